"""Retention, repair and layout of the job tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources.model import ACTIVE_STATES, TERMINAL_STATES
from jobloom.sources.tables import file_system

# fixed values: run state of an ended latest run and the job state that it means
ZOMBIE_STATES = {3: 4, 4: 5, 12: 6, 6: 7}


def ended_before(time: int) -> Column:
    """Whether a job is terminal and had its last transition before a time."""
    return F.col("state").isin(*TERMINAL_STATES) & (F.col("last_transition_time") < time)


def prunable(job: DataFrame, now: int, lifetime: int) -> DataFrame:
    """job_id of terminal jobs whose last transition is longer ago than ``lifetime`` seconds."""
    return job.where(ended_before(now - lifetime)).select("job_id")


def prune_jobs_daily(spark: SparkSession, path: str, now: int, lifetime: int) -> DataFrame:
    """The same over tables of ``write_daily``, in place; a job's transitions don't come before its submission."""
    return prune_daily(spark, path, ended_before(now - lifetime), now - lifetime)


def prune_jobs(tables: Mapping[str, DataFrame], now: int, lifetime: int) -> dict[str, DataFrame]:
    """All tables with a job_id column without the prunable jobs."""
    ids = prunable(tables["job"], now, lifetime)
    return {name: df.join(ids, "job_id", "left_anti") for name, df in tables.items()}


def expire_dedup(dedup: DataFrame, now: int, lifetime: int) -> DataFrame:
    """Without entries inserted at ``now - lifetime`` or before."""
    return dedup.where(F.col("inserted") > now - lifetime)


def _zombies(job: DataFrame, job_run: DataFrame) -> DataFrame:
    ended = job_run.where(F.col("job_run_state").isin(*ZOMBIE_STATES)).select(F.col("run_id").alias("latest_run_id"), F.col("job_run_state").alias("_run"), F.col("finished").alias("_finished"))
    return job.where(F.col("state").isin(*ACTIVE_STATES)).join(ended, "latest_run_id")


def repair_zombies(job: DataFrame, job_run: DataFrame, now: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The repaired job table, and a report of the repairs: active jobs whose latest run ended long ago."""
    to = F.coalesce(*[F.when(F.col("_run") == r, s) for r, s in ZOMBIE_STATES.items()]).cast("short")
    found = _zombies(job, job_run).where(F.col("_finished") < now - threshold)
    report = found.select("job_id", "queue", "jobset", F.col("state").alias("old_state"), to.alias("new_state"), F.col("latest_run_id").alias("run_id"), F.col("_finished").alias("finished"))
    fixed = job.join(report.select("job_id", "new_state", "finished"), "job_id", "left")
    out = fixed.withColumns({"state": F.coalesce("new_state", "state"), "last_transition_time": F.coalesce("finished", "last_transition_time")}).select(*job.columns)
    return out, report


def count_unrepairable_zombies(job: DataFrame, job_run: DataFrame) -> DataFrame:
    """Active jobs whose latest run ended at no known time."""
    return _zombies(job, job_run).where("_finished is null").agg(F.count("*").alias("jobs"))


def prune_scheduler(jobs: DataFrame, children: Mapping[str, DataFrame], now: int, keep: int) -> dict[str, DataFrame]:
    """Ended scheduler jobs not modified since ``now - keep`` go, and their rows in the child tables (P5)."""
    gone = jobs.where((F.col("last_modified") < now - keep) & (F.col("succeeded") | F.col("failed") | F.col("cancelled"))).select("job_id")
    return {"jobs": jobs.join(gone, "job_id", "left_anti")} | {n: df.join(gone, "job_id", "left_anti") for n, df in children.items()}


def prune_markers(markers: DataFrame, now: int, keep: int) -> DataFrame:
    """Without markers created before ``now - keep`` (P5)."""
    return markers.where(F.col("created") >= now - keep)


def write_hot_cold(job: DataFrame, path: str) -> None:
    """Active and terminal jobs in partitions of their own; the file count follows the data, not the tasks."""
    job.withColumn("active", F.col("state").isin(*ACTIVE_STATES)).repartition("active", F.pmod(F.xxhash64("job_id"), F.lit(max(1, job.sparkSession.sparkContext.defaultParallelism)))).write.partitionBy("active").parquet(path)


def read_hot_cold(spark: SparkSession, path: str, active: bool | None = None) -> DataFrame:
    """Both sides, or one; then the other's files aren't read."""
    df = spark.read.parquet(path)
    return (df if active is None else df.where(F.col("active") == active)).drop("active")


def move_terminal(job: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after terminal updates; cancel reason and user stay where the update has none."""
    new = updates.select("job_id", F.col("state").alias("_state"), F.col("cancel_reason").alias("_reason"))
    rows = job.join(new, "job_id", "left")
    return rows.withColumns({"state": F.coalesce("_state", "state"), "cancel_reason": F.coalesce("_reason", "cancel_reason")}).select(*job.columns)


def write_by_submitted_day(job: DataFrame, path: str) -> None:
    """One partition per day of submission, so that retention drops folders."""
    job.withColumn("day", F.to_date(F.timestamp_seconds("submitted"))).repartitionByRange("submitted", "job_id").write.partitionBy("day").parquet(path)


def _period(seconds: str, days: int) -> Column:
    """The first day of the period of so many days that a time falls into, in days from the epoch."""
    return (F.floor(F.col(seconds) / (86_400 * days)) * days).cast("int")


#: Jobs in a folder, on average, from which every task writes a file of its own into it instead of rows being dealt by folders first.
LARGE_FOLDER = 100_000
#: Bytes of rows that a task joins and sorts in memory where folders are large, and of rows that it has for a folder at least.
TASK_BYTES, FILE_BYTES = 64 << 20, 100 << 10


def _bytes(df: DataFrame) -> Column:
    """About the bytes that a table's rows take in memory, as an aggregate."""
    sizes = [F.octet_length(c if t.startswith(("string", "binary")) else F.to_json(c)) for c, t in df.dtypes if t.startswith(("string", "binary", "array", "map", "struct"))]
    return F.coalesce(F.sum(reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), sizes, F.lit(32 + 16 * len(df.columns)))), F.lit(0))


def _tasks(spark: SparkSession, size: int, folders: int) -> int:
    """Tasks, at most ``spark.sql.shuffle.partitions``, that hold so many bytes in memory and don't write crumbs into so many folders.

    A single one would not count as dealt by hash, and its rows would be dealt again.
    """
    return max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / max(TASK_BYTES, FILE_BYTES * folders))))


def _meet(rows: DataFrame, other: DataFrame, size: int, on: list[str], value: Column, folders: int) -> DataFrame:
    """Left join by hash with a table of so many bytes, over as many tasks as it takes to hold both sides in memory.

    The value is computed from the other side once it is dealt: two sides that come straight from a deal would be dealt over
    ``spark.sql.shuffle.partitions`` tasks, however small.
    """
    tasks = _tasks(rows.sparkSession, rows.agg(_bytes(rows)).first()[0] + size, folders)
    return rows.join(other.repartition(tasks, *on).select(*on, value).hint("shuffle_hash"), on, "left")


def write_daily(tables: Mapping[str, DataFrame], path: str, parent: str = "job", submitted: str = "submitted", days: int = 1) -> None:
    """Tables by the day on which their job was submitted, so that retention follows folders through all of them.

    The children of a job lie under its day; children of no job lie under no day, which retention leaves alone. With ``days`` a folder
    holds as many days, for tables with few rows a day. Large days are dealt over several tasks and files: where folders are large,
    rows are dealt once, to meet their job's day by hash without a sort of either side, and over so many tasks that these sort their
    rows in memory; small folders are put together in few files. The parent's rows are dealt only if they are many for each core.
    """
    spark = tables[parent].sparkSession
    number, date = tables[parent].select("job_id", _period(submitted, days).alias("_day")), F.date_from_unix_date("_day").alias("day")
    jobs, folders, size, whole = tables[parent].agg(F.count("*"), F.count_distinct(_period(submitted, days)), _bytes(number), _bytes(tables[parent])).first()
    large = jobs >= LARGE_FOLDER * max(folders, 1)
    for name, df in tables.items():
        if name == parent:
            rows = df.withColumn("day", F.date_from_unix_date(_period(submitted, days)))
            if large and whole > 2 * TASK_BYTES * spark.sparkContext.defaultParallelism:
                rows = rows.repartition(_tasks(spark, whole, folders), "job_id")
        else:
            rows = _meet(df, number, size, ["job_id"], date, folders) if large else df.join(number.select("job_id", date), "job_id", "left")
        (rows if large else rows.hint("rebalance", "day")).sortWithinPartitions("day", "job_id").write.partitionBy("day").parquet(f"{path}/{name}")


def read_daily(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("day")


def prune_daily(spark: SparkSession, path: str, gone: Column, before: int, parent: str = "job") -> DataFrame:
    """Drop the jobs for which ``gone`` holds, and their rows in all tables below ``path``, by days.

    ``before`` (epoch seconds) promises that no job submitted after it can be gone, so later days aren't opened. A day whose jobs all
    go is deleted as a folder; only days of which some go are read and written anew, each swapped as a whole. Children go before
    their jobs, so a run that was cut off is made good by the next. Rows (day, jobs, gone) of the days that changed.
    """
    fs, root = file_system(spark, path)
    names = sorted((f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory() and f.getPath().getName()[0] not in "._"), key=lambda n: n == parent)
    old = F.col("day") <= F.to_date(F.timestamp_seconds(F.lit(before)))
    jobs = spark.read.parquet(f"{path}/{parent}").where(old)
    told = jobs.groupBy("day").agg(F.count("*").alias("jobs"), F.count_if(F.coalesce(gone, F.lit(False))).alias("gone")).where("gone > 0")
    days = told.collect()  # a row per day
    mixed = [r.day for r in days if r.gone < r.jobs]
    if mixed:
        ids = jobs.where(F.col("day").isin(mixed)).where(gone).select("day", "job_id")
        large = sum(r.jobs for r in days if r.gone < r.jobs) >= LARGE_FOLDER * len(mixed)
        size = ids.agg(_bytes(ids)).first()[0] if large else 0
        for name in names:
            table = spark.read.parquet(f"{path}/{name}").where(F.col("day").isin(mixed))
            if name == parent:
                kept = table.where(~F.coalesce(gone, F.lit(False)))
            elif large:
                kept = _meet(table, ids, size, ["day", "job_id"], F.lit(True).alias("_gone"), len(mixed)).where("_gone is null").select(*table.columns)
            else:
                kept = table.join(ids, ["day", "job_id"], "left_anti")
            was = _day_files(spark, path, name, mixed)
            # a dynamic overwrite swaps folders when all tasks are done, so it may read what it replaces
            kept.sortWithinPartitions("day", "job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")
            now = _day_files(spark, path, name, mixed)
            _drop_days(spark, path, name, [d for d in mixed if was[d] & now[d]])  # nothing was left to be written there
    for name in names:
        _drop_days(spark, path, name, [r.day for r in days if r.gone == r.jobs])
    return spark.createDataFrame([(r.day, r.jobs, r.gone) for r in days], "day date, jobs long, gone long")


def _day_files(spark: SparkSession, path: str, name: str, days: Iterable) -> dict:
    """The names of the files in each day's folder."""
    out = {}
    for day in days:
        fs, folder = file_system(spark, f"{path}/{name}/day={day.isoformat()}")
        out[day] = {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()
    return out


def _drop_days(spark: SparkSession, path: str, name: str, days: Iterable) -> None:
    for day in days:
        fs, folder = file_system(spark, f"{path}/{name}/day={day.isoformat()}")
        fs.delete(folder, True)
    spark.catalog.refreshByPath(f"{path}/{name}")
