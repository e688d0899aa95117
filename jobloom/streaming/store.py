"""The job tables kept merged while the log goes on (W2, S3, I19): batches go in, tables and changes between batches come out.

A table is a list of files. Rows that may still change are hot and lie in buckets of their key's hash; ended ones are cold and lie
in parts. A batch is reduced to one row per key, meets the hot rows of the buckets that it touches and those cold files that hold a
row it changes, and writes only these anew; rows that end are appended as a cold part. The list of a batch is written last, in one
step, so readers see a whole batch or none, and every file that a batch doesn't touch stays as it is. Cold parts of one tier are
merged into one of the next as soon as there are ``fanout`` of them, so that their number grows with the logarithm of the batches.

What a list names and the next doesn't is all that differs between two batches: the change feed reads only those files.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.ordering import with_position
from jobloom.operators.fold import JOB_COLUMNS, PREEMPT_OVERRIDES, RUN_COLUMNS, first_errors, job_says, run_says
from jobloom.sources.model import TERMINAL_STATES
from jobloom.sources.tables import discard, file_system, materialise

KEYS = {"job": "job_id", "job_run": "run_id", "job_error": "job_id"}
#: What a job keeps of its latest run, and the run's column that it is.
LATEST = {"latest_cluster": "cluster", "latest_node": "node", "latest_pool": "pool", "latest_run_state": "job_run_state"}
#: What jobs ask of the runs that a batch touched.
RUN_SIDE = ("run_id", "job_id", *LATEST.values(), "serial")
#: Columns that only the store itself needs.
_OWN = ("known", "settled")
#: Bytes of a cold part of the lowest tier; larger ones begin higher, so that they aren't rewritten for the sake of small ones.
SMALL_PART = 64 << 20


def _struct(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name))


def _or_null(df: DataFrame, name: str, fields: Iterable[str]) -> list[str]:
    """Fields that a struct column has."""
    own = set(df.schema[name].dataType.names)
    return [f for f in fields if f in own]


def _late(overrides: Sequence[int]) -> Column:
    return F.col("p").isNotNull() & F.col("o.settled") & F.col("o.state").isin(*overrides)


def apply_to_jobs(rows: DataFrame, overrides: Sequence[int]) -> DataFrame:
    """Rows (job_id, o, c, u, p, r): a stored job, what a batch says, and its latest run if that was touched; as the job after it."""
    o = lambda f: F.col(f"o.{f}")
    was_known, settled = F.coalesce(o("known"), F.lit(False)), F.coalesce(o("settled"), F.lit(False))
    takes = F.col("u").isNotNull() & ~settled
    ended = takes & F.col("u.state").isin(*TERMINAL_STATES)
    late = F.coalesce(_late(overrides), F.lit(False)) | (F.col("p").isNotNull() & ended & (F.col("p.seq") > F.col("u.seq")) & F.col("u.state").isin(*overrides))
    out = rows.withColumns({"_takes": takes, "_late": F.coalesce(late, F.lit(False)), "_new": F.col("c").isNotNull() & ~was_known})
    value = lambda c: F.coalesce(F.when(F.col("_late"), F.col(f"p.{c}")), F.when(F.col("_takes"), F.col(f"u.{c}")), o(c))
    known = was_known | F.col("_new")
    created = lambda c: F.when(was_known, o(c)).otherwise(F.col(f"c.{c}"))
    columns = {c: created(c) for c in rows.schema["c"].dataType.names if c not in (*JOB_COLUMNS, "seq")}
    columns |= {c: value(c) for c in JOB_COLUMNS}
    first = {"priority": F.col("c.priority"), "state": F.lit(1).cast("short"), "last_transition_time": F.col("c.submitted")}
    columns |= {c: F.coalesce(columns[c], F.when(F.col("_new"), x)) for c, x in first.items()}
    seqs = [o("serial"), F.when(F.col("_new"), F.col("c.seq")), F.when(F.col("_takes"), F.col("u.seq")), F.when(F.col("_late"), F.col("p.seq"))]
    columns |= {"known": known, "settled": F.coalesce(value("state").isin(*TERMINAL_STATES), F.lit(False)), "serial": F.greatest(*seqs)}
    return out.select("job_id", "o", *[x.alias(c) for c, x in columns.items()])


def with_latest_run(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs (with their stored row ``o``) with what they keep of their latest run; ``runs`` are the known ones that the batch touched."""
    run = runs.select("job_id", F.col("run_id").alias("latest_run_id"), F.struct(*[F.col(c).alias(k) for k, c in LATEST.items()], "serial").alias("r"))
    rows = jobs.join(run, ["job_id", "latest_run_id"], "left")
    same = F.col("latest_run_id").eqNullSafe(F.col("o.latest_run_id"))
    kept = {k: F.when(F.col("r").isNotNull(), F.col(f"r.{k}")).when(same, F.col(f"o.{k}")) for k in LATEST}
    differs = reduce(Column.__or__, [~x.eqNullSafe(F.col(f"o.{k}")) for k, x in kept.items()])
    serial = F.when(F.col("known") & F.col("r").isNotNull() & differs, F.greatest("serial", "r.serial")).otherwise(F.col("serial"))
    return rows.withColumns(kept | {"_serial": serial}).drop("o", "r", "serial").withColumnRenamed("_serial", "serial")


def apply_to_runs(rows: DataFrame) -> DataFrame:
    """Rows (run_id, o, c, u) as the run after the batch."""
    o = lambda f: F.col(f"o.{f}")
    was_known = F.coalesce(o("known"), F.lit(False))
    new = F.col("c").isNotNull() & ~was_known
    columns = {c: F.when(was_known, o(c)).otherwise(F.col(f"c.{c}")) for c in rows.schema["c"].dataType.names if c not in ("seq", "node", "job_run_state")}
    columns |= {c: F.coalesce(F.col(f"u.{c}"), o(c)) for c in _or_null(rows, "u", (*RUN_COLUMNS, "ingress_addresses"))}
    first = {"node": F.col("c.node"), "job_run_state": F.col("c.job_run_state")}
    columns |= {c: F.coalesce(columns[c], F.when(new, x)) for c, x in first.items()}
    columns |= {"known": was_known | new, "settled": columns["finished"].isNotNull(), "serial": F.greatest(o("serial"), F.when(new, F.col("c.seq")), F.col("u.seq"))}
    return rows.select("run_id", *[x.alias(c) for c, x in columns.items()])


class JobStore:
    """job, job_run and job_error below a path, merged batch by batch.

    Batches follow each other in log order, numbered from 0. The tables are those of ``fold.tables_of`` over the whole log, however
    it was cut: an update may come batches before the create of its key, whose row then stays hot and unseen until then. Rows have a
    ``serial``, the place in the log of the last event that touched them, so that a replay gives the same ones. ``buckets`` is fixed
    when a store is begun: as many as the live rows need at some hundred MB each. Lists of the last ``keep`` batches and their files
    stay for readers and the change feed; older files that no list names are deleted.
    """

    def __init__(self, path: str | os.PathLike, buckets: int = 8, fanout: int = 4, keep: int = 64, preempt_overrides: Sequence[int] = PREEMPT_OVERRIDES):
        self.path, self.buckets, self.fanout, self.keep, self.overrides = os.fspath(path), buckets, fanout, keep, tuple(preempt_overrides)

    # lists of files

    def manifest(self, spark: SparkSession, batch: int) -> dict | None:
        """What the tables consist of after a batch: {table: {schema, hot: {bucket: files}, cold: [{tier, files}]}}."""
        content = self._content(spark, batch)
        return content and content["tables"]

    def _content(self, spark: SparkSession, batch: int) -> dict | None:
        fs, there = file_system(spark, f"{self.path}/_batches/{batch}.json")
        if not fs.exists(there):
            return None
        stream = fs.open(there)
        try:
            return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def source(self, spark: SparkSession, batch: int | None = None) -> tuple[int, int] | None:
        """Which part of which micro-batch of a stream a batch (the last by default) was, if it was one."""
        content = self._content(spark, self.last_batch(spark) if batch is None else batch)
        return tuple(content["source"]) if content and content["source"] else None

    def last_batch(self, spark: SparkSession) -> int:
        """The number of the last batch that is stored whole, or -1."""
        fs, there = file_system(spark, f"{self.path}/_batches")
        names = [f.getPath().getName() for f in fs.listStatus(there)] if fs.exists(there) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=-1)

    @staticmethod
    def files(manifest: Mapping | None, *names: str) -> set[str]:
        """All files that a list names, of some tables or all."""
        tables = [t for name, t in (manifest or {}).items() if not names or name in names]
        return {f for t in tables for files in [*t["hot"].values(), *(p["files"] for p in t["cold"])] for f in files}

    def _commit(self, spark: SparkSession, batch: int, content: dict) -> None:
        fs, there = file_system(spark, f"{self.path}/_batches/{batch}.json")
        _, draft = file_system(spark, f"{self.path}/_batches/.{batch}.draft")
        out = fs.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        fs.rename(draft, there)

    def _forget(self, spark: SparkSession, batch: int) -> None:
        """Drop the list that has become too old, and what it alone names: a file that the next list lacks never comes back."""
        old = self.manifest(spark, batch - self.keep)
        if old is not None:
            for name in [*(self.files(old) - self.files(self.manifest(spark, batch - self.keep + 1))), f"_batches/{batch - self.keep}.json"]:
                fs, there = file_system(spark, f"{self.path}/{name}")
                fs.delete(there, False)

    def _read(self, spark: SparkSession, files: Iterable[str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in sorted(files)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, folder: str) -> tuple[dict[bool, dict[int, list[str]]], int]:
        """Write rows into folders by whether they are hot and by bucket, in the order of their key; the files, and bytes of cold ones."""
        key, spark = KEYS[name], rows.sparkSession
        hot = F.lit(False) if name == "job_error" else ~(F.col("known") & F.col("settled"))
        dealt = rows.withColumns({"hot": hot, "b": self._bucket(key)}).hint("rebalance", "b").sortWithinPartitions("hot", "b", key)
        dealt.write.mode("overwrite").partitionBy("hot", "b").parquet(f"{self.path}/{name}/{folder}")
        fs, pattern = file_system(spark, f"{self.path}/{name}/{folder}/hot=*/b=*/*.parquet")
        out: dict[bool, dict[int, list[str]]] = {True: {}, False: {}}
        size = 0
        for status in fs.globStatus(pattern) or []:
            *_, side, bucket, file = status.getPath().toString().rsplit("/", 3)
            out[side == "hot=true"].setdefault(int(bucket[2:]), []).append(f"{name}/{folder}/{side}/{bucket}/{file}")
            size += 0 if side == "hot=true" else status.getLen()
        return out, size

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # a batch

    def add_in_parts(self, events: DataFrame, micro_batch: int, most: int) -> None:
        """Merge a micro-batch of a stream in batches of at most ``most`` events, in log order.

        Each batch notes which part of which micro-batch it is, so that one that is repeated after a stop goes on where it ended.
        """
        spark = events.sparkSession
        done = self.source(spark) or (-1, -1)
        if done[0] > micro_batch:
            return
        placed = with_position(events, "seq", position="_place")
        n = placed.count()
        for part in range(-(-n // most)):
            if (micro_batch, part) > done:
                rows = placed.where((F.col("_place") >= part * most) & (F.col("_place") < (part + 1) * most)).drop("_place")
                self.add(rows, self.last_batch(spark) + 1, (micro_batch, part))

    def add(self, events: DataFrame, batch: int, source: tuple[int, int] | None = None) -> None:
        """Merge one micro-batch of flat events. One that is stored already changes nothing."""
        spark = events.sparkSession
        if self.manifest(spark, batch) is not None:
            return
        before = self.manifest(spark, batch - 1)
        if before is None and batch:
            raise ValueError(f"batch {batch - 1} isn't stored yet")
        events.persist()
        after: dict[str, dict] = {}
        # what is read more than once is written: its files are as few as its rows ask for, where a cached plan has a task per shuffle partition
        with ThreadPoolExecutor(2) as pool:
            # errors need nothing of runs or jobs, and jobs need runs only to be merged
            said = pool.submit(inheritable_thread_target(lambda: materialise(job_says(events))))
            failed = pool.submit(inheritable_thread_target(lambda: self._merge(spark, "job_error", materialise(first_errors(events).withColumnRenamed("seq", "serial")), before, after, batch)[0]))
            runs, run_files = self._merge(spark, "job_run", materialise(run_says(events)), before, after, batch)
            touched = materialise(self._read(spark, run_files, T.StructType.fromJson(after["job_run"]["schema"])).where("known").select(*RUN_SIDE).join(runs.select("run_id"), "run_id", "left_semi"))
            says, errors = said.result(), failed.result()
        jobs = materialise(says.join(touched.select("job_id").distinct(), "job_id", "full_outer"))
        self._merge(spark, "job", jobs, before, after, batch, touched)
        self._commit(spark, batch, {"tables": after, "source": source})
        events.unpersist()
        discard(runs, touched, says, jobs, errors)
        self._forget(spark, batch)

    def _changes(self, name: str, rows: DataFrame, touched: DataFrame | None) -> DataFrame:
        """Stored cold rows (key, _file, o) beside a batch's (c, u, p): with whether the batch changes them."""
        if name != "job":
            return rows.withColumn("_changed", F.col("u").isNotNull() if name == "job_run" else F.lit(False))
        run = touched.select("job_id", F.col("run_id").alias("_latest"), F.struct(*[F.col(c).alias(k) for k, c in LATEST.items()]).alias("r"))
        rows = rows.withColumn("_latest", F.col("o.latest_run_id")).join(run, ["job_id", "_latest"], "left")
        copied = F.col("r").isNotNull() & reduce(Column.__or__, [~F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in LATEST])
        return rows.withColumn("_changed", F.coalesce(_late(self.overrides), F.lit(False)) | copied)

    def _merge(self, spark: SparkSession, name: str, delta: DataFrame, before: dict | None, after: dict, batch: int, touched: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """Merge one table; its delta, and the files that were written."""
        key = KEYS[name]
        state = (before or {}).get(name)
        told = delta.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"), F.collect_set(self._bucket(key)).alias("buckets")).first()
        if state is not None and not told.n:
            after[name] = state
            return delta, []
        news, stored, changed_files, hits = delta, None, set(), None
        if state is not None:
            schema = T.StructType.fromJson(state["schema"])
            cold = [f for part in state["cold"] for f in part["files"]]
            if cold:
                # keys that rise with time keep this to the files of their span; a row tells its file
                near = self._read(spark, cold, schema).where(F.col(key).between(told.low, told.high)).select(key, F.col("_metadata.file_path").alias("_file"), F.struct(*[c for c in schema.names if c != key]).alias("o"))
                hits = materialise(self._changes(name, near.join(delta, key), touched).select(key, "_file", "_changed"))
                changed_files = {"/".join(r[0].split("/")[-5:]) for r in hits.where("_changed").select("_file").distinct().collect()}
                if changed_files.difference(cold):
                    raise ValueError(f"files that no list names: {changed_files.difference(cold)}")
                news = delta.join(hits.where("not _changed").select(key), key, "left_anti")
            hot = [f for b in told.buckets for f in state["hot"].get(str(b), [])]
            stored = self._read(spark, {*hot, *changed_files}, schema)
        rows = self._applied(name, news, stored, touched)
        files, size = self._write(rows, name, str(batch))
        if hits is not None:
            discard(hits)
        hot = dict(state["hot"]) if state else {}
        hot |= {str(b): files[True].get(b, []) for b in told.buckets}
        parts = [{"tier": p["tier"], "files": [f for f in p["files"] if f not in changed_files]} for p in (state["cold"] if state else [])]
        parts.append({"tier": self._tier(size), "files": [f for fs in files[False].values() for f in fs]})
        after[name] = {"schema": rows.schema.jsonValue(), "hot": hot, "cold": self._tiered(spark, name, rows.schema, [p for p in parts if p["files"]], batch)}
        return delta, [f for side in files.values() for fs in side.values() for f in fs]

    def _applied(self, name: str, news: DataFrame, stored: DataFrame | None, touched: DataFrame | None) -> DataFrame:
        key = KEYS[name]
        if name == "job_error":  # the first stays
            return news if stored is None else stored.unionByName(news.join(stored.select(key), key, "left_anti"))
        if stored is None:
            kinds = {"job": self._job_state, "job_run": self._run_state}[name](news)
            rows = news.withColumn("o", F.lit(None).cast(kinds))
        else:
            rows = _struct(stored, key, "o").join(news, key, "full_outer")
        return apply_to_runs(rows) if name == "job_run" else with_latest_run(apply_to_jobs(rows, self.overrides), touched)

    @staticmethod
    def _run_state(delta: DataFrame) -> T.StructType:
        create, update = (delta.schema[n].dataType for n in ("c", "u"))
        kinds = {f.name: f.dataType for f in [*create.fields, *update.fields] if f.name != "seq"}
        return T.StructType([T.StructField(c, k) for c, k in kinds.items()] + [T.StructField("known", T.BooleanType()), T.StructField("settled", T.BooleanType()), T.StructField("serial", create["seq"].dataType)])

    @staticmethod
    def _job_state(delta: DataFrame) -> T.StructType:
        state = JobStore._run_state(delta)
        latest = [T.StructField(c, T.ShortType() if c == "latest_run_state" else T.StringType()) for c in LATEST]
        return T.StructType([*state.fields, *latest])

    # cold parts

    def _tier(self, size: int) -> int:
        return max(0, int(math.log(max(1, size / SMALL_PART), self.fanout)))

    def _tiered(self, spark: SparkSession, name: str, schema: T.StructType, parts: list[dict], batch: int) -> list[dict]:
        """Merge the parts of a tier into one of the next, as long as any tier is full."""
        tier = 0
        while parts and tier <= max(p["tier"] for p in parts):
            full = [p for p in parts if p["tier"] == tier]
            if len(full) >= self.fanout:
                files, size = self._write(self._read(spark, [f for p in full for f in p["files"]], schema), name, f"{batch}-{tier + 1}")
                parts = [p for p in parts if p["tier"] != tier] + [{"tier": max(tier + 1, self._tier(size)), "files": [f for fs in files[False].values() for f in fs]}]
            tier += 1
        return parts

    # reading

    def _at(self, spark: SparkSession, version: int | None) -> dict:
        version = self.last_batch(spark) if version is None else version
        if (content := self.manifest(spark, version)) is None:
            raise ValueError(f"no batch {version} is stored below {self.path}")
        return content

    def read(self, spark: SparkSession, name: str, active: bool | None = None, version: int | None = None) -> DataFrame:
        """A table after a batch (the last by default); with ``active`` only that side, of which no other file is opened."""
        state = self._at(spark, version)[name]
        sides = {True: [f for fs in state["hot"].values() for f in fs], False: [f for p in state["cold"] for f in p["files"]]}
        rows = self._read(spark, [f for side, fs in sides.items() for f in fs if active in (None, side)], T.StructType.fromJson(state["schema"]))
        return rows if name == "job_error" else rows.where("known").drop(*_OWN)

    def tables(self, spark: SparkSession, version: int | None = None) -> dict[str, DataFrame]:
        """job, job_run and job_error after a batch, the last by default."""
        return {name: self.read(spark, name, version=version) for name in KEYS}

    def changes(self, spark: SparkSession, name: str, after: int, upto: int | None = None) -> DataFrame:
        """The net change of a table from one batch (-1: none yet) to a later one.

        Rows (key, change, serial, before, after): ``inserted`` or ``updated``, and the row as it was and as it is; a row that was
        touched but is as before isn't there. Only files that one of the two batches has and the other hasn't are read.
        """
        new, key = self._at(spark, upto), KEYS[name]
        old = self._at(spark, after) if after >= 0 else {}
        schema = T.StructType.fromJson(new[name]["schema"])
        was, is_ = self.files(old, name), self.files(new, name)
        seen = F.lit(True) if name == "job_error" else F.col("known")
        rows = lambda files, as_: _struct(self._read(spark, files, schema).where(seen).drop(*_OWN), key, as_)
        both = rows(was - is_, "before").join(rows(is_ - was, "after"), key, "full_outer").where(~F.col("before.serial").eqNullSafe(F.col("after.serial")))
        values = [f for f in schema.names if f not in (key, "serial", *_OWN)]
        differs = reduce(Column.__or__, [~F.to_json(F.struct(F.col(f"before.{f}"))).eqNullSafe(F.to_json(F.struct(F.col(f"after.{f}")))) for f in values])
        return both.where(F.col("before").isNull() | differs).select(key, F.when(F.col("before").isNull(), "inserted").otherwise("updated").alias("change"), F.col("after.serial").alias("serial"), "before", "after")
