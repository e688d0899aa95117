"""The stored job tables: independent of the cuts, untouched files, tiers, changes between batches."""

import hashlib
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import fold, maintain
from jobloom.streaming import ingest, store
from test_jobs import mixed_log


def shown(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def whole_tables(events):
    return fold.tables_of(fold.reduce_log(events))


def same_tables(got, want):
    for name, df in want.items():
        assert shown(got[name].select(*df.columns)) == shown(df), name


def with_cuts(spark, events, path, cuts, **options):
    kept = store.JobStore(path, **options)
    for k, (a, b) in enumerate(zip((0, *cuts), (*cuts, 1 << 40))):
        kept.add(events.where((F.col("seq") >= a) & (F.col("seq") < b)), k)
    return kept


def digests(path):
    return {os.path.relpath(os.path.join(d, f), path): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest() for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.mark.parametrize("seed,cuts", [(1, (1, 40)), (3, (5, 44, 80))])
def test_tables_do_not_depend_on_cuts(spark, tmp_path, seed, cuts):
    events = mixed_log(spark, seed).cache()
    kept = with_cuts(spark, events, str(tmp_path), cuts, buckets=3, fanout=2)
    same_tables(kept.tables(spark), whole_tables(events))
    for version, bound in enumerate(cuts):
        same_tables(kept.tables(spark, version), whole_tables(events.where(F.col("seq") < bound)))


def test_stream_equals_batch(spark, tmp_path):
    events = mixed_log(spark, 4)
    for a, b in ((0, 20), (20, 30), (30, 70), (70, 90)):
        events.where((F.col("seq") >= a) & (F.col("seq") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.stream_batches(spark, str(tmp_path / "in"), events.schema, 1)
    assert ingest.run_ingest_stream(stream, str(tmp_path / "tables"), str(tmp_path / "offsets"), available_now=True).awaitTermination(300)
    kept = store.JobStore(str(tmp_path / "tables"))
    assert kept.last_batch(spark) == 3
    same_tables(kept.tables(spark), whole_tables(events))
    before = digests(tmp_path / "tables")
    kept.add(events.where("seq < 5"), 3)  # a replayed batch finds its list
    assert digests(tmp_path / "tables") == before


def steady_log(spark, jobs):
    """Jobs that follow each other, each ended soon; every tenth stays open. Keys rise with time."""
    rows = []
    for j in range(jobs):
        job, run = f"job-{j:06d}", f"run-{j:06d}"
        rows += [(job, run, k) for k in ("SubmitJob", "JobRunLeased", "JobRunAssigned", "JobRunRunning", *(() if j % 10 == 0 else ("JobRunSucceeded", "JobSucceeded")))]
    kinds = "job_id string, run_id string, kind string, seq long"
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], kinds)
    some = lambda x, kind="string": F.lit(x).cast(kind)
    return df.withColumns({
        "queue": some("q"), "jobset": some("s"), "user": some("u"), "created": F.col("seq") + 1000, "priority": some(1, "long"), "reason": some("r"), "requestor": some(None), "cluster": some("c"), "node": some("n"), "pool": some("p"),
        "terminal": F.lit(True), "error_kind": some(None), "exit_code": some(0, "int"), "bytes": some(1, "long"),
    }), len(rows)


def test_untouched_files_stay(spark, tmp_path):
    batches = 8
    events, n = steady_log(spark, 80)
    events = events.cache()
    kept = store.JobStore(str(tmp_path), buckets=2, fanout=3, keep=4)
    untouched, written = 0, []
    for k in range(batches):
        was, seen = kept.files(kept.manifest(spark, k - 1)), digests(tmp_path)
        kept.add(events.where((F.col("seq") >= n * k // batches) & (F.col("seq") < n * (k + 1) // batches)), k)
        is_, now = kept.files(kept.manifest(spark, k)), digests(tmp_path)
        assert all(now[f] == seen[f] for f in was & is_)
        untouched += len(was & is_)
        written.append(len(is_ - was))
    assert untouched > 2 * sum(written[1:]) / 3 and max(written) <= 2 * min(written[1:]) + 8
    same_tables(kept.tables(spark), whole_tables(events))
    with pytest.raises(ValueError):
        kept.read(spark, "job", version=batches - 5)
    # what only forgotten lists named is gone; beside what is named there are parts that were merged within their batch
    named = set().union(*(kept.files(kept.manifest(spark, j)) for j in range(batches - 4, batches)))
    assert len(set(digests(tmp_path)) - named) <= 3 * batches


def test_folders_grow_with_the_logarithm(spark, tmp_path):
    batches, fanout = 60, 4
    kept, before, parts = store.JobStore(str(tmp_path), buckets=1, fanout=fanout), None, []
    for k in range(batches):
        after = {}
        delta = spark.createDataFrame([(f"job-{k:04d}", f"e{k}", k), (f"job-{k // 2:04d}", "late", k)], "job_id string, error string, serial long")
        kept._merge(spark, "job_error", delta.dropDuplicates(["job_id"]), before, after, k)
        before = after
        parts.append(len(after["job_error"]["cold"]))
    assert max(parts) <= fanout * (1 + math.log(batches, fanout)) < batches / 3
    kept._commit(spark, 0, {"tables": before, "source": None})
    got = {r.job_id: r.error for r in kept.read(spark, "job_error").collect()}
    assert len(got) == batches and all(got[f"job-{k:04d}"] == f"e{k}" for k in range(1, batches))


def plain_changes(was, is_):
    out = {}
    for key, row in is_.items():
        if row != was.get(key):
            out[key] = ("updated" if key in was else "inserted", was.get(key), row)
    return out


@pytest.mark.parametrize("seed", [5])
def test_change_feed_is_the_difference(spark, tmp_path, seed):
    events, cuts = mixed_log(spark, seed).cache(), (10, 26, 60)
    kept = with_cuts(spark, events, str(tmp_path / "a"), cuts, buckets=3, fanout=2)
    values = lambda r: {c: v for c, v in r.asDict(True).items() if c != "serial"}
    for name, key in store.KEYS.items():
        at = lambda v: {r[key]: values(r) for r in kept.read(spark, name, version=v).collect()} if v >= 0 else {}
        for after, upto in ((-1, 0), (0, 3), (2, 2)):
            got = {r[key]: (r["change"], r["before"] and values(r["before"]) | {key: r[key]}, values(r["after"]) | {key: r[key]}) for r in kept.changes(spark, name, after, upto).collect()}
            assert got == plain_changes(at(after), at(upto)), (name, after, upto)
    # a replay of the log gives the same serials, whatever its cuts
    other = with_cuts(spark, events, str(tmp_path / "b"), (random.Random(seed).randrange(1, 90),), buckets=5)
    for name in store.KEYS:
        assert shown(other.read(spark, name)) == shown(kept.read(spark, name)), name


def test_retention_leaves_later_days_alone(spark, tmp_path):
    day = 86_400
    jobs = [("a", 4, 0, 5), ("b", 4, 10, 20), ("c", 4, day, day + 5), ("d", 1, day, day + 5), ("e", 4, day, 9 * day), ("f", 4, 8 * day, 8 * day + 1), ("g", 4, 9 * day, 9 * day)]
    runs = [(f"r{k}", j, k) for k, j in enumerate("aabcdefg")] + [("lost", "nobody", 9)]
    path = str(tmp_path)
    maintain.write_daily({"job": spark.createDataFrame(jobs, "job_id string, state int, submitted long, last_transition_time long"), "job_run": spark.createDataFrame(runs, "run_id string, job_id string, n int"), "job_error": spark.createDataFrame([("c", "x")], "job_id string, error string")}, path)
    before = digests(path)
    report = maintain.prune_jobs_daily(spark, path, 9 * day, 2 * day)
    assert sorted((str(r.day), r.jobs, r.gone) for r in report.collect()) == [("1970-01-01", 2, 2), ("1970-01-02", 3, 1)]
    after = digests(path)
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("day=")[1].split("/")[0] for f in same} == {"1970-01-09", "1970-01-10", "__HIVE_DEFAULT_PARTITION__"}
    assert sorted(r.job_id for r in maintain.read_daily(spark, path, "job").collect()) == ["d", "e", "f", "g"]
    assert sorted(r.run_id for r in maintain.read_daily(spark, path, "job_run").collect()) == ["lost", "r4", "r5", "r6", "r7"]
    assert maintain.read_daily(spark, path, "job_error").count() == 0 if os.listdir(f"{path}/job_error") and any("day=" in f for f in os.listdir(f"{path}/job_error")) else True
    # only the days up to the limit are opened
    old = spark.read.parquet(f"{path}/job").where(F.col("day") <= F.to_date(F.timestamp_seconds(F.lit(7 * day))))
    files = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files
    assert maintain.prune_jobs_daily(spark, path, 9 * day, 2 * day).count() == 0


def moved(spark):
    """Rows that all stages of the session have dealt and written so far."""
    jvm, sc = spark._jvm, spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
    return {s.stageId(): (s.shuffleWriteRecords(), s.outputRecords()) for s in (stages.apply(k) for k in range(stages.size()))}


def test_large_days_are_dealt_and_written_once(spark, tmp_path, monkeypatch):
    day, n = 86_400, 3_000
    monkeypatch.setattr(maintain, "LARGE_FOLDER", 1, raising=False)
    was_limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    i = F.col("id")
    jobs = spark.range(n).select(F.format_string("j%d", i).alias("job_id"), F.when(i % 2 == 0, 4).otherwise(1).alias("state"), (i % 3 * day).alias("submitted"), (i % 3 * day + 5).alias("last_transition_time"))
    runs = spark.range(4 * n + 1).select(i.cast("string").alias("run_id"), F.format_string("j%d", F.floor(i / 4)).alias("job_id"))  # the last one's job isn't there
    path = str(tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = moved(spark)
        maintain.write_daily({"job": jobs, "job_run": runs}, path)
        second = moved(spark)
        report = maintain.prune_jobs_daily(spark, path, 9 * day, 2 * day)
        third = moved(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was_limit)
    new = lambda a, b, k: sum(v[k] for s, v in b.items() if s not in a)
    assert new(first, second, 0) < 5 * n + 100 and new(first, second, 1) == 5 * n + 1
    assert new(second, third, 0) < 4 * n + n // 2 + 100 and new(second, third, 1) == n // 2 + 2 * n
    assert sorted((r.jobs, r.gone) for r in report.collect()) == [(n // 3, n // 6)] * 3
    gone = maintain.prunable(jobs, 9 * day, 2 * day)
    for name, df in (("job", jobs), ("job_run", runs)):
        assert shown(maintain.read_daily(spark, path, name)) == shown(df.join(gone, "job_id", "left_anti")), name


def test_tasks_of_large_days_follow_the_bytes(spark, tmp_path, monkeypatch):
    day, n, share = 86_400, 15_000, 150_000
    for name, value in (("LARGE_FOLDER", 1), ("TASK_BYTES", share), ("FILE_BYTES", 1)):
        monkeypatch.setattr(maintain, name, value, raising=False)
    i, confs = F.col("id"), {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40"}
    jobs = spark.range(n, numPartitions=2).select(F.format_string("j%d", i).alias("job_id"), F.when(i % 4 == 0, 4).otherwise(1).alias("state"), (i % 3 * day).alias("submitted"), (i % 3 * day + 5).alias("last_transition_time"))
    runs = spark.range(4 * n, numPartitions=2).select(F.format_string("run-%020d", i).alias("run_id"), F.format_string("j%d", F.floor(i / 4)).alias("job_id"))
    notes = spark.range(0, n, 2, 2).select(F.format_string("j%d", i).alias("job_id")).select("job_id", F.create_map(F.lit("of"), "job_id").alias("notes"))
    path, was = str(tmp_path), {c: spark.conf.get(c) for c in confs}
    most = lambda name: max(r[1] for r in spark.read.parquet(f"{path}/{name}").groupBy(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1)).count().collect())
    for c, value in confs.items():
        spark.conf.set(c, value)
    try:
        maintain.write_daily({"job": jobs, "job_run": runs, "note": notes}, path)
        # a task has its share of jobs, and of runs (some 100 bytes each), and a small table isn't dealt over all partitions
        assert most("job") * 100 < 1.5 * share and most("job_run") * 100 < 1.5 * share
        assert len({f.split("part-")[1][:5] for f in digests(f"{path}/note") if "part-" in f}) < 20
        maintain.prune_jobs_daily(spark, path, 9 * day, 2 * day)
        assert most("job_run") * 100 < 1.5 * share
    finally:
        for c, value in was.items():
            spark.conf.set(c, value)
    gone = maintain.prunable(jobs, 9 * day, 2 * day)
    for name, df in (("job", jobs), ("job_run", runs)):
        assert shown(maintain.read_daily(spark, path, name)) == shown(df.join(gone, "job_id", "left_anti")), name
    assert maintain.read_daily(spark, path, "note").count() == n // 4


def test_batches_by_items_go_on_after_a_stop(spark, tmp_path):
    events = mixed_log(spark, 6).coalesce(1)
    events.write.parquet(str(tmp_path / "in"))
    kept, added = store.JobStore(str(tmp_path / "tables"), buckets=2), []

    class Stopped(store.JobStore):
        def add(self, rows, batch, source=None):
            if len(added) == 2:
                raise RuntimeError("stopped")
            added.append(rows.count())
            super().add(rows, batch, source)

    log = spark.read.parquet(str(tmp_path / "in"))
    n = log.count()
    with pytest.raises(RuntimeError):
        Stopped(str(tmp_path / "tables"), buckets=2).add_in_parts(log, 0, 40)
    assert added == [40, 40] and kept.source(spark) == (0, 1)
    kept.add_in_parts(log, 0, 40)
    assert kept.last_batch(spark) == -(-n // 40) - 1 and kept.source(spark) == (0, -(-n // 40) - 1)
    same_tables(kept.tables(spark), whole_tables(log))
    kept.add_in_parts(log, 0, 40)  # a repeated one is there already
    assert kept.last_batch(spark) == -(-n // 40) - 1


@pytest.mark.parametrize("seed", [7])
def test_says_are_the_reduced_log(spark, seed):
    events = mixed_log(spark, seed).cache()
    reduced = fold.reduce_log(events)
    rows = lambda df, key: {r[key]: {c: v for c, v in r.asDict(True).items() if c != key} for r in df.collect()}
    until, late = (rows(reduced["job_update"].where(c).drop("single"), "job_id") for c in ("not single", "single"))
    parts = {"job_id": (fold.job_says(events), {"c": rows(reduced["job_create"], "job_id"), "u": until, "p": late}), "run_id": (fold.run_says(events), {"c": rows(reduced["run_create"], "run_id"), "u": rows(reduced["run_update"], "run_id")})}
    for key, (says, want) in parts.items():
        got = rows(says, key)
        for name, told in want.items():
            assert {k: r[name] for k, r in got.items() if r[name] is not None} == told, (key, name)


def test_spans_begin_where_the_cuts_do(spark):
    from jobloom.jobs.store_queries import _span

    for a, n, spans in ((0, 100, 20), (7, 33, 20), (5, 3, 20), (0, 1001, 4)):
        log = spark.range(a, a + n).withColumnRenamed("id", "seq")
        got = {r.seq: r.k for r in log.select("seq", _span(log, spans).alias("k")).collect()}
        assert all(got[s] == max(k for k in range(spans) if n * k // spans <= s - a) for s in range(a, a + n))
    empty = spark.range(0).withColumnRenamed("id", "seq")
    assert empty.select(_span(empty, 3)).count() == 0


def test_a_batch_is_spread_over_tasks(spark, sf_dir, monkeypatch):
    """No file of the feed is a whole batch, since one task would read it."""
    from jobloom.jobs import store_queries
    from jobloom.sources import model

    seen = []
    monkeypatch.setattr(store_queries.m, "job_event", lambda spark, d: model.table(spark, d, "events").select(F.col("event_id").alias("seq")).repartition(4))
    monkeypatch.setattr(store_queries.JobStore, "last_batch", lambda self, spark: len(seen) - 1)
    monkeypatch.setattr(ingest.JobStore, "add", lambda self, df, batch: seen.append(len(df.inputFiles()) or df.rdd.getNumPartitions()))
    store_queries._ingest(spark, sf_dir, 3)
    assert len(seen) == 3 and min(seen) > 1
