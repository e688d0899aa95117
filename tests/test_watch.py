"""Watched jobs, penalties that lapse, sketches that merge."""

import random

import pytest
from pyspark.sql import functions as F

from jobloom.operators import sketches, watch
from jobloom.streaming import ingest, penalty

API = "queue string, jobset string, job_id string, seq long, subseq int, created long, api_kind string, retryable boolean, pod int, pods int"


@pytest.mark.parametrize(
    ("events", "status", "pods"),
    [
        # kind, time, pod; a job has two pods
        ([("submitted", 1, 0), ("queued", 1, 0), ("leased", 2, 0)], "leased", ["submitted", "submitted"]),
        ([("submitted", 1, 0), ("pending", 3, 0), ("running", 4, 1)], "pending", ["pending", "running"]),
        ([("submitted", 1, 0), ("running", 3, 0), ("running", 4, 1)], "running", ["running", "running"]),
        ([("submitted", 1, 0), ("running", 3, 0), ("succeeded", 5, 1)], "running", ["running", "succeeded"]),
        ([("submitted", 1, 0), ("succeeded", 3, 0), ("succeeded", 5, 1)], "succeeded", ["succeeded", "succeeded"]),
        ([("submitted", 1, 0), ("running", 3, 0), ("failed", 5, 1), ("succeeded", 6, 0)], "failed", ["succeeded", "failed"]),
        # a failure that is tried again, and a lease that comes back, begin anew
        ([("submitted", 1, 0), ("running", 3, 0), ("again", 5, 1)], "queued", ["submitted", "submitted"]),
        ([("submitted", 1, 0), ("running", 3, 0), ("lease_returned", 5, 0), ("leased", 6, 0)], "leased", ["submitted", "submitted"]),
        # out of time order: of the job, of one pod
        ([("submitted", 5, 0), ("leased", 4, 0)], "submitted", ["submitted", "submitted"]),
        ([("submitted", 1, 0), ("running", 7, 0), ("pending", 3, 0)], "running", ["running", "submitted"]),
        ([("submitted", 1, 0), ("cancelled", 9, 0), ("running", 7, 0)], "cancelled", ["running", "submitted"]),
        ([("pending", 2, 3)], "pending", ["submitted", "submitted", "submitted", "pending"]),
    ],
)
def test_a_job_and_its_pods(events, status, pods):
    job = watch.WatchedJob()
    for kind, at, pod in events:
        job.take("failed" if kind == "again" else kind, at, kind == "again", pod, 2)
    assert (job.status, job.pod_status) == (status, pods)
    assert watch.WatchedJob(*job.state()).state() == job.state()


def random_api(spark, n, seed):
    rng, kinds = random.Random(seed), ["submitted", "queued", "leased", "lease_returned", "pending", "running", "failed", "succeeded", "cancelled", "reprioritized"]
    rows = [("q", f"s{j % 2}", f"j{j}", i, 0, rng.randrange(i, i + 8), rng.choice(kinds), rng.choice([None, True, False]), rng.randrange(2), 2) for i in range(n) for j in [0 if rng.random() < 0.4 else rng.randrange(9)]]
    return spark.createDataFrame(rows, API)


def test_stream_of_changes_equals_the_table(spark, tmp_path):
    api = random_api(spark, 400, 3)
    for k in range(3):
        api.where(F.floor(F.col("seq") * 3 / 400) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.stream_status_changes(spark.readStream.schema(api.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(200)
    got, want = spark.read.parquet(str(tmp_path / "out")), watch.status_changes(api).cache()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and want.count() > 100
    jobs = watch.watched_jobs(want).cache()
    assert {tuple(r) for r in watch.status_counts(want).collect()} == {tuple(r) for r in jobs.groupBy("status").count().collect()}
    assert watch.status_changes(api.where("false")).count() == 0


def test_a_bucket_of_jobs_is_one_call(spark, tmp_path):
    """Jobs of a bucket share a state, which comes back as it was, whatever pods they have."""
    jobs = {("q", f"s{k % 3}", f"j{k}"): watch.WatchedJob(*(("running", k, ["running"] * k, list(range(k))) if k % 4 else (None, 0, [], []))) for k in range(9)}
    again = watch._jobs_of(watch._state_of(jobs))
    assert {k: j.state() for k, j in again.items()} == {k: j.state() for k, j in jobs.items()} and list(again) == list(jobs)
    api = random_api(spark, 300, 5)
    for k in range(2):
        api.where(F.floor(F.col("seq") * 2 / 300) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = watch.stream_status_changes(spark.readStream.schema(api.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 1)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(200)
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1] == 1
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, watch.status_changes(api).collect()), key=repr)


def test_a_penalty_counts_once_and_lapses(spark, tmp_path):
    rows = [  # job, pool, start, report
        ("a", "p", 0, 5), ("a", "p", 0, 6), ("b", "p", 0, 100), ("c", "p", 2, 9), ("d", "other", 0, 5), ("e", "q", 0, 60), ("f", "p", 190, 191), ("a", "p", 0, 192), ("g", "p", 390, 400),
    ]
    ends = spark.createDataFrame([(j, "queue", p, s, at, float(ord(j)), 1.0, 0.0) for j, p, s, at in rows], "job_id string, queue string, pool string, started long, at long, cpu double, memory double, gpu double").withColumn("at", F.timestamp_seconds("at"))
    for k in range(5):
        ends.where((F.unix_timestamp("at") >= 100 * k - (k == 0)) & (F.unix_timestamp("at") < 100 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = penalty.penalty_entries(spark.readStream.schema(ends.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), {"p": 50, "q": 200}, "1 second")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(200)
    entries = spark.read.parquet(str(tmp_path / "out")).cache()
    assert sorted((r.job_id, r.sign, r.at) for r in entries.collect()) == [("a", -1, 50), ("a", 1, 5), ("c", -1, 52), ("c", 1, 9), ("e", -1, 200), ("e", 1, 60), ("f", -1, 240), ("f", 1, 191), ("g", 1, 400)]
    at = lambda t: sorted((r.pool, r.jobs, r.cpu) for r in penalty.penalty_at(entries, t).collect())
    assert at(4) == [] and at(10) == [("p", 2, float(ord("a") + ord("c")))] and at(51) == [("p", 1, float(ord("c")))] and at(100) == [("q", 1, float(ord("e")))] and at(210) == [("p", 1, float(ord("f")))] and at(300) == []


def test_sketches_merge_within_their_errors(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50 * 100).alias("at"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("x"), (F.col("id") % 7000).alias("key")).unionByName(spark.sql("select 1L g, 0L at, null x, 1L key"))
    stats = sketches.merged(sketches.sketch(rows, ["g"], "at", "x", "key", period=500), ["g"], 0, 9).cache()
    exact = {r.g: r for r in rows.where("x is not null").groupBy("g").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"), F.count_distinct("key").alias("keys")).collect()}
    for r in stats.collect():
        e = exact[r.g]
        assert (r.n, r.total, r.least, r.most) == (e.n, e.total, e.least, e.most) and abs(r.distinct - e.keys) <= sketches.distinct_error(12) * e.keys
    for r in sketches.ranks(rows, stats, ["g"], "x").collect():
        assert max(r.p50_off, r.p90_off, r.p99_off) <= sketches.rank_error(800)
    assert sketches.merged(sketches.sketch(rows.where("false"), ["g"], "at", "x", "key"), ["g"], 0, 9).count() == 0


def test_jobs_of_one_bucket_lapse_one_by_one(spark, tmp_path):
    """A call serves a whole bucket of jobs, each of which comes and lapses on its own; parts come in many files, one may be empty."""
    reports = [(f"j{k}", 10 * k, 10 * k + again) for k in range(30) for again in (5, 7)]  # job, start, report
    ends = spark.createDataFrame([(j, "queue", "p", s, at, 1.0, 2.0, 0.0) for j, s, at in reports], "job_id string, queue string, pool string, started long, seconds long, cpu double, memory double, gpu double").withColumn("at", F.timestamp_seconds("seconds")).repartition(5)
    writer = lambda stream: penalty.penalty_entries(stream, {"p": 50}, "1 second", buckets=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "offsets"))
    part = F.when(F.col("seconds") < 150, 0).otherwise(2)
    ingest.feed_in_turn(ends, part, 3, lambda stream: writer(stream).start(str(tmp_path / "out")))
    entries = spark.read.parquet(str(tmp_path / "out")).cache()
    assert sorted((r.at, r.job_id) for r in entries.where("sign = 1").collect()) == sorted((10 * k + 5, f"j{k}") for k in range(30))
    passed = 297 - 1  # the watermark
    assert sorted((r.at, r.job_id) for r in entries.where("sign = -1").collect()) == sorted((10 * k + 50, f"j{k}") for k in range(30) if 10 * k + 50 <= passed)
    assert [r.jobs for r in penalty.penalty_at(entries, 120).collect()] == [len([k for k in range(30) if 10 * k + 5 <= 120 < 10 * k + 50])]


def test_a_part_is_a_batch(spark, tmp_path):
    seen = []
    start = lambda stream: stream.writeStream.foreachBatch(lambda df, k: seen.append((k, sorted(r.id for r in df.collect())))).option("checkpointLocation", str(tmp_path)).start()
    ingest.feed_in_turn(spark.range(0, 40, 1, 4), F.when(F.col("id") < 9, 0).when(F.col("id") < 31, 1).otherwise(3), 4, start)
    assert seen == [(0, list(range(9))), (1, list(range(9, 31))), (2, []), (3, list(range(31, 40)))]
