"""Queries of streams with state: watched jobs, and the penalty of short jobs as it lapses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.jobs.health_queries import _API
from jobloom.jobs.registry import query
from jobloom.operators import events as e
from jobloom.operators import sketches, watch
from jobloom.sources import model as m
from jobloom.sources.model import NOW
from jobloom.sources.tables import shared_folder
from jobloom.streaming import dedup, ingest, penalty


def _streamed(rows: DataFrame, order: str, parts: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream gives to which a table comes in so many parts that follow each other in an order, one in a batch."""
    spark, out = rows.sparkSession, shared_folder(rows.sparkSession, "out")
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    place = F.when(F.lit(ends.a == ends.b), 0).otherwise(F.floor((F.col(order) - F.lit(ends.a)).cast("double") * parts / F.lit(max(1, (ends.b or 0) - (ends.a or 0) + 1))))

    def start(stream: DataFrame):
        writer = step(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", shared_folder(spark, "offsets"))
        return writer.trigger(processingTime="0 seconds").start(out)

    ingest.feed_in_turn(rows, place.cast("int"), parts, start)
    return spark.read.schema(step(rows).schema).parquet(out)


def _watched_api(spark, d):
    """API events of jobs with two pods each."""
    return e.to_api_events(m.job_event(spark, d)).withColumns({"pod": (F.floor(F.col("seq") / 12) % 2).cast("int"), "pods": F.lit(2)})


_FOLD = """, ev AS (SELECT *, seq // 12 % 2 AS pod, coalesce(retryable, FALSE) AS again, row_number() OVER (PARTITION BY job_id ORDER BY seq, subseq) AS rn FROM api WHERE api_kind IN ('submitted', 'queued', 'leased', 'lease_returned', 'lease_expired', 'cancelled', 'pending', 'running', 'failed', 'succeeded')),
g AS (SELECT queue, jobset, job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, 0 AS subseq, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS st, CAST(0 AS BIGINT) AS lu, CAST(0 AS BIGINT) AS n, 'submitted' AS s0, CAST(0 AS BIGINT) AS t0, 'submitted' AS s1, CAST(0 AS BIGINT) AS t1 FROM ev WHERE rn = 1
UNION ALL SELECT queue, jobset, job_id, rn, seq, subseq, st AS before, CASE WHEN takes THEN CASE WHEN api_kind IN ('submitted', 'leased', 'cancelled') THEN api_kind ELSE 'queued' END WHEN fails THEN 'queued' WHEN hit AND lu <= greatest(nt0, nt1) THEN CASE WHEN 'failed' IN (ns0, ns1) THEN 'failed' WHEN 'pending' IN (ns0, ns1) THEN 'pending' WHEN 'running' IN (ns0, ns1) THEN 'running' ELSE 'succeeded' END ELSE st END AS st,
  CASE WHEN takes THEN created WHEN hit AND lu <= greatest(nt0, nt1) THEN greatest(nt0, nt1) ELSE lu END AS lu, nn AS n, ns0 AS s0, nt0 AS t0, ns1 AS s1, nt1 AS t1 FROM
  (SELECT *, CASE WHEN resets THEN 'submitted' WHEN hit AND pod = 0 THEN api_kind ELSE s0 END AS ns0, CASE WHEN resets THEN 0 WHEN hit AND pod = 0 THEN created ELSE t0 END AS nt0, CASE WHEN resets THEN 'submitted' WHEN hit AND pod = 1 THEN api_kind ELSE s1 END AS ns1, CASE WHEN resets THEN 0 WHEN hit AND pod = 1 THEN created ELSE t1 END AS nt1,
    CASE WHEN takes AND api_kind = 'submitted' THEN greatest(n, 2) WHEN of_pod THEN greatest(n, pod + 1) ELSE n END AS nn FROM
    (SELECT *, of_pod AND CASE pod WHEN 0 THEN t0 ELSE t1 END <= created AS hit, (takes AND api_kind IN ('lease_returned', 'lease_expired')) OR fails AS resets FROM
      (SELECT ev.*, st, lu, n, s0, t0, s1, t1, api_kind IN ('submitted', 'queued', 'leased', 'lease_returned', 'lease_expired', 'cancelled') AND lu <= created AS takes, api_kind = 'failed' AND again AS fails, api_kind IN ('pending', 'running', 'succeeded') OR (api_kind = 'failed' AND NOT again) AS of_pod
       FROM g JOIN ev ON ev.job_id = g.job_id AND ev.rn = g.rn + 1) a) b) c),
ch AS (SELECT * FROM g WHERE rn > 0 AND st IS DISTINCT FROM before),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) AS last FROM g WHERE rn > 0) x WHERE last = 1)"""
_RUNNING = "CAST((CASE WHEN s0 = 'running' THEN 1 ELSE 0 END) + (CASE WHEN s1 = 'running' THEN 1 ELSE 0 END) AS BIGINT) AS pods_running"


@query("w5_status_changes", _API + _FOLD + f" SELECT queue, jobset, job_id, seq, subseq, before, st AS status, lu AS updated, n AS pods, {_RUNNING} FROM ch", recursive=True)
def w5_changes(spark, d):
    return watch.status_changes(_watched_api(spark, d)).withColumn("subseq", F.col("subseq").cast("long"))


@query("w5_watched_jobs", _API + _FOLD + f", lc AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) AS last FROM ch) SELECT queue, jobset, job_id, st AS status, lu AS updated, n AS pods, {_RUNNING} FROM lc WHERE last = 1", recursive=True)
def w5_jobs(spark, d):
    return watch.watched_jobs(watch.status_changes(_watched_api(spark, d)))


@query("w5_status_counts", _API + _FOLD + " SELECT queue, st AS status, count(*) AS jobs FROM fin WHERE st IS NOT NULL GROUP BY queue, st", recursive=True)
def w5_counts(spark, d):
    """Counts by status from the changes that a stream of four batches gives."""
    changes = _streamed(_watched_api(spark, d), "seq", 4, watch.stream_status_changes)
    return watch.status_counts(changes, "queue")


@query("w5_max_used", "SELECT job_id, event_type AS resource, max(value) AS used FROM job_event GROUP BY job_id, event_type")
def w5_used(spark, d):
    return watch.max_used(m.job_event(spark, d).select("job_id", F.col("event_type").alias("resource"), F.col("value").alias("used")))


#: Cutoffs by pool, and the times at which the penalty is asked for.
CUTOFFS, TIMES = {"pool-0": 20_000_000, "pool-1": 50_000_000}, (760_000_000, 800_000_000)
_LAPSE = ", fi AS (SELECT sjob.queue, srun.pool, running_at, terminated_at AS reported, running_at + CASE srun.pool WHEN 'pool-0' THEN 20000000 WHEN 'pool-1' THEN 50000000 END AS deadline, cpu, memory, gpu FROM srun JOIN sjob ON sjob.job_id = srun.job_id WHERE (srun.succeeded OR srun.failed OR srun.cancelled) AND NOT preempted AND NOT preempt_requested AND running_at IS NOT NULL)"


@query("w8_penalty_over_time", _LAPSE + " " + " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS now, pool, queue, count(*) AS jobs, sum(cpu) AS cpu, sum(memory) AS memory, sum(gpu) AS gpu FROM fi WHERE reported <= {t} AND reported < deadline AND deadline > {t} GROUP BY pool, queue" for t in TIMES))
def w8_penalty(spark, d):
    """Every end is reported twice, and counts once."""
    runs = m.scheduler_runs(spark, d).where("(succeeded or failed or cancelled) and not preempted and not preempt_requested and running_at is not null and terminated_at is not null")
    ends = runs.join(m.scheduler_jobs(spark, d).select("job_id", "queue", "cpu", "memory", "gpu"), "job_id").select("job_id", "queue", "pool", F.col("running_at").alias("started"), "terminated_at", F.timestamp_seconds("terminated_at").alias("at"), "cpu", "memory", "gpu")
    entries = _streamed(ends.unionByName(ends), "terminated_at", 4, lambda stream: penalty.penalty_entries(stream, CUTOFFS, "1 hour"))
    return reduce(DataFrame.unionByName, [penalty.penalty_at(entries, t).select(F.lit(t).cast("long").alias("now"), "pool", "queue", "jobs", "cpu", "memory", "gpu") for t in TIMES])


@query("m3_sketched_durations", f"SELECT queue, count(*) AS n, CAST(sum({NOW} - submitted) AS BIGINT) AS total, min({NOW} - submitted) AS least, max({NOW} - submitted) AS most, TRUE AS ranks_hold, TRUE AS distinct_holds FROM sjob WHERE queued AND submitted // 2592000 BETWEEN 280 AND 330 GROUP BY queue")
def m3_sketched(spark, d):
    """Sketches of a month each, stored and merged over four years; whether their errors are within what is stated."""
    rows = m.scheduler_jobs(spark, d).where("queued").select("queue", "priority_class", "submitted", (F.lit(NOW) - F.col("submitted")).alias("seconds"), "scheduling_key")
    path, span = shared_folder(spark, "sketches"), (280, 330)
    sketches.sketch(rows, ["queue", "priority_class"], "submitted", "seconds", "scheduling_key", period=2_592_000).write.parquet(path)
    stats = sketches.merged(spark.read.parquet(path), ["queue"], *span)
    inside = rows.where(F.floor(F.col("submitted") / 2_592_000).between(*span))
    off = sketches.ranks(inside, stats, ["queue"], "seconds")
    keys = inside.groupBy("queue").agg(F.count_distinct("scheduling_key").alias("keys"))
    worst = F.greatest(*[F.col(c) for c in off.columns if c.endswith("_off")])
    # a group of few rows can't hit a rank more finely than by one of them
    holds = (worst <= sketches.rank_error(800) + 1 / F.col("n")).alias("ranks_hold")
    return stats.join(off, "queue").join(keys, "queue").select("queue", "n", "total", "least", "most", holds, (F.abs(F.col("distinct") - F.col("keys")) <= F.greatest(F.lit(1.0), sketches.distinct_error(12) * F.col("keys"))).alias("distinct_holds"))


#: Seconds for which a deduplication id is kept: a week.
KEPT = 604_800
_AGAIN = f""", s AS (SELECT 'j-' || seq AS job_id, seq, created AS made, CASE WHEN seq % 10 <> 0 THEN 'c-' || (seq // 12 % 40) END AS k FROM job_event WHERE kind IN ('SubmitJob', 'JobRunLeased', 'JobSucceeded')),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS rn FROM s WHERE k IS NOT NULL),
g AS (SELECT k, job_id, rn, job_id AS original, made AS stored FROM o WHERE rn = 1 UNION ALL SELECT o.k, o.job_id, o.rn, CASE WHEN o.made >= g.stored + {KEPT} THEN o.job_id ELSE g.original END, CASE WHEN o.made >= g.stored + {KEPT} THEN o.made ELSE g.stored END FROM g JOIN o ON o.k = g.k AND o.rn = g.rn + 1)
SELECT k AS deduplication_id, job_id, original AS original_job_id, original <> job_id AS is_duplicate FROM g UNION ALL SELECT NULL, job_id, job_id, FALSE FROM s WHERE k IS NULL"""


@query("i24_stream_duplicates", _AGAIN, recursive=True)
def i24_stream(spark, d):
    seq = F.col("seq")
    subs = m.job_event(spark, d).where("kind in ('SubmitJob', 'JobRunLeased', 'JobSucceeded')").select(m.text("j-", seq).alias("job_id"), "seq", F.timestamp_seconds("created").alias("at"), F.when(seq % 10 != 0, m.text("c-", F.floor(seq / 12) % 40)).alias("deduplication_id"))
    return _streamed(subs, "seq", 3, lambda stream: dedup.with_originals(stream, KEPT, "40 days"))
