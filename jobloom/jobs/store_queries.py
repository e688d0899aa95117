"""Queries of the stored job tables: a log that comes in batches, the tables after it, and what batches changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.jobs.fold_queries import _CONFLATED, _CREATED, _RUN_LAST, _RUN_UPDATES
from jobloom.jobs.health_queries import _GONE, LIFETIME
from jobloom.jobs.registry import query
from jobloom.operators import maintain
from jobloom.sources import model as m
from jobloom.sources.model import NOW
from jobloom.sources.tables import shared_folder
from jobloom.streaming import ingest
from jobloom.streaming.store import JobStore

#: Batches that the log is cut into, and those that the change feed spans.
BATCHES, AFTER, UPTO = 20, 2, 5


def _span(log: DataFrame, spans: int) -> Column:
    """Which of so many spans of ``seq`` an event falls into; span k begins at the whole part of k / ``spans`` of the length."""
    a, b = log.agg(F.min("seq"), F.max("seq")).first()
    return F.expr(f"int(({spans} * (seq - {a or 0} + 1) - 1) div {(b or 0) - (a or 0) + 1})")


_STORED: dict[tuple[str, str], str] = {}


def ingested(spark, d) -> JobStore:
    """The store after a stream of batches, ingested once for all queries of a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _STORED:
        _STORED[at] = _ingest(spark, d, BATCHES).path
    return JobStore(_STORED[at])


def _ingest(spark, d, batches: int) -> JobStore:
    tables, log = shared_folder(spark, "tables"), m.job_event(spark, d)
    ingest.feed_in_turn(log, _span(log, batches), batches, lambda stream: ingest.run_ingest_stream(stream, tables, shared_folder(spark, "offsets"), interval="0 seconds"))
    store = JobStore(tables)
    if store.last_batch(spark) != batches - 1:
        raise ValueError("a span is a batch")
    return store


def _numbers(df):
    return df.withColumns({c: F.col(c).cast("long") for c in df.columns if c.endswith("state")})


_RUNS = _RUN_UPDATES + f", rc AS (SELECT run_id, {_RUN_LAST} FROM rupd GROUP BY run_id), lea AS (SELECT run_id, job_id, cluster, node, pool, created AS leased FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM job_event WHERE kind = 'JobRunLeased') t WHERE rn = 1), ru AS (SELECT lea.run_id, lea.job_id, cluster, coalesce(rc.node, lea.node) AS node, pool, leased, pending, started, finished, coalesce(rc.job_run_state, 11) AS job_run_state, exit_code, error, debug, termination_reason FROM lea LEFT JOIN rc ON lea.run_id = rc.run_id)"
_JOBS = _CONFLATED + _CREATED + _RUNS + ", jo AS (SELECT cre.job_id, owner, submitted, coalesce(conf.priority, cre.priority) AS priority, coalesce(conf.state, 1) AS state, coalesce(conf.last_transition_time, submitted) AS last_transition_time, conf.latest_run_id, cancelled, cancel_reason, cancel_user, ru.cluster AS latest_cluster, ru.node AS latest_node, ru.pool AS latest_pool, ru.job_run_state AS latest_run_state FROM cre LEFT JOIN conf ON cre.job_id = conf.job_id LEFT JOIN ru ON ru.run_id = conf.latest_run_id AND ru.job_id = cre.job_id)"


@query("w1_w2_ingest_stream", _JOBS + " SELECT * FROM jo")
def w2(spark, d):
    return _numbers(ingested(spark, d).read(spark, "job").select("job_id", "owner", "submitted", "priority", "state", "last_transition_time", "latest_run_id", "cancelled", "cancel_reason", "cancel_user", "latest_cluster", "latest_node", "latest_pool", "latest_run_state"))


@query("w1_w2_ingest_runs", _RUNS + " SELECT * FROM ru")
def w2_runs(spark, d):
    return _numbers(ingested(spark, d).read(spark, "job_run").select("run_id", "job_id", "cluster", "node", "pool", "leased", "pending", "started", "finished", "job_run_state", "exit_code", "error", "debug", "termination_reason"))


@query("w2_active_side", _JOBS + " SELECT job_id, state, latest_node FROM jo WHERE state IN (1, 2, 3, 8)")
def w2_active(spark, d):
    return _numbers(ingested(spark, d).read(spark, "job", active=True).select("job_id", "state", "latest_node"))


def _version(name: str, batches: int) -> str:
    """Jobs after so many batches, as a table of that name."""
    log = f"(SELECT * FROM job_event WHERE seq < (SELECT min(seq) + (max(seq) + 1 - min(seq)) * {batches} // {BATCHES} FROM job_event))"
    return f", {name} AS (WITH " + _JOBS.removeprefix(", ").replace("FROM job_event", f"FROM {log} AS job_event") + " SELECT * FROM jo)"


_SHOWN = ("state", "priority", "last_transition_time", "latest_run_id", "latest_node", "latest_run_state")
_SIDES = ", ".join([f"was.{c} AS before_{c}" for c in _SHOWN] + [f"is_.{c} AS after_{c}" for c in _SHOWN])


@query("i19_change_feed", _version("was", AFTER + 1) + _version("is_", UPTO + 1) + f" SELECT is_.job_id, CASE WHEN was.job_id IS NULL THEN 'inserted' ELSE 'updated' END AS change, {_SIDES} FROM is_ LEFT JOIN was ON was.job_id = is_.job_id WHERE was IS DISTINCT FROM is_")
def i19_feed(spark, d):
    feed = ingested(spark, d).changes(spark, "job", AFTER, UPTO)
    return _numbers(feed.select("job_id", "change", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("before", "after") for c in _SHOWN]))


#: Days in a folder of these small tables.
PERIOD = 120
_PRUNED: dict[tuple[str, str], str] = {}


def _pruned(spark, d) -> str:
    """All four tables by day, pruned once for all queries of a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _PRUNED:
        path, jobs = shared_folder(spark, "daily"), m.job(spark, d, False)
        specs = jobs.select("job_id", F.concat(F.lit("spec of "), "job_id").alias("job_spec"))
        errors = jobs.where("state = 5").select("job_id", F.concat(F.lit("error of "), "job_id").alias("error"))
        maintain.write_daily({"job": jobs.select("job_id", "state", "submitted", "last_transition_time"), "job_run": m.job_run(spark, d).select("run_id", "job_id"), "job_spec": specs, "job_error": errors}, path, days=PERIOD)
        report = maintain.prune_jobs_daily(spark, path, NOW, LIFETIME)
        report.write.parquet(f"{path}-report")
        _PRUNED[at] = path
    return _PRUNED[at]


def _kept(name: str):
    return lambda spark, d: maintain.read_daily(spark, _pruned(spark, d), name)


@query("p1_daily_jobs", _GONE + " SELECT job_id, state FROM job WHERE job_id NOT IN (SELECT job_id FROM gone)")
def p1_jobs(spark, d):
    return _numbers(_kept("job")(spark, d).select("job_id", "state"))


query("p1_daily_runs", _GONE + " SELECT run_id, job_id FROM job_run WHERE job_id NOT IN (SELECT job_id FROM gone)")(_kept("job_run"))
query("p1_daily_specs", _GONE + " SELECT job_id, 'spec of ' || job_id AS job_spec FROM job WHERE job_id NOT IN (SELECT job_id FROM gone)")(_kept("job_spec"))
query("p1_daily_errors", _GONE + " SELECT job_id, 'error of ' || job_id AS error FROM job WHERE state = 5 AND job_id NOT IN (SELECT job_id FROM gone)")(_kept("job_error"))


@query("p1_daily_report", _GONE + " SELECT CAST(submitted // 86400 // 120 * 120 AS BIGINT) AS day, count(*) AS jobs, count(gone.job_id) AS gone FROM job LEFT JOIN gone ON gone.job_id = job.job_id GROUP BY 1 HAVING count(gone.job_id) > 0")
def p1_report(spark, d):
    return spark.read.parquet(f"{_pruned(spark, d)}-report").select(F.unix_date("day").cast("long").alias("day"), "jobs", "gone")


@query("p5_daily_scheduler_runs", f"SELECT srun.run_id FROM srun JOIN sjob ON sjob.job_id = srun.job_id WHERE NOT (submitted + 1000 < {NOW - LIFETIME} AND (sjob.succeeded OR sjob.failed OR sjob.cancelled))")
def p5_runs(spark, d):
    path, jobs = shared_folder(spark, "daily"), m.scheduler_jobs(spark, d).withColumn("last_modified", F.col("submitted") + 1000)
    maintain.write_daily({"jobs": jobs.select("job_id", "submitted", "last_modified", "succeeded", "failed", "cancelled"), "runs": m.scheduler_runs(spark, d).select("run_id", "job_id")}, path, parent="jobs", days=PERIOD)
    ended = F.col("succeeded") | F.col("failed") | F.col("cancelled")
    maintain.prune_daily(spark, path, ended & (F.col("last_modified") < NOW - LIFETIME), NOW - LIFETIME, parent="jobs")
    return maintain.read_daily(spark, path, "runs").select("run_id")


@query("w1_batches_by_items", ", o AS (SELECT seq, (row_number() OVER (ORDER BY seq) - 1) // (SELECT count(*) // 3 + 1 FROM job_event) AS batch FROM job_event), j AS (SELECT job_id, min(seq) AS first FROM job_event WHERE kind = 'SubmitJob' GROUP BY job_id) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS jobs FROM j JOIN o ON o.seq = j.first GROUP BY batch")
def w1_items(spark, d):
    """Jobs that each batch brings, where what has come at once is stored in batches of a third of its events."""
    log, tables = m.job_event(spark, d), shared_folder(spark, "tables")
    most = log.count() // 3 + 1
    ingest.feed_in_turn(log, F.lit(0), 1, lambda stream: ingest.run_ingest_stream(stream, tables, shared_folder(spark, "offsets"), interval="0 seconds", max_events=most))
    store = JobStore(tables)
    feeds = [store.changes(spark, "job", k - 1, k).where("change = 'inserted'").select(F.lit(k).cast("long").alias("batch")) for k in range(store.last_batch(spark) + 1)]
    return reduce(DataFrame.unionByName, feeds).groupBy("batch").agg(F.count("*").alias("jobs"))


@query("q5_stored_latest_run", _JOBS + " SELECT job_id, state, latest_node FROM jo WHERE latest_cluster = 'cluster-2' AND latest_run_state IN (2, 3, 4)")
def q5_stored(spark, d):
    """Jobs by their latest run without a join: the stored job carries what the search asks for."""
    rows = ingested(spark, d).read(spark, "job").where("latest_cluster = 'cluster-2' and latest_run_state in (2, 3, 4)")
    return _numbers(rows.select("job_id", "state", "latest_node"))


@query("q13_stored_group_by_pool", _JOBS + " SELECT coalesce(latest_pool, '') AS pool, count(*) AS jobs, min(submitted) AS submitted, count(*) FILTER (WHERE state IN (1, 2, 3, 8)) AS active FROM jo GROUP BY 1")
def q13_stored(spark, d):
    """Jobs by their latest run's pool, those without a run in the empty group."""
    jobs = ingested(spark, d).read(spark, "job")
    return jobs.groupBy(F.coalesce("latest_pool", F.lit("")).alias("pool")).agg(F.count("*").alias("jobs"), F.min("submitted").alias("submitted"), F.count_if(F.col("state").isin(1, 2, 3, 8)).alias("active"))
