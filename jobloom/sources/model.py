"""The job tables derived from the given order tables and event stream, and the same derivation in DuckDB SQL.

``job`` comes from orders, ``job_run`` from lineitem, ``job_event`` from events; scheduler snapshots, nodes and queues come
from these and from supplier. Times are epoch seconds (long) throughout, so that no session time zone enters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources.tables import table

#: The fixed "now" of every query that needs one.
NOW = 990_000_000

# fixed values: state ordinals and their display order
JOB_STATES = {"QUEUED": 1, "PENDING": 2, "RUNNING": 3, "SUCCEEDED": 4, "FAILED": 5, "CANCELLED": 6, "PREEMPTED": 7, "LEASED": 8, "REJECTED": 9}
DISPLAY_ORDER = ["QUEUED", "LEASED", "PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED", "PREEMPTED", "REJECTED"]
RUN_STATES = {"PENDING": 1, "RUNNING": 2, "SUCCEEDED": 3, "FAILED": 4, "TERMINATED": 5, "PREEMPTED": 6, "UNABLE_TO_SCHEDULE": 7, "LEASE_RETURNED": 8, "LEASE_EXPIRED": 9, "MAX_RUNS_EXCEEDED": 10, "LEASED": 11, "CANCELLED": 12}
ACTIVE_STATES = (1, 2, 3, 8)
TERMINAL_STATES = (4, 5, 6, 7, 9)
KINDS = ["SubmitJob", "JobRunLeased", "JobRunAssigned", "JobRunRunning", "JobSucceeded", "CancelledJob", "ReprioritisedJob", "JobErrors", "JobRunPreempted", "JobRequeued", "JobRunErrors", "JobRunSucceeded"]


def seconds(c: Column | str) -> Column:
    return F.unix_timestamp((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def job_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    leased = seconds("l_shipdate") + part % 86400
    started = F.when(F.col("l_linestatus") == "F", leased + 120)
    rows = line.select(
        F.concat_ws("-", F.lit("run"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"), F.concat(F.lit("job-"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0")).alias("job_id"),
        text("cluster-", supp % 5).alias("cluster"), text("node-", supp).alias("node"), text("pool-", part % 3).alias("pool"), leased.alias("leased"),
        F.when(F.col("l_returnflag") != "N", leased + 60).alias("pending"), started.alias("started"),
        F.when(F.col("l_returnflag") != "N", started + F.col("l_quantity").cast("long") * 100).alias("finished"), part.alias("pk"), supp.alias("sk"), F.col("l_linenumber").alias("ln"),
    )
    over = F.get(F.array(*map(F.lit, (3, 4, 12, 6))), (F.col("pk") % 4).cast("int"))
    state = F.when(F.col("finished").isNotNull(), over).when(F.col("started").isNotNull(), 2).when(F.col("pending").isNotNull(), 1).otherwise(11)
    rows = rows.withColumn("job_run_state", state.cast("short"))
    failed = F.col("job_run_state") == 4
    return rows.select(
        "run_id", "job_id", "cluster", "node", "pool", "leased", "pending", "started", "finished", "job_run_state", F.when(F.col("job_run_state").isin(4, 6), text("err-", F.col("ln"))).alias("error"),
        F.when(failed, text("debug-", F.col("ln"))).alias("debug"), F.when(failed, (F.col("pk") % 3).cast("int")).alias("exit_code"), F.when(failed, text("cat-", F.col("pk") % 5)).alias("failure_category"),
        F.when(failed, text("sub-", F.col("sk") % 3)).alias("failure_subcategory"), F.when(F.col("job_run_state") == 6, F.lit("urgent")).alias("termination_reason"),
    )


def job(spark: SparkSession, sf_dir: str, latest: bool = True) -> DataFrame:
    orders, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    submitted = seconds("o_orderdate") + k % 86400
    state = (k % 9 + 1).cast("short")
    team = F.create_map(F.lit("team"), text("team-", c % 11))
    rows = orders.select(
        F.concat(F.lit("job-"), F.lpad(k.cast("string"), 10, "0")).alias("job_id"), text("queue-", c % 7).alias("queue"), text("user-", c).alias("owner"), text("js-", c % 50).alias("jobset"),
        (1000 * (1 + k % 16)).alias("cpu"), ((1 + k % 8) * (1 << 30)).alias("memory"), ((k % 4) * (1 << 30)).alias("ephemeral_storage"), F.when(k % 8 == 0, 1).otherwise(0).cast("long").alias("gpu"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), submitted.alias("submitted"), state.alias("state"), (submitted + c % 7200).alias("last_transition_time"),
        F.when(state == 6, submitted + c % 7200).alias("cancelled"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").alias("priority_class"), F.when(k % 10 != 0, text("ns-", c % 3)).alias("namespace"),
        F.when(k % 4 == 0, F.map_concat(team, F.create_map(F.lit("ticket"), text("T", k % 100)))).otherwise(team).alias("annotations"), F.when(state == 6, text("reason-", c % 4)).alias("cancel_reason"),
        F.when(k % 6 == 0, text("uri-", k % 200)).alias("external_job_uri"),
    )
    if not latest:
        return rows
    runs = job_run(spark, sf_dir).groupBy("job_id").agg(F.max(F.struct("leased", "run_id")).getField("run_id").alias("latest_run_id"))
    return rows.join(runs, "job_id", "left")


def job_event(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Flat event log in the order of event_id, as a table or as a stream of its files."""
    e = table(spark, sf_dir, "events")
    if stream:
        # a pattern, since a stream's plain path has to be a folder
        e = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parque[t]")
    i, u = F.col("event_id"), F.col("user_id")
    j = F.floor(i / 12)  # independent of the kind
    kind = F.get(F.array(*map(F.lit, KINDS)), (i % 12).cast("int"))
    return e.select(
        text("ej-", u).alias("job_id"), F.concat(F.lit("er-"), u.cast("string"), F.lit("-"), (i % 5).cast("string")).alias("run_id"), text("queue-", u % 7).alias("queue"), text("js-", u % 20).alias("jobset"), text("user-", u % 9).alias("user"),
        i.alias("seq"), seconds("ts").alias("created"), kind.alias("kind"), (i % 10).alias("priority"), text("reason-", j % 4).alias("reason"), F.when(j % 3 == 0, text("req-", i % 2)).alias("requestor"),
        text("cluster-", i % 5).alias("cluster"), text("node-", i % 40).alias("node"), text("pool-", i % 3).alias("pool"), (i % 7 < 5).alias("terminal"), F.get(F.array(*map(F.lit, ["PodError", "LeaseReturned", "LeaseExpired", "JobRunPreemptedError", "MaxRunsExceeded", "JobRejected"])), (j % 6).cast("int")).alias("error_kind"),
        (j % 4).cast("int").alias("exit_code"), F.length("props").cast("long").alias("bytes"), F.col("event_type"), F.col("value"),
    )


def scheduler_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot of the scheduler's jobs: flags, pools, gang, requests as columns."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pools = F.when(k % 2 == 0, F.array(text("pool-", k % 3), text("pool-", (k + 1) % 3))).otherwise(F.array(text("pool-", k % 3)))
    return o.select(
        F.concat(F.lit("job-"), F.lpad(k.cast("string"), 10, "0")).alias("job_id"), text("queue-", c % 9).alias("queue"), text("js-", c % 50).alias("job_set"), (seconds("o_orderdate") + k % 86400).alias("submitted"),
        (k % 5).alias("priority"), F.when(k % 3 == 0, "high").otherwise("low").alias("priority_class"), (k % 9 == 0).alias("queued"), (k % 5 != 0).alias("validated"), (k % 9 == 5).alias("cancelled"), (k % 9 == 3).alias("succeeded"), (k % 9 == 4).alias("failed"),
        (k % 6).alias("queued_version"), k.alias("serial"), pools.alias("pools"), text("band-", c % 4).alias("price_band"), F.when(k % 10 < 3, text("gang-", F.floor(k / 30))).alias("gang_id"), (2 + k % 2).alias("gang_cardinality"),
        (1000 * (1 + k % 16)).cast("double").alias("cpu"), ((1 + k % 8) * 4.0).alias("memory"), F.when(k % 8 == 0, 1.0).otherwise(0.0).alias("gpu"), text("key-", k % 37).alias("scheduling_key"),
    )


def scheduler_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest run of every scheduler job that isn't queued."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    created = seconds("o_orderdate") + k % 86400 + 60
    return o.where(k % 9 != 0).select(
        text("run-", k).alias("run_id"), F.concat(F.lit("job-"), F.lpad(k.cast("string"), 10, "0")).alias("job_id"), text("executor-", c % 6).alias("executor"), text("node-", k % 100).alias("node"), text("pool-", k % 3).alias("pool"), created.alias("created"),
        (k % 9 == 1).alias("pending"), (k % 9 == 2).alias("running"), (k % 9 == 3).alias("succeeded"), (k % 9 == 4).alias("failed"), (k % 9 == 5).alias("cancelled"), (k % 9 == 6).alias("preempted"), (k % 9 == 7).alias("returned"), (k % 20 == 0).alias("preempt_requested"),
        created.alias("leased_at"), F.when(k % 9 != 8, created + 2 + k % 30).alias("pending_at"), F.when((k % 9).between(2, 6), created + 40 + k % 50).alias("running_at"), F.when((k % 9).between(3, 7), created + 100 + c % 5000).alias("terminated_at"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(
        text("executor-", k % 6).alias("executor"), text("node-", k).alias("node"), text("pool-", k % 3).alias("pool"), text("type-", k % 4).alias("node_type"), F.when(k % 7 == 0, text("res-", k % 2)).alias("reservation"), (k % 11 == 0).alias("unschedulable"),
        (64000.0 + 1000 * (k % 4)).alias("cpu"), (256.0 + k % 8).alias("memory"), F.when(k % 5 == 0, 8.0).otherwise(0.0).alias("gpu"),
    )


def queues(spark: SparkSession) -> DataFrame:
    """Eight queues; queue-8 of the jobs is unknown, queue-7 has few jobs, the third is cordoned."""
    return spark.range(8).select(text("queue-", F.col("id")).alias("queue"), (F.lit(1.0) + F.col("id") % 3).alias("priority_factor"), (F.col("id") == 2).alias("cordoned"))


def executors(spark: SparkSession) -> DataFrame:
    """Heartbeats of six executors; two have stopped."""
    return spark.range(6).select(text("executor-", F.col("id")).alias("executor"), (F.lit(NOW) - F.col("id") * 200).alias("last_updated"), (F.col("id") == 4).alias("cordoned"))


def bids(spark: SparkSession) -> DataFrame:
    """Bids by queue, pool, band and phase; a third of them is missing."""
    ids = spark.range(8 * 3 * 4 * 2)
    i = F.col("id")
    rows = ids.select(text("queue-", i % 8).alias("queue"), text("pool-", (i / 8).cast("long") % 3).alias("pool"), text("band-", (i / 24).cast("long") % 4).alias("band"), F.when(i < 96, "queued").otherwise("running").alias("phase"), (i % 13 + 0.5).cast("double").alias("amount"), i.alias("i"))
    return rows.where("i % 3 <> 0").select("queue", "pool", "band", "phase", "amount")


#: The same tables as DuckDB common table expressions; every oracle query begins with them.
VIEWS = """WITH job_run0 AS (
  SELECT concat_ws('-', 'run', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS run_id, 'job-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS job_id,
    'cluster-' || (l_suppkey % 5) AS cluster, 'node-' || l_suppkey AS node, 'pool-' || (l_partkey % 3) AS pool, CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 86400 AS leased,
    CASE WHEN l_returnflag <> 'N' THEN CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 86400 + 60 END AS pending,
    CASE WHEN l_linestatus = 'F' THEN CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 86400 + 120 END AS started,
    CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'N' THEN CAST(epoch(l_shipdate) AS BIGINT) + l_partkey % 86400 + 120 + CAST(l_quantity AS BIGINT) * 100 END AS finished,
    l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln FROM lineitem),
job_run1 AS (SELECT *, CASE WHEN finished IS NOT NULL THEN CASE pk % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 12 ELSE 6 END WHEN started IS NOT NULL THEN 2 WHEN pending IS NOT NULL THEN 1 ELSE 11 END AS job_run_state FROM job_run0),
job_run AS (SELECT run_id, job_id, cluster, node, pool, leased, pending, started, finished, job_run_state, CASE WHEN job_run_state IN (4, 6) THEN 'err-' || ln END AS error, CASE WHEN job_run_state = 4 THEN 'debug-' || ln END AS debug,
    CASE WHEN job_run_state = 4 THEN CAST(pk % 3 AS INTEGER) END AS exit_code, CASE WHEN job_run_state = 4 THEN 'cat-' || (pk % 5) END AS failure_category, CASE WHEN job_run_state = 4 THEN 'sub-' || (sk % 3) END AS failure_subcategory,
    CASE WHEN job_run_state = 6 THEN 'urgent' END AS termination_reason FROM job_run1),
latest AS (SELECT job_id, run_id AS latest_run_id FROM (SELECT job_id, run_id, row_number() OVER (PARTITION BY job_id ORDER BY leased DESC, run_id DESC) AS rn FROM job_run) t WHERE rn = 1),
job0 AS (SELECT 'job-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS job_id, 'queue-' || (o_custkey % 7) AS queue, 'user-' || o_custkey AS owner, 'js-' || (o_custkey % 50) AS jobset, 1000 * (1 + o_orderkey % 16) AS cpu,
    (1 + o_orderkey % 8) * 1073741824 AS memory, (o_orderkey % 4) * 1073741824 AS ephemeral_storage, CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS gpu, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS priority,
    CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS submitted, o_orderkey % 9 + 1 AS state, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 + o_custkey % 7200 AS last_transition_time,
    CASE WHEN o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 3 = 1 THEN 'low' END AS priority_class, CASE WHEN o_orderkey % 10 <> 0 THEN 'ns-' || (o_custkey % 3) END AS namespace,
    'team-' || (o_custkey % 11) AS team, CASE WHEN o_orderkey % 4 = 0 THEN 'T' || (o_orderkey % 100) END AS ticket, CASE WHEN o_orderkey % 9 = 5 THEN 'reason-' || (o_custkey % 4) END AS cancel_reason,
    CASE WHEN o_orderkey % 6 = 0 THEN 'uri-' || (o_orderkey % 200) END AS external_job_uri FROM orders),
job AS (SELECT job0.*, latest.latest_run_id FROM job0 LEFT JOIN latest ON job0.job_id = latest.job_id),
job_event AS (SELECT 'ej-' || user_id AS job_id, 'er-' || user_id || '-' || (event_id % 5) AS run_id, 'queue-' || (user_id % 7) AS queue, 'js-' || (user_id % 20) AS jobset, 'user-' || (user_id % 9) AS usr, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS created,
    CASE event_id % 12 WHEN 0 THEN 'SubmitJob' WHEN 1 THEN 'JobRunLeased' WHEN 2 THEN 'JobRunAssigned' WHEN 3 THEN 'JobRunRunning' WHEN 4 THEN 'JobSucceeded' WHEN 5 THEN 'CancelledJob' WHEN 6 THEN 'ReprioritisedJob' WHEN 7 THEN 'JobErrors' WHEN 8 THEN 'JobRunPreempted' WHEN 9 THEN 'JobRequeued' WHEN 10 THEN 'JobRunErrors' ELSE 'JobRunSucceeded' END AS kind,
    event_id % 10 AS priority, 'reason-' || (event_id // 12 % 4) AS reason, CASE WHEN event_id // 12 % 3 = 0 THEN 'req-' || (event_id % 2) END AS requestor, 'cluster-' || (event_id % 5) AS cluster, 'node-' || (event_id % 40) AS node, 'pool-' || (event_id % 3) AS pool, event_id % 7 < 5 AS terminal,
    CASE event_id // 12 % 6 WHEN 0 THEN 'PodError' WHEN 1 THEN 'LeaseReturned' WHEN 2 THEN 'LeaseExpired' WHEN 3 THEN 'JobRunPreemptedError' WHEN 4 THEN 'MaxRunsExceeded' ELSE 'JobRejected' END AS error_kind, CAST(event_id // 12 % 4 AS INTEGER) AS exit_code, CAST(length(props) AS BIGINT) AS bytes, event_type, value FROM events),
sjob AS (SELECT 'job-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS job_id, 'queue-' || (o_custkey % 9) AS queue, 'js-' || (o_custkey % 50) AS job_set, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS submitted, o_orderkey % 5 AS priority,
    CASE WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'low' END AS priority_class, o_orderkey % 9 = 0 AS queued, o_orderkey % 5 <> 0 AS validated, o_orderkey % 9 = 5 AS cancelled, o_orderkey % 9 = 3 AS succeeded, o_orderkey % 9 = 4 AS failed, o_orderkey % 6 AS queued_version, o_orderkey AS serial,
    'pool-' || (o_orderkey % 3) AS pool1, CASE WHEN o_orderkey % 2 = 0 THEN 'pool-' || ((o_orderkey + 1) % 3) END AS pool2, 'band-' || (o_custkey % 4) AS price_band, CASE WHEN o_orderkey % 10 < 3 THEN 'gang-' || (o_orderkey // 30) END AS gang_id, 2 + o_orderkey % 2 AS gang_cardinality,
    CAST(1000 * (1 + o_orderkey % 16) AS DOUBLE) AS cpu, (1 + o_orderkey % 8) * CAST(4.0 AS DOUBLE) AS memory, CAST(CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS gpu, 'key-' || (o_orderkey % 37) AS scheduling_key FROM orders),
sjob_pool AS (SELECT *, pool1 AS pool FROM sjob UNION ALL SELECT *, pool2 AS pool FROM sjob WHERE pool2 IS NOT NULL),
srun0 AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 + 60 AS created FROM orders WHERE o_orderkey % 9 <> 0),
srun AS (SELECT 'run-' || k AS run_id, 'job-' || lpad(CAST(k AS VARCHAR), 10, '0') AS job_id, 'executor-' || (c % 6) AS executor, 'node-' || (k % 100) AS node, 'pool-' || (k % 3) AS pool, created, k % 9 = 1 AS pending, k % 9 = 2 AS running, k % 9 = 3 AS succeeded, k % 9 = 4 AS failed, k % 9 = 5 AS cancelled,
    k % 9 = 6 AS preempted, k % 9 = 7 AS returned, k % 20 = 0 AS preempt_requested, created AS leased_at, CASE WHEN k % 9 <> 8 THEN created + 2 + k % 30 END AS pending_at, CASE WHEN k % 9 BETWEEN 2 AND 6 THEN created + 40 + k % 50 END AS running_at, CASE WHEN k % 9 BETWEEN 3 AND 7 THEN created + 100 + c % 5000 END AS terminated_at FROM srun0),
node AS (SELECT 'executor-' || (s_suppkey % 6) AS executor, 'node-' || s_suppkey AS node, 'pool-' || (s_suppkey % 3) AS pool, 'type-' || (s_suppkey % 4) AS node_type, CASE WHEN s_suppkey % 7 = 0 THEN 'res-' || (s_suppkey % 2) END AS reservation, s_suppkey % 11 = 0 AS unschedulable,
    CAST(64000 + 1000 * (s_suppkey % 4) AS DOUBLE) AS cpu, CAST(256 + s_suppkey % 8 AS DOUBLE) AS memory, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 8 ELSE 0 END AS DOUBLE) AS gpu FROM supplier),
queues AS (SELECT 'queue-' || i AS queue, CAST(1 + i % 3 AS DOUBLE) AS priority_factor, i = 2 AS cordoned FROM (SELECT unnest(range(8)) AS i) r),
executors AS (SELECT 'executor-' || i AS executor, 990000000 - i * 200 AS last_updated, i = 4 AS cordoned FROM (SELECT unnest(range(6)) AS i) r),
bids AS (SELECT 'queue-' || (i % 8) AS queue, 'pool-' || ((i // 8) % 3) AS pool, 'band-' || ((i // 24) % 4) AS band, CASE WHEN i < 96 THEN 'queued' ELSE 'running' END AS phase, CAST(i % 13 AS DOUBLE) + 0.5 AS amount FROM (SELECT unnest(range(192)) AS i) r WHERE i % 3 <> 0)
"""
