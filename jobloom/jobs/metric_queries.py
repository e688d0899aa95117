"""Queries of queue, state, capacity, pod and stream metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.jobs.registry import query
from jobloom.operators import metrics as x
from jobloom.sources import model as m
from jobloom.sources.model import NOW
from jobloom.sources.tables import shared_folder
from jobloom.streaming import ingest

ORDER = ("pool-1", "pool-0")
_QP = ", qp AS (SELECT *, CASE WHEN pool = CASE WHEN pool2 IS NULL THEN pool1 WHEN 'pool-1' IN (pool1, pool2) THEN 'pool-1' WHEN 'pool-0' IN (pool1, pool2) THEN 'pool-0' ELSE pool1 END THEN 'primary' ELSE 'secondary' END AS role FROM sjob_pool WHERE queued AND validated)"
_ACT = ", act AS (SELECT srun.job_id, run_id, executor, node, srun.pool, created, pending, running, preempt_requested, running_at, queue, priority_class, price_band, submitted, priority, gang_id, gang_cardinality, cpu, memory, gpu FROM srun JOIN sjob ON srun.job_id = sjob.job_id WHERE NOT (srun.succeeded OR srun.failed OR srun.cancelled OR srun.preempted OR returned))"
_NODE = ", onn AS (SELECT act.*, node.executor AS cluster, node_type, reservation, CASE WHEN running THEN 'Running' WHEN pending THEN 'Pending' ELSE 'Leased' END AS phase FROM act JOIN node ON act.node = node.node)"


def _stats(c: str, buckets=()) -> str:
    out = f"count({c}) AS count, CAST(sum({c}) AS {'BIGINT' if buckets else 'DOUBLE'}) AS sum, min({c}) AS min, max({c}) AS max, CAST(median({c}) AS DOUBLE) AS median"
    return out + "".join(f", CAST(sum(CASE WHEN {c} <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS le_{b}" for b in buckets)


def _long(table: str, keys: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS resource, {c} AS value FROM {table}" for c in x.RESOURCES)


def _jr(spark, d):
    return m.scheduler_jobs(spark, d), m.scheduler_runs(spark, d)


@query("m1_m2_queue_sizes", "SELECT queues.queue, CAST(coalesce(sum(CASE WHEN queued AND validated THEN 1 ELSE 0 END), 0) AS BIGINT) AS validated, CAST(coalesce(sum(CASE WHEN queued AND NOT validated THEN 1 ELSE 0 END), 0) AS BIGINT) AS unvalidated, count(DISTINCT CASE WHEN queued AND validated THEN scheduling_key END) AS scheduling_keys FROM queues LEFT JOIN sjob ON sjob.queue = queues.queue GROUP BY queues.queue")
def m1(spark, d):
    return x.queue_sizes(m.scheduler_jobs(spark, d), m.queues(spark))


@query("m3_queued_durations", _QP + f", z AS (SELECT qp.*, {NOW} - greatest(submitted, coalesce(e.ended, submitted)) AS seconds FROM qp LEFT JOIN (SELECT job_id, max(terminated_at) AS ended FROM srun GROUP BY job_id) e ON e.job_id = qp.job_id) SELECT pool, priority_class, queue, role, {_stats('seconds', x.DURATION_BUCKETS)} FROM z GROUP BY pool, priority_class, queue, role")
def m3(spark, d):
    return x.queued_durations(*_jr(spark, d), NOW, ORDER)


@query("m4_running_durations", _ACT + f", z AS (SELECT *, {NOW} - created AS seconds FROM act) SELECT pool, priority_class, queue, {_stats('seconds', x.DURATION_BUCKETS)} FROM z GROUP BY pool, priority_class, queue")
def m4(spark, d):
    return x.running_durations(*_jr(spark, d), NOW)


@query("m5_queued_resources", _QP + f", z AS ({_long('qp', 'pool, priority_class, queue, price_band, role')}) SELECT pool, priority_class, queue, price_band, role, resource, {_stats('value')} FROM z GROUP BY pool, priority_class, queue, price_band, role, resource")
def m5(spark, d):
    return x.queued_resources(m.scheduler_jobs(spark, d), ORDER)


@query("m6_running_resources", _ACT + f", z AS ({_long('act', 'pool, priority_class, queue, price_band')}) SELECT pool, priority_class, queue, price_band, resource, {_stats('value')} FROM z GROUP BY pool, priority_class, queue, price_band, resource")
def m6(spark, d):
    return x.running_resources(*_jr(spark, d))


@query("m7_m8_m10_bid_price_stats", _QP + ", z AS (SELECT qp.*, coalesce(amount, 0) AS bid FROM qp LEFT JOIN bids ON bids.queue = qp.queue AND bids.pool = qp.pool AND band = price_band AND phase = 'queued') SELECT pool, priority_class, queue, role, CAST(min(bid) AS DOUBLE) AS min, CAST(max(bid) AS DOUBLE) AS max, CAST(median(bid) AS DOUBLE) AS median FROM z GROUP BY pool, priority_class, queue, role")
def m7(spark, d):
    return x.bid_price_stats(m.scheduler_jobs(spark, d), m.bids(spark), ORDER)


@query("m7_m10_running_bid_price_stats", _ACT + ", z AS (SELECT act.*, CASE WHEN priority_class = 'low' THEN coalesce(amount, 0) ELSE 1000000 END AS bid FROM act LEFT JOIN bids ON bids.queue = act.queue AND bids.pool = act.pool AND band = price_band AND phase = 'running') SELECT pool, priority_class, queue, CAST(min(bid) AS DOUBLE) AS min, CAST(max(bid) AS DOUBLE) AS max, CAST(median(bid) AS DOUBLE) AS median FROM z GROUP BY pool, priority_class, queue")
def m7_running(spark, d):
    return x.running_bid_price_stats(*_jr(spark, d), m.bids(spark), ["low"])


@query("m9_price_band_grid", ", p AS (SELECT DISTINCT pool FROM srun), b AS (SELECT DISTINCT price_band AS band FROM sjob), f AS (SELECT DISTINCT phase FROM bids) SELECT queues.queue, p.pool, b.band, f.phase, coalesce(amount, CAST(0 AS DOUBLE)) AS amount FROM queues CROSS JOIN p CROSS JOIN b CROSS JOIN f LEFT JOIN bids ON bids.queue = queues.queue AND bids.pool = p.pool AND bids.band = b.band AND bids.phase = f.phase")
def m9(spark, d):
    jobs, runs = _jr(spark, d)
    return x.price_band_grid(m.queues(spark), runs.select("pool").distinct(), jobs.select(F.col("price_band").alias("band")).distinct(), m.bids(spark).select("phase").distinct(), m.bids(spark))


_CAP = ", ".join(f"sum({c}) AS total_{c}, sum(CASE WHEN schedulable THEN {c} ELSE 0 END) AS available_{c}" for c in x.RESOURCES)


@query("c1_c3_cluster_capacity", f", n AS (SELECT node.*, NOT (unschedulable OR coalesce(cordoned, FALSE)) AS schedulable, 'dedicated' AS capacity_class FROM node LEFT JOIN executors e ON e.executor = node.executor), al AS (SELECT * FROM n UNION ALL SELECT executor, node, 'pool-0' AS pool, node_type, reservation, unschedulable, cpu, memory, gpu, schedulable, 'shared' AS capacity_class FROM n WHERE pool = 'pool-2') SELECT executor, pool, node_type, reservation, capacity_class, count(*) AS nodes, CAST(sum(CASE WHEN schedulable THEN 1 ELSE 0 END) AS BIGINT) AS schedulable_nodes, {_CAP} FROM al GROUP BY executor, pool, node_type, reservation, capacity_class")
def c1(spark, d):
    away = spark.range(1).select(F.lit("pool-0").alias("pool"), F.lit("pool-2").alias("away_pool"))
    return x.cluster_capacity(m.nodes(spark, d), m.executors(spark), away)


@query("c2_deduct_home_usage", _ACT + ", u AS (SELECT node, pool, sum(cpu) AS c, sum(memory) AS me, sum(gpu) AS g FROM act GROUP BY node, pool) SELECT node.node, node.pool, greatest(cpu - coalesce(c, 0), 0) AS cpu, greatest(memory - coalesce(me, 0), 0) AS memory, greatest(gpu - coalesce(g, 0), 0) AS gpu FROM node LEFT JOIN u ON u.node = node.node AND u.pool = node.pool")
def c2(spark, d):
    return x.deduct_home_usage(m.nodes(spark, d), *_jr(spark, d))


_FULL = _ACT + """, n AS (SELECT node.*, CAST(substr(node.node, 6) AS BIGINT) AS k, NOT (unschedulable OR coalesce(e.cordoned, FALSE)) AS sch FROM node LEFT JOIN executors e ON e.executor = node.executor),
n2 AS (SELECT n.*, 'unit-' || (k % 2) AS scalable_unit, 1000.0 * (k % 3) AS ucpu FROM n), us AS (SELECT node, pool, sum(cpu) AS cpu, sum(memory) AS memory, sum(gpu) AS gpu FROM act GROUP BY node, pool),
h AS (""" + " UNION ALL ".join(f"SELECT n2.executor AS cluster, n2.pool, node_type, coalesce(reservation, '') AS reservation, n2.pool AS physical_pool, scalable_unit, '{c}' AS resource, n2.{c} AS total, n2.{c}{' - ucpu' if c == 'cpu' else ''} AS farm, CASE WHEN sch THEN n2.{c}{' - ucpu' if c == 'cpu' else ''} ELSE 0 END AS available, coalesce(us.{c}, 0) AS used, CASE WHEN sch THEN coalesce(us.{c}, 0) ELSE 0 END AS used_on FROM n2 LEFT JOIN us ON us.node = n2.node AND us.pool = n2.pool" for c in x.RESOURCES) + """),
aw AS (SELECT 'pool-0' AS pfor, 'pool-2' AS pown UNION ALL SELECT 'pool-1', 'pool-2')
SELECT cluster, pool, node_type, reservation, physical_pool, 'dedicated' AS capacity_class, scalable_unit, resource, sum(total) AS total, sum(farm) AS farm, sum(available) AS available FROM h GROUP BY ALL
UNION ALL SELECT cluster, pfor, node_type, reservation, physical_pool, 'shared', scalable_unit, resource, greatest(sum(total) - sum(used), 0), sum(farm), greatest(sum(available) - sum(used_on), 0) FROM h JOIN aw ON pown = h.pool GROUP BY ALL
UNION ALL SELECT 'floating', 'pool-0', '', '', '', '', '', 'gpu', 12.0, 0.0, 12.0 UNION ALL SELECT 'floating', 'pool-3', '', '', '', '', '', 'cpu', 500.0, 0.0, 500.0"""


def _detailed_nodes(spark, d):
    k = F.substring("node", 6, 12).cast("long")
    return m.nodes(spark, d).withColumns({"scalable_unit": m.text("unit-", k % 2), "unmanaged_cpu": (1000 * (k % 3)).cast("double")})


@query("c1_c2_capacity_by_resource", _FULL)
def c1_full(spark, d):
    away = spark.createDataFrame([("pool-0", "pool-2"), ("pool-1", "pool-2")], "pool string, away_pool string")
    floating = spark.createDataFrame([("pool-0", 0.0, 0.0, 12.0), ("pool-3", 500.0, 0.0, 0.0)], "pool string, cpu double, memory double, gpu double")
    return x.capacity_by_resource(_detailed_nodes(spark, d), m.executors(spark), *_jr(spark, d), away, floating)


@query("c5_allocated_by_unit", _ACT + _NODE.replace("node_type, reservation,", "node_type, reservation, node.pool AS physical_pool, 'unit-' || (CAST(substr(node.node, 6) AS BIGINT) % 2) AS scalable_unit,") + ", z AS (" + " UNION ALL ".join(f"SELECT queue, cluster, pool, priority_class, price_band, node_type, reservation, physical_pool, scalable_unit, '{c}' AS resource, {c} AS value FROM onn" for c in x.RESOURCES) + ") SELECT queue, cluster, pool, priority_class, price_band, node_type, reservation, physical_pool, scalable_unit, resource, sum(value) AS value FROM z GROUP BY ALL")
def c5_units(spark, d):
    return x.allocated_by_queue(_detailed_nodes(spark, d), *_jr(spark, d), ("physical_pool", "scalable_unit"))


@query("c4_leased_pod_counts", _ACT + _NODE + " SELECT cluster, pool, queue, phase, node_type, reservation, count(*) AS pods FROM onn GROUP BY ALL")
def c4(spark, d):
    return x.leased_pod_counts(m.nodes(spark, d), *_jr(spark, d))


@query("c5_allocated_by_queue", _ACT + _NODE + ", z AS (" + " UNION ALL ".join(f"SELECT queue, cluster, pool, priority_class, price_band, node_type, reservation, '{c}' AS resource, {c} AS value FROM onn" for c in x.RESOURCES) + ") SELECT queue, cluster, pool, priority_class, price_band, node_type, reservation, resource, sum(value) AS value FROM z GROUP BY ALL")
def c5(spark, d):
    return x.allocated_by_queue(m.nodes(spark, d), *_jr(spark, d))


@query("c6_used_by_queue", ", u AS (SELECT node, queue, cpu * 0.5 AS cpu, memory * 0.25 AS memory, gpu FROM srun JOIN sjob ON srun.job_id = sjob.job_id WHERE running), z AS (" + " UNION ALL ".join(f"SELECT queue, node.executor AS cluster, node.pool, node_type, '{c}' AS resource, CAST(u.{c} AS DOUBLE) AS value FROM u JOIN node ON u.node = node.node" for c in x.RESOURCES) + ") SELECT queue, cluster, pool, node_type, resource, sum(value) AS value FROM z GROUP BY ALL")
def c6(spark, d):
    jobs, runs = _jr(spark, d)
    usage = runs.where("running").select("job_id", "node").join(jobs.select("job_id", "queue", (F.col("cpu") * 0.5).alias("cpu"), (F.col("memory") * 0.25).alias("memory"), "gpu"), "job_id")
    return x.used_by_queue(usage.drop("job_id"), m.nodes(spark, d))


@query("c7_node_phase_counts", _ACT + _NODE + " SELECT node, cluster, phase, count(*) AS jobs FROM onn WHERE phase IN ('Running', 'Pending') GROUP BY ALL")
def c7(spark, d):
    return x.node_phase_counts(m.nodes(spark, d), *_jr(spark, d))


@query("c8_cordon_status", "SELECT DISTINCT node.executor, CASE WHEN cordoned THEN 1 ELSE 0 END AS cordoned FROM node LEFT JOIN executors e ON e.executor = node.executor AND e.executor <> 'executor-5'")
def c8(spark, d):
    return x.cordon_status(m.nodes(spark, d).select("executor").distinct(), m.executors(spark).where("executor <> 'executor-5'"))


_TR = """, tr0 AS (SELECT srun.job_id, run_id, queue, srun.pool, node, executor AS cluster, submitted, leased_at, pending_at, running_at, cpu, memory, gpu, terminated_at, CASE WHEN srun.succeeded THEN 'succeeded' WHEN srun.failed THEN 'failed' WHEN srun.cancelled THEN 'cancelled' WHEN srun.preempted THEN 'preempted' END AS fin FROM srun JOIN sjob ON srun.job_id = sjob.job_id),
tr AS (SELECT *, 'leased' AS state, leased_at AS tat FROM tr0 UNION ALL SELECT *, 'pending', pending_at FROM tr0 WHERE pending_at IS NOT NULL UNION ALL SELECT *, 'running', running_at FROM tr0 WHERE running_at IS NOT NULL UNION ALL SELECT *, fin, terminated_at FROM tr0 WHERE fin IS NOT NULL AND terminated_at IS NOT NULL),
ps AS (SELECT *, CASE WHEN running_at < tat AND NOT coalesce(pending_at = running_at, FALSE) THEN 'running' WHEN pending_at < tat AND pending_at > leased_at THEN 'pending' WHEN leased_at < tat THEN 'leased' ELSE 'queued' END AS prior, CASE WHEN running_at < tat THEN tat - running_at WHEN pending_at < tat THEN tat - pending_at WHEN leased_at < tat THEN tat - leased_at ELSE tat - submitted END AS seconds FROM tr),
rd AS (SELECT *, tat - coalesce(running_at, pending_at, leased_at) AS duration FROM tr WHERE state IN ('succeeded', 'failed', 'cancelled', 'preempted'))"""


def _transitions(spark, d):
    return x.run_transitions(*_jr(spark, d))


@query("t1_prior_state", _TR + ' SELECT run_id, state, tat AS "at", prior, seconds FROM ps')
def t1(spark, d):
    return x.with_prior_state(_transitions(spark, d)).select("run_id", "state", "at", "prior", "seconds")


_SUMS = "count(*) AS transitions, CAST(sum(seconds) AS BIGINT) AS seconds, sum(seconds * cpu / 1000) AS cpu_seconds, sum(seconds * memory) AS memory_seconds, sum(seconds * gpu) AS gpu_seconds"


@query("t2_t3_t4_by_queue", _TR + f" SELECT queue, pool, state, prior, {_SUMS} FROM ps WHERE seconds > 0 GROUP BY queue, pool, state, prior")
def t2(spark, d):
    return x.state_counters(_transitions(spark, d), ["queue", "pool"])


@query("t2_t3_t4_by_node", _TR + f" SELECT node, pool, cluster, state, prior, {_SUMS} FROM ps WHERE seconds > 0 GROUP BY node, pool, cluster, state, prior")
def t2_node(spark, d):
    return x.state_counters(_transitions(spark, d), ["node", "pool", "cluster"])


@query("t5_run_duration_histogram", _TR + ", bo AS (SELECT CAST(2 * power(2, i) AS BIGINT) AS bound FROM (SELECT unnest(range(20)) AS i) r) SELECT queue, pool, bound, count(*) AS n, CAST(sum(CASE WHEN duration <= bound THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM rd CROSS JOIN bo GROUP BY queue, pool, bound")
def t5(spark, d):
    return x.run_duration_histogram(_transitions(spark, d))


@query("t6_error_counts", "SELECT queue, pool, failure_category, failure_subcategory, count(*) AS failures FROM job_run JOIN job ON job.job_id = job_run.job_id WHERE job_run_state = 4 GROUP BY ALL")
def t6(spark, d):
    return x.error_counts(m.job_run(spark, d).where("job_run_state = 4").join(m.job(spark, d, False).select("job_id", "queue"), "job_id"), ["queue", "pool"])


@query("t6_error_counts_by_node", "SELECT cluster, node, failure_category, failure_subcategory, count(*) AS failures FROM job_run WHERE job_run_state = 4 GROUP BY ALL")
def t6_nodes(spark, d):
    return x.error_counts(m.job_run(spark, d).where("job_run_state = 4"), ["cluster", "node"])


@query("t7_preemption_loss", _TR + ", ck AS (SELECT 'none' AS checkpoint, 1000000000000 AS c UNION ALL SELECT '600', 600 UNION ALL SELECT '3600', 3600) SELECT queue, pool, checkpoint, sum(least(duration, c) * cpu / 1000) AS lost_cpu, sum(least(duration, c) * memory) AS lost_memory, sum(least(duration, c) * gpu) AS lost_gpu FROM rd CROSS JOIN ck WHERE state = 'preempted' AND duration > 0 GROUP BY queue, pool, checkpoint")
def t7(spark, d):
    return x.preemption_loss(_transitions(spark, d), (600, 3600))


@query("t9_scheduled_counts", "SELECT srun.pool, queue, priority_class, CASE WHEN srun.preempted THEN 'preempted' ELSE 'scheduled' END AS type, count(*) AS n FROM srun JOIN sjob ON srun.job_id = sjob.job_id GROUP BY ALL")
def t9(spark, d):
    jobs, runs = _jr(spark, d)
    rows = runs.select("job_id", "pool", F.when(F.col("preempted"), "preempted").otherwise("scheduled").alias("type")).join(jobs.select("job_id", "queue", "priority_class"), "job_id")
    return x.counts_by(rows, "pool", "queue", "priority_class", "type")


def _pods(spark, d):
    k = F.col("o_orderkey")
    phase = F.get(F.array(*[F.lit(p) for p in ("Pending", "Running", "Succeeded", "Failed", "")]), (k % 5).cast("int"))
    return m.table(spark, d, "orders").select(m.text("queue-", k % 4).alias("queue"), F.when(k % 13 != 0, m.text("node-", k % 110)).alias("node"), F.when(k % 3 == 0, m.text("pool-", k % 3)).alias("pod_pool"), phase.alias("phase"), (k % 4 != 1).alias("managed"), F.when(k % 2 == 0, k % 3).alias("priority"), (100.0 * (k % 7)).cast("double").alias("cpu"), (k % 5).cast("double").alias("memory"), F.lit(0.0).alias("gpu"))


_POD = ", pod AS (SELECT 'queue-' || (o_orderkey % 4) AS queue, CASE WHEN o_orderkey % 13 <> 0 THEN 'node-' || (o_orderkey % 110) END AS node, CASE WHEN o_orderkey % 3 = 0 THEN 'pool-' || (o_orderkey % 3) END AS pod_pool, CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Running' WHEN 2 THEN 'Succeeded' WHEN 3 THEN 'Failed' ELSE '' END AS phase, o_orderkey % 4 <> 1 AS managed, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 END AS priority, CAST(100 * (o_orderkey % 7) AS DOUBLE) AS cpu, CAST(o_orderkey % 5 AS DOUBLE) AS memory, CAST(0 AS DOUBLE) AS gpu FROM orders)"


@query("x1_node_availability", _POD + ", u AS (SELECT node, sum(cpu) AS c, sum(memory) AS me, sum(gpu) AS g FROM pod WHERE phase NOT IN ('Succeeded', 'Failed') GROUP BY node) SELECT node.node, unschedulable, coalesce(c, 0) AS allocated_cpu, coalesce(me, 0) AS allocated_memory, coalesce(g, 0) AS allocated_gpu, cpu - coalesce(c, 0) AS available_cpu, memory - coalesce(me, 0) AS available_memory, gpu - coalesce(g, 0) AS available_gpu FROM node LEFT JOIN u ON u.node = node.node")
def x1(spark, d):
    return x.node_availability(m.nodes(spark, d), _pods(spark, d))


@query("x2_pod_phase_metrics", _POD + ", p AS (SELECT queue, CASE WHEN pod.node IS NULL THEN 'unassigned' ELSE coalesce(node_type, 'unknown') END AS node_type, CASE WHEN phase = '' THEN 'Leased' ELSE phase END AS phase, pod.cpu FROM pod LEFT JOIN node ON node.node = pod.node), g AS (SELECT DISTINCT queue, node_type FROM p), ph AS (SELECT unnest(['Pending', 'Running', 'Succeeded', 'Failed', 'Unknown', 'Leased']) AS phase) SELECT g.queue, g.node_type, ph.phase, count(p.cpu) AS pods, coalesce(sum(p.cpu), 0) AS cpu FROM g CROSS JOIN ph LEFT JOIN p ON p.queue = g.queue AND p.node_type = g.node_type AND p.phase = ph.phase GROUP BY g.queue, g.node_type, ph.phase")
def x2(spark, d):
    return x.pod_phase_metrics(_pods(spark, d), m.nodes(spark, d)).select("queue", "node_type", "phase", "pods", "cpu")


@query("x2_pod_resources", _POD + ", p AS (SELECT queue, CASE WHEN pod.node IS NULL THEN 'unassigned' ELSE coalesce(node_type, 'unknown') END AS node_type, CASE WHEN phase = '' THEN 'Leased' ELSE phase END AS phase, pod.cpu, pod.memory, pod.gpu FROM pod LEFT JOIN node ON node.node = pod.node), g AS (SELECT DISTINCT queue, node_type FROM p), ph AS (SELECT unnest(['Pending', 'Running', 'Succeeded', 'Failed', 'Unknown', 'Leased']) AS phase) SELECT g.queue, g.node_type, ph.phase, count(p.cpu) AS pods, coalesce(sum(p.cpu), 0) AS cpu, coalesce(sum(p.memory), 0) AS memory, coalesce(sum(p.gpu), 0) AS gpu, coalesce(sum(p.cpu / 2), 0) AS usage_cpu, coalesce(sum(p.memory / 4), 0) AS usage_memory FROM g CROSS JOIN ph LEFT JOIN p ON p.queue = g.queue AND p.node_type = g.node_type AND p.phase = ph.phase GROUP BY g.queue, g.node_type, ph.phase")
def x2_resources(spark, d):
    pods = _pods(spark, d).withColumns({"usage_cpu": F.col("cpu") / 2, "usage_memory": F.col("memory") / 4})
    return x.pod_phase_metrics(pods, m.nodes(spark, d))


@query("x3_node_group_capacity", _POD + ", r AS (SELECT node, sum(CASE WHEN NOT managed THEN cpu ELSE 0 END) AS o, sum(cpu) AS a FROM pod WHERE phase = 'Running' GROUP BY node) SELECT node_type, sum(cpu) AS total_cpu, sum(CASE WHEN unschedulable THEN 0 ELSE cpu - coalesce(o, 0) END) AS allocatable_cpu, sum(CASE WHEN unschedulable THEN coalesce(a, 0) ELSE 0 END) AS cordoned_cpu FROM node LEFT JOIN r ON r.node = node.node GROUP BY node_type")
def x3(spark, d):
    return x.node_group_capacity(m.nodes(spark, d), _pods(spark, d)).select("node_type", "total_cpu", "allocatable_cpu", "cordoned_cpu")


@query("x3_node_group_resources", _POD + ", r AS (SELECT node, " + ", ".join(f"sum(CASE WHEN NOT managed THEN {c} ELSE 0 END) AS o_{c}, sum({c}) AS a_{c}" for c in x.RESOURCES) + " FROM pod WHERE phase = 'Running' GROUP BY node) SELECT node_type, " + ", ".join(f"sum({c}) AS total_{c}, sum(CASE WHEN unschedulable THEN 0 ELSE {c} - coalesce(o_{c}, 0) END) AS allocatable_{c}, sum(CASE WHEN unschedulable THEN coalesce(a_{c}, 0) ELSE 0 END) AS cordoned_{c}" for c in x.RESOURCES) + " FROM node LEFT JOIN r ON r.node = node.node GROUP BY node_type")
def x3_resources(spark, d):
    return x.node_group_capacity(m.nodes(spark, d), _pods(spark, d))


@query("x4_usage_by_queue_pool", _POD + " SELECT pod.node, queue, coalesce(pod_pool, node.pool) AS pool, sum(pod.cpu) AS cpu, sum(pod.memory) AS memory, sum(pod.gpu) AS gpu FROM pod JOIN node ON node.node = pod.node GROUP BY 1, 2, 3")
def x4(spark, d):
    return x.usage_by_queue_pool(_pods(spark, d), m.nodes(spark, d))


@query("x5_unmanaged_by_priority", _POD + ", u AS (SELECT node, coalesce(priority, 0) AS priority, sum(cpu) AS cpu FROM pod WHERE NOT managed AND phase NOT IN ('Succeeded', 'Failed') GROUP BY 1, 2), t AS (SELECT node.node, 1 AS priority, greatest(2000 - coalesce(s, 0), 0) AS cpu FROM node LEFT JOIN (SELECT node, sum(cpu) AS s FROM u GROUP BY node) q ON q.node = node.node), al AS (SELECT * FROM u UNION ALL SELECT * FROM t WHERE cpu > 0) SELECT node, priority, sum(cpu) AS cpu FROM al GROUP BY node, priority")
def x5(spark, d):
    return x.unmanaged_by_priority(_pods(spark, d), m.nodes(spark, d), {"cpu": 2000.0}, 1).select("node", "priority", "cpu")


@query("x5_unmanaged_resources", _POD + ", u AS (SELECT node, coalesce(priority, 0) AS priority, sum(cpu) AS cpu, sum(memory) AS memory, sum(gpu) AS gpu FROM pod WHERE NOT managed AND phase NOT IN ('Succeeded', 'Failed') GROUP BY 1, 2), t AS (SELECT node.node, 2 AS priority, greatest(1500 - coalesce(s, 0), 0) AS cpu, greatest(9 - coalesce(q.me, 0), 0) AS memory, CAST(0 AS DOUBLE) AS gpu FROM node LEFT JOIN (SELECT node, sum(cpu) AS s, sum(memory) AS me FROM u GROUP BY node) q ON q.node = node.node), al AS (SELECT * FROM u UNION ALL SELECT * FROM t WHERE cpu > 0 OR memory > 0) SELECT node, priority, sum(cpu) AS cpu, sum(memory) AS memory, sum(gpu) AS gpu FROM al GROUP BY node, priority")
def x5_resources(spark, d):
    return x.unmanaged_by_priority(_pods(spark, d), m.nodes(spark, d), {"cpu": 1500.0, "memory": 9.0}, 2)


@query("x6_aggregate_samples", ", sp AS (SELECT 'view' AS metric, 'sum' AS a, 2.0 AS mu UNION ALL SELECT 'click', 'mean', 0.0 UNION ALL SELECT 'purchase', 'mean', 10.0) SELECT event_type AS metric, job_id AS pod, CASE WHEN a = 'sum' THEN sum(value) ELSE avg(value) END * CASE WHEN mu > 0 THEN mu ELSE 1 END AS value FROM job_event JOIN sp ON sp.metric = event_type GROUP BY event_type, job_id, a, mu")
def x6(spark, d):
    specs = spark.createDataFrame([("view", "sum", 2.0), ("click", "mean", 0.0), ("purchase", "mean", 10.0)], "metric string, aggregation string, multiplier double")
    return x.aggregate_samples(m.job_event(spark, d).select(F.col("event_type").alias("metric"), F.col("job_id").alias("pod"), "value"), specs)


@query("x7_w8_utilisation_rollup", "SELECT run_id, created - created % 86400 AS period, event_type AS resource, max(value) AS max_current, avg(value) AS avg_current, max(bytes) AS max_cumulative FROM job_event GROUP BY ALL")
def x7(spark, d):
    return x.utilisation_rollup(m.job_event(spark, d).select("run_id", F.col("created").alias("at"), F.col("event_type").alias("resource"), F.col("value").alias("current"), F.col("bytes").alias("cumulative")), 86400)


_STREAMS = ", st AS (SELECT queue, jobset, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes, greatest(0, 1706000000 - min(created)) AS age FROM job_event GROUP BY queue, jobset)"


def _streams(spark, d):
    return x.stream_stats(m.job_event(spark, d).select(F.concat(F.lit("Events:"), "queue", F.lit(":"), "jobset").alias("key"), "bytes", F.col("created").alias("at")), 1_706_000_000)


@query("r1_stream_stats", _STREAMS + " SELECT * FROM st")
def r1(spark, d):
    return _streams(spark, d)


@query("r2_top_streams", _STREAMS + "".join(f", t{c} AS (SELECT *, '{c}' AS ranked_by FROM st ORDER BY {c} DESC, queue, jobset LIMIT 5)" for c in ("bytes", "events", "age")) + " SELECT * FROM tbytes UNION ALL SELECT * FROM tevents UNION ALL SELECT * FROM tage")
def r2(spark, d):
    return x.top_streams(_streams(spark, d), 5)


@query("r3_stream_histograms", _STREAMS + ", bo AS (SELECT 'bytes' AS measure, CAST(1024 * power(2, i) AS BIGINT) AS bound FROM (SELECT unnest(range(30)) AS i) a UNION ALL SELECT 'events', CAST(10 * power(2, i) AS BIGINT) FROM (SELECT unnest(range(30)) AS i) b UNION ALL SELECT 'age', CAST(60 * power(2, i) AS BIGINT) FROM (SELECT unnest(range(25)) AS i) c) SELECT measure, bound, CAST(sum(CASE WHEN CASE measure WHEN 'bytes' THEN bytes WHEN 'events' THEN events ELSE age END <= bound THEN 1 ELSE 0 END) AS BIGINT) AS streams FROM bo CROSS JOIN st GROUP BY measure, bound")
def r3(spark, d):
    return x.stream_histograms(_streams(spark, d))


@query("r4_queue_stream_totals", _STREAMS + " SELECT queue, count(*) AS streams, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(events) AS BIGINT) AS events FROM st GROUP BY queue")
def r4(spark, d):
    return x.queue_stream_totals(_streams(spark, d))


_INSIDE = ", ".join(f"max(CASE WHEN cum >= total * {p / 100} AND cum - n < total * {p / 100} THEN low + (high - low) * (total * {p / 100} - (cum - n)) / n END) AS p{p}" for p in (50, 95, 99))


@query("w7_latency_percentiles", f", b AS (SELECT event_type, CASE WHEN value < 0.5 THEN 0 ELSE floor(log2(value / 0.5)) + 1 END AS k, count(*) AS n, max(value) AS top FROM job_event GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type) AS total, sum(n) OVER (PARTITION BY event_type ORDER BY k) AS cum, max(top) OVER (PARTITION BY event_type) AS most FROM b), e AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE 0.5 * power(2, k - 1) END AS low, least(0.5 * power(2, k), most) AS high FROM c) SELECT event_type, {_INSIDE} FROM e GROUP BY event_type")
def w7(spark, d):
    return x.latency_percentiles(m.job_event(spark, d), "value", 0.5, ["event_type"])


@query("w8_short_jobs", _TR + ", sj AS (SELECT queue, pool, running_at // 3600 * 3600 AS start, cpu, memory, gpu FROM rd WHERE running_at IS NOT NULL AND state IN ('succeeded', 'failed', 'cancelled') AND duration < 2000) SELECT queue, pool, start, count(*) AS jobs, sum(cpu) AS cpu, sum(memory) AS memory, sum(gpu) AS gpu FROM sj GROUP BY queue, pool, start")
def w8_short(spark, d):
    done = x.run_durations(_transitions(spark, d)).where("running_at is not null and state in ('succeeded', 'failed', 'cancelled')")
    rows = done.select("queue", "pool", F.timestamp_seconds("running_at").alias("started_at"), F.col("duration").alias("seconds"), *x.RESOURCES)
    return ingest.recent_short_jobs(rows, 2000, "1 hour").withColumn("start", F.unix_timestamp("start"))


@query("w8_first_submissions", "SELECT 'c-' || (seq // 12 % 400) AS deduplication_id FROM job_event WHERE kind = 'SubmitJob' GROUP BY 1")
def w8_first(spark, d):
    subs = m.job_event(spark, d, True).where("kind = 'SubmitJob'").select(m.text("c-", F.floor(F.col("seq") / 12) % 400).alias("deduplication_id"), F.timestamp_seconds("created").alias("at"))
    out = shared_folder(spark, "first")
    writer = ingest.first_submissions(subs, "30 days").writeStream.format("parquet").option("checkpointLocation", shared_folder(spark, "offsets"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("deduplication_id")
