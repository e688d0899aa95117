"""Queries of fair-share accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.jobs.metric_queries import _ACT
from jobloom.jobs.registry import query
from jobloom.operators import fairshare as s
from jobloom.operators import metrics as x
from jobloom.sources import model as m
from jobloom.sources.model import NOW

CLASSES = {"high": 1000, "low": 100}
_R3 = "sum(cpu) AS cpu, sum(memory) AS memory, sum(gpu) AS gpu"
_TOT = ", tot AS (SELECT pool, sum(cpu) AS total_cpu, sum(memory) AS total_memory, sum(gpu) AS total_gpu FROM node GROUP BY pool)"
_DEM = _ACT + f", dem AS (SELECT pool, queue, priority_class, {_R3} FROM (SELECT pool, queue, priority_class, cpu, memory, gpu FROM sjob_pool WHERE queued AND queue NOT IN (SELECT queue FROM queues WHERE cordoned) UNION ALL SELECT pool, queue, priority_class, cpu, memory, gpu FROM act) u GROUP BY pool, queue, priority_class)"
_ALL = _ACT + f", alo AS (SELECT pool, queue, priority_class, {_R3} FROM act WHERE executor <> 'executor-5' GROUP BY pool, queue, priority_class)"


def _dom(p: str = "") -> str:
    return "greatest(0, " + ", ".join(f"CASE WHEN total_{c} > 0 THEN {p}{c} / total_{c} ELSE 0 END" for c in x.RESOURCES) + ")"


_LIM = _DEM + _TOT + ", lim AS (SELECT dem.*, total_cpu * CASE WHEN queue = 'queue-1' AND pool = 'pool-1' THEN 0.02 WHEN queue = 'queue-1' THEN 0.05 WHEN priority_class = 'low' THEN 0.5 END AS limit_cpu, total_memory * CASE WHEN priority_class = 'low' AND pool = 'pool-2' THEN 0.1 WHEN priority_class = 'low' THEN 0.4 END AS limit_memory FROM dem LEFT JOIN tot USING (pool)), con AS (SELECT pool, queue, sum(least(cpu, coalesce(limit_cpu, cpu))) AS cpu, sum(least(memory, coalesce(limit_memory, memory))) AS memory, sum(gpu) AS gpu FROM lim GROUP BY pool, queue)"


def _jr(spark, d):
    return m.scheduler_jobs(spark, d), m.scheduler_runs(spark, d)


def _limits(spark):
    rows = [(None, "low", None, 0.5, 0.4, None), (None, "low", "pool-2", None, 0.1, None), ("queue-1", "low", None, 0.05, None, None), ("queue-1", "high", None, 0.05, None, None), ("queue-1", "low", "pool-1", 0.02, None, None), ("queue-1", "high", "pool-1", 0.02, None, None)]
    return spark.createDataFrame(rows, "queue string, priority_class string, pool string, cpu double, memory double, gpu double")


def _overrides(spark):
    return spark.createDataFrame([("pool-0", "queue-1", 0.5), ("pool-1", "queue-2", -1.0)], "pool string, queue string, priority_factor double")


def _context(spark, d):
    return s.demand_context(*_jr(spark, d), m.queues(spark), m.nodes(spark, d), _limits(spark), _overrides(spark))


def _known(spark):
    return m.executors(spark).where("executor <> 'executor-5'")


@query("f1_dominant_cost", _ALL + _TOT + f", q AS (SELECT pool, queue, {_R3} FROM alo GROUP BY pool, queue) SELECT pool, queue, {_dom()} AS cost FROM q JOIN tot USING (pool)")
def f1(spark, d):
    own = s.allocation(*_jr(spark, d), _known(spark)).groupBy("pool", "queue").agg(*[F.sum(c).alias(c) for c in x.RESOURCES])
    return own.join(s.pool_totals(m.nodes(spark, d)), "pool").select("pool", "queue", s.dominant_cost().alias("cost"))


@query("f2_demand", _DEM + " SELECT * FROM dem")
def f2(spark, d):
    return s.demand(*_jr(spark, d), m.queues(spark))


@query("f3_allocation", _ALL + " SELECT * FROM alo")
def f3(spark, d):
    return s.allocation(*_jr(spark, d), _known(spark))


@query("f3_away_allocation", _ALL + f" SELECT 'pool-0' AS pool, queue, {_R3} FROM alo WHERE pool = 'pool-2' GROUP BY queue")
def f3_away(spark, d):
    away = spark.createDataFrame([("pool-0", "pool-2")], "pool string, away_pool string")
    return s.away_allocation(s.allocation(*_jr(spark, d), _known(spark)), away)


@query("f4_queue_limits", _LIM + " SELECT pool, queue, priority_class, limit_cpu, limit_memory FROM lim")
def f4(spark, d):
    return s.queue_limits(s.demand(*_jr(spark, d), m.queues(spark)), s.pool_totals(m.nodes(spark, d)), _limits(spark)).select("pool", "queue", "priority_class", "limit_cpu", "limit_memory")


@query("f5_constrained_demand", _LIM + " SELECT pool, queue, cpu, memory, gpu FROM con")
def f5(spark, d):
    return s.constrained_demand(s.queue_limits(s.demand(*_jr(spark, d), m.queues(spark)), s.pool_totals(m.nodes(spark, d)), _limits(spark)))


@query("f6_queue_weights", _TOT + " SELECT pool, queue, CASE WHEN pool = 'pool-0' AND queue = 'queue-1' THEN 2.0 ELSE 1 / priority_factor END AS weight FROM queues CROSS JOIN tot")
def f6(spark, d):
    return s.queue_weights(m.queues(spark), s.pool_totals(m.nodes(spark, d)), _overrides(spark))


def _rounds(extra: float | None = None) -> str:
    """Sharing out spare capacity in SQL: a common table expression per round, ``r10`` at last; ``extra`` adds a queue."""
    more = f" UNION ALL SELECT pool, NULL, {1 / extra}, CAST('Infinity' AS DOUBLE) FROM tot" if extra else ""
    sql = f", r0 AS (SELECT pool, queue, weight AS w, demand AS need, CAST(0 AS DOUBLE) AS capped, CAST(0 AS DOUBLE) AS uncapped, CAST(0 AS DOUBLE) AS spare, FALSE AS met, CAST(1 AS DOUBLE) AS lft FROM (SELECT pool, queue, weight, demand FROM ctx{more}) c)"
    for k in range(s.ROUNDS):
        sql += f""", a{k} AS (SELECT *, lft > {s.ENOUGH} AS going, coalesce(sum(CASE WHEN NOT met THEN w END) OVER (PARTITION BY pool), 0) AS tw FROM r{k}),
b{k} AS (SELECT *, CASE WHEN going AND tw + CASE WHEN met THEN w ELSE 0 END > 0 THEN uncapped + w / (tw + CASE WHEN met THEN w ELSE 0 END) * (lft - spare) ELSE uncapped END AS un, CASE WHEN going AND tw > 0 AND NOT met THEN capped + w / tw * lft ELSE capped END AS ca FROM a{k}),
c{k} AS (SELECT *, CASE WHEN going AND tw > 0 THEN greatest(ca - need, 0) ELSE spare END AS sp FROM b{k}),
r{k + 1} AS (SELECT pool, queue, w, need, CASE WHEN going AND tw > 0 THEN least(ca, need) ELSE ca END AS capped, un AS uncapped, sp AS spare, met OR (going AND tw > 0 AND ca >= need) AS met, CASE WHEN NOT going THEN lft WHEN tw > 0 THEN sum(sp) OVER (PARTITION BY pool) ELSE 0 END AS lft FROM c{k})"""
    return sql


_CTX = _LIM + f", ctx AS (SELECT pool, queue, weight, {_dom()} AS demand FROM (SELECT tot.*, queues.queue, CASE WHEN tot.pool = 'pool-0' AND queues.queue = 'queue-1' THEN 2.0 ELSE 1 / priority_factor END AS weight, coalesce(con.cpu, 0) AS cpu, coalesce(con.memory, 0) AS memory, coalesce(con.gpu, 0) AS gpu FROM queues CROSS JOIN tot LEFT JOIN con ON con.pool = tot.pool AND con.queue = queues.queue) z)"
_SHARES = _CTX + _rounds() + f", sha AS (SELECT pool, queue, w / sum(w) OVER (PARTITION BY pool) AS fair_share, capped AS capped_share, uncapped AS uncapped_share FROM r{s.ROUNDS})"
_ALO = f", alo AS (SELECT pool, queue, priority_class, {_R3} FROM act WHERE executor <> 'executor-5' GROUP BY pool, queue, priority_class), own AS (SELECT pool, queue, {_R3} FROM alo GROUP BY pool, queue)"


def _places(df, *columns, digits=9):
    """Sums of many doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("f1_weighted_cost", _ALL + _TOT + f", q AS (SELECT pool, queue, {_R3} FROM alo GROUP BY pool, queue) SELECT pool, q.queue, greatest(0, CASE WHEN total_cpu > 0 THEN cpu / total_cpu * 2 ELSE 0 END, CASE WHEN total_gpu > 0 THEN gpu / total_gpu ELSE 0 END) * priority_factor AS weighted_cost FROM q JOIN tot USING (pool) JOIN queues ON queues.queue = q.queue")
def f1_weighted(spark, d):
    own = s.allocation(*_jr(spark, d), _known(spark)).groupBy("pool", "queue").agg(*[F.sum(c).alias(c) for c in x.RESOURCES])
    rows = own.join(s.pool_totals(m.nodes(spark, d)), "pool").join(m.queues(spark), "queue")
    return rows.select("pool", "queue", s.weighted_cost(s.dominant_cost(multipliers={"cpu": 2.0, "gpu": 0.0}), 1 / F.col("priority_factor")).alias("weighted_cost"))


@query("f7_fair_shares", _SHARES + " SELECT pool, queue, round(fair_share, 9) AS fair_share, round(capped_share, 9) AS capped_share, round(uncapped_share, 9) AS uncapped_share FROM sha")
def f7(spark, d):
    return _places(s.fair_shares(_context(spark, d)), "fair_share", "capped_share", "uncapped_share")


@query("f8_theoretical_share", _CTX + _rounds(2.0) + f" SELECT pool, round(capped, 9) AS share FROM r{s.ROUNDS} WHERE queue IS NULL")
def f8(spark, d):
    return _places(s.theoretical_share(_context(spark, d), 2.0), "share")


@query("f9_fairness_error", _SHARES + _ALO + f", ac AS (SELECT pool, queue, {_dom()} AS actual_share FROM own JOIN tot USING (pool)) SELECT sha.pool, round(sum(greatest(0, capped_share - coalesce(actual_share, 0))), 9) AS fairness_error FROM sha LEFT JOIN ac ON ac.pool = sha.pool AND ac.queue = sha.queue GROUP BY sha.pool")
def f9(spark, d):
    own = s.allocation(*_jr(spark, d), _known(spark)).groupBy("pool", "queue").agg(*[F.sum(c).alias(c) for c in x.RESOURCES])
    actual = own.join(s.pool_totals(m.nodes(spark, d)), "pool").select("pool", "queue", s.dominant_cost().alias("actual_share"))
    return _places(s.fairness_error(s.fair_shares(_context(spark, d)).join(actual, ["pool", "queue"], "left").na.fill(0.0)), "fairness_error")


@query("f10_short_job_penalty", f", cu AS (SELECT 'pool-0' AS pool, 60000000 AS cutoff UNION ALL SELECT 'pool-1', 200000000) SELECT srun.pool, queue, {_R3} FROM srun JOIN cu ON cu.pool = srun.pool JOIN sjob ON sjob.job_id = srun.job_id WHERE (srun.succeeded OR srun.failed OR srun.cancelled) AND NOT preempted AND NOT preempt_requested AND running_at IS NOT NULL AND {NOW} - running_at < cutoff GROUP BY srun.pool, queue")
def f10(spark, d):
    cutoffs = spark.createDataFrame([("pool-0", 60_000_000), ("pool-1", 200_000_000)], "pool string, cutoff long")
    return s.short_job_penalty(*_jr(spark, d), cutoffs, NOW)


_OPEN = _ACT + ", opn AS (SELECT sjob.*, a.run_id, a.created AS leased, a.pool AS run_pool, CASE priority_class WHEN 'high' THEN 1000 ELSE 100 END AS cp FROM sjob LEFT JOIN (SELECT job_id, run_id, created, pool FROM act) a ON a.job_id = sjob.job_id WHERE queued OR a.run_id IS NOT NULL)"


@query("f11_scheduling_order", _OPEN + " SELECT queue, job_id, row_number() OVER (PARTITION BY queue ORDER BY CASE WHEN run_id IS NOT NULL THEN 0 ELSE 1 END, cp DESC, priority, coalesce(leased, 0), submitted, job_id) AS place FROM opn")
def f11(spark, d):
    return s.scheduling_order(*_jr(spark, d), CLASSES)


_MKT = _OPEN + ", mk0 AS (SELECT coalesce(run_pool, pool1) AS pool, opn.* EXCLUDE (run_pool) FROM opn), mk AS (SELECT mk0.*, coalesce(amount, CAST(0 AS DOUBLE)) AS bid FROM mk0 LEFT JOIN bids ON bids.queue = mk0.queue AND bids.pool = mk0.pool AND band = price_band AND phase = 'queued'), mo AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY cp DESC, bid DESC, CASE WHEN leased IS NOT NULL THEN 0 ELSE 1 END, coalesce(leased, 0), submitted, job_id) AS place FROM mk)"


def _market(spark, d):
    rows = s._open_jobs(*_jr(spark, d), CLASSES).withColumn("pool", F.coalesce("run_pool", F.get("pools", F.lit(0))))
    return s.market_order(x.resolve_bids(rows.drop("pools"), m.bids(spark), "queued"))


@query("f12_market_order", _MKT + " SELECT pool, job_id, bid, place FROM mo")
def f12(spark, d):
    return _market(spark, d).select("pool", "job_id", "bid", "place")


@query("f13_realised_value", _MKT + " SELECT queue, sum(bid * greatest(0, cpu / 8000, memory / 16, gpu / 1)) AS value FROM mk WHERE run_id IS NOT NULL GROUP BY queue")
def f13(spark, d):
    return s.realised_value(_market(spark, d).where("run_id is not null"), {"cpu": 8000.0, "memory": 16.0, "gpu": 1.0})


@query("f14_clearing_price", _MKT + _TOT + f", ru AS (SELECT *, sum(cpu) OVER w AS run_cpu, sum(memory) OVER w AS run_memory, sum(gpu) OVER w AS run_gpu FROM mo JOIN tot USING (pool) WINDOW w AS (PARTITION BY pool ORDER BY place)), fi AS (SELECT pool, min(place) AS p FROM ru WHERE {_dom('run_')} > 0.1 GROUP BY pool), pr AS (SELECT mo.pool, mo.job_id, coalesce(CASE WHEN mo.gang_id IS NOT NULL THEN (SELECT min(m2.bid) FROM mo m2 WHERE m2.pool = mo.pool AND m2.gang_id = mo.gang_id) END, mo.bid) AS price FROM mo JOIN fi ON fi.pool = mo.pool AND fi.p = mo.place) SELECT tot.pool, pr.job_id, coalesce(price, CAST(0 AS DOUBLE)) AS price FROM tot LEFT JOIN pr ON pr.pool = tot.pool")
def f14(spark, d):
    return s.clearing_price(_market(spark, d), s.pool_totals(m.nodes(spark, d)), 0.1)


@query("f15_resource_share", _ALL + f", q AS (SELECT pool, queue, {_R3} FROM alo GROUP BY pool, queue) SELECT pool, queue, " + ", ".join(f"CASE WHEN sum({c}) OVER (PARTITION BY pool) > 0 THEN {c} / sum({c}) OVER (PARTITION BY pool) ELSE 0 END AS share_{c}" for c in x.RESOURCES) + " FROM q")
def f15(spark, d):
    return s.resource_share(s.allocation(*_jr(spark, d), _known(spark)))


@query("f16_flatten_cycle_metrics", _DEM + ", q AS (SELECT pool, queue, sum(cpu) AS cpu, sum(memory) AS memory FROM dem GROUP BY pool, queue) SELECT pool, queue, 'cpu' AS resource, cpu AS demand, CAST(cpu * 0.5 AS DOUBLE) AS constrained_demand, CAST(0 AS DOUBLE) AS billable, CAST(CASE WHEN pool = 'pool-1' THEN 7 ELSE 3 END AS DOUBLE) AS price FROM q UNION ALL SELECT pool, queue, 'memory', memory, CAST(0 AS DOUBLE), memory, CAST(CASE WHEN pool = 'pool-1' THEN 7 ELSE 3 END AS DOUBLE) FROM q")
def f16(spark, d):
    own = s.demand(*_jr(spark, d), m.queues(spark)).groupBy("pool", "queue").agg(F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"))
    one = F.struct(F.create_map(F.lit("cpu"), F.col("cpu"), F.lit("memory"), F.col("memory")).alias("demand"), F.create_map(F.lit("cpu"), F.col("cpu") * 0.5).alias("constrained_demand"), F.create_map(F.lit("memory"), F.col("memory")).alias("billable"))
    events = own.groupBy("pool").agg(F.map_from_entries(F.collect_list(F.struct(F.col("queue"), one))).alias("queues")).withColumns({"spot_price": F.lit(3.0), "price_override": F.when(F.col("pool") == "pool-1", 7.0)})
    return s.flatten_cycle_metrics(events)


_COUNTED = ", cou AS (SELECT srun.pool, queue, CAST(sum(CASE WHEN running THEN 1 ELSE 0 END) AS BIGINT) AS scheduled, CAST(sum(CASE WHEN preempted THEN 1 ELSE 0 END) AS BIGINT) AS preempted FROM srun JOIN sjob ON sjob.job_id = srun.job_id GROUP BY srun.pool, queue)"


@query("s5_queue_stats", _SHARES + _ALO + _COUNTED + " SELECT sha.pool, sha.queue, round(fair_share, 9) AS fair_share, round(capped_share, 9) AS capped_share, round(uncapped_share, 9) AS uncapped_share, " + ", ".join(f"coalesce({c}, 0) AS allocated_{c}" for c in x.RESOURCES) + ", " + ", ".join(f"round(coalesce(CASE WHEN t_{c} > 0 THEN {c} / t_{c} ELSE 0 END, 0), 9) AS share_{c}" for c in x.RESOURCES) + ", coalesce(scheduled, 0) AS scheduled, coalesce(preempted, 0) AS preempted FROM sha LEFT JOIN (SELECT *, " + ", ".join(f"sum({c}) OVER (PARTITION BY pool) AS t_{c}" for c in x.RESOURCES) + " FROM own) o ON o.pool = sha.pool AND o.queue = sha.queue LEFT JOIN cou ON cou.pool = sha.pool AND cou.queue = sha.queue")
def s5(spark, d):
    jobs, runs = _jr(spark, d)
    ended = runs.join(jobs.select("job_id", "queue"), "job_id").groupBy("pool", "queue").agg(F.count_if("running").alias("scheduled"), F.count_if("preempted").alias("preempted"))
    stats = s.queue_stats(s.allocation(jobs, runs, _known(spark)), s.fair_shares(_context(spark, d)), ended)
    return _places(stats, "fair_share", "capped_share", "uncapped_share", *[f"share_{c}" for c in x.RESOURCES])
