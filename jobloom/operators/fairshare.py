"""Fair-share accounting per pool and queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.ordering import with_position, with_running_sum
from jobloom.operators.metrics import RESOURCES, active_runs
from jobloom.sources.tables import materialise

#: Rounds of sharing out spare capacity, and the unallocated share at which they end.
ROUNDS, ENOUGH = 10, 0.01


def dominant_cost(totals: Mapping[str, Column] | None = None, multipliers: Mapping[str, float] | None = None, prefix: str = "", total_prefix: str = "total_") -> Column:
    """Largest share of any resource times its multiplier; shares of nothing are 0 (F1).

    With ``multipliers`` only the resources named there count, those without a positive number once.
    """
    shares = []
    for c in RESOURCES:
        if multipliers is not None and c not in multipliers:
            continue
        total = totals[c] if totals else F.col(f"{total_prefix}{c}")
        times = 1.0 if multipliers is None or not multipliers[c] > 0 else float(multipliers[c])
        shares.append(F.when(F.coalesce(total, F.lit(0.0)) > 0, F.col(f"{prefix}{c}") / total * times).otherwise(0.0))
    return F.greatest(F.lit(0.0), F.lit(0.0), *shares)


def weighted_cost(cost: Column | str, weight: Column | str) -> Column:
    """Cost per weight, by which queues are compared (F1); of no weight it is 0 for no cost, else endless."""
    c, w = (F.col(x) if isinstance(x, str) else x for x in (cost, weight))
    return F.when(w > 0, c / w).when(c == 0, 0.0).otherwise(float("inf"))


def pool_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("pool").agg(*[F.sum(c).alias(f"total_{c}") for c in RESOURCES])


def demand(jobs: DataFrame, runs: DataFrame, queues: DataFrame) -> DataFrame:
    """Requests of all jobs that haven't ended, by pool, queue and class (F2).

    A queued job counts in each of its pools, unless its queue is cordoned; an active one in its run's pool.
    """
    open_ = jobs.where("queued").join(queues.where("cordoned").select("queue"), "queue", "left_anti").withColumn("pool", F.explode("pools"))
    keys = ["pool", "queue", "priority_class"]
    rows = open_.select(*keys, *RESOURCES).unionByName(active_runs(jobs, runs).select(*keys, *RESOURCES))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in RESOURCES])


def allocation(jobs: DataFrame, runs: DataFrame, executors: DataFrame) -> DataFrame:
    """Requests of active jobs on known executors by pool, queue and class."""
    rows = active_runs(jobs, runs).join(executors.select("executor"), "executor", "left_semi")
    return rows.groupBy("pool", "queue", "priority_class").agg(*[F.sum(c).alias(c) for c in RESOURCES])


def away_allocation(allocated: DataFrame, away: DataFrame) -> DataFrame:
    """The part of a pool's allocation that counts for pools listing it as away pool."""
    return allocated.withColumnRenamed("pool", "away_pool").join(away, "away_pool").groupBy("pool", "queue").agg(*[F.sum(c).alias(c) for c in RESOURCES])


def queue_limits(demanded: DataFrame, totals: DataFrame, limits: DataFrame) -> DataFrame:
    """``demanded`` with limit columns: totals times the fraction of the closest rule, null without one.

    ``limits`` (queue, priority_class, pool, cpu, memory, gpu fractions; null queue or pool for any); a rule for queue and
    pool comes before one for the queue, before one for class and pool, before one for the class.
    """
    keys = ["queue", "pool", "priority_class"]
    rule = limits.select(F.col("queue").alias("_q"), F.col("pool").alias("_p"), "priority_class", F.struct(*RESOURCES).alias("_f"), (F.when(F.col("queue").isNotNull(), 2).otherwise(0) + F.when(F.col("pool").isNotNull(), 1).otherwise(0)).alias("_rank"))
    fits = demanded.select(*keys).distinct().join(rule, "priority_class").where("(_q is null or _q = queue) and (_p is null or _p = pool)")
    own = fits.groupBy(*keys).agg(*[F.max_by(F.col(f"_f.{c}"), F.when(F.col(f"_f.{c}").isNotNull(), F.col("_rank"))).alias(f"_{c}") for c in RESOURCES])
    rows = demanded.join(totals, "pool", "left").join(own, keys, "left")
    return rows.select(*demanded.columns, *[(F.col(f"total_{c}") * F.col(f"_{c}")).alias(f"limit_{c}") for c in RESOURCES])


def constrained_demand(limited: DataFrame) -> DataFrame:
    """Demand per pool and queue, each class cut at its limit."""
    return limited.groupBy("pool", "queue").agg(*[F.sum(F.least(c, F.coalesce(f"limit_{c}", c))).alias(c) for c in RESOURCES])


def queue_weights(queues: DataFrame, pools: DataFrame, overrides: DataFrame) -> DataFrame:
    """1 over the priority factor, 1 if that isn't positive; a positive override of (pool, queue) comes first."""
    rows = queues.join(pools.select("pool"), F.lit(True)).join(overrides.select("pool", "queue", F.col("priority_factor").alias("_o")), ["pool", "queue"], "left")
    own = F.when(F.col("priority_factor") > 0, 1 / F.col("priority_factor")).otherwise(1.0)
    return rows.select("pool", "queue", F.when(F.col("_o") > 0, 1 / F.col("_o")).otherwise(own).alias("weight"))


def share_out(weights: Sequence[float], demands: Sequence[float], extra: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Demand-capped and uncapped shares of one pool.

    In each round what is unallocated goes to the queues with demand left, by weight; a share above its demand is cut, and
    the surplus is shared out in the next round. The uncapped share of a queue is what it would have got with endless
    demand. ``extra`` adds a queue of that weight and endless demand at the end (F8).
    """
    w = np.array([*weights, *([extra] if extra is not None else [])], float)
    need = np.array([*demands, *([np.inf] if extra is not None else [])], float)
    capped, uncapped, spare = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    met, left = np.zeros(len(w), bool), 1.0
    for _ in range(ROUNDS):
        if left <= ENOUGH:
            break
        total = w[~met].sum()
        of = np.where(met, total + w, total)
        uncapped += np.divide(w, of, out=np.zeros_like(w), where=of > 0) * (left - spare)
        if total <= 0:
            break
        capped[~met] += w[~met] / total * left
        spare = np.where(capped > need, capped - need, 0.0)
        met |= capped >= need
        capped = np.minimum(capped, need)
        left = float(spare.sum())
    return capped, uncapped


def fair_shares(context: DataFrame) -> DataFrame:
    """Fair, demand-capped and uncapped share per pool and queue.

    ``context``: pool, queue, weight, demand (dominant cost of the constrained demand). A pool's queues are a small
    catalogue, so a pool is one group.
    """
    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("queue", ignore_index=True)
        capped, uncapped = share_out(rows["weight"], rows["demand"])
        return rows[["pool", "queue"]].assign(fair_share=rows["weight"] / rows["weight"].sum(), capped_share=capped, uncapped_share=uncapped)

    return context.groupBy("pool").applyInPandas(own, "pool string, queue string, fair_share double, capped_share double, uncapped_share double")


def theoretical_share(context: DataFrame, priority_factor: float) -> DataFrame:
    """The capped share of a new queue of that priority factor and endless demand, per pool (F8)."""
    def own(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("queue", ignore_index=True)
        return pd.DataFrame({"pool": [rows["pool"][0]], "share": [share_out(rows["weight"], rows["demand"], 1 / priority_factor)[0][-1]]})

    return context.groupBy("pool").applyInPandas(own, "pool string, share double")


def fairness_error(shares: DataFrame) -> DataFrame:
    """Sum over queues of what they are below their capped share."""
    return shares.groupBy("pool").agg(F.sum(F.greatest(F.lit(0.0), F.col("capped_share") - F.col("actual_share"))).alias("fairness_error"))


def short_job_penalty(jobs: DataFrame, runs: DataFrame, cutoffs: DataFrame, now: int) -> DataFrame:
    """Resources of finished jobs whose run started less than the pool's cutoff ago, each job once."""
    done = runs.where("(succeeded or failed or cancelled) and not preempted and not preempt_requested and running_at is not null")
    recent = done.join(cutoffs, "pool").where(F.lit(now) - F.col("running_at") < F.col("cutoff")).groupBy("job_id").agg(F.max("pool").alias("pool"))
    return recent.join(jobs.select("job_id", "queue", *RESOURCES), "job_id").groupBy("pool", "queue").agg(*[F.sum(c).alias(c) for c in RESOURCES])


def _ranked(rows: DataFrame, group: str, order: list[Column], rank: str) -> DataFrame:
    """Exact places from 1 within groups of any size: places in the whole order less those before the group."""
    keys = [f"_k{i}" for i in range(len(order))]
    placed = with_position(rows.withColumns(dict(zip(keys, order))), group, *keys, position="_at")
    # written first: its size is known when the join is planned, and a large side is split where one group is
    first = materialise(placed.groupBy(group).agg(F.min("_at").alias("_first")))
    return placed.join(first, group).withColumn(rank, F.col("_at") - F.col("_first") + 1).drop("_at", "_first", *keys)


def scheduling_order(jobs: DataFrame, runs: DataFrame, class_priority: Mapping[str, int]) -> DataFrame:
    """Place of each open job in its queue (F11): active first, class, priority number, earlier lease, submission, job_id."""
    rows = _open_jobs(jobs, runs, class_priority)
    order = [F.when(F.col("run_id").isNotNull(), 0).otherwise(1), -F.col("class_priority"), F.col("priority"), F.coalesce("leased", F.lit(0)), F.col("submitted"), F.col("job_id")]
    return _ranked(rows, "queue", order, "place").select("queue", "job_id", "place")


def _open_jobs(jobs: DataFrame, runs: DataFrame, class_priority: Mapping[str, int]) -> DataFrame:
    active = active_runs(jobs, runs).select("job_id", "run_id", F.col("created").alias("leased"), F.col("pool").alias("run_pool"))
    value = F.coalesce(*[F.when(F.col("priority_class") == c, p) for c, p in class_priority.items()], F.lit(0))
    return jobs.join(active, "job_id", "left").where("queued or run_id is not null").withColumn("class_priority", value)


def market_order(rows: DataFrame) -> DataFrame:
    """Place of each job in its pool (F12): class, bid, active first, earlier lease, submission, job_id.

    ``rows``: pool, job_id, class_priority, bid, leased (null if queued), submitted.
    """
    order = [-F.col("class_priority"), -F.col("bid"), F.when(F.col("leased").isNotNull(), 0).otherwise(1), F.coalesce("leased", F.lit(0)), F.col("submitted"), F.col("job_id")]
    return _ranked(rows, "pool", order, "place")


def realised_value(placed: DataFrame, units: Mapping[str, float]) -> DataFrame:
    """Per queue the sum of price times the largest request in units."""
    return placed.groupBy("queue").agg(F.sum(F.col("bid") * dominant_cost({c: F.lit(u) for c, u in units.items()})).alias("value"))


def clearing_price(ordered: DataFrame, totals: DataFrame, cutoff: float) -> DataFrame:
    """Per pool the price at which jobs in market order fill it.

    ``ordered`` has pool, place, bid, gang_id and requests. The first job whose running dominant cost is above the cutoff
    sets the price: the least bid of its gang, or its own; 0 where all fit.
    """
    rows = with_running_sum(ordered, {c: f"run_{c}" for c in RESOURCES}, "place", within=("pool",))
    rows = rows.join(totals, "pool")
    over = rows.where(dominant_cost(prefix="run_") > cutoff)
    first = over.groupBy("pool").agg(F.min_by(F.struct("job_id", "bid", "gang_id"), "place").alias("f")).select("pool", "f.*")
    gang = ordered.where("gang_id is not null").groupBy("pool", "gang_id").agg(F.min("bid").alias("_least"))
    priced = first.join(gang, ["pool", "gang_id"], "left")
    return totals.select("pool").join(priced, "pool", "left").select("pool", "job_id", F.coalesce("_least", "bid", F.lit(0.0)).alias("price"))


def resource_share(allocated: DataFrame) -> DataFrame:
    """Each queue's share of the pool's allocation per resource."""
    own = allocated.groupBy("pool", "queue").agg(*[F.sum(c).alias(c) for c in RESOURCES])
    total = own.groupBy("pool").agg(*[F.sum(c).alias(f"_{c}") for c in RESOURCES])
    return own.join(total, "pool").select("pool", "queue", *[F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(0.0).alias(f"share_{c}") for c in RESOURCES])


def flatten_cycle_metrics(events: DataFrame) -> DataFrame:
    """Metric events (pool, spot_price, price_override, queues map of struct of maps) as pool, queue, resource rows (F16)."""
    rows = events.select("pool", F.coalesce("price_override", "spot_price").alias("price"), F.explode("queues").alias("queue", "q"))
    each = rows.select("pool", "queue", "price", F.explode("q.demand").alias("resource", "demand"), "q")
    got = lambda name: F.coalesce(F.try_element_at(F.col(f"q.{name}"), F.col("resource")), F.lit(0.0)).alias(name)
    return each.select("pool", "queue", "resource", "demand", got("constrained_demand"), got("billable"), "price")


def queue_stats(allocated: DataFrame, shares: DataFrame, counts: DataFrame) -> DataFrame:
    """The export per pool and queue: shares, shares of the allocation, amounts and counts."""
    sums = allocated.groupBy("pool", "queue").agg(*[F.sum(c).alias(f"allocated_{c}") for c in RESOURCES])
    return shares.join(sums, ["pool", "queue"], "left").join(resource_share(allocated), ["pool", "queue"], "left").join(counts, ["pool", "queue"], "left").na.fill(0)


def demand_context(jobs: DataFrame, runs: DataFrame, queues: DataFrame, nodes: DataFrame, limits: DataFrame, overrides: DataFrame) -> DataFrame:
    """pool, queue, weight and demand as ``fair_shares`` takes them."""
    totals = pool_totals(nodes)
    cut = constrained_demand(queue_limits(demand(jobs, runs, queues), totals, limits))
    weights = queue_weights(queues, totals, overrides)
    rows = weights.join(cut, ["pool", "queue"], "left").na.fill(0.0, list(RESOURCES)).join(totals, "pool")
    return rows.select("pool", "queue", "weight", dominant_cost().alias("demand"))


