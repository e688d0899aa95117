"""Queue, state and capacity metrics.

Resources are columns (cpu, memory, gpu) where jobs and nodes are joined and become rows only after aggregation. Medians
are exact: values are counted first, which is reduced before the shuffle, and medians are read from the counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESOURCES = ("cpu", "memory", "gpu")
# fixed values: histogram bounds in seconds
DURATION_BUCKETS = (60, 600, 1800, 3600, 10800, 43200, 86400, 172800, 604800)
RUN_BUCKETS = tuple(2 * 2**i for i in range(20))
# fixed value: the bid of running jobs that can't be preempted
NOT_PREEMPTIBLE_BID = 1_000_000.0


def statistics(rows: DataFrame, by: Sequence[str], value: str, buckets: Sequence[float] = ()) -> DataFrame:
    """count, sum, min, max, exact median, and cumulative bucket counts of a column per group.

    The rows of a group are counted per value, and only distinct values are ordered; no group is gathered.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    placed = counted.withColumns({"_upto": F.sum("_n").over(group.orderBy("_v")), "_all": F.sum("_n").over(group)})
    v, n, half = F.col("_v"), F.col("_n"), (F.col("_all") + 1) / 2
    low, high = (F.min(F.when(F.col("_upto") >= place, v)) for place in (F.floor(half), F.ceil(half)))
    out = [F.sum(n).alias("count"), F.sum(v * n).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), ((low + high) / 2).cast("double").alias("median")]
    return placed.groupBy(*by).agg(*out, *[F.coalesce(F.sum(F.when(v <= b, n)), F.lit(0)).alias(f"le_{b}") for b in buckets])


def as_rows(df: DataFrame, columns: Sequence[str], value: str = "value", key: str = "resource") -> DataFrame:
    """Resource columns as (resource, value) rows."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value)) for c in columns])).alias("_x")).select(*rest, "_x.*")


# queues


def queue_sizes(jobs: DataFrame, queues: DataFrame) -> DataFrame:
    """Queued jobs per known queue, validated or not, zero where there are none (M1); distinct scheduling keys (M2)."""
    counts = jobs.where("queued").groupBy("queue").agg(F.count_if("validated").alias("validated"), F.count_if(~F.col("validated")).alias("unvalidated"), F.count_distinct(F.when(F.col("validated"), F.col("scheduling_key"))).alias("scheduling_keys"))
    own = queues.select("queue").join(counts, "queue", "left")
    return own.select("queue", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("validated", "unvalidated", "scheduling_keys")])


def primary_pool(pools: Column, order: Sequence[str]) -> Column:
    """The only pool, else the first of a given order that is among them, else their first (M8)."""
    preferred = F.filter(F.array(*map(F.lit, order)), lambda p: F.array_contains(pools, p))
    return F.when(F.size(pools) == 1, F.get(pools, F.lit(0))).otherwise(F.coalesce(F.get(preferred, F.lit(0)), F.get(pools, F.lit(0))))


def queued_by_pool(jobs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Queued validated jobs once per pool, with the accounting role of that pool."""
    rows = jobs.where("queued and validated").withColumn("_primary", primary_pool(F.col("pools"), order))
    rows = rows.withColumn("pool", F.explode("pools"))
    return rows.withColumn("role", F.when(F.col("pool") == F.col("_primary"), "primary").otherwise("secondary")).drop("_primary")


def queued_durations(jobs: DataFrame, runs: DataFrame, now: int, order: Sequence[str]) -> DataFrame:
    """Time since the later of creation and the end of the latest run (M3)."""
    ends = runs.groupBy("job_id").agg(F.max("terminated_at").alias("ended"))
    rows = queued_by_pool(jobs, order).join(ends, "job_id", "left").withColumn("seconds", F.lit(now) - F.greatest("submitted", F.coalesce("ended", "submitted")))
    return statistics(rows, ("pool", "priority_class", "queue", "role"), "seconds", DURATION_BUCKETS)


def active_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that haven't ended, with their jobs' columns."""
    ended = F.col("succeeded") | F.col("failed") | F.col("cancelled") | F.col("preempted") | F.col("returned")
    own = runs.where(~ended).select("job_id", "run_id", "executor", "node", "pool", "created", "pending", "running", "preempt_requested", "running_at")
    return own.join(jobs.select("job_id", "queue", "priority_class", "price_band", "submitted", "priority", "gang_id", "gang_cardinality", *RESOURCES), "job_id")


def running_durations(jobs: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """Time since an active run was created (M4)."""
    rows = active_runs(jobs, runs).withColumn("seconds", F.lit(now) - F.col("created"))
    return statistics(rows, ("pool", "priority_class", "queue"), "seconds", DURATION_BUCKETS)


def queued_resources(jobs: DataFrame, order: Sequence[str]) -> DataFrame:
    """Requests of queued jobs by pool, class, queue, band, role and resource (M5)."""
    rows = as_rows(queued_by_pool(jobs, order).select("pool", "priority_class", "queue", "price_band", "role", *RESOURCES), RESOURCES)
    return statistics(rows, ("pool", "priority_class", "queue", "price_band", "role", "resource"), "value")


def running_resources(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests of running jobs (M6)."""
    rows = as_rows(active_runs(jobs, runs).select("pool", "priority_class", "queue", "price_band", *RESOURCES), RESOURCES)
    return statistics(rows, ("pool", "priority_class", "queue", "price_band", "resource"), "value")


def resolve_bids(rows: DataFrame, bids: DataFrame, phase: str) -> DataFrame:
    """``rows`` (queue, pool, price_band) with their bid: the band's, else the one without band, else 0."""
    own = bids.where(F.col("phase") == phase)
    band = own.where("band is not null").select("queue", "pool", F.col("band").alias("price_band"), F.col("amount").alias("_band"))
    rest = own.where("band is null").groupBy("queue", "pool").agg(F.max("amount").alias("_rest"))
    return rows.join(band, ["queue", "pool", "price_band"], "left").join(rest, ["queue", "pool"], "left").withColumn("bid", F.coalesce("_band", "_rest", F.lit(0.0))).drop("_band", "_rest")


def bid_price_stats(jobs: DataFrame, bids: DataFrame, order: Sequence[str]) -> DataFrame:
    """Bids of queued jobs by pool, class, queue and role (M7)."""
    rows = resolve_bids(queued_by_pool(jobs, order), bids, "queued")
    return statistics(rows, ("pool", "priority_class", "queue", "role"), "bid").drop("count", "sum")


def running_bids(jobs: DataFrame, runs: DataFrame, bids: DataFrame, preemptible: Sequence[str]) -> DataFrame:
    """Active runs with their bid; those of classes that can't be preempted have the fixed one."""
    rows = resolve_bids(active_runs(jobs, runs), bids, "running")
    return rows.withColumn("bid", F.when(F.col("priority_class").isin(*preemptible), F.col("bid")).otherwise(NOT_PREEMPTIBLE_BID))


def running_bid_price_stats(jobs: DataFrame, runs: DataFrame, bids: DataFrame, preemptible: Sequence[str]) -> DataFrame:
    """Bids of running jobs by pool, class and queue (M7)."""
    return statistics(running_bids(jobs, runs, bids, preemptible), ("pool", "priority_class", "queue"), "bid").drop("count", "sum")


def price_band_grid(queues: DataFrame, pools: DataFrame, bands: DataFrame, phases: DataFrame, bids: DataFrame) -> DataFrame:
    """Every queue, band, pool and phase with its bid, 0 where there is none (M9). The sides are small catalogues."""
    every = F.lit(True)
    grid = queues.select("queue").join(pools, every).join(bands, every).join(phases, every)
    return grid.join(bids, ["queue", "pool", "band", "phase"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


# capacity


def cluster_capacity(nodes: DataFrame, executors: DataFrame, away: DataFrame | None = None) -> DataFrame:
    """Total and available resources and node counts by cluster, pool, capacity class and type.

    Cordoned or unschedulable nodes have nothing available. ``away`` (pool, away_pool): a node counts as shared for each
    pool that lists its own as away pool.
    """
    settings = executors.select("executor", F.col("cordoned").alias("_cordoned"))
    rows = nodes.join(settings, "executor", "left").withColumn("schedulable", ~(F.col("unschedulable") | F.coalesce("_cordoned", F.lit(False)))).withColumn("capacity_class", F.lit("dedicated"))
    if away is not None:
        shared = rows.join(away.select(F.col("pool").alias("_for"), F.col("away_pool").alias("pool")), "pool").withColumns({"pool": F.col("_for"), "capacity_class": F.lit("shared")})
        rows = rows.unionByName(shared.select(*rows.columns))
    keys = ["executor", "pool", "node_type", "reservation", "capacity_class"]
    sums = [F.sum(c).alias(f"total_{c}") for c in RESOURCES] + [F.sum(F.when(F.col("schedulable"), F.col(c)).otherwise(0.0)).alias(f"available_{c}") for c in RESOURCES]
    return rows.groupBy(*keys).agg(F.count("*").alias("nodes"), F.count_if("schedulable").alias("schedulable_nodes"), *sums)


def deduct_home_usage(nodes: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Per node what jobs running on its own pool leave, not below zero."""
    used = active_runs(jobs, runs).groupBy("node", "pool").agg(*[F.sum(c).alias(f"_{c}") for c in RESOURCES])
    rows = nodes.join(used, ["node", "pool"], "left")
    return rows.select("node", "pool", *[F.greatest(F.col(c) - F.coalesce(f"_{c}", F.lit(0.0)), F.lit(0.0)).alias(c) for c in RESOURCES])


#: What a row of capacity is told by.
CAPACITY_KEYS = ("cluster", "pool", "node_type", "reservation", "physical_pool", "capacity_class", "scalable_unit")


def capacity_by_resource(nodes: DataFrame, executors: DataFrame, jobs: DataFrame, runs: DataFrame, away: DataFrame, floating: DataFrame | None = None) -> DataFrame:
    """total, farm and available per CAPACITY_KEYS and resource (C1, with C2 on its shared rows).

    Farm is what the platform may use of a node (``unmanaged_`` columns, where nodes have them, tell what others use), also
    on nodes that aren't schedulable; available is that of schedulable ones. Rows of class "shared" are for pools that list
    the node's own pool as away pool: from their total and available goes what jobs on their home pool use, and never
    below zero. ``floating`` (pool and resources) belongs to no node and is a cluster of that name.
    """
    own = lambda c: F.col(c) - F.coalesce(F.col(f"unmanaged_{c}"), F.lit(0.0)) if f"unmanaged_{c}" in nodes.columns else F.col(c)
    unit = F.coalesce("scalable_unit", F.lit("")) if "scalable_unit" in nodes.columns else F.lit("")
    settings = executors.select("executor", F.col("cordoned").alias("_cordoned"))
    used = active_runs(jobs, runs).groupBy("node", "pool").agg(*[F.sum(c).alias(f"used_{c}") for c in RESOURCES])
    rows = nodes.join(settings, "executor", "left").join(used, ["node", "pool"], "left")
    on = ~(F.col("unschedulable") | F.coalesce("_cordoned", F.lit(False)))
    amounts = F.array(*[F.struct(F.lit(c).alias("resource"), F.col(c).alias("total"), own(c).alias("farm"), F.when(on, own(c)).otherwise(0.0).alias("available"), F.coalesce(f"used_{c}", F.lit(0.0)).alias("used"), F.when(on, F.coalesce(f"used_{c}", F.lit(0.0))).otherwise(0.0).alias("used_on")) for c in RESOURCES])
    rows = rows.select(F.col("executor").alias("cluster"), "pool", "node_type", F.coalesce("reservation", F.lit("")).alias("reservation"), F.col("pool").alias("physical_pool"), unit.alias("scalable_unit"), F.explode(amounts).alias("a")).select("*", "a.*").drop("a")
    shared = rows.join(away.select(F.col("pool").alias("_for"), F.col("away_pool").alias("pool")), "pool").drop("pool").withColumnRenamed("_for", "pool")
    sums = lambda df, kind: df.withColumn("capacity_class", F.lit(kind)).groupBy(*CAPACITY_KEYS, "resource").agg(*[F.sum(c).alias(c) for c in ("total", "farm", "available", "used", "used_on")])
    keep = [*CAPACITY_KEYS, "resource", "total", "farm", "available"]
    lent = sums(shared, "shared").withColumns({"total": F.greatest(F.col("total") - F.col("used"), F.lit(0.0)), "available": F.greatest(F.col("available") - F.col("used_on"), F.lit(0.0))})
    out = sums(rows, "dedicated").select(*keep).unionByName(lent.select(*keep))
    if floating is None:
        return out
    loose = as_rows(floating.select("pool", *RESOURCES), RESOURCES).where("value > 0")
    blank = {c: F.lit("") for c in CAPACITY_KEYS if c not in ("cluster", "pool")}
    return out.unionByName(loose.withColumns(blank | {"cluster": F.lit("floating"), "total": F.col("value"), "farm": F.lit(0.0), "available": F.col("value")}).select(*keep))


def _phase() -> Column:
    return F.when(F.col("running"), "Running").when(F.col("pending"), "Pending").otherwise("Leased")


def on_nodes(nodes: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Active runs with the attributes of the node that they are on."""
    unit = F.coalesce("scalable_unit", F.lit("")) if "scalable_unit" in nodes.columns else F.lit("")
    attributes = nodes.select("node", F.col("executor").alias("cluster"), "node_type", "reservation", F.col("pool").alias("physical_pool"), unit.alias("scalable_unit"))
    return active_runs(jobs, runs).join(attributes, "node").withColumn("phase", _phase())


def leased_pod_counts(nodes: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs on nodes by cluster, pool, queue, phase and type (C4)."""
    return on_nodes(nodes, jobs, runs).groupBy("cluster", "pool", "queue", "phase", "node_type", "reservation").agg(F.count("*").alias("pods"))


def allocated_by_queue(nodes: DataFrame, jobs: DataFrame, runs: DataFrame, also_by: Sequence[str] = ()) -> DataFrame:
    """Resources of runs on nodes by queue, cluster, pool, class, band and type (C5), and by physical_pool and scalable_unit if wanted."""
    sums = on_nodes(nodes, jobs, runs).groupBy("queue", "cluster", "pool", "priority_class", "price_band", "node_type", "reservation", *also_by).agg(*[F.sum(c).alias(c) for c in RESOURCES])
    return as_rows(sums, RESOURCES)


def used_by_queue(usage: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reported usage (node, queue, resources) by queue, cluster, pool and type."""
    rows = usage.join(nodes.select("node", F.col("executor").alias("cluster"), "pool", "node_type"), "node")
    return as_rows(rows.groupBy("queue", "cluster", "pool", "node_type").agg(*[F.sum(c).alias(c) for c in RESOURCES]), RESOURCES)


def node_phase_counts(nodes: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Running and pending runs per node."""
    return on_nodes(nodes, jobs, runs).where("phase in ('Running', 'Pending')").groupBy("node", "cluster", "phase").agg(F.count("*").alias("jobs"))


def cordon_status(clusters: DataFrame, settings: DataFrame) -> DataFrame:
    """1 for cordoned clusters, 0 for others and those without a setting."""
    return clusters.join(settings.select("executor", F.col("cordoned").cast("int").alias("cordoned")), "executor", "left").select("executor", F.coalesce("cordoned", F.lit(0)).alias("cordoned"))


# state transitions


def with_prior_state(transitions: DataFrame, at: str = "at") -> DataFrame:
    """The state before a transition, and the seconds spent in it.

    The latest of queued, leased, pending and running times strictly before it; of equal ones the earlier state; queued
    since creation if none is.
    """
    diff = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) < F.col(at)), F.col(at) - F.col(c))
    options = [("queued", "submitted", 0), ("leased", "leased_at", 1), ("pending", "pending_at", 2), ("running", "running_at", 3)]
    best = F.array_min(F.filter(F.array(*[F.struct(diff(c).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("prior")) for name, c, k in options]), lambda s: s["d"].isNotNull()))
    rows = transitions.withColumn("_best", best)
    return rows.withColumns({"prior": F.coalesce("_best.prior", F.lit("queued")), "seconds": F.coalesce("_best.d", F.col(at) - F.col("submitted"))}).drop("_best")


def run_transitions(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run and state it reached, at its time, with the job's queue and resources."""
    states = F.array(
        F.struct(F.lit("leased").alias("state"), F.col("leased_at").alias("at")), F.struct(F.lit("pending").alias("state"), F.col("pending_at").alias("at")), F.struct(F.lit("running").alias("state"), F.col("running_at").alias("at")),
        F.struct(F.when(F.col("succeeded"), "succeeded").when(F.col("failed"), "failed").when(F.col("cancelled"), "cancelled").when(F.col("preempted"), "preempted").alias("state"), F.col("terminated_at").alias("at")),
    )
    rows = runs.join(jobs.select("job_id", "queue", "submitted", *RESOURCES), "job_id")
    rows = rows.select("job_id", "run_id", "queue", "pool", "node", F.col("executor").alias("cluster"), "submitted", "leased_at", "pending_at", "running_at", *RESOURCES, F.explode(states).alias("s")).select("*", "s.state", "s.at").drop("s")
    return rows.where("state is not null and at is not null")


def state_counters(transitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, seconds and resource-seconds by the given columns, state and prior state; durations of 0 or less are left out."""
    rows = with_prior_state(transitions).where("seconds > 0")
    return rows.groupBy(*by, "state", "prior").agg(F.count("*").alias("transitions"), F.sum("seconds").alias("seconds"), *[F.sum(F.col("seconds") * F.col(c) / (1000 if c == "cpu" else 1)).alias(f"{c}_seconds") for c in RESOURCES])


def run_durations(transitions: DataFrame) -> DataFrame:
    """Seconds of completed runs: from running, else pending, else leasing."""
    rows = transitions.where("state in ('succeeded', 'failed', 'cancelled', 'preempted')")
    return rows.withColumn("duration", F.col("at") - F.coalesce("running_at", "pending_at", "leased_at"))


def run_duration_histogram(transitions: DataFrame) -> DataFrame:
    """Cumulative buckets of completed runs' durations by queue and pool (T5)."""
    counted = run_durations(transitions).groupBy("queue", "pool").agg(F.count("*").alias("n"), *[F.count_if(F.col("duration") <= b).alias(f"b{b}") for b in RUN_BUCKETS])
    return counted.select("queue", "pool", "n", F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bound"), F.col(f"b{b}").alias("runs")) for b in RUN_BUCKETS])).alias("_x")).select("queue", "pool", "n", "_x.*")


def error_counts(failures: DataFrame, by: Sequence[str]) -> DataFrame:
    """Failed runs by the given columns and failure category."""
    return failures.groupBy(*by, "failure_category", "failure_subcategory").agg(F.count("*").alias("failures"))


def preemption_loss(transitions: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """Resource-seconds lost by preemption: all of a run without checkpoints ("none"), else what the last one missed."""
    rows = run_durations(transitions.where("state = 'preempted'")).where("duration > 0")
    lost = [F.struct(F.lit("none").alias("checkpoint"), F.col("duration").alias("lost"))] + [F.struct(F.lit(str(c)).alias("checkpoint"), F.least("duration", F.lit(c)).alias("lost")) for c in checkpoints]
    rows = rows.select("queue", "pool", *RESOURCES, F.explode(F.array(*lost)).alias("x")).select("*", "x.*").drop("x")
    return rows.groupBy("queue", "pool", "checkpoint").agg(*[F.sum(F.col("lost") * F.col(c) / (1000 if c == "cpu" else 1)).alias(f"lost_{c}") for c in RESOURCES])


def counts_by(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Plain counts: retry decisions (T8), scheduled and preempted jobs."""
    return df.groupBy(*by).agg(F.count("*").alias(name))


# pods


def node_availability(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """Requests of pods that haven't finished, and what they leave, per node."""
    used = pods.where("phase not in ('Succeeded', 'Failed')").groupBy("node").agg(*[F.sum(c).alias(f"_{c}") for c in RESOURCES])
    rows = nodes.join(used, "node", "left").withColumns({f"allocated_{c}": F.coalesce(f"_{c}", F.lit(0.0)) for c in RESOURCES})
    return rows.select("node", "unschedulable", *[f"allocated_{c}" for c in RESOURCES], *[(F.col(c) - F.col(f"allocated_{c}")).alias(f"available_{c}") for c in RESOURCES])


PHASES = ("Pending", "Running", "Succeeded", "Failed", "Unknown", "Leased")


def pod_phase_metrics(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pods and requests by queue, node type and phase, zero where a phase has none (X2); usage where pods have usage_ columns."""
    measures = [*RESOURCES, *[f"usage_{c}" for c in RESOURCES if f"usage_{c}" in pods.columns]]
    types = nodes.select("node", "node_type")
    kind = F.when(F.col("node").isNull(), "unassigned").otherwise(F.coalesce("node_type", F.lit("unknown")))
    rows = pods.join(types, "node", "left").withColumns({"node_type": kind, "phase": F.when(F.coalesce("phase", F.lit("")) == "", "Leased").otherwise(F.col("phase"))})
    sums = rows.groupBy("queue", "node_type", "phase").agg(F.count("*").alias("pods"), *[F.sum(c).alias(c) for c in measures])
    dense = sums.groupBy("queue", "node_type").agg(F.map_from_entries(F.collect_list(F.struct("phase", F.struct("pods", *measures)))).alias("m"))
    each = dense.select("queue", "node_type", "m", F.explode(F.array(*map(F.lit, PHASES))).alias("phase"))
    got = F.try_element_at("m", F.col("phase"))
    return each.select("queue", "node_type", "phase", F.coalesce(got["pods"], F.lit(0)).alias("pods"), *[F.coalesce(got[c], F.lit(0.0)).alias(c) for c in measures])


def node_group_capacity(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """Per node type and resource: total, allocatable (without running unmanaged pods), and in use on cordoned nodes."""
    sums = [F.sum(F.when(~F.col("managed"), F.col(c)).otherwise(0.0)).alias(f"_other_{c}") for c in RESOURCES] + [F.sum(c).alias(f"_all_{c}") for c in RESOURCES]
    rows = nodes.join(pods.where("phase = 'Running'").groupBy("node").agg(*sums), "node", "left")
    out = []
    for c in RESOURCES:
        left, used = F.col(c) - F.coalesce(f"_other_{c}", F.lit(0.0)), F.coalesce(f"_all_{c}", F.lit(0.0))
        out += [F.sum(c).alias(f"total_{c}"), F.sum(F.when(F.col("unschedulable"), 0.0).otherwise(left)).alias(f"allocatable_{c}"), F.sum(F.when(F.col("unschedulable"), used).otherwise(0.0)).alias(f"cordoned_{c}")]
    return rows.groupBy("node_type").agg(*out)


def usage_by_queue_pool(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requests per node, queue and pool; a pod without pool counts for its node's."""
    rows = pods.join(nodes.select("node", F.col("pool").alias("_pool")), "node").withColumn("pool", F.coalesce("pod_pool", "_pool"))
    return rows.groupBy("node", "queue", "pool").agg(*[F.sum(c).alias(c) for c in RESOURCES])


def unmanaged_by_priority(pods: DataFrame, nodes: DataFrame, minimum: Mapping[str, float], priority: int) -> DataFrame:
    """Requests of unmanaged pods per node and priority, topped up at one priority to a least sum of each resource per node."""
    used = pods.where("not managed and phase not in ('Succeeded', 'Failed')").groupBy("node", F.coalesce("priority", F.lit(0)).alias("priority")).agg(*[F.sum(c).alias(c) for c in RESOURCES])
    total = used.groupBy("node").agg(*[F.sum(c).alias(f"_{c}") for c in RESOURCES])
    lack = lambda c: F.greatest(F.lit(float(minimum.get(c, 0.0))) - F.coalesce(f"_{c}", F.lit(0.0)), F.lit(0.0))
    top = nodes.select("node").join(total, "node", "left").select("node", F.lit(priority).cast("long").alias("priority"), *[lack(c).alias(c) for c in RESOURCES])
    return used.unionByName(top.where(" or ".join(f"{c} > 0" for c in RESOURCES))).groupBy("node", "priority").agg(*[F.sum(c).alias(c) for c in RESOURCES])


def aggregate_samples(samples: DataFrame, specs: DataFrame) -> DataFrame:
    """Samples per metric and pod by sum or mean, times a multiplier if that is positive."""
    rows = samples.groupBy("metric", "pod").agg(F.sum("value").alias("_sum"), F.avg("value").alias("_mean")).join(specs, "metric")
    value = F.when(F.col("aggregation") == "sum", F.col("_sum")).otherwise(F.col("_mean"))
    return rows.select("metric", "pod", (value * F.when(F.col("multiplier") > 0, F.col("multiplier")).otherwise(1.0)).alias("value"))


def utilisation_rollup(samples: DataFrame, period: int) -> DataFrame:
    """Greatest and mean of current values and greatest cumulative value per run and period."""
    start = F.col("at") - F.col("at") % period
    return samples.groupBy("run_id", start.alias("period"), "resource").agg(F.max("current").alias("max_current"), F.avg("current").alias("avg_current"), F.max("cumulative").alias("max_cumulative"))


# streams


def stream_stats(entries: DataFrame, now: int) -> DataFrame:
    """Events, bytes and age per stream key ``Events:{queue}:{jobset}``."""
    key = r"^Events:([^:]*):(.*)$"
    rows = entries.select(F.regexp_extract("key", key, 1).alias("queue"), F.regexp_extract("key", key, 2).alias("jobset"), "bytes", "at")
    return rows.groupBy("queue", "jobset").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.greatest(F.lit(0), F.lit(now) - F.min("at")).cast("long").alias("age"))


def top_streams(stats: DataFrame, n: int) -> DataFrame:
    """The n largest streams by bytes, by events and by age (R2)."""
    tops = [stats.orderBy(F.desc(by), "queue", "jobset").limit(n).withColumn("ranked_by", F.lit(by)) for by in ("bytes", "events", "age")]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


def stream_histograms(stats: DataFrame) -> DataFrame:
    """Cumulative buckets of bytes, events and age over all streams."""
    bounds = [("bytes", 1024 * 2**i) for i in range(30)] + [("events", 10 * 2**i) for i in range(30)] + [("age", 60 * 2**i) for i in range(25)]
    counted = stats.agg(*[F.count_if(F.col(c) <= b).alias(f"{c}_{b}") for c, b in bounds])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(b).cast("long").alias("bound"), F.col(f"{c}_{b}").alias("streams")) for c, b in bounds])).alias("x")).select("x.*")


def queue_stream_totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("queue").agg(F.count("*").alias("streams"), F.sum("bytes").alias("bytes"), F.sum("events").alias("events"))


def latency_percentiles(df: DataFrame, value: str, base: float, by: Sequence[str], percents: Sequence[int] = (50, 95, 99)) -> DataFrame:
    """Percentiles by linear interpolation inside doubling buckets, the last one capped at the maximum."""
    k = F.when(F.col(value) < base, 0).otherwise(F.floor(F.log2(F.col(value) / base)) + 1).cast("long")
    counts = df.groupBy(*by, k.alias("k")).agg(F.count("*").alias("n"), F.max(value).alias("top"))
    w = Window.partitionBy(*by)
    upto = w.orderBy("k")
    rows = counts.withColumns({"total": F.sum("n").over(w), "cum": F.sum("n").over(upto), "most": F.max("top").over(w)})
    low, high = F.when(F.col("k") == 0, 0.0).otherwise(F.lit(base) * F.pow(F.lit(2.0), F.col("k") - 1)), F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("k")), F.col("most"))
    rank = lambda p: F.col("total") * (p / 100)
    inside = lambda p: F.when((F.col("cum") >= rank(p)) & (F.col("cum") - F.col("n") < rank(p)), low + (high - low) * (rank(p) - (F.col("cum") - F.col("n"))) / F.col("n"))
    return rows.groupBy(*by).agg(*[F.max(inside(p)).alias(f"p{p}") for p in percents])
