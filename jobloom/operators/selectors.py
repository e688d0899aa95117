"""Bulk selectors, change feeds and markers over scheduler tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.functions.ordering import with_running_sum

STATES = ("queued", "leased", "pending", "running")


def select_active_jobs(jobs: DataFrame, runs: DataFrame, executor: str | None = None, node: str | None = None, queues: Sequence[str] = (), pools: Sequence[str] = (), states: Sequence[str] = (), priority_classes: Sequence[str] = ()) -> DataFrame:
    """job_id, queue, job_set of jobs that haven't ended; empty lists mean all.

    A queued job is in any of its pools, an active one in its run's.
    """
    open_ = jobs.where("not (cancelled or succeeded or failed)").select("job_id", "queue", "job_set", "priority_class", "queued", "pools")
    open_ = open_.where(F.col("queue").isin(list(queues))) if queues else open_
    open_ = open_.where(F.col("priority_class").isin(list(priority_classes))) if priority_classes else open_
    active = runs.where("not (succeeded or failed or cancelled or preempted or returned)").select("job_id", "executor", "node", "pool", F.when(F.col("running"), "running").when(F.col("pending"), "pending").otherwise("leased").alias("state"))
    active = active.where(F.col("executor") == executor) if executor else active
    active = active.where(F.col("node") == node) if node else active
    active = active.where(F.col("pool").isin(list(pools))) if pools else active
    active = active.where(F.col("state").isin(list(states))) if states else active
    found = open_.where("not queued").join(active.select("job_id"), "job_id", "left_semi").select("job_id", "queue", "job_set")
    if executor or node or (states and "queued" not in states):
        return found
    waiting = open_.where("queued")
    waiting = waiting.where(F.arrays_overlap("pools", F.array(*map(F.lit, pools)))) if pools else waiting
    return found.unionByName(waiting.select("job_id", "queue", "job_set"))


def by_job_set(found: DataFrame, most: int = 10_000) -> DataFrame:
    """Job ids per job set in requests of at most ``most`` ids each, in the order of the ids."""
    counted = with_running_sum(found.withColumn("_one", F.lit(1).cast("long")), "_one", "job_id", running="_n", within=("queue", "job_set"))
    request = F.floor((F.col("_n") - 1) / most)
    return counted.groupBy("queue", "job_set", request.cast("int").alias("request")).agg(F.array_sort(F.collect_list("job_id")).alias("job_ids"))


def changes_since(df: DataFrame, serial: int, limit: int = 0) -> DataFrame:
    """Rows above a serial in its order, at most ``limit``."""
    rows = df.where(F.col("serial") > serial).orderBy("serial")
    return rows.limit(limit) if limit else rows


def initial_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("not (cancelled or succeeded or failed)")


def initial_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of the jobs of the initial load."""
    return runs.join(initial_jobs(jobs).select("job_id"), "job_id", "left_semi")


def marker_group_counts(markers: DataFrame, partitions: int) -> DataFrame:
    """Distinct partitions per marker group, and whether all have written theirs."""
    return markers.groupBy("group_id").agg(F.count_distinct("partition_id").alias("partitions")).withColumn("complete", F.col("partitions") == partitions)
