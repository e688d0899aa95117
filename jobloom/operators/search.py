"""Job search: filters, orders, pages, latest runs, nested runs and bulk lookups (Q1-Q11, Q19-Q22)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.sources.model import ACTIVE_STATES, JOB_STATES

# fixed values: which matches each field allows
_TEXT = {"exact", "startsWith", "contains"}
_NUMBER = {"exact", "greaterThan", "lessThan", "greaterThanOrEqualTo", "lessThanOrEqualTo"}
ALLOWED = {
    "job_id": {"exact"}, "queue": _TEXT | {"anyOf"}, "jobset": _TEXT, "owner": _TEXT, "namespace": _TEXT, "priority_class": _TEXT, "state": {"exact", "anyOf"}, "cpu": _NUMBER, "memory": _NUMBER,
    "ephemeral_storage": _NUMBER, "gpu": _NUMBER, "priority": _NUMBER, "submitted": _NUMBER - {"exact"}, "cluster": {"exact"}, "node": {"exact"}, "pool": {"exact", "anyOf"},
}
ANNOTATION_MATCHES = _TEXT | {"exists"}
RUN_FIELDS = {"cluster", "node", "pool"}
ORDERABLE = {"job_id", "jobset", "submitted", "last_transition_time", "queue", "state"}


@dataclass(frozen=True)
class Filter:
    field: str
    match: str
    value: Any = None
    annotation: bool = False


def validate(filters: Iterable[Filter]) -> None:
    """Raise ValueError for a field or match that isn't allowed (Q2)."""
    for f in filters:
        allowed = ANNOTATION_MATCHES if f.annotation else ALLOWED.get(f.field)
        if allowed is None:
            raise ValueError(f"unknown field {f.field}")
        if f.match not in allowed:
            raise ValueError(f"match {f.match} isn't supported for {f.field}")


def state_ordinals(names: str | Sequence[str]) -> list[int]:
    """Ordinals of state names (Q3); an unknown name is an error."""
    names = [names] if isinstance(names, str) else list(names)
    if unknown := [n for n in names if n not in JOB_STATES]:
        raise ValueError(f"unknown state {unknown[0]}")
    return [JOB_STATES[n] for n in names]


def condition(f: Filter) -> Column:
    """A filter as a column. ``%`` and ``_`` in texts act as wildcards, a backslash is itself (Q1, Q4)."""
    column, value = (F.element_at("annotations", F.lit(f.field)) if f.annotation else F.col(f.field)), f.value
    if f.field == "state" and not f.annotation:
        value = state_ordinals(value) if f.match == "anyOf" else state_ordinals(value)[0]
    escaped = value.replace("\\", "\\\\") if isinstance(value, str) else value
    if f.match == "exact":
        return column == value
    if f.match == "startsWith":
        return column.like(f"{escaped}%")
    if f.match == "contains":
        return column.like(f"%{escaped}%")
    if f.match == "anyOf":
        return column.isin(list(value))
    if f.match == "exists":
        return F.map_contains_key("annotations", F.lit(f.field))
    return {"greaterThan": column > value, "lessThan": column < value, "greaterThanOrEqualTo": column >= value, "lessThanOrEqualTo": column <= value}[f.match]


def filter_jobs(job: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Jobs that meet all filters on job columns and annotations."""
    validate(filters)
    return job.where(reduce(Column.__and__, map(condition, filters))) if filters else job


def filter_latest_run(job: DataFrame, job_run: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Jobs whose latest run meets the filters; earlier runs don't count (Q5)."""
    validate(filters)
    runs = job_run.where(reduce(Column.__and__, map(condition, filters))).select(F.col("run_id").alias("latest_run_id"))
    return job.join(runs, "latest_run_id", "left_semi")


def active_job_sets(job: DataFrame) -> DataFrame:
    """Jobs, terminal ones too, of those (queue, jobset) that have an active job (Q6)."""
    active = job.where(F.col("state").isin(*ACTIVE_STATES)).select("queue", "jobset").distinct()
    return job.join(active, ["queue", "jobset"], "left_semi")


def order_jobs(job: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Nulls last going up, first going down; job_id decides between equals (Q7)."""
    if field not in ORDERABLE:
        raise ValueError(f"can't order by {field}")
    c = F.col(field)
    return job.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col("job_id"))


def page(df: DataFrame, skip: int = 0, take: int = 0) -> DataFrame:
    """Rows after ``skip``; ``take`` 0 means all (Q8)."""
    df = df.offset(skip) if skip else df
    return df.limit(take) if take else df


def nest_runs(job: DataFrame, job_run: DataFrame) -> DataFrame:
    """Jobs with their runs as an array ordered by coalesce(leased, pending); none gives an empty array (Q9)."""
    own = job_run.join(job.select("job_id").distinct(), "job_id", "left_semi")
    run = F.struct(F.coalesce("leased", "pending").alias("at"), *[c for c in job_run.columns if c != "job_id"])
    runs = own.groupBy("job_id").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    kind = runs.schema["runs"].dataType.simpleString()
    return job.join(runs, "job_id", "left").withColumn("runs", F.coalesce("runs", F.array().cast(kind)))


def with_last_run(nested: DataFrame) -> DataFrame:
    """Node, cluster, pool and exit code of the last nested run (Q10)."""
    last = F.try_element_at("runs", F.lit(-1))
    return nested.withColumns({c: last[c] for c in ("node", "cluster", "pool", "exit_code")})


def runtime_seconds(started: Column, finished: Column, now: int) -> Column:
    """Whole seconds between start and end, or now while running; 0 if not started (Q11)."""
    return F.when(started.isNull(), 0).otherwise(F.round(F.coalesce(finished, F.lit(now)) - started)).cast("long")


def by_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is among ``ids`` (one column of any name); Spark broadcasts the ids where they are few (Q19)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def states_by_uri(job: DataFrame, queue: str, jobset: str, uri: str) -> DataFrame:
    return job.where((F.col("queue") == queue) & (F.col("jobset") == jobset) & (F.col("external_job_uri") == uri)).select("job_id", "state")


def job_details(job: DataFrame, spec: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs of the ids with their spec from the side table, else the inline one."""
    side = spec.select("job_id", F.col("job_spec").alias("_side"))
    return by_ids(job, "job_id", ids).join(side, "job_id", "left").withColumn("job_spec", F.coalesce("_side", "job_spec")).drop("_side")


def job_errors_for(job: DataFrame, job_run: DataFrame, job_error: DataFrame, ids: DataFrame) -> DataFrame:
    """job_id, error: of the side table, else of the latest run; without either no row (Q20)."""
    own = by_ids(job, "job_id", ids).select("job_id", "latest_run_id")
    run = job_run.select(F.col("run_id").alias("latest_run_id"), F.col("error").alias("run_error"))
    found = own.join(job_error.select("job_id", "error"), "job_id", "left").join(run, "latest_run_id", "left")
    return found.select("job_id", F.coalesce("error", "run_error").alias("error")).where("error is not null")


def run_column(job_run: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Error, debug message or termination reason of runs, where there is one (Q20)."""
    return by_ids(job_run, "run_id", ids).where(F.col(column).isNotNull()).select("run_id", column)


def active_queues_by_pool(job: DataFrame, job_run: DataFrame) -> DataFrame:
    """Distinct (pool, queue) of pending, running or leased jobs with such a run (Q21)."""
    jobs = job.where(F.col("state").isin(2, 3, 8)).select("job_id", "queue")
    runs = job_run.where(F.col("job_run_state").isin(1, 2, 11)).select("job_id", "pool")
    return jobs.join(runs, "job_id").select("pool", "queue").distinct()


def queue_retry_policies(attachments: DataFrame) -> DataFrame:
    """Policies of each queue in ordinal order; a repeated name keeps its first place (Q22)."""
    first = attachments.groupBy("queue", "policy").agg(F.min("ordinal").alias("ordinal"))
    return first.groupBy("queue").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "policy"))), lambda s: s["policy"]).alias("policies"))
