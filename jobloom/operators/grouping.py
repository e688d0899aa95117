"""Grouping of jobs with aggregates, orders and pages (Q12-Q18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.search import RUN_FIELDS, Filter, active_job_sets, condition, filter_jobs, page, state_ordinals, validate
from jobloom.sources.model import DISPLAY_ORDER, JOB_STATES

GROUPABLE = {"queue", "namespace", "jobset", "state"} | RUN_FIELDS


def agg_submitted() -> Column:
    return F.min("submitted").cast("long").alias("submitted")


def agg_last_transition(kind: str = "average") -> Column:
    """Greatest for "latest", least for "earliest", else the average in whole seconds (Q15)."""
    own = {"latest": F.max, "earliest": F.min}.get(kind, F.avg)
    return F.round(own("last_transition_time")).cast("long").alias("last_transition_time")


def state_counts(filters: Sequence[Filter] = ()) -> list[Column]:
    """A zero-filled count per state in display order, or of the states that a filter names (Q16)."""
    named = {s for f in filters if f.field == "state" and not f.annotation for s in ([f.value] if isinstance(f.value, str) else f.value)}
    state_ordinals(sorted(named))
    return [F.count_if(F.col("state") == JOB_STATES[s]).alias(s.lower()) for s in DISPLAY_ORDER if not named or s in named]


def group_jobs(job: DataFrame, field: str, filters: Sequence[Filter] = (), aggregates: Sequence[Column] = (), job_run: DataFrame | None = None, annotation: bool = False, active_only: bool = False, also_by: str | None = None) -> DataFrame:
    """Groups with ``count`` and the aggregates; ``also_by`` is a job column that groups too and stays as a column.

    By a job column (Q12); by cluster, node or pool of the latest run, where jobs without a run, or whose run misses a run
    filter, form the group with the empty name (Q13); or by an annotation's value, without jobs that lack it (Q14).
    """
    validate(filters)
    job = active_job_sets(job) if active_only else job
    own = [f for f in filters if f.annotation or f.field not in RUN_FIELDS]
    of_run = [f for f in filters if not f.annotation and f.field in RUN_FIELDS]
    rows = filter_jobs(job, own)
    more = [also_by] if also_by else []
    if annotation:
        rows = rows.where(F.map_contains_key("annotations", F.lit(field)))
        return rows.groupBy(F.element_at("annotations", F.lit(field)).alias("name"), *more).agg(F.count("*").alias("count"), *aggregates)
    if field not in GROUPABLE:
        raise ValueError(f"can't group by {field}")
    if of_run or field in RUN_FIELDS:
        if job_run is None:
            raise ValueError(f"runs are needed to group by {field}")
        runs = job_run
        for f in of_run:
            runs = runs.where(condition(f))
        runs = runs.select(F.col("run_id").alias("latest_run_id"), *sorted(RUN_FIELDS))
        rows = rows.join(runs, "latest_run_id", "left" if field in RUN_FIELDS else "inner")
    name = F.coalesce(F.col(field).cast("string"), F.lit("")) if field in RUN_FIELDS else F.col(field)
    return rows.groupBy(name.alias("name"), *more).agg(F.count("*").alias("count"), *aggregates)


def order_groups(groups: DataFrame, field: str = "count", descending: bool = True, skip: int = 0, take: int = 0) -> DataFrame:
    """By count, name or an aggregate, the name between equals; state counts don't order (Q17)."""
    if field.upper() in JOB_STATES or field not in groups.columns:
        raise ValueError(f"can't order groups by {field}")
    c = F.col(field)
    return page(groups.orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), F.col("name")), skip, take)


def ordered_groups(job: DataFrame, field: str, order: str = "count", descending: bool = True, skip: int = 0, take: int = 0, aggregates: Sequence[Column] = (), **options) -> DataFrame:
    """``group_jobs`` in order; a job column to order by that is neither grouped nor aggregated joins the grouping (Q17)."""
    groups = group_jobs(job, field, aggregates=aggregates, **options)
    if order == field:
        order = "name"
    elif order.upper() not in JOB_STATES and order not in groups.columns and order in job.columns:
        groups = group_jobs(job, field, aggregates=aggregates, also_by=order, **options)
    return order_groups(groups, order, descending, skip, take)


def job_set_overview(job: DataFrame, queue: str, active_only: bool = False) -> DataFrame:
    """Counts of six states and the first submission per job set of a queue (Q18)."""
    shown = [F.count_if(F.col("state") == JOB_STATES[s]).alias(s.lower()) for s in ("QUEUED", "PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")]
    return group_jobs(job, "jobset", [Filter("queue", "exact", queue)], [agg_submitted(), *shown], active_only=active_only)
