"""Folding the event log into job and job-run tables.

The log is flat: one row per event with its place ``seq`` in log order, which alone decides between events. Updates are
accepted up to the first terminal state of a job, and after it only a preemption of a job that ended otherwise. An update
may stand before the create of its job; it counts as soon as the job is there. Stored as reduced rows (``reduce_log``), of
which there are a few per key, the fold of a log doesn't depend on how it was cut into batches, as long as these follow
each other in log order. ``fold_log`` with given tables updates known keys only, as the platform's own tables do.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.ordering import with_position, with_running_sum
from jobloom.sources.model import TERMINAL_STATES
from jobloom.sources.tables import materialise

PREEMPTED, REJECTED = 7, 9
#: Terminal states that a later preemption replaces.
PREEMPT_OVERRIDES = (4, 5, 6)
#: Characters of an external URI that are stored.
LONGEST_URI = 1024
JOB_COLUMNS = ("priority", "state", "cancelled", "last_transition_time", "latest_run_id", "cancel_reason", "cancel_user")
RUN_COLUMNS = ("pending", "started", "finished", "job_run_state", "node", "exit_code", "error", "debug", "termination_reason")


def last_value(column: str, order: str = "seq", accepted: Column | None = None) -> Column:
    """The last non-null value in log order, of accepted rows only."""
    keep = F.col(column).isNotNull() if accepted is None else F.col(column).isNotNull() & accepted
    return F.max_by(F.col(column), F.when(keep, F.col(order)))


def first_rows(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The first row of each key, by aggregation: rows of a hot key are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def submitted_jobs(events: DataFrame) -> DataFrame:
    """Each submission as a queued job.

    Where events have ``external_job_uri`` or ``uri_annotation``, the first comes before the second, and empty ones are none.
    """
    given = [F.when(F.col(c) != "", F.substring(c, 1, LONGEST_URI)) for c in ("external_job_uri", "uri_annotation") if c in events.columns]
    uri = [F.coalesce(*given).alias("external_job_uri")] if given else []
    return events.where("kind = 'SubmitJob'").select(*uri, "job_id", "queue", "jobset", F.col("user").alias("owner"), "priority", F.col("created").alias("submitted"), F.lit(1).cast("short").alias("state"), F.col("created").alias("last_transition_time"), "seq")


def create_jobs(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One queued job per submitted job_id; the first write wins, known jobs are ignored."""
    new = first_rows(submitted_jobs(events), "job_id")
    return new.join(existing.select("job_id"), "job_id", "left_anti") if existing is not None else new


def job_updates(events: DataFrame) -> DataFrame:
    """Events as column updates of jobs; columns that an event doesn't touch are null."""
    kind = F.col("kind")
    error = F.when(F.col("error_kind") == "JobRunPreemptedError", PREEMPTED).when(F.col("error_kind") == "JobRejected", REJECTED).otherwise(5)
    fatal = (kind == "JobErrors") & F.col("terminal")
    state = (
        F.when(kind == "CancelledJob", 6).when(kind == "JobSucceeded", 4).when(fatal, error).when(kind == "JobRunRunning", 3).when(kind == "JobRequeued", 1).when(kind == "JobRunLeased", 8).when(kind == "JobRunAssigned", 2).when(kind == "JobRunPreempted", PREEMPTED)
    )
    rows = events.withColumn("_state", state.cast("short")).where(F.col("_state").isNotNull() | (kind == "ReprioritisedJob"))
    cancelled = kind == "CancelledJob"
    return rows.select(
        "job_id", "seq", F.when(kind == "ReprioritisedJob", F.col("priority")).alias("priority"), F.col("_state").alias("state"), F.when(cancelled, F.col("created")).alias("cancelled"), F.when(F.col("_state").isNotNull(), F.col("created")).alias("last_transition_time"),
        F.when(kind.isin("JobRunRunning", "JobRunLeased", "JobRunAssigned"), F.col("run_id")).alias("latest_run_id"), F.when(cancelled, F.col("reason")).alias("cancel_reason"), F.when(cancelled, F.coalesce("requestor", "user")).alias("cancel_user"),
    )


def accepted_updates(updates: DataFrame, preempt_overrides: Iterable[int] = PREEMPT_OVERRIDES) -> DataFrame:
    """Updates up to each job's first terminal state, and after it the first preemption if that state gives way."""
    terminal = F.col("state").isin(*TERMINAL_STATES)
    # of reduced rows only those of a single event can come after the end
    preempted = (F.col("state") == PREEMPTED) & (F.col("single") if "single" in updates.columns else F.lit(True))
    ends = updates.where(terminal).groupBy("job_id").agg(F.min("seq").alias("_end"), F.min_by("state", "seq").alias("_final"), F.min(F.when(preempted, F.col("seq"))).alias("_preempted"))
    rows = updates.join(ends, "job_id", "left")
    late = preempted & (F.col("seq") == F.col("_preempted")) & F.col("_final").isin(*preempt_overrides)
    return rows.where(F.col("_end").isNull() | (F.col("seq") <= F.col("_end")) | late).drop("_end", "_final", "_preempted")


def conflate_job_updates(updates: DataFrame, preempt_overrides: Iterable[int] = PREEMPT_OVERRIDES) -> DataFrame:
    """One row per job: the last non-null value of each column among the accepted updates."""
    return accepted_updates(updates, preempt_overrides).groupBy("job_id").agg(*[last_value(c).alias(c) for c in JOB_COLUMNS])


def drop_updates_to_terminal(updates: DataFrame, job: DataFrame, preempt_overrides: Iterable[int] = PREEMPT_OVERRIDES) -> DataFrame:
    """Without updates to stored terminal jobs, save preemptions of those that give way (I4)."""
    stored = job.where(F.col("state").isin(*TERMINAL_STATES)).select("job_id", F.col("state").alias("_stored"))
    rows = updates.join(stored, "job_id", "left")
    gives_way = F.col("_stored").isin(*preempt_overrides) & (F.col("state") == PREEMPTED)
    return rows.where(F.col("_stored").isNull() | F.coalesce(gives_way, F.lit(False))).drop("_stored")


def apply_updates(table: DataFrame, updates: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``table`` with the updates' non-null values; updates of unknown keys are ignored."""
    own = [c for c in columns if c in table.columns]
    new = updates.select(key, *[F.col(c).alias(f"_{c}") for c in own])
    return table.join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in own}).select(*table.columns)


def leased_runs(events: DataFrame) -> DataFrame:
    """Each lease as a run."""
    return events.where("kind = 'JobRunLeased'").select("run_id", "job_id", "cluster", "node", "pool", F.col("created").alias("leased"), F.lit(11).cast("short").alias("job_run_state"), "seq")


def create_runs(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One leased run per run_id; the first write wins."""
    new = first_rows(leased_runs(events), "run_id")
    return new.join(existing.select("run_id"), "run_id", "left_anti") if existing is not None else new


def run_updates(events: DataFrame) -> DataFrame:
    """Events as column updates of runs (I7), run errors classified by their kind (I8).

    Events of stand-alone ingress have ``addresses`` (port to address) and those of terminated pods ``debug_info``, where the
    log has these columns; they change nothing else.
    """
    kind, error = F.col("kind"), F.col("error_kind")
    failed = (kind == "JobRunErrors") & (error != "JobRunPreemptedError")
    error_state = F.when(error == "LeaseReturned", 8).when(error == "LeaseExpired", 9).otherwise(4)
    state = F.when(kind == "JobRunAssigned", 1).when(kind == "JobRunRunning", 2).when(kind == "JobRunSucceeded", 3).when(kind == "CancelledJob", 12).when(kind == "JobRunPreempted", 6).when(failed, error_state)
    ended = kind.isin("JobRunSucceeded", "CancelledJob", "JobRunPreempted") | (failed & F.col("terminal"))
    message = F.when(kind == "JobRunPreempted", F.lit("preempted")).when(failed, F.when(error == "PodError", F.concat(F.lit("pod error on "), "node")).when(error == "LeaseExpired", "Lease expired").when(error == "LeaseReturned", "Lease returned").otherwise("Unknown error"))
    addresses, info = "addresses" in events.columns, "debug_info" in events.columns
    extra = [F.when(kind == "StandaloneIngressInfo", F.col("addresses")).alias("ingress_addresses")] if addresses else []
    debug = F.when(failed & (error == "PodError"), F.concat(F.lit("debug of "), "run_id"))
    debug = F.when(kind == "JobRunTerminatedDebugInfo", F.col("debug_info")).otherwise(debug) if info else debug
    rows = events.withColumn("_state", state.cast("short")).where(F.col("_state").isNotNull() | kind.isin("StandaloneIngressInfo", "JobRunTerminatedDebugInfo"))
    return rows.select(
        *extra, "run_id", "seq", F.when(kind == "JobRunAssigned", F.col("created")).alias("pending"), F.when(kind == "JobRunRunning", F.col("created")).alias("started"), F.when(ended, F.col("created")).alias("finished"), F.col("_state").alias("job_run_state"),
        F.when(kind == "JobRunRunning", F.coalesce("node", F.lit("UNKNOWN"))).when(failed & (error == "PodError"), F.col("node")).alias("node"), F.when(kind == "JobRunSucceeded", 0).when(failed & (error == "PodError"), F.col("exit_code")).alias("exit_code"),
        message.alias("error"), debug.alias("debug"), F.when(kind == "JobRunPreempted", F.col("reason")).when(kind == "CancelledJob", F.coalesce("reason", F.lit("cancelled"))).alias("termination_reason"),
    )


def conflate_run_updates(updates: DataFrame) -> DataFrame:
    """One row per run: the last non-null value of each column."""
    return updates.groupBy("run_id").agg(*[last_value(c).alias(c) for c in _run_columns(updates)])


def _run_columns(updates: DataFrame) -> list[str]:
    return [*RUN_COLUMNS, *[c for c in ("ingress_addresses",) if c in updates.columns]]


def job_errors(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One error per rejected job, the first wins."""
    new = events.where("kind = 'JobErrors' and terminal and error_kind = 'JobRejected'").select("job_id", F.concat(F.lit("rejected: "), "reason").alias("error"), "seq")
    new = first_rows(new, "job_id").select("job_id", "error")
    return new.join(existing.select("job_id"), "job_id", "left_anti") if existing is not None else new


def state_update_counts(updates: DataFrame) -> DataFrame:
    return updates.where("state is not null").groupBy("state").agg(F.count("*").alias("updates"))


def rows_changed(events: DataFrame, jobs: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Rows inserted and updated by (table, operation) when the log is folded into the given tables."""
    open_updates = job_updates(events) if jobs is None else drop_updates_to_terminal(job_updates(events), jobs)
    parts = {}
    for table, created, stored, updated, key in (("job", create_jobs(events, jobs), jobs, conflate_job_updates(open_updates), "job_id"), ("job_run", create_runs(events, runs), runs, conflate_run_updates(run_updates(events)), "run_id")):
        known = created.select(key) if stored is None else created.select(key).unionByName(stored.select(key))
        parts |= {(table, "insert"): created.select(key), (table, "update"): updated.join(known, key, "left_semi")}
    parts["job_error", "insert"] = job_errors(events)
    counted = [df.agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), F.lit(operation).alias("operation"), "rows") for (table, operation), df in parts.items()]
    return reduce(DataFrame.unionByName, counted)


def event_counts(events: DataFrame) -> DataFrame:
    """Events and bytes by queue and kind."""
    return events.groupBy("queue", "kind").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))


def fold_log(events: DataFrame, jobs: DataFrame | None = None, runs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Job and run tables after the log, given those before it: creates before updates, jobs before runs."""
    def fresh(created: DataFrame, stored: DataFrame | None, columns: Sequence[str], kinds: dict[str, str]) -> DataFrame:
        added = created.drop("seq")
        added = added.withColumns({c: F.lit(None).cast(kinds[c]) for c in columns if c not in added.columns})
        return added if stored is None else stored.unionByName(added)

    updates, run_news = job_updates(events), run_updates(events)
    all_jobs = fresh(create_jobs(events, jobs), jobs, JOB_COLUMNS, dict(updates.dtypes))
    open_updates = updates if jobs is None else drop_updates_to_terminal(updates, jobs)
    all_jobs = apply_updates(all_jobs, conflate_job_updates(open_updates), "job_id", JOB_COLUMNS)
    all_runs = fresh(create_runs(events, runs), runs, RUN_COLUMNS, dict(run_news.dtypes))
    return all_jobs, apply_updates(all_runs, conflate_run_updates(run_news), "run_id", RUN_COLUMNS)


def reduce_job_updates(updates: DataFrame) -> DataFrame:
    """At most two rows per job that say as much as all of ``updates``: what is accepted up to its first terminal state as one
    row, and its first preemption as a ``single`` one. Reducing reduced parts that follow each other is reducing all."""
    rows = updates if "single" in updates.columns else updates.withColumn("single", F.lit(True))
    end = rows.where(F.col("state").isin(*TERMINAL_STATES)).groupBy("job_id").agg(F.min("seq").alias("_end"))
    until = rows.join(end, "job_id", "left").where("_end is null or seq <= _end").groupBy("job_id").agg(F.max("seq").alias("seq"), *[last_value(c).alias(c) for c in JOB_COLUMNS])
    preempted = first_rows(rows.where(F.col("single") & (F.col("state") == PREEMPTED)).drop("single"), "job_id")
    return until.withColumn("single", F.lit(False)).unionByName(preempted.withColumn("single", F.lit(True)).select(*until.columns, "single"))


def reduce_run_updates(updates: DataFrame) -> DataFrame:
    """One row per run that says as much as all of ``updates``."""
    return updates.groupBy("run_id").agg(F.max("seq").alias("seq"), *[last_value(c).alias(c) for c in _run_columns(updates)])


def first_of(key: str):
    return lambda rows: first_rows(rows, key)


#: The reduced parts of a log, each with what reduces a union of such parts.
REDUCED = {"job_create": first_of("job_id"), "job_update": reduce_job_updates, "run_create": first_of("run_id"), "run_update": reduce_run_updates, "job_error": first_of("job_id")}


def first_errors(events: DataFrame) -> DataFrame:
    """The first error of each rejected job, with its place."""
    errors = events.where("kind = 'JobErrors' and terminal and error_kind = 'JobRejected'").select("job_id", F.concat(F.lit("rejected: "), "reason").alias("error"), "seq")
    return first_rows(errors, "job_id")


def reduce_log(events: DataFrame) -> dict[str, DataFrame]:
    """The log, or a part of it, as reduced rows."""
    return {
        "job_create": create_jobs(events), "job_update": reduce_job_updates(job_updates(events)), "run_create": create_runs(events), "run_update": reduce_run_updates(run_updates(events)),
        "job_error": first_errors(events),
    }


def _both(creates: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Creates (as ``c``) and updates (each column with an underscore) as one table."""
    create = F.struct(*[f for f in creates.columns if f != key]).alias("c")
    return creates.select(key, create).unionByName(updates.select(key, *[F.col(f).alias(f"_{f}") for f in updates.columns if f != key]), allowMissingColumns=True)


def _update(values: Sequence[str]) -> Column:
    """The last value of each column, with the place of the last update, or null without one."""
    last = [F.max("_seq").alias("seq"), *[F.max_by(F.col(f"_{f}"), F.when(F.col(f"_{f}").isNotNull(), F.col("_seq"))).alias(f) for f in values if f != "seq"]]
    return F.when(F.max("_seq").isNotNull(), F.struct(*last))


def job_says(events: DataFrame) -> DataFrame:
    """What events say on jobs, one row each: the first create (``c``), updates up to the first end (``u``), the first preemption (``p``).

    The reduced rows of ``reduce_log`` in two aggregations of one table, however many kinds of events there are.
    """
    both, values = _both(submitted_jobs(events), job_updates(events), "job_id"), ("seq", *JOB_COLUMNS)
    preempted = F.when(F.col("_state") == PREEMPTED, F.col("_seq"))
    told = both.groupBy("job_id").agg(
        F.min_by("c", "c.seq").alias("c"), F.min_by(F.struct(*[F.col(f"_{f}").alias(f) for f in values]), preempted).alias("p"), F.min(F.when(F.col("_state").isin(*TERMINAL_STATES), F.col("_seq"))).alias("_end")
    )
    open_ = both.where("_seq is not null").join(told.where("_end is not null").select("job_id", "_end"), "job_id", "left").where("_end is null or _seq <= _end")
    return told.drop("_end").join(open_.groupBy("job_id").agg(_update(values).alias("u")), "job_id", "left").select("job_id", "c", "u", "p")


def run_says(events: DataFrame) -> DataFrame:
    """What events say on runs, one row each: the first create (``c``) and all updates (``u``), in one aggregation."""
    updates = run_updates(events)
    return _both(leased_runs(events), updates, "run_id").groupBy("run_id").agg(F.min_by("c", "c.seq").alias("c"), _update(("seq", *_run_columns(updates))).alias("u"))


def tables_of(reduced: dict[str, DataFrame], preempt_overrides: Iterable[int] = PREEMPT_OVERRIDES) -> dict[str, DataFrame]:
    """job, job_run and job_error from reduced parts of a log, however many."""
    created = first_rows(reduced["job_create"], "job_id")
    jobs = created.select(*[c for c in created.columns if c not in ("seq", "state", "priority", "last_transition_time")], F.col("priority").alias("_priority"))
    jobs = jobs.join(conflate_job_updates(reduced["job_update"], preempt_overrides), "job_id", "left").withColumns({
        "priority": F.coalesce("priority", "_priority"), "state": F.coalesce("state", F.lit(1).cast("short")), "last_transition_time": F.coalesce("last_transition_time", "submitted"),
    }).drop("_priority")
    leased = first_rows(reduced["run_create"], "run_id").drop("seq", "job_run_state").withColumnRenamed("node", "_node")
    runs = leased.join(conflate_run_updates(reduced["run_update"]), "run_id", "left").withColumns({"node": F.coalesce("node", "_node"), "job_run_state": F.coalesce("job_run_state", F.lit(11).cast("short"))}).drop("_node")
    return {"job": jobs, "job_run": runs, "job_error": first_rows(reduced["job_error"], "job_id").drop("seq")}


def upsert(target: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins by key; rows of ``target`` come before those of ``source``."""
    rest = [c for c in target.columns if c != key]
    both = target.withColumn("_w", F.lit(0)).unionByName(source.withColumn("_w", F.lit(1)))
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_w", order)).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def apply_versioned(target: DataFrame, updates: DataFrame, key: str, value: str, version: str, order: str = "seq") -> DataFrame:
    """The greatest pending version's value, where it is greater than the stored one; of equal ones the earlier."""
    best = updates.groupBy(key).agg(F.max_by(F.struct(F.col(value).alias("_value"), F.col(version).alias("_version")), F.struct(F.col(version), -F.col(order))).alias("_b"))
    newer = F.coalesce(F.col("_b._version") > F.col(version), F.lit(False))
    rows = target.join(best, key, "left")
    return rows.withColumns({value: F.when(newer, F.col("_b._value")).otherwise(F.col(value)), version: F.when(newer, F.col("_b._version")).otherwise(F.col(version))}).select(*target.columns)


def fold_scheduler_flags(events: DataFrame, validated: str = "JobValidated") -> tuple[DataFrame, DataFrame]:
    """Flags per job and per run with their times.

    ``validated`` is the kind that marks a job so. Where the log has ``pools``, a job takes those of its last validation;
    where it has ``run_attempted``, a run whose lease was returned tells whether it was tried.
    """
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    at = lambda cond: F.max_by(F.col("created"), F.when(cond, F.col("seq")))
    fatal = (F.col("kind") == "JobErrors") & F.col("terminal")
    pools = [F.max_by("pools", F.when(is_(validated) & F.col("pools").isNotNull(), F.col("seq"))).alias("pools")] if "pools" in events.columns else []
    jobs = events.groupBy("job_id").agg(F.bool_or(is_("CancelledJob")).alias("cancelled"), F.bool_or(is_("JobSucceeded")).alias("succeeded"), F.bool_or(fatal).alias("failed"), F.bool_or(is_(validated)).alias("validated"), *pools)
    run_failed = (F.col("kind") == "JobRunErrors") & F.col("terminal")
    returned = run_failed & (F.col("error_kind") == "LeaseReturned")
    ended = is_("CancelledJob", "JobRunSucceeded") | run_failed
    attempted = [F.bool_or(returned & F.col("run_attempted")).alias("run_attempted")] if "run_attempted" in events.columns else []
    runs = events.groupBy("run_id").agg(
        *attempted, F.bool_or(is_("JobRunAssigned")).alias("pending"), F.bool_or(is_("JobRunRunning")).alias("running"), F.bool_or(is_("JobRunSucceeded")).alias("succeeded"), F.bool_or(run_failed).alias("failed"), F.bool_or(returned).alias("returned"), F.bool_or(is_("JobRunPreempted")).alias("preempted"),
        at(is_("JobRunAssigned")).alias("pending_at"), at(is_("JobRunRunning")).alias("running_at"), at(ended).alias("terminated_at"), at(is_("JobRunPreempted")).alias("preempted_at"),
    )
    return jobs, runs


def apply_jobset_updates(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Reprioritise and cancel whole job sets, or lists of their jobs (I16).

    ``requests``: queue, job_set, seq, action ("reprioritise" or "cancel"), priority, user, reason, states ("queued",
    "leased" or null for both) and, if any request is a list, job_ids (null for a whole set). Ended jobs stay; of
    reprioritisations the last writes, of cancellations the first that has a user, and the first that has a reason.
    """
    ended = F.col("cancelled") | F.col("succeeded") | F.col("failed")
    kind = F.when(F.col("queued"), "queued").otherwise("leased")
    open_ = jobs.where(~ended).select("job_id", "queue", "job_set", kind.alias("_kind"))
    whole, lists = requests, None
    if "job_ids" in requests.columns:
        whole = requests.where("job_ids is null").drop("job_ids")
        lists = requests.where("job_ids is not null").withColumn("job_id", F.explode(F.array_distinct("job_ids"))).drop("job_ids")
    # requests of one set are reduced before they meet its jobs: the last priority, the first cancellations of each kind
    first = lambda c, cond: F.min_by(c, F.when(cond & F.col(c).isNotNull(), F.col("seq")))
    cancel = F.col("action") == "cancel"

    def reduced(rows: DataFrame, *by: str) -> DataFrame:
        out = [F.max_by(F.struct("priority", "user", "seq"), F.when(F.col("action") == "reprioritise", F.col("seq"))).alias("_p")]
        for name, states in (("queued", F.col("states").isNull() | (F.col("states") == "queued")), ("leased", F.col("states").isNull() | (F.col("states") == "leased"))):
            wanted = cancel & states
            who, why = (F.struct(F.min(F.when(wanted & F.col(c).isNotNull(), F.col("seq"))).alias("seq"), first(c, wanted).alias("value")).alias(c) for c in ("user", "reason"))
            out.append(F.struct(F.coalesce(F.bool_or(wanted), F.lit(False)).alias("hit"), who, why).alias(f"_{name}"))
        return rows.groupBy(*by).agg(*out)

    own = lambda: F.when(F.col("_kind") == "queued", F.col("_queued")).otherwise(F.col("_leased"))
    found = open_.join(reduced(whole, "queue", "job_set"), ["queue", "job_set"]).select("job_id", "_p", own().alias("_c"), F.lit(True).alias("_set"))
    if lists is not None:
        listed = open_.join(reduced(lists, "queue", "job_set", "job_id"), ["queue", "job_set", "job_id"]).select("job_id", "_p", own().alias("_c"), F.lit(False).alias("_set"))
        found = found.unionByName(listed)
    earliest = lambda c: F.min_by(f"_c.{c}.value", F.when(F.col(f"_c.{c}.value").isNotNull(), F.col(f"_c.{c}.seq")))
    best = found.groupBy("job_id").agg(
        F.max_by("_p", "_p.seq").alias("_p"), F.bool_or(F.col("_c.hit") & ~F.col("_set")).alias("_listed"), F.bool_or(F.col("_c.hit") & F.col("_set")).alias("_by_set"), earliest("user").alias("_user"), earliest("reason").alias("_reason"),
    )
    out = jobs.join(best, "job_id", "left")
    by_set, listed = (F.coalesce(c, F.lit(False)) for c in ("_by_set", "_listed"))
    return out.withColumns({
        "priority": F.coalesce("_p.priority", "priority"), "reprioritise_user": F.col("_p.user"), "cancel_requested": by_set | listed, "cancel_by_jobset_requested": by_set, "cancel_user": F.col("_user"), "cancel_reason": F.col("_reason"),
    }).drop("_p", "_listed", "_by_set", "_user", "_reason")


def apply_preempt_requests(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Runs with preempt_requested and the reason text; ended runs stay (I17). ``requests``: job_id, seq, user, reason."""
    ended = F.col("cancelled") | F.col("succeeded") | F.col("failed") | F.col("preempted")
    reason = F.when(F.col("user").isNotNull() & (F.col("user") != ""), F.concat(F.lit("Preempted by "), "user", F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" - "), "reason")).otherwise(""))).otherwise(F.col("reason"))
    first = requests.groupBy("job_id").agg(F.min_by(reason, "seq").alias("_why"))
    out = runs.join(first, "job_id", "left")
    hit = F.col("_why").isNotNull() & ~ended
    return out.withColumns({"preempt_requested": F.col("preempt_requested") | hit, "preempt_reason": F.when(hit, F.col("_why"))}).drop("_why")


_TRANSITIONS = ("queued", "leased", "pending", "running", "cancelled", "preempt_requested", "preempted", "failed", "succeeded")


def exclusive_terminal(runs: DataFrame) -> DataFrame:
    """At most one terminal flag: succeeded before failed before cancelled before preempted."""
    s, f, c, p = (F.col(x) for x in ("succeeded", "failed", "cancelled", "preempted"))
    return runs.withColumns({"failed": f & ~s, "cancelled": c & ~f & ~s, "preempted": p & ~c & ~f & ~s})


def state_transitions(old_jobs: DataFrame, old_runs: DataFrame, new_jobs: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Per job which flags became true between two snapshots, its runs' among them."""
    def rises(old: DataFrame, new: DataFrame, key: str, flags: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        before = old.select(key, *[F.col(c).alias(f"_{c}") for c in flags])
        rows = new.select(key, *keep, *flags).join(before, key, "left")
        return rows.select(key, *keep, *[(F.col(c) & ~F.coalesce(f"_{c}", F.lit(False))).alias(c) for c in flags])

    run_flags = ("leased", "pending", "running", "cancelled", "preempt_requested", "preempted", "failed", "succeeded")
    with_lease = lambda df: exclusive_terminal(df).withColumn("leased", F.col("leased_at").isNotNull())
    runs = rises(with_lease(old_runs), with_lease(new_runs), "run_id", run_flags, ("job_id",))
    own = runs.groupBy("job_id").agg(*[F.bool_or(c).alias(f"r_{c}") for c in run_flags])
    jobs = rises(old_jobs, new_jobs, "job_id", ("queued", "cancelled", "failed", "succeeded")).join(own, "job_id", "full_outer")
    both = lambda c: F.coalesce(F.col(c) if c in jobs.columns else F.lit(None), F.lit(False)) | F.coalesce(F.col(f"r_{c}") if f"r_{c}" in jobs.columns else F.lit(None), F.lit(False))
    return jobs.select("job_id", *[both(c).alias(c) for c in _TRANSITIONS])


def propagate_gang_preemption(transitions: DataFrame, jobs: DataFrame) -> DataFrame:
    """A preempt request on one member marks all jobs of its (queue, gang)."""
    gangs = jobs.where("gang_id is not null").select("job_id", "queue", "gang_id")
    hit = transitions.where("preempt_requested").join(gangs, "job_id").select("queue", "gang_id").distinct()
    members = gangs.join(hit, ["queue", "gang_id"], "left_semi").select("job_id", F.lit(True).alias("_gang"))
    rows = transitions.join(members, "job_id", "full_outer")
    return rows.select("job_id", *[F.coalesce(F.col(c) | F.col("_gang") if c == "preempt_requested" else F.col(c), F.col("_gang") if c == "preempt_requested" else F.lit(False), F.lit(False)).alias(c) for c in _TRANSITIONS])


def find_duplicates(submissions: DataFrame, dedup: DataFrame) -> DataFrame:
    """Each submission's original job: the stored one of its key, else the batch's first; no client id is never a duplicate."""
    keyed = submissions.withColumn("deduplication_id", F.when(F.coalesce("client_id", F.lit("")) != "", F.concat_ws(":", "queue", "client_id")))
    first = keyed.where("deduplication_id is not null").groupBy("deduplication_id").agg(F.min_by("job_id", "seq").alias("_first"))
    stored = dedup.select("deduplication_id", F.col("job_id").alias("_stored"))
    rows = keyed.join(first, "deduplication_id", "left").join(stored, "deduplication_id", "left")
    original = F.coalesce("_stored", "_first", "job_id")
    return rows.select("job_id", original.alias("original_job_id"), (original != F.col("job_id")).alias("is_duplicate"))


def _with_islands(seqs: DataFrame, value: str | None = None, running: str = "") -> DataFrame:
    """``seqs`` with ``island``, the running sum of ``_change``, and that of another column.

    Job sets may be of any length: the rows are dealt into ranges of the order, and a range only has to know the last row
    before it.
    """
    keys, group = ["queue", "jobset"], ["user", "groups"]
    placed = materialise(seqs.repartitionByRange(*keys, "seq").sortWithinPartitions(*keys, "seq").withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_id", 33))
    # one row per range: the last row of each, moved on to the next range that has rows
    lasts = placed.groupBy("_range").agg(F.max_by(F.struct(*keys, *group), "_id").alias("_last"))
    lasts = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))
    own = Window.partitionBy("_range").orderBy("_id")
    here, before = F.struct(*keys, *group), F.coalesce(F.lag(F.struct(*keys, *group)).over(own), F.col("_last"))
    rows = placed.join(F.broadcast(lasts), "_range").withColumn("_change", F.when(here.eqNullSafe(before), 0).otherwise(1))
    return with_running_sum(rows.drop("_id", "_range", "_last"), {"_change": "island"} | ({value: running} if value else {}), "seq", within=("queue", "jobset"))


def sequence_islands(seqs: DataFrame) -> DataFrame:
    """``seqs`` with ``island``, which counts the changes of user or groups within a job set up to each row."""
    return _with_islands(seqs).drop("_change")


def compact_sequences(seqs: DataFrame, most: int = 10_000) -> DataFrame:
    """Adjacent sequences of a job set with equal queue, user and groups become one, in order.

    A run of such sequences is written as pieces of about ``most`` events, so that no row and no task holds a whole run: a piece ends
    with the sequence that takes its job set's count over a multiple of ``most``, and one that ``continues`` goes on from the piece
    before it. ``island`` is the run's number within its job set.
    """
    counted = _with_islands(seqs.withColumn("_n", F.size("events").cast("long")), "_n", "_upto")
    piece = F.floor((F.col("_upto") - F.col("_n")) / most)
    events = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "events"))), lambda s: s["events"]))
    pieces = counted.groupBy("queue", "jobset", "island", piece.alias("_piece")).agg(F.min_by("user", "seq").alias("user"), F.min_by("groups", "seq").alias("groups"), F.min("seq").alias("seq"), (F.max("_change") == 0).alias("continues"), events.alias("events"))
    return pieces.drop("_piece")


def limit_by_count(seqs: DataFrame, most: int) -> DataFrame:
    """Sequences cut into parts of at most ``most`` events."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("events") / most).cast("int") - 1)), lambda k: F.slice("events", k * most + 1, F.lit(most)))
    return seqs.select(*[c for c in seqs.columns if c != "events"], F.posexplode(parts).alias("part", "events"))


def parts_by_count(events: DataFrame, most: int, key: Sequence[str], order: str = "seq") -> DataFrame:
    """Events with the part of their sequence that they fall into, ``most`` events each, for sequences of any length."""
    placed = with_position(events, *key, order, position="_place")
    # written first, so that adaptive execution can split the join where one sequence is very long
    first = materialise(placed.groupBy(*key).agg(F.min("_place").alias("_first")))
    return placed.join(first, list(key)).withColumn("part", F.floor((F.col("_place") - F.col("_first")) / most).cast("int")).drop("_place", "_first")


def _walk(sizes: Iterable[int], most: int, part: int = 0, filled: int = 0) -> tuple[list[int], int, int]:
    """The part of each event, the last part and its bytes, going on from a part that is filled already."""
    parts = []
    for n in sizes:
        if filled and filled + n > most:
            part, filled = part + 1, 0
        filled += n
        parts.append(part)
    return parts, part, filled


#: Rows of a cut function: where a fill makes the first cut (``end``), none filled yet, no cut at all.
_CUT, _EMPTY, _THROUGH = 0, 1, 2
_FUNCTION = ("end", "kind", "cuts", "fill")


class _CutFunction:
    """What a stretch of events makes of the part that it is handed, by how much of that is filled.

    From an empty part: ``empty`` (cuts, fill after). From a fill f the first cut falls at the first of ``ends`` above most - f, which
    gives ``values`` (cuts, fill after); above none of them everything still fits, and f grows by ``total``. A ``reset`` one gives
    ``empty`` whatever it is handed, with a part number of its own instead of cuts. Starts soon run into the same cuts, so ends with
    equal values are one.
    """

    def __init__(self, empty: tuple[int, int], ends: np.ndarray, values: np.ndarray, total: int, reset: bool = False):
        if len(ends):
            first = np.append(True, ends[1:] != ends[:-1])  # no fill lies between equal ends
            ends, values = ends[first], values[first]
            last = np.append((values[1:] != values[:-1]).any(axis=1), True)
            ends, values = ends[last], values[last]
        self.empty, self.ends, self.values, self.total, self.reset = empty, ends, values, total, reset

    @classmethod
    def of_sizes(cls, sizes: np.ndarray, most: int) -> _CutFunction:
        """The function of events of these sizes."""
        ends, m = np.cumsum(sizes), len(sizes)
        some = np.append(np.flatnonzero(sizes > 0), m)
        after, fill = np.zeros(m, np.int64), np.zeros(m, np.int64)  # cuts and fill from a part that begins at each event
        base = ends - sizes
        jump = np.maximum(np.searchsorted(ends, base + most, side="right"), some[np.searchsorted(some, np.arange(m))] + 1)
        for j in range(m - 1, -1, -1):
            if (k := jump[j]) >= m:
                fill[j] = ends[-1] - base[j]
            else:
                after[j], fill[j] = after[k] + 1, fill[k]
        n = min(int(np.searchsorted(ends, most, side="right")) + 1, m)  # later events can't be where the first cut falls
        return cls((int(after[0]), int(fill[0])), ends[:n], np.stack([after[:n] + 1, fill[:n]], 1), int(ends[-1]))

    def of(self, fills: np.ndarray, most: int) -> np.ndarray:
        """(cuts, fill after) for each fill."""
        if self.reset:
            return np.tile(self.empty, (len(fills), 1)).reshape(-1, 2)
        j = np.searchsorted(self.ends, most - fills, side="right")
        cut = np.vstack([self.values, [[0, 0]]])[j]
        cut[j == len(self.ends), 1] = (fills + self.total)[j == len(self.ends)]
        cut[fills == 0] = self.empty
        return cut

    def then(self, other: _CutFunction, most: int) -> _CutFunction:
        """This stretch and the one after it as one."""
        if other.reset:
            return other
        mine = np.vstack([[self.empty], self.values]).astype(np.int64)
        mine = np.stack([mine[:, 0], mine[:, 1]], 1)
        theirs = other.of(mine[:, 1], most)
        both = np.stack([mine[:, 0] + theirs[:, 0], theirs[:, 1]], 1)
        empty = int(both[0, 0]), int(both[0, 1])
        if self.reset:
            return _CutFunction(empty, self.ends[:0], both[:0], 0, True)
        later = other.ends + self.total
        n = min(int(np.searchsorted(later, most, side="right")) + 1, len(later))
        return _CutFunction(empty, np.append(self.ends, later[:n]), np.vstack([both[1:], other.values[:n]]), self.total + other.total)

    def rows(self) -> pd.DataFrame:
        parts = [(0, _EMPTY, *self.empty)] if self.reset else [(0, _EMPTY, *self.empty), (0, _THROUGH, 0, self.total)]
        out = pd.DataFrame(parts, columns=list(_FUNCTION))
        if not self.reset and len(self.ends):
            out = pd.concat([out, pd.DataFrame({"end": self.ends, "kind": _CUT, "cuts": self.values[:, 0], "fill": self.values[:, 1]})])
        return out.astype({"end": "int64", "kind": "int32", "cuts": "int64", "fill": "int64"}).assign(reset=self.reset)

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> _CutFunction:
        cut = rows[rows["kind"] == _CUT].sort_values("end")
        empty, through = rows[rows["kind"] == _EMPTY].iloc[0], rows[rows["kind"] == _THROUGH]
        return cls((int(empty["cuts"]), int(empty["fill"])), cut["end"].to_numpy(np.int64), cut[["cuts", "fill"]].to_numpy(np.int64).reshape(-1, 2), int(through["fill"].iloc[0]) if len(through) else 0, bool(empty["reset"]))


_FUNCTION_ROWS = "node long, end long, kind int, cuts long, fill long, reset boolean"


def _states_before(functions: DataFrame, most: int) -> DataFrame:
    """Rows (node, part, filled): what each stretch is handed by those before it, by a parallel prefix over their functions.

    Neighbours are composed to functions of twice the stretch until one is left, and on the way back the second of each pair gets
    what the first makes of the state before both. Every level is a table of half as many functions; the driver knows their number.
    """
    def pair(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = [_CutFunction.of_rows(g) for _, g in rows.groupby("node")]
        return reduce(lambda a, b: a.then(b, most), ordered).rows().assign(node=key[0])[["node", *_FUNCTION, "reset"]]

    n = functions.agg(F.max("node")).first()[0] or 0
    levels = [functions]
    while n > 1:
        n //= 2
        parents = levels[-1].withColumn("parent", F.floor(F.col("node") / 2)).groupBy("parent").applyInPandas(pair, _FUNCTION_ROWS)
        levels.append(materialise(parents))
    states = functions.sparkSession.createDataFrame([(0, 0, 0)], "node long, part long, filled long")
    for level in reversed(levels if n else []):
        first = states.withColumn("node", 2 * F.col("node"))
        fits = F.col("reset") | F.when(F.col("filled") == 0, F.col("kind") == _EMPTY).otherwise((F.col("kind") == _THROUGH) | ((F.col("kind") == _CUT) & (F.col("end") > most - F.col("filled"))))
        met = level.join(first, "node").where(fits & ~(F.col("reset") & (F.col("kind") != _EMPTY)))
        # the first end above; where there is none everything fits
        best = met.groupBy("node", "part", "filled").agg(F.min_by(F.struct("cuts", "fill", "kind", "reset"), F.struct("kind", "end")).alias("b"))
        second = best.select(F.col("node") + 1, F.when(F.col("b.reset"), F.col("b.cuts")).otherwise(F.col("part") + F.col("b.cuts")), F.when(F.col("b.kind") == _THROUGH, F.col("filled") + F.col("b.fill")).otherwise(F.col("b.fill")))
        states = materialise(first.select("node", "part", "filled").union(second))
    return states


def limit_by_bytes(events: DataFrame, most: int, key: Sequence[str], order: str = "seq", size: str = "bytes") -> DataFrame:
    """Events with the part of their sequence that they fall into: parts are filled greedily up to ``most`` bytes.

    An event larger than that is a part of its own. The greedy cut depends on all cuts before it, so a sequence, however long, is
    walked in ranges. Each range first tells what it makes of any fill that it may be handed, as rows of a table; a parallel prefix
    over these functions tells what it is handed indeed; and each range is walked from there. Nothing but the number of ranges
    comes to the driver.
    """
    named = events.withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    placed = materialise(named.repartitionByRange(*key, order).sortWithinPartitions(*key, order).withColumn("_range", F.spark_partition_id()))
    ranged = placed.repartition("_range").sortWithinPartitions("_range", *key, order)

    def pieces(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                change = (batch["_range"] != batch["_range"].shift()) | (batch["_key"] != batch["_key"].shift())
                yield from (g for _, g in batch.groupby(change.cumsum(), sort=False))

    def tell(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        """The function of each range's first sequence, and of its last one, if that is another, from its start."""
        def told() -> Iterable[pd.DataFrame]:
            sizes = (first, last) if last else (first,)
            for k, stretch in enumerate(sizes):
                yield _CutFunction.of_sizes(np.concatenate(stretch), most).rows().assign(range=place, first=names[0], last=names[1], own=k == 1)[["range", "first", "last", "own", *_FUNCTION]]

        place, names, first, last = None, ["", ""], [], []
        for piece in pieces(batches):
            r, k, sizes = int(piece["_range"].iloc[0]), piece["_key"].iloc[0], piece[size].to_numpy(np.int64)
            if r != place:
                if place is not None:
                    yield from told()
                place, names, first, last = r, [k, k], [sizes], []
            elif k == names[0]:
                first.append(sizes)
            else:
                last = [*last, sizes] if k == names[1] else [sizes]
                names[1] = k
        if place is not None:
            yield from told()

    table = materialise(ranged.select("_range", "_key", *key, order, size).mapInPandas(tell, "range int, first string, last string, own boolean, end long, kind int, cuts long, fill long"))
    # one row per range: its place among those that hold rows, and whether its first sequence goes on from the one before
    ends = table.groupBy("range").agg(F.min("first").alias("first"), F.min("last").alias("last"))
    by_range = Window.orderBy("range")
    ends = ends.select("range", (F.row_number().over(by_range) - 1).cast("long").alias("node"), F.coalesce(F.lag("last").over(by_range) == F.col("first"), F.lit(False)).alias("goes_on"), (F.col("first") != F.col("last")).alias("ends"))
    ends = materialise(ends)
    rows = table.join(F.broadcast(ends), "range")
    # where a sequence begins the state is that after it alone, whatever came before
    reset = F.col("ends") | ~F.col("goes_on")
    functions = rows.where(F.col("own") == F.col("ends")).where(~reset | (F.col("kind") == _EMPTY)).select("node", "end", "kind", "cuts", "fill", reset.alias("reset"))
    before = _states_before(materialise(functions), most).join(ends, "node").where("goes_on").select(F.col("range").alias("_range"), F.col("part").alias("_part"), F.col("filled").alias("_filled"))

    def walk(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        at, part, filled = None, 0, 0
        for piece in pieces(batches):
            r, k = int(piece["_range"].iloc[0]), piece["_key"].iloc[0]
            if at is None or at[0] != r:
                part, filled = int(piece["_part"].iloc[0]), int(piece["_filled"].iloc[0])
            elif at[1] != k:
                part, filled = 0, 0
            at = r, k
            parts, part, filled = _walk(piece[size].tolist(), most, part, filled)
            yield piece.assign(part=parts)[[f.name for f in schema]]

    schema = events.withColumn("part", F.lit(0).cast("long")).schema
    started = placed.join(F.broadcast(before), "_range", "left").withColumns({"_part": F.coalesce("_part", F.lit(0).cast("long")), "_filled": F.coalesce("_filled", F.lit(0).cast("long"))})
    return started.repartition("_range").sortWithinPartitions("_range", *key, order).mapInPandas(walk, schema)
