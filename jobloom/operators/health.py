"""Consistency, failure and health reports (H1-H9)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.operators.metrics import active_runs


def stale_executors(executors: DataFrame, now: int, timeout: int) -> DataFrame:
    return executors.where(F.col("last_updated") < now - timeout).select("executor", "last_updated")


def jobs_to_expire(jobs: DataFrame, runs: DataFrame, stale: DataFrame) -> DataFrame:
    """Active jobs on executors that stopped reporting (H1)."""
    return active_runs(jobs, runs).join(stale.select("executor"), "executor", "left_semi").select("job_id", "run_id", "executor", F.lit("internal").alias("category"), F.lit("lease expired").alias("reason"))


def lagging_executors(jobs: DataFrame, runs: DataFrame, reported: DataFrame, limit: int) -> DataFrame:
    """Executors with their leased jobs that they haven't reported, flagged above the limit (H2). ``reported``: run_id."""
    waiting = active_runs(jobs, runs).join(reported, "run_id", "left_anti")
    return waiting.groupBy("executor").agg(F.count("*").alias("unreported")).withColumn("lagging", F.col("unreported") > limit)


def reconcile_runs(jobs: DataFrame, runs: DataFrame, nodes: DataFrame, away: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """Active runs that no longer fit their node, with the reason (H3). ``away``: pool, away_pool.

    ``pools`` (pool, match, no_match) are the enabled ones, and whether their jobs have to match a node's reservation or
    must not; without it every pool is enabled and has to match. A job matches the reservations of its column
    ``reservations``; without that column high-priority jobs match all and others only nodes without one.
    """
    on = nodes.select("node", F.col("pool").alias("node_pool"), F.coalesce("reservation", F.lit("")).alias("reservation"))
    lent = away.select("pool", F.col("away_pool").alias("node_pool"), F.lit(True).alias("_away"))
    rows = active_runs(jobs, runs).join(on, "node", "left").join(lent, ["pool", "node_pool"], "left")
    if pools is None:
        rows = rows.withColumns({"match": F.lit(True), "no_match": F.lit(False)})
    else:
        rows = rows.join(pools, "pool")
    if "reservations" in jobs.columns:
        rows = rows.join(jobs.select("job_id", "reservations"), "job_id")
        matches = F.array_contains("reservations", F.col("reservation"))
    else:
        matches = (F.col("reservation") == "") | (F.col("priority_class") == "high")
    vanished = F.col("node_pool").isNull() & F.col("gang_id").isNotNull()
    there = F.col("node_pool").isNotNull()
    moved = there & (F.col("node_pool") != F.col("pool")) & F.col("_away").isNull()
    reason = F.when(vanished, F.lit("node of gang job no longer exists")).when(moved, F.concat(F.lit("node is now in pool "), "node_pool"))
    reason = reason.when(there & F.col("match") & ~matches, F.concat(F.lit("node is reserved for "), "reservation")).when(there & F.col("no_match") & matches, F.concat(F.lit("away on a node of its own reservation "), "reservation"))
    return rows.withColumn("reason", reason).where("reason is not null").select("job_id", "run_id", "node", "pool", "reason")


# fixed values: annotations that make a job a member of a gang
GANG_ID, GANG_CARDINALITY, GANG_UNIFORMITY = "gangId", "gangCardinality", "gangNodeUniformityLabel"


def gang_info(jobs: DataFrame, annotations: str = "annotations") -> DataFrame:
    """``jobs`` with gang_id, gang_cardinality, gang_uniformity and gang_error from annotations (H4).

    A cardinality of 1 is no gang. Where the annotations can't be read, gang_error tells why and the others are null.
    """
    get = lambda key: F.try_element_at(F.col(annotations), F.lit(key))
    name, size = get(GANG_ID), get(GANG_CARDINALITY)
    number = F.when(size.rlike("^[+-]?[0-9]+$"), size.try_cast("long"))
    error = F.when(name == "", "gang id is empty").when(size.isNull(), "gang cardinality is missing").when(number.isNull(), "gang cardinality is not a number").when(number <= 0, "gang cardinality is not positive")
    error = F.when(name.isNotNull(), error)
    gang = name.isNotNull() & error.isNull() & (number >= 2)
    return jobs.withColumns({"gang_error": error, "gang_id": F.when(gang, name), "gang_cardinality": F.when(gang, number), "gang_uniformity": F.when(gang, F.coalesce(get(GANG_UNIFORMITY), F.lit("")))})


def invalid_gangs(jobs: DataFrame) -> DataFrame:
    """Members of inconsistent gangs with the first failing reason (H4); a cardinality below 2 is no gang.

    Gang information is the cardinality and, where there is such a column, gang_uniformity.
    """
    members = jobs.where("gang_id is not null and gang_cardinality >= 2")
    info = F.struct("gang_cardinality", *[F.col(c) for c in ("gang_uniformity",) if c in jobs.columns])
    gangs = members.groupBy("queue", "gang_id").agg(F.bool_and("queued").alias("queued"), F.count_distinct("priority_class").alias("classes"), F.count_distinct(info).alias("infos"), F.max("gang_cardinality").alias("size"), F.count("*").alias("members"))
    reason = F.when(~F.col("queued"), "not all members are queued").when(F.col("classes") > 1, "members differ in priority class").when(F.col("infos") > 1, "members differ in gang information").when(F.col("members") > F.col("size"), "more members than the cardinality")
    bad = gangs.withColumn("reason", reason).where("reason is not null").select("queue", "gang_id", "reason")
    return members.join(bad, ["queue", "gang_id"]).select("queue", "gang_id", "job_id", "reason")


def retry_decisions(failed: DataFrame, policies: DataFrame, rules: DataFrame, global_max: int, default_policy: str | None = None) -> DataFrame:
    """Decision per failed run (H5).

    ``failed``: run_id, queue, policy, category, subcategory, failures, gang_id, returned, and fail_fast if any job is so.
    ``policies``: policy, retry_limit, default_action. ``rules``: policy, ordinal, on_category, on_subcategory (null for
    any), action. A queue without a policy takes ``default_policy``; without one, and for gangs, returned leases and
    fail-fast jobs, there is no decision. With a default policy, an unknown policy isn't decided either.
    """
    rows = failed.where("gang_id is null and not returned")
    if "fail_fast" in failed.columns:
        rows = rows.where("not coalesce(fail_fast, false)")
    if default_policy is not None:
        rows = rows.withColumn("policy", F.coalesce(F.when(F.col("policy") != "", F.col("policy")), F.lit(default_policy))).join(policies.select("policy"), "policy", "left_semi")
    rows = rows.withColumn("used", F.greatest(F.col("failures") - 1, F.lit(0)))
    fits = rows.select("run_id", "policy", "category", "subcategory").join(rules, "policy").where("on_category = category and (on_subcategory is null or on_subcategory = subcategory)")
    first = fits.groupBy("run_id").agg(F.min_by("action", "ordinal").alias("rule"))
    rows = rows.join(policies, "policy", "left").join(first, "run_id", "left")
    decision = (
        F.when(F.col("category").isNull(), "no_error").when((F.lit(global_max) == 0) | (F.col("used") >= global_max), "fail_global_limit").when(F.col("rule") == "Fail", "fail_rule")
        .when(F.col("rule").isNull() & (F.coalesce("default_action", F.lit("Fail")) == "Fail"), "fail_default").when(F.col("used") >= F.coalesce("retry_limit", F.lit(0)), "fail_policy_limit").otherwise("retry")
    )
    return rows.select("run_id", "queue", "policy", decision.alias("decision"))


def failure_counts(runs: DataFrame) -> DataFrame:
    """Failed runs per job that were neither preempted nor returned (H6)."""
    return runs.groupBy("job_id").agg(F.count_if(F.col("failed") & ~F.col("preempted") & ~F.col("returned")).alias("failures"))


@dataclass(frozen=True)
class Rule:
    """One failure category: all given matchers of the rule have to match (H7)."""

    category: str
    conditions: Sequence[str] = ()
    exit_codes: Sequence[int] = ()
    not_exit_codes: Sequence[int] = ()
    termination_message: str | None = None
    pod_error: str | None = None
    container: str | None = None
    event_type: str | None = None
    event_reason: str | None = None
    event_message: str | None = None


def _matches(rule: Rule) -> Column:
    def of_containers(test) -> Column:
        own = lambda c: (c["exit_code"] != 0) & test(c)
        return F.exists("containers", (lambda c: own(c) & (c["name"] == rule.container)) if rule.container else own)

    parts: list[Column] = []
    if rule.conditions:
        pod = [c for c in rule.conditions if c != "OOMKilled"]
        any_of = [F.col("pod_reason").isin(pod)] if pod else []
        any_of += [of_containers(lambda c: c["reason"] == "OOMKilled")] if "OOMKilled" in rule.conditions else []
        parts.append(any_of[0] if len(any_of) == 1 else any_of[0] | any_of[1])
    if rule.exit_codes:
        parts.append(of_containers(lambda c: c["exit_code"].isin(list(rule.exit_codes))))
    if rule.not_exit_codes:
        parts.append(of_containers(lambda c: ~c["exit_code"].isin(list(rule.not_exit_codes))))
    if rule.termination_message:
        parts.append(of_containers(lambda c: c["termination_message"].rlike(rule.termination_message)))
    if rule.pod_error:
        parts.append(F.col("pod_error").rlike(rule.pod_error))
    if rule.event_type:
        parts.append(F.exists("pod_events", lambda e: (e["type"] == rule.event_type) & (F.lit(True) if rule.event_reason is None else e["reason"] == rule.event_reason) & (F.lit(True) if rule.event_message is None else e["message"].rlike(rule.event_message))))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return F.coalesce(out, F.lit(False))


def categorise_failures(failed: DataFrame, rules: Sequence[Rule], default: str) -> DataFrame:
    """Category of each failed run: the first rule that matches, else the default (H7).

    ``failed``: run_id, pod_reason, pod_error, containers (name, exit_code, reason, termination_message), pod_events
    (type, reason, message). Only containers that ended with a code other than 0 are looked at.
    """
    out: Column = F.lit(default)
    for rule in reversed(rules):
        out = F.when(_matches(rule), rule.category).otherwise(out)
    return failed.select("run_id", out.alias("category"))


@dataclass(frozen=True)
class AuditConfig:
    classes: Sequence[str] = ("high", "low")
    bands: Sequence[str] = ()
    longest_id: int = 100
    oversubscription: Mapping[str, float] = field(default_factory=lambda: {"cpu": 1.0, "memory": 1.0})


def audit_submissions(subs: DataFrame, config: AuditConfig) -> DataFrame:
    """job_id and each rule that it violates (H8).

    ``subs``: job_id, queue, jobset, namespace, client_id, priority_class, price_band, and per resource request_ and limit_.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = {"missing queue": blank("queue"), "missing job set": blank("jobset"), "missing namespace": blank("namespace"), "client id too long": F.char_length(F.coalesce("client_id", F.lit(""))) > config.longest_id}
    tests["unknown priority class"] = F.col("priority_class").isNotNull() & ~F.col("priority_class").isin(list(config.classes))
    if config.bands:
        tests["unknown price band"] = F.col("price_band").isNotNull() & ~F.col("price_band").isin(list(config.bands))
    for r, ratio in config.oversubscription.items():
        request, limit = F.col(f"request_{r}"), F.col(f"limit_{r}")
        tests[f"{r} is missing"] = request.isNull() | limit.isNull()
        tests[f"{r} is negative"] = (request < 0) | (limit < 0)
        tests[f"{r} limit out of range"] = (limit < request) | (limit > request * ratio)
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in tests.items()]))
    return subs.select("job_id", F.explode(found).alias("rule"))


def processing_delay(messages: DataFrame, acked: DataFrame, now: int) -> DataFrame:
    """Age of the oldest message not yet acknowledged per partition, 0 where all are (H9).

    ``messages``: partition, seq, published; ``acked``: partition, seq up to which is done.
    """
    rows = messages.join(acked.select("partition", F.col("seq").alias("_done")), "partition", "left")
    open_ = F.when(F.col("_done").isNull() | (F.col("seq") > F.col("_done")), F.col("published"))
    return rows.groupBy("partition").agg(F.coalesce(F.greatest(F.lit(now) - F.min(open_), F.lit(0)), F.lit(0)).cast("long").alias("delay"))
