"""Queries of the search surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.jobs.registry import query
from jobloom.operators import grouping as g
from jobloom.operators import search as s
from jobloom.operators.search import Filter
from jobloom.sources import model as m
from jobloom.sources.model import DISPLAY_ORDER, JOB_STATES

BASE = ["job_id", "queue", "jobset", "owner", "cpu", "memory", "priority", "state", "submitted"]
_BASE = ", ".join(BASE)
_STATES = ", ".join(f"CAST(sum(CASE WHEN state = {JOB_STATES[x]} THEN 1 ELSE 0 END) AS BIGINT) AS {x.lower()}" for x in DISPLAY_ORDER)


_ASKED = "job_id IN (SELECT job_id FROM job_run WHERE job_run_state = 4)"


def asked(spark, d):
    """The ids that a user looks up: those of all jobs with a failed run."""
    return m.job_run(spark, d).where("job_run_state = 4").select("job_id")


@query("q1_filter_columns", f"SELECT {_BASE} FROM job WHERE queue LIKE 'queue-%' AND jobset LIKE '%s-1%' AND cpu >= 4000 AND cpu < 12000 AND priority > 1 AND memory <= 4294967296 AND owner LIKE 'user-1%'")
def q1(spark, d):
    filters = [Filter("queue", "startsWith", "queue-"), Filter("jobset", "contains", "s-1"), Filter("cpu", "greaterThanOrEqualTo", 4000), Filter("cpu", "lessThan", 12000), Filter("priority", "greaterThan", 1), Filter("memory", "lessThanOrEqualTo", 4 << 30), Filter("owner", "startsWith", "user-1")]
    return s.filter_jobs(m.job(spark, d, False), filters).select(*BASE)


@query("q1_filter_any_of", f"SELECT {_BASE} FROM job WHERE queue IN ('queue-1', 'queue-4') AND namespace LIKE 'ns_1%' AND gpu = 1")
def q1_any(spark, d):
    return s.filter_jobs(m.job(spark, d, False), [Filter("queue", "anyOf", ["queue-1", "queue-4"]), Filter("namespace", "startsWith", "ns_1"), Filter("gpu", "exact", 1)]).select(*BASE)


@query("q3_state_filter", f"SELECT {_BASE} FROM job WHERE state IN (8, 9)")
def q3(spark, d):
    return s.filter_jobs(m.job(spark, d, False), [Filter("state", "anyOf", ["LEASED", "REJECTED"])]).select(*BASE)


@query("q4_annotation_filters", f"SELECT {_BASE}, ticket FROM job WHERE ticket LIKE 'T1%' AND team LIKE '%m-1%' AND ticket IS NOT NULL")
def q4(spark, d):
    filters = [Filter("ticket", "startsWith", "T1", True), Filter("team", "contains", "m-1", True), Filter("ticket", "exists", None, True)]
    return s.filter_jobs(m.job(spark, d, False), filters).select(*BASE, F.element_at("annotations", "ticket").alias("ticket"))


@query("q5_latest_run_filter", f"SELECT {', '.join('job.' + c for c in BASE)} FROM job JOIN job_run ON run_id = latest_run_id WHERE job_run.cluster = 'cluster-2' AND job_run.pool IN ('pool-0', 'pool-1')")
def q5(spark, d):
    return s.filter_latest_run(m.job(spark, d), m.job_run(spark, d), [Filter("cluster", "exact", "cluster-2"), Filter("pool", "anyOf", ["pool-0", "pool-1"])]).select(*BASE)


@query("q6_active_job_sets", ", fin AS (SELECT *, CASE WHEN CAST(substr(jobset, 4) AS BIGINT) % 3 = 0 AND state IN (1, 2, 3, 8) THEN 4 ELSE state END AS st FROM job), act AS (SELECT DISTINCT queue, jobset FROM fin WHERE st IN (1, 2, 3, 8)) SELECT a.job_id, a.queue, a.jobset, a.st AS state FROM fin a JOIN act ON a.queue = act.queue AND a.jobset = act.jobset")
def q6(spark, d):
    """Every third job set is made to have ended."""
    ended = (F.substring("jobset", 4, 9).cast("long") % 3 == 0) & F.col("state").isin(1, 2, 3, 8)
    jobs = m.job(spark, d, False).withColumn("state", F.when(ended, 4).otherwise(F.col("state")))
    return s.active_job_sets(jobs).select("job_id", "queue", "jobset", F.col("state").cast("long").alias("state"))


@query("q7_q8_order_and_page", "SELECT job_id, namespace, jobset, state, last_transition_time FROM job ORDER BY last_transition_time DESC, job_id LIMIT 100 OFFSET 50")
def q7(spark, d):
    return s.page(s.order_jobs(m.job(spark, d, False), "last_transition_time", True), 50, 100).select("job_id", "namespace", "jobset", "state", "last_transition_time")


@query("q9_q10_nested_runs", ", r AS (SELECT job_id, run_id, node, cluster, pool, exit_code, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(leased, pending), run_id DESC) AS up, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(leased, pending) DESC, run_id DESC) AS down FROM job_run), c AS (SELECT job_id, count(*) AS runs, string_agg(run_id, ',' ORDER BY coalesce(leased, pending), run_id) AS run_ids FROM job_run GROUP BY job_id) SELECT job.job_id, CAST(coalesce(c.runs, 0) AS BIGINT) AS n_runs, coalesce(c.run_ids, '') AS run_ids, r.node, r.cluster, r.pool, r.exit_code FROM job LEFT JOIN c ON job.job_id = c.job_id LEFT JOIN r ON job.job_id = r.job_id AND r.down = 1 WHERE job.queue = 'queue-3'")
def q9(spark, d):
    # what is nested is shuffled whole, so runs come with what is asked of them only
    runs = m.job_run(spark, d).select("run_id", "job_id", "cluster", "node", "pool", "leased", "pending", "exit_code")
    jobs = s.filter_jobs(m.job(spark, d, False), [Filter("queue", "exact", "queue-3")]).select("job_id")
    nested = s.with_last_run(s.nest_runs(jobs, runs))
    return nested.select("job_id", F.size("runs").cast("long").alias("n_runs"), F.array_join(F.transform("runs", lambda r: r["run_id"]), ",").alias("run_ids"), "node", "cluster", "pool", "exit_code")


@query("q11_runtime_seconds", f"SELECT run_id, CASE WHEN started IS NULL THEN 0 ELSE coalesce(finished, {m.NOW}) - started END AS runtime FROM job_run")
def q11(spark, d):
    return m.job_run(spark, d).select("run_id", s.runtime_seconds(F.col("started"), F.col("finished"), m.NOW).alias("runtime"))


@query("q12_q15_q16_group_by_queue", f"SELECT queue AS name, count(*) AS count, min(submitted) AS submitted, CAST(round(avg(last_transition_time)) AS BIGINT) AS last_transition_time, {_STATES} FROM job GROUP BY queue")
def q12(spark, d):
    return g.group_jobs(m.job(spark, d, False), "queue", aggregates=[g.agg_submitted(), g.agg_last_transition(), *g.state_counts()])


@query("q12_group_by_namespace", f"SELECT namespace AS name, count(*) AS count, max(last_transition_time) AS last_transition_time, {_STATES} FROM job WHERE cpu > 5000 GROUP BY namespace")
def q12_namespace(spark, d):
    return g.group_jobs(m.job(spark, d, False), "namespace", [Filter("cpu", "greaterThan", 5000)], [g.agg_last_transition("latest"), *g.state_counts()])


@query("q12_group_by_state", "SELECT CAST(state AS BIGINT) AS name, count(*) AS count, min(last_transition_time) AS last_transition_time FROM job GROUP BY state")
def q12_state(spark, d):
    return g.group_jobs(m.job(spark, d, False), "state", aggregates=[g.agg_last_transition("earliest")]).withColumn("name", F.col("name").cast("long"))


@query("q13_group_by_run_column", ", r AS (SELECT run_id, cluster, pool FROM job_run WHERE pool = 'pool-1') SELECT coalesce(r.cluster, '') AS name, count(*) AS count, min(submitted) AS submitted FROM job LEFT JOIN r ON r.run_id = latest_run_id GROUP BY 1")
def q13(spark, d):
    return g.group_jobs(m.job(spark, d), "cluster", [Filter("pool", "exact", "pool-1")], [g.agg_submitted()], m.job_run(spark, d))


@query("q14_group_by_annotation", f"SELECT ticket AS name, count(*) AS count, {_STATES} FROM job WHERE ticket IS NOT NULL GROUP BY ticket")
def q14(spark, d):
    return g.group_jobs(m.job(spark, d, False), "ticket", aggregates=g.state_counts(), annotation=True)


@query("q16_state_filtered_counts", "SELECT jobset AS name, count(*) AS count, CAST(sum(CASE WHEN state = 1 THEN 1 ELSE 0 END) AS BIGINT) AS queued, CAST(sum(CASE WHEN state = 3 THEN 1 ELSE 0 END) AS BIGINT) AS running FROM job WHERE state IN (1, 3) GROUP BY jobset")
def q16(spark, d):
    f = [Filter("state", "anyOf", ["QUEUED", "RUNNING"])]
    return g.group_jobs(m.job(spark, d, False), "jobset", f, g.state_counts(f))


@query("q17_order_groups", "SELECT jobset AS name, count(*) AS count, min(submitted) AS submitted FROM job GROUP BY jobset ORDER BY submitted DESC, name LIMIT 20 OFFSET 5")
def q17(spark, d):
    return g.order_groups(g.group_jobs(m.job(spark, d, False), "jobset", aggregates=[g.agg_submitted()]), "submitted", True, 5, 20)


@query("q17_order_by_ungrouped", "SELECT jobset AS name, priority, count(*) AS count FROM job GROUP BY jobset, priority ORDER BY priority DESC, name LIMIT 30 OFFSET 5")
def q17_ungrouped(spark, d):
    return g.ordered_groups(m.job(spark, d, False), "jobset", "priority", True, 5, 30)


@query("q18_job_set_overview", ", act AS (SELECT DISTINCT queue, jobset FROM job WHERE state IN (1, 2, 3, 8)) SELECT job.jobset AS name, count(*) AS count, min(submitted) AS submitted, " + ", ".join(f"CAST(sum(CASE WHEN state = {JOB_STATES[x]} THEN 1 ELSE 0 END) AS BIGINT) AS {x.lower()}" for x in ("QUEUED", "PENDING", "RUNNING", "SUCCEEDED", "FAILED", "CANCELLED")) + " FROM job JOIN act ON job.queue = act.queue AND job.jobset = act.jobset WHERE job.queue = 'queue-2' GROUP BY job.jobset")
def q18(spark, d):
    return g.job_set_overview(m.job(spark, d, False), "queue-2", True)


@query("q19_job_states", "SELECT job_id, CAST(state AS INTEGER) AS state FROM job WHERE " + _ASKED)
def q19(spark, d):
    return s.by_ids(m.job(spark, d, False), "job_id", asked(spark, d)).select("job_id", F.col("state").cast("int").alias("state"))


@query("q19_runs_by_job_ids", "SELECT job_id, run_id, leased FROM job_run WHERE " + _ASKED + " ORDER BY leased DESC, run_id")
def q19_runs(spark, d):
    return s.by_ids(m.job_run(spark, d), "job_id", asked(spark, d)).select("job_id", "run_id", "leased").orderBy(F.desc("leased"), "run_id")


@query("q19_runs_by_run_ids", "SELECT job_run.job_id, run_id, node FROM job_run JOIN job ON run_id = latest_run_id WHERE job." + _ASKED)
def q19_by_run(spark, d):
    return s.by_ids(m.job_run(spark, d), "run_id", s.by_ids(m.job(spark, d), "job_id", asked(spark, d)).select("latest_run_id")).select("job_id", "run_id", "node")


@query("q19_states_by_uri", "SELECT job_id, CAST(state AS INTEGER) AS state FROM job WHERE queue = 'queue-3' AND jobset = 'js-49' AND external_job_uri = 'uri-0'")
def q19_uri(spark, d):
    return s.states_by_uri(m.job(spark, d, False), "queue-3", "js-49", "uri-0").withColumn("state", F.col("state").cast("int"))


@query("q19_job_details", "SELECT job_id, CASE WHEN CAST(substr(job_id, 5, 10) AS BIGINT) % 2 = 0 THEN 'side-' || owner ELSE 'inline-' || owner END AS job_spec FROM job WHERE " + _ASKED)
def q19_details(spark, d):
    job = m.job(spark, d, False).withColumn("job_spec", F.concat(F.lit("inline-"), "owner"))
    side = job.where(F.substring("job_id", 5, 10).cast("long") % 2 == 0).select("job_id", F.concat(F.lit("side-"), "owner").alias("job_spec"))
    return s.job_details(job, side, asked(spark, d)).select("job_id", "job_spec")


@query("q20_job_errors", ", e AS (SELECT job_id, 'rejected-' || owner AS error FROM job WHERE state = 9) SELECT job.job_id, coalesce(e.error, r.error) AS error FROM job LEFT JOIN e ON e.job_id = job.job_id LEFT JOIN job_run r ON r.run_id = latest_run_id WHERE coalesce(e.error, r.error) IS NOT NULL")
def q20(spark, d):
    job = m.job(spark, d)
    side = job.where("state = 9").select("job_id", F.concat(F.lit("rejected-"), "owner").alias("error"))
    return s.job_errors_for(job, m.job_run(spark, d), side, job.select("job_id"))


@query("q20_run_errors", "SELECT run_id, error, debug, termination_reason FROM (SELECT run_id, error, debug, termination_reason FROM job_run WHERE error IS NOT NULL) t")
def q20_run(spark, d):
    runs = m.job_run(spark, d)
    ids_ = runs.select("run_id")
    out = s.run_column(runs, ids_, "error")
    return out.join(s.run_column(runs, ids_, "debug"), "run_id", "left").join(s.run_column(runs, ids_, "termination_reason"), "run_id", "left")


@query("q21_active_queues_by_pool", "SELECT DISTINCT r.pool, j.queue FROM job j JOIN job_run r ON j.job_id = r.job_id WHERE j.state IN (2, 3, 8) AND r.job_run_state IN (1, 2, 11)")
def q21(spark, d):
    return s.active_queues_by_pool(m.job(spark, d, False), m.job_run(spark, d))


@query("q22_queue_retry_policies", ", a AS (SELECT queue, 'policy-' || (priority % 4) AS policy, min(CAST(substr(job_id, 5, 10) AS BIGINT) % 100) AS ordinal FROM job GROUP BY queue, 'policy-' || (priority % 4)) SELECT queue, string_agg(policy, ',' ORDER BY ordinal, policy) AS policies FROM a GROUP BY queue")
def q22(spark, d):
    job = m.job(spark, d, False)
    attached = job.select("queue", m.text("policy-", F.col("priority") % 4).alias("policy"), (F.substring("job_id", 5, 10).cast("long") % 100).alias("ordinal"))
    return s.queue_retry_policies(attached).withColumn("policies", F.array_join("policies", ","))
