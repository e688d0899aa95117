"""Queries of maintenance, health reports, normalisation and the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.functions import scalars
from jobloom.jobs.metric_queries import _ACT
from jobloom.jobs.registry import query
from jobloom.operators import events as e
from jobloom.operators import health as h
from jobloom.operators import maintain as p
from jobloom.operators import metrics as x
from jobloom.operators import selectors as sel
from jobloom.sources import job_tables
from jobloom.sources import model as m
from jobloom.sources.model import NOW
from jobloom.sources.tables import shared_folder

LIFETIME = 100_000_000
_GONE = f", gone AS (SELECT job_id FROM job WHERE state IN (4, 5, 6, 7, 9) AND last_transition_time < {NOW - LIFETIME})"


def _jr(spark, d):
    return m.scheduler_jobs(spark, d), m.scheduler_runs(spark, d)


def _short(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("state", "old_state", "new_state") if c in df.columns})


@query("p1_prune_jobs", _GONE + " SELECT job_id, state FROM job WHERE job_id NOT IN (SELECT job_id FROM gone)")
def p1(spark, d):
    return _short(p.prune_jobs({"job": m.job(spark, d, False)}, NOW, LIFETIME)["job"].select("job_id", "state"))


@query("p1_prune_runs", _GONE + " SELECT run_id FROM job_run LEFT JOIN gone ON gone.job_id = job_run.job_id WHERE gone.job_id IS NULL")
def p1_runs(spark, d):
    return p.prune_jobs({"job": m.job(spark, d, False), "job_run": m.job_run(spark, d)}, NOW, LIFETIME)["job_run"].select("run_id")


@query("p2_expire_dedup", f"SELECT queue || ':c' || CAST(priority AS VARCHAR) || owner AS deduplication_id, submitted AS inserted FROM job WHERE submitted > {NOW - LIFETIME}")
def p2(spark, d):
    dedup = m.job(spark, d, False).select(F.concat("queue", F.lit(":c"), F.col("priority").cast("string"), "owner").alias("deduplication_id"), F.col("submitted").alias("inserted"))
    return p.expire_dedup(dedup, NOW, LIFETIME)


_Z = f", z AS (SELECT job.job_id, queue, jobset, state AS old_state, CASE job_run_state WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 12 THEN 6 ELSE 7 END AS new_state, run_id, finished FROM job JOIN job_run ON run_id = latest_run_id WHERE state IN (1, 2, 3, 8) AND job_run_state IN (3, 4, 12, 6) AND finished < {NOW} - 3600)"


@query("p3_zombie_report", _Z + " SELECT * FROM z")
def p3(spark, d):
    return _short(p.repair_zombies(m.job(spark, d), m.job_run(spark, d), NOW, 3600)[1])


@query("p3_repaired_jobs", _Z + " SELECT job.job_id, coalesce(new_state, state) AS state, coalesce(finished, last_transition_time) AS last_transition_time FROM job LEFT JOIN z ON z.job_id = job.job_id")
def p3_jobs(spark, d):
    return _short(p.repair_zombies(m.job(spark, d), m.job_run(spark, d), NOW, 3600)[0].select("job_id", "state", "last_transition_time"))


@query("p4_unrepairable_zombies", "SELECT count(*) AS jobs FROM job JOIN job_run ON run_id = latest_run_id WHERE state IN (1, 2, 3, 8) AND job_run_state IN (3, 4, 12, 6) AND CASE WHEN CAST(substr(job.job_id, 5, 10) AS BIGINT) % 2 = 0 THEN NULL ELSE finished END IS NULL")
def p4(spark, d):
    runs = m.job_run(spark, d).withColumn("finished", F.when(F.substring("job_id", 5, 10).cast("long") % 2 != 0, F.col("finished")))
    return p.count_unrepairable_zombies(m.job(spark, d), runs)


@query("p5_prune_scheduler", f"SELECT srun.run_id FROM srun JOIN sjob ON sjob.job_id = srun.job_id WHERE NOT (submitted + 1000 < {NOW - LIFETIME} AND (sjob.succeeded OR sjob.failed OR sjob.cancelled))")
def p5(spark, d):
    jobs, runs = _jr(spark, d)
    return p.prune_scheduler(jobs.withColumn("last_modified", F.col("submitted") + 1000), {"runs": runs}, NOW, LIFETIME)["runs"].select("run_id")


_OLD = f", old AS (SELECT job_id FROM sjob WHERE submitted + 1000 < {NOW - LIFETIME} AND (succeeded OR failed OR cancelled))"


@query("p5_prune_scheduler_children", _OLD + ", ch AS (SELECT 'metadata' AS child, job_id, 'm-' || job_id AS id FROM sjob UNION ALL SELECT 'errors', job_id, 'e-' || run_id FROM srun WHERE failed) SELECT child, id FROM ch WHERE job_id NOT IN (SELECT job_id FROM old)")
def p5_children(spark, d):
    jobs, runs = _jr(spark, d)
    children = {"metadata": jobs.select("job_id", F.concat(F.lit("m-"), "job_id").alias("id")), "errors": runs.where("failed").select("job_id", F.concat(F.lit("e-"), "run_id").alias("id"))}
    kept = p.prune_scheduler(jobs.withColumn("last_modified", F.col("submitted") + 1000), children, NOW, LIFETIME)
    return kept["metadata"].select(F.lit("metadata").alias("child"), "id").unionByName(kept["errors"].select(F.lit("errors").alias("child"), "id"))


@query("p5_prune_markers", "SELECT seq FROM job_event WHERE created >= 1706000000 - 3600")
def p5_markers(spark, d):
    return p.prune_markers(m.job_event(spark, d).select("seq", "created"), 1_706_000_000, 3600).select("seq")


@query("p6_move_terminal", ", u AS (SELECT job_id, 6 AS st, CASE WHEN CAST(substr(job_id, 5, 10) AS BIGINT) % 4 = 0 THEN 'moved' END AS r FROM job WHERE CAST(substr(job_id, 5, 10) AS BIGINT) % 2 = 0) SELECT job.job_id, coalesce(st, state) AS state, coalesce(r, cancel_reason) AS cancel_reason FROM job LEFT JOIN u ON u.job_id = job.job_id")
def p6(spark, d):
    job, k = m.job(spark, d, False), F.substring("job_id", 5, 10).cast("long")
    updates = job.where(k % 2 == 0).select("job_id", F.lit(6).cast("short").alias("state"), F.when(k % 4 == 0, "moved").alias("cancel_reason"))
    return _short(p.move_terminal(job, updates).select("job_id", "state", "cancel_reason"))


@query("h1_jobs_to_expire", _ACT + f" SELECT job_id, run_id, executor, 'internal' AS category, 'lease expired' AS reason FROM act WHERE executor IN (SELECT executor FROM executors WHERE last_updated < {NOW} - 600)")
def h1(spark, d):
    return h.jobs_to_expire(*_jr(spark, d), h.stale_executors(m.executors(spark), NOW, 600))


@query("h2_lagging_executors", _ACT + " SELECT executor, count(*) AS unreported, count(*) > 40 AS lagging FROM act WHERE CAST(substr(run_id, 5, 10) AS BIGINT) % 4 = 0 GROUP BY executor")
def h2(spark, d):
    jobs, runs = _jr(spark, d)
    return h.lagging_executors(jobs, runs, runs.where(F.substring("run_id", 5, 10).cast("long") % 4 != 0).select("run_id"), 40)


@query("h3_reconcile_runs", _ACT + ", r AS (SELECT act.*, n.pool AS np, reservation FROM act LEFT JOIN node n ON n.node = act.node), q AS (SELECT job_id, run_id, node, pool, CASE WHEN np IS NULL AND gang_id IS NOT NULL THEN 'node of gang job no longer exists' WHEN np <> pool AND NOT (pool = 'pool-0' AND np = 'pool-2') THEN 'node is now in pool ' || np WHEN reservation IS NOT NULL AND priority_class <> 'high' THEN 'node is reserved for ' || reservation END AS reason FROM r) SELECT * FROM q WHERE reason IS NOT NULL")
def h3(spark, d):
    away = spark.createDataFrame([("pool-0", "pool-2")], "pool string, away_pool string")
    return h.reconcile_runs(*_jr(spark, d), m.nodes(spark, d), away)


@query("h3_reconcile_enabled_pools", _ACT + ", r AS (SELECT act.*, n.node AS found, n.pool AS np, coalesce(reservation, '') AS rs, CAST(substr(act.job_id, 5, 10) AS BIGINT) % 2 AS own FROM act LEFT JOIN node n ON n.node = act.node WHERE act.pool IN ('pool-0', 'pool-1')), q AS (SELECT job_id, run_id, node, pool, CASE WHEN found IS NULL AND gang_id IS NOT NULL THEN 'node of gang job no longer exists' WHEN np <> pool AND NOT (pool = 'pool-0' AND np = 'pool-2') THEN 'node is now in pool ' || np WHEN found IS NOT NULL AND pool = 'pool-0' AND rs NOT IN ('', 'res-' || own) THEN 'node is reserved for ' || rs WHEN found IS NOT NULL AND pool = 'pool-1' AND rs IN ('', 'res-' || own) THEN 'away on a node of its own reservation ' || rs END AS reason FROM r) SELECT * FROM q WHERE reason IS NOT NULL")
def h3_pools(spark, d):
    jobs, runs = _jr(spark, d)
    jobs = jobs.withColumn("reservations", F.array(F.lit(""), m.text("res-", F.substring("job_id", 5, 10).cast("long") % 2)))
    away = spark.createDataFrame([("pool-0", "pool-2")], "pool string, away_pool string")
    pools = spark.createDataFrame([("pool-0", True, False), ("pool-1", False, True)], "pool string, match boolean, no_match boolean")
    return h.reconcile_runs(jobs, runs, m.nodes(spark, d), away, pools)


_GANG = ", k AS (SELECT *, CAST(substr(job_id, 5, 10) AS BIGINT) AS n FROM sjob), an AS (SELECT *, CASE WHEN gang_id IS NULL THEN NULL WHEN n % 40 = 1 THEN '' ELSE gang_id END AS gid, CASE n % 50 WHEN 2 THEN NULL WHEN 11 THEN 'two' WHEN 21 THEN '0' WHEN 32 THEN '1' ELSE '2' END AS size, CASE WHEN n % 6 <> 0 THEN 'zone-' || (n // 100 % 2 + CASE WHEN n % 70 = 1 THEN 1 ELSE 0 END) END AS label FROM k), gi AS (SELECT *, CASE WHEN gid IS NULL THEN NULL WHEN gid = '' THEN 'gang id is empty' WHEN size IS NULL THEN 'gang cardinality is missing' WHEN size = 'two' THEN 'gang cardinality is not a number' WHEN size = '0' THEN 'gang cardinality is not positive' END AS err FROM an), ok AS (SELECT *, coalesce(label, '') AS lab FROM gi WHERE gid IS NOT NULL AND err IS NULL AND size = '2')"


def _annotated(spark, d):
    n = F.substring("job_id", 5, 10).cast("long")
    size = F.when(n % 50 == 2, None).when(n % 50 == 11, "two").when(n % 50 == 21, "0").when(n % 50 == 32, "1").otherwise("2")
    label = F.when(n % 6 != 0, m.text("zone-", F.floor(n / 100) % 2 + F.when(n % 70 == 1, 1).otherwise(0)))
    pairs = [F.struct(F.lit(key).alias("k"), v.alias("v")) for key, v in ((h.GANG_ID, F.when(F.col("gang_id").isNotNull(), F.when(n % 40 == 1, "").otherwise(F.col("gang_id")))), (h.GANG_CARDINALITY, size), (h.GANG_UNIFORMITY, label))]
    jobs = m.scheduler_jobs(spark, d).withColumn("annotations", F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull())))
    return h.gang_info(jobs.drop("gang_id", "gang_cardinality"))


@query("h4_gang_info", _GANG + " SELECT gi.job_id, gi.err AS gang_error, ok.gid AS gang_id, CASE WHEN ok.gid IS NOT NULL THEN 2 END AS gang_cardinality, ok.lab AS gang_uniformity FROM gi LEFT JOIN ok ON ok.job_id = gi.job_id")
def h4_info(spark, d):
    return _annotated(spark, d).select("job_id", "gang_error", "gang_id", "gang_cardinality", "gang_uniformity")


@query("h4_invalid_gangs_uniformity", _GANG + ", g AS (SELECT queue, gid, bool_and(queued) AS q, count(DISTINCT priority_class) AS c, count(DISTINCT lab) AS i, count(*) AS n FROM ok GROUP BY queue, gid), b AS (SELECT queue, gid, CASE WHEN NOT q THEN 'not all members are queued' WHEN c > 1 THEN 'members differ in priority class' WHEN i > 1 THEN 'members differ in gang information' WHEN n > 2 THEN 'more members than the cardinality' END AS reason FROM g) SELECT ok.queue, ok.gid AS gang_id, job_id, reason FROM ok JOIN b ON b.queue = ok.queue AND b.gid = ok.gid WHERE reason IS NOT NULL")
def h4_uniformity(spark, d):
    return h.invalid_gangs(_annotated(spark, d))


@query("h4_invalid_gangs", ", g AS (SELECT queue, gang_id, bool_and(queued) AS q, count(DISTINCT priority_class) AS c, count(DISTINCT gang_cardinality) AS i, max(gang_cardinality) AS s, count(*) AS n FROM sjob WHERE gang_id IS NOT NULL GROUP BY queue, gang_id), b AS (SELECT queue, gang_id, CASE WHEN NOT q THEN 'not all members are queued' WHEN c > 1 THEN 'members differ in priority class' WHEN i > 1 THEN 'members differ in gang information' WHEN n > s THEN 'more members than the cardinality' END AS reason FROM g) SELECT sjob.queue, sjob.gang_id, job_id, reason FROM sjob JOIN b ON b.queue = sjob.queue AND b.gang_id = sjob.gang_id WHERE reason IS NOT NULL")
def h4(spark, d):
    return h.invalid_gangs(m.scheduler_jobs(spark, d))


_FAILED = ", fr AS (SELECT run_id, queue, 'policy-' || (CAST(substr(job_run.job_id, 5, 10) AS BIGINT) % 3) AS policy, CASE WHEN exit_code > 0 THEN failure_category END AS category, failure_subcategory AS subcategory, CAST(substr(job_run.job_id, 5, 10) AS BIGINT) % 6 AS failures FROM job_run JOIN job ON job.job_id = job_run.job_id WHERE job_run_state = 4 AND CAST(substr(job_run.job_id, 5, 10) AS BIGINT) % 10 <> 0)"
_DECIDED = _FAILED + ", ru AS (SELECT 'policy-0' AS policy, 0 AS o, 'cat-1' AS c, 'sub-1' AS s, 'Retry' AS a UNION ALL SELECT 'policy-0', 1, 'cat-1', NULL, 'Fail' UNION ALL SELECT 'policy-1', 0, 'cat-0', NULL, 'Retry'), fi AS (SELECT run_id, arg_min(a, o) AS rule FROM fr JOIN ru ON ru.policy = fr.policy AND ru.c = fr.category AND (ru.s IS NULL OR ru.s = fr.subcategory) GROUP BY run_id), de AS (SELECT fr.run_id, queue, policy, CASE WHEN category IS NULL THEN 'no_error' WHEN greatest(failures - 1, 0) >= 4 THEN 'fail_global_limit' WHEN rule = 'Fail' THEN 'fail_rule' WHEN rule IS NULL AND policy <> 'policy-1' THEN 'fail_default' WHEN greatest(failures - 1, 0) >= CASE policy WHEN 'policy-0' THEN 3 WHEN 'policy-1' THEN 2 ELSE 0 END THEN 'fail_policy_limit' ELSE 'retry' END AS decision FROM fr LEFT JOIN fi ON fi.run_id = fr.run_id)"


def _retry_inputs(spark, d):
    k = F.substring("job_id", 5, 10).cast("long")
    failed = m.job_run(spark, d).where("job_run_state = 4").join(m.job(spark, d, False).select("job_id", "queue"), "job_id")
    failed = failed.select("run_id", "job_id", "queue", m.text("policy-", k % 3).alias("policy"), F.when(F.col("exit_code") > 0, F.col("failure_category")).alias("category"), F.col("failure_subcategory").alias("subcategory"), (k % 6).alias("failures"), F.when(k % 10 == 0, "g").alias("gang_id"), F.lit(False).alias("returned"))
    policies = spark.createDataFrame([("policy-0", 3, "Fail"), ("policy-1", 2, "Retry")], "policy string, retry_limit int, default_action string")
    rules = spark.createDataFrame([("policy-0", 0, "cat-1", "sub-1", "Retry"), ("policy-0", 1, "cat-1", None, "Fail"), ("policy-1", 0, "cat-0", None, "Retry")], "policy string, ordinal int, on_category string, on_subcategory string, action string")
    return failed, policies, rules


def _decisions(spark, d):
    return h.retry_decisions(*_retry_inputs(spark, d), 4)


@query("h5_retry_decisions", _DECIDED + " SELECT * FROM de")
def h5(spark, d):
    return _decisions(spark, d)


@query("h5_default_policy", _FAILED.replace("'policy-' || (CAST(substr(job_run.job_id, 5, 10) AS BIGINT) % 3)", "CASE CAST(substr(job_run.job_id, 5, 10) AS BIGINT) % 5 WHEN 0 THEN 'policy-0' WHEN 1 THEN 'policy-1' WHEN 2 THEN 'gone' WHEN 3 THEN '' END").replace("AS failures FROM", "AS failures, CAST(substr(job_run.job_id, 5, 10) AS BIGINT) % 4 = 3 AS ff FROM") + _DECIDED[len(_FAILED):].replace("FROM fr JOIN ru", "FROM fq fr JOIN ru").replace("FROM fr LEFT JOIN fi", "FROM fq fr LEFT JOIN fi").replace(", ru AS (", ", fq AS (SELECT * EXCLUDE (policy), coalesce(nullif(policy, ''), 'policy-1') AS policy FROM fr WHERE NOT ff AND coalesce(policy, '') <> 'gone'), ru AS (", 1) + " SELECT * FROM de")
def h5_default(spark, d):
    k = F.substring("job_id", 5, 10).cast("long")
    policy = F.when(k % 5 == 0, "policy-0").when(k % 5 == 1, "policy-1").when(k % 5 == 2, "gone").when(k % 5 == 3, "")
    failed, policies, rules = _retry_inputs(spark, d)
    return h.retry_decisions(failed.withColumns({"policy": policy, "fail_fast": k % 4 == 3}), policies, rules, 4, "policy-1")


@query("t8_retry_decision_counts", _DECIDED + " SELECT queue, policy, decision, count(*) AS n FROM de GROUP BY queue, policy, decision")
def t8(spark, d):
    return x.counts_by(_decisions(spark, d), "queue", "policy", "decision")


@query("h6_failure_counts", "SELECT job_id, CAST(sum(CASE WHEN failed AND NOT preempted AND NOT returned THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM srun GROUP BY job_id")
def h6(spark, d):
    return h.failure_counts(m.scheduler_runs(spark, d))


RULES = [h.Rule("oom", ("OOMKilled",)), h.Rule("evicted", ("Evicted", "DeadlineExceeded")), h.Rule("exit", exit_codes=(1,), container="main"), h.Rule("message", termination_message="(?i)disk full"), h.Rule("pull", pod_error="image .* not found"), h.Rule("mount", event_type="Warning", event_reason="FailedMount", event_message="^timeout")]


@query("h7_categorise_failures", ", r AS (SELECT run_id, exit_code, CAST(substr(job_id, 5, 10) AS BIGINT) AS k FROM job_run WHERE job_run_state = 4) SELECT run_id, CASE WHEN exit_code <> 0 AND k % 7 = 0 THEN 'oom' WHEN k % 11 = 0 THEN 'evicted' WHEN exit_code = 1 AND k % 2 = 0 THEN 'exit' WHEN exit_code <> 0 AND k % 5 = 0 THEN 'message' WHEN k % 13 = 0 THEN 'pull' WHEN k % 3 = 0 THEN 'mount' ELSE 'other' END AS category FROM r")
def h7(spark, d):
    k = F.substring("job_id", 5, 10).cast("long")
    container = F.struct(F.when(k % 2 == 0, "main").otherwise("side").alias("name"), "exit_code", F.when(k % 7 == 0, "OOMKilled").otherwise("Error").alias("reason"), F.when(k % 5 == 0, "Disk full on /").otherwise("").alias("termination_message"))
    event = F.struct(F.lit("Warning").alias("type"), F.when(k % 3 == 0, "FailedMount").otherwise("BackOff").alias("reason"), F.lit("timeout of volume").alias("message"))
    failed = m.job_run(spark, d).where("job_run_state = 4").select("run_id", F.when(k % 11 == 0, "Evicted").otherwise("").alias("pod_reason"), F.when(k % 13 == 0, "image x:1 not found").otherwise("").alias("pod_error"), F.array(container).alias("containers"), F.array(event).alias("pod_events"))
    return h.categorise_failures(failed, RULES, "other")


@query("h8_audit_submissions", " UNION ALL ".join(["SELECT job_id, 'missing namespace' AS rule FROM job WHERE namespace IS NULL", "SELECT job_id, 'client id too long' FROM job WHERE length(owner) > 8", "SELECT job_id, 'unknown priority class' FROM job WHERE priority_class = 'low'", "SELECT job_id, 'cpu limit out of range' FROM job WHERE priority = 2", "SELECT job_id, 'memory is missing' FROM job WHERE gpu = 1", "SELECT job_id, 'cpu is negative' FROM job WHERE cpu = 16000"]))
def h8(spark, d):
    job = m.job(spark, d, False)
    cpu = F.when(F.col("cpu") == 16000, F.lit(-1.0)).otherwise(F.col("cpu").cast("double"))
    subs = job.select("job_id", "queue", "jobset", "namespace", F.col("owner").alias("client_id"), "priority_class", F.lit(None).cast("string").alias("price_band"), cpu.alias("request_cpu"), F.when(F.col("priority") == 2, cpu + 1).otherwise(cpu).alias("limit_cpu"), F.when(F.col("gpu") == 0, F.col("memory").cast("double")).alias("request_memory"), F.col("memory").cast("double").alias("limit_memory"))
    return h.audit_submissions(subs, h.AuditConfig(classes=("high",), longest_id=8))


@query("h9_processing_delay", ", a AS (SELECT i AS part, CASE WHEN i = 3 THEN 1000000000 ELSE 4000 + i * 10 END AS done FROM (SELECT unnest(range(4)) AS i) r) SELECT job_event.seq % 5 AS \"partition\", coalesce(greatest(1706700000 - min(CASE WHEN done IS NULL OR job_event.seq > done THEN created END), 0), 0) AS delay FROM job_event LEFT JOIN a ON a.part = job_event.seq % 5 GROUP BY 1")
def h9(spark, d):
    messages = m.job_event(spark, d).select((F.col("seq") % 5).alias("partition"), "seq", F.col("created").alias("published"))
    acked = spark.range(4).select(F.col("id").alias("partition"), F.when(F.col("id") == 3, 1_000_000_000).otherwise(4000 + F.col("id") * 10).alias("seq"))
    return h.processing_delay(messages, acked, 1_706_700_000)


@query("i18_active_jobs_on_executor", _ACT + " SELECT queue, job_set, count(*) AS jobs FROM act JOIN (SELECT job_id, job_set FROM sjob) s USING (job_id) WHERE executor = 'executor-2' AND queue IN ('queue-1', 'queue-2', 'queue-5') AND pool IN ('pool-0', 'pool-1') AND priority_class = 'low' GROUP BY queue, job_set")
def i18(spark, d):
    found = sel.select_active_jobs(*_jr(spark, d), executor="executor-2", queues=["queue-1", "queue-2", "queue-5"], pools=["pool-0", "pool-1"], priority_classes=["low"])
    return found.groupBy("queue", "job_set").agg(F.count("*").alias("jobs"))


@query("i18_active_jobs_on_node", _ACT + " SELECT job_id, act.queue, s.job_set FROM act JOIN (SELECT job_id, job_set FROM sjob) s USING (job_id) WHERE node IN ('node-1', 'node-10') AND node = 'node-10' AND CASE WHEN running THEN 'running' WHEN pending THEN 'pending' ELSE 'leased' END IN ('running', 'leased')")
def i18_node(spark, d):
    return sel.select_active_jobs(*_jr(spark, d), node="node-10", states=["running", "leased"])


@query("i18_queued_jobs", "SELECT queue, job_set, count(*) AS jobs FROM sjob WHERE queued AND queue = 'queue-3' AND (pool1 = 'pool-1' OR pool2 = 'pool-1') GROUP BY queue, job_set")
def i18_queued(spark, d):
    found = sel.select_active_jobs(*_jr(spark, d), queues=["queue-3"], pools=["pool-1"], states=["queued"])
    return found.groupBy("queue", "job_set").agg(F.count("*").alias("jobs"))


@query("i18_by_job_set", ", f AS (SELECT queue, job_set, job_id, (row_number() OVER (PARTITION BY queue, job_set ORDER BY job_id) - 1) // 20 AS request FROM sjob WHERE queued) SELECT queue, job_set, CAST(request AS INTEGER) AS request, string_agg(job_id, ',' ORDER BY job_id) AS job_ids FROM f GROUP BY queue, job_set, request")
def i18_sets(spark, d):
    return sel.by_job_set(sel.select_active_jobs(*_jr(spark, d), states=["queued"]), 20).withColumn("job_ids", F.array_join("job_ids", ","))


@query("i19_changes_since", "SELECT job_id, serial FROM sjob WHERE serial > 100 ORDER BY serial LIMIT 500")
def i19(spark, d):
    return sel.changes_since(m.scheduler_jobs(spark, d), 100, 500).select("job_id", "serial")


@query("i19_initial_jobs", "SELECT job_id, serial FROM sjob WHERE NOT (cancelled OR succeeded OR failed)")
def i19_initial(spark, d):
    return sel.initial_jobs(m.scheduler_jobs(spark, d)).select("job_id", "serial")


@query("i19_initial_runs", "SELECT srun.run_id, srun.job_id FROM srun JOIN sjob ON sjob.job_id = srun.job_id WHERE NOT (sjob.cancelled OR sjob.succeeded OR sjob.failed)")
def i19_runs(spark, d):
    return sel.initial_runs(*_jr(spark, d)).select("run_id", "job_id")


@query("i20_marker_group_counts", "SELECT 'g' || (seq // 50) AS group_id, count(DISTINCT seq % 8) AS partitions, count(DISTINCT seq % 8) = 8 AS complete FROM job_event WHERE seq % 9 < 7 GROUP BY 1")
def i20(spark, d):
    markers = m.job_event(spark, d).where("seq % 9 < 7").select(m.text("g", F.floor(F.col("seq") / 50)).alias("group_id"), (F.col("seq") % 8).alias("partition_id"))
    return sel.marker_group_counts(markers, 8)


@query("s4_finished_runs", ", en AS (SELECT job_id, CASE kind WHEN 'CancelledJob' THEN 'CANCELLED' WHEN 'JobSucceeded' THEN 'SUCCEEDED' ELSE 'PREEMPTED' END AS state, created AS finished FROM job_event WHERE kind IN ('CancelledJob', 'JobSucceeded', 'JobRunPreempted')), sc AS (SELECT job_id, max(created) AS scheduled FROM job_event WHERE kind = 'JobRunLeased' GROUP BY job_id), jb AS (SELECT job_id, min(created) AS submitted, arg_min(queue, seq) AS queue FROM job_event WHERE kind = 'SubmitJob' GROUP BY job_id) SELECT en.job_id, en.state, finished, scheduled, submitted, queue FROM en JOIN jb ON jb.job_id = en.job_id LEFT JOIN sc ON sc.job_id = en.job_id")
def s4(spark, d):
    log = m.job_event(spark, d)
    job = log.where("kind = 'SubmitJob'").groupBy("job_id").agg(F.min("created").alias("submitted"), F.min_by("queue", "seq").alias("queue"))
    return e.finished_runs(job, log)


@query("s7_quantities", "SELECT job_id, CAST(cpu AS BIGINT) AS cpu, memory FROM job")
def s7(spark, d):
    job = m.job(spark, d, False)
    half = F.create_map(F.lit("cpu"), F.concat((F.col("cpu") / 2).cast("long").cast("string"), F.lit("m")), F.lit("memory"), F.concat((F.col("memory") / (1 << 20)).cast("long").cast("string"), F.lit("Mi")))
    other = F.create_map(F.lit("cpu"), (F.col("cpu") / 2000).cast("string"))
    return job.select("job_id", scalars.job_resources(F.array(half, other), "cpu", True).alias("cpu"), scalars.job_resources(F.array(half, other), "memory").alias("memory"))


@query("s8_clean_annotations", "SELECT job_id, team, ticket FROM job")
def s8(spark, d):
    job = m.job(spark, d, False)
    raw = F.map_concat(F.transform_keys("annotations", lambda k, v: F.when(k == "team", F.lit("example.org/team")).otherwise(k)), F.create_map(F.lit("Internal-Secret"), F.lit("x")))
    clean = scalars.clean_annotations(raw, "example.org/", ["internal-secret"])
    return job.select("job_id", clean.alias("a")).select("job_id", F.try_element_at("a", F.lit("team")).alias("team"), F.try_element_at("a", F.lit("ticket")).alias("ticket"))


_API = ", api AS (" + " UNION ALL ".join(["SELECT queue, jobset, job_id, created, seq, 0 AS subseq, 'submitted' AS api_kind, CAST(NULL AS BOOLEAN) AS retryable FROM job_event WHERE kind = 'SubmitJob'", "SELECT queue, jobset, job_id, created, seq, 1, 'queued', NULL FROM job_event WHERE kind = 'SubmitJob'", "SELECT queue, jobset, job_id, created, seq, 0, CASE kind WHEN 'JobRunLeased' THEN 'leased' WHEN 'JobRunAssigned' THEN 'pending' WHEN 'JobRunRunning' THEN 'running' WHEN 'JobSucceeded' THEN 'succeeded' WHEN 'CancelledJob' THEN 'cancelled' WHEN 'ReprioritisedJob' THEN 'reprioritized' WHEN 'JobRunPreempted' THEN 'preempted' WHEN 'JobRunErrors' THEN CASE error_kind WHEN 'LeaseExpired' THEN 'lease_expired' ELSE 'lease_returned' END ELSE CASE WHEN error_kind = 'JobRunPreemptedError' THEN 'preempted' ELSE 'failed' END END, CASE WHEN kind = 'JobErrors' AND error_kind <> 'JobRunPreemptedError' THEN NOT terminal END FROM job_event WHERE kind IN ('JobRunLeased', 'JobRunAssigned', 'JobRunRunning', 'JobSucceeded', 'CancelledJob', 'ReprioritisedJob', 'JobRunPreempted', 'JobErrors') OR (kind = 'JobRunErrors' AND error_kind IN ('LeaseExpired', 'LeaseReturned'))"]) + ")"


@query("w3_api_events", _API + " SELECT job_id, created, seq, subseq, api_kind, retryable FROM api")
def w3(spark, d):
    return e.to_api_events(m.job_event(spark, d)).select("job_id", "created", "seq", "subseq", "api_kind", "retryable")


@query("w4_read_after", _API + " SELECT created || ':' || seq || ':' || subseq || ':' || CASE WHEN api_kind = 'submitted' THEN 0 ELSE 1 END AS id, api_kind FROM api WHERE queue = 'queue-1' AND jobset = 'js-1' AND (created > 1704400000 OR (created = 1704400000 AND seq > 0)) ORDER BY created, seq, subseq LIMIT 40")
def w4(spark, d):
    return e.read_after(e.to_api_events(m.job_event(spark, d)), "queue-1", "js-1", "1704400000:0:0:1", 40).select("id", "api_kind")


@query("w5_watch_summary", _API + ", st AS (SELECT *, CASE WHEN api_kind IN ('submitted', 'queued', 'lease_returned', 'lease_expired') OR (api_kind = 'failed' AND retryable) THEN 'queued' WHEN api_kind <> 'reprioritized' THEN api_kind END AS status FROM api) SELECT queue, jobset, job_id, status, created AS updated FROM (SELECT *, row_number() OVER (PARTITION BY queue, jobset, job_id ORDER BY created DESC, seq DESC, subseq DESC) AS rn FROM st WHERE status IS NOT NULL) t WHERE rn = 1")
def w5(spark, d):
    return e.watch_summary(e.to_api_events(m.job_event(spark, d)))


@query("w6_event_gap_stats", ", ga AS (SELECT kind, lead(created) OVER (PARTITION BY job_id ORDER BY seq) - created AS gap FROM job_event) SELECT kind, count(*) AS n, min(gap) AS min, max(gap) AS max, avg(gap) AS mean, coalesce(var_samp(gap), 0) AS variance, coalesce(stddev_samp(gap), 0) AS stddev FROM ga WHERE gap IS NOT NULL GROUP BY kind")
def w6(spark, d):
    return e.event_gap_stats(m.job_event(spark, d))


@query("p6_hot_partition", "SELECT job_id, state FROM job WHERE state IN (1, 2, 3, 8)")
def p6_hot(spark, d):
    path = shared_folder(spark, "jobs")
    p.write_hot_cold(m.job(spark, d, False).select("job_id", "state"), path)
    return _short(p.read_hot_cold(spark, path, True))


@query("p7_submitted_days", "SELECT CAST(submitted // 86400 AS BIGINT) AS day, count(*) AS jobs FROM job GROUP BY 1")
def p7(spark, d):
    path = shared_folder(spark, "jobs")
    p.write_by_submitted_day(m.job(spark, d, False).select("job_id", "submitted"), path)
    return spark.read.parquet(path).groupBy(F.unix_date("day").cast("long").alias("day")).agg(F.count("*").alias("jobs"))


@query("s1_s2_explode_events", "SELECT queue, jobset, seq, kind, CASE WHEN seq % 4 = 0 THEN 1706800000 ELSE created END AS created FROM job_event")
def s1(spark, d):
    log = m.job_event(spark, d)
    event = F.struct(F.when(F.col("seq") % 4 != 0, F.timestamp_seconds("created")).alias("created"), "kind", "job_id", "run_id", F.col("seq").cast("string").alias("reason"), "priority")
    seqs = log.groupBy("queue", "jobset", "user", F.floor(F.col("seq") / 50).alias("message")).agg(F.min("seq").alias("seq"), F.collect_list(event).alias("events")).withColumn("publish_time", F.timestamp_seconds(F.lit(1_706_800_000)))
    return e.explode_events(e.fill_created(seqs)).select("queue", "jobset", F.col("reason").cast("long").alias("seq"), "kind", F.unix_timestamp("created").alias("created"))


@query("s3_job_tables", "SELECT job.job_id, job.state, job.queue, job.latest_run_id, job_run.job_run_state, job_run.finished, job_run.node, 'spec of ' || job.job_id AS spec, CASE WHEN job.state = 5 THEN 'error of ' || job.job_id END AS error FROM job LEFT JOIN job_run ON job_run.run_id = job.latest_run_id WHERE job.state IN (4, 5, 6, 7, 9)")
def s3(spark, d):
    path, jobs = shared_folder(spark, "jobs"), m.job(spark, d)
    specs = jobs.select("job_id", F.encode(F.concat(F.lit("spec of "), "job_id"), "UTF-8").alias("job_spec"))
    job_tables.write_tables({"job": jobs, "job_run": m.job_run(spark, d), "job_spec": specs, "job_error": jobs.where("state = 5").select("job_id", F.concat(F.lit("error of "), "job_id").alias("error"))}, path)
    jobs = job_tables.read_tables(spark, path, active=False, names=("job",))["job"]
    rest = job_tables.read_tables(spark, path)
    # the ended jobs are the hashed side, so that the many runs aren't sorted to be met
    rows = jobs.hint("shuffle_hash").join(rest["job_run"].select(F.col("run_id").alias("latest_run_id"), "job_run_state", "finished", "node"), "latest_run_id", "left").join(rest["job_spec"], "job_id").join(rest["job_error"], "job_id", "left")
    return _short(rows.select("job_id", "state", "queue", "latest_run_id", "job_run_state", "finished", "node", F.decode("job_spec", "UTF-8").alias("spec"), "error"))


@query("s1_read_event_log", "SELECT queue, jobset, seq, kind, CASE WHEN seq % 4 = 0 THEN 1706800000 ELSE created END AS created FROM job_event")
def s1_read(spark, d):
    """Messages of a few events each, written as files and read as the log."""
    log, path = m.job_event(spark, d), shared_folder(spark, "log")
    event = F.struct(F.when(F.col("seq") % 4 != 0, F.timestamp_seconds("created")).alias("created"), "kind", "job_id", "run_id", F.col("seq").cast("string").alias("reason"), "priority")
    seqs = log.groupBy("queue", "jobset", "user", F.floor(F.col("seq") / 50).alias("message")).agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(event)).alias("events"))
    seqs.select("queue", "jobset", "user", F.array(F.lit("g")).alias("groups"), F.timestamp_seconds(F.lit(1_706_800_000)).alias("publish_time"), F.lit(0).alias("partition"), "seq", "events").write.parquet(path)
    rows = e.explode_events(e.read_event_log(spark, path))
    return rows.select("queue", "jobset", F.col("reason").cast("long").alias("seq"), "kind", F.unix_timestamp("created").alias("created"))


@query("s6_event_store", "SELECT queue, jobset, seq, kind, CASE WHEN kind = 'CancelledJob' THEN '' ELSE reason END AS reason FROM job_event")
def s6_store(spark, d):
    path = shared_folder(spark, "store")
    e.write_event_store(m.job_event(spark, d).select("queue", "jobset", "seq", "kind", "reason", F.array(F.lit("g")).alias("groups")), path, 25)
    return e.read_event_store(spark, path).select("queue", "jobset", "seq", "kind", "reason")


@query("s6_compacted_pieces", ", h AS (SELECT CASE WHEN seq % 3 = 0 THEN 'queue-0' ELSE queue END AS queue, CASE WHEN seq % 3 = 0 THEN 'hot' ELSE jobset END AS jobset, seq, kind FROM job_event), p AS (SELECT *, (row_number() OVER (PARTITION BY queue, jobset ORDER BY seq) - 1) // 25 AS piece FROM h) SELECT queue, jobset, min(seq) AS seq, max(seq) AS last, count(*) AS events, string_agg(kind, ',' ORDER BY seq) AS kinds FROM p GROUP BY queue, jobset, piece")
def s6_pieces(spark, d):
    """A job set that holds a third of the log is in as many rows as it has pieces."""
    third = F.col("seq") % 3 == 0
    log = m.job_event(spark, d).select(F.when(third, "queue-0").otherwise(F.col("queue")).alias("queue"), F.when(third, "hot").otherwise(F.col("jobset")).alias("jobset"), "seq", "kind", "reason")
    return e.compacted(log, 25).select("queue", "jobset", "seq", "last", F.size("events").cast("long").alias("events"), F.array_join(F.transform("events", lambda x: x["kind"]), ",").alias("kinds"))
