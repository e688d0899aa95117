"""Queries of the event-log folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.jobs.registry import query
from jobloom.operators import fold as f
from jobloom.sources import model as m

_UPDATES = """, upd0 AS (SELECT *, CASE WHEN kind = 'CancelledJob' THEN 6 WHEN kind = 'JobSucceeded' THEN 4 WHEN kind = 'JobErrors' AND terminal THEN CASE error_kind WHEN 'JobRunPreemptedError' THEN 7 WHEN 'JobRejected' THEN 9 ELSE 5 END
  WHEN kind = 'JobRunRunning' THEN 3 WHEN kind = 'JobRequeued' THEN 1 WHEN kind = 'JobRunLeased' THEN 8 WHEN kind = 'JobRunAssigned' THEN 2 WHEN kind = 'JobRunPreempted' THEN 7 END AS st FROM job_event),
upd AS (SELECT job_id, seq, CASE WHEN kind = 'ReprioritisedJob' THEN priority END AS priority, st AS state, CASE WHEN kind = 'CancelledJob' THEN created END AS cancelled, CASE WHEN st IS NOT NULL THEN created END AS last_transition_time,
  CASE WHEN kind IN ('JobRunRunning', 'JobRunLeased', 'JobRunAssigned') THEN run_id END AS latest_run_id, CASE WHEN kind = 'CancelledJob' THEN reason END AS cancel_reason, CASE WHEN kind = 'CancelledJob' THEN coalesce(requestor, usr) END AS cancel_user
  FROM upd0 WHERE st IS NOT NULL OR kind = 'ReprioritisedJob'),
ends AS (SELECT job_id, min(seq) AS e FROM upd WHERE state IN (4, 5, 6, 7, 9) GROUP BY job_id), fin AS (SELECT upd.job_id, e, state AS final FROM upd JOIN ends ON upd.job_id = ends.job_id AND upd.seq = e),
pre AS (SELECT job_id, min(seq) AS p FROM upd WHERE state = 7 GROUP BY job_id),
acc AS (SELECT upd.* FROM upd LEFT JOIN fin ON upd.job_id = fin.job_id LEFT JOIN pre ON upd.job_id = pre.job_id WHERE fin.e IS NULL OR upd.seq <= fin.e OR (upd.seq = pre.p AND fin.final IN (4, 5, 6)))"""
_LAST = ", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in f.JOB_COLUMNS)
_CONFLATED = _UPDATES + f", conf AS (SELECT job_id, {_LAST} FROM acc GROUP BY job_id)"
_CREATED = ", cre AS (SELECT job_id, queue, jobset, usr AS owner, priority, created AS submitted FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM job_event WHERE kind = 'SubmitJob') t WHERE rn = 1)"
_RUN_UPDATES = """, rupd0 AS (SELECT *, CASE kind WHEN 'JobRunAssigned' THEN 1 WHEN 'JobRunRunning' THEN 2 WHEN 'JobRunSucceeded' THEN 3 WHEN 'CancelledJob' THEN 12 WHEN 'JobRunPreempted' THEN 6 WHEN 'JobRunErrors' THEN CASE error_kind WHEN 'JobRunPreemptedError' THEN NULL WHEN 'LeaseReturned' THEN 8 WHEN 'LeaseExpired' THEN 9 ELSE 4 END END AS st FROM job_event),
rupd AS (SELECT run_id, seq, CASE WHEN kind = 'JobRunAssigned' THEN created END AS pending, CASE WHEN kind = 'JobRunRunning' THEN created END AS started, CASE WHEN kind IN ('JobRunSucceeded', 'CancelledJob', 'JobRunPreempted') OR (kind = 'JobRunErrors' AND terminal) THEN created END AS finished, st AS job_run_state,
  CASE WHEN kind = 'JobRunRunning' OR (kind = 'JobRunErrors' AND error_kind = 'PodError') THEN node END AS node, CASE WHEN kind = 'JobRunSucceeded' THEN 0 WHEN kind = 'JobRunErrors' AND error_kind = 'PodError' THEN exit_code END AS exit_code,
  CASE WHEN kind = 'JobRunPreempted' THEN 'preempted' WHEN kind = 'JobRunErrors' THEN CASE error_kind WHEN 'PodError' THEN 'pod error on ' || node WHEN 'LeaseExpired' THEN 'Lease expired' WHEN 'LeaseReturned' THEN 'Lease returned' ELSE 'Unknown error' END END AS error,
  CASE WHEN kind = 'JobRunErrors' AND error_kind = 'PodError' THEN 'debug of ' || run_id END AS debug, CASE WHEN kind IN ('JobRunPreempted', 'CancelledJob') THEN reason END AS termination_reason FROM rupd0 WHERE st IS NOT NULL)"""
_RUN_LAST = ", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in f.RUN_COLUMNS)


def _numbers(df):
    return df.withColumns({c: F.col(c).cast("long") for c in ("state", "job_run_state") if c in df.columns})


@query("s2_i12_event_counts", "SELECT queue, kind, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes FROM job_event GROUP BY queue, kind")
def s2(spark, d):
    return f.event_counts(m.job_event(spark, d))


@query("i1_create_jobs", _CREATED + " SELECT * FROM cre")
def i1(spark, d):
    return f.create_jobs(m.job_event(spark, d)).select("job_id", "queue", "jobset", "owner", "priority", "submitted")


@query("i2_job_updates", _UPDATES + " SELECT job_id, seq, priority, state, cancelled, last_transition_time, latest_run_id, cancel_reason, cancel_user FROM upd")
def i2(spark, d):
    return _numbers(f.job_updates(m.job_event(spark, d)))


@query("i3_conflate_job_updates", _CONFLATED + " SELECT * FROM conf")
def i3(spark, d):
    return _numbers(f.conflate_job_updates(f.job_updates(m.job_event(spark, d))))


@query("i4_drop_updates_to_terminal", _UPDATES + ", sto AS (SELECT 'ej-' || o_orderkey AS job_id, o_orderkey % 9 + 1 AS st FROM orders) SELECT upd.job_id, upd.seq, upd.state FROM upd LEFT JOIN sto ON upd.job_id = sto.job_id WHERE sto.st IS NULL OR sto.st IN (1, 2, 3, 8) OR (sto.st IN (4, 5, 6) AND upd.state = 7)")
def i4(spark, d):
    stored = m.table(spark, d, "orders").select(F.concat(F.lit("ej-"), F.col("o_orderkey").cast("string")).alias("job_id"), (F.col("o_orderkey") % 9 + 1).alias("state"))
    return _numbers(f.drop_updates_to_terminal(f.job_updates(m.job_event(spark, d)), stored).select("job_id", "seq", "state"))


@query("i5_fold_jobs", _CONFLATED + _CREATED + " SELECT cre.job_id, queue, jobset, owner, submitted, coalesce(conf.priority, cre.priority) AS priority, coalesce(conf.state, 1) AS state, coalesce(conf.last_transition_time, submitted) AS last_transition_time, latest_run_id, cancelled, cancel_reason, cancel_user FROM cre LEFT JOIN conf ON cre.job_id = conf.job_id")
def i5(spark, d):
    return _numbers(f.fold_log(m.job_event(spark, d))[0].select("job_id", "queue", "jobset", "owner", "submitted", "priority", "state", "last_transition_time", "latest_run_id", "cancelled", "cancel_reason", "cancel_user"))


@query("i7_i8_run_updates", _RUN_UPDATES + " SELECT * FROM rupd")
def i7(spark, d):
    return _numbers(f.run_updates(m.job_event(spark, d)))


@query("i6_i9_fold_runs", _RUN_UPDATES + f", rc AS (SELECT run_id, {_RUN_LAST} FROM rupd GROUP BY run_id), lea AS (SELECT run_id, job_id, cluster, node, pool, created AS leased FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM job_event WHERE kind = 'JobRunLeased') t WHERE rn = 1) SELECT lea.run_id, lea.job_id, cluster, coalesce(rc.node, lea.node) AS node, pool, leased, pending, started, finished, coalesce(rc.job_run_state, 11) AS job_run_state, exit_code, error, debug, termination_reason FROM lea LEFT JOIN rc ON lea.run_id = rc.run_id")
def i9(spark, d):
    return _numbers(f.fold_log(m.job_event(spark, d))[1].select("run_id", "job_id", "cluster", "node", "pool", "leased", "pending", "started", "finished", "job_run_state", "exit_code", "error", "debug", "termination_reason"))


@query("i10_job_errors", "SELECT job_id, 'rejected: ' || arg_min(reason, seq) AS error FROM job_event WHERE kind = 'JobErrors' AND terminal AND error_kind = 'JobRejected' GROUP BY job_id")
def i10(spark, d):
    return f.job_errors(m.job_event(spark, d))


@query("i11_state_update_counts", _UPDATES + " SELECT state, count(*) AS updates FROM upd WHERE state IS NOT NULL GROUP BY state")
def i11(spark, d):
    return _numbers(f.state_update_counts(f.job_updates(m.job_event(spark, d))))


@query("i13_upsert", ", b AS (SELECT job_id, state, cpu, 0 AS w, 0 AS o FROM job UNION ALL SELECT 'job-' || lpad(CAST(event_id % 4000 AS VARCHAR), 10, '0'), 100 + event_id % 7, event_id, 1, event_id FROM events) SELECT job_id, state, cpu FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY w DESC, o DESC) AS rn FROM b) t WHERE rn = 1")
def i13(spark, d):
    e = m.table(spark, d, "events")
    target = m.job(spark, d, False).select("job_id", F.col("state").cast("long").alias("state"), "cpu", F.lit(0).cast("long").alias("o"))
    source = e.select(F.concat(F.lit("job-"), F.lpad((F.col("event_id") % 4000).cast("string"), 10, "0")).alias("job_id"), (100 + F.col("event_id") % 7).alias("state"), F.col("event_id").alias("cpu"), F.col("event_id").alias("o"))
    return f.upsert(target, source, "job_id", "o").select("job_id", "state", "cpu")


@query("i14_apply_versioned", ", u AS (SELECT 'job-' || lpad(CAST(event_id % 900 AS VARCHAR), 10, '0') AS job_id, event_id % 3 = 0 AS queued, event_id % 8 AS v, event_id AS seq FROM events), b AS (SELECT job_id, queued, v FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY v DESC, seq) AS rn FROM u) t WHERE rn = 1) SELECT sjob.job_id, CASE WHEN b.v > sjob.queued_version THEN b.queued ELSE sjob.queued END AS queued, CASE WHEN b.v > sjob.queued_version THEN b.v ELSE sjob.queued_version END AS queued_version FROM sjob LEFT JOIN b ON sjob.job_id = b.job_id")
def i14(spark, d):
    e = F.col("event_id")
    u = m.table(spark, d, "events").select(F.concat(F.lit("job-"), F.lpad((e % 900).cast("string"), 10, "0")).alias("job_id"), (e % 3 == 0).alias("queued"), (e % 8).alias("queued_version"), e.alias("seq"))
    return f.apply_versioned(m.scheduler_jobs(spark, d).select("job_id", "queued", "queued_version"), u, "job_id", "queued", "queued_version")


@query("i15_scheduler_job_flags", "SELECT job_id, bool_or(kind = 'CancelledJob') AS cancelled, bool_or(kind = 'JobSucceeded') AS succeeded, bool_or(kind = 'JobErrors' AND terminal) AS failed, bool_or(kind = 'SubmitJob') AS validated FROM job_event GROUP BY job_id")
def i15(spark, d):
    return f.fold_scheduler_flags(m.job_event(spark, d), "SubmitJob")[0]


@query("i15_scheduler_run_flags", "SELECT run_id, bool_or(kind = 'JobRunAssigned') AS pending, bool_or(kind = 'JobRunRunning') AS running, bool_or(kind = 'JobRunSucceeded') AS succeeded, bool_or(kind = 'JobRunErrors' AND terminal) AS failed, bool_or(kind = 'JobRunErrors' AND terminal AND error_kind = 'LeaseReturned') AS returned, bool_or(kind = 'JobRunPreempted') AS preempted, arg_max(created, seq) FILTER (WHERE kind = 'JobRunAssigned') AS pending_at, arg_max(created, seq) FILTER (WHERE kind = 'JobRunRunning') AS running_at, arg_max(created, seq) FILTER (WHERE kind IN ('CancelledJob', 'JobRunSucceeded') OR (kind = 'JobRunErrors' AND terminal)) AS terminated_at, arg_max(created, seq) FILTER (WHERE kind = 'JobRunPreempted') AS preempted_at FROM job_event GROUP BY run_id")
def i15_runs(spark, d):
    return f.fold_scheduler_flags(m.job_event(spark, d))[1]


def _requests(spark, d):
    e = F.col("event_id")
    return m.table(spark, d, "events").where(e % 5 == 0).select(m.text("queue-", e % 9).alias("queue"), m.text("js-", e % 50).alias("job_set"), e.alias("seq"), F.when(e % 2 == 0, "reprioritise").otherwise("cancel").alias("action"), (e % 13).alias("priority"), m.text("u-", e % 6).alias("user"), m.text("r-", e % 4).alias("reason"), F.when(e % 15 == 0, "queued").when(e % 15 == 5, "leased").alias("states"))


_REQ = ", req AS (SELECT 'queue-' || (event_id % 9) AS queue, 'js-' || (event_id % 50) AS job_set, event_id AS seq, event_id % 2 = 0 AS re, event_id % 13 AS priority, 'u-' || (event_id % 6) AS usr, 'r-' || (event_id % 4) AS reason, CASE WHEN event_id % 15 = 0 THEN 'queued' WHEN event_id % 15 = 5 THEN 'leased' END AS states FROM events WHERE event_id % 5 = 0)"


@query("i16_jobset_updates", _REQ + ", op AS (SELECT sjob.job_id, CASE WHEN queued THEN 'queued' ELSE 'leased' END AS k, req.* FROM sjob JOIN req ON sjob.queue = req.queue AND sjob.job_set = req.job_set WHERE NOT (cancelled OR succeeded OR failed)), a AS (SELECT job_id, arg_max(priority, seq) AS priority, arg_max(usr, seq) AS usr FROM op WHERE re GROUP BY job_id), c AS (SELECT job_id, arg_min(usr, seq) AS usr, arg_min(reason, seq) AS reason FROM op WHERE NOT re AND (states IS NULL OR states = k) GROUP BY job_id) SELECT sjob.job_id, coalesce(a.priority, sjob.priority) AS priority, a.usr AS reprioritise_user, c.job_id IS NOT NULL AS cancel_requested, c.usr AS cancel_user, c.reason AS cancel_reason FROM sjob LEFT JOIN a ON a.job_id = sjob.job_id LEFT JOIN c ON c.job_id = sjob.job_id")
def i16(spark, d):
    return f.apply_jobset_updates(m.scheduler_jobs(spark, d), _requests(spark, d)).select("job_id", "priority", "reprioritise_user", "cancel_requested", "cancel_user", "cancel_reason")


@query("i17_preempt_requests", ", pr AS (SELECT 'job-' || lpad(CAST(event_id % 700 AS VARCHAR), 10, '0') AS job_id, arg_min('Preempted by u-' || (event_id % 6) || CASE WHEN event_id % 2 = 0 THEN ' - r-' || (event_id % 4) ELSE '' END, event_id) AS why FROM events GROUP BY 1) SELECT srun.run_id, preempt_requested OR (why IS NOT NULL AND NOT (cancelled OR succeeded OR failed OR preempted)) AS preempt_requested, CASE WHEN NOT (cancelled OR succeeded OR failed OR preempted) THEN why END AS preempt_reason FROM srun LEFT JOIN pr ON pr.job_id = srun.job_id")
def i17(spark, d):
    e = F.col("event_id")
    requests = m.table(spark, d, "events").select(F.concat(F.lit("job-"), F.lpad((e % 700).cast("string"), 10, "0")).alias("job_id"), e.alias("seq"), m.text("u-", e % 6).alias("user"), F.when(e % 2 == 0, m.text("r-", e % 4)).otherwise("").alias("reason"))
    return f.apply_preempt_requests(m.scheduler_runs(spark, d), requests).select("run_id", "preempt_requested", "preempt_reason")


def _snapshots(spark, d):
    """The snapshot, and the one before it, in which every third job's flags weren't set yet."""
    third = F.substring("job_id", 5, 10).cast("long") % 3 == 0
    off = lambda df, flags: df.withColumns({c: F.col(c) & ~third for c in flags})
    jobs, runs = m.scheduler_jobs(spark, d), m.scheduler_runs(spark, d)
    old_runs = off(runs, ("pending", "running", "succeeded", "failed", "cancelled", "preempted", "preempt_requested")).where(F.substring("job_id", 5, 10).cast("long") % 6 != 0)
    return off(jobs, ("queued", "cancelled", "succeeded", "failed")), old_runs, jobs, runs


_T = ", n AS (SELECT *, CAST(substr(job_id, 5, 10) AS BIGINT) AS k FROM sjob), r AS (SELECT *, CAST(substr(job_id, 5, 10) AS BIGINT) AS k FROM srun), t AS (SELECT n.job_id, n.queued AND n.k % 3 = 0 AS queued, coalesce(r.k % 6 = 0, FALSE) AS leased, coalesce(r.pending AND r.k % 3 = 0, FALSE) AS pending, coalesce(r.running AND r.k % 3 = 0, FALSE) AS running, (n.cancelled AND n.k % 3 = 0) OR coalesce(r.cancelled AND r.k % 3 = 0, FALSE) AS cancelled, coalesce(r.preempt_requested AND r.k % 3 = 0, FALSE) AS preempt_requested, coalesce(r.preempted AND r.k % 3 = 0, FALSE) AS preempted, (n.failed AND n.k % 3 = 0) OR coalesce(r.failed AND r.k % 3 = 0, FALSE) AS failed, (n.succeeded AND n.k % 3 = 0) OR coalesce(r.succeeded AND r.k % 3 = 0, FALSE) AS succeeded FROM n LEFT JOIN r ON n.job_id = r.job_id)"


@query("i21_i22_state_transitions", _T + " SELECT * FROM t")
def i21(spark, d):
    return f.state_transitions(*_snapshots(spark, d))


@query("i23_gang_preemption", _T + ", hit AS (SELECT DISTINCT queue, gang_id FROM t JOIN sjob ON t.job_id = sjob.job_id WHERE preempt_requested AND gang_id IS NOT NULL) SELECT t.job_id, t.preempt_requested OR hit.gang_id IS NOT NULL AS preempt_requested FROM t JOIN sjob ON t.job_id = sjob.job_id LEFT JOIN hit ON hit.queue = sjob.queue AND hit.gang_id = sjob.gang_id")
def i23(spark, d):
    return f.propagate_gang_preemption(f.state_transitions(*_snapshots(spark, d)), m.scheduler_jobs(spark, d)).select("job_id", "preempt_requested")


@query("i24_find_duplicates", ", s AS (SELECT 'job-' || event_id AS job_id, event_id AS seq, CASE WHEN event_id % 10 <> 0 THEN 'queue-' || (event_id % 7) || ':c-' || (event_id % 400) END AS k FROM events), st AS (SELECT 'queue-' || (i % 7) || ':c-' || (i % 400) AS k, min('old-' || i) AS old FROM (SELECT unnest(range(90)) AS i) r GROUP BY 1), fi AS (SELECT k, arg_min(job_id, seq) AS f FROM s WHERE k IS NOT NULL GROUP BY k) SELECT s.job_id, coalesce(st.old, fi.f, s.job_id) AS original_job_id, coalesce(st.old, fi.f, s.job_id) <> s.job_id AS is_duplicate FROM s LEFT JOIN st ON st.k = s.k LEFT JOIN fi ON fi.k = s.k")
def i24(spark, d):
    e, i = F.col("event_id"), F.col("id")
    subs = m.table(spark, d, "events").select(m.text("job-", e).alias("job_id"), e.alias("seq"), m.text("queue-", e % 7).alias("queue"), F.when(e % 10 != 0, m.text("c-", e % 400)).alias("client_id"))
    stored = spark.range(90).select(F.concat(m.text("queue-", i % 7), F.lit(":"), m.text("c-", i % 400)).alias("deduplication_id"), m.text("old-", i).alias("job_id")).groupBy("deduplication_id").agg(F.min("job_id").alias("job_id"))
    return f.find_duplicates(subs, stored)


def _hot_sequences(spark, d):
    """A message per event; one job set holds a third of them."""
    seq = F.col("seq")
    return m.job_event(spark, d).select(
        F.when(seq % 3 == 0, "queue-0").otherwise(F.col("queue")).alias("queue"), F.when(seq % 3 == 0, "hot").otherwise(F.col("jobset")).alias("jobset"), "seq", m.text("u", F.floor(seq / 300)).alias("user"),
        F.array(F.lit("g")).alias("groups"), F.array(seq.cast("string")).alias("events"),
    )


_HOT = ", h AS (SELECT CASE WHEN seq % 3 = 0 THEN 'queue-0' ELSE queue END AS queue, CASE WHEN seq % 3 = 0 THEN 'hot' ELSE jobset END AS jobset, seq, seq // 300 AS g FROM job_event)"


@query("i25_compact_sequences", _HOT + ", o AS (SELECT *, CASE WHEN lag(g) OVER w = g THEN 0 ELSE 1 END AS ch, (row_number() OVER w - 1) // 40 AS piece FROM h WINDOW w AS (PARTITION BY queue, jobset ORDER BY seq)), i AS (SELECT *, sum(ch) OVER (PARTITION BY queue, jobset ORDER BY seq) AS isl FROM o) SELECT queue, jobset, CAST(isl AS BIGINT) AS island, 'u' || min(g) AS \"user\", min(seq) AS seq, max(ch) = 0 AS continues, count(*) AS events, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM i GROUP BY queue, jobset, isl, piece")
def i25(spark, d):
    out = f.compact_sequences(_hot_sequences(spark, d), 40)
    return out.select("queue", "jobset", "island", "user", "seq", "continues", F.size("events").cast("long").alias("events"), F.array_join("events", ",").alias("seqs"))


@query("i26_limit_by_count", ", o AS (SELECT queue, jobset, seq, (row_number() OVER (PARTITION BY queue, jobset ORDER BY seq) - 1) // 8 AS part FROM job_event) SELECT queue, jobset, CAST(part AS INTEGER) AS part, count(*) AS events, min(seq) AS first_seq FROM o GROUP BY queue, jobset, part")
def i26(spark, d):
    parts = f.parts_by_count(m.job_event(spark, d).select("queue", "jobset", "seq"), 8, ["queue", "jobset"])
    return parts.groupBy("queue", "jobset", "part").agg(F.count("*").alias("events"), F.min("seq").alias("first_seq"))


_GREEDY = """, o AS (SELECT queue, jobset, seq, bytes, row_number() OVER (PARTITION BY queue, jobset ORDER BY seq) AS rn FROM job_event),
g AS (SELECT queue, jobset, seq, bytes, rn, CAST(0 AS BIGINT) AS part, bytes AS filled FROM o WHERE rn = 1
UNION ALL SELECT o.queue, o.jobset, o.seq, o.bytes, o.rn, CASE WHEN g.filled > 0 AND g.filled + o.bytes > 64 THEN g.part + 1 ELSE g.part END, CASE WHEN g.filled > 0 AND g.filled + o.bytes > 64 THEN o.bytes ELSE g.filled + o.bytes END FROM g JOIN o ON o.queue = g.queue AND o.jobset = g.jobset AND o.rn = g.rn + 1)
SELECT queue, jobset, seq, bytes, part FROM g"""


_GREEDY_ONE = """, o AS (SELECT seq, bytes, row_number() OVER (ORDER BY seq) AS rn FROM job_event),
g AS (SELECT seq, bytes, rn, CAST(0 AS BIGINT) AS part, bytes AS filled FROM o WHERE rn = 1
UNION ALL SELECT o.seq, o.bytes, o.rn, CASE WHEN g.filled > 0 AND g.filled + o.bytes > 500 THEN g.part + 1 ELSE g.part END, CASE WHEN g.filled > 0 AND g.filled + o.bytes > 500 THEN o.bytes ELSE g.filled + o.bytes END FROM g JOIN o ON o.rn = g.rn + 1)
SELECT part, count(*) AS events, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS first_seq FROM g GROUP BY part"""


@query("i26_limit_one_sequence", _GREEDY_ONE, recursive=True)
def i26_one(spark, d):
    """One sequence that holds the whole log."""
    parts = f.limit_by_bytes(m.job_event(spark, d).select(F.lit("all").alias("jobset"), "seq", "bytes"), 500, ["jobset"])
    return parts.groupBy("part").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.min("seq").alias("first_seq"))


@query("i26_limit_by_bytes", _GREEDY, recursive=True)
def i26_bytes(spark, d):
    return f.limit_by_bytes(m.job_event(spark, d).select("queue", "jobset", "seq", "bytes"), 64, ["queue", "jobset"])


@query("i25_sequence_islands", ", o AS (SELECT *, CASE WHEN lag(g) OVER w = g THEN 0 ELSE 1 END AS ch FROM (SELECT *, seq // 300 AS g FROM job_event) x WINDOW w AS (PARTITION BY queue, jobset ORDER BY seq)) SELECT queue, jobset, seq, CAST(sum(ch) OVER (PARTITION BY queue, jobset ORDER BY seq) AS BIGINT) AS island FROM o")
def i25_islands(spark, d):
    seqs = m.job_event(spark, d).select("queue", "jobset", "seq", m.text("u", F.floor(F.col("seq") / 300)).alias("user"), F.array(F.lit("g")).alias("groups"))
    return f.sequence_islands(seqs).select("queue", "jobset", "seq", "island")


@query("i1_external_uri", "SELECT job_id, coalesce(CASE WHEN seq % 36 <> 0 THEN 'uri-' || (seq % 50) END, CASE WHEN seq % 24 = 0 THEN 'noted-' || (seq % 70) END) AS external_job_uri FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS rn FROM job_event WHERE kind = 'SubmitJob') t WHERE rn = 1")
def i1_uri(spark, d):
    seq = F.col("seq")
    log = m.job_event(spark, d).withColumns({"external_job_uri": F.when(seq % 36 != 0, m.text("uri-", seq % 50)).otherwise(""), "uri_annotation": F.when(seq % 24 == 0, m.text("noted-", seq % 70))})
    return f.create_jobs(log).select("job_id", "external_job_uri")


@query("i7_ingress_and_debug", ", e AS (SELECT *, CASE WHEN seq % 24 = 3 THEN 'ingress' WHEN seq % 24 = 10 THEN 'debug' ELSE kind END AS k2 FROM job_event) SELECT run_id, arg_max('host-' || (seq % 17), seq) FILTER (WHERE k2 = 'ingress') AS address, arg_max(CASE WHEN k2 = 'debug' THEN 'pod ended ' || seq ELSE 'debug of ' || run_id END, seq) FILTER (WHERE k2 = 'debug' OR (k2 = 'JobRunErrors' AND error_kind = 'PodError')) AS debug, max(CASE WHEN k2 = 'JobRunRunning' THEN 1 ELSE 0 END) = 1 AS started FROM e WHERE k2 IN ('ingress', 'debug', 'JobRunAssigned', 'JobRunRunning', 'JobRunSucceeded', 'CancelledJob', 'JobRunPreempted') OR (k2 = 'JobRunErrors' AND error_kind <> 'JobRunPreemptedError') GROUP BY run_id")
def i7_extra(spark, d):
    seq = F.col("seq")
    log = m.job_event(spark, d).withColumn("kind", F.when(seq % 24 == 3, "StandaloneIngressInfo").when(seq % 24 == 10, "JobRunTerminatedDebugInfo").otherwise(F.col("kind")))
    log = log.withColumns({"addresses": F.create_map(F.lit(8080), m.text("host-", seq % 17)), "debug_info": m.text("pod ended ", seq)})
    rows = f.conflate_run_updates(f.run_updates(log))
    return rows.select("run_id", F.try_element_at("ingress_addresses", F.lit(8080)).alias("address"), "debug", F.col("started").isNotNull().alias("started"))


@query("i11_rows_changed", _CONFLATED + _CREATED + _RUN_UPDATES + ", le AS (SELECT DISTINCT run_id FROM job_event WHERE kind = 'JobRunLeased') SELECT 'job' AS \"table\", 'insert' AS operation, count(*) AS rows FROM cre UNION ALL SELECT 'job', 'update', count(*) FROM conf JOIN cre ON cre.job_id = conf.job_id UNION ALL SELECT 'job_run', 'insert', count(*) FROM le UNION ALL SELECT 'job_run', 'update', count(DISTINCT rupd.run_id) FROM rupd JOIN le ON le.run_id = rupd.run_id UNION ALL SELECT 'job_error', 'insert', count(DISTINCT job_id) FROM job_event WHERE kind = 'JobErrors' AND terminal AND error_kind = 'JobRejected'")
def i11_rows(spark, d):
    return f.rows_changed(m.job_event(spark, d))


@query("i15_validated_pools", ", e AS (SELECT *, CASE WHEN seq % 24 = 0 THEN 'JobValidated' ELSE kind END AS k2 FROM job_event) SELECT job_id, bool_or(k2 = 'JobValidated') AS validated, arg_max(pool, seq) FILTER (WHERE k2 = 'JobValidated') AS pool FROM e GROUP BY job_id")
def i15_pools(spark, d):
    log = m.job_event(spark, d).withColumns({"kind": F.when(F.col("seq") % 24 == 0, "JobValidated").otherwise(F.col("kind")), "pools": F.array("pool")})
    return f.fold_scheduler_flags(log)[0].select("job_id", "validated", F.get("pools", F.lit(0)).alias("pool"))


@query("i15_run_attempted", "SELECT run_id, coalesce(bool_or(kind = 'JobRunErrors' AND terminal AND error_kind = 'LeaseReturned' AND exit_code % 2 = 0), FALSE) AS run_attempted FROM job_event GROUP BY run_id")
def i15_attempted(spark, d):
    log = m.job_event(spark, d).withColumn("run_attempted", F.col("exit_code") % 2 == 0)
    return f.fold_scheduler_flags(log)[1].select("run_id", "run_attempted")


_LISTED = """, rq AS (SELECT sjob.queue, sjob.job_set, sjob.job_id, event_id AS seq, event_id % 2 = 0 AS re, event_id % 13 AS priority, CASE WHEN event_id % 3 <> 0 THEN 'u-' || (event_id % 6) END AS usr, CASE WHEN event_id % 4 <> 1 THEN 'r-' || (event_id % 4) END AS reason, event_id % 7 = 0 AS whole FROM events JOIN sjob ON CAST(substr(sjob.job_id, 5, 10) AS BIGINT) = event_id % 3000),
op AS (SELECT rq.* FROM rq JOIN sjob ON sjob.job_id = rq.job_id WHERE NOT whole AND NOT (cancelled OR succeeded OR failed)
UNION ALL SELECT rq.queue, rq.job_set, sjob.job_id, seq, re, rq.priority, usr, reason, whole FROM rq JOIN sjob ON sjob.queue = rq.queue AND sjob.job_set = rq.job_set WHERE whole AND NOT (cancelled OR succeeded OR failed)),
a AS (SELECT job_id, arg_max(priority, seq) AS priority, max(seq) AS s FROM op WHERE re GROUP BY job_id), au AS (SELECT DISTINCT a.job_id, a.priority, op.usr FROM a JOIN op ON op.job_id = a.job_id AND op.seq = a.s),
c AS (SELECT job_id, arg_min(usr, seq) FILTER (WHERE usr IS NOT NULL) AS usr, arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason, bool_or(whole) AS by_set FROM op WHERE NOT re GROUP BY job_id)
SELECT sjob.job_id, coalesce(au.priority, sjob.priority) AS priority, au.usr AS reprioritise_user, c.job_id IS NOT NULL AS cancel_requested, coalesce(c.by_set, FALSE) AS cancel_by_jobset_requested, c.usr AS cancel_user, c.reason AS cancel_reason FROM sjob LEFT JOIN au ON au.job_id = sjob.job_id LEFT JOIN c ON c.job_id = sjob.job_id"""


@query("i16_job_lists", _LISTED)
def i16_lists(spark, d):
    e = F.col("event_id")
    jobs = m.scheduler_jobs(spark, d)
    named = m.table(spark, d, "events").withColumn("job_id", F.concat(F.lit("job-"), F.lpad((e % 3000).cast("string"), 10, "0"))).join(jobs.select("job_id", "queue", "job_set"), "job_id")
    requests = named.select(
        "queue", "job_set", e.alias("seq"), F.when(e % 2 == 0, "reprioritise").otherwise("cancel").alias("action"), (e % 13).alias("priority"), F.when(e % 3 != 0, m.text("u-", e % 6)).alias("user"), F.when(e % 4 != 1, m.text("r-", e % 4)).alias("reason"),
        F.lit(None).cast("string").alias("states"), F.when(e % 7 != 0, F.array("job_id")).alias("job_ids"),
    )
    return f.apply_jobset_updates(jobs, requests).select("job_id", "priority", "reprioritise_user", "cancel_requested", "cancel_by_jobset_requested", "cancel_user", "cancel_reason")
