"""Watching jobs by their API events (W5): each job's status from its own events and its pods', and counts by status.

A job's status follows its events in log order; those older than what the job has seen are ignored, and a pod's are compared with
that pod's. A pod event sets the job from all of its pods: failed before pending before running before succeeded. The same fold
serves a table, whose jobs are read in order with one state in memory at a time, and a stream, whose state is kept per job. Both
tell changes of status; counts by status are sums over them, plus one for the status that a job has now and minus one for the one
that it had, so they are kept up to date without looking at jobs that didn't change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ("queue", "jobset", "job_id")
#: The jobs of a bucket, a place each in every array but the last two: those have all pods, ``pods`` of each job in turn. Times are epoch seconds.
STATE = "queue array<string>, jobset array<string>, job_id array<string>, status array<string>, updated array<long>, pods array<int>, pod_status array<string>, pod_updated array<long>"
CHANGE = "queue string, jobset string, job_id string, seq long, subseq int, before string, status string, updated long, pods long, pods_running long"
_POD = {"pending": "pending", "running": "running", "failed": "failed", "succeeded": "succeeded"}
_JOB = {"submitted": "submitted", "queued": "queued", "leased": "leased", "lease_returned": "queued", "lease_expired": "queued", "cancelled": "cancelled"}


class WatchedJob:
    """The state of one job."""

    def __init__(self, status: str | None = None, updated: int = 0, pod_status: Iterable[str] = (), pod_updated: Iterable[int] = ()):
        self.status, self.updated, self.pod_status, self.pod_updated = status, updated, list(pod_status), list(pod_updated)

    def state(self) -> tuple:
        return self.status, self.updated, self.pod_status, self.pod_updated

    def _pods(self, n: int) -> None:
        while len(self.pod_status) < n:
            self.pod_status.append("submitted")
            self.pod_updated.append(0)

    def _reset(self) -> None:
        self.pod_status, self.pod_updated = ["submitted"] * len(self.pod_status), [0] * len(self.pod_status)

    def take(self, kind: str, created: int, retryable: bool | None, pod: int, pods: int) -> None:
        """One API event; ``pods`` is the number of pods that a submission names."""
        if kind in _JOB:
            if self.updated > created:
                return
            self.updated, self.status = created, _JOB[kind]
            if kind == "submitted":
                self._pods(pods)
            elif kind in ("lease_returned", "lease_expired"):
                self._reset()
        elif kind == "failed" and retryable:
            self.status = "queued"
            self._reset()
        elif kind in _POD:
            self._pods(pod + 1)
            if self.pod_updated[pod] > created:
                return
            self.pod_updated[pod], self.pod_status[pod] = created, _POD[kind]
            if self.updated > max(self.pod_updated):
                return
            self.updated = max(self.pod_updated)
            self.status = next((s for s in ("failed", "pending", "running") if s in self.pod_status), "succeeded")


_TOLD = (*KEY, "api_kind", "created", "retryable", "pod", "pods", "seq", "subseq")


def _fold(rows: pd.DataFrame, job_of: Callable[[tuple], WatchedJob]) -> Iterator[tuple]:
    """The changes of status that the next events make, a job's in their order; ``job_of`` gives the state of a job."""
    for *key, kind, created, retryable, pod, pods, seq, subseq in rows[list(_TOLD)].itertuples(index=False, name=None):
        job = job_of(tuple(key))
        before = job.status
        job.take(kind, int(created), retryable is True or retryable == 1, int(pod), int(pods))
        if job.status != before:
            yield *key, int(seq), int(subseq), before, job.status, job.updated, len(job.pod_status), job.pod_status.count("running")


def _jobs_of(state: tuple) -> dict[tuple, WatchedJob]:
    """The jobs of a bucket's state."""
    *keys, status, updated, pods, pod_status, pod_updated = state
    ends = list(accumulate(pods, initial=0))
    return {key: WatchedJob(s, u, pod_status[i:j], pod_updated[i:j]) for key, s, u, i, j in zip(zip(*keys), status, updated, ends, ends[1:])}


def _state_of(jobs: dict[tuple, WatchedJob]) -> tuple:
    all_ = list(jobs.values())
    keys = [[key[k] for key in jobs] for k in range(len(KEY))]
    return *keys, [j.status for j in all_], [j.updated for j in all_], [len(j.pod_status) for j in all_], [x for j in all_ for x in j.pod_status], [x for j in all_ for x in j.pod_updated]


def _events(api: DataFrame) -> DataFrame:
    """The events that matter to a status, with a job's only pod where the log names none."""
    column = lambda c, default: F.coalesce(F.col(c) if c in api.columns else F.lit(None), F.lit(default)).cast("int").alias(c)
    wanted = F.col("api_kind").isin(*_JOB, *_POD)
    return api.where(wanted).select(*KEY, "seq", "subseq", "created", "api_kind", F.coalesce("retryable", F.lit(False)).alias("retryable"), column("pod", 0), column("pods", 1))


def status_changes(api: DataFrame) -> DataFrame:
    """Every change of a job's status in the log, in order.

    ``api``: queue, jobset, job_id, seq, subseq, created (epoch seconds), api_kind, retryable; pod (number) and pods (of a submission)
    if jobs have several. A task reads its jobs' events in order and keeps the state of one, so that no job's history is gathered.
    """
    order = (*KEY, "seq", "subseq")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, job = None, WatchedJob()

        def job_of(key: tuple) -> WatchedJob:
            nonlocal at, job
            if key != at:
                at, job = key, WatchedJob()
            return job

        for batch in batches:
            yield pd.DataFrame(list(_fold(batch, job_of)), columns=_names(CHANGE))

    return _events(api).repartition(*KEY).sortWithinPartitions(*order).mapInPandas(walk, CHANGE)


def _names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def stream_status_changes(api: DataFrame, buckets: int = 256) -> DataFrame:
    """The same changes of a stream, whose micro-batches follow each other in log order; the state is a few values per job.

    Jobs are held by ``buckets`` of their key's hash, since a call for each job costs far more than its work. The number of buckets is
    fixed when a stream is begun: so many that each holds some ten thousand jobs, and some hundred thousand events of a batch, at most.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = _jobs_of(state.get) if state.exists else {}

        def job_of(key: tuple) -> WatchedJob:
            return jobs.get(key) or jobs.setdefault(key, WatchedJob())

        rows = pd.concat(list(batches)).sort_values(["seq", "subseq"])
        out = pd.DataFrame(list(_fold(rows, job_of)), columns=_names(CHANGE))
        state.update(_state_of(jobs))
        yield out

    rows = _events(api).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    return rows.groupBy("bucket").applyInPandasWithState(step, CHANGE, STATE, "append", GroupStateTimeout.NoTimeout)


def watched_jobs(changes: DataFrame) -> DataFrame:
    """Each job's last status with its time and pods, from its changes."""
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct("status", "updated", "pods", "pods_running"), F.struct("seq", "subseq")).alias("s"))
    return last.select(*KEY, "s.*")


def status_counts(changes: DataFrame, *by: str) -> DataFrame:
    """Jobs by status, by retraction: what a job was is taken from the count that it enters another."""
    moves = F.array(F.struct(F.col("status").alias("status"), F.lit(1).alias("n")), F.struct(F.col("before").alias("status"), F.lit(-1).alias("n")))
    return changes.select(*by, F.explode(moves).alias("m")).where("m.status is not null").groupBy(*by, F.col("m.status").alias("status")).agg(F.sum("m.n").alias("jobs")).where("jobs > 0")


def max_used(usage: DataFrame) -> DataFrame:
    """The greatest use of each resource by each job, from its reports; a table or a stream."""
    return usage.groupBy("job_id", "resource").agg(F.max("used").alias("used"))
