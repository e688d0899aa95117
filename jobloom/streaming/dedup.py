"""Submissions by their deduplication id as they come (I24, P2): keyed state that forgets an id after its lifetime."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "deduplication_id string, job_id string, original_job_id string, is_duplicate boolean"


def with_originals(submissions: DataFrame, lifetime: int, lateness: str) -> DataFrame:
    """A stream of submissions with the job that first had their id, and whether that is another one.

    ``submissions``: deduplication_id, job_id, seq, at (timestamp), in log order from one batch to the next. An id is stored with the time
    of its first submission; one that comes ``lifetime`` seconds later or more is a first one again. A timer on the watermark
    (``lateness`` behind the latest time) drops ids that nothing can meet any more, so the state holds a lifetime's ids. Without an id a
    submission is no duplicate of any, and passes by the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        job, stored = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for own, at in zip(rows["job_id"], rows["second"]):
            if job is None or at >= stored + lifetime:
                job, stored = own, int(at)
            out.append((key[0], own, job, job != own))
        state.update((job, stored))
        state.setTimeoutTimestamp(max((stored + lifetime) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["deduplication_id", "job_id", "original_job_id", "is_duplicate"])

    rows = submissions.withWatermark("at", lateness)
    keyed = rows.where("deduplication_id is not null").select("deduplication_id", "job_id", "seq", "at", F.unix_timestamp("at").alias("second"))
    met = keyed.groupBy("deduplication_id").applyInPandasWithState(step, RESULT, "job_id string, stored long", "append", GroupStateTimeout.EventTimeTimeout)
    free = rows.where("deduplication_id is null").select("deduplication_id", "job_id", F.col("job_id").alias("original_job_id"), F.lit(False).alias("is_duplicate"))
    return met.unionByName(free)
