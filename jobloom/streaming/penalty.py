"""The penalty of short jobs as it comes and lapses (W8, F10): keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENTRY = "job_id string, pool string, queue string, at long, sign int, cpu double, memory double, gpu double"
_HELD = ("job_id", "pool", "queue", "deadline", "cpu", "memory", "gpu")
STATE = "job_id array<string>, pool array<string>, queue array<string>, deadline array<long>, cpu array<double>, memory array<double>, gpu array<double>"
_NAMES = [c.split(" ")[0] for c in ENTRY.split(", ")]


def penalty_entries(finished: DataFrame, cutoffs: Mapping[str, int], lateness: str, buckets: int = 256) -> DataFrame:
    """A stream of entries: a job's resources with sign 1 when its end is reported, and with sign -1 when its penalty lapses.

    ``finished``: job_id, queue, pool, started (epoch seconds), at (timestamp of the report), cpu, memory, gpu; jobs that were
    preempted or have no start aren't in it. A job counts if it is reported less than its pool's cutoff after its start, once however
    often it is reported, and until its start plus the cutoff, when a timer on the watermark ends it. The state holds the jobs that
    count just now and no others; pools without a cutoff have no penalty. Jobs are held by ``buckets`` of their id's hash, since a call
    for each job costs far more than its work; a bucket's timer is that of its job that lapses next. The number of buckets is fixed when a
    stream is begun: so many that each holds some ten thousand jobs at most.
    """
    limit = F.coalesce(*[F.when(F.col("pool") == pool, seconds) for pool, seconds in cutoffs.items()]).cast("long")
    rows = finished.withWatermark("at", lateness).withColumn("deadline", F.col("started") + limit).where(F.unix_timestamp("at") < F.col("deadline"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(_HELD, state.get if state.exists else [[]] * len(_HELD)))).astype({"deadline": "int64"})
        mark, out = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            first = pd.concat(list(batches)).sort_values("seconds", kind="stable").drop_duplicates("job_id")
            new = first[(first["deadline"] * 1000 > mark) & ~first["job_id"].isin(held["job_id"])]
            out.append(new.assign(at=new["seconds"], sign=1))
            held = pd.concat([held, new[list(_HELD)]]) if len(held) else new[list(_HELD)]
        over = held["deadline"] * 1000 <= mark
        out.append(held[over].assign(at=held["deadline"][over], sign=-1))
        held = held[~over]
        if len(held):
            state.update(tuple(held[c].tolist() for c in _HELD))
            state.setTimeoutTimestamp(int(held["deadline"].min()) * 1000)
        elif state.exists:
            state.remove()
        yield from (rows[_NAMES] for rows in out if len(rows))

    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket")
    out = rows.select(bucket, "job_id", "pool", "queue", "at", F.unix_timestamp("at").alias("seconds"), "deadline", *[F.col(c).cast("double").alias(c) for c in ("cpu", "memory", "gpu")])
    return out.groupBy("bucket").applyInPandasWithState(step, ENTRY, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def penalty_at(entries: DataFrame, now: int) -> DataFrame:
    """Per pool and queue the penalty at a time that the stream's watermark has passed: the sum of all entries up to then."""
    sums = [F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("cpu", "memory", "gpu")]
    return entries.where(F.col("at") <= now).groupBy("pool", "queue").agg(F.sum("sign").alias("jobs"), *sums).where("jobs > 0")
