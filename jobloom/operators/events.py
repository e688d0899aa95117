"""The event log itself: reading, exploding, exports, API events, watching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.ordering import with_running_sum

# fixed values: longest column values
LIMITS = {"queue": 512, "user": 512, "jobset": 1024, "priority_class": 63, "cluster": 512, "node": 512}

EVENT = T.StructType([T.StructField("created", T.TimestampType()), T.StructField("kind", T.StringType()), T.StructField("job_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("priority", T.LongType())])
EVENT_SEQUENCE = T.StructType([
    T.StructField("queue", T.StringType()), T.StructField("jobset", T.StringType()), T.StructField("user", T.StringType()), T.StructField("groups", T.ArrayType(T.StringType())),
    T.StructField("publish_time", T.TimestampType()), T.StructField("partition", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("events", T.ArrayType(EVENT)),
])


def fill_created(seqs: DataFrame) -> DataFrame:
    """Events without a time take the publish time of their message."""
    return seqs.withColumn("events", F.transform("events", lambda e: e.withField("created", F.coalesce(e["created"], F.col("publish_time")))))


def read_event_log(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Event sequences from Parquet, as a table or as a stream with at most ``max_files`` files a batch."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return fill_created(reader.schema(EVENT_SEQUENCE).parquet(path))


def explode_events(seqs: DataFrame) -> DataFrame:
    """One row per event with its place (seq, pos); texts are cut to their column, events still without time go."""
    rows = seqs.select(F.substring("queue", 1, LIMITS["queue"]).alias("queue"), F.substring("jobset", 1, LIMITS["jobset"]).alias("jobset"), F.substring(F.trim("user"), 1, LIMITS["user"]).alias("user"), "seq", F.posexplode("events").alias("pos", "e"))
    return rows.select("queue", "jobset", "user", "seq", "pos", "e.*").where("created is not null")


def finished_runs(job: DataFrame, events: DataFrame) -> DataFrame:
    """One row per end of a job with its resources and times."""
    state = F.when(F.col("kind") == "CancelledJob", "CANCELLED").when(F.col("kind") == "JobSucceeded", "SUCCEEDED").when(F.col("kind") == "JobRunPreempted", "PREEMPTED")
    ends = events.select("job_id", state.alias("state"), F.col("created").alias("finished")).where("state is not null")
    scheduled = events.where("kind = 'JobRunLeased'").groupBy("job_id").agg(F.max("created").alias("scheduled"))
    return ends.join(scheduled, "job_id", "left").join(job, "job_id")


def to_event_store(events: DataFrame) -> DataFrame:
    """Events for readers of a job set: cancellation reasons blanked, in log order."""
    return events.withColumn("reason", F.when(F.col("kind").isin("CancelJob", "CancelJobSet", "CancelledJob"), "").otherwise(F.col("reason"))).drop("groups")


def compacted(events: DataFrame, most: int = 10_000) -> DataFrame:
    """The event store's rows: a job set's events in pieces of ``most``, in log order.

    Rows (queue, jobset, seq, last, events): the places of the first and the last event, and the events as structs. Places within a
    job set come from running counts over ranges, so a job set of any share of the log is spread over as many tasks as it has pieces.
    """
    rest = [c for c in events.columns if c not in ("queue", "jobset")]
    counted = with_running_sum(events.withColumn("_one", F.lit(1).cast("long")), "_one", "seq", running="_n", within=("queue", "jobset"))
    whole = F.array_sort(F.collect_list(F.struct("seq", *[c for c in rest if c != "seq"])))
    pieces = counted.groupBy("queue", "jobset", F.floor((F.col("_n") - 1) / most).alias("_piece")).agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), whole.alias("events"))
    return pieces.drop("_piece")


def write_event_store(events: DataFrame, path: str, most: int = 10_000) -> None:
    """Compacted pieces below ``path``, those of a job set next to each other and in order."""
    compacted(to_event_store(events), most).repartitionByRange("queue", "jobset", "seq").sortWithinPartitions("queue", "jobset", "seq").write.partitionBy("queue").parquet(path)


def read_event_store(spark: SparkSession, path: str, queue: str | None = None, jobset: str | None = None, after: int | None = None) -> DataFrame:
    """The stored events, of all or one job set, after a place in the log; pieces that end before it aren't opened."""
    rows = spark.read.parquet(path)
    for c, value in (("queue", queue), ("jobset", jobset)):
        rows = rows if value is None else rows.where(F.col(c) == value)
    rows = rows if after is None else rows.where(F.col("last") > after)
    out = rows.select("queue", "jobset", F.explode("events").alias("_e")).select("queue", "jobset", "_e.*")
    return out if after is None else out.where(F.col("seq") > after)


def to_api_events(events: DataFrame) -> DataFrame:
    """Each log event as none, one or two user events."""
    kind, error = F.col("kind"), F.col("error_kind")
    one = lambda name, retryable=None: F.array(F.struct(F.lit(name).alias("api_kind"), F.lit(retryable).cast("boolean").alias("retryable")))
    failed = F.array(F.struct(F.lit("failed").alias("api_kind"), (~F.col("terminal")).alias("retryable")))
    names = {"JobRunLeased": "leased", "JobRunAssigned": "pending", "JobRunRunning": "running", "JobSucceeded": "succeeded", "CancelledJob": "cancelled", "ReprioritisedJob": "reprioritized", "JobRunPreempted": "preempted"}
    out = F.when(kind == "SubmitJob", F.concat(one("submitted"), one("queued")))
    for k, name in names.items():
        out = out.when(kind == k, one(name))
    out = out.when((kind == "JobRunErrors") & (error == "LeaseExpired"), one("lease_expired")).when((kind == "JobRunErrors") & (error == "LeaseReturned"), one("lease_returned")).when((kind == "JobErrors") & (error == "JobRunPreemptedError"), one("preempted")).when(kind == "JobErrors", failed)
    return events.where(out.isNotNull()).select("queue", "jobset", "job_id", "created", "seq", F.posexplode(out).alias("subseq", "x"), "reason").select("queue", "jobset", "job_id", "created", "seq", "subseq", "x.*", "reason")


def read_after(api: DataFrame, queue: str, jobset: str, last_id: str = "", limit: int = 0) -> DataFrame:
    """A job set's messages strictly after ``time:seq:subseq:last`` in order, each with its own id."""
    rows = api.where((F.col("queue") == queue) & (F.col("jobset") == jobset))
    if last_id:
        time, seq, subseq, _ = last_id.split(":")
        at = F.struct(F.col("created").cast("long"), F.col("seq").cast("long"), F.col("subseq").cast("long"))
        rows = rows.where(at > F.struct(F.lit(int(time)).cast("long"), F.lit(int(seq)).cast("long"), F.lit(int(subseq)).cast("long")))
    order = Window.partitionBy("created", "seq").orderBy("subseq")
    rows = rows.withColumn("last", F.lead("subseq").over(order).isNull()).orderBy("created", "seq", "subseq")
    rows = rows.withColumn("id", F.concat_ws(":", F.col("created").cast("string"), F.col("seq").cast("string"), F.col("subseq").cast("string"), F.when(F.col("last"), "1").otherwise("0")))
    return rows.limit(limit) if limit else rows


def watch_summary(api: DataFrame) -> DataFrame:
    """Each job's latest status by time, later log entries between equals; those out of order are ignored."""
    status = (
        F.when(F.col("api_kind").isin("submitted", "queued", "lease_returned", "lease_expired"), "queued").when((F.col("api_kind") == "failed") & F.col("retryable"), "queued")
        .when(F.col("api_kind").isin("leased", "pending", "running", "succeeded", "failed", "cancelled", "preempted"), F.col("api_kind"))
    )
    rows = api.withColumn("status", status).where("status is not null")
    return rows.groupBy("queue", "jobset", "job_id").agg(F.max_by("status", F.struct("created", "seq", "subseq")).alias("status"), F.max("created").alias("updated"))


def event_gap_stats(events: DataFrame) -> DataFrame:
    """Seconds from each event of a job to its next, per kind; variance 0 below two samples."""
    order = Window.partitionBy("job_id").orderBy("seq")
    rows = events.select("kind", (F.lead("created").over(order) - F.col("created")).alias("gap")).where("gap is not null")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("gap").alias("min"), F.max("gap").alias("max"), F.avg("gap").alias("mean"), F.coalesce(F.var_samp("gap"), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp("gap"), F.lit(0.0)).alias("stddev"))
