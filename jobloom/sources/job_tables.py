"""The stored job tables (S3): their columns, and writing and reading them with a layout for look-ups and retention."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources.model import ACTIVE_STATES


def _columns(ddl: str) -> dict[str, str]:
    return dict(column.split(" ", 1) for column in ddl.split(", "))


#: Columns of each table; times are epoch seconds.
SCHEMAS = {
    "job": _columns(
        "job_id string, queue string, owner string, namespace string, jobset string, cpu long, memory long, ephemeral_storage long, gpu long, priority long, submitted long, cancelled long, state short, last_transition_time long, "
        "latest_run_id string, cancel_reason string, cancel_user string, priority_class string, annotations map<string,string>, external_job_uri string"
    ),
    "job_run": _columns(
        "run_id string, job_id string, cluster string, node string, pool string, leased long, pending long, started long, finished long, job_run_state short, error string, debug string, exit_code int, termination_reason string, "
        "failure_category string, failure_subcategory string"
    ),
    "job_spec": _columns("job_id string, job_spec binary"),
    "job_error": _columns("job_id string, error string"),
}
def _active(name: str) -> Column | None:
    """Whether a row may still change."""
    return F.col("state").isin(*ACTIVE_STATES) if name == "job" else F.col("finished").isNull() if name == "job_run" else None


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order and type; those that ``df`` lacks are null, others go."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in SCHEMAS[name].items()])


def write_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Write any of the tables below ``path``.

    Rows of one job lie together and in order, so that a look-up by job_id skips most row groups and joins by it find
    their rows near each other. Active rows have a folder of their own.
    """
    for name, df in tables.items():
        rows = conform(df, name).repartition("job_id")
        active = _active(name)
        if active is None:
            rows.sortWithinPartitions("job_id").write.mode(mode).parquet(f"{path}/{name}")
        else:
            rows.withColumn("active", active).sortWithinPartitions("active", "job_id").write.mode(mode).partitionBy("active").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, active: bool | None = None, names: tuple[str, ...] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The tables below ``path``; with ``active`` only that side of jobs and runs, of which no other file is opened."""
    out = {}
    for name in names:
        split = _active(name) is not None
        columns = SCHEMAS[name] | ({"active": "boolean"} if split else {})
        df = spark.read.schema(", ".join(f"{c} {kind}" for c, kind in columns.items())).parquet(f"{path}/{name}")
        out[name] = (df.where(F.col("active") == active) if split and active is not None else df).drop("active")
    return out
