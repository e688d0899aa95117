"""Reading the given tables and writing intermediate ones where every executor sees them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; ``sf_dir`` may be any path or URI that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, a temporary one, but only on one machine."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not conf and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(conf or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


_WRITTEN: set[str] = set()


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed, and what is read again prunes columns. Results are lazy
    and may read such a table whenever they run, so its files stay until ``discard``, ``discard_all`` or the end of this process.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table")
    if not _WRITTEN:
        atexit.register(discard_all, spark)
    _WRITTEN.add(path)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing will read again."""
    for df in tables:
        fs, path = file_system(df.sparkSession, df.written_to)
        fs.delete(path, True)
        _WRITTEN.discard(df.written_to)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that ``materialise`` has written in this process, once no result is still to be read."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = _WRITTEN.pop()
        try:
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(there, True)
        except (Py4JError, OSError):  # the JVM has gone before
            _WRITTEN.clear()
