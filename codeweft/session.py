"""Session helpers: where lineage is cut, table reading, codec of executor functions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import codeweft

# Executors need no copy of the package: its functions travel by value.
cloudpickle.register_pickle_by_value(codeweft)


def steady(spark: SparkSession) -> SparkSession:
    """The session without one rule of Spark 4.1: a union that takes over its inputs'
    partitioning is joined without a shuffle, but adaptive execution may have coalesced the
    inputs differently; the join then ends with "Can't zip RDDs with unequal numbers of partitions"."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return steady(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place the cluster shares; a temporary one only where it names none and
    all runs on one machine (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codeweft-")
        sc.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared folder: survives lost executors, cuts lineage, and
    has a known size. The folder goes when the application ends."""
    spark = steady(df.sparkSession)
    path = shared_folder(spark, "table")
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table that ``checkpointed`` wrote and that nothing reads any more; the shuffle files
    that made it go with it, for Spark frees them when the driver collects their plans."""
    for file in df.inputFiles()[:1]:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    df.sparkSession._jvm.System.gc()
