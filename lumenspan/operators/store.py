"""Materialising a DataFrame where a lost executor can't take it away."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; on one machine, one of our own where that is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lumenspan-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder goes with the cluster's clean-up
        return


#: Tables of more rows than these are never broadcast. Files of like rows are a hundredth of what the rows take in memory, and Spark
#: goes by the files.
LARGE = 100_000


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, removed when the driver exits. Joins shuffle it where it is LARGE."""
    return counted(df)[0]


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """stored(df) and aggregates of its rows, n their number, made while they are written: one job."""
    spark, seen = df.sparkSession, Observation()
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in counts.items())).write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if seen.get["n"] > LARGE else out, seen.get
