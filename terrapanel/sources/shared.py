"""Tables written once where every executor reads them, for jobs that pass over a result often."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: list[str] = []

#: Bytes of rows that Spark puts into one Arrow batch for Python.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to BATCH_BYTES where the session has no limit of its own: a batch of 10,000 long texts is
    held several times in a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where one
    machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(Path(tempfile.mkdtemp(prefix="spark-shared-")).as_uri())
        named = _own[0]
    return named.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_apart(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """kept() in two folders, of the rows for which condition holds and of the others, so that neither is read for the other."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writers = "spark.sql.maxConcurrentOutputFileWriters"  # a task has both files open, and its rows are not sorted for that
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        df.withColumn("_apart", F.coalesce(condition, F.lit(False))).write.partitionBy("_apart").parquet(path)
    finally:
        spark.conf.set(writers, before)
    both = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_apart", T.BooleanType())])).parquet(path)
    return both.filter("_apart").drop("_apart"), both.filter("not _apart").drop("_apart")
