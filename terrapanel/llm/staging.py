"""Places that every executor can reach, and small helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []

#: Bytes of rows that Spark puts into one Arrow batch for Python, and so holds off the heap at once.
BATCH_BYTES = "4m"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append(Path(tempfile.mkdtemp(prefix="spark-shared-")).as_uri())
        named = _own[0]
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and no executor's
    local disk holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def staged_folder(spark: SparkSession, name: str) -> str:
    """A folder for files that tasks write and read themselves; released like a table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged_so_far() -> int:
    return len(_written)


def release(since: int = 0) -> None:
    """Removes what was staged after `since` tables, but for the last one; to be called when only that is
    still read.  With no argument and once results are written, it removes all but the last table."""
    gone, _written[since:] = _written[since:-1], _written[-1:] if len(_written) > since else []
    for spark, path in gone:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Limits Arrow batches to BATCH_BYTES where the session has no limit of its own: texts can be long, and
    a batch of 10,000 of them is held several times, in the executor and in its Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of at most `rows` rows for Python in what runs inside, where a row can be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column cast to kind, or nulls where the table has no such column."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of numpy or Arrow columns in the schema's order and types."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(k).type) for k, c in ((f.name, columns[f.name]) for f in schema)], schema=schema
    )
