"""Idempotent merges of a source into a target by key; plain Parquet has no MERGE.

Each gives the table as it should be; publish() writes it beside the old one and then swaps.  Keys must be
unique and not null on both sides: primary_key_violations() tells, and a null key never matches, so that
its row would be added again by each run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows, and target rows whose key the source has not."""
    rest = target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns)
    return source.select(*target.columns).unionByName(rest)


def upsert_preserving(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """New keys from the source; known keys take its `update` columns and keep all others."""
    s = source.select(*target.columns, F.lit(True).alias("_in_source")).alias("s")
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    on = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    joined = t.join(s, on, "full")

    def value(c: str):
        if c in keys:
            return F.coalesce(f"t.{c}", f"s.{c}")
        if c in update:
            return F.when(F.col("s._in_source").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))
        return F.when(F.col("t._in_target").isNotNull(), F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))

    return joined.select(*(value(c).alias(c) for c in target.columns))


def insert_missing(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target, and source rows whose key it has not."""
    return target.unionByName(source.select(*target.columns).join(target.select(*keys), list(keys), "left_anti").select(*target.columns))


def update_existing(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """The target with `update` columns from the source where it has the key; no new rows."""
    s = source.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in update), F.lit(True).alias("_hit"))
    joined = target.join(s, list(keys), "left")
    return joined.select(*(F.when(F.col("_hit").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns))


def with_constant(rows: DataFrame, column: str, value) -> DataFrame:
    """rows with a column of one value."""
    return rows.withColumn(column, F.lit(value))


def publish(table: DataFrame, path: str) -> None:
    """Writes a table that may have been computed from what lies at path: first beside it, then in its
    place, by renames.  A run that ended between the renames has left the old table beside its place; it is
    put back by recover(), which readers and the next publish() call first."""
    spark = table.sparkSession
    recover(spark, path)
    new, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    table.write.mode("overwrite").parquet(new)
    at, fs = _files(spark, path)
    if fs.exists(at(path)):
        fs.delete(at(old), True)
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)
    spark.catalog.refreshByPath(path)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back a table that publish() had moved aside and not replaced; whether there was one."""
    at, fs = _files(spark, path)
    old = f"{path.rstrip('/')}__old"
    return not fs.exists(at(path)) and fs.exists(at(old)) and fs.rename(at(old), at(path))


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
