"""Snapshots with manifests, and the staging mirror."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def filtered_snapshot(raw: DataFrame, condition: Column, path: str) -> None:
    """The wanted rows of a bulk file as tab-separated text; the filter runs in the scan's tasks."""
    raw.filter(condition).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


#: Files up to this many bytes are digested from their content as one value, larger ones in pieces of CHUNK bytes.
WHOLE, CHUNK = 128 << 20, 8 << 20


def _open(path: str) -> BinaryIO:
    """A file by its address as Spark lists it, not escaped, read in order."""
    if path.startswith("file:"):
        return open(re.sub("^file:/+", "/", path), "rb")
    system, place = pa.fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(place)


def digests(spark: SparkSession, path: str, opener: Callable[[str], BinaryIO] = _open, whole: int = WHOLE) -> DataFrame:
    """(path, size, sha256) of each file, whatever its size.

    Sizes come from the listing.  Files up to `whole` bytes are read by Spark's own source; larger ones are
    streamed by the tasks, one file each, in pieces of CHUNK bytes from what `opener` returns (by default
    local and mounted paths, and the object stores that Arrow knows), so that memory does not follow the size.
    Spark's listing leaves out empty files, and so does this.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.select("path", "length").filter(F.col("length") > whole)
    n = large.count()
    if not n:
        return small

    def run(batches):
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest = hashlib.sha256()
                with opener(name) as stream:
                    while piece := stream.read(CHUNK):
                        digest.update(piece)
                yield pa.RecordBatch.from_pydict({"path": [name], "size": [size], "sha256": [digest.hexdigest()]})

    # The listing is small; by ranges of its order, each task has about one file.
    dealt = large.repartitionByRange(min(n, 10_000), "path")
    return small.unionByName(dealt.mapInArrow(run, "path string, size long, sha256 string"))


def manifest(spark: SparkSession, path: str, source: str, url: str, day: str, rows: DataFrame | None = None, notes: str = "") -> DataFrame:
    """(source, source_url, capture_date, path, sha256, size, row_count, notes), one row for each file of any
    size; see digests().  row_count is of all files together, null without `rows`."""
    n = rows.count() if rows is not None else None
    return digests(spark, path).select(F.lit(source).alias("source"), F.lit(url).alias("source_url"), F.to_date(F.lit(day)).alias("capture_date"), "path", "sha256", "size", F.lit(n).cast("long").alias("row_count"), F.lit(notes).alias("notes"))


def verify_manifest(spark: SparkSession, path: str, recorded: DataFrame) -> DataFrame:
    """(path, status): `changed`, `missing` and `unrecorded` files; none if all are as recorded."""
    now = digests(spark, path).select("path", F.col("sha256").alias("now"))
    both = recorded.select("path", "sha256").join(now, "path", "full")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "unrecorded").when(F.col("now") != F.col("sha256"), "changed")
    return both.select("path", status.alias("status")).filter(F.col("status").isNotNull())


def mirror(raw: DataFrame, path: str, day: str) -> None:
    """Raw rows one to one under a date that can be written once."""
    raw.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/capture_date={day}")


def materialise(stages: list[tuple[str, object]], root: str, spark: SparkSession, cluster: str = "place") -> dict[str, DataFrame]:
    """Runs stages (name, function of the tables so far) in order; each is written and read again by those
    after it, so that a rebuilt table never meets a stale one.  Tables of days are written by year, each
    task's rows sorted by `cluster` and day as its shuffle left them: no year is gathered in one task."""
    done: dict[str, DataFrame] = {}
    for name, build in stages:
        df = build(done)
        path = f"{root.rstrip('/')}/{name}"
        if {"day", cluster} <= set(df.columns):
            dated = df.withColumn("part_year", F.year("day")).sortWithinPartitions("part_year", cluster, "day")
            dated.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part_year").parquet(path)
            done[name] = spark.read.parquet(path).drop("part_year")
        else:
            df.write.mode("overwrite").parquet(path)
            done[name] = spark.read.parquet(path)
    return done
