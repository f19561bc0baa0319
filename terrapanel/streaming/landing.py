"""Files that keep arriving, mirrored one to one and merged by key, each file once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrapanel.sources.store import PartStore, create_keyed, merge_all


def mirror_arrivals(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, separator: str = ",") -> StreamingQuery:
    """Every file that has arrived in `source` since the last run, as Parquet under its day of arrival;
    the checkpoint sees to it that a file is taken once, however often a run is repeated."""
    raw = spark.readStream.schema(schema).option("header", True).option("sep", separator).csv(source)
    dated = raw.withColumn("capture_date", F.current_date())
    return dated.writeStream.format("parquet").partitionBy("capture_date").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, keys: Sequence[str], newest: str, buckets: int = 64) -> StreamingQuery:
    """Upserts arriving Parquet rows into a stored table of `buckets` hash buckets, of several rows of a key the
    one with the largest `newest` (ties: the greatest row).  Rows with a null in a key stay out: they are no
    row's keys.  Only the buckets of the arrived keys are rewritten; a batch that is run again, after a stop
    anywhere, gives the same table."""
    schema = spark.read.parquet(source).schema

    def merge(batch: DataFrame, _: int) -> None:
        session, columns = batch.sparkSession, batch.columns
        rows = batch.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(F.struct(F.col(newest).alias("_newest"), *columns)).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in columns))
        store = PartStore(session, target)
        if not store.exists():
            create_keyed(session, target, rows.limit(0), keys, buckets)
        merge_all(store, rows)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
