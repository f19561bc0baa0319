"""Tables stored and joined by place, so that what concerns one place is always in one task.

Rows of a place and day are joined on both columns, but every table of such rows fits a partitioning by place
alone: windows and running sums need it anyway.  Tables bucketed by place, and what is dealt by place to as many
parts, then meet without another exchange.  A place has at most a row for each day, so no part is hot.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from terrapanel.sources.shared import shared_folder

_SUBSET = "spark.sql.requireAllClusterKeysForCoPartition"
#: Bytes of code beyond which the JVM leaves a method uncompiled; rows of many columns are beyond it as one method.
_METHOD, _METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def wide_rows(spark: SparkSession) -> None:
    """Lets Spark run stages over rows of many columns operator by operator, in methods that the JVM compiles."""
    spark.conf.set(_METHOD, _METHOD_BYTES)


def place_parts(spark: SparkSession) -> int:
    """The number of parts that places are dealt to; lets joins on place and day use tables dealt by place."""
    spark.conf.set(_SUBSET, "false")
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, key: str, parts: int | None) -> DataFrame:
    """df dealt by key to `parts` parts, or as it is without them."""
    return df if parts is None else df.repartition(parts, key)


def bucketed(df: DataFrame, name: str, key: str, parts: int, sort: Sequence[str]) -> DataFrame:
    """df as a table in the shared folder, one file for each of `parts` buckets of key, sorted inside."""
    table = f"{name}_{uuid.uuid4().hex}"
    rows = dealt(df, key, parts).sortWithinPartitions(*sort)
    rows.write.bucketBy(parts, key).sortBy(*sort).option("path", f"{shared_folder(df.sparkSession)}/{table}").saveAsTable(table)
    return df.sparkSession.table(table)
