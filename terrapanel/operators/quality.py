"""Explicit gates: what a database would enforce or a loader would print, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A gate that must hold does not."""


def resolve_keys(rows: DataFrame, master: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key the master has, rows whose key it has not or is null)."""
    known = master.select(key).distinct()
    return rows.join(known, key, "left_semi"), rows.join(known, key, "left_anti")


def resolution_report(rows: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """One row: total, kept, dropped, and how many different keys were dropped (null counts as one)."""
    known = master.select(F.col(key), F.lit(True).alias("known")).distinct()
    joined = rows.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    lost = F.when(~F.col("known"), F.coalesce(F.col(key).cast("string"), F.lit("\u0000")))
    return joined.agg(F.count(F.lit(1)).alias("total"), F.count_if("known").alias("kept"), F.count_if(~F.col("known")).alias("dropped"), F.count_distinct(lost).alias("offenders"))


def foreign_key_offenders(rows: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Keys that the master lacks, with their number of rows; null keys are no offence."""
    return rows.filter(F.col(key).isNotNull()).join(master.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def primary_key_violations(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that repeat or hold a null, with their number of rows."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter((F.col("n_rows") > 1) | null)


def require_empty(offenders: DataFrame, what: str) -> None:
    """Raises with a few examples unless there are no offenders."""
    found = offenders.take(5)
    if found:
        raise QualityError(f"{what}: {[tuple(r) for r in found]}")


def vintage_flags(rows: DataFrame, key: str, required: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """One row: whether all required keys are present and no forbidden one is."""
    has = lambda k: F.coalesce(F.bool_or(F.col(key) == k), F.lit(False))
    present, absent = F.lit(True), F.lit(True)
    for k in required:
        present = present & has(k)
    for k in forbidden:
        absent = absent & ~has(k)
    return rows.agg(present.alias("required_present"), absent.alias("forbidden_absent"))


def row_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows), the largest first."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("n_rows"), "table_name")


def missing_shares(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_share): one pass over the rows.  Columns that can hold no null need not be in the rows."""
    one = rows.agg(*(F.avg(F.col(c).isNull().cast("double") if c in rows.columns else F.lit(0.0)).alias(c) for c in columns))
    return one.unpivot([], list(columns), "column_name", "null_share")


def load_profile(rows: DataFrame, key: str, distance: str | None = None) -> DataFrame:
    """One row: rows, first and last day, different keys, and the largest snap distance."""
    far = F.max(distance) if distance else F.lit(None).cast("double")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct(key).alias("n_keys"), far.alias("max_distance"))


def spot_check(rows: DataFrame, key: str, keys: Sequence) -> DataFrame:
    """The rows of named keys, for a look at places whose figures are known."""
    return rows.filter(F.col(key).isin(*keys))


def suppression_counts(wide: DataFrame, governed_by: dict[str, str]) -> DataFrame:
    """(measure, n_suppressed, n_zero, n_present): withheld (null with operations), zero and positive."""
    parts = []
    for measure, operations in governed_by.items():
        parts.append(wide.agg(F.count_if(F.col(measure).isNull() & (F.col(operations) > 0)).alias("n_suppressed"), F.count_if(F.col(measure) == 0).alias("n_zero"), F.count_if(F.col(measure) > 0).alias("n_present")).select(F.lit(measure).alias("measure"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
