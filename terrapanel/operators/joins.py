"""Grids, densifying joins, pivots and other relational pieces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_grid(places: DataFrame, calendar: DataFrame, last_day: DataFrame | None = None) -> DataFrame:
    """Every place on every day (up to the one-row last_day); the calendar, a span of years, is broadcast."""
    days = calendar.select("day")
    if last_day is not None:
        days = days.join(F.broadcast(last_day), F.col("day") <= F.col("max_day")).select("day")
    return places.crossJoin(F.broadcast(days))


def count_related(places: DataFrame, edges: DataFrame, into: str = "n_neighbors") -> DataFrame:
    """(place, into): related rows of each place, 0 where there is none."""
    n = edges.groupBy("place").agg(F.count("neighbour").alias(into))
    return places.select("place").join(n, "place", "left").select("place", F.coalesce(into, F.lit(0)).cast("long").alias(into))


def densify(master: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """wide for every key of the master."""
    return master.select(key).join(wide, key, "left")


def nullable_key_join(days: DataFrame, facts: DataFrame, measures: Sequence[str]) -> DataFrame:
    """days (place, day) with the facts of its place, and as all_<measure> those of its day without a
    place: rows for a whole country, which an equi-join on both would lose."""
    local = facts.filter(F.col("place").isNotNull()).groupBy("place", "day").agg(*(F.sum(m).alias(m) for m in measures))
    wide = facts.filter(F.col("place").isNull()).groupBy("day").agg(*(F.sum(m).alias(f"all_{m}") for m in measures))
    return days.join(local, ["place", "day"], "left").join(wide, "day", "left")


def collapse(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flags, counts and sums of (confirmed, birds) by keys."""
    return rows.groupBy(*keys).agg(F.bool_or("confirmed").alias("confirmed"), F.count_if("confirmed").alias("outbreak_events"), F.sum("birds").alias("birds_affected"))


def pivot_mean(rows: DataFrame, keys: Sequence[str], kind: str, value: str, names: Mapping[str, str], require: Sequence[str] = ()) -> DataFrame:
    """The mean value of each kind as a column of its own; rows lacking a required one go."""
    wide = rows.groupBy(*keys).pivot(kind, list(names)).agg(F.avg(value))
    return wide.dropna(subset=list(require) or None, how="any" if require else "all").select(*keys, *(F.col(k).alias(v) for k, v in names.items()))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n")


def symmetric_pairs(pairs: DataFrame, remap: Mapping[str, str], dropped: Sequence[str], keep) -> DataFrame:
    """Distinct (place, neighbour) after codes are remapped; self pairs, dropped codes and codes that
    `keep` refuses go.  Remapping comes first, so that a merge collapses into a self pair."""
    from terrapanel.functions.scalar import literal_map

    now = lambda c: F.coalesce(literal_map(remap, F.col(c)), F.col(c))
    mapped = pairs.select(now("place").alias("place"), now("neighbour").alias("neighbour")).dropna()
    return mapped.filter((F.col("place") != F.col("neighbour")) & ~F.col("place").isin(*dropped) & ~F.col("neighbour").isin(*dropped) & keep(F.col("place")) & keep(F.col("neighbour"))).distinct()


def top_rows(rows: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """The k rows with the largest `by`, nulls last, ties by `tie`."""
    return rows.orderBy(F.desc_nulls_last(by), tie).limit(k)


def both_ends(rows: DataFrame, by: str, head: int, tail: int, tie: str) -> DataFrame:
    """The first `head` and last `tail` rows by `by`, descending, nulls last."""
    first = rows.orderBy(F.desc_nulls_last(by), tie).limit(head)
    last = rows.orderBy(F.asc_nulls_first(by), F.desc(tie)).limit(tail)
    return first.union(last).distinct()
