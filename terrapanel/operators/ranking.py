"""Cumulative counts and exact quantiles over a column's distinct values, without a global sort in one
task: values are dealt to ranges, summed inside each, and the ranges' totals, a bounded table, added."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are dealt to.
RANGES = 256
#: Accuracy of the approximate quantiles that bracket exact ones.
ACCURACY = 10_000


def cumulative(rows: DataFrame, value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """One row for each distinct value: each of `sums` (result: column) and its running total,
    `cum_<result>`, from the least value up (or from the largest down).  Null and NaN values are left out."""
    good = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    levels = good.groupBy(F.col(value).cast("double").alias(value)).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    edges = good.agg(F.percentile_approx(F.col(value).cast("double"), [k / RANGES for k in range(1, RANGES)], 10_000)).first()[0] or [0.0]
    edges = sorted(set(edges))
    dealt = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=value, outputCol="_range").transform(levels)
    total = dealt.groupBy("_range").agg(*(F.sum(name).alias(f"_{name}") for name in sums))
    order = F.desc("_range") if descending else F.asc("_range")
    before = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    base = total.select("_range", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.select("*", *(F.sum(name).over(inside).alias(f"cum_{name}") for name in sums)).join(F.broadcast(base), "_range")
    return running.select(value, *sums, *((F.col(f"cum_{name}") + F.col(f"_{name}")).alias(f"cum_{name}") for name in sums))


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row, q0, q1, ...: linearly interpolated quantiles of the values that are not null; null if
    there are none."""
    one = rows.select(F.col(column).cast("double").alias(column), F.lit(1).alias("_one"))
    table = cumulative(one, column, {"n": "_one"})
    size = one.filter(F.col(column).isNotNull() & ~F.isnan(column)).agg(F.count(F.lit(1)).alias("size"))
    table = table.crossJoin(F.broadcast(size))
    out = []
    for k, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("size") - 1)
        low, high = F.floor(at), F.ceil(at)
        out += [F.min(F.when(F.col("cum_n") > low, F.col(column))).alias(f"l{k}"), F.min(F.when(F.col("cum_n") > high, F.col(column))).alias(f"h{k}"), F.max(at - low).alias(f"w{k}")]
    found = table.agg(*out)
    return found.select(*((F.col(f"l{k}") + (F.col(f"h{k}") - F.col(f"l{k}")) * F.col(f"w{k}")).alias(f"q{k}") for k in range(len(shares))))


def exact_quantiles_of(rows: DataFrame, values: Mapping[str, Column], shares: Sequence[float]) -> DataFrame:
    """One row, `<name>_q0`, `<name>_q1`, ...: linearly interpolated quantiles of several columns (name: value),
    all in two passes; null and NaN values are left out, and what has none is null.

    The first pass counts and brackets every quantile by approximate ones, whose error in rank is at most one in
    ACCURACY; a column of few values is its own bracket.  The second counts what lies below each bracket and the
    different values inside, a thousandth of all rows at most.
    """
    spark, margin = rows.sparkSession, 4 / ACCURACY
    number = {name: F.nanvl(c.cast("double"), F.lit(None).cast("double")) for name, c in values.items()}
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-margin, margin)]
    first = rows.agg(*(F.struct(F.count(c).alias("n"), F.percentile_approx(c, around, ACCURACY).alias("at")).alias(name) for name, c in number.items())).first()
    brackets, ranks = [], []
    for name, c in number.items():
        n, at = first[name]["n"], first[name]["at"]
        for k, share in enumerate(shares):
            low, high = (-math.inf, math.inf) if n <= 2 * ACCURACY else (at[2 * k], at[2 * k + 1])
            inside = F.when(c < low, F.lit(-math.inf)).when(c <= high, c)
            brackets.append(F.struct(F.lit(name).alias("name"), F.lit(k).alias("k"), inside.alias("v")))
            place = share * max(0, n - 1)
            ranks.append((name, k, math.floor(place), math.ceil(place), place - math.floor(place)))
    each = rows.select(F.explode(F.filter(F.array(*brackets), lambda b: b["v"].isNotNull())).alias("b")).groupBy("b.name", "b.k", "b.v").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.broadcast(spark.createDataFrame(ranks, "name string, k int, low long, high long, weight double"))
    up_to = Window.partitionBy("name", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = each.withColumn("up_to", F.sum("n").over(up_to)).join(wanted, ["name", "k"])
    found = running.groupBy("name", "k").agg(F.min(F.when(F.col("up_to") > F.col("low"), F.col("v"))).alias("a"), F.min(F.when(F.col("up_to") > F.col("high"), F.col("v"))).alias("b"), F.max("weight").alias("w"))
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("w")
    return found.agg(*(F.max(F.when((F.col("name") == name) & (F.col("k") == k), value)).alias(f"{name}_q{k}") for name in number for k in range(len(shares))))
