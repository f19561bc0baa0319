"""Mixing sources to target weights by entropy balancing.

Among all document rates with the wanted number of words from each source and no rate above the cap, the
one of least relative entropy to "everything once" is r = min(cap, exp(lambda * size)), with one
multiplier for each source.  The convex dual is solved by Newton steps, each a grouped sum over the table
of (source, size) counts; nothing but a few sums reaches the driver.  The rates are then rounded into
whole copies, from the longest documents to the shortest, each size handing its error on to the next.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from terrapanel.llm.staging import column_or_null, staged

#: Documents of one source and size are rounded by this many hashed parts, one of them row by row.
PARTS = 32
#: Groups of rows of equal id and text in a part that is split.
SALTS = 1024
_KEY = ["no_source", "source_key"]


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (one row each) with `place`, their place by code point, null last: numbers inside ranges of
    sources, and the ranges' totals before."""
    at = sources.repartitionByRange(sources.sparkSession.sparkContext.defaultParallelism, *_KEY).withColumn("range", F.spark_partition_id())
    ranges = staged(at, "mix-sources")
    before = F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*_KEY)) - 1
    return ranges.withColumn("own", own).join(F.broadcast(totals), "range").withColumn("place", F.col("before") + F.col("own")).drop("range", "own", "before")


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sources (no_source, source_key, source_size, ...) with `target`: shares of the total by weight; what
    exceeds cap times a source's size is shared among the others.

    The level of a unit of weight solves one equation that is concave and piecewise linear in it, by Newton
    steps from below; each step but the last moves at least one source to its cap, mostly many.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    placed = staged(_ranked(sources).select(*sources.columns, weight.alias("weight")), "mix-weights")
    total, all_weights = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, most = (float(total) / all_weights if total else 0.0), F.col("source_size") * float(cap)
    while total:
        over = F.col("weight") * level > most
        full, open_ = placed.agg(F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        raised = (total - (full or 0.0)) / open_ if open_ else level
        if not raised > level * (1 + 1e-15):
            break
        level = raised
    return placed.withColumn("target", F.least(F.col("weight") * level, most)).drop("weight")


def _multipliers(histogram: DataFrame, wanted: DataFrame, cap: float, steps: int, tolerance: float) -> DataFrame:
    """(source, mean, lam, all_full): Newton steps on the logarithm of each source's words, kept inside a
    bracket.  A step is one grouped sum of the histogram, with the state carried along."""
    ratio = F.col("target") / F.col("source_size")
    bound = F.when(ratio < 1, F.log(ratio)).otherwise(F.lit(math.log(cap))) * F.col("mean") / F.col("shortest")
    low, high = F.least(bound, F.lit(0.0)), F.greatest(bound, F.lit(0.0))
    full = ratio >= cap * (1 - 1e-9)
    start = F.when(full, high).otherwise(F.greatest(low, F.least(high, F.log(ratio))))
    state = wanted.filter("source_size > 0 and target > 0").select(*_KEY, "target", "mean", low.alias("low"), high.alias("high"), start.alias("lam"), full.alias("all_full"))
    x = F.col("size") / F.col("mean")
    free = F.exp(F.least(F.col("lam") * x, F.lit(700.0)))
    words = F.col("n") * F.col("size") * F.least(free, F.lit(float(cap)))
    carried = [F.max(c).alias(c) for c in ("target", "mean", "low", "high", "lam", "all_full")]
    gap = F.when(F.col("all_full"), 0.0).otherwise(F.abs(F.col("g") / F.col("target") - 1))
    for _ in range(steps):
        both = histogram.join(state, _KEY).groupBy(*_KEY).agg(*carried, F.sum(words).alias("g"), F.sum(F.when(free < cap, words * x)).alias("h"))
        both = both.withColumn("newton", F.col("lam") + (F.log("target") - F.log("g")) * F.col("g") / F.col("h")).withColumn("gap", gap)
        both = both.withColumn("low", F.when(F.col("g") < F.col("target"), F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("g") >= F.col("target"), F.col("lam")).otherwise(F.col("high")))
        better = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        widest = Observation()
        moved = both.select(*_KEY, "target", "mean", "low", "high", F.when(F.col("gap") <= tolerance, F.col("lam")).otherwise(better).alias("lam"), "all_full", "gap").observe(widest, F.max("gap").alias("gap"))
        state = staged(moved, "mix-state").drop("gap")
        if (widest.get["gap"] or 0.0) <= tolerance:
            return state.select(*_KEY, "mean", "lam", "all_full")
    raise RuntimeError(f"rates have not settled in {steps} Newton steps")


def _rounded(cap: float):
    """How many documents of each size of a source get one copy more than the whole ones, from the longest size to
    the shortest, each handing its error on to the next."""

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.compute.sort_indices(group["size"], [("", "descending")]))
        sizes, numbers, rates = (group[c].to_numpy() for c in ("size", "n", "rate"))
        wholes = np.minimum(rates.astype(np.int64), int(cap))
        carry, counts = 0.0, np.zeros(len(sizes), np.int64)
        for k, (size, n, rate, whole) in enumerate(zip(sizes.tolist(), numbers.tolist(), rates.tolist(), wholes.tolist(), strict=True)):
            wanted = n * rate * size + carry
            counts[k] = count = min(max(math.floor(wanted / size - whole * n + 0.5), 0), n) if whole < cap else 0
            carry = wanted - (whole * n + count) * size
        return group.select([*_KEY, "size", "rate"]).append_column("base", pa.array(wholes, pa.int32())).append_column("count", pa.array(counts))

    return run


def _plan(rated: DataFrame, histogram: DataFrame, cap: float) -> DataFrame:
    """(source, size, rate, base, limit, more): the copies by size; parts below `limit` get one more, and `more`
    documents of that part.

    A source is rounded by one task, as three numbers a size.  Different sizes are few: D of them have
    at least D * D / 2 words together, so a source of 10**13 words has at most 4.5 million.
    """
    counts = rated.groupBy(*_KEY).applyInArrow(_rounded(cap), "no_source boolean, source_key string, size long, rate double, base int, count long")
    start = F.struct(F.lit(0).cast("long").alias("reached"), F.lit(PARTS).alias("limit"))

    def step(state, part):
        stops = (state["limit"] == PARTS) & (state["reached"] + part["c"] > F.col("count"))
        reached = F.when(stops | (state["limit"] < PARTS), state["reached"]).otherwise(state["reached"] + part["c"])
        return F.struct(reached.alias("reached"), F.when(stops, part["part"]).otherwise(state["limit"]).alias("limit"))

    cut = F.aggregate(F.array_sort("parts"), start, step)
    return staged(counts.join(histogram.select(*_KEY, "size", "parts"), [*_KEY, "size"]).withColumn("cut", cut).select(*_KEY, "size", "rate", "base", "cut.limit", (F.col("count") - F.col("cut.reached")).alias("more")), "mix-plan")


def _split_parts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The `row` of the first `more` rows of each part that is taken in part, by a hash of id and text.
    Rows of the same hash are counted by `row` in SALTS groups, so that no task ranks a great group of them."""
    cut = plan.filter("more > 0").select(*_KEY, "size", F.col("limit").alias("part"), "more")
    rows = staged(sized.join(cut, [*_KEY, "size", "part"]).select(*_KEY, "size", "more", "mix", F.pmod("row", F.lit(SALTS)).alias("salt"), "row"), "mix-cut")
    group = [*_KEY, "size", "more", "mix", "salt"]
    before = F.sum("c").over(Window.partitionBy(*_KEY, "size").orderBy("mix", "salt").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).withColumn("left", F.col("more") - F.coalesce(before, F.lit(0)))
    taken = rows.join(counted.filter("left > 0").select(*group, "c", "left"), group)
    ranked = taken.filter("c > left").withColumn("r", F.row_number().over(Window.partitionBy(*_KEY, "size").orderBy("row"))).filter("r <= left")
    return taken.filter("c <= left").select("row").union(ranked.select("row"))


def entropy_mix(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, steps: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    documents: doc_id long, text string, source string.  A document's size is its number of words (runs
    of characters other than space, tab and line ends; null has none).  The mix has as many words as all
    documents; sources by code point, null last, get shares by `weights`, repeating, but at most `cap`
    times their own words, the excess going to the others by weight.  Returns doc_id, source, size,
    source_size, target (of the source), rate (of the balanced solution), copies (0 to cap) and taken
    (copies * size).  A document gets the whole copies of its rate or one more.  Each source's taken words differ
    from its target by about its shortest documents' sizes where these have room for the longer ones' errors, also
    where all its documents have one size or no id; where they have none, as with rates just below a whole number,
    by half of its longest document's size at most, however many sizes there are.

    The result is a function of the rows alone: what is rounded up follows a hash of doc_id and text, and of
    rows equal in both any may be.  A null source is a source; null and repeated ids are separate documents;
    sources and documents of size 0 take 0; a very long text is counted whole, in one pass over it; empty
    tables give an empty result.  Newton steps that do not settle in `steps` raise an error.
    """
    text, source = column_or_null(documents, "text", "string"), column_or_null(documents, "source", "string")
    doc_id = column_or_null(documents, "doc_id", "long")
    sized = documents.select(
        doc_id.alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.xxhash64(doc_id, text, F.lit("mix")).alias("mix"), F.monotonically_increasing_id().alias("row"),
    )
    sized = staged(sized.withColumn("part", F.pmod("mix", F.lit(PARTS)).cast("int")), "mix-sizes")
    counts = sized.groupBy(*_KEY, "size", "part").agg(F.count(F.lit(1)).alias("c"))
    histogram = staged(counts.groupBy(*_KEY, "size").agg(F.sum("c").alias("n"), F.collect_list(F.struct("part", "c")).alias("parts")), "mix-histogram")
    some = F.when(F.col("size") > 0, F.col("size"))
    sources = histogram.groupBy(*_KEY).agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(some).alias("shortest"), (F.sum(some * F.col("n")) / F.sum(F.when(F.col("size") > 0, F.col("n")))).alias("mean")
    )
    wanted = staged(targets(sources, weights, cap), "mix-targets")
    full = histogram.filter("size > 0")
    multipliers = _multipliers(full.drop("parts"), wanted, cap, steps, tolerance)
    rate = F.when(F.col("all_full"), F.lit(float(cap))).otherwise(F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(700.0))), F.lit(float(cap))))
    rated = full.join(multipliers, _KEY).select(*_KEY, "size", "n", rate.alias("rate"))
    plan = _plan(rated, histogram, cap)
    first = staged(_split_parts(sized, plan), "mix-first").withColumn("first", F.lit(True))
    out = sized.join(plan, [*_KEY, "size"], "left").join(wanted.select(*_KEY, "source_size", "target"), _KEY).join(first, "row", "left")
    n = F.coalesce(F.col("base") + F.when((F.col("part") < F.col("limit")) | F.col("first"), 1).otherwise(0), F.lit(0))
    return out.select("doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), n.alias("copies"), (n * F.col("size")).cast("long").alias("taken"))
