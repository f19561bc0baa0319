"""Rare-event baselines over the model table: sampling, design matrix, fits, metrics and inference."""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.functions.scalar import log_count
from terrapanel.operators.quality import QualityError
from terrapanel.operators.ranking import cumulative, exact_quantiles, exact_quantiles_of
from terrapanel.sources.layout import wide_rows
from terrapanel.sources.shared import kept

#: Columns of the model table that enter as logarithms, and those that enter as they are.
COUNTS = [
    *(f"own_outbreaks_{w}d" for w in (7, 21, 60)), *(f"nbr_infected_counties_{w}d" for w in (7, 21, 60)), *(f"nbr_infections_{w}d" for w in (7, 21, 60)),
    *(f"nbr_wild_detections_{w}d" for w in (7, 21, 60)), *(f"wild_detections_{w}d" for w in (7, 21, 60)), "breeding_side_pressure", "wintering_side_pressure",
    "poultry_operations", "layer_operations", "broiler_operations", "turkey_operations", "duck_operations", "population",
]
PLAIN = ["temp_min_7d_c", "temp_max_7d_c", "precip_7d_mm", "doy_sin", "doy_cos", "n_neighbors"]
WEATHER = ["temp_min_7d_c", "temp_max_7d_c", "precip_7d_mm"]
CENSORED = ["days_since_outbreak_county", "days_since_outbreak_neighbor"]
LABEL = "target_outbreak_next_7d"
#: What stands for "nothing within the look-back", and the scale of recency.
CENSORED_DAYS, RECENCY_SCALE = 400, 100.0


def key_share(*keys: str, seed: int = 0, parts: int = 10_000) -> Column:
    """A number in [0, 1) that depends on the key alone, so that samples repeat."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(parts)) / parts


def case_control(rows: DataFrame, split_day: str, rate: float, label: str = LABEL, draw: Column | None = None) -> DataFrame:
    """All rows from split_day on, and before it all positives and the share `rate` of the negatives."""
    draw = key_share("place", "day") if draw is None else draw
    return rows.filter((F.col("day") >= F.lit(split_day).cast("date")) | F.col(label) | (draw < rate))


def split_audit(rows: DataFrame, split_day: str, label: str = LABEL) -> DataFrame:
    """(is_train, n_rows, positives, rate)."""
    return rows.groupBy((F.col("day") < F.lit(split_day).cast("date")).alias("is_train")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(label).alias("positives"), F.avg(F.col(label).cast("double")).alias("rate"))


def design_fill(rows: DataFrame, split_day: str, places: DataFrame | None = None) -> DataFrame:
    """One row, _layer_inventory and one for each of WEATHER: the median over all rows, and those over the rows before
    split_day.  With places, inventory is theirs: right where each has as many rows.  Rows without weather may be left out."""
    before = F.col("day") < F.lit(split_day).cast("date")
    weather = {c: F.when(before, F.col(c)) for c in WEATHER}
    inventory = {"layer_inventory": F.col("layer_inventory")}
    medians = exact_quantiles_of(rows, inventory | weather, [0.5]) if places is None else exact_quantiles_of(rows, weather, [0.5]).crossJoin(F.broadcast(exact_quantiles_of(places, inventory, [0.5])))
    return medians.select(*(F.col(f"{c}_q0").alias(f"_{c}") for c in ("layer_inventory", *WEATHER)))


def design_matrix(rows: DataFrame, split_day: str, banding: bool = False, keep: Sequence[str] = ("place", "day", LABEL), fill: DataFrame | None = None) -> DataFrame:
    """Model columns: logarithms of counts, recency capped with an indicator of censoring, inventory with
    an indicator of withholding and filled with its median over all rows, weather filled with medians over
    the rows before split_day and an indicator.  fill: these medians as design_fill() gives them; without it, rows are
    passed over twice for them."""
    wide_rows(rows.sparkSession)
    fill = design_fill(rows, split_day) if fill is None else fill
    x = rows.crossJoin(F.broadcast(fill))  # one row of medians
    columns = [log_count(F.col(c)).alias(f"log_{c}") for c in COUNTS]
    for c in CENSORED:
        columns += [F.col(c).isNull().cast("int").alias(f"{c}_censored"), (F.coalesce(F.col(c), F.lit(CENSORED_DAYS)) / RECENCY_SCALE).alias(c)]
    columns += [
        (F.col("layer_inventory").isNull() & (F.col("layer_operations") > 0)).cast("int").alias("layer_inventory_suppressed"),
        F.log1p(F.coalesce("layer_inventory", "_layer_inventory")).alias("log_layer_inventory"),
    ]
    if banding:
        columns += [log_count(F.col(c)).alias(f"log_{c}") for c in ("band_count_21d", "nbr_band_count_21d")]
    columns += [(F.coalesce(c, f"_{c}") if c in WEATHER else F.col(c)).cast("double").alias(c) for c in PLAIN]
    columns.append(F.col("temp_max_7d_c").isNull().cast("int").alias("weather_missing"))
    return x.select(*keep, *columns)


def design_columns(banding: bool = False) -> list[str]:
    """The columns that design_matrix() makes, in order."""
    censored = [n for c in CENSORED for n in (f"{c}_censored", c)]
    bands = ["log_band_count_21d", "log_nbr_band_count_21d"] if banding else []
    return [*(f"log_{c}" for c in COUNTS), *censored, "layer_inventory_suppressed", "log_layer_inventory", *bands, *PLAIN, "weather_missing"]


def design_inputs(banding: bool = False, keep: Sequence[str] = ("place", "day", LABEL)) -> list[str]:
    """The columns of the model table that design_matrix() reads; nothing else of it need be made or written."""
    bands = ["band_count_21d", "nbr_band_count_21d"] if banding else []
    return list(dict.fromkeys([*keep, *COUNTS, *CENSORED, "layer_inventory", "layer_operations", *bands, *PLAIN]))


def feature_columns(x: DataFrame, keep: Sequence[str] = ("place", "day", LABEL)) -> list[str]:
    return [c for c in x.columns if c not in keep]


def leakage_scan(x: DataFrame, features: Sequence[str]) -> DataFrame:
    """(column_name, banned, n_null): columns that look ahead or at the same day, and nulls by column."""
    nulls = x.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in features)).unpivot([], list(features), "column_name", "n_null")
    return nulls.select("column_name", (F.col("column_name").startswith("target_") | (F.col("column_name") == "outbreak")).alias("banned"), "n_null")


def require_clean(x: DataFrame, features: Sequence[str]) -> None:
    bad = leakage_scan(x, features).filter("banned or n_null > 0").collect()  # a row a column
    if bad:
        raise QualityError(f"columns that leak or hold nulls: {[r['column_name'] for r in bad]}")


@dataclass
class Logit:
    """Coefficients on standardised features; shift is what sampling of negatives added to the intercept."""

    features: list[str]
    means: np.ndarray
    deviations: np.ndarray
    coefficients: np.ndarray
    intercept: float
    shift: float = 0.0

    def margin(self) -> Column:
        total = F.lit(float(self.intercept + self.shift))
        for name, mean, deviation, b in zip(self.features, self.means, self.deviations, self.coefficients, strict=True):
            total = total + (F.col(name) - float(mean)) / float(deviation) * float(b)
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def fit_logit(train: DataFrame, features: Sequence[str], label: str = LABEL, c: float | None = 1.0, sampled_rate: float | None = None, iterations: int = 2000) -> Logit:
    """Logistic regression on standardised features, with an L2 penalty of 1 / c on the sum of losses (none
    if c is None), population deviations with a penalty and sample deviations without, 0 taken as 1.
    sampled_rate, the kept share of negatives, corrects the intercept."""
    return fit_logits(train, [features], label, c, sampled_rate, iterations)[0]


def fit_logits(train: DataFrame, sets: Sequence[Sequence[str]], label: str = LABEL, c: float | None = 1.0, sampled_rate: float | None = None, iterations: int = 2000) -> list[Logit]:
    """fit_logit() on each set of features; all fits take their steps in the same passes over the rows."""
    features = list(dict.fromkeys(f for one in sets for f in one))
    wide_rows(train.sparkSession)
    deviation = F.stddev_pop if c else F.stddev_samp
    stats = train.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f"m_{f}") for f in features), *(deviation(f).alias(f"s_{f}") for f in features)).first()
    means = np.array([stats[f"m_{f}"] for f in features], float)
    deviations = np.array([stats[f"s_{f}"] or 1.0 for f in features], float)
    own = [np.array([features.index(f) for f in one], int) for one in sets]
    rows = train.select(*(F.col(f).cast("double").alias(f) for f in features), F.col(label).cast("double").alias("_y"))
    betas = _newton(rows, features, own, means, deviations, 1 / c if c else 0.0, iterations)
    shift = math.log(sampled_rate) if sampled_rate else 0.0
    return [Logit(list(one), means[at], deviations[at], beta[1:], float(beta[0]), shift) for one, at, beta in zip(sets, own, betas, strict=True)]


class _Fit:
    """The steps of one fit: at is where it wants the sums next, None once it is done.  A step that makes it worse is halved."""

    def __init__(self, size: int, penalty: float, iterations: int):
        self.ridge, self.left = np.array([0.0] + [penalty] * (size - 1)), iterations
        self.beta, self.step, self.best = np.zeros(size), np.zeros(size), None
        self.at: np.ndarray | None = self.beta

    def take(self, loss: float, gradient: np.ndarray, second: np.ndarray) -> None:
        self.left -= 1
        loss += float(np.sum(self.ridge * self.at**2)) / 2
        if self.best is not None and not loss <= self.best + 1e-12 * abs(self.best):
            done = np.max(np.abs(self.step)) < 1e-9
            self.step = self.step if done else self.step / 2
        else:
            done = self.best is not None and self.best - loss <= 1e-13 * abs(self.best)
            self.beta, self.best = self.at, loss
            slope = gradient + self.ridge * self.beta
            self.step = -np.linalg.pinv(second + np.diag(self.ridge), hermitian=True) @ slope
            done = done or float(-slope @ self.step) <= 1e-14 * max(1.0, abs(loss)) or not np.all(np.isfinite(self.step))
        self.at = None if done or not self.left else self.beta + self.step


def _newton(rows: DataFrame, features: Sequence[str], own: Sequence[np.ndarray], means: np.ndarray, deviations: np.ndarray, penalty: float, iterations: int) -> list[np.ndarray]:
    """For each fit, of the features that `own` has the places of, the intercept and coefficients that minimise the sum of
    losses and penalty / 2 times the squared coefficients.

    A step of all fits is one pass, whose tasks give each fit's loss, its gradient and its second derivatives, p * p
    numbers; a handful of steps reach what gradients alone take hundreds of passes for.
    """
    fits = [_Fit(len(at) + 1, penalty, iterations) for at in own]
    while any(f.at is not None for f in fits):
        going = [k for k, f in enumerate(fits) if f.at is not None]
        sums = _loss_sums(rows, features, means, deviations, [(own[k], fits[k].at) for k in going])
        for k, found in zip(going, sums, strict=True):
            fits[k].take(*found)
    return [f.beta for f in fits]


def _loss_sums(rows: DataFrame, features: Sequence[str], means: np.ndarray, deviations: np.ndarray, fits: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each of fits, (places of its features, beta), the sum of logistic losses at beta, its gradient and its second
    derivatives: partial sums by task, then by entry."""
    sizes = [len(beta) for _, beta in fits]

    def partial(batches):
        totals = [np.zeros((k + 2, k)) for k in sizes]
        for b in batches:
            x = np.ones((b.num_rows, len(features) + 1))
            for j, f in enumerate(features):
                x[:, j + 1] = (b.column(f).to_numpy(zero_copy_only=False) - means[j]) / deviations[j]
            y = b.column("_y").to_numpy(zero_copy_only=False)
            for total, (own, beta) in zip(totals, fits, strict=True):
                z = x if len(own) == len(features) else x[:, np.concatenate([[0], own + 1])]
                m = z @ beta
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                total[0] += z.T @ (p - y)
                total[1:-1] += z.T @ (z * (p * (1 - p))[:, None])
                total[-1, 0] += np.sum(np.logaddexp(0.0, m) - y * m)
        for n, total in enumerate(totals):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.size, n, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["fit", "i", "j", "v"])

    out = [np.zeros((k + 2, k)) for k in sizes]
    for r in rows.mapInArrow(partial, "fit int, i int, j int, v double").groupBy("fit", "i", "j").agg(F.sum("v").alias("v")).collect():  # entries of the models
        out[r["fit"]][r["i"], r["j"]] = r["v"]
    return [(float(o[-1, 0]), o[0], o[1:-1]) for o in out]


def scored(rows: DataFrame, model: Logit, into: str, label: str = LABEL) -> DataFrame:
    """(into, label) of each row, written once: metrics pass over scores several times, and not over all features."""
    return kept(rows.select(model.probability().alias(into), label), "scored")


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    rows = scored.select(score, F.col(label).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one"))
    return cumulative(rows, score, {"tp": "_y", "n": "_one"}, descending=True)


def metrics(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: n, positives, base_rate, roc_auc, average_precision, lift, brier, mean_score.  Equal scores
    are one threshold."""
    table = _by_score(scored, score, label)
    y = F.col(label).cast("double")
    plain = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(y).alias("base_rate"), F.avg(F.pow(F.col(score) - y, F.lit(2.0))).alias("brier"), F.avg(score).alias("mean_score"))
    ranked = table.agg(F.sum((F.col("n") - F.col("tp")) * (F.col("cum_tp") - F.col("tp") / 2)).alias("area"), F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")).alias("precision"))
    both = plain.crossJoin(F.broadcast(ranked))
    negatives = F.col("n") - F.col("positives")
    auc = F.when((F.col("positives") > 0) & (negatives > 0), F.col("area") / F.col("positives") / negatives)
    precision = F.when(F.col("positives") > 0, F.col("precision") / F.col("positives"))
    return both.select("n", "positives", "base_rate", auc.alias("roc_auc"), precision.alias("average_precision"), (precision / F.col("base_rate")).alias("lift"), "brier", "mean_score")


def curves(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, precision, recall, false_positive_rate) for each distinct score."""
    totals = scored.agg(F.sum(F.col(label).cast("long")).alias("_positives"), F.count(F.lit(1)).alias("_all"))
    t = _by_score(scored, score, label).crossJoin(F.broadcast(totals))
    share = lambda a, b: F.when(b > 0, a / b)
    return t.select(F.col(score).alias("threshold"), (F.col("cum_tp") / F.col("cum_n")).alias("precision"), share(F.col("cum_tp"), F.col("_positives")).alias("recall"), share(F.col("cum_n") - F.col("cum_tp"), F.col("_all") - F.col("_positives")).alias("false_positive_rate"))


def calibration(scored: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, mean_score, observed, n) by quantile bins, closed on the right; equal edges merge."""
    edges = exact_quantiles(scored, score, [k / bins for k in range(bins + 1)])
    inner = F.array_distinct(F.array(*(F.col(f"q{k}") for k in range(bins + 1))))
    with_edges = scored.crossJoin(F.broadcast(edges.select(inner.alias("_edges"))))
    number = F.greatest(F.size(F.filter("_edges", lambda e: e < F.col(score))) - 1, F.lit(0))
    return with_edges.groupBy(number.alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"), F.count(F.lit(1)).alias("n"))


def _outer_sums(rows: DataFrame, columns: Sequence[str], weight: str | None) -> np.ndarray:
    """The sum of w x x' over rows: partial sums by task, then by entry."""
    p = len(columns)

    def partial(batches):
        total = np.zeros((p, p))
        for b in batches:
            x = b[list(columns)].to_numpy(float)
            total += x.T @ (x * b[weight].to_numpy(float)[:, None] if weight else x)
        i, j = np.indices((p, p))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    entries = rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # p * p rows
    out = np.zeros((p, p))
    for r in entries:
        out[r["i"], r["j"]] = r["v"]
    return out


def clustered_inference(train: DataFrame, features: Sequence[str], cluster: str = "place", label: str = LABEL) -> pd.DataFrame:
    """Odds ratios for one sample deviation, with confidence limits and p-values from a covariance clustered
    by `cluster`: an unpenalised fit, the sandwich of the inverse information and the summed outer
    products of cluster scores, times G / (G - 1) * (n - 1) / (n - k).  The rows are features, not data."""
    model = fit_logit(train, features, label, c=None, iterations=200)
    names = ["_const", *features]
    z = train.select(cluster, F.lit(1.0).alias("_const"), *(((F.col(f) - float(m)) / float(s)).alias(f) for f, m, s in zip(features, model.means, model.deviations, strict=True)), F.col(label).cast("double").alias("_y"), model.probability().alias("_p"))
    z = z.withColumn("_w", F.col("_p") * (1 - F.col("_p")))
    bread = np.linalg.pinv(_outer_sums(z, names, "_w"))
    scores = z.groupBy(cluster).agg(*(F.sum(F.col(c) * (F.col("_y") - F.col("_p"))).alias(c) for c in names))
    meat = _outer_sums(scores, names, None)
    n, groups = z.agg(F.count(F.lit(1)), F.count_distinct(cluster)).first()
    k = len(names)
    covariance = bread @ meat @ bread * (groups / max(1, groups - 1)) * ((n - 1) / max(1, n - k))
    error = np.sqrt(np.diag(covariance))[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        p = [math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else float("nan") for b, e in zip(model.coefficients, error, strict=True)]
    out = pd.DataFrame({"feature": list(features), "odds_ratio": np.exp(model.coefficients), "ci_low": np.exp(model.coefficients - 1.959963984540054 * error), "ci_high": np.exp(model.coefficients + 1.959963984540054 * error), "p_value": p})
    return out.assign(significant=out["p_value"] < 0.05).sort_values("odds_ratio", ascending=False, ignore_index=True)


def shuffled_block(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int, stratum_rows: int = 10_000) -> DataFrame:
    """rows with the values of a block of columns moved, together, to other rows.  Rows are dealt to
    strata by a hash of their key and permuted inside each, so no task orders the whole table."""
    from pyspark.sql import Window

    n = rows.count()
    strata = max(1, n // stratum_rows)
    dealt = rows.withColumn("_s", F.pmod(F.xxhash64(*keys), F.lit(strata)))
    number = lambda salt: F.row_number().over(Window.partitionBy("_s").orderBy(F.xxhash64(*keys, F.lit(salt)), *keys))
    block = dealt.select("_s", number(f"from {seed}").alias("_n"), *columns)
    rest = dealt.drop(*columns).withColumn("_n", number("to"))
    return rest.join(block, ["_s", "_n"]).select(*rows.columns)


def shuffled_blocks(rows: DataFrame, columns: Sequence[str], keys: Sequence[str], seeds: Sequence[int], stratum_rows: int = 10_000) -> DataFrame:
    """rows and, for each seed, columns `<name>_<seed>` with the values that shuffled_block() gives: a stratum is
    ordered in its task, for all seeds together, so rows are moved once."""
    strata = max(1, rows.count() // stratum_rows)
    orders = {"_to": "to"} | {f"_from_{s}": f"from {s}" for s in seeds}
    dealt = rows.select("*", F.pmod(F.xxhash64(*keys), F.lit(strata)).alias("_s"), *(F.xxhash64(*keys, F.lit(salt)).alias(n) for n, salt in orders.items()))
    names, block = rows.columns, list(columns)

    def shuffle(stratum: pa.Table) -> pa.Table:
        order = lambda by: pc.sort_indices(stratum, sort_keys=[(by, "ascending"), *((k, "ascending") for k in keys)])
        out = stratum.select(names).take(order("_to"))
        for s in seeds:
            moved = stratum.select(block).take(order(f"_from_{s}"))
            for c in block:
                out = out.append_column(f"{c}_{s}", moved[c])
        return out

    kinds = [*rows.schema, *(T.StructField(f"{c}_{s}", rows.schema[c].dataType) for s in seeds for c in block)]
    return dealt.groupBy("_s").applyInArrow(shuffle, T.StructType(kinds))


def ablation(train: DataFrame, test: DataFrame, features: Sequence[str], blocks: dict[str, Sequence[str]], label: str = LABEL) -> DataFrame:
    """(block, roc_auc, average_precision): fits without each block in turn, and with all (`none`)."""
    sets = {name: [f for f in features if f not in block] for name, block in {"none": [], **blocks}.items()}
    return _judged(test, dict(zip(sets, fit_logits(train, list(sets.values()), label), strict=True)), "block", label)


def _judged(test: DataFrame, models: dict, into: str, label: str) -> DataFrame:
    """(into, roc_auc, average_precision) of each model on the test rows, which are scored by all in one pass and written."""
    names = [f"_score_{k}" for k in range(len(models))]
    wide_rows(test.sparkSession)
    scores = kept(test.select(*(m.probability().alias(n) for n, m in zip(names, models.values(), strict=True)), label), "scored")
    each = [metrics(scores.select(F.col(n).alias("_score"), label), "_score", label).select(F.lit(key).alias(into), "roc_auc", "average_precision") for n, key in zip(names, models, strict=True)]
    return functools.reduce(DataFrame.unionByName, each)


def permutation_test(train: DataFrame, test: DataFrame, features: Sequence[str], block: Sequence[str], keys: Sequence[str] = ("place", "day"), repeats: int = 5, label: str = LABEL) -> DataFrame:
    """(repeat, roc_auc, average_precision): repeat 0 is the fit on the data, the others on data whose block
    was shuffled before the fit."""
    wide = kept(shuffled_blocks(train, block, keys, range(1, repeats + 1)), "shuffled")  # the fits read it often
    sets = [list(features), *([f"{f}_{r}" if f in block else f for f in features] for r in range(1, repeats + 1))]
    fits = [dataclasses.replace(m, features=list(features)) for m in fit_logits(wide, sets, label)]
    return _judged(test, dict(enumerate(fits)), "repeat", label)


def exchange_test(rows: DataFrame, block: Sequence[str], statistic: Column, keys: Sequence[str], within: Sequence[str], repeats: int = 99, seed: int = 1) -> DataFrame:
    """One row, (observed, p_value, repeats): how often exchanging a block of columns gives a statistic as large.

    The block's values move together, and only among rows that are equal in `within` (a place's region and a
    span of time, so that what rows near each other have in common stays).  statistic is an aggregate of the
    rows' columns.  All repeats are one job, whose rows are `repeats` times the table's; each exchange is the
    join of two orders of a stratum by hashes of the keys, which must be unique.  The p-value is the observed
    statistic's rank, (1 + exchanges at least as large) / (1 + repeats); null statistics count as not.
    """
    from pyspark.sql import Window

    order = lambda *salt: F.row_number().over(Window.partitionBy("_r", *within).orderBy(F.xxhash64(*keys, "_r", *(F.lit(x) for x in salt)), *keys))
    again = rows.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    moved = again.select(F.col("_r").alias("_q"), order("from", seed).alias("_m"), *(F.col(c).alias(f"_in_{c}") for c in within), *(F.col(c).alias(f"_new_{c}") for c in block))
    rest = again.withColumn("_n", order("to", seed))
    same = [F.col("_r") == F.col("_q"), F.col("_n") == F.col("_m"), *(F.col(c).eqNullSafe(F.col(f"_in_{c}")) for c in within)]
    joined = rest.join(moved, functools.reduce(lambda a, b: a & b, same))
    exchanged = joined.select("_r", *(F.col(f"_new_{c}").alias(c) if c in block else F.col(c) for c in rows.columns)).groupBy("_r").agg(statistic.alias("s"))
    observed = rows.agg(statistic.alias("observed"))
    larger = F.count_if(F.col("s") >= F.col("observed") - 1e-12 * F.abs("observed"))
    return exchanged.crossJoin(F.broadcast(observed)).groupBy("observed").agg(((larger + 1) / (repeats + 1)).alias("p_value"), F.count(F.lit(1)).alias("repeats"))  # one row
