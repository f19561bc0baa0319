"""Scores of posts and their roll-up to places and days."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.sources.shared import small_batches

POSITIVE = ("good", "great", "happy", "love", "safe", "healthy", "calm")
NEGATIVE = ("bad", "awful", "sick", "dead", "hate", "fear", "stupid", "idiot", "scum")


def lexicon_score(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) words of a text, 0 without any, null for a null text."""
    low = F.lower(text)
    n = lambda of: F.regexp_count(low, F.lit(rf"(?<![a-z])(?:{'|'.join(w for w in of if re.fullmatch('[a-z]+', w)) or '(?!)'})(?![a-z])")).cast("long")
    share = lambda c: F.when(c["good"] + c["bad"] > 0, (c["good"] - c["bad"]) / (c["good"] + c["bad"])).otherwise(F.lit(0.0))
    # The counts are bound once, and not made anew for each of their uses.
    counted = F.transform(F.array(F.struct(n(positive).alias("good"), n(negative).alias("bad"))), share)
    return F.when(text.isNotNull(), F.element_at(counted, 1))


def score_with(posts: DataFrame, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]], text: str = "text", into: str = "score", translate: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """posts with a score in [-1, 1] of a scorer that is made once in each task and fed batch by batch;
    `translate`, if given, is applied to a batch's texts first.  A null text has a null score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            texts = batch[text]
            known = texts.notna()
            scores = pd.Series(float("nan"), index=batch.index)
            if known.any():
                given = texts[known] if translate is None else translate(texts[known])
                scores[known] = scorer(given).clip(-1, 1)
            yield batch.assign(**{into: scores.astype(object).where(known, None)})

    small_batches(posts.sparkSession)
    schema = T.StructType([*(f for f in posts.schema.fields if f.name != into), T.StructField(into, T.DoubleType())])
    return posts.drop(into).mapInPandas(run, schema)


def sentiment_rollup(scored: DataFrame, below: float = 0.0) -> DataFrame:
    """(place, day, post_count, sentiment_mean, sentiment_neg_share, lang_breakdown) of posts (place, day,
    lang, score).  A post without a score counts as a post but not in the mean and share."""
    known = F.when(F.col("score").isNotNull(), (F.col("score") < below).cast("double"))
    kinds = scored.groupBy("place", "day", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count("score").alias("k"), F.sum(known).alias("b"))
    total = kinds.groupBy("place", "day").agg(F.sum("n").alias("post_count"), F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("b").alias("b"), F.array_sort(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n")))).alias("langs"))
    share = F.transform("langs", lambda x: F.struct(x["lang"].alias("key"), (x["n"] / F.aggregate("langs", F.lit(0).cast("long"), lambda a, y: a + y["n"])).alias("value")))
    per = lambda c: F.when(F.col("k") > 0, F.col(c) / F.col("k"))
    return total.select("place", "day", "post_count", per("s").alias("sentiment_mean"), per("b").alias("sentiment_neg_share"), F.to_json(F.map_from_entries(share)).alias("lang_breakdown"))

