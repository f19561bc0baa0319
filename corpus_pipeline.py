"""A corpus from raw documents: stages in order, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.decontaminate import decontaminate
from terrapanel.llm.lang_id import keep_identified
from terrapanel.llm.line_dedup import remove_repeated_windows
from terrapanel.llm.mixing import entropy_mix
from terrapanel.llm.ngram_join import first_of_components
from terrapanel.llm.staging import release, staged, staged_so_far


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises; null and empty texts and texts without letters go,
    repeated rows stay together, an empty table stays empty."""
    return keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of three-line windows; n_chars follows the text.  Null texts and
    texts of fewer lines stay as they are, rows of equal id and text are thinned alike, and of copies of a
    window the one of the least id, then position, stays."""
    cleaned = remove_repeated_windows(docs, n_lines="_n_lines", n_removed="_n_removed")
    n_chars = F.when(F.col("_n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row, the first by doc_id, of each group of near copies; null and repeated ids too.  Rows
    without words, null texts among them, are no copies of anything and stay."""
    return first_of_components(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages to speak of; null and empty texts hold none, repeated rows
    have one fate, and an empty table stays empty."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the training mix takes; one row for each row, null texts and sources
    included."""
    return entropy_mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_copies),
    ("decontamination", remove_contaminated),
    ("source_mixing", mix_sources),
]

#: No SQL for run(): a trained network decides in its first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and reread; what a finished stage had written for itself is
    removed, and what the last one reads is left to staging.release()."""
    start = staged_so_far()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
            release(start)
    return docs
