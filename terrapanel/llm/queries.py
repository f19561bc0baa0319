"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import oracle
from terrapanel.llm.collocations import collocations
from terrapanel.llm.decontaminate import contamination
from terrapanel.llm.lang_id import language_id
from terrapanel.llm.license_scan import license_findings
from terrapanel.llm.line_dedup import line_dedup
from terrapanel.llm.lz_fingerprint import lz_fingerprints
from terrapanel.llm.merkle import audit
from terrapanel.llm.mixing import entropy_mix
from terrapanel.llm.multiprobe import nearest_neighbours
from terrapanel.llm.ngram_join import ngram_jaccard_components
from terrapanel.llm.pii import pseudonymize
from terrapanel.llm.quality_knn import quality_votes
from terrapanel.llm.whitening import whiten

#: The key of the registered pseudonyms; a deployment passes its own.
DEMO_KEY = "terrapanel demonstration key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def damaged_replica(pages: DataFrame) -> DataFrame:
    """pages as a replica with known faults: every 97th page changed, every 193rd missing, and a second
    copy of every 389th under an id that the primary does not have."""
    kept = pages.filter(F.pmod("page_id", F.lit(193)) != 7)
    changed = kept.withColumn("html", F.when(F.pmod("page_id", F.lit(97)) == 5, F.concat("html", F.lit(" "))).otherwise(F.col("html")))
    return changed.unionByName(pages.filter(F.pmod("page_id", F.lit(389)) == 11).withColumn("page_id", -1 - F.col("page_id")))


def op1_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged_replica(pages))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_findings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_paragraphs", "n_licenses", "licenses", F.array_join(F.col("found.paragraph").cast("array<string>"), ",").alias("paragraphs"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprints(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op13_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_merkle_fixity_audit, op2_feistel_pseudonyms, op3_ngram_jaccard_join, op4_license_scan, op5_language_id,
        op6_benchmark_decontamination, op7_quality_knn, op8_lz_fingerprints, op9_source_mixing, op10_line_dedup, op11_embedding_whitening, op12_multiprobe_neighbours,
        op13_collocation_mining,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others are learned, keyed with a permutation, or rounded by a rule that SQL does not express."""
    return {"op1_merkle_fixity_audit": oracle.MERKLE, "op3_ngram_jaccard_join": oracle.NGRAMS, "op6_benchmark_decontamination": oracle.CONTAMINATION, "op10_line_dedup": oracle.LINES, "op13_collocation_mining": oracle.COLLOCATIONS}
