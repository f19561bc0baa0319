"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed words and word pairs, and what tells prose from tables, shouting, symbol noise and loops in
any language: trigrams of character classes (letter, capital, digit, line end, separator, symbol, ...) and
repeated words.  A document's term weights are the square roots of its term shares, times an inverse document
frequency; the latent space is a truncated singular value decomposition of the labelled sample.  The labelled
vectors, of bounded number, are broadcast, and every document's cosine to all of them is computed in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import tokens
from terrapanel.llm.lang_id import held_out
from terrapanel.llm.staging import column_or_null, record_batch, small_batches

#: Bound of the labelled sample.
SAMPLE_DOCS = 3000
DIMENSIONS = 32
NEIGHBOURS = 25

#: Character classes by byte.
_CLASS = np.full(256, 9, dtype=np.int32)
_CLASS[[32, 9]] = 0
_CLASS[[10, 13]] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[128:] = 5
_CLASS[[44, 46, 58, 59]] = 6
_CLASS[[124, 95, 45]] = 7
_CLASS[[35, 36, 37, 38, 42, 33, 64, 94, 126, 43, 61]] = 8
_N = 10
#: Buckets of hashed words, and of hashed pairs of words.
WORDS = 1024
#: The trigrams, then: words like the one before, words like the second one before, words, long words; then
#: the buckets of words and of pairs.
TERMS = _N**3 + 4 + 2 * WORDS
#: Texts in one block of counts.
BLOCK_ROWS = 256


def term_counts(column: pa.Array):
    """(first row, counts of terms by row), piece by piece, over whole texts."""
    for i, j, data, starts, ends in tokens.pieces(column, 1 << 18, BLOCK_ROWS):
        n = j - i
        counts = np.zeros(n * TERMS, np.float32)
        if len(data) >= 3:
            kind = _CLASS[data]
            code = kind[:-2] * (_N * _N) + kind[1:-1] * _N + kind[2:]
            row = np.repeat(np.arange(n), ends - starts)
            inside = row[:-2] == row[2:]
            counts += np.bincount(row[:-2][inside] * TERMS + code[inside], minlength=n * TERMS)
        low = tokens.LOWER[data]
        begin, end, row = tokens.words(data, starts, ends, tokens.NOT_SPACE)
        if len(row):
            at = counts.reshape(n, TERMS)
            hashes = tokens.span_hashes(data, begin, end)
            at[:, _N**3 + 2] = np.bincount(row, minlength=n)
            at[:, _N**3 + 3] = np.bincount(row[end - begin > 14], minlength=n)
            for back in (1, 2):
                same = np.flatnonzero((hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back]))
                at[:, _N**3 + back - 1] = 4 * np.bincount(row[same], minlength=n)
            begin, end, row = tokens.words(low, starts, ends, tokens.ALNUM)
            hashes = tokens.span_hashes(low, begin, end)
            pair = tokens.mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
            inside = row[:-1] == row[1:]
            for first, h, r in ((_N**3 + 4, hashes, row), (_N**3 + 4 + WORDS, pair[inside], row[:-1][inside])):
                counts += np.bincount(r * TERMS + first + (h & np.uint64(WORDS - 1)).astype(np.int64), minlength=n * TERMS)
        yield i, counts.reshape(n, TERMS)


def _weights(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


@dataclass
class LabelledSpace:
    """The projection of term weights, and the labelled vectors in it."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        z = _weights(counts) @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, counts: np.ndarray, block: int = 256) -> np.ndarray:
        """The share of label 1 among the nearest labelled vectors, weighted by similarity; a text
        without terms gets the share among all."""
        out = np.full(len(counts), self.labels.mean())
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(counts), block):
            own = counts[i : i + block]
            cosine = self.project(own) @ self.vectors.T
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            above, equal = cosine > least, cosine == least
            # Of labelled vectors that are equally near, the first by doc_id.
            chosen = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
            near = np.nonzero(chosen)[1].reshape(len(own), k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** 16
            share = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
            full = own.sum(axis=1) > 0
            out[i : i + block][full] = share[full]
        return out


def _leading_axes(a: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """The k leading right singular vectors of a, by subspace iteration."""
    q = np.random.default_rng(7).normal(size=(a.shape[1], min(2 * k, *a.shape)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, turn = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ turn.T).T[:k]


def fit(counts: np.ndarray, labels: np.ndarray) -> LabelledSpace:
    weights = _weights(counts)
    idf = np.log((1 + len(weights)) / (1 + (weights > 0).sum(axis=0))) + 1
    axes = _leading_axes(weights * idf, DIMENSIONS)
    space = LabelledSpace((idf[:, None] * axes[:DIMENSIONS].T).astype(np.float32), np.zeros(0), labels.astype(np.float64))
    space.vectors = space.project(counts.astype(np.float32)).astype(np.float32)
    return space


def learn(documents: DataFrame, labels: DataFrame) -> LabelledSpace | None:
    """The space of SAMPLE_DOCS labelled documents, the first by a hash of their id among those that are
    not held out; None where there are none.  A document labelled more than once counts by its first
    label in ascending order."""
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    marked = labels.select(column_or_null(labels, "doc_id", "long").alias("doc_id"), column_or_null(labels, "quality", "double").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    marked = marked.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.filter("text is not null").select("doc_id").distinct()
    chosen = marked.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def count(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.float64()), ("terms", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for i, counts in term_counts(batch.column(2)):
                n = len(counts)
                terms = [np.flatnonzero(c).astype(np.uint16) for c in counts]
                yield record_batch(schema, doc_id=batch.column(0)[i : i + n], quality=batch.column(1)[i : i + n], terms=[t.tobytes() for t in terms], counts=[c[t].tobytes() for c, t in zip(counts, terms, strict=True)])

    # Of several texts of one id, the least.
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = rows.mapInArrow(count, "doc_id long, quality double, terms binary, counts binary").toArrow()
    if not len(sample):
        return None
    sample = sample.sort_by("doc_id")
    counts = np.zeros((len(sample), TERMS), np.float32)
    for row, terms, own in zip(counts, sample["terms"].to_pylist(), sample["counts"].to_pylist(), strict=True):
        row[np.frombuffer(terms, np.uint16)] = np.frombuffer(own, np.float32)
    return fit(counts, sample["quality"].to_numpy())


def quality_votes(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold).

    Only the text decides a score.  Null and empty texts get the labelled share of label 1; where no
    label can be learned from, every score is 0.5.  A null doc_id is not learned from; repeated rows have
    a result each; of labelled documents that are equally near the first by doc_id votes; other columns are
    ignored, whatever their names; texts are read whole, a long one in a block of its own; empty tables give
    an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    space = learn(documents, labels)
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    if space is None:
        scored = docs.select("doc_id", F.lit(0.5).alias("score"))
    else:
        shared = spark.sparkContext.broadcast(space)

        def run(batches):
            schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
            for batch in batches:
                for i, counts in term_counts(batch.column(1)):
                    yield record_batch(schema, doc_id=batch.column(0)[i : i + len(counts)], score=np.clip(shared.value.vote(counts), 0, 1))

        scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
