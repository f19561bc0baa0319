"""Language identification by a small convolutional network over UTF-8 bytes.

Byte embeddings, filters of several widths, max pooling over a window and a softmax; trained in numpy on
windows of labelled texts.  Prediction cuts each whole text into windows of WINDOW bytes, runs them in
batches and averages the windows' probabilities by their length, so a long text costs memory by the
batch, not by its length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm import tokens
from terrapanel.llm.staging import column_or_null, small_batches

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Bounds of the training sample: documents, documents of each language at least, and windows of each.
SAMPLE_DOCS = 2000
LEAST_DOCS = 50
#: Languages whose counts are broadcast.
MOST_LANGS = 10_000
SAMPLE_WINDOWS = 6
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Trained weights; the filters of all widths stand in one matrix, with zeros beyond their width."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), self.filters.shape[1]), np.float32)
        for i in range(0, len(windows), 32):  # few enough for a core's cache
            part = windows[i : i + 32]
            x = np.take(self.embed, part, axis=0).reshape(len(part), -1)
            wide = np.lib.stride_tricks.sliding_window_view(x, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]
            flat = np.ascontiguousarray(wide).reshape(-1, max(WIDTHS) * EMBED)
            h = (flat @ self.filters).reshape(len(part), -1, self.filters.shape[1])
            half = h.shape[1] // 2
            out[i : i + 32] = np.maximum(np.maximum(h[:, :half], h[:, half : 2 * half]).max(axis=1), h[:, -1])
        return np.maximum(out + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 128, rate: float = 0.01, seed: int = 11) -> ByteNet:
    """Adam on cross entropy; only the positions that max pooling chose carry gradients."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    y = np.searchsorted(langs, labels)
    n_filters, reach = FILTERS * len(WIDTHS), max(WIDTHS)
    mask = np.zeros((reach, EMBED, n_filters), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(reach * EMBED, n_filters)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), "bias": np.zeros(n_filters, np.float32),
        "dense": rng.normal(0, 0.3, (n_filters, len(langs))).astype(np.float32), "dense_bias": np.zeros(len(langs), np.float32),
    }
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), batch):
            rows = windows[order[i : i + batch]]
            target = y[order[i : i + batch]]
            b = len(rows)
            x = p["embed"][rows].reshape(b, -1)
            wide = np.lib.stride_tricks.sliding_window_view(x, reach * EMBED, axis=1)[:, ::EMBED]
            h = (np.ascontiguousarray(wide).reshape(-1, reach * EMBED) @ p["filters"]).reshape(b, -1, n_filters)
            at = h.argmax(axis=1)
            pre = np.take_along_axis(h, at[:, None], axis=1)[:, 0] + p["bias"]
            act = np.maximum(pre, 0)
            z = act @ p["dense"] + p["dense_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            dz = z / z.sum(axis=1, keepdims=True)
            dz[np.arange(b), target] -= 1
            dz /= b
            dact = (dz @ p["dense"].T) * (pre > 0)
            chosen = wide[np.arange(b)[:, None], at]  # b, n_filters, reach * EMBED
            g = {"dense": act.T @ dz, "dense_bias": dz.sum(axis=0), "bias": dact.sum(axis=0), "filters": np.einsum("bf,bfk->kf", dact, chosen) * mask}
            back = (dact[:, :, None] * p["filters"].T[None]).reshape(b, n_filters, reach, EMBED)
            byte = rows[np.arange(b)[:, None, None], at[:, :, None] + np.arange(reach)]
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], byte.reshape(-1), back.reshape(-1, EMBED))
            step += 1
            lr = rate * (0.5 if epoch >= epochs // 2 else 1)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(langs, p["embed"], p["filters"], p["bias"], p["dense"], p["dense_bias"])


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sample_windows(batches):
    """Up to SAMPLE_WINDOWS windows of each text, spread over the whole of it."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("k", pa.int32()), ("window", pa.binary())])
    for batch in batches:
        ids, langs, texts, ks, windows = [], [], batch.column(2), [], []
        raw, starts, ends = tokens.text_spans(texts)
        for i, (doc_id, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            size = int(ends[i] - starts[i])
            n = min(SAMPLE_WINDOWS, -(-size // WINDOW))
            for k in range(n):
                at = int(starts[i]) + (size - WINDOW) * k // max(1, n - 1) if n > 1 else int(starts[i])
                ids.append(doc_id), langs.append(lang), ks.append(k), windows.append(raw[at : min(int(ends[i]), at + WINDOW)].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, langs, ks, windows), schema, strict=True)], schema=schema)


def learn(documents: DataFrame) -> ByteNet | None:
    """A network from the text and lang of documents with a lang that are not held out, the first of each
    language by a hash of their id: an equal share of SAMPLE_DOCS for each language, and LEAST_DOCS at
    least; None where there are none.  Of rows of one id the least by lang and text is read."""
    doc_id = column_or_null(documents, "doc_id", "long")
    labelled = documents.select(doc_id.alias("doc_id"), column_or_null(documents, "lang", "string").alias("lang"), column_or_null(documents, "text", "string").alias("text"))
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("c"))
    few = counts.limit(MOST_LANGS + 1).collect()
    if len(few) <= MOST_LANGS:  # else the join shuffles
        counts = F.broadcast(documents.sparkSession.createDataFrame(few, "lang string, c long"))
    quota = max(LEAST_DOCS, SAMPLE_DOCS // max(1, len(few)))
    # The least hashes of a language: about four times its share of ids are ranked, whatever their rows.
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    low = labelled.select("doc_id", "lang", at.alias("at")).join(counts, "lang").filter(F.col("at") * F.col("c") <= 4.0 * quota).distinct()
    chosen = low.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("at", "doc_id"))).filter(F.col("k") <= quota).select("doc_id").distinct()
    rows = labelled.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text")
    sample = rows.mapInArrow(_sample_windows, "doc_id long, lang string, k int, window binary").toArrow()
    if not len(sample):
        return None
    sample = sample.sort_by([(c, "ascending") for c in ("doc_id", "k")])
    windows = np.zeros((len(sample), WINDOW), np.uint8)
    for i, w in enumerate(sample["window"].to_pylist()):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    return train(windows, sample["lang"].to_pylist())


def predict_batch(net: ByteNet, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(class, its mean probability) of each text."""
    classes, scores = np.zeros(len(column), np.int64), np.zeros(len(column))
    for i, j, data, starts, ends in tokens.pieces(column):
        n = -(-(ends - starts) // WINDOW)
        owner = np.repeat(np.arange(j - i), n)
        if not len(owner):
            continue
        first = starts[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
        size = np.minimum(WINDOW, ends[owner] - first)
        total = np.zeros((j - i, len(net.langs)))
        for k in range(0, len(owner), 4096):
            at = first[k : k + 4096, None] + np.arange(WINDOW)
            windows = data[np.minimum(at, len(data) - 1)]
            windows[np.arange(WINDOW) >= size[k : k + 4096, None]] = 0
            np.add.at(total, owner[k : k + 4096], net.probabilities(windows) * size[k : k + 4096, None])
        full = ends > starts
        best = total.argmax(axis=1)
        classes[i:j] = best
        scores[i:j][full] = total[np.arange(j - i), best][full] / (ends - starts)[full]
    return classes, scores


def with_language(documents: DataFrame, result: str, net: ByteNet | None = None) -> DataFrame:
    """documents with a struct column `result` of lang_pred and score; `net` is learned where not given.

    lang_pred is a learned value, or `und` with score 0 for a null text, a text without a letter, and
    where nothing could be learned.  The text alone decides; of equally probable languages the first by name
    counts.  A very long text is read whole, window by window, in a piece of its own.  Repeated rows get equal results; every
    column is kept, whatever its name; empty tables give an empty result.
    """
    spark = documents.sparkSession
    small_batches(spark)
    net = net or learn(documents)
    names = documents.columns
    frame = documents.toDF(*(f"c{k}" for k in range(len(names))))
    if dict(documents.dtypes).get("text") == "string":
        text_at, text = names.index("text"), F.col(f"c{names.index('text')}")
    else:
        text_at, text = len(names), F.lit(None).cast("string")
        frame = frame.withColumn("text", text)
    kept = frame.schema.fields
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    shared = spark.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            classes, scores = predict_batch(shared.value, batch.column(text_at))
            lang = pa.array(shared.value.langs, pa.string()).take(pa.array(classes))
            struct = pa.StructArray.from_arrays([lang, pa.array(np.clip(scores, 0, 1))], names=["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, "result"])

    schema = T.StructType([*kept, T.StructField("result", T.StructType.fromDDL("lang_pred string, score double"))])
    found = frame.mapInArrow(run, schema) if net else frame.withColumn("result", F.lit(None).cast("struct<lang_pred:string,score:double>"))
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    decided = F.when(known if net else F.lit(False), F.col("result")).otherwise(unknown)
    return found.select(*(F.col(f"c{k}") for k in range(len(names))), decided.alias("result")).toDF(*names, result)


def language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; see with_language()."""
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    return with_language(docs, "r", learn(documents)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "r.lang_pred", "r.score")


def keep_identified(documents: DataFrame, least_score: float = 0.3) -> DataFrame:
    """documents without those whose language is unknown or scores under least_score."""
    mark = "language"
    while mark in documents.columns:
        mark += "_"
    scored = with_language(documents, mark)
    return scored.filter((F.col(f"`{mark}`.lang_pred") != UNKNOWN) & (F.col(f"`{mark}`.score") >= least_score)).drop(mark)
