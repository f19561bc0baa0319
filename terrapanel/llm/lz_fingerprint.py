"""Document fingerprints from Lempel-Ziv phrases.

A text's bytes are parsed into dictionary phrases (each the longest phrase seen so far in this text and
one more byte); the set of phrases is hashed, and its least SKETCH hashes are the fingerprint.  Two
fingerprints compare by the share of equal hashes among the least SKETCH of both, an estimate of the
Jaccard index of the phrase sets, which is high for texts that compress each other well.

To compare each document with the next one, documents are dealt to ranges of doc_id (those of one id that
is very common to parts by a hash of the text), sorted inside each and streamed; the first document of a
range is also sent to the range before it.  Only rows equal in id and text stay together in one part.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import tokens
from terrapanel.llm.staging import column_or_null, small_batches

#: Hashes of a fingerprint, 32 bits each.
SKETCH = 128
#: Bytes of text in one range of documents, and the most ranges (their first ids are broadcast).
RANGE_BYTES = 1 << 20
MOST_RANGES = 100_000


def _parse(data: bytes, book: dict[int, int], ends: list[int], at: int) -> None:
    """Appends the phrase ends of data to ends and its phrases to book; the last phrase may be a known
    one.  A key is the phrase before its last byte, by number, and that byte; the empty phrase is 0."""
    node, get = 0, book.get
    for at, byte in enumerate(data, at + 1):
        key = node | byte
        node = get(key)
        if node is None:
            ends.append(at)
            book[key] = len(ends) << 8
            node = 0
    if node:
        ends.append(at)


def phrase_ends(data: bytes, resume: tuple[dict[int, int], list[int]] | None = None, at: int = 0) -> list[int]:
    """Where the phrases of data end; `resume` continues a parse whose last phrase was complete."""
    book, ends = resume or ({}, [])
    _parse(data, book, ends, at)
    return ends


def _sketch(data: np.ndarray, ends: list[int]) -> np.ndarray:
    if not ends:
        return np.zeros(0, np.uint32)
    end = np.array(ends)
    hashes = (tokens.span_hashes(data, np.append(0, end[:-1]), end) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * SKETCH:
        hashes.partition(2 * SKETCH)
        least = np.unique(hashes[: 2 * SKETCH])
        if len(least) >= SKETCH:
            return least[:SKETCH]
        hashes = np.unique(hashes)
    return np.unique(hashes)[:SKETCH]


def fingerprint(text: bytes) -> np.ndarray:
    """The least SKETCH distinct 32-bit hashes of the text's phrases, in order."""
    return _sketch(np.frombuffer(text, np.uint8), phrase_ends(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    repeat = both[1:] == both[:-1]
    union = both[np.append(True, ~repeat)]
    last = union[min(SKETCH, len(union)) - 1]
    return float(np.count_nonzero(both[1:][repeat] <= last)) / min(SKETCH, len(union))


def _code_points(data: bytes) -> np.ndarray:
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def edit(text: bytes, following: bytes) -> tuple[bytes, int]:
    """text with its last half (in code points, rounded down) replaced by as many from the start of
    `following`, or all of it; and how many code points text has."""
    starts = _code_points(text)
    n = len(starts)
    half = n // 2
    cut = int(starts[n - half]) if half else len(text)
    after = _code_points(following)
    return text[:cut] + following[: int(after[half]) if half < len(after) else len(following)], n


def both_fingerprints(text: bytes, edited: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints of a text and of its edited text; what they begin with alike is parsed once, up to
    the last phrase that ends there."""
    n = min(len(text), len(edited))
    x, y = np.frombuffer(text, np.uint8), np.frombuffer(edited, np.uint8)
    differ = x[:n] != y[:n]
    common = int(differ.argmax()) if differ.any() else n
    book: dict[int, int] = {}
    ends: list[int] = []
    _parse(text[:common], book, ends, 0)
    if ends and len(ends) != len(book):
        ends.pop()  # an unfinished phrase
    done = ends[-1] if ends else 0
    other, other_ends = dict(book), list(ends)
    _parse(text[done:], book, ends, done)
    _parse(edited[done:], other, other_ends, done)
    return _sketch(x, ends), _sketch(y, other_ends)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _stream(batches):
    """Rows (part, extra, doc_id, text) in order.  A row is fingerprinted when the next one of its part
    has come and finished when that one is fingerprinted; an extra row, the first document of the part
    after, only serves the row before it."""
    out: list[list] = [[] for _ in _SCHEMA]

    def finish(held, following):
        for column, value in zip(out, [*held[0], likeness(held[1], following)], strict=True):
            column.append(value)

    current = held = None
    for batch in batches:
        for part, extra, doc_id, data in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
            data = data or b""
            if current is not None and current[0] == part:
                edited, n = edit(current[2], data)
                own, changed = both_fingerprints(current[2], edited)
                if held is not None:
                    finish(held, own)
                held = [current[1], n, hashlib.sha256(edited).hexdigest(), _hex(own), _hex(changed), likeness(own, changed)], own
                if extra:
                    finish(held, own if data == current[2] else fingerprint(data))
            current, held = (None, None) if extra else ((part, doc_id, data), held if current is not None and current[0] == part else None)
        if len(out[0]) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
            out = [[] for _ in _SCHEMA]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)


def lz_fingerprints(documents: DataFrame) -> DataFrame:
    """For each document, its fingerprint, and how alike it is to its edited text and to the next document.

    Documents stand in ascending order of doc_id (null first; rows of equal id by a hash of the text) and
    the first follows the last.  The edited text has the last half of the code points (rounded down)
    replaced by as many from the start of the next document, or all of it.  Returns doc_id, n_chars (code
    points), edited_sha256, fingerprint and edited_fingerprint (SKETCH 32-bit hashes in hexadecimal, or
    fewer where there are fewer phrases), near_edited and near_next (0 to 1).

    Texts are parsed whole, one after the other, so a very long one costs its own size and dictionary.  Rows of
    equal id and hash, which are equal texts, have no order among them and need none.
    A null text is an empty one: no phrases, an empty fingerprint, alike only to another empty one.  Equal
    texts have equal fingerprints.  A single document is its own next one; repeated rows follow each
    other; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    text = column_or_null(documents, "text", "string")
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("h"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63))))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MOST_RANGES, 1 + n_bytes // RANGE_BYTES))
    found = docs.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], max(10_000, 5 * n))).first()[0] or []
    # An id that takes up several ranges, as null can, has a range of its own, dealt to parts by hash.
    hot = [float(x) for x, c in Counter(found).items() if c > 2]
    splits = sorted({*map(float, found), *hot, *(math.nextafter(x, math.inf) for x in hot)}) if n > 1 else []
    ranges = Bucketizer(splits=[float("-inf"), *(splits or [0.0]), float("inf")], inputCol="at", outputCol="range")
    placed = ranges.transform(docs.withColumn("at", F.col("id").cast("double"))).withColumn("range", F.col("range").cast("int"))
    # One row for each range and then for each part, of which there are at most about 2 * MOST_RANGES.
    sizes = placed.groupBy("range").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.octet_length("text")).alias("b")).filter(F.col("low") == F.col("high"))
    sizes = [(r["range"], int(min(MOST_RANGES, 1 + (r["b"] or 0) // RANGE_BYTES))) for r in sizes.collect()]
    parts = F.broadcast(spark.createDataFrame([x for x in sizes if x[1] > 2] or [(-1, 1)], "range int, parts int"))
    share = F.floor((F.col("h") / float(1 << 64) + 0.5) * F.col("parts"))
    placed = placed.join(parts, "range", "left").withColumn("sub", F.coalesce(F.least(share, F.col("parts") - 1), F.lit(0)).cast("int"))
    firsts = placed.groupBy("range", "sub").agg(F.min(F.struct("id", "h")).alias("f")).orderBy("range", "sub").collect()
    before = [(r["f"]["id"], r["f"]["h"], firsts[k - 1]["range"], firsts[k - 1]["sub"]) for k, r in enumerate(firsts)]
    before = F.broadcast(spark.createDataFrame(before, "id long, h long, b_range int, b_sub int"))
    own = F.struct(F.col("range").alias("range"), F.col("sub").alias("sub"), F.lit(False).alias("extra"))
    sent = F.when(F.col("b_range").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("b_range").alias("range"), F.col("b_sub").alias("sub"), F.lit(True).alias("extra"))))
    dealt = placed.join(before, ["id", "h"], "left").withColumn("to", F.explode(sent)).select((F.col("to.range").cast("long") * (1 << 32) + F.col("to.sub")).alias("part"), "to.extra", "doc_id", "text", "id", "h")
    small_batches(spark)
    return dealt.repartition("part").sortWithinPartitions("part", "extra", "id", "h").mapInArrow(_stream, _DDL)
