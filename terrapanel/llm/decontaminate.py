"""Benchmark decontamination by suffix arrays of the training text.

A shard is a run of whole documents of a task.  Its suffix array holds every position of its text, sorted
by the hashes of the words that follow, up to the document's end (prefix doubling).  Every benchmark suffix
is binary-searched in it, word by word, for as long as anything matches: the interval after a whole window
gives that window's occurrences, the deepest one the longest verbatim matches and where they stand.  A
document stays with its shard.  The benchmark is broadcast in blocks of bounded size; where there are several,
each scan yields a small state by document, and the states are merged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm import tokens
from terrapanel.llm.staging import column_or_null, small_batches, staged

#: Bytes of benchmark text and ids in one broadcast block (a single longer item is a block of its own).
BLOCK_BYTES = 4 << 20
#: Bytes of training text in one shard.
SHARD_BYTES = 2 << 20
#: Bits of the table of word pairs that tells which benchmark suffixes can match two words of a shard.
PAIR_BITS = 22

_A, _B = np.uint64(0xB5297A4D3F84D5A7), np.uint64(0x68E31DA41B56C4E9)


def _pair_place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (tokens.mix(first * _A + second * _B) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the row of each word; the first hash is never 0."""
    one, two, owner = [], [], []
    for i, _, data, starts, ends in tokens.pieces(texts):
        low = tokens.LOWER[data]
        begin, end, row = tokens.words(low, starts, ends, tokens.ALNUM)
        one.append(tokens.span_hashes(low, begin, end))
        two.append(tokens.span_hashes(low, begin, end, 1))
        owner.append(row + i)
    if not one:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate(one)
    first[first == 0] = 1
    return first, np.concatenate(two), np.concatenate(owner)


def build_queries(item_ids: list[list[str]], texts: list[str | None], window: int) -> dict:
    """The suffixes of a block of benchmark texts, ready to be searched; item_ids are those of each text."""
    seq, second, item = _words_of(pa.array(texts, pa.large_string()))
    length = np.bincount(item, minlength=len(texts))
    rest = ((np.cumsum(length) - length)[item] + length[item]) - np.arange(len(seq))
    width = np.minimum(window, length[item])
    starts_window = np.flatnonzero(rest >= width)
    # Equal windows have one number, with all their texts, and one suffix that stands for them.
    rows = np.zeros((len(starts_window), window + 1), np.uint64)
    rows[:, window] = width[starts_window]
    for d in range(window):
        has = width[starts_window] > d
        rows[has, d] = seq[starts_window[has] + d]
    _, first, number = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(rows) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    number = number.reshape(-1)
    window_of = np.full(len(seq), -1, np.int64)
    window_of[starts_window[first]] = np.arange(len(first))
    pairs = np.unique(np.stack([number, item[starts_window]], axis=1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
    place = np.zeros(len(seq), np.int64)
    two = np.flatnonzero(rest >= 2)
    place[two] = _pair_place(seq[two], seq[two + 1])
    ids = [sorted(map(str, x)) for x in item_ids]
    by_name = np.argsort(np.argsort([x[0] for x in ids], kind="stable"), kind="stable") if ids else np.zeros(0, np.int64)
    return {
        "seq": seq, "second": second, "width": width, "rest": rest, "window_of": window_of, "place": place, "ids": ids,
        "window_items": pairs[:, 1], "window_at": np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)),
        "text_rank": by_name[item], "text_of_rank": np.argsort(by_name),
    }


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """All positions of seq in the order of the suffixes there, each up to and with the next 0; a 0 ends a
    document and is different from every other one."""
    n = len(seq)
    array = np.argsort(seq)
    ordered = seq[array]
    new = np.append(True, ordered[1:] != ordered[:-1])
    new[: int(np.searchsorted(ordered, 1))] = True
    rank = np.empty(n, np.int64)
    rank[array] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # Only suffixes that are still equal to another one are sorted again, by twice as many words.
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    words = 1
    while len(slots):
        at = array[slots]
        key = rank[at] * n + rank[at + words]
        order = np.argsort(key)
        at, key = at[order], key[order]
        array[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        words *= 2
    return array


def _bisect(seq: np.ndarray, array: np.ndarray, d: int, low: np.ndarray, high: np.ndarray, key: np.ndarray, right: bool) -> np.ndarray:
    """Where `key` belongs among the words d after the sorted positions low to high."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        # No suffix that has matched d words ends before them.
        word = seq[array[mid] + d]
        below = word <= key[open_] if right else word < key[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low to high."""
    n = high - low
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def search(seq: np.ndarray, q: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window's suffix, position) of every occurrence of a window, and for each position of seq the words
    of its longest match of two words or more with a benchmark suffix, and the rank of the first such text."""
    longest, text = np.zeros(len(seq), np.int64), np.full(len(seq), -1, np.int64)
    seen = np.zeros(1 << PAIR_BITS, bool)
    seen[_pair_place(seq[:-1], seq[1:])] = True
    alive = np.flatnonzero((q["rest"] >= 2) & seen[q["place"]] | (q["window_of"] >= 0) & (q["width"] == 1))
    which, at = [], []
    if len(alive):
        array = suffix_array(seq)
        low, high, d = np.zeros(len(alive), np.int64), np.full(len(alive), len(array), np.int64), 0
        while len(alive):
            key = q["seq"][alive + d]
            low, high = _bisect(seq, array, d, low, high, key, False), _bisect(seq, array, d, low, high, key, True)
            keep = low < high
            alive, low, high, d = alive[keep], low[keep], high[keep], d + 1
            done = np.flatnonzero((q["width"][alive] == d) & (q["window_of"][alive] >= 0))
            which.append(np.repeat(alive[done], high[done] - low[done]))
            at.append(array[_ranges(low[done], high[done])])
            if d >= 2 and len(alive):
                # Suffixes that begin alike share an interval, others have none in common.
                order = np.lexsort((q["text_rank"][alive], low))
                first = order[np.append(True, np.diff(low[order]) > 0)]
                here = array[_ranges(low[first], high[first])]
                longest[here] = d
                text[here] = np.repeat(q["text_rank"][alive[first]], high[first] - low[first])
            more = q["rest"][alive] > d
            alive, low, high = alive[more], low[more], high[more]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *which]), np.concatenate([none, *at]), longest, text


def _merge(ranges: np.ndarray) -> np.ndarray:
    """Disjoint sorted [start, end) rows of overlapping ones."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    top = np.maximum.accumulate(ranges[:, 1])
    new = np.append(True, ranges[1:, 0] > top[:-1])
    return np.stack([ranges[new, 0], np.append(top[np.flatnonzero(new)[1:] - 1], top[-1])], axis=1)


def scan(column: pa.Array, q: dict):
    """For each row: words, merged hit ranges, item ids, and (words, first word, item id) of the longest
    match, the earliest one of several."""
    for i, j, data, starts, ends in tokens.pieces(column, SHARD_BYTES):
        n = j - i
        data = tokens.LOWER[data]
        begin, end, row = tokens.words(data, starts, ends, tokens.ALNUM)
        hashes = tokens.span_hashes(data, begin, end)
        hashes[hashes == 0] = 1
        count = np.bincount(row, minlength=n)
        seq = np.zeros(len(hashes) + n, np.uint64)
        seq[np.arange(len(hashes)) + row] = hashes
        first = np.cumsum(count) - count + np.arange(n)
        which, at, longest, text = search(seq, q)
        if len(at):
            # A hit counts only if a second hash of each of its words agrees.
            doc = np.searchsorted(first, at, "right") - 1
            width = q["width"][which]
            word = np.repeat(at - doc - np.cumsum(width) + width, width) + np.arange(width.sum())
            other = np.repeat(which - np.cumsum(width) + width, width) + np.arange(width.sum())
            used, inverse = np.unique(word, return_inverse=True)
            same = tokens.span_hashes(data, begin[used], end[used], 1)[inverse] == q["second"][other]
            good = np.logical_and.reduceat(same, np.cumsum(width) - width)
            which, at, doc, width = which[good], at[good], doc[good], width[good]
        ranges, items = [None] * n, [[]] * n
        if len(at):
            order = np.argsort(doc, kind="stable")
            bounds = np.searchsorted(doc[order], np.arange(n + 1))
            for r in np.unique(doc):
                own = order[bounds[r] : bounds[r + 1]]
                ranges[r] = _merge(np.stack([at[own] - first[r], at[own] - first[r] + width[own]], axis=1))
                windows = np.unique(q["window_of"][which[own]])
                texts = np.unique(np.concatenate([q["window_items"][q["window_at"][k] : q["window_at"][k + 1]] for k in windows]))
                items[r] = sorted({x for k in texts for x in q["ids"][k]})
        # The longest match of each document; of several, the earliest.
        best = np.maximum.reduceat(longest * len(seq) + (len(seq) - 1 - np.arange(len(seq))), first)
        most, where = best // len(seq), len(seq) - 1 - best % len(seq)
        for r in range(n):
            match = (int(most[r]), int(where[r] - first[r]), q["ids"][q["text_of_rank"][text[where[r]]]][0]) if most[r] else (0, None, None)
            yield int(count[r]), ranges[r], items[r], match


_STATE = pa.schema([("n_words", pa.int64()), ("ranges", pa.binary()), ("items", pa.list_(pa.string())), ("longest_match", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())])
_STATE_DDL = "n_words long, ranges binary, items array<string>, longest_match long, longest_at long, longest_item string"
_HITS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("items_sha256", pa.string()), ("hits", _HITS), ("longest_match", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string()), ("contaminated", pa.bool_())])
_RESULT_DDL = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, hits array<struct<first:long,last:long>>, longest_match long, longest_at long, longest_item string, contaminated boolean"


def _result_field() -> T.StructField:
    return T.StructField("state", T.StructType.fromDDL(_RESULT_DDL))


def _result(n: int, ranges: np.ndarray | None, items: list[str], match: tuple, share: int) -> tuple:
    hit = 0 if ranges is None else int((ranges[:, 1] - ranges[:, 0]).sum())
    hits = [] if ranges is None else [{"first": int(a), "last": int(b) - 1} for a, b in ranges]
    return n, hit, len(items), items, hashlib.sha256(",".join(items).encode()).hexdigest(), hits, *match, hit > 0 and share * hit >= n


def _with_results(text_at: int, q, share: int):
    """Every column and a struct of the result."""

    def run(batches):
        for batch in batches:
            rows = [_result(*r, share) for r in scan(batch.column(text_at), q.value)]
            arrays = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_RESULT)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(arrays, fields=list(_RESULT))], names=[*batch.schema.names, "state"])

    return run


def _states(q):
    """(doc_id, h1, h2, text) to (doc_id, h1, h2) and the state of one block, for rows that it matches."""

    def run(batches):
        for batch in batches:
            kept, rows = [], []
            for k, (n, ranges, items, match) in enumerate(scan(batch.column(3), q.value)):
                if match[0] or items:
                    kept.append(k), rows.append((n, None if ranges is None else np.ascontiguousarray(ranges).tobytes(), items, *match))
            names = batch.schema.names[:3]
            own = [c.take(pa.array(kept, pa.int64())) for c in batch.columns[:3]]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_STATE))], names=[*names, *_STATE.names])

    return run


def _merged(share: int):
    """(doc_id, h1, h2, n_words, list of ranges, items, longest) to (doc_id, h1, h2, state)."""

    def run(batches):
        for batch in batches:
            out = []
            for n, ranges, items, match in zip(*(c.to_pylist() for c in batch.columns[3:7]), strict=True):
                parts = [np.frombuffer(r, np.int64).reshape(-1, 2) for r in ranges if r]
                found = (match["longest_match"], match["longest_at"], match["longest_item"]) if match["longest_match"] else (0, None, None)
                out.append(_result(n, _merge(np.concatenate(parts)) if parts else None, sorted(set(items)), found, share))
            arrays = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(_RESULT)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.StructArray.from_arrays(arrays, fields=list(_RESULT))], names=[*batch.schema.names[:3], "state"])

    return run


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's different texts with their ids, and how many blocks of about BLOCK_BYTES they make."""
    items = benchmark.select(F.coalesce(column_or_null(benchmark, "item_id", "string"), F.lit("")).alias("item_id"), column_or_null(benchmark, "text", "string").alias("text"))
    texts = staged(items.filter("text is not null").groupBy("text").agg(F.collect_set("item_id").alias("ids")), "benchmark")
    n_bytes = texts.agg(F.sum(F.octet_length("text") + F.octet_length(F.array_join("ids", ",")))).first()[0] or 0
    return texts, 1 + int(n_bytes) // BLOCK_BYTES


def _block(texts: DataFrame, k: int, n: int, window: int) -> dict:
    part = texts if n == 1 else texts.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
    rows = sorted((r["text"], r["ids"]) for r in part.collect())  # about BLOCK_BYTES
    return build_queries([ids for _, ids in rows], [text for text, _ in rows], window)


def _hashed(doc_id, text):
    return doc_id.alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")


def _block_results(frame: DataFrame, texts: DataFrame, n: int, window: int, share: int) -> DataFrame:
    """(doc_id, h1, h2, state) of the rows (doc_id, h1, h2, text) that some of n blocks match: one scan for
    each block, whose states are merged.  Equal rows have equal states, so copies of a row count once."""
    spark = frame.sparkSession
    states = None
    for k in range(n):
        q = spark.sparkContext.broadcast(_block(texts, k, n, window))
        own = staged(frame.mapInArrow(_states(q), f"doc_id long, h1 long, h2 long, {_STATE_DDL}"), "contamination")
        q.destroy()
        states = own if states is None else states.union(own)
    # Of the longest matches the earliest, of those the one with the least item.
    match = F.struct(F.col("longest_match").alias("l"), (-F.col("longest_at")).alias("p"))
    longest = F.max(match)
    item = F.min_by("longest_item", F.struct(-F.col("longest_match"), F.col("longest_at"), F.col("longest_item")))
    merged = states.groupBy("doc_id", "h1", "h2").agg(F.max("n_words").alias("n_words"), F.collect_set("ranges").alias("ranges"), F.flatten(F.collect_set("items")).alias("items"), longest.alias("m"), item.alias("item"))
    merged = merged.select("doc_id", "h1", "h2", "n_words", "ranges", "items", F.struct(F.col("m.l").alias("longest_match"), (-F.col("m.p")).alias("longest_at"), F.col("item").alias("longest_item")).alias("match"))
    return merged.mapInArrow(_merged(share), T.StructType([*T.StructType.fromDDL("doc_id long, h1 long, h2 long").fields, _result_field()]))


def with_contamination(documents: DataFrame, benchmark: DataFrame, result: str, window: int = 13, share: int = 20) -> DataFrame:
    """documents with a struct column `result`: n_words, n_hit, n_items, items, items_sha256, hits (ranges of
    hit words, from 0), longest_match, longest_at and longest_item (the words of the longest match with any
    benchmark suffix, its first word, and its item), contaminated.

    A word is a run of letters a-z, digits and non-ASCII characters of the text with A-Z lower-cased.
    An item's windows are its runs of `window` words, or all its words where it has fewer; a document's
    word inside an occurrence of a window is hit.  A document is contaminated when it has a hit and
    share * n_hit >= n_words.  Words are compared by hashes, those of hits by 128 bits, of the longest match
    by 64; matches of one word are not looked for, save windows of one word.

    Null and empty texts have no words and no hits; items without words have no windows; equal item ids
    count once, a null id as the empty string; equal items are searched once; repeated rows have a result
    each; an empty benchmark hits nothing.  Of equally long matches the earliest counts, of the items that
    have it the least.  Texts are read whole: a text longer than SHARD_BYTES is a shard of its own.  Every
    column of documents is kept, whatever its name.
    """
    spark = documents.sparkSession
    small_batches(spark)
    names = documents.columns
    frame = documents.toDF(*(f"c{k}" for k in range(len(names))))
    has_text = dict(documents.dtypes).get("text") == "string"
    text_at = names.index("text") if has_text else len(names)
    if not has_text:
        frame = frame.withColumn(f"c{text_at}", F.lit(None).cast("string"))
    texts, n = _items(benchmark)
    if n == 1:
        q = spark.sparkContext.broadcast(_block(texts, 0, 1, window))
        schema = T.StructType([*frame.schema.fields, _result_field()])
        found = frame.mapInArrow(_with_results(text_at, q, share), schema)
    else:
        text = F.col(f"c{text_at}")
        doc_id = F.col(f"c{names.index('doc_id')}").cast("long") if "doc_id" in names else F.lit(None).cast("long")
        matched = _block_results(frame.select(*_hashed(doc_id, text), text.alias("text")), texts, n, window, share).toDF("r_id", "r_h1", "r_h2", "state")
        n_words = F.coalesce(F.regexp_count(F.translate(text, _UPPER, _UPPER.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        nothing = {"n_words": n_words, "n_hit": F.lit(0), "n_items": F.lit(0), "items": F.array(), "items_sha256": F.sha2(F.lit(""), 256), "hits": F.array(), "longest_match": F.lit(0), "contaminated": F.lit(False)}
        clean = F.struct(*(nothing.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _result_field().dataType))
        joined = frame.select("*", *_hashed(doc_id, text)).join(matched, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2")), "left")
        found = joined.withColumn("state", F.coalesce("state", clean))
    return found.select(*(f"c{k}" for k in range(len(names))), "state").toDF(*names, result)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """doc_id with the columns of with_contamination(); see there for special cases."""
    docs = documents.select(column_or_null(documents, "doc_id", "long").alias("doc_id"), column_or_null(documents, "text", "string").alias("text"))
    return with_contamination(docs, benchmark, "r", window, share).select("doc_id", "r.*")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """documents without the contaminated ones, with the same columns; see with_contamination()."""
    mark = "contamination"
    while mark in documents.columns:
        mark += "_"
    return with_contamination(documents, benchmark, mark, window, share).filter(~F.col(f"`{mark}`.contaminated")).drop(mark)
