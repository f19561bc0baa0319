"""Words and word hashes of whole Arrow string columns, computed over the UTF-8 bytes with numpy.

Nothing is decoded row by row: a batch is one byte buffer with offsets, words are runs of word bytes,
and a word's hash is made of its blocks of eight bytes.  Batches are cut into pieces of about PIECE_BYTES
so that a worker's memory does not follow the batch size; only a single longer document exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that white space ends, and of words of letters, digits and non-ASCII characters
#: (to be looked up in lower-cased bytes).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Masks of the first 0 to 8 bytes of a little-endian block.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_GRAM_FACTORS = np.random.default_rng(20240608).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of a string column; a null is an empty span."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        gone = np.asarray(column.is_null())
        ends[gone] = starts[gone]
    return raw, starts, ends


def pieces(column: pa.Array, size: int = PIECE_BYTES, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends): runs of rows of about `size` bytes and at most `rows` rows,
    spans relative to the run's bytes."""
    raw, starts, ends = text_spans(column)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        j = min(j, i + rows) if rows else j
        base = starts[i]
        yield i, j, raw[base : max(base, ends[j - 1])], starts[i:j] - base, ends[i:j] - base
        i = j


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row) of every maximal run of bytes of `kind`; a run ends with its row."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = ends > starts
    first[starts[full]] = inside[starts[full]]
    last[ends[full] - 1] = inside[ends[full] - 1]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(starts, begin, "right") - 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    Each block of eight bytes is mixed with its number in the span, and the mixed blocks are added up, so
    that no repetition inside a long span can cancel out as it does in a polynomial modulo 2**64.
    """
    if not len(begin):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = end - begin
    blocks = np.maximum(1, (size + 7) >> 3)
    if blocks.max() == 1:
        number, at, left = np.zeros(1, np.uint64), begin, size
    else:
        before = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        number, at, left = before.astype(np.uint64), np.repeat(begin, blocks) + 8 * before, np.repeat(size, blocks) - 8 * before
    value = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
    value += (number + np.uint64(seed * 2 + 1)) * np.uint64(0x9E3779B97F4A7C15)
    out = mix(value)
    if len(out) > len(size):
        out = np.add.reduceat(out, np.cumsum(blocks) - blocks)
    out ^= size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the lower-cased (A-Z) bytes."""
    low = LOWER[data]
    begin, end, row = words(low, starts, ends, kind)
    return span_hashes(low, begin, end), row


def gram_hashes(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all runs of `size` words; of a row with fewer words, one hash of them all."""
    n = len(hashes)
    count = np.bincount(row, minlength=n_rows)
    out, out_row = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    if n >= size:
        same = row[: n - size + 1] == row[size - 1 :]
        total = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            total += hashes[k : n - size + 1 + k] * _GRAM_FACTORS[k]
        out, out_row = mix(total[same]), row[: n - size + 1][same]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = (np.cumsum(count) - count)[short]
        total = count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(size - 1):
            has = count[short] > k
            total[has] += hashes[at[has] + k] * _GRAM_FACTORS[k + 8]
        out, out_row = np.concatenate([out, mix(total)]), np.concatenate([out_row, short.astype(row.dtype)])
        order = np.argsort(out_row, kind="stable")
        out, out_row = out[order], out_row[order]
    return out, out_row
