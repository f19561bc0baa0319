"""Rows of every day from a place's facts in lists: running totals over arrays of places by days, inside tasks.

Spark gathers what concerns a place into lists in its one row; here these become a matrix of places by days, and every
trailing sum, age and flag is a few passes over it.  A group of places is written out as one Arrow batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Places times days that are worked on together.
CELLS = 40_000
#: Days whose events are a matrix at once when weights meet them.
DAYS_AT_ONCE = 512
_EPOCH = dt.date(1970, 1, 1)


@dataclass(frozen=True)
class Days:
    """A run of `size` days from `first` on, as days since 1970, and which of them are wanted."""

    first: int
    size: int
    wanted: tuple[int, ...]

    @staticmethod
    def of(first: dt.date, last: dt.date, wanted: Sequence[dt.date]) -> Days:
        start = (first - _EPOCH).days
        return Days(start, max(0, (last - first).days + 1), tuple(sorted((d - first).days for d in set(wanted) if first <= d <= last)))


class Lists:
    """The list columns of a batch as entries (row, day, value) inside the run of days."""

    def __init__(self, batch: pa.RecordBatch, days: Days):
        self.batch, self.days, self.rows = batch, days, batch.num_rows

    def _entries(self, name: str) -> tuple[np.ndarray, pa.Array]:
        column = self.batch.column(name)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(self.rows), lengths), column.flatten()

    def at(self, prefix: str, clip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, day, which entries these are) of a table's entries inside the days; with clip, earlier days too, negative."""
        row, day = self._entries(f"{prefix}_day")
        day = day.view(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64) - self.days.first
        inside = np.flatnonzero((day < self.days.size) & (clip | (day >= 0)))
        return row[inside], day[inside], inside

    def values(self, name: str, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether there is one) of entries."""
        flat = self._entries(name)[1]
        flat = flat.view(pa.int32()) if pa.types.is_date32(flat.type) else flat
        held = flat.is_valid().to_numpy(zero_copy_only=False)[which]
        zero = False if pa.types.is_boolean(flat.type) else 0
        return pc.fill_null(flat, zero).to_numpy(zero_copy_only=False)[which], held

    def full(self, name: str) -> np.ndarray:
        """A column whose lists have a value for each day, 0 where there is no list."""
        column, out = self.batch.column(name), np.zeros((self.rows, self.days.size))
        out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.days.size)
        return out

    def matrix(self, row: np.ndarray, day: np.ndarray, value: np.ndarray, kind=np.int64) -> np.ndarray:
        out = np.zeros((self.rows, self.days.size), kind)
        np.add.at(out, (row, day), value)
        return out


def before(m: np.ndarray) -> np.ndarray:
    """Totals of all days before each day; one column more than m, the total of all days."""
    out = np.zeros((m.shape[0], m.shape[1] + 1), m.dtype)
    np.cumsum(m, axis=1, out=out[:, 1:])
    return out


def trailing(total: np.ndarray, window: int) -> np.ndarray:
    """Sums over the `window` days before each day, from before()."""
    out = total[:, :-1].copy()
    out[:, window:] -= total[:, : max(0, out.shape[1] - window)]
    return out


def last_age(hit: np.ndarray) -> np.ndarray:
    """Days since the last hit before each day; a large number where there was none."""
    days = np.arange(hit.shape[1], dtype=np.int32)
    last = np.maximum.accumulate(np.where(hit, days, np.int32(-(1 << 20))), axis=1)
    out = np.full(hit.shape, 1 << 20, np.int32)
    out[:, 1:] = days[1:] - last[:, :-1]
    return out


def rolling_sum(m: np.ndarray, days: int) -> np.ndarray:
    """Sums over each day and the days - 1 before it, oldest first; nothing is subtracted, so m may be of doubles."""
    out = np.zeros_like(m)
    for back in range(min(days, m.shape[1]) - 1, -1, -1):
        out[:, back:] += m[:, : m.shape[1] - back]
    return out


def rounded(value: np.ndarray, digits: int) -> np.ndarray:
    """functions.scalar.rounded() of an array."""
    scale, size = 10.0**digits, np.abs(value)
    return np.where(size < 9e15 / scale, np.copysign(np.floor(size * scale + 0.5) / scale, value), value)


def dense_rows(days: Days, attributes: Sequence[str], dated: pa.Table, names: Mapping[str, str], compute, schema: pa.Schema, digits: int | None = None):
    """A function of batches of places for mapInArrow: for each place and wanted day its attributes, the columns of the day
    in `dated`, and the matrices, or (values, present), that compute(Lists) gives by name, under their names here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_day = dated.combine_chunks().sort_by("day")
        at = by_day["day"].combine_chunks().view(pa.int32()).to_numpy().astype(np.int64) - days.first
        inside = np.isin(at, days.wanted)
        by_day, at = by_day.filter(pa.array(inside)).combine_chunks(), at[inside]
        if not len(at):
            return
        run_ = slice(int(at[0]), int(at[-1]) + 1) if len(at) == at[-1] - at[0] + 1 else at
        step = max(1, CELLS // days.size)
        flat = lambda m: np.ascontiguousarray(m[:, run_]).ravel()
        tiled: dict[tuple[int, str], pa.Array] = {}

        def of_day(name: str, n: int) -> pa.Array:
            if (n, name) not in tiled:
                tiled[n, name] = by_day[name].combine_chunks().take(pa.array(np.tile(np.arange(len(at)), n))).cast(schema.field(name).type)
            return tiled[n, name]

        for batch in batches:
            for i in range(0, batch.num_rows, step):
                own = batch.slice(i, step)
                n = own.num_rows
                if n < step:
                    tiled.clear()  # of the last, shorter group
                made = compute(Lists(own, days))
                repeated = pa.array(np.repeat(np.arange(n, dtype=np.int32), len(at)))
                columns = []
                for f in schema:
                    if f.name in attributes:
                        columns.append(own.column(f.name).take(repeated))
                    elif f.name in by_day.column_names:
                        columns.append(of_day(f.name, n))
                    else:
                        found = made[names[f.name]]
                        value, held = found if isinstance(found, tuple) else (found, None)
                        value = flat(value)
                        if digits is not None and value.dtype == np.float64:
                            value = rounded(value, digits)
                        columns.append(pa.array(value, type=f.type, mask=None if held is None else ~flat(held)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def weighted_trailing(sides: Sequence[str], days: Days, lag: int, schema: pa.Schema):
    """A function of the edges (place, neighbour, a weight for each side) and events (neighbour, seen_day, seen_n: lists) of a
    block of places, for cogroup: for each place the sums of weighted events over the `lag` days before each day, as a list
    by side.  Weights and events are matrices and their product is made some days at a time."""

    def run(edges: pa.Table, events: pa.Table) -> pa.Table:
        place = edges["place"].combine_chunks().dictionary_encode()
        other = pc.index_in(edges["neighbour"].combine_chunks(), value_set=events["neighbour"].combine_chunks())
        known = other.is_valid().to_numpy(zero_copy_only=False)
        at = place.indices.to_numpy()[known], pc.fill_null(other, 0).to_numpy(zero_copy_only=False)[known]
        size = len(place.dictionary), events.num_rows
        lists = Lists(events.combine_chunks().to_batches()[0], days) if events.num_rows else None
        row, day, which = lists.at("seen") if lists else (np.zeros(0, np.int64),) * 3
        count = lists.values("seen_n", which)[0].astype(float) if lists else np.zeros(0)
        order = np.argsort(day, kind="stable")
        row, day, count = row[order], day[order], count[order]
        out = {}
        weights = []
        for s in sides:
            w = np.zeros(size)
            w[at] = pc.fill_null(edges[s].combine_chunks(), 0.0).to_numpy(zero_copy_only=False)[known]
            weights.append(w)
            out[s] = np.zeros((size[0], days.size))
        for first in range(0, days.size, DAYS_AT_ONCE):
            last = min(days.size, first + DAYS_AT_ONCE)
            low, high = np.searchsorted(day, [first, last])
            x = np.zeros((size[1], last - first))
            np.add.at(x, (row[low:high], day[low:high] - first), count[low:high])
            for s, w in zip(sides, weights, strict=True):
                out[s][:, first:last] = w @ x
        offsets = pa.array(np.arange(size[0] + 1, dtype=np.int32) * days.size)
        lists_ = []
        for s in sides:
            past = np.zeros_like(out[s])
            past[:, 1:] = rolling_sum(out[s], lag)[:, :-1]
            lists_.append(pa.ListArray.from_arrays(offsets, pa.array(past.ravel())))
        return pa.Table.from_arrays([place.dictionary.cast(schema.field(0).type), *lists_], schema=schema)

    return run
