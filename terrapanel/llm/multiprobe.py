"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are put on the unit sphere: divided by the largest norm, with one more coordinate that makes up for what
their norm lacks; queries are divided by their own norm, with a zero there.  The order of distances to a query
is then that of inner products.  A table hashes a vector to the cell of floor((a v + b) / w) for several normally
distributed a.  A query visits, in each table, its own and perturbed cells in the order of the probability that a
neighbour lies there, until that of a success reaches what the wanted recall needs.  The distance of neighbours
that this rests on is measured: a bounded sample of the queries is searched exactly.

Queries and vectors of a cell meet in blocks of bounded size.  A block passes on only the best of each query, by
inner products in double precision, and of these only what is no worse than the best of a bounded sample of the
vectors, which every query is compared with first.  The best over sample, tables and blocks are the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import tokens
from terrapanel.llm.staging import record_batch, small_batches, staged
from terrapanel.llm.whitening import _matrix, finite_vectors

TABLES = 3
#: Wanted probability that a neighbour is in a visited cell of some table.
SUCCESS = 0.95
#: Queries that are searched exactly to learn how far neighbours are.
SAMPLE_QUERIES = 64
#: Vectors of one cell that are meant to be there, and vectors, or queries, of a cell in one block.
CELL_ROWS = 4096
BLOCK_ROWS = 8192
#: Cells with several blocks, at most, on each side: the size of what is broadcast (blocks grow beyond that).
BLOCKED_CELLS = 1 << 18
#: Bytes of the sample of vectors that bounds what blocks pass on.
SAMPLE_BYTES = 4 << 20
#: Inner products held at once.
PRODUCTS = 1 << 21


@dataclass
class Index:
    """Largest norm, distance of neighbours on the sphere, width of cells, directions (table, coordinate, hash)
    and offsets (table, hash)."""

    largest: float
    reach: float
    width: float
    directions: np.ndarray
    offsets: np.ndarray


def _best(queries: np.ndarray, rows: np.ndarray, own: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the `most` best rows of each query, ties to the lesser id.  own: ids of the
    queries; a row of the same id and vector is the query's own and no candidate."""
    found = []
    step = max(1, PRODUCTS // max(1, len(rows)))
    for i in range(0, len(queries), step):
        q = queries[i : i + step]
        products = q @ rows.T
        if len(rows) > most:
            # One more than asked for, as the query's own row may be among them, and what rounding may bring in.
            least = np.partition(products, len(rows) - most - 1, axis=1)[:, len(rows) - most - 1]
            least = least - 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(rows, axis=1).max()
            at, row = np.nonzero(products >= least[:, None])
        else:
            at, row = (x.ravel() for x in np.indices(products.shape))
        score = (q[at] * rows[row]).sum(axis=1)
        same = np.flatnonzero(own[i + at] == ids[row])
        same = same[(q[at[same]] == rows[row[same]]).all(axis=1)]
        at, row, score = (np.delete(x, same) for x in (at, row, score))
        order = np.lexsort((ids[row], -score, at))
        at, row, score = at[order], row[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        found.append((i + at[rank < most], row[rank < most], score[rank < most]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


_NEAR = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_NEAR_DDL = "query_id long, query long, vec_id long, score double"


def _exact(ids: np.ndarray, names: np.ndarray, queries: np.ndarray, most: int):
    """The best of all rows of a task for a few queries."""

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column(1), float)
            if len(rows):
                own = batch.column(0).to_numpy()
                at, row, score = _best(queries, rows, ids, own, most)
                yield record_batch(_NEAR, query_id=ids[at], query=names[at], vec_id=own[row], score=score)

    return run


def _first(found: DataFrame, most: int) -> DataFrame:
    """The `most` best of each query, each vector once, with their rank."""
    once = found.distinct()
    return once.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id)")).filter(F.col("rank") <= most)


def _on_sphere(x: np.ndarray, largest: float | None) -> np.ndarray:
    """Vectors (or, without the largest norm, queries) with the coordinate that puts them on the unit sphere."""
    norm = np.linalg.norm(x, axis=1)
    share = norm / largest if largest else np.ones(len(x))
    return np.column_stack([x / (largest or norm[:, None]), np.sqrt(np.maximum(0, 1 - share * share))])


def _cells(steps: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of each row of hash values; cells that share one are searched together."""
    factors = np.random.default_rng(20240613).integers(1, 1 << 63, steps.shape[1], dtype=np.uint64) | np.uint64(1)
    total = (steps.astype(np.int64).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + np.uint64(table)
    return tokens.mix(total).view(np.int64)


def _places(x: np.ndarray, index: Index, table: int) -> np.ndarray:
    return (x @ index.directions[table] + index.offsets[table]) / index.width


_COUNTED = pa.schema([("tab", pa.int32()), ("cell", pa.int64())])
_INDEXED = pa.schema([*_COUNTED, ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])


def _hashed(index: Index, with_vectors: bool):
    """The cells of each vector, one for each table."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), float)
            if not len(x):
                continue
            placed = _on_sphere(x, index.largest)
            for table in range(len(index.directions)):
                own = {"tab": np.full(len(x), table, np.int32), "cell": _cells(np.floor(_places(placed, index, table)), table)}
                if with_vectors:
                    yield pa.RecordBatch.from_arrays([pa.array(own["tab"]), pa.array(own["cell"]), *batch.columns], names=_INDEXED.names)
                else:
                    yield record_batch(_COUNTED, **own)

    return run


def _normal_below(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to 1e-7 (formula 7.1.26 of Abramowitz and Stegun)."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x > 0, 1 - tail, tail)


def probes(place: np.ndarray, ratio: float, success: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, hash values, probability) of the cells to visit, in the order of the probability that a neighbour
    lies there, until that adds up to `success`.  place: (query, hash) positions in cell widths; ratio: the
    width of cells over the standard deviation of a neighbour's place."""
    n, hashes = place.shape
    around = np.arange(-math.ceil(5 / ratio) - 1, math.ceil(5 / ratio) + 2)
    base = np.floor(place)
    edges = (base[:, :, None] + around - place[:, :, None]) * ratio
    chance = np.maximum(0, _normal_below(edges + ratio) - _normal_below(edges))
    out, open_, least = [], np.arange(n), 1e-3
    while len(open_):
        query, p, steps = open_, np.ones(len(open_)), np.zeros((len(open_), 0))
        for h in range(hashes):
            more = p[:, None] * chance[query, h]
            at, k = np.nonzero(more >= least)
            p, steps, query = more[at, k], np.column_stack([steps[at], base[query[at], h] + around[k]]), query[at]
        reached = np.bincount(query, p, n)[open_] >= success
        order = np.lexsort((-p, query))
        query, p, steps = query[order], p[order], steps[order]
        done = np.isin(query, open_[reached])
        query, p, steps = query[done], p[done], steps[done]
        before = np.cumsum(p) - p
        first = np.searchsorted(query, query)
        visit = before - before[first] < success if len(query) else np.zeros(0, bool)
        out.append((query[visit], steps[visit], p[visit]))
        open_, least = open_[~reached], least / 16
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))


def _bounded(ids: np.ndarray, rows: np.ndarray, most: int):
    """Each query with the best of a sample, and the least score it may still need."""

    def run(batches):
        for batch in batches:
            asked, own = _matrix(batch.column(2), float), batch.column(0).to_numpy()
            at, row, score = _best(asked, rows, own, ids, most)
            n = np.bincount(at, minlength=len(own))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            least = np.full(len(own), -np.inf)
            least[n == most] = score[offsets[1:][n == most] - 1]
            found = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (ids[row], score))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), *found], names=[*batch.schema.names, "least", "ids", "scores"])

    return run


_PROBES = pa.schema([*_COUNTED, ("query_id", pa.int64()), ("query", pa.int64()), ("embedding", pa.list_(pa.float64())), ("least", pa.float64())])


def _probed(index: Index, success: float):
    """The cells that each query visits."""
    own = 1 - (1 - success) ** (1 / len(index.directions))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                placed = _on_sphere(_matrix(part.column(2), float), None)
                for table in range(len(index.directions)):
                    query, steps, _ = probes(_places(placed, index, table), index.width / index.reach, own)
                    rows = part.take(pa.array(query.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), table, np.int32)), pa.array(_cells(steps, table)), *rows.columns], names=_PROBES.names)

    return run


def _met(most: int):
    """The best of a block's vectors for each of its queries."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _NEAR.empty_table()
        rows, asked = (_matrix(t["embedding"].combine_chunks(), float) for t in (vectors, queries))
        ids, own = vectors["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        at, row, score = _best(asked, rows, own, ids, most)
        needed = score >= queries["least"].to_numpy()[at]
        at, row, score = at[needed], row[needed], score[needed]
        return pa.Table.from_batches([record_batch(_NEAR, query_id=own[at], query=queries["query"].to_numpy()[at], vec_id=ids[row], score=score)])

    return run


def _fit(vectors: DataFrame, queries: DataFrame, neighbours: int, tables: int) -> Index | None:
    """The index's parameters: None where there is nothing to search."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, largest = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = queries.orderBy(F.xxhash64("query_id", "query"), "query_id").limit(SAMPLE_QUERIES).toArrow()
    if n < 2 or not sample.num_rows:
        return None
    ids, names, x = sample["query_id"].to_numpy(), sample["query"].to_numpy(), _matrix(sample["embedding"].combine_chunks(), float)
    near = _first(vectors.mapInArrow(_exact(ids, names, x, neighbours), _NEAR_DDL), neighbours).toArrow()
    norms = dict(zip(zip(ids.tolist(), names.tolist(), strict=True), np.linalg.norm(x, axis=1), strict=True))
    own = np.array([norms[k] for k in zip(near["query_id"].to_pylist(), near["query"].to_pylist(), strict=True)])
    far = np.sqrt(np.maximum(0, 2 - 2 * near["score"].to_numpy() / (largest * own)))
    reach = max(1e-3, float(np.quantile(far, 0.9))) if len(far) else 1.0
    width = 2 * reach
    # A hash of normally distributed values fills about sqrt(2 pi e) / width cells.
    hashes = max(2, math.ceil(math.log(max(2, n / CELL_ROWS)) / math.log(max(1.5, 4.13 / width))))
    rng = np.random.default_rng(20240614)
    return Index(largest, reach, width, rng.standard_normal((tables, x.shape[1] + 1, hashes)), rng.uniform(0, width, (tables, hashes)))


def nearest_neighbours(embeddings: DataFrame, query_every: int = 20, neighbours: int = 20, tables: int = TABLES, success: float = SUCCESS) -> DataFrame:
    """Each query's nearest vectors by largest inner product.

    embeddings: vec_id long, embedding array of float or double; other columns are ignored, whatever their
    names.  Queries are the rows whose vec_id is divisible by query_every; candidates are all rows but the
    query's own.  Returns query_id, rank (from 1), vec_id, score (the inner product of the vectors in double
    precision), nearest first, ties to the lesser vec_id, all candidates where they are fewer.

    Vectors that are null, zero, empty, or hold null or non-finite entries take no part, nor do those of another
    length than the most frequent one, nor rows without vec_id, which could not be named.  Rows of equal vec_id
    and vector are one row, as a query and as a candidate; of rows with one id and different vectors each is
    a query of its own, and a candidate for the others.  An empty table gives an empty result.
    Every vector is in the index.  A neighbour is found with a probability of about `success`; the index is
    fitted on SAMPLE_QUERIES queries (of least hash), searched exactly, and on the count and the largest norm of
    all rows.  The sample of vectors (of least hash) is bounded by SAMPLE_BYTES; it is one more place where neighbours
    are found, and spares blocks from passing on what cannot be among the nearest.  A cell with many vectors or queries is dealt to blocks, each of which is searched whole.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    vectors = finite_vectors(embeddings).filter(F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    queries = vectors.filter(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("query"), "embedding").dropDuplicates(["query_id", "query"])
    queries = staged(queries, "ann-queries")
    index = _fit(vectors, queries, neighbours, tables)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = dict(vectors.dtypes)["embedding"]
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(max(1, SAMPLE_BYTES // (8 * index.directions.shape[1]))).toArrow()
    bounded = _bounded(sample["vec_id"].to_numpy(), _matrix(sample["embedding"].combine_chunks(), float), neighbours)
    queries = staged(queries.mapInArrow(bounded, f"query_id long, query long, embedding {kind}, least double, ids array<long>, scores array<double>"), "ann-bounds")
    sampled = queries.select("query_id", "query", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", "query", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    asked = staged(queries.select("query_id", "query", "embedding", "least").mapInArrow(_probed(index, success), f"tab int, cell long, query_id long, query long, embedding {kind}, least double"), "ann-probes")
    placed = vectors.mapInArrow(_hashed(index, False), "tab int, cell long")
    cell = ["tab", "cell"]

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = staged(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("c")), f"ann-{name}")
        block = max(BLOCK_ROWS, -(-int(sizes.agg(F.sum("c")).first()[0] or 0) // BLOCKED_CELLS))
        return sizes.filter(F.col("c") > block).select(*cell, F.ceil(F.col("c") / block).alias(name))

    many = staged(blocks(placed, "row_blocks").join(blocks(asked, "query_blocks"), cell, "full"), "ann-blocks")

    def dealt(rows: DataFrame, own: str, others: str, by: str) -> DataFrame:
        """rows in their own block, once for each block of the other side."""
        known = rows.join(F.broadcast(many), cell, "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(1).cast("long"))
        return known.withColumn(own, F.pmod(F.xxhash64(by), n(own))).withColumn(others, F.explode(F.sequence(F.lit(0).cast("long"), n(others) - 1)))

    keys = [*cell, "row_blocks", "query_blocks"]
    left = dealt(vectors.mapInArrow(_hashed(index, True), f"tab int, cell long, vec_id long, embedding {kind}"), "row_blocks", "query_blocks", "vec_id").select(*keys, "vec_id", "embedding")
    right = dealt(asked, "query_blocks", "row_blocks", "query_id").select(*keys, "query_id", "query", "embedding", "least")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_met(neighbours), _NEAR_DDL)
    return _first(found.unionByName(sampled), neighbours).select("query_id", "rank", "vec_id", "score")
