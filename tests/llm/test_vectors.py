"""Whitening and nearest neighbours against numpy, and on nulls, ties, repeated rows and crowded cells."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import multiprobe, queries, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>"


def table(spark, rows, kind=KIND):
    return spark.createDataFrame(rows, kind)


def read(folder):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    return t["vec_id"].to_numpy(), np.stack(t["embedding"].to_pylist()).astype(float)


def plain_whitening(x):
    """(n, sums, variances, components) of distinct integer vectors, by the covariance's eigenvectors."""
    u = np.unique(x, axis=0)
    centred = u - u.sum(0) / len(u)
    e, v = np.linalg.eigh(centred.T @ centred / len(u))
    return len(u), u.sum(0), e[::-1], v[:, ::-1]


def test_whitening_equals_eigenvectors(spark):
    ids, vectors = read(SF)
    x = np.floor(256 * vectors).astype(np.int64)
    n, sums, e, v = plain_whitening(x)
    rows = queries.op11_embedding_whitening(spark, SF).toPandas()
    assert len(rows) == 4 * len(ids) and set(rows["n"]) == {n} and rows["identity_error"].max() < 1e-12
    by = rows.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    for k in range(4):
        want = (x - sums / n) @ v[:, k] / np.sqrt(e[k])
        assert min(np.abs(by[:, k] - want).max(), np.abs(by[:, k] + want).max()) < 1e-9
        assert np.allclose(rows.loc[rows["component"] == k + 1, "explained"], e[k] / e.sum(), rtol=1e-12)
    exact = ((n * x - sums) ** 2).sum(1)
    assert rows.drop_duplicates("vec_id").set_index("vec_id").loc[ids, "deviation"].tolist() == exact.tolist()


def test_whitening_of_odd_rows(spark):
    rows = [(1, [0.5, 1.0, -0.001]), (1, [0.5, 1.0, -0.001]), (2, [0.25, -1.0, 0.0]), (3, None), (4, [None, 1.0, 2.0]), (5, [float("nan"), 1.0, 2.0]), (6, [float("inf"), 1.0, 2.0]), (7, [1.0]), (8, []), (None, [3.0, 2.0, 1.0])]
    df = table(spark, rows).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("component", F.lit(2))
    got = whitening.whiten(df).toPandas()
    # Three different vectors span two directions.
    assert sorted(got["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 1, 1, 2, 2] and set(got["component"]) == {1, 2}
    x = np.array([[128, 256, -1], [64, -256, 0], [768, 512, 256]])
    n, sums, e, v = plain_whitening(x)
    assert set(got["n"]) == {3} and np.isclose(got["explained"].drop_duplicates().sum(), 1)
    first = got[(got["component"] == 1) & (got["vec_id"] == 2)]["whitened"].item()
    assert np.isclose(abs(first), abs((x[1] - sums / 3) @ v[:, 0] / np.sqrt(e[0])))
    assert int(got[got["vec_id"] == 2]["deviation"].iloc[0]) == int(((3 * x[1] - sums) ** 2).sum())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_whitening_without_variance_is_empty(spark, rows):
    got = whitening.whiten(table(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_whitening_of_ill_conditioned_and_large_values(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [1e6, 1e3, 10, 1, 0.1, 0.05] + 5e6
    base[:, 5] = base[:, 4]
    x = np.floor(256 * base).astype(np.int64)
    n, sums, e, v = plain_whitening(x.astype(object).astype(float))
    got = whitening.whiten(table(spark, [(k, r.tolist()) for k, r in enumerate(base)]), 5).toPandas()
    assert got["identity_error"].max() < 1e-4 and set(got["component"]) == {1, 2, 3, 4, 5}
    assert np.allclose(got.drop_duplicates("component").sort_values("component")["explained"], e[:5] / e.sum(), rtol=1e-4)
    total = [sum(int(r[j]) for r in x) for j in range(6)]
    want = sum((300 * int(x[7][j]) - total[j]) ** 2 for j in range(6))
    assert int(got[got["vec_id"] == 7]["deviation"].iloc[0]) == want


def plain_neighbours(ids, x, every=20, k=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if not (ids[i] == ids[q] and (x[i] == x[q]).all())]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order[:k]]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in want[q]} & set(got[got["query_id"] == q]["vec_id"])) for q in want)
    return hit / sum(len(v) for v in want.values())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_recall_and_order_of_neighbours(spark, folder):
    ids, x = read(folder)
    got = queries.op12_multiprobe_neighbours(spark, folder).toPandas()
    want = plain_neighbours(ids, x)
    assert recall(got, want) >= 0.95
    at = {int(v): k for k, v in enumerate(ids)}
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and q not in set(own["vec_id"])
        assert np.allclose(own["score"], [x[at[q]] @ x[at[v]] for v in own["vec_id"]], rtol=1e-12)
        assert (np.diff(own["score"]) <= 0).all()


def test_neighbours_of_unequal_norms_and_a_crowded_cell(spark, monkeypatch):
    """A third of the rows in one small ball, norms from 0.1 to 10, and blocks so small that cells are dealt."""
    monkeypatch.setattr(multiprobe, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.1, 3, (900, 1))
    x[:300] = x[0] + rng.normal(size=(300, 8)) * 1e-4
    ids = np.arange(900)
    got = multiprobe.nearest_neighbours(table(spark, [(int(k), r.tolist()) for k, r in zip(ids, x, strict=True)])).toPandas()
    assert recall(got, plain_neighbours(ids, x)) >= 0.9 and (got.groupby("query_id").size() == 20).all()


def test_ties_go_to_the_lesser_id_and_own_row_is_none(spark):
    rows = [(k, [1.0, 0.0, 2.0]) for k in range(60)] + [(40, [1.0, 0.0, 2.0]), (20, [0.0, 1.0, 0.0]), (100, [5.0, 0.0, 0.0])]
    got = multiprobe.nearest_neighbours(table(spark, rows), neighbours=5, success=0.999).toPandas()
    of = lambda q: [tuple(r) for r in got[got["query_id"] == q].sort_values(["score", "rank"], ascending=[False, True])[["vec_id", "score"]].to_numpy().tolist()]
    assert of(0) == [(1, 5.0), (2, 5.0), (3, 5.0), (4, 5.0), (5, 5.0)]
    assert [v for v, _ in of(40)] == [0, 1, 2, 3, 4]
    # Two rows of id 20: each is a query, and a candidate for the other.
    assert len(of(20)) == 10 and {v for v, s in of(20) if s == 5.0} == {0, 1, 2, 3, 4}
    assert of(100)[0] == (0, 5.0)


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [None, 1.0]), (80, [float("nan"), 1.0]), (None, [9.0, 9.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [])]
    df = table(spark, rows).withColumn("cell", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("query", F.lit(1))
    got = multiprobe.nearest_neighbours(df, success=0.999)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and [tuple(r) for r in got.collect()] == [(0, 1, 1, 4.0)]
    for none in ([], [(0, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(0, None)]):
        assert multiprobe.nearest_neighbours(table(spark, none)).count() == 0


def test_probes_come_in_order_and_reach_the_wanted_probability():
    rng = np.random.default_rng(7)
    place = rng.uniform(-3, 3, (40, 3))
    query, steps, p = multiprobe.probes(place, 1.5, 0.8)
    for q in range(40):
        own, cells = p[query == q], steps[query == q]
        assert (np.diff(own) <= 0).all() and own.sum() >= 0.8 and own[:-1].sum() < 0.8
        assert len({tuple(c) for c in cells}) == len(cells)
        # The most probable cell is the query's own, and a simulated neighbour falls there as often as said.
        assert (cells[0] == np.floor(place[q])).all()
    falls = np.floor(place[0] + rng.normal(size=(40_000, 3)) / 1.5)
    assert abs((falls == steps[query == 0][0]).all(1).mean() - p[query == 0][0]) < 0.01
