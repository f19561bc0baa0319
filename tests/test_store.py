"""Tables in parts: merges rewrite what they touch, and no stop loses anything."""

import os

import pytest

from terrapanel.operators.quality import QualityError
from terrapanel.sources import store as S
from terrapanel.sources import upsert as U
from terrapanel.streaming.landing import merge_arrivals

KIND = "k int, a int, b string"
OLD = [(k, 10 * k, f"old{k}") for k in range(200)]


def rows(spark, data):
    return spark.createDataFrame(data, KIND)


def table(spark, tmp_path, data=OLD, buckets=16):
    return S.create_keyed(spark, str(tmp_path / "t"), rows(spark, data), ["k"], buckets)


def content(df):
    return sorted(map(tuple, df.collect()))


def files(store):
    """Part -> names and times of its files."""
    out = {}
    for part, folder in store.version()["parts"].items():
        at = os.path.join(store.path, folder)
        out[part] = sorted((n, os.stat(os.path.join(at, n)).st_mtime_ns) for n in os.listdir(at) if n.endswith(".parquet"))
    return out


MERGES = {
    "all": (S.merge_all, U.upsert, ()),
    "preserving": (S.merge_preserving, U.upsert_preserving, (["b"],)),
    "missing": (S.merge_missing, U.insert_missing, ()),
    "existing": (S.merge_existing, U.update_existing, (["a"],)),
}


@pytest.mark.parametrize("name", sorted(MERGES))
def test_merges_equal_whole_tables_and_leave_other_buckets(spark, tmp_path, name):
    merge, plain, extra = MERGES[name]
    store = table(spark, tmp_path)
    source = rows(spark, [(3, -1, "new"), (77, -2, None), (1000, -3, "added")])
    want = content(plain(rows(spark, OLD), source, ["k"], *extra).select("k", "a", "b"))
    before = files(store)
    touched = merge(store, source, *extra)
    after = files(store)
    assert content(store.read()) == want and 1 <= len(touched) <= 3
    assert {p for p in before if before[p] != after.get(p)} <= set(touched)
    assert all(before[p] == after[p] for p in set(before) - set(touched))
    # Once more changes nothing.
    merge(store, source, *extra)
    assert content(store.read()) == want


def test_keys_must_be_unique_and_not_null(spark, tmp_path):
    store = table(spark, tmp_path)
    for bad in ([(1, 1, "x"), (1, 2, "y")], [(None, 1, "x")]):
        with pytest.raises(QualityError):
            S.merge_all(store, rows(spark, bad))
    with pytest.raises(QualityError):
        table(spark, tmp_path)
    with pytest.raises(QualityError):
        S.create_keyed(spark, str(tmp_path / "u"), rows(spark, [(1, 1, "x"), (1, 2, "y")]), ["k"], 4)
    assert content(store.read()) == sorted(OLD)


def test_empty_tables_and_sources(spark, tmp_path):
    store = table(spark, tmp_path, [])
    assert content(store.read()) == [] and S.merge_all(store, rows(spark, [])) == []
    S.merge_existing(store, rows(spark, [(1, 1, "x")]), ["a"])
    assert content(store.read()) == []
    S.merge_all(store, rows(spark, [(1, 1, "x")]))
    assert content(store.read()) == [(1, 1, "x")]
    with pytest.raises(QualityError):
        S.PartStore(spark, str(tmp_path / "none")).read()


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["before the write", "after the write", "before the rename", "after the rename"])
def test_a_stop_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, step):
    store = table(spark, tmp_path)
    source = rows(spark, [(3, -1, "new"), (1000, -3, "added")])
    want = content(U.upsert(rows(spark, OLD), source, ["k"]))
    point = S.PartStore._point

    def stop(*_, **__):
        raise Stop

    def after(self, version):
        point(self, version)
        raise Stop

    base, touched = store.version(), S._touched(source, ["k"], 16)
    if step == "before the write":
        monkeypatch.setattr(S.PartStore, "commit", stop)
    elif step == "before the rename":
        monkeypatch.setattr(S.PartStore, "_point", stop)
    elif step == "after the rename":
        monkeypatch.setattr(S.PartStore, "_point", after)
    with pytest.raises(Stop):
        if step == "after the write":
            store.commit(U.upsert(store.read(touched), source, ["k"]), S.bucket_of(["k"], 16), touched, base, check=stop)
        else:
            S.merge_all(store, source)
    monkeypatch.undo()
    assert content(store.read()) == (want if step == "after the rename" else sorted(OLD))
    S.merge_all(store, source)
    assert content(store.read()) == want
    store.vacuum()
    assert content(store.read()) == want and len(os.listdir(os.path.join(store.path, "_versions"))) <= 2


def test_of_two_writers_one_wins_and_the_other_hears_of_it(spark, tmp_path):
    store = table(spark, tmp_path)
    base = store.version()
    S.merge_all(store, rows(spark, [(3, -1, "first")]))
    touched = S._touched(rows(spark, [(4, 0, "x")]), ["k"], 16)
    with pytest.raises(S.ConflictError):
        store.commit(store.read(touched), S.bucket_of(["k"], 16), touched, base)
    assert (3, -1, "first") in content(store.read())


def test_vacuum_removes_what_no_version_names(spark, tmp_path):
    store = table(spark, tmp_path)
    for n in range(3):
        S.merge_all(store, rows(spark, [(5, n, "x")]))
    want = content(store.read())
    assert store.vacuum() > 0 and store.vacuum() == 0 and content(store.read()) == want
    assert set(store.version()["parts"].values()) == {f"data/{w}/{p}" for w in os.listdir(f"{store.path}/data") for p in os.listdir(f"{store.path}/data/{w}") if p.startswith("_part=")}


@pytest.mark.parametrize("step", ["before", "after"])
def test_a_stopped_arrival_is_merged_by_the_next_run(spark, tmp_path, monkeypatch, step):
    """A batch stopped around its commit is run again by the stream, and the table holds all rows once."""
    source, target = str(tmp_path / "in"), str(tmp_path / "t")
    run = lambda: merge_arrivals(spark, source, target, str(tmp_path / "c"), ["k"], "a", buckets=4).awaitTermination()
    rows(spark, [(1, 1, "x"), (2, 1, "x"), (2, 2, "y"), (None, 9, "z")]).write.parquet(source)
    run()
    rows(spark, [(2, 3, "w"), (3, 1, "x")]).write.mode("append").parquet(source)
    point = S.PartStore._point

    def stopped(self, version):
        if step == "after":
            point(self, version)
        raise RuntimeError("stopped here")

    monkeypatch.setattr(S.PartStore, "_point", stopped)
    with pytest.raises(Exception, match="stopped here"):
        run()
    monkeypatch.undo()
    run()
    run()
    assert content(S.PartStore(spark, target).read()) == [(1, 1, "x"), (2, 3, "w"), (3, 1, "x")]


def test_a_gated_load_writes_reports_and_refuses(spark, tmp_path):
    from pyspark.sql import functions as F

    from terrapanel.operators.quality import resolution_report

    master = spark.createDataFrame([(k,) for k in range(5)] + [(3,)], "k int")
    source = rows(spark, [(1, 1, "x"), (2, 1, "x"), (7, 1, "y"), (7, 2, "y"), (None, 3, "z"), (8, 1, "y")])
    store = S.PartStore(spark, str(tmp_path / "g"))
    report = S.load_resolved(store, source, master, "k", F.col("a"), ["k"])
    assert tuple(report.values()) == tuple(resolution_report(source, master, "k").first()) == (6, 2, 4, 3)
    assert content(store.read()) == [(1, 1, "x"), (2, 1, "x")] and store.rejected().count() == 4 and store.read().columns == ["k", "a", "b"]
    before = store.version()
    with pytest.raises(QualityError, match="4 of 6"):
        S.load_resolved(store, source, master, "k", F.col("a"), most_dropped=0.5)
    with pytest.raises(QualityError, match="keys"):
        S.load_resolved(store, rows(spark, [(1, 1, "x"), (1, 2, "y")]), master, "k", F.col("a"), ["k"])
    assert store.version() == before and content(store.read()) == [(1, 1, "x"), (2, 1, "x")]
    # Only the touched part is replaced; what was put aside follows the last write.
    S.load_resolved(store, rows(spark, [(4, 2, "new")]), master, "k", F.col("a"), ["k"], touched=["2"])
    assert content(store.read()) == [(1, 1, "x"), (2, 1, "x"), (4, 2, "new")] and store.rejected().count() == 0
    store.vacuum()
    assert content(store.read()) == [(1, 1, "x"), (2, 1, "x"), (4, 2, "new")]
