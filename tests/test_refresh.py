"""Partial rebuilds of the stored feature tables against whole ones."""

import dataclasses
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from terrapanel.operators.spatial import migration_axis, proximity
from terrapanel.plans.refresh import FACTS, REACHES, FeatureTables, Inputs

DAY0 = dt.date(2020, 12, 1)
FACT_KINDS = {
    "outbreak": "place string, day date, flock_type string, confirmed boolean, birds long", "wild": "place string, day date, detection_count long, n_species long",
    "band": "place string, day date, band_count long", "weather": "place string, day date, temp_min_c double, temp_max_c double, precip_mm double",
    "sentiment": "place string, day date, post_count long, sentiment_mean double, sentiment_neg_share double",
}
VALUES = {"outbreak": ("U", True, 5), "wild": (2, 1), "band": (3,), "weather": (1.0, 2.0, 0.5), "sentiment": (1, 0.25, 0.0)}


def day(n):
    return DAY0 + dt.timedelta(days=n)


def inputs(spark, facts, last):
    """Six places in a row, each the neighbour of the next, some 100 km apart."""
    names = list("abcdef")
    places = spark.createDataFrame([(p, "PA", f"P{p}", 40.0, -80.0 + k, 1000 * k, 10.0, p != "f") for k, p in enumerate(names)], "place string, state string, name string, lat double, lon double, population int, land_area_sqmi double, is_conus boolean")
    near = [(a, b) for k, a in enumerate(names) for j, b in enumerate(names) if abs(k - j) == 1]
    exposure = ["poultry_operations", "layer_operations", "broiler_operations", "turkey_operations", "duck_operations"]
    measures = ["layer_inventory", "broiler_sales_head", "turkey_inventory", "duck_inventory", "poultry_sales_usd"]
    census = spark.createDataFrame([("a", 2022, *[1] * 5, *[2.0] * 5)], ", ".join(["place string", "census_year int", *(f"{c} long" for c in exposure), *(f"{c} double" for c in measures)]))
    tables = {f: spark.createDataFrame([(p, day(n), *VALUES[f]) for p, n in facts[f]], FACT_KINDS[f]) for f in FACTS}
    days = spark.createDataFrame([(day(n),) for n in range(last + 1)], "day date")
    conus = places.filter("is_conus")
    return Inputs(places, days, spark.createDataFrame(near, "place string, neighbour string"), proximity(conus, 400.0), migration_axis(conus), census, **tables)


def random_facts(seed, last):
    rng = random.Random(seed)
    out = {f: sorted({(rng.choice("abcdef"), rng.randrange(last + 1)) for _ in range(12)}) for f in FACTS}
    out["weather"] += [("a", last)]
    out["weather"] = sorted(set(out["weather"]))
    return out


def content(df):
    return sorted(map(str, df.select([F.round(c, 9).alias(c) if k == "double" else c for c, k in sorted(df.dtypes)]).collect()))


def files(store):
    out = {}
    for part, folder in store.version()["parts"].items():
        at = os.path.join(store.path, folder)
        out[part] = sorted((folder, n, os.stat(os.path.join(at, n)).st_mtime_ns) for n in os.listdir(at) if n.endswith(".parquet"))
    return out


CASES = {
    # name: (facts that come, facts that go, new last day), with 800 days to begin with
    "a late outbreak reaches a year on and the neighbours": ({"outbreak": [("b", 20)]}, {}, 800),
    "late weather stays in its year": ({"weather": [("c", 300)]}, {}, 800),
    "everything at the turn of a year, facts that go, and new days": ({**{f: [("d", 30), ("e", 396)] for f in FACTS}, "weather": [("a", 830)], "band": [("f", 812)]}, {"wild": 1, "band": 2}, 830),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_refresh_equals_rebuild(spark, tmp_path, name):
    come, go, last = CASES[name]
    old = random_facts(len(name), 800)
    new = {f: sorted({*old[f][go.get(f, 0) :], *come.get(f, [])}) for f in FACTS}
    late = {f: spark.createDataFrame([(p, day(n)) for p, n in sorted(set(old[f]) ^ set(new[f]))], "place string, day date") for f in FACTS if set(old[f]) ^ set(new[f])}
    tables, whole = (FeatureTables(spark, str(tmp_path / n)) for n in ("part", "whole"))
    tables.rebuild(inputs(spark, old, 800))
    before = {t: files(tables.stores[t]) for t in REACHES}
    now = inputs(spark, new, last)
    done = tables.refresh(now, late)
    whole.rebuild(now)
    for t in REACHES:
        assert content(tables.read(t)) == content(whole.read(t)), t
        after = files(tables.stores[t])
        assert {p for p in before[t] if before[t][p] != after.get(p)} <= set(map(str, done[t])), t
    if name.startswith("late weather"):
        assert done == {"weather_lag": [2021], "spatial_lag": [], "pressure": [], "county_day": [2021]}
    if name.startswith("a late outbreak"):
        assert done["spatial_lag"] == [2020, 2021] and done["weather_lag"] == []


def test_a_stopped_refresh_is_completed_by_the_next(spark, tmp_path, monkeypatch):
    old = random_facts(5, 500)
    new = dict(old, outbreak=sorted({*old["outbreak"], ("c", 90)}))
    late = {"outbreak": spark.createDataFrame([("c", day(90))], "place string, day date")}
    tables, whole = (FeatureTables(spark, str(tmp_path / n)) for n in ("part", "whole"))
    tables.rebuild(inputs(spark, old, 500))
    now = inputs(spark, new, 500)
    built = FeatureTables._built

    def stopped(name, *rest):
        if name == "county_day":
            raise RuntimeError("stopped here")
        return built(name, *rest)

    monkeypatch.setattr(FeatureTables, "_built", staticmethod(stopped))
    with pytest.raises(RuntimeError, match="stopped here"):
        tables.refresh(now, late)
    monkeypatch.undo()
    tables.refresh(now, late)
    whole.rebuild(now)
    assert all(content(tables.read(t)) == content(whole.read(t)) for t in REACHES)


def test_nothing_late_rewrites_nothing(spark, tmp_path):
    now = inputs(spark, random_facts(6, 400), 400)
    tables = FeatureTables(spark, str(tmp_path / "t"))
    tables.rebuild(now)
    before = {t: files(tables.stores[t]) for t in REACHES}
    none = spark.createDataFrame([], "place string, day date")
    assert tables.refresh(now, {}) == tables.refresh(now, dict.fromkeys(FACTS, none)) == {t: [] for t in REACHES}
    assert before == {t: files(tables.stores[t]) for t in REACHES} and dataclasses.is_dataclass(now)


def test_the_model_table_is_rebuilt_in_one_pass_over_the_grid(spark, tmp_path):
    """The stored model table and its refreshed years come of one join of the grid, not of one for each feature table."""
    now = inputs(spark, random_facts(7, 400), 400)
    tables = FeatureTables(spark, str(tmp_path / "t"))
    tables.rebuild(now)
    plan = FeatureTables._built("county_day", now, now.days, tables.read)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter, ((place") == 1
    wide = [line for line in plan.splitlines() if "own_outbreaks_60d" in line and "Join LeftOuter" in line]
    assert not wide


def test_the_model_table_is_stored_and_refreshed_alone(spark, tmp_path):
    """Without the other tables and without pairs of places it comes out as whole, sorted in its files; untouched years stay."""
    old = random_facts(5, 800)
    new = {f: sorted({*old[f], ("b", 20), ("c", 31)}) for f in FACTS}
    late = {f: spark.createDataFrame([(p, day(n)) for p, n in sorted(set(old[f]) ^ set(new[f]))], "place string, day date") for f in FACTS}
    alone, whole = FeatureTables(spark, str(tmp_path / "alone"), ["county_day"]), FeatureTables(spark, str(tmp_path / "whole"))
    before = dataclasses.replace(inputs(spark, old, 800), pairs=None)
    alone.rebuild(before)
    years = files(alone.stores["county_day"])
    done = alone.refresh(dataclasses.replace(inputs(spark, new, 800), pairs=None), late)
    whole.rebuild(inputs(spark, new, 800))
    assert content(alone.read("county_day")) == content(whole.read("county_day"))
    assert os.listdir(tmp_path / "alone") == ["county_day"] and done["county_day"] and not done["pressure"]
    after = files(alone.stores["county_day"])
    assert all(after[y] == years[y] for y in years if int(y) not in done["county_day"])
    for folder in alone.stores["county_day"].version()["parts"].values():
        for name in os.listdir(tmp_path / "alone" / "county_day" / folder):
            if name.endswith(".parquet"):
                keys = [tuple(r) for r in spark.read.parquet(str(tmp_path / "alone" / "county_day" / folder / name)).select("place", "day").collect()]
                assert keys == sorted(keys)
