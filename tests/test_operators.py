import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrapanel.operators import ingest, quality, ranking, spatial, windows
from terrapanel.operators.crosswalk import resolve_names
from terrapanel.plans import features, model, text
from terrapanel.sources import readers, snapshots, upsert

D = datetime.date


def days(spark, first, last):
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS day")


def test_trailing_counts_of_neighbours(spark):
    edges = spark.createDataFrame([("A", "N")], "place string, neighbour string")
    hits = spark.createDataFrame([("N", D(2024, 1, 1), True, 1), ("N", D(2024, 1, 3), True, 1)], "place string, day date, confirmed boolean, birds int")
    none = spark.createDataFrame([], "place string, day date, detection_count long, band_count long")
    lag = features.spatial_lag(edges, features.daily_counts(hits, none.drop("band_count"), none.drop("detection_count")), days(spark, "2024-01-01", "2025-06-30"))
    rows = {r["day"].isoformat(): r for r in lag.filter("place = 'A'").collect()}
    assert "2024-01-01" not in rows
    see = lambda d: tuple(rows[d][f"nbr_{k}"] for k in ("infected_counties_7d", "infections_7d", "infections_21d", "infections_60d"))
    assert see("2024-01-02")[:2] == (1, 1)
    assert see("2024-01-08")[:2] == (1, 2)
    assert see("2024-01-09")[:2] == (1, 1)
    assert see("2024-01-11")[:3] == (0, 0, 2)
    assert see("2024-03-03")[3] == 1 and see("2024-03-04")[3] == 0
    own = {r["day"].isoformat(): r["days_since_outbreak_county"] for r in lag.filter("place = 'N'").collect()}
    assert own["2024-01-02"] == 1 and own["2025-01-02"] == 365 and "2025-01-03" not in own


def test_windows_only_look_back(spark):
    events = spark.createDataFrame([("a", D(2024, 1, 5), 2), ("a", D(2024, 2, 1), 5)], "place string, day date, n int")
    span = days(spark, "2024-01-01", "2024-03-31")
    before = windows.trailing_sums(events.filter("day < '2024-02-01'"), ["place"], {"n": "n"}, calendar=span).filter("day <= '2024-02-01'")
    assert sorted(map(tuple, windows.trailing_sums(events, ["place"], {"n": "n"}, calendar=span).filter("day <= '2024-02-01'").collect())) == sorted(map(tuple, before.collect()))


def test_rolling_counts_gaps(spark):
    rows = [("a", D(2024, 1, d), None if d == 4 else 1.0) for d in (1, 2, 3, 4, 6, 7)]
    out = windows.rolling(spark.createDataFrame(rows, "place string, day date, precip double"), ["place"], 7, {"s": ("sum", "precip"), "n": ("count", "precip")})
    got = {r["day"].day: (r["s"], r["n"]) for r in out.collect()}
    assert got[7] == (5.0, 5) and 5 not in got


def test_forward_targets(spark):
    outbreak = spark.createDataFrame([("a", D(2024, 1, 15), True)], "place string, day date, confirmed boolean")
    got = {r["day"].day: (r[2], r[3]) for r in features.forward_targets(outbreak, days(spark, "2024-01-01", "2024-01-20")).collect()}
    assert set(got) == set(range(1, 15)) and all(v[1] for v in got.values())
    assert {d for d, v in got.items() if v[0]} == set(range(8, 15))


POINTS = [("P1", 40.0, -76.0), ("P2", 41.0, -76.0), ("P3", 40.0, -75.0), ("P4", 44.5, -76.0)]


def test_pairs_axis_and_pressure(spark):
    places = spark.createDataFrame([(p, "PA", a, o) for p, a, o in POINTS], "place string, state string, lat double, lon double")
    pairs = spatial.proximity(places, 400)
    got = {(r[0], r[1]): (r[2], r[3]) for r in pairs.collect()}
    assert len(got) == 8 and ("P4", "P1") not in got and ("P4", "P3") not in got
    assert got["P1", "P2"] == pytest.approx((111.194927, 0), abs=1e-5) and got["P3", "P1"] == pytest.approx((85.179809, 270.321399), abs=1e-5)
    assert got["P2", "P3"][0] == pytest.approx(139.688635, abs=1e-5) and got["P2", "P4"][0] == pytest.approx(389.182243, abs=1e-5)
    axis = spatial.migration_axis(places)
    assert axis.filter("place = 'P1'").first()[1:] == ("Atlantic", pytest.approx(13.285816, abs=1e-5), pytest.approx(200.506458, abs=1e-5))
    found = spark.createDataFrame([("P2", D(2024, 1, 10), 2)], "place string, day date, detection_count int")
    p1 = features.migration_pressure(pairs, axis, found).filter("place = 'P1'").orderBy("day").collect()
    assert [r["day"] for r in p1] == [D(2024, 1, 11) + datetime.timedelta(k) for k in range(21)]
    assert p1[0]["breeding_side_pressure"] == pytest.approx(2 * 0.4764943034) and p1[0]["wintering_side_pressure"] is None


def test_pairs_across_the_date_line_and_near_the_pole(spark):
    points = spark.createDataFrame([("a", 10.0, 179.9), ("b", 10.0, -179.9), ("c", 89.9, 0.0), ("d", 89.9, 180.0), ("e", None, 1.0)], "id string, lat double, lon double")
    assert {(r[0], r[1]) for r in spatial.pairs_within(points, points, 50).collect()} == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}


def _plain_km(a, b):
    (la, lo), (lb, lp) = (np.radians(np.asarray(x)).T for x in (a, b))
    h = np.sin((lb[None] - la[:, None]) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb)[None] * np.sin((lp[None] - lo[:, None]) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))


def test_nearest_and_pairs_in_clusters(spark, monkeypatch):
    """A tight cluster, its copies at one coordinate, and far points: cells are quartered and joined in blocks."""
    rng = np.random.default_rng(11)
    at = [*zip(40 + rng.random(900) * 0.004, -90 + rng.random(900) * 0.004, strict=True), *[(40.002, -89.998)] * 300, *zip(rng.uniform(25, 49, 60), rng.uniform(-120, -70, 60), strict=True)]
    frame = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "id long, lat double, lon double")
    monkeypatch.setattr(spatial, "BLOCK", 64)
    assert len(spatial._levels(frame, frame, 500.0, 49.0, 64 * 6)) > 3
    km = _plain_km(at, at)
    got = {}
    for r in spatial.nearest(frame, frame.withColumnRenamed("id", "place"), 5).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["place"], r["distance_km"])
    assert len(got) == len(at)
    for k in range(len(at)):
        want = np.sort(km[k])[:5]
        found = [got[k][x] for x in range(5)]
        assert np.allclose([d for _, d in found], want, atol=1e-6)
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and len({p for p, _ in found}) == 5
    same = sorted(got[900][x][0] for x in range(5))
    assert same == [900, 901, 902, 903, 904]
    pairs = spatial.pairs_within(frame, frame, 0.05).select("id", "other").collect()
    near = np.argwhere((km > 0) & (km <= 0.05))
    edge = int(((km > 0.05 - 1e-9) & (km < 0.05 + 1e-9)).sum())
    assert len(set(pairs)) == len(pairs) and abs(len(pairs) - len(near)) <= edge and len(near) > 5000


def test_nearest_equals_brute_force(spark):
    points = spark.sql("SELECT id, 25 + (id * 7919 % 2400) / 100D AS lat, -124 + (id * 104729 % 5700) / 100D AS lon FROM range(60)")
    places = spark.sql("SELECT id AS place, 25 + (id * 6131 % 2400) / 100D AS lat, -124 + (id * 86311 % 5700) / 100D AS lon FROM range(80)")
    from pyspark.sql import Window

    from terrapanel.functions.geo import distance_km

    both = points.crossJoin(places.toDF("place", "b", "o")).withColumn("d", distance_km(F.col("lat"), F.col("lon"), F.col("b"), F.col("o")))
    want = both.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "place")) - 1).filter("rank < 3").select("id", "place", "rank")
    for radius in (None, 20.0):
        got = spatial.nearest(points, places, 3, radius).select("id", "place", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = spatial.nearest(points.limit(2), places.limit(2), 3)
    assert few.count() == 4


def test_crosswalk(spark):
    master = spark.createDataFrame([("51059", "VA", "Fairfax County"), ("51600", "VA", "Fairfax city"), ("32510", "NV", "Carson City"), ("29189", "MO", "St. Louis County"), ("42061", "PA", "Huntingdon County")], "place string, state string, name string")
    rows = [("Virginia", "Fairfax"), ("Nevada", "Carson City"), ("Missouri", "Saint Louis"), ("Pennsylvania", "Huntington"), ("Guam", "X"), ("Missouri", "Unknown"), (None, None)]
    out = resolve_names(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, n string"), master, "s", "n")
    assert [r["place"] for r in out.orderBy("i").collect()] == ["51059", "32510", "29189", "42061", None, None, None]


def test_adjacency_file(spark, tmp_path):
    lines = ["Bedford\t51515\tBedford\t51515", "\t\tBedford County\t51019", "\t\tX\t51031", "Valdez\t02261\tY\t02122", "PR\t72001\tZ\t72003"]
    (tmp_path / "adjacency.txt").write_bytes("\n".join(lines).encode("latin-1"))
    out = ingest.adjacency(readers.read_adjacency(spark, str(tmp_path / "adjacency.txt")))
    assert [tuple(r) for r in out.collect()] == [("51019", "51031")]


def test_outbreaks_and_detections(spark):
    master = spark.createDataFrame([("19001", "IA", "Adair County")], "place string, state string, name string")
    rows = [("Iowa", "Adair", "2024-01-01", "Layer", "10"), ("Iowa", "Adair", "2024-01-01", "Layer", None), ("Iowa", "Adair", "2024-01-02", None, None), ("Iowa", "Nowhere", "2024-01-02", None, "5")]
    raw = spark.createDataFrame(rows, "State string, `County Name` string, `Confirmed Diagnosis` string, Production string, Affected string")
    clean, rejects = ingest.outbreaks(raw, master)
    got = {(r["day"], r["flock_type"]): r["birds"] for r in clean.collect()}
    assert [tuple(r) for r in rejects.collect()] == [("Iowa", "Nowhere", 1)] and clean.filter("confirmed").count() == 2
    assert got == {(D(2024, 1, 1), "Layer"): 10, (D(2024, 1, 2), "unknown"): None}
    birds = [("Iowa", "Adair", "2024-03-01", None, s) for s in ("a", "a", None)] + [("Iowa", "Adair", "", "2024-03-02", "b")]
    wild, rejects = ingest.wild_detections(spark.createDataFrame(birds, "State string, County string, `Collection Date` string, `Date Detected` string, `Bird Species` string"), master)
    assert rejects.count() == 0
    assert sorted(tuple(r)[1:] for r in wild.collect()) == [(D(2024, 3, 1), 3, 1), (D(2024, 3, 2), 1, 1)]


def test_band_filter(spark):
    row = lambda **k: {"iso_country": "US", "event_type": "B", "species_id": "1320", "event_year": "2021", "event_month": "5", "event_day": "1", "coordinates_precision_code": None, "lat_dd": "40.1", "lon_dd": "-76.1"} | k
    rows = [row(), row(coordinates_precision_code="12.0"), row(event_type="E"), row(event_year="2019"), row(event_month="2", event_day="31"), row(lat_dd="x")]
    names = list(row())
    raw = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    places = spark.createDataFrame(POINTS, "place string, lat double, lon double")
    assert [tuple(r) for r in ingest.band_density(raw, places).collect()] == [("P1", D(2021, 5, 1), 1)]


def test_weather_fallback(spark):
    day = D(2024, 1, 1)
    obs = [("s0", day, "TMAX", 20.0), ("s0", day, "PRCP", 1.0), ("s1", day, "TMIN", 5.0), ("s1", day, "TMAX", 15.0), ("s1", day, "PRCP", 9.0)]
    near = spark.createDataFrame([("a", "s0", 0), ("a", "s1", 1)], "place string, station string, rank int")
    out = ingest.place_day_weather(spark.createDataFrame(obs, "station string, day date, elem string, value double"), near)
    assert [tuple(r)[2:] for r in out.collect()] == [(5.0, 15.0, 1.0)]


def test_station_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("USC00000001 40.0000  -76.0000   10.0\nCA000000002 50.0000  -76.0000   10.0\n")
    stations = readers.read_stations(spark, str(tmp_path / "list.txt"))
    assert [tuple(r) for r in stations.collect()] == [("USC00000001", 40.0, -76.0)]
    lines = [f"s1 40 -76 {e} 1990 2024" for e in ("TMAX", "TMIN", "PRCP")] + [f"s2 40 -76 {e} 1990 2024" for e in ("TMAX", "TMIN")] + [f"s3 40 -76 {e} 1990 2019" for e in ("TMAX", "TMIN", "PRCP")]
    (tmp_path / "inventory.txt").write_text("\n".join(lines))
    inventory = readers.read_inventory(spark, str(tmp_path / "inventory.txt"))
    three = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "station string")
    assert [r[0] for r in ingest.complete_stations(three, inventory).collect()] == ["s1"]
    import gzip

    with gzip.open(tmp_path / "2024.csv.gz", "wt") as f:
        f.write("s1,20240101,TMAX,123,,,S,\ns1,20240101,TMIN,5,,X,S,\ns9,20240101,TMAX,1,,,S,\ns1,20240102,SNOW,1,,,S,\n")
    assert [tuple(r) for r in readers.read_observations(spark, str(tmp_path / "*.csv.gz"), three).collect()] == [("s1", D(2024, 1, 1), "TMAX", 12.3)]


def test_json_table_and_population(spark, tmp_path):
    (tmp_path / "p.json").write_text('[["P1_001N","state","county"],["12","1","3"],["x","51","059"]]')
    assert sorted(map(tuple, ingest.population(readers.read_json_table(spark, str(tmp_path / "p.json"))).collect())) == [("01003", 12), ("51059", None)]


def test_poultry_exposure(spark):
    row = lambda county, what, value: ("TOTAL", what, "01", county, value)
    ops, inventory = "CHICKENS, LAYERS - OPERATIONS WITH INVENTORY", "CHICKENS, LAYERS - INVENTORY"
    raw = spark.createDataFrame([row("1", ops, "3"), row("1", inventory, "(D)"), row("2", ops, "2"), row("2", inventory, "50"), row("999", ops, "1")], "DOMAIN_DESC string, SHORT_DESC string, STATE_FIPS_CODE string, COUNTY_CODE string, VALUE string")
    master = spark.createDataFrame([("01001",), ("01002",), ("01003",)], "place string")
    wide, orphans = ingest.poultry_exposure(raw, master)
    assert {r["place"]: (r["layer_operations"], r["layer_inventory"]) for r in wide.collect()} == {"01001": (3, None), "01002": (2, 50), "01003": (0, 0)}
    assert [r[0] for r in orphans.collect()] == ["01999"]


def test_merges(spark, tmp_path):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    source = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    see = lambda df: dict(map(tuple, df.collect()))
    once = upsert.upsert(target, source, ["k"])
    assert see(once) == see(upsert.upsert(once, source, ["k"])) == {"a": 1, "b": 9, "c": 3}
    assert see(upsert.insert_missing(target, source, ["k"])) == {"a": 1, "b": 2, "c": 3}
    assert see(upsert.update_existing(target, source, ["k"], ["v"])) == {"a": 1, "b": 9}
    old = spark.createDataFrame([("a", "x", 100)], "k string, name string, population int")
    new = spark.createDataFrame([("a", "y", None), ("b", "z", None)], "k string, name string, population int")
    assert sorted(map(tuple, upsert.upsert_preserving(old, new, ["k"], ["name"]).collect())) == [("a", "y", 100), ("b", "z", None)]
    path = str(tmp_path / "table")
    upsert.publish(target, path)
    upsert.publish(upsert.upsert(spark.read.parquet(path), source, ["k"]), path)
    assert see(spark.read.parquet(path)) == {"a": 1, "b": 9, "c": 3}


def test_digests_of_files_of_any_size(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    body = np.random.default_rng(1).bytes(20 << 20)
    want = {}
    for name, data in (("a b.bin", body), ("c.bin", body[: 9 << 20]), ("small", b"xyz"), ("empty", b"")):
        (tmp_path / "raw" / name).write_bytes(data)
        want[name] = (len(data), hashlib.sha256(data).hexdigest())
    del want["empty"]
    for whole in (10, 10 << 20, 1 << 30):
        rows = snapshots.digests(spark, str(tmp_path / "raw"), whole=whole).collect()
        assert {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in rows} == want


def test_manifest_and_mirror(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.csv").write_text("x\n1\n")
    recorded = spark.createDataFrame(snapshots.manifest(spark, str(tmp_path / "raw"), "s", "u", "2024-01-01").toPandas().assign(row_count=0))
    assert snapshots.verify_manifest(spark, str(tmp_path / "raw"), recorded).count() == 0
    (tmp_path / "raw" / "a.csv").write_text("x\n2\n")
    (tmp_path / "raw" / "b.csv").write_text("y")
    assert sorted(r["status"] for r in snapshots.verify_manifest(spark, str(tmp_path / "raw"), recorded).collect()) == ["changed", "unrecorded"]
    rows = spark.createDataFrame([(1,)], "x int")
    snapshots.mirror(rows, str(tmp_path / "mirror"), "2024-01-01")
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.mirror(rows, str(tmp_path / "mirror"), "2024-01-01")
    built = snapshots.materialise([("one", lambda t: spark.sql("SELECT 1 AS k, DATE'2024-01-02' AS day")), ("two", lambda t: t["one"].select("k"))], str(tmp_path / "tables"), spark)
    assert built["two"].collect()[0][0] == 1


def test_gates(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), (None, 4)], "k string, v int")
    master = spark.createDataFrame([("a",), ("b",)], "k string")
    kept, lost = quality.resolve_keys(rows, master, "k")
    assert kept.count() == 2 and lost.count() == 2
    assert tuple(quality.resolution_report(rows, master, "k").first()) == (4, 2, 2, 2)
    with pytest.raises(quality.QualityError):
        quality.require_empty(quality.foreign_key_offenders(rows, master, "k"), "k")
    assert {tuple(r) for r in quality.primary_key_violations(rows, ["k"]).collect()} == {("a", 2), (None, 1)}
    assert tuple(quality.vintage_flags(rows, "k", ["a"], ["q"]).first()) == (True, True)


def test_metrics_and_quantiles(spark):
    scored = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.8, 0), (0.1, 0)], "p double, y int")
    m = model.metrics(scored, "p", "y").first()
    assert (m["roc_auc"], m["average_precision"], m["brier"]) == pytest.approx((0.875, 5 / 6, 0.175))
    values = spark.createDataFrame([(v,) for v in (5.0, 1.0, None, 2.0, 2.0, 9.0)], "v double")
    assert tuple(ranking.exact_quantiles(values, "v", [0, 0.5, 0.25, 1]).first()) == (1.0, 2.0, 2.0, 9.0)
    assert ranking.exact_quantiles(values.filter("v is null"), "v", [0.5]).first()[0] is None


def test_logit_recovers_coefficients_and_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    y = rng.random(3000) < 1 / (1 + np.exp(-(x @ [1.0, -0.5] - 1)))
    rows = spark.createDataFrame([(f"c{i % 50}", float(a), float(b), bool(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "place string, a double, b double, y boolean")
    fit = model.fit_logit(rows, ["a", "b"], "y", c=None)
    assert fit.coefficients / fit.deviations == pytest.approx([1.0, -0.5], abs=0.15) and fit.intercept < 0
    assert model.fit_logit(rows, ["a", "b"], "y", sampled_rate=0.05).shift == pytest.approx(-2.995732, abs=1e-6)
    table = model.clustered_inference(rows, ["a", "b"], label="y")
    assert table["significant"].all() and (table["ci_low"] < table["odds_ratio"]).all()
    # By hand: the sandwich over clusters.
    z = np.column_stack([np.ones(3000), (x - x.mean(0)) / x.std(0, ddof=1)])
    beta = np.append(fit.intercept, fit.coefficients)
    p = 1 / (1 + np.exp(-z @ beta))
    bread = np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z)
    scores = np.array([(z * (y - p)[:, None])[np.arange(3000) % 50 == g].sum(0) for g in range(50)])
    error = np.sqrt(np.diag(bread @ scores.T @ scores @ bread * 50 / 49 * 2999 / 2997))
    got = table.set_index("feature").loc["a"]
    assert np.log(got["ci_high"] / got["odds_ratio"]) == pytest.approx(1.959964 * error[1], rel=1e-3)


def test_shuffled_block_keeps_values(spark):
    rows = spark.sql("SELECT id AS place, DATE'2024-01-01' AS day, id * 2 AS u, id * 3 AS v, id AS w FROM range(200)")
    out = model.shuffled_block(rows, ["u", "v"], ["place", "day"], 1).toPandas()
    assert sorted(out["u"]) == [2 * i for i in range(200)] and (out["u"] * 3 == out["v"] * 2).all() and (out["u"] != 2 * out["w"]).any()


def test_sentiment(spark):
    posts = spark.createDataFrame([("a", D(2024, 1, 1), "en", "Good, good day"), ("a", D(2024, 1, 1), "fr", "stupid!"), ("a", D(2024, 1, 1), "en", None)], "place string, day date, lang string, text string")
    out = text.sentiment_rollup(posts.withColumn("score", text.lexicon_score(F.col("text")))).first()
    assert (out["post_count"], out["sentiment_mean"], out["sentiment_neg_share"]) == (3, 0.0, 0.5)
    import json

    assert json.loads(out["lang_breakdown"]) == pytest.approx({"en": 2 / 3, "fr": 1 / 3})
    scored = text.score_with(posts, lambda: lambda s: s.str.len() / 10.0)
    assert sorted((r["score"] for r in scored.collect()), key=str) == [0.7, 1.0, None]


def test_contiguous_states(spark):
    rows = spark.createDataFrame([("01001", 30.0, -86.0), ("02020", 61.0, -150.0), ("15003", 21.0, -158.0), ("72001", 18.0, -66.0), ("48001", None, -95.0), (None, 1.0, 1.0)], "code string, lat double, lon double")
    assert [r[0] for r in rows.select(ingest.is_contiguous(*map(F.col, ("code", "lat", "lon")))).collect()] == [True, False, False, False, False, False]


def test_population_backfill_keeps_its_gate(spark):
    places = spark.createDataFrame([("01001", None), ("01003", 5)], "place string, population long")
    raw = spark.createDataFrame([("7", "1", "1"), ("9", "1", "3"), ("9", "1", "5")], "P1_001N string, state string, county string")
    filled, report = ingest.backfill_population(places, raw, required=["01001"], forbidden=["09999"])
    assert sorted(map(tuple, filled.collect())) == [("01001", 7), ("01003", 9)] and tuple(report.first()) == (2, 0)
    with pytest.raises(quality.QualityError):
        ingest.backfill_population(places, raw, required=["09999"])


def test_publish_recovers_a_table_moved_aside(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert.publish(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t__old")
    assert upsert.recover(spark, path) and spark.read.parquet(path).count() == 3 and not upsert.recover(spark, path)


def test_key_share_repeats_and_spreads(spark):
    from terrapanel.plans.model import key_share

    out = spark.range(4000).select(key_share("id").alias("a"), key_share("id", seed=1).alias("b")).toPandas()
    assert (out["a"] != out["b"]).mean() > 0.9 and 0.08 < (out["a"] < 0.1).mean() < 0.12 and out.min().min() >= 0 and out.max().max() < 1


def test_lexicon_counts_whole_words(spark):
    from terrapanel.plans.text import lexicon_score

    rows = spark.createDataFrame([("Good GOODS bad", ), ("safe;sick,safe_ safe1", ), ("", ), (None, ), ("nothing", )], "t string")
    got = [r[0] for r in rows.select(lexicon_score(F.col("t"), ("good", "safe", "x y"), ("bad", "sick"))).collect()]
    assert got == [0.0, 0.5, 0.0, None, 0.0]


def test_model_table_of_facts_before_the_calendar_equals_the_joined_one(spark):
    """Both ways to the model table, with facts from before the calendar, at its ends, and of unknown places."""
    import datetime as dt

    from terrapanel.operators.ingest import with_calendar_columns
    from tests.test_refresh import FACTS, content, inputs, random_facts

    facts = random_facts(11, 500)
    facts = {f: sorted({*rows, ("a", 0), ("zz", 250), ("b", 500), ("c", 60), ("c", 130)}) for f, rows in facts.items()}
    i = inputs(spark, facts, 500)
    days = i.days.filter(F.col("day") >= dt.date(2021, 2, 1))
    calendar = with_calendar_columns(days)
    counts = features.daily_counts(i.outbreak, i.wild, i.band)
    lag = features.spatial_lag(i.edges, counts, days)
    pressure = features.migration_pressure(i.pairs, i.axis, i.wild, calendar=days)
    joined = features.county_day(i.places, calendar, i.edges, i.outbreak, i.weather, i.wild, i.band, i.axis, i.census, pressure, lag, features.weather_lag(i.weather), i.sentiment)
    dense = features.dense_county_day(i.places, calendar, i.edges, i.outbreak, i.weather, i.wild, i.band, i.axis, i.pairs, i.census, i.sentiment, 4)
    assert dense.columns == joined.columns and set(FACTS) == set(facts)
    assert content(dense) == content(joined)
    few = ["place", "day", "nbr_infections_7d", "days_since_outbreak_neighbor", "target_outbreak_next_14d", "breeding_side_pressure"]
    some = features.dense_county_day(i.places, calendar, i.edges, i.outbreak, i.weather, i.wild, i.band, i.axis, i.pairs, i.census, i.sentiment, 4, columns=few)
    assert content(some) == content(joined.select(*few))


def test_the_grid_is_not_shuffled(spark):
    """What is joined to the grid is dealt by place as it is: exchanges by place and day are of facts alone."""
    import re

    from terrapanel.plans.views import Views

    plan = Views(spark, "/root/testdata/sf0.001").county_day._jdf.queryExecution().executedPlan().toString()
    join = re.search(r"SortMergeJoin \[place#\d+L?, day#\d+\], \[place#\d+L?, day#\d+\], LeftOuter", plan)
    grid, facts = plan[: plan.index("Union")], plan[plan.index("Union") :]
    assert join and "Union" in plan and "hashpartitioning(place" in facts
    assert not re.search(r"Exchange hashpartitioning\(place#\d+L?, day", grid)
    assert len(re.findall(r"\bWindow \[", grid)) == len(re.findall(r"\bWindow \[", plan[: join.start()]))


def test_quantiles_of_many_columns_equal_those_of_one(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 30_000
    ties, few = rng.integers(0, 40, n).astype(float), rng.normal(size=n)
    wide = np.exp(3 * rng.normal(size=n))
    rows = [(float(t), float(w) if k % 7 else None, float("nan") if k % 5 == 0 else float(f), k) for k, (t, w, f) in enumerate(zip(ties, wide, few, strict=True))]
    df = spark.createDataFrame(rows, "t double, w double, f double, k int").withColumn("name", F.lit("clash"))
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    values = {"t": F.col("t"), "w": F.col("w"), "f": F.col("f"), "some": F.when(F.col("k") < 11, F.col("f")), "none": F.lit(None)}
    got = ranking.exact_quantiles_of(df, values, shares).first()
    want = {"t": ties, "w": np.array([r[1] for r in rows if r[1] is not None]), "f": np.array([r[2] for r in rows if r[2] == r[2]]), "some": np.array([r[2] for r in rows[:11] if r[2] == r[2]])}
    for name, x in want.items():
        assert [got[f"{name}_q{k}"] for k in range(5)] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)
    assert got["none_q2"] is None and ranking.exact_quantiles_of(df.limit(0), {"t": F.col("t")}, [0.5]).first()[0] is None


def test_exchange_test_agrees_with_all_exchanges(spark):
    import itertools

    groups = {"a": [(1.0, 3.0), (2.0, 1.0), (5.0, 9.0)], None: [(4.0, 2.0), (0.0, 0.0), (3.0, 4.0), (8.0, 7.0)]}
    rows = [(g, k, x, y) for g, own in groups.items() for k, (x, y) in enumerate(own)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    observed = sum(x * y for *_, x, y in rows)
    every = [sum(x * y for (x, _), y in zip([*groups["a"], *groups[None]], [*p, *q], strict=True)) for p in itertools.permutations([y for _, y in groups["a"]]) for q in itertools.permutations([y for _, y in groups[None]])]
    exact = sum(s >= observed - 1e-9 for s in every) / len(every)
    row = model.exchange_test(df, ["y"], F.sum(F.col("x") * F.col("y")), ["g", "k"], ["g"], repeats=1500).first()
    assert row["observed"] == observed and row["repeats"] == 1500 and abs(row["p_value"] - exact) < 0.02 and exact < 0.05
    # A block that says nothing of the statistic is as large in every exchange.
    assert model.exchange_test(df.withColumn("z", F.lit(1.0)), ["z"], F.sum("y"), ["g", "k"], ["g"], repeats=9).first()["p_value"] == 1.0
