"""Work that must grow with the input, on small tables that show it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import spatial
from terrapanel.operators import windows as W
from terrapanel.plans import features, model
from terrapanel.plans.views import Views


def day(k: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(k)


def test_pressure_over_sites_equals_that_over_places(spark):
    """Places that share coordinates, of two flyways; both sides, each place's own row."""
    rng = random.Random(5)
    spots = [(40 + rng.random() * 4, -76 + rng.random() * 4) for _ in range(12)]
    rows = [(k, rng.choice(("PA", "OH")), *spots[k % 12]) for k in range(40)]
    places = spark.createDataFrame(rows, "place long, state string, lat double, lon double")
    axis = spatial.migration_axis(places.filter("place <> 7"))
    found = spark.createDataFrame([(rng.randrange(45), day(d), 1 + rng.randrange(3)) for d in sorted(rng.choices(range(200), k=60))], "place long, day date, detection_count long").groupBy("place", "day").agg(F.sum("detection_count").alias("detection_count"))
    calendar = spark.createDataFrame([(day(k),) for k in range(10, 190)], "day date")
    want = features.migration_pressure(spatial.proximity(places, 400), axis, found, calendar=calendar)
    got = features.site_pressure(places, axis, found, calendar=calendar, parts=3)
    key = lambda r: (r["place"], r["day"])
    a, b = sorted(want.collect(), key=key), sorted(got.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b] and len(a) > 1000
    for x, y in zip(a, b, strict=True):
        assert [x[2] is None, x[3] is None] == [y[2] is None, y[3] is None]
        assert [v or 0 for v in x[2:]] == pytest.approx([v or 0 for v in y[2:]])


def test_trailing_values_spread_no_row_over_the_next(spark):
    """300 days in a row, of which some have one value only: what is spread has a row a day, not 21."""
    rows = [(1, day(k), 0.1 * k, None if k % 50 else 1.0) for k in range(300)] + [(2, day(5), None, 2.0), (2, day(40), 3.0, None)]
    daily = spark.createDataFrame(rows, "place long, day date, a double, b double")
    found = W.trailing_values(daily, ["place"], ["a", "b"], 21)
    got = {(r["place"], r["day"]): (r["a"], r["b"]) for r in found.collect()}
    want = {}
    for place in (1, 2):
        for k in range(0, 330):
            sums = [[r[c] for r in rows if r[0] == place and r[c] is not None and day(k - 21) <= r[1] < day(k)] for c in (2, 3)]
            if any(sums):
                want[place, day(k)] = [sum(s) if s else None for s in sums]
    assert got.keys() == want.keys()
    assert all(list(got[k]) == pytest.approx(want[k]) for k in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence(day") == 1 and "until" in plan


def test_the_design_makes_only_the_columns_it_reads(spark, monkeypatch):
    """The queries on the design ask the model table for its inputs alone, and these are all that it reads."""
    from terrapanel.plans import registry

    asked = []

    def only(self, *columns):
        asked.append(columns)
        raise KeyboardInterrupt

    monkeypatch.setattr(Views, "model_columns", only)
    for name in ("design_matrix", "leakage_scan_matrix", "ablation"):
        with pytest.raises(KeyboardInterrupt):
            registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(asked) == 3 and all(0 < len(c) < 45 for c in asked)
    rows = spark.createDataFrame([], ", ".join(f"{c} {'date' if c == 'day' else 'double'}" for c in model.design_inputs(banding=True)))
    assert set(model.feature_columns(model.design_matrix(rows, "2000-01-01", banding=True))) == set(model.design_columns(banding=True))


def test_a_fit_takes_few_passes_and_is_exact(spark, monkeypatch):
    """Newton steps: the gradient of the penalised losses is 0 where they end, also with a constant and a doubled column."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 2))
    y = rng.random(2000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0] - 2)))
    df = spark.createDataFrame([(float(a), float(b), 3.0, float(a), bool(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, c double, d double, y boolean")
    calls, sums = [], model._loss_sums
    monkeypatch.setattr(model, "_loss_sums", lambda *args: calls.append(1) or sums(*args))
    fit = model.fit_logit(df, ["a", "b", "c", "d"], "y")
    assert 2 < len(calls) <= 15
    z = np.column_stack([x[:, 0], x[:, 1], np.full(2000, 3.0), x[:, 0]])
    z = (z - fit.means) / fit.deviations
    p = 1 / (1 + np.exp(-(z @ fit.coefficients + fit.intercept)))
    assert np.abs(z.T @ (p - y) + fit.coefficients).max() < 1e-6 and abs(np.sum(p - y)) < 1e-6
    # Every fit is judged on written scores: metrics pass over two columns, not over the features again.
    seen, metrics = [], model.metrics
    monkeypatch.setattr(model, "metrics", lambda s, *args: seen.append((s.columns, s.inputFiles())) or metrics(s, *args))
    out = model.ablation(df, df, ["a", "b"], {"b": ["b"]}, "y").collect()
    assert len(out) == 2 and all(columns == ["_score", "y"] and files for columns, files in seen)


def test_edges_meet_events_and_not_their_days(spark):
    """Recency and counts of different neighbours equal those by neighbour ages, but what meets the edges is not spread."""
    rng = random.Random(9)
    edges = spark.createDataFrame([(a, b) for a in range(8) for b in range(8) if a != b and (a + b) % 3], "place long, neighbour long")
    events = spark.createDataFrame(sorted({(rng.randrange(9), day(rng.randrange(500))) for _ in range(60)}), "place long, day date")
    calendar = spark.createDataFrame([(day(k),) for k in range(20, 700)], "day date")
    ages = W.neighbour_ages(edges, events, 365, calendar)
    want = ages.groupBy("place", "day").agg(F.min("age").alias("since"))
    counted = ages.filter("age <= 60").groupBy("place", "day").agg(*(F.count_if(F.col("age") <= w).alias(f"n_{w}d") for w in W.WINDOWS))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for parts in (None, 3):
        since = W.neighbour_recency(edges, events, 365, "since", calendar, parts)
        counts = W.neighbour_counts(edges, events, "n", calendar=calendar, parts=parts)
        assert since.columns == want.columns and rows(since) == rows(want)
        assert counts.columns == counted.columns and rows(counts) == rows(counted)
        for df in (since, counts):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "sequence(" not in plan[plan.index("Join Inner") :]


def test_scorers_get_batches_of_bounded_bytes(spark):
    """60 texts of a million characters reach a scorer in batches of a few of them."""
    from terrapanel.plans.text import score_with

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    posts = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))

    def scorer():
        return lambda texts: texts.str.len().sum() / 1e9 + texts.str.len() * 0.0

    found = score_with(posts, scorer).agg(F.max("score"), F.count("score")).first()
    assert found[0] * 1e9 <= 8_000_000 and found[1] == 60


def test_the_grid_of_dense_trailing_is_not_shuffled(spark):
    """Places are dealt before they are crossed with days; what is exchanged below the join is places and facts."""
    from terrapanel.plans import registry

    plan = registry.queries()["dense_trailing"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    cross = plan.index("BroadcastNestedLoopJoin")
    assert "Exchange hashpartitioning" not in plan[:cross] and "Exchange hashpartitioning(place" in plan[cross:]


def test_columns_of_outbreaks_alone_read_no_other_fact(spark, monkeypatch):
    """The sample and the scores are made from the lines of outbreaks: no other facts are written, no posts read."""
    from terrapanel.plans import registry

    monkeypatch.setattr(Views, "rebuilt", lambda self: pytest.fail("all facts are written"))
    plan = registry.queries()["case_control_sample"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "detection_count" not in plan and "post_count" not in plan and "temp_min_c" not in plan
    assert registry._scores(Views(spark, "/root/testdata/sf0.001")).columns == ["place", "day", "y", "p"]


def test_the_model_table_meets_no_pairs_of_places(spark, monkeypatch):
    """Pressure comes of sites, not of all pairs of places, whose number grows as the square of the places'."""
    monkeypatch.setattr(Views, "pairs", property(lambda self: pytest.fail("pairs of places")))
    assert "breeding_side_pressure" in Views(spark, "/root/testdata/sf0.001").county_day.columns


def test_missing_shares_make_no_column_that_cannot_be_null(spark, monkeypatch):
    """Counts, flags and keys of the model table are not made to find that none is null."""
    from terrapanel.plans import registry

    asked, made = [], Views.model_columns
    monkeypatch.setattr(Views, "model_columns", lambda self, *columns, **how: asked.append(columns) or made(self, *columns, **how))
    rows = registry.queries()["missingness"](spark, "/root/testdata/sf0.001")
    assert len(asked) == 1 and 0 < len(asked[0]) < 45 and "nbr_infections_60d" not in asked[0]
    model = Views(spark, "/root/testdata/sf0.001").rebuilt()
    holds = {f.name for f in made(model).schema.fields if f.nullable}
    assert holds - set(asked[0]) <= {"place", "day"} and rows.columns == ["column_name", "null_share"]


def test_the_model_table_of_lists_equals_that_of_windows(spark, monkeypatch):
    """Facts from before the calendar, at its ends and of unknown places, a calendar with gaps, some columns, modelled rows,
    and groups of two places, blocks of one site and a few days at once."""
    from terrapanel.operators import dense
    from terrapanel.operators.ingest import with_calendar_columns
    from tests.test_refresh import content, inputs, random_facts

    facts = random_facts(11, 500)
    facts = {f: sorted({*rows, ("a", 0), ("a", 3), ("zz", 250), ("b", 500), ("c", 60), ("c", 130)}) for f, rows in facts.items()}
    i = inputs(spark, facts, 500)
    calendar = with_calendar_columns(i.days.filter((F.col("day") >= dt.date(2021, 2, 1)) & (F.dayofyear("day") % 50 != 0)))
    tables = i.outbreak, i.weather, i.wild, i.band, i.axis
    want = features.dense_county_day(i.places, calendar, i.edges, *tables, i.pairs, i.census, i.sentiment, 4).cache()
    got = features.listed_county_day(i.places, calendar, i.edges, *tables, i.census, i.sentiment)
    assert got.columns == want.columns and [(c, k) for c, k in got.dtypes] == want.dtypes
    assert content(got) == content(want)
    few = ["place", "day", "nbr_infections_7d", "days_since_outbreak_neighbor", "target_outbreak_next_14d", "breeding_side_pressure", "season", "state"]
    for cells, at_once in ((1, 100), (1500, 7)):
        monkeypatch.setattr(dense, "CELLS", cells)
        monkeypatch.setattr(dense, "DAYS_AT_ONCE", at_once)
        some = features.listed_county_day(i.places, calendar, i.edges, *tables, i.census, i.sentiment, columns=few, digits=8, modelled=True)
        assert content(some) == content(want.filter("is_conus and target_complete_7d").select(*few))


def test_places_times_days_are_written_and_not_computed_by_rows(spark):
    """The plan of the model table joins places; days are not exploded, no window runs over the grid, and nothing follows
    the task that writes the rows."""
    from terrapanel.plans import registry

    plan = registry.queries()["county_day"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan[:200] and "sequence(" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan[: plan.index("Join")]


def test_rounding_by_arithmetic_equals_that_of_decimals(spark):
    import numpy as np

    from terrapanel.functions.scalar import rounded
    from terrapanel.operators import dense

    rng = random.Random(3)
    values = [0.0, 1 / 512, -1 / 512, 0.1, 2.5e-9, 1e300, float("inf"), float("nan"), 123456789.123456789, None, *(rng.uniform(-1000, 1000) for _ in range(2000))]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded(F.col("v"), 8).alias("a"), F.round("v", 8).alias("b")).collect()
    assert all(repr(r["a"]) == repr(r["b"]) for r in rows)
    plain = [v for v in values if v is not None]
    assert list(map(repr, dense.rounded(np.array(plain), 8).tolist())) == [repr(r["a"]) for r in rows if r["v"] is not None]


def test_the_whole_design_is_made_in_one_pass_and_not_written(spark, monkeypatch):
    """Medians come of facts and places; neither model rows nor the design are written, and both ways give the same."""
    from terrapanel.plans import registry
    from tests.test_refresh import content

    folder, written, kept = "/root/testdata/sf0.001", [], registry.kept
    monkeypatch.setattr(registry, "kept", lambda df, name: written.append(name) or kept(df, name))
    made = registry._whole_design(Views(spark, folder))
    registry.queries()["leakage_scan_matrix"](spark, folder)
    assert not written
    rows = registry._model_rows(Views(spark, folder), *model.design_inputs())
    assert content(made) == content(model.design_matrix(rows, "2000-01-01"))


def test_all_fits_step_in_the_same_passes(spark, monkeypatch):
    """An ablation and a permutation pass over the rows as often as one fit does, and write one table of scores."""
    rng = random.Random(6)
    rows = [(k, day(k % 300), rng.random(), rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(3000)]
    df = spark.createDataFrame([(k, d, a, b, a, u + b > 0.9) for k, d, u, a, b in rows], "place long, day date, a double, b double, c double, y boolean")
    calls, written, sums, kept = [], [], model._loss_sums, model.kept
    monkeypatch.setattr(model, "_loss_sums", lambda *args: calls.append(len(args[-1])) or sums(*args))
    monkeypatch.setattr(model, "kept", lambda df, name: written.append(name) or kept(df, name))
    blocks = {"b": ["b"], "a": ["a", "c"]}
    table = {r["block"]: r["roc_auc"] for r in model.ablation(df, df, ["a", "b", "c"], blocks, "y").collect()}
    assert 2 < len(calls) <= 15 and max(calls) == 3 and written == ["scored"]
    for name, block in {"none": [], **blocks}.items():
        alone = model.fit_logit(df, [f for f in ("a", "b", "c") if f not in block], "y")
        assert model.metrics(model.scored(df, alone, "p", "y"), "p", "y").first()["roc_auc"] == pytest.approx(table[name], abs=1e-9)
    calls.clear()
    found = {r["repeat"]: r["roc_auc"] for r in model.permutation_test(df, df, ["a", "b", "c"], ["b"], repeats=2, label="y").collect()}
    assert 2 < len(calls) <= 15 and max(calls) == 3
    alone = model.fit_logit(model.shuffled_block(df, ["b"], ["place", "day"], 2), ["a", "b", "c"], "y")
    assert model.metrics(model.scored(df, alone, "p", "y"), "p", "y").first()["roc_auc"] == pytest.approx(found[2], abs=1e-9)


def test_blocks_are_shuffled_together_as_one_by_one(spark):
    rows = spark.range(5000).select(F.col("id").alias("place"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 70).cast("int")).alias("day"), (F.col("id") * 3).alias("u"), F.rand(1).alias("v"))
    both = model.shuffled_blocks(rows, ["u"], ["place", "day"], [1, 2], stratum_rows=600)
    for seed in (1, 2):
        one = model.shuffled_block(rows, ["u"], ["place", "day"], seed, stratum_rows=600)
        assert sorted(map(tuple, both.select("place", F.col(f"u_{seed}")).collect())) == sorted(map(tuple, one.select("place", "u").collect()))


def test_training_rows_are_written_apart(spark):
    """A fit's passes read no file of test rows."""
    from terrapanel.sources.shared import kept_apart

    rows = spark.range(100).select("id", F.when(F.col("id") < 90, F.col("id") % 3 == 0).alias("train"))
    a, b = kept_apart(rows, "apart", F.col("train"))
    assert a.columns == b.columns == ["id", "train"] and a.count() == 30 and b.count() == 70
    assert not set(a.inputFiles()) & set(b.inputFiles()) or "PartitionFilters: [isnotnull(_apart" in a._jdf.queryExecution().executedPlan().toString()
    none, all_ = kept_apart(rows.filter("id < 0"), "apart", F.col("train"))
    assert none.count() == all_.count() == 0
