import datetime
import math

import pytest
from pyspark.sql import functions as F

from terrapanel.functions import geo, scalar
from terrapanel.operators.ingest import calendar


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_census_value(spark):
    rows = [(v,) for v in (" 1,234 ", "(D)", "(NA)", "(X)", "(Z)", "abc", None)]
    assert one(spark, rows, "v string", scalar.census_value(F.col("v"))) == [1234.0, None, None, None, 0.0, None, None]


def test_zero_padding_keeps_longer_texts(spark):
    assert one(spark, [("7",), ("123456",), (None,)], "v string", scalar.zero_padded(F.col("v"), 5)) == ["00007", "123456", None]


def test_dates(spark):
    parts = [("2024", "2", "31"), ("2024", None, "1"), ("2024", "2", "29"), ("2024.0", "02", "1"), ("x", "1", "1")]
    assert one(spark, parts, "y string, m string, d string", scalar.day_from_parts(F.col("y"), F.col("m"), F.col("d"))) == [None, None, datetime.date(2024, 2, 29), datetime.date(2024, 2, 1), None]
    texts = [("2024-03-02",), ("3/2/2024",), ("20240302",), ("",), (None,)]
    assert one(spark, texts, "v string", scalar.day_of(F.col("v"))) == [datetime.date(2024, 3, 2)] * 3 + [None] * 2


def test_log_count_and_ratio_keep_nulls(spark):
    assert one(spark, [(None,), (-3.0,), (math.e - 1,)], "v double", scalar.log_count(F.col("v"))) == [None, 0.0, pytest.approx(1.0)]
    assert one(spark, [(4, 2.0), (4, 0.0), (None, 2.0)], "a int, b double", scalar.ratio(F.col("a"), F.col("b"))) == [2.0, None, None]


def test_angles(spark):
    rows = [(350.0, 10.0), (10.0, 350.0), (0.0, 180.0), (359.0, 1.0)]
    assert one(spark, rows, "a double, b double", geo.angle_between(F.col("a"), F.col("b"))) == pytest.approx([20, 20, 180, 2])


def test_calendar(spark):
    days = {r["day"].isoformat(): r for r in calendar(spark, "2021-01-01", "2024-12-31").collect()}
    assert (days["2021-01-03"]["iso_week"], days["2021-01-03"]["season"]) == (53, "winter")
    assert (days["2024-12-30"]["iso_week"], days["2024-12-30"]["day_of_year"]) == (1, 365)
    assert days["2024-02-29"]["day_of_year"] == 60
    holidays = {d for d, r in days.items() if r["is_us_holiday"]}
    assert {"2024-01-01", "2024-01-15", "2024-05-27", "2024-07-04", "2024-11-28", "2021-06-19", "2021-06-18", "2021-12-24", "2021-12-31", "2023-01-02"} <= holidays
    assert not {"2024-01-16", "2024-07-05", "2020-06-19"} & holidays
