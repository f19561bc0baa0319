"""Queries over landed files: raw text written from the tables in a source's layout, read and conformed as the
source would be.  Registered with registry.add_query(), which imports this module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.operators import ingest as I
from terrapanel.plans import model as M
from terrapanel.plans.registry import add_query, design, km_sql, landed
from terrapanel.plans.views import Views
from terrapanel.sources import readers, snapshots


def _code(place: Column) -> Column:
    return F.lpad((place % 72 * 1000 + place % 1000).cast("string"), 5, "0")


_REMAP, _SPLIT = {"03003": "04004", "10010": "12012"}, ("07007",)
_CODES = "CASE {0} WHEN '03003' THEN '04004' WHEN '10010' THEN '12012' ELSE {0} END"
_CODE_SQL = "lpad(CAST({0} % 72 * 1000 + {0} % 1000 AS VARCHAR), 5, '0')"


@add_query(
    "adjacency_file",
    f"""SELECT DISTINCT place, neighbour FROM (SELECT {_CODES.format('a')} AS place, {_CODES.format('b')} AS neighbour FROM (SELECT {_CODE_SQL.format('place')} AS a, {_CODE_SQL.format('neighbour')} AS b FROM adjacency))
    WHERE place <> neighbour AND place <> '07007' AND neighbour <> '07007' AND substr(place, 1, 2) < '60' AND substr(neighbour, 1, 2) < '60'""",
)
def _adjacency_file(v: Views) -> DataFrame:
    """Blocks of a place and its neighbours, the place on a block's first line only and without its zeros."""
    bare = lambda c: F.regexp_replace(_code(F.col(c)), "^0+(?=.)", "")
    pairs = v.adjacency.select("place", bare("place").alias("own"), F.concat(F.lit("Doña\t"), bare("neighbour")).alias("near"))
    blocks = pairs.groupBy("place").agg(F.max("own").alias("own"), F.sort_array(F.collect_list("near")).alias("near"))  # six neighbours at most
    text = F.concat(F.lit("A Place\t"), F.col("own"), F.lit("\t"), F.array_join("near", "\n\t\t"))
    blocks.select(text.alias("value")).repartition(8).write.option("encoding", "ISO-8859-1").text(path := landed(v, "adjacency"))
    return I.adjacency(readers.read_adjacency(v.spark, path), _REMAP, _SPLIT)


def _station_id(station: Column) -> Column:
    return F.concat(F.when(station % 5 == 0, "CA").otherwise("US"), F.lpad(station.cast("string"), 9, "0"))


_STATION = "CASE WHEN station % 5 = 0 THEN 'CA' ELSE 'US' END || lpad(CAST(station AS VARCHAR), 9, '0')"


@add_query(
    "station_files",
    f"""SELECT {_STATION} AS station, lat, lon FROM stations WHERE station % 5 <> 0 AND station IN (SELECT station FROM stations CROSS JOIN (VALUES ('TMAX', 0), ('TMIN', 1), ('PRCP', 2)) e(elem, n)
    WHERE NOT (station % 4 = 1 AND elem = 'PRCP') AND 2005 + (station + 7 * n) % 30 >= 2020 AND 1990 + (station + 11 * n) % 45 <= 2026 GROUP BY station HAVING count(DISTINCT elem) = 3)""",
)
def _station_files(v: Views) -> DataFrame:
    """A fixed-width list and an inventory in columns; the stations that report all elements."""
    k, n = F.col("station"), F.col("n")
    line = F.concat(_station_id(k), F.lit(" "), F.format_string("%8.4f", "lat"), F.lit(" "), F.format_string("%9.4f", "lon"), F.lit("  120.0 NAME"))
    v.stations.select(line.alias("value")).write.text(listed := landed(v, "stations"))
    each = v.stations.select("station", "lat", "lon", F.posexplode(F.array(*map(F.lit, ("TMAX", "TMIN", "PRCP", "SNOW")))).alias("n", "elem")).filter(~((k % 4 == 1) & (F.col("elem") == "PRCP")))
    years = (F.lit(1990) + (k + 11 * n) % 45, F.lit(2005) + (k + 7 * n) % 30)
    line = F.concat_ws("   ", _station_id(k), F.format_string("%.4f", "lat"), F.format_string("%.4f", "lon"), "elem", *(y.cast("string") for y in years))
    each.select(line.alias("value")).write.text(inventory := landed(v, "inventory"))
    return I.complete_stations(readers.read_stations(v.spark, listed), readers.read_inventory(v.spark, inventory))


@add_query(
    "yearly_observations",
    """SELECT CAST(o_custkey AS VARCHAR) AS station, CAST(o_orderdate AS DATE) AS day, ['TMAX', 'TMIN', 'PRCP', 'SNOW'][o_orderkey % 4 + 1] AS elem, CAST(o_orderkey % 1000 - 200 AS DOUBLE) / 10 AS value
    FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 11 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""",
)
def _yearly_observations(v: Views) -> DataFrame:
    """Gzipped files of a year each, headerless, values in tenths."""
    k = F.col("o_orderkey")
    elem = F.element_at(F.array(*map(F.lit, ("TMAX", "TMIN", "PRCP", "SNOW"))), (k % 4 + 1).cast("int"))
    flag = F.when(k % 11 == 0, "X")
    none = F.lit(None).cast("string")
    rows = v.table("orders").select(
        F.col("o_custkey").cast("string").alias("station"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), elem.alias("elem"), (k % 1000 - 200).alias("value"), none.alias("mflag"), flag.alias("qflag"), F.lit("S").alias("sflag"),
        F.lit("0700").alias("obstime"), F.year("o_orderdate").alias("part_year"),
    )
    rows.repartition("part_year").write.partitionBy("part_year").option("compression", "gzip").csv(path := landed(v, "by-year"))
    wanted = v.table("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("station"))
    return readers.read_observations(v.spark, path, wanted, partitions=8)


@add_query(
    "wild_file",
    """SELECT r.place, day, count(*) AS detection_count, count(DISTINCT CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 7 END) AS n_species
    FROM lines l JOIN resolved r ON r.row_id = l.place WHERE l_quantity >= 40 AND l_returnflag = 'A' AND r.place IS NOT NULL AND (l_linenumber % 3 <> 0 OR l_linenumber % 6 <> 0) GROUP BY ALL""",
)
def _wild_file(v: Views) -> DataFrame:
    """Detections with the day of collection, or only that of detection, or neither."""
    n = F.col("l_linenumber")
    rows = v.lines.filter("l_quantity >= 40 and l_returnflag = 'A'").join(v.named_rows, F.col("place") == F.col("row_id"))
    collected = F.when(n % 3 == 0, "").when(n % 2 == 0, F.date_format("day", "M/d/yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    detected = F.when(n % 6 == 0, "unknown").when(n % 3 == 0, F.date_format("day", "yyyy-MM-dd")).otherwise("1/2/1990")
    species = F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("Anas, "), (F.col("l_partkey") % 7).cast("string")))
    raw = rows.select(F.col("state_name").alias("State"), F.col("place_name").alias("County"), collected.alias("Collection Date"), detected.alias("Date Detected"), species.alias("Bird Species"))
    raw.write.option("header", True).csv(path := landed(v, "wild"))
    return I.wild_detections(readers.read_csv(v.spark, path), v.master)[0]


_BANDED = """SELECT floor(25 + CAST(o_custkey * 6131 % 2400 AS DOUBLE) / 100) AS lat, floor(-124 + CAST(o_custkey * 86311 % 5700 AS DOUBLE) / 100) AS lon,
    TRY_CAST(CAST(year(CAST(o_orderdate AS DATE)) AS VARCHAR) || '-' || lpad(CAST(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) AS day
    FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 2 AND o_orderkey % 5 <> 0 AND o_orderkey % 17 <> 0 AND year(CAST(o_orderdate AS DATE)) >= 1997"""


@add_query(
    "band_file",
    f"""WITH_ snapped AS (SELECT lat, lon, arg_min(place, (d, place)) AS place FROM (SELECT q.lat, q.lon, p.place, {km_sql('q.lat', 'q.lon', 'p.lat', 'p.lon')} AS d FROM (SELECT DISTINCT lat, lon FROM ({_BANDED}) WHERE day IS NOT NULL) q CROSS JOIN places p) GROUP BY lat, lon)
    SELECT place, day, count(*) AS band_count FROM ({_BANDED}) b JOIN snapped s ON s.lat = b.lat AND s.lon = b.lon WHERE day IS NOT NULL GROUP BY ALL""",
)
def _band_file(v: Views) -> DataFrame:
    """Bandings with parts of dates and coordinates, of which five conditions keep some."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    lat, lon = F.floor(25 + (c * 6131 % 2400).cast("double") / 100), F.floor(-124 + (c * 86311 % 5700).cast("double") / 100)
    raw = v.table("orders").select(
        F.when(k % 13 == 0, "CA").otherwise("US").alias("iso_country"), F.when(k % 7 == 0, "E").otherwise("B").alias("event_type"), F.when(k % 3 == 0, "1320").when(k % 3 == 1, "1400").otherwise("9999").alias("species_id"),
        text(F.year("o_orderdate")).alias("event_year"), text(k % 14).alias("event_month"), text(k % 33).alias("event_day"), F.when(k % 5 == 0, "12.0").when(k % 5 != 1, "1.0").alias("coordinates_precision_code"),
        F.when(k % 17 == 0, "x").otherwise(text(lat)).alias("lat_dd"), text(lon).alias("lon_dd"),
    )
    raw.write.option("header", True).csv(path := landed(v, "bandings"))
    return I.band_density(readers.read_csv(v.spark, path), v.places, first_year=1997)


@add_query("snapshot_digests", "SELECT CAST(o_orderkey % 16 AS INTEGER) AS part, sha256(string_agg(CAST(o_orderkey AS VARCHAR) || ' ' || o_orderstatus || chr(10), '' ORDER BY o_orderkey)) AS sha256, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + 3) AS BIGINT) AS size FROM orders GROUP BY 1")
def _snapshot_digests(v: Views) -> DataFrame:
    """The manifest of a snapshot of sixteen sorted files, whose bytes follow from the rows."""
    rows = v.table("orders").select((F.col("o_orderkey") % 16).cast("int").alias("part"), "o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus").alias("value"))
    rows.repartition(16, "part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path := landed(v, "digests"))
    listed = snapshots.manifest(v.spark, f"{path}/part=*", "orders", "landed", "2024-01-01")
    return listed.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), "sha256", "size")


@add_query("logit_score", "SELECT unnest([" + ", ".join(f"'{c}'" for c in ["_const", *M.design_columns()]) + "]) AS feature, 0.0::DOUBLE AS score")
def _logit_score(v: Views) -> DataFrame:
    """The gradient of the penalised loss by row at the fitted coefficients, which is 0 in every feature."""
    train, _, names = design(v)
    model = M.fit_logit(train, names)
    n = train.count()
    left = F.col(M.LABEL).cast("double") - model.probability()
    scaled = {"_const": F.lit(1.0)} | {f: (F.col(f) - float(m)) / float(s) for f, m, s in zip(names, model.means, model.deviations, strict=True)}
    penalty = dict(zip(names, map(float, model.coefficients), strict=True))
    sums = train.agg(*((F.sum(left * x) / n - penalty.get(f, 0.0) / n).alias(f) for f, x in scaled.items()))
    return sums.unpivot([], list(scaled), "feature", "score").select("feature", (F.round("score", 4) + 0.0).alias("score"))
