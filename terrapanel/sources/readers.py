"""Raw snapshots as they land: everything is read as text and coerced by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions.scalar import number


def read_csv(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, all columns as text, names trimmed, empty values null."""
    df = spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", False).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(path, line, value): the numbered lines of small files, each file read whole."""
    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", encoding).alias("content"))
    lines = files.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line", "value"))
    return lines.filter(F.col("value") != "")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, place, neighbour): a headerless file of four columns whose first two are blank on
    continuation rows; blanks are null here."""
    part = F.split("value", "\t")
    blank = lambda k: F.nullif(F.trim(F.get(part, F.lit(k))), F.lit(""))
    return read_lines(spark, path).select("path", "line", blank(1).alias("place"), blank(3).alias("neighbour"))


def read_stations(spark: SparkSession, path: str, prefix: str = "US") -> DataFrame:
    """(station, lat, lon) of a fixed-width list: columns 1-11, 13-20 and 22-30."""
    rows = spark.read.text(path).filter(F.col("value").startswith(prefix))
    field = lambda start, size: F.trim(F.substring("value", start, size))
    return rows.select(field(1, 11).alias("station"), number(field(13, 8)).alias("lat"), number(field(22, 9)).alias("lon"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(station, lat, lon, elem, first_year, last_year) of a file in columns parted by spaces."""
    part = F.split(F.trim("value"), r"\s+")
    at = lambda k: F.get(part, F.lit(k))
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(at(0).alias("station"), number(at(1)).alias("lat"), number(at(2)).alias("lon"), at(3).alias("elem"), at(4).try_cast("int").alias("first_year"), at(5).try_cast("int").alias("last_year"))


def read_observations(spark: SparkSession, path: str, stations: DataFrame, elements: tuple[str, ...] = ("TMAX", "TMIN", "PRCP"), partitions: int | None = None) -> DataFrame:
    """(station, day, elem, value): wanted stations and elements that passed the quality check, in units.

    Yearly files are gzipped and so read by one task each; filters run in that task, and with
    `partitions` the rest is dealt out for what follows.
    """
    schema = "station string, date string, elem string, value double, mflag string, qflag string, sflag string, obstime string"
    raw = spark.read.schema(schema).csv(path).filter(F.col("elem").isin(*elements) & F.col("qflag").isNull())
    kept = raw.join(stations.select("station").distinct(), "station", "left_semi")
    out = kept.select("station", F.to_date("date", "yyyyMMdd").alias("day"), "elem", (F.col("value") / 10).alias("value"))
    return out.repartition(partitions, "station") if partitions else out


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of arrays whose first row is the header, as text columns."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("n", "row"))
    header = rows.filter("n = 0").select("row").first()[0]
    return rows.filter("n > 0").select(*(F.col("row")[k].alias(name) for k, name in enumerate(header)))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Files of such tables, one on each line and each with its header, as text columns; headers are the
    same.  A large table comes in many lines, since one of them is one task's."""
    rows = spark.read.text(path).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("n", "row"))
    header = rows.filter("n = 0").select("row").first()[0]
    return rows.filter("n > 0").select(*(F.col("row")[k].alias(name) for k, name in enumerate(header)))


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A warehouse table, the named columns only."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
