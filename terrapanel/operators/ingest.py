"""Raw snapshots to conformed tables of one row per place and day."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.functions import scalar as S
from terrapanel.operators.crosswalk import resolve_names
from terrapanel.operators.joins import densify, first_by, pivot_mean, symmetric_pairs
from terrapanel.operators.quality import require_empty, vintage_flags
from terrapanel.operators.spatial import snap
from terrapanel.operators.windows import fill_forward
from terrapanel.sources.upsert import update_existing, with_constant

#: Place codes that were renamed or merged, and a split that has no successor.
CODE_CHANGES = {"02270": "02158", "46113": "46102", "51515": "51019"}
CODES_SPLIT = ("02261",)
#: Published measures and their columns.
CENSUS_MEASURES = {
    "POULTRY TOTALS - OPERATIONS WITH INVENTORY": "poultry_operations",
    "CHICKENS, LAYERS - OPERATIONS WITH INVENTORY": "layer_operations",
    "CHICKENS, LAYERS - INVENTORY": "layer_inventory",
    "CHICKENS, BROILERS - OPERATIONS WITH SALES": "broiler_operations",
    "CHICKENS, BROILERS - SALES, MEASURED IN HEAD": "broiler_sales_head",
    "TURKEYS - OPERATIONS WITH INVENTORY": "turkey_operations",
    "TURKEYS - INVENTORY": "turkey_inventory",
    "DUCKS - OPERATIONS WITH INVENTORY": "duck_operations",
    "DUCKS - INVENTORY": "duck_inventory",
    "POULTRY TOTALS, INCL EGGS - SALES, MEASURED IN $": "poultry_sales_usd",
}
#: The operations that tell whether a missing measure is zero or withheld.
GOVERNED_BY = {
    "layer_inventory": "layer_operations",
    "broiler_sales_head": "broiler_operations",
    "turkey_inventory": "turkey_operations",
    "duck_inventory": "duck_operations",
    "poultry_sales_usd": "poultry_operations",
}
#: Banded species, and precision codes that are too coarse.
BANDED_SPECIES = ("1320", "1720", "1440", "1723", "1400", "1390", "1430", "1690", "0700")
COARSE_PRECISION = ("12.0", "72.0")


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday is 0) of a month; n = -1: the last."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n > 0:
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(first)
    return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))


def federal_holiday(day: Column) -> Column:
    """Whether a date is a federal holiday of the United States, or the weekday on which one that falls
    on a weekend is observed."""
    fixed = [(1, 1), (7, 4), (11, 11), (12, 25)]
    year = F.year(day)
    is_fixed = lambda d: F.lit(False)
    on = lambda d: [((F.month(d) == m) & (F.dayofmonth(d) == n)) for m, n in fixed] + [(F.month(d) == 6) & (F.dayofmonth(d) == 19) & (F.year(d) >= 2021)]

    def any_of(parts: list[Column]) -> Column:
        out = is_fixed(day)
        for p in parts:
            out = out | p
        return out

    moving = [day == _nth(year, 1, 0, 3), day == _nth(year, 2, 0, 3), day == _nth(year, 5, 0, -1), day == _nth(year, 9, 0, 1), day == _nth(year, 10, 0, 2), day == _nth(year, 11, 3, 4)]
    observed = (F.weekday(day) == 0) & any_of(on(F.date_sub(day, 1))) | (F.weekday(day) == 4) & any_of(on(F.date_add(day, 1)))
    return any_of([*on(day), *moving]) | observed


def calendar(spark: SparkSession, first: date | str, last: date | str) -> DataFrame:
    """One row for each day of [first, last] with its calendar columns."""
    span = spark.range(1).select(F.explode(F.sequence(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).alias("day"))
    return with_calendar_columns(span)


def with_calendar_columns(days: DataFrame) -> DataFrame:
    d = F.col("day")
    return days.select("day", F.year(d).alias("year"), F.month(d).alias("month"), F.weekofyear(d).alias("iso_week"), F.dayofyear(d).alias("day_of_year"), S.season(F.month(d)).alias("season"), federal_holiday(d).alias("is_us_holiday"))


def in_states(code: Column) -> Column:
    """Whether a five-digit place code lies in a state or the capital district."""
    return F.substring(code, 1, 2).try_cast("int") < 60


#: Prefixes of the states that lie apart from the others.
APART = ("02", "15")


def is_contiguous(code: Column, lat: Column, lon: Column) -> Column:
    """Whether a place lies in the contiguous states: by its code, and with a known centroid."""
    return F.coalesce(in_states(code) & ~F.substring(code, 1, 2).isin(*APART), F.lit(False)) & lat.isNotNull() & lon.isNotNull()


def county_dimension(raw: DataFrame) -> DataFrame:
    """(place, state, name, lat, lon, land_area_sqmi, is_conus) from a gazetteer; territories go."""
    place = S.zero_padded(F.trim("GEOID"), 5)
    out = raw.select(place.alias("place"), F.trim("USPS").alias("state"), F.trim("NAME").alias("name"), S.number(F.col("INTPTLAT")).alias("lat"), S.number(F.col("INTPTLONG")).alias("lon"), S.number(F.col("ALAND_SQMI")).alias("land_area_sqmi"))
    return out.filter(in_states(F.col("place"))).withColumn("is_conus", is_contiguous(F.col("place"), F.col("lat"), F.col("lon")))


def population(raw: DataFrame) -> DataFrame:
    """(place, population) from (P1_001N, state, county)."""
    return raw.select(F.concat(S.zero_padded(F.col("state"), 2), S.zero_padded(F.col("county"), 3)).alias("place"), F.col("P1_001N").try_cast("long").alias("population"))


def backfill_population(places: DataFrame, raw: DataFrame, required: Sequence[str] = (), forbidden: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(places with population where the source has it, one row of how many are populated and null).  The
    source must have the required place keys and none of the forbidden ones, which tell its vintage."""
    source = population(raw)
    flags = vintage_flags(source, "place", required, forbidden)
    require_empty(flags.filter("not (required_present and forbidden_absent)"), "population of another vintage")
    filled = update_existing(places, source.dropDuplicates(["place"]), ["place"], ["population"])
    return filled, filled.agg(F.count("population").alias("n_populated"), F.count_if(F.col("population").isNull()).alias("n_null"))


def adjacency(lines: DataFrame, remap: Mapping[str, str] = CODE_CHANGES, split: Sequence[str] = CODES_SPLIT) -> DataFrame:
    """Distinct (place, neighbour) from read_adjacency(): the place of a block stands on its first line."""
    filled = fill_forward(lines, "place", "line", ["path"])
    padded = filled.select(S.zero_padded(F.col("place"), 5).alias("place"), S.zero_padded(F.col("neighbour"), 5).alias("neighbour"))
    return symmetric_pairs(padded, remap, split, in_states)


def _resolved(rows: DataFrame, state: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a place, rejects): the rejects are counted by the names that no place has."""
    lost = rows.filter("place is null").groupBy(F.col(state).alias("state_name"), F.col(name).alias("place_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.filter("place is not null"), lost


def outbreaks(raw: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((place, day, flock_type, birds, confirmed), rejects) of poultry detections; rejects (state_name,
    place_name, n_rows) are the names that resolve to no place.  The birds of a key are null where all are."""
    rows, rejects = _resolved(resolve_names(raw, master, "State", "County Name"), "State", "County Name")
    kind = F.coalesce(F.nullif(F.trim("Production"), F.lit("")), F.lit("unknown"))
    rows = rows.select("place", S.day_of(F.col("Confirmed Diagnosis")).alias("day"), kind.alias("flock_type"), S.number(F.replace("Affected", F.lit(","), F.lit(""))).cast("long").alias("birds"))
    found = rows.dropna(subset=["day"]).groupBy("place", "day", "flock_type").agg(F.sum("birds").alias("birds"))
    return with_constant(found, "confirmed", True), rejects


def wild_detections(raw: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((place, day, detection_count, n_species), rejects): the day of collection, else of detection."""
    rows, rejects = _resolved(resolve_names(raw, master, "State", "County"), "State", "County")
    day = F.coalesce(S.day_of(F.col("Collection Date")), S.day_of(F.col("Date Detected")))
    rows = rows.select("place", day.alias("day"), F.col("Bird Species").alias("species")).dropna(subset=["day"])
    return rows.groupBy("place", "day").agg(F.count(F.lit(1)).alias("detection_count"), F.count_distinct("species").alias("n_species")), rejects


def complete_stations(stations: DataFrame, inventory: DataFrame, elements: Sequence[str] = ("TMAX", "TMIN", "PRCP"), first: int = 2020, last: int = 2026) -> DataFrame:
    """Stations that report every element within the years."""
    good = inventory.filter(F.col("elem").isin(*elements) & (F.col("last_year") >= first) & (F.col("first_year") <= last))
    keep = good.groupBy("station").agg(F.count_distinct("elem").alias("n")).filter(F.col("n") == len(elements))
    return stations.join(keep.select("station"), "station", "left_semi")


def place_day_weather(observations: DataFrame, near: DataFrame) -> DataFrame:
    """(place, day, temp_min_c, temp_max_c, precip_mm): temperatures as a pair of the nearest station that
    has both, precipitation of the nearest that has it.  near: (place, station, rank)."""
    merged = observations.join(near, "station")
    keys = ["place", "day"]
    pairs = pivot_mean(merged.filter(F.col("elem").isin("TMIN", "TMAX")), [*keys, "rank"], "elem", "value", {"TMIN": "temp_min_c", "TMAX": "temp_max_c"}, ["TMIN", "TMAX"])
    temperature = pairs.groupBy(*keys).agg(F.min_by(F.struct("temp_min_c", "temp_max_c"), "rank").alias("t")).select(*keys, "t.*")
    rain = merged.filter(F.col("elem") == "PRCP").groupBy(*keys).agg(F.min_by("value", F.struct("rank", "value")).alias("precip_mm"))
    return temperature.join(rain, keys, "full")


def band_density(raw: DataFrame, places: DataFrame, species: Sequence[str] = BANDED_SPECIES, coarse: Sequence[str] = COARSE_PRECISION, first_year: int = 2020) -> DataFrame:
    """(place, day, band_count): bandings by the nearest place of their coordinates.  A missing precision
    code is kept."""
    year = S.number(F.col("event_year"))
    kept = raw.filter((F.col("iso_country") == "US") & (F.col("event_type") == "B") & F.col("species_id").isin(*species) & (year >= first_year) & ~F.coalesce(F.col("coordinates_precision_code").isin(*coarse), F.lit(False)))
    rows = kept.select(S.number(F.col("lat_dd")).alias("lat"), S.number(F.col("lon_dd")).alias("lon"), S.day_from_parts(F.col("event_year"), F.col("event_month"), F.col("event_day")).alias("day")).dropna()
    at = snap(rows, places)
    return rows.join(at, ["lat", "lon"]).groupBy("place", "day").agg(F.count(F.lit(1)).alias("band_count"))


def census_wide(rows: DataFrame, master: DataFrame, measures: Mapping[str, str], governed_by: Mapping[str, str]) -> DataFrame:
    """One row for each place of the master from (place, measure, value): operations without a row are 0;
    a measure is 0 where its operations are, and null where it is withheld."""
    known = rows.filter(F.col("measure").isin(*measures)).join(master.select("place"), "place", "left_semi")
    wide = known.groupBy("place").pivot("measure", list(measures)).agg(F.min("value"))
    wide = densify(master, wide.select("place", *(F.col(f"`{k}`").alias(v) for k, v in measures.items())), "place")
    operations = sorted(set(governed_by.values()))
    filled = {c: F.coalesce(c, F.lit(0.0)) for c in operations}
    magnitude = {m: F.when(F.col(m).isNull() & (filled[o] == 0), 0.0).otherwise(F.col(m)) for m, o in governed_by.items()}
    return wide.select("place", *((filled | magnitude).get(c, F.col(c)).alias(c) for c in measures.values()))


def poultry_exposure(raw: DataFrame, master: DataFrame, year: int = 2022) -> tuple[DataFrame, DataFrame]:
    """(exposure by place, keys that the master lacks) from census rows; only totals count.  Of several
    values of a place and measure the least counts."""
    place = F.concat(S.zero_padded(F.col("STATE_FIPS_CODE"), 2), S.zero_padded(F.col("COUNTY_CODE"), 3))
    totals = raw.filter((F.col("DOMAIN_DESC") == "TOTAL") & F.col("SHORT_DESC").isin(*CENSUS_MEASURES))
    rows = totals.select(place.alias("place"), F.col("SHORT_DESC").alias("measure"), S.census_value(F.col("VALUE")).alias("value"))
    orphans = rows.select("place").distinct().join(master.select("place"), "place", "left_anti")
    return census_wide(rows, master, CENSUS_MEASURES, GOVERNED_BY).withColumn("census_year", F.lit(year)), orphans


def nearest_reporting(observations: DataFrame, near: DataFrame, value: str) -> DataFrame:
    """(place, day, value, rank): the value of the nearest station that reported that day."""
    return first_by(observations.join(near, "station").filter(F.col(value).isNotNull()), ["place", "day"], ["rank", value]).select("place", "day", value, "rank")
