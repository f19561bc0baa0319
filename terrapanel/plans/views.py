"""Places, days, events and measures derived from the star-schema tables, so that every operator runs on
them at any scale.  Each view has the same definition in SQL in registry.py."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.operators import spatial as G
from terrapanel.operators.ingest import with_calendar_columns
from terrapanel.plans import features as P
from terrapanel.plans.text import lexicon_score, sentiment_rollup
from terrapanel.sources.layout import bucketed, place_parts
from terrapanel.sources.shared import kept

#: Words that give the invented posts a score.
LIKED, DISLIKED = ("with", "from", "mit", "con", "avec"), ("stupid", "idiot", "scum", "not", "nicht")


class Views:
    """Lazy views over a folder of tables; `built` holds those that are already written."""

    def __init__(self, spark: SparkSession, sf_dir: str, built: dict[str, DataFrame] | None = None):
        self.spark, self.dir, self.built, self.parts, self.only_modelled = spark, sf_dir, built or {}, None, False

    def modelled(self) -> Views:
        """The same views, of which the model table has only the rows that models are made of."""
        some = Views(self.spark, self.dir, self.built)
        some.parts, some.only_modelled = self.parts, True
        return some

    def of_lines(self, condition: Column) -> Views:
        """The views as they are with only the lines for which condition holds."""
        some = Views(self.spark, self.dir)
        some.lines = self.lines.filter(condition)
        return some

    def rebuilt(self) -> Views:
        """The same views over the facts of the lines, written in one scan of them in buckets of places, and the
        calendar that follows from the facts; every feature reads these, and stays dealt by place."""
        parts = place_parts(self.spark)
        facts = bucketed(self.facts, "facts", "place", parts, ["place", "day"])
        days = kept(Views(self.spark, self.dir, {"facts": facts}).days, "days")
        built = Views(self.spark, self.dir, {"facts": facts, "days": days})
        built.parts = parts
        return built

    @cached_property
    def facts(self) -> DataFrame:
        """Each place's lines of a day and status, with what every daily fact needs of them."""
        if "facts" in self.built:
            return self.built["facts"]
        heavy, wild = F.col("l_quantity") >= 45, (F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 45)
        early = (F.col("l_returnflag") == "N") & (F.col("day") < F.lit("2001-01-01").cast("date"))
        return self.lines.groupBy("place", "day", F.col("l_linestatus").alias("flock_type")).agg(
            F.count_if(heavy).alias("n_heavy"), F.bool_or(heavy & (F.col("l_returnflag") == "R")).alias("confirmed"), F.sum(F.when(heavy, F.col("l_quantity"))).cast("long").alias("birds"),
            F.count_if(wild).alias("n_wild"), F.collect_set(F.when(wild, F.col("l_partkey"))).alias("species"), F.count_if(early).alias("n_band"),
            F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.sum(F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax"))).alias("rain"),
        )

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        return self.table("lineitem").withColumn("day", F.to_date("l_shipdate")).withColumnRenamed("l_suppkey", "place")

    @cached_property
    def places(self) -> DataFrame:
        k = F.col("s_suppkey")
        named = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are fewer than 256
        return named.select(
            k.alias("place"), F.col("n_name").alias("state"), F.col("s_name").alias("name"), (F.lit(25.0) + (k * 7919 % 2400).cast("double") / 100.0).alias("lat"), (F.lit(-124.0) + (k * 104729 % 5700).cast("double") / 100.0).alias("lon"),
            F.when(k % 17 != 0, 1000 + k * 37 % 90000).alias("population"), F.when(k % 13 == 0, F.lit(0.0)).otherwise((50 + k % 400).cast("double")).alias("land_area_sqmi"), (k % 11 != 0).alias("is_conus"),
        )

    @cached_property
    def days(self) -> DataFrame:
        if "days" in self.built:
            return self.built["days"]
        span = self.built.get("facts", self.lines).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
        return span.select(F.explode(F.sequence("lo", "hi")).alias("day"))

    @cached_property
    def calendar(self) -> DataFrame:
        return with_calendar_columns(self.days)

    @cached_property
    def adjacency(self) -> DataFrame:
        k = self.table("supplier").select(F.col("s_suppkey").alias("place"))
        near = k.select("place", F.explode(F.array(*(F.col("place") + i for i in (-3, -2, -1, 1, 2, 3)))).alias("neighbour"))
        return near.join(k.select(F.col("place").alias("neighbour")), "neighbour", "left_semi").select("place", "neighbour")

    @cached_property
    def outbreak(self) -> DataFrame:
        if "facts" in self.built:
            return self.facts.filter("n_heavy > 0").select("place", "day", "flock_type", "confirmed", "birds")
        rows = self.lines.filter("l_quantity >= 45")
        return rows.groupBy("place", "day", F.col("l_linestatus").alias("flock_type")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("confirmed"), F.sum("l_quantity").cast("long").alias("birds"))

    @cached_property
    def wild(self) -> DataFrame:
        if "facts" in self.built:
            found = self.facts.filter("n_wild > 0").groupBy("place", "day").agg(F.sum("n_wild").alias("detection_count"), F.flatten(F.collect_list("species")).alias("species"))
            return found.select("place", "day", "detection_count", F.size(F.array_distinct("species")).cast("long").alias("n_species"))
        rows = self.lines.filter("l_returnflag = 'A' and l_quantity >= 45")
        return rows.groupBy("place", "day").agg(F.count(F.lit(1)).alias("detection_count"), F.count_distinct("l_partkey").alias("n_species"))

    @cached_property
    def band(self) -> DataFrame:
        if "facts" in self.built:
            return self.facts.filter("n_band > 0").groupBy("place", "day").agg(F.sum("n_band").alias("band_count"))
        rows = self.lines.filter((F.col("l_returnflag") == "N") & (F.col("day") < F.lit("2001-01-01").cast("date")))
        return rows.groupBy("place", "day").agg(F.count(F.lit(1)).alias("band_count"))

    @cached_property
    def weather(self) -> DataFrame:
        if "facts" in self.built:
            return self.facts.groupBy("place", "day").agg((F.min("low") / 1000).alias("temp_min_c"), (F.max("high") / 1000).alias("temp_max_c"), F.sum("rain").alias("precip_mm"))
        rain = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax"))
        return self.lines.groupBy("place", "day").agg((F.min("l_extendedprice") / 1000).alias("temp_min_c"), (F.max("l_extendedprice") / 1000).alias("temp_max_c"), F.sum(rain).alias("precip_mm"))

    @cached_property
    def axis(self) -> DataFrame:
        """Flyways by the region of a place's nation; the names of states are not those of a map."""
        k = F.col("place")
        coded = self.places.filter("is_conus").select("place", "lat", "lon", F.element_at(F.array(*map(F.lit, ("PA", "OH", "TX", "CA", "ZZ"))), (k % 5 + 1).cast("int")).alias("state"))
        return G.migration_axis(coded)

    @cached_property
    def pairs(self) -> DataFrame:
        return G.proximity(self.places.filter("is_conus"), 400.0)

    @cached_property
    def census(self) -> DataFrame:
        k, zero = F.col("place"), F.lit(0.0)
        operations = {c: (k % m).cast("long") for c, m in zip(P.EXPOSURE_COUNTS, (9, 7, 5, 4, 3), strict=True)}
        pairs = zip(P.EXPOSURE_MEASURES, ("layer_operations", "broiler_operations", "turkey_operations", "duck_operations", "poultry_operations"), strict=True)
        measures = {m: F.when(operations[o] == 0, zero).when(k % 6 != 0, (operations[o] * 1000 + k).cast("double")) for m, o in pairs}
        return self.places.filter("place % 10 <> 3").select("place", F.lit(2022).alias("census_year"), *(c.alias(n) for n, c in (operations | measures).items()))

    @cached_property
    def posts(self) -> DataFrame:
        one = self.table("supplier").agg(F.count(F.lit(1)).alias("n")).crossJoin(self.days.agg(F.min("day").alias("first_day")))
        docs = self.table("documents").select("doc_id", "text", "lang").crossJoin(F.broadcast(one))  # one row
        return docs.select("doc_id", "text", "lang", F.pmod("doc_id", "n").alias("place"), F.date_add("first_day", (F.col("doc_id") % 365).cast("int")).alias("day"))

    @cached_property
    def sentiment(self) -> DataFrame:
        return sentiment_rollup(self.posts.withColumn("score", lexicon_score(F.col("text"), LIKED, DISLIKED)))

    @cached_property
    def stations(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(k.alias("station"), (F.lit(25.0) + (k * 6131 % 2400).cast("double") / 100.0).alias("lat"), (F.lit(-124.0) + (k * 86311 % 5700).cast("double") / 100.0).alias("lon"))

    @cached_property
    def observations(self) -> DataFrame:
        element = F.element_at(F.array(F.lit("TMAX"), F.lit("TMIN"), F.lit("PRCP")), (F.col("o_orderkey") % 3 + 1).cast("int"))
        rows = self.table("orders").filter("o_orderpriority <> '1-URGENT'")
        return rows.select(F.col("o_custkey").alias("station"), F.to_date("o_orderdate").alias("day"), element.alias("elem"), (F.col("o_totalprice") / 10).alias("value"))

    @cached_property
    def pressure(self) -> DataFrame:
        return P.site_pressure(self.places.filter("is_conus"), self.axis, self.wild, calendar=self.days, parts=self.parts or place_parts(self.spark))

    @cached_property
    def daily_counts(self) -> DataFrame:
        if "facts" not in self.built:
            return P.daily_counts(self.outbreak, self.wild, self.band)
        confirmed = F.count_if((F.col("n_heavy") > 0) & F.col("confirmed"))
        return self.facts.groupBy("place", "day").agg(confirmed.alias("outbreaks"), F.sum("n_wild").alias("wild"), F.sum("n_band").alias("band")).filter("outbreaks > 0 or wild > 0 or band > 0")

    @cached_property
    def spatial_lag(self) -> DataFrame:
        return P.spatial_lag(self.adjacency, self.daily_counts, self.days, parts=self.parts or place_parts(self.spark))

    @cached_property
    def weather_lag(self) -> DataFrame:
        return P.weather_lag(self.weather)

    @cached_property
    def county_day(self) -> DataFrame:
        """The model table by windows over the grid; model_columns() makes the same of lists."""
        v = self if self.parts else self.rebuilt()
        return P.dense_county_day(v.places, v.calendar, v.adjacency, v.outbreak, v.weather, v.wild, v.band, v.axis, None, v.census, v.sentiment.drop("lang_breakdown"), v.parts, observed=v.observed)

    def modelled_weather(self) -> DataFrame:
        """The modelled rows of the model table that have weather, (place, day, the weather of seven days), straight from the facts."""
        last = self.observed.select(F.date_sub("max_day", 7).alias("_last"))
        rows = self.weather_lag.join(self.places.filter("is_conus").select("place"), "place", "left_semi")
        return rows.crossJoin(F.broadcast(last)).filter("day <= _last").drop("_last")  # one row

    @cached_property
    def observed(self) -> DataFrame:
        """features.observed_days() and the first day of any fact, by one look at the lines or what is made of them."""
        early = F.col("n_band") > 0 if "facts" in self.built else (F.col("l_returnflag") == "N") & (F.col("day") < F.lit("2001-01-01").cast("date"))
        rows = self.facts if "facts" in self.built else self.lines
        return kept(rows.agg(F.max("day").alias("max_day"), F.max(F.when(early, F.col("day"))).alias("band_max_day"), F.min("day").alias("min_day")), "observed")

    def model_columns(self, *columns: str, digits: int | None = None) -> DataFrame:
        """The model table, or the named columns of it.  It is made of facts in buckets of places; where outbreaks
        are all that the columns need, straight from the few lines that tell of these."""
        v = self
        if not self.parts and columns and P.of_outbreaks_alone(columns):
            v = Views(self.spark, self.dir, {"days": self.observed.select(F.explode(F.sequence("min_day", "max_day")).alias("day"))})
            v.lines, v.observed = self.lines, self.observed
        elif not self.parts:
            v = self.rebuilt()
        return P.listed_county_day(v.places, v.calendar, v.adjacency, v.outbreak, v.weather, v.wild, v.band, v.axis, v.census, v.sentiment.drop("lang_breakdown"), columns=columns, observed=v.observed, digits=digits, modelled=self.only_modelled)

    @cached_property
    def long_values(self) -> DataFrame:
        """Published figures as text: withheld where a group has fewer than three rows."""
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("measure"))
        sums = self.lines.join(parts, "l_partkey").groupBy("place", "measure").agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"))
        text = F.when(F.col("n") < 3, "(D)").when(F.col("q") % 50 == 0, "(Z)").otherwise(F.concat(F.lit(" "), F.format_number("q", 0), F.lit(" ")))
        return sums.select("place", "measure", "n", text.alias("value"))

    @cached_property
    def named_rows(self) -> DataFrame:
        """Names as sources write them."""
        k = F.col("s_suppkey")
        state = F.element_at(F.array(*map(F.lit, ("Virginia", " missouri ", "Nevada", "Guam"))), (k % 4 + 1).cast("int"))
        base = F.concat(F.lit("Saint "), F.lit("O'Place-"), (k / 2).cast("long").cast("string"))
        kind = F.element_at(F.array(*map(F.lit, (" County", " City", "", " Parish", "."))), (k % 5 + 1).cast("int"))
        return self.table("supplier").select(k.alias("row_id"), state.alias("state_name"), F.concat(base, kind).alias("place_name"))

    @cached_property
    def master(self) -> DataFrame:
        k = F.col("s_suppkey")
        state = F.element_at(F.array(*map(F.lit, ("VA", "MO", "NV"))), (k % 3 + 1).cast("int"))
        kind = F.when(k % 2 == 0, " County").otherwise(" city")
        return self.table("supplier").select(F.lpad(k.cast("string"), 8, "0").alias("place"), state.alias("state"), F.concat(F.lit("St. OPlace "), (k / 2).cast("long").cast("string"), kind).alias("name"))
