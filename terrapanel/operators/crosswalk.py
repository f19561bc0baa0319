"""State and place names to place keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.functions.scalar import literal_map, name_key, state_code

#: Names that no rule reaches, by state and key.
OVERRIDES = {"PA|huntington": "42061", "LA|jeffersondavispari": "22053", "AK|valdezcordova": "02063"}


def resolve_names(rows: DataFrame, master: DataFrame, state: str, name: str, into: str = "place", overrides: dict[str, str] | None = None) -> DataFrame:
    """rows with column `into`: the key of the master's (place, state, name) that a state name and a place
    name mean, null if none.

    Names are compared without type words (see name_key); a source name is tried with and without
    `city` as one.  An override goes first; of several hits the least key counts, which is the county
    where a city has the same name.  A row is looked up twice and never repeated.
    """
    overrides = OVERRIDES if overrides is None else overrides
    code = state_code(F.col(state))
    keyed = rows.withColumn("_code", code).withColumn("_full", name_key(F.col(name), True)).withColumn("_plain", name_key(F.col(name), False))
    index = master.groupBy(F.col("state").alias("_code"), name_key(F.col("name"), True).alias("_key")).agg(F.min("place").alias("_hit"))
    full = index.toDF("_code", "_full", "_hit_full")
    plain = index.toDF("_code", "_plain", "_hit_plain")
    joined = keyed.join(full, ["_code", "_full"], "left").join(plain, ["_code", "_plain"], "left")
    fixed = F.coalesce(*(literal_map(overrides, F.concat_ws("|", "_code", c)) for c in ("_full", "_plain"))) if overrides else F.lit(None).cast("string")
    found = F.coalesce(fixed, F.least("_hit_full", "_hit_plain"))
    return joined.select(*rows.columns, F.when(F.col("_code").isNotNull(), found).alias(into))
