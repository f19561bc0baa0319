"""Parsing, calendar and feature expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: State names and their postal codes.
STATE_CODES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "dc": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO",
    "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ",
    "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH",
    "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}

#: Words that close a place name, longest first; `city` alone only in the full form.
PLACE_TYPES = ("city and borough", "census area", "municipality", "municipio", "county", "parish", "borough")


def literal_map(values: Mapping[str, str], key: Column) -> Column:
    """values[key], null for other keys."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")


def name_base(name: Column) -> Column:
    """A place name in lower case without dots, apostrophes and hyphens, `saint` as `st`, single spaces."""
    plain = F.translate(F.lower(F.trim(name)), "-.'", " ")
    return F.trim(F.regexp_replace(F.replace(plain, F.lit("saint "), F.lit("st ")), r"\s+", " "))


def name_key(name: Column, drop_city: bool) -> Column:
    """name_base() without its type word and spaces; `city` counts as a type word only with drop_city."""
    types = (*PLACE_TYPES, "city") if drop_city else PLACE_TYPES
    return F.replace(F.regexp_replace(name_base(name), rf"\s+({'|'.join(types)})$", ""), F.lit(" "), F.lit(""))


def state_code(name: Column) -> Column:
    """The postal code of a state name, null if unknown."""
    return literal_map(STATE_CODES, F.lower(F.trim(name)))


def census_value(text: Column) -> Column:
    """A published figure: commas dropped, (D), (NA), (X) withheld or absent: null, (Z) zero."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain == "(Z)", F.lit(0.0)).otherwise(number(plain))


def number(text: Column) -> Column:
    """A finite double, null where the text is none."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value), value)


def zero_padded(text: Column, width: int) -> Column:
    """text with zeros in front up to width; a longer text stays whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def day_of(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd")) -> Column:
    """The date by the first format that fits, null if none does."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats))


def day_from_parts(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers or number texts, null where there is none."""
    y, m, d = (F.trim(x.cast("string")).try_cast("double").try_cast("int") for x in (year, month, day))
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")


def season(month: Column) -> Column:
    """Meteorological season."""
    return F.when(month.isin(12, 1, 2), "winter").when(month <= 5, "spring").when(month <= 8, "summer").otherwise("fall")


def year_wave(day_of_year: Column) -> tuple[Column, Column]:
    """Sine and cosine of the place in the year."""
    angle = 2 * F.pi() * day_of_year / 365.25
    return F.sin(angle), F.cos(angle)


def log_count(value: Column) -> Column:
    """log(1 + x) with negatives taken as 0; null stays null."""
    return F.when(value.isNotNull(), F.log1p(F.greatest(value.cast("double"), F.lit(0.0))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the latter is positive, else null."""
    return F.when(denominator > 0, numerator / denominator)


def rounded(value: Column, digits: int) -> Column:
    """A double to so many digits, halves away from zero, by arithmetic on doubles as SQL engines do it; what is too large
    to have such digits, and NaN, stays."""
    scale = 10.0**digits
    whole = F.floor(F.abs(value) * scale + 0.5) / scale
    return F.when(F.abs(value) < 9e15 / scale, F.when(value < 0, -whole).otherwise(whole)).otherwise(value)
