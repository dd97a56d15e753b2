"""Scalar expressions of the profiling and audit jobs, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names shown to users.
TYPE_NAMES = {"integer": "int", "long": "long", "double": "double", "decimal": "decimal", "float": "float", "string": "string", "boolean": "boolean"}
EARTH_DIAMETER_KM = 12742.0
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def string_length(c: Column) -> Column:
    """Length in characters; null counts as 0."""
    return F.coalesce(F.length(c), F.lit(0)).cast("bigint")


def audit_table(resource: Column, restype: Column) -> Column:
    """``db.table`` of a column or table resource, else null; a resource without a slash names no table."""
    parts = F.split(resource, "/")
    return F.when(restype.isin("@column", "@table") & (F.size(parts) > 1), F.array_join(F.slice(parts, 1, 2), "."))


def display_type(kind: T.DataType) -> str:
    return TYPE_NAMES.get(kind.typeName(), kind.simpleString())


def key_values(text: Column) -> Column:
    """``[k=v, k=v]`` as a map with trimmed keys."""
    pairs = F.str_to_map(F.regexp_replace(text, r"[\[\]]", ""), F.lit(","), F.lit("="))
    return F.transform_keys(pairs, lambda k, v: F.trim(k))


def table_size_and_rows(parameters: Column, statistics: Column) -> tuple[Column, Column]:
    """(totalSize, numRows) of ``[totalSize=…, numRows=…]``, else of the text ``… bytes, … rows``."""
    found = key_values(parameters)
    number = lambda name, pattern: F.coalesce(F.element_at(found, name).try_cast("bigint"), F.regexp_extract(statistics, pattern, 1).try_cast("bigint"))
    return number("totalSize", r"(\d+) bytes"), number("numRows", r"(\d+) rows")


def created_date(text: Column) -> Column:
    """Date of ``Mon Jan 02 03:04:05 UTC 2018``; 1970-01-01 where it can't be read."""
    parts = F.split(text, r"\s+")
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.get(parts, F.lit(1)))
    made = F.concat_ws("-", F.element_at(parts, -1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    return F.coalesce(F.when(F.size(parts) >= 4, made.try_cast("date")), F.lit("1970-01-01").cast("date"))


def qualified(cluster: str, *parts: Column) -> Column:
    """``db.table.column@cluster``."""
    return F.concat(F.concat_ws(".", *parts), F.lit("@" + cluster))


def split_qualified(name: Column) -> tuple[Column, Column, Column]:
    """(db, table, column) of ``db.table[.column]@cluster``; column is null where there is none."""
    parts = F.split(F.substring_index(name, "@", 1), r"\.")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))


def whole_match(value: Column, patterns: list[str]) -> Column:
    """Does any pattern match the whole value."""
    return value.cast("string").rlike(r"\A(?:" + "|".join(f"(?:{p})" for p in patterns) + r")\z")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = 0.5 - F.cos(F.radians(lat2 - lat1)) / 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (1 - F.cos(F.radians(lon2 - lon1))) / 2
    return F.when(half.isNotNull(), EARTH_DIAMETER_KM * F.asin(F.sqrt(F.least(F.greatest(half, F.lit(0.0)), F.lit(1.0)))))  # least and greatest pass over nulls


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def period_days(period: str) -> int:
    """Days that a period reaches back from its end date."""
    return {"daily": 1, "weekly": 7, "monthly": 30, "snapshot": 1}[period.lower()]


def period_dates(end: Column, period: str) -> Column:
    """Array of the days of a period, oldest first."""
    return F.sequence(F.date_sub(end, period_days(period) - 1), end)


def audit_end(end_millis: Column, same_day: Column, now: Column) -> Column:
    """The moment a job works up to: as given, else now for jobs of the same day, else a day before."""
    return F.coalesce(F.timestamp_millis(end_millis), F.when(same_day, now).otherwise(now - F.expr("INTERVAL 1 DAY")))
