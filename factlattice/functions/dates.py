"""Dates that arrive as text: coercion, the day a question is asked about, and years read from order numbers."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of dates in the tables (fixed values), tried in this order.
FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss")


def parsed(text: Column, formats: Sequence[str] = FORMATS) -> Column:
    """The date in a text; NULL if no format fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in formats))


def run_day(day: str | None = None) -> str:
    """The day of a run as yyyy-MM-dd: as given, or today."""
    return day or datetime.date.today().isoformat()


def days_of(joined: Column) -> Column:
    """The days in a ;-joined list, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ";"), lambda d: F.trim(d)), lambda d: d != "")


def newest_day(df: DataFrame, joined: str) -> str | None:
    """The last day that any row's ;-joined list names (days as text sort as days)."""
    return df.select(F.array_max(days_of(F.col(joined))).alias("d")).agg(F.max("d")).first()[0]


def held_on(joined: Column, day: str | Column) -> Column:
    """Whether the ;-joined list names the day."""
    return F.array_contains(days_of(joined), day)


def adoption_year(order: Column) -> Column:
    """The year in an order number: without a region's prefix the first 19xx or 20xx, else two leading
    digits (90 and later are 19xx), else 0."""
    text = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(order, F.lit("")), r"(?U)\s+", "")), r"^R\d{1,2}[A-Z]?-?", "")
    four = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    two = F.regexp_extract(text, r"^(?:\d-)?(\d{2})(?:\D|$)", 1).try_cast("int")
    return F.when(four != "", four.try_cast("int")).when(two >= 90, two + 1900).when(two.isNotNull(), two + 2000).otherwise(0)
