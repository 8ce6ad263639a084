"""The April-March fiscal calendar as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _label(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("_"), F.lpad(F.pmod(year + 1, F.lit(100)).cast("string"), 2, "0"))


def fy_start_year(date: Column) -> Column:
    return F.year(date) - F.when(F.month(date) < 4, 1).otherwise(0)


def fy_of(date: Column) -> Column:
    """Label YYYY_YY of the fiscal year that a date lies in."""
    return _label(fy_start_year(date))


def normalize_fy(label: Column) -> Column:
    """2025-26, 2025_26, 2025/26, fy_2025_26 and a bare 2025 become 2025_26; anything else is null."""
    year = F.regexp_extract(F.lower(F.trim(label)), r"^(?:fy[_-]?)?(\d{4})(?:[-_/](?:\d{2}|\d{4}))?$", 1)
    return F.when(year != "", _label(F.expr("1") * year.try_cast("int")))


def fy_start(label: Column) -> Column:
    """April 1 of a YYYY_YY label; null where the label has no year."""
    return F.to_date(F.concat(F.nullif(F.regexp_extract(label, r"^(\d{4})_\d{2}$", 1), F.lit("")), F.lit("-04-01")))


def fy_end(label: Column) -> Column:
    return F.date_sub(F.add_months(fy_start(label), 12), 1)


def fiscal_month(date: Column) -> Column:
    """0 for April to 11 for March."""
    return F.pmod(F.month(date) - 4, F.lit(12))


def fiscal_month_start(label: Column, month: Column) -> Column:
    """The first day of calendar month 1..12 inside a fiscal year; months wrap at December."""
    return F.add_months(fy_start(label), F.pmod(month - 4, F.lit(12)))


def fys_touched(start: Column, end: Column) -> Column:
    """Sorted labels of all fiscal years that an inclusive date range overlaps; reversed ranges give none."""
    first, last = fy_start_year(start), fy_start_year(end)
    return F.when(start <= end, F.transform(F.sequence(first, last), _label)).otherwise(F.array().cast("array<string>"))


def previous_month_start(date: Column) -> Column:
    return F.trunc(F.add_months(date, -1), "MM").cast("date")


def previous_month_end(date: Column) -> Column:
    return F.last_day(F.add_months(date, -1))


def days_inclusive(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def month_dimension(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row for each calendar month of an inclusive window: month_start, month_end."""
    months = F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month")))
    return df.withColumn("month_start", months).withColumn("month_start", F.col("month_start").cast("date")).withColumn("month_end", F.last_day("month_start"))


def with_fy(df: DataFrame, date: str, name: str = "fy") -> DataFrame:
    """Add the partition column of the fiscal-year layout."""
    return df.withColumn(name, fy_of(F.col(date)))


def fy_scan(df: DataFrame, fys: list[str], column: str = "fy") -> DataFrame:
    """Read only the named fiscal-year partitions of a table laid out by year; no names means every year."""
    return df.where(F.col(column).isin(fys)) if fys else df


def in_years(date: Column, fys: list[str]) -> Column:
    """Whether a stored date or timestamp lies in one of the years: ranges of the column itself, which a scan can push down and prune by.

    No names means every year; a label without a year matches nothing.
    """
    years = sorted({int(m[1]) for m in (re.match(r"(\d{4})_\d{2}$", fy) for fy in fys) if m})
    ranges = [(date >= F.lit(f"{y}-04-01").cast("timestamp")) & (date < F.lit(f"{y + 1}-04-01").cast("timestamp")) for y in years]
    return reduce(or_, ranges, F.lit(False)) if fys else F.lit(True)
