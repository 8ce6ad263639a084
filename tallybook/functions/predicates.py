"""Predicates with the null and text semantics of the reports."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are there."""
    return reduce(and_, (c for c in conditions if c is not None), F.lit(True))


def any_of(conditions: list[Column | None]) -> Column:
    """Disjunction; nothing selected means no row."""
    return reduce(or_, (c for c in conditions if c is not None), F.lit(False))


def optional_filters(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Equality or IN for every column whose wanted value is set; None and "" are not filters, [] matches nothing."""
    found = []
    for column, value in wanted.items():
        if value is None or value == "":
            continue
        found.append(in_list(F.col(column), list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df.where(all_of(found))


def in_list(column: Column, values: list) -> Column:
    return column.isin(values) if values else F.lit(False)


def excluding(column: Column, *values: object) -> Column:
    """Everything but the values; rows with null stay."""
    return ~F.coalesce(column.isin(list(values)), F.lit(False))


def iexact(column: Column, text: str | Column) -> Column:
    return F.lower(column) == F.lower(text if isinstance(text, Column) else F.lit(text))


def icontains(column: Column, text: str | Column) -> Column:
    """Literal, case-insensitive: % and _ have no meaning."""
    return F.contains(F.lower(column), F.lower(text if isinstance(text, Column) else F.lit(text)))


def iendswith(column: Column, text: str | Column) -> Column:
    return F.endswith(F.lower(column), F.lower(text if isinstance(text, Column) else F.lit(text)))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns that exist contains the text; an empty text keeps all."""
    if not text.strip():
        return df
    return df.where(any_of([F.coalesce(icontains(F.col(c).cast("string"), text.strip()), F.lit(False)) for c in columns if c in df.columns]))


def row_text_matches(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Search in what a reader sees of a row: tags stripped, cells joined by a blank."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "<[^>]*>", "") for c in columns]
    return df.where(icontains(F.concat_ws(" ", *cells), text)) if text else df


def contained(start: Column, end: Column, low: object, high: object) -> Column:
    return (start >= F.lit(low)) & (end <= F.lit(high))


def overlapping(start: Column, end: Column, low: object, high: object) -> Column:
    """Inclusive ranges that share a day."""
    return (start <= F.lit(high)) & (end >= F.lit(low))


def on_days(timestamp: Column, first: str, last: str) -> Column:
    """Half-open: from the first day's midnight to before the midnight after the last day."""
    return (timestamp >= F.lit(first).cast("timestamp")) & (timestamp < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"))


def to_end_of_day(timestamp: Column, first: str, last: str) -> Column:
    """Closed window up to the last microsecond of the last day."""
    end = F.date_add(F.lit(last).cast("date"), 1).cast("timestamp") - F.expr("interval 1 microsecond")
    return (timestamp >= F.lit(first).cast("timestamp")) & (timestamp <= end)


def done(done_date: Column) -> Column:
    return done_date.isNotNull()


def pending(done_date: Column, status: Column) -> Column:
    """Not done and not on hold; a null status is not on hold."""
    return done_date.isNull() & excluding(status, "Hold")


def active_on(out_date: Column, today: object) -> Column:
    return out_date.isNull() | (out_date >= F.lit(today))


def member(array: Column, text: str) -> Column:
    """Case-insensitive membership in a text array."""
    return F.coalesce(F.array_contains(F.transform(array, F.lower), text.lower()), F.lit(False))


def numeric_filter(column: Column, spec: str) -> Column:
    """`5-8`, `>=n`, `<=n`, `>n`, `<n` or `n`; a value that is no number never matches, an empty spec always does."""
    spec = spec.strip()
    if not spec:
        return F.lit(True)
    value = column.cast("string").try_cast("double")
    number = r"(-?\d+(?:\.\d+)?)"
    if m := re.fullmatch(rf"{number}\s*-\s*{number}", spec):
        test = value.between(float(m[1]), float(m[2]))
    elif m := re.fullmatch(rf"(>=|<=|>|<|=?)\s*{number}", spec):
        n = float(m[2])
        test = {">=": value >= n, "<=": value <= n, ">": value > n, "<": value < n, "": value == n, "=": value == n}[m[1]]
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def blacklisted(texts: list[Column], words: list[str], numbers: list[str]) -> Column:
    """Any word in the lower-cased texts, or any number in them once all but letters and digits is gone."""
    joined = F.lower(F.concat_ws(" ", *texts))
    bare = F.regexp_replace(joined, "[^a-z0-9]+", "")
    return any_of([F.contains(joined, F.lit(w.lower())) for w in words] + [F.contains(bare, F.lit(n)) for n in numbers])
