from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import fiscal, predicates, scalars


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'date' if isinstance(v, date) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, value", [("1,23,456.78", "123456.78"), ("(12.00)", "-12.00"), ("-", "0"), ("12.50 Dr", "-12.50"), ("12.50 Cr", "12.50"), ("Rs. 5", "5"), ("INR 1 000", "1000"), ("-7.25", "-7.25"), ("x", None), ("", None), (None, None)])
def test_money(spark, text, value):
    assert one(spark, scalars.parse_money(F.col("t")), t=text) == (None if value is None else Decimal(value).quantize(Decimal("0.01")))


@pytest.mark.parametrize("text, value", [("1-4-2024", date(2024, 4, 1)), ("31-02-2024", None), ("05/06/24", date(2024, 6, 5)), ("3-JAN-2023", date(2023, 1, 3)), ("2024-12-01", date(2024, 12, 1)), (" 1.2.2020 ", date(2020, 2, 1)), ("?", None), (None, None)])
def test_dates(spark, text, value):
    assert one(spark, scalars.parse_date(F.col("t")), t=text) == value


@pytest.mark.parametrize("label, value", [("2025-26", "2025_26"), ("2025_26", "2025_26"), ("2025/26", "2025_26"), ("fy_2025_26", "2025_26"), ("2025", "2025_26"), ("1999-00", "1999_00"), ("junk", None), (None, None)])
def test_fiscal_labels(spark, label, value):
    assert one(spark, fiscal.normalize_fy(F.col("t")), t=label) == value


def test_fiscal_dates(spark):
    assert one(spark, fiscal.fy_of(F.col("d")), d=date(2025, 3, 31)) == "2024_25"
    assert one(spark, fiscal.fy_of(F.col("d")), d=date(2025, 4, 1)) == "2025_26"
    assert one(spark, fiscal.fys_touched(F.col("a"), F.col("b")), a=date(2024, 3, 31), b=date(2025, 4, 1)) == ["2023_24", "2024_25", "2025_26"]
    assert one(spark, fiscal.previous_month_end(F.col("d")), d=date(2024, 3, 15)) == date(2024, 2, 29)


@pytest.mark.parametrize("function, text, value", [
    (scalars.normalize_code, "1282.0", "1282"), (scalars.normalize_code, " A1 ", "A1"), (scalars.normalize_pan, "abcde 1234f", "ABCDE1234F"), (scalars.normalize_pan, "x", None),
    (scalars.clean_ack, "nan", ""), (scalars.clean_ack, "12-34", "1234"), (scalars.safe_name, "a b/c*", "a_b_c"), (scalars.safe_name, "", "unknown"), (scalars.message_id, "<A@B> ", "a@b"),
    (scalars.heal_numbers, "1 234 . 50", "1234.50"), (scalars.strip_html, "<p>a&nbsp;b</p>  c &amp; d", "a b c & d"), (scalars.alias_key, " Foo--Bar  9", "foo bar 9"), (scalars.is_cash, "ATM WDL", True), (scalars.is_cash, "cash chrg", False),
    (scalars.emails_in, "x B@c.com a@b.org b@c.com", ["a@b.org", "b@c.com"]), (scalars.account_numbers, "12345 123456789 123456789", ["123456789"]), (scalars.masked_tails, "XXXX1234 **9876 12", ["1234", "9876"]),
])
def test_texts(spark, function, text, value):
    assert one(spark, function(F.col("t")), t=text) == value


def test_narration_and_lists(spark):
    r = one(spark, scalars.split_narration(F.col("t"), 10), t="hello brave world")
    assert (r.first, r.rest) == ("hello", "brave world")
    assert one(spark, scalars.leading_digits(F.col("t")), t=["a/1234_x.pdf", "2024_y.pdf", "b.pdf"]) == ["1234"]
    assert one(spark, scalars.normalize_emails(F.col("t"), 2), t=[" A@b.c", "a@b.c", "", "d@e.f", "g@h.i"]) == ["a@b.c", "d@e.f"]


@pytest.mark.parametrize("spec, hits", [("5-8", [5, 8]), (">=8", [8, 20]), ("<5", [1]), ("20", [20]), ("", [1, 5, 8, 20]), ("what", [])])
def test_numeric_filters(spark, spec, hits):
    df = spark.createDataFrame([(1,), (5,), (8,), (20,)], "n int")
    assert sorted(r.n for r in df.where(predicates.numeric_filter(F.col("n"), spec)).collect()) == hits


def test_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([("Hold",), (None,), ("x",)], "s string")
    assert df.where(predicates.excluding(F.col("s"), "Hold")).count() == 2
    assert df.where(predicates.in_list(F.col("s"), [])).count() == 0
    assert predicates.search(spark.createDataFrame([("10%",), ("100",)], "s string"), "0%", ["s"]).count() == 1
