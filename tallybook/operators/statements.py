"""From the words, lines and cells of a statement to its rows: header and table scores, formats, columns, parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.scalars import bound, collapse, computed_once, normalize_pan, parse_date, parse_money, strip

# Header words by kind, in order of preference.
HEADER_WORDS = {
    "date": r"\b(txn date|tran date|transaction date|value date|post date|date)\b",
    "debit": r"\b(debits?|withdrawals?|dr amt|dr tran amt|paid out)\b",
    "credit": r"\b(credits?|deposits?|cr amt|cr tran amt|paid in)\b",
    "balance": r"\b(balance|bal amt|closing bal)\b",
    "drcr": r"\b(dr/cr|cr/dr|type)\b",
    "amount": r"\b(amount|amt)\b",
    "description": r"\b(particulars?|narration|description|details|remarks)\b",
}


def header_kind(cell: Column, words: dict[str, str] = HEADER_WORDS) -> Column:
    """Kind of a header cell; unknown if no word fits, which one pattern of them all tells."""
    known = "|".join(words.values())
    known = rf"\b(?:{known})" if all(p.startswith(r"\b") for p in words.values()) else known

    def kind_of(text: Column) -> Column:
        out = F.lit("unknown")
        for kind, pattern in reversed(list(words.items())):
            out = F.when(text.rlike(pattern), kind).otherwise(out)
        return F.when(text.rlike(known), out).otherwise("unknown")

    return bound(F.lower(collapse(F.coalesce(cell, F.lit("")))), kind_of)


# The points of the header and acknowledgement scores below.
def header_score(kinds: Column) -> Column:
    """2 for a date, 2 for debit or credit, 2 for an amount with its side, 1 each for balance and description, -0.2 an unknown cell."""
    has = lambda k: F.array_contains(kinds, k)
    points = F.when(has("date"), 2.0).otherwise(0.0) + F.when(has("debit") | has("credit"), 2.0).otherwise(0.0) + F.when(has("amount") & has("drcr"), 2.0).otherwise(0.0)
    points = points + F.when(has("balance"), 1.0).otherwise(0.0) + F.when(has("description"), 1.0).otherwise(0.0)
    return points - 0.2 * F.size(F.filter(kinds, lambda k: k == "unknown"))


def best_header(rows: DataFrame, keys: list[str], seq: str, cells: str, first: int = 6) -> DataFrame:
    """The row with the best header score among the first rows of each table, the earliest of equals; it has to exceed -1."""
    kinds = computed_once(rows.where(F.col(seq) < first), {"_kinds": F.transform(cells, lambda c: header_kind(c))})
    scored = computed_once(kinds, {"score": header_score(F.col("_kinds"))}).where("score > -1")
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(seq, "score"), F.struct("score", -F.col(seq))).alias("b"))
    return best.select(*keys, F.col(f"b.{seq}").alias(seq), F.col("b.score").alias("score"))


def column_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Score of each column as acknowledgement numbers: a cell with 14-16 digits counts 3, else with 12-20 1, else a mobile number -2.

    A column whose name has `ack` in it gets 3 more.
    """
    def score(c: Column) -> Column:
        text = strip(F.coalesce(c.cast("string"), F.lit("")))
        return F.when(text.rlike(r"\b\d{14,16}\b"), 3).when(text.rlike(r"\b\d{12,20}\b"), 1).when(text.rlike(r"^[6-9]\d{9}$"), -2).otherwise(0)

    return _by_column(df, columns, lambda c: F.coalesce(F.sum(score(F.col(c))), F.lit(0)) + (3 if "ack" in c.lower() else 0), "score")


def pan_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many valid PANs each column has."""
    return _by_column(df, columns, lambda c: F.count(normalize_pan(F.col(c).cast("string"))), "score")


def best_column(scores: DataFrame, columns: list[str]) -> DataFrame:
    """The column with the highest score above zero, the leftmost of equals; no row if there is none."""
    place = F.array_position(F.array(*map(F.lit, columns)), F.col("column_name"))
    best = scores.where("score > 0").agg(F.max_by("column_name", F.struct("score", -place)).alias("column_name"))
    return best.where("column_name is not null")


def _by_column(df: DataFrame, columns: list[str], value: Callable[[str], Column], name: str) -> DataFrame:
    sums = df.agg(*(value(c).cast("long").alias(c) for c in columns))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column_name", name))


def table_scores(rows: DataFrame, keys: list[str], table: str, seq: str, cells: str) -> DataFrame:
    """keys, table, score: 2 for each row whose first cell is a date and 1 for each with a number, the first row left out.

    Tables of fewer than 4 or more than 12 columns have no score; blank rows don't count.
    """
    filled = rows.where(F.exists(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    order = Window.partitionBy(*keys, table).orderBy(seq)
    dated = parse_date(F.coalesce(F.get(cells, 0), F.lit(""))).isNotNull()
    number = F.exists(cells, lambda c: F.coalesce(c, F.lit("")).rlike(r"\d"))
    points = F.when(F.col("_n") == 1, 0).otherwise(F.when(dated, 2).otherwise(0) + F.when(number, 1).otherwise(0))
    numbered = filled.withColumn("_n", F.row_number().over(order))
    sums = numbered.groupBy(*keys, table).agg(F.max(F.size(cells)).alias("_width"), F.sum(points).alias("score"))
    return sums.where(F.col("_width").between(4, 12)).drop("_width")


def best_table(scores: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Of each key the table with the highest score above zero, the first of equals."""
    best = scores.where("score > 0").groupBy(*keys).agg(F.max_by(F.struct(table, "score"), F.struct("score", -F.col(table))).alias("_b"))
    return best.select(*keys, F.col(f"_b.{table}").alias(table), F.col("_b.score").alias("score"))


def sections(rows: DataFrame, keys: list[str], seq: str, is_header: Column) -> DataFrame:
    """section: how many header rows there are up to and with each row; rows before the first have 0."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(is_header.cast("int")).over(w))


def cells_to_map(cells: Column) -> Column:
    """col_0, col_1, ... to the cells."""
    return F.map_from_entries(F.transform(cells, lambda x, i: F.struct(F.concat(F.lit("col_"), i.cast("string")), x)))


def padded_cells(cells: Column, width: int) -> Column:
    """The array cut or filled with empty texts to a width."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), 1, width)


def detect_format(text: Column, rules: list[tuple[str, str]], default: str = "unknown") -> Column:
    """Name of the first rule whose pattern the text matches; an empty text is `empty`."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").otherwise(out)


def words_to_columns(words: DataFrame, boxes: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Words of each line by the column box that their middle lies in: keys, line, label, text.

    words: text, x0, x1; boxes: label, left, right for each key. The keys are an equality, the box its residual.
    """
    middle = (F.col("x0") + F.col("x1")) / 2
    hit = words.join(boxes, keys).where((middle >= F.col("left")) & (middle < F.col("right")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    return hit.groupBy(*keys, line, "label").agg(joined.alias("text"))


def bands(anchors: DataFrame, keys: list[str], top: str = "top") -> DataFrame:
    """Vertical bands around anchors, cut half way to the neighbours: band_top, band_bottom."""
    w = Window.partitionBy(*keys).orderBy(top)
    up, down = (F.lag(top).over(w) + F.col(top)) / 2, (F.lead(top).over(w) + F.col(top)) / 2
    return anchors.withColumn("band_top", F.coalesce(up, F.lit(float("-inf")))).withColumn("band_bottom", F.coalesce(down, F.lit(float("inf"))))


# Parsers of line tables (file, seq, line) to statement rows, by format name.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def parser(name: str) -> Callable:
    def register(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        PARSERS[name] = function
        return function

    return register


def _statement_rows(cells: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Rows with a date. The fields stand behind a generator, below which the filter on the date is not pushed, so each is computed once."""
    rows = cells.select("file", "seq", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in fields.items()))))).where("txn_date is not null")
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.withColumns({"withdrawal": F.coalesce("withdrawal", zero), "deposit": F.coalesce("deposit", zero)})


def _delimited(lines: DataFrame, separator: str, at: dict[str, int]) -> DataFrame:
    # Only lines that reach to the date and have a number are looked at closely.
    likely = F.col("line").rlike(rf"^(?:[^{separator}]*{separator}){{{at["date"]}}}") & F.col("line").rlike(r"\d")
    cells = lines.where(likely).select("file", "seq", F.explode_outer(F.array(F.split("line", separator))).alias("c"))
    get = lambda k: collapse(F.get("c", at[k]))
    return _statement_rows(cells, {"txn_date": parse_date(get("date")), "narration": get("narration"), "withdrawal": parse_money(get("withdrawal")), "deposit": parse_money(get("deposit")), "balance": parse_money(get("balance"))})


@parser("pipe")
def pipe_text(lines: DataFrame) -> DataFrame:
    """Account | date | particular | instrument | debit | credit | balance | branch."""
    return _delimited(lines, r"\|", {"date": 1, "narration": 2, "withdrawal": 4, "deposit": 5, "balance": 6})


@parser("tab")
def tab_text(lines: DataFrame) -> DataFrame:
    """Date, particulars, cheque, debit, credit, balance between tabs; preamble lines have no date and go."""
    return _delimited(lines, "\t", {"date": 0, "narration": 1, "withdrawal": 3, "deposit": 4, "balance": 5})


@parser("html")
def html_table(lines: DataFrame) -> DataFrame:
    """Rows of six cells: date, particulars, cheque, withdrawals, deposits, balance with Cr or Dr."""
    whole = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), " ").alias("page"))
    rows = whole.select("file", F.posexplode(F.regexp_extract_all("page", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("seq", "row"))
    cell = lambda x: collapse(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "&nbsp;", " "))
    cells = rows.withColumn("c", F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell)).where("size(c) = 6")
    get = lambda i: F.get("c", i)
    return _statement_rows(cells, {"txn_date": parse_date(get(0)), "narration": get(1), "withdrawal": parse_money(get(3)), "deposit": parse_money(get(4)), "balance": parse_money(get(5))})
