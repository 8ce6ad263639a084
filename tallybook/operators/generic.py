"""The generic reader: statements of banks without a layout of their own, by what their headers, dates and balances say.

Three strategies are tried in order, each on the files that the ones before it left without rows: words under header words, tables of cells
whose header names the columns, and plain lines that begin at a date. A file has to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.scalars import collapse, computed_once, pack_narration, parse_date, parse_money, strip
from tallybook.operators import layouts as L
from tallybook.operators.ledger import fill_balance
from tallybook.operators.pages import Header, banded, lined
from tallybook.operators.statements import HEADER_WORDS, header_kind, header_score
from tallybook.session import written

# Header words beyond those of the score, and rows that are no entries.
KINDS = HEADER_WORDS | {"reference": r"\b(chq|cheque|ref|utr|instrument)\b"}
OPENING, CLOSING, SUMMARY = r"(?i)\bopening\s+bal(ance)?\b", r"(?i)\bclosing\s+bal(ance)?\b", r"(?i)^\s*statement\s+summary\b"
PURE_NUMBER = r"^([-+]?\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)$"
DATE_ANYWHERE = r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2})\b"
MONEY_ANYWHERE = r"(?<![\w.,])(-?\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|-?\d+\.\d+)(?!\w)"
PERIOD = rf"(?is)\bfrom\s+{DATE_ANYWHERE}\s+to\s+{DATE_ANYWHERE}"
#: Part of a column's rows that have to be numbers for it to be the balance, and the least number of them.
NUMERIC, NUMERIC_ROWS = 0.6, 3

_ORDER = lambda: Window.partitionBy("file").orderBy("seq")
_SO_FAR = lambda: _ORDER().rowsBetween(Window.unboundedPreceding, 0)


def _fixed(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """computed_once() whose fields are made below the generator, in generated code wherever they can be."""
    return computed_once(df.withColumns({f"_own_{n}": c for n, c in fields.items()}), {n: F.col(f"_own_{n}") for n in fields}).drop(*(f"_own_{n}" for n in fields))


def _with_columns(rows: DataFrame) -> DataFrame:
    """Rows from their file's header on, with _i, header and at_* as in file_columns().

    Rows meet their header by windows over the file, so what the rows are made of is made once. A cell behind all amounts of a file without a balance
    column is a row of its own until it is counted, so that columns are counted in place too.
    """
    file = Window.partitionBy("file")
    numbered = rows.withColumn("_i", F.row_number().over(_ORDER()) - 1)
    # The score knows no references; their pattern is the last, so they are what is unknown to it.
    kinds = numbered.withColumn("_kinds", F.when(F.col("_i") < 6, F.transform("cells", lambda c: header_kind(c, KINDS))))
    scored = kinds.withColumn("_score", header_score(F.transform("_kinds", lambda k: F.when(k == "reference", "unknown").otherwise(k))))
    place = lambda k: (F.nullif(F.array_position("_kinds", F.lit(k)), F.lit(0)) - 1).cast("int").alias(f"at_{k}")
    own = F.when(F.col("_score") >= 2, F.struct("_score", (-F.col("_i")).alias("_first"), *map(place, KINDS)))
    headed = scored.withColumn("_own", own).drop("_kinds", "_score").withColumn("_head", F.max("_own").over(file)).where("_head is not null and _i >= -_head._first")
    at = headed.select("file", "seq", "cells", "_i", (-F.col("_head._first")).alias("header"), *(F.col(f"_head.at_{k}") for k in KINDS))
    both = F.col("at_debit").isNotNull() & F.col("at_credit").isNotNull()
    at = at.withColumns({f"at_{k}": F.when(~both, F.col(f"at_{k}")) for k in ("amount", "drcr")} | {"at_date": F.coalesce("at_date", F.lit(0))})
    last = F.greatest(*(F.coalesce(f"at_{k}", F.lit(-1)) for k in ("debit", "credit", "amount", "drcr")))
    vote = lambda at, hit: F.struct(at.cast("int").alias("_at"), hit.cast("int").alias("_hit"))
    none = F.array(vote(F.lit(None), F.lit(None)))
    behind = F.slice("cells", F.col("_last") + 2, F.greatest(F.size("cells") - F.col("_last") - 1, F.lit(0)))
    votes = F.transform(behind, lambda c, i: vote(i + F.col("_last") + 1, parse_money(c).isNotNull()))
    asked = F.col("at_balance").isNull() & (F.col("_i") > F.col("header")) & F.col("cells").isNotNull()
    each = at.withColumn("_last", last).withColumn("_votes", F.when(asked, F.concat(none, votes)).otherwise(none)).drop("_last")
    each = each.select(*at.columns, F.inline("_votes")).withColumn("cells", F.when(F.col("_at").isNull(), F.col("cells")))
    column = Window.partitionBy("file", "_at")
    counted = each.withColumns({"_hits": F.sum("_hit").over(column), "_n": F.count("_hit").over(column)})
    mostly = F.col("_at").isNotNull() & (F.col("_hits") >= NUMERIC_ROWS) & (F.col("_hits") >= F.floor(F.col("_n") * NUMERIC))
    guess = counted.withColumn("_guess", F.max(F.when(mostly, F.col("_at"))).over(file)).where("_at is null")
    return guess.withColumn("at_balance", F.coalesce("at_balance", "_guess")).drop("_at", "_hit", "_hits", "_n", "_guess")


def file_columns(rows: DataFrame) -> DataFrame:
    """file, header and for each kind of column its place (at_date, ...; null: the file has none), by the file's best header row.

    The first column of a kind counts. With debit and credit columns an amount with its side is left alone. Without a balance column the rightmost
    one behind all amounts that mostly holds numbers is the balance. Files without a header have no row.
    """
    return _with_columns(rows).where("_i = header").drop("seq", "cells", "_i")


def table_rows(rows: DataFrame) -> DataFrame:
    """Statement rows of cells (file, seq, cells), every row read by its own file's columns.

    A row whose date cell is just a date begins an entry, rows without one go on with its narration, a summary ends it. Opening and closing rows
    are no entries; the opening balance counts as the one before. A missing or zero balance follows from its neighbours; one amount on the side that the balance
    contradicts, or that a lone DR or CR in the narration contradicts, changes sides; without an amount the change of the balance is the amount.
    """
    body = _with_columns(rows).where("_i > header")
    cell = lambda k: strip(F.coalesce(F.get("cells", F.col(f"at_{k}")), F.lit("")))
    body = body.withColumn("_day", cell("date")).withColumns({"_date": parse_date(F.col("_day")), "_ends": F.array_join("cells", " ").rlike(SUMMARY)})
    body = body.withColumn("_block", F.sum(F.col("_date").isNotNull().cast("int")).over(_SO_FAR()))
    # Blocks follow each other, so a row is behind its block's summary if the last summary is of the same block.
    body = body.withColumn("_over", F.last(F.when(F.col("_ends"), F.col("_block")), ignorenulls=True).over(_SO_FAR()))
    body = body.where("_block > 0 and (_over is null or _over < _block)")

    cutoff = F.least(*(F.coalesce(f"at_{k}", F.lit(1 << 20)) for k in ("debit", "credit", "amount", "drcr", "balance")))
    begins = F.col("_date").isNotNull()
    own = lambda i: F.coalesce(i == F.col("at_date"), F.lit(False)) | (F.col("_begins") & (F.coalesce(i == F.col("at_description"), F.lit(False)) | F.coalesce(i == F.col("at_reference"), F.lit(False))))
    bits = F.filter(F.transform(F.filter("cells", lambda c, i: (i < F.col("_cut")) & ~own(i)), lambda c: collapse(F.coalesce(c, F.lit("")))), lambda c: (c != "") & ~c.rlike(PURE_NUMBER))
    body = body.withColumns({"_cut": cutoff, "_begins": begins}).withColumn("_bits", bits)
    # Of a block only the row that begins it is read for these.
    read = {"_lead": collapse(cell("description")), "out": parse_money(cell("debit")), "in": parse_money(cell("credit")), "amount": parse_money(cell("amount")), "tag": F.lower(cell("drcr")), "end": parse_money(cell("balance")), "ref": collapse(cell("reference"))}
    read = {n: F.when(F.col("_begins"), c) for n, c in read.items()}
    whole = body.select("file", "_block", "seq", "_date", "_bits", *(c.alias(n) for n, c in read.items()))
    whole = whole.groupBy("file", "_block").agg(F.sort_array(F.collect_list(F.struct("seq", "_date", *read, "_bits"))).alias("_l"))
    first = F.get("_l", 0)
    whole = whole.select("file", first.alias("_f"), F.flatten(F.transform("_l", lambda r: r["_bits"])).alias("_bits"))
    first = F.col("_f")
    rest = F.array_remove(F.array_distinct("_bits"), first["_lead"])
    ref = F.when(~first["ref"].rlike("^0+$"), first["ref"]).otherwise("")
    tail = F.concat_ws(" ", F.array_join(rest, " "), ref)
    none = F.lit(None).cast("decimal(18,2)")
    single = lambda p: F.when(first["tag"].rlike(p), F.abs(first["amount"]))
    filled = lambda own, other: F.coalesce(F.nullif(F.abs(own), F.lit(0).cast("decimal(18,2)")), other, none, F.lit(0)).cast("decimal(18,2)")
    whole = whole.select(
        "file", first["seq"].alias("seq"), first["_date"].alias("txn_date"), first["_lead"].alias("_lead"), tail.alias("_tail"),
        filled(first["out"], single(r"\bdr?\b|debit")).alias("withdrawal"), filled(first["in"], single(r"\bcr?\b|credit")).alias("deposit"), first["end"].cast("decimal(18,2)").alias("balance"),
    )
    entries = _fixed(whole, {"_packed": pack_narration(F.col("_lead"), F.col("_tail"))})
    entries = entries.select("file", "seq", "txn_date", F.col("_packed.first").alias("narration1"), F.col("_packed.second").alias("narration2"), "withdrawal", "deposit", "balance")
    told = F.concat_ws(" ", "narration1", "narration2")
    zero = F.lit(0).cast("decimal(18,2)")
    entries = _fixed(entries, {"_opening": told.rlike(OPENING), "_closing": told.rlike(CLOSING)}).where("not _closing or _opening").drop("_closing")
    entries = entries.withColumns({c: F.when(F.col("_opening"), zero).otherwise(F.col(c)) for c in ("withdrawal", "deposit")})
    return settled(entries).where("not _opening").drop("_opening")


def settled(entries: DataFrame) -> DataFrame:
    """Statement rows whose missing balances follow from their neighbours and whose sides agree with narration and balance."""
    told = F.concat_ws(" ", "narration1", "narration2")
    dr, cr = told.rlike(r"(?i)\bDR\b"), told.rlike(r"(?i)\bCR\b")
    w, d = F.col("withdrawal"), F.col("deposit")
    wrong = (dr & ~cr & (d > 0) & (w == 0)) | (cr & ~dr & (w > 0) & (d == 0))
    swapped = lambda wrong: {"withdrawal": F.when(wrong, d).otherwise(w), "deposit": F.when(wrong, w).otherwise(d)}
    rows = fill_balance(entries.withColumns(swapped(wrong)), ["file"], ["seq"])
    before = F.last("balance", ignorenulls=True).over(_ORDER().rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_change", F.col("balance") - before)
    rows = rows.withColumns(swapped(F.coalesce(((F.col("_change") > 0) & (w > 0) & (d == 0)) | ((F.col("_change") < 0) & (d > 0) & (w == 0)), F.lit(False))))
    none = (w == 0) & (d == 0)
    kind = "decimal(18,2)"
    moved = {"withdrawal": F.when(none & (F.col("_change") < 0), -F.col("_change")).otherwise(w).cast(kind), "deposit": F.when(none & (F.col("_change") > 0), F.col("_change")).otherwise(d).cast(kind)}
    return rows.withColumns(moved).drop("_change")


def header_rows(words: DataFrame, how: Header) -> DataFrame:
    """Statement rows of words under header words (date, narration, withdrawal, deposit, balance); rows are bands half way between dates."""
    below = L.words_below_header(lined(words), list(how.labels))
    bands = banded(below, (F.col("_c") == 0) & parse_date(F.col("text")).isNotNull())
    cells = L.lines_of_cells(bands.withColumn("x0", F.struct("line", "x0")), len(how.labels))
    get = lambda i: F.get("cells", i)
    amount = lambda i: F.coalesce(F.abs(parse_money(get(i))), F.lit(0)).cast("decimal(18,2)")
    rows = _fixed(cells, {"txn_date": parse_date(get(0)), "narration1": collapse(get(1)), "narration2": F.lit(""), "withdrawal": amount(2), "deposit": amount(3), "balance": parse_money(get(4)).cast("decimal(18,2)")})
    return settled(rows.drop("cells").where("txn_date is not null"))


def text_rows(lines: DataFrame) -> DataFrame:
    """Statement rows of plain lines (file, seq, line): a line with a date begins an entry that lines without one go on with.

    Of the numbers with a point or comma behind the date the last is the balance and the one before it the amount, whose side a lone DR or CR tells,
    else the change of the balance, else it is a withdrawal; with one number only, it is the balance. What is between date and amount is the narration.
    """
    dated = F.col("line").rlike(DATE_ANYWHERE)
    block = F.sum(dated.cast("int")).over(_SO_FAR())
    chunks = lines.where("trim(line) <> ''").withColumn("_block", block).where("_block > 0").groupBy("file", "_block").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("_l"))
    chunks = _fixed(chunks, {"seq": F.get("_l", 0)["seq"], "_text": collapse(F.array_join(F.transform("_l", lambda r: r["line"]), " "))}).drop("_l")
    chunks = _fixed(chunks, {"_date": F.regexp_extract("_text", DATE_ANYWHERE, 1)})
    chunks = _fixed(chunks, {"_tail": F.expr("substring(_text, instr(_text, _date) + length(_date))"), "txn_date": parse_date(F.col("_date"))}).drop("_text", "_date").where("txn_date is not null")
    found = _fixed(chunks, {"_v": F.regexp_extract_all("_tail", F.lit(MONEY_ANYWHERE), F.lit(1))})
    n = F.size("_v")
    balance, amount = parse_money(F.get("_v", n - 1)), F.when(n > 1, F.abs(parse_money(F.get("_v", n - 2))))
    # The narration ends where the last one or two numbers begin.
    ends = F.regexp_replace("_tail", rf"^(.*?)\s*(?:{MONEY_ANYWHERE}[^.,]*?)?{MONEY_ANYWHERE}[^.,]*$", "$1")
    dr, cr = F.col("_tail").rlike(r"(?i)\bDR\b"), F.col("_tail").rlike(r"(?i)\bCR\b")
    found = _fixed(found, {"balance": balance.cast("decimal(18,2)"), "_amount": amount, "narration1": collapse(F.when(n > 0, ends).otherwise(F.col("_tail"))), "_dr": dr, "_cr": cr}).drop("_v", "_tail")
    dr, cr = F.col("_dr"), F.col("_cr")
    change = F.col("balance") - F.last("balance", ignorenulls=True).over(_ORDER().rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("_credit", F.when(cr & ~dr, True).when(dr & ~cr, False).otherwise(F.coalesce(change > 0, F.lit(False))))
    zero = F.lit(0).cast("decimal(18,2)")
    tidy = strip(F.regexp_replace("narration1", r"(?i)(?:\bDr\b|\bCR?\b)\s*$", ""))
    return found.select("file", "seq", "txn_date", tidy.alias("narration1"), F.lit("").alias("narration2"), F.when(~F.col("_credit"), F.coalesce("_amount", zero)).otherwise(zero).cast("decimal(18,2)").alias("withdrawal"), F.when(F.col("_credit"), F.coalesce("_amount", zero)).otherwise(zero).cast("decimal(18,2)").alias("deposit"), "balance")


def first_that_reads(files: DataFrame, strategies: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Rows of the first strategy that gives a file any, with its name in `strategy`; a strategy gets the files (file) that are left.

    Each strategy's rows are a written table, so nothing is read twice to know what is left; files are dropped by anti joins.
    """
    left, out = files.select("file").distinct(), []
    for name, read in strategies:
        got = written(read(left).withColumn("strategy", F.lit(name)), f"read-{name}")
        out.append(got)
        left = left.join(got.select("file").distinct(), "file", "left_anti")
    return reduce(DataFrame.unionByName, out)


def within_period(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows inside the period (from A to B) that the first page of their file prints; files that print none keep all."""
    day = lambda i: parse_date(F.regexp_extract("text", PERIOD, i))
    known = pages.where(F.col("text").rlike(PERIOD)).select("file", "page", day(1).alias("_a"), day(2).alias("_b")).where("page = 1 and _a is not null and _b is not null")
    periods = known.groupBy("file").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return rows.join(periods, "file", "left").where("_a is null or txn_date between _a and _b").drop("_a", "_b")


def cleaned(rows: DataFrame) -> DataFrame:
    """Without rows of no amount, totals (no narration to speak of and no change of the balance) and shorter repeats of an entry."""
    rows = rows.where("withdrawal <> 0 or deposit <> 0")
    length = F.length("narration1") + F.length("narration2")
    change = F.abs(F.col("balance") - F.lag("balance").over(Window.partitionBy("file").orderBy("txn_date", "seq")))
    rows = rows.withColumns({"_length": length, "_change": F.coalesce(change, F.lit(0))}).where("not (_length < 3 and _change < 0.01)")
    same = Window.partitionBy("file", "txn_date", "withdrawal", "deposit", "balance").orderBy(F.desc("_length"), "seq")
    return rows.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_length", "_change", "_n")


# Fixed value: the header words that statements of words are read by.
HEADED = Header(("Date", "Description", "Debit", "Credit", "Balance"), halves=True)


def read_generic(files: DataFrame, pages: DataFrame, words: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """file, strategy and statement rows of files (file) by the first strategy that reads them, cut to the printed period and cleaned.

    words (file, page, text, x0, x1, top), cells (file, seq, cells) and lines (file, seq, line) are what the pages (file, page, text) gave.
    """
    of = lambda rows: lambda left: rows.join(left, "file", "left_semi")
    strategies = [("headed", lambda left: header_rows(of(words)(left), HEADED)), ("table", lambda left: table_rows(of(cells)(left))), ("text", lambda left: text_rows(of(lines)(left)))]
    return cleaned(within_period(first_that_reads(files, strategies), pages))
