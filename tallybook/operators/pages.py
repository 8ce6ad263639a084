"""Pages of statements: words from characters, lines from words, rows from anchors, and which layout a file has.

Input is what a page gives: characters or words with places (file, page, text, x0, x1, top), or its text. Everything that is ordered is
ordered within a page or a file, so windows and groups are as large as a file; a file has to fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.scalars import bound, collapse, computed_once
from tallybook.operators import layouts as L
from tallybook.session import written

#: Lines of a file are numbered page * PAGE + line.
PAGE = 1 << 20


def lined(words: DataFrame, least: float = 2.0) -> DataFrame:
    """Adds `line`, a number that orders the lines of a file: words whose tops follow each other closely are one line.

    A page's tops are sorted and a new line begins where the step to the next is above the page's tolerance: half the smallest of its steps of
    more than `least`, and `least` at least. So the tolerance follows the page's narrowest spacing, whatever space there is between
    paragraphs, and a line whose words are not quite level stays one.
    Words without a top have a null line, after no other.
    """
    page = Window.partitionBy("file", "page")
    down = page.orderBy("top")
    stepped = words.withColumn("_step", F.col("top") - F.lag("top").over(down))
    usual = F.min(F.when(F.col("_step") > least, F.col("_step"))).over(page)
    stepped = stepped.withColumn("_new", (F.col("_step") > F.greatest(F.lit(least), F.coalesce(usual / 2, F.lit(0.0)))).cast("int"))
    number = F.sum(F.coalesce("_new", F.lit(0))).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return stepped.withColumn("line", F.when(F.col("top").isNotNull(), F.col("page").cast("long") * PAGE + number)).drop("_step", "_new")


def words_of_chars(chars: DataFrame, gap: float = 1.0, least: float = 1.5) -> DataFrame:
    """Words (file, page, line, text, x0, x1, top) of characters: a line is cut where a character begins more than `gap` right of where the one before it ended, and at blanks."""
    across = Window.partitionBy("file", "page", "line").orderBy("x0", "x1")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    marked = lined(chars, least).where("line is not null").withColumn("_blank", blank)
    apart = F.coalesce((F.col("x0") - F.lag("x1").over(across) > gap) | F.lag("_blank").over(across), F.lit(False))
    marked = marked.withColumn("_word", F.sum(apart.cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0))).where("not _blank")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))), lambda c: c["text"]), "")
    return marked.groupBy("file", "page", "line", "_word").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top")).drop("_word")


def line_texts(words: DataFrame) -> DataFrame:
    """file, seq and line: the words of each line from left to right."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ")
    return words.groupBy("file", F.col("line").alias("seq")).agg(text.alias("line"))


def banded(words: DataFrame, anchor: Column, ahead: float | None = None) -> DataFrame:
    """Words with `seq`, the number of the anchor whose band they lie in; words above a page's first band go.

    anchor tells which words are anchors. Bands begin half way up to the anchor before, the first one at the page's top; or, with `ahead`, so much
    above their own anchor. Anchors and words are one relation, and one window carries the last band's number to the words after it: nothing is joined.
    """
    page = Window.partitionBy("file", "page")
    marked = words.withColumn("_anchor", F.coalesce(anchor, F.lit(False)))
    if ahead is None:
        before = F.last(F.when(F.col("_anchor"), F.col("top")), ignorenulls=True).over(page.orderBy("top").rowsBetween(Window.unboundedPreceding, -1))
        marked = marked.withColumn("_before", before)
        # Two anchors of one height are one band. Every band has its anchor in it, so the number of bands begun is that of a word's own.
        new = (F.col("_before").isNull() | (F.col("_before") < F.col("top"))).cast("int")
        begun = F.struct(F.coalesce((F.col("_before") + F.col("top")) / 2, F.lit(float("-inf"))).alias("_y"), F.lit(0).alias("_is_word"), new.alias("_new"))
        both = marked.select("*", F.explode(F.array(F.when(F.col("_anchor") & F.col("top").isNotNull(), begun), F.struct(F.col("top").alias("_y"), F.lit(1).alias("_is_word"), F.lit(0).alias("_new")))).alias("_e"))
        both = both.where("_e._y is not null").select(*words.columns, "_e.*")
        number = F.sum("_new").over(page.orderBy("_y", "_is_word").rowsBetween(Window.unboundedPreceding, 0))
        placed = both.withColumn("_number", number).where("_is_word = 1 and _number > 0")
        return placed.withColumn("seq", F.col("page").cast("long") * PAGE + F.col("_number")).drop("_y", "_is_word", "_new", "_number")
    marked = marked.withColumn("_from", F.when(F.col("_anchor"), F.col("top") - ahead))
    both = marked.select("*", F.inline(F.array(F.struct(F.col("_from").alias("_y"), F.lit(0).alias("_is_word")), F.struct(F.col("top").alias("_y"), F.lit(1).alias("_is_word"))))).where("_y is not null")
    order = page.orderBy("_y", "_is_word").rowsBetween(Window.unboundedPreceding, 0)
    band = F.last(F.when(F.col("_is_word") == 0, F.col("top")), ignorenulls=True).over(order)
    placed = both.withColumn("_band", band).where("_is_word = 1 and _band is not null")
    # Two anchors of one height are one band.
    return placed.withColumn("seq", F.col("page").cast("long") * PAGE + F.dense_rank().over(page.orderBy("_band"))).drop("_anchor", "_from", "_y", "_is_word", "_band")


def merged_strays(rows: DataFrame, stray: Column) -> DataFrame:
    """Statement rows with each stray row's text joined to the row before it, or to the row after where a file has none before.

    The kept row gives date and place; amounts and a balance that it lacks come from its strays. A file of strays only becomes one row.
    """
    order = Window.partitionBy("file").orderBy("seq")
    marked = rows.withColumn("_stray", F.coalesce(stray, F.lit(False)))
    block = F.greatest(F.sum((~F.col("_stray")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    parts = ["seq", "_stray", "txn_date", "narration1", "narration2", "withdrawal", "deposit", "balance"]
    whole = marked.withColumn("_block", block).groupBy("file", "_block").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("_l"))
    main = F.coalesce(F.get(F.filter("_l", lambda r: ~r["_stray"]), 0), F.get("_l", 0))
    glue = lambda n: F.trim(F.array_join(F.filter(F.transform("_l", lambda r: r[n]), lambda t: F.trim(t) != ""), " ")).alias(n)
    lent = lambda n: F.coalesce(F.get(F.filter(F.transform(F.filter("_l", lambda r: r["_stray"]), lambda r: r[n]), lambda a: a != 0), 0), F.lit(0).cast("decimal(18,2)"))
    amount = lambda n: F.when(F.coalesce(main[n], F.lit(0)) == 0, lent(n)).otherwise(main[n]).cast("decimal(18,2)").alias(n)
    balance = F.coalesce(main["balance"], F.get(F.filter(F.transform("_l", lambda r: r["balance"]), lambda b: b.isNotNull()), 0))
    return whole.select("file", main["seq"].alias("seq"), main["txn_date"].alias("txn_date"), glue("narration1"), glue("narration2"), amount("withdrawal"), amount("deposit"), balance.alias("balance"))


# Fixed value: narrations whose rows carry no amount of their own.
CASH_OR_SELF = r"(?i)\b(BY\s+CASH|TO\s+SELF)\b"


def cash_strays() -> Column:
    """Rows of cash and self words without an amount."""
    return F.concat_ws(" ", "narration1", "narration2").rlike(CASH_OR_SELF) & (F.coalesce("withdrawal", F.lit(0)) == 0) & (F.coalesce("deposit", F.lit(0)) == 0)


# Words to cells, for layouts whose pages are words


@dataclass(frozen=True)
class Fixed:
    """Columns at fixed edges; of several the one whose pattern is the first to match a line of the file, else the first."""

    choices: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Header:
    """Columns at the words of the header line. ahead: rows are bands that begin so much above a date; None: lines.  halves: bands are cut half way between dates."""

    labels: tuple[str, ...]
    ahead: float | None = None
    halves: bool = False
    date: str = ""


# How the words of each layout become cells.
WORDS: dict[str, Fixed | Header] = {
    "bob_1": Fixed((("bob_6", r"(?i)^\s*DATE\s*NARRATION\s*CHQ.NO."), ("bob_8", r"(?i)^\s*Serial\s*Transaction\s*Value\s*Description"), ("bob_7", r"(?i)^\s*TRAN DATE\s*VALUE DATE\s*NARRATION"), ("bob_8b", r"^\s*क.सं\s*लेनदेन की\s*पभाव तारीख"))),
    "kalupur_1": Fixed((("kalupur", "."),)),
    "spcb_2": Fixed((("spcb_2", "."),)),
    "kotak_1": Fixed((("kotak_1", "."),)),
    "kotak_2": Header(("Date", "Description", "Ref", "Debit", "Credit", "Balance")),
    "sbi_2": Header(("Date", "Details", "Ref", "Debit", "Credit", "Balance"), ahead=1.0, date=r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"),
    "pnb_1": Header(("Txn", "Chq", "Dr", "Cr", "Balance", "Description"), halves=True, date=r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$"),
}


def words_to_rows(name: str, words: DataFrame) -> DataFrame:
    """file, seq and cells of the words of a layout: lines or bands by height, columns by fixed or header edges."""
    how = WORDS[name]
    placed = lined(words)
    if isinstance(how, Fixed):
        if len(how.choices) == 1:
            return L.words_to_cells(placed, L.BOUNDS[how.choices[0][0]])
        return _chosen(placed, how)
    if how.ahead is None and not how.halves:
        return L.words_to_header_cells(placed, list(how.labels))
    below = L.words_below_header(placed, list(how.labels))
    bands = banded(below, (F.col("_c") == 0) & F.col("text").rlike(how.date), None if how.halves else how.ahead)
    # Within a band's cell words go line by line.
    across = F.struct(F.col("line"), F.col("x0"))
    return L.lines_of_cells(bands.withColumn("x0", across), len(how.labels))


def _chosen(placed: DataFrame, how: Fixed) -> DataFrame:
    """Cells by the edges that each file's own header asks for.

    Lines are lists of their words, so that a window over the file tells them its header and nothing is joined.
    """
    lines = placed.groupBy("file", F.col("line").alias("seq")).agg(F.sort_array(F.collect_list(F.struct("x0", "text", "x1"))).alias("_w"))
    lines = computed_once(lines, {"_line": F.array_join(F.transform("_w", lambda w: w["text"]), " ")})
    which = F.coalesce(*(F.when(F.col("_line").rlike(p), i) for i, (_, p) in enumerate(how.choices)))
    lines = lines.withColumn("_i", which)
    first = F.min_by("_i", F.when(F.col("_i").isNotNull(), F.col("seq"))).over(Window.partitionBy("file"))
    lines = lines.select("file", "seq", "_w", F.coalesce(first, F.lit(0)).alias("_i"))
    out = None
    for i, (key, _) in enumerate(how.choices):
        bounds = L.BOUNDS[key]
        inside = F.filter(F.transform("_w", lambda w: F.struct(L.column_of((w["x0"] + w["x1"]) / 2, bounds).alias("_c"), w["text"].alias("text"))), lambda w: w["_c"].between(0, len(bounds) - 2))
        out = (F if out is None else out).when(F.col("_i") == i, F.struct(inside.alias("w"), F.lit(i).alias("i")))
    lines = computed_once(lines, {"_p": out}).where("size(_p.w) > 0")
    widths = [len(L.BOUNDS[key]) - 1 for key, _ in how.choices]
    cells = L.cells_of(F.col("_p.w"), max(widths))
    return computed_once(lines, {"cells": F.slice(cells, F.lit(1), F.get(F.array(*map(F.lit, widths)), F.col("_p.i")))}).select("file", "seq", "cells")


def words_statement(name: str, words: DataFrame) -> DataFrame:
    """Statement rows of a layout whose pages are words; cash and self rows without an amount join their neighbours in PNB's."""
    rows = L.statement(name, words_to_rows(name, words))
    return merged_strays(rows, cash_strays()) if name == "pnb_1" else rows


# Which layout a file has


@dataclass(frozen=True)
class Rule:
    """All of the parts have to be on one page; of a part any of its patterns, or with `times` so many matches of a pattern."""

    layout: str
    parts: tuple[tuple[str | tuple[str, int], ...], ...]


def _rule(layout: str, *parts: str | tuple) -> Rule:
    return Rule(layout, tuple((p,) if isinstance(p, str) else p for p in parts))


_IDBI_ENTRY = r"(?im)^\s*\d+\.\s+\d{2}-[A-Za-z]{3}-\d{2}\s+.+?\s+[\d,]+\.\d{2}\s+(Cr|Dr)\s*$"

# What tells the layouts apart, in the order in which they are tried on a page.
RULES: list[Rule] = [
    _rule("sbi_3", r"txn\s+date", "value", "description", r"ref\s+no", "debit", "credit", "balance"),
    _rule("icici_2", r"detailed\s+statement", r"transactions\s+list", r"value\s+date", r"transaction\s+date", "withdrawal", "deposit", "balance"),
    _rule("bandhan_1", (r"Bandhan\s+Bank", r"BDBL\d{7}"), r"Transaction\s+Date", r"Dr\s*/\s*Cr", "Balance"),
    _rule("sbi_1", r"Transaction\s+Reference", (r"Ref\.?/?No\.?/Chq\.?/?No\.?", r"Ref\.?\.?No\./Chq\.?\.?No\.?"), r"\bCredit\b", r"\bDebit\b", r"\bBalance\b"),
    _rule("spcb_1", "This is SPCB"),
    _rule("spcb_2", "Statement Downloaded by INB User"),
    _rule("spcb_3", r"Post\s+Dt\.?", r"Val\s+Dt\.?", r"\bDebit\b", r"\bCredit\b", r"\bBalance\b"),
    _rule("bob_1", ("www.bankofbaroda.in", "using bob World", "Main Account Holder Name :", "through bob World mobile app")),
    _rule("bob_1", r"Statement\s+Period", (r"Bank\s+of\s+Baroda", r"www\.bankofbaroda\.in", r"bob\s+World")),
    _rule("hdfc_1", ("www.hdfcbank.com", "savings account Details")),
    _rule("hdfc_1", r"Txn Date\s*Narration\s*Withdrawals\s*Deposits", "Joint Holders 2"),
    _rule("axis_1", "Statement of Axis Account"),
    _rule("canara_1", "Canara Bank"),
    _rule("bom_1", "Website : www.bankofmaharashtra.in"),
    _rule("sutex_1", r"Date\s*Particulars\s*.*?\s+Debit\s*Credit", "STATEMENT SUMMARY"),
    _rule("sarvodaya_1", r"Date\s*Particulars\s*Chq No.", "The Sarvodaya Sahakari Bank Ltd"),
    _rule("icici_2", r"icici\s+bank", r"detailed\s+statement", r"transactions\s+list", "withdrawal", "deposit", "balance"),
    _rule("icici_1", "www.icicibank.com"),
    _rule("kalupur_1", (r"The\s+Kalupur\s+Commercial\s+Co\.?\.?op\.?\s+Bank\s+Ltd\.?", r"\bIFSC\s*:\s*KCCB0"), r"\bDate\s+Value\s+Date\s+TR-Mode-?", r"\bParticulars\b", r"\bDebit\s+Amt\.?\b", r"\bCredit\s+Amt\.?\b", r"\bBalance\b"),
    _rule("pnb_1", (r"Punjab\s+National\s+Bank", r"pnbindia\.in", r"\bKIMS\s*Remark")),
    _rule("pnb_1", r"\bTxn\s*Date\b", r"\bDescription\b", (r"\bDr\s*Amount\b", r"\bDebit\s*Amount\b"), (r"\bCr\s*Amount\b", r"\bCredit\s*Amount\b"), r"\bBalance\b"),
    _rule("kotak_1", (r"Kotak\s+Mahindra\s+Bank", r"\bKKBK\b", r"Account\s*No"), r"\bDate\s+Narration\b", (r"Withdrawal\s*\(?\s*Dr\s*\)?", r"Deposit\s*\(?\s*Cr\s*\)?"), r"\bBalance\b"),
    _rule("kotak_2", r"Kotak\s+Mahindra\s+Bank", "DEBIT", "CREDIT", "BALANCE"),
    _rule("union_1", "unionbankofindia"),
    _rule("union_1", r"S\.?No", r"Transaction\s*Id", r"Amount\(Rs\.\)", r"Balance\(Rs\.\)"),
    _rule("indian_1", (r"\bIndian\s+Bank\b", r"indianbank\.in", r"Account\s*Number\s*[:\-]?\s*\d{6,20}"), (r"Date\s+Transaction\s+Details\s+Debits\s+Credits\s+Balance", r"(?is)^(?=.*\bTransaction\s+Details\b)(?=.*\bDebits\b)(?=.*\bCredits\b)(?=.*\bBalance\b)")),
    _rule("sbi_2", r"State\s+Bank\s+of\s+India", r"\bDate\b", r"\bCredit\b", r"\bBalance\b", "Details?.*Ref.*Cheque", r"\bDebit\b"),
    _rule("idbi_choicepoint", _IDBI_ENTRY, ((_IDBI_ENTRY, 3), r"\b(Sr\.?\s*No\.?|S\.?\s*No\.?|Sr\.?)\s+Date\s+Description\s+Amount\s+Type\b", r"\bIDBI\b")),
]
# What files get that no rule can be tried on, or that none fits.
MISSING, UNREADABLE, NO_PAGES, NO_TEXT, UNKNOWN = "Check Path", "Passwords failed", "PDF Empty", "Scanned PDF", "Module Not Found"


def page_rule(text: Column, rules: list[Rule] = RULES) -> Column:
    """Place of the first rule that a page's text fits, else null."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), "[​ ]", " ")

    def first_rule(page: Column) -> Column:
        def seen(p: str | tuple[str, int]) -> Column:
            if isinstance(p, tuple):
                return F.regexp_count(page, F.lit(p[0])) >= p[1]
            return page.rlike(p if p.startswith("(?") else f"(?i){p}")

        fits = [reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, map(seen, part)) for part in rule.parts)) for rule in rules]
        return reduce(lambda out, it: F.when(it[1], it[0]).otherwise(out), reversed(list(enumerate(fits))), F.lit(None).cast("int"))

    return bound(clean, first_rule)


def file_layouts(files: DataFrame, pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """file and layout of every row of files (file, found, opened): the first rule over the file's pages (file, page, text), page by page.

    A file that is not found, not opened, without pages, without any text, or fitting no rule gets the word for that. Texts are matched where
    they are read; a page is three small values before the one shuffle.
    """
    tried = pages.select("file", "page", page_rule(F.col("text"), rules).alias("_rule"), (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s​ ]+", " ")) != "").alias("_text"))
    best = tried.groupBy("file").agg(F.min_by("_rule", F.when(F.col("_rule").isNotNull(), F.col("page"))).alias("_rule"), F.max("_text").alias("_text"))
    names = F.array(*(F.lit(r.layout) for r in rules))
    told = F.when(~F.coalesce("found", F.lit(False)), MISSING).when(~F.coalesce("opened", F.lit(False)), UNREADABLE).when(F.col("_text").isNull(), NO_PAGES)
    told = told.when(F.col("_rule").isNotNull(), F.get(names, F.col("_rule"))).when(~F.col("_text"), NO_TEXT).otherwise(UNKNOWN)
    # Both sides grow with the files, so neither is broadcast.
    return files.join(best.hint("merge"), "file", "left").select("file", told.alias("layout"))


def read_statements(layouts: DataFrame, cells: DataFrame, lines: DataFrame, words: DataFrame) -> DataFrame:
    """file, layout and statement rows of all files of a mixed folder, each read by its own layout (file, layout).

    cells (file, seq, cells), lines (file, seq, line) and words (file, page, text, x0, x1, top) hold what each file's pages gave. Each is written once, laid
    out by layout, so that a layout's reader scans its own files only; files without a layout give no rows.
    """
    known = layouts.where(F.col("layout").isin(sorted({r.layout for r in RULES})))
    routed = {kind: written(rows.join(known, "file").repartition("file"), f"routed-{kind}", by=["layout"]) for kind, rows in (("cells", cells), ("lines", lines), ("words", words))}
    out = []
    for name in sorted({r.layout for r in RULES}):
        if name in WORDS:
            rows = words_statement(name, routed["words"].where(F.col("layout") == name).drop("layout"))
        else:
            kind = "cells" if isinstance(L.LAYOUTS[name], L.Cells) else "lines"
            rows = L.statement(name, routed[kind].where(F.col("layout") == name).drop("layout"))
        out.append(rows.withColumn("layout", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


# Footers whose letters are printed twice


def noisy(phrase: str) -> str:
    """A pattern of every text with the run-length normal form of the phrase: each run of a letter any number of times, blanks as they come."""
    runs = ["".join(dict.fromkeys(g)) for _, g in groupby(" ".join(phrase.lower().split()))]
    return "".join(r"\s+" if c == " " else f"{c}+" if c.isalpha() else f"\\{c}+" for c in runs)


# Phrases that begin a footer.
FOOTERS = ["this is system", "unified payment inter", "national electronic fund", "registered office", "request to our customers", "page no"]


def without_noisy_footer(column: Column, phrases: list[str] = FOOTERS) -> Column:
    """The text before the first footer phrase, whose letters may be repeated, or before a web address; then without trailing marks."""
    pattern = "|".join(["https?://\\S", *map(noisy, phrases)])
    return F.regexp_replace(F.regexp_replace(column, f"(?is)(?:{pattern}).*$", ""), r"[ \-:/|]+$", "")


def letters_once(column: Column) -> Column:
    """Run-length normal form: lower-case letters and single blanks, each run of one letter once."""
    letters = F.regexp_replace(F.lower(column), r"[^\p{L}\s]", "")
    return collapse(F.regexp_replace(letters, r"(.)\1+", "$1"))
