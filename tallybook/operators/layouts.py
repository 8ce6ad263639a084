"""Bank statement layouts as data: where each field of a printed line is, and how its side is told.

Three kinds of input become statement rows (file, seq, txn_date, narration1, narration2, withdrawal, deposit, balance): tables of
cells, lines that one pattern reads, and blocks of lines that begin at a date. Words with positions become cells first, by fixed
column bounds or by those of the header. A window over each file is all that a layout ever needs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions.scalars import collapse, computed_once, parse_date, parse_money, strip
from tallybook.operators.ledger import line_blocks



@dataclass(frozen=True)
class Cells:
    """A table layout. at: for each width the places of date, narration, reference, withdrawal, deposit and balance (None: absent).

    side: `columns`; `delta` (one amount, by the balance); `sign` (one amount, Dr is a withdrawal); `tag` (Cr or Dr in the amount, else the
    balance's change); `spilled`, `repaired` and `rescued`: see cell_statement(). joined: what is put between a row and rows without a date after it; None leaves those out. cut: characters
    of the first narration; between: what stands before the reference in the second.
    """

    bank: str
    at: dict[int, tuple]
    side: str = "columns"
    cut: int = 90
    between: str = "  "
    joined: str | None = None
    skip: str = ""
    skip_last: bool = False
    dates: str = ""
    distinct: bool = False
    tolerance: float = 0.05
    split_dates: bool = False


@dataclass(frozen=True)
class Lines:
    """A line layout. pattern: groups of date, narration, then as many of withdrawal, deposit, balance or amount, tag as `groups` names."""

    bank: str
    pattern: str
    groups: tuple[str, ...]
    goes_on: bool = False
    stop: str = ""


@dataclass(frozen=True)
class Blocks:
    """A block layout. start: a line that begins an entry; its amounts are found by `amount` (group 1 the number, 2 a tag).

    The last amount is the balance, the one before it the entry's. started: lines up to the first that matches are no entries. credit, debit: patterns of the block that tell the side
    before the balance does; hints: those that do so after it. gone: what is taken out of the narration. noise: lines left out.
    """

    bank: str
    start: str
    amount: str
    gone: tuple[str, ...]
    date_group: int = 1
    credit: str = ""
    debit: str = ""
    hints: tuple[str, str] = ("", "")
    default: str = "debit"
    noise: str = ""
    cut: int = 0
    tail: str = ""
    tolerance: float | None = None
    started: str = ""
    reference: str = ""


# Left edges of the columns of printed statements and the last column's right edge.
BOUNDS = {
    "bob_6": [29, 77, 250, 295, 380, 473, 1000], "bob_8": [21, 48, 92, 140, 318, 375, 429, 495, 1000], "bob_7": [5, 75, 150, 365, 430, 550, 670, 1000],
    "bob_8b": [10, 45, 90, 135, 310, 365, 430, 495, 1000], "spcb_2": [20, 85, 150, 300, 355, 425, 500, 580], "kalupur": [25, 80, 140, 180, 372, 437, 538, 1000],
    "kotak_1": [20, 110, 500, 600, 700, 820], "kotak_2": [20, 110, 430, 560, 650, 740, 860],
}

_DMY = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
_DECIMALS = r"[\d,]+\.\d{2}"
_OPENING = r"(?i)\b(opening|closing)\s+balance\b"

# The layouts, in the terms of the classes above.
LAYOUTS: dict[str, Cells | Lines | Blocks] = {
    "axis_1": Cells("AXIS", {5: (0, 1, None, 2, 3, 4), 7: (0, 2, 1, 3, 4, 5)}, skip_last=True, dates=r"\d{2}-\d{2}-\d{4}"),
    "bom_1": Cells("BOM", {8: (1, 2, 3, 4, 5, 6)}, cut=0, dates=r"\d{2}/\d{2}/\d{4}"),
    "sutex_1": Cells("SUTEX", {6: (0, 1, 2, 3, 4, 5)}, between=" - "),
    "icici_1": Cells("ICICI Bank", {6: (0, 2, 1, 4, 3, 5)}, skip=_OPENING),
    "sbi_1": Cells("SBI Bank", {6: (0, 1, 2, 4, 3, 5)}, side="delta"),
    "hdfc_1": Cells("HDFC", {5: (0, 1, None, 2, 3, 4), 7: (0, 1, 2, 4, 5, 6)}, joined="", cut=0),
    "bob_1": Cells("BOB", {6: (0, 1, 2, 3, 4, 5), 7: (0, 2, 3, 4, 5, 6), 8: (1, 3, 4, 5, 6, 7)}, joined=" ", cut=0),
    "bob_2": Cells("BOB", {8: (1, 3, 4, 5, 6, 7)}, joined=""),
    "sarvodaya_1": Cells("SARVODAYA CO-OP BANK LTD", {8: (3, 1, 2, 5, 6, 7)}, joined=""),
    "kalupur_1": Cells("KALUPUR", {7: (0, 3, None, 4, 5, 6)}, cut=0),
    "spcb_2": Cells("SPCB", {7: (0, 2, 3, 4, 5, 6), 6: (0, 2, 3, 4, 5, None)}, joined="", cut=0),
    "kotak_1": Cells("KOTAK", {5: (0, 1, 2, 3, None, 4)}, side="sign", joined=" ", cut=0),
    "kotak_2": Cells("KOTAK", {6: (0, 1, 2, 3, 4, 5)}, side="spilled", cut=0),
    "sbi_2": Cells("SBI Bank", {6: (0, 1, 2, 3, 4, 5)}, joined=" ", cut=0),
    "pnb_1": Cells("PNB", {6: (0, 5, 1, 2, 3, 4)}, side="repaired", joined=" ", cut=0, skip=_OPENING),
    "spcb_1": Cells("SPCB", {6: (0, 1, 2, 3, 4, 5)}, side="rescued", joined=" ", split_dates=True),
    "indian_1": Cells("INDIAN", {5: (0, 1, None, 2, 3, 4)}, joined=" ", cut=0, distinct=True),
    "union_1": Cells("UNION", {6: (1, 3, None, 4, None, 5)}, side="tag", skip=_OPENING, distinct=True),
    "union_text": Lines("UNION", rf"(?i)^\s*\d{{1,4}}\s+({_DMY})\s+[A-Z0-9]+\s+(.+?)\s+({_DECIMALS})\s+\((Cr|Dr)\)\s+({_DECIMALS}\s+\((?:Cr|Dr)\))\s*$", ("amount", "tag", "balance")),
    "icici_2": Lines(
        "ICICI Bank", rf"(\d{{2}}/\d{{2}}/\d{{4}})\s+\d{{2}}/\d{{2}}/\d{{4}}\s+(.+?)\s+({_DECIMALS})\s+({_DECIMALS})\s+(-?{_DECIMALS})", ("withdrawal", "deposit", "balance"), goes_on=True,
        stop=r"(?i)^\d+\.\s*[A-Z]{2,}|\bCAPTIONS\b|\bINFT\b|\bBPAY\b|\bBBPS\b|\bNEFT\b|\bIMPS\b|\bRTGS\b|\bUPI\b\s*-\s*|\bICICI\b|\bTRANSACTION\s+TYPE\b|\bSERVICE\b|\bCHARGES\b",
    ),
    "idbi_choicepoint": Lines("IDBI", rf"(?i)^\s*\d+\.\s+(\d{{2}}-[A-Za-z]{{3}}-\d{{2}})\s+(.*?)\s+({_DECIMALS})\s+(Cr|Dr)\s*$", ("amount", "tag")),
    "canara_1": Blocks(
        "CANARA", rf"\b({_DMY})\b.*\d", r"(-?\d[\d,]*\.\d{2})()", (rf"\b{_DMY}\b", rf"-?{_DECIMALS}", r"(?i)(\bDR\b|\bCR\b)\s*$"), credit=r"(?i)\bCR\b", debit=r"(?i)\bDR\b",
        noise=r"(?i)^(DATE PARTICULARS|PAGE )", started=r"(?i)^DATE PARTICULARS",
    ),
    "canara": Blocks("CANARA", rf"\b({_DMY})\b.*\d", r"(-?\d[\d,]*\.\d{2})()", (rf"\b{_DMY}\b", rf"-?{_DECIMALS}"), credit=r"(?i)\b(BY|DEPOSIT|CREDIT)\b", debit=r"(?i)\b(TO|WITHDRAWAL|DEBIT)\b", noise=r"(?i)^(DATE PARTICULARS|PAGE )"),
    "bandhan_1": Blocks(
        "BANDHAN", r"([A-Za-z]{3}\s*\d{1,2},\s*\d{4})", r"(?i)INR\s*([\d,]+\.\d{2})\s*(Dr|Cr)?", (r"[A-Za-z]{3}\s*\d{1,2},\s*\d{4}", r"(?i)INR\s*[\d,]+\.\d{2}\s*(Dr|Cr)?"),
        tail=r"(?i)(statement summary|opening balance|total credits|total debits|closing balance|statement generated|insurance|customer care|end of statement)", cut=180,
    ),
    "sbi_3": Blocks(
        "SBI Bank", r"^\d{1,2} [A-Za-z]{3} \d{4}\s+(\d{1,2} [A-Za-z]{3} \d{4})\s", rf"\b({_DECIMALS})\b()", (r"\d{1,2} [A-Za-z]{3} \d{4}", _DECIMALS), debit=r"^\d{1,2} \w{3} \d{4}\s+\d{1,2} \w{3} \d{4}\s+TO|/DR/", credit=".",
        noise=r"(?i)Txn Date|Value Date|Debit Credit Balance|computer generated|do not share your ATM", reference=r"(UPI/(?:CR|DR)/\d+)",
    ),
    "spcb_3": Blocks(
        "SPCB", r"^(\d{2}/\d{2}/\d{2})\s+\d{2}/\d{2}/\d{2}", r"(\d[\d,]*\.\d{2})\s*(Cr|Dr|CR|DR)?", (r"^\d{2}/\d{2}/\d{2}\s+\d{2}/\d{2}/\d{2}\s*", r"(?:\d[\d,]*\.\d{2}\s*(?:Cr|Dr|CR|DR)?\s*)+$"), cut=85,
        credit=r"(?i)BALANCE\s+(TRANSFER|BROUGHT\s+FORWARD)|/CR\b", hints=(r"(?i)(NEFT|RTGS|IMPS|BY|FROM|RECEIVED|CREDIT|DEPOSIT)\b", r"(?i)(WITHDRAWAL|ATM|BILL|PAYMENT|CHG|CHARGES|TRANSFER\s+TO)\b"),
        default="credit", tolerance=0.02, tail=r"(?i)(CARRIED\s+FORWARD:|Statement\s+Summary|Dr\.\s*Count\s*\d+)",
    ),
}


def words_to_cells(words: DataFrame, bounds: list[float], line: str = "line") -> DataFrame:
    """file, seq and cells of words (file, line, text, x0, x1): each word goes to the column that its middle lies in, in order of x0."""
    inside = words.withColumn("_c", column_of((F.col("x0") + F.col("x1")) / 2, bounds)).where(F.col("_c").between(0, len(bounds) - 2))
    return lines_of_cells(inside.withColumnRenamed(line, "seq"), len(bounds) - 1)


def column_of(middle: Column, bounds: list[float]) -> Column:
    """Number of the column that a place lies in; -1 left of all, the number of columns right of all."""
    return reduce(lambda n, edge: n + (middle >= F.lit(float(edge))).cast("int"), bounds, F.lit(-1))


def column_below(middle: Column, width: int) -> Column:
    """The same by the `edges` of a header of so many columns; edges passed are bits, as sums of whole numbers are checked for overflow one by one."""
    passed = (F.when(F.get("edges", i) <= middle, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(width + 1))
    return F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), passed)).cast("int") - 1


def cells_of(placed: Column, width: int) -> Column:
    """The cells of a line's words (_c, text) in order: of each column the texts between blanks."""
    cell = lambda i: F.array_join(F.filter(placed, lambda w: w["_c"] == i)["text"], " ")
    return F.array(*map(cell, range(width)))


def lines_of_cells(words: DataFrame, width: int) -> DataFrame:
    """file, seq and cells of words with their column number _c: one group for each line, from which its cells are taken."""
    lines = words.groupBy("file", "seq").agg(F.sort_array(F.collect_list(F.struct("x0", "text", "_c"))).alias("_w"))
    return computed_once(lines, {"cells": cells_of(F.col("_w"), width)}).select("file", "seq", "cells")


def header_edges(hits: Column, names: list[str], margin: float) -> Column:
    """The left edges of a header's columns, each by `margin` before its word, and a far right edge; null if a name is missing among hits (label, x0)."""
    at = lambda name: F.array_min(F.transform(F.filter(hits, lambda h: h["label"] == name), lambda h: h["x0"])) - margin
    whole = F.size(F.array_distinct(F.transform(hits, lambda h: h["label"]))) == len(names)
    return F.when(whole, F.array(*map(at, names), F.lit(1e9)))


def headed_lines(words: DataFrame, labels: list[str], margin: float = 5.0) -> DataFrame:
    """file, line, edges and _w, its words from left to right, of the lines below each file's header, the first line that has all labels.

    edges: the left edges of the header's columns, each by `margin` before its word, and a far right edge. Words meet the header as lists of their
    lines, by a window over the file, so nothing is joined and words are made once.
    """
    names = [x.upper() for x in labels]
    upper = F.upper("text")
    hit = F.when(upper.isin(names), F.struct(upper.alias("label"), "x0"))
    lines = words.where("line is not null").groupBy("file", "line").agg(F.sort_array(F.collect_list(F.struct("x0", "text", "x1", "top", "page"))).alias("_w"), F.collect_list(hit).alias("_h"))
    lines = lines.withColumn("_own", F.when(F.size("_h") >= len(names), header_edges(F.col("_h"), names, margin)))
    edges = F.first("_own", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumn("edges", edges).where("edges is not null").select("file", "line", "edges", "_w")


def words_below_header(words: DataFrame, labels: list[str]) -> DataFrame:
    """Words (file, page, line, text, x0, x1, top) below each file's header with the number of their column, _c; words left of all columns go."""
    names = [x.upper() for x in labels]
    # Few words pass the pattern, so few are put in capitals; those that it cannot judge pass too.
    likely = F.col("text").rlike(rf"(?i)^(?:{'|'.join(map(re.escape, names))})$|[^\x00-\x7f]")
    upper = F.upper(F.when(likely, F.col("text")))
    own = words.where("line is not null").withColumn("_hit", F.when(upper.isin(names), F.struct(upper.alias("label"), "x0"))).withColumn("_h", F.collect_list("_hit").over(Window.partitionBy("file", "line")))
    own = own.withColumn("_own", F.when(F.size("_h") >= len(names), header_edges(F.col("_h"), names, 5.0))).drop("_hit", "_h")
    edges = F.first("_own", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rangeBetween(Window.unboundedPreceding, -1))
    below = own.withColumn("edges", edges).where("edges is not null").select("file", "page", "line", "text", "x0", "x1", "top", "edges")
    return computed_once(below, {"_c": column_below((F.col("x0") + F.col("x1")) / 2, len(labels))}).where("_c >= 0").drop("edges")


def words_to_header_cells(words: DataFrame, labels: list[str]) -> DataFrame:
    """file, seq and cells of the words below each file's header, by the header's own columns; lines without words in them go."""
    column = lambda w: column_below((w["x0"] + w["x1"]) / 2, len(labels))
    placed = computed_once(headed_lines(words, labels), {"_w": F.transform("_w", lambda w: F.struct(column(w).alias("_c"), w["text"].alias("text")))})
    placed = placed.where(F.exists("_w", lambda w: w["_c"] >= 0))
    return computed_once(placed, {"cells": cells_of(F.col("_w"), len(labels))}).select("file", F.col("line").alias("seq"), "cells")


def statement(name: str, rows: DataFrame) -> DataFrame:
    """Statement rows of a named layout from cells (file, seq, cells) or lines (file, seq, line).

    Rows and lines that fit nothing are left out; an amount that is missing is 0, a balance that is not printed null.
    """
    layout = LAYOUTS[name]
    rows = with_years(rows) if name == "sbi_3" else rows
    return {Cells: cell_statement, Lines: line_statement, Blocks: block_statement}[type(layout)](rows, layout)


def _order() -> Window:
    return Window.partitionBy("file").orderBy("seq")


def _amount(text: Column) -> Column:
    return F.abs(parse_money(F.regexp_replace(text, r"[()]", " ")))


def _signed(text: Column) -> Column:
    """A balance: Dr, with brackets or not, is below zero."""
    return parse_money(F.regexp_replace(text, r"\(\s*((?i)cr|dr)\s*\)", "$1"))


def likely_amount(cell: Column, change: Column, tolerance: float = 0.005) -> Column:
    """Of the numbers in a cell the one that the balance's change agrees with, else the last with decimals, the last with separators, the last of four digits or fewer."""
    healed = F.regexp_replace(F.regexp_replace(cell, r"(\d)\s*,\s*(\d{3})", "$1,$2"), r"(\d)\s*\.\s*(\d{2})\b", "$1.$2")
    every = lambda pattern: F.transform(F.regexp_extract_all(healed, F.lit(pattern), F.lit(0)), lambda t: F.regexp_replace(t, ",", "").try_cast("decimal(18,2)"))
    numbers = every(r"\d[\d,]*(?:\.\d+)?")
    agreeing = F.filter(numbers, lambda v: F.abs(v - F.abs(change)) <= tolerance)
    last = lambda pattern: F.try_element_at(every(pattern), F.lit(-1))
    return F.coalesce(F.get(agreeing, 0), last(r"(?<![\d.,])\d[\d,]*\.\d+"), last(r"(?<![\d.,])\d{1,3}(?:,\d{2,3})+(?![\d.])"), last(r"(?<![\d.,])\d{1,4}(?![\d.,])"))


def _filled(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    return rows.withColumns({"withdrawal": F.coalesce("withdrawal", zero), "deposit": F.coalesce("deposit", zero)}).select("file", "seq", "txn_date", "narration1", "narration2", "withdrawal", "deposit", "balance")


def _narrations(narration: Column, reference: Column, cut: int, between: str) -> dict[str, Column]:
    """The first `cut` characters, and the rest with the reference behind it; 0 leaves the narration whole."""
    text, ref = collapse(F.coalesce(narration, F.lit(""))), collapse(F.coalesce(reference, F.lit("")))
    rest = F.substr(text, F.lit(cut + 1)) if cut else F.lit("")
    return {"narration1": strip(F.substring(text, 1, cut)) if cut else text, "narration2": strip(F.when((ref == "") | (rest == ""), F.concat(rest, ref)).otherwise(F.concat(rest, F.lit(between), ref)))}


def cell_statement(rows: DataFrame, layout: Cells) -> DataFrame:
    """Rows of cells in order of seq; a file's rows may have any of the layout's widths.

    spilled: an amount that slid into the reference is a withdrawal. repaired: one amount on the side that the balance contradicts changes
    sides; without any, the change of the balance is the amount. rescued: the same, and of several numbers in an amount's cell the one that the balance agrees
    with counts. split_dates: a day and month whose year stands in the row below are one date.
    """
    get = lambda i: F.get("cells", i) if i is not None else F.lit(None).cast("string")
    width = F.size("cells")
    place = lambda k: reduce(lambda out, it: F.when(width == it[0], get(it[1][k])).otherwise(out), layout.at.items(), F.lit(None).cast("string"))
    names = ["date", "narration", "reference", "out", "in", "end"]
    parts = computed_once(rows.where(width.isin(list(layout.at))).select("file", "seq", "cells"), {n: strip(F.coalesce(place(k), F.lit(""))) for k, n in enumerate(names)}).drop("cells")
    parts = parts.where(reduce(lambda a, b: a | b, (F.col(n) != "" for n in names)))
    if layout.split_dates:
        day, year = r"^\d{1,2}-([A-Za-z]{3}|\d{1,2})-$", r"^\d{4}$"
        below, above = F.lead("date").over(_order()), F.lag("date").over(_order())
        parts = parts.withColumn("date", F.when(F.col("date").rlike(day) & below.rlike(year), F.concat("date", below)).when(F.col("date").rlike(year) & above.rlike(day), F.lit("")).otherwise(F.col("date")))
    dated = parse_date(F.col("date")).isNotNull() & (F.col("date").rlike(f"^{layout.dates}$") if layout.dates else F.lit(True))
    if layout.joined is None:
        parts = parts.where(dated)
    else:
        block = F.sum(dated.cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0))
        lists = F.sort_array(F.collect_list(F.struct("seq", *names)))
        whole = parts.withColumn("_block", block).where("_block > 0").groupBy("file", "_block").agg(lists.alias("_l"))
        glue = lambda n: F.array_join(F.array_remove(F.col("_l")[n], ""), layout.joined).alias(n)
        parts = whole.select("file", F.get("_l", 0)["seq"].alias("seq"), *(F.get("_l", 0)["date"].alias("date") if n == "date" else glue(n) for n in names))
    if layout.skip:
        noise = F.concat_ws(" ", "narration", "reference").rlike(layout.skip)
        parts = parts.withColumn("_noise", noise)
    parts = computed_once(parts, {"txn_date": parse_date(F.col("date"))} | _narrations(F.col("narration"), F.col("reference"), layout.cut, layout.between))
    parts = computed_once(parts, {"balance": _signed(F.col("end")), "_out": _amount(F.col("out")), "_in": _amount(F.col("in"))})
    out, in_ = F.col("_out"), F.col("_in")
    before = F.last("balance", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    change = F.col("balance") - F.coalesce(before, F.lit(0))
    if layout.side == "delta":
        amount = F.greatest(F.coalesce(out, F.lit(0)), F.coalesce(in_, F.lit(0)))
        parts = parts.withColumns({"withdrawal": F.when(change <= 0, amount), "deposit": F.when(change > 0, amount)})
    elif layout.side == "sign":
        minus = F.col("out").rlike(r"(?i)dr|^\s*-")
        parts = parts.withColumns({"withdrawal": F.when(minus, out), "deposit": F.when(~minus, out)})
    elif layout.side == "tag":
        near = lambda sign: F.abs(F.col("balance") - before - sign * out) <= layout.tolerance
        credit = F.col("out").rlike(r"(?i)cr")
        debit = ~credit & F.col("out").rlike(r"(?i)dr")
        parts = parts.withColumns({"withdrawal": F.when(debit | (~credit & near(-1)), out), "deposit": F.when(credit | (~debit & near(1)), out)})
    elif layout.side == "spilled":  # an amount that slid into the reference belongs to the withdrawals
        slid = (F.col("out") == "") & F.col("reference").rlike(rf"^-?{_DECIMALS}$")
        parts = parts.withColumns({"withdrawal": F.when(slid, _amount(F.col("reference"))).otherwise(out), "deposit": in_, "narration2": F.when(slid, F.lit("")).otherwise(F.col("narration2"))})
    elif layout.side in ("repaired", "rescued"):
        known = F.when(before.isNotNull(), F.col("balance") - before)
        if layout.side == "rescued":
            parts = parts.withColumn("_known", known)
            known = F.col("_known")
            out, in_ = likely_amount(F.col("out"), known), likely_amount(F.col("in"), known)
        w, d = F.coalesce(out, F.lit(0)), F.coalesce(in_, F.lit(0))
        wrong = ((known > 0) & (w > 0) & (d == 0)) | ((known < 0) & (d > 0) & (w == 0))
        none = (w == 0) & (d == 0)
        kind = "decimal(18,2)"
        parts = parts.withColumns({
            "withdrawal": F.when(wrong, d).when(none & (known < 0), -known).otherwise(w).cast(kind),
            "deposit": F.when(wrong, w).when(none & (known > 0), known).otherwise(d).cast(kind),
        })
    else:
        parts = parts.withColumns({"withdrawal": out, "deposit": in_})
    if layout.skip:  # an opening balance counts as the one before, but is no entry
        parts = parts.where("not _noise")
    if layout.skip_last:
        parts = parts.withColumn("_last", F.lead("seq").over(_order()).isNull()).where("not _last")
    rows_ = _filled(parts)
    if layout.distinct:
        same = ["file", "txn_date", "narration1", "narration2", "withdrawal", "deposit", "balance"]
        rows_ = rows_.groupBy(*same).agg(F.min("seq").alias("seq")).select(rows_.columns)
    return rows_


def line_statement(lines: DataFrame, layout: Lines) -> DataFrame:
    """Lines that the pattern reads; with goes_on, lines without an amount after one continue its narration until a line of `stop`."""
    hit = F.col("line").rlike(layout.pattern)
    if layout.goes_on:
        order = _order().rowsBetween(Window.unboundedPreceding, 0)
        block = F.sum(hit.cast("int")).over(order)
        marked = lines.withColumn("_hit", hit).withColumn("_block", block).where("_block > 0")
        stopped = F.max(~F.col("_hit") & F.col("line").rlike(layout.stop)).over(Window.partitionBy("file", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        kept = marked.withColumn("_stopped", stopped).where("_hit or (not _stopped and not line rlike '[0-9]+[.][0-9]{2}')")
        lists = kept.groupBy("file", "_block").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("_l"))
        rest = F.array_join(F.transform(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), lambda x: strip(x["line"])), " ")
        rows = lists.select("file", F.get("_l", 0)["seq"].alias("seq"), F.get("_l", 0)["line"].alias("line"), rest.alias("_rest"))
    else:
        rows = lines.where(hit).select("file", "seq", "line", F.lit("").alias("_rest"))
    group = lambda i: F.regexp_extract("line", layout.pattern, i)
    at = {n: group(i + 3) for i, n in enumerate(layout.groups)}
    money = {n: parse_money(at[n]) for n in ("withdrawal", "deposit") if n in at}
    if "tag" in at:
        credit = F.lower(at["tag"]) == "cr"
        money = {"withdrawal": F.when(~credit, parse_money(at["amount"])), "deposit": F.when(credit, parse_money(at["amount"]))}
    balance = _signed(at["balance"]) if "balance" in at else F.lit(None).cast("decimal(18,2)")
    narration = collapse(F.concat_ws(" ", group(2), "_rest"))
    return _filled(rows.select("file", "seq", parse_date(group(1)).alias("txn_date"), narration.alias("narration1"), F.lit("").alias("narration2"), *(c.alias(n) for n, c in money.items()), balance.alias("balance")).where("txn_date is not null"))


def block_statement(lines: DataFrame, layout: Blocks) -> DataFrame:
    """Blocks of lines that begin where `start` matches; what comes before the first one is no entry."""
    kept = lines
    if layout.started:
        begun = F.max(F.col("line").rlike(layout.started)).over(_order().rowsBetween(Window.unboundedPreceding, 0))
        kept = kept.withColumn("_begun", begun).where("_begun").drop("_begun")
    kept = kept.where(~F.col("line").rlike(layout.noise)) if layout.noise else kept
    blocks = line_blocks(kept, ["file"], "seq", F.col("line").rlike(layout.start)).withColumnRenamed("block", "seq")
    text = collapse(F.col("text"))  # each step below is computed once, as filters and later columns use it
    if layout.tail:
        text = strip(F.get(F.split(text, layout.tail, 2), 0))
    blocks = computed_once(blocks, {"text": text}).select("file", "seq", "text")
    found = computed_once(blocks, {"_v": F.regexp_extract_all("text", F.lit(layout.amount), F.lit(1)), "_t": F.regexp_extract_all("text", F.lit(layout.amount), F.lit(2))}).where("size(_v) > 0")
    n = F.size("_v")
    last, tag = F.get("_v", n - 1), F.lower(F.get("_t", n - 1))
    amount = F.when(n > 1, parse_money(F.get("_v", n - 2)))
    own = F.lower(F.when(n > 1, F.get("_t", n - 2)))
    end = parse_money(last)
    found = computed_once(found, {"_end": end, "_amount": amount, "_tag": own, "_last_tag": tag}).withColumn("balance", F.when(F.col("_last_tag") == "dr", -F.col("_end")).otherwise(F.col("_end")))
    change = F.col("balance") - F.lag("balance").over(_order())
    says = lambda p: F.col("text").rlike(p) if p else F.lit(False)
    yes, no = says(layout.credit), says(layout.debit)
    told = F.when(yes & ~no, "credit").when(no & (~yes | F.lit(layout.credit == ".")), "debit")
    by_change = F.when(change > 0, "credit").when(change < 0, "debit")
    if layout.tolerance is not None:
        by_change = F.when(F.abs(F.abs(change) - F.col("_amount")) <= layout.tolerance, by_change)
    hinted = F.when(says(layout.hints[0]), "credit").when(says(layout.hints[1]), "debit")
    by_tag = F.when(F.col("_tag") == "cr", "credit").when(F.col("_tag") == "dr", "debit")
    found = found.withColumn("_side", F.coalesce(told, by_tag, by_change, hinted, F.lit(layout.default)))
    narration = reduce(lambda t, p: F.regexp_replace(t, p, ""), layout.gone, F.col("text"))
    narration = F.regexp_replace(collapse(narration), r"^[ \-:/]+|[ \-:/]+$", "")
    reference = F.regexp_extract(narration, layout.reference, 1) if layout.reference else F.lit("")
    if layout.reference:
        narration = collapse(F.regexp_replace(narration, layout.reference, ""))
    date = F.regexp_extract("text", layout.start, layout.date_group)
    named = _narrations(narration, reference, layout.cut, "")
    return _filled(found.select("file", "seq", parse_date(date).alias("txn_date"), *(c.alias(k) for k, c in named.items()), F.when(F.col("_side") == "debit", F.col("_amount")).alias("withdrawal"), F.when(F.col("_side") == "credit", F.col("_amount")).alias("deposit"), "balance").where("txn_date is not null"))


_MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
# A period that a statement prints, and lines whose dates have no year.
PRINTED_PERIOD = r"(?i)Account Statement from .*?([A-Za-z]{3})[a-z]* (\d{4}).*?to .*?\d{4}"
SHORT_DATES = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{1,2}) ([A-Za-z]{3}) (?!\d{4}\b)(.+)$"
FULL_DATES = r"^\d{1,2} ([A-Za-z]{3}) (\d{4})\b"


def with_years(lines: DataFrame) -> DataFrame:
    """Lines (file, seq, line) whose two short dates (10 Apr 11 Apr ...) got their years.

    The year is carried along a file: from the period that its head prints, one more whenever the month falls back, and anew from every line with a whole
    date. A value date more than half a year away from its entry is in the year beside. Years that stand before a line that goes on are dropped;
    files without any year keep their lines.
    """
    month = lambda c: F.try_element_at(F.create_map(*(F.lit(x) for pair in _MONTHS.items() for x in pair)), F.upper(c))
    part = lambda p, i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    lines = lines.withColumn("line", F.regexp_replace(collapse(F.col("line")), r"^20\d{2} 20\d{2} ", ""))
    lines = lines.withColumns({"_m": F.coalesce(month(part(SHORT_DATES, 2)), month(part(FULL_DATES, 1))), "_full": part(FULL_DATES, 2).try_cast("int"), "_head_m": month(part(PRINTED_PERIOD, 1)), "_head_y": part(PRINTED_PERIOD, 2).try_cast("int")})
    so_far = _order().rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.last("_m", ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_turn", F.coalesce((F.col("_m") < earlier).cast("int"), F.lit(0)))
    lines = lines.withColumn("_turns", F.sum("_turn").over(so_far))
    base = F.last(F.col("_full") - F.col("_turns"), ignorenulls=True).over(so_far)
    first, head_m, head_y = (F.first(c, ignorenulls=True).over(so_far) for c in ("_m", "_head_m", "_head_y"))
    year = F.col("_turns") + F.coalesce(base, head_y + (first < head_m).cast("int"))
    lines = lines.withColumns({"_y": year, "_vm": month(part(SHORT_DATES, 4))})
    beside = F.col("_y") + F.when(F.col("_vm") - F.col("_m") > 6, -1).when(F.col("_m") - F.col("_vm") > 6, 1).otherwise(0)
    whole = F.concat_ws(" ", part(SHORT_DATES, 1), part(SHORT_DATES, 2), F.col("_y").cast("string"), part(SHORT_DATES, 3), part(SHORT_DATES, 4), beside.cast("string"), part(SHORT_DATES, 5))
    return lines.withColumn("line", F.when(F.col("_vm").isNotNull() & F.col("_y").isNotNull(), whole).otherwise(F.col("line"))).select("file", "seq", "line")


def keyword_rows(rows: DataFrame, words: list[str], least: int = 3) -> DataFrame:
    """file, seq and word of rows of at least so many cells that name one of the words, the first of those it names."""
    text = F.lower(F.array_join("cells", " "))
    word = F.coalesce(*(F.when(F.contains(text, F.lit(w.lower())), F.lit(w)) for w in words))
    return rows.where(F.size("cells") >= least).select("file", "seq", word.alias("word")).where("word is not null")
