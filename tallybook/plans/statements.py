"""One query for each statement layout: statements are printed from the orders, read back, and compared with what was printed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.operators import layouts as L
from tallybook.operators import pages as P
from tallybook.operators import statements as T
from tallybook.session import dealt, table

QUERIES, ORACLES = {}, {}
#: How each layout's files are printed: cells, lines or words.
PRINTED: dict[str, Callable[[DataFrame], DataFrame]] = {}

LONG = " INVOICES OF MONTH AND GOODS SENT ON WITH LOT NUMBERS NINETY ONE NINETY TWO NINETY THREE NINETY FOUR"
TX = f"""tx AS (SELECT o_custkey AS file, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS total, o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderstatus = 'F' AS dr,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amt, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS bal,
  'ITEM ' || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '{LONG}' ELSE '' END AS narr, 'R' || o_orderkey AS ref
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def expected(n1: str = "narr", n2: str = "ref", bal: str = "bal", day: str = "d", where: str = "") -> str:
    return f"WITH {TX} SELECT file, {day} AS txn_date, {n1} AS narration1, {n2} AS narration2, CASE WHEN dr THEN amt ELSE 0 END AS withdrawal, CASE WHEN dr THEN 0 ELSE amt END AS deposit, {bal} AS balance FROM tx {where}"


def cut(n: int = 90, between: str = "  ", ref: str = "ref") -> dict[str, str]:
    rest = f"substr(narr, {n + 1})"
    return {"n1": f"trim(left(narr, {n}))", "n2": f"trim(CASE WHEN {ref} = '' OR {rest} = '' THEN {rest} || {ref} ELSE {rest} || '{between}' || {ref} END)"}


#: Orders that one task prints and reads at most, but for chance and large files: what they print is some hundred times as large.
ORDERS = 25_000


def transactions(spark, sf) -> DataFrame:
    """Entries of the orders, dealt by file to as many tasks as there are ORDERS of them; what follows keeps a file in its task.

    The window is over `file` itself, so that a filter on it is applied below: who reads some files orders and sums those only.
    """
    o = dealt(table(spark, sf, "orders").withColumnRenamed("o_custkey", "file"), ORDERS, "file")
    w = Window.partitionBy("file").orderBy("o_orderdate", "o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    signed = F.when(F.col("o_orderstatus") == "F", -amount).otherwise(amount)
    k = F.col("o_orderkey")
    return o.select(
        "file", F.row_number().over(w).alias("n"), k.alias("k"), F.to_date("o_orderdate").alias("d"), (F.col("o_orderstatus") == "F").alias("dr"),
        amount.alias("amt"), F.sum(signed).over(w).cast("decimal(18,2)").alias("bal"), F.concat(F.lit("ITEM "), k.cast("string"), F.when(k % 4 == 0, LONG).otherwise("")).alias("narr"), F.concat(F.lit("R"), k.cast("string")).alias("ref"),
    )


# How a field is printed
def day(form: str) -> Column:
    return F.date_format("d", form)


def money(c: str = "amt") -> Column:
    return F.format_number(F.abs(F.col(c)), 2)


def side(wanted: bool, other: str = "") -> Column:
    return F.when(F.col("dr") == wanted, money()).otherwise(other)


OUT, IN = lambda other="": side(True, other), lambda other="": side(False, other)
BALANCE = lambda: F.concat(money("bal"), F.when(F.col("bal") < 0, " Dr").otherwise(" Cr"))
MINUS = lambda: F.concat(F.when(F.col("bal") < 0, "-").otherwise(""), money("bal"))


def cells(tx: DataFrame, *rows: list) -> DataFrame:
    """One or more rows of cells for each transaction; a row is a list of columns and texts, or (condition, list)."""
    made = []
    for i, row in enumerate(rows):
        when, row = row if isinstance(row, tuple) else (F.lit(True), row)
        made.append(F.when(when, F.struct((F.col("n") * 10 + i).alias("seq"), F.array(*(c if isinstance(c, Column) else F.lit(c) for c in row)).alias("cells"))))
    # Rows that are not printed are dropped behind the generator: a lambda inside it would keep all the printing out of generated code.
    return tx.select("file", F.explode(F.array(*made)).alias("r")).where("r is not null").select("file", "r.seq", "r.cells")


def lines(tx: DataFrame, *texts: Column | tuple) -> DataFrame:
    rows = [(t[0], [t[1]]) if isinstance(t, tuple) else [t] for t in texts]
    return cells(tx, *rows).select("file", "seq", F.get("cells", 0).alias("line"))


def words(rows: DataFrame, bounds: list[float], labels: list[str] | None = None) -> DataFrame:
    """The words of cells as a page gives them: 15 entries to a page, 12 units from line to line, words of a line not quite level, no line numbers.

    Words stand inside their columns; labels, which are a header's, at the left of theirs.
    """
    each = rows.select("file", "seq", F.posexplode("cells").alias("c", "cell")).where("cell <> ''").select("*", F.posexplode(F.split("cell", " ")).alias("i", "text"))
    edges = F.array(*map(F.lit, map(float, bounds)))
    left, right = F.get(edges, F.col("c")), F.get(edges, F.col("c") + 1)
    m = F.length("cell") - F.length(F.replace(F.col("cell"), F.lit(" "), F.lit(""))) + 1
    x = left + (F.least(right, left + 200.0) - left) * (F.col("i") + 1) / (m + 1)
    if labels:
        x = F.when(F.col("cell").isin(labels), left).otherwise(x)
    entry = F.expr("seq DIV 10 - 1")
    top = (entry % 15) * 60 + (F.col("seq") % 10) * 12 + ((F.col("c") + F.col("i")) % 3) * 0.6
    return each.select("file", F.expr("cast(1 + (seq DIV 10 - 1) DIV 15 as int)").alias("page"), "text", x.alias("x0"), x.alias("x1"), top.cast("double").alias("top"))


def layout(name: str, sql: str) -> Callable:
    """Register statement_<name>: the printed rows go through the layout and come back in whole cents."""

    def register(function: Callable[[DataFrame], DataFrame]) -> Callable:
        def run(spark, sf) -> DataFrame:
            printed = function(transactions(spark, sf))
            out = P.words_statement(name, printed) if name in P.WORDS else L.statement(name, printed)
            cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
            return out.select("file", "txn_date", "narration1", "narration2", *map(cents, ("withdrawal", "deposit", "balance")))

        QUERIES[f"statement_{name}"], ORACLES[f"statement_{name}"], PRINTED[name] = run, sql, function
        return function

    return register


@layout("axis_1", expected(**cut(), where="WHERE n < total"))
def _(tx):
    return cells(tx, (F.col("n") == 1, ["Tran Date", "Chq No", "Particulars", "Debit", "Credit", "Balance", "Init"]), [day("dd-MM-yyyy"), F.col("ref"), F.col("narr"), OUT(), IN(), BALANCE(), "17"])


@layout("bom_1", expected())
def _(tx):
    return cells(tx, (F.col("n") == 1, ["Sr No", "Date", "Particulars", "Chq", "Debit", "Credit", "Balance", "Channel"]), [F.col("n").cast("string"), day("dd/MM/yyyy"), F.col("narr"), F.col("ref"), OUT("-"), IN("-"), BALANCE(), "NET"])


@layout("sutex_1", expected(**cut(between=" - ")))
def _(tx):
    return cells(tx, [day("d/M/yyyy"), F.col("narr"), F.col("ref"), OUT("-"), IN("-"), BALANCE()])


@layout("icici_1", expected(**cut()))
def _(tx):
    return cells(tx, (F.col("n") == 1, [day("dd-MM-yyyy"), "Opening Balance", "", "", "", "0.00"]), [day("dd-MM-yyyy"), F.col("ref"), F.col("narr"), IN(), OUT(), BALANCE()])


@layout("sbi_1", expected(**cut()))
def _(tx):
    return cells(tx, [day("dd-MM-yyyy"), F.col("narr"), F.col("ref"), money(), "-", MINUS()])


@layout("hdfc_1", expected())
def _(tx):
    head, tail = F.substring("narr", 1, 3), F.expr("substring(narr, 4)")
    return cells(tx, (F.col("n") == 1, ["Date", "Narration", "Ref", "Value", "Out", "In", "Closing"]), [day("dd/MM/yyyy"), head, F.col("ref"), day("dd/MM/yyyy"), OUT(), IN(), BALANCE()], ["", tail, "", "", "", "", ""])


@layout("bob_1", expected())
def _(tx):
    head = lambda *texts: (F.col("n") == 1, list(texts))
    end = [F.col("narr"), F.col("ref"), OUT("-"), IN("-"), BALANCE()]
    own = [
        ("bob_6", [head("DATE", "NARRATION", "CHQ.NO.", "", "", ""), [day("dd-MM-yyyy"), *end]]),
        ("bob_7", [head("TRAN DATE", "VALUE DATE", "NARRATION", "", "", "", ""), [day("dd-MM-yyyy"), day("dd-MM-yyyy"), *end]]),
        ("bob_8", [head("Serial", "Transaction", "Value", "Description", "", "", "", ""), [F.col("n").cast("string"), day("dd-MM-yyyy"), day("dd-MM-yyyy"), *end]]),
    ]
    made = [words(cells(tx.where(F.col("file") % 3 == i), *rows), L.BOUNDS[key]) for i, (key, rows) in enumerate(own)]
    return made[0].unionByName(made[1]).unionByName(made[2])


@layout("bob_2", expected(**cut()))
def _(tx):
    return cells(tx, [F.col("n").cast("string"), day("dd/MM/yyyy"), day("dd/MM/yyyy"), F.substring("narr", 1, 3), F.col("ref"), OUT(), IN(), BALANCE()], ["", "", "", F.expr("substring(narr, 4)"), "", "", "", ""])


@layout("sarvodaya_1", expected(**cut()))
def _(tx):
    return cells(tx, [day("dd/MM/yyyy"), F.col("narr"), F.col("ref"), day("dd/MM/yyyy"), "T1", OUT(), IN(), BALANCE()])


@layout("kalupur_1", expected(n2="''"))
def _(tx):
    bounds = L.BOUNDS["kalupur"]
    return words(cells(tx, ["Date", "Value", "Mode", "Particulars", "Debit", "Credit", "Balance"], [day("dd/MM/yyyy"), day("dd/MM/yyyy"), "TR", F.col("narr"), OUT(), IN(), BALANCE()]), bounds)


@layout("spcb_2", expected())
def _(tx):
    return words(cells(tx, [day("dd-MMM-yyyy"), day("dd-MMM-yyyy"), F.col("narr"), F.col("ref"), OUT(), IN(), BALANCE()]), L.BOUNDS["spcb_2"])


@layout("kotak_1", expected(n1="narr || ' MORE'"))
def _(tx):
    amount = F.concat(money(), F.when(F.col("dr"), "(Dr)").otherwise("(Cr)"))
    printed = cells(tx, [day("dd-MM-yyyy"), F.col("narr"), F.col("ref"), amount, F.concat(money("bal"), F.when(F.col("bal") < 0, "(Dr)").otherwise("(Cr)"))], ["", "MORE", "", "", ""])
    return words(printed, L.BOUNDS["kotak_1"])


@layout("kotak_2", expected(n2="CASE WHEN dr AND k % 5 = 0 THEN '' ELSE ref END"))
def _(tx):
    labels, slid = list(P.WORDS["kotak_2"].labels), F.col("dr") & (F.col("k") % 5 == 0)
    printed = cells(tx, (F.col("n") == 1, labels), [day("dd MMM yyyy"), F.col("narr"), F.when(slid, money()).otherwise(F.col("ref")), F.when(~slid, OUT()).otherwise(""), IN(), MINUS()])
    return words(printed, L.BOUNDS["kotak_2"], labels)


@layout("sbi_2", expected(n1="narr || ' MORE'"))
def _(tx):
    labels = list(P.WORDS["sbi_2"].labels)
    printed = cells(tx, (F.col("n") == 1, ["BANK", "OF", "", "", "", ""]), (F.col("n") == 1, labels), [day("d/M/yyyy"), F.col("narr"), F.col("ref"), OUT(), IN(), MINUS()], ["", "MORE", "", "", "", ""])
    return words(printed, [20, 110, 420, 520, 600, 700, 900], labels)


@layout("pnb_1", expected(n1="CASE WHEN n = 1 THEN 'TO SELF ' ELSE '' END || narr || CASE WHEN k % 9 = 0 THEN ' BY CASH' ELSE '' END"))
def _(tx):
    labels, first, swapped = list(P.WORDS["pnb_1"].labels), F.col("n") == 1, F.col("k") % 6 == 0
    out, in_ = F.when(swapped, IN()).otherwise(OUT()), F.when(swapped, OUT()).otherwise(IN())
    printed = cells(
        tx, (first, labels), (first, [day("dd-MM-yyyy"), "", "", "", "0.00", "OPENING BALANCE"]), (first, [day("dd-MM-yyyy"), "", "", "", "", "TO SELF"]),
        ["", "", "", "", "", F.substring("narr", 1, 4)], [day("dd-MM-yyyy"), F.col("ref"), out, in_, BALANCE(), F.expr("substring(narr, 6)")], (F.col("k") % 9 == 0, [day("dd-MM-yyyy"), "", "", "", "", "BY CASH"]),
    )
    return words(printed, [20, 110, 200, 300, 400, 520, 900], labels)


@layout("spcb_1", expected(**cut()))
def _(tx):
    """Amounts left out, amounts behind a number that slid into their cell, and dates whose year stands a line lower."""
    later, split = F.col("n") > 1, F.col("k") % 3 == 0
    blank, slid = (F.col("k") % 7 == 0) & later, (F.col("k") % 4 == 1) & later
    shown = lambda c: F.when(blank, "").when(slid & (c != ""), F.concat(F.lit("191101.00 "), c, F.lit(" 7"))).otherwise(c)
    date = F.when(split, day("dd-MMM-")).otherwise(day("dd-MMM-yyyy"))
    return cells(tx, [date, F.col("narr"), F.col("ref"), shown(OUT()), shown(IN()), BALANCE()], (split, [day("yyyy"), "", "", "", "", ""]))


@layout("indian_1", expected(n2="''"))
def _(tx):
    inr = lambda c: F.when(c == "", "-").otherwise(F.concat(F.lit("INR "), c))
    row = [day("dd MMM yyyy"), F.col("narr"), inr(OUT()), inr(IN()), F.concat(F.lit("INR "), money("bal"), F.when(F.col("bal") < 0, " DR").otherwise(" CR"))]
    return cells(tx, row, row)


@layout("union_1", expected(n2="trim(substr(narr, 91))", n1="trim(left(narr, 90))"))
def _(tx):
    tag = F.when((F.col("k") % 2 == 0) | (F.col("n") == 1), F.when(F.col("dr"), " (Dr)").otherwise(" (Cr)")).otherwise("")
    balance = F.concat(money("bal"), F.when(F.col("bal") < 0, " (Dr)").otherwise(" (Cr)"))
    row = lambda tag: [F.col("n").cast("string"), day("dd/MM/yyyy"), F.col("ref"), F.col("narr"), F.concat(money(), tag), balance]
    return cells(tx, row(tag), row(F.when(F.col("dr"), " (Dr)").otherwise(" (Cr)")))  # printed again on the next page


@layout("union_text", expected(n2="''"))
def _(tx):
    tag = lambda c: F.when(c, "(Dr)").otherwise("(Cr)")
    return lines(tx, F.lit("S.No Date Transaction Id Remarks"), F.concat_ws(" ", F.col("n").cast("string"), day("dd/MM/yyyy"), F.col("ref"), F.col("narr"), money(), tag(F.col("dr")), money("bal"), tag(F.col("bal") < 0)))


@layout("icici_2", expected(n1="narr || ' MORE WORDS'", n2="''"))
def _(tx):
    first = F.concat_ws(" ", day("dd/MM/yyyy"), day("dd/MM/yyyy"), "narr", OUT("0.00"), IN("0.00"), MINUS())
    return lines(tx, first, F.lit("MORE"), F.lit("page total 12.00"), F.lit("WORDS"), F.lit("CAPTIONS"), F.lit("AFTER"))


@layout("idbi_choicepoint", expected(n2="''", bal="CAST(NULL AS BIGINT)", day="make_date(2000 + year(d) % 100, month(d), day(d))"))
def _(tx):
    return lines(tx, F.lit("Sr. Date Description Amount Type"), F.concat_ws(" ", F.concat(F.col("n").cast("string"), F.lit(".")), day("dd-MMM-yy"), "narr", money(), F.when(F.col("dr"), "Dr").otherwise("Cr")))


# Entries that no tag or word tells the side of, so that the change of the balance has to.
BARE, BARE_SQL = lambda: (F.col("k") % 5 == 0) & (F.col("n") > 1), "k % 5 = 0 AND n > 1"


@layout("canara_1", expected(n2="''"))
def _(tx):
    tag = F.when(F.col("dr"), "DR").otherwise("CR")
    first = F.col("n") == 1
    return lines(tx, (first, F.lit("01-01-1990 printed 5")), (first, F.lit("Date Particulars Deposits Withdrawals Balance")), F.concat_ws(" ", day("dd-MM-yyyy"), money(), MINUS()), F.col("narr"), (~BARE(), tag), F.lit("page 3"))


@layout("canara", expected(n1=f"CASE WHEN {BARE_SQL} THEN '' WHEN dr THEN 'TO ' ELSE 'BY ' END || narr", n2="''"))
def _(tx):
    said = F.when(BARE(), "").when(F.col("dr"), "TO ").otherwise("BY ")
    return lines(tx, F.concat_ws(" ", day("dd-MM-yyyy"), money(), MINUS()), F.concat(said, F.col("narr")))


@layout("bandhan_1", expected(n2="''"))
def _(tx):
    own = F.when(BARE(), "").when(F.col("dr"), " Dr").otherwise(" Cr")
    return lines(tx, F.concat_ws(" ", day("MMM d, yyyy"), "narr"), F.concat(F.lit("INR "), money(), own, F.lit(" INR "), BALANCE()), F.lit("Statement Summary 12"))


@layout("sbi_3", expected(n1="CASE WHEN dr THEN 'TO ' ELSE 'BY ' END || narr", n2="'UPI/' || CASE WHEN dr THEN 'DR/' ELSE 'CR/' END || k", bal="abs(bal)"))
def _(tx):
    """Every second file prints dates without a year wherever the period at its head and the turns of the calendar tell it."""
    said = F.when(F.col("dr"), "TO").otherwise("BY")
    upi = F.concat(F.lit("UPI/"), F.when(F.col("dr"), "DR/").otherwise("CR/"), F.col("k").cast("string"))
    before = F.lag("d").over(Window.partitionBy("file").orderBy("n"))
    turns = F.year("d") - F.year(before)
    plain = before.isNull() | ((turns == 0) & (F.month("d") >= F.month(before))) | ((turns == 1) & (F.month("d") < F.month(before)))
    short = plain & (F.col("file") % 2 == 0)
    tx = tx.withColumn("short", short)
    date = F.when(F.col("short"), F.concat_ws(" ", day("d MMM"), day("d MMM"))).otherwise(F.concat_ws(" ", day("d MMM yyyy"), day("d MMM yyyy")))
    head = F.concat(F.lit("Account Statement from "), day("d MMM yyyy"), F.lit(" to 31 Dec 2009"))
    return lines(tx, (F.col("n") == 1, head), F.concat_ws(" ", date, said, "narr", upi), F.concat_ws(" ", F.when(F.col("k") % 2 == 0, "2025 2025"), money(), money("bal")), F.lit("Txn Date Value Date"))


@layout("spcb_3", expected(n1="trim(left(narr, 85))", n2="trim(substr(narr, 86))", day="make_date(2000 + year(d) % 100, month(d), day(d))"))
def _(tx):
    tag = F.when((F.col("k") % 2 == 0) | (F.col("n") == 1), F.when(F.col("dr"), " Dr").otherwise(" Cr")).otherwise("")
    return lines(tx, F.concat_ws(" ", day("dd/MM/yy"), day("dd/MM/yy"), "narr", F.concat(money(), tag), BALANCE()), F.lit("CARRIED FORWARD: 12"))


# The text formats


def _text_query(name: str, sql: str, printed: Callable[[DataFrame], DataFrame]) -> None:
    def run(spark, sf) -> DataFrame:
        out = T.PARSERS[name](printed(transactions(spark, sf)))
        cents = lambda c: F.round(F.col(c) * 100).cast("long").alias(c)
        return out.select("file", "txn_date", "narration", *map(cents, ("withdrawal", "deposit", "balance")))

    QUERIES[f"statement_{name}"], ORACLES[f"statement_{name}"] = run, sql


_TEXT = f"WITH {TX} SELECT file, d AS txn_date, narr AS narration, CASE WHEN dr THEN amt ELSE 0 END AS withdrawal, CASE WHEN dr THEN 0 ELSE amt END AS deposit, bal AS balance FROM tx"
_text_query("tab", _TEXT, lambda tx: lines(tx, (F.col("n") == 1, F.lit("Account Name\tX")), F.concat_ws("\t", day("d/M/yyyy"), "narr", F.lit(""), OUT(), IN(), BALANCE())))
_text_query("html", _TEXT, lambda tx: lines(tx, (F.col("n") == 1, F.lit("<table><tr><th>Date</th></tr>")), F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", day("dd/MM/yyyy"), F.regexp_replace("narr", " ", "&nbsp;"), F.lit("&nbsp;"), OUT(), IN(), BALANCE()), F.lit("</td></tr>"))))
