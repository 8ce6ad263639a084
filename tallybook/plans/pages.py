"""Queries of mixed folders of statements, of page geometry and of the generic reader; all are printed from the orders and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.operators import generic as G
from tallybook.operators import layouts as L
from tallybook.operators import pages as P
from tallybook.plans import statements as S
from tallybook.plans.statements import BALANCE, IN, OUT, TX, cells, day, lines, money, words
from tallybook.session import dealt, table

QUERIES, ORACLES = {}, {}

# A mixed folder

#: What a page of each layout says of itself.
MARKS = {
    "axis_1": "Statement of Axis Account No 17", "bandhan_1": "Bandhan Bank\nTransaction Date Description Amount Dr / Cr Balance", "bob_1": "Main Account Holder Name : A B", "bom_1": "Website : www.bankofmaharashtra.in",
    "canara_1": "CANARA BANK", "hdfc_1": "Savings Account Details", "icici_1": "See www.icicibank.com", "icici_2": "Detailed Statement\nTransactions  List\nValue Date Transaction Date Remarks Withdrawal Deposit Balance",
    "idbi_choicepoint": "Sr. No. Date Description Amount Type\n1. 05-AUG-25 OF AUGUST 75,000.00 Cr", "indian_1": "Account Number: 123456789\nDate Transaction Details Debits Credits Balance", "kalupur_1": "IFSC : KCCB0SRT001\nDate Value Date TR-Mode Particulars Debit Amt Credit Amt Balance",
    "kotak_1": "Kotak Mahindra Bank\nDate Narration Ref Withdrawal (Dr) Balance", "kotak_2": "Kotak Mahindra Bank\n# Debit Credit Balance", "pnb_1": "Txn Date Description Dr Amount Cr Amount Balance", "sarvodaya_1": "The Sarvodaya Sahakari Bank Ltd\nDate Particulars Chq No.",
    "sbi_1": "Date Transaction Reference Ref.No./Chq.No. Credit Debit Balance", "sbi_2": "State Bank of India\nDate Credit Balance Details and Ref of Cheque Debit", "sbi_3": "Txn Date Value Description Ref No Debit Credit Balance",
    "spcb_1": "This is SPCB", "spcb_2": "Statement downloaded by INB user X", "spcb_3": "Post Dt. Val Dt. Debit Credit Balance", "sutex_1": "Date Particulars Chq Debit Credit Balance\nStatement Summary", "union_1": "S.No Date Transaction Id Remarks Amount(Rs.) Balance(Rs.)",
}
NAMES = sorted(MARKS)
SPECIAL = [P.MISSING, P.UNREADABLE, P.NO_PAGES, P.NO_TEXT, P.UNKNOWN]
KINDS = len(NAMES) + len(SPECIAL)
#: Files whose pages one task makes and matches, but for chance.
FILES = 25_000


def folder(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Files (file, found, opened), one for each customer, and their pages; a file's layout goes by its number.

    A first page without a mark comes before, and the marks of every layout after it, so that only the order of pages tells.
    """
    kind = F.col("c_custkey") % KINDS
    customers = dealt(table(spark, sf, "customer").select("c_custkey"), FILES, "c_custkey").select(F.col("c_custkey").alias("file"), kind.alias("kind"))
    files = customers.select("file", (F.col("kind") != len(NAMES)).alias("found"), (F.col("kind") != len(NAMES) + 1).alias("opened"))
    mark = F.coalesce(*(F.when(F.col("kind") == i, MARKS[n]) for i, n in enumerate(NAMES)))
    every = "\n".join(MARKS[n] for n in NAMES)
    text = F.when(F.col("page") == 1, "Dear customer").when(F.col("page") == 2, mark).otherwise(every)
    text = F.when(F.col("kind") == len(NAMES) + 3, F.when(F.col("page") == 1, "​ \n").when(F.col("page") == 2, "")).when(F.col("kind") == len(NAMES) + 4, "Nothing that is known").otherwise(text)
    pages = customers.where(F.col("kind") != len(NAMES) + 2).select("file", F.explode(F.array(*map(F.lit, (3, 1, 2)))).alias("page"), "kind").select("file", "page", text.alias("text"))
    return files, pages


def detected_layouts(spark, sf) -> DataFrame:
    return P.file_layouts(*folder(spark, sf))


QUERIES["detected_layouts"] = detected_layouts
ORACLES["detected_layouts"] = f"SELECT c_custkey AS file, list_extract([{', '.join(repr(n) for n in NAMES + SPECIAL)}], CAST(c_custkey % {KINDS} + 1 AS BIGINT)) AS layout FROM customer"


def mixed_statements(spark, sf) -> DataFrame:
    """Files of all layouts in one folder, each read by the layout that its pages tell."""
    tx, printed = S.transactions(spark, sf), {}
    for i, name in enumerate(NAMES):
        rows = S.PRINTED[name](tx.where(F.col("file") % KINDS == i))
        kind = "words" if name in P.WORDS else "cells" if isinstance(L.LAYOUTS[name], L.Cells) else "lines"
        printed[kind] = printed[kind].unionByName(rows) if kind in printed else rows
    out = P.read_statements(detected_layouts(spark, sf), printed["cells"], printed["lines"], printed["words"])
    return _cents(out, "file", "layout", "txn_date", "narration1", "narration2")


def _cents(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, *(F.round(F.col(c) * 100).cast("long").alias(c) for c in ("withdrawal", "deposit", "balance")))


QUERIES["mixed_statements"] = mixed_statements
ORACLES["mixed_statements"] = " UNION ALL ".join(
    f"SELECT file, '{n}' AS layout, txn_date, narration1, narration2, withdrawal, deposit, balance FROM ({S.ORACLES[f'statement_{n}']}) WHERE file % {KINDS} = {i}" for i, n in enumerate(NAMES)
)

# Geometry

_EDGES = [20, 110, 430, 560, 700]


def page_lines(spark, sf) -> DataFrame:
    """Lines of pages from words that are not quite level and have no line numbers."""
    printed = cells(S.transactions(spark, sf), [day("dd-MM-yyyy"), F.col("narr"), F.col("ref"), money()], ["", "MORE OF THIS", "", "-"])
    found = P.line_texts(P.lined(words(printed, _EDGES)))
    return found.select("file", F.expr(f"cast(seq DIV {P.PAGE} as int)").alias("page"), (F.col("seq") % P.PAGE).alias("line"), F.col("line").alias("text"))


QUERIES["page_lines"] = page_lines
ORACLES["page_lines"] = f"""
WITH {TX}, p AS (SELECT *, CAST((n - 1) // 15 + 1 AS INTEGER) AS page, (n - 1) % 15 AS i FROM tx),
a AS (SELECT printf('%d.%02d', amt // 100, amt % 100) AS plain, p.* FROM p)
SELECT file, page, CAST(2 * i + 1 AS BIGINT) AS line, strftime(d, '%d-%m-%Y') || ' ' || narr || ' ' || ref || ' ' || format('{{:,}}', amt // 100) || printf('.%02d', amt % 100) AS text FROM a
UNION ALL SELECT file, page, CAST(2 * i + 2 AS BIGINT), 'MORE OF THIS -' FROM a
"""


def page_words(spark, sf) -> DataFrame:
    """Words of printed lines from single characters with places; blanks are printed by no character, so gaps alone tell."""
    tx = S.transactions(spark, sf)
    chars = tx.select("file", "n", F.posexplode(F.split(F.concat_ws(" ", day("dd-MM-yyyy"), "narr", money()), "")).alias("i", "text")).where("trim(text) <> ''")
    x, top = F.col("i") * 5.0 + 10, ((F.col("n") - 1) % 40) * 12.0 + (F.col("i") % 2) * 0.5
    placed = chars.select("file", F.expr("cast((n - 1) DIV 40 + 1 as int)").alias("page"), "text", x.alias("x0"), (x + 4.6).alias("x1"), top.alias("top"))
    found = P.words_of_chars(placed)
    return found.select("file", "page", (F.col("line") % P.PAGE).alias("line"), "text", F.round((F.col("x0") - 10) / 5).cast("long").alias("starts"))


QUERIES["page_words"] = page_words
ORACLES["page_words"] = f"""
WITH {TX}, l AS (SELECT file, n, strftime(d, '%d-%m-%Y') || ' ' || narr || ' ' || format('{{:,}}', amt // 100) || printf('.%02d', amt % 100) AS text FROM tx),
w AS (SELECT file, n, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) AS i FROM l)
SELECT file, CAST((n - 1) // 40 + 1 AS INTEGER) AS page, CAST((n - 1) % 40 + 1 AS BIGINT) AS line, text,
       CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts
FROM w
"""


def noisy_footers(spark, sf) -> DataFrame:
    """Narrations into which a footer ran whose letters are printed twice or more often."""
    k = F.col("k")
    footer = F.when(k % 4 == 0, "This is  SYSTEM generated statement").when(k % 4 == 1, "Registered Office 12").when(k % 4 == 2, "Request to our customers").otherwise("https://bank.example/x")
    doubled = F.when(k % 3 == 0, footer).otherwise(F.regexp_replace(footer, r"([A-Za-z])", F.when(k % 3 == 1, "$1$1").otherwise("$1$1$1")))
    doubled = F.when(k % 4 == 3, footer).otherwise(doubled)
    return S.transactions(spark, sf).select(k.alias("k"), P.without_noisy_footer(F.concat_ws(" ", "narr", F.lit("-"), doubled)).alias("narration"), P.letters_once(doubled).alias("once"))


QUERIES["noisy_footers"] = noisy_footers
ORACLES["noisy_footers"] = f"""
WITH {TX}
SELECT k, narr AS narration, list_extract(['this is system generated statement', 'registered ofice', 'request to our customers', 'htpsbankexamplex'], CAST(k % 4 + 1 AS BIGINT)) AS once FROM tx
"""

# The generic reader


def _printed_tables(tx: DataFrame) -> DataFrame:
    """Four headers and orders of columns in one table, by file; entries that go on, opening and closing rows, sides that the balance contradicts, balances left out."""
    tx = tx.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("file")))
    first, last, end = F.col("n") == 1, F.col("n") == F.col("total"), F.col("bal") + 100
    # Only long narrations go on in a row of their own; a number alone would be no part of one.
    head, rest, long = F.regexp_extract("narr", r"^(ITEM \d+)", 1), F.regexp_extract("narr", r"^ITEM \d+ (.*)$", 1), F.col("k") % 4 == 0
    tx = tx.withColumn("bal", end)
    left = (F.col("k") % 5 == 0) & ~first
    shown = F.when(left, "").otherwise(S.MINUS())
    swapped = F.col("k") % 6 == 0
    d = day("dd/MM/yyyy")
    # A side can be told to be wrong only where the balance is printed.
    wrong = swapped & ~left
    out, in_ = F.when(wrong, IN()).otherwise(OUT()), F.when(wrong, OUT()).otherwise(IN())
    tables = [
        [["Date", "Particulars", "Chq No", "Debit", "Credit", "Balance"], [d, "OPENING BALANCE", "", "", "", "100.00"], [d, head, F.col("ref"), out, in_, shown], (long, ["", rest, "", "", "", ""]), [d, "CLOSING BALANCE", "", "", "", S.MINUS()]],
        [["Balance", "Withdrawal", "Deposit", "Txn Date", "Narration"], ["100.00", "", "", d, "Opening Balance"], [shown, out, in_, d, F.col("narr")], None, [S.MINUS(), "", "", d, "Closing Balance"]],
        [["S No", "Value Date", "Description", "Amount", "Dr/Cr", "Closing Bal"], ["", d, "Opening Balance", "", "", "100.00"], [F.col("n").cast("string"), d, head, money(), F.when(F.col("dr"), "DR").otherwise("CR"), shown], (long, ["", "", rest, "", "", ""]), None],
        [["Date", "Details", "Ref No", "Paid Out", "Paid In", "Rs"], [d, "Opening Balance", "", "", "", "100.00"], [d, F.col("narr"), F.col("ref"), OUT(), IN(), S.MINUS()], None, [d, "Closing Balance", "", "", "", S.MINUS()]],
    ]
    made = []
    for i, (header, opening, row, more, closing) in enumerate(tables):
        own = tx.where(F.col("file") % 4 == i)
        rows = [(first, header), (first, opening), row, *([more] if more else []), *([(last, closing)] if closing else [])]
        made.append(cells(own, *rows))
    return reduce(DataFrame.unionByName, made)


def generic_columns(spark, sf) -> DataFrame:
    """Files of one table whose headers name other columns in other orders."""
    return _cents(G.table_rows(_printed_tables(S.transactions(spark, sf))), "file", "txn_date", "narration1", "narration2")


_READ = "CASE WHEN dr THEN amt ELSE 0 END AS withdrawal, CASE WHEN dr THEN 0 ELSE amt END AS deposit"
_TABLE_NARRATION = "narr || CASE WHEN file % 4 IN (0, 3) THEN ' ' || ref ELSE '' END"
QUERIES["generic_columns"] = generic_columns
ORACLES["generic_columns"] = f"WITH {TX} SELECT file, d AS txn_date, {_TABLE_NARRATION} AS narration1, '' AS narration2, {_READ}, bal + 10000 AS balance FROM tx"


def generic_chain(spark, sf) -> DataFrame:
    """Files that each need another strategy: header words, a table, plain lines; all print a period, and entries after it."""
    tx = S.transactions(spark, sf)
    own = lambda i: tx.where(F.col("file") % 3 == i)
    labels = list(G.HEADED.labels)
    headed = words(cells(own(0), (F.col("n") == 1, labels), ["", F.substring("narr", 1, 4), "", "", ""], [day("dd-MM-yyyy"), F.expr("substring(narr, 6)"), OUT(), IN(), S.MINUS()]), [20, 110, 520, 600, 700, 900], labels)
    tables = _printed_tables(own(1))
    plain = lines(own(2), F.concat_ws(" ", F.concat(F.lit("S"), F.col("n").cast("string")), day("dd-MM-yyyy"), F.col("narr")), F.concat_ws(" ", F.when(F.col("dr"), "DR").otherwise("CR"), money(), S.MINUS()))
    # Files of the later strategies also have pieces that the earlier ones find nothing in.
    headed = headed.unionByName(words(cells(own(1), ["no", "header", "here"]), [20, 110, 520, 900]))
    tables = tables.unionByName(cells(own(2), ["no", "header", "here"]))
    files = tx.select("file").distinct()
    pages = files.select("file", F.lit(1).alias("page"), F.lit("Account statement\nfrom 01-06-1995 to 31-12-1999\nof one customer").alias("text"))
    return _cents(G.read_generic(files, pages, headed, tables, plain), "file", "strategy", "txn_date", "narration1", "narration2")


QUERIES["generic_chain"] = generic_chain
ORACLES["generic_chain"] = f"""
WITH {TX}
SELECT file, list_extract(['headed', 'table', 'text'], CAST(file % 3 + 1 AS BIGINT)) AS strategy, d AS txn_date,
       CASE WHEN file % 3 = 1 THEN {_TABLE_NARRATION} ELSE narr END AS narration1, '' AS narration2, {_READ}, bal + CASE WHEN file % 3 = 1 THEN 10000 ELSE 0 END AS balance
FROM tx WHERE d BETWEEN DATE '1995-06-01' AND DATE '1999-12-31'
"""
