import random

import pytest
from pyspark.sql import functions as F

from tallybook.operators import generic as G
from tallybook.operators import pages as P

WORDS = "file long, page int, text string, x0 double, x1 double, top double"


def test_lines_from_tops_against_a_plain_loop(spark):
    rnd, rows, want = random.Random(3), [], {}
    for page, pitch in ((1, 12.0), (2, 30.0), (3, 5.0)):
        top = 40.0
        for line in range(1, 30):
            for i in range(rnd.randrange(1, 7)):
                rows.append((7, page, f"w{page}_{line}_{i}", 10.0 * i, 10.0 * i + 5, top + rnd.uniform(0, 1.5)))
                want[rows[-1][2]] = (page, line)
            top += pitch * rnd.choice([1, 1, 1, 2])
    rnd.shuffle(rows)
    out = P.lined(spark.createDataFrame(rows, WORDS)).collect()
    assert {r.text: (r.line // P.PAGE, r.line % P.PAGE) for r in out} == want
    texts = {r.seq: r.line for r in P.line_texts(P.lined(spark.createDataFrame(rows, WORDS))).collect()}
    assert texts[P.PAGE + 1].split() == sorted(w for w in want if want[w] == (1, 1))


def test_lines_of_odd_pages(spark):
    rows = [(1, 1, "a", 0.0, 1.0, 5.0), (1, 2, "b", 0.0, 1.0, 5.0), (1, 2, "c", 0.0, 1.0, 5.0), (1, 2, "d", 0.0, 1.0, 400.0), (2, 1, "e", 0.0, 1.0, None), (2, 5000, "f", 0.0, 1.0, 1.0)]
    out = {r.text: r.line for r in P.lined(spark.createDataFrame(rows, WORDS)).collect()}
    assert [out[c] for c in "abcdef"] == [P.PAGE + 1, 2 * P.PAGE + 1, 2 * P.PAGE + 1, 2 * P.PAGE + 2, None, 5000 * P.PAGE + 1]
    assert P.lined(spark.createDataFrame([], WORDS)).count() == 0


def test_words_from_characters(spark):
    chars = [(1, 1, c, i * 5.0, i * 5.0 + 4.5 + (c == "W"), 10.0 + (i % 2) * 0.4) for i, c in enumerate("ab cW") if c != " "]
    chars += [(1, 1, c, i * 5.0, i * 5.0 + 4.5, 30.0) for i, c in enumerate("x y")] + [(1, 1, None, 90.0, 91.0, 30.0)]
    out = {(r.line % P.PAGE, r.text) for r in P.words_of_chars(spark.createDataFrame(chars, WORDS)).collect()}
    assert out == {(1, "ab"), (1, "cW"), (2, "x"), (2, "y")}


@pytest.mark.parametrize("ahead", [None, 1.0])
def test_bands_against_a_plain_loop(spark, ahead):
    rnd, rows = random.Random(9), []
    for page in (1, 2):
        tops = sorted(rnd.sample(range(50, 400, 7), 12))
        rows += [(1, page, "ANCHOR", 0.0, 1.0, float(t)) for t in tops] + [(1, page, f"w{i}", 0.0, 1.0, rnd.uniform(0, 450)) for i in range(80)]
    out = P.banded(spark.createDataFrame(rows, WORDS), F.col("text") == "ANCHOR", ahead).collect()
    got = {(r.page, r.text, r.top): r.seq for r in out}
    for page in (1, 2):
        anchors = sorted(t for _, p, w, *_, t in rows if p == page and w == "ANCHOR")
        begins = [a - ahead for a in anchors] if ahead is not None else [float("-inf")] + [(a + b) / 2 for a, b in zip(anchors, anchors[1:])]
        for _, p, w, *_, t in rows:
            if p == page:
                band = sum(b <= t for b in begins)
                assert got.get((p, w, t)) == (page * P.PAGE + band if band else None)


def test_stray_rows_join_the_row_before_or_the_first_after(spark):
    d = __import__("decimal").Decimal
    row = lambda file, seq, text, w, b: (file, seq, __import__("datetime").date(2024, 1, seq), text, "", w and d(w), d("0.00"), b and d(b))
    rows = [row(1, 1, "TO SELF", "0.00", None), row(1, 2, "by cash", "0.00", None), row(1, 3, "A", "5.00", "9.00"), row(1, 4, "BY CASH", "0.00", None), row(1, 5, "B", "7.00", None), row(1, 6, "to self x", "0.00", "2.00"), row(1, 7, "BY CASH", "3.00", "1.00"), row(2, 1, "TO SELF", "0.00", "4.00"), row(2, 2, "TO SELF", "0.00", None)]
    df = spark.createDataFrame(rows, "file long, seq long, txn_date date, narration1 string, narration2 string, withdrawal decimal(18,2), deposit decimal(18,2), balance decimal(18,2)")
    out = sorted((r.file, r.seq, r.narration1, str(r.withdrawal), str(r.balance)) for r in P.merged_strays(df, P.cash_strays()).collect())
    assert out == [(1, 3, "TO SELF by cash A BY CASH", "5.00", "9.00"), (1, 5, "B to self x", "7.00", "2.00"), (1, 7, "BY CASH", "3.00", "1.00"), (2, 1, "TO SELF TO SELF", "0.00", "4.00")]


def test_rules_by_page_then_order(spark):
    files = spark.createDataFrame([(i, i != 5, i != 6) for i in range(1, 10)] + [(10, None, True)], "file long, found boolean, opened boolean")
    pages = [
        (1, 1, "hello"), (1, 2, "www.icicibank.com"), (1, 3, "This is SPCB"), (2, 1, "www.icicibank.com this is spcb"), (3, 1, None), (3, 2, "​ \n"), (4, 1, "no bank"), (5, 1, "This is SPCB"), (6, 1, "This is SPCB"),
        (8, 1, "IDBI\n1. 05-AUG-25 A 1.00 Cr"), (9, 1, "1. 05-AUG-25 A 1.00 Cr\n2. 05-AUG-25 B 1.00 Dr"), (9, 2, "1. 05-AUG-25 A 1.00 Cr\n2. 05-AUG-25 B 1.00 Dr\n x\n 3. 06-AUG-25 C D 12.00 Cr "), (11, 1, "This is SPCB"),
    ]
    out = {r.file: r.layout for r in P.file_layouts(files, spark.createDataFrame(pages, "file long, page int, text string")).collect()}
    assert out == {1: "icici_1", 2: "spcb_1", 3: P.NO_TEXT, 4: P.UNKNOWN, 5: P.MISSING, 6: P.UNREADABLE, 7: P.NO_PAGES, 8: "idbi_choicepoint", 9: "idbi_choicepoint", 10: P.MISSING}


def test_noisy_footers(spark):
    texts = ["UPI PAY  ReGGistereeddd   ooffice 12", "registrar office", "this iis ssystem", "A - http://x.y z", None, "", "PPaage  nno"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r[0] for r in df.select(P.without_noisy_footer(F.col("t"))).collect()]
    assert out == ["UPI PAY", "registrar office", "", "A", None, "", ""]
    assert P.noisy("off ice") == r"o+f+\s+i+c+e+" and df.select(P.letters_once(F.lit("Noo  TTwo, 33 éé"))).first()[0] == "no two é"


CELLS = "file long, seq long, cells array<string>"


def test_tables_by_their_own_headers(spark):
    rows = [
        (1, 0, ["x", "y"]), (1, 1, ["Txn Date", "Narration", "Debit", "Credit", "Balance"]), (1, 2, ["01-04-2024", "Opening Balance", None, "", "100.00"]), (1, 3, ["02-04-2024", "A/DR/x", "", "10.00", "90.00"]),
        (1, 4, ["", "more", "", "", ""]), (1, 5, ["03-04-2024", "B", "20.00", "", ""]), (1, 6, ["04-04-2024", "C", "", "", "75.00"]), (1, 7, ["STATEMENT SUMMARY", "z", "", "", ""]), (1, 8, ["", "after", "", "", ""]), (1, 9, ["05-04-2024", "Closing Balance", "", "", "75.00"]),
        (2, 0, ["no", "header"]), (2, 1, ["01-04-2024", "5.00"]), (3, 0, None), (4, 0, ["Date", "Details", "Amount", "Dr/Cr", "Balance"]),
    ]
    out = sorted((r.seq, r.narration1, str(r.withdrawal), str(r.deposit), str(r.balance)) for r in G.table_rows(spark.createDataFrame(rows, CELLS)).collect())
    assert out == [(3, "A/DR/x more", "10.00", "0.00", "90.00"), (5, "B", "20.00", "0.00", "70.00"), (6, "C", "0.00", "5.00", "75.00")]
    assert G.table_rows(spark.createDataFrame([], CELLS)).count() == 0


def test_plain_lines(spark):
    rows = [(1, "head 1.00"), (2, "S1 01-04-2024 OLD 50.00"), (3, "S2 02-04-2024 PAY X 3,000.50"), (4, "45.00"), (5, " "), (6, "03-04-2024 GOT 9 BACK CR 1.00 46.00"), (7, "04-04-2024 nothing"), (8, "31-02-2024 X 1.00 2.00")]
    out = [(r.seq, r.narration1, str(r.withdrawal), str(r.deposit), str(r.balance)) for r in G.text_rows(spark.createDataFrame([(1, i, t) for i, t in rows], "file long, seq long, line string")).orderBy("seq").collect()]
    assert out == [(2, "OLD", "0.00", "0.00", "50.00"), (3, "PAY X", "3000.50", "0.00", "45.00"), (6, "GOT 9 BACK", "0.00", "1.00", "46.00"), (7, "nothing", "0.00", "0.00", "None")]


def test_each_strategy_gets_what_is_left(spark):
    files = spark.createDataFrame([(i,) for i in range(6)], "file long")
    asked = []

    def reads(least):
        def read(left):
            asked.append(sorted(r.file for r in left.collect()))
            return left.where(F.col("file") >= least)

        return read

    out = G.first_that_reads(files, [("a", reads(4)), ("b", reads(2)), ("c", reads(1))])
    assert asked == [[0, 1, 2, 3, 4, 5], [0, 1, 2, 3], [0, 1]]
    assert {r.file: r.strategy for r in out.collect()} == {5: "a", 4: "a", 3: "b", 2: "b", 1: "c"}


def test_period_cut(spark):
    rows = spark.sql("select file, date'2024-01-01' + cast(i as int) as txn_date from (select explode(sequence(0, 9)) i), (select explode(array(1, 2, 3)) file)")
    pages = spark.createDataFrame([(1, 1, "X from 03-01-2024 to 05-01-2024"), (1, 2, "from 01-01-2020 to 02-01-2020"), (2, 1, "from 31-02-2024 to 5"), (2, 2, None)], "file long, page int, text string")
    assert {r.file: r["count"] for r in G.within_period(rows, pages).groupBy("file").count().collect()} == {1: 3, 2: 10, 3: 10}


def test_tables_meet_their_headers_without_being_made_again(spark):
    rnd, rows, want = random.Random(5), [], {}
    heads = {"date": "Txn Date", "debit": "Debit", "credit": "Credit", "amount": "Amount", "drcr": "Dr/Cr", "description": "Narration", "reference": "Chq No", "balance": "Closing Bal"}
    for file in range(40):
        named = rnd.sample(sorted(heads), rnd.randrange(2, 8)) + [None] * rnd.randrange(3)
        body = [[rnd.choice(["1.00", "2,500.00", "", "x", None]) if rnd.random() < 0.6 else "3.00" for _ in range(len(named) - (rnd.random() < 0.2))] for _ in range(rnd.randrange(8))]
        lead = rnd.randrange(7)
        rows += [(file, i, cells) for i, cells in enumerate([["old 1.00"]] * lead + [[heads.get(k, "Rs") for k in named]] + body)]
        has = set(named)
        score = 2 * ("date" in has) + 2 * bool(has & {"debit", "credit"}) + 2 * ({"amount", "drcr"} <= has) + ("balance" in has) + ("description" in has) - 0.2 * sum(k in (None, "reference") for k in named)
        if lead < 6 and score >= 2:
            at = {k: named.index(k) if k in named else None for k in heads}
            if at["debit"] is not None and at["credit"] is not None:
                at["amount"] = at["drcr"] = None
            if at["balance"] is None:
                last = max(-1 if at[k] is None else at[k] for k in ("debit", "credit", "amount", "drcr"))
                for i in range(last + 1, len(named)):
                    cells = [c[i] for c in body if len(c) > i]
                    hits = sum(c not in (None, "", "x") for c in cells)
                    at["balance"] = i if hits >= 3 and hits >= int(len(cells) * 0.6) else at["balance"]
            want[file] = (lead, at | {"date": at["date"] or 0})
    df = spark.createDataFrame(rows, CELLS)
    out = {r.file: (r.header, {k: r[f"at_{k}"] for k in heads}) for r in G.file_columns(df).collect()}
    assert out == want and len(want) > 15 and any(at["balance"] is not None and at["balance"] > 0 for _, at in want.values())
    plan = G.table_rows(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Join" not in plan


def test_some_files_are_ordered_without_the_others(spark):
    from tallybook.plans import statements as S

    plan = S.transactions(spark, "/root/testdata/sf0.001").where(F.col("file") % 3 == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("% 3) = 1")
