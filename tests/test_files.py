import pytest
from pyspark.sql import functions as F

from tallybook.operators import layouts as L
from tallybook.operators import linkage as K
from tallybook.operators import office as O
from tallybook.sources import company, files
from tallybook.streaming.ingest import ingest_keyed


def test_files_are_listed_copied_and_deleted(spark, tmp_path):
    root = f"file://{tmp_path}/a b"
    rows = spark.createDataFrame([(f"{root}/x/1%.txt", "one"), (f"{root}/x/ü.txt", ""), (f"{root}/y/2.txt", None)], "path string, content string")
    assert all(r.done for r in files.write_files(rows).collect())
    listed = files.listing(spark, root)
    assert {(r.path, r.name, r.size) for r in listed.collect()} == {(f"{root}/x/1%.txt", "1%.txt", 3), (f"{root}/x/ü.txt", "ü.txt", 0), (f"{root}/y/2.txt", "2.txt", 0)}
    assert files.listing(spark, f"{root}/none").count() == 0 and {r.name for r in files.listing(spark, f"{root}/x").collect()} == {"1%.txt", "ü.txt"}
    moves = spark.createDataFrame([(f"{root}/x/1%.txt", f"{root}/z/deep/1.txt"), (f"{root}/none.txt", f"{root}/z/n.txt")], "source string, target string")
    for _ in range(2):  # a task that runs again does the same again
        assert {r.path[-6:]: (r.done, r.reason) for r in files.copy_files(moves).collect()} == {"1%.txt": (True, None), "ne.txt": (False, "FileNotFoundError")}
    gone = spark.createDataFrame([(f"{root}/x/1%.txt",), (f"{root}/x/1%.txt",)], "path string").coalesce(1)
    assert all(r.done for r in files.delete_files(gone).collect())
    left = {r.name for r in files.orphans(files.listing(spark, root), spark.createDataFrame([(f"{root}/y/2.txt",)], "path string")).collect()}
    assert left == {"ü.txt", "1.txt"}


def test_first_existing_place(spark):
    there = spark.createDataFrame([("b", 2), ("c", 3)], "path string, size long")
    wanted = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "a"), (3, 1, "c"), (3, 1, "c"), (None, 1, None)], "k int, place int, path string")
    assert {tuple(r) for r in files.first_existing(wanted, there, "k").collect()} == {(1, 2, "b", 2), (3, 1, "c", 3)}


def test_company_source_reads_only_what_is_asked(spark, tmp_path):
    head = "code,name,acgroup,bank,accno\n"
    for where, body in {"a/DB1202425.csv": "1,X,Bank Accounts,B,007\n2,Y,Other,,\n", "a/db202425.csv": "9,no,Bank Accounts,,\n", "a/db202324.csv": "3,Z,Bank Accounts,B,1\n", "b/db.csv": "4,W,Bank Accounts,B,2\n", "c/db202324.csv": ""}.items():
        (tmp_path / where).parent.mkdir(exist_ok=True)
        (tmp_path / where).write_text(head + body)
    df = company.company_accounts(spark, f"file://{tmp_path}")
    assert {(r.company, r.fy, r.code) for r in df.collect()} == {("a", "2024_25", "1"), ("a", "2024_25", "2"), ("a", "2023_24", "3")}
    asked = df.where("fy = '2024_25' and acgroup in ('Bank Accounts') and length(name) = 1")
    assert {tuple(r) for r in asked.collect()} == {("a", "2024_25", "1", "X", "Bank Accounts", "B", "007"), ("b", "2024_25", "4", "W", "Bank Accounts", "B", "2")}
    assert asked.rdd.getNumPartitions() == 2
    # What the source takes, Spark doesn't test again; what it doesn't stays Spark's.
    kept = next(line for line in asked._jdf.queryExecution().executedPlan().toString().split("\n") if "Filter (" in line)
    assert "2024_25" not in kept and "Bank Accounts" not in kept and "length(name" in kept
    assert df.where("company = 'none'").count() == 0


def test_keyed_stream_restarts_and_ignores_what_came_before(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(60).selectExpr("cast(id % 7 as int) as box", "concat('m', id % 5) as msg", "timestamp'2024-03-30' + make_interval(0, 0, 0, cast(id % 4 as int)) as ts")
    run = lambda: ingest_keyed(spark, src, df.schema, str(tmp_path / "out"), str(tmp_path / "cp"), ["box", "msg"], "ts")
    df.limit(30).repartition(3).write.parquet(src)
    first = run().count()
    df.repartition(3).write.mode("append").parquet(src)  # all of it again, and the rest
    out = run()
    want = df.selectExpr("box", "msg", "if(ts < '2024-04-01', '2023_24', '2024_25') as fy").distinct()
    assert sorted(out.select("box", "msg", "fy").collect()) == sorted(want.collect()) and 0 < first < out.count()
    assert run().count() == out.count()


def test_years_of_short_dates(spark):
    rows = [
        (1, 0, "Account Statement from 1 Nov 2023 to 31 Mar 2025"), (1, 1, "10 Dec 10 Dec A"), (1, 2, "2023 2023 goes on 5.00"), (1, 3, "31 Dec 1 Jan B"), (1, 4, "2 Jan 31 Dec C"), (1, 5, "3 Feb 2026 3 Feb 2026 D"), (1, 6, "1 Mar 1 Mar E"), (1, 7, "5 Jan 5 Jan F"),
        (2, 0, "Account Statement from 1 Nov 2023 to 31 Mar 2025"), (2, 1, "1 Feb 1 Feb G"), (3, 1, "1 Feb 1 Feb H"), (4, 1, "1 Xyz 1 Xyz I"), (5, 1, None),
    ]
    out = {(r.file, r.seq): r.line for r in L.with_years(spark.createDataFrame(rows, "file int, seq int, line string")).collect()}
    assert [out[1, i] for i in range(1, 8)] == ["10 Dec 2023 10 Dec 2023 A", "goes on 5.00", "31 Dec 2023 1 Jan 2024 B", "2 Jan 2024 31 Dec 2023 C", "3 Feb 2026 3 Feb 2026 D", "1 Mar 2026 1 Mar 2026 E", "5 Jan 2027 5 Jan 2027 F"]
    assert out[2, 1] == "1 Feb 2024 1 Feb 2024 G" and out[3, 1] == "1 Feb 1 Feb H" and out[4, 1] == "1 Xyz 1 Xyz I" and out[5, 1] is None


@pytest.mark.parametrize(("cell", "change", "want"), [("191101 264.26", None, 264.26), ("191101.00 264.26 7", -264.26, 264.26), ("12 1 , 234 . 50", None, 1234.5), ("936,900", None, 936900), ("3000", None, 3000), ("191101", None, None), ("191101", 191101, 191101), ("", 5, None), ("5 1,234", 5, 5)])
def test_likely_amounts(spark, cell, change, want):
    df = spark.createDataFrame([(cell, change and float(change))], "c string, d double").withColumn("d", F.col("d").cast("decimal(18,2)"))
    got = df.select(L.likely_amount(F.col("c"), F.col("d"))).first()[0]
    assert (None if got is None else float(got)) == want


def test_month_summary_spans(spark):
    rows = [("g", 2, "a", "x"), ("g", 2, "b", "x"), ("g", 2, "c", "y"), ("g", 1, "b", "x"), (None, 3, "a", "z"), (None, 3, "b", "z"), (None, 3, "c", "z")]
    out = {r.k: r for r in O.month_summary(spark.createDataFrame(rows, "g string, k int, month string, status string"), "g", "k", ["a", "b", "c"]).collect()}
    assert {k: (r.group_rows, r.a, r.c, [tuple(x) for x in r.runs]) for k, r in out.items()} == {1: (2, None, None, [(None, 1), ("x", 1), (None, 1)]), 2: (0, "x", "y", [("x", 2), ("y", 1)]), 3: (1, "z", "z", [("z", 3)])}


def test_found_accounts_against_plain_loops(spark):
    import random

    rnd = random.Random(6)
    held = [(c, 100 * c + i, "".join(rnd.choice("aB1-2 ") for _ in range(rnd.randrange(0, 8)))) for c in range(5) for i in range(6)] + [(1, 199, None)]
    wanted = [(k, rnd.randrange(6), "".join(rnd.choice("Ab1-2 ") for _ in range(rnd.randrange(0, 6)))) for k in range(200)]
    wanted += [(200 + i, c, f" {n} ") for i, (c, _, n) in enumerate(held) if n]
    want = {}
    only = lambda t: "".join(x for x in t if x.isdigit())
    for key, client, typed in wanted:
        t = typed.strip(" ")
        tiers = [lambda n: n == t, lambda n: n.lower() == t.lower(), lambda n: t.lower() in n.lower(), lambda n: n.lower().endswith(t.lower()), lambda n: only(n) == only(t)]
        best = min(((i, a) for i, f in enumerate(tiers, 1) for c, a, n in held if c == client and n is not None and t and f(n)), default=None)
        if best:
            want[key] = best
    out = K.found_account(spark.createDataFrame(wanted, "key int, client_id int, typed string"), spark.createDataFrame(held, "client_id int, account_id int, account_no string"))
    assert {r.key: (r.tier, r.account_id) for r in out.collect()} == want
    assert len({t for t, _ in want.values()}) == 4
