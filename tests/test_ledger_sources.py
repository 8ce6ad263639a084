from datetime import date
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallybook.operators import ledger, mutations, relational, statements
from tallybook.sources import readers, sinks
from tallybook.streaming.ingest import deduplicated_stream, ingest

moves = st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.sampled_from(["keep", "null", "zero"])), min_size=1, max_size=20)


@settings(max_examples=10, deadline=None)
@given(moves, st.integers(0, 19))
def test_balance_fill(spark, rows, sure):
    balance, full = 1000, []
    for i, (d, w, _) in enumerate(rows):
        balance += d - w
        full.append(balance)
    known = [b if k == "keep" or i == sure % len(rows) else None if k == "null" else 0 for i, (b, (_, _, k)) in enumerate(zip(full, rows))]
    df = spark.createDataFrame([(1, i, d, w, b) for i, ((d, w, _), b) in enumerate(zip(rows, known))], "a int, seq int, deposit long, withdrawal long, balance long")
    out = ledger.fill_balance(df, ["a"], ["seq"]).orderBy("seq").collect()
    assert [r.balance for r in out] == full
    assert not any(r.balance_mismatch for r in ledger.reconcile(ledger.fill_balance(df, ["a"], ["seq"]), ["a"], ["seq"]).collect())


def test_reference_backfill_mode(spark):
    df = spark.createDataFrame([(1, 0, 5, 0, None), (1, 1, 0, 2, 100)], "a int, seq int, deposit long, withdrawal long, balance long")
    exact = [r.balance for r in ledger.fill_balance(df, ["a"], ["seq"]).orderBy("seq").collect()]
    quirk = [r.balance for r in ledger.fill_balance(df, ["a"], ["seq"], "reference").orderBy("seq").collect()]
    assert exact == [102, 100] and quirk == [95, 100]


def test_upsert_counters(spark):
    t = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    s = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "id int, v string")
    assert {r.action: r.n for r in mutations.action_counts(t, s, ["id"]).collect()} == {"existing": 1, "updated": 1, "inserted": 1}
    assert sorted(map(tuple, mutations.upsert(t, s, ["id"]).collect()), key=lambda r: r[0]) == [(1, "a"), (2, "b"), (3, "c"), (4, None)]


def test_statement_formats(spark):
    rows = [("f", 0, "Account | Tran Date | x"), ("f", 1, "001 | 03-JAN-2024 | B/F | | | | 10.00 Cr | M"), ("f", 2, "001 | 04-Jan-2024 | BY  X | 7 | 2.50 | | 7.50 Cr | M")]
    out = statements.PARSERS["pipe"](spark.createDataFrame(rows, "file string, seq int, line string")).orderBy("seq").collect()
    assert [(r.txn_date, r.narration, r.withdrawal, r.balance) for r in out] == [(date(2024, 1, 3), "B/F", Decimal("0.00"), Decimal("10.00")), (date(2024, 1, 4), "BY X", Decimal("2.50"), Decimal("7.50"))]
    page = "<tr><td>01/02/24</td><td>A&nbsp;B</td><td>&nbsp;</td><td>1,000.00</td><td></td><td>5.00 Dr</td></tr>"
    r = statements.PARSERS["html"](spark.createDataFrame([("h", 0, "<table>" + page), ("h", 1, "</table>")], "file string, seq int, line string")).first()
    assert (r.txn_date, r.narration, r.withdrawal, r.deposit, r.balance) == (date(2024, 2, 1), "A B", Decimal("1000.00"), Decimal("0.00"), Decimal("-5.00"))
    t = statements.PARSERS["tab"](spark.createDataFrame([("t", 0, "Name\tX"), ("t", 1, "1-2-2024\tp\t\t\t3.00\t9.00")], "file string, seq int, line string")).collect()
    assert len(t) == 1 and t[0].deposit == Decimal("3.00")


def test_words_and_bands(spark):
    words = spark.createDataFrame([(1, 1, "a", 0.0, 4.0), (1, 1, "b", 5.0, 9.0), (1, 1, "c", 12.0, 14.0)], "page int, line int, text string, x0 double, x1 double")
    boxes = spark.createDataFrame([(1, "left", 0.0, 10.0), (1, "right", 10.0, 20.0)], "page int, label string, left double, right double")
    assert {r.label: r.text for r in statements.words_to_columns(words, boxes, ["page"], "line").collect()} == {"left": "a b", "right": "c"}
    tops = [r.band_bottom for r in statements.bands(spark.createDataFrame([(1, 10.0), (1, 20.0)], "page int, top double"), ["page"]).orderBy("top").collect()]
    assert tops == [15.0, float("inf")]


def test_csv_mail_and_sinks(spark, tmp_path):
    (tmp_path / "u.csv").write_text(" PAN ,Ack\nA,1\n")
    assert readers.csv_lower(spark, str(tmp_path / "u.csv")).columns == ["pan", "ack"]
    box = tmp_path / "mail" / "a@x.org"
    box.mkdir(parents=True)
    (box / "1.eml").write_bytes(b"From: =?utf-8?q?J=C3=BC?= <J@y.org>\r\nTo: A <a@x.org>, b@x.org\r\nMessage-ID: <ID1@y>\r\nDate: Mon, 01 Apr 2024 10:00:00 +0530\r\nSubject: =?utf-8?b?w6k=?=\r\n\r\nhello\r\n")
    (box / "2.eml").write_bytes(b"Subject: none\r\n\r\nx\r\n")
    rows = {r.subject: r for r in readers.mail_files(spark, str(tmp_path / "mail")).collect()}
    r = rows["é"]
    assert (r.mailbox, r.msg_id, r.sender, r.recipients, r.rec_dat.hour) == ("a@x.org", "id1@y", "j@y.org", ["a@x.org", "b@x.org"], 4) and rows["none"].msg_id is None
    assert readers.mail_window(readers.mail_files(spark, str(tmp_path / "mail")), "2024-04-01", "2024-04-01", 1).count() == 1
    df = spark.createDataFrame([("2024_25", "a  b")], "fy string, v string")
    sinks.write_by_fy(df, str(tmp_path / "out"))
    assert (tmp_path / "out" / "fy=2024_25").is_dir()
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).where("value like '%\"a b\"%'").count() == 1


def test_header_rows_and_files(spark):
    rows = spark.createDataFrame([(0, ["Report"]), (1, ["PAN No", None, "ACK"]), (2, ["pan", "ack"])], "seq int, cells array<string>")
    assert readers.header_row(rows, "seq", "cells", ["pan", "ack"]).first().seq == 1
    files = spark.createDataFrame([("c", "db.bds", 5), ("c", "db1202425.bds", 1), ("c", "x.bds", 9)], "company string, name string, modified int")
    assert readers.newest_for_year(files, "202425").first().name == "db1202425.bds"


def test_stream_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i % 5, f"m{i % 7}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "box int, msg string, n int").withColumn("ts", F.expr("timestamp '2024-03-30' + make_interval(0, 0, 0, n % 4)"))
    df.repartition(4).write.parquet(src)
    for run in (1, 2):  # the second run finds the same files again under a new checkpoint
        out = ingest(spark, src, df.schema, str(tmp_path / "target"), str(tmp_path / f"cp{run}"), ["box", "msg"], "ts")
    # A key is unique within a fiscal year; the third and fourth day lie in the next one.
    assert out.count() == len({(*r[:2], r[2] % 4 > 1) for r in rows}) and {r.fy for r in out.select("fy").distinct().collect()} <= {"2023_24", "2024_25"}
    stream = deduplicated_stream(spark.readStream.schema(df.schema).parquet(src), ["box", "msg"], "ts")
    q = stream.writeStream.format("memory").queryName("dedup").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp3")).start()
    q.awaitTermination()
    assert spark.table("dedup").count() == len({r[:2] for r in rows})


def test_cascade_and_best(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (2, "c", 9)], "k int, v string, n int")
    assert {r.k: (r.v, r.tier) for r in relational.cascading(df, ["k"], [F.col("n") == 2, F.col("n") > 2], [F.col("v")]).collect()} == {1: ("b", 1), 2: ("c", 2)}
    assert {r.k: r.v for r in relational.best_scored(df, ["k"], [F.col("n")], ["v"]).collect()} == {1: "a", 2: "c"}


def test_voucher_serials_above_9999_are_whole(spark):
    out = ledger.voucher_serial(spark.range(1, 10012), F.lit("A"), ["id"]).collect()
    assert {r.id: r.voucher for r in out} == {i: f"A-{i:04d}" for i in range(1, 10012)}


def test_dates_and_amounts_by_shape(spark):
    from tallybook.functions.scalars import parse_date, parse_money

    shown = {"1-4-2024": "2024-04-01", "31-02-2024": None, "03-JAN-2024": "2024-01-03", "3 jan, 2024": "2024-01-03", "Jan 3, 2024": "2024-01-03", "01/02/24": "2024-02-01", "2024-2-9": "2024-02-09", "1-2/2024": None, "1.2.2024": "2024-02-01", "05-AUG-25": "2025-08-05", "": None, "12": None}
    out = spark.createDataFrame([(k,) for k in shown], "t string").select("t", parse_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in out} == shown
    sums = {"1,23,456.78": 123456.78, "(12.00)": -12.0, "-": 0.0, "12.50 Dr": -12.5, "Rs. 5": 5.0, "x": None, "- 7.5": -7.5, "INR 3.00 CR": 3.0}
    out = spark.createDataFrame([(k,) for k in sums], "t string").select("t", parse_money(F.col("t")).cast("double").alias("v")).collect()
    assert {r.t: r.v for r in out} == sums


def test_scores_and_floor(spark):
    rows = spark.createDataFrame([(1, 0, ["a"] * 6), (1, 1, ["b"] * 7), (2, 0, ["x"]), (2, 1, ["Date", "Balance"])], "t int, seq int, cells array<string>")
    assert [(r.t, r.seq, r.score) for r in statements.best_header(rows, ["t"], "seq", "cells").collect()] == [(2, 1, 3.0)]
    df = spark.createDataFrame([("123456789012345", " 9876543210 "), ("x 1234567890123", "9876543210"), (None, "")], "ack_no string, phone string")
    assert {r.column_name: r.score for r in statements.column_scores(df, df.columns).collect()} == {"ack_no": 3 + 3 + 1, "phone": -4}


def test_fiscal_ranges_are_pushed_down(spark, tmp_path):
    from tallybook.functions.fiscal import in_years

    spark.sql("select explode(sequence(timestamp'2023-03-30', timestamp'2025-04-02', interval 1 day)) as d").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = df.where(in_years(F.col("d"), ["2023_24", "bad"]))
    assert [str(v)[:10] for v in got.agg(F.min("d"), F.max("d")).first()] == ["2023-04-01", "2024-03-31"] and df.where(in_years(F.col("d"), ["bad"])).isEmpty()
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual" in got._jdf.queryExecution().toString()
