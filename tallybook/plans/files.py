"""Queries over files that are written from the given tables: CSV, mails, attachments, companies' ledgers, streams; and the last normalisers."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import scalars as S
from tallybook.operators import ledger as LG
from tallybook.plans.statements import TX, transactions
from tallybook.session import scratch_root, table, written
from tallybook.sources import company, files, readers, sinks
from tallybook.streaming.ingest import ingest_keyed

QUERIES, ORACLES = {}, {}


def query(sql: str) -> Callable:
    def register(function: Callable) -> Callable:
        QUERIES[function.__name__], ORACLES[function.__name__] = function, sql
        return function

    return register


def _folder(spark, name: str) -> str:
    root = scratch_root(spark)
    return os.path.join(root if "://" in root or root.startswith("file:") else f"file://{root}", f"tallybook-{name}-{uuid.uuid4().hex}")


# CSV and sheets


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', ' || 'a b' AS name, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS size FROM part")
def csv_round_trip(spark, sf):
    """Written with every value quoted and white space collapsed, read with header names in lower case."""
    at = _folder(spark, "csv")
    p = table(spark, sf, "part")
    sinks.export_csv(p.select(F.col("p_partkey").alias("P_PartKey"), F.concat("p_name", F.lit(",  a \t b ")).alias(" Name "), F.when(F.col("p_size") > 10, F.col("p_size")).alias("SIZE")), at)
    return readers.csv_lower(spark, at)


@query("SELECT n_nationkey % 4 AS sheet, CAST(n_nationkey % 4 + 1 AS BIGINT) AS header FROM nation GROUP BY ALL")
def sheet_header_rows(spark, sf):
    """Where the header stands in each sheet: behind as many rows of other text as its number says, and one."""
    n = table(spark, sf, "nation").select((F.col("n_nationkey") % 4).alias("sheet"), "n_name").groupBy("sheet").agg(F.min("n_name").alias("n_name"))
    rows = n.select("sheet", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seq"), "n_name")
    cells = F.when(F.col("seq") == F.col("sheet") + 1, F.array(F.lit(" PAN No"), F.lit(None), F.lit("Ack Number"))).when(F.col("seq") > F.col("sheet") + 1, F.array(F.lit("pan"), F.lit("ack"), F.lit(""))).otherwise(F.array(F.lit("Pan"), F.col("n_name")))
    rows = rows.select("sheet", F.col("seq").cast("long").alias("seq"), cells.alias("cells"))
    return readers.header_rows(rows, "sheet", "seq", "cells", ["pan", "ack"]).select("sheet", F.col("seq").alias("header"))


@query("SELECT s_suppkey % 10 AS company, max(CASE s_suppkey % 10 % 3 WHEN 0 THEN 'DB1202425.bds' WHEN 1 THEN 'db202425.bds' ELSE 'zz.bds' END) AS name FROM supplier GROUP BY 1")
def newest_company_files(spark, sf):
    """The ledger file of each company for a year: by name where there is one, else the newest."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 10).alias("company")).distinct()
    kind = F.col("company") % 3
    file = lambda name, modified: F.struct(name.alias("name"), F.lit(modified).alias("modified"))
    both = [file(F.when(kind == 1, "db202425.bds").when(kind == 0, "DB1202425.bds"), 1), file(F.when(kind == 0, "db202425.bds"), 2)]
    names = F.filter(F.array(file(F.lit("zz.bds"), 9), file(F.lit("old.bds"), 8), *both), lambda f: f["name"].isNotNull())
    return readers.newest_for_year(s.select("company", F.inline(names)), "202425").select("company", "name")


# Mails


@query("""SELECT 'box' || s_suppkey % 3 AS mailbox, 'id.' || s_suppkey || '@x.org' AS msg_id, CASE WHEN s_suppkey % 4 > 0 THEN 'sénd' || s_suppkey || '@y.org' END AS sender, 'a@x.org,b' || s_suppkey || '@x.org' AS recipients,
'Ünit ' || s_suppkey AS subject, 'body é ' || s_suppkey AS body, CAST(6 AS BIGINT) AS size, make_timestamp(2024, 4, 1, CAST(s_suppkey % 20 AS BIGINT), 30, 0) AS received FROM supplier""".replace("sénd", "send"))
def mail_scan(spark, sf):
    """Mail files of three mailboxes: encoded headers, address lists with names and repeats, base64 bodies, an attachment."""
    at = _folder(spark, "mail")
    k = F.col("s_suppkey").cast("string")
    b64 = lambda c: F.base64(F.encode(c, "utf-8"))
    text = F.concat_ws(
        "\r\n", F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("From: =?utf-8?b?"), b64(F.lit("Jü, K")), F.lit("?= <Send"), k, F.lit("@Y.org>"))), F.concat(F.lit('To: "A, B" <A@x.org>, a@x.org,\r\n B'), k, F.lit("@x.org")), F.lit("Cc: a@X.org"), F.concat(F.lit("Message-ID: <ID."), k, F.lit("@x.org>")),
        F.concat(F.lit("Date: Mon, 01 Apr 2024 "), F.lpad((F.col("s_suppkey") % 20).cast("string"), 2, "0"), F.lit(":30:00 +0000")), F.concat(F.lit("Subject: =?utf-8?b?"), b64(F.concat(F.lit("Ünit "), k)), F.lit("?=")), F.lit("MIME-Version: 1.0"), F.lit('Content-Type: multipart/mixed; boundary="b"'), F.lit(""),
        F.lit("--b"), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit("Content-Transfer-Encoding: base64"), F.lit(""), b64(F.concat(F.lit("body é "), k)), F.lit("--b"), F.lit("Content-Type: application/pdf"), F.lit('Content-Disposition: attachment; filename="a.pdf"'), F.lit("Content-Transfer-Encoding: base64"), F.lit(""), b64(F.lit("sixchr")), F.lit("--b--"), F.lit(""),
    )
    path = F.concat(F.lit(f"{at}/box"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/"), k, F.lit(".eml"))
    _all_done(files.write_files(table(spark, sf, "supplier").select(path.alias("path"), text.alias("content"))))
    m = readers.mail_files(spark, at)
    return m.select("mailbox", "msg_id", "sender", F.concat_ws(",", "recipients").alias("recipients"), "subject", F.trim("body").alias("body"), F.get("attachments", 0)["size_bytes"].cast("long").alias("size"), F.col("rec_dat").cast("timestamp_ntz").alias("received"))


def _all_done(outcomes: DataFrame) -> None:
    """Run the actions, once, and fail if one of them did."""
    failed = outcomes.agg(F.count(F.when(~F.col("done"), 1)).alias("n"), F.max("reason").alias("reason")).first()
    if failed["n"]:
        raise OSError(f"{failed['n']} files failed: {failed['reason']}")


# Attachments


def _attachments(spark, sf) -> tuple[str, DataFrame, DataFrame]:
    """A folder of attachments: where each supplier's may be, in order, and what is there. Files that no supplier names are there too."""
    at = _folder(spark, "files")
    s = table(spark, sf, "supplier").select("s_suppkey")
    k = F.col("s_suppkey").cast("string")
    place = lambda i, folder: F.struct(F.lit(i).alias("place"), F.concat(F.lit(f"{at}/{folder}/"), k, F.lit("/a b.pdf")).alias("path"))
    candidates = s.select("s_suppkey", F.inline(F.array(place(1, "mail"), place(2, "media"), place(3, "old"))))
    there = (F.col("place") == 1) & (F.col("s_suppkey") % 3 == 0) | (F.col("place") == 2) & (F.col("s_suppkey") % 2 == 0) | (F.col("place") == 3) & (F.col("s_suppkey") % 5 != 0)
    made = candidates.where(there).select("path", F.expr("repeat('x', cast(10 * place + s_suppkey % 7 as int))").alias("content"))
    lost = s.where("s_suppkey % 4 = 1").select(F.concat(F.lit(f"{at}/lost/"), k, F.lit(".pdf")).alias("path"), F.lit("lost").alias("content"))
    _all_done(files.write_files(made.unionByName(lost)))
    return at, candidates, files.listing(spark, at)


@query("""WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 2 WHEN s_suppkey % 5 <> 0 THEN 3 END AS place FROM supplier)
SELECT s_suppkey, place, CAST(10 * place + s_suppkey % 7 AS BIGINT) AS size FROM p WHERE place IS NOT NULL""")
def first_existing_file(spark, sf):
    """The first of a supplier's three places that holds its attachment."""
    _, candidates, listed = _attachments(spark, sf)
    return files.first_existing(candidates, listed, "s_suppkey").select("s_suppkey", "place", "size")


@query("SELECT 'archive/' || s_suppkey || '.pdf' AS name, CAST(4 AS BIGINT) AS size FROM supplier WHERE s_suppkey % 4 = 1")
def orphan_files(spark, sf):
    """Files that nothing refers to are copied to an archive and deleted; what the folders hold then."""
    at, candidates, listed = _attachments(spark, sf)
    gone = written(files.orphans(listed, candidates), "orphans")
    moves = gone.select(F.col("path").alias("source"), F.regexp_replace("path", "/lost/", "/archive/").alias("target"))
    copied = written(files.copy_files(moves), "copied")
    _all_done(copied)
    _all_done(files.delete_files(copied.where("done").select("path")))
    now = files.orphans(files.listing(spark, at), candidates)
    return now.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("name"), "size")


# Companies


@query("SELECT 'co' || c_nationkey AS company, '1995_96' AS fy, CAST(c_custkey AS VARCHAR) AS code, c_name AS name, 'N' || c_custkey % 97 AS accno FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 2 = 0")
def company_ledgers(spark, sf):
    """Bank accounts of one year from the ledger files of companies, of which some have other years only."""
    at = _folder(spark, "companies")
    c = table(spark, sf, "customer")
    group = F.when(F.col("c_custkey") % 3 == 0, "Bank Accounts").otherwise("Sundry")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", group, F.lit("B"), F.concat(F.lit("N"), (F.col("c_custkey") % 97).cast("string")))
    whole = F.concat(F.lit("code,name,acgroup,bank,accno\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"))
    by_company = c.groupBy("c_nationkey").agg(whole.alias("content"))
    name = F.when(F.col("c_nationkey") % 4 == 0, F.lit("DB1199596.csv")).when(F.col("c_nationkey") % 2 == 0, F.lit("db199596.csv"))
    spots = F.filter(F.array(name, F.lit("db199697.csv"), F.when(F.col("c_nationkey") % 4 == 0, F.lit("db199596.csv"))), lambda n: n.isNotNull())
    each = by_company.select("c_nationkey", F.posexplode(spots).alias("i", "name"), "content")
    content = F.when(F.col("i") == 0, F.col("content")).otherwise(F.lit("code,name,acgroup,bank,accno\n0,OTHER,Bank Accounts,B,N0"))
    content = F.when((F.col("name") == "db199697.csv"), F.lit("code,name,acgroup,bank,accno\n0,OTHER,Bank Accounts,B,N0")).otherwise(content)
    _all_done(files.write_files(each.select(F.concat(F.lit(f"{at}/co"), F.col("c_nationkey").cast("string"), F.lit("/"), "name").alias("path"), content.alias("content"))))
    found = company.company_accounts(spark, at)
    return found.where("fy = '1995_96' and acgroup = 'Bank Accounts'").select("company", "fy", "code", "name", "accno")


# Streams


@query("SELECT DISTINCT user_id, event_type, CAST(year(ts) - CASE WHEN month(ts) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fy_start FROM events")
def stream_keyed_ingest(spark, sf):
    """Deliveries whose keys are the stream's state: several batches, then a restart that finds the first ones delivered again and some that are new."""
    root = os.path.join(scratch_root(spark), f"tallybook-keyed-{uuid.uuid4().hex}")
    events = table(spark, sf, "events")
    first, rest = events.where("event_id % 3 > 0"), events.where("event_id % 3 = 0")
    run = lambda: ingest_keyed(spark, f"{root}/source", events.schema, f"{root}/target", f"{root}/checkpoint", ["user_id", "event_type"], "ts", files_per_batch=2)
    first.repartition(4, "event_id").write.parquet(f"{root}/source")
    run()
    first.unionByName(rest).repartition(4, "event_id").write.mode("append").parquet(f"{root}/source")
    return run().select("user_id", "event_type", F.substring("fy", 1, 4).cast("int").alias("fy_start"))


# Normalisers


@query(f"WITH {TX} SELECT file, n, bal + 10000 AS balance FROM tx")
def back_filled_balance(spark, sf):
    """Only every file's last balance is printed; the others follow from the lines behind them."""
    tx = transactions(spark, sf)
    last = F.row_number().over(LG.Window.partitionBy("file").orderBy(F.desc("n"))) == 1
    zero = F.lit(0).cast("decimal(18,2)")
    rows = tx.withColumns({"deposit": F.when(F.col("dr"), zero).otherwise(F.col("amt")), "withdrawal": F.when(F.col("dr"), F.col("amt")).otherwise(zero), "balance": F.when(last, F.col("bal") + 100).cast("decimal(18,2)")})
    return LG.fill_balance(rows, ["file"], ["n"]).select("file", F.col("n").cast("long").alias("n"), F.round(F.col("balance") * 100).cast("long").alias("balance"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey + 100000000000000 AS VARCHAR) WHEN 2 THEN left('1234567890' || '1234567890' || CAST(o_orderkey AS VARCHAR), 20) ELSE '' END AS ack,
CASE o_orderkey % 3 WHEN 0 THEN lpad(CAST(o_orderkey % 2000 AS VARCHAR), 4, '0') ELSE '' END AS heads, CASE o_orderkey % 2 WHEN 0 THEN 'pay 1,234.50 to 7' ELSE 'pay 1,234.5 0x' END AS healed FROM orders""".replace("'pay 1,234.5 0x'", "'no 12 a'"))
def acknowledgements_and_heads(spark, sf):
    """Acknowledgement numbers, leading digits of file names, and amounts that white space has split."""
    k = F.col("o_orderkey")
    t = k.cast("string")
    ack = F.when(k % 4 == 0, " NaN ").when(k % 4 == 1, F.concat(F.lit("Ack-"), (k + 100000000000000).cast("string"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("1234567890/1234567890/"), t)).otherwise(F.lit("none"))
    names = F.array(F.when(k % 3 == 0, F.concat(F.lit("x/"), F.lpad((k % 2000).cast("string"), 4, "0"), F.lit("99.pdf"))).otherwise(F.lit("abc12345.pdf")), F.lit("y\\2024-x.pdf"))
    split = F.when(k % 2 == 0, F.lit("pay 1 ,234 . 50 to 7")).otherwise(F.lit("no 12 a"))
    return table(spark, sf, "orders").select(k.alias("k"), S.clean_ack(ack).alias("ack"), F.concat_ws(",", S.leading_digits(names)).alias("heads"), S.heal_numbers(split).alias("healed"))
