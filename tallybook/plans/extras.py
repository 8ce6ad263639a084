"""Further queries: sheets and other sinks as columns, imports, pickers, and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions import fiscal
from tallybook.functions import predicates as P
from tallybook.functions import scalars as S
from tallybook.operators import ledger as L
from tallybook.operators import mutations as M
from tallybook.operators import relational as R
from tallybook.operators import statements as T
from tallybook.plans.fixtures import ACCOUNTS, ENTRIES, HIGH, LOW, accounts, day, entries, fy_sql
from tallybook.plans.ledgers import LINES, accts, full_lines
from tallybook.session import table
from tallybook.sources.sinks import json_rows, split_rejects

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


@query("SELECT max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS status FROM orders")
def latest_by_id(spark, sf):
    return table(spark, sf, "orders").agg(F.max("o_orderkey").alias("id"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


@query(f"WITH {ENTRIES}, {ACCOUNTS} SELECT id FROM entries WHERE account_id IN (SELECT account_id FROM accounts WHERE group_id = 7)")
def fk_path_predicate(spark, sf):
    a = accounts(spark, sf).where("group_id = 7").select("account_id")
    return entries(spark, sf).join(a, "account_id", "left_semi").select("id")


@query("SELECT DISTINCT c_mktsegment AS option FROM customer ORDER BY 1")
def dropdown_options(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("option")).distinct().orderBy("option")


@query(f"WITH {ACCOUNTS}, m AS (SELECT unnest(generate_series(DATE '{LOW}', DATE '{HIGH}', INTERVAL 1 MONTH))::DATE AS month_start) SELECT account_id, month_start, last_day(month_start) AS month_end FROM accounts, m")
def account_months(spark, sf):
    return fiscal.month_dimension(accounts(spark, sf).select("account_id"), day(LOW), day(HIGH))


@query(f"WITH {ENTRIES} SELECT id, CASE WHEN fy = '1996_97' AND status = 'O' THEN '1997_98' ELSE fy END AS fy FROM entries")
def move_between_shards(spark, sf):
    return M.updated_where(entries(spark, sf), (F.col("fy") == "1996_97") & (F.col("status") == "O"), {"fy": F.lit("1997_98")}).select("id", "fy")


# Sheets


@query(f"""WITH {ENTRIES}, v AS (SELECT *, row_number() OVER (PARTITION BY account_id % 100, strftime(from_date, '%b') ORDER BY from_date, id) AS rn, CASE priority WHEN '1-URGENT' THEN 'ATM cash' WHEN '2-HIGH' THEN 'cash chrg' ELSE 'other' END AS n FROM entries)
SELECT id, 'BANK' || lpad(CAST(account_id % 100 AS VARCHAR), 2, '0') || '-' || strftime(from_date, '%b') || '-' || CASE WHEN rn < 10000 THEN lpad(CAST(rn AS VARCHAR), 4, '0') ELSE CAST(rn AS VARCHAR) END AS voucher,
 CASE WHEN n = 'ATM cash' THEN amount ELSE 0 END AS cash, CASE WHEN n = 'ATM cash' THEN 0 ELSE amount END AS bank FROM v""")
def ledger_sheet(spark, sf):
    narration = F.when(F.col("priority") == "1-URGENT", "ATM cash").when(F.col("priority") == "2-HIGH", "cash chrg").otherwise("other")
    prefix = F.concat(F.lit("BANK"), F.lpad((F.col("account_id") % 100).cast("string"), 2, "0"), F.lit("-"), F.date_format("from_date", "MMM"))
    out = L.voucher_serial(entries(spark, sf).withColumn("cash_row", S.is_cash(narration)), prefix, ["from_date", "id"])
    return out.select("id", "voucher", F.when(F.col("cash_row"), F.col("amount")).otherwise(0.0).alias("cash"), F.when(F.col("cash_row"), 0.0).otherwise(F.col("amount")).alias("bank"))


@query("""WITH s AS (SELECT c_custkey, 'BANK-' || right('0000' || CAST(c_custkey % 400 AS VARCHAR), 4) AS name FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS rn FROM s)
SELECT c_custkey, CASE WHEN rn = 1 THEN name ELSE name || '_' || rn END AS sheet FROM r""")
def bank_sheet_names(spark, sf):
    k = F.col("c_custkey")
    named = table(spark, sf, "customer").select("c_custkey", S.sheet_name(F.lit("BA?NK"), F.concat(F.lit("No 0000"), (k % 400).cast("string"))).alias("name"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("c_custkey"))
    return named.withColumn("n", n).select("c_custkey", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("_"), F.col("n").cast("string"))).alias("sheet"))


@query(f"""WITH {ENTRIES}, {ACCOUNTS}, c AS (SELECT group_id, account_id, count(*) AS n FROM entries JOIN accounts USING (account_id) GROUP BY ALL)
SELECT group_id, string_agg(account_id || '=' || n, ';' ORDER BY account_id) AS detail, sum(n)::BIGINT AS total FROM c GROUP BY 1""")
def nested_detail(spark, sf):
    c = entries(spark, sf).groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).join(accounts(spark, sf).select("account_id", "group_id"), "account_id")
    cells = F.transform(F.sort_array(F.collect_list(F.struct("account_id", "n"))), lambda s: F.concat(s["account_id"].cast("string"), F.lit("="), s["n"].cast("string")))
    return c.groupBy("group_id").agg(F.array_join(cells, ";").alias("detail"), F.sum("n").alias("total"))


@query("SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def json_sink(spark, sf):
    return json_rows(table(spark, sf, "nation").select("n_nationkey", "n_name"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'tiny' END AS reason FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 2000")
def reject_log(spark, sf):
    reason = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") < 2000, "tiny")
    return split_rejects(table(spark, sf, "orders"), reason)[1].select("o_orderkey", "reason")


@query(f"WITH {ENTRIES} SELECT id, fy || '/' || 'box' || account_id % 9 || '/' || 'Order_' || id || '.pdf' AS path FROM entries")
def partitioned_paths(spark, sf):
    e = entries(spark, sf)
    return e.select("id", S.partition_path(F.col("fy"), F.concat(F.lit("box"), (F.col("account_id") % 9).cast("string")), F.concat(F.lit("Order #"), F.col("id").cast("string"), F.lit(".pdf"))).alias("path"))


@query(f"WITH {LINES} SELECT event_id, balance, last_value(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opening FROM full_lines")
def opening_carried_over_pages(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return full_lines(spark, sf).select("event_id", "balance", F.last("balance", True).over(w).alias("opening"))


@query("""WITH r AS (SELECT o_custkey AS file, o_orderkey % 3 AS t, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 11 <> 0),
s AS (SELECT file, t, sum(CASE WHEN n = 1 THEN 0 WHEN t = 0 THEN 3 ELSE 1 END)::BIGINT AS score FROM r WHERE t < 2 GROUP BY ALL)
SELECT file, arg_max(t, score * 10 - t) AS t, max(score) AS score FROM s WHERE score > 0 GROUP BY 1""")
def table_scores(spark, sf):
    """Tables of dated rows (0), of numbers without dates (1) and too narrow ones (2); every eleventh row is blank."""
    k = F.col("o_orderkey")
    dated = F.concat_ws("|", F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("x"), F.lit("1.50"), F.lit(""))
    line = F.when(k % 11 == 0, " | | | ").when(k % 3 == 0, dated).when(k % 3 == 1, F.concat_ws("|", F.lit("n"), k.cast("string"), F.lit("x"), F.lit("y"))).otherwise("01/02/2024|3")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), (k % 3).alias("t"), k.alias("seq"), F.split(line, r"\|").alias("cells"))
    return T.best_table(T.table_scores(rows, ["file"], "t", "seq", "cells"), ["file"], "t")


@query("SELECT 'pan' AS kind, 'Tax Id' AS column_name UNION ALL SELECT 'ack', 'Receipt'")
def best_columns(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select((k % 1000000 + 9000000000).cast("string").alias("Phone"), F.concat(F.lit("abcde"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("f")).alias("Tax Id"), (k + 100000000000000).cast("string").alias("Receipt"), F.lit(None).cast("string").alias("Empty"))
    pan, ack = (T.best_column(score(df, df.columns), df.columns) for score in (T.pan_scores, T.column_scores))
    return pan.select(F.lit("pan").alias("kind"), "column_name").unionByName(ack.select(F.lit("ack").alias("kind"), "column_name"))


# Imports and lookups


@query("""WITH u AS (SELECT o_orderkey AS line, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) || '.0' WHEN o_orderkey % 3 = 1 THEN 'x' ELSE NULL END AS code, 'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name FROM orders),
a AS (SELECT line, c_custkey AS by_id FROM u JOIN customer ON code = CAST(c_custkey AS VARCHAR) || '.0'), b AS (SELECT line, min(c_custkey) AS by_name FROM u JOIN customer ON upper(c_name) = name GROUP BY 1)
SELECT u.line, coalesce(by_id, by_name) AS client_id, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_name IS NOT NULL THEN 'name' ELSE 'skipped' END AS found FROM u LEFT JOIN a USING (line) LEFT JOIN b USING (line)""")
def import_lookup(spark, sf):
    o, r = table(spark, sf, "orders"), F.col("o_orderkey") % 3
    raw = o.select(F.col("o_orderkey").cast("string").alias(" LINE"), F.when(r == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).when(r == 1, "x").alias("Code "), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("Party"))
    u = R.renamed_by_alias(raw, {"line": [], "code": [], "name": ["party"], "missing": []}).withColumn("code", S.normalize_code(F.col("code")))
    c = table(spark, sf, "customer")
    by_id = c.select(F.col("c_custkey").cast("string").alias("code"), F.col("c_custkey").alias("by_id"))
    by_name = c.groupBy(F.lower("c_name").alias("key")).agg(F.min("c_custkey").alias("by_name"))
    out = u.join(by_id, "code", "left").withColumn("key", F.lower("name")).join(by_name, "key", "left")
    found = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("skipped")
    return out.select(F.col("line").cast("long").alias("line"), F.coalesce("by_id", "by_name").alias("client_id"), found.alias("found"))


@query("""WITH p AS (SELECT c_custkey, 'ABCDE' || lpad(CAST(c_custkey % 500 AS VARCHAR), 4, '0') || 'F' AS pan FROM customer), u AS (SELECT s_suppkey AS line, 'ABCDE' || lpad(CAST(s_suppkey % 600 AS VARCHAR), 4, '0') || 'F' AS pan FROM supplier)
SELECT u.line, p.c_custkey FROM u JOIN p USING (pan) WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = p.c_custkey AND o_orderstatus = 'O')""")
def pan_to_clients(spark, sf):
    pan = lambda k, n: S.normalize_pan(F.concat(F.lit(" abcde"), F.lpad((k % n).cast("string"), 4, "0"), F.lit("f")))
    p = table(spark, sf, "customer").select("c_custkey", pan(F.col("c_custkey"), 500).alias("pan"))
    u = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line"), pan(F.col("s_suppkey"), 600).alias("pan"))
    filed = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return u.join(p, "pan").join(filed, "c_custkey", "left_semi").select("line", "c_custkey")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey % 100 AS item, 'f' || o_orderkey % 4 || '.pdf' AS want, CASE WHEN o_orderkey % 5 = 0 THEN 'skip' ELSE 'save' END AS action FROM orders), have AS (SELECT range AS item, 'f' || range % 3 || '.pdf' AS name FROM range(100))
SELECT CASE WHEN action = 'skip' THEN 'ignored' WHEN name IS NULL THEN 'skipped' ELSE 'saved' END AS outcome, count(*) AS n FROM f LEFT JOIN have ON have.item = f.item AND name = want GROUP BY 1""")
def save_documents(spark, sf):
    k = F.col("o_orderkey")
    f = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("item"), F.concat(F.lit("f"), (k % 4).cast("string"), F.lit(".pdf")).alias("name"), (k % 5 != 0).alias("save"))
    files = spark.range(100).select(F.col("id").alias("item"), F.array(F.concat(F.lit("f"), (F.col("id") % 3).cast("string"), F.lit(".pdf"))).alias("files"))
    have = files.select("item", F.explode("files").alias("name")).withColumn("hit", F.lit(True))
    outcome = F.when(~F.col("save"), "ignored").when(F.col("hit").isNull(), "skipped").otherwise("saved")
    return f.join(have, ["item", "name"], "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(max(c_custkey) + 1 AS VARCHAR) AS next_id FROM customer")
def next_account_id(spark, sf):
    c = table(spark, sf, "customer")
    last = F.max_by(F.col("c_custkey").cast("string"), "c_custkey")
    return c.agg(F.coalesce((last.try_cast("bigint") + 1).cast("string"), F.lit("1")).alias("next_id"))


@query("SELECT CAST(y AS VARCHAR) || '_' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS fy, make_date(y::BIGINT, 4::BIGINT, 1::BIGINT) AS starts FROM range(2015, 2027) r(y)")
def fy_choices(spark, sf):
    years = table(spark, sf, "region").limit(1).select(F.explode(F.sequence(F.lit(2015), F.lit(2026))).alias("y"))
    d = F.make_date("y", F.lit(4), F.lit(1))
    return years.select(fiscal.fy_of(d).alias("fy"), d.alias("starts"))


@query("""WITH e AS (SELECT 'a' || c_custkey % 1200 || '@x.org' AS email, c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey || '@x.org', -s_suppkey FROM supplier)
SELECT email, count(DISTINCT id) AS owners, min(id) AS first_owner FROM e GROUP BY 1 HAVING count(DISTINCT id) > 1""")
def email_owned_twice(spark, sf):
    mail = lambda p, k: F.lower(F.concat(F.lit(p), k.cast("string"), F.lit("@X.org")))
    c = table(spark, sf, "customer").select(mail("A", F.col("c_custkey") % 1200).alias("email"), F.col("c_custkey").alias("id"))
    s = table(spark, sf, "supplier").select(mail("S", F.col("s_suppkey")).alias("email"), (-F.col("s_suppkey")).alias("id"))
    return c.unionByName(s).distinct().groupBy("email").agg(F.count(F.lit(1)).alias("owners"), F.min("id").alias("first_owner")).where("owners > 1")


@query("SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'Plant' ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) END AS label, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1")
def grouped_picker(spark, sf):
    labels = F.create_map(F.lit("MACHINERY"), F.lit("Plant"))
    c = table(spark, sf, "customer").withColumn("label", F.coalesce(F.try_element_at(labels, F.col("c_mktsegment")), F.initcap("c_mktsegment"), F.lit("Others")))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))


# Reports


@query(f"""WITH {ENTRIES}, {ACCOUNTS}, r AS (SELECT e.*, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN row_number() OVER (PARTITION BY account_id, priority IN ('1-URGENT', '2-HIGH') ORDER BY amount, id) END AS n FROM entries e)
SELECT r.id, a.name, CASE WHEN n IS NULL THEN 'Original' ELSE 'Revised(' || n || ')' END AS kind, coalesce(trim(status), 'Pending') AS stage FROM r JOIN accounts a USING (account_id) WHERE r.fy = '1995_96'""")
def report_returns(spark, sf):
    e = L.revision_numbers(entries(spark, sf), ["account_id"], [F.col("amount"), F.col("id")], F.col("priority").isin("1-URGENT", "2-HIGH")).where("fy = '1995_96'")
    kind = F.when(F.col("revision").isNull(), "Original").otherwise(F.concat(F.lit("Revised("), F.col("revision").cast("string"), F.lit(")")))
    return e.join(accounts(spark, sf).select("account_id", "name"), "account_id").select("id", "name", kind.alias("kind"), F.coalesce(F.trim("status"), F.lit("Pending")).alias("stage"))


@query(f"""WITH {ENTRIES}, {ACCOUNTS}, f AS (SELECT group_id, count(DISTINCT CASE WHEN done_date IS NOT NULL THEN account_id END) AS filed, count(DISTINCT CASE WHEN status = 'O' THEN account_id END) AS open_n FROM entries JOIN accounts USING (account_id) WHERE fy = '1996_97' GROUP BY 1)
SELECT n_name, coalesce(filed, 0) AS filed, coalesce(open_n, 0) AS open_n FROM nation LEFT JOIN f ON group_id = n_nationkey WHERE contains(lower(n_name), 'on_1')""")
def report_return_funnel(spark, sf):
    rows = entries(spark, sf, ["1996_97"]).join(accounts(spark, sf).select("account_id", "group_id"), "account_id")
    f = R.stage_funnel(rows, "group_id", "account_id", {"filed": F.col("done_date").isNotNull(), "open_n": F.col("status") == "O"})
    n = table(spark, sf, "nation").where(P.icontains(F.col("n_name"), "ON_1"))
    return n.join(f, n["n_nationkey"] == f["group_id"], "left").select("n_name", F.coalesce("filed", F.lit(0)).alias("filed"), F.coalesce("open_n", F.lit(0)).alias("open_n"))


@query(f"WITH {ENTRIES}, {ACCOUNTS} SELECT id, name, status FROM entries JOIN accounts USING (account_id) WHERE group_id = 3 AND fy = '1996_97' ORDER BY name, id")
def report_group_drill_down(spark, sf):
    a = accounts(spark, sf).where("group_id = 3").select("account_id", "name")
    return entries(spark, sf, ["1996_97"]).join(a, "account_id").select("id", "name", "status").orderBy("name", "id")


@query(f"""WITH {ENTRIES}, {ACCOUNTS} SELECT count(*) AS matched, count(CASE WHEN trim(status) = 'O' THEN 1 END) AS will_change, count(DISTINCT account_id) AS clients FROM entries JOIN accounts USING (account_id) WHERE group_id IN (1, 2) AND fy = '1996_97'""")
def report_reassignment(spark, sf):
    a = accounts(spark, sf).where(F.col("group_id").isin(1, 2)).select("account_id")
    e = entries(spark, sf, ["1996_97"]).join(a, "account_id", "left_semi")
    return e.agg(F.count(F.lit(1)).alias("matched"), F.count(F.when(F.trim("status") == "O", 1)).alias("will_change"), F.countDistinct("account_id").alias("clients"))


@query(f"""WITH m AS (SELECT event_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS client, ts, value > 50 AS has_file, {fy_sql('ts')} AS fy FROM events)
SELECT m.event_id, m.fy, client IS NULL OR c_custkey IS NULL AS mail_not_registered, NOT coalesce(has_file, FALSE) AS document_not_added, CASE WHEN c_custkey IS NOT NULL AND has_file THEN 'done' ELSE 'pending' END AS status
FROM m LEFT JOIN customer ON c_custkey = client WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'""")
def report_mail_list(spark, sf):
    m = table(spark, sf, "events").where(P.on_days(F.col("ts"), "2024-01-01", "2024-01-31")).select("event_id", F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("client"), fiscal.fy_of(F.to_date("ts")).alias("fy"), (F.col("value") > 50).alias("has_file"))
    j = R.related(m, table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey") == F.col("client"))
    known, has = F.col("c_custkey").isNotNull(), F.coalesce("has_file", F.lit(False))
    return j.select("event_id", "fy", (~known).alias("mail_not_registered"), (~has).alias("document_not_added"), F.when(known & has, "done").otherwise("pending").alias("status"))


@query("""WITH l AS (SELECT s_suppkey AS code, s_name AS name FROM supplier), a AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 150 AS VARCHAR) || '.0' END AS ledger FROM customer)
SELECT c_custkey, l.name AS ledger_name, CASE WHEN l.code IS NULL THEN 'pending' ELSE 'done' END AS state FROM a LEFT JOIN l ON CAST(l.code AS VARCHAR) || '.0' = a.ledger""")
def report_mapping(spark, sf):
    k = F.col("c_custkey")
    a = table(spark, sf, "customer").select("c_custkey", S.normalize_code(F.when(k % 2 == 0, F.concat((k % 150).cast("string"), F.lit(".0")))).alias("code"))
    l = R.one_per_key(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("code"), F.col("s_name").alias("ledger_name")), ["code"], [F.col("ledger_name")])
    return a.join(l, "code", "left").select("c_custkey", "ledger_name", F.when(F.col("ledger_name").isNull(), "pending").otherwise("done").alias("state"))


@query(f"""WITH {ENTRIES}, f AS (SELECT l_orderkey AS id, count(*) AS files FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT fy, id, coalesce(files, 0) AS files, CASE WHEN coalesce(files, 0) = 0 THEN 'PENDING' ELSE 'RECEIVED' END AS state FROM entries LEFT JOIN f USING (id)""")
def report_dashboard(spark, sf):
    f = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("files"))
    e = entries(spark, sf).join(f, "id", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    return e.select("fy", "id", "files", F.when(F.col("files") == 0, "PENDING").otherwise("RECEIVED").alias("state"))


@query("""WITH n AS (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section, length(text) AS c FROM conversations)
SELECT conv_id, CAST(section AS BIGINT) AS section, count(*) AS n, sum(c)::BIGINT AS chars FROM n GROUP BY ALL""")
def report_section_summary(spark, sf):
    s = T.sections(table(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return s.groupBy("conv_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {ENTRIES}, {ACCOUNTS} SELECT a.account_id, a.name, n_name FROM accounts a JOIN nation ON n_nationkey = group_id WHERE account_id IN (3, 5, 8, 13, 21) ORDER BY name")
def report_chosen_accounts(spark, sf):
    a = accounts(spark, sf).where(P.in_list(F.col("account_id"), [3, 5, 8, 13, 21]))
    return R.related(a, table(spark, sf, "nation"), F.col("n_nationkey") == F.col("group_id")).select("account_id", "name", "n_name").orderBy("name")
