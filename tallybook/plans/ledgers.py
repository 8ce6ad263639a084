"""Queries of statement lines, text normalisers, linkage, statement parsing, nested values and ingestion."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions import scalars as S
from tallybook.operators import ledger as L
from tallybook.operators import linkage as K
from tallybook.operators import statements as T
from tallybook.plans.fixtures import ENTRIES, entries
from tallybook.session import dealt, scratch_root, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


# Statement lines: a purchase is a deposit, an error a withdrawal, of whole cents; every fifth balance is missing.

LINES = """lines AS (
  SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS deposit,
         CASE WHEN event_type = 'error' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS withdrawal FROM events),
full_lines AS (SELECT *, 100000 + CAST(sum(deposit - withdrawal) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM lines)"""
KEYS, SEQ = ["user_id"], ["ts", "event_id"]


def lines(spark, sf):
    e = table(spark, sf, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    return e.select("user_id", "event_id", "ts", "event_type", F.when(F.col("event_type") == "purchase", cents).otherwise(F.lit(0).cast("long")).alias("deposit"), F.when(F.col("event_type") == "error", cents).otherwise(F.lit(0).cast("long")).alias("withdrawal"))


def full_lines(spark, sf):
    return L.running_balance(lines(spark, sf), KEYS, SEQ, F.lit(100000).cast("long"))


@query(f"WITH {LINES} SELECT event_id, balance FROM full_lines")
def running_balance(spark, sf):
    return full_lines(spark, sf).select("event_id", "balance")


@query(f"WITH {LINES} SELECT event_id, balance FROM full_lines")
def balance_fill(spark, sf):
    holes = full_lines(spark, sf).withColumn("balance", F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, 0).otherwise(F.col("balance")))
    one = F.min("event_id").over(Window.partitionBy("user_id"))
    known = full_lines(spark, sf).withColumn("_one", one).where("event_id = _one").select("event_id", F.col("balance").alias("_sure"))
    patched = holes.join(known, "event_id", "left").withColumn("balance", F.coalesce("_sure", "balance")).drop("_sure")
    return L.fill_balance(patched, KEYS, SEQ).select("event_id", "balance")


@query(f"WITH {LINES}, p AS (SELECT *, lag(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM full_lines) SELECT event_id, CASE WHEN event_type = 'click' THEN 'credit' WHEN balance > prev THEN 'credit' ELSE 'debit' END AS direction FROM p")
def direction_from_delta(spark, sf):
    tag = F.when(F.col("event_type") == "click", "Cr.")
    return L.delta_direction(full_lines(spark, sf), KEYS, SEQ, tag).select("event_id", "direction")


@query(f"""WITH {LINES}, c AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN balance + 7 ELSE balance END AS printed FROM full_lines),
p AS (SELECT *, lag(printed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM c) SELECT event_id, coalesce(prev + deposit - withdrawal <> printed, FALSE) AS balance_mismatch FROM p""")
def reconcile_flag(spark, sf):
    c = full_lines(spark, sf).withColumn("balance", F.col("balance") + F.when(F.col("event_id") % 50 == 0, 7).otherwise(0))
    return L.reconcile(c, KEYS, SEQ).select("event_id", "balance_mismatch")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY length(props) DESC, ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedupe_longest(spark, sf):
    return L.longest_narration(table(spark, sf, "events").withColumnRenamed("props", "narration"), ["user_id", "event_type"], SEQ).select("event_id")


@query(f"""WITH {LINES}, p AS (SELECT event_id, event_type, coalesce(balance - lag(balance) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS change FROM full_lines)
SELECT event_id FROM p WHERE NOT (length(trim(CASE WHEN event_id % 3 = 0 THEN 'ab ' ELSE event_type END)) < 3 AND change = 0)""")
def noise_rows(spark, sf):
    n = full_lines(spark, sf).withColumn("narration", F.when(F.col("event_id") % 3 == 0, "ab ").otherwise(F.col("event_type")))
    return L.without_noise(n, KEYS, SEQ).select("event_id")


@query(f"WITH {ENTRIES} SELECT id, priority || '-' || strftime(from_date, '%b') || '-' || CASE WHEN rn < 10000 THEN lpad(CAST(rn AS VARCHAR), 4, '0') ELSE CAST(rn AS VARCHAR) END AS voucher FROM (SELECT *, row_number() OVER (PARTITION BY priority, strftime(from_date, '%b') ORDER BY from_date, id) AS rn FROM entries)")
def voucher_serial(spark, sf):
    return L.voucher_serial(entries(spark, sf), F.concat("priority", F.lit("-"), F.date_format("from_date", "MMM")), ["from_date", "id"]).select("id", "voucher")


@query("""WITH s AS (SELECT o_custkey, count(*) AS lines, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS debit,
 sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END)::BIGINT AS credit, max(CASE WHEN o_orderstatus <> 'F' AND round(o_totalprice * 100) > 0 THEN CAST(o_orderdate AS DATE) END) AS last_payment FROM orders GROUP BY 1)
SELECT c_custkey AS account_id, coalesce(lines, 0) AS lines, last_payment, CAST(round(c_acctbal * 100) AS BIGINT) - coalesce(debit, 0) + coalesce(credit, 0) AS closing FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def ledger_balance(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("account_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("opening"))
    cents, zero = F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(0).cast("long")
    lines_ = table(spark, sf, "orders").select(F.col("o_custkey").alias("account_id"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", cents).otherwise(zero).alias("debit"), F.when(F.col("o_orderstatus") != "F", cents).otherwise(zero).alias("credit"))
    return L.ledger_balance(c, lines_, "account_id", "opening").select("account_id", "lines", "last_payment", "closing")


# Text normalisers over whole texts


@query("SELECT conv_id, turn, regexp_replace(text, '[^0-9]+', '', 'g') AS d, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM conversations")
def digits_and_alias_keys(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.digits(F.col("text")).alias("d"), S.alias_key(F.col("text")).alias("k"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda e: lower(e)))), ',') AS emails FROM documents")
def emails_in_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(S.emails_in(F.col("text")), ",").alias("emails"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '^ | $', '', 'g') AS body FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.strip_html(F.col("html")).alias("body"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(html, 'https://[^\\s\"''<>]+', 0), ''), nullif(regexp_extract(html, 'href=\"[^\"]+\"', 0), '')) AS link FROM pages")
def first_link(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.first_link(F.col("html"), [r"https://[^\s\"'<>]+", r'href="[^"]+"']).alias("link"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[0-9]+'), lambda r, i: length(r) BETWEEN 9 AND 18 AND list_position(regexp_extract_all(text, '[0-9]+'), r) = i), ',') AS numbers, lpad(CAST(doc_id AS VARCHAR), 4, '0') AS tails FROM documents")
def account_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(S.account_numbers(F.col("text")), ",").alias("numbers"), F.array_join(S.masked_tails(F.concat("text", F.lit(" a/c xx"), F.lpad(F.col("doc_id").cast("string"), 4, "0"))), ",").alias("tails"))


@query("""WITH t AS (SELECT p_partkey, p_retailprice, CAST(p_retailprice AS DECIMAL(18,2)) AS v FROM part)
SELECT p_partkey, v AS plain, v AS grouped, -v AS bracketed, -v AS debit, CAST(0 AS DECIMAL(18,2)) AS dash, CAST(NULL AS DECIMAL(18,2)) AS bad FROM t""")
def parse_money(spark, sf):
    v = F.col("p_retailprice").cast("decimal(18,2)")
    shown = F.format_number(v, 2)
    m = S.parse_money
    return table(spark, sf, "part").select("p_partkey", m(v.cast("string")).alias("plain"), m(F.concat(F.lit("Rs. "), shown)).alias("grouped"), m(F.concat(F.lit("("), shown, F.lit(")"))).alias("bracketed"), m(F.concat(shown, F.lit(" Dr"))).alias("debit"), m(F.lit("-")).alias("dash"), m(F.lit("n/a")).alias("bad"))


@query(f"WITH {ENTRIES} SELECT id, from_date AS iso, from_date AS dashed, from_date AS slashed, from_date AS named, CAST(NULL AS DATE) AS impossible FROM entries")
def multi_format_date(spark, sf):
    d, p = F.col("from_date"), S.parse_date
    e = entries(spark, sf)
    return e.select("id", p(d.cast("string")).alias("iso"), p(F.date_format(d, "d-M-yyyy")).alias("dashed"), p(F.date_format(d, "dd/MM/yyyy")).alias("slashed"), p(F.date_format(d, "dd-MMM-yyyy")).alias("named"), p(F.concat(F.lit("31-02-"), F.year(d).cast("string"))).alias("impossible"))


@query(f"""WITH {ENTRIES} SELECT id, CASE WHEN id % 2 = 0 THEN from_date ELSE CAST(date_trunc('month', from_date) - INTERVAL 1 MONTH AS DATE) END AS start,
CASE WHEN id % 2 = 0 THEN last_date ELSE CAST(date_trunc('month', from_date) AS DATE) - 1 END AS "end" FROM entries""")
def period_window(spark, sf):
    day = lambda c: F.date_format(c, "dd-MM-yyyy")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Statement for the Period "), day("last_date"), F.lit(" to "), day("from_date"))).otherwise("no dates here")
    return S.with_period(entries(spark, sf).withColumn("text", text), "text", "from_date").select("id", "start", "end")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS code, 'A' || o_orderkey AS other FROM orders")
def normalize_code(spark, sf):
    k = F.col("o_orderkey").cast("string")
    return table(spark, sf, "orders").select("o_orderkey", S.normalize_code(F.concat(F.lit(" "), k, F.lit(".0"))).alias("code"), S.normalize_code(F.concat(F.lit(" A"), k)).alias("other"))


@query("""SELECT conv_id, turn, (contains(lower(text), 'cash') OR contains(lower(text), 'atm') OR contains(lower(text), 'self')) AND NOT (contains(lower(text), 'chrgs') OR contains(lower(text), 'chrg')
 OR contains(lower(text), 'charge') OR contains(lower(text), 'chg') OR contains(lower(text), 'upi') OR contains(lower(text), 'transfer')) AS cash FROM conversations""")
def cash_class(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", S.is_cash(F.col("text")).alias("cash"))


# Linkage

MAILS = """mails AS (SELECT o_orderkey AS message_id, o_custkey AS client_id, o_custkey * 3 + o_orderkey % 3 AS hint, o_orderkey % 5 AS kind FROM orders)"""
ACCTS = """accts AS (SELECT c_custkey * 3 + k AS account_id, c_custkey AS client_id, lpad(CAST(100000000 + (c_custkey * 3 + k) * 7919 AS VARCHAR), 11, '9') AS number, CASE k WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' ELSE 'GAMMA' END AS bank
  FROM customer, range(3) r(k) WHERE c_custkey % 4 <> 0 OR k = 0)"""


def accts(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("client_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).where("client_id % 4 <> 0 or k = 0")
    id_ = F.col("client_id") * 3 + F.col("k")
    return c.select(id_.alias("account_id"), "client_id", F.concat(F.lit("AC "), F.lpad((100000000 + id_ * 7919).cast("string"), 11, "9")).alias("account_no"), F.element_at(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), F.col("k") + 1).alias("bank_word"))


def number_of(account):
    return F.lpad((100000000 + account * 7919).cast("string"), 11, "9")


@query(f"""WITH {MAILS}, {ACCTS}, t AS (SELECT message_id, client_id, kind, lpad(CAST(100000000 + hint * 7919 AS VARCHAR), 11, '9') AS hinted, CASE hint % 3 WHEN 0 THEN 'ALPHA' WHEN 1 THEN 'BETA' ELSE 'GAMMA' END AS word FROM mails),
f AS (SELECT message_id, account_id, 1 AS tier, hinted AS token FROM t JOIN accts USING (client_id) WHERE kind = 0 AND number = hinted),
tl AS (SELECT message_id, account_id, bank, word, right(hinted, 4) AS token, count(*) OVER (PARTITION BY message_id) AS n FROM t JOIN accts USING (client_id) WHERE kind = 1 AND right(number, 4) = right(hinted, 4)),
hd AS (SELECT message_id, account_id, bank, word, left(hinted, 4) AS token, count(*) OVER (PARTITION BY message_id) AS n FROM t JOIN accts USING (client_id) WHERE kind = 2 AND left(number, 4) = left(hinted, 4)),
so AS (SELECT message_id, min(account_id) AS account_id FROM t JOIN accts USING (client_id) GROUP BY 1 HAVING count(*) = 1),
allc AS (SELECT message_id, account_id, tier, token FROM f UNION ALL SELECT message_id, account_id, CASE WHEN n = 1 THEN 2 WHEN word = bank THEN 3 END, token FROM tl
 UNION ALL SELECT message_id, account_id, CASE WHEN n = 1 THEN 4 WHEN word = bank THEN 5 END, token FROM hd UNION ALL SELECT message_id, account_id, 6, '' FROM so)
SELECT message_id, account_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY tier, token, account_id) AS rn FROM allc WHERE tier IS NOT NULL) WHERE rn = 1""")
def tiered_match(spark, sf):
    o = table(spark, sf, "orders")
    hint = F.col("o_custkey") * 3 + F.col("o_orderkey") % 3
    kind, n = F.col("o_orderkey") % 5, number_of(hint)
    none = F.array().cast("array<string>")
    m = o.select(
        F.col("o_orderkey").alias("message_id"), F.col("o_custkey").alias("client_id"), F.when(kind == 0, F.array(n)).otherwise(none).alias("full"),
        F.when(kind == 1, F.array(F.right(n, F.lit(4)))).otherwise(none).alias("tails"), F.when(kind == 2, F.array(F.left(n, F.lit(4)))).otherwise(none).alias("heads"),
        F.element_at(F.array(F.lit("ALPHA"), F.lit("BETA"), F.lit("GAMMA")), (hint % 3).cast("int") + 1).alias("words"),
    )
    return K.tiered_accounts(m, accts(spark, sf))


@query(f"""WITH {ACCTS}, t AS (SELECT o_orderkey AS message_id, CASE o_orderkey % 3 WHEN 0 THEN n WHEN 1 THEN right(n, 4) ELSE right(n, 2) END AS token FROM (SELECT o_orderkey, lpad(CAST(100000000 + (o_custkey * 3 + o_orderkey % 3) * 7919 AS VARCHAR), 11, '9') AS n FROM orders)),
h AS (SELECT message_id, account_id, 3 AS score FROM t JOIN accts ON token = number UNION ALL SELECT message_id, account_id, 2 FROM t JOIN accts ON token = right(number, 4) UNION ALL SELECT message_id, account_id, 1 FROM t JOIN accts ON token = right(number, 2))
SELECT message_id, account_id, score FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY score DESC, account_id) AS rn FROM h) WHERE rn = 1""")
def scored_best_match(spark, sf):
    o = table(spark, sf, "orders")
    n, r = number_of(F.col("o_custkey") * 3 + F.col("o_orderkey") % 3), F.col("o_orderkey") % 3
    t = o.select(F.col("o_orderkey").alias("message_id"), F.when(r == 0, n).when(r == 1, F.right(n, F.lit(4))).otherwise(F.right(n, F.lit(2))).alias("token"))
    return K.scored_accounts(t, accts(spark, sf))


@query("""WITH e AS (SELECT lower(c_mktsegment) || c_custkey % 700 || '@x.org' AS email, c_custkey AS id FROM customer UNION ALL SELECT 'extra' || c_custkey % 90 || '@x.org', c_custkey FROM customer)
SELECT email, max(id) AS client_id FROM e GROUP BY 1""")
def explode_emails_lookup(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("client_id"), F.concat("c_mktsegment", (k % 700).cast("string"), F.lit("@X.org ")).alias("email"), F.array(F.concat(F.lit("extra"), (k % 90).cast("string"), F.lit("@x.org")), F.lit(" ")).alias("extra"))
    return K.email_owners(c, "client_id", "email", "extra")


@query("SELECT 'm' || c_custkey % 50 AS email, c_custkey AS client_id FROM customer UNION SELECT 'm' || s_suppkey % 50, s_suppkey FROM supplier")
def multi_source_candidates(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit(" M"), (F.col("c_custkey") % 50).cast("string")).alias("e"), F.col("c_custkey").alias("id"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("m"), (F.col("s_suppkey") % 50).cast("string")).alias("e"), F.col("s_suppkey").alias("id"))
    return K.candidate_clients([(c, "e", "id"), (s, "e", "id"), (c, "e", "id")])


@query(f"""WITH {ACCTS}, t AS (SELECT c_custkey AS key, lpad(CAST(100000000 + c_custkey * 3 * 7919 AS VARCHAR), 11, '9') AS typed FROM customer),
c AS (SELECT key, account_id, CASE WHEN number = typed THEN 1 WHEN right(number, 5) = right(typed, 5) THEN 2 WHEN right(number, 4) = right(typed, 4) THEN 3 END AS tier FROM t JOIN accts ON client_id = key)
SELECT key, account_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, account_id) AS rn FROM c WHERE tier IS NOT NULL) WHERE rn = 1""")
def cascading_lookup(spark, sf):
    from tallybook.operators.relational import cascading

    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), number_of(F.col("c_custkey") * 3).alias("typed"))
    c = t.join(accts(spark, sf), F.col("key") == F.col("client_id")).withColumn("number", S.digits(F.col("account_no")))
    tails = [F.right("number", F.lit(k)) == F.right("typed", F.lit(k)) for k in (5, 4)]
    return cascading(c, ["key"], [F.col("number") == F.col("typed"), *tails], [F.col("account_id")]).select("key", "account_id", "tier")


@query("""WITH a AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS w, min(p_partkey % 400) AS owner_id FROM part GROUP BY 1),
t AS (SELECT p_partkey AS text_id, trim(regexp_replace(lower(p_type || ' ' || p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS b FROM part),
h AS (SELECT text_id, owner_id, length(w) AS score FROM t, a WHERE length(w) >= 4 AND contains(' ' || b || ' ', ' ' || w || ' ')
 UNION ALL SELECT text_id, owner_id, length(w) - 1 FROM t, a WHERE length(w) >= 4 AND contains(replace(b, ' ', ''), replace(w, ' ', '')))
SELECT text_id, owner_id, score FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, owner_id) AS rn FROM h WHERE score >= 6) WHERE rn = 1""")
def alias_longest_match(spark, sf):
    p = table(spark, sf, "part")
    a = p.select((F.col("p_partkey") % 400).alias("owner_id"), F.col("p_name").alias("alias"))
    return K.longest_alias(p.select(F.col("p_partkey").alias("text_id"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("text")), a)


@query("""WITH m AS (SELECT event_id AS mail_id, user_id % 300 AS k, ts, CASE WHEN event_id % 4 <> 0 THEN 'http://x/' || event_id END AS link FROM events)
SELECT c_custkey AS entry_id, (SELECT arg_max(link, ROW(ts, mail_id)) FROM m WHERE link IS NOT NULL AND m.k = c_custkey) AS link FROM customer""")
def latest_match_lookup(spark, sf):
    ids = lambda k: F.concat(F.lit("<ID"), k.cast("string"), F.lit("@X>"))
    m = table(spark, sf, "events").select(F.col("event_id").alias("mail_id"), S.message_id(ids(F.col("user_id") % 300)).alias("msg_id"), F.col("ts").alias("fetched_at"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("http://x/"), F.col("event_id").cast("string"))).alias("link"))
    e = table(spark, sf, "customer").select(F.col("c_custkey").alias("entry_id"), S.message_id(ids(F.col("c_custkey"))).alias("msg_id"))
    return K.latest_link(e, m)


@query(f"WITH {ACCTS} SELECT account_id FROM accts WHERE number NOT IN (SELECT number FROM accts WHERE account_id % 2 = 0) AND CAST(account_id AS VARCHAR) NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 3 = 0)")
def unmapped_accounts(spark, sf):
    a = accts(spark, sf)
    known = a.where("account_id % 2 = 0").select(F.col("account_no").alias("number"), F.lit("").alias("code")).unionByName(table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.lit("").alias("number"), F.col("c_custkey").cast("string").alias("code")))
    return K.unmapped(a, known, F.col("account_no"), F.col("account_id").cast("string")).select("account_id")


# Statement parsing


@query("SELECT 'ack' AS column_name, (SELECT sum(CASE WHEN length(n) BETWEEN 14 AND 16 THEN 3 WHEN length(n) BETWEEN 12 AND 20 THEN 1 ELSE 0 END)::BIGINT + 3 FROM (SELECT CAST(o_orderkey * 1000000007 + 100000000000 AS VARCHAR) AS n FROM orders)) AS score UNION ALL SELECT 'mobile', (SELECT -2 * count(*) FROM orders) UNION ALL SELECT 'other', 0")
def column_score(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select((k * 1000000007 + 100000000000).cast("string").alias("ack"), (k % 1000000 + 9000000000).cast("string").alias("mobile"), F.col("o_orderstatus").alias("other"))
    return T.column_scores(df, ["ack", "mobile", "other"])


DOC_LINES = "lines AS (SELECT doc_id, UNNEST(range(len(string_split(text, chr(10))))) AS seq, UNNEST(string_split(text, chr(10))) AS line FROM documents)"


def doc_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))


@query(f"""WITH {DOC_LINES}, n AS (SELECT *, sum(CASE WHEN line LIKE 'Th%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS block FROM lines)
SELECT doc_id, CAST(block AS BIGINT) AS block, md5(string_agg(line, ' ' ORDER BY seq)) AS digest FROM n WHERE block > 0 GROUP BY ALL""")
def block_grouping(spark, sf):
    blocks = L.line_blocks(doc_lines(spark, sf), ["doc_id"], "seq", F.startswith("line", F.lit("Th")))
    return blocks.select("doc_id", "block", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""WITH {DOC_LINES}, n AS (SELECT *, sum(CASE WHEN contains(line, '|') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS section FROM lines)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n FROM n GROUP BY ALL""")
def section_rows(spark, sf):
    s = T.sections(doc_lines(spark, sf), ["doc_id"], "seq", F.contains("line", F.lit("|")))
    return s.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'pipe' WHEN regexp_matches(text, '[A-Z]{6,}!!') THEN 'shout' ELSE 'unknown' END AS format FROM documents")
def detect_format(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.detect_format(F.col("text"), [("pipe", r" \| "), ("shout", "[A-Z]{6,}!!")]).alias("format"))


#: Tables that one task scores, but for chance.
TABLES = 25_000
HEADERS = ["Txn Date|Particulars|Withdrawals|Deposits|Balance", "a|b|c", "Value Date|Narration|Amount|Dr/Cr|Balance|x", "Date|Remarks|Balance"]


@query("""SELECT c_custkey AS t, CASE WHEN c_custkey % 9 IN (0, 4, 8) THEN 1 ELSE (CASE c_custkey % 9 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 5 THEN 0 ELSE 1 END) END AS seq,
CASE WHEN c_custkey % 9 IN (0, 1, 2) THEN 6.0 WHEN c_custkey % 9 IN (3, 4, 5) THEN 5.8 ELSE 4.0 END AS score FROM customer WHERE c_custkey % 10 <> 9""")
def header_score(spark, sf):
    """Three rows a table: the header, at place 0 to 2, a row of unknown cells and one of six, which is below the floor; a tenth of the tables has none."""
    k = F.col("c_custkey")
    kind, place = (k % 9 / 3).cast("int"), F.element_at(F.array(*map(F.lit, [1, 2, 0, 2, 1, 0, 1, 1, 1])), (k % 9).cast("int") + 1)
    header = F.element_at(F.array(*map(F.lit, [HEADERS[0], HEADERS[2], HEADERS[3]])), kind + 1)
    customers = dealt(table(spark, sf, "customer").select("c_custkey"), TABLES, "c_custkey")
    rows = customers.select(k.alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"), header.alias("header"), place.alias("place"))
    line = F.when((F.col("seq") == F.col("place")) & (F.col("t") % 10 != 9), F.col("header")).otherwise("a|b|c|d|e|f")
    rows = rows.select("t", "seq", F.split(line, r"\|").alias("cells"))
    return T.best_header(rows, ["t"], "seq", "cells").select("t", "seq", F.round("score", 6).alias("score"))


@query("""SELECT 'S' || o_custkey AS file, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT) / 100.0) AS paid, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY 1""")
def parse_pipe_statements(spark, sf):
    o = table(spark, sf, "orders")
    amount = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    line = F.concat_ws(" | ", F.lit("0001"), F.date_format("o_orderdate", "dd-MMM-yyyy"), F.lit("TO TRANSFER"), F.lit(""), F.lit(""), amount, F.concat(amount, F.lit(" Cr")), F.lit("MAIN"))
    head = o.select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("file"), F.lit(-1).cast("long").alias("seq"), F.lit("Account | Tran Date | ...").alias("line")).distinct()
    lines_ = o.select(F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").alias("seq"), line.alias("line")).unionByName(head)
    return T.PARSERS["pipe"](lines_).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("deposit").cast("double").alias("paid"), F.min("txn_date").alias("first_day"))


# Nested values


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || '}' AS json FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"))).alias("json"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'b.PDF' WHEN 1 THEN 'c.xlsx' ELSE 'a.txt' END AS best FROM supplier")
def best_attachment(spark, sf):
    r = F.col("s_suppkey") % 3
    f = lambda n, kind: F.struct(F.lit(n).alias("filename"), F.lit(kind).alias("content_type"))
    text, sheet, pdf = f("a.txt", "text/plain"), f("c.xlsx", S.SHEET_TYPES[1]), f("b.PDF", "application/pdf")
    named = f("d.pdf", "application/octet-stream")  # the type decides, not the name
    files = F.when(r == 0, F.array(text, sheet, named, pdf)).when(r == 1, F.array(text, named, sheet)).otherwise(F.array(text, named))
    return table(spark, sf, "supplier").select("s_suppkey", S.best_attachment(files)["filename"].alias("best"))


@query("SELECT s_suppkey, 'me@x.org,s' || s_suppkey || '@x.org' AS emails, TRUE AS has_it FROM supplier")
def email_list_edit(spark, sf):
    from tallybook.functions.predicates import member

    own = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("@x.org"))
    out = S.promote_email(S.normalize_emails(F.array(own, F.lower(own), F.lit(" ME@x.org"), F.lit(""))), "Me@x.org")
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(out, ",").alias("emails"), member(out, "ME@X.org").alias("has_it"))


@query("SELECT n_nationkey, map_size AS n, n_name AS col_1 FROM (SELECT n_nationkey, n_name, 3 AS map_size FROM nation)")
def cells_to_map(spark, sf):
    cells = T.padded_cells(F.array(F.col("n_nationkey").cast("string"), F.col("n_name")), 3)
    return table(spark, sf, "nation").select("n_nationkey", F.size(T.cells_to_map(cells)).alias("n"), T.cells_to_map(cells)["col_1"].alias("col_1"))


# Ingestion


@query("SELECT DISTINCT user_id, event_type, CAST(year(ts) - CASE WHEN month(ts) < 4 THEN 1 ELSE 0 END AS INTEGER) AS fy_start FROM events")
def stream_idempotent_ingest(spark, sf):
    from tallybook.streaming.ingest import ingest

    root = os.path.join(scratch_root(spark), f"tallybook-ingest-{uuid.uuid4().hex}")
    events = table(spark, sf, "events")
    events.repartition(6, "event_id").write.parquet(f"{root}/source")  # six deliveries, two in each batch
    out = ingest(spark, f"{root}/source", events.schema, f"{root}/target", f"{root}/checkpoint", ["user_id", "event_type"], "ts", files_per_batch=2)
    return out.select("user_id", "event_type", F.substring("fy", 1, 4).cast("int").alias("fy_start"))
