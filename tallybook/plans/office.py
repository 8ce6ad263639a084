"""Queries of the office's flows and of the narration, mail and sheet functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.functions import predicates as P
from tallybook.functions import scalars as S
from tallybook.functions.fiscal import fy_of
from tallybook.operators import layouts as L
from tallybook.operators import linkage as K
from tallybook.operators import office as O
from tallybook.plans.fixtures import ACCOUNTS, DENSE, ENTRIES, HIGH, LOW, accounts, clamped_sql, day, dense, entries, gaps_sql, islands_sql
from tallybook.plans.ledgers import ACCTS, accts, number_of
from tallybook.plans.statements import TX, transactions
from tallybook.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


MAIL = """mails AS (SELECT o_orderkey AS mail_id, o_orderkey % 4 AS kind, 'c' || o_custkey % 900 || '@x.org' AS email, o_orderkey % 10 <> 0 AS known, lpad(CAST(100000000 + (o_custkey * 3) * 7919 AS VARCHAR), 11, '9') AS num, CAST(o_orderdate AS DATE) AS received,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'm' || o_orderkey // 2 || '@x' ELSE 'maillog-' || o_orderkey END AS msg_id FROM orders),
found AS (SELECT m.*, c_custkey AS client_id FROM mails m JOIN customer ON 'c' || c_custkey % 900 || '@x.org' = email WHERE known),
hits AS (SELECT f.mail_id, f.client_id, f.received, f.msg_id, f.kind, min(CASE WHEN kind = 0 AND number = num THEN account_id END) AS full_hit,
  CASE WHEN count(CASE WHEN right(number, 4) = right(num, 4) THEN 1 END) = 1 AND kind = 1 THEN min(CASE WHEN right(number, 4) = right(num, 4) THEN account_id END) END AS tail_hit,
  CASE WHEN count(*) = 1 THEN min(account_id) END AS sole FROM found f JOIN accts a ON a.client_id = f.client_id GROUP BY f.mail_id, f.client_id, f.received, f.msg_id, f.kind),
chosen AS (SELECT *, coalesce(full_hit, tail_hit) AS hit FROM hits QUALIFY row_number() OVER (PARTITION BY mail_id ORDER BY coalesce(full_hit, tail_hit) IS NULL, client_id) = 1),
entry AS (SELECT mail_id, msg_id, CAST(year(received) - CASE WHEN month(received) < 4 THEN 1 ELSE 0 END AS INTEGER) AS y, client_id, coalesce(hit, sole) AS account_id, received,
  CASE WHEN kind = 2 THEN received - 40 ELSE CAST(date_trunc('month', received) - INTERVAL 1 MONTH AS DATE) END AS start, CASE WHEN kind = 2 THEN received - 10 ELSE CAST(date_trunc('month', received) AS DATE) - 1 END AS "end" FROM chosen)"""


@query(f"""WITH {ACCTS}, {MAIL} SELECT mail_id, msg_id, y AS fy_start, client_id, account_id, start, "end" FROM entry
WHERE NOT (msg_id LIKE 'm%7@x') QUALIFY row_number() OVER (PARTITION BY y, msg_id ORDER BY received, mail_id) = 1""")
def mail_to_entries(spark, sf):
    """Mails of orders, clients that share addresses, numbers in full or masked; ids that end in 7 are there already."""
    o = table(spark, sf, "orders")
    k, number = F.col("o_orderkey"), number_of(F.col("o_custkey") * 3)
    when = F.to_date("o_orderdate")
    shown = lambda d: F.date_format(d, "dd-MM-yyyy")
    subject = F.when(k % 4 == 0, F.concat(F.lit("Statement of "), number)).when(k % 4 == 2, F.concat(F.lit("Statement for period "), shown(F.date_sub(when, 40)), F.lit(" to "), shown(F.date_sub(when, 10)))).otherwise("Your statement")
    attached = F.when(k % 4 == 1, F.concat(F.lit("stmt XXXX"), F.right(number, F.lit(4)), F.lit(".pdf"))).otherwise("file.pdf")
    address = F.concat(F.lit(" C"), (F.col("o_custkey") % 900).cast("string"), F.lit("@X.org"))
    mails = o.select(
        k.alias("mail_id"), F.when(k % 3 != 0, F.concat(F.lit("<M"), F.expr("o_orderkey div 2").cast("string"), F.lit("@X>"))).alias("msg_id"), when.alias("received"),
        F.when(k % 10 != 0, F.array(F.lit("nobody@x.org"), address)).otherwise(F.array(F.lit("nobody@x.org"))).alias("recipients"), subject.alias("subject"), attached.alias("attached"),
    )
    emails = K.candidate_clients([(table(spark, sf, "customer").select(F.concat(F.lit("c"), (F.col("c_custkey") % 900).cast("string"), F.lit("@x.org")).alias("e"), F.col("c_custkey").alias("id")), "e", "id")])
    found = O.mail_entries(mails, emails, accts(spark, sf).withColumns({"mail_id": F.lit(""), "bank": F.col("bank_word")}))
    have = mails.select(fy_of(F.col("received")).alias("fy"), S.message_id(F.col("msg_id")).alias("msg_id")).where("msg_id like 'm%7@x'")
    return O.new_entries(found, have).select("mail_id", "msg_id", F.substring("fy", 1, 4).cast("int").alias("fy_start"), "client_id", "account_id", "start", "end")


K2 = "group_id, priority"


@query(f"""WITH {ENTRIES}, {ACCOUNTS}, {DENSE}, {clamped_sql('dense', K2)}, {islands_sql('clamped', K2)}, universe AS (SELECT DISTINCT {K2} FROM dense), {gaps_sql('islands', 'universe', K2)},
cut AS (SELECT {K2}, gap_start, gap_end, unnest(generate_series(date_trunc('month', gap_start), date_trunc('month', gap_end), INTERVAL 1 MONTH))::DATE AS m FROM gaps),
parts AS (SELECT {K2}, m, greatest(gap_start, m) AS s, least(gap_end, last_day(m)) AS e FROM cut),
here AS (SELECT * FROM dense WHERE from_date <= DATE '{HIGH}' AND last_date >= DATE '{LOW}'),
begun AS (SELECT DISTINCT {K2}, CAST(date_trunc('month', from_date) AS DATE) AS m FROM here),
partial AS (SELECT p.* FROM parts p JOIN begun USING (group_id, priority, m)),
grid AS (SELECT u.*, unnest(generate_series(DATE '{LOW}', DATE '{HIGH}', INTERVAL 1 MONTH))::DATE AS m FROM universe u),
state AS (SELECT g.*, EXISTS (SELECT 1 FROM parts p WHERE p.group_id = g.group_id AND p.priority = g.priority AND p.m = g.m) AS lacks, EXISTS (SELECT 1 FROM partial p WHERE p.group_id = g.group_id AND p.priority = g.priority AND p.m = g.m) AS aside FROM grid g),
runs AS (SELECT *, sum(CASE WHEN lacks THEN 0 ELSE 1 END) OVER (PARTITION BY {K2} ORDER BY m ROWS UNBOUNDED PRECEDING) AS r FROM state)
SELECT DISTINCT {K2}, 'received' AS kind, from_date AS start, last_date AS "end" FROM here UNION ALL SELECT {K2}, 'partial', s, e FROM partial
UNION ALL SELECT {K2}, 'block', min(m), last_day(max(m)) FROM runs WHERE lacks AND NOT aside GROUP BY {K2}, r""")
def report_coverage_rows(spark, sf):
    d = dense(spark, sf)
    return O.coverage_rows(d, d, ["group_id", "priority"], day(LOW), day(HIGH))


LEDGER = """ledger AS (SELECT c_custkey % 300 AS client_id, f AS file, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS code, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'SB ' || (c_custkey // 3 + 1000000) END AS number, c_name AS name FROM customer, range(2) r(f)),
acc AS (SELECT o_custkey % 300 AS client_id, CAST(o_custkey // 3 + 1000000 AS VARCHAR) AS digits, CASE o_orderkey % 4 WHEN 0 THEN 'Bank Accounts' WHEN 1 THEN 'Do Not Display' ELSE 'Loans' END AS g, CASE WHEN o_orderkey % 9 = 0 THEN CAST(o_custkey AS VARCHAR) END AS code FROM orders WHERE o_orderkey % 5 = 1)"""


def _ledger(spark, sf):
    k = F.col("c_custkey")
    ledger = table(spark, sf, "customer").select((k % 300).alias("client_id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("file"), F.when(k % 7 != 0, k.cast("string")).otherwise("").alias("code"), F.when(k % 11 != 0, F.concat(F.lit("SB "), F.expr("c_custkey div 3 + 1000000").cast("string"))).alias("number"), F.col("c_name").alias("name"))
    o = F.col("o_orderkey")
    group = F.when(o % 4 == 0, "Bank Accounts").when(o % 4 == 1, "Do Not Display").otherwise("Loans")
    held = table(spark, sf, "orders").where(o % 5 == 1).select((F.col("o_custkey") % 300).alias("client_id"), F.concat(F.lit("A/c-"), F.expr("o_custkey div 3 + 1000000").cast("string")).alias("account_no"), F.when(o % 9 == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("code"), group.alias("account_group"))
    return ledger, held


@query(f"""WITH {LEDGER}, l AS (SELECT client_id, regexp_replace(number, '[^0-9]', '', 'g') AS number, file, code, name FROM ledger WHERE number IS NOT NULL),
k AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.client_id = l.client_id AND g IN ('Bank Accounts', 'Do Not Display') AND digits = l.number) AND NOT EXISTS (SELECT 1 FROM acc WHERE acc.client_id = l.client_id AND acc.code = l.code AND l.code <> ''))
SELECT client_id, number, file, code, name FROM k QUALIFY row_number() OVER (PARTITION BY client_id, number ORDER BY file, code) = 1""")
def report_pending_rebuild(spark, sf):
    ledger, held = _ledger(spark, sf)
    return O.pending_ledger_accounts(ledger, held, ["Do Not Display", "Secured Loans"], ["Bank Accounts", "Bank O/D Account"])


@query(f"WITH {LEDGER} SELECT client_id, file, name FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.client_id = l.client_id AND g = 'Do Not Display' AND digits = regexp_replace(l.number, '[^0-9]', '', 'g'))")
def hidden_pairs(spark, sf):
    ledger, held = _ledger(spark, sf)
    return O.without_hidden(ledger, held, ["Do Not Display", "Secured Loans"]).select("client_id", "file", "name")


@query("SELECT c_name AS client, s_name AS bank, s_suppkey AS account_id FROM supplier JOIN customer ON c_custkey = s_suppkey % 50 + 1 WHERE s_suppkey % 3 <> 1 AND s_suppkey % 2 = 0")
def report_unmapped(spark, sf):
    """Bank accounts (the group in any case) without a ledger code, by client and bank."""
    k = F.col("s_suppkey")
    a = table(spark, sf, "supplier").select(k.alias("account_id"), (k % 50 + 1).alias("c_custkey"), F.col("s_name").alias("bank"), F.when(k % 3 == 1, "77").when(k % 3 == 2, "").alias("code"), F.when(k % 2 == 0, "BANK accounts").otherwise("Loans").alias("account_group"))
    bare = a.where((F.col("code").isNull() | (F.col("code") == "")) & P.iexact(F.col("account_group"), "Bank Accounts"))
    return bare.join(table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("client")), "c_custkey").select("client", "bank", "account_id").orderBy("client", "bank")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 5 END AS tier FROM customer")
def account_finder_tiers(spark, sf):
    """A suffix is contained as well, so the tier of suffixes is never the first one that holds."""
    k = F.col("c_custkey")
    number = F.concat(F.lit("AB-"), (k + 5000000).cast("string"), F.lit("-x9"))
    typed = F.when(k % 5 == 0, number).when(k % 5 == 1, F.lower(number)).when(k % 5 == 2, F.concat(F.lit("b-"), (k + 5000000).cast("string"))).when(k % 5 == 3, F.concat((k + 5000000).cast("string"), F.lit("-X9"))).otherwise(F.concat((k + 5000000).cast("string"), F.lit("/9")))
    c = table(spark, sf, "customer")
    wanted = c.select(k.alias("key"), k.alias("client_id"), typed.alias("typed"))
    held = c.select(k.alias("client_id"), k.alias("account_id"), number.alias("account_no"))
    return K.found_account(wanted, held).select(F.col("key").alias("c_custkey"), "tier")


@query(f"""WITH {ACCTS}, m AS (SELECT c_custkey AS message_id, c_custkey AS client_id, c_custkey % 5 AS kind FROM customer), n AS (SELECT client_id, count(*) AS n, min(account_id) AS least, max(CASE WHEN bank = 'BETA' THEN account_id END) AS beta, max(CASE WHEN bank = 'GAMMA' THEN account_id END) AS gamma, max(CASE WHEN bank = 'ALPHA' THEN account_id END) AS alpha FROM accts GROUP BY 1)
SELECT message_id, CASE WHEN kind = 0 AND n > 1 THEN beta WHEN n = 1 THEN least WHEN kind = 1 THEN gamma WHEN kind = 2 THEN alpha END AS account_id, CASE WHEN kind = 0 AND n > 1 THEN 1 WHEN n = 1 THEN 2 WHEN kind = 1 THEN 3 ELSE 4 END AS tier FROM m JOIN n USING (client_id) WHERE n = 1 OR kind < 3""")
def fallback_pick(spark, sf):
    """By mail id, only account, named bank, unique tail: one of them for each kind of client, none for the rest."""
    a = accts(spark, sf)
    bank = F.when(F.col("bank_word") == "alpha", "HDFC Bank").when(F.col("bank_word") == "beta", "AXIS").otherwise("SBI Main")
    a = a.select("account_id", "client_id", F.when(F.col("bank_word") == "beta", F.concat(F.lit("Acc"), F.col("client_id").cast("string"), F.lit("@b.org"))).alias("mail_id"), bank.alias("bank"), "account_no")
    k = F.col("c_custkey")
    mail = F.when(k % 5 == 0, F.concat(F.lit("acc"), k.cast("string"), F.lit("@b.org"))).otherwise("x@y.org")
    tail = F.when(k % 5 == 2, F.array(F.right(number_of(k * 3), F.lit(4)))).otherwise(F.array().cast("array<string>"))
    m = table(spark, sf, "customer").select(k.alias("message_id"), k.alias("client_id"), F.array(F.lit("n@n.org"), mail).alias("recipients"), F.when(k % 5 == 1, "from State Bank").otherwise("hello").alias("hint"), tail.alias("tails"))
    return K.fallback_accounts(m, a)


@query(f"WITH {ACCTS} SELECT c_custkey AS message_id, account_id, 2 AS score FROM customer JOIN accts ON client_id = c_custkey AND (bank = 'BETA' OR client_id % 4 = 0)")
def scored_match_ties(spark, sf):
    """Tails of all of a client's accounts are in the mail; the attachment's recipient settles it where there are several."""
    a = accts(spark, sf)
    a = a.select("account_id", "client_id", "account_no", F.when(F.col("bank_word") == "beta", F.concat(F.lit("B"), F.col("client_id").cast("string"))).alias("mail_id"), F.col("bank_word").alias("bank"))
    k = F.col("c_custkey")
    tails = F.array(*(F.right(number_of(k * 3 + i), F.lit(4)) for i in range(3)))
    m = table(spark, sf, "customer").select(k.alias("message_id"), k.alias("client_id"), tails.alias("tokens"), F.array(F.concat(F.lit("b"), k.cast("string"))).alias("recipients"), F.array(F.lit("z")).alias("receivers"))
    return K.scored_owned_accounts(m, a)


@query("SELECT c_custkey AS message_id, c_custkey * 3 + CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS account_id, 2 AS score FROM customer")
def scored_tie_breakers(spark, sf):
    """Three accounts of a client end alike; a recipient, a receiver, the bank's name, the number or the account settles it, by the kind of client."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    a = c.select(k.alias("client_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    of = lambda kind, *values: F.when(F.col("client_id") % 5 == kind, F.element_at(F.array(*map(F.lit, values)), F.col("j") + 1))
    tail = F.lpad((F.col("client_id") % 10000).cast("string"), 4, "0")
    mail = F.concat(F.lit(" Mail"), F.col("j").cast("string"), F.lit("@"), F.col("client_id").cast("string"))
    a = a.select("client_id", (F.col("client_id") * 3 + F.col("j")).alias("account_id"), F.concat(F.coalesce(of(3, "9-", "5-", "7-"), of(4, "1", "1", "1"), F.lit("44")), tail).alias("account_no"), mail.alias("mail_id"), F.coalesce(of(2, "A", "C", "B"), F.lit("ONE")).alias("bank"))
    to = lambda j: F.concat(F.lit(f"mail{j}@"), k.cast("string"))
    m = c.select(k.alias("message_id"), k.alias("client_id"), F.array(F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("x")).alias("tokens"), F.array(F.when(k % 5 == 0, to(0)).otherwise("q")).alias("recipients"), F.array(F.when(k % 5 < 2, to(1)).otherwise("q")).alias("receivers"))
    return K.scored_owned_accounts(m, a)


@query("SELECT c_custkey AS key, c_custkey * 3 + CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS account_id, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 5 END AS tier FROM customer")
def account_finder(spark, sf):
    """Which of a client's three accounts a typed number means: equal, equal but for case, a part of all three, a part of one, equal digits."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    middle = (k + 5000000).cast("string")
    held = c.select(k.alias("client_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"), middle.alias("middle"))
    held = held.select("client_id", (F.col("client_id") * 3 + F.col("j")).alias("account_id"), F.concat(F.lit("AB-"), "middle", F.lit("-x"), F.col("j").cast("string")).alias("account_no"))
    typed = F.when(k % 5 == 0, F.concat(F.lit(" AB-"), middle, F.lit("-x1 "))).when(k % 5 == 1, F.concat(F.lit("ab-"), middle, F.lit("-X2"))).when(k % 5 == 2, F.concat(F.lit("b-"), middle)).when(k % 5 == 3, F.concat(middle, F.lit("-X2"))).otherwise(F.concat(middle, F.lit("/1")))
    return K.found_account(c.select(k.alias("key"), k.alias("client_id"), typed.alias("typed")), held)


# Sheets


def _printed(spark, sf):
    t = transactions(spark, sf).withColumnsRenamed({"n": "seq", "d": "txn_date", "narr": "narration1", "ref": "narration2"})
    zero = F.lit(0).cast("decimal(18,2)")
    text = F.when(F.col("k") % 5 == 0, "ATM cash").when(F.col("k") % 5 == 1, "cash chrg").otherwise(F.col("narration1"))
    wrong = F.when(F.col("k") % 50 == 0, F.lit(7)).otherwise(F.lit(0))
    return t.withColumns({"withdrawal": F.when(F.col("dr"), F.col("amt")).otherwise(zero), "deposit": F.when(~F.col("dr"), F.col("amt")).otherwise(zero), "narration1": text, "balance": (F.col("bal") + wrong).cast("decimal(18,2)")})


SHEET = f"""{TX}, p AS (SELECT *, CASE k % 5 WHEN 0 THEN 'ATM cash' WHEN 1 THEN 'cash chrg' ELSE narr END AS n1, bal + CASE WHEN k % 50 = 0 THEN 700 ELSE 0 END AS b, CASE WHEN dr THEN amt ELSE 0 END AS w, CASE WHEN dr THEN 0 ELSE amt END AS i FROM tx)"""


@query(f"""WITH {SHEET} SELECT file, n AS seq, strftime(d, '%d-%m-%Y') AS "Date", n1 AS "Narration1", ref AS "Narration2", w AS "Withdrawals", i AS "Deposits", b AS "Balance",
coalesce(lag(b) OVER (PARTITION BY file ORDER BY n) + i - w <> b, FALSE) AS mismatch FROM p""")
def bank_sheet(spark, sf):
    out = O.bank_sheet(_printed(spark, sf))
    return out.withColumns({c: F.round(F.col(c) * 100).cast("long") for c in ("Withdrawals", "Deposits", "Balance")})


@query(f"""WITH {SHEET}, v AS (SELECT *, row_number() OVER (PARTITION BY file % 100, strftime(d, '%b') ORDER BY file, n) AS rn FROM p)
SELECT file, n AS seq, 'Main' AS "Type", 'BANK' || lpad(CAST(file % 100 AS VARCHAR), 2, '0') || '-' || strftime(d, '%b') || '-' || CASE WHEN rn < 10000 THEN lpad(CAST(rn AS VARCHAR), 4, '0') ELSE CAST(rn AS VARCHAR) END AS "Sr",
CASE WHEN file % 2 = 0 THEN 'Ledger ' || file ELSE 'BANK' END AS "Bank", strftime(d, '%d-%m-%Y') AS "Date", '*Unknown*' AS "Account", n1 AS "Narration1", ref AS "Narration2", CASE WHEN n1 <> 'ATM cash' THEN w END AS "Withdrawals", CASE WHEN n1 <> 'ATM cash' THEN i END AS "Deposits",
CASE WHEN n1 = 'ATM cash' THEN w END AS "CashWithdrawals", CASE WHEN n1 = 'ATM cash' THEN i END AS "CashDeposits", b AS "Balance" FROM v""")
def ledger_sheet_columns(spark, sf):
    number = F.lpad(F.col("file").cast("string"), 6, "0")
    out = O.ledger_sheet(_printed(spark, sf), F.lit("BANK"), number, F.when(F.col("file") % 2 == 0, F.concat(F.lit("Ledger "), F.col("file").cast("string"))))
    return out.withColumns({c: F.round(F.col(c) * 100).cast("long") for c in ("Withdrawals", "Deposits", "CashWithdrawals", "CashDeposits", "Balance")})


@query("""SELECT CASE WHEN user_id % 7 < 6 THEN 'box' || user_id % 7 END AS mailbox, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS inserted, count(CASE WHEN event_type = 'click' THEN 1 END) AS updated, count(CASE WHEN event_type NOT IN ('purchase', 'click') THEN 1 END) AS existing FROM events GROUP BY 1
UNION ALL SELECT 'all', count(CASE WHEN event_type = 'purchase' THEN 1 END), count(CASE WHEN event_type = 'click' THEN 1 END), count(CASE WHEN event_type NOT IN ('purchase', 'click') THEN 1 END) FROM events""")
def mailbox_totals(spark, sf):
    outcome = F.when(F.col("event_type") == "purchase", "inserted").when(F.col("event_type") == "click", "updated").otherwise("existing")
    return O.mailbox_totals(table(spark, sf, "events").select(F.when(F.col("user_id") % 7 < 6, F.concat(F.lit("box"), (F.col("user_id") % 7).cast("string"))).alias("mailbox"), outcome.alias("outcome")))


@query(f"WITH {ENTRIES} SELECT account_id, id, coalesce(status, '') AS status, priority FROM entries QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY id) <= 3")
def sheet_preview(spark, sf):
    return O.preview(entries(spark, sf).select("account_id", "id", "status", "priority"), "account_id", "id", 3)


# Narrations, mails


@query("""SELECT o_orderkey AS k, 'PAID ' || o_orderkey || CASE WHEN o_orderkey % 3 = 2 THEN ' for goods' ELSE '' END AS first, CASE o_orderkey % 3 WHEN 0 THEN '12/34-' || o_orderkey WHEN 1 THEN 'Chq 9' ELSE '' END AS second,
CASE o_orderkey % 4 WHEN 0 THEN 'TO SELF - 304659' WHEN 1 THEN 'UPI/DR/77 shop' WHEN 2 THEN 'BY CASH' ELSE 'plain NEFT text' END AS own, 'text ' || o_orderkey AS clean,
CASE o_orderkey % 3 WHEN 0 THEN 1234.50 WHEN 1 THEN 12345.00 ELSE 77.00 END AS amount FROM orders""")
def narrations(spark, sf):
    k = F.col("o_orderkey")
    text = k.cast("string")
    tail = F.when(k % 3 == 0, F.concat(F.lit("12/34-"), text)).when(k % 3 == 1, "Chq  9").otherwise("for goods")
    packed = S.pack_narration(F.concat(F.lit(" PAID  "), text), tail)
    ran = F.when(k % 4 == 0, "TO SELF - 304659 NEFT_IN: x").when(k % 4 == 1, "UPI/DR/77 shop NEFT 12").when(k % 4 == 2, "BY CASH IMPS 1").otherwise("plain NEFT text")
    noisy = F.concat(F.lit("text "), text, F.lit("  https://x.org/a Registered  office: somewhere"))
    amounts = F.when(k % 3 == 0, "ref 123456789 of 5 is 99,000 and 1,234.50").when(k % 3 == 1, "id 1234567890 7 12,345").otherwise("UTR 998877665544 x 77")
    return table(spark, sf, "orders").select(k.alias("k"), packed["first"].alias("first"), packed["second"].alias("second"), S.own_narration(ran).alias("own"), S.without_footer(noisy).alias("clean"), S.rightmost_amount(amounts).cast("double").alias("amount"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) <= 400 THEN t WHEN contains(left(t, 381), ' ') THEN left(t, 380 - position(' ' IN reverse(left(t, 381))) + 1) ELSE left(t, 380) END AS first_part FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)""")
def long_narrations(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", S.split_long_narration(F.col("text"))["first"].alias("first_part"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'https://mail.google.com/mail/u/0/#search/rfc822msgid%3Aa%2Bb%40x' WHEN 1 THEN 'https://mail.yahoo.com/d/search/?q=Bank%20note%20me%40x.org' WHEN 2 THEN 'https://mail.google.com/mail/u/0/#search/Bank%20note%20me%40x.org' END AS link,
CASE s_suppkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS virtual, 'a.pdf x/a.pdf b.pdf y/b.pdf' AS files, DATE '2024-03-31' + CAST(s_suppkey % 2 AS INTEGER) AS local_day, CASE s_suppkey % 2 WHEN 0 THEN 'Gmail' ELSE 'Mail' END AS channel FROM supplier""")
def mail_details(spark, sf):
    k = F.col("s_suppkey")
    r = k % 4
    box = F.when(r == 1, "me@yahoo.com").otherwise("me@office.org")
    has = r.isin(1, 2)
    link = S.webmail_link(box, F.when(r == 0, "<a+b@x>").otherwise(""), F.when(has, "Bank note").otherwise(""), F.when(has, "me@x.org").otherwise(""))
    files = F.array(*(F.struct(F.lit(f).alias("filename"), F.lit(f"{d}/{f}").alias("path")) for f, d in (("a.pdf", "x"), ("b.pdf", "y"))))
    virtual = S.virtual_type(F.when(k % 3 == 0, " Sales A/c").when(k % 3 == 1, "PURCHASE").otherwise("1282.0"))
    stamp = F.when(k % 2 == 0, "2024-03-31 18:29:59").otherwise("2024-03-31 18:30:00").cast("timestamp")
    channel = S.channel_of(F.when(k % 2 == 0, "a@GMAIL.com").otherwise("a@b.org"), {"gmail": "Gmail"})
    return table(spark, sf, "supplier").select("s_suppkey", link.alias("link"), virtual.alias("virtual"), S.attachments_text(files).alias("files"), S.local_date(stamp).alias("local_day"), channel.alias("channel"))


@query(f"WITH {ENTRIES} SELECT id, CASE WHEN status IS NULL THEN 'Not Alloted' ELSE 'Alloted' END AS allotment FROM entries WHERE contains(lower(priority), 'h') AND contains(CAST(id AS VARCHAR), '7')")
def allotment_and_column_filters(spark, sf):
    e = entries(spark, sf).where(P.all_of([P.icontains(F.col("priority"), "H"), P.icontains(F.col("id").cast("string"), "7"), None]))
    return e.select("id", F.when(F.col("status").isNull(), "Not Alloted").otherwise("Alloted").alias("allotment"))


@query(f"WITH {TX} SELECT file, n, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN k % 9 = 0 THEN NULL ELSE d END NULLS LAST, n) AS place FROM tx")
def stable_date_order(spark, sf):
    """Lines by their parsed date, unreadable dates last, ties in printed order."""
    from pyspark.sql.window import Window

    shown = F.when(F.col("k") % 9 == 0, "n/a").otherwise(F.date_format("d", "dd/MM/yyyy"))
    w = Window.partitionBy("file").orderBy(F.asc_nulls_last(S.parse_date(shown)), "n")
    return transactions(spark, sf).select("file", "n", F.row_number().over(w).alias("place"))


@query(f"WITH {TX} SELECT file, n AS seq, 'Interest' AS word FROM tx WHERE k % 3 = 0 UNION ALL SELECT file, n, 'Dividend' FROM tx WHERE k % 3 = 1")
def keyword_rows(spark, sf):
    """Rows of three or more cells in which one of the words stands."""
    label = F.when(F.col("k") % 3 == 0, "Interest on deposit").when(F.col("k") % 3 == 1, "DIVIDEND").otherwise("Salary")
    rows = transactions(spark, sf).select("file", F.col("n").alias("seq"), F.array(F.lit("1"), label, F.lit("x")).alias("cells"))
    return L.keyword_rows(rows, ["Dividend", "Interest", "Sale of securities"])
