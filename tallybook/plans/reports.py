"""Queries of filters, joins, aggregates, ordering, sets, changes and the report compositions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.functions import predicates as P
from tallybook.operators import mutations as M
from tallybook.operators import relational as R
from tallybook.plans.fixtures import ACCOUNTS, ENTRIES, accounts, entries
from tallybook.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def register(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = sql
        return function

    return register


# Filters


@query(f"WITH {ENTRIES} SELECT id, status, priority FROM entries WHERE priority IN ('1-URGENT', '2-HIGH') AND status = 'O'")
def optional_filters(spark, sf):
    return P.optional_filters(entries(spark, sf), {"priority": ["1-URGENT", "2-HIGH"], "status": "O", "account_id": None, "fy": ""}).select("id", "status", "priority")


@query("SELECT o_orderkey AS id FROM orders WHERE 1 = 0")
def empty_in_list(spark, sf):
    return table(spark, sf, "orders").where(P.in_list(F.col("o_orderstatus"), [])).select(F.col("o_orderkey").alias("id"))


@query(f"WITH {ENTRIES} SELECT id, status FROM entries WHERE status IS NULL OR status NOT IN ('Hold', 'F')")
def exclude_keeps_nulls(spark, sf):
    return entries(spark, sf).where(P.excluding(F.col("status"), "Hold", "F")).select("id", "status")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_brand), 'al') OR contains(lower(p_type), 'al')")
def icontains_or_search(spark, sf):
    return P.search(table(spark, sf, "part"), " AL ", ["p_name", "p_brand", "p_type", "no_such_column"]).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building' AND ends_with(lower(c_name), '7')")
def iexact_and_suffix(spark, sf):
    c = table(spark, sf, "customer")
    return c.where(P.iexact(F.col("c_mktsegment"), "Building") & P.iendswith(F.col("c_name"), "7")).select("c_custkey", "c_name")


@query(f"WITH {ENTRIES} SELECT id, CASE WHEN done_date IS NOT NULL THEN 'Done' WHEN status IS NULL OR status <> 'Hold' THEN 'Pending' ELSE 'Hold' END AS workflow FROM entries")
def status_predicate(spark, sf):
    e = entries(spark, sf)
    return e.select("id", F.when(P.done(F.col("done_date")), "Done").when(P.pending(F.col("done_date"), F.col("status")), "Pending").otherwise("Hold").alias("workflow"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def half_open_window(spark, sf):
    return table(spark, sf, "events").where(P.on_days(F.col("ts"), "2024-01-05", "2024-01-10")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10 23:59:59.999999'")
def closed_day_window(spark, sf):
    return table(spark, sf, "events").where(P.to_end_of_day(F.col("ts"), "2024-01-05", "2024-01-10")).select("event_id")


@query(f"WITH {ENTRIES} SELECT id, from_date >= DATE '1997-01-01' AND last_date <= DATE '1997-12-31' AS contained FROM entries WHERE from_date <= DATE '1997-12-31' AND last_date >= DATE '1997-01-01'")
def range_overlap_and_containment(spark, sf):
    a, b = F.col("from_date"), F.col("last_date")
    w = (F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return entries(spark, sf).where(P.overlapping(a, b, *w)).select("id", P.contained(a, b, *w).alias("contained"))


@query("SELECT p_partkey, p_size FROM part WHERE (p_size BETWEEN 5 AND 8) OR p_size >= 45 OR p_size = 20")
def numeric_mini_language(spark, sf):
    c = F.col("p_size")
    return table(spark, sf, "part").where(P.numeric_filter(c, "5-8") | P.numeric_filter(c, ">= 45") | P.numeric_filter(c, "20") | P.numeric_filter(c, "x")).select("p_partkey", "p_size")


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(concat_ws(' ', role, text)), 'the an') OR contains(regexp_replace(lower(concat_ws(' ', role, text)), '[^a-z0-9]+', '', 'g'), '555')")
def keyword_blacklist(spark, sf):
    return table(spark, sf, "conversations").where(P.blacklisted([F.col("role"), F.col("text")], ["The An"], ["555"])).select("conv_id", "turn")


@query("SELECT page_id FROM pages WHERE contains(lower(concat_ws(' ', regexp_replace(coalesce(url, ''), '<[^>]*>', '', 'g'), regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g'))), 'thing')")
def rendered_text_search(spark, sf):
    return P.row_text_matches(table(spark, sf, "pages"), "Thing", ["url", "html"]).select("page_id")


@query(f"WITH {ENTRIES} SELECT id FROM entries WHERE (status IS NULL) OR (priority = '5-LOW') OR (done_date IS NOT NULL AND amount > 200000)")
def multi_select_disjunction(spark, sf):
    flags = {"unknown": F.col("status").isNull(), "low": F.col("priority") == "5-LOW", "large": F.col("done_date").isNotNull() & (F.col("amount") > 200000), "off": F.col("amount") < 0}
    chosen = ["unknown", "low", "large"]
    return entries(spark, sf).where(P.any_of([F.coalesce(flags[c], F.lit(False)) for c in chosen])).select("id")


@query(f"WITH {ENTRIES} SELECT account_id, count(*) AS n FROM entries WHERE done_date IS NULL OR done_date >= DATE '1995-01-01' GROUP BY 1")
def active_on_day(spark, sf):
    return entries(spark, sf).where(P.active_on(F.col("done_date"), F.lit("1995-01-01").cast("date"))).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


# Projections


@query(f"""WITH {ENTRIES} SELECT id, coalesce(nullif(trim(status), ''), nullif(trim(priority), ''), '-') AS first_filled, strftime(from_date, '%d-%m-%Y') AS shown,
  coalesce(CASE WHEN account_id % 3 = 0 THEN CAST(account_id AS VARCHAR) END, CASE account_id % 3 WHEN 1 THEN 'Sales' WHEN 2 THEN 'Purchase' END, '-') AS account FROM entries""")
def display_columns(spark, sf):
    from tallybook.functions.scalars import first_filled, virtual_account

    e, a = entries(spark, sf), F.col("account_id")
    own = F.when(a % 3 == 0, a.cast("string"))
    return e.select("id", F.coalesce(first_filled(F.col("status"), F.col("priority")), F.lit("-")).alias("first_filled"), F.date_format("from_date", "dd-MM-yyyy").alias("shown"), virtual_account(own, (a % 3).cast("string")).alias("account"))


@query("SELECT c_custkey AS client_id, c_name AS client_name, CAST(NULL AS VARCHAR) AS pan FROM customer")
def rename_by_alias(spark, sf):
    c = table(spark, sf, "customer").withColumnsRenamed({"c_custkey": " Client Code ", "c_name": "NAME"})
    return R.renamed_by_alias(c, {"client_id": ["client code", "code"], "client_name": ["party", "name"], "pan": ["pan no"]})


@query(f"WITH {ACCOUNTS} SELECT account_id, format('{{:,.2f}}', abs(opening)) || CASE WHEN opening < 0 THEN ' Dr' ELSE ' Cr' END AS shown FROM accounts")
def drcr_format(spark, sf):
    from tallybook.functions.scalars import drcr

    return accounts(spark, sf).select("account_id", drcr(F.col("opening")).alias("shown"))


# Joins


@query("SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def select_related(spark, sf):
    o = R.related(table(spark, sf, "orders"), table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return R.related(o, table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT n_nationkey, coalesce(string_agg(CAST(s_suppkey AS VARCHAR) || ':' || s_name, ',' ORDER BY s_suppkey), '') AS children FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def prefetch_list(spark, sf):
    s = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    out = R.with_children(table(spark, sf, "nation"), s, "n_nationkey", ["s_suppkey", "s_name"], "suppliers")
    return out.select("n_nationkey", F.array_join(F.transform("suppliers", lambda x: F.concat(x["s_suppkey"].cast("string"), F.lit(":"), x["s_name"])), ",").alias("children"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_ids(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01')")
def anti_join_no_entries(spark, sf):
    o = table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))
    return table(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query(f"""WITH {ENTRIES}, k AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE account_id % 10 END AS a, status FROM entries), n AS (SELECT a, status, count(*) AS n FROM k WHERE id % 2 = 0 GROUP BY ALL)
SELECT k.id, coalesce(n.n, 0) AS n FROM k LEFT JOIN n ON n.a IS NOT DISTINCT FROM k.a AND n.status IS NOT DISTINCT FROM k.status""")
def null_safe_join(spark, sf):
    k = entries(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.col("account_id") % 10).alias("a"), "status")
    n = k.where("id % 2 = 0").groupBy("a", "status").agg(F.count(F.lit(1)).alias("n"))
    return R.null_safe_join(k, n, ["a", "status"]).select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT n.n_nationkey, r.r_name AS parent, s.n AS suppliers FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey")
def self_parent_join(spark, sf):
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    n = R.related(table(spark, sf, "nation"), table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return R.related(n, s, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", F.col("r_name").alias("parent"), F.col("n").alias("suppliers"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def existence_check(spark, sf):
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("hit", F.lit(True))
    return R.related(table(spark, sf, "orders"), r, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("returned"))


# Aggregates


@query(f"WITH {ENTRIES} SELECT status, priority, count(id) AS n FROM entries GROUP BY ALL")
def group_count(spark, sf):
    return entries(spark, sf).groupBy("status", "priority").agg(F.count("id").alias("n"))


@query(f"WITH {ENTRIES}, {ACCOUNTS} SELECT a.account_id, count(CASE WHEN e.status = 'O' THEN e.id END) AS open_n, count(CASE WHEN e.done_date IS NOT NULL THEN e.id END) AS done_n FROM accounts a LEFT JOIN entries e USING (account_id) GROUP BY 1")
def conditional_count_left(spark, sf):
    out = R.conditional_counts(accounts(spark, sf).select("account_id"), entries(spark, sf), "account_id", {"open_n": F.col("status") == "O", "done_n": F.col("done_date").isNotNull()}, "id")
    return out


FUNNEL = {"total": "id IS NOT NULL", "received": "done_date IS NOT NULL", "held": "status = 'Hold'", "urgent": "priority = '1-URGENT'", "large": "amount > 150000", "unknown": "status IS NULL"}


@query(f"WITH {ENTRIES}, {ACCOUNTS} SELECT group_id, " + ", ".join(f"count(DISTINCT CASE WHEN {p} THEN account_id END) AS {n}" for n, p in FUNNEL.items()) + " FROM entries JOIN accounts USING (account_id) GROUP BY 1")
def stage_funnel(spark, sf):
    rows = entries(spark, sf).join(accounts(spark, sf).select("account_id", "group_id"), "account_id")
    return R.stage_funnel(rows, "group_id", "account_id", {n: F.expr(p) for n, p in FUNNEL.items()})


@query(f"WITH {ENTRIES}, {ACCOUNTS} SELECT group_id, count(DISTINCT account_id) AS clients, count(*) AS n FROM entries JOIN accounts USING (account_id) GROUP BY 1")
def two_level_rollup(spark, sf):
    per = entries(spark, sf).groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).join(accounts(spark, sf).select("account_id", "group_id"), "account_id")
    return per.groupBy("group_id").agg(F.count(F.lit(1)).alias("clients"), F.sum("n").alias("n"))


@query(f"WITH {ENTRIES}, c AS (SELECT priority, count(*) AS n, count(done_date) AS done FROM entries GROUP BY 1) SELECT priority, n, done FROM c UNION ALL SELECT 'Total', sum(n)::BIGINT, sum(done)::BIGINT FROM c")
def grand_total(spark, sf):
    c = entries(spark, sf).groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.count("done_date").alias("done"))
    return R.with_grand_total(c, "priority", ["n", "done"])


@query("SELECT c_mktsegment, max(CAST(c_custkey AS VARCHAR)) AS last_id FROM customer GROUP BY 1")
def lexicographic_max(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.max(F.col("c_custkey").cast("string")).alias("last_id"))


@query("SELECT c_name, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS rn FROM customer) WHERE rn = 1")
def distinct_by_first(spark, sf):
    return R.one_per_key(table(spark, sf, "customer"), ["c_mktsegment"], [F.col("c_name"), F.col("c_custkey")]).select("c_name", "c_mktsegment")


@query(f"WITH {ENTRIES} SELECT account_id, bool_or(status = 'Hold') AS any_hold, bool_and(done_date IS NOT NULL) AS all_done FROM entries GROUP BY 1")
def any_and_all(spark, sf):
    return entries(spark, sf).groupBy("account_id").agg(F.bool_or(F.col("status") == "Hold").alias("any_hold"), F.bool_and(F.col("done_date").isNotNull()).alias("all_done"))


@query(f"WITH {ENTRIES} SELECT account_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS n FROM entries GROUP BY 1")
def ordered_lists(spark, sf):
    return entries(spark, sf).groupBy("account_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


# Order, windows


@query(f"WITH {ENTRIES} SELECT id, revision FROM (SELECT id, CASE WHEN priority = '1-URGENT' THEN row_number() OVER (PARTITION BY account_id, priority = '1-URGENT' ORDER BY amount NULLS LAST, id) END AS revision FROM entries)")
def revision_number(spark, sf):
    from tallybook.operators.ledger import revision_numbers

    return revision_numbers(entries(spark, sf), ["account_id"], [F.asc_nulls_last("amount"), F.col("id")], F.col("priority") == "1-URGENT").select("id", "revision")


@query(f"WITH {ENTRIES} SELECT fy, id FROM (SELECT fy, id, row_number() OVER (PARTITION BY fy ORDER BY from_date DESC, id) AS rn FROM entries) WHERE rn <= 50")
def top_n_per_shard(spark, sf):
    return R.top_n_per(entries(spark, sf), ["fy"], [F.desc("from_date"), F.col("id")], 50).select("fy", "id")


@query(f"WITH {ENTRIES} SELECT account_id, count(*) AS n FROM entries GROUP BY 1 ORDER BY n DESC, account_id LIMIT 20")
def top_k_count(spark, sf):
    return entries(spark, sf).groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "account_id").limit(20)


@query("SELECT DISTINCT c_mktsegment AS label, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS place FROM customer")
def custom_label_order(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label")).distinct()
    return d.withColumn("place", R.label_rank(F.col("label"), ["MACHINERY", "BUILDING"])).orderBy("place", "label")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 300")
def newest_capped(spark, sf):
    return R.first_existing_order(table(spark, sf, "events").select("event_id", "ts"), ["rec_dat", "ts"], ties=["event_id"]).limit(300)


# Sets


@query("SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier")
def append_shards(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")))


@query("""SELECT 'both' AS side, x FROM (SELECT c_nationkey AS x FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
UNION ALL SELECT 'left', x FROM (SELECT c_nationkey AS x FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set_intersection_difference(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("x")).distinct()
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("x")).distinct()
    both = a.join(b, "x", "left_semi").select(F.lit("both").alias("side"), "x")
    return both.unionByName(a.join(b, "x", "left_anti").select(F.lit("left").alias("side"), "x"))


# Changes

OLD = "old AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount FROM orders WHERE o_orderkey % 4 <> 0)"
NEW = "new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS amount FROM orders WHERE o_orderkey % 3 <> 1)"
ACTIONS = "acts AS (SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.status ELSE n.status END AS status, coalesce(n.amount, o.amount) AS amount, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted' WHEN n.status IS DISTINCT FROM o.status OR n.amount IS DISTINCT FROM o.amount THEN 'updated' ELSE 'existing' END AS action FROM old o FULL JOIN new n ON n.id = o.id)"


def _old_new(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    old = o.where(k % 4 != 0).select(k.alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    new = o.where(k % 3 != 1).select(k.alias("id"), F.when(k % 6 != 0, F.col("o_orderstatus")).alias("status"), (F.col("o_totalprice") + F.when(k % 5 == 0, 1.0).otherwise(0.0)).alias("amount"))
    return old, new


@query(f"WITH {OLD}, {NEW}, {ACTIONS} SELECT action, count(*) AS n FROM acts WHERE action <> 'kept' GROUP BY 1")
def upsert_actions(spark, sf):
    return M.action_counts(*_old_new(spark, sf), ["id"])


@query(f"WITH {OLD}, {NEW}, {ACTIONS} SELECT id, status, amount FROM acts")
def upsert(spark, sf):
    return M.upsert(*_old_new(spark, sf), ["id"])


@query(f"WITH {OLD}, {NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_if_absent(spark, sf):
    old, new = _old_new(spark, sf)
    return M.insert_if_absent(old, new.unionByName(new), ["id"], [F.col("amount")])


@query(f"WITH {ENTRIES} SELECT id, CASE WHEN priority = '5-LOW' AND status = 'O' THEN 'Filed' ELSE status END AS status, CASE WHEN priority = '5-LOW' AND status = 'O' THEN last_date ELSE done_date END AS done_date FROM entries")
def bulk_update(spark, sf):
    hit = (F.col("priority") == "5-LOW") & (F.col("status") == "O")
    return M.updated_where(entries(spark, sf), hit, {"done_date": F.col("last_date"), "status": F.lit("Filed")} | {}).select("id", "status", "done_date")


@query(f"WITH {ENTRIES} SELECT id FROM entries WHERE NOT coalesce(status = 'F', FALSE)")
def predicate_delete(spark, sf):
    return M.deleted_where(entries(spark, sf), F.col("status") == "F").select("id")


@query("""WITH g AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM g))
SELECT 'nation' AS level, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT * FROM g) UNION ALL
SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT * FROM c) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM c)""")
def cascade_delete(spark, sf):
    n, c, o = (table(spark, sf, t) for t in ("nation", "customer", "orders"))
    doomed = n.where("n_regionkey = 1").select("n_nationkey")
    left = M.cascade_delete([(n, None, "n_nationkey"), (c, "c_nationkey", "c_custkey"), (o, "o_custkey", "o_orderkey")], doomed)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n")
    return count(left[0], "nation").unionByName(count(left[1], "customer")).unionByName(count(left[2], "orders"))


@query(f"""WITH {ENTRIES}, i AS (SELECT DISTINCT account_id, priority, fy FROM entries)
SELECT account_id, priority, '1997_98' AS fy FROM i a WHERE fy = '1996_97' AND NOT EXISTS (SELECT 1 FROM i b WHERE b.fy = '1997_98' AND b.account_id = a.account_id AND b.priority = a.priority)""")
def carry_forward(spark, sf):
    items = entries(spark, sf).select("account_id", "priority", "fy")
    return M.carried_forward(items, "1996_97", "1997_98", ["account_id", "priority"])


@query(f"""WITH {ENTRIES} SELECT id, 'dates' AS rule FROM entries WHERE NOT (from_date < last_date) UNION ALL SELECT id, 'status' FROM entries WHERE NOT coalesce(status IN ('O', 'F'), FALSE)""")
def violations(spark, sf):
    return M.violations(entries(spark, sf), "id", {"dates": F.col("from_date") < F.col("last_date"), "status": F.col("status").isin("O", "F")})


@query("SELECT c_name, count(*) AS n FROM (SELECT c_nationkey AS c_name FROM customer) GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, sf):
    return M.duplicate_keys(table(spark, sf, "customer").select(F.col("c_nationkey").alias("c_name")), ["c_name"])


# Report compositions


@query(f"""WITH {ENTRIES}, {ACCOUNTS} SELECT a.group_id, a.name, e.fy, count(*) AS total, count(CASE WHEN status IS NULL OR status NOT IN ('Hold') THEN id END) AS counted, count(done_date) AS received
FROM entries e JOIN accounts a USING (account_id) GROUP BY ALL""")
def report_hardcopy_counts(spark, sf):
    e = entries(spark, sf).groupBy("account_id", "fy").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(P.excluding(F.col("status"), "Hold"), F.col("id"))).alias("counted"), F.count("done_date").alias("received"))
    return e.join(accounts(spark, sf), "account_id").groupBy("group_id", "name", "fy").agg(*(F.sum(c).alias(c) for c in ("total", "counted", "received")))


@query(f"""WITH {ENTRIES}, {ACCOUNTS} SELECT name, id, fy, coalesce(status, 'Unknown') AS status, coalesce(CAST(done_date AS VARCHAR), '-') AS done
FROM entries JOIN accounts USING (account_id) WHERE fy = '1996_97' AND done_date IS NULL""")
def report_pending_checklist(spark, sf):
    e = entries(spark, sf, ["1996_97"]).where(F.col("done_date").isNull())
    return e.join(accounts(spark, sf), "account_id").select("name", "id", "fy", F.coalesce("status", F.lit("Unknown")).alias("status"), F.coalesce(F.col("done_date").cast("string"), F.lit("-")).alias("done"))


@query(f"""WITH {ENTRIES}, {ACCOUNTS}, c AS (SELECT group_id, count(*) AS clients FROM accounts WHERE segment = 'BUILDING' GROUP BY 1)
SELECT n_name, coalesce(clients, 0) AS clients FROM nation LEFT JOIN c ON c.group_id = n_nationkey""")
def report_group_counts(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("group_id"))
    return R.conditional_counts(n, accounts(spark, sf), "group_id", {"clients": F.col("segment") == "BUILDING"}, "account_id").select("n_name", "clients")


@query(f"""WITH {ENTRIES} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN c_custkey IS NULL THEN 'missing' WHEN amount IS NULL OR amount < 1000 THEN 'invalid' ELSE 'updated' END AS outcome
FROM entries LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = account_id) GROUP BY 1""")
def report_upload_outcomes(spark, sf):
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey")
    j = entries(spark, sf).join(c, F.col("account_id") == F.col("c_custkey"), "left")
    outcome = F.when(F.col("c_custkey").isNull(), "missing").when(F.col("amount").isNull() | (F.col("amount") < 1000), "invalid").otherwise("updated")
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENTRIES} SELECT o.id, o.priority, o.n FROM (SELECT id, priority, count(*) OVER (PARTITION BY account_id) AS n FROM entries) o WHERE o.n > 15""")
def report_busy_accounts(spark, sf):
    return entries(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("account_id"))).where("n > 15").select("id", "priority", "n")
