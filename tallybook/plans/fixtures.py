"""The domain's relations on the star-schema tables, and the same as SQL.

An entry is an order that covers o_orderkey % 45 days from its date on; an account is a customer, a group a nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.fiscal import fy_of, in_years
from tallybook.session import table

LOW, HIGH = "1997-04-01", "1998-03-31"


def day(text: str):
    return F.lit(text).cast("date")


def entries(spark: SparkSession, sf_dir: str, fys: list[str] = []) -> DataFrame:  # noqa: B006
    """All entries, or those of some fiscal years, read by ranges of the stored date."""
    o = table(spark, sf_dir, "orders").where(in_years(F.col("o_orderdate"), fys))
    start = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderstatus") == "P", "Hold").otherwise(F.col("o_orderstatus"))
    done = F.when(F.col("o_orderstatus") == "F", F.date_add(start, 3))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), start.alias("from_date"), F.date_add(start, (F.col("o_orderkey") % 45).cast("int")).alias("last_date"),
        status.alias("status"), done.alias("done_date"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("amount"), fy_of(start).alias("fy"),
    )


FY_SQL = "CAST(year({d}) - CASE WHEN month({d}) < 4 THEN 1 ELSE 0 END AS VARCHAR) || '_' || lpad(CAST((year({d}) - CASE WHEN month({d}) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0')"


def fy_sql(date: str) -> str:
    return FY_SQL.format(d=date)


ENTRIES = f"""entries AS (
  SELECT o_orderkey AS id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS from_date,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS last_date,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'Hold' ELSE o_orderstatus END AS status,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 3 END AS done_date,
         o_orderpriority AS priority, o_totalprice AS amount, {fy_sql("CAST(o_orderdate AS DATE)")} AS fy
  FROM orders)"""


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("opening"))


ACCOUNTS = "accounts AS (SELECT c_custkey AS account_id, c_nationkey AS group_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS opening FROM customer)"

#: Entries keyed by group and priority, which nest and overlap much more than those of one account.
DENSE = "dense AS (SELECT a.group_id, e.priority, e.from_date, e.last_date, e.done_date FROM entries e JOIN accounts a USING (account_id))"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).join(accounts(spark, sf_dir).select("account_id", "group_id"), "account_id").select("group_id", "priority", "from_date", "last_date", "done_date")


def clamped_sql(source: str, keys: str, name: str = "clamped") -> str:
    return f"{name} AS (SELECT {keys}, greatest(from_date, DATE '{LOW}') AS from_date, least(last_date, DATE '{HIGH}') AS last_date FROM {source} WHERE from_date <= DATE '{HIGH}' AND last_date >= DATE '{LOW}')"


def islands_sql(source: str, keys: str, name: str = "islands") -> str:
    return f"""marked_{name} AS (
  SELECT *, max(last_date) OVER (PARTITION BY {keys} ORDER BY from_date, last_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
numbered_{name} AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR from_date > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY from_date, last_date ROWS UNBOUNDED PRECEDING) AS island FROM marked_{name}),
{name} AS (SELECT {keys}, min(from_date) AS from_date, max(last_date) AS last_date FROM numbered_{name} GROUP BY {keys}, island)"""


def gaps_sql(islands: str, universe: str, keys: str, name: str = "gaps") -> str:
    return f"""ends_{name} AS (
  SELECT {keys}, from_date, last_date FROM {islands} UNION ALL SELECT {keys}, DATE '{HIGH}' + 1, DATE '{HIGH}' + 1 FROM {universe}),
all_{name} AS (
  SELECT {keys}, coalesce(lag(last_date) OVER (PARTITION BY {keys} ORDER BY from_date) + 1, DATE '{LOW}') AS gap_start, from_date - 1 AS gap_end FROM ends_{name}),
{name} AS (SELECT * FROM all_{name} WHERE gap_start <= gap_end)"""
