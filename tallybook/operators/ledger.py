"""Ordered statement lines: running balances, repairs, reconciliation, vouchers, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(keys: list[str], seq: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*seq)


def running_balance(df: DataFrame, keys: list[str], seq: list[str], opening: Column, name: str = "balance") -> DataFrame:
    """Opening plus deposits minus withdrawals up to each line."""
    w = _order(keys, seq).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, opening + F.sum(F.col("deposit") - F.col("withdrawal")).over(w))


def fill_balance(df: DataFrame, keys: list[str], seq: list[str], mode: str = "exact") -> DataFrame:
    """Missing or zero balances from the last known one before, else from the first known one after.

    mode "reference" takes the amounts of the line itself, not of the next, when it fills backwards.
    """
    w = _order(keys, seq)
    before, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.col("deposit") - F.col("withdrawal")
    known = F.nullif(F.col("balance"), F.lit(0).cast(df.schema["balance"].dataType))
    out = df.withColumn("_known", known).withColumn("_sum", F.sum(moved).over(before))
    out = out.withColumn("_shift", F.col("_sum") if mode == "exact" else F.col("_sum") - F.coalesce(moved, F.lit(0)))
    forward = F.last(F.col("_known") - F.col("_sum"), True).over(before) + F.col("_sum")
    # A line without a known balance up to it has that of the key's first known one, so the whole key's frame does: it is one pass.
    backward = F.first(F.col("_known") - F.col("_shift"), True).over(whole) + F.col("_shift")
    return out.withColumn("balance", F.coalesce(forward, backward).cast(df.schema["balance"].dataType)).drop("_known", "_sum", "_shift")


def delta_direction(df: DataFrame, keys: list[str], seq: list[str], tag: Column | None = None) -> DataFrame:
    """direction: an explicit Dr/Cr tag, else the sign of the change of the last known balance, else debit."""
    last = F.last("balance", True).over(_order(keys, seq).rowsBetween(Window.unboundedPreceding, -1))
    change = F.col("balance") - last
    lowered = F.lower(F.coalesce(tag, F.lit(""))) if tag is not None else F.lit("")
    told = F.when(F.startswith(lowered, F.lit("cr")), "credit").when(F.startswith(lowered, F.lit("dr")), "debit")
    return df.withColumn("direction", F.coalesce(told, F.when(change > 0, "credit").when(change < 0, "debit"), F.lit("debit")))


def reconcile(df: DataFrame, keys: list[str], seq: list[str], tolerance: float = 0.0) -> DataFrame:
    """balance_mismatch: previous balance plus deposit minus withdrawal differs from the balance; first line false."""
    previous = F.lag("balance").over(_order(keys, seq))
    off = F.abs(previous + F.col("deposit") - F.col("withdrawal") - F.col("balance")) > tolerance
    return df.withColumn("balance_mismatch", F.coalesce(off, F.lit(False)))


def longest_narration(df: DataFrame, same: list[str], seq: list[str]) -> DataFrame:
    """Of lines equal in `same` the one with the longest narration, the earliest of equals."""
    order = [F.desc(F.length("narration")), *seq]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).where("_rn = 1").drop("_rn")


def without_noise(df: DataFrame, keys: list[str], seq: list[str], least: int = 3) -> DataFrame:
    """Drop lines whose narration is shorter than `least` and whose balance did not change; the first line's change is 0."""
    change = F.coalesce(F.col("balance") - F.lag("balance").over(_order(keys, seq)), F.lit(0))
    return df.withColumn("_change", change).where(~((F.length(F.trim("narration")) < least) & (F.col("_change") == 0))).drop("_change")


def voucher_serial(df: DataFrame, prefix: Column, seq: list[str], name: str = "voucher") -> DataFrame:
    """prefix-0001, 0002, ..., 9999, 10000, ... in row order; equal prefixes share one series whatever the year.

    Rows are numbered within each value of the first column of seq (say a day), to which the counts of the values before
    are added, so that a series of any length is many tasks' work.
    """
    first, out = seq[0], df.withColumn("_prefix", prefix)
    counts = out.groupBy("_prefix", F.col(first).alias("_first")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_prefix").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_prefix").alias("_p"), "_first", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_prefix", first).orderBy(*seq))
    out = out.withColumn("_inside", inside).join(counts, F.col("_prefix").eqNullSafe(F.col("_p")) & F.col(first).eqNullSafe(F.col("_first")))
    number = (F.col("_before") + F.col("_inside")).cast("string")
    padded = F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))  # lpad alone cuts longer numbers
    return out.withColumn(name, F.concat("_prefix", F.lit("-"), padded)).drop("_prefix", "_p", "_first", "_before", "_inside")


def line_blocks(lines: DataFrame, keys: list[str], seq: str, anchor: Column, text: str = "line") -> DataFrame:
    """An anchor line starts a block that the lines after it join: keys, block, text. Lines before any anchor go."""
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(anchor.cast("int")).over(w)).where("block > 0")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, text))), lambda s: s[text]), " ")
    return numbered.groupBy(*keys, "block").agg(joined.alias("text"))


def revision_numbers(df: DataFrame, keys: list[str], order: list[Column], revised: Column, name: str = "revision") -> DataFrame:
    """1, 2, ... for the revised rows of each key, null for others."""
    flagged = df.withColumn("_revised", F.coalesce(revised, F.lit(False)))
    number = F.row_number().over(Window.partitionBy(*keys, "_revised").orderBy(*order))
    return flagged.withColumn(name, F.when(F.col("_revised"), number)).drop("_revised")


def ledger_balance(accounts: DataFrame, lines: DataFrame, key: str, opening: str) -> DataFrame:
    """Each account's lines, debit and credit sums, last payment date and closing = opening - debit + credit.

    Lines are summed before the join; an account without lines closes at its opening.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(zero("debit")).alias("debit"), F.sum(zero("credit")).alias("credit"),
        F.max(F.when(zero("credit") > 0, F.col("date"))).alias("last_payment"),
    )
    out = accounts.join(sums, key, "left").withColumn("lines", zero("lines"))
    return out.withColumn("closing", F.col(opening) - zero("debit") + zero("credit"))
