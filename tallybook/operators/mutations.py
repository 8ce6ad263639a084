"""Changes as pure functions from tables to tables: upserts, inserts, deletes, moves, constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators.relational import one_per_key


def _differs(columns: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x | y, (~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns), F.lit(False))


def classified(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of the merged table with its action: kept (source has no such key), existing, updated or inserted.

    source needs one row for each key (see one_per_key); its other columns win.
    """
    columns = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*columns).alias("t"))
    s = source.select(*keys, F.struct(*columns).alias("s"))
    action = F.when(F.col("s").isNull(), "kept").when(F.col("t").isNull(), "inserted").when(_differs(columns, "s", "t"), "updated").otherwise("existing")
    both = t.join(s, keys, "full").withColumn("action", action)
    row = F.coalesce("s", "t")
    return both.select(*keys, *(row[c].alias(c) for c in columns), "action")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return classified(target, source, keys).select(*target.columns)


def action_counts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return classified(target, source, keys).where("action <> 'kept'").groupBy("action").count().withColumnRenamed("count", "n")


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target and those source rows, the first of each key, whose key it lacks."""
    fresh = one_per_key(source, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def updated_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """New values where the condition holds; a null condition changes nothing."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def cascade_delete(tables: list[tuple[DataFrame, str | None, str]], doomed: DataFrame) -> list[DataFrame]:
    """Delete along a chain of (table, foreign key to the table before, own key); doomed: keys of the first table."""
    out, gone = [], doomed
    for df, foreign, own in tables:
        gone_keys = gone.select(F.col(gone.columns[0]).alias("_gone")).distinct()
        on = F.col(foreign or own) == F.col("_gone")
        out.append(df.join(gone_keys, on, "left_anti"))
        gone = df.join(gone_keys, on, "left_semi").select(own)
    return out


def carried_forward(items: DataFrame, from_fy: str, to_fy: str, keys: list[str]) -> DataFrame:
    """Items of one year that the other does not have yet, as rows of the other."""
    old = items.where(F.col("fy") == from_fy).dropDuplicates(keys)
    return old.join(items.where(F.col("fy") == to_fy).select(*keys), keys, "left_anti").withColumn("fy", F.lit(to_fy))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule for every rule that a row breaks (a null rule counts as broken)."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
