"""Joins, lookups, aggregates, ordering and set operations that the reports are composed of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def related(facts: DataFrame, dimension: DataFrame, on: Column | str | list[str]) -> DataFrame:
    """Left join: a dangling reference keeps its row. The optimizer broadcasts a dimension whose size is small."""
    return facts.join(dimension, on, "left")


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with a sorted array of their children's structs, empty where there are none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equality in which null equals null; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys))
    return left.join(renamed, on, how).drop(*(f"_r_{k}" for k in keys))


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order that must be total."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most n rows of each key; Spark prunes each partition to n rows of a key before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def cascading(candidates: DataFrame, keys: list[str], tiers: list[Column], order: list[Column]) -> DataFrame:
    """Of each key's candidates the one of the lowest tier that holds, in column tier (from 1)."""
    tier = reduce(lambda rest, it: F.when(it[1], F.lit(it[0])).otherwise(rest), reversed(list(enumerate(tiers, 1))), F.lit(None).cast("int"))
    return one_per_key(candidates.withColumn("tier", tier).where("tier is not null"), keys, [F.col("tier"), *order])


def conditional_counts(parents: DataFrame, children: DataFrame, key: str, counts: dict[str, Column], id_: str) -> DataFrame:
    """Counts of children by predicate for every parent, 0 where there are none.

    Children are counted before the join, so one row for each key is joined.
    """
    grouped = children.groupBy(key).agg(*(F.count(F.when(p, F.col(id_))).alias(n) for n, p in counts.items()))
    return parents.join(grouped, key, "left").fillna(0, list(counts))


def stage_funnel(rows: DataFrame, group: str, member: str, stages: dict[str, Column]) -> DataFrame:
    """Distinct members of each group by stage predicate, one column for each, in one pass."""
    return rows.groupBy(group).agg(*(F.countDistinct(F.when(p, F.col(member))).alias(n) for n, p in stages.items()))


def with_grand_total(df: DataFrame, label: str, sums: list[str], total: str = "Total") -> DataFrame:
    """The rows and one more with the sums."""
    return df.select(label, *sums).unionByName(df.groupBy().agg(*(F.sum(c).alias(c) for c in sums)).select(F.lit(total).alias(label), *sums))


def first_existing_order(df: DataFrame, candidates: list[str], descending: bool = True, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """Order by the first of the columns that the table has, ties by further columns; unordered if it has none of them."""
    found = next((c for c in candidates if c in df.columns), None)
    return df if found is None else df.orderBy(F.desc(found) if descending else F.asc(found), *ties)


def label_rank(column: Column, labels: list[str]) -> Column:
    """Rank in a fixed order of labels; others come after, to be ordered by name."""
    out = F.lit(len(labels))
    for i, label in reversed(list(enumerate(labels))):
        out = F.when(column == label, i).otherwise(out)
    return out


def renamed_by_alias(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Each target column from the first alias that the table has (headers trimmed, case ignored), else null."""
    have = {c.strip().lower(): c for c in df.columns}
    pick = {t: next((have[a] for a in [t, *names] if a in have), None) for t, names in aliases.items()}
    return df.select(*(F.col(f"`{c}`").alias(t) if c else F.lit(None).cast("string").alias(t) for t, c in pick.items()))


def best_scored(candidates: DataFrame, keys: list[str], scores: list[Column], payload: list[str]) -> DataFrame:
    """The payload with the greatest tuple of scores in each key, without a sort."""
    best = F.max_by(F.struct(*payload), F.struct(*(s.alias(f"s{i}") for i, s in enumerate(scores)))).alias("_best")
    return candidates.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{p}").alias(p) for p in payload))
