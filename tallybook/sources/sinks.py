"""Writers: fiscal-year partitions, quoted CSV, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.scalars import collapse


def write_by_fy(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, one folder for each fiscal year; rows of a year are spread over the tasks that hold them."""
    df.write.mode(mode).partitionBy("fy").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, white space collapsed, header on top."""
    df.select(*(collapse(F.col(c).cast("string")).alias(c) for c in df.columns)).write.option("header", True).option("quoteAll", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def split_rejects(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows with a reason): a null reason is good."""
    marked = df.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")
