"""Bounded samples of labelled rows, and folds by a checksum of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's text modulo folds equals fold; a null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(True))


def sample_ids(labels: DataFrame, key: str, label: str, classes: list, size: int) -> DataFrame:
    """(id, label) of at most `size` rows of each class, those with the lowest hashes of the id.

    Bounded by size times the number of classes, so that it can be broadcast.
    """
    out = None
    for value in classes:
        one = labels.where(F.col(label) == value).select(F.col(key).alias("id"), F.col(label).alias("label")).orderBy(F.xxhash64("id"), "id").limit(size)
        out = one if out is None else out.unionByName(one)
    return out
