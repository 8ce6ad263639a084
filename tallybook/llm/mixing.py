"""Pfair mixing: interleave sources so that each keeps within one block of its target weight.

A source's documents form blocks; block k of a source with weight w is released at slot floor(k/w) and
due at ceil((k+1)/w); one slot takes one block, earliest deadline first. Weights are exact ratios of whole
numbers, so nothing is rounded at any length. When a source runs out, a phase ends and the others share the
slots anew. The driver deals the blocks, holding the sources and one piece of the schedule, which is a table with
one row for each block; every document finds its slot by its rank in its source. A block has BLOCK_ROWS rows, or
more where the mix would have over MOST_BLOCKS of them, so that the driver's share of the work is bounded.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain, islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.session import table, written

BLOCK_ROWS = 16
#: Blocks that the driver deals at most, beside one of each source.
MOST_BLOCKS = 1 << 22
#: Without given targets, a source's weight is its row count to this power.
TEMPERATURE = 0.7
#: The mix ends when the sources still holding documents have less than this part of the target weight.
LEAST_ACTIVE = 0.5
#: Pieces of each source that are ranked apart.
RANK_BUCKETS = 1024
#: Blocks of a piece of the schedule that the driver holds at once.
PIECE = 1 << 18


def target_parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the weights that are above zero."""
    exact = {k: Fraction(w) for k, w in sorted(weights.items()) if w > 0}
    unit = lcm(*(w.denominator for w in exact.values()))
    return {k: int(w * unit) for k, w in exact.items()}


def schedule(blocks: dict[str, int], parts: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int, bool]]:
    """Earliest deadline first, ties by name: name, block, slot, release, deadline, phase and in_mix of every block in turn."""
    left = {k: n for k, n in blocks.items() if n > 0}
    used = dict.fromkeys(left, 0)
    whole, start, phase = sum(parts.values()), 0, 0
    while left:
        period = sum(parts[k] for k in left)
        in_mix = period / whole >= LEAST_ACTIVE
        done = dict.fromkeys(left, 0)
        waiting = [(0, k) for k in sorted(left)]  # release of a source's next block
        ready: list[tuple[int, str, int]] = []
        t, out = 0, False
        while not out:
            while waiting and waiting[0][0] <= t:
                release, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(done[k] + 1) * period // parts[k]), k, release))
            due, k, release = heapq.heappop(ready)
            assert due > t, "a set of weights that sum to one always has a schedule"
            yield k, used[k] + done[k], start + t, start + release, start + due, phase, in_mix
            done[k] += 1
            t += 1
            out = done[k] == left[k]
            heapq.heappush(waiting, (done[k] * period // parts[k], k))
        for k, n in done.items():
            used[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}
        start, phase = start + t, phase + 1


def schedule_table(spark: SparkSession, rows: Iterator[tuple[str, int, int, int, int, int, bool]]) -> DataFrame:
    """The rows of schedule() as a table, written piece by piece."""
    names = ["_name", "block", "slot", "release", "deadline", "phase", "in_mix"]
    types = [pa.string(), *[pa.int64()] * 4, pa.int32(), pa.bool_()]
    out = None
    while True:
        piece = list(islice(rows, PIECE))
        if out is not None and not piece:
            return out
        columns = zip(*piece) if piece else [[]] * len(names)
        made = written(spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)), "schedule")
        out = made if out is None else out.unionByName(made)


def pfair_mix(docs: DataFrame, targets: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: key, source, block, slot, release, deadline, phase, position and in_mix.

    A null source is a source of its own. Sources outside `targets` get no weight and come last, after
    all others, not in the mix. Rows of a source are in the order of a hash of the whole row, so rows that share a key,
    or have none, are spread like any others. position sorts the rows of the whole mix; in_mix says that the row comes
    before the mix ends. A block has block_rows rows, or total / MOST_BLOCKS where that is more. Texts may have any length.
    Empty tables give no rows; other columns are not returned, but for those of `carry`, small columns that name a row: they are
    no part of the hash and settle ties between equal rows. No text is shuffled.
    """
    spark, carry = docs.sparkSession, carry or []
    whole_rows = [F.struct(*carry).alias("_row")] if carry else []
    hashed = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind and c not in carry]  # those have no hash
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.coalesce(F.concat(F.lit("s:"), F.col(source)), F.lit("null")).alias("_name"), F.xxhash64(*hashed).alias("_hash"), *whole_rows)
    rows = rows.withColumn("_bucket", F.shiftrightunsigned("_hash", 54))  # the order of the buckets is that of the unsigned hashes
    counts = rows.groupBy("_name", "_bucket").agg(F.count(F.lit(1)).alias("_n"))  # at most sources times RANK_BUCKETS rows
    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_name", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    totals = {r["_name"]: r["n"] for r in counts.groupBy("_name").agg(F.sum("_n").alias("n")).collect()}  # one row for each source
    if targets is None:
        weights = {k: n**TEMPERATURE for k, n in totals.items()}
    else:
        weights = {f"s:{k}" if k is not None else "null": float(w) for k, w in targets.items()}
    parts = target_parts({k: w for k, w in weights.items() if k in totals})
    block_rows = max(block_rows, -(-sum(totals.values()) // MOST_BLOCKS))
    blocks = {k: -(-n // block_rows) for k, n in totals.items()}
    planned, rest = {k: blocks[k] for k in parts}, sorted(set(totals) - set(parts))
    last = chain.from_iterable(((k, b) for b in range(blocks[k])) for k in rest)
    after = ((k, b, slot, slot, slot + 1, len(parts), False) for slot, (k, b) in enumerate(last, sum(planned.values())))
    placing = schedule_table(spark, chain(schedule(planned, parts), after))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_name", "_bucket").orderBy("_hash", "_key", *(["_row"] if carry else []))) - 1)
    placed = ranked.join(offsets, ["_name", "_bucket"]).withColumn("_at", F.col("_rank") + F.col("_before"))
    placed = placed.withColumn("block", F.expr(f"_at div {block_rows}"))
    placed = placed.join(placing, ["_name", "block"])
    return placed.select(
        F.col("_key").alias(key), F.col("_source").alias(source), "block", "slot", "release", "deadline",
        "phase", F.expr(f"_at % {block_rows}").alias("_in_block"), "in_mix", *(["_row.*"] if carry else []),
    ).withColumn("position", F.col("slot") * block_rows + F.col("_in_block")).drop("_in_block")


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pfair_mixing": op10_pfair_mixing}
