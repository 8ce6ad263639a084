"""Vector codes by exact k-means over Hilbert-sorted flat blocks.

Vectors are cut into equal parts and each part position has its own codebook. The parts of a position are sorted along a
Hilbert curve and lie in flat blocks of BLOCK_ROWS parts, each with the least and greatest value of every component
and the sums of its components. In each round the distances from a block's box to the entries leave a short list of
entries that can be the nearest of some part of it: with one left the block's sums go to that entry and its rows are not looked at, else
whole-number kernels decide among the few. All arithmetic is on whole numbers, so results don't depend on blocks, order or partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import table, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Parts in a block.
BLOCK_ROWS = 512
#: Rows at most whose range sets the cells of the curve; it affects the blocks, never a result.
RANGE_ROWS = 10_000
#: Whole-number components are below this, so that squared distances fit in 64 bits.
LIMIT = 1 << 26


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row, _id, _label and floor(SCALE * x) of the vectors without null or non-finite components, as whole numbers."""
    for batch in batches:
        vectors = batch.column(3)
        vectors = vectors.cast(pa.large_list(pa.float64()))
        offsets = np.asarray(vectors.offsets)
        values = vectors.values.to_numpy(zero_copy_only=False)  # nulls become nan
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
        chosen = np.flatnonzero(keep)
        if not len(chosen):
            continue
        with np.errstate(invalid="ignore"):
            whole = np.floor(values * SCALE)
        inside = np.zeros(len(values) + 1, np.int64)
        np.add.at(inside, offsets[:-1][chosen], 1)
        np.add.at(inside, offsets[1:][chosen], -1)
        inside = np.cumsum(inside)[:-1] > 0
        whole = whole[inside]
        if len(whole) and np.abs(whole).max() >= LIMIT:
            raise ValueError(f"a component is {LIMIT // SCALE} or more in size: its squared distances need more than 64 bits")
        lengths = (offsets[1:] - offsets[:-1])[chosen]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(whole.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(chosen)) for i in range(3)), lists], names=["_row", "_id", "_label", "_v"])


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (rows of `cells`, each component of `bits` bits; components * bits <= 62)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest
        bit = np.int64(1 << level)
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (bit - 1))
            x[0] ^= np.where(turned, bit - 1, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):  # from Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    place = np.zeros_like(flip)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _placed(low: np.ndarray, high: np.ndarray, width: int):
    """A row for each part of each vector: its position, its place on the curve, its row and its bytes. low, high: usual range of each component."""
    used = min(width, 60)  # components that set the order
    bits = max(1, min(12, 60 // used))
    step = (1 << bits) / np.maximum(high - low, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width * PARTS)
            cells = np.clip(((v - low) * step).astype(np.int64), 0, (1 << bits) - 1)
            for part in range(PARTS):
                own = np.ascontiguousarray(v[:, part * width : (part + 1) * width]).astype("<i4")
                place = hilbert_index(cells[:, part * width : part * width + used], bits)
                data = pa.Array.from_buffers(pa.binary(4 * width), len(own), [None, pa.py_buffer(own)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), pa.array(place), batch.column(0), data], names=["_part", "_place", "_row", "_data"])

    return run


def _blocks(width: int):
    """Flat blocks of sorted parts: position, number of parts, rows, components, box and sums."""

    def block(part: int, rows: np.ndarray, v: np.ndarray) -> list:
        return [part, len(rows), rows.tobytes(), v.tobytes(), v.min(0).astype("<i8").tobytes(), v.max(0).astype("<i8").tobytes(), v.sum(0, dtype="<i8").tobytes()]

    names = ["_part", "_n", "_rows", "_data", "_low", "_high", "_sums"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, held = -1, np.zeros(0, "<i8"), np.zeros((0, width), "<i4")
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, made = batch.column(0).to_numpy(), []
            ids = batch.column(2).to_numpy().astype("<i8")
            data = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4").reshape(-1, width)
            for run_of in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(parts)) + 1):
                if len(rows) and parts[run_of[0]] != part:
                    made.append(block(part, rows, held))
                    rows, held = rows[:0], held[:0]
                part = int(parts[run_of[0]])
                rows, held = np.concatenate([rows, ids[run_of]]), np.concatenate([held, data[run_of]])
                whole = len(rows) // BLOCK_ROWS * BLOCK_ROWS
                made += [block(part, rows[a : a + BLOCK_ROWS], held[a : a + BLOCK_ROWS]) for a in range(0, whole, BLOCK_ROWS)]
                rows, held = rows[whole:], held[whole:]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(block(part, rows, held), types)], names=names)

    return run


def short_list(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries can be nearest to some point of the box: those no farther from it than every entry's farthest corner allows. Ascending."""
    near = np.maximum(np.maximum(low - entries, entries - high), 0)
    far = np.maximum(np.abs(entries - low), np.abs(entries - high))
    return np.flatnonzero((near * near).sum(1) <= (far * far).sum(1).min())


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry, ties to the first, and its squared distance."""
    distance = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        gap = points[:, j, None] - entries[None, :, j]
        distance += gap * gap
    best = distance.argmin(1)
    return best, distance[np.arange(len(points)), best]


def _each_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, object, object, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        part, n, rows, data, low, high, sums = batch.columns
        for i in range(batch.num_rows):
            box = [np.frombuffer(c[i].as_py(), "<i8") for c in (low, high, sums)]
            yield part[i].as_py(), n[i].as_py(), rows[i], data[i], *box


def _points(data: object, width: int) -> np.ndarray:
    return np.frombuffer(data.as_py(), "<i4").reshape(-1, width).astype(np.int64)


def _round(books: np.ndarray, width: int):
    """Sums and counts of each entry over a task's blocks, one row for each component of an entry with any part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for part, n, _, data, low, high, sums in _each_block(batches, width):
            few = short_list(low, high, books[part])
            if len(few) == 1:
                total[part, few[0]] += sums
                count[part, few[0]] += n
                continue
            points = _points(data, width)
            best, _ = nearest(points, books[part][few])
            chosen = np.zeros((len(few), n), np.int64)
            chosen[best, np.arange(n)] = 1
            total[part, few] += chosen @ points
            count[part, few] += chosen.sum(1)
        part, entry = np.nonzero(count)
        for p, e in zip(part.tolist(), entry.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([p] * width, pa.int32()), pa.array([e] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(total[p, e]), pa.array([int(count[p, e])] * width, pa.int64())], names=["_part", "_entry", "_at", "_total", "_n"])

    return run


def _assigned(books: np.ndarray, width: int):
    """Row, position, nearest entry and squared distance of every part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, rows, data, low, high, _ in _each_block(batches, width):
            few = short_list(low, high, books[part])
            best, distance = nearest(_points(data, width), books[part][few])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows.as_py(), "<i8")), pa.array(np.full(n, part, np.int32)), pa.array(few[best].astype(np.int32)), pa.array(distance)], names=["_row", "_part", "_code", "_distance"])

    return run


_CODED = "code string, error long"


def coded_vectors(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of each usable vector, and the codebooks as parts x entries x components.

    Rows whose vector is null or holds null or non-finite components are left out. The width is that of the first usable vector
    (least key, nulls last, then least components); if 8 doesn't divide it, zeros are added; usable vectors of another width
    stay, with null code and error. Repeated rows count each; with fewer rows than entries there are fewer entries; without
    usable rows the result is empty and there are no entries. A component of 16,384 or more in size is an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_id"), F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_v"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_id", "_label")}
    rows = written(rows.mapInArrow(_components, f"_row long, _id {kinds['_id']}, _label {kinds['_label']}, _v array<int>"), "components")
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(1).collect()
    size = len(first[0]["_v"]) if first else 0
    usual = rows.where(F.size("_v") == size)
    width = max(1, -(-size // PARTS))
    seeds = [r["_v"] for r in usual.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()]
    books = np.zeros((len(seeds), width * PARTS), np.int64)
    for i, v in enumerate(seeds):
        books[i, :size] = v
    books = np.ascontiguousarray(books.reshape(len(seeds), PARTS, width).transpose(1, 0, 2))
    named = [F.col("_id").alias(key), F.col("_label").alias(label)]
    odd = rows.where(F.size("_v") != size).select(*named, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return odd, books

    padded = usual.select("_row", F.concat("_v", F.array_repeat(F.lit(0), width * PARTS - size)).alias("_v"))
    spread = padded.limit(RANGE_ROWS).select(F.posexplode("_v").alias("_at", "_x")).groupBy("_at").agg(F.avg("_x").alias("m"), F.stddev_pop("_x").alias("s")).collect()
    low, high = np.zeros(width * PARTS), np.zeros(width * PARTS)
    for r in spread:
        low[r["_at"]], high[r["_at"]] = r["m"] - 3 * r["s"], r["m"] + 3 * r["s"]
    parts = padded.mapInArrow(_placed(low, high, width), "_part int, _place long, _row long, _data binary")
    order = ["_part", "_place", "_row"]
    sorted_parts = parts.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(sorted_parts.mapInArrow(_blocks(width), "_part int, _n int, _rows binary, _data binary, _low binary, _high binary, _sums binary"), "blocks")

    for _ in range(rounds):
        sums = blocks.mapInArrow(_round(books, width), "_part int, _entry int, _at int, _total long, _n long")
        books = books.copy()
        # One row for each component of the codebooks.
        for r in sums.groupBy("_part", "_entry", "_at").agg(F.sum(F.col("_total").cast("decimal(38,0)")).alias("t"), F.sum("_n").alias("n")).collect():
            books[r["_part"], r["_entry"], r["_at"]] = int(r["t"]) // r["n"]

    found = blocks.mapInArrow(_assigned(books, width), "_row long, _part int, _code int, _distance long")
    packed = found.groupBy("_row").agg(F.bit_or(F.expr("shiftleft(cast(_code as long), 8 * _part)")).alias("_bits"), F.sum("_distance").alias("error"))
    digits = [F.lower(F.lpad(F.hex(F.shiftrightunsigned("_bits", 8 * p).bitwiseAND(F.lit(255))), 2, "0")) for p in range(PARTS)]
    coded = usual.select("_row", "_id", "_label").join(packed, "_row").select(*named, F.concat(*digits).alias("code"), "error")
    return coded.unionByName(odd), books


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: key, code (two hex digits for each part), error, label_error (over all rows of its label, nulls together), codebooks_sha256.

    See coded_vectors() for nulls, odd widths, ties, repeated rows and empty tables; other columns are ignored.
    """
    coded, books = coded_vectors(vectors.withColumn("_any_label", F.col(label)), rounds, entries, key, "_any_label", vector)
    coded = written(coded.withColumnRenamed(key, "_key"), "coded")
    sums = coded.groupBy(F.col("_any_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("_any_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The rounds as plain SQL: every part is compared with every entry."""
    kept = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
p AS MATERIALIZED (
  SELECT vec_id, i AS part, v[CAST(len(v) // {PARTS} * i + 1 AS BIGINT) : CAST(len(v) // {PARTS} * (i + 1) AS BIGINT)] AS x FROM k, range({PARTS}) r(i)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p
  WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES}))"""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT p.part, vec_id, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(x) AS x FROM (SELECT p.part, vec_id, x, entry, {square} AS d FROM p JOIN b{n} b ON p.part = b.part) p GROUP BY p.part, vec_id)")
        if n < ROUNDS:
            steps.append(f"""
u{n} AS (SELECT part, entry, j, CAST(floor_div(sum(x[j]), count(*)) AS BIGINT) AS m FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS j FROM a{n}) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(nc, c) AS c FROM b{n} LEFT JOIN (SELECT part, entry, list(m ORDER BY j) AS nc FROM u{n} GROUP BY ALL) USING (part, entry))""".replace("floor_div(sum(x[j]), count(*))", "(sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*)"))
    last = ROUNDS
    return f"""{kept},
{', '.join(s.strip() for s in steps)},
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(y, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(range(1, len(c) + 1)) AS j, CAST(unnest(c) AS VARCHAR) AS y FROM b{last})),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, s
"""


QUERIES = {"op12_hilbert_codes": op12_hilbert_codes}
ORACLES = {"op12_hilbert_codes": _oracle()}
