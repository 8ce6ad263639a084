"""Repeated passages: column-wise multi-string suffix construction over the places where texts can repeat.

Every string of LENGTH bytes has an anchor: the least hash among its ANCHOR-byte parts (the leftmost of equals), at
the same offset in every occurrence. Anchors that occur twice or more carry their context, all bytes that a
LENGTH-byte string around them can reach. Contexts of one anchor are a collection of strings for which the order of
all suffixes and their common prefixes are built column by column, from the right, one symbol of each string
per round (as the multi-string Burrows-Wheeler construction does), from sequentially read partitions sorted by anchor.
A run of suffixes with a common prefix of LENGTH is one repeated string; all but its earliest occurrence are marked.

Equal contexts go through the construction once, and texts equal as a whole only by their smallest id.
An anchor with very many different contexts is decided by grouping hashes of its strings instead, which
spreads over tasks; both ways give the same marks.

A row is known by its key and a hash of its text (x), so that rows which share a key never mix. Every table that a hot anchor
is joined with is written first: both sides of such a join are then plain shuffles, which Spark cuts where one is skewed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.llm.textkit import mix, powers, slices
from tallybook.session import discarded, table, written

LENGTH, ANCHOR = 100, 32
#: Bytes beside the anchor that a string can reach on either side; a string's offset is 0..SIDE.
SIDE = LENGTH - ANCHOR
WIDTH = ANCHOR + 2 * SIDE
#: Contexts handled at once, and different contexts of an anchor above which hashes decide.
BLOCK, MANY = 1 << 15, 1 << 14
#: Bytes of a long text that anchors are looked for in at once, and contexts of a text that are made at once.
PIECE, PLACES = 1 << 22, 1 << 14
_POSITION_BITS = 28
_VALUES = mix(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def rolled(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all parts of `size` bytes."""
    n = len(data)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * power[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and position (in the slice) of all anchors of the rows' strings; the slice has 1 << _POSITION_BITS bytes at most."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.view(np.uint64), none
    h = rolled(data, ANCHOR)
    low = (h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | np.arange(len(h), dtype=np.uint64)
    span, least = 1, low
    while span < SIDE + 1:  # the least of SIDE + 1 neighbours, by doubling
        step = min(span, SIDE + 1 - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    start = np.ones(len(least), bool)  # strings that lie inside a row
    for a in offsets[1:-1].tolist():
        start[max(0, a - LENGTH + 1) : a] = False
    at = (least[start] & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return np.searchsorted(offsets, at, "right") - 1, h[at], at


def text_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a slice of any length: one long text is read in pieces that share LENGTH - 1 bytes."""
    if len(data) <= PIECE or len(offsets) > 2:
        return anchors(data, offsets)
    hashes, places, last = [], [], -1
    for a in range(0, len(data) - LENGTH + 1, PIECE - LENGTH + 1):
        piece = data[a : a + PIECE]
        _, h, at = anchors(piece, np.array([0, len(piece)]))
        fresh = at + a > last  # the anchor of the last string of one piece can be that of the first of the next
        hashes.append(h[fresh])
        places.append(at[fresh] + a)
        last = int(places[-1][-1]) if len(places[-1]) else last
    at = np.concatenate(places)
    return np.zeros(len(at), np.int64), np.concatenate(hashes), at


def anchor_table(docs: DataFrame) -> DataFrame:
    """id, x and the hashes and positions of the anchors of each text (id, x, text) of LENGTH bytes or more."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, hashes, places = [], [], []
        for a, b, data, offsets in slices(batch.column(2)):
            row, h, at = text_anchors(data, offsets)
            cut = np.searchsorted(row, np.arange(b - a + 1))
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                ids.append(a + i)
                hashes.append(h[cut[i] : cut[i + 1]].view(np.int64))
                places.append((at[cut[i] : cut[i + 1]] - offsets[i]).astype(np.int32))
        keys = [batch.column(c).take(pa.array(ids, pa.int64())) for c in (0, 1)]
        return pa.record_batch([*keys, pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["id", "x", "h", "pos"])

    return map_batches(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, x long, h array<long>, pos array<int>")


def context_table(rows: DataFrame) -> DataFrame:
    """For rows (id, x, text, places): one row per place with h, id, x, pos, left, right, context and a hash pair of it.

    left and right: bytes of the text beside the anchor, SIDE at most; the context has WIDTH bytes, padded with 0.
    """

    def part(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, pos: np.ndarray) -> list[pa.Array]:
        at = offsets[row] + pos
        left = np.minimum(pos, SIDE)
        right = np.minimum(offsets[row + 1] - at - ANCHOR, SIDE)
        column = np.arange(WIDTH)
        inside = (column >= SIDE - left[:, None]) & (column < SIDE + ANCHOR + right[:, None])
        source = np.clip(at[:, None] - SIDE + column, 0, len(data) - 1)
        context = np.where(inside, data[source], 0).astype(np.uint8)
        words = np.ascontiguousarray(np.pad(context, ((0, 0), (0, -WIDTH % 8)))).view(np.uint64)
        one, two = (left * 1000 + right).astype(np.uint64), (left * 1000 + right + 7).astype(np.uint64)
        for j in range(words.shape[1]):
            one, two = mix(one ^ words[:, j]), mix((two + words[:, j]) * np.uint64(0xD6E8FEB86659FD93))
        anchor = np.ascontiguousarray(context[:, SIDE : SIDE + ANCHOR]).view(np.uint64)
        h = np.zeros(len(pos), np.uint64)
        for j in range(anchor.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ anchor[:, j])
        binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(pos), [None, pa.py_buffer(np.ascontiguousarray(context).tobytes())]).cast(pa.binary())
        return [pa.array(h.view(np.int64)), pa.array(pos.astype(np.int32)), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), binary]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, _, data, offsets in slices(batch.column(2)):
            places = batch.column(3).slice(a, len(offsets) - 1)
            count = np.diff(places.offsets.to_numpy())
            row = np.repeat(np.arange(len(count)), count)
            pos = places.flatten().to_numpy().astype(np.int64)
            order = np.lexsort((pos, row))
            row, pos = row[order], pos[order]
            for k in range(0, len(pos), PLACES):
                keys = [batch.column(c).take(pa.array(row[k : k + PLACES] + a)) for c in (0, 1)]
                yield pa.record_batch([*keys, *part(data, offsets, row[k : k + PLACES], pos[k : k + PLACES])], names=["id", "x", "h", "pos", "left", "right", "one", "two", "context"])

    return map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, x long, h long, pos int, left short, right short, one long, two long, context binary")


def later_strings(group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """contexts x (SIDE + 1): whether the string that begins `offset` bytes before the anchor occurs earlier.

    group: sorted numbers of the anchors; the contexts of each are in the order of their first occurrences. In each round one symbol of
    every context is put before its suffix: a stable sort by (group, symbol) keeps the order of the suffixes, and the
    common prefix of two neighbours grows by one to the least of those between them before, up to LENGTH.
    """
    n = len(group)
    later = np.zeros((n, SIDE + 1), bool)
    order = np.arange(n)
    common = np.zeros(n, np.int64)  # with the suffix before in order
    column = np.arange(WIDTH)
    present = (column >= SIDE - left[:, None]) & (column < SIDE + ANCHOR + right[:, None])
    symbols = np.where(present, context.astype(np.int32) + 1, 0)
    base = group.astype(np.int64) << 9
    for c in range(WIDTH - 1, -1, -1):
        s = symbols[order, c]
        key = base[order] | s
        move = np.argsort(key, kind="stable")
        key = key[move]
        same = np.zeros(n, bool)
        same[1:] = key[1:] == key[:-1]
        same &= s[move] > 0  # a byte outside the text equals nothing
        fresh = np.zeros(n, np.int64)
        at = np.flatnonzero(same)
        if len(at):
            first, last = move[at - 1] + 1, move[at]
            between = common[last]
            apart = np.flatnonzero(first < last)
            if len(apart):
                bounds = np.column_stack([first[apart], last[apart] + 1]).ravel()
                between[apart] = np.minimum.reduceat(np.append(common, 0), bounds)[::2]
            fresh[at] = np.minimum(between + 1, LENGTH)
        common, order = fresh, order[move]
        if c <= SIDE:
            run = common >= LENGTH
            if run.any():
                starts = np.flatnonzero(~run)
                least = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.append(starts, n)))
                later[order, SIDE - c] = order > least
    return later


def _marks(later: np.ndarray) -> pa.Array:
    return pa.array([m.tobytes() for m in np.packbits(later, axis=1)], pa.binary())


def marked_contexts(firsts: DataFrame) -> DataFrame:
    """(h, one, two, mask) for contexts sorted by h and first place within partitions; those without a later string are left out."""

    def flush(t: pa.Table) -> list[pa.RecordBatch]:
        h = t["h"].to_numpy()
        group = np.cumsum(np.append(False, h[1:] != h[:-1]))
        context = np.frombuffer(b"".join(t["context"].to_pylist()), np.uint8).reshape(-1, WIDTH)
        later = later_strings(group, context, t["left"].to_numpy().astype(np.int64), t["right"].to_numpy().astype(np.int64))
        out = pa.table([t["h"], t["one"], t["two"], _marks(later)], names=["h", "one", "two", "mask"])
        return out.filter(pa.array(later.any(axis=1))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows >= BLOCK:
                h = held["h"].to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on in the next batch
                if cut:
                    yield from flush(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from flush(held)

    return firsts.select("h", "one", "two", "left", "right", "context").mapInArrow(run, "h long, one long, two long, mask binary")


def hashed_contexts(firsts: DataFrame) -> DataFrame:
    """The same marks for anchors with very many contexts: group by the hash of each string, least first place first."""

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        context = np.frombuffer(b"".join(batch.column("context").to_pylist()), np.uint8)
        h1 = rolled(context, LENGTH)
        left, right = (batch.column(c).to_numpy().astype(np.int64)[:, None] for c in ("left", "right"))
        offset = np.arange(SIDE + 1)
        row, off = np.nonzero((offset <= left) & (LENGTH - ANCHOR - offset <= right))
        at = row * WIDTH + SIDE - off
        pick = [batch.column(c).take(pa.array(row)) for c in ("h", "one", "two", "first")]
        return pa.record_batch([*pick, pa.array(off.astype(np.int16)), pa.array(h1[at].view(np.int64))], names=["h", "one", "two", "place", "off", "string"])

    kind = firsts.schema["first"].dataType.simpleString()
    every = map_batches(firsts.select("h", "one", "two", "first", "left", "right", "context"), strings, f"h long, one long, two long, place {kind}, off short, string long")
    least = every.groupBy("h", "off", "string").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = every.join(written(least, "strings"), ["h", "off", "string"]).where("place > first")
    flags = late.groupBy("h", "one", "two").agg(F.collect_set("off").alias("offs"))

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        later = np.zeros((batch.num_rows, SIDE + 1), bool)
        for i, offs in enumerate(batch.column(3).to_pylist()):
            later[i, offs] = True
        return pa.record_batch([*batch.columns[:3], _marks(later)], names=["h", "one", "two", "mask"])

    return map_batches(flags, packed, "h long, one long, two long, mask binary")


def removed_ranges(marks: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by marked strings; marks: pos, left, right and mask (None: every string)."""
    if not marks:
        return []
    pos = np.array([m["pos"] for m in marks], np.int64)
    left, right = (np.array([m[k] for m in marks], np.int64)[:, None] for k in ("left", "right"))
    every = np.packbits(np.ones(SIDE + 1, bool)).tobytes()
    mask = np.frombuffer(b"".join([m["mask"] or every for m in marks]), np.uint8).reshape(len(marks), -1)
    offset = np.arange(SIDE + 1)
    flagged = np.unpackbits(mask, axis=1)[:, : SIDE + 1].astype(bool) & (offset <= left) & (SIDE - offset <= right)
    row, off = np.nonzero(flagged)
    starts = np.unique(pos[row] - off)
    if not len(starts):
        return []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + LENGTH).tolist()))


def _place() -> Column:
    """Rows in the order of their keys, rows that share one by a hash of the text, then positions, in one number."""
    number = lambda c: c.cast("decimal(20,0)")
    tie = F.col("x").bitwiseAND((1 << 30) - 1) * F.lit(1 << 31) + F.col("pos")
    return (number(F.col("id")) * F.lit(1 << 61).cast("decimal(19,0)") + number(tie)).cast("decimal(38,0)")


def _decisions(docs: DataFrame, key: str, text: str, carry: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """id, text, copy (equal to the text of a smaller id) and marks for every row of docs; carry: further columns by new name."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(name) for name, c in carry.items()))
    rows = rows.withColumn("x", F.xxhash64("text"))
    long_ = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))
    keyed = long_.select("id", "x", F.xxhash64(F.lit(7), F.col("text")).alias("y"), F.octet_length("text").alias("n"))
    equal = keyed.groupBy("x", "y", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    equal = written(equal, "equal")
    equal_rows = written(keyed.join(equal, ["x", "y", "n"]).groupBy("id", "x", "least").agg(F.count(F.lit(1)).alias("rows")), "equal")
    copies = equal_rows.where("id > least").select("id", "x")
    if not equal_rows.where("id = least and rows > 1").isEmpty():  # rows that share key and text have the same marks
        long_ = long_.dropDuplicates(["id", "x"])

    found = anchor_table(long_.select("id", "x", "text")).join(copies, ["id", "x"], "left_anti")
    found = written(found.select("id", "x", F.explode(F.arrays_zip("h", "pos")).alias("a")).select("id", "x", "a.h", "a.pos"), "anchors")
    twice = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    places = found.join(twice, "h", "left_semi").groupBy("id", "x").agg(F.collect_list("pos").alias("places"))
    places = written(places, "places")
    discarded(equal, found, twice)
    contexts = written(context_table(long_.join(places, ["id", "x"]).select("id", "x", "text", "places")), "contexts")
    discarded(places)

    kinds = contexts.groupBy("h", "one", "two", "left", "right", "context").agg(F.min(_place()).alias("first"))
    kinds = written(kinds, "kinds")
    several = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "several")
    chosen = kinds.join(several, "h")
    built = marked_contexts(chosen.where(F.col("different") <= MANY).repartition("h").sortWithinPartitions("h", "first"))
    hashed = hashed_contexts(chosen.where(F.col("different") > MANY))
    masks = written(built.unionByName(hashed), "masks")
    decided = written(kinds.select("h", "one", "two", "first").join(masks, ["h", "one", "two"], "left"), "decided")
    discarded(kinds, several, masks)

    # A context that is not the first of its kind has every string of its own earlier; the first one has those of its mask.
    marks = contexts.drop("context").join(decided, ["h", "one", "two"]).withColumn("is_first", _place() == F.col("first"))
    marks = marks.where("not is_first or mask is not null").select("id", "x", "pos", "left", "right", F.when(F.col("is_first"), F.col("mask")).alias("mask"))
    marks = written(marks.groupBy("id", "x").agg(F.collect_list(F.struct("pos", "left", "right", "mask")).alias("marks")), "marks")  # at most a text's anchors
    discarded(contexts, decided)
    return rows.join(copies.withColumn("copy", F.lit(True)), ["id", "x"], "left").join(marks, ["id", "x"], "left")


def _ranges(copy: bool | None, marks: list[dict] | None, size: int) -> list[tuple[int, int]]:
    return [(0, size)] if copy else removed_ranges(marks or [], size)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", spans_name: str | None = "spans") -> DataFrame:
    """The rows of docs, texts without the bytes of strings that occur earlier, and the removed byte ranges.

    Earlier: in a row with a smaller key, or before in the same text. Of rows that share a key but not a text those
    with a smaller hash of the text are earlier; equal rows are not earlier than each other. A row without a key takes no part
    and stays whole. A null text is empty; texts may have any length. A character of which some bytes are removed is removed.
    Other columns stay as they are; an empty table gives no rows. spans_name: the column of the ranges, None for none.
    """
    others = {f"_other{i}": c for i, c in enumerate(docs.columns) if c not in (key, text)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, spans = [], []
        for t, copy, marks in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = _ranges(copy, marks, len(t))
            out.append(_kept(t, gone).decode("utf-8", "ignore"))
            spans.append([{"start": a, "end": b} for a, b in gone])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(spans, span), *batch.columns[4:]], names=["id", "text", "spans", *others])

    rows = _decisions(docs, key, text, others).select("id", "text", "copy", "marks", *others)
    kinds = "".join(f", {name} {docs.schema[c].dataType.simpleString()}" for name, c in others.items())
    out = map_batches(rows, run, f"id {docs.schema[key].dataType.simpleString()}, text string, spans array<struct<start:bigint,end:bigint>>{kinds}")
    back = {key: "id", text: "text"} | {c: name for name, c in others.items()}
    return out.select(*(F.col(back[c]).alias(c) for c in docs.columns), *([F.col("spans").alias(spans_name)] if spans_name else []))


def _kept(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in gone for x in span), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def removal_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 for each row; the rules are those of deduplicated()."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, copy, marks in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = _ranges(copy, marks, len(t))
            out.append((len(t), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_kept(t, gone)).hexdigest()))
        columns = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.record_batch([batch.column(0), *columns], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _decisions(docs, key, text).select("id", "text", "copy", "marks")
    return map_batches(rows, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
