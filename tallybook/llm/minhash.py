"""Near-duplicates by circulant MinHash: banded signatures, exact Jaccard checks, connected components.

Two permutations give all coordinates: sigma spreads the shingles over 2**32 places, and coordinate k is the
least value of pi after a circular shift of the places by k. Bands of ROWS coordinates make buckets. With 32
bands of 4 rows a pair at similarity 0.75 is missed with probability 6e-6, one at 0.8 with 5e-8.

Documents with equal shingle sets are one class and only its smallest id goes on. Inside buckets links are
looked for in rounds of stars: a few members of each bucket (the centres) are compared with those members that
are in other components so far; more members are centres in each round, until every bucket lies in
one component or all its members have been centres. So copies cost one comparison each, no bucket is expanded
into all its pairs while it holds together, and no pair of a bucket that could join two components goes unchecked.

Members of a bucket that no link joins would still meet each other all. Two exact bounds keep them apart. A shingle
that one document alone has, of those still in question, is in no intersection; so documents with c and d other shingles
have at most min(c, d) in common. And an odd sketch (each shingle flips one of its bits) differs in at most as
many bits as the sets differ in shingles, which bounds what they have in common from above, too. Every set has a sketch of SKETCH_BITS
bits; one of more than WIDE shingles has another of twice as many bits as shingles at least, as a short sketch of a long text tells nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.llm.graph import components, joined
from tallybook.llm.textkit import mix, shingle_sets, slices
from tallybook.session import table, written

BANDS, ROWS = 32, 4
SHINGLE_WORDS, PER_CENT = 5, 75
#: Centres of a bucket in round r: about FIRST * GROWTH**(r - 1), so a bucket of 16,384 members takes four rounds at most. The first are few, as
#: each member of a group of copies meets them in every bucket that they share, and mostly is in their component after that.
FIRST, GROWTH = 4, 16
SKETCH_BITS, WIDE = 1024, 512
#: Pairs of one document that a task checks at least before they are dealt to several, and documents with so many at most.
CHUNK, HOT = 256, 20_000
#: Members of a bucket that one task compares with its centres.
PART = 4096

_SIGMA = np.uint64(0x5851F42D4C957F2D)
_PI1, _PI2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: Shingles handled at once; they stay in the processor's cache for all coordinates.
_BLOCK = 1 << 15


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """count x len(sets) coordinates of sets that are not empty.

    pi is a bijection of 32 bits (multiply, xor with the upper half, multiply); the shift by k goes into its
    first multiplication, as pi1 * (place - k) = pi1 * place - pi1 * k.
    """
    out = np.empty((count, len(sets)), np.uint32)
    a = 0
    while a < len(sets):
        b, n = a, 0
        while b < len(sets) and (b == a or n + len(sets[b]) <= _BLOCK):
            n += len(sets[b])
            b += 1
        members = np.concatenate(sets[a:b])
        starts = np.cumsum([0] + [len(s) for s in sets[a : b - 1]])
        place = (mix(members ^ _SIGMA) >> np.uint64(32)).astype(np.uint32) * _PI1
        x, y = np.empty_like(place), np.empty_like(place)
        for k in range(count):
            np.subtract(place, np.uint32(k * int(_PI1) & 0xFFFFFFFF), out=x)
            np.right_shift(x, 16, out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, _PI2, out=x)
            out[k, a:b] = np.minimum.reduceat(x, starts)
        a = b
    return out


def band_keys(coordinates: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """sets x bands: a 64-bit key of each band's coordinates and number."""
    keys = np.empty((coordinates.shape[1], bands), np.uint64)
    for j in range(bands):
        h = np.full(coordinates.shape[1], j + 1, np.uint64)
        for c in coordinates[j * rows : (j + 1) * rows]:
            h = mix(h ^ (c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        keys[:, j] = h
    return keys.view(np.int64)


def odd_sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """`bits` bits (a power of 2, 64 at least) as 64-bit numbers: for each place whether an odd number of shingles falls on it.

    A shingle's place is its lowest bits, so half a sketch xor its other half is the sketch of half as many bits.
    """
    place = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray | None:
    return odd_sketch(shingles, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) > WIDE else None


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def signature_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n (shingles), two order-free sums of the set, its odd sketches (wide: of long texts only) and the band keys (none for an empty set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, one, two, odd, wide, bands = [], [], [], [], [], []
        for _, _, data, offsets in slices(batch.column(1)):
            sets = shingle_sets(data, offsets, SHINGLE_WORDS)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signatures(full)) if full else ())
            for s in sets:
                sizes.append(len(s))
                one.append(int(s.sum().view(np.int64)) if len(s) else 0)
                two.append(int(mix(s).sum().view(np.int64)) if len(s) else 0)
                odd.append(odd_sketch(s))
                wide.append(wide_sketch(s))
                bands.append(next(keys) if len(s) else np.zeros(0, np.int64))
        return pa.record_batch(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "n", "one", "two", "odd", "wide", "bands"],
        )

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, f"id {docs.schema[key].dataType.simpleString()}, n long, one long, two long, odd array<long>, wide array<long>, bands array<long>")


def with_both(pairs: DataFrame, rows: DataFrame, total: int) -> DataFrame:
    """pairs (a, b) with the value of either end: a, b, value_a, value_b; rows: id, value, one for each id.

    Either end can be that of very many pairs. Those of a hot one are dealt to parts by their other end, and its value is sent to each part: an end is
    hot beyond CHUNK pairs and beyond 2 / HOT of all `total` pairs, so there are HOT hot ones at most, which are broadcast.
    """
    limit = max(CHUNK, -(-2 * total // HOT))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") > limit)
    hot = written(ends.select("id", F.ceil(F.col("pairs") / limit).cast("int").alias("parts")), "hot")
    dealt = pairs.select("a", "b")
    for end, other in (("b", "a"), ("a", "b")):
        # The parts of a pair are settled before any value is joined, as values are wide.
        dealt = dealt.join(F.broadcast(hot.withColumnRenamed("id", end)), end, "left").withColumn(f"part_{end}", F.coalesce(F.pmod(F.xxhash64(other), "parts").cast("int"), F.lit(0))).drop("parts")
    for end in ("b", "a"):
        each = rows.select(F.col("id").alias(end), F.col("value").alias(f"value_{end}")).join(F.broadcast(hot.withColumnRenamed("id", end)), end, "left")
        each = each.withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        dealt = dealt.join(each, [end, f"part_{end}"])
    return dealt.select("a", "b", "value_a", "value_b")


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs (a, b, n, m: sizes) without those whose wide sketches prove that they are no link; pairs with a set of WIDE shingles or fewer stay."""
    kind = pairs.schema["a"].dataType.simpleString()
    long = (F.col("n") > WIDE) & (F.col("m") > WIDE)
    large = written(pairs.where(long).select("a", "b"), "large")
    total = large.count()
    if not total:
        return pairs.select("a", "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            (n, s), (m, t) = ((v["n"].as_py(), v["wide"].values.to_numpy()) for v in (x, y))
            if not n or not m:  # an id of several sets
                keep.append(True)
                continue
            size = min(len(s), len(t))
            apart = int(np.bitwise_count((folded(s, size) ^ folded(t, size)).view(np.uint64)).sum())
            most = (n + m - apart) // 2
            keep.append(100 * most >= PER_CENT * (n + m - most))
        return pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = with_both(large, sketches.select("id", F.struct("n", "wide").alias("value")), total)
    return pairs.where(~long).select("a", "b").unionByName(map_batches(both, run, f"a {kind}, b {kind}"))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose full shingle sets have 100 * intersection >= 75 * union."""
    kind = pairs.schema["a"].dataType.simpleString()
    total = pairs.count()
    if not total:
        return pairs.select("a", "b")
    both = with_both(pairs, texts.select("id", F.col("text").alias("value")), total)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for k in (2, 3):
            codes = batch.column(k).dictionary_encode()  # a centre's text comes many times: its set is made once
            distinct = [s for _, _, data, offsets in slices(codes.dictionary) for s in shingle_sets(data, offsets, SHINGLE_WORDS)]
            sides.append([distinct[i] for i in codes.indices.to_pylist()])
        keep = []
        for s, t in zip(*sides):
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * common >= PER_CENT * (len(s) + len(t) - common) > 0)
        return pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both, run, f"a {kind}, b {kind}")


def shared_shingles(texts: DataFrame) -> DataFrame:
    """id and `alone`: how many of its shingles no other row of texts has (rows without any are left out).

    One count and least id for each shingle, then one count for each id; both are aggregated before they are shuffled.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, parts, sizes = batch.column(0), [], []
        for _, _, data, offsets in slices(batch.column(1)):
            sets = shingle_sets(data, offsets, SHINGLE_WORDS)
            parts += sets
            sizes += map(len, sets)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        return pa.record_batch([ids.take(pa.array(rows)), pa.array(np.concatenate(parts).view(np.int64))], names=["id", "shingle"])

    rows = map_batches(texts.select("id", "text"), run, f"id {texts.schema['id'].dataType.simpleString()}, shingle long")
    lone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("id")).where("documents = 1")
    return lone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))


def centres_of(members: DataFrame, rounds: int) -> DataFrame:
    """The members that are centres of their buckets in a round: the lowest by a fixed place in [0, 1), all once the round's number reaches the size."""
    place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    return members.where(place * F.col("size") < float(FIRST * GROWTH ** (rounds - 1)))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    A null or wordless text has an empty set and is linked with nothing, not even with rows of its own key. A row with a
    null key is linked with nothing either, has a null component_id and is not kept. Other rows that share a key count as linked, so
    all that is linked with one of them is one group. Equal texts tie to the smallest key. Texts may have any length. An
    empty table gives no rows; other columns are ignored.
    """
    sig = written(signature_table(docs, key, text), "signatures")
    full = sig.where("n > 0 and id is not null")
    classes = full.groupBy("one", "two", "n").agg(F.min("id").alias("rep"))
    classes = written(classes, "classes")
    mine = full.join(classes, (full["id"] == classes["rep"]) & (full["one"] == classes["one"]) & (full["two"] == classes["two"]) & (full["n"] == classes["n"]), "left_semi")
    banded = mine.select("id", "n", F.explode("bands").alias("bucket")).distinct()
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
    members = written(banded.join(sizes.drop("size"), "bucket"), "buckets")
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(members.select("id").distinct(), "id", "left_semi")
    # Of rows that share an id any text will do where they are one set; others were never in question by that id alone.
    texts = written(texts, "texts")

    first = members.where("id <> least").groupBy("id").agg(F.min(F.col("least")).alias("a")).select("a", F.col("id").alias("b"))
    checked = written(first, "pairs")
    shared = full.join(written(full.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "shared"), "id", "left_semi")
    shared = shared.join(classes, ["one", "two", "n"]).where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirmed(checked, texts).unionByName(shared), "links")
    found = written(components(links), "components")
    open_ = written(_torn(members, found), "open")
    # The bounds are those of a set; an id that several sets share is never kept apart by them.
    several = written(mine.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("id"), "several")
    alone = shared_shingles(texts.join(open_.select("id").distinct(), "id", "left_semi")).join(several, "id", "left_anti")
    open_ = open_.join(alone, "id", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0))).where(100 * F.col("c") >= PER_CENT * F.col("n"))
    words = [f"w{i}" for i in range(SKETCH_BITS // 64)]
    sketch = mine.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("odd")).alias("odd")).select("id", *(F.col("odd")[i].alias(w) for i, w in enumerate(words)))
    sketches = written(mine.where("wide is not null").join(open_.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.max("n").alias("n"), F.first("wide").alias("wide")), "sketches")
    sketches = sketches.join(several.withColumn("_any", F.lit(True)), "id", "left").select("id", F.when(F.col("_any"), 0).otherwise(F.col("n")).alias("n"), "wide")
    members = written(open_.select("bucket", "id", "n", "c").join(sketch, "id"), "buckets")
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_"))) for w in words), F.lit(0))
    most = F.least("c", "d", F.floor((F.col("n") + F.col("m") - apart) / 2))
    possible = 100 * most >= PER_CENT * (F.col("n") + F.col("m") - most)
    rounds, open_ = 0, written(_torn(members, found), "open")
    while True:
        rounds += 1
        # A large bucket's members are dealt to parts, each of which meets all its centres.
        parts = F.ceil(F.col("size") / PART).cast("int")
        centres = centres_of(open_, rounds).select("bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("id").alias("centre"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("component").alias("other"), *(F.col(w).alias(f"{w}_") for w in words))
        ends = [F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m")]
        met = open_.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int")).join(centres, ["bucket", "part"]).where(possible & (F.col("component") != F.col("other")))
        met = written(met.select(*ends).distinct().join(checked, ["a", "b"], "left_anti"), "met")
        pairs = written(bounded(met, sketches), "pairs")
        checked = checked.unionByName(met.select("a", "b"))
        fresh = None if pairs.isEmpty() else written(confirmed(pairs, texts), "links")
        more = not open_.where(F.col("size") > float(FIRST * GROWTH ** (rounds - 1))).isEmpty()
        if fresh is not None:
            if not fresh.isEmpty():
                found = written(joined(found, fresh), "components")
                open_ = written(_torn(members, found), "open") if more else open_
        if not more:
            break
    rep = sig.select("id", "n", "one", "two").join(classes, ["one", "two", "n"], "left").select("id", "n", F.col("rep"))
    labelled = rep.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return labelled.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _torn(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that lie in more than one component, and the bucket's size."""
    placed = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    torn = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    return placed.join(torn.select("bucket", "size"), "bucket")


def op1_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_circulant_minhash": op1_circulant_minhash}
