import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallybook.llm import matroska as M
from tallybook.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, slot int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7) for i, t, s in rows], DOCS)


def test_matroska_round_trip_and_parser():
    for text in (b"", b"a", b"x" * 64, b"y" * 513, bytes(range(256)) * 1500):
        data = M.padded(text)
        assert len(data) % 64 == 0 and data and data[: len(text)] == text and len(data) - len(text) <= 64
        stored = M.mux(data)
        media = M.parse(stored)
        assert not media.error and b"".join(stored[o : o + n] for _, _, o, n, _ in media.packets) == data
        assert len(media.cues) == len(media.clusters)
        assert [at for _, _, at in media.cues] == media.clusters
        assert [ms for _, ms, *_ in media.packets] == [M.FRAME_MS * i for i in range(len(media.packets))]
        assert M.parse(stored[: len(stored) // 2]).error


def test_matroska_lacing_and_unknown_sizes():
    xiph = b"\x81\x00\x05\x82" + bytes([1, 255, 45]) + b"a" * 300 + b"bc"
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, xiph))
    cluster = (M.CLUSTER).to_bytes(4, "big") + b"\xff" + M.unsigned(M.TIMESTAMP, 100) + group
    file = M.header() + (M.SEGMENT).to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster * 1500
    media = M.parse(file)
    assert not media.error and len(media.packets) == 3000 and media.packets[0][:2] == (1, 105) and [p[3] for p in media.packets[:2]] == [300, 2]
    assert M.lace_sizes(b"\x02" + M.size_vint(500) + b"\xbf" + b"z" * 1200, 0, 4 + 1200, M.EBML_LACING)[0] == [500, 500, 200]


def test_matroska_times_and_keyframes():
    def file(entry, body):
        track = M.element(M.TRACK_ENTRY, M.unsigned(M.TRACK_NUMBER, 1) + entry)
        return M.header() + M.element(M.SEGMENT, M.element(M.TRACKS, track) + M.element(M.CLUSTER, M.unsigned(M.TIMESTAMP, 100) + body))

    laced = b"\x81\x00\x05" + bytes([0x04, 2]) + b"a" * 480  # fixed lacing, three frames of 160 bytes
    plain, after = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, laced)), M.element(M.BLOCK_GROUP, M.element(M.BLOCK, laced) + M.element(M.REFERENCE_BLOCK, b"\xff"))
    media = M.parse(file(M.unsigned(M.DEFAULT_DURATION, 20_000_000), plain + after))
    assert not media.error and [(p[1], p[4]) for p in media.packets] == [(t, k) for k in (True, False) for t in (105, 125, 145)]
    import struct

    audio = M.element(M.AUDIO, M.element(M.SAMPLING, struct.pack(">f", 4000.0)) + M.unsigned(M.CHANNELS, 2) + M.unsigned(M.BIT_DEPTH, 8))
    pcm = M.element(M.CODEC, b"A_PCM/INT/LIT") + audio
    assert [p[1] for p in M.parse(file(pcm, plain)).packets] == [105, 125, 145]  # 160 bytes are 80 samples of two channels
    assert [p[1] for p in M.parse(file(b"", plain)).packets] == [105, 105, 105]  # nothing says how long a frame is


def test_matroska_tables(spark):
    df = docs(spark, [(1, None, "a"), (2, "hé" * 400, "a"), (2, "hé" * 400, "a"), (None, "x", None)])
    rows = {(r.doc_id, r.n_bytes): r for r in M.media_digest(df).collect()}
    r = rows[2, 1200]
    data = M.padded(("hé" * 400).encode())
    assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(data))
    assert rows[1, 0].payload_bytes == 64 and (None, 1) in rows
    packets = M.packet_table(M.media_column(df)).where("doc_id = 2").orderBy("seq").collect()
    assert [p.n_bytes for p in packets] == [512, 512, 512, 512, 192, 192] and all(p.in_cues for p in packets)
    assert M.media_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{"a": 700, "b": 40, "c": 3, None: 15}, {"a": 1}, {"a": 64, "b": 64}])
def test_pfair_deviation(spark, counts):
    rows = [(i, "t", s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    out = mixing.pfair_mix(docs(spark, rows), block_rows=4).collect()
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
    slots = {}
    for r in out:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    assert len({r.position for r in out}) == len(out)
    parts = mixing.target_parts({str(s): n**mixing.TEMPERATURE for s, n in counts.items()})
    end = min(max(r.slot for r in out if r.source == s) for s in counts) + 1
    for t in range(1, end + 1):
        for s in counts:
            share = parts[str(s)] / sum(parts.values()) * t
            assert abs(sum(slots[u][0] == s for u in range(t)) - share) < 1
    assert any(r.in_mix for r in out)


def test_pfair_follows_the_true_targets():
    from fractions import Fraction

    targets = {"hot": 0.70055, "warm": 0.29935, "tiny": 0.0001}
    true = {k: Fraction(w) / sum(map(Fraction, targets.values())) for k, w in targets.items()}
    taken = dict.fromkeys(targets, 0)
    rows = list(mixing.schedule({"hot": 30000, "warm": 30000, "tiny": 30000}, mixing.target_parts(targets)))
    for t, (name, block, slot, release, deadline, phase, _) in enumerate(rows[:30000], 1):
        assert (block, slot, phase) == (taken[name], t - 1, 0)
        taken[name] += 1
        assert release == block / true[name] // 1 and deadline == -(-(block + 1) / true[name] // 1)
        assert all(abs(n - true[k] * t) < 1 for k, n in taken.items())
    assert sorted(r[:2] for r in rows) == sorted((k, b) for k in targets for b in range(30000))


@pytest.mark.parametrize("seed", range(6))
def test_pfair_against_a_plain_simulation(seed):
    import random
    from fractions import Fraction

    rnd = random.Random(seed)
    parts = {f"s{i}": rnd.randint(1, 40) for i in range(rnd.randint(1, 7))}
    blocks = {k: rnd.randint(1, 60) for k in parts}
    left, used, want, start, phase = dict(blocks), dict.fromkeys(parts, 0), [], 0, 0
    while left:
        weight = {k: Fraction(parts[k], sum(parts[j] for j in left)) for k in left}
        done, t = dict.fromkeys(left, 0), 0
        while all(done[k] < n for k, n in left.items()):
            ready = [(-(-(done[k] + 1) // weight[k]), k) for k in left if done[k] / weight[k] // 1 <= t]
            due, k = min(ready)
            want.append((k, used[k] + done[k], start + t, start + done[k] / weight[k] // 1, start + due, phase))
            done[k], t = done[k] + 1, t + 1
        used = {k: n + done.get(k, 0) for k, n in used.items()}
        left = {k: n - done[k] for k, n in left.items() if n > done[k]}
        start, phase = start + t, phase + 1
    assert [r[:6] for r in mixing.schedule(blocks, parts)] == want


def test_pfair_odd_rows_and_bounded_blocks(spark, monkeypatch):
    rows = [(None, f"t{i}", "a") for i in range(40)] + [(7, "same", "b")] * 30 + [(7, f"u{i}", "b") for i in range(30)] + [(8, "x" * 300_000, None)]
    df = docs(spark, rows).withColumn("_name", F.lit("clash")).withColumn("position", F.lit(-1)).withColumn("_row", F.lit(0))
    got = mixing.pfair_mix(df.withColumn("_at", F.monotonically_increasing_id()), carry=["_at"]).collect()
    assert sorted(r.source or "" for r in got) == sorted(s or "" for *_, s in rows) and len({r.position for r in got}) == len({r._at for r in got}) == len(rows)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 5)
    assert mixing.pfair_mix(df).select("slot").distinct().count() <= 5 + 3


def test_pfair_schedule_in_pieces(spark, monkeypatch):
    df = docs(spark, [(i, "t", "abc"[i % 3]) for i in range(60)])
    read = lambda: sorted(map(tuple, mixing.pfair_mix(df, {"a": 2, "b": 1}, block_rows=2).collect()))
    whole = read()
    monkeypatch.setattr(mixing, "PIECE", 7)
    assert read() == whole and len(whole) == 60


def test_pfair_targets_and_empty(spark):
    df = docs(spark, [(i, "t", "ab"[i % 2]) for i in range(40)] + [(99, None, "z")])
    out = mixing.pfair_mix(df, {"a": 3, "b": 1, "missing": 5}, block_rows=2)
    head = [r.source for r in out.where("slot < 12").orderBy("position").collect()]
    assert head.count("a") == 18 and not out.where("source = 'z'").first().in_mix
    assert mixing.pfair_mix(df.limit(0)).count() == 0


def test_sharding_limits(spark):
    df = docs(spark, [(i, "x" * (50 + i % 7), "s") for i in range(300)] + [(7, "x" * 90, "s")] * 40 + [(1000, "y" * 5000, "s"), (1001, None, "s"), (None, "q", "s")])
    out = sharding.extendible_shards(df, 1000).cache()
    assert out.count() == 343
    sizes = df.groupBy().agg(F.sum(F.octet_length("text"))).first()[0]
    shards = out.groupBy("shard", "depth", "shard_bytes").count().collect()
    assert sum(r.shard_bytes for r in shards) == sizes
    names = sorted(r.shard for r in shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert [r["count"] for r in shards if r.shard_bytes > 1000] == [1]
    assert sharding.extendible_shards(df, 10**9).select("shard").distinct().collect() == [("",)]
    assert sharding.extendible_shards(df.limit(0), 10).count() == 0


def test_sharding_many_rows_of_one_hash(spark):
    """Rows without a key and rows of one key split by their numbers; no window gathers them."""
    df = spark.range(100_000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "repeat('x', cast(id % 9 as int)) as text", "-1 as _number", "'c' as _bits")
    out = sharding.extendible_shards(df, 20_000)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    out = out.cache()
    sizes = out.groupBy("shard").agg(F.max("shard_bytes").alias("b")).collect()
    assert out.count() == 100_000 and all(r.b <= 20_000 for r in sizes) and sum(r.b for r in sizes) == df.agg(F.sum(F.octet_length("text"))).first()[0]
    assert out.where("doc_id is null").select("shard").distinct().count() > 5
    names = sorted(r.shard for r in sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
