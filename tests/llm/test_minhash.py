import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import minhash
from tallybook.llm.graph import components, joined
from tallybook.llm.textkit import shingle_sets, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1) for i, t in rows], DOCS)


def brute(rows):
    """Shingle sets as tuples of words, all pairs, union-find."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    owners = {}
    for i in ids:
        near = {}
        for s in sets[i]:
            for j in owners.setdefault(s, []):
                near[j] = near.get(j, 0) + 1
            owners[s].append(i)
        for j, common in near.items():
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def check(spark, rows):
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert len(out) == len(rows) and got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return got


@pytest.mark.parametrize("words", range(8))
def test_slices_of_few_words(words):
    text = " ".join("abcdefgh"[:words])
    alone = [x.tolist() for *_, d, o in slices(pa.array([text])) for x in shingle_sets(d, o)]
    among = [x.tolist() for *_, d, o in slices(pa.array(["q r s t u v w", text, None, "", text])) for x in shingle_sets(d, o)]
    assert alone == [among[1]] == [among[4]] and among[2] == among[3] == [] and len(alone[0]) == max(min(words, 1), words - 4)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(20, 120))] for _ in range(25)]
    rows = []
    for i in range(300):
        words = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((i, rnd.choice([" ", "\n", "\t\v "]).join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one two"), (1004, "ONE  two"), (1005, "one two three"), (1006, rows[0][1]), (1007, rows[0][1].upper())]
    rows += [(1008, "long " * 50000 + "tail"), (1009, "long " * 40000 + "tail"), (1010, "É é"), (1011, "é é")]
    check(spark, rows)


def test_chain_of_near_copies(spark):
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(40):  # each copy moves on by a few words: neighbours are linked, the ends are far apart
        rows.append((100 - i, " ".join(words[k + 4 * i] if k + 4 * i < 200 else f"x{k + 4 * i}" for k in range(160))))
    assert len({c for _, c in check(spark, rows).values()}) == 1


def test_group_that_shares_a_bucket_without_links(spark):
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}_{k}" for k in range(45)])) for i in range(60)]
    assert len({c for _, c in check(spark, rows).values()}) == 60


def test_rows_that_share_a_key_are_linked(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(3, two), (5, one), (5, two), (5, ""), (8, three), (9, one + " x"), (2, three), (2, three), (None, one)]
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in out)
    assert got == sorted([("3", 26, "3", True), ("5", 26, "3", False), ("5", 26, "3", False), ("5", 0, "5", True), ("8", 26, "2", False), ("9", 27, "3", False), ("2", 26, "2", True), ("2", 26, "2", True), ("None", 26, "None", False)])


def test_hot_centres_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    words = [f"t{i}" for i in range(60)]
    check(spark, [(i, " ".join(words[:30] + [f"u{i}"] + words[31:])) for i in range(70)] + [(100 + i, f"x{i} y z a b c") for i in range(20)])


def test_hot_ends_on_both_sides_are_dealt(spark, monkeypatch):
    """One document is the b of very many pairs, another the a of many; no task gets all pairs of either."""
    monkeypatch.setattr(minhash, "CHUNK", 64)
    rows = spark.range(6000).selectExpr("id", "concat('v', id) as value")
    pairs = spark.range(5000).selectExpr("id as a", "5999L as b").unionByName(spark.range(1, 1000).selectExpr("0L as a", "id as b")).distinct()
    out = minhash.with_both(pairs, rows, pairs.count())
    assert out.where("value_a = concat('v', a) and value_b = concat('v', b)").count() == out.count() == pairs.count() == out.select("a", "b").distinct().count()
    keys = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in line or "Exchange hashpartitioning" in line]
    assert any("part_b" in k for k in keys) and any("part_a" in k for k in keys)


def test_long_texts_that_share_buckets_are_kept_apart_without_their_texts(spark, monkeypatch):
    """Similarity 0.33 in 4,000 words: nearly all pairs share a bucket, and hardly any of them is compared by its texts."""
    checked = []
    real = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, texts: (checked.append(pairs.count()), real(pairs, texts))[1])
    common = [f"c{i}" for i in range(2000)]
    rows = [(i, " ".join(common + [f"u{i}_{k}" for k in range(2000)])) for i in range(80)]
    rows += [(200, rows[3][1] + " more words at the end of it"), (201, " ".join(common[:600])), (202, " ".join(common[:500]))]
    check(spark, rows)
    assert sum(checked) < 83 * 82 / 2 / 10


def test_wide_sketches_bound_differences():
    rng = np.random.default_rng(4)
    for n, m in ((600, 600), (600, 5000), (4000, 4100)):
        common = rng.integers(0, 1 << 63, n // 2, np.uint64)
        s, t = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, k - n // 2, np.uint64)])) for k in (n, m))
        a, b = minhash.wide_sketch(s), minhash.wide_sketch(t)
        size = min(len(a), len(b))
        apart = int(np.bitwise_count((minhash.folded(a, size) ^ minhash.folded(b, size)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(s, t)) and (n != m or apart > 0.5 * len(np.setxor1d(s, t)))
        assert (minhash.folded(a, size) == minhash.odd_sketch(s, size * 64)).all()
    assert minhash.wide_sketch(s[: minhash.WIDE]) is None


def test_an_id_of_several_long_sets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "WIDE", 8)
    one, two = ([f"{w}{i}" for i in range(60)] for w in "ab")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join(one[:55])), (3, " ".join(two[:56])), (4, " ".join(f"z{i}" for i in range(50)))]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert out == {1: 1, 2: 1, 3: 1, 4: 4}


def test_large_buckets_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 16)
    words = [f"t{i}" for i in range(60)]
    check(spark, [(i, " ".join(words[:30] + [f"u{i}"] + words[31:])) for i in range(70)] + [(100 + i, " ".join(words[:20] + [f"y{i}_{k}" for k in range(12)])) for i in range(60)])


def test_empty_null_keys_and_repeats(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    out = minhash.near_duplicates(frame(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in out) == [(False, 2, True), (False, 2, True), (True, None, False)]


@pytest.mark.parametrize("n", [1, 2, 9, 64])
def test_components(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 500), (700, 701), (701, 700)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {700: 700, 701: 700}


def test_fixture_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_new_links_join_found_components(spark, seed):
    """Links in two deliveries give the components of all of them; the second has known, new and repeated ends, or is empty."""
    rng = random.Random(seed)
    draw = lambda n: [(rng.randrange(40), rng.randrange(40)) for _ in range(n)]
    first, second = draw(14), draw(14) if seed else []
    link = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = {(r.id, r.component) for r in joined(components(link(first)), link(second)).collect()}
    assert got == {(r.id, r.component) for r in components(link(first + second)).collect()}


def test_few_centres_at_first_and_every_member_at_last(spark):
    members = spark.range(1000).selectExpr("id", "1 as bucket", "1000 as size")
    counts = [minhash.centres_of(members, r).count() for r in (1, 2, 3)]
    assert 1 <= counts[0] < 10 < counts[1] < 100 and counts[2] == 1000
