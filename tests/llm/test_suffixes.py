import hashlib
import random

import numpy as np
import pytest
import xxhash

from tallybook.llm import suffixes as S
from tallybook.llm.textkit import slices

DOCS = "doc_id long, text string, lang string, pos int, h long, copy string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 3, 4, "x") for i, t in rows], DOCS)


def place(i, b):
    """Rows in the order of their keys, those that share one by a hash of the text."""
    return i, xxhash.xxh64(b, seed=42).intdigest() % 2**30


def brute(rows, length=S.LENGTH):
    """(id, text) to the digest, by a table of all strings."""
    first = {}
    for b, i in sorted({((t or "").encode(), i) for i, t in rows if i is not None}, key=lambda r: place(r[1], r[0])):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], (*place(i, b), k))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < (*place(i, b), k):
                gone[k : k + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i, t] = (i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return [out[r] for r in rows]


def check(spark, rows):
    got = S.removal_digest(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    text = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passages = [text(rnd.randint(15, 60)) for _ in range(8)]
    rows = []
    for i in rnd.sample(range(10000), n):
        parts = [text(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(passages)
            if rnd.random() < 0.5:
                a, b = sorted((rnd.randrange(len(p)), rnd.randrange(len(p))))
                p = p[a : b + 90]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(p))
                p = p[:k] + "Z" + p[k + 1 :]
            parts += [p, text(rnd.randint(0, 10))]
        rows.append((i, rnd.choice(["", " "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(20001, rows[0][1]), (20002, rows[0][1]), (20003, None), (20004, ""), (20005, "x" * 99), (20006, "x" * 100), (20007, "x" * 101), (20008, "ab" * 400), (20009, "x" * 5000 + rows[1][1])]
    check(spark, rows)


def test_many_contexts_by_hashes(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 3)
    check(spark, corpus(9))


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 50)
    check(spark, corpus(10))


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    monkeypatch.setattr(S, "PLACES", 3)
    monkeypatch.setattr(S, "slices", lambda column: slices(column, 500))
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefg ") for _ in range(n))
    shared = noise(1500)
    rows = [(1, noise(3000) + shared + noise(40)), (2, shared[200:] + noise(2500) + shared[:900]), (3, noise(699)), (4, noise(5000)), (5, shared[600:701]), (6, "x" * 4000)]
    check(spark, rows + corpus(4, 30))


def test_rows_that_share_a_key(spark):
    rnd = random.Random(8)
    noise = lambda n: "".join(rnd.choice("abcdefghij") for _ in range(n))
    passage, other = noise(150), noise(220)
    rows = [(7, passage), (7, "12" + passage), (7, passage + "1234567"), (7, passage), (8, other), (8, other), (3, other[20:]), (9, noise(90)), (9, None), (9, ""), (None, passage), (None, passage)]
    check(spark, rows + [(7, noise(30) + other)] * 3)
    check(spark, [(5, noise(40) + passage + noise(k)) for k in range(30)] + [(5, passage)] * 20)


def test_no_column_for_the_ranges(spark):
    df = frame(spark, [(1, "x" * 300)]).withColumnRenamed("copy", "spans")
    assert S.deduplicated(df, spans_name=None).columns == df.columns
    assert S.deduplicated(df, spans_name="gone").first().spans == "x"


def test_texts_without_broken_characters(spark):
    rnd = random.Random(6)
    p = "".join(chr(0xE0 + rnd.randrange(29)) for _ in range(80))  # no period: the text must not repeat itself
    rows = [(1, "a" + p + "1"), (2, "b" + p + "2")]
    out = {r.doc_id: r for r in S.deduplicated(frame(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text in ("b2", p[0] + "2", "b" + p[-1] + "2") and [(s.start, s.end) for s in out[2].spans] == [(1, 161)]


def test_odd_rows(spark):
    rnd = random.Random(7)
    long_ = "".join(chr(97 + rnd.randrange(23)) for _ in range(300))
    out = S.removal_digest(frame(spark, [(None, long_), (4, long_), (4, long_), (5, long_)])).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in out) == [(False, 0), (False, 0), (False, 300), (True, 0)]
    assert S.removal_digest(frame(spark, [])).count() == 0


def test_fixture_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
