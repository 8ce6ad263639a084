import random
import zlib
from collections import Counter

from tallybook.llm import spelling as S


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(counts):
    """The definition by comparing all pairs."""
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        top = min(near, key=lambda v: (-counts[v], v), default=None)
        form = top if top is not None and counts[top] >= 5 * n else None
        rows[w] = (n, len(near), form, counts[form] if form else None)
    out = set()
    for w, (n, k, form, top) in rows.items():
        root = w
        while rows[root][2]:
            root = rows[root][2]
        out.add((w, form, root, n, k, top))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def variants(words, rnd, letters="abeé"):
    out = set(words)
    for w in words:
        for _ in range(6):
            i, kind = rnd.randrange(len(w) + 1), rnd.randrange(3)
            out.add(w[:i] + rnd.choice(letters) * (kind > 0) + w[i + (kind < 2) :])
    return sorted(w for w in out if len(w) >= 6)


def test_neighbours_against_all_pairs(spark):
    rnd = random.Random(4)
    words = variants(["".join(rnd.choice("abeé") for _ in range(rnd.randrange(6, 10))) for _ in range(60)], rnd)
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "ÿaaaaaa", "Àbcdef".lower(), "×÷×÷×÷"]
    counts = {w: rnd.choice([5, 6, 25, 30, 150, 800, 4000]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert got(S.variant_forms(df)) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and len({r[4] for r in want}) > 4


def test_long_words(spark, monkeypatch):
    monkeypatch.setattr(S, "TRIE_LETTERS", 9)
    rnd = random.Random(8)
    words = variants(["".join(rnd.choice("abc") for _ in range(rnd.randrange(7, 13))) for _ in range(60)], rnd, "abc")
    counts = {w: rnd.choice([5, 25, 150, 800]) for w in words}
    assert got(S.variant_forms(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_very_long_words(spark):
    w = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    counts = {w: 100, w[:-1]: 5, "x" + w: 7, w[:2000] + "z" + w[2001:]: 9, w[:70]: 6, w[:71]: 40, w[:64]: 5, w[:63]: 25}
    assert got(S.variant_forms(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_whole_texts(spark):
    import re

    rnd = random.Random(2)
    stems = ["letter", "Ölfarbe", "straßen", "LETTERS", "worden", "kleiner", "naïveté"]
    rows = [(i if i % 9 else None, " ".join(rnd.choice(stems) + rnd.choice(["", "", "s", "-x", "2", "É"]) for _ in range(40))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a" * 400_000 + " ab cd"), (503, "letter"), (503, "letter"), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = S.spelling_variants(docs)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got(out) == brute(counts)
    assert S.spelling_variants(docs.limit(0)).count() == 0
    assert S.spelling_variants(docs.where("doc_id = 501")).count() == 0
