import random
import re

import pytest

from tallybook.llm import licenses as L

DOCS = "doc_id long, text string, lang string, label string, template int, _words string, n_words long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 7, "clash", -1) for i, t in rows], DOCS)


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def brute(text, phrases=L.PHRASES, notices=L.NOTICES):
    """The definition by plain loops: every place is compared with every template word by word."""
    w, base, labels, score = words(text), [], set(), 0.0
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                base.append((i, label))
    for notice, label in notices:
        t = words(notice)
        k = 2 if len(t) < 12 else 4
        grams = len(t) - k + 1
        hits = sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in range(grams) if w[i : i + k] == t[j : j + k])
        groups = []
        for h in hits:
            if not groups or h[0] - groups[-1][-1][0] > 6:
                groups.append([])
            groups[-1].append(h)
        for g in groups:
            covered, wide = len({j for *_, j in g}), max(i for _, i, _ in g) - min(i for _, i, _ in g) + 1
            if covered * 100 >= 60 * grams and covered * 2 >= wide:
                labels.add(label)
                score = max(score, covered / grams)
    starts = [i for i, _ in base]
    both = labels | {b for _, b in base}
    first = lambda f: f(starts) if starts else None
    return (len(w), len(base), first(min), first(max), ",".join(sorted({b for _, b in base})), ",".join(sorted(both)), 1.0 if base else score)


def check(spark, rows):
    out = L.license_scan(docs(spark, rows)).collect()
    got = sorted((str(r[0]), *map(str, r[1:7]), round(r[7], 9)) for r in out)
    assert got == sorted((str(i), *map(str, b[:6]), round(b[6], 9)) for i, b in ((i, brute(t)) for i, t in rows))
    return out


def test_places_of_phrases(spark):
    rows = [(1, "MIT License mit-license. MIT\x00LICENSE"), (2, "gnu general public gnu general public license"), (3, "CC BY-NC cc  by cc bye ccby"), (4, "apache licenses apache license"), (5, "mit lİcense Kapache license"), (6, "mit license cc by")]
    out = {r.doc_id: r for r in check(spark, rows)}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (3, 0, 4, "mit")
    assert (out[2].n_base, out[2].first_word) == (1, 3) and out[6].base_labels == "cc-by,mit"


def test_notices_with_edits(spark):
    rnd, rows = random.Random(5), []
    for n, (notice, _) in enumerate(L.NOTICES):
        for edits in range(0, 9, 2):
            w = words(notice)
            for _ in range(edits):
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([[], ["other"], [w[i], "more"]])
            around = [rnd.choice("of the in to a software license and".split()) for _ in range(30)]
            rows.append((n * 10 + edits, " ".join(around[:15] + w + around[15:])))
    out = check(spark, rows)
    assert all(r.labels for r in out if r.doc_id % 10 == 0)
    spans = L.license_spans(docs(spark, rows)).where("found and not exact").collect()
    assert {r.first_word for r in spans if r.doc_id % 10 == 0 and r.score == 1.0} == {15}


def test_repeated_templates_and_common_words(spark):
    text = " ".join(L.NOTICES[-1][0] for _ in range(40)) + " of the software" * 300
    out = check(spark, [(1, text), (2, "cc by " * 500), (3, "the " * 2000)])
    assert {r.doc_id: r.n_base for r in out} == {1: 0, 2: 500, 3: 0}


def test_odd_rows(spark):
    rows = [(None, None), (None, "mit license"), (None, "mit license"), (None, "mit license"), (4, ""), (5, " \n!"), (6, "mit"), (7, "été " * 50_000 + "mit license"), (7, "mit license"), (7, "cc by")]
    check(spark, rows)
    check(spark, rows * 3)
    assert L.license_scan(docs(spark, rows).limit(0)).count() == 0
    same = docs(spark, [(1, "mit license")] * 50).coalesce(1)
    assert [tuple(r)[1:3] for r in L.license_scan(same).collect()] == [(2, 1)] * 50


def test_own_templates(spark):
    rows = [(1, "some house rule here"), (2, "house rule"), (3, "no")]
    out = {r.doc_id: r for r in L.license_scan(docs(spark, rows), [("house rule", "o'house")], []).collect()}
    assert [out[i].labels for i in (1, 2, 3)] == ["o'house", "o'house", ""] and out[1].first_word == 1
    assert L.license_scan(docs(spark, rows), [], []).where("labels = '' and score = 0").count() == 3
    with pytest.raises(ValueError):
        L.license_scan(docs(spark, rows), [("one", "x")], [])


def test_plan_has_no_python(spark):
    plan = L.license_scan(docs(spark, [(1, "a")]).select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
