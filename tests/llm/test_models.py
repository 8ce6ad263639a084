import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import language, neighbours, quality, toxicity
from tallybook.llm.labelled import held_out
from tallybook.llm.textkit import slices, words

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, score double, id int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0.5, 3, 1) for i, t, lang in rows], DOCS)


def test_folds(spark):
    import zlib

    got = {r.i: r.h for r in spark.range(50).withColumnRenamed("id", "i").select("i", held_out(F.col("i"), 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


# Toxicity


def brute_segments(steps):
    """Ruzzo-Tompa by definition: the best segment (shortest, leftmost of equals), then both sides of it."""
    best = None
    for a in range(len(steps)):
        for b in range(a + 1, len(steps) + 1):
            s = sum(steps[a:b])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, s = best
    return [*brute_segments(steps[:a]), best, *((x + b, y + b, t) for x, y, t in brute_segments(steps[b:]))]


def test_maximal_segments():
    rnd = random.Random(4)
    for _ in range(400):
        steps = [rnd.choice([-5, -3, -2, -1.25, 1, 2.5, 3.125, 4]) + rnd.randint(0, 1000) / 2**20 for _ in range(rnd.randint(0, 14))]
        got = sorted(toxicity.maximal_segments(steps))
        want = sorted(brute_segments(steps))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_decay_rate():
    r = toxicity.decay_rate(np.array([1.0, -1.0]), np.array([0.2, 0.8]))
    assert abs(r - np.log(4)) < 1e-6


@pytest.fixture(scope="module")
def held(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return {c: {r.doc_id: r[c] for r in labels.select("doc_id", c).collect()} for c in ("quality", "toxic")}


def test_toxicity_on_held_out_rows(spark, held):
    rows = [r for r in toxicity.op8_toxic_segments(spark, SF).collect() if r.held_out and r.doc_id in held["toxic"]]
    right = {y: np.mean([r.predicted == y for r in rows if held["toxic"][r.doc_id] == y]) for y in (0, 1)}
    assert right[1] > 0.8 and right[0] > 0.96
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxic_scores_against_plain_python(spark):
    rnd = random.Random(12)
    bad, plain = "vile rotten scum filth".split(), [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows = []
    for i in range(160):
        words_ = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        if i % 2:
            at = rnd.randrange(len(words_))
            words_[at:at] = [rnd.choice(bad) for _ in range(rnd.randint(3, 8))]
        rows.append((i, " ".join(words_).title() + rnd.choice(["", "!", " 12"]), "en"))
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int"))
    assert len(model.tokens)
    token = lambda w: int(words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[2][0])
    weight = dict(zip(model.tokens.tolist(), model.weights.tolist()))
    for r in toxicity.evidence_table(docs, model).collect():
        found = re.findall("[a-z]+", rows[r.doc_id][1].lower())
        assert r.n_tokens == len(found)
        steps = [weight.get(token(w), 0.0) - model.drift for w in found]
        logs = [model.log_k + np.log(len(found)) - model.rate * s for *_, s in brute_segments(steps)]
        evidence = -sum(x for x in logs if x < np.log(toxicity.MOST_E))
        assert abs(r.evidence - evidence) < 1e-6 and abs(r.score - 1 / (1 + np.exp(-model.slope * (evidence - model.cut)))) < 1e-6


def test_toxic_passages_and_odd_texts(spark):
    bad = ["vile rotten scum words"] * 12
    rows = [(i, f"plain text number {i} about fields and rivers {'and ' + bad[i % 12] if i % 2 else ''} end", "en") for i in range(60)]
    docs = frame(spark, rows + [(100, None, "en"), (101, "", None), (102, "...", None), (103, "plain words " * 3000, None), (103, "rivers", None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.evidence_table(docs, model).collect()}
    assert len(out) == 64 and all(out[i].predicted == i % 2 for i in range(4, 60))
    text = rows[5][1].encode()
    assert b"scum" in text[out[5].passages[0].start : out[5].passages[0].end]
    assert out[100].evidence == 0 and out[100].predicted == 0 and out[102].n_tokens == 0
    assert toxicity.evidence_table(docs.limit(0), model).count() == 0
    assert toxicity.evidence_table(docs, toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


# Quality


def test_quality_on_held_out_rows(spark, held):
    rows = [r for r in quality.op9_bradley_terry_quality(spark, SF).collect() if r.held_out and r.doc_id in held["quality"]]
    right = {y: np.mean([r.predicted == y for r in rows if held["quality"][r.doc_id] == y]) for y in (0, 1)}
    assert right[0] > 0.9 and right[1] > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_quality_features_do_not_depend_on_slices():
    texts = pa.array(["", None, "One two.\nOne two.", "ÀB é!", "x" * 3000, "A | b | c", "  "])
    whole = np.vstack([quality.features(d, o) for *_, d, o in slices(texts)])
    each = np.vstack([quality.features(d, o) for i in range(len(texts)) for *_, d, o in slices(texts.slice(i, 1))])
    assert np.allclose(whole, each) and np.isfinite(whole).all()


def plain_features(text):
    """The features of one text, by definition."""
    data = (text or "").encode()
    n, size = len(data), max(len(data), 1)
    found = re.findall(rb"[^\x20\x09-\x0D]+", data)
    share = lambda kinds: sum(c in kinds for c in data) / size
    upper, letters, symbols = range(65, 91), {*range(65, 91), *range(97, 123), *range(128, 256)}, set(b"#$%&*+<=>@\\^_`{}~[]()/\"-'")
    many = max(len(found), 1)
    inside = lambda w, kinds: sum(c in kinds for c in w)
    flags = [lambda w: w[0] in upper, lambda w: inside(w, upper) > 1 and 2 * inside(w, upper) > inside(w, letters), lambda w: inside(w, symbols | set(b"!|")) > 0, lambda w: len(w) <= 3, lambda w: len(w) >= 14]
    distinct = lambda items: len(set(items)) / len(items) if len(items) > 1 else 1.0
    lowered = [bytes(c | 32 if c in upper else c for c in w) for w in found]
    lines = [bytes(c | 32 if c in upper else c for c in x) for x in data.split(b"\n") if x]
    return [
        np.log1p(n), np.log1p(len(found)), share(upper), share(b"0123456789"), share(b" \t\n\v\f\r"), share(range(128, 256)), share(b".,;:?"), share(b"!"), share(symbols), share(b"|"),
        sum(map(len, found)) / many, len(lines) / many, distinct(lowered) * np.log1p(len(found)), distinct(list(zip(lowered, lowered[1:], lowered[2:]))), distinct(lines), *(sum(map(f, found)) / many for f in flags),
    ]


def test_quality_features_against_plain_python(spark):
    rnd = random.Random(3)
    texts = ["", None, "a a a a", "a a b", "a b", "One two.\nOne two.\n\nONE", "ÀB é! $5 | x", "x" * 3000, "  ", "a a a a a a"]
    texts += [rnd.choice([" ", "\n"]).join(rnd.choice(["a", "B", "ab|", "LOUD!", "q-r", "verylongwordindeed"]) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    whole = np.vstack([quality.features(d, o) for *_, d, o in slices(pa.array(texts))])
    assert np.allclose(whole, [plain_features(t) for t in texts])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(len(texts))], "doc_id long, quality int")
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)])
    model = quality.train(docs, labels)
    want = {i: float(model.score(np.array([plain_features(t)]))[0]) for i, t in enumerate(texts)}
    for parts in (1, 7):
        assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in quality.scored(docs.repartition(parts), model).collect())


def test_quality_long_and_repeated_rows(spark):
    rows = [(i, f"plain text number {i} about fields" if i % 2 else "BUY!!! $$$ " * (1 + i % 5), "en") for i in range(40)]
    rows += [(100, "plain words about fields and rivers. " * 40000, "en"), (3, rows[3][1], "en"), (3, "another text", "en"), (None, "plain text", "en")]
    docs = frame(spark, rows)
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int"))
    out = quality.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 3}) == 2 and sum(r.doc_id is None for r in out) == 1


def test_quality_without_labels_keeps_everything(spark):
    docs = frame(spark, [(1, "a b", "en"), (2, None, None)])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.predicted for r in quality.scored(docs, model).collect()] == [1, 1]
    assert quality.accepted(docs, model).count() == 2 and quality.accepted(docs.limit(0), model).count() == 0


# Language


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.op2_centroid_language(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_texts(spark):
    rows = [(i, "the river and the thing " * (1 + i % 3), "en") if i % 2 else (i, "der fluß und die sache " * 2, "de") for i in range(40)]
    docs = frame(spark, rows + [(100, None, "en"), (101, "123 ...", None), (102, "é", None), (103, "", None), (104, "the thing", None), (104, "the thing", None)])
    model = language.train(docs)
    out = {r.doc_id: r for r in language.identified(docs, model).collect()}
    assert [out[i].lang_pred for i in (100, 101, 103, 104, 0)] == ["und", "und", "und", "en", "de"]
    assert out[102].lang_pred in ("en", "de") and out[101].score == 0 and out[101].rejected
    assert language.identified(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in language.identified(docs, language.train(docs.limit(0))).collect()} == {"und"}
    long_ = language.identified(frame(spark, [(1, "the river and the thing " * 60000, None), (2, "x" * 900_000, None)]), model).collect()
    assert [r.lang_pred for r in sorted(long_)][0] == "en" and all(0 <= r.score <= 1 for r in long_)


def plain_trigrams(text):
    """Counts of the hashed trigrams of one text, by definition."""
    kinds = [c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else c if c >= 128 else 32 for c in text.encode()]
    counts = {}
    for a, b, c in zip(kinds, kinds[1:], kinds[2:]):
        if (a, b, c) != (32, 32, 32):
            place = ((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 21
            counts[place] = counts.get(place, 0) + 1
    return counts


def test_language_against_plain_tf_idf(spark):
    rnd = random.Random(8)
    words = {"en": "the of and river thing house Water".split(), "de": "der die und fluß sache Haus wässer".split()}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(1, 30))), lang if i % 9 else None) for i in range(120) for lang in (("en", "de")[i % 2],)]
    docs = frame(spark, rows)
    model = language.train(docs)
    grams = {i: plain_trigrams(t) for i, t, _ in rows}
    found = {}
    for g in grams.values():
        for p in g:
            found[p] = found.get(p, 0) + 1
    idf = [np.log((1 + len(rows)) / (1 + found.get(p, 0))) + 1 for p in range(language.DIMENSIONS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    for r in language.identified(docs, model).collect():
        v = {p: np.log(1 + n) * idf[p] for p, n in grams[r.doc_id].items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        cosines = [sum(x * float(centre[p]) for p, x in v.items()) / norm if norm else 0.0 for centre in model.matrix]
        best = max(cosines)
        assert abs(r.score - max(0, min(1, best))) < 1e-4
        assert r.lang_pred in {model.languages[i] for i, c in enumerate(cosines) if c > best - 1e-4}


def test_language_model_does_not_depend_on_held_out_texts_or_partitions(spark, tmp_path):
    rows = [(i, ("the river and thing number " if i % 2 else "der fluß und die sache ") + "ab" * (i % 7), "en" if i % 2 else "de", "s", i) for i in range(90)]
    out = []
    for name, change, parts in (("a", False, 1), ("b", True, 5)):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if change:
            df = df.withColumn("text", F.when(held_out(F.col("doc_id"), 3, 1), "zzz qqq xxx").otherwise(F.col("text")))
        df.repartition(parts).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = language.op2_centroid_language(spark, str(tmp_path / name)).where("not held_out").collect()
        out.append(sorted((r.doc_id, r.lang_pred, round(r.score, 6), r.rejected) for r in got))
    assert out[0] == out[1] and len(out[0]) > 50


def test_trigrams_stay_inside_rows():
    texts = pa.array(["abc", "de", "", "fgh ij"])
    whole = np.vstack([language.trigram_counts(d, o) for *_, d, o in slices(texts)])
    each = np.vstack([language.trigram_counts(d, o) for i in range(4) for *_, d, o in slices(texts.slice(i, 1))])
    assert (whole == each).all() and whole.sum(axis=1).tolist() == [1, 0, 0, 4]


# Neighbours


def brute(x, ids, queries, k=5):
    norm = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        i = ids.index(q)
        s = (x @ x[i]) / norm / norm[i]
        out[q] = [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[j], 12), ids[j]))[:k]]
    return out


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = brute(x, list(range(3000)), range(0, 3000, 50))
    assert len(rows) == 300 and sum(r.vec_id in want[r.query_id] for r in rows) / 300 >= 0.9
    for r in rows:
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_recall_with_many_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 10)
    x = np.random.default_rng(4).normal(size=(6000, 32)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, df.where("vec_id % 50 = 0")).collect()
    want = brute(x, list(range(6000)), range(0, 6000, 50))
    assert len(rows) == 600 and sum(r.vec_id in want[r.query_id] for r in rows) / 600 >= 0.9


def test_easy_queries_read_fewer_lists():
    """The fitted ratio reads different numbers of lists for different queries, and holds the recall it was fitted for on others, too."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(60, 12)) * 3
    make = lambda n: neighbours.normalised(np.vstack([middle[rng.integers(0, 60, n // 2)] + rng.normal(size=(n // 2, 12)) * 0.3, rng.normal(size=(n - n // 2, 12))]))
    x, q, other = make(6000), make(200), make(200)
    graph = neighbours.CentroidGraph(neighbours.balanced_centroids(x[:3000], 120))
    row, list_ = graph.lists(x, neighbours.REPLICAS, neighbours.BOUNDARY, True)
    lists = {}
    for r, i in zip(row.tolist(), list_.tolist()):
        lists.setdefault(r, []).append(i)
    near = lambda q: [(i, lists[j]) for i, v in enumerate(q @ x.T) for j in np.argsort(-v)[:5].tolist()]
    most, ratio = neighbours.probes_needed(graph, q, near(q))
    r, at = graph.lists(other, most, ratio, False)
    read = {i: set(at[r == i].tolist()) for i in range(200)}
    sizes = sorted(map(len, read.values()))
    assert sizes[20] * 3 <= sizes[180] <= most < 120
    assert np.mean([bool(read[i] & set(ls)) for i, ls in near(other)]) >= 0.92
    assert neighbours.probes_needed(graph, q, [])[0] == len(graph.c)


def test_copies_ties_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(0, 20)] + [(50, [2.0, 4.0]), (51, [0.0, 0.0]), (52, None), (53, [1.0, None]), (54, [nan, 1.0]), (55, [inf, 1.0]), (56, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (57, []), (100, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, list int")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0 or vec_id in (51, 56)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(got) == [0, 50, 100]
    assert got[0] == [(i + 1, v) for i, v in enumerate([1, 2, 3, 4, 5])] and [v for _, v in got[50]] == [0, 1, 2, 3, 4]
    few = df.where("vec_id in (0, 100, 51)")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(few, few).orderBy("query_id").collect()] == [(0, 100), (100, 0)]
    assert neighbours.nearest(df.limit(0), df).count() == 0


def test_queries_with_short_lists_read_all(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 3), ("PROBES", 1), ("CHECKED", 1), ("RECALL", 0.0), ("REPLICAS", 1)):
        monkeypatch.setattr(neighbours, name, value)
    x = np.random.default_rng(9).normal(size=(120, 6)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, df.where("vec_id % 10 = 0")).collect()
    assert len(rows) == 60 and len({(r.query_id, r.rank) for r in rows}) == 60


@pytest.mark.parametrize("n", [1, 2, 5, 17, 60])
def test_graph_reaches_every_centroid(n):
    c = neighbours.normalised(np.random.default_rng(n).normal(size=(n, 8)))
    ids, _ = neighbours.CentroidGraph(c).search(c[:3], n)
    assert all(sorted(r) == list(range(n)) for r in ids.tolist())


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(5)
    c = neighbours.normalised(rng.normal(size=(2000, 24)))
    graph = neighbours.CentroidGraph(c)
    x = neighbours.normalised(rng.normal(size=(100, 24)))
    ids, s = graph.search(x, 32)
    want = np.argsort(-(x @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids[:, :32].tolist(), want.tolist())]) > 0.9
    assert (np.diff(s, axis=1) <= 1e-6).all()


def test_quality_is_fitted_on_every_labelled_row(spark, monkeypatch):
    from tallybook.llm import quality as Q

    docs = frame(spark, [(i, "BUY $$$ now !!! " * (1 + i % 4) if i % 9 == 0 else f"plain words number {i} about fields", "en") for i in range(7000)])
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(7000)], "doc_id long, quality int")
    seen, fit = [], Q.fit
    monkeypatch.setattr(Q, "fit", lambda rows, *a: (seen.append(rows.count()), fit(rows, *a))[1])
    Q.train(docs, labels)
    assert seen == [7000]


def test_quality_threshold_is_the_exact_quantile(spark, monkeypatch):
    from tallybook.llm import quality as Q

    rnd = np.random.default_rng(2)
    s, label = np.round(rnd.normal(size=3000), 3), (rnd.random(3000) > 0.2).astype(int)
    weight = {1: 0.8 / (label == 1).sum(), 0: 0.2 / (label == 0).sum()}
    order = np.lexsort((label, s))
    sums = np.cumsum([weight[y] for y in label[order]])
    rows = spark.createDataFrame(list(zip(s.tolist(), label.tolist())), "s double, label int")
    for few in (50, 20000):
        monkeypatch.setattr(Q, "FEW", few)
        at = int(np.searchsorted(sums, 0.2 + 1e-12))
        assert Q.quantile(rows, 0.2, weight) in (s[order][at], (s[order][at] + s[order][at - 1]) / 2)
