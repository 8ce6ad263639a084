"""Toxic passages: maximal-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens are runs of letters, ASCII lower-cased, held as 64-bit hashes. A token's weight is its log-odds between
toxic and other labelled documents (counted once in each, so that repeated lines don't matter) under a Dirichlet
prior proportional to its count in all documents; weights whose z-score is small are 0. Every token also costs
DRIFT (more where the weights of clean text need it), so that unrelated text scores below 0. The linear-time scan
of Ruzzo and Tompa finds all maximal segments; a segment of score S in a text of n tokens has E-value
K n exp(-lambda S), lambda from the background token distribution and K from the best segments of documents
that are not toxic. The document's evidence is the sum of the log E-values of its significant segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.llm.labelled import held_out, sample_ids
from tallybook.llm.minhash import signatures
from tallybook.llm.textkit import letter_byte, mix, shingle_sets, slices, words
from tallybook.session import table, written

#: Labelled rows of each class that the fit uses at most, and tokens that the model holds at most.
SAMPLE, TOKENS = 4000, 1 << 20
#: Toxic sample documents that a token of the model occurs in at least.
LEAST_DOCUMENTS = 6
#: Weight of the prior as a part of each class's tokens, and its floor for a token, shared between the classes by size.
PRIOR, FLOOR = 0.1, 0.5
LEAST_Z, DRIFT = 2.2, 0.04
#: Sketch coordinates that sample documents are compared by; those that agree in SAME of them are copies and count once in the fit.
SKETCH, SAME = 12, 9
#: Segments with a larger E-value are not significant.
MOST_E = 0.5


@dataclass
class Model:
    tokens: np.ndarray  # sorted hashes
    weights: np.ndarray
    rate: float  # lambda
    log_k: float
    cut: float  # evidence at which the score is 1/2
    slope: float
    drift: float = DRIFT

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (evidence - self.cut), -500, 500)))


def maximal_segments(steps: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa, linear time): (first, end, score) with score > 0."""
    out: list[list] = []  # first, end, total before, total after, earlier segment with a smaller total before
    total = 0.0
    for i, x in enumerate(steps):
        before, total = total, total + x
        if x <= 0:
            continue
        first, left = i, before
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                del out[_keep(out, first) :]
                out.append([first, i + 1, left, total, j])
                break
            first, left = out[j][0], out[j][2]
            j = out[j][4]
    return [(a, b, r - s) for a, b, s, r, _ in out]


def _keep(out: list[list], first: int) -> int:
    """How many segments end before `first`."""
    n = len(out)
    while n and out[n - 1][0] >= first:
        n -= 1
    return n


def _segments(places: np.ndarray, values: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """Maximal segments of a document as (first token, end token, score); places: tokens with a weight, in order.

    A run of tokens without weight is one step of -drift for each; segments never begin or end in such a run.
    """
    steps, where = [], []
    at = 0
    for p, v in zip(places.tolist(), values.tolist()):
        if p > at:
            steps.append(-drift * (p - at))
            where.append(at)
        steps.append(v - drift)
        where.append(p)
        at = p + 1
    return [(where[a], where[b - 1] + 1, s) for a, b, s in maximal_segments(steps)]


def _documents(model: Model, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[float, float, list, int]]:
    """For each row: evidence, best log E-value so far as -inf..; significant segments in bytes, token count."""
    starts, ends, hashes, first = words(data, offsets, letter_byte())
    at = np.searchsorted(model.tokens, hashes)
    at[at == len(model.tokens)] = 0
    known = model.tokens[at] == hashes if len(model.tokens) else np.zeros(len(hashes), bool)
    weight = np.where(known, model.weights[at] if len(model.tokens) else 0.0, 0.0)
    hits = np.flatnonzero(weight)
    bounds = np.searchsorted(hits, first)
    for i in range(len(offsets) - 1):
        n = int(first[i + 1] - first[i])
        mine = hits[bounds[i] : bounds[i + 1]]
        evidence, best, found = 0.0, 0.0, []
        for a, b, s in _segments(mine - first[i], weight[mine], model.drift) if len(mine) else ():
            best = max(best, s)
            log_e = model.log_k + np.log(n) - model.rate * s
            if log_e < np.log(MOST_E):
                evidence -= log_e
                found.append((int(starts[first[i] + a] - offsets[i]), int(ends[first[i] + b - 1] - offsets[i]), float(s), float(log_e)))
        yield evidence, best, found, n


def token_counts(docs: DataFrame, text: str, label: str) -> DataFrame:
    """token, label, n (occurrences), documents: summed over all rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = np.array(batch.column(1).to_pylist())
        parts = []
        for a, b, data, offsets in slices(batch.column(0)):
            _, _, hashes, first = words(data, offsets, letter_byte())
            row = np.repeat(np.arange(b - a), np.diff(first))
            order = np.lexsort((hashes, row))
            h, r = hashes[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            at = np.flatnonzero(new)
            parts.append((h[at], marks[a:b][r[at]], np.diff(np.append(at, len(h)))))
        h, y, n = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((h, y))
        h, y, n = h[order], y[order], n[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (y[1:] != y[:-1])
        at = np.flatnonzero(new)
        sums = np.add.reduceat(n, at) if len(at) else n
        return pa.record_batch([pa.array(h[at].view(np.int64)), pa.array(y[at].astype(np.int32)), pa.array(sums.astype(np.int64)), pa.array(np.diff(np.append(at, len(h))).astype(np.int64))], names=["token", "label", "n", "documents"])

    counted = map_batches(docs.select(F.col(text).cast("string").alias("text"), F.col(label).alias("label")), run, "token long, label int, n long, documents long")
    return counted.groupBy("token", "label").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def background_counts(docs: DataFrame, text: str, tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the (sorted) tokens occurs, and the sum of that over all tokens there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(tokens), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                _, _, hashes, first = words(data, offsets, letter_byte())
                row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(first))
                both = np.sort(mix(hashes + row * np.uint64(0xC2B2AE3D27D4EB4F)))
                total += int(np.count_nonzero(both[1:] != both[:-1])) + bool(len(both))
                at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
                hit = tokens[at] == hashes
                once = np.unique(row[hit].astype(np.int64) * len(tokens) + at[hit])
                counts += np.bincount(once % len(tokens), minlength=len(tokens))
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(counts[used], total), pa.int64())], names=["at", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # at most TOKENS + 1 rows
    counts, total = np.zeros(len(tokens)), 0
    for r in rows:
        if r["at"] < 0:
            total = r["n"]
        else:
            counts[r["at"]] = r["n"]
    return counts, total


def log_odds(toxic: np.ndarray, other: np.ndarray, all_toxic: float, all_other: float, background: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of each token between the classes under the informative Dirichlet prior, their z-scores, the other class's prior."""
    everywhere = background / max(total, 1)
    prior = [n * (PRIOR * everywhere + FLOOR / (all_toxic + all_other)) for n in (all_toxic, all_other)]
    one = np.log(toxic + prior[0]) - np.log(all_toxic * (1 + PRIOR))
    two = np.log(other + prior[1]) - np.log(all_other * (1 + PRIOR))
    return one - two, (one - two) / np.sqrt(1 / (toxic + prior[0]) + 1 / (other + prior[1])), prior[1]


def distinct_texts(rows: list) -> list:
    """Of (id, hash, label, sketch) those that agree in fewer than SAME coordinates with each one of their label that is kept before them."""
    kept = np.zeros((2, len(rows), SKETCH), np.int64)
    n, out = [0, 0], []
    for r in sorted(rows, key=lambda r: (r["id"], r["hash"], r["label"])):
        y = int(r["label"])
        if r["sketch"]:
            if n[y] and int((kept[y, : n[y]] == np.array(r["sketch"])).sum(axis=1).max()) >= SAME:
                continue
            kept[y, n[y]] = r["sketch"]
            n[y] += 1
        out.append((r["id"], r["hash"], y))
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """id, hash (of the text), label and the first SKETCH coordinates of the text's circulant MinHash (none for an empty text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, _, data, offsets in slices(batch.column(3)):
            sets = shingle_sets(data, offsets, 3)
            coordinates = iter(signatures([s for s in sets if len(s)], SKETCH).T.astype(np.int64)) if any(map(len, sets)) else iter(())
            out += [next(coordinates) if len(s) else np.zeros(0, np.int64) for s in sets]
        return pa.record_batch([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["id", "hash", "label", "sketch"])

    return map_batches(docs.select("id", "hash", "label", "text"), run, f"id {docs.schema['id'].dataType.simpleString()}, hash long, label int, sketch array<long>")


def decay_rate(steps: np.ndarray, chances: np.ndarray) -> float:
    """The positive root of sum(chance * exp(rate * step)) = 1; steps have a negative mean and a positive maximum."""
    low, high = 0.0, 1.0
    value = lambda r: float(np.sum(chances * np.exp(np.clip(r * steps, -700, 700)))) - 1
    while value(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return max(high, 1e-3)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most SAMPLE rows of each class of labels (1 toxic, 0 not); the prior counts all documents.

    Null keys and other labels are left out, repeated rows and near copies of one label count once, a null text counts as
    empty. Without rows of both classes the model scores every text alike and below 1/2. An empty table gives that model too.
    """
    ids = F.broadcast(sample_ids(labels.where(F.col(key).isNotNull()), key, label, [0, 1], SAMPLE))
    chosen = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text")).join(ids, "id")
    chosen = chosen.select("id", "hash", F.col("label").cast("int").alias("label"), "text").dropDuplicates(["id", "hash", "label"])
    sample = written(chosen, "sample")  # read again for each step of the fit, instead of all documents
    kept = distinct_texts(sketches(sample).collect())  # at most 2 * SAMPLE keys
    kind = sample.schema["id"].dataType.simpleString()
    unique = F.broadcast(docs.sparkSession.createDataFrame(kept, f"id {kind}, hash long, label int"))
    chosen = sample.join(unique, ["id", "hash", "label"])
    counts = written(token_counts(chosen, "text", "label"), "tokens")
    totals = {r["label"]: r["n"] for r in counts.groupBy("label").agg(F.sum("documents").alias("n")).collect()}
    wide = counts.groupBy("token").agg(*(F.sum(F.when(F.col("label") == y, F.col("documents")).otherwise(0)).alias(c) for y, c in ((1, "toxic"), (0, "other"))))
    rows = wide.where(F.col("toxic") >= LEAST_DOCUMENTS).orderBy(F.desc("toxic"), "token").limit(TOKENS).collect()
    tokens = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    tokens = tokens[order]
    toxic, other = (np.array([r[k] for r in rows], float)[order] for k in ("toxic", "other"))
    if not len(tokens) or not totals.get(0) or not totals.get(1):
        return Model(tokens[:0], np.zeros(0), 1.0, 0.0, 1.0, 1.0)
    background, total = background_counts(docs, text, tokens)
    odds, z, prior = log_odds(toxic, other, totals[1], totals[0], background, total)
    used = np.abs(z) >= LEAST_Z
    tokens, weights = tokens[used], odds[used]
    chance = (other[used] + prior[used]) / (totals[0] * (1 + PRIOR))
    drift = max(DRIFT, 2 * float(chance @ weights))  # extreme-value statistics need steps that are negative on average
    steps = np.append(weights, 0.0) - drift
    rate = decay_rate(steps, np.append(chance, max(0.0, 1 - chance.sum()))) if (steps > 0).any() else 1.0
    model = Model(tokens, weights, rate, 0.0, 1.0, 1.0, drift)
    seen = evidence_table(chosen, model, "id", "text", ["label"]).select("label", "best", "n_tokens").collect()  # at most 2 * SAMPLE keys
    clean = [(r["best"], r["n_tokens"]) for r in seen if r["label"] == 0 and r["n_tokens"] > 0]
    # The mean of lambda S - ln n over clean documents is ln K + Euler's constant; at least 1/n each, so K stays above 0.
    model.log_k = float(np.mean([max(rate * s - np.log(n), -np.log(n) - 1) for s, n in clean]) - 0.5772) if clean else 0.0
    return calibrated(model, evidence_table(chosen, model, "id", "text", ["label"]).select("label", "evidence").collect())


def calibrated(model: Model, rows: list) -> Model:
    """Set the cut between the classes' evidence where most rows of the sample (both classes alike) are right."""
    y = np.array([r["label"] for r in rows])
    e = np.array([r["evidence"] for r in rows])
    order = np.argsort(e, kind="stable")
    e, y = e[order], y[order]
    w = np.where(y == 1, 1 / max(1, (y == 1).sum()), -1 / max(1, (y == 0).sum()))
    gain = np.append(np.cumsum(-w), 0)  # cut after i rows: clean below, toxic above
    ends = np.flatnonzero(np.append(np.diff(e) > 0, False))
    if len(ends):
        best = ends[int(np.argmax(gain[ends]))]
        model.cut = float((e[best] + e[best + 1]) / 2)
        model.slope = float(np.log(99) / max(model.cut, 0.1))
    return model


def evidence_table(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: list[str] = []) -> DataFrame:  # noqa: B006
    """key, evidence, best (segment score), n_tokens, score, predicted and passages (byte spans with score and log E-value).

    Null texts count as empty: no tokens, evidence 0. One row for each row, null and repeated keys included; equal texts
    give equal values and an empty table gives no rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r for _, _, data, offsets in slices(batch.column(1)) for r in _documents(model, data, offsets)]
        evidence = np.array([r[0] for r in rows])
        score = model.score(evidence)
        passages = pa.array([[{"start": a, "end": b, "score": s, "log_e": e} for a, b, s, e in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_e", pa.float64())])))
        columns = [pa.array(evidence), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), passages]
        return pa.record_batch([batch.column(0), *columns, *batch.columns[2:]], names=[key, "evidence", "best", "n_tokens", "score", "predicted", "passages", *extra])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"), *extra)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, evidence double, best double, n_tokens long, score double, predicted int, passages array<struct<start:bigint,end:bigint,score:double,log_e:double>>{kinds}"
    return map_batches(rows, run, schema)


FOLDS, FOLD = 5, 0


def op8_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"), FOLDS, FOLD)))
    return evidence_table(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


QUERIES = {"op8_toxic_segments": op8_toxic_segments}
