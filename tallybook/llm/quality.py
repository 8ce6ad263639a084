"""Quality by Bradley-Terry pairwise ranking.

All labelled rows are dealt to blocks by a hash, and in a block every pair of one good and one bad document says that the good one is
preferred. A linear score of text features is learned by logistic loss on the pairs' feature differences (Newton steps with a ridge;
each step is one pass over the blocks, whose sums the driver adds), then cut at the quantile that leaves the labelled share of bad documents below it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.llm.labelled import held_out
from tallybook.llm.textkit import slices, words
from tallybook.session import discarded, table, written

#: Rows of a block at least and at most; between them a block is so large that it has RARER rows of the rarer class on average.
BLOCK, LARGEST, RARER = 1024, 65536, 32
#: Pairs that weigh as much as one ridge, however many there are.
PAIRS = 60000
#: Bins of the scores in a pass for the threshold, and scores that the last pass may collect.
BINS, FEW = 4096, 20000
#: The calibrated score of a document at the threshold.
CUT = 0.7
FEATURES = [
    "log_bytes", "log_words", "upper", "digit", "space", "other_bytes", "sentence_marks", "exclamation", "symbols", "pipes",
    "word_length", "lines", "distinct_words", "distinct_triples", "distinct_lines", "capital_words", "shouted_words", "symbol_words", "short_words", "long_words",
]


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(b"0123456789")
_SPACE = _table(b" \t\n\v\f\r")
_OTHER = _table(bytes(range(128, 256)))
_SENTENCE = _table(b".,;:?")
_SYMBOL = _table(b"#$%&*+<=>@\\^_`{}~[]()/\"-'")
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(values: np.ndarray, first: np.ndarray, size: int = 1) -> np.ndarray:
    """Share of distinct values in each row's run of values, which are of `size` items inside the row; 1 for none."""
    out = np.ones(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), (first[1:] - size + 1).tolist())):
        if b - a > 1:
            s = np.sort(values[a:b])
            out[i] = (1 + np.count_nonzero(s[1:] != s[:-1])) / (b - a)
    return out


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x FEATURES for a slice of texts."""
    n = np.diff(offsets).astype(float)
    size = np.maximum(n, 1)
    starts, ends, hashes, first = words(data, offsets)
    count = np.diff(first).astype(float)
    many = np.maximum(count, 1)
    share = {name: _per_row(t[data], offsets) / size for name, t in (("upper", _UPPER), ("digit", _DIGIT), ("space", _SPACE), ("other", _OTHER), ("sentence", _SENTENCE), ("symbol", _SYMBOL), ("bang", _table(b"!")), ("pipe", _table(b"|")))}
    length = ends - starts
    upper, letters, symbols = (np.concatenate([[0], np.cumsum(t[data])]) for t in (_UPPER, _LETTER, _SYMBOL | _table(b"!|")))
    inner = [c[ends] - c[starts] for c in (upper, letters, symbols)] if len(data) else [length] * 3
    flags = [_UPPER[data[starts]] if len(data) else length > 0, (inner[0] > 1) & (2 * inner[0] > inner[1]), inner[2] > 0, length <= 3, length >= 14]
    per_word = [_per_row(f, first) / many for f in flags]
    triples = np.zeros(max(0, len(hashes) - 2), np.uint64)
    for k in range(3):
        triples = triples * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(triples)]
    newline = _table(b"\n")
    line_kind = ~newline
    _, _, line_hashes, line_first = words(data, offsets, line_kind)
    columns = [
        np.log1p(n), np.log1p(count), share["upper"], share["digit"], share["space"], share["other"], share["sentence"], share["bang"], share["symbol"], share["pipe"],
        _per_row_sum(length, first) / many, np.diff(line_first) / many, _distinct(hashes, first) * np.log1p(count), _distinct(triples, first, 3), _distinct(line_hashes, line_first), *per_word,
    ]
    return np.column_stack(columns)


def _per_row_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return (sums[first[1:]] - sums[first[:-1]]).astype(float)


class Ranking:
    """Weights, scaling and threshold of a fitted score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.scale, self.weights, self.threshold = mean, scale, weights, threshold

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z / 6])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated to 0..1: CUT exactly at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + np.log(CUT / (1 - CUT)), -500, 500)))


def _moments(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x), (label == 1).sum(), (label == 0).sum()], x.sum(axis=0), (x * x).sum(axis=0)])


def _preferences(model: Ranking, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Pairs of a block, and the gradient and Hessian of their logistic loss; no pair is made as a row, as d = good - bad splits into sums over either side."""
    z = model.expand(x)
    good, bad = z[label == 1], z[label == 0]
    p = 1 / (1 + np.exp(np.clip((good @ model.weights)[:, None] - bad @ model.weights, -30, 30)))  # chance that the bad one wins
    w = p * (1 - p)
    cross = good.T @ w @ bad
    hessian = (good * w.sum(axis=1)[:, None]).T @ good + (bad * w.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate([[p.size], good.T @ p.sum(axis=1) - bad.T @ p.sum(axis=0), hessian.ravel()])


def _summed(blocks: DataFrame, function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of function(x, label) over blocks. A task gives one sum for some megabytes of blocks, so the driver adds few."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = 0
        for r in batch.column(1):
            x = np.array(r.values.field("x").flatten()).reshape(-1, len(FEATURES))
            total = total + function(x, r.values.field("label").to_numpy())
        return pa.record_batch([batch.column(0).slice(0, 1), pa.array([total], pa.list_(pa.float64()))], names=["block", "total"])

    rows = map_batches(blocks, run, "block long, total array<double>").collect()
    return np.sum([r.total for r in sorted(rows, key=lambda r: r.block)], axis=0)


def fit(rows: DataFrame, bad_share: float, ridge: float = 1.0) -> Ranking:
    """The Bradley-Terry score of all rows (id, hash, x, label: 1 good, 0 bad)."""
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    model = Ranking(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(2 * len(FEATURES)), 0.0)
    if not good or not bad:  # nothing to prefer: every document is as good as the one class there is
        model.threshold = 2.0 if bad else -2.0
        return model
    n = good + bad
    size = min(LARGEST, max(BLOCK, RARER * n // min(good, bad)))
    block = F.pmod(F.xxhash64("id", "hash"), F.lit(-(-n // size))).alias("block")
    blocks = written(rows.select(block, F.struct("id", "hash", "label", "x").alias("r")).groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("rows")), "blocks")
    sums = _summed(blocks, _moments)
    model.mean = sums[3 : 3 + len(FEATURES)] / n
    scale = np.sqrt(np.maximum(sums[3 + len(FEATURES) :] / n - model.mean**2, 0))
    model.scale = np.where(scale > 1e-9, scale, 1.0)
    for _ in range(25):
        sums = _summed(blocks, lambda x, label: _preferences(model, x, label))
        k, share = len(model.weights), PAIRS / max(1, sums[0])
        gradient = sums[1 : 1 + k] * share - ridge * model.weights
        step = np.linalg.solve(sums[1 + k :].reshape(k, k) * share + ridge * np.eye(k), gradient)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [(model.raw(np.array(r.values.field("x").flatten()).reshape(-1, len(FEATURES))), r.values.field("label")) for r in batch.column(1)]
        return pa.record_batch([pa.array(np.concatenate([s for s, _ in every])), pa.concat_arrays([y for _, y in every])], names=["s", "label"])

    scores = written(map_batches(blocks, run, "s double, label int"), "scores")
    model.threshold = quantile(scores, bad_share, {1: (1 - bad_share) / good, 0: bad_share / bad})
    discarded(blocks, scores)
    return model


def quantile(scores: DataFrame, share: float, weight: dict[int, float]) -> float:
    """The middle of the two scores (s, label) between which the weights of their labels from below reach `share`: exact, by narrowing bins."""
    share += 1e-12
    low, high = scores.agg(F.min("s"), F.max("s")).first()
    counts = lambda df, *by: df.groupBy(*by).agg(*(F.count(F.when(F.col("label") == y, 1)).alias(f"n{y}") for y in (0, 1)))
    value = lambda r: r["n0"] * weight[0] + r["n1"] * weight[1]
    below = 0.0
    while low < high:
        inside = scores.where(F.col("s").between(low, high))
        bins = sorted(counts(inside, F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1)).alias("bin")).collect(), key=lambda r: r["bin"])
        if sum(r["n0"] + r["n1"] for r in bins) <= FEW:
            break
        sums = below + np.cumsum([value(r) for r in bins])
        at = bins[min(int(np.searchsorted(sums, share)), len(bins) - 1)]["bin"]
        own = inside.where(F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1)) == at).agg(F.min("s"), F.max("s")).first()
        if tuple(own) == (low, high):
            break
        low, high = own
        below = sum(map(value, counts(scores.where(F.col("s") < low)).collect()))
    # What is left are few scores, or one score that many rows have, which counts as a whole.
    left = counts(scores.where(F.col("s").between(low, high)), "s").orderBy("s").collect()
    sums = below + np.cumsum([value(r) for r in left])
    at = min(int(np.searchsorted(sums, share)), len(left) - 1)
    first = left[at]["s"]
    inner = min(weight[y] for y in (0, 1) if left[at][f"n{y}"])
    if share - (sums[at] - value(left[at])) > inner:  # the row before it has the same score
        return float(first)
    before = left[at - 1]["s"] if at else scores.where(F.col("s") < first).agg(F.max("s")).first()[0]
    return float(first if before is None else (first + before) / 2)


def feature_table(docs: DataFrame, key: str, text: str, extra: list[str] = []) -> DataFrame:  # noqa: B006
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.vstack([features(data, offsets) for _, _, data, offsets in slices(batch.column(1))])
        return pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64())), *batch.columns[2:]], names=["id", "x", *extra])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), *extra)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return map_batches(rows, run, f"id {docs.schema[key].dataType.simpleString()}, x array<double>{kinds}")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking:
    """Fit on all rows of labels (1 good, 0 bad; other labels and null keys are left out).

    Equal rows count once, other rows that share a key each. Without labels, or with one class, every text is as good as that class.
    Features are made before labels are joined, so that no text is shuffled.
    """
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    known = written(feature_table(texts, "id", "text", ["hash"]).join(rows.distinct(), "id").dropDuplicates(["id", "label", "hash"]), "features")
    model = fit(known, counts.get(0, 0) / max(1, sum(counts.values())))
    discarded(known)
    return model


def scored(docs: DataFrame, model: Ranking, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted for each row of docs, null and repeated keys included; null texts score as empty ones.

    A score depends on the text alone; an empty table gives no rows; other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.concatenate([model.score(features(data, offsets)) for _, _, data, offsets in slices(batch.column(1))])
        return pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[key, "score", "predicted"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The rows of docs that score CUT or more, as they are, repeated and keyless ones too; no row moves between partitions.

    An empty table gives no rows; other columns keep their names and values.
    """
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.concatenate([model.score(features(data, offsets)) for _, _, data, offsets in slices(batch.column(at))])
        return batch.filter(pa.array(score >= CUT))

    return map_batches(docs, run, docs.schema)


FOLDS, FOLD = 4, 2


def op9_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(~held_out(F.col("doc_id"), FOLDS, FOLD)))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")


QUERIES = {"op9_bradley_terry_quality": op9_bradley_terry_quality}
