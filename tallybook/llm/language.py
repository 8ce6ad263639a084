"""Language identification: the nearest of several centroids per language by cosine.

A text is a vector of byte trigrams (letters lower-cased, all else one blank), hashed to DIMENSIONS places,
weighted log(1 + count) times the inverse document frequency over all documents of the fit, and normalised. Each
language's sample is clustered into up to CLUSTERS centroids. A text takes the language of the nearest centroid
and is marked rejected when it lies farther from it than almost all of that centroid's own sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.arrow import map_batches
from tallybook.llm.labelled import held_out
from tallybook.llm.textkit import slices
from tallybook.session import table

DIMENSIONS = 2048
#: Labelled documents of each language that the fit uses at most, and centroids of each language.
SAMPLE, CLUSTERS = 400, 4
#: Rows of all languages that the fit uses at most; very many languages get fewer rows each.
ROWS = 200_000
#: Parts of a language that its sample is first taken from.
PARTS = 8
#: Share of a centroid's own sample that lies beyond its rejection distance.
REJECT = 0.005
UNKNOWN = "und"


def _classes() -> np.ndarray:
    table_ = np.full(256, 32, np.uint32)
    table_[97:123] = table_[65:91] = np.arange(97, 123)
    table_[128:] = np.arange(128, 256)
    return table_


_CLASS = _classes()


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIMENSIONS counts of the hashed trigrams inside each row."""
    rows = len(offsets) - 1
    n = len(data)
    if n < 3:
        return np.zeros((rows, DIMENSIONS), np.float32)
    c = _CLASS[data]
    gram = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    place = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
    inside = np.ones(n - 2, bool)
    for k in (1, 2):  # trigrams that would cross into the next row
        cross = offsets[1:-1] - k
        inside[cross[(cross >= 0) & (cross < n - 2)]] = False
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))[: n - 2]
    blank = gram != (32 << 16 | 32 << 8 | 32)
    keep = inside & blank
    return np.bincount(row[keep] * DIMENSIONS + place[keep], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors; zero where a row has no trigram."""
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter of any script."""
    ascii_ = np.zeros(len(data) + 1, np.int64)
    np.cumsum((_CLASS[data] != 32) & (data < 128), out=ascii_[1:])
    found = ascii_[offsets[1:]] > ascii_[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        found[i] = not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))
    return found


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the trigram)) + 1 for each place, over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found += (trigram_counts(data, offsets) > 0).sum(axis=0)
                rows += len(offsets) - 1
        yield pa.record_batch([pa.array(np.arange(-1, DIMENSIONS), pa.int32()), pa.array(np.append(rows, found), pa.int64())], names=["place", "n"])

    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(DIMENSIONS + 1)
    for r in sums:
        n[r["place"] + 1] = r["n"]
    return (np.log((1 + n[0]) / (1 + n[1:])) + 1).astype(np.float32)


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out starts: centroids, and the least cosine that each accepts."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(12):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        owner = np.argmax(x @ c.T, axis=1)
        c = np.array([x[owner == i].mean(axis=0) if (owner == i).any() else c[i] for i in range(len(c))])
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cosine = x @ c.T
    owner = np.argmax(cosine, axis=1)
    least = np.array([np.quantile(cosine[owner == i, i], REJECT) - 1e-6 if (owner == i).any() else 1.0 for i in range(len(c))])
    return c.astype(np.float32), least


class Centroids:
    def __init__(self, idf: np.ndarray, languages: list[str], matrix: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.matrix, self.least = idf, languages, matrix, least

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine of the nearest centroid in 0..1, and whether the text is rejected."""
        letters = has_letter(data, offsets)
        if not self.languages:
            return [UNKNOWN] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
        cosine = vectors(trigram_counts(data, offsets), self.idf) @ self.matrix.T
        best = np.argmax(cosine, axis=1)
        score = np.where(letters, np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], score, (score < self.least[best]) | ~letters


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Centroids:
    """Centroids from at most SAMPLE rows of each language; document frequencies from all rows of docs, labelled or not.

    Rows without a key, a language or a text give no centroid; equal rows count once, other rows that share a key each.
    Ties follow the keys and texts, never the partitions. No usable row gives a model that calls every text `und`.
    """
    idf = inverse_frequencies(docs, text)
    usable = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
    texts = usable.select(F.col(text).cast("string").alias("text"), F.col(key).alias("id"), F.col(lang).alias("lang")).withColumn("hash", F.xxhash64("text"))
    size = max(1, min(SAMPLE, ROWS // max(1, texts.select("lang").distinct().count())))
    chosen = texts.select("id", "lang", "hash").withColumn("part", F.pmod(F.xxhash64("id", "hash", F.lit(5)), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # first in parts of each language, so that the second task reads PARTS * size rows at most
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id", "hash"))
        chosen = chosen.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")
    chosen = chosen.select("id", "lang", "hash").distinct()
    texts = texts.join(F.broadcast(chosen), ["id", "lang", "hash"]).dropDuplicates(["id", "lang", "hash"])  # ROWS rows at most are broadcast

    def embed(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = np.vstack([vectors(trigram_counts(data, offsets), idf) for _, _, data, offsets in slices(batch.column("text"))])
        return pa.record_batch([batch.column("id"), batch.column("hash"), batch.column("lang"), pa.array(list(v), pa.list_(pa.float32()))], names=["id", "hash", "lang", "v"])

    def centroids(lang_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values(["id", "hash"])["v"].to_numpy())  # an order that does not depend on the partitions
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        c, least = cluster(x, CLUSTERS)
        return pd.DataFrame({"lang": [lang_[0]] * len(c), "centre": list(c), "least": least})

    kind = docs.schema[key].dataType.simpleString()
    rows = map_batches(texts, embed, f"id {kind}, hash long, lang string, v array<float>").groupBy("lang").applyInPandas(centroids, "lang string, centre array<float>, least double").collect()
    rows.sort(key=lambda r: (r["lang"], list(r["centre"])))
    return Centroids(idf, [r["lang"] for r in rows], np.array([r["centre"] for r in rows], np.float32).reshape(-1, DIMENSIONS), np.array([r["least"] for r in rows]))


def identified(docs: DataFrame, model: Centroids, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score and rejected for each row; null texts and texts without a letter are `und` with score 0.

    Other columns are ignored, equal texts give equal values and an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [model.predict(data, offsets) for _, _, data, offsets in slices(batch.column(1))]
        names, score, rejected = ([v for p in parts for v in p[0]], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=[key, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, run, f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


FOLDS, FOLD = 3, 1


def op2_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"), FOLDS, FOLD) & F.col("lang").isNotNull()))
    return identified(docs, model).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_centroid_language": op2_centroid_language}
