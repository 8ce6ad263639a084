"""Approximate nearest neighbours by balanced posting lists.

Centroids come from hierarchical balanced clustering of a bounded sample. A vector joins the list of its nearest
centroid and, near boundaries, those of others almost as near unless a chosen one covers them. The centroids
are found through a neighbour graph held in memory, however few they are; a query reads the lists whose centroids are within a
ratio of the nearest one's distance. The ratio is fitted on a sample of the queries that is compared with all vectors, so that it finds what they
have to; queries with one centroid much nearer than the others read few lists, and a number bounds those of the rest. A query whose lists hold too few vectors reads all lists. Lists are cut into blocks of bounded size, so a hot list is many
tasks' work. Equal vectors are one class: no result needs more than the smallest few ids of a class, and equal queries are
searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.llm.arrow import map_batches
from tallybook.session import table, written

#: Vectors that the centroids are fitted on at most, aimed vectors of a list, and lists at most (they bound the broadcast index).
SAMPLE, LIST_ROWS, MOST_LISTS = 20000, 256, 8192
#: Lists that a vector joins at most, and how much farther than the nearest their centroids may be.
REPLICAS, BOUNDARY = 4, 1.15
#: Lists from which on it is tried how many a query has to read at most.
PROBES = 8
#: Queries that are compared with all vectors, and the part of their neighbours that the lists read have to hold.
CHECKED, RECALL = 256, 0.95
#: Rows of a block at most (about), on either side.
BLOCK_ROWS = 2048
DEGREE = 20


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, count: int) -> np.ndarray:
    """About `count` centroids: parts are split in up to 8 again and again, each taking a bounded share."""
    rng, out, work = np.random.default_rng(11), [], [(x, count)]
    while work:
        part, k = work.pop()
        if k <= 1 or len(part) <= 2:
            out.append(part.mean(axis=0))
            continue
        ways = min(8, k, len(part))
        c = part[rng.choice(len(part), ways, replace=False)]
        cap = -(-len(part) * 5 // (4 * ways))
        for _ in range(6):
            s = part @ c.T
            owner = np.full(len(part), -1)
            free = np.full(ways, cap)
            for choice in np.argsort(-s, axis=1).T:  # each to its best centre that has room; the surest first
                left = np.flatnonzero(owner < 0)
                if not len(left):
                    break
                for j in range(ways):
                    mine = left[choice[left] == j]
                    mine = mine[np.argsort(-s[mine, j], kind="stable")][: free[j]]
                    owner[mine] = j
                    free[j] -= len(mine)
            c = np.array([part[owner == j].mean(axis=0) if (owner == j).any() else c[j] for j in range(ways)])
        share = [k // ways + (j < k % ways) for j in range(ways)]
        work += [(part[owner == j], share[j]) for j in range(ways) if (owner == j).any()]
    c = np.array(out)
    c = c[np.linalg.norm(c, axis=1) > 1e-12]
    return normalised(c) if len(c) else normalised(x[:1])


class CentroidGraph:
    """Unit centroids with links to near ones and a few far ones; searched best first for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        n = len(centroids)
        near = min(DEGREE, n - 1)
        links = []
        for a in range(0, n, 512):
            s = self.c[a : a + 512] @ self.c.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            links.append(np.argsort(-s, axis=1)[:, :near])
        far = np.random.default_rng(3).integers(0, n, (n, 4))
        ring = (np.arange(n)[:, None] + 1) % n  # every centroid can be reached from every other
        self.links = np.hstack([np.vstack(links), far, ring]) if n > 1 else np.zeros((1, 1), int)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found for each row of unit vectors x: ids (-1: none) and cosines, nearest first."""
        x = x.astype(np.float32)
        n, width = len(x), min(width, len(self.c))
        seen = np.zeros((n, len(self.c)), bool)
        ids = np.tile(self.entries, (n, 1))
        s = x @ self.c[self.entries].T
        seen[:, self.entries] = True
        done = np.zeros(ids.shape, bool)
        rows = np.arange(n)
        while True:
            order = np.argsort(-s, axis=1, kind="stable")[:, :width]
            ids, s, done = (np.take_along_axis(v, order, 1) for v in (ids, s, done))
            open_ = ~done & (ids >= 0)
            if not open_.any():
                return ids, s
            at = np.argmax(open_, axis=1)
            some = open_[rows, at]
            done[rows[some], at[some]] = True
            next_ = self.links[ids[rows, at]]
            fresh = ~seen[rows[:, None], next_] & some[:, None]
            fresh &= ~(np.triu(next_[:, None, :] == next_[:, :, None], 1).any(axis=1))  # a centroid linked twice counts once
            cosine = np.einsum("ij,ikj->ik", x, self.c[next_])
            np.put_along_axis(seen, next_, True, 1) if some.all() else seen.__setitem__((rows[some][:, None], next_[some]), True)
            ids = np.hstack([ids, np.where(fresh, next_, -1)])
            s = np.hstack([s, np.where(fresh, cosine, -9).astype(np.float32)])
            done = np.hstack([done, ~fresh])

    def lists(self, x: np.ndarray, most: int, ratio: float | None, cover: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: centroids within `ratio` (None: any) of the nearest one's distance, `most` at most.

        cover: skip a centroid that lies nearer to one chosen before than to the vector.
        """
        ids, s = self.search(x, 2 * most if cover else most)
        d = np.sqrt(np.maximum(0, 2 - 2 * s.astype(float)))
        ok = ids >= 0
        if ratio is not None:
            ok &= d <= ratio * d[:, :1] + 1e-9
        ok[:, 0] = True
        if cover:
            taken = np.ones(len(x), int)
            for j in range(1, ids.shape[1]):
                for i in range(j):
                    between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.c[ids[:, j]], self.c[ids[:, i]]).astype(float)))
                    ok[:, j] &= ~(ok[:, i] & (2 * between < d[:, j]))
                ok[:, j] &= taken < most
                taken += ok[:, j]
        row, at = np.nonzero(ok)
        return row, ids[row, at]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part: a vector without null, infinite or NaN parts that is not all zeros."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(key).alias("id"), v.alias("v"))


def top_pairs(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, exact cosine) of each query's k best of a block, ties to the smaller id."""
    q, v = q.astype(float), v.astype(float)
    qn, vn = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
    rough = (q / qn[:, None]) @ (v / vn[:, None]).T
    if rough.shape[1] > k:
        least = -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k]
        row, at = np.nonzero(rough >= least - 1e-9)
    else:
        row, at = np.nonzero(np.ones_like(rough, bool))
    exact = (q[row] * v[at]).sum(axis=1) / (qn[row] * vn[at])
    order = np.lexsort((vid[at], -exact, row))
    row, at, exact = row[order], at[order], exact[order]
    first = np.searchsorted(row, np.arange(len(q)))
    best = np.arange(len(row)) - first[row] < k
    return row[best], at[best], exact[best]


def true_neighbours(candidates: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """query (row of sample) and id of the k nearest candidates of each, copies of the query itself left out."""
    sent = candidates.sparkSession.sparkContext.broadcast(sample)
    kind = candidates.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, ids = sent.value, batch.column(0)
        ranks = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"))
        row, at, score = top_pairs(_matrix(q["v"]), np.arange(q.num_rows), _matrix(batch.column(3)), ranks, 2 * k + 1)  # k + 1 copies at most
        own = np.logical_and.reduce([q[c].to_numpy()[row] == batch.column(i).to_numpy()[at] for i, c in ((1, "h"), (2, "g"))])
        row, at, score = row[~own], at[~own], score[~own]
        return pa.record_batch([pa.array(row, pa.int32()), ids.take(pa.array(at)), pa.array(score)], names=["query", "id", "score"])

    if not sample.num_rows:
        return candidates.select(F.lit(0).alias("query"), "id").limit(0)
    found = map_batches(candidates.select("id", "h", "g", "v"), run, f"query int, id {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("query", "id")


def probes_needed(graph: CentroidGraph, x: np.ndarray, held: list[tuple[int, list[int]]]) -> tuple[int, float]:
    """How many lists at most, within which ratio, queries like the rows of x have to read; held: row and the lists of each true neighbour.

    The number is twice that by which the nearest lists alone would hold RECALL of the neighbours; within it the ratio is the least that does.
    """
    n = len(graph.c)
    row = np.repeat([r for r, _ in held], [len(ls) for _, ls in held]).astype(int)
    list_ = np.array([i for _, ls in held for i in ls], int)
    first = np.cumsum([0] + [len(ls) for _, ls in held[:-1]])

    def recall(most: int, ratio: float | None) -> float:
        read = np.zeros((len(x), n), bool)
        read[graph.lists(x, most, ratio, False)] = True
        return float(np.logical_or.reduceat(read[row, list_], first).mean())

    if not held:
        return n, 1e9
    most = min(PROBES, n)
    while recall(most, None) < RECALL and most < n:
        most = min(n, most + most // 4 + 1)
    most = min(n, 2 * most)
    away = np.sqrt(np.maximum(0, 2 - 2 * (x.astype(np.float32) @ graph.c.T).astype(float)))
    away = away / np.maximum(away.min(axis=1, keepdims=True), 1e-9)
    nearest_held = np.sort(np.minimum.reduceat(away[row, list_], first))  # by which ratio each neighbour is reached
    at = min(len(nearest_held) - 1, max(0, int(np.ceil(RECALL * len(nearest_held))) - 1))
    while at < len(nearest_held) - 1 and recall(most, float(nearest_held[at])) < RECALL:  # what the graph or the number misses
        at = min(len(nearest_held) - 1, at + 1 + len(nearest_held) // 256)
    return most, float(nearest_held[at])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found of each row of queries among vectors.

    A row never finds itself (its own key). Vectors that are null, zero or hold null or non-finite parts take no
    part, nor do those of another length than most, nor rows without a key; a query among them has no rows. Ties go to
    the smaller key. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, asked = usable(vectors, key, vector), usable(queries, key, vector)
    kind = rows.schema["id"].dataType.simpleString()
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    size = lengths[0]["size"]
    same = lambda df: df.where(F.size("v") == size).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.reverse("v"), F.lit(5))})
    rows, asked = same(rows), same(asked)
    copies = Window.partitionBy("h", "g").orderBy("id")
    candidates = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1)
    classes = asked.withColumn("_n", F.row_number().over(copies)).where("_n = 1").select("h", "g", "v")

    total = rows.select("h", "g").distinct().count()
    fit = candidates.where("_n = 1").select("h", "g", "v").orderBy(F.xxhash64("h"), "h", "g").limit(SAMPLE).toArrow()
    lists = int(min(max(1, total // LIST_ROWS), MOST_LISTS, max(1, fit.num_rows // 4)))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(normalised(_matrix(fit["v"]).astype(float)), lists)))

    def placed(df: DataFrame, columns: list[str], most: int, ratio: float | None, cover: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, list_ = [], []
            for a in range(0, batch.num_rows, 1024):
                x = normalised(_matrix(batch.column("v").slice(a, 1024)).astype(float))
                r, c = graph.value.lists(x, most, ratio, cover)
                row.append(r + a)
                list_.append(c)
            taken = batch.take(pa.array(np.concatenate(row)))
            return pa.record_batch([*taken.columns, pa.array(np.concatenate(list_), pa.int32())], names=[*batch.schema.names, "list"])

        kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in columns)
        return map_batches(df.select(*columns), run, f"{kinds}list int")

    postings = written(placed(candidates, ["id", "v"], REPLICAS, BOUNDARY, True), "postings")
    sample = classes.orderBy(F.xxhash64("h", F.lit(3)), "h", "g").limit(CHECKED).toArrow()
    true = true_neighbours(candidates, sample, k)
    held = true.join(postings.select("id", "list"), "id").groupBy("query", "id").agg(F.collect_list("list").alias("lists")).collect()  # CHECKED * k rows at most
    x = normalised(_matrix(sample["v"]).astype(float)) if sample.num_rows else np.zeros((0, size))
    probes = written(placed(classes, ["h", "g", "v"], *probes_needed(graph.value, x, [(r["query"], r["lists"]) for r in held]), False), "probes")
    blocks = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def search(v: pa.Table, q: pa.Table) -> pa.Table:
        names, types = ["h", "g", "id", "score"], [pa.int64(), pa.int64(), v.schema.field("id").type if v.num_rows else pa.int64(), pa.float64()]
        if not v.num_rows or not q.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        ids = v["id"].combine_chunks()
        ranks = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"))
        row, at, score = top_pairs(_matrix(q["v"]), np.arange(q.num_rows), _matrix(v["v"]), ranks, k + 1)
        return pa.table([q["h"].take(pa.array(row)), q["g"].take(pa.array(row)), ids.take(pa.array(at)), pa.array(score)], names=names)

    def found_in(probes: DataFrame) -> DataFrame:
        """h, g, id, score of the k + 1 best of each query class (h, g, v, list) in its lists."""
        cuts = F.broadcast(blocks(postings, "parts").join(blocks(probes, "shares"), "list"))  # MOST_LISTS rows at most
        left = postings.join(cuts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), each("shares").alias("share"), "id", "v")
        right = probes.join(cuts, "list").select("list", each("parts").alias("part"), F.pmod("h", F.col("shares")).cast("int").alias("share"), "h", "g", "v")
        keys = ["list", "part", "share"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, f"h long, g long, id {kind}, score double")
        best = found.groupBy("h", "g", "id").agg(F.max("score").alias("score"))
        best = best.withColumn("_n", F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k + 1)
        return best.select("h", "g", "id", "score")

    best = written(found_in(probes), "best")
    enough = best.groupBy("h", "g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k + 1, candidates.count()))
    short = written(classes.join(enough, ["h", "g"], "left_anti"), "short")
    if not short.isEmpty():  # too few in the lists read: these read all lists
        everywhere = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(len(graph.value.c) - 1))))
        best = best.join(short, ["h", "g"], "left_anti").unionByName(written(found_in(everywhere), "best"))
    mine = asked.select(F.col("id").alias("query_id"), "h", "g").join(best, ["h", "g"]).where(F.col("query_id") != F.col("id"))
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


STEP = 50


def op5_balanced_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % STEP == 0))


QUERIES = {"op5_balanced_postings": op5_balanced_postings}
