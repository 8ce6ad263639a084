"""Spelling variants: words one edit apart, found by walking a trie that is a table of edges.

A state (word, position, node, edits) says that the first `position` characters of a word lead to a node of the trie with
so many edits. Level by level the states are joined with the edges of their nodes: a state without an edit goes on along its own word, or
edits along every other edge; one with an edit only goes on where the next character fits. A state that ends at the end of
a word with one edit is a pair of neighbours. Words stand in the trie forwards and backwards and a walk begins at its
word's middle, so an edit in the first half is met on the way from the end: near the root, where every node has all letters,
nothing is tried. A node is the prefix itself, and an edge knows which characters come after it, so that most states that can't go on are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm.arrow import map_batches
from tallybook.llm.licenses import _lowered
from tallybook.session import discarded, table, written

#: Runs of letters in texts whose A-Z are lower-cased.
RUN = "[a-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: One (document, run) in so many loses a character.
DAMAGED = 199
#: A form has to be so many times as frequent.
RATIO = 5
#: Words of more code points are compared by hashes with a character left out, not by the trie, whose levels they would multiply.
TRIE_LETTERS = 64


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of LEAST_LETTERS code points and LEAST_COUNT occurrences or more.

    Null texts have no words; a null key counts as an empty one; repeated rows count each.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode_outer(F.regexp_extract_all(_lowered(F.col(text)), F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.where(F.char_length("_run") >= LEAST_LETTERS)
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    hit = F.expr("cast(_h % char_length(_run) as int)")
    cut = F.concat(F.substring("_run", F.lit(1), hit), F.substring("_run", hit + 2, F.char_length("_run")))
    words = runs.select(F.when(F.col("_h") % DAMAGED == 0, cut).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letters(c: str) -> list[Column]:
    """The letter in column c as a bit of one of two longs: a to z, U+00C0 to U+00FF."""
    return [F.expr(f"CASE WHEN ascii({c}) BETWEEN 97 AND 122 THEN shiftleft(1L, ascii({c}) - 97) ELSE 0L END"), F.expr(f"CASE WHEN ascii({c}) BETWEEN 192 AND 255 THEN shiftleft(1L, ascii({c}) - 192) ELSE 0L END")]


def _spelled(words: DataFrame) -> DataFrame:
    """(s, n, size, half) twice for each word: forwards behind "<", backwards behind ">"; half: where its walk begins."""
    both = F.explode(F.array(F.concat(F.lit("<"), "word"), F.concat(F.lit(">"), F.reverse("word"))))
    return words.select(both.alias("s"), "n").withColumn("size", F.char_length("s")).withColumn("half", F.expr("(size - 1) DIV 2 + 1"))


def trie_edges(spelled: DataFrame) -> DataFrame:
    """(depth, node, ch, end_n, low, high): from node (a prefix of `depth` characters) along ch; end_n is the count of the word that ends
    there, low and high are the letters that go on from there. Only nodes that a walk can meet: from the middle of the shortest word that can come by."""
    at = spelled.select("s", "n", "size", F.explode(F.expr("sequence((size - 2) DIV 2 + 1, size - 1)")).alias("depth"))
    at = at.select("depth", F.expr("substring(s, 1, depth)").alias("node"), F.expr("substring(s, depth + 1, 1)").alias("ch"), F.expr("substring(s, depth + 2, 1)").alias("_after"), F.expr("CASE WHEN depth + 1 = size THEN n END").alias("end_n"))
    low, high = _letters("_after")
    return at.groupBy("depth", "node", "ch").agg(F.max("end_n").alias("end_n"), F.bit_or(low).alias("low"), F.bit_or(high).alias("high"))


_STATE = ["s", "size", "pos", "node", "edits", "end_n"]


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one level down. edits: 0, 1, or 2 for a finished pair, whose node is the neighbour and end_n its count.

    Only the last of equal characters is left out, and none is put in before its like, so a pair comes by one way in each direction.
    """
    gone = F.expr("""inline(filter(array(
        struct(pos, edits),
        struct(pos + 1 AS pos, 1 AS edits)),
      x -> x.pos = pos OR (edits = 0 AND pos + 1 < size AND substring(s, pos + 1, 1) <> substring(s, pos + 2, 1))))""")
    states = states.select("s", "size", "node", gone)
    met = states.join(edges, "node").where("edits = 0 OR ch = substring(s, pos + 1, 1)")
    moved = met.select("s", "size", F.concat("node", "ch").alias("node"), "end_n", "low", "high", F.expr("""inline(
      CASE WHEN edits = 1 THEN array(struct(pos + 1 AS pos, 1 AS edits))
           WHEN ch = substring(s, pos + 1, 1) THEN array(struct(pos + 1 AS pos, 0 AS edits), struct(pos + 2 AS pos, 3 AS edits))
           ELSE array(struct(pos + 1 AS pos, 1 AS edits), struct(pos AS pos, 1 AS edits)) END)"""))
    # 3: the word's last character is left out, and what is before it is a word.
    moved = moved.withColumn("_x", F.expr("substring(s, pos + 1, 1)"))
    low, high = _letters("_x")
    goes_on = (low.bitwiseAND(F.col("low")) != 0) | (high.bitwiseAND(F.col("high")) != 0)
    ends = (F.col("pos") == F.col("size")) & F.col("end_n").isNotNull()
    keep = F.when(F.col("edits") == 0, (F.col("pos") <= F.col("size")) & ((F.col("low") != 0) | (F.col("high") != 0))).otherwise(ends | ((F.col("edits") == 1) & (F.col("pos") < F.col("size")) & goes_on))
    return moved.where(keep).withColumn("edits", F.when((F.col("edits") >= 1) & ends, 2).otherwise(F.col("edits"))).select(*_STATE)


def trie_neighbours(words: DataFrame) -> DataFrame:
    """(word, near, near_n): ordered pairs of words of TRIE_LETTERS code points at most that are one edit apart; a pair may come twice.

    One join and one written table for each level; there are as many levels as the longest of these words has code points.
    """
    spelled = written(_spelled(words.where(F.char_length("word") <= TRIE_LETTERS)).sort("half"), "spelled")
    edges = written(trie_edges(spelled).repartitionByRange("depth", "node").sortWithinPartitions("depth", "node"), "edges")
    first, last = spelled.agg(F.min("half"), F.max("size")).first()
    found, states = [], None
    for depth in range(first or 1, last or 0):
        begun = spelled.where(F.col("half") == depth).select("s", "size", F.lit(depth).alias("pos"), F.expr(f"substring(s, 1, {depth})").alias("node"), F.lit(0).alias("edits"))
        going = begun if states is None else begun.unionByName(states.where("edits < 2").drop("end_n"))
        states = written(_advanced(going, edges.where(F.col("depth") == depth).drop("depth")), "states")
        found.append(states.where("edits = 2"))
    if not found:
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    plain = lambda c: F.expr(f"CASE WHEN {c} LIKE '<%' THEN substring({c}, 2) ELSE reverse(substring({c}, 2)) END")
    pairs = written(pairs.select(plain("s").alias("word"), plain("node").alias("near"), F.col("end_n").alias("near_n")), "pairs")
    discarded(spelled, edges)
    return pairs


def _left_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each word the hash of the whole (kind 0), of every text with one character left out (1) and with one masked at its place (2)."""
    for digest, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        codes = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        base = np.uint64(0xBF58476D1CE4E5B9)
        power = np.ones(len(codes) + 1, np.uint64)
        np.cumprod(np.full(len(codes), base), out=power[1:])
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1], dtype=np.uint64)])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        shorter = before[:-1] + (before[-1] - before[1:]) * inverse
        masked = before[-1] - codes * power[:-1] + power[:-1] * np.uint64(0x94D049BB133111EB)
        keys = np.concatenate([before[-1:], shorter, masked]).view(np.int64)
        kinds = np.repeat(np.array([0, 1, 2], np.int32), [1, len(codes), len(codes)])
        yield pa.RecordBatch.from_arrays([pa.array([digest] * len(keys), pa.string()), pa.array(kinds), pa.array(keys)], names=["id", "kind", "hash"])


def long_neighbours(words: DataFrame) -> DataFrame:
    """trie_neighbours() for words of TRIE_LETTERS code points or more: equal hashes give candidates, the words themselves decide."""
    long = written(words.where(F.char_length("word") >= TRIE_LETTERS).select(F.sha2("word", 256).alias("id"), "word", "n"), "long")
    keys = written(map_batches(long.select("id", "word"), _left_out, "id string, kind int, hash long").distinct(), "left-out")
    whole, less, masked = (keys.where(F.col("kind") == k).select(F.col("id").alias(i), "hash") for k, i in ((0, "b"), (1, "a"), (2, "a")))
    one = less.join(whole, "hash").select("a", "b")
    # Words with one character masked at one place are as many as there are letters at most.
    two = masked.join(masked.select(F.col("a").alias("b"), "hash"), "hash").where("a <> b").select("a", "b")
    pairs = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(two).distinct()
    named = pairs.join(long.select(F.col("id").alias("a"), "word"), "a").join(long.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    return named.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def variant_forms(words: DataFrame) -> DataFrame:
    """(word, n) with form, form_n, n_near and root; the words are distinct and of the letters of RUN.

    A word's form is its neighbour of largest n, of these the first in code-point order, if that n is RATIO times its own or more; root
    follows forms to the last, the word itself if it has none. Forms grow in n, so no walk comes back. An empty table gives no rows.
    """
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    pairs = trie_neighbours(words)
    if longest >= TRIE_LETTERS:
        pairs = pairs.unionByName(long_neighbours(words))
    best = pairs.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    out = words.join(best, "word", "left").withColumn("_top", -F.col("_best.less"))
    has = F.col("_top") >= RATIO * F.col("n")
    out = written(out.select("word", "n", F.when(has, F.col("_best.near")).alias("form"), F.when(has, F.col("_top")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "forms")
    steps = out.where("form is not null").select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    roots = steps.select(F.col("_from").alias("word"), F.col("_to").alias("root"))
    while True:  # at most as many rounds as the largest n has digits to the base RATIO
        further = roots.join(steps, F.col("root") == F.col("_from"), "left")
        roots = written(further.select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return out.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of whole texts with n, form, form_n, n_near, root: see counted_words() and variant_forms(). Other columns are ignored."""
    words = written(counted_words(docs, key, text), "words")
    return variant_forms(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE_OP13 = f"""
WITH RECURSIVE
t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [-1, -1, -1, -1, -1, -1, -1, -1]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{RUN}')) AS run FROM documents),
o AS (SELECT id, run, count(*) AS c FROM r WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END)) AS bytes FROM o),
h AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], bytes), lambda s, x: xor(tab[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
x AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) AS head, substring(word, i + 1) AS tail FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT x.word AS a, v.word AS b FROM x JOIN v ON v.word = x.head || x.tail
  UNION SELECT v.word, x.word FROM x JOIN v ON v.word = x.head || x.tail
  UNION SELECT y.word, z.word FROM x y JOIN x z ON y.i = z.i AND y.head = z.head AND y.tail = z.tail AND y.word <> z.word),
q AS (SELECT a, count(*) AS n_near, min(ROW(-n, b)) AS best FROM p JOIN v ON v.word = b GROUP BY a),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= {RATIO} * n THEN best[2] END AS form, CASE WHEN -best[1] >= {RATIO} * n THEN -best[1] END AS form_n
  FROM v LEFT JOIN q ON a = word),
g AS (SELECT word, word AS place FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.place WHERE f.form IS NOT NULL),
e AS (SELECT g.word, g.place AS root FROM g JOIN f ON f.word = g.place WHERE f.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN e USING (word)
"""


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLES = {"op13_spelling_variants": ORACLE_OP13}
