"""License scans by diagonal voting: which license texts and phrases a document holds, and where.

Only DataFrame functions. Every rolling word k-gram of every text is hashed and joined with the k-gram positions of the
templates; a hit votes for the diagonal (word position minus template position) on which a whole copy would lie. Words
put in or left out move a copy to a neighbouring diagonal, so neighbours of one template are merged into a span, and
a span counts if enough of its template's k-grams have voted within a stretch that is not much longer. Only votes are
shuffled; texts stay in the tasks that read them, and a vote compares the words themselves, not only their hash.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallybook.session import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words: all of ASCII but digits and lower-case letters (texts are lower-cased before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Wordings that the licenses prescribe for notices, with labels; these may be found in part.
NOTICES = [
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
]

#: Words of a k-gram: pairs for phrases and notices shorter than LONG words, else fours (pairs are too common to vote for long texts).
SHORT_K, LONG_K, LONG = 2, 4, 12
#: Diagonals of one notice at most this far apart are merged.
GAP = 6
#: Part of a notice's k-grams that have to vote, and part of the span's places that hold a vote.
COVERED, DENSE = 0.6, 0.5
#: Bits of a template's k-grams that one long holds.
_WORD = 60


def _lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _with_grams(rows: DataFrame, text: str) -> DataFrame:
    """Adds _words, and _pairs and _fours: a hash for each run of 2 and of 4 words."""
    rows = rows.withColumn("_words", F.array_remove(F.split(_lowered(F.col(text)), BETWEEN, -1), ""))
    rows = rows.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    part = lambda c, start, less: F.slice(c, F.lit(start), F.greatest(F.size(c) - less, F.lit(0)))
    rows = rows.withColumn("_pairs", F.zip_with(part("_one", 1, 1), part("_one", 2, 1), lambda a, b: F.xxhash64(a, b)))
    return rows.withColumn("_fours", F.zip_with(part("_pairs", 1, 2), part("_pairs", 3, 2), lambda a, b: F.xxhash64(a, b))).drop("_one")


def _entries(phrases: list, notices: list) -> list[dict]:
    """The templates with their k, the k-grams they need and how far their diagonals may lie apart; phrases have to be whole."""
    out = []
    for exact, pairs in ((True, phrases), (False, notices)):
        for text, label in pairs:
            words = _python_words(text)
            k = SHORT_K if exact or len(words) < LONG else LONG_K
            grams = len(words) - k + 1
            if grams < 1:
                raise ValueError(f"a template needs {k} words or more: {text!r}")
            out.append({"template": len(out), "label": label, "exact": exact, "k": k, "grams": grams, "gap": 0 if exact else GAP, "need": grams if exact else -(-grams * round(COVERED * 100) // 100), "text": text, "words": words})
    return out


def _python_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _literal(spark: SparkSession, rows: list[tuple], kinds: dict[str, str]) -> DataFrame:
    """A few rows as a DataFrame without an RDD."""
    made = json.dumps([dict(zip(kinds, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(made), f"array<struct<{', '.join(f'{c}: {k}' for c, k in kinds.items())}>>")))


def license_spans(docs: DataFrame, phrases: list | None = None, notices: list | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every template in every row of docs, and one row of template -1 for each row itself.

    Columns: _part, key, _digest, n_words (these name a row's text), template, first_word and last_word (words from 0), start (the least
    diagonal), covered (the template's k-grams that voted), label, exact, score (covered in parts of all), found, copies. Rows that
    share key and text in one input partition are one, with their number in copies of the -1 row. Null texts are empty; texts
    without words and empty tables have no spans; one row's words and spans have to fit a task.
    """
    spark = docs.sparkSession
    entries = _entries(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    longs = -(-max([e["grams"] for e in entries], default=1) // _WORD)
    grams = [(e["template"], e["k"], p, " ".join(e["words"][p : p + e["k"]])) for e in entries for p in range(e["grams"])]
    places = _literal(spark, [*grams, (-1, 0, 0, "")], {"_template": "int", "_k": "int", "_at": "int", "_gram": "string"})
    hashed = _with_grams(places, "_gram")
    # One row for each k-gram of the templates, whatever the input: safe to broadcast.
    places = hashed.select("_template", "_k", "_at", "_gram", F.when(F.col("_k") == LONG_K, F.col("_fours")[0]).when(F.col("_k") == SHORT_K, F.col("_pairs")[0]).otherwise(F.lit(0)).alias("_hash"))

    rows = docs.select(F.spark_partition_id().alias("_part"), F.col(key).alias("_key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("_digest"), F.col(text).alias("_text"))
    rows = _with_grams(rows, "_text").select("_part", "_key", "_digest", "_words", F.size("_words").cast("long").alias("n_words"), F.size("_pairs").alias("_n2"), F.concat(F.array(F.lit(0).cast("long")), "_pairs", "_fours").alias("_all"))
    # The array is never empty; the outer form keeps Spark from testing that by computing it a second time in a filter.
    each = rows.select("_part", "_key", "_digest", "_words", "n_words", "_n2", F.posexplode_outer("_all").alias("_p", "_hash"))
    # Place 0 is the row itself; then all pairs, then all fours.
    pair = F.col("_p") <= F.col("_n2")
    k = F.when(F.col("_p") == 0, F.lit(0)).when(pair, F.lit(SHORT_K)).otherwise(F.lit(LONG_K))
    at = F.when(pair, F.col("_p")).otherwise(F.col("_p") - F.col("_n2")) - 1
    same = (k == F.col("_k")) & ((F.col("_k") == 0) | (F.concat_ws(" ", F.slice("_words", F.greatest(at + 1, F.lit(1)), F.greatest(F.col("_k"), F.lit(1)))) == F.col("_gram")))
    votes = each.join(F.broadcast(places), (each["_hash"] == places["_hash"]) & same).select("_part", "_key", "_digest", "n_words", "_template", "_at", at.cast("long").alias("_word"))

    ident = ["_part", "_key", "_digest", "n_words"]
    bits = [f"_b{j}" for j in range(longs)]
    voted = votes.groupBy(*ident, "_template", (F.col("_word") - F.col("_at")).alias("_diagonal")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_word").alias("_first"), F.max("_word").alias("_last"),
        *[F.bit_or(F.expr(f"CASE WHEN _at DIV {_WORD} = {j} THEN shiftleft(1L, _at % {_WORD}) ELSE 0L END")).alias(b) for j, b in enumerate(bits)],
    )
    facts = [(e["template"], e["label"], e["exact"], e["k"], e["grams"], e["gap"], e["need"]) for e in entries]
    facts = _literal(spark, facts, {"_template": "int", "label": "string", "exact": "boolean", "_k": "int", "_grams": "int", "_gap": "int", "_need": "int"})
    voted = voted.join(F.broadcast(facts), "_template", "left")
    along = Window.partitionBy(*ident, "_template").orderBy("_diagonal")
    apart = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(along) > F.col("_gap"), F.lit(False))
    spans = voted.withColumn("_new", apart.cast("int")).withColumn("_span", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*ident, "_template", "_span", "label", "exact", "_k", "_grams", "_need").agg(F.min("_diagonal").alias("start"), F.min("_first").alias("first_word"), F.max("_last").alias("_last"), F.max("_n").alias("copies"), *[F.bit_or(b).alias(b) for b in bits])
    covered = sum((F.bit_count(b) for b in bits), F.lit(0))
    dense = F.col("covered") >= DENSE * (F.col("_last") - F.col("first_word") + 1)
    return spans.withColumn("covered", covered).select(
        "_part", F.col("_key").alias(key), "_digest", "n_words", F.col("_template").alias("template"), "first_word", (F.col("_last") + F.coalesce(F.col("_k"), F.lit(1)) - 1).alias("last_word"), "start",
        "covered", "label", "exact", (F.col("covered") / F.col("_grams")).alias("score"), F.coalesce((F.col("covered") >= F.col("_need")) & (F.col("exact") | dense), F.lit(False)).alias("found"), "copies",
    )


def license_scan(docs: DataFrame, phrases: list | None = None, notices: list | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the phrases, first_word and last_word are the least and greatest of their starts (null
    without any); base_labels are the phrases' labels, labels those of found notices too, distinct, sorted and joined by commas ("" if none);
    score is the largest part of a found template's k-grams that voted, 0 without any. Null and empty texts have no words;
    a null key is a value like any other; repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
    """
    entries = _entries(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    names = sorted({e["label"] for e in entries})
    if len(names) > 62:
        raise ValueError("at most 62 labels")
    spans = license_spans(docs, phrases, notices, key, text)
    base = F.col("found") & F.col("exact")
    number = F.array_position(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), F.col("label"))
    bit = F.expr("shiftleft(1L, cast(_number - 1 as int))")
    spans = spans.withColumn("_number", number)
    out = spans.groupBy("_part", key, "_digest", "n_words").agg(
        F.max(F.when(F.col("template") == -1, F.col("copies"))).alias("_copies"), F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.coalesce(F.bit_or(F.when(base, bit)), F.lit(0)).alias("_base"), F.coalesce(F.bit_or(F.when(F.col("found"), bit)), F.lit(0)).alias("_found"),
        F.coalesce(F.max(F.when(F.col("found"), F.col("score"))), F.lit(0.0)).alias("score"),
    )
    told = lambda c: F.concat_ws(",", *[F.when(F.col(c).bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)])
    out = out.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    return out.select(key, "n_words", "n_base", "first_word", "last_word", told("_base").alias("base_labels"), told("_found").alias("labels"), "score")


def op11_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same definition with words compared as text."""
    entries = _entries(PHRASES, NOTICES)
    grams = ", ".join(f"({e['template']}, {e['k']}, {p}, '{' '.join(e['words'][p : p + e['k']])}')" for e in entries for p in range(e["grams"]))
    facts = ", ".join(f"({e['template']}, '{e['label']}', {str(e['exact']).lower()}, {e['grams']}, {e['gap']}, {e['need']})" for e in entries)
    return f"""
WITH grams(template, k, place, gram) AS (VALUES {grams}),
facts(template, label, exact, grams, gap, need) AS (VALUES {facts}),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
f AS (
  SELECT doc_id, pos, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3 FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
g AS (
  SELECT doc_id, pos, 2 AS k, word || ' ' || w1 AS gram FROM f WHERE w1 IS NOT NULL
  UNION ALL SELECT doc_id, pos, 4, word || ' ' || w1 || ' ' || w2 || ' ' || w3 FROM f WHERE w3 IS NOT NULL),
v AS (SELECT doc_id, template, place, pos, pos - place AS diagonal FROM g JOIN grams USING (k, gram)),
m AS (
  SELECT v.*, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos) > gap AS apart FROM v JOIN facts USING (template)),
s AS (
  SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS span FROM m),
t AS (
  SELECT doc_id, template, min(diagonal) AS start, count(DISTINCT place) AS covered, max(pos) - min(pos) + 1 AS wide FROM s GROUP BY doc_id, template, span),
ok AS (
  SELECT doc_id, label, exact, start, covered / grams::DOUBLE AS score FROM t JOIN facts USING (template)
  WHERE covered >= need AND (exact OR covered >= {DENSE} * wide)),
r AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM ok GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r USING (doc_id)
"""


QUERIES = {"op11_license_diagonals": op11_license_diagonals}
ORACLES = {"op11_license_diagonals": _oracle()}
