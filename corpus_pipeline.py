"""From raw documents to token ids: five stages, each over everything that the one before it kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, minhash, mixing, quality, suffixes
from tallybook.session import ship_package, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry score rejects go; it is learned from the labels of the documents that are here.

    Rows are judged by their text alone: repeated and keyless rows like any others, a null text as an empty one. Without
    labels nothing goes; an empty table gives no rows; other columns stay as they are.
    """
    ship_package(spark)
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; repeated rows count as copies.

    A document is an id with its text, so different texts under one id are compared like any others. Rows without an id
    are linked with nothing and all stay, as does one row of each empty text of an id. Texts may have any length; an empty table gives no rows.
    """
    ship_package(spark)
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # other columns may have any names
    known = named.where(F.col(key).isNotNull()).withColumn("_node", F.xxhash64(key, text))
    marked = minhash.near_duplicates(known.select("_node", F.col(text).alias("text")), "_node").select("_node", F.col("component_id").alias("_group")).distinct()
    first = known.select("_node", key).distinct().join(marked, "_node").groupBy("_group").agg(F.min(F.struct(key, "_node")).alias("_first"))
    kept = known.join(first.select("_first._node"), "_node", "left_semi")
    kept = kept.withColumn("_check", F.xxhash64(F.lit(7), text, key)).dropDuplicates(["_node", "_check"])  # nodes that clash both stay
    return kept.select(*named.columns).unionByName(named.where(F.col(key).isNull())).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that occur earlier are cut out of the texts; every document stays, n_chars is counted anew.

    Rows without an id keep their text, a null text becomes an empty one; of repeated rows one keeps its text and the others lose what
    it has; texts may have any length, other columns any names; an empty table gives no rows.
    """
    ship_package(spark)
    out = suffixes.deduplicated(docs, spans_name=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def stored_places(docs: DataFrame) -> DataFrame | None:
    """The columns of docs, as it is read from files, as c0, c1, ..., with _file and _at, a row's place; None where it doesn't come from files."""
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    try:
        return docs.select(*named, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return None


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix; those beyond its end, where too few sources are left to hold the weights, come last.

    The order is that of partitions and of the rows in them, so it is that of the written files by number; positions() finds it again. Sources are ranked by keys
    and hashes alone, and texts are joined to their positions once. Null ids and null sources are values like others, repeated rows all stay, texts may
    have any length, other columns any names; an empty table gives no rows.
    """
    ship_package(spark)
    placed = stored_places(docs)
    if placed is None:
        placed = stored_places(written(docs, "documents"))
    key, source = (f"c{docs.columns.index(c)}" for c in ("doc_id", "source"))
    order = mixing.pfair_mix(placed, key=key, source=source, carry=["_file", "_at"]).select("_file", "_at", "position")
    out = placed.join(order, ["_file", "_at"]).repartitionByRange("position").sortWithinPartitions("position")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def positions(docs: DataFrame) -> DataFrame | None:
    """doc_id and text of docs with position, a number that sorts rows as their files by number and as the rows in each; None where docs doesn't come from files.

    It is made of the file's part number, its number within the part and the row's place, so that nothing is counted, joined or shuffled.
    """
    placed = stored_places(docs)
    if placed is None:
        return None
    number = lambda p: F.coalesce(F.regexp_extract("_file", p, 1).try_cast("long"), F.lit(0))
    position = F.shiftleft(number(r"part-(\d+)"), 44) + F.shiftleft(number(r"-c(\d+)\."), 34) + F.col("_at")
    key, text = (F.col(f"c{docs.columns.index(c)}").alias(c) for c in ("doc_id", "text"))
    return placed.select(key, text, position.alias("position"))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with checksums of the ids and of their decoding, and a position that sorts texts as the mix does.

    One row for each row, repeated and keyless ones too; a null text has no tokens; an empty table gives no rows. The position is that in the stored table
    (see positions(); gaps between numbers mean nothing); it is null where the documents don't come from files.
    """
    ship_package(spark)
    placed = positions(docs)
    if placed is None:
        placed = docs.select("doc_id", "text", F.lit(None).cast("long").alias("position"))
    return bpe.encoded(placed, bpe.tokenizer_path(), tokens=True, carry="position")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixed_sources),
    ("bpe_encoding", bpe_tokens),
]

#: The stages are learned or iterative; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
