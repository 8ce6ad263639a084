"""Readers: case-blind CSV, statement texts, mail files, newest file of a year."""

from __future__ import annotations

from email import message_from_bytes, policy
from email.utils import getaddresses, parsedate_to_datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.relational import one_per_key


def csv_lower(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """CSV with a header; header names are trimmed and lower-cased, values stay text."""
    df = spark.read.option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def header_row(rows: DataFrame, seq: str, cells: str, words: list[str], first: int = 15) -> DataFrame:
    """The first of the first rows whose cells name all words, else row 0: one row with `seq`."""
    return rows.where(F.col(seq) < first).agg(F.coalesce(F.min(F.when(_names_all(cells, words), F.col(seq))), F.lit(0)).alias(seq))


def header_rows(rows: DataFrame, key: str, seq: str, cells: str, words: list[str], first: int = 15) -> DataFrame:
    """header_row() of every sheet (key) at once: key and `seq`."""
    return rows.where(F.col(seq) < first).groupBy(key).agg(F.coalesce(F.min(F.when(_names_all(cells, words), F.col(seq))), F.lit(0)).alias(seq))


def _names_all(cells: str, words: list[str]) -> Column:
    lowered = F.transform(cells, lambda c: F.lower(F.coalesce(c, F.lit(""))))
    has = lambda w: F.exists(lowered, lambda c: F.contains(c, F.lit(w)))
    return reduce(lambda a, b: a & b, map(has, words), F.lit(True))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, line of text files; a file is read whole so that its lines keep their order."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))


def newest_for_year(files: DataFrame, fy_digits: str) -> DataFrame:
    """Of files (company, name, modified) each company's by rank: db1{fy}, db{fy}, db, then the newest."""
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    rank = F.when(stem == f"db1{fy_digits}", 0).when(stem == f"db{fy_digits}", 1).when(stem == "db", 2).otherwise(3)
    return one_per_key(files.withColumn("rank", rank), ["company"], [F.col("rank"), F.desc("modified"), F.col("name")])


MAIL_SCHEMA = "mailbox string, msg_id string, rec_dat timestamp, sender string, recipients array<string>, subject string, body string, attachments array<struct<filename:string,content_type:string,size_bytes:int>>"


def _mail(mailbox: str, content: bytes) -> dict:
    m = message_from_bytes(content, policy=policy.default)
    part = m.get_body(("html", "plain"))
    try:
        received = parsedate_to_datetime(m["Date"]) if m["Date"] else None
    except ValueError:
        received = None
    files = [{"filename": a.get_filename() or "file", "content_type": a.get_content_type(), "size_bytes": len(a.get_payload(decode=True) or b"")} for a in m.iter_attachments()]
    addresses = [a.lower() for _, a in getaddresses(m.get_all("To", []) + m.get_all("Cc", [])) if a]
    return {
        "mailbox": mailbox, "msg_id": (m["Message-ID"] or "").strip().strip("<>").lower() or None, "rec_dat": received,
        "sender": next((a.lower() for _, a in getaddresses(m.get_all("From", [])) if a), None), "recipients": list(dict.fromkeys(addresses)),
        "subject": str(m["Subject"] or ""), "body": part.get_content() if part else "", "attachments": files,
    }


def mail_files(spark: SparkSession, path: str) -> DataFrame:
    """RFC 822 files of mailbox folders as a table; encoded headers, address lists and bodies are decoded in the tasks."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -2).alias("mailbox"), "content")

    def parse(frames):
        for f in frames:
            rows = [_mail(b, bytes(c)) for b, c in zip(f["mailbox"], f["content"])]
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MAIL_SCHEMA.replace(",filename", "").split(", ")])
            out["rec_dat"] = pd.to_datetime(out["rec_dat"], utc=True)
            yield out

    return raw.mapInPandas(parse, MAIL_SCHEMA)


def mail_window(mails: DataFrame, since: str | None = None, until: str | None = None, newest: int | None = None) -> DataFrame:
    """Mails of a half-open day window; the newest so many of each mailbox where asked for."""
    out = mails
    if since:
        out = out.where(F.col("rec_dat") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.where(F.col("rec_dat") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp"))
    if newest:
        from tallybook.operators.relational import top_n_per

        out = top_n_per(out, ["mailbox"], [F.desc("rec_dat"), F.col("msg_id")], newest)
    return out
