"""Exact dedup: groups of equal texts by a 128-bit content hash, compared byte by byte."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import keyed, staying, whole


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, keep: str = "smallest",
                digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by (hash, bytes): the hash spreads them, the bytes part texts whose hashes collide. Equal rows are
    combined before the shuffle, so a text that fills a third of the table travels once per task. Only groups of two
    or more meet the rows again, over hashes alone; a hot group is split there by the adaptive skew join.

    Null text is the empty text. Null ids never win over an id; in a group of null ids all stay. Rows that repeat an
    id and its text are counted each and share their decision. An empty table gives no rows.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = keyed(docs, doc_id, text).withColumn("hash", digest(F.col("text")))
    groups = (
        rows.groupBy("hash", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select("hash", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size", F.lit(True).alias("grouped"))
    )
    joined = rows.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256")).join(groups, ["hash", "text_sha256"], "left")
    keep_id = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, keep: str = "smallest") -> DataFrame:
    """The documents, all columns, less those that `exact_dedup` drops: one row of each text, also of repeated rows and null ids."""
    judged = exact_dedup(docs, doc_id, text, keep=keep).filter("group_size > 1").select("doc_id", F.col("text_sha256").alias("mark"), "kept")
    return staying(docs, judged, doc_id, F.sha2(whole(text), 256))
