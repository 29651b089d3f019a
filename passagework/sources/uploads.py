"""Uploaded files: kind from content, hash, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First bytes of each kind, in hex; parts that make a ZIP a presentation.
PDF, OLE2 = "255044462D", "D0CF11E0A1B11AE1"
ZIPS = ("504B0304", "504B0506", "504B0708")
SLIDE_PARTS = ("ppt/presentation.xml", "ppt/slides/")


def file_kind(content: Column) -> Column:
    """pdf, ppt or pptx by content, else null; the file name is not trusted."""
    head = F.hex(F.substring(content, 1, 8))
    zipped = F.lit(False)
    for magic in ZIPS:
        zipped = zipped | F.startswith(head, F.lit(magic))
    slides = F.lit(False)
    for part in SLIDE_PARTS:
        slides = slides | F.contains(content, F.lit(part).cast("binary"))
    return F.when(F.startswith(head, F.lit(PDF)), "pdf").when(head == OLE2, "ppt").when(zipped & slides, "pptx")


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Accepted files with their kind and content hash; others carry a null kind."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", "content", file_kind(F.col("content")).alias("kind"), F.sha2("content", 256).alias("content_hash"))


def dedupe_uploads(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """What to do with each upload: `insert`, `replace` a failed row, or refuse as `duplicate`."""
    # Several old rows may share a hash: one that did not fail settles it.
    held = documents.groupBy("session_id", "content_hash").agg(
        F.min_by("document_id", F.struct(F.col("status") == "failed", "document_id")).alias("existing_id"),
        F.bool_and(F.col("status") == "failed").alias("failed"),
    )
    return uploads.join(held, ["session_id", "content_hash"], "left").withColumn(
        "action", F.when(F.col("existing_id").isNull(), "insert").when(F.col("failed"), "replace").otherwise("duplicate")
    ).drop("failed")
