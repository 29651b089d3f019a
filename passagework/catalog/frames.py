"""The test tables read as the frames the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.functions.citations import shingles
from passagework.functions.vectors import hashed_embedding
from passagework.operators.retrieval import postings
from passagework.plans.retrieve import Index
from passagework.session import cut

WIDTH = 64


def spread(df: DataFrame) -> DataFrame:
    """Gives the one file of a small test table to every core. Operators never do this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as one chunk, owned by its source."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("doc_id").alias("document_id"),
        F.col("source").alias("user_id"), "text",
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def embedded_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = whole_documents(spark, sf)
    return docs.select("chunk_id", "chunk_index", "document_id", "user_id", hashed_embedding(WIDTH)("text").alias("vector"))


def embedded_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages(spark, sf).withColumn("vector", hashed_embedding(WIDTH)("text"))


def stored_postings(spark: SparkSession, sf: str, stem: bool = False) -> DataFrame:
    """Postings as a table: searching reads them twice, for statistics and for scores."""
    return cut(postings(whole_documents(spark, sf), stem=stem))


def document_index(spark: SparkSession, sf: str, stem: bool = False) -> Index:
    docs = whole_documents(spark, sf)
    return Index(docs, embedded_documents(spark, sf), stored_postings(spark, sf, stem))


def passage_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a benchmark passage word for word; graded by the quality label.

    A document holding the passage holds all its inner five-word runs, so one of them (the one
    with the least hash) is an exact join key; the whole passage is then looked up in the text.
    """
    def runs(text: str):
        inner = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"^[^a-z0-9]*[a-z0-9]+", ""), r"[a-z0-9]+[^a-z0-9]*$", "")
        return F.transform(shingles(inner), lambda s: F.xxhash64(s))

    asked = passages(spark, sf).select("query_id", F.col("text").alias("passage"), F.array_min(runs("text")).alias("run"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    keyed = (
        docs.select("doc_id", F.explode(F.transform(shingles("text"), lambda s: F.xxhash64(s))).alias("run"))
        .join(asked.select("query_id", "run"), "run").select("doc_id", "query_id").distinct()
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return (
        keyed.join(docs, "doc_id").join(asked.select("query_id", "passage"), "query_id")
        .filter(F.contains("text", F.col("passage")))
        .join(labels, "doc_id", "left")
        .select("query_id", F.col("doc_id").alias("chunk_id"), (0.5 + 0.5 * F.coalesce("quality", F.lit(0))).cast("double").alias("gain"))
    )
