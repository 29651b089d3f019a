"""Gold questions: reading, writing, and making them from headings or responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.text import let, strip
from passagework.session import cut

GOLD_SCHEMA = "question string, relevant_chunk_ids array<string>, graded map<string,double>, document_ids array<string>, note string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw): the lines of text files with their numbers from 1, however the files are split over tasks.

    A task numbers the lines of its splits; one row per split carries the counts across, by file and place of the split in it.
    """
    read = spark.read.text(path, lineSep="\n")
    rows = cut(read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                           F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw")))
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # One row per split of a file.
    upto = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return rows.join(before, ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "raw")


def _entries(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, parsed."""
    lines = lines.withColumn("raw", strip("raw")).filter((F.col("raw") != "") & ~F.startswith("raw", F.lit("//")))
    return lines.withColumn("entry", F.from_json("raw", GOLD_SCHEMA, {"mode": "PERMISSIVE"}))


_BAD = "entry.question is null or entry.relevant_chunk_ids is null"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions from JSON lines; blank lines and `//` comments are skipped.

    A bad line fails the read, naming file and line; so does a set with no question. Files are read in splits; lines are
    numbered only where one is bad.
    """
    parsed = _entries(spark.read.text(path, lineSep="\n").withColumnRenamed("value", "raw"))
    found, bad = parsed.agg(F.count("*"), F.count_if(F.expr(_BAD))).first()
    if bad:
        first = _entries(numbered_lines(spark, path)).filter(_BAD).orderBy("file", "line").select("file", "line").first()
        raise ValueError(f"{first['file']}:{first['line']} is not a valid gold entry")
    if not found:
        raise ValueError(f"{path} contained no gold queries")
    return parsed.select(
        F.substring(F.sha2("entry.question", 256), 1, 16).alias("query_id"), "entry.question",
        F.array_distinct("entry.relevant_chunk_ids").alias("relevant_chunk_ids"),
        "entry.graded", "entry.document_ids", F.coalesce("entry.note", F.lit("")).alias("note"),
    )


def qrels_of(gold: DataFrame) -> DataFrame:
    """Long form: one row per relevant chunk, with its gain when grades are given."""
    long = gold.select("query_id", "graded", F.explode("relevant_chunk_ids").alias("chunk_id"))
    graded = F.coalesce(F.size("graded") > 0, F.lit(False))
    gain = F.when(graded, F.coalesce(F.try_element_at("graded", F.col("chunk_id")), F.lit(0.0))).otherwise(F.lit(1.0))
    return long.select("query_id", "chunk_id", gain.alias("gain"))


def gold_lines(gold: DataFrame) -> DataFrame:
    """One JSON object per question: ids sorted, empty optional fields left out."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    entry = F.struct(
        "question", F.array_sort("relevant_chunk_ids").alias("relevant_chunk_ids"),
        filled("graded"), filled("document_ids"), F.nullif("note", F.lit("")).alias("note"),
    )
    return gold.select(F.to_json(entry, {"ignoreNullFields": "true"}).alias("value"))


def write_gold(gold: DataFrame, path: str) -> None:
    gold_lines(gold).write.mode("overwrite").text(path)


def gold_from_headings(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(question, heading) joined to every chunk under that heading: the long-form answers."""
    return questions.join(chunks.select("heading", "chunk_id", "document_id"), "heading").select(
        "question", "heading", "chunk_id", "document_id"
    )


def unmatched_headings(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    return questions.join(chunks.select("heading").filter(F.col("heading").isNotNull()).distinct(), "heading", "left_anti")


def gold_from_responses(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """A question written for a chunk becomes a gold row answered by that chunk."""
    skipped = F.instr(F.substring(F.upper("response"), 1, 20), "SKIP") > 0
    question = let(F.split("response", "\n")[0], lambda s: F.regexp_replace(strip(s), "^[\"']|[\"']$", ""))
    return (
        responses.filter(F.col("response").isNotNull())
        .withColumn("response", strip("response"))
        .filter((F.col("response") != "") & ~skipped)
        .join(chunks, "chunk_id")
        .select(
            question.alias("question"), F.array("chunk_id").alias("relevant_chunk_ids"),
            F.array("document_id").alias("document_ids"), F.array_join("heading_path", " › ").alias("note"),
        )
    )
