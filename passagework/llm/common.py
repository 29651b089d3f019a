"""What several operators share: the word pattern, text columns, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.session import cut

#: A word is a run of anything but ASCII white space (fixed by the result contracts).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text) only, whatever other columns the input has; null text is empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))


def staying(docs: DataFrame, judged: DataFrame, doc_id: str, mark: Column) -> DataFrame:
    """The documents, all columns, less those judged to go; of kept rows that repeat an id and a mark, one stays.

    `judged` has rows (doc_id, mark, kept), one for each row of a group of two or more; `mark` is the documents' own.
    Repeats are combined before they are shuffled, so a row ingested very often travels once per task.
    """
    judged = cut(judged.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "kept"))
    same = mark.eqNullSafe(F.col("__mark")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    rest = docs.join(judged.filter(~F.col("kept")).drop("kept").distinct(), same, "left_anti")
    again = judged.filter("kept").groupBy("__id", "__mark").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if again.isEmpty():
        return rest
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.join(again, same).groupBy("__id", "__mark").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return rest.join(again, same, "left_anti").unionByName(once)


def ranked(df: DataFrame, order: list, sums_before: dict[str, Column], rank: str | None = None) -> DataFrame:
    """Running sums (and 0-based ranks) over the whole frame in a sorted order, without one window over all rows.

    The rows are range-sorted and written once; each sorted partition is then summed on its own, and one row per
    partition carries the sums across. Ties in `order` fall either way.
    """
    inputs = {**sums_before, **({rank: F.lit(1).cast("bigint")} if rank else {})}
    sorted_rows = cut(
        df.select("*", *[e.alias(f"__v_{n}") for n, e in inputs.items()]).orderBy(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftright("__at", 33))
    totals = sorted_rows.groupBy("__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in inputs])
    # One row per sorted partition.
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__t_{n}").over(upto), F.lit(0)).alias(f"__o_{n}") for n in inputs])
    inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = sorted_rows.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(f"__i_{n}") for n in inputs])
    return summed.join(offsets, F.col("__part") == F.col("__p")).select(
        *df.columns, *[(F.col(f"__i_{n}") + F.col(f"__o_{n}")).alias(n) for n in inputs])


def portions(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about `most` bytes of text or one row, each with its text as one byte array and the texts' offsets."""
    texts = batch.column("text").cast(pa.large_binary())
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start), held[at[start]:at[end]], at[start:end + 1] - at[start]
        start = end
