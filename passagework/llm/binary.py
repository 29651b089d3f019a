"""Token ids in ORC files: stripes of run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagework.llm.common import keyed, portions
from passagework.llm.units import Remembered, bytes_where, runs

#: Bytes outside ASCII white space, which ends every unit of the supported tokenizers.
_SOLID = bytes_where(lambda b: b not in b" \t\n\v\f\r")
#: The folder, inside that of the token files and hidden from plain reads, with one row per file.
_FILES = "_files"


def parted(tokenizer: Tokenizer) -> np.ndarray:
    """Kinds of bytes for `runs`: letters, and marks that the tokenizer always parts from letters; so that words are met without them."""
    split = lambda text: [s for s, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] if tokenizer.pre_tokenizer else [text]
    special = "".join(x.content for x in tokenizer.get_added_tokens_decoder().values())
    marks = [m for m in ".,;:!?" if m not in special and all(len(split(text)) == 3 for text in (f"a{m}a", f"Z{m}z", f"{m}a{m}"))]
    return np.array([1 if chr(b).isascii() and chr(b).isalpha() else 2 if chr(b) in marks else 0 for b in range(256)], np.uint8)


def spaced_ids(tokenizer: Tokenizer, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units free of ASCII white space, and how many each has, encoded as one text with spaces between them.

    Offsets tell whose a token is.
    """
    texts = [u.decode() for u in units]
    made = tokenizer.encode(" ".join(texts), add_special_tokens=False)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    first = np.searchsorted(np.array([start for start, _ in made.offsets], np.int64), begins)
    return np.array(made.ids, np.int32), np.diff(np.append(first, len(made.ids)))


def _encoder(spec: str, end_id: int):
    """Ids of sorted documents, each with its end id, and how many ids of the same file stand before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(spec)
        memory, kinds = Remembered(lambda units: [spaced_ids(tokenizer, units)]), parted(tokenizer)
        written = 0
        for batch in batches:
            for part, held, at in portions(batch, 4 << 20):
                units, bounds = runs(held, at, _SOLID, kinds)
                ids, lengths = memory.gather(memory.codes(units))
                ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
                ids = np.insert(ids, ends[1:], end_id)
                offsets = ends + np.arange(len(ends))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(written + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))],
                    names=["doc_id", "at", "n_tokens", "ids"])
                written += int(offsets[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, end_id: int = 1,
                 file_bytes: int = 256 << 20, stripe_bytes: int = 16 << 20, stride: int = 1000, false_positives: float = 0.01) -> None:
    """Writes the ids of every whole text below `path`, in ascending order of document ids, and a table of the files.

    `tokenizer` is the path of a tokenizers .json file whose units end at white space. Each document's ids, without the
    tokenizer's own begin or end but with `end_id` behind them, are one row (doc_id, at, n_tokens, ids) of an ORC file; `at`
    counts the ids before it in that file. Files follow each other in the order of ids: texts are range-sorted, one
    task and file for about `file_bytes` of text, and encoded behind the sort. Stripes of about `stripe_bytes` can be
    read by tasks of their own; each `stride` rows have index entries (least and greatest values) and Bloom filters on doc_id
    with the given rate of false positives. The files' table has each file's rows, ids and least and greatest doc_id.

    Null texts are empty: their only id is the end id. Null ids stand first. Rows that repeat an id follow each other
    (in an order fixed by their text) and each keep their ids. An empty table writes no rows. A lost task writes its file anew.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    added = json.loads(spec).get("added_tokens") or []
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that look at their surroundings are not supported")
    rows = keyed(docs, doc_id, text)
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-size // file_bytes))
    # The hash spreads rows that share an id, such as null, over several files.
    order = ["doc_id", "hash", "place"]
    sorted_rows = rows.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["doc_id"]
    encoded = sorted_rows.select("doc_id", "text").mapInArrow(_encoder(spec, end_id), f"doc_id {kind}, at long, n_tokens long, ids array<int>")
    encoded.write.mode("overwrite").options(**{
        "compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives}).orc(path)
    named = spark.read.schema(encoded.schema).orc(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"))
    files_table = named.groupBy("file").agg(
        F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_ids"), F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"),
        F.count_if(F.col("doc_id").isNull()).alias("n_null"))
    # One row a file: small enough for one task at any size of the corpus.
    in_order = Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("int"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files_table.withColumn("before", F.coalesce(F.sum("n_ids").over(in_order), F.lit(0))).write.mode("overwrite").orc(f"{path}/{_FILES}")


def _read(spark: SparkSession, path: str, files: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Rows of the token files that the given rows of the files' table name; a condition reaches the stripes' indexes."""
    rows = spark.read.orc(path)
    if wanted is not None:
        names = [r[0] for r in files.select("file").collect()]
        rows = spark.read.schema(rows.schema).orc([f"{path}/{n}" for n in names]) if names else rows.limit(0)
        rows = rows.filter(wanted)
    known = files.select(F.col("file").alias("f"), "before")
    return rows.select("*", F.col("_metadata.file_name").alias("file")).join(known, F.col("file") == F.col("f")).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(f"{path}/{_FILES}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): all documents, with the ids of all documents before them counted."""
    return _read(spark, path, _files(spark, path))


def find_tokens(spark: SparkSession, path: str, doc_ids: Sequence) -> DataFrame:
    """The same rows for a short list of document ids: of files whose span has one, row groups whose Bloom filter may hold one."""
    spans = [F.lit(i).between(F.col("least"), F.col("greatest")) for i in doc_ids]
    hit = spans[0] if spans else F.lit(False)
    for other in spans[1:]:
        hit = hit | other
    return _read(spark, path, _files(spark, path).filter(hit), F.col("doc_id").isin(*doc_ids))


def tokens_between(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The same rows for documents with an id at a place in [low, high) of the whole sequence: only files that cross it are read."""
    files = _files(spark, path).filter((F.col("before") < high) & (F.col("before") + F.col("n_ids") > low))
    found = _read(spark, path, files, F.lit(True))
    return found.filter((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        held = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        sums = [zlib.crc32(held[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as read: the CRC-32 of the ids as little-endian unsigned 32-bit numbers."""
    return tokens.mapInArrow(_checksums, f"doc_id {dict(tokens.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")
