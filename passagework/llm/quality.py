"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import keyed, whole
from passagework.session import cut

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"


def _numbered(words: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Each distinct word's number, and the text as numbers."""
    seen: dict[bytes, int] = {}
    return seen, np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 3:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k:len(again) + k] |= again
    return int(inside.sum())


def _repeated_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += bool(line.strip())
        seen.add(line)
    return again


def _buckets(seen: dict[bytes, int], ids: np.ndarray, size: int) -> np.ndarray:
    """Hashed single words and word pairs of a text."""
    hashes = np.fromiter(map(crc32, seen), np.uint64, len(seen))[ids]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    return (np.concatenate([hashes, pairs]) % np.uint64(size)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _counter(trusted: frozenset, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                found = _buckets(*_numbered(text.split()), size)
                np.add.at(raw, found, 1)
                if key in trusted:
                    np.add.at(target, found, 1)
        used = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])
    return run


def _scorer(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars = pc.utf8_length(batch.column("text")).to_pylist()
            rows = []
            for text, n_chars in zip(_texts(batch), chars, strict=True):
                words = text.split()
                seen, ids = _numbered(words)
                grams = _buckets(seen, ids, len(weights))
                rows.append((
                    len(words), n_chars - (len(text) - len(text.translate(None, SPACE))), len(text) - len(text.translate(None, SYMBOLS)),
                    _repeated_lines(text), _repeated(ids, len(seen)), float(weights[grams].mean()) if len(grams) else 0.0))
            made = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)]],
                                  names=["doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"])
    return run


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", *, buckets: int = 1 << 16,
            labelled_rows: int = 20_000, trusted_kept: float = 0.99) -> DataFrame:
    """One row per document: doc_id, text_hash, the five counts, score, base_failed, kept.

    The score is the mean, over a text's single words and word pairs hashed to `buckets`, of
    log(p_target / p_raw): two multinomials with one added to each bucket. The raw one counts every document whole; the
    target counts the trusted documents among a fixed sample of at most `labelled_rows` labelled rows (the least by a
    hash of the id). The threshold parts trusted from rejected rows of that sample best, but keeps at least the share
    `trusted_kept` of the trusted ones. A document is kept if the plain rules pass and its score reaches the threshold.

    The weights (one number per bucket) and the sampled ids are all that travels to tasks. Null text has no words; null
    ids are scored but never trusted; rows that repeat an id are judged each; without usable labels the plain rules
    decide alone. An empty table gives no rows.
    """
    rows = keyed(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    sample = [tuple(r) for r in (
        labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).collect())]
    trusted = frozenset(k for k, good in sample if good == 1)
    counted = rows.mapInArrow(_counter(trusted, buckets), "bucket long, raw long, target long")
    found = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] += found["target"]
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum()) if found["target"].sum() else np.zeros(buckets)
    kind = dict(rows.dtypes)["doc_id"]
    scored = cut(rows.mapInArrow(_scorer(weights), f"doc_id {kind}, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"))
    scored = scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    threshold = _threshold(scored, sample, trusted_kept) if trusted else -math.inf
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def passing(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, that `quality` keeps."""
    failed = quality(docs, labels, doc_id, text, **options).filter(~F.col("kept")).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = F.xxhash64(whole(text)).eqNullSafe(F.col("__hash")) & F.col(doc_id).eqNullSafe(F.col("__id"))
    return docs.join(failed, same, "left_anti")


def _threshold(scored: DataFrame, sample: list[tuple], trusted_kept: float) -> float:
    """From the sampled rows' scores, of which there are as many as the sample has ids."""
    spark = scored.sparkSession
    kind = dict(scored.dtypes)["doc_id"]
    judged = scored.filter(~F.col("base_failed")).groupBy("doc_id").agg(F.min("score").alias("score")).join(
        F.broadcast(spark.createDataFrame(sample, f"doc_id {kind}, quality int")), "doc_id").select("score", "quality").toPandas()
    good = np.sort(judged.loc[judged["quality"] == 1, "score"].to_numpy())
    bad = np.sort(judged.loc[judged["quality"] != 1, "score"].to_numpy())
    if not len(good):
        return -math.inf
    limit = good[math.floor((1 - trusted_kept) * len(good))]
    if not len(bad):
        return float(limit)
    tries = np.unique(np.concatenate([good[good <= limit], bad[bad <= limit], [limit]]))
    gain = (len(good) - np.searchsorted(good, tries)) / len(good) + np.searchsorted(bad, tries) / len(bad)
    best = int(np.argmax(gain))
    # Half way to the next lower score, so that unseen documents near the edge are treated alike.
    below = np.concatenate([good, bad])
    below = below[below < tries[best]]
    return float((tries[best] + below.max()) / 2) if len(below) else float(tries[best])
