"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import keyed, portions

#: The hash shifts one bit a byte and has 16 bits, so it sees the last 16 bytes.
WINDOW = 16
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


class Chunker:
    """Cuts where the gear hash of the last 16 bytes has `bits` leading zeros, at least `least` and at most `most` bytes apart
    and never inside a character."""

    def __init__(self, bits: int, least: int, most: int):
        if least < WINDOW or most < least + 4:
            raise ValueError("a chunk holds the hash's window, and its most exceeds its least by a character")
        self.bits, self.least, self.most = bits, least, most

    def places(self, held: np.ndarray) -> list[int]:
        """Where a chunk may end, over several texts laid end to end: a chunk holds the window, so it never sees two texts."""
        h = GEAR[held]
        for k in (1, 2, 4, 8):
            wider = h.copy()
            wider[k:] += h[:-k] << k
            h = wider
        fits = h >> (WINDOW - self.bits) == 0
        fits[:-1] &= (held[1:] & 0xC0) != 0x80
        return (np.flatnonzero(fits) + 1).tolist()

    def cut(self, held: np.ndarray, places: list[int], start: int, end: int) -> list[int]:
        """The chunks' ends of the text at start:end."""
        out, at = [], bisect_left(places, start)
        while end - start > self.least:
            at = bisect_left(places, start + self.least, at)
            stop = places[at] if at < len(places) else end
            if stop > start + self.most:
                stop = min(start + self.most, end)
                while stop < end and held[stop] & 0xC0 == 0x80:
                    stop -= 1
            if stop >= end:
                break
            out.append(stop)
            start = stop
        if end > start:
            out.append(end)
        return out


def _texts(batch: pa.RecordBatch, chunker: Chunker) -> Iterator[tuple[int, bytes, list[int]]]:
    """Row number, bytes and chunk bounds of each text of a batch."""
    row = 0
    for _, held, at in portions(batch):
        places, raw = chunker.places(held), held.tobytes()
        for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield row, raw[start:end], [0, *[e - start for e in chunker.cut(held, places, start, end)]]
            row += 1


def _digests(chunker: Chunker):
    """A row per distinct chunk of each text, at its first place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, digests = [], []
            for row, text, bounds in _texts(batch, chunker):
                found = {xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)}
                rows += [row] * len(found)
                digests += found
            taken = batch.select(["doc_id", "text_hash"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*taken.columns, pa.array(digests, pa.binary())], names=["doc_id", "text_hash", "digest"])
    return run


def _remover(chunker: Chunker, least_run: int):
    """Drops runs of chunks that an earlier document, or an earlier place of the text, has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elsewhere = batch.column("elsewhere").to_pylist()
            rows = []
            for row, text, bounds in _texts(batch, chunker):
                known, kept, removed, dropped, spans = set(elsewhere[row] or ()), [], 0, 0, 0
                held: list[tuple[int, int]] = []

                def close() -> None:
                    nonlocal removed, dropped, spans
                    if held and held[-1][1] - held[0][0] >= least_run:
                        removed += held[-1][1] - held[0][0]
                        dropped += len(held)
                        spans += 1
                    elif held:
                        kept.append(text[held[0][0]:held[-1][1]])
                    held.clear()

                for a, b in zip(bounds, bounds[1:], strict=False):
                    digest = xxhash.xxh3_128_digest(text[a:b])
                    if digest in known:
                        held.append((a, b))
                    else:
                        close()
                        kept.append(text[a:b])
                        known.add(digest)
                close()
                rest = b"".join(kept)
                rows.append((len(text), len(bounds) - 1, dropped, removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode()))
            made = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch(
                [batch.column("doc_id"), *[pa.array(list(c), k) for c, k in zip(made, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_chunks", "n_dropped", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def drop_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, bits: int = 5, least: int = 16, most: int = 128,
                         least_run: int = 120) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chunks, n_dropped, n_removed, n_spans, kept_sha256, and `kept`, what stays, as text.

    Texts are cut by content, so an insertion moves the cuts next to it only. A chunk stays in the document of the least
    id that has it, at its first place there; elsewhere it is repeated. Runs of repeated chunks of at least
    `least_run` bytes go; shorter ones stay, for a few common words say nothing.

    Each document sends a chunk's digest once; digests are counted with map-side combine, and only those of two or more
    documents meet the rows again. Null text is empty; a null id comes after every id, and documents of null ids alone
    keep their common chunks; rows that repeat an id keep them too, being one document. An empty table gives no rows.
    """
    chunker = Chunker(bits, least, most)
    rows = keyed(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    found = rows.mapInArrow(_digests(chunker), f"doc_id {kind}, text_hash long, digest binary")
    first = found.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = (
        found.join(first, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("digest").alias("elsewhere"))
        .withColumnsRenamed({"doc_id": "r_id", "text_hash": "r_hash"})
    )
    joined = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    return joined.select("doc_id", "text", "elsewhere").mapInArrow(
        _remover(chunker, least_run), f"doc_id {kind}, n_bytes long, n_chunks long, n_dropped long, n_removed long, n_spans long, kept_sha256 string, kept string")
