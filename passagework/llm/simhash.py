"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import keyed, staying, whole
from passagework.llm.components import components
from passagework.session import cut

#: A fingerprint is a ring of 8 segments of 8 bits.
SEGMENTS = 8
#: Members of one key that meet in one task; larger keys are cut into blocks, and blocks meet two by two.
BLOCK = 1024


def budgets(bits: int) -> list[int]:
    """Most differences a chain of 1, 2, ... 8 segments may have.

    If two rings differ in at most `bits` bits, some segment starts a chain whose every prefix of n segments differs
    in at most n / 8 of them.
    """
    return [bits * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def _fingerprint(text: bytes, words: int, seed: int) -> int:
    found = text.lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start:start + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprinter(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = pa.array([_fingerprint(t, words, seed) for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), made], names=["doc_id", "text_hash", "print"])
    return run


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, print): A-Z lower-cased, word shingles with repeats, a bit set where over half the hashes have it."""
    rows = keyed(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_fingerprinter(words, seed), f"doc_id {kind}, text_hash long, print long")


def _segment(at: int) -> Column:
    return F.shiftrightunsigned("print", 8 * (at % SEGMENTS)).bitwiseAND(255)


def _keys(bits: int) -> list[Column]:
    """What two linked prints must share, for each start of the ring.

    A chain begins with segments that agree; then come segments of which at most one differs. For each choice of that
    one, the others form the key. A place number in front keeps the keys of different choices apart.
    """
    allowed = budgets(bits)
    same, near = allowed.count(0), allowed.count(1)
    out = []
    for start in range(SEGMENTS):
        for skipped in range(near) if near else [None]:
            used = [start + k for k in range(same)] + [start + same + k for k in range(near) if k != skipped]
            key = F.lit(len(out)).cast("bigint")
            for at in used:
                key = F.shiftleft(key, 8).bitwiseOR(_segment(at))
            out.append(key)
    return out


def _chain_masks(start: int) -> list[np.uint64]:
    masks, mask = [], 0
    for n in range(SEGMENTS):
        mask |= 255 << (8 * ((start + n) % SEGMENTS))
        masks.append(np.uint64(mask))
    return masks


def _forest(prints: np.ndarray, side: np.ndarray, mixed: bool, start: int, allowed: list[int]) -> list[tuple[int, int]]:
    """Links that hold the cell's linked prints together: at most one fewer than there are prints."""
    apart = prints[:, None] ^ prints[None, :]
    linked = np.ones(apart.shape, bool)
    for mask, most in zip(_chain_masks(start), allowed, strict=True):
        # The chain's budgets, shortest first; the last is the whole ring, the Hamming check.
        left = np.flatnonzero(linked)
        linked.flat[left] = np.bitwise_count(apart.flat[left] & mask) <= most
    np.fill_diagonal(linked, False)
    if mixed:
        linked &= side[:, None] != side[None, :]
    waiting, out = np.ones(len(prints), bool), []
    for root in np.flatnonzero(linked.any(1)):
        if not waiting[root]:
            continue
        waiting[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            found = np.flatnonzero(linked[at] & waiting)
            waiting[found] = False
            out += [(at, f) for f in found]
            stack += list(found)
    return out


def _linker(bits: int):
    allowed = budgets(bits)
    choices = max(allowed.count(1), 1)
    width = 8 * (allowed.count(0) + max(allowed.count(1) - 1, 0))

    def solve(key: int, low: int, high: int, prints: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int]]:
        signed = prints.view(np.int64)
        for a, b in _forest(prints, side, low != high, (key >> width) // choices, allowed):
            yield int(signed[a]), int(signed[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(table: pa.Table, to_end: bool) -> tuple[list[tuple[int, int]], pa.Table]:
            key, low, high = (table.column(c).to_numpy() for c in ("key", "low", "high"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            starts = [0, *edges.tolist()]
            ends = [*edges.tolist(), len(key)]
            if not to_end:
                starts, ends = starts[:-1], ends[:-1]
            prints, side = table.column("print").to_numpy().view(np.uint64), table.column("block").to_numpy()
            found = [x for s, e in zip(starts, ends, strict=True) if e - s > 1
                     for x in solve(int(key[s]), low[s], high[s], prints[s:e], side[s:e])]
            return found, table.slice(ends[-1] if ends else 0)

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            if held.num_rows:
                found, held = links(held, False)
                yield batch_of(found)
        if held is not None and held.num_rows:
            yield batch_of(links(held, True)[0])
    return run


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) between distinct prints (column print) at most `bits` bits apart, enough of them to hold every
    component together.

    Candidates share a key of the ring (`_keys`); their chains are then checked against the budgets, and last the whole
    distance. A key with many prints is cut into blocks of bounded size that meet two by two, each pair of blocks in a
    cell of its own; a cell returns a spanning forest, never all its pairs.
    """
    rows = prints.select("print", F.explode(F.array(*_keys(bits))).alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = rows.join(shared, "key").select("key", "print", blocks.alias("blocks"), F.pmod(F.xxhash64("print"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block"))
    cells = met.select("key", "print", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "print", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(_linker(bits), "a long, b long")


def _labelled(docs: DataFrame, doc_id: str, text: str, words: int = 3, seed: int = 42, bits: int = 3) -> DataFrame:
    """(doc_id, text_hash, print, label, component_id, members): the rows with their component's label, least id and number of rows."""
    rows = cut(fingerprints(docs, doc_id, text, words, seed))
    nodes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    labels = components(links(nodes.select("print"), bits))
    named = nodes.join(labels, nodes["print"] == labels["node"], "left").select("print", "least_id", "n", F.coalesce("label", "print").alias("label"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("members"))
    return rows.join(named.join(least, "label").select("print", "label", "component_id", "members"), "print")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 3, seed: int = 42, bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, text_hash.

    Prints at `bits` or fewer differing bits are linked, and component_id is the least doc_id of all documents so
    joined. Equal prints are one node, so copies make no links. Null and empty texts have print zero and are linked
    like any other; null ids never are the least (a component of null ids alone has a null id); rows that repeat an id
    are judged each. An empty table gives no rows.
    """
    rows = _labelled(docs, doc_id, text, words, seed, bits)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id", "text_hash")


def one_of_each(docs: DataFrame, labelled: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents, all columns: of each component one row with the least id stays, of its texts the one of least hash.

    `labelled` has rows (doc_id, text_hash, label, component_id, members).
    """
    rows = cut(labelled.filter("members > 1").select(
        "doc_id", "text_hash", "label", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("least")))
    best = rows.filter("least").groupBy("label").agg(F.min("text_hash").alias("best"))
    judged = rows.join(best, "label").select("doc_id", F.col("text_hash").alias("mark"), (F.col("least") & (F.col("text_hash") == F.col("best"))).alias("kept"))
    return staying(docs, judged, doc_id, F.xxhash64(whole(text)))


def without_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents less those that `near_groups` joins to another: one row of each component stays."""
    return one_of_each(docs, _labelled(docs, doc_id, text, **options), doc_id, text)
