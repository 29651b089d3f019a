"""Near-dedup at a similarity of 0.8: wide SimHash prints of five-word shingles, pigeonring chains, Hamming check.

Texts of Jaccard similarity 0.8 have shingle vectors at a cosine of 0.89, and so differ in 15 % of their print's bits:
of 64 bits 9.7, give or take 2.9, which is too blunt to decide by. Prints here have 512 bits, a ring of 128 segments of 4 bits;
0.8 means 77.6 differing bits, give or take 8.1, and 90 are allowed. `simhash` is the same method at few bits.

Unlike prints share a head of h bits by chance, once in 2^h. So heads grow by a bit with each doubling of the prints, and further
rings, the same bits in other orders, make up for what longer heads miss: what chance brings together grows with about the fourth
root of the prints for each of them, 4 at 45,000 and 10 at 10 million.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import keyed
from passagework.llm.components import components
from passagework.llm.simhash import one_of_each
from passagework.session import cut

#: 64-bit words of a print, segments of its ring, and bits at the head of a chain that agree outright, at least.
WIDTH, SEGMENTS, HEAD = 8, 128, 20
#: Bits of a head beyond the logarithm of the number of prints; share of differing bits at a similarity of 0.8, and how many such pairs may share no head.
SPARE, APART, MISSED = 5, 0.1516, 0.015
#: Bits in which linked prints may differ, and what a chain of all segments may differ in; shorter chains in proportion.
BITS, CHAIN = 90, 128
#: Prints of one key that meet in one task.
BLOCK = 1024
#: Every so manieth chain is searched first, so that the others need not link again what holds together by then.
STEP = 16
#: Odd multipliers, one for each word of a print, made from their numbers.
MIX = np.array([xxhash.xxh64_intdigest(bytes([n]), 11) | 1 for n in range(WIDTH)], np.uint64)


def wide_print(text: bytes, words: int, seed: int) -> bytes:
    """A bit is set where over half the distinct shingles' hashes have it. Fewer words: the whole sequence; none: zero."""
    found = text.lower().split()
    if not found:
        return bytes(8 * WIDTH)
    shingles = map(b" ".join, zip(*[found[k:] for k in range(words)], strict=False)) if len(found) >= words else [b" ".join(found)]
    hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64))
    ones = np.zeros(64 * WIDTH, np.int64)
    for start in range(0, len(hashes), 4080):
        mixed = hashes[start:start + 4080, None] * MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= MIX[0]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        for low in range(0, len(bits), 255):
            # 255 bits at most add up in a byte.
            ones += bits[low:low + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def _printer(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [wide_print(t, words, seed) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(made, pa.binary())], names=["doc_id", "text_hash", "print"])
    return run


def rings(n: int) -> tuple[int, np.ndarray]:
    """For n prints: the bits of a head, and a row per chain, the order in which it reads the bits of a print.

    Chains of the first ring start at each of its segments, those of the others wherever a head ends.
    """
    size = 64 * WIDTH
    head = max(HEAD, (max(n, 1) - 1).bit_length() + SPARE)
    alike = (1 - APART) ** head
    # Heads that overlap agree together: their clumps count.
    found = SEGMENTS * alike * (1 - (1 - APART) ** (size // SEGMENTS))
    more = max(0, math.ceil((-math.log(MISSED) - found) / (alike * (size // head))))
    orders = [np.roll(np.arange(size), -start) for start in range(0, size, size // SEGMENTS)]
    for k in range(more):
        mixed = np.argsort([xxhash.xxh64_intdigest(b"%d" % bit, k) for bit in range(size)])
        orders += [np.roll(mixed, -start) for start in range(0, size - head + 1, head)]
    return head, np.array(orders, np.int16)


def _bits(prints: pa.Array) -> np.ndarray:
    """The bits of each print, the first of them its highest."""
    return np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(-1, 8 * WIDTH), axis=1)


def _heads(head: int, orders: np.ndarray):
    """A row per print and chain: the chain's number, and the bits of its head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                bits = _bits(part.column("print"))
                key = np.broadcast_to(np.arange(len(orders)), (len(bits), len(orders)))
                for k in range(head):
                    key = key << 1 | bits[:, orders[:, k]]
                nodes = np.repeat(part.column("node").to_numpy(), len(orders))
                yield pa.record_batch([pa.array(key.ravel()), pa.array(nodes)], names=["key", "node"])
    return run


def _from_start(prints: pa.Array, order: np.ndarray) -> np.ndarray:
    """The prints as words, each with its bits in its own order."""
    read = [np.packbits(np.take_along_axis(_bits(prints.slice(low, 4096)), order[low:low + 4096].astype(np.int64), axis=1), axis=1) for low in range(0, len(prints), 4096)]
    return np.concatenate(read).view(np.uint64)


def _linked(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Which rows stay within every chain's budget, word after word, and then within `bits` over the whole ring."""
    at, total = np.arange(len(left)), np.zeros(len(left), np.int64)
    for n in range(WIDTH):
        total = total + np.bitwise_count(left[at, n] ^ right[at, n] if len(right) > 1 else left[at, n] ^ right[0, n])
        stays = total <= (CHAIN * (n + 1) // WIDTH if n + 1 < WIDTH else bits)
        at, total = at[stays], total[stays]
    return at


def _forest(prints: np.ndarray, label: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links that hold together the cell's linked prints of different labels. Each print meets those not yet reached."""
    waiting, stack = np.arange(len(prints)), []
    while len(waiting):
        if not stack:
            stack, waiting = [waiting[0]], waiting[1:]
            continue
        at = stack.pop()
        meets = waiting[label[waiting] != label[at]]
        found = meets[_linked(prints[meets], prints[at:at + 1], bits)]
        waiting = waiting[~np.isin(waiting, found, assume_unique=True)]
        stack += found.tolist()
        for f in found.tolist():
            yield at, f


def _linker(bits: int, head: int, orders: np.ndarray):
    def solve(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate([[0], ends[:-1]])
        node, label = table.column("node").to_numpy(), table.column("label").to_numpy()
        prints = _from_start(table.column("print").combine_chunks(), orders[table.column("key").to_numpy() >> head])
        # Most cells are two prints, which chance has given one head; they are judged together.
        two = starts[ends - starts == 2]
        two = two[label[two] != label[two + 1]]
        at = two[_linked(prints[two], prints[two + 1], bits)] if len(two) > 1 else two[[len(_linked(prints[t:t + 1], prints[t + 1:t + 2], bits)) > 0 for t in two]]
        pairs = [np.stack([at, at + 1], axis=1)]
        for k in np.flatnonzero(ends - starts > 2):
            low, high = int(starts[k]), int(ends[k])
            found = list(_forest(prints[low:high], label[low:high], bits))
            if found:
                pairs.append(np.array(found) + low)
        at = np.concatenate(pairs).astype(np.int64)
        ends = [x[at[:, k]] for x in (node, label) for k in (0, 1)]
        return pa.record_batch([pa.array(x) for x in ends], names=["a", "b", "l_a", "l_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            key, low, high = (held.column(c).to_numpy() for c in ("key", "low", "high"))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            if len(ends):
                yield solve(held.slice(0, int(ends[-1])), ends)
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield solve(held, np.array([held.num_rows]))
    return run


def _met(cells: DataFrame, nodes: DataFrame, bits: int, head: int, orders: np.ndarray) -> DataFrame:
    """Links from rows (key, node, low, high, label), a cell for each (key, low, high): one for each two labels that are linked."""
    rows = cells.join(nodes.select("node", "print"), "node").select("key", "low", "high", "node", "label", "print")
    found = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_linker(bits, head, orders), "a long, b long, l_a long, l_b long")
    return found.groupBy(F.least("l_a", "l_b"), F.greatest("l_a", "l_b")).agg(F.min(F.struct("a", "b")).alias("link")).select("link.a", "link.b")


def _named(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows with `label`: the component of the node, by links so far."""
    labels = components(links).withColumnsRenamed({"node": "l_node", "label": "l_label"})
    return rows.join(labels, F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("l_label", "node")).drop("l_node", "l_label")


def wide_links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between nodes (node long, print), enough to hold every component of what is found together.

    Candidates share the head of a chain. First they meet inside blocks of bounded size: keys of up to `BLOCK` prints are
    one block, and a large group of near copies grows together over the blocks of its many keys: over a part of the chains first, so that
    the others link only what is still apart, and a large group does not get links anew from each chain. Then, in keys of several blocks
    whose prints are still apart, prints of the largest component meet all others, and the others one another, never itself.
    """
    head, orders = rings(nodes.count())
    heads = nodes.select("node", "print").mapInArrow(_heads(head, orders), "key long, node long")
    shared = heads.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(heads.join(shared, "key"))
    block = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / BLOCK)).cast("int")
    early = F.shiftright("key", head) % STEP == 0
    cells = met.select("key", "node", block.alias("low"), block.alias("high"))
    first = cut(_met(cells.filter(early).withColumn("label", F.col("node")), nodes, bits, head, orders))
    first = cut(first.unionByName(_met(_named(cells.filter(~early), first), nodes, bits, head, orders)))
    hot = met.filter(F.col("n") > BLOCK)
    if hot.isEmpty():
        return first
    named = cut(_named(hot, first).select("key", "node", "n", "label"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("n_all")).filter(F.col("n_all") > F.col("top.m")).select(
        "key", F.col("top.label").alias("top"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("tops"), F.ceil((F.col("n_all") - F.col("top.m")) / BLOCK).cast("int").alias("others"))
    on_top = F.col("label") == F.col("top")
    dealt = named.drop("n").join(largest, "key").withColumn(
        "own", F.when(on_top, F.pmod(F.xxhash64("node"), "tops")).otherwise(F.col("tops") + F.pmod(F.xxhash64("node"), "others")).cast("int"))
    other = F.explode(F.sequence(F.when(on_top, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("others") - 1))
    cells = dealt.select("key", "node", "label", "own", other.alias("other")).select("key", "node", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return first.unionByName(_met(cells, nodes, bits, head, orders))


def _labelled(docs: DataFrame, doc_id: str, text: str, words: int, seed: int, bits: int) -> DataFrame:
    rows = keyed(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    rows = cut(rows.mapInArrow(_printer(words, seed), f"doc_id {kind}, text_hash long, print binary"))
    # Numbers are fixed by the write.
    nodes = cut(rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    labels = components(wide_links(nodes, bits)).withColumnRenamed("node", "l_node")
    named = nodes.join(labels, F.col("node") == F.col("l_node"), "left").select("print", "least_id", "n", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("members"))
    return rows.join(named.join(least, "label").select("print", "label", "component_id", "members"), "print")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, seed: int = 42, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, component_id (the least doc_id of all documents so joined), text_hash.

    Documents are linked whose prints differ in `bits` bits or fewer and share some chain: a head that agrees, followed
    by words whose differences stay in proportion. Sharing a head is a matter of chance: by estimate 0.985 of pairs at a
    similarity of 0.8 do, and more above it, at any number of documents; of those at 0.8 itself, 0.94 also pass the Hamming check.
    Chains a print grow with about the fourth root of the documents.

    Null and empty texts have print zero and are linked to each other; null ids never are the least (a component of null ids
    alone has a null id); rows that repeat an id are judged each. An empty table gives no rows.
    """
    return _labelled(docs, doc_id, text, words, seed, bits).select("doc_id", "component_id", "text_hash")


def without_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 5, seed: int = 42, bits: int = BITS) -> DataFrame:
    """The documents, all columns: of each component one row with the least id stays, of its texts the one of least hash."""
    return one_of_each(docs, _labelled(docs, doc_id, text, words, seed, bits), doc_id, text)
