"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import keyed
from passagework.session import cut

#: Ranks are below this; whatever a look-up gives from here on means that the pair does not merge.
NEVER = (1 << 16) - 1
#: Stands before and behind a word's pieces; no pair with it merges.
EDGE = NEVER
#: Distinct stretches of text, and distinct words, a task remembers before it starts over.
REMEMBERED = 400_000
#: Bytes of a word up to which scanning lists is quicker than a heap.
SHORT = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _prime(least: int) -> int:
    return next(n for n in range(least | 1, 2 * least + 9, 2) if all(n % d for d in range(3, int(n ** 0.5) + 1, 2)))


class RankMap:
    """The mergeable pairs of a vocabulary as two literal arrays: a hash table without collisions.

    With `words`, only pairs whose bytes stand in one of these words are held, which keeps the literal small. A pair (left
    rank, right rank) is one whole number below 2^32. Its remainder by one prime names a group, the group has a shift, and
    the remainder by another prime plus the shift is the slot, which holds pair and rank. The primes' product
    exceeds 2^32, so two pairs of a group never start at the same slot and some shift always fits.
    """

    GROUPS = 65_539

    def __init__(self, ranks: dict[bytes, int], words: Iterable[bytes] | None = None):
        if max(ranks.values()) >= EDGE:
            raise ValueError("ranks must fit 16 bits")
        if words is None:
            met = ranks
        else:
            longest = max(map(len, ranks))
            met = {w[a:b]: ranks[w[a:b]] for w in words for a in range(len(w)) for b in range(a + 2, min(len(w), a + longest) + 1) if w[a:b] in ranks}
        groups: list[list[int]] = [[] for _ in range(self.GROUPS)]
        for piece, rank in met.items():
            for at in range(1, len(piece)):
                left, right = ranks.get(piece[:at]), ranks.get(piece[at:])
                if left is not None and right is not None:
                    groups[(left << 16 | right) % self.GROUPS].append((left << 16 | right) << 16 | rank)
        self.span = _prime(max(2 * sum(map(len, groups)), 65_537))
        # An empty slot reads as NEVER or more for every pair.
        slots, shifts = array("q", [NEVER]) * (2 * self.span), array("i", [0]) * self.GROUPS
        for group in sorted(range(self.GROUPS), key=lambda g: -len(groups[g])):
            places = [(entry >> 16) % self.span for entry in groups[group]]
            while any(slots[place + shifts[group]] != NEVER for place in places):
                shifts[group] += 1
            for place, entry in zip(places, groups[group], strict=True):
                slots[place + shifts[group]] = entry
        used = self.span + max(shifts)
        self.slots = F.split(F.lit(",".join(map(str, slots[:used]))), ",").cast("array<bigint>")
        self.shifts = F.split(F.lit(",".join(map(str, shifts))), ",").cast("array<int>")

    def rank(self, slots: Column, shifts: Column, left: Column, right: Column) -> Column:
        """The rank a pair merges to; NEVER or more if it does not."""
        pair = F.shiftleft(left.cast("bigint"), 16).bitwiseOR(right.cast("bigint"))
        slot = (pair % self.span).cast("int") + F.get(shifts, (pair % self.GROUPS).cast("int"))
        return F.get(slots, slot).bitwiseXOR(F.shiftleft(pair, 16))


def _let(value: Column, body) -> Column:
    """Binds a value inside a higher-order expression, where common parts are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), 0)


def merged(word: Column, table: RankMap) -> Column:
    """The ids of a word given as an array of its bytes' ranks.

    While some adjacent pair has a rank, the first pair of the least rank merges. The fold carries the pieces and the
    ranks of adjacent pairs, so a merge looks up its two new neighbours only.
    """
    def fold(slots: Column, shifts: Column) -> Column:
        def look(left: Column, right: Column) -> Column:
            return table.rank(slots, shifts, left, right)

        def merge(state: Column, least: Column) -> Column:
            def at(i: Column) -> Column:
                ids, gains, new = state["ids"], state["gains"], least.cast("int")
                return F.struct(
                    F.concat(F.slice(ids, 1, i - 1), F.array(new), F.slice(ids, i + 2, F.size(ids))).alias("ids"),
                    F.concat(F.slice(gains, 1, i - 2), F.array(look(F.get(ids, i - 2), new), look(new, F.get(ids, i + 1))),
                             F.slice(gains, i + 2, F.size(gains))).alias("gains"))
            return _let(F.array_position(state["gains"], least).cast("int"), at)

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state["gains"]), lambda least: F.when(least < NEVER, merge(state, least)).otherwise(state))

        def run(ids: Column) -> Column:
            gains = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids)), look)
            return F.aggregate(F.slice(ids, 1, F.size(ids) - 3), F.struct(ids.alias("ids"), gains.alias("gains")), step,
                               lambda s: F.slice(s["ids"], 2, F.size(s["ids"]) - 2))

        return F.when(F.size(word) < 2, word).otherwise(_let(F.concat(F.array(F.lit(EDGE)), word, F.array(F.lit(EDGE))), run))

    return _let(table.slots, lambda slots: _let(table.shifts, lambda shifts: fold(slots, shifts)))


class Pretokens:
    """Matches of a pattern, found once per distinct stretch of text.

    A space before a character that is not white space always begins a match of the supported pattern, so a text is cut there
    first, and only distinct stretches meet the pattern.
    """

    def __init__(self, pattern: str):
        self.pattern, self.cut, self.memo = regex.compile(pattern), re.compile(r"(?= [^\s\x1c-\x1f])"), {}

    def stretches(self, text: str) -> list[str]:
        return self.cut.split(text)

    def matches(self, stretch: str) -> list[str]:
        return self.pattern.findall(stretch)


def _glanced(pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = Pretokens(pattern)
        for batch in batches:
            found: Counter = Counter()
            for stretch, n in Counter(s for t in batch.column("text").to_pylist() for s in pre.stretches(t)).items():
                for m in pre.matches(stretch):
                    found[m] += n
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
    return run


def _spelled(spelling: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").cast(pa.binary()).to_pylist()
            yield pa.record_batch([batch.column("word"), pa.array([[spelling[b] for b in w] for w in words], pa.list_(pa.int32()))], names=["word", "bytes"])
    return run


def _merged_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold with a heap of ranks and links between pieces, whose time grows little faster than the word."""
    ends, before = list(range(1, len(word) + 1)), list(range(-1, len(word)))
    heap = [(r, at, at + 2) for at in range(len(word) - 1) if (r := ranks.get(word[at:at + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        # Pieces that merged meanwhile have other ends; a piece swallowed from the left ends at 0.
        if not middle or middle >= len(word) or ends[middle] != end:
            continue
        ends[at], ends[middle] = end, 0
        if end < len(word):
            before[end] = at
            if (r := ranks.get(word[at:ends[end]])) is not None:
                heapq.heappush(heap, (r, at, ends[end]))
        if at and (r := ranks.get(word[before[at]:end])) is not None:
            heapq.heappush(heap, (r, before[at], end))
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at:ends[at]]])
        at = ends[at]
    return out


def merged_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold as `merged` for one word of any length; while the word is short, with the same two lists."""
    if len(word) > SHORT:
        return _merged_long(word, ranks)
    edges, gains = list(range(len(word) + 1)), [ranks.get(word[at:at + 2], NEVER) for at in range(len(word) - 1)]
    while gains and (least := min(gains)) < NEVER:
        at = gains.index(least)
        del edges[at + 1], gains[at]
        if at < len(gains):
            gains[at] = ranks.get(word[edges[at]:edges[at + 2]], NEVER)
        if at:
            gains[at - 1] = ranks.get(word[edges[at - 1]:edges[at + 1]], NEVER)
    return [ranks[word[start:end]] for start, end in pairwise(edges)]


class _Memo(dict):
    """What `make` gives for a key, made once while remembered. Values are strings, which the garbage collector does not walk."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


def _encoder(pattern: str, carried: dict[str, list[int]], ranks: dict[bytes, int], with_ids: bool):
    """Per document: the ids in text order, each written with a comma before it, put together from distinct stretches, and these from
    distinct words; and the decoding of what was written, by concatenated pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = Pretokens(pattern)
        decimal, pieces = {rank: f",{rank}" for rank in ranks.values()}, {str(rank): piece for piece, rank in ranks.items()}
        words = _Memo(lambda word: "".join([decimal[i] for i in carried.get(word) or merged_bytes(word.encode(), ranks)]))
        written = _Memo(lambda stretch: "".join(map(words.__getitem__, pre.matches(stretch))))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                for memo in (words, written):
                    if len(memo) >= REMEMBERED:
                        memo.clear()
                # Without the first comma; no id is empty.
                listed = "".join(map(written.__getitem__, pre.stretches(text)))[1:]
                ids = listed.split(",") if listed else []
                rows.append((
                    len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b"".join(map(pieces.__getitem__, ids))).hexdigest(),
                    [int(i) for i in ids] if with_ids else None))
            made = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][:4 if with_ids else 3]
            yield pa.record_batch([batch.column("doc_id"), *[pa.array(list(c), k) for c, k, _ in zip(made, kinds, names, strict=False)]], names=["doc_id", *names])
    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", *, with_ids: bool = False,
           carried: int = 1 << 14, carried_bytes: int = 48, glance: int = 5_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    Each match of the pattern is encoded by itself. The frequent distinct words of a glance at about `glance` documents (at
    most `carried` of at most `carried_bytes` bytes each), which make up most of any text, are folded by Spark's
    higher-order functions over a literal rank map (`merged`), once each, and their ids carried to the tasks. The other words
    are folded by the same rule where they occur (`merged_bytes`), once per distinct stretch a task remembers. The result
    does not depend on which words are carried. Nothing is shuffled but the glance, and a lost task redoes its own
    documents only.

    Null text is the empty text: no ids, the digest of nothing. Rows that repeat an id, and null ids, each get a row.
    An empty table gives no rows.
    """
    ranks = read_ranks(ranks_path)
    rows = keyed(docs, doc_id, text)
    share = min(1.0, glance / max(rows.count(), 1))
    seen = rows.sample(share, 7).select("text").mapInArrow(_glanced(pattern), "word string, n long")
    often = cut(seen.filter(F.octet_length("word") <= carried_bytes).groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(carried))
    # `limit` leaves one partition; the fold is spread again.
    spread = often.select("word").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    spelling = [ranks[bytes([b])] for b in range(256)]
    table = RankMap(ranks, (w.encode() for w in often.select("word").toArrow().column(0).to_pylist()))
    made = spread.mapInArrow(_spelled(spelling), "word string, bytes array<int>").select("word", merged(F.col("bytes"), table).alias("ids")).toArrow()
    folded = dict(zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True))
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(_encoder(pattern, folded, ranks, with_ids), schema)
