"""Ranked lexical search: branch-and-bound over tries of frequency-ordered term vectors (document FP-trees)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.llm.common import keyed, portions
from passagework.llm.units import binary, bytes_where, runs
from passagework.session import cut

#: Bytes of terms: ASCII letters and digits, and everything beyond ASCII (fixed by the result contract).
_TERM = bytes_where(lambda b: b >= 128 or bytes([b]).isalnum())
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Documents and term places of one tree, documents of a leaf, distinct terms that share a tree.
TREE_DOCS, TREE_PLACES, LEAF, TREE_TERMS = 1 << 15, 1 << 22, 64, 1 << 13


def _terms(held: np.ndarray, at: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Lower-cased terms of texts, and before which of them each text begins."""
    return runs(_LOWER[held], at, _TERM)


def _item_terms(text: str) -> Counter:
    held = np.frombuffer(text.encode(), np.uint8)
    return Counter(_terms(held, np.array([0, len(held)]))[0].to_pylist())


def _restricted(vocabulary: list[bytes]):
    """Per document the number of its terms, and those of the vocabulary, by their places there, with their occurrences."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            for part, held, at in portions(batch):
                found, bounds = _terms(held, at)
                coded = found.dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = place[coded.indices.to_numpy()] if len(found) else np.empty(0, np.int64)
                n = np.diff(bounds)
                own = np.repeat(np.arange(len(n)), n)[term >= 0]
                keys, tf = np.unique(own * size + term[term >= 0], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size).astype(np.int32))
                yield pa.record_batch([
                    part.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array((keys % size).astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tfs"])
    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array(held), pa.array(df[held])], names=["term", "df"])
    return run


@dataclass
class Group:
    """Items searched over one tree: their numbers, and for each the terms (by places in the group) with their weights."""

    numbers: list[int]
    #: The block's vocabulary to places in the group, rarest last; -1 for other terms.
    place: np.ndarray
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    size: int


def grouped(items: Sequence[tuple[int, Counter]], vocabulary: dict[bytes, int], df: np.ndarray, weight: np.ndarray) -> list[Group]:
    """Items in groups of at most TREE_TERMS distinct terms (or one item), most frequent terms first."""
    cuts, held = [[]], set()
    for number, counts in items:
        own = set(counts)
        if cuts[-1] and len(held | own) > TREE_TERMS:
            cuts.append([])
            held = set()
        held |= own
        cuts[-1].append((number, counts))
    made = []
    for part in cuts:
        used = np.array(sorted({vocabulary[t] for _, counts in part for t in counts}), np.int64)
        used = used[np.argsort(-df[used], kind="stable")]
        place = np.full(len(vocabulary), -1, np.int64)
        place[used] = np.arange(len(used))
        terms, weights = [], []
        for _, counts in part:
            own = np.array([vocabulary[t] for t in counts], np.int64)
            worth = weight[own] * np.array(list(counts.values()), np.int64)
            terms.append(place[own[worth > 0]])
            weights.append(worth[worth > 0])
        made.append(Group([n for n, _ in part], place, terms, weights, len(used)))
    return made


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds per unit of weight: grows with tf, falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Tree:
    """A trie over documents sorted by their term vectors, most frequent term first.

    A node is a stretch of that order: all documents whose vectors begin with the same path. Stretches of at most LEAF documents,
    or of equal vectors, are leaves; small neighbouring branches share one. Each node has the largest occurrence count of each
    term and the least m below it.
    """

    def __init__(self, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, size: int):
        key = terms.astype(">u4").tobytes()
        edges = (4 * at).tolist()
        spelled = [key[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.order = np.array(sorted(range(len(spelled)), key=spelled.__getitem__), np.int64)
        n = np.diff(at)[self.order]
        moved = np.repeat(at[self.order], n) + np.arange(len(terms)) - np.repeat(np.cumsum(n) - n, n)
        self.at, self.terms, tfs, self.m = np.append(0, np.cumsum(n)), terms[moved], tfs[moved].astype(np.int64), m[self.order]
        self.gain = _gain(tfs, np.repeat(self.m, n))
        self.stretch, self.children = [(0, len(n), 0)], []
        while len(self.children) < len(self.stretch):
            self.children.append(self._branches(*self.stretch[len(self.children)]))
        nodes = len(self.stretch)
        self.most, self.least = np.zeros((nodes, size), np.int64 if tfs.max() >> 31 else np.int32), np.empty(nodes, np.int64)
        for k in range(nodes - 1, -1, -1):
            lo, hi, _ = self.stretch[k]
            if self.children[k]:
                self.least[k] = self.least[self.children[k]].min()
                self.most[k] = self.most[self.children[k]].max(axis=0)
            else:
                a, b = self.at[lo], self.at[hi]
                self.least[k] = self.m[lo:hi].min()
                np.maximum.at(self.most[k], self.terms[a:b], tfs[a:b])

    def _path(self, doc: int) -> np.ndarray:
        return self.terms[self.at[doc]:self.at[doc + 1]]

    def _branches(self, lo: int, hi: int, depth: int) -> list[int]:
        """Adds a node's children, which are named by their places; none for a leaf."""
        if hi - lo <= LEAF:
            return []
        first, last = self._path(lo), self._path(hi - 1)
        shared = min(len(first), len(last))
        apart = np.flatnonzero(first[depth:shared] != last[depth:shared])
        depth = depth + int(apart[0]) if len(apart) else shared
        if depth == len(first) == len(last):
            return []
        lengths = np.diff(self.at[lo:hi + 1])
        next_term = np.where(lengths > depth, self.terms[np.minimum(self.at[lo:hi] + depth, len(self.terms) - 1)], -1)
        edges = [lo, *(np.flatnonzero(np.diff(next_term)) + lo + 1).tolist(), hi]
        made, begun = [], lo
        for k in range(1, len(edges)):
            # Closes a stretch of small branches before a branch that does not fit in with it.
            if edges[k - 1] > begun and edges[k] - begun > LEAF:
                made.append((begun, edges[k - 1], depth))
                begun = edges[k - 1]
        made.append((begun, hi, depth))
        self.stretch += made
        return list(range(len(self.stretch) - len(made), len(self.stretch)))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node a score that no document below it exceeds."""
        return (_gain(self.most[:, terms].astype(np.int64), self.least[:, None]) * weights).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, size: int, enough) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first, best bound first: (documents, scores) of leaves whose bound is at least `enough()` and above 0."""
        bound, worth = self.bounds(terms, weights), np.zeros(size, np.int64)
        worth[terms] = weights
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < max(enough(), 1):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bound.__getitem__)
                continue
            lo, hi, _ = self.stretch[node]
            a = self.at[lo]
            scores = np.add.reduceat(worth[self.terms[a:self.at[hi]]] * self.gain[a:self.at[hi]], self.at[lo:hi] - a)
            yield self.order[lo:hi], scores


class _Best:
    """An item's best (score, doc_id), equal scores by ascending id, null last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def enough(self) -> int:
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: Sequence) -> None:
        self.rows = sorted([*self.rows, *((-s, i is None, i) for s, i in zip(scores.tolist(), ids, strict=True))])[:self.k]


def _trees(group: Group, m: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> tuple[Tree, np.ndarray] | None:
    """The tree of documents with a term of the group, and which documents these are."""
    place = group.place[terms]
    own = np.repeat(np.arange(len(m)), np.diff(at))
    order = np.lexsort((place, own))
    order = order[place[order] >= 0]
    if not len(order):
        return None
    docs, first = np.unique(own[order], return_index=True)
    return Tree(np.append(first, len(order)), place[order], tfs[order], m[docs], group.size), docs


def _searcher(groups: list[Group], n_docs: int, n_terms: int, k: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: _Best(k) for group in groups for number in group.numbers}

        def search(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, lists = rows.column("doc_id").chunk(0), rows.column("terms").chunk(0)
            m = 100 - 25 + 25 * rows.column("n").to_numpy() * n_docs // n_terms
            at = lists.offsets.to_numpy().astype(np.int64)
            at, terms, tfs = at - at[0], lists.flatten().to_numpy(), rows.column("tfs").chunk(0).flatten().to_numpy()
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            for group in groups:
                made = _trees(group, m, at, terms, tfs)
                if made is None:
                    continue
                tree, docs = made
                for number, own, weights in zip(group.numbers, group.terms, group.weights, strict=True):
                    mine = best[number]
                    for where, scores in tree.search(own, weights, group.size, mine.enough):
                        good = np.flatnonzero(scores >= mine.enough())
                        good = good[np.lexsort((rank[docs[where[good]]], -scores[good]))[:k]]
                        if len(good):
                            mine.add(scores[good], ids.take(pa.array(docs[where[good]])).to_pylist())

        held, n, places = [], 0, 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                ends = batch.column("terms").offsets.to_numpy().astype(np.int64)
                fit = int(np.searchsorted(ends, ends[start] + TREE_PLACES - places, "right")) - 1
                stop = min(max(fit, start + (not held)), start + TREE_DOCS - n, batch.num_rows)
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    n, places, start = n + stop - start, places + int(ends[stop] - ends[start]), stop
                if start < batch.num_rows:
                    search(held)
                    held, n, places = [], 0, 0
        if held:
            search(held)
        rows = [(number, -s, i) for number, mine in best.items() for s, _, i in mine.rows]
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), id_type), strict=True)], names=["item", "score", "doc_id"])
    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """Rows (item_id, text) in lists of about `block_bytes` of text."""
    held, size = [], 0
    for item_id, text in items.toLocalIterator():
        held.append((item_id, text))
        size += len(text) + 64
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           *, k: int = 20, block_bytes: int = 16 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Terms are runs of ASCII letters, digits and anything beyond ASCII; only A-Z are lower-cased. A document's score for an item sums
    w * (10^9 * tf div (1000 * tf + 12 * m)) over the item's terms, repeats included: w = floor(1000 ln((2 N + 2) / (2 df + 1))) and
    m = 75 + 25 n N div L, with N documents that have a term, L terms in all, n in the document, df documents that hold the term.

    Items go to the tasks in blocks of about `block_bytes` of text. Documents are cut to the block's terms, whole texts read, and
    written once. Each task sorts its documents' vectors, most frequent term first, into tries of bounded size, and finds each item's
    best by depth-first branch-and-bound: a node's largest occurrence counts and least m bound every score below it, and branches
    below the k-th score so far are left out. Tasks hand on k rows an item, which one window by item ranks; its partial limit runs
    in the tasks.

    Null and empty texts, of documents or items, have no terms: no rows. Null ids come last among equal scores. Documents that
    repeat an id each count and may each be found; items that repeat an id each get their ranks. Empty tables give no rows.
    """
    rows, spark = keyed(docs, doc_id, text), docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    kinds = dict(rows.dtypes)["doc_id"], asked.dtypes[0][1]
    id_type = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    found = spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score long")
    for block in _blocks(asked, block_bytes):
        counts = [_item_terms(t) for _, t in block]
        vocabulary = {t: p for p, t in enumerate(sorted(set().union(*counts)))}
        if not vocabulary:
            continue
        vectors = cut(rows.mapInArrow(_restricted(list(vocabulary)), f"doc_id {kinds[0]}, n long, terms array<int>, tfs array<int>"))
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        held = vectors.filter("size(terms) > 0")
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in held.select("terms").mapInArrow(_document_frequencies(len(df)), "term long, df long").groupBy("term").agg(F.sum("df")).toLocalIterator():
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        groups = grouped([(n, c) for n, c in enumerate(counts) if c], vocabulary, df, weight)
        best = held.mapInArrow(_searcher(groups, n_docs, n_terms or 1, k, id_type), f"item long, score long, doc_id {kinds[0]}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"number long, item_id {kinds[1]}")
        found = found.unionByName(top.join(names, F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score"))
    return found
