"""Two tokenizers side by side: token ends merged in equal pieces (merge path), groups between common ends, linked ids counted."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import portions
from passagework.llm.units import Remembered, binary, bytes_where
from passagework.session import cut

#: Steps of the merge in one piece.
PIECE = 1 << 14
#: Distinct units a task remembers, and bytes of text it works on at a time; both tokenizers and their pieces are in memory beside them.
MEMORY, PORTION = 250_000, 2 << 20
_NONE = np.empty(0, np.int32)
#: What may begin white space: its ASCII bytes, and the first bytes of every longer character that is white space.
_MAYBE_SPACE = bytes_where(lambda b: b in b" \t\n\v\f\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")


def byte_letters() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Pair:
    """Both tokenizers, the bytes of their ids, and units encoded by both."""

    def __init__(self, spec: str, model: bytes):
        # Read here: tasks load the tokenizers, the driver only their files.
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_str(spec), SentencePieceProcessor(model_proto=model)
        # Strings of special tokens inside a text are plain text.
        self.a.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, units: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of units, each of which begins with a space, and how many each has; none where the tokens spell other bytes.

        A takes the units as one text, except those that end in a space, which could join the next; its tokens' bytes tell whose a
        token is.
        """
        raw_a = [_NONE] * len(units)
        joined = [k for k, u in enumerate(units) if u[-1] != 32]
        for some in [joined, *([k] for k, u in enumerate(units) if u[-1] == 32)]:
            ids = np.array(self.a.encode(b"".join([units[k] for k in some]).decode(), add_special_tokens=False).ids, np.int32)
            ends = np.searchsorted(np.cumsum(self.size_a[ids]), np.cumsum([len(units[k]) for k in some]), "right").tolist()
            for k, lo, hi in zip(some, [0, *ends], ends, strict=False):
                raw_a[k] = ids[lo:hi]
        raw_b = self.b.encode([u[1:].decode() for u in units], num_threads=1)
        for k, unit in enumerate(units):
            if b"".join([self.bytes_a[i] for i in raw_a[k].tolist()]) != unit or b"".join([self.bytes_b[i] for i in raw_b[k]]) != unit:
                raw_a[k] = raw_b[k] = _NONE
        count = lambda lists: np.fromiter(map(len, lists), np.int64, len(lists))
        return [(np.concatenate(raw_a), count(raw_a)), (np.fromiter(chain.from_iterable(raw_b), np.int32), count(raw_b))]


def spaced_units(held: np.ndarray, at: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Texts, each behind a space, cut before spaces that follow another byte and stand before no white space; bounds as in `runs`.

    There both tokenizers begin a token, whatever stands around. Where the next byte may begin white space no cut is
    made, so a unit may be longer than it has to be. Empty texts have no units.
    """
    full = at[:-1] < at[1:]
    begins = at[:-1][full]
    data = np.insert(held, begins, 32)
    starts = begins + np.arange(len(begins))
    cuts = np.zeros(len(data), bool)
    if len(data) > 2:
        cuts[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & ~_MAYBE_SPACE[data[2:]]
    # The space put before a text begins a unit; its neighbours decide nothing across the border.
    last = np.append(starts[1:], len(data)) - 1 if len(starts) else starts
    cuts[last] = False
    cuts[starts] = True
    places = np.flatnonzero(cuts)
    return binary(data, np.append(places, len(data))), np.searchsorted(places, at + np.append(0, np.cumsum(full)))


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    """Rows (places in a, places in b) at which two ascending arrays are cut into pieces of about `piece` steps of their merge.

    On each diagonal, i + j steps, a binary search over all diagonals at once finds where the merge crosses it. A crossing between
    two equal ends moves one step on, so both stay in one piece.
    """
    steps = np.append(np.arange(0, len(a) + len(b), max(piece, 2)), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(steps), bool)
        first[open_] = a[middle[open_]] <= b[steps[open_] - middle[open_] - 1]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i, j = low, steps - low
    split = np.zeros(len(steps), bool)
    can = (i > 0) & (j < len(b))
    split[can] = a[i[can] - 1] == b[j[can]]
    return np.stack([i, j + split], axis=1)


def overlaps(a: np.ndarray, b: np.ndarray, piece: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The places in a and b of the ends that both have, found in one piece of the merge alone."""
    i0, i1, j0, j1 = piece
    ends_a, ends_b = a[i0:i1], b[j0:j1]
    where = np.searchsorted(ends_a, ends_b)
    hit = np.flatnonzero(where < len(ends_a))
    hit = hit[ends_a[where[hit]] == ends_b[hit]]
    return i0 + where[hit], j0 + hit


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in two ascending arrays at which both have the same value, piece by piece.

    What a piece leaves open behind its last common end is closed by the first common end of a later piece, since
    groups are the stretches between the places returned here.
    """
    crossings = merge_path(a, b, piece)
    found = [overlaps(a, b, (i0, i1, j0, j1)) for (i0, j0), (i1, j1) in zip(crossings[:-1].tolist(), crossings[1:].tolist(), strict=True)]
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.empty(0, np.int64),) * 2


def _aligned(spec: str, model: bytes, piece: int, with_groups: bool):
    """Per document: sizes, groups and their digest, and its distinct pairs of linked ids with their occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Pair(spec, model)
        memory = Remembered(both.encode, 2, MEMORY)
        sizes = [np.array([len(x) for x in names], np.int64) for names in (both.bytes_a, both.bytes_b)]
        n_a, n_b = len(both.bytes_a), len(both.bytes_b)
        # What is written for a token: its id, and the mark behind it; none, ",", and "|" or ";".
        marks = [(n_a, ("", ",", "|")), (n_b, ("", ",", ";"))]
        spelled = np.array([f"{i}{mark}" for n, own in marks for mark in own for i in range(n)], object)
        base_b = 3 * n_a
        for batch in batches:
            for part, held, at in portions(batch, PORTION):
                units, bounds = spaced_units(held, at)
                codes = memory.codes(units)
                lengths = [memory.starts[s][codes + 1] - memory.starts[s][codes] for s in (0, 1)]
                # A unit without tokens differs from its bytes; its document has no tokens then.
                spoilt = np.append(0, np.cumsum(lengths[0] == 0))[bounds]
                kept = np.repeat(np.diff(spoilt) == 0, np.diff(bounds))
                bounds = np.append(0, np.cumsum(kept))[bounds]
                codes = codes[kept]
                (ids_a, per_a), (ids_b, per_b) = memory.gather(codes, 0), memory.gather(codes, 1)
                tokens_a, tokens_b = (np.append(0, np.cumsum(per))[bounds] for per in (per_a, per_b))
                i, j = common_ends(np.cumsum(sizes[0][ids_a]), np.cumsum(sizes[1][ids_b]), piece)
                groups = np.searchsorted(i, tokens_a)
                # Tokens in the order written: of each group those of A, then those of B.
                mark_a, mark_b = np.ones(len(ids_a), np.int64), np.ones(len(ids_b), np.int64)
                mark_a[i] = mark_b[j] = 2
                mark_b[tokens_b[1:][np.diff(tokens_b) > 0] - 1] = 0
                group_a = np.repeat(np.arange(len(i)), np.diff(i, prepend=-1))
                group_b = np.repeat(np.arange(len(j)), np.diff(j, prepend=-1))
                place_a = np.arange(len(ids_a)) + np.append(0, j + 1)[group_a]
                written = np.empty(len(ids_a) + len(ids_b), np.int64)
                written[place_a] = mark_a * n_a + ids_a
                place_b = np.arange(len(ids_b)) + i[group_b] + 1
                written[place_b] = base_b + mark_b * n_b + ids_b
                words = spelled[written].tolist()
                edges = (tokens_a + tokens_b).tolist()
                texts = ["".join(words[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
                # Distinct pairs per document; a sort by document and pair.
                pairs = ids_a[i].astype(np.int64) << 32 | ids_b[j]
                owner = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
                order = np.lexsort((pairs, owner))
                pairs, owner = pairs[order], owner[order]
                first = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1]))) if len(pairs) else np.empty(0, np.int64)
                offsets = pa.array(np.searchsorted(owner[first], np.arange(len(groups))).astype(np.int32))
                times = np.diff(np.append(first, len(pairs)))
                made = [part.column("row"), part.column("doc_id"), *[pa.array(np.diff(x).astype(np.int64)) for x in (tokens_a, tokens_b, groups)], pa.array(digests, pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(pairs[first])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
                yield pa.record_batch([*made, pa.array(texts, pa.large_string()).cast(pa.string())] if with_groups else made, names=[*names, "groups"] if with_groups else names)
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of pairs, added up over each batch."""
    for batch in batches:
        pairs, places = np.unique(batch.column("pairs").flatten().to_numpy(), return_inverse=True)
        n = np.bincount(places, weights=batch.column("times").flatten().to_numpy(), minlength=len(pairs)).astype(np.int64)
        yield pa.record_batch([pa.array(pairs, pa.int64()), pa.array(n)], names=["pair", "n"])


def _scored(carried: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Per document the sums over links with carried pairs, and its other pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            at = lists.offsets.to_numpy().astype(np.int64)
            at, pairs, times = at - at[0], lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            place = np.minimum(np.searchsorted(carried, pairs), max(len(carried) - 1, 0))
            known = carried[place] == pairs if len(carried) else np.zeros(len(pairs), bool)
            place = place[known]

            def per_document(values: np.ndarray) -> np.ndarray:
                all_values = np.zeros(len(pairs) + 1, np.int64)
                all_values[1:][known] = values
                return np.diff(np.cumsum(all_values)[at])

            rest = pa.array(np.append(0, np.cumsum(~known))[at].astype(np.int32))
            passed = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.record_batch([
                *[batch.column(c) for c in passed], pa.array(per_document(times[known] * best[place])), pa.array(per_document(times[known] * counts[place])),
                pa.ListArray.from_arrays(rest, pa.array(pairs[~known])), pa.ListArray.from_arrays(rest, pa.array(times[~known]))],
                names=[*passed, "known_best", "known_sum", "pairs", "times"])
    return run


def align(docs: DataFrame, tokenizer: str, model: str, doc_id: str = "doc_id", text: str = "text", *, piece: int = PIECE,
          carried: int = 1 << 18, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; and the groups themselves if asked for.

    A is the byte-level tokenizers file `tokenizer` over a space and the text, B the sentencepiece file `model` (which adds the space
    itself) over the text; neither takes or adds special tokens. Ends of A's and of B's tokens, as byte offsets, are merged: the merge
    path is cut on diagonals into pieces of `piece` steps, found by binary searches, each piece finds its common ends alone, and
    what stays open at its end is stitched to the next. So a task's work is dealt in equal pieces however long its documents are;
    documents always end in a common end. Groups are what lies between common ends, written `a1,a2|b1;a3|b2`. The last tokens of a
    group link their ids. A pair's count is the number of its links over all documents; n_best has the links whose count is the
    highest that their B id has with any A id, count_sum adds up the counts of all links.

    Both tokenizers see distinct units of text only, as long as a task remembers them. Documents hand on distinct pairs with
    their occurrences, which are written once. The counts of the `carried` most frequent pairs are sent to the tasks (24 bytes each);
    all other pairs are joined, and results do not depend on `carried`.

    Null and empty texts, and texts whose tokens spell other bytes (such as those with U+2581), have no tokens: zeros and ''. Rows
    that repeat an id, and null ids, are documents of their own. An empty table gives no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.dumps(json.load(f))
    with open(model, "rb") as f:
        proto = f.read()
    kind = dict(docs.select(F.col(doc_id).alias("doc_id")).dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"
    texts, lists = (", groups string" if with_groups else ""), ", pairs array<long>, times array<long>"
    aligned = cut(rows.mapInArrow(_aligned(spec, proto, piece, with_groups), sized + lists + texts))
    counts = aligned.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # Partial maxima leave one row per id of B and task; no window over a frequent id's pairs.
    by_b = cut(counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)))
    highest = by_b.groupBy("b").agg(F.max("n").alias("most"))
    judged = cut(by_b.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    often = judged.orderBy(F.desc("n"), "pair").limit(carried).toArrow().sort_by("pair")
    known, n, best = (often.column(c).to_numpy() for c in ("pair", "n", "best"))
    scored = cut(aligned.mapInArrow(_scored(known, n, best), sized + texts + ", known_best long, known_sum long" + lists))
    rest = scored.filter("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = rest.join(judged, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("known_best") + more("more_best")).alias("n_best"),
        (F.col("known_sum") + more("more_sum")).alias("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))
