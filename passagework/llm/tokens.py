"""Token counts: pieces counted once per distinct pre-token, then summed over each document's frequencies."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagework.llm.common import keyed
from passagework.session import cut

#: Distinct units a task remembers before it starts over.
REMEMBERED = 300_000


class Pretokens:
    """Cuts a unit of text, free of ASCII white space, into the library's pre-tokens.

    White space ends every pre-token and every normalisation of the supported files, so a document is its units.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        added = json.loads(spec).get("added_tokens") or []
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.special = re.compile("|".join(sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)) or r"(?!)")

    def split(self, unit: str) -> tuple[list[str], int]:
        """The unit's pre-tokens, and how many special strings it holds (a token each)."""
        normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        parts = [s for s in self.special.split(unit) if s]
        found = [p for s in parts for p, _ in pre.pre_tokenize_str(normal.normalize_str(s) if normal else s)]
        return found, len(self.special.findall(unit))

    def pieces(self, pretoken: str) -> int:
        return len(self.tokenizer.model.tokenize(pretoken))


def _frequencies(spec: str, known: dict[str, int]):
    """Per document: pieces of known pre-tokens, and the others with their frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens, memo = Pretokens(spec), {}

        def look(unit: bytes) -> tuple[int, tuple[str, ...]]:
            found, specials = pretokens.split(unit.decode())
            return specials + sum(known.get(p, 0) for p in found), tuple(p for p in found if p not in known)

        for batch in batches:
            sums, names, counts = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                total, rare = 0, Counter()
                for unit, n in Counter(text.split()).items():
                    made = memo.get(unit)
                    if made is None:
                        if len(memo) >= REMEMBERED:
                            memo.clear()
                        made = memo[unit] = look(unit)
                    total += n * made[0]
                    for p in made[1]:
                        rare[p] += n
                sums.append(total)
                names.append(list(rare))
                counts.append(list(rare.values()))
            yield pa.record_batch(
                [*[batch.column(c) for c in ("doc_id", "text_hash", "n_bytes")], pa.array(sums, pa.int64()),
                 pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_bytes", "known", "rare", "times"])
    return run


def _distinct(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = Pretokens(spec)
        for batch in batches:
            units = {u for t in batch.column("text").cast(pa.binary()).to_pylist() for u in t.split()}
            found = Counter(p for u in units for p in pretokens.split(u.decode())[0])
            yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pretoken", "n"])
    return run


def _piece_counter(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = Pretokens(spec)
        for batch in batches:
            names = batch.column("pretoken")
            yield pa.record_batch([names, pa.array([pretokens.pieces(p) for p in names.to_pylist()], pa.int64())], names=["pretoken", "pieces"])
    return run


def count_pieces(pretokens: DataFrame, spec: str) -> DataFrame:
    """(pretoken, pieces), each distinct pre-token once."""
    return pretokens.select("pretoken").distinct().mapInArrow(_piece_counter(spec), "pretoken string, pieces long")


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, limit: int = 2048,
                 carried: int = 1 << 17, carried_bytes: int = 48, glance: int = 8_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens above `limit`).

    `tokenizer` is the path of a tokenizers .json file whose pre-tokens end at white space. Pieces of each distinct
    pre-token are counted once; documents send (pre-token, frequency) to the table of counts and get sums back. Ids are
    never made. The most frequent pre-tokens of a glance at about `glance` documents, at most `carried` of at most
    `carried_bytes` bytes each, have their counts carried to the tasks instead: this spares the shuffle its hot keys and most of
    its rows, and does not change a result. Everything else is joined, whatever it is.

    Counts are the library's without begin, end or padding; special strings inside a text count as it takes them by
    default. Null and empty texts have none. Rows that repeat an id and its text each get their row; null ids too. An
    empty table gives no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    rows = keyed(docs, doc_id, text).select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    share = min(1.0, glance / max(rows.count(), 1))
    seen = rows.sample(share, 7).select("text").mapInArrow(_distinct(spec), "pretoken string, n long")
    often = seen.filter(F.octet_length("pretoken") <= carried_bytes).groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(carried)
    known = {r[0]: r[1] for r in count_pieces(often, spec).toLocalIterator()}
    kind = dict(rows.dtypes)["doc_id"]
    counted = cut(rows.mapInArrow(
        _frequencies(spec, known), f"doc_id {kind}, text_hash long, n_bytes long, known long, rare array<string>, times array<long>"))
    rare = counted.select("doc_id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "doc_id", "text_hash", F.col("x.rare").alias("pretoken"), F.col("x.times").alias("times"))
    sums = (
        rare.join(count_pieces(rare, spec), "pretoken")
        .groupBy("doc_id", "text_hash").agg(F.sum(F.col("times") * F.col("pieces")).alias("joined"))
        .select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "joined")
    )
    # Rows that repeat an id and its text were summed together above.
    base = counted.groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows"), F.first("n_bytes").alias("n_bytes"), F.first("known").alias("known"))
    joined = base.join(sums, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")
    n_tokens = F.col("known") + F.coalesce(F.expr("joined div rows"), F.lit(0))
    return joined.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
