"""Blocks of text to chunks.

Frame `blocks`: document_id, order (integer, unique in a document), type, text, and optionally
level, page, slide, source, document_name, user_id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as t
from passagework.functions.sequence import carried, upper_median, with_position
from passagework.operators.packing import STRETCH, pack, slices_of, tokens_of
from passagework.session import cut

DOC = ["document_id"]
LEVELS = 6
ATOMIC = ("table", "speaker_note", "figure")
# Fixed value: how far above the target an atomic piece or a merged chunk may go.
OVERSIZE = 2
_OPTIONAL = {"level": "int", "page": "int", "slide": "int", "source": "string", "document_name": "string", "user_id": "string"}


def complete(blocks: DataFrame) -> DataFrame:
    """Blocks with every optional column present, and text trimmed; blank ones left out."""
    for name, kind in _OPTIONAL.items():
        if name not in blocks.columns:
            default = F.lit("text") if name == "source" else F.lit(None)
            blocks = blocks.withColumn(name, default.cast(kind))
    return blocks.withColumn("text", t.strip("text")).filter(F.col("text") != "")


def heading_paths(blocks: DataFrame) -> DataFrame:
    """Adds the open headings of each block: `heading_path`, `section` (outermost), `heading` (innermost).

    A heading of level L stays open until one of level L or less. So the latest heading of
    each level counts if it came after the latest of every lesser level.
    """
    return _name_path(carried(blocks, DOC, "order", last=_opened())).drop(*_opened())


def _opened() -> dict[str, Column]:
    """Per level, the heading a block opens there."""
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(LEVELS))
    entry = F.struct(F.col("order").alias("at"), t.strip("text").alias("title"))
    return {f"__h{n}": F.when((F.col("type") == "heading") & (level == n), entry) for n in range(1, LEVELS + 1)}


def _name_path(rows: DataFrame) -> DataFrame:
    kept = []
    for n in range(1, LEVELS + 1):
        h = F.col(f"__h{n}")
        shallower = [F.coalesce(F.col(f"__h{m}.at"), F.lit(-1)) for m in range(1, n)]
        after = h["at"] > F.greatest(F.lit(-1), F.lit(-1), *shallower)
        kept.append(F.when(h.isNotNull() & after, h["title"]))
    return (
        rows.withColumn("heading_path", F.array_compact(F.array(*kept)))
        .withColumn("section", F.try_element_at("heading_path", F.lit(1)))
        .withColumn("heading", F.try_element_at("heading_path", F.lit(-1)))
    )


def page_end(first: Column | str, last: Column | str) -> Column:
    """The last page, where it lies beyond the first."""
    return F.when(t.col(last) > t.col(first), t.col(last))


def _finish(chunks: DataFrame) -> DataFrame:
    """Derived columns of a chunk, from its text and place."""
    return (
        chunks.withColumn("content_hash", t.content_hash("text"))
        .withColumn("chunk_id", t.uuid5(t.CHUNK_NAMESPACE, F.concat(F.col("document_id").cast("string"), F.lit(":"), F.col("content_hash"))))
        .withColumn("token_count", t.token_count("text"))
    )


def fixed_window_chunks(blocks: DataFrame, target_tokens: int = 512, overlap_tokens: int = 64, rate_words: int = 2000) -> DataFrame:
    """Windows of words, each `overlap` longer than its step; cut points never fall inside a word.

    Each block cuts its own share of every window it touches, so no document is gathered:
    what meets in one group is one window's words. The first `rate_words` words of a document tell how many tokens a
    word is; windows are cut from all of them.
    """
    if target_tokens <= 0:
        raise ValueError("target_tokens must be positive")
    if overlap_tokens >= target_tokens:
        raise ValueError("overlap_tokens must be smaller than target_tokens")
    rows = complete(blocks)
    words = F.split("text", r"(?U)\s+")
    rows = cut(carried(rows.withColumn("n_words", F.size(words)), DOC, "order", sums_before={"first_word": F.col("n_words")}))
    sampled = F.greatest(F.lit(0), F.least(F.col("n_words"), F.lit(rate_words) - F.col("first_word"))).cast("int")
    chars = F.length(F.array_join(F.slice(words, F.lit(1), F.greatest(sampled, F.lit(0))), ""))
    whole = rows.groupBy("document_id").agg(
        F.sum("n_words").alias("total"),
        F.sum(F.when(sampled > 0, chars).otherwise(0)).alias("chars"),
        F.min_by("text", F.when(F.col("type") == "heading", F.col("order"))).alias("section"),
    )
    counted = F.least(F.col("total"), F.lit(rate_words))
    per_word = F.greatest(F.lit(1), F.bround((F.col("chars") + counted - 1) / t.CHARS_PER_TOKEN)) / counted
    whole = (
        whole.withColumn("per_word", per_word)
        .withColumn("window", F.greatest((F.lit(target_tokens) / F.col("per_word")).cast("bigint"), F.lit(1)))
        .withColumn("stride", F.greatest(F.col("window") - (F.lit(overlap_tokens) / F.col("per_word")).cast("bigint"), F.lit(1)))
        .withColumn("windows", F.greatest(F.ceil((F.col("total") - F.col("window")) / F.col("stride")) + 1, F.lit(1)).cast("bigint"))
        .select(F.col("document_id").alias("__doc"), "section", "window", "stride", "windows")
    )
    rows = rows.join(whole, F.col("document_id") == F.col("__doc")).drop("__doc")
    first = F.greatest(F.lit(0), F.floor((F.col("first_word") - F.col("window")) / F.col("stride")) + 1).cast("bigint")
    last = F.least(F.col("windows") - 1, F.floor((F.col("first_word") + F.col("n_words") - 1) / F.col("stride"))).cast("bigint")

    def share(w: Column, of: Column) -> Column:
        begin = F.greatest(F.lit(0), w * F.col("stride") - F.col("first_word"))
        end = F.least(F.col("n_words"), w * F.col("stride") + F.col("window") - F.col("first_word"))
        return F.struct(w.alias("chunk_index"), F.array_join(F.slice(of, (begin + 1).cast("int"), (end - begin).cast("int")), " ").alias("part"))

    # Slices are taken inside the array expression, so the words are not copied per window.
    parts = F.when(first <= last, t.let(words, lambda of: F.transform(F.sequence(first, last), lambda w: share(w, of))))
    pieces = rows.select("document_id", "document_name", "user_id", "section", "order", "page", "slide", F.inline(parts))
    chunks = pieces.groupBy("document_id", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "part"))), lambda p: p["part"]), " ").alias("text"),
        F.first("document_name").alias("document_name"), F.first("user_id").alias("user_id"), F.first("section").alias("section"),
        F.min_by("page", "order").alias("page_number"), F.max("page").alias("__last"), F.min_by("slide", "order").alias("slide_number"),
    )
    return _finish(
        chunks.withColumn("page_end", page_end("page_number", "__last")).drop("__last")
        .withColumn("heading", F.lit(None).cast("string")).withColumn("heading_path", F.array().cast("array<string>"))
        .withColumn("char_start", F.lit(None).cast("bigint")).withColumn("char_end", F.lit(None).cast("bigint"))
        .withColumn("source", F.lit("text"))
    )


_SLICES = "array<struct<at: int, before: bigint, lengths: array<int>, starts: array<int>>>"


def _slicer(width: int):
    """Where each piece of a block starts in its text (searching on from the one before), in slices of bounded tokens."""

    def of(text: str, parts, lined: bool) -> list[tuple]:
        starts, lengths, cursor = [], [len(p) for p in parts], 0
        for part in parts:
            # Lines follow each other without the blank ones between them.
            at = cursor if lined else max(text.find(part, cursor), 0) or cursor
            starts.append(at)
            cursor = at + len(part) + lined
        cuts = slices_of(tokens_of(np.array(lengths, np.int64)), width)
        return [(at, before, lengths[at:at + n], starts[at:at + n]) for at, n, before in cuts]

    @F.pandas_udf(_SLICES)
    def run(texts: pd.Series, parts: pd.Series, lined: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("at", "before", "lengths", "starts"), x, strict=True)) for x in of(*row)] for row in zip(texts, parts, lined, strict=True)])

    return run


def piece_rows(blocks: DataFrame, target: int, width: int) -> DataFrame:
    """Blocks with `parts`, the smallest units of packing, and `slices`, their places and lengths.

    Parts are sentences; tables, notes and figures are whole, or their lines where they exceed what may stand. Headings have none.
    """
    atomic = F.col("type").isin(*ATOMIC)
    size = t.token_count("text")
    lined = atomic & (size > OVERSIZE * target)
    whole = F.when(F.col("type") == "heading", F.array().cast("array<string>")).when(
        lined, F.filter(F.split("text", "\n"), lambda s: s.rlike(r"(?U)\S"))).when(atomic, F.array("text")).otherwise(t.split_sentences("text"))
    rows = complete(blocks).withColumns({"atomic": atomic, "big": atomic & (size > target), "lined": lined, "parts": whole})
    return rows.withColumn("slices", _slicer(width)("text", "parts", "lined"))


def _runs_of(rows: DataFrame) -> DataFrame:
    """Body blocks, numbers only: offset in the document, latest heading, run, and tokens and pieces before.

    A run starts after a heading, at a figure on another page, and around an oversized piece.
    """
    heading = F.col("type") == "heading"
    last = F.element_at("slices", -1)
    spoken = F.transform(last["lengths"], lambda n: F.greatest(F.lit(1), F.bround(n / t.CHARS_PER_TOKEN).cast("int")))
    numbers = rows.select(
        *DOC, "order", heading.alias("heading"), (F.col("type") == "figure").alias("figure"), "page", "slide", (F.col("source") == "vision").alias("vision"),
        "atomic", "big", F.length("text").alias("length"), "slices", (last["before"] + F.aggregate(spoken, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("tokens"),
        (last["at"] + F.size(last["lengths"])).cast("bigint").alias("pieces"))
    placed = carried(numbers, DOC, "order", sums_before={"offset": F.col("length") + 2}, last_before={
        "mark": F.when(F.col("heading"), F.col("order").cast("bigint")),
        "prev": F.when(~F.col("heading"), F.struct("order", "page", "slide", "big")),
    }).filter(~F.col("heading"))
    moved = ~(F.col("prev.page").eqNullSafe(F.col("page")) & F.col("prev.slide").eqNullSafe(F.col("slide")))
    starts = (
        F.col("prev").isNull() | (F.coalesce("mark", F.lit(-1)) > F.col("prev.order")) | F.col("big") | F.col("prev.big") | (F.col("figure") & moved)
    )
    body = cut(placed.withColumn("starts", starts).drop("prev", "big", "heading", "figure", "length"))
    return cut(carried(body, DOC, "order", last={"run": F.when(F.col("starts"), F.col("order").cast("bigint"))},
                       sums_before={"base": F.col("tokens"), "first": F.col("pieces")}).drop("starts", "tokens", "pieces"))


def structural_chunks(blocks: DataFrame, target_tokens: int = 512, overlap_tokens: int = 64, min_tokens: int = 64, stretch: int = STRETCH) -> DataFrame:
    """Chunks that never cross a heading nor cut a sentence.

    Sentences are found once and written; from there on only numbers move (`packing.pack`), however long a run is. The text is
    brought to its chunks at the end, where each block hands out its sentences. A task packs `stretch` targets of tokens at a time.
    """
    if target_tokens <= 0 or stretch < 2:
        raise ValueError("target_tokens must be positive and a stretch two targets long")
    width = stretch * target_tokens
    rows = cut(piece_rows(blocks, target_tokens, width))
    opened = carried(rows.filter("type = 'heading'").select(*DOC, "order", "type", "level", "text"), DOC, "order", last=_opened())
    heads = _name_path(opened).select(F.col("document_id").alias("h_doc"), F.col("order").cast("bigint").alias("h_order"), "section", "heading", "heading_path")
    groups = pack(_runs_of(rows), target_tokens, min(overlap_tokens, target_tokens // 2), width)
    groups = cut(groups.join(heads, (F.col("document_id") == F.col("h_doc")) & (F.col("mark") == F.col("h_order")), "left").drop("h_doc", "h_order").withColumn(
        "heading_path", F.coalesce("heading_path", F.array().cast("array<string>"))))
    plan = _fold_small(groups.select(*DOC, "at", "tokens", "heading_path"), target_tokens, min_tokens)
    part = ("first_page", "last_page", "slide", "char_start", "char_end", "vision", "section", "heading", "heading_path", "members")
    one = groups.select(*DOC, "at", *part)
    two = groups.select(*[F.col(c).alias(f"b_{c}") for c in (*DOC, "at", *part)])
    both = F.col("folded_at").isNotNull()
    deeper = both & (F.size("b_heading_path") > F.size("heading_path"))
    pick = lambda c: F.when(deeper, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c)
    of_part = lambda c, n: F.transform(F.coalesce(c, F.array().cast("array<struct<order: bigint, piece: int, pieces: int>>")), lambda m: F.struct(F.lit(n).alias("part"), m["order"].alias("order"), m["piece"].alias("piece"), m["pieces"].alias("pieces")))
    made = cut(plan.join(one, [*DOC, "at"]).join(two, (F.col("document_id") == F.col("b_document_id")) & (F.col("folded_at") == F.col("b_at")), "left").select(
        *DOC, "chunk_index", F.col("first_page").alias("page_number"), page_end("first_page", F.greatest("last_page", "b_last_page")).alias("page_end"),
        F.col("slide").alias("slide_number"), pick("section"), pick("heading"), pick("heading_path"),
        "char_start", F.coalesce("b_char_end", "char_end").alias("char_end"),
        F.when(F.col("vision") & F.coalesce("b_vision", F.lit(True)), "vision").otherwise("text").alias("source"),
        F.concat(of_part(F.col("members"), 0), of_part(F.col("b_members"), 1)).alias("members")))
    used = made.select(F.col("document_id").alias("m_doc"), "chunk_index", F.inline("members"))
    texts = rows.select(*DOC, F.col("order").cast("bigint").alias("order"), "parts", "document_name", "user_id").withColumnRenamed("order", "r_order")
    spoken = used.join(texts, (F.col("m_doc") == F.col("document_id")) & (F.col("order") == F.col("r_order"))).select(
        *DOC, "chunk_index", F.struct("part", "order", "piece", F.array_join(F.slice("parts", F.col("piece") + 1, F.col("pieces")), " ").alias("text")).alias("spoken"),
        "document_name", "user_id")
    joined = spoken.groupBy(*DOC, "chunk_index").agg(
        t.strip(F.array_join(F.transform(F.array_sort(F.collect_list("spoken")), lambda x: x["text"]), " ")).alias("text"),
        F.min_by("document_name", F.struct("spoken.part", "spoken.order")).alias("document_name"), F.min_by("user_id", F.struct("spoken.part", "spoken.order")).alias("user_id"))
    return _finish(made.drop("members").join(joined, [*DOC, "chunk_index"]).filter(F.col("text") != "").select(
        *DOC, "document_name", "user_id", "chunk_index", "text", "page_number", "page_end", "slide_number", "section", "heading", "heading_path", "char_start", "char_end", "source"))


def _fold_small(groups: DataFrame, target: int, least: int) -> DataFrame:
    """Which groups stand, which one each takes up, and their final index.

    A group below `least` tokens takes up the next one of the same or a deeper path. Folding
    goes once through the groups, pair by pair, so in a stretch of foldable groups every other
    one is taken up by the one before it.
    """
    ordered = cut(with_position(groups, DOC, "at", "pos"))
    following = ordered.select(
        *[F.col(c).alias(f"next_{c}") for c in (*DOC, "at", "tokens", "heading_path")], (F.col("pos") - 1).alias("pos_before"))
    rows = ordered.join(following, (F.col("document_id") == F.col("next_document_id")) & (F.col("pos") == F.col("pos_before")), "left")
    depth = F.size("heading_path")
    related = (depth == 0) | (F.slice("next_heading_path", F.lit(1), F.greatest(depth, F.lit(1))) == F.col("heading_path"))
    fits = (F.col("tokens") < least) & related & (F.col("tokens") + F.col("next_tokens") <= OVERSIZE * target)
    rows = rows.select(*DOC, "at", "pos", "next_at", F.coalesce(fits, F.lit(False)).alias("foldable"))
    rows = carried(rows, DOC, "pos", last_before={"barrier": F.when(~F.col("foldable"), F.col("pos"))})
    kept = cut(rows.filter((F.col("pos") - F.coalesce("barrier", F.lit(-1))) % 2 != 0))
    return with_position(kept, DOC, "pos", "chunk_index").select(
        *DOC, "at", "chunk_index", F.when(F.col("foldable"), F.col("next_at")).alias("folded_at"))


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """The first of chunks with the same id in a document; later indices keep their gaps."""
    w = Window.partitionBy("document_id", "chunk_id").orderBy("chunk_index")
    return chunks.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") == 1).drop("__n")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks kept, duplicates dropped, tokens and their upper median."""
    kept = dedupe_chunks(chunks)
    per = kept.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    before = chunks.groupBy("document_id").agg(F.count("*").alias("__all"))
    return (
        per.join(before, "document_id").join(upper_median(kept, DOC, "token_count", "median_tokens"), "document_id")
        .select("document_id", "chunks", (F.col("__all") - F.col("chunks")).alias("duplicates_dropped"), "tokens", "median_tokens")
    )


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunk counts per owner, and overall (owner null)."""
    return chunks.rollup("user_id").agg(F.count("*").alias("chunks"))
