"""Typeset lines to blocks.

Frame `lines`: document_id, page, text, font_size, is_bold, x0, y0, x1, y1; `order` once read
in order. Frame `tables`: document_id, page, x0, y0, x1, y1, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions import text as t
from passagework.functions.sequence import carried, upper_median
from passagework.session import cut

# How much larger than body text a heading is, sizes taken as one, deepest level,
# share and least characters of a second body size, paragraph gap, table overlap, scanned page.
SIZE_RATIO, SAME_SIZE, MAX_LEVEL = 1.08, 0.03, 6
SECOND_SHARE, SECOND_CHARS = 0.3, 200
GAP_RATIO, GAP_LEAST = 0.35, 2.0
TABLE_OVERLAP, SCANNED_CHARS = 0.5, 60

DOC = ["document_id"]
# More rows than a page can hold: keeps the pages of a document apart in one integer.
_PAGE = 1 << 32


def table_text(rows: Column | str) -> Column:
    """Cells joined by bars, one line per row; empty rows left out."""
    cells = lambda r: F.transform(r, lambda c: F.replace(t.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))
    filled = F.filter(F.transform(t.col(rows), cells), lambda r: F.exists(r, lambda c: c != ""))
    return F.array_join(F.transform(filled, lambda r: F.array_join(r, " | ")), "\n")


def table_overlap(line: dict[str, Column], table: dict[str, Column]) -> Column:
    """Share of a line's area inside a table."""
    width = F.least(line["x1"], table["x1"]) - F.greatest(line["x0"], table["x0"])
    height = F.least(line["y1"], table["y1"]) - F.greatest(line["y0"], table["y0"])
    area = F.greatest((line["x1"] - line["x0"]) * (line["y1"] - line["y0"]), F.lit(1e-6))
    return F.when((width > 0) & (height > 0), width * height / area).otherwise(0.0)


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that are not at least half inside a table of their page."""
    box = ("x0", "y0", "x1", "y1")
    inside = table_overlap({b: lines[b] for b in box}, {b: tables[b] for b in box}) >= TABLE_OVERLAP
    same = (lines["document_id"] == tables["document_id"]) & (lines["page"] == tables["page"])
    return lines.join(tables, same & inside, "left_anti")


def reading_order(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines and tables in one order: page, then top, then left.

    Rows are numbered within their page; page sizes are then summed up, so no document is
    sorted as a whole.
    """
    both = lines.withColumn("kind", F.lit("line")).unionByName(tables.withColumn("kind", F.lit("table")), allowMissingColumns=True)
    on_page = Window.partitionBy("document_id", "page").orderBy("y0", "x0", "kind", "text")
    placed = both.withColumn("__at", F.coalesce("page", F.lit(0)).cast("bigint") * _PAGE + F.row_number().over(on_page))
    return carried(placed, DOC, "__at", sums_before={"order": F.lit(1).cast("bigint")}, width=_PAGE).drop("__at")


def _weights(lines: DataFrame) -> DataFrame:
    """Characters per document and size: a handful of rows per document."""
    size = F.bround("font_size", 1)
    return lines.groupBy("document_id", size.alias("size")).agg(
        F.sum(F.greatest(F.length(t.strip("text")), F.lit(1))).alias("weight"), F.min("order").alias("seen"))


def body_sizes(lines: DataFrame) -> DataFrame:
    """Per document the body size (most characters) and the largest size that is still body text."""
    weights = _weights(lines)
    body = weights.groupBy("document_id").agg(
        F.max_by("size", F.struct("weight", -F.col("seen"))).alias("body_size"), F.max("weight").alias("body_weight"))
    least = F.greatest(F.col("body_weight") * SECOND_SHARE, F.lit(float(SECOND_CHARS)))
    return weights.join(body, "document_id").groupBy("document_id").agg(
        F.first("body_size").alias("body_size"),
        F.max(F.when((F.col("size") == F.col("body_size")) | (F.col("weight") >= least), F.col("size"))).alias("body_ceiling"))


def heading_levels(lines: DataFrame) -> DataFrame:
    """Lines with `level` (null for body text): sizes ranked from the largest, near-equal ones as one.

    The sizes of a document are few; they are folded to the size that leads each level.
    """
    sized = lines.join(body_sizes(lines).select("document_id", "body_ceiling"), "document_id")
    text = t.strip("text")
    larger = (F.col("body_ceiling") > 0) & (F.col("font_size") >= F.col("body_ceiling") * SIZE_RATIO)
    named = (text != "") & (F.length(text) <= 200) & text.rlike(r"[\p{L}\p{N}]")
    sized = sized.withColumn("__h", named & (larger | (F.col("is_bold") & t.looks_like_heading("text")))).withColumn("__larger", larger)
    sizes = sized.filter("__h").groupBy("document_id").agg(F.sort_array(F.collect_set(F.bround("font_size", 2)), asc=False).alias("sizes"))

    def lead(acc: Column, size: Column) -> Column:
        before = F.element_at(acc, -1)
        apart = F.abs(before - size) / F.greatest(before, F.lit(1e-6)) > SAME_SIZE
        return F.when((F.size(acc) == 0) | apart, F.concat(acc, F.array(size))).otherwise(acc)

    empty = F.array().cast("array<double>")
    leads = sizes.select(F.col("document_id").alias("__d"), F.aggregate("sizes", empty, lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(lead(a, s))).alias("leads"))
    rows = sized.join(leads, F.col("document_id") == F.col("__d"), "left").drop("__d")
    nearest = F.array_min(F.transform("leads", lambda s, i: F.struct(F.abs(s - F.bround("font_size", 2)).alias("away"), i.alias("i"))))["i"]
    small = (F.col("body_ceiling") > 0) & ~F.col("__larger")
    level = F.when(small, F.least(F.size("leads") + 1, F.lit(MAX_LEVEL))).otherwise(F.least(nearest + 1, F.lit(MAX_LEVEL)))
    return rows.withColumn("level", F.when(F.col("__h"), level)).drop("__h", "__larger", "leads", "body_ceiling")


def merge_paragraphs(lines: DataFrame) -> DataFrame:
    """Blocks: headings as they are, and body lines joined into paragraphs.

    A paragraph ends at a page, at a heading, and at a gap wider than the document's usual one. `n_lines` counts its lines.
    """
    before = carried(lines, DOC, "order", last_before={"prev": F.struct("page", "y1", "font_size", F.col("level").isNotNull().alias("heading"))})
    gap = F.col("y0") - F.col("prev.y1")
    gaps = cut(before.withColumn("__gap", F.when(F.col("prev.page") == F.col("page"), gap)))
    usual = upper_median(gaps, DOC, "__gap", "usual")
    rows = gaps.join(usual, "document_id", "left")
    wide = gap > F.coalesce("usual", F.lit(0.0)) + F.greatest(F.lit(GAP_LEAST), F.col("prev.font_size") * GAP_RATIO)
    starts = F.col("level").isNotNull() | F.col("prev").isNull() | F.col("prev.heading") | (F.col("prev.page") != F.col("page")) | wide
    rows = cut(rows.withColumn("__starts", starts).drop("prev", "usual", "__gap"))
    rows = carried(rows, DOC, "order", last={"block": F.when(F.col("__starts"), F.col("order"))})
    # A paragraph lies on one page, so its lines may be collected.
    here = F.array_sort(F.collect_list(F.struct("order", "text")))
    blocks = rows.groupBy("document_id", "block").agg(
        F.array_join(F.transform(here, lambda p: p["text"]), " ").alias("text"), F.min_by("level", "order").alias("level"),
        F.min_by("page", "order").alias("page"), F.min_by("font_size", "order").alias("font_size"), F.min("x0").alias("x0"),
        F.min_by("y0", "order").alias("y0"), F.max("x1").alias("x1"), F.max_by("y1", "order").alias("y1"), F.count("*").alias("n_lines"))
    kind = F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph")
    text = F.when(F.col("level").isNotNull(), F.col("text")).otherwise(t.normalize("text"))
    return blocks.withColumn("text", text).filter("text <> ''").withColumn("type", kind).withColumnRenamed("block", "order").withColumn("source", F.lit("text"))


def document_stats(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per document: headings, tables, notes, images, pages."""
    is_ = lambda kind: F.count_if(F.col("type") == kind)
    counted = blocks.groupBy("document_id").agg(
        is_("heading").alias("headings"), is_("table").alias("tables"), is_("speaker_note").alias("notes"), F.max("page").alias("pages"))
    if images is None:
        return counted.withColumn("images", F.lit(0).cast("bigint"))
    pictures = images.groupBy("document_id").agg(F.count("*").alias("images"))
    return counted.join(pictures, "document_id", "left").fillna({"images": 0})


def scanned_pages(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with next to no text, those without any line included."""
    chars = lines.groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    found = pages.select("document_id", "page").join(chars, ["document_id", "page"], "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return found.filter(F.col("chars") < SCANNED_CHARS)
