"""Pictures in documents: which to read, cached readings, and readings as blocks.

Frame `images`: document_id, order, page, slide, pixels, content_hash, whole_page.
Frame `readings`: model_key, content_hash, reading (null: nothing to read, still a hit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.sequence import carried
from passagework.functions.text import strip

# Least pixels, new readings per document, characters of context, seconds before each further try.
MIN_PIXELS, BUDGET, CONTEXT_CHARS = 40_000, 40, 400
RETRY_SECONDS = (60, 180, 600)
# A marked heading; a caption, which is not one; a heading's number.
HEADING_LINE = r"(?U)^(#{1,6})\s+(.+?)(?:\s+#+)?$"
CAPTION = r"(?i)^(table|fig(ure)?\.?|chart|diagram|graph|plate|image)\s*(\d|[IVX]+\b)"
NUMBER = r"(?U)^(\d+(?:\.\d+)*)\.?\s+\S"

DOC = ["document_id"]


def select_images(images: DataFrame, min_pixels: int = MIN_PIXELS) -> DataFrame:
    """Adds `status`: small, duplicate or chosen. An unknown size (0) is kept."""
    small = (F.col("pixels") > 0) & (F.col("pixels") < min_pixels)
    rows = images.withColumn("__small", small)
    first = rows.filter(~F.col("__small")).groupBy(*DOC, "content_hash").agg(F.min("order").alias("__first"))
    rows = rows.join(first, [*DOC, "content_hash"], "left")
    again = (F.col("content_hash") != "") & (F.col("order") > F.col("__first"))
    return rows.withColumn("status", F.when(F.col("__small"), "small").when(again, "duplicate").otherwise("chosen")).drop("__small", "__first")


def reading_cache_join(images: DataFrame, readings: DataFrame, model_key: str, budget: int = BUDGET) -> DataFrame:
    """Adds `outcome` to every image: small, duplicate, cached, pending or skipped_budget.

    A document's first `budget` images not in the cache are pending, in its own order.
    """
    held = readings.filter(F.col("model_key") == model_key).select("content_hash", "reading", F.lit(True).alias("__held"))
    rows = select_images(images).join(held, "content_hash", "left")
    unread = (F.col("status") == "chosen") & F.col("__held").isNull()
    rows = carried(rows, DOC, "order", sums_before={"__nth": unread.cast("bigint")})
    waiting = F.when(F.col("__nth") < budget, "pending").otherwise("skipped_budget")
    outcome = F.when(F.col("status") != "chosen", F.col("status")).when(F.col("__held"), "cached").otherwise(waiting)
    return rows.withColumn("outcome", outcome).drop("__held", "__nth")


def vision_stats(outcomes: DataFrame) -> DataFrame:
    """Per document: images by outcome, cached ones with and without content, and those left to read."""
    is_ = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    has = F.coalesce(F.col("reading") != "", F.lit(False))
    return outcomes.groupBy("document_id").agg(
        is_("small").alias("skipped_small"), is_("duplicate").alias("skipped_duplicate"), is_("cached").alias("cached"),
        is_("skipped_budget").alias("skipped_budget"), F.count_if((F.col("outcome") == "cached") & has).alias("described"),
        F.count_if((F.col("outcome") == "cached") & ~has).alias("no_content"),
        is_("pending", "failed", "skipped_quota").alias("figures_pending"))


def reading_blocks(readings: DataFrame) -> DataFrame:
    """A reading as blocks at its image's place.

    On a page scanned whole, `#` lines become headings, numbered ones at the level of their
    number, captions excepted; elsewhere the marks go and the words stay. Other lines between
    headings form figure blocks.
    """
    rows = readings.select("*", F.posexplode(F.split("reading", r"\r?\n")).alias("line", "raw"))
    marked = strip("raw")
    title = F.regexp_replace(F.regexp_extract(marked, HEADING_LINE, 2), r"^[*_ ]+|[*_ ]+$", "")
    is_title = marked.rlike(HEADING_LINE) & (title != "")
    rows = rows.withColumn("__title", F.when(is_title, title))
    heads = F.col("whole_page") & F.col("__title").isNotNull() & ~F.coalesce(F.col("__title").rlike(CAPTION), F.lit(False))
    number = F.regexp_extract("__title", NUMBER, 1)
    depth = F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(6))).otherwise(F.length(F.regexp_extract(marked, HEADING_LINE, 1)))
    rows = rows.withColumn("__head", heads).withColumn("level", F.when(heads, depth)).withColumn(
        "raw", F.coalesce("__title", "raw"))
    # A reading is one page's text: its lines are numbered and joined within the image.
    key = [*DOC, "order"]
    # A heading opens a part of its own; the lines after it another.
    rows = carried(rows, key, "line", sums={"__opened": F.col("__head").cast("int")})
    rows = rows.withColumn("__part", F.col("__opened") * 2 - F.col("__head").cast("int"))
    keep = [c for c in readings.columns if c not in ("reading", "order", *DOC)]
    joined = rows.groupBy(*key, "__part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda p: p["raw"]), "\n").alias("text"),
        F.max("level").alias("level"), *[F.first(c).alias(c) for c in keep])
    return (
        joined.withColumn("text", strip("text")).filter("text <> ''")
        .withColumn("type", F.when(F.col("level").isNotNull(), "heading").otherwise("figure"))
        .withColumn("source", F.lit("vision")).withColumnRenamed("__part", "part")
    )


def fan_out_readings(images: DataFrame, readings: DataFrame) -> DataFrame:
    """One reading per distinct image, as blocks at every place the image occurs; null gives none."""
    known = readings.filter(F.col("reading") != "").select("content_hash", "reading")
    return reading_blocks(images.select("document_id", "order", "page", "slide", "content_hash", "whole_page").join(known, "content_hash"))


def image_context(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each image with the first characters of its slide's text.

    Only the blocks that reach into those characters are put together.
    """
    place = ["__d", "__s"]
    # A document without slides has one place, number -1.
    where = [F.col("document_id").alias("__d"), F.coalesce("slide", F.lit(-1)).alias("__s")]
    rows = carried(blocks.select(*where, "order", "text"), place, "order", sums_before={"__chars": F.length("text") + 1})
    wanted = rows.filter(F.col("__chars") < CONTEXT_CHARS)
    near = wanted.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("parts"))
    hint = F.substring(F.array_join(F.transform("parts", lambda p: p["text"]), " "), 1, CONTEXT_CHARS)
    near = near.select(*place, hint.alias("context_hint"))
    return images.select("*", *where).join(near, place, "left").drop(*place).withColumn("context_hint", F.coalesce("context_hint", F.lit("")))


def next_retry(unread: Column, quota_spent: Column, tries: Column) -> Column:
    """Struct(step, attempt, delay_s): complete, retry after a growing pause, or give up."""
    delays = F.array(*[F.lit(s) for s in RETRY_SECONDS])
    delay = F.when(~quota_spent, F.get(delays, tries))
    again = delay.isNotNull()
    step = F.when(unread <= 0, "complete").when(again, "retry").otherwise("unread")
    return F.struct(
        step.alias("step"), F.when(step == "retry", tries + 1).alias("attempt"), F.when(step == "retry", delay).alias("delay_s"))
