"""Quiz questions and cards: what to write from, and what to keep of what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.sequence import with_position
from passagework.functions.text import col, let, normalise_heading, strip

# Batch size, least tokens of a passage and of a titled slide, longest card back.
BATCH, MIN_TOKENS, MIN_SLIDE_TOKENS, MAX_BACK = 6, 25, 4, 400
# Fixed value: sections about the document rather than its subject.
SCAFFOLDING = (
    r"^(references?|bibliography|works cited|citations?|further reading"
    r"|acknowledge?ments?|(table of )?contents|agenda|outline|thank you|thanks|any questions)$"
)
# Fixed value: credits on a title slide.
CREDIT = r"(?i)^(submitted|presented|prepared|guided|made|done|created)\s+(by|to|under)\b|^under the guidance of\b"
TYPES = ("mcq", "true_false", "short_answer")


def is_usable(min_tokens: int = MIN_TOKENS) -> Column:
    """Study material long enough to ask about; a titled slide may be much shorter."""
    named = F.filter(F.concat(F.coalesce("heading_path", F.array().cast("array<string>")), F.array("heading")), lambda h: h.isNotNull() & (h != ""))
    scaffold = F.exists(named, lambda h: normalise_heading(h).rlike(SCAFFOLDING))
    title = normalise_heading(F.coalesce("heading", F.lit("")))
    titled = F.col("slide_number").isNotNull() & (title != "") & ~title.rlike(r"^slide \d+$")
    text = strip("text")
    listed = titled & (F.col("token_count") >= MIN_SLIDE_TOKENS) & ~text.rlike(CREDIT)
    return (text != "") & ~scaffold & ((F.col("token_count") >= min_tokens) | listed)


def usable_chunks(chunks: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    return chunks.filter(is_usable(min_tokens))


def label_chunks(chunks: DataFrame, keys: tuple[str, ...] = ("set_id",), size: int = BATCH, order: str = "chunk_index") -> DataFrame:
    """Adds `batch` and `label`: consecutive groups of `size`, labelled C1, C2, ..."""
    return with_position(chunks, list(keys), order, "__p").withColumn("batch", F.floor(F.col("__p") / size).cast("int")).withColumn(
        "label", F.concat(F.lit("C"), (F.col("__p") % size + 1))).drop("__p")


def batch_prompts(labelled: DataFrame, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """One passage text per batch; a batch is at most `BATCH` chunks."""
    part = F.concat(F.lit("["), "label", F.lit("] "), F.coalesce(F.nullif("heading", F.lit("")), F.nullif("section", F.lit("")), F.lit("")), F.lit("\n"), strip("text"))
    rows = labelled.select(*keys, "batch", F.struct(F.substring("label", 2, 18).cast("bigint").alias("n"), part.alias("part")).alias("p"))
    return rows.groupBy(*keys, "batch").agg(
        F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n\n").alias("passages"))


def quiz_quota(batches: DataFrame, count: int, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Questions to ask each batch: an even share, rounded up, never more than is still owed."""
    n = batches.groupBy(*keys).agg(F.count("*").alias("__n"))
    each = F.greatest(F.lit(1), F.ceil(F.lit(count) / F.col("__n")))
    owed = F.greatest(F.lit(0), F.lit(count) - each * F.col("batch"))
    return batches.join(n, list(keys)).withColumn("ask_for", F.least(each, owed).cast("int")).filter("ask_for > 0").drop("__n")


def card_quota(batches: DataFrame, count: int, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Cards to ask each batch: the cards owed shared by batch size, at least one.

    All batches but the last of a set are full, so the fold needs only their number and the
    size of the last. It stops when nothing is owed, hence within `count` steps.
    """
    sets = batches.groupBy(*keys).agg(F.sum("size").alias("__total"), F.max("size").alias("__full"), F.count("*").alias("__n"))
    start = F.struct(F.lit(count).alias("owed"), F.col("__total").alias("left"), F.array().cast("array<int>").alias("asked"))

    def ask(acc: Column, b: Column) -> Column:
        share = F.least(F.col("__full"), acc["left"])
        want = F.greatest(F.lit(1), F.bround(acc["owed"] * share / F.greatest(acc["left"], F.lit(1))).cast("int"))
        done = acc["owed"] <= 0
        return F.struct(
            F.when(done, acc["owed"]).otherwise(acc["owed"] - want).alias("owed"), (acc["left"] - share).alias("left"),
            F.when(done, acc["asked"]).otherwise(F.concat(acc["asked"], F.array(want))).alias("asked"))

    steps = F.sequence(F.lit(1), F.least(F.col("__n"), F.lit(max(count, 1))))
    asked = sets.select(*keys, F.posexplode(F.aggregate(steps, start, ask, lambda acc: acc["asked"])).alias("batch", "ask_for"))
    return batches.join(asked, [*keys, "batch"])


def parse_items(responses: DataFrame, response: str = "response") -> DataFrame:
    """One row per object in a model's JSON, which may be fenced, wrapped in prose or in an object.

    A response without JSON gives one row with `item` null and an error.
    """
    bare = let(strip(response), lambda x: F.when(F.startswith(x, F.lit("```")), F.regexp_replace(x, r"(?m)^```(?:json)?\s*|\s*```$", "")).otherwise(x))
    rows = responses.withColumn("__t", bare)
    found = F.regexp_extract("__t", r"(?s)\[.*\]|\{.*\}", 0)
    rows = rows.withColumn("__json", F.when(F.try_parse_json("__t").isNotNull(), F.col("__t")).otherwise(found))
    rows = rows.withColumn("__v", F.try_parse_json(F.nullif("__json", F.lit(""))))
    kind = F.schema_of_variant("__v")
    listed = F.expr("try_cast(__v as array<variant>)")
    held = F.expr("try_cast(__v as map<string,variant>)")
    # Keys in the order written: the first one that holds a list wraps the items.
    wrapper = F.filter(F.json_object_keys("__json"), lambda k: F.startswith(F.schema_of_variant(F.try_element_at(held, k)), F.lit("ARRAY")))
    inner = F.transform(wrapper, lambda k: F.try_element_at(held, k).cast("array<variant>"))
    is_object = F.startswith(kind, F.lit("OBJECT"))
    items = F.when(is_object & (F.size(wrapper) > 0), inner[0]).when(is_object, F.array("__v")).otherwise(listed)
    items = F.filter(items, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
    bad = F.col("__v").isNull() | ~(is_object | F.startswith(kind, F.lit("ARRAY")))
    kept = [c for c in responses.columns]
    good = rows.filter(~bad).select(*kept, F.posexplode(items).alias("place", "item")).withColumn("parse_error", F.lit(None).cast("string"))
    failed = rows.filter(bad).select(*kept, F.lit(0).alias("place"), F.lit(None).cast("variant").alias("item"), F.lit("no JSON found in response").alias("parse_error"))
    return good.unionByName(failed)


def field(name: str, item: str = "item") -> Column:
    """A text field of a parsed item, trimmed; blank when absent."""
    return F.coalesce(strip(F.try_variant_get(item, f"$.{name}", "string")), F.lit(""))


def resolve_items(items: DataFrame, labelled: DataFrame, source: str = "source", keys: tuple[str, ...] = ("set_id", "batch")) -> DataFrame:
    """The chunk behind an item's label: `[c2]` is C2. An unknown label leaves `chunk_id` null."""
    label = F.upper(F.regexp_replace(strip(source), r"^[\[\]]+|[\[\]]+$", ""))
    return items.withColumn("label", label).join(labelled.select(*keys, "label", "chunk_id"), [*keys, "label"], "left")


def normalise_mcq(options: Column | str, answer: Column | str) -> Column:
    """Index of the right option, as text; null when it cannot be told.

    The answer may be the option, its letter, its index, or the option but for case and a
    final full stop.
    """
    # Options blank after trimming do not count.
    kept = mcq_options(options)
    plain = lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")

    def find(o: Column) -> Column:
        a = strip(F.coalesce(col(answer), F.lit("")))
        letter = F.ascii(F.upper(a)) - 65
        number = a.try_cast("bigint")
        near = F.array_position(F.transform(o, plain), plain(a))
        return (
            F.when(F.size(o) < 2, None)
            .when(F.array_contains(o, a), (F.array_position(o, a) - 1).cast("string"))
            .when(a.rlike("^[A-Za-z]$") & (letter < F.size(o)), letter.cast("string"))
            .when(a.rlike("^[0-9]+$") & (number < F.size(o)), a)
            .when(near > 0, (near - 1).cast("string"))
        )

    return let(kept, find)


def mcq_options(options: Column | str) -> Column:
    return F.filter(F.transform(F.coalesce(col(options), F.array().cast("array<string>")), lambda o: strip(o)), lambda o: o != "")


def validate_questions(items: DataFrame, allowed: tuple[str, ...] = TYPES) -> DataFrame:
    """Adds `discard` (null for a good question) and the normalised type, answer and options.

    Items carry type, prompt, options, correct_answer, explanation and chunk_id.
    """
    kind = F.lower(strip(F.coalesce("type", F.lit(""))))
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    answer = strip(F.coalesce("correct_answer", F.lit("")))
    index = normalise_mcq("options", "correct_answer")
    reason = (
        F.when(F.col("chunk_id").isNull(), "unknown source")
        .when(blank("prompt") | blank("explanation"), "missing text")
        .when(~kind.isin(*TYPES), "unknown type")
        .when(~kind.isin(*allowed), "type not asked for")
        .when((kind == "mcq") & index.isNull(), "unmarkable options")
        .when((kind != "mcq") & (answer == ""), "no answer")
        .when((kind == "true_false") & ~F.lower(answer).isin("true", "false"), "neither true nor false")
    )
    final = F.when(kind == "mcq", index).when(kind == "true_false", F.lower(answer)).otherwise(answer)
    return items.withColumns({
        "discard": reason, "type": kind, "prompt": strip("prompt"), "explanation": strip("explanation"),
        "options": F.when(kind == "mcq", mcq_options("options")), "correct_answer": final,
    })


def take_wanted(valid: DataFrame, count: int, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """The first `count` kept items of each set, in the order they came."""
    w = Window.partitionBy(*keys).orderBy("batch", "place")
    return valid.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= count)


def card_discards(items: DataFrame, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Adds `discard` to cards: blank, too long, repeated front, or untraceable."""
    front, back = (strip(F.coalesce(c, F.lit(""))) for c in ("front", "back"))
    rows = items.withColumn("front", front).withColumn("back", back).withColumn("front_key", F.regexp_replace(F.lower(front), r"[?. ]+$", ""))
    reason = (
        F.when((F.col("front") == "") | (F.col("back") == ""), "missing text")
        .when(F.length("back") > MAX_BACK, "back too long")
        .when(F.col("chunk_id").isNull(), "unknown source")
    )
    rows = rows.withColumn("__bad", reason)
    # The earliest good card of each front, found by a map-side minimum rather than a sort.
    here = F.struct("batch", "place")
    first = rows.filter(F.col("__bad").isNull()).groupBy(*keys, "front_key").agg(F.min(here).alias("__first"))
    rows = rows.join(first, [*keys, "front_key"], "left")
    repeated = F.col("__bad").isNull() & (here > F.col("__first"))
    return rows.withColumn("discard", F.when(repeated, "repeated front").otherwise(F.col("__bad"))).drop("__bad", "__first")


def dedupe_cards(items: DataFrame, count: int | None, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Good cards in order, at most `count` a set; None means all."""
    good = card_discards(items, keys).filter(F.col("discard").isNull())
    return good if count is None else take_wanted(good, count, keys)


def least_used(pool: DataFrame, cards: DataFrame, size: int = BATCH, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Passages for a top-up: fewest cards so far, then reading order."""
    drawn = cards.groupBy(*keys, "chunk_id").agg(F.count("*").alias("used"))
    rows = pool.join(drawn, [*keys, "chunk_id"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("used", "chunk_index", "chunk_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= size)


def item_yield(items: DataFrame, requested: DataFrame, keys: tuple[str, ...] = ("set_id",)) -> DataFrame:
    """Per set: items asked for, kept, discarded by reason, and batches that failed."""
    counts = items.groupBy(*keys).agg(
        F.count_if(F.col("discard").isNull() & F.col("parse_error").isNull()).alias("kept"),
        F.count_if(F.col("discard").isNotNull() & F.col("parse_error").isNull()).alias("discarded"),
        F.count_if(F.col("discard") == "unknown source").alias("untraceable"),
        F.count_distinct(F.when(F.col("parse_error").isNotNull(), F.col("batch"))).alias("failed_batches"),
    )
    zero = {c: 0 for c in ("kept", "discarded", "untraceable", "failed_batches")}
    return requested.join(counts, list(keys), "left").fillna(zero)
