"""Quizzes and cards from chunks, and attempts marked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework import hooks
from passagework.functions.sequence import with_position
from passagework.operators import grading as gr
from passagework.operators import study as sd
from passagework.operators.sampling import pick_fresh
from passagework.session import cut

SET = ("set_id",)


@dataclass(frozen=True)
class Made:
    items: DataFrame
    yields: DataFrame


def _sample(chunks: DataFrame, limit: int, used: DataFrame | None, seed: int | None) -> tuple[DataFrame, DataFrame]:
    pool = cut(sd.usable_chunks(chunks))
    used = pool.select("set_id", "chunk_id").limit(0) if used is None else used
    return pool, cut(sd.label_chunks(pick_fresh(pool, limit, used, SET, seed)))


def _ask(batches: DataFrame, wording: str, responder: hooks.Responder) -> DataFrame:
    prompt = F.concat(F.lit("Write "), F.col("ask_for"), F.lit(f" {wording} from these passages.\n\n"), "passages")
    return hooks.respond(batches.withColumn("prompt", prompt), responder).select("set_id", "batch", F.coalesce("response", F.lit("")).alias("response"))


def make_quiz(chunks: DataFrame, responder: hooks.Responder, count: int = 10, used: DataFrame | None = None, allowed=("mcq", "short_answer"),
              seed: int | None = None) -> Made:
    """Questions for every set, two passages sampled per question; `chunks` carry set_id."""
    _, labelled = _sample(chunks, count * 2, used, seed)
    said = cut(_ask(sd.quiz_quota(sd.batch_prompts(labelled), count), "exam questions", responder))
    items = sd.parse_items(said)
    fields = ("type", "prompt", "correct_answer", "explanation", "source")
    items = items.select("set_id", "batch", "place", "parse_error", *[sd.field(f).alias(f) for f in fields],
                         F.try_variant_get("item", "$.options", "array<string>").alias("options"))
    judged = cut(sd.validate_questions(sd.resolve_items(items, labelled), allowed))
    judged = judged.withColumn("discard", F.when(F.col("parse_error").isNull(), F.col("discard")))
    kept = sd.take_wanted(judged.filter(F.col("discard").isNull() & F.col("parse_error").isNull()), count)
    asked = labelled.select("set_id").distinct().withColumn("requested", F.lit(count))
    return Made(kept, sd.item_yield(judged, asked))


def _cards(said: DataFrame, labelled: DataFrame) -> DataFrame:
    items = sd.parse_items(said).select("set_id", "batch", "place", "parse_error", *[sd.field(f).alias(f) for f in ("front", "back", "source")])
    return sd.resolve_items(items, labelled)


def make_cards(chunks: DataFrame, responder: hooks.Responder, count: int = 20, used: DataFrame | None = None, seed: int | None = None) -> Made:
    """Cards for every set; a set that came up short is topped up once from its least used passages."""
    pool, labelled = _sample(chunks, count, used, seed)
    first = cut(_cards(_ask(sd.card_quota(sd.batch_prompts(labelled), count), "flashcards", responder), labelled))
    good = first.filter(F.col("parse_error").isNull())
    kept = cut(sd.dedupe_cards(good, count))
    have = kept.groupBy("set_id").agg(F.count("*").alias("have"))
    short = pool.select("set_id").distinct().join(have, "set_id", "left").withColumn("ask_for", F.lit(count) - F.coalesce("have", F.lit(0))).filter("ask_for > 0").drop("have")
    last = labelled.groupBy("set_id").agg((F.max("batch") + 1).alias("batch"))
    extra = sd.label_chunks(sd.least_used(pool, kept).drop("place", "used").join(short.select("set_id"), "set_id", "left_semi"))
    extra = cut(extra.drop("batch").join(last, "set_id"))
    # Fronts written so far: at most `count` per set.
    written = kept.groupBy("set_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "front"))), lambda c: F.concat(F.lit("- "), c["front"])), "\n").alias("written"))
    prompts = sd.batch_prompts(extra).join(short, "set_id").join(written, "set_id", "left")
    prompts = prompts.withColumn("passages", F.concat(F.coalesce(F.concat(F.lit("Do not repeat:\n"), "written", F.lit("\n\n")), F.lit("")), "passages"))
    more = cut(_cards(_ask(prompts, "more flashcards", responder), extra))
    both = first.unionByName(more)
    judged = sd.card_discards(both.filter(F.col("parse_error").isNull()))
    failed = both.filter(F.col("parse_error").isNotNull()).select("set_id", "batch", "parse_error")
    asked = pool.select("set_id").distinct().withColumn("requested", F.lit(count))
    kept = sd.take_wanted(judged.filter(F.col("discard").isNull()), count)
    return Made(kept, sd.item_yield(judged.unionByName(failed, allowMissingColumns=True), asked))


def grade_attempts(questions: DataFrame, attempts: DataFrame, responses: DataFrame, chunks: DataFrame, responder: hooks.Responder,
                   source_chars: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Every question of every attempt marked, and each attempt's score.

    Written answers go to the marker in batches of eight. A batch is known by its attempt and
    number, so a marker's reply is read back to the answers it was about. The marker sees the first `source_chars`
    characters of a source.
    """
    # A question stands here once with its source; answers, of which there are attempts times questions, carry its number.
    asked = gr.sourced(questions, chunks).withColumn("source_text", F.left("source_text", F.lit(source_chars)))
    asked = cut(asked.withColumn("__q", F.monotonically_increasing_id()))
    is_written = F.col("type") == "short_answer"
    judged = asked.filter(~is_written).select("test_id", "question_id", "type", "options", "correct_answer", "explanation")
    objective = gr.grade_objective(gr.answer_rows(judged, attempts, responses))
    written = gr.answer_rows(asked.filter(is_written).select("test_id", "question_id", "position", "__q"), attempts, responses)
    numbered = cut(with_position(written.drop("test_id"), ["attempt_id"], "position", "__p").withColumn("batch", F.floor(F.col("__p") / gr.BATCH).cast("int")).drop("__p"))
    said = F.coalesce(F.nullif(F.trim(F.coalesce("response", F.lit(""))), F.lit("")), F.lit("[blank]"))
    batches = numbered.groupBy("attempt_id", "batch").agg(F.array_sort(F.collect_list(F.struct("position", "__q", said.alias("said")))).alias("items"))
    batches = batches.withColumn("ids", F.transform("items", lambda x: x["__q"]))
    # Attempts at one test share their batches' texts, which are put together once and meet the answers where a prompt is made.
    told = F.concat(F.lit("id: "), F.col("question_id").cast("string"), F.lit("\n  asked: "), "prompt", F.lit("\n  expected: "), "correct_answer",
                    F.lit("\n  from: "), "source_text", F.lit("\n  given: "))
    texts = batches.select("ids").distinct().select("ids", F.posexplode("ids").alias("place", "__q")).join(asked.select("__q", told.alias("told")), "__q")
    texts = texts.groupBy("ids").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "told"))), lambda x: x["told"]).alias("texts"))
    block = lambda item, text: F.struct(item["position"].alias("position"), F.concat(text, item["said"], F.lit("\n")).alias("block"))
    prompts = batches.join(texts, "ids").select("attempt_id", "batch", F.array_join(
        F.transform(F.array_sort(F.zip_with("items", "texts", block)), lambda b: b["block"]), "\n").alias("prompt"))
    # Replies are read twice, for items and for what has none; the marker is asked once.
    replies = cut(hooks.respond(prompts, responder).select("attempt_id", "batch", F.coalesce("response", F.lit("")).alias("response")))
    parsed = cut(sd.parse_items(replies).select("attempt_id", "batch", "place", "parse_error", sd.field("id").alias("id"), sd.field("awarded").alias("awarded"), sd.field("feedback").alias("feedback")))
    key = F.col("question_id").cast("string")
    matched = numbered.select("attempt_id", "batch", "question_id", key.alias("id")).join(parsed, ["attempt_id", "batch", "id"])
    # A repeated id: the marker's last word counts.
    grades = matched.groupBy("attempt_id", "question_id").agg(F.max_by("awarded", "place").alias("awarded"), F.max_by("feedback", "place").alias("feedback"))
    failed = numbered.join(parsed.filter(F.col("parse_error").isNotNull()).select("attempt_id", "batch"), ["attempt_id", "batch"], "left_semi").select("attempt_id", "question_id")
    answers = numbered.drop("batch", "position").join(asked.select("__q", "type", "correct_answer", "explanation"), "__q").drop("__q")
    marked = gr.apply_written_grades(answers, grades, failed)
    kept = ["attempt_id", "question_id", "type", "is_correct", "awarded", "feedback"]
    graded = objective.select(*kept).unionByName(marked.select(*kept))
    return graded, gr.attempt_score(graded)
