"""Checked queries: quiz items, cards, marking."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.frames import table
from passagework.functions.text import token_count
from passagework.operators import grading as gr
from passagework.operators import study as sd

QUERIES, ORACLES = {}, {}


def check(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


# Documents as study passages: a set per source, headings of every sort; some texts open with a list or a credit.
PASSAGES = """passages AS (SELECT source AS set_id, doc_id AS chunk_id, doc_id AS chunk_index,
    CASE WHEN doc_id % 4 = 1 THEN 'Hardware: Arduino Uno, LCD' || chr(10) WHEN doc_id % 8 = 3 THEN 'Submitted by A. Student' || chr(10) ELSE '' END || text AS text,
    lang AS section, CASE doc_id % 6 WHEN 0 THEN 'References' WHEN 1 THEN '3. Sound sensors:' WHEN 2 THEN '7.1 Agenda' WHEN 3 THEN 'Slide 4' WHEN 4 THEN '' END AS heading,
    CASE WHEN doc_id % 2 = 1 THEN doc_id % 30 END AS slide_number FROM documents)"""


def study_passages(spark, sf):
    d, kind = table(spark, sf, "documents"), F.col("doc_id") % 6
    opening = F.when(F.col("doc_id") % 4 == 1, "Hardware: Arduino Uno, LCD\n").when(F.col("doc_id") % 8 == 3, "Submitted by A. Student\n").otherwise("")
    text = F.concat(opening, "text")
    heading = F.when(kind == 0, "References").when(kind == 1, "3. Sound sensors:").when(kind == 2, "7.1 Agenda").when(kind == 3, "Slide 4").when(kind == 4, "")
    return d.select(
        F.col("source").alias("set_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("chunk_index"), text.alias("text"), F.col("lang").alias("section"),
        heading.alias("heading"), F.array("lang").alias("heading_path"), F.when(F.col("doc_id") % 2 == 1, (F.col("doc_id") % 30).cast("int")).alias("slide_number"),
        token_count(text).alias("token_count"))


@check("usable_chunks", f"""WITH {PASSAGES}, n AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)) END AS tokens FROM passages)
    SELECT chunk_id FROM n WHERE regexp_matches(text, '\\S') AND chunk_id % 6 NOT IN (0, 2) AND (tokens >= 25 OR (slide_number IS NOT NULL AND chunk_id % 6 = 1 AND tokens >= 4 AND chunk_id % 8 <> 3))""")
def usable_chunks(spark, sf):
    return sd.usable_chunks(study_passages(spark, sf)).select("chunk_id")


LABELLED = PASSAGES + """,
    labelled AS (SELECT *, (row_number() OVER w - 1) // 6 AS batch, 'C' || ((row_number() OVER w - 1) % 6 + 1) AS label FROM passages WINDOW w AS (PARTITION BY set_id ORDER BY chunk_index))"""


@check("label_chunks", f"WITH {LABELLED} SELECT chunk_id, batch, label FROM labelled")
def label_chunks(spark, sf):
    return sd.label_chunks(study_passages(spark, sf)).select("chunk_id", "batch", "label")


@check("batch_prompts", rf"""WITH {LABELLED} SELECT set_id, batch, count(*) AS size,
    string_agg('[' || label || '] ' || coalesce(nullif(heading, ''), section) || chr(10) || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY chunk_index) AS passages FROM labelled GROUP BY ALL""")
def batch_prompts(spark, sf):
    return sd.batch_prompts(sd.label_chunks(study_passages(spark, sf)))


@check("quiz_quota", f"""WITH {LABELLED}, b AS (SELECT DISTINCT set_id, batch FROM labelled), n AS (SELECT set_id, ceil(40 / count(*))::INT AS each FROM b GROUP BY 1)
    SELECT set_id, batch, least(each, greatest(0, 40 - each * batch)) AS ask_for FROM b JOIN n USING (set_id) WHERE 40 - each * batch > 0""")
def quiz_quota(spark, sf):
    b = sd.label_chunks(study_passages(spark, sf)).groupBy("set_id", "batch").agg(F.count("*").alias("size"))
    return sd.quiz_quota(b, 40).select("set_id", "batch", "ask_for")


@check("card_quota", f"""WITH RECURSIVE {LABELLED}, b AS (SELECT set_id, batch, count(*) AS size FROM labelled GROUP BY ALL), t AS (SELECT set_id, sum(size)::INT AS total FROM b GROUP BY 1),
    f AS (SELECT set_id, 0 AS batch, 17 AS owed, total AS remaining, greatest(1, round_even(17 * size / total, 0))::INT AS ask_for, size FROM b JOIN t USING (set_id) WHERE batch = 0
        UNION ALL SELECT f.set_id, b.batch::INT, f.owed - f.ask_for, (f.remaining - f.size)::INT, greatest(1, round_even((f.owed - f.ask_for) * b.size / (f.remaining - f.size), 0))::INT, b.size
        FROM f JOIN b ON b.set_id = f.set_id AND b.batch = f.batch + 1 WHERE f.owed - f.ask_for > 0)
    SELECT set_id, batch, ask_for FROM f""")
def card_quota(spark, sf):
    b = sd.label_chunks(study_passages(spark, sf)).groupBy("set_id", "batch").agg(F.count("*").alias("size"))
    return sd.card_quota(b, 17).select("set_id", "batch", "ask_for")


ITEMS = LABELLED + """,
    items AS (SELECT set_id, batch, label, chunk_id AS doc_id, row_number() OVER (PARTITION BY set_id, batch ORDER BY chunk_id) - 1 AS place,
        CASE chunk_id % 7 WHEN 4 THEN ' True_False' WHEN 5 THEN 'short_answer' WHEN 6 THEN 'essay' ELSE 'MCQ' END AS type,
        CASE WHEN chunk_id % 13 = 0 THEN ' ' ELSE 'Which of these is ' || set_id || '?' END AS prompt,
        [' ' || section, set_id, 'neither.', ''] AS options,
        CASE chunk_id % 5 WHEN 0 THEN section WHEN 1 THEN 'b' WHEN 2 THEN '2' WHEN 3 THEN 'NEITHER' ELSE 'FALSE' END AS answer,
        CASE WHEN chunk_id % 11 = 0 THEN 'c9' ELSE '[' || lower(label) || '] ' END AS source FROM labelled)"""


def study_items(spark, sf):
    rows = sd.label_chunks(study_passages(spark, sf))
    d = F.col("chunk_id")
    pick = lambda n, *cases: _case(d % n, cases)
    return rows.select(
        "set_id", "batch", d.alias("doc_id"), (F.substring("label", 2, 2).cast("int") - 1).alias("place"),
        pick(7, "MCQ", "MCQ", "MCQ", "MCQ", " True_False", "short_answer", "essay").alias("type"),
        F.when(d % 13 == 0, " ").otherwise(F.concat(F.lit("Which of these is "), "set_id", F.lit("?"))).alias("prompt"),
        F.array(F.concat(F.lit(" "), "section"), "set_id", F.lit("neither."), F.lit("")).alias("options"),
        pick(5, F.col("section"), "b", "2", "NEITHER", "FALSE").alias("correct_answer"), F.lit("Because.").alias("explanation"),
        F.when(d % 11 == 0, "c9").otherwise(F.concat(F.lit("["), F.lower("label"), F.lit("] "))).alias("source"))


def _case(key, cases):
    out = None
    for i, value in enumerate(cases):
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(key == i, value) if out is None else out.when(key == i, value)
    return out


def _resolved(spark, sf):
    labelled = sd.label_chunks(study_passages(spark, sf))
    return sd.resolve_items(study_items(spark, sf), labelled)


@check("resolve_items", f"WITH {ITEMS} SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS chunk_id FROM items")
def resolve_items(spark, sf):
    return _resolved(spark, sf).select("doc_id", "chunk_id")


VALID = ITEMS + """,
    judged AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'unknown source' WHEN doc_id % 13 = 0 THEN 'missing text' WHEN type = 'essay' THEN 'unknown type'
        WHEN type = 'MCQ' AND answer = 'FALSE' THEN 'unmarkable options' WHEN type = ' True_False' AND answer <> 'FALSE' THEN 'neither true nor false' END AS discard FROM items)"""


@check("validate_questions", f"""WITH {VALID} SELECT doc_id, discard, CASE WHEN discard IS NULL THEN CASE WHEN type <> 'MCQ' THEN CASE type WHEN ' True_False' THEN 'false' ELSE answer END
        WHEN doc_id % 5 = 0 THEN '0' WHEN doc_id % 5 = 1 THEN '1' ELSE '2' END END AS correct_answer FROM judged""")
def validate_questions(spark, sf):
    v = sd.validate_questions(_resolved(spark, sf))
    return v.select("doc_id", "discard", F.when(F.col("discard").isNull(), F.col("correct_answer")).alias("correct_answer"))


@check("take_wanted", f"WITH {VALID} SELECT set_id, doc_id, row_number() OVER (PARTITION BY set_id ORDER BY batch, place) AS position FROM judged WHERE discard IS NULL QUALIFY position <= 10")
def take_wanted(spark, sf):
    v = sd.validate_questions(_resolved(spark, sf)).filter(F.col("discard").isNull())
    return sd.take_wanted(v, 10).select("set_id", "doc_id", "position")


def _responses(spark, sf):
    """Items of a batch as a model would send them: plain, fenced, in prose, in an object, or broken."""
    packed = study_items(spark, sf).groupBy("set_id", "batch").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "type", "prompt", "options", "correct_answer", "source"))).alias("items"))
    j = F.to_json("items")
    kind = F.col("batch") % 5
    said = (
        F.when(kind == 0, j).when(kind == 1, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here you are:\n"), j, F.lit("\nGood luck!")))
        .when(kind == 3, F.concat(F.lit('{"note": "x", "questions": '), j, F.lit("}"))).otherwise("Sorry, nothing today."))
    return packed.select("set_id", "batch", said.alias("response"))


@check("parse_items", f"""WITH {ITEMS} SELECT set_id, batch, place, doc_id::VARCHAR AS doc_id, trim(prompt) AS prompt, trim(type) AS type, NULL AS parse_error FROM items WHERE batch % 5 <> 4
    UNION ALL SELECT DISTINCT set_id, batch, 0, '', '', '', 'no JSON found in response' FROM items WHERE batch % 5 = 4""")
def parse_items(spark, sf):
    p = sd.parse_items(_responses(spark, sf))
    return p.select("set_id", "batch", "place", *[sd.field(n).alias(n) for n in ("doc_id", "prompt", "type")], "parse_error")


@check("item_yield", f"""WITH {VALID}, j AS (SELECT set_id, batch, discard, batch % 5 = 4 AS failed FROM judged)
    SELECT set_id, 20 AS requested, count(*) FILTER (discard IS NULL AND NOT failed) AS kept, count(*) FILTER (discard IS NOT NULL AND NOT failed) AS discarded,
           count(*) FILTER (discard = 'unknown source' AND NOT failed) AS untraceable, count(DISTINCT batch) FILTER (failed) AS failed_batches FROM j GROUP BY 1""")
def item_yield(spark, sf):
    v = sd.validate_questions(_resolved(spark, sf)).withColumn("parse_error", F.when(F.col("batch") % 5 == 4, "no JSON found in response"))
    v = v.withColumn("discard", F.when(F.col("parse_error").isNull(), F.col("discard")))
    asked = v.select("set_id").distinct().withColumn("requested", F.lit(20))
    return sd.item_yield(v, asked)


CARDS = LABELLED + """,
    cards AS (SELECT set_id, batch, label, chunk_id AS doc_id, 'What is ' || section || ' ' || (chunk_id % 9) || '? ' AS front, CASE WHEN chunk_id % 10 = 0 THEN ' ' ELSE text END AS back,
        row_number() OVER (PARTITION BY set_id, batch ORDER BY chunk_id) - 1 AS place FROM labelled),
    good AS (SELECT *, regexp_replace(lower(trim(front)), '[?. ]+$', '') AS k FROM cards WHERE regexp_matches(back, '\\S') AND length(regexp_replace(back, '^\\s+|\\s+$', '', 'g')) <= 400 AND doc_id % 11 <> 0
             QUALIFY row_number() OVER (PARTITION BY set_id, k ORDER BY batch, place) = 1)"""


def _cards(spark, sf):
    rows = sd.label_chunks(study_passages(spark, sf))
    d = F.col("chunk_id")
    return rows.select(
        "set_id", "batch", d.alias("doc_id"), (F.substring("label", 2, 2).cast("int") - 1).alias("place"), F.when(d % 11 != 0, d).alias("chunk_id"),
        F.concat(F.lit("What is "), "section", F.lit(" "), (d % 9), F.lit("? ")).alias("front"), F.when(d % 10 == 0, " ").otherwise(F.col("text")).alias("back"))


@check("dedupe_cards", f"WITH {CARDS} SELECT set_id, doc_id, row_number() OVER (PARTITION BY set_id ORDER BY batch, place) AS position FROM good QUALIFY position <= 10")
def dedupe_cards(spark, sf):
    return sd.dedupe_cards(_cards(spark, sf), 10).select("set_id", "doc_id", "position")


@check("least_used", f"""WITH {CARDS}, u AS (SELECT set_id, doc_id, count(*) AS used FROM good GROUP BY ALL)
    SELECT p.set_id, p.chunk_id, coalesce(used, 0) AS used, row_number() OVER (PARTITION BY p.set_id ORDER BY coalesce(used, 0), chunk_index) AS place FROM passages p LEFT JOIN u ON u.set_id = p.set_id AND u.doc_id = p.chunk_id QUALIFY place <= 6""")
def least_used(spark, sf):
    kept = sd.dedupe_cards(_cards(spark, sf), None).select("set_id", "chunk_id")
    return sd.least_used(study_passages(spark, sf), kept).select("set_id", "chunk_id", "used", "place")


# Orders as attempts at the test of their customer's segment; the lines as its answers.
def _attempt_answers(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("n", F.col("l_linenumber"))
    return li.select(
        F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("question_id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.when(F.col("l_linenumber") <= 4, "mcq").otherwise("true_false").alias("type"), F.array(F.lit("A"), F.lit("N"), F.lit("R")).alias("options"),
        F.when(F.col("l_linenumber") <= 4, F.col("l_partkey") % 3).otherwise(F.col("l_partkey") % 3).cast("string").alias("correct_answer"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise((F.col("l_suppkey") % 3).cast("string")).alias("response"), F.lit("See notes.").alias("explanation"))


@check("grade_objective", """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 3)::VARCHAR AS good, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE (l_suppkey % 3)::VARCHAR END AS said FROM lineitem),
    c AS (SELECT *, CASE WHEN l_linenumber <= 4 THEN CASE said WHEN 'A' THEN '0' WHEN 'N' THEN '1' WHEN 'R' THEN '2' ELSE said END ELSE lower(said) END AS chosen FROM a)
    SELECT l_orderkey AS attempt_id, l_linenumber AS question_id, l_partkey AS part, l_suppkey AS supp, chosen = good AS is_correct, CASE WHEN chosen = good THEN 1.0 ELSE 0.0 END::DOUBLE AS awarded, 'See notes.' AS feedback FROM c""")
def grade_objective(spark, sf):
    return gr.grade_objective(_attempt_answers(spark, sf)).select("attempt_id", "question_id", "part", "supp", "is_correct", "awarded", "feedback")


@check("attempt_score", """SELECT l_orderkey AS attempt_id, round_even(sum(least(1, l_discount * 10)), 2) AS score, count(*) AS max_score, count(*) FILTER (least(1, l_discount * 10) >= 0.7) AS correct FROM lineitem GROUP BY 1""")
def attempt_score(spark, sf):
    credit = F.least(F.lit(1.0), F.col("l_discount") * 10)
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("attempt_id"), credit.alias("awarded"), (credit >= gr.CORRECT).alias("is_correct"))
    return gr.attempt_score(a)


WRITTEN = """answers AS (SELECT o_orderkey AS attempt_id, o_custkey AS question_id, 'It is ' || o_orderpriority AS correct_answer FROM orders),
    grades AS (SELECT o_orderkey AS attempt_id, CASE WHEN o_orderstatus = 'F' THEN 'most of it' WHEN o_orderstatus = 'P' THEN NULL ELSE (o_totalprice / 400000)::VARCHAR END AS awarded, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE 'Well done' END AS feedback FROM orders WHERE o_orderpriority <> '5-LOW'),
    failures AS (SELECT o_orderkey AS attempt_id FROM orders WHERE o_orderpriority = '1-URGENT')"""


@check("apply_written_grades", f"""WITH {WRITTEN}, j AS (SELECT a.*, g.attempt_id IS NOT NULL AND a.attempt_id NOT IN (FROM failures) AS marked, a.attempt_id IN (FROM failures) AS lost, greatest(0, least(1, coalesce(try_cast(g.awarded AS DOUBLE), 0))) AS credit, trim(g.feedback) AS said
        FROM answers a LEFT JOIN grades g USING (attempt_id))
    SELECT attempt_id, round(CASE WHEN marked THEN credit ELSE 0 END, 9)::DOUBLE AS awarded, marked AND credit >= 0.7 AS is_correct,
        CASE WHEN marked THEN coalesce(nullif(said, ''), 'See notes.') WHEN lost THEN '{gr.FAILED}' || correct_answer ELSE '{gr.UNMARKED}' || correct_answer END AS feedback FROM j""")
def apply_written_grades(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "attempt_id").withColumnRenamed("o_custkey", "question_id")
    answers = o.select("attempt_id", "question_id", F.concat(F.lit("It is "), "o_orderpriority").alias("correct_answer"), F.lit("See notes.").alias("explanation"))
    said = F.when(F.col("o_orderstatus") == "F", "most of it").when(F.col("o_orderstatus") != "P", (F.col("o_totalprice") / 400000).cast("string"))
    grades = o.filter("o_orderpriority <> '5-LOW'").select("attempt_id", "question_id", said.alias("awarded"), F.when(F.col("attempt_id") % 3 == 0, " ").otherwise("Well done").alias("feedback"))
    failed = o.filter("o_orderpriority = '1-URGENT'").select("attempt_id", "question_id")
    return gr.apply_written_grades(answers, grades, failed).select("attempt_id", F.round("awarded", 9).alias("awarded"), "is_correct", "feedback")


QUIZ = """questions AS (SELECT s_nationkey AS test_id, s_suppkey AS question_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey * 3 END AS source_chunk_id FROM supplier),
    attempts AS (SELECT c_custkey AS attempt_id, c_nationkey AS test_id FROM customer),
    responses AS (SELECT o_custkey AS attempt_id, o_orderkey % (SELECT count(*) FROM supplier) AS question_id, max(o_orderpriority) AS response FROM orders GROUP BY ALL)"""


def _quiz(spark, sf):
    supplier = table(spark, sf, "supplier")
    n = supplier.agg(F.count("*")).scalar()
    q = supplier.select(F.col("s_nationkey").alias("test_id"), F.col("s_suppkey").alias("question_id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") * 3).alias("source_chunk_id"))
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("attempt_id"), F.col("c_nationkey").alias("test_id"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("attempt_id"), (F.col("o_orderkey") % n).alias("question_id"), "o_orderpriority")
    return q, a, r.groupBy("attempt_id", "question_id").agg(F.max("o_orderpriority").alias("response"))


@check("grade_join", f"""WITH {QUIZ} SELECT a.attempt_id, q.question_id, r.response, coalesce(d.text, '') AS source_text FROM attempts a JOIN questions q USING (test_id)
    LEFT JOIN responses r ON r.attempt_id = a.attempt_id AND r.question_id = q.question_id LEFT JOIN documents d ON d.doc_id = q.source_chunk_id""")
def grade_join(spark, sf):
    q, a, r = _quiz(spark, sf)
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return gr.grade_join(q, a, r, chunks).select("attempt_id", "question_id", "response", "source_text")


@check("unknown_answers", f"""WITH {QUIZ} SELECT attempt_id, question_id, response FROM responses r WHERE NOT EXISTS (SELECT 1 FROM attempts a JOIN questions q USING (test_id) WHERE a.attempt_id = r.attempt_id AND q.question_id = r.question_id)""")
def unknown_answers(spark, sf):
    q, a, r = _quiz(spark, sf)
    return gr.unknown_answers(q, a, r).select("attempt_id", "question_id", "response")
