import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from passagework import hooks
from passagework.operators import context as cx
from passagework.operators import conversation as cv
from passagework.operators import images as im
from passagework.operators import sampling as sm
from passagework.operators import structure as sx
from passagework.operators import study as sd
from passagework.session import work_dir
from passagework.sources import gold as sg
from passagework.sources import reports
from passagework.sources import uploads as su


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


RANKED = ("query_id int, rank int, chunk_id string, document_id string, document_name string, page_number int, page_end int, slide_number int, "
          "heading_path array<string>, source string, text string")


def fill(rows, max_tokens, max_chunks):
    """Admission, one query at a time."""
    kept, sets, used = [], [], 0
    for rank, name, text in rows:
        body = text.strip()
        w = body.lower().split()
        runs = {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
        cost = max(1, round(len(f"[S{len(kept) + 1}] {name}\n{body}") / 4))
        if len(kept) < max_chunks and body and used + cost <= max_tokens and not any(len(runs & o) / min(len(runs), len(o)) >= 0.85 for o in sets):
            kept.append(rank)
            sets.append(runs)
            used += cost
    return kept


def test_build_context_against_a_plain_loop(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 60))) for _ in range(12)]
    rows, want = [], {}
    for q in range(20):
        mine = [(r, "n.pdf", rng.choice(texts)) for r in range(1, rng.randint(2, 14))]
        rows += [(q, r, f"c{r}", "d", n, None, None, None, [], "text", x) for r, n, x in mine]
        want[q] = fill(mine, 100, 4)
    contexts, sources = cx.build_context(spark.createDataFrame(rows, RANKED), 100, 4)
    got = {c.query_id: c for c in contexts.collect()}
    named = {}
    for s in sources.collect():
        named.setdefault(s.query_id, {})[s.marker] = s.chunk_id
    for q, ranks in want.items():
        assert named.get(q, {}) == {f"S{i}": f"c{r}" for i, r in enumerate(ranks, 1)}
        assert got[q].sources == len(ranks) and got[q].dropped == len([r for r in rows if r[0] == q]) - len(ranks)


def test_near_duplicates_deep_and_shallow(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, r, text if r % 3 else f"row {r} says something else entirely here now") for r in range(1, 70)]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string")
    copies = [r for _, r, x in rows if x == text]
    want = {(a, b) for a in copies for b in copies if a < b}
    assert {(x["rank"], x.later) for x in cx.near_duplicates(df).collect()} == want
    shallow = cx.near_duplicates(df.filter("rank <= 30"))
    assert {(x["rank"], x.later) for x in shallow.collect()} == {p for p in want if p[1] <= 30}


def test_near_duplicates_pairs_are_added_up_before_they_are_shuffled(spark):
    rng = random.Random(5)
    parts = [" ".join(rng.choices("river stone walk blue seven light corn end north tall".split(), k=6)) for _ in range(40)]
    rows = [(q, r, " . ".join(rng.sample(parts, 12))) for q in (None, 1, 2) for r in range(1, 71)]
    rows += [(3, 1, "same words in one ranking twice over"), (3, 2, "same words in one ranking twice over"), (3, 3, None), (3, 4, "")]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string")
    sets = {(q, r): cx._words(x or "") for q, r, x in rows if q is not None}
    want = {(q, r, later): len(a & b) / min(len(a), len(b)) for (q, r), a in sets.items() for (p, later), b in sets.items()
            if p == q and r < later and a & b and len(a & b) / min(len(a), len(b)) >= 0.1}
    found = cx.near_duplicates(df, 0.1)
    got = {(x.query_id, x["rank"], x.later): x.overlap for x in found.collect()}
    assert got == pytest.approx(want) and len(want) > 500 and want[3, 1, 2] == 1
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("question,last2,want", [
    ("how does it work", [], True), ("and then?", [], True), ("what are the advantages?", ["Hashing is fast"], True), ("what is Pharmakon?", ["The college was founded"], False),
    ("when was the college founded?", ["colleges in town"], True), ("compare hashing sorting merging scanning probing costs", ["hashing"], False)])
def test_needs_context(spark, question, last2, want):
    arr = F.array(*[F.lit(x) for x in last2]).cast("array<string>")
    assert value(spark, cv.needs_context(F.lit(question), arr)) is want


@pytest.mark.parametrize("question,want", [
    ("Summarise this", True), ("What are the key points?", True), ("What is most likely to be asked in the exam?", True), ("Summarise normalization", False),
    ("What is a key?", False), ("hello", False), ("What is my deck about?", True)])
def test_overview(spark, question, want):
    assert value(spark, cv.is_overview_question(F.lit(question))) is want


def plain_spread(n, limit):
    return list(range(n)) if limit >= n else [int(i * (n / limit)) for i in range(limit)]


def test_spreads(spark):
    rows = [(f"d{n}", i, f"{n}-{i}") for n in (1, 2, 3, 7, 10, 49, 100, 333) for i in range(n)]
    df = spark.createDataFrame(rows, "document_id string, chunk_index int, chunk_id string")
    for limit in (1, 3, 7, 12, 50):
        got = {}
        for x in sm.even_spread(df, limit).collect():
            got.setdefault(x.document_id, []).append(x.chunk_index)
        lots = sm.stratified_spread(df, limit, 5).groupBy("document_id").count().collect()
        for n in (1, 2, 3, 7, 10, 49, 100, 333):
            assert sorted(got[f"d{n}"]) == plain_spread(n, limit)
        assert {x.document_id: x["count"] for x in lots} == {f"d{n}": min(n, limit) for n in (1, 2, 3, 7, 10, 49, 100, 333)}
    assert sm.even_spread(df, 0).count() == 0


@pytest.mark.parametrize("limit", [3, 8, 20, 1000])
def test_spread_by_document(spark, limit):
    sizes = [1, 2, 2, 2, 5, 9, 30]
    rows = [("u", f"d{k}", i, f"{k}-{i}") for k, n in enumerate(sizes) for i in range(n)]
    got = sm.spread_by_document(spark.createDataFrame(rows, "user_id string, document_id string, chunk_index int, chunk_id string"), limit)
    want, left = {}, limit
    for k, n in enumerate(sizes):
        share = max(1, left // (len(sizes) - k))
        want[f"d{k}"] = sorted(plain_spread(n, share))
        left -= len(want[f"d{k}"])
        if left <= 0:
            break
    mine = {}
    for x in got.collect():
        mine.setdefault(x.document_id, []).append(x.chunk_index)
    assert {k: sorted(v) for k, v in mine.items()} == want


def plain_levels(lines):
    """heading_levels for one document of (text, size, bold)."""
    weights = {}
    for text, size, _ in lines:
        weights[round(size, 1)] = weights.get(round(size, 1), 0) + max(len(text.strip()), 1)
    body = max(weights, key=lambda s: weights[s])
    top = max(s for s, w in weights.items() if s == body or w >= max(weights[body] * 0.3, 200))
    heads = [size >= top * 1.08 or (bold and text.istitle()) for text, size, bold in lines]
    leads = []
    for size in sorted({round(s, 2) for (_, s, _), h in zip(lines, heads) if h}, reverse=True):
        if not leads or abs(leads[-1] - size) / leads[-1] > 0.03:
            leads.append(size)
    out = []
    for (_, size, _), h in zip(lines, heads):
        level = min(range(len(leads)), key=lambda i: abs(leads[i] - round(size, 2))) + 1 if h else None
        if h and size < top * 1.08:
            level = min(len(leads) + 1, 6)
        out.append(level and min(level, 6))
    return out


def test_heading_levels(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for d in range(15):
        lines = [(rng.choice(["Third Normal Form", "plain words set in rows of body text that goes on"]), rng.choice([10.0, 10.0, 10.0, 12.0, 12.2, 14.0, 18.0, 24.0]), rng.random() < 0.3) for _ in range(30)]
        rows += [(f"d{d}", i, 1, *x) for i, x in enumerate(lines)]
        want[f"d{d}"] = plain_levels(lines)
    df = spark.createDataFrame(rows, "document_id string, order int, page int, text string, font_size double, is_bold boolean")
    got = {}
    for x in sx.heading_levels(df).orderBy("order").collect():
        got.setdefault(x.document_id, []).append(x.level)
    assert got == want


def test_gold_files(spark, tmp_path):
    good = tmp_path / "gold.jsonl"
    good.write_text('// hand written\n\n{"question": "q?", "relevant_chunk_ids": ["b", "a"], "graded": {"a": 0.5}}\n{"question": "r?", "relevant_chunk_ids": ["c"], "note": "x"}\n')
    gold = sg.read_gold(spark, str(good))
    lines = [json.loads(x.value) for x in sg.gold_lines(gold).collect()]
    assert sorted(lines, key=lambda x: x["question"]) == [
        {"question": "q?", "relevant_chunk_ids": ["a", "b"], "graded": {"a": 0.5}}, {"question": "r?", "relevant_chunk_ids": ["c"], "note": "x"}]
    gains = {x.chunk_id: x.gain for x in sg.qrels_of(gold).collect()}
    assert gains == {"a": 0.5, "b": 0.0, "c": 1.0}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"question": "q?", "relevant_chunk_ids": ["a"]}\nnot json\n')
    with pytest.raises(ValueError, match=r"bad.jsonl:2"):
        sg.read_gold(spark, str(bad))
    empty = tmp_path / "empty.jsonl"
    empty.write_text("// nothing\n")
    with pytest.raises(ValueError, match="no gold"):
        sg.read_gold(spark, str(empty))
    sg.write_gold(gold, str(tmp_path / "out"))
    assert sg.read_gold(spark, str(tmp_path / "out")).count() == 2


def test_reports_can_be_read_again(spark):
    m = spark.createDataFrame([(i, s, "mrr", (i % 3) / 3 + (0.3 if s == "a" else 0)) for i in range(12) for s in ("a", "b")], "query_id int, strategy string, metric string, value double")
    path = work_dir(spark)
    reports.write_report(m, path)
    c = reports.reanalyse(spark, path, "b", resamples=500).collect()
    assert [(x.strategy, x.wins, round(x.difference, 6), x.p_bootstrap) for x in c] == [("a", 12, 0.3, 0.0)]


def test_uploads_by_content(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"%PDF-1.7 rest")
    (tmp_path / "b.bin").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    for name, part in (("c.pptx", "ppt/presentation.xml"), ("d.docx", "word/document.xml")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(part, "x")
    got = {x.path.rsplit("/", 1)[-1]: x.kind for x in su.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "pdf", "b.bin": "ppt", "c.pptx": "pptx", "d.docx": None}


@pytest.mark.parametrize("options,answer,want", [
    (["a", "b"], "b", "1"), (["x", "y"], "B", "1"), (["x", "y"], "0", "0"), (["Third.", "Other"], "third", "0"), (["x", "y"], "C", None), (["x", "y"], "7", None),
    (["only", " "], "only", None), (["x", "y"], "", None)])
def test_normalise_mcq(spark, options, answer, want):
    assert value(spark, sd.normalise_mcq(F.array(*[F.lit(o) for o in options]), F.lit(answer))) == want


def test_parse_items(spark):
    raw = ['[{"a": 1}, 2, {"a": 2}]', '```json\n[{"a": 1}]\n```', 'Sure: {"a": 1} done', '{"z": 1, "items": [{"a": 5}], "b": [{"a": 6}]}', "nothing", "3"]
    got = sd.parse_items(spark.createDataFrame(list(enumerate(raw)), "n int, response string")).select("n", "place", sd.field("a").alias("a"), "parse_error").collect()
    assert sorted((x.n, x.place, x.a, x.parse_error is None) for x in got) == [
        (0, 0, "1", True), (0, 1, "2", True), (1, 0, "1", True), (2, 0, "1", True), (3, 0, "5", True), (4, 0, "", False), (5, 0, "", False)]


def test_hooks(spark):
    df = spark.createDataFrame([("has [S1]",), ("nothing",), ("boom",)], "prompt string")

    def answer(prompt):
        if prompt == "boom":
            raise RuntimeError("model down")
        return hooks.stand_in_response(prompt)

    got = {x.prompt: (x.response, x.error) for x in hooks.respond(df, answer).collect()}
    assert got["nothing"] == ("NOT_SUPPORTED", None) and got["boom"] == (None, "model down") and "[S1]" in got["has [S1]"][0]
    with pytest.raises(Exception, match="embedder returned"):
        hooks.embed(df, lambda texts: [], "prompt").collect()


def test_reading_blocks(spark):
    rows = [("d", 1, 3, None, "h", True, "intro\n# 2.1 Scope #\nbody\n# Table 1.3\nrow\n## *Notes*\n"), ("d", 2, 4, None, "i", False, "# Title\nrow")]
    df = spark.createDataFrame(rows, "document_id string, order int, page int, slide int, content_hash string, whole_page boolean, reading string")
    got = [(x.order, x.type, x.level, x.text) for x in im.reading_blocks(df).orderBy("order", "part").collect()]
    assert got == [(1, "figure", None, "intro"), (1, "heading", 2, "2.1 Scope"), (1, "figure", None, "body\nTable 1.3\nrow"), (1, "heading", 2, "Notes"), (2, "figure", None, "Title\nrow")]


def test_lines_keep_their_numbers_over_splits(spark, tmp_path):
    """Files cut into splits of few bytes, with lines ended by CR LF, blank and last lines without an end."""
    files = {"a.txt": "\n".join(f"line {k} " + "x" * (k % 40) for k in range(400)), "b.txt": "\r\n".join(["one", "", "three", "four"]), "c.txt": "", "d.txt": "only\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        read = sg.numbered_lines(spark, str(tmp_path))
        got = {(r.file.rsplit("/", 1)[1], r.line, r.raw.rstrip("\r")) for r in read.collect()}
        (tmp_path / "z.txt").write_text("\n".join(['{"question": "q", "relevant_chunk_ids": ["a"]}'] * 57 + ["// fine", "", "{broken"] + ["{worse"] * 9))
        with pytest.raises(ValueError, match=r"z\.txt:60 is not"):
            sg.read_gold(spark, str(tmp_path / "z.txt"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(name, k, line) for name, text in files.items() for k, line in enumerate(text.replace("\r", "").removesuffix("\n").split("\n") if text else [], 1)}


def test_unknown_answers_make_no_table_of_all_questions(spark):
    """Answers of known, other and no tests, an attempt at two tests, nulls; no join keeps attempts times questions."""
    from passagework.operators import grading as gr

    questions = spark.createDataFrame([(t, 10 * t + n) for t in range(3) for n in range(5)], "test_id int, question_id int")
    attempts = spark.createDataFrame([(1, 0), (2, 1), (2, 2), (2, 2), (3, 9)], "attempt_id int, test_id int")
    said = [(1, 0), (1, 4), (1, 10), (2, 11), (2, 24), (2, 3), (3, 0), (4, 0), (None, 0), (1, None)]
    responses = spark.createDataFrame(said, "attempt_id int, question_id int").withColumn("response", F.lit("x"))
    got = gr.unknown_answers(questions, attempts, responses)
    assert sorted(map(str, ((r.attempt_id, r.question_id) for r in got.collect()))) == sorted(map(str, [(1, 10), (2, 3), (3, 0), (4, 0), (None, 0), (1, None)]))
    # Tests meet questions only together with an answer's question.
    joins = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert not any("test_id" in x and "question_id" not in x for x in joins)


def _marking(spark):
    from passagework.operators import grading as gr

    questions = spark.createDataFrame([(t, q, q % 5, "short_answer" if q % 2 else "true_false", f"p{q}", "true", "why", [], q) for t in (1, 2) for q in range(t * 100, t * 100 + 24)]
                                      + [(2, 200, 0, "true_false", "again", "false", "why", [], None), (None, 7, 0, "short_answer", "lost", "true", "why", [], 1)],
                                      "test_id int, question_id int, position int, type string, prompt string, correct_answer string, explanation string, options array<string>, source_chunk_id int")
    questions = questions.withColumn("position", F.col("question_id"))
    attempts = spark.createDataFrame([(a, 1 + a % 2) for a in range(6)] + [(3, 2), (8, None), (9, 5), (None, 1)], "attempt_id int, test_id int")
    responses = spark.createDataFrame([(a, q, f" r{a}.{q} ") for a in range(7) for q in (100, 101, 200, 203, 999)] + [(2, 101, "twice"), (2, None, "x"), (None, 100, "y"), (1, 205, None)], "attempt_id int, question_id int, response string")
    chunks = spark.createDataFrame([(q, f"text {q}") for q in range(100, 210)] + [(103, "another")], "chunk_id int, text string")
    return gr, questions, attempts, responses, chunks


def test_grade_join_makes_pairs_where_they_are_used(spark, monkeypatch):
    gr, questions, attempts, responses, chunks = _marking(spark)
    monkeypatch.setattr(gr, "DEALT", 10)
    rows = attempts.join(questions, "test_id").join(responses, ["attempt_id", "question_id"], "left").join(
        chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.col("text").alias("source_text")), "source_chunk_id", "left").fillna("", ["source_text"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = gr.grade_join(questions, attempts, responses, chunks)
        plan = got._jdf.queryExecution().executedPlan().toString()
        key = lambda df: sorted(str([x[c] for c in sorted(df.columns)]) for x in df.collect())
        assert key(got) == key(rows.select(*got.columns)) and got.columns == rows.columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re
    assert not re.search(r"hashpartitioning\(attempt_id#\d+, question_id#", plan)


def test_a_marker_is_asked_once_a_batch(spark):
    from passagework.plans.study import grade_attempts

    gr, questions, attempts, responses, chunks = _marking(spark)
    calls, told = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def marker(prompt):
        calls.add(1)
        told.add("id: 101\n  asked: p101\n  expected: true\n  from: text\n  given: r2.101\n" in prompt)
        if "r1.203" in prompt:
            return "no marks"
        return json.dumps([{"id": line[4:], "awarded": 0.8, "feedback": "ok"} for line in prompt.split("\n") if line.startswith("id: ")])

    graded, scores = grade_attempts(questions, attempts.filter("attempt_id < 3"), responses, chunks, marker, source_chars=4)
    rows = graded.collect()
    # Attempts 0 and 2 have 12 written questions and a source or an answer twice, attempt 1 has 12 at another test.
    assert calls.value == 6 and told.value == 1
    assert sorted((x.attempt_id, x.question_id) for x in rows if x.feedback and x.feedback.startswith(gr.FAILED)) == [(1, q) for q in range(201, 217, 2)]
    assert {(x.attempt_id, x.score, x.max_score) for x in scores.collect()} == {(0, 10.4, 25), (1, 3.2, 25), (2, 11.2, 26)}
