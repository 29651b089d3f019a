import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework import hooks
from passagework.operators import evaluation as ev
from passagework.operators import retrieval as r
from passagework.operators import significance as sg
from passagework.plans.evaluate import evaluate, ranked_by_strategy
from passagework.plans.retrieve import Index, retrieve
from passagework.functions import sparse
from passagework.functions.vectors import hashed_embedding


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 7, f"d{i % 5}", f"u{i % 2}", [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(300 + i, 1, "d1", "u1", rows[11][4]) for i in range(90)]  # a third of u1 is one vector
    return spark.createDataFrame(rows, "chunk_id long, chunk_index int, document_id string, user_id string, vector array<double>")


@pytest.fixture(scope="module")
def questions(spark, vectors):
    return vectors.filter("chunk_id < 20").select(
        F.col("chunk_id").alias("query_id"), "user_id", "vector",
        F.when(F.col("chunk_id") % 3 == 0, F.array(F.lit("d1"), F.lit("d3"))).when(F.col("chunk_id") == 7, F.array().cast("array<string>")).alias("document_ids"))


def brute(vectors, questions, k):
    out = set()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    corpus = vectors.collect()
    for q in questions.collect():
        rows = [c for c in corpus if c.user_id == q.user_id and (q.document_ids is None or c.document_id in q.document_ids)]
        rows.sort(key=lambda c: (-round(float(unit(c.vector) @ unit(q.vector)), 9), c.chunk_index, c.chunk_id))
        out |= {(q.query_id, c.chunk_id, i) for i, c in enumerate(rows[:k], 1)}
    return out


def test_dense_search_both_ways(vectors, questions):
    want = brute(vectors, questions, 5)
    for options in ({}, {"query_bytes": 2_000}):
        got = r.dense_search(questions, vectors, 5, **options)
        assert {(x.query_id, x.chunk_id, x.rank) for x in got.collect()} == want


def test_mixed_widths_are_refused(spark, questions):
    bad = spark.createDataFrame([(1, 0, "d1", "u0", [1.0, 2.0])], "chunk_id long, chunk_index int, document_id string, user_id string, vector array<double>")
    with pytest.raises(Exception, match="width"):
        r.dense_search(questions, bad, 5).collect()


def ranked(spark, name, ids, score=1.0):
    return spark.createDataFrame([(1, c, 0, score - i / 100, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, chunk_index int, score double, rank int")


def test_rrf(spark):
    fused = r.rrf({"dense": ranked(spark, "d", "abc"), "sparse": ranked(spark, "s", "cad")}).orderBy("rank").collect()
    assert [x.chunk_id for x in fused] == ["a", "c", "b", "d"]
    assert fused[0].rrf_score == pytest.approx(1 / 61 + 1 / 62)
    assert (fused[2].sparse_rank, fused[2].dense_rank) == (None, 2)
    same = r.rrf({"x": ranked(spark, "x", "cab"), "y": ranked(spark, "y", "cab")}).orderBy("rank").collect()
    assert [x.chunk_id for x in same] == ["c", "a", "b"]
    with pytest.raises(ValueError):
        r.rrf({}, k=0)


def test_empty_query_finds_nothing(spark):
    chunks = spark.createDataFrame([("a", 0, "d", "third normal form")], "chunk_id string, chunk_index int, document_id string, text string")
    q = spark.createDataFrame([(1, "the of and"), (2, "normal")], "query_id int, text string")
    got = r.sparse_search(q, r.postings(chunks), chunks).collect()
    assert [(x.query_id, x.chunk_id) for x in got] == [(2, "a")]


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([(1, "s", c, i) for i, c in enumerate("xaybz", 1)], "query_id int, strategy string, chunk_id string, rank int")
    qrels = spark.createDataFrame([(1, "a"), (1, "b"), (1, "q"), (2, "a")], "query_id int, chunk_id string")
    m = {(x.query_id, x.metric): x.value for x in ev.query_metrics(run, qrels, ev.runs_of(qrels, ["s"])).collect()}
    assert m[1, "mrr"] == 0.5 and m[1, "recall@3"] == pytest.approx(1 / 3) and m[1, "precision@10"] == pytest.approx(0.2)
    ideal = 1 + 1 / math.log2(3) + 1 / 2
    assert m[1, "ndcg@5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal)
    assert m[2, "mrr"] == m[2, "recall@10"] == m[2, "hit@10"] == 0.0
    assert m[1, "recall@1"] <= m[1, "recall@3"] <= m[1, "recall@5"] <= m[1, "recall@10"]


def metric_rows(spark, values):
    return spark.createDataFrame([(i, s, "mrr", float(v)) for s, vs in values.items() for i, v in enumerate(vs)], "query_id int, strategy string, metric string, value double")


def test_significance(spark):
    rng = random.Random(1)
    base = [rng.random() for _ in range(30)]
    m = metric_rows(spark, {"base": base, "same": base, "up": [b + 0.2 + rng.random() / 10 for b in base], "noise": [b + rng.uniform(-0.3, 0.3) for b in base], "short": base[:9]})
    c = {x.strategy: x for x in sg.compare_strategies(m, "base", resamples=2000).collect()}
    assert set(c) == {"same", "up", "noise"}
    assert (c["same"].p_bootstrap, c["same"].p_sign, c["same"].ties) == (1.0, 1.0, 30)
    assert c["up"].p_bootstrap < 0.01 and c["up"].significant and c["up"].p_sign == pytest.approx(2 * 0.5**30, abs=1e-9)
    assert c["noise"].p_bootstrap > 0.05 and c["noise"].ci_low < 0 < c["noise"].ci_high
    assert sg.compare_strategies(m, "unknown").count() == 0


@pytest.mark.parametrize("wins,losses", [(0, 0), (5, 5), (10, 0), (9, 1), (3, 8), (600, 500), (1500, 1400)])
def test_sign_test(spark, wins, losses):
    n = wins + losses
    pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + n * math.log(0.5)) for k in range(n + 1)] if n else [1.0]
    want = min(1.0, sum(p for p in pmf if p <= pmf[wins if n else 0] + 1e-12))
    got = spark.range(1).select(sg.sign_test(F.lit(wins), F.lit(losses)).alias("p")).head().p
    assert got == pytest.approx(want, abs=1e-6)


SECTIONS = {
    "Normal Forms": "A relation in third normal form has no transitive dependency of a nonkey attribute.",
    "Indexes": "A b-tree index keeps keys sorted so that range queries read few pages.",
    "Transactions": "A transaction is atomic, consistent, isolated and durable.",
    "Recovery": "A write-ahead log lets the engine redo committed work after a crash.",
    "Joins": "A hash join builds a table on the smaller input and probes it with the larger.",
}
QUESTIONS = {
    "what is a transitive dependency": "Normal Forms", "how does an index help range queries": "Indexes", "which properties does a transaction have": "Transactions",
    "what does the write-ahead log do after a crash": "Recovery", "how does a hash join probe": "Joins",
}


def test_evaluate_small_corpus(spark):
    rows = [(h, i, "guide", "u", f"{h}. {text}") for i, (h, text) in enumerate(SECTIONS.items())]
    chunks = spark.createDataFrame(rows, "chunk_id string, chunk_index int, document_id string, user_id string, text string")
    index = Index(chunks, chunks.withColumn("vector", hashed_embedding(256)("text")).drop("text"), r.postings(chunks))
    q = spark.createDataFrame([(i, t, "u") for i, t in enumerate(QUESTIONS)], "query_id int, text string, user_id string").withColumn("vector", hashed_embedding(256)("text"))
    qrels = spark.createDataFrame([(i, h) for i, h in enumerate(QUESTIONS.values())], "query_id int, chunk_id string")
    done = evaluate(q, qrels, index, scorer=hooks.overlap_scorer)
    averages = {(x.strategy, x.metric): x.value for x in done.averages.collect()}
    assert all(averages[s, "recall@5"] == 1.0 for s in ("bm25", "dense", "hybrid", "hybrid_rerank"))
    assert averages["bm25", "mrr"] == 1.0
    other = retrieve(q.withColumn("user_id", F.lit("v")), index, "hybrid", 5)
    assert other.count() == 0  # nobody reads another owner's chunks
    with pytest.raises(ValueError, match="none of the gold"):
        evaluate(q, qrels.withColumn("chunk_id", F.lit("gone")), index)


@pytest.mark.parametrize("stem", [True, False])
def test_postings_are_the_terms_of_a_chunk(spark, stem):
    texts = ["Running runs run, the runner's 3.5 B-tree b-tree!", "", None, "of the and", "état naïve İstanbul x y zz", "a" * 20_000]
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "chunk_id int, text string")
    got = sorted((x.chunk_id, x.term, x.tf, x.term_idx) for x in r.postings(chunks, stem=stem).collect())
    rows = chunks.select("chunk_id", F.explode(sparse.terms("text", stem)).alias("term")).groupBy("chunk_id", "term").count().withColumn("i", sparse.term_index("term"))
    assert got == sorted(tuple(x) for x in rows.collect())


def test_a_failing_half_takes_only_its_own(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, "d", "u", f"word{i} common text") for i in range(6)], "chunk_id string, chunk_index int, document_id string, user_id string, text string")
    index = Index(chunks, chunks.withColumn("vector", hashed_embedding(32)("text")).drop("text"), r.postings(chunks))
    q = spark.createDataFrame([(1, "word3 common", "u")], "query_id int, text string, user_id string").withColumn("vector", hashed_embedding(64)("text"))
    failed = {}
    left = ranked_by_strategy(q, index, ["dense", "bm25", "hybrid"], 3, failed=failed).collect()
    assert {x.strategy for x in left} == {"bm25"} and [x.chunk_id for x in left if x["rank"] == 1] == ["c3"]
    assert set(failed) == {"dense", "hybrid"} and "width" in failed["dense"]
    with pytest.raises(Exception, match="width"):
        ranked_by_strategy(q, index, ["dense", "bm25"], 3)
    with pytest.raises(ValueError, match="every strategy failed"):
        ranked_by_strategy(q, index, ["dense"], 3, failed={})


@pytest.mark.parametrize(("rare", "k", "size"), [(0.2, 5, 32), (0.0, 3, 2), (0.6, 50, 8), (1.0, 5, 32)])
def test_bounded_search_is_the_whole_search(spark, monkeypatch, rare, k, size):
    """Texts of very different lengths, words of very different frequencies, ties, and questions in scopes of their own."""
    rng = random.Random(12)
    words = [f"w{n}" for n in range(120)]
    often = [1 / (n + 1) for n in range(120)]
    rows = [(i, i % 3, f"d{i % 9}", f"u{i % 2}", " ".join(rng.choices(words, often, k=rng.choice([1, 4, 30, 400])))) for i in range(300)]
    rows += [(300 + i, 0, "d1", "u1", rows[7][4]) for i in range(40)] + [(999, 0, "d2", "u0", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_index int, document_id string, user_id string, text string")
    asked = [(q, " ".join(rng.choices(words, k=rng.randint(1, 25)) + ["w0", "unheard"]), f"u{q % 2}", None if q % 3 else ["d1", "d5"]) for q in range(12)] + [(50, "", "u0", None), (51, "unheard", "u1", None)]
    queries = spark.createDataFrame(asked, "query_id int, text string, user_id string, document_ids array<string>")
    plain = r.with_blocks
    monkeypatch.setattr(r, "with_blocks", lambda rows, posted: plain(rows, posted, size))
    got = {(x.query_id, x.chunk_id, x["rank"], round(x.score, 6)) for x in r.sparse_search(queries, r.postings(chunks, stem=False), chunks, k, stem=False, rare=rare).collect()}
    counts = [(c, {w: c[4].split().count(w) for w in set(c[4].split())} if c[4] else {}) for c in rows]
    df = {w: sum(w in n for _, n in counts) for w in words}
    want = set()
    for q, text, user, ids in asked:
        found = []
        for c, n in counts:
            held = set(text.split()) & set(n)
            if held and c[3] == user and (ids is None or c[2] in ids):
                score = sum(n[w] * 2.5 / (n[w] + 1.5) * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) for w in held)
                found.append((-round(score, 9), c[1], c[0]))
        want |= {(q, i, place, round(-s, 6)) for place, (s, _, i) in enumerate(sorted(found)[:k], 1)}
    assert got == want


def test_postings_are_not_gathered_in_the_driver(spark):
    """However small they look as files, postings meet what also grows with the corpus in merge joins."""
    chunks = spark.createDataFrame([(i, 0, f"d{i}", f"common words number{i}") for i in range(50)], "chunk_id long, chunk_index int, document_id string, text string")
    q = spark.createDataFrame([(1, "common words number3")], "query_id int, text string")
    plan = r.sparse_search(q, r.postings(chunks), chunks, 2)._jdf.queryExecution().executedPlan().toString()
    merged = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert sum("chunk_id" in line for line in merged) == 1 and sum("block" in line for line in merged) == 1


def test_terms_of_one_index_are_apart(spark):
    """`ofntbleen` and `oftheshahe` have one 32-bit index."""
    chunks = spark.createDataFrame([("a", 0, "d", "ofntbleen rare"), ("b", 0, "d", "oftheshahe"), ("c", 0, "d", "oftheshahe")], "chunk_id string, chunk_index int, document_id string, text string")
    posted = r.postings(chunks, stem=False)
    assert len({x.term_idx for x in posted.filter("term like 'of%'").collect()}) == 1
    assert {(x.term, x.df) for x in r.document_frequency(posted, chunks).collect()} == {("ofntbleen", 1), ("oftheshahe", 2), ("rare", 1)}
    q = spark.createDataFrame([(1, "ofntbleen")], "query_id int, text string")
    assert [x.chunk_id for x in r.sparse_search(q, posted, chunks, stem=False).collect()] == ["a"]


def test_searches_among_vectors_ask_every_twentieth(spark, sf):
    from passagework.catalog import queries

    asked = queries()["dense_search"](spark, sf).select("query_id").distinct().collect()
    n = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert len(asked) == n > 0 and all(x.query_id % 20 == 0 for x in asked)


def test_owners_are_told_apart_by_number():
    import pyarrow as pa

    q, b = pa.table({"user_id": ["a", "c", None, "gone"]}), pa.table({"user_id": ["c", "a", None, "a"]})
    assert r._allowed(q, b).tolist() == [[False, True, False, True], [True, False, False, False], [False, False, True, False], [False] * 4]


def test_searches_among_vectors_ask_every_row(spark, sf):
    from passagework.catalog import queries

    for name, rows, k in (("dense_search", "embeddings", "vec_id"), ("dense_search_scoped", "documents", "doc_id")):
        asked = {x.query_id for x in queries()[name](spark, sf).select("query_id").distinct().collect()}
        assert asked == {x[0] for x in spark.read.parquet(f"{sf}/{rows}.parquet").select(k).collect()}
    asked = queries()["vector_label_metrics"](spark, sf).collect()[0]["queries"]
    assert asked > spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").count()


def test_only_pairs_of_one_owner_are_scored():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    owners = ["a", None, "b", "c"]
    q = pa.table({"query_id": list(range(40)), "user_id": [owners[i % 3] for i in range(40)], "vector": rng.normal(size=(40, 8)).tolist()})
    b = pa.table({"chunk_id": list(range(60)), "chunk_index": [0] * 60, "user_id": [owners[i % 4] for i in range(60)], "vector": rng.normal(size=(60, 8)).tolist()})
    best = r._Best(q, 3)
    met = np.zeros((40, 60), bool)
    for mine, held in best._shares(b):
        met[np.ix_(mine, held)] = True
    assert (met == r._allowed(q, b)).all() and met.sum() == 40 * 15
    best.add(b)
    best.add(b.filter(pa.array([i % 4 == 3 for i in range(60)])))
    unit = lambda rows: np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    scores = np.where(met, np.round(unit(q["vector"].to_pylist()) @ unit(b["vector"].to_pylist()).T, 9), -9.0)
    want = {(i, int(c)) for i in range(40) for c in np.argsort(-scores[i])[:3]}
    assert {(x["query_id"], x["chunk_id"]) for part in best.rows() for x in part.to_pylist()} == want


def test_a_reranked_search_reads_its_vectors_once(spark):
    chunks = spark.createDataFrame([(f"c{i}", i, "d", "u", f"word{i} common text") for i in range(40)], "chunk_id string, chunk_index int, document_id string, user_id string, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    made = chunks.withColumn("vector", hashed_embedding(32)("text")).drop("text")
    index = Index(chunks, made.mapInArrow(counted, made.schema), r.postings(chunks))
    q = spark.createDataFrame([(1, "word3 common", "u")], "query_id int, text string, user_id string").withColumn("vector", hashed_embedding(32)("text"))
    found = retrieve(q, index, "hybrid_rerank", 3, scorer=hooks.overlap_scorer).collect()
    assert [x.chunk_id for x in found if x["rank"] == 1] == ["c3"] and len(found) == 3
    assert read.value == 40


@pytest.mark.parametrize("k", [2, 30])
def test_blocks_of_a_scoped_search_hold_one_owner(spark, monkeypatch, k):
    rng = random.Random(5)
    words = [f"w{n}" for n in range(60)]
    rows = [(i, 0, f"d{i}", None if i % 50 == 9 else f"u{i % 5}", " ".join(rng.choices(words, [1 / (n + 1) for n in range(60)], k=rng.choice([3, 40, 44])))) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id long, chunk_index int, document_id string, user_id string, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12)) + " w0 w1", f"u{i % 6}") for i in range(30)], "query_id int, text string, user_id string")
    posted = r.postings(chunks, stem=False)
    plain, seen = r.block_maxima, []
    monkeypatch.setattr(r, "block_maxima", lambda *a: seen.append(a[0]) or plain(*a))
    got = {(x.query_id, x.chunk_id, x["rank"], x.score) for x in r.sparse_search(q, posted, chunks, k, stem=False).collect()}
    owners = seen[0].groupBy("block").agg(F.count_distinct("user_id").alias("owners"), F.count_distinct("chunk_id").alias("chunks")).collect()
    assert max(x.owners for x in owners) == 1 and max(x.chunks for x in owners) > 8
    # The whole corpus counts for idf; a search with every term rare scores everything.
    assert got == {(x.query_id, x.chunk_id, x["rank"], x.score) for x in r.sparse_search(q, posted, chunks, k, stem=False, rare=1.0).collect()}
    assert {g[0] for g in got} == {i for i in range(30) if i % 6 != 5}


def test_contexts_and_sources_compare_passages_once(spark, monkeypatch):
    from passagework.operators import context as cx

    calls = spark.sparkContext.accumulator(0)
    plain = cx._admit

    def counted(*limits):
        run = plain(*limits)

        def each(frames):
            for pdf in frames:
                calls.add(len(pdf))
                yield from run(iter([pdf]))
        return each

    monkeypatch.setattr(cx, "_admit", counted)
    row = "query_id int, rank int, chunk_id string, document_id string, text string, document_name string, page_number int, page_end int, slide_number int, heading_path array<string>, source string"
    ranked_ = spark.createDataFrame([(1, i + 1, f"c{i}", "d", t, "d.pdf", None, None, None, [], "text") for i, t in enumerate(
        ["one two three", "one two three", "one two three four five six", "x " * 30_000, "one two"])], row)
    contexts, sources = cx.build_context(ranked_)
    assert contexts.collect()[0].sources == 3 and {x.chunk_id for x in sources.collect()} == {"c0", "c2", "c4"}
    assert calls.value == 5
