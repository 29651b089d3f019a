"""Checked queries: conversations, samples, contexts, citations, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework import hooks
from passagework.catalog import sql
from passagework.catalog.chunks import WINDOWS, line_blocks
from passagework.catalog.frames import document_index, embedded_passages, passages, stored_postings, table, whole_documents
from passagework.functions import citations as c
from passagework.functions import text as t
from passagework.operators import chunking as ch
from passagework.operators import context as cx
from passagework.operators import conversation as cv
from passagework.operators import rerank as rr
from passagework.operators import retrieval as r
from passagework.operators import sampling as sm
from passagework.session import cut

QUERIES, ORACLES = {}, {}


def check(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# Citations spread through the turns, by their numbers, so that every form occurs.
CITED = """cited AS (SELECT conv_id, turn, role, CASE (conv_id + turn) % 4 WHEN 0 THEN '[S1] ' || text WHEN 1 THEN text || ' [S' || (turn + 1) || ', S3]'
    WHEN 2 THEN '[S2-S4] ' || text || ' [S5; S1]' ELSE text || ' [S3-S40][S9-S2]' END AS text FROM conversations)"""


def cited_turns(spark, sf):
    kind = (F.col("conv_id") + F.col("turn")) % 4
    return table(spark, sf, "conversations").withColumn(
        "text",
        F.when(kind == 0, F.concat(F.lit("[S1] "), "text"))
        .when(kind == 1, F.concat("text", F.lit(" [S"), F.col("turn") + 1, F.lit(", S3]")))
        .when(kind == 2, F.concat(F.lit("[S2-S4] "), "text", F.lit(" [S5; S1]")))
        .otherwise(F.concat("text", F.lit(" [S3-S40][S9-S2]"))))


@check("cited_markers", f"""WITH {CITED}, m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN [1] WHEN 1 THEN [turn + 1, 3] WHEN 2 THEN [2, 3, 4, 5, 1] ELSE [3, 40, 9, 2] END AS n FROM cited)
    SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_distinct(n)), lambda x: 'S' || x), ' ') AS markers FROM m""")
def cited_markers(spark, sf):
    return cited_turns(spark, sf).select("conv_id", "turn", F.array_join(c.cited_markers("text"), " ").alias("markers"))


@check("strip_markers", r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM conversations")
def strip_markers(spark, sf):
    return cited_turns(spark, sf).select("conv_id", "turn", c.strip_markers("text").alias("text"))


@check("verify_citations", f"""WITH {CITED}, u AS (SELECT conv_id * 100 + turn AS answer_id, unnest(list_distinct(CASE (conv_id + turn) % 4 WHEN 0 THEN [1] WHEN 1 THEN [turn + 1, 3] WHEN 2 THEN [2, 3, 4, 5, 1] ELSE [3, 40, 9, 2] END)) AS n FROM cited WHERE role = 'assistant')
    SELECT answer_id, 'S' || n AS marker, CASE WHEN n <= 3 THEN 'cited' ELSE 'dangling' END AS state FROM u""")
def verify_citations(spark, sf):
    answers = cited_turns(spark, sf).filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("answer_id"), F.col("text").alias("answer"))
    sources = answers.select("answer_id", F.explode(F.array(F.lit("S1"), F.lit("S2"), F.lit("S3"))).alias("marker"))
    good, bad = cx.verify_citations(answers, sources)
    return good.select("answer_id", "marker", F.lit("cited").alias("state")).unionByName(bad.withColumn("state", F.lit("dangling")))


@check("prepare_history", r"""WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role,
        CASE WHEN role = 'assistant' THEN regexp_replace(regexp_replace(text, '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') ELSE text END AS x FROM conversations
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20),
    s AS (SELECT conv_id, turn, role, regexp_replace(substr(x, 1, 1500), '^\s+|\s+$', '', 'g') AS content FROM p),
    b AS (SELECT *, sum(greatest(1, round_even(length(content) / 4.0, 0))) OVER w AS spent, count(*) OVER w AS nth FROM s WHERE content <> ''
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT * FROM b WHERE spent <= 1500 AND nth <= 8)
    SELECT conv_id, turn, role, content FROM k WHERE turn >= (SELECT min(turn) FROM k q WHERE q.conv_id = k.conv_id AND q.role = 'user')""")
def prepare_history(spark, sf):
    return cv.prepare_history(table(spark, sf, "conversations"))


@check("needs_context", rf"""WITH f AS (SELECT conv_id, turn, lower(text) AS x, regexp_extract_all(lower(text), '[a-z0-9]+') AS w,
        coalesce(lag(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) OVER o, []) || coalesce(lag(regexp_extract_all(lower(text), '[a-z0-9]+'), 2) OVER o, []) AS spoken
        FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
    g AS (SELECT *, list_filter(w, lambda v: v NOT IN ({quoted(cv.FILLER)})) AS subject FROM f),
    h AS (SELECT *, list_filter(subject, lambda v: v NOT IN ({quoted(cv.ASPECT)}) AND NOT regexp_matches(v, '^[0-9]+$')) AS named FROM g)
    SELECT conv_id, turn, CASE WHEN len(list_filter(w, lambda v: v IN ({quoted(cv.REFERRING)}))) > 0 OR regexp_matches(x, '{cv.CONTINUATION}') THEN true
        WHEN len(named) = 0 THEN true WHEN len(subject) >= 5 THEN false
        ELSE list_has_any(list_transform(named, lambda v: CASE WHEN length(v) > 3 AND v LIKE '%s' THEN v[:-2] ELSE v END), list_transform(spoken, lambda v: CASE WHEN length(v) > 3 AND v LIKE '%s' THEN v[:-2] ELSE v END)) END AS leans FROM h""")
def needs_context(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").withColumn("last2", F.array_compact(F.array(F.lag("text", 1).over(w), F.lag("text", 2).over(w))))
    return rows.select("conv_id", "turn", cv.needs_context("text", "last2").alias("leans"))


# Every turn as a question: one of five openings before its whole text.
OPENINGS = ("Please summarise these notes", "What are the key points of my lecture?", "Which topics are likely to come up in the exam?", "Summarise", "What is the hardest idea here?")
ASKED = f"""asked AS (SELECT conv_id, turn, role, [{", ".join(f"'{x}'" for x in OPENINGS)}][(conv_id + 2 * turn) % 5 + 1] AS opening, text FROM conversations)"""


def asked(spark, sf):
    opening = F.get(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") + 2 * F.col("turn")) % 5).cast("int"))
    return table(spark, sf, "conversations").withColumn("opening", opening).withColumn("question", F.concat("opening", F.lit(" "), "text"))


@check("route_query", f"""WITH {ASKED}, q AS (SELECT conv_id, turn, 'opening' AS form, opening AS question FROM asked UNION ALL SELECT conv_id, turn, 'with text', opening || ' ' || text FROM asked),
    w AS (SELECT conv_id, turn, form, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM q)
    SELECT conv_id, turn, form, CASE WHEN regexp_matches(array_to_string(w, ' '), '{cv.OVERVIEW_INTENT}') AND len(list_filter(w, lambda v: v NOT IN ({quoted(cv.GENERIC)}))) = 0
        THEN 'whole' ELSE 'search' END AS route FROM w""")
def route_query(spark, sf):
    rows = asked(spark, sf)
    both = rows.withColumn("form", F.lit("with text")).unionByName(rows.withColumn("form", F.lit("opening")).withColumn("question", F.col("opening")))
    return cv.route_query(both).select("conv_id", "turn", "form", "route")


@check("is_refusal", r"""WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '"Not_supported." ' || text WHEN 1 THEN '  **NOT_SUPPORTED** ' || text ELSE text END AS x FROM conversations)
    SELECT conv_id, turn, starts_with(upper(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^["''*`]+', '')), 'NOT_SUPPORTED') AS refused FROM a""")
def is_refusal(spark, sf):
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('"Not_supported." '), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("  **NOT_SUPPORTED** "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", t.is_refusal(x).alias("refused"))


@check("accept_rewrite", r"""WITH a AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN '"' || regexp_replace(text, '\S', '', 'g') || '"' ELSE text || text END AS x FROM conversations),
    b AS (SELECT *, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g') AS y FROM a)
    SELECT conv_id, turn, CASE WHEN y = '' OR length(y) > 500 THEN text ELSE y END AS query, y = '' OR length(y) > 500 AS fell_back FROM b""")
def accept_rewrite(spark, sf):
    k = F.col("turn") % 3
    quoted_ = lambda t: F.concat(F.lit('"'), t, F.lit('"'))
    x = F.when(k == 0, quoted_(F.col("text"))).when(k == 1, quoted_(F.regexp_replace("text", r"\S", ""))).otherwise(F.concat("text", "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", t.accept_rewrite("text", x).alias("r")).select("conv_id", "turn", "r.query", "r.fell_back")


def _windows(spark, sf):
    return cut(ch.fixed_window_chunks(line_blocks(spark, sf), 128, 16).select("document_id", "chunk_index", "chunk_id", "user_id"))


SPREAD = WINDOWS + """,
    n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n FROM windows)"""


@check("even_spread", f"""WITH {SPREAD}, places AS (SELECT doc_id, CASE WHEN n <= 4 THEN g.s ELSE floor(g.s * (n / 4.0::DOUBLE))::BIGINT END AS i FROM (SELECT DISTINCT doc_id, n FROM n) x, range(4) g(s) WHERE g.s < n)
    SELECT doc_id AS document_id, i AS chunk_index FROM places""")
def even_spread(spark, sf):
    return sm.even_spread(_windows(spark, sf), 4).select("document_id", "chunk_index")


@check("stratified_spread", f"""WITH {SPREAD}, c AS (SELECT n.*, CASE WHEN n <= 4 THEN n.i ELSE (SELECT max(s) FROM range(4) g(s) WHERE floor(s * (n.n / 4.0::DOUBLE))::BIGINT <= n.i) END AS s FROM n)
    SELECT doc_id AS document_id, i AS chunk_index FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY md5('7:' || doc_id || '/' || i), i) = 1""")
def stratified_spread(spark, sf):
    rows = _windows(spark, sf).withColumn("key", F.concat("document_id", F.lit("/"), "chunk_index"))
    return sm.stratified_spread(rows, 4, 7, id_="key").select("document_id", "chunk_index")


@check("pick_fresh", f"""WITH {SPREAD}, u AS (SELECT *, i < 3 AS used FROM n),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, used ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY doc_id, used) AS m, count(*) FILTER (NOT used) OVER (PARTITION BY doc_id) AS fresh FROM u),
    q AS (SELECT *, CASE WHEN used THEN greatest(4 - fresh, 0) ELSE 4 END AS want FROM p)
    SELECT doc_id AS document_id, i AS chunk_index FROM q WHERE want > 0 AND (want >= m OR EXISTS (SELECT 1 FROM range(4) g(s) WHERE s < want AND floor(s * (m / want::DOUBLE))::BIGINT = j))""")
def pick_fresh(spark, sf):
    pool = _windows(spark, sf).withColumn("chunk_id", F.concat("document_id", F.lit("/"), "chunk_index"))
    return sm.pick_fresh(pool, 4, pool.filter("chunk_index < 3")).select("document_id", "chunk_index")


@check("spread_by_document", f"""WITH RECURSIVE {WINDOWS},
    d AS (SELECT source, doc_id, count(*) AS n FROM (SELECT doc_id FROM windows) JOIN documents USING (doc_id) GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n, doc_id) AS k, count(*) OVER (PARTITION BY source) AS m FROM d),
    f AS (SELECT DISTINCT source, -1::BIGINT AS doc_id, 0::BIGINT AS n, 0::BIGINT AS k, 0::BIGINT AS share, 40::BIGINT AS owed FROM d
          UNION ALL SELECT o.source, o.doc_id, o.n, o.k, greatest(1, owed // (m - o.k + 1)), owed - least(o.n, greatest(1, owed // (m - o.k + 1))) FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1 WHERE owed > 0),
    places AS (SELECT source, doc_id, CASE WHEN n <= share THEN g.s ELSE floor(g.s * (n / share::DOUBLE))::BIGINT END AS i FROM f, range(40) g(s) WHERE k > 0 AND g.s < least(n, share))
    SELECT source AS user_id, doc_id AS document_id, i AS chunk_index FROM places""")
def spread_by_document(spark, sf):
    return sm.spread_by_document(_windows(spark, sf), 40).select("user_id", "document_id", "chunk_index")


def _ranked_passages(spark, sf, k=10):
    docs = whole_documents(spark, sf)
    found = r.sparse_search(passages(spark, sf), stored_postings(spark, sf), docs, k, stem=False)
    # Spread before writing: a batch read from a file holds thousands of whole texts.
    return cut(found.join(docs.select("chunk_id", "document_id", "text"), "chunk_id").repartition("query_id", "rank"))


def _overlapping(depth: int, least: str) -> str:
    return f"""WITH {sql.SPARSE.replace("rank <= 50", "rank <= 200")},
    {sql.GRAMS}, sh AS (SELECT s.query_id, s.rank, g FROM sparse s JOIN grams ON doc_id = chunk_id WHERE s.rank <= {depth}),
    z AS (SELECT query_id, rank, count(*) AS n FROM sh GROUP BY ALL),
    o AS (SELECT a.query_id, a.rank, b.rank AS later, count(*) AS shared FROM sh a JOIN sh b ON a.query_id = b.query_id AND a.g = b.g AND a.rank < b.rank GROUP BY ALL)
    SELECT o.query_id, o.rank, later, round(shared / least(x.n, y.n), 6) AS overlap FROM o JOIN z x ON x.query_id = o.query_id AND x.rank = o.rank JOIN z y ON y.query_id = o.query_id AND y.rank = later
    WHERE shared / least(x.n, y.n) >= {least}"""


@check("near_duplicates", _overlapping(10, "0.85"))
def near_duplicates(spark, sf):
    return cx.near_duplicates(_ranked_passages(spark, sf)).withColumn("overlap", F.round("overlap", 6))


@check("near_duplicates_deep", _overlapping(200, "0.5"))
def near_duplicates_deep(spark, sf):
    """Rankings of 200 passages, and a looser overlap."""
    return cx.near_duplicates(_ranked_passages(spark, sf, 200), 0.5).withColumn("overlap", F.round("overlap", 6))


def _citable(spark, sf, k=10):
    named = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_name"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("int").alias("page_end"),
        (F.col("doc_id") % 50).cast("int").alias("slide_number"), F.array("lang").alias("heading_path"), F.lit("text").alias("source"))
    return _ranked_passages(spark, sf, k).join(named, "chunk_id")


# Passages in rank order, each with its duplicates before it, then the fold over ranks.
ADMITTED = f"""{sql.SPARSE}, {sql.GRAMS}, sh AS (SELECT s.query_id, s.rank, g FROM sparse s JOIN grams ON doc_id = chunk_id WHERE s.rank <= 10),
    z AS (SELECT query_id, rank, count(*) AS n FROM sh GROUP BY ALL),
    dup AS (SELECT a.query_id, b.rank, list(a.rank) AS same FROM (SELECT a.query_id, a.rank, b.rank AS later, count(*) AS shared FROM sh a JOIN sh b ON a.query_id = b.query_id AND a.g = b.g AND a.rank < b.rank GROUP BY ALL) o
            JOIN z a ON a.query_id = o.query_id AND a.rank = o.rank JOIN z b ON b.query_id = o.query_id AND b.rank = o.later WHERE shared::DOUBLE / least(a.n, b.n) >= 0.85 GROUP BY ALL),
    p AS (SELECT s.query_id, s.rank, s.chunk_id, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS body, d.source || ' · slide ' || d.doc_id % 50 || ' · ' || d.lang AS location, coalesce(same, []) AS same
          FROM sparse s JOIN documents d ON d.doc_id = s.chunk_id LEFT JOIN dup ON dup.query_id = s.query_id AND dup.rank = s.rank WHERE s.rank <= 10),
    fold AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, []::BIGINT[] AS taken, 0::BIGINT AS used, false AS fits FROM p
             UNION ALL SELECT query_id, rank, CASE WHEN fits THEN list_append(taken, rank) ELSE taken END, used + CASE WHEN fits THEN cost ELSE 0 END, fits FROM (
                 SELECT *, len(taken) < 8 AND body <> '' AND used + cost <= 5000 AND NOT list_has_any(taken, same) AS fits FROM (
                     SELECT p.query_id, p.rank, f.taken, f.used, p.body, p.same, greatest(1, round_even(length('[S' || (len(f.taken) + 1) || '] ' || p.location || chr(10) || p.body) / 4.0, 0))::BIGINT AS cost
                     FROM fold f JOIN p ON p.query_id = f.query_id AND p.rank = f.rank + 1))),
    marked AS (SELECT p.*, CASE WHEN fits THEN len(taken) END AS marker, '[S' || len(taken) || '] ' || location || chr(10) || body AS block FROM p JOIN fold USING (query_id, rank))"""


@check("build_context", f"""WITH RECURSIVE {ADMITTED} SELECT query_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY marker) FILTER (marker IS NOT NULL), '') AS context, count(marker) AS sources,
    coalesce(sum(greatest(1, round_even(length(block) / 4.0, 0))) FILTER (marker IS NOT NULL), 0)::BIGINT AS token_count, count(*) FILTER (marker IS NULL) AS dropped FROM marked GROUP BY 1""")
def build_context(spark, sf):
    return cx.build_context(cut(_citable(spark, sf)))[0]


@check("context_sources", f"""WITH RECURSIVE {ADMITTED}, c AS (SELECT *, regexp_replace(regexp_replace(body, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS x FROM marked WHERE marker IS NOT NULL)
    SELECT query_id, 'S' || marker AS marker, chunk_id, chunk_id AS document_id, source AS document_name, NULL AS page_number, NULL AS page_end, chunk_id % 50 AS slide_number,
           CASE WHEN length(x) <= 320 THEN x ELSE regexp_replace(left(x, 320), ' [^ ]*$', '') || '…' END AS snippet FROM c JOIN documents ON doc_id = chunk_id""")
def context_sources(spark, sf):
    return cx.build_context(cut(_citable(spark, sf)))[1].drop("heading_path")


@check("evidence", f"""WITH {sql.FUSED}, e AS (SELECT query_id, max(dense_score) AS similarity, max(CASE WHEN sparse_rank <= 3 THEN round(sparse_score / 100, 9) END) AS relevance FROM fused GROUP BY 1)
    SELECT query_id, round(similarity, 6) AS similarity, round(relevance, 6) AS relevance, coalesce(similarity < 0.55 AND relevance < 0.10, false) AS off_topic, coalesce(relevance >= 0.2, false) AS recheck FROM e""")
def evidence(spark, sf):
    index, queries = document_index(spark, sf), embedded_passages(spark, sf)
    lists = {"dense": r.dense_search(queries, index.dense, 50), "sparse": r.sparse_search(queries, index.postings, index.chunks, 50, stem=False)}
    ranked = r.rrf(lists, limit=25).withColumn("rerank_score", F.when(F.col("sparse_rank") <= 3, F.round(F.col("sparse_score") / 100, 9)))
    e = cx.evidence(ranked)
    no = F.lit(False)
    return e.select("query_id", F.round("similarity", 6).alias("similarity"), F.round("relevance", 6).alias("relevance"),
                    cx.off_topic(F.col("similarity"), F.col("relevance"), no).alias("off_topic"), cx.worth_recheck(F.col("relevance"), no).alias("recheck"))


@check("apply_scores", f"""WITH {sql.SPARSE}, c AS (SELECT *, (chunk_id * 37 + rank * 11) % 101 AS v, chunk_id IN (SELECT doc_id FROM labels) AS scored FROM sparse WHERE rank <= 25),
    s AS (SELECT *, bool_or(scored) OVER (PARTITION BY query_id) AS answered FROM c),
    k AS (SELECT query_id, chunk_id, rank AS before, CASE WHEN answered THEN v / 100.0 END AS rerank_score FROM s WHERE NOT answered OR scored)
    SELECT query_id, chunk_id, rerank_score::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, before) AS rank FROM k QUALIFY rank <= 8""")
def apply_scores(spark, sf):
    docs = whole_documents(spark, sf)
    cand = cut(r.sparse_search(passages(spark, sf), stored_postings(spark, sf), docs, 25, stem=False))
    # Labelled documents are scored; every query also gets a score for a position it does not have.
    labelled = cand.join(table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    scores = labelled.select("query_id", (F.col("rank") - 1).alias("position"), (((F.col("chunk_id") * 37 + F.col("rank") * 11) % 101) / 100).alias("relevance"))
    scores = scores.unionByName(passages(spark, sf).select("query_id", F.lit(99).alias("position"), F.lit(1.0).alias("relevance")))
    return rr.apply_scores(cand, scores, 8).select("query_id", "chunk_id", "rerank_score", "rank")


@check("apply_listwise", f"""WITH {sql.SPARSE}, c AS (SELECT * FROM sparse WHERE rank <= 10),
    p AS (SELECT *, CASE rank WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 7 THEN 3 END AS place FROM c),
    s AS (SELECT query_id, chunk_id, rank AS before, place, CASE WHEN query_id % 3 = 0 THEN NULL ELSE coalesce(1.0 / place, 0) END AS rerank_score FROM p)
    SELECT query_id, chunk_id, round(rerank_score, 6)::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 3 <> 0 THEN place END NULLS LAST, before) AS rank FROM s QUALIFY rank <= 8""")
def apply_listwise(spark, sf):
    cand = cut(r.sparse_search(passages(spark, sf), stored_postings(spark, sf), whole_documents(spark, sf), 10, stem=False))
    said = F.when(F.col("query_id") % 3 == 0, "I cannot rank these.").otherwise("Best first: [3, 1, 3, 99, 7, 0] - and [2]")
    orders = passages(spark, sf).select("query_id", said.alias("response"))
    return rr.apply_listwise(cand, orders, 8).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


@check("rerank_with_scorer", f"""WITH {sql.SPARSE}, c AS (SELECT query_id, chunk_id, rank AS was FROM sparse WHERE rank <= 25),
    s AS (SELECT query_id, chunk_id, was, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(left(d.text, 4000)), '[a-z0-9]+')) AS p
          FROM c JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = chunk_id)
    SELECT query_id, chunk_id, round(len(list_intersect(q, p)) / greatest(len(q), 1), 6) AS rerank_score,
           row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(q, p)) DESC, was) AS rank FROM s QUALIFY rank <= 8""")
def rerank_with_scorer(spark, sf):
    docs = whole_documents(spark, sf)
    cand = cut(r.sparse_search(passages(spark, sf), stored_postings(spark, sf), docs, 25, stem=False))
    return rr.rerank(passages(spark, sf), cand, docs, hooks.overlap_scorer, 8).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "rank")
