"""Pieces of SQL shared by the checks: the same frames, written for another engine."""

from __future__ import annotations

from passagework.functions.sparse import STOPWORDS

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TERM = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"


def terms(name: str, table: str, key: str, text: str = "text") -> str:
    return f"""{name} AS (
        SELECT {key}, t AS term FROM (
            SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TERM}')) AS t FROM {table})
        WHERE length(t) > 1 AND t NOT IN ({STOP}))"""


POSTINGS = terms("tok", "documents", "doc_id") + """,
    post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
            FROM post GROUP BY term)"""

SPARSE = POSTINGS + "," + terms("qtok", "benchmark", "item_id") + """,
    sparse_all AS (
        SELECT q.item_id AS query_id, p.doc_id AS chunk_id, round(sum(p.tf * 2.5 / (p.tf + 1.5) * d.idf), 9) AS score
        FROM (SELECT DISTINCT item_id, term FROM qtok) q JOIN post p USING (term) JOIN dfs d USING (term) GROUP BY ALL),
    sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse_all
               QUALIFY rank <= 50)"""


def hashed(name: str, table: str, key: str, width: int = 64) -> str:
    return f"""{name}_w AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {table}),
    {name}_h AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM {name}_w)),
    {name}_b AS (
        SELECT w, ('0x' || substr(h, 1, 8))::BIGINT % {width} AS b, 1 - 2 * (('0x' || substr(h, 9, 2))::BIGINT % 2) AS s FROM {name}_h
        UNION ALL
        SELECT w, ('0x' || substr(h, 17, 8))::BIGINT % {width}, 1 - 2 * (('0x' || substr(h, 25, 2))::BIGINT % 2) FROM {name}_h),
    {name}_raw AS (SELECT k, b, sum(s)::DOUBLE AS v FROM {name}_w JOIN {name}_b USING (w) GROUP BY ALL),
    {name}_size AS (SELECT {key} AS k, coalesce(sqrt(sum(v * v)), 0) AS n FROM {table} LEFT JOIN {name}_raw ON {key} = k GROUP BY 1),
    {name} AS (SELECT k, b, v / n AS v FROM {name}_raw JOIN {name}_size USING (k) WHERE n > 0
               UNION ALL SELECT k, 0, 1.0 FROM {name}_size WHERE n = 0)"""


DENSE = hashed("dvec", "documents", "doc_id") + "," + hashed("qvec", "benchmark", "item_id") + """,
    dense_all AS (
        SELECT q.item_id AS query_id, d.doc_id AS chunk_id, round(coalesce(s.score, 0), 9) AS score
        FROM benchmark q CROSS JOIN documents d LEFT JOIN (
            SELECT qvec.k AS qk, dvec.k AS dk, sum(qvec.v * dvec.v) AS score FROM qvec JOIN dvec USING (b) GROUP BY ALL) s
        ON s.qk = q.item_id AND s.dk = d.doc_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_all
              QUALIFY rank <= 50)"""

FUSED = SPARSE + "," + DENSE + """,
    fused_all AS (
        SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS score,
               max(CASE WHEN l = 'd' THEN score END) AS dense_score, max(CASE WHEN l = 'd' THEN rank END) AS dense_rank,
               max(CASE WHEN l = 's' THEN score END) AS sparse_score, max(CASE WHEN l = 's' THEN rank END) AS sparse_rank
        FROM (SELECT *, 'd' AS l FROM dense UNION ALL SELECT *, 's' FROM sparse) GROUP BY ALL),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused_all
              QUALIFY rank <= 25)"""

QRELS = """qrels AS (
        SELECT b.item_id AS query_id, d.doc_id AS chunk_id, 0.5 + 0.5 * coalesce(l.quality, 0) AS gain
        FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l USING (doc_id))"""

STRATEGIES = """ranked AS (
        SELECT query_id, chunk_id, rank, 'bm25' AS strategy FROM sparse WHERE rank <= 10
        UNION ALL SELECT query_id, chunk_id, rank, 'dense' FROM dense WHERE rank <= 10
        UNION ALL SELECT query_id, chunk_id, rank, 'hybrid' FROM fused WHERE rank <= 10),
    names AS (SELECT unnest(['bm25', 'dense', 'hybrid']) AS strategy)"""


def _at(k: int) -> str:
    return f"""
        SELECT query_id, strategy, 'recall@{k}' AS metric, count(chunk_id) FILTER (rank <= {k}) / max(rel) AS value FROM judged GROUP BY ALL
        UNION ALL SELECT query_id, strategy, 'precision@{k}', count(chunk_id) FILTER (rank <= {k}) / {k}.0 FROM judged GROUP BY ALL
        UNION ALL SELECT query_id, strategy, 'hit@{k}', CASE WHEN count(chunk_id) FILTER (rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END FROM judged GROUP BY ALL
        UNION ALL SELECT query_id, strategy, 'ndcg@{k}', coalesce(sum(gain / log2(rank + 1)) FILTER (rank <= {k}), 0) / max(ideal)
            FROM judged JOIN (SELECT query_id, sum(gain / log2(p + 1)) AS ideal FROM best WHERE p <= {k} GROUP BY 1) USING (query_id) GROUP BY ALL"""


METRICS = FUSED + "," + QRELS + "," + STRATEGIES + """,
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, chunk_id) AS p FROM qrels),
    gold AS (SELECT query_id, count(*) AS rel FROM qrels GROUP BY 1),
    judged AS (
        SELECT g.query_id, n.strategy, g.rel, h.chunk_id, h.rank, h.gain FROM gold g CROSS JOIN names n
        LEFT JOIN (SELECT r.*, q.gain FROM ranked r JOIN qrels q USING (query_id, chunk_id)) h
        ON h.query_id = g.query_id AND h.strategy = n.strategy),
    metrics AS (
        SELECT query_id, strategy, 'mrr' AS metric, coalesce(1.0 / min(rank), 0) AS value FROM judged GROUP BY ALL
        UNION ALL """ + " UNION ALL ".join(_at(k) for k in (1, 3, 5, 10)) + ")"


GRAMS = """tw AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
    tg AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM tw WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    grams AS (SELECT DISTINCT doc_id, g FROM tg WHERE g IS NOT NULL UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM tw GROUP BY doc_id HAVING count(*) < 5)"""
