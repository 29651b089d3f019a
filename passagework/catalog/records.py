"""Checked queries: traces, tables of the app, the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.chunks import uuid5_sql
from passagework.catalog.frames import table
from passagework.functions import text as t
from passagework.functions.vectors import hashed_embedding
from passagework.operators import lifecycle as lc
from passagework.operators import traces as tr
from passagework.sources import chunks as sc
from passagework.sources import gold as sg
from passagework.sources import traces as st
from passagework.sources import uploads as su
from passagework.session import work_dir

QUERIES, ORACLES = {}, {}
NOW = "2024-02-01 00:00:00"


def check(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def micros(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_traces(spark, sf):
    return as_traces(table(spark, sf, "events"))


def as_traces(e):
    """Events read as spans: the type is the kind, the day of a user one operation."""
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("trace_id"), F.col("event_type").alias("kind"), F.when(k % 5 == 0, "request").otherwise(F.concat(F.lit("stage-"), k % 5)).alias("name"),
        F.when(k != 7, F.bround(F.col("value") * 10).cast("int")).alias("duration_ms"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed with "), k)).alias("error"),
        F.concat(F.lit("u"), "user_id", F.lit("-"), F.dayofmonth("ts")).alias("correlation_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("created_at"))


TRACES = r"""k AS (SELECT *, regexp_extract(props, '\d+')::INT AS k FROM events),
    traces AS (SELECT event_id AS trace_id, event_type AS kind, CASE WHEN k % 5 = 0 THEN 'request' ELSE 'stage-' || (k % 5) END AS name,
        CASE WHEN k <> 7 THEN round_even(value * 10, 0)::INT END AS duration_ms, CASE WHEN event_type = 'error' THEN 'failed with ' || k END AS error,
        'u' || user_id || '-' || day(ts) AS correlation_id, user_id::VARCHAR AS user_id, ts AS created_at FROM k)"""


@check("stage_summary", f"""WITH {TRACES} SELECT kind, name, count(*) AS calls, count(error) AS errors, quantile_disc(duration_ms, 0.5) AS p50,
    quantile_disc(duration_ms, 0.95) AS p95, max(duration_ms) AS worst FROM traces WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 1000 HOURS GROUP BY ALL""")
def stage_summary(spark, sf):
    return tr.stage_summary(event_traces(spark, sf), 1000, at(NOW))


@check("trace_rollup", f"""WITH {TRACES} SELECT correlation_id, min_by(kind, (created_at, trace_id)) AS kind, count(*) AS spans,
    coalesce(first(duration_ms ORDER BY created_at, trace_id) FILTER (name = 'request'), greatest(0, max(duration_ms))) AS total_ms, bool_or(error IS NOT NULL) AS failed FROM traces GROUP BY 1""")
def trace_rollup(spark, sf):
    return tr.trace_rollup(event_traces(spark, sf))


@check("trace_spans", f"WITH {TRACES} SELECT correlation_id, trace_id, name, duration_ms, epoch_us(created_at) AS at_us FROM traces")
def trace_spans(spark, sf):
    return tr.trace_spans(event_traces(spark, sf)).select("correlation_id", "trace_id", "name", "duration_ms", micros("created_at").alias("at_us"))


@check("recent_failures", f"""WITH {TRACES} SELECT trace_id, kind, name, error, epoch_us(created_at) AS at_us FROM traces
    WHERE error IS NOT NULL AND created_at > TIMESTAMP '{NOW}' - INTERVAL 1000 HOURS ORDER BY created_at DESC, trace_id DESC LIMIT 50""")
def recent_failures(spark, sf):
    return tr.recent_failures(event_traces(spark, sf), 1000, at(NOW), 50).select("trace_id", "kind", "name", "error", micros("created_at").alias("at_us"))


@check("clean_traces", f"""WITH {TRACES} SELECT trace_id, substr(repeat(kind, 12), 1, 64) AS kind, substr(repeat(name, 20), 1, 128) AS name,
    {uuid5_sql(t.CORRELATION_NAMESPACE, "traces.correlation_id")} AS correlation_id, NULL::VARCHAR AS user_id FROM traces""")
def clean_traces(spark, sf):
    long = event_traces(spark, sf).withColumn("kind", F.repeat("kind", 12)).withColumn("name", F.repeat("name", 20))
    return st.clean_traces(long).select("trace_id", "kind", "name", "correlation_id", "user_id")


@check("keyset_page", """WITH p AS (SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)
    SELECT id, epoch_us(created_at) AS at_us, (SELECT CASE WHEN count(*) = 50 THEN epoch_us(min(created_at)) END FROM p) AS next_us FROM p""")
def keyset_page(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return lc.keyset_page(o, 50, at("2000-01-01 00:00:00")).select("id", micros("created_at").alias("at_us"), micros("next_before").alias("next_us"))


@check("latest_per_owner", """SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 5""")
def latest_per_owner(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return lc.latest_per_owner(o, "owner", 5).select("owner", "id", "place")


@check("latest_sessions", "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_sessions(spark, sf):
    return lc.latest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).select("id")


@check("questions_in_order", "SELECT l_orderkey AS test_id, l_linenumber AS position, l_partkey AS prompt FROM lineitem")
def questions_in_order(spark, sf):
    q = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("test_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("prompt"),
                                            F.col("l_returnflag").alias("correct_answer"), F.col("l_suppkey").alias("source_chunk_id"))
    return lc.for_taking(q)


@check("messages_with_sources", r"""WITH m AS (SELECT conv_id, turn, role, conv_id * 100 + turn AS message_id FROM conversations),
    s AS (SELECT message_id, r AS source_rank, (conv_id * 7 + turn * 3 + r * 11) % (SELECT count(*) FROM documents) AS chunk_id FROM m, range(1, 4) g(r) WHERE role = 'assistant' AND r <= 1 + turn % 3),
    c AS (SELECT s.message_id, s.source_rank, s.chunk_id, regexp_replace(regexp_replace(d.text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS x, d.source FROM s JOIN documents d ON d.doc_id = s.chunk_id)
    SELECT m.message_id, m.role, source_rank, chunk_id, source AS document_name, CASE WHEN length(x) <= 320 THEN x ELSE regexp_replace(substr(x, 1, 320), ' [^ ]*$', '') || '…' END AS snippet
    FROM m LEFT JOIN c USING (message_id)""")
def messages_with_sources(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.agg(F.count("*")).scalar()
    m = table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("session_id"), F.col("turn").alias("created_at"))
    s = m.filter("role = 'assistant'").select("message_id", "conv_id", "turn", F.explode(F.sequence(F.lit(1), (1 + F.col("turn") % 3).cast("int"))).alias("source_rank"))
    s = s.select("message_id", "source_rank", ((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("source_rank") * 11) % n).alias("chunk_id"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    named = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("document_name"))
    return lc.messages_with_sources(m, s, chunks, named).select("message_id", "role", "source_rank", "chunk_id", "document_name", "snippet")


SESSIONS = """sessions AS (SELECT c_custkey AS session_id, c_nationkey AS user_id, TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * (c_custkey % 2000) AS created_at, c_acctbal < 0 AS ended FROM customer),
    tokens AS (SELECT o_custkey AS session_id, o_orderdate + INTERVAL 30 DAYS AS expires_at, o_orderstatus = 'F' AS revoked FROM orders),
    over AS (SELECT session_id FROM sessions s WHERE ended OR (created_at < TIMESTAMP '2000-01-01' - INTERVAL 5 MINUTES AND NOT EXISTS (
        SELECT 1 FROM tokens k WHERE k.session_id = s.session_id AND NOT revoked AND expires_at > TIMESTAMP '2000-01-01')))"""
WHEN = "2000-01-01 00:00:00"


def _sessions(spark, sf):
    c = table(spark, sf, "customer")
    born = at("1998-01-01 00:00:00") + F.make_dt_interval((F.col("c_custkey") % 2000).cast("int"))
    sessions = c.select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("user_id"), born.alias("created_at"),
                        F.when(F.col("c_acctbal") < 0, born).alias("ended_at"))
    tokens = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
                                               F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    return sessions, tokens


@check("expired_sessions", f"WITH {SESSIONS} SELECT session_id FROM over")
def expired_sessions(spark, sf):
    return lc.expired_sessions(*_sessions(spark, sf), at(WHEN), None).select("session_id")


@check("purge_cascade", f"""WITH {SESSIONS}, lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM over))
    SELECT 'sessions' AS name, count(*) AS kept FROM sessions WHERE session_id NOT IN (FROM over)
    UNION ALL SELECT 'documents', count(*) FROM orders WHERE o_custkey NOT IN (FROM over)
    UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM lost)
    UNION ALL SELECT 'tokens', count(*) FROM orders WHERE o_custkey NOT IN (FROM over)
    UNION ALL SELECT 'chat_sessions', count(*) FROM orders WHERE o_custkey NOT IN (FROM over)
    UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM lost)
    UNION ALL SELECT 'message_sources', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM lost) AND l_partkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (FROM lost))
    UNION ALL SELECT 'tests', count(*) FROM customer WHERE c_custkey NOT IN (FROM over)
    UNION ALL SELECT 'questions', count(*) FROM orders WHERE o_custkey NOT IN (FROM over)
    UNION ALL SELECT 'questions with a source', count(*) FROM orders WHERE o_custkey NOT IN (FROM over) AND o_orderkey % 1000 NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (FROM lost))
    UNION ALL SELECT 'attempts', count(*) FROM orders WHERE o_custkey NOT IN (FROM over)
    UNION ALL SELECT 'answers', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM lost)
    UNION ALL SELECT 'card_sets', count(*) FROM customer WHERE c_custkey NOT IN (FROM over)
    UNION ALL SELECT 'cards', count(*) FROM orders WHERE o_custkey NOT IN (FROM over)
    UNION ALL SELECT 'traces', count(*) FROM events WHERE user_id % 25 NOT IN (SELECT user_id FROM sessions EXCEPT SELECT user_id FROM sessions WHERE session_id NOT IN (FROM over))
    UNION ALL SELECT 'users', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT user_id FROM sessions EXCEPT SELECT user_id FROM sessions WHERE session_id NOT IN (FROM over))""")
def purge_cascade(spark, sf):
    sessions, tokens = _sessions(spark, sf)
    items, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    tables = {
        "sessions": sessions, "users": table(spark, sf, "nation").select(F.col("n_nationkey").alias("user_id")),
        "documents": table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("session_id")),
        "chunks": items.select(F.col("l_orderkey").alias("document_id"), F.col("l_orderkey").alias("chunk_id")),
        "tokens": tokens, "chat_sessions": orders.select(F.col("o_orderkey").alias("chat_id"), F.col("o_custkey").alias("session_id")),
        "messages": items.select(F.col("l_orderkey").alias("chat_id"), F.col("l_orderkey").alias("message_id")),
        "message_sources": items.select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("chunk_id")),
        "tests": sessions.select(F.col("session_id").alias("test_id"), "session_id"), "card_sets": sessions.select(F.col("session_id").alias("set_id"), "session_id"),
        "questions": orders.select(F.col("o_custkey").alias("test_id"), (F.col("o_orderkey") % 1000).alias("source_chunk_id")),
        "attempts": orders.select(F.col("o_custkey").alias("test_id"), F.col("o_orderkey").alias("attempt_id")),
        "answers": items.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("question_id")),
        "cards": orders.select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("source_chunk_id")),
        "traces": table(spark, sf, "events").select((F.col("user_id") % 25).alias("user_id")),
    }
    kept = lc.purge_cascade(lc.expired_sessions(sessions, tokens, at(WHEN), None), tables)
    kept["questions with a source"] = kept["questions"].filter("source_chunk_id is not null")
    counts = [df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("name"), "kept") for name, df in kept.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@check("session_documents", f"WITH {SESSIONS} SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (FROM over)")
def session_documents(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderstatus") == "O", "ready").alias("status"))
    return lc.session_documents(d, lc.expired_sessions(*_sessions(spark, sf), at(WHEN), None)).select("document_id")


@check("used_chunks", """SELECT DISTINCT document_id, chunk_id FROM (
    SELECT o_custkey AS document_id, l_partkey AS chunk_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N'
    UNION ALL SELECT s_nationkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_suppkey <> 1)""")
def used_chunks(spark, sf):
    li = table(spark, sf, "lineitem")
    q = li.select(F.col("l_orderkey").alias("test_id"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("source_chunk_id"))
    tests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("test_id"), F.col("o_custkey").alias("document_id"))
    cards = li.select(F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("source_chunk_id"))
    sets = table(spark, sf, "supplier").filter("s_suppkey <> 1").select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").cast("bigint").alias("document_id"))
    return lc.used_chunks(q, tests, cards, sets)


@check("merge_json", r"""SELECT event_id, regexp_extract(props, '\d+')::INT AS k, event_type AS kind FROM events""")
def merge_json(spark, sf):
    e = table(spark, sf, "events")
    patch = F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit(1).alias("old")))
    merged = e.select("event_id", lc.merge_json(lc.merge_json(F.lit('{"kind": "x", "n": 2}'), patch), "props").alias("j"))
    return merged.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"), F.get_json_object("j", "$.kind").alias("kind"))


def _lines(spark, sf):
    """Distinct lines of a document as its chunks, keyed by content."""
    lines = table(spark, sf, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("document_id"), F.explode(F.split("text", "\n")).alias("text"))
    return lines.distinct().withColumn("chunk_id", F.sha2("text", 256))


LINES = "l AS (SELECT DISTINCT source AS user_id, doc_id AS document_id, unnest(string_split(text, chr(10))) AS text FROM documents)"


@check("scan_chunks", "SELECT doc_id AS document_id, source AS user_id, n_chars FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AND doc_id IN (SELECT doc_id FROM labels)")
def scan_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), "n_chars")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "document_id")
    owners = docs.join(labels.filter("toxic = 1").select("document_id"), "document_id", "left_semi").select("user_id").distinct()
    scopes = docs.join(labels.select("document_id"), "document_id", "left_semi").join(owners, "user_id", "left_semi").select("user_id", "document_id")
    path = work_dir(spark)
    sc.save_chunks(docs.withColumn("chunk_id", F.col("document_id")), path, 16)
    return sc.scope_saved(spark, path, scopes).drop("chunk_id")


@check("scan_one_owner", "SELECT doc_id AS document_id, source AS user_id, 0 AS chunk_index, length(text) AS chars FROM documents WHERE source = 'src3'")
def scan_one_owner(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.lit(0).alias("chunk_index"), F.length("text").alias("chars"))
    path = work_dir(spark)
    sc.save_chunks(docs.withColumn("chunk_id", F.col("document_id")), path, 16)
    return sc.scan_saved(spark, path, "src3").drop("chunk_id")


REVISED = LINES + """,
    new AS (SELECT user_id, document_id, text FROM l WHERE document_id IN (SELECT doc_id FROM labels) AND length(text) > 40
            UNION ALL SELECT DISTINCT user_id, document_id, 'revised edition' FROM l WHERE document_id IN (SELECT doc_id FROM labels))"""


def _revision(spark, sf):
    """Labelled documents arrive again: short lines gone, one line new."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("document_id"))
    mine = _lines(spark, sf).join(labels, "document_id", "left_semi")
    extra = mine.select("user_id", "document_id").distinct().withColumn("text", F.lit("revised edition")).withColumn("chunk_id", F.sha2("text", 256))
    return mine.filter(F.length("text") > 40).unionByName(extra)


@check("upsert_chunks", f"WITH {REVISED} SELECT document_id, sha256(text) AS chunk_id FROM l WHERE document_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT document_id, sha256(text) FROM new")
def upsert_chunks(spark, sf):
    return sc.upsert_chunks(_lines(spark, sf), _revision(spark, sf)).select("document_id", "chunk_id")


@check("upsert_summary", f"""WITH {REVISED}, o AS (SELECT * FROM l WHERE document_id IN (SELECT doc_id FROM labels))
    SELECT document_id, count(*) FILTER (o.text IS NULL) AS inserted, count(*) FILTER (o.text IS NOT NULL AND n.text IS NOT NULL) AS kept, count(*) FILTER (n.text IS NULL) AS removed
    FROM o FULL JOIN new n USING (document_id, text) GROUP BY 1""")
def upsert_summary(spark, sf):
    return sc.upsert_summary(_lines(spark, sf), _revision(spark, sf))


@check("delete_documents", f"""WITH {LINES} SELECT document_id, sha256(text) AS chunk_id FROM l
    WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) OR text IN (SELECT text FROM l WHERE document_id IN (SELECT doc_id FROM labels WHERE quality = 1))""")
def delete_documents(spark, sf):
    lines = _lines(spark, sf)
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "document_id")
    keys = lines.select("user_id", "document_id").distinct().join(labels.filter("toxic = 1").select("document_id"), "document_id", "left_semi")
    keep = lines.join(labels.filter("quality = 1").select("document_id"), "document_id", "left_semi").select("chunk_id").distinct()
    return sc.delete_documents(lines, keys, keep).select("document_id", "chunk_id")


@check("known_ids", "SELECT doc_id AS chunk_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def known_ids(spark, sf):
    asked = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    held = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("user_id"))
    return sc.known_ids(asked, held, "src3", uuids=False)


@check("alive_sources", "SELECT l_orderkey AS message_id, l_partkey AS chunk_id FROM lineitem WHERE l_partkey IN (SELECT doc_id FROM documents)")
def alive_sources(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_partkey").alias("chunk_id"))
    return lc.alive_sources(s, table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")))


@check("cached_embed", r"""WITH h AS (SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS h FROM documents),
    c AS (SELECT DISTINCT h FROM h JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT count(*) FILTER (h IN (FROM c)) AS hits, count(DISTINCT h) FILTER (h NOT IN (FROM c)) AS misses, count(*) AS embedded,
           count(DISTINCT h) FILTER (h NOT IN (FROM c)) AS appended, count(*) FILTER (h NOT IN (FROM c)) AS ones FROM h""")
def cached_embed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    good = docs.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    cache = good.select(F.lit("hashed-16").alias("model_key"), t.content_hash("text").alias("content_hash"), hashed_embedding(16)("text").alias("vector")).dropDuplicates(["content_hash"])

    def embed(texts):
        return [[1.0] + [0.0] * 14 + [float(len(x))] for x in texts]

    rows, fresh, counts = sc.cached_embed(docs, cache, embed, "hashed-16")
    done = rows.filter(F.size("vector") == 16).agg(F.count("*").alias("embedded"))
    # Fresh vectors end in the length of their text; held ones are unit vectors.
    ones = rows.filter(F.col("vector")[15] == F.length("text")).agg(F.count("*").alias("ones"))
    return counts.withColumn("embedded", done.scalar()).withColumn("appended", fresh.agg(F.count_distinct("content_hash", "vector")).scalar()).withColumn("ones", ones.scalar())


@check("gold_from_headings", """SELECT 'what is ' || n_name AS question, 'Brand#' || n_nationkey AS heading, p_partkey AS chunk_id FROM nation JOIN part ON p_brand = 'Brand#' || n_nationkey""")
def gold_from_headings(spark, sf):
    q = table(spark, sf, "nation").select(F.concat(F.lit("what is "), "n_name").alias("question"), F.concat(F.lit("Brand#"), "n_nationkey").alias("heading"))
    chunks = table(spark, sf, "part").select(F.col("p_brand").alias("heading"), F.col("p_partkey").alias("chunk_id"), F.col("p_type").alias("document_id"))
    return sg.gold_from_headings(q, chunks).select("question", "heading", "chunk_id")


@check("unmatched_headings", "SELECT 'Brand#' || n_nationkey AS heading FROM nation WHERE 'Brand#' || n_nationkey NOT IN (SELECT p_brand FROM part)")
def unmatched_headings(spark, sf):
    q = table(spark, sf, "nation").select(F.concat(F.lit("Brand#"), "n_nationkey").alias("heading"))
    return sg.unmatched_headings(q, table(spark, sf, "part").select(F.col("p_brand").alias("heading")))


@check("gold_from_responses", r"""SELECT d.doc_id AS chunk_id, regexp_replace(trim(string_split(c.x, chr(10))[1]), '^["'']|["'']$', '', 'g') AS question, d.source || ' › ' || d.lang AS note
    FROM (SELECT conv_id * 10 + turn AS doc_id, CASE WHEN role = 'system' THEN 'Skip: ' || text ELSE '"' || text END AS x FROM conversations) c JOIN documents d USING (doc_id) WHERE NOT contains(upper(substr(x, 1, 20)), 'SKIP')""")
def gold_from_responses(spark, sf):
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.array("source", "lang").alias("heading_path"))
    r = table(spark, sf, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("chunk_id"),
                                                 F.when(F.col("role") == "system", F.concat(F.lit("Skip: "), "text")).otherwise(F.concat(F.lit('"'), "text")).alias("response"))
    return sg.gold_from_responses(chunks, r).select(F.col("relevant_chunk_ids")[0].alias("chunk_id"), "question", "note")


@check("dedupe_uploads", """WITH held AS (SELECT source, sha256(text) AS h, bool_and(toxic = 1) AS failed, coalesce(min(doc_id) FILTER (toxic <> 1), min(doc_id)) AS existing_id FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT doc_id, existing_id, CASE WHEN existing_id IS NULL THEN 'insert' WHEN failed THEN 'replace' ELSE 'duplicate' END AS action FROM documents d LEFT JOIN held ON held.source = d.source AND h = sha256(text)""")
def dedupe_uploads(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("session_id"), F.sha2("text", 256).alias("content_hash"))
    held = docs.join(table(spark, sf, "labels"), "doc_id").select("session_id", "content_hash", F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "failed").otherwise("ready").alias("status"))
    return su.dedupe_uploads(docs, held).select("doc_id", "existing_id", "action")


@check("gold_round_trip", """SELECT substr(sha256(text), 1, 16) AS query_id, text AS question, item_id::VARCHAR AS relevant, CASE WHEN item_id % 3 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS gain,
    CASE WHEN item_id % 2 = 0 THEN 'even' ELSE '' END AS note FROM benchmark""")
def gold_round_trip(spark, sf):
    """Passages written as gold questions, read back and laid out as gains."""
    item = F.col("item_id").cast("string")
    path = work_dir(spark)
    sg.write_gold(table(spark, sf, "benchmark").select(
        F.col("text").alias("question"), F.array(item, item).alias("relevant_chunk_ids"), F.when(F.col("item_id") % 3 == 0, F.create_map(item, F.lit(0.5))).alias("graded"),
        F.array().cast("array<string>").alias("document_ids"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("").alias("note")), path)
    gold = sg.read_gold(spark, path)
    gains = sg.qrels_of(gold).withColumnRenamed("chunk_id", "relevant")
    return gains.join(gold.select("query_id", "question", "note"), "query_id").select("query_id", "question", "relevant", "gain", "note")


@check("gold_line_numbers", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents WHERE source = 'src3')
    SELECT doc_id, line, sha256(raw) AS raw FROM l""")
def gold_line_numbers(spark, sf):
    """Texts of one source as files of lines, one folder a document, numbered again."""
    path = work_dir(spark)
    table(spark, sf, "documents").filter("source = 'src3'").select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(path)
    lines = sg.numbered_lines(spark, f"{path}/*")
    return lines.select(F.regexp_extract("file", r"doc_id=(\d+)", 1).cast("bigint").alias("doc_id"), "line", F.sha2("raw", 256).alias("raw"))


@check("read_uploads", """WITH f AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '%PDF-' ELSE '' END || text || chr(10) AS content FROM benchmark)
    SELECT item_id, strlen(content) AS length, CASE WHEN item_id % 3 = 0 THEN 'pdf' END AS kind, sha256(content) AS content_hash FROM f""")
def read_uploads(spark, sf):
    """Passages written as files, a third of them marked as PDF, and taken in as uploads."""
    path = work_dir(spark)
    marked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("%PDF-"), "text")).otherwise(F.col("text"))
    table(spark, sf, "benchmark").select("item_id", marked.alias("value")).write.mode("overwrite").partitionBy("item_id").text(path)
    return su.read_uploads(spark, f"{path}/*/*.txt").select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint").alias("item_id"), "length", "kind", "content_hash")
