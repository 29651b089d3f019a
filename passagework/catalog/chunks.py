"""Checked queries: text, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog import sql
from passagework.catalog.frames import table
from passagework.functions import citations as c
from passagework.functions import text as t
from passagework.functions.stemming import stem_all
from passagework.functions.sparse import terms
from passagework.operators import chunking as ch
from passagework.session import cut

QUERIES, ORACLES = {}, {}


def check(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


def line_blocks(spark, sf, docs=None):
    """One block per line; lines shaped like headings are headings, their length sets the level."""
    docs = table(spark, sf, "documents") if docs is None else docs
    lines = docs.select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_name"),
        F.posexplode(F.split("text", "\n")).alias("order", "text"),
    )
    heading = t.looks_like_heading("text")
    return lines.withColumn("type", F.when(heading, "heading").otherwise("paragraph")).withColumn(
        "level", F.when(heading, 1 + F.length(t.strip("text")) % 3)
    ).withColumn("page", (1 + F.floor(F.col("order") / 5)).cast("int"))


HEADING = r"""(length(x) > 0 AND length(x) <= 120 AND NOT regexp_matches(x, '[.,;]$') AND len(string_split_regex(x, '\s+')) <= 14 AND (
        regexp_matches(x, '(?i)^(\d+(\.\d+)*|[IVXLC]+|chapter|unit|section|part)(?:[^\p{L}\p{N}_]|$)')
        OR coalesce(len(list_filter(list_filter(string_split_regex(x, '\s+'), lambda w: regexp_matches(w, '\p{L}')), lambda w: regexp_matches(w, '^\p{Lu}')))
           / nullif(len(list_filter(string_split_regex(x, '\s+'), lambda w: regexp_matches(w, '\p{L}'))), 0) >= 0.7, false)))"""

BLOCKS = rf"""lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
    trimmed AS (SELECT doc_id, source, ord, 1 + ord // 5 AS page, regexp_replace(line, '^\s+|\s+$', '', 'g') AS x FROM lines),
    blocks AS (SELECT *, {HEADING} AS is_heading, 1 + length(x) % 3 AS level FROM trimmed WHERE x <> '')"""


def uuid5_sql(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')
        || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"""


NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'),
    '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""


@check("normalize_and_hash", rf"""WITH n AS (SELECT doc_id, regexp_replace({NORMAL}, '^\s+|\s+$', '', 'g') AS x FROM documents)
    SELECT doc_id, length(x) AS chars, sha256(x) AS content_hash FROM n""")
def normalize_and_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.normalize("text").alias("x"), t.content_hash("text").alias("content_hash")).select(
        "doc_id", F.length("x").alias("chars"), "content_hash")


SENTENCES = r"""pieces AS (
        SELECT doc_id, ord, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (
            SELECT doc_id, ord, string_split(regexp_replace(line, '([.!?])["'')\]]*\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM lines WHERE regexp_matches(line, '\S'))),
    flagged AS (
        SELECT *, regexp_matches(piece, '(?i)(^|[^\p{L}\p{N}_])([\p{L}\p{N}_]|etc|vs|cf|al|fig|eq|ref|no|vol|ch|sec|approx|dept|univ|mr|mrs|ms|dr|prof|st|jr|sr|inc|ltd|co)\.\s*$') AS open
        FROM pieces WHERE trim(piece) <> ''),
    grouped AS (SELECT *, coalesce(sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, ord ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM flagged),
    sentences AS (SELECT doc_id, ord, g, trim(string_agg(piece, ' ' ORDER BY i)) AS sentence FROM grouped GROUP BY ALL)"""


@check("split_sentences", f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents), {SENTENCES}
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord, g) - 1)::BIGINT AS place, sentence FROM sentences""")
def split_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(t.split_sentences("text")).alias("place", "sentence")).withColumn("place", F.col("place").cast("bigint"))


@check("looks_like_heading", f"WITH {BLOCKS} SELECT doc_id, ord AS line, is_heading FROM blocks")
def looks_like_heading(spark, sf):
    return line_blocks(spark, sf).filter(t.strip("text") != "").select(
        F.col("document_id").alias("doc_id"), F.col("order").cast("bigint").alias("line"), (F.col("type") == "heading").alias("is_heading"))


@check("token_count", """SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, round_even(length(text) / 4.0, 0)::INT) END AS tokens,
    sha256(substr(text, 1, 400)) AS head_100 FROM documents""")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.token_count("text").alias("tokens"), F.sha2(t.truncate_tokens("text", 100), 256).alias("head_100"))


@check("chunk_ids", rf"""WITH n AS (SELECT doc_id, sha256(regexp_replace({NORMAL}, '^\s+|\s+$', '', 'g')) AS h FROM documents)
    SELECT doc_id, {uuid5_sql(t.CHUNK_NAMESPACE, "doc_id::VARCHAR || ':' || n.h")} AS chunk_id, {uuid5_sql(t.CORRELATION_NAMESPACE, "'doc ' || doc_id")} AS correlation_id FROM n""")
def chunk_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.chunk_id("doc_id", "text").alias("chunk_id"), t.as_uuid(F.concat(F.lit("doc "), F.col("doc_id"))).alias("correlation_id"))


OPEN = BLOCKS + """,
    heads AS (SELECT doc_id, ord, x, level, (SELECT min(l.ord) FROM blocks l WHERE l.doc_id = b.doc_id AND l.is_heading AND l.ord > b.ord AND l.level <= b.level) AS closed
              FROM blocks b WHERE is_heading),
    paths AS (SELECT b.doc_id, b.ord, string_agg(h.x, ' > ' ORDER BY h.ord) AS path, min_by(h.x, h.ord) AS section, max_by(h.x, h.ord) AS heading
              FROM blocks b JOIN heads h ON h.doc_id = b.doc_id AND h.ord <= b.ord AND (h.closed IS NULL OR b.ord < h.closed) GROUP BY ALL)"""


@check("heading_paths", f"""WITH {OPEN} SELECT doc_id, ord AS line, coalesce(path, '') AS path, section, heading FROM blocks LEFT JOIN paths USING (doc_id, ord)""")
def heading_paths(spark, sf):
    return ch.heading_paths(ch.complete(line_blocks(spark, sf))).select(
        F.col("document_id").alias("doc_id"), F.col("order").cast("bigint").alias("line"), F.array_join("heading_path", " > ").alias("path"), "section", "heading")


WINDOWS = BLOCKS + """,
    words AS (SELECT doc_id, flatten(list(string_split_regex(x, '\\s+') ORDER BY ord)) AS w, flatten(list(list_transform(string_split_regex(x, '\\s+'), lambda z: page) ORDER BY ord)) AS pages,
                     min_by(x, ord) FILTER (is_heading) AS section FROM blocks GROUP BY doc_id),
    rates AS (SELECT *, greatest(1, round_even(length(array_to_string(w[1:2000], ' ')) / 4.0, 0)) / len(w[1:2000]) AS rate FROM words),
    sizes AS (SELECT *, greatest(floor(128 / rate)::BIGINT, 1) AS win, greatest(greatest(floor(128 / rate)::BIGINT, 1) - floor(16 / rate)::BIGINT, 1) AS stride FROM rates),
    starts AS (SELECT *, unnest(range(CASE WHEN len(w) <= win THEN 1 ELSE ceil((len(w) - win) / stride)::BIGINT + 1 END)) AS i FROM sizes),
    windows AS (SELECT doc_id, i, section, array_to_string(w[i * stride + 1 : i * stride + win], ' ') AS text, pages[i * stride + 1] AS page_number,
                       list_max(pages[i * stride + 1 : i * stride + win]) AS last_page FROM starts)"""


@check("fixed_window_chunks", f"""WITH {WINDOWS} SELECT doc_id AS document_id, i AS chunk_index, sha256(text) AS content_hash, section, page_number, CASE WHEN last_page > page_number THEN last_page END AS page_end,
    greatest(1, round_even(length(text) / 4.0, 0)::INT) AS token_count, {uuid5_sql(t.CHUNK_NAMESPACE, "doc_id::VARCHAR || ':' || sha256(windows.text)")} AS chunk_id FROM windows""")
def fixed_window_chunks(spark, sf):
    return ch.fixed_window_chunks(line_blocks(spark, sf), 128, 16).select(
        "document_id", "chunk_index", "content_hash", "section", "page_number", "page_end", "token_count", "chunk_id")


@check("dedupe_chunks", f"""WITH {WINDOWS} SELECT doc_id AS document_id, min(i) AS chunk_index, sha256(text) AS content_hash FROM windows GROUP BY doc_id, sha256(text)""")
def dedupe_chunks(spark, sf):
    return ch.dedupe_chunks(ch.fixed_window_chunks(line_blocks(spark, sf), 128, 16)).select("document_id", "chunk_index", "content_hash")


@check("chunk_stats", f"""WITH {WINDOWS}, kept AS (SELECT doc_id, any_value(greatest(1, round_even(length(text) / 4.0, 0)::INT)) AS n, count(*) AS copies FROM windows GROUP BY doc_id, text)
    SELECT doc_id AS document_id, count(*) AS chunks, sum(copies - 1)::BIGINT AS duplicates_dropped, sum(n)::BIGINT AS tokens, list_sort(list(n))[count(*) // 2 + 1] AS median_tokens FROM kept GROUP BY 1""")
def chunk_stats(spark, sf):
    return ch.chunk_stats(ch.fixed_window_chunks(line_blocks(spark, sf), 128, 16))


@check("corpus_stats", f"""WITH {WINDOWS} SELECT source AS user_id, count(*) AS chunks FROM windows JOIN documents USING (doc_id) GROUP BY ROLLUP (source)""")
def corpus_stats(spark, sf):
    return ch.corpus_stats(ch.fixed_window_chunks(line_blocks(spark, sf), 128, 16))


# Every step by itself, one after another: where sentences stand, where groups begin, which chunk takes up the next.
STRUCTURAL = (OPEN.replace("lines AS", "raw AS").replace("FROM lines", "FROM raw")
    .replace("string_agg(h.x, ' > ' ORDER BY h.ord) AS path", "list(h.x ORDER BY h.ord) AS path") + f""",
    lines AS (SELECT doc_id, ord, x AS line FROM blocks WHERE NOT is_heading), {SENTENCES},
    offsets AS (SELECT doc_id, ord, page, x, coalesce(sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip,
                       coalesce(max(CASE WHEN is_heading THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord), -1) AS mark FROM blocks),
    placed AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id, ord ORDER BY g) AS k, sentence FROM sentences),
    found AS (
        SELECT doc_id, ord, 0::BIGINT AS k, 0::BIGINT AS begins, 0::BIGINT AS cursor_at FROM offsets
        UNION ALL
        SELECT p.doc_id, p.ord, p.k, f.cursor_at + greatest(instr(substr(o.x, f.cursor_at + 1), p.sentence) - 1, 0),
               f.cursor_at + greatest(instr(substr(o.x, f.cursor_at + 1), p.sentence) - 1, 0) + length(p.sentence)
        FROM found f JOIN placed p ON p.doc_id = f.doc_id AND p.ord = f.ord AND p.k = f.k + 1 JOIN offsets o ON o.doc_id = p.doc_id AND o.ord = p.ord),
    numbered AS (SELECT doc_id, ord, mark, page, sentence, skip + begins AS char_start, skip + begins + length(sentence) AS char_end, greatest(1, round_even(length(sentence) / 4.0, 0)::BIGINT) AS n,
                        row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) AS i FROM placed JOIN found USING (doc_id, ord, k) JOIN offsets USING (doc_id, ord)),
    summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, mark ORDER BY i)::BIGINT AS upto, max(i) OVER (PARTITION BY doc_id, mark) AS last_i FROM numbered),
    ends AS (SELECT a.doc_id, a.mark, a.i, a.upto - a.n AS before, coalesce(min(b.i), any_value(a.last_i) + 1) AS e FROM summed a
             LEFT JOIN summed b ON b.doc_id = a.doc_id AND b.mark = a.mark AND b.i > a.i AND b.upto - a.upto + a.n > 128 GROUP BY ALL),
    tails AS (SELECT c.doc_id, c.i, c.e, any_value(z.upto) AS upto, min(struct_pack(i := q.i, before := q.upto - q.n)) AS tail FROM ends c JOIN summed z ON z.doc_id = c.doc_id AND z.i = c.e AND z.mark = c.mark
              JOIN summed q ON q.doc_id = c.doc_id AND q.i >= c.i AND q.i <= c.e AND z.upto - z.n - q.upto + q.n <= 16 GROUP BY c.doc_id, c.i, c.e),
    jumps AS (SELECT doc_id, i, CASE WHEN upto - tail.before <= 128 THEN tail.i ELSE e END AS onward FROM tails),
    chain AS (
        SELECT doc_id, min(i) AS i FROM summed GROUP BY doc_id, mark
        UNION ALL
        SELECT j.doc_id, j.onward FROM chain c JOIN jumps j ON j.doc_id = c.doc_id AND j.i = c.i),
    groups AS (SELECT c.doc_id, c.i, any_value(e.mark) AS mark, string_agg(s.sentence, ' ' ORDER BY s.i) AS text, sum(s.n)::BIGINT AS n, min_by(s.page, s.i) AS page_number, max(s.page) AS last_page,
                      min_by(s.char_start, s.i) AS char_start, max_by(s.char_end, s.i) AS char_end, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.i) AS pos
               FROM chain c JOIN ends e ON e.doc_id = c.doc_id AND e.i = c.i JOIN summed s ON s.doc_id = c.doc_id AND s.i >= c.i AND s.i < e.e GROUP BY c.doc_id, c.i),
    named AS (SELECT g.*, coalesce(path, []) AS path, section, heading FROM groups g LEFT JOIN paths p ON p.doc_id = g.doc_id AND p.ord = g.mark),
    pairs AS (SELECT a.*, b.text AS b_text, b.path AS b_path, b.section AS b_section, b.heading AS b_heading, b.last_page AS b_last, b.char_end AS b_end,
                     coalesce(a.n < 16 AND b.path[1:len(a.path)] = a.path AND a.n + b.n <= 256, false) AS takes
              FROM named a LEFT JOIN named b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
    stands AS (
        SELECT doc_id, 1::BIGINT AS pos, 0::BIGINT AS chunk_index FROM pairs WHERE pos = 1
        UNION ALL
        SELECT p.doc_id, p.pos + CASE WHEN p.takes THEN 2 ELSE 1 END, s.chunk_index + 1 FROM stands s JOIN pairs p ON p.doc_id = s.doc_id AND p.pos = s.pos),
    structural AS (SELECT doc_id AS document_id, 'doc-' || doc_id AS document_name, source AS user_id, chunk_index, CASE WHEN takes THEN text || ' ' || b_text ELSE text END AS text,
                          page_number, nullif(greatest(CASE WHEN takes THEN greatest(last_page, b_last) ELSE last_page END, page_number), page_number) AS page_end, NULL::INT AS slide_number,
                          CASE WHEN takes AND len(b_path) > len(path) THEN b_section ELSE section END AS section, CASE WHEN takes AND len(b_path) > len(path) THEN b_heading ELSE heading END AS heading,
                          char_start, CASE WHEN takes THEN b_end ELSE char_end END AS char_end, 'text' AS source
                   FROM pairs JOIN stands USING (doc_id, pos) JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
    hashed AS (SELECT *, sha256(regexp_replace({NORMAL}, '^\\s+|\\s+$', '', 'g')) AS content_hash FROM structural)""")


@check("structural_chunks", f"""WITH RECURSIVE {STRUCTURAL} SELECT *, greatest(1, round_even(length(text) / 4.0, 0)::INT) AS token_count,
    {uuid5_sql(t.CHUNK_NAMESPACE, "document_id::VARCHAR || ':' || hashed.content_hash")} AS chunk_id FROM hashed""")
def structural_chunks(spark, sf):
    return ch.structural_chunks(line_blocks(spark, sf), 128, 16, 16).drop("heading_path")


@check("shingles", f"WITH {sql.GRAMS} SELECT doc_id, count(g) AS shingles FROM documents LEFT JOIN grams USING (doc_id) GROUP BY 1")
def shingles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(c.shingles("text")).cast("bigint").alias("shingles"))


@check("passage_overlap", f"""WITH {sql.GRAMS}, d AS (SELECT doc_id, list(g) AS gs FROM grams GROUP BY 1),
    {sql.GRAMS.replace("grams AS", "asked_grams AS").replace("tw", "bw").replace("tg", "bg").replace("documents", "benchmark").replace("doc_id", "item_id")}, b AS (SELECT item_id, list(g) AS gs FROM asked_grams GROUP BY 1)
    SELECT item_id, doc_id, round(len(list_intersect(b.gs, d.gs)) / least(len(b.gs), len(d.gs)), 6) AS overlap FROM b, d WHERE list_has_any(b.gs, d.gs)""")
def passage_overlap(spark, sf):
    """How much of a passage a document holds, for all that share a run of words; met by that run."""
    runs = lambda name, key: table(spark, sf, name).select(key, c.shingles("text").alias("runs"))
    docs, asked = cut(runs("documents", "doc_id")), cut(runs("benchmark", "item_id"))
    met = docs.select("doc_id", F.explode("runs").alias("run")).join(asked.select("item_id", F.explode("runs").alias("run")), "run").select("item_id", "doc_id").distinct()
    both = met.join(docs, "doc_id").join(asked.withColumnRenamed("runs", "asked"), "item_id")
    return both.select("item_id", "doc_id", F.round(c.overlap_coefficient("asked", "runs"), 6).alias("overlap"))


@check("stemmed_terms")
def stemmed_terms(spark, sf):
    return table(spark, sf, "documents").select(F.explode(terms("text", stem=False)).alias("term")).groupBy("term").count().select(
        "term", stem_all(F.array("term"))[0].alias("stem"), "count")


@check("labels_of_text", r"""WITH p AS (SELECT doc_id, doc_id % 7 = 0 AS slide, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS x, text, source, lang FROM documents)
    SELECT doc_id, 'doc-' || doc_id || ' > ' || source || ' > ' || lang || chr(10) || chr(10) || text AS embedding_text,
           'doc-' || doc_id || CASE WHEN slide THEN ' · slide ' || (doc_id % 50) WHEN doc_id % 3 = 0 THEN ' · pp.' || (doc_id % 50) || '–' || (doc_id % 50 + 1) ELSE ' · p.' || (doc_id % 50) END
               || ' · ' || source || ' › ' || lang || CASE WHEN doc_id % 5 = 0 THEN ' · read from an image' ELSE '' END AS location,
           CASE WHEN length(x) <= 320 THEN x ELSE regexp_replace(substr(x, 1, 320), ' [^ ]*$', '') || '…' END AS snippet,
           CASE WHEN x = '' THEN 'New chat' WHEN length(x) <= 60 THEN x
                WHEN 60 - instr(reverse(substr(x, 1, 60)), ' ') > 36 AND instr(substr(x, 1, 60), ' ') > 0 THEN rtrim(substr(x, 1, 60 - instr(reverse(substr(x, 1, 60)), ' '))) || '…'
                ELSE rtrim(substr(x, 1, 60)) || '…' END AS title
    FROM p""")
def labels_of_text(spark, sf):
    d = table(spark, sf, "documents").withColumn("name", F.concat(F.lit("doc-"), F.col("doc_id"))).withColumn("path", F.array("source", "lang"))
    n = F.col("doc_id") % 50
    slide = F.col("doc_id") % 7 == 0
    return d.select(
        "doc_id", t.embedding_text("name", "path", "text").alias("embedding_text"),
        t.location_label("name", F.when(~slide, n), F.when(F.col("doc_id") % 3 == 0, n + 1), F.when(slide, n), "path",
                         F.when(F.col("doc_id") % 5 == 0, "vision").otherwise("text")).alias("location"),
        t.snippet("text").alias("snippet"), t.derive_title("text").alias("title"))


@check("normalise_heading", r"""WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, doc_id % 9 || '.' || doc_id % 4 || '. ' || line || ':' AS x FROM h WHERE line <> '')
    SELECT regexp_replace(regexp_replace(lower(x), '^\d+(\.\d+)*\.?\s+', ''), '[\s:.!?\-]+$', '') AS heading, count(*) AS lines FROM n GROUP BY 1""")
def normalise_heading(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    x = F.concat_ws("", F.col("doc_id") % 9, F.lit("."), F.col("doc_id") % 4, F.lit(". "), "line", F.lit(":"))
    return lines.groupBy(t.normalise_heading(x).alias("heading")).agg(F.count("*").alias("lines"))
