"""Checked queries: typeset lines, tables, pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.chunks import BLOCKS, HEADING, line_blocks
from passagework.catalog.frames import table
from passagework.operators import images as im
from passagework.operators import structure as sx
from passagework.plans.structure import structure_lines

QUERIES, ORACLES = {}, {}


def check(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return add


# Document lines set on pages of eight; short lines large, every fourth bold, wide gaps now and then.
SET = """raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents),
    lines AS (SELECT doc_id AS document_id, ord, 1 + ord // 8 AS page, text, CASE WHEN length(text) < 15 THEN 16.0 WHEN length(text) < 60 AND doc_id % 5 = 0 THEN 12.04 ELSE 10.0 END AS font_size, ord % 4 = 0 AS is_bold,
        50.0 + ord % 2 AS x0, (ord % 8) * 20.0 + CASE WHEN ord % 8 >= 5 THEN 30 ELSE 0 END AS y0, 50.0 + length(text) AS x1, (ord % 8) * 20.0 + CASE WHEN ord % 8 >= 5 THEN 30 ELSE 0 END + 12 AS y1 FROM raw WHERE text <> '')"""


def set_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("order", "text")).filter("text <> ''")
    top = (F.col("order") % 8) * 20.0 + F.when(F.col("order") % 8 >= 5, 30).otherwise(0)
    return d.select(
        F.col("doc_id").alias("document_id"), "order", (1 + F.floor(F.col("order") / 8)).cast("int").alias("page"), "text",
        F.when(F.length("text") < 15, 16.0).when((F.length("text") < 60) & (F.col("doc_id") % 5 == 0), 12.04).otherwise(10.0).alias("font_size"),
        (F.col("order") % 4 == 0).alias("is_bold"), (50.0 + F.col("order") % 2).alias("x0"), top.alias("y0"), (50.0 + F.length("text")).alias("x1"), (top + 12).alias("y1"))


RULED = "tables AS (SELECT DISTINCT document_id, page, 40.0 AS x0, 30.0 AS y0, 200.0 AS x1, 90.0 AS y1, 'a | b' AS text FROM lines WHERE page % 2 = 1)"


def ruled_tables(spark, sf):
    return set_lines(spark, sf).filter("page % 2 = 1").select("document_id", "page").distinct().select(
        "document_id", "page", F.lit(40.0).alias("x0"), F.lit(30.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(90.0).alias("y1"), F.lit("a | b").alias("text"))


@check("body_sizes", f"""WITH {SET}, w AS (SELECT document_id, round_even(font_size, 1) AS size, sum(greatest(length(trim(text)), 1)) AS weight, min(ord) AS seen FROM lines GROUP BY ALL),
    b AS (SELECT document_id, max_by(size, (weight, -seen)) AS body_size, max(weight) AS top FROM w GROUP BY 1)
    SELECT document_id, any_value(body_size)::DOUBLE AS body_size, max(size) FILTER (size = body_size OR weight >= greatest(top * 0.3, 200))::DOUBLE AS body_ceiling FROM w JOIN b USING (document_id) GROUP BY 1""")
def body_sizes(spark, sf):
    return sx.body_sizes(set_lines(spark, sf))


@check("heading_levels", f"""WITH RECURSIVE {SET}, w AS (SELECT document_id, round_even(font_size, 1) AS size, sum(greatest(length(trim(text)), 1)) AS weight, min(ord) AS seen FROM lines GROUP BY ALL),
    b AS (SELECT document_id, max_by(size, (weight, -seen)) AS body_size, max(weight) AS top FROM w GROUP BY 1),
    c AS (SELECT document_id, max(size) FILTER (size = body_size OR weight >= greatest(top * 0.3, 200))::DOUBLE AS ceiling FROM w JOIN b USING (document_id) GROUP BY 1),
    x AS (SELECT document_id, ord, font_size::DOUBLE AS font_size, is_bold, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM lines),
    h AS (SELECT x.*, ceiling, ceiling > 0 AND font_size >= ceiling * 1.08::DOUBLE AS larger FROM x JOIN c USING (document_id)),
    n AS (SELECT * FROM h WHERE x <> '' AND length(x) <= 200 AND regexp_matches(x, '[\\p{{L}}\\p{{N}}]') AND (larger OR (is_bold AND {HEADING}))),
    s AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY size DESC) AS k FROM (SELECT DISTINCT document_id, round_even(font_size, 2)::DOUBLE AS size FROM n)),
    f AS (SELECT document_id, k, size AS lead_size, 1 AS place FROM s WHERE k = 1
          UNION ALL SELECT s.document_id, s.k, CASE WHEN abs(lead_size - size) / greatest(lead_size, 1e-6) > 0.03 THEN size ELSE lead_size END,
                           place + (abs(lead_size - size) / greatest(lead_size, 1e-6) > 0.03)::INT FROM f JOIN s ON s.document_id = f.document_id AND s.k = f.k + 1),
    l AS (SELECT DISTINCT document_id, place, lead_size FROM f), m AS (SELECT document_id, max(place) AS places FROM l GROUP BY 1)
    SELECT n.document_id, ord AS "order", CASE WHEN any_value(ceiling) > 0 AND NOT any_value(larger) THEN least(any_value(places) + 1, 6)
           ELSE least(arg_min(place, (abs(lead_size - round_even(font_size, 2)), place)), 6) END AS level
    FROM n JOIN l USING (document_id) JOIN m USING (document_id) GROUP BY n.document_id, ord""")
def heading_levels(spark, sf):
    return sx.heading_levels(set_lines(spark, sf)).filter("level IS NOT NULL").select("document_id", "order", "level")


@check("merge_paragraphs", f"""WITH {SET}, h AS (SELECT *, CASE WHEN length(text) < 15 THEN 2 END AS level FROM lines),
    p AS (SELECT *, lag(page) OVER o AS p_page, lag(y1) OVER o AS p_y1, lag(font_size) OVER o AS p_size, lag(level) OVER o AS p_level, row_number() OVER o AS rn FROM h WINDOW o AS (PARTITION BY document_id ORDER BY ord)),
    m AS (SELECT document_id, list_sort(list(y0 - p_y1))[count(*) // 2 + 1] AS usual FROM p WHERE p_page = page GROUP BY 1),
    s AS (SELECT p.*, (rn = 1 OR level IS NOT NULL OR p_level IS NOT NULL OR p_page <> page OR y0 - p_y1 > coalesce(usual, 0) + greatest(2.0, 0.35 * p_size))::INT AS starts FROM p LEFT JOIN m USING (document_id)),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY ord) AS block FROM s)
    SELECT document_id, min(ord) AS line, max(level) AS level, min(page) AS page, count(*) AS n_lines, sha256(regexp_replace(string_agg(text, ' ' ORDER BY ord), '[ \\t]+', ' ', 'g')) AS text_hash, min(x0)::DOUBLE AS x0, max(x1)::DOUBLE AS x1, min(y0)::DOUBLE AS y0, max(y1)::DOUBLE AS y1
    FROM g GROUP BY document_id, block""")
def merge_paragraphs(spark, sf):
    lines = set_lines(spark, sf).withColumn("level", F.when(F.length("text") < 15, 2))
    b = sx.merge_paragraphs(lines)
    return b.select("document_id", F.col("order").cast("bigint").alias("line"), "level", "page", F.sha2("text", 256).alias("text_hash"), "x0", "x1", "y0", "y1", "n_lines")


@check("reading_order", f"""WITH {SET}, {RULED}, u AS (SELECT document_id, page, y0, x0, 'line' AS kind, text FROM lines UNION ALL SELECT document_id, page, y0, x0, 'table', text FROM tables)
    SELECT document_id, page, kind, sha256(text) AS text_hash, row_number() OVER (PARTITION BY document_id ORDER BY page, y0, x0, kind, text) - 1 AS place FROM u""")
def reading_order(spark, sf):
    r = sx.reading_order(set_lines(spark, sf).drop("order"), ruled_tables(spark, sf))
    return r.select("document_id", "page", "kind", F.sha2("text", 256).alias("text_hash"), F.col("order").alias("place"))


@check("outside_tables", f"""WITH {SET}, {RULED} SELECT document_id, ord AS line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM tables t WHERE t.document_id = l.document_id AND t.page = l.page
    AND greatest(0, least(l.x1, t.x1) - greatest(l.x0, t.x0)) * greatest(0, least(l.y1, t.y1) - greatest(l.y0, t.y0)) / greatest((l.x1 - l.x0) * (l.y1 - l.y0), 1e-6) >= 0.5)""")
def outside_tables(spark, sf):
    return sx.outside_tables(set_lines(spark, sf), ruled_tables(spark, sf)).select("document_id", F.col("order").cast("bigint").alias("line"))


@check("table_text", r"""SELECT doc_id, lang || ' | ' || source || ' | ' || chr(10) || replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') || ' | ' || n_chars AS rendered FROM documents""")
def table_text(spark, sf):
    d = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    rows = F.array(F.array("lang", F.concat("source", F.lit(" ")), none), F.array(F.lit(" "), none, F.lit("")), F.array("text", F.col("n_chars").cast("string")))
    return d.select("doc_id", sx.table_text(rows).alias("rendered"))


@check("document_stats", f"""WITH {BLOCKS} SELECT doc_id AS document_id, count(*) FILTER (is_heading) AS headings, 0 AS tables, 0 AS notes, max(page) AS pages, coalesce(any_value(n), 0) AS images
    FROM blocks LEFT JOIN (SELECT user_id AS doc_id, count(*) AS n FROM events GROUP BY 1) USING (doc_id) GROUP BY doc_id""")
def document_stats(spark, sf):
    blocks = line_blocks(spark, sf).filter(F.col("text").rlike(r"\S"))
    return sx.document_stats(blocks, table(spark, sf, "events").select(F.col("user_id").alias("document_id")))


@check("scanned_pages", f"""WITH {SET}, every AS (SELECT document_id, unnest(range(1, max(page) + 2)) AS page FROM lines GROUP BY 1)
    SELECT document_id, page, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM every LEFT JOIN lines USING (document_id, page) GROUP BY ALL HAVING chars < 60""")
def scanned_pages(spark, sf):
    lines = set_lines(spark, sf)
    every = lines.groupBy("document_id").agg(F.max("page").alias("n")).select("document_id", F.explode(F.sequence(F.lit(1), F.col("n") + 1)).alias("page"))
    return sx.scanned_pages(lines, every)


@check("structure_lines")
def structured(spark, sf):
    blocks = structure_lines(set_lines(spark, sf).drop("order"), ruled_tables(spark, sf))
    return blocks.select("document_id", "order", "type", "level", "page", F.sha2("text", 256).alias("text_hash"))


# Events as pictures: a user's are one document, equal k the same picture.
PICTURES = r"""pictures AS (SELECT user_id AS document_id, event_id AS ord, day(ts) AS slide, (value * 2000)::INT AS pixels, 'h' || regexp_extract(props, '\d+') AS content_hash, regexp_extract(props, '\d+')::INT AS k FROM events),
    held AS (SELECT DISTINCT content_hash, CASE WHEN k % 6 = 0 THEN NULL ELSE 'read ' || k END AS reading FROM pictures WHERE k < 40),
    judged AS (SELECT *, pixels > 0 AND pixels < 40000 AS small, min(CASE WHEN NOT (pixels > 0 AND pixels < 40000) THEN ord END) OVER (PARTITION BY document_id, content_hash) AS first_ord FROM pictures),
    chosen AS (SELECT *, CASE WHEN small THEN 'small' WHEN ord > first_ord THEN 'duplicate' ELSE 'chosen' END AS status FROM judged)"""


def pictures(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_id").alias("order"), F.lit(None).cast("int").alias("page"), F.dayofmonth("ts").alias("slide"),
        F.bround(F.col("value") * 2000).cast("int").alias("pixels"), F.concat(F.lit("h"), k).alias("content_hash"), (k % 2 == 0).alias("whole_page"), k.alias("k"))


def readings(spark, sf):
    p = pictures(spark, sf).filter("k < 40").select("content_hash", "k").distinct()
    return p.select(F.lit("m").alias("model_key"), "content_hash", F.when(F.col("k") % 6 != 0, F.concat(F.lit("read "), "k")).alias("reading"))


@check("select_images", f"WITH {PICTURES} SELECT document_id, ord, status FROM chosen")
def select_images(spark, sf):
    return im.select_images(pictures(spark, sf)).select("document_id", F.col("order").alias("ord"), "status")


OUTCOMES = PICTURES + """,
    outcomes AS (SELECT c.*, h.reading, CASE WHEN status <> 'chosen' THEN status WHEN h.content_hash IS NOT NULL THEN 'cached'
        WHEN count(*) FILTER (status = 'chosen' AND h.content_hash IS NULL) OVER (PARTITION BY document_id ORDER BY ord) <= 5 THEN 'pending' ELSE 'skipped_budget' END AS outcome
        FROM chosen c LEFT JOIN held h USING (content_hash))"""


@check("reading_cache_join", f"WITH {OUTCOMES} SELECT document_id, ord, outcome FROM outcomes")
def reading_cache_join(spark, sf):
    return im.reading_cache_join(pictures(spark, sf), readings(spark, sf), "m", 5).select("document_id", F.col("order").alias("ord"), "outcome")


@check("vision_stats", f"""WITH {OUTCOMES} SELECT document_id, count(*) FILTER (outcome = 'small') AS skipped_small, count(*) FILTER (outcome = 'duplicate') AS skipped_duplicate, count(*) FILTER (outcome = 'cached') AS cached,
    count(*) FILTER (outcome = 'skipped_budget') AS skipped_budget, count(*) FILTER (outcome = 'cached' AND reading <> '') AS described, count(*) FILTER (outcome = 'cached' AND reading IS NULL) AS no_content,
    count(*) FILTER (outcome = 'pending') AS figures_pending FROM outcomes GROUP BY 1""")
def vision_stats(spark, sf):
    return im.vision_stats(im.reading_cache_join(pictures(spark, sf), readings(spark, sf), "m", 5))


@check("fan_out_readings", f"""WITH {PICTURES}, p AS (SELECT document_id, ord, k FROM pictures WHERE k < 40)
    SELECT document_id, ord, 'heading' AS type, 2 AS level, '1.' || k || ' Title' AS text FROM p WHERE k % 2 = 0
    UNION ALL SELECT document_id, ord, 'figure', NULL, 'body ' || k || chr(10) || 'Table 3' || chr(10) || 'more' FROM p WHERE k % 2 = 0
    UNION ALL SELECT document_id, ord, 'heading', 3, 'Bold' FROM p WHERE k % 2 = 0 UNION ALL SELECT document_id, ord, 'figure', NULL, 'end' FROM p WHERE k % 2 = 0
    UNION ALL SELECT document_id, ord, 'figure', NULL, '1.' || k || ' Title' || chr(10) || 'body ' || k || chr(10) || 'Table 3' || chr(10) || 'more' || chr(10) || 'Bold' || chr(10) || 'end' FROM p WHERE k % 2 = 1""")
def fan_out_readings(spark, sf):
    p = pictures(spark, sf)
    said = F.concat(F.lit("# 1."), "k", F.lit(" Title\nbody "), "k", F.lit("\n## Table 3\nmore\n### **Bold** ##\nend\n"))
    known = p.select("content_hash", "k").distinct().select("content_hash", F.when(F.col("k") < 40, said).alias("reading"))
    return im.fan_out_readings(p, known).select("document_id", F.col("order").alias("ord"), "type", "level", "text")


@check("image_context", r"""WITH b AS (SELECT user_id AS document_id, day(ts) AS slide, substr(string_agg(event_type || ' ' || regexp_extract(props, '\d+'), ' ' ORDER BY event_id), 1, 400) AS context_hint FROM events GROUP BY ALL)
    SELECT user_id AS document_id, event_id AS ord, coalesce(context_hint, '') AS context_hint FROM events e LEFT JOIN b ON b.document_id = e.user_id AND b.slide = day(e.ts)""")
def image_context(spark, sf):
    e = table(spark, sf, "events")
    blocks = e.select(F.col("user_id").alias("document_id"), F.dayofmonth("ts").alias("slide"), F.col("event_id").alias("order"), F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("text"))
    return im.image_context(pictures(spark, sf), blocks).select("document_id", F.col("order").alias("ord"), "context_hint")


@check("next_retry", r"""WITH e AS (SELECT event_id, value::INT AS unread, event_type = 'error' AS spent, regexp_extract(props, '\d+')::INT % 5 AS tries FROM events)
    SELECT event_id, CASE WHEN unread <= 0 THEN 'complete' WHEN spent OR tries > 2 THEN 'unread' ELSE 'retry' END AS step, CASE WHEN unread > 0 AND NOT spent AND tries <= 2 THEN tries + 1 END AS attempt,
        CASE WHEN unread > 0 AND NOT spent AND tries <= 2 THEN [60, 180, 600][tries + 1] END AS delay_s FROM e""")
def next_retry(spark, sf):
    e = table(spark, sf, "events")
    tries = F.get_json_object("props", "$.k").cast("int") % 5
    return e.select("event_id", im.next_retry(F.bround("value").cast("int"), F.col("event_type") == "error", tries).alias("r")).select("event_id", "r.step", "r.attempt", "r.delay_s")
