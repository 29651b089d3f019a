"""The operators over their whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.align import align
from passagework.llm.binary import read_tokens, token_checksums, write_tokens
from passagework.llm.bpe import encode
from passagework.llm.common import table
from passagework.llm.exact import exact_dedup
from passagework.llm.lexical import search
from passagework.llm.lines import BREAK, EDGES, HIDDEN, TAG, drop_boilerplate
from passagework.llm.mixing import mix
from passagework.llm.quality import quality
from passagework.llm.simhash import near_groups
from passagework.llm.substrings import drop_repeated_chunks
from passagework.llm.suffixes import drop_repeats
from passagework.llm.tokens import count_tokens
from passagework.llm.urls import filter_urls
from passagework.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


@_query("op8_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"), keep="largest")


@_query("op10_mix_sources", r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
    w AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM s),
    f AS (SELECT *, sum(most) OVER upto AS full_, sum(weight) OVER upto AS passed,
                 1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(weight) OVER () AS weights
          FROM w WINDOW upto AS (ORDER BY most / weight, place)),
    c AS (SELECT *, full_ + most / weight * (weights - passed) < goal AS capped FROM f),
    t AS (SELECT source, source_size, place, CASE WHEN capped THEN most ELSE least(most, weight * (
                 SELECT (max(goal) - coalesce(sum(most) FILTER (capped), 0)) / sum(weight) FILTER (NOT capped) FROM c)) END::DOUBLE AS target FROM c),
    o AS (SELECT doc_id, size, source_size, target, place, round(target)::BIGINT AS asked,
                 sum(size) OVER (PARTITION BY d.source ORDER BY hash, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS at_,
                 CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS rounds
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    p AS (SELECT *, greatest(0, least(size, asked - rounds * source_size - at_)) AS part, at_::DOUBLE / asked AS due FROM o)
    SELECT doc_id, size, source_size, target, size * rounds + part AS taken,
           (rounds + CASE WHEN part > 0 AND 2 * part >= size THEN 1 ELSE 0 END)::INTEGER AS copies,
           CASE WHEN size * rounds + part > 0 THEN floor(1e12 * CASE place % 3
                WHEN 0 THEN 2.0::DOUBLE * due / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2.0::DOUBLE * due))
                WHEN 1 THEN due
                ELSE CASE WHEN due - 0.375::DOUBLE >= 0
                     THEN 0.5::DOUBLE + 2.0::DOUBLE * (due - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 2.0::DOUBLE * (due - 0.375::DOUBLE)))
                     ELSE 2.0::DOUBLE * due / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * due)) END END)::BIGINT END AS position
    FROM p""")
def _mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


@_query("op6_quality_rules")
def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@_query("op1_simhash_near_dedup")
def _near(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(table(spark, sf, "documents"))


@_query("op2_token_counts")
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op9_byte_bpe")
def _bpe(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op7_substring_dedup")
def _substrings(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_chunks(table(spark, sf, "documents")).drop("kept")


_HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query("op3_line_dedup", rf"""
    WITH p AS (
        SELECT page_id, {_HOST} AS host, [y FOR y IN [
                   regexp_replace(regexp_replace(x, '{TAG}', '', 'g'), '{EDGES}', '', 'g')
                   FOR x IN string_split_regex(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{BREAK}')] IF y <> ''] AS lines
        FROM pages),
    t AS (SELECT host, count(*) AS pages FROM p GROUP BY host HAVING count(*) >= 5),
    o AS (SELECT host, list(line) AS often FROM (
              SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL) JOIN t USING (host)
          WHERE n > 1 AND n / pages > 0.2 GROUP BY host),
    k AS (SELECT page_id, host, lines, [x FOR x IN lines IF NOT list_contains(coalesce(often, []), x)] AS kept FROM p LEFT JOIN o USING (host))
    SELECT page_id, host, len(lines)::INTEGER AS n_lines, (len(lines) - len(kept))::INTEGER AS n_dropped,
           sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k""")
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    made = drop_boilerplate(table(spark, sf, "pages"))
    return made.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


#: The template tree, a level a round; a round sees the shapes that have a segment there.
_TREE = """
    walk AS (SELECT *, [x FOR x IN string_split(shape, '/') IF x <> ''] AS segments, '' AS template, 0 AS level FROM shapes
        UNION ALL
        SELECT host, shape, pages, judged, good, segments,
               template || CASE WHEN n_pages >= 20 AND n_judged > 0 AND all_judged > n_judged
                                     AND (n_good::DOUBLE / n_judged - (all_good - n_good)::DOUBLE / (all_judged - n_judged)) ** 2
                                         > (1.96::DOUBLE * 1.96::DOUBLE) * (all_good::DOUBLE / all_judged) * (1 - all_good::DOUBLE / all_judged)
                                           * (1.0::DOUBLE / n_judged + 1.0::DOUBLE / (all_judged - n_judged))
                                THEN '/' || segments[level + 1] ELSE '/*' END, level + 1
        FROM (SELECT *, sum(pages) OVER own AS n_pages, sum(judged) OVER own AS n_judged, sum(good) OVER own AS n_good,
                     sum(judged) OVER sisters AS all_judged, sum(good) OVER sisters AS all_good
              FROM walk WHERE level < len(segments)
              WINDOW own AS (PARTITION BY host, template, segments[level + 1]), sisters AS (PARTITION BY host, template))),
    placed AS (SELECT host, shape, pages, judged, good, template FROM walk WHERE level = len(segments))"""


@_query("op5_url_filters", rf"""
    WITH RECURSIVE p AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, regexp_replace(path, '[0-9]+', '#', 'g') AS shape FROM p),
    known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    shapes AS (SELECT host, shape, count(*) AS pages, count(quality) AS judged, count(*) FILTER (quality = 1) AS good
               FROM s LEFT JOIN known ON page_id = doc_id GROUP BY host, shape),
    {_TREE},
    hosts AS (SELECT host, (sum(good) + 20.0::DOUBLE * (SELECT coalesce(sum(good)::DOUBLE / nullif(sum(judged), 0), 1) FROM placed)) / (sum(judged) + 20.0::DOUBLE) AS host_purity
              FROM placed GROUP BY host),
    t AS (SELECT host, template, (sum(good) + 20.0::DOUBLE * max(host_purity)) / (sum(judged) + 20.0::DOUBLE) AS purity FROM placed JOIN hosts USING (host) GROUP BY host, template),
    rules(name, start, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    fits AS (SELECT host, path, arg_max(name || start, length(name || start)) AS rule, arg_max(says, length(name || start)) AS says
             FROM (SELECT DISTINCT host, path FROM s) JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path)
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
    FROM s JOIN placed USING (host, shape) JOIN t USING (host, template) LEFT JOIN fits USING (host, path)""")
def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return filter_urls(table(spark, sf, "pages"), table(spark, sf, "labels"))


@_query("op4_suffix_array_dedup")
def _repeats(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeats(table(spark, sf, "documents")).drop("spans")


@_query("op11_cross_tokenizer_alignment")
def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op12_token_files")
def _token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark)
    write_tokens(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_checksums(read_tokens(spark, path))


@_query("op13_ranked_search", r"""
    WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
    m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // terms) AS m FROM sizes, whole),
    tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
    w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
    asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
               FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
    placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20""")
def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
