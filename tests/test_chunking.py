"""The chunkers against a plain reading of their rules, one document at a time."""

import math
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from passagework.functions.sequence import carried, exact_percentiles, upper_median, with_position
from passagework.operators import chunking as ch
from passagework.sources.chunks import cached_embed, delete_from, load_chunks, merge_into, save_chunks, scan_saved, scope_saved, upsert_summary
from passagework.session import work_dir

SCHEMA = "document_id string, order int, type string, level int, page int, slide int, source string, text string"


def tokens(text):
    return max(1, round(len(text) / 4)) if text else 0


def make_document(rng, name, most=40):
    rows, page = [], 1
    for order in range(rng.randint(3, most)):
        page += rng.random() < 0.2
        kind = rng.choices(["heading", "paragraph", "table", "figure"], [2, 6, 1, 2])[0]
        words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "of", "normal"]) for _ in range(n))
        if kind == "heading":
            text = words(2).title()
        elif kind == "table":
            text = "\n".join(words(rng.randint(1, 12)) for _ in range(rng.randint(1, 30)))
        else:
            text = " ".join(words(rng.randint(1, 14)).capitalize() + "." for _ in range(rng.randint(1, 6)))
        rows.append((name, order * 3, kind, rng.randint(1, 3) if kind == "heading" else None, page, None, "vision" if kind == "figure" else "text", text))
    return rows


def by_the_rules(rows, target, overlap, least):
    """(path, text) of every chunk of one document."""
    segments, path = [], []
    for _, _, kind, level, page, slide, _, text in sorted(rows, key=lambda r: r[1]):
        if kind == "heading":
            path = [h for h in path if h[0] < level] + [(level, text)]
            segments.append((tuple(h[1] for h in path), []))
            continue
        if not segments:
            segments.append(((), []))
        parts = [text] if kind in ch.ATOMIC else [s + "." for s in text[:-1].split(". ")]
        segments[-1][1].extend((p, tokens(p), kind in ch.ATOMIC, kind == "figure", (page, slide)) for p in parts)
    groups = []
    for path, pieces in segments:
        current = []

        def close():
            if current:
                groups.append((path, [p[0] for p in current], sum(p[1] for p in current)))

        for piece in pieces:
            if current and piece[3] and piece[4] != current[-1][4]:
                close()
                current = []
            if piece[2] and piece[1] > target:
                close()
                current = []
                if piece[1] <= 2 * target:
                    groups.append((path, [piece[0]], piece[1]))
                else:
                    lines, used = [], 0
                    for line in piece[0].split("\n"):
                        if lines and used + tokens(line) > target:
                            groups.append((path, lines, used))
                            lines, used = [], 0
                        lines, used = [*lines, line], used + tokens(line)
                    groups.append((path, lines, used))
                continue
            if current and sum(p[1] for p in current) + piece[1] > target:
                close()
                tail, room = [], overlap
                for p in reversed(current):
                    if p[2] or p[1] > room:
                        break
                    tail, room = [p, *tail], room - p[1]
                current = tail if sum(p[1] for p in tail) + piece[1] <= target else []
            current = [*current, piece]
        close()
    merged, i = [], 0
    while i < len(groups):
        path, parts, size = groups[i]
        if i + 1 < len(groups):
            after, more, extra = groups[i + 1]
            if size < least and after[: len(path)] == path and size + extra <= 2 * target:
                merged.append((after, parts + more))
                i += 2
                continue
        merged.append((path, parts))
        i += 1
    return [(p, " ".join(x).strip()) for p, x in merged]


@pytest.mark.parametrize("stretch", [64, 2, 3])
def test_structural_chunks_follow_the_rules(spark, stretch):
    """Also where a run is many stretches: one has no heading, one is a single block, one has a piece longer than a stretch."""
    rng = random.Random(5)
    documents = {f"d{i}": make_document(rng, f"d{i}") for i in range(25)}
    sentence = lambda n: " ".join(rng.choice(["alpha", "beta", "of"]) for _ in range(n)).capitalize() + "."
    documents["long"] = [("long", k, "paragraph", None, 1, None, "text", " ".join(sentence(rng.randint(1, 14)) for _ in range(rng.randint(1, 9)))) for k in range(150)]
    documents["one"] = [("one", 7, "paragraph", None, None, None, "text", " ".join(sentence(rng.choice([1, 9, 40])) for _ in range(200)))]
    documents["wide"] = [("wide", k, "paragraph", None, None, None, "text", sentence(900 if k % 3 == 1 else 5)) for k in range(12)]
    blocks = spark.createDataFrame([r for rows in documents.values() for r in rows], SCHEMA)
    got = ch.structural_chunks(blocks, 40, 12, 15, stretch).orderBy("document_id", "chunk_index").collect()
    for name, rows in documents.items():
        mine = [(tuple(c.heading_path), c.text) for c in got if c.document_id == name]
        assert mine == by_the_rules(rows, 40, 12, 15), name
        assert [c.chunk_index for c in got if c.document_id == name] == list(range(len(mine)))


def test_chunk_columns(spark):
    rows = [("d", 0, "heading", 1, 1, None, "text", "Title"), ("d", 1, "paragraph", None, 1, None, "text", "One two three. Four five six."), ("d", 2, "paragraph", None, 2, None, "text", "Seven.")]
    c = ch.structural_chunks(spark.createDataFrame(rows, SCHEMA), 100, 0, 0).collect()
    assert len(c) == 1
    c = c[0]
    assert (c.heading, c.section, c.page_number, c.page_end, c.source) == ("Title", "Title", 1, 2, "text")
    assert (c.char_start, c.char_end) == (7, 44)
    with pytest.raises(ValueError):
        ch.fixed_window_chunks(spark.createDataFrame(rows, SCHEMA), 10, 10)


def test_rechunking_changes_no_row(spark):
    blocks = spark.createDataFrame(make_document(random.Random(2), "d"), SCHEMA)
    a, b = (ch.dedupe_chunks(ch.structural_chunks(blocks, 40, 12, 15)) for _ in range(2))
    s = upsert_summary(a, b).collect()[0]
    assert (s.inserted, s.removed) == (0, 0)


def test_merge_into_touches_only_its_documents(spark):
    path = work_dir(spark)
    one = spark.createDataFrame([(f"d{i}", f"c{i}-{j}", j) for i in range(30) for j in range(5)], "document_id string, chunk_id string, chunk_index int")
    save_chunks(one, path, 8)
    new = spark.createDataFrame([("d3", "c3-1", 0), ("d3", "new", 1), ("d99", "first", 0)], one.schema)
    merge_into(spark, path, new)
    after = spark.read.parquet(path)
    assert after.filter("document_id = 'd3'").count() == 2 and after.filter("document_id = 'd99'").count() == 1
    assert after.count() == 29 * 5 + 3
    merge_into(spark, path, new.limit(0), spark.createDataFrame([("d4",), ("d5",), ("unheard",)], "document_id string"))
    assert load_chunks(spark, path).count() == 27 * 5 + 3


def test_a_bucket_left_empty_goes(spark):
    path = work_dir(spark)
    rows = spark.createDataFrame([(f"d{i}", "u", f"c{i}", 0) for i in range(12)], "document_id string, user_id string, chunk_id string, chunk_index int")
    save_chunks(rows, path, 64)
    assert delete_from(spark, path, rows.filter("document_id in ('d1', 'd2')"), rows.filter("document_id = 'd2'")) == 1
    assert {r[0] for r in load_chunks(spark, path).select("document_id").collect()} == {f"d{i}" for i in range(12)} - {"d1"}


def test_a_scoped_read_opens_its_owners_folders(spark):
    path = work_dir(spark)
    rows = spark.range(4000).selectExpr("id % 400 as document_id", "concat('u', id % 40) as user_id", "id as chunk_id", "cast(id div 400 as int) as chunk_index")
    save_chunks(rows, path, 8)

    def read(df):
        """Rows and files that the scan of the table reads."""
        plan = df._jdf.queryExecution()
        n, todo = df._jdf.collectAsList().size(), [plan.executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            elif "QueryStage" in node.nodeName():
                todo.append(node.plan())
            elif node.nodeName().startswith("Scan parquet"):
                return n, node.metrics().apply("numPartitions").value()
            else:
                todo += [node.children().apply(k) for k in range(node.children().size())]

    folders = sum(len(os.listdir(f"{path}/buckets=8/owners=16/{o}")) for o in os.listdir(f"{path}/buckets=8/owners=16") if o.startswith("owner="))
    n, opened = read(scan_saved(spark, path, "u3"))
    assert n == 100 and opened <= 8 < folders
    n, opened = read(scan_saved(spark, path, "u3", [3, 43, 4]))
    assert n == 20 and opened <= 3
    assert scan_saved(spark, path, "u3", []).count() == scan_saved(spark, path, "nobody").count() == 0
    n, opened = read(scope_saved(spark, path, spark.createDataFrame([("u3", 3), ("u7", 7), ("u7", 8)], "user_id string, document_id long")))
    assert n == 20 and opened <= 16
    # A document that comes again under another owner leaves its old folder.
    merge_into(spark, path, spark.createDataFrame([(3, "u9", 1, 0)], rows.schema))
    assert scan_saved(spark, path, "u3", [3]).count() == 0 and scan_saved(spark, path, "u9", [3]).count() == 1
    assert load_chunks(spark, path).count() == 3991


def test_each_missing_text_is_embedded_once(spark):
    log = work_dir(spark)
    os.makedirs(log, exist_ok=True)

    def embed(texts):
        with open(f"{log}/{uuid.uuid4()}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(x)), uuid.uuid4().int % 97] for x in texts]

    rows = spark.createDataFrame([(k, f"text {k % 5}") for k in range(20)], "chunk_id int, text string").repartition(4)
    cache = spark.createDataFrame([], "model_key string, content_hash string, dimensions int, vector array<double>")
    made, fresh, counts = cached_embed(rows, cache, embed, "m")
    vectors = {r.text: tuple(r.vector) for r in made.collect()}
    assert {tuple(r.vector) for r in fresh.collect()} == set(vectors.values()) and tuple(counts.first()) == (0, 5)
    assert sorted(line for f in os.listdir(log) for line in open(f"{log}/{f}").read().split("\n")) == sorted(vectors)


def test_sequences_with_one_huge_group(spark):
    """One key holds most rows; stretches of ten rows give what one window would."""
    rng = random.Random(4)
    rows = [("big", i * 2, rng.choice([None, 1, 2, 3])) for i in range(400)] + [(f"k{i}", 5, 1) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = carried(df, ["k"], "o", last={"l": F.col("v")}, last_before={"b": F.col("v")}, sums={"s": F.col("v")}, sums_before={"p": F.col("v")}, totals={"t": F.col("v")}, width=10)
    total = {}
    for k, _, v in rows:
        total[k] = total.get(k, 0) + (v or 0)
    last, running = {}, {}
    for k, o, v in rows:
        before, sofar = last.get(k), running.get(k, 0)
        last[k] = v if v is not None else before
        running[k] = sofar + (v or 0)
        rows_out = (k, o, last[k], before, running[k], sofar, total[k])
        total.setdefault("out", []).append(rows_out)
    assert sorted(tuple(r) for r in got.select("k", "o", "l", "b", "s", "p", "t").collect()) == sorted(total["out"])
    at = with_position(df, ["k"], "o", "at", "n", width=7).filter("k = 'big'").orderBy("o").collect()
    assert [x["at"] for x in at] == list(range(400)) and at[0].n == 400


def test_percentiles_and_medians(spark):
    values = [5, 1, 9, 3, 3, 8, 2, 7, 6, 4]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", None)], "g string, v int")
    rng = random.Random(8)
    many = [(g, rng.choice([rng.lognormvariate(0, 4), -1.5, 1e300, float(rng.randrange(40))])) for g in ("a", None) for _ in range(700)] + [("one", 2.0)] * 5 + [("b", None)]
    ordered = {g: sorted(v for h, v in many if h == g) for g in ("a", None, "one")}
    want = sorted(((g, *(x[max(math.ceil(p * len(x)) - 1, 0)] for p in (0.0, 0.31, 0.95, 1.0))) for g, x in ordered.items()), key=str)
    wide = spark.createDataFrame(many, "g string, v double")
    for listed in (1024, 10, 1):
        got = exact_percentiles(wide, ["g"], "v", {"a": 0.0, "b": 0.31, "c": 0.95, "d": 1.0}, listed).collect()
        assert sorted((tuple(x) for x in got), key=str) == want, listed
    p = exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    assert [(x.g, x.p50, x.p95) for x in p] == [("g", 4, 9)]
    assert upper_median(df, ["g"], "v", "m").collect()[0].m == 5
