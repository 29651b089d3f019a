"""The mixing stage deals every copy along the curriculum."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagework.llm import mixing


def test_copies_in_order_of_their_own_positions(spark):
    rows = [(k, f"s{k % 3}", " ".join(f"w{k}" for _ in range(5 + k % 4))) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    made = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert max(r.copies for r in made.values()) == 2
    due = []
    for place, source in enumerate(("s0", "s1", "s2")):
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest()[:15], r[0]))
        at, asked, size = 0, round(made[mine[0][0]].target), made[mine[0][0]].source_size
        for i, _, text in mine:
            for turn in range(made[i].copies):
                share = (at + turn * size) / asked
                # The integrals of the three schedules, inverted by bisection.
                area = (lambda t: 1.5 * t - t * t / 2, lambda t: t, lambda t: 0.5 * t + 0.5 * t * t)[place]
                low, high = 0.0, 1.0
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (mid, high) if area(mid) < share else (low, mid)
                due.append((low, i))
            at += len(text.split())
    got = [r.doc_id for r in mixing.mixed_documents(docs).collect()]
    assert Counter(got) == Counter(i for _, i in due)
    times: dict[int, list[float]] = {}
    for t, i in sorted(due):
        times.setdefault(i, []).append(t)
    dealt = [times[i].pop(0) for i in got]
    assert all(b > a - 1e-9 for a, b in zip(dealt, dealt[1:], strict=False))
    flat = [r.doc_id for r in mixing.mixed_documents(docs, schedules=(((0.0, 1.0), (1.0, 1.0)),)).collect()]
    assert Counter(flat) == Counter(got) and flat != got


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_every_row_gets_its_own_deal(spark, ids):
    """A source whose rows have no ids, one id, or their own: as many copies either way; texts alike or not."""
    i = {"null": "cast(null as long)", "one": "7L", "own": "id"}[ids]
    small = spark.range(300).selectExpr(f"{i} as doc_id", "concat(repeat('w ', 49), if(id < 150, 'same', concat('x', id))) as text", "'a' as source", "'x' as due", "1 as place")
    large = spark.range(90).selectExpr("1000 + id as doc_id", "repeat('w ', 400) as text", "'b' as source", "'y' as due", "2 as place")
    nothing = spark.createDataFrame([(None, None, None, "z", 3), (5, "", "a", None, None), (5, "", "a", None, None)], "doc_id long, text string, source string, due string, place int")
    docs = small.unionByName(large).unionByName(nothing).repartition(3)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    got = {r.source: r.n for r in made.groupBy("source").agg(F.count("*").alias("n")).collect()}
    dealt = mixing._dealt(docs, "doc_id", "source", "text", mixing.WEIGHTS, 1.5, 2.0).groupBy("source").agg(F.sum("copies").alias("n"), F.max("target").alias("target")).collect()
    assert got == {r.source: r.n for r in dealt if r.n}
    assert all(abs(got[r.source] * {"a": 50, "b": 400}[r.source] - r.target) <= 400 for r in dealt if r.n)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
