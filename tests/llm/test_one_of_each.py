"""One row of each group stays, also where rows repeat an id or have none."""

from __future__ import annotations

import pytest
from test_operators import prose

from passagework.llm import exact, simhash

ROWS = [(1, "a a", "x"), (1, "a a", "x"), (1, "a a", "y"), (2, "a a", "x"), (None, "b b", "x"), (None, "b b", "x"), (None, "a a", "x"), (3, "c", "x"), (3, "d", "x"), (None, None, "x"), (None, "", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3).cache()


@pytest.mark.parametrize(("keep", "best"), [("smallest", 1), ("largest", 2)])
def test_exact(docs, keep, best):
    kept = exact.without_copies(docs, keep=keep)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(best, "a a"), (None, "b b"), (3, "c"), (3, "d"), (None, "")], key=str)


def test_near(spark, docs):
    kept = simhash.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted([(1, "a a"), (None, "b b"), (3, "c"), (3, "d"), (None, "")], key=str)
    text = prose(3, 400)
    rows = [(5, text, "x"), (5, text.encode().upper().decode(), "x"), (5, text, "x"), (9, text, "x")]
    assert [r.doc_id for r in simhash.without_near_copies(spark.createDataFrame(rows, docs.schema)).collect()] == [5]
