"""Every registered query beside its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import compare
from passagework import catalog


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_matches_sql(spark, con, sf, name):
    ok, note = compare.run(spark, con, sf, name)
    if ok is None:
        pytest.skip(note)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "rank", "score"]
