"""Trace records made fit for the trace table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import as_uuid, valid_uuid

# Column widths.
KIND, NAME, ERROR = 64, 128, 4000


def clean_traces(records: DataFrame) -> DataFrame:
    """Cuts over-long fields; any correlation label becomes a UUID; a bad owner is dropped, not the row."""
    return records.withColumns({
        "kind": F.substring("kind", 1, KIND),
        "name": F.substring("name", 1, NAME),
        "error": F.when(F.col("error") != "", F.substring("error", 1, ERROR)),
        "correlation_id": as_uuid("correlation_id"),
        "user_id": valid_uuid("user_id"),
    })


def bad_traces(records: DataFrame) -> DataFrame:
    """Records the table cannot hold: no kind, no name or no time."""
    return records.filter(F.col("kind").isNull() | F.col("name").isNull() | F.col("created_at").isNull())


def append_traces(records: DataFrame, path: str) -> None:
    good = records.filter(F.col("kind").isNotNull() & F.col("name").isNotNull() & F.col("created_at").isNotNull())
    clean_traces(good).write.mode("append").parquet(path)
