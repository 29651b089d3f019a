"""Trace analytics: stages, traces, recent failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.sequence import exact_percentiles

STAGE = ["kind", "name"]


def recent(traces: DataFrame, hours: float, now: Column) -> DataFrame:
    since = now - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(int(round(hours % 1 * 60))))
    return traces.filter(F.col("created_at") > since)


def stage_summary(traces: DataFrame, hours: float, now: Column, kind: str | None = None) -> DataFrame:
    """Per stage: calls, errors, and nearest-rank p50 and p95 of its duration, slowest first.

    Durations are folded to counts before ranking, so a stage holding most rows stays small.
    """
    rows = recent(traces, hours, now)
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    counted = rows.groupBy(*STAGE).agg(
        F.count("*").alias("calls"), F.count("error").alias("errors"), F.max("duration_ms").alias("worst"))
    places = exact_percentiles(rows, STAGE, "duration_ms", {"p50": 0.5, "p95": 0.95})
    return counted.join(places, STAGE, "left").select(*STAGE, "calls", "errors", "p50", "p95", "worst").orderBy("kind", F.desc_nulls_last("p95"))


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Per correlation id: kind of the first span, spans, whole duration, whether any span failed.

    The request span encloses the others, so it is the duration; without one, the longest span is.
    """
    request = F.min_by("duration_ms", F.when(F.col("name") == "request", F.struct("created_at", "trace_id")))
    return traces.groupBy("correlation_id").agg(
        F.min_by("kind", F.struct("created_at", "trace_id")).alias("kind"),
        F.count("*").alias("spans"),
        F.coalesce(request, F.greatest(F.lit(0), F.max("duration_ms"))).alias("total_ms"),
        F.bool_or(F.col("error").isNotNull()).alias("failed"),
    )


def trace_spans(traces: DataFrame, correlation_id: str | None = None) -> DataFrame:
    """Spans in time order, one row each: a trace of any size is a range of the sort, not a list."""
    rows = traces if correlation_id is None else traces.filter(F.col("correlation_id") == correlation_id)
    return rows.orderBy("correlation_id", "created_at", "trace_id")


def recent_failures(traces: DataFrame, hours: float, now: Column, limit: int) -> DataFrame:
    """The latest failures of the last hours."""
    failed = recent(traces, hours, now).filter(F.col("error").isNotNull())
    return failed.orderBy(F.desc("created_at"), F.desc("trace_id")).limit(limit)
