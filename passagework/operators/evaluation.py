"""Ranking quality per query, strategy and cutoff, and its aggregates.

Frames
  ranked   query_id, strategy, chunk_id, rank
  qrels    query_id, chunk_id, optional gain (graded relevance; binary when absent)
  runs     query_id, strategy: the queries a strategy answered, empty answers included
  metrics  query_id, strategy, metric, value
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.sequence import exact_percentiles

K_VALUES = (1, 3, 5, 10)
REPORTED = ("mrr", "ndcg@5", "recall@5")


def runs_of(qrels: DataFrame, strategies: Sequence[str], failures: DataFrame | None = None) -> DataFrame:
    """Every gold query under every strategy, less the pairs that failed."""
    names = F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy")
    runs = qrels.select("query_id").distinct().select("query_id", names)
    return runs if failures is None else runs.join(failures, ["query_id", "strategy"], "left_anti")


def stale_ids(qrels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Gold ids the index no longer has."""
    return qrels.select("chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def refuse_if_all_stale(qrels: DataFrame, chunks: DataFrame) -> None:
    """Raises when no gold id is in the index: every metric would be a meaningless zero."""
    if qrels.join(chunks.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
        raise ValueError("none of the gold chunk ids exist in this index")


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def query_metrics(ranked: DataFrame, qrels: DataFrame, runs: DataFrame, k_values: Sequence[int] = K_VALUES) -> DataFrame:
    """recall, precision, ndcg and hit at each k, and mrr over all that was returned."""
    if "gain" not in qrels.columns:
        qrels = qrels.withColumn("gain", F.lit(1.0))
    # One row per chunk of a ranking, at its first place.
    first = ranked.groupBy("query_id", "strategy", "chunk_id").agg(F.min("rank").alias("rank"))
    hits = first.join(qrels, ["query_id", "chunk_id"])
    within = lambda k: F.col("rank") <= k
    found = hits.groupBy("query_id", "strategy").agg(
        F.min("rank").alias("first_rank"),
        *[F.count_if(within(k)).alias(f"found_{k}") for k in k_values],
        *[F.sum(F.when(within(k), F.col("gain") * _discount(F.col("rank")))).alias(f"dcg_{k}") for k in k_values],
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "chunk_id")
    ideal = (
        qrels.withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= max(k_values))
        .groupBy("query_id")
        .agg(*[F.sum(F.when(F.col("place") <= k, F.col("gain") * _discount(F.col("place")))).alias(f"ideal_{k}") for k in k_values])
    )
    relevant = qrels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    values = [F.struct(F.lit("mrr").alias("metric"), zero(F.lit(1.0) / F.col("first_rank")).alias("value"))]
    for k in k_values:
        n = F.coalesce(F.col(f"found_{k}"), F.lit(0))
        ndcg = F.when(F.col(f"ideal_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"ideal_{k}"))
        for name, value in (
            ("recall", zero(n / F.col("relevant"))), ("precision", n / F.lit(float(k))),
            ("ndcg", zero(ndcg)), ("hit", F.when(n > 0, 1.0).otherwise(0.0)),
        ):
            values.append(F.struct(F.lit(f"{name}@{k}").alias("metric"), value.cast("double").alias("value")))
    rows = runs.join(found, ["query_id", "strategy"], "left").join(relevant, "query_id", "left").join(ideal, "query_id", "left")
    return rows.select("query_id", "strategy", F.inline(F.array(*values)))


def macro_average(metrics: DataFrame) -> DataFrame:
    """Mean over queries, each counting the same."""
    return metrics.groupBy("strategy", "metric").agg(F.avg("value").alias("value"), F.count("*").alias("queries"))


def latency_percentiles(latencies: DataFrame, value: str = "took_ms") -> DataFrame:
    return exact_percentiles(latencies, ["strategy"], value, {"p50_ms": 0.50, "p95_ms": 0.95})


def comparison_table(averages: DataFrame, shown: Sequence[str]) -> DataFrame:
    """One row per strategy, one column per metric, and which positive values lead a column."""
    wide = averages.groupBy("strategy").pivot("metric", list(shown)).agg(F.first("value"))
    everyone = Window.partitionBy()  # one row per strategy: a handful
    return wide.select(
        "strategy",
        *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(m) for m in shown],
        *[F.coalesce((F.col(f"`{m}`") == F.max(f"`{m}`").over(everyone)) & (F.col(f"`{m}`") > 0), F.lit(False)).alias(f"best {m}") for m in shown],
    )


def paired_differences(metrics: DataFrame, baseline: str, shown: Sequence[str] = REPORTED) -> DataFrame:
    """Each strategy's value beside the baseline's for the same query.

    Nothing for a pair of runs that do not cover the same queries, or for a missing metric.
    """
    wanted = metrics.filter(F.col("metric").isin(list(shown)))
    base = wanted.filter(F.col("strategy") == baseline).select("query_id", "metric", F.col("value").alias("baseline_value"))
    mine = wanted.filter(F.col("strategy") != baseline)
    pairs = mine.join(base, ["query_id", "metric"])
    sizes = mine.groupBy("strategy", "metric").agg(F.count("*").alias("n"))
    base_sizes = base.groupBy("metric").agg(F.count("*").alias("n_base"))
    paired = pairs.groupBy("strategy", "metric").agg(F.count("*").alias("n_pairs"))
    comparable = (
        sizes.join(base_sizes, "metric").join(paired, ["strategy", "metric"])
        .filter((F.col("n") == F.col("n_base")) & (F.col("n") == F.col("n_pairs")))
        .select("strategy", "metric", "n")
    )
    return pairs.join(comparable, ["strategy", "metric"]).withColumn("difference", F.round(F.col("value") - F.col("baseline_value"), 12))
