"""Saved evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.operators.evaluation import REPORTED, macro_average
from passagework.operators.significance import RESAMPLES, SEED, compare_strategies


def write_report(metrics: DataFrame, path: str, failures: DataFrame | None = None, latencies: DataFrame | None = None) -> None:
    """Saves per-query values beside the averages, so a run can be read again without retrieval."""
    metrics.write.mode("overwrite").partitionBy("strategy").parquet(f"{path}/per_query")
    saved = metrics.sparkSession.read.schema(metrics.schema).parquet(f"{path}/per_query")
    macro_average(saved).write.mode("overwrite").parquet(f"{path}/averages")
    for name, extra in (("failures", failures), ("latencies", latencies)):
        if extra is not None:
            extra.write.mode("overwrite").parquet(f"{path}/{name}")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/per_query")


def reanalyse(spark: SparkSession, path: str, baseline: str, shown=REPORTED, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Significance of a saved run against any of its strategies."""
    return compare_strategies(read_report(spark, path), baseline, shown, resamples, seed)
