"""Paired bootstrap and sign test over per-query differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.sequence import numbered
from passagework.operators.evaluation import REPORTED, paired_differences

RESAMPLES = 10_000
SEED = 20260907
PAIR = ["strategy", "metric"]


def draw(seed: int, rep: Column, place: Column, n: Column) -> Column:
    """A reproducible draw from 0..n-1: the same row is drawn on every engine."""
    key = F.concat_ws(":", F.lit(str(seed)), rep.cast("string"), place.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), n)


def paired_bootstrap(differences: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Per pair: two-sided p, and the 95 % interval of the mean difference.

    Draws are made once per sample size and joined to the differences by place, so the work is
    resamples x n rows spread over the cluster; nothing is gathered. Places come from one range sort of all pairs.
    """
    sorted_rows = numbered(differences.select(*PAIR, "query_id", "n", "difference"), [*PAIR, "query_id"], "at")
    first = sorted_rows.groupBy(*PAIR).agg(F.min("at").alias("first"))
    placed = sorted_rows.join(first, PAIR).select(*PAIR, "n", "difference", (F.col("at") - F.col("first")).alias("place"))
    upto = lambda last: F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    drawn = (
        placed.select("n").distinct()  # run sizes: at most strategies x metrics
        .withColumn("rep", upto(F.lit(resamples - 1))).repartition("n", "rep")
        .withColumn("j", upto(F.col("n") - 1))
        .select("n", "rep", draw(seed, F.col("rep"), F.col("j"), F.col("n")).alias("place"))
        .groupBy("n", "rep", "place").agg(F.count("*").alias("times"))
    )
    means = (
        placed.join(drawn, ["n", "place"])
        .groupBy(*PAIR, "rep", "n")
        .agg(F.sum(F.col("difference") * F.col("times")).alias("total"))
        .withColumn("mean", F.round(F.col("total") / F.col("n"), 9))
    )
    order = Window.partitionBy(*PAIR).orderBy("mean", "rep")  # `resamples` rows per pair
    ranked = means.withColumn("at", F.row_number().over(order) - 1)
    low, high = int(0.025 * resamples), min(resamples - 1, int(0.975 * resamples))
    boot = ranked.groupBy(*PAIR).agg(
        F.least(F.lit(1.0), 2.0 * F.least(F.count_if(F.col("mean") <= 0), F.count_if(F.col("mean") >= 0)) / resamples).alias("p"),
        F.max(F.when(F.col("at") == low, F.col("mean"))).alias("low"),
        F.max(F.when(F.col("at") == high, F.col("mean"))).alias("high"),
    )
    spread = differences.groupBy(*PAIR).agg(F.min("difference").alias("least"), F.max("difference").alias("most"))
    constant = F.col("least") == F.col("most")
    return spread.join(boot, PAIR, "left").select(
        *PAIR,
        F.when(constant, F.when(F.col("least") == 0, 1.0).otherwise(0.0)).otherwise(F.col("p")).alias("p_bootstrap"),
        F.when(constant, F.col("least")).otherwise(F.col("low")).alias("ci_low"),
        F.when(constant, F.col("least")).otherwise(F.col("high")).alias("ci_high"),
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial test at one half; 1 when there is nothing to test.

    At one half the outcomes no likelier than the one seen are the two equal tails.
    """
    n, m = (wins + losses).cast("double"), F.least(wins, losses).cast("int")
    zero = F.struct((n * F.log(F.lit(0.5))).alias("log_p"), F.lit(0.0).alias("tail"))
    steps = F.sequence(F.lit(0), m)

    def add(acc: Column, k: Column) -> Column:
        here = F.when(k == 0, acc["log_p"]).otherwise(acc["log_p"] + F.log((n - k + 1) / F.greatest(k, F.lit(1))))
        return F.struct(here.alias("log_p"), (acc["tail"] + F.exp(here)).alias("tail"))

    tail = F.aggregate(steps, zero, add, lambda acc: acc["tail"])
    return F.when((wins + losses == 0) | (wins == losses), F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def compare_strategies(metrics: DataFrame, baseline: str, shown=REPORTED, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """Every strategy against the baseline, metric by metric."""
    differences = paired_differences(metrics, baseline, shown)
    counted = differences.groupBy(*PAIR).agg(
        F.max("n").alias("n"),
        F.avg("value").alias("treatment_mean"),
        F.avg("baseline_value").alias("baseline_mean"),
        F.avg("difference").alias("difference"),
        F.count_if(F.col("difference") > 0).alias("wins"),
        F.count_if(F.col("difference") < 0).alias("losses"),
        F.count_if(F.col("difference") == 0).alias("ties"),
    )
    tested = counted.withColumn("p_sign", sign_test(F.col("wins"), F.col("losses")))
    return (
        tested.join(paired_bootstrap(differences, resamples, seed), PAIR)
        .withColumn("baseline", F.lit(baseline))
        .withColumn("significant", F.col("p_bootstrap") < 0.05)
    )
