"""Ordered operators that survive one huge group.

A window over a document (or user, or session) puts the whole group into one task. These
helpers cut each group into stretches of its integer order column first: the window runs
inside a stretch, and one small row per stretch carries counts, sums or last values across.
The order column must be unique within a group and at most `width` rows share a stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import cut

WIDTH = 8192
_STRETCH = "__stretch"


def carried(df: DataFrame, keys: Sequence[str], order: str, *, last: dict[str, Column] | None = None,
            last_before: dict[str, Column] | None = None, sums: dict[str, Column] | None = None,
            sums_before: dict[str, Column] | None = None, totals: dict[str, Column] | None = None,
            width: int = WIDTH) -> DataFrame:
    """Adds running columns in group order, in one pass.

    Keys and order must not be null. `last` and `last_before` give an expression's latest non-null value, with or without the
    row itself; `sums` and `sums_before` its running sum; `totals` its sum over the group.
    """
    latest = {**(last or {}), **(last_before or {})}
    added = {**(sums or {}), **(sums_before or {})}
    inputs = {**latest, **added, **(totals or {})}
    # Integer division: exact for any bigint.
    stretch = F.expr(f"cast(`{order}` as bigint) div {width}L").alias(_STRETCH)
    rows = df.select("*", stretch,
                    *[e.alias(f"__v_{n}") for n, e in inputs.items()])
    ends = rows.groupBy(*keys, _STRETCH).agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__e_{n}") for n in latest],
        *[F.sum(f"__v_{n}").alias(f"__e_{n}") for n in (*added, *(totals or {}))],
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy(_STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *[F.col(k).alias(f"__k_{k}") for k in (*keys, _STRETCH)],
        *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in latest],
        *[F.coalesce(F.sum(f"__e_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in added],
        *[F.sum(f"__e_{n}").over(group).alias(f"__c_{n}") for n in totals or {}],
    )
    inside = Window.partitionBy(*keys, _STRETCH).orderBy(order)
    upto = {n: inside.rowsBetween(Window.unboundedPreceding, -1 if n in {**(last_before or {}), **(sums_before or {})} else 0) for n in inputs}
    rows = rows.select(
        "*",
        *[F.last(f"__v_{n}", ignorenulls=True).over(upto[n]).alias(f"__l_{n}") for n in latest],
        *[F.coalesce(F.sum(f"__v_{n}").over(upto[n]), F.lit(0)).alias(f"__l_{n}") for n in added],
    )
    # Plain equality on the very columns of the window: the rows are shuffled and sorted once.
    same = F.lit(True)
    for k in (*keys, _STRETCH):
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    joined = rows.join(ends, same, "left")
    kept = [c for c in df.columns if c not in inputs]
    return joined.select(
        *kept,
        *[F.coalesce(f"__l_{n}", f"__c_{n}").alias(n) for n in latest],
        *[(F.col(f"__c_{n}") + F.col(f"__l_{n}")).alias(n) for n in added],
        *[F.col(f"__c_{n}").alias(n) for n in totals or {}],
    )


def with_position(df: DataFrame, keys: Sequence[str], order: str, out: str = "position",
                  total: str | None = None, width: int = WIDTH) -> DataFrame:
    """0-based position of each row within its group, and optionally the group's size."""
    one = F.lit(1).cast("bigint")
    return carried(df, keys, order, sums_before={out: one}, totals={total: one} if total else None, width=width)


def numbered(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """0-based position of each row in a sorted order of the whole frame; ties fall either way.

    Rows are range-sorted and written; one row per sorted partition carries the counts across.
    """
    rows = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    # One row per sorted partition.
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(upto), F.lit(0)).alias("__before"))
    return rows.join(before, part == F.col("__part")).select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).alias(out))


#: Parts of a histogram, and distinct values that are sorted as one list.
PARTS, LISTED = 256, 1024


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, float], listed: int = LISTED) -> DataFrame:
    """Nearest-rank percentiles per group, nulls left out; values are numbers.

    Rows are first folded to (group, value, count) with map-side combine. While more than `listed` distinct values may be the one
    at a rank, they are counted in equal parts between the least and the greatest, and only the part that holds the rank goes
    on; so each round leaves a small share, and no task ever sorts a group's values.
    """
    key = [f"__k{i}" for i in range(len(keys))]
    counts = cut(df.filter(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(a) for k, a in zip(keys, key, strict=True)], F.col(value).alias("__v")).agg(F.count("*").alias("__n")))
    sizes = counts.groupBy(*key).agg(F.sum("__n").alias("all"), F.count("*").alias("distinct"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in picks.items()]))
    state = sizes.withColumn("ask", asked).select(
        *[F.col(k).alias(f"s{k}") for k in key], F.col("ask.name").alias("name"), F.greatest(F.ceil(F.col("all") * F.col("ask.p")), F.lit(1)).cast("bigint").alias("rank"), "distinct", "low", "high")
    state = cut(state)
    mine = [f"s{k}" for k in key]

    def inside(of: DataFrame) -> DataFrame:
        same = (F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high"))
        for k, m in zip(key, mine, strict=True):
            same = same & F.col(k).eqNullSafe(F.col(m))
        return counts.join(of, same).drop(*key)

    while not (wide := state.filter(F.col("distinct") > listed)).isEmpty():
        share = (F.col("__v") - F.col("low")) / (F.col("high") - F.col("low"))
        part = F.when(F.col("__v") == F.col("low"), 0).when(F.col("__v") == F.col("high"), PARTS - 1).otherwise(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int"))
        parts = inside(wide).groupBy(*mine, "name", "rank", part.alias("part")).agg(
            F.sum("__n").alias("n"), F.count("*").alias("distinct"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        # At most PARTS rows an asked percentile.
        upto = F.sum("n").over(Window.partitionBy(*mine, "name").orderBy("part"))
        found = parts.withColumn("before", upto - F.col("n")).filter((F.col("before") < F.col("rank")) & (F.col("before") + F.col("n") >= F.col("rank")))
        state = cut(state.filter(F.col("distinct") <= listed).unionByName(
            found.select(*mine, "name", (F.col("rank") - F.col("before")).alias("rank"), "distinct", "low", "high")))
    step = lambda a, x: F.when(a["left"] <= 0, a).otherwise(F.struct((a["left"] - x["__n"]).alias("left"), x["__v"].alias("at")))
    kind = counts.schema["__v"].dataType
    at = F.aggregate(F.array_sort(F.collect_list(F.struct("__v", "__n"))), F.struct(F.col("rank").alias("left"), F.lit(None).cast(kind).alias("at")), step, lambda a: a["at"])
    chosen = inside(state).groupBy(*mine, "name", "rank").agg(at.alias("at"))
    return chosen.groupBy(*[F.col(m).alias(k) for m, k in zip(mine, keys, strict=True)]).agg(
        *[F.max(F.when(F.col("name") == name, F.col("at"))).alias(name) for name in picks])


def upper_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The value at position n // 2 of the sorted group (the upper one of two middles)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("__upto", F.sum("__n").over(w.orderBy(value))).withColumn("__all", F.sum("__n").over(w))
    half = F.floor(F.col("__all") / 2)
    return ranked.groupBy(*keys).agg(F.min(F.when(F.col("__upto") > half, F.col(value))).alias(out))
