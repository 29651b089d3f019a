"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import WORD, ranked, whole
from passagework.session import cut

#: Weights by place of the source, repeating.
WEIGHTS = (3, 1, 2)
#: For each weight, how it moves over training: (time, factor) knots joined by straight lines. Integrals are scaled to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def time_of(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The training time in [0, 1] by which a source has been asked for this share of its words.

    The schedule is integrated piece by piece; within a piece the demand is quadratic in time and is inverted in closed form.
    """
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in pairwise(schedule)]
    done, out = 0.0, None
    for (a, b), piece in zip(pairwise(schedule), area, strict=True):
        y = share * F.lit(sum(area)) - F.lit(done)
        slope = 2 * (b[1] - a[1]) / (b[0] - a[0])
        root = F.sqrt(F.greatest(F.lit(a[1] * a[1]) + F.lit(slope) * y, F.lit(0.0)))
        at = F.lit(a[0]) + F.lit(2.0) * y / (F.lit(a[1]) + root)
        out = F.when(y >= 0, at) if out is None else F.when(y >= 0, at).otherwise(out)
        done += piece
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, place, target) from rows (source, size).

    Resharing the excess of capped sources by weight, again and again, ends at one level: every target is
    min(cap * size, level * weight), and they sum to `share` of all words. Sources are sorted by cap * size / weight;
    running sums tell which are capped, and the level follows from the rest.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(sources, [F.col("source").asc_nulls_last()], {}, "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    level_of = F.col("most") / F.col("weight")
    weighed = cut(placed.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")))
    goal = weighed.agg(F.lit(float(share)) * F.sum("source_size")).scalar()
    all_weight = weighed.agg(F.sum("weight")).scalar()
    filled = ranked(weighed, [level_of, F.col("place")], {"full": F.col("most"), "passed": F.col("weight")})
    capped = F.col("full") + F.col("most") + level_of * (all_weight - F.col("passed") - F.col("weight")) < goal
    filled = cut(filled.withColumn("capped", capped))
    level = filled.agg((goal - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0))) / F.sum(F.when(~F.col("capped"), F.col("weight")))).scalar()
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.coalesce(F.least("most", level * F.col("weight")), F.col("most")))
    return filled.select("source", "source_size", "place", target.alias("target"))


def _dealt(docs: DataFrame, doc_id: str, source: str, text: str, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """The documents without texts, each with its place in its source (`at`), the words asked of the source, taken and copies."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(whole(text), F.lit(WORD)).cast("bigint").alias("size"), hashed.alias("hash"), F.xxhash64(whole(text)).alias("mark")))
    by_source = targets(sized, weights, share, cap)
    ordered = cut(ranked(sized, [F.col("source").asc_nulls_last(), "hash", F.col("doc_id"), F.col("size")], {"before": F.col("size")}))
    starts = ordered.groupBy("source").agg(F.min("before").alias("start")).withColumnRenamed("source", "s_source")
    goals = by_source.join(starts, F.col("source").eqNullSafe(F.col("s_source"))).select("s_source", "start", "source_size", "place", "target")
    rows = ordered.join(goals, F.col("source").eqNullSafe(F.col("s_source")))
    asked = F.round("target").cast("bigint")
    rounds = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("bigint")
    rows = rows.select("*", asked.alias("asked"), rounds.alias("rounds"), (F.col("before") - F.col("start")).alias("at"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("asked") - F.col("rounds") * F.col("source_size") - F.col("at"))).cast("bigint")
    rows = rows.withColumn("part", part).withColumn("taken", F.col("size") * F.col("rounds") + F.col("part"))
    copies = F.col("rounds") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("int"))


def _position(turn: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    """When a document is due in this round of its source (0-based), in millionths of a millionth of training."""
    kind = F.pmod("place", F.lit(len(schedules)))
    due = (F.col("at") + turn * F.col("source_size")) / F.col("asked")
    return F.floor(F.coalesce(*[F.when(kind == i, time_of(due, s)) for i, s in enumerate(schedules)]) * F.lit(1e12))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *, weights: Sequence[int] = WEIGHTS,
        schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document, range-sorted by training position: doc_id, size, source_size, target, taken, copies, position.

    Within its source a document's place is the running sum of sizes in the order of a hash of its id. The mix takes as
    many whole rounds of the source as fit the target, then the documents up to the exact remainder, the last one in
    part; so the words taken of a source are its target, rounded. `copies` counts whole copies (the document cut by
    the remainder rounds to the nearer). `position` is the time its first copy is due, in millionths of a millionth
    of training; null where nothing is taken. Later copies follow a round of the source apart: see `mixed_documents`.

    Sizes are summed over a global range sort (source, hash), so a source with a third of all rows spreads over many
    tasks. Null text has size 0, null source is a source of its own and comes last, null ids share one hash (ties fall
    by size), rows that repeat an id are documents of their own. An empty table gives no rows; a source without words gets
    target 0.
    """
    rows = _dealt(docs, doc_id, source, text, weights, share, cap)
    position = F.when(F.col("taken") > 0, _position(F.lit(0), schedules))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", position.alias("position")).orderBy(
        F.col("position").asc_nulls_last(), F.col("doc_id"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *, weights: Sequence[int] = WEIGHTS,
                    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix as documents with all columns, whole, each as often as `copies` says, range-sorted by the training
    position of each copy; documents not taken go.

    The copy of round r is due when its source has been asked for r whole rounds and the words before the document. Each row gets
    the copies dealt to it: rows are met by id, source and a hash of the text. Rows that share all three (a row ingested
    several times, or copies without ids) are numbered, by one range sort on either side, and each takes the deal of its number.

    Null text has no words and is never taken, null source is a source of its own, null ids and repeated ids are documents of their
    own. Copies due at the same time follow by id. An empty table gives no rows; clashing extra columns pass through.
    """
    turns = F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1)
    due = F.when(F.col("copies") > 0, F.transform(turns, lambda r: _position(r, schedules)))
    deals = cut(_dealt(docs, doc_id, source, text, weights, share, cap).select(
        F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.col("mark").alias("d_mark"), due.alias("due")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("r_id"), F.col(source).alias("r_source"), F.xxhash64(whole(text)).alias("r_mark"))
    again = cut(deals.groupBy("d_id", "d_source", "d_mark").agg(F.count("*").alias("n")).filter("n > 1").select(
        F.col("d_id").alias("a_id"), F.col("d_source").alias("a_source"), F.col("d_mark").alias("a_mark")))

    def same(one: str, other: str) -> Column:
        return F.col(f"{one}_id").eqNullSafe(F.col(f"{other}_id")) & F.col(f"{one}_source").eqNullSafe(F.col(f"{other}_source")) & (F.col(f"{one}_mark") == F.col(f"{other}_mark"))

    def numbered(some: DataFrame, name: str) -> DataFrame:
        """Those that share all three, with their number among them."""
        key = [f"{name}_{c}" for c in ("source", "id", "mark")]
        sorted_rows = ranked(some.join(again, same(name, "a"), "left_semi"), [F.col(c) for c in key], {}, "place")
        first = sorted_rows.groupBy(*key).agg(F.min("place").alias("first")).toDF("a_source", "a_id", "a_mark", "first")
        return sorted_rows.join(first, same(name, "a")).withColumn(f"{name}_number", F.col("place") - F.col("first")).drop("place", "first", "a_id", "a_source", "a_mark")

    taken = F.col("due").isNotNull()
    if again.isEmpty():
        found = rows.join(deals.filter(taken), same("r", "d")).select("row", "due")
    else:
        once = deals.join(again, same("d", "a"), "left_anti")
        more = numbered(rows, "r").join(numbered(deals, "d").filter(taken), same("r", "d") & (F.col("r_number") == F.col("d_number")))
        found = rows.join(once.filter(taken), same("r", "d")).select("row", "due").unionByName(more.select("row", "due"))
    return found.select("row", F.explode("due").alias("at")).orderBy("at", F.col(f"row.`{doc_id}`")).select("row.*")
