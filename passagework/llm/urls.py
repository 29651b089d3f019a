"""URL filters: host rules, and a tree of path templates judged by labelled purity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or above it and whose path begins the url's, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _templates(shapes: DataFrame, support: int, z: float) -> DataFrame:
    """(host, shape, template): the tree is walked from the root, a level at a time, over distinct shapes.

    A branch stays by name if it has `support` pages and its labelled purity differs from its siblings' by a test of
    two proportions; rare branches are variable, and branches like the rest say nothing of their own: both become `*`.
    The walk ends where no host has `support` pages with a further segment, for no branch below can have its own name.
    """
    rows = shapes.withColumn("segments", F.filter(F.split("shape", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    below = Window.partitionBy("host").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    lengths = rows.groupBy("host", F.size("segments").alias("length")).agg(F.sum("pages").alias("n")).withColumn("reach", F.sum("n").over(below))
    depth = lengths.filter(F.col("reach") >= support).agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    for level in range(depth):
        branch = F.get("segments", F.lit(level))
        rows = rows.withColumn("branch", branch)
        named = rows.filter("branch is not null").groupBy("host", "template", "branch").agg(*[F.sum(c).alias(c) for c in ("pages", "judged", "good")])
        whole = named.groupBy("host", "template").agg(F.sum("judged").alias("all_judged"), F.sum("good").alias("all_good"))
        both = named.join(whole, ["host", "template"])
        rest, rest_good = F.col("all_judged") - F.col("judged"), F.col("all_good") - F.col("good")
        p = F.col("all_good") / F.col("all_judged")
        apart = F.col("good") / F.col("judged") - rest_good / rest
        differs = (F.col("judged") > 0) & (rest > 0) & (apart * apart > F.lit(z * z) * p * (1 - p) * (F.lit(1.0) / F.col("judged") + F.lit(1.0) / rest))
        # Division by zero is null under `try`, so the guards above decide.
        kept = both.filter(F.col("pages") >= support).filter(F.coalesce(differs, F.lit(False))).select("host", "template", "branch", F.lit(True).alias("own"))
        name = F.when(F.col("branch").isNull(), "").when(F.col("own"), F.concat(F.lit("/"), F.col("branch"))).otherwise("/*")
        rows = rows.join(kept, ["host", "template", "branch"], "left").withColumn("template", F.concat("template", name)).drop("own")
        if level % 3 == 2:
            rows = cut(rows)
    deeper = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - depth, F.lit(0)))
    return rows.select("host", "shape", "pages", "judged", "good", F.concat("template", deeper).alias("template"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", *, rules: Sequence[tuple[str, str, str]] = RULES,
                support: int = 20, z: float = 1.96, prior: float = 20.0, least_purity: float = 0.5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    Runs of digits in a path become `#`; the distinct shapes of each host form its tree (`_templates`), which
    has no depth of its own. A page's label is the row of `labels` with its id (quality 1 is good). A template's purity is its
    share of good labelled pages, smoothed by `prior` pages of its host's purity, that again by the corpus's; below
    `least_purity` it is blocked. A rule, where one fits, decides instead; rules are a short list. Without any label
    everything is pure.

    Pages are combined to (host, shape) before any shuffle of theirs; a hot host is split by the adaptive join. Null urls
    and urls without `://` have empty host and path and form a template; null page ids have no label; rows that repeat
    an id are judged each. An empty table gives no rows.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn(
        "shape", F.regexp_replace("path", "[0-9]+", "#"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("quality").alias("quality"))
    shapes = rows.join(known, "page_id", "left").groupBy("host", "shape").agg(
        F.count("*").alias("pages"), F.count("quality").alias("judged"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"))
    placed = cut(_templates(cut(shapes), support, z))
    overall = placed.agg(F.coalesce(F.expr("try_divide(sum(good), sum(judged))"), F.lit(1.0))).scalar()
    hosts = placed.groupBy("host").agg(((F.sum("good") + F.lit(prior) * overall) / (F.sum("judged") + F.lit(prior))).alias("host_purity"))
    purity = (F.sum("good") + F.lit(prior) * F.first("host_purity")) / (F.sum("judged") + F.lit(prior))
    judged = placed.join(hosts, "host").groupBy("host", "template").agg(purity.alias("purity"))
    verdicts = placed.select("host", "shape", "template").join(judged, ["host", "template"])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return rows.join(verdicts, ["host", "shape"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
