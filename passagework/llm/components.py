"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) from links (a, b) of whole numbers: the least node of each component, for every node but that one.

    Each round hangs larger neighbours on the least one, then smaller ones too, until nothing moves; rounds grow with the
    logarithm of the longest chain. Rounds are written to the shared folder. Only a count and a checksum reach the driver.
    """
    stars = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
