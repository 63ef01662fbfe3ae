"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of `edges` (a, b); root is the smallest node reachable. Each round is written to the shared folder; rounds grow with the logarithm of the longest path."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now, mark = materialise(pairs, "links"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).collect()[0]
        if not seen["n"] or seen == mark:
            break
        mark = seen
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        joined = large.join(small, large["hi"] == small["u"])
        links = joined.select("hi", F.col("m").alias("lo")).unionAll(joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        before, now = now, materialise(links.where("hi <> lo").distinct(), "links")
        discard(before)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
