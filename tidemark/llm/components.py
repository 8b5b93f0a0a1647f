"""Connected components of a graph given by its links, by alternating large-star and small-star steps.

Every step is an aggregation and a join on the same key. Its aggregated side is staged first: it is then either small
enough, by its files' size, to be broadcast, or both sides of the join are plain exchanges, which adaptive execution
splits where a hub holds many links. The number of rounds grows with the logarithm of the longest chain. Links and
nodes stay distributed; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stage


def _downhill(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()


def _print(links: DataFrame) -> tuple:
    return links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in ``links`` (a, b bigint) that isn't its own root."""
    now = stage(_downhill(links), "links")
    seen = _print(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "large-star")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = stage(_downhill(large), "links")
        least = stage(large.groupBy("hi").agg(F.min("lo").alias("m")), "small-star")
        small = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
        now = stage(_downhill(small.unionByName(least.select(F.col("hi").alias("a"), F.col("m").alias("b")))), "links")
        last, seen = seen, _print(now)
        if seen == last:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
