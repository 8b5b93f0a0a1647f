"""Garbage collection: listed objects that no kept head reaches and that are old enough to be sure of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sweep(listed: DataFrame, live: DataFrame, old: Column) -> DataFrame:
    """``listed`` (key, size, ...) with state: live, young (unreachable, but perhaps of a commit under way) or doomed."""
    marked = listed.join(live.select("key", F.lit(True).alias("_live")).distinct(), "key", "left")
    return marked.withColumn("state", F.when(F.col("_live"), "live").when(old, "doomed").otherwise("young")).drop("_live")


def report(swept: DataFrame) -> DataFrame:
    n = lambda state: F.count(F.when(F.col("state") == state, 1))
    bytes_gone = F.coalesce(F.sum(F.when(F.col("state") == "doomed", F.col("size"))), F.lit(0)).cast("long")
    return swept.agg(n("live").alias("live"), n("doomed").alias("deleted"), bytes_gone.alias("deleted_bytes"), n("young").alias("kept_young"))
