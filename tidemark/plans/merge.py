"""Merging runs: all versions of all inputs, each once, in key order within hash partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateVersion(ValueError):
    """Two runs hold the same key at the same block."""


def merge_runs(runs: list[DataFrame], keys: list[str], partitions: int | None = None) -> DataFrame:
    """Union of the runs, hash-partitioned and sorted by (keys, block): one exchange and one sort with spilling.

    Nothing is dropped, tombstones and zeros included. Empty partitions and salting aren't needed: the hash takes key
    and range of blocks, so a hot key's versions spread, while each (key, block) has one place.
    """
    rows = reduce(DataFrame.unionByName, runs)
    by = [*keys, F.floor(F.col("block") / 4096)]
    dealt = rows.repartition(partitions, *by) if partitions else rows.repartition(*by)
    return dealt.sortWithinPartitions(*keys, "block")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, "block").agg(F.count("*").alias("n")).where("n > 1")
