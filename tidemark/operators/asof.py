"""As-of joins: for each probe (key, block) the newest version of the key at or before the block.

Payloads travel in a struct, so that a version whose values are null or zero is still a version: what a probe gets is
null only where no version is old enough.

Strategies:

- ``window``: versions and probes are sorted together by (key, block) and the last version seen is carried forward.
  One exchange, linear in both sides, spills.
- ``bucketed``: the same within (key, range of blocks), after the newest version before each range has been found by a
  map-side aggregation. A key with a third of all versions or probes so spreads over as many tasks as it has ranges.
- ``equi``: join each distinct (key, block) asked for on the key and take the newest match by aggregation; for few blocks
  a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def as_of_join(probes: DataFrame, versions: DataFrame, on: list[str], strategy: str = "bucketed", probe_block: str = "block", version_block: str = "block", bucket: int = BUCKET, name: str = "version") -> DataFrame:
    """``probes`` with a struct column ``name`` of the version's columns besides ``on``."""
    payload = F.struct(*[F.col(c) for c in versions.columns if c not in on])
    side = versions.select(*on, F.col(version_block).alias("_at"), payload.alias("_version"))
    own = F.struct(*[F.col(c) for c in probes.columns])
    if strategy == "equi":
        wanted = probes.select(*on, probe_block).distinct()
        met = wanted.join(side, on).where(F.col("_at") <= F.col(probe_block)).groupBy(*on, probe_block).agg(F.max_by("_version", "_at").alias(name))
        return probes.join(met, [*on, probe_block], "left").select(*probes.columns, name)
    asked = probes.select(*on, F.col(probe_block).alias("_at"), F.lit(None).cast(side.schema["_version"].dataType).alias("_version"), own.alias("_own"))
    known = side.withColumn("_own", F.lit(None).cast(asked.schema["_own"].dataType))
    if strategy == "window":
        return _carried(asked.unionByName(known), on, name, probes)
    if strategy != "bucketed":
        raise ValueError(f"no as-of strategy {strategy!r}")
    ranged = lambda df: df.withColumn("_range", F.floor(F.col("_at") / bucket))
    # what each range of a key leaves behind, and so what every later range that is asked about begins with
    left = ranged(side).groupBy(*on, "_range").agg(F.max_by("_version", "_at").alias("_last"))
    wanted = ranged(asked).select(*on, "_range").distinct().withColumn("_last", F.lit(None).cast(left.schema["_last"].dataType))
    before = Window.partitionBy(*on).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    steps = left.unionByName(wanted).groupBy(*on, "_range").agg(F.first("_last", ignorenulls=True).alias("_last"))
    starts = steps.withColumn("_version", F.last("_last", ignorenulls=True).over(before)).where(F.col("_version").isNotNull())
    starts = starts.select(*on, "_range", F.lit(None).cast("long").alias("_at"), "_version", F.lit(None).cast(asked.schema["_own"].dataType).alias("_own"))
    rows = ranged(asked).unionByName(ranged(known)).unionByName(starts.withColumn("_at", F.col("_range") * bucket - 1), allowMissingColumns=True)
    return _carried(rows, [*on, "_range"], name, probes)


def _carried(rows: DataFrame, keys: list[str], name: str, probes: DataFrame) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("_at"), F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn(name, F.last("_version", ignorenulls=True).over(order)).where(F.col("_own").isNotNull())
    return out.select(*[F.col(f"_own.{c}").alias(c) for c in probes.columns], name)


def snapshot_at(versions: DataFrame, on: list[str], block: int) -> DataFrame:
    """Newest version of every key at ``block``: one aggregation, combined in every task first."""
    rest = F.struct(*[F.col(c) for c in versions.columns if c not in on])
    newest = versions.where(F.col("block") <= block).groupBy(*on).agg(F.max_by(rest, "block").alias("_v"))
    return newest.select(*on, "_v.*")
