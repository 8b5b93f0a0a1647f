"""What cold reads cost, by a model of the layout: object reads of an account lookup, and their quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reads: the head once, a summary for each run looked at, and root, fence and page in the run that has the version.
HEAD, SUMMARY, IN_RUN = 1, 1, 3
LIMIT = 192


def account_reads(runs: list[tuple[int, int]]) -> Column:
    """Object reads for a probe with columns block and found (the version's block, or null), over runs (first, last block)."""
    starts = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in runs])
    seen = F.filter(starts, lambda r: (r["first"] <= F.col("block")) & (F.col("found").isNull() | (r["last"] >= F.col("found"))))
    return (HEAD + SUMMARY * F.size(seen) + F.when(F.col("found").isNull(), 0).otherwise(IN_RUN)).cast("long")


def storage_reads(runs: list[tuple[int, int]]) -> Column:
    """Object reads of an account and then a slot of it: as ``account_reads``, with columns asked (whether there is an
    account to look a slot up for) and slot_found (the block of the slot's version, or null).

    An address's summary serves its account and its slots, so those already read cost nothing again; what is read for the
    slot beyond them are the summaries of older runs and what leads to the slot's page, from whose run the root is known
    if it is the account's.
    """
    listed = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in runs])
    looked = lambda found: F.size(F.filter(listed, lambda r: (r["first"] <= F.col("block")) & (F.col(found).isNull() | (r["last"] >= F.col(found)))))
    holding = lambda found: F.filter(listed, lambda r: (r["first"] <= F.col(found)) & (r["last"] >= F.col(found)))
    slot = F.greatest(looked("slot_found") - looked("found"), F.lit(0)) * SUMMARY
    in_run = F.when(F.col("slot_found").isNull(), 0).when(holding("slot_found") == holding("found"), IN_RUN - 1).otherwise(IN_RUN)
    return (account_reads(runs) + F.when(F.col("asked"), slot + in_run).otherwise(0)).cast("long")


def quantiles(costs: DataFrame, column: str = "gets") -> DataFrame:
    """samples, most, p50 and p99 by nearest rank."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})").cast("long")
    return costs.agg(F.count("*").alias("samples"), F.max(column).cast("long").alias("most"), at(0.5).alias("p50"), at(0.99).alias("p99"))


def admitted(costs: DataFrame, limit: int = LIMIT, column: str = "gets") -> DataFrame:
    """``costs`` with ``within_budget``: admission control on planned reads."""
    return costs.withColumn("within_budget", F.col(column) <= limit)
