"""Incarnations: which life of an account a version belongs to.

Versions of a key are windowed within ranges of its order, and ranges, of which there are few, are windowed over the
whole key: a key with a third of all versions so spreads over as many tasks as it has ranges. What a range's first
version does depends on how the range before ended, so that version's step is added with what the range begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks a range.
RANGE = 4096


def _counted(rows: DataFrame, new: Column, gone: Column, live: Column, key: str, order: str, totals: dict[str, str]) -> DataFrame:
    """``rows`` with ``incarnation``, the running count of steps, ``_before``, whether the key existed before, and running
    ``totals`` (name: column). A step is ``new`` at a key's first version, ``gone`` or ``live`` after one that left it so."""
    step = lambda before: F.when(before.isNull(), F.col("_new")).when(before, F.col("_live")).otherwise(F.col("_gone"))
    within, keys = Window.partitionBy(key, "_range").orderBy(order), Window.partitionBy(key).orderBy("_range")
    so_far, earlier = within.rowsBetween(Window.unboundedPreceding, 0), keys.rowsBetween(Window.unboundedPreceding, -1)
    sums = {"incarnation": "_step", **totals}

    ranged = rows.withColumns({"_range": F.expr(f"{order} div {RANGE}"), "_new": new, "_gone": gone, "_live": live})
    ranged = ranged.withColumns({"_first": F.row_number().over(within) == 1, "_before": F.lag("exists").over(within)})
    ranged = ranged.withColumn("_step", F.when(F.col("_first"), 0).otherwise(step(F.col("_before"))))

    firsts = [F.min_by(c, order).alias(c) for c in ("_new", "_gone", "_live")]
    ends = ranged.groupBy(key, "_range").agg(F.max_by("exists", order).alias("_last"), *firsts, *[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    starts = ends.withColumn("_prior", F.lag("_last").over(keys)).withColumn("_first_step", step(F.col("_prior")))
    starts = starts.withColumn("_of_incarnation", F.col("_of_incarnation") + F.col("_first_step"))
    begins = {f"_at_{n}": F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)) for n in sums}
    starts = starts.withColumns(begins).withColumn("_at_incarnation", F.col("_at_incarnation") + F.col("_first_step"))
    starts = starts.select(F.col(key).alias("_key"), F.col("_range").alias("_nth"), "_prior", *begins)

    local = ranged.withColumns({f"_in_{n}": F.sum(c).over(so_far) for n, c in sums.items()})
    out = local.join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_range").eqNullSafe(F.col("_nth")))
    out = out.withColumns({n: (F.col(f"_at_{n}") + F.col(f"_in_{n}")).cast("long") for n in sums})
    before = F.when(F.col("_first"), F.col("_prior")).otherwise(F.col("_before")).alias("_before")
    return out.select(*rows.columns, *sums, before)


def incarnations(versions: DataFrame, wiped: Column, key: str = "address", order: str = "block", totals: dict[str, str] | None = None) -> DataFrame:
    """``versions`` (with ``exists``) and their incarnation: a running count, per key, of new lives.

    A new life begins where an account exists that had a version but didn't exist before, or that existed and was
    wiped. ``totals`` are running sums (name: column) added in the same pass.
    """
    begins = lambda c: F.when(c, 1).otherwise(0)
    return _counted(versions, F.lit(0), begins(F.col("exists")), begins(F.col("exists") & wiped), key, order, totals or {}).drop("_before")


def incarnations_of_flags(updates: DataFrame, key: str = "address", order: str = "block") -> DataFrame:
    """Incarnations from a replay's own flags (previous_exists, exists, wiped), from zero.

    An account's first update stays in life zero unless it existed and was wiped. ``consistent`` is false where an
    update's previous_exists isn't what the update before it left.
    """
    reborn = F.when(F.col("exists"), 1).otherwise(0)
    cleared = F.when(F.col("exists") & F.col("previous_exists") & F.col("wiped"), 1).otherwise(0)
    out = _counted(updates, cleared, reborn + cleared, cleared, key, order, {})
    return out.withColumn("consistent", F.coalesce(F.col("_before") == F.col("previous_exists"), F.lit(True))).drop("_before")
