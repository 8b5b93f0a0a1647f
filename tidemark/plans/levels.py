"""Layout arithmetic: which runs a fully compacted archive consists of, and what they cost to read.

New epochs are runs of weight 1 in a buffer of four; full buffers carry into levels whose units are 4 * 8**level, as
digits carry in base 8. After E epochs the buffer so holds E mod 4 runs, and level i one run of weight unit(i) times
the ith base-8 digit of E div 4, if that isn't zero. Runs cover the epochs from the highest level, oldest, down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUFFER, FAN, LEVELS, BACKLOG = 4, 8, 8, 16


def unit(level: int) -> int:
    return BUFFER * FAN**level


def weights(epochs: int) -> dict[int, int]:
    """Weight of the run on each level, after ``epochs`` epochs with everything carried."""
    full = epochs // BUFFER
    return {i: unit(i) * d for i in range(LEVELS) if (d := full // FAN**i % FAN)}


def layout(epochs: DataFrame) -> DataFrame:
    """epochs, slot, weight, first, last for each number in ``epochs``; slot -1 stands for the buffer's runs."""
    digit = lambda i: F.expr(f"(epochs div {BUFFER} div {FAN**i}) % {FAN}") * unit(i)
    levels = [F.struct(F.lit(i).alias("slot"), digit(i).cast("long").alias("weight"), F.lit(0).cast("long").alias("nth")) for i in range(LEVELS)]
    buffered = F.transform(F.sequence(F.lit(1), F.lit(BUFFER - 1)), lambda n: F.struct(F.lit(-1).alias("slot"), F.when(n <= F.col("epochs") % BUFFER, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("weight"), n.cast("long").alias("nth")))
    held = F.filter(F.concat(F.array(*reversed(levels)), buffered), lambda r: r["weight"] > 0)
    runs = epochs.withColumn("_runs", held).select("epochs", "_runs", F.posexplode("_runs").alias("at", "run"))
    first = F.aggregate(F.slice("_runs", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda total, r: total + r["weight"])
    return runs.select("epochs", "run.slot", "run.weight", first.alias("first"), (first + F.col("run.weight") - 1).alias("last"))


def runs_to_probe(block: Column, blocks_per_epoch: int) -> Column:
    """Whether a run may hold a version at or before ``block``."""
    return F.col("first") * blocks_per_epoch <= block
