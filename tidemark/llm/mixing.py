"""Mixing sources to target weights, by repetition rates and hash-seeded Bernoulli copies. DataFrame operations only.

A source's target is its weight's share of all words, but never over ``cap`` times what it has; what that leaves
over goes to the others by weight until nobody is above. A document is emitted ``floor(rate)`` times, plus once more
with probability ``rate - floor(rate)``, where ``rate = target / source size``. Its draw is a hash of its doc_id, so
reruns agree. Of ``8 * BLOCKS`` independent seeds each source uses the one that brings it nearest to its target;
the sums for all seeds come from the same aggregation, so this costs no further pass.

Defined results: null text has size 0 (and any number of copies of it 0 words); a null source is a source of its
own, sorted last; rows with the same doc_id and source get the same number of copies; an empty table gives no rows;
columns besides doc_id, source and the text are carried along, except that mixing's own columns replace any of the
same names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import packed, stage, unpacked, words

BLOCKS = 4
WEIGHTS = (5, 2, 1)
CAP = 3
PLAN = ("source_size", "target", "rate", "seed")


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def _draws() -> list[Column]:
    """One number below 2**32 for each seed: eight from each SHA-256 of the block's number and the doc_id."""
    draws = []
    for block in range(BLOCKS):
        digest = F.sha2(F.concat(F.lit(f"mix:{block}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
        draws += [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") for i in range(8)]
    return draws


def _copies(draw: Column) -> Column:
    whole = F.floor("rate")
    return (whole + (draw < (F.col("rate") - whole) * F.lit(4294967296.0)).cast("long")).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """0-based rank by code point, null last, without bringing all sources into one task."""
    order = F.col("source").asc_nulls_last()
    parts = stage(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return parts.withColumn("n", within).join(starts, "part").withColumn("rank", F.col("start") + F.col("n") - 1).drop("part", "n", "start", "count")


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: source, source_size, target, rate, seed. ``sizes`` needs doc_id, source and size."""
    sizes = sizes.select("doc_id", "source", "size")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.col("rank") % len(weights)
    weight = F.coalesce(*[F.when(turn == i, F.lit(w)) for i, w in enumerate(weights)]).cast("long")
    sources = stage(_ranked(totals).withColumn("weight", weight), "mix-weights")

    wide = lambda c: F.col(c).cast("decimal(38,0)")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    left, weight_left, capped, before = total, None, F.lit(False), -1
    while True:  # the set at its cap only grows; each turn reads the sources once and brings three numbers
        held, weight_left, n = sources.agg(
            F.coalesce(F.sum(F.when(capped, wide("source_size") * cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
            F.count(F.when(capped, 1)),
        ).first()
        left = int(total - held)
        if n == before or not weight_left:
            break
        before = n
        capped = wide("source_size") * F.lit(cap * weight_left).cast("decimal(38,0)") < wide("weight") * F.lit(left).cast("decimal(38,0)")

    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(weight_left or 1))
    targets = sources.withColumn("target", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(share))
    targets = targets.withColumn("rate", F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size")))
    targets = stage(targets.select("source", "source_size", "target", "rate"), "mix-targets")

    drawn = sizes.join(targets.select(F.col("source").alias("s"), "rate"), F.col("source").eqNullSafe(F.col("s")))
    sums = drawn.groupBy("source").agg(*[F.sum(F.col("size") * _copies(d)).alias(f"t{i}") for i, d in enumerate(_draws())])
    off = [F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("off"), F.lit(i).alias("seed")) for i in range(8 * BLOCKS)]
    best = sums.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("seed", F.least(*off)["seed"])
    return stage(best.select("source", *PLAN), "mix-plan")


def mix(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """``sized`` with each row's source_size, target, rate, seed, copies and taken (words)."""
    own = sized.drop(*PLAN, "copies", "taken")
    given = sources.withColumnRenamed("source", "_mix_source")
    out = own.join(given, F.col("source").eqNullSafe(F.col("_mix_source"))).drop("_mix_source")
    draw = F.coalesce(*[F.when(F.col("seed") == i, d) for i, d in enumerate(_draws())])
    return out.withColumn("copies", _copies(draw)).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as the mix takes it."""
    used = ("doc_id", "source", "text")
    sized = with_size(packed(docs, *used))
    out = mix(sized, plan(sized, weights, cap))
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return unpacked(out, docs.columns, *used)
