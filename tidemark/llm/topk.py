"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into ``SEGMENTS`` = 4 segments of 16 bits, and each code is indexed under its value in each. Two
codes that differ in d bits differ in at most d // 4 bits in some segment: once a query has probed all values within
radius r in every segment, it has met every code within 4 r + 3 bits. The radii grow from 0, each round probing only the
values at exactly the new radius, until the query's kth verified distance is that near: nothing unseen can be nearer. At
radius 16 every code has been met, so it ends for queries with fewer neighbours too. Each probe carries its query's kth
distance of the round before, and meets only codes that are as near: the small first radii give a kth distance early,
and what the large ones meet is then a few candidates a query instead of a share of all codes.

Equal codes are one in the index, with the ``k + 1`` smallest ids that have them (one more than k, as a query doesn't
find itself): so a code that a third of all rows share costs no more than any other. Groups are cut down to that many
in every task before they are shuffled. The masks of a radius are a fixed number (1,820 for radius 4).

Codes of vectors are their signs: bit i is set if component i is above zero.

Defined results: rows with null vectors or null ids are neither found nor searched for; equal distances are ranked by
id; a row isn't its own neighbour, and rows that repeat an id are one row; with fewer than k others a query returns all
of them; vectors of more than 64 components are refused; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import stage

K = 10
SEGMENTS, WIDTH = 4, 16
BITS = SEGMENTS * WIDTH


def sign_code(vector: Column) -> Column:
    """64-bit code of a vector's signs, as a signed number."""
    bit = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = F.aggregate(F.transform(vector, bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) > 64, F.raise_error(F.lit("a code has 64 bits at most"))).when(vector.isNotNull(), code)


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).cast("int")


def _probes(queries: DataFrame, radius: int) -> DataFrame:
    """query, kth, segment, value: what is exactly ``radius`` bits from the query's segments."""
    # a constant that is folded once: not looked for anew for every query
    masks = F.split(F.lit(",".join(str(m) for m in range(1 << WIDTH) if m.bit_count() == radius)), ",").cast("array<int>")
    return _by_segment(queries, "query").withColumn("mask", F.explode(masks)).select("query", "kth", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))


def _by_segment(codes: DataFrame, name: str) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).alias("segment"), _segment(F.col(name), i).alias("value")) for i in range(SEGMENTS)])
    return codes.withColumn("s", F.explode(parts)).select(*codes.columns, "s.segment", "s.value")


def _met(probes: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """query, code, first, ids, distance of what the probes meet for the first time, each once, and that may still be
    among the query's nearest: what lies farther than its present ``kth`` distance can't, what lies as far still can.

    A pair that lies nearer in some segment was met in an earlier round; of the segments in which it lies ``radius``
    apart the first one counts. So no shuffle is needed to tell repeats.
    """
    apart = [F.bit_count(_segment(F.col("query"), i).bitwiseXOR(_segment(F.col("code"), i))) for i in range(SEGMENTS)]
    new = [F.when(F.col("p.segment") > i, apart[i] > radius).otherwise(apart[i] >= radius) for i in range(SEGMENTS)]
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
    same = (F.col("p.segment") == F.col("c.segment")) & (F.col("p.value") == F.col("c.value"))
    found = probes.alias("p").join(index.alias("c").hint("merge"), reduce(Column.__and__, new, same & (distance <= F.col("kth"))))
    return found.select("query", "code", "first", "ids", distance.cast("int").alias("distance"))


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest codes of each query by (distance, smallest id): they hold the k + 1 nearest ids."""
    order = Window.partitionBy("query").orderBy("distance", "first")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")


def search(rows: DataFrame, k: int = K, asks: Column | None = None) -> DataFrame:
    """query_id, rank, neighbour_id, distance for the rows of ``rows`` (id, code) for which ``asks`` is true (default: all)."""
    known = rows.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    unique = known.select("id", "code").distinct()
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    members = stage(unique.withColumn("n", nth).where(F.col("n") <= k + 1).drop("n"), "topk-members")
    codes = members.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("ids"))
    index = stage(_by_segment(codes, "code"), "topk-index")
    asking = stage(known.where(F.lit(True) if asks is None else asks).select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct(), "topk-queries")
    active = stage(asking.select("query", F.lit(BITS).alias("kth")).distinct(), "topk-active")
    best, done, total = None, [], codes.count()
    for radius in range(WIDTH + 1):
        met = _best(_met(_probes(active, radius), index, radius), k)
        best = stage(_best(met.unionByName(best.join(active.select("query"), "query", "left_semi")), k) if best is not None else met, "topk-best")
        order = Window.partitionBy("query").orderBy("distance", "first")
        kth = F.min(F.when(F.col("cum") > k, F.col("distance"))).alias("kth")
        enough = best.withColumn("cum", F.sum("ids").over(order)).groupBy("query").agg(kth, F.count("*").alias("met"))
        left = active.select("query").join(enough, "query", "left").select("query", F.coalesce("kth", F.lit(BITS)).alias("kth"), "met")
        covered = (F.col("kth") <= SEGMENTS * (radius + 1) - 1) | F.coalesce(F.col("met") >= total, F.lit(False)) | F.lit(radius == WIDTH)
        state = stage(left.select("query", "kth", covered.alias("covered")), "topk-state")
        done.append(best.join(state.where("covered").select("query"), "query", "left_semi"))
        active = state.where("NOT covered").drop("covered")
        if not total or not active.limit(1).count():
            break
    nearest = stage(reduce(DataFrame.unionByName, done), "topk-nearest")
    near = asking.join(nearest, "query").select("query_id", "code", "distance").join(members, "code").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
