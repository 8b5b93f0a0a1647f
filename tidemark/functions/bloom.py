"""Bloom summaries of keys: which bits a key sets, the shards they lie in, and probing them.

A shard holds at most SHARD_KEYS keys at BITS_PER_KEY bits. A group (tag and address) with more than ``heavy`` keys
keeps only a marker in its address's shard; its keys go to spill shards, chosen by the key's own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import BITS_PER_KEY, HASHES, HEAVY_GROUP, SHARD_KEYS, _masked, group_of
from tidemark.functions.shipping import ship
from tidemark.plans.store import stage

ship(__name__)

#: Shares of a shard's probes, each of which gets the shard's bits.
SALTS = 8
BITS = SHARD_KEYS * BITS_PER_KEY
MARKER = "FF"


def bits_of(items: list[bytes], total: int = BITS) -> np.ndarray:
    """One row of HASHES bit numbers for each item, by double hashing modulo 2**64."""
    digests = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:16] for x in items), ">u8").reshape(-1, 2).astype(np.uint64)
    first, step = digests[:, :1], digests[:, 1:] | np.uint64(1)
    return (first + np.arange(HASHES, dtype=np.uint64)[None, :] * step) % np.uint64(total)


def _filled(groups: pd.DataFrame, total: int) -> bytes:
    bits = np.zeros(total, bool)
    bits[bits_of([bytes(x) for x in groups["item"]], total).astype(np.int64).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def summary_items(keys: DataFrame, shards: int, heavy: int = HEAVY_GROUP) -> DataFrame:
    """kind (a or s), shard, item for the distinct ``key`` of a run."""
    shard = lambda c, at: _masked(F.sha2(c, 256), at, F.lit(shards))
    unique = keys.select("key").distinct().withColumn("grp", group_of(F.col("key")))
    sizes = unique.groupBy("grp").agg((F.count("*") > heavy).alias("is_heavy"))
    route = shard(F.substring("grp", 2, 20), 0)
    light = unique.join(sizes.where("NOT is_heavy"), "grp").select(F.lit("a").alias("kind"), route.alias("shard"), F.col("key").alias("item"))
    marks = sizes.where("is_heavy").select(F.lit("a").alias("kind"), route.alias("shard"), F.concat(F.unhex(F.lit(MARKER)), "grp").alias("item"))
    spilled = unique.join(sizes.where("is_heavy"), "grp").select(F.lit("s").alias("kind"), shard(F.col("key"), 16).alias("shard"), F.col("key").alias("item"))
    return light.unionByName(marks).unionByName(spilled)


def build_summary(keys: DataFrame, shards: int, heavy: int = HEAVY_GROUP, total: int = BITS) -> DataFrame:
    """kind, shard, bits: one row a shard that holds anything. A shard's items are bounded by its sizing."""

    def build(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": [key[0]], "shard": [key[1]], "bits": [_filled(items, total)]})

    return summary_items(keys, shards, heavy).groupBy("kind", "shard").applyInPandas(build, "kind string, shard long, bits binary")


def _probed(probes: DataFrame, summary: DataFrame, items: dict[str, Callable[[bytes], bytes]], total: int) -> DataFrame:
    """``probes`` (key, shard, others) with a boolean for each of ``items``, by the bits of the key's shard.

    A shard's bits travel once for each of ``SALTS`` shares of its probes, not once a probe, and come before them in the
    order of a partition: a task holds one shard's bits and one batch, however many probes a shard has.
    """
    own = [f for f in probes.schema if f.name != "shard"]
    salted = probes.withColumns({"_salt": F.pmod(F.hash("key"), F.lit(SALTS)), "_bits": F.lit(None).cast("binary")})
    sent = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("shard", "_salt", F.col("bits").alias("_bits"))
    rows = sent.unionByName(salted, allowMissingColumns=True).repartition("shard", "_salt").sortWithinPartitions("shard", "_salt", F.col("_bits").isNull())

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, bits = None, None
        for batch in batches:
            for (shard, salt), group in batch.groupby(["shard", "_salt"], sort=False):
                if (shard, salt) != at:
                    at, bits = (shard, salt), None
                known = group["_bits"].notna()
                if known.any():
                    bits = np.frombuffer(bytes(group.loc[known, "_bits"].iloc[0]), np.uint8)
                asked = group[~known]
                if len(asked):
                    keys, out = [bytes(k) for k in asked["key"]], asked[[f.name for f in own]]
                    for name, item in items.items():
                        places = bits_of([item(k) for k in keys], total).astype(np.int64)
                        out = out.assign(**{name: np.zeros(len(keys), bool) if bits is None else (bits[places >> 3] >> (places & 7) & 1).all(axis=1)})
                    yield out

    return rows.mapInPandas(probe, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + "".join(f", {n} boolean" for n in items))


def may_contain(probes: DataFrame, summary: DataFrame, shards: int, total: int = BITS) -> DataFrame:
    """``probes`` (with a key) with a boolean ``may_contain``: false only for keys that the run doesn't hold.

    Probes go to their address's shard, and only those of a heavy group on to their spill shard.
    """
    shard = lambda c, at: _masked(F.sha2(c, 256), at, F.lit(shards))
    summary = stage(summary, "bloom-summary")  # both kinds are read, and it is built once
    of = lambda kind: summary.where(F.col("kind") == kind).drop("kind")
    marker = bytes.fromhex(MARKER)
    first = probes.withColumn("shard", shard(F.substring(group_of(F.col("key")), 2, 20), 0))
    first = stage(_probed(first, of("a"), {"_light": lambda k: k, "_heavy": lambda k: marker + k[:21]}, total), "bloom-probes")
    known = first.where("_light OR NOT _heavy").select(*probes.columns, F.col("_light").alias("may_contain"))
    spilled = first.where("_heavy AND NOT _light").select(*probes.columns, shard(F.col("key"), 16).alias("shard"))
    return known.unionByName(_probed(spilled, of("s"), {"may_contain": lambda k: k}, total))


def bit_numbers(key: Column, total: int = BITS) -> Column:
    """The bits of a key as built-in expressions, for use where a summary isn't built: array of HASHES numbers."""
    digest, wide = F.sha2(key, 256), "decimal(38,0)"
    part = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast(wide)
    first, second = part(1), part(17)
    step = second + F.when(second % 2 == 0, F.lit(1)).otherwise(F.lit(0)).cast(wide)
    modulus = F.lit("18446744073709551616").cast(wide)
    return F.array(*[(((first + step.cast("decimal(20,0)") * F.lit(i).cast("decimal(2,0)")) % modulus) % F.lit(total).cast(wide)).cast("long") for i in range(HASHES)])
