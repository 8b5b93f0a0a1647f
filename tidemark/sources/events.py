"""A versioned account history from a table of events (event_id, user_id, event_type, value).

Ten events in a row make a block, a user is an address. An account has one version a block it was active in: its last
event there decides whether it exists (``error``: it doesn't), and a ``signup`` while it existed wipes its storage. Its
nonce counts its events, its balance adds up their absolute values in hundredths; both are zero on a tombstone. A live
version writes one storage slot for each event type of the block, ``view`` writing zero. An event type stands in for
code: its SHA-256 for the code hash, first seen in its first block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lifetime import incarnations

EVENTS_PER_BLOCK, BLOCKS_PER_EPOCH = 10, 10
SLOTS = ("click", "error", "purchase", "signup", "view")


def load(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocked(events: DataFrame) -> DataFrame:
    """event_id, block, address, event_type, cents."""
    cents = F.floor(F.abs(F.coalesce("value", F.lit(0.0))) * 100).cast("long")
    return events.select("event_id", F.expr(f"event_id div {EVENTS_PER_BLOCK}").alias("block"), F.col("user_id").alias("address"), "event_type", cents.alias("cents"))


def changes(events: DataFrame) -> DataFrame:
    """One row an (address, block): last event type, whether the account exists after it, and what it adds."""
    last = F.max_by("event_type", "event_id").alias("last_type")
    rows = blocked(events).groupBy("address", "block").agg(last, F.count("*").alias("n"), F.sum("cents").alias("cents"))
    return rows.withColumn("exists", F.col("last_type") != "error")


def account_versions(events: DataFrame) -> DataFrame:
    """address, block, exists, incarnation, nonce, balance, code_hash."""
    rows = incarnations(changes(events), wiped=F.col("last_type") == "signup", totals={"events": "n", "spent": "cents"})
    live = lambda c: F.when(F.col("exists"), c).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "address", "block", "exists", "incarnation", live(F.col("events")).alias("nonce"), live(F.col("spent")).alias("balance"),
        F.when(F.col("exists"), F.sha2("last_type", 256)).alias("code_hash"),
    )


def storage_versions(events: DataFrame) -> DataFrame:
    """address, incarnation, slot, block, value."""
    cents = F.when(F.col("event_type") == "view", F.lit(0)).otherwise(F.max_by("cents", "event_id")).cast("long")
    slots = blocked(events).groupBy("address", "block", "event_type").agg(cents.alias("value"))
    live = account_versions(events).where("exists").select("address", "block", "incarnation")
    return slots.join(live, ["address", "block"]).select("address", "incarnation", F.col("event_type").alias("slot"), "block", "value")


def code_blobs(events: DataFrame) -> DataFrame:
    """code_hash, first_seen_block, code."""
    firsts = blocked(events).groupBy("event_type").agg(F.min("block").alias("first_seen_block"))
    return firsts.select(F.sha2("event_type", 256).alias("code_hash"), "first_seen_block", F.col("event_type").alias("code"))


def head_block(events: DataFrame) -> int:
    return events.agg(F.expr(f"max(event_id) div {EVENTS_PER_BLOCK}")).first()[0]


def shares(events: DataFrame) -> int:
    """Tasks for what is made of the events line by line: one for 50,000 of them, but as many as there are cores at least."""
    return max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // 50_000))


def probes(spark: SparkSession, n: int, head: int, addresses: int) -> DataFrame:
    """``n`` probes (probe_id, address, slot, block), spread by arithmetic, some at addresses that aren't there."""
    slot = F.element_at(F.array(*[F.lit(s) for s in SLOTS]), (F.col("id") % len(SLOTS) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("probe_id"), (F.col("id") * 37 % (addresses + 11)).alias("address"), slot.alias("slot"), (F.col("id") * 97 % (head + 1)).alias("block"))


def event_probes(events: DataFrame, head: int, addresses: int) -> DataFrame:
    """One probe (probe_id, address, slot, block) an event, so they grow, and are skewed, as the table is: its user and
    type at a block computed from its id. Every eleventh asks for an address above all that are there."""
    absent = F.when(F.col("event_id") % 11 == 0, F.lit(addresses + 1)).otherwise(F.lit(0))
    return events.select(F.col("event_id").alias("probe_id"), (F.col("user_id") + absent).alias("address"), F.col("event_type").alias("slot"), (F.col("event_id") * 97 % (head + 1)).alias("block"))
