"""Genesis allocations as anchor packages.

The allocation becomes one row an account, of which events and problems are both projections: whatever is wrong with the
block, the config or any account is gathered first, and the package is made only if nothing is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.keccak import EMPTY_CODE, keccak_of
from tidemark.plans.store import stage
from tidemark.sources.packages import SCHEMA, InvalidPackage

EMPTY_CODE_HASH = "0x" + EMPTY_CODE.hex()
#: The fields of an allocation.
_ALLOC = "map<string, struct<nonce: string, balance: string, code: string, storage: map<string, string>>>"
_ZERO = "00" * 32


def _accounts(spark: SparkSession, genesis: str) -> DataFrame:
    """name, key, nonce, balance, code, slots (name, key, value) and code_hash; what doesn't parse is null."""
    field = lambda name, without: F.coalesce(F.col(f"given.{name}"), F.lit(without))
    each = spark.createDataFrame([(genesis,)], "text string").select(F.explode(F.from_json("text", f"alloc {_ALLOC}")["alloc"]).alias("name", "given"))
    named = each.withColumn("name", F.concat(F.lit("0x"), "name"))
    slots = F.transform(F.map_entries(F.coalesce("given.storage", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), S.parse_fixed(e["key"], 32).alias("key"), S.parse_fixed(e["value"], 32).alias("value")))
    rows = named.select(
        "name", S.parse_fixed(F.col("name"), 20).alias("key"), S.parse_quantity(field("nonce", "0x0")).alias("nonce"), S.parse_u256(field("balance", "0x0")).alias("balance"),
        S.parse_data(field("code", "0x")).alias("code"), slots.alias("slots"),
    )
    return stage(rows.withColumn("code_hash", keccak_of("code")), "genesis")


def _problems(accounts: DataFrame, chain: object, block: dict) -> list[str]:
    """Everything that keeps an allocation from being an anchor."""
    lacking = [f for f in ("number", "hash", "parentHash", "stateRoot", "timestamp") if not isinstance(block.get(f), str)]
    found = [f"the block has no {f}" for f in lacking]
    if block.get("number", "0x0") != "0x0":
        found.append(f"block {block['number']} can't be an anchor, only 0x0 can")
    if int(block.get("parentHash") or "0x0", 16):
        found.append("the first block of a chain has no parent, but this one names one")
    if not isinstance(chain, int) or isinstance(chain, bool):
        found.append("the config doesn't say which chain this is (chainId)")
    unread = F.col("key").isNull() | F.col("nonce").isNull() | F.col("balance").isNull() | F.col("code").isNull() | F.exists("slots", lambda s: s["key"].isNull() | s["value"].isNull())
    total, bad = accounts.agg(F.count("*"), F.min(F.when(unread, F.col("name")))).first()
    if not total:
        found.append("nobody is allocated anything")
    if bad is not None:
        found.append(f"account {bad} has a field that can't be read")
    clash = accounts.groupBy("code_hash").agg(F.countDistinct("code").alias("codes")).where("codes > 1").limit(1).count()
    if clash:
        found.append("two codes of one hash")
    return found


def genesis_anchor(spark: SparkSession, genesis: str, block: str, schema: str = SCHEMA) -> DataFrame:
    """(line_no, line) of the anchor package of a genesis allocation and its block zero, zero slots left out.

    ``block`` may be the bare block or a JSON-RPC response around it. All that is wrong is named in one InvalidPackage.
    """
    given = json.loads(block)
    zero = given.get("result", given)
    chain = json.loads(genesis).get("config", {}).get("chainId")
    accounts = _accounts(spark, genesis)
    problems = _problems(accounts, chain, zero)
    if problems:
        raise InvalidPackage("; ".join(problems))
    line = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()]))
    at = F.lit("0x0")
    live = accounts.select(
        F.lit("b").alias("kind"), "name", F.lit("").alias("slot"),
        line("account", block=at, address=F.col("name"), exists=F.lit(True), incarnation=at, nonce=S.quantity(F.col("nonce")), balance=S.quantity_u256(F.col("balance")), code_hash=S.data_hex(F.col("code_hash"))).alias("line"),
    )
    held = accounts.select("name", F.explode("slots").alias("s")).where(F.col("s.value") != F.unhex(F.lit(_ZERO)))
    slots = held.select(F.lit("c").alias("kind"), "name", F.col("s.name").alias("slot"), line("storage", block=at, address=F.col("name"), incarnation=at, slot=F.col("s.name"), value=S.data_hex(F.col("s.value"))).alias("line"))
    blobs = accounts.where(F.octet_length("code") > 0).select(S.data_hex(F.col("code_hash")).alias("name"), S.data_hex(F.col("code")).alias("code")).distinct()
    codes = blobs.select(F.lit("d").alias("kind"), "name", F.lit("").alias("slot"), line("code", code_hash=F.col("name"), bytes=F.col("code")).alias("line"))
    events = live.unionByName(slots).unionByName(codes)
    frame = _frame(spark, schema, chain, zero, events.count())
    # one window: an allocation is one package, whose size is capped
    ordered = events.unionByName(frame).withColumn("line_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("kind", "name", "slot")))
    return ordered.select("line_no", "line").orderBy("line_no")


def _frame(spark: SparkSession, schema: str, chain: int, zero: dict, events: int) -> DataFrame:
    """The records around the events: header and block before, block_end and trailer after."""
    ends = {"end_number": "0x0", "end_hash": zero["hash"], "block_count": "0x1"}
    opened = {"number": "0x0", "hash": zero["hash"], "parent_hash": zero["parentHash"], "state_root": zero["stateRoot"], "timestamp": zero["timestamp"]}
    about = {"schema": schema, "chain_id": hex(chain), "genesis_hash": zero["hash"], "mode": "anchor", "anchor_number": "0x0", "anchor_hash": zero["hash"]}
    rows = [("a", "0", {"type": "header", **about}), ("a", "1", {"type": "block", **opened}), ("e", "0", {"type": "block_end", "number": "0x0", "event_count": hex(events)}), ("e", "1", {"type": "trailer", **ends})]
    return spark.createDataFrame([(kind, name, "", json.dumps(record)) for kind, name, record in rows], "kind string, name string, slot string, line string")


def write_package(ordered: DataFrame, path: str) -> None:
    """A package (columns line_no, line) as a single text file in the folder ``path``; packages are capped in size."""
    ordered.select("line_no", "line").coalesce(1).sortWithinPartitions("line_no").select("line").write.text(path)


def write_packages(lines: DataFrame, path: str) -> None:
    """Many packages (columns package, line_no, line) in one job, each as a single text file in a folder of its own."""
    lines.repartition("package").sortWithinPartitions("package", "line_no").select("package", "line").write.partitionBy("package").text(path)

