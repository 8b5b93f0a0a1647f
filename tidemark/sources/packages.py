"""Change packages: JSON Lines, plain or as one zstd stream, many files at once, and the tables they decode to.

A package's digest is the SHA-256 of the file as it is. Line numbers come from positions within the file.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.functions.shipping import ship
from tidemark.operators import validate
from tidemark.plans.store import stage

ship(__name__)

#: The package format that is read and written; a parameter, for archives that name theirs otherwise.
SCHEMA = "state-export/1"
MAX_DECODED = 1 << 30
#: Fixed value: how a zstd stream begins.
ZSTD = b"\x28\xb5\x2f\xfd"


class InvalidPackage(ValueError):
    """A package breaks rules; the message names the first few."""


@F.pandas_udf(T.StringType())
def _text(contents: pd.Series) -> pd.Series:
    import zstandard

    def one(raw: bytes) -> str:
        if raw[:4] == ZSTD:
            with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)) as stream:
                raw = stream.read(MAX_DECODED + 1)
        if len(raw) > MAX_DECODED:
            raise ValueError("package decodes to more than 1 GiB")
        return bytes(raw).decode("utf-8")

    return contents.map(one)


def files(spark: SparkSession, path: str, most: int = MAX_DECODED) -> DataFrame:
    """Files under a path. One of more than ``most`` bytes is refused by its listing, before any is read."""
    listed = spark.read.format("binaryFile").load(path)
    large = listed.where(F.col("length") > most).select("path", "length").limit(1).collect()
    if large:
        raise InvalidPackage(f"{large[0]['path']} has {large[0]['length']} bytes, the limit is {most}")
    return listed


def read_lines(content: DataFrame, *kept: str) -> DataFrame:
    """package (digest, hex), line_no (from 1), line of ``content`` (column content), without blank lines, and columns ``kept``."""
    named = content.select(F.sha2("content", 256).alias("package"), _text("content").alias("text"), *kept)
    lines = named.select("package", F.posexplode(F.split("text", "\n")).alias("at", "line"), *kept)
    return lines.where(F.trim("line") != "").select("package", (F.col("at") + 1).alias("line_no"), "line", *kept)


def package_from_text(spark: SparkSession, text: str | bytes) -> DataFrame:
    raw = text.encode("utf-8") if isinstance(text, str) else text
    return read_lines(spark.createDataFrame([(raw,)], "content binary"))


@dataclass(frozen=True)
class Header:
    """What a package says of itself, and its first and last block."""

    digest: str
    chain_id: int
    genesis: str
    mode: str
    preceding: tuple[int, str] | None
    first: tuple[int, str, str]
    last: tuple[int, str, str]


@dataclass(frozen=True)
class Package(Header):
    """One decoded package: a header, and lazy frames of what it changes."""

    blocks: DataFrame
    accounts: DataFrame
    storage: DataFrame
    codes: DataFrame


@dataclass(frozen=True)
class Packages:
    """Many decoded packages: their headers by first block, and lazy frames of what all of them change."""

    headers: list[Header]
    accounts: DataFrame
    storage: DataFrame
    codes: DataFrame


def tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """blocks, accounts, storage and codes of decoded records, each with its package; a code is first seen in the block it stands in."""
    block = F.col("block").cast("long")
    opened = F.last(F.when(F.col("type") == "block", F.col("number")), ignorenulls=True).over(Window.partitionBy("package").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    blocks = records.where("type = 'block'").select("package", F.col("number").cast("long").alias("number"), "hash", "parent_hash", "state_root", "timestamp")
    accounts = records.where("type = 'account'").select("package", "address", block.alias("block"), "exists", "incarnation", "nonce", "balance", "code_hash")
    storage = records.where("type = 'storage'").select("package", "address", "incarnation", "slot", block.alias("block"), "value")
    codes = records.withColumn("opened", opened).where("type = 'code'").select("package", "code_hash", F.col("opened").cast("long").alias("first_seen_block"), F.col("bytes").alias("code"))
    return blocks, accounts, storage, codes


def read_package(lines: DataFrame, schema: str = SCHEMA) -> Package:
    """The one package of ``lines``, validated: every rule's violations must be none."""
    records = stage(validate.decode(lines), "package")
    bad = validate.package_violations(records, schema).limit(5).collect()
    if bad:
        raise InvalidPackage("; ".join(f"line {r['line_no']}: {r['rule']}" for r in bad))
    blocks, accounts, storage, codes = (t.drop("package") for t in tables(records))
    head = records.where("type = 'header'").first()
    row = lambda end: blocks.orderBy(F.col("number").desc() if end else F.col("number")).first()
    first, last = row(False), row(True)
    anchor = head["mode"] == "anchor"
    zero = F.unhex(F.lit("00" * 32))
    wrong = validate.lifecycle(accounts, storage, anchor, zero).select("rule").limit(1).collect()
    if wrong:
        raise InvalidPackage(f"storage lifecycle: {wrong[0]['rule']}")
    if anchor and validate.missing_code(accounts, codes).limit(1).count():
        raise InvalidPackage("anchor lacks code of a live account")
    preceding = None if anchor else (int(head["preceding_number"]), bytes(head["preceding_hash"]).hex())
    ends = (first["number"], bytes(first["hash"]).hex(), bytes(first["parent_hash"]).hex()), (last["number"], bytes(last["hash"]).hex(), bytes(last["state_root"]).hex())
    return Package(head["package"], int(head["chain_id"]), bytes(head["genesis_hash"]).hex(), head["mode"], preceding, *ends, blocks, accounts, storage, codes)


def read_packages(content: DataFrame, schema: str = SCHEMA) -> Packages:
    """All packages of ``content`` (path, content), validated together by the rules of ``read_package``, each for itself.

    The driver gets a row a package, for the chain that packages must be. Copies of a file count once.
    """
    records = stage(validate.decode(read_lines(content, "path"), "path"), "packages")
    paths = records.where("type = 'header'").groupBy("package").agg(F.array_sort(F.collect_set("path")).alias("paths")).where("size(paths) > 1").collect()
    if paths:
        records = records.where(~F.col("path").isin([p for r in paths for p in r["paths"][1:]]))
    records = records.drop("path")
    bad = validate.package_violations(records, schema).limit(5).collect()
    if bad:
        raise InvalidPackage("; ".join(f"package {r['package'][:12]}, line {r['line_no']}: {r['rule']}" for r in bad))
    _, accounts, storage, codes = tables(records)
    mode = F.max(F.when(F.col("type") == "header", F.col("mode"))).alias("mode")
    block = F.struct("number", "hash", "parent_hash", "state_root")
    end = lambda least, name: least(F.when(F.col("type") == "block", block), F.when(F.col("type") == "block", F.col("number"))).alias(name)
    of = lambda c: F.max(F.when(F.col("type") == "header", F.col(c))).alias(c)
    each = records.groupBy("package").agg(mode, *[of(c) for c in ("chain_id", "genesis_hash", "preceding_number", "preceding_hash")], end(F.min_by, "first"), end(F.max_by, "last")).collect()
    text = lambda b: bytes(b).hex()
    headers = [
        Header(
            r["package"], int(r["chain_id"]), text(r["genesis_hash"]), r["mode"], None if r["mode"] == "anchor" else (int(r["preceding_number"]), text(r["preceding_hash"])),
            (int(r["first"]["number"]), text(r["first"]["hash"]), text(r["first"]["parent_hash"])), (int(r["last"]["number"]), text(r["last"]["hash"]), text(r["last"]["state_root"])),
        )
        for r in each
    ]
    anchors = [h.digest for h in headers if h.mode == "anchor"]
    anchor = F.col("package").isin(anchors) if anchors else F.lit(False)
    wrong = validate.lifecycle(accounts, storage, anchor, F.unhex(F.lit("00" * 32)), ["package"]).select("package", "rule").limit(1).collect()
    if wrong:
        raise InvalidPackage(f"package {wrong[0]['package'][:12]}, storage lifecycle: {wrong[0]['rule']}")
    for digest in anchors[:2]:  # a second anchor can't continue the first, and is refused when published
        if validate.missing_code(accounts.where(F.col("package") == digest), codes.where(F.col("package") == digest)).limit(1).count():
            raise InvalidPackage("anchor lacks code of a live account")
    return Packages(sorted(headers, key=lambda h: h.first[0]), accounts, storage, codes)


def probe_samples(spark: SparkSession, path: str) -> DataFrame:
    """address, slot, block of a file of samples in JSON Lines."""
    rows = spark.read.schema("address string, slot string, block long").json(path)
    return rows.select(S.parse_fixed(F.col("address"), 20).alias("address"), S.parse_slot(F.col("slot")).alias("slot"), "block")


def replayed_updates(blocks: DataFrame) -> DataFrame:
    """address, block, exists, previous_exists, wiped of replayed blocks in JSON (column ``json``)."""
    state = "struct<state: struct<exists: boolean, nonce: string, balance: string, code_hash: string>, previous_exists: boolean, wiped_storage: boolean>"
    parsed = blocks.select(F.from_json("json", f"block bigint, accounts map<string, {state}>").alias("b"))
    each = parsed.select("b.block", F.explode("b.accounts").alias("address", "a"))
    return each.select(S.parse_fixed(F.col("address"), 20).alias("address"), "block", "a.state.exists", "a.previous_exists", F.col("a.wiped_storage").alias("wiped"))
