"""Registered queries over an archive that is published from the events' history, and over wire formats with known answers.

The history of ``sources.events`` is written as package files with accounts, storage and code (addresses padded to 20
bytes, slots hashed, balances times 10**17, so that they pass 2**64), read back from the files, validated and published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.functions import scalars as S
from tidemark.functions.keccak import keccak_of
from tidemark.operators.snapshot import requests_of
from tidemark.plans.archive import Archive
from tidemark.plans.store import scratch, stage
from tidemark.queries import _EVENT_PROBES, _KEYS, _STORAGE, _address, _keys, _sql, query
from tidemark.sources import events as E
from tidemark.sources.genesis import write_packages
from tidemark.sources.packages import files, read_packages
from tidemark.sources.writing import package_lines
from tidemark.streaming.ingest import ingest

#: Packages that the history is dealt into, as long as none gets more than the 1,000 blocks that a package may have.
PACKAGES, UNIT = 5, 10**17
#: Packages a micro-batch of the stream, of which there are two at least.
STREAMED = 256


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """package, line_no, line of the history as packages, staged, and the packages' names in order."""
    events = E.load(spark, sf_dir)
    head = E.head_block(events)
    per = min(1000, head // PACKAGES + 1)
    codes = stage(E.code_blobs(events).withColumn("bytes", F.encode("code", "UTF-8")).withColumn("hash", keccak_of("bytes")), "codes")
    accounts = E.account_versions(events).join(codes.select("code_hash", "hash"), "code_hash", "left")
    wide = lambda c, by: S.u256(F.col(c).cast("decimal(38,0)") * F.lit(by).cast("decimal(18,0)"))
    accounts = accounts.select(_address("address").alias("address"), "block", "exists", "incarnation", "nonce", wide("balance", UNIT).alias("balance"), F.col("hash").alias("code_hash"))
    storage = E.storage_versions(events).select(_address("address").alias("address"), "incarnation", S.digest(F.col("slot")).alias("slot"), "block", wide("value", 1).alias("value"))
    blobs = codes.select(F.col("hash").alias("code_hash"), "first_seen_block", F.col("bytes").alias("code"))
    numbers = spark.range(head + 1).withColumnRenamed("id", "block")
    return stage(package_lines(accounts, per, storage=storage, codes=blobs, numbers=numbers, anchored=True, shares=E.shares(events)), "package-lines"), [str(n) for n in range(head // per + 1)]


def published(spark: SparkSession, sf_dir: str) -> Archive:
    """An archive of the history: all package files written, read, validated and published together, and compacted."""
    lines, _ = _lines(spark, sf_dir)
    root = scratch(spark, "archive")
    archive = Archive(spark, root, 1)
    write_packages(lines, f"{root}-in")
    archive.publish_all(read_packages(files(spark, f"{root}-in/package=*/part-*")))
    return archive


_WRITTEN = f"""
SELECT lpad(format('{{:x}}', address), 40, '0') AS address, block, "exists", incarnation, CASE WHEN "exists" THEN nonce END AS nonce,
       CASE WHEN "exists" THEN lpad(format('{{:x}}', balance::HUGEINT * {UNIT}::HUGEINT), 64, '0') END AS balance
FROM acc"""


def _versions(archive: Archive) -> DataFrame:
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return archive.snapshot().accounts.select(hexed("address"), "block", "exists", F.col("incarnation").cast("long"), F.col("nonce").cast("long"), hexed("balance"))


@query(_sql(_WRITTEN))
def publish_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account version, read back from the archive that the history was published into and compacted."""
    return _versions(published(spark, sf_dir))


@query(_sql("SELECT lpad(format('{:x}', address), 40, '0') AS address, incarnation, sha256(slot) AS slot, block, value FROM sto"))
def archive_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every storage version, read back likewise."""
    rows = published(spark, sf_dir).snapshot().storage
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select(hexed("address"), F.col("incarnation").cast("long"), hexed("slot"), "block", F.conv(F.substring(F.hex("value"), 49, 16), 16, 10).cast("long").alias("value"))


@query(_sql(_WRITTEN))
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packages as files of a stream, a share of them a micro-batch, each published once, and every account version read back."""
    lines, names = _lines(spark, sf_dir)
    root = scratch(spark, "stream")
    archive = Archive(spark, f"{root}/archive", 1)
    share = min(STREAMED, -(-len(names) // 2))
    for i in range(0, len(names), share):
        write_packages(lines.where(F.col("package").cast("int").between(i, i + share - 1)), f"{root}/in/{i}")
        ingest(spark, f"{root}/in/*/package=*/part-*", archive, f"{root}/checkpoint", at_once=max(share, 2)).awaitTermination()
    return _versions(archive)


#: What each request asks, by event: the method, and how its block is given (twice as a quantity, as the head, in an
#: object, in decimal, which is refused, and beyond the head).
_METHODS = ("eth_getBalance", "eth_getTransactionCount", "eth_getCode", "eth_getStorageAt", "eth_blockNumber", "eth_chainId", "eth_getProof")
_ASKED = f"""
asked AS (
  SELECT p.* EXCLUDE (block), {list(_METHODS)}[probe_id % 7 + 1] AS m, probe_id % 6 AS form, CASE WHEN probe_id % 6 = 2 THEN head ELSE block END AS block
  FROM eprb p, head),
met AS (SELECT p.*, a."exists" AS ex, a.incarnation, a.nonce, a.balance, a.code_hash FROM asked p ASOF LEFT JOIN acc a ON p.address = a.address AND p.block >= a.block)"""


@query(_sql(f"""
SELECT h.probe_id::VARCHAR AS request_id, m AS method,
  CASE WHEN m = 'eth_blockNumber' THEN '0x' || format('{{:x}}', head) WHEN m = 'eth_chainId' THEN '0x1' WHEN m = 'eth_getProof' OR form >= 4 THEN NULL
       WHEN m = 'eth_getBalance' THEN '0x' || format('{{:x}}', CASE WHEN h.ex THEN h.balance::HUGEINT * {UNIT}::HUGEINT ELSE 0 END)
       WHEN m = 'eth_getTransactionCount' THEN '0x' || format('{{:x}}', CASE WHEN h.ex THEN h.nonce ELSE 0 END)
       WHEN m = 'eth_getCode' THEN '0x' || coalesce(lower(hex(c.code)), '') WHEN m = 'eth_getStorageAt' THEN '0x' || lpad(format('{{:x}}', coalesce(v.value, 0)), 64, '0') END AS result,
  (CASE WHEN m = 'eth_getProof' THEN -32601 WHEN m IN ('eth_blockNumber', 'eth_chainId') THEN NULL WHEN form = 4 THEN -32602 WHEN form = 5 THEN -32001 END)::INT AS error_code
FROM met h JOIN val v USING (probe_id) LEFT JOIN cod c ON h.ex AND h.code_hash = c.code_hash AND c.first_seen_block <= h.block, head""", _EVENT_PROBES, _ASKED, _STORAGE.replace("FROM hit)", "FROM met)")))
def archive_rpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-RPC request an event, answered from the published archive: 256-bit balances and values, code in hex, errors."""
    events = E.load(spark, sf_dir)
    pinned = published(spark, sf_dir).snapshot()
    probes = E.event_probes(events, pinned.head, events.agg(F.max("user_id")).first()[0])
    nth, number = F.col("probe_id"), S.quantity(F.col("block"))
    forms = (
        F.when(nth % 6 == 2, F.lit('"latest"')).when(nth % 6 == 3, F.concat(F.lit('{"blockNumber":"'), number, F.lit('","requireCanonical":true}')))
        .when(nth % 6 == 4, F.concat(F.lit('"'), F.col("block").cast("string"), F.lit('"'))).when(nth % 6 == 5, F.concat(F.lit('"'), S.quantity(F.col("block") + pinned.head + 1), F.lit('"')))
        .otherwise(F.concat(F.lit('"'), number, F.lit('"')))
    )
    method = F.element_at(F.array(*[F.lit(m) for m in _METHODS]), (nth % 7 + 1).cast("int"))
    slot = F.when(method == "eth_getStorageAt", F.concat(F.lit('"0x'), F.sha2("slot", 256), F.lit('",'))).otherwise(F.lit(""))
    address = S.data_hex(_address("address"))
    text = F.concat(F.lit('{"jsonrpc":"2.0","id":'), nth.cast("string"), F.lit(',"method":"'), method, F.lit('","params":["'), address, F.lit('",'), slot, forms, F.lit("]}"))
    return pinned.answer(requests_of(probes.select(nth.alias("body"), text.alias("text"))))


@query(_sql("""
SELECT selector, CASE WHEN b BETWEEN 0 AND head THEN b END::BIGINT AS block, (CASE WHEN b < 0 THEN -32602 WHEN b > head THEN -32001 END)::INT AS error_code
FROM (SELECT selector, CASE WHEN n = -2 THEN head ELSE n END AS b, head FROM head, (VALUES
  ('{"blockNumber":"0x1f"}', 31), ('{"blockNumber":"latest"}', -2), ('{"blockNumber":"0x2","requireCanonical":false}', 2), ('{"blockNumber":"0x2","requireCanonical":"no"}', -1),
  ('{"blockNumber":31}', -1), ('{"blockNumber":null}', -1), ('{"blockHash":"0x00"}', -1), ('{"blockNumber":"0x2","blockHash":"0x00"}', -1), ('{}', -1), ('{"blockNumber":"0x2"', -1),
  ('31', -1), ('0xffffffffffffffff', 18446744073709551615), ('0x10000000000000000', -1), ('0xFF', -1), ('', -1), ('LATEST', -1)) v(selector, n))"""))
def selector_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors in objects, in decimal, and at the bounds of 64 bits."""
    from tidemark.queries import _snapshot

    pinned, _ = _snapshot(spark, sf_dir)
    forms = (
        '{"blockNumber":"0x1f"}', '{"blockNumber":"latest"}', '{"blockNumber":"0x2","requireCanonical":false}', '{"blockNumber":"0x2","requireCanonical":"no"}', '{"blockNumber":31}',
        '{"blockNumber":null}', '{"blockHash":"0x00"}', '{"blockNumber":"0x2","blockHash":"0x00"}', "{}", '{"blockNumber":"0x2"', "31", "0xffffffffffffffff", "0x10000000000000000", "0xFF", "", "LATEST",
    )
    return pinned.resolved(spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in forms])).alias("selector"))).select("selector", "block", "error_code")


#: Keccak-256 of some texts, as published for the hash that Ethereum uses.
KECCAK = {
    "": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470",
    "abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45",
    "hello": "1c8aff950685c2ed4bc3174f3472287b56d9517b9c948127319a09a7a36deac8",
    "testing": "5f16f4c7f149ac4f9510d9cf8cf384038ad348b3bcdc01915f95de12df9d1b02",
    "The quick brown fox jumps over the lazy dog": "4d741b6f1eb29cb2a9b9911c82f56fa8d73b04959d3d9d222895df6c0b28aa15",
    "transfer(address,uint256)": "a9059cbb2ab09eb219583f4a59a5d0623ade346d962bcd4e46b11da047c9049b",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{text}', '{digest}')" for text, digest in KECCAK.items()) + ") v(text, digest)")
def keccak_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keccak-256 of texts whose hashes are published."""
    texts = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in KECCAK])).alias("text"))
    return texts.select("text", F.lower(F.hex(keccak_of(F.encode("text", "UTF-8")))).alias("digest"))


_TWO64 = 1 << 64
_BITS_SQL = f"""
placed AS (
  SELECT k, (('0x' || substr(sha256(unhex(substr(k, 3, 40))), 1, 8))::UBIGINT & 3)::BIGINT AS shard,
         ('0x' || substr(sha256(unhex(k)), 1, 16))::UBIGINT::HUGEINT AS h1, ('0x' || substr(sha256(unhex(k)), 17, 16))::UBIGINT::HUGEINT | 1 AS h2 FROM keys),
bits AS (SELECT DISTINCT shard, ((h1 + i * h2) % {_TWO64}) % {bloom.BITS} AS bit FROM placed, range(0, {S.HASHES}) r(i))"""


@query(_sql("SELECT shard, count(*)::BIGINT AS bits_set, sum(bit)::BIGINT AS places FROM bits GROUP BY shard", _KEYS, _BITS_SQL))
def bloom_set_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bits a summary of four shards has set, and the sum of their numbers, read from its bytes."""
    summary = bloom.build_summary(_keys(spark, sf_dir).distinct(), 4, heavy=1 << 40)

    def read(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            at = [np.flatnonzero(np.unpackbits(np.frombuffer(bytes(b), np.uint8), bitorder="little")) for b in batch["bits"]]
            yield pd.DataFrame({"shard": batch["shard"], "bits_set": [len(x) for x in at], "places": [int(x.sum()) for x in at]})

    return summary.where("kind = 'a'").select("shard", "bits").mapInPandas(read, "shard long, bits_set long, places long")


@query("SELECT count(*)::BIGINT AS probes, true AS within FROM events")
def bloom_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent keys, one an event, that a summary of the history says it may hold: fewer than 50 in 10,000."""
    keys = stage(_keys(spark, sf_dir).distinct(), "bloom-keys")
    shards = keys.agg(S.shard_count(F.count("*"))).first()[0]
    name = F.unhex(F.substring(F.sha2(F.concat(F.lit("absent "), F.col("event_id").cast("string")), 256), 1, 40))
    absent = E.load(spark, sf_dir).select(S.account_key(name).alias("key"))
    found = bloom.may_contain(absent, bloom.build_summary(keys, shards, heavy=20), shards)
    positive = F.sum(F.col("may_contain").cast("long"))
    return found.agg(F.count("*").alias("probes"), (positive * 10000 < 50 * F.count("*")).alias("within"))
