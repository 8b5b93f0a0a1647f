"""Reads at a block: account, storage and code, for one probe or millions of them.

Three kinds of nothing are kept apart until the last step: no version (inherits nothing), a tombstone (a version that
says the account is gone), and zero (a value like any other). Storage is looked up only for accounts that are live at
the block, under the incarnation found there; code only for live accounts with a code hash, in blobs seen by then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.operators.asof import as_of_join, snapshot_at

#: JSON-RPC error codes.
UNREADABLE, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL, NOT_AVAILABLE = -32700, -32600, -32601, -32602, -32603, -32001
STATED = ("eth_blockNumber", "eth_chainId", "web3_clientVersion")
METHODS = ("eth_getBalance", "eth_getTransactionCount", "eth_getCode", "eth_getStorageAt", *STATED)
#: Requests a batch may hold; a parameter of ``requests_of``.
BATCH = 100


class BeyondHead(ValueError):
    """A probe asks for a block after the snapshot's head."""


@dataclass(frozen=True)
class Snapshot:
    """A pinned head and the versions up to it. Frames are lazy; nothing is read before an action."""

    accounts: DataFrame
    storage: DataFrame
    codes: DataFrame
    head: int
    chain_id: int = 1
    client: str = "tidemark"
    strategy: str = "bucketed"
    empty_hash: bytes | None = None
    #: Whether what is published is finalized; else there is no safe and no finalized block.
    finalized: bool = True

    def check(self, probes: DataFrame) -> DataFrame:
        """``probes``, failing at run time if one lies beyond the head: never a clamped answer."""
        beyond = F.raise_error(F.concat(F.lit(f"beyond head {self.head}: block "), F.col("block").cast("string")))
        return probes.withColumn("block", F.when(F.col("block") > self.head, beyond.cast("long")).otherwise(F.col("block")))

    def accounts_as_of(self, probes: DataFrame, live_only: bool = False) -> DataFrame:
        """``probes`` (address, block, any others) with the account's struct; its ``block`` is the one asked for."""
        found = as_of_join(self.check(probes), self.accounts, ["address"], self.strategy, name="account")
        return found.where(F.coalesce(F.col("account.exists"), F.lit(False))) if live_only else found

    def storage_as_of(self, probes: DataFrame, zero: Column) -> DataFrame:
        """``probes`` (address, slot, block) with ``value``: ``zero`` where account or slot has none."""
        return self._storage(self.accounts_as_of(probes), zero)

    def _storage(self, found: DataFrame, zero: Column, asked: Column | None = None) -> DataFrame:
        """The slot's value beside each account found; looked up only where ``asked``."""
        alive = F.coalesce(F.col("account.exists"), F.lit(False))
        alive = alive if asked is None else alive & asked
        # dead and absent accounts get a null incarnation, which no version has
        keyed = found.withColumn("incarnation", F.when(alive, F.col("account.incarnation")))
        slots = as_of_join(keyed, self.storage, ["address", "incarnation", "slot"], self.strategy, name="written")
        return slots.withColumn("value", F.coalesce(F.col("written.value"), zero)).drop("written")

    def code_as_of(self, probes: DataFrame, empty: Column) -> DataFrame:
        """``probes`` (address, block) with ``code``; a live account's missing blob has ``missing`` true."""
        return self._code(self.accounts_as_of(probes), empty)

    def _code(self, found: DataFrame, empty: Column, asked: Column | None = None) -> DataFrame:
        alive = F.coalesce(F.col("account.exists"), F.lit(False)) & F.col("account.code_hash").isNotNull()
        alive = alive & (F.col("account.code_hash") != F.lit(self.empty_hash)) if self.empty_hash else alive
        alive = alive if asked is None else alive & asked
        first = self.codes.groupBy("code_hash").agg(F.min_by(F.struct("first_seen_block", "code"), "first_seen_block").alias("blob"))
        # what has no code is joined by its address, which no blob has: a null would put all of them into one task
        binary = isinstance(self.codes.schema["code_hash"].dataType, T.BinaryType)
        elsewhere = F.unhex(F.sha2(F.concat(F.lit("no code "), F.col("address").cast("string")), 224)) if binary else F.concat(F.lit("no code "), F.col("address").cast("string"))
        keyed = found.withColumn("_has", alive).withColumn("_code", F.when(alive, F.col("account.code_hash")).otherwise(elsewhere))
        met = keyed.join(first, (F.col("_code") == F.col("code_hash")) & (F.col("blob.first_seen_block") <= F.col("block")), "left")
        out = met.withColumn("missing", F.col("_has") & F.col("blob").isNull())
        return out.withColumn("code", F.when(~F.col("missing"), F.coalesce(F.col("blob.code"), empty))).drop("_has", "_code", "code_hash", "blob")

    def accounts_at(self, block: int) -> DataFrame:
        """Extension: the whole account state at a block, tombstones included."""
        return snapshot_at(self.accounts, ["address"], self._within(block))

    def storage_at(self, block: int) -> DataFrame:
        """Extension: all slots of the accounts live at a block, under their incarnation, zeros included."""
        live = self.accounts_at(block).where("exists").select("address", "incarnation")
        return snapshot_at(self.storage, ["address", "incarnation", "slot"], self._within(block)).join(live, ["address", "incarnation"])

    def _within(self, block: int) -> int:
        if block > self.head:
            raise BeyondHead(f"block {block} is beyond head {self.head}")
        return block

    def history(self, key: Column) -> DataFrame:
        """Extension: every version of the accounts that ``key`` selects, oldest first within each."""
        return self.accounts.where(key).sortWithinPartitions("address", "block")

    def resolved(self, requests: DataFrame, selector: str = "selector") -> DataFrame:
        """``requests`` with block and error_code, from a selector's text.

        latest: the head; safe and finalized: the head, unless what is published isn't final; earliest: 0; a canonical
        hex quantity of 64 bits at most: that block. A JSON object may hold one of these as ``blockNumber``, and a boolean
        ``requireCanonical``; block hashes have no index and are refused, and so are pending, decimals and all else.
        """
        given = F.col(selector)
        nested = F.ltrim(given).startswith("{")
        keys = F.coalesce(F.json_object_keys(given), F.array().cast("array<string>"))
        sound = (F.size(F.array_except(keys, F.array(F.lit("blockNumber"), F.lit("requireCanonical")))) == 0) & F.array_contains(keys, "blockNumber")
        sound = sound & (~F.array_contains(keys, "requireCanonical") | given.rlike('"requireCanonical"\\s*:\\s*(?:true|false)\\b'))
        sound = sound & given.rlike('"blockNumber"\\s*:\\s*"')
        text = F.when(nested, F.when(sound, F.get_json_object(given, "$.blockNumber"))).otherwise(given)
        number = lambda n: F.lit(n).cast("decimal(20,0)")
        head, final = number(self.head), text.isin("safe", "finalized")
        block = F.when((text == "latest") | final, head).when(text == "earliest", number(0)).otherwise(S.parse_quantity(text))
        absent = (block > head) | (final & F.lit(not self.finalized))
        code = F.when(block.isNull(), INVALID_PARAMS).when(absent, NOT_AVAILABLE)
        return requests.withColumn("error_code", code.cast("int")).withColumn("block", F.when(code.isNull(), block.cast("long")))

    def answer(self, requests: DataFrame) -> DataFrame:
        """A batch of requests (request_id, method, address, slot, selector) with result and error_code, one row each.

        Accounts are looked up once, storage and code only for the requests that ask for them. Balances and values of 256
        bits, and code, are written in hex if the snapshot holds them in binary, else as they are. Rows that can't be
        answered get a code of their own instead of failing the job; one that ``requests`` has already is kept.
        """
        before = F.col("error_code") if "error_code" in requests.columns else F.lit(None).cast("int")
        asked = requests.withColumn("_given", before).drop("error_code", "block")
        known, stated = F.col("method").isin(*METHODS), F.col("method").isin(*STATED)
        needs_slot, needs_code = F.col("method") == "eth_getStorageAt", F.col("method") == "eth_getCode"
        lacking = F.col("address").isNull() | (needs_slot & F.col("slot").isNull())
        wanted = self.resolved(asked)
        bad = F.when(F.col("_given").isNotNull(), F.col("_given")).when(~F.coalesce(known, F.lit(False)), NO_METHOD).when(stated, F.lit(None)).when(lacking, INVALID_PARAMS).otherwise(F.col("error_code"))
        wanted = wanted.withColumn("error_code", bad.cast("int")).withColumn("block", F.when(bad.isNull(), F.coalesce(F.col("block"), F.lit(self.head).cast("long"))))
        kind = lambda table, c: table.schema[c].dataType
        binary = lambda table, c: isinstance(kind(table, c), T.BinaryType)
        nothing = F.unhex(F.lit("00" * 32))
        zero = nothing if binary(self.storage, "value") else F.lit(0).cast(kind(self.storage, "value"))
        empty = F.unhex(F.lit("")) if binary(self.codes, "code") else F.lit("0x")
        read = self._code(self._storage(self.accounts_as_of(wanted), zero, needs_slot), empty, needs_code)
        live = F.coalesce(F.col("account.exists"), F.lit(False))
        number = lambda c: S.quantity(F.when(live, F.col(c)).otherwise(F.lit(0)).cast("decimal(20,0)"))
        balance = S.quantity_u256(F.when(live, F.col("account.balance")).otherwise(nothing)) if binary(self.accounts, "balance") else number("account.balance")
        text = lambda table, c: S.data_hex(F.col(c)) if binary(table, c) else F.col(c).cast("string")
        result = (
            F.when(F.col("method") == "eth_blockNumber", S.quantity(F.lit(self.head)))
            .when(F.col("method") == "eth_chainId", S.quantity(F.lit(self.chain_id)))
            .when(F.col("method") == "web3_clientVersion", F.lit(self.client))
            .when(F.col("method") == "eth_getBalance", balance)
            .when(F.col("method") == "eth_getTransactionCount", number("account.nonce"))
            .when(needs_code, text(self.codes, "code"))
            .when(needs_slot, text(self.storage, "value"))
        )
        failed = F.coalesce(F.col("error_code"), F.when(F.col("missing") & needs_code, INTERNAL))
        return read.withColumn("result", F.when(failed.isNull(), result)).withColumn("error_code", failed.cast("int")).select("request_id", "method", "result", "error_code")


def requests_of(texts: DataFrame, most: int = BATCH) -> DataFrame:
    """body, request_id, method, address, slot, selector and error_code of JSON-RPC bodies (columns body, text).

    A body is a request or a batch, which becomes a row a request. What isn't JSON, is an empty or too large batch, isn't
    a request of version 2.0, or has other parameters than its method takes, gets its error code here.
    """
    text, whole = F.col("text"), F.try_parse_json("text")
    items = F.when(F.ltrim(text).startswith("["), F.from_json("text", "array<string>")).otherwise(F.array("text"))
    fault = F.when(whole.isNull(), UNREADABLE).when((F.size(items) == 0) | (F.size(items) > most), INVALID_REQUEST)
    # a body at fault as a whole is one row, without a request in it
    each = texts.withColumns({"_fault": fault, "_items": F.when(fault.isNull(), items)}).select("body", "_fault", F.posexplode_outer("_items").alias("_at", "_item"))
    r = each.withColumn("_r", F.from_json("_item", "jsonrpc string, id string, method string, params array<string>"))
    method, params = F.col("_r.method"), F.col("_r.params")
    takes = F.when(method == "eth_getStorageAt", 3).when(method.isin(*[m for m in METHODS if m not in STATED]), 2)
    wrong = F.when(F.col("_fault").isNotNull(), F.col("_fault")).when(~F.coalesce((F.col("_r.jsonrpc") == "2.0") & method.isNotNull(), F.lit(False)), INVALID_REQUEST)
    wrong = wrong.when(takes.isNotNull() & ~F.coalesce(F.size(params) == takes, F.lit(False)), INVALID_PARAMS)
    return r.select(
        "body", F.coalesce("_at", F.lit(0)).alias("nth"), F.col("_r.id").alias("request_id"), method.alias("method"), S.parse_fixed(F.get(params, 0), 20).alias("address"),
        F.when(method == "eth_getStorageAt", S.parse_slot(F.get(params, 1))).alias("slot"), F.get(params, takes - 1).alias("selector"), wrong.cast("int").alias("error_code"),
    )
