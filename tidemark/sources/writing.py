"""Account histories written as change packages: one package an epoch, one line a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.sources.packages import SCHEMA


def block_hash(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("block "), number.cast("string")), 256))


def package_lines(
    accounts: DataFrame, blocks_per_epoch: int, schema: str = SCHEMA, code_hash: str = "0x" + "ee" * 32, storage: DataFrame | None = None, codes: DataFrame | None = None,
    numbers: DataFrame | None = None, anchored: bool = False, shares: int | None = None,
) -> DataFrame:
    """package, line_no, line of packages of ``accounts`` (address, block, exists, incarnation, nonce, balance).

    ``storage`` (address, incarnation, slot, block, value) and ``codes`` (code_hash, first_seen_block, code) are written
    into their blocks, hashes, values and code being binary; an account's own code_hash, if there is such a column, stands
    for ``code_hash``, and its balance may be binary. ``numbers`` (block) are the blocks to write, by default those with
    accounts: a package's blocks follow each other where none is left out. The first package is an anchor if ``anchored``.
    ``shares`` is the number of tasks that packages are dealt to, where it shouldn't be the session's.
    """
    q = S.quantity
    line = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()])).alias("line")
    named = lambda: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("address"), 40, "0")))
    row = lambda frame, kind, order, text: frame.select("block", F.lit(kind).alias("kind"), order.alias("a"), text)
    live = lambda c: F.when(F.col("exists"), c)
    wide = dict(accounts.dtypes)["balance"] == "binary"
    own = S.data_hex(F.col("code_hash")) if dict(accounts.dtypes).get("code_hash") == "binary" else F.lit(code_hash)
    balance = S.quantity_u256(F.col("balance")) if wide else q(F.col("balance"))
    account = line("account", block=q(F.col("block")), address=named(), exists=F.col("exists"), incarnation=q(F.col("incarnation")), nonce=live(q(F.col("nonce"))), balance=live(balance), code_hash=live(own))
    events = row(accounts, 1, named(), account)
    if storage is not None:
        written = line("storage", block=q(F.col("block")), address=named(), incarnation=q(F.col("incarnation")), slot=S.data_hex(F.col("slot")), value=S.data_hex(F.col("value")))
        life = F.lpad(F.col("incarnation").cast("string"), 20, "0")
        events = events.unionByName(row(storage, 2, F.concat(named(), life, S.data_hex(F.col("slot"))), written))
    if codes is not None:
        blobs = codes.select(F.col("first_seen_block").alias("block"), S.data_hex(F.col("code_hash")).alias("code_hash"), S.data_hex(F.col("code")).alias("code"))
        events = events.unionByName(row(blobs, 3, F.col("code_hash"), line("code", code_hash=F.col("code_hash"), bytes=F.col("code"))))
    epoch = F.floor(F.col("block") / blocks_per_epoch).alias("epoch")
    counts = events.groupBy("block").agg(F.count("*").alias("n"))
    blocks = (counts if numbers is None else numbers.join(counts, "block", "left")).select("block", F.coalesce("n", F.lit(0)).alias("n"))
    n, h, zero = q(F.col("block")), block_hash(F.col("block")), F.lit("0x" + "00" * 32)
    parent = F.when(F.lit(anchored) & (F.col("block") == 0), zero).otherwise(block_hash(F.col("block") - 1))
    opening = row(blocks, 0, F.lit(""), line("block", number=n, hash=h, parent_hash=parent, state_root=zero, timestamp=q(F.col("block"))))
    closing = row(blocks, 4, F.lit(""), line("block_end", number=n, event_count=q(F.col("n"))))
    epochs = blocks.groupBy(epoch).agg(F.min("block").alias("first"), F.max("block").alias("last"), F.count("*").alias("n"))
    before, start = q(F.greatest(F.col("first") - 1, F.lit(0))), F.lit(anchored) & (F.col("first") == 0)
    following = ~start
    header = line(
        "header", schema=F.lit(schema), chain_id=F.lit("0x1"), genesis_hash=block_hash(F.lit(0)), mode=F.when(start, F.lit("anchor")).otherwise(F.lit("delta")),
        anchor_number=F.when(start, q(F.col("first"))), anchor_hash=F.when(start, block_hash(F.col("first"))), preceding_number=F.when(following, before), preceding_hash=F.when(following, block_hash(F.col("first") - 1)),
    )
    trailer = line("trailer", end_number=q(F.col("last")), end_hash=block_hash(F.col("last")), block_count=q(F.col("n")))
    inner = events.unionByName(opening).unionByName(closing).select(epoch, "block", "kind", "a", "line")
    frame = lambda block, text: epochs.select("epoch", block.cast("long").alias("block"), F.lit(9).alias("kind"), F.lit("").alias("a"), text)
    lines = inner.unionByName(frame(F.lit(-1), header)).unionByName(frame(F.col("last") + 1, trailer))
    lines = lines.repartition(shares, "epoch") if shares else lines
    nth = F.row_number().over(Window.partitionBy("epoch").orderBy("block", "kind", "a"))
    return lines.select(F.col("epoch").cast("string").alias("package"), nth.alias("line_no"), "line")
