"""Validation of change packages and histories: each rule's violations are rows, and a sound input has none.

Packages are validated many at a time: windows and aggregations run per package, whose size is capped. A rule is a
condition on a line (with what came before it in its package) or on a package's totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.keccak import EMPTY_CODE, keccak_of
from tidemark.operators.asof import as_of_join

MAX_BLOCKS, MAX_CODE, MAX_BYTES = 1000, 1 << 20, 256 << 20
#: Records a task.
ROWS = 100_000
#: Each record type's fields, those in brackets being optional.
FIELDS = {
    "header": "schema chain_id genesis_hash mode [anchor_number] [anchor_hash] [preceding_number] [preceding_hash]",
    "block": "number hash parent_hash state_root timestamp",
    "account": "block address exists incarnation [nonce] [balance] [code_hash]",
    "storage": "block address incarnation slot value",
    "code": "code_hash bytes",
    "block_end": "number event_count",
    "trailer": "end_number end_hash block_count",
}
_QUANTITIES = ("chain_id", "anchor_number", "preceding_number", "number", "timestamp", "block", "incarnation", "nonce", "event_count", "end_number", "block_count")
_HASHES = ("genesis_hash", "anchor_hash", "preceding_hash", "hash", "parent_hash", "state_root", "code_hash", "slot", "value", "end_hash")
_ALL = sorted({f.strip("[]") for fields in FIELDS.values() for f in fields.split()})
RECORD = "struct<" + ", ".join(f"`{c}`: {'boolean' if c == 'exists' else 'string'}" for c in ["type", *_ALL]) + ">"


def decode(lines: DataFrame, *kept: str) -> DataFrame:
    """package, line_no, line to typed columns; ``fields_ok`` and ``format_ok`` tell how that went. Columns ``kept`` stay."""
    parsed = lines.withColumn("r", F.from_json("line", RECORD)).withColumn("keys", F.json_object_keys("line"))
    kind = F.col("r.type")
    allowed = lambda fields: F.array(F.lit("type"), *[F.lit(f.strip("[]")) for f in fields.split()])
    present = lambda fields: [F.col(f"r.{f}").isNotNull() for f in fields.split() if f[0] != "["]
    ok = F.lit(False)
    for name, fields in FIELDS.items():
        whole = F.size(F.array_except("keys", allowed(fields))) == 0
        for c in present(fields):
            whole = whole & c
        ok = F.when(kind == name, whole).otherwise(ok)
    once = F.size(F.array_distinct("keys")) == F.size("keys")
    typed = {c: S.parse_quantity(F.col(f"r.{c}")) for c in _QUANTITIES} | {c: S.parse_fixed(F.col(f"r.{c}"), 32) for c in _HASHES}
    typed |= {"address": S.parse_fixed(F.col("r.address"), 20), "balance": S.parse_u256(F.col("r.balance")), "bytes": S.parse_data(F.col("r.bytes"))}
    typed |= {"exists": F.col("r.exists"), "schema": F.col("r.schema"), "mode": F.col("r.mode")}
    read = F.lit(True)
    for c, value in typed.items():
        read = read & (F.col(f"r.{c}").isNull() | value.isNotNull())
    columns = [value.alias(c) for c, value in typed.items()]
    return parsed.select("package", "line_no", kind.alias("type"), F.coalesce(ok & once, F.lit(False)).alias("fields_ok"), F.coalesce(read, F.lit(False)).alias("format_ok"), *columns, *kept)


def _failed(rules: dict[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])))


def package_violations(records: DataFrame, schema: str) -> DataFrame:
    """package, rule, line_no of everything wrong with decoded packages (line_no null: with the package as a whole).

    ``records`` are read several times, and counted for the number of tasks that packages are dealt to: ``ROWS`` records
    each, so that what a task sorts doesn't grow with the number of packages.
    """
    shares = max(records.sparkSession.sparkContext.defaultParallelism, -(-records.count() // ROWS))
    by_line = Window.partitionBy("package").orderBy("line_no")
    so_far, before = by_line.rowsBetween(Window.unboundedPreceding, 0), by_line.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("type")
    is_event = kind.isin("account", "storage", "code")
    of = lambda t, c: F.when(kind == t, F.col(c))
    n_of = lambda t, w: F.coalesce(F.sum(F.when(kind == t, 1).otherwise(0)).over(w), F.lit(0))
    # what is sorted: of state and code only what the rules ask about them
    state = [F.col(c).isNull() for c in ("nonce", "balance", "code_hash")]
    asked = ("schema", "mode", "anchor_number", "anchor_hash", "preceding_number", "preceding_hash", "number", "hash", "parent_hash", "block", "address", "incarnation", "slot", "exists", "event_count")
    flags = [(state[0] | state[1] | state[2]).alias("lacking"), ~(state[0] & state[1] & state[2]), F.octet_length("bytes").alias("code_bytes")]
    flags[1] = flags[1].alias("stated")
    r = records.select("package", "line_no", "type", "fields_ok", "format_ok", *asked, *flags).repartition(shares, "package").withColumns({
        "open_before": n_of("block", before) - n_of("block_end", before), "current": F.last(of("block", "number"), ignorenulls=True).over(so_far),
        "nth_block": n_of("block", so_far), "last_line": F.max("line_no").over(Window.partitionBy("package")), "first_line": F.min("line_no").over(Window.partitionBy("package")),
        "prev_number": F.last(of("block", "number"), ignorenulls=True).over(before), "prev_hash": F.last(of("block", "hash"), ignorenulls=True).over(before),
        "mode_": F.first(of("header", "mode"), ignorenulls=True).over(so_far), "preceding_hash_": F.first(of("header", "preceding_hash"), ignorenulls=True).over(so_far),
    })
    # the account and the storage line before, with their block: no sort beside that by line
    held = lambda t, *c: F.last(F.when(kind == t, F.struct("nth_block", F.struct(*c).alias("key"))), ignorenulls=True).over(before)
    r = r.withColumns({"_account": held("account", "address"), "_storage": held("storage", "address", "incarnation", "slot")})
    same_block = lambda c: F.when((kind == c[1:]) & (F.col(f"{c}.nth_block") == F.col("nth_block")), F.col(f"{c}.key"))
    block_events = F.sum(F.when(is_event, 1).otherwise(0)).over(Window.partitionBy("package", "nth_block"))
    r = r.withColumns({
        "prev_address": same_block("_account")["address"], "prev_storage": same_block("_storage"), "events": block_events,
    })
    here = F.struct("address", "incarnation", "slot")
    live = F.col("exists")
    lines = {
        "unknown or missing fields": ~F.col("fields_ok"), "malformed value": F.col("fields_ok") & ~F.col("format_ok"),
        "header not first or repeated": (kind == "header") != (F.col("line_no") == F.col("first_line")), "trailer not last": (kind == "trailer") != (F.col("line_no") == F.col("last_line")),
        "schema": (kind == "header") & (F.col("schema") != schema), "mode": (kind == "header") & ~F.col("mode").isin("anchor", "delta"),
        "anchor without number or hash": (kind == "header") & (F.col("mode") == "anchor") & (F.col("anchor_number").isNull() | F.col("anchor_hash").isNull()),
        "delta without preceding": (kind == "header") & (F.col("mode") == "delta") & (F.col("preceding_number").isNull() | F.col("preceding_hash").isNull()),
        "block_end missing": kind.isin("block", "trailer") & (F.col("open_before") != 0), "block_end without block": (kind == "block_end") & (F.col("open_before") != 1),
        "block_end of another block": (kind == "block_end") & (F.col("number") != F.col("current")),
        "blocks not contiguous": (kind == "block") & (F.col("number") != F.col("prev_number") + 1), "parent hash": (kind == "block") & (F.col("parent_hash") != F.col("prev_hash")),
        "first parent is not the preceding block": (kind == "block") & (F.col("nth_block") == 1) & (F.col("mode_") == "delta") & (F.col("parent_hash") != F.col("preceding_hash_")),
        "event outside its block": kind.isin("account", "storage") & ((F.col("open_before") != 1) | (F.col("block") != F.col("current"))), "code outside a block": (kind == "code") & (F.col("open_before") != 1),
        "accounts not sorted": (kind == "account") & (F.col("prev_address") > F.col("address")), "account repeated": (kind == "account") & (F.col("prev_address") == F.col("address")),
        "live account without state": (kind == "account") & live & F.col("lacking"),
        "tombstone with state": (kind == "account") & ~live & F.col("stated"),
        "storage not sorted": (kind == "storage") & (F.col("prev_storage") > here), "storage repeated": (kind == "storage") & (F.col("prev_storage") == here),
        "code too large": (kind == "code") & (F.col("code_bytes") > MAX_CODE),
        "event count": (kind == "block_end") & (F.col("event_count") != F.col("events")),
        "block beyond the signed range": (kind == "block") & (F.col("number") >= F.lit("9223372036854775808").cast("decimal(20,0)")),
    }
    found = r.select("package", "line_no", _failed(lines).alias("rule"))

    same_code = F.count("*").over(Window.partitionBy("package", "code_hash"))
    repeated = records.where("type = 'code'").select("package", "line_no", "code_hash").withColumn("n", same_code).where("n > 1")
    found = found.unionByName(repeated.select("package", "line_no", F.lit("code hash repeated").alias("rule")))

    codes = records.where("type = 'code' AND bytes IS NOT NULL").select("package", "line_no", "code_hash", keccak_of("bytes").alias("true_hash"))
    found = found.unionByName(codes.where("true_hash <> code_hash").select("package", "line_no", F.lit("code hash").alias("rule")))

    one = lambda t, c: F.max(of(t, c))
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("address", "slot", "value", "bytes", "balance")), F.lit(32))
    t = records.groupBy("package").agg(
        F.count("*").alias("lines"), F.sum(F.when(kind == "header", 1).otherwise(0)).alias("headers"), F.sum(F.when(kind == "trailer", 1).otherwise(0)).alias("trailers"),
        F.sum(F.when(kind == "block", 1).otherwise(0)).alias("blocks"), F.min(of("block", "number")).alias("first"), F.max(of("block", "number")).alias("last"),
        F.min_by(of("block", "hash"), of("block", "number")).alias("first_hash"), F.max_by(of("block", "hash"), of("block", "number")).alias("last_hash"),
        *[one("header", c).alias(c) for c in ("mode", "genesis_hash", "anchor_number", "anchor_hash", "preceding_number")], *[one("trailer", c).alias(c) for c in ("end_number", "end_hash", "block_count")],
        F.sum(F.when(is_event, size).otherwise(0)).alias("size"),
    )
    totals = {
        "fewer than three records": F.col("lines") < 3, "header missing": F.col("headers") == 0, "trailer missing": F.col("trailers") == 0, "no block": F.col("blocks") == 0,
        "trailer differs from the last block": (F.col("end_number") != F.col("last")) | (F.col("end_hash") != F.col("last_hash")) | (F.col("block_count") != F.col("blocks")),
        "anchor is not the first block": (F.col("mode") == "anchor") & ((F.col("anchor_number") != F.col("first")) | (F.col("anchor_hash") != F.col("first_hash"))),
        "block zero is not genesis": (F.col("first") == 0) & (F.col("first_hash") != F.col("genesis_hash")), "delta does not follow": (F.col("mode") == "delta") & (F.col("first") != F.col("preceding_number") + 1),
        "too many blocks": F.col("blocks") > MAX_BLOCKS, "too many bytes": F.col("size") > MAX_BYTES,
    }
    return found.unionByName(t.select("package", F.lit(None).cast("int").alias("line_no"), _failed(totals).alias("rule")))


def lifecycle(accounts: DataFrame, storage: DataFrame, anchor: bool | Column, zero: Column, inputs: list[str] | None = None) -> DataFrame:
    """Rows of ``storage`` (address, block, incarnation, value) that the accounts of the same input contradict, with ``rule``.

    The newest account record at or before a write must have its incarnation, and be live unless the write is zero. A
    write whose account the input doesn't have is an error in an anchor only. Columns ``inputs`` tell many inputs apart.
    """
    by = [*(inputs or []), "address"]
    own = accounts.select(*by, "block", "exists", "incarnation")
    met = as_of_join(storage, own, by, name="account")
    other = F.col("account.incarnation") != F.col("incarnation")
    dead = ~F.col("account.exists") & (F.col("value") != zero)
    absent = F.col("account").isNull() & (F.lit(anchor) if isinstance(anchor, bool) else anchor)
    rule = F.when(absent, "no_account").when(other, "incarnation").when(dead, "after_tombstone")
    return met.withColumn("rule", rule).where(F.col("rule").isNotNull()).drop("account")


def missing_code(accounts: DataFrame, codes: DataFrame) -> DataFrame:
    """Code hashes of live accounts that have code which isn't among ``codes``."""
    used = accounts.where(F.col("exists") & (F.col("code_hash") != F.unhex(F.lit(EMPTY_CODE.hex())))).select("code_hash").distinct()
    return used.join(codes, "code_hash", "left_anti")


def gaps(numbers: DataFrame, column: str, width: int = 1 << 16) -> DataFrame:
    """``column`` and the ``previous`` number of every one that doesn't follow its predecessor directly.

    Distinct numbers are windowed within ranges of ``width``; what a range begins after comes from the maxima of the
    ranges, of which there are few. So there is no window over all rows.
    """
    ranged = numbers.select(F.col(column), F.floor(F.col(column) / width).alias("_range"))
    ends = ranged.groupBy("_range").agg(F.max(column).alias("_end"))
    # an own copy of the few ranges: a window over them alone
    before = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_before"))
    within = F.lag(column).over(Window.partitionBy("_range").orderBy(column))
    rows = ranged.withColumn("_within", within).join(before, "_range").withColumn("previous", F.coalesce("_within", "_before"))
    return rows.where(F.col(column) != F.col("previous") + 1).select(column, "previous")
