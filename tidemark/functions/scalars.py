"""Wire formats, keys and routing as Column expressions. What doesn't parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Account, storage and code keys begin with these bytes.
ACCOUNT_TAG, STORAGE_TAG, CODE_TAG = "01", "02", "03"
#: Fixed values of the summaries: keys a shard, keys from which a group is heavy, hashes a key, bits a key.
SHARD_KEYS, HEAVY_GROUP, HASHES, BITS_PER_KEY = 32768, 4096, 11, 16
PARTITIONS = 16


def parse_fixed(text: Column, size: int) -> Column:
    """``0x`` and exactly 2 * size lower-case hex digits, to binary."""
    return F.when(text.rlike(f"^0x[0-9a-f]{{{2 * size}}}$"), F.unhex(F.substr(text, F.lit(3))))


def parse_data(text: Column) -> Column:
    return F.when(text.rlike("^0x(?:[0-9a-f]{2})*$"), F.unhex(F.substr(text, F.lit(3))))


def parse_quantity(text: Column) -> Column:
    """Canonical unsigned 64-bit quantity, to decimal(20,0)."""
    return F.when(text.rlike("^0x(?:0|[1-9a-f][0-9a-f]{0,15})$"), F.conv(F.substr(text, F.lit(3)), 16, 10).cast("decimal(20,0)"))


def parse_block(text: Column) -> Column:
    """A quantity as a block number; 2**63 and above are rejected."""
    number = parse_quantity(text)
    return F.when(number < F.lit("9223372036854775808").cast("decimal(20,0)"), number.cast("long"))


def parse_u256(text: Column) -> Column:
    return F.when(text.rlike("^0x(?:0|[1-9a-f][0-9a-f]{0,63})$"), F.unhex(F.lpad(F.substr(text, F.lit(3)), 64, "0")))


def quantity(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(number.cast("decimal(20,0)").cast("string"), 10, 16)))


def u256(number: Column) -> Column:
    """A decimal of up to 38 digits as 32 bytes."""
    wide, half = number.cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")
    digits = lambda n: F.lpad(F.conv(n.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0")
    return F.unhex(F.concat(F.lit("00" * 16), digits(F.floor(wide / half)), digits(wide % half)))


def quantity_u256(value: Column) -> Column:
    digits = F.regexp_replace(F.lower(F.hex(value)), "^0+", "")
    return F.concat(F.lit("0x"), F.when(digits == "", "0").otherwise(digits))


def data_hex(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def digest(value: Column) -> Column:
    return F.unhex(F.sha2(value, 256))


def object_key(digest_hex: Column) -> Column:
    return F.concat(F.lit("objects/sha256/"), F.substring(digest_hex, 1, 2), F.lit("/"), digest_hex)


def _bytes(hex_text: str) -> Column:
    return F.unhex(F.lit(hex_text))


def _be64(number: Column) -> Column:
    return F.unhex(F.lpad(F.conv(number.cast("decimal(20,0)").cast("string"), 10, 16), 16, "0"))


def account_key(address: Column) -> Column:
    return F.concat(_bytes(ACCOUNT_TAG), address)


def storage_key(address: Column, incarnation: Column, slot: Column) -> Column:
    return F.concat(_bytes(STORAGE_TAG), address, _be64(incarnation), slot)


def code_key(code_hash: Column) -> Column:
    return F.concat(_bytes(CODE_TAG), code_hash)


def encode_account(exists: Column, incarnation: Column, nonce: Column, balance: Column, code_hash: Column) -> Column:
    """81 bytes: exists, incarnation, nonce, balance, code hash; a tombstone is zero but for its incarnation."""
    zero = lambda n: _bytes("00" * n)
    live = F.concat(_bytes("01"), _be64(incarnation), _be64(nonce), balance, code_hash)
    return F.when(exists, live).otherwise(F.concat(zero(1), _be64(incarnation), zero(8), zero(32), zero(32)))


def decode_account(value: Column) -> Column:
    """Struct of exists, incarnation, nonce, balance, code_hash; null if it isn't 81 bytes or a tombstone isn't zero."""
    number = lambda at: F.conv(F.hex(F.substring(value, at, 8)), 16, 10).cast("decimal(20,0)")
    flag, rest = F.hex(F.substring(value, 1, 1)), F.hex(F.substring(value, 10, 72))
    sound = (F.octet_length(value) == 81) & ((flag == "01") | ((flag == "00") & (rest == "00" * 72)))
    live = flag == "01"
    return F.when(sound, F.struct(
        live.alias("exists"), number(2).alias("incarnation"), F.when(live, number(10)).alias("nonce"),
        F.when(live, F.substring(value, 18, 32)).alias("balance"), F.when(live, F.substring(value, 50, 32)).alias("code_hash"),
    ))


def partition_of(key: Column) -> Column:
    """One of 16 partitions: the top four bits of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 1), 16, 10).cast("int")


def group_of(key: Column) -> Column:
    """Tag and address; whole keys that are shorter."""
    return F.substring(key, 1, 21)


def _masked(digest_hex: Column, first_byte: int, shards: Column) -> Column:
    return F.conv(F.substring(digest_hex, 2 * first_byte + 1, 8), 16, 10).cast("long").bitwiseAND(shards.cast("long") - 1)


def address_shard(key: Column, shards: Column) -> Column:
    """Summary shard of the key's address; the tag doesn't take part, so an account and its storage share one."""
    return _masked(F.sha2(F.substring(key, 2, 20), 256), 0, shards)


def spill_shard(key: Column, shards: Column) -> Column:
    return _masked(F.sha2(key, 256), 16, shards)


def shard_count(keys: Column) -> Column:
    """Power of two that gives each shard at most SHARD_KEYS of ``keys``."""
    needed = F.greatest(F.lit(1), F.ceil(keys / SHARD_KEYS)).cast("long")
    return F.when(needed == 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(needed - 1))))


def shard_path(run_hex: Column, shards: Column, kind: Column, index: Column) -> Column:
    """``kind``: ``a`` for address shards, ``s`` for spill shards."""
    return F.concat(F.lit("summaries/"), run_hex, F.lit("/"), F.lower(F.lpad(F.hex(shards.cast("long")), 8, "0")), F.lit("/"), kind, F.lower(F.lpad(F.hex(index.cast("long")), 8, "0")))


def parse_slot(text: Column) -> Column:
    """32 bytes written in full, or a shorter hex number padded on the left."""
    strict = parse_fixed(text, 32)
    padded = F.when(text.rlike("^0x[0-9a-f]{1,64}$"), F.unhex(F.lpad(F.substr(text, F.lit(3)), 64, "0")))
    return F.when(F.length(text) == 66, strict).otherwise(padded)


def parse_checkpoint(text: Column) -> Column:
    """``NUMBER:0xHASH`` with the number in decimal or hex, as a struct of number and hash."""
    left, right = F.regexp_extract(text, "^([^:]*):", 1), F.regexp_extract(text, "^[^:]*:(.*)$", 1)
    number = F.coalesce(parse_block(left), F.when(left.rlike("^[0-9]{1,18}$"), left.cast("long")))
    block_hash = parse_fixed(right, 32)
    return F.when(number.isNotNull() & block_hash.isNotNull(), F.struct(number.alias("number"), block_hash.alias("hash")))


def parse_range(header: Column, size: Column) -> Column:
    """HTTP byte range as a struct of verdict (ignore, unsatisfiable, satisfiable), offset and length."""
    first, last = F.regexp_extract(header, "^bytes=([0-9]*)-", 1), F.regexp_extract(header, "^bytes=[0-9]*-([0-9]*)$", 1)
    number = lambda c: F.when(c != "", c.try_cast("decimal(20,0)"))
    a, b, n = number(first), number(last), size.cast("decimal(20,0)")
    sound = header.rlike("^bytes=(?:[0-9]+-[0-9]*|-[0-9]+)$") & F.coalesce(b >= a, F.lit(True))
    suffix = first == ""
    none = F.when(suffix, (b == 0) | (n == 0)).otherwise(a >= n)
    length = F.when(suffix, F.least(b, n)).otherwise(F.least(F.coalesce(b, n - 1), n - 1) - a + 1)
    offset = F.when(suffix, n - length).otherwise(a)
    verdict = F.when(~sound | sound.isNull(), "ignore").when(none, "unsatisfiable").otherwise("satisfiable")
    on = verdict == "satisfiable"
    return F.struct(verdict.alias("verdict"), F.when(on, offset).cast("long").alias("offset"), F.when(on, length).cast("long").alias("length"))


def decode_cas_key(encoded: Column) -> Column:
    """A percent-encoded object key of the exact shape ``objects/sha256/hh/<64 hex digits>``, else null."""
    plain = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return F.when(plain.rlike("^objects/sha256/([0-9a-f]{2})/\\1[0-9a-f]{62}$"), plain)
