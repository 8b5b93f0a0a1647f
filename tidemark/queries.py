"""Registered queries over the history that ``sources.events`` derives, with the SQL that DuckDB holds against them.

Hashes and keys are shown in lower-case hex. Queries named ``ext_`` have no counterpart among the reads of a
point-in-time archive; they are extensions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import bloom, scalars
from tidemark.functions.keccak import keccak_of
from tidemark.operators.asof import as_of_join
from tidemark.operators.lifetime import incarnations_of_flags
from tidemark.operators.snapshot import Snapshot
from tidemark.plans import levels
from tidemark.plans.store import stage
from tidemark.sources import events as E

#: Probes of the queries that don't take theirs from the events (``_events``), whatever the tables' size.
PROBES = 4000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The derived history in DuckDB; each query's SQL goes on from these.
HISTORY = r"""
ev AS (SELECT event_id, event_id // 10 AS block, user_id AS address, event_type, floor(abs(coalesce(value, 0.0)) * 100)::BIGINT AS cents FROM events),
chg AS (SELECT address, block, arg_max(event_type, event_id) AS last_type, count(*) AS n, sum(cents) AS cents FROM ev GROUP BY address, block),
flg AS (SELECT *, last_type <> 'error' AS ex, lag(last_type <> 'error') OVER (PARTITION BY address ORDER BY block) AS before FROM chg),
acc AS (
  SELECT address, block, ex AS "exists",
         (sum(CASE WHEN ex AND before IS NOT NULL AND (NOT before OR last_type = 'signup') THEN 1 ELSE 0 END) OVER w)::BIGINT AS incarnation,
         (CASE WHEN ex THEN sum(n) OVER w ELSE 0 END)::BIGINT AS nonce, (CASE WHEN ex THEN sum(cents) OVER w ELSE 0 END)::BIGINT AS balance,
         CASE WHEN ex THEN sha256(last_type) END AS code_hash
  FROM flg WINDOW w AS (PARTITION BY address ORDER BY block)),
sto AS (
  SELECT e.address, a.incarnation, e.event_type AS slot, e.block, CASE WHEN e.event_type = 'view' THEN 0 ELSE arg_max(e.cents, e.event_id) END AS value
  FROM ev e JOIN acc a ON a.address = e.address AND a.block = e.block AND a."exists" GROUP BY e.address, a.incarnation, e.event_type, e.block),
cod AS (SELECT sha256(event_type) AS code_hash, min(block) AS first_seen_block, event_type AS code FROM ev GROUP BY event_type),
head AS (SELECT max(event_id) // 10 AS head, max(user_id) AS top FROM events),
prb AS (
  SELECT i AS probe_id, (i * 37) % (top + 11) AS address, ['click', 'error', 'purchase', 'signup', 'view'][i % 5 + 1] AS slot, (i * 97) % (head + 1) AS block
  FROM range(0, 4000) r(i), head),
hit AS (
  SELECT p.*, a."exists" AS ex, a.incarnation, a.nonce, a.balance, a.code_hash
  FROM prb p ASOF LEFT JOIN acc a ON p.address = a.address AND p.block >= a.block)
"""


def _sql(body: str, *more: str) -> str:
    return "WITH " + ",".join([HISTORY, *more]) + body


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _snapshot(spark: SparkSession, sf_dir: str, strategy: str = "bucketed") -> tuple[Snapshot, DataFrame]:
    events = E.load(spark, sf_dir)
    head, top = events.agg(F.expr("max(event_id) div 10"), F.max("user_id")).first()
    pinned = Snapshot(E.account_versions(events), E.storage_versions(events), E.code_blobs(events), head, strategy=strategy)
    return pinned, E.probes(spark, PROBES, head, top)


def _asked(spark: SparkSession, sf_dir: str, strategy: str = "bucketed") -> tuple[Snapshot, DataFrame]:
    """``_snapshot`` for its probes alone: all events are read, but versions derived only of the addresses that are asked
    for. A version depends on its own address's events and on nothing else, so the probes find the same."""
    pinned, probes = _snapshot(spark, sf_dir, strategy)
    events = E.load(spark, sf_dir)
    own = events.join(F.broadcast(probes.select(F.col("address").alias("user_id")).distinct()), "user_id", "left_semi")
    return replace(pinned, accounts=E.account_versions(own), storage=E.storage_versions(own)), probes


_ACCOUNT_SQL = _sql("SELECT probe_id, address, block, ex AS \"exists\", incarnation, nonce, balance, code_hash FROM hit")


def _accounts(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    pinned, probes = _asked(spark, sf_dir, strategy)
    found = pinned.accounts_as_of(probes)
    return found.select("probe_id", "address", "block", *[f"account.{c}" for c in ("exists", "incarnation", "nonce", "balance", "code_hash")])


@query(_ACCOUNT_SQL)
def account_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir, "bucketed")


@query(_ACCOUNT_SQL)
def account_as_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir, "window")


@query(_ACCOUNT_SQL)
def account_as_of_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accounts(spark, sf_dir, "equi")


@query(_sql("SELECT probe_id, address, block, incarnation, nonce FROM hit WHERE ex"))
def account_as_of_live_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, probes = _asked(spark, sf_dir)
    return pinned.accounts_as_of(probes, live_only=True).select("probe_id", "address", "block", "account.incarnation", "account.nonce")


@query(_sql("SELECT probe_id, '0x' || lower(format('{:x}', CASE WHEN ex THEN balance ELSE 0 END)) AS balance FROM hit"))
def balance_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, probes = _asked(spark, sf_dir)
    live = F.when(F.col("account.exists"), F.col("account.balance")).otherwise(F.lit(0))
    return pinned.accounts_as_of(probes).select("probe_id", scalars.quantity(live).alias("balance"))


@query(_sql("SELECT probe_id, '0x' || lower(format('{:x}', CASE WHEN ex THEN nonce ELSE 0 END)) AS nonce FROM hit"))
def nonce_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, probes = _asked(spark, sf_dir)
    live = F.when(F.col("account.exists"), F.col("account.nonce")).otherwise(F.lit(0))
    return pinned.accounts_as_of(probes).select("probe_id", scalars.quantity(live).alias("nonce"))


_STORAGE = """
val AS (
  SELECT h.probe_id, h.address, h.slot, h.block, h.ex, s.value
  FROM (SELECT *, CASE WHEN ex THEN incarnation END AS inc FROM hit) h
  ASOF LEFT JOIN sto s ON h.address = s.address AND h.inc = s.incarnation AND h.slot = s.slot AND h.block >= s.block)"""


@query(_sql("SELECT probe_id, address, slot, block, coalesce(value, 0)::BIGINT AS value FROM val", _STORAGE))
def storage_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, probes = _asked(spark, sf_dir)
    return pinned.storage_as_of(probes, F.lit(0).cast("long")).select("probe_id", "address", "slot", "block", "value")


@query(_sql("""
SELECT h.probe_id, h.address, h.block, coalesce(c.code, '') AS code
FROM hit h LEFT JOIN cod c ON h.ex AND h.code_hash = c.code_hash AND c.first_seen_block <= h.block"""))
def code_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, probes = _asked(spark, sf_dir)
    return pinned.code_as_of(probes, F.lit("")).select("probe_id", "address", "block", "code")


#: Probes and hits like HISTORY's prb and hit, with one probe an event instead of PROBES in all.
_EVENT_PROBES = """
eprb AS (
  SELECT event_id AS probe_id, user_id + CASE WHEN event_id % 11 = 0 THEN top + 1 ELSE 0 END AS address, event_type AS slot, (event_id * 97) % (head + 1) AS block
  FROM events, head),
ehit AS (
  SELECT p.*, a."exists" AS ex, a.incarnation, a.nonce, a.balance, a.code_hash
  FROM eprb p ASOF LEFT JOIN acc a ON p.address = a.address AND p.block >= a.block)"""


def _event_snapshot(spark: SparkSession, sf_dir: str) -> tuple[Snapshot, DataFrame]:
    pinned, _ = _snapshot(spark, sf_dir)
    events = E.load(spark, sf_dir)
    return pinned, E.event_probes(events, pinned.head, events.agg(F.max("user_id")).first()[0])


@query(_sql('SELECT probe_id, address, block, ex AS "exists", incarnation, nonce, balance, code_hash FROM ehit', _EVENT_PROBES))
def account_as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``account_as_of`` with a probe an event."""
    pinned, probes = _event_snapshot(spark, sf_dir)
    return pinned.accounts_as_of(probes).select("probe_id", "address", "block", *[f"account.{c}" for c in ("exists", "incarnation", "nonce", "balance", "code_hash")])


@query(_sql("SELECT probe_id, address, slot, block, coalesce(value, 0)::BIGINT AS value FROM val", _EVENT_PROBES, _STORAGE.replace("FROM hit)", "FROM ehit)")))
def storage_as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``storage_as_of`` with a probe an event."""
    pinned, probes = _event_snapshot(spark, sf_dir)
    return pinned.storage_as_of(probes, F.lit(0).cast("long")).select("probe_id", "address", "slot", "block", "value")


@query(_sql("""
SELECT h.probe_id, h.address, h.block, coalesce(c.code, '') AS code
FROM ehit h LEFT JOIN cod c ON h.ex AND h.code_hash = c.code_hash AND c.first_seen_block <= h.block""", _EVENT_PROBES))
def code_as_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code_as_of`` with a probe an event."""
    pinned, probes = _event_snapshot(spark, sf_dir)
    return pinned.code_as_of(probes, F.lit("")).select("probe_id", "address", "block", "code")


@query(_sql("""
SELECT address, block, "exists", incarnation, nonce, balance FROM acc, head WHERE block <= head // 2
QUALIFY row_number() OVER (PARTITION BY address ORDER BY block DESC) = 1"""))
def ext_snapshot_accounts_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, _ = _snapshot(spark, sf_dir)
    return pinned.accounts_at(pinned.head // 2).select("address", "block", "exists", "incarnation", "nonce", "balance")


@query(_sql("""
SELECT s.address, s.incarnation, s.slot, s.block, s.value FROM (
  SELECT sto.* FROM sto, head WHERE block <= head // 2 QUALIFY row_number() OVER (PARTITION BY address, incarnation, slot ORDER BY block DESC) = 1) s
JOIN (SELECT address, incarnation, "exists" FROM acc, head WHERE block <= head // 2
      QUALIFY row_number() OVER (PARTITION BY address ORDER BY block DESC) = 1) a ON s.address = a.address AND s.incarnation = a.incarnation AND a."exists" """))
def ext_snapshot_storage_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, _ = _snapshot(spark, sf_dir)
    return pinned.storage_at(pinned.head // 2).select("address", "incarnation", "slot", "block", "value")


@query(_sql("SELECT * FROM acc WHERE address % 10 = 3"))
def ext_key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, _ = _snapshot(spark, sf_dir)
    return pinned.history(F.col("address") % 10 == 3)


@query(_sql("SELECT * FROM acc"))
def ext_key_history_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of every key; ``ext_key_history`` returns a tenth of them."""
    pinned, _ = _snapshot(spark, sf_dir)
    return pinned.history(F.lit(True))


@query(_sql('SELECT address, block, "exists", incarnation FROM acc'))
def lifetime_incarnations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.account_versions(E.load(spark, sf_dir)).select("address", "block", "exists", "incarnation")


@query(_sql("""
SELECT address, block, (sum(CASE WHEN before IS NOT NULL AND NOT before AND ex THEN 1 ELSE 0 END + CASE WHEN ex AND before AND last_type = 'signup' THEN 1 ELSE 0 END)
  OVER (PARTITION BY address ORDER BY block))::BIGINT AS incarnation, true AS consistent FROM flg"""))
def lifetime_from_replay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("exists").over(Window.partitionBy("address").orderBy("block"))
    flags = E.changes(E.load(spark, sf_dir)).withColumn("previous_exists", F.coalesce(before, F.lit(False))).withColumn("wiped", F.col("last_type") == "signup")
    return incarnations_of_flags(flags).select("address", "block", "incarnation", "consistent")


def _faulty_storage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Accounts, and every event as a write under incarnation 0 and zero for views: some of it is wrong on purpose."""
    events = E.load(spark, sf_dir)
    writes = E.blocked(events).select("address", "block", F.lit(0).cast("long").alias("incarnation"), F.col("event_type").alias("slot"), F.when(F.col("event_type") == "view", 0).otherwise(F.col("cents")).alias("value"))
    return E.account_versions(events), writes


@query(_sql("""
SELECT CASE WHEN a.incarnation <> 0 THEN 'incarnation' ELSE 'after_tombstone' END AS rule, count(*)::BIGINT AS n
FROM (SELECT address, block, CASE WHEN event_type = 'view' THEN 0 ELSE cents END AS value FROM ev) w JOIN acc a USING (address, block)
WHERE a.incarnation <> 0 OR (NOT a."exists" AND w.value <> 0) GROUP BY 1"""))
def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.validate import lifecycle

    accounts, writes = _faulty_storage(spark, sf_dir)
    found = lifecycle(accounts, writes.select(*writes.columns), anchor=False, zero=F.lit(0))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(_sql("""SELECT DISTINCT a.code_hash FROM acc a, head WHERE a."exists" AND NOT EXISTS (SELECT 1 FROM cod c WHERE c.code_hash = a.code_hash AND c.code <> 'purchase')"""))
def missing_code_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = E.load(spark, sf_dir)
    held = E.code_blobs(events).where("code <> 'purchase'")
    return E.account_versions(events).where("exists").select("code_hash").distinct().join(held, "code_hash", "left_anti")


@query(_sql("SELECT address, block // 2 AS block, count(*)::BIGINT AS n FROM acc GROUP BY address, block // 2 HAVING count(*) > 1"))
def duplicate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halving the block numbers makes versions collide; finds every (key, block) that has more than one."""
    halved = E.account_versions(E.load(spark, sf_dir)).select("address", F.expr("block div 2").alias("block"))
    return halved.groupBy("address", "block").agg(F.count("*").alias("n")).where("n > 1")


@query(_sql("SELECT block, previous FROM (SELECT block, lag(block) OVER (ORDER BY block) AS previous FROM (SELECT DISTINCT block FROM ev WHERE event_type = 'signup')) WHERE block <> previous + 1"))
def block_contiguity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with a signup whose predecessor in that list isn't the block before: gaps, found without a global sort."""
    blocks = E.blocked(E.load(spark, sf_dir)).where("event_type = 'signup'").select("block").distinct()
    from tidemark.operators.validate import gaps

    return gaps(blocks, "block")


@query(_sql("SELECT block, count(*)::BIGINT AS events, count(DISTINCT address)::BIGINT AS accounts FROM ev GROUP BY block"))
def block_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.blocked(E.load(spark, sf_dir)).groupBy("block").agg(F.count("*").alias("events"), F.countDistinct("address").alias("accounts"))


@query(_sql("SELECT event_id, block, address FROM (SELECT *, lag(address) OVER (PARTITION BY block ORDER BY event_id) AS before FROM ev) WHERE before >= address"))
def sort_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = Window.partitionBy("block").orderBy("event_id")
    rows = E.blocked(E.load(spark, sf_dir)).withColumn("before", F.lag("address").over(ordered))
    return rows.where("before >= address").select("event_id", "block", "address")


@query(_sql("SELECT block // 10 AS epoch, count(DISTINCT address)::BIGINT AS keys, count(*)::BIGINT AS versions FROM acc GROUP BY block // 10"))
def distinct_keys_per_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.account_versions(E.load(spark, sf_dir)).withColumn("epoch", F.expr("block div 10"))
    return rows.groupBy("epoch").agg(F.countDistinct("address").alias("keys"), F.count("*").alias("versions"))


_HEAVY = 40


@query(_sql(f"SELECT address, count(*)::BIGINT AS keys FROM (SELECT DISTINCT address, incarnation, slot FROM sto) GROUP BY address HAVING count(*) > {_HEAVY}"))
def heavy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage groups with more than 40 keys (production: HEAVY_GROUP)."""
    keys = E.storage_versions(E.load(spark, sf_dir)).select("address", "incarnation", "slot").distinct()
    return keys.groupBy("address").agg(F.count("*").alias("keys")).where(F.col("keys") > _HEAVY)


def _address(c: str):
    return F.unhex(F.lpad(F.hex(F.col(c)), 40, "0"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account and storage keys in bytes: addresses padded to 20, slots hashed to 32."""
    events = E.load(spark, sf_dir)
    accounts = E.account_versions(events).select(scalars.account_key(_address("address")).alias("key"))
    storage = E.storage_versions(events).select(scalars.storage_key(_address("address"), F.col("incarnation"), scalars.digest(F.col("slot"))).alias("key"))
    return accounts.unionByName(storage)


_KEYS = """
keys AS (
  SELECT DISTINCT '01' || lpad(format('{:x}', address), 40, '0') AS k FROM acc
  UNION SELECT DISTINCT '02' || lpad(format('{:x}', address), 40, '0') || lpad(format('{:x}', incarnation), 16, '0') || sha256(slot) FROM sto)"""


@query(_sql("SELECT k AS key, length(k) // 2 AS bytes FROM keys", _KEYS))
def key_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir).distinct()
    return keys.select(F.lower(F.hex("key")).alias("key"), F.octet_length("key").cast("long").alias("bytes"))


@query(_sql("SELECT ('0x' || substr(sha256(unhex(k)), 1, 1))::INT AS part, count(*)::BIGINT AS keys FROM keys GROUP BY 1", _KEYS))
def hash_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir).distinct()
    return keys.groupBy(scalars.partition_of(F.col("key")).alias("part")).agg(F.count("*").alias("keys"))


@query(_sql("""
SELECT k AS key, (('0x' || substr(sha256(unhex(substr(k, 3, 40))), 1, 8))::UBIGINT & 15)::BIGINT AS address_shard,
       (('0x' || substr(sha256(unhex(k)), 33, 8))::UBIGINT & 15)::BIGINT AS spill_shard FROM keys""", _KEYS))
def shard_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, shards = F.col("key"), F.lit(16)
    return _keys(spark, sf_dir).distinct().select(F.lower(F.hex("key")).alias("key"), scalars.address_shard(key, shards).alias("address_shard"), scalars.spill_shard(key, shards).alias("spill_shard"))


@query("SELECT CAST(NULL AS VARCHAR) AS key WHERE false")
def bloom_no_false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the history that its own summary denies: none."""
    keys = stage(_keys(spark, sf_dir).distinct(), "bloom-keys")
    shards = keys.agg(scalars.shard_count(F.count("*"))).first()[0]
    summary = bloom.build_summary(keys, shards, heavy=20)
    return bloom.may_contain(keys, summary, shards).where("NOT may_contain").select(F.lower(F.hex("key")).alias("key"))



_LAYOUT_SQL = f"""
WITH runs AS (
  SELECT e AS epochs, i::INT AS slot, (4 * 8 ** i)::BIGINT * ((e // 4 // (8 ** i)::BIGINT) % 8) AS weight, 8 - i AS ord FROM range(0, 601) a(e), range(0, {levels.LEVELS}) b(i)
  UNION ALL SELECT e, -1, 1, 8 + n FROM range(0, 601) a(e), range(1, 4) b(n) WHERE n <= e % 4)
SELECT epochs, slot, weight, (sum(weight) OVER w - weight)::BIGINT AS first, (sum(weight) OVER w - 1)::BIGINT AS last
FROM runs WHERE weight > 0 WINDOW w AS (PARTITION BY epochs ORDER BY ord)
"""


@query(_LAYOUT_SQL)
def level_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a drained archive after every number of epochs up to 600."""
    return levels.layout(spark.range(601).withColumnRenamed("id", "epochs"))


_RUNS = """
n AS (SELECT head // 10 + 1 AS e FROM head),
runs AS (
  SELECT i::INT AS slot, (4 * 8 ** i)::BIGINT * ((e // 4 // (8 ** i)::BIGINT) % 8) AS weight, 8 - i AS ord FROM n, range(0, 8) b(i)
  UNION ALL SELECT -1, 1, 8 + k FROM n, range(1, 4) b(k) WHERE k <= e % 4),
ivl AS (SELECT slot, weight, (sum(weight) OVER (ORDER BY ord) - weight)::BIGINT AS first, (sum(weight) OVER (ORDER BY ord) - 1)::BIGINT AS last FROM runs WHERE weight > 0)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs = E.head_block(E.load(spark, sf_dir)) // E.BLOCKS_PER_EPOCH + 1
    return levels.layout(spark.range(epochs, epochs + 1).withColumnRenamed("id", "epochs")).drop("epochs")


@query(_sql("""
SELECT slot, weight, first, last, count(a.block)::BIGINT AS versions, count(DISTINCT a.address)::BIGINT AS keys
FROM ivl LEFT JOIN acc a ON a.block // 10 BETWEEN first AND last GROUP BY slot, weight, first, last""", _RUNS))
def run_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's runs with the versions and distinct keys each holds. There are a few runs whatever the data."""
    runs = F.broadcast(_intervals(spark, sf_dir))
    rows = E.account_versions(E.load(spark, sf_dir)).select("address", F.expr("block div 10").alias("epoch"))
    held = runs.join(rows, F.col("epoch").between(F.col("first"), F.col("last")))
    return held.groupBy("slot", "weight", "first", "last").agg(F.count("*").alias("versions"), F.countDistinct("address").alias("keys"))


@query(_sql("SELECT probe_id, block, (SELECT count(*) FROM ivl WHERE first * 10 <= block)::BIGINT AS runs FROM prb", _RUNS))
def run_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs a probe has to consider: those that begin at or before its block."""
    _, probes = _snapshot(spark, sf_dir)
    starts = _intervals(spark, sf_dir).agg(F.collect_list("first").alias("starts"))
    listed = starts.first()["starts"]
    older = F.filter(F.array(*[F.lit(s) for s in listed]), lambda s: s * E.BLOCKS_PER_EPOCH <= F.col("block"))
    return probes.select("probe_id", "block", F.size(older).cast("long").alias("runs"))


_COST = """
cost AS (
  SELECT p.probe_id, 1 + (SELECT count(*) FROM ivl WHERE first * 10 <= p.block AND (h.found IS NULL OR last * 10 + 9 >= h.found)) + CASE WHEN h.found IS NULL THEN 0 ELSE 3 END AS gets
  FROM prb p JOIN (SELECT p2.probe_id, a.block AS found FROM prb p2 ASOF LEFT JOIN acc a ON p2.address = a.address AND p2.block >= a.block) h USING (probe_id))"""


@query(_sql("""
SELECT count(*)::BIGINT AS samples, max(gets)::BIGINT AS most, quantile_disc(gets, 0.5)::BIGINT AS p50, quantile_disc(gets, 0.99)::BIGINT AS p99 FROM cost""", _RUNS, _COST))
def probe_cost_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a cold account lookup, newest run first: head, a summary a run until the hit, and three in that run."""
    from tidemark.plans.probe import account_reads, quantiles

    pinned, probes = _snapshot(spark, sf_dir)
    runs = [(r["first"] * 10, r["last"] * 10 + 9) for r in _intervals(spark, sf_dir).collect()]
    found = as_of_join(probes, pinned.accounts, ["address"], name="account").withColumn("found", F.col("account.block"))
    return quantiles(found.withColumn("gets", account_reads(runs)))


@query(_sql('SELECT address, block, "exists", incarnation, nonce, balance FROM acc'))
def merge_runs_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the archive merged again: every version once, none dropped."""
    from tidemark.plans.merge import merge_runs

    rows = E.account_versions(E.load(spark, sf_dir)).drop("code_hash")
    runs = [(r["first"] * 10, r["last"] * 10 + 9) for r in _intervals(spark, sf_dir).collect()]
    parts = [rows.where(F.col("block").between(a, b)) for a, b in runs]
    return merge_runs(parts, ["address"])


@query(_sql("""
SELECT probe_id, ex AS "exists", nonce, incarnation FROM hit"""))
def compaction_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads from merged runs as from the versions themselves."""
    pinned, probes = _snapshot(spark, sf_dir)
    merged = merge_runs_versions(spark, sf_dir)
    found = as_of_join(probes, merged, ["address"], name="account")
    return found.select("probe_id", "account.exists", "account.nonce", "account.incarnation")


@query("""
WITH listed AS (SELECT 'objects/' || event_id AS key, event_id % 50 AS age, event_id * 3 % 1000 AS size FROM events),
live AS (SELECT 'objects/' || event_id AS key FROM events WHERE event_type = 'purchase')
SELECT count(*) FILTER (WHERE key IN (SELECT key FROM live))::BIGINT AS live, count(*) FILTER (WHERE key NOT IN (SELECT key FROM live) AND age >= 10)::BIGINT AS deleted,
       sum(size) FILTER (WHERE key NOT IN (SELECT key FROM live) AND age >= 10)::BIGINT AS deleted_bytes, count(*) FILTER (WHERE key NOT IN (SELECT key FROM live) AND age < 10)::BIGINT AS kept_young
FROM listed""")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.gc import report, sweep

    events = E.load(spark, sf_dir)
    key = F.concat(F.lit("objects/"), F.col("event_id").cast("string")).alias("key")
    listed = events.select(key, (F.col("event_id") % 50).alias("age"), (F.col("event_id") * 3 % 1000).alias("size"))
    return report(sweep(listed, events.where("event_type = 'purchase'").select(key), F.col("age") >= 10))


_SELECTORS = ("latest", "safe", "finalized", "earliest", "pending", "0x0", "0x1f", "17", "0x00", "0xffffff", "junk", "-1")


@query("""
WITH head AS (SELECT max(event_id) // 10 AS head FROM events),
s AS (SELECT * FROM (VALUES ('latest', NULL), ('safe', NULL), ('finalized', NULL), ('earliest', 0), ('pending', -1), ('0x0', 0), ('0x1f', 31), ('17', -1), ('0x00', -1), ('0xffffff', 16777215), ('junk', -1), ('-1', -1)) v(selector, n)),
r AS (SELECT selector, coalesce(n, head)::BIGINT AS b, head FROM s, head)
SELECT selector, CASE WHEN b BETWEEN 0 AND head THEN b END AS block, (CASE WHEN b < 0 THEN -32602 WHEN b > head THEN -32001 END)::INT AS error_code FROM r""")
def selector_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned, _ = _snapshot(spark, sf_dir)
    given = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in _SELECTORS])).alias("selector"))
    return pinned.resolved(given).select("selector", "block", "error_code")


@query(_sql("""
SELECT probe_id AS request_id, m AS method,
  CASE m WHEN 'eth_getBalance' THEN '0x' || format('{:x}', CASE WHEN h.ex THEN h.balance ELSE 0 END) WHEN 'eth_getTransactionCount' THEN '0x' || format('{:x}', CASE WHEN h.ex THEN h.nonce ELSE 0 END)
         WHEN 'eth_getCode' THEN coalesce(c.code, '0x') WHEN 'eth_getStorageAt' THEN coalesce(v.value, 0)::VARCHAR WHEN 'eth_blockNumber' THEN '0x' || format('{:x}', head) END AS result,
  (CASE WHEN m = 'eth_getProof' THEN -32601 END)::INT AS error_code
FROM (SELECT *, ['eth_getBalance', 'eth_getTransactionCount', 'eth_getCode', 'eth_getStorageAt', 'eth_blockNumber', 'eth_getProof'][probe_id % 6 + 1] AS m FROM hit) h
JOIN val v USING (probe_id) LEFT JOIN cod c ON h.ex AND h.code_hash = c.code_hash AND c.first_seen_block <= h.block, head""", _STORAGE))
def rpc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of requests is a table of them; each row gets its answer or its error code."""
    pinned, probes = _asked(spark, sf_dir)
    methods = F.array(*[F.lit(m) for m in ("eth_getBalance", "eth_getTransactionCount", "eth_getCode", "eth_getStorageAt", "eth_blockNumber", "eth_getProof")])
    asked = probes.select(F.col("probe_id").alias("request_id"), F.element_at(methods, (F.col("probe_id") % 6 + 1).cast("int")).alias("method"), "address", "slot", scalars.quantity(F.col("block")).alias("selector"))
    return pinned.answer(asked)


@query("SELECT o_orderkey, '0x' || format('{:x}', o_orderkey * 7919) AS wire, (o_orderkey * 7919)::DECIMAL(20,0) AS number FROM orders")
def quantity_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = scalars.quantity(F.col("o_orderkey") * 7919)
    rows = E.load(spark, sf_dir, "orders").select("o_orderkey", wire.alias("wire"))
    return rows.withColumn("number", scalars.parse_quantity(F.col("wire")))


@query("SELECT p_partkey, '0x' || regexp_replace(sha256(p_name), '^0+', '') AS wire, lpad(regexp_replace(sha256(p_name), '^0+', ''), 64, '0') AS value FROM part")
def u256_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = scalars.quantity_u256(scalars.digest(F.col("p_name")))
    rows = E.load(spark, sf_dir, "part").select("p_partkey", wire.alias("wire"))
    return rows.withColumn("value", F.lower(F.hex(scalars.parse_u256(F.col("wire")))))


_WRITTEN = ("0x0", "0x1", "0x00", "0x01", "0xff", "0xFF", "0x", "ff", "0xffffffffffffffff", "0x10000000000000000", "0x+1", " 0x1", "0x8000000000000000")


@query("""
WITH w AS (SELECT unnest(['0x0', '0x1', '0x00', '0x01', '0xff', '0xFF', '0x', 'ff', '0xffffffffffffffff', '0x10000000000000000', '0x+1', ' 0x1', '0x8000000000000000']) AS wire)
SELECT wire, CASE WHEN regexp_full_match(wire, '0x(0|[1-9a-f][0-9a-f]{0,15})') THEN wire::UBIGINT::DECIMAL(20,0) END AS number,
       CASE WHEN regexp_full_match(wire, '0x(0|[1-9a-f][0-9a-f]{0,15})') AND wire::UBIGINT < 9223372036854775808 THEN wire::UBIGINT::BIGINT END AS block FROM w""")
def quantity_parse_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in _WRITTEN])).alias("wire"))
    return rows.select("wire", scalars.parse_quantity(F.col("wire")).alias("number"), scalars.parse_block(F.col("wire")).alias("block"))


@query("SELECT n::BIGINT AS keys, greatest(1, 2 ** ceil(log2(greatest(1, ceil(n / 32768.0)))))::BIGINT AS shards FROM (SELECT unnest([0, 1, 32768, 32769, 65536, 65537, 131073, 1000000]) AS n)")
def summary_shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(n).cast("long") for n in (0, 1, 32768, 32769, 65536, 65537, 131073, 1000000)])).alias("keys"))
    return rows.select("keys", scalars.shard_count(F.col("keys")).alias("shards"))


@query("""
WITH o AS (SELECT unnest([NULL, 0, 1, 2, 3, 4]) AS n),
g AS (SELECT u.unit, s.size, a.n AS a, b.n AS b, u.unit || '=' || coalesce(a.n::VARCHAR, '') || '-' || coalesce(b.n::VARCHAR, '') AS header FROM o a, o b, range(0, 4) s(size), (VALUES ('bytes'), ('lines')) u(unit)),
r AS (SELECT *, unit = 'bytes' AND (a IS NOT NULL OR b IS NOT NULL) AND (a IS NULL OR b IS NULL OR b >= a) AS sound,
             CASE WHEN a IS NULL THEN least(b, size) ELSE least(coalesce(b, size - 1), size - 1) - a + 1 END AS len FROM g)
SELECT header, size, CASE WHEN NOT sound THEN 'ignore' WHEN len <= 0 THEN 'unsatisfiable' ELSE 'satisfiable' END AS verdict,
       (CASE WHEN sound AND len > 0 THEN coalesce(a, size - len) END)::BIGINT AS "offset", (CASE WHEN sound AND len > 0 THEN len END)::BIGINT AS length FROM r""")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every range header with bounds up to four, or without one or both, asks of objects of up to three bytes."""
    bounds = F.array(F.lit(""), *[F.lit(str(n)) for n in range(5)])
    grid = spark.range(4).select(F.col("id").alias("size"), F.explode(bounds).alias("a")).withColumn("b", F.explode(bounds)).withColumn("unit", F.explode(F.array(F.lit("bytes"), F.lit("lines"))))
    rows = grid.select("size", F.concat("unit", F.lit("="), "a", F.lit("-"), "b").alias("header"))
    return rows.withColumn("r", scalars.parse_range(F.col("header"), F.col("size"))).select("header", "size", "r.*")


@query("SELECT c_custkey, 'objects/sha256/' || substr(sha256(c_name), 1, 2) || '/' || sha256(c_name) AS key FROM customer")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content addresses, sent through percent-encoding and back."""
    key = scalars.object_key(F.sha2("c_name", 256))
    return E.load(spark, sf_dir, "customer").select("c_custkey", scalars.decode_cas_key(F.replace(key, F.lit("/"), F.lit("%2F"))).alias("key"))


@query()
def keccak_code_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keccak-256 of every part's name: no SQL engine at hand has it."""
    return E.load(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(keccak_of(F.encode("p_name", "UTF-8")))).alias("code_hash"))


@query(_sql("""
SELECT rule, count(*)::BIGINT AS n FROM (
  SELECT 'event count' AS rule FROM (SELECT DISTINCT block FROM acc) WHERE block % 7 = 0
  UNION ALL SELECT 'tombstone with state' FROM acc WHERE NOT "exists" AND block % 13 = 0
  UNION ALL SELECT 'blocks not contiguous' FROM (SELECT block, lag(block) OVER (PARTITION BY block // 10 ORDER BY block) AS p FROM (SELECT DISTINCT block FROM acc)) WHERE block <> p + 1
  UNION ALL SELECT 'parent hash' FROM (SELECT block, lag(block) OVER (PARTITION BY block // 10 ORDER BY block) AS p FROM (SELECT DISTINCT block FROM acc)) WHERE block <> p + 1
  UNION ALL SELECT 'delta does not follow' FROM head WHERE EXISTS (SELECT 1 FROM acc WHERE block = 0)
  UNION ALL SELECT 'accounts not sorted' WHERE false) GROUP BY rule"""))
def package_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by rule of the history written as one package an epoch, with counts and tombstones spoilt on purpose."""
    from tidemark.operators import validate
    from tidemark.sources.packages import SCHEMA
    from tidemark.sources.writing import package_lines

    events = E.load(spark, sf_dir)
    lines = package_lines(E.account_versions(events), E.BLOCKS_PER_EPOCH, shares=E.shares(events))
    number = lambda field: F.conv(F.substring(F.get_json_object("line", f"$.{field}"), 3, 16), 16, 10).cast("long")
    kind = F.get_json_object("line", "$.type")
    wrong_count = F.regexp_replace("line", '"event_count":"0x', '"event_count":"0x1')
    with_nonce = F.regexp_replace("line", "}$", ',"nonce":"0x1"}')
    dead = (kind == "account") & (F.get_json_object("line", "$.exists") == "false") & (number("block") % 13 == 0)
    spoilt = F.when((kind == "block_end") & (number("number") % 7 == 0), wrong_count).when(dead, with_nonce).otherwise(F.col("line"))
    records = stage(validate.decode(lines.withColumn("line", spoilt)), "records")
    return validate.package_violations(records, SCHEMA).groupBy("rule").agg(F.count("*").alias("n"))
