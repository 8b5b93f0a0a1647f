"""The archive: runs of versions in Parquet under one head, with publishing, compaction, verification and collection.

A run is a folder named by a digest of its interval and contents, with a table each of accounts, storage and codes. Rows
are dealt to 16 partitions by hash of address (code hash), so that an account and its storage lie together, and sorted
by (key, block) within files, which gives Parquet's statistics the shape of fences; keys get Parquet Bloom filters.
Files are written first and become visible only by the swap of the head, which is the one commit point. A run's digest
is made of its interval, its number of rows and the sum of their hashes, so reading it anew tells whether it changed.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.keccak import EMPTY_CODE
from tidemark.operators.asof import as_of_join
from tidemark.operators.snapshot import Snapshot
from tidemark.plans import gc, levels, probe
from tidemark.plans.merge import DuplicateVersion
from tidemark.plans.store import Conflict, HeadFile, Store, digest_of
from tidemark.sources.packages import Header, Package, Packages

MAGIC = "tidemark-head/1"
RETRIES = 32
TABLES = {"accounts": ["address"], "storage": ["address", "incarnation", "slot"], "codes": ["code_hash"]}
SCHEMAS = {
    "accounts": "address binary, block bigint, exists boolean, incarnation decimal(20,0), nonce decimal(20,0), balance binary, code_hash binary",
    "storage": "address binary, incarnation decimal(20,0), slot binary, block bigint, value binary",
    "codes": "code_hash binary, first_seen_block bigint, code binary",
}
AT = {"accounts": "block", "storage": "block", "codes": "first_seen_block"}
#: Blocks a range of a merged run, by which a hot key's versions spread.
BUCKET = 4096
#: Blocks a range of the runs that many packages are published as: a key has one version a block at most.
WIDE = 65536
#: Seconds: files younger than this may belong to a commit under way; a merge gives up before that.
GC_AGE, MERGE_DEADLINE = 3 * 3600, 2 * 3600


class Rejected(ValueError):
    """A transition the archive doesn't allow."""


@dataclass
class Archive:
    spark: SparkSession
    root: str
    chain_id: int

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.root)
        self.heads = HeadFile(self.store, self.chain_id)

    # --- reading

    def head(self) -> tuple[int, dict | None]:
        version, head = self.heads.read()
        if head is not None:
            check_head(head, self.chain_id)
        return version, head

    def table(self, name: str, runs: list[dict]) -> DataFrame:
        """A table of runs, oldest first. Only the runs given are opened."""
        each = [self.spark.read.schema(f"{SCHEMAS[name]}, part int").parquet(f"{self.root}/runs/{r['digest']}/{name}").drop("part") for r in runs]
        return reduce(DataFrame.unionByName, each)

    def snapshot(self, block: int | None = None) -> Snapshot:
        """Pinned to the present head; with ``block``, runs that begin later are not even opened."""
        _, head = self.head()
        if head is None:
            raise Rejected("the archive is empty")
        if block is not None and block > head["number"]:
            raise Rejected(f"block {block} is beyond head {head['number']}")
        runs = [r for r in runs_of(head) if block is None or r["start"] <= block]
        return Snapshot(*[self.table(t, runs) for t in TABLES], head["number"], self.chain_id, empty_hash=EMPTY_CODE, finalized=head.get("final", True))

    def describe(self) -> dict:
        """For health checks and gauges."""
        version, head = self.head()
        return {"generation": version, "published_block": head and head["number"], "runs": head and len(runs_of(head)), "manifest": head and digest_of(head)}

    # --- writing

    def _write_run(self, tables: dict[str, DataFrame], start: int, end: int, weight: int) -> dict:
        """Writes under a temporary name, checks that each (key, block) comes once, and renames to the digest.

        A table is dealt and sorted once, as its files are; the same pass tells repeats by the row before, counts the rows
        and adds up their hashes. Only the distinct keys of a merged run, whose versions may lie in several ranges of
        blocks, are counted by an aggregation of their own.
        """
        temporary = f"runs/{uuid.uuid4().hex}.tmp"
        counts, prints = {}, []
        for name, rows in tables.items():
            keys, at, columns = TABLES[name], AT[name], [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
            bucket = F.floor(F.col(at) / BUCKET) if weight > 1 else F.lit(0).cast("long")
            placed = rows.select(*columns).withColumns({"part": S.partition_of(F.col(keys[0])), "_range": bucket}).repartition("part", "_range")
            order = Window.partitionBy("part", "_range", *keys).orderBy(at)
            before = F.lag(at).over(order)
            seen = Observation()
            sorted_ = placed.withColumns({"_again": before == F.col(at), "_first": before.isNull()}).observe(
                seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash"), F.sum(F.col("_again").cast("long")).alias("again"), F.sum(F.col("_first").cast("long")).alias("keys")
            )
            writer = sorted_.drop("_again", "_first", "_range").write.partitionBy("part").option("compression", "zstd")
            for key in keys[:1]:
                writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
            writer.parquet(f"{self.root}/{temporary}/{name}")
            found = seen.get
            if name != "codes" and found["again"]:
                self.store.delete(temporary)
                raise DuplicateVersion(f"{name} has a key twice at one block")
            counts[name] = int(found["keys"] or 0)
            if weight > 1:
                counts[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{temporary}/{name}").select(*keys).distinct().count()
            prints.append(_print(name, found["rows"], found["hash"]))
        return self._named(temporary, start, end, weight, prints, sum(counts.values()))

    def _named(self, temporary: str, start: int, end: int, weight: int, prints: list[tuple], keys: int) -> dict:
        """Renames what was written to its digest."""
        digest = _digest(start, end, prints)
        if not self.store.rename_new(temporary, f"runs/{digest}"):
            # equal contents are there already; as they may be old, collection mustn't take them before the head's swap
            self.store.touch(f"runs/{digest}")
            if not self.store.exists(f"runs/{digest}") and not self.store.rename_new(temporary, f"runs/{digest}"):
                raise Conflict(f"run {digest} comes and goes")
            self.store.delete(temporary)
        return {"digest": digest, "start": start, "end": end, "weight": weight, "keys": keys, "shards": 1}

    def _write_runs(self, tables: dict[str, DataFrame], planned: list[dict]) -> list[dict]:
        """``_write_run`` for several runs, a job a table: rows (with ``run``, the number of theirs) are dealt by run and
        part, and each run's rows, hashes and keys are told apart in the one pass."""
        temporary = f"runs/{uuid.uuid4().hex}.tmp"
        nth = range(len(planned))
        folders = [f"runs/{uuid.uuid4().hex}.tmp" for _ in nth]
        prints, keys = [[] for _ in nth], [0 for _ in nth]
        for name, rows in tables.items():
            key, at, columns = TABLES[name], AT[name], [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
            dealt = rows.select("run", *columns).withColumns({"part": S.partition_of(F.col(key[0])), "_range": F.floor(F.col(at) / WIDE)}).repartition("run", "part", "_range")
            before = F.lag(at).over(Window.partitionBy("run", "part", "_range", *key).orderBy(at))
            marked = dealt.withColumns({"_again": F.coalesce(before == F.col(at), F.lit(False)), "_first": before.isNull(), "_hash": F.xxhash64(*columns).cast("decimal(38,0)")})
            seen, own = Observation(), lambda i: F.col("run") == i
            sums = [(F.count_if(own(i)).alias(f"rows{i}"), F.sum(F.when(own(i), F.col("_hash"))).alias(f"hash{i}")) for i in nth]
            observed = marked.observe(seen, F.count_if("_again").alias("again"), F.count_if(~F.col("run").between(0, len(planned) - 1)).alias("stray"), *[c for pair in sums for c in pair])
            writer = observed.drop("_again", "_first", "_hash", "_range").write.partitionBy("run", "part").option("compression", "zstd")
            writer.option(f"parquet.bloom.filter.enabled#{key[0]}", "true").parquet(f"{self.root}/{temporary}/{name}")
            found = seen.get
            if name != "codes" and found["again"]:
                self.store.delete(temporary)
                raise DuplicateVersion(f"{name} has a key twice at one block")
            if found["stray"]:
                self.store.delete(temporary)
                raise Rejected(f"{name} has rows at blocks of no run")
            for i in nth:
                prints[i].append(_print(name, found[f"rows{i}"], found[f"hash{i}"]))
            written = self.spark.read.schema(f"{SCHEMAS[name]}, run int").parquet(f"{self.root}/{temporary}/{name}")
            for r in written.select("run", *key).distinct().groupBy("run").count().collect():
                keys[r["run"]] += r["count"]
            for i in nth:
                self.store.place(f"{temporary}/{name}/run={i}", f"{folders[i]}/{name}")
        self.store.delete(temporary)
        return [self._named(folders[i], p["start"], p["end"], p["weight"], prints[i], keys[i]) for i, p in enumerate(planned)]

    def publish(self, package: Package, finalized: tuple[int, str] | None = None, observed: tuple[int, str, int] | None = None) -> bool:
        """Adds a package's changes; False if it is the head already. Nothing is visible before the head's swap.

        A gate must hold if one is given: the package ends at the ``finalized`` block, or at the ``observed`` one, whose
        number, hash and offset behind the tip are given and whose offset must be 0. What is published through the latter
        isn't final, and the head says so.
        """
        number, block_hash, state_root = package.last
        if package.chain_id != self.chain_id:
            raise Rejected(f"chain {package.chain_id} is not {self.chain_id}")
        if finalized is not None and finalized != (number, block_hash):
            raise Rejected("the package doesn't end at the finalized block")
        if observed is not None and observed != (number, block_hash, 0):
            raise Rejected("the package doesn't end at the observed block, without an offset")
        version, head = self.head()
        if head and (head["number"], head["hash"], head["input_sha256"]) == (number, block_hash, package.digest):
            return False
        self._check_transition(package, head)
        run = self._write_run({"accounts": package.accounts, "storage": package.storage, "codes": package.codes}, package.first[0], number, 1)
        for _ in range(RETRIES):
            new = {
                "magic": MAGIC, "chain_id": self.chain_id, "genesis": package.genesis, "number": number, "hash": block_hash, "state_root": state_root, "input_sha256": package.digest,
                "parent": version or None, "final": observed is None, "l0": [*(head["l0"] if head else []), run], "levels": head["levels"] if head else [],
            }
            check_head(new, self.chain_id)
            try:
                self.heads.compare_and_swap(version, new)
                return True
            except Conflict:
                version, head = self.head()  # a compactor may have been first: its layout is kept, another package's is not
                self._check_transition(package, head)
        raise Conflict("the head kept changing")

    def publish_all(self, packages: Packages) -> int:
        """Adds many packages that follow each other, as publishing and compacting one after the other would, with one
        swap of the head: the runs that are left in the end are written, once, and those between never are.

        Returns how many it added. Those up to the one that is the head, if that is among them, are there already. There
        is no gate here; what has to end at a finalized or observed block goes through ``publish``.
        """
        for _ in range(RETRIES):
            version, head = self.head()
            state = lambda p: (p.last[0], p.last[1], p.digest)
            at = next((i for i, p in enumerate(packages.headers) if head and state(p) == (head["number"], head["hash"], head["input_sha256"])), -1)
            fresh, before = packages.headers[at + 1 :], head
            if not fresh:
                return 0
            for p in fresh:
                if p.chain_id != self.chain_id:
                    raise Rejected(f"chain {p.chain_id} is not {self.chain_id}")
                self._check_transition(p, before, backlog=False)
                before = {"number": p.last[0], "hash": p.last[1], "genesis": p.genesis}
            l0, now = planned(head, fresh)
            todo = [r for r in [*reversed([r for r in now if r]), *l0] if not r["digest"]]
            starts = F.array(*[F.lit(r["start"]).cast("long") for r in todo])
            tables = {}
            for name in TABLES:
                rows = getattr(packages, name).where(F.col(AT[name]) >= fresh[0].first[0])
                rows = rows.withColumn("run", F.aggregate(starts, F.lit(-1), lambda n, s: n + (s <= F.col(AT[name])).cast("int")))  # noqa: B023
                for i, r in enumerate(todo):
                    if r["of"]:
                        rows = rows.unionByName(self.table(name, r["of"]).withColumn("run", F.lit(i)), allowMissingColumns=True)
                tables[name] = rows
            tables["codes"] = tables["codes"].groupBy("run", "code_hash").agg(F.min("first_seen_block").alias("first_seen_block"), F.min_by("code", "first_seen_block").alias("code"))
            runs = iter(self._write_runs(tables, todo))
            made = {id(r): run for r, run in zip(todo, runs, strict=True)}
            place = lambda r: made.get(id(r), r) if r else r
            last = fresh[-1]
            new = {
                "magic": MAGIC, "chain_id": self.chain_id, "genesis": last.genesis, "number": last.last[0], "hash": last.last[1], "state_root": last.last[2], "input_sha256": last.digest,
                "parent": version or None, "final": True, "l0": [place(r) for r in l0], "levels": [place(r) for r in now],
            }
            check_head(new, self.chain_id)
            try:
                self.heads.compare_and_swap(version, new)
                return len(fresh)
            except Conflict:
                continue  # a compactor or another writer was first: begin anew from what is there
        raise Conflict("the head kept changing")

    def _check_transition(self, package: Header, head: dict | None, backlog: bool = True) -> None:
        start, _, parent = package.first
        if package.mode == "anchor":
            if head is not None or start != 0 or int(parent, 16):
                raise Rejected("an anchor starts an empty archive at block 0")
        elif head is None or package.genesis != head["genesis"] or (start, package.preceding, parent) != (head["number"] + 1, (head["number"], head["hash"]), head["hash"]):
            raise Rejected("a delta continues the head")
        if backlog and head and len(head["l0"]) >= levels.BACKLOG:
            raise Rejected("backlog: compact first")

    def compact_once(self) -> bool:
        """Merges the oldest four new runs with every level they fill; False if there are fewer than four."""
        began = time.time()
        version, head = self.head()
        if head is None or len(head["l0"]) < levels.BUFFER:
            return False
        inputs = head["l0"][: levels.BUFFER]
        merged, level, weight, now = carried(inputs, head["levels"])
        # not merged here: writing a run deals and sorts its rows
        tables = {t: self.table(t, merged) for t in ("accounts", "storage")}
        tables["codes"] = self.table("codes", merged).groupBy("code_hash").agg(F.min("first_seen_block").alias("first_seen_block"), F.min_by("code", "first_seen_block").alias("code"))
        now[level] = self._write_run(tables, merged[0]["start"], merged[-1]["end"], weight)
        for _ in range(RETRIES):
            if time.time() - began > MERGE_DEADLINE:
                raise Conflict("the merge took too long to be sure of its inputs")
            try:
                new = {**head, "parent": version, "l0": head["l0"][levels.BUFFER :], "levels": now}
                check_head(new, self.chain_id)
                self.heads.compare_and_swap(version, new)
                return True
            except Conflict:
                version, head = self.head()  # newer packages may have been added behind
                if head["l0"][: levels.BUFFER] != inputs:
                    raise
        raise Conflict("the head kept changing")

    def compact(self) -> int:
        n = 0
        while self.compact_once():
            n += 1
        return n

    # --- maintenance

    def reachable(self, keep_heads: int) -> set[str]:
        version, head = self.heads.read()
        live, left = set(), keep_heads
        while head is not None:
            live |= {f"runs/{r['digest']}" for r in runs_of(head)}
            version = head["parent"] or 0
            head = self.heads.at(version) if left > 0 and version else None
            left -= 1
        return live

    def collect_garbage(self, keep_heads: int = 2, min_age: float = GC_AGE, dry_run: bool = False) -> dict:
        """Deletes runs, and what crashed writers left of some, that no kept head reaches, and heads beyond ``keep_heads``.

        What is reachable is marked before and after listing, and once more before the first deletion; what is young is
        spared, by its age when listed and again when its turn comes.
        """
        cutoff = int((time.time() - min_age) * 1000)
        live = self.reachable(keep_heads)
        listed = self.store.list("runs", temporary=True)
        live |= self.reachable(keep_heads)
        rows = self.spark.createDataFrame(listed or [("", 0, 0)], "key string, size long, modified long").where("key <> ''")
        marked = self.spark.createDataFrame([(k,) for k in live] or [("",)], "key string")
        swept = gc.sweep(rows, marked, F.col("modified") <= cutoff)
        out = gc.report(swept).first().asDict()
        doomed = [r["key"] for r in swept.where("state = 'doomed'").select("key").collect()]  # a manifest's worth of runs
        version, _ = self.heads.read()
        old = [k for k, _, m in self.store.list(self.heads.folder) if m <= cutoff and k < self.heads.key(max(version - keep_heads, 1))]
        out["heads"] = len(old)
        if not dry_run:
            again = self.reachable(keep_heads)
            for key in [*doomed, *old]:
                modified = self.store.modified(key)
                if key not in again and modified is not None and modified <= cutoff:
                    self.store.delete(key)
        return out

    def verify(self, deep: bool = False) -> dict:
        """The head is sound and its runs are there; ``deep`` (an extension) also reads every run and takes its digest anew."""
        _, head = self.head()
        if head is None:
            raise Rejected("the archive is empty")
        for run in runs_of(head):
            if not self.store.exists(f"runs/{run['digest']}"):
                raise Rejected(f"run {run['digest']} is missing")
            if deep:
                prints = []
                for name in TABLES:
                    rows = self.table(name, [run])
                    prints.append(_print(name, *rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()))
                if _digest(run["start"], run["end"], prints) != run["digest"]:
                    raise Rejected(f"run {run['digest']} holds other rows than were written")
        return {"number": head["number"], "runs": len(runs_of(head)), "keys": sum(r["keys"] for r in runs_of(head))}

    def refresh(self, pinned: Snapshot) -> Snapshot:
        """The newest snapshot, unless it would go back behind ``pinned``, or can't be had: then ``pinned`` itself."""
        try:
            newest = self.snapshot()
        except (Rejected, OSError, ValueError):
            return pinned
        return pinned if newest.head < pinned.head else newest

    def probe(self, samples: DataFrame) -> DataFrame:
        """Quantiles of the reads that cold lookups of samples (address, slot, block) would cost: the account, and where
        it is live and a slot is given, the slot. Samples beyond the head are ``errors``, and count in nothing else."""
        _, head = self.head()
        runs = runs_of(head)
        slotted = samples if "slot" in samples.columns else samples.withColumn("slot", F.lit(None).cast("binary"))
        sound = slotted.where(F.col("block").between(0, head["number"]))
        accounts = self.table("accounts", runs).select("address", "block", F.col("block").alias("at"), "exists", "incarnation")
        hit = as_of_join(sound, accounts, ["address"], name="hit").withColumn("incarnation", F.when(F.col("hit.exists"), F.col("hit.incarnation")))
        storage = self.table("storage", runs).select("address", "incarnation", "slot", "block", F.col("block").alias("at"))
        both = as_of_join(hit, storage, ["address", "incarnation", "slot"], name="held")
        asked = F.col("incarnation").isNotNull() & F.col("slot").isNotNull()
        costs = both.select("block", F.col("hit.at").alias("found"), asked.alias("asked"), F.col("held.at").alias("slot_found"))
        out = probe.quantiles(costs.withColumn("gets", probe.storage_reads([(r["start"], r["end"]) for r in runs])))
        errors = slotted.where(~F.coalesce(F.col("block").between(0, head["number"]), F.lit(False))).count()
        return out.withColumn("errors", F.lit(errors).cast("long"))


def _print(name: str, rows: int, mixed: object) -> tuple:
    return name, int(rows), str(int(mixed or 0))


def _digest(start: int, end: int, prints: list[tuple]) -> str:
    return hashlib.sha256(repr((start, end, prints)).encode()).hexdigest()


def carried(inputs: list[dict], now: list) -> tuple[list[dict], int, int, list]:
    """What the oldest new runs merge with, the level and weight of the run that becomes of it, and the levels without them."""
    level, weight, merged, now = 0, levels.BUFFER, list(inputs), list(now)
    while level < len(now) and now[level]:
        merged, weight = [now[level], *merged], weight + now[level]["weight"]
        now[level] = None
        if weight < levels.FAN * levels.unit(level):
            break
        level += 1
    while level >= len(now):
        now.append(None)
    return merged, level, weight, now


def planned(head: dict | None, packages: list[Header]) -> tuple[list[dict], list]:
    """Buffer and levels after packages have been published and compacted one after the other. Runs still to be written
    have no digest, and ``of``, the runs there are whose rows they take over."""
    l0, now = (list(head["l0"]), list(head["levels"])) if head else ([], [])
    held = lambda r: [r] if r["digest"] else r["of"]
    for p in packages:
        l0.append({"digest": None, "start": p.first[0], "end": p.last[0], "weight": 1, "of": []})
        while len(l0) >= levels.BUFFER:
            merged, level, weight, now = carried(l0[: levels.BUFFER], now)
            now[level] = {"digest": None, "start": merged[0]["start"], "end": merged[-1]["end"], "weight": weight, "of": [x for r in merged for x in held(r)]}
            l0 = l0[levels.BUFFER :]
    return l0, now


def runs_of(head: dict) -> list[dict]:
    """Oldest first: levels from the highest down, then the buffer."""
    return [r for r in reversed(head["levels"]) if r] + head["l0"]


def check_head(head: dict, chain_id: int) -> None:
    problems = []
    if head["magic"] != MAGIC or head["chain_id"] != chain_id:
        problems.append("magic or chain")
    if len(head["l0"]) > levels.BACKLOG or len(head["levels"]) > levels.LEVELS:
        problems.append("too many runs or levels")
    if any(r["weight"] != 1 for r in head["l0"]):
        problems.append("weight of a new run")
    for i, run in enumerate(head["levels"]):
        if run and (run["weight"] <= 0 or run["weight"] % levels.unit(i) or run["weight"] >= levels.FAN * levels.unit(i)):
            problems.append(f"weight on level {i}")
    runs = runs_of(head)
    ends = [-1] + [r["end"] for r in runs]
    if any(r["start"] != e + 1 for r, e in zip(runs, ends, strict=False)) or ends[-1] != head["number"]:
        problems.append("runs don't cover the blocks in order")
    if problems:
        raise Rejected("unsound head: " + ", ".join(problems))
