"""The archive end to end: packages, publishing, reading back, compaction, collection, streaming."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import random
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from tests import packages as P
from tidemark.functions import scalars as S
from tidemark.operators import validate
from tidemark.operators.snapshot import BeyondHead, requests_of
from tidemark.plans import levels
from tidemark.plans.archive import Archive, Rejected, check_head
from tidemark.plans.merge import DuplicateVersion, duplicates, merge_runs
from tidemark.plans.store import Conflict, HeadFile, Store
from tidemark.sources.genesis import genesis_anchor
from tidemark.sources.packages import SCHEMA, InvalidPackage, files, package_from_text, read_lines, read_package, read_packages
from tidemark.streaming.ingest import ingest


def package(spark, blocks, **kw):
    return read_package(package_from_text(spark, P.text(P.records(blocks, **kw))))


def rules(spark, variants):
    """The rules that each variant breaks, all validated in one job."""
    raw = {name: P.text(rows).encode() for name, rows in variants.items()}
    frame = spark.createDataFrame([(v,) for v in raw.values()], "content binary")
    found = {}
    for r in validate.package_violations(validate.decode(read_lines(frame)), SCHEMA).collect():
        found.setdefault(r["package"], set()).add(r["rule"])
    return {name: found.get(hashlib.sha256(v).hexdigest(), set()) for name, v in raw.items()}


def ask(spark, snapshot, *asked):
    """Results or error codes of (method, selector, address, slot)."""
    rows = [(i, m, address, slot, selector) for i, (m, selector, address, slot) in enumerate(asked)]
    frame = spark.createDataFrame(rows, "request_id long, method string, address string, slot string, selector string")
    frame = frame.withColumn("address", S.parse_fixed(F.col("address"), 20)).withColumn("slot", S.parse_slot(F.col("slot")))
    return [r["error_code"] or r["result"] for r in snapshot.answer(frame).orderBy("request_id").collect()]


def test_package_rules(spark):
    good, follow = P.records(P.BEGINNING), P.records(P.SEQUEL)
    ended = next(i for i, r in enumerate(good) if r["type"] == "block_end")
    opened = max(i for i, r in enumerate(good) if r["type"] == "block_end")
    change = lambda kind, rows=good, **more: [{**r, **more} if r["type"] == kind else r for r in rows]
    lacking = lambda rows, kind, name: [{k: v for k, v in r.items() if r["type"] != kind or k != name} for r in rows]
    slot = P.storage(0, 0, P.COUNTER, P.word(7))
    broken = {
        "block_end missing": [r for r in good if r.get("number") != "0x1" or r["type"] != "block_end"],
        "block_end without block": good[: ended + 1] + good[ended:],
        "block_end of another block": change("block_end", number="0x0"),
        "unknown or missing fields": change("block_end", extra=1),
        "event count": change("block_end", event_count="0x9"),
        "schema": change("header", schema="other"),
        "mode": change("header", mode="other"),
        "malformed value": change("block", timestamp="0x00"),
        "code hash": change("code", bytes="0x0102"),
        "code outside a block": good[: opened + 1] + [P.code("0x", P.EMPTY_HASH)] + good[opened + 1 :],
        "parent hash": change("block", parent_hash=P.ZERO),
        "trailer differs from the last block": change("trailer", block_count="0x7"),
        "trailer missing": good[:-1],
        "trailer not last": [good[-1], *good],
        "header missing": good[1:],
        "header not first or repeated": [*good[:2], good[0], *good[2:]],
        "fewer than three records": good[:2],
        "no block": [good[0], good[-1], good[-1]],
        "live account without state": lacking(good, "account", "nonce"),
        "tombstone with state": [{**r, "nonce": "0x1"} if r.get("exists") is False else r for r in follow],
        "accounts not sorted": P.records({0: [P.account(0, True, 0, address=P.VAULT), P.account(0, True, 0)]}),
        "account repeated": P.records({0: [P.account(0, True, 0), P.account(0, True, 0)]}),
        "storage repeated": P.records({0: [P.account(0, True, 0), slot, slot]}),
        "storage not sorted": P.records({0: [P.account(0, True, 0), P.storage(0, 0, P.OWNER, P.word(7)), slot]}),
        "blocks not contiguous": P.records({0: [], 2: []}),
        "event outside its block": P.records({0: [P.account(7, True, 0)]}),
        "block zero is not genesis": change("header", genesis_hash=P.ZERO),
        "code hash repeated": P.records({0: [P.code(), P.code()]}),
        "code too large": P.records({0: [P.code("0x" + "5b" * ((1 << 20) + 1))]}),
        "anchor without number or hash": lacking(good, "header", "anchor_hash"),
        "anchor is not the first block": change("header", anchor_number="0x1"),
        "delta without preceding": lacking(follow, "header", "preceding_hash"),
        "delta does not follow": change("header", follow, preceding_number="0x1"),
        "first parent is not the preceding block": change("header", follow, preceding_hash=P.ZERO),
        "too many blocks": P.records({n: [] for n in range(1, 1002)}),
        "block beyond the signed range": change("block", number="0x8000000000000000"),
    }
    minimal = P.records({0: []})
    found = rules(spark, {"good": good, "follow": follow, "minimal": minimal, **broken})
    assert [found.pop(name) for name in ("good", "follow", "minimal")] == [set()] * 3
    assert [rule for rule, broke in found.items() if rule not in broke] == []


def test_too_many_bytes(spark, monkeypatch):
    monkeypatch.setattr(validate, "MAX_BYTES", 100)
    assert rules(spark, {"x": P.records(P.BEGINNING)}) == {"x": {"too many bytes"}}


def test_lifecycle_and_code_rules(spark):
    slot = P.storage(0, 0, P.COUNTER, P.word(7))
    with pytest.raises(InvalidPackage, match="incarnation"):
        package(spark, {0: [P.account(0, True, 1), slot]})
    with pytest.raises(InvalidPackage, match="no_account"):
        package(spark, {0: [slot]})
    with pytest.raises(InvalidPackage, match="after_tombstone"):
        package(spark, {1: [P.account(1, False, 0), P.storage(1, 0, P.COUNTER, P.word(7))]})
    with pytest.raises(InvalidPackage, match="code"):
        package(spark, {0: [P.account(0, True, 0, code_hash=P.CODE_HASH)]})
    package(spark, {1: [P.storage(1, 0, P.COUNTER, P.word(7))]})


def test_compressed_package_is_the_same(spark, tmp_path):
    raw = P.text(P.records(P.BEGINNING)).encode()
    (tmp_path / "a.jsonl").write_bytes(raw)
    (tmp_path / "b.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    lines = [[r["line"] for r in read_lines(files(spark, f"{tmp_path}/{name}")).orderBy("line_no").collect()] for name in ("a.jsonl", "b.zst")]
    assert lines == [raw.decode().splitlines()] * 2
    with pytest.raises(InvalidPackage, match="limit is 1000"):
        files(spark, str(tmp_path / "a.jsonl"), most=1000)


def test_reads_by_block(spark, tmp_path):
    """Inherited, zero, gone and reborn are told apart, at every block and after compaction alike."""
    archive = Archive(spark, str(tmp_path), 1)
    assert archive.publish(package(spark, P.BEGINNING)) is True
    before = archive.snapshot()
    assert archive.publish(package(spark, P.SEQUEL)) is True
    assert archive.publish(package(spark, P.SEQUEL)) is False
    get = lambda what, n, slot=None, of=P.VAULT: (f"eth_get{what}", n if isinstance(n, str) else hex(n), of, slot)
    wanted = {
        get("Balance", 0, of=P.PLAIN): hex(P.RICH), get("Balance", 3, of=P.PLAIN): hex(P.RICH), get("Balance", 4, of=P.PLAIN): "0x0", get("Balance", "latest"): "0x9",
        get("Balance", "earliest"): "0x0", get("Balance", 7, of=P.NOBODY): "0x0", get("Balance", '{"blockNumber":"0x3"}', of=P.PLAIN): hex(P.RICH),
        get("TransactionCount", 3, of=P.PLAIN): "0x3", get("TransactionCount", 4, of=P.PLAIN): "0x4", get("TransactionCount", 5): "0x0",
        get("Code", 0): "0x", get("Code", 4): P.CODE, get("Code", 6): "0x", get("Code", 7): P.CODE, get("Code", 7, of=P.PLAIN): "0x",
        get("StorageAt", 0, P.COUNTER): P.ZERO, get("StorageAt", 1, P.COUNTER): P.word(41), get("StorageAt", 2, "0x1"): P.word(42), get("StorageAt", 4, P.COUNTER): P.ZERO,
        get("StorageAt", 4, P.OWNER): P.word(0x5EED), get("StorageAt", 6, P.OWNER): P.ZERO, get("StorageAt", 7, P.OWNER): P.ZERO, get("StorageAt", 7, P.COUNTER): P.word(1),
        get("Balance", 8): -32001, get("Code", "0xffffffffffffffff"): -32001, get("Balance", "pending"): -32602, get("Balance", "7"): -32602, get("StorageAt", 7): -32602,
        get("Proof", 7): -32601, get("Balance", 7, of="0x12"): -32602, ("eth_blockNumber", None, None, None): "0x7", ("eth_chainId", None, None, None): "0x1", ("web3_clientVersion", None, None, None): "tidemark",
    }
    assert ask(spark, archive.snapshot(), *wanted) == list(wanted.values())
    with pytest.raises(BeyondHead):
        archive.snapshot().accounts_at(8)
    assert before.head == 2 and archive.refresh(before).head == 7
    newest = archive.snapshot()
    assert archive.refresh(dataclasses.replace(newest, head=9)).head == 9


def test_unfinal_publication_has_no_safe_block(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    with pytest.raises(Rejected):
        archive.publish(package(spark, P.BEGINNING), observed=(2, P.block_hash(2)[2:], 3))
    archive.publish(package(spark, P.BEGINNING), observed=(2, P.block_hash(2)[2:], 0))
    assert ask(spark, archive.snapshot(), *[("eth_getBalance", tag, P.PLAIN, None) for tag in ("safe", "finalized", "latest")]) == [-32001, -32001, hex(P.RICH)]


def test_json_rpc_bodies(spark):
    call = lambda i, method, *params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    bodies = ["{", "[]", "[" + ",".join(["1"] * 101) + "]", call(1, "eth_getBalance", P.PLAIN), json.dumps({"id": 1, "method": "eth_chainId"}), f"[{call(1, 'eth_chainId')}, {call('b', 'eth_getCode', P.PLAIN, {'blockNumber': '0x1'})}]"]
    found = requests_of(spark.createDataFrame(list(enumerate(bodies)), "body long, text string")).orderBy("body", "nth").collect()
    assert [(r["body"], r["error_code"]) for r in found] == [(0, -32700), (1, -32600), (2, -32600), (3, -32602), (4, -32600), (5, None), (5, None)]
    assert found[-1]["selector"] == '{"blockNumber":"0x1"}' and found[-1]["request_id"] == "b"


def test_transitions(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    with pytest.raises(Rejected):
        archive.publish(package(spark, {1: []}))
    archive.publish(package(spark, {0: [P.account(0, True, 0)]}))
    with pytest.raises(Rejected):
        archive.publish(package(spark, {2: []}))
    with pytest.raises(Rejected):
        archive.publish(package(spark, {0: []}))
    with pytest.raises(Rejected):
        Archive(spark, str(tmp_path), 2).publish(package(spark, {1: []}))
    with pytest.raises(Rejected):
        archive.publish(package(spark, {1: []}), finalized=(9, "00"))


def test_compaction_keeps_every_version_and_collection_only_garbage(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    for n in range(5):
        archive.publish(package(spark, {n: [P.account(n, True, 0, nonce=n)]}))
    before = sorted(map(tuple, archive.snapshot().accounts.select("block", "nonce").collect()))
    assert archive.compact() == 1
    _, head = archive.head()
    assert [r["weight"] for r in head["l0"]] == [1] and head["levels"][0]["weight"] == 4
    assert sorted(map(tuple, archive.snapshot().accounts.select("block", "nonce").collect())) == before
    assert archive.verify(deep=True)["runs"] == 2
    kept = archive.collect_garbage(keep_heads=0, min_age=3600)
    assert kept["deleted"] == 0 and kept["kept_young"] == 4
    dry = archive.collect_garbage(keep_heads=0, min_age=0, dry_run=True)
    assert archive.collect_garbage(keep_heads=0, min_age=0)["deleted"] == dry["deleted"] == 4
    assert archive.collect_garbage(keep_heads=0, min_age=0)["deleted"] == 0
    assert sorted(map(tuple, archive.snapshot().accounts.select("block", "nonce").collect())) == before
    samples = spark.createDataFrame([(bytes.fromhex(a[2:]), bytes.fromhex(P.COUNTER[2:]), n) for a, n in ((P.PLAIN, 4), (P.NOBODY, 2), (P.PLAIN, 5))], "address binary, slot binary, block long")
    cost = archive.probe(samples).first()
    assert cost["most"] <= 1 + 2 + 6 and (cost["samples"], cost["errors"]) == (2, 1)


def test_backlog(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    archive.publish(package(spark, {0: []}))
    version, head = archive.head()
    run = head["l0"][0]
    full = {**head, "number": 15, "hash": P.block_hash(15)[2:], "l0": [{**run, "start": n, "end": n} for n in range(16)]}
    archive.heads.compare_and_swap(version, full)
    with pytest.raises(Rejected, match="backlog"):
        archive.publish(package(spark, {16: []}))


def test_levels_are_base_eight_digits(spark):
    assert levels.weights(171) == {0: 8, 1: 160}
    rows = levels.layout(spark.createDataFrame([(171,)], "epochs long")).orderBy("first").collect()
    assert [(r["slot"], r["weight"]) for r in rows] == [(1, 160), (0, 8), (-1, 1), (-1, 1), (-1, 1)]
    assert [r["first"] for r in rows] == [0, 160, 168, 169, 170]


def test_head_swaps_once(spark, tmp_path):
    head = HeadFile(Store(spark, str(tmp_path)), 1)
    assert head.compare_and_swap(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        head.compare_and_swap(0, {"a": 2})
    assert head.compare_and_swap(1, {"a": 3}) == 2
    assert head.read() == (2, {"a": 3})
    store = Store(spark, str(tmp_path))
    store.put_immutable("objects/x", b"one")
    store.put_immutable("objects/x", b"one")
    with pytest.raises(Conflict):
        store.put_immutable("objects/x", b"two")
    with pytest.raises(ValueError):
        store.read("objects/x", 2)


def test_merge(spark):
    rng = random.Random(23)
    rows = sorted({(f"k{rng.randrange(9)}", rng.randrange(40)): rng.choice(["", "x", "yy"]) for _ in range(150)}.items())
    rows = [(k, n, v) for (k, n), v in rows]
    runs = [spark.createDataFrame([r for r in rows if a <= r[1] < b], "key string, block long, value string") for a, b in ((0, 7), (7, 30), (30, 40))]
    assert [tuple(r) for r in merge_runs(runs, ["key"], 1).collect()] == rows
    twice = duplicates(merge_runs([*runs, runs[1]], ["key"]), ["key"])
    assert twice.count() == sum(7 <= n < 30 for _, n, _ in rows)


def test_a_run_with_a_key_twice_is_not_written(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    made = package(spark, {0: [P.account(0, True, 0)]})
    with pytest.raises(DuplicateVersion):
        archive.publish(dataclasses.replace(made, accounts=made.accounts.unionByName(made.accounts)))
    assert archive.heads.read() == (0, None) and archive.store.list("runs", temporary=True) == []


def test_verify_reads_what_is_there(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    archive.publish(package(spark, P.BEGINNING))
    assert archive.verify(deep=True)["runs"] == 1
    _, head = archive.head()
    folder = f"{tmp_path}/runs/{head['l0'][0]['digest']}/storage"
    rows = [tuple(r) for r in archive.snapshot().storage.collect()]
    changed = spark.createDataFrame([(*r[:-1], b"\x11" * 32) for r in rows], archive.snapshot().storage.schema)
    changed.withColumn("part", S.partition_of(F.col("address"))).write.mode("overwrite").partitionBy("part").parquet(folder)
    assert archive.verify()["runs"] == 1
    with pytest.raises(Rejected, match="other rows"):
        archive.verify(deep=True)


def test_unsound_heads(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    archive.publish(package(spark, {0: []}))
    _, head = archive.head()
    run = head["l0"][0]
    unsound = {
        "weight of a new run": {"l0": [{**run, "weight": 2}]}, "weight on level 0": {"l0": [], "levels": [{**run, "weight": 3}]}, "weight on level 1": {"l0": [], "levels": [None, {**run, "weight": 4}]},
        "magic or chain": {"chain_id": 9}, "too many": {"l0": [{**run, "start": n, "end": n} for n in range(17)], "number": 16}, "in order": {"l0": [{**run, "start": 1}]},
    }
    for problem, change in unsound.items():
        with pytest.raises(Rejected, match=problem):
            check_head({**head, **change}, 1)


def test_a_package_published_during_a_merge_is_kept(spark, tmp_path, monkeypatch):
    """The compactor's swap fails, it sees only new packages behind its inputs, and puts its level before them."""
    archive, other = Archive(spark, str(tmp_path), 1), Archive(spark, str(tmp_path), 1)
    for n in range(4):
        archive.publish(package(spark, {n: [P.account(n, True, 0, nonce=n)]}))
    late, write = package(spark, {4: [P.account(4, True, 0, nonce=4)]}), archive._write_run
    monkeypatch.setattr(archive, "_write_run", lambda *a: (write(*a), other.publish(late))[0])
    assert archive.compact_once() is True
    _, head = archive.head()
    assert head["number"] == 4 and [r["weight"] for r in head["l0"]] == [1] and head["levels"][0]["weight"] == 4
    assert sorted(r["nonce"] for r in archive.snapshot().accounts.collect()) == [0, 1, 2, 3, 4]


def test_collection_spares_what_a_writer_counts_on(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    made = package(spark, P.BEGINNING)
    run = archive._write_run({"accounts": made.accounts, "storage": made.storage, "codes": made.codes}, 0, 2, 1)
    key, long_ago = f"runs/{run['digest']}", time.time() - 9000
    left = tmp_path / "runs" / "crashed.tmp"
    left.mkdir()
    for path in (tmp_path / key, left):
        os.utime(path, (long_ago, long_ago))
    again = archive._write_run({"accounts": made.accounts, "storage": made.storage, "codes": made.codes}, 0, 2, 1)
    assert again == run and archive.store.modified(key) > long_ago * 1000 + 1e6
    out = archive.collect_garbage(keep_heads=0, min_age=3600)
    assert (out["deleted"], out["kept_young"]) == (1, 1) and archive.store.exists(key) and not left.exists()
    archive.publish(made)
    assert archive.collect_garbage(keep_heads=0, min_age=0)["live"] == 1 and archive.verify(deep=True)["runs"] == 1


def test_old_heads_are_collected(spark, tmp_path):
    archive = Archive(spark, str(tmp_path), 1)
    for n in range(4):
        archive.publish(package(spark, {n: []}))
    assert archive.collect_garbage(keep_heads=1, min_age=0)["heads"] == 2
    assert [k[-7:] for k, *_ in archive.store.list(archive.heads.folder)] == ["03.json", "04.json"]
    assert archive.head()[0] == 4


def test_genesis(spark):
    holder, empty, twin = "0x" + "7c" * 20, "0x" + "0b" * 20, "0x" + "7d" * 20
    alloc = {holder[2:]: {"code": P.CODE, "storage": {P.OWNER: P.word(3), P.COUNTER: P.ZERO}}, empty[2:]: {"balance": hex(2**200)}, twin[2:]: {"nonce": "0x2", "code": P.CODE}}
    block = {"number": "0x0", "hash": P.block_hash(0), "parentHash": P.ZERO, "stateRoot": P.ZERO, "timestamp": "0x5"}
    genesis = {"config": {"chainId": 77}, "alloc": alloc}
    lines = [r["line"] for r in genesis_anchor(spark, json.dumps(genesis), json.dumps({"id": 1, "result": block})).collect()]
    made = read_package(package_from_text(spark, "\n".join(lines)))
    assert (made.mode, made.chain_id, made.last[0]) == ("anchor", 77, 0)
    accounts = {"0x" + bytes(r["address"]).hex(): r for r in made.accounts.collect()}
    assert set(accounts) == {holder, empty, twin} and int.from_bytes(accounts[empty]["balance"]) == 2**200 and accounts[twin]["nonce"] == 2
    assert [(bytes(r["slot"]).hex(), int.from_bytes(r["value"])) for r in made.storage.collect()] == [(P.OWNER[2:], 3)]
    assert [bytes(r["code"]) for r in made.codes.collect()] == [bytes(range(40))]
    wrong = [({**genesis, "alloc": {}}, block, "nobody"), ({"alloc": alloc}, block, "chainId"), (genesis, {**block, "number": "0x1"}, "0x1"), (genesis, {**block, "parentHash": P.word(1)}, "parent"), ({**genesis, "alloc": {"7c": {}}}, block, "0x7c"), (genesis, {"number": "0x0"}, "no hash")]
    for g, b, says in wrong:
        with pytest.raises(InvalidPackage, match=says):
            genesis_anchor(spark, json.dumps(g), json.dumps(b))


def test_streaming_publishes_each_package_once(spark, tmp_path, monkeypatch):
    """A batch that fails after its package was published runs again and adds nothing; late packages fail theirs."""
    folder = tmp_path / "in"
    folder.mkdir()
    archive = Archive(spark, str(tmp_path / "archive"), 1)
    run = lambda: ingest(spark, str(folder), archive, str(tmp_path / "checkpoint")).awaitTermination(120)
    for n in range(2):
        (folder / f"{n}.jsonl").write_text(P.text(P.records({n: [P.account(n, True, 0, nonce=n)]})))
        run()
    (folder / "2.jsonl").write_text(P.text(P.records({2: [P.account(2, True, 0, nonce=2)]})))
    publish = archive.publish
    monkeypatch.setattr(archive, "publish", lambda p: publish(p) and 1 / 0)
    with pytest.raises(Exception, match="ZeroDivision"):
        run()
    monkeypatch.setattr(archive, "publish", publish)
    run()
    assert archive.describe()["published_block"] == 2 and archive.describe()["generation"] == 3
    (folder / "9.jsonl").write_text(P.text(P.records({9: []})))
    with pytest.raises(Exception, match="continues the head"):
        run()


def test_the_stream_compacts_before_the_backlog_is_full(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(levels, "BACKLOG", 5)
    archive = Archive(spark, str(tmp_path / "archive"), 1)
    for n in range(6):
        (tmp_path / f"{n}.jsonl").write_text(P.text(P.records({n: [P.account(n, True, 0, nonce=n)]})))
        ingest(spark, f"{tmp_path}/*.jsonl", archive, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert archive.describe()["published_block"] == 5 and archive.describe()["runs"] < 6


def test_an_account_that_goes_and_comes_back(spark, tmp_path):
    """Five one-block packages, published and streamed: the same versions."""
    lives = [(True, 0), (True, 0), (False, 0), (True, 1), (True, 1)]
    texts = [P.text(P.records({n: [P.account(n, exists, life, nonce=n + 1, balance=100 * n)]})) for n, (exists, life) in enumerate(lives)]
    archive, streamed = Archive(spark, str(tmp_path / "a"), 1), Archive(spark, str(tmp_path / "s"), 1)
    (tmp_path / "in").mkdir()
    for n, text in enumerate(texts):
        archive.publish(read_package(package_from_text(spark, text)))
        (tmp_path / "in" / f"{n}.jsonl").write_text(text)
        ingest(spark, str(tmp_path / "in"), streamed, str(tmp_path / "checkpoint")).awaitTermination(120)
    archive.compact()
    found = [sorted(map(tuple, a.snapshot().accounts.select("block", "exists", "incarnation", "nonce").collect())) for a in (archive, streamed)]
    assert found[0] == found[1] == [(n, exists, life, n + 1 if exists else None) for n, (exists, life) in enumerate(lives)]


def _lives(folder, n, first=0, **kw):
    """One-block packages as files: an account that changes in each, and storage of it."""
    folder.mkdir(exist_ok=True)
    for i in range(first, n):
        rows = [P.account(i, True, 0, nonce=i, code_hash=P.CODE_HASH), P.storage(i, 0, P.COUNTER, P.word(i))]
        (folder / f"{i}.jsonl").write_text(P.text(P.records({i: rows + ([P.code()] if i % 3 == 0 else [])}, **kw)))


def test_many_packages_are_published_as_one_after_the_other_would(spark, tmp_path):
    """The same runs, by their digests, in one swap; what is there already isn't added, and a copy of a file counts once."""
    _lives(tmp_path / "in", 7)
    single, many = Archive(spark, str(tmp_path / "a"), 1), Archive(spark, str(tmp_path / "b"), 1)
    for i in range(7):
        single.publish(read_package(read_lines(files(spark, f"{tmp_path}/in/{i}.jsonl"))))
        single.compact()
    some = lambda names: read_packages(files(spark, f"{tmp_path}/in/{names}.jsonl"))
    with pytest.raises(Rejected, match="continues the head"):
        many.publish_all(some("[02]"))
    assert many.publish_all(some("[0-2]")) == 3
    (tmp_path / "in" / "copy.jsonl").write_text((tmp_path / "in" / "5.jsonl").read_text())
    assert many.publish_all(some("*")) == 4 and many.publish_all(some("*")) == 0
    runs = lambda a: (a.head()[1]["l0"], a.head()[1]["levels"])
    assert runs(many) == runs(single) and many.describe()["generation"] == 2
    many.verify(deep=True)


def test_many_packages_are_validated_each_for_itself(spark, tmp_path):
    _lives(tmp_path / "in", 3)
    (tmp_path / "in" / "1.jsonl").write_text(P.text(P.records({1: [P.account(1, True, 0), P.storage(1, 1, P.COUNTER, P.word(1))]})))
    with pytest.raises(InvalidPackage, match="storage lifecycle: incarnation"):
        read_packages(files(spark, f"{tmp_path}/in"))
    (tmp_path / "in" / "1.jsonl").write_text(P.text(P.records({1: [P.account(1, True, 0), P.account(1, True, 0)]})))
    with pytest.raises(InvalidPackage, match="account repeated"):
        read_packages(files(spark, f"{tmp_path}/in"))


def test_a_stream_of_many_packages_a_batch(spark, tmp_path):
    _lives(tmp_path / "in", 6)
    archive = Archive(spark, str(tmp_path / "archive"), 1)
    run = lambda: ingest(spark, str(tmp_path / "in"), archive, str(tmp_path / "checkpoint"), at_once=8).awaitTermination(120)
    run()
    assert archive.describe()["published_block"] == 5 and archive.describe()["generation"] == 1
    _lives(tmp_path / "in", 9, first=6)
    run()
    assert archive.describe()["published_block"] == 8 and archive.describe()["generation"] == 2
    assert archive.snapshot().accounts.count() == 9 and [r["first_seen_block"] for r in archive.snapshot().codes.collect()] == [0]


def test_packages_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    """What one task sorts is bounded by a number of records, not by the session's number of partitions."""
    records = validate.decode(package_from_text(spark, P.text(P.records(P.BEGINNING))))
    monkeypatch.setattr(validate, "ROWS", 1)
    found = validate.package_violations(records, SCHEMA)
    n = records.count()
    assert n > 8 and "hashpartitioning(package#" in found._jdf.queryExecution().toString()
    assert f", {n})" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 0
