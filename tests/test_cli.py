"""Each verb of the command line, on one archive from its genesis on."""

from __future__ import annotations

import argparse
import json

import pytest

from tests import packages as P
from tidemark.__main__ import parsed, run


def test_verbs(spark, tmp_path):
    do = lambda *args: run(spark, parsed([str(a) for a in args]))
    block = {"number": "0x0", "hash": P.block_hash(0), "parentHash": P.ZERO, "stateRoot": P.ZERO, "timestamp": "0x5"}
    (tmp_path / "genesis.json").write_text(json.dumps({"config": {"chainId": 1}, "alloc": {P.PLAIN[2:]: {"balance": "0x7"}}}))
    (tmp_path / "block.json").write_text(json.dumps(block))
    made = do("anchor", "--genesis", tmp_path / "genesis.json", "--block", tmp_path / "block.json", "--output", tmp_path / "anchor")
    assert made["lines"] == 5
    store = ("--store", tmp_path / "store", "--chain-id", "0x1")
    assert do("archive", *store, "--input", f"{tmp_path}/anchor/part-*")["published"] is True
    for n in range(1, 4):
        (tmp_path / f"{n}.jsonl").write_text(P.text(P.records({n: [P.account(n, True, 0, nonce=n)]})))
        assert do("archive", *store, "--input", tmp_path / f"{n}.jsonl", "--finalized", f"{n}:{P.block_hash(n)}")["published_block"] == n
    assert do("archive", *store, "--input", tmp_path / "3.jsonl")["published"] is False
    assert do("compact", *store)["merges"] == 1
    assert do("verify", *store, "--deep") == {"number": 3, "runs": 1, "keys": 1}
    assert do("gc", *store, "--keep-heads", 0, "--min-age-seconds", 0, "--dry-run")["deleted"] == 4
    assert do("gc", *store, "--keep-heads", 0, "--min-age-seconds", 0)["deleted"] == 4
    samples = [{"address": P.PLAIN, "slot": P.COUNTER, "block": n} for n in (0, 3, 9)]
    (tmp_path / "samples.jsonl").write_text("\n".join(map(json.dumps, samples)))
    cost = do("probe", *store, "--input", tmp_path / "samples.jsonl")
    assert (cost["samples"], cost["errors"]) == (2, 1) and 1 < cost["most"] <= 8
    for wrong in ("1", "0x01", "0xA", "0x"):
        with pytest.raises((SystemExit, ValueError, argparse.ArgumentTypeError)):
            parsed(["verify", "--store", "x", "--chain-id", wrong])
