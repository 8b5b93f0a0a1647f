"""Command line: archive, compact, anchor, verify, gc and probe, each printing one JSON line."""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.plans.archive import GC_AGE, Archive
from tidemark.sources.genesis import genesis_anchor, write_package
from tidemark.sources.packages import SCHEMA, files, probe_samples, read_lines, read_package


def chain_id(text: str) -> int:
    """A canonical quantity: 0x and lower-case hex digits without leading zeros."""
    digits = text.removeprefix("0x")
    if not text.startswith("0x") or not digits or digits != f"{int(digits, 16):x}":
        raise argparse.ArgumentTypeError(f"{text!r} is not a canonical quantity")
    return int(digits, 16)


def parsed(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, about: str, store: bool = True) -> argparse.ArgumentParser:
        made = verbs.add_parser(name, help=about)
        if store:
            made.add_argument("--store", required=True, help="folder of the archive: a path or any URI Spark's file systems know")
            made.add_argument("--chain-id", type=chain_id, default="0x1")
        return made

    add = verb("archive", "validate a package and publish it")
    add.add_argument("--input", required=True)
    add.add_argument("--schema", default=SCHEMA)
    add.add_argument("--finalized", help="NUMBER:HASH of the block at which the package must end")
    verb("compact", "merge new runs into levels until none are left to merge").add_argument("--follow-seconds", type=float, help="go on, looking again this often")
    anchor = verb("anchor", "make the anchor package of a genesis allocation", store=False)
    for name in ("genesis", "block", "output"):
        anchor.add_argument(f"--{name}", required=True)
    anchor.add_argument("--schema", default=SCHEMA)
    verb("verify", "check the head and its runs").add_argument("--deep", action="store_true", help="read every run and take its digest anew")
    gc = verb("gc", "delete what no kept head reaches")
    gc.add_argument("--keep-heads", type=int, default=16)
    gc.add_argument("--min-age-seconds", type=float, default=GC_AGE)
    gc.add_argument("--dry-run", action="store_true")
    verb("probe", "what cold reads of samples (address, slot, block in JSON Lines) would cost").add_argument("--input", required=True)
    return parser.parse_args(args)


def run(spark: SparkSession, given: argparse.Namespace) -> dict:
    """What a verb did or found."""
    if given.verb == "anchor":
        lines = genesis_anchor(spark, Path(given.genesis).read_text(), Path(given.block).read_text(), given.schema)
        write_package(lines, given.output)
        return {"output": given.output, "lines": lines.count()}
    archive = Archive(spark, given.store, given.chain_id)
    if given.verb == "archive":
        ends = None
        if given.finalized:
            number, _, block_hash = given.finalized.partition(":")
            ends = (int(number, 16 if number.startswith("0x") else 10), block_hash.removeprefix("0x"))
        published = archive.publish(read_package(read_lines(files(spark, given.input)), given.schema), finalized=ends)
        return {"published": published, **archive.describe()}
    if given.verb == "compact":
        merges = archive.compact()
        while given.follow_seconds:
            time.sleep(given.follow_seconds)
            merges += archive.compact()
        return {"merges": merges, **archive.describe()}
    if given.verb == "verify":
        return archive.verify(deep=given.deep)
    if given.verb == "gc":
        return archive.collect_garbage(given.keep_heads, given.min_age_seconds, given.dry_run)
    return archive.probe(probe_samples(spark, given.input)).first().asDict()


def main(args: list[str] | None = None) -> None:
    given = parsed(args)
    print(json.dumps(run(SparkSession.builder.appName("tidemark").getOrCreate(), given)))


if __name__ == "__main__":
    main()
