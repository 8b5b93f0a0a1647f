"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has 64 bits, or a multiple: bit i is set if it is set in over half of the hashes of its word
shingles. Two fingerprints link at ``distance`` or fewer differing bits. To find links without comparing all pairs:

- Equal fingerprints are one from here on, so exact copies cost nothing.
- Fingerprints are cut into blocks. The anchors of a block are the 4,096 words of the binary Golay code of length 23,
  which covers everything within ``RADIUS`` = 3 (it is perfect: each point has exactly one anchor that near, its home),
  in some plans beside further bits that are taken as they are. Every fingerprint goes to all anchors within RADIUS +
  ``reach`` of its block. If x and y differ in at most ``reach`` bits of the block, y is so among those at x's home.
- Per anchor, those at home are compared with all that are there, bit for bit over the whole fingerprint. Anchors with
  many are dealt out as a grid of cells of at most ``CELL`` homes times ``CELL`` others, so no task holds more, whatever
  the skew. A cell returns the links of a spanning forest, not all pairs.

Plans (``Scheme``):

- ``FEW`` and ``MANY`` link four-word shingles' 64 bits at 4 differing bits, and miss none. FEW has three blocks, of
  which one differs in at most 4 // 3 = 1 bit: a fingerprint goes to one or six anchors a block, and meets one in 800 of
  all. MANY has two blocks of 23 + 9 bits, of which one differs in at most 2: a fingerprint goes to about 106 anchors a
  block, of two million, and meets one in 10,000 of all. Both find the same links, so which is taken is a matter of
  cost: from ``MANY_FROM`` distinct fingerprints on comparing costs more than replicating.
- ``SIMILAR`` is for texts whose five-word shingles have a Jaccard similarity of 0.8 or more. 256 bits tell similarities
  apart that 64 can't: at 0.8 a bit differs with probability 0.15 (arccos(2 J / (1 + J)) / pi), so 39 of 256 do, give
  or take six, and it links at 46. There are eleven blocks, any of which may bring two fingerprints together by differing
  little. This is an estimate of the similarity, not its value; README has the measured shares of pairs linked.

Components of the links then give each document the smallest doc_id it can reach.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; a null doc_id is the
smallest only where all of a component are null; rows that repeat a doc_id get results of their own; an empty table
gives no rows; other columns are ignored, and carried along by ``near_dedup``; very long texts are read piece by piece.
Wide fingerprints are told apart by 64 bits of their hash.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import once as once_a_worker
from tidemark.llm._shared import packed, ship, stage, unpacked
from tidemark.llm.components import components

ship(__name__)

SHINGLE, SEED = 4, 42
DISTANCE, RADIUS = 4, 3
CELL = 4000
PIECE = 1 << 22
#: Anchors up to which the table of those that are dealt out, of two numbers each, is sent to all executors.
FEW_ANCHORS = 1 << 16
#: Length, check bits and generator polynomial (x^11+x^9+x^7+x^6+x^5+x+1) of the binary Golay code.
GOLAY_LENGTH, GOLAY_CHECKS, GOLAY_GENERATOR = 23, 11, 0b101011100011


@dataclass(frozen=True)
class Scheme:
    """How texts are fingerprinted, linked and brought together. ``blocks``: lowest bit, bits in the code, bits as they are."""

    shingle: int
    words: int
    distance: int
    reach: int
    blocks: tuple[tuple[int, int, int], ...]

    @property
    def bits(self) -> list[str]:
        """The columns that hold a fingerprint; one of 64 bits is its own number."""
        return [f"b{i}" for i in range(self.words)] if self.words > 1 else ["fp"]

    @property
    def anchors(self) -> int:
        return sum(1 << GOLAY_LENGTH - GOLAY_CHECKS + exact for *_, exact in self.blocks)


FEW = Scheme(SHINGLE, 1, DISTANCE, DISTANCE // 3, ((0, 22, 0), (22, 21, 0), (43, 21, 0)))
MANY = Scheme(SHINGLE, 1, DISTANCE, DISTANCE // 2, ((0, 23, 9), (32, 23, 9)))
MANY_FROM = 20_000_000
SIMILAR = Scheme(5, 4, 46, 1, tuple((GOLAY_LENGTH * i, GOLAY_LENGTH, 0) for i in range(11)))
#: Odd multipliers that make further 64-bit hashes of a first one.
MIXERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _word_pieces(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The words in lists of bounded size, each beginning with the last words of the one before."""
    at, tail = 0, []
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = re.compile(rb"[\x20\x09-\x0d]").search(text, end)
            end = gap.start() if gap else len(text)
        found = tail + text[at:end].split()
        if found:
            yield found
        tail, at = found[len(found) - (size - 1) :] if len(found) >= size - 1 else found, end


def _widened(hashes: np.ndarray, words: int) -> np.ndarray:
    """One row of ``words`` 64-bit hashes for each hash, of which it is the first."""
    more = []
    for mixer in MIXERS[: words - 1]:
        x = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(mixer)
        more.append(x ^ (x >> np.uint64(29)))
    return np.stack([hashes, *more], axis=1)


def wide_fingerprint(text: str | None, size: int = SHINGLE, words: int = 1) -> np.ndarray:
    """SimHash as signed 64-bit numbers. bytes.lower and bytes.split know ASCII only, as is wanted here."""
    counts, total, few = np.zeros(64 * words, np.int64), 0, []
    for found in _word_pieces((text or "").encode("utf-8", "surrogatepass").lower(), size):
        if len(found) < size:
            few = found
            continue
        few = []
        runs = map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), np.uint64, len(found) - size + 1)
        total += len(hashes)
        for i in range(0, len(hashes), 1 << 16):
            rows = _widened(hashes[i : i + (1 << 16)], words)
            counts += np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    if not total and few:
        return _widened(np.array([xxhash.xxh64_intdigest(b" ".join(few), SEED)], np.uint64), words)[0].view(np.int64)
    return np.packbits(2 * counts > total, bitorder="little").view(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    return int(wide_fingerprint(text, size)[0])


def _printer(scheme: Scheme) -> Callable[[str], Column]:
    if scheme.words == 1:

        @F.pandas_udf(T.LongType())
        def narrow(texts: pd.Series) -> pd.Series:
            return pd.Series([fingerprint(t, scheme.shingle) for t in texts], dtype="int64")

        return narrow

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in scheme.bits]))
    def wide(texts: pd.Series) -> pd.DataFrame:
        rows = [wide_fingerprint(t, scheme.shingle, scheme.words) for t in texts]
        return pd.DataFrame(np.array(rows, np.int64).reshape(len(rows), scheme.words), columns=scheme.bits)

    return wide


def printed(docs: DataFrame, scheme: Scheme, *carried: str) -> DataFrame:
    """``carried``, the number ``fp`` of the text's fingerprint, and its bits where they are more than that."""
    given = docs.select(*carried, _printer(scheme)("text").alias("_bits"))
    if scheme.words == 1:
        return given.withColumnRenamed("_bits", "fp")
    number = F.xxhash64(*[F.col(f"_bits.{c}") for c in scheme.bits]).alias("fp")
    return given.select(*carried, number, "_bits.*")


def hex_of(fingerprint_column: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word, as a polynomial, by the generator: zero for the code's words."""
    left = words.astype(np.int64).copy()
    for bit in range(GOLAY_LENGTH - 1, GOLAY_CHECKS - 1, -1):
        left ^= np.where(left >> bit & 1, GOLAY_GENERATOR << bit - GOLAY_CHECKS, 0)
    return left


def _patterns(radius: int) -> list[np.ndarray]:
    """For each syndrome the patterns of at most ``radius`` bits that lead from such a word to an anchor, nearest first."""
    found: list[list[int]] = [[] for _ in range(1 << GOLAY_CHECKS)]
    for weight in range(radius + 1):
        masks = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(GOLAY_LENGTH), weight)], np.int64)
        for mask, syndrome in zip(masks.tolist(), _syndromes(masks).tolist(), strict=True):
            found[syndrome].append(mask)
    return [np.array(x, np.int64) for x in found]


def _part(prints: np.ndarray, low: int, bits: int) -> np.ndarray:
    """``bits`` bits from bit ``low`` on of each row of 64-bit words."""
    word, at = divmod(low, 64)
    found = prints[:, word] >> np.uint64(at)
    if at + bits > 64:
        found = found | prints[:, word + 1] << np.uint64(64 - at)
    return found.astype(np.int64) & ((1 << bits) - 1)


def anchors(prints: np.ndarray, scheme: Scheme = FEW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, at home) of every fingerprint's anchors in every block; a fingerprint is a row of 64-bit words."""
    prints = prints.view(np.uint64).reshape(len(prints), -1)
    index, key, home = [], [], []
    for block, (low, coded, exact) in enumerate(scheme.blocks):
        part = _part(prints, low, coded + exact)
        code, rest = part & ((1 << coded) - 1), part >> coded
        syndromes = _syndromes(code)
        for apart in range(min(scheme.reach, exact) + 1):
            masks = _anchor_table(RADIUS + scheme.reach - apart)[syndromes]
            at, nth = np.nonzero(masks >= 0)
            anchor = code[at] ^ masks[at, nth]
            for flipped in itertools.combinations(range(exact), apart):
                other = rest[at] ^ sum(1 << b for b in flipped)
                index.append(at)
                key.append((block << exact | other) << GOLAY_LENGTH | anchor)
                home.append((nth == 0) & (apart == 0))
    return np.concatenate(index), np.concatenate(key), np.concatenate(home)


def _anchor_table(radius: int) -> np.ndarray:
    def make() -> np.ndarray:
        patterns = _patterns(radius)
        table = np.full((len(patterns), max(map(len, patterns))), -1, np.int64)
        for i, x in enumerate(patterns):
            table[i, : len(x)] = x
        return table

    return once_a_worker(("anchors", radius), make)


def _rows(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for c in columns], axis=1)


def _replicated(scheme: Scheme) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fp and bits at every anchor of theirs."""

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["fp"] if scheme.words == 1 else ["fp", *scheme.bits]
        for batch in batches:
            whole = _rows(batch, columns)
            for i in range(0, len(whole), 5000):
                some = whole[i : i + 5000]
                index, key, home = anchors(np.ascontiguousarray(some[:, -scheme.words :]), scheme)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), *[pa.array(some[index, c]) for c in range(len(columns))]], ["anchor", "home", *columns])

    return replicate


def _counted(scheme: Scheme) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many are at home at each anchor, and there at all, of each batch."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _rows(batch, scheme.bits)
            for i in range(0, len(whole), 10_000):
                _, key, home = anchors(np.ascontiguousarray(whole[i : i + 10_000]), scheme)
                anchor, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.bincount(at, home).astype(np.int64)), pa.array(np.bincount(at).astype(np.int64))], ["anchor", "homes", "others"])

    return count


def spanning_links(homes: np.ndarray, others: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within homes and others, exactly what their links of up to ``distance`` bits join.

    Rows are a fingerprint's number and then its bits; a single column is both.
    """
    homes, others = homes.reshape(len(homes), -1), others.reshape(len(others), -1)
    bits = slice(1 if homes.shape[1] > 1 else 0, None)
    nodes, at = np.unique(np.concatenate([homes[:, 0], others[:, 0]]), return_inverse=True)
    home_at, other_at = at[: len(homes)], at[len(homes) :]
    label = np.arange(len(nodes))
    step = max(1, 2_000_000 // max(1, len(others)))
    mine, theirs = homes[:, bits].view(np.uint64), others[:, bits].view(np.uint64)
    for i in range(0, len(homes), step):
        apart = np.zeros((len(mine[i : i + step]), len(theirs)), np.uint16)
        for word in range(mine.shape[1]):
            apart += np.bitwise_count(mine[i : i + step, word, None] ^ theirs[None, :, word])
        x, y = np.nonzero(apart <= distance)
        x, y = home_at[i + x], other_at[y]
        while True:
            low = np.minimum(label[x], label[y])
            if (label[x] == low).all() and (label[y] == low).all():
                break
            for ends in (x, y, label[x], label[y]):
                np.minimum.at(label, ends, low)
            while (label != (up := label[label])).any():
                label = up
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[joined], nodes[label[joined]]


#: Roles of a row in a cell: compared with the others, being one of the others, or both.
HOME, OTHER = 1, 2


def _compared(scheme: Scheme) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted by cell, the rows of a cell follow each other, over any number of batches."""
    columns = ["fp"] if scheme.words == 1 else ["fp", *scheme.bits]

    def of(rows: list[np.ndarray]) -> pa.RecordBatch | None:
        cell = np.concatenate(rows)
        role, prints = cell[:, 1], np.ascontiguousarray(cell[:, 2:])
        homes, others = prints[role & HOME > 0], prints[role & OTHER > 0]
        if not len(homes) or not len(others):
            return None
        a, b = spanning_links(homes, others, scheme.distance)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        for batch in batches:
            rows = _rows(batch, ["cell", "role", *columns])
            parts = np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []
            for part in parts:
                if kept and kept[0][0, 0] != part[0, 0]:
                    if (found := of(kept)) is not None:
                        yield found
                    kept = []
                kept.append(part)
        if kept and (found := of(kept)) is not None:
            yield found

    return compare


def links(prints: DataFrame, scheme: Scheme = FEW) -> DataFrame:
    """Links a, b that connect what the links of all distinct fingerprints connect.

    Fingerprints are replicated where they are compared, and once before only to count: what has more than ``CELL`` rows
    at an anchor is told from the counts alone, so replicas are neither written nor shuffled twice.
    """
    columns = ["fp"] if scheme.words == 1 else ["fp", *scheme.bits]
    distinct = prints.select(*columns).distinct() if scheme.words == 1 else prints.select(*columns).dropDuplicates(["fp"])
    distinct = stage(distinct, "simhash-distinct")
    counts = distinct.select(*scheme.bits).mapInArrow(_counted(scheme), "anchor long, homes long, others long")
    sizes = counts.groupBy("anchor").agg(F.sum("homes").alias("homes"), F.sum("others").alias("others"))
    cells = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    grid = stage(sizes.where(F.greatest("homes", "others") > CELL).select("anchor", F.greatest(F.lit(1), cells("homes")).alias("down"), cells("others").alias("across")), "simhash-grid")
    fields = ", ".join(f"{c} long" for c in columns)
    placed = distinct.mapInArrow(_replicated(scheme), f"anchor long, home boolean, {fields}")
    met = placed.join(F.broadcast(grid) if scheme.anchors <= FEW_ANCHORS else grid, "anchor", "left")
    met = met.withColumns({"down": F.coalesce("down", F.lit(1)), "across": F.coalesce("across", F.lit(1))})
    met = met.withColumns({"i": F.pmod(F.hash("fp", F.lit(1)), F.col("down")), "j": F.pmod(F.hash("fp", F.lit(2)), F.col("across"))})
    here = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    down = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda i: here(i, F.col("j"), F.when(F.col("home") & (i == F.col("i")), HOME | OTHER).otherwise(OTHER)))
    across = F.transform(F.filter(F.sequence(F.lit(0), F.col("across") - 1), lambda j: F.col("home") & (j != F.col("j"))), lambda j: here(F.col("i"), j, F.lit(HOME)))
    dealt = met.select("anchor", *columns, F.explode(F.concat(down, across)).alias("c"))
    rows = dealt.select(F.xxhash64("anchor", "c.i", "c.j").alias("cell"), F.col("c.role").alias("role"), *columns)
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compared(scheme), "a long, b long")


def _named(prints: DataFrame, scheme: Scheme) -> DataFrame:
    """fp, its smallest doc_id ``first``, and root and component_id of its component, for every distinct fingerprint."""
    bits = [F.first(c).alias(c) for c in scheme.bits if c != "fp"]
    firsts = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), *bits), "simhash-first")
    if scheme is FEW and firsts.count() >= MANY_FROM:
        scheme = MANY
    roots = stage(components(links(firsts, scheme)), "simhash-roots")
    firsts = firsts.select("fp", "first")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    known = members.join(firsts, F.col("node") == F.col("fp")).select("fp", "root", "first")
    least = stage(known.groupBy("root").agg(F.min("first").alias("least")), "simhash-least")
    merged = stage(members.join(least, "root").select(F.col("node").alias("fp"), "root", "least"), "simhash-merged")
    named = firsts.join(merged, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    return stage(named, "simhash-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the component) of every row of ``docs``."""
    prints = stage(printed(docs, FEW, "doc_id"), "simhash-prints")
    return prints.join(_named(prints, FEW).select("fp", "component_id"), "fp")


def near_dedup(docs: DataFrame, scheme: Scheme = FEW) -> DataFrame:
    """One row of each group of near duplicates: of those with its smallest doc_id (null if it has no other), that with
    the least fingerprint and text. Rows of other groups don't matter to it, whether they share its doc_id or not."""
    prints = stage(printed(docs, scheme, "doc_id"), "simhash-prints")
    best = _named(prints, scheme).where(F.col("first").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("fp").alias("_fp"))
    several = stage(prints.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1"), "simhash-several")
    keep = best.join(several, F.col("component_id").eqNullSafe(F.col("doc_id")), "left")
    keep = stage(keep.select(F.col("component_id").alias("_keep"), "_fp", F.coalesce("rows", F.lit(1)).alias("_rows")), "simhash-kept")
    once = keep.groupBy("_keep").agg(F.max("_rows").alias("_rows"))
    out = packed(docs, "doc_id", "text").join(once.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_keep"))).drop("_keep")
    if keep.where("_rows > 1").limit(1).count():
        again = printed(out.where("_rows > 1"), scheme, "doc_id", "text", "_rest").select("doc_id", "text", "_rest", F.col("fp").alias("_print"))
        again = again.join(keep.select("_keep", "_fp"), F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("_print") == F.col("_fp")))
        least = F.min_by(F.struct("text", "_rest"), F.struct(F.col("text").isNotNull(), "text")).alias("_row")
        again = again.groupBy("doc_id", "_fp").agg(least).select("doc_id", "_row.text", "_row._rest")
        out = out.where("_rows = 1").drop("_rows").unionByName(again)
    return unpacked(out, docs.columns, "doc_id", "text")
