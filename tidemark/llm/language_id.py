"""Language identification by language-bitmask n-gram filters.

Learning: per language the character n-grams that make up at least ``RATE`` of its text go into a Bloom filter. The
filters of all languages lie across each other (bit-sliced): slot i of the table is a bitmask with a bit for each
language whose filter has bit i set. So ``PROBES`` slots, ANDed, return at once all languages that contain an n-gram.

Prediction: the masks of all n-grams of the whole text are counted per language (popcounts). A filter with a share f
of its bits set says yes to f ** PROBES of the n-grams it doesn't hold; the counts are corrected for that, and the
language with the largest corrected count is the answer. Its share of all corrected counts is the score.

N-grams are of ``SIZES`` letters over the lower-cased text, in which whatever is no letter is one space.

The classifier is fitted on a sample of at most about ``SAMPLE`` documents a language, chosen by hash among those with
a language whose crc32 of doc_id isn't 0 modulo ``FOLDS``. All languages are learned; the table takes ``SLOTS`` * 8
bytes for each 64 of them, so more than ``LANGUAGES``, which no worker should have to hold, are refused with an error. The
slots' masks are put together in Spark: what the driver collects and broadcasts is the table, one row a slot in use.
Prediction reads every document's whole text.

Defined results: null text or text without a letter is ``und`` with score 0; a text none of whose n-grams is known
gets the first language by code point and a score of 1 / number of languages; ties go to the first by code point;
without any learned language everything is ``und``; a null doc_id counts as held out; repeated rows all count;
very long texts are read piece by piece; other columns are carried along, except that the operator's own columns replace
any of the same names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import once, ship, stage, unused

ship(__name__)

FOLDS, SAMPLE, LANGUAGES = 5, 1000, 1024
SIZES, RATE, PROBES, SLOTS = (2, 3, 4), 2e-5, 3, 1 << 20
PIECE = 1 << 19
UNDETERMINED = "und"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(0)) == 0


def _letters() -> np.ndarray:
    return once("letters", lambda: np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ (keys >> np.uint64(29))


def ngrams(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(size, 64-bit keys) of the text's n-grams, piece by piece; nothing if it has no letter."""
    if not text:
        return
    carry, last = np.array([32], np.uint64), True
    seen = False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        seen = seen or bool(letter.any())
        gap = ~letter
        keep = letter | (gap & ~np.concatenate([[last], gap[:-1]]))
        last = bool(gap[-1])
        codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
        if at + PIECE >= len(text) and not last:
            codes = np.append(codes, np.uint64(32))
        codes = np.concatenate([carry, codes])
        if not seen:
            continue
        longest = max(SIZES)
        for size in SIZES:
            # each piece begins with the last characters of the one before: those n-grams that ended there are not new
            start = max(0, len(carry) - size + 1) if at else 0
            n = len(codes) - start - size + 1
            if n <= 0:
                continue
            key = np.full(n, size, np.uint64)
            for i in range(size):
                key = key * np.uint64(0x1F0A3D) + codes[start + i : start + i + n]
            yield size, _mixed(key)
        carry = codes[-(longest - 1) :]


def slots(keys: np.ndarray) -> list[np.ndarray]:
    bits = np.uint64(SLOTS.bit_length() - 1)
    return [((keys >> (bits * np.uint64(i))) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(PROBES)]


class Filters:
    """The filters of all languages: ``table[word][slot]`` has the bits of languages 64 * word and on."""

    def __init__(self, languages: list[str], grams: Iterable[tuple[int, np.ndarray]] = (), table: np.ndarray | None = None) -> None:
        """From n-gram keys by language number, or from a table that has them."""
        self.languages = languages
        self.table = np.zeros((len(languages) + 63 >> 6, SLOTS), np.uint64) if table is None else table
        for language, keys in grams:
            for at in slots(keys):
                self.table[language >> 6][at] |= np.uint64(1 << (language & 63))
        filled = [np.count_nonzero(self.table[i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / SLOTS for i in range(len(languages))]
        self.false_positive = np.array(filled) ** PROBES
        self.bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """For each language how many of ``keys`` its filter holds."""
        at, found = slots(keys), []
        for i, words in enumerate(self.table):
            masks = words[at[0]]
            for more in at[1:]:
                masks &= words[more]
            each = masks.view(np.uint8).reshape(-1, 8)
            for byte in range(min(8, len(self.languages) - 64 * i + 7 >> 3)):
                found.append(np.bincount(each[:, byte], minlength=256) @ self.bits)
        return np.concatenate(found)[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        total, hits = 0, np.zeros(len(self.languages), np.int64)
        for _, keys in ngrams(text) if self.languages else ():
            total += len(keys)
            hits += self.counts(keys)
        if not total:
            return UNDETERMINED, 0.0
        corrected = np.maximum(hits - total * self.false_positive, 0) / np.maximum(1 - self.false_positive, 1e-9)
        best, whole = int(corrected.argmax()), corrected.sum()
        return self.languages[best], float(corrected[best] / whole) if whole > 0 else 1 / len(self.languages)


def fit(docs: DataFrame) -> Filters:
    """Filters learned from text and lang of the documents that aren't held out."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    found = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn: the table of their filters would be too large for a worker")
    if not found:
        return Filters([])
    counted = sorted((r["lang"], r["count"]) for r in found)
    languages = [lang for lang, _ in counted]
    # at most LANGUAGES rows
    numbered = spark.createDataFrame([(lang, i, int(min(1.0, SAMPLE / n) * (1 << 30))) for i, (lang, n) in enumerate(counted)], "lang string, language int, part long")
    chosen = known.join(F.broadcast(numbered), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("part")).select("language", "text")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, texts in batch.groupby("language")["text"]:
                by_size: dict[int, list[np.ndarray]] = {}
                for text in texts:
                    for size, keys in ngrams(text):
                        by_size.setdefault(size, []).append(keys)
                for size, found in by_size.items():
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"language": language, "size": size, "key": keys.view(np.int64), "n": n})

    counted = chosen.mapInPandas(count, "language int, size int, key long, n long").groupBy("language", "size", "key").agg(F.sum("n").alias("n"))
    counted = stage(counted, "language-ngrams")
    totals = counted.groupBy("language", "size").agg(F.sum("n").alias("total"))
    frequent = counted.join(totals, ["language", "size"]).where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * RATE)).select("language", "key")
    bits = SLOTS.bit_length() - 1
    probes = F.array(*[F.shiftrightunsigned("key", bits * i).bitwiseAND(F.lit(SLOTS - 1).cast("long")) for i in range(PROBES)])
    own = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("language") % 64)
    masks = frequent.select(F.floor(F.col("language") / 64).cast("int").alias("word"), own.alias("bit"), F.explode(probes).alias("slot")).groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    rows = masks.toArrow()
    table = np.zeros((len(languages) + 63 >> 6, SLOTS), np.uint64)
    table[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Filters(languages, table=table)


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """``docs`` with held_out, lang_pred and score."""
    filters = filters or fit(docs)
    # plain values: a broadcast's classes would be looked for on the executors
    given, name = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table)), uuid.uuid4().hex

    @F.pandas_udf(RESULT)
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        learned = once(("filters", name), lambda: Filters(given.value[0], table=given.value[1]))
        for texts in batches:
            yield pd.DataFrame([learned.predict(t) for t in texts], columns=["lang_pred", "score"])

    own = unused("_lid", docs.columns)
    out = docs.withColumn("held_out", held_out()).withColumn(own, predicted("text"))
    return out.withColumns({f.name: F.col(f"{own}.{f.name}") for f in RESULT}).drop(own)
