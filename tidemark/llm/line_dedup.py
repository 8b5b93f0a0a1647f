"""Line dedup across documents: lines that many documents share stay in one of them. DataFrame operations only.

A line's key is the line without ASCII space at its ends, A-Z lower-cased. Keys of at least ``min_chars`` code points
in at least ``min_docs`` distinct documents lose all their lines except in the document with the largest doc_id that
holds them. Only hashes, ids and positions are exploded and shuffled; texts move once, to meet their positions.

Keys are told apart by 96 bits of hash (XXH64 and Murmur3), so even 10**12 lines are unlikely to hold a collision.
Counting distinct documents is two partial aggregations, by (key, document) and by key, so a line that a third of
all documents hold is reduced in every task before it is shuffled.

Defined results: null text counts as one empty line and stays null; a null doc_id is one document that sorts before
all others; rows that repeat a doc_id are one document; a document that loses all its lines keeps its row with an
empty text; other columns of any name are carried along, except that the operator's own n_lines and n_dropped replace
any of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import ascii_lower, packed, stage, trimmed, unpacked

MIN_CHARS, MIN_DOCS = 20, 3
_OWN = ("_ld_doc", "_ld_text")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _identified(docs: DataFrame) -> DataFrame:
    """The document's number (null: the smallest) and the text's hash: together they tell rows apart."""
    return docs.withColumns({"_ld_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_ld_text": F.xxhash64("text")})


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """_ld_doc, _ld_text, pos, h1, h2 of every line long enough to count."""
    keys = F.transform(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), "\n"), trimmed)
    hashed = F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"))))
    rows = _identified(docs).select(*_OWN, F.explode(F.filter(hashed, lambda x: x.isNotNull())).alias("k"))
    return rows.select(*_OWN, "k.pos", "k.h1", "k.h2")


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """_ld_doc, _ld_text and the 0-based positions (array) of the lines that go."""
    keys = _keys(docs, min_chars)
    pairs = keys.groupBy("h1", "h2", "_ld_doc").agg(F.lit(1).alias("one"))
    shared = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("_ld_doc").alias("keeper")).where(F.col("n") >= min_docs)
    shared = stage(shared.drop("n"), "line-keys")
    gone = keys.join(shared.hint("merge"), ["h1", "h2"]).where(F.col("_ld_doc") < F.col("keeper"))
    return stage(gone.groupBy(*_OWN).agg(F.collect_set("pos").alias("gone")), "line-positions")


OWN = ("n_lines", "n_dropped")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the text that stays, and columns n_lines (before) and n_dropped."""
    out = _deduped(packed(docs, "doc_id", "text"), min_chars, min_docs)
    carried = [F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in docs.columns if c not in OWN]
    return out.select(*carried, *OWN)


def _deduped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Of documents whose other columns are packed."""
    gone = dropped_positions(docs, min_chars, min_docs)
    out = _identified(docs).join(gone.hint("merge"), list(_OWN), "left")
    out = out.withColumn("_ld_lines", _lines(F.col("text")))
    # read more than once below, or the optimizer would split the text anew for every line; array_except hashes, so
    # this is linear in the lines, however many of them go
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), F.col("gone")))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_ld_lines"), i)), "\n")
    own = {
        "n_lines": F.size("_ld_lines").cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept),
    }
    return out.withColumns(own).drop(*_OWN, "gone", "_ld_lines")


def with_shared_lines_dropped(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its own columns and the text that stays; n_chars, where there is one, is that text's length."""
    out = _deduped(packed(docs, "doc_id", "text", "n_chars"), min_chars, min_docs)
    if "n_chars" in docs.columns:
        chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, chars).otherwise(F.col("n_chars")))
    return unpacked(out, docs.columns, "doc_id", "text", "n_chars")
