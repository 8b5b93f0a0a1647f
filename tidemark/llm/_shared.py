"""Helpers shared by the corpus operators: staging, words, and shipping Python code."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship
from tidemark.plans.store import stage

__all__ = ["LOWER", "UPPER", "WS", "WS_CHARS", "ascii_lower", "load", "once", "packed", "ship", "stage", "trimmed", "unpacked", "unused", "words"]

T = TypeVar("T")
#: The six ASCII white-space characters that end a word, as a character class.
WS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII spaces; null or blank text has none."""
    bare = trimmed(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS + "+"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged. ``lower`` is much faster, and the same where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with all columns but those ``used`` in one struct, so no name of theirs can clash with ours."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*[c for c in docs.columns if c in used], F.struct(*rest or [F.lit(None).alias("none")]).alias("_rest"))


def unpacked(frame: DataFrame, columns: list[str], *used: str) -> DataFrame:
    return frame.select(*[F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in columns])


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with more underscores where a column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def once(key: object, make: Callable[[], T]) -> T:
    """``make()``, kept for later tasks of the same Python worker, which get new copies of shipped modules."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    name = f"kept {key!r}"
    if name not in kept:
        kept[name] = make()
    return kept[name]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ship(__name__)
