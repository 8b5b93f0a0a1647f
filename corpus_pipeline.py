"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage's function takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``.

Defined results: documents without text fail the quality rules; a null doc_id is an id like any other; rows that repeat a
document are one after near-dedup, with the same copies in the mix; ties in mixing go to the first seed; whole texts of any
length are read; columns besides doc_id, text, lang, source and n_chars are carried along by all stages but the last; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, quality_rules, sentencepiece_tok, simhash
from tidemark.llm._shared import load, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; a document keeps its row, and n_chars follows its text."""
    return line_dedup.with_shared_lines_dropped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 0.8 or more alike, by SimHash's estimate, stays."""
    return simhash.near_dedup(docs, simhash.SIMILAR)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, ids and n_tokens of each document emitted, and that encoding it can be undone."""
    return sentencepiece_tok.encode(docs, keep_text=False).select("doc_id", "source", "lang", "ids", "n_tokens", "parity", "round_trip")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("mixing", mix), ("sentencepiece", tokens)]

#: SQL can't express SimHash or SentencePiece; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
