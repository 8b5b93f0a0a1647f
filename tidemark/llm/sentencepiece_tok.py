"""SentencePiece encoding and decoding on the tokenizers library.

A model's protobuf file is parsed here (no protobuf library needed) and rebuilt as a ``tokenizers`` pipeline: the
precompiled character map and the white-space rules as normalisers, the metaspace marker, unigram scores or BPE merges
as the model, byte fallback, and the decoder that undoes it all. Batches are encoded by the library's threads.

Where no piece of the vocabulary holds a marker after another character, no merge can reach over such a place, so the
text is cut there first: the same pieces come out, from short words that are encoded once each, a batch at a time.

Parity with the ``sentencepiece`` library is verified by ``verify_parity`` on fixed probes whenever a worker builds a
tokenizer, and on every document, whole: ``parity`` tells whether the library gives the same ids for its text. So is the
round trip: ``round_trip`` tells whether the document's pieces, put together, are its text as the model's normaliser
leaves it.

The model's bytes go to the executors as a broadcast: read once, on the driver, from ``model_path``; a vocabulary has a
bounded size. Defined results: null text has null ids, empty text none; repeated rows are encoded each; an empty table
gives no rows; other columns are carried along, except that the operator's own columns replace any of the same names.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from tidemark.llm._shared import once, ship, unused

ship(__name__)

#: Where the box keeps its public vocabulary; a parameter of every function here.
MODEL_PATH = os.environ.get("TIDEMARK_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PROBES = ("", " ", "a", "  two  spaces ", "The quick brown fox.", "Éèç ñ ü ß", "tab\tand\nnewline\n", "你好 \U0001f600‍", "<s> </s> <unk> <0x41>", "x" * 300, MARK + " mark", "\x00\x7f")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"protobuf wire type {kind}")
        yield tag >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, type), model type, and the normaliser's settings."""
    model: dict = {"pieces": [], "kind": UNIGRAM, "charsmap": b"", "prefix": True, "squeeze": True, "escape": True}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            model["pieces"].append((piece.get(1, b"").decode("utf-8"), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            model["kind"] = dict(fields(value)).get(3, UNIGRAM)
        elif number == 3:
            rules = dict(fields(value))
            model |= {"charsmap": rules.get(2, b""), "prefix": bool(rules.get(3, 1)), "squeeze": bool(rules.get(4, 1)), "escape": bool(rules.get(5, 1))}
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best score first."""
    ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for text, at in ids.items():
        ways = [(text[:i], text[i:]) for i in range(1, len(text)) if text[:i] in ids and text[i:] in ids]
        found += [(-pieces[at][1], at, ids[left], ids[right], left, right) for left, right in ways]
    return [(left, right) for *_, left, right in sorted(found)]


def build(data: bytes) -> Tokenizer:
    model = parse_model(data)
    pieces = model["pieces"]
    unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), None)
    fallback = any(kind == BYTE for *_, kind in pieces)
    if model["kind"] == BPE:
        core = models.BPE({text: i for i, (text, _, _) in enumerate(pieces)}, _merges(pieces), cache_capacity=10_000, unk_token=None if unknown is None else pieces[unknown][0], fuse_unk=True, byte_fallback=fallback)
    elif model["kind"] == UNIGRAM:
        low = min((score for _, score, kind in pieces if kind == NORMAL), default=0.0)
        # what no text may be cut into, control and byte pieces' own spellings, is dearer than any cut into characters
        core = models.Unigram([(text, score if kind in (NORMAL, USER_DEFINED) else low - 1e5) for text, score, kind in pieces], unknown, fallback)
    else:
        raise ValueError(f"model type {model['kind']} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    rules = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["squeeze"]:
        rules += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    rules += [normalizers.Prepend(MARK)] if model["prefix"] else []
    rules += [normalizers.Replace(" ", MARK)] if model["escape"] else []
    tokenizer.normalizer = normalizers.Sequence(rules)
    if not any(MARK in text.lstrip(MARK) for text, _, kind in pieces if kind in (NORMAL, USER_DEFINED)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*undo, *([decoders.Strip(" ", 1, 0)] if model["prefix"] else [])])
    return tokenizer


def normalised(tokenizer: Tokenizer, text: str) -> str:
    """What decoding a text's pieces gives back: the text after the model's own normaliser."""
    whole = tokenizer.normalizer.normalize_str(text).replace(MARK, " ")
    return whole[1:] if whole[:1] == " " else whole


def verify_parity(tokenizer: Tokenizer, data: bytes, texts: Iterable[str] = PROBES) -> list[bool]:
    """For each text whether the sentencepiece library gives the same ids."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    given = list(texts)
    ours = tokenizer.encode_batch_fast(given, add_special_tokens=False)
    return [x.ids == y for x, y in zip(ours, theirs.encode(given, num_threads=1), strict=True)]


def _verified(data: bytes) -> Tokenizer:
    tokenizer = build(data)
    if not all(verify_parity(tokenizer, data)):
        raise ValueError("the rebuilt tokenizer differs from sentencepiece on the probes")
    return tokenizer


def ready(data: bytes) -> Tokenizer:
    """The tokenizer of a model, built and verified once a worker."""
    return once(("tokenizer", hashlib.sha256(data).hexdigest()), lambda: _verified(data))


def read_model(path: str = MODEL_PATH) -> bytes:
    return Path(path).read_bytes()


class _Numbers(dict):
    """Numbers words as they are first seen, and remembers which are new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes Arrow batches of texts, each distinct word of a stretch of the data once.

    Words are what lies between single spaces. Where the model leaves text as it is but for the marker, and no piece
    reaches over a marker, a text's ids are its words' ids one after the other. New words go through the library as a
    batch, many in a text, on its threads. Texts with other spacing, and all texts of other models, go through it whole, likewise. Whether
    the ids are right is then asked of each whole document.

    Memory: about ``WORDS`` words and one stretch of texts, whatever the batch.
    """

    WORDS, STRETCH, GROUP = 300_000, 1 << 20, 100

    def __init__(self, data: bytes, parity: bool = True) -> None:
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.tokenizer = ready(data)
        model = parse_model(data)
        self.by_words = self.tokenizer.pre_tokenizer is not None and model["prefix"] and model["escape"] and not (model["charsmap"] or model["squeeze"])
        self.pieces = pa.array([bytes([int(text[3:-1], 16)]) if kind == BYTE else text.replace(MARK, " ").encode() for text, _, kind in model["pieces"]], pa.binary())
        self.marked = np.array([text.startswith(MARK) for text, _, _ in model["pieces"]])
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data) if parity else None
        self.clear()

    def clear(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encodes the new words, ``GROUP`` of them as one text of the batch: a word's pieces begin where one has the marker."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        groups = [new[i : i + self.GROUP] for i in range(0, len(new), self.GROUP)]
        ids, sizes = [self.ids], []
        for words, listed in zip(groups, self._batch([" ".join(g) for g in groups]), strict=True):
            found = np.array(listed, np.int32)
            at = np.flatnonzero(self.marked[found])
            if len(at) == len(words):
                ids.append(found)
                sizes.append(np.diff(np.append(at, len(found))))
            else:
                each = self._batch(words)
                ids += [np.array(x, np.int32) for x in each]
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        self.ids = np.concatenate(ids)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and how many each has; the texts have words and single spaces."""
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        number = np.fromiter(map(self.numbers.__getitem__, flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
        self._learn()
        word = number[flat.indices.to_numpy()]
        sizes = self.starts[word + 1] - self.starts[word]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[word] - (ends - sizes), sizes)]
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        return ids, np.add.reduceat(sizes, first) if len(counts) else np.empty(0, np.int64)

    def _same(self, texts: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each text whether the sentencepiece library gives its ids."""
        theirs = self.theirs.encode(texts, num_threads=1)
        same = np.fromiter(map(len, theirs), np.int64, len(theirs)) == sizes
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(same & (sizes > 0)):
            same[i] = np.array_equal(theirs[i], ids[ends[i] - sizes[i] : ends[i]])
        return same

    def _back(self, texts: list[str], plain: bool, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each text whether its pieces make it up again, after the normaliser of models that change it."""
        if plain:
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            made = pc.binary_join(pa.ListArray.from_arrays(offsets, self.pieces.take(pa.array(ids))), b"")
            wanted = pc.binary_join_element_wise(pa.scalar(b" "), pa.array(texts, pa.string()).cast(pa.binary()), b"")
            return pc.equal(made, wanted).to_numpy(zero_copy_only=False)
        listed = np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []
        made = self.tokenizer.decode_batch([x.tolist() for x in listed], skip_special_tokens=False)
        return np.array([x == normalised(self.tokenizer, t) for x, t in zip(made, texts, strict=True)], bool)

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """ids, n_tokens, parity and round_trip of a stretch of texts."""
        if len(self.numbers) > self.WORDS:
            self.clear()
        n = len(texts)
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        odd = np.ones(n, bool)
        if self.by_words:
            text = pc.fill_null(texts, "")
            spaced = pc.or_(pc.or_(pc.starts_with(text, " "), pc.ends_with(text, " ")), pc.or_(pc.match_substring(text, "  "), pc.match_substring(text, MARK)))
            odd = pc.or_(spaced, pc.equal(text, "")).to_numpy(zero_copy_only=False)
        tokens, same, back = np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool)
        parts, owners = [], []
        for plain, rows in ((True, np.flatnonzero(known & ~odd)), (False, np.flatnonzero(known & odd))):
            if not len(rows):
                continue
            some = texts.take(pa.array(rows))
            listed = some.to_pylist()
            if plain:
                ids, sizes = self._plain(some)
            else:
                whole = self._batch(listed)
                ids, sizes = np.fromiter(itertools.chain.from_iterable(whole), np.int32), np.fromiter(map(len, whole), np.int64, len(whole))
            tokens[rows], back[rows] = sizes, self._back(listed, plain, ids, sizes)
            if self.theirs:
                same[rows] = self._same(listed, ids, sizes)
            parts.append(ids)
            owners.append(np.repeat(rows, sizes))
        ids = np.concatenate(parts) if parts else np.empty(0, np.int32)
        if len(parts) == 2:
            ids = ids[np.argsort(np.concatenate(owners), kind="stable")]
        offsets = pa.array(np.concatenate([[0], np.cumsum(tokens)]).astype(np.int32))
        masked = lambda x, kind, on=known: pa.array(x, kind, mask=~on)
        checked = known if self.theirs else np.zeros(n, bool)
        return [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=pa.array(~known)), masked(tokens, pa.int64()), masked(same, pa.bool_(), checked), masked(back, pa.bool_())]


RESULT = {"ids": "array<int>", "n_tokens": "bigint", "parity": "boolean", "round_trip": "boolean"}


def _stretches(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about Encoder.STRETCH bytes of text, at least one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // Encoder.STRETCH
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else [0]
    for a, b in itertools.pairwise(starts):
        yield batch.slice(int(a), int(b - a))


def encode(docs: DataFrame, model: bytes | None = None, parity: bool = True, keep_text: bool = True) -> DataFrame:
    """``docs`` with ids, n_tokens, parity (null unless asked for) and round_trip of its text."""
    given = docs.sparkSession.sparkContext.broadcast(model or read_model())
    carried = [c for c in docs.columns if c not in RESULT and (keep_text or c != "text")]

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("encoder", parity, hashlib.sha256(given.value).hexdigest()), lambda: Encoder(given.value, parity))
        for batch in batches:
            for part in _stretches(batch, len(carried)):
                own = [part.column(i) for i in range(len(carried))]
                yield pa.RecordBatch.from_arrays([*own, *encoder.encode(part.column(len(carried)))], [*carried, *RESULT])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried], *[f"{c} {t}" for c, t in RESULT.items()]])
    return docs.select(*[F.col(f"`{c}`") for c in carried], F.col("text").alias(unused("_sp_text", carried))).mapInArrow(encoded, schema)


def decode(encoded: DataFrame, model: bytes | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids in a column ``decoded`` (null ids: null)."""
    given = encoded.sparkSession.sparkContext.broadcast(model or read_model())

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = ready(given.value)
        for batch in batches:
            some = [x is not None for x in batch]
            texts = iter(tokenizer.decode_batch([list(x) for x in batch if x is not None], skip_special_tokens=False))
            yield pd.Series([next(texts) if x else None for x in some], dtype=object)

    return encoded.withColumn("decoded", decoded(ids))
