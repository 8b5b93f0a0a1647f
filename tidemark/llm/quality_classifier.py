"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features is shared by all grades; ordered thresholds cut its scale:
P(grade <= k) = sigmoid(threshold_k - weights . features). From that follow a document's expected grade and the
probability of the top grade, by which documents are selected.

Grades come from ``labels``: 0 for low quality, 1 for good but toxic, 2 for good and clean.

Features of a whole text: each distinct word, lower-cased and stripped of what is no letter or digit at its ends, and
each distinct beginning of ``PREFIX`` letters of longer ones; each shape of its words (runs of letters, capitals, digits
and other characters drawn together) with ``SHAPE`` times its share of the words. All are hashed to ``DIMENSIONS``
weights, of which only those get a value whose feature is seen with some grade unlike chance has it: words that mean
nothing would otherwise let the model learn its sample by heart.

The model is fitted on the driver on at most about ``SAMPLE`` documents a grade, chosen by hash and weighted so that the
grades keep their frequency; only those of their hashed features that get a weight are collected. The sampled ids, having that bound, are
broadcast, so texts aren't shuffled. The weights (DIMENSIONS * 4 bytes) are broadcast to score every document.

Defined results: null or blank text has grade 0, probabilities 0, and isn't selected; labels without a quality are
ignored, and a null toxic counts as not toxic; a document labelled more than once has its lowest grade; without any
label every score is null and nothing is selected; repeated rows get the same score; a grade nobody has gets no
probability; other columns are carried along, except that the operator's own columns replace any of the same names; very
long texts are split into words whole, in one row's memory.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._shared import ship, stage, unused

ship(__name__)

DIMENSIONS, SAMPLE, SHAPE, PREFIX, GRADES = 1 << 18, 8000, 4.0, 5, 3
#: Rows a feature must be in, and by how many standard deviations a grade must differ there from chance.
LEAST, SURPRISE = 5, 5.0
STEPS, RATE, RIDGE = 300, 0.2, 3e-5
SELECT = 0.5
CACHE = 300_000


def _shape(word: str) -> str:
    letters = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return re.sub(r"(\W)\1+", r"\1", re.sub(r"\d+", "0", letters))


def _hashed(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) % DIMENSIONS


class _Words(dict):
    """Feature numbers of a word, its beginning and its shape (-1: none), kept for the words met lately."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        if len(self) > CACHE:
            self.clear()
        bare = re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())
        whole = _hashed(f"w {bare}") if bare else -1
        self[word] = found = whole, _hashed(f"p {bare[:PREFIX]}") if len(bare) > PREFIX else -1, _hashed(f"s {_shape(word)}")
        return found


def features(text: str | None, cache: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values."""
    counts = Counter((text or "").split())
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    words, starts, shapes = zip(*map(cache.__getitem__, counts), strict=True)
    present = np.unique(np.array(words + starts, np.int64))
    present = present[present >= 0]
    shape, at = np.unique(np.array(shapes, np.int64), return_inverse=True)
    n = np.bincount(at, np.fromiter(counts.values(), np.float64, len(counts)))
    numbers = np.concatenate([present, shape]).astype(np.int32)
    return numbers, np.concatenate([np.ones(len(present)), SHAPE * n / n.sum()]).astype(np.float32)


class Ordinal:
    """Cumulative-link model: ``weights``, and ``cuts`` in ascending order."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray) -> None:
        self.weights, self.cuts = weights.astype(np.float32), cuts

    def probabilities(self, numbers: np.ndarray, values: np.ndarray) -> np.ndarray:
        at_most = 1 / (1 + np.exp(-np.clip(self.cuts - float(self.weights[numbers] @ values), -50, 50)))
        return np.diff(np.concatenate([[0.0], at_most, [1.0]]))


def screened(hashed: DataFrame) -> np.ndarray:
    """Which features are worth a weight: in enough rows, and with some grade far more or less often than chance gives."""
    rows = {r["grade"]: r["count"] for r in hashed.groupBy("grade").count().collect()}
    seen = [F.sum(F.when(F.col("grade") == k, 1).otherwise(0)).alias(f"seen{k}") for k in rows]
    counts = hashed.select("grade", F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("total"), *seen)
    expected = {k: F.col("total") * F.lit(n / sum(rows.values())) for k, n in rows.items()}
    surprise = F.greatest(F.lit(0.0), *[F.abs(F.col(f"seen{k}") - e) / F.sqrt(e + 0.5) for k, e in expected.items()])
    worth = np.zeros(DIMENSIONS, bool)
    worth[[r["number"] for r in counts.where((F.col("total") >= LEAST) & (surprise >= SURPRISE)).select("number").collect()]] = True
    return worth


def train(rows: list[tuple[int, float, np.ndarray, np.ndarray]]) -> Ordinal:
    """Adam on the whole sample; rows are (grade, weight, numbers, values)."""
    # a row without any such feature still tells about the cuts
    rows = [r if len(r[2]) else (r[0], r[1], np.zeros(1, np.int32), np.zeros(1, np.float32)) for r in rows]
    grade, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    weight = weight / weight.sum()
    numbers, values = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]).astype(np.float64)
    sizes = np.array([len(r[2]) for r in rows])
    row, starts = np.repeat(np.arange(len(rows)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # only the features the sample has are stepped
    used, numbers = np.unique(numbers, return_inverse=True)
    # first cut, then the logarithm of each further distance: the cuts stay in order
    below = [np.clip((weight * (grade <= k)).sum(), 1e-3, 1 - 1e-3) for k in range(GRADES - 1)]
    first = np.log(np.array(below) / (1 - np.array(below)))
    p = np.concatenate([np.zeros(len(used)), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, free = p[: len(used)], p[len(used) :]
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        eta = np.add.reduceat(w[numbers] * values, starts)
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = (1 / (1 + np.exp(-np.clip(ends[grade + i] - eta, -500, 500))) for i in (1, 0))
        upper, lower = np.where(grade == GRADES - 1, 1.0, upper), np.where(grade == 0, 0.0, lower)
        inside = np.maximum(upper - lower, 1e-12)
        by_eta = weight * (1 - upper - lower)
        by_upper, by_lower = -weight * upper * (1 - upper) / inside, weight * lower * (1 - lower) / inside
        by_cut = np.array([by_upper[grade == k].sum() + by_lower[grade == k + 1].sum() for k in range(GRADES - 1)])
        by_free = np.array([by_cut[k:].sum() * (1 if k == 0 else np.exp(free[k])) for k in range(GRADES - 1)])
        slope = np.concatenate([np.bincount(numbers, by_eta[row] * values, len(used)) + RIDGE * w, by_free])
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        p -= RATE * (1 - 0.9 * step / STEPS) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-12)
    weights = np.zeros(DIMENSIONS)
    weights[used] = p[: len(used)]
    free = p[len(used) :]
    return Ordinal(weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 1).otherwise(2)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def fit(docs: DataFrame, grades: DataFrame) -> Ordinal | None:
    """The model learned from a sample of ``grades`` (doc_id, grade)."""
    grades = stage(grades, "quality-grades")
    counts = {r["grade"]: r["count"] for r in grades.groupBy("grade").count().collect()}
    if not counts:
        return None
    share = {g: min(1.0, SAMPLE / n) for g, n in counts.items()}
    part = F.coalesce(*[F.when(F.col("grade") == g, F.lit(int(x * (1 << 30)))) for g, x in share.items()])
    sample = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part)

    def hashed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Words()
        for batch in batches:
            found = [features(t, cache) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "numbers": [n for n, _ in found], "values": [v for _, v in found]})

    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kept = stage(chosen.mapInPandas(hashed, "doc_id long, grade int, numbers array<int>, values array<float>").where(F.size("numbers") > 0), "quality-features")
    worth = screened(kept)

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            on = [worth[n] for n in batch["numbers"]]
            numbers = [n[o].astype(np.int32).tobytes() for n, o in zip(batch["numbers"], on, strict=True)]
            values = [v[o].astype(np.float32).tobytes() for v, o in zip(batch["values"], on, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "grade": batch["grade"], "numbers": numbers, "values": values})

    rows = sorted(kept.mapInPandas(packed, "doc_id long, grade int, numbers binary, values binary").collect(), key=lambda r: (r["doc_id"], r["numbers"]))
    unpacked = [(r["grade"], 1 / share[r["grade"]], np.frombuffer(r["numbers"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows]
    return train(unpacked) if unpacked else None


RESULT = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("p_good", T.DoubleType()), T.StructField("p_top", T.DoubleType())])


def classify(docs: DataFrame, model: Ordinal | None) -> DataFrame:
    """``docs`` with expected_grade, p_good (at least grade 1), p_top (the highest grade) and selected."""
    # plain arrays: a broadcast's classes would be looked for on the executors
    given = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.weights, model.cuts))

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, fitted = _Words(), None if given.value is None else Ordinal(*given.value)

        def one(text: str | None) -> tuple:
            if fitted is None:
                return None, None, None
            numbers, values = features(text, cache)
            if not len(numbers):
                return 0.0, 0.0, 0.0
            p = fitted.probabilities(numbers, values)
            return float(p @ np.arange(GRADES)), float(p[1:].sum()), float(p[-1])

        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=[f.name for f in RESULT], dtype="float64")

    own = unused("_qc", docs.columns)
    out = docs.withColumn(own, scored("text"))
    out = out.withColumns({f.name: F.col(f"{own}.{f.name}") for f in RESULT}).drop(own)
    return out.withColumn("selected", F.coalesce(F.col("p_top") >= SELECT, F.lit(False)))
