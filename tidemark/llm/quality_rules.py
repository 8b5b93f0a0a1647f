"""Quality rules with adaptive thresholds per language and source. DataFrame operations only.

Each document's whole text gives a few counts, and from them rates in integers (per mille of words, lines or
characters; word length in hundredths). The rates of all documents that pass the base rules go into quantile sketches:
histograms of integer buckets, kept per (lang, source), which merge by adding counts. They are reduced in every task
before they are shuffled, are the same on every run, and hold at most about a thousand buckets a rate whatever the
input; a quantile read from one is off by less than a bucket.

From a group's sketch come the quartiles of each rate, and a fence ``FENCE`` interquartile ranges beyond them. Nothing
else sets where it lies or how wide it is: a source where nearly every document has a third of its characters in capitals
or a symbol in ten gets a fence beyond that, one without symbols gets a fence at zero. The fence of a small group is
drawn towards its language's, as if ``PRIOR`` documents of the language were among its own, and a language's towards that
of all documents.

A fence is a rate; what a document is judged by is its count. A document of n words meets a rate f by chance with a count
of about n f, give or take its root, so the count may exceed n f by ``FENCE`` standard deviations of a count that comes in
lots of ``LOT`` (a repeated window covers twice its words at least): a short document isn't rejected for one line said
twice. The fences are joined to the documents, and a document is kept if it passes the base rules and every fence.

Defined results: null text is an empty text, and fails; null lang and null source are groups of their own; repeated
rows are judged each by itself, all alike; an empty table gives no rows; all other columns are carried along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import packed, stage, trimmed, unpacked, words

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
PRIOR, FENCE = 30, 3
_READ = ("text", "lang", "source")
#: Rate: (count, factor, of how many, highest bucket, whether too little counts against it too).
RATES = {
    "symbols": ("n_symbols", 1000, "word_chars", 1000, False),
    "capitals": ("n_capitals", 1000, "word_chars", 1000, False),
    "dup_lines": ("n_dup_lines", 1000, "n_lines", 1000, False),
    "echoes": ("n_echoes", 1000, "n_words", 1000, False),
    "repeats": ("n_repeat_words", 1000, "n_words", 1000, False),
    "word_length": ("word_chars", 100, "n_words", 5000, True),
}
#: Least number by which a count can grow, where that isn't one.
LOT = {"repeats": 2 * WINDOW}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines", "n_echoes")


def _pairs(hashes: str, apart: int) -> Column:
    """Hash of each element with the one ``apart`` after it."""
    return F.zip_with(F.col(hashes), F.slice(F.col(hashes), apart + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def score(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct column ``_quality`` of counts and base_failed.

    Columns that a later step reads in a lambda are read there more than once, which keeps the optimizer from
    evaluating them anew for every element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    removed = lambda pattern: F.char_length("_text") - F.char_length(F.regexp_replace("_text", pattern, ""))
    q = docs.withColumn("_text", text).withColumn("_words", words(F.col("_text"))).withColumn("n_words_", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda line: trimmed(line) != "")
    q = q.withColumn("_lines", lines).withColumn("_q1", F.struct(
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        removed(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        removed(r"\p{Lu}").cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    ))
    # Hashes of 1, 2, 4 and then 8 words in a row, each in one pass over the array
    q = q.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words", "_lines", "_text")
    echo = F.zip_with(F.col("_h1"), F.slice(F.col("_h1"), 2, F.size("_h1")), lambda a, b: F.when(a == b, 1).otherwise(0))
    q = q.withColumn("_echoes", F.aggregate(echo, F.lit(0).cast("long"), lambda total, x: total + x))
    q = q.withColumn("_h2", _pairs("_h1", 1)).drop("_h1").withColumn("_h4", _pairs("_h2", 2)).drop("_h2").withColumn("_h8", _pairs("_h4", 4)).drop("_h4")
    windows = F.slice("_h8", 1, F.greatest(F.col("n_words_").cast("int") - (WINDOW - 1), F.lit(0)))
    q = q.withColumn("_win", windows).drop("_h8")
    numbered = F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    q = q.withColumn("_win", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), numbered))
    same = lambda x, j: F.get(F.col("_win"), j)["h"] == x["h"]
    again = F.filter("_win", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
    q = q.withColumn("_at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_win")
    covers = F.zip_with("_at", F.slice(F.col("_at"), 2, F.size("_at")), lambda a, b: F.least(F.lit(WINDOW), b - a))
    repeated = F.coalesce(F.aggregate(covers, F.lit(0).cast("long"), lambda total, c: total + c), F.lit(0).cast("long"))
    q = q.withColumn("_repeat", repeated).drop("_at")
    failed = (F.col("n_words_") < MIN_WORDS) | (100 * F.col("_repeat") > MAX_REPEAT_PERCENT * F.col("n_words_"))
    own = F.struct(F.col("n_words_").alias("n_words"), "_q1.*", F.col("_repeat").alias("n_repeat_words"), F.col("_echoes").alias("n_echoes"), failed.alias("base_failed"))
    return q.withColumn("_quality", own).select(*[F.col(c) for c in docs.columns], "_quality")


def _rate(name: str) -> Column:
    above, factor, below, most, _ = RATES[name]
    n, d = F.col(f"_quality.{above}"), F.col(f"_quality.{below}")
    return F.least(F.lit(most).cast("long"), F.when(d == 0, F.lit(0).cast("long")).otherwise(F.floor((n * factor).cast("decimal(20,0)") / d.cast("decimal(20,0)"))))


def sketches(scored: DataFrame) -> DataFrame:
    """Bucket counts of each rate over the documents that pass the base rules: lang, source, rate, bucket, n."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _rate(r).alias("bucket")) for r in RATES]))
    rows = scored.where(~F.col("_quality.base_failed")).select("lang", "source", each.alias("b")).select("lang", "source", "b.*")
    return rows.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def merge(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(merged: DataFrame, *keys: str) -> DataFrame:
    """keys, docs, and for each rate hi_ and, where too little counts too, lo_: quartiles and FENCE ranges beyond."""
    group = Window.partitionBy(*keys, "rate")
    ranked = merged.withColumns({"cum": F.sum("n").over(group.orderBy("bucket")), "all": F.sum("n").over(group)})
    at = lambda quarter: F.min(F.when(4 * F.col("cum") >= quarter * F.col("all"), F.col("bucket")))
    q = ranked.groupBy(*keys, "rate").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("all").alias("docs"))
    spread = FENCE * (F.col("q3") - F.col("q1"))
    out = [F.max("docs").alias("docs")]
    for r, (*_, both) in RATES.items():
        out += [F.max(F.when(F.col("rate") == r, F.col("q3") + spread)).alias(f"hi_{r}")]
        out += [F.max(F.when(F.col("rate") == r, F.col("q1") - spread)).alias(f"lo_{r}")] if both else []
    return q.groupBy(*keys).agg(*out)


LIMITS = [f"hi_{r}" for r in RATES] + [f"lo_{r}" for r, x in RATES.items() if x[-1]]


def thresholds(scored: DataFrame) -> DataFrame:
    """The fences that hold for each (lang, source) of ``scored``: lang, source, and LIMITS as doubles.

    Small groups are drawn towards their language, languages towards all documents.
    """
    parts = stage(sketches(scored), "quality-sketches")
    whole = fences(merge(parts)).first()
    drawn = lambda own, docs, prior: (F.col(docs).cast("double") * F.col(own).cast("double") + F.lit(float(PRIOR)) * prior) / (F.col(docs).cast("double") + F.lit(float(PRIOR)))
    # one row without keys: its few numbers go in as literals
    last = {n: F.lit(whole[n]).cast("double") for n in LIMITS}
    coarse = fences(merge(parts, "lang"), "lang").select(F.col("lang").alias("l"), *[drawn(n, "docs", last[n]).alias(f"b_{n}") for n in LIMITS])
    fine = fences(parts, "lang", "source").join(coarse, F.col("lang").eqNullSafe(F.col("l")))
    return stage(fine.select("lang", "source", *[drawn(n, "docs", F.col(f"b_{n}")).alias(n) for n in LIMITS]), "quality-fences")


def _within(name: str) -> Column:
    """Whether a document's count lies where the fences of its group and the chance of a count of its size allow."""
    count, factor, of, _, both = RATES[name]
    lot, n, d = float(LOT.get(name, 1)), F.col(f"_quality.{count}").cast("double"), F.col(f"_quality.{of}").cast("double")
    expected = lambda limit: F.greatest(F.col(f"_limits.{limit}_{name}") * d / F.lit(float(factor)), F.lit(0.0))
    chance = lambda e: F.lit(float(FENCE)) * F.sqrt(F.lit(lot) * (e + F.lit(lot)))
    above = n <= expected("hi") + chance(expected("hi"))
    return above & (n >= expected("lo") - chance(expected("lo"))) if both else above


def judge(scored: DataFrame) -> DataFrame:
    """``scored`` with a boolean column ``_kept``. Reads ``scored`` twice: stage it first."""
    given = thresholds(scored)
    limits = given.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct(*LIMITS).alias("_limits"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    verdict = ~F.col("_quality.base_failed") & F.coalesce(reduce(Column.__and__, [_within(r) for r in RATES]), F.lit(False))
    return out.withColumn("_kept", verdict).drop("_l", "_s", "_limits")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, as they were."""
    scored = stage(score(packed(docs, *_READ)), "quality-scored")
    return unpacked(judge(scored).where("_kept"), docs.columns, *_READ)
