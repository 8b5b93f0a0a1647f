"""Each operator against plain Python on small tables, with nulls, empty and long texts, ties, repeats and odd columns."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, language_id, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece_tok, simhash, topk, warc
from tidemark.llm.components import components

WS = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, rows string, _keep string"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    line = lambda n: " ".join(rng.choices(vocab, k=n))
    rows = [(i, "\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(2, 9))), rng.choice(["en", "fr"]), f"s{i % 3}") for i in range(60)]
    shared = "A line that several documents share, twice"
    for i in (3, 9, 21, 30):
        rows[i] = (i, rows[i][1] + f"\n  {shared.upper() if i == 9 else shared}\t\n{shared}", *rows[i][2:])
    rows[40] = (40, rows[41][1], "en", "s0")  # an exact copy
    rows[43] = (43, rows[44][1] + " " + vocab[0], None, None)  # a near copy
    rows += [(100, None, "en", "s0"), (101, "", "fr", None), (102, " \n\t\x0b ", None, "s1"), (103, "one", "en", "s1"), (7, rows[7][1], "en", "s1"), (None, rows[8][1], "en", "s2"), (None, None, None, None)]
    rows += [(104, "é" * 30 + "\nÉ" + "x" * 30 + "\n" + "long text " * 30000, "fr", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z") for r in texts], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(frame):
    return [tuple(r) for r in frame.collect()]


# 1


def formatted(spark, given):
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in given], "conv_id long, record string").withColumn("record", F.parse_json("record"))
    return chat_format.canonical_turns(table)


def test_layouts_lead_to_the_same_turns(spark):
    same = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversation": {"messages": [{"content": "q", "role": "user"}, {"role": "assistant", "content": "a"}]}},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"question": "q", "answer": "a"},
    ]
    found = formatted(spark, enumerate(same)).orderBy("conv_id", "turn").select("conv_id", "role", "text").collect()
    assert [tuple(r) for r in found] == [x for i in range(len(same)) for x in ((i, "user", "q"), (i, "assistant", "a"))]


def test_unknown_layouts_keep_a_row_and_paths_nest(spark):
    odd = formatted(spark, [(1, {"a": {"b": [{"c": 1}], "we ird": None}, "z": []})]).collect()
    assert [(r["layout"], r["turn"], r["text"]) for r in odd] == [(None, None, None)]
    record = spark.createDataFrame([(json.dumps({"a": {"b": [{"c": 1, "d": [[2]]}]}, "z": "x"}),)], "r string")
    assert record.select(chat_format.field_paths(F.parse_json("r")).alias("p")).first()["p"] == ["a", "a.b", "a.b[].c", "a.b[].d", "z"]


def test_control_strings_survive(spark):
    said = ["\\", "<turn:user>", "</turn>\n", "\\b\\l", "a\\<>\\", "", None, "\\### Assistant: </turn> ok", "é\n" * 50]
    table = spark.createDataFrame([(1, i, r, t) for i, t in enumerate(said) for r in ("assistant",)] + [(2, None, None, "x"), (2, None, None, "x"), (None, 1, "us>er", "y")], "conv_id long, turn long, role string, text string")
    turns = table.select("conv_id", "turn", F.lit(0).cast("long").alias("part"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    read = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    assert [t["text"] for t in read[1]["turns"]] == [t or "" for t in said] == read[1]["learned"]
    assert [(t["role"], t["text"]) for t in read[2]["turns"]] == [("", "x"), ("", "x")] and read[2]["learned"] == ["", ""]
    assert read[None]["turns"][0]["role"] == "us>er"
    for r in read.values():
        cut = [r["formatted"][m["start"] : m["end"]] for m in r["loss_mask"]]
        assert [c.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") for c in cut] == r["learned"]
    assert rows(chat_format.format_chats(turns.limit(0))) == []


# 2


def counted(text):
    text = text or ""
    w, lines = WS.findall(text), [x for x in text.split("\n") if WS.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        covered |= set(range(i, i + 8)) if many[x] > 1 else set()
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, texts):
    some = [(i, t) for i, t in enumerate(["a b c d e f g h a b c d e f g h", "x " * 40, "# $ |\n# $ |\n\n\n", *(t[1] for t in texts)])]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in some], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.score(frame).select("doc_id", "_quality.*").collect()}
    for i, t in some:
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(t), t
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_quality_keeps_prose_and_drops_junk(spark, docs, none):
    rng = random.Random(3)
    prose = [(i, " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(2, 9))) for _ in range(80)) + ".", "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(f"word{i}{j}$$$ ###{j} |" for j in range(60)), "en", "a") for i in range(5)]
    frame = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string, source string")
    assert sorted(r["doc_id"] for r in quality_rules.keep_good(frame).collect()) == list(range(300))
    assert quality_rules.keep_good(none).columns == docs.columns and rows(quality_rules.keep_good(none)) == []
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_sources_with_other_habits_get_other_fences(spark):
    """The same text is kept where a source's documents all have such symbols, and goes where none has."""
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choices("abcdefghijk", k=rng.randint(3, 8))) for _ in range(80))
    marked = lambda share: " ".join(w + ("##" if rng.random() < share else "") for w in prose().split())
    same = marked(0.3)
    table = [(i, prose(), "en", "plain") for i in range(300)] + [(1000 + i, marked(rng.uniform(0.1, 0.4)), "en", "marked") for i in range(300)]
    table += [(500, same, "en", "plain"), (1500, same, "en", "marked")]
    # a source of three documents goes by its language, a language of three by all documents
    table += [(2000 + i, prose(), "en", "tiny") for i in range(3)] + [(3000 + i, prose(), "xx", None) for i in range(3)] + [(3010, "#$%& " * 60 + prose(), "xx", None)]
    kept = {r["doc_id"] for r in quality_rules.keep_good(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")).collect()}
    assert 1500 in kept and 500 not in kept
    assert len(kept & set(range(300))) > 290 and len(kept & set(range(1000, 1300))) > 290
    assert kept >= {2000, 2001, 2002, 3000, 3001, 3002} and 3010 not in kept


def test_sketches_merge(spark):
    halves = [spark.createDataFrame([("r", b, n) for b, n in x], "rate string, bucket long, n long") for x in ([(1, 3), (2, 5)], [(2, 1), (9, 4)])]
    merged = quality_rules.merge(halves[0].unionByName(halves[1]))
    assert sorted((r["bucket"], r["n"]) for r in merged.collect()) == [(1, 3), (2, 6), (9, 4)]


# 3


def plain_print(text, size=4):
    w = WS.findall(low(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clusters(prints):
    """Smallest id of each component, by comparing all pairs."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in prints}


def test_simhash(docs, texts, none):
    found = rows(simhash.near_duplicates(docs).select("doc_id", simhash.hex_of(F.col("fp")), "component_id"))
    prints = [(i, plain_print(t)) for i, t, *_ in texts if i is not None]
    want = clusters(list(dict(prints).items()))
    assert sorted((i, f, c) for i, f, c in found if i is not None) == sorted((i, f"{p:016x}", want[i]) for i, p in prints)
    assert len(found) == len(texts)
    assert rows(simhash.near_duplicates(none)) == []
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert rows(simhash.near_dedup(none)) == []


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    rng = random.Random(29)
    a, b, c, d, e, f, g = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(7))
    table = [(None, a), (None, a), (None, b), (None, c), (7, c), (1, d), (1, e), (1, e), (2, f), (3, f), (3, g), (None, d)]
    want = [(1, d), (1, e), (2, f), (3, g), (7, c), (None, a), (None, b)]
    kept = simhash.near_dedup(spark.createDataFrame(table, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_word_pieces_of_long_texts(monkeypatch):
    text = "Some words é and\tmore\nwords " * 40
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 17)
    assert simhash.fingerprint(text) == whole == struct.unpack("<q", struct.pack("<Q", plain_print(text)))[0]


def test_anchors_meet_all_links_and_skew_is_dealt_out(spark, monkeypatch):
    assert {len(x) for x in simhash._patterns(3)} == {1} and {len(x) for x in simhash._patterns(4)} == {1, 6}
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    near = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(200)}
    far = {rng.getrandbits(64) for _ in range(300)}
    prints = [(i, p) for i, p in enumerate(sorted(near | far))]
    signed = [(i, struct.unpack("<q", struct.pack("<Q", p))[0]) for i, p in prints]
    monkeypatch.setattr(simhash, "CELL", 20)
    want: dict = {}
    for i, c in clusters(prints).items():
        want.setdefault(c, set()).add(i)
    for scheme in (simhash.FEW, simhash.MANY):
        found = rows(components(simhash.links(spark.createDataFrame(signed, "i long, fp long"), scheme)))
        number = {p: i for i, p in signed}
        groups: dict = {}
        for node, root in found:
            groups.setdefault(root, {root}).add(node)
        assert sorted(sorted(number[p] for p in g) for g in groups.values()) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_every_pair_within_reach_of_a_block_meets():
    """What differs in up to four bits is, in some block, at the home of the other, by either plan."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**63, 300, dtype=np.int64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(63, rng.integers(1, 5), replace=False):
            y[i] ^= np.int64(1) << np.int64(b)
    for scheme in (simhash.FEW, simhash.MANY):
        homes, others = (set() for _ in range(2))
        for i, key, home in zip(*simhash.anchors(x, scheme), strict=True):
            homes |= {(i, key)} if home else set()
        for i, key, _ in zip(*simhash.anchors(y, scheme), strict=True):
            others.add((i, key))
        assert {i for i, _ in homes & others} == set(range(300)) and len(homes) == 300 * len(scheme.blocks)


def test_similar_texts_of_five_word_shingles(spark):
    """Nearly all pairs of a similarity well above 0.8 are one document, and none of pairs well below."""
    rng = random.Random(31)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(3000)]
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    table, alike, apart = [], [], []
    for i in range(150):
        text, rate = rng.choices(vocab, k=300), rng.choice([0.002, 0.01, 0.2])
        other = [rng.choice(vocab) if rng.random() < rate else w for w in text]
        j = len(grams(text) & grams(other)) / len(grams(text) | grams(other))
        alike += [i] if j >= 0.9 else []
        apart += [i] if j < 0.5 else []
        table += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(table, "doc_id long, text string"), simhash.SIMILAR).collect()}
    assert set(range(0, 300, 2)) <= kept
    assert len(alike) > 30 and sum(2 * i + 1 in kept for i in alike) <= 0.02 * len(alike) and all(2 * i + 1 in kept for i in apart)
    assert simhash.wide_fingerprint("some words of a text here", 5, 4)[0] == simhash.fingerprint("some words of a text here", 5)
    assert [r["text"] for r in simhash.near_dedup(spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string"), simhash.SIMILAR).collect()] == [None]


def test_components_of_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 100), (5, 5)], "a long, b long")
    assert dict(rows(components(chain))) == {**{i: 0 for i in range(1, 71)}, 200: 100}


# 4


def test_classifier_finds_grades_it_has_not_seen(spark, none):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    bad = ["vile", "awful", "nasty"]

    def text(grade):
        w = rng.choices(words, k=80)
        if grade == 0:
            return " ".join(x.upper() + "!!" for x in w)
        return " ".join(w if grade == 2 else [*w[:40], rng.choice(bad), *w[40:]])

    given = [(i, text(g := rng.choice([0, 1, 2, 2])), g) for i in range(700)]
    frame = spark.createDataFrame([(i, t) for i, t, _ in given] + [(900, None), (901, " ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g > 0), int(g == 1)) for i, _, g in given[:500]] + [(0, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(frame, quality_classifier.graded(labels))
    found = {r["doc_id"]: r for r in quality_classifier.classify(frame, model).collect()}
    unseen = given[500:]
    assert np.mean([found[i]["selected"] == (g == 2) for i, _, g in unseen]) > 0.95
    assert np.mean([round(found[i]["expected_grade"]) == g for i, _, g in unseen]) > 0.9
    assert list(model.cuts) == sorted(model.cuts)
    assert [(found[i]["expected_grade"], found[i]["selected"]) for i in (900, 901)] == [(0.0, False)] * 2
    nothing = quality_classifier.fit(frame, quality_classifier.graded(labels.limit(0)))
    assert nothing is None and quality_classifier.classify(frame, None).where("selected OR p_top IS NOT NULL").count() == 0
    assert rows(quality_classifier.classify(none, model)) == []


def test_ordinal_model_against_plain_python():
    """Probabilities from the formula, and at the fitted point no change of a weight or a cut is any better."""
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        numbers = np.array(sorted(rng.sample(range(6), 2)), np.int32)
        score = sum(n - 2.5 for n in numbers) + rng.gauss(0, 2)
        rows.append((int(score > -1) + int(score > 2), rng.choice([1.0, 2.0]), numbers, np.ones(2, np.float32)))
    model = quality_classifier.train(rows)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def loss(weights, cuts):
        total = 0.0
        for grade, weight, numbers, values in rows:
            eta = sum(weights[n] * v for n, v in zip(numbers, values, strict=True))
            upper, lower = (sigmoid(cuts[grade] - eta) if grade < 2 else 1.0), (sigmoid(cuts[grade - 1] - eta) if grade else 0.0)
            total -= weight * np.log(max(upper - lower, 1e-12))
        return total / sum(r[1] for r in rows) + quality_classifier.RIDGE / 2 * sum(w * w for w in weights[:6])

    weights, cuts = model.weights.astype(float), np.array(model.cuts, float)
    at = loss(weights, cuts)
    for i in range(6):
        for step in (-0.05, 0.05):
            other = weights.copy()
            other[i] += step
            assert loss(other, cuts) > at - 1e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(weights, cuts + step * np.eye(2)[k]) > at - 1e-4
    for _, _, numbers, values in rows[:20]:
        eta = float(weights[numbers] @ values)
        want = [sigmoid(cuts[0] - eta), sigmoid(cuts[1] - eta) - sigmoid(cuts[0] - eta), 1 - sigmoid(cuts[1] - eta)]
        assert model.probabilities(numbers, values) == pytest.approx(want, abs=1e-6)


# 5


def test_language(spark, none):
    rng = random.Random(2)
    sound = {"xx": "abcde", "yy": "fghij", "zz": "klmnoéü"}
    text = lambda x: " ".join("".join(rng.choices(sound[x], k=rng.randint(2, 8))) for _ in range(40))
    given = [(i, text(x := rng.choice(list(sound))), x) for i in range(300)]
    odd = [(1000, None, "xx"), (1001, "123 !!", None), (1002, "漢字", None), (1003, "", "yy"), (None, text("zz"), "yy")]
    frame = spark.createDataFrame(given + odd, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.identify(frame, language_id.fit(frame)).collect()}
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in given)
    assert all(found[i]["lang_pred"] == x and 0 <= found[i]["score"] <= 1 for i, _, x in given)
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1003)] == ["und"] * 3
    assert found[1002]["lang_pred"] == "xx" and found[None]["lang_pred"] == "zz" and found[None]["held_out"]
    assert language_id.Filters([], []).predict("text") == ("und", 0.0)
    assert rows(language_id.identify(none.select("doc_id", "text", "lang"))) == []


def test_corrected_popcounts_by_n_gram_sets(spark):
    """Predictions recomputed from plain sets of n-grams; with filters as large as these no answer is a false positive."""
    rng = random.Random(21)
    sound = {f"l{i}": rng.sample("abcdefghijklmnopqrstuvwxyzéüñ", 9) for i in range(4)}
    text = lambda x: " ".join("".join(rng.choices(sound[x], k=rng.randint(1, 6))) for _ in range(rng.randint(3, 60)))
    given = [(i, text(x := rng.choice(list(sound))), x) for i in range(200)]
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string")

    def grams(t):
        t = re.sub(r"[^a-zéüñ]+", " ", f" {t.lower()} ")
        return [(n, t[i : i + n]) for n in language_id.SIZES for i in range(len(t) - n + 1)]

    seen = {x: Counter() for x in sound}
    for i, t, x in given:
        if zlib.crc32(str(i).encode()) % 5:
            seen[x].update(grams(t))
    totals = {(x, n): sum(c for (m, _), c in seen[x].items() if m == n) for x in sound for n in language_id.SIZES}
    held = {x: {g for g, c in seen[x].items() if c >= max(2, totals[x, g[0]] * language_id.RATE)} for x in sound}
    for r in language_id.identify(frame).collect():
        hits = {x: sum(g in held[x] for g in grams(r["text"])) for x in sorted(sound)}
        best = max(hits, key=hits.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(hits[best] / sum(hits.values()), abs=2e-3)


def test_three_hundred_languages(spark, monkeypatch):
    """Each with a word of its own; none is left out, and too many for the table are refused."""
    rng = random.Random(12)
    name = lambda i: "".join(chr(97 + i // 26**p % 26) for p in range(2))
    own = ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(300)]
    given = [(i * 10 + j, f"{own[i]} " * 9, f"{name(i)}-X{i}") for i in range(300) for j in range(6)]
    frame = spark.createDataFrame(given, "doc_id long, text string, lang string").repartition(4)
    found = language_id.identify(frame).select("lang", "lang_pred", "held_out").collect()
    assert all(r["lang"] == r["lang_pred"] for r in found)
    monkeypatch.setattr(language_id, "LANGUAGES", 299)
    with pytest.raises(ValueError, match="299 languages"):
        language_id.fit(frame)


def test_ngrams_do_not_depend_on_pieces(monkeypatch):
    text = "Some, words!  12 and\nmore" * 30
    whole = {size: np.sort(keys) for size, keys in language_id.ngrams(text)}
    monkeypatch.setattr(language_id, "PIECE", 10)
    parts: dict = {}
    for size, keys in language_id.ngrams(text):
        parts.setdefault(size, []).append(keys)
    assert all((np.sort(np.concatenate(parts[s])) == whole[s]).all() for s in language_id.SIZES)


def test_filters_never_deny_and_rarely_invent():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 30_000, dtype=np.int64).view(np.uint64)
    filters = language_id.Filters([f"l{i:02}" for i in range(70)], [(0, keys[:10_000]), (69, keys[10_000:20_000])])
    assert filters.counts(keys[:10_000])[0] == 10_000 and filters.counts(keys[10_000:20_000])[69] == 10_000
    assert filters.counts(keys[20_000:])[0] < 20 and filters.counts(keys)[5] == 0


# 6


def test_warc_round_trip(spark, monkeypatch):
    long, page = "<p>é</p>" * 40, "page_id long, url string, html string, digest string"
    given = [(5, "http://a\r\nX: y", long), (3, None, long), (9, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (3, "u", long), (None, "u", long), (7, "u", "x\r\n\r\nWARC/1.1\r\n" * 20), (6, "u", "big" * 200_000)]
    frame = spark.createDataFrame([(*g, "mine") for g in given], page).repartition(2)
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    monkeypatch.setattr(warc, "PART", 500)
    found = rows(warc.round_trip(frame).drop("url"))

    def want(i, html):
        raw = (html or "").encode()
        revisit = html == long and i != 3
        return i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None

    assert sorted(map(str, found)) == sorted(str(want(i, h)) for i, _, h in given)
    assert rows(warc.round_trip(frame.limit(0))) == []


def test_normalised_members_stand_alone(spark):
    plan = warc.planned(spark.createDataFrame([(i, "u", f"text {i}" * 30) for i in range(20)], "page_id long, url string, html string"))
    one = warc.normalise(warc.write_archives(plan.coalesce(1))).collect()
    whole = b"".join(r["content"] for r in one)
    index = [x for r in one for x in r["index"]]
    assert len(index) == 20 and sum(x["length"] for x in index) == len(whole)
    for x in index:
        member = whole[x["offset"] : x["offset"] + x["length"]]
        assert f"<{warc.URN}{warc.read_member(member)['page_id']}>" == x["record_id"]
        assert zlib.decompressobj(31).decompress(member).startswith(b"WARC/1.1")
    with pytest.raises(ValueError):
        list(warc.records_in(zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", wbits=31)))


def test_foreign_archives_and_saved_files(spark, tmp_path):
    """Records of other writers are read as they are; what is saved as files is read back by its index."""
    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()

    def foreign(kind, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", *more, f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(lines).encode() + block + b"\r\n\r\n"

    said = "Content-Type: application/http; msgtype=response"
    whole = foreign("warcinfo", b"software: x\r\n") + foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request")
    whole += foreign("response", http, said, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Target-URI: http://a/") + foreign("revisit", http[: -len(body)], said, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:response>")
    whole += foreign("metadata", b"") + foreign("response", http, said)
    archives = spark.createDataFrame([("x/crawl.warc.gz", zlib.compress(whole, wbits=31))], warc.ARCHIVES)
    normal = warc.normalise(archives)
    found = [(r["record_type"], r["payload_bytes"], r["page_id"], r["refers_to"]) for r in warc.read_records(normal).collect()]
    assert found == [("warcinfo", 13, None, None), ("request", 0, None, None), ("response", 12, None, None), ("revisit", None, None, None), ("metadata", 0, None, None), ("response", 12, None, None)]
    wrong = spark.createDataFrame([("y", zlib.compress(foreign("response", http, said, "WARC-Payload-Digest: sha1:" + "A" * 32), wbits=31))], warc.ARCHIVES)
    with pytest.raises(Exception, match="not what its headers say"):
        warc.read_records(warc.normalise(wrong)).collect()
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i % 7} " * 40) for i in range(30)], "page_id long, url string, html string")
    made = warc.normalise(warc.write_archives(warc.planned(pages).coalesce(2)))
    saved = warc.save(made.unionByName(normal), f"file://{tmp_path}/out")
    assert saved.agg(F.sum("records")).first()[0] == 36
    files = sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith("."))
    assert len(files) == 2 * saved.count() and "crawl-00000.warc.gz" in files and "crawl-00000.warc.gz.index.jsonl" in files
    again = warc.read_records(warc.opened(spark, f"file://{tmp_path}/out"))
    assert sorted(map(str, again.where("page_id IS NOT NULL").collect())) == sorted(map(str, warc.read_records(made).collect())) and again.count() == 36


# 7


def test_sentencepiece_parity_on_every_document(spark, docs, texts, none):
    import sentencepiece

    model = sentencepiece_tok.read_model()
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
    extra = [(500, "  spaces  within "), (501, "▁ mark ▁▁"), (502, "你好\U0001f600"), (503, "a b " * 3000), (504, "<s> <0x41>")]
    frame = docs.select("doc_id", "text", "n_chars").unionByName(spark.createDataFrame([(i, t, 0) for i, t in extra], "doc_id long, text string, n_chars long"))
    out = sentencepiece_tok.decode(sentencepiece_tok.encode(frame)).collect()
    assert len(out) == len(texts) + len(extra)
    for r in out:
        if r["text"] is None:
            assert r["ids"] is None and r["n_tokens"] is None and r["decoded"] is None
        else:
            assert r["ids"] == theirs.encode(r["text"]) and r["n_tokens"] == len(r["ids"])
            assert r["parity"] and r["round_trip"] and r["decoded"] == theirs.decode(r["ids"])
    assert rows(sentencepiece_tok.encode(none)) == []


def test_parity_and_round_trip_are_asked_of_whole_documents(monkeypatch):
    """Ids that are wrong for a document are told, however they came about."""
    data = sentencepiece_tok.read_model()
    encoder = sentencepiece_tok.Encoder(data)
    texts = ["some plain words", "other plain words", "  odd   spaces ", None, ""]
    assert [x.to_pylist() for x in encoder.encode(pa.array(texts))[2:]] == [[True, True, True, None, True]] * 2
    number = encoder.numbers["some"]
    encoder.ids[encoder.starts[number]] = 7
    _, _, same, back = (x.to_pylist() for x in encoder.encode(pa.array(texts)))
    assert same == [False, True, True, None, True] and back[0] is False
    unasked = sentencepiece_tok.Encoder(data, parity=False).encode(pa.array(texts))
    assert unasked[2].to_pylist() == [None] * 5 and unasked[0].to_pylist()[1] == encoder.encode(pa.array(texts))[0].to_pylist()[1]


def _field(number, value):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_unigram_model_with_byte_fallback():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]]
    pieces += [("▁", -3.0, 1), ("▁he", -2.0, 1), ("llo", -2.5, 1), ("▁hello", -6.0, 1), *[(c, -5.0, 1) for c in "helowrd<>s/0x41unk"]]
    model = b"".join(_field(1, _field(1, t.encode()) + _field(2, s) + (_field(3, k) if k != 1 else b"")) for t, s, k in pieces)
    model += _field(2, _field(3, 1) + _field(35, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1) + _field(5, 1))
    tokenizer = sentencepiece_tok.build(model)
    assert all(sentencepiece_tok.verify_parity(tokenizer, model, ["hello world", " hello  hello ", "hé", "", "held", "<s><0x41>", " \n "]))
    encoder = sentencepiece_tok.Encoder(model, parity=False)
    assert not encoder.by_words


# 8


def test_line_dedup(docs, texts, none):
    holders: dict = {}
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: -(2**63) if i is None else i
    for i, t, *_ in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(order(i))
    gone = lambda i, line: len(held := holders.get(key(line), ())) >= 3 and order(i) < max(held)
    want = []
    for i, t, *_ in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not gone(i, x)]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    found = rows(line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))))
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert sum(w[2] for w in want) == 6
    out = line_dedup.with_shared_lines_dropped(docs)
    assert out.columns == docs.columns and out.where("text IS NULL").count() == 2
    assert out.where("n_chars <> char_length(coalesce(text, ''))").count() == 0
    assert rows(line_dedup.line_dedup(none)) == []


def test_columns_of_any_name_are_carried_along(spark):
    """Every operator that returns its input's rows, on columns named like its own."""
    names = ["gone", "h1", "pos", "shared", "score_", "fp", "rows", "_rest", "_sp_text", "_lid", "_qc", "ids_", "kth", "anchor"]
    texts = ["a line that is long enough to count\nown words of it here %d" % i for i in range(4)]
    frame = spark.createDataFrame([(i, t, "en", "s", *["x"] * len(names)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(frame, quality_classifier.graded(labels))
    outs = {
        "lines": line_dedup.line_dedup(frame), "kept lines": line_dedup.with_shared_lines_dropped(frame), "language": language_id.identify(frame), "pieces": sentencepiece_tok.encode(frame),
        "grades": quality_classifier.classify(frame, model), "near": simhash.near_dedup(frame), "mixed": mixing.emit(frame),
    }
    for what, out in outs.items():
        row = out.orderBy("doc_id").first()
        assert [row[n] for n in names] == ["x"] * len(names), what
    assert [r["n_dropped"] for r in outs["lines"].withColumn("n_lines", F.lit("mine")).orderBy("doc_id").collect()] == [1, 1, 1, 0]
    again = line_dedup.line_dedup(outs["lines"].withColumn("n_lines", F.lit("mine")))
    assert again.columns.count("n_lines") == 1 and again.schema["n_lines"].dataType.simpleString() == "bigint"


def test_columns_named_like_an_operators_own_are_replaced(spark):
    frame = spark.createDataFrame([(1, "some words", "mine", "mine", "mine")], "doc_id long, text string, ids string, score string, p_top string").withColumn("lang", F.lit("en"))
    assert sentencepiece_tok.encode(frame).first()["ids"] != "mine"
    assert language_id.identify(frame).first()["score"] != "mine" and quality_classifier.classify(frame, None).first()["p_top"] is None


# 9


def test_mixing(spark, docs, texts, none):
    sized = mixing.with_size(docs)
    found = mixing.mix(sized, mixing.plan(sized)).select("doc_id", "source", "size", "source_size", "target", "taken", "copies").collect()
    sizes = Counter()
    for _, t, _, s in texts:
        sizes[s] += len(WS.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else share[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    assert len(found) == len(texts)
    for r in found:
        assert r["size"] == len(WS.findall(next(t for i, t, _, s in texts if (i, s) == (r["doc_id"], r["source"])) or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    again = mixing.mix(sized, mixing.plan(sized)).select("doc_id", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in spark.createDataFrame([(r["doc_id"], r["copies"]) for r in found], "doc_id long, copies long").collect())
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in found)
    assert rows(mixing.emit(none)) == [] and rows(mixing.emit(docs.where("text IS NULL"))) == []


def test_targets_are_met_on_many_documents(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), (1 + F.col("id") * 7919 % 400).alias("size"))
    taken = mixing.mix(frame, mixing.plan(frame)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.02 * r["target"] for r in taken)


# 10


def test_topk_is_exact(spark):
    rng = random.Random(4)
    hot = rng.getrandbits(64)
    codes = [(i, hot if i % 3 == 0 else rng.getrandbits(64) if i % 3 == 1 else hot ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for i in range(400)]
    frame = spark.createDataFrame([(i, struct.unpack("<q", struct.pack("<Q", c))[0]) for i, c in [*codes, codes[0]]] + [(None, 1), (900, None)], "id long, code long")
    found = topk.search(frame, k=5, asks=F.col("id") % 40 == 0).orderBy("query_id", "rank").collect()
    want = []
    for q, c in codes:
        if q % 40 == 0:
            best = sorted(((c ^ d).bit_count(), i) for i, d in codes if i != q)[:5]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    assert [tuple(r) for r in found] == want
    few = spark.createDataFrame([(0, 1), (1, 2), (2, -1)], "id long, code long")
    assert [tuple(r) for r in topk.search(few).where("query_id = 0").orderBy("rank").collect()] == [(0, 1, 1, 2), (0, 2, 2, 63)]
    assert rows(topk.search(few.limit(0))) == []


def test_topk_takes_ties_at_the_kth_distance_by_id(spark):
    """Many codes at the distance that the kth neighbour has, met in different rounds: the smallest ids must win."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    at = lambda n: base ^ sum(1 << b for b in rng.sample(range(64), n))
    codes = [(0, base)] + [(1000 - i, at(9)) for i in range(60)] + [(2000 + i, at(8)) for i in range(2)] + [(3000 + i, at(30)) for i in range(300)]
    frame = spark.createDataFrame([(i, struct.unpack("<q", struct.pack("<Q", c))[0], "x") for i, c in codes], "id long, code long, kth string")
    for k in (1, 4, 30):
        want = sorted(((base ^ c).bit_count(), i) for i, c in codes if i)[:k]
        found = topk.search(frame, k=k, asks=F.col("id") == 0).orderBy("rank").collect()
        assert [(r["distance"], r["neighbour_id"]) for r in found] == want


def test_sign_codes(spark):
    frame = spark.createDataFrame([([1.0, -1.0, 0.5] + [0.0] * 60 + [2.0],), (None,)], "v array<float>")
    assert [r["c"] for r in frame.select(topk.sign_code(F.col("v")).alias("c")).collect()] == [5 - 2**63, None]
