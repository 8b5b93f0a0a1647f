"""The corpus operators as registered queries, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, language_id, line_dedup, mixing, quality_classifier, quality_rules, sentencepiece_tok, simhash, topk, warc
from tidemark.llm._shared import load, stage

SQL_WS = r"[\x20\x09-\x0D]"
#: A-Z to a-z in DuckDB, everything else as it is.
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, quality_classifier.graded(load(spark, sf_dir, "labels")))
    return quality_classifier.classify(docs, model).drop("text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs.drop("lang"), language_id.fit(docs)).drop("text")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_tok.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    digest = F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256")
    return out.select("doc_id", "n_tokens", digest, "parity", "round_trip")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).drop("url")


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {SQL_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, (s.key IS NOT NULL AND k.doc_id < s.keeper) AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(mixing.with_size(load(spark, sf_dir, "documents")).select("doc_id", "source", "size"), "mix-sizes")
    return mixing.mix(sizes, mixing.plan(sizes)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP9_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
water AS (
  SELECT *, row_number() OVER o AS k, sum(s) OVER () - coalesce(3 * sum(s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM src WINDOW o AS (ORDER BY s::DOUBLE / w, source NULLS LAST)),
level AS (SELECT k, rest, w_left FROM water WHERE 3 * s * w_left >= w * rest ORDER BY k LIMIT 1),
targets AS (
  SELECT source, s, CASE WHEN water.k < level.k THEN (3 * s)::DOUBLE ELSE (w * level.rest)::DOUBLE / level.w_left::DOUBLE END AS target FROM water, level),
rates AS (SELECT *, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE target / s END AS rate FROM targets),
drawn AS (
  SELECT d.*, r.s, r.target, b * 8 + i AS seed,
         d.size * (floor(rate)::BIGINT + (CASE WHEN ('0x' || substr(sha256('mix:' || b || ':' || coalesce(doc_id::VARCHAR, 'null')), 1 + 8 * i, 8))::UBIGINT::DOUBLE
                                          < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END))::BIGINT AS taken,
         floor(rate)::BIGINT + (CASE WHEN ('0x' || substr(sha256('mix:' || b || ':' || coalesce(doc_id::VARCHAR, 'null')), 1 + 8 * i, 8))::UBIGINT::DOUBLE
                                          < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, range(0, 4) blocks(b), range(0, 8) parts(i)),
sums AS (SELECT source, seed, abs(sum(taken)::DOUBLE - any_value(target)) AS off_by FROM drawn GROUP BY source, seed),
best AS (SELECT source, seed FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY off_by, seed) = 1)
SELECT d.doc_id, d.size, d.s AS source_size, d.target, d.taken, d.copies, d.source
FROM drawn d JOIN best b ON d.seed = b.seed AND d.source IS NOT DISTINCT FROM b.source
"""

def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = load(spark, sf_dir, "conversations").select("conv_id", F.to_variant_object(F.struct("role", "text", "turn")).alias("record"))
    said = r"\### Assistant: </turn> ok"
    extra = {"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}
    given = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.parse_json(F.lit(json.dumps(extra))).alias("record"))
    turns = chat_format.canonical_turns(table.unionByName(given))
    read = chat_format.read_back(chat_format.format_chats(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(0, 2) r(i))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length('<turn:></turn>' || chr(10)) + length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    scored = stage(quality_rules.score(docs).drop("text"), "quality-scored")
    return quality_rules.judge(scored).select("doc_id", *[f"_quality.{c}" for c in (*quality_rules.COUNTS, "base_failed")], F.col("_kept").alias("kept"))


_RATE_SQL = {
    r: f"least({most}, CASE WHEN {d} = 0 THEN 0 ELSE ({f} * {n}) // {d} END)::BIGINT" for r, (n, f, d, most, _) in quality_rules.RATES.items()
}
_FENCE_SQL = ", ".join(
    f"max(q3 + {quality_rules.FENCE} * (q3 - q1)) FILTER (WHERE rate = '{r}') AS hi_{r}"
    + (f", max(q1 - {quality_rules.FENCE} * (q3 - q1)) FILTER (WHERE rate = '{r}') AS lo_{r}" if both else "")
    for r, (*_, both) in quality_rules.RATES.items()
)


def _fences_sql(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""(SELECT {by}max(total) AS docs, {_FENCE_SQL} FROM (
      SELECT {by}rate, min(bucket) FILTER (WHERE 4 * cum >= total) AS q1, min(bucket) FILTER (WHERE 4 * cum >= 3 * total) AS q3, any_value(total) AS total
      FROM (SELECT *, sum(n) OVER (PARTITION BY {by}rate ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {by}rate) AS total
            FROM (SELECT {by}rate, bucket, sum(n) AS n FROM hist GROUP BY {by}rate, bucket))
      GROUP BY {by}rate) {group})"""


def _drawn_sql(t: str, own: str, prior: str) -> str:
    p = f"{quality_rules.PRIOR}::DOUBLE"
    return f"({t}.docs::DOUBLE * {t}.{own}::DOUBLE + {p} * {prior}::DOUBLE) / ({t}.docs::DOUBLE + {p})"


def _within_sql(r: str) -> str:
    n, factor, d, _, both = quality_rules.RATES[r]
    lot = f"{quality_rules.LOT.get(r, 1)}::DOUBLE"
    expected = lambda side: f"greatest({side}_{r} * {d}::DOUBLE / {factor}::DOUBLE, 0::DOUBLE)"
    chance = lambda e: f"{quality_rules.FENCE}::DOUBLE * sqrt({lot} * ({e} + {lot}))"
    above = f"{n}::DOUBLE <= {expected('hi')} + {chance(expected('hi'))}"
    return above + (f" AND {n}::DOUBLE >= {expected('lo')} - {chance(expected('lo'))}" if both else "")


OP2_SQL = rf"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
covered AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM again, range(0, 8) r(k) WHERE n >= 2 GROUP BY doc_id),
feat AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals, len(lines)::BIGINT AS n_lines, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))::BIGINT AS n_echoes
  FROM base b LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {", ".join(f"{x} AS r_{r}" for r, x in _RATE_SQL.items())} FROM feat),
hist AS ({" UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, r_{r} AS bucket, count(*) AS n FROM judged WHERE NOT base_failed GROUP BY lang, source, r_{r}" for r in _RATE_SQL)}),
fine AS {_fences_sql("lang, source")},
coarse AS {_fences_sql("lang")},
whole AS {_fences_sql("")},
langs AS (SELECT c.lang, {", ".join(f"{_drawn_sql('c', n, f'a.{n}')} AS {n}" for n in quality_rules.LIMITS)} FROM coarse c, whole a),
groups AS (SELECT f.lang, f.source, {", ".join(f"{_drawn_sql('f', n, f'l.{n}')} AS {n}" for n in quality_rules.LIMITS)}
  FROM fine f JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, {", ".join(quality_rules.COUNTS)}, base_failed, (NOT base_failed AND coalesce({" AND ".join(_within_sql(r) for r in quality_rules.RATES)}, false)) AS kept
FROM judged j LEFT JOIN groups g ON j.lang IS NOT DISTINCT FROM g.lang AND j.source IS NOT DISTINCT FROM g.source
"""

def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.sign_code(F.col("embedding")).alias("code"))
    return topk.search(rows, asks=F.col("id") % 100 == 0)


OP10_SQL = """
WITH codes AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS code FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, list_sum(list_transform(list_zip(q.code, c.code), lambda p: (p[1] <> p[2])::INT))::INT AS distance
  FROM codes q, codes c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id))::INT AS rank, neighbour_id, distance
FROM pairs QUALIFY rank <= 10
"""

QUERIES = {"op1_chat_format": op1_chat_format, "op2_quality_rules": op2_quality_rules, "op3_simhash": op3_simhash, "op4_quality_classifier": op4_quality_classifier, "op5_language_id": op5_language_id, "op6_warc": op6_warc, "op7_sentencepiece": op7_sentencepiece, "op8_line_dedup": op8_line_dedup, "op9_mixing": op9_mixing, "op10_exact_topk": op10_exact_topk}
SQL = {"op1_chat_format": OP1_SQL, "op2_quality_rules": OP2_SQL, "op6_warc": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_mixing": OP9_SQL, "op10_exact_topk": OP10_SQL}
