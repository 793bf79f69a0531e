"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripwire.llm import audit, bpe, chat, language, license, lines, loglinear, neighbours, packing, pages, partenum, quality, runs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op3_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]
    more = spark.createDataFrame(planted, "conv_id long, turn long, role string, text string")
    return chat.digests(_table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    hashed = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    return bpe.decode(hashed, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, how many of them copy an earlier line, and a digest of what is left."""
    out = lines.dedup(_table(spark, sf_dir, "documents"), short=True)
    return out.select("doc_id", "line_dedup.*", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _with_repeated_ends(documents: DataFrame) -> DataFrame:
    """doc_id and text; for ids whose hash is a multiple of ten, the words from some place on repeat a passage that begins there.

    A null id counts as the empty text in the hash; a null text, or one without words, stays as it is.
    """
    g, n = F.floor(language.id_crc() / 10), F.size("words")
    rows = documents.select("doc_id", "text", (language.id_crc() % 10 == 0).alias("chosen"), g.alias("g"))
    cut = rows.withColumn("words", F.when(F.col("chosen"), F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    placed = cut.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.transform("words", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("chosen") & (n > 0), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(_with_repeated_ends(_table(spark, sf_dir, "documents")))
    # exponents are compared as fractions; of equal ones the first run is taken, and they stand by start and period
    order = lambda x, y: F.when(x["length"] * y["period"] != y["length"] * x["period"], F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int")).when(x["start"] != y["start"], F.signum(x["start"] - y["start"]).cast("int")).otherwise(F.signum(x["period"] - y["period"]).cast("int"))
    best = F.get(F.array_sort("runs", order), 0)
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(spelled, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_loglinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loglinear.score(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_html_main_text": op2_html_main_text,
    "op3_language_ppm": op3_language_ppm,
    "op4_chat_format": op4_chat_format,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_diagonals": op6_license_diagonals,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_ivf_pq": op8_ivf_pq,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_loglinear_scores": op13_loglinear_scores,
}

_UPPER, _LOWER = license._UPPER, license._LOWER

_TEMPLATES = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(license.TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in license.PHRASES.items())

ORACLES: dict[str, str] = {
    "op1_quality_divergence": rf"""
WITH doc AS (SELECT doc_id, lang, text IS NOT NULL AS given, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, lang, unnest(w) AS word FROM doc),
five AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos + 1, pos + 5), ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS pos FROM doc)),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT pos + d) AS n FROM twice, range(0, 5) r(d) GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words FROM doc LEFT JOIN repeated r USING (doc_id)),
common AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM (SELECT lang, word, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY lang, word)) WHERE place <= {quality.COMMON_WORDS}),
c0 AS (SELECT doc_id, lang, given, unnest([
  {{'bin': '0', 'n': length(regexp_replace(x, '[^\x20\x09-\x0D]', '', 'g'))}}, {{'bin': '1', 'n': length(regexp_replace(x, '[^a-z]', '', 'g'))}}, {{'bin': '2', 'n': length(regexp_replace(x, '[^A-Z]', '', 'g'))}},
  {{'bin': '3', 'n': length(regexp_replace(x, '[^0-9]', '', 'g'))}}, {{'bin': '4', 'n': length(regexp_replace(x, '[^.,;:''"?()-]', '', 'g'))}}, {{'bin': '6', 'n': length(regexp_replace(x, '[\x00-\x7F]', '', 'g'))}},
  {{'bin': '5', 'n': length(regexp_replace(x, '[\x20\x09-\x0Da-zA-Z0-9.,;:''"?()-]|[^\x00-\x7F]', '', 'g'))}}]) AS b FROM doc),
counted AS (SELECT 'c' AS kind, doc_id, lang, given, b.bin AS bin, CAST(b.n AS BIGINT) AS n FROM c0 UNION ALL
  SELECT 'w', doc_id, lang, true, bin, count(*) FROM (SELECT doc_id, lang, CASE WHEN common.word IS NULL THEN 'other' ELSE 'w ' || word.word END AS bin FROM word LEFT JOIN common ON common.word = word.word) GROUP BY doc_id, lang, bin),
sums AS (SELECT kind, lang, bin, sum(n) AS n FROM counted WHERE lang IS NOT NULL AND given GROUP BY kind, lang, bin),
ref AS (SELECT kind, lang, bin, n / sum(n) OVER (PARTITION BY kind, lang) AS q FROM sums WHERE n > 0),
own AS (SELECT kind, doc_id, bin, n / greatest(sum(n) OVER (PARTITION BY kind, doc_id), 1) AS p FROM counted),
pair AS (SELECT d.doc_id, r.kind, r.lang, r.bin, r.q, coalesce(o.p, 0) AS p FROM doc d CROSS JOIN ref r LEFT JOIN own o ON o.doc_id = d.doc_id AND o.kind = r.kind AND o.bin = r.bin),
alone AS (SELECT o.doc_id, o.kind, l.lang, sum(o.p) AS p FROM own o JOIN (SELECT DISTINCT kind, lang FROM ref) l ON l.kind = o.kind WHERE NOT EXISTS (SELECT 1 FROM ref r WHERE r.kind = o.kind AND r.lang = l.lang AND r.bin = o.bin) GROUP BY ALL),
js AS (SELECT doc_id, kind, lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) AS s FROM pair GROUP BY ALL),
near AS (SELECT js.doc_id, js.kind, min(sqrt(greatest(0, least(1, (s + coalesce(alone.p, 0)) / 2)))) AS d FROM js LEFT JOIN alone ON alone.doc_id = js.doc_id AND alone.kind = js.kind AND alone.lang = js.lang GROUP BY ALL),
all_ AS (SELECT base.*, round(c.d, 9) AS character_distance, round(v.d, 9) AS word_distance, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base LEFT JOIN near c ON c.doc_id = base.doc_id AND c.kind = 'c' LEFT JOIN near v ON v.doc_id = base.doc_id AND v.kind = 'w')
SELECT *, NOT base_failed AND NOT (n_words >= {quality.GUARD_WORDS} AND coalesce(character_distance > CAST({quality.CHARACTER_LIMIT} AS DOUBLE) + CAST({quality.CHARACTER_NOISE} AS DOUBLE) / sqrt(greatest(n_words, 1))
  OR word_distance > CAST({quality.WORD_LIMIT} AS DOUBLE) + CAST({quality.WORD_NOISE} AS DOUBLE) / sqrt(greatest(n_words, 1)), false)) AS kept FROM all_""",
    "op4_chat_format": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed AS (SELECT *, CAST(row_number() OVER w - 1 AS INT) AS pos, coalesce(lag(role) OVER w, '') AS before,
  replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
judged AS (SELECT *, CASE WHEN before || '>' || role NOT IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') THEN pos END AS wrong FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ') + length(escaped) + length(' </turn>') + 1) AS BIGINT) AS formatted_chars,
  min(wrong) IS NULL AS valid, coalesce(min(wrong), -1) AS rejected_at
FROM judged GROUP BY conv_id""",
    "op6_license_diagonals": rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
template AS (SELECT t, label, regexp_extract_all(translate(x, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (VALUES {_TEMPLATES}) v(t, label, x)),
placed AS (SELECT t, label, len(w) AS size, pos AS tpos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM (SELECT *, unnest(range(0, len(w) - 2)) AS pos FROM template)),
grams AS (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM (SELECT *, unnest(range(0, len(w) - 2)) AS pos FROM doc)),
diagonals AS (SELECT doc_id, t, label, size, pos - tpos AS diagonal, list(tpos) AS covers, min(pos) AS lo, max(pos) AS hi FROM grams JOIN placed USING (gram) GROUP BY ALL),
apart AS (SELECT *, CAST(coalesce(diagonal - lag(diagonal) OVER o > least({license.DIAGONALS}, size // 2), true) AS INT) AS fresh FROM diagonals WINDOW o AS (PARTITION BY doc_id, t ORDER BY diagonal)),
banded AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS band FROM apart),
far AS (SELECT *, CAST(coalesce(lo - max(hi) OVER (PARTITION BY doc_id, t, band ORDER BY lo, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {license.GAP}, true) AS INT) AS cut FROM banded),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, t, band ORDER BY lo, diagonal) AS span FROM far),
spans AS (SELECT doc_id, t, label, size, min(lo) AS lo, band, span, least(1::DOUBLE, CAST(len(list_distinct(flatten(list(covers)))) AS DOUBLE) / greatest(size - 2, 1)) AS covered, max(hi) - min(lo) + 3 <= ceil(size * CAST({license.STRETCH} AS DOUBLE)) AS tight FROM numbered GROUP BY doc_id, t, label, size, band, span),
verified AS (SELECT doc_id, label, covered FROM spans WHERE tight AND covered >= CAST({license.COVERED} AS DOUBLE)
  QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN label LIKE '{license.RIVALS}%' THEN '{license.RIVALS}' ELSE CAST(t AS VARCHAR) END, lo ORDER BY covered DESC, size DESC, t) = 1),
base AS (SELECT doc_id, p.label AS label, pos FROM (SELECT *, unnest(range(0, len(w))) AS pos FROM doc), (VALUES {_PHRASES}) p(phrase, label) WHERE list_slice(w, pos + 1, pos + len(string_split(phrase, ' '))) = string_split(phrase, ' '))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, (SELECT count(*) FROM base b WHERE b.doc_id = doc.doc_id) AS n_base,
  (SELECT min(pos) FROM base b WHERE b.doc_id = doc.doc_id) AS first_word, (SELECT max(pos) FROM base b WHERE b.doc_id = doc.doc_id) AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base b WHERE b.doc_id = doc.doc_id), '') AS base_labels,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM verified) l WHERE l.doc_id = doc.doc_id), '') AS labels,
  coalesce((SELECT max(covered) FROM verified v WHERE v.doc_id = doc.doc_id), 0) AS score, (SELECT count(*) FROM verified v WHERE v.doc_id = doc.doc_id) AS n_spans
FROM doc""",
    "op10_ngram_jaccard": rf"""
WITH RECURSIVE cut AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM cut WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM cut WHERE len(w) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * both_ >= 90 * (p.n + q.n - both_)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.other)
SELECT r.doc_id AS doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, min(r.other) AS component_id FROM reach r LEFT JOIN sizes ON sizes.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op12_filter_audit": rf"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT x, min(doc_id) AS first FROM doc GROUP BY x),
flags AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, good, toxic, CASE WHEN len(w) < {audit.MIN_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < {audit.DISTINCT_PERCENT} * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > {audit.CAPITAL_PERCENT} * length(x) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM doc JOIN firsts USING (x) LEFT JOIN flags USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks GROUP BY part, mask),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31),
steps AS (SELECT filter_order, step, filter_order[step] AS letter, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS earlier FROM orders, range(1, 6) r(step)),
counted AS (SELECT part, filter_order, letter, CAST(step AS INTEGER) AS step, sum(n) FILTER (mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0) AS toxic_lost FROM cells CROSS JOIN steps GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in audit.COUNTED)}, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted""",
}
