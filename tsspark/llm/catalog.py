"""Registered queries of the text operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tsspark.llm import bpe, decontam, langid, licenses, lm, neardup, pii, quality, resample, secrets, toxicity, trie, urls
from tsspark.session import scratch_path
from tsspark.sources.panels import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.fit(urls.seed_table(spark)), urls.RULES)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.Banding(width=2))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.judged(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.judged(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(documents, scratch_path(spark, "secret-ledger")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.judged(documents, langid.fit(documents))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.branched_paths(table(spark, sf_dir, "conversations"))).drop("turn_id")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_near_duplicates, op3_lm_score, op4_decontaminate, op5_license_scan, op6_personal_data, op7_secret_scan, op8_toxicity, op9_byte_bpe, op10_quality_rules, op11_language, op12_prefix_trie, op13_resample)
}

#: Words of every document, A-Z lowered, as DuckDB writes them.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: The table of CRC-32, and the checksum of a string's UTF-8 bytes by it.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)) AS t)"""


def _crc32(word: str) -> str:
    digit = "(instr('0123456789ABCDEF', hex({0})[{1}]) - 1)"
    code = f"({digit.format(word, 'i')} * 16 + {digit.format(word, 'i + 1')})::UBIGINT"
    steps = f"list_transform(range(1, length(hex({word})) + 1, 2), lambda i: {code})"
    return f"xor(list_reduce({steps}, lambda c, b: xor(t[(xor(c, b) % 256 + 1)::BIGINT], c // 256), 4294967295::UBIGINT), 4294967295::UBIGINT)"


ORACLES: dict[str, str] = {
    "op12_prefix_trie": f"""
WITH {_CRC_TABLE},
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cuts AS (SELECT conv_id, l, ({_crc32("conv_id::VARCHAR")} % 6)::BIGINT AS h FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l
  FROM cuts c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
keyed AS (SELECT conv_id, l, list_transform(l, lambda x: md5(length(x.r)::VARCHAR || ':' || x.r || x.t)) AS k FROM rebuilt),
steps AS (SELECT conv_id, l, k, unnest(range(0, len(k) + 1)) AS depth FROM keyed),
prefixes AS (
  SELECT conv_id, depth, len(k) = depth AS ends, CASE WHEN depth = 0 THEN '' ELSE array_to_string(k[1:depth], '') END AS path,
    CASE WHEN depth = 0 THEN 0 ELSE length(l[depth].t) END AS chars
  FROM steps),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY path, depth),
counted AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 32 * (n.depth - 1)::INTEGER)
  LEFT JOIN (SELECT left(path, 32 * (depth - 1)::INTEGER) AS up, depth - 1 AS d, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2) c
    ON c.up = n.path AND c.d = n.depth),
upward AS (
  SELECT left(path, 32 * up::INTEGER) AS path, n_children = 0 AS leaf, (n_convs - 1) * chars AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted)),
sums AS (SELECT path, count_if(leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM upward GROUP BY path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, ends_sha256
FROM counted JOIN sums USING (path)""",
    "op13_resample": rf"""
WITH {_CRC_TABLE},
texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
words AS (
  SELECT side, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
single AS (SELECT side, doc_id, unnest(w) AS word FROM words),
coded AS (SELECT word, ({_crc32("word")} % 10000)::BIGINT AS bucket FROM (SELECT DISTINCT word FROM single), crc),
features AS (SELECT side, doc_id, bucket FROM single JOIN coded USING (word)),
totals AS (SELECT count_if(side = 'd')::DOUBLE AS s_all, count_if(side = 'b')::DOUBLE AS t_all FROM features),
counts AS (SELECT bucket, count_if(side = 'd')::DOUBLE AS s, count_if(side = 'b')::DOUBLE AS t FROM features GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000)) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM features JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
noise AS (
  SELECT d.doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight, ('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT AS h
  FROM words d LEFT JOIN weights USING (doc_id) WHERE d.side = 'd'),
scores AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM noise),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scores LEFT JOIN places USING (doc_id)""",
    "op2_near_duplicates": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
meets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM meets JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN sym e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN least l USING (doc_id)""",
    "op10_quality_rules": r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM base),
tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM tri),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE k > 1) GROUP BY doc_id),
counts AS (
  SELECT l.doc_id, len(w) AS n_words, length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(regexp_replace(t, '[^!]', '', 'g')) AS shouts, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals
  FROM lines l LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines
    OR 10 * shouts > 3 * n_words OR 100 * capitals > 35 * word_chars OR word_chars > 20 * n_words) AS kept
FROM counts""",
}
