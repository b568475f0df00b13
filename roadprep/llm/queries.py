"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadprep.llm import decontaminate, extract, jaccard, language, lm, pieces, quality, resample, secrets, sharding, tokens, urls, variants
from roadprep.llm.new_sql import OP11, OP12, OP13


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), tokenizer())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_report(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), tokenizer())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_report(_table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_pieces, op3_decontaminate, op4_lm_scores, op5_main_text, op6_quality, op7_token_counts, op8_url_filter, op9_language, op10_jaccard_join, op11_resample, op12_variants, op13_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3, "op6_quality": OP6, "op8_url_filter": OP8, "op10_jaccard_join": OP10, "op11_resample": OP11, "op12_variants": OP12, "op13_shards": OP13}


OP3 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
win AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1) GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM d LEFT JOIN rep USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * capitals > 50 * letters OR 100 * letters < 40 * word_chars
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 70 * n_lines) AS kept
FROM g
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS x
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
k AS (SELECT r, n, md5(string_agg(x, chr(10) ORDER BY x)) AS h FROM s JOIN n USING (r) GROUP BY r, n),
g AS (SELECT min(r) AS g, n, h FROM k GROUP BY n, h),
gs AS (SELECT g, x, n, count(*) OVER (PARTITION BY x) AS c FROM s JOIN g ON s.r = g.g),
pairs AS (
  SELECT a.g AS a, b.g AS b FROM (SELECT * FROM gs WHERE c > 1) a JOIN (SELECT * FROM gs WHERE c > 1) b ON a.x = b.x AND a.g < b.g
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT g AS a, g AS b FROM g UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
low AS (SELECT reach.a AS g, min(doc_id) AS component_id FROM reach JOIN g ON g.g = reach.b JOIN k USING (n, h) JOIN d ON d.r = k.r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r) LEFT JOIN g ON g.n = k.n AND g.h = k.h LEFT JOIN low ON low.g = g.g
"""

OP8 = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS fetched,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
h AS (SELECT DISTINCT host, md5(host) AS h FROM p WHERE host IS NOT NULL),
bad AS (SELECT host, CAST(('0x' || h[2:3]) AS INTEGER) AS n FROM h WHERE h[1:1] <= '5'),
iv AS (
  SELECT 'block' AS action, 'domain' AS kind, host AS value, DATE '2024-01-01' + n AS f, DATE '2024-01-01' + n + 40 AS t FROM bad
  UNION ALL SELECT 'block', 'domain', host, DATE '2024-01-01' + n + 90, NULL FROM bad
  UNION ALL SELECT 'allow', 'prefix', host || '/en', DATE '2024-03-01', NULL FROM bad
  UNION ALL SELECT DISTINCT 'block', 'domain', 'example.net', DATE '2024-07-19', CAST(NULL AS DATE) FROM h WHERE host LIKE '%.example.net'),
parts AS (
  SELECT *, string_split(host, '.') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS ss FROM p),
k AS (
  SELECT page_id, url, fetched, 'domain' AS kind, array_to_string(ls[len(ls) - i + 1 :], '.') AS value, i AS weight
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM parts WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, url, fetched, 'prefix', host || '/' || array_to_string(ss[1 : i], '/'), 536870912 + i
  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM parts WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, url, fetched, 'url', url, 1073741824 FROM parts),
m AS (
  SELECT page_id, count(*) AS n, min({'w': -weight, 'b': action <> 'allow', 'name': action || ':' || k.kind || ':' || k.value}) AS best
  FROM k JOIN iv ON k.kind = iv.kind AND k.value = iv.value AND fetched >= f AND (t IS NULL OR fetched < t) GROUP BY page_id)
SELECT page_id, url, CAST(fetched AS VARCHAR) AS fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(NOT best.b, true) AS allowed, best.name AS matched
FROM p LEFT JOIN m USING (page_id)
"""
