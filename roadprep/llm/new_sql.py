"""SQL of resampling, spelling variants and shards. DuckDB has no CRC-32: it is folded over the bits of the text's bytes."""

from __future__ import annotations

_BYTES = "flatten(list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda b: [CAST('0x' || b AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"


def crc32(x: str) -> str:
    """Each byte is followed by seven zeros: every step takes one of them in and shifts by a bit."""
    return f"xor(4294967295, list_reduce({_BYTES.format(x=x)}, lambda c, b: (xor(c, b) >> 1).xor(3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)))"


def _lower(x: str) -> str:
    return f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(x=_lower("text"))} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest({_WORDS.format(x=_lower("text"))}) AS w FROM benchmark),
k AS (SELECT w, {crc32("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT b, count(*) AS s FROM dw JOIN k USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN k USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM dw) AS ns, (SELECT count(*) FROM bw) AS nt),
g AS (
  SELECT b, CAST(floor(1000 * ln(((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(ns AS DOUBLE) + 10000)) / ((CAST(s AS DOUBLE) + 1) * (CAST(nt AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (b) CROSS JOIN n),
f AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN k USING (w) JOIN g USING (b) GROUP BY r),
h AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (r)),
p AS (SELECT *, n_features >= 20 AS long, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank FROM h)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND rank <= (SELECT 10 * count(*) // 100 FROM h WHERE n_features >= 20) THEN rank END AS rank FROM p
"""

OP12 = f"""
WITH RECURSIVE d AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, unnest(regexp_extract_all({_lower("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT i, w, count(*) AS n FROM d WHERE length(w) >= 5 GROUP BY i, w),
h AS (SELECT w, n, {crc32("i || ':' || w")} AS h FROM c),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, p, w[: p - 1] || w[p + 1 :] AS cut FROM (SELECT word, word AS w, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.cut = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.cut = v.word),
best AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'w': encode(other)}}) AS b FROM near GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * v.n THEN decode(b.w) END AS form, CASE WHEN -b.n >= 2 * v.n THEN -b.n END AS form_n
  FROM v LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON up.form = f.word)
SELECT f.word, f.form, up.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN up ON up.word = f.word AND up.form IS NULL
"""


def _position(x: str) -> str:
    return f"CAST(('0x' || md5({x})[1:8]) AS BIGINT)"


def _round(k: int, shards: int) -> str:
    """One walk on the ring: the state after it, of the slices that were left before."""
    return f"""
o{k} AS MATERIALIZED (SELECT shard FROM range({shards}) t(shard) WHERE shard NOT IN (SELECT shard FROM c{k})),
w{k} AS MATERIALIZED (
  SELECT slice, bytes, rows, (SELECT arg_min(shard, pos) FROM ring WHERE pos >= l.slice * 262144 AND shard IN (SELECT shard FROM o{k})) AS shard FROM l{k} l),
s{k} AS MATERIALIZED (
  SELECT *, sum(bytes) OVER (PARTITION BY shard) * (SELECT count(*) FROM o{k}) >= (SELECT sum(bytes) FROM l{k}) AS closes,
    (2 * sum(bytes) OVER (PARTITION BY shard ORDER BY length(bin(bytes)) DESC, slice) - bytes) * (SELECT count(*) FROM o{k}) <= 2 * (SELECT sum(bytes) FROM l{k}) AS fits
  FROM w{k}),
c{k + 1} AS MATERIALIZED (SELECT shard FROM c{k} UNION SELECT shard FROM s{k} WHERE closes),
l{k + 1} AS MATERIALIZED (SELECT slice, bytes, rows FROM s{k} WHERE NOT (closes AND fits) AND (SELECT count(*) FROM o{k}) > 1)"""


SHARDS, NODES = 16, 64
OP13 = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32("coalesce(text, '')")} AS text_crc32, md5(coalesce(text, '')) AS key FROM documents),
n AS (SELECT count(*) AS n, sum(size) AS total FROM d),
big AS (SELECT key, greatest((sum(size) * 128 + total - 1) // total, (count(*) * 128 + n - 1) // n) AS pieces FROM d CROSS JOIN n GROUP BY key, n, total),
e AS MATERIALIZED (
  SELECT doc_id, size, text_crc32,
    {_position("CASE WHEN pieces > 1 THEN key || '/' || CAST(" + crc32("coalesce(CAST(doc_id AS VARCHAR), '')") + " % CAST(pieces AS BIGINT) AS VARCHAR) ELSE key END")} // 262144 AS slice
  FROM d JOIN big USING (key)),
one AS (SELECT {_position(f"CAST(id % {SHARDS} AS VARCHAR) || '/' || CAST(id // {SHARDS} AS VARCHAR)")} AS pos, id % {SHARDS} AS shard FROM range({SHARDS * NODES}) t(id)),
ring AS MATERIALIZED (SELECT * FROM one UNION ALL SELECT pos + 4294967296, shard FROM one),
c0 AS (SELECT shard FROM range(0) t(shard)),
l0 AS MATERIALIZED (SELECT slice, sum(size) AS bytes, count(*) AS rows FROM e GROUP BY slice),{",".join(_round(k, SHARDS) for k in range(SHARDS))},
p AS MATERIALIZED ({" UNION ALL ".join(f"SELECT slice, rows, shard FROM s{k} WHERE closes AND fits OR (SELECT count(*) FROM o{k}) = 1" for k in range(SHARDS))}),
q AS (SELECT slice, shard, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(ahead + row_number() OVER (PARTITION BY slice ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM e JOIN q USING (slice)
"""
