"""Queries over open records, manifests, mergeable states, packed labels, resumed stages and full reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadprep.functions.classes import UNIFIED
from roadprep.jobs import marts
from roadprep.jobs.labels import TEXT, _text, yolo
from roadprep.jobs.registry import query, with_parts
from roadprep.operators import manifests as M
from roadprep.operators import states
from roadprep.operators import stats as S
from roadprep.sources import open_labels, packed, stages
from roadprep.sources.fixtures import view

#: Source records of the images as JSON text: some have attributes that others lack, of several types, some are broken.
_RECORD = """concat('{"name":"', file_name, '","attributes":{"weather":"', weather, '","timeofday":"', timeofday, '"',
 CASE WHEN image_id % 7 = 0 THEN concat(',"lens":', CAST(image_id % 3 AS VARCHAR(4))) ELSE '' END, CASE WHEN image_id % 11 = 0 THEN ',"flags":{"wiper":true}' ELSE '' END,
 CASE WHEN image_id % 13 = 0 THEN ',"parked":false' ELSE '' END, CASE WHEN image_id % 17 = 0 THEN ',"note":null' ELSE '' END, '},"labels":[{"category":"car","box2d":{"x1":1,"y1":2}},{"category":"',
 CASE WHEN image_id % 5 = 0 THEN 'lane' ELSE 'sign' END, '"', CASE WHEN image_id % 5 = 0 THEN ',"poly2d":[[0,1],[2,3]]' ELSE '' END, CASE WHEN image_id % 19 = 0 THEN ',"box3d":{"h":1}' ELSE '' END, '}]', CASE WHEN image_id % 23 = 0 THEN '' ELSE '}' END)"""
RECORDS = with_parts("fx_images") + f", rec AS (SELECT image_id, CAST({_RECORD} AS JSON) AS j FROM fx_images WHERE image_id % 23 <> 0)\n"


def records(spark, d):
    return open_labels.parsed(view(spark, d, "fx_images").select("image_id", F.expr(_RECORD.replace("VARCHAR(4)", "STRING")).alias("json")))


@query(RECORDS + """, a AS (SELECT unnest(json_keys(j->'attributes')) AS key, j->'attributes' AS o FROM rec),
k AS (SELECT key, CASE json_type(o, '$.' || key) WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, o->>key AS value FROM a)
SELECT key, kind, value, CAST(count(*) AS BIGINT) AS n, CAST(sum(count(*)) OVER (PARTITION BY key) AS BIGINT) AS records_with FROM k GROUP BY key, kind, value""")
def attribute_profile(spark, d):
    """Every attribute key that records have, named nowhere here, with its values' types and counts."""
    return open_labels.attribute_profile(records(spark, d))


@query(RECORDS + """, l AS (SELECT unnest(CAST(j->'labels' AS JSON[])) AS l FROM rec),
g AS (SELECT l->>'category' AS category, list_filter(json_keys(l), lambda k: json_type(l, '$.' || k) IN ('OBJECT', 'ARRAY')) AS names FROM l)
SELECT category, geometry, CAST(count(*) AS BIGINT) AS n FROM (SELECT category, unnest(CASE WHEN len(names) > 0 THEN names ELSE ['none'] END) AS geometry FROM g) GROUP BY ALL""")
def geometry_kinds(spark, d):
    """Geometries of labels by category: whatever objects and lists a label has."""
    return open_labels.geometries(records(spark, d)).groupBy("category", "geometry").agg(F.count("*").alias("n"))


_ENTRIES = with_parts("fx_images") + """, one AS (SELECT file_name, weather FROM fx_images WHERE image_id % 101 <> 5 UNION ALL SELECT file_name, weather FROM fx_images WHERE image_id % 211 = 3),
two AS (SELECT file_name, CASE WHEN image_id % 97 = 1 THEN 'other' ELSE weather END AS weather FROM fx_images WHERE image_id % 103 <> 7)
"""
_ENTRY_HASH = "sha256(length(file_name) || ':' || file_name || length(weather) || ':' || weather)"


def _manifests(spark, d):
    """Two manifests of the images with their conditions: some entries are missing in either, some repeated, some changed."""
    rows = view(spark, d, "fx_images")
    one = rows.filter("image_id % 101 <> 5").select("file_name", "weather").union(rows.filter("image_id % 211 = 3").select("file_name", "weather"))
    return one, rows.filter("image_id % 103 <> 7").select("file_name", F.when(F.col("image_id") % 97 == 1, "other").otherwise(F.col("weather")).alias("weather"))


def _level(k: int) -> str:
    """SQL of a tree's level k, over that below it."""
    return f"t{k} AS (SELECT substr(prefix, 1, {k}) AS prefix, sum(n) AS n, sha256(string_agg(prefix || '=' || digest, '|' ORDER BY prefix)) AS digest FROM t{k + 1} GROUP BY 1)"


_TREE = _ENTRIES + f""", h AS (SELECT substr(sha256(file_name), 1, 3) AS prefix, {_ENTRY_HASH} AS h FROM one),
q AS (SELECT prefix, count(*) AS n, {", ".join(f"CAST(sum(CAST(('0x' || substr(h, {16 * k + 1}, 15)) AS BIGINT)) AS HUGEINT) AS q{k}" for k in range(4))} FROM h GROUP BY prefix),
t3 AS (SELECT prefix, n, sha256(n || '|' || q0 || '|' || q1 || '|' || q2 || '|' || q3) AS digest FROM q), {_level(2)}, {_level(1)}, {_level(0)}
"""


@query(_TREE + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS level, prefix, CAST(n AS BIGINT) AS n, digest FROM t{k}" for k in range(4)))
def manifest_tree(spark, d):
    """The Merkle tree of a manifest: its root is the fingerprint."""
    return M.tree(_manifests(spark, d)[0], "file_name", ["weather"])


@query(_ENTRIES + """, g AS (SELECT file_name, list_sort(list(weather)) AS w FROM one GROUP BY 1), k AS (SELECT file_name, list_sort(list(weather)) AS w FROM two GROUP BY 1)
SELECT coalesce(g.file_name, k.file_name) AS path, substr(sha256(coalesce(g.file_name, k.file_name)), 1, 3) AS "range", CASE WHEN g.file_name IS NULL THEN 'added' WHEN k.file_name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM g FULL JOIN k ON g.file_name = k.file_name WHERE g.w IS DISTINCT FROM k.w""")
def manifest_diff(spark, d):
    """Entries that two manifests don't share, found by comparing their trees from the root down."""
    one, two = _manifests(spark, d)
    return M.difference(one, two, "file_name", ["weather"])


@query(marts.REPORTS + "SELECT base, weather, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 0 THEN coalesce(stddev_samp(value), 0.0) END, 6) AS std, CAST(count(value) AS BIGINT) AS n FROM (SELECT *, regexp_replace(run, '_(official|fold[0-9]+)$', '') AS base FROM fx_reports) GROUP BY ALL")
def merged_folds(spark, d):
    """Means and deviations over all folds' values, from a state of each fold: a new fold adds a row and reads no other."""
    rows = view(spark, d, "fx_reports").withColumns(S.run_parts(F.col("run")))
    each = states.moments(rows, ["base", "weather", "fold"], "value")
    out = states.summary_of(states.merged_moments(each, ["base", "weather"]), ["base", "weather"])
    return out.select("base", "weather", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(with_parts("yolo", "fx_images") + f"""SELECT weather, CAST(count(DISTINCT image_id) AS BIGINT) AS images, {", ".join(f"CAST(count(*) FILTER (class_id = {k}) AS BIGINT) AS n_{n}" for k, n in enumerate(UNIFIED))} FROM yolo JOIN fx_images USING (image_id) GROUP BY weather""")
def merged_class_counts(spark, d):
    """Class counts of each condition, added up from count vectors of its splits."""
    labels = yolo(spark, d).join(view(spark, d, "fx_images").select("image_id", "weather", "split"), "image_id")
    out = states.merged_vectors(states.class_vectors(labels, ["weather", "split"]), ["weather"])
    return out.select("weather", "images", *(F.col("counts")[k].alias(f"n_{n}") for k, n in enumerate(UNIFIED)))


@query(TEXT + """, tx AS (SELECT i.file_name AS name, coalesce(t, '') AS text FROM fx_images i LEFT JOIN (
 SELECT image_id, string_agg(class_id || ' ' || cx || ' ' || cy || ' ' || bw || ' ' || bh || chr(10), '' ORDER BY ann_idx) AS t FROM lb GROUP BY image_id) USING (image_id)),
sh AS (SELECT name, octet_length(encode(text)) AS length, CAST(('0x' || substr(sha256(name), 1, 8)) AS BIGINT) % 7 AS shard FROM tx)
SELECT name, CAST(shard AS INTEGER) AS shard, CAST(coalesce(sum(length + 1) OVER (PARTITION BY shard ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length FROM sh""")
def label_shards(spark, d):
    """Where each image's label file lies in seven archives."""
    images = view(spark, d, "fx_images")
    files = _text(spark, d, images).join(images.select("image_id", F.col("file_name").alias("name")), "image_id").select("name", "text")
    return packed.layout(files, 7).select("name", "shard", "offset", "length")


@query(with_parts("fx_images") + """, r AS (SELECT file_name, CAST(('0x' || substr(sha256(file_name), 1, 8)) AS BIGINT) % 16 AS r FROM fx_images)
SELECT CAST(r AS INTEGER) AS "range", CAST(count(*) AS BIGINT) AS images, min(file_name) AS first FROM r WHERE r NOT IN (0, 3, 4, 11) GROUP BY r""")
def stage_backlog(spark, d):
    """Ranges of a stage that are still to be rendered when four of sixteen are committed."""
    done = spark.createDataFrame([(0,), (3,), (4,), (11,)], "range int")
    rows = stages.pending(view(spark, d, "fx_images").select(F.col("file_name").alias("name")), done)
    return rows.groupBy("range").agg(F.count("*").alias("images"), F.min("name").alias("first"))


@query(marts._GATE + """SELECT condition, monotonic AND pos IS NOT NULL AS passed,
 CASE WHEN NOT (monotonic AND pos IS NOT NULL) AND monotonic AND target > base THEN 'target sharper than base' WHEN NOT monotonic THEN 'curve not monotonic' WHEN pos IS NULL THEN 'target outside the curve' WHEN pos < 0.1 THEN 'lower bound reached' WHEN pos > 0.6 THEN 'upper bound reached' ELSE 'ok' END AS reason,
 monotonic, pos IS NOT NULL AS in_range, monotonic AND pos IS NOT NULL AND (pos < 0.1 OR pos > 0.6) AS clipped, round(base, 9) AS base_primary, round(target, 9) AS target_primary FROM vi""")
def gate_report(spark, d):
    """Why each condition's fit passed or not, with the metrics that decided it."""
    rows = S.gate_report(marts._fits(spark, d))
    return rows.select("condition", "passed", "reason", "monotonic", "in_range", "clipped", *(F.round(c, 9).alias(c) for c in ("base_primary", "target_primary")))


@query(marts.CURVE + """, ms AS (SELECT condition, base AS b, target AS t, min_by(m, abs(strength - 0.3)) AS m FROM fc JOIN t USING (condition) GROUP BY ALL)
SELECT condition, round(b / 2.5, 9) AS base_ratio, round(t / 2.5, 9) AS target_ratio, round(m / 2.5, 9) AS measured_ratio, round(abs(m - t), 9) AS abs_err FROM ms""")
def calibration_ratios(spark, d):
    """Base, target and measured metric of each condition against those of a reference sample."""
    at = marts.curve(spark, d).groupBy("condition").agg(F.min_by("m", F.abs(F.col("strength") - 0.3)).alias("measured_primary"))
    rows = marts.targets(spark, d).select("condition", F.col("base").alias("base_primary"), F.col("target").alias("target_primary")).join(at, "condition")
    return S.closed_loop_ratios(rows, 2.5).select("condition", *(F.round(c, 9).alias(c) for c in ("base_ratio", "target_ratio", "measured_ratio", "abs_err")))


_METRICS = {"mAP50": 1.0, "mAP50-95": 0.6, "precision": 1.3, "recall": 0.9}


@query(marts.CELLS.split("pct AS")[0].rstrip().rstrip(",") + ", " + """f AS (SELECT base AS experiment, '5-fold' AS eval, weather, class, """ + ", ".join(f'avg(value * {k}) AS "{n}", CASE WHEN count(value) > 0 THEN coalesce(stddev_samp(value * {k}), 0.0) END AS "{n}_std", count(value) AS "{n}_n"' for n, k in _METRICS.items()) + """ FROM cp WHERE fold GROUP BY ALL
 UNION ALL SELECT base, CASE WHEN official THEN 'official' ELSE 'single' END, weather, class, """ + ", ".join(f"value * {k}, NULL, NULL" for k in _METRICS.values()) + """ FROM cp WHERE NOT fold)
SELECT experiment, eval, weather, class, """ + ", ".join(f'round("{n}", 4) AS "{n}", round("{n}_std", 4) AS "{n}_std", CAST("{n}_n" AS BIGINT) AS "{n}_n"' for n in _METRICS) + " FROM f")
def metrics_table(spark, d):
    """All four metrics side by side for each experiment, kind of evaluation, condition and class."""
    cells = marts.cells(spark, d).select("run", "weather", "class", *((F.col("value") * k).alias(n) for n, k in _METRICS.items()))
    return S.per_class_table(cells, list(_METRICS), UNIFIED).drop("position")
