"""Queries over detections and ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadprep.functions.classes import UNIFIED, unified_name
from roadprep.jobs.registry import query, with_parts
from roadprep.operators import metrics as M
from roadprep.operators import stats
from roadprep.operators.kernels import BLUR
from roadprep.operators.labels import unify
from roadprep.sources.fixtures import view

_CASE = "CASE category_id WHEN 24 THEN 0 WHEN 25 THEN 1 WHEN 26 THEN 2 WHEN 27 THEN 3 WHEN 28 THEN 4 WHEN 32 THEN 5 WHEN 33 THEN 5 END"
TRUTH = with_parts("uni", "fx_detections", "fx_images", "classes") + f""", tr AS (SELECT image_id, ann_idx, class_id, x, y, w, h FROM uni WHERE class_id IS NOT NULL AND w > 0),
de AS (SELECT *, {_CASE} AS class_id FROM fx_detections WHERE {_CASE} IS NOT NULL),
pr AS (SELECT * FROM (SELECT tr.image_id, tr.class_id, ann_idx, det_idx, conf, tr.w AS tw, tr.h AS th, de.w AS dw, de.h AS dh,
 greatest(0.0, least(tr.x + tr.w, de.x + de.w) - greatest(tr.x, de.x)) * greatest(0.0, least(tr.y + tr.h, de.y + de.h) - greatest(tr.y, de.y)) AS inter
 FROM tr JOIN de ON tr.image_id = de.image_id AND tr.class_id = de.class_id)),
pairs AS (SELECT image_id, class_id, ann_idx, det_idx, conf, inter / (tw * th + dw * dh - inter) AS iou FROM pr WHERE inter / (tw * th + dw * dh - inter) >= 0.5),
pt AS (SELECT * FROM pairs JOIN (SELECT unnest(range(50, 100, 5)) AS thr) ON iou >= thr / 100.0),
b1 AS (SELECT * FROM pt QUALIFY row_number() OVER (PARTITION BY image_id, class_id, thr, det_idx ORDER BY iou DESC, ann_idx) = 1),
tp AS (SELECT thr, image_id, class_id, det_idx FROM b1 QUALIFY row_number() OVER (PARTITION BY image_id, class_id, thr, ann_idx ORDER BY conf DESC, det_idx) = 1),
scoped AS (SELECT de.*, s.scope FROM de JOIN fx_images i USING (image_id), LATERAL (SELECT unnest(['overall', i.weather]) AS scope) s),
nt AS (SELECT scope, class_id, count(*) AS n_truth FROM tr JOIN fx_images i USING (image_id), LATERAL (SELECT unnest(['overall', i.weather]) AS scope) s GROUP BY ALL),
cu AS (SELECT t.thr, scope, class_id, n_truth, conf, image_id, det_idx,
 sum(CASE WHEN tp.det_idx IS NULL THEN 0 ELSE 1 END) OVER o AS ctp, count(*) OVER o AS n
 FROM scoped CROSS JOIN (SELECT unnest(range(50, 100, 5)) AS thr) t LEFT JOIN tp USING (thr, image_id, class_id, det_idx) JOIN nt USING (scope, class_id)
 WINDOW o AS (PARTITION BY t.thr, scope, class_id ORDER BY conf DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT thr, scope, class_id, CAST(floor(100 * ctp / n_truth) AS INTEGER) AS level, max(ctp / n) AS p FROM cu GROUP BY ALL),
gr AS (SELECT thr, scope, class_id, n_truth, coalesce(max(p) OVER (PARTITION BY thr, scope, class_id ORDER BY level DESC ROWS UNBOUNDED PRECEDING), 0.0) AS p
 FROM nt CROSS JOIN (SELECT unnest(range(50, 100, 5)) AS thr) CROSS JOIN (SELECT unnest(range(101)) AS level) LEFT JOIN lv USING (thr, scope, class_id, level)),
ap AS (SELECT thr, scope, class_id, n_truth, sum(p) / 101 AS ap FROM gr GROUP BY ALL)
"""


def truth(spark, d):
    return unify(view(spark, d, "fx_annotations")).filter("w > 0").select("image_id", "ann_idx", "class_id", "x", "y", "w", "h")


def detections(spark, d):
    return unify(view(spark, d, "fx_detections")).select("image_id", "det_idx", "class_id", "x", "y", "w", "h", "conf")


def scoped(rows, spark, d):
    """Each row once for all conditions together and once for its own: curves are ranked anew in each scope."""
    images = view(spark, d, "fx_images").select("image_id", "weather")
    return rows.join(images, "image_id").withColumn("scope", F.explode(F.array(F.lit("overall"), "weather"))).drop("weather")


def precisions(spark, d, thresholds=M.THRESHOLDS):
    t, p = truth(spark, d), detections(spark, d)
    ts, groups = scoped(t, spark, d), ["scope", "class_id"]
    # masks come first: a detection is matched once, not once for each scope
    return M.precision_areas(scoped(M.masked(t, p, thresholds), spark, d), ts, groups, thresholds, M.along_confidence(p))


@query(TRUTH + "SELECT image_id, class_id, ann_idx, det_idx, round(iou, 9) AS iou FROM pairs")
def iou_match(spark, d):
    return M.candidates(truth(spark, d), detections(spark, d)).select("image_id", "class_id", "ann_idx", "det_idx", F.round("iou", 9).alias("iou"))


@query(TRUTH + """SELECT scope, class_name, CAST(n_truth AS BIGINT) AS n_truth, round(max(ap) FILTER (thr = 50), 6) AS ap50, round(avg(ap), 6) AS ap50_95
FROM ap JOIN classes USING (class_id) GROUP BY ALL""")
def ap_per_class(spark, d):
    ap = precisions(spark, d)
    out = ap.groupBy("scope", "class_id", "n_truth").agg(F.max(F.when(F.col("thr") == 50, F.col("ap"))).alias("a"), F.avg("ap").alias("b"))
    return out.select("scope", unified_name(F.col("class_id")).alias("class_name"), "n_truth", F.round("a", 6).alias("ap50"), F.round("b", 6).alias("ap50_95"))


@query(TRUTH + "SELECT scope, CAST(count(DISTINCT class_id) AS BIGINT) AS classes, round(avg(ap) FILTER (thr = 50), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM ap GROUP BY scope")
def map_report(spark, d):
    """Macro means over the classes present in the ground truth, overall and by condition."""
    out = precisions(spark, d).groupBy("scope").agg(F.count_distinct("class_id").alias("classes"), F.avg(F.when(F.col("thr") == 50, F.col("ap"))).alias("a"), F.avg("ap").alias("b"))
    return out.select("scope", "classes", F.round("a", 6).alias("map50"), F.round("b", 6).alias("map50_95"))


@query(TRUTH + """SELECT scope, round(sum(ap * n_truth) FILTER (thr = 50) / sum(n_truth) FILTER (thr = 50), 6) AS micro_map50,
 round(avg(ap) FILTER (thr = 50 AND class_id IN (1, 4, 5)), 6) AS rare_map50 FROM ap GROUP BY scope""")
def micro_map(spark, d):
    """Means weighted by instances, and over the rare classes alone."""
    at = precisions(spark, d, [50])
    rare = F.when(F.col("class_id").isin([UNIFIED.index(n) for n in ("rider", "bus", "bicycle")]), F.col("ap"))
    return at.groupBy("scope").agg(F.round(F.sum(F.col("ap") * F.col("n_truth")) / F.sum("n_truth"), 6).alias("micro_map50"), F.round(F.avg(rare), 6).alias("rare_map50"))


@query(TRUTH + """SELECT thr, class_id, CAST(count(*) AS BIGINT) AS detections, CAST(max(ctp) AS BIGINT) AS tp, CAST(max(n - ctp) AS BIGINT) AS fp, CAST(sum(ctp) AS BIGINT) AS area FROM cu WHERE scope = 'overall' GROUP BY ALL""")
def pr_curve(spark, d):
    """The curve's end points and the sum of its running true positives, by threshold and class."""
    t, p = truth(spark, d), detections(spark, d)
    return M.curve_ends(M.masked(t, p), t, ["class_id"], pieces=M.along_confidence(p)).select("thr", "class_id", "detections", "tp", "fp", "area")


SENSITIVITY = TRUTH.replace("LATERAL (SELECT unnest(['overall', i.weather]) AS scope) s)", "LATERAL (SELECT i.weather || '@' || unnest([0, 1, 2, 3, 4]) AS scope) s WHERE i.weather <> 'night' AND (de.image_id * 31 + de.det_idx) % 10 >= 2 * CAST(split_part(s.scope, '@', 2) AS INTEGER))", 1).replace("LATERAL (SELECT unnest(['overall', i.weather]) AS scope) s GROUP BY ALL)", "LATERAL (SELECT i.weather || '@' || unnest([0, 1, 2, 3, 4]) AS scope) s WHERE i.weather <> 'night' GROUP BY ALL)", 1)


@query(SENSITIVITY + """SELECT split_part(scope, '@', 1) AS condition, round(CAST(split_part(scope, '@', 2) AS DOUBLE) / 2, 1) AS multiplier, CAST(sum(n_truth) FILTER (thr = 50) AS BIGINT) AS boxes,
 round(CAST(split_part(scope, '@', 2) AS DOUBLE) / 2 * CASE split_part(scope, '@', 1) WHEN 'fog' THEN 0.0065 WHEN 'rain' THEN 0.01575 ELSE 0.00415 END, 9) AS frac,
 round(avg(ap) FILTER (thr = 50), 6) AS map50, round(avg(ap), 6) AS map50_95 FROM ap GROUP BY scope""")
def sensitivity_curve(spark, d):
    """Scores by condition and multiple of its blur, from supplied detections: fewer of them stand for a stronger blur."""
    levels = stats.effective(spark.createDataFrame([], "condition string, value double, source string"), spark.createDataFrame([(c, *v) for c, v in BLUR.items()], "condition string, kind string, low double, high double"))
    levels = levels.filter("kind <> 'none'").select("condition", F.col("frac").alias("f"), F.posexplode(F.array(*map(F.lit, [0.0, 0.5, 1.0, 1.5, 2.0]))).alias("level", "multiplier"))
    images = view(spark, d, "fx_images").select("image_id", F.col("weather").alias("condition"))
    at = images.join(F.broadcast(levels.withColumn("frac", F.round(F.col("f") * F.col("multiplier"), 9)).drop("f")), "condition")
    t, p, groups = truth(spark, d), detections(spark, d), ["condition", "multiplier", "frac", "class_id"]
    # detections are matched once, before a scenario leaves some of them out
    ts, ps = (x.join(at, "image_id") for x in (t, M.masked(t, p)))
    ap = M.precision_areas(ps.filter((F.col("image_id") * 31 + F.col("det_idx")) % 10 >= 2 * F.col("level")), ts, groups, pieces=M.along_confidence(p))
    out = ap.groupBy("condition", "multiplier", "frac").agg(F.sum(F.when(F.col("thr") == 50, F.col("n_truth"))).alias("boxes"), F.avg(F.when(F.col("thr") == 50, F.col("ap"))).alias("a"), F.avg("ap").alias("b"))
    return out.select("condition", "multiplier", "frac", "boxes", F.round("a", 6).alias("map50"), F.round("b", 6).alias("map50_95"))


@query(TRUTH + """, hit AS (SELECT image_id, class_id, det_idx, 1 AS hit FROM tp WHERE thr = 50),
cc AS (SELECT class_id, CAST(floor(conf * 1000) AS INTEGER) AS cut, count(hit) AS tp, count(*) AS n FROM de LEFT JOIN hit USING (image_id, class_id, det_idx) GROUP BY ALL),
gg AS (SELECT class_id, n_truth, g.cut, coalesce(sum(tp) OVER o, 0) AS tp, coalesce(sum(n) OVER o, 0) AS n FROM (SELECT class_id, n_truth FROM nt WHERE scope = 'overall') CROSS JOIN (SELECT unnest(range(1000)) AS cut) g
 LEFT JOIN cc USING (class_id, cut) WINDOW o AS (PARTITION BY class_id ORDER BY g.cut DESC ROWS UNBOUNDED PRECEDING)),
ff AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE tp / n END AS p, tp / n_truth AS r FROM gg),
f1 AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM ff),
bb AS (SELECT cut FROM f1 GROUP BY cut ORDER BY round(avg(f), 9) DESC, cut LIMIT 1)
SELECT class_id, cut, round(p, 9) AS "precision", round(r, 9) AS recall, round(f, 9) AS f1 FROM f1 JOIN bb USING (cut)""")
def precision_recall(spark, d):
    return M.operating_point(truth(spark, d), detections(spark, d)).select("class_id", "cut", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))
