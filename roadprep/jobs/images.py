"""Queries over images: the vectors of the given tables stand for pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadprep.functions.classes import CONDITIONS
from roadprep.jobs.labels import yolo
from roadprep.jobs.marts import STATS, pixel_stats
from roadprep.jobs.registry import query, with_parts
from roadprep.operators import images as I
from roadprep.operators import kernels as K
from roadprep.operators import stats as S
from roadprep.sources.fixtures import view


#: Test-time multiples of a condition's blur.
MULTIPLIERS = [0.0, 0.5, 1.0, 1.5, 2.0]


def table(spark, d, side=16):
    """Square images: each vector's 64 gray values over and over, so that rows and channels shift against each other."""
    # the vectors lie in one small file: dealt out before they become images, so that kernels run in every task
    rows = view(spark, d, "pixels").repartition(spark.sparkContext.defaultParallelism, "image_id")
    hexed = F.array_join(F.transform("px", lambda v: F.lpad(F.hex(v), 2, "0")), "")
    condition = F.get(F.array(*map(F.lit, CONDITIONS)), F.col("label") % 4)
    return rows.select("image_id", F.concat(F.lit("img_"), "image_id").alias("name"), condition.alias("condition"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.unhex(F.repeat(hexed, side * side * 3 // 64)).alias("data"))


def _rounded(frame, keys):
    return frame.select(*keys, *(F.round(c, 6).alias(c) for c, k in frame.dtypes if c not in keys and k == "double"))


FIELDS = ["mean_b", "std_b", "mean_g", "std_g", "mean_r", "std_r", "saturation"]


def _summaries(spark, d):
    """33 quantiles and the range of each appearance field by condition: 28 rows, which go to the driver."""
    long = I.appearance_stats(table(spark, d)).unpivot(["condition"], FIELDS, "field", "value")
    out: dict = {}
    for r in S.robust_summary(long, ["condition", "field"], "value", 0.0, 255.0).select("condition", "field", "median", "q").collect():
        out.setdefault(r.condition, {})[r.field] = (list(r.q), 0.0, 255.0, r.median)
    return out


def _targets(spark, d):
    return {c: {f: v[:3] for f, v in fields.items()} for c, fields in _summaries(spark, d).items()}


def _ranges(spark):
    return spark.createDataFrame([(c, *v) for c, v in K.BLUR.items()], "condition string, kind string, low double, high double")


def _fitted(spark, d):
    """condition, value, source: strengths fitted to the images' own sharpness, halved, through grid, curve and gate."""
    # images are blurred once: their numbers are kept while medians read them twice, and 48 medians, which several steps read, go to the driver
    grid = I.strength_grid(table(spark, d, 64), ("normalized_laplacian",)).persist()
    curve = S.medians(grid, ["condition", "strength"], "normalized_laplacian", "m")
    curve = spark.createDataFrame(curve.collect(), curve.schema)
    grid.unpersist()
    base = curve.groupBy("condition").agg(F.min_by("m", "strength").alias("base")).withColumn("target", F.col("base") / 2)
    fits = S.monotonic(curve, "condition", "strength", "m").join(S.invert(curve, base.select("condition", "target"), "condition", "strength", "m"), "condition").join(base, "condition")
    fallback = F.when(F.col("condition") == "fog", 0.004).when(F.col("condition") == "snow", 0.003).otherwise(0.012)
    return S.gate(fits.join(_ranges(spark), "condition").withColumn("fallback", fallback)).select("condition", F.col("strength").alias("value"), "source")


def _fractions(spark, d):
    return {r.condition: r.value for r in _fitted(spark, d).collect()}


@query()
def photometric_plan(spark, d):
    return I.plans(table(spark, d).drop("data"), "s2").select("image_id", "seed", F.map_keys("params").alias("ops"), F.map_values("params").alias("values"))


@query()
def weather_plan(spark, d):
    return I.plans(table(spark, d).drop("data"), "s3").select("image_id", "condition", "seed", F.map_keys("params").alias("names"), F.map_values("params").alias("values"))


@query()
def photometric_apply(spark, d):
    return I.build_stage(table(spark, d), "s2").select("image_id", "attempt", F.sha2("data", 256).alias("pixels"))


@query()
def weather_apply(spark, d):
    return I.build_stage(table(spark, d), "s3").select("image_id", "condition", "attempt", F.sha2("data", 256).alias("pixels"))


@query()
def appearance_match(spark, d):
    """Stage s5: weather, then each channel matched to a draw from the fitted distributions."""
    out = I.build_stage(table(spark, d), "s5", _targets(spark, d))
    return _rounded(I.appearance_stats(out.select("image_id", "name", "condition", "height", "width", "data")), ["image_id", "condition"])


@query()
def sharpness_stats(spark, d):
    return _rounded(I.sharpness_stats(table(spark, d)), ["image_id", "condition"])


@query()
def strength_grid(spark, d):
    """Median sharpness by condition and strength, from one pass that blurs each image at 16 strengths."""
    metrics = ["normalized_laplacian", "laplacian_var", "hf_energy_ratio"]
    long = I.strength_grid(table(spark, d)).unpivot(["condition", "strength"], metrics, "metric", "value")
    out = S.medians(long, ["condition", "strength", "metric"], "value", "m").groupBy("condition", "strength").pivot("metric", metrics).agg(F.first("m"))
    return _rounded(out, ["condition", "strength"])


@query()
def stage_build(spark, d):
    """Stage s5b: weather, blur, appearance; the index without pixels, sorted by name."""
    out = I.build_stage(table(spark, d), "s5b", _targets(spark, d), _fractions(spark, d))
    return out.select("name", "condition", "stage", "seed", "attempt", F.sha2("data", 256).alias("pixels")).orderBy("name")


EFFECTIVE = """, fit AS (SELECT condition, round(avg(mean) / 20000, 9) AS value, 'fit' AS source FROM flat WHERE condition <> 'snow' GROUP BY condition),
rg AS (SELECT * FROM (VALUES ('fog', 'gaussian', 0.001, 0.012), ('snow', 'gaussian', 0.0003, 0.008), ('rain', 'motion', 0.0015, 0.030), ('night', 'none', 0.0, 0.0)) t(condition, kind, low, high)),
ef AS (SELECT condition, kind, low, high, coalesce(value, (low + high) / 2) AS raw, coalesce(source, 'provisional') AS source FROM rg LEFT JOIN fit USING (condition)),
eff AS (SELECT condition, kind, CASE WHEN kind = 'none' THEN 0.0 ELSE greatest(low, least(raw, high)) END AS frac,
 CASE WHEN kind = 'none' THEN 'none' ELSE source || CASE WHEN greatest(low, least(raw, high)) <> raw THEN '+clipped' ELSE '' END END AS source FROM ef)
"""


def effective(spark, d):
    """The strengths in effect by fits from the pixels' means: no fit for snow, those of others inside and outside the range."""
    fits = pixel_stats(spark, d).filter("condition <> 'snow'").groupBy("condition").agg(F.round(F.avg("mean") / 20000, 9).alias("value")).withColumn("source", F.lit("fit"))
    return S.effective(fits, _ranges(spark))


@query(STATS + EFFECTIVE + "SELECT condition, kind, round(frac, 9) AS frac, source FROM eff")
def effective_blur(spark, d):
    """The blur in effect: a fitted value cut to the range, the middle of the range if there is no fit."""
    return effective(spark, d).withColumn("frac", F.round("frac", 9))


@query()
def fitted_blur(spark, d):
    """Strengths fitted by the grid of blurred images, its inverted curves and the gate, as they are in effect."""
    return S.effective(_fitted(spark, d), _ranges(spark)).withColumn("frac", F.round("frac", 6))


@query()
def blur_apply(spark, d):
    out = I.blur_apply(table(spark, d), F.lit(0.05))
    return out.select("image_id", "condition", F.sha2("data", 256).alias("pixels"))


def _labels(spark, d):
    return yolo(spark, d)


GRAY = """, im AS (SELECT image_id, CASE label % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS condition,
 list_transform(range(256), lambda j: px[(3 * j) % 64 + 1]) AS b, list_transform(range(256), lambda j: px[(3 * j + 1) % 64 + 1]) AS g, list_transform(range(256), lambda j: px[(3 * j + 2) % 64 + 1]) AS r FROM pixels),
gr AS (SELECT *, list_transform(range(1, 257), lambda j: (1868 * b[j] + 9617 * g[j] + 4899 * r[j] + 8192) // 16384) AS gray FROM im)
"""


@query(with_parts("pixels") + GRAY + """SELECT image_id, condition, round(list_avg(b), 6) AS mean_b, round(list_avg(g), 6) AS mean_g, round(list_avg(r), 6) AS mean_r,
 round(list_stddev_pop(b), 6) AS std_b, round(list_stddev_pop(g), 6) AS std_g, round(list_stddev_pop(r), 6) AS std_r,
 round(list_avg(list_transform(range(1, 257), lambda j: ((greatest(b[j], g[j], r[j]) - least(b[j], g[j], r[j])) * CAST(round(1044480.0 / greatest(b[j], g[j], r[j], 1)) AS BIGINT) + 2048) // 4096)), 6) AS saturation,
 round(list_avg(gray), 6) AS luma FROM gr""")
def appearance_stats(spark, d):
    return _rounded(I.appearance_stats(table(spark, d)), ["image_id", "condition"])


@query(with_parts("pixels", "yolo") + GRAY + """, bx AS (SELECT image_id, ann_idx, greatest(0, CAST(trunc((cx - bw / 2) * 16) AS INTEGER)) AS x0, greatest(0, CAST(trunc((cy - bh / 2) * 16) AS INTEGER)) AS y0,
 least(16, CAST(trunc((cx + bw / 2) * 16) AS INTEGER)) AS x1, least(16, CAST(trunc((cy + bh / 2) * 16) AS INTEGER)) AS y1 FROM yolo)
SELECT image_id, CAST(ann_idx AS INTEGER) AS ann_idx, round(stddev_pop(v), 6) AS std FROM (SELECT image_id, ann_idx, gray[y * 16 + x + 1] AS v FROM (
 SELECT *, unnest(range(x0, x1)) AS x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM bx JOIN gr USING (image_id) WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 4))) GROUP BY ALL""")
def box_contrast(spark, d):
    """Contrast of each labelled box of the images."""
    return _rounded(I.box_contrast(table(spark, d), _labels(spark, d)), ["image_id", "ann_idx"])


@query()
def visibility_summary(spark, d):
    """Contrast of labelled boxes after s3 over that before, by condition: numbers are joined, not pixels."""
    source = table(spark, d)
    made = I.build_stage(source, "s3").select("image_id", "name", "condition", "height", "width", "data")
    after = I.box_contrast(made, _labels(spark, d)).join(source.select("image_id", "condition"), "image_id")
    return _rounded(I.visibility(I.box_contrast(source, _labels(spark, d)), after), ["condition", "boxes"])


@query()
def sharpness_ratios(spark, d):
    """Median sharpness of the blurred stage over the stage without blur; a partner may be missing."""
    source, q = table(spark, d), _targets(spark, d)
    keep = ["image_id", "name", "condition", "height", "width", "data"]
    plain, blurred = (I.sharpness_stats(I.build_stage(source, s, q).select(*keep), ("normalized_laplacian",)).select("image_id", "condition", F.col("normalized_laplacian").alias(s)) for s in ("s5", "s5b"))
    rows = S.paired(plain, blurred.drop("condition"), ["image_id"], "s5", "s5b")
    pairs = rows.groupBy("condition").agg(F.count("ratio").alias("pairs"))
    return pairs.join(S.medians(rows, ["condition"], "ratio", "m"), "condition").select("condition", "pairs", F.round("m", 6).alias("ratio"), (F.col("m") < 0.995).alias("blurred"))


_AT = "px[CASE WHEN {y} < 0 THEN 1 WHEN {y} > 7 THEN 6 ELSE {y} END * 8 + CASE WHEN {x} < 0 THEN 1 WHEN {x} > 7 THEN 6 ELSE {x} END + 1]"
LAPLACE = """, la AS (SELECT image_id, condition, list_stddev_pop(lap) * list_stddev_pop(lap) / (list_stddev_pop(px) * list_stddev_pop(px) + 1e-6) AS s FROM (
 SELECT image_id, CASE label % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS condition, px, list_transform(range(64), lambda i: """ + " + ".join(_AT.format(y=f"(i // 8 {a})", x=f"(i % 8 {b})") for a, b in (("- 1", ""), ("+ 1", ""), ("", "- 1"), ("", "+ 1"))) + """ - 4 * px[i + 1]) AS lap FROM pixels))
"""


def _laplacian(px):
    """Variance of the 4-neighbour Laplacian of 8 x 8 pixels, mirrored at the borders, over their variance: no Python."""
    inside = lambda v: F.when(v < 0, 1).when(v > 7, 6).otherwise(v)
    at = lambda y, x: F.get(px, (inside(y) * 8 + inside(x)).cast("int"))
    y, x = (lambda i: F.floor(i / 8)), (lambda i: i % 8)
    lap = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: at(y(i) - 1, x(i)) + at(y(i) + 1, x(i)) + at(y(i), x(i) - 1) + at(y(i), x(i) + 1) - 4 * F.get(px, i))

    def var(values):
        total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
        squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        return squares / F.size(values) - (total / F.size(values)) ** 2

    return var(lap) / (var(px) + 1e-6)


@query(with_parts("pixels") + LAPLACE + """SELECT a.image_id, a.condition, round(a.s, 4) AS before, round(b.s, 4) AS after, round(b.s / nullif(a.s, 0), 4) AS ratio
FROM la a LEFT JOIN (SELECT image_id + 1 AS image_id, s FROM la WHERE image_id % 13 <> 0) b USING (image_id)""")
def paired_sharpness(spark, d):
    """Sharpness of each image beside its partner's in another table, which may lack it: here the next image stands for it."""
    rows = view(spark, d, "pixels").select("image_id", F.get(F.array(*map(F.lit, CONDITIONS)), F.col("label") % 4).alias("condition"), _laplacian(F.col("px")).alias("s"))
    other = rows.filter("image_id % 13 <> 0").select((F.col("image_id") + 1).alias("image_id"), F.col("s").alias("after"))
    return S.paired(rows.withColumnRenamed("s", "before"), other, ["image_id"], "before", "after").select("image_id", "condition", *(F.round(c, 4).alias(c) for c in ("before", "after", "ratio")))


@query()
def closed_loop(spark, d):
    """Errors that remain when the fitted values are applied and measured again: appearance matched to the medians, by
    field, and images blurred at the fitted strength, against the sharpness that it was fitted to."""
    source = table(spark, d)
    medians = {c: {f: v[3] for f, v in fields.items()} for c, fields in _summaries(spark, d).items()}
    matched = I.match_errors(source, medians).groupBy("condition", "field").agg(F.avg("error").alias("error"))
    large = table(spark, d, 64)
    primary = ("normalized_laplacian",)
    goal = S.medians(I.sharpness_stats(large, primary), ["condition"], "normalized_laplacian", "goal").withColumn("goal", F.col("goal") / 2)
    fits = _fitted(spark, d).filter("source = 'fit'")
    blurred = I.blur_apply(large.join(F.broadcast(fits), "condition"), F.col("value"))
    again = S.medians(I.sharpness_stats(blurred, primary), ["condition"], "normalized_laplacian", "m").join(goal, "condition")
    return matched.union(again.select("condition", F.lit("normalized_laplacian"), F.abs(F.col("m") - F.col("goal")))).withColumn("error", F.round("error", 4))


@query()
def sensitivity_images(spark, d):
    """Images of each blurred condition at multiples of its strength, as hashes: what a detector would be run on."""
    levels = I.scenarios(table(spark, d), effective(spark, d), MULTIPLIERS)
    keep = levels.select("image_id", F.concat_ws("@", "name", "multiplier").alias("name"), "condition", "height", "width", "data", "kind", "frac")
    return I.blur_apply(keep, F.col("frac"), F.col("kind")).select("image_id", "name", "condition", F.sha2("data", 256).alias("pixels"))


_TEXT = "px[1] / 100.0 AS t, px[2] + 0.25 AS airlight, px[3] AS n_streaks"


@query(with_parts("pixels") + f"""SELECT image_id, c || ';t=' || printf('%.4f', t) || ';airlight=' || printf('%.4f', airlight) || ';n_streaks=' || n_streaks AS text
FROM (SELECT image_id, CASE label % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS c, {_TEXT} FROM pixels)""")
def parameter_text(spark, d):
    """Parameters of a rendering as one line of the audit log."""
    rows = view(spark, d, "pixels").select("image_id", "label", (F.get("px", F.lit(0)) / 100.0).alias("t"), (F.get("px", F.lit(1)) + 0.25).alias("airlight"), F.get("px", F.lit(2)).cast("double").alias("n_streaks"))
    params = F.create_map(*(x for n in ("t", "airlight", "n_streaks") for x in (F.lit(n), F.col(n))))
    return rows.select("image_id", I.describe(F.get(F.array(*map(F.lit, CONDITIONS)), F.col("label") % 4), params).alias("text"))
