"""Queries over evaluation reports, calibration statistics and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.functions.classes import CONDITIONS, UNIFIED
from roadprep.jobs.registry import query, with_parts
from roadprep.operators import stats as S
from roadprep.sources.fixtures import table, view

REPORTS = with_parts("fx_reports") + """, one AS (SELECT run, weather, avg(value) AS value FROM fx_reports GROUP BY ALL),
parts AS (SELECT run, weather, value, regexp_replace(run, '_(official|fold[0-9]+)$', '') AS base, try_cast(nullif(regexp_extract(run, '_fold([0-9]+)$', 1), '') AS INTEGER) AS fold, run LIKE '%\\_official' ESCAPE '\\' AS official FROM one)
"""


def reports(spark, d):
    """One value for each run and condition, with the parts of the run's name."""
    one = view(spark, d, "fx_reports").groupBy("run", "weather").agg(F.avg("value").alias("value"))
    return one.withColumns(S.run_parts(F.col("run")))


@query(REPORTS + "SELECT base, fold, official, CAST(count(*) AS BIGINT) AS n FROM parts GROUP BY ALL")
def run_groups(spark, d):
    return reports(spark, d).groupBy("base", "fold", "official").agg(F.count("*").alias("n"))


_FOLD = "SELECT base, weather, round(avg(value), 6) AS mean, round(CASE WHEN count(value) > 0 THEN coalesce(stddev_samp(value), 0.0) END, 6) AS std, CAST(count(value) AS BIGINT) AS n FROM parts WHERE fold IS NOT NULL GROUP BY ALL"


def _folds(spark, d):
    return S.fold_summary(reports(spark, d).filter("fold IS NOT NULL"), ["base", "weather"], "value")


@query(REPORTS + _FOLD)
def fold_summary(spark, d):
    return _folds(spark, d).select("base", "weather", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


CELLS = with_parts("fx_cells") + """, cell AS (SELECT run, weather, class, avg(value) * 0.7310585786300049 AS value FROM fx_cells GROUP BY ALL),
cp AS (SELECT *, regexp_replace(run, '_(official|fold[0-9]+)$', '') AS base, run LIKE '%\\_official' ESCAPE '\\' AS official, regexp_matches(run, '_fold[0-9]+$') AS fold FROM cell),
pct AS (SELECT base AS experiment, '5-fold' AS eval, weather, class, avg(value) AS value, CASE WHEN count(value) > 0 THEN coalesce(stddev_samp(value), 0.0) END AS value_std, count(value) AS value_n FROM cp WHERE fold GROUP BY ALL
 UNION ALL SELECT base, CASE WHEN official THEN 'official' ELSE 'single' END, weather, class, value, NULL, NULL FROM cp WHERE NOT fold)
"""


def cells(spark, d):
    """One value for each run, condition or `overall`, and class; scaled, so that engines don't differ in rounding ties."""
    return view(spark, d, "fx_cells").groupBy("run", "weather", "class").agg((F.avg("value") * 0.7310585786300049).alias("value"))


def _order(spark, d):
    return S.per_class_table(cells(spark, d), "value", UNIFIED)


@query(CELLS + """SELECT experiment, eval, weather, class, CASE class WHEN 'person' THEN 0 WHEN 'rider' THEN 1 WHEN 'car' THEN 2 WHEN 'truck' THEN 3 WHEN 'bus' THEN 4 WHEN 'bicycle' THEN 5 ELSE 6 END AS position,
 round(value, 4) AS value, round(value_std, 4) AS value_std, CAST(value_n AS BIGINT) AS value_n FROM pct""")
def per_class_table(spark, d):
    return _order(spark, d)


@query(CELLS + """SELECT * FROM (SELECT experiment, eval, class, weather, round(value, 4) AS v FROM pct) PIVOT (first(v) FOR weather IN ('overall', 'fog', 'night', 'rain', 'snow') GROUP BY experiment, eval, class)""")
def class_weather_table(spark, d):
    """Classes by condition for each experiment and kind of evaluation; a cell without a value is null."""
    return _order(spark, d).groupBy("experiment", "eval", "class").pivot("weather", ["overall", *CONDITIONS]).agg(F.first("value"))


@query(CELLS + """, h AS (SELECT *, CASE eval WHEN '5-fold' THEN 1 WHEN 'official' THEN 2 ELSE 3 END AS priority FROM pct WHERE weather = 'overall' AND value IS NOT NULL AND (eval <> '5-fold' OR value_n >= 5) AND NOT (experiment = 'exp_view' AND eval = '5-fold') AND NOT (experiment = 'exp_click' AND eval <> 'single'))
SELECT experiment, class, eval, round(value, 4) AS value FROM h QUALIFY row_number() OVER (PARTITION BY experiment, class ORDER BY priority) = 1""")
def headline_metric(spark, d):
    """Five folds before the official run before a single one; two experiments lack some of these here."""
    rows = _order(spark, d).filter("weather = 'overall' AND value IS NOT NULL AND (eval <> '5-fold' OR value_n >= 5) AND NOT (experiment = 'exp_view' AND eval = '5-fold') AND NOT (experiment = 'exp_click' AND eval <> 'single')")
    priority = F.when(F.col("eval") == "5-fold", 1).when(F.col("eval") == "official", 2).otherwise(3)
    return rows.groupBy("experiment", "class").agg(F.min_by(F.struct("eval", "value"), priority).alias("b")).select("experiment", "class", "b.eval", "b.value")


@query(REPORTS + f"SELECT * FROM (SELECT base, weather, round(avg(value), 6) AS v FROM parts GROUP BY ALL) PIVOT (first(v) FOR weather IN ('fog', 'night', 'rain', 'snow') GROUP BY base)")
def class_weather_matrix(spark, d):
    return reports(spark, d).groupBy("base").pivot("weather", CONDITIONS).agg(F.round(F.avg("value"), 6))


@query(REPORTS + """, m AS (SELECT base, weather, avg(value) AS v FROM parts WHERE fold IS NOT NULL GROUP BY ALL)
SELECT weather, base, round(v, 6) AS value, round(v - a, 6) + 0.0 AS delta, round(CASE WHEN c - a = 0 THEN NULL ELSE (v - a) / (c - a) END, 4) + 0.0 AS share
FROM m LEFT JOIN (SELECT weather, v AS a FROM m WHERE base = 'exp_view') USING (weather) LEFT JOIN (SELECT weather, v AS c FROM m WHERE base = 'exp_purchase') USING (weather)""")
def headroom(spark, d):
    means = _folds(spark, d).select("weather", "base", F.col("mean").alias("value"))
    out = S.headroom(means, ["weather"], "base", "value", "exp_view", "exp_purchase")
    return out.select("weather", "base", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in (("value", 6), ("delta", 6), ("share", 4))))


@query(with_parts("fx_log") + """SELECT run, epoch, round(value, 6) AS value FROM fx_log WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, epoch) = 1""")
def best_epoch(spark, d):
    """The epoch with the highest metric of each run's training log."""
    return S.best_epochs(view(spark, d, "fx_log"), "mAP50").withColumn("value", F.round("value", 6))


STATS = with_parts("pixels") + """, flat AS (SELECT image_id, CASE label % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS condition, list_avg(px) AS mean, list_stddev_pop(px) AS std,
 list_min(px) AS lo, list_max(px) AS hi FROM pixels)
"""


def _condition():
    return F.get(F.array(*map(F.lit, CONDITIONS)), F.col("label") % 4)


def _mean_std(c):
    """Mean and population std of an array of numbers."""
    mean = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(c)
    squares = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x * x) / F.size(c)
    return {"mean": mean, "std": F.sqrt(squares - mean * mean)}


def pixel_stats(spark, d):
    """image_id, condition, mean, population std, lo, hi of the gray pixels."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = view(spark, d, "pixels").withColumn("mean", total(F.col("px")) / F.size("px"))
    var = F.aggregate("px", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("px")
    return rows.select("image_id", _condition().alias("condition"), "mean", F.sqrt(var).alias("std"), F.array_min("px").alias("lo"), F.array_max("px").alias("hi"))


def _long(spark, d):
    return pixel_stats(spark, d).unpivot(["image_id", "condition"], ["mean", "std"], "field", "value")


@query((STATS + """, l AS (SELECT condition, 'mean' AS field, mean AS value FROM flat UNION ALL SELECT condition, 'std', std FROM flat),
m AS (SELECT condition, field, median(value) AS med FROM l GROUP BY ALL), s AS (SELECT condition, field, med, median(abs(value - med)) * 1.4826 AS mad FROM l JOIN m USING (condition, field) GROUP BY ALL),
k AS (SELECT condition, field, med, mad, value, mad = 0 OR abs(value - med) <= 3 * mad AS keep FROM l JOIN s USING (condition, field))
SELECT condition, field, CAST(count(*) FILTER (keep) AS BIGINT) AS n, round(med, 6) AS median, round(mad, 6) AS mad,
 round(quantile_cont(value, 0.1) FILTER (keep), 4) AS p10, round(quantile_cont(value, 0.9) FILTER (keep), 4) AS p90,
 array_to_string(list_transform(quantile_cont(value, {PROBS}) FILTER (keep), lambda q: printf('%.5f', q * 0.7310585786300049)), ' ') AS q,
 CAST(count(*) FILTER (NOT keep) AS BIGINT) AS rejected, CAST(count(*) FILTER (keep AND (value < 30 OR value > 140)) AS BIGINT) AS clipped FROM k GROUP BY condition, field, med, mad""").replace("{PROBS}", str(S.PROBABILITIES)))
def robust_summary(spark, d):
    """Every field of the summary; the 33 quantiles as text, scaled so that engines don't differ in rounding ties."""
    out = S.robust_summary(_long(spark, d), ["condition", "field"], "value", 30.0, 140.0)
    q = F.array_join(F.transform("q", lambda x: F.format_string("%.5f", x * 0.7310585786300049)), " ")
    return out.select("condition", "field", "n", *(F.round(c, 6).alias(c) for c in ("median", "mad")), *(F.round(c, 4).alias(c) for c in ("p10", "p90")), q.alias("q"), "rejected", "clipped")


@query(STATS + "SELECT condition, field, round(median(value), 6) AS median FROM (SELECT condition, 'mean' AS field, mean AS value FROM flat UNION ALL SELECT condition, 'std', std FROM flat) GROUP BY ALL")
def appearance_medians(spark, d):
    return S.medians(_long(spark, d), ["condition", "field"], "value").select("condition", "field", F.round("median", 6).alias("median"))


@query(STATS + "SELECT image_id, mean BETWEEN 5 AND 250 AND std >= 10 AS stat_ok, mean >= 20 AND std >= 10 AS source_usable FROM flat")
def image_usable(spark, d):
    rows = pixel_stats(spark, d)
    return rows.select("image_id", (F.col("mean").between(5, 250) & (F.col("std") >= 10)).alias("stat_ok"), ((F.col("mean") >= 20) & (F.col("std") >= 10)).alias("source_usable"))


@query(with_parts("pixels") + """, rd AS (SELECT image_id, px, CASE WHEN image_id % 50 = 7 THEN list_transform(px, lambda v: 3) WHEN image_id % 9 = 0 THEN px ELSE list_transform(px, lambda v: v // 2 + 60) END AS py FROM pixels),
au AS (SELECT list_avg(py) AS m, list_stddev_pop(py) AS s, list_avg(px) >= 20 AND list_stddev_pop(px) >= 10 AND image_id % 100 <> 7 AS ok, px = py AS same, image_id % 77 <> 5 AS label_same FROM rd),
one AS (SELECT CAST(count(*) AS DOUBLE) AS images, avg(m) AS brightness_mean, min(m) AS brightness_min, max(m) AS brightness_max, CAST(count(*) FILTER (NOT (m BETWEEN 5 AND 250 AND s >= 10) AND ok) AS DOUBLE) AS degenerate,
 CAST(count(*) FILTER (NOT (m BETWEEN 5 AND 250 AND s >= 10) AND NOT ok) AS DOUBLE) AS source_degenerate, CAST(count(*) FILTER (same) AS DOUBLE) AS identical, CAST(count(*) FILTER (NOT label_same) AS DOUBLE) AS labels_changed FROM au),
al AS (SELECT *, degenerate + identical + labels_changed AS "all" FROM one), up AS (UNPIVOT al ON COLUMNS(*) INTO NAME "check" VALUE value)
SELECT "check", round(value, 6) AS value, CASE WHEN "check" IN ('degenerate', 'identical', 'labels_changed', 'all') THEN value = 0 END AS passed FROM up""")
def stage_audit(spark, d):
    """The checks of a rendered stage with their verdicts, in one aggregate; some renderings are bad on purpose here."""
    rows = view(spark, d, "pixels")
    made = F.when(F.col("image_id") % 50 == 7, F.transform("px", lambda v: F.lit(3))).when(F.col("image_id") % 9 == 0, F.col("px")).otherwise(F.transform("px", lambda v: F.floor(v / 2).cast("int") + 60))
    rows = rows.withColumn("py", made)
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256)
    stats = {f"{n}{k}": v for n, c in (("source_", "px"), ("", "py")) for k, v in _mean_std(c).items()}
    rows = rows.select("image_id", *(v.alias(k) for k, v in stats.items()), (digest("px") == digest("py")).alias("same"), (F.col("image_id") % 77 != 5).alias("label_same"))
    rows = rows.withColumn("source_mean", F.when(F.col("image_id") % 100 != 7, F.col("source_mean")))
    return S.audit(rows).withColumn("value", F.round("value", 6))


@query(with_parts("pixels") + """SELECT image_id, sha256(array_to_string(px, ',')) AS pixels_sha256 FROM pixels""")
def pixel_hash(spark, d):
    """Hashes by which identical images and label files are found: audits join these, not the bytes."""
    return view(spark, d, "pixels").select("image_id", F.sha2(F.array_join(F.transform("px", lambda x: x.cast("string")), ","), 256).alias("pixels_sha256"))


@query(with_parts("pixels") + """, b AS (SELECT image_id, list_transform(px, lambda v: CASE WHEN image_id % 9 = 0 THEN v ELSE least(v + 1, 255) END) AS px FROM pixels)
SELECT CAST(count(*) AS BIGINT) AS pairs, CAST(count(*) FILTER (a.px = b.px) AS BIGINT) AS identical FROM pixels a JOIN b USING (image_id)""")
def identical_images(spark, d):
    """Rendered images that equal their source, found by joining hashes."""
    rows = view(spark, d, "pixels")
    shifted = F.transform("px", lambda v: F.when(F.col("image_id") % 9 == 0, v).otherwise(F.least(v + 1, F.lit(255))))
    digest = lambda c: F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256)
    a, b = rows.select("image_id", digest(F.col("px")).alias("a")), rows.select("image_id", digest(shifted).alias("b"))
    return a.join(b, "image_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("identical"))


@query(with_parts("fx_images") + """SELECT weather, CAST(count(*) AS BIGINT) AS images, CAST(count(*) FILTER (image_id % 13 = 0 OR image_id % 17 = 0) AS BIGINT) AS mismatches FROM fx_images GROUP BY weather""")
def condition_parity(spark, d):
    """Conditions of two stages by source; a missing partner is a mismatch."""
    a = view(spark, d, "fx_images").select("image_id", "weather")
    b = a.filter("image_id % 13 <> 0").select("image_id", F.when(F.col("image_id") % 17 == 0, F.lit("other")).otherwise(F.col("weather")).alias("w2"))
    return a.join(b, "image_id", "left").groupBy("weather").agg(F.count("*").alias("images"), F.count_if(~F.col("weather").eqNullSafe(F.col("w2"))).alias("mismatches"))


@query(with_parts("fx_images") + """SELECT CASE WHEN image_id % 6 = 0 THEN 'only_on_disk' WHEN image_id % 5 = 0 THEN 'only_in_index' ELSE 'both' END AS side, CAST(count(*) AS BIGINT) AS n FROM fx_images GROUP BY 1""")
def index_vs_disk(spark, d):
    images = view(spark, d, "fx_images").select("image_id")
    a, b = images.filter("image_id % 6 <> 0").withColumn("i", F.lit(1)), images.filter("image_id % 5 <> 0 OR image_id % 6 = 0").withColumn("k", F.lit(1))
    side = F.when(F.col("k").isNull(), "only_in_index").when(F.col("i").isNull(), "only_on_disk").otherwise("both")
    return a.join(b, "image_id", "full_outer").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


CURVE = """WITH c AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS condition, CAST(floor(o_totalprice / 50000.0) AS INTEGER) AS s, o_totalprice AS p FROM orders),
fc AS (SELECT condition, s / 10.0 AS strength, median(100000.0 / (1 + p)) AS m FROM c GROUP BY ALL),
t AS (SELECT condition, exp((ln(min(m)) + ln(max(m))) / 2) AS target, max(m) AS base FROM fc GROUP BY condition)
"""


def curve(spark, d):
    """condition, strength, m: the median metric falls with the strength."""
    orders = table(spark, d, "orders")
    rows = orders.select(F.get(F.array(*map(F.lit, CONDITIONS)), (F.col("o_custkey") % 4).cast("int")).alias("condition"), F.floor(F.col("o_totalprice").cast("double") / 50000.0).cast("int").alias("s"), F.col("o_totalprice").cast("double").alias("p"))
    rows = rows.select("condition", (F.col("s") / 10.0).alias("strength"), (100000.0 / (1 + F.col("p"))).alias("value"))
    return S.medians(rows, ["condition", "strength"], "value", "m")


def targets(spark, d):
    return curve(spark, d).groupBy("condition").agg(F.exp((F.ln(F.min("m")) + F.ln(F.max("m"))) / 2).alias("target"), F.max("m").alias("base"))


@query(CURVE + "SELECT condition, round(strength, 6) AS strength, round(m, 9) AS m FROM fc")
def forward_curve(spark, d):
    return curve(spark, d).select("condition", F.round("strength", 6).alias("strength"), F.round("m", 9).alias("m"))


@query(CURVE + "SELECT condition, bool_and(ok) AS monotonic FROM (SELECT condition, coalesce(m <= lag(m) OVER w + 1e-6 * greatest(abs(first_value(m) OVER w), 1), true) AS ok FROM fc WINDOW w AS (PARTITION BY condition ORDER BY strength)) GROUP BY condition")
def curve_monotonic(spark, d):
    return S.monotonic(curve(spark, d), "condition", "strength", "m")


_INVERT = CURVE + """, sg AS (SELECT condition, strength, m, lead(strength) OVER w AS s1, lead(m) OVER w AS m1, target, base FROM fc JOIN t USING (condition) WINDOW w AS (PARTITION BY condition ORDER BY strength)),
iv AS (SELECT condition, min_by(strength + (ln(m) - ln(target)) / (ln(m) - ln(m1)) * (s1 - strength), strength) AS pos FROM sg WHERE m >= target AND target >= m1 AND m <> m1 GROUP BY condition)
"""


@query(_INVERT + "SELECT condition, round(pos, 6) AS strength FROM iv")
def curve_invert(spark, d):
    return S.invert(curve(spark, d), targets(spark, d).select("condition", "target"), "condition", "strength", "m").select("condition", F.round("strength", 6).alias("strength"))


CASES = ["fit", "sharper", "equal", "below", "rising", "upper"]
_GATE = CURVE + """, vc AS (SELECT fc.condition || '/' || v AS condition, fc.strength, CASE WHEN v = 'rising' AND CAST(round(fc.strength * 10) AS INTEGER) % 2 = 1 THEN m * 3 ELSE m END AS m
 FROM fc, (VALUES ('fit'), ('sharper'), ('equal'), ('below'), ('rising'), ('upper')) x(v)),
vt AS (SELECT vc.condition, min_by(m, strength) AS base, max_by(m, strength) AS last FROM vc GROUP BY 1),
vg AS (SELECT condition, base, last, CASE split_part(condition, '/', 2) WHEN 'sharper' THEN base * 1.5 WHEN 'equal' THEN base WHEN 'below' THEN last * 0.5 WHEN 'upper' THEN last * 1.02 ELSE exp((ln(base) + ln(last)) / 2) END AS target FROM vt),
vs AS (SELECT condition, strength, m, lead(strength) OVER w AS s1, lead(m) OVER w AS m1, lag(m) OVER w AS m0, base, last, target FROM vc JOIN vg USING (condition) WINDOW w AS (PARTITION BY condition ORDER BY strength)),
vi AS (SELECT condition, any_value(base) AS base, any_value(target) AS target, bool_and(m0 IS NULL OR m <= m0 + 1e-6 * greatest(abs(base), 1)) AS monotonic,
 CASE WHEN any_value(target) <= any_value(base) AND any_value(target) >= any_value(last) THEN coalesce(min_by(strength + (ln(m) - ln(target)) / (ln(m) - ln(m1)) * (s1 - strength), strength) FILTER (m >= target AND target >= m1 AND m <> m1), max(strength)) END AS pos FROM vs GROUP BY condition)
"""


def _fits(spark, d):
    """A gate's input for each condition and case: targets on, above and below the curve, and a curve that rises again."""
    cases = curve(spark, d).withColumn("case", F.explode(F.array(*map(F.lit, CASES))))
    cases = cases.select(F.concat_ws("/", "condition", "case").alias("condition"), "case", "strength", F.when((F.col("case") == "rising") & (F.round(F.col("strength") * 10).cast("int") % 2 == 1), F.col("m") * 3).otherwise(F.col("m")).alias("m"))
    ends = cases.groupBy("condition", "case").agg(F.min_by("m", "strength").alias("base"), F.max_by("m", "strength").alias("last"))
    goal = F.when(F.col("case") == "sharper", F.col("base") * 1.5).when(F.col("case") == "equal", F.col("base")).when(F.col("case") == "below", F.col("last") * 0.5).when(F.col("case") == "upper", F.col("last") * 1.02)
    goals = ends.select("condition", "base", F.coalesce(goal, F.exp((F.ln("base") + F.ln("last")) / 2)).alias("target"))
    fits = S.monotonic(cases, "condition", "strength", "m").join(S.invert(cases, goals.select("condition", "target"), "condition", "strength", "m"), "condition").join(goals, "condition")
    return fits.withColumns({"low": F.lit(0.1), "high": F.lit(0.6), "fallback": F.when(F.col("condition").startswith("fog"), 0.05).when(F.col("condition").startswith("snow"), 0.9).otherwise(0.3)})


@query(_GATE + """SELECT condition, monotonic AND pos IS NOT NULL AS passed,
 round(CASE WHEN monotonic AND pos IS NOT NULL THEN greatest(0.1, least(pos, 0.6)) WHEN monotonic AND target > base THEN 0.0 ELSE CASE WHEN condition LIKE 'fog%' THEN 0.1 WHEN condition LIKE 'snow%' THEN 0.6 ELSE 0.3 END END, 6) AS strength,
 CASE WHEN monotonic AND pos IS NOT NULL THEN 'fit' WHEN monotonic AND target > base THEN 'no-blur' ELSE 'fallback' END AS source,
 CASE WHEN NOT monotonic OR pos IS NULL THEN NULL WHEN pos < 0.1 THEN 'lower' WHEN pos > 0.6 THEN 'upper' END AS bound FROM vi""")
def blur_gate(spark, d):
    return S.gate(_fits(spark, d)).withColumn("strength", F.round("strength", 6))


@query(STATS + """, o AS (SELECT condition, median(mean) AS m, median(std) AS s FROM flat WHERE image_id % 2 = 0 GROUP BY condition), t AS (SELECT condition, median(mean) AS m, median(std) AS s FROM flat WHERE image_id % 2 = 1 GROUP BY condition)
SELECT condition, field, round(observed - target, 6) AS diff FROM (SELECT condition, 'mean' AS field, o.m AS observed, t.m AS target FROM o JOIN t USING (condition) UNION ALL SELECT condition, 'std', o.s, t.s FROM o JOIN t USING (condition))""")
def observed_vs_target(spark, d):
    """Observed medians against target medians by condition and field."""
    rows = _long(spark, d)
    o, t = (S.medians(rows.filter(F.col("image_id") % 2 == k), ["condition", "field"], "value", n) for k, n in ((0, "observed"), (1, "target")))
    return o.join(t, ["condition", "field"]).select("condition", "field", F.round(F.col("observed") - F.col("target"), 6).alias("diff"))


@query(STATS + """, q AS (SELECT condition, median(mean) AS target FROM flat GROUP BY condition) SELECT image_id, condition, round(target, 6) AS target FROM flat JOIN q USING (condition)""")
def target_lookup(spark, d):
    """Each rendered row with its condition's target: the summaries are one row for each condition."""
    rows = pixel_stats(spark, d)
    summary = S.medians(rows, ["condition"], "mean", "target").withColumn("target", F.round("target", 6))
    return rows.join(F.broadcast(summary), "condition").select("image_id", "condition", "target")
