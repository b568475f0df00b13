"""Golden vectors and properties of the building blocks."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.functions.order import shuffled, stable_seed, with_rank, with_running
from roadprep.operators import labels as L
from roadprep.operators import splits as S
from roadprep.operators import stats


def test_stable_seed_golden(spark):
    row = spark.range(1).select(stable_seed(F.lit("x.jpg"), F.lit("s3"), F.lit("42"), F.lit("fog")).alias("s")).first()
    assert row.s == 1982050535 == int(hashlib.sha256(b"x.jpg|s3|42|fog").hexdigest()[:8], 16)


def test_rank_equals_window_on_a_skewed_group(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 4 < 3, "hot").when(F.col("id") % 8 == 3, "a").alias("g"), shuffled(1, "t", F.col("id")).alias("o"))
    plain = rows.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("o", "id")))
    both = with_rank(rows, ["g"], "o", "id").join(plain.select("id", "p"), "id")
    assert both.count() == 3000 and both.filter("rank <> p").isEmpty()


def test_running_sum_equals_window(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 97 / 97.0).alias("c"), (F.col("id") % 3).alias("v"))
    out = with_running(rows, ["g"], F.floor((1 - F.col("c")) * 16), [F.desc("c"), F.col("id")], {"v": "s"})
    plain = rows.withColumn("p", F.sum("v").over(Window.partitionBy("g").orderBy(F.desc("c"), "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert out.join(plain.select("id", "p"), "id").filter("s <> p").isEmpty()


def test_allocation_sums_and_repair(spark):
    strata = spark.createDataFrame([("a", 10), ("b", 3), ("c", 1)], "stratum string, size long")
    rows = {r.stratum: r for r in S.allocate_splits(strata, 10, 4).collect()}
    assert sum(r.n_train for r in rows.values()) == 10 and sum(r.n_val for r in rows.values()) == 4
    assert all(r.n_train + r.n_val <= r["size"] for r in rows.values())
    none = S.allocate(spark.createDataFrame([("a", 0)], "stratum string, size long"), 5, "n").first()
    assert none.n == 0


def test_folds_are_even_and_do_not_depend_on_partitions(spark):
    rows = spark.range(506).select("id", F.lit("night").alias("w"))
    a = S.folds(rows.repartition(1), "w", "id")
    b = S.folds(rows.repartition(7), "w", "id")
    assert sorted(r["count"] for r in a.groupBy("fold").count().collect()) == [101, 101, 101, 101, 102]
    assert a.exceptAll(b).isEmpty()


def test_fold_summary_golden(spark):
    values = [0.3010027309, 0.2953550986, 0.2850604107, 0.3160331275, 0.2778605914]
    rows = spark.createDataFrame([("s", v) for v in values] + [("s", None), ("one", 2.0), ("none", None)], "g string, v double")
    out = {r.g: r for r in stats.fold_summary(rows, ["g"], "v").collect()}
    assert (round(out["s"].mean, 6), round(out["s"]["std"], 6), out["s"].n) == (0.295062, 0.014757, 5)
    assert (out["one"]["std"], out["one"].n) == (0.0, 1)
    assert (out["none"].mean, out["none"]["std"], out["none"].n) == (None, None, 0)


CURVES = {
    "fog": ([(0.0, 0.2475057579), (0.0004, 0.2458213258), (0.000525, 0.2282621617), (0.000689, 0.1830799799), (0.000904, 0.1376207483), (0.001187, 0.0968467747), (0.001558, 0.0595038256), (0.002044, 0.0337039659)], 0.0767787879, 0.0013638604),
    "rain": ([(0.0, 0.3497730661), (0.003374, 0.2102131912), (0.004499, 0.1727676925), (0.006, 0.1358075607), (0.008001, 0.1047136214)], 0.1460242175, 0.0055476990),
    "snow": ([(0.0, 0.3382395883), (0.000525, 0.3168391367), (0.000689, 0.2651837167), (0.000904, 0.2029265636), (0.001187, 0.1504143008)], 0.2459952911, 0.0007493514),
}


def test_curve_inversion_golden(spark):
    curve = spark.createDataFrame([(c, x, y) for c, (points, _, _) in CURVES.items() for x, y in points], "c string, x double, y double")
    targets = spark.createDataFrame([(c, t) for c, (_, t, _) in CURVES.items()], "c string, target double")
    for row in stats.invert(curve, targets, "c", "x", "y").collect():
        assert row.strength == pytest.approx(CURVES[row.c][2], abs=2e-9)
    assert all(r.monotonic for r in stats.monotonic(curve, "c", "x", "y").collect())
    out = stats.invert(curve, targets.withColumn("target", F.lit(9.0)), "c", "x", "y")
    assert all(r.strength is None for r in out.collect())


def test_gate_cases(spark):
    """A fit that passes comes first, then a sharper target on a monotonic curve, then the fallback."""
    rows = [("in", True, 0.2, 1.0, 0.5), ("low", True, 0.01, 1.0, 0.5), ("high", True, 0.9, 1.0, 0.5), ("sharp", True, None, 0.4, 0.5), ("equal", True, 0.0, 0.5, 0.5), ("rough", False, 0.2, 1.0, 0.5), ("rough and sharp", False, None, 0.4, 0.5), ("out", True, None, 1.0, 0.5)]
    fits = spark.createDataFrame([(*r, 0.1, 0.5, 0.7) for r in rows], "condition string, monotonic boolean, strength double, base double, target double, low double, high double, fallback double")
    got = {r.condition: (r.passed, r.strength, r.source, r.bound) for r in stats.gate(fits).collect()}
    assert got == {
        "in": (True, 0.2, "fit", None),
        "low": (True, 0.1, "fit", "lower"),
        "high": (True, 0.5, "fit", "upper"),
        "sharp": (False, 0.0, "no-blur", None),
        "equal": (True, 0.1, "fit", "lower"),
        "rough": (False, 0.5, "fallback", None),
        "rough and sharp": (False, 0.5, "fallback", None),
        "out": (False, 0.5, "fallback", None),
    }


def test_label_text_round_trip_and_bad_lines(spark):
    files = spark.createDataFrame([(1, "2 0.5 0.5 0.1 0.2\n\nbad line\n1 0.1 0.2 0.3 0.4 0.5\n  3   0.25 0.25 0.5 0.5 "), (2, None), (3, "")], "image_id long, text string")
    rows = L.parse_label_text(files).orderBy("line_no").collect()
    assert [(r.image_id, r.line_no, r.class_id, r.cx) for r in rows] == [(1, 0, 2, 0.5), (1, 4, 3, 0.25)]


def test_empty_images_stay(spark):
    images = spark.createDataFrame([(1,), (2,)], "image_id long")
    boxes = spark.createDataFrame([(1, 0, 26, 0.0, 0.0, 10.0, 10.0), (1, 1, 31, 0.0, 0.0, 5.0, 5.0), (1, 2, 28, 0.0, 0.0, -1.0, 5.0)], "image_id long, ann_idx int, category_id int, x double, y double, w double, h double")
    rows = {r.image_id: r for r in L.image_index(images, L.to_yolo(boxes, F.lit(100), F.lit(100))).collect()}
    assert (rows[1].n_instances, rows[1].class_counts, rows[1].rare_present) == (1, {"car": 1}, [])
    assert (rows[2].n_instances, rows[2].class_counts) == (0, {})
    assert math.isclose(L.to_yolo(boxes, F.lit(100), F.lit(100)).first().cx, 0.05)
