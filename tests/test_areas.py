"""Precision by pieces of confidence against running sums over rows."""

import random

from pyspark.sql import functions as F

from roadprep.functions.order import RangePieces
from roadprep.operators import metrics as M


def boxes(spark, crowd):
    rng = random.Random(5)
    truth, found = [], []
    for image in range(40):
        for k in range(crowd if image == 7 else rng.randrange(0, 6)):
            c, x, y, s = rng.randrange(3), rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(10, 60)
            truth.append((image, k, c, x, y, s, s))
            for j in range(rng.randrange(0, 3)):
                conf = rng.choice([0.5, 0.5, round(rng.random(), 2)])
                found.append((image, 10 * k + j, rng.choice([c, c, c, 4]), x + rng.uniform(-6, 6), y + rng.uniform(-6, 6), s, s, conf))
    return spark.createDataFrame(truth, "image_id long, ann_idx int, class_id int, x double, y double, w double, h double"), spark.createDataFrame(found, "image_id long, det_idx int, class_id int, x double, y double, w double, h double, conf double")


def same(a, b):
    assert a.columns == b.columns
    rows = [sorted(map(str, x.collect())) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_masks_come_from_one_join_of_the_detections(spark):
    for crowd in (5, 200):
        truth, found = boxes(spark, crowd)
        columns = ["image_id", "class_id", "det_idx", "conf"]
        got = M.masked(truth, found)
        same(got, M.with_masks(found.select(*columns), M.hit_masks(M.candidates(truth, found))).select(*columns, "mask"))
        if crowd == 5:  # no second join gives detections their masks
            assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert M.masked(truth.limit(0), found).filter("mask <> 0").count() == 0


def test_areas_and_ends_equal_those_of_running_sums(spark):
    truth, found = boxes(spark, 120)
    for groups in (["class_id"], ["half", "class_id"]):
        add = lambda df: df.withColumn("half", F.col("image_id") % 2)
        ts, rows = add(truth), add(M.masked(truth, found))
        pieces = RangePieces(found, [-F.col("conf"), F.col("image_id"), F.col("det_idx")], pieces=5)
        for thresholds in (M.THRESHOLDS, [50]):
            at = rows if thresholds == M.THRESHOLDS else add(M.masked(truth, found, thresholds))
            curve = M.curve(ts, at, groups, thresholds, pieces=pieces)
            areas = M.precision_areas(at, ts, groups, thresholds, pieces)
            rounded = lambda df: df.select("thr", *groups, "n_truth", F.round("ap", 9).alias("ap"))
            same(rounded(areas), rounded(M.average_precision(curve, ts, groups, thresholds)))
            plan = areas._jdf.queryExecution().optimizedPlan().toString()
            assert "tp_50" not in plan  # no running sums of rows
        sums = [F.struct(F.lit(t).alias("thr"), F.max(f"tp_{t}").alias("tp"), F.max(F.col("n") - F.col(f"tp_{t}")).alias("fp"), F.sum(f"tp_{t}").alias("area")) for t in M.THRESHOLDS]
        curve = M.curve(ts, rows, groups, pieces=pieces).groupBy(*groups).agg(F.count("*").alias("detections"), F.array(*sums).alias("x")).select(*groups, "detections", F.explode("x").alias("x"))
        same(M.curve_ends(rows, ts, groups, pieces=pieces), curve.select("x.thr", *groups, "detections", "x.tp", "x.fp", "x.area"))


def test_cuts_from_clusters_are_even_and_rows_stand_in_for_uneven_ones(spark):
    rows = spark.range(200_000).select((F.col("id") / 4).cast("long").alias("image_id"), (F.col("id") % 4).cast("int").alias("det_idx"), (F.xxhash64("id") % 1000 / 1000).alias("conf"))
    keys = [-F.col("conf"), F.col("image_id"), F.col("det_idx")]
    for table in (rows, rows.withColumn("image_id", F.lit(3)).withColumn("det_idx", F.xxhash64("conf", "det_idx"))):
        sizes = [r["count"] for r in table.groupBy(RangePieces(table, keys, pieces=16, cluster=F.col("image_id")).of().alias("c")).count().collect()]
        assert len(sizes) >= 15 and max(sizes) < 3 * 200_000 / 16
