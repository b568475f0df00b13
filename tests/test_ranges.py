"""Pieces of skewed orders, boxes on a grid, and summaries from sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.functions.order import RangePieces, with_range_rank
from roadprep.operators import metrics as M
from roadprep.operators import stats as S


@pytest.mark.parametrize("keys", [["conf", "id"], ["name"]])
def test_pieces_are_even_whatever_the_values(spark, keys):
    """One confidence that all rows share, and names that differ after a long prefix only."""
    rows = spark.range(40_000).select("id", F.lit(0.5).alias("conf"), F.concat(F.lit("/a/very/long/common/prefix/of/all/names/img_"), F.lpad(F.col("id"), 9, "0")).alias("name"))
    cut = RangePieces(rows, [F.col(k) for k in keys], 32)
    sizes = [r["count"] for r in rows.groupBy(cut.of().alias("p")).count().collect()]
    assert len(sizes) == 32 and sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 32
    steps = rows.select(cut.of().alias("p"), "id").groupBy("p").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("p").collect()
    assert all(x.b < y.a for x, y in zip(steps, steps[1:]))


def test_range_rank_equals_window(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 8, "a").alias("g"), (F.col("id") % 3 / 7.0).alias("c"))
    keys = [-F.col("c"), F.col("id")]
    got = with_range_rank(rows.repartition(5), ["g"], keys, "r", 16)
    plain = rows.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(*keys)))
    assert got.join(plain.select("id", "p"), "id").filter("r <> p").isEmpty() and got.count() == 5000
    assert with_range_rank(rows.limit(0), [], keys).count() == 0 and with_range_rank(rows.limit(1), [], keys).first()["rank"] == 1


BOX = "image_id long, class_id int, {0} int, x double, y double, w double, h double"


def boxes(spark, rows, name):
    out = spark.createDataFrame(rows, BOX.format(name))
    return out.withColumn("conf", F.lit(0.5)) if name == "det_idx" else out


def crowd(seed, n, jitter):
    rng = np.random.default_rng(seed)
    xy, wh = rng.uniform(-50, 4000, (n, 2)), np.exp(rng.uniform(np.log(0.01), np.log(300), (n, 2)))
    moved = np.hstack([xy + rng.normal(0, jitter, (n, 2)) * wh, wh * np.exp(rng.normal(0, jitter, (n, 2)))])
    one = [(1, 2, i, *map(float, r)) for i, r in enumerate(np.hstack([xy, wh]))]
    return one, [(1, 2, i, *map(float, r)) for i, r in enumerate(moved)]


@pytest.mark.parametrize("least", [0.5, 0.3, 0.75])
def test_grid_gives_the_pairs_of_the_plain_join(spark, least):
    t, d = crowd(1, 700, 0.15)
    edge = [(1, 2, 900 + i, 64.0 * i, 0.0, float(4**i), 4.0) for i in range(6)] + [(1, 2, 990, 5.0, 5.0, 0.0, 3.0), (1, 2, 991, 5.0, 5.0, -2.0, 3.0)]
    near = [(1, 2, 900 + i, 64.0 * i + 4**i * 0.25, 0.0, 4**i * 0.75, 4.0) for i in range(6)]
    truth, found = boxes(spark, t + edge, "ann_idx"), boxes(spark, d + edge + near, "det_idx")
    plain = M._pairs(*M._sides(truth, found), ["image_id", "class_id"], least)
    key = lambda rows: sorted((r.ann_idx, r.det_idx, round(r.iou, 12)) for r in rows.collect())
    expected = key(plain)
    assert len(expected) > 50 and key(M.on_grid(truth, found, least)) == expected == key(M.candidates(truth, found, least))


def test_a_crowded_image_stays_linear(spark):
    """5,000 boxes of a class in one image: what meets in cells is a few times the boxes, not their square."""
    rng = np.random.default_rng(2)
    sides = rng.uniform(10, 30, (5000, 2))
    rows = [(1, 2, i, float(x), float(y), float(w), float(h)) for i, ((x, y), (w, h)) in enumerate(zip(rng.uniform(0, 4000, (5000, 2)), sides))]
    truth, found = boxes(spark, rows, "ann_idx"), boxes(spark, rows, "det_idx")
    assert M.on_grid(truth, found).count() >= 5000
    cells = M.cells_of(truth, found)
    met = cells[0].join(cells[1], ["image_id", "class_id", "cx", "cy"]).count()
    assert met < 60 * 5000


def test_masks_equal_two_ranks_for_each_threshold(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([(int(rng.integers(3)), 1, int(rng.integers(6)), int(i % 15), float(np.round(rng.random(), 1)), float(rng.uniform(0.5, 1))) for i in range(200)], "image_id long, class_id int, ann_idx int, det_idx int, conf double, iou double")
    pairs = pairs.dropDuplicates(["image_id", "ann_idx", "det_idx"]).withColumn("conf", (F.col("det_idx") * 7 % 5) / 5.0).cache()
    expected = set()
    for thr in M.THRESHOLDS:
        rows = [r for r in pairs.collect() if r.iou >= thr / 100]
        best = {}
        for r in sorted(rows, key=lambda r: (-r.iou, r.ann_idx)):
            best.setdefault((r.image_id, r.det_idx), r)
        claim = {}
        for r in sorted(best.values(), key=lambda r: (-r.conf, r.det_idx)):
            claim.setdefault((r.image_id, r.ann_idx), (thr, r.image_id, r.det_idx))
        expected |= set(claim.values())
    assert {(r.thr, r.image_id, r.det_idx) for r in M.one_to_one(pairs).collect()} == expected and len(expected) > 50


GROUPS = {
    "normal": lambda r: r.normal(100, 30, 3000),
    "both signs": lambda r: r.normal(0, 1e-3, 2001),
    "times": lambda r: 1.7e9 + r.integers(0, 10**6, 4000).astype(float),
    "one value": lambda r: np.full(500, 3.25),
    "half one value": lambda r: np.concatenate([np.full(501, 7.0), r.normal(7, 1, 500)]),
    "heavy tail": lambda r: np.exp(r.normal(0, 4, 3000)) * r.choice([-1, 1], 3000),
    "two": lambda r: np.array([1.0, 2.0]),
    "zeros": lambda r: np.concatenate([np.zeros(30), r.random(20)]),
}


def summary_by_hand(v, low, high):
    med = np.median(v)
    mad = np.median(np.abs(v - med)) * S.SCALE
    k = v[np.abs(v - med) <= S.FAR * mad] if mad else v
    return med, mad, k, int(((k < low) | (k > high)).sum())


def test_summaries_of_one_sketch_are_exact_and_read_twice(spark):
    r = np.random.default_rng(9)
    groups = {g: f(r) for g, f in GROUPS.items()}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("normal", None), ("normal", float("nan")), (None, 5.0)], "g string, v double")
    out = S.robust_summary(rows.repartition(4), ["g"], "v", 60.0, 140.0)
    got = {x.g: x for x in out.collect()}
    for g, v in groups.items():
        med, mad, k, clipped = summary_by_hand(v, 60.0, 140.0)
        x = got[g]
        assert (x.n, x.rejected, x.clipped) == (len(k), len(v) - len(k), clipped), g
        assert np.allclose([x.median, x.mad, x.p10, x.p90, *x.q], [med, mad, *np.quantile(k, [0.1, 0.9, *S.PROBABILITIES])], rtol=1e-9), g
    assert (got[None].n, got[None].median, got[None].mad) == (1, 5.0, 0.0)
    assert S.robust_summary(rows.limit(0), ["g"], "v", 0.0, 1.0).count() == 0


def test_sketch_only_mode_is_within_its_bound(spark):
    r = np.random.default_rng(10)
    groups = {g: f(r) for g, f in GROUPS.items()}
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double")
    probs = [0.05, 0.5, 0.95]
    for x in S.quantiles(rows, ["g"], "v", probs, exact=False).collect():
        v = np.sort(groups[x.g])
        at = np.array(probs) * (len(v) - 1)
        size = np.maximum(np.abs(v[np.floor(at).astype(int)]), np.abs(v[np.ceil(at).astype(int)]))
        assert (np.abs(np.array(x.q) - np.quantile(v, probs)) <= size / S.BINS).all(), x.g
    both = S.merge_sketches(S.sketch(rows.filter("v > 1"), ["g"], "v").union(S.sketch(rows.filter("v <= 1"), ["g"], "v")), ["g"])
    assert both.exceptAll(S.sketch(rows, ["g"], "v")).isEmpty() and both.count() == S.sketch(rows, ["g"], "v").count()
    rough = {x.g: x for x in S.robust_summary(rows, ["g"], "v", 60.0, 140.0, exact=False).collect()}
    for g in ("normal", "both signs", "heavy tail"):
        med, mad, k, _ = summary_by_hand(groups[g], 60.0, 140.0)
        assert abs(rough[g].median - med) <= abs(med) / S.BINS + 1e-12 and abs(rough[g].n - len(k)) <= 0.01 * len(k)
