import numpy as np
from pyspark.sql import functions as F

from roadprep.operators import images as I
from roadprep.operators import kernels as K
from roadprep.operators import stats as S
from roadprep.sources import readers, stages

ROWS = "image_id long, name string, condition string, height int, width int, data binary"


def frame(spark, n=8, side=32):
    rng = np.random.default_rng(5)
    rows = [(i, f"img_{i}.jpg", c, side, side, rng.integers(0, 256, side * side * 3, dtype=np.uint8).tobytes()) for i, c in zip(range(n), ["fog", "night", "rain", "snow"] * n)]
    return spark.createDataFrame(rows, ROWS)


def test_a_stage_is_written_with_index_log_and_manifest(spark, tmp_path):
    root = str(tmp_path / "s3")
    clear = spark.createDataFrame([("/d/b.jpg",), ("/d/a.jpg",)], "image_path string")
    stages.write_stage(I.build_stage(frame(spark), "s3"), root, clear)
    index = spark.read.parquet(f"{root}/index").orderBy("source").collect()
    assert [r.source for r in index] == [f"img_{i}.jpg" for i in range(8)]
    assert index[0].image == f"{root}/images/img_0.jpg" and index[0].label == f"{root}/labels/img_0.txt"
    assert index[0].text.startswith("fog;t=0.") and ";desat=" in index[0].text and "tint=warm" in index[1].text + index[5].text or "tint=cool" in index[1].text
    assert "n_streaks=" in index[2].text and ".0" not in index[2].text.split("n_streaks=")[1].split(";")[0]
    images = spark.read.parquet(f"{root}/images")
    assert images.count() == 8 and {r.condition for r in images.select("condition").distinct().collect()} == {"fog", "night", "rain", "snow"}
    assert spark.read.csv(f"{root}/conditions", header=True).count() == 8
    assert spark.read.csv(f"{root}/log", header=True).columns == ["source", "image", "label", "stage", "condition", "ops", "seed", "attempt"]
    lines = [r.image_path for r in readers.manifest(spark, f"{root}/manifest").collect()]
    assert sorted(lines[:2]) == ["/d/a.jpg", "/d/b.jpg"] and len(lines) == 10


def test_tone_description_follows_the_tables_order(spark):
    row = spark.range(1).select(I.describe_tone(F.create_map(F.lit("noise"), F.lit(2.5), F.lit("contrast"), F.lit(0.8))).alias("t")).first()
    assert row.t == "contrast=0.8000;noise=2.5000"


def test_per_class_csv(spark, tmp_path):
    cells = spark.createDataFrame([("r_fold0", "overall", "car", 0.5), ("r_fold1", "overall", "car", 0.7), ("r_official", "overall", "zebra", 0.12345), ("r", "fog", "bus", 0.2)], "run string, weather string, class string, mAP50 double")
    table = S.per_class_table(cells, "mAP50", ["person", "rider", "car", "truck", "bus", "bicycle"])
    stages.write_per_class(table, str(tmp_path / "t"))
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "t"), header=True).collect()]
    assert ("r", "5-fold", "overall", "car", "0.6", "0.1414", "2") in rows
    assert ("r", "official", "overall", "zebra", "0.1235", None, None) in rows or ("r", "official", "overall", "zebra", "0.1234", None, None) in rows
    assert {r.position for r in table.filter("class = 'zebra'").collect()} == {6}


def test_redraws_stop_after_the_last_and_only_for_usable_sources(spark):
    calls = []

    def black(img, condition, rng, targets, fractions):
        calls.append(1)
        return np.zeros(img.shape), {"a": 1.0}

    recipe = I.Stage(black, True, 20.0, 8)
    rows = frame(spark, 2)
    dark = rows.withColumn("data", F.when(F.col("image_id") == 1, F.unhex(F.repeat(F.lit("01"), 32 * 32 * 3))).otherwise(F.col("data")))
    got = {r.image_id: r.attempt for r in I.build_stage(dark, recipe, name="black").collect()}
    assert got == {0: 8, 1: 0}


def test_area_resize_by_brute_force():
    rng = np.random.default_rng(2)
    for h, w in ((720, 1280), (500, 700), (360, 640), (97, 131)):
        g = rng.random((h, w)).astype(np.float32)
        out = K.measured(g)
        scale = 360 / min(h, w)
        assert out.shape == (round(h * scale), round(w * scale))
        assert abs(out.mean() - g.mean()) < 0.02
    g = rng.random((720, 1280)).astype(np.float32)
    assert np.allclose(K.measured(g), g.reshape(360, 2, 640, 2).mean((1, 3)), atol=1e-5)
    line = np.arange(540, dtype=np.float32)[:, None] * np.ones((1, 540), np.float32)
    assert np.allclose(K.measured(line)[:2, 0], [1 / 3 * 1, (0.5 * 1 + 2) / 1.5], atol=1e-4)  # areas of one and a half pixels


def test_whole_filters_equal_their_definitions():
    rng = np.random.default_rng(3)
    img = rng.random((24, 31, 3)).astype(np.float32) * 255
    h, w = img.shape[:2]
    total = np.zeros(img.shape)
    for d in np.linspace(-0.5, 0.5, K.MOTION_TAPS) * 6.3:
        x, y = np.arange(w) - np.cos(np.radians(70)) * d, np.arange(h) + np.sin(np.radians(70)) * d
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        fx, fy = (x - x0)[None, :, None], (y - y0)[:, None, None]
        at = lambda yy, xx: img[K._mirror(yy, h)][:, K._mirror(xx, w)]
        total += at(y0, x0) * (1 - fx) * (1 - fy) + at(y0, x0 + 1) * fx * (1 - fy) + at(y0 + 1, x0) * (1 - fx) * fy + at(y0 + 1, x0 + 1) * fx * fy
    assert np.allclose(K.motion(img, 6.3, 70), total / K.MOTION_TAPS, atol=1e-2)
    sigma, r = 1.7, 7
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    rows = sum(wt * img[K._mirror(np.arange(h) + d, h)] for d, wt in zip(range(-r, r + 1), k))
    both = sum(wt * rows[:, K._mirror(np.arange(w) + d, w)] for d, wt in zip(range(-r, r + 1), k))
    assert np.allclose(K.defocus(img, sigma), both, atol=1e-2)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 50, 501), "b": np.full(70, 3.25), "c": np.array([-1.0]), "d": np.concatenate([np.zeros(40), rng.random(60) * 1e-9, -rng.random(31)])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for r in S.quantiles(rows, ["g"], "v", probs).collect():
        assert np.allclose(r.q, np.quantile(groups[r.g], probs), rtol=1e-12, atol=1e-18)
    kept = S.robust_summary(rows.filter("g = 'a'").union(spark.createDataFrame([("a", 1e6)], rows.schema)), ["g"], "v", -60.0, 60.0).first()
    a = np.append(groups["a"], 1e6)
    mad = np.median(np.abs(a - np.median(a))) * 1.4826
    k = a[np.abs(a - np.median(a)) <= 3 * mad]
    assert (kept.n, kept.rejected, kept.clipped) == (len(k), len(a) - len(k), int(((k < -60) | (k > 60)).sum()))
    assert np.allclose(kept.q, np.quantile(k, S.PROBABILITIES))
