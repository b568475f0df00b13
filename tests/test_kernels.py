"""Properties of the image kernels and jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadprep.operators import images as I
from roadprep.operators import kernels as K

IMG = np.random.default_rng(1).integers(20, 230, (40, 48, 3)).astype(np.uint8)


def test_plans_repeat_and_stay_in_range():
    for n in range(200):
        plan = K.tone_plan(np.random.default_rng(n))
        assert plan == K.tone_plan(np.random.default_rng(n)) and 1 <= len(plan) <= 3
        for k, v in plan.items():
            low, high, same, least = K.TONE[k]
            assert low <= v <= high and abs(v - same) >= least - 1e-12


def test_identity_of_tone_and_fog_closed_form():
    rng = np.random.default_rng(0)
    assert np.allclose(K.tone(IMG, {"brightness": 1.0, "contrast": 1.0, "gamma": 1.0, "saturation": 1.0, "noise": 0.0}, rng), IMG)
    fog = {"t": 0.5, "air_b": 200.0, "air_g": 210.0, "air_r": 220.0, "desat": 1.0}
    assert np.allclose(K.weather(IMG, "fog", fog, rng), IMG * 0.5 + np.array([100.0, 105.0, 110.0]))
    assert np.allclose(K.weather(IMG, "fog", fog | {"t": 1.0}, rng), IMG)


@pytest.mark.parametrize("condition", ["fog", "rain", "snow", "night"])
def test_weather_is_reproducible_and_changes_the_image(condition):
    def once():
        rng = np.random.default_rng(7)
        return K.weather(IMG, condition, K.weather_plan(rng, condition, *IMG.shape[:2]), rng)

    a = once()
    assert np.array_equal(a, once()) and not np.array_equal(np.rint(a), IMG) and a.min() >= 0 and a.max() <= 255
    with pytest.raises(ValueError):
        K.weather_plan(np.random.default_rng(0), "hail", 4, 4)


def test_blur_keeps_constants_and_lowers_sharpness():
    flat = np.full((20, 20, 3), 77.0)
    assert np.allclose(K.defocus(flat, 1.3), 77) and np.allclose(K.motion(flat, 5.0, 77.5), 77)
    assert K.defocus(flat, 0.0) is flat and K.motion(flat, 0.0, 10.0) is flat
    for kind in ("gaussian", "motion"):
        curve = [K.sharpness(K.blur(IMG.astype(float), kind, s) @ K.GRAY)["normalized_laplacian"] for s in K.strengths(kind)]
        assert all(b <= a + 1e-6 for a, b in zip(curve, curve[1:])) and curve[-1] < curve[0]


def test_match_reaches_the_target():
    target = {"mean_b": 120.0, "mean_g": 125.0, "mean_r": 130.0, "std_b": 20.0, "std_g": 21.0, "std_r": 22.0}
    got = K.appearance(K.match(IMG, target))
    assert all(got[k] == pytest.approx(v, abs=0.05) for k, v in target.items())
    assert K.draw([1.0, 2.0, 3.0], np.random.default_rng(0)) == pytest.approx(1 + 2 * np.random.default_rng(0).random())


def test_measuring_scale_and_boxes():
    assert K.measured(np.ones((720, 1280))).shape == (360, 640) and K.measured(np.ones((30, 40))).shape == (360, 480)
    gray = np.zeros((10, 10))
    gray[:, 5:] = 10
    assert K.box_std(gray, [(0, 0, 5, 5), (0, 0, 10, 10), (3, 3, 3, 9)]) == [0.0, 5.0, 0.0]


def test_stage_does_not_depend_on_partitions(spark):
    rows = [(i, f"n{i}", ["fog", "night", "rain", "snow"][i % 4], 40, 48, bytearray(IMG.tobytes())) for i in range(8)]
    images = spark.createDataFrame(rows, "image_id long, name string, condition string, height int, width int, data binary")
    q = {c: {f: ([100.0, 110.0] if f.startswith("mean") else [20.0, 25.0], 0.0, 255.0) for f in ("mean_b", "std_b", "mean_g", "std_g", "mean_r", "std_r", "saturation")} for c in ("fog", "night", "rain", "snow")}
    digest = lambda n: sorted(map(repr, I.build_stage(images.repartition(n), "s5b", q).select("image_id", "seed", "attempt", F.sha2("data", 256)).collect()))
    assert digest(1) == digest(5)
    assert I.build_stage(images.limit(0), "s2").count() == 0
    black = images.withColumn("data", F.unhex(F.lit("00" * (40 * 48 * 3))))
    assert {r.attempt for r in I.build_stage(black, "s3").collect()} == {0}  # no new draws for a source that can't be used


@pytest.mark.parametrize("shape", [(16, 16), (20, 24), (64, 64)])
def test_stacks_are_measured_without_enlarging_each_image(shape, monkeypatch):
    stack = np.random.default_rng(3).integers(0, 256, (5, *shape, 3)).astype(np.uint8)
    names = K.METRICS if shape != (64, 64) else K.METRICS[:2]
    cases = [(kind, s) for kind in ("gaussian", "motion") for s in K.strengths(kind)[::5]]
    wanted = [[K.sharpness(K.blur(g, kind, s)) for g in K.gray(stack)] for kind, s in cases]
    monkeypatch.setattr(K, "measured", None)  # it enlarges one image
    for (kind, s), each in zip(cases, wanted):
        got = K.sharpness_many(K.blur_many(K.gray(stack), kind, s), names)
        assert list(got) == list(names)
        for n in names:
            assert got[n] == pytest.approx([e[n] for e in each], rel=3e-5)


def test_large_stacks_and_mixed_tables_are_measured_alike(spark):
    rng = np.random.default_rng(4)
    big = rng.integers(0, 256, (2, 40, 48, 3)).astype(np.uint8)
    assert K.sharpness_many(K.gray(big))["hf_energy_ratio"].tolist() == [K.sharpness(g)["hf_energy_ratio"] for g in K.gray(big)]
    sizes, names = [(8, 8), (40, 48), (8, 12)], ["fog", "rain", "night", "snow"]
    images = [rng.integers(0, 256, (*sizes[i % 3], 3)).astype(np.uint8) for i in range(12)]
    rows = [(i, f"n{i}", names[i % 4], *x.shape[:2], bytearray(x.tobytes())) for i, x in enumerate(images)]
    frame = spark.createDataFrame(rows, "image_id long, name string, condition string, height int, width int, data binary")
    for r in I.sharpness_stats(frame).collect():
        assert [r[n] for n in K.METRICS] == pytest.approx([K.sharpness(K.gray(images[r.image_id]))[n] for n in K.METRICS], rel=3e-5)
    for r in I.appearance_stats(frame).collect():
        assert r.luma == pytest.approx(K.appearance(images[r.image_id])["luma"], abs=1e-9) and r.condition == names[r.image_id % 4]
    grid = I.strength_grid(frame, ("normalized_laplacian",)).collect()
    assert len(grid) == 9 * 16 and {r.image_id for r in grid} == {i for i in range(12) if i % 4 != 2}
    for r in grid[::7]:
        g = K.blur(K.gray(images[r.image_id]), K.BLUR[r.condition][0], r.strength)
        assert r.normalized_laplacian == pytest.approx(K.sharpness(g)["normalized_laplacian"], rel=3e-5)
