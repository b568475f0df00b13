"""Open records, manifest trees, mergeable states, packed labels, bucketed tables, resumed stages, full reports."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_stages import frame

from roadprep.operators import images as I
from roadprep.operators import manifests as M
from roadprep.operators import states
from roadprep.operators import stats as S
from roadprep.sources import bucketed, open_labels, packed, readers, stages


def test_attributes_of_any_name_and_type(spark, tmp_path):
    rows = [{"attributes": {"a": "x", "b": 3, "deep": {"k": [1]}, "list": [1, "2"], "t": True, "none": None, "x y": 1.5}}, {"attributes": [1]}, {"other": 1}, {"attributes": {"a": "x"}}]
    texts = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "no json {"), (10, None)], "id int, json string")
    got = {(r.id, r.key, r.kind, r.value) for r in open_labels.attributes(open_labels.parsed(texts), "id").collect()}
    assert got == {(0, "a", "text", "x"), (0, "b", "number", "3"), (0, "deep", "object", '{"k":[1]}'), (0, "list", "list", '[1,"2"]'), (0, "t", "truth", "true"), (0, "none", "null", None), (0, "x y", "number", "1.5"), (3, "a", "text", "x")}
    profile = {(r.key, r.value): (r.n, r.records_with) for r in open_labels.attribute_profile(open_labels.parsed(texts)).collect()}
    assert profile["a", "x"] == (2, 2) and profile["none", None] == (1, 1)
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name, whole in (("r.json", True), ("r.jsonl", False)):
        assert open_labels.attributes(open_labels.read_records(spark, str(tmp_path / name), whole)).count() == 8


def test_geometries_of_any_name(spark):
    labels = [{"category": "car", "box2d": {"x1": 1}}, {"category": "lane", "poly2d": [[0, 1]], "graph": {}}, {"category": "sign", "id": 3}, {"box3d": {}}]
    texts = spark.createDataFrame([(json.dumps({"labels": labels}),), (json.dumps({"labels": []}),), (json.dumps({}),)], "json string")
    got = sorted((r.category or "", r.geometry) for r in open_labels.geometries(open_labels.parsed(texts)).collect())
    assert got == [("", "box3d"), ("car", "box2d"), ("lane", "graph"), ("lane", "poly2d"), ("sign", "none")]


def entries(spark, rows):
    return spark.createDataFrame(rows, "path string, size long")


def test_manifest_trees_see_swaps_repeats_and_order(spark):
    rows = [(f"/d/{i}.jpg", i % 7) for i in range(500)]
    root = lambda r, **k: M.tree(entries(spark, r), "path", ["size"], **k).filter("level = 0").collect()
    assert root(rows) == root(rows[::-1]) and root(rows)[0].n == 500
    swapped = [(rows[1][0], rows[0][1]), (rows[0][0], rows[1][1]), *rows[2:]]
    assert root(swapped) != root(rows) and root(rows + rows[:1]) != root(rows) and root(rows, depth=2) != root(rows)
    assert root([("a1", 2)]) != root([("a", 12)]) and root([(None, 1)]) != root([("", 1)])
    assert M.tree(entries(spark, []), "path", ["size"]).count() == 0


def test_manifest_difference_by_kept_trees(spark, tmp_path):
    one = [(f"/d/{i}.jpg", i) for i in range(400)] + [("/d/5.jpg", 5), ("/d/6.jpg", 60), ("/d/6.jpg", 61)]
    two = [(p, s + (s == 7)) for p, s in one if s not in (3, 60)] + [("/d/new", 1), ("/d/9.jpg", 9)]
    expected = {("/d/3.jpg", "removed"), ("/d/60.jpg", "removed"), ("/d/6.jpg", "changed"), ("/d/7.jpg", "changed"), ("/d/9.jpg", "changed"), ("/d/new", "added")}
    a, b = entries(spark, one), entries(spark, two)
    trees = []
    for name, rows in (("a", a), ("b", b)):
        M.tree(rows, "path", ["size"]).write.partitionBy("level").parquet(str(tmp_path / name))
        trees.append(spark.read.parquet(str(tmp_path / name)))
    ranges = {r.prefix for r in M.differing(*trees).collect()}
    assert 1 <= len(ranges) <= len(expected)
    for kept in (None, tuple(trees)):
        got = M.difference(a, b, "path", ["size"], kept).collect()
        assert {(r.path, r.change) for r in got} == expected and {r.range for r in got} == ranges
    assert M.difference(a, a, "path", ["size"]).isEmpty() and M.difference(entries(spark, []), entries(spark, []), "path", ["size"]).isEmpty()


def test_merged_states_equal_recomputed_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(5)), "ab"[i % 2], float(1e9 + rng.normal()) if i % 9 else None) for i in range(600)] + [(7, "c", 4.0), (8, "d", None)]
    values = spark.createDataFrame(rows, "fold int, g string, v double")
    old = states.moments(values.filter("fold < 4"), ["g", "fold"], "v")
    new = states.moments(values.filter("fold >= 4"), ["g", "fold"], "v")
    got = {r.g: r for r in states.summary_of(states.merged_moments(old.union(new), ["g"]), ["g"]).collect()}
    for g in "ab":
        v = np.array([r[2] for r in rows if r[1] == g and r[2] is not None])
        assert got[g].n == len(v) and got[g].mean == pytest.approx(v.mean(), rel=1e-12) and got[g]["std"] == pytest.approx(v.std(ddof=1), rel=1e-6)
    assert (got["c"].mean, got["c"]["std"], got["c"].n) == (4.0, 0.0, 1) and (got["d"].mean, got["d"]["std"], got["d"].n) == (None, None, 0)
    labels = spark.createDataFrame([(i, i % 3, i % 6) for i in range(60)], "image_id int, shard int, class_id int")
    merged = states.merged_vectors(states.class_vectors(labels, ["shard"]), []).first()
    assert merged.images == 60 and list(merged.counts) == [10] * 6


def test_packed_labels_round_trip(spark, tmp_path):
    texts = {f"img_{i}.txt": f"{i % 6} 0.5 0.5 0.1 0.{i}\n" * (i % 4) for i in range(60)} | {"ü.txt": "größe\n", "empty.txt": "", "none.txt": None, "open.txt": "no line feed"}
    files = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(5)
    root = str(tmp_path / "labels")
    packed.write(files, root, 3)
    assert len([f for k in range(3) for f in os.listdir(f"{root}/archives/shard={k}") if f.endswith(".txt")]) == 3
    assert {r.name: r.text for r in packed.read(spark, root).collect()} == {n: t or "" for n, t in texts.items()}
    wanted = spark.createDataFrame([("ü.txt",), ("img_7.txt",), ("other.txt",)], "name string")
    assert {r.name: r.text for r in packed.read(spark, root, wanted).collect()} == {n: texts[n] for n in ("ü.txt", "img_7.txt")}
    for r in packed.index(spark, root).limit(5).collect():
        (archive,) = [f for f in os.listdir(f"{root}/archives/shard={r.shard}") if f.endswith(".txt")]
        with open(f"{root}/archives/shard={r.shard}/{archive}", "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length).decode() == (texts[r.name] or "")
    packed.write(files.limit(0), str(tmp_path / "none"))
    assert packed.read(spark, str(tmp_path / "none")).count() == 0


def test_bucketed_tables_join_without_an_exchange(spark):
    images = frame(spark, 12)
    labels = spark.createDataFrame([(i, k, 0.5, 0.5, 0.3 + 0.1 * k, 0.5) for i in range(12) for k in range(i % 4)], "image_id long, ann_idx int, cx double, cy double, bw double, bh double")
    spark.sql("CREATE DATABASE IF NOT EXISTS together")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        bucketed.save(images, "together.images", 3)
        bucketed.save(labels, "together.labels", 3)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = I.box_contrast(*bucketed.together(spark, "together.images", "together.labels"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        expected = I.box_contrast(images, labels)
        assert "Exchange" in expected._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, expected.collect()))
        bucketed.save(labels, "together.labels", 2)
        with pytest.raises(ValueError, match="buckets"):
            bucketed.together(spark, "together.images", "together.labels")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP DATABASE together CASCADE")


def test_a_stage_resumes_where_it_was_ended(spark, tmp_path):
    images, root, seen = frame(spark, 24), str(tmp_path / "s3"), str(tmp_path / "seen")
    os.mkdir(seen)

    def ended(at):
        def draw(img, condition, rng, targets, fractions):
            made = len(os.listdir(seen))
            if made >= at:
                raise RuntimeError("lost")
            open(f"{seen}/{rng.integers(1 << 62)}", "w").close()
            return img.astype(np.float32), {"t": 0.5}

        return lambda rows: I.build_stage(rows, I.Stage(draw, True, 20.0, 0), name="x")

    whole = sorted((r.name, bytes(r.data)) for r in ended(99)(images).collect())
    for f in os.listdir(seen):
        os.remove(f"{seen}/{f}")
    sizes = {r.range: r["count"] for r in images.groupBy(stages.range_of(F.col("name"), 4).alias("range")).count().collect()}
    first = sizes.get(0, 0) + sizes.get(1, 0)
    with pytest.raises(Exception, match="lost"):
        stages.resume_stage(images, ended(first), root, ranges=4, at_once=1)
    assert {r.range: r.images for r in stages.committed(spark, root).collect()} == {0: sizes.get(0, 0), 1: sizes.get(1, 0)}
    again = len(os.listdir(seen))
    stages.resume_stage(images, ended(999), root, ranges=4, at_once=2)
    assert again == first and len(os.listdir(seen)) == 24  # each image is rendered once, those of the lost range too
    stages.resume_stage(images, ended(0), root, ranges=4)  # nothing is left to render
    made = spark.read.parquet(f"{root}/images")
    assert sorted((r.name, bytes(r.data)) for r in made.collect()) == whole
    assert spark.read.parquet(f"{root}/index").count() == 24 and spark.read.csv(f"{root}/log", header=True).count() == 24
    assert readers.manifest(spark, f"{root}/manifest").count() == 24


def test_lines_of_the_audit_log(spark):
    rows = [
        ("night", [("brightness", 0.3), ("gamma", 1.25), ("tint", 1.0), ("vignette", 0.12345)], "night;brightness=0.3000;gamma=1.2500;tint=warm;tint_delta=5.0000;vignette=0.1235"),
        ("rain", [("n_streaks", 451.0), ("slant_deg", 77.1234), ("blur_frac", 0.0055477), ("blur_px", 3.99434)], "rain;n_streaks=451;slant_deg=77.1234;blur=motion(length_px=3.994,length_frac=0.005548,angle_deg=77.123)"),
        ("fog", [("t", 0.5), ("blur_frac", 0.00136386), ("blur_px", 0.98198)], "fog;t=0.5000;blur=gaussian(sigma_px=0.982,sigma_frac=0.001364)"),
        ("snow", [("n_particles", 7.0), ("density", 0.25)], "snow;n_particles=7;density=0.2500"),
        ("night", [("tint", -1.0), ("blur_frac", 0.0), ("blur_px", 0.0)], "night;tint=cool;tint_delta=5.0000"),
    ]
    for condition, params, line in rows:
        column = F.create_map(*(F.lit(x) for p in params for x in p))
        assert spark.range(1).select(I.describe(F.lit(condition), column).alias("t")).first().t == line


def test_gate_report_and_ratios(spark):
    rows = [("ok", True, 0.2, 1.0, 0.5), ("upper", True, 0.9, 1.0, 0.5), ("sharp", True, None, 0.4, 0.5), ("rough", False, 0.2, 1.0, 0.5), ("out", True, None, 1.0, 0.5)]
    fits = spark.createDataFrame([(*r, 0.1, 0.5, 0.7) for r in rows], "condition string, monotonic boolean, strength double, base double, target double, low double, high double, fallback double")
    got = {r.condition: (r.passed, r.reason, r.in_range, r.clipped, r.base_primary, r.target_primary) for r in S.gate_report(fits).collect()}
    assert got == {"ok": (True, "ok", True, False, 1.0, 0.5), "upper": (True, "upper bound reached", True, True, 1.0, 0.5), "sharp": (False, "target sharper than base", False, False, 0.4, 0.5), "rough": (False, "curve not monotonic", True, False, 1.0, 0.5), "out": (False, "target outside the curve", False, False, 1.0, 0.5)}
    measured = spark.createDataFrame([("fog", 0.4, 0.1, 0.12)], "condition string, base_primary double, target_primary double, measured_primary double")
    r = S.closed_loop_ratios(measured, 0.2).first()
    assert (r.base_ratio, r.target_ratio, r.measured_ratio) == pytest.approx((2.0, 0.5, 0.6)) and r.abs_err == pytest.approx(0.02)
    assert S.closed_loop_ratios(measured, 0.0).first().base_ratio is None


def test_images_are_read_as_bgr_rows(spark, tmp_path):
    import struct
    import zlib

    def png(pixels):
        part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        h, w, _ = pixels.shape
        raw = b"".join(b"\x00" + row.tobytes() for row in pixels)
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    rgb = np.random.default_rng(3).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.png").write_bytes(png(rgb))
    (tmp_path / "bad.png").write_bytes(b"no image")
    rows = {r.name: r for r in readers.images(spark, str(tmp_path), skip_bad=True).collect()}
    assert set(rows) == {"a.png"} and (rows["a.png"].height, rows["a.png"].width) == (5, 7)
    assert bytes(rows["a.png"].data) == rgb[:, :, ::-1].tobytes()
    assert readers.images(spark, str(tmp_path)).count() == 2
