import json

from roadprep.sources import readers as R


def test_label_files(spark, tmp_path):
    for name in ("a", "b"):
        images = [{"id": 1, "file_name": "fog/1.png", "width": 10, "height": 5}, {"id": 2, "file_name": "rain/2.png", "width": 10, "height": 5}]
        boxes = [{"image_id": 1, "category_id": 26, "bbox": [1, 2, 3, 4]}, {"image_id": 2, "category_id": 24, "bbox": [1]}]
        (tmp_path / f"{name}.json").write_text(json.dumps({"images": images, "annotations": boxes, "categories": []}, indent=1))
    assert R.coco_images(spark, str(tmp_path)).count() == 4
    fog = R.coco_images(spark, str(tmp_path), "fog").collect()
    assert len({r.label_file for r in fog}) == 2 and {r.image_id for r in fog} == {1}
    assert [(r.x, r.h) for r in R.coco_annotations(spark, str(tmp_path / "a.json")).collect()] == [(1.0, 4.0)]


def test_source_labels(spark, tmp_path):
    rows = [{"name": "x", "attributes": {"weather": "clear"}, "labels": [{"category": "car", "box2d": {"x1": 1, "y1": 2, "x2": 4, "y2": 8}}, {"category": "lane", "poly2d": [[1]]}]}, {"name": "y", "labels": []}, {"name": "z"}]
    (tmp_path / "s.json").write_text(json.dumps(rows))
    records = R.source_labels(spark, str(tmp_path / "s.json"))
    assert records.count() == 3
    assert [(r.name, r.category, r.w, r.h) for r in R.source_boxes(records).collect()] == [("x", "car", 3.0, 6.0)]


def test_manifest_and_inventory(spark, tmp_path):
    (tmp_path / "m.txt").write_text("  a/1.png \n\n b/2.png\n")
    assert [r.image_path for r in R.manifest(spark, str(tmp_path / "m.txt")).collect()] == ["a/1.png", "b/2.png"]
    R.write_manifest(R.manifest(spark, str(tmp_path / "m.txt")), str(tmp_path / "out"))
    assert R.manifest(spark, str(tmp_path / "out")).count() == 2
    assert R.inventory(spark, [str(tmp_path / "out"), str(tmp_path)]).filter("priority = 1").count() >= 1


def test_reports_and_logs(spark, tmp_path):
    block = {"precision": 0.5, "recall": 0.4, "mAP50": 0.3, "mAP50-95": 0.2}
    report = {"run": "s_fold0", "overall": {**block, "per_class": {"car": block}}, "per_weather": {"fog": {"images": 3, **block, "per_class": {"car": block, "bus": {"recall": 0.1}}}}}
    (tmp_path / "r.json").write_text(json.dumps(report))
    (tmp_path / "other.json").write_text('{"x": 1}')
    rows = R.reports(spark, str(tmp_path / "*.json"))
    assert rows.count() == 1
    facts = {(r.weather, r["class"], r.metric): r.value for r in R.report_facts(rows).collect()}
    assert facts["fog", "bus", "recall"] == 0.1 and ("fog", "bus", "mAP50") not in facts and len(facts) == 9
    (tmp_path / "log.csv").write_text("epoch,   train/loss,  metrics/mAP50(B)\n1, 0.5, x\n2, 0.4, 0.3\n")
    log = {(r.epoch, r.metric): r.value for r in R.training_log(spark, str(tmp_path / "log.csv")).collect()}
    assert log == {(1, "train/loss"): 0.5, (2, "train/loss"): 0.4, (2, "metrics/mAP50(B)"): 0.3}
