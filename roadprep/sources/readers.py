"""Readers and writers with explicit schemas: label files, images, manifests, reports, training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COCO = (
    "images ARRAY<STRUCT<id BIGINT, file_name STRING, width INT, height INT>>, "
    "annotations ARRAY<STRUCT<image_id BIGINT, category_id INT, bbox ARRAY<DOUBLE>>>, "
    "categories ARRAY<STRUCT<id INT, name STRING>>"
)
SOURCE = (
    "name STRING, attributes STRUCT<weather STRING, scene STRING, timeofday STRING>, "
    "labels ARRAY<STRUCT<category STRING, box2d STRUCT<x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE>, poly2d STRING>>"
)
_BLOCK = "precision DOUBLE, recall DOUBLE, mAP50 DOUBLE, `mAP50-95` DOUBLE"
_FULL = f"{_BLOCK}, per_class MAP<STRING, STRUCT<{_BLOCK.replace(' DOUBLE', ': DOUBLE')}>>"
REPORT = f"run STRING, overall STRUCT<{_FULL}>, per_weather MAP<STRING, STRUCT<images BIGINT, {_FULL}>>"


def coco_images(spark: SparkSession, path: str, condition: str | None = None) -> DataFrame:
    """label_file, image_id, file_name, width, height. Ids are unique within a file only: the key is both.

    With a condition, images of a combined file that don't lie under `<condition>/` are left out before any union.
    """
    rows = spark.read.schema(COCO).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("label_file"), F.inline("images"))
    rows = rows.withColumnRenamed("id", "image_id")
    return rows.filter(F.col("file_name").startswith(f"{condition}/")) if condition else rows


def coco_annotations(spark: SparkSession, path: str) -> DataFrame:
    """label_file, image_id, category_id, x, y, w, h; rows without a whole box go."""
    rows = spark.read.schema(COCO).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("label_file"), F.inline("annotations"))
    box = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")]
    return rows.select("label_file", "image_id", "category_id", *box).dropna(subset=list("xywh"))


def source_labels(spark: SparkSession, path: str) -> DataFrame:
    """Source records, a JSON array or lines. A multi-line file is one task: convert it to Parquet once."""
    return spark.read.schema(SOURCE).json(path, multiLine=True)


def source_boxes(records: DataFrame) -> DataFrame:
    """name, category, x, y, w, h of the labels with a box."""
    rows = records.select("name", F.explode("labels").alias("l")).filter("l.box2d IS NOT NULL")
    return rows.select("name", "l.category", F.col("l.box2d.x1").alias("x"), F.col("l.box2d.y1").alias("y"), F.expr("l.box2d.x2 - l.box2d.x1").alias("w"), F.expr("l.box2d.y2 - l.box2d.y1").alias("h"))


def images(spark: SparkSession, path: str, skip_bad: bool = False) -> DataFrame:
    """name, height, width, data (row-major BGR) of three-channel images. An image that can't be read gives an empty
    row, or none with `skip_bad`."""
    rows = spark.read.format("image").option("dropInvalid", skip_bad).option("recursiveFileLookup", True).load(path).select("image.*")
    return rows.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "height", "width", "data")


def inventory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """priority, path of all files under each root; contents are not read."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", True).load(r).select(F.lit(i).alias("priority"), "path") for i, r in enumerate(roots)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """image_path of each line that is not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("image_path")).filter("image_path <> ''")


def write_manifest(rows: DataFrame, path: str, column: str = "image_path") -> None:
    rows.select(column).orderBy(column).write.mode("overwrite").text(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports: files without `run` and `overall` are not reports; of one run in several files all stay."""
    return spark.read.schema(REPORT).json(path, multiLine=True).filter("run IS NOT NULL AND overall IS NOT NULL")


def report_facts(rows: DataFrame) -> DataFrame:
    """run, weather ('all' for overall), class, metric, value: one row for each number, missing ones are absent."""
    metrics = ["precision", "recall", "mAP50", "mAP50-95"]
    scopes = rows.select("run", F.lit("all").alias("weather"), F.col("overall.per_class").alias("pc")).union(rows.select("run", F.explode("per_weather").alias("weather", "b")).select("run", "weather", "b.per_class"))
    cells = scopes.select("run", "weather", F.explode("pc").alias("class", "m"))
    return cells.select("run", "weather", "class", *(F.col("m").getField(m).alias(m) for m in metrics)).unpivot(["run", "weather", "class"], metrics, "metric", "value").dropna(subset=["value"])


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """epoch, metric, value of a CSV log; header white space goes, cells that are no numbers are skipped."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.toDF(*(c.strip() for c in rows.columns))
    others = [c for c in rows.columns if c != "epoch"]
    long = rows.select(F.expr("try_cast(epoch AS INT)").alias("epoch"), *(F.col(f"`{c}`") for c in others)).unpivot(["epoch"], others, "metric", "text")
    return long.select("epoch", "metric", F.expr("try_cast(text AS DOUBLE)").alias("value")).dropna()
