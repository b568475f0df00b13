"""Label conversion: unification, normalisation, per-image indexes, label text, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadprep.functions import boxes
from roadprep.functions.classes import RARE, UNIFIED, unified_id, unified_name


def unify(annotations: DataFrame) -> DataFrame:
    """Adds class_id and class_name; rows of unmapped or null categories go."""
    out = annotations.withColumn("class_id", unified_id(F.col("category_id"))).filter("class_id IS NOT NULL")
    return out.withColumn("class_name", unified_name(F.col("class_id")))


def to_yolo(annotations: DataFrame, width: Column, height: Column) -> DataFrame:
    """image_id, ann_idx, class_id, cx, cy, bw, bh of the unified boxes with positive sides."""
    known = unify(annotations).filter(boxes.valid(F.col("w"), F.col("h"), width, height))
    sides = boxes.normalised(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    return known.select("image_id", "ann_idx", "class_id", *(c.alias(n) for n, c in sides.items()))


def from_yolo(labels: DataFrame, width: int, height: int, least_area: int = 4) -> DataFrame:
    """image_id, ann_idx, class_id and whole pixels x0, y0, x1, y1; boxes under `least_area` pixels go."""
    x0, x1 = boxes.pixels(F.col("cx"), F.col("bw"), F.lit(width))
    y0, y1 = boxes.pixels(F.col("cy"), F.col("bh"), F.lit(height))
    out = labels.select("image_id", "ann_idx", "class_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return out.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area)


def class_counts(labels: DataFrame) -> DataFrame:
    """image_id, n_instances, class_counts (map of name to count), rare_present (sorted): one row for each image with boxes.

    One shuffle on the image; counts of an image's classes are columns of a partial aggregate, not collected rows.
    """
    each = [F.count_if(F.col("class_id") == k).alias(f"_{k}") for k in range(len(UNIFIED))]
    counted = labels.groupBy("image_id").agg(F.count("*").alias("n_instances"), *each)
    pairs = F.array(*(F.struct(F.lit(n).alias("k"), F.col(f"_{k}").cast("int").alias("v")) for k, n in enumerate(UNIFIED)))
    rare = F.array_compact(F.array(*(F.when(F.col(f"_{UNIFIED.index(n)}") > 0, F.lit(n)) for n in sorted(RARE))))
    return counted.select("image_id", "n_instances", F.map_from_entries(F.filter(pairs, lambda p: p["v"] > 0)).alias("class_counts"), rare.alias("rare_present"))


def image_index(images: DataFrame, labels: DataFrame) -> DataFrame:
    """All images with n_instances, class_counts and rare_present; images without boxes have 0 and empty ones."""
    out = images.join(class_counts(labels), "image_id", "left")
    return out.withColumns(
        {
            "n_instances": F.coalesce("n_instances", F.lit(0)),
            "class_counts": F.coalesce("class_counts", F.create_map().cast("map<string,int>")),
            "rare_present": F.coalesce("rare_present", F.array().cast("array<string>")),
        }
    )


def label_text(labels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """image_id and the label file's text: a line `class cx cy w h` for each box in box order, six decimals.

    With `images` (image_id) there is a row for each of them, with an empty text where it has no box. Decimals are
    rounded half up on the decimal expansion; a writer that rounds the binary value can differ in ties.
    """
    line = F.format_string("%d %.6f %.6f %.6f %.6f\n", "class_id", "cx", "cy", "bw", "bh")
    rows = labels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ann_idx", line.alias("line")))).alias("lines"))
    rows = rows.select("image_id", F.array_join(F.col("lines.line"), "").alias("text"))
    return rows if images is None else images.select("image_id").join(rows, "image_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def parse_label_text(files: DataFrame) -> DataFrame:
    """image_id, line_no, class_id, cx, cy, bw, bh of the lines with exactly five numbers."""
    lines = files.select("image_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("t", F.split(F.trim("line"), r"\s+")).filter(F.size("t") == 5)
    cols = [F.expr("try_cast(t[0] AS INT)").alias("class_id"), *(F.expr(f"try_cast(t[{i}] AS DOUBLE)").alias(n) for i, n in enumerate(("cx", "cy", "bw", "bh"), 1))]
    return lines.select("image_id", "line_no", *cols).dropna()


def path_condition(path: Column) -> Column:
    """The segment after `images`; null for another path."""
    return F.nullif(F.regexp_extract(path, "/images/([^/]+)/", 1), F.lit(""))


def label_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/images/", "/labels/"), r"\.[A-Za-z]+$", ".txt")


def first_of_roots(paths: DataFrame) -> DataFrame:
    """name and the path of the first root (smallest priority, then path) that has it."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.groupBy(name.alias("name")).agg(F.min(F.struct("priority", "path")).alias("b")).select("name", F.col("b.path").alias("path"), F.col("b.priority").alias("priority"))
