"""Sink of a rendered stage: images, index, conditions, audit log and training manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadprep.operators.images import describe, describe_tone


def index_of(rendered: DataFrame, root: str, *keep: str) -> DataFrame:
    """source, image, label, stage, condition, ops, params, text, seed, attempt of rendered rows and `keep`; no pixels."""
    path = lambda kind, name: F.concat(F.lit(f"{root.rstrip('/')}/{kind}/"), name)
    text = F.when(F.col("stage") == "s2", describe_tone(F.col("params"))).otherwise(describe(F.col("condition"), F.col("params")))
    label = F.concat(F.regexp_replace("name", r"\.[A-Za-z]+$", ""), F.lit(".txt"))
    return rendered.select(F.col("name").alias("source"), path("images", F.col("name")).alias("image"), path("labels", label).alias("label"), "stage", "condition", F.map_keys("params").alias("ops"), "params", text.alias("text"), "seed", "attempt", *keep)


def write_stage(rendered: DataFrame, root: str, clear: DataFrame | None = None) -> None:
    """Writes a stage under `root`.

    images: rows in the layout of the image source, by stage and condition; index: Parquet by source; conditions and log:
    CSV with a header, by source; manifest: the paths of `clear` (image_path) and the rendered ones, sorted. The index
    is read from the images just written, so that nothing is rendered twice and no pixel is read for it.
    """
    rendered.write.mode("overwrite").partitionBy("stage", "condition").parquet(f"{root}/images")
    written = rendered.sparkSession.read.schema(rendered.schema).parquet(f"{root}/images")
    index_of(written.drop("data"), root).orderBy("source").write.mode("overwrite").parquet(f"{root}/index")
    _write_lists(rendered.sparkSession, root, clear)


def _write_lists(spark: SparkSession, root: str, clear: DataFrame | None) -> None:
    """Conditions, log and manifest of the index that is written."""
    index = spark.read.parquet(f"{root}/index")
    index.select("source", "condition").orderBy("source").write.mode("overwrite").csv(f"{root}/conditions", header=True)
    index.select("source", "image", "label", "stage", "condition", F.col("text").alias("ops"), "seed", "attempt").orderBy("source").write.mode("overwrite").csv(f"{root}/log", header=True)
    lines = index.select(F.lit(1).alias("part"), F.col("image").alias("image_path"))
    if clear is not None:
        lines = clear.select(F.lit(0).alias("part"), "image_path").union(lines)
    lines.orderBy("part", "image_path").select("image_path").write.mode("overwrite").text(f"{root}/manifest")


#: Ranges of names' hashes that a resumable stage is written in.
RANGES = 16
_COMMITS = "range int, images long"


def range_of(name: Column, ranges: int = RANGES) -> Column:
    """The range of an image: by the hash of its name, so that ranges are even and an image stays in its own."""
    return F.pmod(F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long"), F.lit(ranges)).cast("int")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """range, images of the ranges that are written whole; no rows before the first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], _COMMITS)
    return spark.read.schema(_COMMITS).parquet(f"{root}/commits").groupBy("range").agg(F.max("images").alias("images"))


def pending(images: DataFrame, done: DataFrame, ranges: int = RANGES) -> DataFrame:
    """images with `range`, without those of the ranges in `done` (range)."""
    return images.withColumn("range", range_of(F.col("name"), ranges)).join(F.broadcast(done.select("range")), "range", "left_anti").select(*images.columns, "range")


def resume_stage(images: DataFrame, render: Callable[[DataFrame], DataFrame], root: str, clear: DataFrame | None = None, ranges: int = RANGES, at_once: int = 4) -> None:
    """Writes a stage as `write_stage` does, in batches of `at_once` ranges, and goes on where an earlier call ended.

    `render` maps rows of images to rendered rows, each by its own name and parameters. A batch overwrites the
    partitions of its ranges only, then its index, and last appends a row for each range to `commits`: what a call that
    was ended has left of a range without that row is written again. The number of ranges must stay the same under one
    root. Conditions, log and manifest are written when all ranges are there. An empty table gives an empty stage.
    """
    spark = images.sparkSession
    rows = pending(images, committed(spark, root), ranges)
    todo = sorted(set(range(ranges)) - {r.range for r in committed(spark, root).collect()})
    for k in range(0, len(todo), at_once):
        batch = todo[k : k + at_once]
        rendered = render(rows.filter(F.col("range").isin(batch)).drop("range")).withColumn("range", range_of(F.col("name"), ranges))
        rendered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range", "stage", "condition").parquet(f"{root}/images")
        written = spark.read.schema(rendered.schema).parquet(f"{root}/images").filter(F.col("range").isin(batch)).drop("data")
        own = index_of(written, root, "range")
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(f"{root}/index")
        counts = written.groupBy("range").agg(F.count("*").alias("images"))
        every = spark.createDataFrame([(r,) for r in batch], "range int").join(counts, "range", "left")
        every.select("range", F.coalesce("images", F.lit(0)).cast("long").alias("images")).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    _write_lists(spark, root, clear)


def write_per_class(table: DataFrame, path: str) -> None:
    """The per-class table as CSV with a header, sorted by experiment, kind of evaluation, condition and class order."""
    table.orderBy("experiment", "eval", "weather", "position", "class").drop("position").write.mode("overwrite").csv(path, header=True)
