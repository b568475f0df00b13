"""Mergeable states of summaries: a new fold, day or shard is added without reading the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.functions.classes import UNIFIED


def moments(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, n, mean, m2 (the sum of squared distances to the mean) of the non-null values; mean and m2 are 0 without any."""
    n = F.count(value)
    m2 = F.coalesce(F.var_pop(F.col(value).cast("double")), F.lit(0.0)) * n
    return values.groupBy(*groups).agg(n.alias("n"), F.coalesce(F.avg(F.col(value).cast("double")), F.lit(0.0)).alias("mean"), m2.alias("m2"))


def merged_moments(states: DataFrame, groups: list[str]) -> DataFrame:
    """The state of all values of a group from its parts' states (groups, n, mean, m2).

    Two sums as for two parts at once: distances inside the parts, and of the parts' means to the mean of all. So nothing
    large is taken from something large, as in a difference of squares.
    """
    over = Window.partitionBy(*(groups or [F.lit(0)]))
    n = F.sum("n").over(over)
    rows = states.withColumn("_mean", F.when(n > 0, F.sum(F.col("n") * F.col("mean")).over(over) / n).otherwise(0.0))
    apart = F.col("mean") - F.col("_mean")
    return rows.groupBy(*groups).agg(F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"))


def summary_of(states: DataFrame, groups: list[str]) -> DataFrame:
    """groups, mean, std, n as a fold summary of the values has them: std of a sample, 0 for one value, null without any."""
    some = F.col("n") > 0
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).when(some, 0.0)
    return states.select(*groups, F.when(some, F.col("mean")).alias("mean"), std.alias("std"), "n")


def class_vectors(labels: DataFrame, groups: list[str]) -> DataFrame:
    """groups, images, counts: boxes of each class in canonical order, as an array, of labels (image_id, class_id).

    `images` counts each image once, if an image's labels lie in one part: a part is whole images.
    """
    counts = F.array(*(F.count_if(F.col("class_id") == k) for k in range(len(UNIFIED))))
    return labels.groupBy(*groups).agg(F.count_distinct("image_id").alias("images"), counts.alias("counts"))


def merged_vectors(states: DataFrame, groups: list[str]) -> DataFrame:
    return states.groupBy(*groups).agg(F.sum("images").alias("images"), F.array(*(F.sum(F.col("counts")[k]) for k in range(len(UNIFIED)))).alias("counts"))
