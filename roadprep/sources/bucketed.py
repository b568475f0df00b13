"""Image and label tables that lie together: both bucketed and sorted by image id, joined without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, name: str, buckets: int, key: str = "image_id") -> None:
    """Writes the table `name`, hashed by the key into `buckets` files (or as many groups of them), each sorted by it.

    Rows are dealt by the key first, so that each bucket is one file. Tables with one number of buckets join on the key,
    and group by it, where they lie: pixels are read by the task that needs them and move nowhere.
    """
    rows.repartition(buckets, F.col(key)).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def buckets_of(spark: SparkSession, name: str) -> int | None:
    """The number of buckets of a table; null if it has none."""
    found = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").select("data_type").first()
    return int(found[0]) if found else None


def together(spark: SparkSession, images: str, labels: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, after a check that they are bucketed alike: else a join would shuffle the pixels, silently."""
    a, b = buckets_of(spark, images), buckets_of(spark, labels)
    if a is None or a != b:
        raise ValueError(f"{images} has {a} buckets and {labels} has {b}: write both with one number of them")
    return spark.table(images), spark.table(labels)
