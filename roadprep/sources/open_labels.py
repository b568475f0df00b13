"""Source label records as they come: attributes, values and geometries that no schema names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(records: DataFrame, column: str = "json") -> DataFrame:
    """records with `record`, a VARIANT of the JSON text; null where it is no JSON."""
    return records.withColumn("record", F.try_parse_json(column))


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """record: one for each JSON line; with `multi_line` for each element of an array, of which a file is one task."""
    rows = spark.read.option("singleVariantColumn", "record").json(path, multiLine=multi_line)
    return rows.select(F.explode(F.try_variant_get("record", F.lit("$"), "array<variant>")).alias("record")) if multi_line else rows


def _kind(value: Column) -> Column:
    """number, text, truth, list, object or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value), "null")
        .when(name == "STRING", "text")
        .when(name == "BOOLEAN", "truth")
        .when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "list")
        .otherwise("number")
    )


def attributes(records: DataFrame, *keep: str) -> DataFrame:
    """keep, key, kind, value: one row for each attribute of each record (`record.attributes`), whatever its name.

    Text as it is, numbers, truths, lists and objects as JSON; null for a JSON null. Records without an object there
    have no rows.
    """
    rows = records.select(*keep, F.try_variant_get("record", F.lit("$.attributes"), "variant").alias("_a"))
    rows = rows.filter(F.schema_of_variant("_a").startswith("OBJECT"))
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_a").outer()))
    kind = _kind(F.col("value"))
    return rows.select(*keep, "key", kind.alias("kind"), F.when(kind != "null", F.try_variant_get("value", F.lit("$"), "string")).alias("value"))


def attribute_profile(records: DataFrame) -> DataFrame:
    """key, kind, value, n, records_with: how often each attribute has each value, and how many records have the key."""
    counts = attributes(records).groupBy("key", "kind", "value").agg(F.count("*").alias("n"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("records_with"))
    return counts.join(keys, "key").select("key", "kind", "value", "n", "records_with")


def geometries(records: DataFrame, *keep: str) -> DataFrame:
    """keep, category, geometry: a row for each label of each record and each of its objects and lists, by name, for
    example box2d or poly2d; 'none' for a label without any."""
    label = F.explode(F.try_variant_get("record", F.lit("$.labels"), "array<variant>")).alias("_l")
    rows = records.select(*keep, label)
    parts = F.try_variant_get("_l", F.lit("$"), "map<string,variant>")
    names = F.map_keys(F.map_filter(parts, lambda k, v: F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY")))
    rows = rows.select(*keep, F.try_variant_get("_l", F.lit("$.category"), "string").alias("category"), F.array_sort(names).alias("_n"))
    return rows.select(*keep, "category", F.explode(F.when(F.size("_n") > 0, F.col("_n")).otherwise(F.array(F.lit("none")))).alias("geometry"))
