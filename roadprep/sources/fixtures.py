"""Views of the given star-schema tables in the shapes of detection data: images, boxes, detections, reports, pixels.

The SQL is portable; FX holds each view's text, `view` builds it as a DataFrame over Parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FX: dict[str, str] = {
    "fx_images": """
SELECT o_orderkey AS image_id,
 CASE o_custkey % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS weather,
 CASE WHEN o_orderstatus = 'F' THEN 'val' ELSE 'train' END AS split,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'clear' ELSE 'overcast' END AS sky,
 CASE WHEN o_orderstatus = 'P' THEN 'night' ELSE 'daytime' END AS timeofday,
 1920 AS width, 1080 AS height,
 concat('img_', CAST(o_orderkey AS VARCHAR(20)), '.png') AS file_name
FROM orders""",
    "fx_annotations": """
SELECT l_orderkey AS image_id,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ann_idx,
 CASE WHEN l_partkey % 10 < 6 THEN 26
      ELSE CASE l_partkey % 8 WHEN 0 THEN 24 WHEN 1 THEN 25 WHEN 2 THEN 26 WHEN 3 THEN 27
                              WHEN 4 THEN 28 WHEN 5 THEN 31 WHEN 6 THEN 32 ELSE 33 END END AS category_id,
 CAST((l_partkey * 7) % 1950 AS DOUBLE) AS x,
 CAST((l_suppkey * 11 + l_partkey) % 1000 AS DOUBLE) AS y,
 CAST(l_quantity AS DOUBLE) * 4 - 8 AS w,
 CAST(l_linenumber * 15 AS DOUBLE) AS h
FROM lineitem""",
    "fx_detections": """
SELECT image_id, ann_idx AS det_idx, category_id,
 x + CAST((image_id * 3 + ann_idx * 5) % 9 - 4 AS DOUBLE) AS x,
 y + CAST((image_id * 7 + ann_idx * 3) % 7 - 3 AS DOUBLE) AS y,
 w, h,
 CAST((image_id * 7919 + ann_idx * 104729) % 100003 AS DOUBLE) / CAST(100003.0 AS DOUBLE) AS conf
FROM fx_annotations WHERE w > 0 AND (image_id + ann_idx) % 5 <> 0
UNION ALL
SELECT image_id, ann_idx + 1000, category_id, CAST((x + 400) AS DOUBLE), y, w, h,
 CAST((image_id * 6151 + ann_idx * 50021) % 100003 AS DOUBLE) / CAST(200006.0 AS DOUBLE)
FROM fx_annotations WHERE w > 0 AND (image_id + ann_idx) % 7 = 0""",
    "fx_reports": """
SELECT concat('exp_', event_type, CASE WHEN user_id % 6 = 5 THEN '_official' ELSE concat('_fold', CAST(user_id % 6 AS VARCHAR(4))) END) AS run,
 CASE event_id % 4 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS weather,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value
FROM events""",
    "fx_cells": """
SELECT concat('exp_', event_type, CASE WHEN user_id % 7 = 6 THEN '' WHEN user_id % 7 = 5 THEN '_official' ELSE concat('_fold', CAST(user_id % 7 AS VARCHAR(4))) END) AS run,
 CASE event_id % 5 WHEN 0 THEN 'overall' WHEN 1 THEN 'fog' WHEN 2 THEN 'night' WHEN 3 THEN 'rain' ELSE 'snow' END AS weather,
 CASE CAST(floor(event_id / 5.0) AS BIGINT) % 8 WHEN 0 THEN 'bicycle' WHEN 1 THEN 'bus' WHEN 2 THEN 'car' WHEN 3 THEN 'person' WHEN 4 THEN 'rider' WHEN 5 THEN 'truck' WHEN 6 THEN 'van' ELSE 'animal' END AS class,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS value
FROM events""",
    "fx_log": """
SELECT concat('exp_', event_type) AS run, CAST(event_id % 40 + 1 AS INTEGER) AS epoch, 'mAP50' AS metric, value FROM events""",
}
#: Pixel view: 64 components of a vector as gray values of an 8 x 8 image. The lambda is written per engine.
PIXELS_DUCKDB = """
SELECT vec_id AS image_id, label, list_transform(embedding, lambda v: CAST(floor(greatest(0.0, least(255.0,
  (CAST(v AS DOUBLE) + 0.6) / 1.2 * 255.0))) AS INTEGER)) AS px FROM embeddings"""

_BASE = {"fx_images": "orders", "fx_annotations": "lineitem", "fx_reports": "events", "fx_cells": "events", "fx_log": "events"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view by name, `pixels` included."""
    if name == "pixels":
        scaled = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + F.lit(0.6)) / F.lit(1.2) * F.lit(255.0)))).cast("int")
        return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.transform("embedding", scaled).alias("px"))
    if name == "fx_detections":
        return spark.sql(FX[name].replace("fx_annotations", "{src}"), src=view(spark, sf_dir, "fx_annotations"))
    base = _BASE[name]
    return spark.sql(FX[name].replace(f"FROM {base}", "FROM {src}"), src=table(spark, sf_dir, base))
