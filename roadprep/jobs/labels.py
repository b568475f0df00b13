"""Queries over labels: IO, projections, joins and aggregates of the conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadprep.functions.classes import CONDITIONS, UNIFIED, unified_id, unified_name
from roadprep.functions.order import stable_seed
from roadprep.jobs.registry import query, with_parts
from roadprep.operators import labels as L
from roadprep.sources.fixtures import view

def yolo(spark, d):
    return L.to_yolo(view(spark, d, "fx_annotations"), F.lit(1920), F.lit(1080))


def index(spark, d):
    return L.image_index(view(spark, d, "fx_images"), yolo(spark, d))


@query(with_parts("fx_images", "yolo", "classes") + """SELECT split, weather, class_name, CAST(count(*) AS BIGINT) AS instances
FROM yolo JOIN classes USING (class_id) JOIN fx_images USING (image_id) GROUP BY ALL""")
def class_instances(spark, d):
    """Flagship: unify, normalise, join the images and count instances by split, condition and class."""
    images = view(spark, d, "fx_images").select("image_id", "split", "weather")
    return yolo(spark, d).join(images, "image_id").groupBy("split", "weather", "class_id").agg(F.count("*").alias("instances")).select("split", "weather", unified_name(F.col("class_id")).alias("class_name"), "instances")


@query(with_parts("fx_images") + """SELECT weather, split, image_id FROM fx_images
WHERE starts_with(concat(weather, '/', file_name), 'fog/') OR starts_with(concat(weather, '/', file_name), 'rain/')""")
def coco_images(spark, d):
    """Images of the combined label file whose file name begins with a declared condition."""
    images = view(spark, d, "fx_images").withColumn("path", F.concat("weather", F.lit("/"), "file_name"))
    return images.filter(F.col("path").startswith("fog/") | F.col("path").startswith("rain/")).select("weather", "split", "image_id")


@query(with_parts("fx_images") + """SELECT file_name AS name, min(CASE image_id % 3 WHEN 0 THEN '/a/100k/' ELSE '/b/10k/' END || file_name) AS path,
CAST(min(CASE image_id % 3 WHEN 0 THEN 0 ELSE 1 END) AS INTEGER) AS priority FROM fx_images GROUP BY file_name""")
def resolve_paths(spark, d):
    images = view(spark, d, "fx_images")
    first = images.filter("image_id % 3 = 0").select(F.lit(0).alias("priority"), F.concat(F.lit("/a/100k/"), "file_name").alias("path"))
    second = images.select(F.lit(1).alias("priority"), F.concat(F.lit("/b/10k/"), "file_name").alias("path"))
    return L.first_of_roots(first.union(second))


#: Sides by which no share of a whole pixel ends in a tie of the sixth decimal: engines round ties differently.
WIDTH, HEIGHT = 1913, 1087
TEXT = with_parts("uni", "fx_images") + f""", lb AS (SELECT image_id, ann_idx, class_id, printf('%.6f', greatest(least((x + w / 2) / {WIDTH}, 1.0), 0.0)) AS cx, printf('%.6f', greatest(least((y + h / 2) / {HEIGHT}, 1.0), 0.0)) AS cy,
 printf('%.6f', greatest(least(w / {WIDTH}, 1.0), 0.0)) AS bw, printf('%.6f', greatest(least(h / {HEIGHT}, 1.0), 0.0)) AS bh FROM uni WHERE class_id IS NOT NULL AND w > 0 AND h > 0)
"""


def _text(spark, d, images=None):
    return L.label_text(L.to_yolo(view(spark, d, "fx_annotations"), F.lit(WIDTH), F.lit(HEIGHT)), images)


@query(TEXT + """SELECT i.image_id, coalesce(t, '') AS text FROM fx_images i LEFT JOIN (
 SELECT image_id, string_agg(class_id || ' ' || cx || ' ' || cy || ' ' || bw || ' ' || bh || chr(10), '' ORDER BY ann_idx) AS t FROM lb GROUP BY image_id) USING (image_id)""")
def yolo_label_text(spark, d):
    """Label text of every image, empty where it has no box."""
    return _text(spark, d, view(spark, d, "fx_images"))


@query(with_parts("uni", "classes") + """SELECT category_id, class_id, class_name, CAST(count(*) AS BIGINT) AS n FROM uni JOIN classes USING (class_id) GROUP BY ALL""")
def unify_classes(spark, d):
    return L.unify(view(spark, d, "fx_annotations")).groupBy("category_id", "class_id", "class_name").agg(F.count("*").alias("n"))


@query(with_parts("fx_images") + "SELECT image_id, file_name FROM fx_images WHERE sky = 'clear' AND timeofday = 'daytime'")
def source_filter(spark, d):
    return view(spark, d, "fx_images").filter("sky = 'clear' AND timeofday = 'daytime'").select("image_id", "file_name")


@query(with_parts("fx_annotations") + """SELECT image_id, ann_idx, x, y, (x + w) - x AS w, (y + h) - y AS h FROM fx_annotations WHERE ann_idx % 4 <> 0""")
def bdd_boxes(spark, d):
    """Corner boxes to x, y, width, height; labels without a box go."""
    corners = F.when(F.col("ann_idx") % 4 != 0, F.struct(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2")))
    nested = view(spark, d, "fx_annotations").select("image_id", "ann_idx", corners.alias("box2d")).filter("box2d IS NOT NULL")
    return nested.select("image_id", "ann_idx", F.col("box2d.x1").alias("x"), F.col("box2d.y1").alias("y"), F.expr("box2d.x2 - box2d.x1").alias("w"), F.expr("box2d.y2 - box2d.y1").alias("h"))


@query(with_parts("yolo") + "SELECT image_id, ann_idx, class_id, round(cx, 9) AS cx, round(cy, 9) AS cy, round(bw, 9) AS bw, round(bh, 9) AS bh FROM yolo")
def yolo_boxes(spark, d):
    return yolo(spark, d).select("image_id", "ann_idx", "class_id", *(F.round(c, 9).alias(c) for c in ("cx", "cy", "bw", "bh")))


@query(with_parts("yolo") + """SELECT * FROM (SELECT image_id, ann_idx, class_id,
 greatest(0, least(CAST(trunc((cx - bw / 2) * 1920) AS INTEGER), 1920)) AS x0, greatest(0, least(CAST(trunc((cy - bh / 2) * 1080) AS INTEGER), 1080)) AS y0,
 greatest(0, least(CAST(trunc((cx + bw / 2) * 1920) AS INTEGER), 1920)) AS x1, greatest(0, least(CAST(trunc((cy + bh / 2) * 1080) AS INTEGER), 1080)) AS y1 FROM yolo)
WHERE (x1 - x0) * (y1 - y0) >= 4""")
def denormalize_boxes(spark, d):
    return L.from_yolo(yolo(spark, d), 1920, 1080)


@query(TEXT + """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ann_idx) - 1 AS INTEGER) AS line_no, class_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(bw AS DOUBLE) AS bw, CAST(bh AS DOUBLE) AS bh FROM lb""")
def parse_yolo_text(spark, d):
    return L.parse_label_text(_text(spark, d))


@query(with_parts("fx_images") + "SELECT image_id, CASE WHEN image_id % 10 = 0 THEN NULL ELSE weather END AS condition FROM fx_images")
def path_condition(spark, d):
    root = F.when(F.col("image_id") % 10 == 0, F.lit("/d/other/")).otherwise(F.lit("/d/images/"))
    return view(spark, d, "fx_images").select("image_id", L.path_condition(F.concat(root, "weather", F.lit("/"), "file_name")).alias("condition"))


@query(with_parts("fx_images") + "SELECT image_id, '/d/labels/' || weather || '/' || replace(file_name, '.png', '.txt') AS label FROM fx_images")
def label_path(spark, d):
    return view(spark, d, "fx_images").select("image_id", L.label_path(F.concat(F.lit("/d/images/"), "weather", F.lit("/"), "file_name")).alias("label"))


@query(with_parts("fx_images") + """SELECT image_id, CAST(('0x' || substr(sha256(file_name || '|s3|42|' || weather), 1, 8)) AS BIGINT) AS seed FROM fx_images""")
def stable_seeds(spark, d):
    return view(spark, d, "fx_images").select("image_id", stable_seed(F.col("file_name"), F.lit("s3"), F.lit("42"), F.col("weather")).alias("seed"))


@query(with_parts("fx_images") + """SELECT split, substr(sha256(concat(CAST(count(*) AS VARCHAR), '|', CAST(CAST(sum(CAST(('0x' || substr(md5(file_name), 1, 12)) AS BIGINT)) AS HUGEINT) AS VARCHAR))), 1, 16) AS fingerprint
FROM fx_images GROUP BY split""")
def manifest_hash(spark, d):
    """Fingerprint of each split's manifest, whatever its order: hashes of the paths are added up, no list is built."""
    part = F.conv(F.substring(F.md5("file_name"), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = view(spark, d, "fx_images").groupBy("split").agg(F.count("*").cast("string").alias("n"), F.sum(part).cast("string").alias("s"))
    return sums.select("split", F.substring(F.sha2(F.concat_ws("|", "n", "s"), 256), 1, 16).alias("fingerprint"))


@query(with_parts("idx") + "SELECT image_id, weather, split, CAST(n_instances AS BIGINT) AS n_instances, rare AS rare_present FROM idx")
def image_index(spark, d):
    return index(spark, d).select("image_id", "weather", "split", "n_instances", F.array_join("rare_present", ",").alias("rare_present"))


@query(with_parts("fx_images", "fx_annotations") + "SELECT image_id, ann_idx FROM fx_annotations SEMI JOIN (SELECT image_id FROM fx_images WHERE weather = 'fog') USING (image_id)")
def annotations_of_weather(spark, d):
    fog = view(spark, d, "fx_images").filter("weather = 'fog'").select("image_id")
    return view(spark, d, "fx_annotations").join(fog, "image_id", "left_semi").select("image_id", "ann_idx")


@query(with_parts("fx_images") + "SELECT image_id, file_name FROM fx_images WHERE image_id % 7 = 0")
def missing_images(spark, d):
    """Records without an image in the inventory."""
    images = view(spark, d, "fx_images").select("image_id", "file_name")
    inventory = images.filter("image_id % 7 <> 0").select(F.concat(F.lit("/x/"), "file_name").alias("path")).select(F.element_at(F.split("path", "/"), -1).alias("file_name"))
    return images.join(inventory, "file_name", "left_anti").select("image_id", "file_name")


@query(with_parts("fx_images") + "SELECT weather, image_id FROM fx_images WHERE image_id % 5 = 0 AND image_id % 3 <> 0")
def orphan_labels(spark, d):
    """Labels whose stem has no image, the image's suffix in any case."""
    images = view(spark, d, "fx_images")
    stem = lambda c: F.regexp_replace(c, r"(?i)\.(jpg|jpeg|png|txt)$", "")
    labels = images.filter("image_id % 5 = 0").select("weather", "image_id", stem(F.regexp_replace("file_name", "png$", "txt")).alias("stem"))
    there = images.filter("image_id % 3 = 0").select("weather", stem(F.upper("file_name")).alias("s")).select("weather", F.lower("s").alias("stem"))
    return labels.join(there, ["weather", "stem"], "left_anti").select("weather", "image_id")


@query(with_parts("fx_images") + """SELECT file_name FROM (SELECT file_name FROM fx_images WHERE split = 'train' UNION SELECT file_name FROM fx_images WHERE sky = 'clear')
EXCEPT SELECT file_name FROM fx_images WHERE image_id % 4 = 0""")
def copy_plan(spark, d):
    """Names in either manifest that are not there yet."""
    images = view(spark, d, "fx_images")
    wanted = images.filter("split = 'train'").select("file_name").union(images.filter("sky = 'clear'").select("file_name")).distinct()
    return wanted.join(images.filter("image_id % 4 = 0").select("file_name"), "file_name", "left_anti")


@query(with_parts("yolo", "classes") + """SELECT image_id, CAST(count(*) AS BIGINT) AS n_instances, string_agg(class_name || '=' || n, ',' ORDER BY class_id) AS counts FROM (
 SELECT image_id, class_id, class_name, count(*) AS n FROM yolo JOIN classes USING (class_id) GROUP BY ALL) JOIN (SELECT image_id FROM yolo) USING (image_id) GROUP BY image_id""".replace("SELECT image_id, CAST(count(*) AS BIGINT) AS n_instances", "SELECT image_id, CAST(sum(n) AS BIGINT) AS n_instances").replace(" JOIN (SELECT image_id FROM yolo) USING (image_id)", ""))
def image_class_counts(spark, d):
    entries = F.transform(F.map_entries("class_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return L.class_counts(yolo(spark, d)).select("image_id", "n_instances", F.array_join(entries, ",").alias("counts"))


@query(with_parts("idx") + "SELECT rare AS rare_present, CAST(count(*) AS BIGINT) AS images FROM idx GROUP BY rare")
def rare_presence(spark, d):
    return index(spark, d).groupBy(F.array_join("rare_present", ",").alias("rare_present")).agg(F.count("*").alias("images"))


@query(with_parts("fx_images", "yolo", "classes") + """SELECT split, class_id, class_name, CAST(count(image_id) AS BIGINT) AS instances
FROM (SELECT DISTINCT split FROM fx_images) CROSS JOIN classes LEFT JOIN (SELECT image_id, class_id, split FROM yolo JOIN fx_images USING (image_id)) USING (split, class_id) GROUP BY ALL""")
def split_class_instances(spark, d):
    """Instances of every class in every split, 0 where there are none, in canonical order."""
    counts = index(spark, d).groupBy("split").agg(*(F.coalesce(F.sum(F.coalesce(F.element_at("class_counts", F.lit(n)), F.lit(0))), F.lit(0)).alias(n) for n in UNIFIED))
    long = counts.unpivot("split", UNIFIED, "class_name", "instances")
    return long.select("split", (F.array_position(F.array(*map(F.lit, UNIFIED)), F.col("class_name")) - 1).cast("int").alias("class_id"), "class_name", F.col("instances").cast("long").alias("instances"))


@query(with_parts("idx") + "SELECT coalesce(nullif(rare, ''), 'none') AS stratum, CAST(count(*) AS BIGINT) AS images FROM idx GROUP BY 1")
def strata_counts(spark, d):
    return index(spark, d).groupBy(stratum().alias("stratum")).agg(F.count("*").alias("images"))


def stratum():
    return F.coalesce(F.nullif(F.array_join("rare_present", ","), F.lit("")), F.lit("none"))


@query(with_parts("idx") + """SELECT split, CASE WHEN GROUPING(weather) = 0 THEN 'weather' WHEN GROUPING(stratum) = 0 THEN 'stratum' ELSE 'all' END AS dimension,
 coalesce(weather, stratum, 'all') AS key, CAST(count(*) AS BIGINT) AS images, CAST(sum(n_instances) AS BIGINT) AS instances
FROM (SELECT *, coalesce(nullif(rare, ''), 'none') AS stratum FROM idx) GROUP BY GROUPING SETS ((split), (split, weather), (split, stratum))""")
def split_distribution(spark, d):
    """The whole distribution log in one pass: totals, conditions and strata of each split."""
    rows = index(spark, d).select("split", "weather", stratum().alias("stratum"), "n_instances")
    out = rows.groupingSets([["split"], ["split", "weather"], ["split", "stratum"]], "split", "weather", "stratum").agg(F.count("*").alias("images"), F.sum("n_instances").alias("instances"))
    return out.select("split", F.when(F.col("weather").isNotNull(), "weather").when(F.col("stratum").isNotNull(), "stratum").otherwise("all").alias("dimension"), F.coalesce("weather", "stratum", F.lit("all")).alias("key"), "images", "instances")


@query(with_parts("uni", "classes") + """SELECT coalesce(class_name, 'TOTAL') AS class_name, CAST(count(*) AS BIGINT) AS n,
 round(100.0 * count(*) / (SELECT count(*) FROM uni WHERE class_id IS NOT NULL), 6) AS share, (SELECT CAST(count(*) AS BIGINT) FROM uni WHERE class_id IS NULL) AS dropped
FROM uni JOIN classes USING (class_id) GROUP BY ROLLUP (class_name)""")
def category_profile(spark, d):
    """Kept classes with their share and a total, and how many boxes have no class."""
    named = view(spark, d, "fx_annotations").select(unified_name(unified_id(F.col("category_id"))).alias("class_name"))
    counts = named.groupBy("class_name").agg(F.count("*").alias("n"))  # at most one row for each class and one without
    totals = counts.agg(F.sum(F.when(F.col("class_name").isNotNull(), F.col("n"))).alias("all"), F.coalesce(F.sum(F.when(F.col("class_name").isNull(), F.col("n"))), F.lit(0)).alias("dropped"))
    rows = counts.filter("class_name IS NOT NULL").rollup("class_name").agg(F.sum("n").alias("n"))
    return rows.join(F.broadcast(totals)).select(F.coalesce("class_name", F.lit("TOTAL")).alias("class_name"), "n", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 6).alias("share"), "dropped")


@query(with_parts("fx_images") + """SELECT attribute, value, CAST(count(*) AS BIGINT) AS n FROM (SELECT sky, timeofday, weather FROM fx_images) UNPIVOT (value FOR attribute IN (sky, timeofday, weather)) GROUP BY ALL""")
def attribute_counts(spark, d):
    rows = view(spark, d, "fx_images").select(F.explode(F.create_map(F.lit("sky"), "sky", F.lit("timeofday"), "timeofday", F.lit("weather"), "weather")).alias("attribute", "value"))
    return rows.groupBy("attribute", "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "attribute", "value")


@query(with_parts("fx_annotations") + """SELECT CASE WHEN ann_idx % 4 = 0 THEN 'none' WHEN ann_idx % 4 = 3 THEN 'poly2d' ELSE 'box2d' END AS kind, category_id, CAST(count(*) AS BIGINT) AS n FROM fx_annotations GROUP BY ALL""")
def geometry_profile(spark, d):
    rows = view(spark, d, "fx_annotations").select("category_id", F.when(F.expr("ann_idx % 4 IN (1, 2)"), F.col("x")).alias("box2d"), F.when(F.expr("ann_idx % 4 = 3"), F.col("x")).alias("poly2d"))
    kind = F.when(F.col("box2d").isNotNull(), "box2d").when(F.col("poly2d").isNotNull(), "poly2d").otherwise("none")
    return rows.groupBy(kind.alias("kind"), "category_id").agg(F.count("*").alias("n"))


def _line(class_id: str, cx: str = "cx") -> str:
    return f"string_agg({class_id} || ' ' || {cx} || ' ' || cy || ' ' || bw || ' ' || bh || chr(10), '' ORDER BY ann_idx)"


@query(TEXT + f""", tx AS (SELECT image_id, sha256({_line("class_id")}) AS a, sha256({_line("CASE WHEN image_id % 11 = 0 THEN class_id + 1 ELSE class_id END", "CASE WHEN image_id % 17 = 3 AND ann_idx = 1 THEN '0.5' ELSE cx END")}) AS b FROM lb GROUP BY image_id)
SELECT weather, CAST(count(*) AS BIGINT) AS labels, CAST(count(*) FILTER (a <> b) AS BIGINT) AS changed FROM tx JOIN fx_images USING (image_id) GROUP BY weather""")
def label_invariance(spark, d):
    """Label files of a rendered stage against those of its source, by the hash of their text: some have another class,
    some another first number."""
    source = _text(spark, d).select("image_id", F.sha2("text", 256).alias("a"))
    boxes = L.to_yolo(view(spark, d, "fx_annotations"), F.lit(WIDTH), F.lit(HEIGHT))
    other = L.label_text(boxes.withColumn("class_id", F.col("class_id") + (F.col("image_id") % 11 == 0).cast("int")))
    first = F.regexp_replace("text", r"^(\d+) [0-9.]+", "$1 0.5")
    # the first line is box 1's unless that box has no label
    has_first = boxes.filter("ann_idx = 1 AND image_id % 17 = 3").select("image_id", F.lit(True).alias("first"))
    other = other.join(has_first, "image_id", "left").select("image_id", F.sha2(F.when(F.col("first"), first).otherwise(F.col("text")), 256).alias("b"))
    images = view(spark, d, "fx_images").select("image_id", "weather")
    return source.join(other, "image_id").join(images, "image_id").groupBy("weather").agg(F.count("*").alias("labels"), F.count_if(F.col("a") != F.col("b")).alias("changed"))
