"""Queries over splits, folds, quotas and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadprep.functions.classes import CONDITIONS
from roadprep.functions.order import shuffled, with_range_rank
from roadprep.jobs.labels import index, stratum
from roadprep.jobs.registry import query, with_parts
from roadprep.operators import splits as S
from roadprep.sources.fixtures import view

N_TRAIN, N_VAL, QUOTA = 5000, 1000, 100

STRATA = with_parts("idx") + """, st AS (SELECT image_id, weather, split, coalesce(nullif(rare, ''), 'none') AS stratum FROM idx),
c AS (SELECT stratum, count(*) AS size FROM st GROUP BY stratum),
a0 AS (SELECT *, (5000 * size) // sum(size) OVER () AS f1, (5000 * size) % sum(size) OVER () AS r1, (1000 * size) // sum(size) OVER () AS f2, (1000 * size) % sum(size) OVER () AS r2 FROM c),
a1 AS (SELECT *, f1 + CASE WHEN row_number() OVER (ORDER BY r1 DESC, stratum) <= 5000 - sum(f1) OVER () THEN 1 ELSE 0 END AS t,
 f2 + CASE WHEN row_number() OVER (ORDER BY r2 DESC, stratum) <= 1000 - sum(f2) OVER () THEN 1 ELSE 0 END AS v FROM a0),
alloc AS (SELECT stratum, CAST(size AS BIGINT) AS size, CAST(least(t, size - least(v, size)) AS BIGINT) AS n_train, CAST(least(v, size) AS BIGINT) AS n_val FROM a1)
"""


def _hash(salt: str, key: str = "image_id") -> str:
    return f"sha256('42|{salt}|' || {key})"


def stratified_rows(spark, d):
    return index(spark, d).select("image_id", "weather", "split", stratum().alias("stratum"))


@query(STRATA + "SELECT * FROM alloc")
def allocate_strata(spark, d):
    """5,000 and 1,000 over the strata; the fixture's strata have room, tests cover the repair."""
    counts = stratified_rows(spark, d).groupBy("stratum").agg(F.count("*").alias("size"))
    return S.allocate_splits(counts, N_TRAIN, N_VAL).select("stratum", "size", F.col("n_train").cast("long"), F.col("n_val").cast("long"))


_TIGHT = with_parts("idx") + """, c AS (SELECT coalesce(nullif(rare, ''), 'none') AS stratum, count(*) AS size FROM idx GROUP BY 1),
n AS (SELECT sum(size) AS n, sum(size) // 3 AS v, sum(size) - sum(size) // 3 AS t FROM c),
f AS (SELECT c.*, n.*, (t * size) // n AS f1, (t * size) % n AS r1, (v * size) // n AS f2, (v * size) % n AS r2 FROM c, n),
a AS (SELECT *, f1 + CASE WHEN row_number() OVER (ORDER BY r1 DESC, stratum) <= t - sum(f1) OVER () THEN 1 ELSE 0 END AS tr, f2 + CASE WHEN row_number() OVER (ORDER BY r2 DESC, stratum) <= v - sum(f2) OVER () THEN 1 ELSE 0 END AS va FROM f),
k AS (SELECT *, least(va, size) AS v1, least(tr, size - least(va, size)) AS t1 FROM a),
rv AS (SELECT *, size - t1 - v1 AS room, greatest(0, v - sum(v1) OVER ()) AS need FROM k),
v2 AS (SELECT *, v1 + greatest(0, least(room, need - coalesce(sum(room) OVER (ORDER BY room DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS vv FROM rv),
rt AS (SELECT * EXCLUDE (room, need), size - t1 - vv AS room, greatest(0, t - sum(t1) OVER ()) AS need FROM v2),
t2 AS (SELECT *, t1 + greatest(0, least(room, need - coalesce(sum(room) OVER (ORDER BY room DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS tt FROM rt)
SELECT stratum, CAST(size AS BIGINT) AS size, CAST(tt AS BIGINT) AS n_train, CAST(vv AS BIGINT) AS n_val, tr + va > size AS over FROM t2"""


@query(_TIGHT)
def allocate_tight(spark, d):
    """All images are wanted, two thirds and one third: rounding gives some strata more than they have, and repair deals
    it out again. `over` says where."""
    counts = stratified_rows(spark, d).groupBy("stratum").agg(F.count("*").alias("size"))
    n = view(spark, d, "fx_images").count()
    plain = S.allocate(S.allocate(counts, n - n // 3, "t"), n // 3, "v").select("stratum", (F.col("t") + F.col("v") > F.col("size")).alias("over"))
    return S.allocate_splits(counts, n - n // 3, n // 3).join(plain, "stratum").select("stratum", "size", "n_train", "n_val", "over")


@query(STRATA + f""", r AS (SELECT image_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_hash('split')}, image_id) AS rk FROM st)
SELECT image_id, stratum, CASE WHEN rk <= n_val THEN 'val' WHEN rk <= n_val + n_train THEN 'train' END AS part FROM r JOIN alloc USING (stratum)""")
def stratified_split(spark, d):
    return S.stratified(index(spark, d).select("image_id", "rare_present"), "image_id", N_TRAIN, N_VAL, stratum=stratum()).select("image_id", "stratum", "part")


@query(with_parts("fx_images") + f"SELECT image_id, weather, CAST((row_number() OVER (PARTITION BY weather ORDER BY {_hash('fold')}, image_id) - 1) % 5 AS INTEGER) AS fold FROM fx_images")
def kfold(spark, d):
    return S.folds(view(spark, d, "fx_images"), "weather", "image_id").select("image_id", "weather", "fold")


@query(with_parts("fx_images") + f"SELECT image_id, weather FROM fx_images WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY weather ORDER BY {_hash('quota')}, image_id) <= 100")
def design_quota(spark, d):
    return S.quota(view(spark, d, "fx_images").filter("split = 'train'"), "weather", "image_id", QUOTA).select("image_id", "weather")


def _pool(spark, d):
    train = view(spark, d, "fx_images").filter("split = 'train'").select("image_id", "weather", "file_name")
    return train.join(design_quota(spark, d).select("image_id"), "image_id", "left_anti")


@query(with_parts("fx_images") + f"SELECT image_id, weather FROM fx_images WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY weather ORDER BY {_hash('quota')}, image_id) > 100")
def unlabeled_pool(spark, d):
    return _pool(spark, d).select("image_id", "weather")


@query(with_parts("fx_images") + "SELECT weather, file_name FROM fx_images WHERE split = 'val'")
def official_split(spark, d):
    return view(spark, d, "fx_images").filter("split = 'val'").select("weather", "file_name")


@query(with_parts("fx_images") + f"SELECT image_id, CASE WHEN row_number() OVER (ORDER BY {_hash('halves')}, image_id) <= (SELECT count(*) FROM fx_images) // 2 THEN 'A' ELSE 'B' END AS half FROM fx_images")
def ab_halves(spark, d):
    return S.blocks(view(spark, d, "fx_images"), "image_id", ["A", "B"], 42, "halves", "half", floor_first=True).select("image_id", "half")


_ASSIGN = f"""SELECT image_id, CASE ((row_number() OVER (ORDER BY {_hash('assign')}, image_id) - 1) * 4) // (SELECT count(*) FROM fx_images)
 WHEN 0 THEN 'fog' WHEN 1 THEN 'night' WHEN 2 THEN 'rain' ELSE 'snow' END AS condition FROM fx_images"""


@query(with_parts("fx_images") + _ASSIGN)
def assign_conditions(spark, d):
    return S.blocks(view(spark, d, "fx_images"), "image_id", CONDITIONS, 42, "assign", "condition").select("image_id", "condition")


@query(with_parts("fx_images") + f"""SELECT file_name, half, CAST(row_number() OVER (ORDER BY half, file_name) AS BIGINT) AS line FROM (
 SELECT file_name, CASE WHEN row_number() OVER (ORDER BY {_hash('halves')}, image_id) <= (SELECT count(*) FROM fx_images) // 2 THEN 'A' ELSE 'B' END AS half FROM fx_images)""")
def stage_manifest(spark, d):
    """The A half sorted by name, then the rendered B half sorted by name, with line numbers.

    Lines are counted inside pieces of the order with offsets, as no task may hold a half.
    """
    halves = S.blocks(view(spark, d, "fx_images"), "image_id", ["A", "B"], 42, "halves", "half", floor_first=True).select("file_name", "half")
    return with_range_rank(halves, [], [F.col("half"), F.col("file_name")], "line")


@query(with_parts("fx_images") + "SELECT weather, image_id FROM fx_images WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY weather ORDER BY image_id) <= 50")
def pool_limit(spark, d):
    """The first 50 of each condition in manifest order (a sampling operator)."""
    rows = view(spark, d, "fx_images").filter("split = 'train'").select("weather", "image_id")
    return S.first_rows(rows, "weather", [F.col("image_id")], 50)


@query(with_parts("fx_images") + f"SELECT image_id FROM fx_images ORDER BY {_hash('sample')}, image_id LIMIT 200")
def sample_k(spark, d):
    """A seeded sample of 200 records (a sampling operator)."""
    return view(spark, d, "fx_images").select("image_id").orderBy(shuffled(42, "sample", F.col("image_id")), "image_id").limit(200)


@query(with_parts("fx_images") + f""", dq AS (SELECT image_id FROM fx_images WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY weather ORDER BY {_hash('quota')}, image_id) <= 100),
pl AS (SELECT image_id FROM fx_images WHERE split = 'train' AND image_id NOT IN (SELECT image_id FROM dq) UNION ALL SELECT image_id FROM fx_images WHERE image_id % 500 = 7),
sel AS (SELECT image_id FROM dq UNION SELECT image_id FROM pl)
SELECT 'design_and_pool_overlap' AS "check", CAST(count(*) AS BIGINT) AS n, count(*) = 0 AS passed FROM (SELECT image_id FROM dq INTERSECT SELECT image_id FROM pl)
UNION ALL SELECT 'train_missing', count(*), count(*) = 0 FROM (SELECT image_id FROM fx_images WHERE split = 'train' EXCEPT SELECT image_id FROM sel)
UNION ALL SELECT 'val_used', count(*), count(*) = 0 FROM (SELECT image_id FROM sel INTERSECT SELECT image_id FROM fx_images WHERE split = 'val')""")
def leakage_audit(spark, d):
    """Whether design and pool are disjoint, together all of official train, and hold nothing of official val.

    The pool has some rows more here, so that the audit has leaks to find."""
    images = view(spark, d, "fx_images")
    design, pool = design_quota(spark, d).select("image_id"), _pool(spark, d).select("image_id").union(images.filter("image_id % 500 = 7").select("image_id"))
    train, val = images.filter("split = 'train'").select("image_id"), images.filter("split = 'val'").select("image_id")
    checks = {"design_and_pool_overlap": design.intersect(pool), "train_missing": train.exceptAll(design.union(pool)), "val_used": design.union(pool).intersect(val)}
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("passed"))
        out = one if out is None else out.union(one)
    return out
