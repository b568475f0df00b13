"""Detection metrics from detections and ground truth: matching, curves, average precision, operating point.

Rules are those published with the common detection benchmarks: at each threshold a detection claims its best box, a
box keeps its most confident claimant, precision is interpolated at 101 recall levels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.functions.boxes import iou
from roadprep.functions.order import RangePieces, with_running

#: IoU thresholds in hundredths.
THRESHOLDS = list(range(50, 100, 5))
#: (image, class) groups with more truth boxes than this meet on a grid. It changes the cost, not the result.
CROWD = 64
#: Crowded groups up to which their keys are broadcast.
BROADCAST_GROUPS = 100_000
#: Sides of boxes between two levels of the grid, and a cell's side in sides of its level's smallest box.
LEVEL, CELL = 4, 8


def _overlap() -> Column:
    return iou({c: F.col(f"t_{c}") for c in "xywh"}, {c: F.col(f"d_{c}") for c in "xywh"})


def _sides(truth: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = truth.select("image_id", "class_id", "ann_idx", *(F.col(c).alias(f"t_{c}") for c in "xywh"))
    return t, detections.select("image_id", "class_id", "det_idx", "conf", *(F.col(c).alias(f"d_{c}") for c in "xywh"))


def _pairs(t: DataFrame, d: DataFrame, keys: list[str], least: float) -> DataFrame:
    near = (_overlap() >= least) & (F.least("t_w", "t_h", "d_w", "d_h") > 0)
    same = [t[k] == d[k] for k in keys]
    return t.join(d, [*same, near]).select(t["image_id"], t["class_id"], "ann_idx", "det_idx", "conf", _overlap().alias("iou"))


def _level(side: Column) -> Column:
    """The level of a side. A logarithm may be off by a bit at a level's end: it is set right by powers, which are exact."""
    k = F.floor(F.ln(side) / math.log(LEVEL)).cast("int")
    power = lambda e: F.pow(F.lit(float(LEVEL)), e)
    return F.when(power(k) > side, k - 1).when(power(k + 1) <= side, k + 1).otherwise(k)


def cells_of(truth: DataFrame, detections: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Both tables with the cells cx and cy in which they meet: one row for a truth box, some for a detection.

    A truth box has the cell of its centre on a grid whose level follows its width and height. Boxes of an IoU of `least`
    have sides within a factor of `least`, and overlap by that share of either side, so that centres are apart by
    max(1 - least, (1 / least - 1) / 2) sides of the detection at most: it asks the levels and cells within that reach,
    for 0.5 about three for each axis.
    """
    t, d = _sides(truth.filter("w > 0 AND h > 0"), detections.filter("w > 0 AND h > 0"))
    reach = max(1 - least, (1 / least - 1) / 2) * 1.000001
    power = lambda e: F.pow(F.lit(float(LEVEL)), e)

    def cell(centre: Column, level: Column) -> Column:
        return F.floor(centre / (power(level) * CELL)).cast("int")

    def own(p: str, s: str) -> Column:
        level = _level(F.col(f"t_{s}"))
        return F.struct(level.alias("level"), cell(F.col(f"t_{p}") + F.col(f"t_{s}") / 2, level).alias("cell"))

    def asked(p: str, s: str) -> Column:
        side, centre = F.col(f"d_{s}"), F.col(f"d_{p}") + F.col(f"d_{s}") / 2
        levels = F.sequence(_level(side * (least * 0.999999)), _level(side * (1.000001 / least)))
        cells = lambda k: F.sequence(cell(centre - side * reach, k), cell(centre + side * reach, k))
        return F.flatten(F.transform(levels, lambda k: F.transform(cells(k), lambda c: F.struct(k.alias("level"), c.alias("cell")))))

    t = t.select("*", own("x", "w").alias("cx"), own("y", "h").alias("cy"))
    return t, d.select("*", F.explode(asked("x", "w")).alias("cx")).select("*", F.explode(asked("y", "h")).alias("cy"))


def on_grid(truth: DataFrame, detections: DataFrame, least: float = 0.5) -> DataFrame:
    """The same pairs as `candidates`, by cells instead of whole (image, class) groups (see cells_of).

    No pair meets twice, as a truth box is in one cell, and what meets in a cell is near: crowds cost what their dense
    places cost, not the square of the image.
    """
    return _pairs(*cells_of(truth, detections, least), ["image_id", "class_id", "cx", "cy"], least)


def candidates(truth: DataFrame, detections: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of the same image and class with IoU of at least `least`: image_id, class_id, ann_idx, det_idx, conf, iou.

    An equi-join; the overlap is a condition of the join, so that no pair of boxes apart leaves it. Groups with more than
    CROWD truth boxes, where all pairs would be their square, meet on a grid. Boxes without area overlap nothing.
    """
    keys = ["image_id", "class_id"]
    crowded = truth.groupBy(*keys).count().filter(F.col("count") > CROWD).select(*keys)
    n = crowded.limit(BROADCAST_GROUPS + 1).count()
    if not n:
        return _pairs(*_sides(truth, detections), keys, least)
    crowded = F.broadcast(crowded) if n <= BROADCAST_GROUPS else crowded
    few = [x.join(crowded, keys, "left_anti") for x in (truth, detections)]
    many = [x.join(crowded, keys, "left_semi") for x in (truth, detections)]
    return _pairs(*_sides(*few), keys, least).union(on_grid(*many, least))


def hit_masks(pairs: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """image_id, class_id, det_idx, mask of the detections that are true positives somewhere: bit i for threshold i.

    A detection's best box is the same at every threshold that it reaches. Of a box's claimants in falling confidence
    one counts at the thresholds that it reaches and none before it has reached. So thresholds are no rows.
    """
    best = F.row_number().over(Window.partitionBy("image_id", "class_id", "det_idx").orderBy(F.desc("iou"), "ann_idx"))
    claims = pairs.withColumn("_r", best).filter("_r = 1")
    before = Window.partitionBy("image_id", "class_id", "ann_idx").orderBy(F.desc("conf"), "det_idx").rowsBetween(Window.unboundedPreceding, -1)
    claims = claims.withColumn("_before", F.coalesce(F.max("iou").over(before), F.lit(-1.0)))
    return claims.select("image_id", "class_id", "det_idx", _mask(thresholds).alias("mask")).filter("mask <> 0")


def _mask(thresholds: list[int]) -> Column:
    """Of a claim with its iou and `_before`, the best of the box's more confident claimants: bit i for threshold i."""
    at = [F.lit(t) / F.lit(100.0) for t in thresholds]
    bits = [F.when((F.col("iou") >= t) & (F.col("_before") < t), F.lit(1 << i)).otherwise(0) for i, t in enumerate(at)]
    return sum(bits[1:], bits[0])


def masked(truth: DataFrame, detections: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """image_id, class_id, det_idx, conf, mask of every detection: hit_masks in one pass, 0 where it hits nothing.

    Detections keep their place in a left join to the truth of their image, so that they aren't joined again to their
    masks; the class is compared inside the join, which leaves rows of one image where they lie. Images with more than
    CROWD truth boxes meet on the grid instead.
    """
    crowded = truth.groupBy("image_id").count().filter(F.col("count") > CROWD).select("image_id")
    n = crowded.limit(BROADCAST_GROUPS + 1).count()
    few, many = (truth, detections), None
    if n:
        crowded = F.broadcast(crowded) if n <= BROADCAST_GROUPS else crowded
        few, many = ([x.join(crowded, "image_id", how) for x in (truth, detections)] for how in ("left_anti", "left_semi"))
    t, d = _sides(*few)
    near = (_overlap() >= 0.5) & (F.least("t_w", "t_h", "d_w", "d_h") > 0)
    # a difference, not an equality, which would be a key of the join
    rows = d.join(t, [d["image_id"] == t["image_id"], (d["class_id"] - t["class_id"]) == 0, near], "left")
    rows = rows.select(d["image_id"], d["class_id"], "det_idx", "conf", "ann_idx", F.when(F.col("ann_idx").isNotNull(), _overlap()).alias("iou"))
    best = F.row_number().over(Window.partitionBy("image_id", "class_id", "det_idx").orderBy(F.desc("iou"), "ann_idx"))
    before = Window.partitionBy("image_id", "class_id", "ann_idx").orderBy(F.desc("conf"), "det_idx").rowsBetween(Window.unboundedPreceding, -1)
    claims = rows.withColumn("_r", best).filter("_r = 1").withColumn("_before", F.coalesce(F.max("iou").over(before), F.lit(-1.0)))
    columns = ["image_id", "class_id", "det_idx", "conf"]
    out = claims.select(*columns, _mask(thresholds).alias("mask"))
    return out if many is None else out.union(with_masks(many[1].select(*columns), hit_masks(on_grid(*many), thresholds)).select(*columns, "mask"))


def one_to_one(pairs: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """thr, image_id, class_id, det_idx of true positives."""
    each = F.filter(F.array(*(F.struct(F.lit(t).alias("thr"), F.shiftright("mask", i).bitwiseAND(1).alias("hit")) for i, t in enumerate(thresholds))), lambda x: x["hit"] == 1)
    return hit_masks(pairs, thresholds).select(F.explode(each.getField("thr")).alias("thr"), "image_id", "class_id", "det_idx")


def along_confidence(detections: DataFrame) -> RangePieces:
    """Even pieces of detections (image_id, det_idx, conf) by falling confidence."""
    return RangePieces(detections, [-F.col("conf"), F.col("image_id"), F.col("det_idx")], cluster=F.col("image_id"))


def with_masks(detections: DataFrame, hits: DataFrame) -> DataFrame:
    """detections with mask, 0 where they are true positives nowhere."""
    return detections.join(hits, ["image_id", "class_id", "det_idx"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def curve(truth: DataFrame, detections: DataFrame, groups: list[str], thresholds: list[int] = THRESHOLDS, hits: DataFrame | None = None, pieces: RangePieces | None = None) -> DataFrame:
    """One row for each detection with n, its place in its group by falling confidence, tp_<threshold>, the running true
    positives at each threshold, mask and n_truth. All thresholds are columns of one window, not rows.

    `hits` are the masks of the detections where these are counted in several groups, unless detections have them as a
    column; else they are made here. `pieces` cut the order of detections, so that a single confidence that most share is
    many tasks; they are sampled from the detections where they are not given.
    """
    rows = detections if "mask" in detections.columns else with_masks(detections, hit_masks(candidates(truth, detections), thresholds) if hits is None else hits)
    rows = rows.select("image_id", "det_idx", "class_id", "conf", "mask", *[g for g in groups if g != "class_id"])
    rows = rows.withColumns({"_one": F.lit(1), **{f"_{t}": F.shiftright("mask", i).bitwiseAND(1) for i, t in enumerate(thresholds)}})
    pieces = along_confidence(detections) if pieces is None else pieces
    out = with_running(rows, groups, pieces.of(), pieces.keys, {"_one": "n", **{f"_{t}": f"tp_{t}" for t in thresholds}})
    return out.drop("_one", *(f"_{t}" for t in thresholds)).join(truth.groupBy(*groups).agg(F.count("*").alias("n_truth")), groups)


def average_precision(curve_rows: DataFrame, truth: DataFrame, groups: list[str], thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """thr, groups, n_truth, ap: mean over 101 recall levels of the best precision at that recall or more.

    Precision is best where a true positive is added, so only those rows are looked at, and only the best precision of
    each whole per cent of recall leaves the detections' tasks: 101 rows for each group and threshold.
    """
    each = F.array(*(F.struct(F.lit(t).alias("thr"), F.col(f"tp_{t}").alias("tp"), F.shiftright("mask", i).bitwiseAND(1).alias("hit")) for i, t in enumerate(thresholds)))
    hits = curve_rows.filter("mask <> 0").select(*groups, "n", "n_truth", F.explode(F.filter(each, lambda x: x["hit"] == 1)).alias("x"))
    level = F.floor(100 * F.col("x.tp") / F.col("n_truth")).cast("int")
    best = hits.groupBy(F.col("x.thr").alias("thr"), *groups, level.alias("level")).agg(F.max(F.col("x.tp") / F.col("n")).alias("p"))
    return _interpolated(best, truth, groups, thresholds)


def _interpolated(best: DataFrame, truth: DataFrame, groups: list[str], thresholds: list[int]) -> DataFrame:
    """thr, groups, n_truth, ap from the best precision of each whole per cent of recall."""
    keys = truth.groupBy(*groups).agg(F.count("*").alias("n_truth")).withColumn("thr", F.explode(F.array(*map(F.lit, thresholds))))
    grid = keys.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(100)))).join(best, ["thr", *groups, "level"], "left")
    onward = Window.partitionBy("thr", *groups).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    envelope = grid.withColumn("p", F.coalesce(F.max("p").over(onward), F.lit(0.0)))
    return envelope.groupBy("thr", *groups).agg(F.first("n_truth").alias("n_truth"), (F.sum("p") / 101).alias("ap"))


def _cells(rows: DataFrame, groups: list[str], pieces: RangePieces, thresholds: list[int]) -> tuple[DataFrame, DataFrame]:
    """rows with the piece of confidence they lie in, and by group and piece n, tp and area: how many rows, the hits at each
    threshold, and the sum of their running number inside the piece."""
    cells = rows.select(*groups, "image_id", "det_idx", "conf", "mask", pieces.of().alias("_cell"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*groups, "_cell").schema)

    def count(key, table):
        hits = _hits(table, thresholds)
        n = len(hits)
        names = [*groups, "_cell", "n", "tp", "area"]
        left = np.arange(n, 0, -1)  # a hit counts in its row and in those after it
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), pa.array([n], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (hits.sum(0), left @ hits))], names=names)

    return cells, cells.groupBy(*groups, "_cell").applyInArrow(count, f"{kinds}, n long, tp array<long>, area array<long>")


def _hits(table: pa.Table, thresholds: list[int]) -> np.ndarray:
    """A row for each detection by falling confidence, a column for each threshold: 1 where it is a true positive."""
    order = pc.sort_indices(table, sort_keys=[("conf", "descending"), ("image_id", "ascending"), ("det_idx", "ascending")])
    return table.column("mask").take(order).to_numpy().astype(np.int64)[:, None] >> np.arange(len(thresholds)) & 1


def _before(totals: DataFrame, groups: list[str], thresholds: list[int]) -> DataFrame:
    """totals with _n and _tp: rows and hits of the group's pieces before."""
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return totals.withColumns({"_n": so_far("n"), "_tp": F.array(*(so_far(F.col("tp")[i]) for i in range(len(thresholds))))})


def precision_areas(rows: DataFrame, truth: DataFrame, groups: list[str], thresholds: list[int] = THRESHOLDS, pieces: RangePieces | None = None) -> DataFrame:
    """thr, groups, n_truth, ap as average_precision gives them on curve's rows, for rows of image_id, det_idx, conf, mask and
    groups.

    A piece of confidence of a group is sorted once in a task; running numbers never leave it, only the best precision of
    each whole per cent of recall. What lies before a piece comes from all pieces' totals. Both steps read one shuffle.
    """
    pieces = along_confidence(rows) if pieces is None else pieces
    cells, totals = _cells(rows, groups, pieces, thresholds)
    known = truth.groupBy(*groups).agg(F.count("*").alias("n_truth"))
    offsets = _before(totals, groups, thresholds).join(known, groups).select(*groups, "_cell", "_n", "_tp", "n_truth")
    names = ["thr", *groups, "level", "p"]

    def best(key, table, offset):
        out: dict[str, list] = {"thr": [], "level": [], "p": []}
        if table.num_rows and offset.num_rows:
            hits, (start, tps, n_truth) = _hits(table, thresholds), (offset.column(c)[0].as_py() for c in ("_n", "_tp", "n_truth"))
            for i, thr in enumerate(thresholds):
                at = np.flatnonzero(hits[:, i])
                tp = tps[i] + np.arange(1, len(at) + 1)
                level = 100 * tp // n_truth
                first = np.flatnonzero(np.diff(level, prepend=-1))
                if len(at):
                    out["thr"] += [thr] * len(first)
                    out["level"] += level[first].tolist()
                    out["p"] += np.maximum.reduceat(tp / (start + at + 1), first).tolist()
        n = len(out["thr"])
        columns = [pa.array(out["thr"], pa.int32()), *(pa.array([k.as_py()] * n, k.type) for k in key[:-1]), pa.array(out["level"], pa.int32()), pa.array(out["p"], pa.float64())]
        return pa.table(columns, names=names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*groups).schema)
    keys = [*groups, "_cell"]
    found = cells.groupBy(*keys).cogroup(offsets.groupBy(*keys)).applyInArrow(best, f"thr int, {kinds}, level int, p double")
    return _interpolated(found.groupBy("thr", *groups, "level").agg(F.max("p").alias("p")), truth, groups, thresholds)


def curve_ends(rows: DataFrame, truth: DataFrame, groups: list[str], thresholds: list[int] = THRESHOLDS, pieces: RangePieces | None = None) -> DataFrame:
    """thr, groups, detections, tp, fp, area: the curve's end and the sum of its running true positives, for rows as for
    precision_areas. All from the pieces' totals; groups without truth have no curve."""
    pieces = along_confidence(rows) if pieces is None else pieces
    totals = _before(_cells(rows, groups, pieces, thresholds)[1], groups, thresholds)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("thr"), F.col("tp")[i].alias("tp"), (F.col("area")[i] + F.col("_tp")[i] * F.col("n")).alias("area")) for i, t in enumerate(thresholds))))
    out = totals.select(*groups, "n", each.alias("x")).groupBy("x.thr", *groups).agg(F.sum("n").alias("detections"), F.sum("x.tp").alias("tp"), F.sum("x.area").alias("area"))
    return out.join(truth.select(*groups).distinct(), groups, "left_semi").select("thr", *groups, "detections", "tp", (F.col("detections") - F.col("tp")).alias("fp"), "area")


def operating_point(truth: DataFrame, detections: DataFrame, steps: int = 1000) -> DataFrame:
    """class_id, cut, precision, recall, f1 at the confidence step that has the best mean F1 over the classes (IoU 0.5)."""
    hits = one_to_one(candidates(truth, detections), [50]).select("image_id", "class_id", "det_idx", F.lit(1).alias("tp"))
    rows = detections.select("image_id", "class_id", "det_idx", F.floor(F.col("conf") * steps).cast("int").alias("cut")).join(hits, ["image_id", "class_id", "det_idx"], "left")
    counts = rows.groupBy("class_id", "cut").agg(F.count("tp").alias("tp"), F.count("*").alias("n"))
    classes = truth.groupBy("class_id").agg(F.count("*").alias("n_truth"))
    grid = classes.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).join(counts, ["class_id", "cut"], "left")
    above = Window.partitionBy("class_id").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumns({"tp": F.coalesce(F.sum("tp").over(above), F.lit(0)), "n": F.coalesce(F.sum("n").over(above), F.lit(0))})
    p, r = F.coalesce(F.try_divide("tp", "n"), F.lit(0.0)), F.col("tp") / F.col("n_truth")
    grid = grid.withColumns({"precision": p, "recall": r}).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    # rounded, so that sums in another order choose the same step
    best = grid.groupBy("cut").agg(F.round(F.avg("f1"), 9).alias("m")).agg(F.max(F.struct("m", -F.col("cut"))).alias("b")).select((-F.col("b")["col2"]).alias("cut"))
    return grid.join(F.broadcast(best), "cut").select("class_id", "cut", "precision", "recall", "f1")
