"""Jobs over image tables (image_id, name, condition, height, width, data): pixels are read and rendered in place.

Each job is a map over rows: pixels are never shuffled; what leaves it is rows of numbers, or rendered rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadprep.operators import kernels as K
from roadprep.operators.stats import quantiles


def pixels(row) -> np.ndarray:
    return np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, 3)


def _map(images: DataFrame, make, schema: str) -> DataFrame:
    def run(frames):
        for frame in frames:
            rows = [out for row in frame.itertuples(index=False) for out in make(row)]
            yield pd.DataFrame(rows, columns=[c.strip().split()[0] for c in schema.replace("map<string,double>", "map").split(",")])

    return images.mapInPandas(run, schema)


#: Bytes of images that are worked on at once.
STACK_BYTES = 1 << 20


def _map_stacks(images: DataFrame, make, schema: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows from stacks of images of one size (and of one value of each column of `by`): make(rows, stack) gives frames."""

    def run(frames):
        for frame in frames:
            for _, rows in frame.groupby(["height", "width", *by], sort=False):
                h, w = int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
                n = max(1, STACK_BYTES // (3 * h * w))
                for i in range(0, len(rows), n):
                    part = rows.iloc[i : i + n]
                    yield from make(part, np.frombuffer(b"".join(part["data"]), np.uint8).reshape(-1, h, w, 3))

    return images.mapInPandas(run, schema)


def plans(images: DataFrame, stage: str, seed: int = 42) -> DataFrame:
    """image_id, condition, seed, params: parameter plans from names and sizes alone; `images` needs no pixels."""

    def make(row):
        parts = (row.name, stage, seed) if stage == "s2" else (row.name, stage, seed, row.condition)
        number = K.seed_of(*parts)
        rng = np.random.default_rng(number)
        yield row.image_id, row.condition, number, K.tone_plan(rng) if stage == "s2" else K.weather_plan(rng, row.condition, row.height, row.width)

    return _map(images, make, "image_id long, condition string, seed long, params map<string,double>")


def appearance_stats(images: DataFrame) -> DataFrame:
    names = ["mean_b", "mean_g", "mean_r", "std_b", "std_g", "std_r", "saturation", "luma"]

    def make(rows, stack):
        stats = K.appearance_many(stack)
        yield rows[["image_id", "condition"]].assign(**{n: stats[n] for n in names})

    return _map_stacks(images, make, "image_id long, condition string, " + ", ".join(f"{n} double" for n in names))


def sharpness_stats(images: DataFrame, metrics: tuple[str, ...] = K.METRICS) -> DataFrame:
    def make(rows, stack):
        yield rows[["image_id", "condition"]].assign(**K.sharpness_many(K.gray(stack), metrics))

    return _map_stacks(images, make, "image_id long, condition string, " + ", ".join(f"{n} double" for n in metrics))


def strength_grid(images: DataFrame, metrics: tuple[str, ...] = K.METRICS) -> DataFrame:
    """Sharpness of every image at each strength of its condition's blur: decoded once, a row for each strength."""

    def make(rows, stack):
        kind = K.BLUR[rows["condition"].iloc[0]][0]
        if kind != "none":
            grays = K.gray(stack)
            for s in K.strengths(kind):
                yield rows[["image_id", "condition"]].assign(strength=s, **K.sharpness_many(K.blur_many(grays, kind, s), metrics))

    return _map_stacks(images, make, "image_id long, condition string, strength double, " + ", ".join(f"{n} double" for n in metrics), ("condition",))


def box_contrast(images: DataFrame, labels: DataFrame, least_area: int = 4) -> DataFrame:
    """image_id, ann_idx, std of the gray pixels in each box of `labels` (image_id, ann_idx, cx, cy, bw, bh as shares).

    Corners are cut to the image and to whole pixels; boxes under `least_area` pixels go. A row of boxes for each image
    (one image's labels) is joined to it. Tables that are bucketed alike by image_id (sources.bucketed) are joined where
    they lie; else Spark broadcasts the boxes below its threshold and shuffles the pixels above it.
    """
    boxes = labels.groupBy("image_id").agg(F.collect_list(F.struct("ann_idx", "cx", "cy", "bw", "bh")).alias("boxes"))

    def make(row):
        gray = K.gray(pixels(row))
        h, w = gray.shape
        for ann_idx, cx, cy, bw, bh in ((b["ann_idx"], b["cx"], b["cy"], b["bw"], b["bh"]) for b in row.boxes):
            x0, y0 = max(0, int((cx - bw / 2) * w)), max(0, int((cy - bh / 2) * h))
            x1, y1 = min(w, int((cx + bw / 2) * w)), min(h, int((cy + bh / 2) * h))
            if x1 > x0 and y1 > y0 and (x1 - x0) * (y1 - y0) >= least_area:
                yield row.image_id, ann_idx, K.box_std(gray, [(x0, y0, x1, y1)])[0]

    return _map(images.join(boxes, "image_id"), make, "image_id long, ann_idx int, std double")


def visibility(before: DataFrame, after: DataFrame, least_std: float = 1.0, faint: float = 0.3) -> DataFrame:
    """condition, boxes, faint, p05, median of the ratio of each box's contrast after rendering to that before.

    `before` and `after` as box_contrast gives them, `after` with condition; boxes with less contrast before don't count.
    """
    rows = before.filter(F.col("std") >= least_std).withColumnRenamed("std", "_b").join(after, ["image_id", "ann_idx"]).withColumn("ratio", F.col("std") / F.col("_b"))
    counts = rows.groupBy("condition").agg(F.count("*").alias("boxes"), F.avg((F.col("ratio") < faint).cast("double")).alias("faint"))
    q = quantiles(rows, ["condition"], "ratio", [0.05, 0.5], "_q")
    return counts.join(q, "condition").select("condition", "boxes", "faint", F.col("_q")[0].alias("p05"), F.col("_q")[1].alias("median"))


def _s2(img, condition, rng, targets, fractions):
    plan = K.tone_plan(rng)
    return K.tone(img, plan, rng), plan


def _s3(img, condition, rng, targets, fractions):
    plan = K.weather_plan(rng, condition, *img.shape[:2])
    return K.weather(img, condition, plan, rng), plan


def _matched(out, condition, rng, targets):
    """Channels matched to draws from the condition's summaries: {field: (quantiles, low, high)}."""
    fields = targets[condition]
    goal = {k: K.draw(fields[k][0], rng, *fields[k][1:]) for c in "bgr" for k in (f"mean_{c}", f"std_{c}")}
    K.draw(fields["saturation"][0], rng, *fields["saturation"][1:])  # drawn for the log, not matched
    return K.match(out, goal)


def _s5(img, condition, rng, targets, fractions):
    out, plan = _s3(img, condition, rng, targets, fractions)
    return _matched(out, condition, rng, targets), plan


def _s5b(img, condition, rng, targets, fractions):
    out, plan = _s3(img, condition, rng, targets, fractions)
    kind, low, high = K.BLUR[condition]
    frac = min(max(fractions.get(condition, (low + high) / 2), low), high)
    out = K.blur(out, kind, frac, plan.get("slant_deg", 77.5))
    return _matched(out, condition, rng, targets), plan | {"blur_frac": frac, "blur_px": frac * min(img.shape[:2])}


@dataclass(frozen=True)
class Stage:
    """A recipe: render(img, condition, rng, targets, fractions) gives the image as floats and its parameters. The seed
    has the condition in it if `by_condition`; a degenerate rendering of a source whose mean is `source_mean` at least
    is drawn again up to `redraws` times."""

    render: Callable
    by_condition: bool
    source_mean: float
    redraws: int


#: Stages by name; a caller may add its own.
STAGES = {"s2": Stage(_s2, False, 5.0, 6), "s3": Stage(_s3, True, 20.0, 8), "s5": Stage(_s5, True, 20.0, 8), "s5b": Stage(_s5b, True, 20.0, 8)}


def build_stage(images: DataFrame, stage: str | Stage, targets: dict | None = None, fractions: dict | None = None, seed: int = 42, name: str | None = None) -> DataFrame:
    """Rendered rows (image_id, name, condition, height, width, data) with stage, seed, attempt and params.

    A degenerate rendering is drawn again with the attempt in the seed, as long as the source is usable; the last one
    stays. `targets` (summaries by condition and field) and `fractions` hold one entry for each condition.
    """
    recipe = STAGES[stage] if isinstance(stage, str) else stage
    title = name or str(stage)

    def make(row):
        img = pixels(row)
        parts = (row.name, title, seed, row.condition) if recipe.by_condition else (row.name, title, seed)
        for attempt in range(recipe.redraws + 1):
            number = K.seed_of(*parts, *([attempt] if attempt else []))
            out, plan = recipe.render(img, row.condition, np.random.default_rng(number), targets or {}, fractions or {})
            data = np.rint(out).astype(np.uint8)
            if K.usable(data) or not K.usable(img, recipe.source_mean):
                break
        yield row.image_id, row.name, row.condition, row.height, row.width, data.tobytes(), title, number, attempt, plan

    return _map(images, make, "image_id long, name string, condition string, height int, width int, data binary, stage string, seed long, attempt int, params map<string,double>")


def blur_apply(images: DataFrame, frac: Column, kind: Column | None = None) -> DataFrame:
    """Images (same columns) blurred by their condition's kind of blur, or by `kind`, at the row's fraction `frac`."""
    kinds = kind if kind is not None else F.create_map(*(F.lit(x) for c, (k, *_) in K.BLUR.items() for x in (c, k)))[F.col("condition")]

    def make(row):
        out = K.blur(pixels(row).astype(np.float32), row.blur_kind, row.blur_frac)
        yield row.image_id, row.name, row.condition, row.height, row.width, np.rint(out.clip(0, 255)).astype(np.uint8).tobytes()

    rows = images.select("image_id", "name", "condition", "height", "width", "data", F.coalesce(kinds, F.lit("none")).alias("blur_kind"), frac.cast("double").alias("blur_frac"))
    return _map(rows, make, "image_id long, name string, condition string, height int, width int, data binary")


#: Parameters that are whole numbers, and the order of tone operations in a description.
COUNTS = ("n_streaks", "n_particles")


def describe(condition: Column, params: Column) -> Column:
    """A line for the audit log: the condition and each parameter in its order, whole numbers as such, others with four
    decimals. A tint is named and followed by its shift; a blur is the last part, with its size in pixels and as a share
    of the short side, and its angle if it has a direction."""
    number = lambda c, digits: F.format_string(f"%.{digits}f", c)
    tint = F.concat(F.when(params["tint"] > 0, "warm").otherwise("cool"), F.lit(f";tint_delta={K.TINT:.4f}"))
    value = lambda e: F.when(e["key"].isin(*COUNTS), e["value"].cast("long").cast("string")).when(e["key"] == "tint", tint).otherwise(number(e["value"], 4))
    plain = F.filter(F.map_entries(params), lambda e: ~e["key"].startswith("blur_"))
    line = F.concat_ws(";", condition, F.array_join(F.transform(plain, lambda e: F.concat_ws("=", e["key"], value(e))), ";"))
    size, share = number(params["blur_px"], 3), number(params["blur_frac"], 6)
    kind = F.create_map(*(F.lit(x) for c, (k, *_) in K.BLUR.items() for x in (c, k)))[condition]
    gaussian = F.concat(F.lit(";blur=gaussian(sigma_px="), size, F.lit(",sigma_frac="), share, F.lit(")"))
    motion = F.concat(F.lit(";blur=motion(length_px="), size, F.lit(",length_frac="), share, F.lit(",angle_deg="), number(F.coalesce(params["slant_deg"], F.lit(0.0)), 3), F.lit(")"))
    return F.concat(line, F.when(params["blur_frac"].isNull(), "").when(kind == "gaussian", gaussian).when(kind == "motion", motion).otherwise(""))


def describe_tone(params: Column) -> Column:
    """A line for the audit log of s2: the operations in the table's order with four decimals."""
    names = F.filter(F.array(*map(F.lit, K.TONE)), lambda n: F.map_contains_key(params, n))
    return F.array_join(F.transform(names, lambda n: F.format_string("%s=%.4f", n, params[n])), ";")


def scenarios(images: DataFrame, effective: DataFrame, multipliers: list[float]) -> DataFrame:
    """Images once for each multiplier of their condition's strength, with multiplier and frac; none for unblurred ones.

    `effective` (condition, kind, frac, source) has one row for each condition.
    """
    levels = effective.filter("kind <> 'none'").select("condition", "kind", F.col("frac").alias("_frac"), F.explode(F.array(*map(F.lit, multipliers))).alias("multiplier"))
    levels = levels.select("condition", "kind", "multiplier", (F.col("_frac") * F.col("multiplier")).alias("frac"))
    return images.join(levels, "condition")


def match_errors(images: DataFrame, medians: dict) -> DataFrame:
    """image_id, condition, field, error: a weather rendering matched to the medians, measured again, against the medians."""

    def make(row):
        rng = np.random.default_rng(K.seed_of("self_test", row.condition, "x"))
        img = pixels(row)
        out = K.weather(img, row.condition, K.weather_plan(rng, row.condition, *img.shape[:2]), rng)
        found = K.appearance(K.match(np.floor(out), medians[row.condition]).astype(np.uint8))
        for field, goal in medians[row.condition].items():
            yield row.image_id, row.condition, field, abs(found[field] - goal)

    return _map(images, make, "image_id long, condition string, field string, error double")
