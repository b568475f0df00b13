"""Box geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def valid(w: Column, h: Column, width: Column, height: Column) -> Column:
    return (w > 0) & (h > 0) & (width > 0) & (height > 0)


def normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Centre, width and height as shares of the image, each clamped to [0, 1] by itself; corners are not clipped."""
    return {"cx": unit((x + w / 2) / width), "cy": unit((y + h / 2) / height), "bw": unit(w / width), "bh": unit(h / height)}


def pixels(centre: Column, size: Column, extent: Column) -> tuple[Column, Column]:
    """First and last pixel of a normalised side: truncated, then clipped to the image."""
    clip = lambda v: F.greatest(F.lit(0), F.least(v.cast("int"), extent))
    return clip((centre - size / 2) * extent), clip((centre + size / 2) * extent)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes with x, y, w, h; 0 if they don't touch, null for two without area."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    inter = side("x", "w") * side("y", "h")
    return F.try_divide(inter, a["w"] * a["h"] + b["w"] * b["h"] - inter)
