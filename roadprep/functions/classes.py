"""The unified class scheme of both label domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unified names in canonical order, the two domains' maps (a missing key is dropped), rare classes, conditions.
UNIFIED = ["person", "rider", "car", "truck", "bus", "bicycle"]
SOURCE_CLASSES = {"person": 0, "rider": 1, "car": 2, "truck": 3, "bus": 4, "bike": 5, "motor": 5}
TARGET_CLASSES = {24: 0, 25: 1, 26: 2, 27: 3, 28: 4, 32: 5, 33: 5}
RARE = ["bus", "bicycle", "rider"]
CONDITIONS = ["fog", "night", "rain", "snow"]


def unified_id(category: Column, mapping: dict = TARGET_CLASSES) -> Column:
    """Unified class of a native category; null if it is unmapped or null."""
    out = F
    for key, value in mapping.items():
        out = out.when(category == key, F.lit(value))
    return out.otherwise(F.lit(None).cast("int"))


def unified_name(class_id: Column) -> Column:
    """Name of a unified class; null beyond the scheme."""
    return F.get(F.array(*map(F.lit, UNIFIED)), class_id)
