"""Queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from roadprep.sources.fixtures import FX, PIXELS_DUCKDB

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


#: Named parts of oracle queries.
PARTS = FX | {
    "pixels": PIXELS_DUCKDB,
    "uni": """
SELECT *, CASE category_id WHEN 24 THEN 0 WHEN 25 THEN 1 WHEN 26 THEN 2 WHEN 27 THEN 3 WHEN 28 THEN 4 WHEN 32 THEN 5 WHEN 33 THEN 5 END AS class_id
FROM fx_annotations""",
    "classes": """
SELECT * FROM (VALUES (0, 'person'), (1, 'rider'), (2, 'car'), (3, 'truck'), (4, 'bus'), (5, 'bicycle')) t(class_id, class_name)""",
    "yolo": """
SELECT image_id, ann_idx, class_id, greatest(least((x + w / 2) / 1920, 1.0), 0.0) AS cx, greatest(least((y + h / 2) / 1080, 1.0), 0.0) AS cy,
 greatest(least(w / 1920, 1.0), 0.0) AS bw, greatest(least(h / 1080, 1.0), 0.0) AS bh
FROM uni WHERE class_id IS NOT NULL AND w > 0 AND h > 0""",
    "idx": """
SELECT i.image_id, i.weather, i.split, coalesce(n, 0) AS n_instances, coalesce(rare, '') AS rare
FROM fx_images i LEFT JOIN (SELECT image_id, count(*) AS n,
  array_to_string(list_sort(list_distinct(list(class_name) FILTER (class_name IN ('bus', 'bicycle', 'rider')))), ',') AS rare
  FROM yolo JOIN classes USING (class_id) GROUP BY image_id) a USING (image_id)""",
}
_NEEDS = {"fx_detections": ["fx_annotations"], "uni": ["fx_annotations"], "yolo": ["uni"], "idx": ["fx_images", "yolo", "classes"]}


def with_parts(*names: str) -> str:
    """A WITH clause of these parts and what they need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in done) + "\n"
