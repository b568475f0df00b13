"""All registered queries over the reference's data work."""

from __future__ import annotations

from roadprep.jobs import images, labels, marts, metrics, records, splits  # noqa: F401
from roadprep.jobs.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
