"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
_steps: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, or in the context's checkpoint folder. Where neither is set, a
    local master, as in tests, has one of its machine; on a cluster that is an error, as executors could not read it."""
    context = spark.sparkContext
    if context.applicationId not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        _roots[context.applicationId] = f"{base.rstrip('/')}/roadprep-{uuid.uuid4().hex}"
    return _roots[context.applicationId]


#: Rows that go to a Python worker at once, at most: whole texts, of which Spark's usual number takes tens of MB twice.
BATCH_ROWS = 4_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside hand Python workers BATCH_ROWS rows at once, at most."""
    before = spark.conf.get(_BATCH)
    try:
        if not 0 < int(before) <= BATCH_ROWS:
            spark.conf.set(_BATCH, str(BATCH_ROWS))
        yield
    finally:
        spark.conf.set(_BATCH, before)


def settled(df: DataFrame, **options) -> DataFrame:
    """The rows of `df`, computed once and kept as a Parquet table that every executor can read; `options` are the writer's."""
    spark = df.sparkSession
    path = "/".join([shared_folder(spark), *_steps[-1:], uuid.uuid4().hex])
    with bounded_batches(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows as a table; the tables that it settles on its way are deleted once that is written."""
    step = uuid.uuid4().hex
    _steps.append(step)
    try:
        out = make()
        _steps.pop()
        return settled(out)
    finally:
        if step in _steps:
            _steps.remove(step)
        _delete(spark, f"{shared_folder(spark)}/{step}")


def clear(spark: SparkSession) -> None:
    """Deletes this application's tables; results that still read them must have been written before."""
    root = _roots.pop(spark.sparkContext.applicationId, None)
    if root:
        _delete(spark, root)
