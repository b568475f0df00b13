"""Label files packed into a few archives with an index of offsets: millions of small files are no files of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of an archive, about.
SHARD_BYTES = 64 << 20


def layout(files: DataFrame, shards: int) -> DataFrame:
    """name, text, shard, offset, length (UTF-8 bytes): where each file lies in its archive, archives in order of names.

    Names are dealt by hash, so archives are even and a file stays in its archive when others come and go. A file has a
    line feed after it, which is not part of its length; a null text is an empty file. Names must be unique.
    """
    text = F.coalesce("text", F.lit(""))
    rows = files.select("name", text.alias("text"), F.pmod(F.conv(F.substring(F.sha2("name", 256), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard"))
    before = Window.partitionBy("shard").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    length = F.octet_length("text").cast("long")
    return rows.select("*", F.coalesce(F.sum(length + 1).over(before), F.lit(0)).cast("long").alias("offset"), length.alias("length"))


def write(files: DataFrame, root: str, shards: int | None = None) -> None:
    """Packs files (name, text) below `root`: archives/shard=<k>/ with one text file each, and index, a Parquet table.

    Every archive is written by one task, sorted by name, through Spark's own text sink: on any file system, and again
    from the start if its executor is lost. Without `shards` their number follows the texts' bytes.
    """
    if shards is None:
        size = files.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    placed = layout(files, shards)
    # a shard is in one task, and a task writes its shards one after the other
    sorted_ = placed.repartition(shards, "shard").sortWithinPartitions("shard", "name")
    sorted_.select("shard", "text").write.mode("overwrite").option("lineSep", "\n").partitionBy("shard").text(f"{root}/archives")
    placed.select("name", "shard", "offset", "length").write.mode("overwrite").parquet(f"{root}/index")


def index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("name string, shard int, offset long, length long").parquet(f"{root}/index")


def read(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """name, text of the packed files, or of those in `wanted` (name): only archives that hold one are read, each once.

    A task holds one archive and cuts its files out of it by their ranges.
    """
    rows = index(spark, root)
    if wanted is not None:
        rows = rows.join(wanted.select("name").distinct(), "name", "left_semi")
    if rows.isEmpty():
        return spark.createDataFrame([], "name string, text string")
    ranges = rows.groupBy("shard").agg(F.collect_list(F.struct("name", "offset", "length")).alias("files"))
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{root}/archives").select(F.col("shard").cast("int").alias("shard"), "content")
    # the ranges go to the archives, which are large
    each = archives.join(F.broadcast(ranges), "shard") if ranges.count() <= 10_000 else archives.join(ranges, "shard")
    cut = F.transform("files", lambda f: F.struct(f["name"].alias("name"), F.substring(F.col("content"), (f["offset"] + 1).cast("int"), f["length"].cast("int")).alias("b")))
    return each.select(F.explode(cut).alias("f")).select("f.name", F.decode("f.b", "UTF-8").alias("text"))
