"""Shards by a consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.llm.scratch import settled

SHARDS = 16
#: Virtual nodes of each shard on the ring.
NODES = 64
#: The ring has 2^32 positions and 2^SLICE_BITS slices; a slice is placed whole.
SLICE_BITS = 14
#: A group with more than this part of an even shard's bytes or rows is cut into pieces that are placed by themselves.
PIECES_A_SHARD = 8


def position(name: Column) -> Column:
    """Where a name is on the ring: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int = SHARDS, nodes: int = NODES) -> DataFrame:
    """(at, shard) of all virtual nodes, and once more a turn further on, so that a walk past the end goes on."""
    at = position(F.concat_ws("/", F.col("shard").cast("string"), F.expr(f"id div {shards}").cast("string")))
    one = spark.range(shards * nodes).withColumn("shard", (F.col("id") % shards).cast("int")).select(at.alias("at"), "shard")
    return one.union(one.select(F.col("at") + F.lit(1 << 32), "shard"))


def with_slices(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (doc_id, size, key) with `slice`, that of the row's group, or of its piece where the group is large.

    At most 2 * shards * PIECES_A_SHARD groups can be large: their table is broadcast.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    parts = shards * PIECES_A_SHARD
    pieces = F.greatest(F.expr(f"(sum(size) * {parts} + {(total or 1) - 1}) div {total or 1}"), F.expr(f"(count(*) * {parts} + {max(n, 1) - 1}) div {max(n, 1)}"))
    large = rows.groupBy("key").agg(pieces.alias("pieces")).filter("pieces > 1")
    piece = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("pieces"))
    name = F.when(F.col("pieces").isNotNull(), F.concat_ws("/", "key", piece.cast("string"))).otherwise(F.col("key"))
    return rows.join(F.broadcast(large), "key", "left").withColumn("slice", F.shiftright(position(name), 32 - SLICE_BITS).cast("int")).drop("pieces", "key")


def place(slices: DataFrame, shards: int = SHARDS) -> DataFrame:
    """slice, rows, shard from slices (slice, bytes, rows): at most 2^SLICE_BITS rows, whatever the input.

    Each slice goes to the first node clockwise whose shard is open. A shard that gets the mean of what is left for the
    open shards, or more, keeps that much (its large slices first, so that small ones meet the bound) and closes; what
    is over walks on to the next open shard. Every round closes a shard, about half of them in each.
    """
    nodes = ring(slices.sparkSession, shards)
    step = 1 << (32 - SLICE_BITS)
    done, closed, left = None, [], slices
    while len(closed) < shards:
        count, total = left.agg(F.count("*"), F.sum("bytes")).first()
        if not count:
            break
        n_open = shards - len(closed)
        marks = left.select((F.col("slice") * F.lit(step).cast("long")).alias("at"), "slice", "bytes", "rows", F.lit(None).cast("int").alias("shard"))
        marks = marks.unionByName(nodes.filter(~F.col("shard").isin(closed)).withColumns({"slice": F.lit(None).cast("int"), "bytes": F.lit(0).cast("long"), "rows": F.lit(0).cast("long")}))
        behind = Window.orderBy(F.desc("at"), F.col("slice").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        owned = marks.withColumn("shard", F.last("shard", ignorenulls=True).over(behind)).filter("slice IS NOT NULL").drop("at")
        of_shard = Window.partitionBy("shard")
        order = of_shard.orderBy(F.desc(F.length(F.bin("bytes"))), "slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # with its half a slice is within the bound: 2 * before + bytes <= 2 * mean
        fits = (2 * F.sum("bytes").over(order) - F.col("bytes")) * n_open <= F.lit(2 * total)
        state = owned.select("*", (F.sum("bytes").over(of_shard) * n_open >= F.lit(total)).alias("closes"), fits.alias("fits"))
        state = settled(state)
        closed += [r.shard for r in state.filter("closes").select("shard").distinct().collect()]
        kept = state.filter("closes AND fits" if len(closed) < shards else "true").select("slice", "rows", "shard")
        done = kept if done is None else done.union(kept)
        left = state.filter("NOT (closes AND fits)").select("slice", "bytes", "rows")
    return done if done is not None else slices.select("slice", "rows", F.lit(None).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs (doc_id, text).

    size is the UTF-8 bytes of the text (null: none) plus 1. Documents with equal texts are one key of the ring, null
    and empty texts too, and share a shard, but for groups with more than an eighth of an even shard, which are cut by
    doc_id. The law is `bytes`: shards differ by less than a slice's bytes from the mean of the open ones, so their
    sizes are near equal, however keys are spread; grown_shard is null. slot numbers a shard's rows from 0 in the
    order of slices, doc_id and text. Repeated rows are rows; an empty table gives none; other columns are not read.

    Texts are read once, for the narrow table of sizes and hashes. The ring is walked by slices, a table of fixed size.
    """
    text = F.coalesce("text", F.lit(""))
    # hashes of the bytes as they are; a column of another type than string has no text
    rows = settled(docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")))
    rows = with_slices(rows, shards)
    slices = settled(rows.groupBy("slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = place(slices, shards).select("slice", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(F.broadcast(placed), "slice").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + inside - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
