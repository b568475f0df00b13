"""Merkle trees of manifests: fingerprints by ranges of the path's hash, folded level by level, and compared top-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of a leaf's range: 16^DEPTH leaves. A tree has little over that many rows, whatever the manifest.
DEPTH = 3


def entry_hash(path: Column, *content: Column) -> Column:
    """SHA-256 of an entry; its parts can't run into each other, as each has its length before it. Nulls have none."""
    parts = [F.concat(F.coalesce(F.length(c.cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c.cast("string"), F.lit(""))) for c in (path, *content)]
    return F.sha2(F.concat(*parts), 256)


def range_of(path: Column, digits: int = DEPTH) -> Column:
    """The range of a path: the first digits of its hash. Ranges of a level are even, whatever the names."""
    return F.substring(F.sha2(path, 256), 1, digits)


def leaves(entries: DataFrame, path: str, content: list[str], depth: int = DEPTH) -> DataFrame:
    """prefix, n, digest of each range with entries. Entries are a multiset: of repeated ones each counts.

    A range's digest is of the number of its entries and of the sums of their hashes' four quarters of 60 bits: sums meet
    in any order and in part before the shuffle, so no list of a range is built; entries that change places of equal
    prefixes, or other sets of equal sums of one quarter, differ in the others.
    """
    h = entry_hash(F.col(path), *(F.col(c) for c in content))
    rows = entries.select(range_of(F.col(path), depth).alias("prefix"), h.alias("_h"))
    quarter = lambda k: F.conv(F.substring("_h", 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("prefix").agg(F.count("*").alias("n"), *(F.sum(quarter(k)).alias(f"_{k}") for k in range(4)))
    return sums.select("prefix", "n", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "_0", "_1", "_2", "_3"))), 256).alias("digest"))


def tree(entries: DataFrame, path: str, content: list[str], depth: int = DEPTH) -> DataFrame:
    """level, prefix, n, digest: the leaves and, up to level 0 with one row, the nodes over them.

    A node's digest is of its children's prefixes and digests in order, 16 at most. An empty manifest has no row.
    """
    level = leaves(entries, path, content, depth)
    out = level.select(F.lit(depth).alias("level"), "prefix", "n", "digest")
    for k in range(depth - 1, -1, -1):
        children = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: F.concat_ws("=", x["prefix"], x["digest"])), "|")
        level = level.groupBy(F.substring("prefix", 1, k).alias("up")).agg(F.sum("n").alias("n"), F.sha2(children, 256).alias("digest")).withColumnRenamed("up", "prefix")
        out = out.union(level.select(F.lit(k).alias("level"), "prefix", "n", "digest"))
    return out


def held(rows: DataFrame) -> DataFrame:
    """A tree, or what is found in one, as a local table: its rows are bounded by the depth."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def differing(one: DataFrame, other: DataFrame, depth: int = DEPTH) -> DataFrame:
    """prefix of the leaf ranges in which two trees differ, found from the root down.

    Of each level only the children of nodes that differ are looked at: equal parts of two kept trees are not read below
    their topmost node, if tables are kept by level and prefix. At most 16^level prefixes are held between levels.
    """
    at = None
    for k in range(depth + 1):
        a, b = (t.filter(F.col("level") == k).select("prefix", F.col("digest").alias(n)) for t, n in ((one, "_a"), (other, "_b")))
        if at is not None:
            up = F.broadcast(at.withColumnRenamed("prefix", "_up"))
            a, b = (t.join(up, F.substring("prefix", 1, k - 1) == F.col("_up"), "left_semi") for t in (a, b))
        at = held(a.join(b, "prefix", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("prefix"))
        if at.isEmpty():
            break
    return at


def difference(one: DataFrame, other: DataFrame, path: str, content: list[str], trees: tuple[DataFrame, DataFrame] | None = None, depth: int = DEPTH) -> DataFrame:
    """path, range, change ('added', 'removed', 'changed') from manifest `one` to `other`.

    Only entries of ranges in which the trees differ are compared. `trees` are the manifests' trees where they are kept;
    a path with several entries is changed if their multisets differ.
    """
    a, b = trees or tuple(held(tree(x, path, content, depth)) for x in (one, other))
    ranges = F.broadcast(differing(a, b, depth).withColumnRenamed("prefix", "range"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col(path).alias("path"), range_of(F.col(path), depth).alias("range"), entry_hash(F.col(path), *(F.col(c) for c in content)).alias("_h"))
        rows = rows.join(ranges, "range", "left_semi")
        part = lambda k: F.sum(F.conv(F.substring("_h", 16 * k + 1, 15), 16, 10).cast("decimal(38,0)"))
        return rows.groupBy("path", "range").agg(F.struct(F.count("*"), *(part(k) for k in range(4))).alias(name))

    both = side(one, "_x").join(side(other, "_y"), ["path", "range"], "full_outer")
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_x") != F.col("_y"), "changed")
    return both.select("path", "range", change.alias("change")).filter("change IS NOT NULL")
