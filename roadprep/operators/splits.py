"""Allocation, splits, folds, quotas and assignments with exact sizes, by a deterministic order instead of a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.functions.order import shuffled, with_rank


def allocate(strata: DataFrame, total: int, out: str, weight: str = "size") -> DataFrame:
    """Largest remainder: floor of the share of `total`, then one more for the largest fractions, ties by stratum.

    `strata` is the table of stratum counts. Without any weight every stratum gets 0.
    """
    everything = Window.partitionBy(F.lit(0))
    whole = F.sum(weight).over(everything)
    share = F.when(whole > 0, F.lit(total) * F.col(weight))
    strata = strata.withColumn("_floor", F.coalesce(F.floor(share / whole), F.lit(0)).cast("long")).withColumn("_part", F.coalesce(share % whole, F.lit(0)))
    left = F.when(whole > 0, F.lit(total) - F.sum("_floor").over(everything)).otherwise(F.lit(0))
    place = F.row_number().over(everything.orderBy(F.desc("_part"), "stratum"))
    return strata.withColumn(out, F.col("_floor") + (place <= left).cast("long")).drop("_floor", "_part")


def allocate_splits(strata: DataFrame, n_train: int, n_val: int) -> DataFrame:
    """stratum, size, n_train, n_val: both allocations, cut to what a stratum has, the deficit dealt to those with most room.

    Room is size less both allocations, so that train can't claim what val has.
    """
    out = allocate(allocate(strata, n_train, "n_train"), n_val, "n_val")
    out = out.withColumn("n_val", F.least("n_val", "size")).withColumn("n_train", F.least(F.col("n_train"), F.col("size") - F.col("n_val")))
    everything = Window.partitionBy(F.lit(0))
    for name, goal in (("n_val", n_val), ("n_train", n_train)):
        room = F.col("size") - F.col("n_train") - F.col("n_val")
        out = out.withColumn("_room", room).withColumn("_need", F.greatest(F.lit(0), F.lit(goal) - F.sum(name).over(everything)))
        before = F.coalesce(F.sum("_room").over(everything.orderBy(F.desc("_room"), "stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(name, F.col(name) + F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_need") - before))).drop("_room", "_need")
    return out


def stratified(rows: DataFrame, key: str, n_train: int, n_val: int, seed: int = 42, stratum: Column | None = None) -> DataFrame:
    """Adds stratum and `part`: in each stratum the first n_val rows of the order are val, the next n_train are train, the
    rest null. `stratum` is any column over the rows; without it they have one of that name."""
    rows = rows if stratum is None else rows.withColumn("stratum", stratum)
    strata = rows.groupBy("stratum").agg(F.count("*").alias("size"))
    plan = allocate_splits(strata, n_train, n_val).select("stratum", "n_train", "n_val")
    ranked = with_rank(rows.withColumn("_order", shuffled(seed, "split", F.col(key))), ["stratum"], "_order", key)
    part = F.when(F.col("rank") <= F.col("n_val"), "val").when(F.col("rank") <= F.col("n_val") + F.col("n_train"), "train")
    return ranked.join(plan, "stratum").withColumn("part", part).drop("_order", "n_train", "n_val")


def folds(rows: DataFrame, group: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds `fold`: rank in the group modulo k. Training sets are the other folds; they are never written out."""
    ranked = with_rank(rows.withColumn("_order", shuffled(seed, "fold", F.col(key))), [group], "_order", key)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("_order", "rank")


def quota(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of each group in the deterministic order: each task keeps n rows of a group before the shuffle."""
    return first_rows(rows, group, [shuffled(seed, "quota", F.col(key)), F.col(key)], n)


def first_rows(rows: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; a limit by group precedes the shuffle."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def blocks(rows: DataFrame, key: str, names: list[str], seed: int, salt: str, out: str, floor_first: bool = False) -> DataFrame:
    """Adds `out`: contiguous near-equal blocks of the shuffled rows; with `floor_first`, the first of two is n // 2."""
    n = rows.count()
    ranked = with_rank(rows.withColumn("_order", shuffled(seed, salt, F.col(key))), [], "_order", key, n=n)
    at = F.col("rank") - 1
    slot = (at >= n // 2).cast("int") if floor_first else F.floor(at * len(names) / n).cast("int")
    return ranked.withColumn(out, F.get(F.array(*map(F.lit, names)), slot)).drop("_order", "rank")
