"""Deterministic orders and exact ranks and prefix sums that stay balanced when one group has most of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stable_seed(*parts: Column) -> Column:
    """First 32 bits of SHA-256 over the parts joined by a bar, big-endian."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def shuffled(seed: int, salt: str, key: Column) -> Column:
    """A uniform order that depends on seed, salt and key only: it replaces a sequential shuffle, whose order of rows
    depends on the input's order. Which rows land where differs from such a shuffle; sizes and balance don't."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), key.cast("string")), 256)


#: Rows in a cell of ranks, if one group has them all.
CELL_ROWS = 1_000_000


def with_rank(df: DataFrame, groups: list[str], order: str, tie: str, out: str = "rank", n: int | None = None) -> DataFrame:
    """Exact rank from 1 in each group by a hexadecimal hash column and a tie breaker.

    Rows are ranked inside (group, first hash digits); counts of these small cells give each cell's offset. So no task
    holds a whole group, whatever its share of the rows: the number of digits follows their number `n`.
    """
    n = df.count() if n is None else n
    digits = next(k for k in range(2, 17) if n <= CELL_ROWS * 16**k)
    cell = df.withColumn("_cell", F.substring(order, 1, digits))
    keys = [*groups, "_cell"]
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cell.groupBy(*keys).count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    on = [cell[k].eqNullSafe(offsets[k]) for k in keys]
    joined = cell.join(offsets, on, "left").select(cell["*"], "_offset")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order, tie))
    return joined.withColumn(out, (inside + F.col("_offset")).cast("long")).drop("_cell", "_offset")


def with_running(df: DataFrame, groups: list[str], cell: Column, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums in each group along `order`, where `cell` rises with that order and cuts a group into even pieces."""
    cells = df.withColumn("_cell", cell)
    keys = [*groups, "_cell"]
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(*keys).agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    totals = totals.select(*keys, *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # all sums in one call: one window, where as many calls would stack windows. The few totals are joined after it, so that
    # rows are sorted once
    out = cells.withColumns({name: F.sum(c).over(inside) for c, name in sums.items()}).join(totals, keys)
    out = out.withColumns({name: F.col(name) + F.col(f"_before_{c}") for c, name in sums.items()})
    return out.drop("_cell", *(f"_before_{c}" for c in sums))


#: Pieces that rows are cut into along an order, and rows of the sample for each of them.
PIECES, SAMPLE_A_PIECE = 256, 64
#: One of so many clusters tells about how many rows there are.
CLUSTER_SHARE = 64
#: Rows of a piece for which there are no more pieces, and pieces that there are at least, where clusters tell how many rows
#: there are: each piece of each group is a call of its own. It changes the cost, not the result.
PIECE_ROWS, LEAST_PIECES = 100_000, 16


class RangePieces:
    """Even pieces along an order of one or more columns, with cut points from a bounded sample.

    The keys must tell rows apart (a tie breaker last), so that rows of one value are cut as well; names of one long
    prefix are as good as any. `of` numbers the piece of a row: it rises with the order, and rows of a piece are the same
    whenever it is asked, as the cuts are fixed. Pieces differ by the sample's error only; results don't depend on them.
    """

    def __init__(self, rows: DataFrame, keys: list[Column], pieces: int = PIECES, seed: int = 1, cluster: Column | None = None):
        """`cluster` is what rows are made by (an image): the sample is then all rows of some clusters by a hash, which Spark
        filters before it makes the others. Where clusters are too uneven for that, the sample is one of rows."""
        self.keys = keys
        sample = lambda rows: rows.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
        most = pieces * SAMPLE_A_PIECE
        names = [f"k{i}" for i in range(len(keys))]
        # cuts as JSON, one literal of the plan whatever the keys' types, by each number of leading keys
        heads = [names[:k] for k in range(1, len(keys) + 1)]
        read = lambda picked: picked.orderBy(*names).select(F.to_json(F.array("k0")), *(F.to_json(F.struct(*h)) for h in heads[1:])).collect()
        kinds, found = [f.dataType.simpleString() for f in sample(rows).schema.fields], None
        if cluster is not None:
            share = lambda n: rows.filter(F.pmod(F.xxhash64(cluster, F.lit(seed)), F.lit(n)) == 0)
            n = share(CLUSTER_SHARE).count() * CLUSTER_SHARE
            pieces = min(pieces, max(LEAST_PIECES, n // PIECE_ROWS))
            most = pieces * SAMPLE_A_PIECE
            n //= most
            found = read(sample(share(n)).limit(2 * most + 1)) if n > 1 else None
        if found is None or not most // 4 <= len(found) <= 2 * most:
            n = rows.count()
            # three standard deviations more than asked for are left to the fraction; the limit bounds the driver
            found = read(sample(rows) if n <= most else sample(rows).sample(fraction=min(1.0, most / n), seed=seed).limit(2 * most))
        rows = found
        at = [k for k in sorted({len(rows) * k // pieces for k in range(1, pieces)} - {0}) if k < len(rows)]
        # as many keys as it takes to tell the cuts apart: one, unless many rows share its value
        n = next((k for k in range(len(keys)) if len({rows[i][k] for i in at}) == len(at)), len(keys) - 1)
        cuts = list(dict.fromkeys(rows[i][n] for i in at))
        self.leading = heads[n]
        if n:
            self.kind = f"struct<{','.join(f'k{k}:{kinds[k]}' for k in range(n + 1))}>"
        else:  # plain values, which are compared sooner than structs of one
            self.kind, cuts = kinds[0], [c[1:-1] for c in cuts]
        self.side = max(1, math.isqrt(len(cuts)))
        self.blocks = [cuts[i : i + self.side] for i in range(0, len(cuts), self.side)]

    def of(self) -> Column:
        """The number of the piece: cuts at or before the row, looked up in blocks of them."""
        if not self.blocks:
            return F.lit(0)
        heads = F.from_json(F.lit(f"[{','.join(b[0] for b in self.blocks)}]"), f"array<{self.kind}>")
        blocks = F.from_json(F.lit(f"[{','.join(f'[{','.join(b)}]' for b in self.blocks)}]"), f"array<array<{self.kind}>>")
        key = self.keys[0] if len(self.leading) == 1 else F.struct(*(v.alias(n) for n, v in zip(self.leading, self.keys)))

        def number(key: Column) -> Column:
            before = lambda cuts: F.size(F.filter(cuts, lambda c: c <= key))
            inside = lambda block: block * self.side + before(F.get(blocks, block))
            return F.get(F.transform(F.array(F.greatest(before(heads) - 1, F.lit(0))), inside), F.lit(0))

        return F.get(F.transform(F.array(key), number), F.lit(0))  # the key is made once for all comparisons


def with_range_rank(df: DataFrame, groups: list[str], keys: list[Column], out: str = "rank", pieces: int = PIECES) -> DataFrame:
    """Exact rank from 1 in each group along `keys` (ascending; they tell rows apart), whatever their distribution.

    Rows are ranked inside (group, piece); the pieces' counts, at most `pieces` for a group, give the offsets.
    """
    cut = RangePieces(df, keys, pieces)
    cell = df.withColumn("_piece", cut.of())
    names = [*groups, "_piece"]
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cell.groupBy(*names).count().withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    joined = cell.join(offsets, [cell[k].eqNullSafe(offsets[k]) for k in names], "left").select(cell["*"], "_offset")
    inside = F.row_number().over(Window.partitionBy(*names).orderBy(*keys))
    return joined.withColumn(out, (inside + F.col("_offset")).cast("long")).drop("_piece", "_offset")
