"""Robust summaries, curves, fold summaries and marts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType
from pyspark.sql.window import Window

#: Probabilities of the stored quantiles: 33 from 0.01 to 0.99.
PROBABILITIES = [0.01 + 0.98 * i / 32 for i in range(33)]


#: Bins for each factor of e of a value's size: values of a bin differ by a thousandth of their size.
BINS = 1000
#: What a robust summary multiplies the median distance with, and how many of these a kept value may be off.
SCALE, FAR = 1.4826, 3


def sketch(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, bin, c, lo, hi: how many finite values of each group lie in each logarithmic bin, the least and the greatest.

    Bins rise with the value and need no look at the data, so sketches merge (merge_sketches): of partitions, of days, of
    shards. A group has as many rows as it has sizes of values, a few thousand, however many values; ranks are exact to
    the bin, values to 1 / BINS of their size.
    """
    rows = _finite(values, groups, value)
    return rows.groupBy(*groups, _bin(F.col("_v")).alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "bin").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _finite(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return values.select(*groups, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))


def _bin(v: Column) -> Column:
    size = F.floor((F.ln(F.abs(v)) + 746) * BINS)  # positive for every double but 0
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v) * size).cast("long")


def _whole(groups: list[str]):
    return Window.partitionBy(*(groups or [F.lit(0)]))


def _ranks(p: float, n: str) -> tuple[str, str]:
    """The ranks, from 0, between which the quantile p of n values lies, as SQL: dozens of them are one text each."""
    return f"floor({p!r}D * ({n} - 1))", f"ceil({p!r}D * ({n} - 1))"


def _refined(values: DataFrame, groups: list[str], value: str, bins: DataFrame) -> DataFrame:
    """groups, v, c: the values of the bins that are marked `need`, each with its count, and the others' bins as one value.

    The second and last reading of the values. Bins that hold a single value need none.
    """
    need = bins.filter("need AND lo < hi").select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("bin").alias("_b"))
    rows = _finite(values, groups, value)
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    exact = rows.join(need, [*same, _bin(F.col("_v")) == F.col("_b")], "left_semi").groupBy(*groups, F.col("_v").alias("v")).agg(F.count("*").alias("c"))
    rest = bins.filter("NOT (need AND lo < hi)").select(*groups, ((F.col("lo") + F.col("hi")) / 2).alias("v"), "c")
    return exact.union(rest)


def _at(rank: str, value: str = "v") -> Column:
    """The value at a rank, of rows with their first (`_from`) and last rank (`_to` - 1): an aggregate."""
    return F.expr(f"max(CASE WHEN {rank} >= _from AND {rank} < _to THEN {value} END)")


def _sides(probabilities: list[float], n: str) -> list[Column]:
    """Columns _<i>a and _<i>b: the values on both sides of each quantile."""
    return [_at(k).alias(f"_{i}{s}") for i, p in enumerate(probabilities) for s, k in zip("ab", _ranks(p, n))]


def _between(i: int, p: float, n: str) -> str:
    return f"_{i}a + (_{i}b - _{i}a) * ({p!r}D * ({n} - 1) - floor({p!r}D * ({n} - 1)))"


def _placed(rows: DataFrame, groups: list[str], order: list, count: str = "c", n: str = "_n") -> DataFrame:
    """_from, _to and the number of values `n`, by running counts."""
    running = F.sum(count).over(_whole(groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"_from": running - F.col(count), "_to": running, n: F.sum(count).over(_whole(groups))})


def _quantiles_of(rows: DataFrame, groups: list[str], probabilities: list[float]) -> DataFrame:
    """groups, q of weighted values (groups, v, c)."""
    one = _placed(rows, groups, ["v"]).groupBy(*groups).agg(F.first("_n").alias("_n"), *_sides(probabilities, "_n"))
    return one.select(*groups, F.expr(f"array({', '.join(_between(i, p, '_n') for i, p in enumerate(probabilities))})").alias("q"))


def quantiles(values: DataFrame, groups: list[str], value: str, probabilities: list[float], out: str = "q", exact: bool = True) -> DataFrame:
    """groups, `out` (an array): quantiles of the finite values of each group, linear between neighbours.

    The sketch tells which bins hold the wanted ranks; a second reading takes those bins' values alone, distinct ones with
    their counts. So no task holds a group. Without `exact` the sketch stands for the values, which are then off by half
    of 1 / BINS of their size at most, and the values are read once.
    """
    bins = sketch(values, groups, value)
    if exact:
        placed = _placed(bins, groups, ["bin"])
        need = " OR ".join(f"{b} >= _from AND {a} < _to" for a, b in (_ranks(p, "_n") for p in probabilities))
        rows = _refined(values, groups, value, placed.withColumn("need", F.expr(need)))
    else:
        rows = bins.select(*groups, ((F.col("lo") + F.col("hi")) / 2).alias("v"), "c")
    return _quantiles_of(rows, groups, probabilities).withColumnRenamed("q", out)


def medians(values: DataFrame, groups: list[str], value: str, out: str = "median", exact: bool = True) -> DataFrame:
    """groups, `out`: the median of each group (see quantiles)."""
    return quantiles(values, groups, value, [0.5], "_q", exact).select(*groups, F.col("_q")[0].alias(out))


def _at_rank(values: np.ndarray, counts: np.ndarray, rank: int) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), rank, "right")])


def _needed(bins: pd.DataFrame, probabilities: list[float], low: float, high: float) -> np.ndarray:
    """Which bins of a group's sketch a robust summary must know the values of.

    The sketch bounds the median by its bin's ends, so each bin's distance to it, the median distance by the ranks of
    the least and of the greatest distances, the limit of what is kept, and how many values below the kept ones are
    rejected; a wanted rank lies in one of the few bins between these bounds. Bins with the range's ends count as well.
    """
    c, lo, hi = (bins[k].to_numpy() for k in ("c", "lo", "hi"))
    last = np.cumsum(c) - 1
    first, n = last - c + 1, int(c.sum())
    k1, k2 = (n - 1) // 2, n // 2
    need = (k2 >= first) & (k1 <= last)
    mlo, mhi = lo[need].min(), hi[need].max()
    near, far = np.maximum(0, np.maximum(lo - mhi, mlo - hi)), np.maximum(hi - mlo, mhi - lo)
    dlo, dhi = _at_rank(near, c, k1), _at_rank(far, c, k2)
    # a millionth aside: products are rounded
    kept = (far <= dlo * SCALE * FAR * (1 - 1e-6)) | (dhi == 0)
    gone = (near > dhi * SCALE * FAR * (1 + 1e-6)) & (dlo > 0)
    below = hi < mlo
    k_min, k_max, r_min, r_max = (int(c[x].sum()) for x in (kept, ~gone, gone & below, ~kept & below))
    need = need | (near <= dhi) & (far >= dlo) | ~kept & ~gone
    for p in probabilities:
        need |= (r_max + math.ceil(p * (k_max - 1)) >= first) & (r_min + math.floor(p * max(k_min - 1, 0)) <= last)
    for end in (low, high):
        need |= (lo <= end) & (hi >= end)
    return need


def _marked(bins: DataFrame, groups: list[str], probabilities: list[float], low: float, high: float) -> DataFrame:
    """bins with `need`. A group's sketch is bounded by the sizes that numbers have, not by its values."""

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin", ignore_index=True)
        return frame.assign(need=_needed(frame, probabilities, low, high))

    schema = StructType([*bins.schema.fields, StructField("need", BooleanType())])
    return bins.groupBy(*groups).applyInPandas(mark, schema)


def robust_summary(values: DataFrame, groups: list[str], value: str, low: float, high: float, exact: bool = True) -> DataFrame:
    """n, median, mad, p10, p90, q, rejected, clipped of the finite values of each group.

    Median and MAD (times 1.4826) are of all finite values; then values further than 3 MAD from the median are
    rejected, none if the MAD is 0. Quantiles are of what is kept, as it is; `clipped` counts what of it lies outside
    [low, high]: a value is cut to that range when it is drawn.

    The values are read twice: for the sketch, and for the values of the few bins on which the result depends. Without
    `exact` they are read once and every value stands in its bin's middle, so that median and quantiles are off by half
    of 1 / BINS of their size, and counts by what lies in the bins at the limits.
    """
    bins = sketch(values, groups, value)
    probabilities = [0.1, 0.9, *PROBABILITIES]
    if exact:
        rows = _refined(values, groups, value, _marked(bins, groups, probabilities, low, high))
    else:
        rows = bins.select(*groups, ((F.col("lo") + F.col("hi")) / 2).alias("v"), "c")
    over = _whole(groups)

    def with_middle(rows: DataFrame, order: str, name: str, scale: float = 1.0) -> DataFrame:
        a, b = (_at(k, order).over(over) for k in _ranks(0.5, "_n"))
        return _placed(rows, groups, [order]).withColumn(name, (a + b) / 2 * scale)

    rows = with_middle(rows, "v", "median")
    rows = with_middle(rows.withColumn("_off", F.abs(F.col("v") - F.col("median"))), "_off", "mad", SCALE)
    kept = (F.col("mad") == 0) | (F.col("_off") <= FAR * F.col("mad"))
    rows = _placed(rows.withColumn("_w", F.when(kept, F.col("c")).otherwise(0)), groups, ["v"], "_w", "_k")
    outside = (F.col("v") < low) | (F.col("v") > high)
    counts = [F.sum(F.col("c") - F.col("_w")).alias("rejected"), F.sum(F.when(outside, F.col("_w")).otherwise(0)).alias("clipped")]
    one = rows.groupBy(*groups).agg(*(F.first(c).alias(n) for c, n in (("_k", "n"), ("median", "median"), ("mad", "mad"))), *counts, *_sides(probabilities, "_k"))
    q = [_between(i, p, "n") for i, p in enumerate(probabilities)]
    return one.select(*groups, "n", "median", "mad", F.expr(q[0]).alias("p10"), F.expr(q[1]).alias("p90"), F.expr(f"array({', '.join(q[2:])})").alias("q"), "rejected", "clipped")


def fold_summary(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """mean, std (of a sample; 0 for one value) and n over the non-null values; null mean and std and 0 if there is none."""
    n = F.count(value)
    return values.groupBy(*groups).agg(F.avg(value).alias("mean"), F.when(n > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("std"), n.alias("n"))


def run_parts(run: Column) -> dict[str, Column]:
    """base: the run without `_official` or `_fold<n>`; fold: its number or null; official."""
    fold = F.regexp_extract(run, r"_fold(\d+)$", 1)
    return {"base": F.regexp_replace(run, r"_(official|fold\d+)$", ""), "fold": F.when(fold != "", fold.cast("int")), "official": run.endswith("_official")}


def class_position(name: Column, order: list[str]) -> Column:
    """The place of a class in the given order, that of all others after it: sort by (position, name)."""
    place = F.array_position(F.array(*map(F.lit, order)), name)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(order))).cast("int")


def per_class_table(cells: DataFrame, values: str | list[str], order: list[str]) -> DataFrame:
    """experiment, eval, weather, class, position, and each value, its _std and _n: the table of reports, four decimals.

    `cells` (run, weather, class and the values, one metric or several) has one row for each report's cell. Folds of a run
    are averaged as 5-fold; its official run, and the first of its other runs by name, stand as they are, without std
    and n. All metrics are columns of one aggregate.
    """
    values = [values] if isinstance(values, str) else values
    rows = cells.withColumns(run_parts(F.col("run")))
    state = lambda v: [F.avg(v).alias(v), F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0))).alias(f"{v}_std"), F.count(v).alias(f"{v}_n")]
    folded = rows.filter("fold IS NOT NULL").groupBy("base", F.lit("5-fold").alias("eval"), "weather", "class").agg(*(c for v in values for c in state(v)))
    others = rows.filter("fold IS NULL").withColumn("eval", F.when(F.col("official"), "official").otherwise("single"))
    first = others.groupBy("base", "eval").agg(F.min("run").alias("run"))
    alone = lambda v: [F.col(v), F.lit(None).cast("double").alias(f"{v}_std"), F.lit(None).cast("long").alias(f"{v}_n")]
    others = others.join(first, ["base", "eval", "run"]).select("base", "eval", "weather", "class", *(c for v in values for c in alone(v)))
    out = folded.union(others).withColumn("position", class_position(F.col("class"), order))
    each = lambda v: [F.round(v, 4).alias(v), F.round(f"{v}_std", 4).alias(f"{v}_std"), F.col(f"{v}_n")]
    return out.select(F.col("base").alias("experiment"), "eval", "weather", "class", "position", *(c for v in values for c in each(v)))


def best_epochs(log: DataFrame, metric: str) -> DataFrame:
    """run, epoch, value: the epoch with the highest value of the metric, the earliest of equal ones. `log` is long:
    run, epoch, metric, value."""
    best = F.max(F.struct("value", -F.col("epoch")))
    rows = log.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy("run").agg(best.alias("b"))
    return rows.select("run", (-F.col("b")["col2"]).alias("epoch"), F.col("b.value").alias("value"))


def audit(rows: DataFrame) -> DataFrame:
    """check, value, passed of a rendered stage, from one pass over rows of (source_mean, source_std, mean, std, same, label_same).

    Degenerate renderings (mean outside 5 to 250 or std below 10) fail unless their source is unusable (mean below 20 or
    std below 10); renderings that equal their source and labels that differ from it fail. Brightness has no verdict.
    The row `all` is passed if nothing fails.
    """
    bad = ~(F.col("mean").between(5, 250) & (F.col("std") >= 10))
    usable = F.coalesce((F.col("source_mean") >= 20) & (F.col("source_std") >= 10), F.lit(False))
    one = rows.agg(
        F.count("*").cast("double").alias("images"),
        F.avg("mean").alias("brightness_mean"),
        F.min("mean").alias("brightness_min"),
        F.max("mean").alias("brightness_max"),
        F.count_if(bad & usable).cast("double").alias("degenerate"),
        F.count_if(bad & ~usable).cast("double").alias("source_degenerate"),
        F.count_if("same").cast("double").alias("identical"),
        F.count_if(~F.col("label_same")).cast("double").alias("labels_changed"),
    ).withColumn("all", F.col("degenerate") + F.col("identical") + F.col("labels_changed"))
    checks = one.unpivot([], one.columns, "check", "value")
    return checks.withColumn("passed", F.when(F.col("check").isin("degenerate", "identical", "labels_changed", "all"), F.col("value") == 0))


def monotonic(curve: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, monotonic: no value exceeds the one before by more than 1e-6 of the first value (or of 1)."""
    w = Window.partitionBy(group).orderBy(x)
    first = F.first(y).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ok = F.coalesce(F.col(y) <= F.lag(y).over(w) + 1e-6 * F.greatest(F.abs(first), F.lit(1.0)), F.lit(True))
    return curve.select(group, ok.alias("_ok")).groupBy(group).agg(F.bool_and("_ok").alias("monotonic"))


def invert(curve: DataFrame, targets: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, strength at which the falling curve meets the group's `target`, linear in log(y).

    Null if the target is above the curve's first point or below its last. Else the first segment that holds the target
    counts, flat ones are skipped; the last x if there is none. Values are taken as 1e-9 at least.
    """
    w = Window.partitionBy(group).orderBy(x)
    rows = curve.withColumns({"x1": F.lead(x).over(w), "y1": F.lead(y).over(w)}).join(targets, group)
    a, b, t = (F.ln(F.greatest(F.col(c), F.lit(1e-9))) for c in (y, "y1", "target"))
    b = F.when(F.col("y1").isNotNull(), b)
    hit = (a >= t) & (t >= b) & (a != b)
    at = F.col(x) + (a - t) / (a - b) * (F.col("x1") - F.col(x))
    agg = rows.groupBy(group).agg(F.min(F.when(hit, F.struct(F.col(x).alias("x"), at.alias("at")))).alias("h"), F.min_by(y, x).alias("first"), F.max_by(y, x).alias("end"), F.max(x).alias("last"), F.first("target").alias("target"))
    return agg.select(group, F.when((F.col("target") <= F.col("first")) & (F.col("target") >= F.col("end")), F.coalesce("h.at", "last")).alias("strength"))


def gate(fits: DataFrame) -> DataFrame:
    """condition, passed, strength, source, bound from condition, monotonic, strength, base, target, low, high, fallback.

    A curve that is monotonic and holds the target passes: its strength is cut to [low, high], `bound` says where. Else,
    if it is monotonic and the target is sharper than `base`, its first point, there is no blur. Else the condition's
    fallback stands in, cut to the range.
    """
    inside = lambda c: F.greatest(F.col("low"), F.least(F.col(c), F.col("high")))
    passed = F.coalesce(F.col("monotonic"), F.lit(False)) & F.col("strength").isNotNull()
    sharp = F.coalesce(F.col("monotonic") & (F.col("target") > F.col("base")), F.lit(False))
    strength = F.when(passed, inside("strength")).when(sharp, F.lit(0.0)).otherwise(inside("fallback"))
    source = F.when(passed, "fit").when(sharp, "no-blur").otherwise("fallback")
    bound = F.when(passed & (F.col("strength") < F.col("low")), "lower").when(passed & (F.col("strength") > F.col("high")), "upper")
    return fits.select("condition", passed.alias("passed"), strength.alias("strength"), source.alias("source"), bound.alias("bound"))


def gate_report(fits: DataFrame) -> DataFrame:
    """The gate's rows with what they are decided by: reason, monotonic, in_range, clipped, and the primary metric of the
    base and of the target. `fits` as for `gate`."""
    rows = gate(fits).join(fits.select("condition", "monotonic", F.col("strength").alias("_at"), "base", "target"), "condition")
    monotonic, in_range = F.coalesce(F.col("monotonic"), F.lit(False)), F.col("_at").isNotNull()
    reason = F.when(F.col("source") == "no-blur", "target sharper than base").when(~monotonic, "curve not monotonic").when(~in_range, "target outside the curve").when(F.col("bound").isNotNull(), F.concat("bound", F.lit(" bound reached"))).otherwise("ok")
    return rows.select("condition", "passed", "strength", "source", "bound", reason.alias("reason"), monotonic.alias("monotonic"), in_range.alias("in_range"), F.col("bound").isNotNull().alias("clipped"), F.col("base").alias("base_primary"), F.col("target").alias("target_primary"))


def closed_loop_ratios(measured: DataFrame, reference: float | Column) -> DataFrame:
    """measured (condition, base_primary, target_primary, measured_primary) with the metric of a reference sample, the
    ratio of each to it and the absolute error against the target; ratios are null where the reference is 0."""
    ratios = [F.try_divide(F.col(f"{n}_primary"), F.col("reference_primary")).alias(f"{n}_ratio") for n in ("base", "target", "measured")]
    rows = measured.withColumn("reference_primary", reference if isinstance(reference, Column) else F.lit(float(reference)))
    return rows.select("*", *ratios, F.abs(F.col("measured_primary") - F.col("target_primary")).alias("abs_err"))


def effective(fits: DataFrame, ranges: DataFrame) -> DataFrame:
    """condition, kind, frac, source for each row of `ranges` (condition, kind, low, high) by `fits` (condition, value, source).

    The fitted value cut to the range, its middle as `provisional` where no fit has a value; `+clipped` where the range
    cuts it; no blur where the kind is none.
    """
    rows = ranges.join(fits.select("condition", F.col("value").alias("_fit"), F.col("source").alias("_source")), "condition", "left")
    raw = F.coalesce("_fit", (F.col("low") + F.col("high")) / 2)
    cut = F.greatest(F.col("low"), F.least(raw, F.col("high")))
    name = F.concat(F.when(F.col("_fit").isNull(), "provisional").otherwise(F.coalesce("_source", F.lit("fit"))), F.when(cut != raw, "+clipped").otherwise(""))
    blurred = F.col("kind") != "none"
    return rows.select("condition", "kind", F.when(blurred, cut).otherwise(0.0).alias("frac"), F.when(blurred, name).otherwise("none").alias("source"))


def paired(rows: DataFrame, others: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """`rows` with the partner's `after` and ratio, after over before; both null where there is no partner."""
    return rows.join(others.select(*keys, after), keys, "left").withColumn("ratio", F.try_divide(after, F.when(F.col(before) != 0, F.col(before))))


def headroom(values: DataFrame, keys: list[str], run: str, value: str, anchor: str, ceiling: str) -> DataFrame:
    """Each run's value less the anchor's and its share of the way from anchor to ceiling, null without a way."""
    at = lambda name: values.filter(F.col(run) == name).select(*keys, F.col(value).alias(f"_{name}"))
    rows = values.join(at(anchor), keys, "left").join(at(ceiling), keys, "left")
    delta = F.col(value) - F.col(f"_{anchor}")
    return rows.select(*keys, run, value, delta.alias("delta"), F.try_divide(delta, F.col(f"_{ceiling}") - F.col(f"_{anchor}")).alias("share"))
