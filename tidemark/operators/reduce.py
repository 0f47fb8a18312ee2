"""Reductions over channels, time or both (F-1 to F-17), fences, ROC, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: axis -> grouping columns: 0 over channels, 1 over time, None over all.
AXES = {0: ["t"], 1: ["channel"], -1: ["channel"], -2: ["t"], None: []}


def ratio(a: Column, b: Column) -> Column:
    """a / b as numpy divides: NaN for 0 / 0, infinity for the rest of / 0; null stays null."""
    over_zero = F.when((a == 0) | F.isnan(a.cast("double")), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, over_zero).otherwise(a / b)


def extreme(how: str, value: str = "value") -> Column:
    """min or max in which NaN wins, as in numpy."""
    nan = F.bool_or(F.isnan(value))
    return F.when(nan, F.lit(float("nan"))).otherwise(F.min(value) if how == "min" else F.max(value))


def variance(ddof: int = 0, value: str = "value") -> Column:
    """Stable variance with any correction."""
    if ddof == 0:
        return F.var_pop(value)
    if ddof == 1:
        return F.var_samp(value)
    return F.var_pop(value) * F.count(value) / F.when(F.count(value) > ddof, F.count(value) - ddof)


def reduce_axis(signal: DataFrame, axis: int | None = None, ddof: int = 0) -> DataFrame:
    """min, max, sum, mean, var and std along an axis: partial aggregates in the map tasks, one shuffle of partials."""
    v = variance(ddof)
    return signal.groupBy(*AXES[axis]).agg(extreme("min").alias("min"), extreme("max").alias("max"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), v.alias("var"), F.sqrt(v).alias("std"))


#: Relative accuracy of the brackets in which order statistics are looked for.
ACCURACY = 1000


def order_statistics(df: DataFrame, by: Sequence[str], ps: Sequence[float], value: str = "value", nearest: bool = False) -> DataFrame:
    """Exact percentiles of each group as _p0, _p1, ..., without sorting or holding a group: a sketch brackets each rank
    (some thousandths of a group; a group of under 4 x ``ACCURACY`` values whole), what lies below is counted, and only
    different values inside the bracket, with their counts, are ordered. ``nearest``: sorted[round(n p / 100)], else
    linear interpolation."""
    e = 2 / ACCURACY
    edges = [min(1.0, max(0.0, q)) for p in ps for q in (p / 100 - e, p / 100 + e)]
    sketch = df.groupBy(*by).agg(F.count(value).alias("_n"), F.percentile_approx(value, edges, ACCURACY).alias("_q"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    joined = df.join(sketch, list(by)) if by else df.crossJoin(F.broadcast(sketch))
    small = F.col("_n") < 4 * ACCURACY
    lows = [F.when(small, F.col("_min")).otherwise(F.col("_q")[2 * k]) for k in range(len(ps))]
    highs = [F.when(small, F.col("_max")).otherwise(F.col("_q")[2 * k + 1]) for k in range(len(ps))]
    x = F.col(value)
    below = joined.groupBy(*by).agg(F.first("_n").alias("_n"), F.array(*(F.count_if(x < low) for low in lows)).alias("_below"))
    inside = joined.select(*by, value, F.explode(F.array_compact(F.array(*(F.when((x >= a) & (x <= b), F.lit(k)) for k, (a, b) in enumerate(zip(lows, highs)))))).alias("_i"))
    counted = inside.groupBy(*by, "_i", value).agg(F.count("*").alias("_c"))
    counted = counted.join(below, list(by)) if by else counted.crossJoin(F.broadcast(below))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_i").orderBy(value)) + F.col("_below")[F.col("_i")]
    share = F.array(*(F.lit(p / 100) for p in ps))[F.col("_i")]
    place = F.least(F.rint(F.col("_n") * share), F.col("_n") - 1.0) if nearest else (F.col("_n") - 1) * share
    ranked = counted.select(*by, "_i", value, "_c", upto.alias("_upto"), place.alias("_at"))
    holds = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
    pair = ranked.groupBy(*by, "_i").agg(F.first("_at").alias("_at"), F.max(F.when(holds(F.floor("_at")), x)).alias("_a"), F.max(F.when(holds(F.ceil("_at")), x)).alias("_b"))
    up = F.col("_at") - F.floor("_at")
    found = pair.select(*by, "_i", F.when(up == 0, F.col("_a")).otherwise((1 - up) * F.col("_a") + up * F.col("_b")).alias("_v"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("_i") == k, F.col("_v"))).alias(f"_p{k}") for k in range(len(ps))))


def percentile_nearest(df: DataFrame, by: Sequence[str], p: float, value: str = "value") -> DataFrame:
    """sorted[round(n * p / 100)] of each group (no group is sorted or gathered)."""
    return order_statistics(df, by, [p], value, nearest=True).select(*by, F.col("_p0").alias("prctile"))


def percentile_linear(df: DataFrame, by: Sequence[str], ps: Sequence[float], value: str = "value") -> DataFrame:
    """Interpolated percentiles without NaN."""
    found = order_statistics(df.where(~F.isnan(value)), by, ps, value)
    return found.select(*by, *(F.col(f"_p{k}").alias(f"p{p:g}") for k, p in enumerate(ps)))


def fences(df: DataFrame, by: Sequence[str], value: str = "value", quantiles: tuple[float, float] = (25, 75), thresh: float = 3.0, sides: str = "both") -> DataFrame:
    """``inlier``: whether a value is strictly between Tukey's fences of its group; NaN is an outlier. Where the
    quartiles are equal, thresh * upper quartile is the range. ``sides='upper'`` has no lower fence."""
    lo, hi = quantiles
    at = order_statistics(df.where(~F.isnan(value)), by, [lo, hi], value).withColumnsRenamed({"_p0": "_lo", "_p1": "_hi"})
    joined = df.join(at, list(by), "left") if by else df.crossJoin(F.broadcast(at))
    reach = thresh * (F.col("_hi") - F.col("_lo")) / 2
    reach = F.when(F.col("_hi") == F.col("_lo"), thresh * F.col("_hi")).otherwise(reach)
    inlier = F.col(value) < F.col("_hi") + reach
    if sides == "both":
        inlier = inlier & (F.col(value) > F.col("_lo") - reach)
    return joined.withColumn("inlier", F.coalesce(inlier & ~F.isnan(value), F.lit(False))).drop("_lo", "_hi")


#: Ranges of thresholds at most, and rows of one.
RANGES, RANGE_ROWS = 256, 100_000


def roc(null: DataFrame, sig: DataFrame, value: str = "value") -> DataFrame:
    """(threshold, fp, tp): shares of each set at or above every value that occurs."""
    both = null.select(F.col(value).alias("threshold"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(sig.select(F.col(value).alias("threshold"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    steps = both.groupBy("threshold").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # ranges of thresholds, each summed in its own task; what lies above a range comes from a small table of totals
    n, edges = both.agg(F.count("*"), F.percentile_approx("threshold", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()
    edges = sorted(set(edges or []))[:: max(1, RANGES * RANGE_ROWS // max(1, n))]
    placed = steps.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col("threshold"))))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_range").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    starts = sums.select("_range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("_a", "_b")))
    total = steps.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    inside = Window.partitionBy("_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("threshold", "_range", F.sum("a").over(inside).alias("a"), F.sum("b").over(inside).alias("b")).join(starts, "_range").crossJoin(F.broadcast(total))
    return summed.select("threshold", ratio(F.col("_a") + F.col("a"), F.col("na")).alias("fp"), ratio(F.col("_b") + F.col("b"), F.col("nb")).alias("tp"))


def integrate_roc(points: Sequence[tuple[float, float]]) -> float:
    """Area under (fp, tp) points: repeated x dropped, ends added, trapezoids."""
    import numpy as np

    pts = np.array(sorted({float(x): float(y) for x, y in sorted(points)}.items()))
    pts = np.concatenate(([[0, 0]] if pts[0, 0] > 0 else np.zeros((0, 2)), pts, [[1, 1]] if pts[-1, 0] < 1 else np.zeros((0, 2))))
    return float(np.trapezoid(pts[:, 1], pts[:, 0]))


def pad_groups(df: DataFrame, group: str, order: Sequence[str], value: str = "value", fill: float | None = None) -> DataFrame:
    """Groups of different sizes as a rectangle (group, k, value): missing places get ``fill``."""
    numbered = df.select(group, (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long").alias("k"), value)
    sizes = numbered.groupBy(group).agg(F.max("k").alias("n"))
    most = sizes.agg(F.max("n").alias("most"))
    grid = sizes.select(group).crossJoin(F.broadcast(most)).select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("k"))
    out = grid.join(numbered, [group, "k"], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def _grouped(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Rows beside their group's aggregates: a small aggregate joined back, so that no group is sorted in one task."""
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))
    return df.join(df.groupBy(*by).agg(*aggregates), list(by))


def normalise(df: DataFrame, by: Sequence[str], how: str, value: str = "value") -> DataFrame:
    """unity: (x - min) / (max - min); density: x / sum; center: (x - mean) / population sd; sphere: x / norm.
    A constant or zero group divides by nought, as in numpy: NaN or infinity."""
    x = F.col(value)
    if how == "unity":
        out, new = _grouped(df, by, F.min(value).alias("_a"), F.max(value).alias("_b")), ratio(x - F.col("_a"), F.col("_b") - F.col("_a"))
    elif how == "density":
        out, new = _grouped(df, by, F.sum(F.when(~F.isnan(value), x)).alias("_a"), F.lit(0).alias("_b")), ratio(x, F.col("_a"))
    elif how == "center":
        out, new = _grouped(df, by, F.avg(value).alias("_a"), F.stddev_pop(value).alias("_b")), ratio(x - F.col("_a"), F.col("_b"))
    elif how == "sphere":
        out, new = _grouped(df, by, F.sqrt(F.sum(x * x)).alias("_a"), F.lit(0).alias("_b")), ratio(x, F.col("_a"))
    else:
        raise ValueError(how)
    return out.withColumn(value, new).select(*df.columns)


def quantize(df: DataFrame, by: Sequence[str] = (), scale: int = 255, value: str = "value") -> DataFrame:
    """0..scale between a group's least and greatest value, halves to even; ``lo`` and ``hi`` undo it.
    A constant group is all at level 0."""
    out = _grouped(df, by, F.min(value).alias("lo"), F.max(value).alias("hi"))
    return out.withColumn("level", F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.rint((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * scale)).cast("long"))


def rescale(df: DataFrame, scale: int = 255) -> DataFrame:
    return df.withColumn("value", F.col("level") / scale * (F.col("hi") - F.col("lo")) + F.col("lo"))


def auto_level(df: DataFrame, value: str = "value", most: int = 1000) -> float | None:
    """A trigger's high level: samples over the mean, again and again, until at most ``most`` are left (or the rest is
    clipped, then a little below it). A job for each round, few rounds; only three numbers reach the driver."""
    low = None
    while True:
        now = df if low is None else df.where(F.col(value) > low)
        n, mean, top = now.agg(F.count("*"), F.avg(value), F.max(value)).first()
        if not n:
            return low
        if n <= most:
            return mean
        if mean >= top:
            return 0.99 * top
        low = mean
