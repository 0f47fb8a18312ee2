"""Stimulus conditions of events (X1-X11), orders of trials (R7, R8). Tables have event_no and a column for each feature."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.events import interval_percentiles, intervals


def uniques(events: DataFrame, feature: str) -> DataFrame:
    """Different values of a feature and their rank from 0 (a small table)."""
    return events.select(feature).distinct().select(feature, (F.row_number().over(Window.orderBy(feature)) - 1).cast("long").alias("rank"))


def check_features(events: DataFrame, features: Sequence[str]) -> None:
    missing = [f for f in features if f not in events.columns]
    if missing:
        raise ValueError(f"no tables for {missing}")


def rolled_shape(events: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count of different values, feature by feature, in one row."""
    check_features(events, features)
    return events.agg(*(F.count_distinct(f).cast("long").alias(f"n_{f}") for f in features))


def conditions(events: DataFrame, features: Sequence[str]) -> DataFrame:
    """Events with their condition: ranks of the features as digits, the first one most significant, from 0. Without
    features every event has condition 1."""
    check_features(events, features)
    if not features:
        return events.withColumn("condition", F.lit(1).cast("long"))
    out, sizes = events, rolled_shape(events, features)
    for f in features:
        out = out.join(F.broadcast(uniques(events, f).withColumnRenamed("rank", f"_{f}")), f)
    out = out.crossJoin(F.broadcast(sizes))
    code = F.lit(0).cast("long")
    for f in features:
        code = code * F.col(f"n_{f}") + F.col(f"_{f}")
    return out.withColumn("condition", code).select(*events.columns, "condition")


def decode_table(events: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every combination of the features' values, whether it occurs or not, with its condition."""
    sizes = rolled_shape(events, features)
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [uniques(events, f).withColumnRenamed("rank", f"_{f}") for f in features]).crossJoin(F.broadcast(sizes))
    code = F.lit(0).cast("long")
    for f in features:
        code = code * F.col(f"n_{f}") + F.col(f"_{f}")
    return out.select(code.alias("condition"), *features)


def iterate_for(events: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each combination with the count of its events and the sum of their stamps' places (empty ones too)."""
    counted = events.groupBy(*features).agg(F.count("*").alias("n"), F.min("event_no").alias("first_event"))
    return decode_table(events, features).join(counted, list(features), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def order_for(events: DataFrame, feature: str) -> DataFrame:
    """Events with their place when trials are grouped by a feature's values (a rank within each value and the start of
    the value: one sort for each value, not one for all)."""
    within = F.row_number().over(Window.partitionBy(feature).orderBy("event_no")) - 1
    before = Window.orderBy(feature).rowsBetween(Window.unboundedPreceding, -1)
    starts = events.groupBy(feature).agg(F.count("*").alias("_n")).select(feature, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return events.withColumn("_k", within).join(F.broadcast(starts), feature).withColumn("place", (F.col("_start") + F.col("_k")).cast("long")).select(*events.columns, "place")


def ordered_epochs(events: DataFrame, fixed: Mapping[str, object], features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Events that have the fixed values, in the order of the other features' combinations; and the size of each
    combination, 0 included."""
    own = reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), fixed.items(), events)
    rest = [f for f in features if f not in fixed]
    coded = own.join(F.broadcast(decode_table(events, rest)), rest)
    sizes = decode_table(events, rest).join(own.groupBy(*rest).agg(F.count("*").alias("size")), rest, "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    return coded.orderBy("condition", "event_no"), sizes


def repeat_sequences(stamps: DataFrame, sequences: Mapping[str, Sequence | object]) -> DataFrame:
    """Cycle each sequence (or one value) over the events; ``stamps`` has event_no from 0."""
    columns: list[Column] = []
    for name, values in sequences.items():
        own = list(values) if isinstance(values, (list, tuple, range)) else [values]
        columns.append(F.element_at(F.array(*map(F.lit, own)), (F.col("event_no") % len(own) + 1).cast("int")).alias(name))
    return stamps.select("*", *columns)


def tonotopy(stamps: DataFrame, tones: Sequence[float] | None = None, amps: Sequence[float] | None = None, rotate: bool = False) -> DataFrame:
    """Tones and amplitudes cycled over events; ``rotate`` moves the amplitudes on by one."""
    tones = list(tones or [1000 * 2 ** (k / 6) for k in range(13) for _ in range(3)])
    amps = list(amps or [50, 60, 70] * 13)
    return repeat_sequences(stamps, {"tone": tones, "amp": amps[-1:] + amps[:-1] if rotate else amps})


def fix_triggers(stamps: DataFrame, expected: int, n: int | None = None) -> DataFrame:
    """Stamps (t) with a first one put in front, a median interval before, if one is missing; fewer are an error.
    ``n``: their number, if it is known."""
    n = stamps.count() if n is None else n
    if n >= expected:
        return stamps
    if n < expected - 1:
        raise RuntimeError(f"{n} stamps for {expected} events")
    isi = interval_percentiles(intervals(stamps.select("t")), [50]).select(F.col("_p0").alias("isi"))
    first = stamps.agg(F.min("t").alias("t")).crossJoin(isi).select((F.col("t") - F.col("isi")).alias("t"))
    return first.unionByName(stamps.select(F.col("t").cast("double").alias("t")))


def subset(events: DataFrame, numbers: Sequence[int]) -> DataFrame:
    return events.where(F.col("event_no").isin(list(numbers)))


def build(kind: str, stamps: DataFrame, **options: object) -> DataFrame:
    """An experiment by the name of its kind in a session's configuration."""
    if kind == "tonotopy":
        return tonotopy(stamps, options.get("tones"), options.get("amps"), bool(options.get("rotate")))
    if kind == "simple":
        return repeat_sequences(stamps, {k: v for k, v in options.items()})
    if kind == "auto":
        return tonotopy(stamps, options.get("tones"), options.get("amps")) if "tones" in options else repeat_sequences(stamps, options)
    raise ValueError(f"no experiment of kind {kind!r}")


def stim_label(kind: str) -> Column:
    """Text of a stimulus: tone (tone, amp), flicker (contrast), wedge (angle), ring (radius), noise (x, y, contrast)."""
    if kind == "tone":
        text = F.when(F.col("tone") >= 1000, F.format_string("%.1f KHz", F.col("tone") / 1000)).otherwise(F.format_string("%.0f Hz", F.col("tone")))
        return F.when(F.col("amp").isNull(), text).otherwise(F.concat(text, F.format_string(" (%d)", F.col("amp").cast("long"))))
    if kind == "wedge":
        return F.format_string("%.2f deg", "angle")
    if kind == "ring":
        return F.format_string("%.2f dva", "radius")
    if kind == "noise":
        shade = F.when(F.col("contrast") < 0, "dark").when(F.col("contrast") > 0, "bright").otherwise("mean")
        return F.format_string("(%d, %d) %s", F.col("x").cast("long"), F.col("y").cast("long"), shade)
    raise ValueError(kind)
