"""Scalar functions: units, sessions, labels, typed parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIXES = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3}


def nice_unit(unit: Column) -> Column:
    low = F.lower(unit)
    return F.when(low == "uv", "μV").when(low == "sigma", "σ").otherwise(unit)


def scale_of(unit: str) -> float:
    """Factor of a unit's SI prefix ("uV" -> 1e-6, "V" -> 1)."""
    return PREFIXES.get(unit[0], 1.0) if len(unit) == 2 else 1.0


def convert_scale(x: Column, old: str, new: str) -> Column:
    factor = scale_of(old) / scale_of(new)
    return x if factor == 1 else x * factor


def _range(r: float | tuple[float, float]) -> tuple[float, float]:
    return r if isinstance(r, tuple) else (min(0.0, r), max(0.0, r))


def convert_range(x: Column, old: float | tuple[float, float], new: float | tuple[float, float]) -> Column:
    """An affine map of one range to another; a single number is a range from nought."""
    (a, b), (c, d) = _range(old), _range(new)
    return (x - a) * ((d - c) / (b - a)) + c


def scaled(raw: Column, offset: float = 0.0, scale: float = 1.0) -> Column:
    """(raw + offset) * scale as doubles, without the steps that change nothing."""
    x = raw.cast("double")
    x = x + offset if offset else x
    return x * scale if scale != 1 else x


def scaling_step(x: float, up: bool = True, lower: float = 1.0, upper: float = 100.0) -> tuple[float, float]:
    """(step, factor): x rescaled by thousands into [lower, upper], and a 1-2-5 step of about a fifth of it."""
    factor = 1.0
    while x * factor < lower:
        factor *= 1e3
    while up and x * factor > upper:
        factor /= 1e3
    rough = x * factor / 5
    base = 10 ** math.floor(math.log10(rough))
    step = min((m for m in (1, 2, 5, 10) if m * base >= rough * 0.999), default=10) * base
    return step, factor


def next_power(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("long")


def session_days(sessions: DataFrame, name: str = "name", reference: str | None = None, sortable: bool = False) -> DataFrame:
    """Days of session names (a date YYYY-MM-DD in each) since the first or since ``reference``, and a label; a name
    without a date is an error."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    date = F.when(found == "", F.raise_error(F.format_string("no date in %s", name)).cast("date")).otherwise(F.to_date(found))
    dated = sessions.withColumn("_date", date)
    first = F.lit(reference).cast("date") if reference else F.col("_first")
    if not reference:
        dated = dated.crossJoin(F.broadcast(dated.agg(F.min("_date").alias("_first"))))
    dated = dated.withColumn("days", F.datediff("_date", first).cast("long"))
    if not sortable:
        return dated.withColumn("label", F.format_string("Day %d", "days")).drop("_date", "_first")
    width = dated.agg(F.max(F.length(F.col("days").cast("string"))).alias("_w"))
    return dated.crossJoin(F.broadcast(width)).withColumn("label", F.concat(F.lit("Day "), F.lpad(F.col("days").cast("string"), F.col("_w"), F.lit("0")))).drop("_date", "_first", "_w")


def regex_capture(df: DataFrame, column: str, pattern: str, group: int = 1) -> DataFrame:
    """Capture group of the rows that match."""
    return df.where(F.col(column).rlike(pattern)).withColumn("captured", F.regexp_extract(column, pattern, group))


def parse(text: Column, kind: str) -> Column:
    """Typed value of a configuration text: bool_or_num (double), sequence (array<double>), none_or_str, path."""
    clean = F.trim(text)
    if kind == "bool_or_num":
        low = F.lower(clean)
        return F.when(low.isin("true", "yes", "on"), 1.0).when(low.isin("false", "no", "off"), 0.0).otherwise(clean.try_cast("double"))
    if kind == "sequence":
        inner = F.regexp_replace(clean, r"[()\[\]\s]", "")
        return F.transform(F.filter(F.split(inner, ","), lambda x: x != ""), lambda x: x.try_cast("double"))
    if kind == "none_or_str":
        return F.when(F.lower(clean).isin("none", ""), None).otherwise(clean)
    if kind == "path":
        import os

        return F.when(clean.startswith("~"), F.concat(F.lit(os.path.expanduser("~")), F.substring(clean, 2, 1 << 30))).otherwise(clean)
    raise ValueError(kind)


def swap_values(value: Column, swaps: dict[str, str]) -> Column:
    out = value
    for old, new in swaps.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def session_table(conf: DataFrame, required: list[str] = ()) -> DataFrame:
    """One row for each recording from (section, key, value): keys as columns, 'unknown' where one is missing."""
    keys = sorted({r[0] for r in conf.select(F.lower("key")).distinct().collect()} | set(required))
    low = conf.withColumn("key", F.lower("key"))
    wide = low.groupBy("section").pivot("key", keys).agg(F.first("value"))
    return wide.select("section", *(F.coalesce(F.col(f"`{k}`"), F.lit("unknown")).alias(k) for k in keys))


def impedance_yield(df: DataFrame, by: list[str], open_at: float, short_at: float, value: str = "value") -> DataFrame:
    """Share of electrodes that are neither open nor shorted, in percent."""
    bad = (F.col(value) > open_at) | (F.col(value) < short_at)
    return df.groupBy(*by).agg((100 * (1 - F.count_if(bad) / F.count("*"))).alias("yield_pct"))
