"""Filters that are sums over a window of samples or over groups."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fir(signal: DataFrame, taps: Sequence[float], centre: int = 0, block: int = 4096) -> DataFrame:
    """y[t] = sum of taps[k] * x[t + centre - k], nought outside. Channels are cut into blocks of time whose first and last
    samples are also sent to the neighbours, so that one channel's filter runs in many tasks (a window ordered by time
    over a whole channel would be one)."""
    n = len(taps)
    behind, ahead = n - 1 - centre, centre
    b = F.floor(F.col("t") / block)
    placed = signal.select("channel", "t", "value", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("t") - ahead) / block), F.floor((F.col("t") + behind) / block))).alias("_b"))
    order = Window.partitionBy("channel", "_b").orderBy("t")
    total = None
    for k, w in enumerate(taps):
        move = centre - k
        near = F.lead("value", move) if move > 0 else F.lag("value", -move)
        x = F.col("value") if move == 0 else F.coalesce(near.over(order), F.lit(0.0))
        term = x * float(w)
        total = term if total is None else total + term
    return placed.withColumn("value", total).where(b == F.col("_b")).select("channel", "t", "value")


def moving_average_taps(n: int) -> list[float]:
    return [1.0 / n] * n


def odd(n: float) -> int:
    k = max(1, round(n))
    return k if k % 2 else k + 1


def reflect(signal: DataFrame, half: int) -> DataFrame:
    """A signal with ``half`` mirrored samples beyond either end (the end sample itself is doubled)."""
    last = signal.groupBy("channel").agg(F.max("t").alias("_last"))
    both = signal.join(F.broadcast(last), "channel")
    left = both.where(F.col("t") < half).select("channel", (-F.col("t") - 1).alias("t"), "value")
    right = both.where(F.col("t") > F.col("_last") - half).select("channel", (2 * F.col("_last") + 1 - F.col("t")).alias("t"), "value")
    return signal.select("channel", "t", "value").unionByName(left).unionByName(right)


def ma_highpass(signal: DataFrame, fc: float) -> DataFrame:
    """Samples less their moving average over an odd length of about 1 / fc, edges mirrored."""
    half = odd(1 / fc) // 2
    n = 2 * half + 1
    shifted = reflect(signal, half).withColumn("t", F.col("t") + half)
    mean = fir(shifted, moving_average_taps(n), half).select("channel", (F.col("t") - half).alias("t"), F.col("value").alias("_m"))
    return signal.join(mean, ["channel", "t"]).select("channel", "t", (F.col("value") - F.col("_m")).alias("value"))


def savgol_taps(window: int, order: int, deriv: int = 0, rate: float = 1.0) -> list[float]:
    """Least-squares polynomial over an odd window: the weights of the value (or a derivative) in the middle, in order of
    a convolution."""
    import numpy as np

    if window % 2 == 0 or window <= order:
        raise ValueError("the window is odd and longer than the order")
    h = window // 2
    a = np.vander(np.arange(-h, h + 1), order + 1, increasing=True)
    return (np.linalg.pinv(a)[deriv][::-1] * rate**deriv * math.factorial(deriv)).tolist()


def savgol(signal: DataFrame, window: int, order: int, deriv: int = 0, rate: float = 1.0, smoothing: bool = True) -> DataFrame:
    taps = savgol_taps(window, order, deriv, rate)
    if not smoothing:
        taps = [-x for x in taps]
        taps[window // 2] += 1
    return fir(signal, taps, window // 2)


def detrend(signal: DataFrame, length: int, kind: str = "linear") -> DataFrame:
    """Each block less its line or its mean; fitted by aggregates, joined back by block."""
    placed = signal.withColumn("_b", F.floor(F.col("t") / length).cast("long"))
    keys = ["channel", "_b"]
    fit = placed.groupBy(*keys).agg(F.avg("value").alias("_m"), F.avg("t").alias("_c"), F.coalesce(F.regr_slope("value", "t"), F.lit(0.0)).alias("_s"))
    line = F.col("_m") + (F.col("_s") * (F.col("t") - F.col("_c")) if kind == "linear" else 0)
    return placed.join(fit, keys).select("channel", "t", (F.col("value") - line).alias("value"))


def rereference(signal: DataFrame, how: str = "common", reference: DataFrame | None = None) -> DataFrame:
    """Less the mean of all channels (``common``), of a vector (t, reference), or the regression on the mean (``regress``)."""
    if how == "regress":
        return regress_common(signal)
    if reference is None:
        reference = signal.groupBy("t").agg(F.avg("value").alias("reference"))
    return signal.join(reference, "t").select("channel", "t", (F.col("value") - F.col("reference")).alias("value"))


def regress_common(signal: DataFrame) -> DataFrame:
    """Less each channel's projection on the common mean."""
    mean = signal.groupBy("t").agg(F.avg("value").alias("_r"))
    both = signal.join(mean, "t")
    beta = both.groupBy("channel").agg((F.sum(F.col("value") * F.col("_r")) / F.sum(F.col("_r") * F.col("_r"))).alias("_b"))
    return both.join(F.broadcast(beta), "channel").select("channel", "t", (F.col("value") - F.col("_b") * F.col("_r")).alias("value"))


def harmonic_cancel(signal: DataFrame, f0: float, fs: float, stdevs: float = 2.0) -> DataFrame:
    """Less the cosine and sine of one frequency, fitted on samples within some standard deviations."""
    spread = signal.groupBy("channel").agg(F.stddev_pop("value").alias("_s"), F.count("*").alias("_n"))
    angle = F.col("t") * (2 * math.pi * f0 / fs)
    both = signal.join(F.broadcast(spread), "channel")
    clean = F.when(F.abs("value") <= stdevs * F.col("_s"), F.col("value")).otherwise(0.0)
    fit = both.groupBy("channel").agg((F.sum(clean * F.cos(angle)) * 2 / F.first("_n")).alias("_c"), (F.sum(clean * F.sin(angle)) * 2 / F.first("_n")).alias("_d"))
    return signal.join(F.broadcast(fit), "channel").select("channel", "t", (F.col("value") - F.col("_c") * F.cos(angle) - F.col("_d") * F.sin(angle)).alias("value"))
