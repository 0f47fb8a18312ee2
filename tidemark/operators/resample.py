"""Rate conversion in SQL (R2, R4, R6, E13); the filters that go before it are in ``filters``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def new_length(n: int, r: int) -> int:
    """Samples left of ``n`` at every r-th."""
    if r != int(r) or r <= 1:
        raise ValueError("the ratio is a whole number over 1")
    return -(-n // int(r))


def decimate(signal: DataFrame, r: int) -> DataFrame:
    return signal.where(F.col("t") % r == 0).withColumn("t", (F.col("t") / r).cast("long"))


def aggregate(signal: DataFrame, r: int, n_times: int, tail: str = "zero") -> DataFrame:
    """Sums of r samples. What is left at the end is dropped and its output 0 (``zero``), or summed (``sum``)."""
    whole = n_times // r
    value = F.sum("value") if tail == "sum" else F.sum(F.when(F.floor(F.col("t") / r) < whole, F.col("value")).otherwise(0.0))
    return signal.groupBy("channel", F.floor(F.col("t") / r).cast("long").alias("t")).agg(value.alias("value"))


def pair_average(signal: DataFrame) -> DataFrame:
    """Mean of samples 2k and 2k + 1."""
    return signal.groupBy("channel", F.floor(F.col("t") / 2).cast("long").alias("t")).agg(F.avg("value").alias("value"))


def upsample_linear(signal: DataFrame, r: int) -> DataFrame:
    """r samples for each, on the line to the next one; the last sample is held."""
    after = F.lead("value").over(Window.partitionBy("channel").orderBy("t"))
    steps = signal.withColumn("_next", F.coalesce(after, F.col("value"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    return steps.select("channel", (F.col("t") * r + F.col("_k")).cast("long").alias("t"), (F.col("value") + (F.col("_next") - F.col("value")) * F.col("_k") / r).alias("value"))
