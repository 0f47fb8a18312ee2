"""Range joins as equi-joins: time is cut into buckets, an interval is copied to each bucket it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucketed(samples: DataFrame, intervals: DataFrame, start: Column, stop: Column, length: int, t: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
    """Samples with every interval [start, stop) that holds their ``t``.

    The plain condition would be a nested loop; with the bucket it is an equi-join with a residual predicate. A sample
    lies in one bucket, so no pair comes twice. ``length`` near the usual interval keeps copies at one to three.
    Intervals are usually few: Spark broadcasts them by their size; if they are many, both sides are shuffled by bucket.
    """
    copies = intervals.withColumn("_start", start).withColumn("_stop", stop)
    copies = copies.where("_stop > _start and _stop > 0").withColumn("_bucket", F.explode(F.sequence(F.floor(F.greatest(F.col("_start"), F.lit(0)) / length).cast("long"), F.floor((F.col("_stop") - 1) / length).cast("long"))))
    placed = samples.withColumn("_bucket", F.floor(F.col(t) / length).cast("long"))
    joined = placed.join(copies, [*by, "_bucket"])
    return joined.where((F.col(t) >= F.col("_start")) & (F.col(t) < F.col("_stop"))).drop("_bucket", "_start", "_stop")
