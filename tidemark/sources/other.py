"""Impedance texts, stimulus XML, raw binary, multiplexed channels."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_binary(spark: SparkSession, path: str, channels: int, dtype: str = "<i2", scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """Flat sample-major files as (path, channel, t, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                x = np.frombuffer(raw, dtype)
                x = x[: len(x) // channels * channels].reshape(-1, channels)
                for at in range(0, len(x), 65536):
                    part = x[at : at + 65536]
                    yield pa.RecordBatch.from_arrays([pa.array([p] * part.size), pa.array(np.tile(np.arange(channels), len(part))), pa.array(np.repeat(np.arange(at, at + len(part)), channels)), pa.array((part.astype(float).ravel() + offset) * scale)], ["path", "channel", "t", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, channel long, t long, value double")


def impedance_text(spark: SparkSession, path: str, mag_scale: float = 1e6) -> DataFrame:
    """(site, frequency_no, magnitude, phase) from tab-separated texts: three header lines and a footer, magnitude and
    phase columns in turn."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\t"))
    cells = lines.select(F.split(F.trim("value"), "\t").alias("c"))
    pairs = cells.select(F.element_at("c", 1).cast("long").alias("site"), F.posexplode(F.transform(F.sequence(F.lit(2), F.size("c") - 1, F.lit(2)), lambda i: F.struct(F.get("c", i - 1).cast("double").alias("m"), F.get("c", i).cast("double").alias("p")))).alias("frequency_no", "x"))
    return pairs.select("site", "frequency_no", (F.col("x.m") * mag_scale).alias("magnitude"), F.col("x.p").alias("phase"))


def polar(magnitude, degrees):
    """A complex number as a struct."""
    angle = F.radians(degrees)
    return F.struct((magnitude * F.cos(angle)).alias("re"), (magnitude * F.sin(angle)).alias("im"))


def stimulus_passes(spark: SparkSession, path: str, fields: Mapping[str, int], skip_blocks: tuple[int, ...] = ()) -> DataFrame:
    """``Pass`` elements of stimulus XML: their attributes and chosen places of their child's comma-separated ``Data``."""
    rows = spark.read.format("xml").option("rowTag", "Pass").load(path)
    if skip_blocks and "_BlockID" in rows.columns:
        rows = rows.where(~F.col("_BlockID").isin(list(skip_blocks)))
    attributes = [F.col(c).alias(c[1:]) for c in rows.columns if c.startswith("_")]
    data = F.split(F.col("Event")["_Data"] if "Event" in rows.columns else F.lit(""), ",")
    return rows.select(*attributes, *(F.get(data, F.lit(k)).try_cast("double").alias(name) for name, k in fields.items()))


def demultiplex(signal: DataFrame, n_rows: int, permutation: Mapping[int, int] | None = None, gain: float = 1.0) -> DataFrame:
    """Multiplexed channels as (row, col): column order undone, values divided by the gain."""
    col = F.floor(F.col("channel") / n_rows).cast("long")
    if permutation:
        col = F.element_at(F.create_map(*[F.lit(int(x)) for kv in permutation.items() for x in kv]), col.cast("int")).cast("long")
    return signal.select((F.col("channel") % n_rows).alias("row"), col.alias("col"), "t", (F.col("value") / gain).alias("value"))


def average_oversampled(signal: DataFrame, k: int = 2) -> DataFrame:
    """Neighbouring channels that are one electrode sampled k times, averaged."""
    return signal.groupBy(F.floor(F.col("channel") / k).cast("long").alias("channel"), "t").agg(F.avg("value").alias("value"))


def trigger_report(signal: DataFrame) -> DataFrame:
    """For each channel: rising edges over 40 % of the median high level, and whether it is a two-level signal.
    A channel that never leaves nought has no edge and no two levels."""
    tops = signal.groupBy("channel").agg(F.max("value").alias("top"))
    level = tops.agg((F.percentile("top", F.lit(0.5)) * 0.4).alias("level"))
    placed = signal.crossJoin(F.broadcast(level)).withColumn("on", F.col("value") > F.col("level"))
    spread = placed.groupBy("channel", "on").agg(F.var_pop("value").alias("v"), F.count("*").alias("n"))
    binary = spread.groupBy("channel").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).join(tops, "channel").select("channel", ((F.col("top") != 0) & (F.col("v") <= 1e-2 * F.col("top") * F.col("top"))).alias("binary"))
    on = placed.where("on").select("channel", "t")
    edges = on.where("t > 0").join(on.select("channel", (F.col("t") + 1).alias("t")), ["channel", "t"], "left_anti").groupBy("channel").agg(F.count("*").alias("edges"))
    return binary.join(edges, "channel", "left").select("channel", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"), "binary")
