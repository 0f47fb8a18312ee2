"""Trigger edges, debouncing, epochs and their averages."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import reduce
from tidemark.plans import ordered
from tidemark.plans.rangejoin import bucketed


def any_level(trig: DataFrame, thresh: float) -> DataFrame:
    """Multichannel trigger signals as one logic level over time: on if any channel is over the threshold."""
    return trig.groupBy("t").agg(F.bool_or(F.col("value") > thresh).alias("level"))


def rising_edges(level: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Times at which a level goes on; a level that begins on has no edge there. Each sample meets the one before it in an
    equi-join, so the time axis is sorted nowhere; behind a gap there is no sample before, so no edge."""
    before = level.where("not level").select(*by, (F.col("t") + 1).alias("t"))
    return level.where("level").select(*by, "t").join(before, [*by, "t"], "left_semi")


def rising_edges_sparse(on: DataFrame) -> DataFrame:
    """The same from the samples that are on only (a join with the sample before: no sort of the whole time axis)."""
    before = on.select((F.col("t") + 1).alias("t"))
    return on.select("t").where("t > 0").join(before, "t", "left_anti")


def intervals(edges: DataFrame) -> DataFrame:
    """(t, isi): distance to the edge before."""
    return ordered.preceded(edges, "isi").withColumn("isi", F.col("t") - F.col("isi")).where(F.col("isi").isNotNull())


def interval_percentiles(isi: DataFrame, ps: Sequence[float]) -> DataFrame:
    """Number of intervals as n and their exact percentiles as _p0, _p1, ... Intervals of sample numbers have few different
    values (n different ones are n^2 / 2 samples long), so an aggregate counts them; others are bracketed."""
    n = F.count("*").alias("n")
    if ordered.whole_numbers(isi, "isi"):
        return isi.agg(n, *(F.percentile("isi", F.lit(p / 100)).alias(f"_p{k}") for k, p in enumerate(ps)))
    return isi.agg(n).crossJoin(reduce.order_statistics(isi, [], ps, "isi"))


def isi_stats(edges: DataFrame) -> DataFrame:
    found = interval_percentiles(intervals(edges), [50, 90, 5, 95])
    return found.withColumnsRenamed({"_p0": "median", "_p1": "p90", "_p2": "p5", "_p3": "p95"})


def debounce(edges: DataFrame, isi: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges less those that follow a kept edge within isi / 2 (default: the 90th percentile of intervals). Keeping is
    greedy, but an edge that far behind the edge before it is kept whatever came before. So each run from such an edge to
    the next goes to the task of the span in which it begins; tasks take sorted edges one by one and hold a batch."""
    if isi is None:
        n, p90 = isi_stats(edges).select("n", "p90").first()
        if n < 2:
            return edges
        isi = p90
    half = float(isi) / 2
    rows = edges.select(*by, F.col("t").cast("long").alias("t"))
    columns, schema = rows.columns, rows.schema

    def keep(batches):
        own = last = None
        for batch in batches:
            kept = []
            for *key, t in zip(*(batch.column(c).to_pylist() for c in columns)):
                if key != own:
                    own, last = key, None
                kept.append(last is None or t - last >= half)
                if kept[-1]:
                    last = t
            yield batch.select(columns).filter(pa.array(kept, pa.bool_()))

    runs = ordered.runs(rows, half, by)
    return runs.repartition(*by, "_home").sortWithinPartitions(*by, "t").mapInArrow(keep, schema)


def process_trigger(trig: DataFrame, thresh: float = 0.5, uniform: bool = True, clean: bool = False) -> DataFrame:
    """Edges of analog trigger channels (channel, t, value): centred, thresholded at a share of the high level, or-ed
    over channels; ``uniform`` drops edges closer than the spread of intervals allows, ``clean`` debounces."""
    mean = trig.agg(F.avg("value")).first()[0]
    centred = trig.withColumn("value", F.col("value") - F.lit(mean))
    high = reduce.auto_level(centred)
    edges = rising_edges(any_level(centred, thresh * (high or 0.0)))
    if clean:
        return debounce(edges)
    if uniform:
        p5, p95 = isi_stats(edges).select("p5", "p95").first()
        if p5 is not None:
            least = p95 - (p95 - p5) / 0.9
            if least > 0:
                return debounce(edges, least)
    return edges


def epochs(signal: DataFrame, triggers: DataFrame, pre: int, post: int, n_times: int | None = None, fill: float | None = None, bounds: str = "drop") -> DataFrame:
    """Samples around triggers: (channel, k, dt, value), dt = t - k + pre. ``triggers`` has k (and more columns).

    Bounds: ``drop`` leaves out triggers whose window does not lie wholly before the last sample (from nought on; an
    epoch that ends at the last sample is dropped as well), ``fill`` keeps them with ``fill`` where there is no sample,
    ``keep`` keeps what samples there are.
    """
    if bounds == "drop":
        if n_times is None:
            n_times = signal.agg(F.max("t") + 1).first()[0] or 0
        triggers = triggers.where((F.col("k") - pre >= 0) & (F.col("k") + post < n_times))
    hit = bucketed(signal, triggers, F.col("k") - pre, F.col("k") + post, max(1, 2 * (pre + post)))
    out = hit.withColumn("dt", F.col("t") - F.col("k") + pre).drop("t")
    if bounds != "fill":
        return out
    grid = triggers.withColumn("dt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pre + post - 1).cast("long")))).crossJoin(F.broadcast(signal.select("channel").distinct()))
    filled = grid.join(out, [*triggers.columns, "dt", "channel"], "left")
    return filled.withColumn("value", F.coalesce("value", F.lit(fill).cast("double")))


def reject(ep: DataFrame, thresh: float, by: tuple[str, ...] = ("channel", "condition")) -> DataFrame:
    """Epochs whose RMS is not over the upper fence of their channel and condition."""
    power = ep.groupBy(*by, "k").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("rms"))
    good = reduce.fences(power, by, "rms", thresh=thresh, sides="upper").where("inlier").select(*by, "k")
    return ep.join(good, [*by, "k"], "left_semi")


def epoch_average(ep: DataFrame, by: tuple[str, ...] = ("channel", "condition")) -> DataFrame:
    """Mean epoch and its count for each group; condition -1 is skipped."""
    own = ep.where("condition <> -1") if "condition" in ep.columns else ep
    return own.groupBy(*by, "dt").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
