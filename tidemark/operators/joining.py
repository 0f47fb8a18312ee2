"""Recordings joined end to end (D1-D7), maps and pairs (D9-D13), set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def offsets(lengths: DataFrame, recording: str = "recording", n: str = "n") -> DataFrame:
    """(recording, offset): where each begins when laid end to end in order of name. One row a recording."""
    before = Window.orderBy(recording).rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select(recording, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias("offset"))


def concatenate(signal: DataFrame, recording: str = "recording") -> DataFrame:
    """Recordings one after the other on one time axis."""
    lengths = signal.groupBy(recording).agg((F.max("t") + 1).alias("n"))
    placed = signal.join(F.broadcast(offsets(lengths, recording)), recording)
    return placed.withColumn("t", F.col("t") + F.col("offset")).drop("offset")


def route(lengths: DataFrame, start: int, stop: int, recording: str = "recording") -> DataFrame:
    """The parts of recordings that a range of the joined axis reads: (recording, first, last) in their own time."""
    placed = lengths.join(offsets(lengths, recording), recording)
    lo, hi = F.greatest(F.lit(start), F.col("offset")), F.least(F.lit(stop), F.col("offset") + F.col("n"))
    return placed.where(lo < hi).select(recording, (lo - F.col("offset")).cast("long").alias("first"), (hi - F.col("offset")).cast("long").alias("stop"))


def join_datasets(signal: DataFrame, sites: DataFrame, recording: str = "recording") -> DataFrame:
    """Recordings end to end on the sites that all of them have: ``sites`` maps (recording, channel) to (row, col)."""
    n = sites.agg(F.count_distinct(recording).alias("n_rec"))
    common = sites.groupBy("row", "col").agg(F.count_distinct(recording).alias("k")).crossJoin(F.broadcast(n)).where("k = n_rec").select("row", "col")
    kept = sites.join(common, ["row", "col"])
    lengths = signal.groupBy(recording).agg((F.max("t") + 1).alias("n"))
    out = signal.join(F.broadcast(kept), [recording, "channel"]).join(F.broadcast(offsets(lengths, recording)), recording)
    return out.select("row", "col", (F.col("t") + F.col("offset")).alias("t"), "value")


def union_recordings(parts: Sequence[DataFrame]) -> DataFrame:
    """Several sources as one table, a name for each; columns must agree."""
    if len({tuple(sorted(p.dtypes)) for p in parts}) > 1:
        raise ValueError("sources differ in columns or types")
    return reduce(DataFrame.unionByName, [p.withColumn("recording", F.lit(f"r{k}")) for k, p in enumerate(parts)])


def extend(first: DataFrame, second: DataFrame, offset: float) -> DataFrame:
    """Events followed by another experiment's, whose stamps are moved by ``offset``."""
    if set(first.columns) != set(second.columns):
        raise ValueError("experiments have different tables")
    return first.unionByName(second.withColumn("t", F.col("t") + offset))


def lookup(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """Channels of sites (row, col); a site without one is an error."""
    hit = wanted.join(F.broadcast(sites), ["row", "col"], "left")
    return hit.withColumn("channel", F.when(F.col("channel").isNull(), F.raise_error(F.format_string("no channel at (%s, %s)", "row", "col")).cast("long")).otherwise(F.col("channel")))


def nearest(sites: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest channel to each point (y, x), the first of equal ones. A map is bounded by its electrodes, and is
    broadcast as one row; each point takes the least of its distances where it lies, so nothing is shuffled or sorted."""
    chart = sites.agg(F.collect_list(F.struct("channel", "y", "x")).alias("_sites")).where(F.size("_sites") > 0)
    y, x = (lambda s, c=c: F.col(c) - s[c] for c in "yx")
    one = lambda s: F.struct(F.sqrt(y(s) * y(s) + x(s) * x(s)).alias("distance"), s["channel"].alias("channel"))
    best = points.crossJoin(F.broadcast(chart)).select(*points.columns, F.array_min(F.transform("_sites", one)).alias("_best"))
    return best.select(*points.columns, F.col("_best.channel").alias("channel"), F.col("_best.distance").alias("distance"))


def channel_pairs(sites: DataFrame, scale: float = 1.0, digits: int = 4) -> DataFrame:
    """Unordered pairs of channels and their distance. Pairs of one map: electrodes squared, whatever the recording."""
    a, b = sites.alias("a"), sites.alias("b")
    far = F.round(F.sqrt((F.col("a.row") - F.col("b.row")) ** 2 + (F.col("a.col") - F.col("b.col")) ** 2) * scale, digits)
    return a.join(F.broadcast(b), F.col("a.channel") < F.col("b.channel")).select(F.col("a.channel").alias("p1"), F.col("b.channel").alias("p2"), far.alias("distance"))


def map_intersection(maps: DataFrame) -> DataFrame:
    """Sites (row, col) of every map in (map, row, col)."""
    n = maps.agg(F.count_distinct("map").alias("n"))
    return maps.groupBy("row", "col").agg(F.count_distinct("map").alias("k")).crossJoin(F.broadcast(n)).where("k = n").select("row", "col")


def difference(all_channels: DataFrame, without: DataFrame) -> DataFrame:
    return all_channels.join(without, "channel", "left_anti")


def subset_map(sites: DataFrame, wanted: DataFrame) -> DataFrame:
    """A map of some channels, numbered anew in channel order."""
    own = sites.join(F.broadcast(wanted), "channel", "left_semi")
    return own.select((F.row_number().over(Window.orderBy("channel")) - 1).cast("long").alias("channel"), "row", "col")


def merge_missing(dest: DataFrame, source: DataFrame, keys: Sequence[str], overwrite: bool = False) -> DataFrame:
    """Rows of ``source`` whose keys ``dest`` lacks, added to it; with ``overwrite`` the source's rows win."""
    if overwrite:
        dest, source = source, dest
    return dest.unionByName(source.join(dest, list(keys), "left_anti"))
