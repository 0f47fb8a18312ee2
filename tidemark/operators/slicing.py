"""Slices, masks, pruned segments and guards (C1-C12), tiles of a time axis (E9-E13), writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.rangejoin import bucketed


class MemoryGuardError(RuntimeError):
    """A read would bring more to the driver than its limit."""


def bounds(where: slice, n: int) -> range:
    """The positions a slice takes of an axis of ``n`` (negative starts and steps as in Python)."""
    return range(*where.indices(n))


def expand(index: tuple, dims: int) -> tuple:
    """An index with ``...`` as one slice for each dimension."""
    if Ellipsis not in index:
        return (*index, *[slice(None)] * (dims - len(index)))
    k = index.index(Ellipsis)
    return (*index[:k], *[slice(None)] * (dims - len(index) + 1), *index[k + 1 :])


def _taken(col: Column, r: range) -> tuple[Column, Column]:
    """(whether a position is in a range, its new position). Both are plain comparisons, so they reach the scan."""
    if not len(r):
        return F.lit(False), F.lit(0)
    low, high = min(r[0], r[-1]), max(r[0], r[-1])
    inside = col.between(low, high)
    if abs(r.step) != 1:
        inside = inside & ((col - low) % abs(r.step) == 0)
    return inside, ((col - r[0]) / r.step).cast("long")


def slice_signal(signal: DataFrame, channels: slice | Sequence[int] = slice(None), times: slice = slice(None), n_channels: int | None = None, n_times: int | None = None) -> DataFrame:
    """Channels and times of a signal, numbered anew in the order of the slice. A list of channels must ascend.

    Open slices need no length; negative starts or steps do (``n_channels``, ``n_times``).
    """
    out = signal
    for name, where, n in (("channel", channels, n_channels), ("t", times, n_times)):
        if isinstance(where, slice):
            if where == slice(None):
                continue
            if n is None:
                if (where.start or 0) < 0 or (where.stop or 0) < 0 or (where.step or 1) < 0:
                    raise ValueError(f"a slice from the end of {name} needs its length")
                start, step = where.start or 0, where.step or 1
                inside = F.col(name) >= start
                if where.stop is not None:
                    inside = inside & (F.col(name) < where.stop)
                if step != 1:
                    inside = inside & ((F.col(name) - start) % step == 0)
                out = out.where(inside).withColumn(name, ((F.col(name) - start) / step).cast("long"))
                continue
            inside, new = _taken(F.col(name), bounds(where, n))
            out = out.where(inside).withColumn(name, new)
        else:
            own = list(where)
            if any(b <= a for a, b in zip(own, own[1:])):
                raise ValueError("a list of channels must ascend")
            place = F.create_map(*[x for k, c in enumerate(own) for x in (F.lit(c), F.lit(k))]) if own else None
            out = out.where(F.col(name).isin(own))
            if place is not None:
                out = out.withColumn(name, F.element_at(place, F.col(name).cast("int")).cast("long"))
    return out


def mask_channels(signal: DataFrame, mask: DataFrame) -> DataFrame:
    """The active channels, numbered anew: ``mask`` has channel and active. The mask is the small side of a semi-join."""
    active = mask.where("active").select("channel", (F.row_number().over(Window.orderBy("channel")) - 1).cast("long").alias("new"))
    return signal.join(active, "channel").drop("channel").withColumnRenamed("new", "channel").select(*signal.columns)


def refine_mask(mask: DataFrame, flags: Sequence[bool] | None) -> DataFrame:
    """A mask set anew: flags for all channels replace it, flags for the active ones narrow it, None activates all."""
    if flags is None:
        return mask.withColumn("active", F.lit(True))
    rows = mask.orderBy("channel").collect()
    if len(flags) == len(rows):
        new = dict(zip((r.channel for r in rows), flags))
    elif len(flags) == sum(r.active for r in rows):
        new = {r.channel: False for r in rows} | dict(zip((r.channel for r in rows if r.active), flags))
    else:
        raise ValueError("a mask has a flag for each channel or for each active one")
    return mask.sparkSession.createDataFrame([(c, bool(x)) for c, x in new.items()], mask.select("channel", "active").schema)


def is_direct(mask: DataFrame) -> Column:
    """Aggregate: whether every channel is active, so that channel numbers are row numbers."""
    return F.bool_and("active")


def prune_segments(signal: DataFrame, segments: DataFrame, length: int = 4096) -> DataFrame:
    """Only samples of [start, stop) segments, one after the other; ``segments`` is a short table (start, stop), met by
    buckets of ``length`` samples."""
    order = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("at", F.coalesce(F.sum(F.col("stop") - F.col("start")).over(order), F.lit(0)))
    hit = bucketed(signal, placed, F.col("start"), F.col("stop"), length)
    return hit.select("channel", (F.col("t") - F.col("start") + F.col("at")).cast("long").alias("t"), "value")


def snip_transient(signal: DataFrame, samples: int) -> DataFrame:
    return signal.where(F.col("t") >= samples).withColumn("t", F.col("t") - samples)


def subset_channels(signal: DataFrame, channels: Sequence[int]) -> DataFrame:
    """Listed channels, keeping their numbers."""
    return signal.where(F.col("channel").isin(list(channels)))


def guard(n_channels: int, n_times: int, itemsize: int = 8, limit: float = 2e9) -> None:
    """Refuse what would not fit on the driver."""
    if n_channels * n_times * itemsize > limit:
        raise MemoryGuardError(f"{n_channels} x {n_times} samples are over {limit:.3g} bytes")


def collect_array(signal: DataFrame, limit: float = 2e9):
    """A slice as a channel x time array on the driver, if it is within the limit."""
    import numpy as np

    n_c, n_t = signal.agg(F.coalesce(F.max("channel") + 1, F.lit(0)), F.coalesce(F.max("t") + 1, F.lit(0))).first()
    guard(n_c, n_t, limit=limit)
    rows = signal.select("channel", "t", "value").toPandas()
    out = np.full((n_c, n_t), np.nan)
    out[rows["channel"], rows["t"]] = rows["value"]
    return out


def blocks(signal: DataFrame, length: int, overlap: int = 0, n_times: int | None = None) -> DataFrame:
    """Blocks of ``length`` that begin every ``length - overlap`` samples (column block, t within it). A sample lies in
    each block that covers it; the last block may be short, and may repeat samples only."""
    step = length - overlap
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - length + 1) / step)).cast("long")
    last = F.floor(F.col("t") / step).cast("long")
    if overlap == 0:
        return signal.withColumn("block", last).withColumn("at", F.col("t") - last * step)
    out = signal.withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumn("at", F.col("t") - F.col("block") * step)


def block_count(n: int, length: int, overlap: int = 0) -> int:
    """Blocks over ``n`` samples: as long as one begins before the end."""
    return -(-n // (length - overlap))


def block_reduce(signal: DataFrame, length: int, how: str = "avg") -> DataFrame:
    """One number for each channel and block: any aggregate by name."""
    block = F.floor(F.col("t") / length).cast("long").alias("block")
    return signal.groupBy("channel", block).agg(F.expr(f"{how}(value)").alias("value"))


def overwrite(old: DataFrame, new: DataFrame) -> DataFrame:
    """A new version of a signal with the samples of ``new`` in place of its own; samples outside it are dropped."""
    keys = ["channel", "t"]
    both = old.join(new.select(*keys, F.col("value").alias("_new"), F.lit(True).alias("_written")), keys, "left")
    return both.withColumn("value", F.when(F.col("_written"), F.col("_new")).otherwise(F.col("value"))).drop("_new", "_written")


def channel_batches(n_channels: int, n_times: int, itemsize: int = 8, limit: float | None = None, each: int = 16) -> list[range]:
    """Batches of channels: a fixed number, or what fits in ``limit`` bytes."""
    if limit is not None:
        each = max(1, int(limit // max(1, n_times * itemsize)))
    return [range(a, min(a + each, n_channels)) for a in range(0, n_channels, each)]
