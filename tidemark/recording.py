"""Recordings as objects: lazy slices, masks, reductions and filters of a channel x time signal, and loading by session."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events, filters, filters_sql, joining, reduce, resample, slicing
from tidemark.sources import catalog, openephys, store


@dataclass(frozen=True)
class Recording:
    """A signal (channel, t, value) with its sampling rate, channel map, aligned signals and triggers. Every method gives
    a new recording or table; nothing runs before it is collected or written."""

    signal: DataFrame
    fs: float
    units: str = "uV"
    sites: DataFrame | None = None
    aligned: dict[str, DataFrame] = field(default_factory=dict)
    triggers: DataFrame | None = None
    limit: float = 2e9

    def shape(self) -> tuple[int, int]:
        n = self.signal.agg(F.count_distinct("channel"), F.coalesce(F.max("t") + 1, F.lit(0))).first()
        return n[0], n[1]

    def _each(self, f: Callable[[DataFrame], DataFrame], aligned: bool = True, **changes) -> Recording:
        return replace(self, signal=f(self.signal), aligned={k: f(v) for k, v in self.aligned.items()} if aligned else self.aligned, **changes)

    def __getitem__(self, where) -> Recording:
        """Channels and times as in NumPy; lists of channels must ascend."""
        where = slicing.expand(where if isinstance(where, tuple) else (where,), 2)
        chans, times = ([w] if isinstance(w, int) else w for w in where)
        ends = lambda w: isinstance(w, slice) and any(x is not None and x < 0 for x in (w.start, w.stop, w.step))
        n_c, n_t = self.shape() if ends(chans) or ends(times) or isinstance(where[1], int) else (None, None)
        if isinstance(where[1], int):
            times = slice(where[1] % n_t, where[1] % n_t + 1)
        return replace(self, signal=slicing.slice_signal(self.signal, chans, times, n_c, n_t), aligned={k: slicing.slice_signal(v, slice(None), times, None, n_t) for k, v in self.aligned.items()})

    def mask(self, active: DataFrame) -> Recording:
        return self._each(lambda s: slicing.mask_channels(s, active), aligned=False)

    def array(self) -> np.ndarray:
        """On the driver, if it is within the limit."""
        return slicing.collect_array(self.signal, self.limit)

    def reduce(self, how: str, axis: int | None = None, ddof: int = 0) -> DataFrame:
        """min, max, sum, mean, var or std along an axis."""
        return reduce.reduce_axis(self.signal, axis, ddof).select(*reduce.AXES[axis], how)

    def blocks(self, length: int = 20_000, overlap: int = 0) -> DataFrame:
        return slicing.blocks(self.signal, length, overlap)

    def iter_blocks(self, length: int = 20_000, overlap: int = 0, reverse: bool = False) -> Iterator[np.ndarray]:
        """Blocks as arrays on the driver, one at a time."""
        n_c, n_t = self.shape()
        order = range(slicing.block_count(n_t, length, overlap))
        for k in reversed(order) if reverse else order:
            start = k * (length - overlap)
            part = slicing.collect_array(slicing.slice_signal(self.signal, slice(None), slice(start, start + length)), self.limit)
            yield part[:, ::-1] if reverse else part

    def filter(self, kind: str, zero_phase: bool = True, **args) -> Recording:
        return self._each(lambda s: filters.filter_signal(s, kind, zero_phase, fs=self.fs, **args), aligned=False)

    def notch(self, lines: float | Sequence[float], **args) -> Recording:
        return self._each(lambda s: filters.notch_lines(s, self.fs, lines, **args), aligned=False)

    def downsample(self, rate: float | None = None, ratio: int | None = None, aggregate_aligned: bool = False) -> Recording:
        """At a lower rate; aligned signals are filtered too, or summed. Triggers move to the new samples."""
        if (rate is None) == (ratio is None):
            raise ValueError("a rate or a ratio")
        r = ratio or filters.ratio(self.fs, rate)
        low = lambda s: filters.downsample(s, r)
        summed = lambda s: resample.aggregate(s, r, self.shape()[1])
        trig = None if self.triggers is None else self.triggers.withColumn("t", F.round(F.col("t") / r).cast("long"))
        return replace(self, signal=low(self.signal), aligned={k: (summed if aggregate_aligned else low)(v) for k, v in self.aligned.items()}, triggers=trig, fs=self.fs / r)

    def rereference(self, how: str = "common", reference: DataFrame | None = None) -> Recording:
        return self._each(lambda s: filters_sql.rereference(s, how, reference), aligned=False)

    def join(self, other: Recording) -> Recording:
        """Followed by another one, on the channels that both have."""
        if set(self.aligned) != set(other.aligned) or self.fs != other.fs:
            raise ValueError("recordings differ in rate or aligned signals")
        n = self.shape()[1]
        common = self.signal.select("channel").distinct().intersect(other.signal.select("channel").distinct())
        end_to_end = lambda a, b: a.unionByName(b.withColumn("t", F.col("t") + n))
        trig = None
        if self.triggers is not None and other.triggers is not None:
            trig = joining.extend(self.triggers, other.triggers, n)
        return replace(self, signal=end_to_end(self.signal, other.signal).join(common, "channel", "left_semi"), aligned={k: end_to_end(v, other.aligned[k]) for k, v in self.aligned.items()}, triggers=trig)

    def detect_triggers(self, name: str, **args) -> Recording:
        """Triggers from an aligned signal."""
        return replace(self, triggers=events.process_trigger(self.aligned[name], **args))

    def epochs(self, pre: int, post: int, conditions: DataFrame | None = None, **args) -> DataFrame:
        """Samples around the triggers, with their conditions if given (event_no, condition)."""
        trig = self.triggers.select(F.col("t").cast("long").alias("k"), *[c for c in self.triggers.columns if c not in ("t", "k")])
        if conditions is not None:
            trig = trig.join(F.broadcast(conditions), "event_no")
        return events.epochs(self.signal, trig, pre, post, **args)

    def save(self, path: str | Path) -> None:
        store.save(path, {"signal": self.signal, "aligned": self.aligned, "fs": self.fs, "units": self.units, **({"sites": self.sites} if self.sites is not None else {}), **({"triggers": self.triggers} if self.triggers is not None else {})})

    @classmethod
    def read(cls, spark: SparkSession, path: str | Path) -> Recording:
        b = store.load(spark, path)
        return cls(b.signal, b.fs, b.units, b.get("sites"), dict(b.get("aligned") or {}), b.get("triggers"))


def open_source(spark: SparkSession, path: str | Path, microvolts: bool = True) -> Recording:
    """A stored recording, or a folder of Open Ephys files."""
    at = Path(path)
    if (at / "_meta.json").exists():
        return Recording.read(spark, at)
    files = openephys.channel_files(at)
    if not files:
        raise FileNotFoundError(f"no recording at {at}")
    openephys.register(spark)
    read = lambda kind: openephys.signal(spark.read.format("openephys").option("channels", kind).load(str(at)), microvolts)
    aligned = {k.lower(): read(k) for k in ("ADC", "AUX") if openephys.channel_files(at, kind=k)}
    return Recording(read("CH").withColumn("channel", F.col("channel") - 1), openephys.common_header([p for _, p in files])["sampleRate"], aligned=aligned)


def load_recording(spark: SparkSession, session: str | Path, name: str, sites: DataFrame | None = None, **call) -> Recording:
    """A recording of a session file: found at its paths (a version stored at the wanted rate first), cut to channels,
    filtered and re-referenced as the session and the call say; the call wins."""
    conf = catalog.read_session(session)[name]
    args = catalog.options({}, {"causal_filtering": False}, {}, {**conf, **catalog.modern(conf)}, catalog.modern(call) | {k: v for k, v in call.items() if k in ("exp_path", "nwk_path")})
    rate = args.get("resample_rate")
    rec, stored_at = None, None
    for root in (args.get("exp_path"), args.get("nwk_path")):
        if root and rec is None and Path(root).exists():
            stored, raw = catalog.find_source(root, name, rate if isinstance(rate, (int, float)) else None)
            if stored or raw:
                rec, stored_at = open_source(spark, stored or raw), stored
    if rec is None:
        raise FileNotFoundError(f"no source of {name}")
    if args.get("load_channels"):
        rec = rec[list(args["load_channels"]), :]
    if rate and not stored_at:
        rec = rec.downsample(ratio=rate[1]) if isinstance(rate, tuple) else rec.downsample(rate) if rate < rec.fs else rec
    if args.get("bandpass"):
        lo, hi = args["bandpass"]
        rec = rec.filter("butter", zero_phase=not args["causal_filtering"], lo=lo, hi=hi, order=3)
    if args.get("notches"):
        rec = rec.notch(list(args["notches"]))
    if args.get("snip_transient"):
        s = int(5 * rec.fs if args["snip_transient"] is True else args["snip_transient"] * rec.fs)
        rec = rec._each(lambda x: slicing.snip_transient(x, s))
    if args.get("car"):
        rec = rec.rereference("common")
    return replace(rec, sites=sites)


def load_recordings(spark: SparkSession, session: str | Path, names: Sequence[str | int], **call) -> Recording:
    """Several recordings end to end; numbers are ``test_%03d``."""
    own = [load_recording(spark, session, f"test_{n:03d}" if isinstance(n, int) else n, **call) for n in names]
    out = own[0]
    for r in own[1:]:
        out = out.join(r)
    return out
