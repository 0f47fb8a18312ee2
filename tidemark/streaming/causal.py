"""Structured Streaming forms (L1-L7): causal filters and debouncing with state, windows over event time.

Streams of blocks have (recording, channel, t0, samples); state is one short row for each key. Samples that come late
(before what a key has seen) are dropped by the stateful operators, and by the watermark in windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.filters import run_sos, steady


def filter_stream(blocks: DataFrame, sos: np.ndarray, settle: bool = True) -> DataFrame:
    """A causal cascade along each channel: the same numbers as the batch filter's forward pass."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z, last = (np.array(state.get[0]).reshape(-1, 2), state.get[1]) if state.exists else (None, -1)
        rows = pd.concat(list(pdfs)).sort_values("t0")
        out = []
        for t0, x in zip(rows["t0"], rows["samples"]):
            if t0 <= last:
                continue
            x = np.asarray(x, float)
            if z is None:
                z = steady(sos) * (x[0] if settle else 0.0)
            y, z = run_sos(sos, x, z)
            last = t0 + len(x) - 1
            out.append((*key, t0, y.tolist()))
        if z is not None:
            state.update((z.ravel().tolist(), int(last)))
        yield pd.DataFrame(out, columns=["recording", "channel", "t0", "samples"])

    return blocks.groupBy("recording", "channel").applyInPandasWithState(run, "recording string, channel long, t0 long, samples array<double>", "z array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def debounce_stream(level: DataFrame, half: float) -> DataFrame:
    """Rising edges of a level (recording, t, level), less those within ``half`` of the last kept one."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, last, kept = state.get if state.exists else (True, -1, -(1 << 62))
        rows = pd.concat(list(pdfs)).sort_values("t")
        out = []
        for t, on in zip(rows["t"].tolist(), rows["level"].tolist()):
            if t <= last:
                continue
            if on and not before and t - kept >= half:
                kept = t
                out.append((*key, t))
            before, last = bool(on), t
        state.update((before, int(last), int(kept)))
        yield pd.DataFrame(out, columns=["recording", "t"])

    return level.groupBy("recording").applyInPandasWithState(run, "recording string, t long", "level boolean, last long, kept long", "append", GroupStateTimeout.NoTimeout)


def sliding(events: DataFrame, length: str, step: str | None = None, late: str = "1 minute", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Mean and count in windows of event time (tumbling without ``step``), closed by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step or length), *by).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "1 minute", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Runs of events with gaps shorter than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))
