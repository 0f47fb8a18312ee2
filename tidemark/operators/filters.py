"""Recursive filters in parallel over channels and over time (H1-H5, H12, R1), and per-channel numerics.

A block of samples is linear in its input and in the filter's state: y = T x + O z, z' = A z + R x. Hence three steps:
every block's end state from a zero start (a map), a scan of those small states along each channel, and every block
again from its true state (a map). Only states, one short row for each block, are ever gathered by channel; samples stay
where they are, so a channel may be as long as it likes. Sections of second order keep this stable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import design

BLOCK = 10_000
_SUB = 128


def arrays(column: pa.Array) -> list[np.ndarray]:
    """Views of a list column's rows as float arrays, without Python numbers; null rows are empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].astype(float, copy=False) for a, b in zip(offsets[:-1], offsets[1:])]


def listed(rows: list[np.ndarray]) -> pa.Array:
    """The inverse."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def to_blocks(signal: DataFrame, length: int = BLOCK) -> DataFrame:
    """(channel, block, samples): a dense signal as arrays."""
    block = F.floor(F.col("t") / length).cast("long").alias("block")
    inner = F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"])
    return signal.groupBy("channel", block).agg(inner.alias("samples"))


def from_blocks(blocks: DataFrame, length: int = BLOCK) -> DataFrame:
    rows = blocks.select("channel", "block", F.posexplode("samples").alias("_k", "value"))
    return rows.select("channel", (F.col("block") * length + F.col("_k")).alias("t"), "value")


def run_sos(sos: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cascade over ``x`` from states ``z`` (sections x 2): output and end states. Inside, spans of ``_SUB`` samples are
    matrix products and only their states are stepped."""
    z_out = np.empty_like(z)
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        n = len(x)
        spans = -(-n // _SUB)
        powers = np.empty((_SUB + 1, 2, 2))
        powers[0] = np.eye(2)
        for k in range(_SUB):
            powers[k + 1] = a @ powers[k]
        impulse = np.concatenate(([b0], powers[: _SUB - 1, 0, :] @ b))
        toeplitz = np.zeros((_SUB, _SUB))
        for k in range(_SUB):
            toeplitz[k, : k + 1] = impulse[: k + 1][::-1]
        reach = (powers[:_SUB] @ b)[::-1]  # effect of each sample on the end state
        padded = np.zeros(spans * _SUB)
        padded[:n] = x
        rows = padded.reshape(spans, _SUB)
        ends, state, starts = rows @ reach, z[s].copy(), np.empty((spans, 2))
        step = powers[_SUB]
        for k in range(spans):
            starts[k] = state
            if k < spans - 1:
                state = step @ state + ends[k]
        last = n - (spans - 1) * _SUB
        tail = rows[-1, :last]
        z_out[s] = powers[last] @ starts[-1] + tail @ (powers[:last] @ b)[::-1]
        x = (rows @ toeplitz.T + starts @ powers[:_SUB, 0, :].T).ravel()[:n]
    return x, z_out


def steady(sos: np.ndarray) -> np.ndarray:
    """States of a cascade that has always seen ones."""
    out, gain = np.zeros((len(sos), 2)), 1.0
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        out[s] = np.linalg.solve(np.eye(2) - a, b) * gain
        gain *= (b0 + b1 + b2) / (1 + a1 + a2)
    return out


def transition(sos: np.ndarray, n: int) -> np.ndarray:
    """What n silent samples make of the states (flattened)."""
    size = 2 * len(sos)
    out = np.empty((size, size))
    for k in range(size):
        unit = np.zeros(size)
        unit[k] = 1
        out[:, k] = run_sos(sos, np.zeros(n), unit.reshape(-1, 2))[1].ravel()
    return out


def sos_blocks(blocks: DataFrame, sos: np.ndarray, reverse: bool = False, settle: bool = True) -> DataFrame:
    """Blocks through a cascade, forward or backward in time; ``settle`` starts as if the first sample had always been."""
    zero = np.zeros((len(sos), 2))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, first, n = [], [], []
            for x in arrays(batch.column("samples")):
                x = x[::-1] if reverse else x
                z.append(run_sos(sos, x, zero)[1].ravel().tolist())
                first.append(float(x[0]))
                n.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("channel"), batch.column("block"), pa.array(z, pa.list_(pa.float64())), pa.array(first), pa.array(n, pa.int64())], ["channel", "block", "end", "first", "n"])

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not reverse)
        steps = {n: transition(sos, n) for n in set(pdf["n"].tolist())}
        z = steady(sos).ravel() * (pdf["first"].iloc[0] if settle else 0.0)
        out = []
        for n, end in zip(pdf["n"].tolist(), pdf["end"]):
            out.append(z.tolist())
            z = steps[n] @ z + np.asarray(end)
        return pd.DataFrame({"channel": pdf["channel"], "block": pdf["block"], "z": out})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, z in zip(arrays(batch.column("samples")), arrays(batch.column("z"))):
                y = run_sos(sos, x[::-1] if reverse else x, z.reshape(-1, 2))[0]
                out.append(y[::-1] if reverse else y)
            yield pa.RecordBatch.from_arrays([batch.column("channel"), batch.column("block"), listed(out)], ["channel", "block", "samples"])

    states = blocks.mapInArrow(ends, "channel long, block long, end array<double>, first double, n long").groupBy("channel").applyInPandas(scan, "channel long, block long, z array<double>")
    return blocks.join(states, ["channel", "block"]).select("channel", "block", "samples", "z").mapInArrow(run, "channel long, block long, samples array<double>")


def filter_blocks(blocks: DataFrame, sos: np.ndarray, zero_phase: bool = True) -> DataFrame:
    """Forward, and then backward for zero phase."""
    out = sos_blocks(blocks, sos)
    return sos_blocks(out, sos, reverse=True) if zero_phase else out


def filter_signal(signal: DataFrame, kind: str, zero_phase: bool = True, block: int = BLOCK, **args) -> DataFrame:
    """Design by name and filter."""
    return from_blocks(filter_blocks(to_blocks(signal, block), design.design(kind, **args), zero_phase), block)


def notch_lines(signal: DataFrame, fs: float, lines: float | Sequence[float], highest: float | None = None, width: float = 3.0, block: int = BLOCK) -> DataFrame:
    """Lines taken out one after the other: a single one with its multiples. No lines: nothing changes."""
    top = min(highest or fs / 2, fs / 2)
    own = [lines * k for k in range(1, int(top / lines) + 1)] if not isinstance(lines, (list, tuple)) else list(lines)
    own = [f for f in own if f < fs / 2]
    if not own:
        return signal
    sos = np.concatenate([design.notch(f, fs, width) for f in own])
    return from_blocks(filter_blocks(to_blocks(signal, block), sos), block)


def downsample(signal: DataFrame, r: int, block: int = BLOCK) -> DataFrame:
    """Every r-th sample behind a zero-phase Chebyshev low-pass."""
    if r == 1:
        return signal
    order = design.cheb1_order(0.8 / r, 1 / r, 0.25, 10)
    low = filter_blocks(to_blocks(signal, block), design.cheby1(0.25, hi=0.8 / r, fs=2.0, order=order))
    return from_blocks(low, block).where(F.col("t") % r == 0).withColumn("t", F.floor(F.col("t") / r).cast("long"))


def ratio(fs: float, wanted: float) -> int:
    return int(np.ceil(fs / wanted))


def block_apply(blocks: DataFrame, f: Callable[[np.ndarray], np.ndarray], guard: int = 0, length: int = BLOCK) -> DataFrame:
    """``f`` on every block, with ``guard`` samples of its neighbours on either side that are cut off again."""
    if guard:
        tail = blocks.select("channel", (F.col("block") + 1).alias("block"), F.slice("samples", -F.least(F.lit(guard), F.size("samples")), F.lit(guard)).alias("_left"))
        head = blocks.select("channel", (F.col("block") - 1).alias("block"), F.slice("samples", 1, guard).alias("_right"))
        blocks = blocks.join(tail, ["channel", "block"], "left").join(head, ["channel", "block"], "left")
    else:
        blocks = blocks.withColumn("_left", F.lit(None).cast("array<double>")).withColumn("_right", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, a, b in zip(*(arrays(batch.column(c)) for c in ("samples", "_left", "_right"))):
                y = f(np.concatenate((a, x, b)))
                out.append(np.asarray(y, float)[len(a) : len(a) + len(x)])
            yield pa.RecordBatch.from_arrays([batch.column("channel"), batch.column("block"), listed(out)], ["channel", "block", "samples"])

    return blocks.select("channel", "block", "samples", "_left", "_right").mapInArrow(run, "channel long, block long, samples array<double>")


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal, through the spectrum."""
    n = len(x)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * h)


def envelope(signal: DataFrame, block: int = BLOCK, guard: int = 500) -> DataFrame:
    """Magnitude of the analytic signal; blocks are taken with guards, so that every sample is covered."""
    return from_blocks(block_apply(to_blocks(signal, block), lambda x: np.abs(analytic(x)), guard, block), block)


def lowpass_envelope(signal: DataFrame, hi: float, fs: float, order: int = 3, block: int = BLOCK, guard: int = 500) -> DataFrame:
    return filter_signal(envelope(signal, block, guard), "butter", hi=hi, fs=fs, order=order, block=block)


def convolve(signal: DataFrame, taps: np.ndarray, block: int = BLOCK) -> DataFrame:
    """A long centred filter of odd length: blocks with guards, by FFT, nought outside."""
    half = len(taps) // 2

    def run(x: np.ndarray) -> np.ndarray:
        size = 1 << (len(x) + len(taps) - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps, size), size)[half : half + len(x)]

    return from_blocks(block_apply(to_blocks(signal, block), run, half, block), block)


def moving_projection(signal: DataFrame, n: int, bw: float, fs: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Sliding low-pass projection on n-sample tapers."""
    return convolve(signal, design.moving_projection_taps(n, bw, fs)[::-1], block)


def slepian(x: np.ndarray, bw: float, fs: float = 1.0, w0: float = 0.0, least: float = 0.9) -> np.ndarray:
    """Projection of a whole series on the tapers of a band around ``w0``."""
    n = len(x)
    nw = n * bw / fs
    v, lam = design.tapers(n, nw, max(1, int(round(2 * nw)) - 1))
    v = v[lam >= least] if (lam >= least).any() else v[:1]
    if not w0:
        return v.T @ (v @ x)
    carrier = np.exp(-2j * np.pi * w0 / fs * np.arange(n))
    return 2 * ((v.T @ (v @ (x * carrier))) * carrier.conj()).real


def slepian_projection(signal: DataFrame, bw: float, fs: float = 1.0, w0: float = 0.0, block: int = 1000) -> DataFrame:
    return from_blocks(block_apply(to_blocks(signal, block), lambda x: slepian(x, bw, fs, w0)), block)


#: Tapers of longer series are interpolated from those of this length.
TAPER = 1024


def tapers_at(t: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """Values at samples ``t`` of tapers of length ``n``, from ``v`` (tapers x their length); nought beyond the end."""
    if n == v.shape[1]:
        out = v[:, np.minimum(t, n - 1)]
    else:
        at = (t + 0.5) * (v.shape[1] / n) - 0.5
        out = np.stack([np.interp(at, np.arange(v.shape[1]), x) for x in v]) * np.sqrt(v.shape[1] / n)
    return np.where(t < n, out, 0.0)


def multitaper_psd(signal: DataFrame, fs: float, nw: float = 4.0) -> DataFrame:
    """(channel, frequency, power): the tapered spectrum of each channel's whole series, averaged over tapers.

    The transform is made in two steps over the series as a matrix of about sqrt(n) x sqrt(n) (padded with noughts, at
    most sqrt(n) + 1 of them), so that a task holds a row or a column of it: columns of every m2-th sample, then rows of
    the results.
    """
    bounds = signal.groupBy("channel").agg(F.min("t").alias("t0"), (F.max("t") - F.min("t") + 1).alias("n"), F.avg("value").alias("mean"))
    shape = bounds.withColumn("m2", F.ceil(F.sqrt("n")).cast("long")).withColumn("m1", F.ceil(F.col("n") / F.col("m2")).cast("long"))
    long = design.tapers(TAPER, nw, int(2 * nw) - 1)
    short: dict = {}

    def own(n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= TAPER:
            return long
        if n not in short:
            short[n] = design.tapers(n, min(nw, n / 4), int(2 * nw) - 1)
        return short[n]

    def columns(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, m1, m2, k2 = (int(first[c]) for c in ("n", "m1", "m2", "c"))
        x = np.zeros(m1)
        x[((pdf["t"] - pdf["t0"]) // m2).to_numpy(np.int64)] = pdf["value"] - first["mean"]
        v = tapers_at(m2 * np.arange(m1) + k2, n, own(n)[0])
        y = np.fft.fft(v * x, axis=1) * np.exp(-2j * np.pi * k2 / (m1 * m2) * np.arange(m1))
        return pd.DataFrame({"channel": int(first["channel"]), "n": n, "m1": m1, "m2": m2, "c": k2, "r": np.arange(m1), "re": y.real.T.tolist(), "im": y.imag.T.tolist()})

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, m1, m2, r = (int(first[c]) for c in ("n", "m1", "m2", "r"))
        y, lam = np.zeros((m2, len(first["re"])), complex), own(n)[1]
        y[pdf["c"].to_numpy(np.int64)] = np.stack(pdf["re"].to_list()) + 1j * np.stack(pdf["im"].to_list())
        power = (np.abs(np.fft.fft(y, axis=0)) ** 2 @ lam) / lam.sum() / fs
        k, m = r + m1 * np.arange(m2), m1 * m2
        power[(k > 0) & (2 * k < m)] *= 2
        return pd.DataFrame({"channel": int(first["channel"]), "frequency": k * fs / m, "power": power})[2 * k <= m]

    placed = signal.join(F.broadcast(shape), "channel").withColumn("c", F.pmod(F.col("t") - F.col("t0"), F.col("m2")))
    half = placed.groupBy("channel", "c").applyInPandas(lambda pdf: columns(pdf), "channel long, n long, m1 long, m2 long, c long, r long, re array<double>, im array<double>")
    return half.groupBy("channel", "r").applyInPandas(lambda pdf: rows(pdf), "channel long, frequency double, power double")


def ar_whiten(x: np.ndarray, p: int = 50) -> np.ndarray:
    """Prediction errors of an autoregression fitted by its autocorrelation."""
    x = x - x.mean()
    p = min(p, len(x) - 1)
    auto = np.correlate(x, x, "full")[len(x) - 1 : len(x) + p] / len(x)
    lags = np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
    a = np.linalg.lstsq(auto[lags], auto[1:], rcond=None)[0]
    return np.convolve(x, np.concatenate(([1.0], -a)))[: len(x)]


def whiten(signal: DataFrame, p: int = 50, block: int = 1000) -> DataFrame:
    return from_blocks(block_apply(to_blocks(signal, block), lambda x: ar_whiten(x, p)), block)


def remove_modes(signal: DataFrame, n: int = 1, kind: str = "dense", block: int = 1000) -> DataFrame:
    """Each block of all channels less n of its singular modes: the most even over channels (``dense``), the least
    (``sparse``) or the strongest (``power``). A block of time is the group; its size is channels x ``block``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="channel", columns="t", values="value").fillna(0.0)
        u, s, v = np.linalg.svd(wide.to_numpy(), full_matrices=False)
        even = np.abs(u).sum(axis=0)
        order = {"dense": np.argsort(-even), "sparse": np.argsort(even), "power": np.argsort(-s)}[kind][:n]
        left = wide.to_numpy() - (u[:, order] * s[order]) @ v[order]
        out = pd.DataFrame(left, index=wide.index, columns=wide.columns).stack().rename("value").reset_index()
        return out[["channel", "t", "value"]]

    placed = signal.withColumn("_b", F.floor(F.col("t") / block))
    return placed.groupBy("_b").applyInPandas(lambda pdf: run(pdf), "channel long, t long, value double")


def upsample_sinc(signal: DataFrame, r: int, block: int = BLOCK, guard: int = 256) -> DataFrame:
    """r samples for each, band-limited: the spectrum of each block (with guards) is padded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, a, b in zip(*(arrays(batch.column(c)) for c in ("samples", "_left", "_right"))):
                y = np.fft.irfft(np.fft.rfft(np.concatenate((a, x, b))), (len(a) + len(x) + len(b)) * r) * r
                out.append(y[len(a) * r : (len(a) + len(x)) * r])
            yield pa.RecordBatch.from_arrays([batch.column("channel"), batch.column("block"), listed(out)], ["channel", "block", "samples"])

    blocks = to_blocks(signal, block)
    tail = blocks.select("channel", (F.col("block") + 1).alias("block"), F.slice("samples", -F.least(F.lit(guard), F.size("samples")), F.lit(guard)).alias("_left"))
    head = blocks.select("channel", (F.col("block") - 1).alias("block"), F.slice("samples", 1, guard).alias("_right"))
    wide = blocks.join(tail, ["channel", "block"], "left").join(head, ["channel", "block"], "left").select("channel", "block", "samples", "_left", "_right")
    return from_blocks(wide.mapInArrow(run, "channel long, block long, samples array<double>"), block * r)


def convert_electrode(signal: DataFrame, circuits: DataFrame, fs: float, inverse: bool = False, block: int = BLOCK) -> DataFrame:
    """Volts to amps (or back) with each channel's own circuit (channel, r, c, series): the state scan with a section for
    each channel, channels side by side."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        sos = design.rc_section(pdf["r"].iloc[0], pdf["c"].iloc[0], pdf["series"].iloc[0], fs, inverse=inverse)
        z, out = np.zeros((1, 2)), []
        for x in pdf["samples"]:
            y, z = run_sos(sos, np.asarray(x, float), z)
            out.append(y.tolist())
        return pd.DataFrame({"channel": pdf["channel"], "block": pdf["block"], "samples": out})

    joined = to_blocks(signal, block).join(F.broadcast(circuits), "channel")
    return from_blocks(joined.groupBy("channel").applyInPandas(run, "channel long, block long, samples array<double>"), block)
