"""Filters, tapers and per-channel numerics against NumPy on the same arrays."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark import registry
from tidemark.functions import design
from tidemark.operators import filters, filters_sql, spatial


def naive(sos, x, z=None):
    y, states = np.array(x, float), []
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = (0.0, 0.0) if z is None else z[s]
        out = np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b0 * v + z1
            z1, z2 = b1 * v - a1 * out[i] + z2, b2 * v - a2 * out[i]
        states.append((z1, z2))
        y = out
    return y, np.array(states)


def frame(spark, x):
    return spark.createDataFrame([(c, t, float(v)) for c, row in enumerate(np.atleast_2d(x)) for t, v in enumerate(row)], "channel long, t long, value double")


def array(df):
    rows = df.toPandas()
    out = np.full((rows.channel.max() + 1, rows.t.max() + 1), np.nan)
    out[rows.channel, rows.t] = rows.value
    return out


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 700), st.integers(0, 2**32 - 1))
def test_cascade_is_the_recurrence(n, seed):
    x = np.random.default_rng(seed).standard_normal(n)
    sos = design.butter(30, 100, 1000, 3)
    z = steady = filters.steady(sos) * x[0]
    y, end = filters.run_sos(sos, x, z)
    want, state = naive(sos, x, steady)
    assert np.allclose(y, want, atol=1e-11) and np.allclose(end, state, atol=1e-11)


def test_edges_of_designs():
    db = lambda sos, f: 20 * np.log10(np.abs(design.response(sos, 2 * np.pi * np.array(f) / 1000)))
    assert np.allclose(db(design.butter(None, 100, 1000, 4), [0, 100]), [0, -3.0103], atol=1e-3)
    assert np.allclose(db(design.butter(30, 100, 1000, 3), [30, 100]), -3.0103, atol=1e-3)
    assert np.allclose(db(design.cheby1(0.25, None, 100, 1000, 5), [0, 100]), [0, -0.25], atol=1e-3)
    assert np.allclose(db(design.cheby2(60, None, 100, 1000, 6), [100]), -60, atol=1e-3)
    assert np.allclose(db(design.ellip(60, 0.5, None, 100, 1000, 5), [0, 100]), [0, -0.5], atol=1e-3)
    stop = db(design.ellip(60, 0.5, None, 100, 1000, 5), np.arange(200, 500, 10))
    assert stop.max() < -59.9
    with pytest.raises(ValueError):
        design.butter(None, 600, 1000)


def test_filter_in_blocks_is_one_filter(spark):
    x = np.random.default_rng(1).standard_normal((3, 1111))
    sos = design.butter(30, 100, 1000, 3)
    got = array(filters.from_blocks(filters.filter_blocks(filters.to_blocks(frame(spark, x), 200), sos), 200))
    for row, y in zip(x, got):
        f, _ = naive(sos, row, filters.steady(sos) * row[0])
        b, _ = naive(sos, f[::-1], filters.steady(sos) * f[-1])
        assert np.allclose(y, b[::-1], atol=1e-9)


def test_notch_takes_a_line_out(spark):
    t = np.arange(4000)
    x = np.sin(2 * np.pi * 60 * t / 1000) + np.sin(2 * np.pi * 13 * t / 1000)
    y = array(filters.notch_lines(frame(spark, x), 1000, [60.0], block=700))[0]
    assert np.abs(y - np.sin(2 * np.pi * 13 * t / 1000))[1000:3000].max() < 0.1
    assert filters.notch_lines(frame(spark, x[:10]), 1000, []).count() == 10


def test_downsample(spark):
    t = np.arange(2000)
    x = np.sin(2 * np.pi * t / 200) + np.sin(2 * np.pi * t / 2.5)
    y = array(filters.downsample(frame(spark, x), 5, block=333))[0]
    assert len(y) == 400 and np.abs(y - np.sin(2 * np.pi * t[::5] / 200))[40:-40].max() < 0.05


def test_tapers():
    v, lam = design.tapers(200, 4, 7)
    assert np.allclose(v @ v.T, np.eye(7), atol=1e-10) and lam[0] > 0.999999 and (np.diff(lam) < 1e-9).all()


def test_projection_keeps_its_band():
    t = np.arange(2000) / 1000
    inside, outside = np.cos(2 * np.pi * 80 * t), np.cos(2 * np.pi * 200 * t)
    y = filters.slepian(inside + outside, 30, 1000, 80)
    assert np.linalg.norm((y - inside)[100:-100]) / np.linalg.norm(inside) < 3e-2


def test_envelope(spark):
    t = np.arange(3000)
    x = (1 + 0.5 * np.cos(2 * np.pi * t / 1500)) * np.cos(2 * np.pi * t / 10)
    y = array(filters.envelope(frame(spark, x), 500, 100))[0]
    assert np.abs(y - 1 - 0.5 * np.cos(2 * np.pi * t / 1500))[100:-100].max() < 0.05


def test_long_convolution_and_short_agree(spark):
    x = np.random.default_rng(2).standard_normal((2, 900))
    taps = np.hanning(41)
    a, b = array(filters.convolve(frame(spark, x), taps, 150)), array(filters_sql.fir(frame(spark, x), taps.tolist(), 20, 100))
    want = np.stack([np.convolve(r, taps, "same") for r in x])
    assert np.allclose(a, want) and np.allclose(b, want)


def test_moving_projection_is_an_average_of_projections(spark):
    n, bw, x = 20, 0.1, np.random.default_rng(3).standard_normal(120)
    v, lam = design.tapers(n, n * bw, max(1, int(round(2 * n * bw)) - 1))
    padded = np.concatenate((np.zeros(n - 1), x, np.zeros(n - 1)))
    total = np.zeros(len(padded))
    for a in range(len(padded) - n + 1):
        total[a : a + n] += v.T @ (lam * (v @ padded[a : a + n])) / n
    assert np.allclose(array(filters.moving_projection(frame(spark, x), n, bw, block=50))[0], total[n - 1 : n - 1 + len(x)], atol=1e-10)


def test_white_noise_stays(spark):
    x = np.random.default_rng(4).standard_normal(2000)
    for k in range(2, len(x)):
        x[k] += 1.5 * x[k - 1] - 0.7 * x[k - 2]
    y = filters.ar_whiten(x, 4)
    c = np.corrcoef(y[10:-1], y[11:])[0, 1]
    assert abs(c) < 0.05


def test_electrode_there_and_back(spark):
    x = np.random.default_rng(5).standard_normal((1, 400))
    circuits = spark.createDataFrame([(0, 1e6, 1e-9, 1e4)], "channel long, r double, c double, series double")
    there = filters.convert_electrode(frame(spark, x), circuits, 1000, block=90)
    assert np.allclose(array(filters.convert_electrode(there, circuits, 1000, inverse=True, block=120)), x, atol=1e-9)
    assert np.allclose(design.circuit((1e4 * 1e6 * 1e-9, 1e4 + 1e6), (1e6 * 1e-9, 1.0)), (1e6, 1e-9, 1e4))


def test_polynomials_leave_nothing_of_themselves(spark):
    sites = spatial.sites(spark, 5, 5)
    r, c = np.divmod(np.arange(25), 5)
    x = np.stack([1 + 2 * r - c + 0.5 * r * c + r * r, r * 0.0 + 3], axis=1)
    assert np.allclose(array(spatial.poly_residual(frame(spark, x), sites, 2).select("channel", "t", "value")), 0, atol=1e-9)


def test_inpaint_and_raster_fill(spark):
    y, x = np.mgrid[:8, :8]
    image = 2.0 * x + y
    mask = np.zeros((8, 8), bool)
    mask[3, 3] = mask[4, 5] = True
    broken = np.where(mask, 99.0, image)
    assert np.abs(spatial.inpaint(broken, mask) - image).max() < 0.5
    df = spark.createDataFrame([(0, int(i), int(j), None if mask[i, j] else float(image[i, j])) for i in range(8) for j in range(8)], "t long, row long, col long, value double")
    rows = {(r.row, r.col): r.value for r in spatial.raster_fill(df, 8, 8).collect()}
    assert rows[3, 3] == image[3, 3] and rows[0, 0] == 0


def test_whole_signal_is_filtered(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((2, 2300)) + 5
    rows = [(2 * t + c, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t), "ab"[c], float(x[c, t])) for t in range(x.shape[1]) for c in range(2)]
    pd.DataFrame(rows, columns=["event_id", "ts", "event_type", "value"]).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")

    def loop(x, y):
        out = []
        for v in x:
            y = 0.2 * v + 0.8 * y
            out.append(y)
        return out

    for name, want in (("first_order_iir", [loop(v, 0.0) for v in x]), ("zero_phase_iir", [loop((f := loop(v, v[0]))[::-1], f[-1])[::-1] for v in x])):
        got = {(r.channel, r.t): r.value for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(got) == x.size and all(abs(got[c, t] - want[c][t]) < 2e-6 for c, t in got)


def test_multitaper_takes_whole_channels(spark):
    rng, sizes = np.random.default_rng(0), {0: 700, 1: 37, 2: 1, 3: 3001}
    series = {c: rng.standard_normal(n) + 3 + 2 * np.sin(0.3 * np.arange(n)) for c, n in sizes.items()}
    signal = spark.createDataFrame([(c, t + 5, float(x)) for c, v in series.items() for t, x in enumerate(v)], "channel long, t long, value double")
    got = filters.multitaper_psd(signal, 1000.0).toPandas().sort_values(["channel", "frequency"])
    assert sorted(got["channel"].unique()) == [0, 1, 2, 3]
    for c, x in series.items():
        n, own = len(x), got[got["channel"] == c]
        m2 = math.ceil(math.sqrt(n))
        m = m2 * math.ceil(n / m2)
        v, lam = design.tapers(n, min(4.0, n / 4), 7)
        want = lam @ np.abs(np.fft.rfft(v * (x - x.mean()), m, axis=1)) ** 2 / lam.sum() / 1000.0
        want[1 : (m + 1) // 2] *= 2
        assert np.allclose(own["frequency"], np.fft.rfftfreq(m, 1 / 1000.0))
        assert np.allclose(own["power"], want, rtol=1e-2 if n > 1024 else 1e-9, atol=1e-4 * want.max() + 1e-12)
