"""Recordings as objects, and loading by session."""

import numpy as np
import pytest

from tidemark.operators import spatial
from tidemark.recording import Recording, load_recording, load_recordings, open_source
from tidemark.sources import openephys

from test_numeric import array, frame


@pytest.fixture(scope="module")
def rec(spark):
    x = np.random.default_rng(0).standard_normal((4, 300))
    return x, Recording(frame(spark, x), 1000.0, aligned={"trig": frame(spark, (np.arange(300) % 50 < 5).astype(float))})


def test_slices_and_reductions(rec):
    x, r = rec
    assert r.shape() == (4, 300)
    assert np.allclose(r[1:3, 10:20].array(), x[1:3, 10:20]) and np.allclose(r[::-1, ::-7].array(), x[::-1, ::-7])
    assert np.allclose(r[[0, 2], ...].array(), x[[0, 2]]) and np.allclose(r[:, -1].array(), x[:, -1:])
    assert np.allclose([v.std for v in r.reduce("std", 1).orderBy("channel").collect()], x.std(axis=1))
    assert [b.shape for b in r.iter_blocks(120, 20)] == [(4, 120), (4, 120), (4, 100)]
    assert np.allclose(next(r.iter_blocks(100, reverse=True)), x[:, :199:-1])


def test_join_filter_epochs(spark, rec):
    x, r = rec
    both = r.join(r)
    assert both.shape() == (4, 600) and np.allclose(both.array(), np.concatenate((x, x), axis=1))
    low = r.downsample(ratio=5)
    assert low.fs == 200 and low.shape() == (4, 60) and set(low.aligned) == {"trig"}
    assert np.allclose(r.rereference().array(), x - x.mean(axis=0))
    trig = r.detect_triggers("trig", clean=True)
    assert sorted(t.t for t in trig.triggers.collect()) == [50, 100, 150, 200, 250]
    assert trig.epochs(10, 20).where("k = 100").count() == 4 * 30
    with pytest.raises(ValueError):
        r.downsample()


def test_saved_and_read(spark, rec, tmp_path):
    x, r = rec
    r.save(tmp_path / "r")
    back = Recording.read(spark, tmp_path / "r")
    assert back.fs == 1000 and np.allclose(back.array(), x) and list(back.aligned) == ["trig"]


def test_sessions_load(spark, tmp_path):
    data = np.random.default_rng(1).integers(-2000, 2000, (3, 64 * 20))
    for n in (1, 2):
        folder = tmp_path / "exp" / f"test_{n:03d}"
        folder.mkdir(parents=True)
        for c in range(3):
            openephys.write_continuous(folder / f"100_CH{c + 1}.continuous", data[c], 64, rate=1000.0)
    (tmp_path / "s.txt").write_text(f"[session]\nexp_path = {tmp_path / 'exp'}\ncar = True\n[test_001]\nload_channels = all\n[test_002]\nbandpass = 30, 100\n".replace("load_channels = all\n", "units = uv\n"))
    whole = open_source(spark, tmp_path / "exp" / "test_001", microvolts=False)
    assert whole.fs == 1000 and np.array_equal(whole.array(), data[:, :-64])
    one = load_recording(spark, tmp_path / "s.txt", "test_001").array() / 0.195
    assert np.allclose(one, data[:, :-64] - data[:, :-64].mean(axis=0))
    both = load_recordings(spark, tmp_path / "s.txt", [1, 2])
    assert both.shape() == (3, 2 * 64 * 19)
    with pytest.raises(FileNotFoundError):
        load_recording(spark, tmp_path / "s.txt", "test_001", exp_path=str(tmp_path / "none"))


def test_interpolation(spark):
    rng = np.random.default_rng(2)
    p = rng.random((15, 2)) * 4
    sites = spark.createDataFrame([(k, float(y), float(x)) for k, (y, x) in enumerate(p)], "channel long, y double, x double")
    plane = 1 + 2 * p[:, 0] - 3 * p[:, 1]
    at = [(2.0, 2.0), (1.8, 2.3), (99.0, 99.0)]
    got = {r.point: r.value for r in spatial.interpolate(frame(spark, plane[:, None]), sites, at).collect()}
    assert np.isclose(got[0], 1 + 4 - 6) and np.isclose(got[1], 1 + 3.6 - 6.9) and 2 not in got
