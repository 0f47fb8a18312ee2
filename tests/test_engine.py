"""Slices, guards, masks, triggers, experiments, sources, stores, sessions and jobs."""

import datetime
import math
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import text
from tidemark.operators import events, experiment, joining, parallel, reduce, slicing, spatial
from tidemark.plans import ordered
from tidemark.plans.rangejoin import bucketed
from tidemark.sources import catalog, openephys, other, store, tables
from tidemark.streaming import causal

from test_numeric import array, frame


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.one_of(st.none(), st.integers(-45, 45)), st.one_of(st.none(), st.integers(-45, 45)), st.one_of(st.none(), st.integers(-5, 5).filter(bool)))
def test_bounds(n, a, b, c):
    assert list(slicing.bounds(slice(a, b, c), n)) == list(range(n))[slice(a, b, c)]


@pytest.mark.parametrize("chans, times", [(slice(None, None, -2), slice(70, 10, -7)), ([1, 4, 7], slice(5, 60)), (slice(-3, None), slice(None, None, 9)), (slice(5, 5), slice(None))])
def test_slices_as_numpy(spark, chans, times):
    x = np.arange(800.0).reshape(10, 80)
    got = slicing.slice_signal(frame(spark, x), chans, times, 10, 80)
    want = x[chans][:, times]
    assert got.count() == want.size
    if want.size:
        assert np.array_equal(array(got), want)


def test_slices_that_cannot_be(spark):
    s = frame(spark, np.zeros((2, 3)))
    with pytest.raises(ValueError):
        slicing.slice_signal(s, [2, 1])
    with pytest.raises(ValueError):
        slicing.slice_signal(s, slice(-1, None))
    with pytest.raises(slicing.MemoryGuardError):
        slicing.collect_array(s, limit=8)
    assert slicing.expand((1, ..., 2), 4) == (1, slice(None), slice(None), 2)


def test_blocks(spark):
    x = np.arange(100.0)[None]
    rows = slicing.blocks(frame(spark, x), 20, 10).groupBy("block").count().orderBy("block").collect()
    assert slicing.block_count(100, 20, 10) == len(rows) == 10 and rows[-1]["count"] == 10
    assert [len(b) for b in slicing.channel_batches(5, 10, each=2)] == [2, 2, 1]


def test_masks(spark):
    mask = spark.createDataFrame([(c, True) for c in range(6)], "channel long, active boolean")
    once = slicing.refine_mask(mask, [True, False, True, True, False, True])
    twice = slicing.refine_mask(once, [False, True, True, True])
    assert [r.channel for r in twice.where("active").orderBy("channel").collect()] == [2, 3, 5]
    with pytest.raises(ValueError):
        slicing.refine_mask(mask, [True])
    assert slicing.refine_mask(twice, None).where("active").count() == 6


def test_reductions_with_nan(spark):
    x = np.array([[1.0, np.nan, 3.0], [4.0, 5.0, 6.0]])
    rows = {r.channel: r for r in reduce.reduce_axis(frame(spark, x), 1).collect()}
    assert np.isnan(rows[0]["min"]) and np.isnan(rows[0]["max"]) and rows[1]["max"] == 6


def test_fences_of_equal_quartiles_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (5.0,), (float("nan"),)], "value double")
    assert sorted(str((r.value, r.inlier)) for r in reduce.fences(df, []).collect()) == sorted(str(x) for x in [(1.0, True)] * 3 + [(5.0, False), (float("nan"), False)])


def test_roc():
    assert reduce.integrate_roc([(0, 0), (0.5, 0.5), (1, 1)]) == pytest.approx(0.5)
    assert reduce.integrate_roc([(0.0, 1.0)]) == pytest.approx(1.0)


def test_quantised_and_back(spark):
    x = np.random.default_rng(0).standard_normal((1, 50))
    q = reduce.quantize(frame(spark, x))
    assert np.abs(array(reduce.rescale(q).select("channel", "t", "value")) - x).max() < np.ptp(x) / 255


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 300), unique=True, max_size=40), st.integers(2, 30))
def test_debounce_is_greedy(spark, edges, isi):
    kept = []
    for t in sorted(edges):
        if not kept or t - kept[-1] >= isi / 2:
            kept.append(t)
    df = spark.createDataFrame([(t,) for t in edges], "t long")
    assert sorted(r.t for r in events.debounce(df, isi).collect()) == kept


def test_process_trigger(spark):
    x = np.zeros((1, 4000))
    for k in range(100, 4000, 200):
        x[0, k : k + 20] = 5
    x[0, 505:508] = 0  # a bounce
    edges = sorted(r.t for r in events.process_trigger(frame(spark, x + 0.01 * np.sin(np.arange(4000))), clean=True).collect())
    assert edges == list(range(100, 4000, 200))
    assert events.rising_edges(spark.createDataFrame([(0, True), (1, False)], "t long, level boolean")).count() == 0


def test_epoch_bounds(spark):
    x = np.arange(50.0)[None]
    trig = spark.createDataFrame([(3,), (20,), (45,)], "k long")
    assert {r.k for r in events.epochs(frame(spark, x), trig, 5, 5).collect()} == {20}
    filled = events.epochs(frame(spark, x), trig, 5, 6, fill=0.0, bounds="fill").collect()
    assert len(filled) == 33 and {(r.k, r.dt): r.value for r in filled}[3, 0] == 0.0
    assert events.epochs(frame(spark, x), trig.where("k < 0"), 5, 5).count() == 0


def test_range_join_is_whole_and_no_loop(spark):
    t = spark.range(1000).withColumnRenamed("id", "t")
    iv = spark.createDataFrame([(-5, 3), (10, 200), (150, 151), (990, 2000), (7, 7)], "a long, b long")
    from pyspark.sql import functions as F

    out = bucketed(t, iv, F.col("a"), F.col("b"), 64)
    assert out.count() == 3 + 190 + 1 + 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_conditions(spark):
    df = spark.createDataFrame([(i, i % 2, i % 3) for i in range(12)], "event_no long, a long, b long")
    rows = experiment.conditions(df, ["a", "b"]).collect()
    assert all(r.condition == r.a * 3 + r.b for r in rows)
    assert {r.condition for r in experiment.conditions(df, []).collect()} == {1}
    with pytest.raises(ValueError):
        experiment.conditions(df, ["zzz"])
    with pytest.raises(RuntimeError):
        experiment.fix_triggers(spark.createDataFrame([(1.0,), (2.0,)], "t double"), 5)
    assert experiment.tonotopy(spark.range(50).withColumnRenamed("id", "event_no"), rotate=True).count() == 50


def test_joins_say_what_is_missing(spark):
    sites = spatial.sites(spark, 2, 2)
    with pytest.raises(Exception, match="no channel at"):
        joining.lookup(sites.select("channel", "row", "col"), spark.createDataFrame([(7, 7)], "row long, col long")).collect()
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="off the grid"):
        spark.range(5).select(spatial.to_site(F.col("id"), 2, 2)[0]).collect()
    with pytest.raises(ValueError):
        joining.union_recordings([spark.range(1), spark.range(1).withColumnRenamed("id", "x")])


def test_connect_and_export(spark):
    a = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "pin long, next long")
    b = spark.createDataFrame([(10, 100), (11, None)], "pin long, next long")
    assert {(r.pin, r.site) for r in spatial.connect([a, b]).collect()} == {(0, 100), (1, None), (2, None)}
    assert [r.kind for r in spatial.export_map(spatial.sites(spark, 1, 2), 3).orderBy("channel").collect()] == ["electrode_data", "electrode_data", "no_electrode"]


def test_scaling_step():
    assert text.scaling_step(0.005) == (1, 1e3)
    step, factor = text.scaling_step(50.0)
    assert step == 10 and factor == 1


def test_session_without_date(spark):
    with pytest.raises(Exception, match="no date"):
        text.session_days(spark.createDataFrame([("abc",)], "name string")).collect()
    days = text.session_days(spark.createDataFrame([("x2016-07-01",), ("2016-07-17_b",)], "name string"))
    assert sorted(r.days for r in days.collect()) == [0, 16]


def test_open_ephys(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = rng.integers(-3000, 3000, (3, 64 * 5))
    for c in range(3):
        openephys.write_continuous(tmp_path / f"100_CH{c + 1}.continuous", data[c], 64)
    openephys.register(spark)
    df = spark.read.format("openephys").option("recordsPerSplit", "2").option("ignoreLastRecord", "false").load(str(tmp_path))
    s = openephys.signal(df, microvolts=False)
    got = array(s.withColumn("channel", s.channel - 1))
    assert np.array_equal(got, data)
    assert df.where("channel = 2 and record >= 3").count() == 2
    assert spark.read.format("openephys").load(str(tmp_path)).count() == 12
    ev = np.zeros(4, openephys.EVENT)
    ev["timestamp"] = [1, 5, 9, 12]
    openephys.write_events(tmp_path / "all_channels.events", ev)
    assert [r.timestamp for r in spark.read.format("openephys").option("kind", "events").load(str(tmp_path)).orderBy("timestamp").collect()] == [1, 5, 9, 12]
    raw = bytearray((tmp_path / "100_CH1.continuous").read_bytes())
    raw[1024 + 8] ^= 1
    (tmp_path / "100_CH1.continuous").write_bytes(raw)
    with pytest.raises(ValueError, match="record 0"):
        openephys.read_records(tmp_path / "100_CH1.continuous", samples=64)


def test_packed(spark, tmp_path):
    data = np.arange(2 * 128).reshape(2, 128)
    for c in range(2):
        openephys.write_continuous(tmp_path / f"100_CH{c + 1}.continuous", data[c], 64)
    openephys.pack(tmp_path, tmp_path / "flat.dat", reference="average")
    got = array(other.raw_binary(spark, str(tmp_path / "flat.dat"), 2).drop("path"))
    assert np.array_equal(got, data - np.round(data.mean(axis=0)))


def test_impedance_text(spark, tmp_path):
    (tmp_path / "z.txt").write_text("title\nmore\nSite\tm\tp\n0\t1.5\t-30\t2.0\t-40\n1\t0.5\t10\t0.25\t20\nend\n")
    rows = other.impedance_text(spark, str(tmp_path / "z.txt"), 1.0).orderBy("site", "frequency_no").collect()
    assert [(r.site, r.frequency_no, r.magnitude, r.phase) for r in rows] == [(0, 0, 1.5, -30), (0, 1, 2.0, -40), (1, 0, 0.5, 10), (1, 1, 0.25, 20)]


def test_stimulus_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<Run><Passes><Pass ID="1" BlockID="0"><Event Data="1,2.5,9"/></Pass><Pass ID="2" BlockID="1"><Event Data="4,5.5,6"/></Pass></Passes></Run>')
    rows = other.stimulus_passes(spark, str(tmp_path / "s.xml"), {"contrast": 1, "angle": 2}, skip_blocks=(1,)).collect()
    assert [(r.ID, r.contrast, r.angle) for r in rows] == [(1, 2.5, 9.0)]


def test_store(spark, tmp_path):
    store.save(tmp_path / "a", {"x": spark.range(5), "k": 3, "z": 1 + 2j, "sub": {"y": spark.range(2), "none": None}})
    back = store.load(spark, tmp_path / "a")
    assert back.x.count() == 5 and back.k == 3 and back.z == 1 + 2j and back.sub.y.count() == 2 and back.sub["none"] is None
    assert store.list_results(tmp_path) == ["a", "a/sub"]
    with pytest.raises(TypeError):
        store.save(tmp_path / "b", {"o": object()})
    masks = store.MaskStore(spark, str(tmp_path / "m"))
    m = spark.createDataFrame([(0, True), (1, False)], "channel long, active boolean")
    masks.stash("s", "r", m)
    masks.stash("s", "r", m.where("channel = 0"))
    assert masks.lookup("s", "r").count() == 2 and masks.names() == [("s", "r")]
    masks.stash("s", "r", m.where("channel = 0"), overwrite=True)
    assert masks.lookup("s", "r").count() == 1


def test_pruned_reads(spark, tmp_path):
    from tidemark.operators.filters import to_blocks

    x = np.arange(400.0).reshape(2, 200)
    store.write_blocks(to_blocks(frame(spark, x), 50), str(tmp_path / "b"))
    got = store.read_range(spark, str(tmp_path / "b"), 60, 130, 50, [1])
    assert sorted(r.value for r in got.collect()) == [float(v) for v in range(260, 330)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block,1)" in plan and "LessThanOrEqual(block,2)" in plan and "EqualTo(channel,1)" in plan


def test_sessions(tmp_path, spark):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "s1_conf.txt").write_text("[session]\nheadstage = x\nbandpass = (2, 300)\n[rec1]\ncar = True\nunits = none\n[rec2]\nbandpass = 1.5, 200\n")
    own = catalog.read_session(catalog.find_session(tmp_path, "g/s1"))
    assert own["rec1"]["bandpass"] == (2, 300) and own["rec1"]["car"] is True and own["rec1"]["units"] is None
    assert own["rec2"]["bandpass"] == (1.5, 200.0) and catalog.sessions(tmp_path) == ["g/s1"]
    table = text.session_table(catalog.conf_table(spark, tmp_path / "g" / "s1_conf.txt").where("section <> 'session'"), ["car"])
    assert {r.section: r.car for r in table.collect()} == {"rec1": "True", "rec2": "unknown"}
    assert catalog.options({"a": 1}, {"a": 0, "b": 2}, {"b": None}, {"c": 3}, {"c": 4}) == {"a": 1, "b": 2, "c": 4}
    assert catalog.modern({"useFs": 500, "odd": 1}) == {"resample_rate": 500}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 200), st.integers(1, 12))
def test_divide(n, k):
    parts = parallel.divide(n, k)
    sizes = [s.stop - s.start for s in parts]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_jobs(spark):
    rows = parallel.run_jobs(spark, lambda a, b: a / b, [(1, 2), (1, 0), (3, 4)]).collect()
    assert [r.i for r in rows] == [0, 1, 2] and rows[0].value == 0.5 and rows[1].error_type == "ZeroDivisionError" and np.isnan(rows[1].value)
    with pytest.raises(RuntimeError, match="job 1"):
        parallel.run_jobs(spark, lambda a, b: a / b, [(1, 2), (1, 0)], reraise=True)


def test_streams_are_the_batch(spark, tmp_path):
    from tidemark.functions import design
    from tidemark.operators import filters

    x = np.random.default_rng(0).standard_normal(300)
    schema = "recording string, channel long, t0 long, samples array<double>"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sos = design.butter(30, 100, 1000, 3)
    q = causal.filter_stream(stream, sos).writeStream.format("memory").queryName("filtered").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for k in range(3):
        spark.createDataFrame([("r", 0, k * 100, x[k * 100 : k * 100 + 100].tolist())], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    got = np.concatenate([r.samples for r in spark.table("filtered").orderBy("t0").collect()])
    assert np.allclose(got, filters.run_sos(sos, x, filters.steady(sos) * x[0])[0])


def test_stream_edges_and_late_samples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "recording string, t long, level boolean"
    q = causal.debounce_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5).writeStream.format("memory").queryName("edges").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for part in ([(0, False), (1, True), (2, False), (3, True)], [(2, True), (4, False), (9, True)], [(10, False), (20, True)]):
        spark.createDataFrame([("r", t, v) for t, v in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert sorted(r.t for r in spark.table("edges").collect()) == [1, 9, 20]


def test_late_events_are_dropped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "ts timestamp, event_type string, value double"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    q = causal.sliding(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "5 minutes", late="2 minutes").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for part in ([(at(1), 1.0)], [(at(30), 2.0)], [(at(2), 9.0)], [(at(59), 3.0)]):
        spark.createDataFrame([(t, "a", v) for t, v in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert sorted((r.mean, r.n) for r in spark.table("late").collect()) == [(1.0, 1), (2.0, 1)]


def test_whole_tables_are_looked_up(spark, tmp_path):
    value = np.random.default_rng(0).random((2, 60)) * 40
    events = pd.DataFrame([(2 * t + c + 1, pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=t), c, ("click", "view")[c], value[c, t]) for t in range(60) for c in range(2)], columns=["event_id", "ts", "user_id", "event_type", "value"])
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    pd.DataFrame({"s_suppkey": [1, 2, 3]}).to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"c_custkey": [3, 6]}).to_parquet(tmp_path / "customer.parquet")
    rows = registry.QUERIES["nearest_channel"](spark, str(tmp_path)).collect()
    assert len(rows) == 120
    for r in rows:
        y, x = value[r.id, r.t] % 7, value[r.id, r.t] % 5
        far, channel = min((math.hypot(y - c // 8, x - c % 8), c) for c in range(64))
        assert r.channel == channel and abs(r.distance - far) < 2e-6
    got = {r.section: r for r in registry.QUERIES["session_table"](spark, str(tmp_path)).collect()}
    assert {k: (r.click, r.view, r.error) for k, r in got.items()} == {"rec0": ("119", "unknown", "unknown"), "rec1": ("unknown", "120", "unknown")}
    assert {(r.pin, r.site) for r in registry.QUERIES["pin_chain"](spark, str(tmp_path)).collect()} == {(1, 3), (2, 6), (3, -1)}


def test_silent_and_constant_channels_divide_as_numpy_does(spark):
    x = np.array([[0.0, 0, 0, 0], [2.0, 2, 2, 2], [1.0, 2, 3, 4]])
    df = frame(spark, x)
    for how in ("unity", "center"):
        got = array(reduce.normalise(df, ["channel"], how))
        assert np.isnan(got[:2]).all() and np.isfinite(got[2]).all()
    for how in ("density", "sphere"):
        got = array(reduce.normalise(df, ["channel"], how))
        assert np.isnan(got[0]).all() and np.isfinite(got[1:]).all()
    levels = array(reduce.quantize(df, ["channel"]).select("channel", "t", F.col("level").alias("value")))
    assert (levels[:2] == 0).all() and levels[2].max() == 255
    assert reduce.normalise(df.where("t < 0"), ["channel"], "unity").count() == 0
    one = reduce.normalise(df.where("t = 0"), ["channel"], "center").collect()
    assert len(one) == 3 and all(np.isnan(r.value) for r in one)


def test_trigger_report_of_silent_channels(spark):
    x = np.array([[0.0, 0, 0, 0, 0, 0], [0.0, 5, 5, 0, 5, 0], [5.0, 5, 5, 5, 5, 5]])
    got = {r.channel: (r.edges, r.binary) for r in other.trigger_report(frame(spark, x)).collect()}
    assert got == {0: (0, False), 1: (2, True), 2: (0, True)}
    assert other.trigger_report(frame(spark, x).where("t < 0")).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(0)
    groups = {0: rng.standard_normal(20_000), 1: np.repeat(1.0, 9000), 2: np.concatenate((np.zeros(6000), rng.random(6001))), 3: rng.random(7), 4: np.array([2.0]), 5: rng.integers(0, 5, 5000).astype(float)}
    df = spark.createDataFrame(pd.DataFrame([(c, x) for c, own in groups.items() for x in own], columns=["channel", "value"]))
    ps = [0, 5, 25, 50, 99.9, 100]
    for r in reduce.order_statistics(df, ["channel"], ps).collect():
        assert np.allclose([r[f"_p{k}"] for k in range(len(ps))], np.percentile(groups[r.channel], ps), rtol=1e-12)
    for r in reduce.percentile_nearest(df, ["channel"], 90).collect():
        own = np.sort(groups[r.channel])
        assert r.prctile == own[min(int(np.rint(len(own) * 0.9)), len(own) - 1)]
    whole = np.concatenate(list(groups.values()))
    assert np.allclose(list(reduce.percentile_linear(df, [], [10, 90]).first()), np.percentile(whole, [10, 90]), rtol=1e-12)
    assert reduce.order_statistics(df.where("channel > 9"), ["channel"], ps).count() == 0


def test_roc_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(reduce, "RANGES", 8)
    monkeypatch.setattr(reduce, "RANGE_ROWS", 10)
    rng = np.random.default_rng(1)
    a, b = np.round(rng.standard_normal(300), 1), np.round(rng.standard_normal(200) + 1, 1)
    one = lambda x: spark.createDataFrame([(float(v),) for v in x], "value double")
    rows = reduce.roc(one(a), one(b)).collect()
    assert {r.threshold for r in rows} == set(a) | set(b)
    assert all(math.isclose(r.fp, (a >= r.threshold).mean()) and math.isclose(r.tp, (b >= r.threshold).mean()) for r in rows)


def test_plans_have_no_loop_and_no_single_task(spark):
    df = frame(spark, np.zeros((2, 50)))
    segments = spark.createDataFrame([(5, 9), (20, 22)], "start long, stop long")
    assert "NestedLoop" not in plan_of(slicing.prune_segments(df, segments))
    level = spark.createDataFrame([(0, 0, False), (0, 1, True), (1, 0, True)], "rec long, t long, level boolean")
    for plan in (plan_of(events.rising_edges(level.drop("rec"))), plan_of(events.rising_edges(level, ("rec",))), plan_of(spatial.poly_residual(df, spatial.sites(spark, 1, 2), 1))):
        assert "SinglePartition" not in plan and "NestedLoop" not in plan
    assert [tuple(r) for r in events.rising_edges(level, ("rec",)).collect()] == [(0, 1)]


def test_numbering_by_ranges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n = 4000
    rows = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 1500, n) // 1000 * 10**9 + rng.integers(0, 30, n), unit="us"), "id": rng.permutation(n), "kind": rng.choice(["a", "b"], n, p=[0.9, 0.1])})
    want = rows.sort_values(["ts", "id"]).reset_index(drop=True)
    df = spark.createDataFrame(rows)
    for df in (df, df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))):
        monkeypatch.setattr(ordered, "RANGE_ROWS", 10**6)
        assert "_range" not in plan_of(ordered.numbered(df, ["ts", "id"]))
        monkeypatch.setattr(ordered, "RANGE_ROWS", 100)
        places = [r[0] for r in ordered.ranged(df, ["ts", "id"]).groupBy("_range").count().select("count").collect()]
        assert sum(places) == n and len(places) > 20 and max(places) < 400
        got = ordered.numbered(df, ["ts", "id"]).toPandas().sort_values("t")
        assert got["t"].tolist() == list(range(n)) and got["id"].tolist() == want["id"].tolist()
        got = ordered.numbered(df, ["ts", "id"], ["kind"]).toPandas().sort_values("t")
        for kind, own in got.groupby("kind"):
            assert own["t"].tolist() == list(range(len(own))) and own["id"].tolist() == want["id"][want["kind"] == kind].tolist()


def whole_windows(df):
    """Columns that lead windows, but for ranges, spans and brackets."""
    return [x for x in re.findall(r"windowspecdefinition\(([^#]*)#", plan_of(df)) if x not in ("_range", "_span", "_i")]


def test_triggers_are_mended_in_parts(spark, sf, monkeypatch):
    whole = [r.t for r in registry.QUERIES["fix_triggers"](spark, sf).orderBy("t").collect()]
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    monkeypatch.setattr(ordered, "SPAN", 16)
    parts = registry.QUERIES["fix_triggers"](spark, sf)
    assert whole_windows(parts) == [] and "_range" in plan_of(parts) and "_span" in plan_of(parts)
    assert [r.t for r in parts.orderBy("t").collect()] == whole
    t = np.cumsum(np.random.default_rng(3).random(900)) - 5
    stamps = experiment.fix_triggers(spark.createDataFrame([(float(x),) for x in t], "t double"), 901)
    assert whole_windows(stamps) == []
    assert np.allclose(sorted(r.t for r in stamps.collect()), [t[0] - np.median(np.diff(t)), *t])


def test_nearest_needs_no_copies_of_points(spark, sf, monkeypatch):
    sites = spark.createDataFrame([(4, 0.0, 0.0), (2, 0.0, 2.0), (7, 3.0, 0.0)], "channel long, y double, x double")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 2.9, 0.1), (3, 0.1, 1.9), (3, 0.1, 1.9), (4, None, 0.0), (5, float("nan"), 0.0)], "id long, y double, x double")
    found = joining.nearest(sites, points)
    assert not re.search("Aggregate[^\n]*id#|Exchange[^\n]*id#|Sort ", plan_of(found))
    assert sorted((r.id, r.channel) for r in found.collect()) == [(1, 2), (2, 7), (3, 2), (3, 2), (4, 2), (5, 2)]
    assert joining.nearest(sites.where("channel > 9"), points).collect() == []
    whole = sorted(map(tuple, registry.QUERIES["nearest_channel"](spark, sf).collect()))
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    parts = registry.QUERIES["nearest_channel"](spark, sf)
    assert re.search(r"windowspecdefinition\(event_type#\w+, _range#", plan_of(parts))
    assert sorted(map(tuple, parts.collect())) == whole


def test_interval_statistics_in_parts(spark, sf, monkeypatch):
    whole = registry.QUERIES["isi_stats"](spark, sf).first()
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    monkeypatch.setattr(ordered, "SPAN", 16)
    parts = registry.QUERIES["isi_stats"](spark, sf)
    assert whole_windows(parts) == [] and parts.first() == whole
    for t, kind in ((np.unique(rng.integers(-500, 9000, 700)), "long"), (np.cumsum(rng.random(700)) * 1e-3, "double"), (np.cumsum(rng.integers(1, 10**12, 300)), "long")):
        edges = spark.createDataFrame([(x,) for x in rng.permutation(t).tolist()], f"t {kind}")
        want = np.diff(t)
        assert np.allclose(list(events.isi_stats(edges).first()), [len(want), *np.percentile(want, [50, 90, 5, 95])], rtol=1e-12)
        assert np.allclose(sorted(r.isi for r in events.intervals(edges).collect()), sorted(want))
    assert events.isi_stats(edges.where("t < 0")).first().n == 0


def test_debounce_in_parts(spark, sf, monkeypatch):
    whole = sorted(r.t for r in registry.QUERIES["debounce"](spark, sf).collect())
    rng = np.random.default_rng(5)
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    monkeypatch.setattr(ordered, "SPAN", 16)
    parts = registry.QUERIES["debounce"](spark, sf)
    assert whole_windows(parts) == [] and "FlatMapGroups" not in plan_of(parts)
    assert sorted(r.t for r in parts.collect()) == whole
    edges = [(rec, int(t)) for rec, most in (("a", 400), ("b", 4000), (None, 900)) for t in rng.integers(-50, most, 200)] + [("c", 7 * k) for k in range(200)]
    df = spark.createDataFrame([edges[k] for k in rng.permutation(len(edges))], "rec string, t long")
    for isi in (0, 5, 40, 300):
        got = sorted(map(repr, map(tuple, events.debounce(df, isi, ("rec",)).collect())))
        kept = []
        for rec in ("a", "b", "c", None):
            last = None
            for t in sorted(t for r, t in edges if r == rec):
                if last is None or t - last >= isi / 2:
                    kept.append((rec, last := t))
        assert got == sorted(map(repr, kept))


def test_edges_of_a_level_numbered_in_parts(spark, sf, monkeypatch):
    whole = sorted(r.t for r in registry.QUERIES["rising_edges"](spark, sf).collect())
    level = sorted(map(tuple, tables.level(spark, sf).collect()))
    monkeypatch.setattr(ordered, "RANGE_ROWS", 50)
    parts = registry.QUERIES["rising_edges"](spark, sf)
    assert whole_windows(parts) == [] and "_range" in plan_of(parts)
    assert sorted(r.t for r in parts.collect()) == whole == [b for (a, was), (b, on) in zip(level, level[1:]) if on and not was]
    assert sorted(map(tuple, tables.level(spark, sf).collect())) == level
