"""Registered queries of the relational operators, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import events, experiment, filters_sql, joining, reduce, resample, slicing, spatial
from tidemark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, mapped: bool = True):
    """Register a query with its SQL (which may use the tables of ``tables.SQL``)."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = f"WITH {tables.SQL.strip()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.strip().lstrip('+').strip()}" if mapped else sql.strip()
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(r(c).alias(c) if c in columns else F.col(c) for c in df.columns))


# -- slices ----------------------------------------------------------------------------------------------------------


@query("SELECT channel - 1 AS channel, t - 100 AS t, value FROM sig WHERE channel >= 1 AND channel < 4 AND t >= 100 AND t < 300")
def slice_channels_time(spark, sf):
    return slicing.slice_signal(tables.signal(spark, sf), slice(1, 4), slice(100, 300))


@query("SELECT channel // 2 AS channel, (t - 5) // 7 AS t, value FROM sig WHERE channel % 2 = 0 AND t >= 5 AND (t - 5) % 7 = 0")
def slice_strided(spark, sf):
    return slicing.slice_signal(tables.signal(spark, sf), slice(None, None, 2), slice(5, None, 7))


@query("SELECT 4 - channel AS channel, (149 - t) // 3 AS t, value FROM sig WHERE t <= 149 AND t > 50 AND (149 - t) % 3 = 0")
def slice_reversed(spark, sf):
    return slicing.slice_signal(tables.signal(spark, sf), slice(None, None, -1), slice(149, 50, -3), n_channels=5, n_times=150)


@query("+ act AS (SELECT channel, (row_number() OVER (ORDER BY channel) - 1)::BIGINT AS n FROM (SELECT DISTINCT channel FROM wide WHERE channel % 3 = 0)) SELECT n AS channel, t, value FROM wide JOIN act USING (channel)")
def channel_mask(spark, sf):
    wide = tables.wide_signal(spark, sf)
    return slicing.mask_channels(wide, wide.select("channel", (F.col("channel") % 3 == 0).alias("active")).distinct())


SEGMENTS = [(10, 50), (200, 260), (300, 301)]


@query("+ seg(a, b, o) AS (VALUES (10, 50, 0), (200, 260, 40), (300, 301, 100)) SELECT channel, (t - a + o)::BIGINT AS t, value FROM sig JOIN seg ON t >= a AND t < b")
def prune_segments(spark, sf):
    return slicing.prune_segments(tables.signal(spark, sf), spark.createDataFrame(SEGMENTS, "start long, stop long"))


@query("SELECT channel, t - 64 AS t, value FROM sig WHERE t >= 64")
def snip_transient(spark, sf):
    return slicing.snip_transient(tables.signal(spark, sf), 64)


@query("SELECT channel, t, value FROM wide WHERE channel IN (3, 7, 11, 13)")
def subset_channels(spark, sf):
    return slicing.subset_channels(tables.wide_signal(spark, sf), [3, 7, 11, 13])


@query("SELECT channel, t, CASE WHEN channel = 1 AND t BETWEEN 20 AND 39 THEN value * 2 ELSE value END AS value FROM sig")
def overwrite_samples(spark, sf):
    s = tables.signal(spark, sf)
    return slicing.overwrite(s, s.where("channel = 1 and t between 20 and 39").withColumn("value", F.col("value") * 2)).select("channel", "t", "value")


@query("SELECT channel, t // 100 AS block, t % 100 AS at, value FROM sig")
def blocks_tumbling(spark, sf):
    return slicing.blocks(tables.signal(spark, sf), 100).select("channel", "block", "at", "value")


@query("SELECT channel, b.block, t - b.block * 60 AS at, value FROM sig JOIN (SELECT unnest(range(0, (SELECT max(t) // 60 + 1 FROM sig)))::BIGINT AS block) b ON t >= b.block * 60 AND t < b.block * 60 + 100")
def blocks_overlap(spark, sf):
    return slicing.blocks(tables.signal(spark, sf), 100, 40).select("channel", "block", "at", "value")


@query("SELECT channel, t // 50 AS block, round(avg(value), 6) + 0.0 AS value FROM sig GROUP BY ALL")
def block_reduce(spark, sf):
    return rounded(slicing.block_reduce(tables.signal(spark, sf), 50), "value")


# -- recordings joined -------------------------------------------------------------------------------------------------

_DAYS = "+ days AS (SELECT strftime(ts, '%Y-%m-%d') AS recording, event_type, value, (row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), event_type ORDER BY ts, event_id) - 1)::BIGINT AS t FROM events), rec AS (SELECT recording, channel, t, value FROM days JOIN chan USING (event_type)), lens AS (SELECT recording, max(t) + 1 AS n FROM rec GROUP BY recording), offs AS (SELECT recording, n, coalesce(sum(n) OVER (ORDER BY recording ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM lens)"


def _recordings(spark, sf):
    from pyspark.sql.window import Window

    day = F.date_format("ts", "yyyy-MM-dd").alias("recording")
    own = tables.load(spark, sf, "events").select(day, "event_type", "value", "ts", "event_id")
    numbered = own.select("recording", "event_type", "value", (F.row_number().over(Window.partitionBy("recording", "event_type").orderBy("ts", "event_id")) - 1).cast("long").alias("t"))
    return numbered.join(F.broadcast(tables.channels(spark, sf)), "event_type").select("recording", "channel", "t", "value")


@query(_DAYS + " SELECT recording, channel, t + o AS t, value FROM rec JOIN offs USING (recording)")
def concat_recordings(spark, sf):
    return joining.concatenate(_recordings(spark, sf)).select("recording", "channel", "t", "value")


@query(_DAYS + " SELECT recording, (greatest(100, o) - o)::BIGINT AS first, (least(900, o + n) - o)::BIGINT AS stop FROM offs WHERE greatest(100, o) < least(900, o + n)")
def concat_route_range(spark, sf):
    lengths = _recordings(spark, sf).groupBy("recording").agg((F.max("t") + 1).alias("n"))
    return joining.route(lengths, 100, 900)


@query(_DAYS + ", sites AS (SELECT DISTINCT recording, channel, channel // 2 AS row, channel % 2 AS col FROM rec WHERE NOT (channel = 2 AND right(recording, 1) = '3')), com AS (SELECT row, col FROM sites GROUP BY row, col HAVING count(DISTINCT recording) = (SELECT count(DISTINCT recording) FROM sites)) SELECT row, col, t + o AS t, value FROM rec JOIN sites USING (recording, channel) JOIN com USING (row, col) JOIN offs USING (recording)")
def join_datasets_intersect(spark, sf):
    rec = _recordings(spark, sf)
    sites = rec.select("recording", "channel").distinct().where("not (channel = 2 and right(recording, 1) = '3')")
    return joining.join_datasets(rec, sites.select("recording", "channel", F.floor(F.col("channel") / 2).cast("long").alias("row"), (F.col("channel") % 2).alias("col")))


@query("SELECT o_orderkey AS event_no, o_totalprice AS t, o_orderstatus AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1e6, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1", mapped=False)
def extend_experiment(spark, sf):
    o = tables.orders(spark, sf).select("event_no", F.col("o_totalprice").alias("t"), F.col("o_orderstatus").alias("kind"))
    return joining.extend(o.where("event_no % 2 = 0"), o.where("event_no % 2 = 1"), 1e6)


@query("SELECT (i // 8)::BIGINT AS row, (i % 8)::BIGINT AS col, i::BIGINT AS channel FROM range(64) x(i) WHERE i % 5 = 0", mapped=False)
def site_lookup(spark, sf):
    sites = spatial.sites(spark, 8, 8)
    return joining.lookup(sites.select("channel", "row", "col"), sites.where("channel % 5 = 0").select("row", "col"))


@query("+ p AS (SELECT channel, t, value FROM sig), pts AS (SELECT channel AS id, t, (value % 7) AS y, (value % 5) AS x FROM p), s AS (SELECT i::BIGINT AS c, (i // 8)::DOUBLE AS sy, (i % 8)::DOUBLE AS sx FROM range(64) q(i)) SELECT id, t, arg_min(c, (sqrt((y - sy)^2 + (x - sx)^2), c)) AS channel, round(min(sqrt((y - sy)^2 + (x - sx)^2)), 6) + 0.0 AS distance FROM pts CROSS JOIN s GROUP BY id, t")
def nearest_channel(spark, sf):
    pts = tables.signal(spark, sf).select(F.col("channel").alias("id"), "t", (F.col("value") % 7).alias("y"), (F.col("value") % 5).alias("x"))
    return rounded(joining.nearest(spatial.sites(spark, 8, 8).select("channel", "y", "x"), pts).select("id", "t", "channel", "distance"), "distance")


@query("+ s AS (SELECT i::BIGINT AS c, i // 8 AS row, i % 8 AS col FROM range(64) q(i)) SELECT a.c AS p1, b.c AS p2, round(sqrt((a.row - b.row)^2 + (a.col - b.col)^2) * 0.4, 4) + 0.0 AS distance FROM s a JOIN s b ON a.c < b.c")
def channel_pairs(spark, sf):
    return joining.channel_pairs(spatial.sites(spark, 8, 8), 0.4).withColumn("distance", F.col("distance") + 0.0)


@query("SELECT DISTINCT (i // 8)::BIGINT AS row, (i % 8)::BIGINT AS col FROM range(64) q(i) WHERE i % 2 = 0 AND i % 3 = 0", mapped=False)
def map_intersection(spark, sf):
    s = spatial.sites(spark, 8, 8)
    maps = s.where("channel % 2 = 0").select(F.lit("a").alias("map"), "row", "col").unionByName(s.where("channel % 3 = 0").select(F.lit("b").alias("map"), "row", "col"))
    return joining.map_intersection(maps)


@query("SELECT DISTINCT channel FROM wide WHERE channel NOT IN (SELECT DISTINCT channel FROM wide WHERE value > 480)")
def channel_setdiff(spark, sf):
    w = tables.wide_signal(spark, sf)
    return joining.difference(w.select("channel").distinct(), w.where("value > 480").select("channel").distinct())


@query("SELECT (row_number() OVER (ORDER BY i) - 1)::BIGINT AS channel, (i // 8)::BIGINT AS row, (i % 8)::BIGINT AS col FROM range(64) q(i) WHERE i IN (1, 4, 10, 3, 18)", mapped=False)
def map_subset(spark, sf):
    return joining.subset_map(spatial.sites(spark, 8, 8), spark.createDataFrame([(c,) for c in (1, 4, 10, 3, 18)], "channel long"))


@query("+ m AS (SELECT user_id::BIGINT AS channel, bool_or(value > 450) AS active FROM events GROUP BY user_id) SELECT channel, active FROM m WHERE channel % 2 = 0 UNION ALL SELECT channel, NOT active FROM m WHERE channel % 2 = 1 AND channel % 3 = 0")
def merge_masks(spark, sf):
    m = tables.load(spark, sf, "events").groupBy(F.col("user_id").cast("long").alias("channel")).agg(F.bool_or(F.col("value") > 450).alias("active"))
    return joining.merge_missing(m.where("channel % 2 = 0"), m.where("channel % 3 = 0").withColumn("active", ~F.col("active")), ["channel"])


# -- reductions --------------------------------------------------------------------------------------------------------

_STATS = 'min(value) AS "min", max(value) AS "max", round(sum(value), 4) + 0.0 AS "sum", round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var, round(stddev_pop(value), 6) + 0.0 AS std'


def _stats(df):
    return rounded(df.withColumn("sum", r("sum", 4)), "mean", "var", "std")


@query(f"SELECT t, {_STATS} FROM sig GROUP BY t")
def reduce_axis0(spark, sf):
    return _stats(reduce.reduce_axis(tables.signal(spark, sf), 0))


@query(f"SELECT channel, {_STATS} FROM sig GROUP BY channel")
def reduce_axis1(spark, sf):
    return _stats(reduce.reduce_axis(tables.signal(spark, sf), 1))


@query(f"SELECT {_STATS} FROM sig")
def reduce_total(spark, sf):
    return _stats(reduce.reduce_axis(tables.signal(spark, sf), None))


@query("SELECT channel, round(var_pop(value) * count(*) / (count(*) - 3), 6) + 0.0 AS var3, round(var_samp(value), 6) + 0.0 AS var1 FROM wide GROUP BY channel")
def var_ddof(spark, sf):
    return rounded(tables.wide_signal(spark, sf).groupBy("channel").agg(reduce.variance(3).alias("var3"), reduce.variance(1).alias("var1")), "var3", "var1")


@query("SELECT channel, value AS prctile FROM (SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY channel) AS n FROM wide) WHERE k = least(round_even(n * 0.9, 0), n - 1)")
def prctile_nearest(spark, sf):
    return reduce.percentile_nearest(tables.wide_signal(spark, sf), ["channel"], 90)


@query("SELECT channel, round(quantile_cont(value, 0.05), 6) + 0.0 AS p5, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95 FROM wide GROUP BY channel")
def prctile_linear(spark, sf):
    return rounded(reduce.percentile_linear(tables.wide_signal(spark, sf), ["channel"], [5, 50, 95]), "p5", "p50", "p95")


@query("+ f AS (SELECT quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM sig) SELECT channel, t, value, (value < hi + 0.5 * (hi - lo) / 2 AND value > lo - 0.5 * (hi - lo) / 2) AS inlier FROM sig CROSS JOIN f")
def tukey_fences(spark, sf):
    return reduce.fences(tables.signal(spark, sf), [], thresh=0.5)


@query("+ f AS (SELECT channel, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi FROM wide GROUP BY channel) SELECT channel, t, value, (value < hi + 0.6 * (hi - lo) / 2 AND value > lo - 0.6 * (hi - lo) / 2) AS inlier FROM wide JOIN f USING (channel)")
def tukey_fences_grouped(spark, sf):
    return reduce.fences(tables.wide_signal(spark, sf), ["channel"], thresh=0.6).select("channel", "t", "value", "inlier")


@query("+ n AS (SELECT round(value, 0) AS v FROM sig WHERE channel = 0), s AS (SELECT round(value, 0) AS v FROM sig WHERE channel = 1), th AS (SELECT v FROM n UNION SELECT v FROM s) SELECT th.v AS threshold, round((SELECT count(*) FROM n WHERE n.v >= th.v) / (SELECT count(*) FROM n), 6) + 0.0 AS fp, round((SELECT count(*) FROM s WHERE s.v >= th.v) / (SELECT count(*) FROM s), 6) + 0.0 AS tp FROM th")
def roc_curve(spark, sf):
    s = tables.signal(spark, sf).withColumn("value", F.round("value", 0))
    return rounded(reduce.roc(s.where("channel = 0"), s.where("channel = 1")), "fp", "tp")


@query("+ w AS (SELECT channel, t AS k, value FROM wide), m AS (SELECT max(k) AS m FROM w) SELECT c.channel, g.k, w.value FROM (SELECT DISTINCT channel FROM w) c CROSS JOIN (SELECT unnest(range(0, (SELECT m + 1 FROM m)))::BIGINT AS k) g LEFT JOIN w ON w.channel = c.channel AND w.k = g.k")
def pad_groups(spark, sf):
    return reduce.pad_groups(tables.wide_signal(spark, sf), "channel", ["t"]).select("channel", "k", "value")


def _norm(how):
    def run(spark, sf):
        return rounded(reduce.normalise(tables.signal(spark, sf), ["channel"], how), "value")

    return run


for _name, _how, _sql in (
    ("unity_norm", "unity", "(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)"),
    ("density_norm", "density", "value / sum(value) OVER w"),
    ("zscore", "center", "(value - avg(value) OVER w) / stddev_pop(value) OVER w"),
    ("sphere_norm", "sphere", "value / sqrt(sum(value * value) OVER w)"),
):
    query(f"SELECT channel, t, round({_sql}, 6) + 0.0 AS value FROM sig WINDOW w AS (PARTITION BY channel)", _name)(_norm(_how))


@query("+ b AS (SELECT min(value) AS lo, max(value) AS hi FROM sig) SELECT channel, t, round_even((value - lo) / (hi - lo) * 255, 0)::BIGINT AS level FROM sig CROSS JOIN b")
def quantize(spark, sf):
    return reduce.quantize(tables.signal(spark, sf)).select("channel", "t", "level")


# -- triggers and epochs -----------------------------------------------------------------------------------------------

_EDGES = "+ edges AS (SELECT t FROM (SELECT t, level, lag(level) OVER (ORDER BY t) AS b FROM lev) WHERE level AND NOT b)"


@query(_EDGES + " SELECT t FROM edges")
def rising_edges(spark, sf):
    return events.rising_edges_sparse(tables.level(spark, sf).where("level"))


@query(_EDGES + ", i AS (SELECT t - lag(t) OVER (ORDER BY t) AS isi FROM edges) SELECT count(isi) AS n, quantile_cont(isi, 0.5) AS median, round(quantile_cont(isi, 0.9), 6) AS p90, round(quantile_cont(isi, 0.05), 6) AS p5, round(quantile_cont(isi, 0.95), 6) AS p95 FROM i")
def isi_stats(spark, sf):
    return rounded(events.isi_stats(events.rising_edges(tables.level(spark, sf))), "median", "p90", "p5", "p95")


@query("WITH RECURSIVE " + tables.SQL.strip() + _EDGES.replace("+", ",") + ", kept(t) AS (SELECT min(t) FROM edges UNION ALL SELECT (SELECT min(e.t) FROM edges e WHERE e.t - kept.t >= 6) FROM kept WHERE kept.t IS NOT NULL) SELECT t FROM kept WHERE t IS NOT NULL", mapped=False)
def debounce(spark, sf):
    return events.debounce(events.rising_edges_sparse(tables.level(spark, sf).where("level")), 12)


_TRIG = "+ trig AS (SELECT t AS k, t % 3 AS condition FROM sig WHERE channel = 1 AND t % 97 = 13), len AS (SELECT max(t) + 1 AS n FROM sig), ep AS (SELECT channel, k, condition, t - k + 10 AS dt, value FROM sig JOIN trig ON t >= k - 10 AND t < k + 30 CROSS JOIN len WHERE k - 10 >= 0 AND k + 30 < n)"


def _epochs(spark, sf):
    s = tables.signal(spark, sf)
    trig = s.where("channel = 1 and t % 97 = 13").select(F.col("t").alias("k"), (F.col("t") % 3).alias("condition"))
    return events.epochs(s, trig, 10, 30)


@query(_TRIG + " SELECT channel, k, condition, dt, value FROM ep")
def epochs(spark, sf):
    return _epochs(spark, sf).select("channel", "k", "condition", "dt", "value")


@query("+ trig AS (SELECT t AS k FROM sig WHERE channel = 1 AND t % 97 = 13), ts AS (SELECT k, unnest(range(0, 40))::BIGINT AS dt FROM trig) SELECT c.channel, k, dt, coalesce(s.value, -1.0) AS value FROM ts CROSS JOIN (SELECT channel FROM chan) c LEFT JOIN sig s ON s.channel = c.channel AND s.t = k - 20 + dt")
def epochs_filled(spark, sf):
    s = tables.signal(spark, sf)
    trig = s.where("channel = 1 and t % 97 = 13").select(F.col("t").alias("k"))
    return events.epochs(s, trig, 20, 20, fill=-1.0, bounds="fill").select("channel", "k", "dt", "value")


@query(_TRIG + " SELECT channel, condition, dt, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM ep GROUP BY ALL")
def epoch_average(spark, sf):
    return rounded(events.epoch_average(_epochs(spark, sf)), "mean")


@query(_TRIG + ", p AS (SELECT channel, condition, k, sqrt(sum(value * value)) AS rms FROM ep GROUP BY ALL), f AS (SELECT channel, condition, quantile_cont(rms, 0.25) AS lo, quantile_cont(rms, 0.75) AS hi FROM p GROUP BY ALL), g AS (SELECT channel, condition, k FROM p JOIN f USING (channel, condition) WHERE rms < hi + CASE WHEN hi = lo THEN 0.5 * hi ELSE 0.5 * (hi - lo) / 2 END) SELECT channel, condition, dt, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM ep JOIN g USING (channel, condition, k) GROUP BY ALL")
def epoch_average_reject(spark, sf):
    return rounded(events.epoch_average(events.reject(_epochs(spark, sf), 0.5)), "mean")


# -- rates -------------------------------------------------------------------------------------------------------------


@query("SELECT channel, t // 4 AS t, value FROM sig WHERE t % 4 = 0")
def decimate(spark, sf):
    return resample.decimate(tables.signal(spark, sf), 4)


@query("+ len AS (SELECT max(t) + 1 AS n FROM sig) SELECT channel, t // 7 AS t, round(sum(CASE WHEN t // 7 < n // 7 THEN value ELSE 0 END), 6) + 0.0 AS value FROM sig CROSS JOIN len GROUP BY ALL")
def aggregate_downsample(spark, sf):
    s = tables.signal(spark, sf)
    return rounded(resample.aggregate(s, 7, s.agg(F.max("t")).first()[0] + 1), "value")


@query("SELECT channel, t // 2 AS t, round(avg(value), 6) + 0.0 AS value FROM sig GROUP BY ALL")
def pair_average(spark, sf):
    return rounded(resample.pair_average(tables.signal(spark, sf)), "value")


@query("SELECT channel, t * 3 + k AS t, round(value + (nx - value) * k / 3, 6) + 0.0 AS value FROM (SELECT channel, t, value, coalesce(lead(value) OVER (PARTITION BY channel ORDER BY t), value) AS nx FROM sig) CROSS JOIN (SELECT unnest(range(0, 3))::BIGINT AS k)")
def upsample_linear(spark, sf):
    return rounded(resample.upsample_linear(tables.signal(spark, sf), 3), "value")


# -- filters -----------------------------------------------------------------------------------------------------------


@query("+ len AS (SELECT channel, max(t) AS m FROM sig GROUP BY channel), ext AS (SELECT channel, t, value FROM sig UNION ALL SELECT channel, -t - 1, value FROM sig WHERE t < 5 UNION ALL SELECT channel, 2 * m + 1 - t, value FROM sig JOIN len USING (channel) WHERE t > m - 5), w AS (SELECT channel, t, value - avg(value) OVER (PARTITION BY channel ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM ext) SELECT channel, t, round(v, 6) + 0.0 AS value FROM w JOIN len USING (channel) WHERE t >= 0 AND t <= m")
def moving_avg_highpass(spark, sf):
    return rounded(filters_sql.ma_highpass(tables.signal(spark, sf), 1 / 11), "value")


@query("SELECT channel, t, round(0.5 * value + 0.3 * coalesce(lag(value, 1) OVER w, 0) + 0.15 * coalesce(lag(value, 2) OVER w, 0) - 0.05 * coalesce(lag(value, 3) OVER w, 0), 6) + 0.0 AS value FROM sig WINDOW w AS (PARTITION BY channel ORDER BY t)")
def fir_filter(spark, sf):
    return rounded(filters_sql.fir(tables.signal(spark, sf), [0.5, 0.3, 0.15, -0.05], block=512), "value")


@query("SELECT channel, t, round((-3 * coalesce(lag(value, 2) OVER w, 0) + 12 * coalesce(lag(value, 1) OVER w, 0) + 17 * value + 12 * coalesce(lead(value, 1) OVER w, 0) - 3 * coalesce(lead(value, 2) OVER w, 0)) / 35, 6) + 0.0 AS value FROM sig WINDOW w AS (PARTITION BY channel ORDER BY t)")
def savgol_smooth(spark, sf):
    return rounded(filters_sql.savgol(tables.signal(spark, sf), 5, 2), "value")


@query("+ f AS (SELECT channel, t // 100 AS b, avg(value) AS m, avg(t) AS c, coalesce(regr_slope(value, t), 0) AS s FROM sig GROUP BY ALL) SELECT sig.channel, t, round(value - m - s * (t - c), 6) + 0.0 AS value FROM sig JOIN f ON f.channel = sig.channel AND f.b = t // 100")
def block_detrend(spark, sf):
    return rounded(filters_sql.detrend(tables.signal(spark, sf), 100), "value")


@query("SELECT channel, t, round(value - avg(value) OVER (PARTITION BY t), 6) + 0.0 AS value FROM sig")
def common_avg_ref(spark, sf):
    return rounded(filters_sql.rereference(tables.signal(spark, sf)), "value")


@query("+ x AS (SELECT channel, t, value, avg(value) OVER (PARTITION BY t) AS r FROM sig) SELECT channel, t, round(value - r * (sum(value * r) OVER w) / (sum(r * r) OVER w), 6) + 0.0 AS value FROM x WINDOW w AS (PARTITION BY channel)")
def regress_common(spark, sf):
    return rounded(filters_sql.regress_common(tables.signal(spark, sf)), "value")


@query("+ s AS (SELECT channel, stddev_pop(value) AS s, count(*) AS n FROM sig GROUP BY channel), f AS (SELECT channel, sum(CASE WHEN abs(value) <= 2 * s THEN value ELSE 0 END * cos(t * (2 * pi() * 60 / 1000))) * 2 / any_value(n) AS c, sum(CASE WHEN abs(value) <= 2 * s THEN value ELSE 0 END * sin(t * (2 * pi() * 60 / 1000))) * 2 / any_value(n) AS d FROM sig JOIN s USING (channel) GROUP BY channel) SELECT channel, t, round(value - c * cos(t * (2 * pi() * 60 / 1000)) - d * sin(t * (2 * pi() * 60 / 1000)), 6) + 0.0 AS value FROM sig JOIN f USING (channel)")
def harmonic_cancel(spark, sf):
    return rounded(filters_sql.harmonic_cancel(tables.signal(spark, sf), 60, 1000), "value")


# -- grids -------------------------------------------------------------------------------------------------------------

_SITES = "+ sites AS (SELECT i::BIGINT AS channel, i // 8 AS row, i % 8 AS col FROM range(64) q(i)), fr AS (SELECT * FROM frames WHERE channel % 7 <> 3)"


def _holey(spark, sf):
    return tables.frames(spark, sf).where("channel % 7 <> 3"), spatial.sites(spark, 8, 8).where("channel % 7 <> 3")


@query(_SITES + " SELECT g.t, sites.row, sites.col, coalesce(fr.value, -9.0) AS value FROM (SELECT DISTINCT t FROM fr) g CROSS JOIN sites LEFT JOIN fr ON fr.t = g.t AND fr.channel = sites.channel")
def grid_embed(spark, sf):
    s, m = _holey(spark, sf)
    return spatial.embed(s, m, 8, 8, -9.0)


@query(_SITES + " SELECT t, channel, value FROM fr")
def grid_gather(spark, sf):
    s, m = _holey(spark, sf)
    return spatial.gather(spatial.embed(s, m, 8, 8), m)


@query(_SITES + ", im AS (SELECT t, row, col, value FROM fr JOIN sites USING (channel)), holes AS (SELECT g.t, row, col FROM (SELECT DISTINCT t FROM fr) g CROSS JOIN sites WHERE channel % 7 = 3) SELECT t, row, col, value FROM im UNION ALL SELECT h.t, h.row, h.col, median(im.value) FROM holes h JOIN im ON im.t = h.t AND abs(im.row - h.row) <= 1 AND abs(im.col - h.col) <= 1 GROUP BY h.t, h.row, h.col")
def grid_median_fill(spark, sf):
    s, m = _holey(spark, sf)
    return spatial.median_fill(spatial.embed(s, m, 8, 8), 8, 8)


@query(_SITES + ", f AS (SELECT t, avg(value) AS m, avg(row) AS mr, avg(col) AS mc, regr_slope(value, row) AS br, regr_slope(value, col) AS bc FROM frames JOIN sites USING (channel) GROUP BY t) SELECT channel, t, round(value - m - br * (row - mr) - bc * (col - mc), 6) + 0.0 AS value FROM frames JOIN sites USING (channel) JOIN f USING (t)")
def poly_residual(spark, sf):
    return rounded(spatial.poly_residual(tables.frames(spark, sf), spatial.sites(spark, 8, 8), 1).select("channel", "t", "value"), "value")


@query("SELECT channel, t, round(value - avg(value) OVER (PARTITION BY t, channel % 4, channel // 32), 6) + 0.0 AS value FROM frames")
def despeckle(spark, sf):
    groups = spatial.sites(spark, 8, 8).select("channel", (F.col("channel") % 4).alias("pin"), F.floor(F.col("channel") / 32).alias("board"))
    return rounded(spatial.despeckle(tables.frames(spark, sf), spatial.sites(spark, 8, 8), groups, ["pin", "board"]), "value")


@query(_SITES + ", bad AS (SELECT row, col FROM sites WHERE channel IN (0, 9, 10, 36)), good AS (SELECT t, row, col, value FROM frames JOIN sites USING (channel) WHERE channel NOT IN (0, 9, 10, 36)) SELECT t, row, col, round(value, 6) + 0.0 AS value FROM good UNION ALL SELECT g.t, b.row, b.col, round(sum(g.value * w) / sum(w), 6) + 0.0 FROM (SELECT bad.row, bad.col, i, j, (CASE WHEN i = 0 THEN 1 ELSE 0.5 END) * (CASE WHEN j = 0 THEN 1 ELSE 0.5 END) AS w FROM bad CROSS JOIN (VALUES (-1), (0), (1)) x(i) CROSS JOIN (VALUES (-1), (0), (1)) y(j)) b JOIN good g ON g.row = b.row + b.i AND g.col = b.col + b.j GROUP BY g.t, b.row, b.col")
def pixel_correct(spark, sf):
    m = spatial.sites(spark, 8, 8)
    image = spatial.embed(tables.frames(spark, sf), m, 8, 8)
    return rounded(spatial.pixel_correct(image, m.where("channel in (0, 9, 10, 36)").select("row", "col")), "value")


@query("SELECT i::BIGINT AS i, (i // 6)::BIGINT AS row_rm, (i % 6)::BIGINT AS col_rm, (i % 4)::BIGINT AS row_cm, (i // 4)::BIGINT AS col_cm, ((i // 6) + (i % 6) * 4)::BIGINT AS to_cm FROM range(24) q(i)", mapped=False)
def index_conventions(spark, sf):
    i = F.col("i")
    rr, cr = spatial.to_site(i, 4, 6)
    rc, cc = spatial.to_site(i, 4, 6, True)
    return spark.range(24).withColumnRenamed("id", "i").select("i", rr.alias("row_rm"), cr.alias("col_rm"), rc.alias("row_cm"), cc.alias("col_cm"), spatial.to_index(rr, cr, 4, 6, True).alias("to_cm"))


@query("+ x AS (SELECT DISTINCT upper(substr('ABCDEFGHJKLMNPRTUVWXYZ', (n_nationkey % 22)::INT + 1, 1)) || ((n_nationkey % 9) + 1) AS site, (n_nationkey % 22)::BIGINT AS row, (n_nationkey % 9)::BIGINT AS col FROM nation) SELECT site, 'signal' AS kind, row, col FROM x UNION ALL SELECT 'ref', 'reference', -1, -1")
def decode_sites(spark, sf):
    letter = F.substring(F.lit(spatial.ALPHABET), (F.col("n_nationkey") % 22 + 1).cast("int"), F.lit(1))
    names = tables.load(spark, sf, "nation").select(F.concat(letter, (F.col("n_nationkey") % 9 + 1).cast("string")).alias("site")).distinct()
    names = names.unionByName(spark.createDataFrame([("ref",)], "site string"))
    kind, row, col = spatial.decode_site(F.col("site"))
    return names.select("site", kind.alias("kind"), F.coalesce(row, F.lit(-1)).alias("row"), F.coalesce(col, F.lit(-1)).alias("col"))


@query("SELECT i::BIGINT AS channel, (i // 4 + 3)::BIGINT AS row, (i % 4 + 4)::BIGINT AS col FROM range(12) q(i)", mapped=False)
def tile_map(spark, sf):
    return spatial.tile(spatial.sites(spark, 3, 4), 224, 3, 4).select("channel", "row", "col")


@query("SELECT i::BIGINT AS code, " + "xor(" * 7 + "i" + "".join(f", i >> {k})" for k in range(1, 8)) + "::BIGINT AS number FROM range(256) q(i)", mapped=False)
def gray_codes(spark, sf):
    return spark.range(256).select(F.col("id").alias("code"), spatial.undo_gray(F.col("id")).alias("number"))


# -- scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT channel, t, round(value * 1000, 6) + 0.0 AS microvolts, round((value + 500) * (16.0 / 1000) - 8, 6) + 0.0 AS volts FROM sig")
def unit_convert(spark, sf):
    return tables.signal(spark, sf).select("channel", "t", r(text.convert_scale(F.col("value"), "mV", "uV")).alias("microvolts"), r(text.convert_range(F.col("value"), (-500.0, 500.0), (-8.0, 8.0))).alias("volts"))


@query("SELECT event_type AS unit, CASE lower(event_type) WHEN 'uv' THEN 'μV' WHEN 'sigma' THEN 'σ' ELSE event_type END AS nice FROM (SELECT DISTINCT event_type FROM events UNION SELECT unnest(['uV', 'SIGMA', 'mV']))", mapped=False)
def nice_units(spark, sf):
    units = tables.load(spark, sf, "events").select("event_type").distinct().unionByName(spark.createDataFrame([("uV",), ("SIGMA",), ("mV",)], "event_type string"))
    return units.select(F.col("event_type").alias("unit"), text.nice_unit(F.col("event_type")).alias("nice"))


@query("+ s AS (SELECT o_orderkey, 'rat ' || strftime(o_orderdate, '%Y-%m-%d') || ' a' AS name, o_orderdate::DATE AS d FROM orders), m AS (SELECT min(d) AS m FROM s) SELECT o_orderkey, name, (d - m)::BIGINT AS days, 'Day ' || lpad((d - m)::BIGINT::VARCHAR, (SELECT max(length((d - m)::BIGINT::VARCHAR)) FROM s CROSS JOIN m)::INT, '0') AS label FROM s CROSS JOIN m")
def session_days(spark, sf):
    own = tables.load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("rat "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" a")).alias("name"))
    return text.session_days(own, sortable=True)


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey * 137 >= 1000 THEN printf('%.1f KHz', n_nationkey * 137 / 1000.0) ELSE printf('%.0f Hz', (n_nationkey * 137)::DOUBLE) END || ' (' || (n_nationkey % 4 * 10) || ')' AS tone, printf('%.2f deg', n_nationkey * 7.5) AS wedge, printf('(%d, %d) %s', n_nationkey, n_nationkey % 5, CASE WHEN n_nationkey % 3 = 0 THEN 'mean' WHEN n_nationkey % 3 = 1 THEN 'bright' ELSE 'dark' END) AS noise FROM nation", mapped=False)
def stim_labels(spark, sf):
    k = F.col("n_nationkey")
    n = tables.load(spark, sf, "nation").select(k.alias("k"), (k * 137).cast("double").alias("tone"), (k % 4 * 10).alias("amp"), (k * 7.5).alias("angle"), k.alias("x"), (k % 5).alias("y"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(-1).alias("contrast"))
    return n.select("k", experiment.stim_label("tone").alias("tone"), experiment.stim_label("wedge").alias("wedge"), experiment.stim_label("noise").alias("noise"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS number, event_id % 2 = 0 AS flag, (event_id % 7)::DOUBLE AS seq0, (event_id % 11)::DOUBLE AS seq1 FROM events", mapped=False)
def parse_params(spark, sf):
    e = tables.load(spark, sf, "events").withColumn("raw", F.get_json_object("props", "$.k"))
    seq = F.concat(F.lit("("), (F.col("event_id") % 7).cast("string"), F.lit(", "), (F.col("event_id") % 11).cast("string"), F.lit(")"))
    flag = text.parse(F.when(F.col("event_id") % 2 == 0, "True").otherwise("no"), "bool_or_num") == 1
    return e.select("event_id", text.parse(F.col("raw"), "bool_or_num").alias("number"), flag.alias("flag"), text.parse(seq, "sequence")[0].alias("seq0"), text.parse(seq, "sequence")[1].alias("seq1"))


# -- conditions --------------------------------------------------------------------------------------------------------

_FEATURES = ["o_orderpriority", "o_orderstatus"]
_CODE = "((dense_rank() OVER (ORDER BY o_orderpriority) - 1) * (SELECT count(DISTINCT o_orderstatus) FROM orders) + dense_rank() OVER (ORDER BY o_orderstatus) - 1)::BIGINT"
_COMBOS = "+ p AS (SELECT DISTINCT o_orderpriority FROM orders), s AS (SELECT DISTINCT o_orderstatus FROM orders), combo AS (SELECT (row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1)::BIGINT AS condition, o_orderpriority, o_orderstatus FROM p CROSS JOIN s)"


@query(f"SELECT o_orderkey AS event_no, o_orderpriority, o_orderstatus, {_CODE} AS condition FROM orders", mapped=False)
def enumerate_conditions(spark, sf):
    return experiment.conditions(tables.orders(spark, sf).select("event_no", *_FEATURES), _FEATURES)


@query(_COMBOS + " SELECT condition, o_orderpriority, o_orderstatus FROM combo")
def condition_decode(spark, sf):
    return experiment.decode_table(tables.orders(spark, sf), _FEATURES)


@query("SELECT count(DISTINCT o_orderpriority) AS n_o_orderpriority, count(DISTINCT o_orderstatus) AS n_o_orderstatus FROM orders", mapped=False)
def rolled_shape(spark, sf):
    return experiment.rolled_shape(tables.orders(spark, sf), _FEATURES)


@query(_COMBOS + " SELECT condition, o_orderpriority, o_orderstatus, count(o_orderkey) AS n, coalesce(min(o_orderkey), -1) AS first_event FROM combo LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'F') USING (o_orderpriority, o_orderstatus) GROUP BY ALL")
def iterate_conditions(spark, sf):
    o = tables.orders(spark, sf).where("o_orderpriority <> '1-URGENT' or o_orderstatus <> 'F'")
    return experiment.iterate_for(o, _FEATURES).select("condition", *_FEATURES, "n", F.coalesce("first_event", F.lit(-1)).alias("first_event"))


@query("SELECT o_orderkey AS event_no, o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1)::BIGINT AS place FROM orders", mapped=False)
def order_for(spark, sf):
    return experiment.order_for(tables.orders(spark, sf).select("event_no", "o_orderpriority"), "o_orderpriority")


@query("+ s AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS condition, o_orderpriority FROM s) SELECT o_orderkey AS event_no, condition FROM orders JOIN c USING (o_orderpriority) WHERE o_orderstatus = 'F'")
def ordered_epochs(spark, sf):
    own, _ = experiment.ordered_epochs(tables.orders(spark, sf).select("event_no", *_FEATURES), {"o_orderstatus": "F"}, _FEATURES)
    return own.select("event_no", "condition")


@query("+ s AS (SELECT DISTINCT o_orderpriority FROM orders), c AS (SELECT (row_number() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS condition, o_orderpriority FROM s) SELECT condition, o_orderpriority, count(o_orderkey) AS size FROM c LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') USING (o_orderpriority) GROUP BY ALL")
def ordered_epoch_sizes(spark, sf):
    _, sizes = experiment.ordered_epochs(tables.orders(spark, sf).select("event_no", *_FEATURES), {"o_orderstatus": "F"}, _FEATURES)
    return sizes.select("condition", "o_orderpriority", "size")


@query("SELECT o_orderkey AS event_no, [3, 1, 4, 1][(o_orderkey % 4)::INT + 1]::BIGINT AS a, [2.5, 7.5, 1.5][(o_orderkey % 3)::INT + 1]::DOUBLE AS b, 9::BIGINT AS c FROM orders", mapped=False)
def repeat_sequences(spark, sf):
    out = experiment.repeat_sequences(tables.orders(spark, sf).select("event_no"), {"a": [3, 1, 4, 1], "b": [2.5, 7.5, 1.5], "c": 9})
    return out.select("event_no", F.col("a").cast("long").alias("a"), "b", F.col("c").cast("long").alias("c"))


@query(_EDGES + ", i AS (SELECT t - lag(t) OVER (ORDER BY t) AS isi FROM edges) SELECT t::DOUBLE AS t FROM edges UNION ALL SELECT (SELECT min(t) FROM edges) - (SELECT quantile_cont(isi, 0.5) FROM i)")
def fix_triggers(spark, sf):
    edges = events.rising_edges_sparse(tables.level(spark, sf).where("level"))
    n = edges.count()
    return experiment.fix_triggers(edges, n + 1, n)


@query("+ c AS (SELECT 'rec' || (user_id % 20) AS section, event_type AS key, max(event_id)::VARCHAR AS value FROM events GROUP BY ALL) SELECT section, " + ", ".join(f"coalesce(max(CASE WHEN key = '{k}' THEN value END), 'unknown') AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " FROM c GROUP BY section")
def session_table(spark, sf):
    e = tables.load(spark, sf, "events")
    conf = e.groupBy(F.concat(F.lit("rec"), (F.col("user_id") % 20).cast("string")).alias("section"), F.col("event_type").alias("key")).agg(F.max("event_id").cast("string").alias("value"))
    return text.session_table(conf, ["click", "error", "purchase", "signup", "view"])


@query("SELECT channel, round(100 * (1 - count(*) FILTER (value > 450 OR value < 20) / count(*)), 6) + 0.0 AS yield_pct FROM wide GROUP BY channel")
def impedance_yield(spark, sf):
    return rounded(text.impedance_yield(tables.wide_signal(spark, sf), ["channel"], 450, 20), "yield_pct")
