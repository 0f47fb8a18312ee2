"""Registered queries of sources, maps, streams and the remaining scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import events, reduce, slicing, spatial
from tidemark.plans.numeric import _drained, _event_stream
from tidemark.plans.queries import query, r, rounded
from tidemark.sources import other, tables
from tidemark.streaming import causal


@query("SELECT channel % 2 AS row, CASE channel // 2 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END::BIGINT AS col, t, round(value / 20, 6) + 0.0 AS value FROM sig")
def demultiplex(spark, sf):
    return rounded(other.demultiplex(tables.signal(spark, sf), 2, {0: 2, 1: 0, 2: 1}, 20.0), "value")


@query("SELECT channel // 2 AS channel, t, round(avg(value), 6) + 0.0 AS value FROM sig GROUP BY ALL")
def average_oversampled(spark, sf):
    return rounded(other.average_oversampled(tables.signal(spark, sf)), "value")


@query("+ lv AS (SELECT channel, t, CASE WHEN value > 300 THEN 5.0 ELSE 0.0 END AS v FROM sig), e AS (SELECT channel, count(*) AS edges FROM (SELECT channel, t, v, lag(v) OVER (PARTITION BY channel ORDER BY t) AS b FROM lv) WHERE v > 2 AND b < 2 GROUP BY channel) SELECT channel, coalesce(edges, 0) AS edges, two AS \"binary\" FROM (SELECT channel, max(v) > 0 AS two FROM lv GROUP BY channel) LEFT JOIN e USING (channel)")
def trigger_report(spark, sf):
    two = tables.signal(spark, sf).withColumn("value", F.when(F.col("value") > 300, 5.0).otherwise(0.0))
    return other.trigger_report(two)


@query("SELECT i::BIGINT AS channel, CASE WHEN i % 3 = 0 THEN 'electrode_data' ELSE 'no_electrode' END AS kind, CASE WHEN i % 3 = 0 THEN i // 8 ELSE -1 END::BIGINT AS row, CASE WHEN i % 3 = 0 THEN i % 8 ELSE -1 END::BIGINT AS col FROM range(80) q(i) WHERE i % 3 <> 0 OR i < 64 UNION ALL SELECT i::BIGINT, 'no_electrode', -1, -1 FROM range(80) q(i) WHERE i % 3 = 0 AND i >= 64", mapped=False)
def electrode_export(spark, sf):
    own = spatial.sites(spark, 8, 8).where("channel % 3 = 0").select("channel", "row", "col")
    out = spatial.export_map(own, 80)
    return out.select("channel", "kind", F.coalesce("row", F.lit(-1)).alias("row"), F.coalesce("col", F.lit(-1)).alias("col"))


@query("SELECT s_suppkey AS pin, c_custkey AS site FROM (SELECT s_suppkey, s_suppkey * 3 % 1000 AS a FROM supplier) JOIN (SELECT c_custkey AS b, c_custkey FROM customer) ON a = b UNION ALL SELECT s_suppkey, -1 FROM supplier WHERE s_suppkey * 3 % 1000 NOT IN (SELECT c_custkey FROM customer)", mapped=False)
def pin_chain(spark, sf):
    first = tables.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("pin"), (F.col("s_suppkey") * 3 % 1000).alias("next"))
    second = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("pin"), F.col("c_custkey").alias("next"))
    return spatial.connect([first, second]).select("pin", F.coalesce("site", F.lit(-1)).alias("site"))


@query("SELECT c_custkey, c_name, regexp_extract(c_name, '#0*([0-9]+)', 1) AS captured FROM customer WHERE regexp_matches(c_name, '#0*([0-9]+)')", mapped=False)
def regex_capture(spark, sf):
    return text.regex_capture(tables.load(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "#0*([0-9]+)")


@query("SELECT p_partkey, pow(2, ceil(log2(p_size)))::BIGINT AS size FROM part", mapped=False)
def next_power(spark, sf):
    return tables.load(spark, sf, "part").select("p_partkey", text.next_power(F.col("p_size")).alias("size"))


@query("SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'clicks' WHEN 'Brand#2' THEN 'tones' ELSE p_brand END AS brand FROM part", mapped=False)
def swap_values(spark, sf):
    return tables.load(spark, sf, "part").select("p_partkey", text.swap_values(F.col("p_brand"), {"Brand#1": "clicks", "Brand#2": "tones"}).alias("brand"))


@query("+ b AS (SELECT min(value) AS lo, max(value) AS hi FROM sig) SELECT channel, t, round(round_even((value - lo) / (hi - lo) * 255, 0) / 255 * (hi - lo) + lo, 6) + 0.0 AS value FROM sig CROSS JOIN b")
def rescale(spark, sf):
    return rounded(reduce.rescale(reduce.quantize(tables.signal(spark, sf))).select("channel", "t", "value"), "value")


@query("SELECT i::BIGINT AS channel, (i // 8)::BIGINT AS row, (7 - i % 8)::BIGINT AS col FROM range(64) q(i)", mapped=False)
def flip_face(spark, sf):
    return spatial.flip(spatial.sites(spark, 8, 8), 8).select("channel", "row", "col")


@query("SELECT (row_number() OVER (ORDER BY i) - 1)::BIGINT AS channel, (i // 8)::BIGINT AS row, (i % 8)::BIGINT AS col FROM range(64) q(i) WHERE i % 5 <> 1", mapped=False)
def map_from_mask(spark, sf):
    grid = spatial.grid(spark, 8, 8)
    return spatial.from_mask(grid.withColumn("active", (F.col("row") * 8 + F.col("col")) % 5 != 1))


@query("+ p AS (SELECT i, i % 8 + 8 * (i // 8) AS a, 1 AS step FROM range(64) q(i) WHERE i % 8 < 7 UNION ALL SELECT 64 + i, i, 8 FROM range(56) q(i)) SELECT t, i::BIGINT AS point, round((v[a + 1] + v[a + step + 1]) / 2, 6) + 0.0 AS value FROM (SELECT vec_id::BIGINT AS t, embedding::DOUBLE[] AS v FROM embeddings) CROSS JOIN p")
def interpolate_sites(spark, sf):
    """Halfway between all neighbours in a row (points 0 to 63, none past the last column) and in a column (64 to 119)."""
    halves = {i: (float(i // 8), i % 8 + 0.5) for i in range(64) if i % 8 < 7} | {64 + i: (i // 8 + 0.5, float(i % 8)) for i in range(56)}
    out = spatial.interpolate(tables.frames(spark, sf), spatial.sites(spark, 8, 8), list(halves.values()))
    number = F.element_at(F.array(*[F.lit(k).cast("long") for k in halves]), (F.col("point") + 1).cast("int"))
    return rounded(out.select("t", number.alias("point"), "value"), "value")


@query("SELECT t, level FROM (SELECT t, bool_or(value > 250) AS level FROM sig GROUP BY t)")
def any_level(spark, sf):
    return events.any_level(tables.signal(spark, sf), 250.0)


@query("+ act AS (SELECT channel, bool_and(value < 489) AS a FROM wide GROUP BY channel) SELECT bool_and(a) AS direct, count(*) FILTER (a) AS active FROM act")
def direct_map(spark, sf):
    mask = tables.wide_signal(spark, sf).groupBy("channel").agg(F.bool_and(F.col("value") < 489).alias("active"))
    return mask.agg(slicing.is_direct(mask).alias("direct"), F.count_if("active").alias("active"))


@query("+ g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf):
    out = _drained(spark, causal.sessions(_event_stream(spark, sf), "2 hours"), "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("+ m AS (SELECT channel, avg(value) AS m FROM sig GROUP BY channel) SELECT channel, round(m / 1000, 9) + 0.0 AS volts, round((m - 0) * 16 / 500 - 8, 6) + 0.0 AS counts FROM m")
def mean_in_units(spark, sf):
    m = reduce.reduce_axis(tables.signal(spark, sf), 1)
    return m.select("channel", r(text.scaled(F.col("mean"), 0.0, 1 / 1000), 9).alias("volts"), r(text.convert_range(F.col("mean"), 500.0, (-8.0, 8.0))).alias("counts"))
