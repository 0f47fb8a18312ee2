"""Registered queries of recursive filters, spectra, jobs and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import design
from tidemark.operators import filters, parallel
from tidemark.plans.queries import query, rounded
from tidemark.sources import tables
from tidemark.sources.store import shared_dir
from tidemark.streaming import causal


#: A first-order filter in blocks of 200 samples: what an earlier block than the last one adds is below 1e-19 of it.
_IIR = "SELECT channel, t, t // 200 AS b, 0.2 * pow(0.8, t % 200) * sum(value * pow(0.8, -(t % 200))) OVER (PARTITION BY channel, t // 200 ORDER BY t) AS v FROM {0}"
_ENDS = "SELECT channel, b + 1 AS b, arg_max(v, t) AS e FROM {0} GROUP BY ALL"


@query(f"+ f AS ({_IIR.format('sig')}), e AS ({_ENDS.format('f')}) SELECT channel, t, round(v + coalesce(pow(0.8, t % 200 + 1) * e, 0), 6) + 0.0 AS value FROM f LEFT JOIN e USING (channel, b)")
def first_order_iir(spark, sf):
    sos = np.array([[0.2, 0, 0, 1, -0.8, 0]])
    return rounded(filters.from_blocks(filters.sos_blocks(filters.to_blocks(tables.signal(spark, sf), 400), sos, settle=False), 400), "value")


@query(
    f"+ f AS ({_IIR.format('sig')}), e AS ({_ENDS.format('f')} UNION ALL SELECT channel, 0, arg_min(value, t) FROM sig GROUP BY channel), "
    "m AS (SELECT channel, max(t) AS m FROM sig GROUP BY channel), "
    "back AS (SELECT channel, m - t AS t, v + pow(0.8, t % 200 + 1) * e AS value FROM f JOIN e USING (channel, b) JOIN m USING (channel)), "
    f"g AS ({_IIR.format('back')}), h AS ({_ENDS.format('g')} UNION ALL SELECT channel, 0, arg_min(value, t) FROM back GROUP BY channel) "
    "SELECT channel, m - t AS t, round(v + pow(0.8, t % 200 + 1) * e, 6) + 0.0 AS value FROM g JOIN h USING (channel, b) JOIN m USING (channel)"
)
def zero_phase_iir(spark, sf):
    sos = np.array([[0.2, 0, 0, 1, -0.8, 0]])
    return rounded(filters.from_blocks(filters.filter_blocks(filters.to_blocks(tables.signal(spark, sf), 300), sos), 300), "value")


@query()
def butter_bandpass(spark, sf):
    return rounded(filters.filter_signal(tables.signal(spark, sf), "butter", lo=30, hi=100, fs=1000, order=3, block=500), "value")


@query()
def notch_lines(spark, sf):
    return rounded(filters.notch_lines(tables.signal(spark, sf), 1000, 60.0, highest=200, block=500), "value")


@query()
def cheby_downsample(spark, sf):
    return rounded(filters.downsample(tables.signal(spark, sf), 4, block=500), "value")


@query()
def analytic_envelope(spark, sf):
    return rounded(filters.envelope(tables.signal(spark, sf), 500, 100), "value")


@query()
def slepian_projection(spark, sf):
    return rounded(filters.slepian_projection(tables.signal(spark, sf), 0.02, block=250), "value")


@query()
def moving_projection(spark, sf):
    return rounded(filters.moving_projection(tables.signal(spark, sf), 50, 0.04, block=500), "value")


@query()
def multitaper_psd(spark, sf):
    return rounded(filters.multitaper_psd(tables.signal(spark, sf), 1000, 4), "power")


@query()
def ar_whiten(spark, sf):
    return rounded(filters.whiten(tables.signal(spark, sf), 10, 500), "value")


@query()
def remove_modes(spark, sf):
    return rounded(filters.remove_modes(tables.frames(spark, sf), 1, "power", 100), "value")


@query()
def upsample_sinc(spark, sf):
    return rounded(filters.upsample_sinc(tables.signal(spark, sf), 2, 500, 50), "value")


@query()
def electrode_current(spark, sf):
    s = tables.signal(spark, sf)
    circuits = s.select("channel").distinct().withColumn("r", F.lit(1e6)).withColumn("c", F.lit(1e-9) * (F.col("channel") + 1)).withColumn("series", F.lit(1e4))
    out = filters.convert_electrode(s, circuits, 1000, block=500)
    return out.withColumn("value", F.round(F.col("value") * 1e6, 6))


@query("SELECT channel, t, round(2 * value + 3, 6) + 0.0 AS value FROM sig")
def split_map(spark, sf):
    def run(pdf, shared):
        pdf = pdf.copy()
        pdf["value"] = pdf["value"] * shared["scale"] + shared["offset"]
        return pdf

    return rounded(parallel.split_map(tables.signal(spark, sf), ["channel"], run, "channel long, t long, value double", {"scale": 2, "offset": 3}), "value")


@query("SELECT i::BIGINT AS i, CASE WHEN i = 8 THEN 'failed' ELSE 'ok' END AS state, CASE WHEN i = 8 THEN -1.0 ELSE (i * (i - 1) / 2)::DOUBLE END AS value FROM range(20) q(i)", mapped=False)
def run_jobs(spark, sf):
    def job(n):
        if n == 8:
            raise ValueError("eight")
        return sum(range(n))

    out = parallel.run_jobs(spark, job, list(range(20)))
    return out.select("i", F.when(F.col("error_type").isNull(), "ok").otherwise("failed").alias("state"), F.when(F.col("error_type").isNull(), F.col("value")).otherwise(-1.0).alias("value"))


def _drained(spark, stream, mode):
    """A stream run over all that there is, as a stored table in the shared folder (each batch of ``complete`` replaces it)."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def store(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")

    q = stream.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _event_stream(spark, sf):
    schema = tables.load(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM events GROUP BY ALL", mapped=False)
def stream_windows(spark, sf):
    out = _drained(spark, causal.sliding(_event_stream(spark, sf), "1 hour"), "complete")
    return rounded(out.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "mean", "n"), "mean")


@query()
def stream_filter(spark, sf):
    """The causal filter on a stream of blocks: events of each type, a block for each hundred."""
    blocks = filters.to_blocks(tables.signal(spark, sf), 100).select(F.lit("r0").alias("recording"), "channel", (F.col("block") * 100).alias("t0"), "samples")
    from tidemark.sources.store import spill

    at = spill(blocks, "stream-blocks")
    stream = spark.readStream.schema(blocks.schema).parquet(at)
    out = _drained(spark, causal.filter_stream(stream, design.butter(30, 100, 1000, 3)), "append")
    rows = out.select("channel", "t0", F.posexplode("samples").alias("k", "value"))
    return rounded(rows.select("channel", (F.col("t0") + F.col("k")).alias("t"), "value"), "value")
