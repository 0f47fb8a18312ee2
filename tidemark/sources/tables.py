"""Recordings from the driver's tables: signals, grids, triggers and conditions in the long forms that operators take.

``signal``: channel, t, value. ``frames``: the same with t a frame of an 8 x 8 electrode grid. Numbering samples is part
of this mapping only; recordings that are stored have their t.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans import ordered


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type -> channel (one row for each type)."""
    kinds = load(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long").alias("channel"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as five channels, in time order. Channels are as long as their type is frequent: no sample is dropped."""
    events = load(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id")
    numbered = ordered.numbered(events, ["ts", "event_id"], ["event_type"])
    return numbered.join(F.broadcast(channels(spark, sf_dir)), "event_type").select("channel", "t", "value")


def wide_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a channel for each user (ragged)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("t"), "value")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames of 64 electrodes."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("t"), F.posexplode("embedding").alias("channel", "value"))
    return rows.select(F.col("channel").cast("long").alias("channel"), "t", F.col("value").cast("double").alias("value"))


def level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logic level over time: events in order of ts, on where an error is logged."""
    events = load(spark, sf_dir, "events").select("ts", "event_id", (F.col("event_type") == "error").alias("level"))
    return ordered.numbered(events, ["ts", "event_id"]).select("t", "level")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events with two stimulus features."""
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("event_no"), "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")


#: The same tables for DuckDB, as common table expressions.
SQL = """
chan AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS channel FROM (SELECT DISTINCT event_type FROM events)),
numbered AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::BIGINT AS t FROM events),
sig AS (SELECT channel, t, value FROM numbered JOIN chan USING (event_type)),
wide AS (SELECT user_id::BIGINT AS channel, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS t, value FROM events),
frames AS (SELECT vec_id::BIGINT AS t, unnest(range(64))::BIGINT AS channel, unnest(embedding)::DOUBLE AS value FROM embeddings),
lev AS (SELECT (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS t, event_type = 'error' AS level FROM events)
"""
