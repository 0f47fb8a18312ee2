"""Sharding (operator 5) by a hierarchical weighted hash tree: region, rack, shard. The law is ``key``.

Every node of the tree has a weight, the sum of its shards' weights, and draws a number for a row from the hash of doc_id
and the node's own name: -ln(u) / weight, the waiting time of an exponential clock. A row goes to the region with the
least draw, there to the rack with the least draw, there to the shard: depth x fan-out draws for each row, each level a
weighted choice. What a change moves is confined: a node draws by its own name and weight only, so weights that
change inside a rack and leave its sum alone move rows inside that rack only; a change that raises or lowers one subtree
moves rows between it and its siblings, never between two others.

The tree is laid out once, for ``base`` shards, in racks of ``RACK`` and regions of ``REGION`` racks. A shard that is added
later hangs at the top level, as a region of its own: no other node's draw changes, so one more shard takes rows only into
itself, from ``base`` shards on. Nothing but doc_id, the number of shards and the layout (``base``, weights, all 1 by
default) decides.

Slots (gapless from 0 in each shard) don't gather a shard in one task: rows go to sub-buckets by hash, sub-buckets get
their first slot from a small table of counts (one prefix sum by shard), rows count on inside their sub-bucket. The
number of sub-buckets grows with the rows (``BUCKET_ROWS``); copies of one row are spread too, as rows that repeat a
doc_id are told apart by the partition they are read in.

Everything is DataFrame functions: no Python on the executors. The text itself is not shuffled.

Defined cases: null text has size 8 and the crc32 of no bytes (0); a very long text counts whole; a null doc_id draws as
the text 'null'; equal draws (none in practice) go to the node that comes first; repeated rows stay, in the same shard,
with slots of their own; extra columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, table, unused

SHARDS, RACK, REGION = 24, 4, 2
#: Rows of a sub-bucket, about: what one sort step numbers.
BUCKET_ROWS = 50_000


def tree(weights: list[float], base: int | None = None, rack: int = RACK, region: int = REGION) -> list[list[list[tuple[int, float]]]]:
    """Regions of racks of (shard, weight): the first ``base`` shards in order, then a region for each later one."""
    base = len(weights) if base is None else min(base, len(weights))
    racks = [[(k, weights[k]) for k in range(at, min(at + rack, base))] for at in range(0, base, rack)]
    return [racks[at : at + region] for at in range(0, len(racks), region)] + [[[(k, weights[k])]] for k in range(base, len(weights))]


def _array(values) -> str:
    """Nested lists of numbers as a SQL literal; floats as doubles."""
    if isinstance(values, list):
        return f"array({', '.join(map(_array, values))})"
    return f"{values!r}D" if isinstance(values, float) else str(values)


def _least(key: str, level: int, path: str, weights: str) -> str:
    """SQL: which child, from 0, of the node at ``path`` has the least draw; ``weights`` are those of its children.
    53 bits of the hash, never 0."""
    u = f"(shiftrightunsigned(xxhash64({key}, {level}, {path}, i), 11) + 0.5D) / {float(1 << 53)!r}D"
    return f"array_min(transform({weights}, (w, i) -> struct(-ln({u}) / w AS d, i AS i))).i"


def descend(df: DataFrame, key: str, regions: list[list[list[tuple[int, float]]]], out: str) -> DataFrame:
    """``df`` with the column ``out``: the shard of each row, found from the root down. ``key`` is a text column."""
    region, rack = unused(df, "_region"), unused(df, "_rack")
    leaves = [[[float(w) for _, w in leaf] for leaf in racks] for racks in regions]
    names = [[[s for s, _ in leaf] for leaf in racks] for racks in regions]
    rack_weights = [[sum(leaf) for leaf in racks] for racks in leaves]
    region_weights = [sum(racks) for racks in rack_weights]
    df = df.withColumn(region, F.expr(_least(key, 0, "0", _array(region_weights))))
    df = df.withColumn(rack, F.expr(_least(key, 1, region, f"{_array(rack_weights)}[{region}]")))
    leaf = _least(key, 2, f"{region}, {rack}", f"{_array(leaves)}[{region}][{rack}]")
    return df.withColumn(out, F.expr(f"CAST({_array(names)}[{region}][{rack}][{leaf}] AS INT)")).drop(region, rack)


def shard(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, base: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``. ``base``: how many
    shards the tree was laid out for (all, if not given)."""
    weights = weights or [1.0] * shards
    base = len(weights) if base is None else base
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key.alias("_key"))
    rows = descend(rows, "_key", tree(weights, base), "shard")
    rows = descend(rows, "_key", tree([*weights, 1.0], base), "grown_shard").drop("_key")
    # one table of narrow rows: slots are counted and given from the same rows, whatever happens to the executors
    rows = cut(rows, "hashtree-rows")
    n = rows.count()
    buckets = max(1, n // (bucket_rows * len(weights)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", F.spark_partition_id()), F.lit(buckets)).cast("int"))
    rows = cut(rows, "hashtree-buckets") if buckets > 1 else rows
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(inside))
    return numbered.join(starts, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at") - 1).alias("slot"), "grown_shard")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
