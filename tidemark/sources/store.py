"""Results and recordings on disk: a directory for each node, tables as Parquet, scalars as JSON."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joining import merge_missing


class Bunch(dict):
    """Named results, also as attributes; may be nested."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def __setattr__(self, name: str, value) -> None:
        self[name] = value


def save(path: str | Path, results: Mapping, mode: str = "error", compression: str = "zstd") -> None:
    """Write a tree of DataFrames, scalars, lists and further trees. What is neither is an error (nothing is pickled)."""
    at = Path(path)
    at.mkdir(parents=True, exist_ok=True)
    scalars = {}
    for name, value in results.items():
        if isinstance(value, DataFrame):
            value.write.mode(mode).option("compression", compression).parquet(str(at / name))
        elif isinstance(value, Mapping):
            save(at / name, value, mode, compression)
        elif value is None or isinstance(value, (str, int, float, bool, list, tuple)):
            scalars[name] = value
        elif isinstance(value, complex):
            scalars[name] = {"re": value.real, "im": value.imag}
        else:
            raise TypeError(f"{name}: a {type(value).__name__} can't be stored")
    (at / "_meta.json").write_text(json.dumps(scalars))


def load(spark: SparkSession, path: str | Path, scan: bool = False) -> Bunch:
    """The tree again, tables lazily; ``scan`` lists names only."""
    at = Path(path)
    out = Bunch()
    meta = at / "_meta.json"
    if meta.exists():
        for k, v in json.loads(meta.read_text()).items():
            out[k] = complex(v["re"], v["im"]) if isinstance(v, dict) else v
    for p in sorted(x for x in at.iterdir() if x.is_dir()):
        if any(p.glob("*.parquet")):
            out[p.name] = None if scan else spark.read.parquet(str(p))
        else:
            out[p.name] = load(spark, p, scan)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; set only where it is unset (on one machine)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file:///tmp/tidemark-shared"
    return f"{at.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def spill(df: DataFrame, what: str) -> str:
    """Write a table into the shared folder: its path. What reads it survives lost executors without replaying the plan."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def list_results(path: str | Path) -> list[str]:
    return sorted(str(p.parent.relative_to(path)) for p in Path(path).rglob("_meta.json"))


def write_blocks(blocks: DataFrame, path: str, mode: str = "error") -> None:
    """Blocks sorted within files by channel and block, so that row groups prune."""
    blocks.repartitionByRange("channel", "block").sortWithinPartitions("channel", "block").write.mode(mode).parquet(path)


def read_range(spark: SparkSession, path: str, start: int, stop: int, length: int, channels: list[int] | None = None) -> DataFrame:
    """A range of time of stored blocks: blocks are pruned by their number, which reaches the scan (a predicate on the
    exploded t could not)."""
    blocks = spark.read.parquet(path).where(F.col("block").between(start // length, (stop - 1) // length))
    if channels is not None:
        blocks = blocks.where(F.col("channel").isin(channels))
    rows = blocks.select("channel", "block", F.posexplode("samples").alias("_k", "value")).select("channel", (F.col("block") * length + F.col("_k")).alias("t"), "value")
    return rows.where((F.col("t") >= start) & (F.col("t") < stop))


class MaskStore:
    """Channel masks by session and recording; an existing one is kept unless ``overwrite``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _version(self) -> str | None:
        versions = sorted(Path(self.path).glob("v*"))
        return str(versions[-1]) if versions else None

    def table(self) -> DataFrame:
        at = self._version()
        return self.spark.read.parquet(at) if at else self.spark.createDataFrame([], "session string, recording string, channel long, active boolean")

    def lookup(self, session: str, recording: str) -> DataFrame:
        return self.table().where((F.col("session") == session) & (F.col("recording") == recording)).select("channel", "active")

    def names(self) -> list[tuple[str, str]]:
        return sorted((r[0], r[1]) for r in self.table().select("session", "recording").distinct().collect())

    def stash(self, session: str, recording: str, mask: DataFrame, overwrite: bool = False) -> None:
        """A new version of the table (files are never changed under a reader)."""
        own = mask.select(F.lit(session).alias("session"), F.lit(recording).alias("recording"), "channel", "active")
        merged = merge_missing(self.table(), own, ["session", "recording"], overwrite)
        n = len(list(Path(self.path).glob("v*")))
        merged.write.parquet(f"{self.path}/v{n:06d}")
