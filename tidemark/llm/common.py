"""Helpers that the training-data operators share: table access, bounded Arrow batches, cut lineage."""

from __future__ import annotations

import ctypes
import gc
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python. Texts have no bound on length, so a batch is further cut by bytes in ``pieces``.
BATCH_ROWS = 1000
#: Text bytes that one Python step works on at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a Python worker whatever the width of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def pieces(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most ``limit`` bytes of ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> list:
    """Columns to hash for the identity of a row: every value (maps as JSON) and which ones are null."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(quoted, df.schema.fields)]
    return [*plain, *(c.isNull() for c in quoted)]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def id_bucket(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, modulo: the fold rule of the contracts. A null id has remainder 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def fold(column: str, modulus: int):
    """``id_bucket`` as a column."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; set only where it is unset (tests on one machine)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file:///tmp/tidemark-shared"
    return f"{at.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: what is downstream survives lost executors without replaying the plan."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tidemark_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing will read again."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_KEPT: dict = {}


def release() -> None:
    """Give this worker's freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # freed blocks stay with the process otherwise (glibc)
    if trim:
        trim(0)


def forget() -> None:
    """Drop what this worker keeps and give the memory back to the system."""
    if not _KEPT:
        return
    _KEPT.clear()
    release()


def kept(key: str, make):
    """What ``make`` builds, kept by a Python worker from task to task until it is asked for another key: one model and
    its cache at a time, so that stages of a pipeline don't add up in memory."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


class TokenTable:
    """Rows of numbers for tokens, worked out once while the token stays in a cache of about ``most`` tokens.

    ``compute`` gives an array with a row of ``width`` numbers for each token of a list. When the cache is full, the more
    used half stays.
    """

    def __init__(self, compute, width: int, most: int = 300_000) -> None:
        self.compute, self.width, self.most = compute, width, most
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.values, self.uses = np.zeros((1024, self.width)), np.zeros(1024, np.int64)

    def _shrink(self) -> None:
        n = len(self.index)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.most // 2])
        names = list(self.index)
        self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.values, self.uses = self.values[keep], self.uses[keep] // 2

    def ids(self, tokens: list) -> np.ndarray:
        """The row number of each token in ``values`` (which a later call may replace)."""
        ids = np.fromiter(map(self.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            new = list(dict.fromkeys([tokens[i] for i in missing.tolist()]))
            if len(self.index) + len(new) > self.most and len(self.index) > self.most // 2:
                self._shrink()
                return self.ids(tokens)
            rows, n = self.compute(new), len(self.index)
            if n + len(new) > len(self.values):
                self.values = np.concatenate((self.values[:n], np.zeros((n + 2 * len(new), self.width))))
                self.uses = np.concatenate((self.uses[:n], np.zeros(n + 2 * len(new), np.int64)))
            self.values[n : n + len(new)] = rows
            self.index.update(zip(new, range(n, n + len(new))))
            ids[missing] = np.fromiter(map(self.index.__getitem__, [tokens[i] for i in missing.tolist()]), np.int64, len(missing))
        self.uses[: len(self.index)] += np.bincount(ids, minlength=len(self.index))
        return ids


def sums(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of consecutive rows: the first counts[0] rows, the next counts[1], ..."""
    n = np.asarray(counts, np.int64)
    out = np.zeros((len(n), *values.shape[1:]))
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some], axis=0)
    return out
