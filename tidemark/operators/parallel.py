"""User functions over split data and job farms (M1-M8): grouped maps and ordered jobs with errors as values."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def divide(n: int, parts: int) -> list[slice]:
    """Even contiguous slices of n places, the longer ones first; empty ones are left out."""
    each, more = divmod(n, parts)
    out, at = [], 0
    for k in range(parts):
        size = each + (k < more)
        if size:
            out.append(slice(at, at + size))
        at += size
    return out


def split_map(df: DataFrame, by: Sequence[str], f: Callable[..., pd.DataFrame], schema: str, shared: object = None) -> DataFrame:
    """``f(group, shared)`` on each group; what is shared is broadcast once. The schema is the output's shape."""
    sent = df.sparkSession.sparkContext.broadcast(shared) if shared is not None else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf, sent.value) if sent is not None else f(pdf)

    return df.groupBy(*by).applyInPandas(run, schema)


def run_jobs(spark: SparkSession, f: Callable, inputs: Sequence, parts: int | None = None, reraise: bool = False) -> DataFrame:
    """``f`` on each input (a tuple is its arguments): (i, value, error_type, error_message, error_trace) in order of i.
    A job that fails is NaN with its error; ``reraise`` makes the first one an error here."""
    jobs = list(inputs)
    sent = spark.sparkContext.broadcast(jobs)

    def work(batches):
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                x = sent.value[i]
                try:
                    value = f(*x) if isinstance(x, tuple) else f(x)
                    rows.append((i, float(value), None, None, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, float("nan"), type(e).__name__, str(e), traceback.format_exc()))
            yield pd.DataFrame(rows, columns=["i", "value", "error_type", "error_message", "error_trace"])

    out = spark.range(0, len(jobs), 1, parts or max(1, min(len(jobs), spark.sparkContext.defaultParallelism))).mapInPandas(work, "i long, value double, error_type string, error_message string, error_trace string")
    out = out.withColumn("value", F.coalesce("value", F.lit(float("nan"))))  # pandas hands NaN over as null
    if reraise:
        bad = out.where(F.col("error_type").isNotNull()).orderBy("i").limit(1).collect()
        if bad:
            raise RuntimeError(f"job {bad[0].i}: {bad[0].error_type}: {bad[0].error_message}")
    return out.orderBy("i")
