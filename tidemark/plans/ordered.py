"""Orders over whole tables without a task that takes them whole: ranges of an order are numbered or scanned side by
side, and a table of one row a range says what lies before each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a range, about, and keys drawn for each: these set only where ranges end.
RANGE_ROWS, DRAWN = 250_000, 32
#: Units of time of a span.
SPAN = 1 << 16


def ranged(df: DataFrame, order: Sequence[str], name: str = "_range") -> DataFrame | None:
    """Rows with the number of the range of an order in which they lie; None if the table is one range. Ends of ranges
    are keys of all columns of the order, so rows with one time are parted too; they are drawn by a job of its own and
    stay in the plan as literals, so each evaluation parts the rows alike. A binary search finds a row's range, a
    projection for each step."""
    if df.count() < 2 * RANGE_ROWS:
        return None
    kinds = dict(df.dtypes)
    keys = [F.col(c).cast("string") if kinds[c].startswith(("timestamp", "date")) else F.col(c) for c in order]
    drawn = sorted(tuple(r) for r in df.select(*keys).sample(min(1.0, DRAWN / RANGE_ROWS), 0).na.drop().collect())
    ends = sorted(set(drawn[DRAWN::DRAWN]))
    columns = [F.array(*map(F.lit, own)).cast(f"array<{kinds[c]}>") for c, own in zip(order, zip(*ends))]
    out = df.withColumn(name, F.lit(0))
    for half in (1 << k for k in reversed(range(len(ends).bit_length()))):
        at = [F.get(own, F.col(name) + half - 1) for own in columns]
        passed = at[-1] <= F.col(order[-1])
        for end, c in zip(at[-2::-1], order[-2::-1]):
            passed = (end < F.col(c)) | (end == F.col(c)) & passed
        out = out.withColumn(name, F.col(name) + F.when(passed, half).otherwise(0))
    return out


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "t") -> DataFrame:
    """Rows numbered from nought in an order, group by group. No task sorts a group: rows are numbered inside ranges of
    the order, to which the sizes of the ranges before are added."""
    placed = ranged(df, order)
    if placed is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*by, "_range").agg(F.count("*").alias("_n")).select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1)
    return inside.join(F.broadcast(starts), [*by, "_range"]).withColumn(name, (F.col("_k") + F.col("_start")).cast("long")).drop("_range", "_k", "_start")


def whole_numbers(df: DataFrame, t: str = "t") -> bool:
    return dict(df.dtypes)[t] in ("tinyint", "smallint", "int", "bigint")


def spanned(df: DataFrame) -> DataFrame:
    """Rows with the span of their t: ``SPAN`` samples, or a range of the stamps if these are no whole numbers."""
    if whole_numbers(df):
        return df.withColumn("_span", F.floor(F.col("t") / SPAN))
    placed = ranged(df, ["t"], "_span")
    return df.withColumn("_span", F.lit(0)) if placed is None else placed


def preceded(df: DataFrame, name: str = "before") -> DataFrame:
    """Rows with the t before theirs: of their span, else the last of the spans before."""
    placed = spanned(df)
    ends = placed.groupBy("_span").agg(F.max("t").alias("_last"))
    last = ends.select("_span", F.lag("_last").over(Window.orderBy("_span")).alias("_last"))
    rows = placed.withColumn(name, F.lag("t").over(Window.partitionBy("_span").orderBy("t")))
    return rows.join(last, "_span").withColumn(name, F.coalesce(name, "_last")).drop("_span", "_last")


def runs(df: DataFrame, gap: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows with the span (_home) in which their run begins: the last t at or before theirs that lies ``gap`` or more
    behind the t before it. Runs that begin in one span share it; groups (``by``) are apart."""
    placed = spanned(df)
    inside, across = Window.partitionBy(*by, "_span").orderBy("t"), Window.partitionBy(*by).orderBy("_span")
    steps = placed.withColumn("_opens", F.coalesce(F.col("t") - F.lag("t").over(inside) >= gap, F.lit(False)))
    table = steps.groupBy(*by, "_span").agg(F.min("t").alias("_first"), F.max("t").alias("_last"), F.bool_or("_opens").alias("_any"))
    table = table.withColumn("_fresh", F.coalesce(F.col("_first") - F.lag("_last").over(across) >= gap, F.lit(True)))
    earlier = F.max(F.when(F.col("_any") | F.col("_fresh"), F.col("_span"))).over(across.rowsBetween(Window.unboundedPreceding, -1))
    table = table.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_span").alias("_at"), "_fresh", earlier.alias("_earlier"))
    opened = F.max("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by), F.col("_span") == F.col("_at"))
    home = F.when(F.col("_fresh") | F.col("_opened"), F.col("_span")).otherwise(F.col("_earlier"))
    return steps.withColumn("_opened", opened).join(table, same).select(*df.columns, home.alias("_home"))
