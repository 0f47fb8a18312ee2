"""Electrode grids: index conventions, embedding, filling, spatial regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def to_site(index: Column, rows: int, cols: int, col_major: bool = False) -> tuple[Column, Column]:
    """(row, col) of a flat index; outside the grid is an error."""
    bad = (index < 0) | (index >= rows * cols)
    safe = F.when(bad, F.raise_error(F.format_string("index %s is off the grid", index)).cast("long")).otherwise(index)
    if col_major:
        return safe % rows, F.floor(safe / rows).cast("long")
    return F.floor(safe / cols).cast("long"), safe % cols


def to_index(row: Column, col: Column, rows: int, cols: int, col_major: bool = False) -> Column:
    """The flat index of a site."""
    bad = (row < 0) | (row >= rows) | (col < 0) | (col >= cols)
    index = col * rows + row if col_major else row * cols + col
    return F.when(bad, F.raise_error(F.format_string("(%s, %s) is off the grid", row, col)).cast("long")).otherwise(index)


def sites(spark: SparkSession, rows: int, cols: int, channels: Sequence[int] | None = None, col_major: bool = False, pitch: float = 1.0) -> DataFrame:
    """A channel map: (channel, row, col, y, x) for channels 0.. at flat indices (default: all, in order)."""
    own = list(range(rows * cols) if channels is None else channels)
    base = spark.createDataFrame([(k, i) for k, i in enumerate(own)], "channel long, at long")
    row, col = to_site(F.col("at"), rows, cols, col_major)
    return base.select("channel", row.alias("row"), col.alias("col")).select("channel", "row", "col", (F.col("row") * pitch).alias("y"), (F.col("col") * pitch).alias("x"))


def from_mask(mask: DataFrame) -> DataFrame:
    """Channels of the active sites of a grid mask (row, col, active), in row-major order."""
    return mask.where("active").select((F.row_number().over(Window.orderBy("row", "col")) - 1).cast("long").alias("channel"), "row", "col")


def flip(sites_: DataFrame, cols: int) -> DataFrame:
    """The map seen from the other face."""
    return sites_.withColumn("col", F.lit(cols - 1) - F.col("col"))


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("row"), (F.col("id") % cols).alias("col"))


def embed(signal: DataFrame, sites_: DataFrame, rows: int, cols: int, fill: float | None = None) -> DataFrame:
    """Samples on the full grid (t, row, col, value); sites without a channel have ``fill``. The map and the grid are
    bounded by the electrodes and are broadcast; the signal is not shuffled."""
    spark = signal.sparkSession
    placed = signal.join(F.broadcast(sites_.select("channel", "row", "col")), "channel").select("t", "row", "col", "value")
    empty = grid(spark, rows, cols).join(F.broadcast(sites_), ["row", "col"], "left_anti")
    times = signal.select("t").distinct()
    rest = times.crossJoin(F.broadcast(empty)).select("t", "row", "col", F.lit(fill).cast("double").alias("value"))
    return placed.unionByName(rest)


def gather(image: DataFrame, sites_: DataFrame) -> DataFrame:
    """Grid samples in channel order (t, channel, value)."""
    return image.join(F.broadcast(sites_.select("channel", "row", "col")), ["row", "col"]).select("t", "channel", "value")


def median_fill(image: DataFrame, rows: int, cols: int) -> DataFrame:
    """Empty sites (null) as the median of their neighbours that have values (all at once). Neighbours come from an
    explode of each sample's offsets, so the join is on (t, row, col)."""
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    seen = image.where("value is not null").select("t", "row", "col", "value", F.explode(around).alias("o")).select("t", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "value")
    holes = image.where("value is null").select("t", "row", "col")
    filled = holes.join(seen, ["t", "row", "col"], "left").groupBy("t", "row", "col").agg(F.percentile("value", F.lit(0.5)).alias("value"))
    return image.where("value is not null").select("t", "row", "col", "value").unionByName(filled)


def raster_fill(image: DataFrame, rows: int, cols: int) -> DataFrame:
    """The same in raster order, where sites filled before count for later ones: a frame is one small array."""
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.full((rows, cols), np.nan)
        a[pdf["row"], pdf["col"]] = pdf["value"]
        for r, c in np.argwhere(np.isnan(a)):
            near = a[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2]
            if not np.isnan(near).all():
                a[r, c] = np.nanmedian(near)
        rr, cc = np.indices(a.shape)
        return pd.DataFrame({"t": pdf["t"].iloc[0], "row": rr.ravel(), "col": cc.ravel(), "value": a.ravel()})

    return image.groupBy("t").applyInPandas(run, "t long, row long, col long, value double")


def projector(sites_: DataFrame, order: int = 1) -> DataFrame:
    """(channel, fit, terms): how much each channel adds to the coefficients of the least-squares spatial polynomial, and
    its terms there. They depend on the map alone and are worked out on the driver."""
    import numpy as np

    rows = sites_.select("channel", "row", "col").orderBy("channel").collect()
    i, j = np.array([r.row for r in rows], float), np.array([r.col for r in rows], float)
    terms = [np.ones_like(i)] + ([i, j] if order >= 1 else []) + ([i * j, i * i, j * j] if order >= 2 else [])
    x = np.stack(terms, axis=1)
    p = np.linalg.pinv(x).T
    return sites_.sparkSession.createDataFrame([(r.channel, a.tolist(), b.tolist()) for r, a, b in zip(rows, p, x)], "channel long, fit array<double>, terms array<double>")


def poly_residual(signal: DataFrame, sites_: DataFrame, order: int = 1) -> DataFrame:
    """Samples less their frame's spatial polynomial: its one, three or six coefficients are sums over the frame with
    weights that depend on the map only (made in the map tasks, one row a frame), and each site adds its terms up."""
    n = {0: 1, 1: 3}.get(order, 6)
    placed = signal.join(F.broadcast(projector(sites_, order)), "channel")  # a row for each electrode
    fit = placed.groupBy("t").agg(*(F.sum(F.col("value") * F.col("fit")[k]).alias(f"_c{k}") for k in range(n)))
    trend = sum((F.col("terms")[k] * F.col(f"_c{k}") for k in range(n)), F.lit(0.0))
    return placed.join(fit, "t").select("channel", "t", (F.col("value") - trend).alias("value"), trend.alias("trend"))


def plane_residual(signal: DataFrame, sites_: DataFrame) -> DataFrame:
    """The same for a plane, from sums alone: no weights. Needs a full rectangular map (rows and columns uncorrelated)."""
    placed = signal.join(F.broadcast(sites_.select("channel", "row", "col")), "channel")
    fit = placed.groupBy("t").agg(F.avg("value").alias("m"), F.avg("row").alias("mr"), F.avg("col").alias("mc"), F.regr_slope("value", "row").alias("br"), F.regr_slope("value", "col").alias("bc"))
    trend = F.col("m") + F.col("br") * (F.col("row") - F.col("mr")) + F.col("bc") * (F.col("col") - F.col("mc"))
    return placed.join(fit, "t").select("channel", "t", (F.col("value") - trend).alias("value"))


def despeckle(signal: DataFrame, sites_: DataFrame, groups: DataFrame, by: Sequence[str] = ("pin",), trend_order: int | None = None) -> DataFrame:
    """Samples less the mean of their pin (and board) group in each frame, a spatial trend apart. Least squares on
    indicator columns are group means; a temporal wavelet would commute with this and change nothing."""
    base = signal.select("channel", "t", "value")
    if trend_order is not None:
        base = poly_residual(base, sites_, trend_order)
    placed = base.join(F.broadcast(groups), "channel")
    mean = placed.groupBy("t", *by).agg(F.avg("value").alias("_m"))
    out = placed.join(mean, ["t", *by]).withColumn("value", F.col("value") - F.col("_m"))
    if trend_order is not None:
        out = out.withColumn("value", F.col("value") + F.col("trend"))
    return out.select("channel", "t", "value")


def pixel_correct(image: DataFrame, bad: DataFrame, weights: Sequence[float] = (0.5, 1.0, 0.5)) -> DataFrame:
    """Bad pixels (row, col) as the weighted mean of good ones around them, by a separable kernel."""
    h = len(weights) // 2
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(weights[i + h] * weights[j + h]).alias("w")) for i in range(-h, h + 1) for j in range(-h, h + 1)))
    good = image.join(F.broadcast(bad), ["row", "col"], "left_anti")
    needed = F.broadcast(bad)
    spread = good.select("t", "row", "col", "value", F.explode(around).alias("o")).select("t", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), (F.col("value") * F.col("o.w")).alias("wv"), F.col("o.w").alias("w"))
    fixed = spread.join(needed, ["row", "col"], "left_semi").groupBy("t", "row", "col").agg((F.sum("wv") / F.sum("w")).alias("value"))
    return good.select("t", "row", "col", "value").unionByName(fixed)


def inpaint(image, mask):
    """One frame (2-D array) with masked pixels as the smoothest surface through the rest (biharmonic, dense solve)."""
    import numpy as np

    rows, cols = image.shape

    def laplacian(n: int) -> np.ndarray:
        a = 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
        a[0, 0] = a[-1, -1] = 1
        return a

    lap = np.kron(laplacian(rows), np.eye(cols)) + np.kron(np.eye(rows), laplacian(cols))
    bi, m = lap @ lap, mask.ravel()
    out = image.astype(float).ravel().copy()
    if m.any():
        out[m] = np.linalg.lstsq(bi[np.ix_(m, m)], -bi[np.ix_(m, ~m)] @ out[~m], rcond=None)[0]
    return out.reshape(image.shape)


#: Letters of connector coordinates, without those that are easily misread.
ALPHABET = "ABCDEFGHJKLMNPRTUVWXYZ"


def decode_site(text: Column) -> tuple[Column, Column, Column]:
    """(kind, row, col) of texts like A3, AA2, ref, gnd: letters count rows in an alphabet without i, o, q and s."""
    clean = F.upper(F.trim(text))
    kind = F.when(clean == "REF", "reference").when(clean == "GND", "grounded").when(clean.rlike("^[A-Z]+[0-9]+$"), "signal").otherwise("other")
    letters, digits = F.regexp_extract(clean, "^([A-Z]+)[0-9]+$", 1), F.regexp_extract(clean, "^[A-Z]+([0-9]+)$", 1)
    last = F.instr(F.lit(ALPHABET), F.substring(letters, -1, 1))
    first = F.when(F.length(letters) == 2, F.instr(F.lit(ALPHABET), F.substring(letters, 1, 1))).otherwise(0)
    row = F.when(kind == "signal", (first * len(ALPHABET) + last - 1).cast("long"))
    return kind, row, F.when(kind == "signal", digits.cast("long") - 1)


def connect(chain: Sequence[DataFrame]) -> DataFrame:
    """Pin tables (pin, next) joined one to the next: where each first pin ends, null if the way breaks off."""
    out = chain[0].select("pin", F.col("next").alias("_at"))
    for k, table in enumerate(chain[1:]):
        out = out.join(F.broadcast(table.select(F.col("pin").alias("_at"), F.col("next").alias(f"_n{k}"))), "_at", "left").drop("_at").withColumnRenamed(f"_n{k}", "_at")
    return out.withColumnRenamed("_at", "site")


def tile(sites_: DataFrame, code: int, rows: int, cols: int) -> DataFrame:
    """A map as one tile of many, placed by a subplot code (222: second of two by two)."""
    n_rows, n_cols, k = code // 100, code // 10 % 10, code % 10 - 1
    if not 0 <= k < n_rows * n_cols:
        raise ValueError(f"tile {code}")
    return sites_.withColumn("row", F.col("row") + (k // n_cols) * rows).withColumn("col", F.col("col") + (k % n_cols) * cols)


def undo_gray(code: Column) -> Column:
    """The number whose Gray code is given."""
    out = code.cast("long")
    for s in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, s))
    return out


def zif_bank(pin: Column) -> Column:
    """The bank of a connector's pin: even pins 1, odd pins -1."""
    return F.when(pin % 2 == 0, 1).otherwise(-1).cast("long")


def export_map(sites_: DataFrame, amplifier_channels: int) -> DataFrame:
    """A row for each amplifier channel: its site, or that it has no electrode."""
    every = sites_.sparkSession.range(amplifier_channels).withColumnRenamed("id", "channel")
    return every.join(F.broadcast(sites_), "channel", "left").withColumn("kind", F.when(F.col("row").isNull(), "no_electrode").otherwise("electrode_data"))


def triangulation(points) -> list[tuple[int, int, int]]:
    """Delaunay triangles of a few points (y, x), by Bowyer and Watson's insertion."""
    import numpy as np

    p = np.asarray(points, float)
    span = max(1.0, float(np.ptp(p, axis=0).max())) * 1e3
    mid = p.mean(axis=0)
    p = np.concatenate((p, mid + span * np.array([[-1, -1], [-1, 3], [3, -1]])))
    n = len(p) - 3

    def holds(t: tuple[int, int, int], q: np.ndarray) -> bool:
        a, b, c = (p[i] - q for i in t)
        m = np.array([[*v, v @ v] for v in (a, b, c)])
        turn = (p[t[1]] - p[t[0]])[0] * (p[t[2]] - p[t[0]])[1] - (p[t[1]] - p[t[0]])[1] * (p[t[2]] - p[t[0]])[0]
        return np.linalg.det(m) * np.sign(turn) > 1e-9

    triangles = {(n, n + 1, n + 2)}
    for k in range(n):
        bad = {t for t in triangles if holds(t, p[k])}
        edges: dict = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                edges[frozenset(e)] = edges.get(frozenset(e), 0) + 1
        triangles -= bad
        triangles |= {(*sorted(e), k) for e, m in edges.items() if m == 1}
    return [t for t in triangles if max(t) < n]


def interpolate(signal: DataFrame, sites_: DataFrame, grid_points: Sequence[tuple[float, float]]) -> DataFrame:
    """Linear interpolation of scattered electrodes (channel, y, x) at points: (t, point, value). The weights of each
    point's triangle depend on the map alone; the signal meets them in a broadcast join and one aggregate. Points outside
    the electrodes' hull have no value."""
    import numpy as np

    own = sites_.select("channel", "y", "x").orderBy("channel").collect()
    p = np.array([(r.y, r.x) for r in own])
    weights = []
    for k, q in enumerate(grid_points):
        for t in triangulation(p):
            m = np.array([[p[t[0]][0] - p[t[2]][0], p[t[1]][0] - p[t[2]][0]], [p[t[0]][1] - p[t[2]][1], p[t[1]][1] - p[t[2]][1]]])
            if abs(np.linalg.det(m)) < 1e-12:
                continue
            a, b = np.linalg.solve(m, np.asarray(q, float) - p[t[2]])
            if min(a, b, 1 - a - b) >= -1e-9:
                weights += [(k, own[i].channel, float(w)) for i, w in zip(t, (a, b, 1 - a - b))]
                break
    table = sites_.sparkSession.createDataFrame(weights, "point long, channel long, w double")
    return signal.join(F.broadcast(table), "channel").groupBy("t", "point").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
