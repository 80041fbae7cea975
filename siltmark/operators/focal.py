"""Neighbourhood operators on long cell tables.

``tiled`` copies each cell to every tile whose halo it lies in and hash-partitions by
tile, once.  All later windows partition on (tile, row) or (tile, col), which that
layout already satisfies: a chain of focal steps costs one shuffle and local sorts,
and no task holds more than a tile and its halo.  Cells must be dense (``densify``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators.order_stats import medians

TILE = 256


def densify(cells: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Every (row, col) of every layer; cells nobody measured carry NULLs.

    ``layers``: keys, n_rows, n_cols.  Rows are spread before columns are made, so a
    single huge layer is generated by many tasks.  Spark takes the frame for as small as
    its list of layers and would broadcast it, so the join is merged.
    """
    rows = layers.select(*keys, "n_rows", "n_cols",
                         F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"))
    frame = (rows.repartition(*keys, "row")
             .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))))
    return frame.hint("merge").join(cells, [*keys, "row", "col"], "left")


def slices(df: DataFrame) -> int:
    """Partitions of a shuffle, asked for by number: tiles pack well, and partitions merged by their packed size are too much for one task."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tiled(cells: DataFrame, keys: list[str], halo, tile: int = TILE) -> DataFrame:
    """Cells laid out by tile with ``halo`` (int or Column) cells of overlap.

    With n_rows and n_cols, no cell is copied to tiles outside the raster, which have no cells of their own.
    """
    h = F.lit(halo) if isinstance(halo, int) else halo
    t = F.lit(tile)

    def spans(axis: str, size: str) -> Column:
        lo, hi = F.floor((F.col(axis) - h) / t), F.floor((F.col(axis) + h) / t)
        if size in cells.columns:
            lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.floor((F.col(size) - 1) / t))
        return F.explode(F.sequence(lo, hi))
    return (cells.withColumn("_tr", spans("row", "n_rows")).withColumn("_tc", spans("col", "n_cols"))
            .withColumn("_core", (F.floor(F.col("row") / t) == F.col("_tr"))
                        & (F.floor(F.col("col") / t) == F.col("_tc")))
            .repartition(slices(cells), *keys, "_tr", "_tc"))


def core(t: DataFrame) -> DataFrame:
    """Drop the halo copies."""
    return t.filter("_core").drop("_tr", "_tc", "_core")


def _line(keys: list[str], along: str):
    across = "row" if along == "col" else "col"
    return Window.partitionBy(*keys, "_tr", "_tc", across).orderBy(along)


def _pads(k: int, left: int | None = None) -> tuple[int, int]:
    left = (k - 1) // 2 if left is None else left
    return left, k - 1 - left


def box_sum(t: DataFrame, keys: list[str], parts: dict[str, Column], k: int) -> DataFrame:
    """Zero-padded k x k sums, one output column per part."""
    lo, hi = _pads(k)
    names = list(parts)
    t = t.select("*", *[parts[n].cast("double").alias(f"_p_{n}") for n in names])
    w = _line(keys, "col").rangeBetween(-lo, hi)
    t = t.select("*", *[F.sum(f"_p_{n}").over(w).alias(f"_h_{n}") for n in names])
    w = _line(keys, "row").rangeBetween(-lo, hi)
    t = t.select("*", *[F.coalesce(F.sum(f"_h_{n}").over(w), F.lit(0.0)).alias(n) for n in names])
    return t.drop(*[f"_p_{n}" for n in names], *[f"_h_{n}" for n in names])


def box_mean(t: DataFrame, keys: list[str], values: dict[str, Column], k: int,
             min_frac: float = 0.5) -> DataFrame:
    """Valid-only k x k means; NULL where under ``min_frac`` of the window is valid."""
    parts: dict[str, Column] = {}
    for name, v in values.items():
        parts[f"_s_{name}"] = v
        parts[f"_n_{name}"] = v.isNotNull().cast("int")
    t = box_sum(t, keys, parts, k)
    for name in values:
        n = F.col(f"_n_{name}")
        t = t.withColumn(name, F.when((n > 0) & (n >= k * k * min_frac), F.col(f"_s_{name}") / n))
    return t.drop(*parts)


def edge_mean(t: DataFrame, keys: list[str], name: str, value: Column, k: int) -> DataFrame:
    """k x k mean of an edge-replicated grid; a NULL in the window gives NULL.

    Needs n_rows and n_cols.  The replicas of the first and last cell are added as
    multiples, so no cell is copied.
    """
    left, right = _pads(k, k // 2)
    t = t.withColumn("_v", value.cast("double"))
    for src, dst, along, size in (("_v", "_h", "col", "n_cols"), ("_h", "_m", "row", "n_rows")):
        w = _line(keys, along).rangeBetween(-left, right)
        short_lo = F.greatest(F.lit(left) - F.col(along), F.lit(0))
        short_hi = F.greatest(F.col(along) + F.lit(right) - (F.col(size) - 1), F.lit(0))
        total = (F.sum(src).over(w) + short_lo * F.first(src).over(w) + short_hi * F.last(src).over(w))
        full = F.count(src).over(w) == F.count(F.lit(1)).over(w)
        t = t.withColumn(dst, F.when(full, total))
    return t.withColumn(name, F.col("_m") / F.lit(float(k * k))).drop("_v", "_h", "_m")


def focal_max(t: DataFrame, keys: list[str], name: str, value: Column, k_row: int, k_col: int) -> DataFrame:
    """Rectangular maximum; a NULL never wins, an all-NULL window stays NULL."""
    t = t.withColumn("_v", value)
    for src, dst, along, k in (("_v", "_h", "row", k_row), ("_h", name, "col", k_col)):
        left, right = _pads(k, k // 2)
        t = t.withColumn(dst, F.max(src).over(_line(keys, along).rangeBetween(-left, right)))
    return t.drop("_v", "_h")


def focal_median(t: DataFrame, keys: list[str], name: str, value: Column, k: int) -> DataFrame:
    """k x k median of an edge-replicated grid, NULL neighbours ignored; needs n_rows, n_cols."""
    pad = k // 2
    t = t.withColumn("_v", F.struct(value.cast("double").alias("v")))
    for src, dst, along, size in (("_v", "_h", "col", "n_cols"), ("_h", "_m", "row", "n_rows")):
        w = _line(keys, along).rangeBetween(-pad, pad)
        seen = F.collect_list(src).over(w)
        lo = F.greatest(F.lit(pad) - F.col(along), F.lit(0)).cast("int")
        hi = F.greatest(F.col(along) + F.lit(pad) - (F.col(size) - 1), F.lit(0)).cast("int")
        t = t.withColumn("_w", seen).withColumn(dst, F.concat(
            F.array_repeat(F.element_at("_w", 1), lo), F.col("_w"),
            F.array_repeat(F.element_at("_w", -1), hi))).drop("_w")
    flat = F.array_sort(F.filter(F.transform(F.flatten("_m"), lambda s: s["v"]), lambda v: v.isNotNull()))
    t = t.withColumn("_f", flat)
    n = F.size("_f")
    mid = (F.get("_f", F.floor((n - 1) / 2).cast("int")) + F.get("_f", F.floor(n / 2).cast("int"))) / 2
    return t.withColumn(name, F.when(n > 0, mid)).drop("_v", "_h", "_m", "_f")


def median_filter(t: DataFrame, keys: list[str], name: str, value: Column, k: int) -> DataFrame:
    """Speckle filter: the focal median on valid cells, the original elsewhere."""
    t = focal_median(t, keys, "_med", value, k)
    return t.withColumn(name, F.when(value.isNotNull(), F.coalesce(F.col("_med"), value))).drop("_med")


ENL = 4.4   # nominal looks of the radar product


def lee_filter(t: DataFrame, keys: list[str], name: str, value: Column, k: int, enl: float = ENL) -> DataFrame:
    """Adaptive speckle filter: smooth where the window looks like pure speckle."""
    return lee_filters(t, keys, {name: value}, k, enl)


def lee_filters(t: DataFrame, keys: list[str], values: dict[str, Column], k: int, enl: float = ENL) -> DataFrame:
    """``lee_filter`` of each named value, all in one pass."""
    t = box_mean(t, keys, {f"_{m}_{n}": x for n, v in values.items() for m, x in (("mu", v), ("sq", v * v))}, k)
    done = {}
    for name, value in values.items():
        mu = F.col(f"_mu_{name}")
        ci2 = F.greatest(F.col(f"_sq_{name}") - mu * mu, F.lit(0.0)) / F.nullif(mu * mu, F.lit(0.0))
        # a flat window has ci2 = 0, an infinite ratio and so weight 0
        w = F.when(ci2 == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.lit(1.0 / enl) / F.nullif(ci2, F.lit(0.0)))))
        done[name] = F.when(value.isNotNull(), F.coalesce(mu + w * (value - mu), value))
    return t.withColumns(done).drop(*[f"_{m}_{n}" for n in values for m in ("mu", "sq")])


def smooth_keep(t: DataFrame, keys: list[str], name: str, value: Column, k: int) -> DataFrame:
    """Window mean of whatever is there; cells with an empty window keep their value."""
    t = box_mean(t, keys, {"_sm": value}, k, min_frac=0.0)
    return t.withColumn(name, F.coalesce(F.col("_sm"), value)).drop("_sm")


VOID_WINDOWS = (3, 7, 15, 31, 63)


def fill_voids(cells: DataFrame, keys: list[str], value: str, tile: int = TILE) -> DataFrame:
    """Close holes from their own surroundings, doubling the window; then the median.

    One tiling with a halo of the summed reach serves all five passes.
    """
    t = tiled(cells, keys, sum((k - 1) // 2 for k in VOID_WINDOWS), tile)
    t = t.withColumn("filled", F.col(value).cast("double"))
    for k in VOID_WINDOWS:
        t = box_mean(t, keys, {"_m": F.col("filled")}, k, min_frac=0.0)
        t = t.withColumn("filled", F.coalesce("filled", "_m")).drop("_m")
    med = medians(cells, keys, F.col(value).cast("double"), "_med").select(*keys, "_med")
    return (core(t).join(med, keys, "left")
            .withColumn("filled", F.coalesce("filled", "_med", F.lit(0.0))).drop("_med"))


def gradients(t: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Central differences per cell, one-sided on the grid edge: _gr (down) and _gc (right)."""
    t = t.withColumn("_z", value)
    for out, along, size in (("_gr", "row", "n_rows"), ("_gc", "col", "n_cols")):
        w = _line(keys, along)
        prev, nxt = F.lag("_z").over(w), F.lead("_z").over(w)
        pos = F.col(along)
        t = t.withColumn(out, F.when(pos == 0, nxt - F.col("_z"))
                         .when(pos == F.col(size) - 1, F.col("_z") - prev).otherwise((nxt - prev) / 2))
    return t.drop("_z")


def slope_aspect(t: DataFrame, keys: list[str], value: Column, dx_m: Column, dy_m: Column) -> DataFrame:
    """Slope in degrees and the compass direction the surface faces downhill."""
    t = gradients(t, keys, value)
    gy, gx = F.col("_gr") / dy_m, F.col("_gc") / dx_m
    return (t.withColumn("slope", F.degrees(F.atan(F.sqrt(gx * gx + gy * gy))))
            .withColumn("aspect", F.pmod(F.degrees(F.atan2(-gx, gy)), F.lit(360.0))).drop("_gr", "_gc"))


def dilate(mask: DataFrame, keys: list[str], n: int) -> DataFrame:
    """4-neighbour dilation ``n`` times: every cell within n steps, no wrap at edges.

    ``mask``: keys, row, col, n_rows, n_cols.  n steps of the cross form one diamond,
    so one explode and one shuffle replace n rounds.
    """
    diamond = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if abs(a) + abs(b) <= n]
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in diamond])
    grown = mask.select(*keys, "n_rows", "n_cols", "row", "col", F.explode(steps).alias("s")).select(
        *keys, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"),
        "n_rows", "n_cols")
    inside = (F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("n_rows")) & (F.col("col") < F.col("n_cols"))
    return grown.filter(inside).select(*keys, "row", "col").distinct()


def march(cells: DataFrame, keys: list[str], value: str, steps: Column, per_tile, out: str, tile: int = TILE) -> DataFrame:
    """Look-line marching inside tiles whose halo is the group's own reach.

    ``cells`` carries the parameters ``per_tile(frame, grid, rows, cols)`` reads; the
    group handed to it is one tile and its halo, never a whole raster.
    """
    t = tiled(cells, keys, steps, tile)
    schema = t.select(*keys, "row", "col").schema.add(out, "boolean")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        r = pdf["row"].to_numpy() - r0
        c = pdf["col"].to_numpy() - c0
        grid = np.full((r.max() + 1, c.max() + 1), np.nan)
        grid[r, c] = pdf[value].to_numpy(dtype=float)
        hit = per_tile(pdf.iloc[0], grid)
        res = pdf[[*keys, "row", "col"]].copy()
        res[out] = hit[r, c]
        return res[pdf["_core"].to_numpy()]
    return t.groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema)
