"""Radar shadow, layover and the layover fade from a height grid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions import radar
from siltmark.operators import focal
from siltmark.operators.order_stats import quantiles


def _ground(dem: DataFrame, keys: list[str], smooth_k: int, tile: int) -> DataFrame:
    """Smoothed heights with voids at the lowest level, and the relief of each group."""
    if smooth_k > 1:
        t = focal.core(focal.edge_mean(focal.tiled(dem, keys, smooth_k, tile), keys, "_z", F.col("h"), smooth_k))
    else:
        t = dem.withColumn("_z", F.col("h"))
    ext = t.groupBy(*keys).agg(F.min("_z").alias("_lo"), F.max("_z").alias("_hi"))
    return t.join(ext, keys).withColumn("ground", F.coalesce("_z", "_lo")).withColumn(
        "relief", F.col("_hi") - F.col("_lo")).filter(F.col("_lo").isNotNull())


def _look(df: DataFrame, rate: Column, max_steps: int | None) -> DataFrame:
    """Step length, number of steps and the largest reach in cells.

    Relief bounds the steps, and so does the raster: past its last row or column a step meets nothing.  A limit may cut
    them further.
    """
    step, az = F.least("dx_m", "dy_m"), F.radians("look_az")

    def off_after(cells: str, metres: str, turn: Column) -> Column:
        return F.when(F.abs(turn) > 1e-9, F.ceil((F.col(cells) + 1) * F.col(metres) / (step * F.abs(turn))))
    n = F.least(F.ceil(F.col("relief") / (rate * step)), off_after("n_rows", "dy_m", F.cos(az)), off_after("n_cols", "dx_m", F.sin(az)))
    n = F.greatest(F.lit(1), n).cast("int")
    n = n if max_steps is None else F.least(F.lit(max_steps), n)
    reach = F.least(F.ceil(n * step / F.least("dx_m", "dy_m")).cast("int") + 1, F.greatest("n_rows", "n_cols"))
    return df.withColumn("_step", step).withColumn("_n", n).withColumn("_rate", rate).withColumn("_reach", reach)


def _shifted(a: np.ndarray, drow: int, dcol: int) -> np.ndarray:
    """out[r, c] = a[r - drow, c - dcol], NaN outside."""
    out = np.full(a.shape, np.nan)
    h, w = a.shape
    r = np.arange(h) - drow
    c = np.arange(w) - dcol
    ok_r, ok_c = (r >= 0) & (r < h), (c >= 0) & (c < w)
    out[np.ix_(ok_r, ok_c)] = a[np.ix_(r[ok_r], c[ok_c])]
    return out


def _cells_back(p, k: int) -> tuple[float, int, int]:
    """Distance and cell offset of step k toward the radar."""
    d = k * p["_step"]
    az = np.radians(p["look_az"])
    return d, int(round(-np.cos(az) * d / p["dy_m"])), int(round(np.sin(az) * d / p["dx_m"]))


def _shadow_tile(p, z: np.ndarray) -> np.ndarray:
    hit = np.zeros(z.shape, dtype=bool)
    for k in range(1, int(p["_n"]) + 1):
        d, dr, dc = _cells_back(p, k)
        hit |= _shifted(z, dr, dc) > z + d * p["_rate"]     # NaN compares False
    return hit


def _layover_tile(p, z: np.ndarray) -> np.ndarray:
    hit = np.zeros(z.shape, dtype=bool)
    for k in range(1, int(p["_n"]) + 1):
        d, dr, dc = _cells_back(p, k)
        hit |= z - _shifted(z, dr, dc) > d * p["_rate"]
        hit |= _shifted(z, -dr, -dc) - z > d * p["_rate"]
    return hit


def shadow(dem: DataFrame, keys: list[str], smooth_k: int = 3, max_steps: int | None = None,
           tile: int = focal.TILE) -> DataFrame:
    """Cells hidden by terrain between them and the radar (keys, row, col, shadow).

    ``dem``: keys, row, col, n_rows, n_cols, h, dx_m, dy_m, look_az, incidence.  Rows with
    no look direction are left out: nothing is masked without a geometry.
    """
    df = _ground(dem.filter(F.col("look_az").isNotNull()), keys, smooth_k, tile)
    df = _look(df, F.lit(1.0) / F.tan(F.radians("incidence")), max_steps)
    cols = [*keys, "row", "col", "n_rows", "n_cols", "ground", "dx_m", "dy_m", "look_az", "_step", "_n", "_rate", "_reach"]
    return focal.march(df.select(*cols), keys, "ground", F.col("_reach"), _shadow_tile, "shadow", tile)


def layover(dem: DataFrame, keys: list[str], smooth_k: int = 3, max_steps: int | None = None,
            tile: int = focal.TILE) -> DataFrame:
    """Cells mixed with other ground because slant range stops growing (keys, row, col, layover)."""
    df = _ground(dem.filter(F.col("look_az").isNotNull()), keys, smooth_k, tile)
    df = _look(df, F.tan(F.radians("incidence")), max_steps)
    cols = [*keys, "row", "col", "n_rows", "n_cols", "ground", "dx_m", "dy_m", "look_az", "_step", "_n", "_rate", "_reach"]
    return focal.march(df.select(*cols), keys, "ground", F.col("_reach"), _layover_tile, "layover", tile)


def layover_alpha(cells: DataFrame, keys: list[str], *, mode: str = "amplitude", thr: float = 0.0,
                  high_percentile: float = 75.0, dim: float = 0.25, slope_min_deg: float = 12.0,
                  aspect_tol_deg: float = 55.0, dem_smooth: int = 3, feather: int = 5,
                  tile: int = focal.TILE) -> DataFrame:
    """Opacity per cell: dimmed where it faces the radar, is steep and reads high.

    ``cells``: keys, row, col, n_rows, n_cols, v, h, dx_m, dy_m, lay_aspect, dense.
    """
    if mode == "amplitude":
        cut = quantiles(cells, keys, F.col("v"), {"_cut": high_percentile / 100.0}).select(*keys, "_cut")
        cells = cells.join(cut, keys, "left")
        high = F.col("v") >= F.col("_cut")
    else:
        high = F.abs("v") >= abs(thr)
    t = focal.tiled(cells, keys, dem_smooth + feather, tile)
    t = focal.edge_mean(t, keys, "_z", F.col("h"), dem_smooth) if dem_smooth > 1 else t.withColumn("_z", F.col("h"))
    t = focal.slope_aspect(t, keys, F.col("_z"), F.col("dx_m"), F.col("dy_m"))
    hit = (F.col("v").isNotNull() & (radar.angular_gap(F.col("aspect"), F.col("lay_aspect")) <= aspect_tol_deg)
           & (F.col("slope") >= slope_min_deg) & high)
    t = t.withColumn("dimmed", F.coalesce(hit, F.lit(False)))
    t = focal.edge_mean(t, keys, "_s", F.col("dimmed").cast("double"), feather) if feather > 1 else t.withColumn(
        "_s", F.col("dimmed").cast("double"))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s")))
    return focal.core(t).withColumn("alpha", F.lit(1.0) - strength * F.lit(1.0 - dim)).drop("_z", "_s")
