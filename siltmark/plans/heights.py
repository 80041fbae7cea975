"""Elevation plan: two height grids and outlines to volumes with error bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.operators import dem
from siltmark.session import written


def change_volume(pre: DataFrame, post: DataFrame, mask: DataFrame, keys: list[str], px_area: Column) -> DataFrame:
    """Difference, co-register, integrate over the outline cells.

    The ground outside the dilated outline gives the bias still left, which is removed, and the noise, which
    gives the error bounds; with too little of it both are zero and ``ok`` is false.  ``mask``: keys, row, col,
    n_rows, n_cols.
    """
    dh, st = dem.difference(pre, post, keys)
    ground = written(dem.stable_ground(dh, mask, keys), "ground")
    level = dh.join(ground.select(*keys, "offset_m"), keys, "left").withColumn("dh", F.col("dh") - F.coalesce("offset_m", F.lit(0.0)))
    out = dem.zonal_volume(level.drop("offset_m"), mask.select(*keys, "row", "col"), keys, px_area)
    s = out.join(st.select(*keys, "offset"), keys).join(ground, keys, "left").withColumn("sigma", F.coalesce("sigma_m", F.lit(0.0)))
    n = F.col("pixel_count")
    return s.withColumn("v_sigma_m3", F.col("sigma") * n * px_area).withColumn(
        "v_sigma_random_m3", F.col("sigma") * px_area * F.sqrt(n))
