"""Optical plans: listing per event, composite and change of the chosen scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.operators import cells as C
from siltmark.operators import ranking as R
from siltmark.operators import search as S
from siltmark.session import written


def listing(events: DataFrame, scenes: DataFrame, obs: DataFrame, *, pre_days: int = 60, post_days: int = 60,
            auto_window: bool = False, max_cloud_pct: float | None = None, sensor: str = "s2") -> DataFrame:
    """Nearest-day-then-clearest scenes per side with measured cloud and snow over the AOI.

    ``obs``: scene_id, scl of the cells inside the AOI.
    """
    cap = 20.0 if (max_cloud_pct is None and auto_window) else max_cloud_pct
    found = S.scene_search(events, scenes, pre_days=pre_days, post_days=post_days, max_cloud=cap)
    top = R.nearest_clearest(found, 1) if auto_window else R.adaptive_listing(found, pre_days, post_days)
    share = C.cloud_snow_share(obs, "scl", F.lit(sensor), ("scene_id",)).select(
        "scene_id", F.col("cloud_pct").alias("aoi_cloud_pct"), F.col("snow_pct").alias("aoi_snow_pct"))
    return top.join(share, "scene_id", "left").withColumn("gap_days", F.bround("gap", 0).cast("bigint"))


def clarity(events: DataFrame, scenes: DataFrame, obs: DataFrame, *, pre_days: int, post_days: int, weight: float = 0.5,
            n_cells: int = 1024, sensor: str = "s2") -> DataFrame:
    """Scenes with coverage, cloud and snow over the AOI and the blended cost on that cloud."""
    found = S.scene_search(events, scenes, pre_days=pre_days, post_days=post_days)
    share = C.cloud_snow_share(obs, "scl", F.lit(sensor), ("scene_id",)).select(
        "scene_id", F.col("cloud_pct").alias("aoi_cloud_pct"), F.col("snow_pct").alias("aoi_snow_pct"),
        (100.0 * F.col("n_valid") / n_cells).alias("coverage_pct"))
    j = found.join(share, "scene_id", "left")
    return j.withColumn("cost", R.blended_cost(F.col("gap"), F.coalesce("aoi_cloud_pct", "cloud_pct"), weight))


def run(obs: DataFrame, picked: DataFrame | None = None, *, zero_dn: float = 0.0, offset: Column | None = None,
        bands=("red", "nir", "green", "blue", "swir1")) -> DataFrame:
    """Composite, indices and change of the picked scenes (event_id, scene), corrupt ones dropped."""
    if picked is not None:
        obs = obs.join(picked, ["event_id", "scene"], "left_semi")
    obs = C.drop_corrupt(obs.filter(~F.col("scl").isin(*C.SCL_NODATA)), F.lit(zero_dn), bands)
    comp = C.median_composite(obs, bands)
    off = F.lit(0.0) if offset is None else offset
    return C.change_layers(comp.withColumns({b: C.s2_reflectance(F.col(b), off) for b in bands}))


def auto_run(events: DataFrame, scenes: DataFrame, cells: DataFrame, sources: list[str], *, pre_days: int = 60, post_days: int = 60,
             k: int = R.RUN_LIMIT, zero_dn: float = 0.0, min_n: int = C.WRAPPED_MIN_N,
             bands=("red", "nir", "green", "blue", "swir1")) -> DataFrame:
    """Search, pick, composite and change with fallback: event_id, source, row, col and the change layers.

    Each side of each source takes its ``k`` cheapest scenes; scenes cut to 8 bits are left out.  An event uses
    the first of ``sources`` whose two sides both measured something; a source with an empty, corrupt or
    uncovered side is passed over, and an event without any source has no rows.  ``cells``: scene_id, row, col,
    scl and the bands.
    """
    found = S.scene_search(events, scenes.filter(F.col("source").isin(*sources)), pre_days=pre_days, post_days=post_days)
    found = found.withColumn("cost", R.blended_cost(F.col("gap"), F.col("cloud_pct")))
    picked = R.top_per_side(found, ("cost", "scene_id"), k, keys=("event_id", "source", "side")).select("event_id", "source", "side", "scene_id")
    obs = cells.filter(~F.col("scl").isin(*C.SCL_NODATA)).join(picked, "scene_id")
    obs = C.drop_corrupt(obs, F.lit(zero_dn), bands, ("event_id", "source", "scene_id"), min_n)
    comp = C.median_composite(obs, bands, ("event_id", "source", "side", "row", "col"))

    def seen(side: str) -> Column:
        return F.bool_or((F.col("side") == side) & F.col("red").isNotNull())
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    whole = comp.groupBy("event_id", "source").agg((seen("pre") & seen("post")).alias("_ok")).filter("_ok")
    choice = whole.groupBy("event_id").agg(F.min_by("source", rank).alias("source"))
    comp = comp.join(choice, ["event_id", "source"]).withColumns({b: C.s2_reflectance(F.col(b), F.lit(0.0)) for b in bands})
    return C.change_layers(comp, ("event_id", "source", "row", "col"))


def product_mosaic(obs: DataFrame, order: str, coefficient: Column, bands=("red", "green", "blue")) -> DataFrame:
    """Counts to reflectance by each scene's coefficient, haze removed, cast balanced, first valid scene wins.

    ``obs``: one row per cell of a scene.  Its reflectances are written once; floors and gains are a row per scene.
    """
    from siltmark.functions import tone
    scene = ["event_id", "scene"]
    refl = written(obs.select(*scene, "row", "col", F.col(order).alias("_order"), *[C.toa_reflectance(F.col(b), coefficient).alias(b) for b in bands]), "reflectance")
    clear = tone.dehaze_bands(refl, scene, bands)
    even = clear.join(written(tone.balance_gains(clear, scene), "gains"), scene, "left")
    even = even.withColumns({b: F.col(b) * F.coalesce(f"gain_{b}", F.lit(1.0)) for b in tone.RGB if b in bands})
    return even.groupBy("event_id", "row", "col").agg(*[F.min_by(b, F.when(F.col(b).isNotNull(), F.col("_order"))).alias(b) for b in bands])
