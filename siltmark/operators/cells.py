"""Pixel cells: validity, reflectance, composites, indices and change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("red", "nir", "green", "blue", "swir1", "swir2")

# Class codes of the two optical products.
SCL_NODATA, SCL_DARK, SCL_CLOUD, SCL_SNOW = (0, 1), (2,), (3, 8, 9, 10), (11,)
QA_FILL, QA_CLOUD_BITS, QA_SNOW_BIT = 1, 0b11010, 0b100000
QA_UNUSABLE_BITS = 0b11111

# A scene whose bands lost their high byte never exceeds this count.
WRAPPED_MAX, WRAPPED_MIN_N = 511, 100


def clean(v: Column) -> Column:
    """NaN and infinities become NULL."""
    v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def power_value(v: Column, nodata: float | None = None, mask: Column | None = None) -> Column:
    """Radar power: finite, positive, not the fill value, not masked out."""
    ok = clean(v) > 0
    if nodata is not None:
        ok = ok & (v != nodata)
    if mask is not None:
        ok = ok & (mask > 0)
    return F.when(ok, v.cast("double"))


def height_value(v: Column, nodata: float = -9999.0) -> Column:
    """Heights may be negative: only finite and not the fill value."""
    return F.when(clean(v) != nodata, v.cast("double"))


def normal_sensor(name: Column) -> Column:
    t = F.lower(F.trim(name))
    return (F.when(t.isin("s2", "sentinel-2", "sentinel2", "sentinel-2-l2a"), "s2")
            .when(t.startswith("landsat"), "landsat"))


def class_flags(code: Column, sensor: Column) -> Column:
    """struct<valid, cloud, snow> of a class word."""
    s2 = sensor == "s2"
    return F.struct(
        F.when(s2, ~code.isin(*SCL_NODATA)).otherwise(code.bitwiseAND(1) == 0).alias("valid"),
        F.when(s2, code.isin(*SCL_CLOUD)).otherwise(code.bitwiseAND(QA_CLOUD_BITS) > 0).alias("cloud"),
        F.when(s2, code.isin(*SCL_SNOW)).otherwise(code.bitwiseAND(QA_SNOW_BIT) > 0).alias("snow"))


def unusable(code: Column, sensor: Column, mask_dark: bool = False) -> Column:
    """Fusion's rule: cloud, shadow or fill; an unmeasured word counts as unusable."""
    scl = (*SCL_NODATA, *SCL_CLOUD, *(SCL_DARK if mask_dark else ()))
    qa = code.isNull() | (code == 0) | (code.bitwiseAND(QA_UNUSABLE_BITS) > 0)
    return F.when(sensor == "s2", code.isNull() | code.isin(*scl)).otherwise(qa)


def excluded_by_mask(code: Column, keep: int = 0, nodata: int | None = None) -> Column:
    """Radar mask cells to leave out: any code but ``keep``, the fill value, and cells without a code."""
    bad = code.isNull() | (code != keep)
    return bad if nodata is None else bad | (code == nodata)


def observed(code: Column) -> Column:
    return code.isNotNull() & (code != 0)


def boa_offset(baseline: Column, acq: Column) -> Column:
    """Additive count offset: -1000 from baseline 04.00, else by date."""
    b = baseline.try_cast("double")
    return F.when(b.isNotNull(), F.when(b >= 4.0, -1000.0).otherwise(0.0)).otherwise(
        F.when(acq >= F.lit("2022-01-25").cast("timestamp_ntz"), -1000.0).otherwise(0.0))


def s2_reflectance(dn: Column, offset: Column) -> Column:
    return (dn + offset) / 10000.0


def landsat_reflectance(dn: Column) -> Column:
    return dn * 0.0000275 - 0.2


def toa_reflectance(dn: Column, coefficient: Column) -> Column:
    """Counts times the band's own coefficient; a missing coefficient is an error."""
    return F.when(coefficient.isNull(), F.raise_error(F.lit("no reflectance coefficient for band")).cast("double")
                  ).otherwise(dn * coefficient)


def _clip(v: Column, lo: float, hi: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def _ratio(a: Column, b: Column) -> Column:
    return _clip((a - b) / F.nullif(a + b, F.lit(0.0)), -1.0, 1.0)


def ndvi(red: Column, nir: Column) -> Column:
    return _ratio(nir, red)


def ndsi(green: Column, swir1: Column) -> Column:
    return _ratio(green, swir1)


def brightness(red: Column, green: Column, blue: Column, nir: Column) -> Column:
    """Mean of whichever of the four bands are present, clipped to 0-1."""
    bands = (red, green, blue, nir)
    total = sum((F.coalesce(b, F.lit(0.0)) for b in bands), F.lit(0.0))
    n = sum((b.isNotNull().cast("int") for b in bands), F.lit(0))
    return _clip(total / F.nullif(n, F.lit(0)), 0.0, 1.0)


def indices(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "ndvi": ndvi(F.col("red"), F.col("nir")), "ndsi": ndsi(F.col("green"), F.col("swir1")),
        "bright": brightness(F.col("red"), F.col("green"), F.col("blue"), F.col("nir"))})


def median_composite(obs: DataFrame, bands=BANDS, keys=("event_id", "side", "row", "col")) -> DataFrame:
    """Median over the scenes of a side, fill dropped and cloud kept.

    A cell's group is its scene stack, at most a listing's worth of rows.
    """
    return obs.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands],
                                  F.count(F.lit(1)).alias("n_scenes"))


def scene_peaks(obs: DataFrame, bands=BANDS, keys=("event_id", "scene")) -> DataFrame:
    """Brightest raw count and number of counts per scene, over all bands."""
    return obs.groupBy(*keys).agg(
        F.max(F.greatest(*bands) if len(bands) > 1 else F.col(bands[0])).alias("peak"),
        sum((F.count(b) for b in bands), F.lit(0)).alias("n_valid"))


def wrapped(peak: Column, n_valid: Column, zero_dn: Column, min_n: int = WRAPPED_MIN_N) -> Column:
    """The scene provably lost its high byte."""
    return (zero_dn > WRAPPED_MAX) & (n_valid >= min_n) & (peak <= WRAPPED_MAX)


def drop_corrupt(obs: DataFrame, zero_dn: Column, bands=BANDS, keys=("event_id", "scene"), min_n: int = WRAPPED_MIN_N) -> DataFrame:
    """Observations without the scenes whose bands were cut to 8 bits."""
    bad = scene_peaks(obs, bands, keys).filter(wrapped(F.col("peak"), F.col("n_valid"), zero_dn, min_n))
    return obs.join(bad.select(*keys), list(keys), "left_anti")


def sides_lost(before: DataFrame, after: DataFrame) -> DataFrame:
    """(event, side) that had scenes and has none after corrupt ones were dropped."""
    k = ["event_id", "side"]
    return before.select(*k).distinct().join(after.select(*k).distinct(), k, "left_anti")


def coverage(comp: DataFrame) -> DataFrame:
    """Does a composite hold any measured red cell?"""
    return comp.groupBy("event_id", "side").agg(F.bool_or(F.col("red").isNotNull()).alias("has_coverage"))


def first_valid_mosaic(obs: DataFrame, order: str, bands, keys=("event_id", "row", "col")) -> DataFrame:
    """Per band, the value of the first scene in order that measured the cell."""
    return obs.groupBy(*keys).agg(*[
        F.min_by(F.col(b), F.when(F.col(b).isNotNull(), F.col(order))).alias(b) for b in bands])


def change_layers(comp: DataFrame, keys=("event_id", "row", "col")) -> DataFrame:
    """Post minus pre of every index, one aggregation instead of a join; one-sided is NULL."""
    def side(c: str, s: str) -> Column:
        return F.max(F.when(F.col("side") == s, F.col(c)))
    out = indices(comp).groupBy(*keys).agg(*[
        side(c, s).alias(f"{c}_{s}") for c in ("ndvi", "ndsi", "bright") for s in ("pre", "post")])
    return out.withColumns({
        f"d{c}": F.col(f"{c}_post") - F.col(f"{c}_pre") for c in ("ndvi", "ndsi", "bright")})


def cloud_snow_share(obs: DataFrame, code: str, sensor: Column, keys=("event_id", "scene")) -> DataFrame:
    """Cloud and snow percent of the measured cells, NULL when nothing was measured."""
    f = class_flags(F.col(code), sensor)
    df = obs.select(*keys, f.alias("f"))
    n = F.count_if(F.col("f.valid"))
    return df.groupBy(*keys).agg(
        (100.0 * F.count_if(F.col("f.valid") & F.col("f.cloud")) / F.nullif(n, F.lit(0))).alias("cloud_pct"),
        (100.0 * F.count_if(F.col("f.valid") & F.col("f.snow")) / F.nullif(n, F.lit(0))).alias("snow_pct"),
        n.alias("n_valid"), F.count(F.lit(1)).alias("n_cells"))


def block_average(cells: DataFrame, factor: int, value: str, keys=("event_id",)) -> DataFrame:
    """Coarser grid on the same axes: mean of the measured fine cells."""
    return cells.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"),
                         F.floor(F.col("col") / factor).cast("int").alias("col")).agg(
        F.avg(value).alias(value), F.count(value).alias("n_fine"))


def regrid_average(cells: DataFrame, src: DataFrame, dst: DataFrame, value: str) -> DataFrame:
    """Area-weighted mean onto another grid of the same map frame.

    ``src``/``dst``: event_id, x0, dx, y0, dy (dy negative), n_rows, n_cols.  Each fine
    cell is spread over the target cells it touches.
    """
    a = cells.join(src.select("event_id", *[F.col(c).alias(f"s_{c}") for c in ("x0", "dx", "y0", "dy")]), "event_id")
    b = a.join(dst.select("event_id", *[F.col(c).alias(f"t_{c}") for c in ("x0", "dx", "y0", "dy", "n_rows", "n_cols")]), "event_id")
    eps = 1e-9

    def lines(axis: str, o: str, step: str, size: str):
        lo = (F.col(f"s_{o}") + F.col(axis) * F.col(f"s_{step}") - F.col(f"t_{o}")) / F.col(f"t_{step}")
        hi = (F.col(f"s_{o}") + (F.col(axis) + 1) * F.col(f"s_{step}") - F.col(f"t_{o}")) / F.col(f"t_{step}")
        first = F.greatest(F.floor(lo + eps), F.lit(0))
        last = F.least(F.ceil(hi - eps) - 1, F.col(f"t_{size}") - 1)
        seq = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(seq, lambda i: F.struct(
            i.alias("i"), (F.least(hi, i + 1.0) - F.greatest(lo, i.cast("double"))).alias("w")))
    b = (b.withColumn("_r", F.explode(lines("row", "y0", "dy", "n_rows")))
         .withColumn("_c", F.explode(lines("col", "x0", "dx", "n_cols"))))
    w = F.when(F.col(value).isNotNull(), F.col("_r.w") * F.col("_c.w"))
    return b.groupBy("event_id", F.col("_r.i").cast("int").alias("row"), F.col("_c.i").cast("int").alias("col")).agg(
        (F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def regrid_nearest(cells: DataFrame, src: DataFrame, dst: DataFrame, value: str) -> DataFrame:
    """Class codes onto another grid: the source cell under each target centre."""
    g = dst.join(src.select("event_id", *[F.col(c).alias(f"s_{c}") for c in ("x0", "dx", "y0", "dy")]), "event_id")
    g = (g.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
         .withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))))
    x = F.col("x0") + (F.col("col") + 0.5) * F.col("dx")
    y = F.col("y0") + (F.col("row") + 0.5) * F.col("dy")
    want = g.select("event_id", "row", "col",
                    F.floor((y - F.col("s_y0")) / F.col("s_dy")).cast("int").alias("_sr"),
                    F.floor((x - F.col("s_x0")) / F.col("s_dx")).cast("int").alias("_sc"))
    have = cells.select("event_id", F.col("row").alias("_sr"), F.col("col").alias("_sc"), value)
    return want.join(have, ["event_id", "_sr", "_sc"], "left").drop("_sr", "_sc")


def common_extent(boxes: DataFrame, keys=("event_id",)) -> DataFrame:
    """Intersection of the boxes of each group; empty intersections are dropped."""
    out = boxes.groupBy(*keys).agg(
        F.max("bbox.w").alias("w"), F.max("bbox.s").alias("s"),
        F.min("bbox.e").alias("e"), F.min("bbox.n").alias("n"), F.count(F.lit(1)).alias("n_boxes"))
    return out.filter((F.col("w") < F.col("e")) & (F.col("s") < F.col("n")))


def coarsest_grid(grids: DataFrame, keys=("event_id",)) -> DataFrame:
    """Reference grid of a fusion: the input with the largest ground pixel, first on ties."""
    cols = [c for c in grids.columns if c not in keys]
    return grids.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct("ground_m", (-F.col("order")).alias("o"))).alias("g")).select(*keys, "g.*")
