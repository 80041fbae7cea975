"""Cell queries: composites, indices, change, class shares and regridding."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import register
from siltmark.operators import cells as C
from siltmark.operators import focal
from siltmark.operators.order_stats import quantiles
from siltmark.sources import driver_tables as D

BANDS = ("red", "nir", "green", "blue", "swir1")

# scaled composite per side, reflectance, indices (SQL side)
COMP = """comp AS (SELECT event_id, side, "row", col, median(red) AS red, median(nir) AS nir, median(green) AS green,
   median(blue) AS blue, median(swir1) AS swir1, count(*) AS n_scenes FROM obs WHERE scl NOT IN (0, 1) GROUP BY ALL),
refl AS (SELECT event_id, side, "row", col, red / 10000.0::DOUBLE AS red, nir / 10000.0::DOUBLE AS nir,
   green / 10000.0::DOUBLE AS green, blue / 10000.0::DOUBLE AS blue, swir1 / 10000.0::DOUBLE AS swir1 FROM comp),
idx AS (SELECT event_id, side, "row", col,
   CASE WHEN nir + red <> 0 THEN greatest(-1, least(1, (nir - red) / (nir + red))) END AS ndvi,
   CASE WHEN green + swir1 <> 0 THEN greatest(-1, least(1, (green - swir1) / (green + swir1))) END AS ndsi,
   greatest(0, least(1, (red + green + blue + nir) / 4)) AS bright FROM refl),
chg AS (SELECT event_id, "row", col,
   max(ndvi) FILTER (side = 'post') - max(ndvi) FILTER (side = 'pre') AS dndvi,
   max(ndsi) FILTER (side = 'post') - max(ndsi) FILTER (side = 'pre') AS dndsi,
   max(bright) FILTER (side = 'post') - max(bright) FILTER (side = 'pre') AS dbright FROM idx GROUP BY ALL)"""


def composite(spark, d):
    obs = D.observations(spark, d).filter(~F.col("scl").isin(*C.SCL_NODATA))
    return C.median_composite(obs, BANDS)


def reflectance(spark, d):
    comp = composite(spark, d)
    return comp.withColumns({b: C.s2_reflectance(F.col(b), F.lit(0.0)) for b in BANDS})


def change(spark, d):
    return C.change_layers(reflectance(spark, d))


@register("median_composite", views=("obs",), extra=COMP, sql="SELECT * FROM comp")
def q_comp(spark, d):
    """Per-cell band medians, fill dropped, cloud kept."""
    return composite(spark, d)


@register("spectral_indices", views=("obs",), extra=COMP, sql="""
SELECT event_id, side, "row", col, round(ndvi, 9) AS ndvi, round(ndsi, 9) AS ndsi, round(bright, 9) AS bright FROM idx""")
def q_idx(spark, d):
    """Vegetation, snow and brightness indices."""
    i = C.indices(reflectance(spark, d))
    return i.select("event_id", "side", "row", "col", *[F.round(c, 9).alias(c) for c in ("ndvi", "ndsi", "bright")])


@register("change_layers", views=("obs",), extra=COMP, sql="""
SELECT event_id, "row", col, round(dndvi, 9) AS dndvi, round(dndsi, 9) AS dndsi, round(dbright, 9) AS dbright FROM chg""")
def q_change(spark, d):
    """Post minus pre, NULL when one side is missing."""
    return change(spark, d).select("event_id", "row", "col", *[F.round(c, 9).alias(c) for c in ("dndvi", "dndsi", "dbright")])


@register("reflectance_scaling", views=("scenes",), sql="""
SELECT scene_id, off AS boa_offset, round((dn + off) / 10000.0::DOUBLE, 9) AS s2, round(dn * 0.0000275::DOUBLE - 0.2::DOUBLE, 9) AS landsat
FROM (SELECT scene_id, CAST(scene_id % 9000 AS DOUBLE) AS dn,
   CAST(CASE WHEN scene_id % 4 = 3 THEN CASE WHEN acq - INTERVAL 725 DAY >= TIMESTAMP '2022-01-25' THEN -1000 ELSE 0 END
        WHEN scene_id % 4 = 0 THEN -1000 ELSE 0 END AS DOUBLE) AS off FROM scenes)""")
def q_refl(spark, d):
    """Additive count offset by baseline, else by date; both product scales."""
    i = F.col("scene_id")
    base = F.when(i % 4 == 0, "04.00").when(i % 4 == 1, "03.01").when(i % 4 == 2, "02.14").otherwise("n/a")
    acq = F.col("acq") - F.make_dt_interval(days=F.lit(725))
    s = D.scenes(spark, d).select("scene_id", (i % 9000).cast("double").alias("dn"), C.boa_offset(base, acq).alias("boa_offset"))
    return s.select("scene_id", "boa_offset", F.round(C.s2_reflectance(F.col("dn"), F.col("boa_offset")), 9).alias("s2"),
                    F.round(C.landsat_reflectance(F.col("dn")), 9).alias("landsat"))


@register("toa_from_counts", views=("obs",), sql="""
SELECT event_id, scene, "row", col, round(red * (0.00002::DOUBLE + scene * 0.000001::DOUBLE), 9) AS toa FROM obs""")
def q_toa(spark, d):
    """Counts times the scene's own band coefficient."""
    obs = D.observations(spark, d)
    coef = obs.select("scene").distinct().withColumn("k", F.lit(0.00002) + F.col("scene") * F.lit(0.000001))
    return obs.join(coef, "scene", "left").select(
        "event_id", "scene", "row", "col", F.round(C.toa_reflectance(F.col("red"), F.col("k")), 9).alias("toa"))


@register("cloud_and_snow_share", views=("obs",), sql="""
SELECT event_id, scene, count(*) FILTER (scl NOT IN (0, 1)) AS n_valid, count(*) AS n_cells,
  round(100.0 * count(*) FILTER (scl IN (3, 8, 9, 10)) / count(*) FILTER (scl NOT IN (0, 1)), 6) AS cloud_pct,
  round(100.0 * count(*) FILTER (scl = 11) / count(*) FILTER (scl NOT IN (0, 1)), 6) AS snow_pct FROM obs GROUP BY ALL""")
def q_cloud(spark, d):
    """Cloud and snow percent over measured cells."""
    out = C.cloud_snow_share(D.observations(spark, d), "scl", F.lit("s2"))
    return out.withColumns({c: F.round(c, 6) for c in ("cloud_pct", "snow_pct")})


@register("class_decode_both_products", views=("obs",), sql="""
SELECT event_id, scene, "row", col, scl IN (0, 1, 3, 8, 9, 10) AS s2_bad, scl IN (0, 1, 2, 3, 8, 9, 10) AS s2_bad_dark,
  red = 0 OR (red & 31) > 0 AS ls_bad, (red & 1) = 0 AS ls_valid, (red & 26) > 0 AS ls_cloud, (red & 32) > 0 AS ls_snow,
  scl <> 0 AS observed FROM obs""")
def q_decode(spark, d):
    """Class words of both products."""
    o, s2, ls = D.observations(spark, d), F.lit("s2"), F.lit("landsat")
    f = C.class_flags(F.col("red"), ls)
    return o.select("event_id", "scene", "row", "col", C.unusable(F.col("scl"), s2).alias("s2_bad"),
                    C.unusable(F.col("scl"), s2, True).alias("s2_bad_dark"), C.unusable(F.col("red"), ls).alias("ls_bad"),
                    f["valid"].alias("ls_valid"), f["cloud"].alias("ls_cloud"), f["snow"].alias("ls_snow"),
                    C.observed(F.col("scl")).alias("observed"))


@register("corrupt_scenes_dropped", views=("obs",), extra="""
low AS (SELECT * REPLACE (CASE WHEN (event_id + scene) % 5 = 0 THEN red % 256 ELSE red END AS red,
   CASE WHEN (event_id + scene) % 5 = 0 THEN nir % 256 ELSE nir END AS nir) FROM obs),
pk AS (SELECT event_id, scene, max(greatest(red, nir)) AS peak, count(red) + count(nir) AS n_valid FROM low GROUP BY ALL),
good AS (SELECT low.* FROM low ANTI JOIN (SELECT * FROM pk WHERE n_valid >= 100 AND peak <= 511) USING (event_id, scene))""",
          sql="""SELECT event_id, side, "row", col, median(red) AS red, median(nir) AS nir, count(*) AS n_scenes FROM good GROUP BY ALL""")
def q_corrupt(spark, d):
    """A4 X11: scenes cut to 8 bits are found by peak count and left out of the composite."""
    cut = (F.col("event_id") + F.col("scene")) % 5 == 0
    obs = D.observations(spark, d).withColumns({b: F.when(cut, F.col(b) % 256).otherwise(F.col(b)) for b in ("red", "nir")})
    return C.median_composite(C.drop_corrupt(obs, F.lit(1000.0), ("red", "nir")), ("red", "nir"))


@register("composite_coverage", views=("obs",), extra=COMP, sql="""
SELECT event_id, side, bool_or(red IS NOT NULL) AS has_coverage FROM comp GROUP BY ALL""")
def q_cov(spark, d):
    """A5: does each side hold any measured cell?"""
    return C.coverage(composite(spark, d))


@register("first_valid_mosaic", views=("obs",), sql="""
SELECT event_id, "row", col, arg_min(r, scene) FILTER (r IS NOT NULL) AS red, arg_min(g, scene) FILTER (g IS NOT NULL) AS green
FROM (SELECT *, CASE WHEN scl NOT IN (0, 1, 8, 9) THEN red END AS r, CASE WHEN scl <> 3 THEN green END AS g FROM obs) GROUP BY ALL""")
def q_mosaic(spark, d):
    """A3: first valid scene wins, each band on its own."""
    o = D.observations(spark, d).withColumns({
        "red": F.when(~F.col("scl").isin(0, 1, 8, 9), F.col("red")), "green": F.when(F.col("scl") != 3, F.col("green"))})
    return C.first_valid_mosaic(o, "scene", ("red", "green"))


@register("regrid_block_average", views=("obs",), extra=COMP, sql="""
SELECT event_id, CAST("row" // 3 AS INTEGER) AS "row", CAST(col // 3 AS INTEGER) AS col, round(avg(dbright), 12) AS dbright,
  count(dbright) AS n_fine FROM chg GROUP BY ALL""")
def q_block(spark, d):
    """Coarse mean of measured fine cells."""
    return C.block_average(change(spark, d), 3, "dbright").withColumn("dbright", F.round("dbright", 12))


@register("regrid_area_weighted", views=("obs",), extra=COMP + """,
spread AS (SELECT event_id, dbright, r, c,
   least(("row" + 1) / 2.5::DOUBLE, r + 1) - greatest("row" / 2.5::DOUBLE, r) AS wr,
   least((col + 1) / 2.5::DOUBLE, c + 1) - greatest(col / 2.5::DOUBLE, c) AS wc
  FROM chg, range(13) a(r), range(13) b(c) WHERE dbright IS NOT NULL)""", sql="""
SELECT event_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(sum(dbright * wr * wc) / sum(wr * wc), 12) AS dbright
FROM spread WHERE wr > 1e-9 AND wc > 1e-9 GROUP BY ALL""")
def q_area(spark, d):
    """Area-weighted mean onto a grid that is no whole multiple."""
    g = D.grids(spark, d)
    dst = g.select("event_id", "x0", (F.col("dx") * 2.5).alias("dx"), "y0", (F.col("dy") * 2.5).alias("dy"),
                   F.lit(13).alias("n_rows"), F.lit(13).alias("n_cols"))
    out = C.regrid_average(change(spark, d).filter(F.col("dbright").isNotNull()), g, dst, "dbright")
    return out.withColumn("dbright", F.round("dbright", 12))


@register("regrid_nearest_classes", views=("grids_l", "obs_l"), extra="""
want AS (SELECT event_id, r, c, CAST(floor((r + 0.5) * 1.5::DOUBLE) AS INTEGER) AS sr, CAST(floor((c + 0.5) * 1.5::DOUBLE) AS INTEGER) AS sc
  FROM grids_l, range(21) a(r), range(21) b(c)), one AS (SELECT * FROM obs_l)""", sql="""
SELECT want.event_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, scl
FROM want LEFT JOIN one ON one.event_id = want.event_id AND one."row" = sr AND one.col = sc""")
def q_near(spark, d):
    """Nearest class code under each target centre."""
    g = D.layer_grids(spark, d, range(1, 8))
    dst = g.select("event_id", "x0", (F.col("dx") * 1.5).alias("dx"), "y0", (F.col("dy") * 1.5).alias("dy"),
                   F.lit(21).alias("n_rows"), F.lit(21).alias("n_cols"))
    return C.regrid_nearest(D.layer_observations(spark, d), g, dst, "scl")


@register("common_extent", views=("det", "scenes"), sql="""
SELECT source, relative_orbit, scene_id % 400 AS pile, max(w) AS w, max(s) AS s, min(e) AS e, min(n) AS n, count(*) AS n_boxes
FROM scenes GROUP BY ALL HAVING max(w) < min(e) AND max(s) < min(n)""")
def q_extent(spark, d):
    """Intersection of several footprints, empty ones dropped."""
    s = D.scenes(spark, d).withColumn("pile", F.col("scene_id") % 400)
    return C.common_extent(s, ("source", "relative_orbit", "pile"))


@register("coarsest_reference_grid", views=("scenes",), sql="""
SELECT event_id, arg_max(scene_id, (ground_m, -scene_id)) AS scene_id, max(ground_m) AS ground_m
FROM (SELECT scene_id % 250 AS event_id, scene_id, CAST(10 + (scene_id * 7) % 5 * 10 AS DOUBLE) AS ground_m FROM scenes) GROUP BY 1""")
def q_coarse(spark, d):
    """The coarsest input sets the grid, first on ties."""
    i = F.col("scene_id")
    g = D.scenes(spark, d).select((i % 250).alias("event_id"), "scene_id", (10 + (i * 7) % 5 * 10).cast("double").alias("ground_m"),
                                  i.alias("order"))
    return C.coarsest_grid(g).select("event_id", "scene_id", "ground_m")


@register("exact_quantiles", views=("obs",), sql="""
SELECT event_id, side, count(nir) AS n_values, quantile_cont(CAST(nir AS DOUBLE), 0.001) AS p0_1,
  quantile_cont(CAST(nir AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(nir AS DOUBLE), 0.995) AS p99_5 FROM obs GROUP BY ALL""")
def q_quant(spark, d):
    """Exact quantiles of groups of any size (used by A6 A13-A18)."""
    return quantiles(D.observations(spark, d), ["event_id", "side"], F.col("nir").cast("double"),
                     {"p0_1": 0.001, "p50": 0.5, "p99_5": 0.995})


@register("cloud_vote_mask", views=("dense", "obs"), extra="""
v AS (SELECT event_id, "row", col, side, count(*) FILTER (scl <> 0) AS seen,
   count(*) FILTER (scl IN (1, 3, 8, 9, 10)) AS votes FROM obs GROUP BY ALL),
j AS (SELECT d.*, s.side, coalesce(seen, 0) AS seen, coalesce(votes, 0) AS votes FROM dense d
   CROSS JOIN (SELECT unnest(['pre', 'post']) AS side) s LEFT JOIN v USING (event_id, "row", col, side))""", sql="""
SELECT event_id, "row", col, bool_or(CASE WHEN seen > 0 THEN votes / seen::DOUBLE >= 0.5 ELSE true END) AS cloud,
  bool_or(seen = 0) AS unseen FROM j GROUP BY ALL""")
def q_vote(spark, d):
    """A cell is cloudy when half of a side's scenes that saw it say so, or none saw it."""
    from siltmark.operators.fusion import cloud_vote
    sides = D.grids(spark, d).withColumn("side", F.explode(F.array(F.lit("pre"), F.lit("post"))))
    dense = focal.densify(spark.createDataFrame([], "event_id long, side string, row int, col int"), sides,
                          ["event_id", "side"]).select("event_id", "side", "row", "col")
    return cloud_vote(D.observations(spark, d), dense, "scl", F.lit("s2"))
