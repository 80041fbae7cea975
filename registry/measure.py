"""Elevation change, outlines, volumes, ledger and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import SQL, VIEWS, register
from registry.detectors import KEYS, TILE
from registry.fusing import MASKED, PRIMARY, maps, primary, scored
from registry.pixels import COMP, change
from siltmark.functions import geo
from siltmark.functions import volume as V
from siltmark.operators import dem as DEM
from siltmark.operators import focal
from siltmark.operators import ledger as L
from siltmark.operators import merge as M
from siltmark.operators import scoring as SC
from siltmark.operators import volumes as VO
from siltmark.sources import driver_tables as D

# ------------------------------------------------------------------ elevation change
DH = """raw AS (SELECT event_id, "row", col, 2.0::DOUBLE + (red % 33 - 16) / 8.0::DOUBLE
    - CASE WHEN ("row" - 16) * ("row" - 16) + (col - 16) * (col - 16) <= 36 THEN 40.0::DOUBLE ELSE 0 END AS v FROM obs_l)"""


def clip_sql(src, n=5, p=""):
    """The five sigma-clip steps as a chain of CTEs whose names begin with ``p``."""
    out, cur = [], src
    for i in range(n):
        out.append(f"{p}s{i} AS (SELECT event_id, median(v) AS med, stddev_pop(v) AS sd FROM {cur} GROUP BY 1)")
        out.append(f"{p}k{i} AS (SELECT k.* FROM {cur} k JOIN {p}s{i} USING (event_id) WHERE abs(v - med) <= 3 * sd)")
        cur = f"{p}k{i}"
    out.append(f"{p}fin AS (SELECT event_id, median(v) AS off, count(*) AS stable_n FROM {cur} GROUP BY 1)")
    out.append(f"{p}mad AS (SELECT event_id, median(abs(v - off)) * 1.4826 AS sigma FROM {cur} JOIN {p}fin USING (event_id) GROUP BY 1)")
    return ",\n".join(out)


def dem_pair(spark, d):
    o = D.layer_observations(spark, d)
    scar = F.when(D.truth_expr(), 40.0).otherwise(0.0)
    pre = o.select("event_id", "row", "col", (100.0 + 20 * F.col("row")).alias("h"))
    post = o.select("event_id", "row", "col", (100.0 + 20 * F.col("row") + 2.0 + (F.col("red") % 33 - 16) / 8.0 - scar).alias("h"))
    return pre, post


@register("dem_vertical_offset", views=("obs_l",), extra=DH + ",\n" + clip_sql("raw"), sql="""
SELECT event_id, off AS "offset", stable_n, round(sigma, 6) AS sigma, n AS n_values FROM fin JOIN mad USING (event_id)
JOIN (SELECT event_id, count(*) AS n FROM raw GROUP BY 1) USING (event_id)""")
def q_offset(spark, d):
    """Robust vertical offset by five 3-sigma clips."""
    return DEM.difference(*dem_pair(spark, d), KEYS)[1].withColumn("sigma", F.round("sigma", 6))


@register("dem_difference", views=("obs_l",), extra=DH + ",\n" + clip_sql("raw"), sql="""
SELECT event_id, "row", col, v - off AS dh FROM raw JOIN fin USING (event_id)""")
def q_dh(spark, d):
    """Elevation change with the offset removed."""
    return DEM.difference(*dem_pair(spark, d), KEYS)[0]


@register("dem_stable_ground", views=("obs_l",), extra=DH + """,
outside AS (SELECT r.* FROM raw r ANTI JOIN (SELECT DISTINCT t.event_id, t."row" + a AS "row", t.col + b AS col
   FROM (SELECT DISTINCT event_id, "row", col FROM obs_l WHERE ("row" - 16) * ("row" - 16) + (col - 16) * (col - 16) <= 36) t,
   (SELECT a.x AS a, b.x AS b FROM range(-3, 4) a(x), range(-3, 4) b(x) WHERE abs(a.x) + abs(b.x) <= 3)) g USING (event_id, "row", col)),
""" + clip_sql("outside"), sql="""
SELECT event_id, off AS offset_m, round(sigma, 6) AS sigma_m, stable_n AS stable_px, true AS ok FROM fin JOIN mad USING (event_id)""")
def q_stable(spark, d):
    """Residual bias and noise outside the dilated outline."""
    pre, post = dem_pair(spark, d)
    dh = DEM.difference(pre, post, KEYS, coregister=False)[0]
    mask = D.layer_observations(spark, d).filter(D.truth_expr()).select(
        "event_id", "row", "col", F.lit(32).alias("n_rows"), F.lit(32).alias("n_cols")).distinct()
    return DEM.stable_ground(dh, mask, KEYS).withColumn("sigma_m", F.round("sigma_m", 6))


@register("dem_zonal_volume", views=("obs_l",), extra=DH + """,
z AS (SELECT event_id, v FROM raw WHERE ("row" - 16) * ("row" - 16) + (col - 16) * (col - 16) <= 36)""", sql="""
SELECT event_id, count(*) AS pixel_count, avg(v) AS mean_dh_m, max(v) AS max_rise_m, min(v) AS max_drop_m, sum(v) * 100 AS v_net,
  sum(greatest(v, 0)) * 100 AS v_deposit, sum(least(v, 0)) * 100 AS v_erosion, count(*) * 100.0::DOUBLE AS covered_area_m2,
  0.5::DOUBLE * count(*) * 100.0::DOUBLE AS v_sigma_m3, round(0.5 * 100.0 * sqrt(count(*)), 6) AS v_sigma_random_m3,
  round(count(*) * 100.0 / 11300.0, 6)::DOUBLE AS coverage_frac FROM z GROUP BY 1""")
def q_zonal(spark, d):
    """Net, deposit and erosion volume with both error bounds."""
    pre, post = dem_pair(spark, d)
    dh = DEM.difference(pre, post, KEYS, coregister=False)[0]
    mask = D.layer_observations(spark, d).filter(D.truth_expr()).select("event_id", "row", "col").distinct()
    area = mask.select("event_id").distinct().withColumn("outline_area_m2", F.lit(11300.0))
    out = DEM.zonal_volume(dh, mask, KEYS, F.lit(100.0), sigma=F.lit(0.5), outline_area=area)
    return out.drop("outline_area_m2").withColumns({c: F.round(c, 6) for c in ("v_sigma_random_m3", "coverage_frac")})


@register("dem_fall_height", views=("dem", "grids"), extra="""
pt AS (SELECT event_id, k AS line_id, CAST(floor(2.5 + s * (28.0 - k) / 26.0::DOUBLE) AS INTEGER) AS "row", CAST(floor(3.5 + k) AS INTEGER) AS col
  FROM grids, range(4) t(k), range(27) u(s))""", sql="""
SELECT event_id, CAST(line_id AS INTEGER) AS line_id, max(h) AS z_top, min(h) AS z_bottom, max(h) - min(h) AS "drop" FROM pt JOIN dem USING (event_id, "row", col) GROUP BY ALL""")
def q_fall(spark, d):
    """Highest and lowest height along a densified line."""
    g = D.grids(spark, d).withColumn("line_id", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    k = F.col("line_id")
    seg = F.struct((k + 3.5).alias("x0"), F.lit(2.5).alias("y0"), (k + 3.5).alias("x1"), (F.lit(30.5) - k).alias("y1"))
    lines = g.select("event_id", "line_id", F.array(seg).alias("seg"), (F.lit(28.0) - k).cast("double").alias("length"))
    return DEM.fall_height(lines, D.elevation(spark, d), KEYS).drop("n")


@register("bilinear_samples", views=("dem",), extra="""
pt AS (SELECT o_orderkey // 4096 AS event_id, o_orderkey AS point_id, (o_orderkey * 37 % 310) / 10.0::DOUBLE AS fy, (o_orderkey * 53 % 310) / 10.0::DOUBLE AS fx FROM orders),
c AS (SELECT pt.*, CAST(floor(fy) AS INTEGER) + a AS "row", CAST(floor(fx) AS INTEGER) + b AS col,
  (CASE a WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE b WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
  FROM pt, (SELECT a.x AS a, b.x AS b FROM range(2) a(x), range(2) b(x)))""", sql="""
SELECT event_id, point_id, round(sum(h * w) / nullif(sum(w) FILTER (h IS NOT NULL), 0), 6) AS h FROM c LEFT JOIN dem USING (event_id, "row", col) GROUP BY ALL""")
def q_bilinear(spark, d):
    """Bilinear over the measured corners only."""
    k = F.col("o_orderkey")
    p = D.table(spark, d, "orders").select(F.expr("o_orderkey div 4096").alias("event_id"), k.alias("point_id"),
                                           ((k * 37 % 310) / 10.0).alias("fy"), ((k * 53 % 310) / 10.0).alias("fx"))
    return DEM.bilinear(p, D.elevation(spark, d), KEYS).withColumn("h", F.round("h", 6))


# outlines as diamonds around a point of each event grid, in map units
def diamonds(spark, d):
    g = D.grids(spark, d).withColumn("outline_id", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    i = F.col("outline_id")
    cx = F.col("x0") + (F.lit(8.3125) + i * 7) * F.col("dx")
    cy = F.col("y0") + (F.lit(9.25) + i * 6) * F.col("dy")
    rx, ry = F.lit(5.5) * F.col("dx"), F.lit(4.5) * F.abs("dy")

    def pt(a, b):
        return F.struct((cx + a * rx).alias("lon"), (cy + b * ry).alias("lat"))
    return g.select("event_id", "outline_id", F.array(pt(1, 0), pt(0, 1), pt(-1, 0), pt(0, -1)).alias("ring"))


@register("polygon_cells_by_centre", views=("dense",), sql="""
SELECT event_id, CAST(i AS INTEGER) AS outline_id, "row", col FROM dense, range(3) t(i)
WHERE abs(col + 0.5 - (8.3125::DOUBLE + i * 7)) / 5.5 + abs("row" + 0.5 - (9.25 + i * 6)) / 4.5 < 1""")
def q_poly(spark, d):
    """Cells whose centre lies in the outline."""
    return DEM.polygon_cells(diamonds(spark, d), D.grids(spark, d), KEYS)


@register("polygon_cells_all_touched", views=("dense",), sql="""
SELECT event_id, CAST(i AS INTEGER) AS outline_id, "row", col FROM dense, range(3) t(i)
WHERE greatest(0, greatest(col - (8.3125::DOUBLE + i * 7), (8.3125::DOUBLE + i * 7) - col - 1)) / 5.5 + greatest(0, greatest("row" - (9.25 + i * 6), (9.25 + i * 6) - "row" - 1)) / 4.5 < 1""")
def q_touch(spark, d):
    """Every cell the outline touches."""
    return DEM.polygon_cells(diamonds(spark, d), D.grids(spark, d), KEYS, all_touched=True)


RINGS = """pts AS (SELECT l_orderkey, l_quantity AS x, l_tax * 1000 + l_linenumber AS y FROM lineitem)"""


@register("longest_chord", extra=RINGS, sql="""
SELECT a.l_orderkey, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS length FROM pts a JOIN pts b USING (l_orderkey) GROUP BY 1""")
def q_chord(spark, d):
    """Farthest pair of a boundary's vertices."""
    p = D.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_quantity").alias("lon"), (F.col("l_tax") * 1000 + F.col("l_linenumber")).alias("lat"))).alias("ring"))
    return p.select("l_orderkey", F.round(DEM.longest_chord(F.col("ring"))["length"], 6).alias("length"))


@register("outline_contains_source", views=("strips",), sql="""
SELECT feature_id, tw <= w2 AND e2 < te AND ts <= s2 AND n2 < tn AS inside FROM (SELECT feature_id, w AS tw, s AS ts, e AS te, n AS tn,
  w + 0.1::DOUBLE AS w2, s + (feature_id % 5 - 1) / 32.0::DOUBLE AS s2, e - 0.1::DOUBLE AS e2, n - (feature_id % 7 - 1) / 32.0::DOUBLE AS n2 FROM strips)""")
def q_contains(spark, d):
    """Does the total outline hold the source outline?"""
    b, i = F.col("bbox"), F.col("feature_id")
    inner = F.struct((b["w"] + 0.1).alias("w"), (b["s"] + (i % 5 - 1) / 32.0).alias("s"),
                     (b["e"] - 0.1).alias("e"), (b["n"] - (i % 7 - 1) / 32.0).alias("n"))
    return D.strips(spark, d).select("feature_id", DEM.ring_inside(geo.box_ring(inner), geo.box_ring(b)).alias("inside"))


@register("box_coverage_percent", views=("det", "strips"), sql="""
SELECT feature_id, round(100 * greatest(0, least(e, w + 0.8) - greatest(w, w + 0.1)) * greatest(0, least(n, s + 0.9) - greatest(s, s - 0.2)) / (0.7 * 1.1), 6) AS pct FROM strips""")
def q_pct(spark, d):
    """Percent of a box a footprint fills, by polygon clipping."""
    b = F.col("bbox")
    box = F.struct((b["w"] + 0.1).alias("w"), (b["s"] - 0.2).alias("s"), (b["w"] + 0.8).alias("e"), (b["s"] + 0.9).alias("n"))
    return D.strips(spark, d).select("feature_id", F.round(geo.coverage_pct(F.array(geo.box_ring(b)), box), 6).alias("pct"))


# ------------------------------------------------------------------ outlines and volumes
ROLES = """lg AS (SELECT slide, role, arg_max(polygon_id, (area_m2, -polygon_id)) AS polygon_id, max(area_m2) AS area_m2, count(*) AS n_polygons
   FROM outlines WHERE area_m2 > 0 GROUP BY ALL),
ra AS (SELECT slide, max(area_m2) FILTER (role = 'total') AS a_total, max(area_m2) FILTER (role = 'best') AS a_best,
   max(area_m2) FILTER (role = 'low') AS a_low, max(area_m2) FILTER (role = 'high') AS a_high FROM lg GROUP BY 1),
rs AS (SELECT slide, a_total * 4 AS a_total, a_best, a_low * CASE WHEN slide LIKE '%3' THEN 1.5::DOUBLE ELSE 0.75::DOUBLE END AS a_low, a_high * 1.25::DOUBLE AS a_high FROM ra)"""


def sized(spark, d):
    a = VO.role_areas(VO.largest_per_role(D.outlines(spark, d)))
    return a.select("slide", (F.col("a_total") * 4).alias("a_total"), "a_best",
                    (F.col("a_low") * F.when(F.col("slide").endswith("3"), 1.5).otherwise(0.75)).alias("a_low"),
                    (F.col("a_high") * 1.25).alias("a_high"))


@register("largest_outline_per_role", views=("outlines",), extra=ROLES, sql="SELECT * FROM lg")
def q_largest(spark, d):
    """The largest polygon of every role."""
    return VO.largest_per_role(D.outlines(spark, d))


FIT = """fit AS (SELECT *, CASE WHEN a_low > a_best THEN 'low_above_best' WHEN a_high < a_best THEN 'high_below_best'
   WHEN a_best IS NOT NULL AND a_low > a_high THEN 'low_above_high' WHEN a_total < greatest(a_best, a_low, a_high) THEN 'total_below_source' END AS problem,
   log10(a_best) AS la, coalesce((log10(a_high) - log10(a_low)) / 4, 0) AS sa FROM rs),
vol AS (SELECT *, -0.63 + 1.41 * la AS lv, sqrt(0.06 * 0.06 + la * la * 0.02 * 0.02 + 1.41 * 1.41 * sa * sa) AS sd FROM fit)"""


@register("outline_role_order", views=("outlines",), extra=ROLES + ",\n" + FIT, sql="SELECT slide, problem FROM fit")
def q_order(spark, d):
    """Which outlines look swapped."""
    a = {r: F.col(f"a_{r}") for r in ("total", "best", "low", "high")}
    return sized(spark, d).select("slide", V.order_problem(a["total"], a["best"], a["low"], a["high"]).alias("problem"))


@register("volume_from_outlines", views=("outlines",), extra=ROLES + ",\n" + FIT, sql="""
SELECT slide, problem, round(CASE WHEN problem IS NULL THEN pow(10, lv) END, 4) AS v, round(CASE WHEN problem IS NULL THEN pow(10, lv - sd) END, 4) AS v_lo,
  round(CASE WHEN problem IS NULL THEN pow(10, lv + sd) END, 4) AS v_hi, round(CASE WHEN problem IS NULL AND a_best IS NOT NULL THEN pow(10, -0.63 + 1.41 * log10(a_low)) END, 4) AS v_src_low,
  round(CASE WHEN problem IS NULL THEN pow(10, lv) / a_total END, 6) AS implied_depth, coalesce(problem IS NULL AND pow(10, lv) / a_total > 5, false) AS too_deep FROM vol""")
def q_volume(spark, d):
    """Volume with propagated error, implied depth and its flag."""
    m = VO.measure(sized(spark, d), F.lit("bedrock"))
    return m.select("slide", "problem", *[F.round(c, 4).alias(c) for c in ("v", "v_lo", "v_hi", "v_src_low")],
                    F.round("implied_depth", 6).alias("implied_depth"), "too_deep")


@register("volume_event_columns", sql="""
WITH det AS (""" + VIEWS["det"] + """), v AS (""" + SQL["volume_from_outlines"] + """),
r AS (SELECT substr(slide, 7, 1)::BIGINT * 4 AS event_id, slide, implied_depth FROM v),
o AS (SELECT p_partkey % 25 AS event_id, ['total', 'best', 'low', 'high'][p_partkey % 4 + 1] AS role, p_partkey AS k, p_size / 1000.0::DOUBLE AS dx, p_retailprice::DOUBLE / 100000 AS dy FROM part),
t AS (SELECT event_id, role, lon + (k % 50) / 100.0::DOUBLE + (dx + (k % 3) / 250.0::DOUBLE) / 3 AS x, lat + (k % 40) / 100.0::DOUBLE + dy / 3 AS y, dx * dy / 2 AS a
  FROM o JOIN det USING (event_id) WHERE role IN ('best', 'total') AND NOT (role = 'best' AND event_id % 8 = 0) AND event_id <> 12),
c AS (SELECT event_id, role, sum(x * a) / sum(a) AS x, sum(y * a) / sum(a) AS y FROM t GROUP BY ALL),
s AS (SELECT event_id, arg_min({'role': role, 'x': x, 'y': y}, CASE role WHEN 'best' THEN 1 ELSE 2 END) AS s FROM c GROUP BY 1),
l AS (SELECT event_id, arg_max({'d': implied_depth}, slide) AS l FROM r GROUP BY 1)
SELECT event_id, slide, round(coalesce(implied_depth, l.d), 6) AS implied_depth, strftime(origin, '%Y-%m-%dT%H:%M:%SZ') AS origin_utc, lat AS det_lat, lon AS det_lon,
  det.event_id / 100.0::DOUBLE AS det_coherency, s.role AS scar_role, round(s.y, 6) AS scar_lat, round(s.x, 6) AS scar_lon,
  CASE WHEN s.y + lat IS NOT NULL THEN round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(s.y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(s.y)) * pow(sin(radians(s.x - lon) / 2), 2)))), 2) END AS offset_km
FROM r JOIN l USING (event_id) LEFT JOIN det USING (event_id) LEFT JOIN s USING (event_id)""")
def q_eventcols(spark, d):
    """Measured slides with the detection, the scar's centre and its distance from the detection."""
    rows = q_volume(spark, d).select((F.substring("slide", 7, 1).cast("bigint") * 4).alias("event_id"), "slide", "implied_depth")
    det = D.detections(spark, d)
    k = F.col("p_partkey")
    lon, lat = F.col("lon") + k % 50 / 100.0, F.col("lat") + k % 40 / 100.0
    role = F.element_at(F.array(*[F.lit(r) for r in ("total", "best", "low", "high")]), (k % 4 + 1).cast("int"))

    def point(x, y):
        return F.struct((lon + x).alias("lon"), (lat + y).alias("lat"))
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point(F.col("p_size") / 1000.0, F.lit(0.0)), point(k % 3 / 250.0, F.col("p_retailprice").cast("double") / 100000))
    outlines = D.table(spark, d, "part").withColumn("event_id", k % 25).join(det, "event_id").select("event_id", role.alias("role"), ring.alias("ring")).filter(
        "NOT (role = 'best' AND event_id % 8 = 0) AND event_id <> 12")
    out = VO.with_event(rows, det.withColumn("coherency", F.col("event_id") / 100.0), outlines, fields=("coherency",))
    return out.select("event_id", "slide", F.round("implied_depth", 6).alias("implied_depth"), "origin_utc", "det_lat", "det_lon", "det_coherency", "scar_role",
                      F.round("scar_lat", 6).alias("scar_lat"), F.round("scar_lon", 6).alias("scar_lon"), F.round("offset_km", 2).alias("offset_km"))


@register("thickness_volumes", views=("outlines",), sql="""
SELECT polygon_id, area_m2 * 2.5 AS volume, CASE WHEN polygon_id % 3 = 0 THEN area_m2 * 1.5 END AS low, area_m2 * 3.5 AS high,
  CASE WHEN polygon_id % 3 = 0 THEN 'glacier_far' END AS setting FROM outlines""")
def q_thick(spark, d):
    """Area times thickness with the named setting."""
    best, high = F.lit(2.5), F.lit(3.5)
    low = F.when(F.col("polygon_id") % 3 == 0, 1.5).otherwise(2.75)
    v = V.thickness_volume(F.col("area_m2"), best, low, high)
    return D.outlines(spark, d).select("polygon_id", v["volume"].alias("volume"), v["low"].alias("low"), v["high"].alias("high"),
                                       V.thickness_setting(best, low, high).alias("setting"))


@register("travel_angle", views=("outlines",), sql="""
SELECT polygon_id, round(dz / len, 6) AS hl_ratio, round(degrees(atan2(dz, len)), 6) AS reach_angle
FROM (SELECT polygon_id, (polygon_id % 900)::DOUBLE AS dz, nullif(area_m2, 0) / 10 AS len FROM outlines)""")
def q_travel(spark, d):
    """Fall over run and its angle."""
    t = V.travel((F.col("polygon_id") % 900).cast("double"), F.col("area_m2") / 10)
    return D.outlines(spark, d).select("polygon_id", F.round(t["hl_ratio"], 6).alias("hl_ratio"), F.round(t["reach_angle"], 6).alias("reach_angle"))


@register("measurement_upsert", sql="""
SELECT coalesce(o.slide, n.slide) AS slide, CASE WHEN n.slide IS NOT NULL THEN n.v ELSE o.v END AS v, coalesce(n.length, o.length) AS length
FROM (SELECT p_partkey AS slide, p_size::DOUBLE AS v, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END AS length FROM part WHERE p_partkey % 5 <> 0) o
FULL JOIN (SELECT p_partkey AS slide, p_size * 2.0::DOUBLE AS v, CASE WHEN p_partkey % 7 = 0 THEN 1.0::DOUBLE END AS length FROM part WHERE p_partkey % 3 = 0) n ON o.slide = n.slide""")
def q_upsert(spark, d):
    """New measurements replace old ones, centerline fields survive."""
    p, k = D.table(spark, d, "part"), F.col("p_partkey")
    old = p.filter(k % 5 != 0).select(k.alias("slide"), F.col("p_size").cast("double").alias("v"), F.when(k % 2 == 0, F.col("p_retailprice")).alias("length"))
    new = p.filter(k % 3 == 0).select(k.alias("slide"), (F.col("p_size") * 2.0).alias("v"), F.when(k % 7 == 0, F.lit(1.0)).alias("length"))
    return VO.upsert(old, new).drop("replaced")


NAMES = """nm AS (SELECT p_partkey // 6 AS project, p_partkey AS pos, ['Total Area', 'Source Area best', 'source area (LOW)', 'Source area max', 'source area', 'total landslide low'][(p_partkey * 5 % 6) + 1] AS name FROM part),
tk AS (SELECT *, regexp_split_to_array(lower(name), '[^a-z0-9]+') AS t FROM nm),
fl AS (SELECT *, (list_contains(t, 'total') AND list_contains(t, 'area')) OR (list_contains(t, 'total') AND list_contains(t, 'landslide')) AS tot,
   list_contains(t, 'source') AND list_contains(t, 'area') AS src, list_contains(t, 'best') AS b, list_contains(t, 'low') AS l, list_contains(t, 'max') AS h FROM tk),
g AS (SELECT project, min(pos) FILTER (tot) AS total, coalesce(min(pos) FILTER (src AND b), min(pos) FILTER (src AND NOT b AND NOT l AND NOT h)) AS best,
   min(pos) FILTER (src AND l) AS low, min(pos) FILTER (src AND h) AS high FROM fl GROUP BY 1)"""


@register("outline_layer_roles", extra=NAMES, sql="""
SELECT project, role, pos FROM (SELECT project, unnest(['total', 'best', 'low', 'high']) AS role, unnest([total, best, low, high]) AS pos FROM g) WHERE pos IS NOT NULL""")
def q_roles(spark, d):
    """Layers claimed by role words, first claim wins."""
    k = F.col("p_partkey")
    names = ("Total Area", "Source Area best", "source area (LOW)", "Source area max", "source area", "total landslide low")
    p = D.table(spark, d, "part").select(F.expr("p_partkey div 6").alias("project"), k.alias("pos"), F.element_at(
        F.array(*[F.lit(n) for n in names]), ((k * 5) % 6 + 1).cast("int")).alias("name"))
    return VO.match_roles(p).select("project", "role", "pos")


# ------------------------------------------------------------------ ledger
FIND = """q AS (SELECT event_id AS query_id, event_id AS q_event, lat, lon, 10.0::DOUBLE AS q_radius,
   lon - 10 / (111.32 * greatest(0.05, cos(radians(lat)))) AS qw, lat - 10 / 111.32 AS qs,
   lon + 10 / (111.32 * greatest(0.05, cos(radians(lat)))) AS qe, lat + 10 / 111.32 AS qn FROM det
  UNION ALL SELECT event_id + 1000, event_id, NULL, NULL, 10, NULL, NULL, NULL, NULL FROM det
  UNION ALL SELECT event_id + 2000, NULL, lat, lon, 10, lon - 10 / (111.32 * greatest(0.05, cos(radians(lat)))), lat - 10 / 111.32,
   lon + 10 / (111.32 * greatest(0.05, cos(radians(lat)))), lat + 10 / 111.32 FROM det),
rb AS (SELECT * EXCLUDE (w, s, e, n), CASE WHEN has_box THEN w ELSE centre_lon - radius_km / (111.32 * greatest(0.05, cos(radians(centre_lat)))) END AS w,
   CASE WHEN has_box THEN s ELSE centre_lat - radius_km / 111.32 END AS s,
   CASE WHEN has_box THEN e ELSE centre_lon + radius_km / (111.32 * greatest(0.05, cos(radians(centre_lat)))) END AS e,
   CASE WHEN has_box THEN n ELSE centre_lat + radius_km / 111.32 END AS n FROM ledger),
fd AS (SELECT q.*, l.* EXCLUDE (event_id) FROM q JOIN rb l ON CASE WHEN w IS NOT NULL AND qw IS NOT NULL THEN
   w <= qe + 1 / (111.32 * greatest(0.05, cos(radians((qs + qn + s + n) / 4)))) AND qw - 1 / (111.32 * greatest(0.05, cos(radians((qs + qn + s + n) / 4)))) <= e
   AND s <= qn + 1 / 111.32 AND qs - 1 / 111.32 <= n ELSE l.event_id = q_event END)"""


def queries_of(spark, d):
    """Every event asked for with place and name, by name alone and by place alone."""
    e = D.detections(spark, d)
    ids = F.array(F.lit("3"), F.lit("7"))
    k, none = F.col("event_id"), F.lit(None)
    rows = [(k, k, F.col("lat"), F.col("lon")), (k + 1000, k, none.cast("double"), none.cast("double")), (k + 2000, none.cast("bigint"), F.col("lat"), F.col("lon"))]
    out = None
    for i, ev, lat, lon in rows:
        part = e.select(i.alias("query_id"), ev.alias("q_event"), lat.alias("lat"), lon.alias("lon"), F.lit(10.0).alias("q_radius"), ids.alias("q_ids"))
        out = part if out is None else out.unionByName(part)
    return out


@register("ledger_recall", views=("det", "ledger"), extra=FIND, sql="""
SELECT query_id, order_id, row_number() OVER (PARTITION BY query_id ORDER BY created DESC NULLS LAST, order_id DESC)::INTEGER AS rank,
  coalesce(side, '?') || ' · ordered ' || strftime(created, '%Y-%m-%d') || ' · ' || array_to_string(scene_ids[1:2], ', ')
  || CASE WHEN len(scene_ids) > 2 THEN ' +' || (len(scene_ids) - 2) ELSE '' END || ' · order ' || order_id AS label FROM fd""")
def q_recall(spark, d):
    """The orders each query can load again, newest first, with labels."""
    return L.recall(queries_of(spark, d), D.ledger(spark, d))


@register("ledger_find", views=("det", "ledger"), extra=FIND, sql="SELECT query_id, order_id FROM fd")
def q_find(spark, d):
    """Location wins, the event id only without a footprint."""
    return L.find(queries_of(spark, d), D.ledger(spark, d)).select("query_id", "order_id")


@register("ledger_find_strict", views=("det", "ledger"), extra=FIND, sql="""
SELECT query_id, order_id FROM fd WHERE (side IS NULL OR side = 'pre') AND list_contains(scene_ids, '3') AND list_contains(scene_ids, '7') AND radius_km + 1e-9 >= q_radius""")
def q_strict(spark, d):
    """Side, every wanted scene, and a wide enough request."""
    return L.find(queries_of(spark, d), D.ledger(spark, d), side="pre", need_ids=True, need_radius=True).select("query_id", "order_id")


@register("ledger_newest_by_side", views=("det", "ledger"), extra=FIND + """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY created DESC, order_id DESC) AS rn FROM fd),
m AS (SELECT query_id, max(order_id) FILTER (side = 'pre' AND rn = 1) AS p, max(order_id) FILTER (side = 'post' AND rn = 1) AS q,
  max(order_id) FILTER (side IS NULL AND rn = 1) AS a1, max(order_id) FILTER (side IS NULL AND rn = 2) AS a2 FROM r GROUP BY 1)""", sql="""
SELECT query_id, coalesce(p, a1) AS pre_order, coalesce(q, CASE WHEN p IS NULL THEN a2 ELSE a1 END) AS post_order FROM m""")
def q_newest(spark, d):
    """Newest record per side, unknown sides fill gaps."""
    return L.newest_by_side(L.find(queries_of(spark, d), D.ledger(spark, d)))


@register("ledger_reusable_order", views=("det", "ledger"), extra=FIND, sql="""
SELECT query_id, arg_max(order_id, (created, order_id)) AS order_id, count(*) AS n_orders FROM fd
WHERE list_contains(scene_ids, '3') AND radius_km + 1e-9 >= q_radius AND (bundle = 'analytic_udm2' OR bundle IS NULL) GROUP BY 1""")
def q_reuse(spark, d):
    """An order that already holds the scenes, wide enough, right product."""
    q = queries_of(spark, d).withColumn("q_ids", F.array(F.lit("3")))
    return L.reusable(L.find(q, D.ledger(spark, d), need_ids=True, need_radius=True), "analytic_udm2")


@register("ledger_upsert_and_forget", views=("ledger",), sql="""
SELECT order_id, CASE WHEN order_id % 5 = 0 THEN 'renewed' ELSE bundle END AS bundle FROM ledger WHERE order_id % 11 <> 0
UNION ALL SELECT order_id + 1000000000, 'renewed' FROM ledger WHERE order_id % 5 = 0 AND order_id % 2 = 0""")
def q_led_upsert(spark, d):
    """Records replace rows of their key; forgotten keys go."""
    led = D.ledger(spark, d).select("order_id", "bundle")
    k = F.col("order_id")
    fresh = led.filter(k % 5 == 0).withColumn("bundle", F.lit("renewed"))
    extra = fresh.filter(k % 2 == 0).withColumn("order_id", k + 1000000000)
    up = L.upsert(led, fresh.unionByName(extra))
    gone = led.filter(k % 11 == 0)
    return L.forget(up, gone)


@register("ledger_labels", views=("ledger",), sql="""
SELECT order_id, coalesce(side, '?') || ' · ordered ' || strftime(created, '%Y-%m-%d') || ' · ' || array_to_string(scene_ids[1:2], ', ')
  || CASE WHEN len(scene_ids) > 2 THEN ' +' || (len(scene_ids) - 2) ELSE '' END || ' · order ' || order_id AS label FROM ledger""")
def q_labels(spark, d):
    """One line per order."""
    return D.ledger(spark, d).select("order_id", L.describe(F.col("side"), F.col("scene_ids"), F.col("order_id").cast("string"), F.col("created")).alias("label"))


@register("ledger_extents", views=("ledger",), sql="""
SELECT event_id, min(w) AS w, min(s) AS s, max(e) AS e, max(n) AS n, count(*) AS n_orders FROM ledger WHERE has_box GROUP BY 1""")
def q_ext(spark, d):
    """Bounds of everything delivered for an event."""
    return L.extents(D.ledger(spark, d), "event_id")


# ------------------------------------------------------------------ scoring against truth
SCORED = """cl AS (SELECT event_id, "row", col, CASE WHEN nir % 7 <> 0 THEN nir / 7000.0::DOUBLE END AS score,
   ("row" - 16) * ("row" - 16) + (col - 16) * (col - 16) <= 36 AS is_scar FROM obs_l)"""


def truth_cells(spark, d):
    return scored(spark, d).select("event_id", "row", "col", "n_cols", F.when(F.col("score") % 7 != 0, F.col("score") / 7000.0).alias("score"),
                                   D.truth_expr().alias("is_scar"), F.lit(True).alias("in_domain"))


@register("score_map_against_truth", views=("obs_l",), extra=SCORED + """,
t AS (SELECT event_id, median(coalesce(score, 0)) FILTER (is_scar) AS t50 FROM cl GROUP BY 1)""", sql="""
SELECT event_id, round(any_value(t50), 6) AS t50, round(count(*) FILTER (NOT is_scar AND coalesce(score, 0) >= t50) / (count(*) FILTER (NOT is_scar))::DOUBLE, 6) AS bg50,
  round(count(*) FILTER (is_scar AND score >= 0.6) / (count(*) FILTER (is_scar))::DOUBLE, 6) AS area,
  round(count(*) FILTER (NOT is_scar AND score >= 0.6) / (count(*) FILTER (NOT is_scar))::DOUBLE, 6) AS bg_flag,
  round(count(*) FILTER (is_scar AND score IS NULL) / (count(*) FILTER (is_scar))::DOUBLE, 6) AS scar_unscored FROM cl JOIN t USING (event_id) GROUP BY 1""")
def q_score(spark, d):
    """Background at half recall, detected and false area, unscored truth."""
    out = SC.score_map(truth_cells(spark, d), KEYS, 0.6)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("t50", "bg50", "area", "bg_flag", "scar_unscored")])


@register("first_blob_on_truth", views=("obs_l",), extra="RECURSIVE " + MASKED + """,
bs AS (SELECT lb.event_id, blob, count(*) AS n_px, max(score) AS peak, bool_or((lb."row" - 16) * (lb."row" - 16) + (lb.col - 16) * (lb.col - 16) <= 36) AS touch
  FROM lb JOIN mk USING (event_id, "row", col) GROUP BY ALL HAVING count(*) >= 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY peak DESC, n_px DESC, blob) AS rn FROM bs)""", sql="""
SELECT event_id, count(*) AS n_blobs, min(rn) FILTER (touch) AS rank FROM rk GROUP BY 1""")
def q_truthrank(spark, d):
    """Rank of the first blob that touches the truth."""
    c = scored(spark, d).withColumn("is_scar", D.truth_expr())
    return SC.truth_rank(c, KEYS, 4500, 2, tile=TILE)


VARIANTS = ["none", "asc", "desc", "merged", "fill-auto"]


def variant_maps(spark, d):
    """Score of every cell under every rule: no radar, either pass, the strongest of both, the primary with filled blind spots."""
    m = maps(spark, d)
    u = F.when(~F.col("masked"), F.col("v"))
    seen = m.groupBy("event_id").agg(F.count_if((F.col("geom") == 0) & u.isNotNull()).alias("n_asc"), F.count_if((F.col("geom") == 1) & u.isNotNull()).alias("n_desc"))
    cell = ["event_id", "row", "col"]

    # semi joins: Spark may take the cells for the smaller side and broadcast them
    def layer(df, name, score):
        return df.select(*cell, F.lit(name).alias("variant"), F.abs(score).alias("score"))
    one = [layer(m.filter(F.col("geom") == g), name, u).join(seen.filter(F.col(n) > 0).select("event_id"), "event_id", "left_semi")
           for g, name, n in ((0, "asc", "n_asc"), (1, "desc", "n_desc"))]
    two = seen.filter("n_asc > 0 AND n_desc > 0").select("event_id")
    both = [layer(M.strongest(m, "logratio", 3.0), "merged", F.col("merged")).join(two, "event_id", "left_semi"),
            layer(M.fill(m, primary(spark, d)), "fill-auto", F.col("filled")).join(two, "event_id", "left_semi")]
    grid = focal.densify(change(spark, d), D.grids(spark, d), KEYS).withColumn("event_id", F.explode(F.array(*[F.col("event_id") * 8 + g for g in range(4)])))
    out = layer(grid, "none", F.col("dbright") * 100)
    for x in one + both:
        out = out.unionByName(x)
    return out


VAR = PRIMARY + """,
mg AS (SELECT event_id, "row", col, arg_max(u, (abs(u), -geom)) FILTER (u IS NOT NULL) AS merged FROM us GROUP BY ALL),
fl AS (SELECT event_id, "row", col, arg_min(u, o) FILTER (u IS NOT NULL) AS filled
  FROM (SELECT us.*, (CASE WHEN geom = primary_geom THEN 0 ELSE 1 END, -n_seen, geom) AS o FROM us JOIN pg USING (event_id, geom) JOIN pr USING (event_id)) GROUP BY ALL),
se AS (SELECT event_id, count(u) FILTER (geom = 0) AS na, count(u) FILTER (geom = 1) AS nd FROM us GROUP BY 1),
vm AS (SELECT event_id, "row", col, 'asc' AS variant, abs(u) AS score FROM us JOIN se USING (event_id) WHERE geom = 0 AND na > 0
  UNION ALL SELECT event_id, "row", col, 'desc', abs(u) FROM us JOIN se USING (event_id) WHERE geom = 1 AND nd > 0
  UNION ALL SELECT event_id, "row", col, 'merged', abs(merged) FROM mg JOIN se USING (event_id) WHERE na > 0 AND nd > 0
  UNION ALL SELECT event_id, "row", col, 'fill-auto', abs(filled) FROM fl JOIN se USING (event_id) WHERE na > 0 AND nd > 0
  UNION ALL SELECT d.event_id, d."row", d.col, 'none', abs(dbright * 100) FROM dense_g d LEFT JOIN chg c ON c.event_id = d.event_id // 8 AND c."row" = d."row" AND c.col = d.col),
tr AS (SELECT *, ("row" - 16) * ("row" - 16) + (col - 16) * (col - 16) <= 36 AS is_scar FROM vm),
t5 AS (SELECT event_id, variant, median(coalesce(score, 0)) FILTER (is_scar) AS t50 FROM tr GROUP BY ALL),
sc AS (SELECT event_id AS event, variant, CASE WHEN any_value(t50) > 0 THEN count(*) FILTER (NOT is_scar AND coalesce(score, 0) >= t50) / (count(*) FILTER (NOT is_scar))::DOUBLE ELSE 1 END AS bg50
  FROM tr JOIN t5 USING (event_id, variant) GROUP BY ALL),
pick AS (SELECT e.event, v.variant, CASE WHEN v.variant = 'none' OR EXISTS (SELECT 1 FROM sc s WHERE s.event = e.event AND s.variant = v.variant) THEN v.variant
   WHEN EXISTS (SELECT 1 FROM sc s WHERE s.event = e.event AND s.variant = 'desc') THEN 'desc'
   WHEN EXISTS (SELECT 1 FROM sc s WHERE s.event = e.event AND s.variant = 'asc') THEN 'asc' END AS used
  FROM (SELECT DISTINCT event FROM sc) e CROSS JOIN (SELECT unnest(['none', 'asc', 'desc', 'merged', 'fill-auto']) AS variant) v)"""


def variant_scores(spark, d):
    truth = focal.densify(D.elevation(spark, d), D.layer_grids(spark, d, range(4)), KEYS).select("event_id", "row", "col", D.truth_expr().alias("is_scar"))
    return SC.score_variants(variant_maps(spark, d), truth, KEYS, 3.0).withColumnRenamed("event_id", "event")


@register("rule_variants_compared", views=("dense_g", "obs"), extra=COMP + ",\n" + VAR, sql="""
SELECT p.variant, round(max(bg50), 6) AS worst, round(avg(bg50), 6) AS mean, count(*) AS n_events
FROM pick p JOIN sc ON sc.event = p.event AND sc.variant = p.used GROUP BY 1""")
def q_variants(spark, d):
    """Worst and mean background at half recall per rule, over the real maps of every event."""
    return SC.compare_variants(variant_scores(spark, d), VARIANTS).select("variant", F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"), "n_events")


@register("rule_variant_table", views=("dense_g", "obs"), extra=COMP + ",\n" + VAR, sql="""
SELECT p.event, """ + ", ".join(f"round(max(bg50) FILTER (p.variant = '{v}'), 6) AS \"{v}\"" for v in VARIANTS) + """
FROM pick p LEFT JOIN sc ON sc.event = p.event AND sc.variant = p.used GROUP BY 1""")
def q_vtable(spark, d):
    """Event by variant, one-pass events take that pass's score."""
    return SC.variant_table(variant_scores(spark, d), VARIANTS).withColumns({v: F.round(F.col(f"`{v}`"), 6) for v in VARIANTS})


@register("blind_shares", views=("dense",), sql="""
SELECT event_id, CAST(geom AS INTEGER) AS geom, round(avg(CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END), 6) AS blind, round(any_value(bb), 6) AS blind_both FROM (
 SELECT *, avg(CASE WHEN both_ THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY event_id) AS bb FROM (
  SELECT event_id, "row", col, geom, ("row" * 3 + col * 5 + geom * 7) % 11 < 4 AS m, ("row" * 3 + col * 5) % 11 < 4 AND ("row" * 3 + col * 5 + 7) % 11 < 4 AS both_
  FROM dense, range(2) t(geom))) GROUP BY ALL""")
def q_blind(spark, d):
    """Share of ground each geometry, and both, cannot see."""
    lay = D.grids(spark, d).withColumn("geom", F.explode(F.array(F.lit(0), F.lit(1))))
    empty = spark.createDataFrame([], "event_id long, geom int, row int, col int")
    m = focal.densify(empty, lay, ["event_id", "geom"]).withColumn("masked", (F.col("row") * 3 + F.col("col") * 5 + F.col("geom") * 7) % 11 < 4)
    return SC.blind_share(m, KEYS).withColumns({c: F.round(c, 6) for c in ("blind", "blind_both")})
