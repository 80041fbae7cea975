"""Ingest, elevation candidates, manifest, gazetteer, text, tone and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import ALL, SQL, register
from registry.catalog import PAIRS
from registry.detectors import KEYS
from siltmark.functions import geo, radar, timing
from siltmark.functions import text as X
from siltmark.functions import tone as TN
from siltmark.operators import cells as C
from siltmark.operators import gazetteer, manifest
from siltmark.operators import ranking as R
from siltmark.operators import search as S
from siltmark.session import shared_folder
from siltmark.sources import dem_catalog as DC
from siltmark.sources import driver_tables as D
from siltmark.sources import granules as G
from siltmark.sources import sinks
from siltmark.sources import strips as ST

# ------------------------------------------------------------------ strip catalogue


def features(spark, d):
    """One GeoJSON feature per order, as the catalogue would send it."""
    o, k = D.table(spark, d, "orders"), F.col("o_orderkey")
    src = F.element_at(F.array(*[F.lit(s) for s in ("WV03_VNIR", "WV02", "ge01_PAN", "UMBRA", "SKYSAT")]), (k % 5 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    props = F.struct(
        k.cast("string").alias("featureId"), F.concat(F.lit("cat"), k.cast("string")).alias("legacyIdentifier"),
        F.concat(day, F.when(k % 3 == 0, "T00:18:47.500Z").when(k % 3 == 1, "T07:36:38Z").otherwise("T21:00:00+02:00")).alias("acquisitionDate"),
        F.concat(day, F.lit("T12:00:00Z")).alias("createdDate"), src.alias("source"),
        F.when(k % 11 == 0, "THIRD_PARTY").when(k % 13 == 0, "RDOG_BASE").otherwise("DAILY_TAKE").alias("productName"),
        (k % 17 == 0).alias("isThirdParty"), ((k * 7) % 50).cast("double").alias("offNadirAngle"),
        F.when(k % 2 == 0, "LV2A").otherwise("LV3D").alias("processingLevel"), ((k % 40) / 10.0).alias("ce90Accuracy"),
        F.concat(day, F.lit("T00:00:00Z")).alias("earliestAcquisitionTime"),
        F.concat(day, F.when(k % 7 == 0, "T00:10:00Z").otherwise("T00:00:30Z")).alias("latestAcquisitionTime"))
    ring = F.array(*[F.array((k % 100).cast("double") + a, (k % 60).cast("double") + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    poly = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return o.select(F.to_json(F.struct(props.alias("properties"), poly.alias("geometry"))).alias("feature"))


def typed(spark, d):
    return ST.typed(ST.require_fields(ST.parse_features(features(spark, d))))


@register("strip_json_to_rows", sql="""
SELECT o_orderkey::VARCHAR AS feature_id, ['WV03', 'WV02', 'GE01', 'UMBRA', 'SKYSAT'][o_orderkey % 5 + 1] AS sensor,
  CAST(o_orderdate AS DATE) + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '18 minutes 47.5 seconds' WHEN 1 THEN INTERVAL '7 hours 36 minutes 38 seconds' ELSE INTERVAL '19 hours' END AS acq,
  o_orderkey % 17 = 0 OR o_orderkey % 11 = 0 AS third_party,
  CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 11 = 0 THEN ['WV03', 'WV02', 'GE01', 'Umbra', 'Planet Labs (SkySat)'][o_orderkey % 5 + 1] ELSE 'Vantor' END AS vendor,
  CASE WHEN o_orderkey % 2 = 1 AND (o_orderkey % 40) / 10.0 >= 0.5 THEN (o_orderkey % 40) / 10.0::DOUBLE END AS ce90,
  o_orderkey % 7 = 0 OR (o_orderkey % 13 = 0 AND o_orderkey % 11 <> 0) AS multi_date, 5 AS n_points FROM orders""")
def q_json(spark, d):
    """Catalogue JSON to typed strips."""
    return typed(spark, d).select("feature_id", "sensor", "acq", "third_party", "vendor", "ce90", "multi_date",
                                  F.size(F.get("rings", F.lit(0))).alias("n_points"))


@register("strip_required_fields", sql="""
SELECT count(*) FILTER (o_orderkey % 6 = 0) AS no_id, count(*) FILTER (o_orderkey % 4 = 0) AS no_date, count(*) AS n FROM orders""")
def q_required(spark, d):
    """Records that would fail the batch."""
    k = F.col("o_orderkey")
    p = D.table(spark, d, "orders").select(F.struct(F.when(k % 6 != 0, k.cast("string")).otherwise(F.lit(" ")).alias("featureId"),
                                                    F.when(k % 4 != 0, F.lit("2024-05-01")).otherwise("soon").alias("acquisitionDate")).alias("p"))
    return ST.missing_fields(p)


@register("time_text_parsing", sql="""
SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN d + INTERVAL '18 minutes 47.5 seconds' WHEN 1 THEN d + INTERVAL '7 hours 36 minutes 38 seconds'
  WHEN 2 THEN d + INTERVAL '19 hours' WHEN 3 THEN d + INTERVAL '5 hours 6 minutes 7 seconds' WHEN 4 THEN d::TIMESTAMP END AS TIMESTAMP) AS ts FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def q_time(spark, d):
    """Z, offset, fraction, no zone, date alone; else NULL."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    t = (F.when(k % 6 == 0, F.concat(day, F.lit("T00:18:47.500Z"))).when(k % 6 == 1, F.concat(day, F.lit("T07:36:38Z")))
         .when(k % 6 == 2, F.concat(day, F.lit("T21:00:00+02:00"))).when(k % 6 == 3, F.concat(day, F.lit("T05:06:07")))
         .when(k % 6 == 4, day).otherwise("n/a"))
    return D.table(spark, d, "orders").select("o_orderkey", timing.parse_time(t).cast("timestamp_ntz").alias("ts"))


@register("ingest_lag_hours", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 3600000000.0::DOUBLE, 6) AS lag_h
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_lag(spark, d):
    """Hours from acquisition to ingest."""
    li, o = D.table(spark, d, "lineitem"), D.table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(timing.lag_hours(F.col("l_shipdate"), F.col("o_orderdate")), 6).alias("lag_h"))


# ------------------------------------------------------------------ granules
@register("granule_name_fields", sql="""
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id % 900 END::INTEGER AS cycle, CASE WHEN event_id % 9 <> 0 THEN user_id END::INTEGER AS track,
  CASE WHEN event_id % 9 <> 0 THEN CASE event_id % 2 WHEN 0 THEN 'ascending' ELSE 'descending' END END AS orbit_state,
  CASE WHEN event_id % 9 <> 0 THEN (event_id % 180) END::INTEGER AS frame, CASE WHEN event_id % 9 <> 0 THEN CASE event_id % 2 WHEN 0 THEN '4005' ELSE '2005' END END AS mode,
  CASE WHEN event_id % 9 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'HH,HV' WHEN 1 THEN 'HH' ELSE 'HH,HV,VH,VV' END END AS pols,
  CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) END AS start FROM events""")
def q_name(spark, d):
    """Granule name decode."""
    i = F.col("event_id")
    ts = F.date_format("ts", "yyyyMMdd'T'HHmmss")
    name = F.when(i % 9 != 0, F.format_string("NISAR_L2_PR_GCOV_%03d_%03d_%s_%03d_%s_%s_A_%s_%s_P05000_N_F_J_001", i % 900, F.col("user_id"),
                  F.when(i % 2 == 0, "A").otherwise("D"), i % 180, F.when(i % 2 == 0, "4005").otherwise("2005"),
                  F.when(i % 3 == 0, "DHDH").when(i % 3 == 1, "SHSH").otherwise("QPDH"), ts, ts)).otherwise("something_else.h5")
    g = D.table(spark, d, "events").select("event_id", G.decode_name(name).alias("g"))
    return g.select("event_id", "g.cycle", "g.track", "g.orbit_state", "g.frame", "g.mode", F.array_join("g.polarizations", ",").alias("pols"), "g.start")


@register("granule_footprints", views=("scenes",), sql="""
SELECT scene_id, 5 AS n_points, w, s, e, n FROM scenes""")
def q_foot(spark, d):
    """Polygons closed, else bounding rectangles; bounds of the result."""
    s, i = D.scenes(spark, d), F.col("scene_id")
    open_ = geo.open_ring(geo.box_ring(F.col("bbox")))
    polys = F.when(i % 3 == 0, F.array(open_)).otherwise(F.array(F.slice(open_, 1, 2)))
    r = s.select("scene_id", G.footprint(polys, F.array("bbox")).alias("rings"))
    return r.select("scene_id", F.size(F.get("rings", F.lit(0))).alias("n_points"), G.rings_box(F.col("rings")).alias("b")).select(
        "scene_id", "n_points", "b.w", "b.s", "b.e", "b.n")


@register("granule_assets_by_suffix", sql="""
SELECT page_id, 'https://a/' || page_id || '.h5' AS h5, CASE WHEN page_id % 2 = 0 THEN 'https://a/' || page_id || '_LATLON_thumbnail.png' ELSE 'https://a/' || page_id || '_NATIVE.png' END AS thumb,
  'https://a/' || page_id || '_NATIVE.png' AS browse, 'https://a/' || page_id || '_VV.tif' AS vv, CASE WHEN page_id % 3 = 0 THEN 'https://a/' || page_id || '_mask.tif' END AS mask FROM pages""")
def q_assets(spark, d):
    """Links told apart by suffix, HTTPS only."""
    p = F.col("page_id").cast("string")
    u = lambda s: F.concat(F.lit("https://a/"), p, F.lit(s))
    urls = F.array_compact(F.array(F.concat(F.lit("s3://a/"), p, F.lit(".h5")), u(".h5"), F.when(F.col("page_id") % 2 == 0, u("_LATLON_thumbnail.png")),
                                   u("_NATIVE.png"), u("_VV.tif"), F.when(F.col("page_id") % 3 == 0, u("_mask.tif"))))
    t = D.table(spark, d, "pages").select("page_id", G.granule_assets(urls).alias("g"), G.burst_assets(urls).alias("b"))
    return t.select("page_id", "g.h5", "g.thumb", "g.browse", "b.vv", "b.mask")


@register("granules_across_collections", views=("scenes",), sql="""
SELECT collection, count(*) AS n FROM (SELECT CASE scene_id % 4 WHEN 0 THEN 'NISAR_L2_GCOV_BETA_V1' WHEN 1 THEN 'OTHER_V1' ELSE 'NISAR_L2_GCOV_PROVISIONAL_V1' END AS collection
  FROM scenes WHERE source = 'NISAR') WHERE collection <> 'OTHER_V1' GROUP BY 1""")
def q_colls(spark, d):
    """Every collection of the product, unnamed ones by the fallback."""
    i = F.col("scene_id")
    g = D.scenes(spark, d).filter(F.col("source") == "NISAR").withColumn(
        "collection", F.when(i % 4 == 0, "NISAR_L2_GCOV_BETA_V1").when(i % 4 == 1, "OTHER_V1").when(i % 4 == 2, "").otherwise(F.lit(None)))
    return G.across_collections(g).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ elevation candidates
@register("dem_strip_collections", views=("det",), sql="""
SELECT c_custkey, CASE WHEN c_custkey % 180 - 90 >= 0 THEN 'arcticdem-strips-s2s041-2m' ELSE 'rema-strips-s2s041-2m' END || ',earthdem-strips-s2s041-2m' AS collections FROM customer""")
def q_hemi(spark, d):
    """Strip collections by hemisphere."""
    return D.table(spark, d, "customer").select("c_custkey", F.array_join(DC.strip_collections(F.col("c_custkey") % 180 - 90), ",").alias("collections"))


@register("dem_tile_mosaics", sql="""
SELECT event_id, dem_source, dem_source || '-' || count(DISTINCT p_partkey) || 'tile' AS id,
  string_agg(DISTINCT 'https://t/' || p_partkey, ',' ORDER BY 'https://t/' || p_partkey) AS urls, resolution_m
FROM (SELECT p_partkey // 8 AS event_id, p_partkey, CASE WHEN p_size < 20 THEN 10 ELSE 30 END AS resolution_m, '3dep-' || CASE WHEN p_size < 20 THEN 10 ELSE 30 END AS dem_source FROM part)
GROUP BY event_id, dem_source, resolution_m""")
def q_tiles(spark, d):
    """All tiles of one product under an AOI as one candidate."""
    res = DC.seamless_resolution(F.col("p_size").cast("double"))
    t = D.table(spark, d, "part").select(
        F.expr("p_partkey div 8").alias("event_id"), F.concat(F.lit("3dep-"), res.cast("string")).alias("dem_source"), res.alias("resolution_m"),
        F.concat(F.lit("https://t/"), F.col("p_partkey").cast("string"), F.lit("?sig=1")).alias("href"), F.lit(None).cast("timestamp_ntz").alias("acq"))
    return DC.tile_mosaics(t).select("event_id", "dem_source", "id", F.array_join("dem_urls", ",").alias("urls"), "resolution_m")


@register("dem_national_model", sql="""
SELECT p_partkey AS event_id, 'mrdem-30' AS dem_source, false AS is_dsm FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'mrdem-30-dsm', true FROM part WHERE p_partkey % 4 <> 0""")
def q_national(spark, d):
    """Bare-earth and surface rows of one item, missing assets left out."""
    k = F.col("p_partkey")
    p = D.table(spark, d, "part").select(k.alias("event_id"), F.when(k % 3 != 0, "a").alias("dtm"), F.when(k % 4 != 0, "b").alias("dsm"))
    return DC.national_model(p).select("event_id", "dem_source", "is_dsm")


TILES = """c AS (SELECT c_custkey AS event_id, -60.0::DOUBLE + c_custkey % 120 + 0.98::DOUBLE AS lat, -170.0::DOUBLE + (c_custkey * 7) % 340 + 0.02::DOUBLE AS lon FROM customer),
b AS (SELECT event_id, CAST(floor(lat - 5 / 111.32) AS BIGINT) AS y0, CAST(floor(lat + 5 / 111.32) AS BIGINT) AS y1,
  CAST(floor(lon - 5 / (111.32 * cos(radians(lat)))) AS BIGINT) AS x0, CAST(floor(lon + 5 / (111.32 * cos(radians(lat)))) AS BIGINT) AS x1 FROM c),
t AS (SELECT event_id, unnest(range(y0, y1 + 1)) AS la, x0, x1 FROM b), u AS (SELECT event_id, la, unnest(range(x0, x1 + 1)) AS lo FROM t)"""


@register("dem_degree_tiles", extra=TILES, sql="""
SELECT event_id, 'Copernicus_DSM_COG_10_' || CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || printf('%02d', abs(la)) || '_00_' || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || printf('%03d', abs(lo)) || '_00_DEM' AS tile
FROM u WHERE lo % 3 <> 0""")
def q_degree(spark, d):
    """1-degree tiles under each box that the archive lists."""
    k = F.col("c_custkey")
    ev = D.table(spark, d, "customer").select(k.alias("event_id"), (F.lit(-60.0) + k % 120 + 0.98).alias("lat"),
                                              (F.lit(-170.0) + (k * 7) % 340 + 0.02).alias("lon"), F.lit(5.0).alias("radius_km"))
    t = DC.degree_tiles(ev)
    return DC.existing_tiles(t, t.filter(F.col("lo") % 3 != 0).select("tile").distinct()).select("event_id", "tile")


DEMC = """aoi AS (SELECT *, lon - radius_km / (111.32 * cos(radians(lat))) AS aw, lat - radius_km / 111.32 AS as_,
    lon + radius_km / (111.32 * cos(radians(lat))) AS ae, lat + radius_km / 111.32 AS an FROM det),
cd AS (SELECT a.event_id, s.scene_id, CASE scene_id % 5 WHEN 0 THEN 'arcticdem' WHEN 1 THEN '3dep-10m' WHEN 2 THEN 'mrdem-30' WHEN 3 THEN 'cop-glo30' ELSE 'other' END AS dem_source,
    w <= lon AND lon <= e AND s <= lat AND lat <= n AS covers, acq, (1 + scene_id % 30)::DOUBLE AS resolution_m, w, s, e, n, aw, as_, ae, an
  FROM aoi a JOIN (SELECT * EXCLUDE (source) FROM scenes WHERE source = 'NISAR') s ON s.w <= a.ae AND a.aw <= s.e AND s.s <= a.an AND a.as_ <= s.n),
rk AS (SELECT *, CASE dem_source WHEN 'arcticdem' THEN 0 WHEN '3dep-10m' THEN 1 WHEN 'mrdem-30' THEN 2 WHEN 'cop-glo30' THEN 3 ELSE 99 END AS tier FROM cd),
so AS (SELECT *, CASE WHEN tier = 0 THEN -CAST(strftime(acq, '%Y%m%d') AS INTEGER) ELSE resolution_m END AS within FROM rk)"""


def dem_candidates(spark, d):
    i = F.col("scene_id")
    src = F.when(i % 5 == 0, "arcticdem").when(i % 5 == 1, "3dep-10m").when(i % 5 == 2, "mrdem-30").when(i % 5 == 3, "cop-glo30").otherwise("other")
    sc = D.scenes(spark, d).filter(F.col("source") == "NISAR").withColumn("dem_source", src)
    p = S.overlapping_ever(D.detections(spark, d), sc)
    return p.select("event_id", "scene_id", "dem_source", S.covers_point(p).alias("covers"), "acq", (1 + i % 30).cast("double").alias("resolution_m"), "bbox")


@register("dem_candidate_order", views=("det", "scenes"), extra=DEMC, sql="""
SELECT event_id, scene_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier, NOT covers, within, scene_id) AS rn FROM so)""")
def q_demrank(spark, d):
    """Strips first, then fallbacks in order; covering the point, newest or finest."""
    c = dem_candidates(spark, d)
    key = DC.rank_key(F.col("dem_source"), F.col("covers"), F.col("acq"), F.col("resolution_m"))
    return R.ranked_per_side(c.withColumn("k", key), ("k", "scene_id"), keys=("event_id",)).select("event_id", "scene_id", F.col("rank"))


COVER = """,
bx AS (SELECT DISTINCT event_id, greatest(w, aw) AS x0, least(e, ae) AS x1, greatest(s, as_) AS y0, least(n, an) AS y1, (ae - aw) * (an - as_) AS whole FROM so
  WHERE tier = 0 AND greatest(w, aw) < least(e, ae) AND greatest(s, as_) < least(n, an)),
xs AS (SELECT event_id, x0 AS lo FROM bx UNION SELECT event_id, x1 FROM bx),
sl AS (SELECT event_id, lo, lead(lo) OVER (PARTITION BY event_id ORDER BY lo) AS hi FROM xs),
iv AS (SELECT event_id, lo, hi, y0, y1, whole, max(y1) OVER (PARTITION BY event_id, lo ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM sl JOIN bx USING (event_id) WHERE x0 <= lo AND hi <= x1),
cv AS (SELECT event_id, sum((hi - lo) * greatest(0, y1 - greatest(y0, coalesce(above, y0))) / whole) AS cover FROM iv GROUP BY 1)"""


@register("dem_strip_cover", views=("det", "scenes"), extra=DEMC + COVER, sql="""
SELECT event_id, round(coalesce(cover, 0), 6) AS cover FROM det LEFT JOIN cv USING (event_id)""")
def q_demcover(spark, d):
    """Exact share of each search box that strips cover together."""
    c = dem_candidates(spark, d).filter(DC.tier(F.col("dem_source")) == 0)
    return DC.strip_cover(D.detections(spark, d), c).select("event_id", F.round("cover", 6).alias("cover"))


SEARCH = PAIRS + """,
s AS (SELECT *, scene_id::VARCHAR AS id, CASE WHEN day < CAST(origin AS DATE) THEN 'pre' WHEN day > CAST(origin AS DATE) THEN 'post' END AS side,
  day BETWEEN CAST(origin - INTERVAL 9 DAY AS DATE) AND CAST(origin - INTERVAL 1 DAY AS DATE)
  OR day BETWEEN CAST(origin + INTERVAL 1 DAY AS DATE) AND CAST(origin + INTERVAL 4 DAY AS DATE) AS inside FROM allp WHERE source = 'NISAR'),
st AS (SELECT * FROM s WHERE scene_id % 5 = 0),
ti AS (SELECT event_id, src, count(DISTINCT scene_id) AS n FROM (SELECT *, CASE scene_id % 10 WHEN 1 THEN '3dep-10m' WHEN 6 THEN '3dep-dsm' WHEN 3 THEN 'cop-glo30' END AS src FROM s) WHERE src IS NOT NULL GROUP BY ALL),
na AS (SELECT event_id, 'mrdem-30' AS src, 'dtm' || id AS id FROM s WHERE scene_id % 5 = 2 AND scene_id % 3 <> 0
  UNION ALL SELECT event_id, 'mrdem-30-dsm', 'dsm' || id FROM s WHERE scene_id % 5 = 2 AND scene_id % 4 <> 0),
ends AS (SELECT event_id, unnest(['pre', 'post']) AS side FROM det),
near AS (SELECT event_id, side, bool_or(inside) AS found, arg_min({'id': id, 'days': abs(date_diff('day', day, CAST(origin AS DATE)))}, (gap, id)) AS hit FROM st WHERE side IS NOT NULL GROUP BY ALL)"""


@register("dem_search", views=("det", "scenes"), extra=SEARCH, sql="""
SELECT event_id, 'strip' AS kind, side, 'arcticdem' AS dem_source, id, round(gap, 6) AS gap_days, NULL::VARCHAR AS code, NULL::BIGINT AS widen_to_days FROM st WHERE inside
  QUALIFY row_number() OVER (PARTITION BY event_id, side ORDER BY gap, id) <= 16
UNION ALL SELECT event_id, 'tier', 'pre', src, src || '-' || n || 'tile', NULL, NULL, NULL FROM ti
UNION ALL SELECT event_id, 'tier', 'pre', src, id, NULL, NULL, NULL FROM na
UNION ALL SELECT event_id, 'note', side, NULL, hit.id, NULL, 'widen', hit.days FROM ends LEFT JOIN near USING (event_id, side) WHERE NOT coalesce(found, false)
UNION ALL SELECT event_id, 'note', NULL, NULL, NULL, NULL, 'no_lidar', NULL FROM det WHERE event_id NOT IN (SELECT event_id FROM ti WHERE src = '3dep-dsm')
UNION ALL SELECT DISTINCT event_id, 'note', NULL, NULL, NULL, NULL, 'national', NULL FROM na
UNION ALL SELECT event_id, 'note', NULL, NULL, NULL, NULL, 'world', NULL FROM ti WHERE src = 'cop-glo30'""")
def q_demsearch(spark, d):
    """Strips of both sides, fallback tiers and notes of every event in one result."""
    ev, i = D.detections(spark, d), F.col("scene_id")
    sc = D.scenes(spark, d).filter(F.col("source") == "NISAR")
    ever = S.overlapping_ever(ev, sc)
    src = F.when(i % 10 == 1, "3dep-10m").when(i % 10 == 6, "3dep-dsm").when(i % 10 == 3, "cop-glo30")
    tiles = ever.select("event_id", src.alias("dem_source"), i.cast("string").alias("href"), "acq", F.lit(10.0).alias("resolution_m")).filter("dem_source IS NOT NULL")
    items = ever.filter(i % 5 == 2).select("event_id", F.when(i % 3 != 0, F.concat(F.lit("dtm"), i.cast("string"))).alias("dtm"),
                                           F.when(i % 4 != 0, F.concat(F.lit("dsm"), i.cast("string"))).alias("dsm"))
    strips = sc.filter(i % 5 == 0).withColumn("dem_source", F.lit("arcticdem"))
    return DC.full_search(ev, strips, tiles, items, pre_days=9, post_days=4).withColumn("gap_days", F.round("gap_days", 6))


@register("dem_default_choice", views=("det", "scenes"), extra=DEMC + COVER + """,
g AS (SELECT event_id, arg_min(scene_id, (tier, NOT covers, within, scene_id::VARCHAR)) FILTER (tier = 0) AS st, arg_min(scene_id, (tier, NOT covers, within, scene_id::VARCHAR)) FILTER (tier BETWEEN 1 AND 98) AS ot,
  coalesce(bool_or(tier = 0 AND covers), false) AS pt FROM so GROUP BY 1)""", sql="""
SELECT event_id, (CASE WHEN pt OR coalesce(cover, 0) >= 0.5 THEN coalesce(st, ot) ELSE coalesce(ot, st) END)::VARCHAR AS id FROM g LEFT JOIN cv USING (event_id)""")
def q_demdefault(spark, d):
    """Strip when it covers the point or half the box, else the best fallback."""
    c = dem_candidates(spark, d).withColumn("id", F.col("scene_id").cast("string"))
    cover = DC.strip_cover(D.detections(spark, d), c.filter(DC.tier(F.col("dem_source")) == 0))
    return DC.default_choice(c, cover)


# ------------------------------------------------------------------ manifest, exports, names
def index(spark, d):
    i = F.col("scene_id")
    return D.scenes(spark, d).select(
        (i % 25).alias("event_id"), i.cast("string").alias("scene_id"), "acq", (i % 30).cast("string").alias("gap_days"), "source", "orbit_state", "relative_orbit",
        F.when(i % 2 == 0, "pre").otherwise("post").alias("side"), F.when(i % 3 != 0, (i % 90).cast("double")).alias("aoi_cloud_pct"), "cloud_pct", (i % 97).cast("double").alias("aoi_snow_pct"), (i % 101).cast("double").alias("coverage"))


IDX = """ix AS (SELECT scene_id % 25 AS event_id, scene_id::VARCHAR AS scene_id, acq, (scene_id % 30)::VARCHAR AS gap_days, source, orbit_state, relative_orbit,
  CASE WHEN scene_id % 2 = 0 THEN 'pre' ELSE 'post' END AS side, CASE WHEN scene_id % 3 <> 0 THEN scene_id % 90 END AS aoi, cloud_pct, scene_id % 97 AS snow, (scene_id % 101)::DOUBLE AS coverage, scene_id AS i FROM scenes)"""
BLANK = {c: "''" for c in manifest.COLUMNS}


def manifest_sql(**cols):
    out = {**BLANK, **cols}
    return "SELECT " + ", ".join(f'{v} AS "{k}"' for k, v in out.items())


CELL = "CASE WHEN aoi IS NOT NULL THEN CASE WHEN snow >= 50 THEN '❄ ' ELSE '' END || aoi || '%' WHEN cloud_pct IS NOT NULL THEN '~' || cloud_pct::BIGINT || '%' ELSE '' END"


@register("manifest_optical_rows", views=("scenes",), extra=IDX + """,
r AS (SELECT p_partkey % 25 AS event_id, CASE WHEN p_partkey % 2 = 0 THEN 'pre' ELSE 'post' END AS side, 'f' || p_partkey || '.tif' AS file,
   unnest([((p_partkey % 25) + 25 * (p_partkey % 300))::VARCHAR, 'gone' || p_partkey]) AS scene_id FROM part),
j AS (SELECT r.*, acq, gap_days, source, aoi, cloud_pct, snow, coverage FROM r LEFT JOIN ix USING (event_id, scene_id))""",
          sql=manifest_sql(**{"Event": "event_id::VARCHAR", "Tab": "'Sentinel-2 / Landsat'", "Side": "side", "File": "file", "Scene ID": "scene_id",
                              "Date (UTC)": "coalesce(strftime(acq, '%Y-%m-%d %H:%M'), CASE WHEN scene_id LIKE 'gone%' THEN '2024-02-02' ELSE '2024-01-01' END)", "Gap (d)": "coalesce(gap_days, '')",
                              "Cloud": f"CASE WHEN acq IS NULL THEN '' ELSE {CELL} END", "Coverage (% AOI)": "coalesce(coverage::BIGINT::VARCHAR, '')",
                              "Source": "coalesce(source, 'Sentinel-2')"}) + " FROM j")
def q_mopt(spark, d):
    """Composited scenes joined to the search index, else from the run."""
    k = F.col("p_partkey")
    runs = D.table(spark, d, "part").select(
        (k % 25).alias("event_id"), F.lit("s2").alias("sensor"), F.when(k % 2 == 0, "pre").otherwise("post").alias("side"),
        F.concat(F.lit("f"), k.cast("string"), F.lit(".tif")).alias("file"), F.array(F.lit("2024-01-01"), F.lit("2024-02-02")).alias("dates"),
        F.array(((k % 25) + 25 * (k % 300)).cast("string"), F.concat(F.lit("gone"), k.cast("string"))).alias("scene_ids"))
    return manifest.optical_rows(runs, index(spark, d).drop("side"))


@register("manifest_radar_rows", views=("det", "scenes"), extra=IDX + """,
f AS (SELECT scene_id % 25 AS event_id, CASE source WHEN 'NISAR' THEN 'NISAR' ELSE 'S1' END AS tag, CASE WHEN scene_id % 9 = 0 THEN 'undated' WHEN scene_id % 7 = 0 THEN '2024-01-01' ELSE strftime(acq, '%Y-%m-%d') END AS day,
   substr(orbit_state, 1, 4) AS orbit, relative_orbit::VARCHAR AS track, scene_id FROM scenes WHERE source IN ('NISAR', 'Sentinel-1')),
h AS (SELECT event_id, CASE source WHEN 'NISAR' THEN 'NISAR' ELSE 'S1' END AS tag, strftime(acq, '%Y-%m-%d') AS day, substr(orbit_state, 1, 4) AS orbit, relative_orbit::VARCHAR AS track,
   arg_max({'id': scene_id, 'acq': acq, 'gap': gap_days, 'src': source, 'side': side, 'cov': coverage}, (coverage, scene_id)) AS h FROM ix WHERE source IN ('NISAR', 'Sentinel-1') GROUP BY ALL),
j AS (SELECT f.*, h, origin FROM f LEFT JOIN h USING (event_id, tag, day, orbit, track) LEFT JOIN det USING (event_id))""",
          sql=manifest_sql(**{"Event": "event_id::VARCHAR", "Tab": "'SAR (Sentinel-1)'",
                              "Side": "coalesce(h.side, CASE WHEN day <> 'undated' AND day < strftime(origin, '%Y-%m-%d') THEN 'pre' WHEN day <> 'undated' AND day > strftime(origin, '%Y-%m-%d') THEN 'post' ELSE '' END)",
                              "Date (UTC)": "coalesce(strftime(h.acq, '%Y-%m-%d %H:%M'), CASE WHEN day <> 'undated' THEN day ELSE '' END)", "Gap (d)": "coalesce(h.gap, '')",
                              "Coverage (% AOI)": "CASE WHEN h IS NULL THEN '' WHEN h.cov > 0 THEN h.cov::BIGINT::VARCHAR ELSE '—' END",
                              "Source": "coalesce(h.src, CASE tag WHEN 'NISAR' THEN 'NISAR' ELSE 'Sentinel-1' END)", "Radar": "CASE tag WHEN 'NISAR' THEN 'NISAR L' ELSE 'S1 C' END",
                              "Orbit": "orbit", "Track": "track", "Scene ID": "coalesce(h.id, '')",
                              "File": "tag || '_' || day || '_' || orbit || '_t' || track || '_VV_' || scene_id || 'm.tif'"}) + " FROM j")
def q_mradar(spark, d):
    """Radar files matched on radar, date, orbit and track, best coverage wins."""
    i = F.col("scene_id")
    day = F.when(i % 9 == 0, "undated").when(i % 7 == 0, "2024-01-01").otherwise(F.date_format("acq", "yyyy-MM-dd"))
    f = D.scenes(spark, d).filter(F.col("source").isin("NISAR", "Sentinel-1")).select((i % 25).alias("event_id"), F.concat_ws(
        "_", F.when(F.col("source") == "NISAR", "NISAR").otherwise("S1"), day, F.substring("orbit_state", 1, 4), F.concat(F.lit("t"), F.col("relative_orbit").cast("string")),
        F.lit("VV"), F.concat(i.cast("string"), F.lit("m.tif"))).alias("file"))
    return manifest.radar_rows(f, index(spark, d), D.detections(spark, d))


@register("manifest_product_rows_in_viewer", views=("scenes",), extra=IDX + """,
f AS (SELECT DISTINCT p_partkey % 25 AS event_id, CASE WHEN p_partkey % 2 = 0 THEN 'pre' ELSE 'post' END AS side,
   CASE WHEN p_partkey % 3 = 0 THEN '20240105_' || printf('%06d', p_partkey) || '_10_2527' ELSE ((p_partkey % 25) + 25 * (p_partkey % 300))::VARCHAR END AS scene_id FROM part),
g AS (SELECT f.*, event_id || '_' || side || '_' || scene_id AS stem FROM f),
j AS (SELECT g.*, stem || '_planet_hdr.tif; ' || stem || '_planet_natural.tif' AS file, acq, gap_days, source, aoi, cloud_pct, coverage FROM g LEFT JOIN ix ON ix.event_id::VARCHAR = g.event_id::VARCHAR AND ix.scene_id = g.scene_id)""",
          sql=manifest_sql(**{"Event": "event_id::VARCHAR", "Tab": "'PlanetScope'", "Side": "side", "File": "file", "Scene ID": "scene_id",
                              "Date (UTC)": "coalesce(strftime(acq, '%Y-%m-%d %H:%M'), CASE WHEN scene_id LIKE '20240105_%' THEN '2024-01-05 ' || substr(scene_id, 10, 2) || ':' || substr(scene_id, 12, 2) ELSE '' END)",
                              "Gap (d)": "coalesce(gap_days, '')", "Cloud": "CASE WHEN acq IS NULL THEN '' WHEN aoi IS NOT NULL THEN aoi || '%' WHEN cloud_pct IS NOT NULL THEN '~' || cloud_pct::BIGINT || '%' ELSE '' END",
                              "Coverage (% AOI)": "coalesce(coverage::BIGINT::VARCHAR, '')", "Source": "coalesce(source, 'PlanetScope')",
                              "In 3D viewer": "CASE WHEN side = 'pre' THEN 'Before' ELSE 'Before + After' END"}) + " FROM j")
def q_mprod(spark, d):
    """Product files by scene (re-tones merged) and the viewer flags."""
    k = F.col("p_partkey")
    sid = F.when(k % 3 == 0, F.format_string("20240105_%06d_10_2527", k)).otherwise(((k % 25) + 25 * (k % 300)).cast("string"))
    stem = F.concat_ws("_", (k % 25).cast("string"), F.when(k % 2 == 0, "pre").otherwise("post"), sid)
    files = D.table(spark, d, "part").select(F.explode(F.array(F.concat(stem, F.lit("_planet_hdr.tif")), F.concat(stem, F.lit("_planet_natural.tif")))).alias("file"))
    rows = manifest.product_rows(files, index(spark, d).drop("side").withColumn("event_id", F.col("event_id").cast("string")))
    pre = rows.select(F.col("File").alias("file"), F.lit("Before").alias("label"))
    post = rows.filter(F.col("Side") == "post").select(F.col("File").alias("file"), F.lit("After").alias("label"))
    return manifest.in_viewer(rows, pre.unionByName(post))


MANIFEST = ("manifest_optical_rows", "manifest_product_rows_in_viewer", "manifest_radar_rows")


@register("manifest_all_tabs", sql="""
SELECT *, row_number() OVER (PARTITION BY "Event", "Tab" ORDER BY CASE "Side" WHEN 'pre' THEN 0 WHEN 'post' THEN 1 ELSE 2 END, "Date (UTC)", "Scene ID", "File") AS "Row"
FROM (""" + "\nUNION ALL BY NAME ".join(f"SELECT * FROM ({SQL[k]})" for k in MANIFEST) + ")")
def q_mall(spark, d):
    """The rows of all tabs in one manifest, in its order."""
    return manifest.in_order(manifest.collected(*[ALL[k](spark, d) for k in MANIFEST]))


@register("export_supersession", sql="""
WITH x AS (SELECT page_id, 'ev' || page_id % 20 || CASE page_id % 3 WHEN 0 THEN '_3d' WHEN 1 THEN '_3d (2)' ELSE '_old' || page_id % 2 END AS stem, page_id AS mtime FROM pages),
u AS (SELECT stem, max(mtime) AS mtime FROM x GROUP BY 1),
k AS (SELECT *, regexp_replace(stem, '\\s*\\(\\d+\\)$', '') AS base FROM u), y AS (SELECT *, lower(regexp_replace(base, '_3d$', '')) AS key FROM k),
t AS (SELECT *, first_value(stem) OVER (PARTITION BY key ORDER BY mtime DESC, stem DESC) AS top FROM y)
SELECT stem, key, mtime, CASE WHEN stem = top THEN '' WHEN base = regexp_replace(top, '\\s*\\(\\d+\\)$', '') THEN 'superseded copy' ELSE 'older export' END AS stale FROM t""")
def q_stale(spark, d):
    """Newest export per event key wins."""
    i = F.col("page_id")
    stem = F.concat(F.lit("ev"), (i % 20).cast("string"), F.when(i % 3 == 0, "_3d").when(i % 3 == 1, "_3d (2)").otherwise(F.concat(F.lit("_old"), (i % 2).cast("string"))))
    e = D.table(spark, d, "pages").select(stem.alias("stem"), i.alias("mtime")).groupBy("stem").agg(F.max("mtime").alias("mtime"))
    return R.supersede(e.withColumn("key", X.event_key(F.col("stem"))))


@register("gazetteer_merge", views=("peaks",), extra="""RECURSIVE 
o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority, seq) AS rn FROM peaks),
r AS (SELECT name, rn, [{'x': lon, 'y': lat}] AS held, true AS kept FROM o WHERE rn = 1
  UNION ALL SELECT name, rn, CASE WHEN fresh THEN list_append(held, {'x': lon, 'y': lat}) ELSE held END, fresh FROM (
    SELECT o.name, o.rn, o.lon, o.lat, r.held, len(list_filter(r.held, lambda k: pow((k.x - o.lon) * 111320.0 * cos(radians((o.lat + k.y) / 2)), 2)
       + pow((k.y - o.lat) * 110540.0, 2) <= 360000)) = 0 AS fresh FROM r JOIN o ON o.name = r.name AND o.rn = r.rn + 1))""",
          sql="SELECT o.name, lon, lat, priority, seq, kept FROM o JOIN r USING (name, rn)")
def q_peaks(spark, d):
    """Same name within 600 m, earlier sources win, greedy against kept points."""
    return gazetteer.merge_points(D.peaks(spark, d))


@register("measurement_csv_round_trip", views=("outlines",), sql="""
SELECT slide, role, polygon_id, area_m2, CASE WHEN polygon_id % 3 <> 0 THEN 'note, ' || polygon_id || ' "q"' END AS note FROM outlines""")
def q_csv(spark, d):
    """A measurement table written as CSV and read again; NULL is an empty cell, quotes and commas survive."""
    k = F.col("polygon_id")
    rows = D.outlines(spark, d).withColumn("note", F.when(k % 3 != 0, F.concat(F.lit("note, "), k.cast("string"), F.lit(' "q"'))))
    path = shared_folder(spark, "csv")
    sinks.write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", "true").option("escape", '"').csv(path)


@register("event_metadata_round_trip", views=("obs",), sql="""
SELECT event_id, scene, side, count(*) AS n_cells, max(red) AS top FROM obs GROUP BY ALL""")
def q_meta(spark, d):
    """One metadata folder per event, written as JSON and read again."""
    rows = D.observations(spark, d).groupBy("event_id", "scene", "side").agg(F.count(F.lit(1)).alias("n_cells"), F.max("red").alias("top"))
    path = shared_folder(spark, "metadata")
    sinks.write_metadata(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register("elevation_text", sql="""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 1234.5::DOUBLE + s_suppkey WHEN 1 THEN (s_suppkey)::DOUBLE WHEN 2 THEN -12.0::DOUBLE END AS ele,
  'peak ' || s_suppkey || ' north' AS norm FROM supplier""")
def q_ele(spark, d):
    """Elevation text and normalised names."""
    k = F.col("s_suppkey")
    raw = (F.when(k % 4 == 0, F.concat((1234.5 + k).cast("string"), F.lit(" m"))).when(k % 4 == 1, k.cast("string"))
           .when(k % 4 == 2, F.lit(" -12 m")).otherwise("99,999"))
    return D.table(spark, d, "supplier").select("s_suppkey", X.parse_elevation(raw).alias("ele"),
                                                X.norm_name(F.concat(F.lit(" Peak-"), k.cast("string"), F.lit(" (North)"))).alias("norm"))


@register("labels_and_tags", views=("scenes",), sql="""
SELECT scene_id, CASE WHEN scene_id % 4 = 0 THEN '' WHEN scene_id % 4 = 1 THEN '2024-01-05' ELSE '2024-01-05_to_2024-02-09' END AS dates,
  CASE WHEN scene_id % 3 <> 0 THEN CASE WHEN scene_id % 97 >= 50 THEN '❄ ' ELSE '' END || scene_id % 90 || '%' WHEN cloud_pct IS NOT NULL THEN '~' || cloud_pct::BIGINT || '%' ELSE '' END AS cloud,
  CASE WHEN scene_id % 2 = 0 THEN 'a' || scene_id ELSE substr('20240105' || scene_id, 1, 8) || '_2scenes_' || substr(sha1('20240105' || scene_id || ',z9'), 1, 8) END AS tag FROM scenes""")
def q_tags(spark, d):
    """Date span, cloud cell and scene-set tags."""
    i = F.col("scene_id")
    t = i.cast("string")
    dates = F.when(i % 4 == 0, F.array(F.lit(""))).when(i % 4 == 1, F.array(F.lit("2024-01-05"), F.lit("2024-01-05"))).otherwise(
        F.array(F.lit("2024-02-09"), F.lit("2024-01-05")))
    ids = F.when(i % 2 == 0, F.array(F.concat(F.lit("a"), t), F.lit(""))).otherwise(F.array(F.lit("z9"), F.concat(F.lit("20240105"), t)))
    return D.scenes(spark, d).select("scene_id", X.date_tag(dates).alias("dates"), X.cloud_cell(
        F.when(i % 3 != 0, (i % 90).cast("double")), F.col("cloud_pct"), (i % 97).cast("double")).alias("cloud"), X.scene_tag(ids).alias("tag"))


@register("key_scrub_in_text", sql="""
SELECT page_id, 'see ' || split_part(url, '?', 1) || CASE page_id % 3 WHEN 0 THEN '?v=2' WHEN 1 THEN '?v=2' ELSE '' END || ' end' AS clean,
  substr(sha256('KEYKEY' || page_id || 'XY'), 1, 8) AS prints, 'maxar-api-key: <KEY> ok' AS header FROM pages""")
def q_scrub(spark, d):
    """Keys leave URLs, headers are hidden, fingerprints instead of values."""
    i = F.col("page_id").cast("string")
    key = F.concat(F.lit("api_key=KEYKEY"), i, F.lit("XY"))
    base = F.element_at(F.split("url", "\\?"), 1)
    m = F.col("page_id") % 3
    url = F.concat(F.lit("see "), base, F.when(m == 0, F.concat(F.lit("?"), key, F.lit("&v=2"))).when(m == 1, F.concat(F.lit("?v=2&"), key))
                   .otherwise(F.concat(F.lit("?"), key)), F.lit(" end"))
    return D.table(spark, d, "pages").select("page_id", X.strip_url_keys(url).alias("clean"), F.array_join(X.key_fingerprints(url), ",").alias("prints"),
                                             X.redact(F.concat(F.lit("maxar-api-key: SECRET"), i, F.lit(" ok"))).alias("header"))


# the secret of each row, the text around it, and what must be left
_LEAKS = """
WITH k AS (SELECT doc_id, text, substr(sha256('a' || doc_id), 1, 32) AS h FROM documents),
u AS (SELECT doc_id, text, h, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM k),
f AS (SELECT doc_id, text, h, to_base64(encode(uuid)) AS dashed, rtrim(to_base64(encode(h)), '=') AS bare FROM u)
SELECT doc_id, sha256(text || CASE doc_id % 8 WHEN 0 THEN ' {"maxar-api-key": "<KEY>"}' WHEN 1 THEN ' maxar api key: <KEY>' WHEN 2 THEN ' maxarapikey=<KEY>'
  WHEN 3 THEN ' ?maxar_api_key%3D<KEY>' WHEN 4 THEN ' {"Authorization": "Bearer <KEY>"}' WHEN 5 THEN ' Authorization: token <KEY> x'
  WHEN 6 THEN ' /keys/<KEY>/usage' ELSE ' key <KEY>-expired' END) AS digest,
  sha256(text || ' ' || CASE doc_id % 8 WHEN 6 THEN dashed WHEN 7 THEN bare ELSE h END) AS before FROM f"""


@register("key_redaction_in_documents", sql=_LEAKS)
def q_redact(spark, d):
    """Every document with a planted key in one of eight forms, scrubbed in whole."""
    k = D.table(spark, d, "documents").withColumn("h", F.substring(F.sha2(F.concat(F.lit("a"), F.col("doc_id").cast("string")), 256), 1, 32))
    h = F.col("h")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    dashed, bare = F.base64(F.encode(uuid, "UTF-8")), F.rtrim(F.base64(F.encode(h, "UTF-8")), F.lit("="))
    m = F.col("doc_id") % 8
    forms = [F.concat(F.lit(a), v, F.lit(b)) for a, v, b in (
        (' {"maxar-api-key": "', h, '"}'), (" maxar api key: ", h, ""), (" maxarapikey=", h, ""), (" ?maxar_api_key%3D", h, ""),
        (' {"Authorization": "Bearer ', h, '"}'), (" Authorization: token ", h, " x"), (" /keys/", dashed, "/usage"), (" key ", bare, "-expired"))]
    planted, secret = forms[7], F.when(m == 6, dashed).when(m == 7, bare).otherwise(h)
    for i in range(7):
        planted = F.when(m == i, forms[i]).otherwise(planted)
    return k.select("doc_id", F.sha2(X.redact(F.concat("text", planted)), 256).alias("digest"),
                    F.sha2(F.concat_ws(" ", "text", secret), 256).alias("before"))


# ------------------------------------------------------------------ grids and radar geometry
@register("utm_zone_codes", sql="""
SELECT c_custkey, CASE WHEN la < 0 THEN 32700 ELSE 32600 END + CAST(floor((lo + 180) / 6) AS INTEGER) + 1 AS epsg
FROM (SELECT c_custkey, c_custkey % 160 - 80.0 AS la, (c_custkey * 7) % 360 - 180.0 AS lo FROM customer)""")
def q_utm(spark, d):
    """UTM code of a point."""
    k = F.col("c_custkey")
    return D.table(spark, d, "customer").select("c_custkey", geo.utm_epsg(k % 160 - F.lit(80.0), (k * 7) % 360 - F.lit(180.0)).alias("epsg"))


@register("search_boxes", views=("det",), sql="""
SELECT event_id, round(lon - 3 / (111.32 * cos(radians(lat))), 9) AS w, round(lat - 3 / 111.0, 9) AS s_alt,
  round(greatest(-180, lon - 3.3 / (111.32 * greatest(0.01, cos(radians(lat))))), 9) AS pad_w, round(least(90, lat + 3.3 / 111.32), 9) AS pad_n FROM det""")
def q_boxes(spark, d):
    """Search boxes under both degree constants, and the padded box."""
    la, lo, r = F.col("lat"), F.col("lon"), F.col("radius_km")
    a, b, p = geo.aoi_box(la, lo, r), geo.aoi_box(la, lo, r, geo.KM_PER_DEG_ALT), geo.padded_box(la, lo, r)
    return D.detections(spark, d).select("event_id", F.round(a["w"], 9).alias("w"), F.round(b["s"], 9).alias("s_alt"),
                                         F.round(p["w"], 9).alias("pad_w"), F.round(p["n"], 9).alias("pad_n"))


@register("grid_pixel_size_and_cell", views=("det", "grids"), sql="""
SELECT event_id, round(dx * 111320 * greatest(0.05, cos(radians(60 - 16 / 4096.0))), 6) AS dx_m, round(110540 / 4096.0, 6) AS dy_m, 5 AS col, 7 AS "row"
FROM (SELECT *, 1 / 2048.0::DOUBLE AS dx FROM grids)""")
def q_pixel(spark, d):
    """Metric pixel size and the cell of a point."""
    g = D.grids(spark, d)
    m = radar.metric_pixel(F.col("dx"), F.col("dy"), F.col("y0"), F.col("n_rows"))
    x, y = F.col("x0") + 5.5 * F.col("dx"), F.col("y0") + 7.25 * F.col("dy")
    return g.select("event_id", F.round(m["dx_m"], 6).alias("dx_m"), F.round(m["dy_m"], 6).alias("dy_m"),
                    F.floor((x - F.col("x0")) / F.col("dx")).cast("int").alias("col"), F.floor((y - F.col("y0")) / F.col("dy")).cast("int").alias("row"))


LOOK = """q AS (SELECT scene_id, orbit_state, (scene_id % 70)::DOUBLE AS lat, 30.0::DOUBLE + scene_id % 15 AS inc FROM scenes),
h AS (SELECT *, asin(cos(radians(98.18)) / cos(radians(lat))) AS psi0 FROM q),
g AS (SELECT *, CASE orbit_state WHEN 'ascending' THEN psi0 ELSE pi() - psi0 END AS h, 7.5 * 6371.0::DOUBLE / 7064.0 AS v FROM h),
hd AS (SELECT *, degrees(atan2(v * sin(h) - 0.4651 * cos(radians(lat)), v * cos(h))) AS head,
   radians(inc) - asin(6371.0::DOUBLE / 7064.0 * sin(radians(inc))) AS gam FROM g),
lk AS (SELECT *, head + CASE orbit_state WHEN 'ascending' THEN 1 ELSE -1 END * degrees(gam * tan(radians(lat))) + 90 AS look FROM hd)"""


@register("radar_look_geometry", views=("scenes",), extra=LOOK, sql="""
SELECT scene_id, round((head + 720) % 360, 6) AS heading, round((look + 720) % 360, 6) AS look, round((look + 180 + 720) % 360, 6) AS lit, round(gam * 6371, 6) AS range_km,
  round(abs(((look + 180 - 100 + 180 + 720) % 360) - 180), 6) AS gap FROM lk""")
def q_look(spark, d):
    """Heading, look azimuth, lit aspect, ground range and facing gap."""
    i = F.col("scene_id")
    s = D.scenes(spark, d).select("scene_id", "orbit_state", (i % 70).cast("double").alias("lat"), (F.lit(30.0) + i % 15).alias("inc"))
    o, la, inc = F.col("orbit_state"), F.col("lat"), F.col("inc")
    lit = radar.illumination_aspect_deg(o, la, inc)
    return s.select("scene_id", F.round(radar.ground_heading_deg(o, la), 6).alias("heading"), F.round(radar.look_azimuth_deg(o, la, inc), 6).alias("look"),
                    F.round(lit, 6).alias("lit"), F.round(radar.range_at_incidence(inc), 6).alias("range_km"), F.round(radar.angular_gap(lit, F.lit(100.0)), 6).alias("gap"))


def _gam(inc):
    return f"(radians({inc}) - asin(6371.0::DOUBLE / 7064.0 * sin(radians({inc}))))"


def _swath_pass(name, src, inc):
    """CTE <name>: the incidence where the point falls between the nearest and the farthest corner along the look for ``inc``."""
    return f"""{name}_a AS (SELECT scene_id, any_value(head) AS head, any_value(orbit_state) AS orbit_state, any_value(lat) AS lat, any_value({inc}) AS inc_in,
   min(d * cos(radians(b - (head + CASE orbit_state WHEN 'ascending' THEN 1 ELSE -1 END * degrees({_gam(inc)} * tan(radians(lat))) + 90)))) AS near,
   max(d * cos(radians(b - (head + CASE orbit_state WHEN 'ascending' THEN 1 ELSE -1 END * degrees({_gam(inc)} * tan(radians(lat))) + 90)))) AS far FROM {src} GROUP BY 1),
{name}_g AS (SELECT *, ({_gam('29.1')} * 6371 + ({_gam('46.0')} - {_gam('29.1')}) * 6371 * greatest(0, least(1, -near / (far - near)))) / 6371 AS g,
   ({_gam('46.0')} - {_gam('29.1')}) * 6371 AS sw FROM {name}_a),
{name} AS (SELECT scene_id, CASE WHEN inc_in IS NOT NULL AND far - near BETWEEN 0.6 * sw AND 1.5 * sw THEN degrees(atan2(6371 * sin(g), 7064 - 6371 * cos(g)) + g) END AS inc FROM {name}_g)"""


SWATH = """q AS (SELECT scene_id, orbit_state, (w + e) / 2 AS lon, (s + n) / 2 AS lat, w - 2 AS w, e + 2 AS e, s, n FROM scenes),
h AS (SELECT *, asin(cos(radians(98.18)) / cos(radians(lat))) AS psi0, 7.5 * 6371.0::DOUBLE / 7064.0 AS v FROM q),
hd AS (SELECT *, degrees(atan2(v * sin(CASE orbit_state WHEN 'ascending' THEN psi0 ELSE pi() - psi0 END) - 0.4651 * cos(radians(lat)),
   v * cos(CASE orbit_state WHEN 'ascending' THEN psi0 ELSE pi() - psi0 END))) AS head FROM h),
pt AS (SELECT *, unnest([w, e, e, w]) AS px, unnest([s, s, n, n]) AS py FROM hd),
pd AS (SELECT *, degrees(atan2(sin(radians(px - lon)) * cos(radians(py)), cos(radians(lat)) * sin(radians(py)) - sin(radians(lat)) * cos(radians(py)) * cos(radians(px - lon)))) AS b,
   2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(py - lat) / 2), 2) + cos(radians(lat)) * cos(radians(py)) * pow(sin(radians(px - lon) / 2), 2)))) AS d FROM pt),
""" + _swath_pass("one", "pd", "39.0") + """,
pe AS (SELECT pd.*, one.inc AS inc1 FROM pd JOIN one USING (scene_id)),
""" + _swath_pass("two", "pe", "inc1")


@register("swath_incidence_at_point", views=("scenes",), extra=SWATH, sql="SELECT scene_id, round(inc, 4) AS incidence FROM two")
def q_swath(spark, d):
    """Incidence at a point from a footprint's near and far edge."""
    s = D.scenes(spark, d)
    b = F.col("bbox")
    wide = F.struct((b["w"] - 2.0).alias("w"), b["s"].alias("s"), (b["e"] + 2.0).alias("e"), b["n"].alias("n"))
    lon, lat = (b["w"] + b["e"]) / 2, (b["s"] + b["n"]) / 2
    return s.select("scene_id", F.round(radar.swath_incidence_deg(geo.box_ring(wide), lon, lat, F.col("orbit_state")), 4).alias("incidence"))


@register("radar_exclude_mask", views=("obs",), sql="""
SELECT event_id, scene, count(*) FILTER (scl <> 0) AS n_excluded, count(*) FILTER (scl <> 5 OR scl = 11) AS n_kept_five,
  count(*) FILTER (scl = 0 OR scl <> 0) AS n_kept_zero_is_fill, count(*) AS n FROM obs GROUP BY ALL""")
def q_exclude(spark, d):
    """Mask codes that exclude a cell, for several codes of a good cell and of fill."""
    o = D.observations(spark, d)
    m = F.col("scl")
    return o.groupBy("event_id", "scene").agg(
        F.count_if(C.excluded_by_mask(m)).alias("n_excluded"), F.count_if(C.excluded_by_mask(m, keep=5, nodata=11)).alias("n_kept_five"),
        F.count_if(C.excluded_by_mask(m, nodata=0)).alias("n_kept_zero_is_fill"), F.count(F.lit(1)).alias("n"))


@register("valid_pixels", views=("obs",), sql="""
SELECT event_id, scene, count(*) FILTER (red > 0 AND red <> 250 AND scl > 0) AS n_power, count(*) FILTER (red <> 250) AS n_height FROM obs GROUP BY ALL""")
def q_valid(spark, d):
    """Power must be positive, heights only measured."""
    o = D.observations(spark, d)
    p = C.power_value(F.col("red"), 250, F.col("scl"))
    return o.groupBy("event_id", "scene").agg(F.count(p).alias("n_power"), F.count(C.height_value(F.col("red"), 250)).alias("n_height"))


@register("sensor_names", views=("scenes",), sql="""
SELECT scene_id, CASE source WHEN 'Sentinel-2' THEN 's2' WHEN 'Landsat' THEN 'landsat' END AS sensor FROM scenes""")
def q_sensor(spark, d):
    """Sensor spellings."""
    return D.scenes(spark, d).select("scene_id", C.normal_sensor(F.concat(F.lit(" "), F.col("source"), F.lit(" "))).alias("sensor"))


@register("sensor_groups", views=("strips",), sql="""
SELECT feature_id, CASE WHEN sensor = 'SKY' THEN 'other' ELSE sensor END AS grp FROM strips""")
def q_groups(spark, d):
    """Sensor group."""
    from siltmark.functions.viewgeom import sensor_group
    return D.strips(spark, d).select("feature_id", sensor_group(F.lower(F.col("sensor"))).alias("grp"))


# ------------------------------------------------------------------ tone
BANDS = """rf AS (SELECT event_id, scene, side, "row", col, red / 3000.0::DOUBLE AS red, green / 3000.0::DOUBLE AS green, blue / 3000.0::DOUBLE AS blue FROM obs)"""


def refl(spark, d):
    return D.observations(spark, d).select("event_id", "scene", "side", "row", "col", *[(F.col(c) / 3000.0).alias(c) for c in ("red", "green", "blue")])


@register("tone_linear_and_cube_root", views=("obs",), extra=BANDS, sql="""
SELECT event_id, scene, "row", col, round(greatest(1, least(1, greatest(0, (red - 0.05) / 0.25)) * 255), 4) AS lin, round(CASE WHEN c < 0.5 THEN 0.5 * pow(2 * c, 1.15) ELSE 1 - 0.5 * pow(2 - 2 * c, 1.15) END * 255, 4) AS nat
FROM (SELECT *, least(1, cbrt(0.6 * green)) AS c FROM rf)""")
def q_tone(spark, d):
    """Linear and cube-root curves with contrast."""
    return refl(spark, d).select("event_id", "scene", "row", "col", F.round(TN.linear(F.col("red"), 0.30, 0.05), 4).alias("lin"),
                                 F.round(TN.cube_root(F.col("green"), 1.15), 4).alias("nat"))


ROLL = BANDS + """,
a AS (SELECT *, greatest(red, green, blue) AS mx, greatest(red, green, blue) / 0.9::DOUBLE AS m FROM rf),
b AS (SELECT *, CASE WHEN m <= 0.55 THEN m ELSE 0.55 + 0.45 * (1 - exp(-(m - 0.55) / 0.45)) END AS sh0 FROM a),
c AS (SELECT *, sh0 + (ln(1 + 60 * sh0) / ln(61) - sh0) * pow(greatest(1 - sh0, 0), 2) AS sh, least(1, greatest(0, (mx - 0.5) / 0.5)) AS u FROM b),
d AS (SELECT *, red / 0.9 * sh / CASE WHEN m <> 0 THEN m ELSE 1 END AS r0, green / 0.9 * sh / CASE WHEN m <> 0 THEN m ELSE 1 END AS g0, blue / 0.9 * sh / CASE WHEN m <> 0 THEN m ELSE 1 END AS b0, 0.7 * u * u * (3 - 2 * u) AS wd FROM c),
e AS (SELECT *, r0 + (sh - r0) * wd AS r1, g0 + (sh - g0) * wd AS g1, b0 + (sh - b0) * wd AS b1, least(1, greatest(0, (mx - 0.08) / 0.14)) AS ub FROM d),
f AS (SELECT *, least(1, greatest(0, CASE WHEN mx > 1e-6 THEN 0.42 ELSE 1 END * least(1, greatest(0, (b1 - greatest(r1, g1)) / 0.18)) * ub * ub * (3 - 2 * ub))) AS bd FROM e),
g AS (SELECT *, least(1, greatest(0, r1 + (sh - r1) * bd)) AS r2, least(1, greatest(0, g1 + (sh - g1) * bd)) AS g2, least(1, greatest(0, b1 + (sh - b1) * bd)) AS b2 FROM f),
h AS (SELECT *, 255 * CASE WHEN r2 < 0.5 THEN 0.5 * pow(2 * r2, 1.15) ELSE 1 - 0.5 * pow(2 - 2 * r2, 1.15) END AS r3,
   255 * CASE WHEN g2 < 0.5 THEN 0.5 * pow(2 * g2, 1.15) ELSE 1 - 0.5 * pow(2 - 2 * g2, 1.15) END AS g3, 255 * CASE WHEN b2 < 0.5 THEN 0.5 * pow(2 * b2, 1.15) ELSE 1 - 0.5 * pow(2 - 2 * b2, 1.15) END AS b3 FROM g),
i AS (SELECT *, 0.299 * r3 + 0.587 * g3 + 0.114 * b3 AS y, 0.7 * least(1, greatest(0, (b3 - r3) / 30)) AS w FROM h),
j AS (SELECT *, r3 + (y - r3) * w AS r4, g3 + (y - g3) * w AS g4, b3 + (y - b3) * w AS b4 FROM i),
k AS (SELECT *, 0.299 * r4 + 0.587 * g4 + 0.114 * b4 AS y2, 0.7 * least(1, greatest(0, (r4 - b4) / 30)) AS w2 FROM j),
l AS (SELECT *, w2 * pow(least(1, greatest(0, (y2 - 175) / 35)), 2) * (3 - 2 * least(1, greatest(0, (y2 - 175) / 35))) AS w3 FROM k)"""


@register("tone_hdr", views=("obs",), extra=ROLL, sql="""
SELECT event_id, scene, "row", col, CAST(floor(greatest(1, least(254, r4 + (y2 - r4) * w3)) + 1e-9) AS INTEGER) AS r, CAST(floor(greatest(1, least(254, g4 + (y2 - g4) * w3)) + 1e-9) AS INTEGER) AS g,
  CAST(floor(greatest(1, least(254, b4 + (y2 - b4) * w3)) + 1e-9) AS INTEGER) AS b FROM l""")
def q_hdr(spark, d):
    """Roll-off with shadow lift, desaturation and cast strips."""
    return TN.hdr(refl(spark, d), F.lit(0.9)).select("event_id", "scene", "row", "col", "r", "g", "b")


@register("tone_hdr_white", views=("obs",), extra=BANDS, sql="""
SELECT event_id, CASE WHEN count(*) < 2000 THEN 0.9 ELSE greatest(0.3, least(1.3, quantile_cont(greatest(red, green, blue), 0.995))) END AS white, count(*) AS n_values FROM rf GROUP BY 1""")
def q_white(spark, d):
    """Pooled white anchor."""
    return TN.hdr_white(refl(spark, d), KEYS, min_n=2000)


@register("tone_auto_stretch", views=("obs",), extra=BANDS + """,
m AS (SELECT event_id, scene, CASE scene WHEN 1 THEN 0.7 + greatest(red, green, blue) / 4 WHEN 2 THEN CASE WHEN "row" = 0 THEN 0.1 ELSE 0.7 + greatest(red, green, blue) / 4 END ELSE greatest(red, green, blue) END AS m FROM rf),
q AS (SELECT event_id, scene, quantile_cont(m, 0.001) AS p_lo, quantile_cont(m, 0.99) AS p_hi, count(*) FILTER (m < 0.165) / count(*)::DOUBLE AS dark FROM m GROUP BY ALL),
w AS (SELECT *, 1 - pow(least(1, greatest(0, (dark - 0.005) / 0.045)), 2) * (3 - 2 * least(1, greatest(0, (dark - 0.005) / 0.045))) AS w, p_lo * 0.9 AS lo, least(p_hi, 1.0) AS hi FROM q),
x AS (SELECT *, w > 0 AND hi - lo >= 0.05 AS fitted FROM w)""", sql="""
SELECT event_id, scene, round(CASE WHEN fitted THEN w * lo ELSE 0 END, 9) AS black, round(CASE WHEN fitted THEN (1 - w) * 0.3 + w * hi ELSE 0.3 END, 9) AS white,
  round(CASE WHEN fitted THEN least(greatest(0.5, (1 - w) * 0.3 + w * hi), 0.95) ELSE 0.5 END, 9) AS onset, fitted FROM x""")
def q_auto(spark, d):
    """Black, white and fade onset fitted to scenes with no dark end."""
    top = F.greatest("red", "green", "blue")
    m = (F.when(F.col("scene") == 1, 0.7 + top / 4).when(F.col("scene") == 2, F.when(F.col("row") == 0, 0.1).otherwise(0.7 + top / 4)).otherwise(top))
    r = refl(spark, d).withColumn("m", m).withColumns({c: F.col("m") for c in ("red", "green", "blue")})
    out = TN.auto_stretch(r, ["event_id", "scene"], min_n=100)
    return out.withColumns({c: F.round(c, 9) for c in ("black", "white", "onset")})


LONG = BANDS + """,
lg AS (SELECT event_id, scene, "row", col, unnest(['red', 'green', 'blue']) AS band, unnest([red + 0.04, green + 0.02 * scene, blue + 0.06]) AS v FROM rf),
fl AS (SELECT event_id, scene, band, quantile_cont(v, 0.001) * 0.9 AS floor FROM lg WHERE v > 0 GROUP BY ALL),
ok AS (SELECT event_id, scene FROM fl GROUP BY ALL HAVING min(floor) <= 0.15)"""


def long_bands(spark, d):
    r = refl(spark, d)
    b = F.array(F.struct(F.lit("red").alias("band"), (F.col("red") + 0.04).alias("v")), F.struct(F.lit("green").alias("band"), (F.col("green") + 0.02 * F.col("scene")).alias("v")),
                F.struct(F.lit("blue").alias("band"), (F.col("blue") + 0.06).alias("v")))
    return r.select("event_id", "scene", "row", "col", F.explode(b).alias("x")).select("event_id", "scene", "row", "col", "x.*")


@register("haze_removed", views=("obs",), extra=LONG, sql="""
SELECT l.event_id, l.scene, l."row", l.col, l.band, round(CASE WHEN ok.scene IS NOT NULL THEN greatest(v - floor, 0) ELSE v END, 9) AS v
FROM lg l LEFT JOIN ok USING (event_id, scene) JOIN fl ON fl.event_id = l.event_id AND fl.scene = l.scene AND fl.band = l.band""")
def q_haze(spark, d):
    """Path-radiance floor per band subtracted where a dark object exists."""
    return TN.dehaze(long_bands(spark, d), ["event_id", "scene"]).select("event_id", "scene", "row", "col", "band", F.round("v", 9).alias("v"))


@register("white_balance_gains", views=("obs",), extra=BANDS + """,
m AS (SELECT *, greatest(red, green, blue) AS m FROM rf), t AS (SELECT event_id, scene, quantile_cont(m, 0.85) AS thr FROM m GROUP BY ALL),
g AS (SELECT event_id, scene, any_value(thr) AS thr, avg(red) AS r, avg(green) AS g, avg(blue) AS b FROM m JOIN t USING (event_id, scene) WHERE m >= thr GROUP BY ALL)""", sql="""
SELECT event_id, scene, round(CASE WHEN thr < 0.5 THEN 1 ELSE least(greatest(greatest(r, g, b) / r, 1), 1.8) END, 6) AS gain_red,
  round(CASE WHEN thr < 0.5 THEN 1 ELSE least(greatest(greatest(r, g, b) / g, 1), 1.8) END, 6) AS gain_green, round(CASE WHEN thr < 0.5 THEN 1 ELSE least(greatest(greatest(r, g, b) / b, 1), 1.8) END, 6) AS gain_blue FROM g""")
def q_gain(spark, d):
    """Gains that make the brightest cells grey."""
    out = TN.balance_gains(refl(spark, d), ["event_id", "scene"])
    return out.withColumns({f"gain_{c}": F.round(f"gain_{c}", 6) for c in ("red", "green", "blue")})


@register("radar_display_bytes", views=("obs",), sql="""
SELECT event_id, scene, "row", col, CASE WHEN red > 0 THEN 1 + CAST(round_even(least(1, greatest(0, (10 * log10(red / 3000.0) + 25) / 25)) * 254, 0) AS INTEGER) ELSE 0 END AS byte,
  CASE WHEN v <= 0 THEN 0 WHEN v <= 3 THEN v / 3 * 255 ELSE 255 END AS r, CASE WHEN v <= 0 THEN 255 + 0 * v WHEN v <= 3 THEN 255 - v / 3 * 255 ELSE 0 END AS b
FROM (SELECT *, greatest(-3, least(3, (green - 1500) / 500.0::DOUBLE)) AS v FROM obs)""")
def q_bytes(spark, d):
    """dB display bytes and a colour ramp."""
    o = D.observations(spark, d)
    ramp = TN.colour_ramp((F.col("green") - 1500) / 500.0, -3, 3, [(-3, "#0000ff", 255), (0, "#0000ff", 255), (3, "#ff0000", 255)])
    return o.select("event_id", "scene", "row", "col", TN.radar_bytes(F.col("red") / 3000.0).alias("byte"), ramp["r"].alias("r"), ramp["b"].alias("b"))
