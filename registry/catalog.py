"""Catalogue queries: search, ranking and choices per event and side."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import register
from siltmark.functions import geo, timing
from siltmark.operators import ranking as R
from siltmark.operators import search as S
from siltmark.sources import driver_tables as D

# box around an event and the joined pairs, shared by the SQL twins
AOI = """aoi AS (SELECT *, lon - radius_km / (111.32 * cos(radians(lat))) AS aw, lat - radius_km / 111.32 AS as_,
    lon + radius_km / (111.32 * cos(radians(lat))) AS ae, lat + radius_km / 111.32 AS an FROM det)"""
PAIRS = AOI + """,
allp AS (SELECT a.*, s.* EXCLUDE (event_id), abs(epoch_us(acq) - epoch_us(origin)) / 86400000000.0::DOUBLE AS gap,
    CAST(acq AS DATE) AS day
  FROM aoi a JOIN (SELECT *, 0 AS event_id FROM scenes) s
    ON s.w <= a.ae AND a.aw <= s.e AND s.s <= a.an AND a.as_ <= s.n)"""


def DAYP(pre, post):
    return PAIRS + f""",
p AS (SELECT *, CASE
    WHEN day BETWEEN CAST(origin - INTERVAL {pre} DAY AS DATE) AND CAST(origin - INTERVAL 1 DAY AS DATE) THEN 'pre'
    WHEN day BETWEEN CAST(origin + INTERVAL 1 DAY AS DATE) AND CAST(origin + INTERVAL {post} DAY AS DATE) THEN 'post'
  END AS side FROM allp)"""


def ORIP(pre, post):
    return PAIRS + f""",
p AS (SELECT *, CASE WHEN acq >= origin - INTERVAL {pre} DAY AND acq < origin THEN 'pre'
    WHEN acq >= origin AND acq <= origin + INTERVAL {post} DAY THEN 'post' END AS side FROM allp)"""


def found(spark, d, pre=12, post=12, **kw):
    return S.scene_search(D.detections(spark, d), D.scenes(spark, d), pre_days=pre, post_days=post, **kw)


@register("search_best_scene_per_side", views=("det", "scenes"), extra=DAYP(12, 12), sql="""
SELECT event_id, side, scene_id, source, round(gap, 6) AS gap, round(cost, 6) AS cost FROM (
  SELECT *, gap + 0.5 * coalesce(cloud_pct, 100) AS cost,
         row_number() OVER (PARTITION BY event_id, side ORDER BY gap + 0.5 * coalesce(cloud_pct, 100), scene_id) AS rn
  FROM p WHERE side IS NOT NULL) WHERE rn = 1""")
def best_scene(spark, d):
    """The best before and after scene of every event."""
    return R.best_by_cost(found(spark, d), 1).select(
        "event_id", "side", "scene_id", "source", F.round("gap", 6).alias("gap"), F.round("cost", 6).alias("cost"))


@register("search_pairs_day_windows", views=("det", "scenes"), extra=DAYP(12, 12), sql="""
SELECT event_id, scene_id, side, CAST(round_even(gap, 0) AS BIGINT) AS gap_days FROM p WHERE side IS NOT NULL""")
def pairs_day(spark, d):
    """Event x scene range join under whole-day windows."""
    return found(spark, d).select("event_id", "scene_id", "side", timing.whole_days(F.col("gap")).alias("gap_days"))


@register("search_pairs_origin_split", views=("det", "scenes"), extra=ORIP(12, 12), sql="""
SELECT event_id, side, source, count(*) AS n, round(min(gap), 6) AS nearest FROM p WHERE side IS NOT NULL GROUP BY ALL""")
def pairs_origin(spark, d):
    """Windows split exactly at the origin time."""
    return found(spark, d, rule="origin").groupBy("event_id", "side", "source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("gap"), 6).alias("nearest"))


@register("search_cloud_cap", views=("det", "scenes"), extra=DAYP(12, 12), sql="""
SELECT event_id, side, count(*) FILTER (cloud_pct < 40) AS n_capped, count(*) AS n_all,
       count(*) FILTER (cloud_pct IS NULL) AS n_no_figure FROM p WHERE side IS NOT NULL GROUP BY ALL""")
def cloud_cap(spark, d):
    """A cap drops scenes without a figure, no cap keeps them."""
    keys = ["event_id", "side"]
    capped = found(spark, d, max_cloud=40).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_capped"))
    every = found(spark, d, max_cloud=100).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("cloud_pct").isNull()).alias("n_no_figure"))
    return every.join(capped, keys, "left").select(
        *keys, F.coalesce("n_capped", F.lit(0).cast("bigint")).alias("n_capped"), "n_all", "n_no_figure")


@register("search_mode_filter_listing", views=("det", "scenes"), extra=DAYP(12, 12), sql="""
SELECT event_id, side, scene_id, rn AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY gap, scene_id) AS rn
 FROM p WHERE side IS NOT NULL AND mode = 'IW' AND source = 'Sentinel-1') WHERE rn <= 12""")
def mode_filter(spark, d):
    """Only the land mode is ranked, then the listing limit applies."""
    sc = D.scenes(spark, d).filter((F.col("mode") == "IW") & (F.col("source") == "Sentinel-1"))
    df = S.scene_search(D.detections(spark, d), sc, pre_days=12, post_days=12)
    return R.top_per_side(df, ("gap", "scene_id"), R.radar_cap(12)).select("event_id", "side", "scene_id", F.col("rank"))


@register("search_products_point_cover", views=("det", "scenes"), extra=DAYP(20, 20), sql="""
SELECT event_id, side, scene_id, rn AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY event_id, side
    ORDER BY round_even(gap, 0), coalesce(cloud_pct, 100), scene_id) AS rn
 FROM p WHERE side IS NOT NULL AND source = 'PlanetScope' AND cloud_pct < 80 AND scene_id % 4 <> 0
   AND scene_id % 3 <> 1 AND w <= lon AND lon <= e AND s <= lat AND lat <= n) WHERE rn <= 60""")
def products(spark, d):
    """Permission, quality and cloud filters, footprint holds the point."""
    sc = (D.scenes(spark, d).filter(F.col("source") == "PlanetScope")
          .withColumn("downloadable", F.col("scene_id") % 4 != 0)
          .withColumn("quality", F.when(F.col("scene_id") % 3 == 1, "test").otherwise("standard")))
    df = S.search_products(D.detections(spark, d), sc, pre_days=20, post_days=20, cover="point")
    return R.nearest_clearest(df, R.PRODUCT_LIMIT).select("event_id", "side", "scene_id", F.col("rank"))


WANTED = """w AS (SELECT c_custkey AS request_id,
  [c_custkey * 3, c_custkey * 7 + 1, c_custkey * 11 + 2] AS ids FROM customer),
x AS (SELECT request_id, unnest(ids) AS scene_id, unnest([0, 1, 2]) AS pos FROM w)"""


def _wanted(spark, d):
    k = F.col("c_custkey")
    return D.table(spark, d, "customer").select(
        k.alias("request_id"), F.array(k * 3, k * 7 + 1, k * 11 + 2).alias("ids"))


@register("fetch_scenes_by_id_in_order", views=("scenes",), extra=WANTED, sql="""
SELECT request_id, CAST(pos AS INTEGER) AS pos, scene_id, source FROM x JOIN scenes USING (scene_id)""")
def by_ids(spark, d):
    """Exact ids in requested order, missing ones dropped."""
    return S.fetch_by_ids(_wanted(spark, d), D.scenes(spark, d)).select("request_id", "pos", "scene_id", "source")


@register("collection_holding_ids", views=("scenes",), extra=WANTED, sql="""
SELECT request_id, arg_min(source, CASE source WHEN 'Sentinel-2' THEN 1 ELSE 2 END) AS source, count(*) AS n_found
FROM x JOIN scenes USING (scene_id) WHERE source IN ('Sentinel-2', 'Landsat') GROUP BY 1""")
def holding(spark, d):
    """First collection that holds any of the ids."""
    return S.holding_collection(_wanted(spark, d), D.scenes(spark, d), {"Sentinel-2": 1, "Landsat": 2})


@register("granules_around_event", views=("det", "scenes"), extra=PAIRS.replace("111.32", "111.0") + """,
p AS (SELECT *, CASE WHEN acq >= origin - INTERVAL 12 DAY AND acq < origin THEN 'pre'
  WHEN acq >= origin AND acq <= origin + INTERVAL 12 DAY THEN 'post' END AS side FROM allp)""", sql="""
SELECT event_id, side, scene_id, relative_orbit AS track,
  CAST(round_even((epoch_us(acq) - epoch_us(origin)) / 86400000000.0::DOUBLE, 0) AS BIGINT) AS signed_gap
FROM p WHERE side IS NOT NULL AND source = 'Sentinel-1'""")
def granules(spark, d):
    """Granules with side, signed gap and track (111.0 km per degree)."""
    sc = D.scenes(spark, d).filter(F.col("source") == "Sentinel-1")
    return S.granule_list(D.detections(spark, d), sc, pre_days=12, post_days=12).select(
        "event_id", "side", "scene_id", F.col("relative_orbit").alias("track"), "signed_gap")


@register("disturbance_alerts_after_event", views=("det", "scenes"), extra=PAIRS.replace("111.32", "111.0"), sql="""
SELECT event_id, scene_id, acq FROM allp
WHERE source = 'Landsat' AND acq >= origin AND acq <= origin + INTERVAL 14 DAY""")
def alerts(spark, d):
    """Alert products, after-window only."""
    sc = D.scenes(spark, d).filter(F.col("source") == "Landsat")
    df = S.granule_list(D.detections(spark, d), sc, pre_days=0, post_days=14)
    return df.filter(F.col("side") == "post").select("event_id", "scene_id", "acq")


@register("nearest_granule_with_mask", views=("det", "scenes"), extra=PAIRS.replace("111.32", "111.0") + """,
p AS (SELECT *, CASE WHEN acq >= origin - INTERVAL 12 DAY AND acq < origin THEN 'pre'
  WHEN acq >= origin AND acq <= origin + INTERVAL 12 DAY THEN 'post' END AS side,
  CAST(round_even((epoch_us(acq) - epoch_us(origin)) / 86400000000.0::DOUBLE, 0) AS BIGINT) AS signed_gap FROM allp)""",
          sql="""
SELECT event_id, side, scene_id, signed_gap FROM (SELECT *, row_number() OVER (
   PARTITION BY event_id, side ORDER BY abs(signed_gap), gap, scene_id) AS rn
 FROM p WHERE side IS NOT NULL AND source = 'Sentinel-1' AND scene_id % 2 = 1) WHERE rn = 1""")
def mask_granule(spark, d):
    """Nearest granule per side that carries the mask asset."""
    sc = D.scenes(spark, d).filter(F.col("source") == "Sentinel-1")
    df = S.granule_list(D.detections(spark, d), sc, pre_days=12, post_days=12)
    return S.nearest_with_asset(df, F.col("scene_id") % 2 == 1)


@register("archive_absence_reasons", sql="""
WITH o AS (SELECT o_orderkey, TIMESTAMP '2025-09-01 00:00:00' + ((o_orderkey * 31) % 400) * INTERVAL 1 DAY AS lo,
   TIMESTAMP '2026-09-20 00:00:00' AS now FROM orders),
q AS (SELECT *, lo + (1 + o_orderkey % 20) * INTERVAL 1 DAY AS hi FROM o)
SELECT o_orderkey, lo + INTERVAL 30 DAY >= TIMESTAMP '2025-10-17 00:00:00' AS applicable,
 CASE WHEN hi < TIMESTAMP '2025-10-17 00:00:00' THEN 'before_first_science'
      WHEN lo >= now - INTERVAL 3 DAY THEN 'too_recent'
      WHEN lo >= TIMESTAMP '2026-07-28 00:00:00' AND hi < TIMESTAMP '2026-08-10 00:00:00' THEN 'instrument_gap'
      WHEN greatest(0, least(epoch_us(hi), epoch_us(TIMESTAMP '2026-06-17 00:00:00'))
             - greatest(epoch_us(lo), epoch_us(TIMESTAMP '2026-01-21 00:00:00')))
           / (epoch_us(hi) - epoch_us(lo))::DOUBLE > 0.5 THEN 'reprocessing' END AS reason
FROM q""")
def absence(spark, d):
    """Could the archive hold anything, and why a window is empty."""
    k = F.col("o_orderkey")
    lo = F.lit("2025-09-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=((k * 31) % 400).cast("int"))
    o = D.table(spark, d, "orders").select(k, lo.alias("lo"))
    hi = F.col("lo") + F.make_dt_interval(days=(1 + k % 20).cast("int"))
    now = F.lit("2026-09-20 00:00:00").cast("timestamp_ntz")
    return o.select(k, S.archive_applicable(F.col("lo"), 30).alias("applicable"),
                    S.absence_reason(F.col("lo"), hi, now).alias("reason"))


@register("nearest_scene_outside_window", views=("det", "scenes"), extra=PAIRS + """,
s AS (SELECT * FROM allp WHERE source = 'NISAR'),
inside AS (SELECT DISTINCT event_id, CASE WHEN acq < origin THEN 'pre' ELSE 'post' END AS side FROM s
   WHERE acq >= origin - INTERVAL 1 DAY AND acq <= origin + INTERVAL 1 DAY),
wide AS (SELECT event_id, CASE WHEN acq < origin THEN 'pre' ELSE 'post' END AS side, scene_id, gap,
   row_number() OVER (PARTITION BY event_id, acq < origin ORDER BY gap, scene_id) AS rn FROM s),
sides AS (SELECT event_id, unnest(['pre', 'post']) AS side FROM det)""", sql="""
SELECT sides.event_id, sides.side, scene_id,
  CAST(CASE WHEN sides.side = 'pre' THEN ceil(gap) ELSE floor(gap) + 1 END AS BIGINT) AS widen_to_days
FROM sides ANTI JOIN inside USING (event_id, side) LEFT JOIN (SELECT * FROM wide WHERE rn = 1) w USING (event_id, side)""")
def outside(spark, d):
    """Nearest scene beyond the window for every empty side."""
    sc = D.scenes(spark, d).filter(F.col("source") == "NISAR")
    return S.nearest_outside(D.detections(spark, d), sc, pre_days=1, post_days=1)


SOURCES = ("Sentinel-2", "Landsat", "Sentinel-1", "Umbra")


@register("search_merge_sources", views=("det", "scenes"), extra=DAYP(6, 6) + """,
k AS (SELECT event_id, unnest(['Sentinel-2', 'Landsat', 'Sentinel-1', 'Umbra']) AS source_key FROM det),
n AS (SELECT k.event_id, k.source_key, count(*) FILTER (p.side = 'pre') AS n_pre, count(*) FILTER (p.side = 'post') AS n_post
  FROM k LEFT JOIN p ON p.event_id = k.event_id AND p.source = k.source_key GROUP BY ALL)""", sql="""
SELECT *, CASE WHEN source_key NOT IN (SELECT source FROM scenes) THEN 'failed' WHEN n_pre = 0 OR n_post = 0 THEN 'incomplete' END AS code FROM n""")
def merge(spark, d):
    """Several sources from one search, with what each found and which failed."""
    ev, sc = D.detections(spark, d), D.scenes(spark, d)
    found = S.search_sources(ev, sc, SOURCES, pre_days=6, post_days=6)
    return S.source_notes(ev, found, SOURCES, S.failed_sources(sc, SOURCES))


@register("search_merged_order", views=("det", "scenes"), extra=DAYP(6, 6) + """,
r AS (SELECT event_id, source AS source_key, side, scene_id, gap FROM p WHERE side IS NOT NULL AND source IN ('Sentinel-2', 'Landsat', 'Sentinel-1')
  UNION ALL SELECT event_id, 'PlanetScope', 'pre', scene_id, NULL FROM allp WHERE source = 'PlanetScope' AND scene_id % 7 = 0)""", sql="""
SELECT event_id, source_key, side, scene_id, row_number() OVER (PARTITION BY event_id ORDER BY gap NULLS LAST, source_key, scene_id) AS rank FROM r""")
def merged_order(spark, d):
    """Scenes of several sources and undated rows of another in one stable order."""
    ev, sc = D.detections(spark, d), D.scenes(spark, d)
    undated = S.overlapping_ever(ev, sc.filter((F.col("source") == "PlanetScope") & (F.col("scene_id") % 7 == 0))).select(
        "event_id", F.col("source").alias("source_key"), F.lit("pre").alias("side"), "scene_id", F.lit(None).cast("double").alias("gap"))
    rows = S.merged_order(S.search_sources(ev, sc, SOURCES, pre_days=6, post_days=6), undated)
    return rows.select("event_id", "source_key", "side", "scene_id", "rank")


@register("optical_source_order", sql="""
SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 19 YEAR >= TIMESTAMP '2016-01-01 00:00:00'
  THEN 'Sentinel-2,Landsat' ELSE 'Landsat' END AS sources FROM orders""")
def source_order(spark, d):
    """No Sentinel-2 before 2016."""
    o = D.table(spark, d, "orders")
    origin = F.col("o_orderdate").cast("timestamp_ntz") + F.make_ym_interval(F.lit(19), F.lit(0))
    return o.select("o_orderkey", F.array_join(S.optical_sources(origin), ",").alias("sources"))


@register("rank_top_six_by_cost", views=("det", "scenes"), extra=DAYP(12, 12), sql="""
SELECT event_id, side, scene_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side
   ORDER BY gap + 0.5 * coalesce(cloud_pct, 100), scene_id) AS rn FROM p WHERE side IS NOT NULL) WHERE rn <= 6""")
def top6(spark, d):
    """The six scenes a run composites."""
    return R.best_by_cost(found(spark, d), R.RUN_LIMIT).select("event_id", "side", "scene_id", F.col("rank"))


@register("rank_nearest_then_clearest", views=("det", "scenes"), extra=DAYP(70, 12), sql="""
SELECT event_id, side, scene_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side
   ORDER BY round_even(gap, 0), coalesce(cloud_pct, 100), scene_id) AS rn FROM p WHERE side IS NOT NULL)
WHERE rn <= CASE side WHEN 'pre' THEN 14 ELSE 12 END""")
def nearest_clear(spark, d):
    """Nearest day, then clearest, with a limit growing with the window."""
    return R.adaptive_listing(found(spark, d, 70, 12), 70, 12).select("event_id", "side", "scene_id", F.col("rank"))


@register("one_frame_per_pass", views=("det", "scenes"), extra=DAYP(12, 12) + """,
q AS (SELECT *, sqrt(pow(greatest(w - lon, lon - e, 0), 2) + pow(greatest(s - lat, lat - n, 0), 2)) AS dist
  FROM p WHERE side IS NOT NULL AND source IN ('Sentinel-1', 'NISAR'))""", sql="""
SELECT event_id, side, relative_orbit, arg_min(scene_id, (CASE WHEN dist > 0 THEN 1 ELSE 0 END, dist, gap, scene_id)) AS scene_id,
   round(min(gap), 6) AS pass_gap FROM q GROUP BY event_id, side, relative_orbit, day""")
def frames(spark, d):
    """One frame per pass, the one imaging the event."""
    sc = D.scenes(spark, d).filter(F.col("source").isin("Sentinel-1", "NISAR"))
    df = S.scene_search(D.detections(spark, d), sc, pre_days=12, post_days=12)
    dist = R.point_box_distance(F.col("bbox"), F.col("lon"), F.col("lat"))
    return R.one_frame_per_pass(df, dist > 0, dist).select(
        "event_id", "side", "relative_orbit", "scene_id", F.round("pass_gap", 6).alias("pass_gap"))


@register("one_scene_per_day", views=("det", "scenes"), extra=DAYP(12, 12), sql="""
SELECT event_id, side, arg_min(scene_id, (gap, scene_id)) AS scene_id FROM p WHERE side IS NOT NULL
GROUP BY event_id, side, day""")
def per_day(spark, d):
    """Nearest scene of every acquisition day."""
    return R.one_per_day(found(spark, d)).select("event_id", "side", "scene_id")


@register("review_rank_star_and_ticks", views=("det", "scenes"), extra=DAYP(12, 12) + """,
q AS (SELECT *, greatest(0, least(ae, e) - greatest(aw, w)) * greatest(0, least(an, n) - greatest(as_, s))
     / ((ae - aw) * (an - as_)) AS cov, w <= lon AND lon <= e AND s <= lat AND lat <= n AS covers
  FROM p WHERE side IS NOT NULL AND scene_id % 11 <> 0)""", sql="""
SELECT event_id, side, scene_id, rn AS rank, rn = 1 AS star FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side
   ORDER BY covers DESC, round_even(cov * 20, 0) DESC, coalesce(cloud_pct, 100), gap, scene_id) AS rn FROM q) WHERE rn <= 6""")
def review(spark, d):
    """Review order with star and ticks, unusable scenes dropped."""
    df = found(spark, d)
    out = R.review_rank(df, geo.overlap_fraction(F.col("aoi"), F.col("bbox")), S.covers_point(df),
                        F.lit(None).cast("double"), F.col("scene_id") % 11 == 0)
    return out.select("event_id", "side", "scene_id", F.col("rank"), "star")


@register("first_source_with_both_sides", views=("det", "scenes"), extra=DAYP(2, 2) + """,
g AS (SELECT event_id, source, count(*) FILTER (side = 'pre') AS n_pre, count(*) FILTER (side = 'post') AS n_post
  FROM p WHERE source IN ('Sentinel-2', 'Landsat', 'PlanetScope') GROUP BY 1, 2)""", sql="""
SELECT event_id, source, n_pre, n_post FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY
   list_position(['Sentinel-2', 'Landsat', 'PlanetScope'], source)) AS rn FROM g WHERE n_pre > 0 AND n_post > 0) WHERE rn = 1""")
def auto_source(spark, d):
    """First source by priority with both sides."""
    return R.first_two_sided_source(found(spark, d, 2, 2), ["Sentinel-2", "Landsat", "PlanetScope"])


@register("nearest_scene_as_of_event", views=("det", "scenes"), extra=ORIP(12, 12), sql="""
SELECT event_id, side, arg_min(scene_id, (gap, scene_id)) AS scene_id, round(min(gap), 6) AS gap
FROM p WHERE side IS NOT NULL GROUP BY ALL""")
def as_of(spark, d):
    """Nearest before and after scene."""
    return R.nearest_per_side(found(spark, d, rule="origin"))
