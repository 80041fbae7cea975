"""Strip triage and radar pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import register
from registry.catalog import DAYP, ORIP, PAIRS
from siltmark.functions import geo, timing
from siltmark.functions import viewgeom as V
from siltmark.operators import pairing as P
from siltmark.operators import search as S
from siltmark.operators import vhr
from siltmark.sources import driver_tables as D

PRE, POST = 25, 20
ALT = "(CASE sensor WHEN 'WV01' THEN 496 WHEN 'WV02' THEN 770 WHEN 'WV03' THEN 617 WHEN 'GE01' THEN 681 ELSE 650 END)"
INC = f"degrees(asin((6371 + {ALT}) / 6371.0::DOUBLE * sin(radians(ona))))"
CTX = "(third_party OR sensor_type = 'Radar' OR product_name <> 'DAILY_TAKE')"
GRADE = f"""CASE WHEN {CTX} THEN 'context' WHEN processing_level = 'LV2A' THEN 'visual'
   WHEN ona <= 30 THEN 'mapping' ELSE 'visual' END"""

# strip edges of these tables lie on the event point or kilometres away, so the shared
# part of a circle is a product of 0, 1/2 and 1
STR = """aoi AS (SELECT *, lon - 3.3 / (111.32 * cos(radians(lat))) AS aw, lat - 3.3 / 111.32 AS as_,
    lon + 3.3 / (111.32 * cos(radians(lat))) AS ae, lat + 3.3 / 111.32 AS an FROM det),
kept AS (SELECT * FROM strips WHERE product_name <> 'VIVID_BASIC'),
j AS (SELECT a.*, s.*, CASE WHEN acq < origin THEN 'pre' ELSE 'post' END AS side,
    abs(epoch_us(acq) - epoch_us(origin)) / 86400000000.0::DOUBLE AS gap,
    (CASE WHEN w < lon AND lon < e THEN 1 WHEN w = lon OR e = lon THEN 0.5::DOUBLE ELSE 0 END)
    * (CASE WHEN s < lat AND lat < n THEN 1 WHEN s = lat OR n = lat THEN 0.5::DOUBLE ELSE 0 END) AS cover,
    w <= lon AND lon < e AND s <= lat AND lat < n AS covers
  FROM aoi a JOIN kept s ON s.w <= a.ae AND a.aw <= s.e AND s.s <= a.an AND a.as_ <= s.n
    AND acq >= origin - INTERVAL 25 DAY AND acq <= origin + INTERVAL 20 DAY),
g AS (SELECT *, %s AS grade, %s AS inc FROM j WHERE cover > 0 OR covers),
sc AS (SELECT *, gap / CASE side WHEN 'pre' THEN 30.0::DOUBLE ELSE 15.0::DOUBLE END + 2 * tan(radians(least(inc, 89)))
    + 0.5 * greatest(0, 25 - sun_el) / 10 + (1 - cover) + CASE WHEN covers THEN 0 ELSE 3 END + 0.5 * cloud AS score,
    CASE WHEN third_party THEN 1 ELSE 0 END + CASE WHEN grade = 'visual' AND ona > 45 THEN 1 ELSE 0 END
    + CASE WHEN sun_el < 15 THEN 1 ELSE 0 END + CASE WHEN cloud * 100 > 30 THEN 1 ELSE 0 END AS n_reasons FROM g)""" % (GRADE, INC)


def kept(spark, d):
    s = D.strips(spark, d)
    return vhr.unique_strips(s.filter(~V.excluded(F.col("product_name"))))


def joined(spark, d):
    return vhr.cover_join(D.detections(spark, d), kept(spark, d), pre_days=PRE, post_days=POST)


def graded(spark, d):
    return vhr.grade_and_score(joined(spark, d), cloud_max=30.0)


@register("strip_circle_cover", views=("det", "strips"), extra=STR, sql="""
SELECT event_id, feature_id, side, round(cover, 6) AS cover, covers FROM j""")
def q_cover(spark, d):
    """Share of the search circle each strip covers."""
    return joined(spark, d).select("event_id", "feature_id", "side", F.round("cover", 6).alias("cover"), "covers")


@register("strip_incidence_and_shift", views=("strips",), sql=f"""
SELECT feature_id, round({INC}, 6) AS incidence, round(50 * tan(radians(least({INC}, 89))), 6) AS shift50 FROM strips""")
def q_inc(spark, d):
    """Incidence at the ground and relief shift per 50 m."""
    i = V.incidence_deg(F.col("ona"), F.col("sensor"))
    return D.strips(spark, d).select("feature_id", F.round(i, 6).alias("incidence"),
                                     F.round(V.relief_shift_m(F.col("ona"), F.col("sensor")), 6).alias("shift50"))


@register("strip_grade_and_score", views=("det", "strips"), extra=STR, sql="""
SELECT event_id, feature_id, side, grade, round(score, 6) AS score, n_reasons > 0 AS hidden FROM sc""")
def q_grade(spark, d):
    """Grade, score and hidden flag of every strip."""
    return graded(spark, d).select("event_id", "feature_id", "side", "grade", F.round("score", 6).alias("score"), "hidden")


@register("strip_list_order", views=("det", "strips"), extra=STR, sql="""
SELECT event_id, side, feature_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY n_reasons > 0,
  CASE grade WHEN 'mapping' THEN 0 WHEN 'visual' THEN 1 ELSE 2 END, round(score, 9), feature_id) AS rn FROM sc)""")
def q_list(spark, d):
    """Each side's whole list: listed before hidden, then grade, score, id."""
    from siltmark.operators.ranking import ranked_per_side
    ls = vhr.listing(graded(spark, d).withColumn("score", F.round("score", 9)))
    return ranked_per_side(ls, ("sort_key",)).select("event_id", "side", "feature_id", F.col("rank"))


BEST = STR + """,
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY score, feature_id) AS rn FROM sc
   WHERE n_reasons = 0 AND grade = 'mapping') WHERE rn <= 5),
pc AS (SELECT a.event_id, a.feature_id AS star_pre, b.feature_id AS star_post, a.score + b.score + 0.1 * abs(a.sun_el - b.sun_el)
   + 0.0167 * least(abs(a.sun_az - b.sun_az) % 360, 360 - abs(a.sun_az - b.sun_az) % 360)
   + 0.5 * abs(tan(radians(least(a.inc, 89))) - tan(radians(least(b.inc, 89)))) AS cost
  FROM tp a JOIN tp b ON a.event_id = b.event_id AND a.side = 'pre' AND b.side = 'post')"""


@register("strip_best_pair", views=("det", "strips"), extra=BEST, sql="""
SELECT event_id, star_pre, star_post, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY event_id
  ORDER BY cost, star_pre, star_post) AS rn FROM pc) WHERE rn = 1
UNION ALL SELECT event_id, CASE side WHEN 'pre' THEN feature_id END, CASE side WHEN 'post' THEN feature_id END, round(score, 6)
FROM tp WHERE rn = 1 AND event_id NOT IN (SELECT event_id FROM pc)""")
def q_pair(spark, d):
    """Cheapest pair of the top five mapping strips per side."""
    return vhr.best_pair(graded(spark, d)).withColumn("cost", F.round("cost", 6))


@register("strip_stereo_mates", views=("strips",), extra="""
o AS (SELECT feature_id, sensor, epoch_us(acq) AS t FROM strips WHERE sensor_type <> 'Radar'),
m AS (SELECT a.feature_id, a.sensor, count(*) - 1 AS n_mates, (a.t - min(b.t)) / 1000000.0::DOUBLE AS run_back_s,
   (max(b.t) - a.t) / 1000000.0::DOUBLE AS run_ahead_s FROM o a JOIN o b ON a.sensor = b.sensor AND abs(a.t - b.t) < 300000000
   GROUP BY a.feature_id, a.sensor, a.t)""", sql="SELECT 0 AS site, * FROM m WHERE n_mates > 0")
def q_stereo(spark, d):
    """Same-sensor optical strips under five minutes apart."""
    return vhr.stereo_mates(D.strips(spark, d).withColumn("site", F.lit(0)), ("site",))


@register("strip_stereo_mate_ids", views=("strips",), extra="""
o AS (SELECT feature_id, sensor, epoch_us(acq) AS t FROM strips WHERE sensor_type <> 'Radar')""", sql="""
SELECT 0 AS site, a.sensor, a.feature_id, b.feature_id AS mate_id, (b.t - a.t) / 1000000.0::DOUBLE AS ahead_s
FROM o a JOIN o b ON a.sensor = b.sensor AND a.feature_id <> b.feature_id AND abs(a.t - b.t) < 300000000""")
def q_mates(spark, d):
    """The mates of every strip by id, and how much later each was taken."""
    return vhr.stereo_mate_ids(D.strips(spark, d).withColumn("site", F.lit(0)), ("site",))


@register("strip_hide_reasons_top", views=("det", "strips"), extra=STR + """,
r AS (SELECT event_id, side, unnest(list_filter([CASE WHEN third_party THEN 'third-party' END,
   CASE WHEN grade = 'visual' AND ona > 45 THEN 'off-nadir > 45°' END, CASE WHEN sun_el < 15 THEN 'low sun' END,
   CASE WHEN cloud * 100 > 30 THEN 'strip cloud' END], lambda x: x IS NOT NULL)) AS reason FROM sc),
n AS (SELECT event_id, side, reason, count(*) AS n FROM r GROUP BY ALL)""", sql="""
SELECT event_id, side, reason, n, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY n DESC, reason) AS rn FROM n)
WHERE rn <= 3""")
def q_reasons(spark, d):
    """Three commonest hide reasons per event and side."""
    return vhr.reason_counts(graded(spark, d)).select("event_id", "side", "reason", "n", F.col("rank"))


@register("strip_counters", views=("det", "strips"), extra=STR, sql="""
SELECT d.event_id, count(j.feature_id) FILTER (NOT (j.cover > 0 OR j.covers)) AS n_outside,
 count(s.feature_id) FILTER (s.side = 'pre') AS listed_pre, count(s.feature_id) FILTER (s.side = 'post') AS listed_post,
 count(s.feature_id) FILTER (s.side = 'pre' AND n_reasons = 0) AS visible_pre,
 count(s.feature_id) FILTER (s.side = 'post' AND n_reasons = 0) AS visible_post
FROM det d LEFT JOIN j ON j.event_id = d.event_id LEFT JOIN sc s ON s.event_id = j.event_id AND s.feature_id = j.feature_id GROUP BY 1""")
def q_counters(spark, d):
    """Outside, listed and visible strips per event."""
    j = joined(spark, d)
    c = vhr.counters(D.detections(spark, d), j, vhr.grade_and_score(j, cloud_max=30.0))
    return c.select("event_id", "n_outside", "listed_pre", "listed_post", "visible_pre", "visible_post")


@register("strip_empty_state", views=("det", "strips"), extra=STR + """,
c AS (SELECT d.event_id, d.origin, count(j.feature_id) AS n_all, count(s.feature_id) AS listed,
   count(s.feature_id) FILTER (s.side = 'pre') AS lp, count(s.feature_id) FILTER (s.side = 'post') AS lq,
   count(s.feature_id) FILTER (s.side = 'pre' AND n_reasons = 0) AS vp, count(s.feature_id) FILTER (s.side = 'post' AND n_reasons = 0) AS vq,
   count(s.feature_id) FILTER (s.side = 'pre' AND grade = 'context') AS cp, count(s.feature_id) FILTER (s.side = 'post' AND grade = 'context') AS cq
  FROM det d LEFT JOIN j ON j.event_id = d.event_id LEFT JOIN sc s ON s.event_id = j.event_id AND s.feature_id = j.feature_id
  GROUP BY ALL)""", sql="""
SELECT event_id, CASE WHEN n_all = 0 THEN 'before_archive' WHEN listed = 0 THEN 'outside_circle' ELSE
  concat_ws(',', CASE WHEN vp = 0 AND vq = 0 THEN 'all_hidden' END,
   CASE WHEN lp - cp = 0 THEN 'no_pre' WHEN vp = 0 AND vq > 0 THEN 'pre_hidden' END,
   CASE WHEN lq - cq = 0 THEN 'no_post_winter' WHEN vq = 0 AND vp > 0 THEN 'post_hidden' END) END AS codes FROM c""")
def q_empty(spark, d):
    """What is missing for each event."""
    j = joined(spark, d)
    c = vhr.counters(D.detections(spark, d), j, vhr.grade_and_score(j, cloud_max=30.0))
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    return vhr.empty_state(c, now, POST, PRE).select("event_id", F.array_join("codes", ",").alias("codes"))


@register("strip_triage", views=("det", "strips"), extra=BEST + """,
c AS (SELECT d.event_id, d.origin, count(j.feature_id) AS n_all, count(s.feature_id) AS listed,
   count(s.feature_id) FILTER (s.side = 'pre') AS lp, count(s.feature_id) FILTER (s.side = 'post') AS lq,
   count(s.feature_id) FILTER (s.side = 'pre' AND n_reasons = 0) AS vp, count(s.feature_id) FILTER (s.side = 'post' AND n_reasons = 0) AS vq,
   count(s.feature_id) FILTER (s.side = 'pre' AND grade = 'context') AS cp, count(s.feature_id) FILTER (s.side = 'post' AND grade = 'context') AS cq
  FROM det d LEFT JOIN j ON j.event_id = d.event_id LEFT JOIN sc s ON s.event_id = j.event_id AND s.feature_id = j.feature_id
  GROUP BY ALL),
st AS (SELECT event_id, star_pre, star_post, round(cost, 6) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cost, star_pre, star_post) AS rn FROM pc) WHERE rn = 1
  UNION ALL SELECT event_id, CASE side WHEN 'pre' THEN feature_id END, CASE side WHEN 'post' THEN feature_id END, round(score, 6) FROM tp WHERE rn = 1 AND event_id NOT IN (SELECT event_id FROM pc)),
ms AS (SELECT a.event_id, count(DISTINCT a.feature_id) AS n_stereo FROM sc a JOIN sc b ON a.event_id = b.event_id AND a.sensor = b.sensor AND a.feature_id <> b.feature_id
  AND a.sensor_type <> 'Radar' AND b.sensor_type <> 'Radar' AND abs(epoch_us(a.acq) - epoch_us(b.acq)) < 300000000 GROUP BY 1)""", sql="""
SELECT c.event_id, star_pre, star_post, cost, n_all - listed AS n_outside, lp AS listed_pre, lq AS listed_post, vp AS visible_pre, vq AS visible_post, coalesce(n_stereo, 0) AS n_stereo,
  CASE WHEN n_all = 0 THEN 'before_archive' WHEN listed = 0 THEN 'outside_circle' ELSE
  concat_ws(',', CASE WHEN vp = 0 AND vq = 0 THEN 'all_hidden' END,
   CASE WHEN lp - cp = 0 THEN 'no_pre' WHEN vp = 0 AND vq > 0 THEN 'pre_hidden' END,
   CASE WHEN lq - cq = 0 THEN 'no_post_winter' WHEN vq = 0 AND vp > 0 THEN 'post_hidden' END) END AS codes FROM c LEFT JOIN st USING (event_id) LEFT JOIN ms USING (event_id)""")
def q_triage(spark, d):
    """P5: the whole triage of every event from one circle clip."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    out = vhr.triage(D.detections(spark, d), D.strips(spark, d), now, pre_days=PRE, post_days=POST, cloud_max=30.0)
    return out.select("event_id", "star_pre", "star_post", F.round("cost", 6).alias("cost"), "n_outside", "listed_pre", "listed_post", "visible_pre", "visible_post", "n_stereo",
                      F.array_join("codes", ",").alias("codes"))


# ------------------------------------------------------------------ radar pairing
SAR = ORIP(12, 12) + """,
rd AS (SELECT *, w <= lon AND lon <= e AND s <= lat AND lat <= n AS covers FROM p
   WHERE side IS NOT NULL AND source IN ('Sentinel-1', 'NISAR')),
cv AS (SELECT * FROM (SELECT *, bool_or(covers) OVER (PARTITION BY event_id, source, side) AS any_c FROM rd) WHERE covers = any_c),
po AS (SELECT event_id, source, arg_min({'id': scene_id, 'acq': acq, 'track': relative_orbit, 'dir': orbit_state}, (gap, scene_id)) AS post
   FROM cv WHERE side = 'post' GROUP BY ALL),
pr AS (SELECT cv.*, post, CASE WHEN relative_orbit = post.track THEN 0 WHEN orbit_state = post.dir THEN 1 ELSE 2 END AS prio
   FROM cv JOIN po USING (event_id, source) WHERE side = 'pre')"""


def radar_scenes(spark, d):
    sc = D.scenes(spark, d).filter(F.col("source").isin("Sentinel-1", "NISAR"))
    return S.scene_search(D.detections(spark, d), sc, pre_days=12, post_days=12, rule="origin")


def covering(spark, d):
    r = radar_scenes(spark, d)
    return P.prefer_covering(r, S.covers_point(r))


@register("radar_best_pair", views=("det", "scenes"), extra=SAR, sql="""
SELECT k.event_id, k.source, coalesce(a.pre_id, CASE WHEN po.post IS NULL THEN lone.pre_id END) AS pre_id, po.post.id AS post_id, coalesce(a.x, false) AS cross_orbit
FROM (SELECT DISTINCT event_id, source FROM cv) k LEFT JOIN po USING (event_id, source)
LEFT JOIN (SELECT event_id, source, arg_min(scene_id, (prio, gap, scene_id)) AS pre_id, min(prio) = 2 AS x FROM pr GROUP BY ALL) a USING (event_id, source)
LEFT JOIN (SELECT event_id, source, arg_min(scene_id, (gap, scene_id)) AS pre_id FROM cv WHERE side = 'pre' GROUP BY ALL) lone USING (event_id, source)""")
def q_rpair(spark, d):
    """Nearest after-scene with its same-track (else same-direction) before-scene."""
    out = P.best_geometry_pair(covering(spark, d))
    return out.select("event_id", "source", F.col("pre.scene_id").alias("pre_id"), F.col("post.scene_id").alias("post_id"), "cross_orbit")


@register("radar_pair_both_directions", views=("det", "scenes"), extra=SAR + """,
pd AS (SELECT event_id, source, orbit_state, arg_min({'id': scene_id, 'track': relative_orbit}, (gap, scene_id)) AS post FROM cv WHERE side = 'post' GROUP BY ALL),
qd AS (SELECT cv.*, pd.post, CASE WHEN relative_orbit = pd.post.track THEN 0 ELSE 1 END AS prio FROM cv JOIN pd USING (event_id, source, orbit_state) WHERE side = 'pre')""",
          sql="""SELECT event_id, source, orbit_state, arg_min(scene_id, (prio, gap, scene_id)) AS pre_id, any_value(post.id) AS post_id FROM qd GROUP BY ALL""")
def q_both(spark, d):
    """One pair on each orbit direction."""
    out = P.best_geometry_pair(covering(spark, d), by_direction=True).filter(F.col("pre").isNotNull() & F.col("post").isNotNull())
    return out.select("event_id", "source", "orbit_state", F.col("pre.scene_id").alias("pre_id"), F.col("post.scene_id").alias("post_id"))


@register("radar_pair_bracket", views=("det", "scenes"), extra=SAR + """,
bp AS (SELECT event_id, source, any_value(origin) AS origin, any_value(post) AS q,
   arg_min({'id': scene_id, 'acq': acq, 'track': relative_orbit, 'dir': orbit_state}, (prio, gap, scene_id)) AS p FROM pr GROUP BY ALL),
n AS (SELECT *, CAST(round_even((epoch_us(origin) - epoch_us(p.acq)) / 86400000000.0::DOUBLE, 0) AS BIGINT) AS pre_days,
   CAST(round_even((epoch_us(q.acq) - epoch_us(origin)) / 86400000000.0::DOUBLE, 0) AS BIGINT) AS post_days,
   CAST(round_even((epoch_us(q.acq) - epoch_us(p.acq)) / 86400000000.0::DOUBLE, 0) AS BIGINT) AS span_days,
   p.track = q.track AND p.dir = q.dir AS same_geometry FROM bp)""", sql="""
SELECT event_id, source, pre_days, post_days, span_days, same_geometry,
 (CASE source WHEN 'NISAR' THEN 'NISAR ' ELSE '' END) || (CASE q.dir WHEN 'ascending' THEN 'ASC' ELSE 'DESC' END) || '·T' || q.track
 || ': pre −' || pre_days || ' d (' || strftime(p.acq, '%d %b') || ') · post +' || post_days || ' d (' || strftime(q.acq, '%d %b')
 || ') · ' || span_days || ' d span · ' || CASE WHEN same_geometry THEN 'same track ✓' ELSE '⚠ cross-orbit — geometry differs' END AS label FROM n""")
def q_bracket(spark, d):
    """How the pair brackets the event."""
    return P.pair_bracket(P.best_geometry_pair(covering(spark, d)), D.detections(spark, d)).filter(F.col("span_days").isNotNull())


CD = ORIP(20, 12) + """,
s1 AS (SELECT *, w <= lon AND lon <= e AND s <= lat AND lat <= n AS covers FROM p WHERE side IS NOT NULL AND source = 'Sentinel-1'),
dy AS (SELECT event_id, relative_orbit, day, arg_min(scene_id, (gap, scene_id)) AS scene_id, min(gap) AS gap FROM s1
   WHERE side = 'pre' AND covers GROUP BY ALL),
nr AS (SELECT *, row_number() OVER (PARTITION BY event_id, relative_orbit ORDER BY gap, scene_id) AS rn FROM dy),
stk AS (SELECT event_id, relative_orbit, max(gap) FILTER (rn = 3) AS stale, count(*) AS n_dates FROM nr GROUP BY ALL),
po AS (SELECT * FROM (SELECT *, bool_or(covers) OVER (PARTITION BY event_id) AS anyc FROM s1 WHERE side = 'post') WHERE covers = anyc),
cd AS (SELECT * FROM (SELECT po.*, stale, n_dates, row_number() OVER (PARTITION BY po.event_id ORDER BY stale IS NULL,
   CASE WHEN stale IS NOT NULL THEN day END, stale, gap, scene_id) AS rn FROM po LEFT JOIN stk USING (event_id, relative_orbit)) WHERE rn = 1)"""


def s1_scenes(spark, d):
    sc = D.scenes(spark, d).filter(F.col("source") == "Sentinel-1")
    return S.scene_search(D.detections(spark, d), sc, pre_days=20, post_days=12, rule="origin")


@register("change_detection_post_scene", views=("det", "scenes"), extra=CD, sql="""
SELECT event_id, scene_id, relative_orbit, stale IS NOT NULL AS usable, round(stale, 6) AS stale, n_dates FROM cd""")
def q_cdpost(spark, d):
    """After-scene on a track that can be differenced, freshest before-stack first."""
    s = s1_scenes(spark, d)
    return P.change_post(s, S.covers_point(s), 3).withColumn("stale", F.round("stale", 6))


@register("change_detection_plan", views=("det", "scenes"), extra=CD, sql="""
SELECT cd.event_id, any_value(cd.scene_id) AS post_id, any_value(cd.relative_orbit) AS relative_orbit, count(nr.scene_id) AS n_pre,
  concat_ws(',', CASE WHEN count(nr.scene_id) >= 3 THEN 'mtcorr' END, CASE WHEN count(nr.scene_id) >= 2 THEN 'tsint' END,
   CASE WHEN count(nr.scene_id) >= 2 THEN 'intcorr' END, CASE WHEN count(nr.scene_id) >= 1 THEN 'logratio' END) AS detectors,
  coalesce(string_agg(nr.scene_id::VARCHAR, ',' ORDER BY nr.rn) FILTER (nr.rn <= n_take), '') AS pre_ids
FROM (SELECT cd.*, CASE WHEN coalesce(n_dates, 0) >= 2 THEN 6 ELSE coalesce(n_dates, 0) END AS n_take FROM cd) cd
LEFT JOIN nr ON nr.event_id = cd.event_id AND nr.relative_orbit = cd.relative_orbit AND nr.rn <= 6 GROUP BY 1""")
def q_cdplan(spark, d):
    """Detectors that can run and their before-scenes."""
    s = s1_scenes(spark, d)
    p = P.change_plan(s, S.covers_point(s))
    return p.select("event_id", "post_id", "relative_orbit", "n_pre", F.array_join("detectors", ",").alias("detectors"),
                    F.array_join(F.transform("pre_ids", lambda x: x.cast("string")), ",").alias("pre_ids"))


@register("footprint_best_partner", views=("scenes",), extra="""
a AS (SELECT scene_id AS anchor_id, w + 0.25 AS aw, s + 0.25 AS as_, e - 0.25 AS ae, n - 0.25 AS an FROM scenes WHERE source = 'Sentinel-2'),
b AS (SELECT scene_id AS partner_id, w, s, e, n FROM scenes WHERE source = 'NISAR'),
m AS (SELECT *, (least(ae, e) - greatest(aw, w)) * (least(an, n) - greatest(as_, s)) AS inter, (ae - aw) * (an - as_) AS fa, (e - w) * (n - s) AS fb
  FROM a JOIN b ON w <= ae AND aw <= e AND s <= an AND as_ <= n)""", sql="""
SELECT anchor_id, partner_id, round(agree, 6) AS agree, round(covered, 6) AS covered FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id
   ORDER BY agree DESC, partner_id) AS rn FROM (SELECT *, inter / fa AS covered, least(inter / fa, inter / fb) AS agree FROM m) WHERE covered >= 0.6) WHERE rn = 1""")
def q_partner(spark, d):
    """Best footprint match among partners covering 60% of the anchor."""
    sc = D.scenes(spark, d)
    b = F.col("bbox")
    inner = F.struct((b["w"] + 0.25).alias("w"), (b["s"] + 0.25).alias("s"), (b["e"] - 0.25).alias("e"), (b["n"] - 0.25).alias("n"))
    a = sc.filter(F.col("source") == "Sentinel-2").select(F.col("scene_id").alias("anchor_id"), inner.alias("a_box"))
    p = sc.filter(F.col("source") == "NISAR").select(F.col("scene_id").alias("partner_id"), F.col("bbox").alias("p_box"))
    return P.footprint_partner(a, p).withColumns({"agree": F.round("agree", 6), "covered": F.round("covered", 6)})


@register("sibling_layers", views=("scenes",), sql="""
SELECT scene_id % 50 AS event_id, CAST(acq AS DATE) AS pre_date, CAST(acq + INTERVAL 12 DAY AS DATE) AS post_date, source AS radar,
  array_to_string(list_sort(list(DISTINCT 'k' || relative_orbit)), ',') AS kinds, count(*) AS n_layers FROM scenes GROUP BY 1, 2, 3, 4""")
def q_sibling(spark, d):
    """Layers of the same event and pair of dates."""
    s = D.scenes(spark, d).select((F.col("scene_id") % 50).alias("event_id"), F.col("acq").cast("date").alias("pre_date"),
                                  (F.col("acq") + F.expr("INTERVAL 12 DAYS")).cast("date").alias("post_date"),
                                  F.col("source").alias("radar"), F.concat(F.lit("k"), F.col("relative_orbit").cast("string")).alias("kind"))
    return P.sibling_layers(s).withColumn("kinds", F.array_join("kinds", ","))


@register("mixed_product_warning", views=("scenes",), sql="""
SELECT scene_id % 900 AS event_id, array_to_string(list_sort(list(DISTINCT CASE WHEN scene_id % 7 < 4 THEN 'provisional' WHEN scene_id % 7 < 6 THEN 'beta' ELSE 'other_v1' END)), ',') AS products,
  count(DISTINCT CASE WHEN scene_id % 7 < 4 THEN 'provisional' WHEN scene_id % 7 < 6 THEN 'beta' ELSE 'other_v1' END) > 1 AS mixed FROM scenes GROUP BY 1""")
def q_mixed(spark, d):
    """Product tag of a collection and the mixed-product warning."""
    i = F.col("scene_id")
    c = F.when(i % 7 < 4, "L2_GCOV_PROVISIONAL_V1").when(i % 7 < 6, "L2_GCOV_BETA_V1").otherwise("OTHER_V1")
    return P.mixed_products(D.scenes(spark, d).select((i % 900).alias("event_id"), c.alias("collection"))).withColumn(
        "products", F.array_join("products", ","))


@register("local_time_labels", views=("scenes",), sql="""
SELECT scene_id, strftime(l, '%Y-%m-%d %H:%M') || CASE WHEN dst THEN ' AKDT' ELSE ' AKST' END || CASE WHEN CAST(l AS DATE) < CAST(t AS DATE) THEN ' (previous day)' ELSE '' END AS label
FROM (SELECT scene_id, t, dst, t - CASE WHEN dst THEN INTERVAL 8 HOUR ELSE INTERVAL 9 HOUR END AS l FROM (
 SELECT scene_id, t, t >= TIMESTAMP '2024-03-10 11:00:00' AND t < TIMESTAMP '2024-11-03 10:00:00' AS dst
 FROM (SELECT scene_id, acq + (scene_id % 300) * INTERVAL 1 DAY AS t FROM scenes)))""")
def q_local(spark, d):
    """Alaska wall time with the previous-day flag."""
    s = D.scenes(spark, d)
    t = F.col("acq") + F.make_dt_interval(days=(F.col("scene_id") % 300).cast("int"))
    return s.select("scene_id", timing.local_label(t).alias("label"))


@register("offsets_and_bearings", views=("scenes",), extra="""
q AS (SELECT scene_id, 60.0::DOUBLE AS a1, -150.0::DOUBLE AS o1, 60.0::DOUBLE + (scene_id % 101 - 50) / 200.0::DOUBLE AS a2,
   -150.0::DOUBLE + (scene_id * 7 % 103 - 51) / 100.0::DOUBLE AS o2 FROM scenes),
h AS (SELECT *, 2 * 6371.0088 * asin(sqrt(least(1, pow(sin((radians(a2) - radians(a1)) / 2), 2)
   + cos(radians(a1)) * cos(radians(a2)) * pow(sin(radians(o2 - o1) / 2), 2)))) AS km,
   degrees(atan2(sin(radians(o2 - o1)) * cos(radians(a2)), cos(radians(a1)) * sin(radians(a2)) - sin(radians(a1)) * cos(radians(a2)) * cos(radians(o2 - o1)))) AS b FROM q)""",
          sql="""SELECT scene_id, round(km, 6) AS km, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 6) AS bearing,
  CASE WHEN km < 0.05 THEN printf('%.0f m', km * 1000) || ' from seismic location' ELSE
  CASE WHEN km < 1 THEN printf('%.0f m', km * 1000) WHEN km < 10 THEN printf('%.2f km', km) ELSE printf('%.1f km', km) END || ' '
  || ['N','NE','E','SE','S','SW','W','NW'][CAST(floor((CASE WHEN b < 0 THEN b + 360 ELSE b END + 22.5) / 45) AS INTEGER) % 8 + 1] || ' of seismic location' END AS text FROM h""")
def q_offset(spark, d):
    """Great-circle distance, bearing and offset text."""
    i = F.col("scene_id")
    s = D.scenes(spark, d).select("scene_id", F.lit(60.0).alias("a1"), F.lit(-150.0).alias("o1"),
                                  (F.lit(60.0) + (i % 101 - 50) / 200.0).alias("a2"), (F.lit(-150.0) + (i * 7 % 103 - 51) / 100.0).alias("o2"))
    c = [F.col(x) for x in ("a1", "o1", "a2", "o2")]
    return s.select("scene_id", F.round(geo.haversine_km(*c), 6).alias("km"), F.round(geo.bearing_deg(*c), 6).alias("bearing"),
                    geo.offset_text(*c).alias("text"))
