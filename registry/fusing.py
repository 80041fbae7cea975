"""Evidence ranks, fusion, geometry merging, blobs, candidates and terrain masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import register
from registry.detectors import KEYS, STACK, TILE, box, frame, rounded
from registry.pixels import COMP, change
from siltmark.functions import radar
from siltmark.operators import blobs as B
from siltmark.operators import focal, fusion, sar, terrain
from siltmark.operators import merge as M
from siltmark.sources import driver_tables as D

# long evidence layers: the optical changes of every cell
LAYERS = COMP + """,
lay AS (SELECT event_id, 'dbright' AS kind, "row", col, dbright AS v FROM chg UNION ALL
        SELECT event_id, 'dndsi', "row", col, dndsi FROM chg),
ev AS (SELECT *, -v AS evidence, CASE kind WHEN 'dbright' THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END AS fl FROM lay),
dt AS (SELECT *, evidence - median(evidence) OVER (PARTITION BY event_id, kind) AS dv FROM ev),
rk AS (SELECT *, CASE WHEN evidence >= fl THEN cume_dist() OVER (PARTITION BY event_id, kind, evidence >= fl ORDER BY dv)
     WHEN evidence IS NOT NULL THEN 0 END AS rank FROM dt)"""


def layers(spark, d):
    c = change(spark, d)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("dbright", "dndsi")]))
    return c.select("event_id", "row", "col", pairs.alias("p")).select("event_id", "row", "col", "p.kind", "p.v")


@register("evidence_orientation", views=("obs",), extra=LAYERS + """,
m AS (SELECT event_id, kind, "row", col, evidence FROM ev UNION ALL
      SELECT event_id, 'logratio_mag', "row", col, abs(v) FROM lay WHERE kind = 'dndsi')""", sql="""
SELECT event_id, kind, count(evidence) AS n, round(sum(evidence), 9) AS total, round(max(evidence), 9) AS top FROM m GROUP BY ALL""")
def q_orient(spark, d):
    """Evidence-positive values by kind, magnitude kinds included."""
    x = layers(spark, d)
    x = x.unionByName(x.filter(F.col("kind") == "dndsi").withColumn("kind", F.lit("logratio_mag")))
    x = x.withColumn("e", fusion.orient(F.col("v"), F.col("kind")))
    return x.groupBy("event_id", "kind").agg(F.count("e").alias("n"), F.round(F.sum("e"), 9).alias("total"),
                                             F.round(F.max("e"), 9).alias("top"))


@register("evidence_percentile_rank", views=("obs",), extra=LAYERS, sql="""
SELECT event_id, kind, "row", col, round(rank, 9) AS rank FROM rk""")
def q_rank(spark, d):
    """Floor on raw evidence, rank on detrended evidence."""
    return fusion.evidence_rank(layers(spark, d), ["event_id"]).select(
        "event_id", "kind", "row", "col", F.round("rank", 9).alias("rank"))


@register("evidence_rank_summary", views=("obs",), extra=LAYERS, sql="""
SELECT event_id, kind, count(rank) AS n_valid, count(*) FILTER (rank > 0) AS n_admitted,
  round(max(evidence) FILTER (rank > 0), 9) AS max_evidence, count(*) FILTER (rank > 0) = 0 AS nothing_cleared FROM rk GROUP BY ALL""")
def q_ranksum(spark, d):
    """How many cells cleared each floor."""
    r = fusion.evidence_rank(layers(spark, d), ["event_id"])
    return fusion.rank_summary(r, ["event_id", "kind"]).withColumn("max_evidence", F.round("max_evidence", 9))


# optical and radar rank per dense cell, deterministic fractions of 128 with gaps
RANKS = """rr AS (SELECT d.event_id, d."row", d.col,
  CASE WHEN (o.red + d.col) % 5 <> 0 THEN (o.red % 129) / 128.0::DOUBLE END AS orank,
  CASE WHEN (o.nir + d."row") % 6 <> 0 THEN (o.nir % 129) / 128.0::DOUBLE END AS srank
 FROM dense_l d LEFT JOIN obs_l o USING (event_id, "row", col))"""


def ranks(spark, d):
    o = D.layer_observations(spark, d).select(
        "event_id", "row", "col",
        F.when((F.col("red") + F.col("col")) % 5 != 0, (F.col("red") % 129) / 128.0).alias("optical_rank"),
        F.when((F.col("nir") + F.col("row")) % 6 != 0, (F.col("nir") % 129) / 128.0).alias("sar_rank"))
    return focal.densify(o, D.layer_grids(spark, d, range(1, 8)), KEYS)


@register("combine_rank_pairs", views=("dense_l", "obs_l"), extra=RANKS, sql="""
SELECT event_id, "row", col, round(CASE WHEN orank IS NOT NULL AND srank IS NOT NULL THEN (orank + srank) / 2 ELSE coalesce(orank, srank) END, 9) AS optical,
  greatest(orank, srank) AS sar FROM rr""")
def q_combine(spark, d):
    """Mean of optical ranks, maximum of radar ranks, missing ones abstain."""
    r, o, s = ranks(spark, d), F.col("optical_rank"), F.col("sar_rank")
    return r.select("event_id", "row", "col", F.round(fusion.combine_optical(o, s), 9).alias("optical"),
                    fusion.combine_sar(o, s).alias("sar"))


def fuse_sql(mode):
    both = "(orank * 2 + srank) / 3" if mode == "mean" else "sqrt(orank * srank)"
    g = f"""g AS (SELECT *, CASE WHEN orank IS NOT NULL AND srank IS NOT NULL THEN {both}
      WHEN orank IS NULL THEN srank * 0.5 END AS g FROM rr)"""
    return RANKS + ",\n" + g + ",\n" + box("b", "g", {
        "gs": "g", "gn": "CASE WHEN g IS NOT NULL THEN 1 ELSE 0 END",
        "os": "orank", "onn": "CASE WHEN orank IS NOT NULL THEN 1 ELSE 0 END"}, 5) + """,
f AS (SELECT event_id, "row", col, orank, srank, coalesce(gs / nullif(gn, 0), g) AS base, coalesce(os / nullif(onn, 0), orank) AS ob,
  CASE WHEN orank IS NOT NULL AND srank IS NOT NULL THEN 2 WHEN srank IS NOT NULL THEN 1 WHEN orank IS NOT NULL THEN 3 END AS confidence FROM b)"""


def _fused(spark, d, mode):
    return fusion.fuse(ranks(spark, d), KEYS, mode=mode, optical_n=2, tile=TILE)


for _mode, _score in (("mean", "base"), ("geometric", "base"), ("product", "base * base")):
    def _q(spark, d, mode=_mode):
        """Fused score, confidence and optical-only score."""
        return _fused(spark, d, mode).select("event_id", "row", "col", "confidence", F.round("score", 12).alias("score"),
                                             F.round("optical_only", 12).alias("optical_only"))
    register(f"fuse_{_mode}", views=("dense_l", "obs_l"), extra=fuse_sql(_mode), sql=f"""
SELECT event_id, "row", col, confidence, round({_score}, 12) AS score, round(ob, 12) AS optical_only FROM f""")(_q)


@register("fuse_summary", views=("dense_l", "obs_l"), extra=fuse_sql("mean"), sql="""
SELECT event_id, count(*) FILTER (confidence = 2) AS n_both, count(*) FILTER (confidence = 1) AS n_sar_only,
 count(*) FILTER (confidence = 3) AS n_optical_only, count(base) AS n_scored, round(max(base), 6) AS max_score FROM f GROUP BY 1""")
def q_fsum(spark, d):
    """Counters of a fusion run."""
    return fusion.fuse_summary(_fused(spark, d, "mean"), KEYS).withColumn("max_score", F.round("max_score", 6))


@register("terrain_ramps", views=("dem",), sql="""
SELECT event_id, "row", col, round(t * t * (3 - 2 * t), 6) AS ramp, CASE WHEN h >= 300 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS step,
  round(l * l * (3 - 2 * l), 6) AS lowland FROM (SELECT *, greatest(0, least(1, (h - 200) / 300.0::DOUBLE)) AS t,
  greatest(0, least(1, (h - 150) / 100.0::DOUBLE)) AS l FROM dem)""")
def q_ramp(spark, d):
    """Smooth ramp, degenerate step and the lowland weight."""
    h = F.col("h")
    return D.elevation(spark, d).select(
        "event_id", "row", "col", F.round(fusion.smoothstep(h, 200, 500), 6).alias("ramp"),
        fusion.smoothstep(h, 300, 300).alias("step"), F.round(fusion.lowland_weight(h, 150, 100), 6).alias("lowland"))


GLACIER = """
m AS (SELECT *, CASE WHEN (("row" // 8) + (col // 8)) % 2 = 0 THEN 1 ELSE 0 END AS m FROM dense),
nb AS (SELECT t.event_id, t."row", t.col, s.m FROM m t CROSS JOIN (SELECT a.x AS a, b.x AS b FROM range(-1, 2) a(x), range(-1, 2) b(x))
  JOIN m s ON s.event_id = t.event_id AND s."row" = greatest(0, least(31, t."row" + a)) AND s.col = greatest(0, least(31, t.col + b)))"""


@register("glacier_weight_feathered", views=("dense",), extra=GLACIER,
          sql="""SELECT event_id, "row", col, round(1 - avg(m) * 0.7, 6) AS glacier_w FROM nb GROUP BY ALL""")
def q_glacier(spark, d):
    """Downweight on ice with a feathered edge."""
    return rounded(glacier(spark, d), "glacier_w")


def glacier(spark, d):
    dense = focal.densify(D.elevation(spark, d), D.grids(spark, d), KEYS)
    m = ((F.floor(F.col("row") / 8) + F.floor(F.col("col") / 8)) % 2 == 0).cast("int")
    return focal.core(fusion.glacier_weight(focal.tiled(dense, KEYS, 2, TILE), KEYS, m))


SLOPE = ("""
g AS (SELECT d.*, h FROM dense d LEFT JOIN dem USING (event_id, "row", col)),
f0 AS (SELECT *, h AS f FROM g),
""" + ",\n".join(box(f"b{i}", f"f{i}", {"s": "f", "n": "CASE WHEN f IS NOT NULL THEN 1 ELSE 0 END"}, k) + f""",
f{i + 1} AS (SELECT event_id, "row", col, h, coalesce(f, s / nullif(n, 0)) AS f FROM b{i})""" for i, k in enumerate((3, 7, 15, 31, 63))) + ",\n"
          + box("sm", "f5", {"s": "f", "n": "1"}, 3) + """,
z AS (SELECT event_id, "row", col, h, CASE WHEN n >= 4.5 THEN s / n ELSE f END AS z FROM sm),
gr AS (SELECT event_id, "row", col, h,
  CASE "row" WHEN 0 THEN lead(z) OVER wc - z WHEN 31 THEN z - lag(z) OVER wc ELSE (lead(z) OVER wc - lag(z) OVER wc) / 2 END / 60.0 AS gy,
  CASE col WHEN 0 THEN lead(z) OVER wr - z WHEN 31 THEN z - lag(z) OVER wr ELSE (lead(z) OVER wr - lag(z) OVER wr) / 2 END / 50.0 AS gx
  FROM z WINDOW wr AS (PARTITION BY event_id, "row" ORDER BY col), wc AS (PARTITION BY event_id, col ORDER BY "row")),
sl AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope FROM gr),
m1 AS (SELECT *, max(slope) OVER (PARTITION BY event_id, col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM sl),
m2 AS (SELECT *, max(a) OVER (PARTITION BY event_id, "row" ORDER BY col RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mx FROM m1)""")


@register("source_zone_slope_weight", views=("dense", "dem"), extra=SLOPE, sql="""
SELECT event_id, "row", col, round(mx, 6) AS slope_max, round(CASE WHEN h IS NOT NULL THEN t * t * (3 - 2 * t) END, 6) AS slope_w
FROM (SELECT *, greatest(0, least(1, (mx - 10) / 20.0::DOUBLE)) AS t FROM m2)""")
def q_slopew(spark, d):
    """Weight from the steepest ground in reach (150 m on 60 x 50 m cells)."""
    return rounded(slope(spark, d), "slope_max", "slope_w")


def slope(spark, d):
    dense = focal.densify(D.elevation(spark, d), D.grids(spark, d), KEYS)
    kr, kc = fusion.window_cells(150, 60), fusion.window_cells(150, 50)
    return fusion.slope_weight(dense, KEYS, kr, kc, F.lit(50.0), F.lit(60.0), tile=64)


# two viewing geometries: the even and the odd scene of each pair of scenes, in eighths of a dB
MAPS = """mp AS (SELECT d.event_id, d."row", d.col, g.geom, (o.red % 97 - 48) / 8.0::DOUBLE AS v,
   (d."row" * 3 + d.col * 5 + g.geom * 7) % 11 = 0 AS masked
  FROM dense_g d CROSS JOIN (SELECT unnest([0, 1]) AS geom) g
  LEFT JOIN obs o ON o.event_id * 8 + o.scene // 2 = d.event_id AND o."row" = d."row" AND o.col = d.col AND o.scene % 2 = g.geom),
us AS (SELECT *, CASE WHEN NOT masked THEN v END AS u FROM mp)"""


def maps(spark, d):
    n = F.col("scene")
    o = D.observations(spark, d).select((F.col("event_id") * 8 + F.floor(n / 2)).alias("event_id"), (n % 2).cast("int").alias("geom"),
                                        "row", "col", ((F.col("red") % 97 - 48) / 8.0).alias("v"))
    lay = D.layer_grids(spark, d, range(4)).withColumn("geom", F.explode(F.array(F.lit(0), F.lit(1))))
    return focal.densify(o, lay, ["event_id", "geom"]).withColumn(
        "masked", (F.col("row") * 3 + F.col("col") * 5 + F.col("geom") * 7) % 11 == 0)


def merge_sql(signed):
    st, an = ("abs(u)", "abs(u) >= 3") if signed else ("u", "u >= 3")
    clash = "pos AND neg" if signed else "false"
    return MAPS + f""",
mg AS (SELECT event_id, "row", col, arg_max(u, ({st}, -geom)) FILTER (u IS NOT NULL) AS merged, count(u) AS n_valid,
   count(*) FILTER ({an}) AS na, coalesce(bool_or({an} AND u > 0), false) AS pos, coalesce(bool_or({an} AND u < 0), false) AS neg,
   count(v) AS n_before FROM us GROUP BY ALL),
mc AS (SELECT event_id, "row", col, merged, CASE WHEN n_valid = 0 THEN NULL WHEN na >= 2 THEN CASE WHEN {clash} THEN 3 ELSE 2 END
   WHEN na = 1 THEN CASE WHEN n_valid > na THEN 3 ELSE 1 END ELSE 0 END AS confidence, n_valid, n_before FROM mg)"""


@register("merge_strongest_signed", views=("dense_g", "obs"), extra=merge_sql(True), sql="""
SELECT event_id, "row", col, merged, confidence, CASE WHEN confidence IS NULL OR confidence <> 3 THEN merged END AS agreeing FROM mc""")
def q_merge(spark, d):
    """Strongest anomaly wins, confidence classes, agreeing-only copy."""
    m = M.strongest(maps(spark, d), "logratio", 3.0)
    return m.select("event_id", "row", "col", "merged", "confidence",
                    M.agreeing_only(F.col("merged"), F.col("confidence")).alias("agreeing"))


@register("merge_strongest_unsigned", views=("dense_g", "obs"), extra=merge_sql(False), sql="""
SELECT event_id, "row", col, merged, confidence FROM mc""")
def q_merge_u(spark, d):
    """The correlation family has no polarity."""
    return M.strongest(maps(spark, d), "intcorr", 3.0).select("event_id", "row", "col", "merged", "confidence")


@register("merge_summary", views=("dense_g", "obs"), extra=merge_sql(True), sql="""
SELECT event_id, count(*) FILTER (confidence = 1) AS n_single, count(*) FILTER (confidence = 2) AS n_agree,
 count(*) FILTER (confidence = 3) AS n_conflict, count(*) FILTER (n_valid = 1 AND n_before > 1) AS n_mask_recovered,
 count(*) FILTER (n_valid = 0 AND n_before > 0) AS n_mask_blind FROM mc GROUP BY 1""")
def q_msum(spark, d):
    """Merge counters."""
    return M.merge_summary(M.strongest(maps(spark, d), "logratio", 3.0))


PRIMARY = MAPS + """,
pg AS (SELECT event_id, geom, count(u) AS n_seen, count(u) / 1024.0::DOUBLE AS coverage FROM us GROUP BY ALL),
el AS (SELECT *, coverage >= 0.5 AS eligible, count(*) FILTER (coverage >= 0.5) OVER (PARTITION BY event_id) AS ne FROM pg),
sn AS (SELECT us.*, ne, count(*) OVER (PARTITION BY event_id, "row", col) = ne AS common FROM us
  JOIN el USING (event_id, geom) WHERE eligible AND u IS NOT NULL),
cn AS (SELECT *, count(*) FILTER (common) OVER (PARTITION BY event_id) / ne AS nc FROM sn),
nz AS (SELECT event_id, geom, median(abs(u)) AS noise FROM cn WHERE nc < 300 OR common GROUP BY ALL),
pr AS (SELECT event_id, arg_min(geom, o) AS primary_geom, arg_min(coverage, o) AS coverage, arg_min(coalesce(noise, -1), o) AS noise FROM
  (SELECT el.*, noise, (CASE WHEN eligible THEN 0 ELSE 1 END, CASE WHEN eligible THEN noise ELSE -coverage END, geom) AS o
   FROM el LEFT JOIN nz USING (event_id, geom)) GROUP BY 1)"""


def primary(spark, d):
    n = D.layer_grids(spark, d, range(4)).select("event_id", (F.col("n_rows") * F.col("n_cols")).alias("n_cells"))
    return M.choose_primary(maps(spark, d), "logratio", n, min_common=300)


@register("fill_primary_choice", views=("dense_g", "obs"), extra=PRIMARY, sql="""
SELECT event_id, primary_geom, noise, round(coverage, 6) AS coverage FROM pr""")
def q_primary(spark, d):
    """The quietest eligible pass leads."""
    return primary(spark, d).select("event_id", "primary_geom", F.coalesce("noise", F.lit(-1.0)).alias("noise"),
                                    F.round("coverage", 6).alias("coverage"))


@register("fill_blind_spots", views=("dense_g", "obs"), extra=PRIMARY, sql="""
SELECT event_id, "row", col, arg_min(u, o) FILTER (u IS NOT NULL) AS filled,
  arg_min(CASE WHEN geom = primary_geom THEN 1 ELSE 2 END, o) FILTER (u IS NOT NULL) AS source, count(v) AS n_any
FROM (SELECT us.*, primary_geom, (CASE WHEN geom = primary_geom THEN 0 ELSE 1 END, -n_seen, geom) AS o
  FROM us JOIN pg USING (event_id, geom) JOIN pr USING (event_id)) GROUP BY ALL""")
def q_fill(spark, d):
    """Primary everywhere it sees, the other pass only in its blind spots."""
    return M.fill(maps(spark, d), primary(spark, d))


@register("fill_summary", views=("dense_g", "obs"), extra=PRIMARY + """,
fi AS (SELECT event_id, "row", col, arg_min(CASE WHEN geom = primary_geom THEN 1 ELSE 2 END, o) FILTER (u IS NOT NULL) AS source, count(v) AS n_any
FROM (SELECT us.*, primary_geom, (CASE WHEN geom = primary_geom THEN 0 ELSE 1 END, -n_seen, geom) AS o
  FROM us JOIN pg USING (event_id, geom) JOIN pr USING (event_id)) GROUP BY ALL)""", sql="""
SELECT event_id, count(*) FILTER (source = 1) AS n_primary, count(*) FILTER (source = 2) AS n_filled,
 count(*) FILTER (source IS NULL AND n_any > 0) AS n_blind, count(*) FILTER (n_any = 0) AS n_nodata FROM fi GROUP BY 1""")
def q_fillsum(spark, d):
    """Cells led by the primary, filled by the other pass, blind to both, and never measured."""
    return M.fill_summary(M.fill(maps(spark, d), primary(spark, d)))


# blobs of a mask; SQL labels by repeated minimum over the 8-neighbourhood
MASKED = """mk AS (SELECT event_id, "row", col, CAST(nir AS DOUBLE) AS score FROM obs_l WHERE nir >= 4500),
nb AS (SELECT a.event_id, a."row" * 32 + a.col AS a, b."row" * 32 + b.col AS b FROM mk a JOIN mk b ON a.event_id = b.event_id
   AND abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT event_id, a, b FROM nb UNION SELECT r.event_id, r.a, n.b FROM reach r JOIN nb n ON r.event_id = n.event_id AND r.b = n.a),
lb AS (SELECT event_id, CAST(a // 32 AS INTEGER) AS "row", CAST(a % 32 AS INTEGER) AS col, CAST(min(b) AS BIGINT) AS blob FROM reach GROUP BY event_id, a)"""


def scored(spark, d):
    return D.layer_observations(spark, d).select(
        "event_id", "row", "col", F.col("nir").cast("double").alias("score"), F.lit(32).alias("n_cols"))


def _blobs(spark, d):
    return B.label_blobs(scored(spark, d).filter(F.col("score") >= 4500), KEYS, tile=TILE)


@register("blob_labels", views=("obs_l",), extra="RECURSIVE " + MASKED, sql="SELECT * FROM lb")
def q_blobs(spark, d):
    """8-neighbour components, labelled by their first cell."""
    return _blobs(spark, d)


@register("blob_sieve", views=("obs_l",), extra="RECURSIVE " + MASKED, sql="""
SELECT o.event_id, o."row", o.col, CASE WHEN c.n < 4 THEN 0 ELSE CAST(o.nir AS DOUBLE) END AS score
FROM obs_l o LEFT JOIN lb USING (event_id, "row", col)
LEFT JOIN (SELECT event_id, blob, count(*) AS n FROM lb GROUP BY ALL) c USING (event_id, blob)""")
def q_sieve(spark, d):
    """Blobs under four cells are cleared."""
    return B.sieve(scored(spark, d), KEYS, "score", F.col("score") >= 4500, 4, tile=TILE).select("event_id", "row", "col", "score")


@register("ranked_candidates", views=("obs_l",), extra="RECURSIVE " + MASKED + """,
bs AS (SELECT event_id, blob, count(*) AS n_px, max(score) AS peak, round(avg(score), 6) AS mean,
   arg_max(mk."row", (score, -mk."row", -mk.col)) AS peak_row, arg_max(mk.col, (score, -mk."row", -mk.col)) AS peak_col,
   min(mk."row") AS row0, max(mk."row") AS row1, min(mk.col) AS col0, max(mk.col) AS col1
  FROM lb JOIN mk USING (event_id, "row", col) GROUP BY ALL)""", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY peak DESC, n_px DESC, blob) AS rank
 FROM bs WHERE n_px >= 2) WHERE rank <= 20""")
def q_cand(spark, d):
    """Blobs by peak, then area; at most twenty per event."""
    return B.candidates(scored(spark, d), KEYS, 4500, F.lit(0.0009), min_px=2, tile=TILE).drop("area_km2").withColumn(
        "mean", F.round("mean", 6))


LOOK = 79.0


def dem_with_look(spark, d, rough_layers=None):
    """Three times the measured heights with their voids, or a rough made-up surface for given grids."""
    rough = (F.col("row") * 37 + F.col("col") * 61 + F.col("event_id") * 13) % 83
    h = F.col("h") * 3 if rough_layers is None else F.lit(300.0) + rough * 2
    g = D.grids(spark, d) if rough_layers is None else rough_layers
    return focal.densify(D.elevation(spark, d), g, KEYS).select(
        "event_id", "row", "col", "n_rows", "n_cols", h.alias("h"),
        F.lit(28.0).alias("dx_m"), F.lit(27.5).alias("dy_m"), F.lit(LOOK).alias("look_az"), F.lit(39.0).alias("incidence"))


def march_sql(rate, cond):
    """Every step offset of a march joined to every cell."""
    return f"""
z AS (SELECT d.*, coalesce(3 * h, min(3 * h) OVER (PARTITION BY event_id)) AS z FROM dense d LEFT JOIN dem USING (event_id, "row", col)),
rel AS (SELECT event_id, CAST(greatest(1, ceil((max(z) - min(z)) / ({rate} * 27.5::DOUBLE))) AS BIGINT) AS n FROM z GROUP BY 1),
st AS (SELECT k, k * 27.5::DOUBLE AS d, CAST(round_even(-cos(radians({LOOK}::DOUBLE)) * k * 27.5::DOUBLE / 27.5::DOUBLE, 0) AS INTEGER) AS dr,
   CAST(round_even(sin(radians({LOOK}::DOUBLE)) * k * 27.5::DOUBLE / 28.0::DOUBLE, 0) AS INTEGER) AS dc FROM range(1, 400) t(k)),
hit AS (SELECT DISTINCT a.event_id, a."row", a.col FROM z a JOIN rel USING (event_id) JOIN st ON st.k <= rel.n
   JOIN z b ON b.event_id = a.event_id AND {cond})"""


@register("radar_shadow_mask", views=("dense", "dem"), extra=march_sql("(1 / tan(radians(39.0::DOUBLE)))", """
   b."row" = a."row" - dr AND b.col = a.col - dc AND b.z > a.z + d * (1 / tan(radians(39.0::DOUBLE)))"""), sql="""
SELECT d.event_id, d."row", d.col, h.event_id IS NOT NULL AS shadow FROM dense d LEFT JOIN hit h USING (event_id, "row", col)""")
def q_shadow(spark, d):
    """March toward the radar for a blocker above the ray."""
    return terrain.shadow(dem_with_look(spark, d), KEYS, smooth_k=1, tile=TILE)


@register("radar_layover_mask", views=("dense", "dem"), extra=march_sql("tan(radians(39.0::DOUBLE))", """(
   (b."row" = a."row" - dr AND b.col = a.col - dc AND a.z - b.z > d * tan(radians(39.0::DOUBLE)))
   OR (b."row" = a."row" + dr AND b.col = a.col + dc AND b.z - a.z > d * tan(radians(39.0::DOUBLE))))"""), sql="""
SELECT d.event_id, d."row", d.col, h.event_id IS NOT NULL AS layover FROM dense d LEFT JOIN hit h USING (event_id, "row", col)""")
def q_layover(spark, d):
    """March both ways for pairs whose slant range flips."""
    return terrain.layover(dem_with_look(spark, d), KEYS, smooth_k=1, tile=TILE)


@register("layover_fade", views=("dense_l", "obs_l"), extra="""
z AS (SELECT d.*, 300.0::DOUBLE + ("row" * 37 + col * 61 + event_id * 13) % 83 * 2 AS z, CAST(nir AS DOUBLE) AS v FROM dense_l d
   LEFT JOIN obs_l USING (event_id, "row", col)),
g AS (SELECT event_id, "row", col, v,
  CASE "row" WHEN 0 THEN lead(z) OVER wc - z WHEN 31 THEN z - lag(z) OVER wc ELSE (lead(z) OVER wc - lag(z) OVER wc) / 2 END / 27.5 AS gy,
  CASE col WHEN 0 THEN lead(z) OVER wr - z WHEN 31 THEN z - lag(z) OVER wr ELSE (lead(z) OVER wr - lag(z) OVER wr) / 2 END / 28.0 AS gx
  FROM z WINDOW wr AS (PARTITION BY event_id, "row" ORDER BY col), wc AS (PARTITION BY event_id, col ORDER BY "row")),
a AS (SELECT *, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, gy)) AS asp,
   quantile_cont(v, 0.75) OVER (PARTITION BY event_id) AS cut FROM g),
m AS (SELECT event_id, "row", col, CASE WHEN v >= cut AND slope >= 12 AND
   abs((((asp - 259.0 + 180.0) % 360.0) + 360.0) % 360.0 - 180.0) <= 55 THEN 1 ELSE 0 END AS m FROM a),
nb AS (SELECT t.event_id, t."row", t.col, s.m FROM m t CROSS JOIN (SELECT a.x AS a, b.x AS b FROM range(-2, 3) a(x), range(-2, 3) b(x))
  JOIN m s ON s.event_id = t.event_id AND s."row" = greatest(0, least(31, t."row" + a)) AND s.col = greatest(0, least(31, t.col + b)))""",
          sql="""SELECT event_id, "row", col, round(1 - avg(m) * 0.75, 6) AS alpha FROM nb GROUP BY ALL""")
def q_alpha(spark, d):
    """Fade where a cell faces the radar, is steep and reads high."""
    v = D.layer_observations(spark, d).select("event_id", "row", "col", F.col("nir").cast("double").alias("v"))
    # no measured height is read here, so Spark drops that join with its hint
    cells = dem_with_look(spark, d, D.layer_grids(spark, d, range(1, 8))).hint("merge").join(v, ["event_id", "row", "col"], "left").withColumn(
        "lay_aspect", F.pmod(F.col("look_az") + 180.0, F.lit(360.0)))
    return rounded(terrain.layover_alpha(cells, KEYS, dem_smooth=1, tile=TILE), "alpha")
