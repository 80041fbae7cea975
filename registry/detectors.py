"""Focal operators and radar change detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import register
from siltmark.operators import focal, sar
from siltmark.sources import driver_tables as D

TILE = 16      # small tiles so that the 32 x 32 grids cross tile borders
KEYS = ["event_id"]

# power of scenes 3, 2, 1 (before, nearest first: idx 0, 1, 2) and of each later scene in turn (after: idx -1)
AFTER = range(4, 8)
STACK = """stk AS (SELECT d.event_id, d."row", d.col, s.idx, CASE WHEN red > 0 THEN CAST(red AS DOUBLE) END AS v
  FROM dense_p d CROSS JOIN (SELECT unnest([3, 2, 1, 0]) AS scene, unnest([0, 1, 2, -1]) AS idx) s
  LEFT JOIN obs o ON o.event_id = d.event_id // 8 AND o."row" = d."row" AND o.col = d.col AND o.scene = CASE WHEN idx = -1 THEN d.event_id % 8 ELSE s.scene END),
wide AS (SELECT event_id, "row", col, max(v) FILTER (idx = 0) AS p0, max(v) FILTER (idx = 1) AS p1,
   max(v) FILTER (idx = 2) AS p2, max(v) FILTER (idx = -1) AS q FROM stk GROUP BY ALL)"""


def box(name, src, parts, k, part="event_id", zero=True):
    """CTEs <name>_h and <name>: k x k zero-padded sums of the given expressions."""
    lo, hi = (k - 1) // 2, k - 1 - (k - 1) // 2
    h = ", ".join(f"sum({e}) OVER wr AS {n}" for n, e in parts.items())
    v = ", ".join(f"coalesce(sum({n}) OVER wc, 0) AS {n}" for n in parts)
    return f"""{name}_h AS (SELECT *, {h} FROM {src} WINDOW wr AS (PARTITION BY {part}, "row" ORDER BY col
  RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)),
{name} AS (SELECT * EXCLUDE ({', '.join(parts)}), {v} FROM {name}_h WINDOW wc AS (PARTITION BY {part}, col ORDER BY "row"
  RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING))"""


def dense_power(spark, d):
    """event_id, idx, row, col, n_rows, n_cols, v (NULL where not measured)."""
    o = D.observations(spark, d)
    cell = ["row", "col", F.when(F.col("red") > 0, F.col("red").cast("double")).alias("v")]
    before = o.filter(F.col("scene") < min(AFTER)).withColumn("after", F.explode(F.array(*[F.lit(p) for p in AFTER])))
    pw = before.select((F.col("event_id") * 8 + F.col("after")).alias("event_id"), (3 - F.col("scene")).alias("idx"), *cell).unionByName(
        D.layer_observations(spark, d).filter(F.col("scene") >= min(AFTER)).select("event_id", F.lit(-1).alias("idx"), *cell))
    layers = D.layer_grids(spark, d, AFTER).withColumn("idx", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, -1)])))
    return focal.densify(pw, layers, ["event_id", "idx"])


def wide_power(spark, d):
    """One row per cell with p0 (nearest before), p1, p2 and q (after)."""
    x = dense_power(spark, d)
    pick = lambda i, n: F.max(F.when(F.col("idx") == i, F.col("v"))).alias(n)
    return x.groupBy("event_id", "row", "col", "n_rows", "n_cols").agg(
        pick(0, "p0"), pick(1, "p1"), pick(2, "p2"), pick(-1, "q"))


def frame(spark, d, halo):
    return focal.tiled(wide_power(spark, d), KEYS, halo, TILE)


def rounded(df, *cols, keep=("event_id", "row", "col")):
    return focal.core(df).select(*keep, *[F.round(c, 6).alias(c) for c in cols]) if "_core" in df.columns else df.select(
        *keep, *[F.round(c, 6).alias(c) for c in cols])


@register("window_sum_and_mean", views=("dense_p", "obs"), extra=STACK + ",\n" + box(
    "b", "wide", {"s": "q", "n": "CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END"}, 5), sql="""
SELECT event_id, "row", col, CAST(n AS BIGINT) AS n, round(s, 6) AS s, round(CASE WHEN n >= 12.5 THEN s / n END, 6) AS m FROM b""")
def q_box(spark, d):
    """Zero-padded 5 x 5 sums and valid-only mean."""
    t = frame(spark, d, 3)
    q = F.col("q")
    t = focal.box_sum(t, KEYS, {"s": q, "n": q.isNotNull().cast("int")}, 5)
    t = focal.box_mean(t, KEYS, {"m": q}, 5)
    return focal.core(t).select("event_id", "row", "col", F.col("n").cast("bigint").alias("n"),
                                F.round("s", 6).alias("s"), F.round("m", 6).alias("m"))


@register("window_mean_even_width", views=("dense_p", "obs"), extra=STACK + ",\n" + box(
    "b", "wide", {"s": "q", "n": "CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END"}, 4), sql="""
SELECT event_id, "row", col, round(CASE WHEN n >= 8 THEN s / n END, 6) AS m FROM b""")
def q_box4(spark, d):
    """An even window pads one more cell after than before."""
    t = focal.box_mean(frame(spark, d, 3), KEYS, {"m": F.col("q")}, 4)
    return rounded(t, "m")


@register("smooth_and_keep", views=("dense_p", "obs"), extra=STACK + ",\n" + box(
    "b", "wide", {"s": "q", "n": "CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END"}, 3), sql="""
SELECT event_id, "row", col, round(coalesce(s / nullif(n, 0), q), 6) AS sm FROM b""")
def q_smooth(spark, d):
    """Mean of whatever the window holds, else the cell itself."""
    return rounded(focal.smooth_keep(frame(spark, d, 2), KEYS, "sm", F.col("q"), 3), "sm")


LEE = STACK + ",\n" + box("b", "wide", {"s": "q", "s2": "q * q", "n": "CASE WHEN q IS NOT NULL THEN 1 ELSE 0 END"}, 5) + """,
l AS (SELECT *, CASE WHEN n >= 12.5 THEN s / n END AS mu, CASE WHEN n >= 12.5 THEN s2 / n END AS sq FROM b),
l2 AS (SELECT *, greatest(sq - mu * mu, 0) / nullif(mu * mu, 0) AS ci2 FROM l)"""


@register("speckle_lee", views=("dense_p", "obs"), extra=LEE, sql="""
SELECT event_id, "row", col, round(CASE WHEN q IS NOT NULL THEN coalesce(mu +
   CASE WHEN ci2 = 0 THEN 0 ELSE greatest(0, least(1, 1 - (1 / 4.4::DOUBLE) / ci2)) END * (q - mu), q) END, 6) AS lee FROM l2""")
def q_lee(spark, d):
    """Adaptive speckle filter."""
    return rounded(focal.lee_filter(frame(spark, d, 3), KEYS, "lee", F.col("q"), 5), "lee")


@register("speckle_median", views=("dense_p", "obs"), extra=STACK + """,
off AS (SELECT a.x AS a, b.x AS b FROM range(-1, 2) a(x), range(-1, 2) b(x)),
nb AS (SELECT t.event_id, t."row", t.col, s.q AS v FROM wide t CROSS JOIN off JOIN wide s ON s.event_id = t.event_id
   AND s."row" = greatest(0, least(31, t."row" + a)) AND s.col = greatest(0, least(31, t.col + b)))""", sql="""
SELECT w.event_id, w."row", w.col, round(CASE WHEN w.q IS NOT NULL THEN coalesce(m, w.q) END, 6) AS med
FROM wide w JOIN (SELECT event_id, "row", col, median(v) AS m FROM nb GROUP BY ALL) USING (event_id, "row", col)""")
def q_median(spark, d):
    """3 x 3 median with replicated edges."""
    return rounded(focal.median_filter(frame(spark, d, 2), KEYS, "med", F.col("q"), 3), "med")


@register("focal_maximum", views=("dense_p", "obs"), extra=STACK + """,
a AS (SELECT *, max(q) OVER (PARTITION BY event_id, col ORDER BY "row" RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m1 FROM wide)""",
          sql="""SELECT event_id, "row", col, max(m1) OVER (PARTITION BY event_id, "row" ORDER BY col
   RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mx FROM a""")
def q_max(spark, d):
    """Rectangular 5 x 7 maximum."""
    t = focal.focal_max(frame(spark, d, 4), KEYS, "mx", F.col("q"), 5, 7)
    return focal.core(t).select("event_id", "row", "col", "mx")


@register("edge_padded_mean", views=("dem", "dense"), extra="""
z AS (SELECT d.*, CAST(100 + 20 * "row" + (col * col) % 50 AS DOUBLE) AS z FROM dense d),
nb AS (SELECT t.event_id, t."row", t.col, s.z FROM z t CROSS JOIN (SELECT a.x AS a, b.x AS b FROM range(-2, 3) a(x), range(-2, 3) b(x))
  JOIN z s ON s.event_id = t.event_id AND s."row" = greatest(0, least(31, t."row" + a)) AND s.col = greatest(0, least(31, t.col + b)))""",
          sql="""SELECT event_id, "row", col, round(avg(z), 6) AS m FROM nb GROUP BY ALL""")
def q_edge(spark, d):
    """5 x 5 mean with replicated edges."""
    z = (100 + 20 * F.col("row") + (F.col("col") * F.col("col")) % 50).cast("double")
    dense = focal.densify(D.elevation(spark, d), D.grids(spark, d), KEYS)
    t = focal.edge_mean(focal.tiled(dense, KEYS, 3, TILE), KEYS, "m", z, 5)
    return rounded(t, "m")


@register("dilate_mask", views=("dense_p", "obs"), extra="""
m AS (SELECT DISTINCT event_id, "row", col FROM obs WHERE red > 2900),
off AS (SELECT a.x AS a, b.x AS b FROM range(-3, 4) a(x), range(-3, 4) b(x) WHERE abs(a.x) + abs(b.x) <= 3)""", sql="""
SELECT DISTINCT event_id, CAST("row" + a AS INTEGER) AS "row", CAST(col + b AS INTEGER) AS col FROM m, off
WHERE "row" + a BETWEEN 0 AND 31 AND col + b BETWEEN 0 AND 31""")
def q_dilate(spark, d):
    """Three 4-neighbour dilations, no wrap at the edges."""
    m = D.observations(spark, d).filter(F.col("red") > 2900).select(
        "event_id", "row", "col", F.lit(32).alias("n_rows"), F.lit(32).alias("n_cols")).distinct()
    return focal.dilate(m, KEYS, 3)


def logratio_sql(src="wide", k=5):
    return box("lr", src, {"a": "CASE WHEN p0 IS NOT NULL AND q IS NOT NULL THEN p0 END",
                           "b": "CASE WHEN p0 IS NOT NULL AND q IS NOT NULL THEN q END",
                           "n": "CASE WHEN p0 IS NOT NULL AND q IS NOT NULL THEN 1 ELSE 0 END"}, k)


@register("detector_log_ratio", views=("dense_p", "obs"), extra=STACK + ",\n" + logratio_sql(), sql="""
SELECT event_id, "row", col, round(CASE WHEN n >= 12.5 THEN 10 * log10((a / n) / (b / n)) END, 6) AS logratio FROM lr""")
def q_lr(spark, d):
    """Log ratio of multilooked power."""
    return rounded(sar.log_ratio(frame(spark, d, 3), KEYS, F.col("p0"), F.col("q"), 5), "logratio")


def rho_sql(name, src, x, y, k=5):
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return box(name, src, {"n": f"CASE WHEN {ok} THEN 1 ELSE 0 END", "sa": f"CASE WHEN {ok} THEN {x} END",
                           "sb": f"CASE WHEN {ok} THEN {y} END", "sab": f"{x} * {y}",
                           "saa": f"CASE WHEN {ok} THEN {x} * {x} END", "sbb": f"CASE WHEN {ok} THEN {y} * {y} END"}, k) + f""",
{name}_r AS (SELECT event_id, "row", col, CASE WHEN n >= {k * k / 2} AND va * vb > 0 THEN greatest(-1, least(1, cov / sqrt(va * vb))) END AS rho
  FROM (SELECT *, sab / n - (sa / n) * (sb / n) AS cov, saa / n - (sa / n) * (sa / n) AS va, sbb / n - (sb / n) * (sb / n) AS vb
        FROM (SELECT * REPLACE (nullif(n, 0) AS n) FROM {name})))"""


@register("detector_intensity_correlation", views=("dense_p", "obs"), extra=STACK + ",\n" + rho_sql("c", "wide", "p0", "q"), sql="""
SELECT event_id, "row", col, round(rho, 6) AS rho FROM c_r""")
def q_rho(spark, d):
    """Windowed Pearson correlation."""
    return rounded(sar.correlation(frame(spark, d, 3), KEYS, F.col("p0"), F.col("q"), 5), "rho")


def stack(spark, d):
    """Cells with their scene stack as a small array (three before, one after)."""
    x = dense_power(spark, d)
    return x.groupBy("event_id", "row", "col", "n_rows", "n_cols").agg(
        F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("pows"))


PAIRS_SQL = STACK + ",\n" + ",\n".join(rho_sql(f"c{a}{b}", "wide", a, b) for a, b in (
    ("p0", "p1"), ("p0", "p2"), ("p1", "p2"), ("p0", "q"), ("p1", "q"), ("p2", "q")))


@register("detector_correlation_loss", views=("dense_p", "obs"), extra=PAIRS_SQL, sql="""
SELECT r.event_id, r."row", r.col, round(CASE WHEN r.rho IS NOT NULL AND c.rho IS NOT NULL THEN
  (greatest(0.001::DOUBLE, r.rho) - greatest(0.001::DOUBLE, c.rho)) / (greatest(0.001::DOUBLE, r.rho) + greatest(0.001::DOUBLE, c.rho)) END, 6) AS intcorr
FROM cp0p1_r r JOIN cp0q_r c USING (event_id, "row", col)""")
def q_loss(spark, d):
    """Normalised loss of the pre-event correlation."""
    t = frame(spark, d, 3)
    t = sar.correlation(t, KEYS, F.col("p0"), F.col("p1"), 5, "ref")
    t = sar.correlation(t, KEYS, F.col("p0"), F.col("q"), 5, "co")
    return rounded(t.withColumn("intcorr", sar.correlation_loss(F.col("ref"), F.col("co"))), "intcorr")


@register("detector_multi_temporal", views=("dense_p", "obs"), extra=PAIRS_SQL + """,
rf AS (SELECT *, 0 AS g FROM cp0p1_r UNION ALL SELECT *, 1 FROM cp0p2_r UNION ALL SELECT *, 2 FROM cp1p2_r),
cf AS (SELECT *, 0 AS g FROM cp0q_r UNION ALL SELECT *, 1 FROM cp1q_r UNION ALL SELECT *, 2 FROM cp2q_r),
st AS (SELECT event_id, "row", col, count(rho) AS n, greatest(1.06 * stddev_pop(rho) * pow(count(rho), -0.2), 0.03) AS h FROM rf GROUP BY ALL),
pp AS (SELECT c.event_id, c."row", c.col, c.g, sum(1 / (1 + exp(-1.702 * greatest(-40, least(40, (r.rho - c.rho) / h))))) / any_value(n) AS p
   FROM cf c JOIN rf r USING (event_id, "row", col) JOIN st USING (event_id, "row", col)
   WHERE c.rho IS NOT NULL AND r.rho IS NOT NULL AND n >= 3 GROUP BY ALL)""", sql="""
SELECT w.event_id, w."row", w.col, round(m, 6) AS mtcorr FROM wide w LEFT JOIN
  (SELECT event_id, "row", col, avg(p) AS m FROM pp GROUP BY ALL) USING (event_id, "row", col)""")
def q_mt(spark, d):
    """Possibility that the co-event correlation is anomalously low."""
    pairs = sar.pair_correlations(stack(spark, d), KEYS, 5, TILE, before=3)
    return rounded(sar.multi_temporal(pairs, KEYS), "mtcorr")


@register("detector_intensity_z", views=("dense_p", "obs"), extra=STACK + ",\n" + box(
    "b", "stk", {"s": "v", "n": "CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END"}, 5, "event_id, idx") + """,
dd AS (SELECT event_id, "row", col, idx, CASE WHEN n >= 12.5 THEN 10 * log10(s / n) END AS d FROM b)""", sql="""
SELECT event_id, "row", col, round(CASE WHEN count(d) FILTER (idx >= 0) >= 2 THEN (max(d) FILTER (idx = -1) - avg(d) FILTER (idx >= 0))
   / greatest(stddev_pop(d) FILTER (idx >= 0), 0.75) END, 6) AS tsint FROM dd GROUP BY ALL""")
def q_z(spark, d):
    """Post brightness against the pre stack, in sigmas."""
    return rounded(sar.intensity_zscore(dense_power(spark, d), KEYS, 5, tile=TILE), "tsint")


@register("tails_deposit_and_scar", views=("dense_p", "obs"), extra=STACK + ",\n" + logratio_sql() + """,
v AS (SELECT event_id, "row", col, -CASE WHEN n >= 12.5 THEN 10 * log10((a / n) / (b / n)) END AS o FROM lr)""", sql="""
SELECT event_id, "row", col, round(CASE WHEN o >= 1 THEN o END, 6) AS deposit, round(CASE WHEN o <= -1 THEN -o END, 6) AS scar FROM v""")
def q_tails(spark, d):
    """Deposit and scar tails of a signed detector."""
    t = sar.log_ratio(frame(spark, d, 3), KEYS, F.col("p0"), F.col("q"), 5)
    s = sar.split_tails(F.col("logratio"), "logratio", 1.0)
    return rounded(t.withColumn("deposit", s["deposit"]).withColumn("scar", s["scar"]), "deposit", "scar")


@register("radiometric_normalise", views=("dense_p", "obs"), extra=STACK + ",\n" + logratio_sql() + """,
v AS (SELECT event_id, "row", col, CASE WHEN n >= 12.5 THEN 10 * log10((a / n) / (b / n)) END AS x FROM lr)""", sql="""
SELECT event_id, "row", col, round(x - median(x) OVER (PARTITION BY event_id), 6) AS logratio FROM v""")
def q_norm(spark, d):
    """Subtract each event's median change."""
    t = focal.core(sar.log_ratio(frame(spark, d, 3), KEYS, F.col("p0"), F.col("q"), 5)).select("event_id", "row", "col", "logratio")
    return rounded(sar.normalise(t, KEYS, "logratio"), "logratio")


@register("void_filling", views=("dense", "dem"), extra="""
g AS (SELECT d.event_id, d."row", d.col, CASE WHEN (d."row" // 6 + d.col // 5) % 3 <> 0 THEN h END AS h
  FROM dense d LEFT JOIN dem USING (event_id, "row", col)),
f0 AS (SELECT *, h AS f FROM g),
""" + ",\n".join(box(f"b{i}", f"f{i}", {"s": "f", "n": "CASE WHEN f IS NOT NULL THEN 1 ELSE 0 END"}, k) + f""",
f{i + 1} AS (SELECT event_id, "row", col, h, coalesce(f, s / nullif(n, 0)) AS f FROM b{i})""" for i, k in enumerate((3, 7, 15, 31, 63))),
          sql="""SELECT event_id, "row", col, round(coalesce(f, median(h) OVER (PARTITION BY event_id)), 6) AS filled FROM f5""")
def q_voids(spark, d):
    """Holes grown shut from their surroundings, window doubling."""
    dense = focal.densify(D.elevation(spark, d), D.grids(spark, d), KEYS)
    keep = (F.floor(F.col("row") / 6) + F.floor(F.col("col") / 5)) % 3 != 0
    return rounded(focal.fill_voids(dense.withColumn("h", F.when(keep, F.col("h"))), KEYS, "h", 64), "filled")


@register("slope_and_aspect", views=("dense",), extra="""
z AS (SELECT *, CAST(100 + 20 * "row" + (col * col) % 50 + event_id % 7 AS DOUBLE) AS z FROM dense),
g AS (SELECT event_id, "row", col,
  CASE "row" WHEN 0 THEN lead(z) OVER wc - z WHEN 31 THEN z - lag(z) OVER wc ELSE (lead(z) OVER wc - lag(z) OVER wc) / 2 END / 27.5 AS gy,
  CASE col WHEN 0 THEN lead(z) OVER wr - z WHEN 31 THEN z - lag(z) OVER wr ELSE (lead(z) OVER wr - lag(z) OVER wr) / 2 END / 25.0 AS gx
  FROM z WINDOW wr AS (PARTITION BY event_id, "row" ORDER BY col), wc AS (PARTITION BY event_id, col ORDER BY "row"))""", sql="""
SELECT event_id, "row", col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope,
  round(CASE WHEN degrees(atan2(-gx, gy)) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END, 6) AS aspect FROM g""")
def q_slope(spark, d):
    """Slope and aspect by central differences."""
    dense = focal.densify(D.elevation(spark, d), D.grids(spark, d), KEYS)
    z = (100 + 20 * F.col("row") + (F.col("col") * F.col("col")) % 50 + F.col("event_id") % 7).cast("double")
    t = focal.slope_aspect(focal.tiled(dense, KEYS, 2, TILE), KEYS, z, F.lit(25.0), F.lit(27.5))
    return rounded(t, "slope", "aspect")
