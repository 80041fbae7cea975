"""Slide measurements from outlines: roles, volumes, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import geo
from siltmark.functions import volume as V


def largest_per_role(outlines: DataFrame) -> DataFrame:
    """Largest polygon of every (slide, role); others are superseded attempts, not parts."""
    return (outlines.filter(F.col("area_m2") > 0).groupBy("slide", "role").agg(
        F.max_by(F.struct("polygon_id", "area_m2"), F.struct("area_m2", (-F.col("polygon_id")).alias("o"))).alias("p"),
        F.count(F.lit(1)).alias("n_polygons")).select("slide", "role", "p.*", "n_polygons"))


def role_areas(largest: DataFrame) -> DataFrame:
    """One row per slide with the area of each role."""
    return largest.groupBy("slide").agg(*[
        F.max(F.when(F.col("role") == r, F.col("area_m2"))).alias(f"a_{r}") for r in ("total", "best", "low", "high")])


def measure(areas: DataFrame, material: Column, table=None) -> DataFrame:
    """Volume of every slide with a best outline and a consistent assignment.

    Low and high outlines also run through the relation on their own.
    """
    a = {r: F.col(f"a_{r}") for r in ("total", "best", "low", "high")}
    df = areas.withColumn("problem", V.order_problem(a["total"], a["best"], a["low"], a["high"]))
    df = df.withColumn("_k", V.coefficients(material, table))
    k, none = F.col("_k"), F.lit(None).cast("double")
    ok = F.col("problem").isNull() & a["best"].isNotNull()
    v = V.area_to_volume(a["best"], a["low"], a["high"], k)
    df = df.withColumn("_v", F.when(ok, v))
    for r in ("low", "high"):
        df = df.withColumn(f"v_src_{r}", F.when(ok & a[r].isNotNull(), V.area_to_volume(a[r], none, none, k)["volume"]))
    df = df.withColumns({"v": F.col("_v.volume"), "v_lo": F.col("_v.low"), "v_hi": F.col("_v.high")})
    depth = V.implied_depth_m(F.col("v"), a["total"])
    return df.withColumn("implied_depth", depth).withColumn("too_deep", V.depth_flag(depth)).drop("_k", "_v")


def upsert(old: DataFrame, new: DataFrame, key: str = "slide", survive=("length", "z_top", "z_bottom", "drop")) -> DataFrame:
    """Re-measured slides replace their row; centerline fields of the old row survive."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old"))
    n = new.withColumn("_new", F.lit(True))
    j = o.join(n, key, "full_outer")
    cols = []
    for c in [x for x in dict.fromkeys([*old.columns, *new.columns]) if x != key]:
        has_o, has_n = c in old.columns, c in new.columns
        if has_o and has_n:
            kept = F.coalesce(F.col(c), F.col(f"_o_{c}")) if c in survive else F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}"))
        else:
            kept = F.col(f"_o_{c}") if has_o else F.col(c)
        cols.append(kept.alias(c))
    return j.select(key, *cols, (F.col("_old") & F.col("_new")).alias("replaced"))


def scar_centres(outlines: DataFrame, roles=("best", "total")) -> DataFrame:
    """Centre of the first of ``roles`` an event has outlines of: event_id, scar_role, scar_lat, scar_lon.

    Several outlines of a role are parts of one scar and weigh by their area.  ``outlines``: event_id, role, ring.
    """
    c = outlines.filter(F.col("role").isin(*roles)).select("event_id", "role", geo.ring_centroid(F.col("ring")).alias("c")).filter("c IS NOT NULL")
    sums = c.groupBy("event_id", "role").agg(F.sum("c.area").alias("a"), *[F.sum(F.col(f"c.{x}") * F.col("c.area")).alias(x) for x in ("lat", "lon")])
    first = sums.groupBy("event_id").agg(F.min_by(F.struct("role", "a", "lat", "lon"), F.array_position(F.lit(list(roles)), F.col("role"))).alias("s"))
    return first.select("event_id", F.col("s.role").alias("scar_role"), (F.col("s.lat") / F.col("s.a")).alias("scar_lat"), (F.col("s.lon") / F.col("s.a")).alias("scar_lon"))


def with_event(rows: DataFrame, detections: DataFrame, outlines: DataFrame, fields=("coherency", "hf_lf")) -> DataFrame:
    """Measured slides with what belongs to their event: the detection, where the scar lies and how far off it is.

    ``rows``: event_id, slide, implied_depth, ...; a slide without a depth takes that of its event's last slide.
    ``detections``: event_id, origin, lat, lon and ``fields``.  An event that has no detection or no scar leaves
    those columns null.
    """
    det = detections.select("event_id", F.date_format("origin", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("origin_utc"),
                            F.col("lat").alias("det_lat"), F.col("lon").alias("det_lon"), *[F.col(f).alias(f"det_{f}") for f in fields])
    last = rows.groupBy("event_id").agg(F.max_by(F.struct("implied_depth"), "slide").alias("_last"))
    stamp = det.join(scar_centres(outlines), "event_id", "full_outer").join(last, "event_id", "right")
    stamp = stamp.withColumn("offset_km", geo.haversine_km(F.col("det_lat"), F.col("det_lon"), F.col("scar_lat"), F.col("scar_lon")))
    return rows.join(stamp, "event_id", "left").withColumn("implied_depth", F.coalesce("implied_depth", "_last.implied_depth")).drop("_last")


def match_roles(layers: DataFrame) -> DataFrame:
    """Role of each named layer: (project, pos, name) -> (project, role, pos, name).

    The total role claims first, then best, low, high; a layer belongs to one role, and
    an unmarked source layer stands in for a missing best.  Earlier claims take at most one
    layer each, so the first few layers of a claim settle it: no more of them are gathered,
    however many a project has.
    """
    t = layers.withColumn("_t", V.name_tokens(F.col("name")))
    tok = F.col("_t")
    total = F.lit(False)
    for words in V.TOTAL_SUBJECTS:
        total = total | V.has_all(tok, words)
    source = V.has_all(tok, V.SOURCE_SUBJECT)
    every = [w for ws in V.ROLE_WORDS.values() for w in ws]
    may = [("total", total), *[(r, source & V.has_any(tok, V.ROLE_WORDS[r])) for r in ("best", "low", "high")],
           ("plain", source & ~V.has_any(tok, every))]
    d = t.filter(F.col("pos").isNotNull()).select("project", "pos", "name", F.explode(F.array_compact(F.array(
        *[F.when(cond, F.lit(r)) for r, cond in may]))).alias("claim"))
    # layers of one position are claimed together, so positions are counted once
    first = d.groupBy("project", "claim", "pos").agg(F.min("name").alias("name"))
    n = F.row_number().over(Window.partitionBy("project", "claim").orderBy("pos"))
    few = first.withColumn("n", n).filter(F.col("n") <= len(may))
    claimed = few.groupBy("project").agg(*[F.array_sort(F.collect_list(
        F.when(F.col("claim") == r, F.struct("pos", "name")))).alias(f"_{r}") for r, _ in may])
    for k, (role, _) in enumerate(may):
        taken = [r for r, _ in may[:k]]
        claimed = claimed.withColumn(role, F.get(F.filter(f"_{role}", lambda x: ~F.coalesce(
            F.array_contains(F.array(*[F.col(f"{r}.pos") for r in taken]), x["pos"]), F.lit(False)) if taken else F.lit(True)), F.lit(0)))
    best = F.coalesce("best", "plain")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("hit")) for r, c in (
        ("total", F.col("total")), ("best", best), ("low", F.col("low")), ("high", F.col("high")))])
    return claimed.select("project", F.explode(roles).alias("r")).filter(F.col("r.hit").isNotNull()).select(
        "project", "r.role", "r.hit.pos", "r.hit.name")
