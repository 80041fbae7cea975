"""Spatio-temporal scene search: many events against a scene catalogue at once.

The join is an equi-join on (grid cell, time bucket), so neither side is ever
compared with every row of the other.  A pair that shares several cells is kept
only in the cell holding the lower-left corner of the shared box, which makes the
result free of duplicates without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import geo, timing

CELL_DEG = 2.0      # about one scene: few copies per scene, few strangers per cell
BUCKET_DAYS = 16


def _cells(box: Column, axis: str) -> Column:
    lo, hi = ("w", "e") if axis == "x" else ("s", "n")
    return F.explode(F.sequence(F.floor(box[lo] / CELL_DEG), F.floor(box[hi] / CELL_DEG)))


def _bucket(us: Column) -> Column:
    return F.floor(us / F.lit(float(BUCKET_DAYS * timing.DAY_US)))


def overlapping_pairs(events: DataFrame, scenes: DataFrame, *, pre_days: int, post_days: int,
                      km_per_deg: float = geo.KM_PER_DEG, padded: bool = False) -> DataFrame:
    """Every (event, scene) whose boxes meet and whose times lie within the windows.

    ``events``: event_id, origin, lat, lon, radius_km.  ``scenes``: scene_id, acq,
    bbox and any further columns.  One day of slack is left on both ends; the
    caller applies the exact side rule.
    """
    lat, lon, r = F.col("lat"), F.col("lon"), F.col("radius_km")
    aoi = geo.padded_box(lat, lon, r) if padded else geo.aoi_box(lat, lon, r, km_per_deg)
    t = timing.micros(F.col("origin"))
    day = timing.DAY_US
    ev = (events.withColumn("aoi", aoi)
          .withColumn("_b", F.explode(F.sequence(_bucket(t - (pre_days + 1) * day),
                                                 _bucket(t + (post_days + 1) * day))))
          .withColumn("_x", _cells(F.col("aoi"), "x"))
          .withColumn("_y", _cells(F.col("aoi"), "y")))
    sc = (scenes.filter(F.col("acq").isNotNull())
          .withColumn("_b", _bucket(timing.micros(F.col("acq"))))
          .withColumn("_x", _cells(F.col("bbox"), "x"))
          .withColumn("_y", _cells(F.col("bbox"), "y")))
    both = ev.join(sc, ["_b", "_x", "_y"])
    a, b = F.col("aoi"), F.col("bbox")
    home = ((F.floor(F.greatest(a["w"], b["w"]) / CELL_DEG) == F.col("_x"))
            & (F.floor(F.greatest(a["s"], b["s"]) / CELL_DEG) == F.col("_y")))
    return both.filter(geo.boxes_meet(a, b) & home).drop("_b", "_x", "_y")


def box_join(left: DataFrame, right: DataFrame, left_box: str, right_box: str, slack_deg: float = 0.0) -> DataFrame:
    """Rows whose boxes meet, joined on grid cells; ``slack_deg`` widens the left box.

    Each pair appears once: in the cell of the shared box's lower-left corner.
    """
    b = F.col(left_box)
    wide = F.struct((b["w"] - slack_deg).alias("w"), (b["s"] - slack_deg).alias("s"),
                    (b["e"] + slack_deg).alias("e"), (b["n"] + slack_deg).alias("n"))
    lf = left.withColumn("_wide", wide).withColumn("_x", _cells(F.col("_wide"), "x")).withColumn("_y", _cells(F.col("_wide"), "y"))
    rt = right.withColumn("_x", _cells(F.col(right_box), "x")).withColumn("_y", _cells(F.col(right_box), "y"))
    j = lf.join(rt, ["_x", "_y"])
    a, c = F.col("_wide"), F.col(right_box)
    home = ((F.floor(F.greatest(a["w"], c["w"]) / CELL_DEG) == F.col("_x"))
            & (F.floor(F.greatest(a["s"], c["s"]) / CELL_DEG) == F.col("_y")))
    return j.filter(geo.boxes_meet(a, c) & home).drop("_x", "_y", "_wide")


def scene_search(events: DataFrame, scenes: DataFrame, *, pre_days: int = 60, post_days: int = 60,
                 rule: str = "day", max_cloud: float | None = None,
                 km_per_deg: float = geo.KM_PER_DEG, now: Column | None = None) -> DataFrame:
    """Scenes per event and side.

    ``rule='day'`` leaves the event day and uses whole days; ``rule='origin'`` splits
    exactly at the origin.  ``max_cloud`` of None or >= 100 applies no cloud
    predicate at all, so scenes without a cloud figure stay.
    """
    if max_cloud is not None and max_cloud < 100:
        scenes = scenes.filter(F.col("cloud_pct") < max_cloud)
    pairs = overlapping_pairs(events, scenes, pre_days=pre_days, post_days=post_days,
                              km_per_deg=km_per_deg)
    origin, acq = F.col("origin"), F.col("acq")
    side = (timing.day_side(acq, timing.day_windows(origin, pre_days, post_days)) if rule == "day"
            else timing.origin_side(acq, origin, pre_days, post_days, now))
    return (pairs.withColumn("side", side).filter(F.col("side").isNotNull())
            .withColumn("gap", timing.gap_days(acq, origin)))


def covers_point(df: DataFrame) -> Column:
    """The scene's box holds the event point; scenes without a box are not excluded."""
    return F.col("bbox").isNull() | geo.box_has_point(F.col("bbox"), F.col("lon"), F.col("lat"))


def search_products(events: DataFrame, scenes: DataFrame, *, pre_days: int, post_days: int,
                    max_cloud_pct: float | None = None, auto_window: bool = False,
                    cover: str = "aoi", qualities=("standard",)) -> DataFrame:
    """Commercial product search: permission, quality and cloud filters, point or box cover."""
    cap = max_cloud_pct if max_cloud_pct is not None else (20.0 if auto_window else 80.0)
    ok = scenes.filter(F.col("downloadable") & F.col("quality").isin(*qualities))
    found = scene_search(events, ok, pre_days=pre_days, post_days=post_days, max_cloud=cap)
    return found.filter(covers_point(found)) if cover == "point" else found


def fetch_by_ids(wanted: DataFrame, scenes: DataFrame) -> DataFrame:
    """Scenes named by ``wanted(request_id, ids)``, in requested order, missing ones dropped."""
    asked = wanted.select("request_id", F.posexplode("ids").alias("pos", "scene_id"))
    return asked.join(scenes, "scene_id")


def holding_collection(wanted: DataFrame, scenes: DataFrame, priority: dict[str, int]) -> DataFrame:
    """First collection, by priority, that holds any wanted id of a request."""
    rank = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])
    hits = (fetch_by_ids(wanted, scenes.filter(F.col("source").isin(*priority)))
            .withColumn("prio", rank[F.col("source")]))
    return hits.groupBy("request_id").agg(
        F.min_by("source", "prio").alias("source"), F.count(F.lit(1)).alias("n_found"))


def overlapping_ever(events: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every (event, scene) whose boxes meet, whenever the scene was taken; undated scenes too."""
    box = geo.aoi_box(F.col("lat"), F.col("lon"), F.col("radius_km"))
    return box_join(events.withColumn("aoi", box), scenes, "aoi", "bbox")


def nearest_outside(events: DataFrame, scenes: DataFrame, *, pre_days: int, post_days: int,
                    reach_days: int | None = None) -> DataFrame:
    """For every empty side, the nearest scene beyond the window and the days to widen to.

    Without ``reach_days`` the whole archive is searched, for events with an empty side only.
    """
    found = scene_search(events, scenes, pre_days=pre_days, post_days=post_days, rule="origin")
    sides = events.select("event_id", F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("side"))
    empty = sides.join(found.select("event_id", "side").distinct(), ["event_id", "side"], "left_anti")
    if reach_days is None:
        some = events.join(empty.select("event_id").distinct(), "event_id", "left_semi")
        wide = overlapping_ever(some, scenes.filter(F.col("acq").isNotNull())).withColumn(
            "side", F.when(F.col("acq") < F.col("origin"), "pre").otherwise("post")).withColumn("gap", timing.gap_days(F.col("acq"), F.col("origin")))
    else:
        wide = scene_search(events, scenes, pre_days=reach_days, post_days=reach_days, rule="origin")
    near = wide.groupBy("event_id", "side").agg(
        F.min_by(F.struct("scene_id", "gap"), F.struct("gap", "scene_id")).alias("hit"))
    return empty.join(near, ["event_id", "side"], "left").select(
        "event_id", "side", F.col("hit.scene_id").alias("scene_id"),
        F.when(F.col("side") == "pre", F.ceil("hit.gap"))
        .otherwise(F.floor("hit.gap") + 1).cast("bigint").alias("widen_to_days"))


def granule_list(events: DataFrame, granules: DataFrame, *, pre_days: int, post_days: int,
                 km_per_deg: float = geo.KM_PER_DEG_ALT) -> DataFrame:
    """Granules around each event with side, signed whole-day gap and track."""
    df = scene_search(events, granules, pre_days=pre_days, post_days=post_days,
                      rule="origin", km_per_deg=km_per_deg)
    signed = timing.signed_gap_days(F.col("acq"), F.col("origin"))
    return df.withColumn("signed_gap", timing.whole_days(signed))


def nearest_with_asset(granules: DataFrame, has_asset: Column) -> DataFrame:
    """Nearest granule per event and side among those carrying the asset."""
    return granules.filter(has_asset).groupBy("event_id", "side").agg(
        F.min_by(F.struct("scene_id", "signed_gap"),
                 F.struct(F.abs("signed_gap"), "gap", "scene_id")).alias("g")
    ).select("event_id", "side", "g.scene_id", "g.signed_gap")


# The L-band archive's calendar.
FIRST_SCIENCE = "2025-10-17 00:00:00"
INSTRUMENT_GAP = ("2026-07-28 00:00:00", "2026-08-10 00:00:00")
REPROCESSING = ("2026-01-21 00:00:00", "2026-06-17 00:00:00")
LATENCY_DAYS = 3


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def archive_applicable(origin: Column, post_days: int, first: str = FIRST_SCIENCE) -> Column:
    return origin + F.make_dt_interval(days=F.lit(post_days)) >= _ts(first)


def absence_reason(lo: Column, hi: Column, now: Column, *, first: str = FIRST_SCIENCE,
                   gap=INSTRUMENT_GAP, reprocessing=REPROCESSING,
                   latency_days: int = LATENCY_DAYS) -> Column:
    """Why an archive window [lo, hi] came back empty; NULL when nothing archive-wide applies."""
    us = timing.micros
    span = F.greatest(us(hi) - us(lo), F.lit(1_000_000))
    shared = F.greatest(F.lit(0), F.least(us(hi), us(_ts(reprocessing[1])))
                        - F.greatest(us(lo), us(_ts(reprocessing[0]))))
    return (F.when(hi < _ts(first), "before_first_science")
            .when(lo >= now - F.make_dt_interval(days=F.lit(latency_days)), "too_recent")
            .when((lo >= _ts(gap[0])) & (hi < _ts(gap[1])), "instrument_gap")
            .when(shared / span > 0.5, "reprocessing"))


def search_sources(events: DataFrame, scenes: DataFrame, sources, **kw) -> DataFrame:
    """One search over all the sources asked for; ``source_key`` says which one a scene is from."""
    return scene_search(events, scenes.filter(F.col("source").isin(*sources)), **kw).withColumn("source_key", F.col("source"))


def failed_sources(scenes: DataFrame, sources) -> DataFrame:
    """The sources asked for that the archive does not hold at all: ``source_key``."""
    asked = scenes.sparkSession.createDataFrame([(s,) for s in sources], "source_key string")
    return asked.join(scenes.select(F.col("source").alias("source_key")).distinct(), "source_key", "left_anti")


def merged_order(found: DataFrame, undated: DataFrame | None = None, key: str = "scene_id") -> DataFrame:
    """All sources of an event in one list with its ``rank``: nearest first, rows without a gap last, then source and id."""
    rows = found if undated is None else found.unionByName(undated, allowMissingColumns=True)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.col("gap").asc_nulls_last(), "source_key", key)).cast("bigint"))


def source_notes(events: DataFrame, found: DataFrame, sources, failed: DataFrame) -> DataFrame:
    """Scenes per side of every event and source asked for, with a code: ``failed`` where the source could not be
    searched, ``incomplete`` where a side is empty, null otherwise.  Other sources are not held up by one that fails.
    """
    wanted = events.select("event_id", F.explode(F.array(*[F.lit(s) for s in sources])).alias("source_key"))
    n = found.groupBy("event_id", "source_key").agg(F.count_if(F.col("side") == "pre").alias("n_pre"), F.count_if(F.col("side") == "post").alias("n_post"))
    lost = failed.select("source_key", F.lit(True).alias("_failed"))
    pre, post = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_pre", "n_post"))
    return wanted.join(n, ["event_id", "source_key"], "left").join(lost, "source_key", "left").select(
        "event_id", "source_key", pre.alias("n_pre"), post.alias("n_post"),
        F.when(F.col("_failed"), "failed").when((pre == 0) | (post == 0), "incomplete").alias("code"))


def optical_sources(origin: Column, s2_floor: str = "2016-01-01 00:00:00") -> Column:
    """Sources to ask, in order: Sentinel-2 only from its first year, then Landsat."""
    return F.when(origin >= _ts(s2_floor), F.array(F.lit("Sentinel-2"), F.lit("Landsat"))).otherwise(
        F.array(F.lit("Landsat")))
