"""Elevation candidates: strips, tile mosaics, national models and their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import geo, timing
from siltmark.operators.search import overlapping_ever

# Strip collections by hemisphere and the order of source tiers.
NORTH = ("arcticdem-strips-s2s041-2m", "earthdem-strips-s2s041-2m")
SOUTH = ("rema-strips-s2s041-2m", "earthdem-strips-s2s041-2m")
STRIP_SOURCES = ("arcticdem", "earthdem", "rema")
TIERS = ("3dep", "mrdem", "cop-glo30")
LIMIT = 16  # strips listed a side


def strip_collections(lat: Column) -> Column:
    return F.when(lat >= 0, F.array(*[F.lit(c) for c in NORTH])).otherwise(F.array(*[F.lit(c) for c in SOUTH]))


def seamless_resolution(gsd: Column) -> Column:
    """10 or 30 m product, from the tile's posting."""
    return F.when(F.coalesce(gsd, F.lit(10.0)) < 20, 10).otherwise(30)


def tile_mosaics(tiles: DataFrame, keys=("event_id", "dem_source")) -> DataFrame:
    """One candidate per AOI and source listing every tile; the newest tile dates it.

    A group is the tiles one search box touches.
    """
    clean = F.regexp_replace("href", r"\?.*$", "")
    g = tiles.filter(F.col("href").isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_set(clean)).alias("dem_urls"), F.max("acq").alias("acq"), F.min("resolution_m").alias("resolution_m"))
    return g.withColumn("id", F.concat(F.col("dem_source"), F.lit("-"), F.size("dem_urls").cast("string"), F.lit("tile")))


def national_model(items: DataFrame) -> DataFrame:
    """Bare-earth and surface candidates of one national item."""
    both = F.array(F.struct(F.col("dtm").alias("href"), F.lit("mrdem-30").alias("dem_source"), F.lit(False).alias("is_dsm")),
                   F.struct(F.col("dsm").alias("href"), F.lit("mrdem-30-dsm").alias("dem_source"), F.lit(True).alias("is_dsm")))
    return items.select("event_id", F.explode(both).alias("c")).select("event_id", "c.*").filter(F.col("href").isNotNull())


def degree_tiles(events: DataFrame) -> DataFrame:
    """1-degree tiles under each search box with their file name."""
    b = geo.aoi_box(F.col("lat"), F.col("lon"), F.col("radius_km"))
    e = events.withColumn("_b", b)
    t = e.select("event_id", "_b", F.explode(F.sequence(F.floor("_b.s"), F.floor("_b.n"))).alias("la")).select(
        "event_id", "la", F.explode(F.sequence(F.floor("_b.w"), F.floor("_b.e"))).alias("lo"))
    ns = F.format_string("%s%02d", F.when(F.col("la") >= 0, "N").otherwise("S"), F.abs("la"))
    ew = F.format_string("%s%03d", F.when(F.col("lo") >= 0, "E").otherwise("W"), F.abs("lo"))
    return t.withColumn("tile", F.concat(F.lit("Copernicus_DSM_COG_10_"), ns, F.lit("_00_"), ew, F.lit("_00_DEM")))


def existing_tiles(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Ocean cells have no tile: keep only those the archive lists."""
    return wanted.join(have.select("tile"), "tile", "left_semi")


def tier(source: Column) -> Column:
    """0 for strips, then the fallbacks in order, 99 for anything else."""
    out = F.when(source.isin(*STRIP_SOURCES), 0)
    for i, t in enumerate(TIERS):
        out = out.when(source.startswith(t), 1 + i)
    return out.otherwise(99)


def rank_key(source: Column, covers: Column, acq: Column, resolution_m: Column) -> Column:
    """Sort key: tier, covering the point, then newest strip or finest fallback."""
    t = tier(source)
    age = -F.coalesce(F.date_format(acq, "yyyyMMdd").cast("int"), F.lit(0)).cast("double")
    return F.struct(t.alias("tier"), (~covers).cast("int").alias("misses"),
                    F.when(t == 0, age).otherwise(F.coalesce(resolution_m, F.lit(999.0))).alias("within"))


TILES = 20


def strip_cover(events: DataFrame, strips: DataFrame) -> DataFrame:
    """Share of each search box under any strip: the exact area of the union of boxes.

    The search box is cut into ``TILES`` x ``TILES`` tiles.  A tile that one strip fills is done; in the others the
    edges cut slabs, and a running maximum over each slab's intervals counts overlaps once.  So only strips with
    an edge inside a tile meet there, not all strips of an event.
    ``strips``: event_id, bbox; a box without area adds nothing.
    """
    b = geo.aoi_box(F.col("lat"), F.col("lon"), F.col("radius_km"))
    j = strips.select("event_id", "bbox").join(events.select("event_id", b.alias("_b")), "event_id")

    def place(edge: str, lo: str, hi: str) -> Column:
        """An edge on one axis in tiles, inside the search box."""
        at = (F.col(f"bbox.{edge}") - F.col(f"_b.{lo}")) / (F.col(f"_b.{hi}") - F.col(f"_b.{lo}")) * TILES
        return F.least(F.greatest(at, F.lit(0.0)), F.lit(float(TILES)))

    box = j.select("event_id", place("w", "w", "e").alias("x0"), place("e", "w", "e").alias("x1"),
                   place("s", "s", "n").alias("y0"), place("n", "s", "n").alias("y1")).filter("x0 < x1 AND y0 < y1").distinct()
    tiled = box.withColumn("i", F.explode(F.sequence(F.floor("x0"), F.ceil("x1") - 1))).withColumn(
        "j", F.explode(F.sequence(F.floor("y0"), F.ceil("y1") - 1)))
    at = ["event_id", "i", "j"]
    part = tiled.select(*at, *[F.least(F.greatest(F.col(c) - F.col(t), F.lit(0.0)), F.lit(1.0)).alias(c)
                               for c, t in (("x0", "i"), ("x1", "i"), ("y0", "j"), ("y1", "j"))]).distinct()
    fills = "x0 = 0 AND x1 = 1 AND y0 = 0 AND y1 = 1"
    filled = part.filter(fills).select(*at).distinct()
    open_ = part.filter(f"NOT ({fills})").join(filled, at, "left_anti")
    edges = open_.select(*at, F.explode(F.array("x0", "x1")).alias("lo")).distinct()
    slabs = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy(*at).orderBy("lo"))).filter("hi IS NOT NULL")
    inside = slabs.join(open_, at).filter("x0 <= lo AND hi <= x1").select(*at, "lo", "hi", "y0", "y1")
    above = F.max("y1").over(Window.partitionBy(*at, "lo").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1))
    gain = inside.select("event_id", ((F.col("hi") - F.col("lo")) * F.greatest(
        F.col("y1") - F.greatest("y0", F.coalesce(above, F.col("y0"))), F.lit(0.0))).alias("area"))
    area = gain.unionByName(filled.select("event_id", F.lit(1.0).alias("area"))).groupBy("event_id").agg(F.sum("area").alias("area"))
    return events.select("event_id").join(area, "event_id", "left").select(
        "event_id", (F.coalesce("area", F.lit(0.0)) / float(TILES * TILES)).alias("cover"))


def full_search(events: DataFrame, strips: DataFrame, tiles: DataFrame, national: DataFrame, *, pre_days: int = 1825, post_days: int = 730,
                limit: int = LIMIT, lidar: str = "3dep-dsm", world: str = "cop-glo30") -> DataFrame:
    """Everything an elevation search finds per event, in one result: strips, undated fallbacks and notes.

    Strips come per side, nearest first up to ``limit``; fallbacks (tile mosaics, national models) ride on the pre
    side without date or gap.  A note is a code: ``widen`` names the nearest strip beyond an empty side's window and the
    days that reach it (neither where there is none), ``no_lidar``, ``national`` and ``world`` say which fallbacks
    are missing or came in.  One range join serves strips and notes.  ``tiles``: event_id, dem_source, href, acq,
    resolution_m; ``national``: event_id, dtm, dsm.
    Returns event_id, kind, side, dem_source, id, gap_days, code, widen_to_days.
    """
    day = F.to_date("acq")
    met = overlapping_ever(events, strips.filter(F.col("acq").isNotNull())).select(
        "event_id", "dem_source", F.col("scene_id").cast("string").alias("id"), timing.gap_days(F.col("acq"), F.col("origin")).alias("gap_days"),
        timing.day_side(F.col("acq"), timing.day_windows(F.col("origin"), pre_days, post_days)).alias("inside"),
        F.when(day < F.to_date("origin"), "pre").when(day > F.to_date("origin"), "post").alias("side"),
        F.abs(F.datediff(F.to_date("origin"), day)).cast("bigint").alias("days"))
    nearest = Window.partitionBy("event_id", "side").orderBy("gap_days", "id")
    found = met.filter("inside IS NOT NULL").withColumn("_rn", F.row_number().over(nearest)).filter(F.col("_rn") <= limit)
    sides = events.select("event_id", F.explode(F.array(F.lit("pre"), F.lit("post"))).alias("side"))
    beyond = met.filter("side IS NOT NULL").groupBy("event_id", "side").agg(
        F.bool_or(F.col("inside").isNotNull()).alias("any"), F.min_by(F.struct("id", "days"), F.struct("gap_days", "id")).alias("hit"))
    widen = sides.join(beyond, ["event_id", "side"], "left").filter("any IS NULL OR NOT any").select(
        "event_id", "side", F.col("hit.id").alias("id"), F.lit("widen").alias("code"), F.col("hit.days").alias("widen_to_days"))
    mosaics = tile_mosaics(tiles).select("event_id", "dem_source", "id")
    models = national_model(national).select("event_id", "dem_source", F.col("href").alias("id"))
    tiers = mosaics.unionByName(models)
    has = tiers.groupBy("event_id").agg(*[F.max(c).alias(n) for n, c in (
        ("lidar", F.col("dem_source") == lidar), ("national", F.col("dem_source").startswith("mrdem")), ("world", F.col("dem_source") == world))])
    codes = F.array_compact(F.array(F.when(~F.coalesce("lidar", F.lit(False)), "no_lidar"), F.when(F.col("national"), "national"), F.when(F.col("world"), "world")))
    told = events.select("event_id").join(has, "event_id", "left").select("event_id", F.explode(codes).alias("code"))
    shape = {"event_id": None, "kind": "string", "side": "string", "dem_source": "string", "id": "string", "gap_days": "double", "code": "string",
             "widen_to_days": "bigint"}
    parts = [found.withColumn("kind", F.lit("strip")), tiers.withColumns({"kind": F.lit("tier"), "side": F.lit("pre")}),
             widen.withColumn("kind", F.lit("note")), told.withColumn("kind", F.lit("note"))]
    rows = [x.select(*[F.col(c) if c in x.columns else F.lit(None).cast(t).alias(c) for c, t in shape.items()]) for x in parts]
    return reduce(DataFrame.unionByName, rows)


def default_choice(candidates: DataFrame, cover: DataFrame) -> DataFrame:
    """Best strip when one covers the point or strips blanket half the box, else the best fallback."""
    c = candidates.withColumn("_t", tier(F.col("dem_source")))
    key = rank_key(F.col("dem_source"), F.col("covers"), F.col("acq"), F.col("resolution_m"))
    order = F.struct(key.alias("k"), F.col("id"))
    strip, other = F.col("_t") == 0, F.col("_t").between(1, 98)
    g = c.groupBy("event_id").agg(
        F.min_by("id", F.when(strip, order)).alias("_strip"), F.min_by("id", F.when(other, order)).alias("_other"),
        F.coalesce(F.bool_or(strip & F.col("covers")), F.lit(False)).alias("_point"))
    j = g.join(cover, "event_id", "left")
    good = F.col("_point") | (F.coalesce("cover", F.lit(0.0)) >= 0.5)
    return j.select("event_id", F.when(good, F.coalesce("_strip", "_other")).otherwise(F.coalesce("_other", "_strip")).alias("id"))
