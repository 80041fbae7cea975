"""Order ledger: find, reuse, newest per side, upsert and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import geo
from siltmark.operators.search import box_join

TOL_KM = 1.0


def record_box(bbox: Column, lat: Column, lon: Column, radius_km: Column) -> Column:
    """What a record delivered: its footprint, else the box around its centre."""
    return F.coalesce(bbox, F.when(lat.isNotNull() & lon.isNotNull(), geo.aoi_box(
        lat, lon, F.coalesce(radius_km, F.lit(0.0)), min_cos=0.05)))


def find(queries: DataFrame, ledger: DataFrame, *, side: str | None = None, need_ids: bool = False,
         need_radius: bool = False, tol_km: float = TOL_KM, need_point: bool = False) -> DataFrame:
    """Ledger records per query.  Location wins where both sides know theirs; else the event id decides.

    ``queries``: query_id, q_event, lat, lon, q_radius and, with ``need_ids``, q_ids.  ``ledger``: bbox and,
    where it has them, centre_lat and centre_lon with radius_km.  A query with neither location nor event finds
    nothing; ``recall`` without queries lists the ledger.  The rules are equi-joins, not one OR-join.
    """
    q = queries.withColumn("q_box", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), geo.aoi_box(
        F.col("lat"), F.col("lon"), F.coalesce("q_radius", F.lit(0.0)), min_cos=0.05)))
    rec = ledger
    if "centre_lat" in ledger.columns:
        rec = rec.withColumn("rec_box", record_box(F.col("bbox"), F.col("centre_lat"), F.col("centre_lon"), F.col("radius_km")))
    else:
        rec = rec.withColumn("rec_box", F.col("bbox"))
    if side:
        rec = rec.filter(F.col("side").isNull() | (F.col("side") == side))
    # a degree of longitude shrinks at most twentyfold (cosine floor), so this slack holds every hit
    placed = box_join(q.filter("q_box IS NOT NULL"), rec.filter("rec_box IS NOT NULL"), "q_box", "rec_box", slack_deg=tol_km / geo.KM_PER_DEG * 20)
    placed = placed.filter(geo.box_has_point(F.col("rec_box"), F.col("lon"), F.col("lat")) if need_point
                           else geo.boxes_meet_within(F.col("q_box"), F.col("rec_box"), tol_km))
    blind = rec.filter("rec_box IS NULL")
    named = q.filter("q_box IS NOT NULL").join(blind, F.col("q_event") == F.col("event_id"))
    unplaced = q.filter("q_box IS NULL").join(rec, F.col("q_event") == F.col("event_id"))
    out = placed.unionByName(named).unionByName(unplaced).drop("rec_box")
    if need_ids:
        out = out.filter(F.size(F.array_except("q_ids", "scene_ids")) == 0)
    if need_radius:
        out = out.filter(F.col("radius_km").isNull() | (F.col("radius_km") + 1e-9 >= F.col("q_radius")))
    return out


def recall(queries: DataFrame | None, ledger: DataFrame, **rules) -> DataFrame:
    """What a user can load again: the records found, newest first, each with its label; the whole ledger without queries."""
    got = ledger.withColumn("query_id", F.lit(None).cast("bigint")) if queries is None else find(queries, ledger, **rules)
    newest = Window.partitionBy("query_id").orderBy(F.col("created").desc_nulls_last(), F.col("order_id").desc())
    return got.select("query_id", "order_id", F.row_number().over(newest).alias("rank"),
                      describe(F.col("side"), F.col("scene_ids"), F.col("order_id").cast("string"), F.col("created")).alias("label"))


def newest_by_side(found: DataFrame, key: str = "query_id") -> DataFrame:
    """Newest record per side; records of unknown side only fill gaps, newest first."""
    s = F.coalesce("side", F.lit("any"))
    w = Window.partitionBy(key, s).orderBy(F.col("created").desc(), F.col("order_id").desc())
    two = found.select(key, s.alias("s"), "order_id", F.row_number().over(w).alias("n")).filter(F.col("n") <= 2)

    def pick(side: str, n: int) -> Column:
        return F.max(F.when((F.col("s") == side) & (F.col("n") == n), F.col("order_id")))
    g = two.groupBy(key).agg(pick("pre", 1).alias("p"), pick("post", 1).alias("q"),
                             pick("any", 1).alias("a1"), pick("any", 2).alias("a2"))
    return g.select(key, F.coalesce("p", "a1").alias("pre_order"),
                    F.coalesce("q", F.when(F.col("p").isNull(), F.col("a2")).otherwise(F.col("a1"))).alias("post_order"))


def reusable(found: DataFrame, bundle: str, legacy_ok: bool = True, key: str = "query_id") -> DataFrame:
    """Newest order of the right product for each query that already holds every wanted scene."""
    ok = F.col("bundle") == bundle
    if legacy_ok:
        ok = ok | F.col("bundle").isNull()
    return found.filter(ok).groupBy(key).agg(F.max_by("order_id", F.struct("created", "order_id")).alias("order_id"),
                                             F.count(F.lit(1)).alias("n_orders"))


def upsert(ledger: DataFrame, records: DataFrame, key: str = "order_id") -> DataFrame:
    """Records replace ledger rows of the same key."""
    return ledger.join(records.select(key), key, "left_anti").unionByName(records, allowMissingColumns=True)


def forget(ledger: DataFrame, keys: DataFrame, key: str = "order_id") -> DataFrame:
    return ledger.join(keys.select(key), key, "left_anti")


def backfill_box(ledger: DataFrame, delivered: DataFrame, key: str = "order_id") -> DataFrame:
    """Records without a footprint take the bounds of their own delivered rings."""
    ring = delivered.select(key, F.explode("rings").alias("ring")).select(key, geo.ring_box(F.col("ring")).alias("b"))
    got = ring.groupBy(key).agg(F.struct(F.min("b.w").alias("w"), F.min("b.s").alias("s"), F.max("b.e").alias("e"),
                                         F.max("b.n").alias("n")).alias("_got"))
    return ledger.join(got, key, "left").withColumn("bbox", F.coalesce("bbox", "_got")).drop("_got")


def scene_date(scene_id: Column) -> Column:
    d = F.regexp_extract(scene_id, r"^(\d{8})", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def describe(side: Column, scene_ids: Column, order_id: Column, created: Column) -> Column:
    """One line per order, led by the acquisition dates of its scenes."""
    dates = F.array_sort(F.array_distinct(F.array_compact(F.transform(scene_ids, scene_date))))
    n = F.size(dates)
    head = (F.when(n == 0, F.concat(F.lit("ordered "), F.coalesce(F.date_format(created, "yyyy-MM-dd"), F.lit("?"))))
            .when(n == 1, F.get(dates, F.lit(0)))
            .otherwise(F.concat(F.get(dates, F.lit(0)), F.lit("…"), F.element_at(dates, -1), F.lit(" ("), n.cast("string"), F.lit(")"))))
    more = F.size(scene_ids) - 2
    ids = F.concat(F.array_join(F.slice(scene_ids, 1, 2), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))
    return F.concat(F.coalesce(side, F.lit("?")), F.lit(" · "), head, F.lit(" · "),
                    F.when(F.size(scene_ids) > 0, ids).otherwise("scenes unknown"), F.lit(" · order "), F.substring(order_id, 1, 12))


def extents(ledger: DataFrame, key: str) -> DataFrame:
    """Bounds of all footprints of a group."""
    return ledger.filter(F.col("bbox").isNotNull()).groupBy(key).agg(
        F.min("bbox.w").alias("w"), F.min("bbox.s").alias("s"), F.max("bbox.e").alias("e"), F.max("bbox.n").alias("n"),
        F.count(F.lit(1)).alias("n_orders"))
