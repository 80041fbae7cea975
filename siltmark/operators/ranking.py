"""Ranking, top-k and one-of-a-kind choices.

Single winners are ``min_by``/``max_by`` aggregates (map-side combined, so one hot
event cannot overload a task); top-k uses ``row_number`` with a literal bound, which
Spark turns into a per-partition group limit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import timing


def blended_cost(gap: Column, cloud_pct: Column, weight: float = 0.5) -> Column:
    """Days from the event plus ``weight`` days per percent cloud; no figure counts as 100."""
    return gap + F.lit(weight) * F.coalesce(cloud_pct, F.lit(100.0))


def _half_even(x: float) -> int:
    return round(x)


def optical_cap(days: int) -> int:
    return max(12, min(24, _half_even(days / 5)))


def radar_cap(days: int) -> int:
    return max(12, min(24, _half_even(days / 4)))


# Fixed listing limits: a run composites six scenes, an automatic window one,
# the commercial listing shows sixty.
RUN_LIMIT, AUTO_LIMIT, PRODUCT_LIMIT = 6, 1, 60


def top_per_side(df: DataFrame, order, k: int, cap: Column | None = None,
                 keys=("event_id", "side")) -> DataFrame:
    """First ``k`` rows per group; ``cap`` may lower the bound per row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return out.filter(F.col("rank") <= cap) if cap is not None else out


def ranked_per_side(df: DataFrame, order, keys=("event_id", "side")) -> DataFrame:
    """Every row with its ``rank``; a list without a limit."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_by_cost(df: DataFrame, k: int = RUN_LIMIT, weight: float = 0.5) -> DataFrame:
    df = df.withColumn("cost", blended_cost(F.col("gap"), F.col("cloud_pct"), weight))
    return top_per_side(df, ("cost", "scene_id"), k)


def nearest_clearest(df: DataFrame, k: int) -> DataFrame:
    """Nearest day first, then the clearest of that day."""
    order = (F.bround("gap", 0), F.coalesce("cloud_pct", F.lit(100.0)), F.col("scene_id"))
    return top_per_side(df, order, k)


def adaptive_listing(df: DataFrame, pre_days: int, post_days: int, cap=optical_cap) -> DataFrame:
    """``nearest_clearest`` with a limit that grows with each side's own window."""
    lim = F.when(F.col("side") == "pre", F.lit(cap(pre_days))).otherwise(F.lit(cap(post_days)))
    order = (F.bround("gap", 0), F.coalesce("cloud_pct", F.lit(100.0)), F.col("scene_id"))
    return top_per_side(df, order, max(cap(pre_days), cap(post_days)), lim)


def one_frame_per_pass(df: DataFrame, misses: Column, distance: Column,
                       extra: Column | None = None) -> DataFrame:
    """One frame per (event, side, track, day): the one imaging the event, else the nearest.

    The kept frame takes the smallest gap of its pass, so the pass keeps its place
    in a nearest-first list.
    """
    day = F.col("acq").cast("date")
    order = [misses.cast("int"), distance] + ([extra] if extra is not None else [])
    cols = [c for c in df.columns if c not in ("event_id", "side", "relative_orbit")]
    return (df.groupBy("event_id", "side", "relative_orbit", day.alias("day")).agg(
        F.min_by(F.struct(*cols), F.struct(*order, F.col("gap"), F.col("scene_id"))).alias("f"),
        F.min(F.struct("gap", "scene_id")).alias("place"))
        .select("event_id", "side", "relative_orbit", "day", "f.*",
                F.col("place.gap").alias("pass_gap"), F.col("place.scene_id").alias("pass_id")))


def point_box_distance(bbox: Column, lon: Column, lat: Column) -> Column:
    """Degrees from a point to a box, 0 inside; a missing box is not penalised."""
    dx = F.greatest(bbox["w"] - lon, lon - bbox["e"], F.lit(0.0))
    dy = F.greatest(bbox["s"] - lat, lat - bbox["n"], F.lit(0.0))
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def one_per_day(df: DataFrame, keys=("event_id", "side")) -> DataFrame:
    """Nearest scene of every acquisition day."""
    day = F.col("acq").cast("date")
    cols = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys, day.alias("day"))
            .agg(F.min_by(F.struct(*cols), F.struct("gap", "scene_id")).alias("f"))
            .select(*keys, "day", "f.*"))


def review_rank(df: DataFrame, coverage: Column, covers: Column, aoi_cloud: Column,
                bad: Column, marks: int = 6) -> DataFrame:
    """Review order: covers the point, 5% coverage bucket, cloud over the AOI, gap.

    Unusable scenes are dropped.  ``star`` marks the first row of each side and
    ``ticked`` the first ``marks``.
    """
    usable = df.filter(~F.coalesce(bad, F.lit(False)))
    order = (covers.cast("int").desc(), F.bround(coverage * 20, 0).desc(),
             F.coalesce(aoi_cloud, F.col("cloud_pct"), F.lit(100.0)), F.col("gap"), F.col("scene_id"))
    top = top_per_side(usable, order, marks)
    return top.withColumn("star", F.col("rank") == 1).withColumn("ticked", F.col("rank") <= marks)


def first_two_sided_source(df: DataFrame, priority: list[str], keys=("event_id",)) -> DataFrame:
    """First source, by priority, that has scenes on both sides of the event."""
    prio = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    sides = df.filter(F.col("source").isin(*priority)).groupBy(*keys, "source").agg(
        F.count_if(F.col("side") == "pre").alias("n_pre"),
        F.count_if(F.col("side") == "post").alias("n_post"))
    return (sides.filter((F.col("n_pre") > 0) & (F.col("n_post") > 0)).groupBy(*keys)
            .agg(F.min_by(F.struct("source", "n_pre", "n_post"), prio).alias("s"))
            .select(*keys, "s.source", "s.n_pre", "s.n_post"))


def nearest_per_side(df: DataFrame, keys=("event_id", "side")) -> DataFrame:
    """As-of choice: the single nearest scene of each side."""
    return (df.groupBy(*keys).agg(F.min_by(F.struct("scene_id", "gap"), F.struct("gap", "scene_id")).alias("s"))
            .select(*keys, "s.scene_id", F.round("s.gap", 6).alias("gap")))


def supersede(entries: DataFrame) -> DataFrame:
    """Newest export per event key wins; every other one says why it is stale.

    ``entries``: stem, key, mtime.  A copy of the winner's stem is a superseded copy,
    anything else an older export.
    """
    from siltmark.functions.text import base_stem
    newest = entries.groupBy("key").agg(F.max_by("stem", F.struct("mtime", "stem")).alias("top"))
    j = entries.join(newest, "key")
    why = F.when(base_stem(F.col("stem")) == base_stem(F.col("top")), "superseded copy").otherwise("older export")
    return j.select("stem", "key", "mtime", F.when(F.col("stem") == F.col("top"), "").otherwise(why).alias("stale"))


def gap_display(acq: Column, origin: Column) -> Column:
    return timing.whole_days(timing.gap_days(acq, origin))
