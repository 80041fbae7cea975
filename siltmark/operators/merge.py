"""Merging the change maps of several viewing geometries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators.order_stats import medians
from siltmark.operators.sar import DEPOSIT_SIGN


def _usable(value: str, masked: str) -> Column:
    return F.when(~F.coalesce(F.col(masked), F.lit(False)), F.col(value))


def strongest(maps: DataFrame, kind: str, threshold: float, agree_min: int = 2, keys=("event_id", "row", "col"),
              value: str = "v", masked: str = "masked") -> DataFrame:
    """Strongest anomaly wins, with a confidence per cell.

    ``maps``: keys, geom (0, 1, ...), v, masked.  Masks apply first.  Confidence: NULL no
    geometry saw it, 0 background, 1 recovered (others blind), 2 agreement, 3 conflict.
    """
    signed, thr = DEPOSIT_SIGN.get(kind) is not None, abs(threshold)
    agree_min = max(2, agree_min)
    m = maps.withColumn("_u", _usable(value, masked))
    u = F.col("_u")
    strength = F.abs(u) if signed else u
    anom = F.coalesce(strength >= thr, F.lit(False))
    g = m.groupBy(*keys).agg(
        F.max_by(u, F.when(u.isNotNull(), F.struct(strength, (-F.col("geom")).alias("g")))).alias("merged"),
        F.count(u).alias("n_valid"), F.count_if(anom).alias("n_anom"),
        F.coalesce(F.bool_or(anom & (u > 0)), F.lit(False)).alias("pos"),
        F.coalesce(F.bool_or(anom & (u < 0)), F.lit(False)).alias("neg"),
        F.count(value).alias("n_before"))
    clash = (F.col("pos") & F.col("neg")) if signed else F.lit(False)
    conf = (F.when(F.col("n_valid") == 0, F.lit(None))
            .when(F.col("n_anom") >= agree_min, F.when(clash, 3).otherwise(2))
            .when(F.col("n_anom") >= 1, F.when(F.col("n_valid") > F.col("n_anom"), 3).otherwise(1))
            .otherwise(0))
    return g.select(*keys, "merged", conf.cast("int").alias("confidence"), "n_valid", "n_before")


def merge_summary(merged: DataFrame, keys=("event_id",)) -> DataFrame:
    c = F.col("confidence")
    return merged.groupBy(*keys).agg(
        F.count_if(c == 1).alias("n_single"), F.count_if(c == 2).alias("n_agree"),
        F.count_if(c == 3).alias("n_conflict"),
        F.count_if((F.col("n_valid") == 1) & (F.col("n_before") > 1)).alias("n_mask_recovered"),
        F.count_if((F.col("n_valid") == 0) & (F.col("n_before") > 0)).alias("n_mask_blind"))


def agreeing_only(merged: Column, confidence: Column) -> Column:
    """Display copy: cells the geometries disagree about show nothing."""
    return F.when(confidence.isNull() | (confidence != 3), merged)


def choose_primary(maps: DataFrame, kind: str, n_cells: DataFrame, min_coverage: float = 0.5,
                   min_common: int = 1000, value: str = "v", masked: str = "masked") -> DataFrame:
    """The pass to lead a fill: quietest on ground every eligible pass sees.

    ``n_cells``: event_id, n_cells.  A pass under ``min_coverage`` is never chosen while
    another reaches it; with none eligible the best-covered pass leads.
    """
    signed = DEPOSIT_SIGN.get(kind) is not None
    u = maps.select("event_id", "geom", "row", "col", _usable(value, masked).alias("u"))
    per = u.groupBy("event_id", "geom").agg(F.count("u").alias("n_seen")).join(n_cells, "event_id")
    per = per.withColumn("coverage", F.col("n_seen") / F.col("n_cells"))
    per = per.withColumn("eligible", F.col("coverage") >= min_coverage)
    ev = Window.partitionBy("event_id")
    per = per.withColumn("n_eligible", F.count_if("eligible").over(ev))
    seen = u.filter(F.col("u").isNotNull()).join(
        per.filter("eligible").select("event_id", "geom", "n_eligible"), ["event_id", "geom"])
    cell = Window.partitionBy("event_id", "row", "col")
    seen = seen.withColumn("common", F.count(F.lit(1)).over(cell) == F.col("n_eligible"))
    share = seen.filter("common").groupBy("event_id").agg(
        (F.count(F.lit(1)) / F.first("n_eligible")).alias("n_common"))
    seen = seen.join(share, "event_id", "left")
    enough = F.coalesce(F.col("n_common") >= min_common, F.lit(False))
    used = seen.filter(~enough | F.col("common"))
    noise = medians(used, ["event_id", "geom"], F.abs("u") if signed else F.col("u"), "noise")
    j = per.join(noise.select("event_id", "geom", "noise"), ["event_id", "geom"], "left")
    order = F.struct((~F.col("eligible")).cast("int").alias("a"),
                     F.when(F.col("eligible"), F.col("noise")).otherwise(-F.col("coverage")).alias("b"), "geom")
    return j.groupBy("event_id").agg(
        F.min_by("geom", order).alias("primary_geom"), F.min_by("noise", order).alias("noise"),
        F.min_by("coverage", order).alias("coverage"))


def fill(maps: DataFrame, primary: DataFrame, keys=("event_id", "row", "col"), value: str = "v",
         masked: str = "masked") -> DataFrame:
    """The primary pass wherever it sees; others only in its blind spots, best-covered first.

    ``source``: 1 primary, 2 filled, NULL unseen.
    """
    m = maps.withColumn("_u", _usable(value, masked))
    seen = m.groupBy("event_id", "geom").agg(F.count("_u").alias("_seen"))
    m = m.join(seen, ["event_id", "geom"]).join(primary.select("event_id", "primary_geom"), "event_id")
    lead = F.col("geom") == F.col("primary_geom")
    order = F.when(F.col("_u").isNotNull(), F.struct(
        F.when(lead, 0).otherwise(1).alias("a"), (-F.col("_seen")).alias("b"), F.col("geom")))
    return m.groupBy(*keys).agg(
        F.min_by("_u", order).alias("filled"),
        F.min_by(F.when(lead, 1).otherwise(2), order).alias("source"),
        F.count(value).alias("n_any"))


def fill_summary(filled: DataFrame) -> DataFrame:
    s = F.col("source")
    return filled.groupBy("event_id").agg(
        F.count_if(s == 1).alias("n_primary"), F.count_if(s == 2).alias("n_filled"),
        F.count_if(s.isNull() & (F.col("n_any") > 0)).alias("n_blind"),
        F.count_if(F.col("n_any") == 0).alias("n_nodata"))
