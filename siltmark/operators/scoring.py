"""Scoring change maps against truth masks and comparing rule variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.operators.blobs import blob_stats, label_blobs
from siltmark.operators.focal import TILE
from siltmark.operators.order_stats import medians

MISS = 999


def score_map(cells: DataFrame, keys: list[str], show_at: float) -> DataFrame:
    """Background flagged at half recall, detected area and displayed false area.

    ``cells``: keys, score, is_scar, in_domain.  Unscored cells count as 0.
    """
    d = cells.filter("in_domain").withColumn("_s", F.coalesce("score", F.lit(0.0)))
    t = medians(d.filter("is_scar"), keys, F.col("_s"), "t50").select(*keys, "t50")
    j = d.join(t, keys)
    bg, scar = ~F.col("is_scar"), F.col("is_scar")

    def share(cond, of):
        return F.count_if(of & cond) / F.nullif(F.count_if(of), F.lit(0))
    return j.groupBy(*keys).agg(
        F.first("t50").alias("t50"),
        F.when(F.first("t50") > 0, share(F.col("_s") >= F.col("t50"), bg)).otherwise(F.lit(1.0)).alias("bg50"),
        share(F.col("_s") >= show_at, scar).alias("area"), share(F.col("_s") >= show_at, bg).alias("bg_flag"),
        share(F.col("score").isNull(), scar).alias("scar_unscored"))


def blind_share(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of cells each geometry, and both together, cannot see: keys, geom, masked per cell."""
    cell = masks.groupBy(*keys, "row", "col").agg(F.bool_and("masked").alias("_all"))
    both = cell.groupBy(*keys).agg(F.avg(F.col("_all").cast("double")).alias("blind_both"))
    one = masks.groupBy(*keys, "geom").agg(F.avg(F.col("masked").cast("double")).alias("blind"))
    return one.join(both, keys)


def truth_rank(cells: DataFrame, keys: list[str], show_at: float, min_px: int, tile: int = TILE) -> DataFrame:
    """Rank of the first blob that touches the truth, and how many blobs there are.

    ``cells``: keys, row, col, n_cols, score, is_scar.  Blobs order by peak, then size.
    A running rank is not needed: the rank is one more than the blobs that beat the best
    touching blob, which is a count.
    """
    blobs = label_blobs(cells.filter(F.col("score") >= show_at), keys, tile=tile)
    st = blob_stats(cells, blobs, keys).filter(F.col("n_px") >= min_px).select(*keys, "blob", "peak", "n_px")
    touch = blobs.join(cells.filter("is_scar").select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi").select(*keys, "blob").distinct()
    hit = st.join(touch, [*keys, "blob"], "left_semi").groupBy(*keys).agg(
        F.max(F.struct("peak", "n_px", (-F.col("blob")).alias("o"))).alias("best"))
    j = st.join(hit, keys, "left")
    beats = F.struct("peak", "n_px", (-F.col("blob")).alias("o")) > F.col("best")
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blobs"), F.when(
        F.first("best").isNotNull(), F.count_if(beats) + 1).alias("rank"))


def score_variants(maps: DataFrame, truth: DataFrame, keys: list[str], show_at: float) -> DataFrame:
    """``score_map`` of every rule variant of every event: keys, variant, t50, bg50, area, bg_flag, scar_unscored.

    ``maps``: keys, variant, row, col, score, one row per cell of each variant that exists; ``truth``: keys, row, col, is_scar.
    Truth made by ``densify`` is taken for small, so the join is merged.
    """
    return score_map(maps.join(truth.hint("merge"), [*keys, "row", "col"]).withColumn("in_domain", F.lit(True)), [*keys, "variant"], show_at)


def used_variant(scores: DataFrame, variants: list[str], key: str = "event") -> DataFrame:
    """Which variant's score stands for each variant of each event: its own, or the single pass's ('desc' if there is one)."""
    have = scores.groupBy(key).agg(F.collect_set("variant").alias("_v"))
    want = have.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    single = F.when(F.array_contains("_v", "desc"), "desc").when(F.array_contains("_v", "asc"), "asc")
    use = F.when(F.array_contains("_v", F.col("variant")) | (F.col("variant") == "none"), F.col("variant")).otherwise(single)
    return want.select(key, "variant", use.alias("used"))


def compare_variants(scores: DataFrame, variants: list[str], metric: str = "bg50", worst: str = "max", key: str = "event") -> DataFrame:
    """Worst case and mean of a metric per variant; a missing rank counts as ``MISS``.  ``scores``: key, variant, metric."""
    j = used_variant(scores, variants, key).join(scores.select(key, F.col("variant").alias("used"), metric), [key, "used"])
    v = F.coalesce(F.col(metric), F.lit(float(MISS))) if metric == "rank" else F.col(metric)
    return j.groupBy("variant").agg((F.max(v) if worst == "max" else F.min(v)).alias("worst"), F.avg(v).alias("mean"),
                                    F.count(F.lit(1)).alias("n_events"))


def variant_table(scores: DataFrame, variants: list[str], metric: str = "bg50", key: str = "event") -> DataFrame:
    """A row per event, a column per variant; a variant without a score of its own takes the single pass's, a missing rank is ``MISS``."""
    j = used_variant(scores, variants, key).join(scores.select(key, F.col("variant").alias("used"), metric), [key, "used"], "left")
    v = F.coalesce(F.col(metric).cast("double"), F.when(F.col("used").isNotNull(), F.lit(float(MISS)))) if metric == "rank" else F.col(metric)
    return j.groupBy(key).pivot("variant", variants).agg(F.max(v))
