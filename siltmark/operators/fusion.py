"""Evidence ranks, fusion of optical and radar evidence, and its weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators import cells as C
from siltmark.operators import focal
from siltmark.operators.order_stats import cumulative_counts, medians, named, small_groups, with_median
from siltmark.session import stored

# Evidence sign and absolute admission floor per change kind.
EVIDENCE_SIGN = {"dbright": -1, "dndsi": -1, "logratio": -1, "tsint": 1, "intcorr": 1, "mtcorr": 1}
MAGNITUDE_KINDS = ("logratio_mag",)
FLOORS = {"dbright": 0.05, "dndsi": 0.10, "logratio": 3.0, "tsint": 3.0, "logratio_mag": 1.0,
          "intcorr": 0.3, "mtcorr": 0.8}
SAR_ONLY, BOTH, OPTICAL_ONLY = 1, 2, 3
SAR_ONLY_WEIGHT = 0.5
SHOW_AT = 0.6


def orient(value: Column, kind: Column) -> Column:
    """Evidence-positive value; an unknown kind fails instead of guessing a sign."""
    out = F.when(kind.isin(*MAGNITUDE_KINDS), F.abs(value))
    for k, s in EVIDENCE_SIGN.items():
        out = out.when(kind == k, value * s)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown change kind "), kind)).cast("double"))


def floor_of(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in FLOORS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[kind], F.lit(0.0))


def detrend(df: DataFrame, keys: list[str], value: str, out: str, small: bool = False) -> DataFrame:
    """Subtract each group's median; groups without values keep theirs.  ``small``: tasks hold whole groups of few rows."""
    if small:
        df = with_median(df, keys, value, "_med")
    else:
        df = df.join(medians(df, keys, F.col(value), "_med").select(*keys, "_med"), keys, "left")
    return df.withColumn(out, F.col(value) - F.coalesce("_med", F.lit(0.0))).drop("_med")


def rank_above_floor(df: DataFrame, keys: list[str], value: str, floor: Column, admit: str | None = None,
                     out: str = "rank", small: bool = False) -> DataFrame:
    """Percentile rank among cells whose raw evidence clears an absolute floor.

    Ties take the highest rank, cells below the floor score 0, unmeasured cells NULL.
    ``admit`` names the raw column the floor is tested on when ``value`` is detrended.
    ``small``: tasks hold whole groups of few rows.
    """
    raw = F.col(admit or value)
    ok = F.col(value).isNotNull() & raw.isNotNull()
    if small:
        df = df.withColumn("_in", F.coalesce(ok & (raw >= floor), F.lit(False))).filter(~F.col("_in") | named(keys))
        share = F.cume_dist().over(Window.partitionBy(*keys, "_in").orderBy(value))
        return df.withColumn(out, F.when(F.col("_in"), share).when(ok, F.lit(0.0))).drop("_in")
    df = df.withColumn("_in", ok & (raw >= floor)).persist()
    c = cumulative_counts(df.filter("_in"), keys, F.col(value)).select(
        *keys, F.col("v").alias(value), (F.col("cum") / F.col("total")).alias(out))
    inside = df.filter("_in").join(c, [*keys, value])
    rest = df.filter(~F.coalesce("_in", F.lit(False))).withColumn(out, F.when(ok, F.lit(0.0)))
    return inside.unionByName(rest).drop("_in")


def evidence_rank(layers: DataFrame, keys: list[str], value: str = "v", kind: str = "kind") -> DataFrame:
    """Orient, detrend and rank long change layers (keys, kind, row, col, v).

    The layers are stored once.  If all layers of every key fit a task, they are shuffled once, by key, for medians,
    ranks and whatever is grouped by key and cell next; larger ones are ranged by value.
    """
    kk = [*keys, kind]
    layers = stored(layers, "layers")
    small = small_groups(layers, keys)
    df = (layers.repartition(*keys) if small else layers).withColumn("evidence", orient(F.col(value), F.col(kind)))
    df = detrend(df, kk, "evidence", "_d", small)
    return rank_above_floor(df, kk, "_d", floor_of(F.col(kind)), admit="evidence", small=small).drop("_d")


def combine_optical(a: Column, b: Column) -> Column:
    """Mean of two optical ranks; a missing one abstains."""
    return F.coalesce((a + b) / 2, a, b)


def combine_sar(a: Column, b: Column) -> Column:
    """Either detector firing counts; a missing one abstains."""
    return F.greatest(a, b)


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    """Hermite ramp; a degenerate ramp is a step at ``lo``."""
    if hi <= lo:
        return F.when(x.isNotNull(), F.when(x >= lo, 1.0).otherwise(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return F.when(x.isNotNull(), t * t * (F.lit(3.0) - F.lit(2.0) * t))


def lowland_weight(h: Column, min_elev_m: float = 15.0, ramp_m: float = 10.0) -> Column:
    """0 at tide level rising to 1; no height is no opinion."""
    return F.coalesce(smoothstep(h, min_elev_m, min_elev_m + max(1e-3, ramp_m)), F.lit(1.0))


def glacier_weight(t: DataFrame, keys: list[str], mask: Column, factor: float = 0.3, feather_k: int = 3) -> DataFrame:
    """1 off the glacier, ``factor`` on it, feathered at the edge; adds glacier_w."""
    t = focal.edge_mean(t, keys, "_g", mask.cast("double"), feather_k) if feather_k > 1 else t.withColumn("_g", mask.cast("double"))
    m = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_g")))
    return t.withColumn("glacier_w", F.lit(1.0) - m * F.lit(1.0 - factor)).drop("_g")


def slope_weight(dem: DataFrame, keys: list[str], k_row: int, k_col: int, dx_m: Column, dy_m: Column,
                 lo_deg: float = 10.0, hi_deg: float = 30.0, smooth_k: int = 3, tile: int = focal.TILE) -> DataFrame:
    """Weight from the steepest ground in a window around each cell; void cells stay NULL.

    ``dem``: keys, row, col, n_rows, n_cols, h dense.  ``k_row``/``k_col`` come from the
    search radius in metres through ``window_cells``.
    """
    t = focal.fill_voids(dem, keys, "h", tile)
    t = focal.tiled(t, keys, max(k_row, k_col) // 2 + smooth_k // 2 + 1, max(tile, 2 * max(k_row, k_col)))
    if smooth_k > 1:
        t = focal.box_mean(t, keys, {"_m": F.col("filled")}, smooth_k).withColumn("_s", F.coalesce("_m", "filled")).drop("_m")
    else:
        t = t.withColumn("_s", F.col("filled"))
    t = focal.slope_aspect(t, keys, F.col("_s"), dx_m, dy_m)
    t = focal.focal_max(t, keys, "slope_max", F.col("slope"), k_row, k_col)
    return focal.core(t).withColumn("slope_w", F.when(
        F.col("h").isNotNull(), smoothstep(F.col("slope_max"), lo_deg, hi_deg))).drop("_s")


def window_cells(radius_m: float, px_m: float) -> int:
    """Odd window width that reaches ``radius_m`` on an axis of ``px_m`` metres."""
    if radius_m <= 0 or px_m <= 0:
        return 1
    return max(1, int(round(2.0 * radius_m / px_m)) | 1)


def confidence(o: Column, s: Column) -> Column:
    return (F.when(o.isNotNull() & s.isNotNull(), BOTH).when(s.isNotNull(), SAR_ONLY)
            .when(o.isNotNull(), OPTICAL_ONLY))


def fuse(ranks: DataFrame, keys: list[str], *, mode: str = "mean", optical_n: int = 1, allow_sar_only: bool = True,
         sar_only_weight: float = SAR_ONLY_WEIGHT, smooth_k: int = 5, tile: int = focal.TILE, keep=()) -> DataFrame:
    """Score, confidence and the optical-only score of every cell, and the columns ``keep`` names.

    ``ranks``: keys, row, col dense with optical_rank, sar_rank and optional slope_w,
    glacier_w.  Smoothing comes before the product square and before the weights.
    """
    if mode not in ("mean", "geometric", "product"):
        raise ValueError(f"unknown fusion mode {mode!r}")
    o, s = F.col("optical_rank"), F.col("sar_rank")
    for w in ("slope_w", "glacier_w"):
        if w not in ranks.columns:
            ranks = ranks.withColumn(w, F.lit(1.0))
    n = max(1, optical_n)
    both = (o * n + s) / F.lit(float(n + 1)) if mode == "mean" else F.sqrt(F.greatest(o * s, F.lit(0.0)))
    g = F.when(o.isNotNull() & s.isNotNull(), both)
    if allow_sar_only:
        g = g.when(o.isNull(), s * sar_only_weight)
    df = ranks.withColumn("_g", g)
    if smooth_k > 1:
        t = focal.tiled(df, keys, smooth_k // 2 + 1, tile)
        t = focal.box_mean(t, keys, {"_gs": F.col("_g"), "_os": o}, smooth_k, min_frac=0.0)
        df = focal.core(t)
    else:
        df = df.withColumn("_gs", F.col("_g")).withColumn("_os", o)
    base = F.coalesce("_gs", "_g")
    score = base * base if mode == "product" else base
    sw, gw = F.coalesce("slope_w", F.lit(1.0)), F.coalesce("glacier_w", F.lit(1.0))
    return df.select(
        *keys, "row", "col", *keep, o, s, sw.alias("slope_weight"), gw.alias("glacier_weight"),
        (score * sw).alias("score_preglacier"), (score * sw * gw).alias("score"),
        confidence(o, s).alias("confidence"), (F.coalesce("_os", o) * sw * gw).alias("optical_only"))


def fuse_summary(fused: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col("confidence")
    return fused.groupBy(*keys).agg(
        F.count_if(c == BOTH).alias("n_both"), F.count_if(c == SAR_ONLY).alias("n_sar_only"),
        F.count_if(c == OPTICAL_ONLY).alias("n_optical_only"), F.count("score").alias("n_scored"),
        F.max("score").alias("max_score"))


def rank_summary(ranked: DataFrame, keys: list[str], evidence: str = "evidence", rank: str = "rank") -> DataFrame:
    """Valid and admitted cells per layer, and whether nothing cleared the floor."""
    n = F.count_if(F.col(rank) > 0)
    return ranked.groupBy(*keys).agg(F.count(rank).alias("n_valid"), n.alias("n_admitted"),
                                     F.max(F.when(F.col(rank) > 0, F.col(evidence))).alias("max_evidence"),
                                     (n == 0).alias("nothing_cleared"))


def cloud_vote(obs: DataFrame, dense: DataFrame, code: str, sensor: Column, frac: float = 0.5,
               missed: DataFrame | None = None, mask_dark: bool = False) -> DataFrame:
    """Cells whose optical change must count as missing.

    On either side, at least ``frac`` of the scenes that saw the cell (plus those that
    could not be read, which count as clear) flag it, or no scene saw it.  ``dense``:
    event_id, row, col and every side asked for; ``missed``: event_id, side, n_missed.
    """
    seen, bad = C.observed(F.col(code)), C.unusable(F.col(code), sensor, mask_dark)
    k = ["event_id", "row", "col", "side"]
    v = obs.groupBy(*k).agg(F.count_if(seen).alias("seen"), F.count_if(seen & bad).alias("votes"))
    j = dense.join(v, k, "left")
    j = j.join(missed, ["event_id", "side"], "left") if missed is not None else j.withColumn("n_missed", F.lit(0))
    n = F.coalesce("seen", F.lit(0)) + F.coalesce("n_missed", F.lit(0))
    flagged = F.when(n > 0, F.coalesce("votes", F.lit(0)) / n >= max(frac, 1e-6)).otherwise(False)
    unseen = (F.coalesce("seen", F.lit(0)) == 0) & (F.coalesce("n_missed", F.lit(0)) == 0)
    return j.groupBy("event_id", "row", "col").agg(
        F.bool_or(flagged | unseen).alias("cloud"), F.bool_or(unseen).alias("unseen"))


def mask_out(value: Column, mask: Column) -> Column:
    """Masked cells are missing, not unchanged."""
    return F.when(~F.coalesce(mask, F.lit(False)), value)
