"""Radar change detectors on window statistics.

Frames come from ``focal.tiled``; each detector adds columns and leaves the layout
alone, so a whole detector set runs on one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.operators import focal
from siltmark.operators.blobs import small_blobs
from siltmark.operators.order_stats import medians, small_groups, with_median
from siltmark.session import stored

# Deposit sign of the signed detectors, significance cut and whether
# it applies to the magnitude, and the before-dates each detector needs.
DEPOSIT_SIGN = {"logratio": -1, "tsint": 1, "intcorr": None, "mtcorr": None}
SIGNIFICANT = {"logratio": ("abs", 3.0), "tsint": ("abs", 3.0), "intcorr": ("pos", 0.3), "mtcorr": ("pos", 0.8)}
BEFORE_DATES = {"mtcorr": 3, "tsint": 2, "intcorr": 2, "logratio": 1}
MAX_PRE = 6
TILED = ("_tr", "_tc")   # a cell's tile, by which its rows lie together: grouping on it too takes no shuffle


def db(ratio: Column) -> Column:
    return F.when(ratio > 0, F.lit(10.0) * F.log10(ratio))


def log_ratio(t: DataFrame, keys: list[str], pre: Column, post: Column, k: int, name: str = "logratio") -> DataFrame:
    """10 log10 of multilooked power before over after, on cells both scenes saw."""
    both = pre.isNotNull() & post.isNotNull()
    t = focal.box_mean(t, keys, {"_a": F.when(both, pre), "_b": F.when(both, post)}, k)
    return t.withColumn(name, db(F.col("_a") / F.nullif(F.col("_b"), F.lit(0.0)))).drop("_a", "_b")


def correlations(t: DataFrame, keys: list[str], pairs: dict[str, tuple[Column, Column]], k: int) -> DataFrame:
    """Windowed Pearson correlation of each named pair, all in one pass; NULL on starved or flat windows."""
    parts = {}
    for name, (a, b) in pairs.items():
        both = a.isNotNull() & b.isNotNull()
        av, bv = F.when(both, a).cast("double"), F.when(both, b).cast("double")
        parts |= {f"_{x}_{name}": v for x, v in (("n", both.cast("int")), ("a", av), ("b", bv), ("ab", av * bv), ("aa", av * av), ("bb", bv * bv))}
    t = focal.box_sum(t, keys, parts, k)
    out = []
    for name in pairs:
        s = {x: F.col(f"_{x}_{name}") for x in ("n", "a", "b", "ab", "aa", "bb")}
        n = F.nullif(s["n"], F.lit(0.0))
        ma, mb = s["a"] / n, s["b"] / n
        cov = s["ab"] / n - ma * mb
        va, vb = s["aa"] / n - ma * ma, s["bb"] / n - mb * mb
        rho = F.when(va * vb > 0, cov / F.sqrt(va * vb))
        ok = s["n"] >= k * k * 0.5
        out.append(F.when(ok & rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias(name))
    return t.select("*", *out).drop(*parts)


def correlation(t: DataFrame, keys: list[str], a: Column, b: Column, k: int, name: str = "rho") -> DataFrame:
    return correlations(t, keys, {name: (a, b)}, k)


def correlation_loss(ref: Column, co: Column) -> Column:
    """(ref - co) / (ref + co) with both correlations floored at 0.001."""
    def floored(x: Column) -> Column:
        return F.greatest(F.lit(1e-3), F.least(F.lit(1.0), x))
    r, c = floored(ref), floored(co)
    return F.when(ref.isNotNull() & co.isNotNull(), (r - c) / (r + c))


def possibility(refs: Column, cos: Column, h_floor: float = 0.03) -> Column:
    """How low the co-event correlations sit in the smoothed pre-event distribution.

    ``refs``/``cos``: arrays of non-NULL correlations (at most fifteen and six).
    """
    n = F.size(refs)
    mean = F.aggregate(refs, F.lit(0.0), lambda s, x: s + x) / F.nullif(n, F.lit(0))
    from siltmark.functions.geo import let

    def with_mean(m: Column) -> Column:
        var = F.aggregate(refs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n
        h = F.greatest(F.lit(1.06) * F.sqrt(var) * F.pow(n.cast("double"), F.lit(-0.2)), F.lit(h_floor))
        return let(h, lambda hh: F.aggregate(cos, F.lit(0.0), lambda s, x: s + F.aggregate(
            refs, F.lit(0.0), lambda u, r: u + F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-1.702) * F.greatest(
                F.lit(-40.0), F.least(F.lit(40.0), (r - x) / hh))))) / n) / F.size(cos))
    return F.when((n >= 3) & (F.size(cos) > 0), let(mean, with_mean))


def pair_correlations(stack: DataFrame, keys: list[str], k: int, tile: int = focal.TILE, before: int = MAX_PRE) -> DataFrame:
    """Windowed correlation of every scene pair of a stack.

    ``stack``: keys, row, col, n_rows, n_cols, pows = array<struct<idx, v>> of one cell
    (at most ``before`` before-scenes and the after-scene, idx -1), NULL where unseen.
    Returns keys, row, col, i, j, rho and the cell's tile, with j = -1 for the after-scene.
    Cells are shuffled and sorted once for all pairs.
    """
    t = focal.tiled(stack.select(*keys, "row", "col", "n_rows", "n_cols", "pows"), keys, (k - 1) // 2 + 1, tile)
    scenes = [*range(before), -1]

    def scene(i: int) -> Column:
        return F.get(F.filter("pows", lambda x: x["idx"] == i), F.lit(0))
    t = t.select(*keys, "row", "col", *TILED, "_core", *[scene(i).alias(f"_x{n}") for n, i in enumerate(scenes)])
    pairs = [(a, b) for a in range(before) for b in range(a + 1, before + 1)]
    t = correlations(t, keys, {f"_rho{a}_{b}": (F.col(f"_x{a}.v"), F.col(f"_x{b}.v")) for a, b in pairs}, k)
    rows = F.array_compact(F.array(*[F.when(F.col(f"_x{a}").isNotNull() & F.col(f"_x{b}").isNotNull(), F.struct(
        F.lit(a).alias("i"), F.lit(scenes[b]).alias("j"), F.col(f"_rho{a}_{b}").alias("rho"))) for a, b in pairs]))
    return t.filter("_core").select(*keys, "row", "col", *TILED, F.inline(rows))


def multi_temporal(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Possibility map from ``pair_correlations``; a cell's group holds at most 21 pairs."""
    ref, co = F.when(F.col("j") != -1, F.col("rho")), F.when(F.col("j") == -1, F.col("rho"))
    return (pairs.groupBy(*keys, *TILED, "row", "col")
            .agg(F.array_sort(F.collect_list(ref)).alias("refs"), F.array_sort(F.collect_list(co)).alias("cos"))
            .select(*keys, "row", "col", possibility(F.col("refs"), F.col("cos")).alias("mtcorr")))


def integral_correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation loss of the nearest pre-pre pair against the pre-post pair."""
    ref = F.max(F.when((F.col("i") == 0) & (F.col("j") == 1), F.col("rho")))
    co = F.max(F.when((F.col("i") == 0) & (F.col("j") == -1), F.col("rho")))
    return pairs.groupBy(*keys, *TILED, "row", "col").agg(ref.alias("r"), co.alias("c")).select(
        *keys, "row", "col", correlation_loss(F.col("r"), F.col("c")).alias("intcorr"))


def intensity_zscore(scenes: DataFrame, keys: list[str], k: int, sigma_floor: float = 0.75,
                     tile: int = focal.TILE) -> DataFrame:
    """Post brightness against the pre stack's own spread, in dB.

    ``scenes``: keys, idx (-1 is the after-scene), row, col, v.
    """
    kk = [*keys, "idx"]
    t = focal.box_mean(focal.tiled(scenes, keys, (k - 1) // 2 + 1, tile), kk, {"_m": F.col("v")}, k)
    d = t.filter("_core").select(*kk, "row", "col", db(F.col("_m")).alias("d"), *TILED)
    pre = F.when(F.col("idx") >= 0, F.col("d"))
    z = d.groupBy(*keys, *TILED, "row", "col").agg(
        F.count(pre).alias("n"), F.avg(pre).alias("mu"), F.stddev_pop(pre).alias("sd"),
        F.max(F.when(F.col("idx") == -1, F.col("d"))).alias("post"))
    return z.select(*keys, "row", "col", F.when(
        F.col("n") >= 2, (F.col("post") - F.col("mu")) / F.greatest("sd", F.lit(sigma_floor))).alias("tsint"))


def zscore(t: DataFrame, keys: list[str], pre: list[Column], post: Column, k: int, sigma_floor: float = 0.75) -> DataFrame:
    """``intensity_zscore`` of tiles with a column per scene; adds tsint."""
    names = [f"_m{n}" for n in range(len(pre) + 1)]
    t = focal.box_mean(t, keys, dict(zip(names, [*pre, post], strict=True)), k)
    d = [db(F.col(n)) for n in names]
    t = t.withColumns({"_d": F.array_compact(F.array(*d[:-1])), "_post": d[-1]}).drop(*names)

    def spread(s: Column, x: Column) -> Column:
        n, delta = s["n"] + 1, x - s["mu"]
        return F.struct(n.alias("n"), (s["mu"] + delta / n).alias("mu"), (s["m2"] + delta * (delta - delta / n)).alias("m2"))
    n = F.size("_d")
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mu"), F.lit(0.0).alias("m2"))
    sd = F.aggregate("_d", start, spread, lambda s: F.sqrt(s["m2"] / s["n"]))
    mu = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x) / n
    return t.withColumn("tsint", F.when(n >= 2, (F.col("_post") - mu) / F.greatest(sd, F.lit(sigma_floor)))).drop("_d", "_post")


def normalise(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Subtract each group's median (radiometric normalisation)."""
    med = medians(df, keys, F.col(value), "_med").select(*keys, "_med")
    return (df.join(med, keys, "left")
            .withColumn(value, F.col(value) - F.coalesce("_med", F.lit(0.0))).drop("_med"))


def significant(value: Column, kind: str) -> Column:
    how, cut = SIGNIFICANT[kind]
    return (F.abs(value) if how == "abs" else value) > cut


def finish(df: DataFrame, keys: list[str], kind: str, min_px: int = 8, tile: int = focal.TILE) -> DataFrame:
    """Normalise the signed detectors and sieve blobs smaller than ``min_px`` cells."""
    return finish_all(df, keys, [kind], min_px, tile)


def finish_all(maps: DataFrame, keys: list[str], kinds, min_px: int = 8, tile: int = focal.TILE, small: bool = False) -> DataFrame:
    """``finish`` of several kinds, a column each of one row per cell: blobs of all kinds are labelled as one graph and meet the cells once.

    ``small``: no key is known to have more cells than a task may sort.  The normalised maps are stored.
    """
    signed = [c for c in kinds if c in ("logratio", "tsint")]
    if not small:
        maps = stored(maps, "maps")
        small = small_groups(maps, keys)
    maps = maps.repartition(*keys) if small else maps
    for kind in signed:
        maps = with_median(maps, keys, kind, "_med").withColumn(kind, F.col(kind) - F.coalesce("_med", F.lit(0.0))).drop("_med") if small else normalise(maps, keys, kind)
    maps = stored(maps, "maps")
    mask = maps.select(*keys, "row", "col", "n_cols", F.explode(F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & significant(F.col(c), c), F.lit(c)) for c in kinds]))).alias("kind"))
    gone = small_blobs(mask, [*keys, "kind"], min_px, tile).groupBy(*keys, "row", "col").agg(F.collect_set("kind").alias("_small"))
    done = maps.join(gone, [*keys, "row", "col"], "left")
    return done.withColumns({c: F.when(F.array_contains("_small", c), F.lit(0.5 if c == "mtcorr" else 0.0)).otherwise(F.col(c)) for c in kinds}).drop("_small")


def deposit_oriented(value: Column, kind: str) -> Column:
    """Deposit positive, scar negative; NULL for the unsigned detectors."""
    s = DEPOSIT_SIGN.get(kind)
    return F.lit(None).cast("double") if s is None else value * s


def split_tails(value: Column, kind: str, threshold: float) -> Column:
    """struct<deposit, scar>: magnitudes beyond the threshold on either side."""
    o, t = deposit_oriented(value, kind), abs(threshold)
    return F.struct(F.when(o >= t, o).alias("deposit"), F.when(o <= -t, -o).alias("scar"))
