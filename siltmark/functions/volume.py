"""Area to volume, thickness, depth and travel angle as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published source-scar fit (log10 alpha, its std, gamma, its std).
SCAR_FIT = {"bedrock": (-0.63, 0.06, 1.41, 0.02), "soil": (-0.649, 0.021, 1.262, 0.009)}
DEPTH_FLAG_M = 5.0
ROLE_WORDS = {
    "best": ("best", "mid", "middle", "medium"),
    "low": ("low", "lower", "min", "minimum", "conservative"),
    "high": ("high", "higher", "max", "maximum", "generous"),
}
TOTAL_SUBJECTS = (("total", "area"), ("total", "landslide"), ("landslide", "area"), ("total", "extent"))
SOURCE_SUBJECT = ("source", "area")


def coefficients(material: Column, table=None) -> Column:
    """Fit coefficients of a material; a fit without them is an error, never a guess."""
    table = SCAR_FIT if table is None else table
    out = F.lit(None)
    for name, values in table.items():
        out = F.when(material == name, F.array(*[F.lit(float(v)) for v in values])).otherwise(out)
    return F.coalesce(out, F.raise_error(F.concat(F.lit("no coefficients for material "), material)).cast("array<double>"))


def area_to_volume(best: Column, low: Column, high: Column, coef: Column) -> Column:
    """struct<volume, low, high>: power law with log-space error propagation.

    Both area bounds together count as the +-2 sigma range of the area; otherwise the
    fit uncertainty stands alone.
    """
    log_a = F.log10(best)
    log_v = coef[0] + coef[2] * log_a
    spread = ((log_a - F.log10(low)) + (F.log10(high) - log_a)) / 4.0
    s_area = F.when(low.isNotNull() & high.isNotNull(), spread).otherwise(F.lit(0.0))
    std = F.sqrt(coef[1] * coef[1] + log_a * log_a * coef[3] * coef[3] + coef[2] * coef[2] * s_area * s_area)
    ten = F.lit(10.0)
    return F.struct(F.pow(ten, log_v).alias("volume"), F.pow(ten, log_v - std).alias("low"),
                    F.pow(ten, log_v + std).alias("high"))


def order_problem(total: Column, best: Column, low: Column, high: Column) -> Column:
    """Code of an inconsistent outline assignment, NULL when consistent."""
    return (F.when(low > best, "low_above_best").when(high < best, "high_below_best")
            .when(best.isNotNull() & (low > high), "low_above_high")
            .when(total < F.greatest(best, low, high), "total_below_source"))


def implied_depth_m(volume: Column, area: Column) -> Column:
    return F.when((volume != 0) & (area > 0), volume / area)


def depth_flag(depth: Column) -> Column:
    """Thicker than almost any deposit on ice."""
    return F.coalesce(depth > DEPTH_FLAG_M, F.lit(False))


def travel(drop: Column, length: Column) -> Column:
    """struct<hl_ratio, reach_angle> of a fall over a run."""
    ok = length > 0
    return F.struct(F.when(ok, drop / length).alias("hl_ratio"),
                    F.when(ok, F.degrees(F.atan2(drop, length))).alias("reach_angle"))


# Deposit thickness settings in metres (best, low, high).
THICKNESS = {
    "glacier_far": (2.5, 1.5, 3.5), "glacier_near": (3.5, 3.0, 5.0), "ice_rich_near": (2.0, 1.0, 3.0),
    "ice_rich_far": (1.5, 1.0, 2.0), "small": (0.7, 0.4, 1.0), "confined": (5.5, 4.0, 8.0), "scar": (15.0, 5.0, 50.0),
}


def thickness_volume(area: Column, best: Column, low: Column, high: Column) -> Column:
    """struct<volume, low, high>: area times thickness; a bound on the wrong side is no bound."""
    return F.struct((area * best).alias("volume"), F.when(low < best, area * low).alias("low"),
                    F.when(high > best, area * high).alias("high"))


def thickness_setting(best: Column, low: Column, high: Column, tol: float = 1e-9) -> Column:
    """Name of the setting these three values are, NULL for a custom choice."""
    out = F.lit(None).cast("string")
    for key, (b, lo, hi) in THICKNESS.items():
        same = (F.abs(best - b) <= tol) & (F.abs(low - lo) <= tol) & (F.abs(high - hi) <= tol)
        out = F.when(same, key).otherwise(out)
    return out


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda t: t != "")


def has_all(tokens: Column, words) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))) == len(words)


def has_any(tokens: Column, words) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
