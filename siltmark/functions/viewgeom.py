"""Very-high-resolution strips: incidence, grade, score and reasons as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltmark.functions import geo

# Nominal orbit heights, weights and limits of the triage.
ALTITUDE_KM = {"WV01": 496.0, "WV02": 770.0, "WV03": 617.0, "WV04": 617.0, "GE01": 681.0}
ALTITUDE_DEFAULT_KM = 650.0
TAU_PRE, TAU_POST = 30.0, 15.0
W_TAN, W_SUN, W_COVER, W_MISS, W_CLOUD = 2.0, 0.5, 1.0, 3.0, 0.5
W_DSUN_EL, W_DSUN_AZ, W_DTAN = 0.1, 0.0167, 0.5
SUN_SOFT, TAN_UNKNOWN, VISUAL_CAP = 25.0, 1.0, 45.0
SENSOR_GROUPS = ("WV01", "WV02", "WV03", "GE01")
OPTICAL_PRODUCTS = ("DAILY_TAKE", "PRIVATE_FEATURE")
EXCLUDED_PRODUCTS = ("VIVID_STANDARD_30", "VIVID_STANDARD", "VIVID_BASIC", "VIVID_ADVANCED",
                     "VIVID_ADVANCED_15", "VIVID_PREMIUM", "BASE_MOSAIC")
GRADES = ("mapping", "visual", "context")


def excluded(product: Column) -> Column:
    p = F.upper(F.coalesce(product, F.lit("")))
    return p.isin(*EXCLUDED_PRODUCTS) | p.startswith("VIVID")


def incidence_deg(ona: Column, sensor: Column) -> Column:
    """Incidence at the ground; the Earth curves away, so it exceeds the off-nadir angle."""
    table = F.create_map(*[x for k, v in ALTITUDE_KM.items() for x in (F.lit(k), F.lit(v))])
    h = F.coalesce(table[F.upper(F.coalesce(sensor, F.lit("")))], F.lit(ALTITUDE_DEFAULT_KM))
    x = (F.lit(geo.EARTH_KM) + h) / F.lit(geo.EARTH_KM) * F.sin(F.radians(F.abs(ona)))
    return F.when(x >= 1, F.lit(90.0)).otherwise(F.degrees(F.asin(x)))


def tan_incidence(inc: Column) -> Column:
    return F.coalesce(F.tan(F.radians(F.least(inc, F.when(inc.isNotNull(), F.lit(89.0))))), F.lit(TAN_UNKNOWN))


def relief_shift_m(ona: Column, sensor: Column, dh: float = 50.0) -> Column:
    """Sideways shift of ground that moved ``dh`` metres vertically; NULL without an angle."""
    inc = incidence_deg(ona, sensor)
    return F.when(ona.isNotNull(), F.lit(dh) * tan_incidence(inc))


def is_context(product: Column, sensor_type: Column, third_party: Column, multi_date: Column) -> Column:
    p = F.upper(F.coalesce(product, F.lit("")))
    no = F.lit(False)
    return (F.coalesce(third_party, no) | F.coalesce(multi_date, no)
            | (F.lower(F.coalesce(sensor_type, F.lit(""))) == "radar") | ((p != "") & ~p.isin(*OPTICAL_PRODUCTS)))


def grade(context: Column, level: Column, ona: Column, ona_max: float = 30.0) -> Column:
    lvl = F.upper(F.coalesce(level, F.lit("")))
    return (F.when(context, "context").when(~lvl.isin("", "LV3D"), "visual")
            .when(ona.isNull(), F.when(lvl == "LV3D", "mapping").otherwise("visual"))
            .when(ona <= ona_max, "mapping").otherwise("visual"))


def strip_score(gap: Column, side: Column, inc: Column, sun_el: Column, cover: Column,
                covers: Column, cloud: Column) -> Column:
    """Cost of a strip, lower is better."""
    zero = F.lit(0.0)
    sun = F.coalesce(F.greatest(zero, F.lit(SUN_SOFT) - sun_el) / 10.0, zero)
    sun = F.when(sun_el.isNull(), zero).otherwise(sun)
    cov = F.greatest(zero, F.least(F.lit(1.0), F.coalesce(cover, zero)))
    return (gap / F.when(side == "pre", F.lit(TAU_PRE)).otherwise(F.lit(TAU_POST))
            + F.lit(W_TAN) * tan_incidence(inc) + F.lit(W_SUN) * sun + F.lit(W_COVER) * (F.lit(1.0) - cov)
            + F.when(covers, zero).otherwise(F.lit(W_MISS))
            + F.lit(W_CLOUD) * F.greatest(zero, F.coalesce(cloud, zero)))


def pair_cost(a: Column, b: Column) -> Column:
    """Both scores plus light and look mismatches; a and b hold score, sun_el, sun_az, incidence."""
    d = F.pmod(F.abs(a["sun_az"] - b["sun_az"]), F.lit(360.0))
    zero = F.lit(0.0)
    return (a["score"] + b["score"] + F.coalesce(F.lit(W_DSUN_EL) * F.abs(a["sun_el"] - b["sun_el"]), zero)
            + F.when(d.isNull(), zero).otherwise(F.lit(W_DSUN_AZ) * F.least(d, F.lit(360.0) - d))
            + F.lit(W_DTAN) * F.abs(tan_incidence(a["incidence"]) - tan_incidence(b["incidence"])))


def sensor_group(sensor: Column) -> Column:
    s = F.upper(F.coalesce(sensor, F.lit("")))
    return F.when(s.isin(*SENSOR_GROUPS), s).otherwise("other")


def hidden_reasons(g: Column, ona: Column, sun_el: Column, cloud: Column, sensor: Column, third_party: Column, *,
                   show_visual: bool = True, sun_min: float = 15.0, cloud_max: float = 100.0,
                   sensors=None, show_third_party: bool = False) -> Column:
    """Short names of every filter that hides a strip; an empty array when it is listed."""
    steep = ona > VISUAL_CAP
    checks = [
        F.when(F.coalesce(third_party, F.lit(False)) & F.lit(not show_third_party), "third-party"),
        F.when((g == "visual") & F.coalesce(steep, F.lit(False)), "off-nadir > 45°")
         .when((g == "visual") & F.lit(not show_visual), "visual only"),
        F.when(sun_el < sun_min, "low sun"),
        F.when(cloud * 100.0 > cloud_max, "strip cloud"),
    ]
    if sensors is not None:
        checks.append(F.when(~sensor_group(sensor).isin(*sensors), "sensor not ticked"))
    return F.array_compact(F.array(*checks))


def hint_candidate(product: Column, context: Column, ona: Column) -> Column:
    """Could a widened window use this strip at all?"""
    return ~excluded(product) & ~context & (ona.isNull() | (ona <= VISUAL_CAP))
