"""Gaps, windows and time text as Column expressions.  All times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def signed_gap_days(acq: Column, origin: Column) -> Column:
    """Days from the event to the acquisition, negative before it."""
    return (micros(acq) - micros(origin)) / F.lit(float(DAY_US))


def gap_days(acq: Column, origin: Column) -> Column:
    return F.abs(signed_gap_days(acq, origin))


def whole_days(days: Column) -> Column:
    """Half-even rounding, the way gaps are displayed."""
    return F.bround(days, 0).cast("bigint")


def day_windows(origin: Column, pre_days: int, post_days: int) -> Column:
    """struct of day bounds: the day before the event back, the day after forward."""
    def d(days: int) -> Column:
        return (origin + F.make_dt_interval(days=F.lit(days))).cast("date")
    return F.struct(d(-pre_days).alias("pre0"), d(-1).alias("pre1"),
                    d(1).alias("post0"), d(post_days).alias("post1"))


def day_side(acq: Column, windows: Column) -> Column:
    """'pre' / 'post' / NULL under ``day_windows`` (whole days)."""
    day = acq.cast("date")
    return (F.when(day.between(windows["pre0"], windows["pre1"]), "pre")
            .when(day.between(windows["post0"], windows["post1"]), "post"))


def origin_side(acq: Column, origin: Column, pre_days: int, post_days: int,
                now: Column | None = None) -> Column:
    """Side split exactly at the origin: before is ``acq < origin``."""
    lo = origin - F.make_dt_interval(days=F.lit(pre_days))
    hi = origin + F.make_dt_interval(days=F.lit(post_days))
    if now is not None:
        hi = F.least(hi, now)
    return (F.when((acq >= lo) & (acq < origin), "pre")
            .when((acq >= origin) & (acq <= hi), "post"))


def parse_time(text: Column) -> Column:
    """ISO text to a UTC timestamp: Z, an offset, fractions or a date alone; else NULL."""
    t = F.nullif(F.trim(text), F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
    )


def local_label(utc: Column, zone: str = "America/Anchorage") -> Column:
    """'2026-07-31 16:18 AKDT (previous day)': local wall time and the date trap."""
    ts = utc.cast("timestamp")
    local = F.from_utc_timestamp(ts, zone)
    hours = F.round((micros(local) - micros(ts)) / 3.6e9).cast("int")
    name = F.when(hours == -8, "AKDT").otherwise("AKST")
    shift = (F.when(local.cast("date") < ts.cast("date"), " (previous day)")
             .when(local.cast("date") > ts.cast("date"), " (next day)").otherwise(""))
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(" "), name, shift)


def lag_hours(created: Column, acq: Column) -> Column:
    return (micros(created) - micros(acq)) / F.lit(3.6e9)
