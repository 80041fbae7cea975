"""Tone curves: reflectance to 0-255 per cell, and the scene values that fit them.

Curves are column steps on a wide table (red, green, blue, plus scene columns such as
``white``); each step is its own projection, so nothing is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.operators.order_stats import quantiles
from siltmark.session import written

# Fixed values of the tone curves.
WHITE, KNEE, CONTRAST = 0.30, 0.55, 1.15
DESAT, DESAT_ONSET = 1.0, 0.5
BLUE_DESAT, BLUE_K, BLUE_LO, BLUE_HI = 0.6, 0.18, 0.08, 0.22
CYAN_STRIP, PINK_STRIP, CAST_K, PINK_LO, PINK_HI = 1.0, 1.0, 30.0, 175.0, 210.0
LIFT, LIFT_TAPER, HDR_SATURATION = 60.0, 2.0, 0.7
HDR_PCT, HDR_MIN, HDR_MAX, HDR_FALLBACK, HDR_MIN_N = 0.995, 0.30, 1.30, 0.90, 5000
AUTO_DARK_FULL, AUTO_DARK_MIN, AUTO_BLACK, AUTO_WHITE = 0.05, 0.005, 0.001, 0.99
AUTO_MARGIN, AUTO_WHITE_MAX, AUTO_ONSET_MAX, AUTO_MIN_SPAN, AUTO_MIN_N = 0.10, 1.0, 0.95, 0.05, 50000
HAZE_PCT, HAZE_MARGIN, HAZE_MAX = 0.001, 0.10, 0.15
BRIGHT_PCT, MIN_ANCHOR, MAX_GAIN = 0.85, 0.50, 1.8

RGB = ("red", "green", "blue")


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _ease(u: Column) -> Column:
    return u * u * (F.lit(3.0) - F.lit(2.0) * u)


def linear(refl: Column, white: float = WHITE, black: float = 0.0) -> Column:
    """Plain clipped stretch."""
    v = _unit((F.greatest(refl, F.lit(0.0)) - black) / max(white - black, 1e-6)) * 255.0
    return F.greatest(v, F.lit(1.0)) if black > 0 else v


def contrast(d: Column, k: float) -> Column:
    """Sigmoid gain that pins both ends and pivots at one half."""
    if k == 1.0:
        return d
    c = _unit(d)
    return F.when(c < 0.5, 0.5 * F.pow(2.0 * c, F.lit(k))).otherwise(1.0 - 0.5 * F.pow(2.0 - 2.0 * c, F.lit(k)))


def cube_root(refl: Column, k: float = 1.0) -> Column:
    """Even detail over the whole range: cube root of 0.6 reflectance."""
    return contrast(_unit(F.cbrt(0.6 * F.greatest(refl, F.lit(0.0)))), k) * 255.0


def shoulder(d: Column, knee: float = KNEE) -> Column:
    """Identity to the knee, then an asymptote to 1 with slope 1 where it leaves."""
    t = F.greatest((d - knee) / (1.0 - knee), F.lit(-50.0))
    return F.when(d <= knee, d).otherwise(knee + (1.0 - knee) * (1.0 - F.exp(-t)))


def _strip(df: DataFrame, strength: float, cool: bool, gate=None) -> DataFrame:
    if strength <= 0:
        return df
    r, g, b = (F.col(f"_{c}") for c in RGB)
    df = df.withColumn("_y", 0.299 * r + 0.587 * g + 0.114 * b)
    w = _unit(((b - r) if cool else (r - b)) / CAST_K) * strength
    if gate:
        w = w * _ease(_unit((F.col("_y") - gate[0]) / (gate[1] - gate[0])))
    df = df.withColumn("_w", w)
    return df.withColumns({f"_{c}": F.col(f"_{c}") + (F.col("_y") - F.col(f"_{c}")) * F.col("_w") for c in RGB})


def rolloff(df: DataFrame, white: Column, black: Column | None = None, onset: Column | None = None, *, knee: float = KNEE,
            k: float = 1.0, desat: float = DESAT, blue_desat: float = BLUE_DESAT, cyan: float = CYAN_STRIP,
            pink: float = PINK_STRIP, lift: float = 0.0, out=("r", "g", "b")) -> DataFrame:
    """Highlight roll-off: terrain stays linear, bright snow is compressed and neutralised."""
    black = F.lit(0.0) if black is None else black
    onset = F.lit(DESAT_ONSET) if onset is None else onset
    keep = df.columns
    df = df.withColumns({f"_{c}": F.greatest(F.col(c), F.lit(0.0)) for c in RGB})
    df = df.withColumn("_max", F.when(F.col("red").isNotNull() & F.col("green").isNotNull() & F.col("blue").isNotNull(),
                                      F.greatest("_red", "_green", "_blue")))
    df = df.withColumn("_black", black).withColumn("_span", F.greatest(white - F.col("_black"), F.lit(1e-6)))
    df = df.withColumns({f"_{c}": (F.col(f"_{c}") - F.col("_black")) / F.col("_span") for c in RGB})
    df = df.withColumn("_m", F.greatest("_red", "_green", "_blue"))
    df = df.withColumn("_sh", shoulder(F.col("_m"), knee))
    if lift > 0:
        df = df.withColumn("_u", F.greatest(F.col("_sh"), F.lit(0.0)))
        lifted = F.log1p(F.lit(lift) * F.col("_u")) / F.log1p(F.lit(lift))
        df = df.withColumn("_sh", F.col("_u") + (lifted - F.col("_u")) * F.pow(F.greatest(1.0 - F.col("_u"), F.lit(0.0)), F.lit(LIFT_TAPER)))
    df = df.withColumn("_gain", F.col("_sh") / F.when(F.col("_m") != 0, F.col("_m")).otherwise(F.lit(1.0)))
    df = df.withColumn("_d", desat * _ease(_unit((F.col("_max") - onset) / F.greatest(1.0 - onset, F.lit(1e-6)))))
    df = df.withColumns({f"_{c}": F.col(f"_{c}") * F.col("_gain") for c in RGB})
    df = df.withColumns({f"_{c}": F.col(f"_{c}") + (F.col("_sh") - F.col(f"_{c}")) * F.col("_d") for c in RGB})
    if blue_desat > 0:
        tint = _unit((F.col("_blue") - F.greatest("_red", "_green")) / BLUE_K)
        gate = _ease(_unit((F.col("_max") - BLUE_LO) / (BLUE_HI - BLUE_LO)))
        ratio = _unit((F.col("_max") - F.col("_black")) / F.greatest(F.col("_max"), F.lit(1e-6)))
        df = df.withColumn("_bd", _unit((1.0 - (1.0 - blue_desat) * ratio) * tint * gate))
        df = df.withColumns({f"_{c}": F.col(f"_{c}") + (F.col("_sh") - F.col(f"_{c}")) * F.col("_bd") for c in RGB})
    df = df.withColumns({f"_{c}": contrast(_unit(F.col(f"_{c}")), k) * 255.0 for c in RGB})
    df = _strip(_strip(df, cyan, True), pink, False, (PINK_LO, PINK_HI))
    floor = F.when(F.col("_black") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    cols = [F.when(F.col("_max").isNotNull(), F.when(F.col("_black") > 0, F.least(F.lit(255.0), F.greatest(floor, F.col(f"_{c}"))))
                   .otherwise(F.col(f"_{c}"))).alias(o) for c, o in zip(RGB, out)]
    return df.select(*keep, *cols)


def hdr(df: DataFrame, white: Column, *, k: float = CONTRAST, out=("r", "g", "b")) -> DataFrame:
    """Roll-off with a tapered shadow lift; bytes 1-254, 0 where unmeasured."""
    s = HDR_SATURATION
    df = rolloff(df, white, k=k, desat=DESAT * s, blue_desat=BLUE_DESAT * s, cyan=CYAN_STRIP * s, pink=PINK_STRIP * s, lift=LIFT, out=out)
    return df.withColumns({c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(
        F.floor(F.greatest(F.lit(1.0), F.least(F.lit(254.0), F.col(c)))).cast("int")) for c in out})


def channel_max(*bands: Column) -> Column:
    """Largest band, NULL unless all are measured."""
    ok = bands[0].isNotNull()
    for b in bands[1:]:
        ok = ok & b.isNotNull()
    return F.when(ok, F.greatest(*bands))


def hdr_white(df: DataFrame, keys: list[str], min_n: int = HDR_MIN_N) -> DataFrame:
    """White anchor per scene pair, pooled over both sides so a swipe shows no step."""
    m = channel_max(*[F.col(c) for c in RGB])
    q = quantiles(df, keys, m, {"p": HDR_PCT})
    return q.select(*keys, F.when(F.col("n_values") < min_n, F.lit(HDR_FALLBACK)).otherwise(
        F.greatest(F.lit(HDR_MIN), F.least(F.lit(HDR_MAX), F.col("p")))).alias("white"), "n_values")


def auto_stretch(df: DataFrame, keys: list[str], white: float = WHITE, knee: float = KNEE, onset: float = DESAT_ONSET,
                 min_n: int = AUTO_MIN_N) -> DataFrame:
    """Black, white and fade onset per scene pair; defaults unless nothing dark is in frame."""
    m = channel_max(*[F.col(c) for c in RGB])
    q = quantiles(df, keys, m, {"p_lo": AUTO_BLACK, "p_hi": AUTO_WHITE})
    dark = df.withColumn("_m", m).groupBy(*keys).agg(
        (F.count_if(F.col("_m") < knee * white) / F.nullif(F.count("_m"), F.lit(0))).alias("dark"))
    j = q.join(dark, keys)
    u = _unit((F.col("dark") - AUTO_DARK_MIN) / (AUTO_DARK_FULL - AUTO_DARK_MIN))
    j = j.withColumn("_w", 1.0 - _ease(u)).withColumn("_lo", F.greatest(F.lit(0.0), F.col("p_lo") * (1.0 - AUTO_MARGIN)))
    j = j.withColumn("_hi", F.least("p_hi", F.lit(AUTO_WHITE_MAX)))
    on = (F.col("n_values") >= min_n) & (F.col("_w") > 0) & (F.col("_hi") - F.col("_lo") >= AUTO_MIN_SPAN)
    w_out = (1.0 - F.col("_w")) * white + F.col("_w") * F.col("_hi")
    return j.select(*keys, F.when(on, F.col("_w") * F.col("_lo")).otherwise(0.0).alias("black"),
                    F.when(on, w_out).otherwise(F.lit(white)).alias("white"),
                    F.when(on, F.least(F.greatest(F.lit(onset), w_out), F.lit(AUTO_ONSET_MAX))).otherwise(F.lit(onset)).alias("onset"),
                    on.alias("fitted"))


def haze_floor(long: DataFrame, keys: list[str]) -> DataFrame:
    """Path-radiance floor per scene and band (keys, band, v > 0); no rows where no dark object is in frame."""
    q = written(quantiles(long.filter(F.col("v") > 0), [*keys, "band"], F.col("v"), {"p": HAZE_PCT}), "haze")
    f = q.select(*keys, "band", (F.col("p") * (1.0 - HAZE_MARGIN)).alias("floor"))
    dark = f.filter(F.col("band").isin(*RGB)).groupBy(*keys).agg(F.min("floor").alias("_d")).filter(F.col("_d") <= HAZE_MAX)
    return f.join(dark.select(*keys), keys, "left_semi")


def _above(v: Column, floor: Column) -> Column:
    return F.when(floor.isNotNull(), F.greatest(v - floor, F.lit(0.0))).otherwise(v)


def dehaze(long: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract the floor, clipped at 0; scenes without a floor stay."""
    j = long.join(haze_floor(long, keys), [*keys, "band"], "left")
    return j.withColumn("v", _above(F.col("v"), F.col("floor"))).drop("floor")


def dehaze_bands(df: DataFrame, keys: list[str], bands=RGB) -> DataFrame:
    """``dehaze`` of a table with a column per band: a scene's floors are one row, joined to each cell once."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands])).alias("x")).select(*keys, "x.*")
    floors = haze_floor(long, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("band") == b, F.col("floor"))).alias(f"_floor_{b}") for b in bands])
    return df.join(floors, keys, "left").withColumns({b: _above(F.col(b), F.col(f"_floor_{b}")) for b in bands}).select(df.columns)


def balance_gains(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gain per visible band that makes the brightest cells grey; 1 without a bright anchor.

    ``df``: keys and the visible bands.
    """
    m = F.greatest(*[F.col(c) for c in RGB])
    cut = written(quantiles(df, keys, m, {"thr": BRIGHT_PCT}).select(*keys, "thr"), "bright")
    j = df.withColumn("_m", m).join(cut, keys)
    g = j.groupBy(*keys).agg(F.first("thr").alias("thr"), *[
        F.avg(F.when(F.col("_m") >= F.col("thr"), F.col(c))).alias(f"_{c}") for c in RGB])
    top = F.greatest(*[F.col(f"_{c}") for c in RGB])

    def gain(c: str) -> Column:
        raw = F.when(F.col(f"_{c}") > 1e-6, top / F.col(f"_{c}")).otherwise(1.0)
        return F.when(F.col("thr") < MIN_ANCHOR, 1.0).otherwise(F.least(F.greatest(raw, F.lit(1.0)), F.lit(MAX_GAIN)))
    return g.select(*keys, *[gain(c).alias(f"gain_{c}") for c in RGB])


def radar_bytes(power: Column, lo: float = -25.0, hi: float = 0.0) -> Column:
    """Power in dB onto 1-255, 0 where unmeasured."""
    u = _unit((10.0 * F.log10(power) - lo) / (max(hi, lo + 1.0) - lo))
    return F.when(power > 0, 1 + F.bround(u * 254.0, 0).cast("int")).otherwise(F.lit(0))


def colour_ramp(value: Column, lo: float, hi: float, stops) -> Column:
    """struct<r,g,b,a> by linear interpolation over (value, '#rrggbb', alpha) stops."""
    v = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), value))
    rgba = [(s[0], int(s[1][1:3], 16), int(s[1][3:5], 16), int(s[1][5:7], 16), s[2]) for s in stops]

    def channel(i: int) -> Column:
        out = F.when(v <= rgba[0][0], F.lit(float(rgba[0][i])))
        for a, b in zip(rgba, rgba[1:]):
            out = out.when(v <= b[0], a[i] + (v - a[0]) / (b[0] - a[0]) * float(b[i] - a[i]))
        return F.when(value.isNull(), F.lit(0.0)).otherwise(out.otherwise(float(rgba[-1][i])))
    return F.struct(*[channel(i + 1).alias(n) for i, n in enumerate("rgba")])
