"""Exact ranks and quantiles of groups of any size.

Equal values are counted first, the distinct values are range-partitioned, and a
small table of per-slice totals turns local running sums into global ones.  No task
ever holds a whole group, and a value repeated by a third of all rows is one row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.session import stable

SMALL = 1 << 20   # rows of a group from which its values are ranged over tasks


def small_groups(df: DataFrame, keys: list[str]) -> bool:
    """Whether one task may sort a whole group: none has over ``SMALL`` rows.  Reads the keys of ``df``, which should be a stored table."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= SMALL


def with_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Each row with the median of its group, none where a key is NULL: windows over the layout by keys that ``df`` has.  For groups that ``small_groups`` found small."""
    group = Window.partitionBy(*keys)
    df = df.withColumn("_nth", F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) - 1).withColumn("_n", F.count(value).over(group))
    pos = F.lit(0.5) * (F.col("_n") - 1)
    for out, at in (("_lo", F.floor(pos)), ("_hi", F.ceil(pos))):
        df = df.withColumn(out, F.max(F.when(F.col("_nth") == at, F.col(value))).over(group))
    return df.withColumn(name, F.when(named(keys), F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos)))).drop("_nth", "_n", "_lo", "_hi")


def named(keys: list[str]) -> Column:
    """Rows that a join on their keys can meet."""
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def cumulative_counts(df: DataFrame, keys: list[str], value: Column, times: Column | None = None) -> DataFrame:
    """(keys, v, n, cum, total): running count of values per group, NULLs ignored.  ``times``: how often a row counts."""
    n = F.count(F.lit(1)) if times is None else F.sum("n")
    counts = (df.select(*keys, value.alias("v"), *([] if times is None else [times.alias("n")])).filter(F.col("v").isNotNull())
              .groupBy(*keys, "v").agg(n.alias("n")))
    # the slice number must never change, so the sliced table is cut from its lineage
    sliced = stable(counts.repartitionByRange(*keys, "v").withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(group).alias("total"))
    local = (Window.partitionBy(*keys, "_slice").orderBy("v")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (sliced.withColumn("_run", F.sum("n").over(local)).join(offsets, [*keys, "_slice"])
            .select(*keys, "v", "n", (F.col("_off") + F.col("_run")).alias("cum"), "total"))


def value_at(index: Column) -> Column:
    """Aggregate: the value at a 0-based position of the sorted group."""
    return F.max(F.when((F.col("cum") - F.col("n") <= index) & (index < F.col("cum")), F.col("v")))


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict[str, float], times: Column | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per name in ``probs``.  ``times``: how often a row counts."""
    c = cumulative_counts(df, keys, value, times)
    aggs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("total") - 1)
        aggs += [value_at(F.floor(pos)).alias(f"_lo_{name}"), value_at(F.ceil(pos)).alias(f"_hi_{name}")]
    out = c.groupBy(*keys).agg(F.max("total").alias("n_values"), *aggs)
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("n_values") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (pos - F.floor(pos)))
    return out.select(*keys, "n_values", *probs)


def medians(df: DataFrame, keys: list[str], value: Column, name: str = "med", times: Column | None = None) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5}, times)


def share_at_or_below(df: DataFrame, keys: list[str], value: str, name: str = "share") -> DataFrame:
    """Each row's share of group values <= its own; ties take the highest."""
    c = cumulative_counts(df, keys, F.col(value)).select(
        *keys, F.col("v").alias(value), (F.col("cum") / F.col("total")).alias(name))
    return df.join(c, [*keys, value])


def clipped_offset(df: DataFrame, keys: list[str], value: Column, *, iters: int = 5,
                   nsig: float = 3.0, thin: int = 100) -> DataFrame:
    """Robust offset per group: median and spread after iterative sigma clipping.

    A clip keeps one contiguous range of the sorted values, so every pass works on
    the same running counts; only a one-row-per-group state is cut per pass.  A clip
    that would leave under ``thin`` values is refused.
    Returns keys, offset, stable_n, sigma, n_values.
    """
    c = cumulative_counts(df, keys, value).persist()

    def stats(bounds: DataFrame | None) -> DataFrame:
        x = c if bounds is None else c.join(bounds.select(*keys, "lo", "hi"), keys).filter(
            F.col("v").between(F.col("lo"), F.col("hi")))
        s = x.groupBy(*keys).agg(
            F.min(F.col("cum") - F.col("n")).alias("base"), F.sum("n").alias("m"),
            (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
        y = x.join(s, keys)
        mid = F.col("base") + (F.col("m") - 1) / 2
        return y.groupBy(*keys).agg(
            F.first("m").alias("m"),
            F.sqrt(F.sum(F.col("n") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))) / F.first("m")).alias("sd"),
            ((value_at(F.floor(mid)) + value_at(F.ceil(mid))) / 2).alias("med"))

    s = stats(None)
    state = stable(s.select(*keys, F.col("m").alias("n_values"), "m", "sd", "med",
                            F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"),
                            F.lit(False).alias("done"), F.lit(False).alias("clipped"),
                            F.lit(None).cast("bigint").alias("thin_n")))
    for _ in range(iters):
        if state.filter(~F.col("done")).isEmpty():
            break
        reach = F.lit(nsig) * F.col("sd")
        want = state.select(
            *keys, F.greatest("lo", F.col("med") - reach).alias("lo"),
            F.least("hi", F.col("med") + reach).alias("hi"))
        nxt = stats(want).select(*keys, F.col("m").alias("m2"), F.col("sd").alias("sd2"), F.col("med").alias("med2"))
        j = state.join(want.select(*keys, F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), keys).join(nxt, keys, "left")
        m2 = F.coalesce("m2", F.lit(0).cast("bigint"))
        stop = F.col("done") | (F.col("sd") == 0) | (m2 == F.col("m"))
        refuse = ~stop & (m2 < thin)
        take = ~stop & ~refuse
        state = stable(j.select(
            *keys, "n_values", *[F.when(take, F.col(b)).otherwise(F.col(a)).alias(a)
                                 for a, b in (("m", "m2"), ("sd", "sd2"), ("med", "med2"), ("lo", "lo2"), ("hi", "hi2"))],
            (stop | refuse).alias("done"), (F.col("clipped") | take).alias("clipped"),
            F.when(refuse, m2).otherwise(F.col("thin_n")).alias("thin_n")))
    # the counts say how often each value stands, so the rows are not read again
    kept = c.join(state.select(*keys, "lo", "hi", "med"), keys).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    mad = medians(kept, keys, F.abs(F.col("v") - F.col("med")), "mad", F.col("n")).select(*keys, "mad")
    return state.join(mad, keys).select(
        *keys, F.col("med").alias("offset"),
        F.when(F.col("thin_n").isNotNull() & ~F.col("clipped"), F.col("thin_n")).otherwise(F.col("m")).alias("stable_n"),
        (F.col("mad") * F.lit(1.4826)).alias("sigma"), "n_values")
