"""Elevation change: co-registration, zonal volumes, fall height, masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions import geo
from siltmark.operators.focal import dilate
from siltmark.operators.order_stats import clipped_offset
from siltmark.session import written


def difference(pre: DataFrame, post: DataFrame, keys: list[str], coregister: bool = True) -> tuple[DataFrame, DataFrame]:
    """(dh cells, per-group stats): post minus pre on common cells, vertical bias removed.

    ``pre``/``post``: keys, row, col, h with NULL for voids.
    """
    a = pre.filter(F.col("h").isNotNull()).select(*keys, "row", "col", F.col("h").alias("_a"))
    b = post.filter(F.col("h").isNotNull()).select(*keys, "row", "col", F.col("h").alias("_b"))
    raw = a.join(b, [*keys, "row", "col"]).select(*keys, "row", "col", (F.col("_b") - F.col("_a")).alias("raw"))
    if not coregister:
        st = raw.groupBy(*keys).agg(F.lit(0.0).alias("offset"), F.lit(0).cast("bigint").alias("stable_n"),
                                    F.lit(0.0).alias("sigma"), F.count(F.lit(1)).alias("n_values"))
    else:
        # read by every later step; the statistics are by far the smaller table and their size is known, so Spark never sends the cells
        raw = written(raw, "differences")
        st = written(clipped_offset(raw, keys, F.col("raw")), "offsets")
    return raw.join(st.select(*keys, "offset"), keys).select(
        *keys, "row", "col", (F.col("raw") - F.col("offset")).alias("dh")), st


def polygon_cells(outlines: DataFrame, grids: DataFrame, keys: list[str], block: int = 256, all_touched: bool = False) -> DataFrame:
    """Cells of each outline by the centre rule, or every cell the outline touches.

    ``outlines``: keys, ring; ``grids``: keys, x0, dx, y0, dy, n_rows, n_cols.  Candidate
    cells come from the ring's box, row by row, so a huge outline spreads over tasks.
    """
    j = outlines.join(grids, keys).withColumn("_b", geo.ring_box(F.col("ring")))
    row_lo = F.greatest(F.floor((F.col("_b.n") - F.col("y0")) / F.col("dy")), F.lit(0))
    row_hi = F.least(F.floor((F.col("_b.s") - F.col("y0")) / F.col("dy")), F.col("n_rows") - 1)
    col_lo = F.greatest(F.floor((F.col("_b.w") - F.col("x0")) / F.col("dx")), F.lit(0))
    col_hi = F.least(F.floor((F.col("_b.e") - F.col("x0")) / F.col("dx")), F.col("n_cols") - 1)
    j = j.filter((row_lo <= row_hi) & (col_lo <= col_hi)).withColumn("_c0", col_lo).withColumn("_c1", col_hi)
    rest = [c for c in outlines.columns if c not in (*keys, "ring")]
    spread = [*keys, *rest]
    r = j.withColumn("row", F.explode(F.sequence(row_lo.cast("int"), row_hi.cast("int")))).repartition(*keys, "row")
    c = r.withColumn("col", F.explode(F.sequence(F.col("_c0").cast("int"), F.col("_c1").cast("int"))))

    def xy(dr: float, dc: float) -> tuple[Column, Column]:
        return F.col("x0") + (F.col("col") + dc) * F.col("dx"), F.col("y0") + (F.col("row") + dr) * F.col("dy")
    x, y = xy(0.5, 0.5)
    hit = geo.point_in_ring(F.col("ring"), x, y)
    if all_touched:
        x0, y0 = xy(0.0, 0.0)
        x1, y1 = xy(1.0, 1.0)
        box = F.struct(x0.alias("w"), F.least(y0, y1).alias("s"), x1.alias("e"), F.greatest(y0, y1).alias("n"))
        # shared area, or an edge of the ring crossing the cell without area
        hit = hit | (geo.clipped_area(F.col("ring"), geo.box_ring(box)) > 0)
    return c.filter(hit).select(*spread, "row", "col")


def zonal_volume(dh: DataFrame, mask: DataFrame, keys: list[str], px_area: Column, *, sigma: Column | None = None,
                 offset: float = 0.0, deposit_positive: bool = True, outline_area: DataFrame | None = None) -> DataFrame:
    """Net, deposit and erosion volume per outline with correlated and random error bounds."""
    sign = 1.0 if deposit_positive else -1.0
    v = (F.col("dh") - F.lit(offset)) * F.lit(sign)
    j = mask.join(dh.filter(F.col("dh").isNotNull()), [*keys, "row", "col"]).withColumn("_v", v)
    zero = F.lit(0.0)
    out = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixel_count"), F.sum("_v").alias("_net"),
        F.sum(F.greatest(F.col("_v"), zero)).alias("_dep"), F.sum(F.least(F.col("_v"), zero)).alias("_ero"),
        F.avg("_v").alias("mean_dh_m"), F.max("_v").alias("max_rise_m"), F.min("_v").alias("max_drop_m"))
    s = F.greatest(F.coalesce(sigma, zero), zero) if sigma is not None else zero
    n = F.col("pixel_count")
    out = out.withColumns({
        "v_net": F.col("_net") * px_area, "v_deposit": F.col("_dep") * px_area, "v_erosion": F.col("_ero") * px_area,
        "covered_area_m2": n * px_area, "v_sigma_m3": s * n * px_area, "v_sigma_random_m3": s * px_area * F.sqrt(n)})
    if outline_area is not None:
        out = out.join(outline_area, keys, "left").withColumn(
            "coverage_frac", F.when(F.col("outline_area_m2") > 0, F.col("covered_area_m2") / F.col("outline_area_m2")))
    return out.drop("_net", "_dep", "_ero")


def stable_ground(dh: DataFrame, mask: DataFrame, keys: list[str], buffer_cells: int = 3, need: int = 100) -> DataFrame:
    """Residual bias and noise from ground outside the dilated outline; not ok under ``need`` cells.

    ``mask``: keys, row, col, n_rows, n_cols.
    """
    out = dh.filter(F.col("dh").isNotNull()).join(dilate(mask, keys, buffer_cells), [*keys, "row", "col"], "left_anti")
    st = clipped_offset(out, keys, F.col("dh"))
    ok = F.col("n_values") >= need
    return st.select(*keys, F.when(ok, F.col("offset")).otherwise(0.0).alias("offset_m"),
                     F.when(ok, F.col("sigma")).otherwise(0.0).alias("sigma_m"),
                     F.when(ok, F.col("stable_n")).otherwise(F.col("n_values")).alias("stable_px"), ok.alias("ok"))


def fall_height(lines: DataFrame, heights: DataFrame, keys: list[str], samples: int = 300) -> DataFrame:
    """Highest and lowest height along a line, densified to at least ``samples`` steps.

    ``lines``: keys, line_id, seg = array<struct<x0,y0,x1,y1>> in cell units, length.
    """
    step = F.greatest(F.col("length") / F.lit(float(samples)), F.lit(1.0))
    seg = lines.withColumn("_s", F.explode("seg"))
    s = F.col("_s")
    n = F.greatest(F.ceil(F.hypot(s["x1"] - s["x0"], s["y1"] - s["y0"]) / step), F.lit(1)).cast("int")
    pts = seg.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), n)))
    f = F.col("_k") / F.col("_n")
    x, y = s["x0"] + f * (s["x1"] - s["x0"]), s["y0"] + f * (s["y1"] - s["y0"])
    at = pts.select(*keys, "line_id", F.floor(y).cast("int").alias("row"), F.floor(x).cast("int").alias("col"))
    return at.join(heights.filter(F.col("h").isNotNull()), [*keys, "row", "col"]).groupBy(*keys, "line_id").agg(
        F.max("h").alias("z_top"), F.min("h").alias("z_bottom"), F.count(F.lit(1)).alias("n"),
        (F.max("h") - F.min("h")).alias("drop"))


def bilinear(points: DataFrame, heights: DataFrame, keys: list[str], value: str = "h") -> DataFrame:
    """Bilinear sample at fractional cell positions over the measured corners only.

    ``points``: keys, point_id, fy, fx.
    """
    r, c = F.floor("fy"), F.floor("fx")
    ty, tx = F.col("fy") - r, F.col("fx") - c
    corners = F.array(*[F.struct((r + a).cast("int").alias("row"), (c + b).cast("int").alias("col"),
                                 ((ty if a else 1 - ty) * (tx if b else 1 - tx)).alias("w")) for a in (0, 1) for b in (0, 1)])
    p = points.select(*keys, "point_id", F.explode(corners).alias("q")).select(*keys, "point_id", "q.*")
    j = p.join(heights.select(*keys, "row", "col", value), [*keys, "row", "col"], "left")
    w = F.when(F.col(value).isNotNull(), F.col("w"))
    return j.groupBy(*keys, "point_id").agg((F.sum(F.col(value) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(value))


def _hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the first; ``p`` is sorted by x, then y, without repeats."""
    # only points extreme in their own column can be corners
    first = np.r_[True, p[1:, 0] != p[:-1, 0]]
    p = p[first | np.r_[first[1:], True]]
    if len(p) < 3:
        return p

    def chain(points) -> list:
        out: list = []
        for x, y in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out
    points = p.tolist()
    return np.array(chain(points)[:-1] + chain(points[::-1])[:-1])


def _far_ends(h: np.ndarray) -> tuple[float, tuple, tuple]:
    """Squared length and ends of a hull's longest chord; of equals the first by x, then y of its ends."""
    n = len(h)
    if n <= 64:
        a, b = np.triu_indices(n)
    else:
        # calipers: the corner farthest from each edge moves on with the edge, so all opposite pairs are a few per edge
        x, y = h[:, 0].tolist(), h[:, 1].tolist()
        a, b, k = [], [], 1
        for i in range(n):
            j = (i + 1) % n
            ex, ey = x[j] - x[i], y[j] - y[i]
            while True:
                m = (k + 1) % n
                if ex * (y[m] - y[k]) <= ey * (x[m] - x[k]):
                    break
                k = m
            a += [i, i, i, j, j, j]
            b += [k, (k + 1) % n, k - 1] * 2
        a, b = np.array(a), np.array(b)
    d = ((h[a] - h[b]) ** 2).sum(axis=1)
    ends = (sorted((tuple(h[i].tolist()), tuple(h[j].tolist()))) for i, j in zip(a[d == d.max()], b[d == d.max()]))
    return float(d.max()), *min(map(tuple, ends))


SMALL_RING = 16     # rings of up to so many vertices are measured pair by pair, many rings at once


def _far_ends_of_many(p: np.ndarray) -> np.ndarray:
    """x0, y0, x1, y1, length of rings of equally many vertices (ring, vertex, axis); of equals the first by x, then y of its ends."""
    a, b = np.triu_indices(p.shape[1])
    q, r = p[:, a], p[:, b]
    swap = (q[..., 0] > r[..., 0]) | ((q[..., 0] == r[..., 0]) & (q[..., 1] > r[..., 1]))
    ends = np.where(swap[..., None], np.concatenate([r, q], axis=2), np.concatenate([q, r], axis=2))
    d = ((q - r) ** 2).sum(axis=2)
    best = d == d.max(axis=1, keepdims=True)
    for k in range(4):
        v = np.where(best, ends[..., k], np.inf)
        best &= v == v.min(axis=1, keepdims=True)
    n = np.arange(len(p))
    at = best.argmax(axis=1)
    return np.column_stack([ends[n, at], np.sqrt(d[n, at])])


def _chords(xs, ys) -> np.ndarray:
    out = np.full((len(xs), 5), np.nan)
    sizes = np.fromiter((0 if x is None else len(x) for x in xs), int, len(xs))
    for n in np.unique(sizes[(sizes > 0) & (sizes <= SMALL_RING)]):
        rows = np.flatnonzero(sizes == n)
        p = np.stack([np.concatenate([v[k] for k in rows]).reshape(-1, n) for v in (xs, ys)], axis=2).astype(float)
        if np.isnan(p).any():
            raise ValueError("a ring has a vertex without coordinates")
        out[rows] = _far_ends_of_many(p)
    for k in np.flatnonzero(sizes > SMALL_RING):
        d, a, b = _far_ends(_hull(np.unique(np.column_stack([xs[k], ys[k]]), axis=0)))
        out[k] = (*a, *b, np.sqrt(d))
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1", "length")]))
def _farthest(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_chords(xs.to_numpy(), ys.to_numpy()), columns=["x0", "y0", "x1", "y1", "length"])


def longest_chord(ring: Column) -> Column:
    """struct<x0, y0, x1, y1, length>: the farthest pair of a ring's vertices.

    A ring is one row's array; rows are handled in Arrow batches.
    """
    return _farthest(F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"]))


def ring_inside(inner: Column, outer: Column) -> Column:
    """Does the outer ring hold every vertex of the inner one with no edges crossing?"""
    def cross(e: Column) -> Column:
        def meets(g: Column) -> Column:
            def side(a: Column, b: Column, p: Column) -> Column:
                return F.signum((b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"]))
            return ((side(e["a"], e["b"], g["a"]) * side(e["a"], e["b"], g["b"]) < 0)
                    & (side(g["a"], g["b"], e["a"]) * side(g["a"], g["b"], e["b"]) < 0))
        return F.exists(geo.edges(outer), meets)
    return F.forall(inner, lambda p: geo.point_in_ring(outer, p["lon"], p["lat"])) & ~F.exists(geo.edges(inner), cross)
