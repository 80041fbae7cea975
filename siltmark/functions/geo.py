"""Boxes, distances, bearings and polygons as Column expressions.

A box is ``struct<w,s,e,n>`` in degrees; a ring is ``array<struct<lon,lat>>``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KM_PER_DEG = 111.32        # optical, S1 and VHR searches
KM_PER_DEG_ALT = 111.0     # the two granule archives use the rounded figure
EARTH_KM = 6371.0
EARTH_MEAN_KM = 6371.0088   # used where a distance is reported
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _box(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.struct(w.alias("w"), s.alias("s"), e.alias("e"), n.alias("n"))


def aoi_box(lat: Column, lon: Column, radius_km: Column,
            km_per_deg: float = KM_PER_DEG, min_cos: float | None = None) -> Column:
    """Box of half size ``radius_km`` around a point."""
    cos = F.cos(F.radians(lat))
    if min_cos is not None:
        cos = F.greatest(cos, F.lit(min_cos))
    dlat = radius_km / F.lit(km_per_deg)
    dlon = radius_km / (F.lit(km_per_deg) * cos)
    return _box(lon - dlon, lat - dlat, lon + dlon, lat + dlat)


def padded_box(lat: Column, lon: Column, radius_km: Column, pad: float = 0.10) -> Column:
    """``aoi_box`` grown by ``pad`` and clamped to the globe."""
    b = aoi_box(lat, lon, radius_km * F.lit(1.0 + pad), min_cos=0.01)
    return _box(
        F.greatest(F.lit(-180.0), b["w"]), F.greatest(F.lit(-90.0), b["s"]),
        F.least(F.lit(180.0), b["e"]), F.least(F.lit(90.0), b["n"]),
    )


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["w"] <= b["e"]) & (b["w"] <= a["e"]) & (a["s"] <= b["n"]) & (b["s"] <= a["n"])


def boxes_meet_within(a: Column, b: Column, tol_km: float) -> Column:
    """Boxes overlap once each side may slip by ``tol_km``."""
    dlat = F.lit(tol_km / KM_PER_DEG)
    mid = (a["s"] + a["n"] + b["s"] + b["n"]) / 4
    dlon = F.lit(tol_km) / (F.lit(KM_PER_DEG) * F.greatest(F.lit(0.05), F.cos(F.radians(mid))))
    return ((a["w"] - dlon <= b["e"]) & (b["w"] <= a["e"] + dlon)
            & (a["s"] - dlat <= b["n"]) & (b["s"] <= a["n"] + dlat))


def box_has_point(box: Column, lon: Column, lat: Column) -> Column:
    return (box["w"] <= lon) & (lon <= box["e"]) & (box["s"] <= lat) & (lat <= box["n"])


def box_area(b: Column) -> Column:
    return (b["e"] - b["w"]) * (b["n"] - b["s"])


def box_overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["e"], b["e"]) - F.greatest(a["w"], b["w"])
    h = F.least(a["n"], b["n"]) - F.greatest(a["s"], b["s"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_fraction(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` covers; 0 for an empty ``a``."""
    return F.when(box_area(a) > 0, box_overlap_area(a, b) / box_area(a)).otherwise(F.lit(0.0))


def footprint_agreement(a: Column, b: Column) -> Column:
    """Symmetric agreement of two footprints: the smaller of both directed overlaps."""
    return F.least(overlap_fraction(a, b), overlap_fraction(b, a))


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.when(lat < 0, F.lit(32700)).otherwise(F.lit(32600)) + zone


def wrap180(deg: Column) -> Column:
    """Angle folded into [-180, 180)."""
    return F.pmod(deg + 180.0, F.lit(360.0)) - 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius_km: float = EARTH_MEAN_KM) -> Column:
    """Great-circle distance; null without all four coordinates."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    # least() passes over nulls
    return F.when(a.isNotNull(), F.lit(2 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def compass8(bearing: Column) -> Column:
    names = F.array(*[F.lit(c) for c in COMPASS])
    step = F.pmod(F.floor((bearing + 22.5) / 45.0), F.lit(8)).cast("int")
    return F.element_at(names, step + 1)


def offset_text(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """'2.31 km SW of seismic location': how far and which way the slide sits."""
    km = haversine_km(lat1, lon1, lat2, lon2)
    dist = (F.when(km < 1, F.format_string("%.0f m", km * 1000))
            .when(km < 10, F.format_string("%.2f km", km)).otherwise(F.format_string("%.1f km", km)))
    way = F.concat(F.lit(" "), compass8(bearing_deg(lat1, lon1, lat2, lon2)), F.lit(" of seismic location"))
    return F.concat(dist, F.when(km < 0.05, " from seismic location").otherwise(way))


def box_ring(box: Column) -> Column:
    """Closed counter-clockwise ring of a box."""
    def pt(x: str, y: str) -> Column:
        return F.struct(box[x].alias("lon"), box[y].alias("lat"))
    return F.array(pt("w", "s"), pt("e", "s"), pt("e", "n"), pt("w", "n"), pt("w", "s"))


def ring_box(ring: Column) -> Column:
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return _box(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def close_ring(ring: Column) -> Column:
    """Repeat the first point at the end when the ring is open."""
    return let(ring, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r)
               .otherwise(F.concat(r, F.slice(r, 1, 1))))


def open_ring(ring: Column) -> Column:
    return let(ring, lambda r: F.when(
        (F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)),
        F.slice(r, 1, F.size(r) - 1),
    ).otherwise(r))


def _pairs(pts: Column) -> Column:
    nxt = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
    return F.zip_with(pts, nxt, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def edges(ring: Column) -> Column:
    """array<struct<a,b>> of consecutive points, last joined to first."""
    return let(open_ring(ring), _pairs)


def point_in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd crossing test, half open in latitude."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) + a["lon"]
        return spans & (lon < at)
    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, positive counter-clockwise."""
    return F.aggregate(
        edges(ring), F.lit(0.0),
        lambda s, e: s + (e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]) / 2.0,
    )


def ring_centroid(ring: Column) -> Column:
    """struct<lon, lat, area>: centre of mass and unsigned area in squared degrees; null without area.

    Sums are taken from the first vertex, so a small ring far from the origin loses no digits.
    """
    def centre(o: Column) -> Column:
        def part(e: Column) -> Column:
            ax, ay, bx, by = e["a"]["lon"] - o["lon"], e["a"]["lat"] - o["lat"], e["b"]["lon"] - o["lon"], e["b"]["lat"] - o["lat"]
            c = ax * by - bx * ay
            return F.struct(c.alias("c"), ((ax + bx) * c).alias("x"), ((ay + by) * c).alias("y"))

        def add(t: Column, p: Column) -> Column:
            return F.struct(*[(t[k] + p[k]).alias(k) for k in "cxy"])
        zero = F.struct(*[F.lit(0.0).alias(k) for k in "cxy"])
        return let(F.aggregate(F.transform(edges(ring), part), zero, add), lambda t: F.when(t["c"] != 0, F.struct(
            (o["lon"] + t["x"] / (3 * t["c"])).alias("lon"), (o["lat"] + t["y"] / (3 * t["c"])).alias("lat"), (F.abs(t["c"]) / 2).alias("area"))))
    return let(F.get(ring, F.lit(0)), centre)


def _clip_half_plane(ring: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Part of an open ring left of the line a->b: each edge yields its kept points."""
    def side(p: Column) -> Column:
        return (bx - ax) * (p["lat"] - ay) - (by - ay) * (p["lon"] - ax)

    def kept(e: Column) -> Column:
        p, q = e["a"], e["b"]
        none = F.filter(F.array(q), lambda _: F.lit(False))

        def keep(d: Column) -> Column:
            t = d["p"] / F.nullif(d["p"] - d["q"], F.lit(0.0))
            cut = F.struct((p["lon"] + t * (q["lon"] - p["lon"])).alias("lon"),
                           (p["lat"] + t * (q["lat"] - p["lat"])).alias("lat"))
            return (F.when((d["p"] >= 0) & (d["q"] >= 0), F.array(q))
                    .when(d["p"] >= 0, F.array(cut))
                    .when(d["q"] >= 0, F.array(cut, q))
                    .otherwise(none))
        return let(F.struct(side(p).alias("p"), side(q).alias("q")), keep)

    return F.when(F.size(ring) >= 3, F.flatten(F.transform(_pairs(ring), kept))).otherwise(ring)


def clip_to_convex(ring: Column, clip: Column) -> Column:
    """Ring cut by every edge of a counter-clockwise convex ring."""
    return F.aggregate(
        edges(clip), open_ring(ring),
        lambda acc, e: _clip_half_plane(acc, e["a"]["lon"], e["a"]["lat"],
                                        e["b"]["lon"], e["b"]["lat"]),
    )


def clipped_area(ring: Column, clip: Column) -> Column:
    return let(clip_to_convex(ring, clip), lambda cut: F.when(
        F.size(cut) >= 3, F.abs(ring_area(cut))).otherwise(F.lit(0.0)))


def coverage_pct(rings: Column, box: Column) -> Column:
    """Percent of a box covered by a polygon: first ring minus its holes."""
    target = box_ring(box)
    outer = clipped_area(F.element_at(rings, 1), target)
    holes = F.aggregate(F.slice(rings, 2, F.size(rings)), F.lit(0.0),
                        lambda s, r: s + clipped_area(r, target))
    pct = F.lit(100.0) * (outer - holes) / F.nullif(box_area(box), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct))


def to_local_km(ring: Column, lat0: Column, lon0: Column) -> Column:
    """Ring in kilometres around a point; safe across the antimeridian."""
    kx = F.lit(KM_PER_DEG) * F.greatest(F.cos(F.radians(lat0)), F.lit(0.01))
    return F.transform(ring, lambda p: F.struct(
        (wrap180(p["lon"] - lon0) * kx).alias("lon"),
        ((p["lat"] - lat0) * F.lit(KM_PER_DEG)).alias("lat")))


def _clip_batch(xs: np.ndarray, ys: np.ndarray, n: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Areas of many rings cut by one convex ring each, all rows at once.

    ``xs``/``ys`` are (rows, width) with ``n`` valid points per row; ``clip`` is
    (rows, edges + 1, 2).  Every pass keeps the part left of one clip edge.
    """
    rows = np.arange(len(n))[:, None]
    for k in range(clip.shape[1] - 1):
        a, b = clip[:, k, None, :], clip[:, k + 1, None, :]
        used = np.arange(xs.shape[1])[None, :] < n[:, None]
        nxt = (np.arange(xs.shape[1])[None, :] + 1) % np.maximum(n, 1)[:, None]
        d = (b[..., 0] - a[..., 0]) * (ys - a[..., 1]) - (b[..., 1] - a[..., 1]) * (xs - a[..., 0])
        qx, qy, dq = xs[rows, nxt], ys[rows, nxt], d[rows, nxt]
        cross = used & ((d >= 0) != (dq >= 0))
        t = np.where(cross, d / np.where(cross, d - dq, 1.0), 0.0)
        keep = np.stack([cross, used & (dq >= 0)], axis=2).reshape(len(n), -1)
        order = np.argsort(~keep, axis=1, kind="stable")
        n = keep.sum(axis=1)
        width = max(1, int(n.max(initial=0)))
        px = np.stack([xs + t * (qx - xs), qx], axis=2).reshape(len(n), -1)
        py = np.stack([ys + t * (qy - ys), qy], axis=2).reshape(len(n), -1)
        xs, ys = px[rows, order[:, :width]], py[rows, order[:, :width]]
    used = np.arange(xs.shape[1])[None, :] < n[:, None]
    nxt = (np.arange(xs.shape[1])[None, :] + 1) % np.maximum(n, 1)[:, None]
    twice = np.where(used, xs * ys[rows, nxt] - xs[rows, nxt] * ys, 0.0).sum(axis=1)
    return np.where(n >= 3, np.abs(twice) / 2.0, 0.0)


@F.pandas_udf(T.DoubleType())
def _disc_area_shared(xs: pd.Series, ys: pd.Series, sizes: pd.Series, radius: pd.Series) -> pd.Series:
    """Area (km2) that the open rings of each row share with its 64-sided disc."""
    owner = np.repeat(np.arange(len(xs)), [len(s) for s in sizes])
    part_n = np.concatenate([np.asarray(s, dtype=int) for s in sizes]) if len(owner) else np.zeros(0, int)
    out = np.zeros(len(xs))
    if len(owner) == 0:
        return pd.Series(out)
    flat_x = np.concatenate([np.asarray(v, dtype=float) for v in xs])
    flat_y = np.concatenate([np.asarray(v, dtype=float) for v in ys])
    width = int(part_n.max(initial=1)) or 1
    slot = np.arange(width)[None, :] < part_n[:, None]
    px, py = np.zeros(slot.shape), np.zeros(slot.shape)
    px[slot], py[slot] = flat_x, flat_y
    ang = 2.0 * np.pi * np.arange(65) / 64.0
    unit = np.stack([np.cos(ang), np.sin(ang)], axis=1)
    clip = unit[None, :, :] * radius.to_numpy()[owner][:, None, None]
    np.add.at(out, owner, np.where(part_n >= 3, _clip_batch(px, py, part_n, clip), 0.0))
    return pd.Series(out)


# counted as non-deterministic so that the planner never runs it twice per row
_disc_area = _disc_area_shared.asNondeterministic()


def disc_cover(rings: Column, lat: Column, lon: Column, radius_km: Column) -> Column:
    """struct<cover, covers_centre>: share of the 64-sided search circle the rings cover.

    The clipping runs in Arrow batches: sixty-four nested array passes per row are
    about thirty times slower as expressions.  Call it after a box prefilter.
    """
    parts = F.transform(rings, lambda r: open_ring(to_local_km(r, lat, lon)))
    flat = F.flatten(parts)
    area = _disc_area(
        F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"]),
        F.transform(parts, lambda r: F.size(r)), radius_km)
    full = 32.0 * math.sin(2.0 * math.pi / 64.0) * radius_km * radius_km
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), area / full)).alias("cover"),
        F.exists(rings, lambda r: point_in_ring(r, lon, lat)).alias("covers_centre"),
    )
