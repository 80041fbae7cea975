"""Hand-computed values, brute-force twins and invariants."""

import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.functions import geo, radar, text, tone
from siltmark.functions import viewgeom as V
from siltmark.functions import volume as VF
from siltmark.operators import blobs, cells, dem, focal, fusion, gazetteer, manifest, merge, ranking, scoring, terrain, volumes
from siltmark.operators.order_stats import clipped_offset, quantiles, share_at_or_below
from siltmark.sources import deliveries, granules, sinks

ONE = "select 1"


def one(spark, *cols):
    return spark.sql(ONE).select(*cols).first()


def grid(spark, a, key=1):
    """2-D array (NaN = missing) as dense cells of one event."""
    h, w = a.shape
    rows = [(key, r, c, None if np.isnan(a[r, c]) else float(a[r, c])) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "event_id int, row int, col int, v double")
    return df.withColumn("n_rows", F.lit(h)).withColumn("n_cols", F.lit(w))


def back(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", col).collect():
        if r[2] is not None:
            out[r[0], r[1]] = r[2]
    return out


def holes(rng, h, w, frac=0.2):
    a = rng.integers(1, 500, (h, w)).astype(float)
    a[rng.random((h, w)) < frac] = np.nan
    return a


def test_incidence_and_relief_shift(spark):
    r = one(spark, V.relief_shift_m(F.lit(30.0), F.lit("WV02")), V.relief_shift_m(F.lit(20.2), F.lit("WV02")),
            V.incidence_deg(F.lit(80.0), F.lit("WV02")), V.tan_incidence(F.lit(None).cast("double")))
    assert r[0] == pytest.approx(33.8, abs=0.1) and r[1] == pytest.approx(21.0, abs=0.1)
    assert r[2] == 90.0 and r[3] == 1.0


def test_grades(spark):
    def g(level, ona, ctx=False):
        return V.grade(F.lit(ctx), F.lit(level).cast("string"), F.lit(ona).cast("double"))
    r = one(spark, g("LV3D", 10.0), g("LV2A", 10.0), g(None, 31.0), g(None, None), g("LV3D", None), g("LV9", 5.0), g("LV3D", 1.0, True))
    assert list(r) == ["mapping", "visual", "visual", "visual", "mapping", "visual", "context"]


def test_disc_cover_shares(spark):
    def box(w, s, e, n):
        return F.array(geo.box_ring(F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("wsen", (w, s, e, n))])))
    lat, lon, r = F.lit(60.0), F.lit(-150.0), F.lit(5.0)
    got = [one(spark, geo.disc_cover(b, lat, lon, r))[0] for b in (
        box(-151, 59, -149, 61), box(-151, 59, -150, 61), box(-150, 60, -149, 61), box(-140, 59, -139, 61))]
    assert [round(g["cover"], 6) for g in got] == [1.0, 0.5, 0.25, 0.0]
    assert got[0]["covers_centre"] and not got[3]["covers_centre"]


def test_clip_matches_both_ways(spark):
    """The expression clip and the batched clip agree on a concave ring."""
    ring = [(-3, -1), (4, -2), (0.5, 0), (4, 3), (-2, 2)]
    pts = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ring])
    disc = F.array(*[F.struct(F.lit(2.5 * math.cos(2 * math.pi * i / 64)).alias("lon"), F.lit(2.5 * math.sin(2 * math.pi * i / 64)).alias("lat"))
                     for i in range(64)])
    a = one(spark, geo.clipped_area(pts, disc))[0]
    xy = np.array(ring, float)
    ang = 2 * np.pi * np.arange(65) / 64
    clip = 2.5 * np.stack([np.cos(ang), np.sin(ang)], axis=1)[None]
    b = geo._clip_batch(xy[None, :, 0], xy[None, :, 1], np.array([5]), clip)[0]
    assert a == pytest.approx(b, rel=1e-9)


def test_look_geometry(spark):
    a, d, lat = F.lit("ascending"), F.lit("descending"), F.lit(60.0)
    r = one(spark, radar.ground_heading_deg(a, lat), radar.ground_heading_deg(d, lat), radar.look_azimuth_deg(a, lat),
            radar.look_azimuth_deg(d, lat), radar.look_azimuth_deg(a, F.lit(None).cast("double")),
            radar.incidence_at_range(radar.range_at_incidence(F.lit(41.3))))
    assert r[0] == pytest.approx(342, abs=1) and r[1] == pytest.approx(198, abs=1)
    assert r[2] == pytest.approx(79, abs=1) and r[3] == pytest.approx(281, abs=1) and r[4] == 90.0
    assert r[5] == pytest.approx(41.3, abs=1e-9)


def test_swath_incidence_mid_and_edges(spark):
    ring = geo.box_ring(F.struct(F.lit(-152.3).alias("w"), F.lit(59.2).alias("s"), F.lit(-147.7).alias("e"), F.lit(60.8).alias("n")))
    mid, west, east = [one(spark, radar.swath_incidence_deg(ring, F.lit(x), F.lit(60.0), F.lit("ascending")))[0] for x in (-150.0, -152.2, -147.8)]
    assert west < mid < east and 29.0 <= west and east <= 46.1 and mid == pytest.approx(38.5, abs=1.5)
    small = geo.box_ring(F.struct(F.lit(-150.1).alias("w"), F.lit(59.9).alias("s"), F.lit(-149.9).alias("e"), F.lit(60.1).alias("n")))
    assert one(spark, radar.swath_incidence_deg(small, F.lit(-150.0), F.lit(60.0), F.lit("ascending")))[0] is None


@pytest.mark.parametrize("k", [3, 4, 5])
def test_window_sum_against_brute_force(spark, k):
    a = holes(np.random.default_rng(k), 23, 19)
    t = focal.tiled(grid(spark, a), ["event_id"], k, tile=8)
    got = back(focal.core(focal.box_sum(t, ["event_id"], {"s": F.col("v")}, k)), "s", a.shape)
    lo = (k - 1) // 2
    z = np.nan_to_num(a)
    want = np.array([[z[max(0, r - lo):r - lo + k, max(0, c - lo):c - lo + k].sum() for c in range(19)] for r in range(23)])
    assert np.allclose(got, want)


def test_window_count_of_ones(spark):
    t = focal.tiled(grid(spark, np.ones((5, 5))), ["event_id"], 3, tile=4)
    s = back(focal.core(focal.box_sum(t, ["event_id"], {"s": F.col("v")}, 3)), "s", (5, 5))
    assert s[0, 0] == 4 and s[0, 2] == 6 and s[2, 2] == 9


def test_median_filter_and_edge_mean_brute_force(spark):
    a = holes(np.random.default_rng(9), 13, 11)
    pad = np.pad(a, 1, mode="edge")
    want = np.array([[np.nanmedian(pad[r:r + 3, c:c + 3]) for c in range(11)] for r in range(13)])
    t = focal.tiled(grid(spark, a), ["event_id"], 2, tile=5)
    got = back(focal.core(focal.median_filter(t, ["event_id"], "m", F.col("v"), 3)), "m", a.shape)
    assert np.allclose(got, np.where(np.isnan(a), np.nan, want), equal_nan=True)
    b = np.arange(143.0).reshape(13, 11)
    pad = np.pad(b, 2, mode="edge")
    want = np.array([[pad[r:r + 5, c:c + 5].mean() for c in range(11)] for r in range(13)])
    t = focal.tiled(grid(spark, b), ["event_id"], 3, tile=5)
    assert np.allclose(back(focal.core(focal.edge_mean(t, ["event_id"], "m", F.col("v"), 5)), "m", b.shape), want)


def test_focal_chain_costs_one_shuffle(spark):
    t = focal.tiled(grid(spark, np.ones((8, 8))), ["event_id"], 4, tile=4)
    t = focal.lee_filter(t, ["event_id"], "l", F.col("v"), 3)
    t = focal.box_mean(t, ["event_id"], {"m": F.col("l")}, 3)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_dilation_never_wraps(spark):
    m = spark.createDataFrame([(1, 0, 0)], "event_id int, row int, col int").withColumn("n_rows", F.lit(6)).withColumn("n_cols", F.lit(6))
    got = {(r["row"], r["col"]) for r in focal.dilate(m, ["event_id"], 2).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)}


def flood(mask, eight=True):
    lab = np.full(mask.shape, -1)
    step = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for r, c in zip(*np.nonzero(mask)):
        if lab[r, c] >= 0:
            continue
        todo, me = [(r, c)], r * mask.shape[1] + c
        lab[r, c] = me
        while todo:
            y, x = todo.pop()
            for dy, dx in step:
                p, q = y + dy, x + dx
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and lab[p, q] < 0:
                    lab[p, q] = me
                    todo.append((p, q))
    return lab


@pytest.mark.parametrize("eight", [True, False])
def test_blobs_across_tiles_match_flood_fill(spark, eight):
    mask = np.random.default_rng(4).random((30, 28)) < 0.52
    mask[7, :] = True                      # a snake through every tile
    df = grid(spark, np.where(mask, 1.0, np.nan)).filter(F.col("v").isNotNull())
    got = {(r["row"], r["col"]): r["blob"] for r in blobs.label_blobs(df, ["event_id"], eight=eight, tile=7).collect()}
    want = flood(mask, eight)
    assert got == {(r, c): int(want[r, c]) for r, c in zip(*np.nonzero(mask))}


def test_sieve_keeps_large_blobs(spark):
    a = np.zeros((6, 6))
    a[0, 0] = 5.0
    a[2:4, 2:5] = 5.0
    got = back(blobs.sieve(grid(spark, a), ["event_id"], "v", F.col("v") > 1, 3, tile=4), "v", a.shape)
    assert got[0, 0] == 0 and (got[2:4, 2:5] == 5).all()


def test_exact_quantiles_and_shares(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.integers(0, 40, 500), np.full(300, 7)].astype(float)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(v)], "g int, v double")
    for r in quantiles(df, ["g"], F.col("v"), {"a": 0.001, "m": 0.5, "z": 0.995}).collect():
        x = v[np.arange(len(v)) % 2 == r["g"]]
        assert [r["a"], r["m"], r["z"]] == pytest.approx(list(np.quantile(x, [0.001, 0.5, 0.995])))
    for r in share_at_or_below(df, ["g"], "v").collect():
        x = v[np.arange(len(v)) % 2 == r["g"]]
        assert r["share"] == pytest.approx((x <= r["v"]).mean())


def test_rank_rules(spark):
    df = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate([None, 0.01, 0.2, 0.3, 0.3, 0.9])], "event_id int, row int, col int, v double")
    r = {x["col"]: x["rank"] for x in fusion.rank_above_floor(df, ["event_id"], "v", F.lit(0.05)).collect()}
    assert r == {0: None, 1: 0.0, 2: 0.25, 3: 0.75, 4: 0.75, 5: 1.0}
    with pytest.raises(Exception, match="unknown change kind"):
        df.select(fusion.orient(F.col("v"), F.lit("mystery"))).collect()


def test_fuse_rules(spark):
    rows = [(1, 0, 0, 0.8, 0.4), (1, 0, 1, None, 0.6), (1, 0, 2, 0.9, None), (1, 0, 3, None, None)]
    df = spark.createDataFrame(rows, "event_id int, row int, col int, optical_rank double, sar_rank double")
    out = {r["col"]: r for r in fusion.fuse(df, ["event_id"], optical_n=2, smooth_k=1).collect()}
    assert out[0]["score"] == pytest.approx((1.6 + 0.4) / 3) and out[0]["confidence"] == 2
    assert out[1]["score"] == pytest.approx(0.3) and out[1]["confidence"] == 1
    assert out[2]["score"] is None and out[2]["confidence"] == 3 and out[3]["confidence"] is None


def test_merge_truth_table(spark):
    cases = [(5.0, None), (5.0, 1.0), (5.0, 4.0), (5.0, -4.0), (1.0, 1.0), (None, None)]
    rows = [(1, g, 0, c, v, False) for c, p in enumerate(cases) for g, v in enumerate(p)] + [(1, 0, 0, 6, 5.0, False), (1, 1, 0, 6, 1.0, True)]
    df = spark.createDataFrame(rows, "event_id int, geom int, row int, col int, v double, masked boolean")
    out = {r["col"]: (r["merged"], r["confidence"]) for r in merge.strongest(df, "logratio", 3.0).collect()}
    assert out == {0: (5.0, 1), 1: (5.0, 3), 2: (5.0, 2), 3: (5.0, 3), 4: (1.0, 0), 5: (None, None), 6: (5.0, 1)}


def test_single_geometry_merge_is_identity(spark):
    a = holes(np.random.default_rng(1), 6, 6)
    df = grid(spark, a).withColumn("geom", F.lit(0)).withColumn("masked", F.lit(False))
    assert np.allclose(back(merge.strongest(df, "logratio", 3.0), "merged", a.shape), a, equal_nan=True)


def test_shadow_behind_a_wall(spark):
    z = np.zeros((5, 30))
    z[:, 10] = 95.0
    df = grid(spark, z).withColumnRenamed("v", "h")
    df = df.withColumns({"dx_m": F.lit(10.0), "dy_m": F.lit(10.0), "look_az": F.lit(90.0), "incidence": F.lit(45.0)})
    got = back(terrain.shadow(df, ["event_id"], smooth_k=1, tile=6).withColumn("x", F.col("shadow").cast("int")), "x", z.shape)
    assert set(np.nonzero(got[2])[0]) == set(range(11, 20))      # 95 m reaches nine steps of 10 m at 45 degrees
    lay = back(terrain.layover(df, ["event_id"], smooth_k=1, tile=6).withColumn("x", F.col("layover").cast("int")), "x", z.shape)
    assert set(np.nonzero(lay[2])[0]) == set(range(1, 11))


def test_volume_of_a_pit(spark):
    a = np.zeros((200, 200))
    a[80:120, 80:120] = -5.0
    dh = grid(spark, a).withColumnRenamed("v", "dh")
    mask = dh.filter((F.col("row").between(70, 129)) & (F.col("col").between(70, 129))).select("event_id", "row", "col", "n_rows", "n_cols")
    v = dem.zonal_volume(dh.select("event_id", "row", "col", "dh"), mask.select("event_id", "row", "col"), ["event_id"], F.lit(100.0), sigma=F.lit(0.5)).first()
    assert v["v_net"] == -800000.0 and v["v_deposit"] == 0.0 and v["v_sigma_m3"] == 0.5 * 3600 * 100
    assert v["v_sigma_random_m3"] == pytest.approx(0.5 * 100 * 60)


def numpy_clip(x):
    keep = x
    for _ in range(5):
        med, sd = np.median(keep), keep.std()
        nxt = keep[np.abs(keep - med) <= 3 * sd]
        if sd == 0 or len(nxt) == len(keep) or len(nxt) < 100:
            break
        keep = nxt
    m = np.median(keep)
    return m, len(keep), 1.4826 * np.median(np.abs(keep - m))


def test_clipped_offset_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(2, 1, 900), rng.normal(-60, 5, 60), [500.0]]
    df = spark.createDataFrame([(1, float(v)) for v in x], "event_id int, d double")
    r = clipped_offset(df, ["event_id"], F.col("d")).first()
    assert (r["offset"], r["stable_n"], r["sigma"]) == pytest.approx(numpy_clip(x))


def test_change_volume_computes_the_difference_once(spark, tmp_path):
    from siltmark.plans import heights
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    cells = [(1, r, c, 100.0 + (r * 7 + c) % 5 * 0.1, 8 <= r < 12 and 8 <= c < 12) for r in range(24) for c in range(24)]
    df = spark.createDataFrame(cells, "event_id int, row int, col int, h double, scar boolean")
    pre = df.select("event_id", "row", "col", "h").mapInArrow(count, "event_id int, row int, col int, h double")
    post = df.select("event_id", "row", "col", (F.col("h") + 2 - F.when(F.col("scar"), 30.0).otherwise(0.0)).alias("h"))
    mask = df.filter("scar").select("event_id", "row", "col", F.lit(24).alias("n_rows"), F.lit(24).alias("n_cols"))
    r = heights.change_volume(pre, post, mask, ["event_id"], F.lit(1.0)).first()
    assert (r["pixel_count"], r["ok"]) == (16, True) and r["v_net"] == pytest.approx(-480.0)
    assert seen.value == 576


def test_mosaic_computes_the_reflectances_once(spark):
    from siltmark.functions import tone
    from siltmark.plans import optical
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    shape = "event_id int, scene int, row int, col int, red long, green long, blue long"
    rows = [(1, s, r, c, *(None if s == 1 and r == 0 else 900 + 300 * s + 40 * k + r * 16 + c for k in range(3))) for s in (1, 2) for r in range(16) for c in range(16)]
    obs = spark.createDataFrame(rows, shape)
    out = optical.product_mosaic(obs.mapInArrow(count, shape), "scene", F.lit(0.0003))
    assert out.count() == 256 and seen.value == 512
    refl = obs.select("event_id", "scene", "row", "col", *[(F.col(b) * 0.0003).alias(b) for b in tone.RGB])
    long = refl.select("event_id", "scene", "row", "col", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in tone.RGB])).alias("x")).select("event_id", "scene", "row", "col", "x.*")
    want = {(r.scene, r.row, r.col, r.band): r.v for r in tone.dehaze(long, ["event_id", "scene"]).collect()}
    got = {(r.scene, r.row, r.col, b): r[b] for r in tone.dehaze_bands(refl, ["event_id", "scene"]).collect() for b in tone.RGB}
    assert got == want


def test_encoded_uuids_are_looked_for_only_where_one_can_begin(spark):
    import base64
    import time
    import uuid
    rng = np.random.default_rng(5)
    ids = [str(uuid.UUID(bytes=rng.bytes(16))) for _ in range(200)]
    runs = [base64.b64encode(w.encode()).decode() for i in ids for w in (i, i.upper(), i.replace("-", ""), i.replace("-", "").upper())]
    df = spark.createDataFrame([(r, f"a {r} b QUIz {r[1:]} {r[:-9]}") for r in runs], "r string, t string")
    assert df.filter(text.redact(F.col("t")) != F.replace("t", "r", F.lit("<KEY>"))).count() == 0
    prose = spark.range(0, 400, 1, 1).select(F.repeat(F.concat(F.lit("Most words Of any Note are Quite short, Readers Yield Zeal "), F.col("id").cast("string")), F.lit(800)).alias("t")).cache()

    def seconds(pattern):
        begun = time.monotonic()
        prose.agg(F.sum(F.length(F.regexp_replace("t", pattern, "")))).collect()
        return time.monotonic() - begun
    seconds("x")
    plain = text._named_value(text.VENDOR_KEY)[0]
    assert min(seconds(text.encoded_uuid()) for _ in range(3)) < 3 * min(seconds(f"(?i){plain}") for _ in range(3))


def test_thin_clip_is_refused_and_reported(spark):
    x = [0.0] * 60 + [float(i) for i in range(1, 38)] + [1e6] * 4
    df = spark.createDataFrame([(1, v) for v in x], "event_id int, d double")
    r = clipped_offset(df, ["event_id"], F.col("d")).first()
    assert r["stable_n"] == 97 and r["n_values"] == 101 and r["offset"] == np.median(x)


def test_area_to_volume(spark):
    k = VF.coefficients(F.lit("bedrock"))
    none = F.lit(None).cast("double")
    r = one(spark, VF.area_to_volume(F.lit(5e5), none, none, k), VF.area_to_volume(F.lit(5e5), F.lit(4e5), F.lit(6e5), k),
            VF.implied_depth_m(F.lit(1.3e6), F.lit(8e5)))
    assert r[0]["volume"] == pytest.approx(10 ** (-0.63 + 1.41 * math.log10(5e5)))
    assert r[0]["low"] / r[0]["volume"] - 1 == pytest.approx(-0.26, abs=0.02) and r[0]["high"] / r[0]["volume"] - 1 == pytest.approx(0.35, abs=0.02)
    assert r[1]["low"] < r[0]["low"] and r[2] == 1.625
    with pytest.raises(Exception, match="no coefficients"):
        spark.sql(ONE).select(VF.coefficients(F.lit("ice"))).collect()


def test_upsert_keeps_centerline(spark):
    old = spark.createDataFrame([("a", 1.0, 50.0), ("b", 2.0, 60.0)], "slide string, v double, length double")
    new = spark.createDataFrame([("a", 9.0, None), ("c", 3.0, None)], "slide string, v double, length double")
    out = {r["slide"]: (r["v"], r["length"]) for r in volumes.upsert(old, new).collect()}
    assert out == {"a": (9.0, 50.0), "b": (2.0, 60.0), "c": (3.0, None)}


def test_wrapped_scene_rule(spark):
    r = one(spark, cells.wrapped(F.lit(300), F.lit(5000), F.lit(1000.0)), cells.wrapped(F.lit(300), F.lit(50), F.lit(1000.0)),
            cells.wrapped(F.lit(300), F.lit(5000), F.lit(0.0)), cells.wrapped(F.lit(600), F.lit(5000), F.lit(1000.0)))
    assert list(r) == [True, False, False, False]


def test_gazetteer_greedy_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    pts = [(f"Peak {i % 3}", -150 + float(rng.integers(0, 12)) * 0.003, 60 + float(rng.integers(0, 9)) * 0.002, int(i % 2) + 1, i) for i in range(120)]
    df = spark.createDataFrame(pts, "name string, lon double, lat double, priority int, seq int")
    got = {r["seq"] for r in gazetteer.merge_points(df).filter("kept").collect()}
    kept = []
    for p in sorted(pts, key=lambda p: (p[3], p[4])):
        def close(q):
            mid = math.radians((p[2] + q[2]) / 2)
            return math.hypot((q[1] - p[1]) * 111320 * math.cos(mid), (q[2] - p[2]) * 110540) <= 600
        if not any(q[0] == p[0] and close(q) for q in kept):
            kept.append(p)
    assert got == {p[4] for p in kept}


def test_redaction(spark):
    import base64
    import json as js
    import uuid
    from urllib.parse import quote
    key = base64.b64encode(b"01234567-89ab-cdef-0123-456789abcdef").decode()
    bare = base64.b64encode(uuid.UUID(int=77 << 64).hex.encode()).decode()
    hidden = [f"maxar-api-key: {key}", "MAXAR-API-KEY:short-value", "x?maxar_api_key=short-value&count=1", "x?" + quote("maxar_api_key=short-value", safe=""),
              "{b'maxar-api-key': b'short-value'}", js.dumps({"maxar-api-key": "short-value"}), "maxar api key: short-value", "maxarapikey=short-value",
              "Authorization: Bearer short-value", js.dumps({"Authorization": "Bearer short-value"}), "Authorization: token short-value",
              f"the key is {key} ok", f"GET /keys/{key}/usage failed", f"key {key}-expired", f"x_{key}", f"the key {bare} ok", f"/a/{bare.rstrip('=')}/b"]
    same = ["featureId ccaae319-0000-4000-8000-000000000826; layer Maxar:Imagery", "send the header maxar-api-key; sha1 " + "a" * 40 + "; paste the API key", "", None]
    out = one(spark, *[text.redact(F.lit(t)) for t in hidden + same])
    for t, o in zip(hidden, out):
        assert "<KEY>" in o and "short-value" not in o and key not in o and bare.rstrip("=") not in o, (t, o)
    assert list(out[len(hidden):]) == same
    assert one(spark, text.redact(F.lit(out[2])))[0] == out[2]
    urls = one(spark, *[text.strip_url_keys(F.lit(u)) for u in ("a?api_key=ABCDEFGH&amp;zmax=1", "a?api_key=ABCDEFGH&v=2", "a%3Fapi_key%3DABCDEFGH%26v%3D2", "a?v=2&amp;api_key=ABCDEFGH")])
    assert list(urls) == ["a&amp;zmax=1", "a?v=2", "a%3Fv%3D2", "a?v=2"]


def test_known_keys_and_hosts(spark):
    import base64
    from urllib.parse import quote, quote_plus
    uid = "01234567-89ab-cdef-0123-456789abcdef"
    keys = [base64.b64encode(uid.encode()).decode(), base64.urlsafe_b64encode(uid.replace("-", "").encode()).decode().rstrip("="), "plain key+/ä value"]
    spelled = [[keys[0], uid, uid.upper(), uid.replace("-", ""), uid.replace("-", "").upper()], [keys[1], uid.replace("-", "")], [keys[2], quote(keys[2], safe=""), quote_plus(keys[2])]]
    for k, forms in zip(keys, spelled):
        out = one(spark, *[text.redact(F.lit(f"x {f} y"), F.lit(k)) for f in forms])
        assert list(out) == ["x <KEY> y"] * len(forms), (k, out)
    assert list(one(spark, text.redact(F.lit("abc def"), F.lit("abc")), text.redact(F.lit("abc"), F.lit(None).cast("string")), text.redact(F.lit(None).cast("string"), F.lit(keys[0])))) == ["abc def", "abc", None]
    urls = {"https://planet.com/a?api_key=ABCDEFGHI x": "https://planet.com/a x", "https://t.planet.com/a?v=1&api_key=ABCDEFGHI": "https://t.planet.com/a?v=1",
            "https://notplanet.com/a?api_key=ABCDEFGHI": "https://notplanet.com/a?api_key=ABCDEFGHI", "https://other.org/planet.com/?api_key=ABCDEFGHI": "https://other.org/planet.com/?api_key=ABCDEFGHI",
            "https://planet.com/a?api_key=ABCDEFGHI https://planet.com/a?api_key=ABCDEFGHI&v=2": "https://planet.com/a https://planet.com/a?v=2", "no url": "no url", "": ""}
    assert list(one(spark, *[text.strip_url_keys(F.lit(u), "planet.com") for u in urls])) == list(urls.values())


def test_deliveries_are_read_once(spark, tmp_path):
    root, state = str(tmp_path / "d"), str(tmp_path / "s")
    files = lambda ks: spark.createDataFrame([(f"a/planet_cache/ev{k % 2}/pre/ord{k}/2024_{k}_3B_metadata.json", "{}") for k in ks], "path string, body string")
    assert deliveries.write_deliveries(files(range(5)), root) == 5
    first = {r.order_id for r in deliveries.read_new_deliveries(spark, root, state).collect()}
    assert first == {f"ord{k}" for k in range(5)}
    assert deliveries.read_new_deliveries(spark, root, state).count() == 0
    deliveries.write_deliveries(files(range(5, 8)), root)
    assert {r.order_id for r in deliveries.read_new_deliveries(spark, root, state).collect()} == {"ord5", "ord6", "ord7"}
    assert deliveries.read_deliveries(spark, root).count() == 8


def test_deliveries_are_listed_by_tasks(spark, tmp_path):
    """The plan holds no file list of its own, files outside the layout are opened once, and a lost call is taken up."""
    root, state = str(tmp_path / "d"), str(tmp_path / "s")
    paths = [f"p{k % 2}/planet_cache/ev{k % 3}/post/ord {k}/2024_{k}_3B_metadata.json" for k in range(40)] + ["stray_metadata.json", "p0/planet_cache/ev0/post/o/notes.json", "p0/.planet_cache/ev0/pre/o/1_metadata.json"]
    files = spark.createDataFrame([(p, "{}") for p in paths], "path string, body string")
    deliveries.write_deliveries(files, root)
    found = deliveries.listed(spark, root)
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString() and not found.inputFiles()
    assert sorted(r.path[len(root) + 1:] for r in found.collect()) == sorted(paths[:41])
    lost = tmp_path / "s" / "scenes" / "call=0"
    lost.mkdir(parents=True)
    (lost / "part-0.parquet").write_text("half a file")
    got = [r.order_id for r in deliveries.read_new_deliveries(spark, root, state).collect()]
    assert sorted(got) == sorted(f"ord {k}" for k in range(40))
    (tmp_path / "d" / "stray_metadata.json").unlink()
    assert deliveries.read_new_deliveries(spark, root, state).count() == 0
    assert deliveries.read_new_deliveries(spark, str(tmp_path / "none"), state).count() == 0


def test_stereo_mates_of_a_crowded_bucket(spark, monkeypatch):
    from siltmark.operators import vhr
    rng = np.random.default_rng(3)
    rows = [(i, "WV0" + str(1 + i % 2), "Radar" if i % 17 == 0 else None, int(t)) for i, t in enumerate(np.r_[rng.integers(0, 400, 120), rng.integers(0, 5000, 80), [7, 7, 307, 306]])]
    df = spark.createDataFrame(rows, "feature_id int, sensor string, sensor_type string, s int").withColumn("acq", F.timestamp_seconds("s").cast("timestamp_ntz")).withColumn("event_id", F.lit(1))
    want = {(a[0], b[0], float(b[3] - a[3])) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and not a[2] and not b[2] and abs(a[3] - b[3]) < 300}
    for crowd in (10 ** 6, 20, 0):
        monkeypatch.setattr(vhr, "CROWD", crowd)
        got = [(r.feature_id, r.mate_id, r.ahead_s) for r in vhr.stereo_mate_ids(df).collect()]
        assert len(got) == len(want) and set(got) == want, crowd


def test_stereo_mates_are_merged_not_broadcast(spark):
    from siltmark.operators import vhr
    df = spark.range(50).select(F.lit(1).alias("event_id"), F.col("id").alias("feature_id"), F.lit("WV01").alias("sensor"), F.lit(None).cast("string").alias("sensor_type"),
                                F.timestamp_seconds(F.col("id") * 9).cast("timestamp_ntz").alias("acq"))
    out = vhr.stereo_mate_ids(df)
    assert out.count() == 2 * sum(min(33, 49 - i) for i in range(50))
    joins = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x and "at#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins), joins


def test_stereo_mates_are_shuffled_once_and_written_in_runs(spark):
    """Keys, one of them constant, take no second shuffle; the mates of a strip stand together, as disk use asks for."""
    from siltmark.operators import vhr
    df = spark.range(300).select(F.lit(1).alias("event_id"), (F.col("id") * 7919 % 300).alias("feature_id"), F.when(F.col("id") >= 0, "WV01").alias("sensor"), F.lit(None).cast("string").alias("sensor_type"),
                                 F.timestamp_seconds(F.col("id") * 2).cast("timestamp_ntz").alias("acq"))
    out = vhr.stereo_mate_ids(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = [r.feature_id for r in out.collect()]
    assert len(rows) == 2 * sum(min(149, 299 - i) for i in range(300))
    assert sum(a != b for a, b in zip(rows, rows[1:], strict=False)) < 2 * 300


def test_rewriting_an_event_prunes_and_keeps_files(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "row int, col int, score double, event_id int"
    cells = spark.createDataFrame([(e, r, 0, float(e)) for e in range(4) for r in range(3)], "event_id int, row int, col int, score double")
    sinks.write_scores(cells, path)
    before = {r.f for r in spark.read.parquet(path).filter("event_id <> 2").select(F.col("_metadata.file_path").alias("f")).collect()}
    sinks.write_scores(cells.filter("event_id = 2").withColumn("score", F.lit(9.0)), path)
    after = {r.f for r in spark.read.parquet(path).filter("event_id <> 2").select(F.col("_metadata.file_path").alias("f")).collect()}
    assert before == after and spark.read.parquet(path).count() == 12
    one_event = sinks.read_scores(spark, path, [2], shape)
    assert {r.score for r in one_event.collect()} == {9.0}
    plan = one_event._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [event_id" in plan.replace("isnotnull(event_id", "event_id").replace("[(event_id", "[event_id")


def test_score_table_is_listed_by_few_tasks_and_not_opened(spark, tmp_path):
    path, tracker = str(tmp_path / "t"), spark.sparkContext.statusTracker()
    sinks.write_scores(spark.range(70).select(F.col("id").alias("event_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("score")), path)
    spark.sparkContext.setJobGroup("listing", "")
    table = sinks.read_scores(spark, path, columns="row int, col int, score double, event_id long")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("listing") for i in tracker.getJobInfo(j).stageIds]
    assert stages and sum(x.numTasks for x in stages) <= 4
    assert table.count() == 70 and spark.conf.get(sinks.LISTING) == "10000"
    assert {r.event_id: r.file for r in sinks.score_files(spark, path).collect()} == {
        r.event_id: "/" + r.f.removeprefix("file:").lstrip("/") for r in table.select("event_id", F.col("_metadata.file_path").alias("f")).collect()}
    part = next((tmp_path / "t" / "event_id=7").glob("*.parquet"))
    part.write_text("not a table")
    assert sinks.score_files(spark, path).count() == 70


def test_scores_are_written_after_circles_were_clipped(spark, tmp_path):
    """A function of another module that has been used, and now holds the driver's session, is not sent to the tasks."""
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    assert one(spark, geo.disc_cover(F.array(ring), F.lit(0.5), F.lit(0.5), F.lit(3.0)))[0]["covers_centre"]
    sinks.write_scores(spark.createDataFrame([(1, 0, 0, 0.5)], "event_id int, row int, col int, score double"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_scores_are_written_and_moved_by_many_tasks(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "row int, col int, score double, event_id string"
    cells = spark.createDataFrame([(e, r, 0, float(r)) for e in ("a/b c=d%", None, *map(str, range(40))) for r in (0, 300, 600)], "event_id string, row int, col int, score double")
    key = lambda r: (r.event_id or "", r.row, r.score)
    rows = lambda df: sorted(map(tuple, sorted(df.select("event_id", "row", "col", "score").collect(), key=key)), key=str)
    sinks.write_scores(cells, path)
    names = [f.name for f in (tmp_path / "t").rglob("*") if f.is_file()]
    assert names and all(n.startswith("part-") and n.endswith(".parquet") for n in names)
    assert len({n.split("-")[1] for n in names}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(f.name.startswith("event_id=") for f in (tmp_path / "t").iterdir())
    assert rows(sinks.read_scores(spark, path, columns=shape)) == rows(cells)
    # an event in several files is replaced whole, also from rows of the table itself; no rows change nothing
    own = sinks.read_scores(spark, path, columns=shape).filter("event_id = 'a/b c=d%' AND row > 0").withColumn("score", -F.col("score"))
    want = rows(cells.filter("NOT event_id <=> 'a/b c=d%'").unionByName(cells.filter("event_id = 'a/b c=d%' AND row > 0").withColumn("score", -F.col("score"))))
    sinks.write_scores(own, path)
    sinks.write_scores(cells.limit(0), path)
    assert rows(sinks.read_scores(spark, path, columns=shape)) == want
    sinks.write_scores(cells.filter("event_id = '7'"), path, "append")
    assert sinks.read_scores(spark, path, columns=shape).filter("event_id = '7'").count() == 6
    with pytest.raises(ValueError):
        sinks.write_scores(cells, path, "ignore")


def test_marching_ends_at_the_raster(spark):
    """A tall wall in a small raster: steps past the edges are no work and change nothing."""
    from siltmark.operators import terrain
    a = np.zeros((9, 9))
    a[4, 4] = 5000.0
    for az in (0.0, 79.0, 90.0, 200.0):
        df = grid(spark, a).withColumnRenamed("v", "h").select("*", *[F.lit(v).alias(n) for n, v in (("dx_m", 10.0), ("dy_m", 12.0), ("look_az", az), ("incidence", 39.0))])
        look = terrain._look(df.withColumn("relief", F.lit(5000.0)), F.lit(0.8), None).first()
        assert look["_n"] <= 18 and look["_reach"] <= 9
        got = {(r.row, r.col) for r in terrain.shadow(df, ["event_id"], smooth_k=1, tile=4).filter("shadow").collect()}
        want = set()
        for k in range(1, 800):
            d = k * 10.0
            dr, dc = round(-math.cos(math.radians(az)) * d / 12.0), round(math.sin(math.radians(az)) * d / 10.0)
            want |= {(r, c) for r in range(9) for c in range(9) if 0 <= r - dr < 9 and 0 <= c - dc < 9 and a[r - dr, c - dc] > a[r, c] + d / math.tan(math.radians(39.0))}
        assert got == want, az


def test_variants_of_one_pass_events(spark):
    rows = [(1, "none", 0.5), (1, "asc", 0.1), (1, "desc", 0.2), (1, "merged", 0.3), (2, "none", 0.6), (2, "asc", 0.4), (3, "none", None)]
    df = spark.createDataFrame(rows, "event int, variant string, rank double")
    got = {r.event: (r.none, r.asc, r.desc, r.merged) for r in scoring.variant_table(df, ["none", "asc", "desc", "merged"], "rank").collect()}
    assert got == {1: (0.5, 0.1, 0.2, 0.3), 2: (0.6, 0.4, 0.4, 0.4), 3: (999.0, None, None, None)}
    worst = {r.variant: (r.worst, r.n_events) for r in scoring.compare_variants(df, ["none", "asc", "desc", "merged"], "rank").collect()}
    assert worst == {"none": (999.0, 3), "asc": (0.4, 2), "desc": (0.4, 2), "merged": (0.4, 2)}


def test_components_of_a_rising_path_take_few_rounds(spark, monkeypatch):
    from siltmark.operators import graph
    calls = []
    follow = graph.follow
    monkeypatch.setattr(graph, "follow", lambda *a: calls.append(1) or follow(*a))
    n = 1024
    e = spark.createDataFrame([(7, i, i + 1) for i in range(n)] + [(8, 5, 5)], "k int, a long, b long")
    got = graph.components(e, ["k"]).groupBy("k", "root").count().collect()
    assert sorted(map(tuple, got)) == [(7, 0, n + 1), (8, 5, 1)]
    assert len(calls) <= 12  # the depth doubles each time


def test_granule_name_rejects_others(spark):
    r = one(spark, granules.decode_name(F.lit("NISAR_L2_PR_GCOV_027_150_A_032_4005_DHDH_A_20260811T142220_20260811T142259_X")),
            granules.decode_name(F.lit("other.h5")))
    assert r[0]["cycle"] == 27 and r[0]["track"] == 150 and r[0]["polarizations"] == ["HH", "HV"]
    assert str(r[0]["start"]) == "2026-08-11 14:22:20" and r[1]["cycle"] is None


def test_granule_numbers_may_outgrow_their_padding(spark):
    r = one(spark, granules.decode_name(F.lit("NISAR_L2_PR_GCOV_027_1500_A_032_4005_DHDH_A_20260811T142220_20260811T142259_X")),
            granules.decode_name(F.lit("NISAR_L2_PR_GCOV_027_15_A_032_4005_DHDH_A_20260811T142220_20260811T142259_X")))
    assert r[0]["track"] == 1500 and r[0]["frame"] == 32 and r[1]["track"] is None


def test_date_of_a_product_named_with_a_longer_time(spark):
    files = spark.createDataFrame([(f"3_pre_20240105_{t}_10_2527_planet_hdr.tif",) for t in ("123456", "1234567", "12345")], "file string")
    index = spark.createDataFrame([], "event_id string, scene_id string, acq timestamp_ntz, gap_days int, aoi_cloud_pct double, cloud_pct double, source string, coverage double")
    got = {r["Scene ID"]: r["Date (UTC)"] for r in manifest.product_rows(files, index).collect()}
    assert got == {"20240105_123456_10_2527": "2024-01-05 12:34", "20240105_1234567_10_2527": "2024-01-05 12:34", "20240105_12345_10_2527": ""}


def test_deliveries_and_sinks(spark, tmp_path):
    base = tmp_path / "planet_cache" / "ev1" / "pre" / "ord1"
    base.mkdir(parents=True)
    for sid, x in (("20240105_1", -150.0), ("20240106_2", -149.0)):
        geom = {"geometry": {"type": "Polygon", "coordinates": [[[x, 60.0], [x + 0.5, 60.0], [x + 0.5, 60.25], [x, 60.0]]]}}
        (base / f"{sid}_3B_metadata.json").write_text(json.dumps(geom))
    scenes = deliveries.read_deliveries(spark, str(tmp_path))
    schema = "order_id string, event_id string, side string, scene_ids array<string>, bbox struct<w:double,s:double,e:double,n:double>"
    led = spark.createDataFrame([("old", "ev0", "post", ["x"], None)], schema)
    out = {r["order_id"]: r for r in deliveries.adopt(led, scenes).collect()}
    assert out["ord1"]["scene_ids"] == ["20240105_1", "20240106_2"] and out["ord1"]["side"] == "pre"
    assert tuple(out["ord1"]["bbox"]) == (-150.0, 60.0, -148.5, 60.25) and out["old"]["source"] is None
    df = spark.createDataFrame([(1, 0, 0, 0.5)], "event_id int, row int, col int, score double")
    sinks.write_scores(df, str(tmp_path / "s"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_metadata(df, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["score"] == "0.5"
    assert spark.read.json(str(tmp_path / "m")).first()["event_id"] == 1


def test_ledger_stream_batches(spark, tmp_path):
    from siltmark.streaming import ledger_batch
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = ledger_batch(out)
    for rows in ([("a", 1, 1), ("b", 1, 1)], [("b", 2, 9), ("b", 3, 5), ("c", 2, 1)]):
        spark.createDataFrame(rows, "order_id string, v int, created int").coalesce(1).write.mode("append").parquet(src)
        q = (spark.readStream.schema("order_id string, v int, created int").parquet(src).writeStream.foreachBatch(run)
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination(60)
    got = {r["order_id"]: r["v"] for r in spark.read.parquet(f"{out}/version=1").collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_hdr_curve_is_monotone_for_greys(spark):
    df = spark.range(0, 200).select(*[(F.col("id") / 100.0).alias(c) for c in ("red", "green", "blue")], "id")
    v = [r["g"] for r in tone.hdr(df, F.lit(0.9)).orderBy("id").collect()]
    assert v == sorted(v) and v[0] == 1 and v[-1] <= 254


def test_truth_rank_counts_stronger_blobs(spark):
    a = np.zeros((9, 9))
    a[0, 0:2], a[4, 4:6], a[8, 7:9] = 9.0, 7.0, 8.0
    df = grid(spark, a).withColumnRenamed("v", "score").withColumn("is_scar", (F.col("row") == 4) & (F.col("col") == 5))
    r = scoring.truth_rank(df, ["event_id"], 1.0, 2, tile=4).first()
    assert (r["n_blobs"], r["rank"]) == (3, 3)


def test_listing_limits():
    assert [ranking.optical_cap(d) for d in (10, 60, 70, 100, 500)] == [12, 12, 14, 20, 24]
    assert [ranking.radar_cap(d) for d in (10, 60, 200)] == [12, 15, 24]


def test_search_has_no_cartesian_product(spark):
    import registry
    registry.load_all()
    for name in ("search_pairs_day_windows", "ledger_find", "footprint_best_partner", "radar_best_pair"):
        plan = registry.ALL[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_strip_cover_is_the_exact_union(spark):
    from siltmark.sources import dem_catalog
    rng = np.random.default_rng(3)
    lat, km = 0.0, 11.132  # a box of 0.1 degrees to either side
    boxes = []
    for e, n in ((1, 1), (2, 6), (3, 40), (4, 3)):
        for _ in range(n):
            x, y = rng.uniform(-0.15, 0.12, 2)
            boxes.append((e, *map(float, (x, y, x + rng.uniform(0.001, 0.12), y + rng.uniform(0.001, 0.12)))))
    boxes += [boxes[3], (4, -1.0, -1.0, 1.0, 1.0), (5, 0.02, 0.02, 0.02, 0.05), (6, 0.5, 0.5, 0.6, 0.6)]
    strips = spark.createDataFrame([(e, (w, s, x, n)) for e, w, s, x, n in boxes], "event_id long, bbox struct<w:double,s:double,e:double,n:double>")
    events = spark.createDataFrame([(e, lat, 0.0, km) for e in range(1, 8)], "event_id long, lat double, lon double, radius_km double")
    got = {r.event_id: r.cover for r in dem_catalog.strip_cover(events, strips).collect()}
    for e in range(1, 8):
        own = [np.clip(b[1:], -0.1, 0.1) for b in boxes if b[0] == e]
        xs, ys = (sorted({v for b in own for v in (b[k], b[k + 2])}) for k in (0, 1))
        area = sum((x1 - x0) * (y1 - y0) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:])
                   if any(b[0] <= x0 and x1 <= b[2] and b[1] <= y0 and y1 <= b[3] for b in own))
        assert abs(got[e] - area / 0.04) < 1e-9, e
    assert got[4] == 1.0 and got[5] == got[6] == got[7] == 0.0


def test_full_elevation_search(spark):
    import datetime as dt

    from siltmark.sources import dem_catalog
    t0 = dt.datetime(2024, 5, 10, 12)
    events = spark.createDataFrame([(1, t0, 60.0, 10.0, 2.0), (2, t0, -60.0, 10.0, 2.0)], "event_id long, origin timestamp_ntz, lat double, lon double, radius_km double")
    box = (9.0, 59.0, 11.0, 61.0)
    days = [-1, -3, -40, 0, 50]
    strips = spark.createDataFrame([(k, t0 + dt.timedelta(days=n), box, "arcticdem") for k, n in enumerate(days)],
                                   "scene_id long, acq timestamp_ntz, bbox struct<w:double,s:double,e:double,n:double>, dem_source string")
    tiles = spark.createDataFrame([(1, "cop-glo30", "a?x", None, 30.0), (1, "cop-glo30", "b", None, 30.0), (2, "3dep-dsm", "c", None, 1.0)],
                                  "event_id long, dem_source string, href string, acq timestamp_ntz, resolution_m double")
    national = spark.createDataFrame([(1, "m", None)], "event_id long, dtm string, dsm string")
    rows = dem_catalog.full_search(events, strips, tiles, national, pre_days=10, post_days=10, limit=1).collect()
    strip = [r for r in rows if r.kind == "strip"]
    assert [(r.event_id, r.side, r.id) for r in strip] == [(1, "pre", "0")]
    assert {(r.event_id, r.dem_source, r.id, r.gap_days) for r in rows if r.kind == "tier"} == {
        (1, "cop-glo30", "cop-glo30-2tile", None), (2, "3dep-dsm", "3dep-dsm-1tile", None), (1, "mrdem-30", "m", None)}
    assert {(r.event_id, r.code, r.side, r.id, r.widen_to_days) for r in rows if r.kind == "note"} == {
        (1, "widen", "post", "4", 50), (1, "no_lidar", None, None, None), (1, "national", None, None, None), (1, "world", None, None, None),
        (2, "widen", "pre", None, None), (2, "widen", "post", None, None)}


@pytest.mark.parametrize("seed", range(6))
def test_longest_chord_of_the_hull(seed):
    from siltmark.operators import dem
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 20, 300):
        for p in (rng.integers(0, 9, (n, 2)).astype(float), rng.normal(size=(n, 2)), np.c_[np.cos(a := rng.uniform(0, 7, n)), np.sin(a)], np.c_[np.arange(n) * 1.0, np.arange(n) * 2.0]):
            q = np.unique(p, axis=0)
            d = ((q[:, None] - q[None]) ** 2).sum(-1)
            got = dem._far_ends(dem._hull(q))
            assert abs(got[0] - d.max()) < 1e-9 and abs(np.hypot(got[1][0] - got[2][0], got[1][1] - got[2][1]) ** 2 - d.max()) < 1e-9


def test_chords_of_many_small_rings_at_once(monkeypatch):
    from siltmark.operators import dem
    rng = np.random.default_rng(5)
    rings = [rng.integers(0, 4, (n, 2)).astype(float) for n in rng.integers(0, 20, 400)] + [None]
    xs, ys = (np.array([None if r is None else r[:, k] for r in rings], dtype=object) for k in (0, 1))
    many = dem._chords(xs, ys)
    for r, got in zip(rings, many):
        if r is None or not len(r):
            assert np.isnan(got).all()
        else:
            d, a, b = dem._far_ends(dem._hull(np.unique(r, axis=0)))
            assert got.tolist() == [*a, *b, math.sqrt(d)]
    calls = []
    monkeypatch.setattr(dem, "_hull", lambda p: calls.append(len(p)))
    dem._chords(np.array([np.ones(4)] * 50 + [None], dtype=object)[:50], np.array([np.ones(4)] * 50 + [None], dtype=object)[:50])
    assert not calls


def test_roles_are_claimed_in_few_shuffles(spark):
    from siltmark.operators import volumes as VO
    words = ("total", "landslide", "area", "source", "best", "low", "max", "other")
    rng = np.random.default_rng(8)
    layers = [(int(rng.integers(0, 60)), k, " ".join(rng.choice(words, rng.integers(2, 6), replace=False))) for k in rng.permutation(400).tolist()]
    df = VO.match_roles(spark.createDataFrame(layers, "project int, pos int, name string"))
    want = set()
    for p in range(60):
        free, got = sorted(x[1:] for x in layers if x[0] == p), {}

        def claim(role, cond):
            hit = next((x for x in free if cond(set(x[1].split()))), None)
            if hit:
                free.remove(hit)
                got[role] = hit
        claim("total", lambda w: len(w & {"total", "area", "landslide"}) > 1)
        for role, word in (("best", "best"), ("low", "low"), ("high", "max")):
            claim(role, lambda w: {"source", "area", word} <= w)
        claim("plain", lambda w: {"source", "area"} <= w and not w & {"best", "low", "max"})
        got.setdefault("best", got.get("plain"))
        want |= {(p, r, *x) for r, x in got.items() if x and r != "plain"}
    assert {(r.project, r.role, r.pos, r.name) for r in df.collect()} == want and len(want) > 80
    assert df._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_detectors_shuffle_cells_once(spark):
    """Pairs and sums of a cell are made where its tile lies, in as many tasks as asked for."""
    from siltmark.operators import sar
    g = grid(spark, np.arange(400.0).reshape(20, 20)).withColumn("idx", F.explode(F.array(*[F.lit(i) for i in (0, 1, 2, -1)])))
    stack = g.groupBy("event_id", "row", "col", "n_rows", "n_cols").agg(F.collect_list(F.struct("idx", (F.col("v") * (F.col("idx") + 3)).alias("v"))).alias("pows"))
    z, m = sar.intensity_zscore(g, ["event_id"], 5, tile=8), sar.multi_temporal(sar.pair_correlations(stack, ["event_id"], 5, 8, before=3), ["event_id"])
    assert sar.pair_correlations(stack, ["event_id"], 5, 8).count() == 6 * 400
    for df, others in ((z, 0), (m, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 + others and "REPARTITION_BY_NUM" in plan
        assert plan.count("Window ") <= 2
        assert df.count() == 400


def test_change_set_equals_its_detectors_and_keeps_no_copies(spark, monkeypatch):
    """One tiling for all four detectors gives what each gives by itself, for large layers and for layers without some scenes."""
    from siltmark.operators import order_stats, sar
    from siltmark.plans import radar as RP
    rng, keys = np.random.default_rng(8), ["event_id"]
    scene = {(e, i): holes(rng, 20, 20, 0.1) for e in (1, 2) for i in (0, 1, 2, -1) if (e, i) not in ((2, 1), (2, 2))}
    scenes = None
    for (e, i), a in scene.items():
        g = grid(spark, a, e).withColumn("idx", F.lit(i))
        scenes = g if scenes is None else scenes.unionByName(g)
    scenes = scenes.unionByName(grid(spark, np.ones((3, 3)), None).withColumn("idx", F.lit(0))).cache()
    scenes.count()
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = {}
    for small in (order_stats.SMALL, 0):
        monkeypatch.setattr(order_stats, "SMALL", small)
        got[small] = {(r.event_id, r.kind, r.row, r.col): r.v for r in RP.change_set(scenes, keys, min_px=3, tile=8, before=3).collect()}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    named = scenes.filter("event_id IS NOT NULL")
    clean = focal.core(focal.lee_filter(focal.tiled(named, keys, 3, 8), [*keys, "idx"], "v2", F.col("v"), 5)).withColumn("v", F.col("v2")).cache()
    wide = clean.groupBy(*keys, "row", "col", "n_rows", "n_cols").agg(*[F.max(F.when(F.col("idx") == i, F.col("v"))).alias(n) for i, n in ((0, "a"), (-1, "b"))])
    pairs = sar.pair_correlations(clean.groupBy(*keys, "row", "col", "n_rows", "n_cols").agg(F.collect_list(F.struct("idx", "v")).alias("pows")), keys, 5, 8, before=3)
    maps = {"logratio": focal.core(sar.log_ratio(focal.tiled(wide, keys, 3, 8), keys, F.col("a"), F.col("b"), 5)), "intcorr": sar.integral_correlation(pairs, keys),
            "tsint": sar.intensity_zscore(clean, keys, 5, tile=8), "mtcorr": sar.multi_temporal(pairs, keys)}
    want = {}
    for kind, df in maps.items():
        df = sar.normalise(df, keys, kind) if kind in ("logratio", "tsint") else df
        df = blobs.sieve(df.withColumn("n_cols", F.lit(20)), keys, kind, sar.significant(F.col(kind), kind), 3, fill=0.5 if kind == "mtcorr" else 0.0, tile=8)
        want |= {(r.event_id, kind, r.row, r.col): r[kind] for r in df.collect()}
    assert len(want) == 8 * 400 and sum(v in (0, 0.5) for v in want.values()) > 5
    for x in got.values():
        assert x.keys() == want.keys()
        assert all((x[k] is None) == (v is None) and (v is None or x[k] == pytest.approx(v, abs=1e-9)) for k, v in want.items())
    scenes.unpersist()
    clean.unpersist()


def test_evidence_is_shuffled_once_by_key(spark, monkeypatch):
    """Small layers: medians, ranks and the cells' sums on one shuffle, nothing kept in memory; as large ones, which are ranged by value."""
    from siltmark.operators import order_stats
    rng, kinds = np.random.default_rng(6), ("dbright", "logratio", "mtcorr")
    rows = [(e, k, i // 9, i % 9, None if rng.random() < 0.1 else float(rng.integers(-40, 40)) / (8.0 if k == "logratio" else 64.0)) for e in (1, 2, None) for k in kinds for i in range(81)]
    rows += [(3, "dbright", 0, 0, None), (3, "mtcorr", 0, 0, 0.9)]
    layers = spark.createDataFrame(rows, "event_id int, kind string, row int, col int, v double")
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    ranked = fusion.evidence_rank(layers, ["event_id"])
    cell = ranked.groupBy("event_id", "row", "col").agg(F.max("rank"))
    assert cell._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = sorted(map(str, ranked.select("event_id", "kind", "row", "col", "v", "evidence", "rank").collect()))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    monkeypatch.setattr(order_stats, "SMALL", 0)
    assert got == sorted(map(str, fusion.evidence_rank(layers, ["event_id"]).select("event_id", "kind", "row", "col", "v", "evidence", "rank").collect()))
    spark.catalog.clearCache()


def test_event_columns_of_slides(spark):
    import datetime as dt

    from siltmark.operators import volumes as VO

    def square(x, y, d):
        return [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    outlines = spark.createDataFrame([(1, "total", square(20.0, 50.0, 1.0)), (1, "best", square(10.0, 60.0, 0.02)), (1, "best", square(10.1, 60.0, 0.04)),
                                      (2, "total", square(-5.0, -5.0, 0.2)), (2, "low", square(7.0, 7.0, 0.2)), (3, "best", [(1.0, 1.0), (2.0, 2.0)]), (3, "best", [])],
                                     "event_id long, role string, ring array<struct<lon:double,lat:double>>")
    det = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 3, 4, 5), 60.0, 10.0, 0.5), (3, dt.datetime(2024, 1, 2), 1.0, 1.0, None)],
                                "event_id long, origin timestamp_ntz, lat double, lon double, coherency double")
    rows = spark.createDataFrame([(1, "a", None), (1, "b", 2.5), (2, "a", 3.0), (2, "b", None), (3, "a", 1.0), (4, "a", 1.0)], "event_id long, slide string, implied_depth double")
    got = {(r.event_id, r.slide): r for r in VO.with_event(rows, det, outlines, fields=("coherency",)).collect()}
    assert len(got) == 6 and got[1, "a"].implied_depth == 2.5 and got[2, "b"].implied_depth is None
    a = got[1, "a"]
    assert a.scar_role == "best" and a.origin_utc == "2024-01-02T03:04:05Z" and a.det_coherency == 0.5
    assert abs(a.scar_lat - (60.01 + 4 * 60.02) / 5) < 1e-9 and abs(a.scar_lon - (10.01 + 4 * 10.12) / 5) < 1e-9
    assert abs(a.offset_km - math.hypot(2.0015, 5.4469)) < 0.01
    b = got[2, "a"]
    assert b.scar_role == "total" and abs(b.scar_lat + 4.9) < 1e-9 and b.det_lat is None and b.offset_km is None
    assert got[3, "a"].scar_lat is None and got[3, "a"].offset_km is None and got[4, "a"].origin_utc is None


def test_a_dense_frame_is_not_broadcast(spark):
    layers = spark.createDataFrame([(1, 8, 8)], "event_id int, n_rows int, n_cols int")
    cells = spark.createDataFrame([(1, 0, 0, 2.0)], "event_id int, row int, col int, v double")
    seen = focal.densify(cells, layers, ["event_id"]).filter("v IS NOT NULL")
    truth = focal.densify(cells, layers, ["event_id"]).select("event_id", "row", "col", (F.col("row") < 2).alias("is_scar"))
    maps = cells.select("event_id", F.lit("asc").alias("variant"), "row", "col", F.col("v").alias("score"))
    for df in (seen, scoring.score_variants(maps, truth, ["event_id"], 3.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[event_id#\d+L?, row", plan)
        assert df.count() == 1


def test_cells_are_copied_to_tiles_of_the_raster_only(spark):
    a = np.arange(40.0 * 24).reshape(40, 24)
    t = focal.tiled(grid(spark, a), ["event_id"], 57, 16)
    assert sorted(map(tuple, t.select("_tr", "_tc").distinct().collect())) == [(r, c) for r in range(3) for c in range(2)]
    assert t.count() == 6 * a.size and focal.core(t).count() == a.size
    assert focal.tiled(grid(spark, a), ["event_id"], 0, 16).count() == a.size


def test_equal_footprints_meet_once(spark, monkeypatch):
    from siltmark.operators import pairing, search
    rng = np.random.default_rng(3)
    box = "struct<w:double,s:double,e:double,n:double>"

    def some(n, side):
        return [(i, (x, y, x + side, y + side)) for i, (x, y) in enumerate((rng.integers(0, 4, (n, 2)) / 4.0).tolist())]
    a, p = some(300, 1.0), some(300, 1.25)
    seen = []

    def watched(left, right, *names):
        seen.append((left.count(), right.count()))
        return search_join(left, right, *names)
    search_join = search.box_join
    monkeypatch.setattr(search, "box_join", watched)
    got = pairing.footprint_partner(spark.createDataFrame(a, f"anchor_id long, a_box {box}"), spark.createDataFrame(p, f"partner_id long, p_box {box}"))

    def share(x, y):
        both = max(0.0, min(x[2], y[2]) - max(x[0], y[0])) * max(0.0, min(x[3], y[3]) - max(x[1], y[1]))
        return both / ((x[2] - x[0]) * (x[3] - x[1]))
    want = {}
    for i, x in a:
        good = [(-min(share(x, y), share(y, x)), k) for k, y in p if share(x, y) >= 0.6]
        if good:
            want[i] = min(good)[1]
    assert {r.anchor_id: r.partner_id for r in got.collect()} == want and len(want) > 200
    assert seen == [(16, 16)]
