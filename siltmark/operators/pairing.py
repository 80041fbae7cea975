"""Pairing radar scenes: same-geometry pairs, change-detection choice and plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.functions import geo, timing
from siltmark.operators.sar import BEFORE_DATES, MAX_PRE


def prefer_covering(df: DataFrame, covers: Column, keys=("event_id", "source", "side")) -> DataFrame:
    """Frames that image the event point, or all of a group's frames when none does."""
    d = df.withColumn("_cov", covers.cast("int"))
    any_cov = d.groupBy(*keys).agg(F.max("_cov").alias("_any"))
    return d.join(any_cov, [*keys]).filter(F.col("_cov") == F.col("_any")).drop("_cov", "_any")


def best_geometry_pair(scenes: DataFrame, mode: str = "track", by_direction: bool = False) -> DataFrame:
    """Nearest after-scene and its best-matching before-scene per event and radar.

    ``mode``: 'track', 'direction' or 'any'.  Track degrades to direction, then (unless
    split by direction) to any orbit, flagged ``cross_orbit``.
    """
    keys = ["event_id", "source"] + (["orbit_state"] if by_direction else [])
    near = F.struct("gap", "scene_id")
    info = F.struct("scene_id", "acq", "gap", "relative_orbit", F.col("orbit_state").alias("orbit"))
    post = scenes.filter(F.col("side") == "post").groupBy(*keys).agg(F.min_by(info, near).alias("post"))
    pre = scenes.filter(F.col("side") == "pre")
    j = pre.join(post, keys, "full_outer")
    track = F.col("relative_orbit") == F.col("post.relative_orbit")
    same_dir = F.col("orbit_state") == F.col("post.orbit")
    if mode == "track":
        prio = F.when(track, 0).when(same_dir, 1)
    elif mode == "direction":
        prio = F.when(same_dir, 1)
    else:
        prio = F.lit(0)
    prio = F.when(F.col("post").isNull(), F.lit(0)).otherwise(prio if by_direction else F.coalesce(prio, F.lit(2)))
    order = F.when(prio.isNotNull() & F.col("scene_id").isNotNull(), F.struct(prio.alias("p"), F.col("gap"), F.col("scene_id")))
    out = j.groupBy(*keys).agg(F.first("post", True).alias("post"), F.min_by(info, order).alias("pre"), F.min(order).alias("o"))
    return out.select(*keys, "pre", "post", F.coalesce((F.col("o.p") == 2) & F.col("post").isNotNull(), F.lit(False)).alias("cross_orbit"))


def same_geometry(a: Column, b: Column) -> Column:
    """Same known track and pass direction (the caller joins within one radar)."""
    return a["relative_orbit"].isNotNull() & (a["relative_orbit"] == b["relative_orbit"]) & (a["orbit"] == b["orbit"])


def pair_bracket(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """How each pair brackets its event, as numbers and as the one-line label."""
    j = pairs.join(events.select("event_id", "origin"), "event_id")
    a, b, o = F.col("pre"), F.col("post"), F.col("origin")
    before = timing.whole_days(-timing.signed_gap_days(a["acq"], o))
    after = timing.whole_days(timing.signed_gap_days(b["acq"], o))
    span = timing.whole_days(timing.signed_gap_days(b["acq"], a["acq"]))
    same = F.coalesce(same_geometry(a, b), F.lit(False))
    c = F.coalesce(b, a)
    orb = F.when(c["orbit"].startswith("asc"), "ASC").when(c["orbit"].startswith("desc"), "DESC").otherwise("?")
    label = F.concat(F.when(F.col("source") == "NISAR", "NISAR ").otherwise(""), orb,
                     F.coalesce(F.concat(F.lit("·T"), c["relative_orbit"].cast("string")), F.lit("")))

    def day(ts: Column) -> Column:
        return F.date_format(ts, "dd MMM")
    both = F.concat(label, F.lit(": pre −"), before.cast("string"), F.lit(" d ("), day(a["acq"]), F.lit(") · post +"),
                    after.cast("string"), F.lit(" d ("), day(b["acq"]), F.lit(") · "), span.cast("string"), F.lit(" d span · "),
                    F.when(same, "same track ✓").otherwise("⚠ cross-orbit — geometry differs"))
    only_post = F.concat(label, F.lit(": post +"), after.cast("string"), F.lit(" d ("), day(b["acq"]), F.lit(") — no pre scene paired"))
    only_pre = F.concat(label, F.lit(": pre −"), before.cast("string"), F.lit(" d ("), day(a["acq"]), F.lit(") — no post scene paired"))
    return j.select("event_id", "source", before.alias("pre_days"), after.alias("post_days"), span.alias("span_days"),
                    same.alias("same_geometry"), F.coalesce(both, only_post, only_pre, F.lit("")).alias("label"))


def before_stack(scenes: DataFrame, covers: Column) -> DataFrame:
    """Covering before-scenes, one per day, numbered nearest first within (event, track)."""
    d = scenes.filter((F.col("side") == "pre") & covers)
    day = d.groupBy("event_id", "relative_orbit", F.col("acq").cast("date").alias("day")).agg(
        F.min_by(F.struct("scene_id", "gap"), F.struct("gap", "scene_id")).alias("s")).select(
        "event_id", "relative_orbit", "day", "s.scene_id", "s.gap")
    w = Window.partitionBy("event_id", "relative_orbit").orderBy("gap", "scene_id")
    return day.withColumn("n", F.row_number().over(w))


def change_post(scenes: DataFrame, covers: Column, need: int) -> DataFrame:
    """After-scene whose track can be differenced and has the freshest before-stack.

    Order: after date, gap of the need-th before-date, gap.  With no usable track the
    nearest after-scene stands and ``usable`` is false.
    """
    st = before_stack(scenes, covers).groupBy("event_id", "relative_orbit").agg(
        F.max(F.when(F.col("n") == need, F.col("gap"))).alias("stale"), F.count(F.lit(1)).alias("n_dates"))
    post = prefer_covering(scenes.filter(F.col("side") == "post"), covers, ("event_id",))
    j = post.join(st, ["event_id", "relative_orbit"], "left").withColumn("usable", F.col("stale").isNotNull())
    order = F.struct((~F.col("usable")).cast("int").alias("u"),
                     F.when(F.col("usable"), F.col("acq").cast("date")).alias("d"), "stale", "gap", "scene_id")
    return j.groupBy("event_id").agg(F.min_by(F.struct(
        "scene_id", "relative_orbit", "usable", "stale", "n_dates"), order).alias("p")).select("event_id", "p.*")


def change_plan(scenes: DataFrame, covers: Column, requested=tuple(BEFORE_DATES)) -> DataFrame:
    """Detectors each event can run and the before-scenes they use, nearest first."""
    need = max(BEFORE_DATES[m] for m in requested)
    post = change_post(scenes, covers, need)
    have = before_stack(scenes, covers)
    j = post.select("event_id", F.col("scene_id").alias("post_id"), "relative_orbit", "usable").join(
        have.filter(F.col("n") <= MAX_PRE).select("event_id", "relative_orbit", "n", F.col("scene_id").alias("pre_id")),
        ["event_id", "relative_orbit"], "left")
    g = j.groupBy("event_id", "post_id", "relative_orbit").agg(
        F.count("n").alias("n_pre"), F.array_sort(F.collect_list(F.struct("n", "pre_id"))).alias("_p"))
    g = g.withColumn("_p", F.filter("_p", lambda x: x["pre_id"].isNotNull()))
    runs = F.array_compact(F.array(*[F.when(F.col("n_pre") >= BEFORE_DATES[m], m) for m in requested]))
    stack = any(m in ("mtcorr", "tsint") for m in requested)
    g = g.withColumn("detectors", runs)
    deep = F.exists("detectors", lambda m: m.isin("mtcorr", "tsint")) if stack else F.lit(False)
    most = F.coalesce(F.array_max(F.transform("detectors", lambda m: F.create_map(
        *[x for k, v in BEFORE_DATES.items() for x in (F.lit(k), F.lit(v))])[m])), F.lit(0))
    take = F.when(deep, F.lit(MAX_PRE)).otherwise(most)
    return g.select("event_id", "post_id", "relative_orbit", "n_pre", "detectors",
                    F.when(take > 0, F.transform(F.slice("_p", F.lit(1), F.greatest(take, F.lit(1))), lambda x: x["pre_id"]))
                    .otherwise(F.array().cast("array<bigint>")).alias("pre_ids"))


def footprint_partner(anchors: DataFrame, partners: DataFrame, gate: float = 0.60) -> DataFrame:
    """Best-agreeing partner raster per anchor among those covering enough of it.

    Gate: share of the anchor the partner covers.  Rank: symmetric agreement, then the smaller id.
    Figures depend on the boxes alone: every box meets others once, for its first partner and all its anchors.
    """
    from siltmark.operators.search import box_join
    boxes = anchors.select("a_box").distinct()
    first = partners.groupBy("p_box").agg(F.min("partner_id").alias("partner_id"))
    j = box_join(boxes, first, "a_box", "p_box")
    a, p = F.col("a_box"), F.col("p_box")
    j = j.withColumn("covered", geo.overlap_fraction(a, p)).withColumn("agree", geo.footprint_agreement(a, p))

    def best(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.max_by(F.struct("partner_id", "agree", "covered"), F.struct("agree", (-F.col("partner_id")).alias("o"))).alias("m")).select(key, "m.*")
    return best(anchors.join(best(j.filter(F.col("covered") >= gate), "a_box"), "a_box"), "anchor_id")


def sibling_layers(layers: DataFrame) -> DataFrame:
    """Layers of the same pair: optical index pair and the radar detector pool."""
    return layers.groupBy("event_id", "pre_date", "post_date", "radar").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("n_layers"))


def mixed_products(scenes: DataFrame, collection: str = "collection") -> DataFrame:
    """Product tag per scene list and a warning flag when an event mixes products."""
    c = F.lower(F.col(collection))
    tag = (F.when(c.contains("beta"), "beta").when(c.contains("provisional"), "provisional")
           .when(c.contains("validated"), "validated").otherwise(F.nullif(c, F.lit(""))))
    return scenes.groupBy("event_id").agg(F.array_sort(F.collect_set(tag)).alias("products")).withColumn(
        "mixed", F.size("products") > 1)
