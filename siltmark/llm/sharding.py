"""Sharding by minimax contiguous partition (operator 8).

Groups of equal texts are atomic and stand in the order of their digest.  The smallest feasible
shard capacity is found by binary search with a greedy check, and the order is cut there.

The groups are never collected.  The driver sees the possible cut points (the running byte totals)
only as buckets: at most ``BUCKETS`` of them a level, each with its lowest and highest cut point.
On buckets the greedy check gives a lower and an upper bound of every cut, so binary search yields
one capacity known to be too small and one known to suffice.  Buckets a cut may still fall in are
split finer by another aggregation, until the two capacities are neighbours: about
log(total bytes) / log(BUCKETS / shards) passes, each returning a bounded number of rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltmark.llm.sharing import read, stable, text_or_empty

SHARDS = 16
BUCKETS = 4096
SALTS = 256
ORDER_BINS = 4096


class Buckets:
    """Sorted, disjoint buckets of cut points; the greedy walk with bounds."""

    def __init__(self, rows: list[tuple[int, int]], total: int, shards: int):
        self.lo = [a for a, _ in rows]
        self.hi = [b for _, b in rows]
        self.total, self.shards = total, shards

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the largest cut point <= x."""
        i = bisect.bisect_right(self.lo, x) - 1
        if i < 0:
            return 0, 0
        return (self.hi[i], self.hi[i]) if x >= self.hi[i] else (self.lo[i], x)

    def walk(self, capacity: int, upper: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(self.shards):
            at = self.floor(at + capacity)[1 if upper else 0]
            cuts.append(at)
        return cuts

    def search(self, bad: int, good: int) -> tuple[int, int]:
        """Largest capacity surely too small, smallest surely enough, within (bad, good]."""
        out = []
        for upper in (True, False):
            a, b = bad, good
            while b - a > 1:
                m = (a + b) // 2
                if self.walk(m, upper)[-1] >= self.total:
                    b = m
                else:
                    a = m
            out.append((a, b))
        return out[0][0], out[1][1]

    def doubtful(self, bad: int, good: int) -> list[tuple[int, int]]:
        """Buckets with inner cut points that a greedy walk between the capacities may meet."""
        found = set()
        for low, high in zip(self.walk(bad, False), self.walk(good, True), strict=True):
            first = max(bisect.bisect_right(self.lo, low) - 1, 0)
            last = bisect.bisect_right(self.lo, high)
            found.update(i for i in range(first, last) if self.lo[i] < self.hi[i])
        return [(self.lo[i], self.hi[i]) for i in sorted(found)]


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int = SHARDS) -> tuple[int, list[int]]:
    """Minimax capacity and cuts for cut points in column ``cut`` (running totals, ascending from one group on)."""
    if total == 0:
        return 0, [0] * shards
    bad, good = max(largest, -(-total // shards)) - 1, total
    known: list[tuple[int, int]] = []
    open_ranges = [(0, total)]
    while True:
        width = max(1, -(-sum(b - a + 1 for a, b in open_ranges) // BUCKETS))
        part = F
        for i, (a, b) in enumerate(open_ranges):  # one flat CASE; the ranges are disjoint and at most BUCKETS
            part = part.when(F.col("cut") <= b, F.when(F.col("cut") >= a, F.lit(i)))
        rows = (ends.select("cut", part.alias("part")).filter(F.col("part").isNotNull())
                .groupBy("part", F.expr(f"cut div {width}L").alias("k"))
                .agg(F.min("cut").alias("a"), F.max("cut").alias("b")).collect())
        known = [k for k in known if not any(a <= k[0] and k[1] <= b for a, b in open_ranges)]
        known += [(int(r.a), int(r.b)) for r in rows]
        view = Buckets(sorted(known), total, shards)
        bad, good = view.search(bad, good)
        doubt = view.doubtful(bad, good)
        if good - bad <= 1 or not doubt:
            return good, view.walk(good, False)
        open_ranges = merge_ranges(doubt)


def minimax_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents to shards of near equal bytes; equal texts stay together.

    Size is the UTF-8 length plus one; a null text has size one and the checksum of the empty text,
    and belongs to the group of the empty text.  Slots count from 0 in each shard without gaps, in the
    order (digest, salt of the id, id); null ids come last and rows equal in id and text get slots of
    their own.  Shards may stay empty if there are fewer groups.  Extra columns are ignored.
    """
    t = text_or_empty(text_col)
    d = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t).alias("text_crc32"), F.sha2(t, 256).alias("digest"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).alias("salt"))
    d = stable(d)
    pieces = stable(d.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")))
    groups = pieces.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn(
        "bin", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * ORDER_BINS / F.lit(2 ** 32)).cast("int"))
    local = W.partitionBy("bin").orderBy("digest")
    groups = stable(groups.select("bin", "digest", "n", "bytes", F.sum("n").over(local).alias("run_n"),
                                  F.sum("bytes").over(local).alias("run_bytes")))
    # at most ORDER_BINS rows from here on
    bins = groups.groupBy("bin").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"), F.max("bytes").alias("largest"))
    at = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = stable(bins.select("bin", "bn", "bb", "largest", F.coalesce(F.sum("bn").over(at), F.lit(0)).alias("base_n"),
                              F.coalesce(F.sum("bb").over(at), F.lit(0)).alias("base_bytes")))
    placed = groups.join(F.broadcast(bins), "bin").select(
        "digest", (F.col("base_bytes") + F.col("run_bytes")).alias("cut"),
        (F.col("base_n") + F.col("run_n") - F.col("n")).alias("first_row"), (F.col("base_n") + F.col("run_n")).alias("last_row"))
    placed = stable(placed)
    head = bins.agg(F.sum("bb").alias("total"), F.max("largest").alias("largest")).first()
    _, cuts = smallest_capacity(placed, int(head.total or 0), int(head.largest or 0), shards)
    shard = F.lit(0)
    for i, c in enumerate(cuts[:-1]):
        shard = F.when(F.col("cut") > F.lit(c), F.lit(i + 1)).otherwise(shard)
    placed = placed.withColumn("shard", shard.cast("int"))
    starts = stable(placed.groupBy("shard").agg(F.min("first_row").alias("shard_row")))
    placed = placed.join(F.broadcast(starts), "shard").select(
        "digest", "shard", (F.col("first_row") - F.col("shard_row")).alias("group_slot"))
    before = W.partitionBy("digest").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select("digest", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("piece_slot"))
    spots = stable(pieces.join(placed, "digest").select("digest", "salt", "shard", (F.col("group_slot") + F.col("piece_slot")).alias("slot0")))
    seat = F.row_number().over(W.partitionBy("digest", "salt").orderBy(F.col("doc_id").asc_nulls_last())) - 1
    return d.join(spots, ["digest", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot0") + seat).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return minimax_shards(read(spark, sf_dir, "documents"))
