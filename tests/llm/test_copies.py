"""Exact and near dedup, sharding."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from siltmark.llm import exact_dedup, near_dedup, sharding
from siltmark.llm.sharing import ROW
from siltmark.operators import graph


def big(i):
    return (i is None, i)


def test_exact_groups(docs, rows):
    got = exact_dedup.mark_copies(docs).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), big(i), i))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v) for k, v in groups.items()}
    assert len(got) == len(rows)
    for r in got:
        g = by_hash[r.text_sha256]
        assert (r.keep_id, r.group_size) == (g[0][2], len(g))
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_drop_keeps_columns(docs, none):
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in docs.collect()})
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_plan_is_native(docs):
    plan = exact_dedup.content_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1  # the window adds none


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * i >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    members = collections.defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(rows[k][0])
    return [(i, len(s), min(members[find(k)], key=big)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_components(docs, rows):
    got = near_dedup.near_duplicates(docs).collect()
    key = lambda r: (big(r[0]), r[1], big(r[2]))
    want = sorted(((i, n, c if n else i) for i, n, c in near_brute(rows)), key=key)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    # one row of every component stays, and every text without words
    stay = [r for r in got if r.stays]
    assert len(stay) == sum(1 for _, n, _ in want if not n) + len({c for _, n, c in want if n})
    assert all(r.kept for r in stay)


def test_near_group_without_common_head(spark, tmp_path_factory):
    """A chain in which only neighbours are near, and a large group of variants of one text."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 10 ** 6)}"
    chain = [[word() for _ in range(100)]]
    for _ in range(12):
        nxt = chain[-1][8:] + [word() for _ in range(8)]
        chain.append(nxt)
    base = [word() for _ in range(120)]
    group = []
    for _ in range(60):
        v = list(base)
        v[rng.randrange(120)] = word()
        group.append(v)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain + group)]
    path = str(tmp_path_factory.mktemp("llm") / "chain")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.read.parquet(path)).collect()}
    assert got == {i: c for i, _, c in near_brute(rows)}


def test_blocks_of_large_bands(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    blank, bands = bytes(near_dedup.SKETCH_BITS // 8), [1] + list(range(-29, 0))
    base = np.arange(100, dtype=np.uint64)
    full = lambda k: (base + np.uint64(1000 * (k % 5))).tobytes()
    rows = [(1, 20, 3, k, k % 3, bands, blank, full(k)) for k in range(20)] + [(2, 1, 50, 50, 51, [2] * 30, blank, full(0))]
    df = spark.createDataFrame(rows, "key long, n long, head long, node long, root long, bands array<long>, sketch binary, members binary")
    assert {(r.key, r.node) for r in near_dedup.undecided(df).collect()} == {(1, k) for k in range(20)}
    # links join equal sets of different roots, and join all roots that have any
    links = [(r.a, r.b) for r in near_dedup.cross_links(df).collect()]
    assert links and all(a % 5 == b % 5 and a % 3 != b % 3 for a, b in links)
    up = {r: r for r in range(3)}
    for a, b in links:
        up = {r: up[a % 3] if t == up[b % 3] else t for r, t in up.items()}
    assert len(set(up.values())) == 1
    # a pair that shares an earlier band is left to that band
    later = df.withColumn("key", near_dedup.F.lit(-29))
    assert near_dedup.undecided(later).count() == 0
    # every block is a tree that holds the head
    trees = [(r.a, r.b) for r in near_dedup.band_forests(df).collect()]
    assert len(trees) == 19 and {r.root for r in near_dedup.connected(spark.createDataFrame(trees, "a long, b long")).collect()} == {0}


def test_forest_is_short_and_spans():
    rng = np.random.default_rng(5)
    path = rng.integers(0, 2 ** 64, (1, near_dedup.LANES), dtype=np.uint64)
    step = np.zeros((40, near_dedup.SKETCH_BITS), np.uint8)
    for k in range(1, 40):  # each row differs from the one before in 60 more bits
        step[k] = step[k - 1]
        step[k, (k - 1) * 50:(k - 1) * 50 + 60] ^= 1
    rows = np.packbits(step, axis=1).view(np.uint64) ^ path
    edges = near_dedup.forest(rows)
    assert len(edges) == 39 and len({b for _, b in edges} | {a for a, _ in edges}) == 40
    far = np.concatenate([rows, rng.integers(0, 2 ** 64, (3, near_dedup.LANES), dtype=np.uint64)])
    assert sorted(near_dedup.forest(far)) == sorted(edges)
    assert near_dedup.forest(rows[:1]) == [] and near_dedup.forest(rows[[0, 0]]) == [(0, 1)]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(200)], [(k, (k * 7 + 3) % 101) for k in range(101)], [(5, 5 + k) for k in range(1, 40)] + [(100, 101)]])
def test_connected(spark, tmp_path, edges):
    path = str(tmp_path / "edges")
    spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long").write.parquet(path)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    assert {r.node: r.root for r in near_dedup.connected(spark.read.parquet(path)).collect()} == {x: top(x) for x in list(up)}


def test_odd_sketches_part_near_from_far():
    rng = np.random.default_rng(1)
    make = lambda n: rng.integers(0, 2 ** 64, n, dtype=np.uint64)
    counts = collections.defaultdict(list)
    for _ in range(12):
        base = make(1000)
        sets = [np.sort(base)] + [np.sort(np.r_[base[:1000 - k], make(k)]) for k in (143, 250, 400)]  # similarity 0.75, 0.6, 0.43
        sk = near_dedup.sketches(np.concatenate(sets), np.arange(4) * 1000)
        for k in range(1, 4):
            counts[k].append(int(np.bitwise_count(sk[0] ^ sk[k]).sum()))
    assert max(counts[1]) <= near_dedup.sketch_limit() < min(counts[2] + counts[3])
    assert abs(np.mean(counts[1]) - near_dedup.expected_bits(0.75)) < 25


def test_near_nothing(none, spark):
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.drop_near_copies(none).columns == none.columns and near_dedup.drop_near_copies(none).count() == 0


def test_components_of_a_long_path(spark):
    n = 400
    order = list(range(n))
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (2000, 2000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(n)}) == 1 and got[1000] == got[1001] != got[0] and got[2000] == 2000


def greedy(sizes, capacity, shards):
    n, at = 1, 0
    for s in sizes:
        if at + s > capacity:
            n, at = n + 1, 0
        at += s
    return n <= shards


def test_shards_are_minimax(docs, rows, none):
    got = sharding.minimax_shards(docs, shards=4).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    groups = collections.Counter()
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
    sizes = [groups[k] for k in sorted(groups)]
    low, high = max(sizes), sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if greedy(sizes, m, 4) else (m + 1, high)
    slots = collections.defaultdict(list)
    for r in got:
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert max(size.values()) == low
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.minimax_shards(none).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_capacity_search_in_passes(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "BUCKETS", 32)
    rng = random.Random(seed)
    sizes = [rng.randint(1, 5000) for _ in range(300)]
    cuts, total = [], 0
    for s in sizes:
        total += s
        cuts.append((total,))
    got, ends = sharding.smallest_capacity(spark.createDataFrame(cuts, "cut long"), total, max(sizes), 8)
    assert greedy(sizes, got, 8) and not greedy(sizes, got - 1, 8) and ends[-1] == total


def test_row_numbers_are_not_in_results(docs):
    assert ROW not in exact_dedup.drop_copies(docs).columns
