"""MinHash near-dedup with odd sketches (operator 1).

Each document's set of five-word shingles (64-bit hashes) gives 120 MinHash values in 30 bands of 4; equal sets are one
class, and classes that share a band are candidates.  A candidate class folds 1,024 more MinHash samples into an odd
sketch of 2,048 bits: every sample flips one bit, so the population count of the XOR of two sketches counts the samples
that differ, precisely at high similarity.

Candidates are verified in two passes over the bands.  The first compares the sketches of a band's rows, block by block
of bounded size, and sends on a forest only: trees of sure pairs, joined by the nearest of the other pairs that may be
links.  The forests' edges are confirmed on the full sets and form components.  The second pass looks at bands that
still hold several components: rows that have a row of another component within the sketches' reach get their full sets
brought along, and every such pair is confirmed or refuted on the spot, in the first band it shares.  So every link
between components is decided on full sets, and what is sent on grows with the rows, not with the pairs, of a group.  A pair at similarity 0.75 shares no band with probability
(1 - 0.75^4)^30 = 1e-5, and its sketch is rejected about as rarely, four and a half standard deviations below.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import ROW, numbered, only_rows, read, stable, stored
from siltmark.llm.textarrays import LOWER, WHITE, flat, hash_words, mix, slices, words

SHINGLE = 5
BANDS, ROWS = 30, 4
SAMPLES = 1024
SKETCH_BITS = 2048
LANES = SKETCH_BITS // 64
NUMERATOR, DENOMINATOR = 75, 100
DEVIATIONS = 4.5
SURE = 0.8  # estimated similarity from which a pair is taken for a likely link
BLOCK = 2048
BLOCK_SHINGLES = 1 << 23
SETS = 1024  # sets whose sketches are folded together

_FACTORS = np.random.default_rng(750).integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLERS = np.random.default_rng(752).integers(0, 2 ** 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(751).integers(0, 2 ** 64, SHINGLE, dtype=np.uint64) | np.uint64(1)


def expected_bits(similarity: float) -> float:
    """Mean XOR population count of two sketches: every sample that differs flips two bits, at random."""
    return SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS))


def sketch_limit() -> int:
    """Largest XOR population count that a pair at the threshold reaches but for a few deviations."""
    t = NUMERATOR / DENOMINATOR
    bits = expected_bits(t)
    # deviations of the number of samples that differ, as bits, and of the bits they flip
    sampling = (expected_bits(t - 1e-4) - bits) / 1e-4 * math.sqrt(t * (1 - t) / SAMPLES)
    flips = 2 * SAMPLES * (1 - t)
    folding = math.sqrt(max(SKETCH_BITS / 4 * (1 - math.exp(-4 * flips / SKETCH_BITS)) - flips * math.exp(-4 * flips / SKETCH_BITS), 0))
    return math.ceil(bits + DEVIATIONS * math.hypot(sampling, folding))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another; and how many each has."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets, WHITE)
    n_docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=n_docs)
    h = hash_words(data, starts, ends)
    m = len(h)
    span = np.minimum(counts, SHINGLE)[doc] if m else doc
    last = np.cumsum(counts)
    head = np.arange(m) + span <= last[doc] if m else np.empty(0, bool)
    total = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        part = np.zeros(m, np.uint64)
        part[:m - j] = h[j:] * _PLACES[j]
        total += np.where(j < span, part, np.uint64(0))
    total = mix(total + span.astype(np.uint64))[head]
    owner = doc[head]
    sizes = np.bincount(owner, minlength=n_docs)
    out, ends_ = [], np.cumsum(sizes)
    for d in np.flatnonzero(sizes):
        u = np.unique(total[ends_[d] - sizes[d]:ends_[d]])
        sizes[d] = len(u)
        out.append(u)
    return np.concatenate(out) if out else np.empty(0, np.uint64), sizes


def signatures(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set key (two words) and band keys of each non-empty set."""
    some = sizes[sizes > 0]
    if not len(some):
        return np.empty((0, 2), np.uint64), np.empty((0, BANDS), np.uint64)
    at = np.cumsum(some) - some
    low = np.stack([np.minimum.reduceat(values * f, at) for f in _FACTORS], axis=1)
    rows = mix(low + np.arange(BANDS * ROWS, dtype=np.uint64))
    bands = np.zeros((len(some), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands + rows[:, r::ROWS])
    return set_keys(values, at), bands + mix(np.arange(BANDS, dtype=np.uint64))


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([np.add.reduceat(mix(values), at), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), at)], axis=1)


def sketches(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Odd sketch (64-bit lanes) of each set that starts at one of ``at``."""
    odd = np.zeros((len(at), SKETCH_BITS), np.uint8)
    each = np.arange(len(at))
    for j, f in enumerate(_SAMPLERS):
        bit = mix(np.minimum.reduceat(values * f, at) + np.uint64(j)) >> np.uint64(20)
        odd[each, (bit % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
    return np.packbits(odd, axis=1).view(np.uint64)


def _fixed(a: np.ndarray, width: int) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(a).view(np.uint8).reshape(len(a), width)] if len(a) else [], pa.binary())


def _lists(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(a).view(np.int64).ravel(), pa.int64()), a.shape[1]).cast(pa.list_(pa.int64()))


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row number, n_shingles, cls, bands`` per document; the last two are null for empty sets."""
    kind = docs.schema[id_col].dataType.simpleString()
    d = numbered(docs).select(F.col(id_col).alias("doc_id"), ROW, F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(2))
            for i, j in slices(offsets):
                values, sizes = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                key, bands = signatures(values, sizes)
                where = np.cumsum(sizes > 0) - 1
                pick = pa.array(np.where(sizes > 0, where, -1), mask=sizes == 0, type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, j - i) for k in range(2)), pa.array(sizes, pa.int64()), _fixed(key, 16).take(pick), _lists(bands).take(pick)],
                    ["doc_id", ROW, "n_shingles", "cls", "bands"])

    return d.mapInArrow(run, f"doc_id {kind}, {ROW} long, n_shingles long, cls binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """``node, bands, sketch, members``: odd sketch and whole sorted shingle set of the rows ``node`` with set key ``cls``."""
    texts = numbered(docs).select(F.col(ROW).alias("node"), F.col(text_col).alias("text")).join(wanted, "node").select("node", "cls", "bands", "text")

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(3))
            for i, j in slices(offsets):
                for i, j in zip(range(i, j, SETS), [*range(i + SETS, j, SETS), j], strict=True):
                    values, sizes = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                    ends = np.cumsum(sizes)
                    if not sizes.all() or _fixed(set_keys(values, ends - sizes), 16).to_pylist() != b.column(1).slice(i, j - i).to_pylist():
                        raise ValueError("a row changed between two readings of the documents")
                    full = [values[e - s:e].tobytes() for e, s in zip(ends, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), _fixed(sketches(values, ends - sizes), SKETCH_BITS // 8),
                                                      pa.array(full, pa.binary())], ["node", "bands", "sketch", "members"])

    return texts.mapInArrow(run, "node long, bands array<long>, sketch binary, members binary")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs of nodes ``a, b`` whose full sets are similar enough."""

    def check(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def forest(sketch: np.ndarray) -> list[tuple[int, int]]:
    """Edges between rows: breadth-first trees over sure pairs, then the nearest pairs that may link two trees."""
    sure, limit = expected_bits(SURE), sketch_limit()
    n = len(sketch)
    tree, out = np.full(n, -1), []
    bits = np.zeros((n, n), np.int16)
    for x in range(n - 1):
        bits[x, x + 1:] = bits[x + 1:, x] = np.bitwise_count(sketch[x + 1:] ^ sketch[x]).sum(axis=1)
    degree = (bits <= sure).sum(axis=1)
    for start in np.argsort(-degree, kind="stable"):
        if tree[start] >= 0:
            continue
        tree[start], front = start, np.array([start])
        while len(front):
            free = np.flatnonzero(tree < 0)
            if not len(free):
                break
            near = bits[np.ix_(front, free)]
            parent = near.argmin(axis=0)
            hit = near[parent, np.arange(len(free))] <= sure
            out += zip(front[parent[hit]].tolist(), free[hit].tolist(), strict=True)
            front = free[hit]
            tree[front] = start
    left, right = np.nonzero(np.triu(bits <= limit, 1) & (tree[:, None] != tree))
    up = {t: t for t in set(tree.tolist())}

    def root(t):
        while up[t] != t:
            up[t] = t = up[up[t]]
        return t

    for k in np.argsort(bits[left, right], kind="stable"):
        a, b = root(int(tree[left[k]])), root(int(tree[right[k]]))
        if a != b:
            up[b] = a
            out.append((int(left[k]), int(right[k])))
    return out


def by_group(batches, n_keys: int):
    """Tables of all rows with equal values in the first ``n_keys`` columns, which come one after another."""
    held, at = [], None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not len(t):
            continue
        keys = np.stack([np.asarray(b.column(c)) for c in range(n_keys)], axis=1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            name = tuple(keys[s].tolist())
            if at is not None and name != at:
                yield pa.concat_tables(held)
                held = []
            at = name
            held.append(t.slice(s, e - s))
    if held:
        yield pa.concat_tables(held)


def _lanes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, LANES)


def _pairs(nodes: np.ndarray, a: list[int], b: list[int]) -> pa.RecordBatch:
    x, y = nodes[a], nodes[b]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def band_forests(members: DataFrame) -> DataFrame:
    """Forest edges ``a, b`` of the rows ``key, n, head, node, sketch`` of each band (n rows have the key).

    A large band's rows are dealt to blocks, and its head is in every block.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))
    m = members.withColumn("block", F.explode(F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(own)))
    m = m.select("key", "block", "node", "sketch").repartition(shuffle_partitions(members), "key", "block").sortWithinPartitions("key", "block")

    def run(batches):
        for g in by_group(batches, 2):
            edges = forest(_lanes(g.column("sketch")))
            if edges:
                yield _pairs(g.column("node").to_numpy(), [a for a, _ in edges], [b for _, b in edges])

    return m.mapInArrow(run, "a long, b long").distinct()


def block_pairs(members: DataFrame, blocks, *columns: str) -> DataFrame:
    """Rows of each ``key`` dealt to ``blocks`` blocks; every two blocks, and each with itself, form a group ``key, i, j``."""
    m = members.withColumn("blocks", blocks)
    m = m.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "bands", "sketch", *columns)
    return m.repartition(shuffle_partitions(members), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def crossing(g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a group, and the bits they differ in, that differ in root, may be a link and share no earlier band.

    Of a group of two blocks only pairs between the blocks count.
    """
    root, mine = (g.column(c).to_numpy() for c in ("root", "mine"))
    key, i, j = (g.column(c)[0].as_py() for c in ("key", "i", "j"))
    bands, sketch, limit = np.asarray(g.column("bands").combine_chunks().flatten()).reshape(-1, BANDS), _lanes(g.column("sketch")), sketch_limit()
    left, right, out = np.flatnonzero(mine == i), np.flatnonzero(mine == j), []
    for x in left:
        r = right[(right > x) | (i != j)]
        r = r[root[r] != root[x]]
        bits = np.bitwise_count(sketch[r] ^ sketch[x]).sum(axis=1)
        r, bits = r[bits <= limit], bits[bits <= limit]
        if len(r):
            first = bands[x][(bands[r] == bands[x]).argmax(axis=1)] == key
            out.append((np.full(first.sum(), x), r[first], bits[first]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int),) * 3


def undecided(members: DataFrame) -> DataFrame:
    """Those ``key, node`` of ``key, n, node, root, bands, sketch`` (n rows have the key) that may be linked with another root in that band."""

    def run(batches):
        for g in by_group(batches, 3):
            a, b, _ = crossing(g)
            rows = np.union1d(a, b)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g.column("key")[0].as_py())), pa.array(g.column("node").to_numpy()[rows])], ["key", "node"])

    return block_pairs(members, F.ceil(F.col("n") / BLOCK).cast("int")).mapInArrow(run, "key long, node long").distinct()


def cross_links(members: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the roots of the rows ``key, node, root, bands, sketch, members`` of each key, decided on the full sets.

    Blocks are bounded in rows and in shingles; two of them meet in one task.
    """
    sizes = members.groupBy("key").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum(F.length("members")) / 8 / BLOCK_SHINGLES).alias("parts"))
    m = block_pairs(members.join(sizes, "key"), F.ceil("parts").cast("int"), "members")

    def run(batches):
        for g in by_group(batches, 3):
            a, b, bits = crossing(g)
            if not len(a):
                continue
            root, full = g.column("root").to_numpy(), g.column("members")
            up = {r: r for r in set(root[np.union1d(a, b)].tolist())}

            def top(t, up=up):
                while up[t] != t:
                    up[t] = t = up[up[t]]
                return t

            found = ([], [])
            for k in np.argsort(bits, kind="stable"):
                x, y = int(a[k]), int(b[k])
                r, s = top(int(root[x])), top(int(root[y]))
                if r != s and similar(*(np.frombuffer(full[z].as_buffer(), np.uint64) for z in (x, y))):
                    up[s] = r
                    found[0].append(x)
                    found[1].append(y)
            if found[0]:
                yield _pairs(g.column("node").to_numpy(), *found)

    return m.mapInArrow(run, "a long, b long").distinct()


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the stored links ``a, b``; the root is the smallest node it is linked with.

    Every round a node and its parent take the smallest grandparent among its neighbours, and every node its own
    grandparent; without a change each node and all its neighbours have one parent.  A round is one job of joins and
    partial aggregations; the number of rounds is logarithmic in the longest shortest path.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    up = stored(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("p"), F.lit(True).alias("moved")), "parents")
    while not up.filter("moved").isEmpty():
        grand = up.join(up.select(F.col("node").alias("p"), F.col("p").alias("g")), "p").select("node", "p", "g")
        least = both.join(grand.select(F.col("node").alias("v"), F.col("g").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        known = grand.join(least, grand.node == least.u).select("node", "p", "g", "m")
        to = known.select(F.inline(F.array(F.struct(F.col("node").alias("node"), F.least("g", "m").alias("to"), F.col("p").alias("was")),
                                           F.struct(F.col("p").alias("node"), F.col("m").alias("to"), F.lit(None).cast("long").alias("was")))))
        up = stored(to.groupBy("node").agg(F.min("to").alias("p"), F.max("was").alias("was")).select("node", "p", (F.col("p") != F.col("was")).alias("moved")), "parents")
    return up.select("node", F.col("p").alias("root"))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of each ``node``, itself if it has no link."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def open_bands(cand: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows ``key, n, node, root`` of bands that hold more than one component; n rows have the key."""
    c = with_roots(cand.select("key", "n", "node"), roots)
    mixed = c.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return c.join(mixed, "key")


def linked(docs: DataFrame, reps: DataFrame, text_col: str) -> DataFrame:
    """``node, root`` of every class ``node, cls, bands`` that has a link; the root is the smallest node of its component."""
    member = reps.select("node", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).filter("n > 1")
    cand = stored(member.join(shared, "key").select("key", "n", "head", "node"), "candidates")
    chosen = reps.join(cand.select("node").distinct(), "node")
    # stored by node, so that joins with pairs of nodes move the pairs only
    sets = stable(full_sets(docs, chosen, text_col).repartition(shuffle_partitions(docs), "node"))
    forests = stored(band_forests(cand.join(sets.select("node", "sketch"), "node")), "forests")
    roots = connected(stored(confirmed(forests, sets), "links"))
    rest = stored(undecided(open_bands(cand, roots).join(sets.select("node", "bands", "sketch"), "node")), "undecided")
    more = stored(cross_links(with_roots(rest, roots).join(sets, "node")), "links")
    if more.isEmpty():
        return roots
    ends = with_roots(with_roots(more.withColumnRenamed("a", "node"), roots).select(F.col("root").alias("a"), F.col("b").alias("node")), roots)
    later = connected(stored(ends.select("a", F.col("root").alias("b")), "links")).select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(roots, "node", "left_anti").withColumn("root", F.col("node"))
    return roots.union(alone).join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept, stays`` and its row number.

    Words are runs of anything but ASCII white space, A-Z lowered.  Fewer than five words make one shingle of
    the whole sequence; a text without words (or null) is linked with nothing, not even its copies.  The
    component is named by the smallest id in it; null ids name one only if there is no other.  ``kept`` marks
    all rows of that id, ``stays`` exactly one row of the component.  Other columns are ignored; no rows in, no rows
    out.  ``docs`` is read twice and must give the same rows in the same order, as a table scan does; a row that changed
    fails the job.
    """
    rows = stored(describe(docs, id_col, text_col), "sets")
    some = rows.filter("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))
    reps = stored(some.groupBy("cls").agg(F.min(ROW).alias("node"), F.first("bands").alias("bands"), F.min(order).alias("first")), "classes")
    roots = linked(docs, reps.select("node", "cls", "bands"), text_col)

    named = with_roots(reps.select("node", "cls", "first"), roots)
    named = stored(named.select("cls", "root", "first"), "named")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    classes = named.select("cls", "root").join(heads, "root").select("cls", "head")
    named = some.select("doc_id", "n_shingles", ROW, "cls").join(classes, "cls").select(
        "doc_id", "n_shingles", F.col("head.id").alias("component_id"), ROW, (F.col(ROW) == F.col("head.row")).alias("stays"))
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), ROW, F.lit(True).alias("stays"))
    return named.union(empty).select("doc_id", "n_shingles", "component_id",
                                     F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "stays", ROW)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns as they came; texts without words all stay."""
    return only_rows(docs, near_duplicates(docs, id_col, text_col).filter("stays"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates over all documents."""
    return near_duplicates(read(spark, sf_dir, "documents")).drop("stays", ROW)
