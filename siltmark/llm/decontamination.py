"""Benchmark decontamination with suffix arrays of the training text (operator 3).

Every shard of training text (a slice of an Arrow batch, a few megabytes) gets a suffix array over its words.
Every test suffix that is long enough for a match (a window of 13 words, or a whole shorter item) is
binary-searched in every shard, equal ones once.  The range found gives all locations of the window; where it is
not empty, the suffixes on both sides are ordered to their full depth and each test suffix's longest verbatim match
is that with its neighbours in this order.  Words that no test item has break every match, so suffixes that
meet one before the shortest window ends are left out of the array: no window can occur there.

The test set is taken in blocks of bounded size, one after the other: the driver and every task hold one block, and
from the second block on each pass over the documents is a table in the shared folder.  Equality of words is that of
their 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.llm.sharing import read, stored
from siltmark.llm.textarrays import LOWER, NOT_ALNUM, flat, hash_words, slices, words

WINDOW = 13
BLOCK_BYTES = 16 << 20
DIGIT = 255


class TestBlock:
    """Words of some test items, coded, and the keys of their suffixes and windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids = [i for i, _ in items]
        data, offsets = flat(pa.array([t for _, t in items], pa.large_string()))
        data = LOWER[data]
        starts, ends, owner = words(data, offsets, NOT_ALNUM)
        hashes = hash_words(data, starts, ends)
        self.vocabulary = np.unique(hashes)
        self.codes = np.searchsorted(self.vocabulary, hashes) + 1
        self.owner = owner
        self.left = np.bincount(owner, minlength=len(items)).cumsum()[owner] - np.arange(len(owner)) if len(owner) else owner
        size = np.bincount(owner, minlength=len(items))[owner] if len(owner) else owner
        first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.empty(0, bool)
        self.at = np.flatnonzero((self.left >= window) | (first & (size < window)))
        self.length = np.minimum(self.left[self.at], window)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        # equal windows are searched once; a shorter item's key ends in zeros, so it differs from all others
        keys = suffix_keys(self.codes, self.at, self.left[self.at], window)
        self.keys, where, self.window_of = np.unique(keys, return_index=True, return_inverse=True)
        self.key_length = self.length[where]
        pairs = np.unique(self.window_of * max(len(items), 1) + owner[self.at])
        self.item_of = pairs % max(len(items), 1)
        self.items_from = np.searchsorted(pairs // max(len(items), 1), np.arange(len(self.keys) + 1))

    def search(self, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range in a sorted array of keys where each window stands."""
        low = self.keys
        width = low.dtype.itemsize
        high = low.view(np.uint8).reshape(-1, width).copy() if len(low) else np.empty((0, width), np.uint8)
        high[np.arange(width) >= 3 * self.key_length[:, None]] = 255
        high = np.ascontiguousarray(high).view(low.dtype).ravel()
        low, high = np.searchsorted(array, low, "left"), np.searchsorted(array, high, "right")
        return low, np.maximum(low, high)


def suffix_keys(codes: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Byte strings that sort as the first ``depth`` codes of each suffix; a word code is three non-zero digits."""
    step = np.arange(depth)
    where = np.minimum(at[:, None] + step, max(len(codes) - 1, 0))
    part = codes[where] if len(codes) else np.zeros((0, depth), np.int64)
    inside = step < left[:, None]
    digits = np.stack([part // DIGIT ** 2, part // DIGIT % DIGIT, part % DIGIT], axis=2) + 1
    digits[~inside] = 0
    return np.ascontiguousarray(digits.reshape(len(at), 3 * depth).astype(np.uint8)).view(f"S{3 * depth}").ravel()


class DeepOrder:
    """Order of suffixes to their full depth: ranks of their first 1, 2, 4, ... words; an end sorts before all words."""

    def __init__(self, codes: np.ndarray, left: np.ndarray):
        self.left = left
        self.ranks = [np.unique(codes, return_inverse=True)[1]]
        step, n, longest = 1, len(codes), int(left.max())
        while step < longest:
            before = self.ranks[-1]
            after = np.zeros(n, np.int64)
            more = np.flatnonzero(left > step)
            after[more] = before[more + step] + 1
            kinds, rank = np.unique(before * (n + 1) + after, return_inverse=True)
            self.ranks.append(rank)
            step *= 2
            if len(kinds) == n:
                break

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that two suffixes have in common."""
        most = np.minimum(self.left[a], self.left[b])
        size = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            on = np.flatnonzero(size < most)
            same = self.ranks[k][a[on] + size[on]] == self.ranks[k][b[on] + size[on]]
            size[on[same]] += 1 << k
        return np.minimum(size, most)

    def sorted(self, at: np.ndarray) -> np.ndarray:
        return at[np.argsort(self.ranks[-1][at], kind="stable")]

    def longest(self, a: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Longest match of each suffix of ``a`` with any of ``others`` (in order): that with a neighbour."""
        here = np.searchsorted(self.ranks[-1][others], self.ranks[-1][a])
        return np.maximum(self.common(a, others[np.maximum(here - 1, 0)]), self.common(a, others[np.minimum(here, len(others) - 1)]))

    def first_with(self, a: np.ndarray, others: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The smallest of ``others`` that have the first ``size`` words of ``a``; there is one at least."""
        here = np.searchsorted(self.ranks[-1][others], self.ranks[-1][a])
        ends = []
        for side in (-1, 1):
            near, far = np.zeros(len(a), np.int64), here if side < 0 else len(others) - here  # how many agree on this side
            while (open_ := near < far).any():
                middle = (near + far + 1) // 2
                at = np.clip(here - middle if side < 0 else here + middle - 1, 0, len(others) - 1)
                agree = self.common(a, others[at]) >= size
                near = np.where(open_ & agree, middle, near)
                far = np.where(open_ & ~agree, middle - 1, far)
            ends.append(here + side * near)
        cuts = np.stack(ends, axis=1).ravel()
        return np.minimum.reduceat(np.r_[others, np.iinfo(np.int64).max], cuts)[::2]


class Shard:
    """Suffix array of a slice of training text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, block: TestBlock):
        self.starts, self.ends, self.doc = words(data, offsets, NOT_ALNUM)
        h = hash_words(data, self.starts, self.ends)
        code = np.searchsorted(block.vocabulary, h)
        known = block.vocabulary[np.minimum(code, max(len(block.vocabulary) - 1, 0))] == h if len(block.vocabulary) else np.zeros(len(h), bool)
        self.codes = np.where(known, code + 1, 0)
        n = len(h)
        # known words up to the next unknown one or the end of the document
        begins = np.r_[True, ~known[1:] | ~known[:-1] | (self.doc[1:] != self.doc[:-1])] if n else np.empty(0, bool)
        ends = np.r_[np.flatnonzero(begins)[1:], n] if n else np.empty(0, np.int64)
        self.left = np.where(known, ends[np.cumsum(begins) - 1] - np.arange(n), 0) if n else ends
        at = np.flatnonzero(self.left >= max(block.shortest, 1)) if block.shortest else np.empty(0, np.int64)
        keys = suffix_keys(self.codes, at, self.left[at], block.window)
        order = np.argsort(keys, kind="stable")
        self.at, self.keys = at[order], keys[order]

        self.run = np.cumsum(begins) - 1
        self.low, self.high = block.search(self.keys)

    def begun(self, block: TestBlock) -> dict[int, np.ndarray]:
        """By length of window, the words where one begins, ascending; ranges are marked, not listed."""
        out = {}
        found = self.high > self.low
        for size in np.unique(block.key_length[found]).tolist():
            mine = found & (block.key_length == size)
            edge = np.zeros(len(self.at) + 1, np.int64)
            np.add.at(edge, self.low[mine], 1)
            np.add.at(edge, self.high[mine], -1)
            out[size] = np.sort(self.at[np.cumsum(edge[:-1]) > 0])
        return out

    def documents(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of document and window number, by document."""
        n = self.high - self.low
        which = np.repeat(np.arange(len(n)), n)
        place = self.at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.low, n)]
        pairs = np.unique(self.doc[place] * max(len(n), 1) + which)
        return pairs // max(len(n), 1), pairs % max(len(n), 1)

    def deep(self, block: TestBlock, places: np.ndarray) -> tuple[DeepOrder, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Full order of the runs around ``places`` (starts of whole windows) and of the items that have them.

        Also the numbers of ``places`` and of the test suffixes met in it, and the words either stand for.
        """
        runs = np.zeros(int(self.run[-1]) + 1, bool)
        runs[self.run[places]] = True
        mine = np.flatnonzero(runs[self.run])
        met = block.at[(self.high > self.low)[block.window_of] & (block.length == block.window)]
        items = np.zeros(len(block.ids), bool)
        items[block.owner[met]] = True
        theirs = np.flatnonzero(items[block.owner])
        order = DeepOrder(np.r_[self.codes[mine], block.codes[theirs]], np.r_[self.left[mine], block.left[theirs]])
        return order, np.searchsorted(mine, places), len(mine) + np.searchsorted(theirs, met), mine, met

    def longest_by_place(self, block: TestBlock, starts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Words where a window begins and the longest match with any test suffix there, a window at least."""
        places = np.concatenate([np.empty(0, np.int64), *starts.values()])
        sizes = np.concatenate([np.empty(0, np.int64), *(np.full(len(p), n, np.int64) for n, p in starts.items())])
        whole = starts.get(block.window)
        if whole is not None:
            order, a, b, _, _ = self.deep(block, whole)
            sizes[sizes == block.window] = order.longest(a, order.sorted(b))
        return places, sizes

    def longest(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Test word, first shard word and length of the longest match of every test suffix that has one of a window."""
        found = np.flatnonzero((self.high > self.low)[block.window_of] & (block.length < block.window))
        key = block.window_of[found]
        cuts = np.stack([self.low[key], self.high[key]], axis=1).ravel()
        first = np.minimum.reduceat(np.r_[self.at, np.iinfo(np.int64).max], cuts)[::2] if len(cuts) else np.empty(0, np.int64)
        out = [block.at[found]], [first], [block.length[found]]
        whole = self.begun(block).get(block.window)
        if whole is not None:
            order, a, b, mine, met = self.deep(block, whole)
            others = order.sorted(a)
            size = order.longest(b, others)
            for x, y in zip(out, (met, mine[order.first_with(b, others, size)], size), strict=True):
                x.append(y)
        return tuple(np.concatenate(x) for x in out)


def blocks_of(bench: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Test items in blocks of bounded text."""
    block, size = [], 0
    for r in bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        n = len((r.t or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


STATE = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_bits", T.BinaryType()), ("hit_items", T.ArrayType(T.StringType())),
         ("longest", T.LongType()), ("longest_at", T.LongType())]


def with_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
              keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` (all by default) by position as c0, c1, ..., then n_words, n_hit, hit_bits, hit_items,
    longest (words of the longest verbatim match that holds a window, 0 without one) and longest_at (its first word
    from 0, the earliest of equals, null without one).

    A null text has no words.  A null item has no windows; an item with a null id hits but is not listed.
    Items that repeat an id are listed once.  An empty test set hits nothing.
    """
    spark = docs.sparkSession
    names = docs.columns if keep is None else keep
    df = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).alias("whole_text"))
    n = len(names)
    shape = T.StructType([f for f in df.schema.fields] + [T.StructField(c, t) for c, t in STATE])
    blocks = blocks_of(bench, item_col, item_text, block_bytes)
    items, first = next(blocks, []), True
    while items is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(items)
        df = df.mapInArrow(_step(shared, n, first, window), shape)
        if following is not None:
            df = stored(df, "test-block")
            shared.destroy()
        items, first = following, False
    return df.drop("whole_text")


def _step(shared, n: int, first: bool, window: int):
    def run(batches):
        block = TestBlock(shared.value, window)
        for b in batches:
            data, offsets = flat(b.column(n))
            found = [[] for _ in STATE]
            for i, j in slices(offsets):
                s = Shard(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], block)
                begun = s.begun(block)
                edge = np.zeros(len(s.codes) + 1, np.int64)
                for size, places in begun.items():
                    edge[places] += 1
                    np.add.at(edge, places + size, -1)
                hit = np.cumsum(edge[:-1]) > 0
                sizes = np.bincount(s.doc, minlength=j - i)
                ends = np.cumsum(sizes)
                place, length = s.longest_by_place(block, begun)
                best = np.lexsort((place, -length, s.doc[place]))
                best = best[np.flatnonzero(np.diff(s.doc[place][best], prepend=-1))]
                longest = dict(zip(s.doc[place][best].tolist(), zip(length[best].tolist(), place[best].tolist(), strict=True), strict=True))
                doc, which = s.documents(block)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    bits = hit[ends[d] - sizes[d]:ends[d]]
                    r = i + d
                    mine = set()
                    if cuts[d] < cuts[d + 1]:
                        items = [block.item_of[block.items_from[w]:block.items_from[w + 1]] for w in which[cuts[d]:cuts[d + 1]]]
                        mine = {block.ids[o] for o in np.unique(np.concatenate(items)).tolist()} - {None}
                    most, where = longest.get(d, (0, None))
                    if where is not None:
                        where -= int(ends[d] - sizes[d])
                    if not first:
                        if old := b.column(n + 3)[r].as_py():
                            bits = bits | np.unpackbits(np.frombuffer(old, np.uint8), count=len(bits)).astype(bool)
                        mine |= set(b.column(n + 4)[r].as_py())
                        old = b.column(n + 5)[r].as_py(), b.column(n + 6)[r].as_py()
                        if old[0] > most or old[0] == most > 0 and old[1] < where:
                            most, where = old
                    for c, v in zip(found, (int(sizes[d]), int(bits.sum()), np.packbits(bits).tobytes() if bits.any() else None, sorted(mine), most, where),
                                    strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64())
            state = [pa.array(f, t) for f, t in zip(found, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(n + 1)] + state,
                                             [*b.schema.names[:n + 1], *(c for c, _ in STATE)])
    return run


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per document: words, words inside test windows, test items met, the verdict, the longest match and where it begins."""
    return with_hits(docs, bench, keep=[id_col], **kw).select(
        F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"), "longest", "longest_at")


def decontaminate(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """The documents that are not contaminated, all columns as they came."""
    clean = with_hits(docs, bench, **kw).filter(f"NOT ({CONTAMINATED})")
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Longest verbatim match of every test suffix over all shards: ``item_id, item_word, n_words, doc_id, doc_word``
    (word numbers from 0).  Matches shorter than a window (or than the item, if that is shorter) are not reported; of
    equal lengths the smallest document and place are given.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"item_id string, item_word long, n_words long, doc_id {kind}, doc_word long"
    best = F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").alias("d"), F.col("doc_word").alias("w"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    blocks = blocks_of(bench, item_col, item_text, block_bytes)
    items = next(blocks, [])
    while items is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            block = TestBlock(shared.value, window)
            begin = np.cumsum(np.bincount(block.owner, minlength=len(block.ids))) - np.bincount(block.owner, minlength=len(block.ids))
            for b in batches:
                data, offsets = flat(b.column(1))
                for i, j in slices(offsets):
                    s = Shard(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], block)
                    t, p, size = s.longest(block)
                    if len(t):
                        head = np.searchsorted(s.doc, np.arange(j - i))
                        owner, doc = block.owner[t], s.doc[p]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([block.ids[o] for o in owner.tolist()], pa.string()), pa.array(t - begin[owner], pa.int64()), pa.array(size, pa.int64()),
                             b.column(0).take(pa.array(i + doc)), pa.array(p - head[doc], pa.int64())],
                            ["item_id", "item_word", "n_words", "doc_id", "doc_word"])

        part = narrow.mapInArrow(run, shape).groupBy("item_id", "item_word").agg(F.min(best).alias("b"))
        if following is not None:
            part = stored(part, "longest-matches")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
        items = following
    # items that repeat an id may be in several blocks
    return out.groupBy("item_id", "item_word").agg(F.min("b").alias("b")).select(
        "item_id", "item_word", (-F.col("b.n")).alias("n_words"), F.col("b.d").alias("doc_id"), F.col("b.w").alias("doc_word"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def brute_force(texts: list[str | None], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """Plain restatement of the contract for tests."""
    import re
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    coded = [(i, split(t)) for i, t in items]
    out = []
    for t in texts:
        w = split(t)
        hit, met = set(), set()
        for i, x in coded:
            size = min(len(x), window)
            grams = {tuple(x[k:k + size]) for k in range(len(x) - size + 1)} if x else set()
            for k in range(len(w) - size + 1 if size else 0):
                if tuple(w[k:k + size]) in grams:
                    hit.update(range(k, k + size))
                    met.add(str(i))
        out.append((len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
