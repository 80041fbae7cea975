"""Language-model scores by prediction by partial matching (operator 6).

The model is a trie of byte contexts up to ``ORDER`` bytes, counted over all training documents.  A byte is coded
in the longest context seen in training; if it is new there an escape is paid (method D: symbol (2n - 1) / 2N,
escape D / 2N) and the next shorter context is tried with the symbols of the longer one excluded, down to a
uniform choice among bytes never seen.  A document is its words, each followed by a space, and an end mark.

Nothing is gathered in one place but the trie's lowest levels, which hold at most 2**24 events however large the
corpus is.  Documents are read in slices of rows.  A slice sends the distinct events it contains (context and
byte packed into one integer) and its distinct words to hash buckets; contexts with equal last three bytes
share a bucket, so a bucket has whole subtries.  Buckets add up the training counts, work out the code length
of every event and answer each slice; the slice then adds up its documents.  Traffic follows distinct events
per slice, not bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import id_bucket, read, shared_folder, text_or_empty
from siltmark.llm.textarrays import LOWER, WHITE, flat, hash_words, mix, slices, words

FOLDS, HELD_OUT = 7, 2
ORDER = 5                    # an event takes 48 bits, which leaves 16 for a text number
LOW = 2                      # orders up to this are kept in every task
SLICE_ROWS = 4096
SPACE, END = 0x20, 0x0A
WORD_FLAG = np.uint64(1 << 63)
END_WORD = np.uint64(0xFFFFFFFFFFFFFFFF)


def symbols(data: np.ndarray, offsets: np.ndarray):
    """Packed events and their documents, word keys and their documents."""
    data = LOWER[data]
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets, WHITE)
    keys = np.minimum(hash_words(data, starts, ends) | WORD_FLAG, END_WORD - np.uint64(1))
    lens = ends - starts
    per_doc = np.bincount(doc, weights=lens + 1, minlength=n).astype(np.int64) + 1
    total = int(per_doc.sum())
    out = np.full(total, SPACE, np.uint8)
    base = np.cumsum(lens + 1) - (lens + 1) + doc
    before = np.cumsum(lens) - lens
    out[np.repeat(base - before, lens) + np.arange(int(lens.sum()))] = data[~WHITE[data]]
    last = np.cumsum(per_doc)
    out[last - 1] = END
    place = np.arange(total) - np.repeat(last - per_doc, per_doc)
    events = out.astype(np.uint64)
    for k in range(1, ORDER + 1):
        back = np.full(total, END, np.uint8)
        back[k:] = out[:-k] if k < total else back[k:]
        back[place < k] = END
        events |= back.astype(np.uint64) << np.uint64(8 * k)
    owner = np.repeat(np.arange(n), per_doc)
    return events, owner, np.concatenate([keys, np.full(n, END_WORD)]), np.concatenate([doc, np.arange(n)])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Events by their last three context bytes, words by themselves."""
    part = np.where(keys >= WORD_FLAG, keys, (keys >> np.uint64(8)) & np.uint64(0xFFFFFF))
    return (mix(part) >> np.uint64(8)) % np.uint64(buckets)


def packed(values: np.ndarray) -> bytes:
    """Integers with equal bytes of all of them next to each other, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts; a plain sort is much faster here than a hash table."""
    v = np.sort(values)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.empty(0, np.int64)
    return v[first], np.diff(np.r_[first, len(v)])


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n, first).astype(np.int64) if len(k) else n.astype(np.int64)


def count_slice(data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of some texts and how often the training texts among them have each."""
    every, learnt, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for i, j in slices(offsets):
        e, de, w, dw = symbols(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        for keys, docs in ((e, de), (w, dw)):
            every.append(distinct(keys)[0])
            u, n = distinct(keys[train[i:j][docs]])
            learnt.append(u)
            counts.append(n)
    keys = distinct(np.concatenate(every))[0]
    u, n = merged(learnt, counts)
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, u)] = n
    return keys, out


def sums_by_text(events: np.ndarray, owner: np.ndarray, n: int, values_of) -> np.ndarray:
    """Sum of the values of each text's events; ``values_of`` sees every distinct event once, in order.

    Event and text number share one integer, so one plain sort brings equal events together.
    """
    both = np.sort(events << np.uint64(16) | owner.astype(np.uint64))
    event = both >> np.uint64(16)
    first = np.flatnonzero(np.r_[True, event[1:] != event[:-1]]) if len(event) else np.empty(0, np.int64)
    value = np.repeat(values_of(event[first]), np.diff(np.r_[first, len(event)]))
    return np.bincount((both & np.uint64(0xFFFF)).astype(np.int64), weights=value.astype(float), minlength=n)


def by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, positions) of sorted keys, keys ascending in each bucket."""
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(b[part[0]]), part


class LowLevels:
    """Counts of orders 0 to 2 from (packed event of order 2, count) pairs."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order].astype(np.uint64), counts[order].astype(np.int64)
        live = self.counts > 0
        c, n = self.codes[live].astype(np.int64), self.counts[live]
        self.n1 = np.bincount(c & 0xFFFF, weights=n, minlength=1 << 16)
        self.n0 = np.bincount(c & 0xFF, weights=n, minlength=1 << 8)
        self.total2 = np.bincount(c >> 8, weights=n, minlength=1 << 16)
        self.kinds2 = np.bincount(c >> 8, minlength=1 << 16)
        self.total1 = self.n1.reshape(256, 256).sum(axis=1)
        self.kinds1 = (self.n1.reshape(256, 256) > 0).sum(axis=1)
        self.total0, self.kinds0 = self.n0.sum(), int((self.n0 > 0).sum())
        # weight of the longer context's symbols in the shorter one
        self.shadow1 = np.bincount(c >> 8, weights=self.n1[c & 0xFFFF], minlength=1 << 16)
        seen1 = np.flatnonzero(self.n1)
        self.shadow0 = np.bincount(seen1 >> 8, weights=self.n0[seen1 & 0xFF], minlength=1 << 8)

    def count2(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0)


def code_lengths(events: np.ndarray, counts: np.ndarray, low: LowLevels, order: int = ORDER) -> np.ndarray:
    """log10 probability of every event; ``events`` are sorted and hold whole subtries below order three."""
    size = len(events)
    out = np.zeros(size)
    open_ = np.ones(size, bool)          # not coded yet
    entered = np.zeros(size, bool)       # some longer context was seen in training
    shadow = np.zeros(size)              # weight of excluded symbols in the current context
    kinds_above = np.zeros(size)
    upper = None
    for j in range(order, -1, -1):
        code = events & np.uint64((1 << 8 * (j + 1)) - 1)
        if j > LOW:
            _, at = np.unique(code, return_inverse=True)
            sums = np.bincount(at, weights=counts)
            n = sums[at]
            first = np.zeros(len(sums), np.int64)
            first[at] = np.arange(size)
            names, node_of = np.unique(code[first] >> np.uint64(8), return_inverse=True)
            total_, kinds_ = np.bincount(node_of, weights=sums), np.bincount(node_of, weights=sums > 0)
            node = node_of[at]
            total, kinds = total_[node], kinds_[node]
        elif j == 2:
            n, c = low.count2(code), (code >> np.uint64(8)).astype(np.int64)
            total, kinds = low.total2[c], low.kinds2[c]
        elif j == 1:
            c = code.astype(np.int64)
            n, total, kinds = low.n1[c], low.total1[c >> 8], low.kinds1[c >> 8]
        else:
            n, total, kinds = low.n0[code.astype(np.int64)], np.full(size, low.total0), np.full(size, low.kinds0)
        if upper is not None:
            if upper[0] > LOW:
                # events of the longer order, once each: what their symbols weigh here
                _, first_u, node_u, sums_u, at_u = upper
                per = np.bincount(node_u, weights=np.where(sums_u > 0, n[first_u], 0))
                shadow = per[node_u[at_u]]
            elif j == 1:
                shadow = low.shadow1[((events >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
            else:
                shadow = low.shadow0[((events >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)]
        left = np.where(entered, total - shadow, total)
        fresh = np.where(entered, kinds - kinds_above, kinds)
        hit = open_ & (n > 0)
        out[hit] += np.log10((2 * n[hit] - 1) / (2 * left[hit]))
        open_ &= ~hit
        escape = open_ & (total > 0) & (fresh > 0)
        out[escape] += np.log10(fresh[escape] / (2 * left[escape]))
        entered |= total > 0
        kinds_above = kinds
        upper = (j, first, node_of, sums, at) if j > LOW else (j,)
    rest = 256 - low.kinds0
    out[open_] -= np.log10(rest) if rest else 0.0
    return out


def _split(table: pa.Table):
    keys = [unpacked(x.as_buffer(), np.uint64) for x in table.column("keys")]
    counts = [unpacked(x.as_buffer(), np.int32) for x in table.column("counts")]
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, u, inverse, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u)).astype(np.int64)


def answered(table: pa.Table, low: LowLevels) -> pa.Table:
    """Per slice the code lengths of its events (float32) and the counts of its words (int64), in the order of its keys."""
    keys, u, inverse, n = _split(table)
    words_at = int(np.searchsorted(u, WORD_FLAG))  # words sort behind all events
    length = code_lengths(u[:words_at], n[:words_at], low).astype(np.float32)
    ends = np.cumsum([len(k) for k in keys])
    lengths, counts = [], []
    for k, e in zip(keys, ends, strict=True):
        at = inverse[e - len(k):e]
        cut = int(np.searchsorted(k, WORD_FLAG))
        lengths.append(packed(length[at[:cut]]) if cut else None)
        counts.append(packed(n[at[cut:]]) if cut < len(k) else None)
    return pa.table({"slice": table.column("slice"), "keys": table.column("keys"), "lengths": pa.array(lengths, pa.binary()),
                     "counts": pa.array(counts, pa.binary())})


def gathered(found: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Sorted events with their code lengths and sorted words with their counts, from the answers to a slice."""
    keys = [unpacked(x.as_buffer(), np.uint64) for x in found.column("keys")]
    cuts = [int(np.searchsorted(k, WORD_FLAG)) for k in keys]
    out = []
    for name, kind, parts in (("lengths", np.float32, [k[:c] for k, c in zip(keys, cuts, strict=True)]),
                              ("counts", np.int64, [k[c:] for k, c in zip(keys, cuts, strict=True)])):
        k = np.concatenate([np.empty(0, np.uint64), *parts])
        v = np.concatenate([np.empty(0, kind), *(unpacked(x.as_buffer(), kind) for x in found.column(name) if x.is_valid)])
        order = np.argsort(k)
        out.append((k[order], v[order]))
    return out[0], out[1]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Per document: tokens, known tokens, training tokens, unigram score and model score (log10).

    A null text counts as empty and has the end token alone; a null id belongs to the training fold.  Without
    training text every byte costs log10(256).  Repeated rows count as often as they occur.  ``docs`` is read twice
    and must give the same rows in the same partitions, as a table scan does; a slice with events it did not
    have before fails the job instead of giving wrong scores.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    buckets = min(1 << 14, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    at = F.monotonically_increasing_id()
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), (id_bucket(id_col, folds) == held_out).alias("held_out"),
                    (F.shiftright(at, 33) * (1 << 24) + F.floor(at.bitwiseAND((1 << 33) - 1) / SLICE_ROWS)).cast("long").alias("slice"))

    def count(batches):
        def flush(name, keys, counts):
            u, n = merged(keys, counts)
            word = u >= WORD_FLAG
            rows = [(name, b, None, packed(u[p]), packed(n[p].astype(np.int32)), None, None) for b, p in by_bucket(u, buckets)]
            # training words for the vocabulary, and counts of the lowest levels
            v, m = u[word & (n > 0)], int(n[word].sum())
            rows += [(name, b, True, packed(v[p]), None, None, None) for b, p in by_bucket(v, buckets)]
            code, sums = merged([u[~word] & np.uint64(0xFFFFFF)], [n[~word]])
            live = sums > 0
            rows.append((name, -1, False, None, None, [*code[live].astype(np.int64).tolist(), -1], [*sums[live].tolist(), m]))
            c = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)],
                                              ["slice", "bucket", "vocabulary", "keys", "counts", "codes", "sums"])
        held, name = ([], []), None
        for b in batches:
            data, offsets = flat(b.column(0))
            train = ~np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)
            where = b.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(where)) + 1), len(where)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e == s:
                    continue
                if name is not None and where[s] != name:
                    yield flush(name, *held)
                    held = ([], [])
                name = int(where[s])
                k, n = count_slice(data[offsets[s]:offsets[e]], offsets[s:e + 1] - offsets[s], train[s:e])
                held[0].append(k)
                held[1].append(n)
        if name is not None:
            yield flush(name, *held)

    folder = shared_folder(spark, "ppm")
    shape = "slice long, bucket int, vocabulary boolean, keys binary, counts binary, codes array<long>, sums array<long>"
    d.select("text", "held_out", "slice").mapInArrow(count, shape).write.parquet(folder)
    counted = spark.read.schema(shape).parquet(folder)

    low = (counted.filter("NOT vocabulary").select(F.arrays_zip("codes", "sums").alias("z")).select(F.inline("z"))
           .groupBy("codes").agg(F.sum("sums").alias("n")).toArrow())  # at most 2**24 + 1 rows
    codes, n = low.column("codes").to_numpy(), low.column("n").to_numpy()
    tokens = int(n[codes == -1].sum())
    shared = spark.sparkContext.broadcast((codes[codes >= 0], n[codes >= 0]))

    def words_of(table):
        return pa.table({"n": pa.array([len(distinct(np.concatenate([unpacked(x.as_buffer(), np.uint64) for x in table.column("keys")]))[0])], pa.int64())})

    kinds = counted.filter("vocabulary").select("bucket", "keys").groupBy("bucket").applyInArrow(words_of, "n long").agg(F.sum("n")).first()[0] or 0
    unknown = -np.log10(tokens + kinds + 1)

    def answer(table):
        return answered(table, LowLevels(*shared.value))

    asked = counted.filter("vocabulary IS NULL").select("slice", "bucket", "keys", "counts")
    answers = asked.groupBy("bucket").applyInArrow(answer, "slice long, keys binary, lengths binary, counts binary")

    def add_up(texts, found):
        data, offsets = flat(texts.column("text").combine_chunks())
        n_docs = len(offsets) - 1
        events, counts = gathered(found)

        def look_up(wanted, keys, value):
            at = np.searchsorted(keys, wanted)
            if len(wanted) and (not len(keys) or not np.array_equal(keys[np.minimum(at, len(keys) - 1)], wanted)):
                raise ValueError("a slice changed between two readings of the documents")
            return value[at]

        cols = [np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs), np.zeros(n_docs)]
        for i, j in slices(offsets):
            e, de, w, dw = symbols(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            seen = look_up(w, *counts)
            base = np.log10(seen + 1.0) + unknown
            cols[0][i:j] = np.bincount(dw, minlength=j - i)
            cols[1][i:j] = np.bincount(dw, weights=seen > 0, minlength=j - i)
            cols[2][i:j] = np.bincount(dw, weights=base, minlength=j - i)
            cols[3][i:j] = sums_by_text(e, de, j - i, lambda wanted: look_up(wanted, *events))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": cols[0], "n_known": cols[1],
                         "train_tokens": np.full(n_docs, tokens), "base_score": cols[2], "score": cols[3]})

    return d.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, counts from all documents outside the held-out fold."""
    return score_documents(read(spark, sf_dir, "documents"))
