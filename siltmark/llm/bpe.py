"""Byte-pair encoding and decoding as streaming transducers (operator 4).

A merge list has a sufficient lookahead: how many bytes to the right of a token end can still change
whether that end is a token boundary.  It follows from the list alone (``sufficient_lookahead``).  The transducer is
fed bytes window by window, words one after another; tokens that end that far before the window's end, or belong to a
word that ends inside it, are stable and are emitted, and the rest of the last word is fed again with the next window.
So memory stays constant however long a word is.  Its output for the distinct words of a slice of documents is the
slice's cache; documents take their tokens from it by the number of the word at each position.  Long texts are cut
where no pre-token can span.  Decoding feeds token bytes to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.pieces import by_text, joined
from siltmark.llm.sharing import read, text_or_empty
from siltmark.llm.textarrays import flat, slices

# fixed values: white space of the public byte-level vocabularies' pre-token pattern, and its contractions
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = "s", "t", "re", "ve", "m", "ll", "d"
OTHER, LETTER, NUMBER, SPACE = range(4)
NO_RANK = 1 << 40
MIX = 0x9E3779B97F4A7C15
WINDOW = 1 << 18
LONG = 64
SEGMENT = 1 << 20  # characters of a text that are cut into words at once
SLICE = 8 << 20  # bytes of text that share a cache
TABLE_BITS = 18


def byte_letters() -> dict[str, int]:
    """Printable letter of every byte in byte-level vocabulary files, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    n = 0
    for b in range(256):
        if b not in out.values():
            out[chr(256 + n)] = b
            n += 1
    return out


def character_kinds() -> np.ndarray:
    """Letter, number, white space or other for every code point."""
    initial = np.frombuffer("".join([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]).encode(), np.uint8)
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds[initial == ord("L")] = LETTER
    kinds[initial == ord("N")] = NUMBER
    kinds[SPACES] = SPACE
    return kinds


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right of a boundary that can influence it.

    A merge (u, v) is prevented only if v is consumed first, by an earlier merge (v, w), or never forms.
    Whether (v, w) fires depends on bytes to the right of w in the same way, through merges that are
    earlier still, so one pass over the list in priority order adds up the longest such chain.
    """
    reach_of: dict[bytes, int] = {}   # right influence on how a token forms
    open_to: dict[bytes, int] = {}    # right influence on a token being consumed by the merges so far
    most = 0
    for u, v in merges:
        right = max(open_to.get(v, 0), reach_of.get(v, 0))
        most = max(most, len(v) + right)
        reach_of[u + v] = max(reach_of.get(u + v, 0), right)
        open_to[u] = max(open_to.get(u, 0), len(v) + right)
    return most


class Transducer:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in spec["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((self.id_of[a], self.id_of[b]), (r, self.id_of[a + b]))
        self.lookahead = sufficient_lookahead(merges)
        self.window = max(WINDOW, 4 * self.lookahead)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.special_at = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.first = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.kinds = character_kinds()
        size = max(self.bytes_of) + 1
        self.labels = pa.array([f",{i}".encode() for i in range(size)], pa.large_binary())
        self.spelled = pa.array([self.bytes_of.get(i, b"") for i in range(size)], pa.large_binary())
        self.length = pc.binary_length(self.spelled).to_numpy()
        self.fill_table()

    def fill_table(self) -> None:
        """Open-addressed arrays of pair -> rank and product, for many look-ups at once."""
        size = 1 << TABLE_BITS
        while size < 4 * len(self.rank):
            size *= 2
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.slot_pair = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, NO_RANK, np.int64)
        self.slot_out = np.zeros(size, np.int64)
        for (a, b), (r, out) in self.rank.items():
            k = (a << 32) | b
            h = ((k * MIX) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.slot_pair[h] >= 0:
                h = (h + 1) % size
            self.slot_pair[h], self.slot_rank[h], self.slot_out[h] = k, r, out

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every pair, or the slot of an empty place."""
        k = (a << 32) | b
        h = ((k.astype(np.uint64) * np.uint64(MIX)) >> self.shift).astype(np.int64)
        todo = np.flatnonzero((self.slot_pair[h] != k) & (self.slot_pair[h] >= 0))
        while len(todo):
            h[todo] = (h[todo] + 1) % len(self.slot_pair)
            there = self.slot_pair[h[todo]]
            todo = todo[(there != k[todo]) & (there >= 0)]
        return h

    def merged_together(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and tokens of many short words after all merges; every round applies each word's next merge."""
        done = [(owner[:0], ids[:0])]
        while len(ids):
            slot = self.look_up(ids[:-1], ids[1:])
            rank = np.append(np.where(owner[:-1] == owner[1:], self.slot_rank[slot], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            live = best < NO_RANK
            done.append((owner[~live], ids[~live]))
            at = np.flatnonzero(live & (rank == best))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            ids[at] = self.slot_out[slot[at]]
            live[at + 1] = False
            ids, owner = ids[live], owner[live]
        return np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same for one long word, with a queue of its pairs."""
        n, rank = len(ids), self.rank
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(rank[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in rank]
        heapq.heapify(queue)
        while queue:
            _, i, p = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != p:
                continue
            ids[i], alive[j], after[i] = rank[p][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := (ids[a], ids[b])) in rank:
                    heapq.heappush(queue, (rank[q][0], a, q))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def feed(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words between ``offsets``, one word after another, and how many each has."""
        at, owners, tokens = 0, [], []
        while at < len(data):
            end = min(at + self.window, len(data))
            first, last = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end, "left")
            cuts = np.concatenate([[at], offsets[first + 1:last], [end]])
            sizes = np.diff(cuts)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ids = self.first[data[at:end]]
            short = (sizes <= LONG)[owner]
            parts = [self.merged_together(ids[short], owner[short])]
            for w in np.flatnonzero(sizes > LONG):
                long = np.array(self.merged_long(ids[cuts[w] - at:cuts[w + 1] - at].tolist()), np.int64)
                parts.append((np.full(len(long), w), long))
            owner, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
            if end != offsets[last]:  # the last word goes on: only its stable tokens are out
                ends = at + np.cumsum(self.length[ids])
                out = (owner < len(sizes) - 1) | (ends <= end - self.lookahead)
                owner, ids, end = owner[out], ids[out], int(ends[out][-1])
            owners.append(owner + first)
            tokens.append(ids)
            at = end
        owner = np.concatenate([np.empty(0, np.int64), *owners])
        return np.concatenate([np.empty(0, np.int64), *tokens]), np.bincount(owner, minlength=len(offsets) - 1)

    def cuts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Starts of all words of segments, and the end of the data; segments in ``whole`` are one word each.

        Words are runs of letters, of numbers, of white space or of anything else.  White space before another run
        leaves its last character to it if that is a space, else as a word of its own.  A quote that starts a word and
        a contraction's letters behind it are a word.  A few segments at a time are decoded, since a character takes
        some fifty bytes meanwhile.
        """
        out = []
        for i, j in slices(offsets, SEGMENT):
            a, b = offsets[i], offsets[j]
            out.append(a + self.starts(data[a:b], offsets[i:j + 1] - a, whole[(whole >= i) & (whole < j)] - i))
        return np.concatenate([*out, [len(data)]])

    def starts(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Starts of all words of a few segments."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        n = len(points)
        first = np.zeros(n + 1, bool)
        edges = np.searchsorted(place, offsets)
        first[edges] = True
        first[n] = True
        kind = np.append(self.kinds[points], OTHER)
        start = first.copy()
        start[1:n] |= kind[1:n] != kind[:n - 1]
        left = (kind[:n] == SPACE) & ((kind[1:] != SPACE) & ~first[1:])
        start[:n] |= left
        start[1 + np.flatnonzero(left & (points == 0x20))] = False
        quote = np.flatnonzero(start[:n] & (points == 0x27))
        padded = np.concatenate([points, [0, 0, 0]])
        stop = np.append(first, [True, True, True])
        for letters in CONTRACTIONS:
            hit = np.ones(len(quote), bool)
            for k, c in enumerate(letters, 1):
                hit &= (padded[quote + k] == ord(c)) & ~stop[quote + k]
            at = quote[hit]
            start[at + 1] = False
            start[at + 1 + len(letters)] = True
        for s in whole:
            start[edges[s] + 1:edges[s + 1]] = False
        return place[np.flatnonzero(start[:n])]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text that words do not span, and whether a part is a special token."""
        at = 0
        marks = self.special_at.finditer(text) if self.special_at else ()
        for begin, end in [*((m.start(), m.end()) for m in marks), (len(text), len(text))]:
            while at < begin:
                # a word may begin with a space but never goes on with one after other characters
                to = at + SEGMENT
                while to < begin and not (text[to] == " " and not text[to - 1].isspace()):
                    to = text.find(" ", to + 1, begin)
                    to = begin if to < 0 else to
                to = min(to, begin)
                yield text[at:to], False
                at = to
            if end > begin:
                yield text[begin:end], True
            at = end

    def chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words of texts, the number of the word at each position, and the position each text ends at."""
        parts = [(p, mark, i) for i, t in enumerate(texts) for p, mark in self.segments(t)]
        data, offsets = flat(pa.array([p for p, _, _ in parts], pa.large_string()))
        cuts = self.cuts(data, offsets, np.array([k for k, (_, mark, _) in enumerate(parts) if mark], np.int64))
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        found = words.dictionary_encode()
        size = np.zeros(len(texts), np.int64)
        np.add.at(size, [i for _, _, i in parts], np.diff(offsets))
        return found.dictionary, found.indices.to_numpy(), np.searchsorted(cuts, np.cumsum(size))

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of distinct words, one word after another, and how many each has."""
        data, offsets = flat(words.cast(pa.large_string()))
        ids, n = self.feed(data, offsets)
        for s, i in self.special.items():
            w = pc.index(words, pa.scalar(s.encode(), pa.large_binary())).as_py()
            if w >= 0:
                at = int(n[:w].sum())
                ids, n[w] = np.concatenate([ids[:at], [i], ids[at + n[w]:]]), 1
        return ids, n

    def encode(self, text: str) -> list[int]:
        words, codes, _ = self.chunks([text])
        ids, n = self.tokens(words)
        stops = np.concatenate([[0], np.cumsum(n)])
        return [i for c in codes for i in ids[stops[c]:stops[c + 1]].tolist()]

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(decoded(self.bytes_of.get(i, b"") for i in ids))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Token count, SHA-256 of the ids and SHA-256 of the decoded text of every text of a slice."""
        words, codes, ends = self.chunks(texts)
        ids, n = self.tokens(words)
        labels, back, at = joined(self.labels, ids, n), joined(self.spelled, ids, n), pa.array(codes)
        for start, end, i, d in zip([0, *ends[:-1].tolist()], ends.tolist(), by_text(labels, at, ends), by_text(back, at, ends), strict=True):
            text_hash, state = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
            for k in range(0, len(d), SEGMENT):
                text_hash.update(state.decode(d[k:k + SEGMENT]).encode())
            text_hash.update(state.decode(b"", True).encode())
            yield int(n[codes[start:end]].sum()), hashlib.sha256(i[1:]).hexdigest(), text_hash.hexdigest()


def decoded(parts: Iterable[bytes]) -> Iterator[str]:
    """Text of token bytes as it becomes complete; malformed bytes become U+FFFD."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for p in parts:
        if s := state.decode(p):
            yield s
    if s := state.decode(b"", True):
        yield s


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


_LOADED: dict[str | None, Transducer] = {}


def transducer(path: str | None) -> Transducer:
    """The vocabulary of ``path``, read once in each worker process; without a path the public one, where the worker has it."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path or default_path())
    return _LOADED[path]


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests per document.  A null text counts as empty; a null id stays null; repeated
    rows give repeated results; other columns are not read; no rows in, no rows out."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        t = transducer(path)
        for b in batches:
            _, offsets = flat(b.column(1))
            for i, j in slices(offsets, SLICE):
                got = list(t.digests(b.column(1).slice(i, j - i).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()),
                     pa.array([g[2] for g in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The token ids themselves: ``doc_id, ids array<int>``, same rules as ``encode_digests``."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.encode(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; unknown ids give no bytes, null ids the empty text."""
    kind = tokens.schema["doc_id"].dataType

    def run(batches):
        t = transducer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind.simpleString()}, text string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return encode_digests(read(spark, sf_dir, "documents"))
