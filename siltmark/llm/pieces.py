"""SentencePiece encoding and decoding over distinct-chunk tables (operator 13).

No piece of the vocabulary has a white-space marker behind another character, so no merge crosses the start of a
marked word: a text's tokens are those of its marked words, one after another.  Every slice of documents lists its
distinct words with a code each; each distinct word is segmented once, all of them together; ids and decoded bytes of
the table's entries are joined back to the documents by the code at each position.  Texts are not shuffled and a slice
bounds memory.  A table for the whole corpus was built and left again: sending every slice's distinct words to it and
the ids back shuffles several times the input, to save segmenting that costs less than the sending (see README).

Segmenting follows the vocabulary's scores: the best-scored pair of neighbours is merged first, the leftmost among
equals; characters without a piece become byte pieces.  Decoding feeds pieces to an incremental UTF-8 machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import read, text_or_empty
from siltmark.llm.textarrays import flat, slices

MARK = "▁"
LONG = 64
SLICE = 8 << 20  # bytes of text that share a table
POSITIONS = 1 << 18  # words of texts whose strings are out at once
NO_RANK = 1 << 40
SHIFT = 22  # bits for a symbol; code points and pieces stay below


class Pieces:
    """Vocabulary of one model file, and the segmenter of marked words."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        piece, score = [model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)]
        if model.encode("  a", out_type=str)[:1] == ["▁a"] or any(model.is_unused(i) for i in range(n)):
            raise ValueError("models that drop white space or hold unused pieces are not read")
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        whole: dict[str, int] = {}
        for i, p in enumerate(piece):
            if model.is_byte(i):
                value = int(p[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i):
                self.bytes_of.append(b"")
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                whole[p] = i
                self.bytes_of.append(p.replace(MARK, " ").encode())
        # symbols: pieces by id, other characters behind them by code point
        self.size = n
        self.symbol_of_char = np.arange(0x110000, dtype=np.int64) + n
        for p, i in whole.items():
            if len(p) == 1:
                self.symbol_of_char[ord(p)] = i
        levels = {s: r for r, s in enumerate(sorted({score[i] for i in whole.values()}, reverse=True))}
        symbol = lambda p: whole.get(p, n + ord(p) if len(p) == 1 else None)
        pairs = {}
        for p, i in whole.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = levels[score[i]], i
        order = sorted(pairs)
        self.pair_key = np.array([*order, 1 << 62], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in order), NO_RANK], np.int64)
        self.pair_out = np.array([*(pairs[k][1] for k in order), 0], np.int64)
        self.pairs = pairs
        # where texts may be cut: before a marker that follows another character, around bytes of no piece
        self.crossing = any(MARK in p.lstrip(MARK) for p in whole)
        used = {c for p in whole for c in p}
        self.alone = np.array([b < 128 and chr(b) not in used and b != 0x20 for b in range(256)])
        self.labels = pa.array([f",{i}".encode() for i in range(n)], pa.large_binary())
        self.spelled = pa.array(self.bytes_of, pa.large_binary())

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of all marked words in ``data`` (texts with their marker as a space), and its length."""
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        if len(data) and not self.crossing:
            space, alone = data == 0x20, self.alone[data]
            first[1:-1] |= (space[1:] & ~space[:-1]) | (alone[1:] != alone[:-1])
        first[len(data)] = True
        return np.flatnonzero(first)

    def segment(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the marked words (their markers as spaces), one word after another, and how many each has."""
        raw, _ = flat(words)
        points = np.frombuffer(raw.tobytes().decode().replace(" ", MARK).encode("utf-32-le"), np.uint32)
        symbols = self.symbol_of_char[points]
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        long = np.flatnonzero(sizes > LONG)
        owner = np.repeat(np.arange(len(words)), sizes)
        short = (sizes <= LONG)[owner]
        parts = [self.merged_together(symbols[short], owner[short])]
        for w in long:
            ids = np.array(self.merged_long(symbols[ends[w] - sizes[w]:ends[w]].tolist()), np.int64)
            parts.append((np.full(len(ids), w), ids))
        owner, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        return self.with_bytes(owner[order], ids[order], len(words))

    def merged_together(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and symbols of many short words after all merges; every round applies each word's next merge."""
        done = [(owner[:0], ids[:0])]
        while len(ids):
            key = ids[:-1] << SHIFT | ids[1:]
            slot = np.searchsorted(self.pair_key, key)
            hit = (self.pair_key[slot] == key) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(hit, self.pair_rank[slot], NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            live = best < NO_RANK
            done.append((owner[~live], ids[~live]))
            at = np.flatnonzero(live & (rank == best))
            at = at[np.append(True, owner[at][1:] != owner[at][:-1])] if len(at) else at
            ids[at] = self.pair_out[slot[at]]
            live[at + 1] = False
            ids, owner = ids[live], owner[live]
        return np.concatenate([o for o, _ in done]), np.concatenate([i for _, i in done])

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same for one long word, with a queue of its pairs."""
        n, pairs = len(ids), self.pairs
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(pairs[k][0], i, k) for i in range(n - 1) if (k := ids[i] << SHIFT | ids[i + 1]) in pairs]
        heapq.heapify(queue)
        while queue:
            _, i, k = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or ids[i] << SHIFT | ids[j] != k:
                continue
            ids[i], alive[j], after[i] = pairs[k][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (q := ids[a] << SHIFT | ids[b]) in pairs:
                    heapq.heappush(queue, (pairs[q][0], a, q))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def with_bytes(self, owner: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids by owner and their number; a character without a piece becomes the pieces of its bytes."""
        other = np.flatnonzero(symbols >= self.size)
        if len(other):
            kinds, which = np.unique(symbols[other], return_inverse=True)
            spelled = [self.byte_id[list(chr(k - self.size).encode())] for k in kinds.tolist()]
            times = np.ones(len(symbols), np.int64)
            times[other] = np.array([len(x) for x in spelled])[which]
            at = np.cumsum(times) - times
            owner, symbols = np.repeat(owner, times), np.repeat(symbols, times)
            for k in range(4):
                sure = np.array([len(x) > k for x in spelled])[which]
                symbols[at[other][sure] + k] = np.array([x[k] if len(x) > k else 0 for x in spelled])[which[sure]]
        return symbols, np.bincount(owner, minlength=n)

    def marked(self, texts: pa.Array) -> pa.Array:
        """Texts as the model sees them: a marker in front, every marker as a space."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARK, " ")
        return pc.binary_join_element_wise(pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ").cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))

    def encode(self, text: str) -> list[int]:
        words, codes, _ = self.chunks(*flat(self.marked(pa.array([text], pa.string()))))
        ids, n = self.segment(words)
        stops = np.concatenate([[0], np.cumsum(n)])
        return [i for c in codes for i in ids[stops[c]:stops[c + 1]].tolist()]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of a whole text's ids; the marker in front is not text, incomplete bytes become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        return ("".join([state.decode(self.bytes_of[i]) for i in ids]) + state.decode(b"", True)).removeprefix(" ")

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct marked words, the number of the word at each position, and the position each text ends at."""
        cuts = self.cuts(data, offsets)
        words = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        found = words.dictionary_encode()
        return found.dictionary, found.indices.to_numpy(), np.searchsorted(cuts, offsets[1:])

    def table(self, words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The chunk table: number of ids, ids as text (a comma before each) and decoded bytes of every distinct word."""
        ids, n = self.segment(words)
        return n, joined(self.labels, ids, n), joined(self.spelled, ids, n)


def joined(strings: pa.Array, ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """One binary per word: the strings of its ids, one after another."""
    each = strings.take(pa.array(ids))
    _, offsets, data = each.buffers()
    ends = np.frombuffer(offsets, np.int64)[np.concatenate([[0], np.cumsum(n)])] if len(each) else np.zeros(len(n) + 1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends), data])


def by_text(strings: pa.Array, codes: pa.Array, ends: np.ndarray) -> Iterator[memoryview]:
    """For each text, the table's strings at its positions, one after another; made for a few texts at a time."""
    stops = np.concatenate([[0], ends])
    for i, j in slices(stops, POSITIONS):
        each = strings.take(codes.slice(stops[i], stops[j] - stops[i]))
        _, offsets, data = each.buffers()
        at = np.frombuffer(offsets, np.int64)[stops[i:j + 1] - stops[i]] if len(each) else np.zeros(j - i + 1, np.int64)
        view = memoryview(data) if data is not None else memoryview(b"")
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield view[a:b]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


_LOADED: dict[str | None, Pieces] = {}


def vocabulary(path: str | None) -> Pieces:
    """The model of ``path``, read once in each worker process; without a path the public one, where the worker has it."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path or default_path())
    return _LOADED[path]


def digests(texts: pa.Array, voc: Pieces) -> Iterator[tuple[int, str, str]]:
    """Number of ids, SHA-256 of the ids and of the decoded text of every text of one slice."""
    words, codes, ends = voc.chunks(*flat(voc.marked(texts)))
    n, ids, back = voc.table(words)
    total = np.concatenate([[0], np.cumsum(n[codes])])
    at = pa.array(codes)
    spelled = pc.equal(back, words.cast(pa.large_binary()))
    if not pc.all(spelled, min_count=0).as_py():
        raise ValueError("the model's pieces do not spell what they encode")
    for start, end, i, d in zip([0, *ends[:-1].tolist()], ends.tolist(), by_text(ids, at, ends), by_text(back, at, ends), strict=True):
        # the comma in front is not of the list, the space in front not of the text
        yield int(total[end] - total[start]), hashlib.sha256(i[1:]).hexdigest(), hashlib.sha256(d[1:]).hexdigest()


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document.

    A null text counts as empty and has no tokens; a null id stays null; repeated rows give repeated results;
    other columns are not read; no rows in, no rows out.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            _, offsets = flat(b.column(1))
            for i, j in slices(offsets, SLICE):
                got = list(digests(b.column(1).slice(i, j - i), voc))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string())))],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves: ``doc_id, ids array<int>``, same rules as ``encode_digests``."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            _, offsets = flat(b.column(1))
            for i, j in slices(offsets, SLICE):
                words, codes, ends = voc.chunks(*flat(voc.marked(b.column(1).slice(i, j - i))))
                ids, n = voc.segment(words)
                stops = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                table = pa.ListArray.from_arrays(pa.array(stops), pa.array(ids.astype(np.int32)))
                each = table.take(pa.array(codes))
                at = np.concatenate([[0], np.cumsum(n[codes])])[np.concatenate([[0], ends])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at), each.flatten())], ["doc_id", "ids"])

    return d.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text, malformed bytes U+FFFD."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        voc = vocabulary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([voc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every document."""
    return encode_digests(read(spark, sf_dir, "documents"))
