"""Cross-tokenizer alignment as an Arrow pipeline (operator 11).

Each slice of documents is encoded by both tokenizers.  The id lists are flattened, every token knows its document
by parent index, and the running sum of token lengths, restarted at each document, is where the token ends.  A full
outer hash join of both sides on (document, end) lists every place where a token of either side ends; in order, each
such place closes exactly one pair of overlapping tokens, namely the next tokens of either side that end there or
later, and places where both end close a group.  So links come from one join and one backward fill, not from pairs of
tokens.

A slice counts its distinct id pairs with ``group_by``; Spark adds those partial counts up over the corpus, finds every
B id's highest count, and sends each slice the totals of its own pairs, which its documents look up by code.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.bpe import byte_letters
from siltmark.llm.sharing import read, shared_folder, text_or_empty
from siltmark.llm.sliced import Names, in_code_order, packed_lists, unpacked_lists
from siltmark.llm.textarrays import flat, slices

MARK = "▁"
SIDE = 32  # bits of a B id in a pair
SEPARATORS = "", ",", "|", ";"


class Tokenizers:
    """Both vocabularies: token bytes and lengths by id, and the libraries that encode."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        entry = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        n = max(entry) + 1
        bytes_a = [special[i] if i in special else bytes(letters[c] for c in entry.get(i, "")) for i in range(n)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.bytes = [pa.array(x, pa.large_binary()) for x in (bytes_a, bytes_b)]
        self.lengths = [pc.binary_length(x) for x in self.bytes]
        self.kinds = max(len(bytes_a), len(bytes_b))
        self.labels = pa.array([s + str(i) for s in SEPARATORS for i in range(self.kinds)], pa.large_string())

    def encoded(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + t if t else "" for t in texts], add_special_tokens=False)]
        return pa.array(a, pa.list_(pa.int32())), pa.array(self.b.encode(texts, num_threads=1), pa.list_(pa.int32()))


def joined_bytes(tokens: pa.Array) -> np.ndarray:
    """All token bytes one after another."""
    _, offsets, data = tokens.buffers()
    off = np.frombuffer(offsets, np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(tokens) else np.empty(0, np.uint8)


def token_table(ids: pa.Array, lengths: pa.Array, spell: pa.Array, expected: np.ndarray, offsets: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """``doc, end, id`` of every token, and which documents' tokens spell the expected bytes."""
    flat_ids, doc = ids.flatten(), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(lengths.take(flat_ids).cast(pa.int64()))
    stops = np.concatenate([[0], running.to_numpy()])[np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int64)]
    end = pc.subtract(running, pa.array(stops[:-1]).take(doc))
    found = joined_bytes(spell.take(flat_ids))
    right = np.diff(stops) == np.diff(offsets)
    if not right.all() or not np.array_equal(found, expected):
        for d in np.flatnonzero(right):
            right[d] = np.array_equal(found[stops[d]:stops[d + 1]], expected[offsets[d]:offsets[d + 1]])
    return pa.table({"doc": doc, "end": end, "id": flat_ids}), right


def aligned(texts: pa.Array, tools: Tokenizers) -> tuple[pa.Table, np.ndarray, pa.Table]:
    """Of one slice: a row per document, the code of every link in order, and the distinct pairs ``a, b, n`` by code."""
    plain = texts.to_pylist()
    a, b = tools.encoded(plain)
    spaced = pc.binary_join_element_wise(pa.array(["" if not t else " " for t in plain], pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    expected, offsets = flat(spaced)
    sides, good = zip(*(token_table(ids, tools.lengths[k], tools.bytes[k], expected, offsets) for k, ids in enumerate((a, b))), strict=True)
    good = pa.array(good[0] & good[1])
    sides = [t.filter(good.take(t.column("doc").combine_chunks())) for t in sides]

    ends = sides[0].rename_columns(["doc", "end", "a"]).join(sides[1].rename_columns(["doc", "end", "b"]), ["doc", "end"], join_type="full outer", use_threads=False)
    ends = ends.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    on_a, on_b = (ends.column(c).is_valid().to_numpy() for c in "ab")
    common = on_a & on_b
    group = np.cumsum(common) - common
    doc = ends.column("doc").to_numpy()
    links = pa.table({"a": pc.fill_null_backward(ends.column("a")), "b": pc.fill_null_backward(ends.column("b"))})

    counts = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
    pairs = pa.table({"a": counts.column("a"), "b": counts.column("b"), "n": counts.column("count_all")}).combine_chunks()
    codes = pc.index_in(pair_key(links), value_set=pair_key(pairs).combine_chunks()).to_numpy()

    n_docs = len(texts)
    per_doc = lambda where: np.bincount(doc[where], minlength=n_docs)
    n_links = np.bincount(doc, minlength=n_docs)
    rows = pa.table({"n_a": per_doc(on_a), "n_b": per_doc(on_b), "n_groups": per_doc(common), "n_links": n_links,
                     "groups_sha256": pa.array(group_hashes(ends, on_a, on_b, group, doc, n_docs, tools), pa.string())})
    return rows, codes, pairs


def pair_key(t: pa.Table) -> pa.ChunkedArray:
    return pc.bit_wise_or(pc.shift_left(t.column("a").cast(pa.int64()), SIDE), t.column("b").cast(pa.int64()))


def group_hashes(ends: pa.Table, on_a: np.ndarray, on_b: np.ndarray, group: np.ndarray, doc: np.ndarray, n_docs: int, tools: Tokenizers) -> list[str]:
    """SHA-256 of each document's groups as text; '' without tokens."""
    ids = np.concatenate([ends.column("a").drop_null().to_numpy(), ends.column("b").drop_null().to_numpy()])
    side = np.repeat([0, 1], [on_a.sum(), on_b.sum()])
    of, owner = np.concatenate([group[on_a], group[on_b]]), np.concatenate([doc[on_a], doc[on_b]])
    order = np.argsort(of * 2 + side, kind="stable")
    ids, side, of, owner = ids[order], side[order], of[order], owner[order]
    fresh = np.append(True, owner[1:] != owner[:-1])[:len(ids)]
    mark = np.ones(len(ids), np.int64)
    mark[1:][side[1:] != side[:-1]] = 2
    mark[1:][of[1:] != of[:-1]] = 3
    mark[fresh] = 0
    data, offsets = flat(tools.labels.take(pa.array(mark * tools.kinds + ids)))
    data = np.ascontiguousarray(data).data
    stops = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_docs))])
    return [hashlib.sha256(data[offsets[s]:offsets[e]]).hexdigest() if e > s else "" for s, e in zip(stops[:-1], stops[1:], strict=True)]


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


_LOADED: dict[tuple[str, str] | None, Tokenizers] = {}


def tokenizers(paths: tuple[str, str] | None) -> Tokenizers:
    """The vocabularies of ``paths``, read once in each worker process; without paths the public ones, where the worker has them."""
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*(paths or default_paths()))
    return _LOADED[paths]


def slice_alignments(d: DataFrame, paths: tuple[str, str] | None) -> DataFrame:
    """Rows of documents (``n`` null) and of id pairs (``doc_id`` and all counts null) of every slice of ``doc_id, text``."""
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tools, name = tokenizers(paths), Names()
        for batch in batches:
            _, offsets = flat(batch.column(1))
            id_kind = batch.column(0).type
            for i, j in slices(offsets):
                k, at = j - i, name()
                rows, codes, pairs = aligned(batch.column(1).slice(i, k), tools)
                m = len(pairs)
                links = packed_lists(codes, np.cumsum(rows.column("n_links").to_numpy()), m)
                none = lambda count, t: pa.nulls(count, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, at)), batch.column(0).slice(i, k), *(c.combine_chunks().cast(pa.int64()) for c in rows.columns[:4]), rows.column("groups_sha256").combine_chunks(),
                     links, *(none(k, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], NAMES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, at)), none(m, id_kind), *(none(m, pa.int64()) for _ in range(4)), none(m, pa.string()), none(m, pa.binary()),
                     pa.array(np.arange(m), pa.int32()), pairs.column("a").combine_chunks(), pairs.column("b").combine_chunks(), pairs.column("n").combine_chunks()], NAMES)

    return d.mapInArrow(run, f"slice long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, code int, a int, b int, n long")


NAMES = ["slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "code", "a", "b", "n"]


def pair_totals(pairs: DataFrame) -> DataFrame:
    """``a, b, total, best`` of every id pair: its links corpus-wide, and whether no A id has more with that B id."""
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))


def align(docs: DataFrame, paths: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens on both sides, groups, links, and how its links fare corpus-wide.

    A null or empty text, and one whose tokens do not spell a space and the text, has no tokens: zeros and ''.  Repeated
    rows count as often as they occur; a null id stays null; other columns are not read; no rows in, no rows out.
    Documents are encoded once; what a slice found is written to the shared folder and read from there.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    found = slice_alignments(d, paths)
    folder = shared_folder(docs.sparkSession, "alignment")
    found.write.parquet(folder)
    stored = lambda: docs.sparkSession.read.schema(found.schema).parquet(folder)
    pairs = stored().filter("n IS NOT NULL").select("slice", "code", "a", "b", "n")
    answers = pairs.join(pair_totals(pairs), ["a", "b"]).select("slice", "code", "total", "best")
    rows = stored().filter("n IS NULL").select(*NAMES[:8])

    def look_up(rows, answers):
        answers = in_code_order(answers)
        codes, sizes = unpacked_lists(rows.column("links"), len(answers))
        ends = np.cumsum(sizes)
        sums = lambda v: np.concatenate([[0], np.cumsum(v[codes].astype(np.int64))])
        best, total = (sums(answers.column(c).to_numpy()) for c in ("best", "total"))
        out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(best[ends] - best[ends - sizes])).append_column("count_sum", pa.array(total[ends] - total[ends - sizes]))
        return out.append_column("groups_sha256", rows.column("groups_sha256"))

    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(
        look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of both public tokenizers over every document."""
    return align(read(spark, sf_dir, "documents"))
