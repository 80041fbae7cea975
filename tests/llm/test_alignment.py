"""Alignment of two tokenizers, SentencePiece ids, embedding whitening."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest

from siltmark.llm import alignment, pieces, whitening
from siltmark.llm.bpe import byte_letters


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(r):
    return (r[0] is None, *r)


@pytest.fixture(scope="module")
def model():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def test_pieces_match_the_library_on_whole_tables(docs, rows, none, model):
    want = []
    for i, x in rows:
        ids = model.encode(x or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    assert sorted(map(tuple, pieces.encode_digests(docs).collect()), key=key) == sorted(want, key=key)
    assert pieces.encode_digests(none).count() == 0
    back = pieces.decode_ids(pieces.encode_ids(docs))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((i, model.decode(model.encode(x or ""))) for i, x in rows), key=key)


def test_pieces_match_the_library_on_hostile_texts(model):
    voc, rng = pieces.vocabulary(None), random.Random(3)
    letters = " ▁\n\tabcdeéTh日本語#01 \U0001f600<>/sn't\x00\x7f"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(1500)]
    texts += [" " * 1000 + "x", "a" * 5000, "the " * 300, "日本" * 400, "▁▁", "\n" * 300, "<0x41> <s> </s>"]
    for t in texts:
        assert voc.encode(t) == model.encode(t), t
        assert voc.decode(model.encode(t)) == model.decode(model.encode(t)), t


def test_words_are_cut_at_markers_and_listed_once():
    import pyarrow as pa
    voc = pieces.vocabulary(None)
    words, codes, ends = voc.chunks(*pieces.flat(voc.marked(pa.array(["the cat the cat", None, "", "the\n\ndog  x "]))))
    assert words.to_pylist() == [" the", " cat", "\n\n", "dog", "  x", " "]
    assert codes.tolist() == [0, 1, 0, 1, 0, 2, 3, 4, 5] and ends.tolist() == [4, 4, 4, 9]


def test_incomplete_answers_fail():
    import pyarrow as pa
    from siltmark.llm.sliced import in_code_order
    with pytest.raises(ValueError):
        in_code_order(pa.table({"code": pa.array([0, 2], pa.int32())}))


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    path_a, path_b = alignment.default_paths()
    a_lib, b_lib = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a_lib.encode_special_tokens = True
    letters = byte_letters()
    a_bytes = {i: t.encode() if t.startswith("<|") else bytes(letters[c] for c in t) for t, i in a_lib.get_vocab().items()}

    def b_bytes(i):
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    spans = lambda ids, f: [(sum(len(f(x)) for x in ids[:k]), sum(len(f(x)) for x in ids[:k + 1])) for k in range(len(ids))]
    seen, out = collections.Counter(), []
    for i, text in rows:
        a, b = ([], []) if not text else (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text))
        whole = (" " + (text or "")).encode()
        if b"".join(map(a_bytes.get, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        sa, sb = spans(a, a_bytes.get), spans(b, b_bytes)
        links = [(x, y) for x, (s, e) in zip(a, sa) for y, (t, f) in zip(b, sb) if max(s, t) < min(e, f)]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = [(",".join(str(x) for x, (_, e) in zip(a, sa) if lo < e <= hi) + "|" + ",".join(str(y) for y, (_, e) in zip(b, sb) if lo < e <= hi))
                  for lo, hi in zip([0, *cuts], cuts)]
        seen.update(links)
        out.append((i, len(a), len(b), len(groups), links, sha(";".join(groups)) if groups else ""))
    most = collections.Counter()
    for (_, y), n in seen.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, ng, len(li), sum(seen[p] == most[p[1]] for p in li), sum(seen[p] for p in li), h) for i, na, nb, ng, li, h in out]


def test_alignment_matches_brute_force(spark, rows, docs, none, tmp_path):
    short = [(i, x if x is None or len(x) < 600 else x[:600]) for i, x in rows] + [(900, "a ▁ b"), (901, "x <|endoftext|> <s> y"), (902, "\U0001f600 ‡‡"), (903, "naïve")]
    path = str(tmp_path / "short")
    spark.createDataFrame([(i, t, "z", "z") for i, t in short], "doc_id long, text string, n long, code string".replace("n long", "n string")).repartition(3).write.parquet(path)
    got = alignment.align(spark.read.parquet(path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_alignment(short), key=key)
    assert alignment.align(none).count() == 0


def test_links_count_both_sides(docs, rows):
    for r in alignment.align(docs).collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups


def embeddings(spark, path, vectors):
    spark.createDataFrame([(i, v, "z") for i, v in vectors], "vec_id long, embedding array<float>, n string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_whitening_matches_a_dense_solver(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 10)) * np.arange(1, 11) / 20
    vectors = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    bad = [(1000, None), (1001, [math.nan] * 10), (1002, [None, *[0.5] * 9]), (1003, [math.inf] * 10), (1004, []), (1005, [0.5] * 3)]
    vectors += [(None, vectors[0][1]), vectors[7], vectors[7]]
    got = whitening.whiten(embeddings(spark, str(tmp_path / "e"), vectors + bad)).toPandas()
    z = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(z), z.sum(axis=0)
    assert len(got) == 8 * n and (got.n == n).all() and sorted(got.component.unique()) == list(range(1, 9))
    y = z - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    exact = collections.Counter(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in z)
    assert collections.Counter(got[got.component == 1].deviation) == exact
    white = y @ axes / np.sqrt(values)
    for k in range(8):
        mine = got[got.component == k + 1]
        assert np.allclose(mine.explained, values[k] / np.trace(y.T @ y / n), rtol=1e-10)
        assert np.allclose(np.sort(np.abs(mine.whitened)), np.sort(np.abs(white[:, k])), atol=1e-8)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_little(spark, tmp_path):
    only_bad = embeddings(spark, str(tmp_path / "bad"), [(1, None), (2, [math.nan]), (3, [])])
    assert whitening.whiten(only_bad).count() == 0
    assert whitening.whiten(only_bad).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    # equal vectors have no direction to whiten; two vectors have one
    assert whitening.whiten(embeddings(spark, str(tmp_path / "one"), [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    two = whitening.whiten(embeddings(spark, str(tmp_path / "two"), [(1, [0.0, 1.0]), (2, [1.0, 0.0])])).collect()
    assert sorted(round(abs(r.whitened), 9) for r in two) == [1.0, 1.0] and abs(two[0].explained - 1) < 1e-12
    huge = whitening.whiten(embeddings(spark, str(tmp_path / "huge"), [(1, [1e12, 1.0]), (2, [-1e12, 0.0]), (3, [0.0, 0.0]), (4, [1e30, 0.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and {r.deviation for r in huge if r.vec_id != 3} == {None}


@pytest.mark.parametrize("spectrum", [[5, 5, 5, 2, 1, 0], [0] * 6, [9, 9, 9, 7, 7 - 1e-13, 5, 4, 4, 1, 1, 1], [3], [1e-300] * 3, [4, 0, 0], list(range(1, 31))])
def test_leading_eigenpairs_are_counted_right(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    v = q @ np.diag(np.array(spectrum, float)) @ q.T
    v = (v + v.T) / 2
    values, axes = whitening.leading(v, 8)
    want = np.sort(np.array(spectrum, float))[::-1][:8]
    scale = max(want.max(), 1e-300)
    assert np.allclose(values / scale, want / scale, atol=1e-12)
    assert np.allclose(axes @ axes.T, np.eye(len(values)), atol=1e-9)
    assert np.allclose(v @ axes.T / scale, axes.T * (values / scale), atol=1e-10)


def test_inertia_counts_indefinite_matrices():
    rng = np.random.default_rng(9)
    for d in (1, 2, 3, 7, 20):
        for _ in range(20):
            v = rng.normal(size=(d, d))
            v = np.triu(v, 1) + np.triu(v, 1).T  # no diagonal to start from
            shift = rng.normal() / 3
            assert whitening.count_above(v, shift) == (np.linalg.eigvalsh(v) > shift).sum()
