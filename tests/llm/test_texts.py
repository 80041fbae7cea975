"""Tokens, decontamination, language model, quality, personal data."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siltmark.llm import bpe, decontamination, personal_data, ppm, quality


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(r):
    return (r[0] is None, *r)


def test_tokens_match_the_library(docs, rows, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_path())
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.encode_digests(docs).collect()), key=key) == sorted(want, key=key)
    assert bpe.encode_digests(none).count() == 0
    back = bpe.decode_ids(bpe.encode_ids(docs))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(((i, x or "") for i, x in rows), key=key)


def test_words_match_the_library_on_hostile_texts(monkeypatch):
    from tokenizers import Tokenizer
    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.transducer(bpe.default_path())
    rng = random.Random(2)
    letters = " \n\t\r''abdlmrstvLE12é日本\u00a0\u3000٣½²\U0001f600.,!_-\x00\x1c\x85" + "a" * 4
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 30, 150]))) for _ in range(3000)]
    texts += ["a<|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y", "'s", "don't", " 's", "''s's", "'tis 'T 'll'", "x\n's", "  ", "a  ", "\n a"]
    for segment in (1 << 20, 7):
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        for t in texts:
            assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, (segment, t)


def test_slice_of_texts_takes_few_bytes_a_byte():
    own, rng = bpe.transducer(bpe.default_path()), random.Random(3)
    words = [rng.choice(["the", "of", "naïve", "x1", "日本"]) + str(k) for k in range(500)]
    texts = [" ".join(rng.choices(words, k=500)) + rng.choice(["", "<|endoftext|>"]) for _ in range(2000)]
    alone = [next(own.digests([t])) for t in texts[:40]]
    tracemalloc.start()
    try:
        held = pa.total_allocated_bytes()
        got = own.digests(texts)
        first = [next(got) for _ in range(40)]
        most = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held
    finally:
        tracemalloc.stop()
    assert first == alone
    assert most < 12 * sum(len(t.encode()) for t in texts)


def test_long_words_stream(monkeypatch):
    from tokenizers import Tokenizer
    lib, own = Tokenizer.from_file(bpe.default_path()), bpe.transducer(bpe.default_path())
    monkeypatch.setattr(own, "window", 2048)
    rng = random.Random(5)
    for alphabet in ("ab", "theinr", "aeiounth", "=-", "日本語"):
        x = "".join(rng.choice(alphabet) for _ in range(3 * own.window + 7))
        assert list(own.encode(x)) == lib.encode(x, add_special_tokens=False).ids
    assert own.lookahead < own.window / 2


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([]) == 0
    # b is consumed by bc before ab can form: one byte to the right matters; with cd earlier still, two do
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 1 + 1
    assert bpe.sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3


def test_decoder_is_incremental():
    raw = "é日".encode()
    assert list(bpe.decoded([raw[:1], raw[1:3], raw[3:]])) == ["é", "日"]
    assert "".join(bpe.decoded([b"\xff", b"a"])) == "�a"


def decontamination_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def same_words(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def longest_in(doc, items, window=decontamination.WINDOW):
    """Longest match of a document with any item that holds a window, and its earliest place."""
    best = (0, None)
    for p in range(len(doc)):
        for x in items:
            for t in range(len(x)):
                n = same_words(doc[p:], x[t:])
                if n > best[0] and n >= min(len(x), window):
                    best = (n, p)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_against_brute_force(seed):
    rng = random.Random(seed)
    kinds, window = rng.choice([2, 3, 8]), rng.choice([2, 3, 5])
    make = lambda n: [rng.choice("abcdefgh"[:kinds]) for _ in range(n)]
    docs, items = [make(rng.randint(0, 40)) for _ in range(6)], [make(rng.randint(0, 14)) for _ in range(5)]
    if seed % 3 == 0:
        docs[2], items[1] = ["a"] * 40, ["a"] * 30  # one word over and over
        docs[4] = docs[4] + ["z"] + items[2]
    block = decontamination.TestBlock([(str(k), " ".join(x)) for k, x in enumerate(items)], window)
    data = [" ".join(d).encode() for d in docs]
    offsets = np.cumsum([0, *map(len, data)])
    shard = decontamination.Shard(np.frombuffer(b"".join(data), np.uint8), offsets, block)
    begun = shard.begun(block)
    head = np.cumsum([0, *map(len, docs)])
    place, size = shard.longest_by_place(block, begun)
    for k, d in enumerate(docs):
        mine = sorted((-n, p - head[k]) for p, n in zip(place.tolist(), size.tolist(), strict=True) if head[k] <= p < head[k + 1])
        assert (((-mine[0][0], mine[0][1]) if mine else (0, None))) == longest_in(d, items, window)
    want = {}
    at = 0
    for x in items:
        for t in range(len(x)):
            if len(x) - t >= min(window, len(x)):
                best = max(((same_words(d[p:], x[t:]), -int(head[k]) - p) for k, d in enumerate(docs) for p in range(len(d))), default=(0, 0))
                if best[0] >= min(window, len(x)):
                    want[at + t] = (-best[1], best[0])
        at += len(x)
    t, p, n = shard.longest(block)
    assert dict(zip(t.tolist(), zip(p.tolist(), n.tolist(), strict=True), strict=True)) == want
    doc, which = shard.documents(block)
    got = {(int(a), int(o)) for a, w in zip(doc, which, strict=True) for o in block.item_of[block.items_from[w]:block.items_from[w + 1]]}
    gram = lambda x, n: {tuple(x[k:k + n]) for k in range(len(x) - n + 1)}
    assert got == {(k, o) for k, d in enumerate(docs) for o, x in enumerate(items) if x and gram(d, min(window, len(x))) & gram(x, min(window, len(x)))}


def test_one_word_over_and_over_is_not_listed():
    item, text = " ".join(["same"] * 2000), " ".join(["same"] * 20000)
    block = decontamination.TestBlock([("q", item)])
    raw = np.frombuffer(text.encode(), np.uint8)
    shard = decontamination.Shard(raw, np.array([0, len(raw)]), block)
    assert len(block.keys) == 1 and len(shard.documents(block)[0]) == 1
    assert [len(x) for x in shard.begun(block).values()] == [20000 - 12]
    assert max(shard.longest_by_place(block, shard.begun(block))[1]) == 2000


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, docs, rows, none, block):
    words = next(t for i, t in rows if i == 13).split()
    items = [(1, " ".join(words[40:70])), (2, " ".join(words[10:20])), (3, None), (4, ""), (5, "no such words here"), (2, " ".join(words[100:120])),
             (10, "one"), (6, ", ".join(words[200:213]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, *x) for (i, _), x in zip(rows, decontamination.brute_force([t for _, t in rows], items), strict=True)]
    got = decontamination.contamination(docs, bench, block_bytes=block)
    assert sorted(map(tuple, got.drop("longest", "longest_at").collect()), key=key) == sorted(want, key=key)
    split = decontamination_words
    lengths = [(i, *longest_in(split(t), [split(x) for _, x in items])) for i, t in rows]
    assert sorted(map(tuple, got.select("doc_id", "longest", "longest_at").collect()), key=key) == sorted(lengths, key=key)
    clean = decontamination.decontaminate(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontamination.contamination(none, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0


def test_longest_matches(spark, docs, rows):
    words = next(t for i, t in rows if i == 13).split()
    bench = spark.createDataFrame([("q", "unseen " + " ".join(words[50:90]) + " unseen")], "item_id string, text string")
    got = decontamination.longest_matches(docs, bench).filter("item_word = 1").first()
    size = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ".join(words[50:90]).lower()))
    assert (got.n_words, got.doc_id) == (size, 13)


def ppm_brute(texts, train, order):
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    stream = lambda t: b"\n" * order + b"".join(w + b" " for w in split(t)) + b"\n"
    count = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t, learn in zip(texts, train, strict=True):
        s = stream(t)
        for i in range(order, len(s) if learn else 0):
            for j in range(order + 1):
                count[j][s[i - j:i]][s[i]] += 1
    words = collections.Counter(w for t, learn in zip(texts, train, strict=True) if learn for w in [*split(t), None])
    n, v = sum(words.values()), len(words)
    for t in texts:
        s, total = stream(t), 0.0
        for i in range(order, len(s)):
            out, coded = set(), False
            for j in range(order, -1, -1):
                seen = count[j].get(s[i - j:i])
                if not seen:
                    continue
                rest = {k: c for k, c in seen.items() if k not in out}
                if s[i] in rest:
                    total += math.log10((2 * rest[s[i]] - 1) / (2 * sum(rest.values())))
                    coded = True
                    break
                if rest:
                    total += math.log10(len(rest) / (2 * sum(rest.values())))
                out |= set(seen)
            if not coded:
                total -= math.log10(256 - len(count[0].get(b"", {})))
        w = [*split(t), None]
        yield len(w), sum(words[x] > 0 for x in w), n, sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w), total


def test_ppm_matches_brute_force(docs, rows, none):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    want = sorted(((i, h, *x) for (i, _), h, x in zip(rows, held, ppm_brute([t for _, t in rows], [not h for h in held], ppm.ORDER), strict=True)), key=key)
    got = sorted(map(tuple, ppm.score_documents(docs).collect()), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)
    assert ppm.score_documents(none).count() == 0


def test_ppm_beats_the_base(spark):
    r = ppm.op6_ppm(spark, "/root/testdata/sf0.1").filter("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert r[1] > r[0]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = quality.op5_quality(spark, sf).join(labels, "doc_id").filter("held_out").selectExpr("avg(int(predicted = quality))", "min(score)", "max(score)").first()
    assert r[0] > 0.95 and 0 <= r[1] <= r[2] <= 1


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model.weights is None and model.share in (1.0, 0.5)
    out = quality.score_quality(docs, model)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score_quality(none, model).count() == 0
    assert quality.train(none, labels).score("x") == model.share


def spans_brute(t):
    t, out = t or "", []
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and personal_data.luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rng = random.Random(1)
    for letters, n in (("a.@b1-+ 25(0é", 30), ("0123456789 -", 60), ("+1.(2) 3-", 40), ("a@.b", 20)):
        for _ in range(3000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
            assert personal_data.base_spans(t) == spans_brute(t), t


def test_personal_data_bootstraps(spark, docs, none):
    rng = random.Random(2)
    known = [f"mail {rng.choice('abc')}{k}.{k}@host{k}.example.org sent" for k in range(10, 40)]
    # same context and shape as the cards around it, but the check digit is wrong
    cards = []
    while len(cards) < 20:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if personal_data.luhn(d):
            cards.append(d)
    wrong = str(int(cards[0]) + 1)
    texts = known + [f"paid with card {c} today" for c in cards] + [f"paid with card {wrong} today", f"room {int(cards[1]) + 1} in plain text", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.personal_data(df).collect()}
    at = len(known) + len(cards)
    assert got[at].n_card == 0 and got[at].spans == "card:15:31"
    assert got[at + 1].spans == ""
    for i, t in enumerate(texts):
        base = spans_brute(t)
        text = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == sha(text)
        assert set(text.split(",")) - {""} <= set(got[i].spans.split(","))
    assert personal_data.personal_data(docs).count() == docs.count() and personal_data.personal_data(none).count() == 0


def test_personal_data_finds_other_shapes(spark):
    texts = [f"please call +1 ({200 + k}) 555-{1000 + 37 * k} today" for k in range(120)]
    texts += [f"write mail to a{k}@host{k}.example.org soon" for k in range(40)]
    # shapes that no seed has
    fresh = {"please call 555-0199 today": "phone:12:20", "please call 5550 1234 today": "phone:12:21", "please call 55501234 today": "phone:12:20",
             "please call: (743) 555-0100, today": "phone:13:27", "write mail to joe (at) example (dot) com soon": "email:14:40",
             "write mail to jo dot doe at example.org soon": "email:14:39"}
    texts += fresh
    # fifteen found numbers make a context known in which no seed stands
    texts += [f"please call 555-02{k}0 today" for k in range(10, 25)] + [f"ring bell 555-02{k}0 quickly" for k in range(10, 25)]
    fresh["ring bell 4444-1111 quickly"] = "phone:10:19"
    fresh["room 55501 is free, of 1234567 rooms"] = ""
    texts += [t for t in fresh if t not in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r for r in personal_data.personal_data(df).collect()}
    for t, spans in fresh.items():
        assert got[t].spans == spans and got[t].base_sha256 == sha(""), (t, got[t].spans)


def test_pieces_of_a_long_number():
    text = "9 " * 5000 + "a@ " * 5000 + "x at y " * 5000
    assert len(personal_data.other_pieces(text, [])) < 100_000
    found = [{"kind": 2, "begin": b, "stop": e, "p": p} for b, e, p in ((0, 9, 0.95), (0, 19, 0.99), (10, 19, 0.95), (30, 39, 0.91))]
    assert [(x["begin"], x["stop"]) for x in personal_data.apart(found)] == [(0, 19), (30, 39)]


def test_personal_data_has_no_greatest_length(spark):
    long = "x" * 300
    texts = [f"write mail to a{k}@host{k}.example.org soon" for k in range(40)] + [f"card{' ' * 200}4{k:03d} 0000 {k % 7}" for k in range(3)]
    texts += [f"{long} +1 ({200 + k}) 555-{1000 + 37 * k} {long}" for k in range(40)]
    fresh = {f"write mail to {'j' * 200}@host. soon": "email:14:219", f"write mail to {'j' * 200} (at) example.org soon": "email:14:231",
             f"{long} {'1234 ' * 10}{long}": "phone:301:350", f"{long}{' ' * 100}5550-1234{' ' * 500}{long}": "phone:400:409"}
    texts += fresh
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r.spans for r in personal_data.personal_data(df).collect()}
    assert {t: got[t] for t in fresh} == fresh


def bootstrap_brute(occ, support):
    edges = {}
    for value, whole, kind, pattern in occ:
        edges[pattern, value, whole] = max(kind, edges.get((pattern, value, whole), -1))
    met = collections.Counter(p for p, _, w in edges if w)
    edges = {e: k for e, k in edges.items() if met[e[0]] >= support}
    known = {}
    while True:
        conf = {}
        for p in {e[0] for e in edges}:
            weight, n, seen = [0.0] * 4, 0, 0
            for (q, v, w), k in edges.items():
                if q == p and w:
                    kind, sure = (k, 1.0) if k >= 0 else known.get((v, w), (-1, 0.0))
                    n += 1
                    if kind >= 0:
                        seen += 1
                        weight[kind] += sure
            if seen >= support and max(weight) / (n + 1) >= personal_data.MIN_PATTERN:
                conf[p] = (weight.index(max(weight)), max(weight) / (n + 1))
        doubt = collections.defaultdict(lambda: 1.0)
        for (p, v, w), k in edges.items():
            if k < 0 and p in conf:
                doubt[v, w, conf[p][0]] *= 1 - min(conf[p][1], 0.999)
        new = {}
        for (v, w, k), d in sorted(doubt.items(), key=lambda x: x[0][2]):
            if 1 - d >= personal_data.MIN_INSTANCE and (v, w) not in known and ((v, w) not in new or 1 - d > new[v, w][1]):
                new[v, w] = (k, 1 - d)
        if not new:
            return known
        known |= new


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_against_brute_force(spark, seed):
    rng = random.Random(seed)
    occ = []
    for v in range(400):
        kind = rng.choice([-1, -1, -1, 0, 3])
        home = rng.randrange(12)
        for _ in range(rng.randint(1, 4)):
            occ.append((f"v{v}", rng.random() < 0.9, kind if home < 6 or kind < 0 else home % 2 * 3, f"p{home if rng.random() < 0.95 else rng.randrange(20)}"))
    # a context of seeds tags u, whose own contexts then tag w
    occ += [(f"s{k}", True, k % 2 * 3, f"p{20 + k % 2}") for k in range(400)] + [(f"u{k}", True, -1, f"p{20 + k % 2}") for k in range(30)]
    occ += [(x, True, -1, p) for x in [*(f"u{k}" for k in range(0, 30, 2)), "w"] for p in ("p22", "p23")]
    got = personal_data.discovered(spark.createDataFrame(occ, "value string, whole boolean, kind int, pattern string"), 4)
    want = bootstrap_brute(occ, 4)
    assert {("u1", True), ("w", True)} <= want.keys()
    assert {(r.value, r.whole): (r.kind, round(r.p, 9)) for r in got.collect()} == {x: (k, round(p, 9)) for x, (k, p) in want.items()}


def test_ppm_counts_beyond_32_bits():
    keys = np.array([0x0A0A0A0A0A61, int(ppm.WORD_FLAG) + 7], np.uint64)
    per_slice = np.array([3, 2**31 - 1], np.int32)
    asked = pa.table({"slice": [0, 1, 2], "keys": pa.array([ppm.packed(keys)] * 2 + [ppm.packed(keys[1:])], pa.binary()),
                      "counts": pa.array([ppm.packed(per_slice)] * 2 + [ppm.packed(per_slice[1:])], pa.binary())})
    low = ppm.LowLevels(np.array([0x0A0A61]), np.array([6]))
    for k, n in ((0, 1), (2, 0)):
        (events, lengths), (words, counts) = ppm.gathered(ppm.answered(asked, low).slice(k, 1))
        assert len(events) == len(lengths) == n and words.tolist() == [keys[1]] and counts.tolist() == [3 * (2**31 - 1)]
