import random

import pytest

# names that clash with columns the operators make
EXTRA = ("kept", "n_words", "digest", "row", "slice", "key")


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empties, copies, near copies, long words and repeated rows."""
    rng = random.Random(11)
    words = ["the", "of", "and", "é", "Über", "naïve", "x1", "don't", "日本", "ab", "cd", "ef", "gh", "Ij"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(n))
    base = make(80)
    near = base.split()
    near[40] = "changed"
    out = [None, "", " \t\n", "one", "one two", "one  two ", "ONE two", base, base, base.upper(), base + "  ", " ".join(near),
           " ".join(near[:70]), make(300), make(3), "a" * 9000, "<|endoftext|> x", "\x1c\x85 ‡ y", "Orre " * 500]
    out += [make(rng.randint(1, 60)) for _ in range(30)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    """The texts as a table scan with columns of clashing names, a null id and a repeated row."""
    rows = [(i, t, *("z" for _ in EXTRA)) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", *("z" for _ in EXTRA)), rows[7], rows[20]]
    path = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
