"""Quality by compression (operator 5).

Two zstandard dictionaries are trained, one on good and one on bad labelled text.  A text is compressed in
windows with either; the normalised difference of the compressed sizes says which kind it resembles.  A logistic
curve, fitted on labelled rows the dictionaries have not seen, turns it into a probability; it also sees how
well the text compresses at all, which tells repetition.

Only a bounded, documented number of labelled rows is used (``ROWS_PER_CLASS`` for dictionaries and as many for
the curve, ``WINDOWS_PER_CLASS`` windows of ``WINDOW`` bytes), chosen by the hash of the id.  Scores read whole texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import id_bucket, read, stable, text_or_empty

FOLDS, HELD_OUT = 3, 1
ROWS_PER_CLASS = 2000
WINDOWS_PER_CLASS = 4000
WINDOW = 1024
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


class SizeModel:
    """Dictionaries and the calibrated curve; small enough to ship with every task."""

    def __init__(self, good: bytes, bad: bytes, share: float, weights=None, mean=None, scale=None):
        self.good, self.bad, self.share = good, bad, share
        self.weights, self.mean, self.scale = weights, mean, scale
        self.ready = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def compressors(self):
        if self.ready is None:
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.ready = *made, zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)
        return self.ready

    def features(self, data: bytes) -> tuple[float, float, float]:
        """Normalised size difference (bad - good), window size over raw size, whole size over raw size."""
        if not data:
            return 0.0, 0.0, 0.0
        good, bad, plain = self.compressors()
        g = b = 0
        for i in range(0, len(data), WINDOW):
            part = data[i:i + WINDOW]
            g += len(good.compress(part))
            b += len(bad.compress(part))
        return (b - g) / (b + g), min(g, b) / len(data), len(plain.compress(data)) / len(data)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> None:
        """Newton steps of a logistic regression on standardised features."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (p - y) + ridge * len(x) * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, text: str | None) -> float:
        data = (text or "").encode()
        if not data or self.weights is None:
            return self.share
        z = (np.array(self.features(data)) - self.mean) / self.scale
        v = float(z @ self.weights[:-1] + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> SizeModel:
    """Model from labelled rows outside the held-out fold; ids with several or null labels, and null ids, teach nothing.

    Without rows of both classes every score is the share of label 1, or 0.5 without labels.
    """
    known = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"),
                                                        F.count(F.lit(1)).alias("n"), F.count(label_col).alias("k"))
    known = known.filter("id IS NOT NULL AND n = k AND y = y2 AND y IN (0, 1)").filter(id_bucket("id", FOLDS) != HELD_OUT)
    known = stable(known.select("id", "y", F.xxhash64("id").alias("h")))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return SizeModel(b"", b"", share)
    picked = None
    for y in (0, 1):
        p = known.filter(F.col("y") == y).orderBy("h", "id").limit(2 * ROWS_PER_CLASS)
        picked = p if picked is None else picked.union(p)
    picked = stable(picked)  # at most 4 * ROWS_PER_CLASS narrow rows
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked), "id")
    rows = stable(rows.filter("text <> ''").select("id", "text", "y", (F.pmod("h", F.lit(2))).alias("part")))

    def windows(batches):
        for b in batches:
            out = ([], [], [])
            for i, t, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = t.encode()
                for k in range(0, len(data), WINDOW):
                    out[0].append(f"{i}:{k}")
                    out[1].append(data[k:k + WINDOW])
                    out[2].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["at", "data", "y"])

    cut = rows.filter("part = 0").select("id", "text", F.col("y").cast("int").alias("y")).mapInArrow(windows, "at string, data binary, y int")
    samples = []
    for y in (1, 0):
        top = cut.filter(F.col("y") == y).orderBy(F.xxhash64("at"), "at").limit(WINDOWS_PER_CLASS).select("data").collect()
        samples.append([bytes(r.data) for r in top])
    model = SizeModel(*map(dictionary, samples), share)

    def measure(batches):
        for b in batches:
            f = [model.features(t.encode()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in f], pa.float64()) for k in range(3)), b.column(1)], ["a", "b", "c", "y"])

    got = rows.filter("part = 1").select("text", F.col("y").cast("int").alias("y")).mapInArrow(measure, "a double, b double, c double, y int").collect()
    y = np.array([r.y for r in got], float)
    if len(set(y.tolist())) == 2:
        # rows are drawn evenly by class; their weight in the curve follows the true shares
        x = np.array([(r.a, r.b, r.c) for r in got])
        order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))
        model.fit(x[order], y[order])
        drawn = y.mean()
        model.weights[-1] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    return model


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; a plain content dictionary where there is too little text to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def score_quality(docs: DataFrame, model: SizeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.  An empty or null text gets the share of label 1; a null id is not held out."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.score(t) for t in b.column(2).to_pylist()], pa.float64())],
                                             ["doc_id", "held_out", "score"])

    d = docs.select(F.col(id_col).alias("doc_id"), (id_bucket(id_col, FOLDS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: SizeModel, text_col: str = "text") -> DataFrame:
    """The rows the model predicts as good, all columns as they came."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t) >= 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    d = docs.toDF(*names)
    return d.mapInArrow(run, d.schema).toDF(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document from labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, read(spark, sf_dir, "labels")))
