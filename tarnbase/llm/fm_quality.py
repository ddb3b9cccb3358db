"""Quality classifier: a factorisation machine over hashed words and the text's structure.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of rank
`FACTORS` in time linear in the text's distinct words. Inputs are the words (hashed, L2-normalised counts) and structure metadata of the
text (lengths, symbol, case, digit and line ratios); never labels, lang, source or doc_id.

Trained on the driver from at most `SAMPLE_ROWS` labelled rows (the documented bound; the rows with the smallest hash of their id), whose features
executors extract from whole texts. The model is `2 ** HASH_BITS * (FACTORS + 1)` floats, fixed, so sending it to every task is bounded.

Defined cases: a null text counts as empty and gets a score from the structure inputs; without labels every score is 0.5;
repeated labels of a document count as the largest; null labels and ids are ignored in training; an empty table gives an empty table;
other columns may have any name (they are not read).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_BITS = 14
FACTORS = 8
SAMPLE_ROWS = 6000
EPOCHS = 8
BATCH = 64
FOLDS = 5
CACHE_WORDS = 200_000
_SYMBOLS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_STRUCTURE = 12


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Numbers in about [0, 1] that describe the text's shape."""
    n, size = len(words), max(1, len(raw))
    m = max(1, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rare = raw.translate(None, b"#*$%&|<>")
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(raw.translate(None, b"0123456789"))
    symbols = size - len(raw.translate(None, _SYMBOLS))
    pairs = len(set(zip(words, words[1:])))
    return [
        1.0, min(1.0, np.log1p(n) / 10), min(1.0, sum(map(len, words)) / m / 20), min(1.0, (len(raw) - len(rare)) / m), min(1.0, 5 * upper / size),
        min(1.0, 10 * digits / size), min(1.0, 5 * symbols / size), len(counts) / m if n else 0.0, pairs / max(1, n - 1) if n > 1 else 0.0,
        len(set(lines)) / max(1, len(lines)), min(1.0, len(lines) / m), min(1.0, counts.most_common(1)[0][1] / m) if n else 0.0,
    ]


class Features:
    """Sparse inputs of a text: (indices, values). Words first, then the structure block."""

    def __init__(self, bits: int = HASH_BITS):
        self.size, self.cache = 1 << bits, {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        counts = Counter(words)
        cache, size = self.cache, self.size
        if len(cache) > CACHE_WORDS:
            cache.clear()
        index = []
        for w in counts:
            i = cache.get(w)
            if i is None:
                i = cache[w] = zlib.crc32(w.lower()) % size
            index.append(i)
        values = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        values /= max(1e-9, float(np.sqrt((values * values).sum())))
        shape = np.array(structure(raw, words, counts))
        return np.concatenate([np.array(index, np.int64), self.size + np.arange(_STRUCTURE)]), np.concatenate([values, shape])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid of concatenated rows; `starts` has the first place of each (no row is empty)."""
        vx = self.factors[index] * values[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[index] * values, starts) + 0.5 * (total * total - squares).sum(axis=1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        z = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = HASH_BITS, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, Adagrad, mini-batches; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    size = (1 << bits) + _STRUCTURE
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, factors)))
    if not len(rows):
        return m
    gw, gv, gb, rate, decay = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2, 0.15, 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            y = labels[order[at : at + BATCH]]
            lengths = np.array([len(i) for i, _ in part])
            index, values = np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part])
            starts = np.cumsum(np.r_[0, lengths[:-1]])
            p = 1 / (1 + np.exp(-np.clip(m.raw(index, values, starts), -30, 30)))
            err = np.repeat((p - y) / len(part), lengths)
            vx = m.factors[index] * values[:, None]
            total = np.repeat(np.add.reduceat(vx, starts, axis=0), lengths, axis=0)
            used, back = np.unique(index, return_inverse=True)
            dw = np.bincount(back, err * values, len(used)) + decay * m.linear[used]
            dv = (err * values)[:, None] * (total - vx)
            dv = np.stack([np.bincount(back, dv[:, f], len(used)) for f in range(factors)], axis=1) + decay * m.factors[used]
            db = float((p - y).mean())
            gb += db * db
            m.bias -= rate * db / gb**0.5
            gw[used] += dw * dw
            m.linear[used] -= rate * dw / np.sqrt(gw[used])
            gv[used] += dv * dv
            m.factors[used] -= rate * dv / np.sqrt(gv[used])
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def held_out(doc_id: str = "doc_id"):
    """True for the fold that training never sees; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> tuple[list, np.ndarray]:
    """Features and labels of at most `most` labelled documents outside the held-out fold."""
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("__y"))
    picked = picked.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "__id")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))  # at most `most` ids
    # One text of each id, so that no more rows than ids come to the driver; of several rows with one id, the first in text order.
    texts = texts.groupBy("doc_id", "__y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            found = [features.of(t.as_py()) for t in b.column(1)]
            arrays = [b.column(0), b.column(2), pa.array([i.astype(np.int32) for i, _ in found], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "y", "i", "v"])

    table = texts.select("doc_id", "text", F.col("__y").cast("int")).mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, y int, i array<int>, v array<float>").toArrow()
    ids = table.column("id").to_pylist()
    rows = [(np.asarray(i.values, np.int64), np.asarray(v.values, np.float64)) for i, v in zip(table.column("i"), table.column("v"))]
    order = sorted(range(len(rows)), key=lambda k: (ids[k], rows[k][0].tobytes(), rows[k][1].tobytes()))[:most]
    y = np.array(table.column("y").to_pylist(), float)
    return [rows[k] for k in order], y[order] if len(order) else np.zeros(0)


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, score) for every row."""
    rows, y = training_rows(docs, labels, most)
    machine = train(rows, y) if len(rows) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            scores, part = [], []
            for t in b.column(1):
                part.append(features.of(t.as_py()))
                if len(part) == 256:
                    scores.append(machine.score(part) if machine else np.full(len(part), 0.5))
                    part = []
            scores.append(machine.score(part) if machine else np.full(len(part), 0.5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores).astype(np.float64))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
