"""Quality classifier: supervised subword embeddings.

Each word and each character n-gram hashes to a row of an embedding table, and two
more rows stand for a word said again, at once or after one other; a document is the
average of its features' vectors, a softmax layer turns it into class probabilities, and
stochastic gradient descent in numpy trains both, a document a step. A step on the table
is divided by the norm of the document's shares, so long and short texts weigh alike. Rows
start at zero, so a feature never seen in training has no say.

Training uses at most SAMPLE labelled documents (the smallest hashes of doc_id);
a document's features are counts of at most ROWS rows, whatever its length, and come to
the driver packed: about two bytes for each of the rows it has, 0.3 MB at most.
Once trained, average and output layer are linear: a document's logit is the mean
of one number per feature, so scoring gathers and adds, batch by batch.

A null or empty text has no features and gets the bias alone; null labels are
dropped, repeated labels of a document are averaged; without any label of a class
every score is the share of label 1 (0.5 without labels). Extra columns are
ignored. A null doc_id is scored and counts as the empty text for the split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .spark import held_out

BUCKETS, GRAMS, DIM, SAMPLE = 1 << 16, (3, 4), 8, 3000
ROWS = 2 * BUCKETS + 2


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of a buffer's words and character n-grams, and their documents."""
    st, en, row = T.words(buf, off)
    h = T.span_hashes(buf, st, en)
    rows, docs = [(h % np.uint64(BUCKETS)).astype(np.int32)], [row]
    for k in (1, 2):  # a word said again, at once or after one other
        again = row[k:][(h[k:] == h[:-k]) & (row[k:] == row[:-k])]
        rows.append(np.full(len(again), 2 * BUCKETS + k - 1, np.int32))
        docs.append(again)
    for n in GRAMS:
        h, row = T.byte_ngrams(buf, off, n)
        rows.append((h % np.uint64(BUCKETS)).astype(np.int32) + BUCKETS)
        docs.append(row)
    return np.concatenate(rows), np.concatenate(docs)


def _counts(batches):
    for b in batches:
        for lo, buf, off in T.pieces(b["text"]):
            rows, docs = features(buf, off)
            key, n = np.unique(docs * ROWS + rows, return_counts=True)
            cut = np.searchsorted(key // ROWS, np.arange(len(off)))
            part = b.slice(lo, len(off) - 1)
            yield pa.RecordBatch.from_arrays(
                [part["key"], part["label"]] + [pa.array([T.pack(f(a[i:j])) for i, j in zip(cut, cut[1:])], pa.binary()) for a, f in ((key % ROWS, _steps), (n, np.int32))],
                ["key", "label", "rows", "counts"],
            )


def _steps(rows: np.ndarray) -> np.ndarray:
    return np.diff(rows, prepend=0).astype(np.int32)


def train(examples, classes: int = 2, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over (rows, counts, label); returns each table row's logits and the bias."""
    rng = np.random.default_rng(seed)
    table, out, bias = np.zeros((ROWS, DIM)), rng.normal(0, 1, (DIM, classes)), np.zeros(classes)
    steps, step = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            rows, counts, label = examples[k]
            now, step = rate * (1 - step / steps), step + 1
            share = counts / max(1, counts.sum())
            hidden = share @ table[rows]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            table[rows] -= now * np.outer(share / max(1e-12, np.sqrt(share @ share)), out @ p)
            out -= 0.05 * now * np.outer(hidden, p)
            bias -= 0.01 * now * p
    return table @ out, bias


class Packed:
    """Examples that are unpacked one at a time."""

    def __init__(self, rows, counts, labels: np.ndarray):
        self.rows, self.counts, self.labels = rows, counts, labels

    def __len__(self) -> int:
        return len(self.labels)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        rows, counts = (T.unpack(c[int(k)].as_py(), np.int32) for c in (self.rows, self.counts))
        return np.cumsum(rows), counts, int(self.labels[k])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on labelled documents (doc_id, label); returns weights by table row, and the bias."""
    chosen = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "key")), "key")
    rows = rows.groupBy("key", "label").agg(F.min("text").alias("text"))  # at most sample rows, however often an id is repeated
    got = rows.select("key", "label", "text").mapInArrow(_counts, "key long, label int, rows binary, counts binary").toArrow().sort_by("key")
    y = got["label"].to_numpy().astype(int)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 0.01), 0.99) if len(y) else 0.5
        return np.zeros(ROWS, np.float32), float(np.log(share / (1 - share)))
    logits, bias = train(Packed(got["rows"], got["counts"], y))
    return (logits[:, 1] - logits[:, 0]).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ROWS numbers

    def run(batches):
        weights, bias = shared.value
        for b in batches:
            parts = [np.zeros(0)]
            for _, buf, off in T.pieces(b["text"]):
                rows, row = features(buf, off)
                total = np.bincount(row, weights[rows], len(off) - 1)
                parts.append(1 / (1 + np.exp(-(total / np.maximum(1, np.bincount(row, minlength=len(off) - 1)) + bias))))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on documents outside the held-out third, then score every document."""
    docs = docs.select("doc_id", "text", held_out(3, 1).alias("held_out"))
    model = fit(docs.where("not held_out"), labels.select("doc_id", F.col("quality").cast("int").alias("label")), sample)
    return score(docs, model)
