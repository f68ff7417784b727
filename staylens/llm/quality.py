"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are labelled rows of quality 1; unlabelled rows are a sample
of all documents, whatever their label.  A linear model on hashed character
n-grams and binned shape statistics minimises

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

with the sigmoid loss; a mini-step whose bracket is negative climbs back
instead.  The class prior is the share of positives among the labelled rows that
are not held out.  Two numbers fitted on those rows (Platt's scaling) turn the
margin into a probability.  The samples are bounded by PER_LABEL and
UNLABELLED; their n-gram rows travel sparse, at full width, and are spread once
into the matrices of the fit.  Every document is scored on its whole text.

Defined cases: null text counts as empty and is scored; without positives the
score is 0.5; null ids and repeated rows are scored like others; several
label rows of one document all count; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import crc_bucket, id_and_text, sample
from staylens.llm.features import DIMS, STATS, codes, grams, platt, shape, sigmoid, unit
from staylens.session import cut_lineage

PER_LABEL, UNLABELLED = 1500, 3000
HELD_OUT = (5, 0)
THRESHOLD = 0.3
BINS = 8
_PAD = np.full(1, 32, np.uint32)


def raw_features(text: str) -> np.ndarray:
    x = np.concatenate((_PAD, codes(text), _PAD))
    return np.concatenate((unit(grams(x)), shape(text))).astype(np.float32)


def packed(x: np.ndarray) -> bytes:
    """A feature row without its zeros: places, values, statistics."""
    at = np.flatnonzero(x[:DIMS])
    return at.astype(np.uint16).tobytes() + x[at].tobytes() + x[DIMS:].tobytes()


def spread(rows: list[bytes]) -> np.ndarray:
    """The feature rows of ``packed``."""
    out = np.zeros((len(rows), DIMS + STATS), np.float32)
    for x, row in zip(out, rows, strict=True):
        n = (len(row) - 4 * STATS) // 6
        x[np.frombuffer(row, np.uint16, n)] = np.frombuffer(row[2 * n : 6 * n], np.float32)
        x[DIMS:] = np.frombuffer(row[6 * n :], np.float32)
    return out


class Model:
    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400):
        self.edges = np.quantile(unlabelled[:, DIMS:], np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        p, u = self.expand(positive), self.expand(unlabelled)
        w = np.zeros(p.shape[1])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            w4 = w.astype(np.float32)
            fp, fu = sigmoid(p @ w4), sigmoid(u @ w4)  # sigmoid loss: l(+1) = 1 - f, l(-1) = f
            sp, su = fp * (1 - fp), fu * (1 - fu)
            bracket = fu.mean() - prior * fp.mean()
            down = -prior * (p.T @ sp) / len(p)
            back = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
            gradient = (down + back if bracket >= 0 else -back) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.scale = w.astype(np.float32), (1.0, 0.0)

    def expand(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), DIMS + STATS * (BINS - 1) + 1), np.float32)  # the last column is the bias
        np.multiply(x[:, :DIMS], 4, out=out[:, :DIMS])
        out[:, DIMS:-1] = (x[:, DIMS:, None] > self.edges[None]).reshape(len(x), -1)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.margin(x) + self.scale[1])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [packed(raw_features(t or "")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(x, pa.binary())], names=["kind", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    known = labels.select("doc_id", F.col("quality").cast("int").alias("kind")).where("doc_id IS NOT NULL AND kind IN (0, 1)")
    known = known.where(crc_bucket(HELD_OUT[0]) != HELD_OUT[1])
    counts = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
    if not counts.get(1):
        return None
    prior = counts[1] / (counts[1] + counts.get(0, 0))
    chosen = sample(known, "kind", PER_LABEL)
    texts = id_and_text(docs)
    labelled = texts.join(F.broadcast(chosen), "doc_id").select("text", "kind")  # about PER_LABEL rows of each label
    anyone = sample(texts.withColumn("kind", F.lit(2)), "kind", UNLABELLED).select("text", "kind")
    found = cut_lineage(labelled.unionByName(anyone).mapInArrow(_rows, "kind int, x binary"), "op8-sample")
    rows = {k: [] for k in range(3)}
    for r in found.toLocalIterator():  # bounded by the samples, a partition at a time
        rows[r.kind].append(bytes(r.x))
    negative, positive, unlabelled = (sorted(rows.pop(k)) for k in range(3))
    if not positive or not unlabelled:
        return None
    positive = spread(positive)
    model = Model(positive, spread(unlabelled), min(prior, 0.99))
    if negative:
        margin = [model.margin(x) for x in (positive, spread(negative))]
        model.scale = platt(np.concatenate(margin), np.repeat([1, 0], [len(x) for x in margin]))
    return model


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score = model.score(np.stack([raw_features(t) for t in texts])) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score.astype(float), pa.float64())], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = id_and_text(docs).mapInArrow(_score(model or train(docs, labels)), "doc_id long, score double")
    return rows.select("doc_id", (crc_bucket(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
