"""Toxicity: a bidirectional gated recurrent network with attention pooling over overlapping windows.

A word enters as a hashed word vector joined with the mean of its hashed
character-trigram vectors.  Two gated recurrent units read a window of
``WINDOW`` words in both directions, attention pools their states, and a linear
layer gives a logit.  A document is cut into windows that overlap by half; its
score is the largest logit, turned into a probability by two numbers fitted on
the labelled documents (Platt's scaling).

Training is in numpy on a bounded sample of labelled rows (TOXIC + CLEAN
documents of at most FIT_BYTES).  Which windows of a toxic document are the toxic
ones is not known: they are first guessed by log odds of words and trigrams, with
which the first coordinate of the vectors starts, and then by the network.
Every document is scored on all windows of its whole text.

Defined cases: null text counts as empty and has one empty window; without labels of
both kinds the score is 0; null ids and repeated rows are scored like others;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import crc_bucket, id_and_text, sample
from staylens.llm.features import platt, sigmoid

WINDOW, STRIDE = 32, 16
H = 8
WORDS, TRIGRAMS = 1 << 16, 1 << 14
DIM = 8
TOXIC, CLEAN = 600, 900
FIT_BYTES = 200_000
CACHE_WORDS = 200_000
HELD_OUT = (5, 0)
THRESHOLD = 0.5
_EDGES = b".,!?;:*#$%&|\"'()-"


def many_inputs(words: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Word bucket of each word, the trigram buckets of all words in a row, and how many each word has."""
    cores = [b"^" + (w.strip(_EDGES) or b"^") + b"$" for w in words]
    size = np.fromiter(map(len, cores), np.int64, len(cores))
    x = np.frombuffer(b"".join(cores), np.uint8).astype(np.uint32)
    three = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) ^ x[2:] * np.uint32(0x27D4EB2F)
    three = ((three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
    inside = np.ones(len(x), bool)
    ends = np.cumsum(size)
    inside[ends - 1] = inside[ends - 2] = False  # trigrams that would run into the next word
    return [xxhash.xxh32_intdigest(c) % WORDS for c in cores], three[inside[:-2]].astype(np.int64), size - 2


def sum_rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row i is the sum of the values whose place is i."""
    return np.stack([np.bincount(at, column, n) for column in values.T], axis=1).astype(np.float32)


def split(text: str) -> list[bytes]:
    return text.lower().encode().split()


def window_starts(n: int) -> range:
    return range(0, max(1, n - STRIDE), STRIDE)


class Network:
    """Parameters of the network; ``forward`` reads gates already computed for each word."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {
            "word": draw(WORDS, DIM) * 0.1, "tri": draw(TRIGRAMS, DIM) * 0.1, "x": draw(2 * DIM, 2, 3 * H), "b": np.zeros((2, 3 * H), np.float32),
            "u": draw(2, H, 2 * H), "n": draw(2, H, H), "a": draw(2 * H), "o": draw(2 * H), "c": np.zeros(1, np.float32),
        }
        self.scale = (1.0, 0.0)

    def inputs(self, words: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """One row of 2 * DIM numbers per word."""
        return self.vectors([w for w, _ in words], np.concatenate([t for _, t in words]), np.array([len(t) for _, t in words]))

    def vectors(self, buckets: list[int], trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        mean = np.add.reduceat(self.p["tri"][trigrams], begin, axis=0) / counts[:, None]
        return np.hstack([self.p["word"][buckets], mean]).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        return (np.tensordot(x, self.p["x"], 1) + self.p["b"]).astype(np.float32)  # (words, 2, 3H)

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows; gates (n, T, 2, 3H) with direction 1 still in reading order, mask (n, T) true at words."""
        n, steps = mask.shape
        h = np.zeros((2, n, H), np.float32)
        states = np.zeros((2, steps, n, H), np.float32)
        for t in range(steps):
            g = np.stack([gates[:, t, 0], gates[:, steps - 1 - t, 1]])
            live = np.stack([mask[:, t], mask[:, steps - 1 - t]])[..., None]
            zr = sigmoid(g[..., : 2 * H] + h @ self.p["u"])
            z, r = zr[..., :H], zr[..., H:]
            new = np.tanh(g[..., 2 * H :] + (r * h) @ self.p["n"])
            after = np.where(live, z * h + (1 - z) * new, h)
            if keep is not None:
                keep.append((h, z, r, new, live))
            h = after
            states[0, t], states[1, steps - 1 - t] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], axis=2)  # (T, n, 2H)
        weight = np.where(mask.T, both @ self.p["a"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = (weight[..., None] * both).sum(0)
        if keep is not None:
            keep.append((both, weight, pooled))
        return pooled @ self.p["o"] + self.p["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss, and with respect to the word inputs x (n, T, 2 DIM)."""
        keep: list = []
        p, steps = self.p, mask.shape[1]
        logit = self.forward(self.gates(x), mask, keep)
        d = (sigmoid(logit) - y) * weights
        both, weight, pooled = keep.pop()
        g = {k: np.zeros_like(p[k]) for k in ("x", "b", "u", "n", "a", "o", "c")}
        g["o"], g["c"] = pooled.T @ d, d.sum(keepdims=True)
        d_pool = d[:, None] * p["o"]
        d_weight = (both * d_pool).sum(2)
        d_raw = weight * (d_weight - (weight * d_weight).sum(0))
        g["a"] = (d_raw[..., None] * both).sum((0, 1))
        d_both = weight[..., None] * d_pool + d_raw[..., None] * p["a"]
        d_gates = np.zeros((*mask.shape, 2, 3 * H), np.float32)
        dh = np.zeros_like(keep[0][0])
        for t in reversed(range(steps)):
            h, z, r, new, live = keep[t]
            dh = dh + np.stack([d_both[t, :, :H], d_both[steps - 1 - t, :, H:]])
            passed = np.where(live, 0, dh)
            now = np.where(live, dh, 0)
            d_new = now * (1 - z) * (1 - new**2)
            d_rh = d_new @ p["n"].transpose(0, 2, 1)
            d_zr = np.concatenate([now * (h - new) * z * (1 - z), d_rh * h * r * (1 - r)], axis=2)
            g["n"] += (r * h).transpose(0, 2, 1) @ d_new
            g["u"] += h.transpose(0, 2, 1) @ d_zr
            dg = np.concatenate([d_zr, d_new], axis=2)
            d_gates[:, t, 0], d_gates[:, steps - 1 - t, 1] = dg[0], dg[1]
            dh = passed + now * z + d_rh * r + d_zr @ p["u"].transpose(0, 2, 1)
        g["b"] = d_gates.sum((0, 1))
        g["x"] = np.tensordot(x, d_gates, ((0, 1), (0, 1)))
        return g, np.tensordot(d_gates, p["x"], ((2, 3), (1, 2)))


class Corpus:
    """Labelled training documents as numbers of their distinct words."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.index: dict[bytes, int] = {}
        self.docs = [np.array([self.index.setdefault(w, len(self.index)) for w in split(t)], np.int64) for t in texts]
        self.labels = np.array(labels)
        buckets, trigrams, counts = many_inputs(list(self.index) or [b""])
        self.words = list(zip(buckets, np.split(trigrams, np.cumsum(counts)[:-1]), strict=True))

    def log_odds(self, buckets: int, of) -> np.ndarray:
        seen = np.full((2, buckets), 2.0)
        for doc, label in zip(self.docs, self.labels, strict=True):
            if len(doc):
                seen[label, np.unique(np.concatenate([of(self.words[w]) for w in np.unique(doc)]))] += 1
        total = np.bincount(self.labels, minlength=2)[:, None] + 4.0
        return np.log(seen[1] / total[1]) - np.log(seen[0] / total[0])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, start) of each window, and the words (-1 past the end)."""
        place = [(d, s) for d, doc in enumerate(self.docs) for s in window_starts(len(doc))]
        words = np.full((len(place), WINDOW), -1, np.int64)
        for row, (d, s) in enumerate(place):
            part = self.docs[d][s : s + WINDOW]
            words[row, : len(part)] = part
        return np.array([d for d, _ in place]), words


def fit(texts: list[str], labels: list[int], prior: float | None = None, epochs: int = 12, rounds: int = 2, seed: int = 7) -> Network | None:
    """``prior``: share of toxic rows among the labelled ones; the sample has more, which the last step undoes."""
    if len(set(labels)) < 2:
        return None
    corpus, net, rng = Corpus(texts, labels), Network(seed), np.random.default_rng(seed)
    odds = corpus.log_odds(WORDS, lambda w: np.array([w[0]]))
    tri_odds = corpus.log_odds(TRIGRAMS, lambda w: w[1])
    net.p["word"][:, 0], net.p["tri"][:, 0] = odds, tri_odds
    net.p["word"], net.p["tri"] = net.p["word"].astype(np.float32), net.p["tri"].astype(np.float32)
    owner, words = corpus.windows()
    mask = words >= 0
    guess = np.array([odds[w] + tri_odds[t].max() for w, t in corpus.words])
    score = np.where(mask, guess[words], -9.0).max(1)
    toxic = corpus.labels[owner] == 1
    size = {k: np.zeros_like(v) for k, v in net.p.items()}
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        order = np.lexsort((-score, owner))
        rank = np.empty(len(order), np.int64)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(owner[order])) + 1))
        rank[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(order)]))))
        best = np.full(len(corpus.docs), -1e9)
        np.maximum.at(best, owner, score)
        chosen = np.flatnonzero((toxic & (rank < 3) & (score >= best[owner] - (1.0 if turn == 0 else 2.0))) | (~toxic & ((rank < 2) | (rng.random(len(owner)) < 0.05))))
        y = toxic[chosen].astype(np.float32)
        share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())).astype(np.float32)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 256)):
                rows, step = chosen[part], step + 1
                used, inverse = np.unique(np.maximum(words[rows], 0), return_inverse=True)
                table = net.inputs([corpus.words[w] for w in used])
                g, dx = net.gradients(table[inverse.reshape(words[rows].shape)], mask[rows], y[part], share[part] / share[part].sum())
                d_word = sum_rows(inverse.ravel(), dx.reshape(-1, 2 * DIM), len(table))
                counts = [len(corpus.words[w][1]) for w in used]
                g["word"] = sum_rows(np.array([corpus.words[w][0] for w in used]), d_word[:, :DIM], WORDS)
                g["tri"] = sum_rows(np.concatenate([corpus.words[w][1] for w in used]), np.repeat(d_word[:, DIM:] / np.array(counts)[:, None], counts, axis=0), TRIGRAMS)
                for k, v in g.items():
                    moment[k] = 0.9 * moment[k] + 0.1 * v
                    size[k] = 0.999 * size[k] + 0.001 * v**2
                    net.p[k] = (net.p[k] - 0.01 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(size[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        gates = np.concatenate([net.gates(net.inputs(corpus.words)), np.zeros((1, 2, 3 * H), np.float32)])
        score = np.concatenate([net.forward(gates[words[i : i + 4096]], mask[i : i + 4096]) for i in range(0, len(words), 4096)])
    best = np.full(len(corpus.docs), -1e9)
    np.maximum.at(best, owner, score)
    a, b = platt(best, corpus.labels)
    here = corpus.labels.mean()
    prior = min(max(prior or here, 1e-4), 1 - 1e-4)
    net.scale = a, b + float(np.log(prior / (1 - prior)) - np.log(here / (1 - here)))
    return net


class Scorer:
    """Document scores of a worker, with the gates of the words met lately."""

    def __init__(self, net: Network):
        self.net = net
        self.index: dict[bytes, int] = {}
        self.table = np.zeros((1, 2, 3 * H), np.float32)  # row 0 stands for no word

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [split(t) for t in texts]
        if len(self.index) > CACHE_WORDS:
            self.index, self.table = {}, self.table[:1]
        new = [w for w in dict.fromkeys(w for d in docs for w in d) if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.net.gates(self.net.vectors(*many_inputs(new)))])
        best = np.full(len(docs), -1e9)
        owner, rows = [], []
        for i, words in enumerate(docs):
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            starts = window_starts(len(at))
            at = np.concatenate((at, np.zeros(starts[-1] + WINDOW - len(at) if starts[-1] + WINDOW > len(at) else 0, np.int64)))
            rows.append(np.lib.stride_tricks.sliding_window_view(at, WINDOW)[::STRIDE][: len(starts)])
            owner.append(np.full(len(starts), i))
        owner, rows = np.concatenate(owner), np.concatenate(rows)
        for i in range(0, len(rows), 2048):
            part = rows[i : i + 2048]
            np.maximum.at(best, owner[i : i + 2048], self.net.forward(self.table[part], part > 0))
        return sigmoid(self.net.scale[0] * best + self.net.scale[1])


def _score(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for batch in (b.slice(i, 128) for b in batches for i in range(0, b.num_rows, 128)):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            score = scorer.score(texts) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.asarray(score, float))], names=["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Network | None:
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("kind")).where("doc_id IS NOT NULL AND kind IN (0, 1)")
    known = known.where(crc_bucket(HELD_OUT[0]) != HELD_OUT[1])
    counts = {r.kind: r["count"] for r in known.groupBy("kind").count().collect()}
    toxic, clean = (sample(known.where(F.col("kind") == k), "kind", n) for k, n in ((1, TOXIC), (0, CLEAN)))
    rows = id_and_text(docs).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(toxic.unionByName(clean)), "doc_id")
    rows = sorted(rows.select("kind", "text").collect())  # bounded: about TOXIC + CLEAN texts of at most FIT_BYTES
    return fit([r.text for r in rows], [r.kind for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def score_toxicity(docs: DataFrame, labels: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = id_and_text(docs).mapInArrow(_score(net or train(docs, labels)), "doc_id long, score double")
    return rows.select("doc_id", (crc_bucket(HELD_OUT[0]) == HELD_OUT[1]).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
