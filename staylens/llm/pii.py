"""Personal data by patterns and a skip-chain conditional random field.

Four patterns give the base spans.  The field then labels the entity-like
tokens of a document (those with a digit or an at sign): each has a score per
label from its shape, neighbours in the text share a chain potential, and
tokens that repeat, or are alike (same local part of an address, same digits,
same groups of digits), share a skip potential, however far apart; a mention of
several tokens is alike as a whole, by its first token.  Loopy belief propagation sends
messages along both kinds of edges until they settle, so a damaged or shortened
mention takes the label of its clear twin.  Tokens inside base spans are
observed: they send messages and take none.  A token outside them that is like a
clear mention, and whose label is not "none" with enough belief, adds a span;
the patterns have the last word on shape alone, so a number that fails its
check is never added without a twin.

Weights are fitted on all tokens of a bounded sample of
documents, labelled by the patterns: about FIT_DOCUMENTS of all, and as many of
those that hold a base span of each kind, which weigh less as they are chosen
more often, so that all stand for the table as the first do.  The skip potential
maximises the likelihood of one end's label given its shape score and the label
of the other, over the skip edges between two clear mentions or two other
tokens, and over clear mentions beside a damaged form of themselves (``damaged``);
edges between a clear mention and another token have no known label and are left
out.  A token is linked to the next one like it, and to a clear twin where neither
neighbour of its like is one, so the edges are linear in the tokens.

Defined cases: null text counts as empty; a text without digits and at signs
has no spans; null ids and repeated rows are handled like others; an empty
table gives no rows; without any base span in the sample nothing is added.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import id_and_text, sample
from staylens.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
FIT_DOCUMENTS = 3000  # of all documents, and of those with a span of each kind
BELIEF = 0.8
SKIP = 2.0  # log potential of equal labels on a skip edge that the fit starts from
OBSERVED = 50.0
ROUNDS = 1000  # a guard for messages that never settle; steps get shorter past STEADY rounds
STEADY = 50
_TRIM = ".,;:!?\"'()[]<>{}*#$%&|"

# The patterns of the base spans.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = frozenset("0123456789")
_GROUP = re.compile("[0-9]+")
_DOTTED = re.compile(r"[0-9.]{7,}")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from the at signs; each character is looked at a few times only."""
    out, done, last, at = [], 0, -1, text.find("@")
    while at >= 0:
        before = text[max(done, last + 1) : at]  # no local part goes past another at sign
        start = at - (len(before) - len(before.rstrip(_LOCAL)))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        last, at = at, text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches that pass their check, by kind and start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(run[0]):
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append(("ip", run.start() + m.start(), run.start() + m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tokens:
    """Entity-like tokens of a text: trimmed spans, and the label (0: none) of those inside base spans."""

    def __init__(self, text: str, spans: list[tuple[str, int, int]]):
        self.spans, self.cores = [], []
        for m in _TOKEN.finditer(text):
            word = m[0]
            left = len(word) - len(word.lstrip(_TRIM))
            core = word.strip(_TRIM)
            if core:
                self.spans.append((m.start() + left, m.start() + left + len(core)))
                self.cores.append(core)
        self.whole = list(self.cores)  # what a token is compared by: inside a mention of several, the first stands for all
        self.twinned: set[int] = set()
        self.labels = np.zeros(len(self.spans), np.int64)
        self.inside = np.zeros(len(self.spans), bool)
        begin = np.array([s for s, _ in self.spans], np.int64)
        stop = np.array([e for _, e in self.spans], np.int64)
        for kind, start, end in spans:
            hit = np.arange(np.searchsorted(stop, start, "right"), np.searchsorted(begin, end))
            self.labels[hit] = KINDS.index(kind) + 1
            self.inside[hit] = True
            for k, i in enumerate(hit.tolist()):
                self.whole[i] = "" if k else text[start:end]

    def features(self) -> np.ndarray:
        rows = []
        for (start, _), core, before in zip(self.spans, self.cores, [(-9, -9), *self.spans], strict=False):
            digits = sum(c.isdigit() for c in core)
            letters = sum(c.isalpha() for c in core)
            rows.append(
                [1, "@" in core, core.count(".") == 1, core.count(".") >= 3, core[0] == "+", "-" in core, digits >= 4, digits >= 8, digits >= 16,
                 digits / len(core), letters / len(core), letters > 0, start - before[1] <= 2, 16 <= digits <= 19 and luhn("".join(c for c in core if c in _DIGITS))]
            )
        return np.array(rows, float).reshape(len(rows), FEATURES)

    def skips(self) -> list[tuple[int, int]]:
        """Each token with the next one that is equal or alike, and with an observed one like it unless a neighbour of its like is observed."""
        alike: dict[str, list[int]] = {}
        for i, whole in enumerate(self.whole):
            for key in likeness(whole) if whole else ():
                alike.setdefault(key, []).append(i)
        out = set()
        for at in alike.values():
            out.update(zip(at, at[1:], strict=False))
            clear = [k for k, i in enumerate(at) if self.inside[i]]
            self.twinned.update(at if clear else ())
            for k, following in zip([-1, *clear], [*clear, len(at)], strict=True) if clear else ():
                if k < 0:
                    out.update((i, at[following]) for i in at[:following])
                else:
                    out.update((at[k], i) for i in at[k + 1 : following - (following < len(at))])
        return sorted(out)


FEATURES = 14


def likeness(whole: str) -> list[str]:
    """Keys of a mention; mentions that share one are alike."""
    groups = _GROUP.findall(whole)
    keys = ["=" + whole.lower()]
    local = whole.partition("@")[0].strip(_TRIM).lower() if "@" in whole else ""
    if local:
        keys.append("@" + local)
    elif sum(map(len, groups)) >= 7:
        keys.append("#" + "".join(groups))
    if len(groups) >= 4 and not local:
        keys.append("." + ".".join(groups))
    return keys


def damaged(kind: str, whole: str) -> str:
    """A mention as it is often cut or rewritten, past its pattern but alike."""
    if kind == "email":
        return whole.partition(".")[0] if "@" in whole.partition(".")[0] else whole[: whole.index(".", whole.index("@"))]
    return {"ip": "-", "card": ".", "phone": ""}[kind].join(_GROUP.findall(whole))


class Field:
    """Weights of the field: labels are none and KINDS."""

    skip = SKIP * np.eye(len(KINDS) + 1)

    def __init__(self, x: np.ndarray, y: np.ndarray, count: np.ndarray, pairs: np.ndarray, twins: tuple | None = None, rounds: int = 300):
        n = len(KINDS) + 1
        self.shape = np.zeros((FEATURES, n))
        target = np.eye(n)[y]
        weight = (count / np.bincount(y, count, n)[y])[:, None]
        weight /= weight.sum()
        for _ in range(rounds):
            p = np.exp(x @ self.shape - (x @ self.shape).max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            self.shape -= 2.0 * (x.T @ (weight * (p - target)) + 1e-4 * self.shape)
        joint = pairs + 1.0
        self.chain = np.log(joint / joint.sum()) - np.log(joint.sum(1, keepdims=True) / joint.sum()) - np.log(joint.sum(0, keepdims=True) / joint.sum())

        if twins is not None and len(twins[0]):
            self.skip = self._fit_skip(*twins)

    def _fit_skip(self, x: np.ndarray, y: np.ndarray, other: np.ndarray, count: np.ndarray, rounds: int = 300) -> np.ndarray:
        """The symmetric potential that makes labels y likeliest given shapes and the labels at the other ends; those weigh alike."""
        n = len(KINDS) + 1
        score, target, skip = x @ self.shape, np.eye(n)[y], self.skip.copy()
        weight = (count / np.bincount(other, count, n)[other])[:, None]
        for _ in range(rounds):
            logit = score + skip[other]
            p = np.exp(logit - logit.max(1, keepdims=True))
            slope = np.zeros((n, n))
            np.add.at(slope, other, weight * (p / p.sum(1, keepdims=True) - target))
            skip -= 0.5 * (slope + slope.T + 2e-3 * skip)
        return skip

    def beliefs(self, tokens: Tokens) -> np.ndarray:
        """Label probabilities of each token by loopy message passing."""
        n = len(KINDS) + 1
        score = tokens.features() @ self.shape
        known = np.flatnonzero(tokens.inside)
        score[known] = -OBSERVED * (1 - np.eye(n)[tokens.labels[known]])
        near = [(i, i + 1) for i in range(len(score) - 1) if tokens.spans[i + 1][0] - tokens.spans[i][1] <= 2]
        edges = [(a, b, self.chain) for a, b in near] + [(a, b, self.skip) for a, b in tokens.skips()]
        if edges:
            a, b = (np.array([e[k] for e in edges]) for k in (0, 1))
            force = np.stack([e[2] for e in edges])
            ahead, back = np.zeros((len(edges), n)), np.zeros((len(edges), n))
            to_b, to_a = ~tokens.inside[b][:, None], ~tokens.inside[a][:, None]
            for self.rounds in range(1, ROUNDS + 1):
                total = score.copy()
                np.add.at(total, b, ahead)
                np.add.at(total, a, back)
                out_a, out_b = total[a] - back, total[b] - ahead
                ahead2 = _log_sum(out_a[:, :, None] + force, 1) * to_b
                back2 = _log_sum(out_b[:, None, :] + force, 2) * to_a
                moved = max(np.abs(ahead2 - ahead).max(), np.abs(back2 - back).max())
                step = 0.5 / max(1, self.rounds / STEADY)
                ahead, back = ahead + step * (ahead2 - ahead), back + step * (back2 - back)
                if moved < 1e-3:
                    break
            np.add.at(score, b, ahead)
            np.add.at(score, a, back)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    out = np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)
    return out - out.max(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field | None) -> list[tuple[str, int, int]]:
    """Spans of tokens outside the base spans that the field labels."""
    if not field:
        return []
    tokens = Tokens(text, base)
    if not len(tokens.spans) or tokens.inside.all():
        return []
    belief = field.beliefs(tokens)
    best = belief.argmax(1)
    rows = np.flatnonzero(~tokens.inside & (best > 0) & (belief.max(1) >= BELIEF))
    return [(KINDS[best[i] - 1], *tokens.spans[i]) for i in rows.tolist() if i in tokens.twinned]


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(document, kind) of the kinds of base spans it holds, and with -1 of each document."""
    for batch in batches:
        marks, kinds = [], []
        for mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held = sorted({KINDS.index(k) for k, _, _ in base_spans(text)})
            marks += [mark] * (1 + len(held))
            kinds += [-1, *held]
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(kinds, pa.int32())], names=["doc_id", "kind"])


def _distinct(rows: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sum of the counts of each."""
    rows, place = np.unique(rows, axis=0, return_inverse=True)
    return rows, np.bincount(place.ravel(), count, len(rows))


def _twins(text: str, base: list[tuple[str, int, int]], tokens: Tokens, x: np.ndarray) -> np.ndarray:
    """(features, label, label at the other end) of the skip edges whose labels are known, both ways, and of damaged mentions."""
    rows = [np.empty((0, FEATURES + 2))]
    edges = np.array([e for e in tokens.skips() if tokens.inside[e[0]] == tokens.inside[e[1]]], np.int64).reshape(-1, 2)
    for a, b in (edges.T, edges.T[::-1]):
        rows.append(np.column_stack((x[a], tokens.labels[a], tokens.labels[b])))
    for kind, start, end in base:
        label = KINDS.index(kind) + 1
        shape = Tokens(damaged(kind, text[start:end]), []).features()[:1]
        rows.append(np.column_stack((shape, np.full((len(shape), 2), label))))
    return np.concatenate(rows)


def _weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different (features, pattern label) of all tokens, their weights, label pairs of neighbours, and the different ``_twins``, as one row per batch."""
    for batch in batches:
        rows, weights, pairs = [np.empty((0, FEATURES + 1))], [np.empty(0)], np.zeros((len(KINDS) + 1,) * 2)
        twins, twin_weights = [np.empty((0, FEATURES + 2))], [np.empty(0)]
        for text, weight in zip(batch.column("text").to_pylist(), batch.column("weight").to_pylist(), strict=True):
            if text and (_DIGIT.search(text) or "@" in text):
                base = base_spans(text)
                tokens = Tokens(text, base)
                if len(tokens.spans):
                    x = tokens.features()
                    twins.append(_twins(text, base, tokens, x))
                    twin_weights.append(np.full(len(twins[-1]), weight))
                    rows.append(np.column_stack((x, tokens.labels)))
                    weights.append(np.full(len(tokens.spans), weight))
                    for i in range(len(tokens.spans) - 1):
                        if tokens.spans[i + 1][0] - tokens.spans[i][1] <= 2:
                            pairs[tokens.labels[i], tokens.labels[i + 1]] += weight
        rows, count = _distinct(np.concatenate(rows), np.concatenate(weights))
        found = (rows, count, pairs, *_distinct(np.concatenate(twins), np.concatenate(twin_weights)))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in found], names=["rows", "count", "pairs", "twins", "twin_count"])


def train(docs: DataFrame) -> Field | None:
    texts = id_and_text(docs).where("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    kinds = cut_lineage(texts.mapInArrow(_kinds, "doc_id long, kind int"), "op7-kinds")
    counts = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    if len(counts) < 2:  # no base span in any document
        return None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, FIT_DOCUMENTS / n))])
    chosen = sample(kinds, "kind", FIT_DOCUMENTS).groupBy("doc_id").agg((share[-1] / F.max(share[F.col("kind")])).alias("weight"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # about FIT_DOCUMENTS rows for each kind and for all
    kinds = "rows binary, count binary, pairs binary, twins binary, twin_count binary"
    found = texts.select("text", "weight").mapInArrow(_weak, kinds).collect()  # different feature rows only
    if not found:
        return None
    rows, count, twins, twin_count = (np.concatenate([np.frombuffer(bytes(r[c])) for r in found]) for c in ("rows", "count", "twins", "twin_count"))
    rows, count = _distinct(rows.reshape(-1, FEATURES + 1), count)
    x, y = rows[:, :FEATURES], rows[:, FEATURES].astype(np.int64)
    if not (y > 0).any():
        return None
    twins, twin_count = _distinct(twins.reshape(-1, FEATURES + 2), twin_count)
    ends = twins[:, FEATURES:].astype(np.int64)
    pairs = sum(np.frombuffer(bytes(r.pairs)).reshape(len(KINDS) + 1, -1) for r in found)
    return Field(x, y, count, pairs, (twins[:, :FEATURES], ends[:, 0], ends[:, 1], twin_count))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def _find(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, all_spans, added = [[] for _ in KINDS], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = added_spans(text, base, field) if "@" in text or _DIGIT.search(text) else []
                for kind, column in zip(KINDS, counts, strict=True):
                    column.append(sum(s[0] == kind for s in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                all_spans.append(_joined(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(all_spans, pa.string()), pa.array(added, pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return run


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    kinds = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return id_and_text(docs).mapInArrow(_find(field or train(docs)), kinds)
