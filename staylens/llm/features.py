"""Hashed character n-gram counts and shape statistics of whole texts, and small linear solvers."""

from __future__ import annotations

import unicodedata

import numpy as np

DIMS = 4096


_PLANE = 1 << 16
_tables: dict[str, np.ndarray] = {}


def are_letters(x: np.ndarray) -> np.ndarray:
    """True at the code points that are letters."""
    if "plane" not in _tables:
        _tables["plane"] = np.array([unicodedata.category(chr(i))[0] == "L" for i in range(_PLANE)])
    out = _tables["plane"][np.minimum(x, _PLANE - 1)]
    beyond = np.flatnonzero(x >= _PLANE)
    if len(beyond):
        out[beyond] = [unicodedata.category(chr(i))[0] == "L" for i in x[beyond]]
    return out


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def grams(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of a code point array."""
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)
    three = (two * np.uint32(0xC2B2AE35)) ^ (c * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - (dims.bit_length() - 1))
    mixed = [(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift for h in (two, three)]
    return sum(np.bincount(h, minlength=dims) for h in mixed)


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots scaled to length 1."""
    x = np.sqrt(counts.astype(np.float32))
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def letter_features(text: str) -> np.ndarray | None:
    """n-gram features of the letters of a text (others count as one blank); None without a letter."""
    x = codes(text.lower())
    is_letter = are_letters(x)
    if not is_letter.any():
        return None
    x = np.where(is_letter, x, np.uint32(32))
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    blank = np.full(1, 32, np.uint32)
    return unit(grams(np.concatenate((blank, x, blank))))


STATS = 11


def shape(text: str) -> np.ndarray:
    """Ratios that tell prose from noise: case, digits, punctuation, repetition, lengths."""
    words, lines = text.split(), text.split("\n")
    x = codes(text)
    n, w = max(1, len(x)), max(1, len(words))
    lower = words if len(words) == 0 else [t.strip(".,!?;:*#$%&|").lower() for t in words]
    counts = np.unique(np.fromiter(map(hash_word, lower), np.int64, len(lower)), return_counts=True)[1] if words else np.ones(1)
    upper = ((x >= 65) & (x <= 90)).sum() / n
    digit = ((x >= 48) & (x <= 57)).sum() / n
    other = (~are_letters(x) & (x != 32) & (x != 10)).sum() / n
    pairs = sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / w
    share = counts / counts.sum()
    return np.array(
        [upper, digit, other, len(counts) / w, share.max(), -(share * np.log(share)).sum() / np.log(w + 1), pairs, len(x) / w, np.log1p(len(words)),
         len(set(lines)) / len(lines), len(lines) / w], np.float32,
    )


def hash_word(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights (bias last) of a squared-hinge linear support vector machine; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = v = np.zeros(x.shape[1])
    momentum, rate = 1.0, 1.0 / (2 * 2 + penalty)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        after = v - rate * (penalty * v - 2 * x.T @ (share * y * slack))
        nxt = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        w, v, momentum = after, after + (momentum - 1) / nxt * (after - w), nxt
    return w


def platt(score: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is the share of label 1, by Newton steps; targets are kept off 0 and 1."""
    n1, n0 = label.sum(), len(label) - label.sum()
    t = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * score + b)
        g = np.array([((p - t) * score).sum(), (p - t).sum()])
        h = p * (1 - p) + 1e-6
        m = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)
