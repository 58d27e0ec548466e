"""Small numpy models on hashed features: softmax and independent binary classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from lumenloom.llm import textkit

BLOCK = 256


def byte_grams(column: pa.Array, buckets: int) -> Iterator[tuple[textkit.Segment, np.ndarray, np.ndarray]]:
    """(segment, piece, bucket) of the byte 2-, 3- and 4-grams inside words of letters."""
    for seg in textkit.segments(column, textkit.LETTER_BYTES):
        pieces, found = [], []
        for at, bucket in textkit.word_grams(seg.buf, range(2, 5), buckets.bit_length() - 1):
            real = (at < seg.size) & ((seg.buf[at] != textkit.SPACE) | (seg.buf[at + 1] != textkit.SPACE))
            pieces.append(np.searchsorted(seg.starts, at[real], side="right") - 1)
            found.append(bucket[real])
        yield seg, np.concatenate(pieces), np.concatenate(found)


def token_features(column: pa.Array, buckets: int) -> Iterator[tuple[textkit.Segment, np.ndarray, np.ndarray]]:
    """(segment, piece, bucket) of tokens and neighbouring pairs."""
    for seg, hashes, piece, _ in textkit.token_grams(column):
        yield seg, piece, (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def histograms(features: Iterator[tuple[textkit.Segment, np.ndarray, np.ndarray]], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, counts) for blocks of texts; each row comes once, with the counts of its whole text."""
    held_row, held = -1, None
    for seg, piece, bucket in features:
        rows = np.unique(seg.rows)
        local = np.searchsorted(rows, seg.rows)[piece]
        order = np.argsort(local, kind="stable")
        local, bucket = local[order], bucket[order]
        for low in range(0, len(rows), BLOCK):
            high = min(low + BLOCK, len(rows))
            i, j = np.searchsorted(local, (low, high))
            counts = np.bincount((local[i:j] - low) * buckets + bucket[i:j], minlength=(high - low) * buckets).reshape(high - low, buckets)
            if held is not None and held_row == rows[low]:
                counts[0] += held
            elif held is not None:
                yield np.array([held_row]), held[None]
            if high - low > 1:
                yield rows[low : high - 1], counts[:-1]
            held_row, held = rows[high - 1], counts[-1].copy()
    if held is not None:
        yield np.array([held_row]), held[None]


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies: rows of unit length."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def matrix(texts: list[str], features: Callable, buckets: int) -> np.ndarray:
    total = np.zeros((len(texts), buckets), np.float32)
    for rows, counts in histograms(features(pa.array(texts, pa.large_string()), buckets), buckets):
        total[rows] = shares(counts)
    return total


def applied(features: Iterator[tuple[textkit.Segment, np.ndarray, np.ndarray]], n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of n whole texts."""
    logits = np.zeros((n, weights.shape[1]))
    for rows, counts in histograms(features, len(weights)):
        logits[rows] = shares(counts) @ weights
    return logits + bias


def _descend(x: np.ndarray, outputs: int, slope_of: Callable, epochs: int, rate: float, ridge: float):
    weights, bias = np.zeros((x.shape[1], outputs), np.float32), np.zeros(outputs, np.float32)
    m = [np.zeros_like(weights), np.zeros_like(bias)]
    v = [np.zeros_like(weights), np.zeros_like(bias)]
    for step in range(1, epochs + 1):
        slope = slope_of(x @ weights + bias)
        for k, (p, g) in enumerate(((weights, x.T @ slope + ridge * weights), (bias, slope.sum(axis=0)))):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.001 * (g * g - v[k])
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return weights, bias


def fit_binary(x: np.ndarray, targets: np.ndarray, *, epochs: int = 150, rate: float = 0.1, ridge: float = 1e-5):
    """One logistic classifier for each column of targets (0 or 1)."""
    return _descend(x, targets.shape[1], lambda z: ((1 / (1 + np.exp(-z)) - targets) / len(x)).astype(np.float32), epochs, rate, ridge)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, labels: np.ndarray, classes: int, weight: np.ndarray, *, epochs: int = 150, rate: float = 0.1, ridge: float = 1e-5):
    marks = np.eye(classes, dtype=np.float32)[labels]
    share = (weight / weight.sum())[:, None]
    return _descend(x, classes, lambda z: ((softmax(z) - marks) * share).astype(np.float32), epochs, rate, ridge)
