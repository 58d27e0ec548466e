"""Toxicity by subword-bag embeddings: averaged n-gram vectors feed a linear softmax.

Words are seen as their character n-grams with boundary marks, hashed to a table of vectors; a bag
is the average of the n-gram vectors of a passage, and a softmax over two outputs (clean, toxic)
reads it. Table and softmax are trained jointly in numpy on a bounded sample of labelled rows: at
most `per_class` rows of each label and `max_bytes` of text, whole texts. Misspelt and inflected
forms share n-grams with known ones. Scoring folds the softmax into the table (one number an n-gram)
and runs on the executors.

A departure from one average a text: bags are passages of `PASSAGE` words and a text is as toxic as
its most toxic passage, as one insult in thousands of words is averaged away otherwise.

Defined cases: null, empty and word-free texts get the score of an empty bag; a null doc_id is not
held out and never used for a fit; without labelled rows of both kinds every score is the label
mean (0 without labels); repeated documents are scored each; extra columns are ignored or kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm import textkit
from lumenloom.llm.common import bounded_sample, fold, give_back
from lumenloom.llm.linear import softmax

GRAMS = range(3, 7)
BITS = 17
DIM = 8
PASSAGE = 3
THRESHOLD = 0.3
MIN_ROWS = 3
CALIBRATION_ROWS = 20


@dataclass
class Model:
    weights: np.ndarray  # of each n-gram bucket, softmax folded in
    bias: float


@dataclass
class Passages:
    """The passages of a segment: the first word of each, its row, and whether the first passage is
    the rest of the last one of the segment before."""

    seg: textkit.Segment
    starts: np.ndarray
    ends: np.ndarray
    of_word: np.ndarray
    first: np.ndarray
    rows: np.ndarray
    continues: bool


def _passages(column: pa.Array) -> Iterator[Passages]:
    last_row, n_words = -1, 0
    for seg in textkit.segments(column, textkit.WORD_BYTES):
        starts, ends = textkit.word_bounds(seg.buf)
        if not len(starts):
            continue
        row = seg.rows[np.searchsorted(seg.starts, starts, side="right") - 1]
        at = np.arange(len(starts))
        begin = np.searchsorted(row, row, side="left")
        number = at - begin + np.where(row == last_row, n_words, 0)
        change = (number % PASSAGE == 0) | (at == begin)
        first = np.flatnonzero(change)
        yield Passages(seg, starts, ends, np.cumsum(change) - 1, first, row[first], bool(number[0] % PASSAGE))
        last_row, n_words = int(row[-1]), int(number[-1]) + 1


def _adam(params: list[np.ndarray], rate: float):
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0

    def apply(grads: list[np.ndarray]) -> None:
        nonlocal step
        step += 1
        for p, g, (m, v) in zip(params, grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    return apply


def _sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Sums of rows[index] between neighbouring starts; no segment is empty, and only a block of
    gathered rows is in memory at a time."""
    out = np.empty((len(starts), rows.shape[1]), rows.dtype)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(index), block), side="left"))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)], strict=True):
        if b > a:
            i, j = int(starts[a]), int(starts[b]) if b < len(starts) else len(index)
            out[a:b] = np.add.reduceat(rows[index[i:j]], starts[a:b] - i, axis=0)
    return out


def fit(texts: list[str], toxic: np.ndarray, prior: float, *, epochs: int = 24, seed: int = 7) -> Model:
    """Joint training of the n-gram vectors and the softmax.

    First all passages of a text carry its label; then each text speaks through its most toxic
    passage. `prior` is the share of toxic rows among all labelled ones: rows are weighted to it.
    """
    if not len(texts) or toxic.min() == toxic.max():
        share = min(max(prior, 1e-4), 1 - 1e-4)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    vocabulary: dict[bytes, int] = {}
    tokens, token_passage, passage_row = [], [], []
    n_passages = 0
    for p in _passages(pa.array(texts, pa.large_string())):
        raw = p.seg.buf.tobytes()
        tokens += [vocabulary.setdefault(raw[i:j], len(vocabulary)) for i, j in zip(p.starts.tolist(), p.ends.tolist(), strict=True)]
        token_passage.append(p.of_word + n_passages - p.continues)
        passage_row.append(p.rows[p.continues :])
        n_passages += len(p.rows) - p.continues
    if not n_passages:
        return fit([], toxic, prior)
    token, of_passage, of_row = np.array(tokens, np.int32), np.concatenate(token_passage).astype(np.int32), np.concatenate(passage_row).astype(np.int32)
    del tokens, token_passage, passage_row
    buf = np.frombuffer(b" " + b" ".join(vocabulary) + b" " * 9, np.uint8)
    starts, _ = textkit.word_bounds(buf)
    owner, gram = [], []
    for at, bucket in textkit.word_grams(buf, GRAMS, BITS):
        owner.append((np.searchsorted(starts, at + 1, side="right") - 1).astype(np.int32))
        gram.append(bucket.astype(np.int32))
    owner, gram = np.concatenate(owner), np.concatenate(gram)
    order = np.argsort(owner, kind="stable")
    owner, gram = owner[order], gram[order]
    counts = np.bincount(owner, minlength=len(vocabulary)).astype(np.float32)
    # N-grams of under MIN_ROWS texts stay at zero; row 0 is a zero vector that every word has.
    word_rows = np.unique(token * np.int64(len(texts)) + of_row[of_passage]) // len(texts)
    spread = np.bincount(word_rows, minlength=len(vocabulary))
    common = np.bincount(gram, spread[owner], minlength=1 << BITS) >= MIN_ROWS
    owner, gram = owner[common[gram]], gram[common[gram]]
    used, gram = np.unique(gram, return_inverse=True)
    owner = np.concatenate((np.arange(len(vocabulary)), owner))
    gram = np.concatenate((np.zeros(len(vocabulary), np.int64), gram + 1))
    order = np.argsort(owner, kind="stable")
    owner, gram = owner[order].astype(np.int32), gram[order].astype(np.int32)
    word_from = np.searchsorted(owner, np.arange(len(vocabulary)))
    by_gram = np.argsort(gram, kind="stable")
    gram_from = np.searchsorted(gram[by_gram], np.arange(len(used) + 1))
    gram_owner = owner[by_gram]
    del owner, by_gram, order
    # Passages with the label weights that bring the sample to the prior.
    positive = toxic[of_row].astype(np.float32)
    weight = np.where(toxic, prior / max(toxic.mean(), 1e-9), (1 - prior) / max(1 - toxic.mean(), 1e-9)).astype(np.float32)
    per_row = np.bincount(of_row, minlength=len(texts)).astype(np.float32)
    passage_from = np.searchsorted(of_passage, np.arange(n_passages))
    by_token = np.argsort(token, kind="stable")
    token_from = np.searchsorted(token[by_token], np.arange(len(vocabulary)))
    token_passage = of_passage[by_token]
    del by_token
    total = np.maximum(np.add.reduceat(counts[token], passage_from), 1)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (len(used) + 1, DIM)).astype(np.float32)
    vectors[0] = 0
    head = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.log([1 - prior, prior]).astype(np.float32)
    wanted = np.stack((1 - positive, positive), axis=1)
    step = _adam([vectors, head, bias], 0.08)
    for epoch in range(epochs):
        words = _sums(vectors, gram, word_from)
        bags = _sums(words, token, passage_from) / total[:, None]
        outputs = bags @ head + bias
        logit = outputs[:, 1] - outputs[:, 0]
        if epoch < epochs // 3:
            share = weight[of_row] / per_row[of_row]
        else:
            top = np.full(len(texts), -np.inf, np.float32)
            np.maximum.at(top, of_row, logit)
            share = np.where(logit >= top[of_row], weight[of_row], 0)
        slope = ((softmax(outputs) - wanted) * (share / len(texts))[:, None]).astype(np.float32)
        at_words = _sums((slope / total[:, None]) @ head.T, token_passage, token_from)
        at_vectors = _sums(at_words, gram_owner, gram_from) + 1e-7 * vectors
        at_vectors[0] = 0
        step([at_vectors, bags.T @ slope, slope.sum(axis=0)])
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = vectors[1:] @ (head[:, 1] - head[:, 0])
    return Model(weights, float(bias[1] - bias[0]))


def calibrate(model: Model, texts: list[str], toxic: np.ndarray, prior: float) -> Model:
    """Scale and shift of the logit, fitted by Newton steps on rows that the vectors haven't seen."""
    p = np.clip(scores(model, pa.array(texts, pa.large_string())), 1e-9, 1 - 1e-9)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1)
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    fit_at = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ fit_at, -30, 30)))
        slope = x.T @ (weight * (q - toxic)) + 1e-2 * (fit_at - [1.0, 0.0])
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        fit_at = fit_at - np.clip(np.linalg.solve(curve, slope), -1, 1)
    scale = max(float(fit_at[0]), 1e-3)
    return Model((model.weights * scale).astype(np.float32), model.bias * scale + float(fit_at[1]))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """The probability of the toxic class for every text of the column."""
    best = np.full(len(column), -np.inf)
    held = (0, 0.0, 0.0)  # row, sum and size of the last passage, which may go on
    for p in _passages(column):
        sums, sizes = np.zeros(p.seg.size), np.zeros(p.seg.size)
        for at, bucket in textkit.word_grams(p.seg.buf, GRAMS, BITS):
            sums[at] += model.weights[bucket]
            sizes[at] += 1
        edges = p.starts[p.first] - 1
        total, size = np.add.reduceat(sums, edges), np.add.reduceat(sizes, edges)
        if p.continues:
            total[0] += held[1]
            size[0] += held[2]
        elif held[2]:
            best[held[0]] = max(best[held[0]], held[1] / held[2])
        np.maximum.at(best, p.rows[:-1], total[:-1] / np.maximum(size[:-1], 1))
        held = (int(p.rows[-1]), float(total[-1]), float(size[-1]))
    if held[2]:
        best[held[0]] = max(best[held[0]], held[1] / held[2])
    best = np.where(np.isfinite(best), best, 0.0)
    return 1 / (1 + np.exp(-(best + model.bias)))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_class: int = 900, max_bytes: int = 8 << 20) -> Model:
    """A model from the labelled rows outside the held-out fold; see the bounds above."""
    usable = labels.where((fold(F.col(doc_id)) != 2) & F.col(toxic).isin(0, 1)).groupBy(doc_id).agg(F.max(toxic).alias("toxic_label"))
    counts = {int(r["toxic_label"]): r["count"] for r in usable.groupBy("toxic_label").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    sample = bounded_sample(docs, usable, doc_id=doc_id, text=text, label="toxic_label", per_class=per_class, max_bytes=max_bytes, seed=10)
    texts, marks = sample["text"].fillna("").to_numpy(object), (sample["label"] == "1").to_numpy()
    aside = np.arange(len(texts)) % 4 == 3
    if min(marks[aside].sum(), (~marks[aside]).sum()) < CALIBRATION_ROWS:
        return fit(list(texts), marks, prior)
    return calibrate(fit(list(texts[~aside]), marks[~aside], prior), list(texts[aside]), marks[aside], prior)


def _scorer(docs: DataFrame, model: Model):
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series(scores(Model(*shipped.value), pa.array(texts, pa.large_string(), from_pandas=True)))

    return scored


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = _scorer(docs, model)
    return docs.select(
        F.col(doc_id),
        F.coalesce(fold(F.col(doc_id)) == 2, F.lit(False)).alias("held_out"),
        scored(F.col(f"`{text}`")).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, columns unchanged."""
    scored = _scorer(docs, model)
    return docs.where(scored(F.col(f"`{text}`")) < threshold)
