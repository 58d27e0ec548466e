"""Language identification with error-correcting output codes.

Every language has a codeword of bits; one logistic classifier of hashed byte n-grams predicts each
bit. Decoding sums, for every codeword, the logistic loss of the predicted bits, each bit weighted
by its accuracy on rows set aside, and takes the least. Where the two least are close the row is
flagged as ambiguous. The fit sees at most `per_class` rows of each language and `max_bytes` of
text, outside the held-out fold; each also in a short excerpt, so that short texts are met.

Defined cases: null text, or text without a letter (Unicode category L), is `und` with score 0; a null or missing
language is never learned; with one language all texts with a letter get it; without any, `und`;
a null doc_id is not held out; repeated documents are predicted each; extra columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm import linear
from lumenloom.llm.common import bounded_sample, fold, give_back

BUCKETS = 4096


def codewords(classes: int, seed: int = 6) -> np.ndarray:
    """Rows of +1 and -1: the exhaustive code for up to 5 classes, else the best of random ones."""
    if classes <= 1:
        return np.zeros((classes, 0))
    if classes <= 5:
        columns = [(1, *c) for c in product((1, -1), repeat=classes - 1) if -1 in c]
        return np.array(columns, float).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = 5 * int(np.ceil(np.log2(classes))) + 2
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        far = (bits - code @ code.T) / 2 + np.eye(classes) * bits
        if far.min() > apart and (np.abs(code.sum(axis=0)) < classes).all():
            best, apart = code, far.min()
    return best if best is not None else code


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = 400, max_bytes: int = 12 << 20) -> dict:
    known = docs.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{text}`").alias("body"), F.col(f"`{lang}`").alias("known")).where((fold(F.col("of")) != 2) & F.col("known").isNotNull() & F.col("body").isNotNull())
    sample = bounded_sample(known, None, doc_id="of", text="body", label="known", per_class=per_class, max_bytes=max_bytes, seed=6).drop_duplicates(["key"])
    names = sorted(sample["label"].unique())
    code = codewords(len(names))
    model = {"names": names, "code": code, "weights": np.zeros((BUCKETS, code.shape[1]), np.float32), "bias": np.zeros(code.shape[1], np.float32), "trust": np.ones(code.shape[1])}
    if len(names) < 2:
        return model
    texts = sample["text"].fillna("").tolist()
    rng = np.random.default_rng(6)
    excerpts = []
    for t in texts:
        words = t.split()
        at = int(rng.integers(0, max(1, len(words) - 8)))
        excerpts.append(" ".join(words[at : at + int(rng.integers(2, 9))]))
    x = linear.matrix(texts + excerpts, linear.byte_grams, BUCKETS)
    bits = np.tile(code[np.searchsorted(names, sample["label"])] > 0, (2, 1)).astype(np.float32)
    aside = np.arange(len(x)) % 5 == 4
    weights, bias = linear.fit_binary(x[~aside], bits[~aside])
    right = ((x[aside] @ weights + bias > 0) == (bits[aside] > 0.5)).mean(axis=0) if aside.any() else np.ones(len(bias))
    trust = np.clip(right - 0.5, 0.01, 0.5)
    return model | {"weights": weights, "bias": bias, "trust": trust / trust.sum() * len(trust)}


def decode(model: dict, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, probability, margin to the second) of rows of bit logits."""
    code = model["code"]
    loss = np.stack([(np.logaddexp(0, -bits * word) * model["trust"]).sum(axis=1) for word in code], axis=1)
    p = linear.softmax(-loss)
    best = p.argmax(axis=1)
    ranked = np.sort(p, axis=1)
    return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)


def identify(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text", margin: float = 0.2) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        give_back()
        model = shipped.value
        plain = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & bool(model["names"])
        if not plain.any():
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "ambiguous": True})
        column = pa.array(texts.where(texts.notna(), ""), pa.large_string())
        bits = linear.applied(linear.byte_grams(column, BUCKETS), len(texts), model["weights"], model["bias"])
        best, p, gap = decode(model, bits)
        names = np.array(model["names"], dtype=object)[best]
        return pd.DataFrame({"lang_pred": np.where(plain, names, "und"), "score": np.where(plain, p, 0.0), "ambiguous": ~plain | (gap < margin)})

    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.coalesce(fold(F.col(f"`{doc_id}`")) == 2, F.lit(False)).alias("held_out"), predicted(F.col(f"`{text}`")).alias("p"))
    return rows.select(doc_id, "held_out", "p.lang_pred", "p.score", "p.ambiguous")
