"""Mixing sources to target weights by soft membership and nonnegative document rates.

A softmax classifier, trained on a bounded sample of the labelled table, gives every document a
posterior over the label's domains. With rate r_i (expected copies of document i), t_i tokens and
posterior p_i, domain k is expected to have sum_i r_i t_i p_ik tokens; least squares against the
target totals is solved over r >= 0 by projected gradient steps from r = 1, scaled by the inverse of
the K x K Hessian, the sum of t p p^T over the documents with a rate above 0. The projection is
taken of the sum of all steps, so that a document needs only that K-vector, and one small sum goes
back. Steps end when each domain is within `tolerance` of its own target, or when the least-squares
residual is proven or the projected gradient has vanished; what is left then is given as a warning.

Defined cases: null and empty texts have no tokens, posterior of the empty text and rate 1 (they
move no total); labels that name no document are ignored, several labels of one doc_id take the
largest; without labels there is one domain and all rates are equal; targets are shares and are
normalised, domains without a target get 0; repeated documents have a rate each; extra columns
are ignored, but for those named in `carry`.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm import linear, textkit
from lumenloom.llm.common import bounded_sample, give_back, materialize

BUCKETS = 2048


def domain_of(quality: Column, toxic: Column) -> Column:
    """The default domains: toxic, rough (low quality) and good."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "rough").when(quality == 1, "good")


def train(docs: DataFrame, domains: DataFrame, *, doc_id: str = "doc_id", text: str = "text", domain: str = "domain", per_class: int = 800, max_bytes: int = 16 << 20) -> dict:
    """domains: (doc_id, domain). The sample is weighted back to the shares of all labelled rows."""
    usable = domains.where(F.col(domain).isNotNull()).groupBy(doc_id).agg(F.max(domain).alias("known_domain"))
    counts = {r[0]: r[1] for r in usable.groupBy("known_domain").count().collect()}
    sample = bounded_sample(docs, usable, doc_id=doc_id, text=text, label="known_domain", per_class=per_class, max_bytes=max_bytes, seed=4)
    names = sorted(sample["label"].unique()) or ["all"]
    model = {"names": names, "weights": np.zeros((BUCKETS, len(names)), np.float32), "bias": np.zeros(len(names), np.float32)}
    if len(names) < 2:
        return model
    x = linear.matrix(sample["text"].fillna("").tolist(), linear.token_features, BUCKETS)
    index = np.searchsorted(names, sample["label"])
    weight = np.array([counts[n] for n in names])[index] / np.bincount(index)[index]
    weights, bias = linear.fit_softmax(x, index, len(names), weight)
    return model | {"weights": weights, "bias": bias}


def posteriors(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, posterior array in the order of the model's names, carried columns)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<n_tokens:long,posterior:array<double>>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        give_back()
        model = shipped.value
        column = pa.array(texts, pa.large_string(), from_pandas=True)
        amount = np.zeros(len(texts), np.int64)

        def features() -> Iterator[tuple[textkit.Segment, np.ndarray, np.ndarray]]:
            for seg, hashes, piece, tokens in textkit.token_grams(column):
                np.add.at(amount, seg.rows, tokens)
                yield seg, piece, (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)

        p = linear.softmax(linear.applied(features(), len(texts), model["weights"], model["bias"]))
        return pd.DataFrame({"n_tokens": amount, "posterior": list(p)})

    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), *[F.col(f"`{c}`") for c in carry], predicted(F.col(f"`{text}`")).alias("p"))
    return rows.select(doc_id, *carry, "p.n_tokens", "p.posterior")


def _replay(posterior: np.ndarray, errors: list[np.ndarray], rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the projected steps with these domain errors, and the next point."""
    r = y = np.ones(len(posterior))
    for n, e in enumerate(errors):
        stepped = np.maximum(0.0, y - rate * (posterior @ e))
        y = stepped + n / (n + 3) * (stepped - r)
        r = stepped
    return r, y


#: Weight of the distance from rate 1 beside the squared errors, step lengths tried at
#: once, and the share of the residual that may stay unproven.
NEAR_ONE, HALVINGS, UNPROVEN = 1e-10, 8, 0.01


def fit_rates(rows: DataFrame, names: list[str], targets: dict[str, float], *, total_tokens: float | None = None, steps: int | None = None, tolerance: float = 1e-3) -> list[np.ndarray]:
    """The summed step, as a list; rates follow from it by _replay.

    steps: a limit on the rounds, none by default. A domain of target 0 may have `tolerance` of the
    smallest other target.
    """
    tokens = float(rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    if not tokens:
        return []
    wanted = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    if not wanted.sum():
        wanted = np.ones(len(names))
    wanted = wanted / wanted.sum() * (total_tokens or tokens) / tokens
    allowed = tolerance * np.where(wanted > 0, wanted, wanted[wanted > 0].min())
    k = len(names)
    width = 1 + k + k * k

    def look(points: list[np.ndarray], probe: np.ndarray) -> tuple[np.ndarray, float]:
        """For every point half the squared rates, domain totals and Hessian; and the least p . probe."""

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, least = np.zeros((len(points), width)), np.inf
            for f in frames:
                f = f[f["n_tokens"] > 0]
                if len(f):
                    p, t = np.stack(f["posterior"].to_numpy()), f["n_tokens"].to_numpy(float) / tokens
                    least = min(least, float((p @ probe).min()))
                    for row, point in zip(total, points, strict=True):
                        r = _replay(p, [point], 1.0)[0]
                        row[0] += (t * r * r).sum() / 2
                        row[1 : k + 1] += (r * t) @ p
                        row[k + 1 :] += ((p * (t * (r > 0))[:, None]).T @ p).ravel()
            yield pd.DataFrame([[least, *total.ravel()]], columns=columns)

        columns = ["least", *[f"s{n}" for n in range(len(points) * width)]]
        found = rows.select("n_tokens", "posterior").mapInPandas(sums, ", ".join(f"{c} double" for c in columns))
        got = found.agg(F.min("least"), *[F.sum(c) for c in columns[1:]]).first()
        return np.array(got[1:], float).reshape(len(points), width), float(got[0])

    at, step, slope, value, error = np.zeros(k), np.zeros(k), 0.0, np.inf, np.zeros(k)
    lengths = np.array([1.0])
    taken = 0
    while True:
        points = [at + a * step for a in lengths]
        found, least = look(points, error)
        if taken:
            bound = error + max(0.0, -least)
            size = np.linalg.norm(error)
            if -(wanted @ bound) >= (1 - UNPROVEN) * size * np.linalg.norm(bound):
                break
        values = found[:, 0] + [wanted @ q + NEAR_ONE / 2 * q @ q for q in points]
        good = np.flatnonzero(values <= value + 1e-4 * lengths * slope)
        if not len(good):
            if lengths[-1] < 1e-12:
                break
            lengths = lengths * 0.5**HALVINGS
            continue
        best = int(good[0])
        at, value, error = points[best], values[best], found[best, 1 : k + 1] - wanted
        if (np.abs(error) <= allowed).all():
            return [at]
        gradient = NEAR_ONE * at - error
        if np.abs(gradient).max() <= 1e-3 * allowed.min() or taken == steps:
            break
        step = -np.linalg.solve(found[best, k + 1 :].reshape(k, k) + NEAR_ONE * np.eye(k), gradient)
        slope, lengths, taken = float(gradient @ step), 0.5 ** np.arange(HALVINGS), taken + 1
    left = ", ".join(f"{n} {e:+.3g} of {w:.3g}" for n, e, w in zip(names, error, wanted, strict=True))
    warnings.warn(f"targets not met after {taken} steps; least-squares residual {np.linalg.norm(error):.3g} of all tokens: {left}", stacklevel=2)
    return [at]


def with_rates(rows: DataFrame, names: list[str], errors: list[np.ndarray]) -> DataFrame:
    @F.pandas_udf("double")
    def rate(posterior: pd.Series) -> pd.Series:
        if not len(posterior):
            return pd.Series([], dtype=float)
        return pd.Series(_replay(np.stack(posterior.to_numpy()), errors, 1.0)[0])

    names_column = F.array(*[F.lit(n) for n in names])
    likeliest = F.get(names_column, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int"))
    return rows.withColumn("domain", likeliest).withColumn("rate", F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(rate("posterior")))


TARGETS = {"good": 0.92, "rough": 0.07, "toxic": 0.01}


def rates(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", targets: dict[str, float] | None = None, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document: doc_id, n_tokens, posterior, domain (the likeliest), rate."""
    domains = labels.select(F.col(doc_id), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    model = train(docs, domains, doc_id=doc_id, text=text)
    rows = materialize(posteriors(docs, model, doc_id=doc_id, text=text, carry=carry), "posteriors")
    errors = fit_rates(rows, model["names"], targets or TARGETS, **options)
    return with_rates(rows, model["names"], errors)
