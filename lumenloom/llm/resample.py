"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens (runs of word bytes or of punctuation) and neighbouring pairs are hashed to `BUCKETS`. Raw
counts cover every document, target counts every labelled row of the target class; a document's
importance is the log ratio of both models over its n-grams. Adding Gumbel noise drawn from the
document id and keeping the k largest keys samples k documents without replacement in proportion to
their importance. The k-th key is found exactly by counting keys in ever narrower ranges.

Defined cases: null and empty texts have no n-grams and log ratio 0; without target rows the
models coincide and the sample is uniform; ties with the k-th key are all selected; repeated rows
have equal keys and share their fate, null ids draw the noise of the id null; k above the number of
rows selects all; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenloom.llm import textkit
from lumenloom.llm.common import materialize

BUCKETS = 10_000
#: Rows of 64 slots that a broadcast set of target ids may have: 4 MB.
SET_ROWS = 1 << 18


def _buckets(column: pa.Array) -> Iterator[tuple[textkit.Segment, np.ndarray, np.ndarray]]:
    for seg, hashes, piece, _ in textkit.token_grams(column):
        yield seg, ((hashes >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), piece


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, bucket, _ in _buckets(batch.column(0)):
            totals += np.bincount(bucket, minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"bucket": np.arange(BUCKETS), "n": totals})


def counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts of a one-column table; one row for each bucket and
    task is all that is shuffled."""
    found = texts.mapInArrow(_counting, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[found["bucket"]] = found["n"]
    return total


def _target_texts(docs: DataFrame, target_ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The texts of the target rows.

    A set of slots, 64 in a row, is broadcast only if it has at most SET_ROWS rows (4 MB). Whole
    numbers are their own slots while that fits, and no text is shuffled. Otherwise slots are hashes
    into a set of the same bound, and texts that pass meet the ids in a join.
    """
    ids = target_ids.select(F.col(doc_id).alias("target_id")).where("target_id is not null").distinct()
    bare = docs.select(F.col(f"`{doc_id}`").alias("of"), F.col(f"`{text}`").alias("text")).where("of is not null")

    def slots_of(slot: Column) -> DataFrame:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        return ids.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))

    def passing(slot: Column, words: DataFrame) -> DataFrame:
        hit = F.call_function("shiftright", F.col("bits"), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return bare.join(F.broadcast(words), F.shiftright(slot, 6) == F.col("word")).where(hit)

    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        words = slots_of(F.col("target_id").cast("long"))
        if words.count() <= SET_ROWS:
            return passing(F.col("of").cast("long"), words).select("text")
    hashed = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(64 * SET_ROWS))
    return passing(hashed("of"), slots_of(hashed("target_id"))).join(ids, F.col("of") == F.col("target_id"), "left_semi").select("text")


def log_ratios(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """log(target / raw) of each bucket, both smoothed, over all documents and all target rows."""
    target = counts(_target_texts(docs, target_ids, doc_id, text))
    if not target.any():
        return np.zeros(BUCKETS)
    raw, target = counts(docs.select(F.col(f"`{text}`"))) + 1.0, target + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def scored(docs: DataFrame, ratios: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> DataFrame:
    """One row per document: doc_id, n_grams, log_ratio, key (log ratio and Gumbel noise)."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)

    @F.pandas_udf("struct<n_grams:long,log_ratio:double>")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        total, amount = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for seg, bucket, piece in _buckets(pa.array(texts, pa.large_string(), from_pandas=True)):
            np.add.at(total, seg.rows, np.bincount(piece, shipped.value[bucket], minlength=len(seg.rows)))
            np.add.at(amount, seg.rows, np.bincount(piece, minlength=len(seg.rows)))
        return pd.DataFrame({"n_grams": amount, "log_ratio": total})

    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), uniform.alias("u"), weigh(F.col(f"`{text}`")).alias("w"))
    return rows.select(doc_id, "w.n_grams", "w.log_ratio", (F.col("w.log_ratio") - F.ln(-F.ln("u"))).alias("key"))


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The exact k-th largest value; each round counts one row for each of `bins` ranges."""
    if k <= 0:
        return math.inf
    span = keys.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n")).first()
    if span["n"] <= k:
        return -math.inf
    lo, hi, left = span["lo"], span["hi"], k
    while lo < hi:
        place = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
        found = keys.where(F.col(column).between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):
            if r["n"] >= left:
                lo, hi = r["lo"], r["hi"]
                break
            left -= r["n"]
    return lo


def select(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", k: int | None = None, seed: int = 3) -> DataFrame:
    """One row per document: doc_id, n_grams, log_ratio, key, selected.

    By default k follows the labels: the share of target rows among labelled ones times all rows.
    """
    target = labels.where(F.col(quality) == 1)
    rows = materialize(scored(docs, log_ratios(docs, target, doc_id=doc_id, text=text), doc_id=doc_id, text=text, seed=seed), "scored")
    if k is None:
        share = labels.where(F.col(quality).isNotNull()).agg(F.avg(F.when(F.col(quality) == 1, 1.0).otherwise(0.0))).first()[0]
        k = math.ceil((1.0 if share is None else share) * rows.count())
    return rows.withColumn("selected", F.col("key") >= F.lit(kth_largest(rows, "key", k)))
