"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked by BK-trees.

Fingerprints at a Hamming distance of at most 3 share some choice of bit blocks exactly, so each
distinct fingerprint stands in one shard for each choice. A shard is a BK-tree of nodes that hold
one fingerprint each: children hang on the integer distance to their parent, and a search with
radius r follows only the edges within r of the query's own distance. A shard's key is as many bits
of its blocks as leave about `tree_rows` fingerprints to a tree; when the blocks have no more bits,
there are more and longer choices, so trees keep their size as the corpus grows. Trees together are
all fingerprints, several times: a broadcast would bring them all through the driver, so the shuffle
brings each tree and its queries together instead. A shard above `shard_rows` is split into chunks,
and each pair of chunks is a tree and its queries of its own; only a spanning forest of the links
leaves a task, so groups of copies never become all their pairs.

Defined cases: null, empty and word-free texts have fingerprint zero and link like any other;
texts under three words hash their whole sequence; repeated doc_ids keep a row each; rows with a
null doc_id get the component of their fingerprint; extra columns are ignored by `groups`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenloom.llm.common import give_back, materialize, meet
from lumenloom.llm.components import connected_components, local_components

SEED = 42
SHINGLE_WORDS = 3
BITS = 64
#: Rows of 64 slots that a broadcast set of ids may have: 4 MB.
SET_ROWS = 1 << 18


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE_WORDS, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def each(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return each(text)


class BKTree:
    """A BK-tree over distinct fingerprints, one to a node."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.children: list[list[tuple[int, int]]] = [[] for _ in range(len(prints))]
        stack = [np.arange(len(prints))]
        while stack:
            rows = stack.pop()
            node, rest = int(rows[0]), rows[1:]
            if not len(rest):
                continue
            far = np.bitwise_count(self.prints[rest] ^ self.prints[node])
            order = np.argsort(far, kind="stable")
            rest, far = rest[order], far[order]
            cuts = [0, *(np.flatnonzero(far[1:] != far[:-1]) + 1).tolist(), len(rest)]
            for i, j in zip(cuts, cuts[1:]):
                self.children[node].append((int(far[i]), int(rest[i])))
                stack.append(rest[i:j])

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query index, member index) at most radius bits apart. Queries descend together: a node
        is met once with those of them that its edges admit."""
        found_q, found_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.visited = 0
        stack = [(0, np.arange(len(queries)))]
        while stack:
            node, asked = stack.pop()
            self.visited += len(asked)
            far = np.bitwise_count(queries[asked] ^ self.prints[node])
            hit = asked[far <= radius]
            if len(hit):
                found_q.append(hit)
                found_m.append(np.full(len(hit), node))
            if self.children[node]:
                order = np.argsort(far, kind="stable")
                asked, far = asked[order], far[order]
                for edge, child in self.children[node]:
                    i, j = far.searchsorted((max(0, edge - radius), edge + radius + 1))
                    if j > i:
                        stack.append((child, asked[i:j]))
        return np.concatenate(found_q), np.concatenate(found_m)


def _spanning(prints: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between prints[first] and prints[second] (indices)."""
    tree = BKTree(prints[second])
    label = np.arange(len(prints))
    for at in range(0, len(first), 512):
        part = first[at : at + 512]
        q, m = tree.within(prints[part], radius)
        label = local_components(len(prints), label[part[q]], label[second[m]])[label]
    linked = np.flatnonzero(label != np.arange(len(prints)))
    return prints[linked], prints[label[linked]]


def _link_jobs(radius: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def jobs(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            prints = rows["fp"].to_numpy(np.int64).view(np.uint64)
            changes = (rows[["key", "i", "j"]].to_numpy()[1:] != rows[["key", "i", "j"]].to_numpy()[:-1]).any(axis=1)
            starts = np.concatenate(([0], np.flatnonzero(changes) + 1, [len(rows)])).tolist()
            side, left, right = (rows[c].to_numpy() for c in ("c", "i", "j"))
            a, b = [], []
            for i, j in zip(starts, starts[1:]):
                if j - i > 1:
                    first, second = np.flatnonzero(side[i:j] == left[i:j]), np.flatnonzero(side[i:j] == right[i:j])
                    if len(first) and len(second):
                        x, y = _spanning(prints[i:j], first, second, radius)
                        a.append(x)
                        b.append(y)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

        held: pd.DataFrame | None = None
        for frame in frames:
            if not len(frame):
                continue
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held[["key", "i", "j"]].iloc[-1]
            open_from = int((held[["key", "i", "j"]] == last).all(axis=1).to_numpy().argmax())
            if open_from:
                yield from jobs(held.iloc[:open_from])
                held = held.iloc[open_from:].reset_index(drop=True)
        if held is not None:
            yield from jobs(held)

    return run


def block_keys(fp: Column, distinct: int, radius: int = 3, tree_rows: int = 512) -> Column:
    """Shard keys: every choice of the bit blocks that `radius` differing bits can leave equal, cut to
    the bits that leave about tree_rows of `distinct` fingerprints to a shard."""
    blocks, need = radius + 1, max(0, math.ceil(math.log2(max(1, distinct) / tree_rows)))
    while blocks < radius + 3 and BITS * (blocks - radius) // blocks < need:
        blocks += 1
    if not need:
        return F.array(F.struct(F.lit(0).alias("table"), F.lit(0).cast("long").alias("value")))
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - radius)):
        bits = [bit for k in kept for bit in range(edges[k], edges[k + 1])][:need]
        mask = sum(1 << bit for bit in bits)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(n).alias("table"), fp.bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*keys)


def links(prints: DataFrame, radius: int = 3, shard_rows: int = 4096, tree_rows: int = 512) -> DataFrame:
    """(a, b) links whose components are those of all pairs within radius; prints: distinct fp."""
    keys = prints.select("fp", F.explode(block_keys(F.col("fp"), prints.count(), radius, tree_rows)).alias("key")).select("fp", F.xxhash64("key.table", "key.value").alias("key"))
    busy = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / shard_rows).cast("int").alias("m"))
    rows = keys.join(busy, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    upper = F.transform(F.sequence("c", F.col("m") - 1), lambda j: F.struct(F.col("c").alias("i"), j.alias("j")))
    lower = F.when(F.col("c") > 0, F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(i.alias("i"), F.col("c").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    jobs = rows.select("fp", "key", "c", F.explode(F.concat(upper, lower)).alias("job")).select("fp", "key", "c", "job.i", "job.j")
    dealt = jobs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(_link_jobs(radius), "a long, b long").distinct()


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fp) of every row joined with component_id of its fingerprint."""
    rows = materialize(docs.select(F.col(f"`{doc_id}`").alias(doc_id), fingerprints(F.col(f"`{text}`")).alias("fp")), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min(doc_id).alias("first_id")), "prints")
    parts = connected_components(links(prints.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    known = prints.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = materialize(known.join(lowest, "component").select("fp", "component_id"), "classes")
    return meet(rows, named, "fp")


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    found = classes(docs, doc_id=doc_id, text=text, radius=radius)
    return found.select(doc_id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _without(row: DataFrame, gone: DataFrame, whole: bool) -> DataFrame:
    """The rows (row, of) whose id isn't among `gone`. Few ids are broadcast as sets of 64 slots a row, if
    they are whole numbers and fill at most SET_ROWS rows (4 MB); otherwise they meet in a shuffle."""
    if whole:
        slot = F.col("gone").cast("long")
        sets = gone.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
        if sets.count() <= SET_ROWS:
            of = F.col("of").cast("long")
            bit = F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), of.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
            return row.join(F.broadcast(sets), F.shiftright(of, 6) == F.col("word"), "left").where(F.col("of").isNull() | (bit == 0)).select("row", "of")
    return row.join(gone, F.col("of") == F.col("gone"), "left_anti")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One document of each component stays: that with the smallest doc_id, columns unchanged.

    Rows are decided one by one: rows that repeat a doc_id with unlike texts are in components of their
    own. Where several rows of a component share its smallest doc_id, that of the least fingerprint, then
    of the least hash of the text stays. Rows without a doc_id can't be told apart and all stay.
    """
    found = materialize(classes(docs, doc_id=doc_id, text=text, radius=radius).where(F.col(doc_id).isNotNull()), "found")
    repeated = materialize(found.groupBy(doc_id).count().where("count > 1").select(doc_id), "repeated")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col(f"row.`{doc_id}`").alias("of"))
    leaving = found.where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("gone"))
    several = repeated.limit(1).count() > 0
    gone = leaving.union(repeated.select(F.col(doc_id).alias("gone"))) if several else leaving
    kept = _without(row, materialize(gone.distinct(), "gone"), isinstance(docs.schema[doc_id].dataType, IntegralType))
    if not several:
        return kept.select("row.*")
    # Of ids that stand more than once every row is looked at again, by its fingerprint.
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col(doc_id).alias("of"), "fp")).alias("first")).select("first.of", "first.fp")
    first = materialize(first.join(repeated.select(F.col(doc_id).alias("of")), "of", "left_semi"), "first")
    again = row.join(first.select("of").distinct(), "of", "left_semi").withColumn("fp", fingerprints(F.col(f"row.`{text}`")))
    one = again.join(first, ["of", "fp"], "left_semi").groupBy("of", "fp").agg(F.min_by("row", F.xxhash64(f"row.`{text}`")).alias("row"))
    return kept.select("row").unionByName(one.select("row")).select("row.*")
