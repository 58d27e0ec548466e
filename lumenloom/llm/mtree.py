"""Exact top-k by inner product with M-trees searched best first.

Vectors become integers, floor(256 x). An extra coordinate sqrt(M^2 - |x|^2), M the largest norm of all
vectors (0 for queries), turns the largest inner products into the smallest Euclidean distances, a
metric. The top of the M-tree is a list of pivots: every vector belongs to its nearest pivot, and
such a shard has a covering radius. A shard is built once, as an M-tree of pages: routing nodes hold
a pivot, a covering radius and the distance to their parent's pivot, leaves hold vectors and their
distances to the pivot. The search takes the page with the least possible distance first; stored
distances and the triangle inequality rule out pages and vectors before their own distance is
computed.

Queries descend in two rounds. In the first, each goes to the few shards of least distance bound and
comes back with k scores, the worst of which no result may fall below. In the second it goes to the
other shards, but only to those whose covering radius admits a better score: so a query visits shards
that can hold results, and a vector travels once. Scores are exact integers; bounds have slack for
rounding, so the result is exact.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors
are compared with those of their own length, an empty vector scores 0; a query never finds its own
row, but finds a repetition of it; ties go to the smaller vec_id, null ids last; extra columns are
ignored. Scores beyond 64 bits are clipped.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.llm.common import give_back, materialize

FANOUT = 16
PAGE = 1024
NO_ID = (1 << 63) - 1


def integers(vector: Column) -> Column:
    """floor(256 x) of each component, null where the vector takes no part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows with one query."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * rows.shape[1]
    if largest < 1 << 53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    wide = rows.astype(object) @ query.astype(object)
    return np.array([max(-NO_ID - 1, min(NO_ID, int(v))) for v in wide], np.int64)


def lifted(rows: np.ndarray, peak: float) -> np.ndarray:
    """The rows with the extra coordinate; peak: the largest squared norm."""
    plain = rows.astype(np.float64)
    return np.column_stack((plain, np.sqrt(np.maximum(peak - (plain**2).sum(axis=1), 0))))


class MTree:
    """An M-tree over the rows of an integer matrix; peak: the largest squared norm of all shards."""

    def __init__(self, rows: np.ndarray, peak: float | None = None, seed: int = 2):
        self.rows = rows
        self.plain = rows.astype(np.float64)
        self.peak = float((self.plain**2).sum(axis=1).max(initial=0)) if peak is None else peak
        points = lifted(rows, self.peak)
        self.exact = float(np.abs(self.plain).max(initial=0)) ** 2 * max(1, rows.shape[1]) < 1 << 50
        self.pivot: list[np.ndarray] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[tuple[np.ndarray, np.ndarray] | None] = []
        rng = np.random.default_rng(seed)
        stack = [(np.arange(len(rows)), -1)] if len(rows) else []
        while stack:
            members, parent = stack.pop()
            at = len(self.pivot)
            centre = points[members].mean(axis=0)
            pivot = points[members[((points[members] - centre) ** 2).sum(axis=1).argmin()]]
            far = np.sqrt(((points[members] - pivot) ** 2).sum(axis=1))
            self.pivot.append(pivot)
            self.radius.append(float(far.max()))
            self.to_parent.append(float(np.sqrt(((pivot - self.pivot[parent]) ** 2).sum())) if parent >= 0 else 0.0)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(at)
            if len(members) <= PAGE:
                self.leaf.append((members, far))
                continue
            self.leaf.append(None)
            heads = points[rng.choice(members, min(FANOUT, len(members)), replace=False)]
            near = (-2 * points[members] @ heads.T + (heads**2).sum(axis=1)).argmin(axis=1)
            parts = [members[near == k] for k in np.unique(near)]
            if len(parts) == 1:  # equal vectors can't be told apart
                parts = np.array_split(members, FANOUT)
            stack += [(part, at) for part in parts]
        self._page = [(np.array([self.pivot[c] for c in kids]), np.array([self.to_parent[c] for c in kids]), np.array([self.radius[c] for c in kids]), np.array(kids)) if kids else None for kids in self.children]

    def packed(self) -> dict:
        """The pages as plain values, the rows in as few bytes as they need."""
        kind = np.promote_types(np.min_scalar_type(self.rows.min(initial=0)), np.min_scalar_type(self.rows.max(initial=0)))
        return self.__dict__ | {"plain": None, "rows": self.rows.astype(kind)}

    @classmethod
    def unpacked(cls, pages: dict) -> MTree:
        tree = cls.__new__(cls)
        tree.__dict__ |= pages
        tree.rows = tree.rows.astype(np.int64)
        tree.plain = tree.rows.astype(np.float64)
        return tree

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own: int, floor: int | None = None) -> list[tuple[int, int, int]]:
        """The k best (score, id, row) of one query, but for the row numbered own; with a floor, only
        scores that reach it."""
        if not len(self.rows):
            return []
        q = np.append(query.astype(np.float64), 0.0)
        level = float(q @ q) + self.peak
        slack = 1e-9 * (level + 1)
        best: list[tuple[int, int, int]] = []  # a heap, the worst first, as (score, -id, -row)

        def limit() -> float:
            worst = best[0][0] if len(best) == k else floor
            if floor is not None and worst is not None:
                worst = max(worst, floor)
            return np.inf if worst is None else float(np.sqrt(max(0.0, level - 2 * worst) + slack))

        reach = limit()
        first = float(np.sqrt(((q - self.pivot[0]) ** 2).sum()))
        queue = [(max(0.0, first - self.radius[0]), 0, first)]
        while queue:
            bound, node, far = heapq.heappop(queue)
            if bound > reach + slack**0.5:
                break
            if (leaf := self.leaf[node]) is not None:
                members, to_pivot = leaf
                members = members[np.abs(far - to_pivot) <= reach + slack**0.5]
                members = members[members != own]
                if not len(members):
                    continue
                scores = (self.plain[members] @ q[:-1]).astype(np.int64) if self.exact else inner(self.rows[members], query)
                least = best[0][0] if len(best) == k else floor
                if least is not None:
                    keep = scores >= least
                    members, scores = members[keep], scores[keep]
                if len(scores) > k:
                    pick = np.lexsort((members, ids[members], -scores))[:k]
                    members, scores = members[pick], scores[pick]
                for s, m in zip(scores.tolist(), members.tolist(), strict=True):
                    entry = (s, -int(ids[m]), -m)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                reach = limit()
                continue
            pivots, to_parent, radius, kids = self._page[node]
            open_ = np.abs(far - to_parent) - radius <= reach + slack**0.5
            pivots, radius, kids = pivots[open_], radius[open_], kids[open_]
            d = np.sqrt(((pivots - q) ** 2).sum(axis=1))
            least = np.maximum(0.0, d - radius)
            for b, c, f in zip(least.tolist(), kids.tolist(), d.tolist(), strict=True):
                if b <= reach + slack**0.5:
                    heapq.heappush(queue, (b, c, f))
        return sorted(((s, -i, -m) for s, i, m in best), key=lambda e: (-e[0], e[1], e[2]))


class Top:
    """The pivots of one length of vectors, and the radius and the number of parts of each shard."""

    def __init__(self, pivots: np.ndarray, peak: float):
        self.pivots, self.peak = pivots, peak
        self.radius = np.full(len(pivots), -1.0)
        self.parts = np.ones(len(pivots), np.int64)

    def nearest(self, rows: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Shard and distance of every row."""
        shard, far = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for i in range(0, len(rows), block):
            d = self.distances(lifted(rows[i : i + block], self.peak))
            shard[i : i + block] = d.argmin(axis=1)
            far[i : i + block] = d.min(axis=1)
        return shard, far

    def distances(self, points: np.ndarray) -> np.ndarray:
        squares = (points**2).sum(axis=1)[:, None] - 2 * points @ self.pivots.T + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The least distance that a row of each shard can have from each query, less the slack."""
        points = np.column_stack((queries.astype(np.float64), np.zeros(len(queries))))
        slack = 1e-6 * (1 + np.sqrt((points**2).sum(axis=1) + self.peak))
        bound = np.maximum(0.0, self.distances(points) - self.radius - slack[:, None])
        return np.where(self.radius < 0, np.inf, bound)

    def reach(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """The distance beyond which no row has the score `floor`; without a floor all are in reach."""
        level = (queries.astype(np.float64) ** 2).sum(axis=1) + self.peak
        far = np.sqrt(np.maximum(0.0, level - 2.0 * np.nan_to_num(floor))) + 1e-6 * (1 + np.sqrt(level))
        return np.where(np.isnan(floor), np.inf, far)


def _matrix(ints: pd.Series, dim: int) -> np.ndarray:
    return np.stack(ints.to_numpy()).astype(np.int64).reshape(len(ints), dim) if len(ints) else np.zeros((0, dim), np.int64)


def _search(k: int):
    def run(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_key", "query_id", "vec_id", "row_key", "score"]
        give_back()
        if not len(trees) or not len(asked):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
        pages, keys, ids = pickle.loads(trees["tree"].iloc[0])
        tree = MTree.unpacked(pages)
        found = []
        for key, name, ints, floor in zip(asked["row_key"], asked["vec_id"], asked["ints"], asked["floor"], strict=True):
            at = int(np.searchsorted(keys, key))
            own = at if at < len(keys) and keys[at] == key else -1
            least = None if pd.isna(floor) else int(np.floor(floor))
            found += [(key, name, i, int(keys[m]), s) for s, i, m in tree.search(np.asarray(ints, np.int64), k, ids, own, least)]
        return pd.DataFrame(found, columns=columns, dtype="int64")

    return run


#: Shards that a query visits before its worst score is known, and queries of a search task.
FIRST, QUERIES = 2, 4096


def _pivots(rows: DataFrame, n: int, dim: int, shards: int) -> pd.DataFrame:
    """The vectors of the `shards` rows of least hash; of a large table only rows below a bound are ordered."""
    drawn = F.xxhash64("row_key", F.lit(7))
    mine = rows.where(F.col("dim") == dim)
    if n > 4 * shards + 1000:
        mine = mine.where(drawn / F.lit(2.0**64) + F.lit(0.5) <= F.lit((4.0 * shards + 100) / n))
    return mine.orderBy(drawn, "row_key").limit(shards).select("ints").toPandas()["ints"]


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, shard_rows: int = 8192, most_shards: int = 1024) -> DataFrame:
    """The k best other rows of every row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Vectors of each length have one pivot for about shard_rows of them, at most most_shards: pivots,
    radii and counts are all that the driver holds. A shard of far more rows is split by row_key into
    parts, each a tree of its own, and the queries of a tree into blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col(f"`{vec_id}`").cast("long"), F.lit(NO_ID)).alias("vec_id"), integers(F.col(f"`{vector}`")).alias("ints")).where("ints is not null")
    rows = materialize(rows.withColumn("row_key", F.monotonically_increasing_id()).withColumn("dim", F.size("ints")), "vectors")
    square = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    tops: dict[int, Top] = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(square).alias("peak")).collect():
        shards = max(1, min(most_shards, -(-r["n"] // shard_rows)))
        picked = _matrix(_pivots(rows, r["n"], r["dim"], shards), r["dim"])
        tops[r["dim"]] = Top(np.unique(lifted(picked, r["peak"]), axis=0), r["peak"])
    pivots = spark.sparkContext.broadcast(tops)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["shard"], frame["far"] = 0, 0.0
            for dim, mine in frame.groupby("dim"):
                shard, far = pivots.value[dim].nearest(_matrix(mine["ints"], dim))
                frame.loc[mine.index, "shard"] = shard
                frame.loc[mine.index, "far"] = far
            yield frame

    dealt = materialize(rows.mapInPandas(placed, "vec_id long, ints array<long>, row_key long, dim int, shard long, far double"), "placed")
    counts = dealt.groupBy("dim", "shard").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    counts = materialize(counts.withColumn("parts", F.ceil(F.col("n") / F.lit(4 * shard_rows)).cast("long")), "shards")
    for r in counts.collect():
        tops[r["dim"]].radius[r["shard"]] = r["far"]
        tops[r["dim"]].parts[r["shard"]] = r["parts"]
    routes = spark.sparkContext.broadcast(tops)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        give_back()
        group = group.sort_values("row_key")
        dim = int(group["dim"].iloc[0])
        tree = MTree(_matrix(group["ints"], dim), routes.value[dim].peak)
        blob = pickle.dumps((tree.packed(), group["row_key"].to_numpy(), group["vec_id"].to_numpy()), protocol=5)
        return pd.DataFrame({"dim": [dim], "shard": group["shard"].iloc[:1].to_numpy(), "part": group["part"].iloc[:1].to_numpy(), "tree": [blob]})

    parted = dealt.join(counts.select("dim", "shard", "parts"), ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("row_key"), F.col("parts"))).drop("parts", "far")
    trees = materialize(parted.groupBy("dim", "shard", "part").applyInPandas(build, "dim int, shard long, part long, tree binary"), "trees")

    def routed(first: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for dim, mine in frame.groupby("dim"):
                    top, queries = routes.value[dim], _matrix(mine["ints"], dim)
                    bound = top.bounds(queries)
                    rank = bound.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
                    go = np.isfinite(bound) & ((rank < FIRST) if first else (rank >= FIRST) & (bound <= top.reach(queries, mine["floor"].to_numpy(float))[:, None]))
                    query, shard = np.nonzero(go)
                    times = top.parts[shard]
                    out = mine.iloc[np.repeat(query, times)].copy()
                    out["shard"] = np.repeat(shard, times)
                    out["part"] = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
                    yield out

        return run

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        schema = "vec_id long, ints array<long>, row_key long, dim int, floor double, shard long, part long"
        sent = materialize(queries.select("vec_id", "ints", "row_key", "dim", "floor").mapInPandas(routed(first), schema), "asked")
        place = ["dim", "shard", "part"]
        blocks = sent.groupBy(*place).agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("blocks"))
        asked = sent.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("row_key"), F.col("blocks")).cast("int")).drop("blocks")
        given = trees.join(blocks, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return given.groupBy(*place, "block").cogroup(asked.groupBy(*place, "block")).applyInPandas(_search(k), "query_key long, query_id long, vec_id long, row_key long, score long")

    queries = rows.where((F.col("vec_id") != NO_ID) & (F.col("vec_id") % every == 0)).withColumn("floor", F.lit(None).cast("double"))
    near = materialize(searched(queries, True), "near")
    order = W.partitionBy("query_key").orderBy(F.desc("score"), "vec_id", "row_key")
    # A little below the k-th score, as a double may not hold it.
    floor = F.col("score") - F.lit(1.0) - F.abs("score") * F.lit(1e-14)
    worst = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_key").alias("row_key"), floor.alias("floor"))
    again = searched(queries.drop("floor").join(worst, "row_key", "left"), False)
    ranked = near.unionAll(again).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
