"""Periodic runs of words, by enumeration of maximal pairs over LCP-interval trees.

A run is a stretch of words with smallest period q, at least max(shortest, 2 q) words long, that no
neighbouring word extends. Two places d apart whose common continuation has l words form a maximal
pair if neither the words before nor those behind agree; the stretch of d + l words from the first is
then a stretch of period d that can't be extended. So the maximal pairs with d <= l and d + l >=
shortest are the runs, found once for each multiple of their period; of pairs with the same stretch the
least distance is the period.

Such pairs have l >= shortest / 2, so suffixes are first grouped by that many words, and only those in
groups of two or more are sorted further, by doubling; the ranks of each doubling also give the common
prefixes of neighbours. The tree of LCP intervals is walked bottom-up without being built. An interval
keeps the places of its suffixes in order, and by left word; where intervals meet, each place of the
smaller asks the larger one for places within l of it whose left word differs, and stretches of one left
word are leapt over by doubling steps. A document costs O(n log n) for sorting, and a logarithm for each
place moved and pair found.

Documents are independent: no row is shuffled, and texts are taken some at a time.

Defined cases: null and empty texts and texts of white space have no words, no runs and an empty
collapsed text; the words of a text with dropped words are joined by single spaces, any other text is
collapsed the same way; repeated ids keep a row each; a null doc_id is a row like any other; ties
between runs are by start, then period; memory follows a slice of texts (`slice_bytes`) or the longest
single one (four bytes a word for each doubling of its longest repeat); an empty table gives an empty
table; columns of docs beyond the text pass through `runs` whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenloom.llm.common import give_back

SHORTEST = 12
SLICE_BYTES = 1 << 20


class Places:
    """Places of an interval in ascending order, all together and by the word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all = [place]
        self.by_left = {left: [place]}

    def differing(self, place: int, left: int, reach: int) -> Iterator[int]:
        """The places within reach of the given one that another word stands before."""
        places, same = self.all, self.by_left.get(left, [])
        at, end, other = bisect_left(places, place - reach), place + reach, 0
        while at < len(places) and places[at] <= end:
            other = bisect_left(same, places[at], other)
            if other == len(same) or same[other] != places[at]:
                yield places[at]
                at += 1
                continue
            # From here both lists agree up to the end of the stretch of that left word.
            step = 1
            while other + step < len(same) and at + step < len(places) and same[other + step] == places[at + step]:
                step *= 2
            low = step // 2
            while low < step - 1:
                middle = (low + step) // 2
                if other + middle < len(same) and at + middle < len(places) and same[other + middle] == places[at + middle]:
                    low = middle
                else:
                    step = middle
            at += low + 1

    def take(self, other: Places) -> None:
        for place in other.all:
            insort(self.all, place)
        for left, places in other.by_left.items():
            mine = self.by_left.setdefault(left, places)
            if mine is not places:
                for place in places:
                    insort(mine, place)


def maximal_pairs(order: list[int], common: list[int], left: list[int], least: int, reach_of=lambda shared: shared) -> Iterator[tuple[int, int, int]]:
    """(i, j, l) with i < j: maximal pairs of suffixes of one sorted group with l >= least and j - i <= l.

    order: places in suffix order; common[k]: the common prefix of order[k - 1] and order[k]; left: a
    number for the word before each of them, that of a text's first place its own.
    """

    def met(into: Places, more: Places, shared: int) -> Iterator[tuple[int, int, int]]:
        for word, places in more.by_left.items():
            for place in places:
                for found in into.differing(place, word, reach_of(shared)):
                    yield (place, found, shared) if place < found else (found, place, shared)

    #: Open intervals, outermost first: their common prefix and places.
    stack: list[tuple[int, Places]] = []
    held: Places | None = None
    for k in range(len(order) + 1):
        shared = common[k] if 0 < k < len(order) else 0
        # Intervals that end before k pass their places to the next one outwards, while that is as deep.
        while stack and stack[-1][0] > shared:
            depth, places = stack.pop()
            small, large = sorted((places, held), key=lambda p: len(p.all))
            yield from met(large, small, depth)
            large.take(small)
            held = large
        if held is not None and shared >= least:
            if stack and stack[-1][0] == shared:
                small, large = sorted((stack[-1][1], held), key=lambda p: len(p.all))
                yield from met(large, small, shared)
                large.take(small)
                stack[-1] = (shared, large)
            else:
                stack.append((shared, held))
        held = Places(order[k], left[k]) if k < len(order) else None


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    kept = keys[order]
    new = np.concatenate(([0], np.cumsum(kept[1:] != kept[:-1]))) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = new
    return out


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """The rank so many places on; beyond the last place -1."""
    return np.concatenate((ranks[by:], np.full(min(by, len(ranks)), -1, np.int64)))


def repeats(words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in suffix order, common prefixes) of the groups of suffixes that share `least` words.

    words: numbers in [0, n), texts separated by numbers that stand once. All common prefixes are exact.
    """
    n = len(words)
    levels = [(1, words.astype(np.int64))]
    while levels[-1][0] * 2 <= least:
        width, ranks = levels[-1]
        levels.append((width * 2, _ranks(ranks * (n + 1) + _shifted(ranks, width) + 1)))
    width, ranks = levels[-1]
    first = ranks
    while width < least:
        step, part = next((w, r) for w, r in reversed(levels) if w <= least - width)
        first, width = _ranks(first * (n + 1) + _shifted(part, width) + 1), width + step
    size = np.bincount(first, minlength=1)
    open_ = np.flatnonzero(size[first] > 1)
    if not len(open_):
        return
    # Suffixes alone in their group are sorted; the others go on by doubling, in shrinking number.
    ranks, tied = levels[-1][1], open_
    width = levels[-1][0]
    group, tail = first, least
    levels = [(w, r.astype(np.int32)) for w, r in levels]
    current = first
    while len(tied):
        # current ranks suffixes by their first `tail` words.
        following = np.minimum(tied + tail, n - 1)
        keys = current[tied] * (n + 1) + np.where(tied + tail < n, current[following], -1) + 1
        order = np.argsort(keys, kind="stable")
        kept = keys[order]
        fresh = np.concatenate(([True], kept[1:] != kept[:-1]))
        groups = current[tied][order]
        begins = np.concatenate(([True], groups[1:] != groups[:-1]))
        at = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(begins, at, 0))
        mine = np.maximum.accumulate(np.where(fresh, at, 0)) - start
        levels.append((tail, current.astype(np.int32)))
        if tail == least:
            # Ranks become places among all suffixes, so that groups can be split in place.
            offset = np.concatenate(([0], np.cumsum(size)[:-1]))
            current = offset[current]
            group = current.copy()
        else:
            current = current.copy()
        current[tied[order]] = current[tied[order]] + mine
        tail *= 2
        counts = np.diff(np.concatenate((np.flatnonzero(fresh), [len(tied)])))
        tied = tied[order][np.repeat(counts > 1, counts)]
    order = open_[np.argsort(current[open_], kind="stable")]
    groups = group[order]
    common = np.zeros(len(order), np.int64)
    near = np.flatnonzero(groups[1:] == groups[:-1]) + 1
    a, b = order[near - 1].copy(), order[near].copy()
    for width, ranks in sorted(levels, key=lambda level: -level[0]):
        inside = np.maximum(a, b) < n
        equal = np.flatnonzero(inside)
        equal = equal[ranks[a[equal]] == ranks[b[equal]]]
        common[near[equal]] += width
        a[equal] += width
        b[equal] += width
    cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield order[i:j], common[i:j]


def runs_of(texts: list[list[bytes]], shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    number: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    for words, end in zip(texts, ends.tolist()):
        flat[end - 1 - len(words) : end - 1] = [number.setdefault(w, len(number)) for w in words]
    text = np.repeat(np.arange(len(texts)), sizes)
    # The same word in two texts is two numbers; an end of text stands once.
    flat = text * (len(number) + 1) + flat
    flat[ends - 1] = (len(texts) + 1) * (len(number) + 1) + np.arange(len(texts))
    flat = _ranks(flat)
    before = np.concatenate(([-1], flat[:-1]))
    least = -(-shortest // 2)
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    for order, common in repeats(flat, least):
        k = int(text[order[0]])
        begin = int(ends[k] - sizes[k])
        for i, j, shared in maximal_pairs(order.tolist(), common.tolist(), before[order].tolist(), least):
            far = j - i
            if far + shared >= shortest:
                stretch = (i - begin, far + shared)
                found[k][stretch] = min(far, found[k].get(stretch, far))
    return [sorted((start, length, period) for (start, length), period in of.items()) for of in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run the first period stays."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def _finder(shortest: int, slice_bytes: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])
            total = np.cumsum(sizes)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + slice_bytes, side="right")))
                words = [t.as_py().split() for t in texts.slice(i, j - i)]
                runs = runs_of(words, shortest)
                flat = [r for of in runs for r in of]
                columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(of) for of in runs]))), pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=["start", "length", "period"]))
                made = {"row": batch.column("row").slice(i, j - i), "n_words": pa.array(list(map(len, words)), pa.int64()), "runs": listed.cast(kind), "collapsed": pa.array(list(map(collapsed, words, runs)), pa.binary())}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
                i = j
            give_back()

    return run


def runs(docs: DataFrame, *, text: str = "text", shortest: int = SHORTEST, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """row (a struct of all columns of docs but the text), n_words, runs (start, length, period; by start,
    then period) and collapsed: the text without what its runs repeat."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    given = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    schema = StructType([given.schema["row"], *StructType.fromDDL("n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary").fields])
    return given.mapInArrow(_finder(shortest, slice_bytes), schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def longest(found: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def report(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_runs, its longest run (start, length, period, exponent_milli) and
    the digests of all runs and of the collapsed text."""
    found = runs(docs, **options)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = longest(F.col("runs"))
    return found.select(
        F.col(f"row.`{doc_id}`").alias(doc_id),
        F.size("runs").cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000).cast("long") * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
