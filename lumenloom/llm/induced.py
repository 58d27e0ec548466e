"""External induced suffix sorting with common-prefix values.

Suffixes are typed as in SA-IS: S if smaller than the suffix behind it, else L. The S* suffixes (S
behind an L) are sorted first: the substrings between neighbours of them are named by external
sorting, and the text of names, a third as long, is sorted in the same way, recursively, until names
differ or a text of names fits in memory. All other suffixes are induced: suffix tuples leave a
priority queue by (first symbol, order of entry) and enter their predecessors, ascending for L, then
descending for S suffixes. A tuple carries its common prefix with the one before it: one more than
the least value met in the queue since the last entry of the same symbol.

Memory holds a queue's newest tuples, one block of every stream and small arrays; text, types, names,
orders and queues above that are files of a scratch folder, so a text may be far larger than memory.
Results are a stream of blocks. The scratch folder is the one that Spark gives a task for its own
spills: it holds nothing that another task reads, and Spark removes it with the executor.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

SENTINEL = 0
MEMORY = 128 << 20


class Scratch:
    """Arrays and files of one sort; arrays above `memory` / 8 bytes are files."""

    def __init__(self, memory: int):
        self.memory, self.folder, self.made = memory, None, 0
        self.block = max(64, min(1 << 18, memory // 64))

    def path(self) -> str:
        if self.folder is None:
            root = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=root if root and os.path.isdir(root) else None)
        self.made += 1
        return os.path.join(self.folder, str(self.made))

    def array(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.memory // 8:
            return np.zeros(n, kind)
        return np.memmap(self.path(), kind, "w+", shape=(n,))

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)
            self.folder = None


class Log:
    """Records in order of entry: a file behind an in-memory rest; read in blocks from either end."""

    def __init__(self, scratch: Scratch, kind):
        self.scratch, self.kind, self.file, self.in_file = scratch, np.dtype(kind), None, 0
        self.kept: list[np.ndarray] = []
        self.size = 0

    def __len__(self) -> int:
        return self.in_file + self.size

    def add(self, records: np.ndarray) -> None:
        self.kept.append(records)
        self.size += len(records)
        if self.size * self.kind.itemsize > self.scratch.memory // 8:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or self.scratch.path()
        with open(self.file, "ab") as out:
            for part in self.kept:
                part.astype(self.kind, copy=False).tofile(out)
        self.in_file, self.kept, self.size = self.in_file + self.size, [], 0

    def read(self, begin: int, end: int) -> np.ndarray:
        parts = []
        if begin < self.in_file:
            parts.append(np.fromfile(self.file, self.kind, min(end, self.in_file) - begin, offset=begin * self.kind.itemsize))
        if end > self.in_file:
            if len(self.kept) > 1:
                self.kept = [np.concatenate(self.kept)]
            parts.append(self.kept[0][max(0, begin - self.in_file) : end - self.in_file].astype(self.kind, copy=False))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, self.kind)

    def blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self), self.scratch.block):
            yield self.read(at, min(len(self), at + self.scratch.block))


RECORD = np.dtype([("major", np.uint64), ("minor", np.uint64), ("index", np.int64)])


def _lex(r: np.ndarray) -> np.ndarray:
    """Order of records by (major, minor)."""
    if not len(r) or r["major"][0] == r["major"][-1] and (r["major"] == r["major"][0]).all():
        return np.argsort(r["minor"])
    return np.lexsort((r["minor"], r["major"]))


def sorted_blocks(scratch: Scratch, blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """RECORDs in the order of (major, minor): runs of a bounded size are sorted, then merged."""
    runs: list[str] = []
    held, size = [], 0
    most = max(64, scratch.memory // (4 * RECORD.itemsize))

    def run() -> np.ndarray:
        r = np.concatenate(held)
        return r[_lex(r)]

    for block in blocks:
        held.append(block)
        size += len(block)
        if size > most:
            runs.append(scratch.path())
            run().tofile(runs[-1])
            held, size = [], 0
    if not runs:
        if held:
            yield run()
        return
    if held:
        runs.append(scratch.path())
        run().tofile(runs[-1])
    files = [np.memmap(path, RECORD, "r") for path in runs]
    at = [0] * len(files)
    part = max(16, most // len(files))
    while True:
        heads = [np.array(f[i : i + part]) for f, i in zip(files, at)]
        bound = min(((h["major"][-1], h["minor"][-1]) for h, f, i in zip(heads, files, at) if i + len(h) < len(f)), default=None)
        if bound is not None:
            heads = [h[: int(((h["major"] < bound[0]) | ((h["major"] == bound[0]) & (h["minor"] <= bound[1]))).sum())] for h in heads]
        at = [i + len(h) for i, h in zip(at, heads)]
        taken = np.concatenate(heads)
        if len(taken):
            yield taken[_lex(taken)]
        if bound is None:
            break
    del files
    for path in runs:
        os.unlink(path)


class DiskQueue:
    """A priority queue by (symbol, order of entry), taken symbol by symbol in one direction; entries
    are suffix positions with their common prefix. Up to 256 symbols have a log each; more symbols
    share logs by ranges, and a range is dealt out to a queue of its own when it is reached."""

    def __init__(self, symbols: int, scratch: Scratch, position):
        self.scratch, self.shift = scratch, max(0, (symbols - 1).bit_length() - 9)
        self.position = position
        self.kind = np.dtype([("at", position), ("lcp", np.uint8)] + ([("symbol", np.uint32)] if self.shift else []))
        self.logs: dict[int, Log] = {}
        self.size = 0
        self.taken: dict[int, int] = {}
        self.now, self.inner = -1, None

    def enter(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        part = symbol >> self.shift
        if self.shift and part == self.now:
            self.inner.enter(symbol & ((1 << self.shift) - 1), at, lcp)
            return
        entries = np.empty(len(at), self.kind)
        entries["at"], entries["lcp"] = at, lcp
        if self.shift:
            entries["symbol"] = symbol
        if part not in self.logs:
            self.logs[part] = Log(self.scratch, self.kind)
        self.logs[part].add(entries)
        self.size += entries.nbytes
        if self.size > self.scratch.memory // 4:
            for log in self.logs.values():
                if log.size:
                    log.spill()
            self.size = 0

    def take(self, symbol: int) -> np.ndarray | None:
        """The next entries of this symbol, in order of entry; None if there are none now."""
        part = symbol >> self.shift
        if self.shift:
            if part != self.now:
                self.now, self.inner = part, DiskQueue(1 << self.shift, self.scratch, self.position)
                for block in self.logs.pop(part, Log(self.scratch, self.kind)).blocks():
                    order = np.argsort(block["symbol"], kind="stable")
                    block = block[order]
                    cuts = [0, *(np.flatnonzero(np.diff(block["symbol"])) + 1).tolist(), len(block)]
                    for i, j in zip(cuts, cuts[1:]):
                        self.inner.enter(int(block["symbol"][i]) & ((1 << self.shift) - 1), block["at"][i:j], block["lcp"][i:j])
            return self.inner.take(symbol & ((1 << self.shift) - 1))
        log, done = self.logs.get(part), self.taken.get(part, 0)
        if log is None or done == len(log):
            self.logs.pop(part, None)
            self.taken.pop(part, None)
            return None
        end = min(len(log), done + self.scratch.block)
        self.taken[part] = end
        return log.read(done, end)


class Text:
    """Symbols in pieces, each ended by SENTINEL, with padding behind: big-endian, so that a word read
    at any place orders as its symbols do."""

    def __init__(self, symbols: np.ndarray, n: int):
        self.symbols, self.n, self.width = symbols, n, symbols.dtype.itemsize
        self.per, self.bits = 8 // self.width, 8 * self.width
        words = (len(symbols) * self.width - 8) // self.width + 1
        self.words = np.ndarray((words,), ">u8", symbols, 0, (self.width,))
        self.position = np.uint32 if n < 1 << 32 else np.int64

    @staticmethod
    def room(scratch: Scratch, n: int, most: int) -> np.ndarray:
        """Space for n symbols up to `most` and the padding."""
        return scratch.array(n + 16, ">u2" if most < 1 << 15 else ">u4")


def _types(text: Text, scratch: Scratch) -> tuple[np.ndarray, int]:
    """symbol * 2 + (1 if S) of every position, and the largest symbol."""
    typed = scratch.array(text.n, np.uint16 if text.width == 2 else np.uint64)
    behind, behind_s, most = -1, True, 0
    for hi in range(text.n, 0, -scratch.block):
        lo = max(0, hi - scratch.block)
        t = text.symbols[lo:hi].astype(np.int64)
        after = np.append(t[1:], behind)
        m = len(t)
        end = np.where(t == after, m, np.arange(m))
        end = np.minimum.accumulate(end[::-1])[::-1]
        is_s = np.where(end < m, (t < after)[np.minimum(end, m - 1)], behind_s)
        is_s[t == SENTINEL] = True
        typed[lo:hi] = t * 2 + is_s
        behind, behind_s, most = int(t[0]), bool(is_s[0]), max(most, int(t.max()))
    return typed, most


def _stars(typed: np.ndarray, text: Text, scratch: Scratch) -> np.ndarray:
    found = Log(scratch, text.position)
    before = 1
    for lo in range(0, text.n, scratch.block):
        s = (typed[lo : lo + scratch.block] & 1).astype(np.int8)
        found.add((np.flatnonzero((s == 1) & (np.append(before, s[:-1]) == 0)) + lo).astype(text.position))
        before = int(s[-1])
    stars = scratch.array(len(found), text.position)
    at = 0
    for block in found.blocks():
        stars[at : at + len(block)] = block
        at += len(block)
    return stars


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    differ = np.zeros(len(columns[0]), bool)
    differ[:1] = True
    for c in columns:
        differ[1:] |= c[1:] != c[:-1]
    return differ


def _with_neighbours(blocks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(records, equal to the one before, equal to the one behind), whatever the blocks are."""
    key = lambda r: (int(r["major"]), int(r["minor"]))
    before, held = None, None
    for block in blocks:
        block = block if held is None else np.concatenate((held, block))
        held = block[-1:]
        if len(block) > 1:
            after = ~_runs(block["major"], block["minor"])[1:]
            yield block[:-1], np.append(before == key(block[0]), after[:-1]), after
            before = key(block[-2])
    if held is not None:
        yield held, np.array([before == key(held[0])]), np.array([False])


ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
OPEN = np.dtype([("name", np.uint64), ("index", np.int64)])


def _named(text: Text, stars: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, bool]:
    """The name of each S* substring, which is how many are smaller, and whether all differ.

    Sentinels come first, by place. Substrings are compared a word at a time; those that are equal so
    far and don't end yet are sorted again. Behind its end a substring counts as larger than any
    symbol, as there the longer of two has an L position.
    """
    k = len(stars)
    names = scratch.array(k, np.uint32 if k < 1 << 32 else np.int64)
    n_ends, open_ = 0, Log(scratch, OPEN)
    for lo in range(0, k, scratch.block):
        ends = text.symbols[stars[lo : lo + scratch.block]] == SENTINEL
        index = np.flatnonzero(ends)
        names[lo + index] = np.arange(n_ends, n_ends + len(index))
        n_ends += len(index)
        rest = np.zeros(len(ends) - len(index), OPEN)
        rest["index"] = np.flatnonzero(~ends) + lo
        open_.add(rest)
    depth, unique = 0, True
    while len(open_):

        def length_of(index: np.ndarray) -> np.ndarray:
            return stars[index + 1].astype(np.int64) - stars[index].astype(np.int64) + 1

        def keyed(rows: Log = open_, depth: int = depth) -> Iterator[np.ndarray]:
            for block in rows.blocks():
                index = block["index"]
                left = np.clip(length_of(index) - depth, 0, text.per)
                shift = np.maximum(left * text.bits - 1, 0).astype(np.uint64)
                r = np.empty(len(block), RECORD)
                word = text.words[stars[index].astype(np.int64) + depth].astype(np.uint64)
                r["major"], r["index"] = block["name"] if depth else n_ends, index
                r["minor"] = np.where(left == 0, ALL, word | ((ALL >> shift) >> np.uint64(1)))
                yield r

        again = Log(scratch, OPEN)
        place, group_from, run_from, major = 0, 0, 0, None
        for block, before, after in _with_neighbours(sorted_blocks(scratch, keyed())):
            group = _runs(block["major"])
            group[0] = major is None or int(block["major"][0]) != major
            at = place + np.arange(len(block))
            group_at = np.maximum.accumulate(np.where(group, at, group_from))
            run_at = np.maximum.accumulate(np.where(~before, at, run_from))
            rows = np.empty(len(block), OPEN)
            rows["name"], rows["index"] = block["major"] + (run_at - group_at).astype(np.uint64), block["index"]
            names[block["index"]] = rows["name"]
            place, group_from, run_from, major = place + len(block), int(group_at[-1]), int(run_at[-1]), int(block["major"][-1])
            twin = before | after
            goes_on = length_of(block["index"]) >= depth + text.per
            unique = unique and not (twin & ~goes_on).any()
            again.add(rows[twin & goes_on])
        open_, depth = again, depth + text.per
    return names, unique


def _doubled(names: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a text of names in memory, by doubling; ends: where pieces end."""
    rank = names.astype(np.uint64)
    last = ends[np.searchsorted(ends, np.arange(len(rank)))]
    open_ = np.flatnonzero(np.bincount(names.astype(np.int64), minlength=len(rank))[names] > 1)
    step = 1
    while len(open_):
        key = (rank[open_] << np.uint64(32)) | rank[np.minimum(open_ + step, last[open_])]
        order = np.argsort(key)
        key, open_ = key[order], open_[order]
        at, group, run = np.arange(len(key)), _runs(key >> np.uint64(32)), _runs(key)
        rank[open_] += (np.maximum.accumulate(np.where(run, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))).astype(np.uint64)
        open_ = open_[~run | np.append(~run[1:], False)]
        step *= 2
    return rank


def _in_order(text: Text, stars: np.ndarray, scratch: Scratch) -> np.ndarray:
    """The S* suffixes in ascending order."""
    k = len(stars)
    names, unique = _named(text, stars, scratch)
    order = scratch.array(k, text.position)
    if not unique and k * 64 <= scratch.memory:
        names = _doubled(np.asarray(names), np.flatnonzero(text.symbols[stars] == SENTINEL))
        unique = True
    if unique:
        for lo in range(0, k, scratch.block):
            order[names[lo : lo + scratch.block]] = stars[lo : lo + scratch.block]
        return order
    reduced = Text.room(scratch, k, k + 1)
    for lo in range(0, k, scratch.block):
        ends = text.symbols[stars[lo : lo + scratch.block]] == SENTINEL
        reduced[lo : lo + len(ends)] = np.where(ends, 0, names[lo : lo + len(ends)].astype(np.int64) + 1)
    free = k
    for at, _ in suffix_order(Text(reduced, k), None, scratch.memory):
        order[free - len(at) : free] = stars[at][::-1]
        free -= len(at)
    return order


def _common(text: Text, p: np.ndarray, q: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at p and q, at most cap; no prefix passes a sentinel."""
    found = np.zeros(len(p), np.int64)
    active, at = np.arange(len(p)), 0
    p, q = p.astype(np.int64), q.astype(np.int64)
    ones = np.uint64(sum(1 << text.bits * lane for lane in range(text.per)))
    tops = ones << np.uint64(text.bits - 1)
    lanes = [np.uint64(text.bits * lane) for lane in range(text.per)]
    while len(active) and at < cap:
        a = text.words[p[active] + at].astype(np.uint64)
        b = text.words[q[active] + at].astype(np.uint64)
        differ = a ^ b
        same = (differ == 0).astype(np.int64)
        for shift in lanes[1:]:
            same += differ >> shift == 0
        ended = np.flatnonzero((a - ones) & ~a & tops)
        if len(ended):
            word = a[ended]
            until = np.zeros(len(ended), np.int64)
            ok = np.ones(len(ended), bool)
            for shift in reversed(lanes):
                ok &= (word >> shift) & np.uint64((1 << text.bits) - 1) != 0
                until += ok
            same[ended] = np.minimum(same[ended], until)
        found[active] += same
        active = active[same == text.per]
        at += text.per
    return np.minimum(found, cap)


class _Sorted:
    """The ordered S* suffixes, taken symbol by symbol, with common prefixes."""

    def __init__(self, text: Text, order: np.ndarray, scratch: Scratch, cap: int | None):
        self.text, self.order, self.scratch, self.cap = text, order, scratch, cap
        self.next = self.at = 0
        self.stars = self.symbols = np.zeros(0, np.int64)

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while True:
            if self.at == len(self.stars):
                if self.next == len(self.order):
                    return
                before = self.order[max(0, self.next - 1)]
                self.stars = np.asarray(self.order[self.next : self.next + self.scratch.block])
                self.symbols = self.text.symbols[self.stars].astype(np.int64)
                self.lcp = np.zeros(len(self.stars), np.uint8)
                if self.cap is not None:
                    self.lcp[:] = _common(self.text, np.append(before, self.stars[:-1]), self.stars, self.cap)
                    if not self.next:
                        self.lcp[0] = 0
                self.next, self.at = self.next + len(self.stars), 0
            end = int(np.searchsorted(self.symbols, symbol, side="right"))
            if end > self.at:
                begin, self.at = self.at, end
                yield self.stars[begin:end], self.lcp[begin:end].copy()
            if end < len(self.stars):
                return


class _Least:
    """Least values over ranges of one batch."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def over(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """min(values[i..j]), ends included."""
        level = np.frexp((j - i + 1).astype(np.float32))[1] - 1
        out = self.levels[0][i]
        for k in range(1, int(level.max(initial=0)) + 1):
            pick = np.flatnonzero(level == k)
            if len(pick):
                out[pick] = np.minimum(self.levels[k][i[pick]], self.levels[k][j[pick] - (1 << k) + 1])
        return out


class _Inducer:
    """Enters the predecessors of one type (1: S, 0: L) of the suffixes that it is shown."""

    def __init__(self, typed: np.ndarray, wanted: int, queue: DiskQueue, symbols: int, cap: int | None):
        self.typed, self.wanted, self.queue, self.cap = typed, wanted, queue, cap
        self.narrow = np.uint16 if symbols < 1 << 16 else np.uint32
        self.since = np.full(symbols, -1, np.int16) if cap is not None else None

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """at: suffixes in order; lcp: common prefix of each with the one shown before."""
        if not len(at):
            return
        target = np.maximum(at, 1) - np.ones(1, at.dtype)
        value = self.typed[target]
        push = np.flatnonzero((at > 0) & (value & 1 == self.wanted) & (value > 1))
        if not len(push):
            if self.cap is not None:
                self.since = np.minimum(self.since, np.int16(lcp.min()))
            return
        symbol = (value[push] >> 1).astype(self.narrow)
        order = np.argsort(symbol, kind="stable")
        push, symbol = push[order], symbol[order]
        target = target[push]
        new = _runs(symbol)
        cuts = np.flatnonzero(new)
        ends = np.append(cuts[1:], len(push))
        if self.cap is None:
            value = np.zeros(len(push), np.uint8)
        else:
            least = _Least(lcp)
            begin = np.append(0, push[:-1] + 1)
            begin[new] = 0
            value = least.over(begin, push).astype(np.int16)
            named = symbol[cuts]
            value[cuts] = np.minimum(value[cuts], self.since[named])
            self.since = np.minimum(self.since, np.int16(lcp.min()))
            tail = push[ends - 1] + 1
            rest = np.full(len(cuts), self.cap, np.int16)
            some = tail < len(lcp)
            rest[some] = least.over(tail[some], np.full(int(some.sum()), len(lcp) - 1))
            self.since[named] = rest
            value = np.minimum(value + 1, self.cap).astype(np.uint8)
        for i, j in zip(cuts.tolist(), ends.tolist(), strict=True):
            self.queue.enter(int(symbol[i]), target[i:j], value[i:j])


def suffix_order(text: Text, cap: int | None, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of suffix positions in descending order, each with its common prefix with the one that
    follows in the stream (at most cap, which is under 256; zeros without a cap).

    Sentinels are smaller than all else and the later of two is the larger, so no common prefix
    passes one.
    """
    scratch = Scratch(memory)
    try:
        yield from _ordered(text, cap, scratch)
    finally:
        scratch.close()


def _ordered(text: Text, cap: int | None, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not text.n:
        return
    typed, most = _types(text, scratch)
    symbols = most + 1
    stars = _Sorted(text, _in_order(text, _stars(typed, text, scratch), scratch), scratch, cap)

    def run_of(at: int) -> int:
        """Length of the run of one symbol from here, at most cap."""
        same = text.symbols[at : at + cap] == text.symbols[at]
        return cap if same.all() and len(same) == cap else int(np.argmin(np.append(same, False)))

    def drain(queue: DiskQueue, inducer: _Inducer, symbol: int) -> Iterator[np.ndarray]:
        while (part := queue.take(symbol)) is not None:
            inducer.scan(part["at"], part["lcp"])
            yield part

    up = DiskQueue(symbols, scratch, text.position)
    inducer = _Inducer(typed, 0, up, symbols, cap)
    low = Log(scratch, [("at", text.position), ("lcp", np.uint8)])
    sizes = Log(scratch, [("symbol", np.int64), ("n", np.int64)])
    for c in range(symbols):
        n, last = 0, None
        for part in drain(up, inducer, c):
            rows = np.empty(len(part), low.kind)
            rows["at"], rows["lcp"] = part["at"], part["lcp"]
            low.add(rows)
            n, last = n + len(part), int(part["at"][-1])
        if n:
            sizes.add(np.array([(c, n)], sizes.kind))
        for k, (at, lcp) in enumerate(stars.take(c)):
            if cap is not None and not k:
                lcp[0] = min(run_of(last), run_of(int(at[0]))) if n else 0
            inducer.scan(at, lcp)
    down = DiskQueue(symbols, scratch, text.position)
    inducer = _Inducer(typed, 1, down, symbols, cap)
    left, of = len(low), len(sizes)
    for c in range(most, SENTINEL, -1):
        count = 0
        if of:
            symbol, n = sizes.read(of - 1, of)[0]
            count, of = (int(n), of - 1) if symbol == c else (0, of)
        top = low.read(left - 1, left)["at"][0] if count else None
        # A prefix belongs to the larger of two: one suffix waits for the prefix that it has with the next.
        waiting = None
        for part in drain(down, inducer, c):
            if waiting is not None:
                yield waiting, part["lcp"][:1]
            if len(part) > 1:
                yield part["at"][:-1], part["lcp"][1:]
            waiting = part["at"][-1:]
        bridge = min(run_of(int(top)), run_of(int(waiting[0]))) if cap is not None and count and waiting is not None else 0
        if waiting is not None:
            yield waiting, np.array([bridge], np.uint8)
        done = 0
        while done < count:
            take = min(scratch.block, count - done)
            # With the one before, so that the prefix of the first is known as well.
            rows = low.read(left - done - take, left - done)[::-1]
            shown = np.empty(take, np.uint8)
            shown[0] = bridge if not done else above
            shown[1:] = rows["lcp"][:-1]
            above = rows["lcp"][-1]
            inducer.scan(rows["at"], shown)
            yield rows["at"], rows["lcp"]
            done += take
        left -= count
    for hi in range(text.n, 0, -scratch.block):
        lo = max(0, hi - scratch.block)
        at = (np.flatnonzero(text.symbols[lo:hi] == SENTINEL)[::-1] + lo).astype(text.position)
        if len(at):
            yield at, np.zeros(len(at), np.uint8)
