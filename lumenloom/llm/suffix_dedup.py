"""Removal of long byte strings that an earlier document holds, by distributed suffix sorting.

Every string of `width` bytes owns one anchor, the least-hashed GRAM-byte string inside it, so equal
strings have equal anchors: anchors only say which shard sorts a string. A run of strings with the
same anchor is a context. Which strings are equal is decided by the external induced suffix sorter.

1. List: each batch of documents lists its contexts. Contexts of a batch with the same bytes are
   pre-aggregated: the one of the smallest document speaks, those of larger ones are covered.
2. Route: buckets of anchors do the same for contexts of all batches, by a digest of 128 bits, and
   tell which of the others may share a string with another document: it has the anchor and, as a string
   holds `width` - GRAM bytes beside that, half of them before or half of them behind it. No other can.
3. Sort: the bytes of all contexts left go to shards, and each shard is a text on disk that
   the external sorter orders; runs of suffixes with a common prefix of `width` are equal strings. A
   context that several rows have stands in the text once and belongs to all of them; each of them
   loses the strings of the runs that a smaller document has a part in.
4. Report: documents meet their covered runs and report or drop them.

An anchor with very many contexts would be one hot key: such anchors are counted beforehand on a
share of the documents (they only steer the routing, results don't depend on them; their number is
bounded by the threshold) and all their strings are routed one by one, by their own hash.

Defined cases: null text is empty; matches never cross documents; rows that repeat a doc_id are one
number, so they take nothing from each other; rows without a doc_id come behind all others and take
nothing from each other; texts under `width` bytes lose nothing; no rows give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import give_back, materialize
from lumenloom.llm.induced import MEMORY, Log, Scratch, Text, suffix_order

GRAM = 16
SEGMENT = 1 << 19
BUCKET_BYTES = 4 << 20
#: Contexts of an anchor from which its strings are routed one by one; the share of documents counted.
HOT_CONTEXTS = 1 << 17
HOT_SHARE = 64
PIECES = 1 << 14
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
COVERED, OPEN, ASK = 0, 1, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * C2
    return x ^ (x >> np.uint64(29))


RAW, SAME, RISING = 0, 1, 2


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as compressed byte planes; read by unpack. A column equal to the one before
    it takes no space, one that mostly rises is stored by its steps."""
    kinds, planes = [], []
    for k, column in enumerate(columns):
        if k and column.dtype == columns[k - 1].dtype and np.array_equal(column, columns[k - 1]):
            kinds.append(SAME)
            continue
        rising = column.dtype == np.int64 and (column[1:] >= column[:-1]).mean() > 0.9 if len(column) > 1 else False
        kinds.append(RISING if rising else RAW)
        stored = np.diff(column, prepend=np.int64(0)) if rising else column
        planes.append(np.ascontiguousarray(stored).view(np.uint8).reshape(len(column), column.itemsize).T.tobytes())
    body = b"".join(planes)
    return np.array([len(columns[0]), len(body)], np.int64).tobytes() + bytes(kinds) + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes, *types) -> list[np.ndarray]:
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    kinds = blob[16 : 16 + len(types)]
    body, at, found = pa.decompress(blob[16 + len(types) :], decompressed_size=size, codec="zstd", asbytes=True), 0, []
    for stored, kind in zip(kinds, types, strict=True):
        if stored == SAME:
            found.append(found[-1])
            continue
        width = np.dtype(kind).itemsize
        column = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).reshape(n)
        found.append(np.cumsum(column) if stored == RISING else column)
        at += n * width
    return found


def _unpack_all(blobs, *types) -> list[np.ndarray]:
    parts = [unpack(b, *types) for b in blobs]
    return [np.concatenate(c) if parts else np.zeros(0, t) for c, t in zip(zip(*parts, strict=True) if parts else [()] * len(types), types, strict=True)]


#: A row is addressed by its key and compared by its number (the doc_id): equal columns as a rule.
RUNS = (np.int64, np.int64, np.uint16)  # key, first start, number of starts
ASKS = (np.uint64, np.int64, np.int64, np.int64, np.uint16)  # anchor, number, key, first start, number of starts
LISTED = (*ASKS, np.uint64, np.uint64, np.uint16, np.uint16)  # and the digest in two parts, marks of both sides


def home(key: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(key ^ (key >> 15) ^ (key >> 31), buckets)


def _home_column(key, buckets: int):
    return F.pmod(key.bitwiseXOR(F.shiftright(key, 15)).bitwiseXOR(F.shiftright(key, 31)), F.lit(buckets)).cast("int")


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _marks(view: np.ndarray, place: np.ndarray, size: int, known: np.ndarray) -> np.ndarray:
    """A 16-bit hash of the `size` bytes at these places; 0 where they are not known."""
    found = np.full(len(place), size, np.uint64)
    for k in range(0, size, 8):
        found = _mix(found ^ (view[place + k] & np.uint64((1 << 8 * min(8, size - k)) - 1)) * C1)
    return np.where(known, found % np.uint64(0xFFFF) + np.uint64(1), 0).astype(np.uint16)


def contexts_of(data: np.ndarray, pieces: list[tuple[int, int]], width: int) -> tuple[np.ndarray, ...]:
    """(anchor, context hash, first start, number of starts, marks) of the contexts in these byte ranges.

    The marks name the bytes before and behind the anchor, on each side half of what a string has
    besides it: an equal string of another context has at least one of the halves whole, too."""
    lengths = np.array([j - i for i, j in pieces])
    starts = np.cumsum(lengths) - lengths
    buf = np.concatenate([data[i:j] for i, j in pieces] + [np.zeros(width + 40, np.uint8)])
    n = int(lengths.sum())
    view = np.ndarray((n + width + 24,), "<u8", buf, 0, (1,))
    grams = _mix(_mix(view[: n + width] * C1) ^ (view[GRAM - 8 : n + width + GRAM - 8] * C3 + C2))
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    reach, size = width - GRAM + 1, 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if reach > size:
        low = np.minimum(low[: size - reach], low[reach - size :])
    count = np.maximum(lengths - width + 1, 0)
    at = np.arange(int(count.sum())) + np.repeat(starts - (np.cumsum(count) - count), count)
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(at) != 1)))[: len(at)]
    first = np.flatnonzero(new)
    begin, times = at[first], np.diff(np.concatenate((first, [len(at)])))
    length = times + width - 1
    context = _mix(length.astype(np.uint64) * C1)
    for k in range(0, int(length.max(initial=0)), 8):
        context = _mix(context ^ view[begin + np.minimum(k, length - 8)] * C1)
    gram, half = anchor[first], (width - GRAM + 1) // 2
    left = _marks(view, np.maximum(gram - half, 0), half, gram - begin >= half)
    right = _marks(view, gram + GRAM, half, begin + length - gram - GRAM >= half)
    return grams[gram] >> np.uint64(16) << np.uint64(1), context, begin, times, left, right


def _first_of_equal(*columns: np.ndarray) -> np.ndarray:
    differ = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        differ |= c[1:] != c[:-1]
    return np.concatenate(([True], differ))[: len(columns[0])]


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the strings of one length (8 or more) at a and b are equal."""
    view = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    equal, active, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(active):
        at = np.minimum(k, length[active] - 8)
        ok = view[a[active] + at] == view[b[active] + at]
        equal[active[~ok]] = False
        k += 8
        active = active[ok & (length[active] > k)]
    return equal


def _context_hash(data: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of the strings of `length` (8 or more) bytes at these places."""
    view = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    found = _mix(length.astype(np.uint64) * C1)
    for k in range(0, int(length.max(initial=0)), 8):
        found = _mix(found ^ view[place + np.minimum(k, length - 8)] * C1)
    return found


def _alike(data: np.ndarray, width: int, key: np.ndarray, place: np.ndarray, times: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where a record differs from the one before it in its bytes or columns."""
    order = np.argsort(key)
    place, times = place[order], times[order]
    same = (times[1:] == times[:-1]) & (key[order][1:] == key[order][:-1])
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    twin = np.flatnonzero(same) + 1
    head = np.ones(len(order), bool)
    head[twin] = ~_equal_bytes(data, place[twin - 1], place[twin], times[twin].astype(np.int64) + width - 1)
    return order, head


def _digests(data: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2 of the strings at these places."""
    raw, digest = memoryview(data), hashlib.blake2b
    high, low = np.empty(len(place), np.uint64), np.empty(len(place), np.uint64)
    for lo in range(0, len(place), PIECES):
        begin, end = place[lo : lo + PIECES], place[lo : lo + PIECES] + length[lo : lo + PIECES]
        found = b"".join([digest(raw[i:j], digest_size=16).digest() for i, j in zip(begin.tolist(), end.tolist(), strict=True)])
        parts = np.frombuffer(found, [("high", "<u8"), ("low", "<u8")])
        high[lo : lo + PIECES], low[lo : lo + PIECES] = parts["high"], parts["low"]
    return high, low


def _collapse(data, width, anchor, context, number, key, at, place, times, *more):
    """Records without the covered ones, and the covered ones: of contexts with equal bytes only those
    of the smallest number stay. place: where the context begins in data."""
    order, head = _alike(data, width, anchor ^ context, place, times, anchor)
    known = np.zeros(len(order), bool)
    if len(order):
        least = np.minimum.reduceat(number[order], np.flatnonzero(head))[np.cumsum(head) - 1]
        known[order] = number[order] > least
    return [c[~known] for c in (anchor, number, key, at, times, place, *more)], [c[known] for c in (key, at, times)]


def _spread(kind: int, where: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(where.astype(np.uint16) if len(where) and int(where.max()) < 1 << 16 else where, kind="stable")
    where = where[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(where)) + 1
    for i, j in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(where)])).tolist(), strict=True):
        if j > i:
            yield int(where[i]), kind, pack(*[c[i:j] for c in columns])


SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])


def _sent(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(SENT.types)], schema=SENT)


def _contexts_in(data: np.ndarray, spans: list[tuple[int, int]], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text of the list, anchor, context hash, first start in its text, place in data, number of
    starts, marks) of some texts at a time; long texts come in overlapping pieces."""
    pieces, of, shift, filled = [], [], [], 0

    def found() -> tuple[np.ndarray, ...]:
        anchor, context, begin, times, *marks = contexts_of(data, pieces, width)
        lengths = np.array([j - i for i, j in pieces])
        starts = np.cumsum(lengths) - lengths
        piece = np.searchsorted(starts, begin, side="right") - 1
        inside = begin - starts[piece]
        return np.array(of)[piece], anchor, context, inside + np.array(shift)[piece], inside + np.array(pieces)[piece, 0], times.astype(np.uint16), *marks

    for n, (i, j) in enumerate(spans):
        for begin in range(i, j - width + 1, SEGMENT):
            end = min(j, begin + SEGMENT + width - 1)
            pieces.append((begin, end))
            of.append(n)
            shift.append(begin - i)
            filled += end - begin
            if filled >= SEGMENT:
                yield found()
                pieces, of, shift, filled = [], [], [], 0
    if pieces:
        yield found()


def _batched(batch: pa.RecordBatch, width: int, amount: int = 32 * SEGMENT):
    """(data, columns of _contexts_in) for about `amount` bytes of the texts of a batch at a time."""
    data, offsets = _texts(batch.column(batch.schema.get_field_index("text")))
    ends = offsets[1:]
    low = 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, offsets[low] + amount, side="right")))
        spans = list(zip(offsets[low:high].tolist(), offsets[low + 1 : high + 1].tolist(), strict=True))
        parts = list(_contexts_in(data, spans, width))
        if parts:
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            columns[0] += low
            yield data, columns
        low = high


def _counting(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, (row, anchor, context, *_) in _batched(batch, width):
                order = np.lexsort((context, row, anchor))
                once = _first_of_equal(anchor[order], row[order], context[order])
                names, counts = np.unique(anchor[order][once], return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": names.view(np.int64), "n": counts})

    return run


def _listing(buckets: int, width: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            keys, numbers = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "number"))
            for data, (row, anchor, context, at, place, times, *marks) in _batched(batch, width):
                (anchor, number, key, at, times, place, *marks), covered = _collapse(data, width, anchor, context, numbers[row], keys[row], at, place, times, *marks)
                rows = list(_spread(COVERED, home(covered[0], buckets), covered))
                busy = np.isin(anchor, hot.value)
                rows += _spread(OPEN, home(key[busy], buckets), [anchor[busy] | np.uint64(1), number[busy], key[busy], at[busy], times[busy]])
                ask = ~busy
                where = (anchor[ask] * C1 >> np.uint64(32)).astype(np.int64) % buckets
                digest = _digests(data, place[ask], times[ask].astype(np.int64) + width - 1)
                rows += _spread(ASK, where, [*(c[ask] for c in (anchor, number, key, at, times)), *digest, *(c[ask] for c in marks)])
                yield _sent(rows)

    return run


def _in_several(name: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Whether several numbers have the name of a record."""
    order = np.argsort(name)
    head = np.flatnonzero(_first_of_equal(name[order]))
    found = np.zeros(len(name), bool)
    if len(head):
        shared = np.minimum.reduceat(number[order], head) != np.maximum.reduceat(number[order], head)
        found[order] = np.repeat(shared, np.diff(np.append(head, len(name))))
    return found


def _resolving(buckets: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Rows of kind ASK are for this bucket, all others on their way to the home of the same number.

        Of equal contexts those of the smallest number speak, those of larger ones are covered. Of the
        others those are open whose anchor and one half beside it lie in several numbers."""
        give_back()
        rows = [(int(g), int(k), p) for g, k, p in zip(group["bucket"], group["kind"], group["payload"], strict=True) if k != ASK]
        columns = _unpack_all(group.loc[group["kind"] == ASK, "payload"], *LISTED)
        anchor, number, key, at, times, high, low, *_ = columns
        order = np.argsort(high)
        head = _first_of_equal(*(c[order] for c in (anchor, high, low, times)))
        if len(order):
            least = np.minimum.reduceat(number[order], np.flatnonzero(head))[np.cumsum(head) - 1]
            copy = order[number[order] > least]
            rows += _spread(COVERED, home(key[copy], buckets), [key[copy], at[copy], times[copy]])
            alone = np.ones(len(order), bool)
            alone[copy] = False
            rest = np.flatnonzero(alone)
            rest = rest[_in_several(anchor[rest], number[rest])]
            anchor, number, *found, _, _, left, right = (c[rest] for c in columns)
            open_ = np.zeros(len(rest), bool)
            for mark in (left, right):
                some = np.flatnonzero(mark)
                open_[some] |= _in_several(anchor[some] >> np.uint64(1) | mark[some].astype(np.uint64) << np.uint64(48), number[some])
            found = [c[open_] for c in (anchor, number, *found)]
            rows += _spread(OPEN, home(found[2], buckets), found)
        return pd.DataFrame(rows, columns=["home", "kind", "payload"])

    return run


CUT = pa.schema([("shard", pa.int32()), ("number", pa.int64()), ("key", pa.int64()), ("at", pa.binary()), ("bytes", pa.binary())])


def _slices(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary column of neighbouring slices of data."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _cutting(shards: int, width: int, most: int = 64 << 20):
    def pieces(data: np.ndarray, anchor, number, key, at, begin, length) -> pa.Table:
        """One row for each context of a row of documents, with all places where that has it."""
        order, head = _alike(data, width, _mix(_context_hash(data, begin, length) ^ key.astype(np.uint64) * C3), begin, (length - width + 1), key, anchor)
        first = np.flatnonzero(head)
        pick = order[first]
        ends = np.append(first[1:], len(order))
        text = np.cumsum(length[pick]) - length[pick]
        flat = np.empty(int(length[pick].sum()), np.uint8)
        for i in range(0, len(pick), PIECES):
            # Places of bytes take eight times the bytes, so only some pieces are gathered at once.
            some, at_text = pick[i : i + PIECES], text[i : i + PIECES]
            place = np.arange(int(length[some].sum())) + np.repeat(begin[some] - (at_text - at_text[0]), length[some])
            flat[at_text[0] : at_text[0] + len(place)] = data[place]
        shard = (_mix(anchor[pick]) >> np.uint64(33)).astype(np.int64) % shards
        columns = [pa.array(shard.astype(np.int32)), pa.array(number[pick]), pa.array(key[pick]), _slices(np.append(0, ends) * 8, at[order].view(np.uint8)), _slices(np.append(text, len(flat)), flat)]
        return pa.Table.from_arrays(columns, schema=CUT)

    def run(docs: pa.Table, asks: pa.Table) -> pa.Table:
        """The bytes of the open contexts, and of every string of the hot ones by itself."""
        give_back()
        mark, number, key, at, times = _unpack_all(asks["payload"].to_pylist(), *ASKS)
        keys = docs["key"].to_numpy()
        if not len(mark) or not len(keys):
            return CUT.empty_table()
        data, offsets = _texts(docs["text"])
        sort = np.argsort(keys)
        begin = offsets[sort[np.searchsorted(keys[sort], key)]] + at
        length = times.astype(np.int64) + width - 1
        hot = mark & np.uint64(1) == 1
        found = [pieces(data, *(c[~hot] for c in (mark >> np.uint64(1), number, key, at, begin, length)))] if not hot.all() else []
        rows = np.flatnonzero(hot)
        for part in np.array_split(rows, max(1, int(length[rows].sum()) * width // most + 1)):
            count = times[part].astype(np.int64)
            of, step = np.repeat(part, count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            if len(of):
                size = np.full(len(of), width)
                found.append(pieces(data, _context_hash(data, begin[of] + step, size), number[of], key[of], at[of] + step, begin[of] + step, size))
        return pa.concat_tables(found)

    return run


def equal_strings(least_of, several, starts, text: Text, width: int, scratch: Scratch, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, offset, least) of every string of `width` bytes that starts in several pieces, or in one of
    several owners: the least number that has it.

    starts: where the pieces begin in text; least_of, several: the least number of a piece's owners, and
    whether others own it too. The order is read once as it is made, keeping these strings and the least
    number of each run, and once more to tell it to all strings of the run.
    """
    kept = Log(scratch, [("at", np.int64), ("piece", np.int64), ("head", np.bool_)])
    least = Log(scratch, [("number", np.int64)])
    running, follows = None, False  # the least number of the run at hand; whether it goes on
    for at, common in suffix_order(text, width, memory):
        goes_on = common >= width
        head = ~np.append(follows, goes_on[:-1])
        follows = bool(goes_on[-1])
        piece = np.searchsorted(starts, at, side="right") - 1
        ends = starts[np.minimum(piece + 1, len(starts) - 1)]
        room = np.where(piece + 1 < len(starts), ends, text.n) - 1 - at
        wanted = goes_on | ~head | (several[piece] & (room >= width))
        if not wanted.any():
            continue
        rows = np.empty(int(wanted.sum()), kept.kind)
        rows["at"], rows["head"], rows["piece"] = at[wanted], head[wanted], piece[wanted]
        kept.add(rows)
        own = least_of[rows["piece"]]
        first = np.flatnonzero(rows["head"])
        edges = first if len(first) and not first[0] else np.append(0, first)
        low = np.minimum.reduceat(own, edges)
        if len(edges) > len(first):
            low[0] = min(low[0], running)
        elif running is not None:
            least.add(np.array([(running,)], least.kind))
        done = np.empty(len(low) - 1, least.kind)
        done["number"] = low[:-1]
        least.add(done)
        running = int(low[-1])
    if running is not None:
        least.add(np.array([(running,)], least.kind))
    run = -1
    for rows in kept.blocks():
        of = run + np.cumsum(rows["head"])
        low = least.read(int(of[0]), int(of[-1]) + 1)["number"][of - of[0]]
        run = int(of[-1])
        yield rows["piece"], rows["at"] - starts[rows["piece"]], low


FOUND = pa.schema([("home", pa.int32()), ("kind", pa.int8()), ("payload", pa.binary())])


def _runs_of(where: np.ndarray, start: np.ndarray, most: int = 60_000) -> np.ndarray:
    """Where runs of neighbouring starts of one row begin; none is longer than `most`."""
    new = np.append(True, (where[1:] != where[:-1]) | (start[1:] != start[:-1] + 1))
    at = np.arange(len(where))
    return new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0)


class Shard:
    """The different pieces of a shard, one behind the other in files, and their owners: symbols are
    bytes + 1, 0 ends a piece. Rows come in the order of their bytes, so equal ones stand together."""

    def __init__(self, memory: int, width: int):
        self.scratch, self.width, self.last = Scratch(memory), width, None
        self.symbols = Log(self.scratch, ">u2")
        self.starts = Log(self.scratch, np.int64)
        self.owners = Log(self.scratch, [("piece", np.int64), ("number", np.int64), ("key", np.int64), ("at", np.int64)])

    def add(self, batch: pa.RecordBatch) -> None:
        data, offsets = _texts(batch.column(4))
        ats, at_offsets = _texts(batch.column(3))
        lengths = np.diff(offsets)
        new = np.ones(len(lengths), bool)
        twin = np.flatnonzero(lengths[1:] == lengths[:-1]) + 1
        new[twin] = ~_equal_bytes(data, offsets[twin - 1], offsets[twin], lengths[twin])
        new[0] = data[offsets[0] : offsets[1]].tobytes() != self.last
        self.last = data[offsets[-2] : offsets[-1]].tobytes()
        piece = len(self.starts) - 1 + np.cumsum(new)
        pick = np.flatnonzero(new)
        size = lengths[pick]
        text = np.cumsum(size) - size
        symbols = np.zeros(int(size.sum()) + len(size), ">u2")
        of = np.repeat(np.arange(len(size)), size)
        symbols[np.arange(len(of)) + of] = data[np.arange(len(of)) + np.repeat(offsets[pick] - text, size)].astype(np.uint16) + 1
        self.starts.add(len(self.symbols) + text + np.arange(len(size)))
        self.symbols.add(symbols)
        times = np.diff(at_offsets) // 8
        rows = np.empty(int(times.sum()), self.owners.kind)
        for name, values in (("piece", piece), ("number", batch.column(1).to_numpy()), ("key", batch.column(2).to_numpy())):
            rows[name] = np.repeat(values, times)
        rows["at"] = ats[at_offsets[0] : at_offsets[-1]].copy().view(np.int64)
        self.owners.add(rows)

    def covered(self, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(key, start) of every string that a smaller number has."""
        n, pieces = len(self.symbols), len(self.starts)
        symbols = Text.room(self.scratch, n, 256)
        starts = self.scratch.array(pieces, np.int64)
        for target, log in ((symbols, self.symbols), (starts, self.starts)):
            at = 0
            for block in log.blocks():
                target[at : at + len(block)] = block
                at += len(block)
        least, several, first = self.scratch.array(pieces, np.int64), self.scratch.array(pieces, np.bool_), self.scratch.array(pieces + 1, np.int64)
        owner = {c: self.scratch.array(len(self.owners), np.int64) for c in ("number", "key", "at")}
        at, before = 0, -1
        for rows in self.owners.blocks():
            for c, values in owner.items():
                values[at : at + len(rows)] = rows[c]
            head = np.flatnonzero(np.append(rows["piece"][0] != before, np.diff(rows["piece"]) != 0))
            edges = head if len(head) and not head[0] else np.append(0, head)
            low, high, of = np.minimum.reduceat(rows["number"], edges), np.maximum.reduceat(rows["number"], edges), rows["piece"][edges]
            if len(edges) > len(head):
                several[of[0]] |= (low[0] != least[of[0]]) | (high[0] != least[of[0]])
                low[0] = min(low[0], least[of[0]])
            several[of] |= low != high
            least[of] = low
            first[rows["piece"][head]] = at + head
            at, before = at + len(rows), int(rows["piece"][-1])
        first[pieces] = at
        for piece, offset, low in equal_strings(least, several, starts, Text(symbols, n), self.width, self.scratch, memory):
            lo, count = first[piece], first[piece + 1] - first[piece]
            cuts = np.unique(np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, 1 << 19)))
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(piece)], strict=True):
                times = count[i:j]
                if not times.sum():
                    continue
                of = np.repeat(np.arange(i, j), times)
                pick = np.arange(len(of)) + np.repeat(lo[i:j] - (np.cumsum(times) - times), times)
                gone = owner["number"][pick] > low[of]
                if gone.any():
                    yield owner["key"][pick[gone]], owner["at"][pick[gone]] + offset[of][gone]


def _sorting(buckets: int, width: int, memory: int):
    def sort(shard: Shard) -> Iterator[pa.RecordBatch]:
        for where, start in shard.covered(memory):
            order = np.lexsort((start, where))
            where, start = where[order], start[order]
            new = np.flatnonzero(_runs_of(where, start))
            times = np.diff(np.append(new, len(where)))
            rows = list(_spread(COVERED, home(where[new], buckets), [where[new], start[new], times.astype(np.uint16)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(FOUND.types)], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a partition stand in the order of shards; a shard is gathered on disk."""
        give_back()
        now, shard = None, None
        try:
            for batch in batches:
                names = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
                for i, j in zip(cuts, cuts[1:]):
                    if j > i:
                        if now is not None and names[i] != now:
                            yield from sort(shard)
                            shard.scratch.close()
                            shard = None
                        now, shard = names[i], shard or Shard(memory, width)
                        shard.add(batch.slice(i, j - i))
            if shard is not None:
                yield from sort(shard)
        finally:
            if shard is not None:
                shard.scratch.close()

    return run


DONE = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def _reporting(width: int, keep_bytes: bool):
    def run(docs: pa.Table, runs: pa.Table) -> pa.Table:
        give_back()
        doc, at, times = _unpack_all(runs["payload"].to_pylist(), *RUNS)
        order = np.lexsort((at, doc))
        doc, begin, end = doc[order], at[order], (at + times.astype(np.int64) + width - 1)[order]
        keys, ids = docs["key"].to_pylist(), docs["doc_id"].to_pylist()
        if not keys:
            return DONE.empty_table()
        data, offsets = _texts(docs["text"])
        lo, hi = np.searchsorted(doc, keys, "left"), np.searchsorted(doc, keys, "right")
        rows = []
        for key, name, i, j, a, b in zip(keys, ids, offsets[:-1].tolist(), offsets[1:].tolist(), lo.tolist(), hi.tolist(), strict=True):
            text, spans, parts, last = data[i:j], [], [], 0
            if b > a:
                top = np.maximum.accumulate(end[a:b])
                new = np.concatenate(([True], begin[a + 1 : b] > top[:-1]))
                first = begin[a:b][new]
                final = top[np.concatenate((np.flatnonzero(new)[1:], [b - a])) - 1]
                for x, y in zip(first.tolist(), final.tolist(), strict=True):
                    spans += [x, y]
                    parts.append(text[last:x].tobytes())
                    last = y
            kept = b"".join([*parts, text[last:].tobytes()])
            rows.append((key, name, j - i, j - i - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans, kept if keep_bytes else None))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DONE.types, strict=True)], schema=DONE)

    return run


def _hot_anchors(rows: DataFrame, size: int, width: int) -> np.ndarray:
    """Anchors with very many contexts, by a count on a share of the documents.

    The threshold grows with the corpus, so that at most some 2^21 anchors can pass.
    """
    most = max(HOT_CONTEXTS, size // (width - GRAM) >> 20)
    part = rows.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(HOT_SHARE)) == 0).select("key", "text")
    counts = part.mapInArrow(_counting(width), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(1, most // HOT_SHARE)).select("anchor").toPandas()["anchor"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 50, keep_bytes: bool = False, bucket_bytes: int = BUCKET_BYTES, memory: int = MEMORY) -> DataFrame:
    """One row per document: row_key, doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts
    and ends, byte offsets) and, if asked for, the kept bytes (they may end inside a character).
    bucket_bytes: text for which one task holds the records at a time; raise it with the memory of
    the executors, as small buckets of a very large corpus make many small payloads. memory: what
    the sorter of a shard keeps in memory, however large the shard is."""
    spark = docs.sparkSession
    if not GRAM <= width <= 255:
        raise ValueError(f"width must lie between {GRAM} and 255")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    seen = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("size")).first()
    unique = seen["n"] == seen["ids"] and rows.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0
    if unique:
        rows = rows.withColumn("key", F.col("doc_id"))
    else:
        rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()), "keyed")
    rows = rows.withColumn("number", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    size = seen["size"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, size // bucket_bytes + 1)
    hot = spark.sparkContext.broadcast(_hot_anchors(rows, size, width))
    listed = rows.select("key", "number", "text").mapInArrow(_listing(buckets, width, hot), "bucket int, kind byte, payload binary")
    sent = "home int, kind byte, payload binary"
    resolved = materialize(listed.groupBy("bucket").applyInPandas(_resolving(buckets), sent), "resolved", keep_shuffle=False)
    at_home = rows.select("key", "doc_id", "text", _home_column(F.col("key"), buckets).alias("home")).groupBy("home")
    asked = resolved.where(F.col("kind") == OPEN).groupBy("home")
    cut = at_home.cogroup(asked).applyInArrow(_cutting(buckets, width), "shard int, number long, key long, at binary, bytes binary")
    dealt = cut.repartition(buckets, "shard").sortWithinPartitions("shard", "bytes")
    ordered = dealt.mapInArrow(_sorting(buckets, width, memory), sent)
    covered = resolved.where(F.col("kind") == COVERED).unionAll(ordered).groupBy("home")
    done = "row_key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"
    return at_home.cogroup(covered).applyInArrow(_reporting(width, keep_bytes), done)


def remove(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 50) -> DataFrame:
    """(doc_id, text) with repeated strings cut out; bytes of split characters are dropped."""
    found = report(docs, doc_id=doc_id, text=text, width=width, keep_bytes=True)
    return found.select(F.col("doc_id").alias(doc_id), F.expr("try_validate_utf8(cast(kept as string))").alias(text), F.col("kept").alias("kept_bytes"))
