"""Vectorised passes over the UTF-8 bytes of many texts: segments, byte n-grams, word hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
MIX = np.uint64(0x9E3779B97F4A7C15)
SEGMENT_BYTES = 1 << 20

#: Bytes of words stay (ASCII letters and digits, all of a non-ASCII character), others are spaces.
WORD_BYTES = np.full(256, SPACE, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTES[_low:_high] = np.arange(_low, _high)
#: As WORD_BYTES without digits.
LETTER_BYTES = WORD_BYTES.copy()
LETTER_BYTES[0x30:0x3A] = SPACE
IDENTITY = np.arange(256, dtype=np.uint8)
#: 0 for white space and control bytes, 1 for bytes of words, 2 for punctuation.
BYTE_CLASS = np.where(WORD_BYTES != SPACE, 1, np.where(IDENTITY <= SPACE, 0, 2)).astype(np.uint8)
BYTE_CLASS[0x7F] = 0


@dataclass
class Segment:
    """Some texts in one buffer, a space before each and spaces behind the last."""

    rows: np.ndarray
    buf: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.buf) - 8


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _cut(piece: np.ndarray) -> int:
    """Where to cut a piece of a longer text: behind its last space, else between its last two
    tokens; a token that fills the piece is cut at its end."""
    kinds = BYTE_CLASS[piece]
    gaps = np.flatnonzero(kinds == 0)
    if len(gaps):
        return int(gaps[-1]) + 1
    changes = np.flatnonzero(kinds[1:] != kinds[:-1])
    return int(changes[-1]) + 1 if len(changes) else len(piece)


def segments(column: pa.Array | pa.ChunkedArray, keep: np.ndarray, lower: bool = True, limit: int = SEGMENT_BYTES) -> Iterator[Segment]:
    """All texts of the column, bytes mapped by `keep`, about `limit` bytes at a time.

    A text above the limit comes in several pieces, cut between tokens, so that memory doesn't follow
    the longest text; each piece names the row it belongs to, and pieces of a row stand together. A
    token is at most `limit` bytes long: longer runs are several tokens.
    """
    if not len(column):
        return
    data, offsets = _flat(pc.utf8_lower(column) if lower else column)
    pieces, rows, filled = [], [], 0

    def emit() -> Segment:
        sizes = np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        buf = np.full(int(sizes.sum()) + 9, SPACE, np.uint8)
        for at, piece in zip(starts.tolist(), pieces, strict=True):
            buf[at + 1 : at + 1 + len(piece)] = piece
        return Segment(np.array(rows), buf, starts)

    for row, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        first = True
        while first or i < j:
            first, end = False, min(j, i + limit)
            piece = keep[data[i:end]]
            if end < j:
                end = i + _cut(piece)
                piece = piece[: end - i]
            if pieces and filled + len(piece) > limit:
                yield emit()
                pieces, rows, filled = [], [], 0
            pieces.append(piece)
            rows.append(row)
            filled += len(piece)
            i = end
    if pieces:
        yield emit()


def gram_hash(buf: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes (n <= 8) from each position; the last 8 positions are padding."""
    view = np.ndarray((len(buf) - 8,), "<u8", buf, 0, (1,))
    masked = view & np.uint64((1 << (8 * n)) - 1)
    return ((masked + np.uint64(n)) * MIX >> np.uint64(64 - bits)).astype(np.int64)


def word_grams(buf: np.ndarray, lengths: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the n-grams inside one word, its bounding spaces included."""
    spaces = np.concatenate(([0], np.cumsum(buf == SPACE, dtype=np.int64)))
    n_at = len(buf) - 8
    for n in lengths:
        inside = np.flatnonzero(spaces[n - 1 : n - 1 + n_at] == spaces[1 : 1 + n_at])
        yield inside, gram_hash(buf, n, bits)[inside]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end position of every word."""
    gap = np.concatenate(([True], buf == SPACE, [True]))
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


_POWERS = np.ones(1 << 16, np.uint64)
_POWERS[1:] = MIX
_POWERS = np.multiply.accumulate(_POWERS)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; words beyond 64 KB share position weights."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    flat = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars = buf[np.repeat(starts, lengths) + flat].astype(np.uint64) + np.uint64(1)
    sums = np.add.reduceat(chars * _POWERS[flat & 0xFFFF], np.cumsum(lengths) - lengths)
    sums ^= sums >> np.uint64(29)
    return sums * MIX


def token_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every token: a run of word bytes, or of punctuation."""
    kinds = np.concatenate(([0], BYTE_CLASS[buf], [0])).astype(np.int8)
    change = np.flatnonzero(np.diff(kinds))
    kind = kinds[change + 1]
    starts = change[kind != 0]
    ends = np.concatenate((change, [len(buf)]))[1:][kind != 0]
    return starts, ends


def token_grams(column: pa.Array | pa.ChunkedArray, limit: int = SEGMENT_BYTES) -> Iterator[tuple[Segment, np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, hashes of tokens and of neighbouring pairs, piece of each, number of tokens by piece)
    of whole texts: a pair counts as well where a long text was cut between its tokens."""
    last_row, last = -1, np.uint64(0)
    for seg in segments(column, IDENTITY, limit=limit):
        starts, ends = token_bounds(seg.buf)
        ones = word_hashes(seg.buf, starts, ends)
        piece = np.searchsorted(seg.starts, starts, side="right") - 1
        amount = np.bincount(piece, minlength=len(seg.rows))
        if len(ones):
            row = seg.rows[piece]
            before = np.concatenate(([last], ones[:-1]))
            near = np.concatenate(([row[0] == last_row], row[1:] == row[:-1]))
            pairs = (before * MIX + ones)[near]
            pairs = (pairs ^ (pairs >> np.uint64(31))) * MIX
            last_row, last = row[-1], ones[-1]
            ones, piece = np.concatenate((ones, pairs)), np.concatenate((piece, piece[near]))
        yield seg, ones, piece, amount
