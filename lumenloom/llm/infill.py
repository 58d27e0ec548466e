"""Fill-in-the-middle transformation: texts are cut at unit boundaries into prefix, middle and suffix
and rearranged, so that a model learns to write the middle.

A unit is a run of ASCII letters, or any other single code point. A text is laid out in fixed blocks
of `block` bytes; a Fenwick tree over its blocks holds how many units begin and how many code points
stand in each. A cut behind the k-th unit is found by binary-lifting descent to the block in which
unit k begins, then among the few units of that block alone; the same descent sums the code points
before the block. All trees of a batch stand side by side in one array and descend together.

Where to cut and which form to take are drawn in Spark from a hash of the document's id, so a document
is treated alike in every run and partitioning. No row is shuffled.

Defined cases: null text is the empty text; empty texts and texts that hold one of the marks stay
as they are (form plain, null lengths); cuts may fall together, so parts may be empty; a null doc_id
draws as the id `null`; repeated ids draw alike; texts of any length are cut whole, memory follows a
batch of texts (`slice_bytes`) or the longest single one; empty tables give empty tables; columns of
docs beyond the text pass through `transform` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenloom.llm.common import give_back

#: The marks before the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 512
#: Bytes of text that one call of the cutter looks at together, and of output that a batch holds.
SLICE_BYTES = 4 << 20


class BlockTrees:
    """Fenwick trees over the blocks of several texts, side by side.

    buf: the texts' bytes one after another; bounds: where each begins, and the end of the last.
    """

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, block: int):
        self.buf, self.bounds, self.block = buf, bounds, block
        letter = ((buf | 0x20) - np.uint8(0x61)) < 26
        self.point = (buf & 0xC0) != 0x80
        begins = np.zeros(len(buf), bool)
        if len(buf):
            follows = np.concatenate(([False], letter[:-1]))
            follows[bounds[:-1][bounds[:-1] < len(buf)]] = False
            begins = self.point & ~(letter & follows)
        self.begins = begins
        lengths = np.diff(bounds)
        self.blocks = -(-lengths // block)
        self.base = np.concatenate(([0], np.cumsum(self.blocks)))
        within = np.arange(self.base[-1]) - np.repeat(self.base[:-1], self.blocks)
        starts = np.repeat(bounds[:-1], self.blocks) + within * block
        self.units, self.points = self._sums(begins, starts), self._sums(self.point, starts)
        # Nodes are numbered from 1 in each text; a node passes its sum on to the one it belongs to.
        node = within + 1
        last = np.repeat(self.blocks, self.blocks)
        step = 1
        while step <= (self.blocks.max() if len(self.blocks) else 0):
            give = np.flatnonzero(((node & -node) == step) & (node + step <= last))
            self.units[give + step] += self.units[give]
            self.points[give + step] += self.points[give]
            step *= 2

    @staticmethod
    def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)

    def totals(self) -> np.ndarray:
        """The number of units of each text: the nodes on the way down from its last block."""
        out, node = np.zeros(len(self.blocks), np.int64), self.blocks.copy()
        while (node > 0).any():
            on = np.flatnonzero(node)
            out[on] += self.units[self.base[on] + node[on] - 1]
            node[on] &= node[on] - 1
        return out

    def cut(self, text: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code point) of the text's boundary behind so many of its units, for many cuts at once."""
        node, left, points = np.zeros(len(text), np.int64), behind.copy(), np.zeros(len(text), np.int64)
        step = 1 << int(self.blocks.max() if len(self.blocks) else 0).bit_length()
        while step:
            reach = node + step
            fits = np.flatnonzero(reach <= self.blocks[text])
            at = self.base[text[fits]] + reach[fits] - 1
            go = self.units[at] <= left[fits]
            fits, at = fits[go], at[go]
            left[fits] -= self.units[at]
            points[fits] += self.points[at]
            node[fits] = reach[fits]
            step //= 2
        # The unit with `left` units of its block before it begins here; no such unit: the text's end.
        at = np.minimum(self.bounds[text] + node * self.block, self.bounds[text + 1])
        end = np.minimum(at + self.block, self.bounds[text + 1])
        for k in np.flatnonzero(at < end).tolist():
            begin = int(at[k])
            at[k] = begin + int(np.flatnonzero(self.begins[begin : end[k]])[left[k]])
            points[k] += int(np.count_nonzero(self.point[begin : at[k]]))
        return at - self.bounds[text], points


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, bounds) of some texts at a time."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def _rearranged(text: bytes, a: int, b: int, suffix_first: bool) -> bytes:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((s, suffix, p, prefix, m, middle) if suffix_first else (p, prefix, s, suffix, m, middle))


def _cutter(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            for i, j, buf, bounds in _slices(texts):
                trees = BlockTrees(buf, bounds, block)
                n = trees.totals()
                low, high = np.sort(np.stack([h1[i:j] % (n + 1), h2[i:j] % (n + 1)]), axis=0)
                text = np.arange(j - i)
                at, points = trees.cut(np.concatenate((text, text)), np.concatenate((low, high)))
                a, b = at[: j - i], at[j - i :]
                forms, outputs = [], []
                for k in range(j - i):
                    whole = buf[bounds[k] : bounds[k + 1]].tobytes()
                    if not whole or h3[i + k] % 100 >= 90 or any(m.encode() in whole for m in (PREFIX, SUFFIX, MIDDLE)):
                        forms.append("plain")
                        outputs.append(whole)
                    else:
                        forms.append("spm" if h4[i + k] % 100 < 20 else "psm")
                        outputs.append(_rearranged(whole, int(a[k]), int(b[k]), forms[-1] == "spm"))
                plain = np.array([f == "plain" for f in forms])
                prefix, middle = points[: j - i], points[j - i :] - points[: j - i]
                columns = {"row": batch.column("row").slice(i, j - i), "n": pa.array(n), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(prefix, mask=plain), "middle_chars": pa.array(middle, mask=plain), "output": pa.array(outputs, pa.binary())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            give_back()

    return run


def _draw(doc_id: Column, salt: str) -> list[Column]:
    """Four numbers of 32 bits drawn from the id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", salt: str = "1:", block: int = BLOCK_BYTES) -> DataFrame:
    """row (a struct of all columns of docs but the text), n (units), form (plain, psm or spm), prefix_chars,
    middle_chars (code points, null if plain) and output, the text to train on."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    given = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *_draw(F.col(f"`{doc_id}`"), salt))
    schema = StructType([given.schema["row"], *StructType.fromDDL("n long, form string, prefix_chars long, middle_chars long, output binary").fields])
    found = given.mapInArrow(_cutter(block), schema)
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that `transform` rearranged, from its output and form alone.

    No part holds a mark, and none can come about where a part and a mark meet, as marks begin with
    their only `<` and end with their only `>`.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first = F.when(form == "spm", F.lit(2)).otherwise(F.lit(1))
    return F.when(form == "plain", output).otherwise(F.concat(F.get(parts, first), F.get(parts, F.lit(3)), F.get(parts, F.lit(3) - first)))


def report(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars and the digests of the output and
    of the text rebuilt from it."""
    found = transform(docs, doc_id=doc_id, **options)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(F.col(f"row.`{doc_id}`").alias(doc_id), "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
