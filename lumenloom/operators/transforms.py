"""Fourier transforms of any size over many tasks.

A field is a table of lines (field_id, line, at, re, im): `at` holds the places of the values on the line,
or is null where all stand in order. Lines are transformed where they are; the pieces of a block of
columns then meet in one group, whose columns are transformed, and come out as lines along the other axis.
So a field crosses the network once, no task holds more than a block, and a transform there and back needs
no turning. A long signal is laid out as a field, its factors twisted between the passes; one whose length
has no fit factors goes by chirps through a power of two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit

#: Values that a task transforms at a time.
CELLS = 1 << 18
#: Longest line; a signal may be its square long.
LONGEST = 1 << 20
#: Places of the largest field that one task correlates by itself, some 100 MB at work.
WHOLE = 1 << 21
LINES = "field_id long, line long, at array<int>, re array<double>, im array<double>"
PIECES = "field_id long, block long, line long, re array<double>, im array<double>"


def lines(values: DataFrame) -> DataFrame:
    """(field_id, line, at, re[, im]) by value as lines. Values of one place are added, those with a null
    place or amount count for nothing; without a column im they are real."""
    im = F.col("im").cast("double") if "im" in values.columns else lit(0)
    given = values.select(F.col("field_id").cast("long").alias("field_id"), F.col("line").cast("long").alias("line"), F.col("at").cast("int").alias("at"), F.coalesce(F.col("re").cast("double"), lit(0)).alias("re"), F.coalesce(im, lit(0)).alias("im"))
    placed = given.where("line IS NOT NULL AND at IS NOT NULL").groupBy("field_id", "line", "at").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    found = placed.groupBy("field_id", "line").agg(F.collect_list(F.struct("at", "re", "im")).alias("v"))
    return found.select("field_id", "line", F.col("v.at").alias("at"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def values(transformed: DataFrame) -> DataFrame:
    """The values of full lines, one a row: field_id, line, at, re, im."""
    return transformed.select("field_id", "line", F.posexplode(F.arrays_zip("re", "im")).alias("at", "v")).select("field_id", "line", "at", "v.re", "v.im")


def _sums(a: np.ndarray, axis: int, inverse: bool) -> np.ndarray:
    return np.fft.ifft(a, axis=axis, norm="forward") if inverse else np.fft.fft(a, axis=axis)


def _full(part: pa.RecordBatch, width: int) -> np.ndarray:
    """The lines of a batch as rows of a matrix."""
    at, re, im = (part.column(c) for c in ("at", "re", "im"))
    n = re.value_lengths().to_numpy(zero_copy_only=False)
    row, place = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    given = np.repeat(np.asarray(at.is_valid()), n)
    place[given] = at.flatten().to_numpy(zero_copy_only=False)
    if len(place) and (place.min() < 0 or place.max() >= width):
        raise ValueError(f"a place lies outside a line of {width}")
    a = np.zeros((len(n), width), complex)
    np.add.at(a, (row, place), re.flatten().to_numpy(zero_copy_only=False) + 1j * im.flatten().to_numpy(zero_copy_only=False))
    return a


def _lists(a: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(np.ascontiguousarray(a).ravel()))


def transform(given: DataFrame, width: int, height: int, inverse: bool = False, twist: bool = False) -> DataFrame:
    """The transform of each field of `height` lines of `width` places, as `width` full lines of `height`.

    Lines that aren't there are dark, a field without lines isn't in the result, an empty table gives an
    empty one, and a field_id of null is a field like any other. A place or line outside is an error. The
    inverse divides by the number of places. With `twist`, value p of line j is turned by the angle of
    j p over the number of places before the second pass.
    """
    if not (0 < width <= LONGEST and 0 < height <= LONGEST):
        raise ValueError(f"lines of 1 to {LONGEST} places, not {width} x {height}")
    block, step, size = max(1, min(width, CELLS // height)), max(1, CELLS // width), width * height
    sign, count = 1 if inverse else -1, -(-width // block)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                line = part.column("line").to_numpy(zero_copy_only=False)
                if line.min() < 0 or line.max() >= height:
                    raise ValueError(f"a line lies outside a field of {height}")
                a = np.zeros((len(line), count * block), complex)
                a[:, :width] = _sums(_full(part, width), 1, inverse)
                if twist:
                    a[:, :width] *= np.exp(sign * 2j * math.pi / size * (line[:, None] * np.arange(width) % size))
                a = a.reshape(-1, block)
                ids = part.column("field_id").take(pa.array(np.repeat(np.arange(len(line)), count)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(count), len(line))), pa.array(np.repeat(line, count)), _lists(a.real), _lists(a.imag)], names=["field_id", "block", "line", "re", "im"])

    def across(key: tuple, pieces: pa.Table) -> pa.Table:
        a = np.zeros((height, block), complex)
        flat = [pieces.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, block) for c in ("re", "im")]
        np.add.at(a, pieces.column("line").to_numpy(), flat[0] + 1j * flat[1])
        begin = key[1].as_py() * block
        found = _sums(a, 0, inverse).T[: width - begin] / (size if inverse else 1)
        n = len(found)
        return pa.table({"field_id": pa.array([key[0].as_py()] * n, pa.int64()), "line": np.arange(begin, begin + n), "at": pa.nulls(n, pa.list_(pa.int32())), "re": _lists(found.real), "im": _lists(found.imag)})

    pieces = given.select("field_id", "line", "at", "re", "im").mapInArrow(along, PIECES)
    return pieces.groupBy("field_id", "block").applyInArrow(across, LINES)


def power(spectrum: DataFrame) -> DataFrame:
    """The squared amounts of full lines as real lines."""
    squares = F.zip_with("re", "im", lambda a, b: a * a + b * b)
    return spectrum.select("field_id", "line", "at", squares.alias("re"), F.transform("im", lambda _: lit(0)).alias("im"))


def correlation(given: DataFrame, width: int, height: int, least: float | None = None) -> DataFrame:
    """The periodic correlation of each field with itself, by the power of its spectrum: full lines, lag
    (line, place). Real for real fields. With `least` only lags of at least so much, `at` telling which.

    A field of at most WHOLE places is transformed there and back in one task, so that only its given
    lines cross the network; a larger one goes by blocks.
    """
    if width * height > WHOLE:
        found = transform(power(transform(given, width, height)), height, width, inverse=True)
        if least is None:
            return found
        kept = F.filter(F.transform(F.arrays_zip("re", "im"), lambda v, i: F.struct(i.alias("at"), v["re"].alias("re"), v["im"].alias("im"))), lambda v: v["re"] >= lit(least))
        return found.select("field_id", "line", kept.alias("v")).select("field_id", "line", F.col("v.at").alias("at"), F.col("v.re").alias("re"), F.col("v.im").alias("im"))

    def whole(key: tuple, held: pa.Table) -> pa.Table:
        line = held.column("line").to_numpy()
        if line.min() < 0 or line.max() >= height:
            raise ValueError(f"a line lies outside a field of {height}")
        a = np.zeros((height, width), complex)
        for part, at in zip(batches := held.to_batches(), np.cumsum([0] + [b.num_rows for b in batches])):
            np.add.at(a, line[at : at + part.num_rows], _full(part, width))
        if a.imag.any():
            spectrum = np.fft.fft2(a)
            found = np.fft.ifft2(spectrum.real**2 + spectrum.imag**2)
        else:
            spectrum = np.fft.rfft2(a.real)
            found = np.fft.irfft2(spectrum.real**2 + spectrum.imag**2, s=(height, width))
        field = lambda n: pa.array([key[0].as_py()] * n, pa.int64())
        if least is None:
            return pa.table({"field_id": field(height), "line": np.arange(height), "at": pa.nulls(height, pa.list_(pa.int32())), "re": _lists(found.real), "im": _lists(found.imag)})
        on, at = np.nonzero(found.real >= least)
        ends = pa.array(np.searchsorted(on, np.arange(height + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int32), found.real[on, at], found.imag[on, at])]
        return pa.table({"field_id": field(height), "line": np.arange(height), "at": lists[0], "re": lists[1], "im": lists[2]})

    return given.select("field_id", "line", "at", "re", "im").groupBy("field_id").applyInArrow(whole, LINES)


def _laid_out(n: int, longest: int) -> tuple[int, int] | None:
    """The two most even factors of n, both at most `longest`."""
    low = next(d for d in range(math.isqrt(n), 0, -1) if n % d == 0)
    return (low, n // low) if n // low <= longest else None


def _chirp(at: str, n: int, sign: int) -> tuple[Column, Column]:
    angle = lit(sign * math.pi / n) * (F.col(at) * F.col(at) % (2 * n))
    return F.cos(angle), F.sin(angle)


def signal_transform(signals: DataFrame, n: int, inverse: bool = False, longest: int = LONGEST) -> DataFrame:
    """signals: (field_id, i, re[, im]) of n places each, n up to 2^31. Their transforms: field_id, k, re,
    im; the inverse divides by n. Places without a row are 0.

    A length with two factors of at most `longest` is laid out as a field of that shape; any other is
    turned by a chirp and becomes a convolution over a power of two.
    """
    if not 0 < n <= 1 << 31:
        raise ValueError(f"a signal of 1 to 2^31 places, not {n}")
    im = F.coalesce(F.col("im").cast("double"), lit(0)) if "im" in signals.columns else lit(0)
    given = signals.select("field_id", F.col("i").cast("long").alias("i"), F.coalesce(F.col("re").cast("double"), lit(0)).alias("re"), im.alias("im"))
    shape = _laid_out(n, longest)
    if shape:
        width, height = shape
        laid = given.select("field_id", (F.col("i") % height).alias("line"), F.floor(F.col("i") / height).alias("at"), "re", "im")
        return values(transform(lines(laid), width, height, inverse, twist=True)).select("field_id", (F.col("line") + F.col("at").cast("long") * width).alias("k"), "re", "im")
    size, sign = 1 << (2 * n - 2).bit_length(), 1 if inverse else -1
    if _laid_out(size, longest) is None:
        raise ValueError(f"lines of {longest} are too short for a signal of {n}")

    def times(df: DataFrame, key: str, by: tuple[Column, Column], scale: float = 1.0) -> DataFrame:
        c, s = by
        return df.select("field_id", key, ((F.col("re") * c - F.col("im") * s) * lit(scale)).alias("re"), ((F.col("re") * s + F.col("im") * c) * lit(scale)).alias("im"))

    c, s = _chirp("id", n, -sign)
    both = F.array_distinct(F.array(F.col("id"), (F.lit(size) - F.col("id")) % size))
    back = signals.sparkSession.range(n).select(F.lit(0).cast("long").alias("field_id"), F.explode(both).alias("i"), c.alias("re"), s.alias("im"))
    kernel = signal_transform(back, size, longest=longest).select("k", F.col("re").alias("c"), F.col("im").alias("s"))
    turned = signal_transform(times(given, "i", _chirp("i", n, sign)), size, longest=longest)
    folded = signal_transform(times(turned.join(kernel, "k"), "k", (F.col("c"), F.col("s"))).withColumnRenamed("k", "i"), size, inverse=True, longest=longest)
    return times(folded.where(F.col("k") < n), "k", _chirp("k", n, sign), 1 / n if inverse else 1.0)
