"""32-bit integer mixing on BIGINT columns, with products split so that none overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = (1 << 32) - 1


def multiply32(a: Column, k: int) -> Column:
    """a * k modulo 2^32 for 0 <= a < 2^32."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)
    high = F.shiftright(a, 16) * F.lit(k & 0xFFFF)
    return (low + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(WORD))


def _shifted(a: Column, n: int) -> Column:
    return a.bitwiseXOR(F.shiftright(a, n))


def mix32(a: Column) -> Column:
    """The finaliser with the fixed values 16, 0x7feb352d, 15, 0x846ca68b, 16."""
    a = multiply32(_shifted(a.bitwiseAND(F.lit(WORD)), 16), 0x7FEB352D)
    a = multiply32(_shifted(a, 15), 0x846CA68B)
    return _shifted(a, 16)


def unit32(a: Column) -> Column:
    return a / F.lit(float(1 << 32))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the UTF-16 code units of a text, as BIGINT; offset 2166136261 and prime 16777619 are
    fixed values. A character beyond the basic plane is two units."""
    point = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    units = F.flatten(F.transform(point, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(0xD800 + F.shiftright(p - 0x10000, 10), 0xDC00 + (p - 0x10000).bitwiseAND(F.lit(0x3FF))))))
    hashed = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: multiply32(h.bitwiseXOR(u), 16777619))
    return F.when(text == "", F.lit(2166136261).cast("long")).otherwise(hashed)


def hex32(a: Column) -> Column:
    return F.lower(F.lpad(F.hex(a), 8, "0"))


def sample_seed(master: Column, sample: Column, attempt: Column) -> Column:
    """Seed of one attempt at one sample: the master seed mixed with both words of the sample number and
    the attempt. The three 32-bit constants are fixed values."""
    word = lambda v: v.bitwiseAND(F.lit(WORD))
    parts = [(word(sample), 0x9E3779B9), (word(F.shiftright(sample, 32)), 0x85EBCA6B), (word(attempt), 0xC2B2AE35)]
    mixed = word(master)
    for part, constant in parts:
        mixed = mixed.bitwiseXOR(mix32(part.bitwiseXOR(F.lit(constant))))
    return mix32(mixed)


def stream32(seed: Column, index: Column) -> Column:
    """The index-th number (from 0) of the 32-bit generator whose state advances by the fixed value
    0x6D2B79F5: any place of the stream on its own."""
    word = lambda v: v.bitwiseAND(F.lit(WORD))
    state = word(seed + multiply32(word(index + 1), 0x6D2B79F5))
    value = product32(_shifted(state, 15), state.bitwiseOR(F.lit(1)))
    value = value.bitwiseXOR(word(value + product32(_shifted(value, 7), value.bitwiseOR(F.lit(61)))))
    return _shifted(value, 14)


def product32(a: Column, b: Column) -> Column:
    """a * b modulo 2^32 for two columns of 32-bit numbers."""
    low = a.bitwiseAND(F.lit(0xFFFF)) * b
    high = (F.shiftright(a, 16) * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFF))
    return (low.bitwiseAND(F.lit(WORD)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(WORD))
