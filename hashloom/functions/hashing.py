"""Feature hashes and what is derived from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the 32-bit Murmur3 string hash that feature ids are built from.
STRING_SEED = 0xF7CA7FD2
_C1, _C2, _M32 = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF


def _rotate(x: int, by: int) -> int:
    return ((x << by) | (x >> (32 - by))) & _M32


def _murmur_units(units: list[int], seed: int) -> int:
    """Murmur3 over UTF-16 code units: two units make one 32-bit word, the length in units finishes it."""
    h, n = seed & _M32, len(units)
    for i in range(0, n - 1, 2):
        k = (((units[i] << 16) + units[i + 1]) & _M32) * _C1 & _M32
        h = _rotate(h ^ (_rotate(k, 15) * _C2 & _M32), 13)
        h = (h * 5 + 0xE6546B64) & _M32
    if n & 1:
        h ^= _rotate(units[-1] * _C1 & _M32, 15) * _C2 & _M32
    h ^= n
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M32
    return h ^ (h >> 16)


def hash64(text: str) -> int:
    """The 64-bit feature hash: low word with the fixed seed, high word seeded with the low one; signed."""
    raw = text.encode("utf-16-be", "surrogatepass")
    units = [(raw[i] << 8) | raw[i + 1] for i in range(0, len(raw), 2)]
    low = _murmur_units(units, STRING_SEED)
    value = (_murmur_units(units, low) << 32) | low
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(T.LongType())
def feature_hash(names: pd.Series) -> pd.Series:
    """``hash64`` of each string, null for null. Distinct strings of a batch are hashed once."""
    codes, distinct = pd.factorize(names)
    hashes = np.array([hash64(x) for x in distinct] or [0], dtype=np.int64)
    out = pd.Series(hashes[np.maximum(codes, 0)], dtype="Int64")
    out[codes < 0] = pd.NA
    return out


def md5_hash(name: Column) -> Column:
    """A 60-bit hash any SQL engine can repeat: the first 15 hexadecimal digits of the md5."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def native_hash(name: Column) -> Column:
    """Spark's own 64-bit hash: the fastest, for use within the engine."""
    return F.xxhash64(name)


def to_unit(code: Column, legacy: bool = False) -> Column:
    """A 64-bit hash as a number in [0, 1); ``legacy`` gives code / 2^63 in [-1, 1], on which a rate r keeps (1 + r) / 2 of all rows."""
    scaled = code.cast("double") / F.lit(9.223372036854775807e18)
    return scaled if legacy else F.pmod(code, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def keep_sampled(row_id: Column, rate: float, unit: Column | None = None) -> Column:
    """Deterministic row sample: true where the unit hash of the row id lies below ``rate`` (strict)."""
    return (to_unit(F.xxhash64(row_id)) if unit is None else unit) < F.lit(float(rate))
