"""Dense-array arithmetic as column expressions; all sums are taken in DOUBLE."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda, an expression is otherwise computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_sum(a: str | Column) -> Column:
    """Sum of the elements; 0 for an empty array, null for a null one, null elements skipped."""
    return F.aggregate(F.filter(_col(a), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x.cast("double"))


def axpy(into: str | Column, add: str | Column, times: float | Column = 1.0) -> Column:
    """into + times * add, element by element."""
    t = F.lit(times) if isinstance(times, (int, float)) else times
    return F.zip_with(_col(into), _col(add), lambda x, y: x.cast("double") + y.cast("double") * t)


def normalize(a: str | Column) -> Column:
    """Elements divided by their sum; null elements where the sum is 0."""
    return bound(array_sum(a), lambda s: F.transform(_col(a), lambda x: F.try_divide(x.cast("double"), s)))


def log_normalizer(a: str | Column) -> Column:
    """log of the sum of exponentials, shifted by the largest element; null for an empty array."""
    return bound(F.array_max(_col(a)).cast("double"), lambda m: m + F.log(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - m))))


def log_normalize(a: str | Column) -> Column:
    """exp(x - log normaliser): sums to 1 for any offset of the input."""
    return bound(log_normalizer(a), lambda z: F.transform(_col(a), lambda x: F.exp(x.cast("double") - z)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _running(a: pd.Series) -> pd.Series:
    return a.map(lambda x: None if x is None else np.cumsum(np.array(x, dtype=float)))


def cumulative_sum(a: str | Column) -> Column:
    """Running sums; null for a null array, and from the first null element on NaN. One pass over each array, in Arrow batches."""
    return _running(_col(a).cast("array<double>"))


def dense_dot(ids: str | Column, weights: str | Column) -> Column:
    """Sum of the weights at 0-based positions ``ids``; positions outside count 0."""
    w = _col(weights)
    return F.aggregate(_col(ids), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(w, i.cast("int")).cast("double"), F.lit(0.0)))


def sparse_dot(a: str | Column, b: str | Column) -> Column:
    """Number of common ids of two sets."""
    return F.size(F.array_intersect(_col(a), _col(b)))


def top_k(a: str | Column, k: int) -> Column:
    """ARRAY<STRUCT<idx, value>> of the k largest, descending; equal values by position."""
    pairs = F.transform(_col(a), lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("idx"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["idx"].alias("idx"), p["value"].alias("value")))


def sort_parallel(keys: str | Column, values: str | Column) -> Column:
    """ARRAY<STRUCT<key, value>> in the order of the keys (values of equal keys by value)."""
    return F.sort_array(F.zip_with(_col(keys), _col(values), lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def array_quantiles(a: str | Column, qs: list[float]) -> Column:
    """sorted[int(min(q n, n - 1))] for each q, without interpolation; nulls for an empty array."""
    at = lambda s, q: F.get(s, F.least(F.lit(q) * F.size(s), F.size(s) - 1.0).cast("int"))
    return bound(F.sort_array(F.filter(_col(a), lambda x: x.isNotNull())), lambda s: F.array(*[at(s, q) for q in qs]))


def as_set(a: str | Column) -> Column:
    """Sorted distinct non-null ids."""
    return F.sort_array(F.array_distinct(F.array_compact(_col(a))))


def truncated(name: str | Column, length: int) -> Column:
    return F.substring(_col(name), 1, length)
