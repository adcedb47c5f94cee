"""Draws that depend on a key and a seed only, never on the layout of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.hashing import to_unit


def draw(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) by the hash of the key."""
    return to_unit(F.xxhash64(*key, F.lit(seed)))


def multinomial(cumulative: str | Column, u: Column) -> Column:
    """The first position whose cumulative probability reaches u, else the last one; null for an empty array."""
    c = F.col(cumulative) if isinstance(cumulative, str) else cumulative
    return F.when(F.size(c) > 0, F.least(F.size(F.filter(c, lambda x: x < u)), F.size(c) - 1))


def binomial_rows(rows: DataFrame, rates: DataFrame, seed: int = 0, unit: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(row_id, col_id): column i is present in a row if its draw lies below rates (col_id, rate).

    ``unit`` makes another draw out of row and column.

    The rates are one array per row of ``rows``; they are a model's parameters, not data, and at most a million are taken.
    """
    n = rates.count()
    if n > 1_000_000:
        raise ValueError("more than a million rates")
    packed = rates.agg(F.sort_array(F.collect_list(F.struct("col_id", "rate")))).scalar()
    each = rows.select("row_id", F.explode(packed).alias("x"))
    u = unit(F.col("row_id"), F.col("x.col_id")) if unit else draw(F.col("row_id"), F.col("x.col_id"), seed=seed)
    return each.where(u < F.col("x.rate")).select("row_id", F.col("x.col_id").alias("col_id"))


def power_law(spark: SparkSession, high: float, low: float, n: int) -> DataFrame:
    """(col_id, rate): from ``high`` down to ``low``, each rate the same factor below the one before."""
    if n < 1 or low <= 0 or high <= 0:
        raise ValueError("n, high and low must be positive")
    exponent = F.col("id") / float(max(n - 1, 1))
    return spark.range(n).select(F.col("id").alias("col_id"), (F.lit(high) * F.pow(F.lit(low / high), exponent)).alias("rate"))
