"""Gamma-family functions on numpy arrays, for kernels that run inside Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bernoulli terms B_2k / (2k (2k - 1)) of the Stirling series of log gamma, and B_2k / 2k of digamma.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
DIGAMMA_TERMS = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760, 1 / 12)


def log_gamma(z) -> np.ndarray:
    """log |gamma| for positive arguments: Stirling's series after shifting the argument to at least 8."""
    z = np.asarray(z, dtype=float)
    shift, x = np.zeros_like(z), z.copy()
    while (low := x < 8).any():
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    r = 1 / x
    series = sum(c * r ** (2 * k + 1) for k, c in enumerate(STIRLING))
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def log_gamma_nemes(z) -> np.ndarray:
    """Nemes' short approximation."""
    z = np.asarray(z, dtype=float)
    return 0.5 * (math.log(2 * math.pi) - np.log(z)) + z * (np.log(z + 1 / (12 * z - 1 / (10 * z))) - 1)


def log_gamma_definition(z: float, terms: int = 1_000_000) -> float:
    """Euler's limit product, with ``terms`` factors: slow, for comparison only."""
    n = np.arange(1, terms + 1)
    return float(-math.log(z) + (z * np.log1p(1 / n) - np.log1p(z / n)).sum())


def log_gamma_difference(z, n: int) -> np.ndarray:
    """log gamma(z + n) - log gamma(z), as a sum of n logarithms."""
    z = np.asarray(z, dtype=float)
    return sum((np.log(z + i) for i in range(n)), np.zeros_like(z))


def digamma(z, legacy: bool = False) -> np.ndarray:
    """Derivative of log gamma, shifted to at least 9.5. ``legacy`` keeps only ln z - 1 / (2 z), with errors up to 9e-4."""
    z = np.asarray(z, dtype=float)
    shift, x = np.zeros_like(z), z.copy()
    while (low := x < 9.5).any():
        shift = np.where(low, shift + 1 / np.where(low, x, 1.0), shift)
        x = np.where(low, x + 1, x)
    out = np.log(x) - 1 / (2 * x) - shift
    return out if legacy else out - sum(c * x ** (-2 * (k + 1)) for k, c in enumerate(DIGAMMA_TERMS))


def digamma_difference(z, n: int) -> np.ndarray:
    """digamma(z + n) - digamma(z)."""
    z = np.asarray(z, dtype=float)
    return sum((1 / (z + i) for i in range(n)), np.zeros_like(z))


def trigamma(z) -> np.ndarray:
    """Derivative of digamma."""
    z = np.asarray(z, dtype=float)
    shift, x = np.zeros_like(z), z.copy()
    while (low := x < 9.5).any():
        shift = np.where(low, shift + np.where(low, x, 1.0) ** -2.0, shift)
        x = np.where(low, x + 1, x)
    series = sum(2 * (k + 1) * c * x ** (-2 * k - 3.0) for k, c in enumerate(DIGAMMA_TERMS))
    return 1 / x + 1 / (2 * x * x) + series + shift


@F.pandas_udf(T.DoubleType())
def log_gamma_udf(z: pd.Series) -> pd.Series:
    return pd.Series(log_gamma(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def digamma_udf(z: pd.Series) -> pd.Series:
    return pd.Series(digamma(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def trigamma_udf(z: pd.Series) -> pd.Series:
    return pd.Series(trigamma(z.to_numpy()))
