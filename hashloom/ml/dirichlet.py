"""Dirichlet distributions fitted to count vectors, and likelihood ratios of two count vectors.

Fits run on histograms: for each dimension, how many observations have each count. A histogram is one distributed aggregate, and its
size doesn't grow with the number of observations, only with the largest count.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.functions.special import digamma, log_gamma
from hashloom.session import checkpointed

#: Bins of all histograms together.
BINS = 20_000_000


@dataclass
class Dirichlet:
    """magnitude x partition are the parameters."""

    magnitude: float
    partition: np.ndarray

    @classmethod
    def of(cls, alpha) -> Dirichlet:
        a = np.asarray(alpha, dtype=float)
        return cls(float(a.sum()), a / a.sum())

    @classmethod
    def symmetric(cls, size: int, alpha: float = 1.0) -> Dirichlet:
        return cls(size * alpha, np.full(size, 1 / size))

    @property
    def size(self) -> int:
        return len(self.partition)

    def alpha(self, i: int | None = None):
        return self.magnitude * (self.partition if i is None else self.partition[i])

    def absolute_difference(self, other: Dirichlet) -> float:
        return float(np.abs(self.alpha() - other.alpha()).sum())

    def squared_difference(self, other: Dirichlet) -> float:
        return float(((self.alpha() - other.alpha()) ** 2).sum())

    def likelihood_ratio(self, x, y) -> float:
        """Log odds that two count vectors come from the same multinomial rather than from two."""
        return _ratio(x, y, self.alpha(), self.magnitude)


def histograms(counts: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """(histogram of counts by dimension, histogram of lengths) of counts (row_id, k 0-based, n), zeros needn't be listed.

    The histograms are written and counted first: more than BINS rows, or a largest count or dimension beyond that, are refused, as the
    fits hold them in the driver's memory.
    """
    positive = counts.where("n > 0")
    by_dim = checkpointed(positive.groupBy("k", "n").agg(F.count(F.lit(1)).alias("m")))
    by_len = checkpointed(positive.groupBy("row_id").agg(F.sum("n").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("m")))
    dense = by_dim.groupBy("k").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    if max(by_dim.count(), by_len.count(), dense[0], dense[1], by_len.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]) > BINS:
        raise ValueError(f"histograms of more than {BINS} bins")
    own: dict[int, dict[int, int]] = defaultdict(dict)
    for r in by_dim.collect():
        own[r["k"]][r["n"]] = r["m"]
    return [_dense(own.get(k, {})) for k in range(max(own, default=-1) + 1)], _dense({r["n"]: r["m"] for r in by_len.collect()})


def _dense(counts: dict[int, int]) -> np.ndarray:
    out = np.zeros(max(counts, default=0) + 1)
    for n, m in counts.items():
        out[n] = m
    return out


def _rises(hist: np.ndarray, a: float) -> float:
    """The sum over observations of digamma(n + a) - digamma(a), by the recurrence of digamma: n terms 1 / (a + i)."""
    return float((hist[1:] * np.cumsum(1 / (a + np.arange(len(hist) - 1)))).sum()) if len(hist) > 1 else 0.0


def fit_histogram(alpha, dims: list[np.ndarray], lengths: np.ndarray, rounds: int = 200, shape: float = 1.00001, scale: float = 1.0) -> np.ndarray:
    """Fixed point of the parameters under a gamma prior (shape, scale) on each; shape 0 and infinite scale give maximum likelihood."""
    a = np.array(alpha, dtype=float)
    for _ in range(rounds):
        below = _rises(lengths, a.sum()) - (1 / scale if np.isfinite(scale) else 0.0)
        a = np.array([x * (_rises(h, x) + shape) / below for x, h in zip(a, dims)])
    return a


def fit_maximum_likelihood(alpha, dims: list[np.ndarray], lengths: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """The same fixed point without prior, until it stands still."""
    a = np.array(alpha, dtype=float)
    for _ in range(rounds):
        new = fit_histogram(a, dims, lengths, 1, 0.0, np.inf)
        if np.abs(new - a).sum() < tolerance:
            return new
        a = new
    return a


def fit_digamma(alpha, dims: list[np.ndarray], lengths: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """The same with digamma itself in place of its recurrence."""
    a = np.array(alpha, dtype=float)
    rise = lambda h, x: float((h * (digamma(np.arange(len(h)) + x) - digamma(x))).sum())
    for _ in range(rounds):
        new = np.array([x * rise(h, x) for x, h in zip(a, dims)]) / rise(lengths, a.sum())
        if np.abs(new - a).sum() < tolerance:
            return new
        a = new
    return a


def fit_leave_one_out(alpha, dims: list[np.ndarray], lengths: np.ndarray, rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Fixed point of the leave-one-out likelihood."""
    a = np.array(alpha, dtype=float)
    term = lambda h, x: float((h[1:] * np.arange(1, len(h)) / (np.arange(len(h) - 1) + x)).sum())
    for _ in range(rounds):
        new = np.array([x * term(h, x) for x, h in zip(a, dims)]) / term(lengths, a.sum())
        if np.abs(new - a).sum() < tolerance:
            return new
        a = new
    return a


def fit_symmetric(dims: list[np.ndarray], lengths: np.ndarray, current: float, rounds: int = 200) -> float:
    """The sum of the parameters of a symmetric Dirichlet: all dimensions pooled into one histogram."""
    size = len(dims)
    pooled = np.zeros(max(len(h) for h in dims))
    for h in dims:
        pooled[: len(h)] += h
    total = current
    for _ in range(rounds):
        total *= _rises(pooled, total / size) / (size * _rises(lengths, total)) * 1.0
    return float(total)


def moments(proportions: DataFrame) -> DataFrame:
    """(k, mean, var) of proportions (row_id, k, p), every dimension of every row listed; var has the divisor n - 1."""
    return proportions.groupBy("k").agg(F.avg("p").alias("mean"), F.var_samp("p").alias("var"))


def fit_moments(stats: list[tuple[float, float]]) -> np.ndarray:
    """Parameters from (mean, variance) by dimension: the log magnitude is the sum of ln(m (1 - m) / v - 1) over the dimensions with m > 0,
    divided by their number less 1 (of all dimensions, also those with m = 0).

    That divisor belongs to a sum that leaves one dimension out; it is kept, as results are compared with those of that formula, so
    the magnitude comes out to the power K / (K - 1). ``fit_moments_but_last`` leaves one out. NaN where a variance is 0 or too
    large, as the logarithm has no value there.
    """
    m, v = np.array(stats, dtype=float).T
    with np.errstate(all="ignore"):
        logs = np.log(m * (1 - m) / v - 1)[m > 0]
        return m * np.exp(logs.sum() / (len(m) - 1))


def fit_moments_but_last(stats: list[tuple[float, float]]) -> np.ndarray:
    """Ronning's own estimate: the mean over all dimensions but the last, unusable ones (v = 0, or v >= m (1 - m)) left out."""
    m, v = np.array(stats, dtype=float).T
    usable = (v[:-1] > 0) & (m[:-1] * (1 - m[:-1]) > v[:-1])
    logs = np.log(m[:-1][usable] * (1 - m[:-1][usable]) / v[:-1][usable] - 1)
    return m * np.exp(logs.mean()) if len(logs) else m


def _ratio(x, y, alpha, total: float) -> float:
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if x.shape != y.shape:
        raise ValueError("both vectors must have the same number of dimensions")
    alpha = np.broadcast_to(np.asarray(alpha, dtype=float), x.shape)
    cells = log_gamma(alpha) + log_gamma(alpha + x + y) - log_gamma(alpha + x) - log_gamma(alpha + y)
    return float(cells.sum() + log_gamma(total + x.sum()) + log_gamma(total + y.sum()) - log_gamma(total) - log_gamma(total + x.sum() + y.sum()))


def likelihood_ratio(x, y, alpha: float, total: float) -> float:
    """As ``Dirichlet.likelihood_ratio`` with a symmetric prior."""
    return _ratio(x, y, alpha, total)


def ewens_ratio(x, y, rate: float) -> float:
    """Log odds under the Ewens sampling formula, from how many types have each count in x, in y and in both together."""
    x, y = np.asarray(x, dtype=int), np.asarray(y, dtype=int)
    if x.shape != y.shape:
        raise ValueError("both vectors must have the same number of dimensions")
    n = int(x.sum() + y.sum())
    hx, hy, both = (np.bincount(c, minlength=n + 1)[1:] for c in (x, y, x + y))
    j = np.arange(1, n + 1)
    terms = (both - hx - hy) * np.log(rate / j) + log_gamma(hx + 1.0) + log_gamma(hy + 1.0) - log_gamma(both + 1.0)
    seats = lambda m: float(log_gamma(rate + m) - log_gamma(rate) - log_gamma(m + 1.0))
    return float(terms.sum()) + seats(x.sum()) + seats(y.sum()) - seats(n)
