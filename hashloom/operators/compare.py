"""Statistical comparison of two row slices, column by column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def welch_t(target: tuple[Column, Column, Column], reference: tuple[Column, Column, Column]) -> Column:
    """Welch's t from (sum, sum of squares, n) of both sides, with population variances E[x^2] - E[x]^2.

    Null only if numerator and denominator are both 0, or a side is empty; a zero denominator alone gives plus or minus infinity.
    """

    def moments(s: Column, sq: Column, n: Column) -> tuple[Column, Column]:
        mean = F.try_divide(s, n)
        return mean, F.try_divide(sq, n) - mean * mean

    (m1, v1), (m2, v2) = moments(*target), moments(*reference)
    top = m1 - m2
    below = F.sqrt(F.greatest(F.try_divide(v1, target[2]) + F.try_divide(v2, reference[2]), F.lit(0.0)))
    infinite = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf")))
    return F.when(below == 0, infinite).otherwise(F.try_divide(top, below))


def smoothed_ratio(target_count: Column, target_n: Column, ref_count: Column, ref_n: Column, prior: float) -> Column:
    """((tc + r p) / (tn + p)) / r with r = rc / rn; null unless tn, rn and rc are positive."""
    r = F.try_divide(ref_count.cast("double"), ref_n)
    ratio = F.try_divide((target_count + r * prior) / (target_n + prior), r)
    return F.when((target_n > 0) & (ref_n > 0) & (ref_count > 0), ratio)


def compare(long: DataFrame, slices: DataFrame, prior: float = 5.0, tests: dict[str, str] | None = None) -> DataFrame:
    """(col, kind, test, score): one test per column of ``long`` (row_id, kind, col, value).

    ``slices`` has (row_id, is_target BOOLEAN), one row per row of either slice. Dense columns are taken for proportions and get
    Welch's t, sparse ones for binary and get the smoothed ratio of rates, unless ``tests`` ("t" or "ratio" by column) says
    otherwise; sums of squares are taken for any column. Both slices are summed up in one pass.
    """
    size = lambda c: slices.agg(F.count_if(c).cast("double")).scalar()
    x = F.col("value").cast("double")
    on = lambda c: F.coalesce(F.sum(F.when(F.col("is_target"), c)), F.lit(0.0))
    off = lambda c: F.coalesce(F.sum(F.when(~F.col("is_target"), c)), F.lit(0.0))
    sums = long.join(slices, "row_id").groupBy("col", "kind").agg(on(x).alias("ts"), on(x * x).alias("tq"), off(x).alias("rs"), off(x * x).alias("rq"))
    one = sums.withColumn("tn", size(F.col("is_target"))).withColumn("rn", size(~F.col("is_target")))
    default = F.when(F.col("kind") == "dense", "t").otherwise("ratio")
    if tests:
        chosen = default
        for c, t in tests.items():
            chosen = F.when(F.col("col") == c, t).otherwise(chosen)
        default = chosen
    t = welch_t((F.col("ts"), F.col("tq"), F.col("tn")), (F.col("rs"), F.col("rq"), F.col("rn")))
    ratio = smoothed_ratio(F.col("ts"), F.col("tn"), F.col("rs"), F.col("rn"), prior)
    tested = one.withColumn("test", default)
    return tested.select("col", "kind", "test", F.when(F.col("test") == "t", t).otherwise(ratio).alias("score"))


def top_tests(tests: DataFrame, k: int = 50) -> DataFrame:
    """The k columns with the largest absolute score of each test, ranked; columns without a score are left out, ties by column.

    One row per column goes in, so a window per test is small against the data compared.
    """
    rank = F.row_number().over(Window.partitionBy("test").orderBy(F.desc(F.abs("score")), "col"))
    return tests.where("score is not null").withColumn("rank", rank).where(F.col("rank") <= k)


def report(ranked: DataFrame) -> DataFrame:
    """(test, rank, line): numbered lines, best first."""
    return ranked.select("test", "rank", F.format_string("%d. %s: %.6f", F.col("rank"), F.col("col"), F.round("score", 6)).alias("line"))
