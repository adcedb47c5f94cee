"""Semi-supervised multinomial naive Bayes by EM, with soft labels as per-row priors.

Parameters stay in long form (col_id, k, log_theta), priors are (row_id, k, log_prior), so that a round is two joins and two
aggregates however many features there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashloom.functions.arrays import log_normalizer
from hashloom.functions.hashing import to_unit
from hashloom.operators.skew import sized_join
from hashloom.session import checkpointed

NEG_INF = float("-inf")


def log_or_inf(x: Column) -> Column:
    """ln x, minus infinity for 0."""
    return F.when(x > 0, F.log(x)).otherwise(F.lit(NEG_INF))


def posteriors(triplets: DataFrame, log_theta: DataFrame, log_priors: DataFrame) -> DataFrame:
    """(row_id, k, post, ll): normalised prior x product of thetas; ll is the row's log likelihood.

    Every row with priors appears; rows without features keep their priors. Features without theta are left out.
    """
    x = sized_join(triplets, log_theta.select("col_id", "k", "log_theta"), "col_id").groupBy("row_id", "k").agg(F.sum(F.col("value") * F.col("log_theta")).alias("s"))
    score = log_priors.join(x, ["row_id", "k"], "left").select("row_id", "k", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))
    # one row per record and class: a record's classes are few, so they are put together in arrays
    rows = score.groupBy("row_id").agg(F.collect_list(F.struct("k", "score")).alias("c"))
    return rows.withColumn("ll", log_normalizer("c.score")).select("row_id", "ll", F.explode("c").alias("e")).select("row_id", F.col("e.k").alias("k"), F.exp(F.col("e.score") - F.col("ll")).alias("post"), "ll")


def emissions(triplets: DataFrame, post: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numerators (col_id, k, num) and denominators (k, den): features, and all features, weighted with posteriors."""
    cells = triplets.join(post.select("row_id", "k", "post"), "row_id")
    num = cells.groupBy("col_id", "k").agg(F.sum(F.col("value") * F.col("post")).alias("num"))
    return num, num.groupBy("k").agg(F.sum("num").alias("den"))


def m_step_ml(num: DataFrame, den: DataFrame) -> DataFrame:
    """log(num / den) without smoothing; minus infinity where num is 0."""
    return num.join(F.broadcast(den), "k").select("col_id", "k", log_or_inf(F.try_divide("num", "den")).alias("log_theta"))  # den: one row per class


def feature_rates(triplets: DataFrame) -> DataFrame:
    """(col_id, rate): share of all entries."""
    nnz = triplets.agg(F.sum("value")).scalar()
    return triplets.groupBy("col_id").agg(F.sum("value").alias("n")).select("col_id", F.try_divide(F.col("n"), nnz).alias("rate"))


def m_step_map(num: DataFrame, den: DataFrame, rates: DataFrame, weight: float) -> DataFrame:
    """log((num + w) / (den + w / rate)): pulled towards the overall rate by ``weight`` pseudo-observations."""
    x = num.join(F.broadcast(den), "k").join(rates, "col_id")
    return x.select("col_id", "k", F.log((F.col("num") + weight) / (F.col("den") + F.lit(weight) / F.col("rate"))).alias("log_theta"))


def random_start(triplets: DataFrame, priors: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Emissions of one class per row, drawn from its priors (row_id, k, prior) by the hash of the row id: the same in every layout."""
    u = to_unit(F.xxhash64(F.col("row_id"), F.lit(seed)))
    drawn = priors.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("k", "prior"))).alias("c")).withColumn("u", u)
    upto = lambda i: F.aggregate(F.slice("c", 1, i + 1), F.lit(0.0), lambda a, e: a + e["prior"])
    first = F.filter(F.transform("c", lambda e, i: F.struct(e["k"].alias("k"), upto(i).alias("upto"))), lambda e: F.col("u") <= e["upto"])
    return emissions(triplets, drawn.select("row_id", F.coalesce(F.get(first, 0)["k"], F.element_at("c", -1)["k"]).alias("k"), F.lit(1.0).alias("post")))


def em(triplets: DataFrame, priors: DataFrame, weight: float = 1.0, rounds: int = 100, min_gain: float = 1e-10, seed: int = 0, start: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """(log_theta, posteriors, log likelihoods by round) after EM with MAP steps until the log likelihood gains less than ``min_gain``.

    Theta is written to the shared folder each round, so that lineage doesn't grow. The driver keeps one number per round. ``start`` is
    (num, den) of ``emissions`` in place of random ones.
    """
    triplets, rates = checkpointed(triplets), checkpointed(feature_rates(triplets))
    log_priors = checkpointed(priors.select("row_id", "k", log_or_inf(F.col("prior")).alias("log_prior")))
    num, den = start or random_start(triplets, priors, seed)
    theta, history, post = checkpointed(m_step_map(num, den, rates, weight)), [], None
    for _ in range(rounds):
        post = checkpointed(posteriors(triplets, theta, log_priors))
        history.append(post.groupBy("row_id").agg(F.first("ll").alias("ll")).agg(F.sum("ll")).first()[0] or 0.0)
        if len(history) > 1 and history[-1] - history[-2] < min_gain:
            break
        num, den = emissions(triplets, post)
        theta = checkpointed(m_step_map(num, den, rates, weight))
    return theta, post, history


def top_features(theta: DataFrame, rates: DataFrame, k: int) -> DataFrame:
    """(k, col_id, lift, rank): the features most typical of each class, by theta over the overall rate, ties by column."""
    from hashloom.operators.mixed import top_k_per_group

    lifts = theta.join(rates, "col_id").select("k", "col_id", F.round(F.exp("log_theta") / F.col("rate"), 9).alias("lift"))
    return top_k_per_group(lifts, "k", "lift", "col_id", k)
