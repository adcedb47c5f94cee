import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.ml import dirichlet, iterate, lda, logistic, naive_bayes, samplers


def test_posterior_of_giveaway_features(spark):
    theta = [(c, k, float(np.log(0.4 if c in (0, 3, 6) and k == 0 else 0.001))) for c in range(20) for k in range(3)]
    t = spark.createDataFrame(theta, "col_id int, k int, log_theta double")
    x = spark.createDataFrame([(1, c, 1.0) for c in (0, 3, 6)], "row_id bigint, col_id int, value double")
    p = spark.createDataFrame([(r, k, float(np.log(q))) for r in (1, 2) for k, q in enumerate((0.3, 0.3, 0.4))], "row_id bigint, k int, log_prior double")
    post = {(r.row_id, r.k): r.post for r in naive_bayes.posteriors(x, t, p).collect()}
    assert abs(sum(post[1, k] for k in range(3)) - 1) < 1e-9 and post[1, 0] > 1 - 1e-5
    assert abs(post[2, 2] - 0.4) < 1e-9  # a row without features keeps its priors


def test_em_finds_the_classes(spark):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 300)
    cells = [(i, c, 1.0) for i, k in enumerate(truth) for c in range(30) if rng.random() < ((0.9 if (c < 5) == (k == 0) else 0.1) if c < 10 else 0.1)]
    x = spark.createDataFrame(cells, "row_id bigint, col_id int, value double")
    pr = spark.createDataFrame([(i, k, 0.7 if k == t else 0.3) for i, t in enumerate(truth.tolist()) for k in range(2)], "row_id bigint, k int, prior double")
    _, post, history = naive_bayes.em(x, pr, 1.0, rounds=4)
    own = {(r.row_id, r.k): r.post for r in post.collect()}
    assert np.mean([own[i, int(k)] for i, k in enumerate(truth)]) > 0.95
    assert all(b >= a - 1 for a, b in zip(history[1:], history[2:]))


def test_m_steps(spark):
    num = spark.createDataFrame([(0, 0, 2.0), (1, 0, 0.0)], "col_id int, k int, num double")
    den = spark.createDataFrame([(0, 4.0)], "k int, den double")
    ml = {r.col_id: r.log_theta for r in naive_bayes.m_step_ml(num, den).collect()}
    assert abs(ml[0] - np.log(0.5)) < 1e-12 and ml[1] == float("-inf")
    rates = spark.createDataFrame([(0, 0.5), (1, 0.25)], "col_id int, rate double")
    mp = {r.col_id: r.log_theta for r in naive_bayes.m_step_map(num, den, rates, 1.0).collect()}
    assert abs(mp[0] - np.log(3 / 6)) < 1e-12 and abs(mp[1] - np.log(1 / 8)) < 1e-12


def _points(n, seed=1):
    rng = np.random.default_rng(seed)
    w = np.array([0.5, -1.2, 0.3])
    x = rng.random((n, 3)) < (0.5, 0.5, 0.1)
    y = np.where(rng.random(n) < 1 / (1 + np.exp(-(x @ w))), 1.0, -1.0)
    return [(np.flatnonzero(r), np.ones(r.sum()), t) for r, t in zip(x, y)]


def test_sgd_recovers_weights_and_ridge_shrinks():
    rates = [0.1 / (1 + e) for e in range(4)]
    w = logistic.run_epochs(_points(20000), logistic.SgdUpdate(), rates)
    assert abs(w[0] - 0.5) < 0.2 and abs(w[1] + 1.2) < 0.2 and abs(w[2] - 0.3) < 0.25
    r = logistic.run_epochs(_points(20000), logistic.SgdUpdate("ridge", 2.0), rates)
    assert abs(r[1]) < abs(w[1]) and r[1] < 0 < r[0]
    assert logistic.run_epochs(_points(2000), logistic.SgdUpdate("lasso", 1e6), [0.1]) == {0: 0.0, 1: 0.0, 2: 0.0}
    with pytest.raises(ValueError):
        logistic.SgdUpdate("other")


def test_gradient_step(spark):
    x = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 0, 1.0)], "row_id bigint, col_id int, value double")
    y = spark.createDataFrame([(1, 1.0), (2, -1.0)], "row_id bigint, y double")
    w = spark.createDataFrame([(0, 0.5), (1, -0.25), (9, 1.0)], "col_id int, w double")
    p1, p2 = 0.1 / (1 + np.exp(0.25)), -0.1 / (1 + np.exp(0.25))
    got = {r.col_id: r.w for r in logistic.step(x, y, w, 0.1).collect()}
    assert abs(got[0] - 0.5 - p1) < 1e-12 and abs(got[1] + 0.25 - p1 - p2) < 1e-12 and got[9] == 1.0
    ridge = {r.col_id: r.w for r in logistic.step(x, y, w, 0.1, 2.0, logistic.ridge).collect()}
    assert abs(ridge[9] - 0.8) < 1e-12
    lasso = {r.col_id: r.w for r in logistic.step(x, y, w, 0.1, 3.0, logistic.lasso).collect()}
    assert lasso[1] == 0.0 and abs(lasso[9] - 0.7) < 1e-12


def test_sharded_sgd_doesnt_depend_on_the_layout(spark):
    pts = _points(400)
    v = spark.createDataFrame([(i, p[0].tolist(), p[1].tolist()) for i, p in enumerate(pts)], "row_id bigint, col_ids array<bigint>, vals array<double>")
    y = spark.createDataFrame([(i, float(p[2])) for i, p in enumerate(pts)], "row_id bigint, y double")
    one, two = ({r.col_id: round(r.w, 9) for r in logistic.sgd_averaged(v.repartition(n), y, logistic.SgdUpdate(), [0.1, 0.05], shards=4).collect()} for n in (1, 7))
    assert one == two
    whole = logistic.run_epochs(pts, logistic.SgdUpdate(), [0.1])
    got = {r.col_id: r.w for r in logistic.sgd_averaged(v, y, logistic.SgdUpdate(), [0.1], shards=1).collect()}
    assert all(abs(got[k] - whole[k]) < 1e-9 for k in whole)


def test_lda_separates_blocks_and_raises_the_bound(spark):
    rng = np.random.default_rng(0)
    docs = [(i, sorted({int(w) for w in rng.integers(0, 20, 12) + 20 * (i % 2)})) for i in range(60)] + [(60, [])]
    v = spark.createDataFrame(docs, "row_id bigint, col_ids array<bigint>").cache()
    m = lda.LdaModel.start(2, 40, 61, seed=1, even=True, tau0=1.0, alpha=0.1, eta=0.1)
    before = m.bound(v)
    for _ in range(5):
        m.learn(v)
    assert m.bound(v) > before
    top = [{w < 20 for w, _ in t} for t in m.top_words(5)]
    assert all(len(t) == 1 for t in top) and top[0] != top[1]
    topics = {r.row_id: int(np.argmax(r.gamma)) for r in m.document_topics(v).collect()}
    assert len({topics[i] for i in range(0, 60, 2)}) == 1 and topics[0] != topics[1]
    assert m.learn(v.limit(0)).updates == 5


def test_dirichlet_fits_agree(spark):
    rng = np.random.default_rng(5)
    counts = [rng.multinomial(200, p) for p in rng.dirichlet([2.0, 5.0, 1.0], 400)]
    rows = [(i, k, int(n)) for i, c in enumerate(counts) for k, n in enumerate(c)]
    df = spark.createDataFrame(rows, "row_id bigint, k int, n bigint")
    dims, lengths = dirichlet.histograms(df)
    a = dirichlet.fit_maximum_likelihood(np.ones(3), dims, lengths)
    assert np.allclose(a, [2, 5, 1], rtol=0.25)
    assert np.allclose(dirichlet.fit_digamma(np.ones(3), dims, lengths), a, rtol=1e-3)
    assert np.allclose(dirichlet.fit_leave_one_out(np.ones(3), dims, lengths), a, rtol=0.2)
    assert np.allclose(dirichlet.fit_histogram(np.ones(3), dims, lengths), a, rtol=0.2)
    p = df.select("row_id", "k", (F.col("n") / 200).alias("p"))
    stats = [(r.mean, r.var) for r in dirichlet.moments(p).orderBy("k").collect()]
    assert np.allclose(dirichlet.fit_moments_but_last(stats), [2, 5, 1], rtol=0.25)
    # one factor too many for the divisor: 8 to the power 3 / 2
    assert abs(dirichlet.fit_moments(stats).sum() - 8**1.5) < 0.2 * 8**1.5 and np.allclose(dirichlet.fit_moments(stats) / dirichlet.fit_moments(stats).sum(), [m for m, _ in stats])
    assert np.isnan(dirichlet.fit_moments([(0.5, 0.0), (0.5, 0.9)])).all()
    flat = [_h([1, 2, 3, 4]), _h([2, 2, 3, 3])]
    assert dirichlet.fit_symmetric(flat, _h([3, 4, 6, 7]), 2.0) > 2


def _h(xs):
    return np.bincount(xs).astype(float)


def test_dirichlet_objects_and_ratios():
    d = dirichlet.Dirichlet.of([1, 3])
    assert d.size == 2 and d.alpha(1) == 3 and dirichlet.Dirichlet.symmetric(4).magnitude == 4
    assert d.absolute_difference(dirichlet.Dirichlet.of([2, 2])) == 2 and d.squared_difference(dirichlet.Dirichlet.of([2, 2])) == 2
    assert dirichlet.likelihood_ratio([9, 1], [9, 1], 1.0, 2.0) > 0 > dirichlet.likelihood_ratio([9, 1], [1, 9], 1.0, 2.0)
    assert abs(dirichlet.Dirichlet.symmetric(2).likelihood_ratio([9, 1], [1, 9]) - dirichlet.likelihood_ratio([9, 1], [1, 9], 1.0, 2.0)) < 1e-9
    assert dirichlet.ewens_ratio([3, 0, 1], [2, 1, 0], 1.0) == pytest.approx(dirichlet.ewens_ratio([2, 1, 0], [3, 0, 1], 1.0))
    with pytest.raises(ValueError):
        dirichlet.likelihood_ratio([1], [1, 2], 1.0, 2.0)


@pytest.mark.parametrize("high,low,n", [(0.5, 0.1, 100), (0.5, 1e-5, 100), (0.1, 1e-3, 20)])
def test_power_law(spark, high, low, n):
    r = [x.rate for x in samplers.power_law(spark, high, low, n).orderBy("col_id").collect()]
    assert abs(r[0] - high) < 1e-12 and abs(r[-1] - low) < 1e-12 and abs(r[n // 2] / (high * low) ** 0.5 - 1) < 0.15


def test_samplers(spark):
    rows = spark.range(4000).select(F.col("id").alias("row_id"))
    rates = spark.createDataFrame([(0, 0.5), (1, 0.01)], "col_id bigint, rate double")
    n = {r.col_id: r["count"] for r in samplers.binomial_rows(rows.repartition(7), rates).groupBy("col_id").count().collect()}
    assert abs(n[0] - 2000) < 150 and abs(n[1] - 40) < 30
    assert n == {r.col_id: r["count"] for r in samplers.binomial_rows(rows.coalesce(1), rates).groupBy("col_id").count().collect()}
    df = spark.createDataFrame([([0.2, 1.0], 0.2), ([0.2, 1.0], 0.21), ([0.2, 0.9], 0.95), ([], 0.5)], "c array<double>, u double")
    assert [r[0] for r in df.select(samplers.multinomial("c", F.col("u"))).collect()] == [0, 1, 1, None]


def test_iteration_counts_and_starts_from_zero(spark):
    class _Mean:
        def start(self):
            return np.zeros(2)

        def add(self, batch, into, state):
            into += [batch["x"].sum(), len(batch)]

        def end(self, iteration, sums):
            return iteration >= 2

    sums, rounds = iterate.run(spark.createDataFrame([(float(i),) for i in range(10)], "x double"), _Mean(), 5)
    assert rounds == 2 and sums.tolist() == [45.0, 10.0]
    a = spark.createDataFrame([("u", [1.0, 2.0]), ("u", [3.0, 4.0])], "k string, a array<double>")
    assert {r.i: r.total for r in iterate.array_sums(a, "k", "a").collect()} == {0: 4.0, 1: 6.0}


def test_stream_batches(spark, tmp_path):
    from hashloom.streaming.minibatch import stream_batches, windowed_counts

    df = spark.createDataFrame([(i, f"2025-01-01 00:0{i % 6}:00") for i in range(30)], "id bigint, t string").withColumn("t", F.to_timestamp("t"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream_batches(spark, str(tmp_path / "in"), df.schema, lambda b, n: seen.append(b.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) == 30 and len(seen) == 3
    assert sum(r.n for r in windowed_counts(df.withColumn("k", F.col("id") % 2), "t", "1 minute", "2 minutes", "k").collect()) == 30


def test_nb_em_runs_until_it_converges(spark, monkeypatch):
    from hashloom.plans import learning

    seen = []

    def em(triplets, priors, weight=1.0, rounds=100, min_gain=1e-10, seed=0, start=None):
        seen.append((rounds, min_gain))
        return None, spark.createDataFrame([(1, 1, 0.5)], "row_id bigint, k int, post double"), []

    monkeypatch.setattr(learning.naive_bayes, "em", em)
    monkeypatch.setattr(learning, "_first_round", lambda *_: (None, None, None))
    monkeypatch.setattr(learning, "_priors", lambda *_: None)
    assert learning.nb_em(spark, "").count() == 1 and seen == [(100, 1e-10)]


def test_lda_step_gives_every_word_of_every_topic(spark, monkeypatch):
    from hashloom.plans import learning

    vectors = spark.createDataFrame([(i, [i % 15, (i * 7 + 1) % 15]) for i in range(40)], "row_id bigint, col_ids array<bigint>")
    monkeypatch.setattr(learning, "_lda", lambda *_: (lda.LdaModel.start(3, 15, 40, seed=1, tau0=1.0), vectors))
    got = learning.lda_step(spark, "").collect()
    assert {(r.topic, r.col_id) for r in got} == {(t, w) for t in range(3) for w in range(15)}
    assert all(abs(sum(r.share for r in got if r.topic == t) - 1) < 1e-4 for t in range(3))


def test_sizes_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError):
        iterate.partial_sums(spark.range(3), (iterate.CELLS + 1,), lambda pdf, own: None)
    with pytest.raises(ValueError):
        lda.LdaModel.start(1000, lda.LIMIT // 1000 + 1, 5)
    with pytest.raises(ValueError):
        dirichlet.histograms(spark.createDataFrame([(1, 0, dirichlet.BINS + 5)], "row_id bigint, k int, n bigint"))
    monkeypatch.setattr(logistic, "WEIGHTS", 2)
    v = spark.createDataFrame([(1, [1, 2, 3], [1.0, 1.0, 1.0])], "row_id bigint, col_ids array<bigint>, vals array<double>")
    with pytest.raises(ValueError):
        logistic.sgd_averaged(v, spark.createDataFrame([(1, 1.0)], "row_id bigint, y double"), logistic.SgdUpdate(), [0.1])


def test_capped_inference_is_reported(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, sorted({int(w) for w in rng.integers(0, 30, 9)})) for i in range(20)] + [(99, [])], "row_id bigint, col_ids array<bigint>")
    m = lda.LdaModel.start(3, 30, 21, seed=1, tau0=1.0)
    assert not any(r.converged for r in m.document_topics(v, cap=1).where("row_id < 99").collect())
    assert m.learn(v, cap=1).unconverged >= 20 and m.learn(v).unconverged == 0


def test_sgd_of_no_rows(spark):
    v = spark.createDataFrame([], "row_id bigint, col_ids array<bigint>, vals array<double>")
    assert logistic.sgd_averaged(v, spark.createDataFrame([], "row_id bigint, y double"), logistic.SgdUpdate(), [0.1]).count() == 0
