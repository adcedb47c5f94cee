"""Queries of the learning operators, over documents: a page is a positive example if its source is harbour_reel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hashloom.functions.hashing import md5_hash
from hashloom.ml import dirichlet, lda, logistic, naive_bayes
from hashloom.operators import featurize as X
from hashloom.operators.matrix import SparseMatrix
from hashloom.plans.features import _SEL, _top
from hashloom.plans.tables import table
from hashloom.session import checkpointed

#: Rounds of EM and of the Dirichlet fits in the SQL, and of inference in the LDA queries that have SQL.
EM_ROUNDS, FIT_ROUNDS, LDA_ROUNDS = 12, 50, 3
#: Prior of the class a page's label names.
SOFT = 0.7


def _matrix(spark, d) -> SparseMatrix:
    return _top(spark, d)


def _positive():
    return F.coalesce(F.col("source") == "harbour_reel", F.lit(False))


def _priors(spark, d):
    p = F.when(_positive(), SOFT).otherwise(1 - SOFT)
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), (1 - p).alias("prior")), F.struct(F.lit(1).alias("k"), p.alias("prior"))))
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), both.alias("x")).select("row_id", "x.k", "x.prior")


def _labels(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.when(_positive(), 1.0).otherwise(-1.0).alias("y"))


def _first_round(spark, d):
    """Emissions with the priors as posteriors."""
    m = _matrix(spark, d)
    cells = checkpointed(m.triplets)
    num, den = naive_bayes.emissions(cells, _priors(spark, d).withColumnRenamed("prior", "post"))
    return cells, num, den


def nb_m_step_ml(spark, d):
    _, num, den = _first_round(spark, d)
    return naive_bayes.m_step_ml(num, den).select("col_id", "k", F.round("log_theta", 6).alias("log_theta"))


def nb_m_step_map(spark, d):
    cells, num, den = _first_round(spark, d)
    return naive_bayes.m_step_map(num, den, naive_bayes.feature_rates(cells), 2.0).select("col_id", "k", F.round("log_theta", 6).alias("log_theta"))


def nb_posterior(spark, d):
    """Posteriors of the second class after one MAP step."""
    cells, num, den = _first_round(spark, d)
    theta = naive_bayes.m_step_map(num, den, naive_bayes.feature_rates(cells), 2.0)
    log_priors = _priors(spark, d).select("row_id", "k", F.log("prior").alias("log_prior"))
    return naive_bayes.posteriors(cells, theta, log_priors).where("k = 1").select("row_id", F.round("post", 5).alias("post"))


def nb_top(spark, d):
    """The ten features most typical of each class after one MAP step."""
    cells, num, den = _first_round(spark, d)
    rates = naive_bayes.feature_rates(cells)
    top = naive_bayes.top_features(naive_bayes.m_step_map(num, den, rates, 2.0), rates, 10)
    return top.select("k", "col_id", F.round("lift", 5).alias("lift"), F.col("rank").cast("bigint").alias("rank"))


def nb_em(spark, d):
    """Posteriors of the second class when the log likelihood gains less than 1e-10, or after 100 rounds, from the priors as first posteriors.

    Its SQL has EM_ROUNDS rounds written out, by which EM stands still on the test data.
    """
    cells, num, den = _first_round(spark, d)
    _, post, _ = naive_bayes.em(cells, _priors(spark, d), 2.0, start=(num, den))
    return post.where("k = 1").select("row_id", F.round("post", 3).alias("post"))


def _start(m: SparseMatrix):
    return m.dictionary.select("col_id", (F.lit(0.01) * (F.pmod("col_id", F.lit(7)) - 3)).alias("w"))


def _lr(spark, d, penalty, regularise):
    m = _matrix(spark, d)
    cells = checkpointed(m.triplets)
    out = logistic.step(cells, _labels(spark, d), checkpointed(_start(m)), 0.01, penalty, regularise)
    return out.select("col_id", F.round("w", 6).alias("w"))


def lr_gradient(spark, d):
    return _lr(spark, d, 0.0, logistic.none)


def lr_ridge(spark, d):
    return _lr(spark, d, 15.0, logistic.ridge)


def lr_lasso(spark, d):
    return _lr(spark, d, 15.0, logistic.lasso)


def lr_sgd(spark, d):
    """Weights after two epochs of ridge SGD on every shard, averaged."""
    packed = checkpointed(_matrix(spark, d).packed())
    out = logistic.sgd_averaged(packed, _labels(spark, d), logistic.SgdUpdate("ridge", 0.1), [0.1, 0.05])
    return out.select("col_id", F.round("w", 6).alias("w"))


def lr_sgd_sequence(spark, d):
    """Weights after one epoch over the documents in their order, as one shard, and the lasso at its end."""
    packed = _matrix(spark, d).packed()
    out = logistic.sgd_averaged(packed, _labels(spark, d), logistic.SgdUpdate("lasso", 0.01), [0.1], shards=1)
    return out.select("col_id", F.round("w", 5).alias("w"))


def _lda_even(spark, d):
    """A start that any system can repeat: lambda (1 + (31 t + 17 w) mod 11) / 66 of three topics."""
    m = _matrix(spark, d)
    vectors, words = checkpointed(m.packed(values=False)), m.dictionary.count()
    t, w = np.arange(3)[:, None], np.arange(words)[None, :]
    return lda.LdaModel.start(3, words, vectors.count(), lam=(1 + (31 * t + 17 * w) % 11) / 66, tau0=3.0, alpha=0.1, eta=0.01), vectors


def lda_even_step(spark, d):
    """Every word's share of every topic after one update with all documents, whose inference takes LDA_ROUNDS rounds."""
    model, vectors = _lda_even(spark, d)
    model.learn(vectors, cap=LDA_ROUNDS)
    share = model.lam / model.lam.sum(1, keepdims=True)
    return spark.createDataFrame([(t, w, round(float(x), 6)) for t, row in enumerate(share) for w, x in enumerate(row)], "topic int, col_id bigint, share double")


def lda_even_bound(spark, d):
    """The bound at the start, with LDA_ROUNDS rounds of inference, and the model's part of it."""
    model, vectors = _lda_even(spark, d)
    return spark.createDataFrame([(round(model.bound(vectors, LDA_ROUNDS), 2), round(model.model_bound(), 2))], "bound double, model double")


def lda_even_topics(spark, d):
    """The topic parameters of every document by the start, after LDA_ROUNDS rounds."""
    model, vectors = _lda_even(spark, d)
    g = model.document_topics(vectors, cap=LDA_ROUNDS)
    return g.select("row_id", F.posexplode("gamma").alias("topic", "gamma")).select("row_id", "topic", F.round("gamma", 4).alias("gamma"))


def _lda(spark, d, topics: int = 5):
    m = _matrix(spark, d)
    vectors = checkpointed(m.packed(values=False))
    words = m.dictionary.count()
    return lda.LdaModel.start(topics, words, vectors.count(), seed=1, tau0=1.0), vectors


def lda_step(spark, d):
    """Every word's share of every topic after one update with all documents as one batch."""
    model, vectors = _lda(spark, d)
    model.learn(vectors)
    rows = [(t, w, round(s, 6)) for t, words in enumerate(model.top_words(model.lam.shape[1])) for w, s in words]
    return spark.createDataFrame(rows, "topic int, col_id bigint, share double")


def lda_infer(spark, d):
    """The likeliest topic of every document after one update."""
    model, vectors = _lda(spark, d)
    g = model.learn(vectors).document_topics(vectors)
    return g.select("row_id", (F.array_position("gamma", F.array_max("gamma")) - 1).alias("topic"))


def lda_elbo(spark, d):
    """The bound before and after one update."""
    model, vectors = _lda(spark, d)
    before = model.bound(vectors)
    return spark.createDataFrame([("before", before), ("after", model.learn(vectors).bound(vectors))], "at string, bound double")


def _length_counts(spark, d):
    """Tokens of each document by length: up to 3, 4 to 7, 8 and more letters."""
    n = F.length("feature")
    k = F.when(n <= 3, 0).when(n <= 7, 1).otherwise(2)
    return X.tokens(table(spark, d, "documents")).groupBy("row_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


def dirichlet_moments(spark, d):
    return dirichlet_shares(spark, d).select("k", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


def dirichlet_shares(spark, d):
    """Mean and variance of the shares of each length of token over the pages."""
    c = _length_counts(spark, d)
    n = c.groupBy("row_id").agg(F.sum("n").alias("all"))
    grid = n.select("row_id", "all", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    p = grid.join(c, ["row_id", "k"], "left").select("row_id", "k", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("p"))
    return dirichlet.moments(p)


def _fits(spark, d, rounds: int | None):
    """Parameters by each way of fitting, each until it stands still, or a given number of rounds."""
    dims, lengths = dirichlet.histograms(_length_counts(spark, d))
    start, how = np.ones(len(dims)), {"rounds": rounds} if rounds else {}
    still = {**how, "tolerance": 0.0} if rounds else {}
    ways = {
        "digamma": dirichlet.fit_digamma(start, dims, lengths, **still), "histogram": dirichlet.fit_maximum_likelihood(start, dims, lengths, **still),
        "leave_one_out": dirichlet.fit_leave_one_out(start, dims, lengths, **still), "prior": dirichlet.fit_histogram(start, dims, lengths, **how),
        "symmetric": [dirichlet.fit_symmetric(dims, lengths, float(len(dims)), **how)],
    }
    return spark.createDataFrame([(name, k, round(float(a), 4)) for name, fit in ways.items() for k, a in enumerate(fit)], "way string, k int, alpha double")


def dirichlet_fit(spark, d):
    return _fits(spark, d, None)


def dirichlet_rounds(spark, d):
    """Parameters after FIT_ROUNDS rounds of each way."""
    return _fits(spark, d, FIT_ROUNDS)


def dirichlet_moment_fit(spark, d):
    """Parameters by the moments of the shares of each length."""
    rows = dirichlet_shares(spark, d).orderBy("k").collect()  # one row per dimension
    return spark.createDataFrame([(k, round(float(a), 5)) for k, a in enumerate(dirichlet.fit_moments([(r["mean"], r["var"]) for r in rows]))], "k int, alpha double")


def dirichlet_ratio(spark, d):
    """For each source, the log odds that its token lengths come from the same multinomial as those of all pages, with a prior of 1 on each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("source", F.lit("none")).alias("source"))
    n = _length_counts(spark, d).join(docs, "row_id").groupBy("source", "k").agg(F.sum("n").alias("n")).collect()  # three rows per source
    of, all_of = {}, np.zeros(3)
    for r in n:
        of.setdefault(r["source"], np.zeros(3))[r["k"]] += r["n"]
        all_of[r["k"]] += r["n"]
    return spark.createDataFrame([(s, round(dirichlet.likelihood_ratio(x, all_of, 1.0, 3.0), 3)) for s, x in sorted(of.items())], "source string, log_odds double")


QUERIES = {
    f.__name__: f
    for f in (
        nb_m_step_ml, nb_m_step_map, nb_posterior, nb_top, nb_em, lr_gradient, lr_ridge, lr_lasso, lr_sgd, lr_sgd_sequence, lda_step, lda_infer,
        lda_elbo, lda_even_step, lda_even_topics, lda_even_bound, dirichlet_moments, dirichlet_fit, dirichlet_rounds, dirichlet_moment_fit, dirichlet_ratio,
    )
}

_NB = _SEL + """,
b AS (SELECT DISTINCT row_id, col_id FROM sc),
pr AS (SELECT doc_id AS row_id, k, CASE WHEN coalesce(source = 'harbour_reel', false) = (k = 1) THEN 0.7::DOUBLE ELSE 1 - 0.7::DOUBLE END AS p FROM documents, (VALUES (0), (1)) t(k)),
num AS (SELECT col_id, k, sum(p) AS num FROM b JOIN pr USING (row_id) GROUP BY 1, 2),
den AS (SELECT k, sum(num) AS den FROM num GROUP BY 1),
rate AS (SELECT col_id, count(*)::DOUBLE / (SELECT count(*) FROM b) AS rate FROM b GROUP BY 1),
th AS (SELECT col_id, k, ln((num + 2.0) / (den + 2.0 / rate)) AS lt, exp(ln((num + 2.0) / (den + 2.0 / rate))) / rate AS lift FROM num JOIN den USING (k) JOIN rate USING (col_id))"""
_LR = _SEL + """,
b AS (SELECT DISTINCT row_id, col_id FROM sc),
w AS (SELECT col_id, 0.01::DOUBLE * (col_id % 7 - 3) AS w FROM se),
z AS (SELECT row_id, sum(w) AS z FROM b JOIN w USING (col_id) GROUP BY 1),
p AS (SELECT row_id, y / (1 + exp(y * z)) * 0.01 AS p FROM z JOIN (SELECT doc_id AS row_id, CASE WHEN coalesce(source = 'harbour_reel', false) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y FROM documents) USING (row_id)),
g AS (SELECT col_id, w + coalesce((SELECT 0), 0) + coalesce(s, 0) AS v FROM w LEFT JOIN (SELECT col_id, sum(p) AS s FROM b JOIN p USING (row_id) GROUP BY 1) USING (col_id))"""


def _em_sql() -> str:
    out, theta = [_NB], "th"
    for r in range(1, EM_ROUNDS + 1):
        out.append(f"""s{r} AS (SELECT pr.row_id, pr.k, ln(p) + coalesce(x, 0) AS s FROM pr LEFT JOIN (SELECT row_id, k, sum(lt) AS x FROM b JOIN {theta} USING (col_id) GROUP BY 1, 2) y ON pr.row_id = y.row_id AND pr.k = y.k),
p{r} AS MATERIALIZED (SELECT a.row_id, a.k, 1 / (1 + exp(o.s - a.s)) AS post FROM s{r} a JOIN s{r} o ON a.row_id = o.row_id AND a.k <> o.k),
n{r} AS MATERIALIZED (SELECT col_id, k, sum(post) AS num FROM b JOIN p{r} USING (row_id) GROUP BY 1, 2),
t{r} AS MATERIALIZED (SELECT col_id, k, ln((num + 2.0) / (den + 2.0 / rate)) AS lt FROM n{r} JOIN (SELECT k, sum(num) AS den FROM n{r} GROUP BY 1) USING (k) JOIN rate USING (col_id))""")
        theta = f"t{r}"
    return f"WITH {', '.join(out)} SELECT row_id, round(post, 3) AS post FROM p{EM_ROUNDS} WHERE k = 1"


def _psi(x: str) -> str:
    """digamma: ten steps of its recurrence, and four terms of its series at 10 or more."""
    y = f"({x} + 10)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) - ({' + '.join(f'1 / ({x} + {i})' for i in range(10))}))"


def _lda_sql() -> str:
    """Rounds of inference from gamma 1: gamma{r} (row_id, t, g) and phi{r} (row_id, col_id, t, p)."""
    out = [_SEL, f"""b AS MATERIALIZED (SELECT DISTINCT row_id, col_id FROM sc),
lam AS (SELECT CAST(t AS INTEGER) AS t, col_id, (1 + (31 * t + 17 * col_id) % 11) / 66.0::DOUBLE AS l FROM se, range(3) r(t)),
lb AS MATERIALIZED (SELECT t, col_id, {_psi('l')} - {_psi('tot')} AS lb FROM lam JOIN (SELECT t, sum(l) AS tot FROM lam GROUP BY 1) USING (t)),
gamma0 AS MATERIALIZED (SELECT doc_id AS row_id, CAST(t AS INTEGER) AS t, 1.0::DOUBLE AS g FROM documents, range(3) r(t))"""]
    for r in range(1, LDA_ROUNDS + 1):
        out.append(f"""lt{r} AS MATERIALIZED (SELECT row_id, t, {_psi('g')} - {_psi('tot')} AS lt FROM gamma{r - 1} JOIN (SELECT row_id, sum(g) AS tot FROM gamma{r - 1} GROUP BY 1) USING (row_id)),
raw{r} AS MATERIALIZED (SELECT row_id, col_id, t, exp(lb + lt) AS e FROM b JOIN lt{r} USING (row_id) JOIN lb USING (col_id, t)),
phi{r} AS MATERIALIZED (SELECT row_id, col_id, t, e / tot AS p FROM raw{r} JOIN (SELECT row_id, col_id, sum(e) AS tot FROM raw{r} GROUP BY 1, 2) USING (row_id, col_id)),
gamma{r} AS MATERIALIZED (SELECT row_id, t, 0.1 + coalesce(s, 0) AS g FROM gamma0 LEFT JOIN (SELECT row_id, t, sum(p) AS s FROM phi{r} GROUP BY 1, 2) USING (row_id, t))""")
    return "WITH " + ", ".join(out)


_LENGTHS = r"""t AS (SELECT doc_id, CASE WHEN n <= 3 THEN 0 WHEN n <= 7 THEN 1 ELSE 2 END AS k FROM (SELECT doc_id, length(f) AS n FROM
        (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS f FROM documents) WHERE f <> '')),
    c AS (SELECT doc_id, k, count(*) AS n FROM t GROUP BY 1, 2)"""


def _fit_sql(rounds: int, plain: int) -> str:
    """``rounds`` of the ways that stop when they stand still, ``plain`` of those with a number of rounds."""
    many = {"ml": rounds, "loo": rounds, "pri": plain}
    rise = lambda x, w: f"(SELECT sum(m / ({x} + i)) FROM {w})"
    loo = lambda x, w: f"(SELECT sum(m * n / (n - 1 + {x})) FROM {w})"
    total, ks = "(a0 + a1 + a2)", range(3)
    ways = {
        "ml": [f"a{k} * {rise(f'a{k}', f'r{k}')} / {rise(total, 'rl')}" for k in ks],
        "loo": [f"a{k} * {loo(f'a{k}', f'h{k}')} / {loo(total, 'hl')}" for k in ks],
        "pri": [f"a{k} * ({rise(f'a{k}', f'r{k}')} + 1.00001) / ({rise(total, 'rl')} - 1)" for k in ks],
    }
    hist = [f"h{k} AS MATERIALIZED (SELECT n, count(*) AS m FROM c WHERE k = {k} GROUP BY 1)" for k in ks]
    hist += ["hl AS MATERIALIZED (SELECT n, count(*) AS m FROM (SELECT sum(n) AS n FROM c GROUP BY doc_id) GROUP BY 1)", "hp AS MATERIALIZED (SELECT n, sum(m) AS m FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1)"]
    # m of i: how many observations are above i
    rises = [f"r{x} AS MATERIALIZED (SELECT i, sum(m)::DOUBLE AS m FROM h{x}, LATERAL (SELECT unnest(range(CAST(n AS BIGINT))) AS i) GROUP BY 1)" for x in (*ks, "l", "p")]
    steps = [f"{w} AS (SELECT 0 AS it, 1.0::DOUBLE AS a0, 1.0::DOUBLE AS a1, 1.0::DOUBLE AS a2 UNION ALL SELECT it + 1, {', '.join(e)} FROM {w} WHERE it < {many[w]})" for w, e in ways.items()]
    steps.append(f"sym AS (SELECT 0 AS it, 3.0::DOUBLE AS a UNION ALL SELECT it + 1, a * {rise('a / 3', 'rp')} / (3 * {rise('a', 'rl')}) FROM sym WHERE it < {plain})")
    names = {"digamma": "ml", "histogram": "ml", "leave_one_out": "loo", "prior": "pri"}
    rows = [f"SELECT '{n}' AS way, {k} AS k, round(a{k}, 4) AS alpha FROM {w} WHERE it = {many[w]}" for n, w in names.items() for k in ks]
    return f"WITH RECURSIVE {_LENGTHS}, {', '.join([*hist, *rises, *steps])} {' UNION ALL '.join(rows)} UNION ALL SELECT 'symmetric', 0, round(a, 4) FROM sym WHERE it = {plain}"


_SGD = f"""WITH RECURSIVE {_SEL},
y AS (SELECT doc_id, CASE WHEN coalesce(source = 'harbour_reel', false) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y, row_number() OVER (ORDER BY doc_id) AS n FROM documents),
c AS (SELECT row_id, list(DISTINCT col_id) AS cols FROM sc GROUP BY 1),
rows AS MATERIALIZED (SELECT n, y, coalesce(cols, []) AS cols FROM y LEFT JOIN c ON row_id = doc_id),
size AS (SELECT count(*) AS m FROM se),
s AS (SELECT CAST(0 AS BIGINT) AS n, list_transform(range((SELECT m FROM size)), lambda i: 0.0::DOUBLE) AS w
      UNION ALL SELECT r.n, list_transform(w, lambda x, i: x + CASE WHEN list_contains(r.cols, i - 1) THEN r.y * 0.1 / (1 + exp(r.y * coalesce(list_sum(list_transform(r.cols, lambda k: w[k + 1])), 0))) ELSE 0 END) FROM s JOIN rows r ON r.n = s.n + 1)
SELECT CAST(i AS BIGINT) AS col_id, round(CASE WHEN abs(x) <= 0.001 THEN 0 ELSE x - sign(x) * 0.001 END, 5) AS w
FROM (SELECT unnest(w) AS x, unnest(range((SELECT m FROM size))) AS i FROM s WHERE n = (SELECT max(n) FROM s))"""

ORACLE = {
    "nb_em": _em_sql(),
    "lr_sgd_sequence": _SGD,
    "lda_even_step": f"""{_lda_sql()}, st AS (SELECT t, col_id, sum(p) AS s FROM phi{LDA_ROUNDS} GROUP BY 1, 2), rho AS (SELECT pow(3.0::DOUBLE, -0.5) AS r),
        nl AS (SELECT t, col_id, (1 - r) * l + r * (0.01 + coalesce(s, 0)) AS l FROM lam LEFT JOIN st USING (t, col_id), rho)
        SELECT t AS topic, col_id, round(l / sum(l) OVER (PARTITION BY t), 6) AS share FROM nl""",
    "lda_even_topics": f"{_lda_sql()} SELECT row_id, t AS topic, round(g, 4) AS gamma FROM gamma{LDA_ROUNDS}",
    "dirichlet_fit": _fit_sql(1000, 200),
    "lda_even_bound": f"""{_lda_sql()}, k AS (SELECT 0.1::DOUBLE AS a, 0.01::DOUBLE AS e, (SELECT count(*) FROM se) AS w),
        gt AS (SELECT row_id, t, g, {_psi('g')} - {_psi('tot')} AS lt, tot FROM gamma{LDA_ROUNDS} JOIN (SELECT row_id, sum(g) AS tot FROM gamma{LDA_ROUNDS} GROUP BY 1) USING (row_id)),
        words AS (SELECT sum(ln(x)) AS s FROM (SELECT sum(exp(lb + lt)) AS x FROM b JOIN gt USING (row_id) JOIN lb USING (col_id, t) GROUP BY row_id, col_id)),
        docs AS (SELECT sum((a - g) * lt + lgamma(g) - lgamma(a)) AS s FROM gt, k), ends AS (SELECT sum(lgamma(a * 3) - lgamma(tot)) AS s FROM (SELECT DISTINCT row_id, tot FROM gt), k),
        model AS (SELECT (SELECT sum((e - l) * lb + lgamma(l) - lgamma(e)) FROM lam JOIN lb USING (t, col_id), k) + (SELECT 3 * lgamma(e * w) FROM k) - (SELECT sum(lgamma(x)) FROM (SELECT sum(l) AS x FROM lam GROUP BY t)) AS m)
        SELECT round(words.s + docs.s + ends.s + m, 2) AS bound, round(m, 2) AS model FROM words, docs, ends, model""",
    "dirichlet_rounds": _fit_sql(FIT_ROUNDS, FIT_ROUNDS),
    "dirichlet_moment_fit": f"""WITH {_LENGTHS}, p AS (SELECT doc_id, v.k AS k, coalesce(n, 0)::DOUBLE / sum(coalesce(n, 0)) OVER (PARTITION BY doc_id) AS p
            FROM (SELECT DISTINCT doc_id FROM t) CROSS JOIN (VALUES (0), (1), (2)) v(k) LEFT JOIN c USING (doc_id, k)),
        m AS (SELECT k, avg(p) AS m, var_samp(p) AS v FROM p GROUP BY 1), g AS (SELECT exp(sum(ln(m * (1 - m) / v - 1)) / 2) AS g FROM m WHERE m > 0)
        SELECT k, round(m * g, 5) AS alpha FROM m, g""",
    "dirichlet_ratio": f"""WITH {_LENGTHS}, x AS (SELECT coalesce(source, 'none') AS source, k, sum(n) AS n FROM c JOIN documents USING (doc_id) GROUP BY 1, 2), y AS (SELECT k, sum(n) AS n FROM c GROUP BY 1),
        q AS (SELECT s.source, y.k, coalesce(x.n, 0)::DOUBLE AS x, y.n::DOUBLE AS y FROM (SELECT DISTINCT source FROM x) s CROSS JOIN y LEFT JOIN x ON x.source = s.source AND x.k = y.k)
        SELECT source, round(sum(lgamma(1 + x + y) - lgamma(1 + x) - lgamma(1 + y)) + lgamma(3 + sum(x)) + lgamma(3 + sum(y)) - lgamma(3::DOUBLE) - lgamma(3 + sum(x) + sum(y)), 3) AS log_odds FROM q GROUP BY 1""",
    "nb_m_step_ml": f"WITH {_NB} SELECT col_id, k, round(ln(num / den), 6) AS log_theta FROM num JOIN den USING (k)",
    "nb_m_step_map": f"WITH {_NB} SELECT col_id, k, round(lt, 6) AS log_theta FROM th",
    "nb_posterior": f"""WITH {_NB}, s AS (SELECT pr.row_id, pr.k, ln(p) + coalesce(x, 0) AS s FROM pr LEFT JOIN (SELECT row_id, k, sum(lt) AS x FROM b JOIN th USING (col_id) GROUP BY 1, 2) y ON pr.row_id = y.row_id AND pr.k = y.k)
        SELECT a.row_id, round(1 / (1 + exp(o.s - a.s)), 5) AS post FROM s a JOIN s o ON a.row_id = o.row_id AND a.k = 1 AND o.k = 0""",
    "nb_top": f"WITH {_NB} SELECT k, col_id, round(lift, 5) AS lift, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(lift, 9) DESC, col_id) AS r FROM th) WHERE r <= 10",
    "lr_gradient": f"WITH {_LR} SELECT col_id, round(v, 6) AS w FROM g",
    "lr_ridge": f"WITH {_LR} SELECT col_id, round(v - v * 0.15, 6) AS w FROM g",
    "lr_lasso": f"WITH {_LR} SELECT col_id, round(CASE WHEN abs(v) <= 0.15 THEN 0 ELSE v - sign(v) * 0.15 END, 6) AS w FROM g",
    "dirichlet_moments": rf"""WITH t AS (SELECT doc_id, length(f) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS f FROM documents) WHERE f <> ''),
        p AS (SELECT doc_id, k, count(*) FILTER ((CASE WHEN n <= 3 THEN 0 WHEN n <= 7 THEN 1 ELSE 2 END) = k)::DOUBLE / count(*) AS p FROM t, (VALUES (0), (1), (2)) v(k) GROUP BY 1, 2)
        SELECT k, round(avg(p), 6) AS mean, round(var_samp(p), 6) AS var FROM p GROUP BY k""",
}
