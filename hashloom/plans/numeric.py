"""Queries over mixed matrices, arrays, statistics and enum-typed columns."""

from __future__ import annotations

import enum

import numpy as np
from pyspark.sql import functions as F

from hashloom.functions import arrays as A
from hashloom.functions.hashing import md5_hash
from hashloom.functions.special import digamma_udf, log_gamma_udf, trigamma_udf
from hashloom.ml import samplers
from hashloom.ml.iterate import array_sums, run
from hashloom.operators import featurize as X
from hashloom.operators.compare import compare, report, top_tests
from hashloom.operators.mixed import BlockedMatrix, FeatureSet, MixedMatrix, minibatches, quantiles
from hashloom.plans.tables import table

DENSE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QS = [0.0, 0.05, 0.1, 0.5, 0.75, 0.9, 1.0]


class Event(enum.Enum):
    click = 1
    error = 2
    purchase = 3
    signup = 4
    view = 5


EVENTS = FeatureSet(Event)


def _money(c: str):
    """Cents as whole numbers, so that sums don't depend on their order."""
    return F.round(F.col(c) * 100).cast("bigint")


def _line_id():
    """An order may have a line number twice; with part and supplier it is unique."""
    return F.expr("((l_orderkey * 1000000 + l_partkey) * 100000 + l_suppkey) * 8 + l_linenumber")


def _lines(spark, d) -> MixedMatrix:
    rows = table(spark, d, "lineitem").withColumn("row_id", _line_id())
    dense = rows.select("row_id", "l_returnflag", *[_money(c).cast("double").alias(c) for c in DENSE])
    flags = F.explode(F.array(F.concat(F.lit("flag_"), "l_returnflag"), F.concat(F.lit("status_"), "l_linestatus")))
    sparse = rows.select("row_id", flags.alias("col")).where("col is not null").withColumn("value", F.lit(1.0))
    return MixedMatrix(dense, sparse, DENSE)


def mixed_colsums(spark, d):
    """Sums of the dense columns, in hundredths, and of the one-hot sparse ones."""
    return _lines(spark, d).column_sums().select("kind", "col", F.col("total").cast("bigint").alias("total"))


def dense_sumsq(spark, d):
    """Sums of squares of quantity, discount and tax, in hundredths squared."""
    m = _lines(spark, d)
    m.dense_cols = ["l_quantity", "l_discount", "l_tax"]
    return m.dense_sum_squares().select("col", F.col("total").cast("bigint").alias("total"))


def mixed_get_column(spark, d):
    """The sparse column flag_R with zeros filled in."""
    return _lines(spark, d).column("flag_R").select("row_id", F.col("value").cast("bigint").alias("value"))


def row_filter(spark, d):
    """Rows by a dense and by a sparse column."""
    m = _lines(spark, d)
    return m.row_filter(F.col("l_quantity") > 4500).join(m.row_filter_sparse("flag_A", F.col("value") > 0), "row_id", "left_semi")


def subset_of_subset(spark, d):
    """A predicate on a subset: the sums of what is left."""
    m = _lines(spark, d).subset(F.col("l_quantity") > 2500).subset(F.col("l_discount") < 5)
    return m.column_sums().select("kind", "col", F.col("total").cast("bigint").alias("total"))


def subset_positions(spark, d):
    """Positions 0, 2 and 5 of the rows with a quantity of 50: relative to the subset."""
    return _lines(spark, d).subset(F.col("l_quantity") == 5000).subset_positions([0, 2, 5]).dense.select("row_id")


def enum_slice(spark, d):
    """Users with more purchases than 1, with their counts by event type."""
    events = table(spark, d, "events").select(F.col("user_id").alias("row_id"), F.concat(F.lit("Event_"), "event_type").alias("name"), F.lit(1.0).alias("one"))
    m = MixedMatrix(EVENTS.from_long(events, "row_id", "name", "one"), events.select("row_id", F.lit("").alias("col"), F.lit(0.0).alias("value")), EVENTS.columns(), EVENTS)
    kept = m.enum_subset(Event.purchase, lambda c: c > 1)
    return kept.dense.select("row_id", *[F.col(c).cast("bigint").alias(c.lower()) for c in EVENTS.columns()])


def blocks(spark, d):
    """Four blocks of orders: rows and total price by block."""
    dense = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.pmod("o_orderkey", F.lit(4)).alias("block_id"), _money("o_totalprice").cast("double").alias("price"))
    m = BlockedMatrix(MixedMatrix(dense, dense.select("row_id", F.lit("").alias("col"), F.lit(0.0).alias("value")), ["price"]))
    return m.totals().select("block_id", "n_rows", F.col("price").cast("bigint").alias("price"))


def block_filter(spark, d):
    dense = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.pmod("o_orderkey", F.lit(4)).alias("block_id"), "o_totalprice")
    return BlockedMatrix(MixedMatrix(dense, dense, ["o_totalprice"])).row_filter(F.col("o_totalprice") > 400000)


def _slices(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag in ('R', 'A')").select(_line_id().alias("row_id"), (F.col("l_returnflag") == "R").alias("is_target"))


def welch_t(spark, d):
    """Lines returned against lines accepted: Welch's t of the dense columns."""
    m = _lines(spark, d)
    t = compare(m.long().where("kind = 'dense'"), _slices(spark, d))
    return t.select("col", F.round("score", 5).alias("score"))


def ratio_of_rates(spark, d):
    """Lines returned against lines accepted: smoothed ratios of the one-hot columns."""
    t = compare(_lines(spark, d).long().where("kind = 'sparse'"), _slices(spark, d))
    return t.select("col", F.round("score", 6).alias("score"))


def _token_tests(spark, d):
    docs = table(spark, d, "documents")
    cells = X.tokens(docs).distinct().select("row_id", F.lit("sparse").alias("kind"), F.col("feature").alias("col"), F.lit(1.0).alias("value"))
    return compare(cells, docs.select(F.col("doc_id").alias("row_id"), F.coalesce(F.col("source") == "harbour_reel", F.lit(False)).alias("is_target")))


def compare_top(spark, d):
    """The 50 tokens most typical, or untypical, of one source against all others."""
    t = _token_tests(spark, d).withColumn("score", F.round("score", 6))
    return top_tests(t).select("col", "score", F.col("rank").cast("bigint").alias("rank"))


def compare_report(spark, d):
    """The same as numbered lines."""
    return report(top_tests(_token_tests(spark, d).withColumn("score", F.round("score", 6)))).select("test", F.col("rank").cast("bigint").alias("rank"), "line")


def quantile_values(spark, d):
    return quantiles(table(spark, d, "events"), "value", QS)


def log_normalize(spark, d):
    """Softmax of the embeddings: the log normaliser, the largest share and the sum."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    p = A.log_normalize("embedding")
    return v.select("vec_id", F.round(A.log_normalizer("embedding"), 6).alias("log_norm"), F.round(F.array_max(p), 6).alias("top"), F.round(A.array_sum(p), 6).alias("total"))


def cumsum(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.cumulative_sum("embedding")).alias("i", "x"))
    return v.select("vec_id", "i", F.round("x", 5).alias("x"))


def axpy(spark, d):
    """e + 2.5 e reversed, element by element, and its sum."""
    e = A.axpy("embedding", F.reverse("embedding"), 2.5)
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(e, F.lit(0)), 5).alias("first"), F.round(A.array_sum(e), 4).alias("total"))


def array_top(spark, d):
    """The three largest elements of each embedding."""
    t = table(spark, d, "embeddings").select("vec_id", F.posexplode(A.top_k("embedding", 3)).alias("k", "x"))
    return t.select("vec_id", "k", F.col("x.idx").alias("idx"), F.round(F.col("x.value").cast("double"), 6).alias("value"))


def accumulate(spark, d):
    """Element-wise sums of the embeddings by label."""
    return array_sums(table(spark, d, "embeddings"), "label", "embedding").select("label", "i", F.round("total", 3).alias("total"))


def minibatch(spark, d):
    """Events in batches of 256 by event id: the size and the first event of each."""
    b = minibatches(table(spark, d, "events").select("event_id"), "event_id", 256)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def power_law_rates(spark, d):
    return samplers.power_law(spark, 0.5, 1e-5, 100).select("col_id", F.round("rate", 9).alias("rate"))


def binomial_draws(spark, d):
    """Rows over the orders' keys, column i present with rate_i by the md5 of key and column: how often each column came."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    unit = lambda r, c: md5_hash(F.concat_ws(",", r.cast("string"), c.cast("string"))) / F.lit(float(1 << 60))
    return samplers.binomial_rows(rows, samplers.power_law(spark, 0.5, 0.01, 10), unit=unit).groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))


def multinomial_draws(spark, d):
    """A class for each order by the md5 of its key, from cumulative probabilities 0.6, 0.8 and 1."""
    u = md5_hash(F.col("o_orderkey").cast("string")) / F.lit(float(1 << 60))
    cum = F.array(*[F.lit(x) for x in (0.6, 0.8, 1.0)])
    return table(spark, d, "orders").groupBy(samplers.multinomial(cum, u).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def special_fn(spark, d):
    """log gamma of the distinct quantities and sizes there are."""
    q = table(spark, d, "lineitem").select((F.col("l_quantity") / 4).alias("z")).distinct()
    return q.select("z", F.round(log_gamma_udf("z"), 6).alias("log_gamma"))


def special_digamma(spark, d):
    """digamma(z + 1) - digamma(z), which is 1 / z."""
    q = table(spark, d, "lineitem").select((F.col("l_quantity") / 4).alias("z")).distinct()
    return q.select("z", F.round(digamma_udf(F.col("z") + 1) - digamma_udf("z"), 6).alias("rise"))


def special_trigamma(spark, d):
    """trigamma(z) - trigamma(z + 1), which is 1 / z^2."""
    q = table(spark, d, "lineitem").select((F.col("l_quantity") / 4).alias("z")).distinct()
    return q.select("z", F.round(trigamma_udf("z") - trigamma_udf(F.col("z") + 1), 6).alias("fall"))


def array_normalize(spark, d):
    """Absolute values of the embeddings divided by their sum: the first one, and their sum."""
    p = A.normalize(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(p, F.lit(0)), 6).alias("first"), F.round(A.array_sum(p), 6).alias("total"))


def parallel_sort(spark, d):
    """The elements of each embedding in ascending order, with the places they came from: the three smallest."""
    places = F.sequence(F.lit(0), F.size("embedding") - 1)
    x = A.sort_parallel(F.transform("embedding", lambda v: F.round(v.cast("double"), 6)), places)
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice(x, 1, 3)).alias("k", "x")).select("vec_id", "k", F.col("x.value").alias("idx"), F.col("x.key").alias("value"))


def enum_updated(spark, d):
    """Users' counts by event type after errors were set to 0 where there are more than 3 views."""
    events = table(spark, d, "events").select(F.col("user_id").alias("row_id"), F.concat(F.lit("Event_"), "event_type").alias("name"), F.lit(1.0).alias("one"))
    dense = EVENTS.updated(EVENTS.from_long(events, "row_id", "name", "one"), Event.error, F.lit(0), EVENTS[Event.view] > 3)
    return dense.select("row_id", *[F.col(c).cast("bigint").alias(c.lower()) for c in EVENTS.columns()])


class _Damped:
    """Sums of the embeddings' elements, each divided by 1 and the absolute sum of the round before."""

    def start(self):
        return np.zeros(64)

    def add(self, batch, into, state):
        for e in batch["embedding"]:
            x = np.asarray(e, dtype=float)
            into[: len(x)] += x / (1 + np.abs(state[: len(x)]))

    def end(self, iteration, sums):
        return False


def iterate_run(spark, d):
    """Three rounds of an accumulating algorithm over the embeddings."""
    sums, _ = run(table(spark, d, "embeddings").select("embedding"), _Damped(), 3)
    return spark.createDataFrame([(i, round(float(x), 4)) for i, x in enumerate(sums)], "i int, x double")


QUERIES = {
    f.__name__: f
    for f in (
        mixed_colsums, dense_sumsq, mixed_get_column, row_filter, subset_of_subset, subset_positions, enum_slice, blocks, block_filter,
        welch_t, ratio_of_rates, compare_top, compare_report, quantile_values, log_normalize, cumsum, axpy, array_top, accumulate,
        minibatch, power_law_rates, binomial_draws, multinomial_draws, special_fn, special_digamma, special_trigamma, array_normalize,
        parallel_sort, enum_updated, iterate_run,
    )
}

_L = """l AS (SELECT ((l_orderkey * 1000000 + l_partkey) * 100000 + l_suppkey) * 8 + l_linenumber AS row_id, l_returnflag, l_linestatus, CAST(round(l_quantity * 100) AS BIGINT) AS l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice,
    CAST(round(l_discount * 100) AS BIGINT) AS l_discount, CAST(round(l_tax * 100) AS BIGINT) AS l_tax FROM lineitem)"""


def _sums(where: str) -> str:
    dense = " UNION ALL ".join(f"SELECT 'dense' AS kind, '{c}' AS col, CAST(coalesce(sum({c}), 0) AS BIGINT) AS total FROM l WHERE {where}" for c in DENSE)
    return f"""{dense} UNION ALL SELECT 'sparse', 'flag_' || l_returnflag, count(*) FROM l WHERE {where} GROUP BY 1, 2
        UNION ALL SELECT 'sparse', 'status_' || l_linestatus, count(*) FROM l WHERE {where} GROUP BY 1, 2"""


_RATIO = """CASE WHEN tn > 0 AND rn > 0 AND rc > 0 THEN round((tc + 5.0 * (rc / rn)) / (tn + 5.0) / (rc / rn), 6) END"""
_WELCH = " UNION ALL ".join(
    f"""SELECT '{c}' AS col, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS score FROM (SELECT avg({c}) FILTER (l_returnflag = 'R') AS m1, avg({c}) FILTER (l_returnflag = 'A') AS m2,
    var_pop({c}) FILTER (l_returnflag = 'R') AS v1, var_pop({c}) FILTER (l_returnflag = 'A') AS v2, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag = 'A') AS n2 FROM l)"""
    for c in DENSE
)
_TOKENS = rf"""t AS (SELECT DISTINCT doc_id, coalesce(source = 'harbour_reel', false) AS tgt, f FROM (SELECT doc_id, source, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS f FROM documents) WHERE f <> ''),
    n AS (SELECT CAST(count(*) FILTER (coalesce(source = 'harbour_reel', false)) AS DOUBLE) AS tn, CAST(count(*) FILTER (NOT coalesce(source = 'harbour_reel', false)) AS DOUBLE) AS rn FROM documents),
    s AS (SELECT f AS col, {_RATIO} AS score FROM (SELECT f, CAST(count(*) FILTER (tgt) AS DOUBLE) AS tc, CAST(count(*) FILTER (NOT tgt) AS DOUBLE) AS rc FROM t GROUP BY f), n),
    k AS (SELECT col, score, row_number() OVER (ORDER BY abs(score) DESC, col) AS rank FROM s WHERE score IS NOT NULL)"""
_E = "e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"

ORACLE = {
    "mixed_colsums": f"WITH {_L} {_sums('true')}",
    "dense_sumsq": f"WITH {_L} " + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST(sum({c} * {c}) AS BIGINT) AS total FROM l" for c in ("l_quantity", "l_discount", "l_tax")),
    "mixed_get_column": f"WITH {_L} SELECT row_id, CAST(coalesce(l_returnflag = 'R', false) AS BIGINT) AS value FROM l",
    "row_filter": f"WITH {_L} SELECT row_id FROM l WHERE l_quantity > 4500 AND l_returnflag = 'A'",
    "subset_of_subset": f"WITH {_L} {_sums('l_quantity > 2500 AND l_discount < 5')}",
    "subset_positions": f"WITH {_L} SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS p FROM l WHERE l_quantity = 5000) WHERE p IN (0, 2, 5)",
    "enum_slice": "SELECT user_id AS row_id, " + ", ".join(f"count(*) FILTER (event_type = '{e.name}') AS event_{e.name}" for e in Event) + " FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 1",
    "blocks": "SELECT o_orderkey % 4 AS block_id, count(*) AS n_rows, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS price FROM orders GROUP BY 1",
    "block_filter": "SELECT o_orderkey % 4 AS block_id, o_orderkey AS row_id FROM orders WHERE o_totalprice > 400000",
    "welch_t": f"WITH {_L} {_WELCH}",
    "ratio_of_rates": f"""WITH {_L}, x AS (SELECT l_returnflag, 'flag_' || l_returnflag AS col FROM l WHERE l_returnflag IN ('R', 'A') UNION ALL SELECT l_returnflag, 'status_' || l_linestatus FROM l WHERE l_returnflag IN ('R', 'A')),
        n AS (SELECT CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS tn, CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS rn FROM l)
        SELECT col, {_RATIO} AS score FROM (SELECT col, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS tc, CAST(count(*) FILTER (l_returnflag = 'A') AS DOUBLE) AS rc FROM x GROUP BY col), n""",
    "compare_top": f"WITH {_TOKENS} SELECT col, score, rank FROM k WHERE rank <= 50",
    "compare_report": f"WITH {_TOKENS} SELECT 'ratio' AS test, rank, printf('%d. %s: %.6f', rank, col, score) AS line FROM k WHERE rank <= 50",
    "quantile_values": "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), q(q) AS (VALUES " + ", ".join(f"({q}::DOUBLE)" for q in QS) + ") SELECT q, value FROM q JOIN v ON i = CAST(floor(least(q * n, n - 1)) AS BIGINT)",
    "log_normalize": f"""WITH {_E}, m AS (SELECT vec_id, max(x) AS m FROM e GROUP BY 1), z AS (SELECT vec_id, m + ln(sum(exp(x - m))) AS z, m FROM e JOIN m USING (vec_id) GROUP BY vec_id, m)
        SELECT vec_id, round(z, 6) AS log_norm, round(exp(m - z), 6) AS top, 1.0::DOUBLE AS total FROM z""",
    "cumsum": f"WITH {_E} SELECT vec_id, CAST(i AS INTEGER) AS i, round(sum(x) OVER (PARTITION BY vec_id ORDER BY i), 5) AS x FROM e",
    "axpy": "SELECT vec_id, round(embedding[1]::DOUBLE + 2.5 * embedding[len(embedding)]::DOUBLE, 5) AS first, round(3.5 * list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total FROM embeddings",
    "array_top": f"WITH {_E} SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS idx, round(x, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) - 1 AS k FROM e) WHERE k < 3",
    "accumulate": f"WITH {_E} SELECT label, CAST(i AS INTEGER) AS i, round(sum(x), 3) AS total FROM e GROUP BY 1, 2",
    "minibatch": "SELECT (k // 256) AS batch, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1",
    "power_law_rates": "SELECT i AS col_id, round(0.5::DOUBLE * pow(0.00001::DOUBLE / 0.5::DOUBLE, i / 99.0::DOUBLE), 9) AS rate FROM range(100) t(i)",
    "multinomial_draws": """SELECT CAST(CASE WHEN u <= 0.6 THEN 0 WHEN u <= 0.8 THEN 1 ELSE 2 END AS INTEGER) AS k, count(*) AS n
        FROM (SELECT ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15))::BIGINT / 1152921504606846976.0 AS u FROM orders) GROUP BY 1""",
    "binomial_draws": """SELECT CAST(c AS BIGINT) AS col_id, count(*) AS n FROM orders, range(10) t(c)
        WHERE ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || ',' || CAST(c AS VARCHAR)), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE < 0.5::DOUBLE * pow(0.01::DOUBLE / 0.5::DOUBLE, c / 9.0::DOUBLE) GROUP BY 1""",
    "special_trigamma": "SELECT DISTINCT l_quantity / 4 AS z, round(16 / (l_quantity * l_quantity), 6) AS fall FROM lineitem",
    "array_normalize": f"WITH {_E}, s AS (SELECT vec_id, sum(abs(x)) AS s FROM e GROUP BY 1) SELECT vec_id, round(abs(x) / s, 6) AS first, 1.0::DOUBLE AS total FROM e JOIN s USING (vec_id) WHERE i = 0",
    "parallel_sort": f"WITH {_E} SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS idx, x AS value FROM (SELECT vec_id, i, round(x, 6) AS x, row_number() OVER (PARTITION BY vec_id ORDER BY round(x, 6), i) - 1 AS k FROM e) WHERE k < 3",
    "enum_updated": "SELECT user_id AS row_id, " + ", ".join(f"count(*) FILTER (event_type = '{e.name}')" + (" * CASE WHEN count(*) FILTER (event_type = 'view') > 3 THEN 0 ELSE 1 END" if e is Event.error else "") + f" AS event_{e.name}" for e in Event) + " FROM events GROUP BY 1",
    "iterate_run": f"""WITH {_E}, i64 AS (SELECT range AS i FROM range(64)), a AS (SELECT i, sum(x) AS s FROM e GROUP BY 1)
        SELECT CAST(i64.i AS INTEGER) AS i, round(coalesce(s / (1 + abs(s / (1 + abs(s)))), 0), 4) AS x FROM i64 LEFT JOIN a ON a.i = i64.i""",
    "special_fn": "SELECT DISTINCT l_quantity / 4 AS z, round(lgamma(l_quantity / 4), 6) AS log_gamma FROM lineitem",
    "special_digamma": "SELECT DISTINCT l_quantity / 4 AS z, round(4 / l_quantity, 6) AS rise FROM lineitem",
}
