import random

import pytest
from pyspark.sql import functions as F

from hashloom.functions.hashing import feature_hash
from hashloom.operators import dictionary as D
from hashloom.operators import featurize as X
from hashloom.operators.matrix import SparseMatrix


def records(spark, first, last):
    def names(i):
        return [str(i), *(["wakka"] if i % 2 == 0 else []), *(["ooga booga"] if i % 5 == 0 else []), *(["foobar"] if i % 13 == 0 else [])]

    return spark.createDataFrame([(i, names(i)) for i in range(first, last + 1)], "row_id bigint, features array<string>")


@pytest.fixture(scope="module")
def f1(spark):
    r = records(spark, 1, 1000).cache()
    return X.one_pass(X.extracted(r, "row_id", "features"), r)


def test_one_pass_dims(f1):
    assert tuple(f1.dims().first()) == (1000, 1003, 1776)


def test_partition_dims(f1):
    p = f1.partition_dims(F.expr("(row_id - 1) div 50")).collect()
    assert len(p) == 20 and all(r.n_rows == 50 and r.nnz in (88, 89) for r in p)


def test_enumeration_is_a_bijection_in_hash_order(f1):
    rows = f1.dictionary.orderBy("hash").collect()
    assert [r.col_id for r in rows] == list(range(1003))


def test_column_subset(f1):
    m = f1.subset_by_feature(F.col("feature").isin("wakka", "ooga booga", "foobar"))
    assert tuple(m.dims().first()) == (1000, 3, 776)
    assert sorted(r.col_id for r in m.dictionary.collect()) == [0, 1, 2]


def test_counts(spark):
    r = spark.createDataFrame([(i, [("x", 1), *([("wakka", 2)] if i % 2 == 0 else [])]) for i in range(1, 11)], "row_id bigint, features array<struct<f string, cnt int>>")
    m = X.one_pass(X.extracted(r, "row_id", "features"), r)
    names = {d.col_id: d.names[0] for d in m.dictionary.collect()}
    got = {(t.row_id, names[t.col_id]): t.value for t in m.triplets.collect()}
    assert got == {**{(i, "x"): 1.0 for i in range(1, 11)}, **{(i, "wakka"): 2.0 for i in range(2, 11, 2)}}


def test_two_pass_round_trip(spark, tmp_path):
    r = records(spark, 0, 199)
    m = X.two_pass(X.extracted(r, "row_id", "features"), r, 1.0, 1)
    m.save(str(tmp_path / "m"))
    back = SparseMatrix.load(spark, str(tmp_path / "m"))
    names = {d.col_id: d.names[0] for d in back.dictionary.collect()}
    got = {x.row_id: {names[c] for c in x.col_ids} for x in back.packed().collect()}
    assert got == {x.row_id: {*x.features} for x in r.collect()}


@pytest.mark.parametrize("most", [0, 1, 3, 7, 8, 50, 51, 52, 1000])
def test_histogram_cutoff(spark, most):
    rng = random.Random(12)
    counts = [rng.choice([2, 3, 5, 5, 8, 13, 40]) for _ in range(52)]
    h = spark.createDataFrame([(v, counts.count(v)) for v in set(counts)], "value int, n bigint")
    # the lowest cutoff that keeps no more than wanted, among the values and the one below the smallest
    fits = [c for c in {*counts, min(counts) - 1} if sum(v > c for v in counts) <= most]
    assert X.histogram_cutoff(h, most).first()[0] == min(fits)


def test_empty_histogram(spark):
    assert X.histogram_cutoff(spark.createDataFrame([], "value int, n bigint"), 3).first()[0] is None


def test_dedupe_and_empty_rows(spark):
    f = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "row_id bigint, feature string")
    keys = spark.createDataFrame([(1,), (2,)], "row_id bigint")
    assert tuple(X.one_pass(f, keys).dims().first()) == (2, 2, 2)
    assert sorted(t.value for t in X.one_pass(f, keys, dedupe=False).triplets.collect()) == [1.0, 2.0]
    assert {r.row_id: r.col_ids for r in X.one_pass(f, keys).packed().collect()}[2] == []


def test_murmur_ids(spark):
    f = spark.createDataFrame([(1, "wakka"), (2, "foobar")], "row_id bigint, feature string")
    m = X.one_pass(f, f.select("row_id"), feature_hash)
    assert {r.names[0]: r.hash for r in m.dictionary.collect()} == {"wakka": -1652022269149602802, "foobar": -8249039087426504138}


def test_life_cycle_extractor(spark):
    class Letters(X.CountExtractor):
        def init(self):
            self.open = True

        def apply(self, record):
            assert self.open
            return [(c, 1.0) for c in record["text"] or ""]

        def close(self):
            self.open = False

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "a")], "row_id bigint, text string")
    assert sorted((r.row_id, r.feature) for r in X.extract_with(df, "row_id", Letters).collect()) == [(1, "a"), (1, "b"), (3, "a")]


def test_dictionary_operations(spark):
    a = spark.createDataFrame([("x", 3), ("y", 3), ("z", -1), (None, 7)], "feature string, hash bigint")
    b = spark.createDataFrame([("z", -1), ("w", 9)], "feature string, hash bigint")
    assert {r.hash: r.names for r in D.complete_dictionary(a).collect()} == {3: ["x", "y"], -1: ["z"]}
    assert sorted(r.feature for r in D.merge(a, b).collect()) == ["w", "x", "y", "z"]
    assert {r.feature: r.known for r in D.contains(b, spark.createDataFrame([("w",), ("q",)], "feature string")).collect()} == {"w": True, "q": False}
    assert {r.hash: r.n for r in D.collisions(a.where("feature is not null")).collect()} == {3: 2, -1: 1}
    assert sorted(r.feature for r in D.add_mapping(b, a.where("feature = 'x'")).collect()) == ["w", "x", "z"]
    d = D.complete_dictionary(a)
    assert [(r.hash, r.col_id) for r in D.subset(d, spark.createDataFrame([(3,)], "hash bigint")).collect()] == [(3, 0)]
    assert {r.hash: r.col_id for r in D.to_column(d, spark.createDataFrame([(3,), (5,)], "hash bigint")).collect()} == {3: 1, 5: None}


def test_empty_everything(spark):
    f = spark.createDataFrame([], "row_id bigint, feature string")
    m = X.one_pass(f, f.select("row_id"))
    assert tuple(m.dims().first()) == (0, 0, 0) and m.packed().count() == 0 and m.column_sums().count() == 0
    assert X.two_pass(f, f.select("row_id"), 1.0).dims().first()["nnz"] == 0


def test_enumerate_ids_however_keys_lie(spark):
    keys = [*range(3000), 9 * 10**18, -(9 * 10**18), *range(10**12, 10**12 + 50)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "id bigint")
    got = {r.id: r.pos for r in D.enumerate_ids(df, "id", "pos", ranges=16).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert D.enumerate_ids(df.limit(0), "id", "pos").count() == 0
    assert [r.pos for r in D.enumerate_ids(spark.createDataFrame([(5,)], "id bigint"), "id", "pos").collect()] == [0]


def test_unknown_names_and_shared_columns(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (1, "zz"), (2, "b"), (2, "b"), (3, None)], "row_id bigint, feature string").withColumn("extra", F.lit(1))
    dictionary = spark.createDataFrame([(5, ["a", "b"], 0)], "hash bigint, names array<string>, col_id int")
    m = X.with_dictionary(f, f.select("row_id").distinct(), dictionary, unique=True)
    assert sorted(map(tuple, m.triplets.collect())) == [(1, 0, 1.0), (2, 0, 1.0)]
