import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.functions import arrays as A
from hashloom.functions import special as S
from hashloom.functions.hashing import feature_hash, hash64, to_unit

#: Hashes that ids must equal.
GOLDEN = {
    "": 3992762020063000376, "a": -3986827505912633208, "b": 9041115770307277158, "ab": 4157034724278720815, "ba": 8300793842340226287,
    "AB": -7649582738128831073, "abcdefg": -1669074919591945955, "oogabooga": -2398617540296328547, "wakka": -1652022269149602802,
    "ooga booga": 730955169793155047, "foobar": -8249039087426504138, "1": 735574140598439701, "13": -2774051404758973991, "é": -1608330459577798339,
}


def test_golden_hashes(spark):
    assert {s: hash64(s) for s in GOLDEN} == GOLDEN
    df = spark.createDataFrame([(s,) for s in [*GOLDEN, None]], "s string")
    got = {r.s: r.h for r in df.withColumn("h", feature_hash("s")).collect()}
    assert got == {**GOLDEN, None: None}


def test_hash_halves_are_distinct():
    halves = [x for s in ["", "x", "y", "xy", "yx", "XY", "harbour", "a longer name, with signs;", "\u00fc"] for h in [hash64(s) & (2**64 - 1)] for x in (h >> 32, h & 0xFFFFFFFF)]
    assert len({*halves}) == 18 and 0xFFFFFFFF not in halves[::2]


def test_legacy_unit_keeps_more_than_the_rate(spark):
    df = spark.createDataFrame([(hash64(str(i)),) for i in range(10000)], "h bigint")
    r = df.agg(F.avg((to_unit(F.col("h"), True) < 0.1).cast("int")), F.avg((to_unit(F.col("h")) < 0.1).cast("int"))).first()
    assert abs(r[0] - 0.5542) < 1e-9 and abs(r[1] - 0.1) < 0.02


@pytest.mark.parametrize("offset", [0.0, -10.0, -5e4])
def test_log_normalize(spark, offset):
    raw = [0, -3, -3, -1, -5e6, -5e6]
    df = spark.createDataFrame([([x + offset for x in raw],)], "a array<double>")
    got = df.select(A.log_normalize("a")).first()[0]
    want = np.exp(raw) / np.exp(raw).sum()
    assert np.allclose(got, want, atol=1e-4)


def test_array_arithmetic(spark):
    df = spark.createDataFrame([([0.1, 0.2, 0.3], [0.5, 0.3, 0.1], [], None)], "a array<double>, b array<double>, e array<double>, n array<double>")
    r = df.select(
        A.axpy("a", "b").alias("one"), A.axpy("a", "b", 4.0).alias("four"), A.array_sum("e").alias("se"), A.array_sum("n").alias("sn"), A.normalize("a").alias("norm"),
        A.cumulative_sum("a").alias("cum"), A.cumulative_sum("e").alias("ce"), A.top_k("b", 2).alias("top"), A.sort_parallel("b", "a").alias("sp"), A.log_normalizer("e").alias("le"),
    ).first()
    assert np.allclose(r.one, [0.6, 0.5, 0.4]) and np.allclose(r.four, [2.1, 1.4, 0.7])
    assert r.se == 0 and r.sn is None and r.ce == [] and r.le is None
    assert np.allclose(r.norm, [1 / 6, 1 / 3, 1 / 2]) and np.allclose(r.cum, [0.1, 0.3, 0.6])
    assert [(x.idx, x.value) for x in r.top] == [(0, 0.5), (1, 0.3)]
    assert [x.key for x in r.sp] == [0.1, 0.3, 0.5] and [x.value for x in r.sp] == [0.3, 0.2, 0.1]


def test_slices_and_dots(spark):
    x = [i / 10 for i in range(1, 11)]
    df = spark.createDataFrame([([0, 5, 8], [5, 8, 9], x)], "a array<int>, b array<int>, w array<double>")
    r = df.select(A.dense_dot("a", "w"), A.sparse_dot("a", "b"), A.as_set(F.array(F.lit(3), F.lit(1), F.lit(3), F.lit(None)))).first()
    assert abs(r[0] - 1.6) < 1e-9 and r[1] == 2 and r[2] == [1, 3]


def test_array_quantiles(spark):
    df = spark.createDataFrame([([-2.0 * i for i in range(1001)],)], "a array<double>")
    assert df.select(A.array_quantiles("a", [0, 0.05, 0.1, 0.5, 0.75, 0.9, 1])).first()[0] == [-2000, -1900, -1800, -1000, -500, -200, 0]


def test_special_functions():
    z = np.array([0.1, 0.5, 1, 2.5, 10, 100])
    assert np.allclose(S.log_gamma(z), [math.lgamma(x) for x in z], atol=1e-9)
    assert np.allclose(S.log_gamma_nemes(z[2:]), [math.lgamma(x) for x in z[2:]], atol=2e-3)
    assert abs(S.log_gamma_definition(2.5) - math.lgamma(2.5)) < 1e-4
    assert np.allclose(S.log_gamma_difference(z, 7), S.log_gamma(z + 7) - S.log_gamma(z))
    assert abs(S.digamma(1.0) + 0.5772156649015329) < 1e-10
    assert np.allclose(S.digamma(z + 1), S.digamma(z) + 1 / z) and np.allclose(S.digamma_difference(z, 3), S.digamma(z + 3) - S.digamma(z))
    assert 1e-5 < abs(S.digamma(9.6, legacy=True) - S.digamma(9.6)) < 1e-3
    assert abs(S.trigamma(1.0) - math.pi**2 / 6) < 1e-9
