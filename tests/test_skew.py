import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hashloom.operators.skew import TASK, balanced_aggregate, balanced_apply, balanced_join, pack, placed, plan_shards, route, sized_join


@pytest.fixture(scope="module")
def skewed(spark):
    data = [(i, 7 if i % 3 else i % 50, i % 11) for i in range(6000)] + [(6000 + i, None, 1) for i in range(5)]
    return spark.createDataFrame(data, "id bigint, k bigint, v bigint").cache()


def test_heavy_key_is_split_and_loads_even_out(skewed):
    plan = plan_shards(skewed, "k", tasks=8)
    assert plan.heavy[0][0] == 7 and len(plan.heavy[0][2]) > 4
    per = Counter(r[TASK] for r in route(skewed, "k", plan, ["id"]).collect())
    assert max(per.values()) < 2 * 6005 / 8


def test_aggregate_equals_group_by(skewed):
    plan = plan_shards(skewed, "k", tasks=8)
    got = balanced_aggregate(skewed.withColumn("n", F.lit(1).cast("bigint")), "k", ["n", "v"], plan)
    want = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    text = got._jdf.queryExecution().toString()
    assert TASK in text.split("== Optimized Logical Plan ==")[1] and "RepartitionById" in text.replace("RepartitionByExpression", "RepartitionById")


def test_rows_lie_where_the_plan_packed_them(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 1, 2, 3]) if i % 2 else rng.randrange(10, 3000)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "id bigint, k bigint")
    plan = plan_shards(df, "k", tasks=64)
    here = placed(df, "k", plan, ["id"]).withColumn("at", F.spark_partition_id())
    loads = {r["at"]: r["n"] for r in here.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert here.where(F.col("at") != F.col(TASK)).count() == 0
    assert len(loads) == 64 and max(loads.values()) <= 2 * min(loads.values())
    assert sum(plan.loads()) > 39_000 and max(plan.loads()) <= 2 * min(plan.loads())


@pytest.mark.parametrize("most", [10**9, 0])
def test_sized_join_both_ways(spark, skewed, most):
    right = spark.createDataFrame([(7, "a"), (7, "b"), (9, None), (None, "n")], "k bigint, w string")
    for how, loads in (("inner", None), ("left", skewed.groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n")))):
        got, want = sized_join(skewed, right, "k", how, loads, most), skewed.join(right, "k", how)
        assert Counter(map(tuple, got.select("id", "k", "v", "w").collect())) == Counter(map(tuple, want.select("id", "k", "v", "w").collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_join(spark, skewed, how):
    right = spark.createDataFrame([(7, "a"), (7, "b"), (9, "c"), (None, "n")], "k bigint, w string")
    got = balanced_join(skewed, right, "k", how, plan_shards(skewed, "k", tasks=8), ["id"])
    want = skewed.join(right, "k", how)
    assert Counter(map(tuple, got.select(sorted(got.columns)).collect())) == Counter(map(tuple, want.select(sorted(want.columns)).collect()))


def test_join_refuses_clashing_names(spark, skewed):
    with pytest.raises(ValueError):
        balanced_join(skewed, spark.createDataFrame([(7, 1)], "k bigint, v bigint"), "k")


def test_apply_sees_sorted_runs(skewed):
    def run(batches):
        for b in batches:
            keys = b.column("k").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([keys == sorted(keys, key=lambda x: (x is not None, x or 0))])], names=["n", "ok"])

    out = balanced_apply(skewed, "k", run, "n bigint, ok boolean", plan=plan_shards(skewed, "k", tasks=8)).collect()
    assert sum(r.n for r in out) == 6005 and all(r.ok for r in out)


def test_empty_table(spark):
    e = spark.createDataFrame([], "id bigint, k bigint, v bigint")
    assert plan_shards(e, "k").heavy == []
    assert balanced_aggregate(e, "k", ["v"]).count() == 0


def test_pack_is_even():
    at = pack([(i, 10 - i) for i in range(10)], 3)
    loads = Counter()
    for i, t in at.items():
        loads[t] += 10 - i
    assert max(loads.values()) - min(loads.values()) <= 3
