import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.llm import pair_table
from hashloom.llm import stable_sample as stable_sample_module
from hashloom.llm.heavy_hitters import ConservativeSketch, frequent, heavy_hitters
from hashloom.llm.pair_table import PairTable, basket_changes
from hashloom.llm.queries import QUERIES
from hashloom.llm.residuals import term_scores
from hashloom.llm.stable_sample import SampleStore, running_weights, stable_sample
from hashloom.llm.term_stats import marked, term_frequencies


def test_sketch_never_underestimates_and_bounds_the_error():
    rng = np.random.default_rng(1)
    s, true = ConservativeSketch(512, 4), Counter()
    for _ in range(50):
        h, c = np.unique(rng.zipf(1.3, 400).astype(np.int64) * 7919, return_counts=True)
        now = s.add(h, c.astype(np.int64))
        true.update(dict(zip(h.tolist(), c.tolist())))
        assert all(e >= true[k] for k, e in zip(h.tolist(), now.tolist()))
    keys = np.array(list(true))
    over = s.estimate(keys) - np.array([true[k] for k in keys])
    assert (over >= 0).all() and np.quantile(over, 0.98) <= np.e / 512 * sum(true.values())


def test_heavy_hitters(spark):
    rows = [("hot", 5)] * 400 + [(f"n{i}", 1) for i in range(3000)] + [("warm", 40)] * 20 + [(None, 9), ("hot", None), ("hot", 0), ("hot", -4)]
    df = spark.createDataFrame(rows, "x string, c int").withColumn("item", F.lit("clash")).withColumn("amount", F.lit(3))
    got = {r["item"]: r.estimate for r in frequent(df, "x", "c", 0.05, width=2048, candidates=50).collect()}
    assert set(got) == {"hot", "warm"} and 2000 <= got["hot"] <= 2020
    assert frequent(df.limit(0), "x", "c", 0.05).count() == 0
    assert sum(r.stream_total for r in heavy_hitters(df, "x", "c").collect()) == 5800


def test_residuals_equal_numpy(spark):
    recs = [(1, [1, 1, 2]), (2, [2, 3, None]), (3, []), (4, None), (5, [1, 4]), (6, [7, 7, 7, 7])]
    df = spark.createDataFrame(recs, "row_id bigint, cols array<int>").withColumn("term", F.lit(1)).withColumn("df", F.lit(2))
    got = {(r.row_id, r.term): r for r in term_scores(df).collect()}
    x = np.zeros((6, 8))
    for i, (_, c) in enumerate(recs):
        for t in c or []:
            if t is not None:
                x[i, t] += 1
    n, rows, cols = x.sum(), x.sum(1), x.sum(0)
    for (i, t), r in got.items():
        e = rows[i - 1] * cols[t] / n
        res = (x[i - 1, t] - e) / e**0.5
        assert r.tf == x[i - 1, t] and r.df == (x[:, t] > 0).sum() and r.n_records == 6
        assert abs(r.residual - res) < 1e-9 and abs(r.adjusted - res / ((1 - rows[i - 1] / n) * (1 - cols[t] / n)) ** 0.5) < 1e-9
    assert len(got) == (x > 0).sum()
    probes = spark.createDataFrame([(1,), (1,), (None,), (99,)], "row_id bigint")
    assert {r.row_id for r in term_scores(df, only=probes).collect()} == {1}
    assert term_scores(df.limit(0)).count() == 0
    one = term_scores(spark.createDataFrame([(1, [5])], "row_id bigint, cols array<int>")).first()
    assert one.residual == 0 and one.adjusted is None


def pair_counts(baskets):
    c = Counter()
    for b in baskets.values():
        s = sorted({x for x in b or [] if x is not None})
        c.update((p, q) for i, p in enumerate(s) for q in s[i + 1 :])
    return c


def frame(spark, baskets):
    return spark.createDataFrame(list(baskets.items()), "k bigint, items array<bigint>")


def test_incremental_pairs_equal_recount(spark, tmp_path):
    rng = random.Random(4)
    before = {k: [rng.randrange(30) for _ in range(rng.randrange(8))] for k in range(200)} | {900: None, 901: [5, None, 5], 902: list(range(100, 260))}
    after = {k: (v if k % 10 else [rng.randrange(30) for _ in range(4)]) for k, v in before.items() if k % 17} | {1000: [1, 2, 3]}
    t = PairTable(spark, str(tmp_path / "p"), buckets=4).apply(frame(spark, before).select("items", F.lit(1).cast("bigint").alias("sign")))
    assert {(r.a, r.b): r.n for r in t.pairs().collect()} == pair_counts(before)
    t.apply(basket_changes(frame(spark, before), frame(spark, after), "k", "items"))
    assert {(r.a, r.b): r.n for r in t.pairs().collect()} == pair_counts(after)
    again = PairTable.open(spark, str(tmp_path / "p"))
    assert {(r.a, r.b): r.n for r in again.pairs().collect()} == pair_counts(after) and again.baskets == len(after)
    s = {(r.a, r.b): r for r in t.scores(2).collect()}
    df = Counter(x for b in after.values() for x in {y for y in b or [] if y is not None})
    assert s and all(abs(r.lift - r.n * len(after) / (df[a] * df[b])) < 1e-9 for (a, b), r in s.items())
    hit = {(r.a, r.b) for r in t.affected_scores().collect()}
    old = pair_counts(before)
    moved = {p for p, n in pair_counts(after).items() if n != old[p]}
    assert moved <= hit
    t.apply(frame(spark, {}).select("items", F.lit(1).cast("bigint").alias("sign")))
    assert {(r.a, r.b): r.n for r in t.pairs().collect()} == pair_counts(after)
    more = frame(spark, {5000: [1, 2, 2]}).select("items", F.lit(1).cast("bigint").alias("sign"))
    assert t.apply(more, load_id="x").baskets == len(after) + 1
    assert t.apply(more, load_id="x").baskets == PairTable.open(spark, t.path).apply(more, load_id="x").baskets == len(after) + 1
    t.apply(more.withColumn("sign", -F.col("sign")), load_id="y")
    assert t.clean() and t.clean() == [] and {(r.a, r.b): r.n for r in PairTable.open(spark, t.path).pairs().collect()} == pair_counts(after)
    t.apply(frame(spark, after).select("items", F.lit(-1).cast("bigint").alias("sign")))
    assert t.pairs().count() == 0 and t.items().count() == 0 and t.baskets == 0


def test_buckets_follow_the_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pair_table, "BUCKET_ROWS", 20)
    rng = random.Random(9)
    one, two = ({k: [rng.randrange(200) for _ in range(8)] for k in range(n)} for n in (20, 300))
    t = PairTable(spark, str(tmp_path / "p"))
    sizes = []
    for part in (one, two):
        t.apply(frame(spark, part).select("items", F.lit(1).cast("bigint").alias("sign")))
        sizes.append(t.buckets)
    assert sizes[1] > 4 * sizes[0] >= 64
    both = pair_counts({**{(1, k): v for k, v in one.items()}, **{(2, k): v for k, v in two.items()}})
    assert {(r.a, r.b): r.n for r in PairTable.open(spark, t.path).pairs().collect()} == both


def blocks_of(spark, path, records, per=50):
    """matrix_blocks with the given records (row id -> columns), numbered from 0."""
    rows = []
    for k in range(0, len(records), per):
        own = [records[r] for r in range(k, min(k + per, len(records)))]
        starts = np.cumsum([0, *map(len, own)]).tolist()
        rows.append((k, k, len(own), 99, [c for r in own for c in r], starts, datetime(2020, 1, 1 + k // per)))
    schema = "block_id bigint, first_row_id bigint, n_rows int, n_cols int, col_ids array<int>, row_start_idx array<int>, written_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/matrix_blocks.parquet")


def test_every_pair_has_a_score(spark, tmp_path):
    rng = random.Random(7)
    records = {r: [rng.randrange(40) for _ in range(rng.randrange(6))] for r in range(170)}
    blocks_of(spark, tmp_path, records)
    want, df = pair_counts(records), Counter(x for b in records.values() for x in {*b})
    assert min(want.values()) == 1
    got = {(r.col_a, r.col_b): r for r in QUERIES["p5_pairs"](spark, str(tmp_path)).collect()}
    assert {p: r.n for p, r in got.items()} == want
    for (a, b), r in got.items():
        lift = r.n * 170 / (df[a] * df[b])
        assert abs(r.lift - lift) < 1e-5 and abs(r.npmi - np.log(lift) / -np.log(r.n / 170)) < 1e-5


def test_term_frequencies(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 5 + [f"t{i}" for i in range(40)]), rng.randrange(60)) for _ in range(4000)] + [(None, 1), ("x", None)]
    df = spark.createDataFrame(rows, "item string, rec bigint").withColumn("total", F.lit(0))
    want = {}
    for t, r in rows:
        if t is not None and r is not None:
            want.setdefault(t, []).append(r)
    for parts in (1, 5):
        got = {r["item"]: (r.total, r.records) for r in term_frequencies(df.repartition(3), "item", "rec", parts).collect()}
        assert got == {t: (len(v), len({*v})) for t, v in want.items()}
    assert term_frequencies(df.limit(0), "item", "rec").count() == 0
    f = spark.createDataFrame([("a", 1, 2), ("b", 9, 3), ("c", 9, 50)], "item string, total bigint, records bigint")
    assert {r["item"]: r.mark for r in marked(f, spark.createDataFrame([(100,)], "n bigint"), 3, 0.2).collect()} == {"a": "rare", "b": None, "c": "common"}


def test_batches_that_cut_a_run(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(1, r // 3) for r in range(90)], "item bigint, rec bigint")
        r = term_frequencies(df, "item", "rec", 2).first()
        assert (r.total, r.records) == (90, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ids(df):
    return {r.id for r in df.collect()}


def test_sample_is_stable_and_grows(spark, tmp_path):
    first = spark.range(4000).withColumn("w", F.lit(1.0))
    more = spark.range(3000, 8000).withColumn("w", F.when(F.col("id") % 2 == 0, 3.0).otherwise(0.5))
    store = SampleStore(spark, str(tmp_path / "s")).add(first, "id", "w")
    one = ids(store.sample(0.1))
    assert one == ids(stable_sample(running_weights(first.repartition(9), "id", "w"), 0.1)) and abs(len(one) - 400) < 80
    two = ids(store.add(more, "id", "w").sample(0.1))
    assert one <= two
    assert two == ids(stable_sample(running_weights(more.unionByName(first), "id", "w"), 0.1))
    heavy = [i for i in range(4000, 8000, 2)]
    assert abs(sum(i in two for i in heavy) / len(heavy) - 0.3) < 0.05


def test_store_is_opened_again_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stable_sample_module, "MERGE", 3)
    path, kept = str(tmp_path / "s"), set()
    other = spark.newSession()
    for k in range(1, 8):
        rows = spark.createDataFrame([(i, float((i * k) % 7)) for i in range(0, 300, k)], "id bigint, w double")
        store = SampleStore(other if k % 2 else spark, path)  # each load by another object, in two sessions
        assert store.step == k - 1
        store.add(rows, "id", "w")
        now = {r.id for r in SampleStore(spark, path).sample(0.05).collect()}
        assert kept <= now
        kept = now
    want = {i: max((i * k) % 7 for k in range(1, 8) if i % k == 0) for i in range(300)}
    assert {r.id: r.weight for r in SampleStore(spark, path).weights().collect()} == want
    assert SampleStore(spark, path).base == 6
    (tmp_path / "s" / "step=8").mkdir()  # a load that failed
    assert SampleStore(spark, path).step == 7
    assert SampleStore(spark, path).add(rows, "id", "w").step == 8
    with pytest.raises(ValueError):
        SampleStore(spark, str(tmp_path / "none")).sample(0.1)


def test_sample_of_dirty_weights(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, -1.0), (None, 9.0), (4, 1e9), (4, 0.0)], "id bigint, weight double")
    assert ids(stable_sample(running_weights(df, "id", "weight"), 1.0)) == {4}
    assert stable_sample(running_weights(df.limit(0), "id"), 0.5).count() == 0
