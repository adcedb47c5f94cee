import random

import pytest
from pyspark.sql import functions as F

from hashloom.llm import similar_sets
from hashloom.llm.similar_sets import Round, rounds, set_classes, similar_between, similar_classes, similar_pairs


def brute(sets, t):
    ids = sorted(i for i, s in sets.items() if s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def data(n=400, seed=1):
    rng = random.Random(seed)
    sets = {}
    for i in range(n):
        if i > 20 and rng.random() < 0.5:
            s = {*sets[rng.randrange(i)]}
            for _ in range(rng.randrange(3)):
                s ^= {rng.randrange(5000)}
            sets[i] = s
        else:
            sets[i] = {rng.randrange(5000) if rng.random() < 0.8 else rng.randrange(5) for _ in range(rng.randrange(0, 30))}
    return sets


def frame(spark, sets):
    return spark.createDataFrame([(i, [*s, None, *list(s)[:1]]) for i, s in sets.items()], "id bigint, s array<bigint>")


@pytest.mark.parametrize("crowd", [256, 4])
def test_pairs_equal_brute_force(spark, crowd):
    sets = data()
    members, classes = set_classes(frame(spark, sets), "id", "s")
    got = {(r.id_a, r.id_b) for r in similar_pairs(members, similar_classes(classes, 0.75, crowd=crowd)).collect()}
    assert got == brute(sets, 0.75)


def test_dirty_rows(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4]), (1, [4, 3, 2, 1]), (2, [1, 2, 3]), (3, None), (4, []), (None, [1, 2, 3]), (5, [3, 2, 1, None])], "id bigint, s array<bigint>")
    members, classes = set_classes(rows.withColumn("rep", F.lit(9)), "id", "s")
    got = {(r.id_a, r.id_b) for r in similar_pairs(members, similar_classes(classes, 0.75)).collect()}
    assert got == {(1, 2), (1, 5), (2, 5)}
    assert classes.count() == 2 and members.count() == 3


def test_a_third_are_copies(spark):
    sets = {i: ({1, 2, 3} if i % 3 == 0 else {i + 200, i + 201, i + 202, i + 1000}) for i in range(90)}
    members, classes = set_classes(frame(spark, sets), "id", "s")
    assert classes.count() == 61 and similar_classes(classes, 0.75).count() == 0
    assert {(r.id_a, r.id_b) for r in similar_pairs(members, similar_classes(classes, 0.75)).collect()} == brute(sets, 0.75)


def test_empty_table_and_bad_threshold(spark):
    e = spark.createDataFrame([], "id bigint, s array<bigint>")
    members, classes = set_classes(e, "id", "s")
    assert similar_pairs(members, similar_classes(classes, 0.75)).count() == 0
    with pytest.raises(ValueError):
        similar_classes(classes, 0)


def test_between_two_tables(spark):
    a, b = data(120, 2), data(120, 2)
    b[3] = {1}
    for ids, by in ((a, 5 * 10**18), (b, -(9 * 10**18))):  # ids at both ends of 64 bits
        ids.update({by + i: ids.pop(i) for i in [*ids][:40]})
    got = {(r.id_a, r.id_b) for r in similar_between(frame(spark, a), frame(spark, b), "id", "s", 0.8).collect()}
    assert got == {(i, j) for i in a for j in b if a[i] and b[j] and len(a[i] & b[j]) >= 0.8 * len(a[i] | b[j])}


def test_rounds_reach_the_recall():
    for t in (0.2, 0.3, 0.75, 0.95):
        total, plan = 0, rounds(t, 0.999)
        for r in plan:
            total = r.trees if r.last else total + r.trees
            assert 1 - (1 - t**r.depth) ** total >= 0.999 and total < 1000
        assert plan[-1].last and not any(r.last for r in plan[:-1])


@pytest.mark.parametrize(("crowd", "plan"), [(4, None), (3, [Round(1, 8), Round(8, 60, True)])])
def test_crowded_neighbourhoods_lose_nothing(spark, crowd, plan):
    rng = random.Random(4)
    core = {*range(100)}
    sets = {i: (core - {rng.randrange(100) for _ in range(4)}) | {1000 + i} for i in range(150)}  # every two of them are similar
    sets |= {200 + i: {rng.randrange(10**6) for _ in range(20)} for i in range(50)}
    members, classes = set_classes(frame(spark, sets), "id", "s")
    got = {(r.id_a, r.id_b) for r in similar_pairs(members, similar_classes(classes, 0.75, crowd=crowd, plan=plan)).collect()}
    assert got == brute(sets, 0.75) and len(got) > 10_000


def test_neighbourhoods_do_not_depend_on_batches(spark):
    sets = data(900, 6)
    members, classes = set_classes(frame(spark, sets), "id", "s")
    want = brute(sets, 0.75)
    for rows in ("7", "100"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            assert {(r.id_a, r.id_b) for r in similar_pairs(members, similar_classes(classes, 0.75, crowd=8)).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_prefixes_are_sent_by_longer_ones(spark, monkeypatch):
    monkeypatch.setattr(similar_sets, "PROBE", 1)
    seen, real = [], similar_sets._hot
    monkeypatch.setattr(similar_sets, "_hot", lambda *a: seen.append(real(*a)) or seen[-1])
    rng = random.Random(5)
    sets = {i: {*range(60)} - {rng.randrange(60) for _ in range(5)} | {100 + rng.randrange(3)} for i in range(300)}
    members, classes = set_classes(frame(spark, sets), "id", "s")
    got = {(r.id_a, r.id_b) for r in similar_pairs(members, similar_classes(classes, 0.75, crowd=3)).collect()}
    assert got == brute(sets, 0.75) and any(1 in h for h in seen)
