import enum
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashloom.operators.compare import compare, top_tests
from hashloom.operators.matrix import SparseMatrix
from hashloom.operators.mixed import BlockedMatrix, FeatureSet, MixedMatrix, UnknownFeature, minibatches, quantiles, top_k_per_group
from hashloom.plans import storage
from hashloom.sources import fileset, legacy


@pytest.fixture(scope="module")
def csr(spark):
    v = spark.createDataFrame([(0, [0, 1, 2]), (1, []), (2, [0, 5, 8]), (3, [3, 4, 4])], "row_id bigint, col_ids array<int>")
    return SparseMatrix.from_vectors(v)


def test_sizes(csr):
    assert {r.row_id: r.nnz for r in csr.row_nnz().collect()} == {0: 3, 1: 0, 2: 3, 3: 2}
    assert csr.dims().first()["nnz"] == 8


def test_cooccurrence_invariants(spark, csr):
    c = csr.cooccurrence(spark.createDataFrame([(0,), (1,), (5,), (7,)], "col_id int")).collect()
    n = {(r.col_a, r.col_b): r.n for r in c}
    assert len(n) == 16 and all(n[a, b] == n[b, a] for a, b in n)
    assert n[0, 0] == 2 and n[0, 1] == 1 and n[1, 5] == 0 and n[7, 7] == 0
    assert [r.col_id for r in csr.top_columns(2).orderBy("col_id").collect()] == [0, 1]


def test_products(spark, csr):
    theta = spark.createDataFrame([(i, j, float(i + j)) for i in range(10) for j in range(3)], "col_id int, j int, v double")
    got = {(r.row_id, r.j): r.value for r in csr.times_matrix(theta).collect()}
    assert [got[2, j] for j in range(3)] == [13, 16, 19]
    w = spark.createDataFrame([(i, (i + 1) / 10) for i in range(10)], "col_id int, w double")
    assert {r.row_id: round(r.value, 9) for r in csr.times_vector(w).collect()}[2] == 1.6
    out = csr.outer_plus(spark.createDataFrame([(2, 0, 2.5)], "row_id bigint, j int, v double")).collect()
    assert {r.col_id: r.value for r in out} == {0: 2.5, 5: 2.5, 8: 2.5}


def test_lookup_and_csr(spark, csr):
    cells = spark.createDataFrame([(2, 5), (2, 6), (9, 1)], "row_id bigint, col_id int")
    assert {(r.row_id, r.col_id): r.value for r in csr.get(cells).collect()} == {(2, 5): 1.0, (2, 6): 0.0, (9, 1): 0.0}
    ids, starts, cols, vals = csr.to_csr()
    assert ids.tolist() == [0, 1, 2, 3] and starts.tolist() == [0, 3, 3, 6] and cols.tolist() == [0, 1, 2, 0, 5, 8, 3, 4] and set(vals) == {1.0}
    with pytest.raises(ValueError):
        csr.to_csr(limit=3)


def test_null_and_repeated_cells(spark):
    t = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (None, 1, 1.0), (2, None, 1.0), (3, 2, None)], "row_id bigint, col_id int, value double")
    assert {(r.row_id, r.col_id): r.value for r in SparseMatrix.from_triplets(t).triplets.collect()} == {(1, 1): 5.0, (3, 2): 0.0}


@pytest.fixture(scope="module")
def mixed(spark):
    dense = spark.createDataFrame([(r, *[(5 * r + c + 1) / 2 for c in range(5)]) for r in range(4)], "row_id bigint, " + ", ".join(f"c{i} double" for i in range(5)))
    sparse = spark.createDataFrame([(r, i, (i - 5) + 0.1) for r in range(4) for i in range(5, 6 + r)], "row_id bigint, col int, value double")
    return MixedMatrix(dense, sparse, [f"c{i}" for i in range(5)])


def rows(df):
    return sorted(r.row_id for r in df.collect())


def test_mixed_filters(mixed):
    assert rows(mixed.row_filter(F.col("c1") > 1.5)) == [1, 2, 3]
    assert rows(mixed.row_filter(F.col("c0") > 0)) == [0, 1, 2, 3]
    assert rows(mixed.row_filter_sparse(20, F.col("value") > 1)) == []
    assert rows(mixed.row_filter_sparse(7, F.col("value") > 0.1)) == [2, 3]


def test_subset_positions(mixed):
    once = mixed.subset_positions([1, 3])
    assert rows(once.dense) == [1, 3] and rows(once.subset_positions([1]).dense) == [3]
    assert rows(once.subset(F.col("c0") > 5).dense) == [3]
    for bad, text in (([4], "out of range row id (4)"), ([-1], "out of range row id (-1)"), ([2, 1], "unsorted at idx 1")):
        with pytest.raises(ValueError, match=text.replace("(", r"\(").replace(")", r"\)")):
            mixed.subset_positions(bad)


def test_mixed_sums_and_columns(mixed):
    sums = {(r.kind, r.col): r.total for r in mixed.column_sums().collect()}
    assert sums["dense", "c0"] == sum((5 * r + 1) / 2 for r in range(4)) and abs(sums["sparse", "7"] - 4.2) < 1e-9
    assert {r.row_id: round(r.value, 3) for r in mixed.column(7).collect()} == {0: 0, 1: 0, 2: 2.1, 3: 2.1}
    assert {r.col: r.total for r in mixed.dense_sum_squares().collect()}["c0"] == sum(((5 * r + 1) / 2) ** 2 for r in range(4))


class Entree(enum.Enum):
    Hamburger = 1
    Hotdog = 2


class Soda(enum.Enum):
    Small = 1
    Medium = 2
    Large = 3


class Other(enum.Enum):
    X = 1


def test_enum_features(spark):
    fs = FeatureSet(Entree) + FeatureSet(Soda)
    assert len(fs) == 5 and fs.index(Soda.Large) == 4
    with pytest.raises(UnknownFeature):
        fs[Other.X]
    cells = spark.createDataFrame([(i, "Entree_Hamburger", 2.0) for i in range(0, 10, 2)] + [(i, "Soda_Large", 3.0) for i in range(10)], "row_id bigint, name string, v double")
    m = MixedMatrix(fs.from_long(cells, "row_id", "name", "v"), spark.createDataFrame([], "row_id bigint, col string, value double"), fs.columns(), fs)
    assert rows(m.enum_filter(Entree.Hamburger, lambda c: c > 0)) == [0, 2, 4, 6, 8]
    assert m.enum_subset(Entree.Hamburger, lambda c: c > 0).enum_column(Soda.Large).agg(F.sum("value")).first()[0] == 15
    upd = fs.updated(m.dense, Soda.Small, F.lit(7), F.col("row_id") == 1)
    assert {r.row_id: r.Soda_Small for r in upd.collect()}[1] == 7


def test_blocks(spark):
    dense = spark.createDataFrame([(i, i % 3, float(i)) for i in range(10)], "row_id bigint, block_id bigint, x double")
    m = BlockedMatrix(MixedMatrix(dense, spark.createDataFrame([], "row_id bigint, col string, value double"), ["x"]))
    assert {r.block_id: (r.n_rows, r.x) for r in m.totals().collect()} == {0: (4, 18.0), 1: (3, 12.0), 2: (3, 15.0)}
    kept = m.row_subset(spark.createDataFrame([(0, 3), (1, 3)], "block_id bigint, row_id bigint"))
    assert rows(kept.matrix.dense) == [3]
    each = m.each_block(lambda pdf: pdf.groupby("block_id", as_index=False).x.max()[["block_id", "x"]], "block_id bigint, x double").collect()
    assert {r.block_id: r.x for r in each} == {0: 9, 1: 7, 2: 8}


def test_compare(spark):
    long = spark.createDataFrame([(i, "dense", "a", float(i % 4)) for i in range(40)] + [(i, "sparse", "b", 1.0) for i in range(0, 40, 4)] + [(i, "dense", "same", 1.0) for i in range(40)], "row_id bigint, kind string, col string, value double")
    slices = spark.createDataFrame([(i, i % 4 < 2) for i in range(40)], "row_id bigint, is_target boolean")
    got = {r.col: r.score for r in compare(long, slices).collect()}
    t, r = np.array([i % 4 for i in range(40) if i % 4 < 2]), np.array([i % 4 for i in range(40) if i % 4 >= 2])
    assert abs(got["a"] - (t.mean() - r.mean()) / np.sqrt(t.var() / 20 + r.var() / 20)) < 1e-9
    assert got["b"] is None and got["same"] is None
    assert {x.col: x.score for x in compare(long, slices, tests={"b": "t"}).collect()}["b"] > 0
    assert [x.col for x in top_tests(compare(long, slices), 1).collect()] == ["a"]
    ones = spark.createDataFrame([(0, "dense", "c", 2.0), (1, "dense", "c", 1.0)], "row_id bigint, kind string, col string, value double")
    assert compare(ones, spark.createDataFrame([(0, True), (1, False)], "row_id bigint, is_target boolean")).first()["score"] == float("inf")


def test_quantiles(spark):
    df = spark.createDataFrame([(-2.0 * i,) for i in range(1001)] + [(None,)], "x double")
    got = {r.q: r.value for r in quantiles(df, "x", [0, 0.05, 0.1, 0.5, 0.75, 0.9, 1]).collect()}
    assert got == {0: -2000, 0.05: -1900, 0.1: -1800, 0.5: -1000, 0.75: -500, 0.9: -200, 1: 0}
    assert quantiles(df.limit(0), "x", [0.5]).count() == 0
    assert quantiles(spark.createDataFrame([(3.0,)] * 50, "x double"), "x", [0.3]).first()["value"] == 3.0


def test_minibatches_and_top_k(spark):
    df = spark.createDataFrame([(i, i % 2, float(i // 4)) for i in range(10)], "id bigint, g bigint, v double")
    assert sorted(r["count"] for r in minibatches(df, "id", 4).groupBy("batch").count().collect()) == [2, 4, 4]
    top = top_k_per_group(df, "g", "v", "id", 2).collect()
    assert sorted((r.g, r.rank, r.id) for r in top) == [(0, 1, 8), (0, 2, 4), (1, 1, 9), (1, 2, 5)]
    low = top_k_per_group(df.unionByName(df.limit(1).selectExpr("99L id", "1L g", "cast(null as double) v")), "g", "v", "id", 2, largest=False).collect()
    assert sorted((r.g, r.rank, r.id) for r in low) == [(0, 1, 0), (0, 2, 2), (1, 1, 1), (1, 2, 3)]


def test_legacy_layouts(spark, tmp_path):
    assert len(legacy.encode_vectors(iter([np.array([0, 5, 8, 10]), np.arange(1, 8)]))) == 52
    assert [a.tolist() for a in legacy.decode_vectors(legacy.encode_vectors(iter([np.array([0, 1, 2])]), True), True)] == [[0, 1, 2]]
    v = spark.createDataFrame([(1, [0, 5, 8], [1.0, 2.5, 3.0]), (2, [], [])], "row_id bigint, col_ids array<bigint>, vals array<double>").coalesce(1)
    for counts in (False, True):
        folder = str(tmp_path / f"v{counts}")
        legacy.write_vectors(v, folder, counts=counts)
        back = legacy.read_vectors(spark, folder, counts=counts).orderBy("position").collect()
        assert [r.col_ids for r in back] == [[0, 5, 8], []]
        assert not counts or back[0].vals == [1.0, 2.5, 3.0]
    dense, starts = np.zeros((30, 10)), np.linspace(0, 1000, 31).astype(int)
    data = legacy.encode_mixed(dense, starts, np.zeros(1200, int), np.zeros(1200), 100)
    d, s, i, x, n = legacy.decode_mixed(data)
    assert d.shape == (30, 10) and s[-1] == 1000 and len(i) == len(x) == 1000 and n == 100
    with pytest.raises(ValueError):
        legacy.decode_vectors(b"\x00\x00\x00\x05\x00")


def test_fileset(spark, tmp_path):
    dims = spark.createDataFrame([(0, 10, 90), (1, 10, 90), (2, 1, 1)], "part int, n_rows bigint, nnz bigint")
    assert [r.part for r in fileset.parts_within(dims, 801).collect()] == [0, 1]
    assert [r.part for r in fileset.parts_within(dims, 800).collect()] == [0]
    assert tuple(fileset.counts_of(dims).first()) == (21, 181)
    m = spark.createDataFrame([("a\tb", 5), ("c", -3)], "feature string, hash bigint")
    fileset.write_dictionary(m, str(tmp_path / "d"))
    assert {r.feature: r.hash for r in fileset.read_dictionary(spark, str(tmp_path / "d")).collect()} == {"a\tb": 5, "c": -3}
    d = spark.createDataFrame([(0, ["x", "y"]), (1, ["z"])], "col_id bigint, names array<string>")
    fileset.write_code_lookup(d, str(tmp_path / "l"))
    assert {r.col_id: r.name for r in fileset.read_code_lookup(spark, str(tmp_path / "l")).collect()} == {0: "x|OR|y", 1: "z"}
    fileset.write_code_lookup(d.where("col_id = 1"), str(tmp_path / "l2"))
    with pytest.raises(ValueError):
        fileset.read_code_lookup(spark, str(tmp_path / "l2"))
    fileset.write_enumeration(d, str(tmp_path / "e"))
    assert [r.value for r in spark.read.text(str(tmp_path / "e")).collect()] == ["x|OR|y", "z"]
    assert fileset.part_paths("r", 3)["vectors"] == "r/vectors.bin.parts/part-00003"


def test_saved_matrix_loads_within_a_budget(spark, tmp_path):
    t = spark.createDataFrame([(r, c, 1.0) for r in range(40) for c in range(r % 5)], "row_id bigint, col_id bigint, value double")
    m = SparseMatrix.from_triplets(t, spark.range(40).withColumnRenamed("id", "row_id"))
    path = str(tmp_path / "m")
    m.save(path, F.pmod("row_id", F.lit(4)))
    assert tuple(SparseMatrix.load(spark, path).dims().first()) == tuple(m.dims().first()) == tuple(spark.read.parquet(f"{path}/dims").first())
    base = 4 * (2 + 16)  # names 0 to 3
    dims = {r.part: (r.n_rows, r.nnz) for r in spark.read.parquet(f"{path}/partition_dims").collect()}
    for n in range(5):
        room = base + sum(sum(dims[p]) * 4 for p in range(n)) + 1
        got = fileset.load_limited(spark, path, room)
        assert {r.row_id for r in got.row_keys.collect()} == {r for r in range(40) if r % 4 < n}
        assert got.triplets.count() == sum(dims[p][1] for p in range(n))
    spark.createDataFrame([(0, 10, 3)], "part int, n_rows bigint, nnz bigint").write.mode("overwrite").parquet(f"{path}/partition_dims")
    with pytest.raises(ValueError):
        fileset.load_limited(spark, path)


def test_conversion_of_sets_and_dims_as_text(spark, tmp_path):
    v = spark.createDataFrame([(0, 1, [7, 9, 7, None]), (0, 2, []), (1, 3, [9, 100]), (1, 4, None)], "part int, row_id bigint, hashes array<bigint>").withColumn("hash", F.lit("x"))
    mapping = spark.createDataFrame([("a", 7), ("b", 9), ("c", 9), ("q", 100)], "feature string, hash bigint")
    ids = fileset.kept_ids(v, 0.4, mapping, F.col("feature") == "q")
    assert {r.hash: r.col_id for r in ids.collect()} == {9: 0, 100: 1}
    out, dims = fileset.converted(v, ids)
    assert {r.row_id: r.col_ids for r in out.collect()} == {1: [0], 2: [], 3: [0, 1], 4: []}
    assert sorted(map(tuple, dims.collect())) == [(0, 2, 2, 1), (1, 2, 2, 2)]
    assert {r.col_id: r.name for r in fileset.remapped_dictionary(mapping.where("feature <> 'q'"), ids).collect()} == {0: "b|OR|c", 1: None}
    total = dims.agg(F.sum("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.sum("nnz").alias("nnz"))
    fileset.write_dims(total, dims, str(tmp_path / "dims"))
    one, two = fileset.read_dims(spark, str(tmp_path / "dims"))
    assert tuple(one.first()) == (4, 2, 3) and sorted(map(tuple, two.collect())) == [(0, 2, 1), (1, 2, 2)]
    assert fileset.converted(v.limit(0), ids)[1].count() == 0


def test_mixed_files_and_file_sets(spark, tmp_path):
    rows = [(i, [float(i), 0.5], list(range(i % 3)), [1.5] * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id bigint, dense array<double>, col_ids array<bigint>, vals array<double>").repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
    legacy.write_mixed(df, f"file://{tmp_path}/x", 2, 5)
    back = sorted(legacy.read_mixed(spark, f"{tmp_path}/x").collect(), key=lambda r: (r.part, r.position))
    assert [(r.dense, r.col_ids, r.vals) for r in back] == [tuple(r[1:]) for r in rows]
    one = legacy.read_mixed(spark, f"{tmp_path}/x/part-00001").collect()
    assert {r.part for r in one} == {1}
    legacy.write_mixed(df.limit(0), f"{tmp_path}/none", 2, 5)
    assert legacy.read_mixed(spark, f"{tmp_path}/none").count() == 0
    files = fileset.FileSet(str(tmp_path / "set"))
    assert files.numbers(spark) == []
    legacy.write_vectors(df, f"{files.root}/{fileset.PARTS[0]}", wide=True)
    assert files.numbers(spark) == [0, 1, 2] and files.part(2)["vectors"].endswith("part-00002")
    assert files.vectors(spark).count() == 12 and 0 < files.vectors(spark, first=2).count() < 12
    assert files.merged_dims.endswith("mergedDims.txt") and files.merged_dictionary.startswith(files.root)
    with pytest.raises(ValueError):
        legacy.local_path("s3a://x/y")


def test_mixed_parts_without_rows(spark, tmp_path):
    rows = [(0, [1.0, None], [4, None, 1], [1.5, 2.5, None]), (1, [0.5, 2.0], None, None), (2, [3.0, 4.0], [], [])]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "row_id bigint, dense array<double>, col_ids array<bigint>, vals array<double>")
    legacy.write_mixed(df.where("row_id < 1"), str(tmp_path / "x"), 2, 5)
    assert len(list((tmp_path / "x").glob("part-*"))) == 3
    (one,) = legacy.read_mixed(spark, str(tmp_path / "x")).collect()
    assert one.dense[0] == 1.0 and np.isnan(one.dense[1]) and one.col_ids == [4, 1] and one.vals[0] == 1.5 and np.isnan(one.vals[1])
    legacy.write_mixed(df, str(tmp_path / "y"), 2, 5)
    assert [(r.col_ids, r.vals) for r in legacy.read_mixed(spark, str(tmp_path / "y")).orderBy("part", "position").collect()][1:] == [([], []), ([], [])]
    with pytest.raises(Exception, match="2.*dense values"):
        legacy.write_mixed(df.withColumn("dense", F.slice("dense", 1, 1)), str(tmp_path / "z"), 2, 5)


def test_mixed_files_in_stretches(monkeypatch):
    per = [0, 3, 9, 0, 0, 1, 2, 0]
    starts, ids, dense = np.cumsum([0, *per]), np.arange(15), np.arange(16.0).reshape(8, 2)
    data = legacy.encode_mixed(dense, starts, ids, ids / 2, 20)
    for stretch in (1, 4, 7, 1000):
        monkeypatch.setattr(legacy, "STRETCH", stretch)
        got = [r for b in legacy._stretches(5, io.BytesIO(data)) for r in b.to_pylist()]
        assert [(r["part"], r["position"]) for r in got] == [(5, i) for i in range(8)]
        assert [r["dense"] for r in got] == dense.tolist()
        assert [r["col_ids"] for r in got] == [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
        assert [r["vals"] for r in got] == [(ids[a:b] / 2).tolist() for a, b in zip(starts, starts[1:])]
    for broken in (data[:-1], data[:10], data[:20] + data[24:]):
        with pytest.raises(ValueError):
            list(legacy._stretches(5, io.BytesIO(broken)))


def test_mixed_query_on_uneven_tables(spark, tmp_path):
    rows = [(5.0, 0.05, 0.01, "A"), (None, 0.1, None, "N"), (7.0, None, None, None), (1.0, 0.0, None, "X")]
    spark.createDataFrame(rows, "l_quantity double, l_discount double, l_tax double, l_returnflag string").repartition(7).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert tuple(storage.io_mixed(spark, str(tmp_path)).first()) == (4, 1300, 15, 1, 1, 1, 0)
    spark.createDataFrame([(None, 0.1, 0.1, "R")] * 2, "l_quantity double, l_discount double, l_tax double, l_returnflag string").write.parquet(str(tmp_path / "b/lineitem.parquet"))
    assert tuple(storage.io_mixed(spark, str(tmp_path / "b")).first()) == (2, None, 20, 20, 0, 0, 2)
