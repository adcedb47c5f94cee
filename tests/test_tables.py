from pyspark.sql import functions as F

from hashloom.plans import tables as T


def test_records_of_dirty_blocks(spark):
    rows = [
        (1, 100, 3, None, [5, 6, 6, 9, 9, 9], [0, 2, 2, 3, 7], "x"),  # capacity beyond the fill, an empty record
        (1, 100, 3, 10, [5, 6, 6, 9, 9, 9], [0, 2, 2, 3, 7], "y"),  # delivered again
        (2, 200, None, 1, [1], [0, 1], None), (3, 300, 0, 1, [], [0], None), (4, 400, 1, 1, None, [0, 1], None), (None, 1, 1, 1, [1], [0, 1], None),
    ]
    b = spark.createDataFrame(rows, "block_id bigint, first_row_id bigint, n_rows int, n_cols int, col_ids array<int>, row_start_idx array<int>, extra string")
    got = {r.row_id: r.cols for r in T.matrix_records(b).collect()}
    assert got == {100: [5, 6], 101: [], 102: [6]}
    assert sorted(r.col_id for r in T.block_entries(b).collect()) == [5, 6, 6]
    assert T.record_count(b.where("block_id = 1")).first()["n"] == 3
    assert T.record_count(b.limit(0)).first()["n"] == 0 and T.matrix_records(b.limit(0)).count() == 0


def test_vector_sets(spark):
    rows = [(1, [9, 3, None, 3, 7], 1, 4), (2, [1, 2], None, None), (3, None, 0, 1), (4, [1, 2, 3], None, 2), (5, [1], 1, 1), (None, [1], 0, 1)]
    v = spark.createDataFrame([(*r, 1, None) for r in rows], "id bigint, col_ids array<bigint>, start_idx int, end_idx int, load_no int, loaded_at timestamp")
    assert {r.id: r.set for r in T.vector_sets(v).collect()} == {1: [3], 2: [1, 2], 3: [], 4: [1, 2], 5: []}


def test_names(spark):
    df = spark.createDataFrame([("  Ab ",), (None,), ("",)], "n string")
    assert [r[0] for r in df.select(T.clean_name(F.col("n"))).collect()] == ["ab", None, ""]
