"""Queries of problem 3: per-key rows and totals although a few keys hold most of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.operators.skew import balanced_aggregate, balanced_join, plan_shards
from hashloom.plans.tables import block_entries, dictionary_once, table

#: Names with null, zero or negative counts add nothing to a total.
POSITIVE = "aggregate(filter(names_and_counts, x -> x.name is not null and x.cnt > 0), 0L, (a, x) -> a + cast(x.cnt as bigint))"


def hash_rows(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, key_value, amount) per row id whose hash is not null."""
    rows = dictionary_once(table(spark, d, "dictionary_rows"))
    return rows.where("hash is not null").select("row_id", F.col("hash").alias("key_value"), F.coalesce(F.expr(POSITIVE), F.lit(0)).alias("amount"))


def _field(name: str, df: DataFrame) -> DataFrame:
    summed = balanced_aggregate(df.withColumn("n_rows", F.lit(1).cast("bigint")), "key_value", ["n_rows", "total"])
    return summed.select(F.lit(name).alias("field"), "key_value", "n_rows", "total")


def _fields(spark: SparkSession, d: str) -> list[DataFrame]:
    entries = block_entries(table(spark, d, "matrix_blocks")).select(F.col("col_id").alias("key_value"), F.lit(1).cast("bigint").alias("total"))
    return [_field("dictionary_rows.hash", hash_rows(spark, d).withColumnRenamed("amount", "total")), _field("matrix_blocks.col_ids", entries)]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(field, key_value): keys with at least 2 % of the row ids (hash not null) or of the entries."""
    out = []
    for totals in _fields(spark, d):
        of_all = totals.agg(F.sum("n_rows")).scalar()
        out.append(totals.where(F.col("n_rows") * 50 >= of_all).select("field", "key_value"))
    return out[0].unionByName(out[1])


def p3_key_totals(spark: SparkSession, d: str) -> DataFrame:
    """(field, key_value, n_rows, total) for every hash of dictionary_rows and every column of matrix_blocks.

    n_rows counts row ids (of a hash) or entries (of a column); total is the sum of positive counts, or the entries again.
    """
    one, two = _fields(spark, d)
    return one.unionByName(two)


def p3_shared_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(hash, n_rows, total, counted_rows): hashes of dictionary_rows that dictionary_count_rows has as well, joined row by row.

    The skewed side is cut into shards and the other side's one row per hash is copied to the shards of heavy hashes.
    """
    left = hash_rows(spark, d).withColumnRenamed("key_value", "hash")
    other = dictionary_once(table(spark, d, "dictionary_count_rows")).where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("counted_rows"))
    plan = plan_shards(table(spark, d, "dictionary_rows").where("hash is not null").select("hash"), "hash")
    return balanced_join(left, other, "hash", "inner", plan, ["row_id"]).groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"), F.first("counted_rows").alias("counted_rows")
    )


QUERIES = {"p3_found": p3_found, "p3_key_totals": p3_key_totals, "p3_shared_hashes": p3_shared_hashes}

_ONCE = """
r AS (SELECT DISTINCT ON (row_id) row_id, hash, names_and_counts FROM dictionary_rows WHERE row_id IS NOT NULL),
h AS (SELECT hash, count(*) AS n_rows, coalesce(sum(t), 0) AS total FROM (
        SELECT hash, (SELECT sum(x.u.cnt) FROM (SELECT unnest(names_and_counts) AS u) x WHERE x.u.name IS NOT NULL AND x.u.cnt > 0) AS t
        FROM r WHERE hash IS NOT NULL) GROUP BY hash),
b AS (SELECT DISTINCT ON (block_id) * FROM matrix_blocks WHERE block_id IS NOT NULL AND n_rows > 0),
c AS (SELECT col, count(*) AS n_rows FROM (SELECT unnest(col_ids[row_start_idx[1] + 1 : row_start_idx[n_rows + 1]]) AS col FROM b) GROUP BY col),
k AS (SELECT 'dictionary_rows.hash' AS field, hash AS key_value, n_rows, CAST(total AS BIGINT) AS total FROM h
      UNION ALL SELECT 'matrix_blocks.col_ids', CAST(col AS BIGINT), n_rows, n_rows FROM c)"""

ORACLE = {
    "p3_found": f"WITH {_ONCE} SELECT field, key_value FROM (SELECT *, sum(n_rows) OVER (PARTITION BY field) AS tot FROM k) WHERE n_rows * 50 >= tot",
    "p3_key_totals": f"WITH {_ONCE} SELECT field, key_value, n_rows, total FROM k",
    "p3_shared_hashes": f"""WITH {_ONCE}, o AS (SELECT hash, count(*) AS counted_rows FROM
        (SELECT DISTINCT ON (row_id) row_id, hash FROM dictionary_count_rows WHERE row_id IS NOT NULL) WHERE hash IS NOT NULL GROUP BY hash)
        SELECT h.hash, h.n_rows, CAST(h.total AS BIGINT) AS total, o.counted_rows FROM h JOIN o ON h.hash = o.hash""",
}
