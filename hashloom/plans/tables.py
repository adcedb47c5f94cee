"""Readers of the project's tables, with redelivered rows counted once.

All readers accept extra columns; every result holds only the columns named in its docstring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slice_between(array: Column, start: Column, end: Column) -> Column:
    """Positions [start, end) of ``array``, counted from 0; null or inverted bounds give an empty array."""
    low = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    length = F.greatest(F.coalesce(end, F.lit(0)) - low, F.lit(0))
    return F.slice(array, low + F.lit(1), length)


def blocks_once(blocks: DataFrame) -> DataFrame:
    """One copy of every block_id; rows without a block_id or without either array are dropped."""
    return (
        blocks.select("block_id", "first_row_id", "n_rows", "col_ids", "row_start_idx")
        .where("block_id is not null and first_row_id is not null and n_rows > 0 and col_ids is not null and row_start_idx is not null")
        .dropDuplicates(["block_id"])
    )


def matrix_records(blocks: DataFrame) -> DataFrame:
    """(row_id BIGINT, cols ARRAY<INT>) of every record of every block, empty records included.

    A column repeated in a record stays repeated. Values beyond the fill of the arrays never appear.
    """
    record = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") - 1),
        lambda r: F.struct(
            (F.col("first_row_id") + r.cast("bigint")).alias("row_id"),
            slice_between(F.col("col_ids"), F.get(F.col("row_start_idx"), r), F.get(F.col("row_start_idx"), r + 1)).alias("cols"),
        ),
    )
    return blocks_once(blocks).select(F.explode(record).alias("r")).select("r.row_id", "r.cols")


def block_entries(blocks: DataFrame) -> DataFrame:
    """(block_id, col_id BIGINT): all entries of all records, repeated ones kept, read as one slice per block."""
    first = F.get(F.col("row_start_idx"), F.lit(0))
    last = F.get(F.col("row_start_idx"), F.col("n_rows"))
    return blocks_once(blocks).select("block_id", F.explode(slice_between(F.col("col_ids"), first, last).cast("array<bigint>")).alias("col_id")).where("col_id is not null")


def record_count(blocks: DataFrame) -> DataFrame:
    """(n BIGINT): the number of matrix records, empty ones included; 0 for an empty table."""
    once = blocks.select("block_id", "n_rows").where("block_id is not null and n_rows > 0").groupBy("block_id").agg(F.max("n_rows").alias("n_rows"))
    return once.agg(F.coalesce(F.sum(F.col("n_rows").cast("bigint")), F.lit(0)).cast("bigint").alias("n"))


def dictionary_once(rows: DataFrame) -> DataFrame:
    """(row_id, hash, names_and_counts): one copy of every row id; rows without a row id are dropped."""
    return rows.select("row_id", "hash", "names_and_counts").where("row_id is not null").dropDuplicates(["row_id"])


def clean_name(name: Column) -> Column:
    """Blanks at both ends removed, lower case."""
    return F.lower(F.trim(name))


def vector_sets(rows: DataFrame) -> DataFrame:
    """(id, set ARRAY<BIGINT>, load_no, loaded_at) per delivered row: the distinct non-null values in [start_idx, end_idx), sorted.

    If both bounds are null the whole array counts; if one is null, it stands for that end of the array. A null array is an empty set.
    """
    whole = F.coalesce(F.col("col_ids"), F.array().cast("array<bigint>"))
    part = slice_between(whole, F.col("start_idx"), F.coalesce(F.col("end_idx"), F.size(whole)))
    return rows.where("id is not null").select("id", F.sort_array(F.array_distinct(F.array_compact(part))).alias("set"), "load_no", "loaded_at")
