"""Sparse matrices: triplets, row keys and a dictionary, all DataFrames.

Triplets are the form queries work on; packed arrays are the form of storage and kernels. Row keys are kept apart, because a row
without entries is still a row. Binary matrices have value 1.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.operators.dictionary import enumerate_hashes
from hashloom.operators.skew import sized_join


@dataclass
class SparseMatrix:
    """triplets (row_id, col_id, value), row_keys (row_id), dictionary (hash, names, col_id)."""

    triplets: DataFrame
    row_keys: DataFrame
    dictionary: DataFrame

    @classmethod
    def from_triplets(cls, triplets: DataFrame, row_keys: DataFrame | None = None, dictionary: DataFrame | None = None) -> SparseMatrix:
        """Null ids are dropped; repeated cells are summed up. Without row keys, rows are those with entries."""
        t = triplets.where("row_id is not null and col_id is not null")
        value = F.coalesce(F.col("value").cast("double"), F.lit(0.0)) if "value" in t.columns else F.lit(1.0)
        cells = t.select("row_id", "col_id", value.alias("value")).groupBy("row_id", "col_id").agg(F.sum("value").alias("value"))
        keys = cells.select("row_id").distinct() if row_keys is None else row_keys.select("row_id").where("row_id is not null").distinct()
        if dictionary is None:
            dictionary = cells.select("col_id").distinct().select(F.col("col_id").cast("bigint").alias("hash"), F.array(F.col("col_id").cast("string")).alias("names"), "col_id")
        return cls(cells, keys, dictionary)

    @classmethod
    def from_vectors(cls, vectors: DataFrame, dictionary: DataFrame | None = None) -> SparseMatrix:
        """From packed rows (row_id, col_ids [, vals]); repeated ids of a binary row count once."""
        if "vals" in vectors.columns:
            x = vectors.select("row_id", F.explode(F.arrays_zip("col_ids", "vals")).alias("x")).select("row_id", F.col("x.col_ids").alias("col_id"), F.col("x.vals").alias("value"))
        else:
            x = vectors.select("row_id", F.explode(F.array_distinct("col_ids")).alias("col_id"))
        return cls.from_triplets(x, vectors.select("row_id"), dictionary)

    # sizes

    def dims(self) -> DataFrame:
        """One row (n_rows, n_cols, nnz): row keys, dictionary entries, stored cells."""
        one = lambda df: df.agg(F.count(F.lit(1))).scalar()
        return self.triplets.agg(F.count(F.lit(1)).alias("nnz")).select(one(self.row_keys).alias("n_rows"), one(self.dictionary).alias("n_cols"), "nnz")

    def partition_dims(self, part: Column) -> DataFrame:
        """(part, n_rows, nnz) by an expression over row_id, so that it doesn't depend on the layout."""
        keys = self.row_keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
        cells = self.triplets.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("nnz"))
        return keys.join(cells, "part", "left").select("part", "n_rows", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))

    def row_nnz(self) -> DataFrame:
        """(row_id, nnz), zeros included."""
        n = self.triplets.groupBy("row_id").agg(F.count(F.lit(1)).alias("nnz"))
        return self.row_keys.join(n, "row_id", "left").select("row_id", F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"))

    # rows and columns

    def subset_rows(self, predicate: Column) -> SparseMatrix:
        """Rows for which an expression over row_id and nnz holds; columns stay."""
        keys = self.row_nnz().where(predicate).select("row_id")
        return self.rows_of(keys)

    def rows_of(self, ids: DataFrame) -> SparseMatrix:
        keys = self.row_keys.join(ids.select("row_id").distinct(), "row_id", "left_semi")
        return replace(self, triplets=self.triplets.join(keys, "row_id", "left_semi"), row_keys=keys)

    def subset_columns(self, cols: DataFrame) -> SparseMatrix:
        """Columns ``cols`` (col_id) only, enumerated anew from 0 in the same order; rows stay, empty ones too. Unknown ids are ignored."""
        kept = self.dictionary.join(cols.select("col_id").distinct(), "col_id", "left_semi")
        again = enumerate_hashes(kept.withColumnRenamed("col_id", "old_col"))
        cells = sized_join(self.triplets, again.select(F.col("old_col").alias("col_id"), F.col("col_id").alias("new_col")), "col_id").select("row_id", F.col("new_col").alias("col_id"), "value")
        return SparseMatrix(cells, self.row_keys, again.drop("old_col"))

    def subset_by_feature(self, predicate: Column) -> SparseMatrix:
        """Columns of which some name, as ``feature``, satisfies the predicate."""
        cols = self.dictionary.select("col_id", F.explode("names").alias("feature")).where(predicate).select("col_id")
        return self.subset_columns(cols)

    def frequent_columns(self, min_fraction: float, predicate: Column | None = None) -> DataFrame:
        """(col_id): columns in more than a fraction of the rows, and those whose (feature, hash) satisfies the predicate."""
        rows = self.row_keys.agg(F.count(F.lit(1))).scalar()
        often = self.column_sums_sparse().where(F.col("n") > F.lit(min_fraction) * rows).select("col_id")
        if predicate is None:
            return often
        named = self.dictionary.select("col_id", "hash", F.explode("names").alias("feature")).where(predicate).select("col_id")
        return often.unionByName(named).distinct()

    # values

    def get(self, cells: DataFrame) -> DataFrame:
        """``cells`` (row_id, col_id) with their value, 0 where there is none."""
        return cells.join(self.triplets, ["row_id", "col_id"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))

    def row(self, row_id: int) -> DataFrame:
        return self.triplets.where(F.col("row_id") == row_id).select("col_id", "value")

    def column(self, col_id: int) -> DataFrame:
        """(row_id, value) of every row, zeros included."""
        own = self.triplets.where(F.col("col_id") == col_id).select("row_id", "value")
        return self.row_keys.join(own, "row_id", "left").select("row_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def as_counts(self) -> SparseMatrix:
        return replace(self, triplets=self.triplets.withColumn("value", F.lit(1.0)))

    def packed(self, values: bool = True) -> DataFrame:
        """(row_id, col_ids [, vals]): sorted by column id, empty rows with empty arrays."""
        x = self.triplets.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("col_id", "value"))).alias("x"))
        none = lambda t: F.array().cast(t)
        kind = self.triplets.schema["col_id"].dataType.simpleString()
        out = self.row_keys.join(x, "row_id", "left").select("row_id", F.coalesce(F.col("x.col_id"), none(f"array<{kind}>")).alias("col_ids"), F.coalesce(F.col("x.value"), none("array<double>")).alias("vals"))
        return out if values else out.drop("vals")

    def to_csr(self, limit: int = 50_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row ids, row starts, column ids, values) as numpy arrays on the driver; refused for more than ``limit`` cells."""
        if self.triplets.count() > limit:
            raise ValueError(f"more than {limit} cells")
        t = self.triplets.orderBy("row_id", "col_id").toArrow()
        ids = np.sort(self.row_keys.toArrow()["row_id"].to_numpy())
        rows = t["row_id"].to_numpy()
        return ids, np.searchsorted(rows, ids).astype(np.int64), t["col_id"].to_numpy(), t["value"].to_numpy()

    # sums

    def column_sums_sparse(self) -> DataFrame:
        """(col_id, n, total) of the columns with entries."""
        return self.triplets.groupBy("col_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))

    def column_sums(self) -> DataFrame:
        """(col_id, n, total) of every column of the dictionary, zeros included."""
        x = self.dictionary.select("col_id").join(self.column_sums_sparse(), "col_id", "left")
        return x.select("col_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))

    def top_columns(self, n: int) -> DataFrame:
        """(col_id) of the n most frequent columns, ties by lower id."""
        return self.column_sums_sparse().orderBy(F.desc("n"), "col_id").limit(n).select("col_id")

    def cooccurrence(self, cols: DataFrame) -> DataFrame:
        """(col_a, col_b, n) of every pair of the given columns, zeros included; symmetric, the diagonal has the column counts.

        Rows are cut down to the given columns before they meet themselves, and each unordered pair is counted once.
        """
        chosen = cols.select("col_id").distinct()
        cells = sized_join(self.triplets.select("row_id", "col_id"), chosen, "col_id", "left_semi").groupBy("row_id").agg(F.sort_array(F.collect_set("col_id")).alias("c"))
        a = cells.select("c", F.posexplode("c").alias("i", "col_a"))
        pairs = a.select("col_a", F.explode(F.slice("c", F.col("i") + 1, F.size("c"))).alias("col_b")).groupBy("col_a", "col_b").agg(F.count(F.lit(1)).alias("n"))
        both = pairs.unionByName(pairs.where("col_a <> col_b").select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "n"))
        every = chosen.agg(F.sort_array(F.collect_list("col_id"))).scalar()  # the caller's choice of columns, as is the size of the result
        grid = chosen.select(F.col("col_id").alias("col_a"), F.explode(every).alias("col_b"))
        return grid.join(both, ["col_a", "col_b"], "left").select("col_a", "col_b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    # products

    def times_vector(self, weights: DataFrame) -> DataFrame:
        """(row_id, value): the sum of value x weight over a row; ``weights`` is (col_id, w), missing ones count 0, every row appears."""
        x = sized_join(self.triplets, weights.select("col_id", "w"), "col_id").groupBy("row_id").agg(F.sum(F.col("value") * F.col("w")).alias("v"))
        return self.row_keys.join(x, "row_id", "left").select("row_id", F.coalesce("v", F.lit(0.0)).alias("value"))

    def times_matrix(self, theta: DataFrame) -> DataFrame:
        """(row_id, j, value) for ``theta`` (col_id, j, v); rows without entries have no result rows."""
        return sized_join(self.triplets, theta.select("col_id", "j", "v"), "col_id").groupBy("row_id", "j").agg(F.sum(F.col("value") * F.col("v")).alias("value"))

    def outer_plus(self, row_values: DataFrame) -> DataFrame:
        """(col_id, j, value): values (row_id, j, v) of the rows, added up over the columns the rows have."""
        return self.triplets.join(row_values.select("row_id", "j", "v"), "row_id").groupBy("col_id", "j").agg(F.sum(F.col("value") * F.col("v")).alias("value"))

    # storage

    def save(self, path: str, part: Column | None = None) -> None:
        """vectors by part, dictionary, dims and partition dims as Parquet.

        ``part`` is an expression over row_id that gives the number of a row's part; by default as many parts as shuffle partitions, by hash.
        """
        spark = self.row_keys.sparkSession
        number = F.pmod(F.xxhash64("row_id"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))) if part is None else part
        self.packed().withColumn("part", number.cast("int")).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/vectors")
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        written = spark.read.parquet(f"{path}/vectors")
        parts = written.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("col_ids").cast("bigint")).alias("nnz"))
        parts.coalesce(1).write.mode("overwrite").parquet(f"{path}/partition_dims")  # one row per part
        stored = spark.read.parquet(f"{path}/partition_dims")
        columns = spark.read.parquet(f"{path}/dictionary").agg(F.count(F.lit(1))).scalar()
        total = stored.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("nnz"), F.lit(0)).alias("nnz"))
        total.select("n_rows", columns.alias("n_cols"), "nnz").write.mode("overwrite").parquet(f"{path}/dims")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dims: bool = True) -> SparseMatrix:
        vectors, dictionary = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/dictionary")
        cells = vectors.select("row_id", F.explode(F.arrays_zip("col_ids", "vals")).alias("x")).select("row_id", F.col("x.col_ids").alias("col_id"), F.col("x.vals").alias("value"))
        return cls(cells, vectors.select("row_id"), dictionary)

    def __repr__(self) -> str:
        return f"SparseMatrix(row_keys{self.row_keys.columns}, triplets{self.triplets.columns}, dictionary{self.dictionary.columns}; dims() counts it)"
