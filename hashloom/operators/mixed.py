"""Mixed matrices: named dense columns beside sparse cells, enum-typed columns, blocks."""

from __future__ import annotations

import enum
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.operators.dictionary import enumerate_ids


#: The error texts of row subsets by position.
OUT_OF_RANGE, UNSORTED = "tried to subset with out of range row id ({})", "subset row idxs must be sorted (unsorted at idx {})"


class UnknownFeature(TypeError):
    """An enum constant that isn't part of a feature set; raised before any job runs."""


class FeatureSet:
    """An ordered list of enum classes; each constant is one dense column, numbered through in that order."""

    def __init__(self, *enums: type[enum.Enum]):
        self.enums = enums
        self.members = [m for e in enums for m in e]
        self.offsets = {e: sum(len(x) for x in enums[:i]) for i, e in enumerate(enums)}

    def __add__(self, other: FeatureSet) -> FeatureSet:
        return FeatureSet(*self.enums, *other.enums)

    def __len__(self) -> int:
        return len(self.members)

    def column(self, member: enum.Enum) -> str:
        """The column's name; constants of other enums are refused."""
        if not isinstance(member, enum.Enum) or type(member) not in self.enums:
            raise UnknownFeature(f"{member!r} is not a feature of {[e.__name__ for e in self.enums]}")
        return f"{type(member).__name__}_{member.name}"

    def index(self, member: enum.Enum) -> int:
        self.column(member)
        return self.members.index(member)

    def columns(self) -> list[str]:
        return [self.column(m) for m in self.members]

    def __getitem__(self, member: enum.Enum) -> Column:
        return F.coalesce(F.col(self.column(member)), F.lit(0.0))

    def updated(self, df: DataFrame, member: enum.Enum, value: Column, where: Column | None = None) -> DataFrame:
        """``df`` with the dense cell set, for the rows where the condition holds."""
        c = self.column(member)
        return df.withColumn(c, value.cast("double") if where is None else F.when(where, value.cast("double")).otherwise(F.col(c)))

    def from_long(self, cells: DataFrame, row_id: str, name: str, value: str) -> DataFrame:
        """One row per ``row_id`` with every column of the set, 0 where a row has no such cell; other names are ignored."""
        sums = [F.coalesce(F.sum(F.when(F.col(name) == F.lit(c), F.col(value).cast("double"))), F.lit(0.0)).alias(c) for c in self.columns()]
        return cells.groupBy(row_id).agg(*sums)


@dataclass
class MixedMatrix:
    """dense: row_id and one DOUBLE column per dense feature; sparse: (row_id, col, value), col being any name or id; features optional."""

    dense: DataFrame
    sparse: DataFrame
    dense_cols: list[str]
    features: FeatureSet | None = None

    def row_filter(self, predicate: Column) -> DataFrame:
        """(row_id) of the rows whose dense columns satisfy the predicate; null is false."""
        return self.dense.where(predicate).select("row_id")

    def row_filter_sparse(self, col: object, predicate: Column) -> DataFrame:
        """(row_id) by the value of a sparse column, as ``value``, 0 where a row has none."""
        own = self.sparse.where(F.col("col") == F.lit(col)).select("row_id", "value")
        return self.dense.select("row_id").join(own, "row_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0))).where(predicate).select("row_id")

    def subset(self, predicate: Column) -> MixedMatrix:
        """Rows by predicate. Applied to a subset it is one more filter."""
        kept = self.dense.where(predicate)
        return replace(self, dense=kept, sparse=self.sparse.join(kept.select("row_id"), "row_id", "left_semi"))

    def subset_rows(self, ids: DataFrame) -> MixedMatrix:
        keys = ids.select("row_id").distinct()
        return replace(self, dense=self.dense.join(keys, "row_id", "left_semi"), sparse=self.sparse.join(keys, "row_id", "left_semi"))

    def subset_positions(self, positions: list[int]) -> MixedMatrix:
        """Rows by 0-based position among this matrix's rows in the order of row_id: in a subset, relative to the subset.

        Positions must be ascending and in range.
        """
        n = self.dense.count()
        for i, p in enumerate(positions):
            if not 0 <= p < n:
                raise ValueError(OUT_OF_RANGE.format(p))
            if i and positions[i - 1] > p:
                raise ValueError(UNSORTED.format(i))
        ranked = positioned(self.dense.select("row_id"))
        wanted = self.dense.sparkSession.createDataFrame([(p,) for p in sorted({*positions})], "position bigint")
        return self.subset_rows(ranked.join(wanted, "position", "left_semi"))

    def column(self, name: object) -> DataFrame:
        """(row_id, value) of every row: a dense column, or a sparse one with zeros filled in."""
        if name in self.dense_cols:
            return self.dense.select("row_id", F.coalesce(F.col(name), F.lit(0.0)).alias("value"))
        own = self.sparse.where(F.col("col") == F.lit(name)).select("row_id", "value")
        return self.dense.select("row_id").join(own, "row_id", "left").select("row_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def long(self) -> DataFrame:
        """(row_id, kind, col STRING, value): dense cells and sparse cells in one table; null dense cells are 0."""
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in self.dense_cols]))
        dense = self.dense.select("row_id", cells.alias("x")).select("row_id", F.lit("dense").alias("kind"), F.col("x.col").alias("col"), F.col("x.value").alias("value"))
        sparse = self.sparse.select("row_id", F.lit("sparse").alias("kind"), F.col("col").cast("string").alias("col"), F.col("value").cast("double").alias("value"))
        return dense.unionByName(sparse)

    def column_sums(self) -> DataFrame:
        """(kind, col, total) of the dense columns and of the sparse columns with entries: one pass each, combined on the map side."""
        return self.sums("value").select("kind", "col", "total")

    def dense_sum_squares(self) -> DataFrame:
        """(col, total) of squares of the dense columns."""
        sums = self.dense.agg(*[F.coalesce(F.sum(F.col(c).cast("double") * F.col(c)), F.lit(0.0)).alias(c) for c in self.dense_cols])
        return _unpivot(sums, self.dense_cols)

    def sums(self, what: str = "value") -> DataFrame:
        dense = self.dense.agg(*[F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in self.dense_cols])
        sparse = self.sparse.groupBy(F.col("col").cast("string").alias("col")).agg(F.sum(F.col(what).cast("double")).alias("total"))
        return _unpivot(dense, self.dense_cols).select(F.lit("dense").alias("kind"), "col", "total").unionByName(sparse.select(F.lit("sparse").alias("kind"), "col", "total"))

    # enum-typed access

    def enum_filter(self, member: enum.Enum, test) -> DataFrame:
        return self.row_filter(test(self._features()[member]))

    def enum_subset(self, member: enum.Enum, test) -> MixedMatrix:
        return self.subset(test(self._features()[member]))

    def enum_column(self, member: enum.Enum) -> DataFrame:
        return self.column(self._features().column(member))

    def _features(self) -> FeatureSet:
        if self.features is None:
            raise UnknownFeature("the matrix has no feature set")
        return self.features


def _unpivot(one_row: DataFrame, cols: list[str]) -> DataFrame:
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("total")) for c in cols])).alias("x")).select("x.col", "x.total")


def positioned(keys: DataFrame, key: str = "row_id") -> DataFrame:
    """``keys`` with ``position``: the 0-based rank in ascending order of a BIGINT key, without a sort of everything in one task."""
    return enumerate_ids(keys, key, "position")


@dataclass
class BlockedMatrix:
    """A matrix cut into blocks by a column ``block_id`` of its dense table; row ids are relative to nothing, blocks only group them."""

    matrix: MixedMatrix

    def blocks(self) -> DataFrame:
        """(block_id, n_rows)."""
        return self.matrix.dense.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"))

    def totals(self) -> DataFrame:
        """(block_id, n_rows, and the sum of every dense column): partial results that add up to the whole matrix's."""
        return self.matrix.dense.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.col(c).cast("double")).alias(c) for c in self.matrix.dense_cols])

    def row_filter(self, predicate: Column) -> DataFrame:
        """(block_id, row_id): one list per block, as rows."""
        return self.matrix.dense.where(predicate).select("block_id", "row_id")

    def row_subset(self, rows: DataFrame) -> BlockedMatrix:
        """Rows (block_id, row_id); a row id counts only in its own block."""
        kept = self.matrix.dense.join(rows.select("block_id", "row_id").distinct(), ["block_id", "row_id"], "left_semi")
        return BlockedMatrix(replace(self.matrix, dense=kept, sparse=self.matrix.sparse.join(kept.select("row_id"), "row_id", "left_semi")))

    def each_block(self, run, schema: str) -> DataFrame:
        """``run(block as pandas)`` for every block; a block must fit into a task's memory, as it does when it is a file part."""
        return self.matrix.dense.groupBy("block_id").applyInPandas(run, schema)


def minibatches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with ``batch``: consecutive batches of ``size`` in the order of a distinct BIGINT column, the last one may be short."""
    if size < 1:
        raise ValueError("size must be positive")
    at = positioned(rows.select(order), order).select(order, F.floor(F.col("position") / size).cast("bigint").alias("batch"))
    return rows.join(at, order)


def quantiles(values: DataFrame, col: str, qs: Iterable[float]) -> DataFrame:
    """(q, value): the element at position int(min(q n, n - 1)) of the sorted non-null values, without interpolation.

    Equal values are counted first; positions are found on the running counts of ranges of values, so no task sorts everything.
    No rows for no values.
    """
    wanted = sorted({float(q) for q in qs})
    if any(not 0 <= q <= 1 for q in wanted):
        raise ValueError("quantiles lie between 0 and 1")
    counted = values.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    bounds = counted.agg(F.percentile_approx("x", [i / 256 for i in range(1, 256)], 10_000)).scalar()
    ranged = counted.withColumn("b", bounds).withColumn("r", F.size(F.filter("b", lambda v: v < F.col("x")))).select("x", "n", "r")
    sizes = ranged.groupBy("r").agg(F.sum("n").alias("m"))
    w = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 256 rows
    starts = sizes.select("r", (F.sum("m").over(w) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("all"))
    run = F.sum("n").over(Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.join(F.broadcast(starts), "r").withColumn("last", F.col("before") + run).withColumn("first", F.col("last") - F.col("n"))
    at = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.least(F.lit(q) * F.col("all"), F.col("all") - 1.0)).alias("at")) for q in wanted]))
    return placed.select("x", "first", "last", at.alias("w")).where("w.at >= first and w.at < last").select(F.col("w.q").alias("q"), F.col("x").alias("value"))


def top_k_per_group(rows: DataFrame, group: str, value: str, tie: str, k: int, largest: bool = True) -> DataFrame:
    """The k rows with the largest ``value`` of each group, or the smallest, ties by smaller ``tie``; nulls come last.

    A bounded list per group and task is merged, so a group of any size is never sorted in one task.
    """
    rest = [c for c in rows.columns if c not in (group, value, tie)]
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(64)))
    for keys in ([group, "__s"], [group]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value) if largest else F.asc_nulls_last(value), tie, *rest))
        salted = salted.withColumn("__k", rank).where(F.col("__k") <= k)
    return salted.withColumnRenamed("__k", "rank").drop("__s")
