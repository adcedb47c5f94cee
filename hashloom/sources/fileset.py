"""Directories of part files with dims, sampling by part, and text dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hashloom.operators.dictionary import OR, enumerate_hashes, matching_ids, reverse
from hashloom.operators.matrix import SparseMatrix
from hashloom.operators.skew import sized_join
from hashloom.session import checkpointed
from hashloom.sources import legacy

PARTS = ("vectors.bin.parts", "dictionary.txt.parts", "dims.txt.parts")


def part_paths(root: str, part: int) -> dict[str, str]:
    """Where the vectors, dictionary and dims of one part lie."""
    return {p.split(".")[0]: f"{root}/{p}/part-{part:05d}" for p in PARTS}


def partition_dims(vectors: DataFrame, part: str = "part") -> DataFrame:
    """(part, n_rows, nnz) of packed vectors (part, col_ids)."""
    return vectors.groupBy(part).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.size("col_ids").cast("bigint")), F.lit(0)).cast("bigint").alias("nnz"))


def first_parts(vectors: DataFrame, n: int, part: str = "part") -> DataFrame:
    """The rows of parts 0 to n - 1: a partition filter where ``part`` is a partition column."""
    return vectors.where(F.col(part) < n)


def parts_within(dims: DataFrame, max_bytes: int, already: int = 0, part: str = "part") -> DataFrame:
    """(part, n_rows, nnz): whole parts in order while (nnz + n_rows) x 4 bytes, on top of ``already``, stay below the budget (strictly).

    The window runs over one row per part.
    """
    size = (F.col("nnz") + F.col("n_rows")) * 4
    upto = F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dims.withColumn("__upto", upto + F.lit(already)).where(F.col("__upto") < max_bytes).drop("__upto")


def dictionary_bytes(names: DataFrame, name: str = "name") -> DataFrame:
    """(bytes): 2 per character and 16 per name."""
    return names.agg((F.coalesce(F.sum(F.length(name)), F.lit(0)) * 2 + F.count(F.lit(1)) * 16).alias("bytes"))


def counts_of(dims: DataFrame, n_cols: int | None = None) -> DataFrame:
    """One row (n_rows, nnz [, n_cols]) of a sampled set."""
    out = dims.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce(F.sum("nnz"), F.lit(0)).cast("bigint").alias("nnz"))
    return out if n_cols is None else out.withColumn("n_cols", F.lit(n_cols).cast("bigint"))


def load_limited(spark: SparkSession, path: str, max_bytes: int = 2_000_000_000) -> SparseMatrix:
    """A saved matrix as far as the budget goes: the dictionary first, then whole parts in order. Only the parts that fit are read.

    Rows and cells of what was read must be those the partition dims name, else ValueError.
    """
    names = spark.read.parquet(f"{path}/dictionary")
    base = dictionary_bytes(names.select(F.explode("names").alias("name"))).first()["bytes"]
    kept = parts_within(spark.read.parquet(f"{path}/partition_dims"), max_bytes, base).collect()  # one row per part
    vectors = spark.read.parquet(f"{path}/vectors").where(F.col("part").isin([r["part"] for r in kept]) if kept else F.lit(False))
    want = (sum(r["n_rows"] for r in kept), sum(r["nnz"] for r in kept))
    got = tuple(vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("col_ids").cast("bigint")), F.lit(0))).first())
    if got != want:
        raise ValueError(f"read {got} rows and cells, {want} expected")
    cells = vectors.select("row_id", F.explode(F.arrays_zip("col_ids", "vals")).alias("x")).select("row_id", F.col("x.col_ids").alias("col_id"), F.col("x.vals").alias("value"))
    return SparseMatrix(cells, vectors.select("row_id"), names)


# conversion of whole sets of vectors


def converted(vectors: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of hashes (part, row_id, hashes) with the dense ids of ``ids`` (hash, col_id): (part, row_id, col_ids), and dims by part.

    Hashes without an id are dropped, repeated ones count once, null entries never; rows left empty stay rows. dims has (part, n_rows,
    n_cols, nnz), n_cols being all of ``ids``. The vectors are written to the shared folder, as both results are made of them.
    """
    cells = vectors.select("part", "row_id", F.explode(F.array_distinct(F.array_compact("hashes"))).alias("hash"))
    met = sized_join(cells, ids.select("hash", "col_id"), "hash").groupBy("part", "row_id").agg(F.sort_array(F.collect_set("col_id")).alias("c"))
    none = F.array().cast("array<bigint>")
    out = checkpointed(vectors.select("part", "row_id").distinct().join(met, ["part", "row_id"], "left").select("part", "row_id", F.coalesce(F.col("c").cast("array<bigint>"), none).alias("col_ids")))
    n_cols = ids.agg(F.count(F.lit(1))).scalar()
    return out, partition_dims(out).select("part", "n_rows", n_cols.alias("n_cols"), "nnz")


def kept_ids(vectors: DataFrame, min_fraction: float, mapping: DataFrame | None = None, predicate: Column | None = None) -> DataFrame:
    """(hash, col_id): hashes in more than a fraction of all rows, and those of ``mapping`` (feature, hash) that satisfy the predicate."""
    rows = vectors.agg(F.count_distinct("part", "row_id")).scalar()
    cells = vectors.select(F.explode(F.array_distinct(F.array_compact("hashes"))).alias("hash"))
    often = cells.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.lit(min_fraction) * rows).select("hash")
    if mapping is not None and predicate is not None:
        often = matching_ids(mapping, predicate, often)
    return enumerate_hashes(often)


def remapped_dictionary(mapping: DataFrame, ids: DataFrame) -> DataFrame:
    """(col_id, name) of every id of ``ids`` (hash, col_id): the joined names of ``mapping`` (feature, hash), null where it has none."""
    return ids.join(reverse(mapping), "hash", "left").select("col_id", F.when(F.col("names").isNotNull(), F.concat_ws(OR, "names")).alias("name"))


@dataclass(frozen=True)
class FileSet:
    """Parts of vectors, dictionaries and dims below a folder, and the merged files beside them."""

    root: str

    @property
    def merged_dictionary(self) -> str:
        return f"{self.root}/mergedDictionary.txt"

    @property
    def merged_dims(self) -> str:
        return f"{self.root}/mergedDims.txt"

    def part(self, number: int) -> dict[str, str]:
        return part_paths(self.root, number)

    def numbers(self, spark: SparkSession) -> list[int]:
        """The numbers of the vector parts there are; a missing folder has none."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{PARTS[0]}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[5:]) for n in names if n.startswith("part-") and n[5:].isdigit())

    def vectors(self, spark: SparkSession, wide: bool = True, first: int | None = None) -> DataFrame:
        """(part, position, col_ids) of all parts, or of those numbered below ``first``."""
        rows = legacy.read_vectors(spark, f"{self.root}/{PARTS[0]}", wide)
        return rows if first is None else rows.where(F.col("part") < first)


# dims as text


def write_dims(dims: DataFrame, parts: DataFrame, path: str) -> None:
    """Three totals (rows, columns, cells), and for each part its number, rows and cells, every group ended by an empty line."""
    total, rows = dims.select("n_rows", "n_cols", "nnz").first(), parts.select("part", "n_rows", "nnz").orderBy("part").collect()  # one row per part
    groups = [total, *rows]
    text = "\n".join("\n".join(map(str, g)) + "\n" for g in groups)
    dims.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_dims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(dims, partition dims) of ``write_dims``; broken groups are an error."""
    groups = [[int(x) for x in g.split("\n")] for g in spark.read.text(path, wholetext=True).first()["value"].strip().split("\n\n")]
    if any(len(g) != 3 for g in groups):
        raise ValueError("dims must be groups of three numbers")
    parts = spark.createDataFrame([tuple(g) for g in groups[1:]], "part int, n_rows bigint, nnz bigint")
    return spark.createDataFrame([tuple(groups[0])], "n_rows bigint, n_cols bigint, nnz bigint"), parts


# dictionaries as text


def write_dictionary(mapping: DataFrame, path: str) -> None:
    """name TAB code, one per line."""
    mapping.select(F.concat_ws("\t", "feature", F.col("hash").cast("string"))).write.mode("overwrite").text(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(feature, hash): split at the last tab, since names may have tabs; lines without a code are left out."""
    line = F.col("value")
    parsed = spark.read.text(path).select(F.regexp_extract(line, r"^(.*)\t(-?\d+)$", 1).alias("feature"), F.regexp_extract(line, r"^(.*)\t(-?\d+)$", 2).alias("h"))
    return parsed.where("h <> ''").select("feature", F.col("h").cast("bigint").alias("hash"))


def write_enumeration(dictionary: DataFrame, path: str) -> None:
    """Line i has the names of column i, joined."""
    rows = dictionary.select("col_id", F.concat_ws(OR, "names").alias("value"))
    rows.repartitionByRange("col_id").sortWithinPartitions("col_id").select("value").write.mode("overwrite").text(path)


def write_code_lookup(dictionary: DataFrame, path: str) -> None:
    """index TAB name in the order of the index."""
    rows = dictionary.select("col_id", F.concat_ws("\t", F.col("col_id").cast("string"), F.concat_ws(OR, "names")).alias("value"))
    rows.repartitionByRange("col_id").sortWithinPartitions("col_id").select("value").write.mode("overwrite").text(path)


def read_code_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(col_id, name); the indexes must be 0 to n - 1, each once."""
    x = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).select(F.col("p")[0].cast("bigint").alias("col_id"), F.col("p")[1].alias("name"))
    n, least, most, distinct = x.agg(F.count(F.lit(1)), F.min("col_id"), F.max("col_id"), F.count_distinct("col_id")).first()
    if n and (least != 0 or most != n - 1 or distinct != n):
        raise ValueError("code lookup isn't dense")
    return x


def write_counts(matrix: SparseMatrix, path: str) -> None:
    matrix.dims().coalesce(1).write.mode("overwrite").json(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n_rows bigint, n_cols bigint, nnz bigint").json(path)
