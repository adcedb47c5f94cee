"""Big-endian binary part files of vectors and mixed matrices, read and written in parallel.

Layouts: a vector is an int32 length and then its ids (int32 or int64); a count vector has ids and float32 counts alternating after
the length; a mixed matrix has five int32 (rows, columns, dense columns, sparse columns, cells), the dense float32 block by rows,
row starts, ids and float32 values of the cells.
"""

from __future__ import annotations

import io
import os
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_INT, _FLOAT = np.dtype(">i4"), np.dtype(">f4")
#: Bytes that a section of a mixed matrix has in memory before it goes to a temporary file, and that are copied at a time.
SPOOL = 4_000_000
#: Values of a mixed matrix that are read at a time; rows are never cut.
STRETCH = 250_000


def encode_vectors(arrays: Iterator[np.ndarray], wide: bool = False) -> bytes:
    kind = np.dtype(">i8") if wide else _INT
    out = bytearray()
    for a in arrays:
        a = np.asarray(a)
        out += np.array([len(a)], _INT).tobytes() + a.astype(kind).tobytes()
    return bytes(out)


def decode_vectors(data: bytes, wide: bool = False) -> list[np.ndarray]:
    kind, at, out = (np.dtype(">i8") if wide else _INT), 0, []
    while at < len(data):
        n = int(np.frombuffer(data, _INT, 1, at)[0])
        if n < 0 or at + 4 + n * kind.itemsize > len(data):
            raise ValueError(f"broken vector at byte {at}")
        out.append(np.frombuffer(data, kind, n, at + 4).astype(np.int64))
        at += 4 + n * kind.itemsize
    return out


def encode_counts(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    pair = np.dtype([("i", ">i4"), ("c", ">f4")])
    out = bytearray()
    for ids, counts in rows:
        cells = np.empty(len(ids), pair)
        cells["i"], cells["c"] = ids, counts
        out += np.array([len(ids)], _INT).tobytes() + cells.tobytes()
    return bytes(out)


def decode_counts(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    pair, at, out = np.dtype([("i", ">i4"), ("c", ">f4")]), 0, []
    while at < len(data):
        n = int(np.frombuffer(data, _INT, 1, at)[0])
        cells = np.frombuffer(data, pair, n, at + 4)
        out.append((cells["i"].astype(np.int64), cells["c"].astype(np.float64)))
        at += 4 + 8 * n
    return out


def encode_mixed(dense: np.ndarray, row_starts: np.ndarray, ids: np.ndarray, values: np.ndarray, n_sparse: int) -> bytes:
    """Only the rows there are get written, whatever the capacity of the arrays."""
    rows, n_dense = dense.shape
    nnz = int(row_starts[rows]) if rows else 0
    head = np.array([rows, n_dense + n_sparse, n_dense, n_sparse, nnz], _INT)
    return b"".join([head.tobytes(), dense.astype(">f4").tobytes(), row_starts[: rows + 1].astype(_INT).tobytes(), ids[:nnz].astype(_INT).tobytes(), values[:nnz].astype(">f4").tobytes()])


def decode_mixed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    rows, _, n_dense, n_sparse, nnz = np.frombuffer(data, _INT, 5).tolist()
    at = 20
    dense = np.frombuffer(data, ">f4", rows * n_dense, at).reshape(rows, n_dense).astype(np.float64)
    at += 4 * rows * n_dense
    starts = np.frombuffer(data, _INT, rows + 1, at).astype(np.int64)
    at += 4 * (rows + 1)
    ids = np.frombuffer(data, _INT, nnz, at).astype(np.int64)
    values = np.frombuffer(data, ">f4", nnz, at + 4 * nnz).astype(np.float64)
    return dense, starts, ids, values, n_sparse


def local_path(folder: str) -> str:
    """The folder as Python's own file functions know it. Part files are written by Python, so it must be mounted on every executor."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"binary part files need a mounted folder, not {folder}")
    return folder


def _write_parts(rows: DataFrame, folder: str, encode: Callable[[Iterator], Iterator[bytes]], arrow: bool = False) -> None:
    """One file per partition, under a name of its attempt and then renamed, so that a task that runs again replaces its own part only.

    ``encode`` gets the partition's batches as pandas, or with ``arrow`` as they come.
    """
    target = local_path(folder)
    os.makedirs(target, exist_ok=True)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, tmp, n = task.partitionId(), f"{target}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        with open(tmp, "wb") as f:
            for data in encode(batches):
                n += f.write(data)
        os.replace(tmp, f"{target}/part-{part:05d}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "bytes"]) if arrow else pd.DataFrame({"part": [part], "bytes": [n]})

    (rows.mapInArrow if arrow else rows.mapInPandas)(run, "part int, bytes bigint").collect()  # one row per part


def write_vectors(vectors: DataFrame, folder: str, wide: bool = False, counts: bool = False) -> None:
    """Packed vectors (row_id, col_ids [, vals]) as one binary part file per partition below ``folder``."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[bytes]:
        for pdf in batches:
            yield encode_counts(zip(pdf["col_ids"], pdf["vals"])) if counts else encode_vectors(iter(pdf["col_ids"]), wide)

    _write_parts(vectors.select("col_ids", *(["vals"] if counts else [])), folder, encode)


def read_vectors(spark: SparkSession, folder: str, wide: bool = False, counts: bool = False) -> DataFrame:
    """(part, position, col_ids [, vals]) of a folder, or of one part file; files are read whole and never split, a broken one is an error."""

    def rows(part: int, data: bytes) -> pd.DataFrame:
        if counts:
            got = decode_counts(data)
            return pd.DataFrame({"part": part, "position": range(len(got)), "col_ids": [r[0] for r in got], "vals": [r[1] for r in got]})
        return pd.DataFrame({"part": part, "position": range(len(got := decode_vectors(data, wide))), "col_ids": got})

    return _read_parts(spark, folder, rows, "part int, position bigint, col_ids array<bigint>" + (", vals array<double>" if counts else ""))


def _read_parts(spark: SparkSession, folder: str, decode: Callable[[int, bytes], pd.DataFrame], schema: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(F.regexp_extract("path", r"part-(\d+)$", 1).cast("int").alias("part"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from (decode(part, data) for part, data in zip(pdf["part"], pdf["content"]))

    return raw.mapInPandas(run, schema)


def write_mixed(rows: DataFrame, folder: str, n_dense: int, n_sparse: int) -> None:
    """Mixed rows (dense ARRAY<DOUBLE>, col_ids, vals) as one matrix file per partition; row ids aren't written, null arrays count as empty.

    The layout has the dense block before the cells, so the four sections are gathered in temporary files: a partition may be larger than
    memory. Null numbers are written as NaN, cells without an id not at all. Row starts are int32: a part with more cells is refused.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        n = nnz = 0
        sections = [tempfile.SpooledTemporaryFile(SPOOL) for _ in range(4)]
        sections[1].write(np.zeros(1, _INT).tobytes())
        for b in batches:
            (dense, width), (ids, held), (vals, valued) = (_flat(b.column(c)) for c in ("dense", "col_ids", "vals"))
            if (width != n_dense).any() or (held != valued).any():
                raise ValueError(f"rows must have {n_dense} dense values, and as many values as ids")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ends = nnz + np.cumsum(np.bincount(np.repeat(np.arange(len(b)), held)[known], minlength=len(b)))
            n, nnz = n + len(b), int(ends[-1]) if len(b) else nnz
            if max(n, nnz) > np.iinfo(np.int32).max:
                raise OverflowError(f"{n} rows and {nnz} cells are too many for one matrix file")
            for f, x, kind in zip(sections, (_floats(dense), ends, ids.drop_null().to_numpy(), _floats(vals)[known]), (_FLOAT, _INT, _INT, _FLOAT)):
                f.write(x.astype(kind).tobytes())
        yield np.array([n, n_dense + n_sparse, n_dense, n_sparse, nnz], _INT).tobytes()
        for f in sections:
            f.seek(0)
            yield from iter(lambda: f.read(SPOOL), b"")  # noqa: B023
            f.close()

    cells = [F.col("dense").cast("array<double>"), F.col("col_ids").cast("array<bigint>"), F.col("vals").cast("array<double>")]
    _write_parts(rows.select(*[c.alias(n) for c, n in zip(cells, ("dense", "col_ids", "vals"))]), folder, encode, arrow=True)


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements, and how many each list has."""
    return lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _floats(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, np.nan).to_numpy(zero_copy_only=False)


def read_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """(part, position, dense, col_ids, vals) of the matrix files of a folder, or of one file; a broken one is an error.

    Mounted files are read a stretch of rows at a time, so a file may be larger than memory; those of other file systems come whole.
    """
    jvm = spark.sparkContext._jvm
    mounted = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    raw = files.select(F.regexp_extract("path", r"part-(\d+)$", 1).cast("int").alias("part"), "path" if mounted else "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1)):
                with open(local_path(x.as_py()), "rb") if mounted else io.BytesIO(x.as_py()) as f:
                    yield from _stretches(part, f)

    return raw.mapInArrow(run, "part int, position bigint, dense array<double>, col_ids array<bigint>, vals array<double>")


def _stretches(part: int, f: BinaryIO) -> Iterator[pa.RecordBatch]:
    """The rows of one matrix file; one without rows gives none."""

    def read(at: int, n: int, kind: np.dtype) -> np.ndarray:
        f.seek(at)
        if n < 0 or len(data := f.read(4 * n)) < 4 * n:
            raise ValueError(f"broken matrix in part {part} at byte {at}")
        return np.frombuffer(data, kind)

    def lists(x: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(kind.to_pandas_dtype()), kind))

    rows, _, n_dense, _, nnz = read(0, 5, _INT).tolist()
    starts_at = 20 + 4 * rows * n_dense
    ids_at = starts_at + 4 * (rows + 1)
    if min(rows, n_dense, nnz) < 0 or f.seek(0, os.SEEK_END) < ids_at + 8 * nnz:
        raise ValueError(f"broken matrix in part {part}")
    at = 0
    while at < rows:
        starts = read(starts_at + 4 * at, min(rows - at, max(1, STRETCH // (n_dense + 1))) + 1, _INT).astype(np.int64)
        if starts[0] < 0 or starts[-1] > nnz or (np.diff(starts) < 0).any():
            raise ValueError(f"broken row starts in part {part}")
        n = max(1, int(np.searchsorted(starts, starts[0] + STRETCH, "right")) - 1)
        starts = starts[: n + 1]
        first, cells = int(starts[0]), int(starts[n] - starts[0])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n), pa.int64()),
                lists(read(20 + 4 * at * n_dense, n * n_dense, _FLOAT), np.arange(n + 1) * n_dense, pa.float64()),
                lists(read(ids_at + 4 * first, cells, _INT), starts - first, pa.int64()),
                lists(read(ids_at + 4 * (nnz + first), cells, _FLOAT), starts - first, pa.float64()),
            ],
            names=["part", "position", "dense", "col_ids", "vals"],
        )
        at += n
