"""Frequency of every distinct value or term: range-partitioned external sort and run-length scan.

(item, record) pairs are range-partitioned by both columns and sorted, spilling to disk where a partition is large. A range may
cut the run of a frequent item anywhere between two records, so an item of any frequency is spread over as many tasks as its share
of the rows. Equal pairs always fall into the same range; a scan therefore counts rows and distinct records of every run, and the
parts of an item that lie in different ranges (or Arrow batches) add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _differs(a: pa.Array) -> np.ndarray:
    """True where a value isn't that of the row before; the first row counts as different."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    out = np.ones(len(a), bool)
    if len(a) > 1:
        out[1:] = pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        item, rec = b.column("item"), b.column("rec")
        new_item = _differs(item)
        new_rec = new_item | _differs(rec)
        if last is not None and item[0].as_py() == last[0] and rec[0].as_py() == last[1]:
            new_rec[0] = False  # the record was counted at the end of the batch before
        at = np.flatnonzero(new_item)
        rows = np.diff(np.append(at, b.num_rows))
        records = np.add.reduceat(new_rec.astype(np.int64), at)
        last = (item[-1].as_py(), rec[-1].as_py())
        yield pa.RecordBatch.from_arrays([item.take(pa.array(at)), pa.array(rows.astype(np.int64)), pa.array(records)], names=["item", "rows", "records"])


def term_frequencies(pairs: DataFrame, item: str, record: str, partitions: int | None = None) -> DataFrame:
    """(item, total, records): how often every item occurs and in how many records.

    ``pairs`` has one row per occurrence. Items may be of any type that can be ordered; records are BIGINT. Null items and null
    records don't count. An empty table gives no rows.
    """
    n = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = pairs.select(F.col(item).alias("item"), F.col(record).cast("bigint").alias("rec")).where("item is not null and rec is not null")
    kind = clean.schema["item"].dataType.simpleString()
    scanned = clean.repartitionByRange(n, "item", "rec").sortWithinPartitions("item", "rec").mapInArrow(_runs, f"item {kind}, rows bigint, records bigint")
    return scanned.groupBy("item").agg(F.sum("rows").alias("total"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, totals: DataFrame, rare_below: int, common_share: float) -> DataFrame:
    """``frequencies`` with a column mark: rare (in fewer than ``rare_below`` records), common (in more than a share of all) or null.

    ``totals`` is one row with n, the number of all records. An item that is both is marked rare.
    """
    n = totals.select("n").scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_share) * n, "common")
    return frequencies.withColumn("mark", mark)
