"""Most frequent items among billions in bounded memory.

The values are combined batch by batch where they are read, so that a value that makes up a third of all rows becomes one row per
batch, and then partitioned by their hash: every value's stream lies in one partition. There a count-min sketch with conservative
update estimates running totals, and a bounded table keeps the candidates with the largest estimates. As the streams are disjoint,
so are the candidates of the partitions, and merging them is a union.

Guarantee: an estimate is never below the true total, and exceeds it by at most e / width of the partition's own total with
probability 1 - exp(-depth) (less with conservative update). A value with at least 1 / ``candidates`` of its partition's total
plus that error is never missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "item string, estimate bigint, error bigint, stream_total bigint"
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


class ConservativeSketch:
    """Count-min rows that are raised only as far as the new estimate of a value asks.

    A batch holds each value once. Estimates are taken from the counters before the batch, then each counter is raised to the
    largest new estimate that falls on it, so no counter ever lies below the total of one of its values.
    """

    def __init__(self, width: int, depth: int):
        if width < 1 or not 1 <= depth <= len(_ODD):
            raise ValueError("width must be positive, depth 1 to 8")
        self.width, self.depth = width, depth
        self.counters = np.zeros((depth, width), np.int64)

    def _cells(self, hashes: np.ndarray, r: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = hashes.view(np.uint64) * _ODD[r]
            h ^= h >> np.uint64(32)
            return (h % np.uint64(self.width)).astype(np.int64)

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The new estimates."""
        cells = [self._cells(hashes, r) for r in range(self.depth)]
        now = np.minimum.reduce([self.counters[r][cells[r]] for r in range(self.depth)]) + counts
        for r in range(self.depth):
            np.maximum.at(self.counters[r], cells[r], now)
        return now

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([self.counters[r][self._cells(hashes, r)] for r in range(self.depth)])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b]).group_by("item").aggregate([("amount", "sum")])
            yield from t.rename_columns(["item", "amount"]).select(["item", "amount"]).to_batches()


def _streams(width: int, depth: int, candidates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kept, total = ConservativeSketch(width, depth), {}, 0
        floor = 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).group_by("item").aggregate([("amount", "sum"), ("h", "min")])
            counts, hashes = t["amount_sum"].to_numpy(), t["h_min"].to_numpy()
            total += int(counts.sum())
            now = sketch.add(hashes, counts)
            good = np.flatnonzero(now > floor)
            names = t["item"].combine_chunks().take(pa.array(good)).to_pylist()
            kept.update(zip(names, zip(now[good].tolist(), hashes[good].tolist())))
            if len(kept) > 2 * candidates:
                best = sorted(kept.items(), key=lambda x: -x[1][0])[:candidates]
                floor = best[-1][1][0]
                kept = dict(best)
        best = sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))[:candidates]
        error = int(np.ceil(np.e / width * total))
        if best or total:
            # a row without an item carries the stream's total, so that an overall total needs no second pass
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"item": [None, *[k for k, _ in best]], "estimate": [0, *[v[0] for _, v in best]], "error": error, "stream_total": [total, *[0] * len(best)]}),
                schema=pa.schema([("item", pa.string()), ("estimate", pa.int64()), ("error", pa.int64()), ("stream_total", pa.int64())]), preserve_index=False,
            )

    return run


def heavy_hitters(rows: DataFrame, item: str, amount: str | None = None, width: int = 1 << 16, depth: int = 4, candidates: int = 2000, streams: int | None = None) -> DataFrame:
    """(item STRING, estimate, error, stream_total): candidates of every stream, and one row without an item per stream with its total.

    Null items, and null, zero and negative amounts don't count; without ``amount`` every row counts 1. Memory of a task is
    width x depth counters and 2 x ``candidates`` values, whatever the input. An empty table gives no rows.
    """
    value = F.lit(1).cast("bigint") if amount is None else F.col(amount).cast("bigint")
    clean = rows.select(F.col(item).cast("string").alias("item"), value.alias("amount")).where("item is not null and amount > 0")
    combined = clean.mapInArrow(_combine, "item string, amount bigint").withColumn("h", F.xxhash64("item"))
    n = streams or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return combined.repartition(n, "item").mapInArrow(_streams(width, depth, candidates), _SCHEMA)


def frequent(rows: DataFrame, item: str, amount: str | None, share: float, **how) -> DataFrame:
    """(item, estimate, error, share) of the items whose estimated total is at least ``share`` of the total of all items."""
    found = heavy_hitters(rows, item, amount, **how)
    total = F.sum("stream_total").over(_everything())
    # the candidates of all streams are a bounded table: streams x candidates rows
    return found.withColumn("total", total).where(F.col("item").isNotNull() & (F.col("estimate") >= share * F.col("total"))).select("item", "estimate", "error", (F.col("estimate") / F.col("total")).alias("share"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
