"""Per-key work on keys of very uneven size: fragment-replicate by estimated load.

``plan_shards`` counts the rows of every key once (map-side combined, key column only) and keeps a summary of bounded size:
the keys that would fill more than a fraction of one task, and the load of ``buckets`` hash buckets of all the others. Both are
bin-packed to tasks, largest first. A heavy key is cut into as many shards as its load needs; a light key has one shard, 0.

* ``balanced_aggregate`` combines batch by batch where rows are read, moves what is left of every shard to its packed task, sums it up
  there and then merges the few shards of the heavy keys.
* ``balanced_join`` cuts the rows of heavy keys of the large side into shards and replicates the matching rows to those shards only.
* ``balanced_apply`` moves every shard to its packed task and runs a function on sorted (key, shard) runs.
* ``sized_join`` broadcasts the other side if its counted size allows it, and is a ``balanced_join`` otherwise.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hashloom.session import checkpointed

SHARD, TASK, HEAVY = "__shard", "__task", "__heavy"
#: Bytes that the other side of a join may have to be sent to every executor.
BROADCAST_BYTES = 64_000_000


@dataclass
class ShardPlan:
    """heavy: (key, load, tasks of its shards), at most ``tasks / heavy_share`` keys; bucket_tasks: task of each hash bucket of light keys."""

    key_type: T.DataType
    tasks: int
    total: int
    heavy: list[tuple[object, int, list[int]]] = field(default_factory=list)
    bucket_tasks: list[int] = field(default_factory=list)
    bucket_loads: list[int] = field(default_factory=list)

    def heavy_frame(self, spark: SparkSession) -> DataFrame:
        """(__key, __tasks): bounded by construction, hence safe to broadcast."""
        schema = T.StructType([T.StructField("__key", self.key_type), T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
        return spark.createDataFrame([(k, tasks) for k, _, tasks in self.heavy], schema)

    def loads(self) -> list[int]:
        """Planned rows of each task."""
        out = [0] * self.tasks
        for _, load, tasks in self.heavy:
            for t in tasks:
                out[t] += load // len(tasks)
        for t, load in zip(self.bucket_tasks, self.bucket_loads):
            out[t] += load
        return out


def pack(loads: Iterable[tuple[object, int]], tasks: int, begin: list[int] | None = None) -> dict:
    """Largest load first, each to the task with the least so far: {item: task}."""
    heap = [(begin[t] if begin else 0, t) for t in range(tasks)]
    heapq.heapify(heap)
    out = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        least, t = heapq.heappop(heap)
        out[item] = t
        heapq.heappush(heap, (least + load, t))
    return out


def plan_shards(df: DataFrame, key: str, tasks: int | None = None, heavy_share: float = 0.25, buckets: int = 1024) -> ShardPlan:
    """``plan_from_loads`` with the rows of every key of ``df`` as loads, counted on the key column alone."""
    keys = df.select(F.col(f"`{key}`").alias("__key"))
    return plan_from_loads(keys.groupBy("__key").agg(F.count(F.lit(1)).alias("n")), "__key", "n", tasks, heavy_share, buckets)


def plan_from_loads(loads: DataFrame, key: str, load: str, tasks: int | None = None, heavy_share: float = 0.25, buckets: int = 1024) -> ShardPlan:
    """Bin-pack keys with known or estimated loads (one row per key) to ``tasks`` (default: spark.sql.shuffle.partitions).

    A key with at least ``heavy_share`` of one task's fair load counts as heavy, so there are at most tasks / heavy_share of
    them. Null keys count as a key of their own. What reaches the driver is at most ``buckets`` + tasks / heavy_share rows.
    An empty table gives a plan without heavy keys.
    """
    spark = loads.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_key = loads.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{load}`").alias("n"))
    ranked = per_key.withColumn("__total", per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).scalar())
    heavy_key = F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("__total") / tasks * heavy_share))
    summary = (
        ranked.groupBy(
            heavy_key.alias("heavy"),
            F.when(heavy_key, F.col("__key")).alias("__key"),
            F.when(~heavy_key, F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")).alias("bucket"),
        )
        .agg(F.sum("n").alias("n"), F.max("__total").alias("total"))
        .collect()
    )
    total = summary[0]["total"] if summary else 0
    capacity = max(1, math.ceil(total / tasks))
    items: list[tuple[object, int]] = []
    light: dict[int, int] = {}
    big: dict[object, tuple[int, int]] = {}
    for r in summary:
        if r["heavy"]:
            parts = max(1, min(tasks, math.ceil(r["n"] / capacity * 2)))
            big[r["__key"]] = (r["n"], parts)
            items += [(("h", r["__key"], i), r["n"] // parts) for i in range(parts)]
        else:
            items.append((("b", r["bucket"]), r["n"]))
            light[r["bucket"]] = r["n"]
    at = pack(items, tasks)
    return ShardPlan(
        loads.schema[key].dataType, tasks, total,
        [(k, n, [at[("h", k, i)] for i in range(parts)]) for k, (n, parts) in sorted(big.items(), key=lambda x: (-x[1][0], str(x[0])))],
        [at.get(("b", b), b % tasks) for b in range(buckets)], [light.get(b, 0) for b in range(buckets)],
    )


def route(df: DataFrame, key: str, plan: ShardPlan, spread: list[str] | None = None) -> DataFrame:
    """``df`` with __shard, __task and __heavy. Rows of a heavy key go to a shard by the hash of ``spread`` (default: all columns).

    The shard depends on the row's content alone, so that a task that runs again after an executor is lost sends every row where
    it went before. Name a row identifier in ``spread`` where whole rows repeat very often.
    """
    heavy = F.broadcast(plan.heavy_frame(df.sparkSession))
    by = [F.col(f"`{c}`") for c in spread or df.columns]
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(len(plan.bucket_tasks))).cast("int")
    packed = F.expr(f"array({','.join(map(str, plan.bucket_tasks))})")
    joined = df.join(heavy, F.col(f"`{key}`").eqNullSafe(F.col("__key")), "left").withColumn(
        SHARD, F.when(F.col("__tasks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*by), F.size("__tasks")).cast("int"))
    )
    task = F.when(F.col("__tasks").isNull(), F.get(packed, bucket)).otherwise(F.get(F.col("__tasks"), F.col(SHARD)))
    return joined.withColumns({TASK: task, HEAVY: F.col("__tasks").isNotNull()}).drop("__key", "__tasks")


def combined(df: DataFrame, key: str, sums: list[str]) -> DataFrame:
    """(key, sums) with one row per key and Arrow batch: what a map task can put together without moving anything."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b]).group_by(key, use_threads=False).aggregate([(c, "sum") for c in sums]).select([key, *(f"{c}_sum" for c in sums)])
                yield from t.rename_columns(b.schema.names).cast(b.schema).combine_chunks().to_batches()

    return df.select(key, *sums).mapInArrow(run, schema)


def placed(df: DataFrame, key: str, plan: ShardPlan, spread: list[str] | None = None) -> DataFrame:
    """``route`` with every row moved to the task the plan has for it."""
    routed = route(df, key, plan, spread)
    return routed.repartitionById(plan.tasks, F.col(TASK)) if hasattr(routed, "repartitionById") else routed.repartitionByRange(plan.tasks, TASK)


def balanced_aggregate(df: DataFrame, key: str, sums: list[str], plan: ShardPlan | None = None) -> DataFrame:
    """(key, sums): one row per key with the sums of the columns ``sums``; a count is a sum of ones.

    Rows are combined by batch before they move; each shard of what is left goes to its packed task, so a key of any size arrives as
    its shards, spread by load. Only heavy keys have several shards, which are merged at the end: at most tasks / heavy_share keys.
    The combined rows are written to the shared folder, as the plan counts them first. Null keys form one group, an empty table
    gives no rows; columns that aren't summed are left out.
    """
    part = checkpointed(combined(df, key, sums))
    plan = plan or plan_shards(part, key)
    # the exchange by task already brings equal (task, key, shard) together: this adds none
    shards = placed(part, key, plan).groupBy(TASK, key, SHARD, HEAVY).agg(*[F.sum(c).alias(c) for c in sums])
    merged = shards.where(F.col(HEAVY)).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    return shards.where(~F.col(HEAVY)).select(key, *sums).unionByName(merged)


def balanced_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", plan: ShardPlan | None = None, spread: list[str] | None = None) -> DataFrame:
    """Join on ``key`` where ``left`` has heavy keys: its shards meet copies of the matching ``right`` rows.

    Right rows of a light key are not copied. ``how`` is inner, left, left_semi or left_anti: with these a left row meets all its
    partners within its shard, so replication changes nothing. Null keys match nothing. Other columns of both sides must differ in
    name; rename before the call.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"balanced_join can't do {how}")
    clash = set(left.columns) & set(right.columns) - {key}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    plan = plan or plan_shards(left, key)
    many = F.broadcast(plan.heavy_frame(left.sparkSession).select("__key", F.size("__tasks").alias("__n")))
    copies = right.join(many, F.col(f"`{key}`") == F.col("__key"), "left").withColumn(
        SHARD, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__n"), F.lit(1)) - 1))
    )
    return route(left, key, plan, spread).drop(TASK, HEAVY).join(copies.drop("__key", "__n"), [key, SHARD], how).drop(SHARD)


def balanced_apply(df: DataFrame, key: str, run: Callable, schema: str, order: list[str] | None = None, plan: ShardPlan | None = None, spread: list[str] | None = None) -> DataFrame:
    """``run(batches)`` over every task's rows, sorted by key, shard and ``order``; each shard lies wholly in its packed task.

    ``run`` gets an iterator of Arrow record batches (a run of equal keys may continue in the next batch) and yields record
    batches of ``schema``. The caller merges the shards of heavy keys.
    """
    plan = plan or plan_shards(df, key)
    return placed(df, key, plan, spread).drop(HEAVY).sortWithinPartitions(key, SHARD, *(order or [])).mapInArrow(run, schema)


def size_in_bytes(df: DataFrame) -> int:
    """Counted, not estimated: 16 bytes per row and value, and the bytes of strings."""
    text = [F.coalesce(F.sum(F.octet_length(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    arrays = [F.coalesce(F.sum(F.size(f.name)), F.lit(0)) * 32 for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    r = df.agg(sum([F.count(F.lit(1)) * 16 * len(df.columns), *text, *arrays], F.lit(0)).alias("n")).first()
    return int(r["n"])


def sized_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", loads: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Join of a large ``left`` with a ``right`` that is small or not: broadcast up to ``most`` bytes, else ``balanced_join``.

    ``right`` is counted first, so it should be cheap to compute or written. ``loads`` (key, n) saves the pass over ``left`` that
    counts its keys. Null keys match nothing.
    """
    if size_in_bytes(right) <= most:
        return left.join(F.broadcast(right), key, how)
    return balanced_join(left, right, key, how, plan_from_loads(loads, key, "n") if loads is not None else None)
