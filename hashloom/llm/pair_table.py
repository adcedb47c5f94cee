"""Items that appear together: a persistent pair table that is kept up to date by signed deltas.

A basket that is new gives +1 for each of its pairs and items, one that went gives -1, one that changed gives both. Deltas are
combined before they move and merged into counts stored by hash bucket; only buckets with a delta are written again. A small
manifest names the version of each bucket. Association scores are computed from the stored counts, for all pairs or for those whose
own count or margins the last change touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.operators.skew import sized_join
from hashloom.session import checkpointed

_PAIRS = "a bigint, b bigint, n bigint"
_ITEMS = "item bigint, n bigint"
_MANIFEST = "step int, buckets int, at map<int,string>, items_at string, baskets bigint, n_pairs bigint, loads array<string>"
#: Pairs a bucket is meant to hold, and how many times as many it may before the table is written in more buckets.
BUCKET_ROWS, GROWN = 1_000_000, 4


def buckets_for(rows: int) -> int:
    """At least 16, else the power of two that gives a bucket at most BUCKET_ROWS."""
    return 1 << max(4, (max(1, rows) // BUCKET_ROWS).bit_length())


def basket_items(baskets: DataFrame, items: str) -> DataFrame:
    """(items ARRAY<BIGINT>, sign): distinct, non-null, sorted; rows of a null basket hold an empty array."""
    clean = F.sort_array(F.array_distinct(F.array_compact(F.coalesce(F.col(items).cast("array<bigint>"), F.array().cast("array<bigint>")))))
    return baskets.select(clean.alias("items"), F.col("sign"))


def pair_deltas(signed: DataFrame) -> DataFrame:
    """(a, b, n): signed pair counts, a < b.

    A basket is unfolded item by item, each with the items after it, so that no row ever holds all pairs of a long basket.
    """
    first = signed.where("size(items) > 1").select("sign", "items", F.posexplode("items").alias("i", "a"))
    rest = first.select("sign", "a", F.explode(F.slice("items", F.col("i") + 2, F.greatest(F.size("items") - F.col("i") - 1, F.lit(0)))).alias("b"))
    return rest.groupBy("a", "b").agg(F.sum("sign").alias("n")).where("n <> 0")


def item_deltas(signed: DataFrame) -> DataFrame:
    """(item, n): signed numbers of baskets with the item."""
    return signed.select("sign", F.explode("items").alias("item")).groupBy("item").agg(F.sum("sign").alias("n")).where("n <> 0")


def basket_changes(before: DataFrame, after: DataFrame, basket: str, items: str) -> DataFrame:
    """(items, sign): what turns ``before`` into ``after``; baskets with the same items give nothing. Basket ids must be unique."""
    old = before.select(F.col(basket).alias("k"), F.col(items).alias("old"), F.lit(1).alias("was"))
    new = after.select(F.col(basket).alias("k"), F.col(items).alias("new"), F.lit(1).alias("is"))
    both = old.join(new, "k", "full")
    gone = both.where("was = 1 and not (is <=> 1 and old <=> new)").select(F.col("old").alias(items), F.lit(-1).cast("bigint").alias("sign"))
    come = both.where("is = 1 and not (was <=> 1 and old <=> new)").select(F.col("new").alias(items), F.lit(1).cast("bigint").alias("sign"))
    return gone.unionByName(come)


class PairTable:
    """Pair counts, item counts and the number of baskets below ``path`` (a folder that all executors share).

    The number of buckets is a power of two that follows the number of pairs: about ``BUCKET_ROWS`` to a bucket, and all are written
    anew in more buckets when they hold ``GROWN`` times as many. A bucket is one sorted file. Each load writes a folder of its own
    and then one manifest row that makes it count, so a load that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.at: dict[int, str] = {}  # bucket -> folder; at most ``buckets`` entries
        self.items_at: str | None = None
        self.baskets = self.rows = self._step = 0
        self.loads: list[str] = []
        self._touched_items: DataFrame | None = None
        self._touched_pairs: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PairTable:
        """The table as its newest manifest row describes it."""
        m = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("step")).first()
        t = cls(spark, path, m["buckets"])
        t.at, t.items_at, t.baskets, t.rows, t._step, t.loads = dict(m["at"]), m["items_at"], m["baskets"], m["n_pairs"], m["step"], list(m["loads"])
        return t

    def _bucket(self):
        return F.pmod(F.xxhash64("a", "b"), F.lit(self.buckets)).cast("int")

    def _write(self, pairs: DataFrame, folder: str, order: bool = True) -> DataFrame:
        """``pairs`` by bucket, one file each, sorted where it is to stay; read again as (a, b, n, bucket)."""
        placed = pairs.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket")
        placed.sortWithinPartitions("bucket", *(("a", "b") if order else ())).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return self.spark.read.schema(f"{_PAIRS}, bucket int").parquet(f"{self.path}/{folder}")

    def pairs(self, only: list[int] | None = None) -> DataFrame:
        """(a, b, n) of all buckets, or of some."""
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in sorted(self.at.items()) if only is None or b in only]
        return self.spark.read.schema(_PAIRS).parquet(*paths) if paths else self.spark.createDataFrame([], _PAIRS)

    def items(self) -> DataFrame:
        """(item, n): baskets with the item."""
        return self.spark.read.schema(_ITEMS).parquet(self.items_at) if self.items_at else self.spark.createDataFrame([], _ITEMS)

    def apply(self, changes: DataFrame, items: str = "items", load_id: str | None = None) -> PairTable:
        """Merge signed baskets: ``changes`` has the column ``items`` and ``sign`` (+1 or -1).

        Empty baskets count as baskets and give no pairs. No changes leave the table as it is. Counts that fall to 0 are removed. A
        load whose ``load_id`` was applied before changes nothing. The counts of a first load are its deltas; there is nothing to merge.
        The item table, one row per item, is written whole.
        """
        if load_id is not None and load_id in self.loads:
            return self
        version = f"v{uuid.uuid4().hex[:12]}"
        signed = checkpointed(basket_items(changes, items))  # read for baskets, pairs and items
        new_baskets = signed.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n")).first()["n"]
        delta = pair_deltas(signed)
        if self.buckets is None:
            delta = checkpointed(delta)
            self.buckets = buckets_for(delta.count())
        changed = self._write(delta, f"{version}/delta", order=not self.at)
        hit = {r["bucket"]: r["n"] for r in changed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``buckets`` numbers
        first = not self.at
        if hit and first:
            self.at, self.rows = dict.fromkeys(hit, f"{version}/delta"), sum(hit.values())
        elif hit:
            grow = self.rows + sum(hit.values()) > GROWN * BUCKET_ROWS * self.buckets
            old = self.pairs(None if grow else list(hit))
            if grow:
                self.buckets, self.at, self.rows = buckets_for(self.rows + sum(hit.values())), {}, 0
            merged = changed.select("a", "b", "n").unionByName(old)
            out = self._write(merged.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0"), f"{version}/pairs")
            kept = {r["bucket"] for r in out.select("bucket").distinct().collect()}
            for b in hit:
                self.at.pop(b, None)
            self.at |= dict.fromkeys(kept, f"{version}/pairs")
            self.rows = max(self.rows, 0) + sum(hit.values())  # an upper bound, as a pair that was known counts twice
        item_delta = checkpointed(item_deltas(signed))
        at = f"{self.path}/{version}/items"
        item_delta.unionByName(self.items()).groupBy("item").agg(F.sum("n").alias("n")).where("n <> 0").write.parquet(at)
        self.items_at, self.baskets = at, self.baskets + new_baskets
        self._touched_items, self._touched_pairs = item_delta, changed
        self._step += 1
        self.loads += [load_id] if load_id is not None else []
        row = [(self._step, self.buckets, self.at, self.items_at, self.baskets, self.rows, self.loads)]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self

    def clean(self) -> list[str]:
        """Deletes the folders of loads that no bucket and no item table needs any more; returns their names.

        For a single user of the table: others who opened an earlier state, and frames read from it, lose their files.
        """
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        used = {v.split("/")[0] for v in self.at.values()} | {str(self.items_at).split("/")[-2]}
        gone = [n for n in (x.getPath().getName() for x in fs.listStatus(root)) if n.startswith("v") and n not in used]
        for n in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, n), True)
        return gone

    def _with_margins(self, pairs: DataFrame, items: DataFrame) -> DataFrame:
        """``pairs`` with the columns of ``items`` (item, n, ...) of both of its items; the item table is sent to the executors if its counted size allows."""
        for side in ("a", "b"):
            own = items.select(F.col("item").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in items.columns if c != "item"])
            pairs = sized_join(pairs, own, side)
        return pairs

    def _scored(self, found: DataFrame) -> DataFrame:
        total = float(self.baskets)
        x = found.withColumn("lift", F.col("n") * total / (F.col("n_a") * F.col("n_b").cast("double")))
        pmi = F.log(F.col("lift"))
        npmi = F.when(F.col("n") >= total, F.lit(1.0)).otherwise(F.try_divide(pmi, -F.log(F.col("n") / total)))
        return x.select("a", "b", "n", "n_a", "n_b", F.lit(self.baskets).cast("bigint").alias("baskets"), "lift", pmi.alias("pmi"), npmi.alias("npmi"))

    def _enough(self, least: int, share: float):
        return (F.col("n") >= least) & (F.col("n") >= F.lit(share) * float(self.baskets))

    def scores(self, least: int = 1, share: float = 0.0) -> DataFrame:
        """(a, b, n, n_a, n_b, baskets, lift, pmi, npmi) of pairs in at least ``least`` baskets and a ``share`` of all baskets.

        lift is n baskets / (n_a n_b), pmi its logarithm, npmi the pmi divided by -ln(n / baskets): 1 for items that only come
        together (also where both are in every basket), 0 for independence.
        """
        return self._scored(self._with_margins(self.pairs().where(self._enough(least, share)), self.items()))

    def affected_scores(self, least: int = 1, share: float = 0.0) -> DataFrame:
        """The scores of pairs whose own count, or the count of one of whose items, the last ``apply`` of this object changed."""
        if self._touched_items is None:
            return self.scores(least, share).limit(0)
        touched = self._touched_items.select("item", F.lit(True).alias("t"))
        items = checkpointed(self.items().join(touched, "item", "left"))  # one row per item
        met = self._with_margins(self.pairs().where(self._enough(least, share)), items)
        by_item = F.coalesce(F.col("t_a"), F.lit(False)) | F.coalesce(F.col("t_b"), F.lit(False))
        own = met.where(~by_item).join(self._touched_pairs.select("a", "b"), ["a", "b"], "left_semi")  # counts may move where both items' counts stay
        return self._scored(met.where(by_item).unionByName(own))
