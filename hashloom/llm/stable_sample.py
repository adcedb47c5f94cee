"""Reproducible sample that stays stable as data grows: consistent weighted Poisson sampling.

An identifier's hash is a number u in [0, 1) that depends on nothing else. A record is in the sample when u < weight x constant.
The weight that counts is the largest seen so far, which is stored: an inclusion probability never falls, so what was selected
once stays selected whatever is loaded later, and any order or partitioning of the loads gives the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED = "id {}, weight double"


def unit_hash(identifier: Column, salt: str = "") -> Column:
    """u in [0, 1): the first 52 bits of the md5 of ``salt`` and the identifier's text, so that any other system can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), identifier.cast("string"))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def running_weights(arrivals: DataFrame, identifier: str, weight: str | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(id, weight): the largest weight of every identifier in ``stored`` and ``arrivals``.

    Null identifiers are dropped. Null, negative and NaN weights count as 0 (never selected by themselves). Without ``weight``
    every record weighs 1. An identifier delivered several times has one row.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    clean = F.when(w.isNull() | F.isnan(w) | (w < 0), F.lit(0.0)).otherwise(w)
    rows = arrivals.where(F.col(identifier).isNotNull()).select(F.col(identifier).alias("id"), clean.alias("weight"))
    if stored is not None:
        rows = rows.unionByName(stored.select("id", "weight"))
    return rows.groupBy("id").agg(F.max("weight").alias("weight"))


def stable_sample(weights: DataFrame, constant: float, salt: str = "") -> DataFrame:
    """(id, weight, u) of the selected identifiers. With weight 1 the constant is the sampled fraction.

    The constant must stay the same from run to run, or rise: it may not be derived from the size of the data.
    """
    if constant < 0:
        raise ValueError("constant must not be negative")
    return weights.select("id", "weight", unit_hash(F.col("id"), salt).alias("u")).where(F.col("u") < F.col("weight") * F.lit(float(constant)))


#: Loads that are merged into one folder, so that a read never meets more folders than that.
MERGE = 16


class SampleStore:
    """Weights below ``path`` (a folder that all executors share), one folder per load.

    A load writes its own largest weights only; the running maximum over all loads is taken where weights are read, and every
    MERGE loads are written together. Opening a path again finds what is stored there: a folder counts once it is complete, so a load
    that failed leaves the store as it was and is simply added again. A load added twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.base, self.step = self._found()

    def _found(self) -> tuple[int, int]:
        """(newest merged step, newest step) among the complete folders."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        done = [p.getName().split("=") for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        base = max([0, *(int(k) for kind, k in done if kind == "upto")])
        return base, max([base, *(int(k) for kind, k in done if kind == "step")])

    def weights(self) -> DataFrame | None:
        """(id, weight): the running maximum of all loads; None before the first one."""
        paths = [f"{self.path}/upto={self.base}"] * (self.base > 0) + [f"{self.path}/step={k}" for k in range(self.base + 1, self.step + 1)]
        if not paths:
            return None
        return self.spark.read.schema(_STORED.format(self._id_type())).parquet(*paths).groupBy("id").agg(F.max("weight").alias("weight"))

    def _id_type(self) -> str:
        newest = f"{self.path}/step={self.step}" if self.step > self.base else f"{self.path}/upto={self.base}"
        return self.spark.read.parquet(newest).schema["id"].dataType.simpleString()

    def add(self, arrivals: DataFrame, identifier: str, weight: str | None = None) -> SampleStore:
        """A load; null, negative and NaN weights count as 0. Identifiers must have the same type in all loads."""
        running_weights(arrivals, identifier, weight).write.mode("overwrite").parquet(f"{self.path}/step={self.step + 1}")
        self.step += 1
        if self.step - self.base >= MERGE:
            self.weights().write.mode("overwrite").parquet(f"{self.path}/upto={self.step}")
            self.base = self.step
        return self

    def sample(self, constant: float, salt: str = "") -> DataFrame:
        """``stable_sample`` of all that was loaded; refused before the first load."""
        weights = self.weights()
        if weights is None:
            raise ValueError(f"nothing was loaded into {self.path}")
        return stable_sample(weights, constant, salt)
