"""Dictionaries: names, hashes and dense column ids.

Schemas: mapping (feature STRING, hash BIGINT); dictionary (hash BIGINT, names ARRAY<STRING>, col_id INT).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OR = "|OR|"


def enumerate_hashes(hashes: DataFrame, key: str = "hash", col: str = "col_id") -> DataFrame:
    """``hashes`` with a dense id: the 0-based rank of the hash in ascending signed order. Hashes must be distinct, nulls are dropped.

    Ranks are taken within ranges given by the top 12 bits; the sizes of at most 4,096 ranges are summed up first, so no task
    ever sorts the whole dictionary.
    """
    return _ranked(hashes.where(F.col(key).isNotNull()).withColumn("__range", F.shiftright(F.col(key), 52)), key, col)


def enumerate_ids(ids: DataFrame, key: str, col: str, ranges: int = 1024) -> DataFrame:
    """The same for BIGINT keys that aren't hashes: ranges between approximate quantiles of the keys, so each holds about as many.

    The quantiles, at most ``ranges`` numbers, are taken at once and kept as constants of the plan, so that every row finds its
    range anew in the same way. However unevenly keys lie, a range has about 1 / ``ranges`` of them.
    """
    known = ids.where(F.col(key).isNotNull())
    cuts = known.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return _ranked(known.withColumn("__range", F.lit(0)), key, col)
    bounds, steps = F.lit(cuts), F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # binary search: how many cuts lie at or below the key
    at = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= len(cuts)) & (F.get(bounds, n + s - 1) <= F.col(key)), n + s).otherwise(n))
    return _ranked(known.withColumn("__range", at), key, col)


def _ranked(known: DataFrame, key: str, col: str) -> DataFrame:
    sizes = known.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    starts = F.broadcast(sizes.select("__range", before.alias("__before")))  # at most 4,096 rows
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return known.join(starts, "__range").withColumn(col, (F.col("__before") + rank - 1).cast("bigint")).drop("__range", "__before")


def complete_dictionary(mapping: DataFrame) -> DataFrame:
    """(hash, names sorted, col_id) of a mapping: colliding names share a hash and thus a column."""
    grouped = mapping.where("feature is not null and hash is not null").groupBy("hash").agg(F.sort_array(F.collect_set("feature")).alias("names"))
    return enumerate_hashes(grouped)


def display_names(names: str | Column = "names", length: int = 30) -> Column:
    """Names cut to ``length`` characters and joined."""
    return F.concat_ws(OR, F.transform(names, lambda x: F.substring(x, 1, length)))


def collisions(mapping: DataFrame) -> DataFrame:
    """(hash, names, n): one row per hash, n > 1 where different names share it."""
    grouped = mapping.groupBy("hash").agg(F.sort_array(F.collect_set("feature")).alias("x"))
    return grouped.select("hash", F.concat_ws(OR, "x").alias("names"), F.size("x").cast("bigint").alias("n"))


def merge(*mappings: DataFrame) -> DataFrame:
    """One mapping out of several; a feature keeps its smallest hash."""
    out = mappings[0].select("feature", "hash")
    for m in mappings[1:]:
        out = out.unionByName(m.select("feature", "hash"))
    return out.where("feature is not null").groupBy("feature").agg(F.min("hash").alias("hash"))


def reverse(mapping: DataFrame) -> DataFrame:
    """(hash, names): every name under its hash."""
    return mapping.where("hash is not null").groupBy("hash").agg(F.sort_array(F.collect_set("feature")).alias("names"))


def add_mapping(mapping: DataFrame, more: DataFrame) -> DataFrame:
    """Features of ``more`` that ``mapping`` doesn't have, added to it."""
    return mapping.select("feature", "hash").unionByName(more.select("feature", "hash").distinct().join(mapping.select("feature"), "feature", "left_anti"))


def contains(mapping: DataFrame, features: DataFrame) -> DataFrame:
    """``features`` (feature) with a column known; a feature that is missing, or null, is not known."""
    known = mapping.select("feature").distinct().withColumn("known", F.lit(True))
    return features.join(known, "feature", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def matching_ids(mapping: DataFrame, predicate: Column, into: DataFrame | None = None) -> DataFrame:
    """(hash): distinct ids whose (feature, hash) satisfies the predicate, together with those of ``into``."""
    ids = mapping.where(predicate).select("hash")
    return (ids if into is None else ids.unionByName(into.select("hash"))).distinct()


def subset(dictionary: DataFrame, ids: DataFrame) -> DataFrame:
    """The dictionary of ``ids`` (hash) only, enumerated anew in the same order."""
    return enumerate_hashes(dictionary.drop("col_id").join(ids.select("hash").distinct(), "hash", "left_semi"))


def to_column(dictionary: DataFrame, hashes: DataFrame) -> DataFrame:
    """``hashes`` with their column id, null where unknown."""
    return hashes.join(dictionary.select("hash", "col_id"), "hash", "left")


def to_hash(dictionary: DataFrame, cols: DataFrame) -> DataFrame:
    """``cols`` (col_id) with their hash, null where unknown."""
    return cols.join(dictionary.select("col_id", "hash"), "col_id", "left")
