"""Records to named features to hashed, enumerated sparse rows.

Features come in long form (row_id, feature [, cnt]); every stage is one declarative plan, so that nothing is collected and the
dictionary is joined rather than shipped by hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.hashing import keep_sampled, native_hash
from hashloom.operators.dictionary import complete_dictionary, enumerate_hashes
from hashloom.operators.matrix import SparseMatrix
from hashloom.operators.skew import sized_join
from hashloom.session import checkpointed


def tokens(documents: DataFrame, row_id: str = "doc_id", text: str = "text", distinct: bool = False) -> DataFrame:
    """(row_id, feature): maximal runs of letters of the lower-cased text, repeated ones repeated, or once per record if ``distinct``."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}]+")
    words = F.array_remove(F.array_distinct(words) if distinct else words, "")
    return documents.select(F.col(row_id).alias("row_id"), F.explode(words).alias("feature"))


def extracted(records: DataFrame, row_id: str, features: str | Column) -> DataFrame:
    """(row_id, feature [, cnt]) from an array of names, or of (name, count) structs whose fields are in that order."""
    x = F.col(features) if isinstance(features, str) else features
    out = records.select(F.col(row_id).alias("row_id"), F.explode(x).alias("x"))
    kind = out.schema["x"].dataType
    if hasattr(kind, "names"):
        name, cnt = kind.names[:2]
        return out.select("row_id", F.col(f"x.{name}").cast("string").alias("feature"), F.col(f"x.{cnt}").cast("double").alias("cnt")).where("feature is not null")
    return out.select("row_id", F.col("x").cast("string").alias("feature")).where("feature is not null")


class CountExtractor:
    """A feature extractor with a life cycle: ``init`` once per task before the first record, ``close`` after the last one."""

    def init(self) -> None: ...

    def apply(self, record: dict) -> list[tuple[str, float]]:
        raise NotImplementedError

    def close(self) -> None: ...


def extract_with(records: DataFrame, row_id: str, make: Callable[[], CountExtractor]) -> DataFrame:
    """(row_id, feature, cnt) by a Python extractor, batch by batch; rows whose extractor gives nothing have no feature rows."""
    columns = records.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extractor = make()
        extractor.init()
        try:
            for pdf in batches:
                rows = [(r[row_id], f, float(c)) for r in (dict(zip(columns, t)) for t in pdf.itertuples(index=False, name=None)) for f, c in extractor.apply(r)]
                yield pd.DataFrame(rows, columns=["row_id", "feature", "cnt"])
        finally:
            extractor.close()

    return records.mapInPandas(run, f"row_id {records.schema[row_id].dataType.simpleString()}, feature string, cnt double")


def hashed(features: DataFrame, hash_with: Callable[[Column], Column] = native_hash) -> DataFrame:
    return features.withColumn("hash", hash_with(F.col("feature")))


def one_pass(features: DataFrame, row_keys: DataFrame, hash_with: Callable[[Column], Column] = native_hash, dedupe: bool = True, unique: bool = False) -> SparseMatrix:
    """Matrix of all features. With a column cnt, values are the summed counts; otherwise 1 per distinct feature of a row.

    The dictionary is written to the shared folder before the cells are made; only distinct names are hashed. ``dedupe=False``
    keeps repeated features of a binary row as their number of occurrences, as nnz would count them. ``unique`` says that no row has
    a feature twice, which saves moving the cells. Rows without features stay rows.
    """
    if "cnt" not in features.columns and not dedupe:
        features = features.withColumn("cnt", F.lit(1.0))
    dictionary = checkpointed(complete_dictionary(hashed(features.select("feature").distinct(), hash_with)))
    return with_dictionary(features, row_keys, dictionary, unique)


def feature_counts(features: DataFrame) -> DataFrame:
    """(feature, cnt): rows, or summed counts, of every feature; combined on the map side."""
    total = F.sum("cnt") if "cnt" in features.columns else F.count(F.lit(1))
    return features.groupBy("feature").agg(total.alias("cnt"))


def histogram(counts: DataFrame, col: str = "cnt") -> DataFrame:
    """(value, n): how many features have each count."""
    return counts.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram_cutoff(histo: DataFrame, at_most: int) -> DataFrame:
    """One row (cutoff): keeping values strictly above it keeps at most ``at_most``; ties at the cutoff are all dropped.

    The cutoff is the largest value whose cumulative count, from the top, exceeds ``at_most``, or the smallest value less 1. The
    histogram has one row per distinct count, which is small whatever the number of features. An empty one gives null.
    """
    cum = F.sum("n").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return histo.withColumn("cum", cum).agg(F.coalesce(F.max(F.when(F.col("cum") > at_most, F.col("value"))), F.min("value") - 1).alias("cutoff"))


def select_features(counts: DataFrame, min_count: float = 10, top: int = 1_000_000) -> DataFrame:
    """(feature, cnt) with at least ``min_count``, and above the cutoff for the ``top`` most frequent ones."""
    enough = counts.where(F.col("cnt") >= min_count)
    return enough.where(F.col("cnt") > histogram_cutoff(histogram(enough), top).scalar())


def dictionary_sample(features: DataFrame, rate: float = 0.1, min_count: float = 10, top: int = 1_000_000, hash_with: Callable[[Column], Column] = native_hash, unit: Column | None = None) -> DataFrame:
    """(hash, names, counts, col_id) from a deterministic sample of rows; names that share a hash stand together."""
    sampled = features if rate >= 1 else features.where(keep_sampled(F.col("row_id"), rate, unit))
    kept = hashed(select_features(feature_counts(sampled), min_count, top), hash_with)
    grouped = kept.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("feature", F.col("cnt").cast("double").alias("cnt")))).alias("x"))
    return enumerate_hashes(grouped.select("hash", F.col("x.feature").alias("names"), F.col("x.cnt").alias("counts")))


def sample_report(features: DataFrame, min_count: float, top: int, hash_with: Callable[[Column], Column] = native_hash) -> DataFrame:
    """(ok, too_low, collisions): features kept, features below the count or cutoff, hashes with several names; exact."""
    counts = feature_counts(features)
    kept = hashed(select_features(counts, min_count, top), hash_with)
    of_all = counts.agg(F.count(F.lit(1))).scalar()
    b = kept.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ok"), F.count_if(F.col("n") > 1).alias("collisions"))
    return b.select("ok", (of_all - F.col("ok")).alias("too_low"), "collisions")


def two_pass(
    features: DataFrame, row_keys: DataFrame, rate: float = 0.1, min_count: float = 10, top: int = 1_000_000, hash_with: Callable[[Column], Column] = native_hash, unit: Column | None = None, cells: DataFrame | None = None, unique: bool = False
) -> SparseMatrix:
    """Matrix over the sampled dictionary, which is written to the shared folder between the passes.

    Unknown features are dropped, rows left without features stay rows. ``cells``: the features of the second pass where they aren't those
    of the first, as counted or distinct ones; ``unique`` as in ``one_pass``.
    """
    dictionary = checkpointed(dictionary_sample(features, rate, min_count, top, hash_with, unit))
    return with_dictionary(features if cells is None else cells, row_keys, dictionary, unique)


def with_dictionary(features: DataFrame, row_keys: DataFrame, dictionary: DataFrame, unique: bool = False) -> SparseMatrix:
    """Matrix of the features that the dictionary (hash, names, col_id [, counts]) names.

    Features meet the dictionary by name, so that nothing is hashed here. Its size is counted: a small one is sent to the executors,
    for a larger one frequent features are cut into shards. An unknown feature isn't counted, not even if it shares a hash. Cells
    move only if counts are summed up, or if a row may have a column twice: unless ``unique``, or where names share a column.
    """
    names = F.explode(F.arrays_zip("names", "counts") if "counts" in dictionary.columns else F.transform("names", lambda n: F.struct(n.alias("names"))))
    known = dictionary.select("col_id", names.alias("x")).select(F.col("x.names").alias("feature"), "col_id", *([F.col("x.counts").alias("n")] if "counts" in dictionary.columns else []))
    loads = known.select("feature", "n") if "n" in known.columns else None
    met = sized_join(features, known.select("feature", "col_id"), "feature", loads=loads)
    if "cnt" in features.columns:
        cells = met.groupBy("row_id", "col_id").agg(F.sum("cnt").alias("value"))
    else:
        cells = met.select("row_id", "col_id")
        if not unique or not dictionary.where("size(names) > 1").isEmpty():
            cells = cells.distinct()
        cells = cells.withColumn("value", F.lit(1.0))
    return SparseMatrix(cells, row_keys.select("row_id"), dictionary)
