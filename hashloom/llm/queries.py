"""Queries of the subpackage and their SQL; ``hashloom.llm.oracle`` holds the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.llm.garbled import restored
from hashloom.llm.heavy_hitters import frequent, heavy_hitters
from hashloom.llm.leakage import leaks
from hashloom.llm.mixing import mix, sized_documents
from hashloom.llm.oracle import ORACLE
from hashloom.llm.pair_table import PairTable, basket_changes
from hashloom.llm.residuals import term_scores
from hashloom.llm.similar_sets import set_classes, similar_between, similar_classes, similar_pairs
from hashloom.llm.stable_sample import SampleStore
from hashloom.llm.term_stats import marked, term_frequencies
from hashloom.plans.tables import clean_name, dictionary_once, matrix_records, record_count, table, vector_sets
from hashloom.session import checkpointed, scratch_path

__all__ = ["ORACLE", "QUERIES"]


def _similar(spark: SparkSession, d: str, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    members, classes = set_classes(vector_sets(table(spark, d, "long_vectors")), "id", "set")
    return members, similar_classes(classes, threshold)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids with similarity >= 0.75, copies written out as the result asks."""
    members, pairs = _similar(spark, d)
    return similar_pairs(members, pairs)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """(id, class_id, links): one row per id with a non-empty set; links counts the similar ids of other classes and of its own."""
    members, pairs = _similar(spark, d)
    pairs = checkpointed(pairs)
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    others = ends.join(copies.select(F.col("rep").alias("other"), "copies"), "other").groupBy("rep").agg(F.sum("copies").alias("n"))
    per_class = copies.join(others, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return members.join(per_class, "rep").select("id", F.col("rep").alias("class_id"), "links")


def p1_between(spark: SparkSession, d: str) -> DataFrame:
    """(id_a, id_b): a record as the newest load delivered it and one as an earlier load did, with similarity >= 0.75."""
    rows = table(spark, d, "long_vectors")
    sets = vector_sets(rows).withColumn("newest", F.col("load_no") == rows.agg(F.max("load_no")).scalar())
    return similar_between(sets.where("newest"), sets.where("not newest"), "id", "set", 0.75).select("id_a", "id_b")


def _named_counts(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = dictionary_once(table(spark, d, name))
    return rows.select(F.explode("names_and_counts").alias("x")).select(clean_name(F.col("x.name")).alias("name"), F.col("x.cnt").alias("cnt"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Names with at least 0.5 % of the total of all names."""
    return frequent(_named_counts(spark, d, "dictionary_rows"), "name", "cnt", 0.005).select(F.col("item").alias("name"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """(name, estimate, error): the candidates of every stream with their estimated totals."""
    found = heavy_hitters(_named_counts(spark, d, "dictionary_rows"), "name", "cnt")
    return found.where("item is not null").select(F.col("item").alias("name"), "estimate", "error")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The column with the highest tf ln(N / df) of every probed record, among its columns with df >= 2."""
    records = matrix_records(table(spark, d, "matrix_blocks"))
    scores = term_scores(records, only=table(spark, d, "probe_rows")).where("df >= 2")
    # equal products of tf and ln may differ in their last bits
    score = F.round(F.col("tf") * F.log(F.col("n_records") / F.col("df")), 9)
    best = scores.groupBy("row_id").agg(F.min(F.struct((-score).alias("s"), F.col("term"))).alias("b"))
    return best.select("row_id", F.col("b.term").alias("col_id"))


def p4_residuals(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, col_id, tf, df, residual, adjusted) of every column of every record."""
    scores = term_scores(matrix_records(table(spark, d, "matrix_blocks")))
    return scores.select("row_id", F.col("term").alias("col_id"), "tf", "df", F.round("residual", 6).alias("residual"), F.round("adjusted", 6).alias("adjusted"))


def _late_blocks(blocks: DataFrame) -> DataFrame:
    """(block_id) of the blocks first written in the later half of the time."""
    first = blocks.where("block_id is not null").groupBy("block_id").agg(F.min("written_at").alias("at"))
    return first.where(F.col("at") > first.agg(F.percentile_approx("at", 0.5)).scalar()).select("block_id")


def _pair_table(spark: SparkSession, d: str) -> PairTable:
    """The table after two loads: the blocks written in the earlier half of the time, then the later ones, merged into the stored counts."""
    blocks = table(spark, d, "matrix_blocks")
    late, pairs = _late_blocks(blocks), PairTable(spark, scratch_path(spark, "pairs"))
    for load, how in (("early", "left_anti"), ("late", "left_semi")):
        pairs.apply(matrix_records(blocks.join(late, "block_id", how)).select(F.col("cols").alias("items"), F.lit(1).cast("bigint").alias("sign")), load_id=load)
    return pairs


def p5_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """(col_a, col_b, n, lift): pairs whose score a second load of changes recomputed.

    First all records are loaded, those of late blocks with the first half of their entries. Then these are completed, and the
    probed records vanish: only what changed goes in, as signed deltas.
    """
    blocks = table(spark, d, "matrix_blocks")
    late = _late_blocks(blocks)
    early, late = (checkpointed(matrix_records(blocks.join(late, "block_id", how))) for how in ("left_anti", "left_semi"))
    half = F.slice("cols", 1, F.ceil(F.size("cols") / 2).cast("int"))
    before = early.unionByName(late.select("row_id", half.alias("cols")))
    after = early.unionByName(late).join(table(spark, d, "probe_rows").select("row_id").distinct(), "row_id", "left_anti")
    pairs = PairTable(spark, scratch_path(spark, "pairs"))
    pairs.apply(before.select(F.col("cols").alias("items"), F.lit(1).cast("bigint").alias("sign")), load_id="before")
    pairs.apply(basket_changes(before, after, "row_id", "cols"), "cols", load_id="changes")
    return pairs.affected_scores().select(F.col("a").alias("col_a"), F.col("b").alias("col_b"), "n", F.round("lift", 6).alias("lift"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of columns in at least 5 records and 0.2 % of all, at least 4 times as many as by chance."""
    found = _pair_table(spark, d).scores(5, 0.002)
    return found.where("cast(n as decimal(38, 0)) * baskets >= 4 * cast(n_a as decimal(19, 0)) * n_b").select(F.col("a").alias("col_a"), F.col("b").alias("col_b"))


def _scored(s: DataFrame) -> DataFrame:
    return s.select(F.col("a").alias("col_a"), F.col("b").alias("col_b"), "n", F.round("lift", 6).alias("lift"), F.round("npmi", 6).alias("npmi"))


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """(col_a, col_b, n, lift, npmi) of every pair of columns in at least 5 records, as its SQL has it; p5_pairs has all pairs."""
    return _scored(_pair_table(spark, d).scores(5))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(col_a, col_b, n, lift, npmi) of every pair of columns that stands together in any record."""
    return _scored(_pair_table(spark, d).scores())


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    blocks, rows = table(spark, d, "matrix_blocks"), table(spark, d, "dictionary_count_rows")
    cols = matrix_records(blocks).select("row_id", F.explode(F.col("cols").cast("array<bigint>")).alias("item"))
    of_columns = marked(term_frequencies(cols, "item", "row_id"), record_count(blocks), 3, 0.2)
    listed = dictionary_once(rows).select("row_id", F.explode("names_and_counts").alias("x")).select("row_id", clean_name(F.col("x.name")).alias("item"))
    row_ids = rows.agg(F.count_distinct("row_id").alias("n"))
    of_names = marked(term_frequencies(listed, "item", "row_id"), row_ids, 3, 0.05)
    named = lambda f, df: df.select(F.lit(f).alias("field"), F.col("item").cast("string").alias("item"), "total", "records", "mark")
    return named("matrix_blocks.col_ids", of_columns).unionByName(named("dictionary_count_rows.names_and_counts", of_names))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Columns and names that are too rare or too common."""
    return _frequencies(spark, d).where("mark is not null").select("field", "item", "mark")


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """(field, item, total, records, mark) of every column and name; total counts occurrences."""
    return _frequencies(spark, d)


def _two_loads(spark: SparkSession, rows: DataFrame, weight: str | None = None) -> SampleStore:
    """A store that got the earlier half of the loads, was opened again and got the later half. Rows without a load number come first."""
    path, cut = scratch_path(spark, "sample"), rows.agg(F.percentile_approx("load_no", 0.5)).scalar()
    late = F.coalesce(F.col("load_no") > cut, F.lit(False))
    SampleStore(spark, path).add(rows.where(~late), "id", weight)
    return SampleStore(spark, path).add(rows.where(late), "id", weight)


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    """(id, first_load): a tenth of the ids of long_vectors, and the load that brought the id first."""
    rows = table(spark, d, "long_vectors")
    first = rows.where("id is not null").groupBy("id").agg(F.min("load_no").alias("first_load"))
    return _two_loads(spark, rows.select("id", "load_no")).sample(0.1).select("id").join(first, "id")


def p7_weighted(spark: SparkSession, d: str) -> DataFrame:
    """(id, weight): ids drawn with a probability of 0.005 per distinct value of the largest set delivered for them."""
    sets = vector_sets(table(spark, d, "long_vectors")).select("id", "load_no", F.size("set").alias("size"))
    return _two_loads(spark, sets, "size").sample(0.005).select("id", F.col("weight").cast("bigint").alias("weight"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that reproduce at least 25 successive words of a test item."""
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, copy_no, source, tokens): the composed set."""
    return mix(sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares wanted and reached by source."""
    return mix(sized_documents(table(spark, d, "documents")), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages with characters that a wrong decoding made."""
    return restored(table(spark, d, "documents")).where("garbled").select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text, chains): the garbled pages, restored as far as possible."""
    return restored(table(spark, d, "documents")).where("garbled").select("doc_id", F.col("restored").alias("text"), F.array_join("chains", ", ").alias("chains"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_classes, p1_between, p2_found, p2_totals, p4_found, p4_residuals, p5_found, p5_scores, p5_pairs, p5_after_changes, p6_found, p6_frequencies,
        p7_sample, p7_weighted, p8_found, p9_mix, p9_report, p10_found, p10_restored,
    )
}
