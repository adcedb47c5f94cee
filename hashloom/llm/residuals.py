"""How distinctive a term is per record: correspondence-analysis residuals.

With x the count of a term in a record, r the record's entries, c the term's entries in the collection and n all entries, the
expected count is e = r c / n. The residual is (x - e) / sqrt(e); dividing it by sqrt((1 - r / n)(1 - c / n)) gives it variance 1
under independence, so that scores of long and short records and of common and rare terms compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.operators.skew import balanced_join, plan_from_loads
from hashloom.session import checkpointed


def term_margins(records: DataFrame, items: str = "cols") -> DataFrame:
    """(term, col_total, df): entries and records of every term; null terms don't count. One shuffle, combined on the map side."""
    cell = lambda c, n, d: F.struct(c.cast("bigint").alias("term"), F.lit(n).cast("bigint").alias("n"), F.lit(d).cast("bigint").alias("d"))
    both = F.concat(F.transform(items, lambda c: cell(c, 1, 0)), F.transform(F.array_distinct(items), lambda c: cell(c, 0, 1)))
    return records.select(F.explode(both).alias("x")).where("x.term is not null").groupBy("x.term").agg(F.sum("x.n").alias("col_total"), F.sum("x.d").alias("df"))


def term_scores(records: DataFrame, row_id: str = "row_id", items: str = "cols", only: DataFrame | None = None) -> DataFrame:
    """(row_id, term, tf, df, n_records, expected, residual, adjusted) for every term of every record, or of the records in ``only``.

    ``records`` has one row per record with its terms (BIGINT or INT) as an array, repeated terms repeated. Margins always cover
    the whole collection. Null terms don't count; records without terms count in n_records and give no rows; ids in ``only`` that
    are listed twice count once. A collection of a single record or a single term has no variance left: adjusted is then null.
    A few terms hold most entries, so the margins are joined by shards of heavy terms.
    """
    margins = checkpointed(term_margins(records, items))
    entries, n_records = margins.agg(F.sum("col_total")).scalar(), records.agg(F.count(F.lit(1))).scalar()
    chosen = records.select(F.col(row_id).alias("row_id"), F.col(items).alias("items"))
    if only is not None:
        chosen = chosen.join(only.select(F.col(row_id).alias("row_id")).where("row_id is not null").distinct(), "row_id", "left_semi")
    terms = F.array_compact("items")
    cells = chosen.select("row_id", F.size(terms).cast("bigint").alias("row_total"), F.explode(terms).alias("term"))
    cells = cells.groupBy("row_id", "row_total", F.col("term").cast("bigint").alias("term")).agg(F.count(F.lit(1)).alias("tf"))
    plan = plan_from_loads(margins.select(F.col("term"), F.col("df")), "term", "df")
    x = (
        balanced_join(cells, margins, "term", "inner", plan, ["row_id"])
        .withColumn("n", entries)
        .withColumn("n_records", n_records)
        .withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("n"))
    )
    residual = (F.col("tf") - F.col("expected")) / F.sqrt("expected")
    spread = (1 - F.col("row_total") / F.col("n")) * (1 - F.col("col_total") / F.col("n"))
    return x.select("row_id", "term", "tf", "df", "n_records", "expected", residual.alias("residual"), F.try_divide(residual, F.sqrt(spread)).alias("adjusted"))
