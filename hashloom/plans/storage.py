"""Queries that write and read matrices, dictionaries and vectors, and convert whole sets of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions.hashing import feature_hash, md5_hash
from hashloom.operators.dictionary import display_names
from hashloom.plans.features import _SEL, _TOK, _tokens, _top
from hashloom.plans.tables import table
from hashloom.session import checkpointed, scratch_path
from hashloom.sources import fileset, legacy

#: Hashes that ids must equal.
NAMES = {
    "": 3992762020063000376, "a": -3986827505912633208, "b": 9041115770307277158, "ab": 4157034724278720815, "ba": 8300793842340226287,
    "AB": -7649582738128831073, "1": 735574140598439701, "13": -2774051404758973991, "é": -1608330459577798339,
}


def murmur_ids(spark, d):
    """The 64-bit Murmur ids of given names."""
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", feature_hash("name").alias("hash"))


def io_limited(spark, d):
    """The selected matrix saved in 16 parts and loaded as far as 150,000 bytes go: column sums of what was loaded."""
    path = scratch_path(spark, "matrix")
    _top(spark, d).save(path, F.pmod("row_id", F.lit(16)))
    return fileset.load_limited(spark, path, 150_000).column_sums().select("col_id", "n")


def io_legacy_ints(spark, d):
    """Binary part files of int vectors: how many rows read back have each column."""
    path = scratch_path(spark, "ints")
    legacy.write_vectors(_top(spark, d).packed(values=False), path)
    return legacy.read_vectors(spark, path).select(F.explode("col_ids").alias("col_id")).groupBy("col_id").agg(F.count(F.lit(1)).alias("n"))


def io_legacy_counts(spark, d):
    """Binary part files of count vectors: rows and totals by column."""
    path = scratch_path(spark, "counts")
    legacy.write_vectors(_top(spark, d, counts=True).packed(), path, counts=True)
    cells = legacy.read_vectors(spark, path, counts=True).select(F.explode(F.arrays_zip("col_ids", "vals")).alias("x"))
    return cells.groupBy(F.col("x.col_ids").alias("col_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.vals").cast("bigint").alias("total"))


def io_legacy_longs(spark, d):
    """A file set of long vectors: how many delivered vectors have each hash."""
    files = fileset.FileSet(scratch_path(spark, "longs"))
    legacy.write_vectors(table(spark, d, "long_vectors").select(F.coalesce(F.array_distinct(F.array_compact("col_ids")), F.array().cast("array<bigint>")).alias("col_ids")), f"{files.root}/{fileset.PARTS[0]}", wide=True)
    return files.vectors(spark).select(F.explode("col_ids").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def io_mixed(spark, d):
    """Mixed matrix files of line items: rows, sums of the dense columns in hundredths, and cells of the sparse ones."""
    path = scratch_path(spark, "mixed")
    cents = [F.round(F.col(c) * 100).cast("double") for c in ("l_quantity", "l_discount", "l_tax")]
    flag = F.array_position(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.col("l_returnflag")) - 1
    legacy.write_mixed(table(spark, d, "lineitem").select(F.array(*cents).alias("dense"), F.array(flag).alias("col_ids"), F.array(F.lit(1.0)).alias("vals")), path, 3, 3)
    back = legacy.read_mixed(spark, path)
    sums = [F.sum(F.nanvl(F.get("dense", i), F.lit(None))).cast("bigint").alias(n) for i, n in enumerate(("quantity", "discount", "tax"))]
    flags = [F.count_if(F.array_contains("col_ids", i)).alias(n) for i, n in enumerate(("flag_a", "flag_n", "flag_r"))]
    return back.agg(F.count(F.lit(1)).alias("n_rows"), *sums, *flags)


def io_dictionary_text(spark, d):
    """Names and hashes of all tokens, written as text and read again."""
    path = scratch_path(spark, "dictionary")
    fileset.write_dictionary(_tokens(spark, d).select("feature").distinct().withColumn("hash", md5_hash(F.col("feature"))), path)
    return fileset.read_dictionary(spark, path)


def io_code_lookup(spark, d):
    """The columns of the selected matrix with their names, written as text and read again."""
    path = scratch_path(spark, "lookup")
    fileset.write_code_lookup(_top(spark, d).dictionary, path)
    return fileset.read_code_lookup(spark, path)


def io_counts(spark, d):
    path = scratch_path(spark, "counts")
    fileset.write_counts(_top(spark, d), path)
    return fileset.read_counts(spark, path)


def io_dims_text(spark, d):
    """Partition dims of the selected matrix, written as text and read again."""
    path, m = scratch_path(spark, "dims"), _top(spark, d)
    fileset.write_dims(m.dims(), m.partition_dims(F.pmod("row_id", F.lit(8))), path)
    return fileset.read_dims(spark, path)[1]


def convert_longs(spark, d):
    """Long vectors converted to dense ids of the hashes in more than a hundredth of them: dims by load."""
    v = table(spark, d, "long_vectors").where("load_no is not null").select(F.col("load_no").alias("part"), F.col("id").alias("row_id"), F.col("col_ids").alias("hashes"))
    once = checkpointed(v.dropDuplicates(["part", "row_id"]))
    return fileset.converted(once, checkpointed(fileset.kept_ids(once, 0.01)))[1]


def remap_dictionary(spark, d):
    """Names of the tokens in more than a twentieth of the pages, and of those that begin with qu, under their new columns."""
    docs = table(spark, d, "documents")
    hashes = F.transform(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")), md5_hash)
    v = docs.select(F.pmod("doc_id", F.lit(4)).alias("part"), F.col("doc_id").alias("row_id"), hashes.alias("hashes"))
    mapping = _tokens(spark, d).select("feature").distinct().withColumn("hash", md5_hash(F.col("feature")))
    return fileset.remapped_dictionary(mapping, fileset.kept_ids(v, 0.05, mapping, F.col("feature").startswith("qu")))


def matrix_row(spark, d):
    """The row with the smallest id, as counts of 1."""
    first = table(spark, d, "documents").agg(F.min("doc_id")).first()[0]
    return _top(spark, d, counts=True).as_counts().row(first).select("col_id", F.col("value").cast("bigint").alias("value"))


def short_names(spark, d):
    """Names of the selected columns, cut to five characters."""
    return _top(spark, d).dictionary.select("col_id", display_names(length=5).alias("name"))


QUERIES = {
    f.__name__: f
    for f in (
        murmur_ids, io_limited, io_legacy_ints, io_legacy_counts, io_legacy_longs, io_mixed, io_dictionary_text, io_code_lookup, io_counts,
        io_dims_text, convert_longs, remap_dictionary, matrix_row, short_names,
    )
}

ORACLE = {
    "murmur_ids": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {h}::BIGINT)" for n, h in NAMES.items()) + ") t(name, hash)",
    "io_limited": f"""WITH {_SEL}, z AS (SELECT doc_id % 16 AS part, count(DISTINCT doc_id) AS n_rows, count(col_id) AS nnz FROM documents LEFT JOIN sc ON doc_id = row_id GROUP BY 1),
        u AS (SELECT part, sum((nnz + n_rows) * 4) OVER (ORDER BY part) + (SELECT sum(length(f)) * 2 + count(*) * 16 FROM se) AS s FROM z)
        SELECT se.col_id, count(row_id) AS n FROM se LEFT JOIN (SELECT * FROM sc WHERE row_id % 16 IN (SELECT part FROM u WHERE s < 150000)) x ON se.col_id = x.col_id GROUP BY 1""",
    "io_legacy_ints": f"WITH {_SEL} SELECT col_id, count(*) AS n FROM sc GROUP BY 1",
    "io_legacy_counts": f"WITH {_SEL} SELECT col_id, count(*) AS n, CAST(sum(tf) AS BIGINT) AS total FROM sc GROUP BY 1",
    "io_legacy_longs": "SELECT hash, count(*) AS n FROM (SELECT unnest(list_distinct(col_ids)) AS hash FROM long_vectors) WHERE hash IS NOT NULL GROUP BY hash",
    "io_mixed": """SELECT count(*) AS n_rows, CAST(sum(round(l_quantity * 100)) AS BIGINT) AS quantity, CAST(sum(round(l_discount * 100)) AS BIGINT) AS discount, CAST(sum(round(l_tax * 100)) AS BIGINT) AS tax,
        count(*) FILTER (l_returnflag = 'A') AS flag_a, count(*) FILTER (l_returnflag = 'N') AS flag_n, count(*) FILTER (l_returnflag = 'R') AS flag_r FROM lineitem""",
    "io_dictionary_text": f"WITH {_TOK} SELECT f AS feature, hash FROM hs",
    "io_code_lookup": f"WITH {_SEL} SELECT col_id, f AS name FROM se",
    "io_counts": f"WITH {_SEL} SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM se) AS n_cols, (SELECT count(*) FROM sc) AS nnz",
    "io_dims_text": f"WITH {_SEL} SELECT CAST(doc_id % 8 AS INTEGER) AS part, count(DISTINCT doc_id) AS n_rows, count(col_id) AS nnz FROM documents LEFT JOIN sc ON doc_id = row_id GROUP BY 1",
    "convert_longs": """WITH v AS (SELECT DISTINCT ON (load_no, id) load_no, id, list_filter(list_distinct(col_ids), lambda x: x IS NOT NULL) AS c FROM long_vectors WHERE load_no IS NOT NULL),
        e AS (SELECT load_no, id, unnest(c) AS h FROM v), k AS (SELECT h FROM e GROUP BY h HAVING count(*) > 0.01 * (SELECT count(*) FROM v)),
        m AS (SELECT load_no, count(*) AS nnz FROM e WHERE h IN (SELECT h FROM k) GROUP BY 1)
        SELECT load_no AS part, n_rows, (SELECT count(*) FROM k) AS n_cols, coalesce(nnz, 0) AS nnz FROM (SELECT load_no, count(*) AS n_rows FROM v GROUP BY 1) LEFT JOIN m USING (load_no)""",
    "remap_dictionary": f"""WITH {_TOK}, k AS (SELECT f, hash FROM hs WHERE starts_with(f, 'qu') OR f IN (SELECT f FROM cell GROUP BY f HAVING count(*) > 0.05 * (SELECT count(*) FROM documents)))
        SELECT row_number() OVER (ORDER BY hash) - 1 AS col_id, f AS name FROM k""",
    "matrix_row": f"WITH {_SEL} SELECT col_id, CAST(1 AS BIGINT) AS value FROM sc WHERE row_id = (SELECT min(doc_id) FROM documents)",
    "short_names": f"WITH {_SEL} SELECT col_id, substr(f, 1, 5) AS name FROM se",
}
