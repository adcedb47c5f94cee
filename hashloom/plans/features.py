"""Queries over features, dictionaries and sparse matrices of the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.arrays import sparse_dot
from hashloom.functions.hashing import md5_hash
from hashloom.operators import dictionary as D
from hashloom.operators import featurize as X
from hashloom.operators.matrix import SparseMatrix
from hashloom.operators.mixed import top_k_per_group
from hashloom.plans.tables import matrix_records, table
from hashloom.session import checkpointed, scratch_path
from hashloom.sources import fileset

LANGS = {"en": ("en", "EN", "eng"), "fr": ("fr", "FR", "fra")}


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.tokens(table(spark, d, "documents"))


def _keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"))


def _matrix(spark: SparkSession, d: str) -> SparseMatrix:
    """All tokens, each once per document."""
    return X.one_pass(X.tokens(table(spark, d, "documents"), distinct=True), _keys(spark, d), md5_hash, unique=True)


def feat_dims(spark, d):
    """Rows, distinct tokens and distinct (document, token) pairs."""
    return _matrix(spark, d).dims()


def feat_partition_dims(spark, d):
    return _matrix(spark, d).partition_dims(F.pmod("row_id", F.lit(8)))


def dict_sample_counts(spark, d):
    """Tokens with at least 10 occurrences in a sample of half the documents by the md5 of their id."""
    unit = md5_hash(F.col("row_id").cast("string")) / F.lit(float(1 << 60))
    counts = X.feature_counts(_tokens(spark, d).where(X.keep_sampled(F.col("row_id"), 0.5, unit)))
    return counts.where("cnt >= 10").select("feature", "cnt")


def dict_histogram(spark, d):
    return X.histogram(X.feature_counts(_tokens(spark, d))).select("value", "n")


def dict_cutoff(spark, d):
    """The 500 most frequent tokens with at least 10 occurrences, ties at the cutoff left out."""
    return X.select_features(X.feature_counts(_tokens(spark, d)), 10, 500)


def dict_collisions(spark, d):
    """Names under hashes cut to 12 bits."""
    mapping = _tokens(spark, d).select("feature").distinct().withColumn("hash", F.pmod(md5_hash(F.col("feature")), F.lit(4096)))
    return D.collisions(mapping)


def dict_report(spark, d):
    """Features kept, features too rare, colliding hashes."""
    return X.sample_report(_tokens(spark, d), 10, 500, md5_hash)


def enumerate_tokens(spark, d):
    return _matrix(spark, d).triplets.select("row_id", "col_id")


def dict_enumeration(spark, d):
    return _matrix(spark, d).dictionary.select("hash", F.array_join("names", "|OR|").alias("names"), "col_id")


def vectors_packed(spark, d):
    return _matrix(spark, d).packed(values=False).select("row_id", F.array_join(F.col("col_ids").cast("array<string>"), ",").alias("col_ids"))


def count_matrix(spark, d):
    """Token counts; the count vectors of the same dictionary."""
    m = X.one_pass(_tokens(spark, d).withColumn("cnt", F.lit(1.0)), _keys(spark, d), md5_hash)
    return m.triplets.select("row_id", "col_id", F.col("value").cast("bigint").alias("tf"))


def two_pass_dims(spark, d):
    """Size of the matrix over the selected dictionary: documents without a known token stay rows."""
    return _top(spark, d).dims()


def two_pass_counts(spark, d):
    """Column sums of the count matrix over the selected dictionary."""
    return _top(spark, d, counts=True).column_sums().select("col_id", "n", F.col("total").cast("bigint").alias("total"))


def colsums_binary(spark, d):
    return _matrix(spark, d).column_sums().select("col_id", "n")


def _top(spark, d, counts: bool = False) -> SparseMatrix:
    """The matrix of the 500 most frequent tokens: the first pass counts all of them, the second one has counts or distinct tokens."""
    cells = _tokens(spark, d).withColumn("cnt", F.lit(1.0)) if counts else X.tokens(table(spark, d, "documents"), distinct=True)
    return X.two_pass(_tokens(spark, d), _keys(spark, d), 1.0, 10, 500, md5_hash, cells=cells, unique=True)


def cooccurrence_top(spark, d):
    """The 20 most frequent columns of the selected dictionary with each other."""
    m = _top(spark, d)
    return m.cooccurrence(m.top_columns(20))


def subset_cols_by_feature(spark, d):
    """Tokens of four letters, enumerated anew."""
    m = _matrix(spark, d).subset_by_feature(F.length("feature") == 4)
    return m.column_sums().select("col_id", "n")


def subset_cols_dims(spark, d):
    return _matrix(spark, d).subset_by_feature(F.length("feature") == 4).dims()


def subset_rows(spark, d):
    """Documents with at least 100 distinct tokens."""
    return _matrix(spark, d).subset_rows(F.col("nnz") >= 100).dims()


def min_frac_columns(spark, d):
    """Columns in more than a twentieth of the documents, and all tokens that begin with qu."""
    return _matrix(spark, d).frequent_columns(0.05, F.col("feature").startswith("qu"))


def dict_merge_reverse(spark, d):
    """The dictionaries of the English and of the French pages, merged and turned round."""
    docs = table(spark, d, "documents")
    parts = [X.tokens(docs.where(F.col("lang").isin(*names))).select("feature").distinct().withColumn("hash", md5_hash(F.col("feature"))) for names in LANGS.values()]
    return D.reverse(D.merge(*parts)).select("hash", F.array_join("names", "|OR|").alias("names"))


def dict_matching(spark, d):
    """Hashes of tokens that begin with qu, or have twelve letters or more."""
    mapping = _tokens(spark, d).select("feature").distinct().withColumn("hash", md5_hash(F.col("feature")))
    return D.matching_ids(mapping, F.col("feature").startswith("qu"), D.matching_ids(mapping, F.length("feature") >= 12))


def dict_contains(spark, d):
    """Which German tokens the English pages have as well."""
    docs = table(spark, d, "documents")
    en = X.tokens(docs.where(F.col("lang").isin("en", "EN", "eng"))).select("feature").distinct().withColumn("hash", md5_hash(F.col("feature")))
    return D.contains(en, X.tokens(docs.where(F.col("lang").isin("de", "DE", "deu"))).select("feature").distinct())


def mat_vec(spark, d):
    """Matrix times the weights 1 / (1 + column)."""
    m = _top(spark, d)
    weights = m.dictionary.select("col_id", (F.lit(1.0) / (F.col("col_id") + 1)).alias("w"))
    return m.times_vector(weights).select("row_id", F.round("value", 6).alias("value"))


def row_times_matrix(spark, d):
    """Rows times theta(c, j) = c + j for j = 0, 1, 2."""
    m = _top(spark, d)
    theta = m.dictionary.select("col_id", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j")).select("col_id", "j", (F.col("col_id") + F.col("j")).cast("double").alias("v"))
    return m.times_matrix(theta).select("row_id", "j", F.col("value").cast("bigint").alias("value"))


def outer_plus(spark, d):
    """For every column: the number of documents, and the sum of their page numbers, that have it."""
    docs = table(spark, d, "documents")
    values = docs.select(F.col("doc_id").alias("row_id"), F.explode(F.array(F.struct(F.lit(0).alias("j"), F.lit(1.0).alias("v")), F.struct(F.lit(1).alias("j"), F.coalesce("page_no", F.lit(0)).cast("double").alias("v")))).alias("x"))
    return _top(spark, d).outer_plus(values.select("row_id", "x.j", "x.v")).select("col_id", "j", F.col("value").cast("bigint").alias("value"))


def dot_sparse(spark, d):
    """Every matrix record with its successor: the number of columns both have."""
    records = matrix_records(table(spark, d, "matrix_blocks"))
    nxt = records.select((F.col("row_id") - 1).alias("row_id"), F.col("cols").alias("other"))
    return records.join(nxt, "row_id").select("row_id", sparse_dot("cols", "other").cast("bigint").alias("common"))


def point_lookup(spark, d):
    """The value of every probed record in column 0 to 49."""
    records = matrix_records(table(spark, d, "matrix_blocks"))
    probes = table(spark, d, "probe_rows").distinct()
    m = SparseMatrix.from_vectors(records.join(probes, "row_id", "left_semi").select("row_id", F.col("cols").alias("col_ids")))
    cells = probes.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("col_id"))
    return m.get(cells).select("row_id", "col_id", F.col("value").cast("bigint").alias("value"))


def matrix_dims(spark, d):
    """Rows, columns in use, and cells of the record matrix."""
    records = matrix_records(table(spark, d, "matrix_blocks"))
    return SparseMatrix.from_vectors(records.select("row_id", F.col("cols").alias("col_ids"))).dims()


def hashed_colsums(spark, d):
    """How many delivered vectors have each hash."""
    v = table(spark, d, "long_vectors").select("id", F.explode(F.array_distinct(F.array_compact("col_ids"))).alias("hash"))
    return v.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def topk_group(spark, d):
    """The ten most frequent tokens of each language as written."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    counts = docs.select("lang", F.explode(words).alias("feature")).groupBy("lang", "feature").agg(F.count(F.lit(1)).alias("n"))
    return top_k_per_group(counts, "lang", "n", "feature", 10).select("lang", "feature", "n", F.col("rank").cast("bigint").alias("rank"))


def io_round_trip(spark, d):
    """The matrix of the selected dictionary, saved, loaded and summed up."""
    path = scratch_path(spark, "matrix")
    _top(spark, d).save(path)
    return SparseMatrix.load(spark, path).column_sums().select("col_id", "n")


def byte_budget(spark, d):
    """Parts by document id that fit into 100,000 bytes."""
    vectors = _top(spark, d).packed(values=False).withColumn("part", F.pmod("row_id", F.lit(64)))
    return fileset.parts_within(fileset.partition_dims(vectors), 100_000).select("part", "n_rows", "nnz")


def long_to_int(spark, d):
    """Packed long vectors re-encoded with dense ids: the size of the result, and the largest id."""
    v = table(spark, d, "long_vectors").select(F.col("id").alias("row_id"), F.explode(F.array_compact("col_ids")).alias("hash")).distinct()
    ids = checkpointed(D.enumerate_hashes(v.select("hash").distinct()))
    cells = v.join(ids, "hash")
    return cells.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("row_id").alias("n_rows"), F.max("col_id").alias("last_col"))


QUERIES = {
    f.__name__: f
    for f in (
        feat_dims, feat_partition_dims, dict_sample_counts, dict_histogram, dict_cutoff, dict_collisions, dict_report, enumerate_tokens,
        dict_enumeration, vectors_packed, count_matrix, two_pass_dims, two_pass_counts, colsums_binary, cooccurrence_top,
        subset_cols_by_feature, subset_cols_dims, subset_rows, min_frac_columns, dict_merge_reverse, dict_matching, dict_contains,
        mat_vec, row_times_matrix, outer_plus, dot_sparse, point_lookup, matrix_dims, hashed_colsums, topk_group, io_round_trip,
        byte_budget, long_to_int,
    )
}

_TOK = r"""tok AS (SELECT doc_id, f FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS f FROM documents) WHERE f <> ''),
fc AS (SELECT f, count(*) AS cnt FROM tok GROUP BY f),
hs AS (SELECT f, ('0x' || substr(md5(f), 1, 15))::BIGINT AS hash FROM fc),
en AS (SELECT hash, f, row_number() OVER (ORDER BY hash) - 1 AS col_id FROM hs),
cell AS (SELECT DISTINCT doc_id AS row_id, col_id, tok.f AS f FROM tok JOIN en ON tok.f = en.f)"""
_SEL = _TOK + """,
hist AS (SELECT cnt AS value, count(*) AS n FROM fc WHERE cnt >= 10 GROUP BY cnt),
cum AS (SELECT value, sum(n) OVER (ORDER BY value DESC) AS s FROM hist),
cut AS (SELECT coalesce((SELECT max(value) FROM cum WHERE s > 500), (SELECT min(value) FROM hist) - 1) AS c),
sel AS (SELECT fc.f, cnt FROM fc, cut WHERE cnt >= 10 AND cnt > c),
se AS (SELECT sel.f, hash, row_number() OVER (ORDER BY hash) - 1 AS col_id FROM sel JOIN hs ON sel.f = hs.f),
sc AS (SELECT doc_id AS row_id, col_id, count(*) AS tf FROM tok JOIN se ON tok.f = se.f GROUP BY 1, 2)"""
_REC = """b AS (SELECT DISTINCT ON (block_id) * FROM matrix_blocks WHERE block_id IS NOT NULL AND n_rows > 0),
r AS (SELECT first_row_id + i AS row_id, col_ids[row_start_idx[i + 1] + 1 : row_start_idx[i + 2]] AS cols FROM (SELECT *, unnest(range(n_rows)) AS i FROM b)),
e AS (SELECT DISTINCT row_id, unnest(cols) AS col_id FROM r)"""


def _split(where: str) -> str:
    return rf"SELECT DISTINCT f FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}]+')) AS f FROM documents WHERE {where}) WHERE f <> ''"


_HASH = "('0x' || substr(md5(f), 1, 15))::BIGINT"

ORACLE = {
    "feat_dims": f"WITH {_TOK} SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM en) AS n_cols, (SELECT count(*) FROM cell) AS nnz",
    "feat_partition_dims": f"""WITH {_TOK} SELECT doc_id % 8 AS part, count(*) AS n_rows, CAST(sum(coalesce(n, 0)) AS BIGINT) AS nnz FROM documents
        LEFT JOIN (SELECT row_id, count(*) AS n FROM cell GROUP BY row_id) ON doc_id = row_id GROUP BY 1""",
    "dict_sample_counts": f"WITH {_TOK} SELECT f AS feature, count(*) AS cnt FROM tok WHERE ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT / 1152921504606846976.0 < 0.5 GROUP BY f HAVING count(*) >= 10",
    "dict_histogram": f"WITH {_TOK} SELECT cnt AS value, count(*) AS n FROM fc GROUP BY cnt",
    "dict_cutoff": f"WITH {_SEL} SELECT f AS feature, cnt FROM sel",
    "dict_collisions": f"WITH {_TOK} SELECT hash % 4096 AS hash, string_agg(f, '|OR|' ORDER BY f) AS names, count(*) AS n FROM hs GROUP BY 1",
    "dict_report": f"WITH {_SEL} SELECT (SELECT count(*) FROM sel) AS ok, (SELECT count(*) FROM fc) - (SELECT count(*) FROM sel) AS too_low, CAST(0 AS BIGINT) AS collisions",
    "enumerate_tokens": f"WITH {_TOK} SELECT row_id, col_id FROM cell",
    "dict_enumeration": f"WITH {_TOK} SELECT hash, f AS names, col_id FROM en",
    "vectors_packed": f"""WITH {_TOK}, p AS (SELECT row_id, string_agg(CAST(col_id AS VARCHAR), ',' ORDER BY col_id) AS c FROM cell GROUP BY row_id)
        SELECT doc_id AS row_id, coalesce(c, '') AS col_ids FROM documents LEFT JOIN p ON doc_id = row_id""",
    "count_matrix": f"WITH {_TOK} SELECT doc_id AS row_id, col_id, count(*) AS tf FROM tok JOIN en ON tok.f = en.f GROUP BY 1, 2",
    "two_pass_dims": f"WITH {_SEL} SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM se) AS n_cols, (SELECT count(*) FROM sc) AS nnz",
    "two_pass_counts": f"WITH {_SEL} SELECT se.col_id, count(row_id) AS n, CAST(coalesce(sum(tf), 0) AS BIGINT) AS total FROM se LEFT JOIN sc ON se.col_id = sc.col_id GROUP BY 1",
    "colsums_binary": f"WITH {_TOK} SELECT col_id, count(*) AS n FROM cell GROUP BY 1",
    "cooccurrence_top": f"""WITH {_SEL}, t AS (SELECT col_id FROM sc GROUP BY 1 ORDER BY count(*) DESC, col_id LIMIT 20), x AS (SELECT * FROM sc WHERE col_id IN (SELECT col_id FROM t)),
        k AS (SELECT p.col_id AS a, q.col_id AS b, count(*) AS n FROM x p JOIN x q ON p.row_id = q.row_id GROUP BY 1, 2)
        SELECT u.col_id AS col_a, v.col_id AS col_b, coalesce(n, 0) AS n FROM t u CROSS JOIN t v LEFT JOIN k ON u.col_id = a AND v.col_id = b""",
    "subset_cols_by_feature": f"WITH {_TOK}, s AS (SELECT f, row_number() OVER (ORDER BY hash) - 1 AS c FROM en WHERE length(f) = 4) SELECT c AS col_id, count(*) AS n FROM cell JOIN s ON cell.f = s.f GROUP BY 1",
    "subset_cols_dims": f"WITH {_TOK} SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM en WHERE length(f) = 4) AS n_cols, (SELECT count(*) FROM cell WHERE length(f) = 4) AS nnz",
    "subset_rows": f"""WITH {_TOK}, k AS (SELECT row_id, count(*) AS n FROM cell GROUP BY row_id HAVING count(*) >= 100)
        SELECT count(*) AS n_rows, (SELECT count(*) FROM en) AS n_cols, CAST(coalesce(sum(n), 0) AS BIGINT) AS nnz FROM k""",
    "min_frac_columns": f"WITH {_TOK} SELECT col_id FROM cell GROUP BY col_id, f HAVING count(*) > 0.05 * (SELECT count(*) FROM documents) OR starts_with(f, 'qu')",
    "dict_merge_reverse": f"SELECT {_HASH} AS hash, f AS names FROM ({_split("lang IN ('en', 'EN', 'eng', 'fr', 'FR', 'fra')")})",
    "dict_matching": f"WITH {_TOK} SELECT hash FROM hs WHERE starts_with(f, 'qu') OR length(f) >= 12",
    "dict_contains": f"""SELECT f AS feature, f IN (SELECT f FROM ({_split("lang IN ('en', 'EN', 'eng')")})) AS known FROM ({_split("lang IN ('de', 'DE', 'deu')")})""",
    "mat_vec": f"WITH {_SEL} SELECT doc_id AS row_id, round(coalesce(sum(1.0::DOUBLE / (1 + col_id)), 0), 6) AS value FROM documents LEFT JOIN sc ON doc_id = row_id GROUP BY 1",
    "row_times_matrix": f"WITH {_SEL} SELECT row_id, CAST(j AS INTEGER) AS j, CAST(sum(col_id + j) AS BIGINT) AS value FROM sc, range(3) t(j) GROUP BY 1, 2",
    "outer_plus": f"""WITH {_SEL} SELECT col_id, 0 AS j, count(*) AS value FROM sc GROUP BY 1
        UNION ALL SELECT col_id, 1, CAST(sum(coalesce(page_no, 0)) AS BIGINT) FROM sc JOIN documents ON doc_id = row_id GROUP BY 1""",
    "dot_sparse": f"""WITH {_REC}, k AS (SELECT x.row_id, count(*) AS n FROM e x JOIN e y ON x.row_id + 1 = y.row_id AND x.col_id = y.col_id GROUP BY 1)
        SELECT a.row_id, coalesce(n, 0) AS common FROM r a JOIN r b ON a.row_id + 1 = b.row_id LEFT JOIN k ON k.row_id = a.row_id""",
    "point_lookup": f"""WITH {_REC} SELECT p.row_id, CAST(c AS INTEGER) AS col_id, CAST(e.row_id IS NOT NULL AS BIGINT) AS value
        FROM (SELECT DISTINCT row_id FROM probe_rows) p CROSS JOIN range(50) t(c) LEFT JOIN e ON e.row_id = p.row_id AND e.col_id = c""",
    "matrix_dims": f"WITH {_REC} SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT count(DISTINCT col_id) FROM e) AS n_cols, (SELECT count(*) FROM e) AS nnz",
    "hashed_colsums": "SELECT hash, count(*) AS n FROM (SELECT unnest(list_distinct(col_ids)) AS hash FROM long_vectors) WHERE hash IS NOT NULL GROUP BY hash",
    "topk_group": r"""SELECT lang, feature, n, k AS rank FROM (SELECT lang, feature, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, feature) AS k FROM
        (SELECT lang, feature, count(*) AS n FROM (SELECT coalesce(lang, 'none') AS lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS feature FROM documents) WHERE feature <> '' GROUP BY 1, 2)) WHERE k <= 10""",
    "io_round_trip": f"WITH {_SEL} SELECT se.col_id, count(row_id) AS n FROM se LEFT JOIN sc ON se.col_id = sc.col_id GROUP BY 1",
    "byte_budget": f"""WITH {_SEL}, z AS (SELECT doc_id % 64 AS part, count(DISTINCT doc_id) AS n_rows, count(col_id) AS nnz FROM documents LEFT JOIN sc ON doc_id = row_id GROUP BY 1)
        SELECT part, n_rows, nnz FROM (SELECT *, sum((nnz + n_rows) * 4) OVER (ORDER BY part) AS s FROM z) WHERE s < 100000""",
    "long_to_int": """WITH v AS (SELECT DISTINCT id, unnest(col_ids) AS hash FROM long_vectors)
        SELECT count(*) AS nnz, count(DISTINCT id) AS n_rows, count(DISTINCT hash) - 1 AS last_col FROM v WHERE hash IS NOT NULL""",
}
