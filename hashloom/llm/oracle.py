"""SQL for the queries of the subpackage."""

_SETS = """s AS (SELECT DISTINCT id, s FROM (SELECT id, list_sort(list_distinct(list_filter(
        CASE WHEN start_idx IS NULL AND end_idx IS NULL THEN col_ids ELSE col_ids[coalesce(start_idx, 0) + 1 : coalesce(end_idx, len(col_ids))] END,
        lambda x: x IS NOT NULL))) AS s FROM long_vectors WHERE id IS NOT NULL) WHERE len(s) > 0),
f AS (SELECT id, len(s) AS n, unnest(s) AS c FROM s),
p AS (SELECT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.c = b.c AND a.id < b.id AND b.n >= 0.75 * a.n AND a.n >= 0.75 * b.n
      GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*)))"""

_NAMES = """n AS (SELECT lower(trim(x.name)) AS name, x.cnt AS cnt FROM
      (SELECT unnest(names_and_counts) AS x FROM (SELECT DISTINCT ON (row_id) row_id, names_and_counts FROM dictionary_rows WHERE row_id IS NOT NULL)))"""

_BLOCKS = """b AS (SELECT DISTINCT ON (block_id) * FROM matrix_blocks WHERE block_id IS NOT NULL AND n_rows > 0),
r AS (SELECT first_row_id + i AS row_id, col_ids[row_start_idx[i + 1] + 1 : row_start_idx[i + 2]] AS cols FROM (SELECT *, unnest(range(n_rows)) AS i FROM b)),
e AS (SELECT row_id, unnest(cols) AS col_id FROM r),
t AS (SELECT row_id, col_id, count(*) AS tf FROM e GROUP BY row_id, col_id),
c AS (SELECT col_id, sum(tf) AS col_total, count(*) AS df FROM t GROUP BY col_id),
nn AS (SELECT count(*) AS n_records FROM r)"""

_PAIRS = """pr AS (SELECT x.col_id AS col_a, y.col_id AS col_b, count(*) AS n FROM t x JOIN t y ON x.row_id = y.row_id AND x.col_id < y.col_id GROUP BY 1, 2),
sc AS (SELECT CAST(col_a AS BIGINT) AS col_a, CAST(col_b AS BIGINT) AS col_b, n, a.df AS n_a, b.df AS n_b, n_records FROM pr JOIN c a ON col_a = a.col_id JOIN c b ON col_b = b.col_id, nn)"""

_FREQ = f"""{_BLOCKS},
dr AS (SELECT DISTINCT ON (row_id) row_id, names_and_counts FROM dictionary_count_rows WHERE row_id IS NOT NULL),
nm AS (SELECT row_id, lower(trim(x.name)) AS item FROM (SELECT row_id, unnest(names_and_counts) AS x FROM dr)),
fr AS (SELECT 'matrix_blocks.col_ids' AS field, CAST(col_id AS VARCHAR) AS item, CAST(col_total AS BIGINT) AS total, df AS records,
         CASE WHEN df < 3 THEN 'rare' WHEN df > 0.2 * n_records THEN 'common' END AS mark FROM c, nn
       UNION ALL SELECT 'dictionary_count_rows.names_and_counts', item, count(*), count(DISTINCT row_id),
         CASE WHEN count(DISTINCT row_id) < 3 THEN 'rare' WHEN count(DISTINCT row_id) > 0.05 * (SELECT count(*) FROM dr) THEN 'common' END
       FROM nm WHERE item IS NOT NULL GROUP BY item)"""

_UNIT = "('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0"

ORACLE = {
    "p1_found": f"WITH {_SETS} SELECT id_a, id_b FROM p",
    "p1_classes": f"""WITH {_SETS}, l AS (SELECT id, count(*) AS links FROM (SELECT id_a AS id FROM p UNION ALL SELECT id_b FROM p) GROUP BY id)
        SELECT s.id, min(s.id) OVER (PARTITION BY s.s) AS class_id, coalesce(l.links, 0) AS links FROM s LEFT JOIN l ON s.id = l.id""",
    "p1_between": """WITH s AS (SELECT DISTINCT id, w, s FROM (SELECT id, load_no = (SELECT max(load_no) FROM long_vectors) AS w, list_sort(list_distinct(list_filter(
        CASE WHEN start_idx IS NULL AND end_idx IS NULL THEN col_ids ELSE col_ids[coalesce(start_idx, 0) + 1 : coalesce(end_idx, len(col_ids))] END,
        lambda x: x IS NOT NULL))) AS s FROM long_vectors WHERE id IS NOT NULL AND load_no IS NOT NULL) WHERE len(s) > 0),
        f AS (SELECT id, w, len(s) AS n, unnest(s) AS c FROM s)
        SELECT a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.c = b.c AND a.w AND NOT b.w AND b.n >= 0.75 * a.n AND a.n >= 0.75 * b.n
        GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.75 * (a.n + b.n - count(*))""",
    "p2_found": f"""WITH {_NAMES} SELECT name FROM (SELECT name, sum(cnt) AS c FROM n WHERE name IS NOT NULL AND cnt > 0 GROUP BY name)
        WHERE c >= 0.005 * (SELECT sum(cnt) FROM n WHERE name IS NOT NULL AND cnt > 0)""",
    "p4_found": f"""WITH {_BLOCKS} SELECT row_id, CAST(col_id AS BIGINT) AS col_id FROM (
        SELECT row_id, col_id, row_number() OVER (PARTITION BY row_id ORDER BY round(tf * ln(n_records / df), 9) DESC, col_id) AS k
        FROM t JOIN c USING (col_id), nn WHERE df >= 2 AND row_id IN (SELECT row_id FROM probe_rows)) WHERE k = 1""",
    "p4_residuals": f"""WITH {_BLOCKS}, q AS (SELECT row_id, sum(tf) AS row_total FROM t GROUP BY row_id), s AS (SELECT sum(tf) AS n FROM t),
        x AS (SELECT row_id, col_id, tf, df, CAST(row_total AS DOUBLE) AS r, CAST(col_total AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n FROM t JOIN c USING (col_id) JOIN q USING (row_id), s)
        SELECT row_id, CAST(col_id AS BIGINT) AS col_id, tf, df, round((tf - r * k / n) / sqrt(r * k / n), 6) AS residual,
        round((tf - r * k / n) / sqrt(r * k / n) / sqrt((1 - r / n) * (1 - k / n)), 6) AS adjusted FROM x""",
    "p5_found": f"WITH {_BLOCKS}, {_PAIRS} SELECT col_a, col_b FROM sc WHERE n >= 5 AND n >= 0.002 * n_records AND n * n_records >= 4 * n_a * n_b",
    "p5_scores": f"""WITH {_BLOCKS}, {_PAIRS} SELECT col_a, col_b, n, round(n * CAST(n_records AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 6) AS lift,
        round(ln(n * CAST(n_records AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE))) / -ln(n / CAST(n_records AS DOUBLE)), 6) AS npmi FROM sc WHERE n >= 5""",
    "p5_pairs": f"""WITH {_BLOCKS}, {_PAIRS} SELECT col_a, col_b, n, round(n * CAST(n_records AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 6) AS lift,
        round(CASE WHEN n >= n_records THEN 1.0 ELSE ln(n * CAST(n_records AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE))) / -ln(n / CAST(n_records AS DOUBLE)) END, 6) AS npmi FROM sc""",
    "p5_after_changes": f"""WITH {_BLOCKS},
        fw AS (SELECT block_id, min(written_at) AS w FROM matrix_blocks WHERE block_id IS NOT NULL GROUP BY 1),
        cut AS (SELECT w AS c FROM (SELECT w, row_number() OVER (ORDER BY w) AS k, count(w) OVER () AS m FROM fw WHERE w IS NOT NULL) WHERE k = greatest(1, ceil(m * 0.5))),
        rr AS (SELECT row_id, cols, coalesce(w > c, false) AS late FROM (SELECT block_id, first_row_id + i AS row_id, col_ids[row_start_idx[i + 1] + 1 : row_start_idx[i + 2]] AS cols
               FROM (SELECT *, unnest(range(n_rows)) AS i FROM b)) JOIN fw USING (block_id), cut),
        v AS (SELECT 0 AS v, row_id, CASE WHEN late THEN cols[1 : CAST(ceil(len(cols) / 2.0) AS BIGINT)] ELSE cols END AS cols FROM rr
              UNION ALL SELECT 1, row_id, cols FROM rr WHERE row_id NOT IN (SELECT row_id FROM probe_rows)),
        vt AS (SELECT DISTINCT v, row_id, unnest(cols) AS col_id FROM v),
        vd AS (SELECT col_id, count(*) FILTER (v = 0) AS d0, count(*) FILTER (v = 1) AS d1 FROM vt GROUP BY 1),
        vp AS (SELECT x.col_id AS p, y.col_id AS q, count(*) FILTER (x.v = 0) AS n0, count(*) FILTER (x.v = 1) AS n1
               FROM vt x JOIN vt y ON x.v = y.v AND x.row_id = y.row_id AND x.col_id < y.col_id GROUP BY 1, 2)
        SELECT CAST(p AS BIGINT) AS col_a, CAST(q AS BIGINT) AS col_b, n1 AS n, round(n1 * CAST((SELECT count(*) FROM v WHERE v = 1) AS DOUBLE) / (e.d1 * CAST(g.d1 AS DOUBLE)), 6) AS lift
        FROM vp JOIN vd e ON p = e.col_id JOIN vd g ON q = g.col_id WHERE n1 > 0 AND (n0 <> n1 OR e.d0 <> e.d1 OR g.d0 <> g.d1)""",
    "p6_found": f"WITH {_FREQ} SELECT field, item, mark FROM fr WHERE mark IS NOT NULL",
    "p6_frequencies": f"WITH {_FREQ} SELECT field, item, total, records, mark FROM fr",
    "p7_sample": f"SELECT id, min(load_no) AS first_load FROM long_vectors WHERE id IS NOT NULL AND {_UNIT} < 0.1 GROUP BY id",
    "p7_weighted": f"""SELECT id, max(w) AS weight FROM (SELECT id, len(list_distinct(list_filter(
        CASE WHEN start_idx IS NULL AND end_idx IS NULL THEN col_ids ELSE col_ids[coalesce(start_idx, 0) + 1 : coalesce(end_idx, len(col_ids))] END, lambda x: x IS NOT NULL))) AS w
        FROM long_vectors WHERE id IS NOT NULL) GROUP BY id HAVING {_UNIT} < max(w) * CAST(0.005 AS DOUBLE)""",
}
