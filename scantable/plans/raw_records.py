"""Queries over raw JSON records: nested payloads and drifting files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantable.common import cut, table
from scantable.operators.drift import consistent_table, file_fields, fingerprints, parsed_fields, schema_changes
from scantable.operators.nested import candidate_views, shred
from scantable.plans.registry import query


def _unfold(x: str) -> str:
    """SQL of a list value in whatever form it is written, as a list of JSON."""
    inner = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid(json_extract_string({x}, '$')) THEN CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END)"
    return f"(CASE WHEN {x} IS NULL OR json_type({inner}) = 'NULL' THEN [] WHEN json_type({inner}) = 'ARRAY' THEN json_extract({inner}, '$[*]') ELSE [{inner}] END)"


VIEWS = f"""WITH r AS (SELECT payload_id, CAST(payload AS JSON) AS j FROM report_payloads WHERE json_valid(payload)), t AS (SELECT payload_id, CASE WHEN json_type(j -> '$.payload') = 'OBJECT' THEN j -> '$.payload' ELSE j END AS j FROM r),
    s AS (SELECT payload_id, j ->> '$.scene_name' AS scene, j -> '$.candidates' AS c, j -> '$.scene_reports' AS sr FROM t WHERE json_type(j) = 'OBJECT'),
    k AS (SELECT payload_id, unnest(json_keys(sr)) AS name, sr FROM s WHERE json_type(sr) = 'OBJECT'), a AS (SELECT payload_id, name, json_extract(sr, '$."' || name || '"') AS rep FROM k
        UNION ALL SELECT payload_id, NULL, unnest(json_extract(sr, '$[*]')) FROM s WHERE json_type(sr) = 'ARRAY'),
    b AS (SELECT payload_id, coalesce(rep ->> '$.scene_name', name) AS scene, CASE WHEN coalesce(json_type(rep -> '$.applied'), 'NULL') <> 'NULL' THEN rep -> '$.applied' ELSE rep -> '$.fusion.applied' END AS c FROM a),
    l AS (SELECT payload_id, scene, 'candidates' AS section, {_unfold('c')} AS items FROM s UNION ALL SELECT payload_id, scene, 'applied', {_unfold('c')} FROM b),
    i AS (SELECT payload_id, scene, section, unnest(items) AS item, unnest(range(len(items))) AS item_pos FROM l), n AS (SELECT payload_id, section, item_pos, item, coalesce(item ->> '$.scene_name', scene) AS scene_name FROM i WHERE json_type(item) <> 'NULL'),
    v AS (SELECT *, CASE WHEN coalesce(json_type(item -> '$.support_views'), 'NULL') <> 'NULL' THEN item -> '$.support_views' ELSE item -> '$.support.support_views' END AS w FROM n), x AS (SELECT *, {_unfold('w')} AS views FROM v),
    y AS (SELECT payload_id, scene_name, section, item_pos, unnest(views) AS view, unnest(range(len(views))) AS view_pos FROM x)
    SELECT payload_id, scene_name, section, CAST(item_pos AS INT) AS item_pos, -1 AS view_pos FROM n UNION ALL SELECT payload_id, scene_name, section, CAST(item_pos AS INT), CAST(view_pos AS INT) FROM y WHERE json_type(view) <> 'NULL'"""

FIELDS = """l AS (SELECT file_id, line_no, CAST(raw_record AS JSON) AS j FROM candidate_file_rows WHERE json_valid(raw_record)), o AS (SELECT * FROM l WHERE json_type(j) = 'OBJECT'),
    e AS (SELECT file_id, line_no, nullif(regexp_replace(j ->> '$.candidate_id', '[^0-9]', '', 'g'), '') AS cand, unnest(json_keys(j)) AS field, j FROM o), v AS (SELECT file_id, line_no, cand, field, json_extract(j, '$."' || field || '"') AS v FROM e),
    f AS (SELECT file_id, line_no, cand, field, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS type, v FROM v),
    y AS (SELECT file_id, field, type, count(*) AS n FROM f GROUP BY 1, 2, 3), known AS (SELECT file_id, field, first(type ORDER BY n DESC, type) FILTER (WHERE type IS NOT NULL) AS type FROM y GROUP BY 1, 2)"""

CHANGES = f"""WITH {FIELDS}, p AS (SELECT * FROM (SELECT file_id, lag(file_id) OVER (PARTITION BY series_name ORDER BY exported_at, file_id) AS prev FROM candidate_files WHERE series_name IS NOT NULL AND exported_at IS NOT NULL) WHERE prev IS NOT NULL),
    a AS (SELECT p.file_id, p.prev, field, type FROM known k JOIN p USING (file_id)), b AS (SELECT p.file_id, p.prev, field, type FROM known k JOIN p ON p.prev = k.file_id),
    g AS (SELECT * FROM b ANTI JOIN a USING (file_id, field)), c AS (SELECT * FROM a ANTI JOIN b USING (file_id, field)),
    w AS (SELECT g.file_id AS pair, f.cand, f.field, arg_min(CASE WHEN f.type = 'number' THEN CAST(CAST(f.v AS DOUBLE) AS VARCHAR) WHEN f.type IS NOT NULL THEN f.type || CAST(f.v AS VARCHAR) END, f.line_no) AS val, 'o' AS side FROM f JOIN g ON g.prev = f.file_id AND g.field = f.field WHERE f.cand IS NOT NULL GROUP BY 1, 2, 3
        UNION ALL SELECT c.file_id, f.cand, f.field, arg_min(CASE WHEN f.type = 'number' THEN CAST(CAST(f.v AS DOUBLE) AS VARCHAR) WHEN f.type IS NOT NULL THEN f.type || CAST(f.v AS VARCHAR) END, f.line_no), 'n' FROM f JOIN c ON c.file_id = f.file_id AND c.field = f.field WHERE f.cand IS NOT NULL GROUP BY 1, 2, 3),
    m AS (SELECT x.pair, x.field AS o, y.field AS n, count(*) AS k, count(*) FILTER (WHERE x.val = y.val) AS same FROM w x JOIN w y ON x.pair = y.pair AND x.cand = y.cand AND x.side = 'o' AND y.side = 'n' WHERE x.val IS NOT NULL AND y.val IS NOT NULL GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY pair, o ORDER BY same / k::DOUBLE DESC, k DESC, o, n) AS i, row_number() OVER (PARTITION BY pair, n ORDER BY same / k::DOUBLE DESC, k DESC, o, n) AS j FROM m WHERE same * 2 > k), q AS (SELECT pair AS file_id, o, n FROM r WHERE i = 1 AND j = 1)
    SELECT file_id, 'renamed' AS change_kind, o AS old_field, n AS new_field FROM q UNION ALL SELECT file_id, 'removed', field, '' FROM g WHERE (file_id, field) NOT IN (SELECT (file_id, o) FROM q) UNION ALL SELECT file_id, 'added', '', field FROM c WHERE (file_id, field) NOT IN (SELECT (file_id, n) FROM q)
    UNION ALL SELECT a.file_id, 'type_changed', a.field, a.field FROM a JOIN b USING (file_id, field) WHERE a.type <> b.type"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "report_payloads").select("payload_id", "payload")


@query(VIEWS)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of candidates and applied, and their support views, as flat rows."""
    return candidate_views(_payloads(spark, sf_dir), "payload_id", "payload").withColumnRenamed("id", "payload_id")


@query()
def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every payload, linked to its container."""
    return shred(_payloads(spark, sf_dir), "payload_id", "payload").withColumnRenamed("id", "payload_id")


@query(CHANGES)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema changes of each candidate file against the one before it."""
    return schema_changes(table(spark, sf_dir, "candidate_files"), table(spark, sf_dir, "candidate_file_rows"))


@query()
def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all candidate files in one consistent table."""
    files, rows = table(spark, sf_dir, "candidate_files"), table(spark, sf_dir, "candidate_file_rows")
    return consistent_table(files, rows).withColumn("others", F.to_json("others"))


_UNIFIED = "(CASE WHEN replace({0}, '_', '') IN ('sourcejson', 'candidatesourcejson', 'sourcepath') THEN 'source_path' ELSE {0} END)".format(
    r"regexp_replace(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '^_+|_+$', '', 'g')"
)
# renames chained file by file to the last one; names that renames link are one, under the name most files use
CORE = (
    CHANGES.split("\n    SELECT file_id, 'renamed'")[0].replace("WITH", "WITH RECURSIVE", 1)
    + f""", nx AS (SELECT prev AS file_id, file_id AS next_id FROM p), hop AS (SELECT k.file_id, k.field, nx.next_id, coalesce(q.n, k.field) AS nf FROM known k JOIN nx USING (file_id) LEFT JOIN q ON q.file_id = nx.next_id AND q.o = k.field),
    lk AS (SELECT h.* FROM hop h SEMI JOIN known k2 ON k2.file_id = h.next_id AND k2.field = h.nf), wk(file_id, field, last_id, nm) AS (SELECT file_id, field, file_id, field FROM known UNION ALL SELECT w2.file_id, w2.field, l2.next_id, l2.nf FROM wk w2 JOIN lk l2 ON l2.file_id = w2.last_id AND l2.field = w2.nm),
    fin AS (SELECT file_id, field, {_UNIFIED.format('nm')} AS name FROM wk ANTI JOIN lk ON lk.file_id = wk.last_id AND lk.field = wk.nm), used AS (SELECT {_UNIFIED.format('field')} AS name, count(*) AS k FROM known GROUP BY 1), al AS (SELECT DISTINCT {_UNIFIED.format('o')} AS a, {_UNIFIED.format('n')} AS b FROM q),
    ed AS (SELECT a, b FROM al UNION SELECT b, a FROM al), rc(name, g) AS (SELECT name, name FROM used UNION SELECT ed.b, rc.g FROM rc JOIN ed ON ed.a = rc.name), rep AS (SELECT rc.name, first(g ORDER BY coalesce(used.k, 0) DESC, g) AS best FROM rc LEFT JOIN used ON used.name = rc.g GROUP BY 1),
    ln AS (SELECT f.file_id, f.line_no, f.cand, coalesce(rep.best, fin.name) AS name, f.field, f.type, CASE WHEN f.type = 'string' THEN f.v ->> '$' WHEN f.type IS NOT NULL THEN CAST(f.v AS VARCHAR) END AS t, TRY_CAST(f.v ->> '$.value' AS DOUBLE) AS inn FROM f JOIN fin USING (file_id, field) LEFT JOIN rep ON rep.name = fin.name),
    pk AS (SELECT file_id, line_no, name, first(struct_pack(t := t, inn := inn) ORDER BY type IS NULL, field) AS e FROM ln GROUP BY 1, 2, 3), tl AS (SELECT o.file_id, o.line_no, nullif(regexp_replace(o.j ->> '$.candidate_id', '[^0-9]', '', 'g'), '') AS cand FROM o),
    pv AS (SELECT file_id, line_no, """
    + ", ".join(f"max(CASE WHEN name = '{n}' THEN e.t END) AS {n}" for n in ("scene_name", "source_path", "class_name", "score", "support_view_count", "num_seed_points"))
    + """, max(CASE WHEN name = 'score' THEN e.inn END) AS inn FROM pk GROUP BY 1, 2)
    SELECT tl.file_id, tl.line_no, TRY_CAST(cand AS BIGINT) AS candidate_id, scene_name, source_path, class_name, coalesce(TRY_CAST(score AS DOUBLE), inn) AS score, CASE WHEN regexp_full_match(support_view_count, '[+-]?[0-9]+') THEN TRY_CAST(support_view_count AS INT) END AS support_view_count,
        CASE WHEN regexp_full_match(num_seed_points, '[+-]?[0-9]+') THEN TRY_CAST(num_seed_points AS INT) END AS num_seed_points FROM tl LEFT JOIN pv USING (file_id, line_no)"""
)

VERSIONS = f"""WITH {FIELDS}, h AS (SELECT file_id, sha256('[' || string_agg('{{"field":' || to_json(field) || coalesce(',"type":"' || type || '"', '') || '}}', ',' ORDER BY field) || ']') AS fingerprint, count(*) AS n_fields FROM known GROUP BY 1),
    n AS (SELECT file_id, series_name, exported_at, fingerprint, coalesce(n_fields, 0) AS n_fields, row_number() OVER w AS i, lag(fingerprint) OVER w AS before FROM candidate_files LEFT JOIN h USING (file_id) WINDOW w AS (PARTITION BY series_name ORDER BY exported_at NULLS FIRST, file_id))
    SELECT file_id, series_name, sum(CASE WHEN i = 1 THEN CASE WHEN fingerprint IS NULL THEN 0 ELSE 1 END WHEN fingerprint IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY series_name ORDER BY i) AS version, fingerprint, n_fields FROM n"""


@query(CORE)
def p4_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of that table which have a type of their own."""
    return p4_table(spark, sf_dir).drop("others", "series_name")


@query(VERSIONS)
def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema fingerprint and version of every file."""
    files, rows = table(spark, sf_dir, "candidate_files"), table(spark, sf_dir, "candidate_file_rows")
    return fingerprints(files, cut(file_fields(parsed_fields(rows))))
