"""Queries of the general training-data operators (p1 to p7) over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import delivery, drift, hierarchy, intervals, nested, orphans, skew
from weftline.session import table


def _intervals(spark, d):
    return intervals.periods_and_gaps(table(spark, d, "task_runs"), "run_id", "started_at_ms", "finished_at_ms")


def _profile(spark, d):
    return skew.per_key_profile(table(spark, d, "runs"), ["tenant", "def_name"])


def _columns(spark, d):
    """The flat tables with columns in place of their JSON: the text of a text, the number of fields of an object."""
    rows, value = nested.flat_rows(spark, d), F.col("value")
    text = F.when(F.startswith(value, F.lit('"')), F.try_variant_get(F.try_parse_json(value), "$", "string"))
    return rows.select("parent_key", "child", "child_path", "parent_path", text.alias("text"), F.size(F.json_object_keys(value)).alias("n_fields")).distinct()


QUERIES = {
    "p1_found": lambda spark, d: delivery.repeated_rows(table(spark, d, "run_events")),
    "p1_kept": lambda spark, d: delivery.kept_rows(table(spark, d, "run_events")).select("seq", "run_id", "status"),
    "p2_found": lambda spark, d: drift.changes_found(table(spark, d, "workflows")),
    "p2_table": lambda spark, d: drift.consistent_table(table(spark, d, "workflows")),
    "p2_columns": lambda spark, d: drift.consistent_table(table(spark, d, "workflows")).select(
        "tenant", "name", "version", "exporter", "file_no", "readable", "description", "timeout_ms", "n_tasks"
    ),
    "p3_found": lambda spark, d: nested.flat_rows(spark, d, with_values=False),
    "p3_tables": lambda spark, d: nested.flat_rows(spark, d),
    "p3_columns": _columns,
    "p4_found": lambda spark, d: hierarchy.cyclic_nodes(hierarchy.hierarchies(table(spark, d, "ml_training"))),
    "p4_tree": lambda spark, d: hierarchy.hierarchies(table(spark, d, "ml_training")).select(
        "tenant", "def_name", "name", "parent", "path", "depth", "root", "n_descendants", "cycle_head"
    ),
    "p4_descendants": lambda spark, d: hierarchy.descendant_pairs(table(spark, d, "ml_training")),
    "p5_found": lambda spark, d: orphans.orphans_found(spark, d).drop("loaded_us"),
    "p5_report": orphans.orphan_report,
    "p6_found": lambda spark, d: _intervals(spark, d).withColumnRenamed("entity", "run_id"),
    "p7_found": lambda spark, d: skew.heavy_keys(_profile(spark, d)),
    "p7_profile": _profile,
}


_MESSAGES = r"""
base AS (
  SELECT seq, nullif(regexp_replace(lower(id), '^\s+|\s+$', '', 'g'), '') AS nid, run_id, lower(trim(kind)) AS k FROM run_events
),
named AS (SELECT run_id, k, min(nid) AS nid FROM base WHERE nid IS NOT NULL GROUP BY 1, 2),
ranked AS (
  SELECT seq, row_number() OVER (PARTITION BY coalesce(b.nid, n.nid, 'none:' || b.run_id || ':' || b.k) ORDER BY seq) AS r
  FROM base b LEFT JOIN named n ON b.run_id = n.run_id AND b.k = n.k
)
"""

_FLAT = r"""
wf AS (
  SELECT concat_ws('/', tenant, name, version) AS parent_key,
         CASE WHEN json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END AS doc
  FROM workflows WHERE json_valid(document)
),
rn AS (
  SELECT id AS parent_key,
         CASE WHEN json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END AS doc
  FROM runs WHERE json_valid(document)
),
task AS (
  SELECT parent_key, key AS i, value AS body FROM (SELECT parent_key, doc::JSON AS doc FROM wf WHERE json_valid(doc)), json_each(doc, '$.tasks')
  WHERE type = 'OBJECT'
),
dep_field AS (
  SELECT parent_key, i, coalesce(nullif(body->'$.depends_on', 'null'), nullif(body->'$.dependsOn', 'null'), nullif(body->'$.needs', 'null')) AS deps
  FROM task
),
dep_names AS (
  SELECT parent_key, i,
         CASE json_type(deps)
           WHEN 'ARRAY' THEN (deps->>'$[*]')
           WHEN 'VARCHAR' THEN list_filter(list_transform(string_split(deps->>'$', ','), lambda x: trim(x)), lambda x: x <> '')
         END AS names
  FROM dep_field
),
failure AS (
  SELECT parent_key, coalesce(
    doc->'$.hooks.on_failure', doc->'$.hooks.onFailure', doc->'$.hooks.on_error',
    doc->'$.notifications.on_failure', doc->'$.notifications.onFailure', doc->'$.notifications.on_error') AS f
  FROM (SELECT parent_key, doc::JSON AS doc FROM wf WHERE json_valid(doc))
),
hook AS (
  SELECT parent_key, key AS i, value AS body
  FROM (SELECT parent_key, CASE json_type(f) WHEN 'OBJECT' THEN json_array(f) ELSE f END AS f FROM failure WHERE json_type(f) IN ('OBJECT', 'ARRAY')), json_each(f)
),
artifacts AS (
  SELECT parent_key, CASE json_type(value) WHEN 'OBJECT' THEN json_array(value) ELSE value END AS a
  FROM (SELECT parent_key, doc::JSON AS doc FROM rn WHERE json_valid(doc)), json_tree(doc, '$.output')
  WHERE key = 'artifacts' AND json_type(value) IN ('OBJECT', 'ARRAY')
),
artifact AS (SELECT parent_key, key AS i, value AS body FROM artifacts, json_each(a)),
part AS (
  SELECT parent_key, i, key AS j, value AS body
  FROM (SELECT parent_key, i, body->'$.parts' AS parts FROM artifact WHERE json_type(body->'$.parts') = 'ARRAY'), json_each(parts)
)
"""

_WALK = """
current AS (
  SELECT tenant, def_name, name, list_filter(d, lambda x: x IS NOT NULL AND x <> '')[1] AS p0
  FROM (SELECT tenant, def_name, name, arg_max(coalesce(depends_on, []), updated_at_ms) AS d FROM ml_training GROUP BY 1, 2, 3)
),
linked AS (
  SELECT a.tenant, a.def_name, a.name, b.name AS parent
  FROM current a LEFT JOIN current b ON a.tenant = b.tenant AND a.def_name = b.def_name AND a.p0 = b.name
),
sizes AS (SELECT tenant, def_name, count(*) AS n FROM linked GROUP BY 1, 2),
walk AS (
  SELECT tenant, def_name, name, parent AS anc, 1 AS i FROM linked WHERE parent IS NOT NULL
  UNION ALL
  SELECT w.tenant, w.def_name, w.name, l.parent, w.i + 1
  FROM walk w JOIN linked l ON w.tenant = l.tenant AND w.def_name = l.def_name AND w.anc = l.name
  JOIN sizes s ON s.tenant = w.tenant AND s.def_name = w.def_name
  WHERE l.parent IS NOT NULL AND w.i < s.n
),
cyclic AS (
  SELECT w.tenant, w.def_name, w.name, w.anc FROM walk w JOIN sizes s ON s.tenant = w.tenant AND s.def_name = w.def_name WHERE w.i = s.n
),
heads AS (
  SELECT c.tenant, c.def_name, c.name, min(w.anc) AS cycle_head
  FROM cyclic c JOIN walk w ON w.tenant = c.tenant AND w.def_name = c.def_name AND w.name = c.anc GROUP BY 1, 2, 3
),
above AS (
  SELECT w.* FROM walk w LEFT JOIN cyclic c ON c.tenant = w.tenant AND c.def_name = w.def_name AND c.name = w.name WHERE c.name IS NULL
)
"""

_PROFILE = """
SELECT key_column, key_value, count(*) AS n_rows, min(created_at_ms) AS first_ms, max(created_at_ms) AS last_ms,
       max(gap) AS max_gap_ms, coalesce(max(streak), 0) AS longest_failed
FROM (
  SELECT *, CASE WHEN marked THEN count(*) FILTER (marked) OVER (PARTITION BY key_column, key_value, island) ELSE 0 END AS streak
  FROM (
    SELECT *, created_at_ms - lag(created_at_ms) OVER (PARTITION BY key_column, key_value ORDER BY created_at_ms, id, status) AS gap,
           sum(CASE WHEN marked THEN 0 ELSE 1 END) OVER (PARTITION BY key_column, key_value ORDER BY created_at_ms, id, status ROWS UNBOUNDED PRECEDING) AS island
    FROM (
      SELECT 'tenant' AS key_column, tenant AS key_value, created_at_ms, id, status, status = 'failed' AS marked FROM runs
      UNION ALL
      SELECT 'def_name', def_name, created_at_ms, id, status, status = 'failed' FROM runs
    )
  )
) GROUP BY 1, 2
"""

_ORPHANS = """
task_refs AS (SELECT id, run_id, min(min(loaded_at)) OVER (PARTITION BY id) AS seen FROM task_runs GROUP BY id, run_id),
run_refs AS (
  SELECT id, tenant, def_name, def_version, min(min(loaded_at)) OVER (PARTITION BY id) AS seen FROM runs GROUP BY id, tenant, def_name, def_version
),
run_keys AS (SELECT id, min(loaded_at) AS first_at, max(deleted_at) AS gone FROM runs GROUP BY id),
wf_keys AS (SELECT tenant, name, version, min(loaded_at) AS first_at, max(deleted_at) AS gone FROM workflows GROUP BY 1, 2, 3),
wf_names AS (SELECT DISTINCT tenant, name FROM workflows),
orphans AS (
  SELECT 'task_runs' AS ref_table, t.id AS ref_id, 'run_id' AS ref_field, t.seen,
         CASE WHEN k.id IS NULL THEN 'missing' WHEN k.gone IS NOT NULL THEN 'deleted' WHEN k.first_at > t.seen THEN 'late' END AS orphan_kind
  FROM task_refs t LEFT JOIN run_keys k ON t.run_id = k.id WHERE t.run_id IS NOT NULL
  UNION ALL
  SELECT 'runs', r.id, CASE WHEN n.name IS NULL THEN 'def_name' ELSE 'def_version' END, r.seen,
         CASE WHEN k.name IS NULL THEN 'missing' WHEN k.gone IS NOT NULL THEN 'deleted' WHEN k.first_at > r.seen THEN 'late' END
  FROM run_refs r
  LEFT JOIN wf_keys k ON r.tenant = k.tenant AND r.def_name = k.name AND r.def_version = k.version
  LEFT JOIN wf_names n ON r.tenant = n.tenant AND r.def_name = n.name
  WHERE r.tenant IS NOT NULL AND r.def_name IS NOT NULL AND r.def_version IS NOT NULL
)
"""

_DRIFT = r"""
docs AS (
  SELECT row_number() OVER () AS d, * FROM (
    SELECT DISTINCT exporter, file_no, tenant, name, version, doc::JSON AS doc FROM (
      SELECT *, CASE WHEN json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END AS doc FROM workflows WHERE json_valid(document)
    ) WHERE json_valid(doc))
),
nodes AS MATERIALIZED (SELECT d, t.id AS n, t.parent AS p, t.key AS k, t.type AS ty, coalesce(t.value::VARCHAR, 'null') AS v FROM docs, json_tree(doc) t),
walk AS (
  SELECT d, n, ty, v, '' AS path, false AS named, false AS shut FROM nodes WHERE p IS NULL
  UNION ALL
  SELECT c.d, c.n, c.ty, c.v, CASE WHEN w.ty <> 'OBJECT' THEN w.path WHEN w.path = '' THEN c.k ELSE w.path || '.' || c.k END, w.ty = 'OBJECT',
         w.ty = 'OBJECT' AND c.k IN ('input', 'meta', 'annotations', 'tags', 'labels', 'headers')
  FROM walk w JOIN nodes c ON c.d = w.d AND c.p = w.n WHERE NOT w.shut
),
fields AS MATERIALIZED (
  SELECT exporter, file_no, tenant, name, version, d, n, path, regexp_replace(path, '(^|\.)[^.]*$', '') AS above, v,
         CASE ty WHEN 'NULL' THEN NULL WHEN 'BOOLEAN' THEN 'b' WHEN 'VARCHAR' THEN 's' WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' ELSE 'n' END AS kind
  FROM walk JOIN docs USING (d) WHERE named
),
files AS (SELECT exporter, file_no, lag(file_no) OVER (PARTITION BY exporter ORDER BY file_no) AS before FROM (SELECT DISTINCT exporter, file_no FROM docs)),
shapes AS (SELECT exporter, file_no, path, above, coalesce(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), []) AS kinds FROM fields GROUP BY 1, 2, 3, 4),
sides AS (
  SELECT f.exporter, f.file_no, f.before, 'old' AS side, s.path, s.above, s.kinds FROM files f JOIN shapes s ON s.exporter = f.exporter AND s.file_no = f.before
  UNION ALL
  SELECT f.exporter, f.file_no, f.before, 'new', s.path, s.above, s.kinds FROM files f JOIN shapes s ON s.exporter = f.exporter AND s.file_no = f.file_no WHERE f.before IS NOT NULL
),
single AS (
  SELECT a.* FROM sides a ANTI JOIN sides b ON b.exporter = a.exporter AND b.file_no = a.file_no AND b.side <> a.side AND b.path = a.path
  WHERE a.above = '' OR EXISTS (SELECT 1 FROM sides c WHERE c.exporter = a.exporter AND c.file_no = a.file_no AND c.side <> a.side AND c.path = a.above)
),
shown AS (SELECT exporter, file_no, tenant, name, path, list(v ORDER BY version, d, n) AS vs FROM fields GROUP BY 1, 2, 3, 4, 5),
held AS (SELECT DISTINCT exporter, file_no, tenant, name FROM docs),
agreed AS (
  SELECT o.exporter, o.file_no, o.path AS old_path, w.path AS new_path, sum(CASE WHEN x.vs = y.vs THEN 1 ELSE 0 END) / count(*) AS share
  FROM single o JOIN single w ON w.exporter = o.exporter AND w.file_no = o.file_no AND w.above = o.above AND o.side = 'old' AND w.side = 'new'
  JOIN shown x ON x.exporter = o.exporter AND x.file_no = o.before AND x.path = o.path
  JOIN held h ON h.exporter = o.exporter AND h.file_no = o.file_no AND h.tenant = x.tenant AND h.name = x.name
  LEFT JOIN shown y ON y.exporter = o.exporter AND y.file_no = o.file_no AND y.path = w.path AND y.tenant = x.tenant AND y.name = x.name
  GROUP BY 1, 2, 3, 4 HAVING 2 * sum(CASE WHEN x.vs = y.vs THEN 1 ELSE 0 END) >= count(*)
),
renamed AS (
  SELECT exporter, file_no, old_path, new_path FROM (
    SELECT *, row_number() OVER (PARTITION BY exporter, file_no, old_path ORDER BY share DESC, new_path) AS a, row_number() OVER (PARTITION BY exporter, file_no, new_path ORDER BY share DESC, old_path) AS b FROM agreed
  ) WHERE a = 1 AND b = 1
),
changes AS (
  SELECT exporter, file_no, 'renamed' AS change_kind, old_path, new_path FROM renamed
  UNION ALL SELECT exporter, file_no, 'removed', path, path FROM single s WHERE side = 'old' AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.exporter = s.exporter AND r.file_no = s.file_no AND r.old_path = s.path)
  UNION ALL SELECT exporter, file_no, 'added', path, path FROM single s WHERE side = 'new' AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.exporter = s.exporter AND r.file_no = s.file_no AND r.new_path = s.path)
  UNION ALL SELECT o.exporter, o.file_no, 'retyped', o.path, o.path FROM sides o JOIN sides w ON w.exporter = o.exporter AND w.file_no = o.file_no AND w.path = o.path AND o.side = 'old' AND w.side = 'new'
    WHERE len(o.kinds) > 0 AND len(w.kinds) > 0 AND o.kinds <> w.kinds
)
SELECT * FROM changes c WHERE NOT EXISTS (
  SELECT 1 FROM changes r WHERE r.exporter = c.exporter AND r.file_no = c.file_no AND
    CASE WHEN c.change_kind = 'added' THEN r.change_kind <> 'removed' AND starts_with(c.new_path, r.new_path || '.') ELSE r.change_kind <> 'added' AND starts_with(c.old_path, r.old_path || '.') END)
"""

SQL = {
    "p2_columns": """
        SELECT tenant, name, version, exporter, file_no, doc IS NOT NULL AS readable, coalesce(doc->>'$.description', doc->>'$.summary', doc->>'$.desc') AS description,
               CASE json_type(wait) WHEN 'OBJECT' THEN (wait->>'$.value')::BIGINT * map {'ms': 1, 's': 1000, 'sec': 1000, 'm': 60000, 'min': 60000, 'h': 3600000, 'd': 86400000}[wait->>'$.unit']
                 ELSE try_cast(wait->>'$' AS BIGINT) END AS timeout_ms, CASE json_type(doc, '$.tasks') WHEN 'ARRAY' THEN json_array_length(doc, '$.tasks') END::INT AS n_tasks
        FROM (SELECT *, coalesce(nullif(doc->'$.timeout_ms', 'null'), nullif(doc->'$.timeoutMs', 'null'), nullif(doc->'$.deadline_ms', 'null')) AS wait FROM (
          SELECT *, CASE WHEN json_valid(inner_) AND json_type(inner_) = 'OBJECT' THEN inner_::JSON END AS doc FROM (
            SELECT *, CASE WHEN json_valid(document) THEN CASE WHEN json_type(document) = 'VARCHAR' THEN json_extract_string(document, '$') ELSE document END END AS inner_ FROM workflows)))""",
    "p2_found": f"WITH RECURSIVE {_DRIFT}",
    "p1_found": f"WITH {_MESSAGES} SELECT seq FROM ranked WHERE r > 1",
    "p1_kept": f"WITH {_MESSAGES} SELECT e.seq, e.run_id, e.status FROM run_events e JOIN ranked USING (seq) WHERE r = 1",
    "p3_found": f"""WITH {_FLAT}
        SELECT DISTINCT parent_key, 'task' AS child, i::VARCHAR AS child_path FROM task
        UNION ALL SELECT DISTINCT parent_key, 'task_dep', i || '/' || (unnest(range(len(names)))) FROM dep_names
        UNION ALL SELECT DISTINCT parent_key, 'failure_hook', i::VARCHAR FROM hook
        UNION ALL SELECT DISTINCT parent_key, 'hook_header', i || '/' || unnest(json_keys(body->'$.headers')) FROM hook WHERE json_type(body->'$.headers') = 'OBJECT'
        UNION ALL SELECT DISTINCT parent_key, 'artifact', i::VARCHAR FROM artifact
        UNION ALL SELECT DISTINCT parent_key, 'artifact_part', i || '/' || j FROM part""",
    "p3_columns": f"""WITH {_FLAT}, every AS (
          SELECT parent_key, 'task' AS child, i::VARCHAR AS child_path, NULL::VARCHAR AS parent_path, body FROM task
          UNION ALL SELECT parent_key, 'failure_hook', i::VARCHAR, NULL, body FROM hook
          UNION ALL SELECT parent_key, 'hook_header', i || '/' || key, i::VARCHAR, value FROM (SELECT parent_key, i, body->'$.headers' AS headers FROM hook WHERE json_type(body->'$.headers') = 'OBJECT'), json_each(headers)
          UNION ALL SELECT parent_key, 'artifact', i::VARCHAR, NULL, body FROM artifact
          UNION ALL SELECT parent_key, 'artifact_part', i || '/' || j, i::VARCHAR, body FROM part)
        SELECT DISTINCT parent_key, child, child_path, parent_path, CASE json_type(body) WHEN 'VARCHAR' THEN body->>'$' END AS text,
          CASE json_type(body) WHEN 'OBJECT' THEN len(json_keys(body)) END::INT AS n_fields FROM every
        UNION ALL SELECT DISTINCT parent_key, 'task_dep', i || '/' || j, i::VARCHAR, dep, NULL FROM (SELECT parent_key, i, unnest(range(len(names))) AS j, unnest(names) AS dep FROM dep_names)""",
    "p4_found": f"WITH RECURSIVE {_WALK} SELECT tenant, def_name, name, cycle_head FROM heads",
    "p4_tree": f"""WITH RECURSIVE {_WALK}
        SELECT l.tenant, l.def_name, l.name, l.parent,
               CASE WHEN h.name IS NULL THEN coalesce(u.path || '/', '') || l.name END AS path,
               CASE WHEN h.name IS NULL THEN coalesce(u.depth, 0) END AS depth,
               CASE WHEN h.name IS NULL THEN coalesce(u.root, l.name) END AS root,
               CASE WHEN h.name IS NULL THEN coalesce(d.n, 0) END AS n_descendants, h.cycle_head
        FROM linked l
        LEFT JOIN heads h ON h.tenant = l.tenant AND h.def_name = l.def_name AND h.name = l.name
        LEFT JOIN (SELECT tenant, def_name, name, string_agg(anc, '/' ORDER BY i DESC) AS path, count(*)::INT AS depth, arg_max(anc, i) AS root
                   FROM above GROUP BY 1, 2, 3) u ON u.tenant = l.tenant AND u.def_name = l.def_name AND u.name = l.name
        LEFT JOIN (SELECT tenant, def_name, anc, count(*) AS n FROM above GROUP BY 1, 2, 3) d
               ON d.tenant = l.tenant AND d.def_name = l.def_name AND d.anc = l.name""",
    "p4_descendants": f"WITH RECURSIVE {_WALK} SELECT tenant, def_name, anc AS ancestor, name FROM above",
    "p5_found": f"WITH {_ORPHANS} SELECT ref_table, ref_id, ref_field, orphan_kind FROM orphans WHERE orphan_kind IS NOT NULL",
    "p5_report": f"""WITH {_ORPHANS} SELECT ref_table, ref_field, orphan_kind, strftime(seen, '%Y-%m') AS period, count(*) AS n_orphans
        FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "p6_found": """
        WITH spans AS (
          SELECT run_id, started_at_ms AS s, finished_at_ms AS e FROM task_runs WHERE run_id <> '' AND finished_at_ms > started_at_ms
        ),
        reached AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans),
        labelled AS (
          SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
          FROM reached
        ),
        periods AS (SELECT run_id, island, min(s) AS from_ms, max(e) AS to_ms FROM labelled GROUP BY 1, 2)
        SELECT run_id, 'period' AS span_kind, from_ms, to_ms FROM periods
        UNION ALL
        SELECT run_id, 'gap', before_ms, from_ms
        FROM (SELECT *, lag(to_ms) OVER (PARTITION BY run_id ORDER BY from_ms) AS before_ms FROM periods) WHERE before_ms IS NOT NULL""",
    "p7_found": """
        SELECT 'tenant' AS key_column, tenant AS key_value FROM runs WHERE tenant IS NOT NULL
        GROUP BY tenant HAVING count(*) * 25 >= (SELECT count(*) FROM runs)
        UNION ALL
        SELECT 'def_name', def_name FROM runs WHERE def_name IS NOT NULL
        GROUP BY def_name HAVING count(*) * 25 >= (SELECT count(*) FROM runs)""",
    "p7_profile": _PROFILE,
}
