"""Queries of problems 1 to 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import drift, hierarchy, nested, periods, snapshots, stitch
from palimpsest.session import blank_trim
from palimpsest.sources.tables import releases, table


def number(col) -> F.Column:  # noqa: ANN001
    """An id written as text, as a number: sign, leading zeros and outer blanks do not matter; null if it is none."""
    text = blank_trim(col.cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(text, r"\.0*$", "").try_cast("bigint"))


def _skills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "skills").select(number(F.col("id")).alias("id"), "req")
    edges = rows.select("id", F.explode(F.map_keys("req")).alias("parent")).select("id", number(F.col("parent")).alias("parent"))
    return rows.select("id"), edges


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(*_skills(spark, d))
    return tree.where("parent is not null").select(F.col("id").alias("skill_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(*_skills(spark, d), paths=True)
    counts = hierarchy.descendant_counts(tree)
    path = F.array_join(F.transform("path", lambda x: x.cast("string")), "/")
    return tree.join(counts, "id").select(
        F.col("id").alias("skill_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), path.alias("path"), (F.col("depth") == -1).alias("in_circle"), "n_descendants"
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.hierarchy(*_skills(spark, d), paths=True)
    return hierarchy.descendants(tree).select(F.col("id").alias("skill_id"), F.col("descendant").alias("descendant_id"), "distance")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "skill_levels").withColumn("skill_id", number(F.col("skill_id")))
    return stitch.wide(rows, ["skill_id", "skill_level"], "stat_name", "stat_value", table(spark, d, "stat_catalog"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return stitch.conflicts(_stats(spark, d), ["skill_id", "skill_level"])


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).drop("conflicts", "ordinal")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    steps = snapshots.steps(table(spark, d, "extractions"), releases(spark, table(spark, d, "client_versions")))
    return snapshots.snapshot_changes(table(spark, d, "records"), steps).select("version_id", "kind", "key", "status")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = periods.validity_periods(table(spark, d, "history_events"), releases(spark, table(spark, d, "client_versions")))
    return found.select("kind", "key", "from_version_id", "to_version_id")


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "history_events")
    found = periods.validity_periods(events, releases(spark, table(spark, d, "client_versions")))
    return found.join(events.select("event_id", "data"), "event_id").select("kind", "key", "from_version_id", "to_version_id", "event_id", "data")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.field_changes(table(spark, d, "raw_records"), releases(spark, table(spark, d, "client_versions")))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent(table(spark, d, "raw_records"), releases(spark, table(spark, d, "client_versions")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.shred(table(spark, d, "nested_records"), ["kind", "key"], types=("object",))
    return nested.objects(nodes, ["kind", "key"])


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """Objects with their plain members, lists, and the values in lists: together every value once."""
    nodes = nested.shred(table(spark, d, "nested_records"), ["record_id", "kind", "key"], members=False)
    return nodes.select("record_id", "kind", "key", "type", "pre", "post", "depth", "path", "parent_pre", "parent_path", "value")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_wide, p3_found, p4_found, p4_history, p5_found, p5_table, p6_found, p6_tables)
}

_WALK = """RECURSIVE ids AS (SELECT DISTINCT try_cast(trim(id) AS BIGINT) AS id FROM skills),
e AS (SELECT id, min(p) AS p FROM (SELECT try_cast(trim(id) AS BIGINT) AS id, try_cast(trim(unnest(map_keys(req))) AS BIGINT) AS p FROM skills) WHERE p IN (SELECT id FROM ids) GROUP BY id),
w(id, cur, depth, seen) AS (SELECT id, p, 1, [id] FROM e UNION ALL SELECT w.id, e.p, depth + 1, list_append(seen, cur) FROM w JOIN e ON e.id = w.cur WHERE NOT list_contains(seen, cur)),
pair AS (SELECT cur AS skill_id, id AS descendant_id, depth::INT AS distance FROM w WHERE NOT list_contains(seen, cur))"""

_CELLS = r"""WITH c AS (SELECT stat_name, value_type, lower(regexp_replace(stat_name, '[^A-Za-z0-9]', '', 'g')) AS f FROM stat_catalog),
r AS (SELECT try_cast(trim(skill_id) AS BIGINT) AS skill_id, skill_level, c.stat_name, value_type, regexp_replace(stat_value, '^\s+|\s+$', '', 'g') AS v
 FROM skill_levels l JOIN c ON c.f = lower(regexp_replace(l.stat_name, '[^A-Za-z0-9]', '', 'g'))),
n AS (SELECT *, CASE value_type WHEN 'int' THEN CASE WHEN regexp_full_match(v, '[+-]?\d+(,\d{3})*(\.0*)?') THEN try_cast(regexp_replace(replace(v, ',', ''), '\.0*$', '') AS HUGEINT)::VARCHAR END
 WHEN 'double' THEN CASE WHEN regexp_full_match(replace(v, ',', '.'), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN try_cast(replace(v, ',', '.') AS DOUBLE)::VARCHAR END
 WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 'yes', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', '0') THEN 'false' END ELSE v END AS x FROM r WHERE v <> '')"""

_RELEASES = "rel AS (SELECT version_id, label, row_number() OVER (ORDER BY coalesce(build_time::TIMESTAMPTZ, imported_at::TIMESTAMPTZ), version_id) AS ord FROM client_versions)"

_DRIFT = f"""WITH {_RELEASES}, lines AS (SELECT feed, version_id, line_no, payload FROM raw_records JOIN rel USING (version_id) WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
leaf AS (SELECT feed, version_id, line_no, json_extract(payload, '$.id')::VARCHAR AS id, replace(substr(j.fullkey, 3), '.', '/') AS path,
 CASE j.type WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list' END AS type, j.value::VARCHAR AS v
 FROM lines l, json_tree(l.payload) j WHERE j.type <> 'OBJECT' AND strpos(j.fullkey, '[') = 0),
cat AS (SELECT feed, version_id, path, max(type) AS type FROM leaf GROUP BY ALL),
f AS (SELECT feed, version_id, lag(version_id) OVER (PARTITION BY feed ORDER BY ord) AS old FROM (SELECT DISTINCT feed, version_id, ord FROM cat JOIN rel USING (version_id))),
n AS (SELECT f.feed, f.version_id, path, type FROM f JOIN cat c ON c.feed = f.feed AND c.version_id = f.version_id WHERE old IS NOT NULL),
o AS (SELECT f.feed, f.version_id, path, type FROM f JOIN cat c ON c.feed = f.feed AND c.version_id = f.old),
went AS (SELECT * FROM o ANTI JOIN n USING (feed, version_id, path)), came AS (SELECT * FROM n ANTI JOIN o USING (feed, version_id, path)),
val AS (SELECT feed, version_id, path, id, max_by(v, line_no) AS v FROM leaf WHERE type IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
met AS (SELECT w.feed, w.version_id, w.path, c.path AS new_path, count(*) AS met, count_if(a.v = b.v) AS equal FROM went w JOIN came c USING (feed, version_id) JOIN f USING (feed, version_id)
 JOIN val a ON a.feed = w.feed AND a.version_id = f.old AND a.path = w.path JOIN val b ON b.feed = w.feed AND b.version_id = w.version_id AND b.path = c.path AND b.id = a.id GROUP BY ALL),
rn AS (SELECT feed, version_id, path, new_path FROM met WHERE met = equal QUALIFY row_number() OVER (PARTITION BY feed, version_id, path ORDER BY equal DESC, new_path) = 1 AND row_number() OVER (PARTITION BY feed, version_id, new_path ORDER BY equal DESC, path) = 1)"""

_PERIODS = f"""{_RELEASES}, canon AS (SELECT event_id, string_agg(j.fullkey || '=' || j.type || coalesce(j.atom::VARCHAR, ''), chr(10) ORDER BY j.fullkey) AS c
 FROM (SELECT event_id, data FROM history_events WHERE json_valid(data)) h, json_tree(h.data) j GROUP BY event_id),
ev AS (SELECT kind, key, r.version_id, ord, max_by(event_id, received_at::VARCHAR || printf('%020d', event_id)) AS event_id FROM history_events h JOIN rel r ON lower(trim(r.label)) = lower(trim(h.version)) GROUP BY ALL),
st AS (SELECT ev.*, CASE WHEN lower(trim(h.status)) = 'removed' THEN NULL ELSE coalesce(c, 'text ' || h.data, 'none') END AS c FROM ev JOIN history_events h USING (event_id) LEFT JOIN canon USING (event_id)),
ch AS (SELECT *, lag(c) OVER w IS DISTINCT FROM c AS change FROM st WINDOW w AS (PARTITION BY kind, key ORDER BY ord)),
pe AS (SELECT kind, key, version_id, event_id, c, lead(version_id) OVER (PARTITION BY kind, key ORDER BY ord) AS nxt FROM ch WHERE change)"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_WALK},
last AS (SELECT id, max_by(cur, depth) AS cur, max(depth) AS depth, max_by(seen, depth) AS seen FROM w GROUP BY id)
SELECT id AS skill_id, CASE WHEN list_contains(seen, cur) THEN list_min(seen[list_position(seen, cur):]) ELSE cur END AS root_id, (CASE WHEN list_contains(seen, cur) THEN -1 ELSE depth END)::INT AS depth FROM last""",
    "p2_found": _CELLS + """ SELECT skill_id, skill_level, stat_name FROM n GROUP BY ALL HAVING count(x) < count(*) OR count(DISTINCT x) > 1""",
    "p3_found": f"""WITH {_RELEASES}, done AS (SELECT DISTINCT extractor AS source, version_id, ord FROM extractions JOIN rel USING (version_id)),
steps AS (SELECT *, lag(version_id) OVER (PARTITION BY source ORDER BY ord) AS old FROM done),
rec AS (SELECT source, version_id, kind, key, max_by(lower(trim(hash)), loaded_at) AS hash FROM (SELECT *, regexp_replace(regexp_replace(key, '[/\\\\]+', '/', 'g'), '^/|/$', '', 'g') AS k FROM records) AS r(version_id, source, kind, raw, hash, blob_hash, loaded_at, key) GROUP BY ALL),
n AS (SELECT s.version_id AS v, s.source, kind, key, hash FROM steps s JOIN rec r ON r.source = s.source AND r.version_id = s.version_id WHERE old IS NOT NULL),
o AS (SELECT s.version_id AS v, s.source, kind, key, hash FROM steps s JOIN rec r ON r.source = s.source AND r.version_id = s.old)
SELECT v AS version_id, kind, key, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' ELSE 'modified' END AS status FROM n FULL JOIN o USING (v, source, kind, key) WHERE n.hash IS DISTINCT FROM o.hash""",
    "p4_found": f"""WITH {_PERIODS}
SELECT kind, key, version_id AS from_version_id, coalesce(nxt, 0) AS to_version_id FROM pe WHERE c IS NOT NULL""",
    "p5_found": f"""{_DRIFT}
SELECT feed, version_id, 'renamed' AS change, path, new_path FROM rn UNION ALL SELECT feed, version_id, 'retyped', path, '' FROM n JOIN o USING (feed, version_id, path) WHERE n.type <> o.type
UNION ALL SELECT feed, version_id, 'removed', path, '' FROM went ANTI JOIN rn USING (feed, version_id, path)
UNION ALL SELECT feed, version_id, 'added', path, '' FROM came c WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.feed = c.feed AND rn.version_id = c.version_id AND rn.new_path = c.path)""",
    "p5_table": f"""{_DRIFT.replace("WITH ", "WITH RECURSIVE ", 1)},
place AS (SELECT feed, version_id, row_number() OVER (PARTITION BY feed ORDER BY ord) AS place FROM (SELECT DISTINCT feed, version_id, ord FROM cat JOIN rel USING (version_id))),
cell AS (SELECT feed, version_id, path, place FROM cat JOIN place USING (feed, version_id)),
nxt AS (SELECT a.feed, a.path, a.place, coalesce(b.path, rn.new_path) AS to_path FROM cell a LEFT JOIN cell b ON b.feed = a.feed AND b.path = a.path AND b.place = a.place + 1
 LEFT JOIN place p ON p.feed = a.feed AND p.place = a.place + 1 LEFT JOIN rn ON rn.feed = a.feed AND rn.version_id = p.version_id AND rn.path = a.path),
walk(feed, path, place, name, fin) AS (SELECT feed, path, place, path, place FROM nxt WHERE to_path IS NULL
 UNION ALL SELECT n.feed, n.path, n.place, w.name, w.fin FROM walk w JOIN nxt n ON n.feed = w.feed AND n.to_path = w.path AND n.place = w.place - 1),
fld AS (SELECT feed, name, fin, min(place) AS begin FROM walk GROUP BY ALL),
clash AS (SELECT *, begin <= lag(fin) OVER (PARTITION BY feed, name ORDER BY fin) AS c FROM fld),
called AS (SELECT k.feed, k.name, k.fin, CASE WHEN bool_or(coalesce(c, false)) OVER (PARTITION BY k.feed, k.name) AND k.fin < max(k.fin) OVER (PARTITION BY k.feed, k.name) THEN k.name || '@' || p.version_id ELSE k.name END AS label
 FROM clash k JOIN place p ON p.feed = k.feed AND p.place = k.fin),
alias AS (SELECT w.feed, p.version_id, w.path, label FROM walk w JOIN called c ON c.feed = w.feed AND c.name = w.name AND c.fin = w.fin JOIN place p ON p.feed = w.feed AND p.place = w.place),
vals AS (SELECT l.*, label FROM leaf l JOIN alias USING (feed, version_id, path)),
kind AS (SELECT feed, label, CASE WHEN count(DISTINCT type) = 0 THEN 'null' WHEN count(DISTINCT type) = 1 THEN min(type) WHEN string_agg(DISTINCT type, ',' ORDER BY type) = 'float,int' THEN 'float' ELSE 'string' END AS as_type FROM vals GROUP BY ALL),
cast_ AS (SELECT v.feed, version_id, line_no, coalesce(id, 'null') AS id, label AS name, as_type AS type, CASE WHEN v.type IS NULL THEN NULL WHEN as_type = 'float' AND v.type = 'int' THEN v || '.0' WHEN v.type = 'string' THEN json_extract_string(v, '$') ELSE v END AS value FROM vals v JOIN kind USING (feed, label))
SELECT *, CASE WHEN type = 'int' THEN try_cast(value AS BIGINT) END AS as_int, CASE WHEN type IN ('int', 'float') THEN try_cast(value AS DOUBLE) END AS as_float, CASE WHEN type = 'bool' THEN try_cast(value AS BOOLEAN) END AS as_bool FROM cast_""",
    "p6_found": r"""WITH RECURSIVE w(kind, key, path, around, v) AS (SELECT DISTINCT kind, key, '', '', data::JSON FROM nested_records WHERE json_valid(data)
UNION ALL SELECT w.kind, w.key, CASE WHEN w.path = '' THEN j.key ELSE w.path || '/' || j.key END, CASE WHEN json_type(w.v) = 'OBJECT' THEN w.path ELSE w.around END,
 CASE WHEN json_type(j.value) = 'VARCHAR' AND regexp_matches(json_extract_string(j.value, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(j.value, '$')) THEN json_extract_string(j.value, '$')::JSON ELSE j.value END
 FROM w, json_each(w.v) j WHERE json_type(w.v) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT kind, key, path, around AS parent_path FROM w WHERE path <> '' AND json_type(v) = 'OBJECT'""",
    "p6_tables": r"""WITH RECURSIVE w(rid, kind, key, ord, depth, path, around, around_ord, inside, name, v) AS (SELECT record_id, kind, key, []::UBIGINT[], 0, '', '', NULL::UBIGINT[], '', '', data::JSON FROM nested_records WHERE json_valid(data)
UNION ALL SELECT rid, kind, w.key, list_append(ord, j.id), depth + 1, CASE WHEN w.path = '' THEN j.key ELSE w.path || '/' || j.key END,
 CASE WHEN json_type(w.v) = 'OBJECT' THEN w.path ELSE w.around END, CASE WHEN json_type(w.v) = 'OBJECT' THEN w.ord ELSE w.around_ord END, json_type(w.v), j.key,
 CASE WHEN json_type(j.value) = 'VARCHAR' AND regexp_matches(json_extract_string(j.value, '$'), '^\s*[\[{]') AND json_valid(json_extract_string(j.value, '$')) THEN json_extract_string(j.value, '$')::JSON ELSE j.value END
 FROM w, json_each(w.v) j WHERE json_type(w.v) IN ('OBJECT', 'ARRAY')),
t AS (SELECT *, CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' ELSE 'value' END AS type, row_number() OVER (PARTITION BY rid ORDER BY ord) - 1 AS pre FROM w),
n AS (SELECT rid, up, count(*) AS below FROM (SELECT rid, unnest(list_transform(range(len(ord)), lambda i: ord[1:i])) AS up FROM w) GROUP BY ALL),
f AS (SELECT rid, around_ord, string_agg(to_json(name)::VARCHAR || ':' || v::VARCHAR, ',' ORDER BY name) AS members FROM t WHERE inside = 'OBJECT' AND type = 'value' GROUP BY ALL)
SELECT t.rid AS record_id, t.kind, t.key, t.type, t.pre, t.pre - t.depth + coalesce(below, 0) AS post, t.depth::INT AS depth, t.path, coalesce(a.pre, -1) AS parent_pre, t.around AS parent_path,
 CASE t.type WHEN 'object' THEN '{' || coalesce(members, '') || '}' WHEN 'value' THEN t.v::VARCHAR END AS value
FROM t LEFT JOIN t a ON a.rid = t.rid AND a.ord = t.around_ord LEFT JOIN n ON n.rid = t.rid AND n.up = t.ord LEFT JOIN f ON f.rid = t.rid AND f.around_ord = t.ord WHERE t.type <> 'value' OR t.inside <> 'OBJECT'""",
    "p1_descendants": f"WITH {_WALK} SELECT skill_id, descendant_id, distance FROM pair",
    "p1_hierarchy": f"""WITH {_WALK}, last AS (SELECT id, max_by(cur, depth) AS cur, max(depth) AS depth, max_by(seen, depth) AS seen FROM w GROUP BY id), n AS (SELECT skill_id, count(*) AS n FROM pair GROUP BY skill_id),
r AS (SELECT ids.id, CASE WHEN cur IS NULL THEN ids.id WHEN list_contains(seen, cur) THEN list_min(seen[list_position(seen, cur):]) ELSE cur END AS root_id, CASE WHEN cur IS NULL THEN 0 WHEN list_contains(seen, cur) THEN -1 ELSE depth END AS depth, cur, seen FROM ids LEFT JOIN last USING (id) WHERE ids.id IS NOT NULL)
SELECT id AS skill_id, root_id, depth::INT AS depth, CASE WHEN depth = 0 THEN id::VARCHAR WHEN depth > 0 THEN array_to_string(list_append(seen, cur), '/') END AS path, depth = -1 AS in_circle, coalesce(n, 0) AS n_descendants FROM r LEFT JOIN n ON n.skill_id = r.id""",
    "p2_wide": _CELLS + """, v AS (SELECT skill_id, skill_level, stat_name, min(x) AS x FROM n GROUP BY ALL HAVING count(x) = count(*) AND count(DISTINCT x) = 1),
ent AS (SELECT DISTINCT try_cast(trim(skill_id) AS BIGINT) AS skill_id, skill_level FROM skill_levels)
SELECT ent.skill_id, ent.skill_level, max(CASE WHEN stat_name = 'mpCost' THEN x END)::DECIMAL(38,0) AS mpCost, max(CASE WHEN stat_name = 'hpCost' THEN x END)::DECIMAL(38,0) AS hpCost, max(CASE WHEN stat_name = 'dmgPct' THEN x END)::DECIMAL(38,0) AS dmgPct, max(CASE WHEN stat_name = 'hitCount' THEN x END)::DECIMAL(38,0) AS hitCount, max(CASE WHEN stat_name = 'targetCount' THEN x END)::DECIMAL(38,0) AS targetCount, max(CASE WHEN stat_name = 'durationSec' THEN x END)::DECIMAL(38,0) AS durationSec, max(CASE WHEN stat_name = 'cooldownSec' THEN x END)::DECIMAL(38,0) AS cooldownSec, max(CASE WHEN stat_name = 'procChance' THEN x END)::DECIMAL(38,0) AS procChance, max(CASE WHEN stat_name = 'reachPx' THEN x END)::DECIMAL(38,0) AS reachPx, max(CASE WHEN stat_name = 'castDelay' THEN x END)::DECIMAL(38,0) AS castDelay, max(CASE WHEN stat_name = 'summonHp' THEN x END)::DECIMAL(38,0) AS summonHp, max(CASE WHEN stat_name = 'pdefDelta' THEN x END)::DECIMAL(38,0) AS pdefDelta, max(CASE WHEN stat_name = 'critBonus' THEN x END)::DOUBLE AS critBonus, max(CASE WHEN stat_name = 'speedMul' THEN x END)::DOUBLE AS speedMul, max(CASE WHEN stat_name = 'healRatio' THEN x END)::DOUBLE AS healRatio, max(CASE WHEN stat_name = 'knockDist' THEN x END)::DOUBLE AS knockDist, max(CASE WHEN stat_name = 'dropMul' THEN x END)::DOUBLE AS dropMul, max(CASE WHEN stat_name = 'isAura' THEN x END)::BOOLEAN AS isAura, max(CASE WHEN stat_name = 'needsWeapon' THEN x END)::BOOLEAN AS needsWeapon, max(CASE WHEN stat_name = 'partyWide' THEN x END)::BOOLEAN AS partyWide, max(CASE WHEN stat_name = 'element' THEN x END)::VARCHAR AS element, max(CASE WHEN stat_name = 'text' THEN x END)::VARCHAR AS text, max(CASE WHEN stat_name = 'anchor' THEN x END)::VARCHAR AS anchor
FROM ent LEFT JOIN v ON v.skill_id = ent.skill_id AND v.skill_level = ent.skill_level WHERE ent.skill_id IS NOT NULL AND ent.skill_level IS NOT NULL GROUP BY ALL""",
    "p4_history": f"""WITH {_PERIODS} SELECT kind, key, version_id AS from_version_id, coalesce(nxt, 0) AS to_version_id, event_id, data FROM pe JOIN (SELECT event_id, data FROM history_events) USING (event_id) WHERE c IS NOT NULL""",
}
