"""Queries of the versioned-record engine over the domain tables, each with the SQL it is compared with."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import canon, jobs, text, textdiff
from palimpsest.operators import catalog, diff, extract, facets, search, timeline, versions
from palimpsest.session import ship
from palimpsest.sources import files, store
from palimpsest.sources.tables import releases, table



def collected():  # noqa: ANN201
    """Empty tables of queries and SQL by name, and the decorator that fills them: it registers a query under its function's
    name, with its SQL if there is one."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):  # noqa: ANN202
        def put(f):  # noqa: ANN001, ANN202
            @wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                ship(spark)
                return f(spark, d)

            queries[f.__name__] = run
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return put

    return queries, oracle, query


QUERIES, ORACLE, query = collected()

_PATH = r"regexp_replace(regexp_replace(key, '[/\\]+', '/', 'g'), '^/|/$', '', 'g')"
_REL = """rel AS (SELECT version_id, label, row_number() OVER (ORDER BY coalesce(build_time::TIMESTAMPTZ, imported_at::TIMESTAMPTZ), version_id) AS ord FROM client_versions)"""
_REC = f"""{_REL}, rec AS (SELECT version_id, source, kind, key, hash, blob_hash FROM (
 SELECT *, row_number() OVER (PARTITION BY version_id, source, kind, key ORDER BY loaded_at DESC, hash DESC, blob_hash DESC) AS rn FROM (
  SELECT version_id, source, kind, {_PATH} AS key, lower(trim(hash)) AS hash, lower(trim(blob_hash)) AS blob_hash, loaded_at FROM records)) WHERE rn = 1)"""
_DIFF = f"""{_REC}, o AS (SELECT * FROM rec WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1 OFFSET 1)),
n AS (SELECT * FROM rec WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1)),
d AS (SELECT kind, key, CASE WHEN o.version_id IS NULL THEN 'added' WHEN n.version_id IS NULL THEN 'removed' ELSE 'modified' END AS status,
 o.hash AS old_hash, n.hash AS new_hash, o.blob_hash AS old_blob, n.blob_hash AS new_blob FROM o FULL JOIN n USING (kind, key)
 WHERE o.version_id IS NULL OR n.version_id IS NULL OR o.hash IS DISTINCT FROM n.hash)"""
_LEAF = f"""{_DIFF}, p AS (SELECT d.kind, d.key, d.status, a.data AS old_data, b.data AS new_data FROM d LEFT JOIN blobs a ON a.hash = d.old_blob LEFT JOIN blobs b ON b.hash = d.new_blob),
x AS (SELECT kind, key, status, u.path, json_extract(old_data, u.loc)::VARCHAR AS old, json_extract(new_data, u.loc)::VARCHAR AS new FROM p,
 (VALUES ('desc', '$.desc'), ('job', '$.job'), ('max_level', '$.max_level'), ('mapName', '$.mapName'), ('streetName', '$.streetName'), ('path', '$.path'), ('name', '$.name'), ('ref', '$.ref'), ('rev', '$.rev'), ('size', '$.size'), ('info', '$.info'), ('info/atk', '$.info.atk'), ('info/lv', '$.info.lv')) AS u(path, loc)
 WHERE old_data IS NOT NULL AND new_data IS NOT NULL AND CASE WHEN u.path = 'info' THEN json_extract(old_data, '$.info') IS NULL OR json_extract(new_data, '$.info') IS NULL
  WHEN u.path LIKE 'info/%' THEN json_extract(old_data, '$.info') IS NOT NULL AND json_extract(new_data, '$.info') IS NOT NULL ELSE true END),
f AS (SELECT * FROM x WHERE old IS DISTINCT FROM new)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_records(table(spark, d, "records"))


def _pair(spark: SparkSession, d: str) -> tuple[int, int]:
    v = table(spark, d, "client_versions")
    return versions.resolve(v, "previous"), versions.resolve(v, "latest")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return diff.changes(_records(spark, d), table(spark, d, "blobs"), *_pair(spark, d))


# Versions


@query(f"WITH {_REL} SELECT version_id, label, ord AS place, lag(version_id) OVER (ORDER BY ord) AS previous_id FROM rel")
def versions_release_order(spark, d):
    return versions.ordered(table(spark, d, "client_versions")).select("version_id", "label", "place", "previous_id")


@query(f"WITH {_REL} SELECT r.version_id, coalesce(b.version_id, lag(r.version_id) OVER (ORDER BY r.ord)) AS base_id FROM rel r LEFT JOIN rel b ON b.label = 'r0973' AND b.ord < r.ord")
def diff_base_choice(spark, d):
    return versions.diff_bases(table(spark, d, "client_versions"), "r0973")


@query("SELECT version_id, extractor, finished_at FROM extractions ORDER BY version_id, extractor")
def extraction_list(spark, d):
    return table(spark, d, "extractions").select("version_id", "extractor", "finished_at").orderBy("version_id", "extractor")


# Records


@query(f"WITH {_REC} SELECT version_id, source, kind, key, hash, blob_hash FROM rec")
def records_clean(spark, d):
    return _records(spark, d)


@query(f"WITH {_REC} SELECT version_id, kind, count(*) AS n FROM rec GROUP BY ALL")
def kind_counts(spark, d):
    return _records(spark, d).groupBy("version_id", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_REC} SELECT DISTINCT version_id FROM rec WHERE kind = 'skill'")
def versions_with_kind(spark, d):
    return table(spark, d, "records").where("kind = 'skill'").select("version_id").distinct()


@query(f"WITH {_REC} SELECT DISTINCT hash FROM rec WHERE kind = 'file'")
def distinct_hashes(spark, d):
    return _records(spark, d).where("kind = 'file'").select("hash").distinct()


@query(f"WITH {_REC} SELECT version_id, kind, key, hash, data FROM rec LEFT JOIN (SELECT hash AS blob_hash, data FROM blobs) USING (blob_hash) WHERE kind = 'skill' AND key = '1003011'")
def record_lookup(spark, d):
    rows = _records(spark, d).where("kind = 'skill' and key = '1003011'")
    return diff.attach(rows, table(spark, d, "blobs"), "blob_hash", "data").select("version_id", "kind", "key", "hash", "data")


@query(f"WITH {_REC} SELECT kind, key, rec.hash, data FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1)")
def version_records(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    rows = _records(spark, d).where(F.col("version_id") == latest)
    return diff.attach(rows, table(spark, d, "blobs"), "blob_hash", "data").select("kind", "key", "hash", "data")


# Differences


@query(f"WITH {_DIFF} SELECT kind, key, status, old_hash, new_hash FROM d")
def diff_records(spark, d):
    return diff.diff(_records(spark, d), *_pair(spark, d)).select("kind", "key", "status", "old_hash", "new_hash")


@query(f"WITH {_DIFF} SELECT kind, key, status FROM d")
def diff_union_form(spark, d):
    return diff.diff_in_halves(_records(spark, d), *_pair(spark, d))


@query(f"WITH {_DIFF} SELECT kind, key, status FROM d WHERE kind = 'STRING' OR kind ILIKE 'STRING/%'")
def diff_kind_filter(spark, d):
    return diff.diff(_records(spark, d), *_pair(spark, d), kind="STRING").select("kind", "key", "status")


@query(f"WITH {_DIFF} SELECT kind, count_if(status = 'added')::BIGINT AS added, count_if(status = 'removed')::BIGINT AS removed, count_if(status = 'modified')::BIGINT AS modified FROM d GROUP BY kind")
def diff_summary(spark, d):
    return diff.summary(diff.diff(_records(spark, d), *_pair(spark, d)))


@query(f"WITH {_DIFF} SELECT kind, count(*) AS total, string_agg(key || ':' || status, ',' ORDER BY key, status) FILTER (rank <= 1000) AS changes FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key) AS rank FROM d) GROUP BY kind")
def diff_by_kind_lists(spark, d):
    lists = diff.by_kind(diff.diff(_records(spark, d), *_pair(spark, d)))
    return lists.select("kind", "total", F.array_join(F.transform("changes", lambda c: F.concat(c["key"], F.lit(":"), c["status"])), ",").alias("changes"))


@query(f"WITH {_DIFF} SELECT kind, key, status, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY key)::INT AS rank, count(*) OVER (PARTITION BY kind) AS total FROM d) WHERE rank <= 50")
def diff_topn_per_kind(spark, d):
    return diff.top_per(diff.diff(_records(spark, d), *_pair(spark, d)), "kind", 50).select("kind", "key", "status", "rank", "total")


@query(f"WITH {_LEAF} SELECT kind, key, path, old, new FROM f")
def diff_field_changes(spark, d):
    return diff.field_rows(_changes(spark, d))


@query(f"""WITH {_LEAF}, t AS (SELECT kind, key, bool_and((old IS NULL OR old LIKE '"%') AND (new IS NULL OR new LIKE '"%')) AS texts FROM f GROUP BY ALL)
SELECT p.kind, p.key, p.status FROM p LEFT JOIN t USING (kind, key) WHERE NOT (p.status = 'modified' AND coalesce(t.texts, false))""")
def diff_hide_text(spark, d):
    return _changes(spark, d).where(~diff.is_text_only()).select("kind", "key", "status")


@query(f"""WITH {_LEAF} SELECT kind, key, coalesce(CASE WHEN json_type(coalesce(new_data, old_data), '$.name') = 'VARCHAR' THEN json_extract_string(coalesce(new_data, old_data), '$.name') END,
CASE WHEN json_type(coalesce(new_data, old_data), '$.mapName') = 'VARCHAR' THEN json_extract_string(coalesce(new_data, old_data), '$.mapName') END) AS title FROM p""")
def title_projection(spark, d):
    c = _changes(spark, d)
    return c.select("kind", "key", diff.title(F.col("new_data"), F.col("old_data")).alias("title"))


@query(f"""WITH {_LEAF} SELECT kind, key, CASE WHEN new_data IS NULL THEN '∅' WHEN length(new_data) > 60 THEN left(new_data, 59) || '…' ELSE new_data END AS shown FROM p""")
def preview(spark, d):
    return _changes(spark, d).select("kind", "key", text.preview(F.col("new_data"), 60).alias("shown"))


def _edited(spark, d):
    rows = diff.field_rows(_changes(spark, d)).where(r"old like '\"%' and new like '\"%'")
    bare = lambda c: F.get_json_object(F.concat(F.lit('{"v":'), F.col(c), F.lit("}")), "$.v")
    return rows.select("kind", "key", "path", bare("old").alias("old"), bare("new").alias("new")).withColumn("diff", textdiff.word_diff("old", "new"))


@query()
def text_diff_inline(spark, d):
    return _edited(spark, d).select("kind", "key", "path", "old", "new", textdiff.inline(F.col("diff")).alias("line"))


@query()
def text_similarity(spark, d):
    return _edited(spark, d).select("kind", "key", "path", textdiff.similarity(F.col("diff")).alias("similarity"), textdiff.display(F.col("diff"), F.col("old"), F.col("new")).alias("shown"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?s)[\p{L}\p{Nd}\p{Nl}\p{No}''%]+|[^\p{L}\p{Nd}\p{Nl}\p{No}''%]'))::INT AS tokens FROM documents WHERE text IS NOT NULL""")
def text_tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"))


# History


@query(f"""WITH {_REC}, cov AS (SELECT DISTINCT kind, rec.version_id, ord FROM rec JOIN rel USING (version_id)),
grid AS (SELECT k.kind, k.key, c.version_id, c.ord FROM (SELECT DISTINCT kind, key FROM rec) k JOIN cov c USING (kind)),
s AS (SELECT g.*, r.version_id IS NOT NULL AS there, r.hash, lag(r.version_id IS NOT NULL) OVER w AS was, lag(r.hash) OVER w AS old FROM grid g LEFT JOIN rec r USING (kind, key, version_id) WINDOW w AS (PARTITION BY g.kind, g.key ORDER BY g.ord))
SELECT kind, key, version_id, CASE WHEN there AND NOT coalesce(was, false) THEN 'added' WHEN NOT there THEN 'removed' ELSE 'modified' END AS status
FROM s WHERE there <> coalesce(was, false) OR (there AND hash IS DISTINCT FROM old)""")
def history_events(spark, d):
    found = timeline.events(_records(spark, d), releases(spark, table(spark, d, "client_versions")), table(spark, d, "records"))
    return found.select("kind", "key", "version_id", "status")


@query(f"WITH {_REC} SELECT version_id, kind, key, hash FROM rec WHERE key = '1001296' OR key LIKE '%/1001296'")
def history_suffix(spark, d):
    return search.with_key(_records(spark, d), "1001296").select("version_id", "kind", "key", "hash")


# Search and pages


@query(f"""WITH {_REC} SELECT kind, key, rec.hash FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash
WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AND (key ILIKE '%FERRY%' OR data ILIKE '%FERRY%') ORDER BY kind, key LIMIT 50""")
def search_records(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    return search.search(_records(spark, d), table(spark, d, "blobs"), latest, "FERRY", most=50).select("kind", "key", "hash")


@query(f"""WITH {_REC} SELECT kind, key FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash
WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AND (kind = 'string' OR kind ILIKE 'string/%') AND (key ILIKE '%100!%' ESCAPE '!' OR data ILIKE '%5!% less%' ESCAPE '!')""")
def search_escaped(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    return search.search(_records(spark, d), table(spark, d, "blobs"), latest, "5% less", kind="string").select("kind", "key")


@query(f"""WITH {_REC}, k AS (SELECT DISTINCT kind, key FROM rec WHERE kind = 'skill' OR kind = 'string/Map'), n AS (SELECT *, CASE WHEN regexp_full_match(key, '\\+?[0-9]{{1,25}}') AND try_cast(key AS HUGEINT) < 18446744073709551616 THEN try_cast(key AS HUGEINT) END AS n FROM k)
SELECT kind, key FROM n ORDER BY n IS NULL, n, key, kind LIMIT 200 OFFSET 200""")
def page_records(spark, d):
    """The second page of all skills and maps, in natural order of their keys: numbers first, then paths."""
    rows = _records(spark, d).where("kind in ('skill', 'string/Map')").select("kind", "key").distinct()
    return search.page(rows, 1, ["key", "kind"])


@query("SELECT count(*) AS rows, ceil(count(*) / 200.0)::BIGINT AS pages FROM records")
def page_count(spark, d):
    return search.pages(table(spark, d, "records"))


@query("SELECT s_name, row_number() OVER (ORDER BY try_cast(regexp_extract(s_name, '[0-9]+$') AS HUGEINT), s_name) AS place FROM supplier")
def natural_sort(spark, d):
    from pyspark.sql import Window

    number = F.regexp_extract("s_name", "[0-9]+$", 0)
    w = Window.partitionBy(F.lit(1)).orderBy(*text.natural_order(number), "s_name")
    return table(spark, d, "supplier").select("s_name", F.row_number().over(w).cast("bigint").alias("place"))


# Facets



def _category(t: str = "") -> str:
    top = f"split_part(regexp_replace({t}key, '^Data/', ''), '/', 1)"
    return f"""CASE WHEN kind IN ('img', 'file') THEN CASE {top} WHEN 'Skill' THEN 'skills' WHEN 'Character' THEN 'equipment' WHEN 'Item' THEN 'items' WHEN 'Mob' THEN 'monsters' WHEN 'Npc' THEN 'npcs' WHEN 'Map' THEN 'maps' WHEN 'Quest' THEN 'quests' ELSE 'other' END
WHEN kind IN ('skill', 'string/Skill') THEN 'skills' WHEN kind = 'string/Eqp' THEN 'equipment' WHEN kind IN ('string/Consume', 'string/Etc', 'string/Ins', 'string/Cash', 'string/Pet') THEN 'items'
WHEN kind IN ('string/Mob', 'string/MobSkill') THEN 'monsters' WHEN kind = 'string/Npc' THEN 'npcs' WHEN kind = 'string/Map' THEN 'maps' ELSE 'other' END"""


def _job(data: str) -> str:
    return f"""CASE WHEN kind = 'skill' THEN coalesce(try_cast(json_extract({data}, '$.job') AS BIGINT), try_cast(key AS BIGINT) // 10000) WHEN kind = 'string/Skill' THEN try_cast(key AS BIGINT) // 10000
 WHEN kind IN ('img', 'file') THEN try_cast(nullif(regexp_extract(regexp_replace(key, '^Data/', ''), '^Skill/(.*)\\.img$', 1), '') AS BIGINT) END"""


_FACETS = f"""{_REC}, fac AS (SELECT rec.version_id, rec.kind, rec.key, {_category('rec.')} AS category,
{_job('b.data')} AS job,
CASE WHEN kind IN ('img', 'file') THEN 'raw' ELSE 'data' END AS detail FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1)),
jobs(id, branch, advancement) AS (VALUES {", ".join(f"({i}, '{b}', {a})" for i, _, b, a in jobs.JOBS)}),
fj AS (SELECT fac.*, jobs.branch, jobs.advancement FROM fac LEFT JOIN jobs ON jobs.id = fac.job)"""


def _facets(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    rows = _records(spark, d).where(F.col("version_id") == latest)
    rows = diff.attach(rows, table(spark, d, "blobs"), "blob_hash", "data")
    return facets.with_facets(rows, F.when(F.col("kind") == "skill", canon.strict(F.col("data"), "job", "int")))


@query(f"WITH {_FACETS} SELECT kind, key, category, job, branch, advancement, detail FROM fj")
def facet_columns(spark, d):
    return _facets(spark, d).select("kind", "key", "category", "job", "branch", "advancement", "detail")


_CHOSEN = facets.FacetFilter(categories=frozenset({"skills", "maps"}), branches=frozenset({"warrior"}), data_only=True)


@query(f"WITH {_FACETS} SELECT kind, key FROM fj WHERE category IN ('skills', 'maps') AND branch = 'warrior' AND detail = 'data'")
def facet_filter(spark, d):
    return _facets(spark, d).where(_CHOSEN.condition()).select("kind", "key")


@query(f"""WITH {_FACETS}, every(dimension, value) AS (VALUES {", ".join(f"('category', '{c}')" for c in facets.CATEGORIES)}, {", ".join(f"('branch', '{b}')" for b in jobs.BRANCHES)}, {", ".join(f"('advancement', '{a[0]}')" for a in jobs.ADVANCEMENTS)}),
hits AS (SELECT 'category' AS dimension, category AS value FROM fj WHERE branch = 'warrior' AND detail = 'data' UNION ALL SELECT 'branch', branch FROM fj WHERE category IN ('skills', 'maps') AND detail = 'data'
 UNION ALL SELECT 'advancement', advancement::VARCHAR FROM fj WHERE category IN ('skills', 'maps') AND branch = 'warrior' AND detail = 'data')
SELECT dimension, value, count(h.value) AS n FROM every LEFT JOIN hits h USING (dimension, value) GROUP BY ALL""")
def facet_drill_sideways(spark, d):
    return facets.drill_sideways(_facets(spark, d), _CHOSEN)


@query(f"WITH {_FACETS} SELECT category, count(*) AS n FROM fj GROUP BY category")
def category_counts(spark, d):
    return facets.category_counts(_facets(spark, d))


@query(f"""WITH {_REC} SELECT kind, key, CASE WHEN kind = 'img' THEN key WHEN kind = 'skill' THEN 'Skill/' || printf('%03d', try_cast(key AS BIGINT) // 10000) || '.img/skill/' || key
WHEN kind LIKE 'string/%' THEN 'String/' || substr(kind, 8) || '.img/' || key END AS path FROM rec WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1)""")
def wz_path(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    rows = _records(spark, d).where(F.col("version_id") == latest)
    return rows.select("kind", "key", extract.node_path(F.col("kind"), F.col("key")).alias("path"))


# Jobs

_JOBS = ", ".join(f"({i}, '{n}', '{b}', {a})" for i, n, b, a in jobs.JOBS)
_PARENT = "CASE WHEN {0} = 0 THEN NULL WHEN {0} % 100 = 0 THEN 0 WHEN {0} % 10 = 0 THEN {0} // 100 * 100 ELSE {0} - 1 END"


@query(f"SELECT id, name, branch, advancement, CASE advancement WHEN 0 THEN 'Beginner' WHEN 1 THEN '1st job' WHEN 2 THEN '2nd job' WHEN 3 THEN '3rd job' ELSE '4th job' END AS label, ({_PARENT.format('id')})::BIGINT AS parent FROM (VALUES {_JOBS}) AS j(id, name, branch, advancement)")
def jobs_dim(spark, d):
    return jobs.dimension(spark).select("id", "name", "branch", "advancement", jobs.label(F.col("advancement")).alias("label"), jobs.parent(F.col("id")).alias("parent"))


@query(f"""WITH RECURSIVE j(id) AS (SELECT id FROM (VALUES {_JOBS}) AS t(id, name, branch, advancement)), w(id, cur, path) AS (SELECT id, id, id::VARCHAR FROM j
UNION ALL SELECT id, {_PARENT.format('cur')}, ({_PARENT.format('cur')})::VARCHAR || '/' || path FROM w WHERE cur <> 0) SELECT id, path FROM w WHERE cur = 0""")
def job_paths(spark, d):
    path = F.array_join(F.transform(jobs.path(F.col("id")), lambda x: x.cast("string")), "/")
    return jobs.dimension(spark).select("id", path.alias("path"))


@query(f"WITH j AS (SELECT DISTINCT job FROM skills WHERE job IS NOT NULL) SELECT job FROM j WHERE job NOT IN (SELECT {_PARENT.format('job')} FROM j WHERE job <> 0)")
def job_leaves(spark, d):
    return jobs.leaves(table(spark, d, "skills").where("job is not null"))


# Skills


@query(f"""WITH {_REC} SELECT key AS id, coalesce(try_cast(json_extract(data, '$.job') AS BIGINT), try_cast(key AS BIGINT) // 10000, 0) AS job, json_extract_string(data, '$.name') AS name,
coalesce(try_cast(json_extract(data, '$.max_level') AS BIGINT), 0) AS max_level, coalesce(json_extract_string(data, '$.name') IS NOT NULL AND try_cast(json_extract(data, '$.max_level') AS BIGINT) > 0, false) AS listed, CASE WHEN json_type(data, '$.desc') = 'VARCHAR' THEN json_extract_string(data, '$.desc') END AS desc, coalesce(json_extract(data, '$.invisible')::VARCHAR = 'true', false) AS invisible, coalesce(json_extract(data, '$.icon')::VARCHAR = 'true', false) AS has_icon, coalesce(len(json_keys(data, '$.req')), 0)::INT AS needs, coalesce(len(json_keys(data, '$.levels')), 0)::INT AS levels
FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE kind = 'skill' AND version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1)""")
def skills_catalog(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    return catalog.skills(_records(spark, d), table(spark, d, "blobs"), latest).select("id", "job", "name", "max_level", "desc", "invisible", "has_icon", F.size("req").alias("needs"), F.size("levels").alias("levels"), catalog.is_listed().alias("listed"))


@query(f"""WITH {_REC}, s AS (SELECT coalesce(try_cast(json_extract(data, '$.job') AS BIGINT), try_cast(key AS BIGINT) // 10000, 0) AS job,
coalesce(json_extract_string(data, '$.name') IS NOT NULL AND try_cast(json_extract(data, '$.max_level') AS BIGINT) > 0, false) AS listed
FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE kind = 'skill' AND version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1))
SELECT job, count(*) AS skills, count_if(listed)::BIGINT AS listed FROM s GROUP BY job""")
def skill_jobs(spark, d):
    latest = versions.resolve(table(spark, d, "client_versions"), "latest")
    return catalog.per_job(catalog.skills(_records(spark, d), table(spark, d, "blobs"), latest))


@query("""WITH l AS (SELECT record_id, j.value AS lv FROM nested_records n, json_each(CASE WHEN json_valid(data) AND json_type(data, '$.levels') = 'OBJECT' THEN json_extract(data, '$.levels') END) j WHERE kind = 'skill' AND json_type(j.value) = 'OBJECT'),
k AS (SELECT record_id, list_sort(list(DISTINCT stat)) AS stats FROM (SELECT record_id, unnest(json_keys(lv)) AS stat FROM l) WHERE stat <> 'text' GROUP BY ALL) SELECT key AS id, coalesce(array_to_string(stats, ','), '') AS stats FROM nested_records LEFT JOIN k USING (record_id) WHERE kind = 'skill'""")
def stat_keys(spark, d):
    rows = table(spark, d, "nested_records").where("kind = 'skill'").select(F.col("key").alias("id"), catalog.skill_fields("data")["levels"].alias("levels"))
    return catalog.stat_names(rows).select("id", F.array_join("stats", ",").alias("stats"))


@query("""WITH l AS (SELECT DISTINCT try_cast(trim(skill_id) AS BIGINT) AS skill_id, skill_level AS lv FROM skill_levels), g AS (SELECT skill_id, lv, lv - row_number() OVER (PARTITION BY skill_id ORDER BY lv) AS island FROM l),
i AS (SELECT skill_id, min(lv) AS a, max(lv) AS b FROM g GROUP BY skill_id, island)
SELECT skill_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '–' || b::VARCHAR END, ', ' ORDER BY a) AS levels FROM i GROUP BY skill_id""")
def level_ranges(spark, d):
    rows = table(spark, d, "skill_levels").select(F.trim("skill_id").try_cast("bigint").alias("skill_id"), "skill_level")
    return rows.groupBy("skill_id").agg(text.ranges(F.collect_set("skill_level")).alias("levels"))


@query(r"""WITH l AS (SELECT record_id, j.key AS lv, j.value AS v FROM nested_records n, json_each(CASE WHEN json_valid(data) AND json_type(data, '$.levels') = 'OBJECT' THEN json_extract(data, '$.levels') END) j WHERE kind = 'skill' AND json_type(j.value) = 'OBJECT'),
f AS (SELECT record_id, lv::INT AS lv, unnest(json_keys(v)) AS field FROM l WHERE regexp_full_match(lv, '[0-9]{1,9}')),
g AS (SELECT record_id, field, list_sort(list(lv)) AS levels, count(*) AS n, 'levels/' || min(lv) || '/' || field AS path FROM f GROUP BY record_id, field)
SELECT 'skill' AS kind, record_id::VARCHAR AS key, field, array_to_string(levels, ',') AS levels, n, path FROM g UNION ALL SELECT kind, record_id::VARCHAR, 'name', '', 1, 'name' FROM nested_records WHERE kind = 'skill'""")
def field_groups(spark, d):
    """The levels of skill payloads as fields that came, and one field without a level."""
    rows = table(spark, d, "nested_records").where("kind = 'skill'").select("kind", F.col("record_id").cast("string").alias("key"), "data")
    each = rows.select("kind", "key", F.explode(catalog.skill_fields("data")["levels"]).alias("lv", "stats")).select("kind", "key", "lv", F.explode("stats").alias("field", "new")).where("lv rlike '^[0-9]{1,9}$'")
    paths = each.select("kind", "key", F.concat_ws("/", F.lit("levels"), "lv", "field").alias("path")).unionByName(rows.select("kind", "key", F.lit("name").alias("path")))
    return diff.grouped_fields(paths.select("*", F.lit(None).cast("string").alias("old"), F.lit("1").alias("new"))).select("kind", "key", "field", F.array_join("levels", ",").alias("levels"), "n", "path")


# Payloads and files


@query("SELECT hash FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM records r WHERE lower(trim(r.blob_hash)) = b.hash)")
def orphan_blobs(spark, d):
    records = table(spark, d, "records").select(F.lower(F.trim("blob_hash")).alias("blob_hash"))
    return store.orphan_blobs(table(spark, d, "blobs"), records).select("hash")


@query("SELECT count(*) AS objects, coalesce(sum(strlen(data)), 0)::BIGINT AS bytes FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM records r WHERE lower(trim(r.blob_hash)) = b.hash)")
def gc_totals(spark, d):
    objects = table(spark, d, "blobs").select("hash", F.octet_length("data").alias("size"))
    used = table(spark, d, "records").select(F.lower(F.trim("blob_hash")).alias("hash"))
    return files.unreferenced(objects, used)


@query("""WITH f AS (SELECT sha256(text) AS hash, strlen(text) AS size FROM documents WHERE text IS NOT NULL), k AS (SELECT sha256(text) AS hash FROM eval_items)
SELECT (SELECT count(*) FROM f) AS files, (SELECT sum(size) FROM f)::BIGINT AS bytes, (SELECT sum(size) FROM (SELECT DISTINCT hash, size FROM f) WHERE hash NOT IN (SELECT hash FROM k))::BIGINT AS new_bytes""")
def import_totals(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("size"))
    return files.import_totals(docs, table(spark, d, "eval_items").select(F.sha2("text", 256).alias("hash")))


@query("""SELECT hash, CASE WHEN strlen(data) < 1024 THEN printf('%.1f B', strlen(data)::DOUBLE) ELSE printf('%.1f KiB', strlen(data) / 1024.0::DOUBLE) END AS size, substr(hash, 1, 2) || '/' || hash AS path FROM blobs""")
def object_list(spark, d):
    return table(spark, d, "blobs").select("hash", text.human_bytes(F.octet_length("data")).alias("size"), text.object_path(F.col("hash")).alias("path"))


@query(r"""WITH t AS (SELECT doc_id, string_split(replace(replace(replace(replace(replace(replace(replace(text, '\r', ''), chr(65533), ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\n', '<br>'), '#') AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i = 1 THEN p[1] ELSE CASE WHEN i > 2 AND regexp_matches(p[i - 1], '^[cbre]') THEN '</mark>' ELSE '' END || CASE WHEN regexp_matches(p[i], '^[cbre]') THEN '<mark>' ELSE '' END || regexp_replace(p[i], '^[cbrekn]', '') END), '')
 || CASE WHEN len(p) > 1 AND regexp_matches(p[len(p)], '^[cbre]') THEN '</mark>' ELSE '' END AS html FROM t""")
def game_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.game_html("text").alias("html"))


@query("SELECT n_nationkey, n_name, decode(from_base64(p)) AS path FROM (SELECT n_nationkey, n_name, to_base64(encode(n_name)) AS p FROM nation)")
def utf16_path(spark, d):
    raw = F.concat(F.unhex(F.lit("FFFE")), F.encode("n_name", "UTF-16LE"))
    return table(spark, d, "nation").select("n_nationkey", "n_name", text.utf16_path(F.base64(raw)).alias("path"))
