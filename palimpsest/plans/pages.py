"""Queries behind listings, pages, reports and selectors over the domain tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import canon, jobs, text
from palimpsest.operators import catalog, diff, facets, report, search, timeline, versions
from palimpsest.plans.reference import _CHOSEN, _DIFF, _FACETS, _JOBS, _LEAF, _REC, _REL, _category, _changes, _edited, _job, _pair, _records, collected
from palimpsest.sources.tables import release_order, releases, table

QUERIES, ORACLE, query = collected()

_JOB_TABLE = f"jobs(id, name, branch, advancement) AS (VALUES {_JOBS})"


def _quoted(c: str) -> str:
    return f"'`' || replace(CASE WHEN {c} IS NULL THEN '∅' WHEN length({c}) > 120 THEN left({c}, 119) || '…' ELSE {c} END, '`', '''') || '`'"


def _latest(spark: SparkSession, d: str) -> int:
    return versions.resolve(table(spark, d, "client_versions"), "latest")


# Versions and selectors


@query(f"WITH {_REL} SELECT r.version_id, r.label, channel, (SELECT count(*) FROM rel) - ord + 1 AS rank FROM rel r JOIN client_versions USING (version_id)")
def versions_newest_first(spark, d):
    return versions.newest_first(table(spark, d, "client_versions"))


@query(f"""WITH {_REL}, s AS (SELECT 'latest' AS selector, (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AS version_id UNION ALL SELECT 'previous', (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1 OFFSET 1)
UNION ALL SELECT 'baseline', (SELECT version_id FROM rel ORDER BY ord LIMIT 1) UNION ALL SELECT label, version_id FROM rel UNION ALL SELECT '#' || version_id, version_id FROM rel) SELECT * FROM s""")
def version_selectors(spark, d):
    have = table(spark, d, "client_versions")
    order = release_order(have)
    names = ["latest", "previous", "baseline", *(label for _, label in order), *(f"#{v}" for v, _ in order)]
    return spark.createDataFrame([(n, versions.resolve(have, n, order[0][1])) for n in names], "selector string, version_id bigint")


@query("""SELECT label, regexp_full_match(label, '[A-Za-z0-9_-][A-Za-z0-9._-]*') AND label NOT IN ('latest', 'previous', 'baseline') AS valid
FROM (SELECT version AS label FROM history_events WHERE version IS NOT NULL UNION SELECT key FROM history_events WHERE key IS NOT NULL UNION SELECT label FROM client_versions)""")
def label_rules(spark, d):
    events = table(spark, d, "history_events")
    names = events.select(F.col("version").alias("label")).union(events.select("key")).union(table(spark, d, "client_versions").select("label")).where("label is not null").distinct()
    return names.select("label", versions.is_label(F.col("label")).alias("valid"))


@query(f"""WITH {_REL} SELECT (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1 OFFSET 1) AS "from", (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AS "to" """)
def diff_page_versions(spark, d):
    """The page of changes compares with the version before, whatever the baseline."""
    have = table(spark, d, "client_versions")
    new = versions.resolve(have, "latest")
    return spark.createDataFrame([(versions.previous(have, new), new)], "`from` bigint, `to` bigint")


# Changes on a page


def _faceted(spark: SparkSession, d: str) -> DataFrame:
    return facets.with_facets(_changes(spark, d), F.when(F.col("kind") == "skill", canon.strict(F.coalesce("new_data", "old_data"), "job", "int")))


_PAGE = f"""{_LEAF}, c AS (SELECT p.*, {_category('p.')} AS category, {_job('coalesce(new_data, old_data)')} AS job, CASE WHEN kind IN ('img', 'file') THEN 'raw' ELSE 'data' END AS detail FROM p),
{_JOB_TABLE}, tx AS (SELECT kind, key, bool_and((old IS NULL OR old LIKE '"%') AND (new IS NULL OR new LIKE '"%')) AS texts FROM f GROUP BY ALL),
pg AS (SELECT c.*, branch, advancement, coalesce(status = 'modified' AND texts, false) AS text_only FROM c LEFT JOIN jobs ON jobs.id = c.job LEFT JOIN tx USING (kind, key))"""


@query(f"WITH {_PAGE} SELECT kind, key, status FROM pg WHERE status IN ('added', 'modified')")
def diff_status_filter(spark, d):
    found = diff.diff(_records(spark, d), *_pair(spark, d))
    return found.where(diff.has_status(["modified", "added", "unknown"])).select("kind", "key", "status")


@query(f"""WITH {_PAGE} SELECT count_if(detail = 'raw')::BIGINT AS raw, count_if(detail = 'data' AND text_only AND status IN ('modified', 'removed'))::BIGINT AS text_only,
count_if(detail = 'data' AND status = 'added' AND NOT text_only)::BIGINT AS added, count_if(detail = 'data' AND status = 'removed' AND NOT text_only)::BIGINT AS removed,
count_if(detail = 'data' AND status = 'modified' AND NOT text_only)::BIGINT AS modified, count_if(detail = 'data' AND NOT text_only AND status IN ('modified', 'removed'))::BIGINT AS shown FROM pg""")
def diff_chip_counts(spark, d):
    return diff.chip_counts(_faceted(spark, d), facets.FacetFilter(data_only=True).condition(), ["modified", "removed"], hide_text=True)


_TOP = "SELECT kind, key, status, category, count(*) OVER (PARTITION BY category) AS total, row_number() OVER (PARTITION BY category ORDER BY kind, key) AS place FROM pg"


@query(f"WITH {_PAGE} SELECT kind, key, status, category, total FROM ({_TOP}) WHERE place <= 100 OR category = 'maps'")
def diff_top_per_category(spark, d):
    return facets.top_categories(_faceted(spark, d), facets.FacetFilter(), every="maps").select("kind", "key", "status", "category", "total")


@query(f"WITH {_PAGE} SELECT kind, key, status, category, total FROM ({_TOP} WHERE category = 'monsters')")
def diff_one_category(spark, d):
    """With one category chosen the limit is lifted."""
    chosen = facets.FacetFilter().add_category("Monsters")
    return facets.top_categories(_faceted(spark, d).where(chosen.condition()), chosen).select("kind", "key", "status", "category", "total")


@query(f"WITH {_PAGE} SELECT kind, key, status FROM pg WHERE detail = 'data' AND (branch = 'warrior' OR branch = 'thief') AND job IN (111, 100)")
def diff_selected_jobs(spark, d):
    """Selectors as a user writes them: branches hold together with jobs, and alternatives within each."""
    chosen = facets.FacetFilter(data_only=True)
    for selector in ("Warrior", "thief", "crusader", "100"):
        chosen = chosen.add_job(selector)
    return _faceted(spark, d).where(chosen.condition()).select("kind", "key", "status")


@query(f"""WITH {_PAGE}, v AS (SELECT (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1 OFFSET 1) AS old, (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AS new)
SELECT kind, key, status, CASE WHEN status = 'removed' THEN v.old ELSE v.new END AS side, CASE WHEN status = 'removed' THEN old_data ELSE new_data END AS data FROM pg, v""")
def diff_cards(spark, d):
    return diff.card(_changes(spark, d), *_pair(spark, d)).withColumn("side", F.col("side").cast("bigint"))


@query(f"WITH {_REC} SELECT version_id, section, count(r.kind) AS n FROM (SELECT DISTINCT version_id FROM rec) v CROSS JOIN (VALUES ('Gear', 'string/Gear'), ('Use & quests', 'string/Use'), ('Use & quests', 'string/Quest'), ('Monsters', 'string/Mob'), ('Pets', 'string/Pet')) AS s(section, kind) LEFT JOIN rec r USING (version_id, kind) GROUP BY ALL")
def home_sections(spark, d):
    """Sections of kinds, also one of two kinds and one without records, of every version."""
    wanted = {"Gear": ["string/Gear"], "Use & quests": ["string/Use", "string/Quest"], "Monsters": ["string/Mob"], "Pets": ["string/Pet"]}
    counts = _records(spark, d).groupBy("version_id", "kind").agg(F.count("*").alias("n"))
    return facets.sections(counts, wanted, ["version_id"])


# Search


@query(f"""WITH {_REC} SELECT kind, key, CASE WHEN json_type(data, '$.name') = 'VARCHAR' THEN json_extract_string(data, '$.name') WHEN json_type(data, '$.mapName') = 'VARCHAR' THEN json_extract_string(data, '$.mapName') END AS name
FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AND (kind = 'string/Map' OR kind ILIKE 'string/Map/%')""")
def search_names(spark, d):
    """An empty text finds all records of a kind."""
    return search.search(_records(spark, d), table(spark, d, "blobs"), _latest(spark, d), "", kind="string/Map").select("kind", "key", "name")


@query(f"""WITH {_REC}, h AS (SELECT kind, key, data FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash
 WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AND (key ILIKE '%ferry%' OR data ILIKE '%ferry%') ORDER BY kind, key LIMIT 20)
SELECT kind, key, rpad(kind, greatest(20, length(kind))::INT, ' ') || ' ' || rpad(key, greatest(32, length(key))::INT, ' ') || ' ' || CASE WHEN data IS NULL THEN '∅' WHEN length(data) > 80 THEN left(data, 79) || '…' ELSE data END AS line FROM h
UNION ALL SELECT '', '', '(showing first 20; use --limit for more)' FROM h HAVING count(*) = 20""")
def search_lines(spark, d):
    found = search.search(_records(spark, d), table(spark, d, "blobs"), _latest(spark, d), "ferry", most=20)
    return report.hits(found, 20).select("kind", "key", "line")


# Reports


@query(f"""WITH {_LEAF}, v AS (SELECT (SELECT label FROM rel ORDER BY ord DESC LIMIT 1 OFFSET 1) AS old, (SELECT label FROM rel ORDER BY ord DESC LIMIT 1) AS new),
q AS (SELECT kind, key, status, CASE WHEN status = 'added' THEN new_data ELSE old_data END AS data, row_number() OVER (PARTITION BY kind ORDER BY key) AS place FROM p),
k AS (SELECT kind, count_if(status = 'added') AS added, count_if(status = 'removed') AS removed, count_if(status = 'modified') AS modified, count(*) AS total FROM p GROUP BY kind)
SELECT 0 AS block, '' AS kind, '' AS key, 0 AS n, '# Changes: ' || old || ' → ' || new AS line FROM v
UNION ALL SELECT 1, '', '', n, line FROM (VALUES (0, ''), (1, '| Kind | Added | Removed | Modified |'), (2, '|---|---:|---:|---:|')) AS h(n, line)
UNION ALL SELECT 2, kind, '', 0, '| `' || kind || '` | ' || added || ' | ' || removed || ' | ' || modified || ' |' FROM k
UNION ALL SELECT 3, kind, '', n, CASE WHEN n = 1 THEN '## `' || kind || '`' ELSE '' END FROM k, (VALUES (0), (1), (2)) AS h(n)
UNION ALL SELECT 3, kind, key, 0, CASE status WHEN 'modified' THEN '- **changed** `' || key || '`' ELSE '- **' || status || '** `' || key || '` ' || {_quoted("data")} END FROM q WHERE place <= 30
UNION ALL SELECT 3, kind, key, row_number() OVER (PARTITION BY kind, key ORDER BY path), '  - `' || path || '`: ' || {_quoted("old")} || ' → ' || {_quoted("new")} FROM f JOIN q USING (kind, key) WHERE place <= 30 AND q.status = 'modified'
UNION ALL SELECT 3, kind, '', 0, '  … ' || (total - 30) || ' more (use --limit 0 for all)' FROM k WHERE total > 30""")
def report_markdown(spark, d):
    old, new = _pair(spark, d)
    label = dict(release_order(table(spark, d, "client_versions")))
    return report.changes(_changes(spark, d), label[old], label[new], 30, report.MARKDOWN).select("block", "kind", "key", "n", "line")


@query()
def report_text(spark, d):
    """All changes as the plain report shows them. No SQL: it marks the words of edited texts."""
    old, new = _pair(spark, d)
    label = dict(release_order(table(spark, d, "client_versions")))
    return report.changes(_changes(spark, d), label[old], label[new], 0).select(*report.ORDER, "line")


_GRID = f"""{_REC}, cov AS (SELECT DISTINCT kind, rec.version_id, ord FROM rec JOIN rel USING (version_id)),
grid AS (SELECT k.kind, k.key, c.version_id, c.ord FROM (SELECT DISTINCT kind, key FROM rec) k JOIN cov c USING (kind)),
s AS (SELECT g.*, r.version_id IS NOT NULL AS there, r.hash, r.blob_hash, lag(r.version_id IS NOT NULL) OVER w AS was, lag(r.hash) OVER w AS old FROM grid g LEFT JOIN rec r USING (kind, key, version_id) WINDOW w AS (PARTITION BY g.kind, g.key ORDER BY g.ord)),
ev AS (SELECT s.kind, s.key, s.version_id, s.ord, CASE WHEN there AND NOT coalesce(was, false) THEN 'added' WHEN NOT there THEN 'removed' ELSE 'changed' END AS status, data FROM s LEFT JOIN blobs b ON b.hash = s.blob_hash WHERE there <> coalesce(was, false) OR (there AND s.hash IS DISTINCT FROM s.old))"""


@query(f"""WITH {_GRID} SELECT kind, key, 0::BIGINT AS ord, kind || ' ' || key AS line FROM ev WHERE kind = 'img' GROUP BY kind, key
UNION ALL SELECT kind, key, ev.ord, '  ' || rpad(label, greatest(24, length(label))::INT, ' ') || ' ' || rpad(status, 8, ' ') || ' ∅' FROM ev JOIN rel USING (version_id) WHERE kind = 'img'""")
def history_lines(spark, d):
    """The report of all images, whose events have no payload and so no fields."""
    have = table(spark, d, "client_versions")
    found = timeline.events(_records(spark, d).where("kind = 'img'"), releases(spark, have))
    found = diff.attach(found, table(spark, d, "blobs"), "blob_hash", "data").withColumn("fields", F.array().cast(canon.FIELDS))
    return report.history(found, have).select("kind", "key", (F.col("n") / (1 << 20)).cast("bigint").alias("ord"), "line")


def _levels_told(df: DataFrame) -> DataFrame:
    return df.withColumn("levels", F.array_join(F.transform("levels", lambda x: x.cast("string")), ","))


# Edited texts: what is marked gives both texts back


@query(f"""WITH {_LEAF} SELECT kind, key, path, json_extract_string(old, '$') AS before, json_extract_string(new, '$') AS after FROM f WHERE old LIKE '"%' AND new LIKE '"%'""")
def text_diff_sides(spark, d):
    """The old text from what stays and is removed, the new one from what stays and is added."""
    side = lambda op: F.array_join(F.transform(F.filter("diff", lambda s: s["op"] != op), lambda s: s["text"]), "")
    return _edited(spark, d).select("kind", "key", "path", side("added").alias("before"), side("removed").alias("after"))


@query(f"""WITH {_LEAF}, lv AS (SELECT kind, key, path, old, new FROM f) SELECT kind, key, path AS label, '' AS levels, old, new FROM lv""")
def field_table(spark, d):
    return _levels_told(diff.field_table(diff.field_rows(_changes(spark, d))))


@query(r"""WITH s AS (SELECT record_id, j.fullkey, j.value::VARCHAR AS v FROM nested_records n, json_tree(CASE WHEN json_valid(data) THEN data END) j WHERE kind = 'skill' AND regexp_full_match(j.fullkey, '\$\.levels\.[0-9]+\.(dmgPct|mpCost)|\$\.levels\."[0-9]+"\.(dmgPct|mpCost)')),
c AS (SELECT record_id::VARCHAR AS key, regexp_extract(fullkey, '([0-9]+)', 1)::INT AS level, regexp_extract(fullkey, '([A-Za-z]+)$', 1) AS field, v FROM s),
g AS (SELECT key, field, count(*) AS n, list_sort(list(level)) AS levels, min_by(v, level) AS v FROM c GROUP BY ALL)
SELECT 'skill' AS kind, key, label, array_to_string(levels, ',') AS levels, NULL::VARCHAR AS old, v AS new FROM (SELECT g.key, levels, v, 'Lv ' || (SELECT string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a::VARCHAR || '–' || b::VARCHAR END, ', ' ORDER BY a) FROM
 (SELECT min(x) AS a, max(x) AS b FROM (SELECT x, x - row_number() OVER (ORDER BY x) AS island FROM (SELECT unnest(levels) AS x)) GROUP BY island)) || ' · ' || field || ' (' || n || ' levels)' AS label FROM g WHERE n >= 3
UNION ALL SELECT c.key, [level], c.v, 'Lv ' || level || ' · ' || c.field FROM c JOIN g ON g.key = c.key AND g.field = c.field WHERE n < 3)""")
def level_table(spark, d):
    """The levels of skill payloads as fields that came, three and more of a field as one row."""
    rows = table(spark, d, "nested_records").where("kind = 'skill'").select(F.col("record_id").cast("string").alias("key"), catalog.skill_fields("data")["levels"].alias("levels"))
    each = rows.select("key", F.explode("levels").alias("lv", "stats")).select("key", "lv", F.explode("stats").alias("field", "new")).where("field in ('dmgPct', 'mpCost') and lv rlike '^[0-9]+$'")
    fields = each.select(F.lit("skill").alias("kind"), "key", F.concat_ws("/", F.lit("levels"), "lv", "field").alias("path"), F.lit(None).cast("string").alias("old"), "new")
    return _levels_told(diff.field_table(fields))


# Skills

_SKILL = f"""{_REC}, k AS (SELECT rec.version_id, key AS id, coalesce(try_cast(json_extract(data, '$.job') AS BIGINT), try_cast(key AS BIGINT) // 10000, 0) AS job, CASE WHEN json_type(data, '$.name') = 'VARCHAR' THEN json_extract_string(data, '$.name') END AS name,
 coalesce(try_cast(json_extract(data, '$.max_level') AS BIGINT), 0) AS max_level, data FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE kind = 'skill'),
kk AS (SELECT *, name IS NOT NULL AND max_level > 0 AS listed FROM k)"""


def _all_skills(spark: SparkSession, d: str, version: int | None = None) -> DataFrame:
    return catalog.skills(_records(spark, d), table(spark, d, "blobs"), version)


@query(f"WITH {_SKILL} SELECT version_id, count(*) AS skills, count_if(listed)::BIGINT AS listed FROM kk GROUP BY version_id")
def skills_per_version(spark, d):
    return _all_skills(spark, d).groupBy("version_id").agg(F.count("*").alias("skills"), F.count_if(catalog.is_listed()).alias("listed"))


@query(f"""WITH {_SKILL}, {_JOB_TABLE} SELECT branch, job, coalesce(jobs.name, 'Job ' || job) AS job_name, advancement, count(*) AS listed FROM kk LEFT JOIN jobs ON jobs.id = kk.job WHERE listed AND version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) GROUP BY ALL""")
def skills_index(spark, d):
    return catalog.index(_all_skills(spark, d, _latest(spark, d)))


@query(f"""WITH {_SKILL}, {_JOB_TABLE} SELECT kk.id, coalesce(kk.name, 'Skill ' || kk.id) AS label, coalesce(jobs.name, 'Job ' || job) AS job_name, listed FROM kk LEFT JOIN jobs ON jobs.id = kk.job WHERE version_id = (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1) AND (listed OR branch = 'warrior')""")
def skills_listed_or_warrior(spark, d):
    rows = jobs.named(catalog.labelled(_all_skills(spark, d, _latest(spark, d))).withColumn("listed", catalog.is_listed()), "job")
    return rows.where("listed or branch = 'warrior'").select("id", "label", "job_name", "listed")


@query("""WITH s AS (SELECT regexp_replace(trim(id), '^0+(?=.)', '') AS id, req FROM skills), n AS (SELECT try_cast(trim(id) AS BIGINT) AS id, max(name) AS name FROM skills GROUP BY ALL),
e AS (SELECT DISTINCT try_cast(trim(id) AS BIGINT) AS id, try_cast(trim(u.key) AS BIGINT) AS need FROM (SELECT id, unnest(map_entries(req)) AS u FROM skills))
SELECT e.id, need, coalesce(n.name, need::VARCHAR) AS need_name FROM e LEFT JOIN n ON n.id = need WHERE e.id IS NOT NULL AND need IS NOT NULL""")
def skill_needs(spark, d):
    """What each skill of the table of skills needs, by name, or by number where no skill has it."""
    from palimpsest.plans.problems import number

    rows = table(spark, d, "skills").select(number(F.col("id")).alias("id"), "name", "req")
    names = rows.groupBy("id").agg(F.max("name").alias("name")).withColumnRenamed("id", "need")
    each = rows.select("id", F.explode(F.map_keys("req")).alias("need")).select("id", number(F.col("need")).alias("need")).where("id is not null and need is not null").distinct()
    return each.join(names, "need", "left").select("id", "need", F.coalesce("name", F.col("need").cast("string")).alias("need_name"))


@query("""WITH l AS (SELECT record_id, j.value AS lv FROM nested_records n, json_each(CASE WHEN json_valid(data) AND json_type(data, '$.levels') = 'OBJECT' THEN json_extract(data, '$.levels') END) j WHERE kind = 'skill' AND json_type(j.value) = 'OBJECT'),
k AS (SELECT DISTINCT record_id, unnest(json_keys(lv)) AS stat FROM l) SELECT record_id, stat FROM k WHERE stat <> 'text'""")
def stat_columns(spark, d):
    rows = table(spark, d, "nested_records").where("kind = 'skill'").select(F.col("record_id").alias("id"), catalog.skill_fields("data")["levels"].alias("levels"))
    return catalog.stat_names(rows).select(F.col("id").alias("record_id"), F.explode("stats").alias("stat"))


# Jobs and selectors


@query(f"""WITH {_JOB_TABLE}, s AS (SELECT DISTINCT trim(id) AS selector FROM skills UNION SELECT name FROM jobs UNION SELECT upper(name) FROM jobs UNION SELECT source FROM mix_targets)
SELECT selector, CASE WHEN regexp_full_match(selector, '\\+?[0-9]+') AND try_cast(selector AS HUGEINT) < 4294967296 THEN try_cast(selector AS BIGINT) ELSE (SELECT min(id) FROM jobs WHERE lower(name) = lower(selector)) END AS job FROM s WHERE selector IS NOT NULL""")
def job_selectors(spark, d):
    known = jobs.dimension(spark)
    names = table(spark, d, "skills").select(F.trim("id").alias("selector")).union(known.select("name")).union(known.select(F.upper("name"))).union(table(spark, d, "mix_targets").select("source"))
    return names.where("selector is not null").distinct().select("selector", jobs.selected(F.col("selector"), known).alias("job"))


@query("""SELECT text, CASE lower(trim(text)) WHEN '0' THEN 0 WHEN 'beginner' THEN 0 WHEN '1' THEN 1 WHEN '1st' THEN 1 WHEN 'first' THEN 1 WHEN '2' THEN 2 WHEN '2nd' THEN 2 WHEN 'second' THEN 2 WHEN '3' THEN 3 WHEN '3rd' THEN 3 WHEN 'third' THEN 3 WHEN '4' THEN 4 WHEN '4th' THEN 4 WHEN 'fourth' THEN 4 END AS advancement
FROM (VALUES ('Beginner'), ('0'), (' 1st'), ('FIRST '), ('1'), ('2nd'), ('second'), ('3'), ('Third'), ('4th'), ('fourth'), ('5th'), (''), ('first job')) AS t(text)""")
def advancement_selectors(spark, d):
    texts = ["Beginner", "0", " 1st", "FIRST ", "1", "2nd", "second", "3", "Third", "4th", "fourth", "5th", "", "first job"]
    return spark.createDataFrame([(t, jobs.parse_advancement(t)) for t in texts], "text string, advancement int")


# Text and numbers for display


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_ms(ts) % 1000 = 0 THEN '' ELSE printf('.%03d', epoch_ms(ts) % 1000) END || '+00:00' AS time,
strftime(ts, '%Y-%m-%dT%H:%M:%S') AS short, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM (SELECT event_id, date_trunc('milliseconds', ts) AS ts FROM events)""")
def event_times(spark, d):
    seconds = F.unix_millis(F.col("ts").cast("timestamp")) / F.lit(1000.0)
    times = table(spark, d, "events").select("event_id", text.rfc3339(seconds).alias("time"))
    return times.select("event_id", "time", text.short_time(F.col("time")).alias("short"), text.minute(F.col("time")).alias("minute"))


@query("""SELECT event_id, CASE WHEN isfinite(x) THEN x END AS value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'nan'::DOUBLE WHEN event_id % 3 = 1 THEN 'inf'::DOUBLE ELSE value END AS x FROM events)""")
def finite_values(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", canon.finite(odd).alias("value"))


@query("""SELECT hash, url_encode(data) AS in_query, array_to_string(list_transform(string_split(data, ''), lambda c: CASE WHEN regexp_matches(c, '[\\x00-\\x20"#%<>?`{}]') OR strlen(c) > 1 THEN url_encode(c) ELSE c END), '') AS in_path
FROM (SELECT hash, data FROM blobs)""".replace("url_encode(data) AS in_query", "replace(replace(replace(replace(url_encode(data), '-', '%2D'), '.', '%2E'), '_', '%5F'), '~', '%7E') AS in_query"))
def url_texts(spark, d):
    return table(spark, d, "blobs").select("hash", text.url_query(F.col("data")).alias("in_query"), text.url_path(F.col("data")).alias("in_path"))


@query("""WITH s AS (SELECT version_id, string_agg(extractor, ' , ' ORDER BY extractor) || ',' AS items FROM extractions GROUP BY version_id), p AS (SELECT version_id, list_filter(list_transform(string_split(items, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM s)
SELECT version_id, array_to_string(l, '|') AS parsed, CASE WHEN list_contains(l, 'skills') THEN array_to_string(list_filter(l, lambda x: x <> 'skills'), ',') ELSE array_to_string(list_append(l, 'skills'), ',') END AS toggled FROM p""")
def toggled_lists(spark, d):
    items = table(spark, d, "extractions").groupBy("version_id").agg(F.concat(F.array_join(F.sort_array(F.collect_list("extractor")), " , "), F.lit(",")).alias("items"))
    return items.select("version_id", F.array_join(text.listed(F.col("items")), "|").alias("parsed"), text.toggled(F.col("items"), F.lit("skills")).alias("toggled"))


@query("""SELECT hash, j.key AS name, CASE json_type(j.value) WHEN 'OBJECT' THEN len(json_keys(j.value)) || ' entries' WHEN 'VARCHAR' THEN json_extract_string(j.value, '$') ELSE j.value::VARCHAR END AS text FROM blobs, json_each(data) j""")
def key_value_texts(spark, d):
    return table(spark, d, "blobs").select("hash", F.explode(text.key_values(F.col("data"))).alias("e")).select("hash", "e.name", "e.text")


@query("""SELECT hash, j.key AS name, CASE j.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' ELSE 'null' END AS type FROM blobs, json_each(data) j""")
def member_types(spark, d):
    members = table(spark, d, "blobs").select("hash", F.explode(F.from_json("data", "map<string,variant>")).alias("name", "v"))
    return members.select("hash", "name", canon.type_name(F.to_json("v")).alias("type"))


@query("""SELECT doc_id, trim(replace(split_part(regexp_replace(regexp_replace(text, '^\\s*\\[[^\\]]*\\]', ''), '^(\\s|\\\\n)+', ''), '\\n', 1), '#', ''), ' ') AS summary FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '(?s)[\\x00-\\x7f]*')""".replace(" AND regexp_full_match(text, '(?s)[\\x00-\\x7f]*')", ""))
def doc_summaries(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("""SELECT hash, '`' || replace(CASE WHEN length(data) > 120 THEN left(data, 119) || '…' ELSE data END, '`', '''') || '`' AS shown FROM blobs""")
def markdown_values(spark, d):
    return table(spark, d, "blobs").select("hash", text.markdown_value(F.col("data")).alias("shown"))


@query("""SELECT version_id, replace(source_path, '/mnt/clients/', '') || '/Data/x.wz' AS path FROM client_versions""")
def relative_paths(spark, d):
    raw = F.concat(F.lit("file:"), F.replace(F.col("source_path"), F.lit("/"), F.lit("\\")), F.lit("\\Data\\x.wz"))
    return table(spark, d, "client_versions").select("version_id", text.relative_path(raw, "/mnt/clients").alias("path"))
