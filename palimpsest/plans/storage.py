"""Queries that write and read back: the store, files and manifests, the tree of nodes. Each works in a scratch folder."""

from __future__ import annotations

import base64
import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import diff, extract
from palimpsest.plans.reference import _REC, _records, collected
from palimpsest.session import shared_dir
from palimpsest.sources import files, ingest, nodes
from palimpsest.sources.store import Store, export_json, orphan_blobs
from palimpsest.sources.tables import release_order, table

QUERIES, ORACLE, query = collected()


def _folder(spark: SparkSession) -> str:
    """A folder of its own that goes with the application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/palimpsest-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _put(spark: SparkSession, path: str, content: bytes) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()


# The store

#: The source that the queries put into the store.
SOURCE = "skills"


_READ: dict[tuple[str, str], Store] = {}


def _filled_once(spark: SparkSession, d: str) -> Store:
    """A filled store for queries that only read it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _READ:
        _READ[key] = _filled(spark, d)
    return _READ[key]


def _filled(spark: SparkSession, d: str, which: int | None = None) -> Store:
    """A store with all versions, and with the records of one source of each version in release order, the payloads with them."""
    store = Store(spark, _folder(spark))
    rows = spark.read.parquet(f"{d}/client_versions.parquet").orderBy("version_id").collect()
    made = {r.version_id: store.insert_version(r.label, r.channel, r.source_path, r.manifest_hash, r.build_time, r.note, r.imported_at) for r in rows}
    found = diff.attach(_records(spark, d).where(F.col("source") == SOURCE), table(spark, d, "blobs"), "blob_hash", "data").cache()
    for v, _ in release_order(table(spark, d, "client_versions"))[: which or None]:
        store.replace_records(made[v], SOURCE, found.where(F.col("version_id") == v).select("kind", "key", "hash", "data"), "then")
    found.unpersist()
    return store


@query("SELECT version_id, label, channel, imported_at, source_path, manifest_hash, build_time, note FROM client_versions")
def store_versions(spark, d):
    """Versions put in one by one: their ids are their places in the order of import."""
    return _filled(spark, d, 1).table("versions")


_IN = f"{_REC}, i AS (SELECT rec.*, data FROM rec LEFT JOIN blobs b ON b.hash = rec.blob_hash WHERE source = '{SOURCE}')"


@query(f"WITH {_IN} SELECT version_id, source, kind, key, hash, CASE WHEN data IS NOT NULL THEN sha256(data) END AS blob_hash FROM i")
def store_records(spark, d):
    return _filled_once(spark, d).table("records")


@query(f"WITH {_IN} SELECT DISTINCT sha256(data) AS hash, data FROM i WHERE data IS NOT NULL")
def store_payloads(spark, d):
    """Payloads come in with every version and are kept once."""
    return _filled_once(spark, d).table("blobs")


@query(f"WITH {_IN}, n AS (SELECT version_id, count(*) AS c FROM i GROUP BY version_id) SELECT version_id, '{SOURCE}' AS extractor, coalesce(c, 0) AS record_count, 'then' AS finished_at FROM client_versions LEFT JOIN n USING (version_id)")
def store_extractions(spark, d):
    """Marks of completion; a version without records has one too."""
    return _filled_once(spark, d).table("extractions")


_KEPT = f"{_IN}, last AS (SELECT version_id FROM rel ORDER BY ord DESC LIMIT 1)"


@query(f"WITH {_KEPT} SELECT DISTINCT sha256(data) AS hash FROM i WHERE data IS NOT NULL AND version_id NOT IN (SELECT version_id FROM last)")
def store_after_removal(spark, d):
    """The payloads that are left when the last version is removed and what nothing refers to is dropped."""
    store = _filled(spark, d)
    last = release_order(store.table("versions"))[-1][0]
    store.remove_version(last)
    store.gc()
    assert orphan_blobs(store.table("blobs"), store.table("records")).head() is None
    return store.table("blobs").select("hash")


@query(f"""WITH {_KEPT} SELECT 0::BIGINT AS objects, 0::BIGINT AS bytes, count(*) AS blobs FROM (SELECT DISTINCT sha256(data) AS h FROM i WHERE data IS NOT NULL
 EXCEPT SELECT sha256(data) FROM i WHERE version_id NOT IN (SELECT version_id FROM last) AND data IS NOT NULL)""")
def store_gc_report(spark, d):
    store = _filled(spark, d)
    store.remove_version(release_order(store.table("versions"))[-1][0])
    return spark.createDataFrame([tuple(store.gc().values())], "objects bigint, bytes bigint, blobs bigint")


@query("""WITH v AS (SELECT version_id, label FROM client_versions ORDER BY version_id), f AS (SELECT label FROM v LIMIT 1), s AS (SELECT label FROM v LIMIT 1 OFFSET 1)
SELECT (SELECT label FROM f) AS first, (SELECT label FROM s) AS chosen, NULL::VARCHAR AS removed, '2' AS layout""")
def store_baseline(spark, d):
    """The first version becomes the baseline, another can be set, and it goes with its version."""
    store = _filled(spark, d, 1)
    labels = [label for _, label in sorted(release_order(store.table("versions")))]
    first = store.meta("baseline")
    store.set_meta("baseline", labels[1])
    chosen = store.meta("baseline")
    store.remove_version(2)
    return spark.createDataFrame([(first, chosen, store.meta("baseline"), store.meta("layout"))], "first string, chosen string, removed string, layout string")


@query("""SELECT version_id, extractor, 0::BIGINT AS record_count, CASE WHEN extractor = 'images' THEN 'again' ELSE finished_at END AS finished_at FROM extractions""")
def upsert_extractions(spark, d):
    store = Store(spark, _folder(spark))
    have = table(spark, d, "extractions").select("version_id", "extractor", F.lit(0).cast("bigint").alias("record_count"), "finished_at")
    keys = ["version_id", "extractor"]
    store.upsert("extractions", keys, have)
    store.upsert("extractions", keys, have.where("extractor = 'images'").withColumn("finished_at", F.lit("again")))
    return store.table("extractions")


@query("""SELECT to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type, 'none': NULL})::VARCHAR AS line FROM events""")
def export_lines(spark, d):
    path = f"{_folder(spark)}/lines"
    export_json(table(spark, d, "events").select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("none")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("SELECT DISTINCT hash, data FROM blobs")
def blob_dedup(spark, d):
    """Payloads that come twice, half of them stored already: what is new is added once."""
    from palimpsest.sources.store import new_blobs

    blobs = table(spark, d, "blobs")
    have = blobs.where("hash < '8'")
    fresh = new_blobs(blobs.unionByName(blobs), have)
    return have.select("hash", "data").unionByName(fresh.select("hash", "data"))


# Files. The texts of eval_items are the files of a client, written one by one; a real client's are there already.


def _client(spark: SparkSession, d: str, again: bool = False) -> str:
    root = _folder(spark)
    for r in table(spark, d, "eval_items").select("item_id", "text", "task").toLocalIterator():
        _put(spark, f"{root}/Data/{r.task}/{r.item_id}.txt", (r.text + ("!" if again and r.item_id % 2 else "")).encode())
    _put(spark, f"{root}/Data/Base/Base.wz", b"base")
    _put(spark, f"{root}/MapleStory.exe", b"exe")
    _put(spark, f"{root}/Other.dll", b"not kept")
    return root


_FILES = """i AS (SELECT 'Data/' || task || '/' || item_id || '.txt' AS path, item_id, text FROM eval_items),
one AS (SELECT path, text FROM i UNION ALL SELECT 'Data/Base/Base.wz', 'base' UNION ALL SELECT 'MapleStory.exe', 'exe'),
two AS (SELECT path, CASE WHEN item_id % 2 = 1 THEN text || '!' ELSE text END AS text FROM i UNION ALL SELECT 'Data/Base/Base.wz', 'base' UNION ALL SELECT 'MapleStory.exe', 'exe')"""


@query(f"WITH {_FILES} SELECT path, strlen(text) AS size, sha256(text) AS hash FROM one")
def client_files(spark, d):
    return files.scan(spark, _client(spark, d))


@query(f"""WITH {_FILES}, r AS (SELECT 1 AS import, path, text FROM one UNION ALL SELECT 2, path, text FROM two) SELECT import, path AS key, sha256(text) AS hash, '{{"size":' || strlen(text) || '}}' AS data FROM r""")
def imported_records(spark, d):
    """Two imports of a client that changes in between, as records of files."""
    store = Store(spark, _folder(spark))
    for label, again in (("one", False), ("two", True)):
        ingest.import_client(store, _client(spark, d, again), label)
    rows = diff.attach(store.table("records"), store.table("blobs"), "blob_hash", "data")
    return rows.select(F.col("version_id").cast("int").alias("import"), "key", "hash", "data")


@query(f"""WITH {_FILES} SELECT 1 AS import, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, (SELECT sum(strlen(text)) FROM (SELECT DISTINCT text FROM one))::BIGINT AS new_bytes, true AS became_baseline FROM one
UNION ALL SELECT 2, count(*), sum(strlen(text))::BIGINT, coalesce((SELECT sum(strlen(text)) FROM (SELECT DISTINCT text FROM two WHERE text NOT IN (SELECT text FROM one))), 0)::BIGINT, false FROM two""")
def import_reports(spark, d):
    store = Store(spark, _folder(spark))
    told = [ingest.import_client(store, _client(spark, d, again), label) for label, again in (("one", False), ("two", True))]
    keys = ("version_id", "files", "bytes", "new_bytes", "became_baseline")
    return spark.createDataFrame([tuple(t[k] for k in keys) for t in told], "import int, files bigint, bytes bigint, new_bytes bigint, became_baseline boolean")


@query(f"WITH {_FILES} SELECT path, strlen(text) AS size, text FROM two")
def snapshot_files(spark, d):
    """The tree of the second import with its contents, when the first is gone and what it alone held was dropped."""
    store = Store(spark, _folder(spark))
    for label, again in (("one", False), ("two", True)):
        ingest.import_client(store, _client(spark, d, again), label)
    store.remove_version(1)
    store.gc()
    return store.files("two").select("path", "size", F.decode("content", "utf-8").alias("text"))


@query(f"""WITH {_FILES}, lost AS (SELECT DISTINCT text FROM one WHERE text NOT IN (SELECT text FROM two)) SELECT count(*) AS objects, coalesce(sum(strlen(text)), 0)::BIGINT AS bytes, (SELECT count(*) FROM (SELECT DISTINCT strlen(text) FROM one EXCEPT SELECT strlen(text) FROM two)) AS blobs FROM lost""")
def file_gc_report(spark, d):
    store = Store(spark, _folder(spark))
    for label, again in (("one", False), ("two", True)):
        ingest.import_client(store, _client(spark, d, again), label)
    store.remove_version(1)
    return spark.createDataFrame([tuple(store.gc().values())], "objects bigint, bytes bigint, blobs bigint")


@query("""SELECT label AS path, 100 + version_id AS size, version_id AS mtime, CASE WHEN channel = 'live' THEN 'a,b' ELSE '__DIR__' END AS objects, channel <> 'live' AS is_dir, 'p' AS product FROM client_versions""")
def manifest_files(spark, d):
    """A manifest whose files are the versions' labels, found by its pointer file."""
    root = _folder(spark)
    listed = {}
    for r in table(spark, d, "client_versions").collect():
        name = base64.b64encode(b"\xff\xfe" + r.label.encode("utf-16-le")).decode()
        listed[name] = {"fsize": 100 + r.version_id, "mtime": r.version_id, "objects": ["a", "b"] if r.channel == "live" else ["__DIR__"]}
    _put(spark, f"{root}/cafe", zlib.compress(json.dumps({"buildtime": 1.5, "product": "p", "version": "1", "files": listed}).encode()))
    _put(spark, f"{root}/x.manifest.hash", b"cafe\n")
    found = files.current_manifest(spark, root)
    return found.select("product", F.explode("files").alias("f")).select("f.*", "product").withColumn("objects", F.array_join("objects", ","))


# The tree. The client's own format needs a parser that is not public: its nodes are told from nested_records, an image each.


def _tree(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nested_records").select(F.format_string("String/%s/%d.img", F.replace("kind", F.lit("/"), F.lit("-")), "record_id").alias("path"), "data")
    return nodes.from_records(rows)


_NODES = r"""RECURSIVE w(rid, path, parent, name, v) AS (SELECT record_id, 'String/' || replace(kind, '/', '-') || '/' || record_id || '.img', 'String/' || replace(kind, '/', '-'), record_id || '.img', data::JSON FROM nested_records WHERE json_valid(data) AND json_type(data) = 'OBJECT'
UNION ALL SELECT rid, w.path || '/' || j.key, w.path, j.key, j.value FROM w, json_each(w.v) j WHERE json_type(w.v) = 'OBJECT'),
node AS (SELECT path, parent, name, CASE WHEN name LIKE '%.img' AND parent NOT LIKE '%.img%' THEN 'img' ELSE CASE json_type(v) WHEN 'OBJECT' THEN 'prop' WHEN 'ARRAY' THEN 'vector' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'int' WHEN 'NULL' THEN 'null' ELSE 'int' END END AS type, v FROM w)"""


@query(f"WITH {_NODES} SELECT path FROM node WHERE type = 'img'")
def tree_images(spark, d):
    return nodes.images(_tree(spark, d)).select("path")


@query(f"""WITH {_NODES}, t AS (SELECT parent AS path, min_by(json_extract_string(v, '$'), CASE name WHEN 'name' THEN 1 WHEN 'mapName' THEN 2 WHEN 'streetName' THEN 3 ELSE 4 END) AS title FROM node WHERE type = 'string' AND name IN ('name', 'mapName', 'streetName', 'bookName') GROUP BY parent)
SELECT n.parent, n.name, n.type, CASE WHEN n.type IN ('prop', 'img') THEN title WHEN n.type = 'vector' THEN NULL ELSE left(v::VARCHAR, CASE WHEN length(v::VARCHAR) > 100 THEN 99 ELSE 100 END) || CASE WHEN length(v::VARCHAR) > 100 THEN '…' ELSE '' END END AS shown
FROM node n LEFT JOIN t USING (path) WHERE n.parent LIKE '%.img' AND n.type <> 'vector'""")
def tree_listing(spark, d):
    """What listing each image shows."""
    tree = _tree(spark, d)
    return nodes.listing(tree).where("parent like '%.img' and type <> 'vector'").select("parent", "name", "type", "shown")


@query(f"WITH {_NODES} SELECT path, type FROM node WHERE path LIKE 'String/skill/%' AND len(string_split(path, '/')) <= 4")
def tree_below(spark, d):
    """What lies below a folder, to a depth of two."""
    return nodes.subtree(_tree(spark, d), "String/skill", 2).where("path <> 'String/skill'").select("path", "type")


@query(f"""WITH {_NODES} SELECT 'img' AS kind, path AS key FROM node WHERE type = 'img'""")
def extract_images(spark, d):
    return extract.images(_tree(spark, d)).select("kind", "key")


_ENTRY = r"""e AS (SELECT DISTINCT n.path FROM node n JOIN node c ON c.parent = n.path AND c.type NOT IN ('prop', 'img') WHERE n.type <> 'img' AND regexp_full_match(n.name, '[0-9]+'))"""


@query(f"WITH {_NODES}, {_ENTRY} SELECT path FROM e")
def tree_entries(spark, d):
    """The entries of all images: nodes of a numeric name with a value among their children."""
    return extract.entries(_tree(spark, d)).select("path")


@query(f"""WITH {_NODES}, {_ENTRY} SELECT 'string/' || regexp_extract(e.path, '^String/(.*?)[.]img/', 1) AS kind, regexp_replace(e.path, '^.*?[.]img/', '') AS key,
 coalesce((SELECT string_agg(c.name, ',' ORDER BY c.name) FROM node c WHERE c.parent = e.path AND c.path NOT IN (SELECT path FROM e)), '') AS members FROM e""")
def extract_strings(spark, d):
    """The entries as records, by the names of what their payload holds: no entry that is a child of theirs."""
    found = extract.strings(_tree(spark, d))
    return found.select("kind", "key", F.array_join(F.array_sort(F.json_object_keys("data")), ",").alias("members"))


def _skill_tree(spark: SparkSession, d: str) -> DataFrame:
    """The skills with a job as a client's tree: an image per job, and one for the texts."""
    from palimpsest.plans.problems import number

    rows = table(spark, d, "skills").select(number(F.col("id")).alias("id"), "job", "name", "descr").where("id is not null")
    one = rows.groupBy("id").agg(F.max("job").alias("job"), F.max("name").alias("name"), F.max("descr").alias("descr")).where("job is not null")
    level = table(spark, d, "skill_levels").select(number(F.col("skill_id")).alias("id"), "skill_level").distinct().join(one.select("id", "job"), "id").where("skill_level is not null")
    image = F.format_string("Skill/%03d.img", "job")
    at = F.concat(image, F.lit("/skill/"), F.col("id").cast("string"))
    text = F.concat(F.lit("String/Skill.img/"), F.col("id").cast("string"))
    none = F.lit(None).cast("string")

    def put(df: DataFrame, path, kind: str, value=none) -> DataFrame:  # noqa: ANN001
        return df.select(path.alias("path"), F.lit(kind).alias("type"), value.alias("value")).where("path is not null").distinct()

    step = F.concat(at, F.lit("/level/"), F.col("skill_level").cast("string"))
    said = lambda c: F.when(F.col(c).isNotNull(), F.concat(text, F.lit("/name" if c == "name" else "/desc")))
    json_ = lambda c: F.regexp_extract(F.to_json(F.struct(c)), r"(?s)^\{[^:]*:(.*)\}$", 1)
    parts = [put(one, image, "img"), put(one, F.concat(image, F.lit("/skill")), "prop"), put(one, at, "prop"), put(level, F.concat(at, F.lit("/level")), "prop"), put(level, step, "prop")]
    parts += [put(level, F.concat(step, F.lit("/lv")), "int", F.col("skill_level").cast("string")), put(one, F.lit("String/Skill.img"), "img"), put(one, text, "prop")]
    parts += [put(one, said(c), "string", json_(c)) for c in ("name", "descr")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    parent = F.regexp_replace("path", "/[^/]*$", "")
    name = F.regexp_extract("path", "[^/]*$", 0)
    depth = F.size(F.split("path", "/"))
    return every.select(F.lit(1).cast("bigint").alias("version_id"), "path", parent.alias("parent"), name.alias("name"), depth.alias("depth"), "type", "value")


@query("""WITH s AS (SELECT try_cast(trim(id) AS BIGINT) AS id, max(job) AS job, max(name) AS name, max(descr) AS descr FROM skills GROUP BY ALL HAVING max(job) IS NOT NULL),
l AS (SELECT try_cast(trim(skill_id) AS BIGINT) AS id, count(DISTINCT skill_level) AS n FROM skill_levels GROUP BY ALL)
SELECT id::VARCHAR AS key, job::BIGINT AS job, name, descr, coalesce(n, 0) AS max_level FROM s LEFT JOIN l USING (id) WHERE id IS NOT NULL""")
def extract_skills(spark, d):
    """The skills' trees and texts as records."""
    from palimpsest.operators.catalog import skill_fields

    found = extract.skills(_skill_tree(spark, d)).select("key", skill_fields("data").alias("s"))
    return found.select("key", "s.job", "s.name", F.col("s.desc").alias("descr"), "s.max_level")
