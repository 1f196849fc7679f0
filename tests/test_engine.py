"""Expectations of the versioned-record engine: versions, diffs, timelines, facets, search, text, store, files, tree, command line."""

import base64
import json
import zlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.functions import canon, jobs, text, textdiff
from palimpsest.operators import diff, extract, facets, search, timeline, versions
from palimpsest.sources import files, nodes
from palimpsest.sources.store import Store
from palimpsest.sources.tables import releases

V = "version_id bigint, label string, channel string, imported_at string, source_path string, manifest_hash string, build_time string, note string"
TREE = """{"String": {"Eqp.img": {"Eqp": {"Weapon": {"1302000": {"name": "Sword", "desc": "A blade.", "7": {"v": 1}}, "note": {"x": {"y": 1}}}}},
 "Skill.img": {"1001003": {"name": "Iron Body", "desc": "Hard.", "h1": "Def 2", "h2": "Def 4"}, "1000000": {"name": "Recovery"}}},
 "Skill": {"100.img": {"skill": {"1001003": {"level": {"1": {"pdd": 2, "hs": "h1", "lt": [1, 2]}, "2": {"pdd": 4, "ball": {"z": 1}}}, "req": {"1000000": 5}, "icon": {"w": 1}},
 "1000000": {"common": {"maxLevel": "16"}, "invisible": 1, "elemAttr": "f"}}}, "Attacktype.img": {"a": 1}}}"""
R = "version_id bigint, kind string, key string, hash string, blob_hash string"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def records(spark, data):
    return spark.createDataFrame([(v, k, key, h, h) for v, k, key, h in data], R)


def col(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(expr(F.col("c"))).collect()]


def test_release_order_and_selectors(spark):
    data = [(1, "plum", "t", "2030-03-04T00:00:00+00:00", "/", None, "2030-03-01T08:00:00+02:00", None), (2, "fig", "t", "2030-03-09T00:00:00Z", "/", None, "2029-12-31T23:59:59Z", None), (3, "kiwi", "t", "2030-01-15T00:00:00Z", "/", None, None, None)]
    df = spark.createDataFrame(data, V)
    assert [r.version_id for r in versions.ordered(df).orderBy("place").collect()] == [2, 3, 1]
    assert (versions.resolve(df, "latest"), versions.resolve(df, "previous"), versions.resolve(df, "#3"), versions.resolve(df, "fig"), versions.resolve(df, "baseline", "kiwi")) == (1, 3, 3, 2, 3)
    assert (versions.previous(df, 1), versions.previous(df, 2)) == (3, None)
    assert (versions.diff_base(df, 1, "fig"), versions.diff_base(df, 2, "plum"), versions.diff_base(df, 3, "plum"), versions.diff_base(df, 2, "fig")) == (2, None, 2, None)
    assert rows(versions.diff_bases(df, "fig")) == [(1, 2), (2, None), (3, 2)] and rows(versions.diff_bases(df)) == [(1, 3), (2, None), (3, 2)]
    for bad in ("nope", "#9", "#x", "baseline"):
        with pytest.raises(KeyError):
            versions.resolve(df, bad)


def test_labels():
    for good in ("r12-beta", "7.0_x", "-", "A"):
        assert versions.validate_label(good) == good
    for bad in ("", "up/down", "two words", "previous", ".dot", "#12", "tab\t", "ü"):
        with pytest.raises(ValueError):
            versions.validate_label(bad)


def test_diff(spark):
    r = records(spark, [(1, "s/Eqp", "1", "Old"), (1, "s/Eqp", "2", "Gone"), (1, "s/Eqp", "3", "Same"), (2, "s/Eqp", "1", "New"), (2, "s/Eqp", "3", "Same"), (2, "s/Eqp", "4", "Added"), (1, "s/Eqp", "5", None), (2, "s/Eqp", "5", None), (2, "string/Eqp", "1", "a"), (2, "stringy", "1", "a")])
    got = [("s/Eqp", "1", "modified"), ("s/Eqp", "2", "removed"), ("s/Eqp", "4", "added"), ("string/Eqp", "1", "added"), ("stringy", "1", "added")]
    assert rows(diff.diff(r, 1, 2).select("kind", "key", "status")) == got == rows(diff.diff_in_halves(r, 1, 2))
    assert rows(diff.diff(r, 1, 2, "String").select("kind")) == [("string/Eqp",)]
    assert rows(diff.summary(diff.diff(r, 1, 2, "s"))) == [("s/Eqp", 1, 1, 1)]
    top = diff.top_per(diff.diff(r, 1, 2), "kind", 1)
    assert rows(top.where("kind = 's/Eqp'").select("key", "total")) == [("1", 3)] and diff.top_per(diff.diff(r, 1, 2), "kind", 0).count() == 5
    assert diff.diff(r, 7, 8).count() == 0


def test_fields_and_text_only(spark):
    f = canon.field_changes
    assert [c["path"] for c in f('{"title":"Oar","note":"wet","size":{"cm":90,"kg":2}}', '{"title":"Oar","size":{"cm":95,"kg":2},"wood":"ash"}')] == ["note", "size/cm", "wood"]
    assert f('{"n":1}', '{"n":"1"}') == [{"path": "n", "old": "1", "new": '"1"'}] and f('{"n":1}', '{"n":1.0}') and f("1", "2")[0]["path"] == ""
    assert f('{"a":null}', "{}") == [{"path": "a", "old": "null", "new": None}] and f(None, "{}") == [] == f("{", "{}")
    assert f('{"a":{"b":1}}', '{"a":[1]}') == [{"path": "a", "old": '{"b":1}', "new": "[1]"}]
    pairs = [('{"desc":"a","n":1}', '{"desc":"b","n":1}'), ('{"desc":"a","n":1}', '{"desc":"b","n":2}'), ('{"n":1}', '{"n":"1"}'), ("{}", '{"d":"x"}'), ("{}", "{}")]
    df = spark.createDataFrame([(i, "modified", *p) for i, p in enumerate(pairs)], "i int, status string, old string, new string").withColumn("fields", canon.json_fields("old", "new"))
    assert rows(df.select("i", diff.is_text_only())) == [(0, True), (1, False), (2, False), (3, True), (4, False)]


def test_grouped_fields_and_ranges(spark):
    data = [("k", "a", f"levels/{i}/dmg", str(i), "0") for i in (2, 3, 4, 6, 9, 10)] + [("k", "a", "name", '"x"', '"y"')]
    g = diff.grouped_fields(spark.createDataFrame(data, "kind string, key string, path string, old string, new string"))
    got = {r.field: r for r in g.withColumn("text", text.ranges(F.col("levels"))).collect()}
    assert (got["dmg"].text, got["dmg"].n, got["dmg"].path, got["dmg"].old) == ("2–4, 6, 9–10", 6, "levels/2/dmg", "2") and got["name"].levels == []
    assert col(spark, [[4], [], [2, 1, 1]], text.ranges, "array<int>") == ["4", "", "1–2"]


def test_timeline(spark):
    rel = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (4, 4)], "version_id bigint, ord int")
    r = records(spark, [(2, "k", "a", "x"), (1, "k", "a", "y"), (4, "k", "a", "y"), (3, "k", "b", "z"), (4, "k", "b", "z"), (1, "other", "c", "q")])
    got = rows(timeline.events(r, rel).select("kind", "key", "version_id", "status"))
    assert got == [("k", "a", 1, "modified"), ("k", "a", 2, "added"), ("k", "a", 3, "removed"), ("k", "a", 4, "added"), ("k", "b", 3, "added"), ("other", "c", 1, "added")]
    assert timeline.events(r.where("false"), rel).count() == 0


def test_key_suffix_and_search(spark):
    r = records(spark, [(1, "s", "Eqp/Weapon/1302000", "a"), (1, "s", "Eqp/Weapon/11302000", "b"), (1, "s", "50%_x", None)])
    blobs = spark.createDataFrame([("a", '{"name":"ÉCLAT Sword"}'), ("b", '{"name":"Bow"}')], "hash string, data string")
    assert rows(search.with_key(r, "1302000").select("key")) == [("Eqp/Weapon/1302000",)]
    find = lambda t, **k: [x.key for x in search.search(r, blobs, 1, t, **k).collect()]
    assert find("sWORD") == ["Eqp/Weapon/1302000"] and find("0%_") == ["50%_x"] and find("éclat") == [] and find("ÉcLAT") and find('"NAME":')
    assert find("e", most=0) == [] and find("", most=2) == ["50%_x", "Eqp/Weapon/11302000"] and find("x", kind="t") == []
    names = spark.createDataFrame([("10",), ("2",), ("b",), ("1a",), ("+3",)], "key string")
    assert [x.key for x in search.page(names, 0).collect()] == ["2", "+3", "10", "1a", "b"] and [x.key for x in search.page(names, 1, size=2).collect()] == ["10", "1a"]
    assert rows(search.pages(names, 2)) == [(5, 3)]


def test_facets(spark):
    data = [("skill", "1101006", 110), ("string/Skill", "0001000", None), ("img", "Skill/111.img", None), ("file", "Data/Mob/Mob_000.wz", None), ("string/Eqp", "x", None), ("skill", "abc", None), ("skill", "+20", None)]
    f = facets.with_facets(spark.createDataFrame(data, "kind string, key string, j bigint"), F.col("j"))
    assert [(r.category, r.job, r.detail) for r in f.orderBy("kind", "key").collect()] == [("monsters", None, "raw"), ("skills", 111, "raw"), ("skills", 0, "data"), ("skills", 110, "data"), ("skills", None, "data"), ("equipment", None, "data"), ("skills", 0, "data")]
    chosen = facets.FacetFilter().add_advancement("2nd").add_job("warrior")
    s = facets.with_facets(spark.createDataFrame([("skill", k) for k in ("1101006", "1001003", "2101001")] + [("string/Eqp", "x")], "kind string, key string"))
    assert rows(s.where(chosen.condition()).select("key")) == [("1101006",)]
    assert s.where(facets.FacetFilter().add_job("warrior").add_job("210").condition()).count() == 0
    counts = {(r.dimension, r.value): r.n for r in facets.drill_sideways(s, chosen).collect()}
    assert counts["branch", "magician"] == 1 and counts["advancement", "1"] == 1 and counts["category", "skills"] == 1
    assert rows(facets.category_counts(s)) == [("equipment", 1), ("skills", 3)] and facets.FacetFilter().is_empty()
    for call in ("add_category", "add_job", "add_advancement"):
        with pytest.raises(ValueError):
            getattr(facets.FacetFilter(), call)("nonsense")


def test_jobs(spark):
    assert col(spark, [111, 230, 0, 100], jobs.path, "bigint") == [[0, 100, 110, 111], [0, 200, 230], [0], [0, 100]]
    assert col(spark, [0, 100, 110, 112], jobs.parent, "bigint") == [None, 0, 100, 111]
    assert [jobs.parse_advancement(x) for x in ("2nd", " Third ", "0", "5th")] == [2, 3, 0, None]
    assert (jobs.find("crusader"), jobs.find("+7"), jobs.find("nobody"), jobs.find(str(1 << 32))) == (111, 7, None, None)
    assert rows(jobs.leaves(spark.createDataFrame([(x,) for x in (0, 100, 110, 111, 120)], "job bigint"))) == [(111,), (120,)]


def test_word_diffs(spark):
    pairs = [
        ("Four herons wade along the quiet northern shore.", "Four herons wade along the shore.", "Four herons wade along the [-quiet northern -]shore."),
        ("Gate opens at 25%!", "Gate opens at 40%!", "Gate opens at [-25%-]{+40%+}!"), ("bread-salt", "bread", "bread[--salt-]"), ("as it was", "as it was", "as it was"), ("", "moss", "{+moss+}"), ("", "", ""),
        ("Every lantern burned out", "Rivers freeze during winter", None), ("a " * 1200 + "x", "b " * 1200 + "y", None), (None, "x", None),
    ]
    df = spark.createDataFrame(pairs, "old string, new string, want string").withColumn("d", textdiff.word_diff("old", "new"))
    got = df.select("*", textdiff.inline(F.col("d")).alias("line"), textdiff.similarity(F.col("d")).alias("s")).collect()
    assert all(r.want is None or r.line == r.want for r in got)
    assert got[0].s == 33 / 48 and got[3].s == 1.0 == got[5].s and got[6].s < 0.3
    for r in got[:-1]:
        assert "".join(x.text for x in r.d if x.op != "added") == r.old and "".join(x.text for x in r.d if x.op != "removed") == r.new


def test_text_helpers(spark):
    assert col(spark, ["Walk #bslowly# &\\n#rrun#k >", None], lambda c: text.game_html(c)) == ["Walk <mark>slowly</mark> &amp;<br><mark>run</mark> &gt;", None]
    assert col(spark, ["[Rank 3]\\nBinds #cfoes# for a while.\\nCosts more."], text.summary) == ["Binds cfoes for a while."]
    assert col(spark, [base64.b64encode(b"\xff\xfe" + "Oars/ä.bin".encode("utf-16-le")).decode()], text.utf16_path) == ["Oars/ä.bin"]
    assert col(spark, [1.5, 1767225600.0], text.rfc3339, "double") == ["1970-01-01T00:00:01.500+00:00", "2026-01-01T00:00:00+00:00"]
    assert col(spark, [0, 1023, 1536, 3 << 40], text.human_bytes, "bigint") == ["0.0 B", "1023.0 B", "1.5 KiB", "3072.0 GiB"]
    assert col(spark, ["ab\ncd", None], lambda c: text.preview(c, 4)) == ["ab\\…", "∅"] and col(spark, ["a`b"], text.markdown_value) == ["`a'b`"]
    assert col(spark, ['"x"', "[1, 2]", "[1]", "7"], text.value_text) == ["x", "(1, 2)", "[1]", "7"]
    assert col(spark, ["5", "+5", " 5", "99999999999", ""], text.u32) == [5, 5, None, None, None]
    assert col(spark, [float("nan"), float("inf"), 1.0], canon.finite, "double") == [None, None, 1.0]
    h = col(spark, ['{"a":1,"b":2}', '{"b":2, "a":1}', "{"], lambda c: canon.content_hash(canon.canonical_json(c)))
    assert h[0] == h[1] and h[2] is None


def test_paths_below_a_root(spark):
    for root in ("/a/b", "file:/a/b/", "file:///a/b", "hdfs://host:8020/a/b", "\\a\\b"):
        assert col(spark, ["file:/a/b/c/d", "hdfs://host:8020/a/b/c/d", "/a/b/c/d", "\\a\\b\\c\\d", "/a/bc/d"], lambda c: text.relative_path(c, root)) == ["c/d"] * 4 + ["/a/bc/d"]  # noqa: B023


def test_store(spark, store):
    a, b = store.insert_version("a"), store.insert_version("b")
    with pytest.raises(ValueError):
        store.insert_version("a")
    make = lambda data: spark.createDataFrame(data, "kind string, key string, data string")
    for _ in range(2):
        assert store.replace_records(a, "strings", make([("k", "1", '{"b":1,"a":2}'), ("k", "2", '{"a":2,"b":1}')])) == 2
    assert store.table("records").count() == 2 and store.table("blobs").count() == 1
    for bad in ([("k", "1", "{}"), ("k", "1", "{}")], [("k", "2", "{}")]):
        with pytest.raises(ValueError):
            store.replace_records(a, "other" if len(bad) == 1 else "strings", make(bad))
    store.replace_records(b, "strings", make([("k", "1", '{"a":3}')]))
    assert [r.record_count for r in store.table("extractions").orderBy("version_id").collect()] == [2, 1] and store.meta("baseline") == "a"
    assert store.replace_records(b, "strings", make([])) == 0 and store.table("records").where(F.col("version_id") == b).count() == 0
    assert store.gc() == {"objects": 0, "bytes": 0, "blobs": 1} and store.table("blobs").count() == 1
    store.remove_version(a)
    assert store.table("records").count() == 0 and store.meta("baseline") is None and [r.label for r in store.table("versions").collect()] == ["b"]
    store.set_meta("layout", "99")
    with pytest.raises(ValueError):
        Store(spark, store.root)


def test_files_and_manifest(spark, store, tmp_path, capsys):
    client = tmp_path / "client"
    tree = {"Data/Base/Base.wz": "base", "Data/String/String_000.wz": "strings", "MapleStory.exe": "exe", "Canvas.dll": "not copied"}
    for p, t in tree.items():
        (client / p).parent.mkdir(parents=True, exist_ok=True)
        (client / p).write_text(t)
    run = lambda *a: (cli.main(["--store", store.root, *a], spark), capsys.readouterr().out)
    code, out = run("import", str(client), "--label", "one")
    assert code == 0 and {k: v for k, v in json.loads(out).items() if k != "version_id"} == {"files": 3, "bytes": 14, "new_bytes": 14, "became_baseline": True}
    (client / "Data/String/String_000.wz").write_text("strings v2")
    patch = tmp_path / "patch"
    patch.mkdir()
    m = {"buildtime": 2000000000.5, "product": "p", "version": "1", "files": {"//5DAGEAbgB2AGEAcwAuAGQAbABsAA==": {"fsize": 3, "mtime": 1, "objects": ["x"]}, "//5EAGEAdABhAA==": {"fsize": 0, "mtime": 1, "objects": ["__DIR__"]}}}
    (patch / "cafe").write_bytes(zlib.compress(json.dumps(m).encode()))
    (patch / "p.manifest.hash").write_text("cafe\n")
    got = files.current_manifest(spark, str(patch)).head()
    assert got.hash == "cafe" and [(f.path, f.is_dir) for f in got.files] == [("Canvas.dll", False), ("Data", True)]
    assert files.decode_path(base64.b64encode("é".encode("utf-16-le") + b"x").decode()) == "é"
    assert run("import", str(client), "--label", "two", "--patchdata", str(patch))[0] == 0
    assert run("import", str(client), "--label", "two")[0] == 1 and run("import", store.root.replace("file://", ""), "--label", "three")[0] == 1
    assert [r.build_time for r in store.table("versions").where("label = 'two'").collect()] == ["2033-05-18T03:33:20.500+00:00"]
    code, out = run("diff", "--from", "one", "--to", "two", "--kind", "file")
    assert code == 0 and "~ Data/String/String_000.wz" in out and "size: 7 -> 10" in out
    assert "**changed** `Data/String/String_000.wz`" in run("diff", "--from", "one", "--to", "two", "--format", "markdown")[1]
    assert len(run("diff", "--from", "one", "--to", "two", "--format", "json")[1].splitlines()) == 3  # with two files of the patch folder
    assert run("diff", "--from", "two", "--to", "two")[0] == 1 and "no changes" in run("diff", "--from", "one", "--to", "two", "--kind", "skill")[1]
    assert "size: 7 -> 10" in run("history", "String_000.wz")[1] and "Data/Base/Base.wz" in run("search", "base")[1]
    assert "baseline" in run("versions")[1] and "import" in run("info")[1] and run("baseline")[1] == "one\n" and "would" in run("remove", "one")[1]
    assert run("remove", "one", "--yes")[0] == 0 and run("gc")[0] == 0 and run("jobs")[1].count("\n") == 37 and run("extractors")[1] == "strings\nskills\nimages\n"


def test_tree_and_extractors(spark, store, tmp_path, capsys):
    t = spark.createDataFrame(extract.nodes_from_json(TREE), extract.NODES)
    assert [r.path for r in nodes.images(t).collect()] == ["Skill/100.img", "Skill/Attacktype.img", "String/Eqp.img", "String/Skill.img"]
    assert [r.name for r in nodes.ls(t, "String/Eqp.img/Eqp/Weapon/1302000").collect()] == ["7", "desc", "name"]
    with pytest.raises(KeyError, match="'Nope'"):
        nodes.get(t, "String/Nope/x")
    got = {r.key: r for r in extract.strings(t).collect()}
    assert json.loads(got["Eqp/Weapon/1302000"].data) == {"name": "Sword", "desc": "A blade."} and "Eqp/Weapon/1302000/7" in got and "1001003" in got
    s = {r.key: json.loads(r.data) for r in extract.skills(t).collect()}
    assert s["1001003"] == {"job": 100, "name": "Iron Body", "desc": "Hard.", "max_level": 2, "req": {"1000000": 5}, "icon": True, "levels": {"1": {"pdd": 2, "lt": [1, 2], "text": "Def 2"}, "2": {"pdd": 4, "text": "Def 4"}}}
    assert s["1000000"]["max_level"] == 16 and s["1000000"]["invisible"] and s["1000000"]["element"] == "f"
    assert extract.images(t).count() == 4
    with pytest.raises(ValueError):
        extract.chosen(["nope"])
    store.insert_version("v1")
    t.write.parquet(f"{tmp_path}/nodes")
    run = lambda *a: (cli.main(["--store", store.root, *a], spark), capsys.readouterr().out)
    assert run("extract", "v1", "--nodes", f"{tmp_path}/nodes")[1].count("extracted") == 3
    assert "Iron Body" in run("skills", "--job", "warrior")[1] and "Iron Body" not in run("skills", "--job", "thief")[1] and '"max_level": 16' in run("skill", "1000000", "--json")[1]
    assert run("ls", "--nodes", f"{tmp_path}/nodes", "v1", "String")[1].split()[0] == "Eqp.img"
    assert json.loads(run("show", "--nodes", f"{tmp_path}/nodes", "v1", "Skill/100.img", "--depth", "1")[1]) == {"skill": {"_children": 2}}


def test_streamed_rows_are_read_as_snapshots(spark, tmp_path):
    from palimpsest.sources.store import latest_records
    from palimpsest.streaming.ingest import follow

    schema = "version_id bigint, source string, kind string, key string, hash string, blob_hash string, loaded_at timestamp"
    one = spark.sql("select 1L version_id, 's' source, 'k' kind, 'a' key, 'x' hash, null blob_hash, timestamp'2031-01-01' loaded_at")
    late = spark.sql("select 1L version_id, 's' source, 'k' kind, '/a' key, 'y' hash, null blob_hash, timestamp'2031-01-02' loaded_at")
    for batch in (one, late, one):
        batch.selectExpr("version_id", "source", "kind", "key", "hash", "cast(blob_hash as string) blob_hash", "loaded_at").write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    got = latest_records(spark.read.parquet(f"{tmp_path}/out"))
    assert rows(got.select("key", "hash")) == [("a", "y")]


def test_releases(spark):
    df = spark.createDataFrame([], V)
    assert releases(spark, df).count() == 0


def test_a_crash_leaves_the_old_or_the_new_table(spark, store, monkeypatch):
    """A generation that was not written to its end is passed over; the one before it stays until then."""
    make = lambda data: spark.createDataFrame(data, "kind string, key string, data string")
    v = store.insert_version("a")
    store.replace_records(v, "s", make([("k", "1", "{}")]))
    for name in ("meta", "versions", "extractions", "blobs", f"records/version_id={v}/source=s"):
        broken = store._path(f"{store.root}/{name}/gen=99/part-0.parquet")
        store._fs.create(broken).close()
    again = Store(spark, store.root)
    assert again.meta("baseline") == "a" and again.table("versions").count() == again.table("records").count() == again.table("blobs").count() == 1

    def fail(self, place, df):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", fail)
        with pytest.raises(RuntimeError):
            again.replace_records(v, "s", make([("k", "2", '{"a":1}')]))
    assert [r.key for r in again.table("records").collect()] == ["1"]
    assert again.replace_records(v, "s", make([("k", "2", '{"a":1}')])) == 1 and [r.key for r in again.table("records").collect()] == ["2"]
    assert again.gc()["blobs"] == 1 and again.table("blobs").count() == 1


def test_a_store_of_the_first_layout_is_brought_up(spark, tmp_path):
    root = f"file://{tmp_path}/old"
    spark.createDataFrame([("layout", "1"), ("baseline", "a")], "key string, value string").write.parquet(f"{root}/meta")
    spark.createDataFrame([(1, "a", "live", "2030", "/", None, None, None)], V).write.parquet(f"{root}/versions")
    spark.createDataFrame([("k", "1", "h", "h")], "kind string, key string, hash string, blob_hash string").write.parquet(f"{root}/records/version_id=1/source=s")
    store = Store(spark, root)
    assert store.meta("layout") == "2" and store.meta("baseline") == "a"
    assert rows(store.table("records").select("key", "version_id", "source")) == [("1", 1, "s")] and store.table("versions").count() == 1


def test_reports(spark, store, capsys):
    make = lambda data: spark.createDataFrame(data, "kind string, key string, data string")
    a, b = store.insert_version("a"), store.insert_version("b")
    store.replace_records(a, "s", make([("k", "1", '{"t":"one two three four"}'), ("k", "2", "{}"), ("k", "3", '{"n":1}'), ("l", "1", "{}")]))
    store.replace_records(b, "s", make([("k", "1", '{"t":"one two 3 four"}'), ("k", "3", '{"n":2}'), ("k", "4", '{"x":"`"}'), ("l", "1", "{}")]))
    run = lambda *x: (cli.main(["--store", store.root, *x], spark), capsys.readouterr().out)[1].splitlines()
    assert run("diff", "--from", "a", "--to", "b", "--limit", "3") == [
        "a -> b", "", f"{'kind':<28} {'added':>7} {'removed':>7} {'modified':>8}", f"{'k':<28} {1:>7} {1:>7} {2:>8}", "", "== k ==",
        "~ 1", "    t: one two [-three-]{+3+} four", "- 2  {}", "~ 3", "    n: 1 -> 2", "  … 1 more (use --limit 0 for all)",
    ]
    markdown = run("diff", "--from", "a", "--to", "b", "--format", "markdown")
    assert markdown[0] == "# Changes: a → b" and "- **added** `4` `{\"x\":\"'\"}`" in markdown and "  - `n`: `1` → `2`" in markdown
    assert run("search", "", "--limit", "2")[-1] == "(showing first 2; use --limit for more)" and len(run("search", "", "--limit", "9")) == 4
    assert run("history", "3") == ["k 3", f"  {'a':<24} {'added':<8} {{\"n\":1}}", f"  {'b':<24} {'changed':<8}", "      n: 1 -> 2"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from palimpsest.session import shared_dir

    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context))


def test_plans_scan_once(spark, data):
    """History reads the records for the coverage and the events, and a search looks at each payload before it joins."""
    from palimpsest.plans import reference

    plan = lambda name: reference.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("history_events").count("records.parquet") <= 1 and plan("kind_counts").count("Join") == 0
    found = plan("search_records")
    assert "Filter" in found.split("Join")[-1] and "Contains" in found or "LIKE" in found
