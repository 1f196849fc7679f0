import json

from conftest import rows

from palimpsest.operators import drift

SCHEMA = "file_name string, feed string, version_id bigint, line_no int, payload string, path string"


def rel(spark):
    return spark.createDataFrame([(1, 1), (3, 2), (2, 3), (4, 4)], "version_id bigint, ord int")


def make(spark, files):
    data = [("f", feed, v, i, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for (feed, v), lines in files.items() for i, p in enumerate(lines)]
    return spark.createDataFrame(data, SCHEMA)


def run(spark, files):
    return rows(drift.field_changes(make(spark, files), rel(spark)))


def test_each_change(spark):
    files = {
        ("a", 1): [{"id": 1, "x": {"n": 5}, "s": "q", "t": 1, "u": None, "e": {}}, {"id": 2, "x": {"n": 6}, "s": "r", "t": 2}, None, "", "{broken", "[1]", "7"],
        ("a", 3): [{"id": 1, "y": 5, "s": "q", "t": 1.5, "u": 3}, {"id": 2, "y": None, "s": "r", "t": 2.0}, {"id": 9, "y": 1, "s": "z"}],
        ("a", 2): [{"id": 1, "y": 5, "t": True, "u": "3", "new": [1]}],
        ("a", 9): [{"id": 1}],
        (None, 1): [{"id": 1, "q": 1}],
    }
    assert run(spark, files) == sorted([
        ("a", 3, "renamed", "x/n", "y"), ("a", 3, "retyped", "t", ""), ("a", 2, "removed", "s", ""), ("a", 2, "added", "new", ""), ("a", 2, "retyped", "t", ""), ("a", 2, "retyped", "u", ""),
    ], key=repr)


def test_rename_needs_equal_values(spark):
    a = {("f", 1): [{"id": 1, "p": 1}, {"id": 2, "p": 2}], ("f", 3): [{"id": 1, "q": 1}, {"id": 2, "q": 3}]}
    assert run(spark, a) == [("f", 3, "added", "q", ""), ("f", 3, "removed", "p", "")]
    b = {("f", 1): [{"id": 1, "p": 1}], ("f", 3): [{"id": 2, "q": 1}]}  # no id in both
    assert run(spark, b) == [("f", 3, "added", "q", ""), ("f", 3, "removed", "p", "")]
    c = {("f", 1): [{"id": i, "p": i, "b": True} for i in range(5)], ("f", 3): [{"id": i, "q": i, "c": True} for i in range(5)]}
    assert run(spark, c) == [("f", 3, "renamed", "b", "c"), ("f", 3, "renamed", "p", "q")]


def test_paths_come_back_and_repeated_lines(spark):
    files = {("f", 1): [{"id": 1, "a": 1}] * 30, ("f", 3): [{"id": 1}], ("f", 2): [{"id": 1, "a": 1}] * 2}
    assert run(spark, files) == [("f", 2, "added", "a", ""), ("f", 3, "removed", "a", "")]
    assert run(spark, {}) == []


def test_consistent_table(spark):
    files = {("f", 1): [{"id": 1, "p": 1, "s": "x"}, {"id": 2, "p": 2, "s": None}], ("f", 3): [{"id": 1, "q": 1}, {"id": 2, "q": 2}], ("f", 2): [{"id": 1, "q": 1.5}]}
    table = drift.consistent(make(spark, files), rel(spark)).cache()
    got = {(r.version_id, r.id, r.name): (r.type, r.value) for r in table.collect()}
    assert got[1, "1", "q"] == ("float", "1.0") and got[2, "1", "q"] == ("float", "1.5") and got[1, "1", "s"] == ("string", "x")
    assert got[1, "2", "s"] == ("string", None) and not any(k[2] == "p" for k in got)
    wide = drift.typed(table, "f")
    assert dict(wide.dtypes)["q"] == "double" and wide.where("version_id = 1 and id = 1").head().q == 1.0


def test_names_that_are_used_again(spark):
    """A path that comes again, and a rename into a name in use before, are fields of their own."""
    files = {
        ("f", 1): [{"id": 1, "a": 1, "x": "q"}], ("f", 3): [{"id": 1, "b": 1, "x": "q"}], ("f", 2): [{"id": 1, "b": 1, "a": "new0", "x": "q"}], ("f", 4): [{"id": 1, "a": "new0", "b": 1}],
        ("g", 1): [{"id": 1, "p": 1, "x": 5}], ("g", 3): [{"id": 1, "q": 1, "x": 5}], ("g", 2): [{"id": 1, "x": 5}], ("g", 4): [{"id": 1, "q": 5}],
    }
    table = drift.consistent(make(spark, files), rel(spark)).where("name <> 'id'")
    got = sorted((r.feed, r.version_id, r.name, r.type, r.value) for r in table.collect())
    assert got == sorted([
        ("f", 1, "b", "int", "1"), ("f", 3, "b", "int", "1"), ("f", 2, "b", "int", "1"), ("f", 2, "a", "string", "new0"), ("f", 4, "a", "string", "new0"),
        ("f", 1, "x", "string", "q"), ("f", 3, "x", "string", "q"), ("f", 2, "x", "string", "q"), ("f", 4, "b", "int", "1"),
        ("g", 1, "q@3", "int", "1"), ("g", 3, "q@3", "int", "1"), ("g", 1, "q", "int", "5"), ("g", 3, "q", "int", "5"), ("g", 2, "q", "int", "5"), ("g", 4, "q", "int", "5"),
    ])


def test_every_value_is_there_once(spark):
    files = {("f", v): [{"id": i, "a": {"b": i * v, "c": None}, "l": [1, {"z": i}]} | ({"new": i} if v > 1 else {"old": i}) for i in range(20)] for v in (1, 3, 2, 4)}
    table = drift.consistent(make(spark, files), rel(spark))
    assert table.count() == sum(5 for lines in files.values() for _ in lines) == table.select("feed", "version_id", "line_no", "name").distinct().count()
    assert {r.name for r in table.select("name").distinct().collect()} == {"id", "a/b", "a/c", "l", "new"}
