import json

from conftest import rows

from palimpsest.functions.jsontext import canonical, digest, read
from palimpsest.operators import nested

SCHEMA = "kind string, key string, data string, other int"


def run(spark, data):
    nodes = nested.shred(spark.createDataFrame([(*r, 1) for r in data], SCHEMA), ["kind", "key"])
    return nodes, rows(nested.objects(nodes, ["kind", "key"]))


def test_objects_and_links(spark):
    value = {"a": {"b": [{"c": 1}, [{"d": {}}], 5]}, "t": json.dumps({"u": [{"v": 1}]}), "w": json.dumps(json.dumps([{"x": 1}])), "n": None, "z": "[broken", "y": "{}"}
    _, got = run(spark, [("k", "1", json.dumps(value)), ("k", "1", json.dumps(value)), ("k", "2", "{bad"), ("k", "3", None), ("k", "4", ""), ("k", "5", "[{}]"), (None, None, '{"a":{}}')])
    assert got == sorted([
        ("k", "1", "a", ""), ("k", "1", "a/b/0", "a"), ("k", "1", "a/b/1/0", "a"), ("k", "1", "a/b/1/0/d", "a/b/1/0"), ("k", "1", "t", ""), ("k", "1", "t/u/0", "t"),
        ("k", "1", "w/0", ""), ("k", "1", "y", ""), ("k", "5", "0", ""), (None, None, "a", ""),
    ], key=repr)


def test_intervals_contain_descendants(spark):
    nodes, _ = run(spark, [("k", "1", '{"a":{"b":[{"c":1},2]},"d":{}}')])
    by = {r.path: r for r in nodes.collect()}
    for p in by.values():
        for q in by.values():
            inside = q.path != p.path and (p.path == "" or q.path.startswith(p.path + "/"))
            assert inside == (p.pre < q.pre and q.post < p.post)
    assert by["a/b/0"].parent_pre == by["a"].pre and by["a/b/0"].value == '{"c":1}'


def test_deep_long_and_empty(spark):
    deep = '{"a":' * 2000 + "1" + "}" * 2000
    long = json.dumps({"t": "x" * 200_000, "l": [{"i": i} for i in range(3000)]})
    _, got = run(spark, [("k", "deep", deep), ("k", "long", long)])
    assert sum(r[1] == "deep" for r in got) == 1999 and sum(r[1] == "long" for r in got) == 3000
    assert run(spark, [])[1] == []


def test_json_text():
    assert canonical(read('{"b":1,"a":[1.0,"é",null,true]}')) == '{"a":[1.0,"é",null,true],"b":1}'
    assert digest('{"a":1,"b":"\\u00e9"}') == digest('{ "b" : "é", "a":1}') != digest('{"a":1.0,"b":"é"}')
    assert digest(None) is None and digest("{x ") == digest(" {x")
    for bad in ("", "nan", "[1,]", '{"a"}', "{'a':1}", "[" * 5000, "1 2", '["\n"]'):
        for text in (bad, "[" * 3000 + bad + "]" * 3000):
            try:
                read(text)
            except ValueError:
                continue
            assert text != bad and bad == "", text
    assert read('"\\ud800"') == "\ud800" and canonical("\ud800") == '"\\ud800"'


def test_no_value_is_lost(spark):
    """The rows without members, in pre-order, put together are the document again."""
    docs = ['{"a":[1,2,[null,"x"]],"b":{"c":[],"d":{}},"e":"é","f":[{"g":[true]},"[1]"]}', "[1,[2,[3]]]", '"text"', "5", "{}", '{"t":"{\\"u\\":[7]}"}']
    df = spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "key string, data string")
    nodes = nested.shred(df, ["key"], members=False)
    for i, d in enumerate(docs):
        got = [(r.path, r.type, r.value) for r in nodes.where(f"key = '{i}'").orderBy("pre").collect()]
        want = read(d)
        if i == 0:
            want["f"][1] = [1]
        if i == 5:
            want["t"] = {"u": [7]}
        assert nested.rebuild(got) == want, d
