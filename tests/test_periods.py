from datetime import datetime

from conftest import rows

from palimpsest.operators.periods import as_of, validity_periods

SCHEMA = "event_id bigint, kind string, key string, version string, status string, data string, received_at timestamp, label string"
T = [datetime(2031, 1, i) for i in range(1, 10)]


def releases(spark):
    return spark.createDataFrame([(1, "v1", 1), (4, "v4", 2), (2, "V2 ", 3), (3, "v3", 4)], "version_id bigint, label string, ord int")


def run(spark, data):
    df = spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(data)], SCHEMA)
    return validity_periods(df, releases(spark))


def pick(df):
    return rows(df.select("kind", "key", "from_version_id", "to_version_id"))


def test_periods(spark):
    data = [
        ("k", "a", "v1", "added", '{"x":1,"y":[1,2]}', T[0]), ("k", "a", "V4", "modified", '{"y": [1, 2], "x": 1}', T[1]),  # the same data
        ("k", "a", "v2", None, '{"x":1,"y":[2,1]}', T[2]), ("k", "a", "v3", " Removed", '{"x":1,"y":[2,1]}', T[3]),
        ("k", "b", "v3", "added", '{"n":"\\u00e9"}', T[0]), ("k", "b", "v1", "added", '{"n":"é"}', T[5]), ("k", "b", "none", "removed", None, T[6]),
        ("k", "c", "v1", "removed", None, T[0]), ("k", "c", "v2", "added", "{}", T[0]), ("k", "c", "v2", "added", "{} ", T[0]), ("k", "c", "v2", "removed", None, None),
        ("k", "d", "v1", "added", None, T[0]), ("k", "d", "v4", "added", "broken{", T[0]), ("k", "d", "v2", "added", " broken{", T[0]),
        ("k", "e", "v1", "added", "1", T[0]), ("k", "e", "v4", "removed", None, T[0]), ("k", "e", "v2", "added", "1", T[0]),
        (None, None, "v1", "added", "1", T[0]), ("k", "f", None, "added", "1", T[0]),
    ]
    found = run(spark, data)
    assert pick(found) == sorted([
        ("k", "a", 1, 2), ("k", "a", 2, 3), ("k", "b", 1, 0), ("k", "c", 2, 0), ("k", "d", 1, 4), ("k", "d", 4, 0), ("k", "e", 1, 4), ("k", "e", 2, 0), (None, None, 1, 0),
    ], key=repr)
    assert pick(as_of(found, releases(spark), 4)) == sorted([("k", "a", 1, 2), ("k", "b", 1, 0), ("k", "d", 4, 0), (None, None, 1, 0)], key=repr)


def test_empty_long_and_repeated(spark):
    assert pick(run(spark, [])) == []
    long = '{"t":"' + "x" * 300_000 + '"}'
    deep = "[" * 3000 + "]" * 3000
    data = [("k", "a", "v1", "added", long, T[0])] * 50 + [("k", "a", "v4", "modified", long, T[1]), ("k", "b", "v1", "added", deep, T[0]), ("k", "b", "v4", "added", deep + " ", T[0])]
    assert pick(run(spark, data)) == [("k", "a", 1, 0), ("k", "b", 1, 0)]
