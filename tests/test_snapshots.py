from datetime import datetime

from conftest import rows

from palimpsest.operators.snapshots import snapshot_changes, steps

T = [datetime(2031, 1, i) for i in range(1, 10)]
SCHEMA = "version_id bigint, source string, kind string, key string, hash string, loaded_at timestamp, status string"
H = {c: c * 64 for c in "abcdef"}


def run(spark, data, done=((1, "s"), (2, "s"), (3, "s")), order=(1, 2, 3)):
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    ext = spark.createDataFrame(list(done), "version_id bigint, extractor string")
    rel = spark.createDataFrame([(v, i) for i, v in enumerate(order, 1)], "version_id bigint, ord int")
    return rows(snapshot_changes(df, steps(ext, rel)).select("version_id", "kind", "key", "status"))


def test_changes_spelling_and_reloads(spark):
    data = [
        (1, "s", "k", "a/b", H["a"], T[0]), (1, "s", "k", "gone", H["a"], T[0]), (1, "s", "k", "same", H["a"], T[0]),
        (2, "s", "k", "\\a//b", " " + H["A".lower()].upper(), T[0]), (2, "s", "k", "same", H["b"], T[0]), (2, "s", "k", "/same", H["a"], T[1]), (2, "s", "k", "new", H["c"], T[0]),
        (2, "s", "k", "new", H["c"], T[0]), (3, "s", "k", "a/b", H["f"], T[0]), (3, "s", "k", "same", H["a"], T[0]), (3, "s", "k", "new", None, T[0]),
    ]
    assert run(spark, data) == [(2, "k", "gone", "removed"), (2, "k", "new", "added"), (3, "k", "a/b", "modified"), (3, "k", "new", "modified")]


def test_incomplete_versions_and_release_order(spark):
    data = [(1, "s", "k", "x", H["a"], T[0]), (2, "s", "k", "y", H["a"], T[0]), (3, "s", "k", "x", H["a"], T[0])]
    assert run(spark, data, done=((1, "s"), (3, "s"), (3, "s"))) == []
    assert run(spark, data, order=(2, 1, 3)) == [(1, "k", "x", "added"), (1, "k", "y", "removed")]


def test_nulls_ties_and_empty(spark):
    data = [
        (1, "s", None, "x", H["a"], None), (1, "s", None, "x", H["b"], T[0]), (1, "s", "k", None, None, T[0]), (1, None, "k", "z", H["a"], T[0]),
        (2, "s", None, "x", H["b"], T[0]), (2, "s", "k", None, None, None), (None, "s", "k", "q", H["a"], T[0]),
        (3, "s", None, "x", H["a"], T[0]), (3, "s", None, "x", H["c"], T[0]), (3, "s", "k", None, "short", T[0]),
    ]
    assert run(spark, data) == [(3, None, "x", "modified"), (3, "k", None, "modified")] or run(spark, data) == [(3, "k", None, "modified"), (3, None, "x", "modified")]
    assert run(spark, []) == []


def test_one_record_loaded_over_and_over(spark):
    data = [(1, "s", "k", "hot", H["a"], T[0])] * 2000 + [(2, "s", "k", "hot", H["a"], T[0])] * 500 + [(2, "s", "k", "hot", H["b"], T[1])]
    assert run(spark, data) == [(2, "k", "hot", "modified"), (3, "k", "hot", "removed")]


def test_hashes_of_any_form_come_back(spark):
    from pyspark.sql import functions as F

    from palimpsest.operators.snapshots import hash_bytes, hash_text, path_key

    forms = ["a" * 64, "AB" * 32, " " + "0f" * 32 + "\t", "z" * 64, "a" * 63, " " + "a" * 63, "short", "", None, "é" * 64, "0" * 65]
    df = spark.createDataFrame([(f,) for f in forms], "h string")
    got = [r[0] for r in df.select(hash_text(hash_bytes(F.col("h")))).collect()]
    assert got == [None if f is None else f.strip().lower() for f in forms]
    keys = ["a/b", "/a", "a/", "a//b", "a\\b", "\\\\a\\/b/", "/", "", None]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(path_key(F.col("k"))).collect()]
    assert got == ["a/b", "a", "a", "a/b", "a/b", "a/b", "", "", None]
