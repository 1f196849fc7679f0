from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from palimpsest.operators import stitch

SCHEMA = "skill_id bigint, skill_level int, stat_name string, stat_value string, extra string"
CATALOG = [("mpCost", "int"), ("speedMul", "double"), ("isAura", "boolean"), ("text", "string"), ("skill_level", "int")]


def make(spark, data, block=4096):
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA)
    catalog = spark.createDataFrame(CATALOG, "stat_name string, value_type string")
    return stitch.wide(df, ["skill_id", "skill_level"], "stat_name", "stat_value", catalog, block)


def test_readings(spark):
    cases = {
        "int": [("1,234", "1234"), ("12.0", "12"), ("+7", "7"), ("007", "7"), (" 5 ", "5"), ("1.5", None), ("1,2", None), ("2x", None), ("-0", "0"), ("1e3", "1000"), ("9" * 50, None)],
        "double": [("1,5", "1.5"), (".5", "0.5"), ("1.12e+00", "1.12"), ("inf", None), ("nan", None), ("1.2.3", None), ("-0.0", "0.0"), ("3", "3.0"), ("1e999", None)],
        "boolean": [("YES", "true"), ("1", "true"), ("No", "false"), ("0", "false"), ("2", None), ("maybe", None)],
        "string": [(" a b ", "a b"), ("1,0", "1,0")],
    }
    data = [(t, v, want) for t, vs in cases.items() for v, want in vs]
    df = spark.createDataFrame(data, "t string, v string, want string")
    bad = df.withColumn("got", stitch.reading(F.col("v"), F.col("t"))).where("not (got <=> want)")
    assert rows(bad) == []


def test_cells_conflicts_and_types(spark):
    out = make(spark, [
        (1, 1, "mpCost", "5"), (1, 1, "MP_COST", " 5.0 "), (1, 1, "speed-mul ", "1,5"), (1, 1, "isAura", "yes"), (1, 1, "text", " hi "),
        (1, 2, "mpCost", "5"), (1, 2, "mpCost", "6"), (1, 2, "isAura", "maybe"), (1, 2, "text", None), (1, 2, "unknown", "q"),
        (2, 1, "unknown", "1"), (2, 1, "mpCost", "  "), (None, 1, "mpCost", "1"), (3, None, "mpCost", "1"), (2, 2, None, "1"), (4, 1, "skill_level", "3"),
    ])
    got = {(r.skill_id, r.skill_level): r for r in out.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (4, 1)}
    a = got[1, 1]
    assert (a.mpCost, a.speedMul, a.isAura, a.text, a.conflicts) == (Decimal(5), 1.5, True, "hi", [])
    b = got[1, 2]
    assert (b.mpCost, b.isAura, b.text, b.conflicts) == (None, None, None, ["isAura", "mpCost"])
    assert got[2, 1].mpCost is None and got[4, 1].skill_level_ == Decimal(3)
    assert sorted(r.ordinal for r in got.values()) == [0, 1, 2, 3, 4]
    assert rows(stitch.conflicts(out, ["skill_id", "skill_level"])) == [(1, 2, "isAura"), (1, 2, "mpCost")]


def test_blocks_and_a_hot_cell(spark):
    data = [(i, 1, "mpCost", str(i)) for i in range(50)] + [(7, 1, "mpCost", "7.0")] * 200
    out = make(spark, data, block=8)
    assert [(r.skill_id, int(r.mpCost), r.ordinal) for r in out.orderBy("skill_id").collect()] == [(i, i, i) for i in range(50)]
    assert out.where("size(conflicts) > 0").count() == 0


def test_empty(spark):
    assert make(spark, []).count() == 0


def test_melt_round_trip(spark):
    back = stitch.melt(make(spark, [(1, 1, "mpCost", "5"), (1, 1, "text", "a")]), ["skill_id", "skill_level"])
    assert rows(back) == [(1, 1, "mpCost", "5"), (1, 1, "text", "a")]
