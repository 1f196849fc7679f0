"""Queries of the engine against plain versions of them, and all light ones against their SQL on the smallest tables."""

import importlib
import re
import unicodedata
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.operators import search
from palimpsest.sources.store import latest_records


def kept(c):
    return c in "'%" or unicodedata.category(c)[0] in "LN"


def n_tokens(text):
    return sum(not kept(c) or not i or not kept(text[i - 1]) for i, c in enumerate(text))


def test_tokens_of_all_documents(spark, tmp_path):
    texts = ["plain text, here", "Der Händler\tverkauft für 5 %\r\n", "Повышает скорость атаки", "最大の敵に!", "오류 수정: 밤에", "l’été, c'est ½", "e\u0301te\u0301 🎉", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in entry.queries()["text_tokens"](spark, str(tmp_path)).collect()}
    assert got == {i: n_tokens(t) for i, t in enumerate(texts) if t is not None}


def test_page_of_all_cleaned_keys(spark, tmp_path):
    raw = ["12", "/7", "skill\\\\100/", "skill//9", "3", "Skill", "18446744073709551616", "3/"] + [str(i) for i in range(1000, 1190)]
    rows = [(1, "extractor", "skill", k, f"h{i}", "b", "2024-01-01") for i, k in enumerate(raw)] + [(1, "extractor", "img", "5", "h", "b", "2024-01-01")]
    spark.createDataFrame(rows, "version_id int, source string, kind string, key string, hash string, blob_hash string, loaded_at string").write.parquet(f"{tmp_path}/records.parquet")
    keys = {re.sub(r"^/|/$", "", re.sub(r"[/\\\\]+", "/", k)) for k in raw}
    number = lambda k: int(k) if k.isdigit() and int(k) < 1 << 64 else None
    order = sorted(keys, key=lambda k: (number(k) is None, number(k) or 0, k))
    rows_ = latest_records(spark.read.parquet(f"{tmp_path}/records.parquet")).where("kind = 'skill'").select("kind", "key").distinct()
    got = [tuple(r) for r in search.page(rows_, 0).collect()]
    assert got == [("skill", k) for k in order[: search.PAGE]] and ("skill", "skill/100") in got
    assert [tuple(r) for r in search.page(rows_, 1, ["key", "kind"], 50).collect()] == [("skill", k) for k in order[50:100]]


HEAVY = ("store_", "import", "snapshot_", "file_gc", "p7", "p8", "p9")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("module", ["problems", "reference", "pages", "storage"])
def test_against_sql(spark, data, module):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    plans = importlib.import_module(f"palimpsest.plans.{module}")
    wrong = []
    for name, sql in plans.ORACLE.items():
        if name.startswith(HEAVY):
            continue
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        want = sorted(repr(plain(r)) for r in found.fetchall())
        got = plans.QUERIES[name](spark, data)
        if sorted(got.columns) != sorted(columns) or sorted(repr(plain(tuple(r))) for r in got.select(*(f"`{c}`" for c in columns)).collect()) != want:
            wrong.append(name)
    assert not wrong
