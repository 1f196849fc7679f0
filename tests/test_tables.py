"""The problems' queries on the smallest tables against plain versions of them, and the driver's contract."""

import brute
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found"])
def test_found(spark, data, name):
    load = lambda t: pq.read_table(f"{data}/{t}.parquet").to_pylist()
    tables = {"p1": ["skills"], "p2": ["skill_levels", "stat_catalog"], "p3": ["records", "extractions", "client_versions"], "p4": ["history_events", "client_versions"], "p5": ["raw_records", "client_versions"], "p6": ["nested_records"]}
    want = getattr(brute, name[:2])(*(load(t) for t in tables[name[:2]]))
    got = [tuple(r) for r in entry.queries()[name](spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_contract(spark):
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert all(f"p{n}_found" in queries for n in range(1, 7))
