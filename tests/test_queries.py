"""Every query against the SQL that defines it."""

import pytest

import __spark_entry__ as entry
from odolog.plans.file_suite import ORACLES, QUERIES as OWN_QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
# the library's own queries; those of the optional subpackage have their own tests
QUERIES = {name: build for name, build in entry.queries().items() if name in OWN_QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(spark, con, lambda *_: df, ORACLES[name], SF) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name, key", [
    ("top_trips", ["o_totalprice", "o_orderkey"]), ("limited_files", ["o_orderkey"]), ("sorted_files", ["csvfile"]), ("columns_by_count", ["count", "column"]),
])
def test_rows_come_in_order(spark, con, name, key):
    """The SQL compares sets of rows; these queries also promise their order."""
    descending = {"o_totalprice", "count"}
    terms = ", ".join(f'"{c}" desc' if c in descending else f'"{c}"' for c in key)
    columns = ", ".join(f'"{c}"' for c in key)
    want = con.sql(f"select {columns} from ({ORACLES[name]}) order by {terms}").fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, SF).select(*key).collect()]
    assert got == want and len(got) > 2
