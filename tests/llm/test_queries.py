"""The registered queries of the training-data operators, against their SQL where there is one."""

import duckdb
import pytest

import __spark_entry__ as entry
from odolog.llm.suite import ORACLES, QUERIES
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, entry.queries()[name], ORACLES[name], SF) is None


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


def test_held_out_accuracy(spark):
    got = QUERIES["op8_quadratic_discriminant"](spark, "/root/testdata/sf0.01").toPandas()
    labels = duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").df()
    seen = got.merge(labels, on="doc_id")
    seen = seen[seen.held_out]
    assert len(got) == 1000 and len(seen) > 80 and (seen.predicted == seen.quality).mean() > 0.97
