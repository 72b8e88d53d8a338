"""What the physical plans must and must not hold."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["trip_speeds", "column_stats", "file_stats", "trip_statistics", "trip_wide", "start_end_positions", "bounding_box"]
)
def test_one_scan_one_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange ") == 1
    assert "partial_" in text


def test_scan_reads_only_what_is_needed(spark):
    text = plan(entry.queries()["event_speeds"](spark, SF))
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>", text)


def test_top_trips_do_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["top_trips"](spark, SF))
