"""Commits of the store, its index of trips, and compaction."""

import json

import pytest
from pyspark.sql import functions as F

from odolog.operators import views
from odolog.plans import store as stores
from odolog.plans.store import TripStore


def rows(spark, trips, each=3):
    df = spark.range(trips * each)
    return df.select(
        (F.col("id") % trips + 1).alias("fileid"), F.lit(0).cast("long").alias("block_start"), F.col("id").alias("seq"),
        F.timestamp_seconds("id").alias("gpstime"), (F.col("id") / 7.0).alias("latitude"), (F.col("id") / 3.0).alias("longitude"),
    )


@pytest.fixture
def store(spark, tmp_path):
    return TripStore(spark, str(tmp_path / "store"))


def test_of_two_jobs_one_commits(spark, store):
    other = TripStore(spark, store.root)
    store.append("logs", rows(spark, 2))
    first, second = store.version() + 1, other.version() + 1
    assert first == second == 2
    store.stage("logs", rows(spark, 5), first)
    other.stage("logs", rows(spark, 7), second)  # the folders of two jobs are their own
    other.commit(second, {"logs": False})
    with pytest.raises(RuntimeError):
        store.commit(first, {"logs": False})
    assert store.read("logs").count() == 6 + 21 == other.read("logs").count()
    assert store.read("logindex").agg(F.sum("rows")).first()[0] == 27
    # both past the check of the version: the file exists, or not
    text = json.dumps({"version": 3, "tables": {}})
    assert store._put_if_absent("commits/000000000000/000000000003.json", text)
    assert not other._put_if_absent("commits/000000000000/000000000003.json", text)


def test_unfinished_commits_do_not_count(spark, store):
    store.append("files", spark.createDataFrame([(1,)], "fileid long"))
    with open(f"{store.root}/commits/000000000000/000000000002.json", "w") as f:
        f.write('{"version": 2, "tab')
    assert store.version() == 1 and store.read("files").count() == 1


def test_a_thousand_commits_list_few_files(spark, store, monkeypatch):
    for version in range(1, 1001):
        store.commit(version, {"files": True}, {"files": f"files/version={version}"})
    listed = []
    monkeypatch.setattr(store, "_names", lambda folder, inner=store._names: listed.append(names := inner(folder)) or names)
    assert store.state()["tables"] == {"files": ["files/version=1000"]} and sum(map(len, listed)) <= 2 * stores.BUCKET
    with pytest.raises(RuntimeError):
        store.commit(1000, {"files": True})
    with pytest.raises(RuntimeError):
        store.commit(1002, {"files": True})


def test_a_trip_opens_its_own_files(spark, store):
    trips = 1000
    for part in range(4):
        store.append("logs", rows(spark, trips).filter(F.col("seq") % 4 == part).repartition(4))
    whole = lambda: sorted(map(tuple, store.read("logs").select("fileid", "seq", "latitude").collect()))
    before = whole()
    trip = lambda n: sorted(r["seq"] for r in store.read_trip(n).collect())
    assert trip(500) == [499, 1499, 2499] and len(store.read_trip(500).inputFiles()) <= 3
    store.compact_logs(rows_per_file=100)
    assert whole() == before and len(store.read("logs").inputFiles()) >= 25
    for n in (1, 500, 1000):
        assert trip(n) == [n - 1, n + 999, n + 1999] and len(store.read_trip(n).inputFiles()) <= 2
    assert store.read_trip(0).count() == 0 and store.read_trip(0).columns == store.read("logs").columns
    assert views.track(store.read_trip(7), "fileid", "latitude", "longitude").count() == 3
    # a trip with most rows lies in many files; too many are scanned instead of named
    store.append("logs", rows(spark, 1, each=2000))
    store.compact_logs(rows_per_file=100)
    assert len(store.read_trip(1).inputFiles()) >= 15 and store.read_trip(1).count() == 2003
    rows_before = store.read_trip(1).count()
    limit, stores.TRIP_FILES = stores.TRIP_FILES, 3
    try:
        assert store.read_trip(1).count() == rows_before
    finally:
        stores.TRIP_FILES = limit


def test_reset_empties_rows_and_index(spark, store):
    store.append("logs", rows(spark, 3))
    store.reset(confirm=True)
    assert store.read("logs").count() == store.read("logindex").count() == store.read_trip(1).count() == 0
    store.append("logs", rows(spark, 2))
    assert store.read("logs").count() == 6 and store.read_trip(2).count() == 3
