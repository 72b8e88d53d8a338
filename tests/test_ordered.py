"""Chunked windows against plain loops, for every chunk size."""

import random
import re

import pytest
from pyspark.sql import functions as F

from odolog.operators import ordered, quality, stats
from odolog.operators.ordered import MarkerRuns


def series(seed=5, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(5)}"
        t = rnd.randrange(0, 5000)
        rows.append((key, i, None if rnd.random() < 0.1 else t, rnd.random() < 0.2, rnd.randrange(100)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, pos long, t long, marker boolean, v long")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def expected_segments(rows, limit, mode):
    out = {}
    for key, items in by_key(rows).items():
        prev, pending, gaps, marks = None, False, [], []
        for r in items:
            if r[3]:
                pending = True
                continue
            gap = None
            if r[2] is not None:
                if pending and prev is not None:
                    gap = float(r[2] - prev)
                prev, pending = r[2], False
            marks.append((r[1], gap))
            if gap is not None:
                gaps.append(gap)
        split = mode == "each" or sum(gaps) > limit
        segment = 0
        for pos, gap in marks:
            if split and gap is not None and (mode == "total" or gap > limit):
                segment += 1
            out[(key, pos)] = segment
    return out


@pytest.mark.parametrize("width", [1, 7, 50, 10_000])
@pytest.mark.parametrize("mode,limit", [("each", 900), ("total", 900), ("total", 1e9)])
def test_segments(spark, width, mode, limit):
    rows = series()
    df = frame(spark, rows)
    out = quality.split_trips(df, ["k"], F.floor(F.col("pos") / width), ["pos"], "ts", F.col("marker"), limit, mode)
    assert {(r["k"], r["pos"]): r["segment"] for r in out.collect()} == expected_segments(rows, limit, mode)
    assert set(out.columns) == {"k", "pos", "t", "marker", "v", "ts", "segment"}


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_gaps(spark, width):
    rows = series(9)
    df = frame(spark, rows)
    got = MarkerRuns(df, ["k"], F.floor(F.col("pos") / width), ["pos"], "ts", F.col("marker")).gaps()
    want = []
    for key, items in by_key(rows).items():
        prev, pending = None, False
        for r in items:
            if r[3]:
                pending = True
            elif r[2] is not None:
                if pending and prev is not None:
                    want.append((key, float(r[2] - prev)))
                prev, pending = r[2], False
    assert sorted((r["k"], r["gap_s"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_neighbours_and_numbers(spark, width):
    rows = series(13)
    df = frame(spark, rows)
    chunk = F.floor(F.col("pos") / width)
    got = {(r["k"], r["pos"]): (r["prev_v"], r["next_v"]) for r in ordered.neighbours(df, ["k"], chunk, ["pos"], ["v"]).collect()}
    numbers = {(r["k"], r["pos"]): r["row_no"] for r in ordered.row_numbers(df, ["k"], chunk, ["pos"]).collect()}
    for key, items in by_key(rows).items():
        for i, r in enumerate(items):
            before = items[i - 1][4] if i else None
            after = items[i + 1][4] if i + 1 < len(items) else None
            assert got[(key, r[1])] == (before, after)
            assert numbers[(key, r[1])] == i + 1
    over_all = ordered.row_numbers(df, [], chunk, ["pos"], start=5)
    assert all(r["row_no"] == r["pos"] + 5 for r in over_all.collect())


def test_chunk_seconds_follow_density(spark):
    df = spark.range(1000).selectExpr("1 as k", "timestamp_seconds(id * 30) as ts")
    assert ordered.pick_chunk_seconds(df, ["k"], "ts", 1000) == 86_400
    assert ordered.pick_chunk_seconds(df, ["k"], "ts", 150) == 3_600
    assert ordered.pick_chunk_seconds(df, ["k"], "ts", 1) == 1 or ordered.pick_chunk_seconds(df, ["k"], "ts", 1) == 60


def test_windows_never_span_a_whole_key(spark):
    df = frame(spark, series())
    out = quality.split_trips(df, ["k"], F.floor(F.col("pos") / 7), ["pos"], "ts", F.col("marker"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    heads = [line for line in plan.split("\n") if "row_number()" in line and "Window" in line]
    assert heads and all("_chunk" in line for line in heads)


@pytest.mark.parametrize("values", [
    [float(i % 17) for i in range(500)],
    [3.4e38, -3.4e38, 1.0, 2.0, 3.0] * 30,
    [1e-300 * i for i in range(200)] + [1e300],
    [5.0] * 99 + [float("nan")] * 5,
    [0.0] * 50 + [1e9] * 50,
    [float("inf"), 1.0, 2.0, 4.0],
])
def test_exact_medians_by_selection(spark, values):
    import statistics

    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 4.0)], "k string, v double")
    got = {r["k"]: r["median"] for r in stats.exact_medians(df, ["k"], ["v"], max_group=3).collect()}
    assert got == {"a": statistics.median([v for v in values if v == v]), "b": 2.5}


def test_dense_ids(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1000 as v").repartition(5)
    got = {r["v"]: r["n"] for r in ordered.dense_ids(df, ["v"], "n", start=10).collect()}
    assert got == {v: v + 10 for v in range(1000)}


def test_start_end_ignores_null_times_and_values(spark):
    rows = [("a", None, 1.0, 1.0), ("a", 5, None, 7.0), ("a", 5, 3.0, 9.0), ("a", 9, 4.0, None), ("b", 1, None, None)]
    df = spark.createDataFrame(rows, "k string, t long, lat double, lon double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["k"]: tuple(r)[1:] for r in stats.start_end_positions(df, "k", "ts", "lat", "lon").collect()}
    assert got == {"a": (3.0, 7.0, 4.0, None), "b": (None, None, None, None)}


@pytest.fixture(autouse=True, params=[0, 200_000], ids=["blocks", "one level"])
def few_chunks(request, monkeypatch):
    monkeypatch.setattr(ordered, "FEW_CHUNKS", request.param)
    return request.param


def test_a_key_of_many_chunks(spark, few_chunks):
    """Every row is a chunk of its own; no window over the rows of the chunks is partitioned by the key alone."""
    n = 100_000
    df = spark.range(n).select(F.floor(F.col("id") / n).alias("k"), F.col("id").alias("pos"), (F.col("id") % 1000 == 7).alias("marker"), F.timestamp_seconds("id").alias("ts"))
    out = ordered.row_numbers(df, ["k"], F.col("pos"), ["pos"])
    assert out.filter("row_no != pos + 1").count() == 0 and out.count() == n
    near = ordered.neighbours(df, ["k"], F.col("pos"), ["pos"], ["pos"])
    assert near.filter("prev_pos != pos - 1 or next_pos != pos + 1").count() == 0 and near.filter("prev_pos is null or next_pos is null").count() == 2
    runs = MarkerRuns(df, ["k"], F.col("pos"), ["pos"], "ts", F.col("marker"))
    assert runs.gaps().filter("gap_s = 2").count() == 100
    assert runs.segments(1.0).agg(F.max("segment")).first()[0] == 100
    if few_chunks:
        return
    windows = [line for line in near._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert windows and any("_block#" in line for line in windows)
    assert not any(re.search(r"\[k#\d+L?\], \[_chunk#", line) for line in windows)  # by key alone only over the rows of blocks


def test_rows_without_a_time_are_cut_by_the_next_column(spark):
    rows = [("hot", i, None if i % 10 else i) for i in range(3000)] + [("b", i, None) for i in range(20)] + [("b", None, None), ("c", 5, 100)]
    df = spark.createDataFrame(rows, "k string, pos long, t long").withColumn("ts", F.timestamp_seconds("t"))
    chunk = ordered.chunk_of(df, ["k"], "ts", "pos", max_rows=200)
    sizes = df.withColumn("c", chunk).groupBy("k", "c").count().agg(F.max("count")).first()[0]
    assert sizes <= 300
    got = {(r["k"], r["pos"]): r["row_no"] for r in ordered.row_numbers(df, ["k"], chunk, ["ts", "pos"]).collect()}
    for key in ("hot", "b", "c"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or 0))
        assert [got[key, r[1]] for r in mine] == list(range(1, len(mine) + 1))
