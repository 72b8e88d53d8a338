"""Box joins and place assignment against one-at-a-time loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolog.operators import places
from odolog.operators.places import Box, assign_places, box_join, match_box, place_leaders, start_box


def tables(spark, points, known):
    p = spark.createDataFrame(points, "trip long, lat double, lon double")
    k = spark.createDataFrame(known, "place_id long, lat double, lon double, count long, label string")
    return p, k


def near(box, t, p):
    return t[1] - box.lat_tol <= p[1] <= t[1] + box.lat_tol and t[2] - box.lon_tol <= p[2] <= t[2] + box.lon_tol


def loop(points, known, box, every=False):
    places = [list(k) for k in known]
    top = max([k[0] for k in known], default=0)
    out = {}
    for t in sorted(points):
        hits = [p for p in places if near(box, t, p)]
        if not hits:
            top += 1
            places.append([top, t[1], t[2], 1, None])
            out[t[0]] = (top, 0, "new")
        elif len(hits) == 1:
            out[t[0]] = (hits[0][0], 1, "matched")
        else:
            out[t[0]] = (None, len(hits), "ambiguous")
        if hits and (every or len(hits) == 1):
            for p in hits:
                p[3] += 1
    return out, {p[0]: (p[1], p[2], p[3]) for p in places}


def random_case(seed, n=400, spread=8.0):
    rnd = random.Random(seed)
    points = [(i, rnd.uniform(-spread, spread), rnd.uniform(-spread, spread)) for i in range(n)]
    # equal positions and exact bounds
    points += [(n + i, points[i][1], points[i][2]) for i in range(30)]
    points += [(2 * n + i, points[i][1] + 1.0, points[i][2] - 0.5) for i in range(30)]
    known = [(i + 1, rnd.uniform(-spread, spread), rnd.uniform(-spread, spread), 5, None) for i in range(30)]
    return points, known


@pytest.mark.parametrize("every", [False, True])
def test_assignment_equals_loop(spark, every):
    box = Box(1.0, 0.5)
    points, known = random_case(7)
    p, k = tables(spark, points, known)
    got, registry = assign_places(p, k, box, "trip", "lat", "lon", ["trip"], every)
    want, want_places = loop(points, known, box, every)
    assert {r["trip"]: (r["place_id"], r["matches"], r["outcome"]) for r in got.collect()} == want
    assert {r["place_id"]: (r["lat"], r["lon"], r["count"]) for r in registry.collect()} == want_places


def test_more_points_per_cell_than_a_round_looks_at(spark):
    """Dense cells in a row, visited in turns, so that rounds end at points left out."""
    box = Box(1.0, 1.0)
    rnd = random.Random(5)
    points = [(i, 127.5 + (i * 7 % 9) * 0.45 + rnd.random() * 0.3, rnd.uniform(0, 3)) for i in range(1500)]
    p, k = tables(spark, points, [])
    got, _ = assign_places(p, k, box, "trip", "lat", "lon", ["trip"])
    want, _ = loop(points, [], box)
    assert {r["trip"]: (r["place_id"], r["matches"], r["outcome"]) for r in got.collect()} == want


def test_hot_cell(spark):
    """Most trips start in one place, with distinct positions."""
    box = match_box(0.00002)
    rnd = random.Random(3)
    points = [(i, 48.0 + rnd.uniform(0, 2e-4), 11.0 + rnd.uniform(0, 2e-4)) for i in range(600)]
    p, k = tables(spark, points, [])
    got, _ = assign_places(p, k, box, "trip", "lat", "lon", ["trip"])
    want, _ = loop(points, [], box)
    assert {r["trip"]: (r["place_id"], r["matches"], r["outcome"]) for r in got.collect()} == want


def test_chain_in_order(spark):
    """A line of starts, each in the box of the one before: the longest dependency there is."""
    box = Box(1.0, 1.0)
    points = [(i, i * 0.9, 0.0) for i in range(1000)]
    p, _ = tables(spark, points, [])
    ranked = p.selectExpr("trip as _rank", "lat as _lat", "lon as _lon")
    got = sorted(r["_rank"] for r in place_leaders(ranked, box).collect())
    want, _ = loop(points, [], box)
    assert got == [t for t, (_, n, _) in want.items() if n == 0]


@pytest.mark.parametrize("hot_rows", [None, 5, 1_000_000])
def test_box_join_equals_brute_force(spark, hot_rows):
    box = Box(1.0, 0.5)
    points, known = random_case(11)
    p, k = tables(spark, points, known)
    named = k.selectExpr("place_id", "lat as plat", "lon as plon")
    got = [(r["trip"], r["place_id"]) for r in box_join(p, named, box, "lat", "lon", "plat", "plon", hot_rows=hot_rows).collect()]
    want = [(t[0], q[0]) for t in points for q in known if near(box, t, q)]
    assert sorted(got) == sorted(want)
    anti = box_join(p, named, box, "lat", "lon", "plat", "plon", "left_anti", hot_rows=hot_rows)
    assert {r["trip"] for r in anti.collect()} == {t[0] for t in points} - {t for t, _ in want}
    plan = box_join(p, named, box, "lat", "lon", "plat", "plon")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_absurd_positions(spark):
    box = Box(1.0, 1.0)
    points = [(1, 3.4e38, 0.0), (2, 3.4e38, 0.5), (3, -3.4e38, 0.0), (4, float("nan"), 0.0), (5, 0.0, 0.0)]
    p, k = tables(spark, points, [])
    got, registry = assign_places(p, k, box, "trip", "lat", "lon", ["trip"])
    want = {1: (1, 0, "new"), 2: (1, 1, "matched"), 3: (2, 0, "new"), 5: (3, 0, "new")}
    assert {r["trip"]: (r["place_id"], r["matches"], r["outcome"]) for r in got.collect()} == want
    assert registry.count() == 3


def test_preset_tolerances():
    assert match_box(0.00002) == Box(0.0000510 + 0.00002, 0.0001221 + 0.00002)
    assert start_box() == Box(0.0001010 + 0.00004, 0.0001421 + 0.00004)


def _near(box, p, q):
    """Whether ``q`` lies in the box around ``p``."""
    return q[0] is not None and p[0] is not None and p[0] - box.lat_tol <= q[0] <= p[0] + box.lat_tol and p[1] - box.lon_tol <= q[1] <= p[1] + box.lon_tol


@pytest.mark.parametrize("tile_rows", [7, 500_000])
@pytest.mark.parametrize("box_of_data", [False, True])
def test_range_sums_against_brute_force(spark, tile_rows, box_of_data):
    rng = np.random.default_rng(4)
    box = places.Box(0.05, 0.05)
    spots = lambda n: [(round(float(a), 3), round(float(b), 3)) for a, b in rng.uniform(-0.2, 0.2, (n, 2))]
    asked = spots(120) + [(0.05, 0.05), (0.1, -0.05), (None, 0.0), (0.0, None), (80.0, 3.0)]
    data = spots(200) + [(0.0, 0.0), (0.1, 0.1), (0.05, 0.1), (0.0, 0.0), (None, 0.1), (0.1, -0.1)]
    queries = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "id long, lat double, lon double")
    known = spark.createDataFrame([(*p, 1, i) for i, p in enumerate(data)], "lat double, lon double, n long, v long")
    got = {r["id"]: (r["n"], r["v"]) for r in places.range_sums(queries, known, box, ["n", "v"], box_of_data, tile_rows).collect()}
    for i, p in enumerate(asked):
        inside = [k for k, q in enumerate(data) if None not in q and None not in p and (_near(box, q, p) if box_of_data else _near(box, p, q))]
        assert got[i] == (len(inside), sum(inside)), p
    assert places.range_sums(queries.limit(0), known, box, ["n"]).count() == 0
    assert {r["n"] for r in places.range_sums(queries, known.limit(0), box, ["n"]).collect()} == {0}


def test_many_places_in_one_box_make_no_pairs(spark):
    """Thousands of places in the box of thousands of trips: no operator makes their pairs."""
    n = 3000
    trips = spark.range(n).select(F.col("id"), (F.col("id") % 977 / 1e5).alias("lat"), (F.col("id") % 991 / 1e5).alias("lon"))
    known = spark.range(1, n + 1).select(
        F.col("id").alias("place_id"), (F.col("id") % 967 / 1e5).alias("lat"), (F.col("id") % 983 / 1e5).alias("lon"),
        F.lit(1).cast("long").alias("count"), F.lit(None).cast("string").alias("label"),
    )
    assigned, registry = places.assign_places(trips, known, places.REFRESH_BOX, "id", "lat", "lon", ["id"], every_match=True)
    assert {(r["matches"], r["outcome"]) for r in assigned.collect()} == {(n, "ambiguous")}
    assert {r["count"] for r in registry.collect()} == {n + 1} and registry.count() == n
    counts = places.box_counts(trips, known, places.REFRESH_BOX, "lat", "lon")
    counts.collect()
    plan = counts._jdf.queryExecution().executedPlan()
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        todo += [children.apply(i) for i in range(children.length())]
    assert 0 < most <= 20 * n
