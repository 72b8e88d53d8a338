"""Matching trip ends to known places by a latitude / longitude box.

The box join is an equi-join on grid cells plus an exact ``between``. A cell is slightly larger
than the tolerance, so all matches of a point lie in the 3 x 3 cells around it. The places (the
small, sparse side) are copied to those nine cells; points stay one row each. Cells that hold very
many points (a depot, a home) are salted: their points spread over several partitions and only the
places near such a cell are copied once more per salt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.operators.ordered import dense_ids
from odolog.session import durable


@dataclass(frozen=True)
class Box:
    """Tolerances of a match, in the unit of the coordinates; bounds are inclusive."""

    lat_tol: float
    lon_tol: float

    def matches(self, lat: Column, lon: Column, place_lat: Column, place_lon: Column) -> Column:
        return place_lat.between(lat - self.lat_tol, lat + self.lat_tol) & place_lon.between(
            lon - self.lon_tol, lon + self.lon_tol
        )

    def cell(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        # a little wider than the tolerance, so rounding at the bound cannot skip a cell
        return (
            F.floor(lat / (1.001 * self.lat_tol)).cast("long"),
            F.floor(lon / (1.001 * self.lon_tol)).cast("long"),
        )


# Tolerances in degrees. ``offset`` widens both.
def match_box(offset: float = 0.00004) -> Box:
    """Box of start and end places."""
    return Box(0.0000510 + offset, 0.0001221 + offset)


def start_box(offset: float = 0.00004) -> Box:
    """Wider box used for start places only."""
    return Box(0.0001010 + offset, 0.0001421 + offset)


LIVE_BOX = match_box(0.00002)
REFRESH_BOX = Box(0.05, 0.05)

HOT_CELL_ROWS = 1_000_000


def _around(df: DataFrame, cy: Column, cx: Column) -> DataFrame:
    """Nine copies of each row, one per cell around it."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (
        df.withColumn("_dy", F.explode(steps))
        .withColumn("_dx", F.explode(steps))
        # null beyond the last cell, where absurd coordinates end up
        .withColumns({"_cy": F.try_add(cy, F.col("_dy")), "_cx": F.try_add(cx, F.col("_dx"))})
        .drop("_dy", "_dx")
    )


def box_join(
    points: DataFrame,
    places: DataFrame,
    box: Box,
    lat: str,
    lon: str,
    place_lat: str,
    place_lon: str,
    how: str = "inner",
    condition: Column | None = None,
    hot_rows: int | None = HOT_CELL_ROWS,
    box_of_place: bool = False,
) -> DataFrame:
    """Points with every place in their box; each pair once. ``how``: inner, left, left_semi, left_anti.

    Column names of the two sides must differ. ``condition`` is a further test on the pair.
    ``box_of_place`` lays the box around the place instead, which differs by rounding at its bounds.
    """
    cy, cx = box.cell(F.col(lat), F.col(lon))
    left = points.withColumns({"_cy": cy, "_cx": cx})
    py, px = box.cell(F.col(place_lat), F.col(place_lon))
    right = _around(places, py, px)
    on = ["_cy", "_cx"]
    if hot_rows:
        # at most (points / hot_rows) cells can be hot, which bounds the broadcast
        hot = F.broadcast(
            left.groupBy("_cy", "_cx")
            .count()
            .filter(F.col("count") > hot_rows)
            .select("_cy", "_cx", F.ceil(F.col("count") / hot_rows).cast("int").alias("_salts"))
        )
        left = left.join(hot, ["_cy", "_cx"], "left").withColumn(
            "_salt", F.coalesce(F.pmod(F.xxhash64(*points.columns), F.col("_salts")), F.lit(0)).cast("int")
        )
        right = (
            right.join(hot, ["_cy", "_cx"], "left")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
            .drop("_salts")
        )
        left = left.drop("_salts")
        on.append("_salt")
    right = right.withColumnsRenamed({c: f"{c}_r" for c in on})
    point, place = (F.col(lat), F.col(lon)), (F.col(place_lat), F.col(place_lon))
    test = box.matches(*place, *point) if box_of_place else box.matches(*point, *place)
    for c in on:
        test = test & (F.col(c) == F.col(f"{c}_r"))
    if condition is not None:
        test = test & condition
    out = left.join(right, test, how)
    return out.drop(*on, *[f"{c}_r" for c in on])


def exact_join(points: DataFrame, places: DataFrame, lat: str, lon: str, place_lat: str, place_lon: str, how: str = "inner") -> DataFrame:
    """Points with the places at exactly their position."""
    return points.join(places, (F.col(lat) == F.col(place_lat)) & (F.col(lon) == F.col(place_lon)), how)


def _sums_within(lat: np.ndarray, lon: np.ndarray, values: list[np.ndarray], spans: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Per query the sums of ``values`` over the data whose rank by latitude and by longitude lies in its spans.

    ``spans``: first and end rank by latitude, first and end rank by longitude. Data in the order of latitude are dealt out by the
    bits of their longitude rank, highest first; every query follows its span of latitudes through the levels and, where its bound
    has a one, takes the sum of the zeros. Time and memory are (data + queries) x log(data), however many data a query holds.
    """
    south, north, west, east = (s.astype(np.int64) for s in spans)
    order = np.argsort(lat, kind="stable")
    rank = np.empty(len(lon), np.int64)
    rank[np.argsort(lon, kind="stable")] = np.arange(len(lon))
    rank, values = rank[order], [v[order] for v in values]
    bits = max(1, len(lon).bit_length())
    sums = [np.zeros(len(south), np.int64) for _ in values]
    first = {side: south.copy() for side in (1, -1)}
    end = {side: np.maximum(north, south) for side in (1, -1)}
    bound = {1: np.maximum(east, west), -1: west}  # data below east, less those below west
    for bit in range(bits - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        below = [np.concatenate(([0], np.cumsum(np.where(one, 0, v)))) for v in values]
        for side in (1, -1):
            up = (bound[side] >> bit) & 1 == 1
            a, b = first[side], end[side]
            for out, prefix in zip(sums, below):
                out[up] += side * (prefix[b] - prefix[a])[up]
            first[side] = np.where(up, zeros[-1] + a - zeros[a], zeros[a])
            end[side] = np.where(up, zeros[-1] + b - zeros[b], zeros[b])
        move = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
        rank, values = rank[move], [v[move] for v in values]
    return sums


TILE_ROWS = 500_000  # positions a task counts in at a time


def range_sums(
    queries: DataFrame, data: DataFrame, box: Box, sums: list[str], box_of_data: bool = False, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """``queries`` (``lat``, ``lon``, other columns) with the sums of the columns ``sums`` (long) of ``data`` (``lat``, ``lon``) in their box.

    No pair is made. Data are combined by position and dealt to grid cells, queries to the nine cells around; each
    cell is solved by sorting (``_sums_within``), and the parts of a query are added. Cells of more than ``tile_rows``
    positions are cut into tiles by hash, which all queries of the cell visit, so tasks stay bounded. Bounds are those of
    ``Box.matches`` around the query, or with ``box_of_data`` around the data, to the last bit. Rows without a position
    get zeros.
    """
    for c in sums:
        if c in queries.columns:
            raise ValueError(f"queries have a column {c}")
    spots = queries.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    cy, cx = box.cell(F.col("lat"), F.col("lon"))
    placed = data.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums])
    placed = placed.withColumns({"_cy": cy, "_cx": cx})
    tiles = placed.groupBy("_cy", "_cx").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_tiles"))
    placed = durable(placed)
    tiles = durable(tiles)
    own = placed.join(tiles, ["_cy", "_cx"]).withColumn("_tile", F.pmod(F.xxhash64("lat", "lon"), F.col("_tiles")).cast("int"))
    asked = _around(spots, cy, cx).join(tiles, ["_cy", "_cx"])
    asked = asked.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    none = [F.lit(None).cast("long").alias(c) for c in sums]
    rows = own.select("_cy", "_cx", "_tile", "lat", "lon", *sums).unionByName(asked.select("_cy", "_cx", "_tile", "lat", "lon", *none))
    lat_tol, lon_tol = box.lat_tol, box.lon_tol

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        is_data = group[sums[0]].notna().to_numpy()
        y, x = group["lat"].to_numpy(), group["lon"].to_numpy()

        def span(values: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
            known, at = np.sort(values[is_data]), values[~is_data]
            if box_of_data:
                return np.searchsorted(known + tol, at, "left"), np.searchsorted(known - tol, at, "right")
            return np.searchsorted(known, at - tol, "left"), np.searchsorted(known, at + tol, "right")

        found = _sums_within(
            y[is_data], x[is_data], [group[c][is_data].to_numpy().astype(np.int64) for c in sums], (*span(y, lat_tol), *span(x, lon_tol))
        )
        return pd.DataFrame({"lat": y[~is_data], "lon": x[~is_data], **dict(zip(sums, found))})

    schema = "lat double, lon double, " + ", ".join(f"{c} long" for c in sums)
    parts = rows.groupBy("_cy", "_cx", "_tile").applyInPandas(solve, schema)
    totals = parts.groupBy(F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon")).agg(*[F.sum(c).alias(f"_q{c}") for c in sums])
    joined = queries.join(totals, (F.col("lat") == F.col("_qlat")) & (F.col("lon") == F.col("_qlon")), "left")
    return joined.select(*queries.columns, *[F.coalesce(f"_q{c}", F.lit(0)).alias(c) for c in sums])


def box_counts(points: DataFrame, places: DataFrame, box: Box, lat: str, lon: str) -> DataFrame:
    """``points`` with ``matches``, the places in their box, and ``place_id``, the place where there is one only. For wide boxes with
    many places in each: no pair is made."""
    named = points.withColumns({"_lat": F.col(lat).cast("double"), "_lon": F.col(lon).cast("double")})
    known = places.select(F.col("lat").cast("double"), F.col("lon").cast("double"), F.lit(1).cast("long").alias("_n"), F.col("place_id").cast("long").alias("_id"))
    asked = named.select("_lat", "_lon").distinct().withColumnsRenamed({"_lat": "lat", "_lon": "lon"})
    # numbers are added, so that they tell the place where there is one; 40 bits of them at a time, for sums that fit
    low = F.col("_id").bitwiseAND(F.lit((1 << 40) - 1))
    known = known.withColumns({"_low": low, "_high": F.shiftright("_id", 40)}).drop("_id")
    found = range_sums(asked, known, box, ["_n", "_low", "_high"]).withColumnsRenamed({"lat": "_flat", "lon": "_flon"})
    joined = named.join(found, (F.col("_lat") == F.col("_flat")) & (F.col("_lon") == F.col("_flon")), "left")
    one = F.when(F.col("_n") == 1, F.shiftleft("_high", 40).bitwiseOR(F.col("_low")))
    return joined.select(*points.columns, F.coalesce("_n", F.lit(0)).alias("matches"), one.alias("place_id"))


# Places always come as (place_id, lat, lon, count, label); they are renamed here so that they can
# be joined to points of any shape.
def _named_places(places: DataFrame) -> DataFrame:
    return places.select(
        "place_id", F.col("lat").alias("_plat"), F.col("lon").alias("_plon"), F.col("label").alias("_label")
    )


def match_counts(
    points: DataFrame, places: DataFrame, box: Box, key: list[str], lat: str, lon: str,
    hot_rows: int | None = HOT_CELL_ROWS,
) -> DataFrame:
    """Per point: places in its box, the place when there is exactly one, and the outcome.

    Pairs go straight from the join into a partial aggregate; they are never shuffled.
    """
    pairs = box_join(points, _named_places(places), box, lat, lon, "_plat", "_plon", "left", hot_rows=hot_rows)
    counted = pairs.groupBy(*key).agg(F.count("place_id").alias("matches"), F.min("place_id").alias("_one"))
    return counted.select(
        *key,
        "matches",
        F.when(F.col("matches") == 1, F.col("_one")).alias("place_id"),
        F.when(F.col("matches") == 0, "new").when(F.col("matches") == 1, "matched").otherwise("ambiguous").alias("outcome"),
    )


def ambiguity_report(
    points: DataFrame, places: DataFrame, box: Box, key: list[str], lat: str, lon: str,
    hot_rows: int | None = HOT_CELL_ROWS,
) -> DataFrame:
    """Per point with several places in its box: how many, whether all labels agree, how many have none."""
    pairs = box_join(points, _named_places(places), box, lat, lon, "_plat", "_plon", hot_rows=hot_rows)
    low, high = F.min("_label"), F.max("_label")
    unlabelled = F.count_if(F.col("_label").isNull())
    agree = ((low == high) & (unlabelled == 0)) | (unlabelled == F.count(F.lit(1)))
    return (
        pairs.groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("matches"),
            F.coalesce(agree, F.lit(False)).alias("labels_agree"),
            unlabelled.alias("unlabelled"),
        )
        .filter(F.col("matches") > 1)
    )


def ambiguous_places(
    points: DataFrame, places: DataFrame, box: Box, key: list[str], lat: str, lon: str,
    hot_rows: int | None = HOT_CELL_ROWS,
) -> DataFrame:
    """Long relation (key, place_id, label) of the places in the box of points that have several."""
    pairs = box_join(points, _named_places(places), box, lat, lon, "_plat", "_plon", hot_rows=hot_rows)
    several = pairs.groupBy(*key).count().filter(F.col("count") > 1).select(*key)
    return pairs.join(several, key, "left_semi").select(*key, "place_id", F.col("_label").alias("label"))


def unlabelled_hits(matched: DataFrame, places: DataFrame) -> DataFrame:
    """One row: points matched to a place without a label."""
    bare = places.filter(F.col("label").isNull()).select("place_id")
    return matched.join(bare, "place_id", "left_semi").agg(F.count(F.lit(1)).alias("unlabelled_hits"))


# -- assignment in trip order ----------------------------------------------------------------------


TILE_BITS = 7  # a tile is 128 x 128 cells
PER_CELL = 64  # earliest undecided points of a cell that a round looks at


def _decide(box: Box):
    """Who opens a place among the points of a tile, as far as the tile can tell.

    Rows are the first undecided points of the tile's cells and of the cells around the tile. A point
    stays open while an earlier point in its box is open itself, or may be among those left out."""
    lat_tol, lon_tol = box.lat_tol, box.lon_tol  # plain numbers, so tasks need nothing of this package

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rank")
        left_out = rows["_nth"] > PER_CELL
        horizon = {(y, x): r for y, x, r in rows.loc[left_out, ["_cy", "_cx", "_rank"]].itertuples(index=False)}
        rows = rows[~left_out]
        seen: dict[tuple[int, int], list[tuple[float, float, bool]]] = {}
        opened = []
        columns = ("_cy", "_cx", "_lat", "_lon", "_rank", "_own")
        for i, (y, x, lat, lon, rank, own) in enumerate(zip(*(rows[c] for c in columns))):
            cells = [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
            near = [
                is_open
                for cell in cells
                for a, b, is_open in seen.get(cell, ())
                if lat - lat_tol <= a <= lat + lat_tol and lon - lon_tol <= b <= lon + lon_tol
            ]
            if own and not all(near):
                continue  # an earlier opener lies in its box
            known = own and not near and all(horizon.get(cell, rank) >= rank for cell in cells)
            seen.setdefault((y, x), []).append((lat, lon, not known))
            if known:
                opened.append(i)
        return rows.iloc[opened][["_lat", "_lon", "_rank", "_cy", "_cx"]]

    return run


def place_leaders(points: DataFrame, box: Box) -> DataFrame:
    """Points (_rank, _lat, _lon) that open a new place when taken one at a time by ``_rank``.

    A point opens a place when no earlier opener lies in its box. Decided in rounds: the earliest
    ``PER_CELL`` undecided points of every grid cell go to the tile they lie in (and to the tiles next
    to it), where they are taken one at a time as far as they do not depend on points of other
    tiles; then all points in the box of a new place are decided. A tile holds a bounded number of
    points however dense its cells are, and a chain of points that depend on each other costs a
    round per tile it crosses. The result is exactly that of the one-at-a-time rule.
    """
    # equal positions: only the first of them can open a place
    cy, cx = box.cell(F.col("_lat"), F.col("_lon"))
    left = durable(
        points.groupBy("_lat", "_lon").agg(F.min("_rank").alias("_rank")).withColumns({"_cy": cy, "_cx": cx})
    )
    schema = left.schema
    found: list[DataFrame] = []
    in_order = Window.partitionBy("_cy", "_cx").orderBy("_rank")

    def tiles(cell: str) -> Column:
        """The tile of a cell and those next to it, where the cell lies at an edge."""
        steps = [F.coalesce(F.try_add(cell, F.lit(d)), F.col(cell)) for d in (-1, 0, 1)]
        return F.explode(F.array_distinct(F.array(*[F.shiftright(c, TILE_BITS) for c in steps])))

    own = (F.col("_ty") == F.shiftright("_cy", TILE_BITS)) & (F.col("_tx") == F.shiftright("_cx", TILE_BITS))
    while not left.isEmpty():
        first = left.withColumn("_nth", F.row_number().over(in_order)).filter(F.col("_nth") <= PER_CELL + 1)
        dealt = first.withColumn("_ty", tiles("_cy")).withColumn("_tx", tiles("_cx")).withColumn("_own", own)
        opened = durable(dealt.groupBy("_ty", "_tx").applyInPandas(_decide(box), schema))
        found.append(opened)
        taken = opened.select(
            F.col("_rank").alias("_orank"), F.col("_lat").alias("_olat"), F.col("_lon").alias("_olon")
        )
        left = durable(
            box_join(
                left.drop("_cy", "_cx"), taken, box, "_lat", "_lon", "_olat", "_olon", "left_anti",
                condition=F.col("_orank") <= F.col("_rank"),
            ).withColumns({"_cy": cy, "_cx": cx}).select(*left.columns)
        )
    out = left
    for part in found:
        out = out.unionByName(part)
    return out.select("_rank", "_lat", "_lon")


def assign_places(
    trips: DataFrame,
    places: DataFrame,
    box: Box,
    key: str,
    lat: str,
    lon: str,
    order: list[str],
    every_match: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Match trips to places one after the other, in ``order``; returns (assignments, new registry).

    One place in a trip's box: the trip gets it and the place counts one more. None: the trip opens
    a place with count 1, which later trips can match. Several: ambiguous, nothing is assigned -
    or, with ``every_match`` (the refresh rule), each of them counts one more.

    Assignments: (key, place_id, matches, outcome). Trips without a position are not matched.
    ``order`` must tell all trips apart.
    """
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    ranked = dense_ids(
        trips.filter(located).select(
            key, *[c for c in order if c != key], F.col(lat).alias("_lat"), F.col(lon).alias("_lon")
        ),
        order,
        "_rank",
    ).select(key, "_rank", "_lat", "_lon")
    known = _named_places(places)
    if every_match:  # many places in a box: counted, not paired
        near = durable(box_counts(ranked, places, box, "_lat", "_lon").withColumnsRenamed({"matches": "_known", "place_id": "_one_known"}))
        lonely = near.filter("_known = 0").select(*ranked.columns)
    else:
        lonely = box_join(ranked, known, box, "_lat", "_lon", "_plat", "_plon", "left_anti")
    leaders = place_leaders(lonely, box)
    top = places.agg(F.max("place_id")).first()[0] or 0
    opened = durable(dense_ids(leaders, ["_rank"], "place_id", start=int(top) + 1))
    candidates = opened.select(
        "place_id", F.col("_lat").alias("_plat"), F.col("_lon").alias("_plon"), F.col("_rank").cast("long").alias("_since")
    )
    if every_match:
        # a box holds few opened places: none of them lies in the box of an earlier one
        points = near
    else:
        candidates = known.select("place_id", "_plat", "_plon", F.lit(0).cast("long").alias("_since")).unionByName(candidates)
        points = ranked.withColumns({"_known": F.lit(0).cast("long"), "_one_known": F.lit(None).cast("long")})
    pairs = box_join(
        points, candidates, box, "_lat", "_lon", "_plat", "_plon", "left",
        condition=F.col("_since") < F.col("_rank"),
    )
    counted = pairs.groupBy(key, "_rank", "_known", "_one_known").agg(
        F.count("place_id").alias("_late"), F.min("place_id").alias("_one_late")
    ).select(
        key, "_rank", (F.col("_known") + F.col("_late")).alias("matches"), F.coalesce("_one_known", "_one_late").alias("_one")
    )
    fresh = opened.select("_rank", F.col("place_id").alias("_opened"))
    assignments = durable(
        counted.join(fresh, "_rank", "left").select(
            key,
            F.when(F.col("matches") == 1, F.col("_one")).when(F.col("matches") == 0, F.col("_opened")).alias("place_id"),
            "matches",
            F.when(F.col("matches") == 0, "new").when(F.col("matches") == 1, "matched").otherwise("ambiguous").alias("outcome"),
        )
    )
    if every_match:
        of_known = range_sums(
            places.select("place_id", "lat", "lon"),
            ranked.select(F.col("_lat").cast("double").alias("lat"), F.col("_lon").cast("double").alias("lon"), F.lit(1).cast("long").alias("_visits")),
            box, ["_visits"], box_of_data=True,
        ).select("place_id", "_visits").filter("_visits > 0")
        late = pairs.filter(F.col("place_id").isNotNull()).groupBy("place_id").agg(F.count(F.lit(1)).alias("_visits"))
        visits = of_known.unionByName(late)
    else:
        visits = assignments.filter(F.col("outcome") == "matched").groupBy("place_id").agg(F.count(F.lit(1)).alias("_visits"))
    added = opened.select(
        "place_id",
        F.col("_lat").alias("lat"),
        F.col("_lon").alias("lon"),
        F.lit(1).cast("long").alias("count"),
        F.lit(None).cast("string").alias("label"),
    )
    registry = (
        places.select("place_id", "lat", "lon", "count", "label")
        .unionByName(added)
        .join(visits, "place_id", "left")
        .withColumn("count", F.col("count") + F.coalesce("_visits", F.lit(0)))
        .drop("_visits")
    )
    return assignments, registry


def count_exact_positions(trips: DataFrame, places: DataFrame, lat: str, lon: str, order: str) -> DataFrame:
    """Registry after trips counted by exact position: known positions gain their visits, unknown
    ones become places, numbered by their first trip along ``order``."""
    visits = trips.groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(
        F.count(F.lit(1)).alias("_visits"), F.min(order).alias("_first")
    )
    known = places.join(visits.drop("_first"), ["lat", "lon"], "left").select(
        "place_id", "lat", "lon", (F.col("count") + F.coalesce("_visits", F.lit(0))).alias("count"), "label"
    )
    top = places.agg(F.max("place_id")).first()[0] or 0
    opened = dense_ids(visits.join(places, ["lat", "lon"], "left_anti"), ["_first"], "place_id", start=int(top) + 1)
    return known.unionByName(
        opened.select("place_id", "lat", "lon", F.col("_visits").alias("count"), F.lit(None).cast("string").alias("label"))
    )
