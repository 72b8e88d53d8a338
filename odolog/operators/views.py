"""Column selections the front ends of a trip-log store ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from odolog.functions.cells import fill_missing


def file_list(files: DataFrame, key: str = "fileid", start: str = "trip_start", rows: str = "sent_rows") -> DataFrame:
    """Files with their start and size."""
    return files.select(key, start, rows)


def trip_rows(logs: DataFrame, key: str, trip=None) -> DataFrame:
    """All columns of one trip, or of every trip."""
    return logs if trip is None else logs.filter(F.col(key) == trip)


def track(logs: DataFrame, key: str, lat: str, lon: str, trip=None) -> DataFrame:
    """Positions of one trip (or all trips), missing ones as 0."""
    return fill_missing(trip_rows(logs, key, trip).select(key, lat, lon), [lat, lon])


def speed_series(logs: DataFrame, key: str, row_id: list[str], speeds: list[str], trip=None) -> DataFrame:
    """Row id and speeds of one trip (or all trips), missing speeds as 0."""
    return fill_missing(trip_rows(logs, key, trip).select(key, *row_id, *speeds), speeds)


def entries_per_file(files: DataFrame, key: str = "fileid", rows: str = "sent_rows") -> DataFrame:
    """Stored rows of each file."""
    return files.select(key, rows)


def start_stop_points(positions: DataFrame) -> DataFrame:
    """First and last positions of all trips."""
    return positions.select("latmin", "lonmin", "latmax", "lonmax")


def speeds_view(speeds: DataFrame, key: str, columns: list[str], time: str) -> DataFrame:
    """The speeds table."""
    return speeds.select(key, *columns, time)
