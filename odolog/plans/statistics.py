"""The statistics jobs over a store; each is a full refresh of its table from one scan of the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from odolog.catalog import CORE_SENSORS, SPEED_COLUMNS, SUMMARY_SENSORS
from odolog.operators import stats
from odolog.operators.places import REFRESH_BOX, assign_places
from odolog.plans.store import TripStore


def refresh_speeds(store: TripStore, limit: int | None = None) -> None:
    """Table ``speeds``."""
    store.replace("speeds", stats.trip_speeds(store.read("logs"), "fileid", SPEED_COLUMNS, "gpstime", limit))


def refresh_column_stats(store: TripStore) -> None:
    """Table ``columnstats``."""
    store.replace("columnstats", stats.column_stats(store.read("logs"), CORE_SENSORS))


def refresh_file_stats(store: TripStore) -> None:
    """Table ``filestats``."""
    store.replace("filestats", stats.file_stats(store.read("logs"), "fileid", CORE_SENSORS))


def refresh_start_places(store: TripStore) -> DataFrame:
    """Count every trip's start at all start places in its (wide) box, new places where there is none.

    Returns the first and last positions of all trips.
    """
    ends = stats.start_end_positions(store.read("logs"), "fileid", "gpstime", "latitude", "longitude")
    _, places = assign_places(
        ends, store.read("startpos"), REFRESH_BOX, "fileid", "latmin", "lonmin", ["fileid"], every_match=True
    )
    store.replace("startpos", places)
    return ends


def refresh_all(store: TripStore) -> None:
    """All statistics, in order."""
    refresh_speeds(store)
    refresh_start_places(store)
    refresh_column_stats(store)
    refresh_file_stats(store)


def all_trip_statistics(store: TripStore) -> DataFrame:
    """Statistics of every trip, in one plan."""
    return stats.trip_statistics(store.read("logs"), "fileid")


def trip_report(store: TripStore) -> DataFrame:
    """Min / max / avg of the report columns for every trip."""
    return stats.trip_min_max_avg(store.read("logs"), "fileid", SUMMARY_SENSORS)


def store_counts(store: TripStore) -> DataFrame:
    """Trips, files and log rows in the store."""
    return stats.table_counts(store.read("trips"), store.read("files"), store.read("logs"))
