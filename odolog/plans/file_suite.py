"""Queries of the file sources, the store and the repair job.

Trip logs are rendered from ``events``, one file per user, into a new folder below the shared checkpoint
folder and read back by the operators themselves; stores are written there and read again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from odolog.operators import stats, views
from odolog.plans import ingest, statistics
from odolog.plans.store import TripStore
from odolog.plans.suite import LOG_VALUES, LOGS, ORACLES, QUERIES, SPEEDS, SPEEDS_SQL, events, logs, query, with_rounded
from odolog.session import shared_folder
from odolog.sources import files as sources, legacy

__all__ = ["ORACLES", "QUERIES"]

HEADER = "GPS Time, Longitude, Latitude,CO₂ in g/km (Average)(g/km),Speed (OBD)(km/h)"

RENDERED = f"""rendered as (select user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ',' || printf('%.2f', value) || ','
  || printf('%.2f', value * 2) || ',-,' || case when event_type = 'error' then '∞' else printf('%.2f', value) end as line from events),
lines as (select user_id, event_id, line from rendered
  union all select distinct user_id, -1, '{HEADER}' from events)"""
CONTENTS = f"""with {RENDERED}, contents as (select user_id, string_agg(line || chr(10), '' order by event_id) as content from lines group by user_id)
select user_id, strlen(content) as size, md5(content) as csvhash, '{HEADER}' as header from contents"""


def write_files(rows: DataFrame) -> str:
    """Writes a file per ``name`` (a path below a new folder), its ``line``s in order of ``at``; returns the folder.

    Spark's writer takes about 16 ms for a file in a folder of its own."""
    root = re.sub("^file:/+", "file:///", shared_folder(rows.sparkSession))

    def write(batches):
        """Rows come sorted by name: one file is open at a time."""
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(root)
        name, file = None, None
        for rows in batches:
            for part, lines in rows.groupby("name", sort=False)["line"]:
                if part != name:
                    if file is not None:
                        file.close()
                    store.create_dir((base + part).rsplit("/", 1)[0])
                    name, file = part, store.open_output_stream(base + part)
                file.write("".join(f"{x}\n" for x in lines).encode())
        if file is not None:
            file.close()
        yield from ()

    rows.repartition("name").sortWithinPartitions("name", "at").mapInPandas(write, "name string").count()
    return root


def write_logs(rows: DataFrame, header: str) -> str:
    """Writes a log per ``user_id``, with its header; returns the folder."""
    heads = rows.select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit(header).alias("line"))
    name = F.format_string("/user=%d/part-00000.txt", F.col("user_id"))
    return write_files(rows.unionByName(heads).select(name.alias("name"), F.col("event_id").alias("at"), "line"))


def render_logs(spark: SparkSession, d: str) -> str:
    """Writes a log per user; returns the folder."""
    number = lambda c: F.format_string("%.2f", c)
    ev = events(spark, d)
    speed = F.when(F.col("event_type") == "error", "∞").otherwise(number(F.col("value")))
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = F.concat_ws(",", time, number(F.col("value")), number(F.col("value") * 2), F.lit("-"), speed)
    return write_logs(ev.select("user_id", "event_id", line.alias("line")), HEADER)


def user_of(path: str) -> Column:
    return F.regexp_extract(path, r"/user=(\d+)/", 1).cast("long").alias("user_id")


@query("found_log_files", CONTENTS + " where strlen(content) > 4000")
def _(spark, d):
    found = sources.discover(spark, render_logs(spark, d), "part-*", min_size=4000)
    return found.select(user_of("path"), "size", "csvhash", "header")


@query("found_csv_files", CONTENTS)
def _(spark, d):
    found = sources.discover(spark, render_logs(spark, d), "part-*", min_size=1, inclusive=True)
    return found.select(user_of("path"), "size", "csvhash", "header")


@query("file_lines", f"with {RENDERED} select user_id, line from lines")
def _(spark, d):
    return sources.read_lines(spark, render_logs(spark, d), "part-*").select(user_of("path"), "line")


@query("file_headers", f"select distinct user_id, '{HEADER}' as header from events")
def _(spark, d):
    return sources.read_headers(spark, render_logs(spark, d), "part-*").select(user_of("path"), "header")


@query(
    "repaired_logs",
    f"""with {RENDERED} select user_id, case when event_id < 0 then 'gpstime,longitude,latitude,coingkmaveragegkm,speedobdkmh'
  else replace(replace(line, ',-,', ',0,'), '∞', '0') end as line from lines""",
)
def _(spark, d):
    out = shared_folder(spark)
    ingest.repair_logs(spark, render_logs(spark, d), out, "part-*")
    return spark.read.parquet(out).select(user_of("path"), "line")


# -- the old folder layout: a folder per user below one of two roots, so that two have each name ------

LEGACY = """firsts as (select user_id, min(ts) as first_ts from events group by user_id),
trips as (select user_id, case when user_id % 2 = 0 then 'a' else 'b' end as root, printf('%013d', user_id // 2) as folder, user_id % 11 <> 0 as has_log,
  case when user_id % 7 = 0 then null when user_id % 10 = 1 then timestamp '2024-01-01' else date_trunc('second', first_ts) end as t from firsts),
named as (select *, case when t is not null then 'trackLog-' || strftime(t, '%Y-%b-%d_%H-%M-%S') || '.csv' end as csvfile from trips),
ranked as (select *, row_number() over (partition by csvfile, has_log order by root, folder) = 1 and has_log and t is not null as hand_over from named)"""


def render_legacy(spark: SparkSession, d: str) -> str:
    """Writes ``<root>/<folder>/trackLog.csv`` and ``profile.properties``; returns the folder above the roots."""
    ev = events(spark, d).select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    user = F.col("user_id")
    folder = F.concat(F.when(user % 2 == 0, "/a/").otherwise("/b/"), F.lpad(F.floor(user / 2).cast("string"), 13, "0"))
    line = F.concat_ws(",", "event_id", F.format_string("%.2f", "value"))
    log_lines = ev.filter(user % 11 != 0).select(F.concat(folder, F.lit("/trackLog.csv")).alias("name"), F.col("event_id").alias("at"), line.alias("line"))
    first = F.when(user % 10 == 1, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(F.col("first"))
    stamp = F.when(user % 7 == 0, "yesterday").otherwise(F.date_format(first, "EEE MMM dd HH:mm:ss 'GMT' yyyy"))
    text = F.array(F.lit("#profile"), F.concat(F.lit("#"), stamp), F.lit("name=x"), F.lit("fuel=1"), F.lit("cost=2"), F.lit("time=3"))
    heads = ev.groupBy("user_id").agg(F.min("ts").alias("first")).select(
        F.concat(folder, F.lit("/profile.properties")).alias("name"), F.posexplode(text).alias("at", "line")
    )

    return write_files(log_lines.unionByName(heads.withColumn("at", F.col("at").cast("long"))))


@query("legacy_trips", f"with {LEGACY} select root || '/' || folder as directory, folder, epoch_us(t) as tripdate, csvfile, has_log, hand_over from ranked")
def _(spark, d):
    trips = legacy.read_legacy_trips(spark, render_legacy(spark, d))
    return trips.select(
        F.substring_index("directory", "/", -2).alias("directory"), "folder", F.unix_micros("tripdate").alias("tripdate"), "csvfile",
        F.col("log_path").isNotNull().alias("has_log"), "hand_over",
    )


@query(
    "transferred_trips",
    f"""with {LEGACY} select root || '/' || folder as directory, csvfile,
  case when t is null then 'no date' when not has_log then 'no log' when not hand_over then 'exists' else 'transferred' end as status from ranked""",
)
def _(spark, d):
    trips = ingest.transfer_legacy(spark, render_legacy(spark, d), shared_folder(spark))
    return trips.select(F.substring_index("directory", "/", -2).alias("directory"), "csvfile", "status")


@query(
    "transferred_lines",
    f"""with {LEGACY} select csvfile, event_id || ',' || printf('%.2f', value) as line from ranked join events using (user_id) where hand_over""",
)
def _(spark, d):
    out = shared_folder(spark)
    ingest.transfer_legacy(spark, render_legacy(spark, d), out)
    return spark.read.parquet(out).select("csvfile", "line")


def filled_store(spark: SparkSession, d: str) -> TripStore:
    """A store with the log rows, appended in two commits."""
    store = TripStore(spark, shared_folder(spark))
    rows = logs(spark, d)
    store.append("logs", rows.filter("fileid % 2 = 0"))
    store.append("logs", rows.filter("fileid % 2 = 1"))
    return store


@query("stored_rows", f"with {LOGS} select fileid, count(*) as sent_rows from logs group by fileid")
def _(spark, d):
    return stats.rows_per_file(filled_store(spark, d).read("logs"), "fileid")


@query("stored_speeds", SPEEDS_SQL)
def _(spark, d):
    store = filled_store(spark, d)
    statistics.refresh_speeds(store)
    return with_rounded(store.read("speeds"), *SPEEDS).withColumn("gpstime", F.unix_micros("gpstime"))


@query("stored_column_stats", ORACLES["column_stats"])
def _(spark, d):
    store = filled_store(spark, d)
    statistics.refresh_column_stats(store)
    return store.read("columnstats").filter(F.col("column_name").isin(LOG_VALUES))


@query("stored_file_stats", ORACLES["file_stats"])
def _(spark, d):
    store = filled_store(spark, d)
    statistics.refresh_file_stats(store)
    return store.read("filestats").filter(F.col("column").isin(LOG_VALUES))


@query(
    "reset_store",
    f"with {LOGS} select 'before' as state, count(*) as rows, count(distinct fileid) as files from logs union all select 'after', 0, 0",
)
def _(spark, d):
    store = filled_store(spark, d)
    before = store.read("logs")
    store.reset(confirm=True)
    counts = [F.count(F.lit(1)).alias("rows"), F.count_distinct("fileid").alias("files")]
    return before.agg(*counts).select(F.lit("before").alias("state"), "rows", "files").unionByName(
        store.read("logs").agg(*counts).select(F.lit("after").alias("state"), "rows", "files")
    )


@query("compacted_rows", f"with {LOGS} select fileid, count(*) as sent_rows from logs group by fileid")
def _(spark, d):
    store = filled_store(spark, d)
    store.compact_logs(rows_per_file=5000)
    return stats.rows_per_file(store.read("logs"), "fileid")


ONE_TRIP = "where fileid = 3"


@query(
    "trip_of_store",
    f"with {LOGS} select fileid, {', '.join(LOG_VALUES)}, epoch_us(gpstime) as row_time from logs {ONE_TRIP}",
)
def _(spark, d):
    store = filled_store(spark, d)
    store.compact_logs(rows_per_file=5000)
    return store.read_trip(3).select("fileid", *LOG_VALUES, F.unix_micros("gpstime").alias("row_time"))


# -- the load job: a trip per user, its month in a day ----------------------------------------------

LOAD_HEADER = "GPS Time, Longitude, Latitude,Speed (OBD)(km/h),Strange Gauge(x)"
DAY_US = 86_400_000_000
LOADED = f"""trips as (select user_id, event_id, event_type, value,
    user_id * {DAY_US} + (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 40 as us from events),
cells as (select *, event_id % 17 = 0 as bad, printf('%.2f', value)::double as v, printf('%.2f', value * 2)::double as v2 from trips)"""


def loaded_store(spark: SparkSession, d: str) -> tuple[TripStore, DataFrame]:
    """A store after a load of one log per user, and the load's report. Some rows have a cell that is no number."""
    number = lambda c: F.format_string("%.2f", c)
    ev = events(spark, d)
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    us = F.col("user_id") * DAY_US + F.expr("(at - base) div 40")
    ev = ev.withColumns({"at": F.unix_micros(F.col("ts").cast("timestamp")), "base": base}).withColumn("us", us)
    time = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    speed = F.when(F.col("event_id") % 17 == 0, "n/a").when(F.col("event_type") == "error", "∞").otherwise(number(F.col("value")))
    line = F.concat_ws(",", time, number(F.col("value")), number(F.col("value") * 2), speed, F.lit("7"))
    root = write_logs(ev.select("user_id", "event_id", line.alias("line")), LOAD_HEADER)
    store = TripStore(spark, shared_folder(spark))
    report = ingest.load_logs(store, root, ingest.LoadOptions(pattern="part-*", min_size=1, inclusive=True))
    return store, report


@query(
    "load_report",
    f"""with {LOADED} select user_id, count(*) as rows, 0 as dropped_rows, 0 as header_rows, null as reason, 0 as reasons,
  count(*) filter (not bad) as sent_rows, count(*) filter (bad) as bad_rows, count(*) filter (bad) as bad_cells,
  'strangegaugex' as unknown, case when count(*) filter (bad) = 0 then 'success' when count(*) filter (not bad) > 0 then 'warning' else 'error' end as status
from cells group by user_id""",
)
def _(spark, d):
    _, report = loaded_store(spark, d)
    counts = ["rows", "dropped_rows", "header_rows", "reason", "reasons", "sent_rows", "bad_rows", "bad_cells", "status"]
    return report.select(user_of("path"), *counts, F.array_join("unknown_columns", ",").alias("unknown"))


@query(
    "loaded_rows",
    f"""with {LOADED} select us as row_time, v as longitude, v2 as latitude, case when event_type <> 'error' then v end as speedobdkmh
from cells where not bad""",
)
def _(spark, d):
    logs_ = loaded_store(spark, d)[0].read("logs")
    return logs_.select(F.unix_micros("gpstime").alias("row_time"), "longitude", "latitude", "speedobdkmh")


@query(
    "loaded_files",
    f"""with {LOADED}, ends as (select user_id, first(us order by event_id) as s, last(us order by event_id) as e, count(*) filter (not bad) as sent_rows
  from cells group by user_id) select user_id, s as trip_start, e as trip_end, (e - s) / 1e6 as trip_duration, sent_rows from ends""",
)
def _(spark, d):
    files = loaded_store(spark, d)[0].read("files")
    start = F.unix_micros("trip_start")
    return files.select(
        F.floor(start / DAY_US).cast("long").alias("user_id"), start.alias("trip_start"), F.unix_micros("trip_end").alias("trip_end"),
        "trip_duration", "sent_rows",
    )


@query(
    "quarantined_lines",
    f"""with {LOADED} select strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f') || ',' || printf('%.2f', value) || ',' || printf('%.2f', value * 2)
  || ',n/a,7' as line, 1 as bad_cells from cells where bad""",
)
def _(spark, d):
    return loaded_store(spark, d)[0].read("quarantine").select("line", "bad_cells")


@query("rows_of_trip", f"with {LOGS} select * exclude (gpstime), epoch_us(gpstime) as gpstime from logs {ONE_TRIP}")
def _(spark, d):
    return views.trip_rows(logs(spark, d), "fileid", 3).withColumn("gpstime", F.unix_micros("gpstime"))


@query("track_of_trip", f"with {LOGS} select fileid, coalesce(latitude, 0) as latitude, coalesce(longitude, 0) as longitude from logs {ONE_TRIP}")
def _(spark, d):
    return views.track(logs(spark, d), "fileid", "latitude", "longitude", trip=3)


@query(
    "speeds_of_trip",
    f"with {LOGS} select fileid, epoch_us(gpstime) as row_time, "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in SPEEDS) + f" from logs {ONE_TRIP}",
)
def _(spark, d):
    df = logs(spark, d).withColumn("row_time", F.unix_micros("gpstime"))
    return views.speed_series(df, "fileid", ["row_time"], SPEEDS, trip=3)
