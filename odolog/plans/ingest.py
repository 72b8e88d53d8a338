"""The load job: find new logs, gate them, store their rows, match their ends to places.

Files known to the store's manifest are not opened. New files are read twice as text. The first pass is narrow (times and positions);
its rows are written, and decide which files are accepted. The second parses all columns of accepted files and
writes them straight from the scan, so the wide rows are never shuffled: rows with a cell that is neither missing
nor a number go to the quarantine in the same pass. The report is stored with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from odolog.catalog import LOG_COLUMNS, TABLES
from odolog.functions.cells import clean_line
from odolog.functions.names import alias_name, canonical_name
from odolog.functions.times import parse_time
from odolog.operators import quality, registry
from odolog.operators.places import LIVE_BOX, Box, assign_places
from odolog.plans.store import TripStore, read_or_empty
from odolog.session import durable, stored
from odolog.sources import files as sources
from odolog.sources.legacy import read_legacy_trips
from odolog.sources.logs import layouts, parse_lines, read_log_rows, unknown_columns

BATCH_FILES = 50_000


@dataclass(frozen=True)
class LoadOptions:
    """What varies between the load commands."""

    pattern: str = "trackLog*.csv"
    min_size: int = sources.MIN_SIZE
    inclusive: bool = False
    limit: int | None = None
    missing: str = "null"
    bad_rows: str = "set_aside"  # rows with an unreadable cell; "keep" stores them with the cell missing
    device_zone: str = "UTC"
    use_aliases: bool = False
    box: Box = LIVE_BOX


def _of_files(lines: DataFrame, files: DataFrame, n_files: int, key: str = "path") -> DataFrame:
    """Lines with the columns of ``files`` (one row per file). Up to ``BATCH_FILES`` are broadcast, so lines are not shuffled; lines never are."""
    return lines.join(F.broadcast(files) if n_files <= BATCH_FILES else files.hint("merge"), key)


def narrow_rows(lines: DataFrame, batch: DataFrame, options: LoadOptions, broadcast: bool = False) -> DataFrame:
    """What the gates need of every line: (path, block_start, seq, marker, timed, gpstime, latitude, longitude)."""
    layout = layouts(batch.select("path", "header"), options.use_aliases)
    cells = ["gpstime", "latitude", "longitude"]
    raw = parse_lines(lines, layout, "path", ["block_start", "seq"], cells, broadcast=broadcast)
    return raw.select(
        "path", "block_start", "seq",
        quality.is_header_cell(F.col("gpstime")).alias("marker"),
        quality.has_value(F.col("gpstime")).alias("timed"),
        parse_time(F.col("gpstime"), options.device_zone).alias("gpstime"),
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
    )


def gate(rows: DataFrame, batch: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, summaries of accepted files, rejects) per path, from ``narrow_rows``.

    Gates in order: no timed row, repeated header in a gap over 60 s, longer than a day, start
    already registered (or, within the batch, taken by an earlier file name).
    """
    header = F.col("marker")
    counts = rows.groupBy("path").agg(
        F.count_if(~header).alias("rows"),
        F.count_if(~header & F.col("gpstime").isNull()).alias("dropped_rows"),
        F.greatest(F.count_if(header) - 1, F.lit(0)).alias("header_rows"),
    )
    timed = rows.filter("timed")
    data = timed.filter(~header & F.col("gpstime").isNotNull())
    summary = durable(
        quality.trip_summary(data, ["path"], ["seq"], "gpstime", "latitude", "longitude", block="block_start")
        .join(batch.select("path", "csvfile"), "path")
    )

    def reject(df: DataFrame, reason: str) -> DataFrame:
        return df.select("path", F.lit(reason).alias("reason"))

    empty = reject(batch.join(summary, "path", "left_anti"), "no data")
    broken = reject(
        quality.header_gate(timed, ["path"], F.col("block_start"), ["seq"], "gpstime", F.col("marker")), "header gap"
    )
    lengthy = reject(summary.filter(F.col("trip_duration") > quality.MAX_TRIP_S), "too long")
    gated = durable(empty.unionByName(broken).unionByName(lengthy))
    passed = summary.join(gated, "path", "left_anti")
    accepted = durable(registry.fresh_starts(passed, known.filter(F.col("trip_start").isNotNull()), "path"))
    known_start = reject(passed.join(accepted, "path", "left_anti"), "known start")
    return counts, accepted, gated.unionByName(known_start)


def _write_rows(store: TripStore, rows: DataFrame, version: int, options: LoadOptions) -> tuple[dict[str, str], dict, DataFrame]:
    """Write typed rows with their lines and ``bad_cells``, good and set aside ones apart, in one pass.

    Returns the folders written, the totals observed on the way, and bad rows and cells per trip."""
    aside = (F.col("bad_cells") > 0) if options.bad_rows == "set_aside" else F.lit(False)
    rows = rows.withColumn("aside", aside).withColumn("line", F.when(F.col("aside"), F.col("line")))
    totals = Observation("load")
    rows = rows.observe(
        totals, F.count(F.lit(1)).alias("rows"), F.count_if("aside").alias("set_aside"), F.coalesce(F.sum("bad_cells"), F.lit(0)).alias("bad_cells")
    )
    folder = store._folder("logs", version)
    rows.write.mode("overwrite").partitionBy("aside").parquet(f"{store.root}/{folder}")
    good, bad = f"{folder}/aside=false", f"{folder}/aside=true"
    folders = {"logs": good if store.has_data(good) else "", "quarantine": bad if store.has_data(bad) else ""}
    if folders["logs"]:
        store.stage_index(good, version)
    else:
        store.stage("logindex", store.spark.createDataFrame([], TABLES["logindex"]), version)
    counts = store.spark.createDataFrame([], "fileid long, bad_cells long, bad_rows long")
    if totals.get["bad_cells"]:
        # two narrow columns of what was just written
        written = store.spark.read.schema("fileid long, bad_cells long, aside boolean").parquet(f"{store.root}/{folder}")
        counts = durable(
            written.filter("bad_cells > 0").groupBy("fileid").agg(F.sum("bad_cells").alias("bad_cells"), F.count(F.lit(1)).alias("bad_rows"))
        )
    return folders, dict(totals.get), counts


def load_logs(store: TripStore, root: str, options: LoadOptions = LoadOptions()) -> DataFrame:
    """Load the new logs below ``root``; returns one report row per new file, as stored in ``loadreport``.

    A first load of millions of files runs best in batches (``limit`` up to ``BATCH_FILES``): the
    wide lines of such a batch are never shuffled. Loading the same files again changes nothing. Rejected files are not registered, so they are
    looked at again next time.

    A row with a cell that is neither missing nor a number is kept out of ``logs`` and, with its line, put into ``quarantine``
    (``bad_rows="keep"``: it is stored, the cell missing). ``status`` is ``success``, ``warning`` where a file has
    bad rows, ``error`` where it was rejected or has no other; header columns the catalog does not know are listed.
    """
    if options.bad_rows not in ("set_aside", "keep"):
        raise ValueError(f"unknown policy {options.bad_rows}")
    spark = store.spark
    version = store.version() + 1
    known = store.read("files")
    found = durable(
        sources.discover(spark, root, options.pattern, options.min_size, options.inclusive, manifest=store.read("manifest"))
    )
    tables = {}
    if not found.filter("fresh").isEmpty():
        store.stage("manifest", found.filter("fresh"), version)
        tables["manifest"] = False
    batch = registry.new_files(found, known, name="path")
    if options.limit:
        batch = batch.orderBy("path").limit(options.limit)
    batch = durable(batch)
    n_files = batch.count()
    report = [c for c in TABLES["loadreport"].names if c != "version"]
    if n_files == 0:
        if tables:
            store.commit(version, tables)
        return spark.createDataFrame([], TABLES["loadreport"]).select(report)
    lines = sources.lines_of(batch)
    # one small layout row per file: up to this many are broadcast, so that lines are not shuffled
    broadcast = n_files <= BATCH_FILES
    counts, accepted, rejects = gate(stored(narrow_rows(lines, batch, options, broadcast)), batch, known)
    fresh = durable(registry.with_new_ids(accepted.join(batch.select("path", "csvhash", "header"), "path"), known, ["path"]))

    rows = read_log_rows(
        lines,
        fresh.select("path", "header", "fileid"),
        "path",
        ["block_start", "seq", "line"],
        LOG_COLUMNS,
        options.device_zone,
        options.missing,
        options.use_aliases,
        carry=("fileid",),
        broadcast=broadcast,
        bad="bad_cells",
    )
    rows = rows.filter(F.col("gpstime").isNotNull()).drop("path")
    folders, metrics, bad = _write_rows(store, rows, version, options)
    sent = durable(store.staged("logindex", version).groupBy("fileid").agg(F.sum("rows").alias("sent_rows")))

    tables |= {"logs": False, "quarantine": False, "files": False}
    ends = fresh
    for kind, table in (("start", "startpos"), ("end", "endpos")):
        matched, places = assign_places(
            fresh, store.read(table), options.box, "fileid", f"{kind}lat", f"{kind}lon", ["trip_start", "path"]
        )
        store.stage(table, places, version)
        tables[table] = True
        ends = ends.join(matched.select("fileid", F.col("place_id").alias(f"{kind}id")), "fileid", "left")
    entries = (
        ends.drop("sent_rows")
        .join(sent, "fileid", "left")
        .withColumns(
            {
                "import_date": F.current_timestamp(),
                "startid": F.coalesce("startid", F.lit(0)),
                "endid": F.coalesce("endid", F.lit(0)),
                "sent_rows": F.coalesce("sent_rows", F.lit(0)),
            }
        )
    )
    store.stage("files", entries, version)
    of_path = fresh.select("path", "fileid")
    listed = quality.ingest_report(
        batch.select("path").join(counts, "path", "left").na.fill(0, ["rows", "dropped_rows", "header_rows"]),
        of_path.join(sent, "fileid").select("path", "sent_rows"), rejects, "path",
    )
    unknown = unknown_columns(batch.select("path", "header"), "path", LOG_COLUMNS, options.use_aliases)
    unknown = unknown.groupBy("path").agg(F.array_sort(F.collect_set("column")).alias("unknown_columns"))
    listed = (
        listed.join(of_path.join(bad, "fileid").select("path", "bad_rows", "bad_cells"), "path", "left")
        .join(unknown, "path", "left")
        .na.fill(0, ["bad_rows", "bad_cells"])
        .withColumns(
            {
                "version": F.lit(version),
                "unknown_columns": F.coalesce("unknown_columns", F.array().cast("array<string>")),
                "status": F.when(F.col("reason").isNotNull() | (F.col("sent_rows") == 0), "error")
                .when(F.col("bad_rows") > 0, "warning").otherwise("success"),
            }
        )
    )
    store.stage("loadreport", listed, version)
    tables["loadreport"] = False
    store.commit(version, tables, folders, metrics)
    return store.read("loadreport").filter(F.col("version") == version).select(report)


def repair_report(lines: DataFrame, key: str = "path", line: str = "line") -> DataFrame:
    """Per file: whether it can be repaired (one header) and how many lines the repair changes."""
    text = F.col(line)
    return (
        lines.groupBy(key)
        .agg(
            F.count_if(quality.is_header_line(text)).alias("header_lines"),
            F.count(F.lit(1)).alias("lines"),
            F.count_if(clean_line(text) != text).alias("changed_lines"),
        )
        .withColumn("damaged", F.col("header_lines") > 1)
        .withColumn("status", F.when(F.col("damaged"), "error").otherwise("ok"))
    )


def repaired_lines(
    lines: DataFrame, headers: DataFrame, report: DataFrame, n_files: int, key: str = "path", use_aliases: bool = False
) -> DataFrame:
    """Cleaned lines of the files ``report`` finds undamaged, with canonical headers: (key, block_start, seq, line).

    Written as a table with its source file in a column; inputs are never overwritten.
    """
    rule = alias_name if use_aliases else canonical_name
    fixed = F.array_join(F.transform(F.split("header", ","), lambda label: rule(label)), ",")
    whole = headers.join(report.filter("not damaged").select(key), key).select(key, F.rtrim("header").alias("_header"), fixed.alias("_fixed"))
    line = F.when(F.rtrim("line") == F.col("_header"), F.col("_fixed")).otherwise(clean_line(F.col("line")))
    return _of_files(lines, durable(whole), n_files, key).withColumn("line", line).select(key, "block_start", "seq", "line")


def _written(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Keys that an output of repaired or transferred lines already holds."""
    return read_or_empty(spark, out, f"{key} string").distinct()


def repair_logs(spark: SparkSession, root: str, out: str, pattern: str = "trackLog-*.csv") -> DataFrame:
    """Append the repaired lines of the logs below ``root`` to the Parquet folder ``out``.

    Files that ``out`` already holds are not opened, damaged files are only reported. The others are read twice, to decide and to
    write, straight from the scan: what is decided is one small row per file. Returns the
    report (path, header_lines, damaged, lines, changed_lines, status) of the files looked at.
    """
    done = _written(spark, out, "path")
    listed = sources.list_files(spark, root, pattern, 1, inclusive=True).select("path", "location", "size")
    files = durable(listed.join(done, "path", "left_anti"))
    n_files = files.count()
    lines = sources.lines_of(files)
    report = durable(repair_report(_of_files(lines, files.select("path"), n_files)))
    repaired_lines(lines, sources.first_lines(files), report, n_files).write.mode("append").parquet(out)
    return report


def transfer_legacy(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Append the logs of the old folder layout to the Parquet folder ``out`` under their new names.

    Rows are (csvfile, block_start, seq, line). Names that ``out`` already holds are skipped.
    Returns the trip folders with what became of them in ``status``.
    """
    done = _written(spark, out, "csvfile").withColumn("_done", F.lit(True))
    trips = durable(
        read_legacy_trips(spark, root)
        .join(done, "csvfile", "left")
        .withColumn(
            "status",
            F.when(F.col("tripdate").isNull(), "no date").when(F.col("log_path").isNull(), "no log")
            .when(F.col("_done") | ~F.col("hand_over"), "exists").otherwise("transferred"),
        )
        .select("folder", "directory", "tripdate", "csvfile", "log_path", "log_location", "log_size", "status")
    )
    moved = trips.filter(F.col("status") == "transferred")
    files = moved.select(F.col("log_path").alias("path"), F.col("log_location").alias("location"), F.col("log_size").alias("size"), "csvfile")
    lines = _of_files(sources.lines_of(files), files.select("path", "csvfile"), files.count())
    lines.select("csvfile", "block_start", "seq", "line").write.mode("append").parquet(out)
    return trips.drop("log_location", "log_size")
