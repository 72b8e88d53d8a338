"""Row filters, gates on whole files, splitting and damage reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from odolog.functions.cells import NULL_MARKERS, is_bad_cell
from odolog.functions.names import canonical_name
from odolog.functions.times import seconds_between, trip_file_name
from odolog.operators.ordered import MarkerRuns

MAX_HEADER_GAP_S = 60
MAX_TRIP_S = 86_400
MAX_SPLIT_GAP_S = 900


def has_value(cell: Column) -> Column:
    """True where a raw cell is neither missing, blank nor a marker."""
    text = F.trim(cell)
    return F.coalesce((text != "") & ~text.isin(NULL_MARKERS), F.lit(False))


def rows_with_time(df: DataFrame, time: str = "gpstime") -> DataFrame:
    """Rows whose raw time cell holds something."""
    return df.filter(has_value(F.col(time)))


def dropped_time_counts(df: DataFrame, keys: list[str], time: str = "gpstime") -> DataFrame:
    """Per key: rows, and rows that ``rows_with_time`` drops."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~has_value(F.col(time))).alias("dropped_rows")
    )


def is_header_cell(cell: Column, name: str = "gpstime") -> Column:
    """True where a cell repeats the header label, in raw or canonical spelling."""
    return F.coalesce(canonical_name(cell) == name, F.lit(False))


def without_headers(df: DataFrame, time: str = "gpstime") -> DataFrame:
    """Rows that are not repeated headers."""
    return df.filter(~is_header_cell(F.col(time)))


def without_dash_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Lines that do not start with a dash."""
    return df.filter(~F.startswith(F.col(line), F.lit("-")))


def header_gate(
    df: DataFrame, keys: list[str], chunk: Column, order: list, time: str, marker: Column,
    max_gap: float = MAX_HEADER_GAP_S,
) -> DataFrame:
    """Keys rejected because a repeated header stands in a gap longer than ``max_gap`` seconds."""
    gaps = MarkerRuns(df, keys, chunk, order, time, marker).gaps()
    worst = gaps.groupBy(*keys).agg(F.max("gap_s").alias("max_gap_s"))
    return worst.filter(F.col("max_gap_s") > max_gap)


def first_and_last(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], block: str | None = None
) -> DataFrame:
    """Per key: ``first_<c>`` / ``last_<c>`` in row order, and the number of rows.

    One map-side combined aggregate. A single order column keeps it a hash aggregate; several are
    compared as a struct. ``block`` names a coarser order column in front of ``order`` that takes
    few values per key (the block of a file): ends are then found per block, and across blocks.
    """
    out = df.select(
        *keys,
        *([block] if block else []),
        *order,
        F.lit(1).cast("long").alias("rows"),
        *[F.col(c).alias(f"{side}_{c}") for c in columns for side in ("first", "last")],
    )
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    steps = [(keys, by)] if block is None else [([*keys, block], by), (keys, F.col(block))]
    for group, position in steps:
        picks = [F.min_by(f"first_{c}", position).alias(f"first_{c}") for c in columns]
        picks += [F.max_by(f"last_{c}", position).alias(f"last_{c}") for c in columns]
        out = out.groupBy(*group).agg(F.sum("rows").alias("rows"), *picks)
    return out


def too_long(
    df: DataFrame, keys: list[str], order: list[str], time: str,
    max_seconds: float = MAX_TRIP_S, block: str | None = None,
) -> DataFrame:
    """Keys whose last row is more than ``max_seconds`` after their first row."""
    ends = first_and_last(df, keys, order, [time], block)
    duration = seconds_between(F.col(f"first_{time}").cast("timestamp"), F.col(f"last_{time}").cast("timestamp"))
    return ends.select(*keys, duration.alias("duration_s")).filter(F.col("duration_s") > max_seconds)


def split_trips(
    df: DataFrame, keys: list[str], chunk: Column, order: list, time: str, marker: Column,
    max_gap: float = MAX_SPLIT_GAP_S, mode: str = "each",
) -> DataFrame:
    """Rows without repeated headers, with the segment of the key they belong to."""
    return MarkerRuns(df, keys, chunk, order, time, marker).segments(max_gap, mode)


def segment_names(segmented: DataFrame, keys: list[str], time: str, segment: str = "segment") -> DataFrame:
    """Per (key, segment): rows, start, and the name of the file a split-off part would get."""
    out = segmented.groupBy(*keys, segment).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.col(time).cast("timestamp")).alias("segment_start")
    )
    name = F.when(F.col(segment) > 0, trip_file_name(F.col("segment_start"), split=True))
    return out.withColumn("file_name", name)


def trip_summary(
    df: DataFrame, keys: list[str], order: list[str], time: str, lat: str, lon: str,
    block: str | None = None,
) -> DataFrame:
    """Per trip: start, end, duration, first and last position in row order, rows."""
    ends = first_and_last(df, keys, order, [time, lat, lon], block)
    start, end = F.col(f"first_{time}").cast("timestamp"), F.col(f"last_{time}").cast("timestamp")
    return ends.select(
        *keys,
        start.alias("trip_start"),
        end.alias("trip_end"),
        seconds_between(start, end).alias("trip_duration"),
        F.col(f"first_{lat}").alias("startlat"),
        F.col(f"first_{lon}").alias("startlon"),
        F.col(f"last_{lat}").alias("endlat"),
        F.col(f"last_{lon}").alias("endlon"),
        F.col("rows").alias("sent_rows"),
    )


def is_header_line(line: Column) -> Column:
    """True where the first four characters of a line hold ``gps``."""
    return F.contains(F.lower(F.substring(line, 1, 4)), F.lit("gps"))


def header_line_counts(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Per file: header lines; more than one means damaged."""
    return (
        lines.groupBy(*keys)
        .agg(F.count_if(is_header_line(F.col(line))).alias("header_lines"))
        .withColumn("damaged", F.col("header_lines") > 1)
    )


def parse_audit(df: DataFrame, keys: list[str], columns: list[str], fields: str | None = None, width: str | None = None) -> DataFrame:
    """Per file: rows, unreadable cells and rows of the wrong width; files with either are flagged.

    ``columns`` are raw text columns; ``fields`` / ``width`` name the columns with a row's number
    of fields and the number its header announces.
    """
    bad = reduce(lambda a, b: a + b, [is_bad_cell(F.col(c)).cast("long") for c in columns], F.lit(0))
    ragged = F.lit(False) if fields is None else F.col(fields) != F.col(width)
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(bad).alias("bad_cells"),
            F.count_if(ragged).alias("ragged_rows"),
        )
        .withColumn("has_errors", (F.col("bad_cells") > 0) | (F.col("ragged_rows") > 0))
    )


def quarantine(df: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(good rows, bad rows, status per key) for raw text columns that must hold numbers.

    Rows with an unreadable cell would be refused by a typed table; they are set aside before the
    write instead. Status: ``success`` all rows good, ``warning`` some, ``error`` none.
    """
    bad = reduce(lambda a, b: a | b, [is_bad_cell(F.col(c)) for c in columns])
    status = df.groupBy(*keys).agg(
        F.count_if(~bad).alias("good_rows"), F.count_if(bad).alias("bad_rows")
    )
    label = (
        F.when(F.col("bad_rows") == 0, "success").when(F.col("good_rows") > 0, "warning").otherwise("error")
    )
    return df.filter(~bad), df.filter(bad), status.withColumn("status", label)


def ingest_report(
    counts: DataFrame, sent: DataFrame, rejects: DataFrame, key: str
) -> DataFrame:
    """One row per file: read and dropped rows, why it was rejected, rows stored.

    ``counts``: key, rows, dropped_rows, header_rows. ``sent``: key, sent_rows. ``rejects``: key,
    reason (one row per reason; the alphabetically first is reported, with the number of reasons).
    """
    why = rejects.groupBy(key).agg(F.min("reason").alias("reason"), F.count(F.lit(1)).alias("reasons"))
    return (
        counts.join(why, key, "left")
        .join(sent, key, "left")
        .select(
            key,
            "rows",
            "dropped_rows",
            "header_rows",
            "reason",
            F.coalesce("reasons", F.lit(0)).alias("reasons"),
            F.coalesce("sent_rows", F.lit(0)).alias("sent_rows"),
        )
    )
