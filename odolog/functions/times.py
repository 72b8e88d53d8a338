"""Times in logs: parsing by text length, durations, names made from times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Text length -> pattern of the times without a zone.
NAIVE_PATTERNS = {
    20: "dd-MMM-yyyy HH:mm:ss",
    24: "dd-MMM-yyyy HH:mm:ss.SSS",
    26: "yyyy-MM-dd HH:mm:ss.SSSSSS",
}

# Text length -> pattern of the times with a zone. The leading day name ("Wed ") is
# cut off first, it carries no information and Spark does not parse it. Zone names in texts of 30 have
# five letters; no text of 36 characters fits its pattern, so these become null.
ZONED_PATTERNS = {
    28: "MMM dd HH:mm:ss 'GMT' yyyy",
    30: "MMM dd HH:mm:ss z yyyy",
    34: "MMM dd HH:mm:ss 'GMT'XXX yyyy",
    36: "MMM dd HH:mm:ss 'GMT'XXX yyyy",
}

# Lengths the two time columns of a log are written in.
DEVICE_LENGTHS = [20, 24, 26, 28]
GPS_LENGTHS = [26, 28, 34]


def parse_time(text: Column, device_zone: str = "UTC", lengths: list[int] | None = None) -> Column:
    """Timestamp (UTC) of a log time; texts of no known format become null.

    Times without a zone are local times of the device, in ``device_zone``.
    """
    wanted = set(lengths or [*NAIVE_PATTERNS, *ZONED_PATTERNS])
    text = F.trim(text)
    size = F.length(text)
    branches = []
    for length, pattern in NAIVE_PATTERNS.items():
        if length in wanted:
            parsed = F.try_to_timestamp(text, F.lit(pattern))
            if device_zone != "UTC":
                parsed = F.to_utc_timestamp(parsed, device_zone)
            branches.append(F.when(size == length, parsed))
    for length, pattern in ZONED_PATTERNS.items():
        if length in wanted:
            dayless = F.substring(text, 5, length)
            branches.append(F.when(size == length, F.try_to_timestamp(dayless, F.lit(pattern))))
    return F.coalesce(*branches)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, with microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def trip_file_name(time: Column, split: bool = False) -> Column:
    """File name of a trip that starts at ``time``; split-off parts carry minutes only."""
    if split:
        return F.concat(F.lit("trackLog-split-"), F.date_format(time, "yyyy-MMM-dd_HH-mm"), F.lit(".csv"))
    return F.concat(F.lit("trackLog-"), F.date_format(time, "yyyy-MMM-dd_HH-mm-ss"), F.lit(".csv"))


def base_name(path: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(path, "/"), -1)
