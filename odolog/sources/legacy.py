"""The old folder layout: one folder per trip with a log and a properties file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from odolog.functions.times import parse_time, trip_file_name
from odolog.session import durable
from odolog.sources import files as sources

# The layout of the folders and of the properties file.
PROPERTY_LINES = [6, 8]
DATE_LENGTHS = [28, 34]
FOLDER_LENGTH = 13
PROFILE, LOG = "profile.properties", "trackLog.csv"


def parse_profiles(profiles: DataFrame, text: str = "text") -> DataFrame:
    """Trip date from the text of properties files: line 2 without its leading ``#``.

    Files of another number of lines, or with a date of unknown format, get a null ``tripdate``.
    """
    lines = F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")
    stamp = F.substring(F.get("_lines", F.lit(1)), 2, 1000)
    return (
        profiles.withColumn("_lines", lines)
        .withColumn(
            "tripdate",
            F.when(F.size("_lines").isin(PROPERTY_LINES), parse_time(stamp, lengths=DATE_LENGTHS)),
        )
        .withColumn("csvfile", trip_file_name(F.col("tripdate")))
        .drop("_lines", text)
    )


def read_legacy_trips(spark: SparkSession, root: str) -> DataFrame:
    """(folder, directory, tripdate, csvfile, log_path, log_location, log_size, hand_over) for each trip folder below ``root``.

    A log belongs to the properties in the same ``directory``; ``folder`` is its last name, which several may have.
    ``csvfile`` is the name of the log in the present layout. ``hand_over`` is false when the date
    is unreadable, the log is missing, or an earlier directory already has that name. The folders are listed once.
    """
    directory = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    folder = F.regexp_extract("path", f"/([^/]{{{FOLDER_LENGTH}}})/[^/]+$", 1)
    listed = sources.list_files(spark, root, f"{{{PROFILE},{LOG}}}", 0, inclusive=True)
    listed = durable(listed.filter(folder != "").withColumn("directory", directory))  # both kinds from one listing
    texts = sources.texts_of(listed.filter(F.col("csvfile") == PROFILE))
    profiles = texts.select(directory.alias("directory"), "text")
    logs = listed.filter(F.col("csvfile") == LOG).select(
        "directory", F.col("path").alias("log_path"), F.col("location").alias("log_location"), F.col("size").alias("log_size")
    )
    trips = logs.join(parse_profiles(profiles), "directory", "full_outer")
    first = (
        trips.filter(F.col("csvfile").isNotNull() & F.col("log_path").isNotNull())
        .groupBy("csvfile")
        .agg(F.min("directory").alias("_first"))
    )
    return trips.join(first, "csvfile", "left").select(
        F.element_at(F.split("directory", "/"), -1).alias("folder"), "directory", "tripdate", "csvfile",
        "log_path", "log_location", "log_size",
        F.coalesce(F.col("directory") == F.col("_first"), F.lit(False)).alias("hand_over"),
    )
