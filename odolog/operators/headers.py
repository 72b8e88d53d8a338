"""Inventory of column headers and odd characters over many files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from odolog.functions.names import canonical_name


def header_columns(headers: DataFrame, file: str = "file", header: str = "header") -> DataFrame:
    """One row per (file, position): raw label and canonical column name."""
    return headers.select(file, F.posexplode(F.split(header, ",")).alias("position", "label")).select(
        file, "position", "label", canonical_name(F.col("label")).alias("column")
    )


def good_columns(columns: DataFrame) -> DataFrame:
    """Header columns whose name is neither empty nor starts with a digit."""
    return columns.filter(F.col("column").rlike("^[^0-9]"))


def header_frequency(columns: DataFrame, file: str = "file") -> DataFrame:
    """Per column: in how many headers it stands and, when that is one, in which file.

    Which files hold a column is the long relation (column, file) itself; gathering every file name
    of a common column into one row would not fit a task.
    """
    return (
        good_columns(columns)
        .groupBy("column")
        .agg(F.count(F.lit(1)).alias("count"), F.min(file).alias("_file"))
        .select("column", "count", F.when(F.col("count") == 1, F.col("_file")).alias("sole_file"))
    )


def column_files(columns: DataFrame, file: str = "file") -> DataFrame:
    """Long relation (column, file) of good columns."""
    return good_columns(columns).select("column", file)


def columns_by_count(frequency: DataFrame) -> DataFrame:
    """Columns with the most files first; ties by name."""
    return frequency.orderBy(F.desc("count"), "column")


def header_sizes(headers: DataFrame, file: str = "file", header: str = "header") -> DataFrame:
    """Per file: number of header columns and length of the canonical header line."""
    names = F.transform(F.split(header, ","), canonical_name)
    return headers.select(
        file, F.size(names).alias("colcount"), F.length(F.array_join(names, ",")).alias("chars")
    )


def average_header(sizes: DataFrame) -> DataFrame:
    """One row: average columns and characters per file."""
    return sizes.agg(F.avg("colcount").alias("avg_columns"), F.avg("chars").alias("avg_chars"))


def distinct_headers(columns: DataFrame) -> DataFrame:
    """Every label that stands in some header."""
    return columns.select("label").distinct()


def non_ascii_runs(lines: DataFrame, keys: list[str], text: str = "line", every_run: bool = False) -> DataFrame:
    """Distinct runs of non-ASCII characters per file, with how often they occur.

    The first run of each comma-separated field, or every run with ``every_run``.
    """
    pattern = F.lit(r"[^\x00-\x7F]+")
    fields = lines.select(*keys, F.explode(F.split(text, ",")).alias("_field"))
    if every_run:
        runs = fields.select(*keys, F.explode(F.regexp_extract_all("_field", pattern, F.lit(0))).alias("run"))
    else:
        runs = fields.select(*keys, F.regexp_extract("_field", r"[^\x00-\x7F]+", 0).alias("run"))
    return runs.filter(F.col("run") != "").groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("fields"))
