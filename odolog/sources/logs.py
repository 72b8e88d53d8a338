"""From raw lines to typed log rows.

Columns are found by name: each file's header decides where a canonical column stands. The header
of a file becomes an array of positions, joined to its lines, so files of any layout are parsed in
one pass without a loop over layouts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from odolog.catalog import LOG_COLUMNS, TIME_COLUMNS
from odolog.functions.cells import NULL_MARKERS, fill_missing
from odolog.functions.names import alias_name, canonical_name
from odolog.functions.times import parse_time
from odolog.operators.quality import is_header_cell


def _names(header: Column, use_aliases: bool) -> Column:
    """Column names of a header. Aliases never lead out of the catalog, so that no value is lost."""
    if not use_aliases:
        return F.transform(F.split(header, ","), canonical_name)
    return F.transform(F.split(header, ","), lambda label: alias_name(label, known=LOG_COLUMNS))


def layouts(headers: DataFrame, use_aliases: bool = False) -> DataFrame:
    """``headers`` with ``names`` (canonical header names) instead of ``header``."""
    return headers.withColumn("names", _names(F.col("header"), use_aliases)).drop("header")


def unknown_columns(headers: DataFrame, file: str = "csvfile", columns: list[str] | None = None, use_aliases: bool = False) -> DataFrame:
    """(file, column) of header columns the catalog does not know; they are not loaded."""
    known = [F.lit(c) for c in (columns or LOG_COLUMNS)]
    named = headers.select(file, F.explode(_names(F.col("header"), use_aliases)).alias("column"))
    return named.filter(~F.array_contains(F.array(*known), F.col("column")) & (F.col("column") != ""))


def column_repeats(layout: DataFrame, columns: list[str]) -> dict[str, int]:
    """Which of ``columns`` some file has, and most columns of one file that share the name. At most a row per column, from the distinct layouts."""
    named = layout.select("names").distinct().select("names", F.explode(F.array_distinct("names")).alias("_name"))
    shared = F.size(F.filter("names", lambda x: x == F.col("_name")))
    return dict(map(tuple, named.filter(F.col("_name").isin(columns)).groupBy("_name").agg(F.max(shared)).collect()))


def _positions(columns: list[str], nth: int) -> Column:
    """For each column the index of its nth place in ``names``; -1 when it has none."""
    wanted = F.array(*[F.lit(c) for c in columns])
    places = F.sequence(F.lit(0), F.size("names") - 1)

    def place(column: Column) -> Column:
        return F.coalesce(F.get(F.filter(places, lambda i: F.get("names", i) == column), nth), F.lit(-1))

    return F.transform(wanted, place)


def parse_lines(
    lines: DataFrame,
    layout: DataFrame,
    file: str,
    keep: list[str],
    columns: list[str] | None = None,
    line: str = "line",
    carry: tuple[str, ...] = (),
    broadcast: bool = False,
) -> DataFrame:
    """Raw text cells of each line by canonical column: (file, keep.., one text column each).

    Missing columns are null (those that no file has are not looked for in the lines), short lines are padded with null, extra fields are cut. When several
    header columns share a canonical name the first one that holds a value counts. ``fields`` and
    ``width`` give the number of fields of the line and of its header. ``carry`` names columns of
    ``layout`` to add. With ``broadcast`` (for a layout table of checked size) lines are not shuffled.
    """
    columns = columns or LOG_COLUMNS
    repeats = column_repeats(layout, columns)
    places = layout.select(
        file,
        *carry,
        F.size("names").alias("width"),
        *[_positions(columns, n).alias(f"_at{n}") for n in range(max(repeats.values(), default=1))],
    )
    # Spark takes lines that tasks read to be as small as the table of their files, and would broadcast them
    cells = lines.join(F.broadcast(places) if broadcast else places.hint("merge"), file).withColumn("_cells", F.split(line, ","))

    # SQL text, as a hundred columns of nested Column objects would take seconds to build
    def cell(i: int, column: str) -> str:
        if column not in repeats:
            return "cast(null as string)"
        texts = [f"trim(get(_cells, get(_at{n}, {i})))" for n in range(repeats[column])]
        if len(texts) == 1:
            return texts[0]
        values = [f"nullif({_no_marker(t)}, '')" for t in texts]
        return f"coalesce({', '.join(values)}, {texts[0]})"

    return cells.select(
        file,
        *keep,
        *carry,
        F.size("_cells").alias("fields"),
        "width",
        *[F.expr(cell(i, c)).alias(c) for i, c in enumerate(columns)],
    )


def _no_marker(text: str) -> str:
    markers = ", ".join(f"'{m}'" for m in NULL_MARKERS)
    return f"case when {text} not in ({markers}) then {text} end"


def _bad(text: str) -> str:
    return f"(coalesce(nullif({_no_marker(text)}, ''), '0') != '0' and try_cast({text} as double) is null)"


def typed_rows(
    raw: DataFrame,
    keep: list[str],
    columns: list[str] | None = None,
    device_zone: str = "UTC",
    missing: str = "null",
    bad: str | None = None,
) -> DataFrame:
    """Timestamps and doubles from raw cells. ``missing="zero"`` turns missing numbers into 0. ``bad`` names a column for the number
    of cells that are neither missing nor a number."""
    if missing not in ("null", "zero"):
        raise ValueError(f"unknown policy {missing}")
    columns = columns or LOG_COLUMNS
    times = [c for c in columns if c in TIME_COLUMNS]
    numbers = [c for c in columns if c not in TIME_COLUMNS]
    rows = raw.select(
        *keep,
        *[parse_time(F.col(c), device_zone).alias(c) for c in times],
        *[F.expr(f"try_cast({_no_marker(c)} as double)").alias(c) for c in numbers],
        *([] if bad is None else [F.expr(" + ".join(f"cast({_bad(c)} as int)" for c in numbers)).cast("long").alias(bad)]),
    )
    return fill_missing(rows, numbers) if missing == "zero" else rows


def read_log_rows(
    lines: DataFrame,
    headers: DataFrame,
    file: str,
    keep: list[str],
    columns: list[str] | None = None,
    device_zone: str = "UTC",
    missing: str = "null",
    use_aliases: bool = False,
    carry: tuple[str, ...] = (),
    broadcast: bool = False,
    bad: str | None = None,
) -> DataFrame:
    """Typed rows of log lines, header lines left out: one pass from text to the catalog's columns. ``bad`` as in ``typed_rows``."""
    columns = columns or LOG_COLUMNS
    raw = parse_lines(
        lines, layouts(headers, use_aliases), file, keep, columns, carry=carry, broadcast=broadcast
    )
    data = raw.filter(~is_header_cell(F.col(TIME_COLUMNS[0])))
    return typed_rows(data, [file, *keep, *carry], columns, device_zone, missing, bad)
