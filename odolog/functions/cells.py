"""Repair of raw lines, cells and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Cell texts that mean "no value".
NULL_MARKERS = ["-", "∞"]

# Cell texts replaced as whole cells, and what replaces them.
CELL_MARKERS = {
    "-": "0",
    "NaN": "0",
    "Â": "",
    "â": "",
    "°": "",
    "₂": "",
    "∞": "",
    "£": "",
    "\n": "",
    "612508207723425200000000000000000000000": "0",
    "340282346638528860000000000000000000000": "0",
    "-3402823618710077500000000000000000000": "0",
    "6.125082077234252e+38": "0",
    "3.4028234663852886e+38": "0",
    "-5.481e-05": "0",
    "â\x88\x9e": "0",
}

# The narrower set of the buffer repair.
BUFFER_MARKERS = {"-": "0", "∞": "0", "NaN": "0", "6.125082077234252e+38": "0"}


def is_bad_cell(cell: Column) -> Column:
    """True where a cell holds text that is neither a marker nor a number."""
    text = F.trim(cell)
    return F.coalesce(
        (text != "") & ~text.isin(NULL_MARKERS) & text.try_cast("double").isNull(), F.lit(False)
    )


def clean_line(line: Column, compat: bool = False) -> Column:
    """Data line with lone dashes and broken symbols replaced by 0.

    The default treats every field that is exactly ``-``. ``compat`` replaces ``,-,`` in one
    left-to-right pass, which leaves every second one of adjacent dashes and never touches the
    first or the last field.
    """
    if compat:
        dashed = F.regexp_replace(line, ",-,", ",0,")
    else:
        dashed = F.regexp_replace(line, "(?<=^|,)-(?=,|$)", "0")
    return F.translate(dashed, "∞âÂ", "000")


def replace_cells(df: DataFrame, columns: list[str], markers: dict[str, str] | None = None) -> DataFrame:
    """Replace cells that equal a marker; longer texts that contain one stay."""
    return df.replace(markers or CELL_MARKERS, subset=columns)


def map_values(column: str, mapping: dict) -> Column:
    """Column with mapped values; values without a mapping stay."""
    if not mapping:
        raise ValueError("mapping must not be empty")
    value = F.col(column)
    branches = reduce(
        lambda acc, kv: F.when(value == kv[0], F.lit(kv[1])) if acc is None else acc.when(value == kv[0], F.lit(kv[1])),
        mapping.items(),
        None,
    )
    return branches.otherwise(value).alias(column)


def replace_chain(text: Column, replacements: dict[str, str]) -> Column:
    """All literal replacements, applied in order."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), replacements.items(), text)


def fill_missing(df: DataFrame, columns: list[str] | None = None, value: float = 0.0) -> DataFrame:
    """Nulls and NaNs of numeric columns -> ``value``."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    floating = {"double", "float"}
    kinds = dict(df.dtypes)
    picked = {c for c in (columns or df.columns) if kinds[c] in numeric}

    def filled(c: str) -> str:
        base = f"nanvl(`{c}`, {value}D)" if kinds[c] in floating else f"`{c}`"
        return f"coalesce({base}, cast({value} as {kinds[c]})) as `{c}`"

    return df.selectExpr(*[filled(c) if c in picked else f"`{c}`" for c in df.columns])


def drop_bad_columns(df: DataFrame) -> DataFrame:
    """Drop columns whose name is empty or starts with a digit."""
    return df.select([F.col(f"`{c}`") for c in df.columns if is_good_name(c)])


def is_good_name(name: str) -> bool:
    return bool(name.strip()) and not name[0].isnumeric()


def drop_marker_columns(df: DataFrame, columns: list[str] | None = None, marker: str = "-") -> DataFrame:
    """Drop columns whose every cell is the marker.

    Which columns stay is part of the result's schema, so this runs one aggregate that returns a
    single row of booleans to the driver. A table without rows keeps all columns.
    """
    checked = columns or [c for c, kind in df.dtypes if kind == "string"]
    if not checked:
        return df
    tests = [F.bool_and(F.coalesce(F.col(c) == marker, F.lit(False))).alias(c) for c in checked]
    only_marker = df.agg(*tests).first().asDict()
    return df.drop(*[c for c in checked if only_marker[c]])


def pairs_to_map(pairs: Column) -> Column:
    """``[k1, v1, k2, v2, ..]`` -> map; a trailing single key is ignored, the last value of a repeated key wins."""
    count = F.floor(F.size(pairs) / 2).cast("int")
    keys = F.filter(F.slice(pairs, F.lit(1), count * 2), lambda _, i: i % 2 == 0)
    values = F.filter(F.slice(pairs, F.lit(1), count * 2), lambda _, i: i % 2 == 1)
    def is_last(_, i):
        return ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), F.get(keys, i))

    return F.map_from_arrays(F.filter(keys, is_last), F.filter(values, is_last))
