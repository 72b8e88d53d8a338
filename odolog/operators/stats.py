"""Statistics over whole tables and per trip.

Every job is one scan with one map-side combined aggregate for all columns; the wide result row is
then unpivoted. Only exact medians of very large groups need further passes (``exact_medians``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.catalog import PROFILE_EXCLUDED, STAT_GROUPS
from odolog.functions.cells import fill_missing
from odolog.functions.joins import null_safe_join
from odolog.session import durable

MOSTLY_NULL = 0.9
# A trip of a day at one row per second stays below this.
MEDIAN_ROWS = 100_000


def _value_columns(df: DataFrame, columns: list[str] | None, excluded: list[str]) -> list[str]:
    return [c for c in (columns or df.columns) if c in df.columns and c not in excluded]


def without_excluded(columns: list[str], excluded: list[str] | None = None) -> list[str]:
    """Columns a profile looks at: all but keys, times and flags, by name."""
    excluded = PROFILE_EXCLUDED if excluded is None else excluded
    return sorted({c for c in columns if c not in excluded})


def _no_nan(column: str, kinds: dict[str, str]) -> Column:
    """Column with NaN read as null, as missing values are one thing in logs."""
    value = F.col(column)
    return F.nullif(value, F.lit(float("nan"))) if kinds[column] in ("double", "float") else value


def unpivot_measures(df: DataFrame, keys: list[str], columns: list[str], measures: list[str], name: str) -> DataFrame:
    """Wide aggregates ``<measure>__<column>`` -> one row per (keys, column) with one field per measure."""
    structs = [
        F.struct(F.lit(c).alias(name), *[F.col(f"{m}__{c}").alias(m) for m in measures]) for c in columns
    ]
    return df.select(*keys, F.inline(F.array(*structs)))


# -- speeds, null counts ---------------------------------------------------------------------------


def trip_speeds(df: DataFrame, key: str, speeds: list[str], time: str, limit: int | None = None) -> DataFrame:
    """Per trip: average of each speed column (0 when it has no value) and the first time."""
    out = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in speeds], F.min(time).alias(time))
    out = fill_missing(out, speeds)
    return out if limit is None else out.orderBy(key).limit(limit)


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the number of nulls of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def _null_stats(df: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls__{c}") for c in columns],
    )
    long = unpivot_measures(wide, [*keys, "rows"], columns, ["nulls"], name)
    return long.withColumn("null_ratio", F.col("nulls") / F.col("rows"))


def column_stats(df: DataFrame, columns: list[str] | None = None, excluded: tuple = ("gpstime", "devicetime")) -> DataFrame:
    """Per column of the whole table: rows, nulls, their share, and whether it is mostly null."""
    picked = _value_columns(df, columns, list(excluded))
    out = _null_stats(df, [], picked, "column_name")
    return out.select(
        "column_name", "rows", "nulls", "null_ratio", (F.col("null_ratio") > MOSTLY_NULL).alias("mostly_null")
    )


def file_stats(
    df: DataFrame,
    key: str,
    columns: list[str] | None = None,
    excluded: tuple = ("gpstime", "devicetime"),
    files: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Per (file, column): nulls and their share. Files without rows do not appear.

    ``limit`` takes the first so many of ``files`` by key.
    """
    picked = _value_columns(df, columns, [key, *excluded])
    if limit is not None:
        if files is None:
            raise ValueError("a limit needs the files it counts")
        df = df.join(F.broadcast(files.select(key).orderBy(key).limit(limit)), key, "left_semi")
    return _null_stats(df, [key], picked, "column").select(key, "column", "nulls", "null_ratio")


# -- profiles --------------------------------------------------------------------------------------


BROADCAST_GROUPS = 100_000


def _select_ranks(
    df: DataFrame,
    keys: list[str],
    clean: dict[str, Column],
    max_group: int,
    ranges: DataFrame | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Exact medians per (keys, column) for groups too large to hold in one task.

    Narrows a bracket around the middle values. Each pass counts the bracket in equal-width
    buckets, so at most ``buckets`` rows per group and task are shuffled, and keeps the bucket that
    holds the middle. Brackets that fit ``max_group`` rows are finished by sorting what lies in them.
    A pass reads only the columns that are not solved yet. ``ranges`` has (column, n, lo, hi) where
    these are already known.
    """
    group = [*keys, "column"]

    def values(columns: list[str]) -> DataFrame:
        pairs = [F.struct(F.lit(c).alias("column"), clean[c].alias("value")) for c in columns]
        return df.select(*keys, F.inline(F.array(*pairs))).filter(F.col("value").isNotNull())

    def in_brackets() -> DataFrame:
        # few brackets (counted) are broadcast, so the values are not shuffled
        side = F.broadcast(state) if sum(o["groups"] for o in open_columns) <= BROADCAST_GROUPS else state
        joined = null_safe_join(values([o["column"] for o in open_columns]), side, group)
        return joined.filter(F.col("value").between(F.col("lo"), F.col("hi")))

    top = 1.7976931348623157e308

    def quarter(c: str) -> Column:
        # widths of any bracket stay finite
        return F.greatest(F.least(c, F.lit(top)), F.lit(-top)) / 4

    if ranges is None:
        ranges = durable(
            values(list(clean))
            .groupBy(*group)
            .agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        )
    state = ranges.filter(F.col("n") > 0).withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")})
    solved = []
    while True:
        done = F.col("lo") == F.col("hi")
        solved.append(state.filter(done).select(*group, F.col("lo").alias("median")))
        state = state.filter(~done)
        # one row per column
        open_columns = (
            state.groupBy("column").agg(F.max("inside").alias("largest"), F.count(F.lit(1)).alias("groups")).collect()
        )
        if max((o["largest"] for o in open_columns), default=0) <= max_group:
            break
        share = (quarter("value") - quarter("lo")) / (quarter("hi") - quarter("lo"))
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counted = (
            in_brackets()
            .withColumn("bucket", bucket)
            .groupBy(*group, "n", "below", "bucket")
            .agg(F.count(F.lit(1)).alias("cnt"), F.min("value").alias("b_lo"), F.max("value").alias("b_hi"))
        )
        along = Window.partitionBy(*group).orderBy("bucket")
        counted = counted.withColumns(
            {
                "upto": F.col("below") + F.sum("cnt").over(along.rowsBetween(Window.unboundedPreceding, 0)),
                "next_lo": F.lead("b_lo").over(along),
            }
        )
        first_rank, second_rank = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
        start = F.col("upto") - F.col("cnt")
        holder = counted.filter((start <= first_rank) & (first_rank < F.col("upto")))
        apart = second_rank >= F.col("upto")
        middle = F.col("b_hi") / 2 + F.col("next_lo") / 2  # a sum could overflow
        state = durable(
            holder.select(
                *group,
                "n",
                F.when(apart, middle).otherwise(F.col("b_lo")).alias("lo"),
                F.when(apart, middle).otherwise(F.col("b_hi")).alias("hi"),
                start.alias("below"),
                F.col("cnt").alias("inside"),
            )
        )

    def at(rank: Column) -> Column:
        return F.get("v", (F.floor(rank) - F.col("below")).cast("int"))

    out = solved[0]
    for part in solved[1:]:
        out = out.unionByName(part)
    if not open_columns:
        return out
    rest = in_brackets().groupBy(*group, "n", "below").agg(F.sort_array(F.collect_list("value")).alias("v"))
    return out.unionByName(
        rest.select(*group, (at((F.col("n") - 1) / 2) / 2 + at(F.col("n") / 2) / 2).alias("median"))
    )


def exact_medians(
    df: DataFrame, keys: list[str], columns: list[str], max_group: int = MEDIAN_ROWS, ranges: DataFrame | None = None
) -> DataFrame:
    """(keys, column, median): exact medians however large a group is.

    One counting pass finds the groups above ``max_group`` rows. All others go to Spark's
    ``median``, which keeps a group's values in one task; the large ones are solved by selection.
    Without keys, ``ranges`` (column, rows, n, lo, hi) saves the passes that find them.
    """
    kinds = dict(df.dtypes)
    clean = {c: _no_nan(c, kinds).cast("double") for c in columns}
    if keys:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        large = durable(counts.filter(F.col("_rows") > max_group).select(*keys))
        n_large = large.count()
    else:
        rows = df.count() if ranges is None else ranges.agg(F.max("rows")).first()[0]
        n_large = int((rows or 0) > max_group)
    small_rows, large_rows = df, df
    if keys and n_large:
        side = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
        small_rows, large_rows = (null_safe_join(df, side, keys, how) for how in ("left_anti", "left_semi"))
    parts = []
    if keys or not n_large:
        wide = small_rows.groupBy(*keys).agg(*[F.median(v).alias(f"median__{c}") for c, v in clean.items()])
        parts.append(unpivot_measures(wide, keys, columns, ["median"], "column"))
    if n_large:
        known = None if keys or ranges is None else ranges.select("column", "n", "lo", "hi")
        parts.append(_select_ranks(large_rows, keys, clean, max_group, known))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def column_profile(
    df: DataFrame,
    keys: list[str] | None = None,
    columns: list[str] | None = None,
    limit: int | None = None,
    order: list | None = None,
    approximate: bool = False,
    max_group: int = MEDIAN_ROWS,
) -> DataFrame:
    """Per column (and per trip with ``keys``): nulls, rows per null, min, median, mean, max.

    ``limit`` profiles the first rows along ``order`` only (the quick look at a table).
    ``approximate`` trades the exact median for a percentile sketch in the same pass.
    """
    keys = keys or []
    columns = without_excluded(columns or df.columns, [*PROFILE_EXCLUDED, *keys])
    if limit:
        if order is None:
            raise ValueError("a limited profile needs an order, or its rows would be arbitrary")
        df = df.orderBy(*order).limit(limit)
    kinds = dict(df.dtypes)
    measures = ["nulls", "min", "mean", "max"] + (["median"] if approximate else [])
    exprs = []
    for c in columns:
        v = _no_nan(c, kinds).cast("double")
        exprs += [
            F.count_if(v.isNull()).alias(f"nulls__{c}"),
            F.min(v).alias(f"min__{c}"),
            F.avg(v).alias(f"mean__{c}"),
            F.max(v).alias(f"max__{c}"),
        ]
        if approximate:
            exprs.append(F.approx_percentile(v, 0.5).alias(f"median__{c}"))
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *exprs)
    out = unpivot_measures(wide, [*keys, "rows"], columns, measures, "column")
    if not approximate:
        ranges = None
        if not keys:  # one row per column
            out = durable(out)
            ranges = out.select(
                "column", "rows", (F.col("rows") - F.col("nulls")).alias("n"), F.col("min").alias("lo"), F.col("max").alias("hi")
            )
        out = null_safe_join(out, exact_medians(df, keys, columns, max_group, ranges), [*keys, "column"], "left")
    per_null = F.when(F.col("nulls") > 0, F.col("rows") / F.col("nulls")).otherwise(F.lit(0.0))
    return out.select(
        *keys, "column", "rows", "nulls", per_null.alias("rows_per_null"), "min", "median", "mean", "max"
    )


# -- trip statistics -------------------------------------------------------------------------------


def stat_group_columns(columns: list[str]) -> dict[str, list[str]]:
    """Columns of each statistics group, by substring; a column may be in several groups."""
    return {
        group: [c for c in columns if any(part in c for part in parts)]
        for group, parts in STAT_GROUPS.items()
    }


# Which measures a statistics group reports.
GROUP_MEASURES = {
    "timestats": ["min", "mean", "max", "tdelta"],
    "speedstats": ["mean", "max"],
    "gpsstats": ["min", "mean", "max"],
    "coststats": ["min", "mean", "max"],
    "tempstats": ["min", "mean", "max"],
}


def trip_statistics(df: DataFrame, key: str, groups: list[str] | None = None) -> DataFrame:
    """Per (trip, group, column): the group's measures, for all trips in one aggregate.

    Long rows (key, stat_group, column, min, mean, max, tdelta_s). Times are seconds since the
    epoch; ``tdelta_s`` is last minus first time. Measures a group does not report are null.
    """
    kinds = dict(df.dtypes)
    wanted = {g: cs for g, cs in stat_group_columns(df.columns).items() if groups is None or g in groups}
    used = list(dict.fromkeys(c for cs in wanted.values() for c in cs if c != key))

    def number(c: str) -> Column:
        if kinds[c].startswith("timestamp"):
            return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
        return F.col(c).cast("double")

    exprs = []
    for c in used:
        exprs += [
            F.min(number(c)).alias(f"min__{c}"),
            F.avg(number(c)).alias(f"mean__{c}"),
            F.max(number(c)).alias(f"max__{c}"),
        ]
    nothing = F.lit(None).cast("double")
    rows = []
    for group, columns in wanted.items():
        has = GROUP_MEASURES[group]
        for c in columns:
            if c == key:
                continue
            span = F.col(f"max__{c}") - F.col(f"min__{c}")
            rows.append(
                F.struct(
                    F.lit(group).alias("stat_group"),
                    F.lit(c).alias("column"),
                    (F.col(f"min__{c}") if "min" in has else nothing).alias("min"),
                    F.col(f"mean__{c}").alias("mean"),
                    F.col(f"max__{c}").alias("max"),
                    (span if "tdelta" in has else nothing).alias("tdelta_s"),
                )
            )
    if not rows:
        raise ValueError("no column belongs to the requested groups")
    return df.groupBy(key).agg(*exprs).select(key, F.inline(F.array(*rows)))


def trip_min_max_avg(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Long rows (key, column, min, max, avg) for the listed columns the table has."""
    present = [c for c in columns if c in df.columns]
    wide = trip_wide(df, key, present)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{m}{c}").cast("double").alias(m) for m in ("min", "max", "avg")],
        )
        for c in present
    ]
    return wide.select(key, F.inline(F.array(*structs)))


def unknown_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Listed columns the table does not have."""
    return [c for c in columns if c not in df.columns]


def trip_wide(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One wide row per trip: ``min<c>``, ``max<c>``, ``avg<c>`` of the listed columns the table has."""
    exprs = []
    for c in [c for c in columns if c in df.columns]:
        exprs += [F.min(c).alias(f"min{c}"), F.max(c).alias(f"max{c}"), F.avg(c).alias(f"avg{c}")]
    return df.groupBy(key).agg(*exprs)


# -- counts and extents ----------------------------------------------------------------------------


def table_counts(trips: DataFrame, files: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: number of trips, files and log rows."""
    tables = {"trips": trips, "files": files, "logs": logs}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t, df in tables.items()]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return rows.agg(*[F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in tables])


def rows_per_file(df: DataFrame, key: str) -> DataFrame:
    """Rows of each file."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("sent_rows"))


def bounding_box(df: DataFrame, lat: str, lon: str, keys: list[str] | None = None) -> DataFrame:
    """Smallest and largest latitude and longitude, overall or per key; null when there is no point."""
    return df.groupBy(*(keys or [])).agg(
        F.min(lat).alias("min_lat"),
        F.min(lon).alias("min_lon"),
        F.max(lat).alias("max_lat"),
        F.max(lon).alias("max_lon"),
    )


def start_end_positions(df: DataFrame, key: str, time: str, lat: str, lon: str) -> DataFrame:
    """Per trip: smallest latitude and smallest longitude among the rows at its first time, and at
    its last time. The two are independent when several rows share that time; null times count not.

    One map-side combined aggregate over (time, value) pairs instead of a window over each trip,
    so a trip of any length costs one row per task in the shuffle.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))

    def smallest_at(sign: int, value: str) -> Column:
        # nulls last: a missing value never beats a present one at the same time
        return F.min(F.struct((t * sign).alias("t"), F.col(value).isNull().alias("none"), F.col(value).alias("v")))["v"]

    return (
        df.filter(F.col(time).isNotNull())
        .groupBy(key)
        .agg(
            smallest_at(1, lat).alias("latmin"),
            smallest_at(1, lon).alias("lonmin"),
            smallest_at(-1, lat).alias("latmax"),
            smallest_at(-1, lon).alias("lonmax"),
        )
    )


# -- top k, order, limits --------------------------------------------------------------------------


def top_trips(trips: DataFrame, key: str, distance: str, k: int = 3) -> DataFrame:
    """The k longest trips; ties by key."""
    return trips.select(key, distance).orderBy(F.desc(distance), key).limit(k)


def top_trip_details(trips: DataFrame, logs: DataFrame, trip_key: str, distance: str, log_key: str, columns: list[str], k: int = 3) -> DataFrame:
    """Min / max / avg of the k longest trips. Only k keys are broadcast."""
    best = top_trips(trips, trip_key, distance, k).select(F.col(trip_key).alias(log_key))
    return trip_min_max_avg(logs.join(F.broadcast(best), log_key, "left_semi"), log_key, columns)


def first_files(files: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """Files in name order, the first ``limit`` of them when given."""
    ordered = files.orderBy(name)
    return ordered if limit is None else ordered.limit(limit)
