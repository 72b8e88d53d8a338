"""Every operator bound to the driver's tables, with the SQL that defines its result.

Bindings: ``lineitem`` is a log table (trip = supplier), ``events`` a time series (trip = user,
marker row = an ``error`` event), ``documents`` files with lines and headers, ``customer`` trip
positions, ``supplier`` the place registry. All queries run over whole tables.

The registry of places derived from ``supplier`` has one place per nation and 100 units of balance,
so the number of places in a box does not grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from odolog.functions import cells, names, times
from odolog.operators import headers, ordered, places, quality, registry, stats, views
from odolog.plans import ingest
from odolog.sources import legacy, logs as log_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL of its result."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int = 4) -> Column:
    """Averages are compared rounded; the nudge keeps ties from falling either way."""
    return F.round((F.col(value) if isinstance(value, str) else value) + 1e-7, digits)


def r(sql: str, digits: int = 4) -> str:
    return f"round(({sql}) + 1e-7, {digits})"


def with_rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(c) for c in columns})


# -- bindings --------------------------------------------------------------------------------------

LOG_VALUES = [
    "latitude", "longitude", "gpsspeedkmh", "speedobdkmh", "speedgpskmh", "fuelcosttripcost", "ambientairtempc",
]


def logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("fileid"),
        F.col("l_shipdate").cast("timestamp").alias("gpstime"),
        F.col("l_quantity").alias("latitude"),
        F.nullif("l_extendedprice", F.lit(1000.0)).alias("longitude"),
        F.nullif("l_quantity", F.lit(1.0)).alias("gpsspeedkmh"),
        F.nullif("l_discount", F.lit(0.0)).alias("speedobdkmh"),
        F.nullif("l_tax", F.lit(0.0)).alias("speedgpskmh"),
        F.col("l_extendedprice").alias("fuelcosttripcost"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("ambientairtempc"),
    )


LOGS = """logs as (select l_suppkey as fileid, l_shipdate as gpstime, l_quantity as latitude,
  nullif(l_extendedprice, 1000.0) as longitude, nullif(l_quantity, 1.0) as gpsspeedkmh,
  nullif(l_discount, 0.0) as speedobdkmh, nullif(l_tax, 0.0) as speedgpskmh,
  l_extendedprice as fuelcosttripcost, case when l_returnflag = 'R' then l_tax end as ambientairtempc
  from lineitem)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "value",
        (F.col("event_type") == "error").alias("marker"), "event_type",
    )


def event_chunk(df: DataFrame, keys: list[str]) -> Column:
    return ordered.time_chunk(F.col("ts"), ordered.pick_chunk_seconds(df, keys, "ts"))


EVENT_ORDER = ["ts", "event_id"]
US = 1_000_000


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES = """lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)"""
CANON = "lower(regexp_replace({0}, '[^A-Za-z0-9_]', '', 'g'))"


def document_headers(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(
        F.col("doc_id").alias("file"), F.substring_index("text", "\n", 1).alias("header")
    )


HEADER_COLUMNS = f"""headers as (select doc_id as file, split_part(text, chr(10), 1) as header from documents),
cols as (select file, position, label, {CANON.format('label')} as "column" from
  (select file, unnest(range(len(string_split(header, ',')))) as position,
     unnest(string_split(header, ',')) as label from headers))"""


def customer_positions(spark: SparkSession, d: str, lat_scale: float = 1e3, lon_scale: float = 1e6) -> DataFrame:
    return table(spark, d, "customer").select(
        "c_custkey",
        (F.col("c_nationkey") / F.lit(lat_scale)).alias("lat"),
        (F.col("c_acctbal") / F.lit(lon_scale)).alias("lon"),
    )


def supplier_places(spark: SparkSession, d: str, lat_scale: float = 1e3, lon_scale: float = 1e6) -> DataFrame:
    step = F.floor(F.col("s_acctbal") / 100)
    return (
        table(spark, d, "supplier")
        .groupBy("s_nationkey", step.alias("step"))
        .agg(
            F.min("s_suppkey").alias("place_id"),
            F.min("s_acctbal").alias("bal"),
            F.count(F.lit(1)).alias("count"),
            F.min("s_name").alias("name"),
        )
        .select(
            "place_id",
            (F.col("s_nationkey") / F.lit(lat_scale)).alias("lat"),
            (F.col("bal") / F.lit(lon_scale)).alias("lon"),
            "count",
            F.when(F.col("place_id") % 3 != 0, F.col("name")).alias("label"),
        )
    )


def all_supplier_places(spark: SparkSession, d: str, lat_scale: float, lon_scale: float) -> DataFrame:
    """Every supplier is a place."""
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("place_id"),
        (F.col("s_nationkey") / F.lit(lat_scale)).alias("lat"),
        (F.col("s_acctbal") / F.lit(lon_scale)).alias("lon"),
        F.lit(1).cast("long").alias("count"),
        F.col("s_name").alias("label"),
    )


ALL_PLACES_SQL = """pos as (select c_custkey, c_nationkey / 1e1 as lat, c_acctbal / 1e5 as lon from customer),
places as (select s_suppkey as place_id, s_nationkey / 1e1 as lat, s_acctbal / 1e5 as lon, 1 as "count", s_name as label from supplier)"""


def positions_sql(lat_scale: str = "1e3", lon_scale: str = "1e6") -> str:
    return f"""pos as (select c_custkey, c_nationkey / {lat_scale} as lat, c_acctbal / {lon_scale} as lon from customer),
places as (select place_id, s_nationkey / {lat_scale} as lat, bal / {lon_scale} as lon, n as "count",
    case when place_id % 3 <> 0 then name end as label
  from (select s_nationkey, floor(s_acctbal / 100) as step, min(s_suppkey) as place_id, min(s_acctbal) as bal,
    count(*) as n, min(s_name) as name from supplier group by all))"""


# The tolerances of the boxes, written out so that a wrong preset shows.
BOX_TOLERANCES = {
    places.LIVE_BOX: ("(0.0000510::double + 0.00002::double)", "(0.0001221::double + 0.00002::double)"),
    places.match_box(): ("(0.0000510::double + 0.00004::double)", "(0.0001221::double + 0.00004::double)"),
    places.start_box(): ("(0.0001010::double + 0.00004::double)", "(0.0001421::double + 0.00004::double)"),
    places.REFRESH_BOX: ("0.05::double", "0.05::double"),
}


def box_sql(box: places.Box) -> str:
    lat, lon = BOX_TOLERANCES[box]
    return f"p.lat between t.lat - {lat} and t.lat + {lat} and p.lon between t.lon - {lon} and t.lon + {lon}"


# -- speeds, null counts, profiles -----------------------------------------------------------------

SPEEDS = ["gpsspeedkmh", "speedobdkmh", "speedgpskmh"]


def speeds_of(spark, d, limit=None):
    out = stats.trip_speeds(logs(spark, d), "fileid", SPEEDS, "gpstime", limit)
    return with_rounded(out, *SPEEDS).withColumn("gpstime", F.unix_micros("gpstime"))


SPEEDS_SQL = f"""with {LOGS} select fileid, {', '.join(f'{r(f"coalesce(avg({c}), 0)")} as {c}' for c in SPEEDS)},
epoch_us(min(gpstime)) as gpstime from logs group by fileid"""


@query("trip_speeds", SPEEDS_SQL)
def _(spark, d):
    return speeds_of(spark, d)


@query("trip_speeds_limited", SPEEDS_SQL + " order by fileid limit 20")
def _(spark, d):
    return speeds_of(spark, d, limit=20)


@query(
    "event_speeds",
    f"select user_id, {r('coalesce(avg(value), 0)')} as value, epoch_us(min(ts)) as ts from events group by user_id",
)
def _(spark, d):
    out = stats.trip_speeds(events(spark, d), "user_id", ["value"], "ts")
    return with_rounded(out, "value").withColumn("ts", F.unix_micros("ts"))


@query("speeds_view", SPEEDS_SQL)
def _(spark, d):
    return views.speeds_view(speeds_of(spark, d), "fileid", SPEEDS, "gpstime")


@query(
    "null_counts",
    f"with {LOGS} select {', '.join(f'count(*) filter (where {c} is null) as {c}' for c in LOG_VALUES)} from logs",
)
def _(spark, d):
    return stats.null_counts(logs(spark, d), LOG_VALUES)


@query(
    "column_stats",
    f"with {LOGS}, x as ("
    + " union all ".join(
        f"select '{c}' as column_name, count(*) as rows, count(*) filter (where {c} is null) as nulls from logs"
        for c in LOG_VALUES
    )
    + ") select *, nulls / rows as null_ratio, nulls / rows > 0.9 as mostly_null from x",
)
def _(spark, d):
    return stats.column_stats(logs(spark, d), LOG_VALUES)


@query(
    "file_stats",
    f"with {LOGS} "
    + " union all ".join(
        f"""select fileid, '{c}' as "column", count(*) filter (where {c} is null) as nulls,
count(*) filter (where {c} is null) / count(*) as null_ratio from logs group by fileid"""
        for c in LOG_VALUES
    ),
)
def _(spark, d):
    return stats.file_stats(logs(spark, d), "fileid", LOG_VALUES)


FIRST_FILES = "(select s_suppkey from supplier order by s_suppkey limit 7)"


@query(
    "file_stats_limited",
    f"with {LOGS} "
    + " union all ".join(
        f"""select fileid, '{c}' as "column", count(*) filter (where {c} is null) as nulls,
count(*) filter (where {c} is null) / count(*) as null_ratio from logs where fileid in {FIRST_FILES} group by fileid"""
        for c in LOG_VALUES
    ),
)
def _(spark, d):
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("fileid"))
    return stats.file_stats(logs(spark, d), "fileid", LOG_VALUES, files=files, limit=7)


def profile_sql(source: str, columns: list[str], key: str | None = None) -> str:
    by = f"{key}, " if key else ""
    tail = f" group by {key}" if key else ""
    return " union all ".join(
        f"""select {by}'{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls,
{r(f"case when count(*) > count({c}) then count(*) / (count(*) - count({c})) else 0.0 end")} as rows_per_null,
min({c})::double as min, {r(f"median({c}::double)")} as median, {r(f"avg({c})")} as mean, max({c})::double as max
from {source}{tail}"""
        for c in columns
    )


def profiled(df: DataFrame) -> DataFrame:
    return with_rounded(df, "rows_per_null", "median", "mean")


@query("column_profile", f"with {LOGS} {profile_sql('logs', LOG_VALUES)}")
def _(spark, d):
    return profiled(stats.column_profile(logs(spark, d), columns=LOG_VALUES))


@query(
    "column_profile_large_groups",
    f"with {LOGS} {profile_sql('logs', LOG_VALUES)}",
)
def _(spark, d):
    return profiled(stats.column_profile(logs(spark, d), columns=LOG_VALUES, max_group=100))


@query(
    "column_profile_first_rows",
    f"with x as (select * from events order by event_id limit 1000) {profile_sql('x', ['event_id', 'value'])}",
)
def _(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    return profiled(stats.column_profile(df, columns=["event_id", "value"], limit=1000, order=["event_id"]))


@query("file_profile", f"with {LOGS} {profile_sql('logs', LOG_VALUES, 'fileid')}")
def _(spark, d):
    return profiled(stats.column_profile(logs(spark, d), ["fileid"], LOG_VALUES))


@query("profile_without_excluded", f"with {LOGS} {profile_sql('logs', LOG_VALUES)}")
def _(spark, d):
    # no column list: keys, times and flags are left out by name
    return profiled(stats.column_profile(logs(spark, d)))


# -- trip statistics -------------------------------------------------------------------------------

STAT_NAMES = {
    "gpstime": "gpstime", "latitude": "gpslatitude", "longitude": "gpslongitude", "gpsspeedkmh": "gpsspeedkmh",
    "speedobdkmh": "speedobdkmh", "fuelcosttripcost": "fuelcosttripcost", "ambientairtempc": "ambientairtempc",
}


def stat_logs(spark, d):
    return logs(spark, d).select("fileid", *[F.col(c).alias(n) for c, n in STAT_NAMES.items()])


def group_sql(group: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        source = {n: o for o, n in STAT_NAMES.items()}[c]
        v = f"epoch_us({source}) / 1e6" if c == "gpstime" else source
        low = f"min({v})::double" if group != "speedstats" else "null::double"
        span = f"max({v}) - min({v})" if group == "timestats" else "null::double"
        parts.append(
            f"""select fileid, '{group}' as stat_group, '{c}' as "column", {low} as min, {r(f"avg({v})")} as mean,
max({v})::double as max, {span} as tdelta_s from logs group by fileid"""
        )
    return " union all ".join(parts)


GROUP_COLUMNS = {
    "timestats": ["gpstime"],
    "speedstats": ["gpsspeedkmh", "speedobdkmh"],
    "gpsstats": ["gpstime", "gpslatitude", "gpslongitude", "gpsspeedkmh"],
    "coststats": ["fuelcosttripcost"],
    "tempstats": ["ambientairtempc"],
}


@query("trip_statistics", f"with {LOGS} " + " union all ".join(group_sql(g, cs) for g, cs in GROUP_COLUMNS.items()))
def _(spark, d):
    return with_rounded(stats.trip_statistics(stat_logs(spark, d), "fileid"), "mean")


def _one_group(group: str):
    @query(f"trip_{group}", f"with {LOGS} {group_sql(group, GROUP_COLUMNS[group])}")
    def _(spark, d):
        return with_rounded(stats.trip_statistics(stat_logs(spark, d), "fileid", [group]), "mean")


for _group in GROUP_COLUMNS:
    _one_group(_group)


def min_max_avg_sql(source: str, key: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select {key}, '{c}' as "column", min({c})::double as min, max({c})::double as max, {r(f'avg({c})')} as avg
from {source} group by {key}"""
        for c in columns
    )


@query("trip_min_max_avg", f"with {LOGS} {min_max_avg_sql('logs', 'fileid', LOG_VALUES)}")
def _(spark, d):
    listed = [*LOG_VALUES, "absentsensor"]
    return with_rounded(stats.trip_min_max_avg(logs(spark, d), "fileid", listed), "avg")


@query(
    "trip_wide",
    f"with {LOGS} select fileid, "
    + ", ".join(f"min({c}) as min{c}, max({c}) as max{c}, {r(f'avg({c})')} as avg{c}" for c in LOG_VALUES)
    + " from logs group by fileid",
)
def _(spark, d):
    return with_rounded(stats.trip_wide(logs(spark, d), "fileid", LOG_VALUES), *[f"avg{c}" for c in LOG_VALUES])


@query(
    "table_counts",
    "select (select count(*) from orders) as trips, (select count(*) from customer) as files, "
    "(select count(*) from lineitem) as logs",
)
def _(spark, d):
    return stats.table_counts(table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "lineitem"))


@query("rows_per_file", f"with {LOGS} select fileid, count(*) as sent_rows from logs group by fileid")
def _(spark, d):
    return stats.rows_per_file(logs(spark, d), "fileid")


BOX_AGG = "min(lat) as min_lat, min(lon) as min_lon, max(lat) as max_lat, max(lon) as max_lon"


@query("bounding_box", f"with {positions_sql()} select {BOX_AGG} from pos")
def _(spark, d):
    return stats.bounding_box(customer_positions(spark, d), "lat", "lon")


@query("bounding_box_per_key", f"with {LOGS} select fileid, {BOX_AGG.replace('lat)', 'latitude)').replace('lon)', 'longitude)')} from logs group by fileid")
def _(spark, d):
    return stats.bounding_box(logs(spark, d), "latitude", "longitude", ["fileid"])


START_END_SQL = f"""with {LOGS}, ends as (select fileid, min(gpstime) as began, max(gpstime) as ended from logs group by fileid),
firsts as (select e.fileid, min(latitude) as latmin, min(longitude) as lonmin from ends e join logs g on g.fileid = e.fileid and gpstime = began group by e.fileid),
lasts as (select e.fileid, min(latitude) as latmax, min(longitude) as lonmax from ends e join logs g on g.fileid = e.fileid and gpstime = ended group by e.fileid)
select fileid, latmin, lonmin, latmax, lonmax from ends left join firsts using (fileid) left join lasts using (fileid)"""


def start_ends(spark, d):
    return stats.start_end_positions(logs(spark, d), "fileid", "gpstime", "latitude", "longitude")


@query("start_end_positions", START_END_SQL)
def _(spark, d):
    return start_ends(spark, d)


@query("start_stop_points", f"select latmin, lonmin, latmax, lonmax from ({START_END_SQL})")
def _(spark, d):
    return views.start_stop_points(start_ends(spark, d))


# -- header inventory and odd characters -----------------------------------------------------------


@query(
    "header_columns",
    f"""with {HEADER_COLUMNS} select file, position::int as position, label, "column" from cols""",
)
def _(spark, d):
    return headers.header_columns(document_headers(spark, d))


FREQUENCY_SQL = f"""with {HEADER_COLUMNS} select "column", count(*) as "count",
case when count(*) = 1 then min(file) end as sole_file from cols
where "column" <> '' and not regexp_matches("column", '^[0-9]') group by "column" """


@query("header_frequency", FREQUENCY_SQL)
def _(spark, d):
    return headers.header_frequency(headers.header_columns(document_headers(spark, d)))


@query("columns_by_count", FREQUENCY_SQL)
def _(spark, d):
    return headers.columns_by_count(headers.header_frequency(headers.header_columns(document_headers(spark, d))))


@query(
    "column_files",
    f"""with {HEADER_COLUMNS} select "column", file from cols where regexp_matches("column", '^[^0-9]')""",
)
def _(spark, d):
    return headers.column_files(headers.header_columns(document_headers(spark, d)))


@query(
    "header_sizes",
    f"""with {HEADER_COLUMNS} select file, count(*)::int as colcount,
(sum(length("column")) + count(*) - 1)::int as chars from cols group by file""",
)
def _(spark, d):
    return headers.header_sizes(document_headers(spark, d))


@query(
    "average_header",
    f"""with {HEADER_COLUMNS}, s as (select file, count(*) as n, sum(length("column")) + count(*) - 1 as c from cols group by file)
select {r('avg(n)')} as avg_columns, {r('avg(c)')} as avg_chars from s""",
)
def _(spark, d):
    sizes = headers.header_sizes(document_headers(spark, d))
    return with_rounded(headers.average_header(sizes), "avg_columns", "avg_chars")


@query("distinct_headers", f"with {HEADER_COLUMNS} select distinct label from cols")
def _(spark, d):
    return headers.distinct_headers(headers.header_columns(document_headers(spark, d)))


FIELDS = "fields as (select doc_id, unnest(string_split(text, ',')) as field from documents)"


@query(
    "non_ascii_runs",
    f"""with {FIELDS}, x as (select doc_id, regexp_extract(field, '[^\\x00-\\x7F]+', 0) as run from fields)
select doc_id, run, count(*) as fields from x where run <> '' group by all""",
)
def _(spark, d):
    return headers.non_ascii_runs(documents(spark, d), ["doc_id"], "text")


@query(
    "non_ascii_runs_overall",
    f"""with {FIELDS}, x as (select unnest(regexp_extract_all(field, '[^\\x00-\\x7F]+')) as run from fields)
select run, count(*) as fields from x group by all""",
)
def _(spark, d):
    return headers.non_ascii_runs(documents(spark, d), [], "text", every_run=True)


@query(
    "header_line_counts",
    f"""with {LINES} select doc_id, count(*) filter (where lower(line[1:4]) like '%gps%') as header_lines,
count(*) filter (where lower(line[1:4]) like '%gps%') > 1 as damaged from lines group by doc_id""",
)
def _(spark, d):
    return quality.header_line_counts(document_lines(spark, d), ["doc_id"])


# Raw text cells of a log, some of them unreadable.
RAW_CELLS = """raw as (select user_id, event_id, case event_type when 'error' then 'x' || printf('%.2f', value)
  when 'view' then '-' when 'signup' then '∞' else printf('%.2f', value) end as cell,
  case when event_type = 'click' then 5 else 4 end as fields, 4 as width from events)"""


def raw_cells(spark, d):
    kind = F.col("event_type")
    text = F.format_string("%.2f", F.col("value"))
    cell = F.when(kind == "error", F.concat(F.lit("x"), text)).when(kind == "view", "-").when(kind == "signup", "∞")
    return events(spark, d).select(
        "user_id", "event_id", cell.otherwise(text).alias("cell"),
        F.when(kind == "click", 5).otherwise(4).alias("fields"), F.lit(4).alias("width"),
    )


@query(
    "parse_audit",
    f"""with {RAW_CELLS} select user_id, count(*) as rows, count(*) filter (where cell like 'x%') as bad_cells,
count(*) filter (where fields <> width) as ragged_rows,
count(*) filter (where cell like 'x%') > 0 or count(*) filter (where fields <> width) > 0 as has_errors
from raw group by user_id""",
)
def _(spark, d):
    return quality.parse_audit(raw_cells(spark, d), ["user_id"], ["cell"], "fields", "width")


@query(
    "append_status",
    f"""with {RAW_CELLS}, s as (select user_id, count(*) filter (where cell not like 'x%') as good_rows,
count(*) filter (where cell like 'x%') as bad_rows from raw group by user_id)
select *, case when bad_rows = 0 then 'success' when good_rows > 0 then 'warning' else 'error' end as status from s""",
)
def _(spark, d):
    return quality.quarantine(raw_cells(spark, d), ["user_id"], ["cell"])[2]


@query("append_good_rows", f"with {RAW_CELLS} select user_id, event_id, cell from raw where cell not like 'x%'")
def _(spark, d):
    return quality.quarantine(raw_cells(spark, d), ["user_id"], ["cell"])[0].select("user_id", "event_id", "cell")


@query("append_quarantine", f"with {RAW_CELLS} select user_id, event_id, cell from raw where cell like 'x%'")
def _(spark, d):
    return quality.quarantine(raw_cells(spark, d), ["user_id"], ["cell"])[1].select("user_id", "event_id", "cell")


# -- row order -------------------------------------------------------------------------------------


@query(
    "first_last_rows",
    """with x as (select *, row_number() over (partition by user_id order by ts, event_id) as a,
row_number() over (partition by user_id order by ts desc, event_id desc) as z from events)
select user_id, count(*) as rows, max(case when a = 1 then event_id end) as first_event_id,
max(case when z = 1 then event_id end) as last_event_id, max(case when a = 1 then value end) as first_value,
max(case when z = 1 then value end) as last_value from x group by user_id""",
)
def _(spark, d):
    return quality.first_and_last(events(spark, d), ["user_id"], EVENT_ORDER, ["event_id", "value"])


@query(
    "neighbour_rows",
    """select user_id, event_id, epoch_us(lag(ts) over w) as prev_ts, epoch_us(lead(ts) over w) as next_ts,
lag(value) over w as prev_value, lead(value) over w as next_value from events
window w as (partition by user_id order by ts, event_id)""",
)
def _(spark, d):
    df = events(spark, d).select("user_id", "event_id", "ts", "value")
    out = ordered.neighbours(df, ["user_id"], event_chunk(df, ["user_id"]), EVENT_ORDER, ["ts", "value"])
    return out.select(
        "user_id", "event_id", F.unix_micros("prev_ts").alias("prev_ts"), F.unix_micros("next_ts").alias("next_ts"),
        "prev_value", "next_value",
    )


@query(
    "row_numbers_per_trip",
    """select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as row_no from events""",
)
def _(spark, d):
    df = events(spark, d).select("user_id", "event_id", "ts")
    return ordered.row_numbers(df, ["user_id"], event_chunk(df, ["user_id"]), EVENT_ORDER).drop("ts")


@query(
    "surrogate_ids",
    "select o_orderkey, 100 + row_number() over (order by o_orderdate, o_orderkey) as id from orders",
)
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ordered.dense_ids(df, ["o_orderdate", "o_orderkey"], "id", start=101).drop("o_orderdate")


# Runs of marker rows with the nearest other rows around them, straight from the definition.
RUNS = """o as (select user_id, event_id, ts, event_type = 'error' as marker,
  row_number() over (partition by user_id order by ts, event_id) as n from events),
m as (select *, last_value(case when not marker then ts end ignore nulls) over (partition by user_id order by n
    rows between unbounded preceding and 1 preceding) as before,
  first_value(case when not marker then n end ignore nulls) over (partition by user_id order by n
    rows between 1 following and unbounded following) as after_n from o),
gaps as (select distinct m.user_id, a.n as after_n, (epoch_us(a.ts) - epoch_us(m.before)) / 1e6 as gap_s
  from m join o a on a.user_id = m.user_id and a.n = m.after_n where m.marker and m.before is not null)"""


def marker_args(spark, d):
    df = events(spark, d).select("user_id", "event_id", "ts", "marker")
    return df, ["user_id"], event_chunk(df, ["user_id"]), EVENT_ORDER, "ts", F.col("marker")


@query(
    "header_gate",
    f"with {RUNS} select user_id, max(gap_s) as max_gap_s from gaps group by user_id having max(gap_s) > 172800",
)
def _(spark, d):
    return quality.header_gate(*marker_args(spark, d), max_gap=172_800)


@query("marker_gaps", f"with {RUNS} select user_id, gap_s from gaps")
def _(spark, d):
    return ordered.MarkerRuns(*marker_args(spark, d)).gaps()


@query(
    "split_trips",
    f"""with {RUNS} select o.user_id, o.event_id, count(g.after_n) as segment from o
left join gaps g on g.user_id = o.user_id and g.after_n <= o.n and g.gap_s > 86400
where not o.marker group by o.user_id, o.event_id""",
)
def _(spark, d):
    out = quality.split_trips(*marker_args(spark, d), max_gap=86_400)
    return out.select("user_id", "event_id", "segment")


@query(
    "split_trips_total",
    f"""with {RUNS}, t as (select user_id, sum(gap_s) as total from gaps group by user_id)
select o.user_id, o.event_id, count(g.after_n) as segment from o left join t on t.user_id = o.user_id
left join gaps g on g.user_id = o.user_id and g.after_n <= o.n and t.total > 1000000
where not o.marker group by o.user_id, o.event_id""",
)
def _(spark, d):
    out = quality.split_trips(*marker_args(spark, d), max_gap=1_000_000, mode="total")
    return out.select("user_id", "event_id", "segment")


@query(
    "segment_names",
    f"""with {RUNS}, s as (select o.user_id, o.event_id, any_value(o.ts) as ts, count(g.after_n) as segment from o
left join gaps g on g.user_id = o.user_id and g.after_n <= o.n and g.gap_s > 86400
where not o.marker group by o.user_id, o.event_id)
select user_id, segment, count(*) as rows, epoch_us(min(ts)) as segment_start,
case when segment > 0 then 'trackLog-split-' || strftime(min(ts), '%Y-%b-%d_%H-%M') || '.csv' end as file_name
from s group by user_id, segment""",
)
def _(spark, d):
    out = quality.segment_names(quality.split_trips(*marker_args(spark, d), max_gap=86_400), ["user_id"], "ts")
    return out.withColumn("segment_start", F.unix_micros("segment_start"))


@query(
    "too_long_trips",
    """with x as (select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as duration_s from events group by user_id)
select * from x where duration_s > 2500000""",
)
def _(spark, d):
    return quality.too_long(events(spark, d), ["user_id"], EVENT_ORDER, "ts", max_seconds=2_500_000)


@query(
    "trip_summary",
    """with x as (select *, row_number() over (partition by user_id order by event_id) as a,
row_number() over (partition by user_id order by event_id desc) as z from events),
y as (select user_id, count(*) as n, max(case when a = 1 then ts end) as s, max(case when z = 1 then ts end) as e,
max(case when a = 1 then value end) as sv, max(case when z = 1 then value end) as ev,
max(case when a = 1 then event_id end) as si, max(case when z = 1 then event_id end) as ei from x group by user_id)
select user_id, epoch_us(s) as trip_start, epoch_us(e) as trip_end, (epoch_us(e) - epoch_us(s)) / 1e6 as trip_duration,
sv as startlat, si as startlon, ev as endlat, ei as endlon, n as sent_rows from y""",
)
def _(spark, d):
    df = events(spark, d).withColumn("lon", F.col("event_id"))
    out = quality.trip_summary(df, ["user_id"], ["event_id"], "ts", "value", "lon")
    return out.withColumns({c: F.unix_micros(c) for c in ("trip_start", "trip_end")})


@query(
    "ingest_report",
    f"""with {RUNS}, c as (select user_id, count(*) filter (where event_type <> 'error') as rows,
count(*) filter (where event_type = 'view') as dropped_rows,
count(*) filter (where event_type = 'error') as header_rows from events group by user_id),
rej as (select user_id, 'header gap' as reason from gaps group by user_id having max(gap_s) > 172800
union all select user_id, 'too long' from events group by user_id
having (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 > 2500000)
select c.user_id, rows, dropped_rows, header_rows, min(reason) as reason, count(reason) as reasons,
case when count(reason) = 0 then rows - dropped_rows else 0 end as sent_rows
from c left join rej on rej.user_id = c.user_id group by c.user_id, rows, dropped_rows, header_rows""",
)
def _(spark, d):
    ev = events(spark, d)
    counts = ev.groupBy("user_id").agg(
        F.count_if(~F.col("marker")).alias("rows"),
        F.count_if(F.col("event_type") == "view").alias("dropped_rows"),
        F.count_if("marker").alias("header_rows"),
    )
    gap = quality.header_gate(*marker_args(spark, d), max_gap=172_800)
    long = quality.too_long(ev, ["user_id"], EVENT_ORDER, "ts", max_seconds=2_500_000)
    rejects = gap.select("user_id", F.lit("header gap").alias("reason")).unionByName(
        long.select("user_id", F.lit("too long").alias("reason"))
    )
    sent = counts.join(rejects, "user_id", "left_anti").select(
        "user_id", (F.col("rows") - F.col("dropped_rows")).alias("sent_rows")
    )
    return quality.ingest_report(counts, sent, rejects, "user_id")


# -- row filters -----------------------------------------------------------------------------------

# Raw time cells: markers, repeated headers in two spellings, times.
RAW_TIMES = """raw as (select event_id, user_id, case when event_type = 'error' then '-'
  when event_type = 'view' and event_id % 2 = 0 then 'GPS Time' when event_type = 'view' then ' gpstime'
  when event_type = 'signup' then null else strftime(ts, '%Y-%m-%d %H:%M:%S.%f') end as gpstime from events)"""


def raw_times(spark, d):
    kind = F.col("event_type")
    cell = (
        F.when(kind == "error", "-")
        .when((kind == "view") & (F.col("event_id") % 2 == 0), "GPS Time")
        .when(kind == "view", " gpstime")
        .when(kind != "signup", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    )
    return events(spark, d).select("event_id", "user_id", cell.alias("gpstime"))


@query("rows_with_time", f"with {RAW_TIMES} select * from raw where gpstime <> '-'")
def _(spark, d):
    return quality.rows_with_time(raw_times(spark, d))


@query(
    "dropped_time_counts",
    f"""with {RAW_TIMES} select user_id, count(*) as rows,
count(*) filter (where gpstime is null or gpstime = '-') as dropped_rows from raw group by user_id""",
)
def _(spark, d):
    return quality.dropped_time_counts(raw_times(spark, d), ["user_id"])


@query(
    "without_headers",
    f"with {RAW_TIMES} select * from raw where gpstime is null or trim(gpstime) not in ('GPS Time', 'gpstime')",
)
def _(spark, d):
    return quality.without_headers(raw_times(spark, d))


@query(
    "without_dash_lines",
    f"with {LINES} select doc_id, count(*) as lines, count(distinct line) as distinct_lines from lines "
    "where line not like '-%' group by doc_id",
)
def _(spark, d):
    kept = quality.without_dash_lines(document_lines(spark, d))
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("line").alias("distinct_lines"))


@query(
    "file_list",
    "select o_custkey as fileid, epoch_us(min(o_orderdate)) as trip_start, count(*) as sent_rows from orders group by o_custkey",
)
def _(spark, d):
    return views.file_list(order_files(spark, d)).withColumn("trip_start", F.unix_micros("trip_start"))


def order_files(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("fileid"))
        .agg(F.min(F.col("o_orderdate").cast("timestamp")).alias("trip_start"), F.count(F.lit(1)).alias("sent_rows"))
    )


@query("entries_per_file", "select o_custkey as fileid, count(*) as sent_rows from orders group by o_custkey")
def _(spark, d):
    return views.entries_per_file(order_files(spark, d))


@query("track", f"with {LOGS} select fileid, coalesce(latitude, 0) as latitude, coalesce(longitude, 0) as longitude from logs")
def _(spark, d):
    return views.track(logs(spark, d), "fileid", "latitude", "longitude")


@query(
    "speed_series",
    f"with {LOGS} select fileid, epoch_us(gpstime) as row_time, "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in SPEEDS)
    + " from logs",
)
def _(spark, d):
    df = logs(spark, d).withColumn("row_time", F.unix_micros("gpstime"))
    return views.speed_series(df, "fileid", ["row_time"], SPEEDS)


@query("trip_rows", f"with {LOGS} select * exclude (gpstime), epoch_us(gpstime) as gpstime from logs")
def _(spark, d):
    return views.trip_rows(logs(spark, d), "fileid").withColumn("gpstime", F.unix_micros("gpstime"))


# -- top k, order, limits --------------------------------------------------------------------------


@query(
    "top_trips",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 3",
)
def _(spark, d):
    return stats.top_trips(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query(
    "top_trip_details",
    "with x as (select * from lineitem where l_orderkey in "
    "(select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 3)) "
    + min_max_avg_sql("x", "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
)
def _(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = stats.top_trip_details(
        table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "o_totalprice", "l_orderkey", columns
    )
    return with_rounded(out, "avg")


@query("sorted_files", "select url as csvfile, page_id from pages")
def _(spark, d):
    return stats.first_files(table(spark, d, "pages").select(F.col("url").alias("csvfile"), "page_id"), "csvfile")


@query("limited_files", "select o_orderkey, o_custkey from orders order by o_orderkey limit 50")
def _(spark, d):
    return stats.first_files(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 50)


# -- names, cells, values --------------------------------------------------------------------------


@query(
    "canonical_names",
    f"select doc_id, {CANON.format('text')} as name from documents",
)
def _(spark, d):
    return documents(spark, d).select("doc_id", names.canonical_name(F.col("text")).alias("name"))


# Labels made from the part table: dictionary labels, underscore labels and unknown ones.
LABELS = """labels as (select p_partkey, case p_size % 5 when 0 then ' G(x)' when 1 then 'DPF Pressure(psi)'
  when 2 then 'Altitude' when 3 then 'Cost per mile/km (Trip)(£/km)' else p_name || ' (' || p_type || ')' end as label
  from part)"""


def part_labels(spark, d):
    k = F.col("p_size") % 5
    return table(spark, d, "part").select(
        "p_partkey",
        F.when(k == 0, " G(x)").when(k == 1, "DPF Pressure(psi)").when(k == 2, "Altitude")
        .when(k == 3, "Cost per mile/km (Trip)(£/km)")
        .otherwise(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("label"),
    )


@query(
    "alias_names",
    f"""with {LABELS} select p_partkey, case trim(label) when 'G(x)' then 'gravityxg'
when 'DPF Pressure(psi)' then 'dpf_pressurepsi' when 'Altitude' then 'altitudem'
when 'Cost per mile/km (Trip)(£/km)' then 'cost_per_milekm_tripkm' else {CANON.format('label')} end as name from labels""",
)
def _(spark, d):
    return part_labels(spark, d).select("p_partkey", names.alias_name(F.col("label")).alias("name"))


@query(
    "merge_labels",
    f"""with known as (select distinct p_name as label, {CANON.format('p_name')} as name from part where p_size <= 5),
fresh as (select distinct p_name || ' (' || p_type || ')' as label from part union select distinct p_name from part where p_type = 'SMALL')
select coalesce(f.label, k.label) as label, case when f.label is not null
then regexp_replace(replace(lower(f.label), ' ', '_'), '[^a-z0-9_]', '', 'g') else k.name end as name
from known k full join fresh f on f.label = k.label""",
)
def _(spark, d):
    part = table(spark, d, "part")
    known = part.filter("p_size <= 5").select(F.col("p_name").alias("label")).distinct()
    known = known.withColumn("name", names.canonical_name(F.col("label")))
    fresh = part.select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("label"))
    fresh = fresh.unionByName(part.filter("p_type = 'SMALL'").select(F.col("p_name").alias("label")))
    return names.merge_labels(known, fresh)


# Lines with dashes made from words, so every kind of dash field occurs.
DASHED = """dashed as (select doc_id, replace(replace(text, ' ', ','), 'e', '-') as line from documents)"""


def dashed_lines(spark, d):
    return documents(spark, d).select("doc_id", F.translate(F.replace("text", F.lit(" "), F.lit(",")), "e", "-").alias("line"))


@query(
    "clean_lines",
    f"""with {DASHED}, f as (select doc_id, unnest(string_split(line, ',')) as field,
unnest(range(len(string_split(line, ',')))) as i from dashed)
select doc_id, string_agg(translate(case when field = '-' then '0' else field end, '∞âÂ', '000'), ',' order by i) as line
from f group by doc_id""",
)
def _(spark, d):
    return dashed_lines(spark, d).select("doc_id", cells.clean_line(F.col("line")).alias("line"))


@query(
    "clean_lines_compat",
    f"with {DASHED} select doc_id, translate(regexp_replace(line, ',-,', ',0,', 'g'), '∞âÂ', '000') as line from dashed",
)
def _(spark, d):
    return dashed_lines(spark, d).select("doc_id", cells.clean_line(F.col("line"), compat=True).alias("line"))


@query(
    "replace_cells",
    """select p_partkey, case when p_size < 10 then '0' when p_size < 15 then '' when p_size < 20 then '0'
when p_size < 25 then '- ' || p_name else p_name end as cell from part""",
)
def _(spark, d):
    size = F.col("p_size")
    cell = (
        F.when(size < 10, "-").when(size < 15, "∞").when(size < 20, "6.125082077234252e+38")
        .when(size < 25, F.concat(F.lit("- "), "p_name")).otherwise(F.col("p_name"))
    )
    return cells.replace_cells(table(spark, d, "part").select("p_partkey", cell.alias("cell")), ["cell"])


@query(
    "map_values",
    """select event_id, case event_type when 'click' then 'tap' when 'view' then 'look' else event_type end as event_type from events""",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", cells.map_values("event_type", {"click": "tap", "view": "look"}))


@query(
    "fill_missing",
    f"with {LOGS} select fileid, "
    + ", ".join(f"count(*) filter (where coalesce({c}, 0) = 0) as {c}" for c in LOG_VALUES)
    + " from logs group by fileid",
)
def _(spark, d):
    filled = cells.fill_missing(logs(spark, d), LOG_VALUES)
    return filled.groupBy("fileid").agg(*[F.count_if(F.col(c) == 0).alias(c) for c in LOG_VALUES])


@query("drop_bad_columns", "select p_partkey, p_name from part")
def _(spark, d):
    odd = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").alias("0200kphtimes"), F.col("p_type").alias(" "))
    return cells.drop_bad_columns(odd)


@query("drop_marker_columns", "select p_partkey, case when p_size < 25 then '-' else p_name end as some from part")
def _(spark, d):
    df = table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") < 25, "-").otherwise(F.col("p_name")).alias("some"), F.lit("-").alias("every")
    )
    return cells.drop_marker_columns(df)


@query(
    "replace_chain",
    "select p_partkey, replace(replace(p_name, 'red', 'blue'), 'blue', 'green') as name, "
    "replace(replace(p_name, 'red', 'blue'), 'blue', 'green') <> p_name as changed from part",
)
def _(spark, d):
    new = cells.replace_chain(F.col("p_name"), {"red": "blue", "blue": "green"})
    return table(spark, d, "part").select("p_partkey", new.alias("name"), (new != F.col("p_name")).alias("changed"))


@query("pairs_to_map", "select p_partkey, p_name as brand, p_type as type, 2 as entries from part")
def _(spark, d):
    pairs = F.array(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("brand"), "p_name", F.lit("tail"))
    m = cells.pairs_to_map(pairs)
    return table(spark, d, "part").select(
        "p_partkey", m["brand"].alias("brand"), m["type"].alias("type"), F.size(m).alias("entries")
    )


# -- times -----------------------------------------------------------------------------------------

TIME_FORMATS = {
    "click": "dd-MMM-yyyy HH:mm:ss", "view": "dd-MMM-yyyy HH:mm:ss.SSS", "error": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "signup": "EEE MMM dd HH:mm:ss 'GMT' yyyy",
}


def time_texts(spark, d):
    ts, kind = F.col("ts"), F.col("event_type")
    text = None
    for name, pattern in TIME_FORMATS.items():
        branch = F.date_format(ts, pattern)
        text = F.when(kind == name, branch) if text is None else text.when(kind == name, branch)
    zoned = F.date_format(ts, "EEE MMM dd HH:mm:ss 'GMT+02:00' yyyy")
    return events(spark, d).select("event_id", text.otherwise(zoned).alias("text"))


SECOND = "(epoch_us(ts) // 1000000) * 1000000"


@query(
    "parse_times",
    f"""select event_id, case event_type when 'error' then epoch_us(ts) when 'view' then (epoch_us(ts) // 1000) * 1000
when 'purchase' then {SECOND} - 7200000000 else {SECOND} end as micros from events""",
)
def _(spark, d):
    return time_texts(spark, d).select("event_id", F.unix_micros(times.parse_time(F.col("text"))).alias("micros"))


@query(
    "parse_times_in_zone",
    f"""select event_id, case event_type when 'error' then epoch_us(ts) - 3600000000
when 'view' then (epoch_us(ts) // 1000) * 1000 - 3600000000 when 'click' then {SECOND} - 3600000000
when 'purchase' then {SECOND} - 7200000000 else {SECOND} end as micros from events""",
)
def _(spark, d):
    parsed = times.parse_time(F.col("text"), device_zone="Europe/Paris")
    return time_texts(spark, d).select("event_id", F.unix_micros(parsed).alias("micros"))


@query(
    "column_times",
    f"""select event_id, case event_type when 'error' then epoch_us(ts) when 'signup' then {SECOND}
else {SECOND} - 7200000000 end as micros from events where event_type in ('error', 'signup', 'purchase')""",
)
def _(spark, d):
    parsed = times.parse_time(F.col("text"), lengths=times.GPS_LENGTHS)
    out = time_texts(spark, d).select("event_id", F.unix_micros(parsed).alias("micros"))
    return out.filter(F.col("micros").isNotNull())


@query(
    "durations",
    """select l_orderkey, l_linenumber, l_partkey, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1e6 as seconds
from lineitem join orders on o_orderkey = l_orderkey""",
)
def _(spark, d):
    joined = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    start, end = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", times.seconds_between(start, end).alias("seconds"))


@query(
    "trip_file_names",
    """select event_id, 'trackLog-' || strftime(ts, '%Y-%b-%d_%H-%M-%S') || '.csv' as file_name,
'trackLog-split-' || strftime(ts, '%Y-%b-%d_%H-%M') || '.csv' as split_name from events""",
)
def _(spark, d):
    return events(spark, d).select(
        "event_id", times.trip_file_name(F.col("ts")).alias("file_name"),
        times.trip_file_name(F.col("ts"), split=True).alias("split_name"),
    )


@query(
    "text_helpers",
    """select page_id, md5(html) as content_hash, list_last(string_split(url, '/')) as base_name,
length(html) as chars, lower(url) like '%example%' as has_example, url like 'https%' as is_secure,
regexp_matches(list_last(string_split(url, '/')), '^[0-9]') as leading_digit from pages""",
)
def _(spark, d):
    base = times.base_name(F.col("url"))
    return table(spark, d, "pages").select(
        "page_id", F.md5("html").alias("content_hash"), base.alias("base_name"), F.length("html").alias("chars"),
        F.contains(F.lower("url"), F.lit("example")).alias("has_example"),
        F.startswith("url", F.lit("https")).alias("is_secure"), base.rlike("^[0-9]").alias("leading_digit"),
    )


# -- files and registry ----------------------------------------------------------------------------

FOUND = """found as (select doc_id, source || '/' || lpad(doc_id::varchar, 12, '0') as csvfile, md5(text) as csvhash,
  octet_length(encode(text)) as size from documents where octet_length(encode(text)) > 3000),
reg as (select min(doc_id) as fileid, md5(text) as csvhash from documents where lang = 'fr' group by md5(text)),
fresh as (select f.* from found f where csvhash not in (select csvhash from reg)
  qualify row_number() over (partition by csvhash order by csvfile) = 1)"""


def found_documents(spark, d):
    return documents(spark, d).filter(F.octet_length("text") > 3000).select(
        "doc_id", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("csvfile"),
        F.md5("text").alias("csvhash"), F.octet_length("text").alias("size"),
    )


def document_registry(spark, d):
    french = documents(spark, d).filter("lang = 'fr'")
    return french.groupBy(F.md5("text").alias("csvhash")).agg(F.min("doc_id").alias("fileid")).select("fileid", "csvhash")


@query("found_files", f"with {FOUND} select * from found")
def _(spark, d):
    return found_documents(spark, d)


@query(
    "found_files_inclusive",
    "select doc_id, md5(text) as csvhash, octet_length(encode(text)) as size from documents "
    "where octet_length(encode(text)) >= 3000",
)
def _(spark, d):
    return documents(spark, d).filter(F.octet_length("text") >= 3000).select(
        "doc_id", F.md5("text").alias("csvhash"), F.octet_length("text").alias("size")
    )


@query("new_files", f"with {FOUND} select * from fresh")
def _(spark, d):
    return registry.new_files(found_documents(spark, d), document_registry(spark, d))


@query(
    "register_files",
    f"""with {FOUND} select csvfile, csvhash, (select max(fileid) from reg) + row_number() over (order by csvfile) as fileid from fresh""",
)
def _(spark, d):
    known = document_registry(spark, d)
    fresh = registry.new_files(found_documents(spark, d), known).select("csvfile", "csvhash")
    return registry.with_new_ids(fresh, known, ["csvfile"])


@query(
    "known_files",
    f"""with {FOUND}, n as (select doc_id as fileid, len(string_split(text, chr(10))) as sent_rows from documents)
select r.fileid, f.csvhash, f.doc_id, f.csvfile, f.size, coalesce(n.sent_rows, 0) as sent_rows
from found f join reg r on r.csvhash = f.csvhash left join n on n.fileid = r.fileid""",
)
def _(spark, d):
    counts = documents(spark, d).select(F.col("doc_id").alias("fileid"), F.size(F.split("text", "\n")).cast("long").alias("sent_rows"))
    return registry.known_files(found_documents(spark, d), document_registry(spark, d), counts)


TRIPS = """t as (select o_orderkey, o_orderdate as trip_start, o_orderstatus from orders),
reg as (select trip_start from t where o_orderstatus = 'F'), found as (select o_orderkey, trip_start from t where o_orderstatus <> 'F')"""


def start_tables(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("trip_start"), "o_orderstatus")
    return t.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), t.filter("o_orderstatus = 'F'")


@query(
    "repeated_starts",
    f"with {TRIPS} select o_orderkey, epoch_us(trip_start) as trip_start from found where trip_start in (select trip_start from reg)",
)
def _(spark, d):
    out = registry.repeated_starts(*start_tables(spark, d))
    return out.withColumn("trip_start", F.unix_micros("trip_start"))


@query(
    "fresh_starts",
    f"""with {TRIPS} select min(o_orderkey) as o_orderkey, epoch_us(trip_start) as trip_start from found
where trip_start not in (select trip_start from reg) group by trip_start""",
)
def _(spark, d):
    out = registry.fresh_starts(*start_tables(spark, d), "o_orderkey")
    return out.withColumn("trip_start", F.unix_micros("trip_start"))


@query(
    "file_rows",
    "select l_orderkey as fileid, l_linenumber, l_partkey, o_orderstatus from lineitem join orders on o_orderkey = l_orderkey",
)
def _(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("fileid"), "o_orderstatus")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fileid"), "l_linenumber", "l_partkey")
    return registry.file_rows(files, rows)


@query(
    "updated_registry",
    """with u as (select o_custkey, count(*) as n, min(o_orderdate) as s from orders group by o_custkey)
select c_custkey as fileid, c_name as csvfile, coalesce(n, 0) as sent_rows,
coalesce(epoch_us(s), 0) as trip_start from customer left join u on o_custkey = c_custkey""",
)
def _(spark, d):
    known = table(spark, d, "customer").select(
        F.col("c_custkey").alias("fileid"), F.col("c_name").alias("csvfile"),
        F.lit(0).cast("long").alias("sent_rows"), F.lit(0).cast("long").alias("trip_start"),
    )
    updates = order_files(spark, d).withColumn("trip_start", F.unix_micros("trip_start"))
    return registry.updated_registry(known, updates)


@query(
    "repair_report",
    f"""with {LINES}, x as (select doc_id, line, lower(line[1:4]) like '%gps%' as h,
regexp_matches(line, '(^|,)-(,|$)') or regexp_matches(line, '[∞âÂ]') as c from lines)
select doc_id, count(*) filter (where h) as header_lines, count(*) filter (where h) > 1 as damaged, count(*) as lines,
count(*) filter (where c) as changed_lines, case when count(*) filter (where h) > 1 then 'error' else 'ok' end as status
from x group by doc_id""",
)
def _(spark, d):
    return ingest.repair_report(document_lines(spark, d), "doc_id")


# -- reading logs ----------------------------------------------------------------------------------

# One log per user, in two layouts. Values are missing for errors, lines of sign-ups carry an extra
# field, lines of views are cut short; every file repeats its header once per purchase.
LOG_HEADERS = {
    0: "GPS Time, Longitude, Latitude,CO₂ in g/km (Average)(g/km),Speed (OBD)(km/h)",
    1: "Speed (OBD)(km/h),Latitude,GPS Time,Mystery Gauge,Longitude",
}
READ_COLUMNS = ["gpstime", "latitude", "longitude", "speedobdkmh", "coingkmaveragegkm"]


def log_files(spark, d):
    """(headers, lines) of trip logs rendered from the events."""
    ev = events(spark, d)
    even = F.col("user_id") % 2 == 0
    header = F.when(even, LOG_HEADERS[0]).otherwise(LOG_HEADERS[1])
    files = ev.select("user_id").distinct().select("user_id", header.alias("header"))
    number = lambda c: F.format_string("%.2f", c)
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    lat, lon = number(F.col("value")), number(F.col("value") * 2)
    speed = F.when(F.col("event_type") == "error", "∞").otherwise(number(F.col("value") + 1))
    tail = F.when(F.col("event_type") == "signup", ",extra").otherwise("")
    view = F.col("event_type") == "view"
    short0 = F.concat_ws(",", time, lon, lat)
    full0 = F.concat(F.concat_ws(",", time, lon, lat, F.lit("-"), speed), tail)
    short1 = F.concat_ws(",", speed, lat, time)
    full1 = F.concat(F.concat_ws(",", speed, lat, time, F.lit("-"), lon), tail)
    line = F.when(even, F.when(view, short0).otherwise(full0)).otherwise(F.when(view, short1).otherwise(full1))
    line = F.when(F.col("event_type") == "purchase", header).otherwise(line)
    return files, ev.select("user_id", "event_id", line.alias("line"))


def read_sql(missing: str) -> str:
    v = "printf('%.2f', {0})::double"
    even = "user_id % 2 = 0"
    co2 = missing
    speed = f"case when event_type = 'error' or (event_type = 'view' and {even}) then {missing} else {v.format('value + 1')} end"
    lon = f"case when event_type = 'view' and not {even} then {missing} else {v.format('value * 2')} end"
    return f"""select user_id, event_id, epoch_us(ts) as gpstime, {v.format('value')} as latitude, {lon} as longitude,
{speed} as speedobdkmh, {co2} as coingkmaveragegkm from events where event_type <> 'purchase'"""


def read_logs(spark, d, missing):
    files, lines = log_files(spark, d)
    out = log_source.read_log_rows(lines, files, "user_id", ["event_id"], READ_COLUMNS, missing=missing)
    return out.withColumn("gpstime", F.unix_micros("gpstime"))


@query("read_logs", read_sql("null::double"))
def _(spark, d):
    return read_logs(spark, d, "null")


@query("read_logs_zero", read_sql("0.0::double"))
def _(spark, d):
    return read_logs(spark, d, "zero")


@query(
    "unknown_log_columns",
    """select distinct user_id, 'mysterygauge' as "column" from events where user_id % 2 <> 0""",
)
def _(spark, d):
    return log_source.unknown_columns(log_files(spark, d)[0], "user_id")


@query(
    "legacy_profiles",
    f"""select event_id, case event_type when 'view' then null when 'click' then {SECOND} - 7200000000 else {SECOND} end as tripdate,
case when event_type <> 'view' then 'trackLog-' || strftime(case event_type when 'click' then ts - interval 2 hours else ts end,
'%Y-%b-%d_%H-%M-%S') || '.csv' end as csvfile from events""",
)
def _(spark, d):
    kind = F.col("event_type")
    zone = F.when(kind == "click", "GMT+02:00").otherwise("GMT")
    stamp = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss "), zone, F.date_format("ts", " yyyy"))
    extra = F.when(kind == "view", "a\n").when(kind == "signup", "a\nb\n").otherwise("")
    text = F.concat(F.lit("#profile\n#"), stamp, F.lit("\nname=x\nfuel=1\ncost=2\ntime=3\n"), extra)
    out = legacy.parse_profiles(events(spark, d).select("event_id", text.alias("text")))
    return out.withColumn("tripdate", F.unix_micros("tripdate"))


# -- places ----------------------------------------------------------------------------------------


def box_pairs(box: places.Box, lat_scale: float = 1e3, lon_scale: float = 1e6):
    def build(spark, d):
        named = supplier_places(spark, d, lat_scale, lon_scale).select(
            "place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")
        )
        pairs = places.box_join(customer_positions(spark, d, lat_scale, lon_scale), named, box, "lat", "lon", "p_lat", "p_lon")
        return pairs.select("c_custkey", "place_id")

    return build


def box_pairs_sql(box: places.Box, lat_scale: str = "1e3", lon_scale: str = "1e6") -> str:
    return f"with {positions_sql(lat_scale, lon_scale)} select c_custkey, place_id from pos t join places p on {box_sql(box)}"


query("box_join_live", box_pairs_sql(places.LIVE_BOX))(box_pairs(places.LIVE_BOX))
query("box_join_default", box_pairs_sql(places.match_box()))(box_pairs(places.match_box()))
query("box_join_start", box_pairs_sql(places.start_box()))(box_pairs(places.start_box()))
query("box_join_refresh", box_pairs_sql(places.REFRESH_BOX, "1e1", "1e5"))(box_pairs(places.REFRESH_BOX, 1e1, 1e5))

COUNTS = f"""c as (select t.c_custkey, count(p.place_id) as matches, min(p.place_id) as one
from pos t left join places p on {box_sql(places.LIVE_BOX)} group by t.c_custkey)"""
OUTCOME = "case matches when 0 then 'new' when 1 then 'matched' else 'ambiguous' end as outcome"


@query(
    "match_counts",
    f"""with {positions_sql()}, {COUNTS} select c_custkey, matches, case when matches = 1 then one end as place_id, {OUTCOME} from c""",
)
def _(spark, d):
    return places.match_counts(
        customer_positions(spark, d), supplier_places(spark, d), places.LIVE_BOX, ["c_custkey"], "lat", "lon"
    )


@query(
    "match_counts_salted",
    f"""with {positions_sql()}, {COUNTS} select c_custkey, matches, case when matches = 1 then one end as place_id, {OUTCOME} from c""",
)
def _(spark, d):
    return places.match_counts(
        customer_positions(spark, d), supplier_places(spark, d), places.LIVE_BOX, ["c_custkey"], "lat", "lon", hot_rows=3
    )


@query(
    "ambiguity_report",
    f"""with {positions_sql()} select c_custkey, count(*) as matches,
(count(p.label) = count(*) and count(distinct p.label) = 1) or count(p.label) = 0 as labels_agree,
count(*) - count(p.label) as unlabelled from pos t join places p on {box_sql(places.LIVE_BOX)}
group by c_custkey having count(*) > 1""",
)
def _(spark, d):
    return places.ambiguity_report(
        customer_positions(spark, d), supplier_places(spark, d), places.LIVE_BOX, ["c_custkey"], "lat", "lon"
    )


@query(
    "ambiguous_places",
    f"""with {positions_sql()}, {COUNTS} select t.c_custkey, p.place_id, p.label from pos t join places p on {box_sql(places.LIVE_BOX)}
join c on c.c_custkey = t.c_custkey and c.matches > 1""",
)
def _(spark, d):
    return places.ambiguous_places(
        customer_positions(spark, d), supplier_places(spark, d), places.LIVE_BOX, ["c_custkey"], "lat", "lon"
    )


@query(
    "unlabelled_hits",
    f"""with {positions_sql()}, {COUNTS} select count(*) as unlabelled_hits from c join places p on p.place_id = c.one
where matches = 1 and label is null""",
)
def _(spark, d):
    known = supplier_places(spark, d)
    matched = places.match_counts(customer_positions(spark, d), known, places.LIVE_BOX, ["c_custkey"], "lat", "lon")
    return places.unlabelled_hits(matched, known)


GRID = """pos as (select c_custkey, c_nationkey / 1e3 as lat, floor(c_acctbal / 100) / 1e4 as lon from customer),
places as (select min(s_suppkey) as place_id, s_nationkey / 1e3 as lat, floor(s_acctbal / 100) / 1e4 as lon,
  count(*) as "count" from supplier group by all)"""


def grid_tables(spark, d):
    trips = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") / F.lit(1e3)).alias("lat"), (F.floor(F.col("c_acctbal") / 100) / F.lit(1e4)).alias("lon")
    )
    known = (
        table(spark, d, "supplier")
        .groupBy((F.col("s_nationkey") / F.lit(1e3)).alias("lat"), (F.floor(F.col("s_acctbal") / 100) / F.lit(1e4)).alias("lon"))
        .agg(F.min("s_suppkey").alias("place_id"), F.count(F.lit(1)).alias("count"))
        .withColumn("label", F.lit(None).cast("string"))
    )
    return trips, known


@query(
    "exact_position_join",
    f"with {GRID} select c_custkey, place_id from pos t join places p on p.lat = t.lat and p.lon = t.lon",
)
def _(spark, d):
    trips, known = grid_tables(spark, d)
    named = known.select("place_id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    return places.exact_join(trips, named, "lat", "lon", "p_lat", "p_lon").select("c_custkey", "place_id")


@query(
    "exact_position_counts",
    f"""with {GRID}, v as (select lat, lon, count(*) as n, min(c_custkey) as f from pos group by all),
fresh as (select * from v where not exists (select 1 from places p where p.lat = v.lat and p.lon = v.lon))
select p.place_id, p.lat, p.lon, p."count" + coalesce(v.n, 0) as "count", null::varchar as label
from places p left join v on v.lat = p.lat and v.lon = p.lon
union all select (select max(place_id) from places) + row_number() over (order by f), lat, lon, n, null from fresh""",
)
def _(spark, d):
    trips, known = grid_tables(spark, d)
    return places.count_exact_positions(trips, known, "lat", "lon", "c_custkey")


def sequential_sql(box: places.Box, lat_scale: str, lon_scale: str, result: str, positions: str | None = None) -> str:
    """The one-at-a-time rule as a recursion that carries the list of places."""
    near = box_sql(box)
    return f"""with recursive {positions or positions_sql(lat_scale, lon_scale)},
trips as (select row_number() over (order by c_custkey) as i, * from pos),
steps as (
  select 0::bigint as i, (select list({{'id': place_id, 'lat': lat, 'lon': lon}}) from places) as known,
    (select max(place_id) from places) as top, null::bigint as c_custkey, []::bigint[] as hits
  union all
  select t.i, case when len(h) = 0 then list_append(known, {{'id': top + 1, 'lat': t.lat, 'lon': t.lon}}) else known end,
    case when len(h) = 0 then top + 1 else top end, t.c_custkey, h
  from (select s.known, s.top, t.*,
      list_transform(list_filter(s.known, lambda p: {near}), lambda p: p.id) as h
    from steps s join trips t on t.i = s.i + 1) t),
done as (select c_custkey, len(hits) as matches, case len(hits) when 1 then hits[1] when 0 then top end as place_id, hits,
  case len(hits) when 0 then 'new' when 1 then 'matched' else 'ambiguous' end as outcome from steps where i > 0)
{result}"""


ASSIGNED = "select c_custkey, place_id, matches, outcome from done"


@query("place_assignment", sequential_sql(places.LIVE_BOX, "1e3", "1e6", ASSIGNED))
def _(spark, d):
    return places.assign_places(
        customer_positions(spark, d), supplier_places(spark, d), places.LIVE_BOX, "c_custkey", "lat", "lon", ["c_custkey"]
    )[0]


NEW_PLACES = """, opened as (select d.place_id, t.lat, t.lon from done d join trips t on t.c_custkey = d.c_custkey where outcome = 'new'),
allp as (select place_id, lat, lon, "count", label from places union all select place_id, lat, lon, 1, null from opened)
select p.place_id, p.lat, p.lon, p."count" + coalesce(v.n, 0) as "count", p.label from allp p left join ({0}) v on v.place_id = p.place_id"""


@query(
    "place_registry",
    sequential_sql(
        places.LIVE_BOX, "1e3", "1e6",
        NEW_PLACES.format("select place_id, count(*) as n from done where outcome = 'matched' group by place_id"),
    ),
)
def _(spark, d):
    return places.assign_places(
        customer_positions(spark, d), supplier_places(spark, d), places.LIVE_BOX, "c_custkey", "lat", "lon", ["c_custkey"]
    )[1]


@query(
    "place_refresh",
    sequential_sql(
        places.REFRESH_BOX, "1e1", "1e5",
        NEW_PLACES.format("select h as place_id, count(*) as n from (select unnest(hits) as h from done) group by h"),
        ALL_PLACES_SQL,
    ),
)
def _(spark, d):
    return places.assign_places(
        customer_positions(spark, d, 1e1, 1e5), all_supplier_places(spark, d, 1e1, 1e5), places.REFRESH_BOX,
        "c_custkey", "lat", "lon", ["c_custkey"], every_match=True,
    )[1]


@query(
    "box_counts_refresh",
    f"""with {ALL_PLACES_SQL} select t.c_custkey, count(p.place_id) as matches,
  case when count(p.place_id) = 1 then min(p.place_id) end as place_id
from pos t left join places p on {box_sql(places.REFRESH_BOX)} group by t.c_custkey""",
)
def _(spark, d):
    points = customer_positions(spark, d, 1e1, 1e5)
    found = places.box_counts(points, all_supplier_places(spark, d, 1e1, 1e5), places.REFRESH_BOX, "lat", "lon")
    return found.select("c_custkey", "matches", "place_id")
