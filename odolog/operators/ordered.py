"""Row order inside a key, computed without ever sorting a whole key in one task.

A trip (or user, or supplier) may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would put that share into one task. Here every key is cut into
*chunks*: pieces that follow each other in the row order, such as hours of the time column or
blocks of a text file. Windows run per (key, chunk); one small row per chunk then carries what the
next chunk needs. The big rows are shuffled once, by (key, chunk).

The rows of the chunks are carried on in two levels, too: they are range-sorted into blocks, scanned per (key, block), and only
one row per key and block meets others of its key, so a key with millions of chunks lies in no task.

A null key is a key like any other. ``chunk`` must never decrease along ``order``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.functions.joins import null_safe_join
from odolog.session import durable

_CHUNK = "_chunk"
_NO_CHUNK = -(2**62)  # rows without a chunk value sort first, as nulls do
CHUNK_SECONDS = [86_400, 3_600, 60, 1]
FEW_CHUNKS = 200_000  # as many rows of chunks, which are counted, are scanned in one level


def time_chunk(time: Column, seconds: int) -> Column:
    """Number of the time slice a time lies in."""
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def pick_chunk_seconds(df: DataFrame, keys: list[str], time: str, max_rows: int = 2_000_000) -> int:
    """Coarsest slice length whose fullest (key, slice) holds at most ``max_rows`` rows.

    Rows without a time do not count, as no slice length divides them. One scan counts the rows per
    second; longer slices are sums of these counts. When even one-second slices are fuller, one
    second is used: such a slice sorts with spilling, nothing is dropped.
    """
    slices = [time_chunk(F.col(time), s).alias(f"_s{s}") for s in CHUNK_SECONDS]
    counts = df.filter(F.col(time).isNotNull()).select(*keys, *slices).groupBy(*keys, *[f"_s{s}" for s in CHUNK_SECONDS])
    counts = durable(counts.agg(F.count(F.lit(1)).alias("_rows")))
    for seconds in CHUNK_SECONDS:
        fullest = counts.groupBy(*keys, f"_s{seconds}").agg(F.sum("_rows").alias("n")).agg(F.max("n")).first()[0]
        if (fullest or 0) <= max_rows:
            break
    return seconds


def chunk_of(df: DataFrame, keys: list[str], time: str, then: str, max_rows: int = 2_000_000) -> Column:
    """Chunks of at most about ``max_rows`` rows for the order (``time``, ``then``): slices of time, and for rows without a time,
    which come first, ranges of the numeric column ``then``. Those are cut where the fullest key has more than ``max_rows`` of them."""
    seconds = pick_chunk_seconds(df, keys, time, max_rows)
    untimed = df.filter(F.col(time).isNull())
    fullest = untimed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).first()
    slices = time_chunk(F.col(time), seconds)
    if fullest is None or fullest["n"] <= max_rows:
        return slices
    n_cuts = min(10_000, -(-2 * fullest["n"] // max_rows))
    same = [F.col(k).eqNullSafe(F.lit(fullest[k])) for k in keys]
    of_key = untimed.filter(reduce(lambda a, b: a & b, same, F.lit(True)))
    shares = [i / n_cuts for i in range(1, n_cuts)]
    cuts = of_key.agg(F.percentile_approx(F.col(then).cast("double"), shares, 10 * n_cuts).alias("q")).first()["q"] or []
    at = F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= F.col(then).cast("double"))
    return F.coalesce(slices, F.lit(_NO_CHUNK) + F.when(F.col(then).isNull(), 0).otherwise(F.size(at) + 1))


def _chunked(df: DataFrame, chunk: Column) -> DataFrame:
    return df.withColumn(_CHUNK, F.coalesce(chunk.cast("long"), F.lit(_NO_CHUNK)))


def _in_blocks(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` (a row per key and chunk) with the block ``_block`` a chunk lies in: blocks follow each other in the order of the chunks
    of a key and hold a task's share of all rows. Few rows, as counted, need no blocks and have no such column."""
    edges = durable(edges)
    if edges.count() <= FEW_CHUNKS:
        return edges
    return durable(edges.repartitionByRange(*keys, _CHUNK).withColumn("_block", F.spark_partition_id()))


def _carried(
    edges: DataFrame, keys: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, back: bool = False
) -> DataFrame:
    """``edges`` with what comes before each chunk in its key: sums, and last values that are not null. ``back``: what comes after."""
    sums, lasts = sums or {}, lasts or {}
    helper = {f"_in_{n}": c for n, c in {**sums, **lasts}.items()}
    rows = edges.withColumns(helper)

    def ahead(partition: list[str], order: str):
        return Window.partitionBy(*partition).orderBy(F.desc(order) if back else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)

    def scanned(names: dict, window, source: str) -> dict[str, Column]:
        return {n: F.last(F.col(f"{source}{n}"), ignorenulls=True).over(window) for n in names}

    if "_block" not in edges.columns:
        along = ahead(keys, _CHUNK)
        found = {n: F.coalesce(F.sum(f"_in_{n}").over(along), F.lit(0)) for n in sums} | scanned(lasts, along, "_in_")
        return rows.withColumns(found).drop(*helper)
    inside, across = ahead([*keys, "_block"], _CHUNK), ahead(keys, "_block")
    nearest = F.min if back else F.max
    of_block = rows.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_chunks"),
        *[F.sum(f"_in_{n}").alias(f"_all_{n}") for n in sums],
        *[nearest(F.when(F.col(f"_in_{n}").isNotNull(), F.struct(_CHUNK, f"_in_{n}")))[f"_in_{n}"].alias(f"_all_{n}") for n in lasts],
    )
    before = of_block.select(
        *keys, "_block",
        *[F.coalesce(F.sum(f"_all_{n}").over(across), F.lit(0)).alias(f"_far_{n}") for n in sums],
        *[c.alias(f"_far_{n}") for n, c in scanned(lasts, across, "_all_").items()],
    )
    near = {f"_near_{n}": F.coalesce(F.sum(f"_in_{n}").over(inside), F.lit(0)) for n in sums}
    near |= {f"_near_{n}": c for n, c in scanned(lasts, inside, "_in_").items()}
    joined = null_safe_join(rows.withColumns(near), before, [*keys, "_block"])
    found = {n: F.col(f"_near_{n}") + F.col(f"_far_{n}") for n in sums} | {n: F.coalesce(f"_near_{n}", f"_far_{n}") for n in lasts}
    return joined.withColumns(found).drop(*helper, *near, *[f"_far_{n}" for n in [*sums, *lasts]])


def row_numbers(
    df: DataFrame, keys: list[str], chunk: Column, order: list, name: str = "row_no", start: int = 1
) -> DataFrame:
    """Consecutive numbers along ``order`` within each key (over all rows when ``keys`` is empty)."""
    base = _chunked(df, chunk)
    group = [*keys, _CHUNK]
    local = base.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    counts = _in_blocks(base.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")), keys)
    offsets = _carried(counts, keys, sums={"_offset": F.col("_rows")}).select(*group, "_offset")
    return (
        null_safe_join(local, offsets, group)
        .withColumn(name, F.col("_n") + F.col("_offset") + F.lit(start - 1))
        .drop(_CHUNK, "_n", "_offset")
    )


def neighbours(df: DataFrame, keys: list[str], chunk: Column, order: list, columns: list[str]) -> DataFrame:
    """Adds ``prev_<c>`` and ``next_<c>``: values of the row before and after, null at the ends."""
    group = [*keys, _CHUNK]
    w = Window.partitionBy(*group).orderBy(*order)
    row = F.struct(*columns)
    local = _chunked(df, chunk).withColumns(
        {"_prev": F.lag(row).over(w), "_next": F.lead(row).over(w), "_row": row}
    )
    first, last = F.col("_prev").isNull(), F.col("_next").isNull()
    edges = (
        local.filter(first | last)
        .groupBy(*group)
        .agg(
            F.first(F.when(first, F.col("_row")), ignorenulls=True).alias("_first"),
            F.first(F.when(last, F.col("_row")), ignorenulls=True).alias("_last"),
        )
    )
    edges = _in_blocks(edges, keys)
    carried = _carried(_carried(edges, keys, lasts={"_before": F.col("_last")}), keys, lasts={"_after": F.col("_first")}, back=True)
    carried = carried.select(*group, "_before", "_after")
    out = null_safe_join(local, carried, group).withColumns(
        {
            "_prev": F.coalesce("_prev", "_before"),
            "_next": F.coalesce("_next", "_after"),
        }
    )
    extra = {f"{side}_{c}": F.col(f"_{side}")[c] for c in columns for side in ("prev", "next")}
    return out.withColumns(extra).drop(_CHUNK, "_prev", "_next", "_row", "_before", "_after")


class MarkerRuns:
    """Marker rows (repeated headers) in ordered rows, and the gaps they leave.

    The gap at a run of markers is the time from the nearest timed row before it to the nearest
    timed row after it. A run at the start or the end of a key has no gap.
    """

    def __init__(self, df: DataFrame, keys: list[str], chunk: Column, order: list, time: str, marker: Column):
        self.keys = keys
        self.group = [*keys, _CHUNK]
        base = _chunked(df, chunk).withColumn("_marker", F.coalesce(marker, F.lit(False)))
        w = Window.partitionBy(*self.group).orderBy(*order)
        so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        timed = ~F.col("_marker") & F.col(time).isNotNull()
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        rows = base.withColumns(
            {
                "_n": F.row_number().over(w),
                "_m": F.sum(F.col("_marker").cast("long")).over(so_far),
                "_t": F.when(timed, micros),
            }
        )
        rows = rows.withColumn("_pair", F.when(F.col("_t").isNotNull(), F.struct("_t", "_m")))
        rows = rows.withColumn("_pv", F.last("_pair", ignorenulls=True).over(earlier))
        self.rows = rows.withColumn(
            "_gap",
            F.when(
                F.col("_t").isNotNull() & (F.col("_m") > F.col("_pv._m")),
                (F.col("_t") - F.col("_pv._t")) / F.lit(1e6),
            ),
        )

    def _chunk_edges(self, is_break: Column | None = None) -> DataFrame:
        """Per chunk: first and last timed row, the gap carried in from before (``_gap``), and the
        sum of the gaps (``_gaps``) and the number of breaks (``_breaks``) inside."""
        opening = F.col("_t").isNotNull() & F.col("_pv").isNull()
        inner_break = F.lit(False) if is_break is None else is_break
        edges = self.rows.groupBy(*self.group).agg(
            F.sum(F.col("_marker").cast("long")).alias("_markers"),
            F.first(F.when(opening, F.struct("_n", "_t", "_m")), ignorenulls=True).alias("_fv"),
            F.max(F.when(F.col("_t").isNotNull(), F.struct("_n", "_t", "_m"))).alias("_lv"),
            F.sum("_gap").alias("_gaps"),
            F.count_if(inner_break).alias("_breaks"),
        )
        edges = _carried(_in_blocks(edges, self.keys), self.keys, sums={"_base": F.col("_markers")})
        closing = F.when(
            F.col("_lv").isNotNull(),
            F.struct(F.col("_lv._t").alias("_t"), (F.col("_base") + F.col("_lv._m")).alias("_m")),
        )
        edges = _carried(edges, self.keys, lasts={"_open": closing})
        return edges.withColumn(
            "_gap",
            F.when(
                F.col("_base") + F.col("_fv._m") > F.col("_open._m"),
                (F.col("_fv._t") - F.col("_open._t")) / F.lit(1e6),
            ),
        )

    def gaps(self) -> DataFrame:
        """One row (keys, gap_s) per run of markers that lies between timed rows."""
        inside = self.rows.select(*self.keys, F.col("_gap").alias("gap_s"))
        carried = self._chunk_edges().select(*self.keys, F.col("_gap").alias("gap_s"))
        return inside.unionByName(carried).filter(F.col("gap_s").isNotNull())

    def segments(self, max_gap: float, mode: str = "each", name: str = "segment") -> DataFrame:
        """Rows without markers, numbered by segment (0, 1, ..) within each key.

        ``each`` starts a segment at every gap above ``max_gap``. ``total`` looks at the sum of a
        key's gaps: up to ``max_gap`` the key stays whole, above it every run of markers starts a
        segment.
        """
        if mode not in ("each", "total"):
            raise ValueError(f"unknown mode {mode}")
        gap = F.col("_gap")
        is_break = gap.isNotNull() if mode == "total" else F.coalesce(gap > max_gap, F.lit(False))
        w = Window.partitionBy(*self.group).orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = self.rows.withColumn("_b", F.sum(is_break.cast("long")).over(w))

        edges = self._chunk_edges(is_break).withColumn("_break0", is_break.cast("long"))
        sums = F.coalesce("_gaps", F.lit(0.0)) + F.coalesce(gap, F.lit(0.0))
        carried = _carried(edges, self.keys, sums={"_offset": F.col("_breaks") + F.col("_break0")})
        carried = carried.select(*self.group, "_break0", F.col("_fv._n").alias("_from"), "_offset")
        if mode == "total":
            totals = edges.groupBy(*self.keys).agg(F.sum(sums).alias("_total"))
            carried = null_safe_join(carried, totals, self.keys)
        joined = null_safe_join(rows.filter(~F.col("_marker")), carried, self.group)
        carried_break = F.when(F.col("_n") >= F.col("_from"), F.col("_break0")).otherwise(F.lit(0))
        number = F.col("_offset") + F.col("_b") + carried_break
        if mode == "total":
            number = F.when(F.col("_total") > max_gap, number).otherwise(F.lit(0))
        helpers = [_CHUNK, "_marker", "_n", "_m", "_t", "_pair", "_pv", "_gap", "_b"]
        return joined.withColumn(name, number.cast("long")).drop(
            *helpers, "_offset", "_break0", "_from", "_total"
        )


def dense_ids(df: DataFrame, order: list, name: str, start: int = 1) -> DataFrame:
    """Consecutive ids over all rows along ``order``, without sorting them in one task.

    Range-sorts, keeps the sorted rows durably (so both uses below see the same partitions) and
    adds the row counts of the partitions before. The count table has one row per partition.
    """
    sorted_rows = durable(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part, position = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = sorted_rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sorted_rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        sorted_rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, position + F.col("_offset") + F.lit(start))
        .drop("_mid", "_part", "_offset")
    )
