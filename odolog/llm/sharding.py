"""Sharding by histogram sort (operator 9).

Rows are sorted by an integer key into shards of nearly equal bytes. The splitters are found by
counting: each round adds up, over all partitions, the exact bytes and rows that lie between candidate
boundaries, keeps for every splitter the interval that holds its target, and probes that interval
more finely, until the boundary misses its target by less than the tolerance or cannot be moved. Only
then are rows exchanged, once.

The rounds read a narrow table (key, tie-breaker, size), and a round returns one row per interval to
the driver: ``shards * cells * probes`` at most, whatever the size of the data.

A shard consists of ``cells`` pieces, split in the same way. Ranks are taken within cells and the rows
before each cell are known from the counts, so no task sorts a whole shard. Rows with equal keys are
ordered by a tie-breaker; a key that holds a third of all rows is split like any other.

Defined results: a null text has no bytes; a null key sorts first; repeated rows each get a slot;
one row longer than a shard's share makes that shard larger, as rows are not cut; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.session import durable

_SPAN = 1 << 63  # tie-breakers are in [0, _SPAN)
_LOWEST = -(1 << 63)  # where null keys go
CELL_BYTES = 4 << 30  # a cell, which one task sorts, holds no more on average
LEAST_CELLS = 8


@dataclass
class _Splitter:
    """Where one target lies: the bytes and rows below ``low`` are known, ``high`` is beyond the target."""

    target: int
    low: int
    high: int
    bytes_low: int
    rows_low: int
    bytes_high: int
    rows_high: int

    def settled(self, tolerance: int) -> bool:
        near = min(self.target - self.bytes_low, self.bytes_high - self.target)
        return near <= tolerance or self.rows_high - self.rows_low <= 1

    def best(self) -> tuple[int, int, int]:
        if self.target - self.bytes_low <= self.bytes_high - self.target:
            return self.low, self.bytes_low, self.rows_low
        return self.high, self.bytes_high, self.rows_high

    def probes(self, n: int) -> list[int]:
        step = (self.high - self.low) / (n + 1)
        return sorted({min(self.high - 1, max(self.low + 1, self.low + round(step * (i + 1)))) for i in range(n)})


def _literal(values: list[int]) -> Column:
    """A constant array, in one expression however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def interval(positions: list[int]) -> Column:
    """Number of positions at or below a row (``_k``, ``_tie``), by binary search in a literal array."""
    if not positions:
        return F.lit(0)
    pairs = [divmod(p, _SPAN) for p in positions]
    # past the largest key: above every row
    pairs = [(k, t) if k < -_LOWEST else (-_LOWEST - 1, _SPAN - 1) for k, t in pairs]
    keys, ties = _literal([k for k, _ in pairs]), _literal([t for _, t in pairs])
    key, tie = F.col("_k"), F.col("_tie")

    def halve(range_: Column, _: Column) -> Column:
        low, high = range_["low"], range_["high"]
        mid = F.shiftright(low + high, 1)
        smaller = (key < F.get(keys, mid)) | ((key == F.get(keys, mid)) & (tie < F.get(ties, mid)))
        below = F.struct(low.alias("low"), mid.alias("high"))
        above = F.struct((mid + 1).alias("low"), high.alias("high"))
        return F.when(low >= high, range_).when(smaller, below).otherwise(above)

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(positions)).alias("high"))
    steps = F.sequence(F.lit(1), F.lit(len(positions).bit_length()))
    return F.aggregate(steps, whole, halve, lambda range_: range_["low"])


def histogram(rows: DataFrame, positions: list[int]) -> list[tuple[int, int]]:
    """Exact bytes and rows below each position."""
    counted = rows.groupBy(interval(positions).alias("i")).agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n"))
    found = {r["i"]: (r["b"], r["n"]) for r in counted.collect()}
    below, total_bytes, total_rows = [], 0, 0
    for i in range(len(positions)):
        b, n = found.get(i, (0, 0))
        total_bytes, total_rows = total_bytes + b, total_rows + n
        below.append((total_bytes, total_rows))
    return below


def splitters(rows: DataFrame, parts: int, tolerance: float, probes: int) -> tuple[list[int], list[int]]:
    """Positions that cut ``rows`` (``_k``, ``_tie``, ``_size``) into ``parts`` of nearly equal bytes, and the
    rows below each. ``tolerance`` is a share of a part's bytes; 0 finds the nearest row.

    A position stands for the pair (key, tie-breaker) as ``key * 2**63 + tie``."""
    total = rows.agg(
        F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo"), F.max("_k").alias("hi")
    ).first()
    if not total["n"]:
        return [], []
    low, high = total["lo"] * _SPAN, (total["hi"] + 1) * _SPAN
    allowed = int(tolerance * total["b"] / parts)
    cuts = [
        _Splitter(total["b"] * i // parts, low, high, 0, 0, total["b"], total["n"]) for i in range(1, parts)
    ]
    while open_ := [c for c in cuts if not c.settled(allowed)]:
        # splitters that still share an interval share its probes
        shared: dict[tuple[int, int], int] = {}
        for c in open_:
            shared[c.low, c.high] = shared.get((c.low, c.high), 0) + 1
        seen: set[tuple[int, int]] = set()
        positions: set[int] = set()
        for c in open_:
            if (c.low, c.high) not in seen:
                seen.add((c.low, c.high))
                positions.update(c.probes(probes * shared[c.low, c.high]))
        at = sorted(positions)
        below = histogram(rows, at)
        weight = [b for b, _ in below]
        for c in open_:
            i = bisect_left(weight, c.target)
            if i < len(at) and at[i] < c.high and at[i] > c.low:
                c.high, c.bytes_high, c.rows_high = at[i], *below[i]
            if i and at[i - 1] > c.low and at[i - 1] < c.high:
                c.low, c.bytes_low, c.rows_low = at[i - 1], *below[i - 1]
    best = sorted(c.best() for c in cuts)  # positions between the same two rows may have crossed
    return [p for p, _, _ in best], [n for _, _, n in best]


@dataclass(frozen=True)
class Plan:
    """Cell boundaries, and per cell the rows before it in its shard."""

    positions: list[int]
    offsets: list[int]
    cells: int

    def cell(self) -> Column:
        return interval(self.positions)

    def shard(self, cell: Column) -> Column:
        return F.floor(cell / F.lit(self.cells)).cast("int")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with sort key ``_k``, tie-breaker ``_tie`` and ``_size``."""
    return docs.withColumns(
        {
            "_k": F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)),
            "_tie": F.monotonically_increasing_id(),
            "_size": (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long"),
        }
    )


def plan(rows: DataFrame, shards: int, tolerance: float = 0.0, cells: int | None = None, probes: int = 4) -> Plan:
    """Splitters for durable ``rows`` (``_k``, ``_tie``, ``_size``). Unless given, the cells of a shard follow its bytes."""
    if cells is None:
        total = rows.agg(F.sum("_size")).first()[0] or 0
        cells = max(LEAST_CELLS, -(-total // (shards * CELL_BYTES)))
    positions, before = splitters(rows, shards * cells, tolerance, probes)
    starts = [0, *before]
    return Plan(positions, [starts[i] - starts[i - i % cells] for i in range(len(starts))], cells)


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: ``key``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (its rank in the shard, from 0)."""
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    crc = F.crc32(F.coalesce("_text", F.lit("")).cast("binary"))
    rows = durable(keyed(source, "_id", "_text").withColumn("_crc", crc).drop("_text"))
    found = plan(rows, shards, **options)
    placed = rows.withColumn("_cell", found.cell())
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_k", "_tie"))
    offset = F.get(F.array(*[F.lit(o).cast("long") for o in found.offsets]), F.col("_cell"))
    return placed.select(
        F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        found.shard(F.col("_cell")).alias("shard"), (rank - 1 + offset).cast("long").alias("slot"),
    )


def write(docs: DataFrame, folder: str, shards: int = 40, key: str = "doc_id", text: str = "text", **options) -> None:
    """``docs`` as Parquet, a folder ``shard=n`` each, sorted by key within the files.

    The rows, texts included, are exchanged once, by cell. The tie-breaker numbers the rows of the
    scan, so the input must not change between the count and the write."""
    rows = keyed(docs, key, text)
    found = plan(durable(rows.select("_k", "_tie", "_size")), shards, **options)
    (
        rows.withColumn("_cell", found.cell())
        .repartitionByRange(shards * found.cells, "_cell", "_k", "_tie")
        .sortWithinPartitions("_cell", "_k", "_tie")
        .withColumn("shard", found.shard(F.col("_cell")))
        .drop("_cell", "_k", "_tie", "_size")
        .write.partitionBy("shard")
        .parquet(folder)
    )
