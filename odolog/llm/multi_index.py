"""Embedding near-duplicates by an inverted multi-index (operator 4).

Vectors are scaled to length 1 and cut into two halves. Each half has a codebook of its own (k-means
on a bounded sample), and the pairs of codewords form a grid of cells; every vector is filed in one.
A vector visits the cells nearest to it, in the order of the multi-sequence traversal (by the sum of the squared
distances of its halves to the codewords), as many as the target recall takes. That number is measured: for sampled
vectors and their partners, true ones and made ones at exactly the threshold, with the difference spread evenly or unevenly over
the halves, it is the rank at which the traversal from either side comes to the other's cell. Everything visited is
verified in double precision. ``recall=1`` visits every cell that an exact bound does not rule out, whatever the data.

A pair is found if either vector visits the other's cell, and counts once for both: visitors know their cell, filed vectors the
cells they visit. With cells of a bounded number of vectors on average, a vector is compared with a bounded number too, so the
work grows with the vectors. Cells that lie near each other form blocks, which tasks take; a vector is copied once per block it
visits.

Equal vectors form a class that is indexed once and counts with its size. A task compares a part of a block's
vectors with as many visitors; it returns counts per vector and a spanning forest of the links, never
the pairs, so a cell or cluster with a third of all vectors costs more tasks, not larger ones.
Codebooks are bounded by parameters, the list of cells by the codebooks.

Defined results: vectors that are null, zero, hold null or non-finite components link with nothing, and neither do rows without
an id; vectors of different lengths do not link, those of each length have an index of their own; repeated rows count as
vectors of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from odolog.llm.common import components, stored
from odolog.session import durable


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype("<f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=k)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def walk(first: np.ndarray, second: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The ``n`` cells with the smallest sums ``first[i] + second[j]``, in that order (multi-sequence
    traversal). ``nearest_cells`` takes the same cells for many vectors at once."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[rows], second[columns]
    heap, seen, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < n:
        _, i, j = heapq.heappop(heap)
        out.append((int(rows[i]), int(columns[j])))
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (a[u] + b[v], u, v))
    return out


def nearest_cells(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Per row the numbers of the first ``n`` cells of the traversal, in no order.

    The traversal comes to the pair of the u-th and v-th nearest codewords after all pairs of nearer ones, so among the first
    ``n`` are only pairs with ``u * v <= n``: about ``n log n`` sums instead of all.
    """
    ka, kb = a.shape[1], b.shape[1]
    n = min(n, ka * kb)
    u, v = np.nonzero(np.add.outer(np.zeros(min(n, ka)), np.zeros(min(n, kb))) == 0)
    fits = (u + 1) * (v + 1) <= n
    u, v = u[fits], v[fits]
    rows, columns = np.argsort(a, axis=1, kind="stable")[:, : u.max() + 1], np.argsort(b, axis=1, kind="stable")[:, : v.max() + 1]
    sums = np.take_along_axis(a, rows, 1)[:, u] + np.take_along_axis(b, columns, 1)[:, v]
    if sums.shape[1] > n:
        best = np.argpartition(sums, n - 1, axis=1)[:, :n]
    else:
        best = np.broadcast_to(np.arange(sums.shape[1]), sums.shape)
    return np.take_along_axis(rows, u[best], 1) * kb + np.take_along_axis(columns, v[best], 1)


@dataclass(frozen=True)
class Index:
    """The two codebooks; a cell's number is ``i * len(second) + j``."""

    first: np.ndarray
    second: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, k: int, rounds: int = 8) -> Index:
        half = sample.shape[1] // 2
        k = min(k, len(sample))
        return Index(_kmeans(sample[:, :half], k, rounds, 1), _kmeans(sample[:, half:], k, rounds, 2))

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Per vector the number of cells the traversal comes to before it has been to the given one, that included."""
        out = np.empty(len(x), np.int64)
        a, b = self.halves(x)
        i, j = np.divmod(cells, len(self.second))
        b = np.sort(b, axis=1)
        other = self.halves(x)[1]
        for k in range(len(x)):
            limit = a[k, i[k]] + other[k, j[k]]
            out[k] = np.searchsorted(b[k], limit - a[k] + 1e-12, "right").sum()
        return out

    def least(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the squared distances from the halves to all that is filed under each codeword."""

        def planes(d: np.ndarray, centres: np.ndarray) -> np.ndarray:
            gaps = np.sqrt(_distances(centres, centres))[d.argmin(axis=1)]
            apart = gaps > 1e-6  # rounding decides between closer codewords
            return np.square(np.divide(d - d.min(axis=1, keepdims=True), 2 * gaps, out=np.zeros_like(d), where=apart))

        a, b = self.halves(x)
        return planes(a, self.first), planes(b, self.second)


def _along(centres: np.ndarray) -> np.ndarray:
    """Places of the codewords along the direction in which they differ most."""
    off = centres - centres.mean(axis=0)
    direction = np.linalg.svd(off, full_matrices=False)[2][0] if len(off) > 1 else np.zeros(off.shape[1])
    place = np.empty(len(off), np.int64)
    place[np.argsort(off @ direction, kind="stable")] = np.arange(len(off))
    return place


class Layout:
    """Blocks of about ``size`` vectors: cells that lie near each other, or one cell with more. ``cells`` are the cells with vectors, by
    number; a cell's index is its place among them."""

    def __init__(self, index: Index, cells: np.ndarray, counts: np.ndarray, size: int):
        self.index, self.cells, self.block = index, cells, np.zeros(len(cells), np.int64)
        first, second = np.divmod(cells, len(index.second))
        i, j = _along(index.first)[first], _along(index.second)[second]
        curve = np.zeros(len(cells), np.int64)  # the bits of both places in turn: near cells are near on the curve
        for bit in range(24):
            curve |= ((i >> bit) & 1) << (2 * bit + 1) | ((j >> bit) & 1) << (2 * bit)
        number = used = 0
        for k in np.argsort(curve, kind="stable").tolist():
            if used and used + counts[k] > size:
                number, used = number + 1, 0
            self.block[k], used = number, used + int(counts[k])
        self.n_blocks = number + 1 if len(cells) else 0

    def place(self, cells: np.ndarray) -> np.ndarray:
        """Indexes of cells, -1 for those without vectors."""
        at = np.searchsorted(self.cells, cells).clip(max=len(self.cells) - 1)
        return np.where(self.cells[at] == cells, at, -1)

    def own(self, x: np.ndarray) -> np.ndarray:
        return self.place(self.index.cells(x))

    def visits(self, x: np.ndarray, n: int | None, cosine: float) -> list[np.ndarray]:
        """Per vector the indexes of the cells it visits, its own included: the first ``n`` of the traversal, or without ``n`` all that
        can hold a vector with at least this cosine."""
        if n is not None:
            found = self.place(nearest_cells(*self.index.halves(x), n))
            own = self.own(x)
            return [np.union1d(f[f >= 0], [o]) for f, o in zip(found, own)]
        a, b = self.index.least(x)
        i, j = np.divmod(self.cells, len(self.index.second))
        return [np.flatnonzero(ra[i] + rb[j] <= 2 - 2 * cosine + 1e-7) for ra, rb in zip(a, b)]


def made_partners(x: np.ndarray, cosine: float, share: np.ndarray, seed: int) -> np.ndarray:
    """For each vector one at exactly the cosine; ``share`` of the squared difference lies in the first half, as far as it fits."""
    rng = np.random.default_rng(seed)
    half = x.shape[1] // 2
    off = rng.normal(size=x.shape)
    for part, weight in ((slice(0, half), share), (slice(half, None), 1 - share)):
        off[:, part] *= np.sqrt(weight)[:, None] / np.maximum(np.linalg.norm(off[:, part], axis=1), 1e-12)[:, None]
    off -= (off * x).sum(1)[:, None] * x
    off /= np.maximum(np.linalg.norm(off, axis=1), 1e-12)[:, None]
    return cosine * x + (1 - cosine**2) ** 0.5 * off


def measured_visits(index: Index, sample: np.ndarray, cosine: float, recall: float, asked: int = 1024) -> tuple[int, float]:
    """(number of cells to visit, share of the partners it finds) on partners made at the threshold and true ones in the sample.

    A partner is found from either side. Each kind of partner alone reaches the recall."""
    x = sample[:asked]
    home = index.cells(x)
    rng = np.random.default_rng(7)
    kinds = [np.full(len(x), 0.5), rng.random(len(x)), np.ones(len(x)), np.zeros(len(x))] if x.shape[1] > 1 else [np.ones(len(x))]
    ranks = []
    for k, share in enumerate(kinds):
        y = made_partners(x, cosine, share, 11 + k)
        ranks.append(np.minimum(index.ranks(x, index.cells(y)), index.ranks(y, home)))
    close = x @ sample.T >= cosine
    close[np.arange(len(x)), np.arange(len(x))] = False
    i, j = np.nonzero(close)
    if len(i) > 20_000:
        some = rng.choice(len(i), 20_000, replace=False)
        i, j = i[some], j[some]
    if len(i):
        ranks.append(np.minimum(index.ranks(x[i], index.cells(sample[j])), index.ranks(sample[j], home[i])))
    needed = max(int(np.quantile(r, recall, method="higher")) for r in ranks)
    return needed, float(min((r <= needed).mean() for r in ranks))


def _kind(vectors: DataFrame, embedding: str) -> str:
    """How components are kept: as in the column where these are floats."""
    return "<f4" if vectors.schema[embedding].dataType.elementType.typeName() == "float" else "<f8"


def _valid(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """Rows with an id and a usable vector, as bytes of its components, with the class of equal ones."""
    kind = _kind(vectors, embedding)
    x = F.col(embedding).cast("array<double>")
    usable = (
        F.col(key).isNotNull()
        & F.col(embedding).isNotNull()
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    rows = vectors.filter(usable).select(F.col(key).cast("long").alias("id"), x.alias("x"))
    schema = pa.schema([("id", pa.int64()), ("class", pa.binary()), ("vector", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column("x")
            flat = (lists.flatten().to_numpy(zero_copy_only=False) + 0.0).astype(kind)  # -0.0 becomes 0.0
            ends = np.cumsum([0, *(len(x) for x in lists)])
            raw = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                schema=schema,
            )

    return rows.mapInArrow(pack, "id long, class binary, vector binary")


def _cells(index: Index, kind: str):
    schema = pa.schema([("cell", pa.int64())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                x = _unit(batch.column("vector").slice(first, 2048).to_pylist(), kind)
                yield pa.RecordBatch.from_arrays([pa.array(index.cells(x))], schema=schema)

    return cells


def _file(layout: Layout, kind: str, cosine: float, n_visits: int | None):
    """Vectors with the index of their cell, their block, and the cells they visit, all (``visits``) and by block (``guests``)."""
    guests = pa.list_(pa.struct([("block", pa.int64()), ("cells", pa.list_(pa.int32()))]))
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()), ("block", pa.int64()),
         ("visits", pa.list_(pa.int32())), ("guests", guests)]
    )

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                x = _unit(rows.column("vector").to_pylist(), kind)
                own, visits = layout.own(x), layout.visits(x, n_visits, cosine)
                by_block = []
                for cells in visits:
                    blocks = layout.block[cells]
                    order = np.argsort(blocks, kind="stable")
                    cells, blocks = cells[order], blocks[order]
                    starts = np.flatnonzero(np.r_[True, np.diff(blocks) != 0])
                    by_block.append(
                        [{"block": int(blocks[s]), "cells": cells[s:e].tolist()} for s, e in zip(starts, [*starts[1:], len(cells)])]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"), rows.column("n"), rows.column("vector"), pa.array(own, pa.int32()), pa.array(layout.block[own]),
                        pa.array([v.astype(np.int32) for v in visits], pa.list_(pa.int32())), pa.array(by_block, guests),
                    ],
                    schema=schema,
                )

    return file


def _verify(kind: str, cosine: float):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        """Counts of the links between a block's vectors and their visitors, and a spanning forest of them."""
        filed, visitors = group[~group["visiting"]], group[group["visiting"]]
        columns = ["id", "links", "other"]
        if not len(filed) or not len(visitors):
            return pd.DataFrame(columns=columns)
        ids, own = filed["id"].to_numpy(), visitors["id"].to_numpy()
        sizes, own_sizes = filed["n"].to_numpy(), visitors["n"].to_numpy()
        cell_of, home = filed["cell"].to_numpy(), visitors["cell"].to_numpy().astype(np.int64)
        x, y = _unit(visitors["vector"].tolist(), kind), _unit(filed["vector"].tolist(), kind)
        nodes, where = np.unique(np.r_[own, ids], return_inverse=True)
        of_own, of_filed, label = where[: len(own)], where[len(own) :], np.arange(len(nodes))
        links, found = np.zeros(len(nodes), np.int64), []
        # who visits which cell of this block; which cells the filed vectors visit, as (vector, cell) in one number
        guest = np.repeat(np.arange(len(own)), [len(c) for c in visitors["cells"]])
        visited = np.concatenate([np.asarray(c, np.int64) for c in visitors["cells"]])
        order = np.argsort(visited, kind="stable")
        guest, visited = guest[order], visited[order]
        span = int(max(visited.max(), home.max(), max((max(c) for c in filed["cells"] if len(c)), default=0))) + 1
        back = np.sort(np.concatenate([k * span + np.asarray(c, np.int64) for k, c in enumerate(filed["cells"])]))
        by_cell = np.argsort(cell_of, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(cell_of[by_cell]) != 0])
        for s, e in zip(starts, [*starts[1:], len(by_cell)]):
            members = by_cell[s:e]
            cell = cell_of[members[0]]
            here = guest[np.searchsorted(visited, cell, "left") : np.searchsorted(visited, cell, "right")]
            step = max(1, 4_000_000 // len(members))
            for first in range(0, len(here), step):
                part = here[first : first + step]
                q, r = np.nonzero(x[part] @ y[members].T >= cosine)
                q, r = part[q], members[r]
                # where the filed vector visits the visitor's cell too, the pair meets twice and counts for the smaller id
                keys = r * span + home[q]
                at = np.searchsorted(back, keys).clip(max=len(back) - 1)
                once = (back[at] != keys) | (own[q] < ids[r])
                q, r = q[once & (own[q] != ids[r])], r[once & (own[q] != ids[r])]
                np.add.at(links, of_own[q], sizes[r])
                np.add.at(links, of_filed[r], own_sizes[q])
                apart = label[of_own[q]] != label[of_filed[r]]
                while apart.any():
                    q, r = q[apart], r[apart]
                    found.append((own[q[0]], ids[r[0]]))
                    label[label == label[of_filed[r[0]]]] = label[of_own[q[0]]]
                    apart = label[of_own[q]] != label[of_filed[r]]
        some = links > 0
        counts = pd.DataFrame({"id": nodes[some], "links": links[some], "other": pd.array([None] * some.sum(), "Int64")})
        edges = pd.DataFrame(found, columns=["id", "other"], dtype="int64").assign(links=0)
        return pd.concat([counts, edges[columns].astype({"other": "Int64"})])

    return verify


def _links(reps: DataFrame, kind: str, cosine: float, recall: float, per_cell: int, max_codewords: int, sample: int, block: int) -> DataFrame:
    """Links among different vectors of one length (``id``, ``class``, ``n``, ``vector``): rows (id, links) and (id, other)."""
    total = reps.count()
    picked = reps.orderBy(F.xxhash64("class"), "id").select("vector").limit(sample).collect()
    x = _unit([bytes(r["vector"]) for r in picked], kind)
    index = Index.fit(x, int(np.clip(round((total / per_cell) ** 0.5), 1, max_codewords)))
    n_visits = None if recall >= 1 else measured_visits(index, x, cosine, recall)[0]
    # larger blocks are copied less often; 8 give enough tasks, and a task holds two of them
    size = int(np.clip(min(total // 8, 8_000_000 // x.shape[1]), block, 8 * block))
    counts = reps.select("vector").mapInArrow(_cells(index, kind), "cell long").groupBy("cell").count().toPandas().sort_values("cell")
    layout = Layout(index, counts["cell"].to_numpy("int64"), counts["count"].to_numpy("int64"), size)
    schema = "id long, n long, vector binary, cell int, block long, visits array<int>, guests array<struct<block: long, cells: array<int>>>"
    filed = stored(reps.select("id", "n", "vector").mapInArrow(_file(layout, kind, cosine, n_visits), schema))
    guests = filed.select("id", F.explode("guests.block").alias("block"))
    blocks = stored(
        filed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("rows"))
        .join(guests.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("columns")), "block")
    )

    def dealt(rows: DataFrame, own: str, other: str, visiting: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("id", F.lit(visiting)), F.col(own)).cast("int")
        return rows.join(blocks, "block").select(
            "id", "n", "vector", "cell", "cells", "block", F.lit(visiting).alias("visiting"), mine.alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
        ).select("id", "n", "vector", "cell", "cells", "visiting", "block", "rows", "columns")

    members = dealt(filed.select("id", "n", "vector", "cell", F.col("visits").alias("cells"), "block"), "rows", "columns", False)
    visitors = filed.select("id", "n", "vector", "cell", F.explode("guests").alias("g")).select("id", "n", "vector", "cell", "g.cells", "g.block")
    visitors = dealt(visitors, "columns", "rows", True)
    return members.unionByName(visitors).groupBy("block", "rows", "columns").applyInPandas(_verify(kind, cosine), "id long, links long, other long")


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    cosine: float = 0.95,
    recall: float = 0.999,
    per_cell: int = 32,
    max_codewords: int = 1024,
    sample: int = 20_000,
    block: int = 4096,
) -> DataFrame:
    """Per row: its id, ``n_links`` (other vectors linked), ``component_id`` (smallest id reachable), ``kept``.

    ``recall``: the share of partners at the threshold that the traversal must come to, as measured on at most ``sample``
    vectors; 1 takes all cells that can hold one."""
    kind = _kind(vectors, embedding)
    packed = stored(_valid(vectors, key, embedding))
    reps = stored(
        packed.groupBy("class").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    )
    lengths = reps.groupBy(F.octet_length("vector").alias("bytes")).count().where("count > 1").orderBy("bytes").collect()
    found = vectors.sparkSession.createDataFrame([], "id long, links long, other long")
    for row in lengths:  # vectors of different lengths do not link
        same = reps.where(F.octet_length("vector") == row["bytes"])
        found = found.unionByName(_links(same, kind, cosine, recall, per_cell, max_codewords, sample, block))
    found = stored(found)
    counts = found.filter("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    of_class = durable(
        reps.select("class", "id", "n").join(counts, "id", "left")
        .join(labels.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
        )
    )
    linked = packed.select("id", "class").join(of_class, "class").select("id", "n_links", "component_id")
    of_id = linked.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows_ = vectors.select(F.col(key).cast("long").alias("_key")).join(of_id, F.col("_key") == F.col("id"), "left")
    component = F.coalesce("component_id", "_key")
    return rows_.select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("_key") == component, F.lit(True)).alias("kept"),
    )
