"""Periodic runs of words: online sparse diagonal DP.

Words are taken from left to right. A word's earlier occurrence ``q`` words before it lies on diagonal ``q``; where
the next word repeats on the same diagonal, the diagonal's match length grows by one, and when it does not, the
diagonal ends and, if long enough, gives its run at once.

Following every earlier occurrence would take the square of a word's count. The DP is sparse: per context length
``L`` (1, 2, 4, ...) a word follows its *nearest* earlier occurrence with the same ``L`` words from it on, and only
for lags in ``(L/2, L]``. No run is lost by that: inside a run of smallest period ``q <= L`` the nearest such
occurrence is exactly ``q`` words back (a nearer one at ``d`` would give the stretch the periods ``d`` and ``q``, so
their common divisor too), and a run of at least ``4q`` words is longer than ``L + q``. A diagonal followed this way has
the smallest period of its stretch, for the same reason. A position whose context occurs once takes no part in
longer contexts, so plain text costs a few sorts, and any text ``n log n``.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LEAST_WORDS = 6
LEAST_PERIODS = 4
CHUNK_WORDS = 1 << 20  # documents are taken together up to so many words

RUNS = "array<struct<start: long, length: long, period: long>>"


def rewritten(words: list, doc_id: int | None) -> list:
    """The contract's change of a tenth of the documents: from word ``a`` on, period ``p``."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def diagonals(names: np.ndarray, least_words: int, least_periods: int) -> np.ndarray:
    """Runs ``(start, length, period)`` in a sequence of word names, by start and period.

    ``names`` holds several documents; words of different documents have different names, and a name that
    occurs nowhere else stands between two documents.
    """
    n = len(names)
    found = []
    size = 1
    at = np.arange(n)  # positions whose context of ``size`` words occurs more than once
    key = names.astype(np.int64)
    name = np.full(n, -1, np.int64)
    while len(at):
        order = np.argsort(key, kind="stable")  # equal contexts stand together, in text order
        key, place = key[order], at[order]
        same = key[1:] == key[:-1]
        again = np.concatenate(([False], same))
        repeated = again | np.concatenate((same, [False]))
        number = np.cumsum(~again)
        lag = np.where(again, place - np.concatenate((place[:1], place[:-1])), 0)
        lag[(lag > size) | (2 * lag <= size)] = 0
        here = lag > 0
        i, q = place[here], lag[here]
        order = np.argsort(i, kind="stable")
        i, q = i[order], q[order]
        if len(i):  # a diagonal goes on while the next word has the same lag
            ends = np.flatnonzero((np.diff(i) != 1) | (np.diff(q) != 0))
            first = np.concatenate(([0], ends + 1))
            last = np.concatenate((ends, [len(i) - 1]))
            matched = i[last] - i[first] + size
            period = q[first]
            length = matched + period
            enough = length >= np.maximum(least_words, least_periods * period)
            if enough.any():
                found.append(np.stack([i[first] - period, length, period], 1)[enough])
        name[place] = np.where(repeated, number, -1)
        at = np.sort(place[repeated])
        at = at[at + size < n]
        after = name[at + size]
        at, after = at[after >= 0], after[after >= 0]
        key = name[at] * (n + 1) + after
        name = np.full(n, -1, np.int64)
        size *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def find_runs(docs: DataFrame, *, rewrite: bool = False, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``runs`` by start and period, and ``collapsed``, the
    text without what repeats (every word that a run holds after its first period).

    A run is a stretch of words with smallest period ``q``, at least ``least_words`` and ``least_periods * q`` long,
    that no neighbour extends. ``rewrite`` applies the change of the query's contract first. Narrow: no
    shuffle; a task holds ``CHUNK_WORDS`` words, or one document if that is longer.

    A null text is empty and has no runs; repeated rows each give their row; a null ``doc_id`` is
    kept and never rewritten; columns other than the two are not read. No rows give no rows.
    """
    if least_periods < 3:
        raise ValueError("fewer than three periods are not found")  # the proof needs length >= L + q

    def solve(held: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        numbers: defaultdict = defaultdict(itertools.count().__next__)
        parts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for _, words in held]
        starts = np.concatenate(([0], np.cumsum([len(part) + 1 for part in parts])))
        names = np.empty(starts[-1], np.int64)
        for d, part in enumerate(parts):  # words of each document have names of their own, and so has its end
            names[starts[d] : starts[d + 1] - 1] = part + d * (len(numbers) + 1)
            names[starts[d + 1] - 1] = (d + 1) * (len(numbers) + 1) - 1
        own: list[list[tuple[int, int, int]]] = [[] for _ in held]
        found = diagonals(names, least_words, least_periods)
        for d, (s, n, q) in zip((np.searchsorted(starts, found[:, 0], side="right") - 1).tolist(), found.tolist()):
            own[d].append((s - int(starts[d]), n, q))
        fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc_id for doc_id, _ in held], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in own], pa.list_(pa.struct(fields))),
                pa.array([collapsed(words, runs).decode() for (_, words), runs in zip(held, own)], pa.string()),
            ],
            names=["doc_id", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").encode().split()  # bytes are split at \x20 and \x09-\x0D only
                if rewrite:
                    words = rewritten(words, doc_id)
                if held and size + len(words) > CHUNK_WORDS:
                    yield solve(held)
                    held, size = [], 0
                held.append((doc_id, words))
                size += len(words) + 1
        if held:
            yield solve(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs`` the number of runs, the one of the greatest exponent, and hashes of runs and text."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate(  # by start and period: the first of equals stays
        "runs",
        none,
        lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top),
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
