"""Packing by deficit round-robin over source queues (operator 1).

Each source is a queue of token ids. In every round each queue's deficit grows by its quantum, its
target share of one window, and the queue is served as many whole tokens as its deficit covers;
the rest is carried to the next round. A queue whose quantum is small waits until ``least`` tokens
are due, so documents are not shredded. The served tokens follow each other in one stream that is cut
into windows of ``length``; nothing is padded but the last window. A queue that has run dry is passed
over, and the others go on in their proportions. Targets default to the sources' shares of all tokens.

After ``r`` rounds a queue has been served ``min(total, floor(quantum * due rounds))`` tokens. This
closed form carries the deficits over any number of windows and partitions: where a token goes
follows from its place in its queue and the totals of the queues. So the work is

1. tokenise every document once and store the ids with their place in the task's part of the queue;
2. add up the tokens per (part, queue), a small table, into the place of each part in its queue;
3. cut the stored documents where rounds and windows end, task by task.

The ids are stored once and never shuffled or collected; a source with a third of all rows is just a
longer queue. The totals per queue are one row per queue on the driver: at most ``max_queues``;
if there are more sources, the smallest share the last queue and its joint target.

Defined results: a null or empty text is the end id alone; a null source is a queue of its own;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.llm.common import stored
from odolog.llm.tokens import Encoder

IDS = "part long, queue string, key long, tokens long, before long, ids binary"
PIECES = (
    "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _tokeniser(path: str, end_id: int):
    schema = _schema(IDS)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, before = TaskContext.get().partitionId(), Encoder(path, end_id), {}
        width = encoder.dtype.itemsize
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                queues = rows.column("queue").to_pylist()
                ids = [encoder.document(t) for t in rows.column("text").to_pylist()]
                counts = [len(x) // width for x in ids]
                places = []
                for queue, n in zip(queues, counts):
                    places.append(before.get(queue, 0))
                    before[queue] = places[-1] + n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ids), pa.int64()), rows.column("queue").cast(pa.string()), rows.column("key"),
                        pa.array(counts, pa.int64()), pa.array(places, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    schema=schema,
                )

    return tokenise


@dataclass(frozen=True)
class Queues:
    """Totals and targets of all queues, in the order they are served in."""

    names: list[str | None]
    totals: np.ndarray
    quanta: np.ndarray
    every: np.ndarray  # rounds between two services of a queue

    @staticmethod
    def of(totals: dict[str | None, int], shares: dict[str | None, float], length: int, least: int) -> Queues:
        names = sorted(totals, key=lambda q: (q is None, q or ""))
        wanted = np.array([float(shares.get(q, 0.0)) for q in names])
        if len(names) and wanted.sum() <= 0:
            raise ValueError("no source has a positive target share")
        # a queue without a target still has to be emptied: it is served last, after all others
        quanta = length * wanted / max(wanted.sum(), 1e-300)
        every = np.where(quanta > 0, np.maximum(1, np.ceil(least / np.maximum(quanta, 1e-12))), 1).astype(np.int64)
        return Queues(names, np.array([totals[q] for q in names], np.int64), quanta, every)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens each queue (column) has been served after each number of rounds (row)."""
        due = np.floor_divide(rounds[:, None], self.every[None, :]) * self.every[None, :]
        return np.minimum(self.totals[None, :], np.floor(self.quanta[None, :] * due).astype(np.int64))

    def rounds_for(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """First number of rounds after which more than ``tokens`` of a queue are served."""
        every, quantum = self.every[queue], self.quanta[queue]
        k = np.maximum(1, np.floor((tokens + 1) / (quantum * every)).astype(np.int64))
        for step in (-1, 0, 1, 2):  # floor() of doubles may be off by one
            fits = np.floor(quantum * (every * (k + step))).astype(np.int64) > tokens
            if step == -1:
                best = np.where(fits, k - 1, np.int64(-1))
            else:
                best = np.where((best < 0) & fits, k + step, best)
        return best * every

    def cut(self, queue: int, place: int, tokens: int, length: int) -> list[tuple[int, int, int]]:
        """Pieces (start, end, position in the stream) of a document at ``place`` in its queue."""
        if self.quanta[queue] <= 0:
            rest = [i for i in range(len(self.names)) if self.quanta[i] <= 0 and i < queue]
            base = int(self.totals[self.quanta > 0].sum()) + int(self.totals[rest].sum())
            starts, at = np.array([0], np.int64), np.array([base + place], np.int64)
        else:
            first, last = self.rounds_for(queue, np.array([place, place + tokens - 1], np.int64))
            every = int(self.every[queue])
            rounds = np.arange(first, last + 1, every, dtype=np.int64)
            earlier = self.served(rounds - 1)
            begins = earlier[:, queue]
            # before this service: all queues after the round before, and those served earlier in this round
            ahead = self.served(rounds)[:, :queue].sum(axis=1) - earlier[:, :queue].sum(axis=1)
            stream = earlier.sum(axis=1) + ahead
            starts = np.maximum(begins - place, 0)
            at = stream + (starts + place - begins)
        ends = np.append(starts[1:], tokens)
        pieces = []
        for s, e, p in zip(starts.tolist(), ends.tolist(), at.tolist()):
            while s < e:
                n = min(e - s, length - p % length)
                if pieces and pieces[-1][1] == s and pieces[-1][2] + s - pieces[-1][0] == p and p % length:
                    pieces[-1] = (pieces[-1][0], s + n, pieces[-1][2])
                else:
                    pieces.append((s, s + n, p))
                s, p = s + n, p + n
        return pieces


def _packer(queues: Queues, length: int, dtype: str):
    schema = _schema(PIECES)
    number = {q: i for i, q in enumerate(queues.names)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("queue", "key", "tokens", "place", "ids")]
            out: list[tuple] = []
            for queue, key, tokens, place, ids in zip(*columns):
                wide = np.frombuffer(ids, dtype).astype("<u4")
                for s, e, p in queues.cut(number[queue], place, tokens, length):
                    out.append((key, s, e - s, zlib.crc32(wide[s:e]), tokens, p // length, p % length))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, schema=schema)

    return pack


def tokenised(
    docs: DataFrame, key: str, text: str, source: str, tokenizer: str, end_id: int
) -> DataFrame:
    """Stored ids of every document with its place in the task's part of its queue."""
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("queue"), F.col(text).alias("text")
    )
    return stored(rows.mapInArrow(_tokeniser(tokenizer, end_id), IDS))


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    length: int = 2048,
    shares: dict[str | None, float] | None = None,
    least: int = 64,
    max_queues: int = 1024,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """Pieces of documents: start, length, crc32 of the ids, tokens of the document, sequence, offset.

    ``shares`` are the target proportions of the sources; sources it leaves out come last. Of more than ``max_queues`` sources the
    smallest form one queue, with their shares added."""
    ids = tokenised(docs, key, text, source, tokenizer, end_id)
    parts = ids.groupBy("queue", "part").agg(F.sum("tokens").alias("n"))
    names = parts.groupBy("queue").agg(F.sum("n").alias("n"))
    largest = names.orderBy(F.desc("n"), "queue").limit(max_queues).collect()
    totals = {r["queue"]: r["n"] for r in largest}
    joint: Column = F.col("queue")
    if len(largest) == max_queues:  # the smallest of these and all that are smaller still are one queue
        last = largest[-1]["queue"]
        own = [r["queue"] for r in largest[:-1]]
        joint = F.when(F.col("queue").isin([q for q in own if q is not None]), F.col("queue"))
        joint = F.when(F.col("queue").isNull() & F.lit(None in own), F.col("queue")).otherwise(
            F.coalesce(joint, F.lit(last))
        )
        totals[last] = names.agg(F.sum("n")).first()[0] - sum(totals[q] for q in own)
    targets = shares if shares is not None else totals
    if shares is not None and len(largest) == max_queues:  # the joint queue has the shares of all its sources
        named = names.where(F.col("queue").isNull() | F.col("queue").isin([q for q in shares if q is not None])).collect()
        joined = {r["queue"] for r in named} - set(own)
        targets = {**shares, last: sum(share for q, share in shares.items() if q in joined)}
    queues = Queues.of(totals, targets, length, least)
    # place of each (part, source) in its queue
    queue_order = Window.partitionBy("_queue").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(
        parts.withColumn("_queue", joint)
        .withColumn("offset", F.coalesce(F.sum("n").over(queue_order), F.lit(0)))
        .select(F.col("queue").alias("_source"), F.col("part").alias("_part"), "_queue", "offset")
    )
    placed = ids.join(
        offsets, (F.col("part") == F.col("_part")) & F.col("queue").eqNullSafe(F.col("_source"))
    ).select(F.col("_queue").alias("queue"), "key", "tokens", (F.col("before") + F.col("offset")).alias("place"), "ids")
    dtype = Encoder(tokenizer, end_id).dtype.str
    pieces = placed.mapInArrow(_packer(queues, length, dtype), PIECES)
    return pieces.select(F.col("key").alias(key), *[c.split()[0] for c in PIECES.split(", ")[1:]])
