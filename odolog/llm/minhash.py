"""Near-duplicates by MinHash with sequential Bayesian verification (operator 7).

1. Each text becomes the set of its five-word shingles (as 64-bit hashes) and a MinHash signature.
   Texts with equal sets form a class; from here on only the smallest document of a class counts.
2. Bands of the signature put classes into buckets. Every member of a bucket is a candidate with the
   bucket's smallest document (its leader): a star, not all pairs.
3. Candidates are compared batch by batch of their signatures. After ``m`` equal values of ``n`` the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair is dropped as soon as the probability
   that it reaches the threshold is below ``miss``.
4. Survivors are confirmed on the full sets, and links become components.
5. A bucket that still holds several components may hide links that do not touch its leader. There,
   and only there, members of different components meet, signatures first, and the survivors are
   confirmed in the task, each pair in the first bucket it shares. Buckets are cut into blocks of
   bounded size and blocks meet in pairs, so no task holds more than two; a task returns the links
   that join components, not the pairs.

Texts move once for the documents in surviving pairs; signatures and sets are never collected. A
bucket, leader or class with a third of all rows is aggregated before the shuffle, split by adaptive
skew joins, or cut into blocks. With the default 25 bands of 5 a pair at the threshold of 0.85 misses
all bands with probability 4e-7, one at 0.9 with 6e-10.

Defined results: null, empty and blank texts have no shingles and no links; fewer than five words are
one shingle; rows with one id count as one document with several texts; a row without an id has no
links and no component and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from odolog.llm.common import components, stored
from odolog.session import durable

WORDS = 5
_U64 = np.uint64
_ODD = _U64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that all bits depend on all."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers the hashes of words it has seen."""

    KEEP = 500_000

    class _Words(dict):
        def __missing__(self, word: bytes) -> int:
            import xxhash

            value = self[word] = xxhash.xxh3_64_intdigest(word)
            return value

    def __init__(self):
        self.words = Shingler._Words()

    def __call__(self, text: bytes | None) -> np.ndarray:
        found = (text or b"").lower().split()  # bytes: lower-cases A-Z, splits at the six ASCII spaces
        if not found:
            return np.empty(0, _U64)
        if len(self.words) > self.KEEP:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, found), _U64, len(found))
        size = min(WORDS, len(found))
        out = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            out *= _ODD
            out += h[k : len(h) - size + 1 + k]
        return np.unique(_mixed(out + _U64(size)))


class Hashes:
    """``n`` hash functions for MinHash."""

    def __init__(self, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 63, n, dtype=np.int64).astype(_U64) * _U64(2) + _U64(1)
        self.b = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(_U64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, _U64)
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048, None] * self.a[None, :] + self.b[None, :]
            np.minimum(best, part.min(axis=0), out=best)
        return (best >> _U64(32)).astype("<u4")


def sketcher(n_hashes: int):
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, hashes = Shingler(), Hashes(n_hashes)
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                sizes, classes, signatures = [], [], []
                for text in rows.column("text").to_pylist():
                    found = shingler(text)
                    sizes.append(len(found))
                    classes.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    signatures.append(hashes.signature(found).tobytes() if len(found) else None)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())],
                    schema=schema,
                )

    return sketch


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest equal values of ``n`` with which a pair still reaches ``threshold`` with probability ``miss``.

    P(S >= t) under Beta(m + 1, n - m + 1) is the probability of at most m successes in n + 1 trials of t."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that pass every batch, and their equal values."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    start = 0
    for end, least in bounds:
        equal = equal + (a[alive, start:end] == b[alive, start:end]).sum(axis=1)
        passed = equal >= least
        alive, equal, start = alive[passed], equal[passed], end
    return alive, equal


def _bounds(n_hashes: int, threshold: float, miss: float, batch: int) -> list[tuple[int, int]]:
    ends = [*range(batch, n_hashes, batch), n_hashes]
    return [(n, least_matches(n, threshold, miss)) for n in ends]


def _matrix(signatures) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u4").reshape(len(signatures), -1)


def _prune(bounds: list[tuple[int, int]]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (_matrix(batch.column(c).to_pylist()) for c in ("sig_a", "sig_b"))
                alive, _ = surviving(left, right, bounds)
                yield batch.select(["a", "b"]).take(pa.array(alive)).cast(schema)

    return prune


def _confirm(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last_text, last = Shingler(), None, None
        for batch in batches:
            linked = []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if last is None or text_a != last_text:
                    last_text, last = text_a, shingler(text_a)
                other = shingler(text_b)
                both = len(np.intersect1d(last, other, assume_unique=True))
                linked.append(bool(both) and 100 * both >= percent * (len(last) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_())).cast(schema)

    return confirm


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets reach the threshold. Texts of documents in no pair stay where they are."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stored(docs.join(ids, "id", "left_semi"))
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return durable(both.mapInArrow(_confirm(percent), "a long, b long").distinct())


def _sets():
    """Shingle sets as bytes, computed once per document."""
    schema = pa.schema([("id", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                found = [shingler(t).astype("<u8").tobytes() for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("signature"), pa.array(found, pa.binary())], schema=schema
                )

    return sets


def _across(bounds: list[tuple[int, int]], rows: int, percent: int):
    """Confirmed links between different components in a group of a bucket's members: those of its two
    blocks with each other or, in a group of one block, those of the block."""

    def across(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable").reset_index(drop=True)
        signatures, ids, labels = _matrix(group["signature"].tolist()), group["id"].to_numpy(), group["label"].to_numpy()
        first, stored_sets = group["first"].to_numpy(), group["shingles"]
        band, leader = int(group["band"].iloc[0]), group["leader"].iloc[0]
        keys = signatures.reshape(len(ids), -1, rows)[:, :band, :]  # of earlier bands
        one, order = first.all() or not first.any(), np.arange(len(ids))
        sets: dict[int, frozenset[int]] = {}

        def shingles(i: int) -> frozenset[int]:
            if i not in sets:
                sets[i] = frozenset(np.frombuffer(stored_sets.iloc[i], "<u8").tolist())
            return sets[i]

        found = []
        for i in range(len(ids)):
            if ids[i] == leader or not (one or first[i]):
                continue  # its links are known; or it is met from the other block
            others = np.flatnonzero((labels != labels[i]) & (ids != leader) & (order > i if one else ~first))
            alive, equal = surviving(np.broadcast_to(signatures[i], (len(others), signatures.shape[1])), signatures[others], bounds)
            left = others[alive[np.argsort(-equal, kind="stable")]]
            left = left[~(keys[i] == keys[left]).all(axis=2).any(axis=1)]  # the others meet in an earlier band
            for k in left.tolist():
                if labels[k] == labels[i]:
                    continue  # joined meanwhile
                both = len(shingles(i) & shingles(k))
                if 100 * both >= percent * (len(sets[i]) + len(sets[k]) - both):
                    found.append((ids[i], ids[k]))
                    labels[labels == labels[k]] = labels[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return across


class Search:
    """Classes, buckets and signatures of a corpus, and the steps that link them."""

    def __init__(self, docs: DataFrame, key: str, text: str, percent: int, bands: int, rows: int, batch: int, miss: float, block: int):
        self.percent, self.bands, self.rows, self.block = percent, bands, rows, block
        self.bounds = _bounds(bands * rows, percent / 100, miss, batch)
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
        self.sketches = stored(
            self.docs.mapInArrow(sketcher(bands * rows), "id long, n_shingles long, class binary, signature binary")
        )
        named = self.sketches.filter("class is not null and id is not null")
        self.classes = durable(named.groupBy("class").agg(F.min("id").alias("id")))
        self.reps = stored(named.join(self.classes, ["class", "id"]).groupBy("id", "class").agg(F.first("signature").alias("signature")).select("id", "signature"))

    def buckets(self) -> DataFrame:
        width = 4 * self.rows
        keys = [F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(self.bands)]
        return self.reps.select("id", F.posexplode(F.array(*keys)).alias("band", "bucket"))

    def pruned(self, pairs: DataFrame) -> DataFrame:
        def side(name: str) -> DataFrame:
            return self.reps.select(F.col("id").alias(name), F.col("signature").alias(f"sig_{name}"))

        return durable(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(self.bounds), "a long, b long"))

    def stars(self) -> DataFrame:
        """Each member of a bucket with the bucket's smallest one."""
        buckets = self.buckets()
        self.leaders = durable(
            buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        )
        return durable(buckets.join(self.leaders, "bucket").filter("a != id").select("a", F.col("id").alias("b")).distinct())

    def hidden(self, labels: DataFrame) -> DataFrame:
        """Confirmed links between different components in buckets where the star cannot have seen all links.

        The members of a bucket's largest component need not meet each other: they are cut into blocks,
        which only the blocks of the other members visit."""
        wide = self.buckets().join(self.leaders.filter("n > 2").select("bucket", F.col("a").alias("leader")), "bucket")
        named = durable(
            wide.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
                "bucket", "band", "leader", "id", F.coalesce("component", "id").alias("label")
            )
        )
        sizes = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        layout = durable(
            sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
            .filter(F.col("top.n") < F.col("all"))
            .select(
                "bucket", F.col("top.label").alias("largest"),
                F.ceil((F.col("all") - F.col("top.n")) / F.lit(self.block)).cast("int").alias("few"),
                F.ceil(F.col("top.n") / F.lit(self.block)).cast("int").alias("many"),
            )
        )
        in_largest, h = F.col("label") == F.col("largest"), F.xxhash64("id", F.lit(5))
        own = F.when(in_largest, F.col("few") + F.pmod(h, F.col("many"))).otherwise(F.pmod(h, F.col("few"))).cast("int")
        last = F.when(in_largest, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
        met = named.join(layout, "bucket").select(
            "bucket", "band", "leader", "id", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other")
        ).select(
            "bucket", "band", "leader", "id", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
            (F.col("own") <= F.col("other")).alias("first"),
        )
        members = met.select("id").distinct()
        texts = self.docs.join(members, "id", "left_semi").dropDuplicates(["id"])
        sets = stored(self.reps.join(texts, "id").mapInArrow(_sets(), "id long, signature binary, shingles binary"))
        groups = met.join(sets, "id").groupBy("bucket", "lo", "hi")
        return durable(groups.applyInPandas(_across(self.bounds, self.rows, self.percent), "a long, b long"))

    def links(self) -> DataFrame:
        """Confirmed links that connect everything that is connected."""
        found = confirmed(self.pruned(self.stars()), self.docs, self.percent)
        return found.unionByName(self.hidden(components(found)))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = 85,
    bands: int = 25,
    rows: int = 5,
    batch: int = 25,
    miss: float = 1e-6,
    block: int = 256,
) -> DataFrame:
    """Per row: its id, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` (it is that one)."""
    search = Search(docs, key, text, percent, bands, rows, batch, miss, block)
    labels = components(search.links())
    of_class = search.classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        "class", F.coalesce("component", "id").alias("component_id")
    )
    # an id may have several texts, in several classes: its smallest component counts for all of them
    rows_ = search.sketches.select("id", "n_shingles", "class").join(durable(of_class), "class", "left")
    component: Column = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows_.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without all but the smallest document of each component."""
    kept = near_duplicates(docs, key, text, **options).filter("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
