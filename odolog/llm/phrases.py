"""Phrase collocation mining: dynamic itemset counting over cyclic shard scans.

The texts are dealt into shards, which are scanned in turn, again and again; a step is one scan. Words are
counted from the first step on. A longer phrase becomes active in the step after both its subphrases (without
its last and without its first word) have reached the threshold, wherever the cycle stands then, and is
counted for exactly one full cycle, so each of its occurrences counts once. Steps end when no phrase is active.

The texts are read once. Shards hold them as 64-bit hashes of words, so no later step splits or decodes text; the different words of
some megabytes of texts at a time are kept beside them. Phrases are counted by a hash of those. Which phrases have reached the threshold is
told to the tasks by a filter of bounded size (a Bloom filter, ``filter_bytes``). It only gains phrases; step ``t`` counts what both
subphrases in the filter of step ``t`` activate, unless the filter of a cycle earlier did so already. A phrase let in by chance, by the
filter or by equal hashes, is counted for one full cycle as well: chance can activate more, never less.

Collocations are ranked by those counts. The phrases, as hashes of their words, are found by reading parts of the shards, each for the
phrases that have not been met, and their words likewise, so that few tasks return a phrase. A last scan then counts the ranked phrases
and all their parts by their words, and only counts that it confirms are returned, if no other word of the texts has the hash of one of
theirs; otherwise every phrase of the last filter is counted by its words and ranked again, with other hashes should words share one.
Counts of other phrases, which decide what is ranked, are by hash: a wrong one takes two words or phrases with equal 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.llm.common import shared_folder, stored

LONGEST = 5
LEAST_COUNT = 100
SHARDS = 2
FILTER_BYTES = (1 << 16, 1 << 25)  # least and most of the filter that every task holds twice; no size changes the result
BUFFER_WORDS = 1 << 20  # words a task counts at a time
BLOCK_WORDS = 1 << 15  # words in a row of a shard
GROUP_ROWS = 32  # rows of shards that a task holds at a time, as a reader decodes a row group at once
BATCH_BYTES = 1 << 23  # sent to Python at a time
SLICE_BYTES = 1 << 23
LONG_WORD = 64  # bytes; longer ones are hashed one by one
PARTS = 64  # of the blocks, by which phrases are named; a power of four
LEAST_SCORES = 2000

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"." * len(_ENDS) + b" ")


def _in_small_batches(made: Callable) -> Callable:
    """``made`` with rows sent to Python some megabytes at a time: both sides hold a batch, and Java doubles its buffers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(made)
    def run(docs: DataFrame, **options):
        conf = docs.sparkSession.conf
        before = conf.get(name, None)
        conf.set(name, str(BATCH_BYTES))
        try:
            return made(docs, **options)
        finally:
            conf.unset(name) if before is None else conf.set(name, before)

    return run


def _slices(text: str) -> Iterator[bytes]:
    """A text with words and ends of pieces (``.``) between blanks, some megabytes at a time."""
    raw = text.encode().translate(_TABLE) + b"."
    at = 0
    while at < len(raw):
        end = at
        while True:  # not within a word, however long
            end = min(len(raw), end + SLICE_BYTES)
            stop = max(raw.rfind(b" ", at, end), raw.rfind(b".", at, end)) + 1
            if end == len(raw) or stop > at:
                break
        end = end if end == len(raw) else stop
        yield raw[at:end].replace(b".", b" . ")
        at = end


def _split(texts: list[bytes]) -> pa.ListArray:
    """Words of each text in order."""
    texts = pa.array([t.strip(b" ") or None for t in texts], pa.large_binary())
    return pc.ascii_split_whitespace(texts.view(pa.large_string()))


def _key(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=str(seed).encode()).digest(), "little")


def _hashes(words: pa.LargeStringArray, key: int) -> np.ndarray:
    """64-bit hash of each word, eight bytes at a time, by a language's ``key``; 0 stands for the end of a piece only."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = bytes(words.buffers()[2] or b"")[: ends[-1]] + bytes(8)
    eights = np.ndarray(len(raw) - 7, np.uint64, raw, strides=(1,))
    start, size = ends[:-1], np.diff(ends)
    h = np.uint64(key) + size.astype(np.uint64)
    some = np.flatnonzero(size)
    for i in range(0, LONG_WORD, 8):
        some = some[size[some] > i]
        if not len(some):
            break
        spare = np.maximum(0, 8 - (size[some] - i)).astype(np.uint64) * np.uint64(8)
        x = (h[some] ^ (eights[start[some] + i] << spare)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        h[some] = x ^ (x >> np.uint64(29))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        digest = hashlib.blake2b(raw[start[i] : start[i] + size[i]], digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(digest, "little")
    h[h == 0] = 1
    h[np.flatnonzero((size == 1) & (eights[start] & np.uint64(0xFF) == ord(".")))] = 0
    return h


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but the last word and of the last word (unsigned 64-bit)."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + right
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


_PLACES = (32, 38, 44, 50, 56)  # of the hash bits that choose the five bits of a phrase in its word of the filter


def _holds(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    need = reduce(np.bitwise_or, (np.uint64(1) << ((h >> np.uint64(s)) & np.uint64(63)) for s in _PLACES))
    return (bloom[(h & np.uint64(len(bloom) - 1)).astype(np.int64)] & need) == need


def _filter_bits(h: Column) -> Column:
    """The five bits as a column."""
    places = [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int") for s in _PLACES]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])


def _deal(rows: DataFrame, longest: int, seed: int) -> DataFrame:
    """``lang``, ``text``, ``shard`` as blocks of word hashes: ``shard``, ``words`` (little-endian) and ``own``, the number of
    words at which phrases of this block begin; what follows them belongs to the next block of a long text. A row of
    shard -1 has the number of a language's words in ``own``, one of shard -2 different words of a language in ``words``, with
    blanks between. ``part`` deals the rows at random into ``PARTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, list[np.ndarray]] = defaultdict(list)
        sizes: defaultdict[int, int] = defaultdict(int)
        totals: defaultdict[str, int] = defaultdict(int)
        texts: defaultdict[str, defaultdict[int, list[bytes]]] = defaultdict(lambda: defaultdict(list))

        def row(shard: int, words: bytes, own: int, lang: str | None = None) -> pa.RecordBatch:
            cells = [pa.array([shard], pa.int32()), pa.array([zlib.crc32(words) % PARTS], pa.int32()), pa.array([lang], pa.string())]
            cells += [pa.array([words], pa.binary()), pa.array([own], pa.int64())]
            return pa.RecordBatch.from_arrays(cells, names=["shard", "part", "lang", "words", "own"])

        def blocks(shard: int, least: int) -> Iterator[pa.RecordBatch]:
            words, begin = np.concatenate(held[shard]), 0
            while len(words) - begin >= least:
                yield row(shard, words[begin : begin + BLOCK_WORDS + longest - 1].tobytes(), BLOCK_WORDS)
                begin += BLOCK_WORDS
            held[shard], sizes[shard] = [words[begin:].copy()], len(words) - begin

        def hashed() -> Iterator[pa.RecordBatch]:
            for lang, by_shard in texts.items():
                split = _split([b"".join(t) for t in by_shard.values()])
                words = split.flatten().dictionary_encode()
                hashes = _hashes(words.dictionary, _key(lang, seed))
                for i in range(0, len(hashes), BLOCK_WORDS):
                    yield row(-2, " ".join(words.dictionary[i : i + BLOCK_WORDS].to_pylist()).encode(), 0, lang)
                hashes, at = hashes[words.indices.to_numpy()], 0
                totals[lang] += int(np.count_nonzero(hashes))
                for shard, n in zip(by_shard, pc.list_value_length(split).fill_null(0).to_pylist()):
                    held[shard].append(hashes[at : at + n])
                    sizes[shard] += n
                    at += n
                    if sizes[shard] >= 2 * BLOCK_WORDS:
                        yield from blocks(shard, 2 * BLOCK_WORDS)
            texts.clear()

        size = 0
        for batch in batches:
            for lang, text, shard in zip(*(c.to_pylist() for c in batch.columns)):
                cut = False
                for part in _slices(text):
                    texts[lang][shard].append(part)
                    size += len(part)
                    if size >= SLICE_BYTES:
                        yield from hashed()
                        size, cut = 0, True
                if cut and size:  # what begins a long text is followed by its rest
                    yield from hashed()
                    size = 0
        yield from hashed()
        for shard in held:
            yield from blocks(shard, BLOCK_WORDS + 1)
            yield row(shard, held[shard][0].tobytes(), sizes[shard])
        for lang, n in totals.items():
            yield row(-1, b"", n, lang)

    return rows.select("lang", "text", "shard").mapInArrow(run, "shard int, part int, lang string, words binary, own long")


@dataclass(frozen=True)
class _Dealt:
    """Texts as blocks of word hashes by shard, the number of words of each language, and the different words of parts of the texts."""

    blocks: DataFrame
    totals: DataFrame
    vocabulary: DataFrame
    seed: int


def _dealt(docs: DataFrame, shards: int, longest: int, seed: int = 0) -> _Dealt:
    folder = f"{shared_folder(docs.sparkSession)}/shards"
    shard = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    rows = _deal(_rows(docs).withColumn("shard", shard), longest, seed)
    rows.write.option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS).partitionBy("shard").parquet(folder)
    written = docs.sparkSession.read.schema("part int, lang string, words binary, own long, shard int").parquet(folder)
    totals = written.where("shard = -1").groupBy("lang").agg(F.sum("own").alias("n"))
    return _Dealt(written.where("shard >= 0"), totals, written.where("shard = -2"), seed)


def _active(
    words: np.ndarray, own: int, now: np.ndarray, before: np.ndarray, longest: int, with_words: bool
) -> Iterator[np.ndarray]:
    """Hashes of the active phrases that begin at the first ``own`` words of a block, by length."""
    at = np.flatnonzero(words)
    yield words[at[: np.searchsorted(at, own)]] if with_words else at[:0].view(np.uint64)
    hashes = words[at]
    for length in range(2, longest + 1):
        again = _holds(now, hashes)
        at, hashes = at[again], hashes[again]  # where the phrase of the length before is frequent
        done = _holds(before, hashes)  # and was so a cycle ago
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        complete = done[1:][follows] & done[:-1][follows]
        at = at[follows]
        hashes = _mixed(hashes[follows], words[at + length - 1])
        yield hashes[~complete & (at < own)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """``words`` and ``own``."""
    for batch in batches:
        for raw, n in zip(batch.column(0), batch.column(1).to_pylist()):
            yield np.frombuffer(raw.as_buffer(), np.uint64), n


def _starts(n: int, columns: Iterator[np.ndarray]) -> np.ndarray:
    """Where runs of equal values begin in columns of ``n``, which are looked at one by one."""
    first = np.zeros(n, bool)
    first[:1] = True
    for x in columns:
        first[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(first)


def _counted(
    batches: Iterator[pa.RecordBatch], now: np.ndarray, before: np.ndarray, longest: int, with_words: bool
) -> Iterator[pa.RecordBatch]:
    """Of blocks only the hashes of active phrases are held, until ``BUFFER_WORDS`` words are read."""
    held: list[list[np.ndarray]] = [[] for _ in range(longest)]
    size = 0

    def summed() -> Iterator[pa.RecordBatch]:
        for hashes in held:
            if not hashes:
                continue
            h = np.concatenate(hashes)
            hashes.clear()
            h.sort()
            begin = _starts(len(h), [h])
            for i in range(0, len(begin), 1 << 17):
                part = begin[i : i + (1 << 17)]
                c = np.diff(part, append=begin[i + len(part)] if i + len(part) < len(begin) else len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(c)], names=["h", "c"])

    for words, own in _blocks(batches):
        for hashes, more in zip(held, _active(words, own, now, before, longest, with_words)):
            hashes.append(more)
        size += len(words)
        if size > BUFFER_WORDS:
            yield from summed()
            size = 0
    yield from summed()


def _scan(shard: DataFrame, now: Broadcast, before: Broadcast, longest: int, with_words: bool) -> DataFrame:
    """Counts ``c`` of the active phrases in blocks of words by hash ``h``, summed as far as a task's memory is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, now.value, before.value, longest, with_words)

    return shard.select("words", "own").mapInArrow(run, "h long, c long")


def _places(
    words: np.ndarray, own: int, begin: int, known: np.ndarray, longest: int, wanted: np.ndarray | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where the phrases of ``known`` begin in a block, from ``begin`` on, and their hashes, by length."""
    at = np.flatnonzero(words)
    hashed = words[at]
    for length in range(1, longest + 1):
        again = _holds(known, hashed)
        at, hashed = at[again], hashed[again]
        mine = np.searchsorted(at, own)
        found = slice(mine) if wanted is None else np.flatnonzero(_holds(wanted, hashed[:mine]))
        yield at[found] + begin, hashed[found]
        if length < longest:
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            at = at[follows]
            hashed = _mixed(hashed[follows], words[at + length])


def _words_of(
    batches: Iterator[pa.RecordBatch], known: np.ndarray, longest: int, wanted: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Of ``BUFFER_WORDS`` words at a time the phrases are counted length by length, so one length is held."""
    blocks: list[tuple[np.ndarray, int]] = []
    size = 0

    def summed() -> Iterator[pa.RecordBatch]:
        words = np.concatenate([w for w, _ in blocks])
        begins = np.cumsum([0, *(len(w) for w, _ in blocks)]).tolist()
        owns = [own for _, own in blocks]
        blocks.clear()
        each = [_places(words[a:b], own, a, known, longest, wanted) for (a, b), own in zip(itertools.pairwise(begins), owns)]
        for length in range(1, longest + 1):
            at, key = (np.concatenate(x) for x in zip(*map(next, each)))
            order = np.argsort(key)
            at = at[order]
            key = key[order]
            del order
            begin = _starts(len(key), itertools.chain([key], (words[at + i] for i in range(length if length > 1 else 0))))
            for i in range(0, len(begin), 50_000):
                part = begin[i : i + 50_000]
                c = np.diff(part, append=begin[i + len(part)] if i + len(part) < len(begin) else len(at))
                spelled = words[at[part][:, None] + np.arange(length)].view(np.int64).ravel()
                cells = [pa.array(np.full(len(part), length, np.int32))]
                cells += [pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * length), pa.array(spelled))]
                cells += [pa.array(key[part].view(np.int64)), pa.array(c)]
                yield pa.RecordBatch.from_arrays(cells, names=["length", "w", "h", "c"])
            del at, key, begin

    for words, own in _blocks(batches):
        blocks.append((words.copy(), own))  # apart from the batch
        size += len(words)
        if size > BUFFER_WORDS:
            yield from summed()
            size = 0
    if blocks:
        yield from summed()


def _named(blocks: DataFrame, known: Broadcast, longest: int, wanted: Broadcast | None = None) -> DataFrame:
    """Counts ``c`` of the phrases of ``known`` (a filter that has their parts as well) in ``blocks``, by the hashes of their words, ``w``,
    with their ``length`` and hash ``h``. With ``wanted`` only of the phrases in that one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _words_of(batches, known.value, longest, wanted and wanted.value)

    return blocks.select("words", "own").mapInArrow(run, "length int, w array<bigint>, h long, c long")


def _spelled(vocabulary: DataFrame, wanted: Broadcast, seed: int) -> DataFrame:
    """``lang`` and ``word`` of the hashes ``h`` in the filter ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, raw in zip(*(c.to_pylist() for c in batch.columns)):
                words = _split([raw]).flatten()
                h = _hashes(words, _key(lang, seed))
                some = np.flatnonzero(_holds(wanted.value, h) & (h > 0))
                cells = [pa.array(h[some].view(np.int64)), pa.array([lang] * len(some), pa.string()), words.take(some).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cells, names=["h", "lang", "word"])

    return vocabulary.select("lang", "words").mapInArrow(run, "h long, lang string, word string").distinct()


def _added(bloom: np.ndarray, hashes: DataFrame) -> np.ndarray:
    """``bloom`` with the hashes ``h`` added. At most one row per word of the filter reaches the driver."""
    word = F.col("h").bitwiseAND(F.lit(len(bloom) - 1))
    rows = hashes.groupBy(word.alias("i")).agg(F.bit_or(_filter_bits(F.col("h"))).alias("m")).toArrow()
    out = bloom.copy()
    out[rows["i"].to_numpy()] |= rows["m"].to_numpy().view(np.uint64)
    return out


def _filter(hashes: DataFrame) -> np.ndarray:
    """A filter of the hashes ``h``, of 16 to 32 bits for each as far as ``FILTER_BYTES`` allows."""
    size = min(FILTER_BYTES[1], max(FILTER_BYTES[0], 2 << hashes.count().bit_length()))
    return _added(np.zeros(size // 8, np.uint64), hashes)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _met(rows: DataFrame, unmet: DataFrame, find: Callable[[DataFrame, Broadcast], DataFrame]) -> DataFrame:
    """``unmet``, by hash ``h``, with what ``find`` returns of it from ``rows``: a row for each that was met of a hash.

    The rows are read in ``PARTS`` parts, one, three, twelve and so on at a time, and each time for what has not been met. Common words
    and phrases are met in few rows, rare ones in few of many, so each is returned by few tasks at any size.
    """
    met: list[DataFrame] = []
    for a, b in itertools.pairwise([0, *(1 << i for i in range(0, PARTS.bit_length(), 2))]):
        wanted = rows.sparkSession.sparkContext.broadcast(_filter(unmet))
        met.append(stored(find(rows.where(F.col("part").between(a, b - 1)), wanted).join(unmet, "h")))
        wanted.destroy()
        unmet = stored(unmet.join(met[-1].select("h"), "h", "left_anti"))
        if unmet.isEmpty():
            break
    return reduce(DataFrame.unionByName, met)


def _phrased(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` (``w``, ``h``, ``f``) with ``lang``, ``length`` and ``phrase``, from ``words`` (``h``, ``lang``, ``word``)."""
    each = found.select("w", "h", "f", F.posexplode("w").alias("i", "of"))
    each = each.join(words.select(F.col("h").alias("of"), "lang", "word"), "of")
    whole = each.groupBy("w", "h", "f").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    return whole.select("lang", F.size("w").alias("length"), F.concat_ws(" ", "words.word").alias("phrase"), "h", "f", "w")


@_in_small_batches
def frequent_phrases(
    docs: DataFrame,
    *,
    least_count: int = LEAST_COUNT,
    longest: int = LONGEST,
    shards: int = SHARDS,
    filter_bytes: int | None = None,
    by_words: bool = True,
    dealt: _Dealt | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words that occur ``least_count`` times in a language, as rows (``lang``, ``length``,
    ``phrase``, its hash ``h``, ``f``, the hashes of its words ``w``), and the words of each language (``lang``, ``n``).

    ``docs``: ``text`` and ``lang``; other columns are not read. Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and
    line ends, pieces into words at blanks and tabs; a phrase lies within a piece. A null text is empty, a null
    language is ``und``; repeated rows count each; no rows give no phrases.

    The texts are read once, to write them as hashes of words by shard (``dealt``, if that is done); each step reads one shard, and the last
    counts, by words, all. Those come as a row for each phrase and buffer of ``BUFFER_WORDS``; if words in them share a hash, all
    is done again with other hashes. Without ``by_words`` the counts are those of the steps, by hash of the phrase, and the shards
    are read only until each phrase has been met; if phrases or words met share a hash, all are counted by words.
    What is shuffled is a hash and a count per phrase and step. ``filter_bytes`` (a power of two) is what tasks and driver hold; unless given
    it follows the number of words within ``FILTER_BYTES``.
    """
    spark = docs.sparkSession
    if dealt is None:
        dealt = _dealt(docs, shards, longest)
    blocks = dealt.blocks
    size = filter_bytes
    if size is None:
        n_words = blocks.agg(F.sum("own")).first()[0] or 0
        size = min(FILTER_BYTES[1], max(FILTER_BYTES[0], 1 << (n_words // 64).bit_length()))
    bloom = np.zeros(size // 8, np.uint64)
    filters = {0: spark.sparkContext.broadcast(bloom)}  # by step
    state, counted = None, []
    last_new = -shards  # the last step after which a phrase was new in the filter
    step = 0
    reached = (F.col("c") >= least_count) & (F.col("old") < least_count)
    while step < shards or step - last_new <= shards:
        part = blocks.where(F.col("shard") == step % shards)
        fresh = _scan(part, filters[step], filters[max(0, step - shards)], longest, step < shards)
        both = fresh.select("h", "c", F.lit(0).cast("long").alias("old"), F.lit(step).alias("first"))
        if state is not None:  # what may still be counted, and so far
            open_ = state.where(F.col("first") + shards > step)
            both = both.unionByName(open_.select("h", "c", F.col("c").alias("old"), "first"))
        sums = both.groupBy("h").agg(F.sum("c").alias("c"), F.sum("old").alias("old"), F.min("first").alias("first"))
        state = stored(sums.where((F.col("c") >= least_count) | (F.col("first") + shards > step + 1)))
        counted.append(state.where((F.col("c") >= least_count) & (F.col("first") + shards <= step + 1)))
        more = _added(bloom, state.where(reached).select("h"))
        if not np.array_equal(more, bloom):
            last_new = step
        bloom = more
        if step >= shards:
            filters.pop(step - shards).destroy()
        step += 1
        filters[step] = spark.sparkContext.broadcast(bloom)
    if not by_words:
        counted.append(state.where((F.col("c") >= least_count) & (F.col("first") + shards > step)))
        hashed = stored(reduce(DataFrame.unionByName, counted).select("h", F.col("c").alias("f")))
        met = _met(blocks, hashed, lambda part, wanted: _named(part, filters[step], longest, wanted).select("h", "w").distinct())
        by_words = {met.count(), met.select("h").distinct().count()} != {hashed.count()}
    if by_words:
        counts = _named(blocks, filters[step], longest).groupBy("w", "h").agg(F.sum("c").alias("f"))
        met = stored(counts.where(F.col("f") >= least_count))
    for sent in filters.values():
        sent.destroy()
    single = met.where(F.size("w") == 1).select("h")
    if by_words:
        wanted = spark.sparkContext.broadcast(_filter(single))
        words = stored(_spelled(dealt.vocabulary, wanted, dealt.seed).join(single, "h"))
        wanted.destroy()
    else:
        words = _met(dealt.vocabulary, single, lambda part, wanted: _spelled(part, wanted, dealt.seed))
    if words.count() != words.select("h").distinct().count():
        seed = dealt.seed + 1 if by_words else 0
        options = {"least_count": least_count, "longest": longest, "shards": shards, "filter_bytes": filter_bytes}
        return frequent_phrases(docs, **options, dealt=_dealt(docs, shards, longest, seed))
    return stored(_phrased(met, words)), dealt.totals


def _part(phrase: Column, start: Column | int, size: Column) -> Column:
    return F.concat_ws(" ", F.slice(phrase, start, size))


@_in_small_batches
def collocations(docs: DataFrame, *, top: int = LEAST_SCORES, **options: int) -> DataFrame:
    """The first ``top`` phrases of each language by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Of a phrase that occurs ``a`` times each cut into a first part (``l`` times) and a rest (``r`` times) scores
    ``floor(1000 * a * n / (l * r))``, exactly; the lowest counts, of equal ones the shortest first part. A phrase inside
    a longer one that occurs as often is dropped. Input and cases as in ``frequent_phrases``.

    Phrases are ranked by their counts by hash. The counts of the ranked ones and of all their parts are then taken from the shards by
    words; if any differs, or if words in them share a hash, all phrases are counted by words and ranked again.
    """
    longest = options.get("longest", LONGEST)
    dealt = _dealt(docs, options.get("shards", SHARDS), longest)
    found, totals = frequent_phrases(docs, by_words=False, dealt=dealt, **options)
    ranked = stored(_ranked(found, totals, top))
    if _confirmed(dealt, ranked, found, longest):
        return ranked
    return _ranked(*frequent_phrases(docs, **options), top)


def _confirmed(dealt: _Dealt, ranked: DataFrame, found: DataFrame, longest: int) -> bool:
    """Whether the counts in ``found`` of all parts of the phrases ``ranked`` are those in the texts, by words."""
    parts = F.split("phrase", " ")
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda size: F.transform(F.sequence(F.lit(1), F.size(parts) - size + 1), lambda at: _part(parts, at, size)),
        )
    )
    used = ranked.select("lang", F.explode(spans).alias("phrase")).distinct()
    used = stored(used.join(found, ["lang", "phrase"], "left").select("lang", "length", "phrase", "h", "f", "w"))
    known = ranked.sparkSession.sparkContext.broadcast(_filter(used.where("h is not null").select("h")))
    counts = _named(dealt.blocks, known, longest).groupBy("w").agg(F.sum("c").alias("c"))
    same = used.join(counts, "w", "left").where(~F.col("f").eqNullSafe(F.col("c")) | F.col("f").isNull()).isEmpty()
    if same:  # and whether no other words share their hashes
        words = used.where("length = 1").select("h", F.struct("lang", F.col("phrase").alias("word")).alias("one"))
        all_words = _spelled(dealt.vocabulary, known, dealt.seed).select("h", F.struct("lang", "word").alias("other"))
        same = all_words.join(words, "h").where("one != other").isEmpty()
    known.destroy()
    return same


def _ranked(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    parts = F.split("phrase", " ")
    candidates = found.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k", _part(parts, F.lit(1), F.col("k")).alias("left"),
        _part(parts, F.col("k") + 1, F.col("length") - F.col("k")).alias("right"),
    )
    counts = found.select("lang", "phrase", "f")
    cut = cut.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.join(totals, "lang")  # a row per language
    big = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    cut = cut.withColumn("top", F.lit(1000).cast("decimal(4,0)") * big["a"] * big["n"]).withColumn("base", big["l"] * big["r"])
    cut = cut.withColumn("score", F.expr("top div base"))
    lowest = cut.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("low")
    )
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("length") - 1),
            lambda size: F.transform(F.sequence(F.lit(1), F.col("length") - size + 1), lambda at: _part(parts, at, size)),
        )
    )
    inside = candidates.where("length > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a").distinct()
    kept = lowest.join(inside, ["lang", "phrase", "a"], "left_anti")  # a longer phrase is never more frequent
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
