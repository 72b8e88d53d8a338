"""Packing against the round-robin done one token at a time."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from odolog.llm import packing
from odolog.llm.suite import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def simulated(queues, quanta, every):
    """The stream of (queue, token) of deficit round-robin."""
    left, out, deficit, r = {q: list(v) for q, v in queues.items()}, [], dict.fromkeys(queues, 0), 0
    served = dict.fromkeys(queues, 0)
    while any(left.values()):
        r += 1
        for q in sorted(queues):
            if r % every[q] == 0:
                upto = int(np.floor(quanta[q] * r))
                while left[q] and served[q] < upto:
                    out.append((q, left[q].pop(0)))
                    served[q] += 1
    return out


@pytest.mark.parametrize("shares", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.01, "b": 0.9, "c": 0.09}, {"a": 3, "b": 1, "c": 1.7}])
@pytest.mark.parametrize("least", [1, 7])
def test_closed_form_equals_round_robin(shares, least):
    rng = np.random.default_rng(3)
    docs = {q: [int(n) for n in rng.integers(1, 60, 25)] for q in shares}
    queues = packing.Queues.of({q: sum(v) for q, v in docs.items()}, shares, 32, least)
    tokens = {q: [(i, j) for i, n in enumerate(v) for j in range(n)] for q, v in docs.items()}
    stream = simulated(tokens, dict(zip(queues.names, queues.quanta)), dict(zip(queues.names, queues.every)))
    want = {(q, *t): i for i, (q, t) in enumerate(stream)}
    got = {}
    for q, lengths in docs.items():
        place = 0
        for i, n in enumerate(lengths):
            pieces = queues.cut(queues.names.index(q), place, n, 32)
            assert [p[0] for p in pieces][0] == 0 and pieces[-1][1] == n
            for s, e, p in pieces:
                assert p // 32 == (p + e - s - 1) // 32
                for k in range(s, e):
                    got[q, i, k] = p + k - s
            place += n
    assert got == want


def check(pieces, docs, end_id=1, length=2048):
    tok = encoder()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    total = 0
    for doc_id, text in docs.items():
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        total += len(ids)
        at = 0
        for p in sorted(by_doc.pop(doc_id), key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    sizes = {}
    for w, parts in windows.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        sizes[w] = at
    assert sorted(windows) == list(range(len(windows)))
    assert all(sizes[w] == length for w in range(len(sizes) - 1)) and sum(sizes.values()) == total


def test_query_packs_every_id_once(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = [r.asDict() for r in QUERIES["op1_packing"](spark, SF).collect()]
    check(pieces, docs)


ODD = ["", None, " ", "a", "a  b", " a\n b \n", "x \t y", "don't stop", "é è", "a  b", "<|endoftext|> b", "\x1c c", "w " * 3000]


def test_odd_texts_and_null_sources(spark):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", 1, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start int, queue string")
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer_path(), length=64, least=4).collect()]
    check(pieces, {r[0]: r[1] for r in rows}, length=64)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_windows_follow_the_targets(spark):
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 100).alias("text"),
        F.when(F.col("id") < 200, "big").otherwise("small").alias("source"),
    )
    out = packing.pack(docs, tokenizer_path(), length=512, shares={"big": 0.6, "small": 0.4}, least=16)
    got = out.join(docs, "doc_id").groupBy("sequence_id").agg(
        F.sum(F.when(F.col("source") == "big", F.col("length"))).alias("big"), F.sum("length").alias("n")
    ).orderBy("sequence_id").collect()
    dry = int(100 * 101 / (0.4 * 512))  # "small" lasts about this many windows
    assert all(abs(r["big"] - 0.6 * 512) <= 2 for r in got[: dry - 1]) and got[-2]["big"] == 512


def test_more_sources_than_queues(spark):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.concat(F.lit("s"), F.col("id") % 20).alias("source")
    )
    pieces = [r.asDict() for r in packing.pack(docs, tokenizer_path(), length=32, max_queues=5, least=2).collect()]
    check(pieces, {i: "some words here" for i in range(60)}, length=32)


def test_joint_queue_has_the_shares_of_its_sources(spark):
    """Four sources at a quarter each in three queues: the joint one gets half."""
    rows = [(i, "word " * 40, f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    shares = {f"s{k}": 0.25 for k in range(4)}
    pieces = packing.pack(docs, tokenizer_path(), length=256, shares=shares, max_queues=3, least=8).collect()
    early = [p for p in pieces if p["sequence_id"] < 15]
    tokens = [sum(p["length"] for p in early if p["doc_id"] % 4 == k) for k in range(4)]
    total = sum(tokens)
    alone = sorted(t / total for t in tokens if abs(t / total - 0.25) < 0.03)
    assert total == 15 * 256 and len(alone) >= 2 and abs(sum(alone[:2]) - 0.5) < 0.06
