"""Periodic runs, page templates and phrases against brute force, and on their corner cases."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from odolog.llm import page_templates, periodic_runs, phrases
from odolog.llm.page_blocks import blocks
from odolog.llm.suite import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# periodic runs


def runs_of(words, least=6, periods=4):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_diagonals_against_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(1500):
        words = rng.integers(0, rng.choice([1, 2, 3, 6]), rng.integers(0, 70)).tolist()
        for _ in range(rng.integers(0, 3)):
            if len(words) > 8:
                a, p = int(rng.integers(0, len(words))), int(rng.integers(1, 10))
                for i in range(a, min(len(words), a + p * int(rng.integers(3, 8)))):
                    words[i] = words[a + (i - a) % p]
        got = periodic_runs.diagonals(np.array([*words, 10**6]), 6, 4)
        assert [tuple(r) for r in got.tolist()] == runs_of(words)


def test_runs_of_texts(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t\n", "one", "x " * 5, "x " * 6, "a b " * 4 + "a", "a b c " * 3, "no break no break " * 4, "x " * 3000 + "end"]
    texts += [" ".join(rng.choice(list("abcd"), n)) for n in (50, 200, 400)] + [f"w{i} " * 7 for i in range(40)]
    texts += ["the same line again\n" * 30 + "and an end", " ".join(f"w{i}" for i in range(700))] * 6
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(4, texts[5], None, "x"), (None, "x " * 9, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, best string")
    got = periodic_runs.digest(periodic_runs.find_runs(docs, rewrite=True))
    want = [expected_digest(r[0], r[1]) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    plain = {r["doc_id"]: r["collapsed"] for r in periodic_runs.find_runs(docs).collect()}
    assert plain[9] == "x end" and plain[0] == "" and plain[6] == "a b"
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, least_periods=2)


def test_documents_larger_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK_WORDS", 50)
    docs = spark.createDataFrame([(i, "a b c d e " * (i % 30)) for i in range(60)], "doc_id long, text string")
    got = periodic_runs.digest(periodic_runs.find_runs(docs, rewrite=True)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [expected_digest(i, "a b c d e " * (i % 30)) for i in range(60)]


# pages

HOST = """<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header><h1>The Site</h1><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/a{i}">Menu {i}</a><li>More</ul></nav>
<div class="ad">Buy {i}</div><main><article class="post"><header><h1>Title {i}</h1><p>By someone</p></header>
<p>First   para&shy;graph {i} &amp; more<p>Sec<b>o</b>nd &lt;{i}&gt;<br>line<ul><li>item {i}<li>all {i}</ul>
<form><label>Mail</label><input><button>Send</button></form><aside>Pulled</aside>
<table><tr><td>cell {i}<td>{i} cell</table><!-- <p>hidden</p> --><p>Read our magazine every week</p>
<section class="comments"><article>Nice {i}</article></section><footer>tags</footer></article></main>
<div class="sidebar">Links</div><footer>&copy; us</footer></body></html>"""
MAIN = "Title {i}\nFirst para­graph {i} & more\nSecond <{i}> line\nitem {i}\nall {i}\ncell {i}\n{i} cell"
PLAIN = """<html><body><div id=top><a href=/>Home</a> <a href=/x>Things</a></div><div id="c1"><div class="k7"><h2>Head {i}</h2>
<p>{text}</p><p>{text} too</p></div><div class=k8>Subscribe to us today</div></div><div class=k9>All rights reserved</div></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://Site.example.org/{i}", HOST.format(i=i), None) for i in range(10)]
    rows += [(100 + i, f"https://u@plain.example.org:80/{i}", PLAIN.format(i=i, text=f"words of page {i} " * 20), None) for i in range(12)]
    rows += [
        (200, None, None, None), (201, "", "", None), (202, "http://one.example/", "<article>a < b<p>c", None),
        (203, "x", "<div " * 20_000 + "tail", None), (204, "x", "<b>" * 20_000 + "deep " * 3 + "</b>" * 20_000, None),
        (205, "http://one.example/2", "just text", None), (None, "http://one.example/3", "<main>in main</main> out", None),
        (0, "http://site.example.org/0", HOST.format(i=0), None),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_main_text(pages):
    rows = page_templates.extract(pages).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == 30 and rows[0].asDict().keys() == {"page_id", "url", "text", "n_template"}
    for i in range(10):  # the weekly line is on every page: the template's
        assert got[i]["text"] == MAIN.format(i=i) and got[i]["n_template"] > 0
    for i in range(12):
        text = ("words of page %d " % i * 20).strip()
        assert got[100 + i]["text"] == f"Head {i}\n{text}\n{text} too"
    assert got[200]["text"] == got[201]["text"] == "" and got[202]["text"] == "a < b\nc"
    assert got[204]["text"] == "deep deep deep" and got[205]["text"] == "just text" and got[None]["text"] == "in main"
    assert page_templates.extract(pages.limit(0)).count() == 0


def test_repeated_article_text_is_no_template(spark):
    line = "This passage stands in most articles of the site."
    rows = [(i, "http://s.org/", f"<article><p>{'' if i % 4 == 0 else line}</p><p>own {i}</p></article>") for i in range(16)]
    got = page_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert r["text"] == ("" if r["page_id"] % 4 == 0 else line + "\n") + f"own {r['page_id']}"
    copies = spark.createDataFrame([(i, "http://s.org/", "<article><p>one and the same</article>") for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in page_templates.extract(copies).collect()} == {"one and the same"}


def test_vectors_make_classes(pages):
    found = {r["host"]: r for r in page_templates.templates(pages).collect()}
    site = found["site.example.org"]
    classes = {}
    for t in site["tokens"]:
        classes.setdefault(t["class"], []).append(t)
    whole = next(c for c in classes.values() if any(t["path"] == "" for t in c))
    assert site["pages"] == 11 and site["different"] == 10 and any(t["path"].endswith("article.post") for t in whole)
    items = [t for t in site["tokens"] if t["text"] is None and t["path"].endswith("/li") and "article" in t["path"]]
    assert not items[0]["once"] and items[0]["class"] != whole[0]["class"]


def test_template_order():
    assert page_templates._in_order([(0, 1.0), (1, 9.0), (2, 2.0), (3, 3.0)]) == {0, 2, 3}
    assert page_templates._in_order([]) == set()


def test_broken_markup():
    def texts(page):
        return [t for _, t in blocks(page)[0]]

    assert texts('<p><b>one<br><p>two</p></b>three<script>x</p>') == ["one", "two", "three"]
    assert texts("a<b>b</b>c <i>d</i><div>e</div>f") == ["abc d", "e", "f"]
    assert texts('<a title="x>y">in</a> <a title=it\'s>out</a><!-- > --> end<!-- open') == ["in out end"]
    assert texts("&#x41;&eacute&nbsp;&unknown; 1 &lt 2") == ["Aé &unknown; 1 < 2"]
    assert texts("<td>x</p>y</td><p>z<textarea><p>no</textarea>") == ["x", "y", "z"]
    assert texts("x" * 10 + "<" * 50_000) == ["x" * 10 + "<" * 50_000]


# phrases


def phrases_of(rows, least, longest=5, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: c for p, c in counts.items() if c >= least}
    out = []
    for lang in totals:
        scored = []
        mine = {p: a for (l, p), a in often.items() if l == lang}
        for p, a in mine.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in mine.items()):
                continue
            n = totals[lang]
            score, _, left, right = min((1000 * a * n // (mine[p[:k]] * mine[p[k:]]), k, mine[p[:k]], mine[p[k:]]) for k in range(1, len(p)))
            scored.append((score, a, " ".join(p), left, right, n))
        scored.sort(key=lambda s: (-s[0], -s[1], s[2].encode()))
        out += [(lang, i + 1, ph, a, left, right, n, score) for i, (score, a, ph, left, right, n) in enumerate(scored[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    vocabulary = ["new", "york", "City", "state", "of", "The", "art", "a", "été", "x-1", "b c"]
    rows = [(None, None), ("en", ""), ("", ". , ;"), (None, "a a a a a a a a"), ("en", "new york city " * 40)]
    for i in range(150):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=np.array([10, 10, 5, 4, 8, 8, 4, 6, 2, 1, 1]) / 59).tolist()
        seps = rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\x0b"], len(words), p=[0.7, 0.1, 0.05, 0.05, 0.04, 0.04, 0.02])
        rows.append((["en", "de", None][i % 3], "".join(w + s for w, s in zip(words, seps))))
    return rows + rows[4:8]


@pytest.mark.parametrize("options", [{}, {"shards": 3}, {"shards": 1}, {"filter_bytes": 64}, {"longest": 3}])
def test_phrases_against_brute_force(spark, texts, options):
    docs = spark.createDataFrame([(*r, 1, "p") for r in texts], "lang string, text string, h int, phrase string").repartition(3)
    got = phrases.collocations(docs, least_count=8, **options)
    want = phrases_of(texts, 8, options.get("longest", 5))
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_phrases_in_small_buffers(spark, texts, monkeypatch):
    monkeypatch.setattr(phrases, "BUFFER_WORDS", 20)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 16)
    docs = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    assert sorted(map(tuple, phrases.collocations(docs, least_count=8).collect())) == phrases_of(texts, 8)
    assert phrases.collocations(docs, least_count=8, top=3).groupBy("lang").count().where("count > 3").count() == 0


def test_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", None), (None, "w " * 50)], "lang string, text string")).count() == 0


def test_a_cycle_counts_each_occurrence_once(spark):
    """Phrases that become active late are counted over one whole cycle and not more."""
    rows = [("en", f"p{i % 7} q{i % 7} r{i % 7} s{i % 7} t{i % 7}") for i in range(700)]
    found, totals = phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string").repartition(4), least_count=100, shards=4)
    assert {r["f"] for r in found.collect()} == {100} and found.count() == 7 * 15 and totals.first()["n"] == 3500


def test_rows_of_named_phrases_do_not_grow_with_the_tasks(spark, monkeypatch):
    """Each phrase is met in few parts of the texts; only the ranked ones are counted in all."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [("en", " ".join(rng.choice(vocabulary, 200))) for _ in range(400)]  # about 270 times each word
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(20)
    rows, named = [], phrases._named

    def counting(*args):
        made = phrases.stored(named(*args))
        rows.append(made.where("length > 0").count())
        return made

    monkeypatch.setattr(phrases, "_named", counting)
    monkeypatch.setattr(phrases, "BUFFER_WORDS", 1 << 10)
    assert phrases.collocations(docs, least_count=8, top=5).count() > 0
    found = phrases.frequent_phrases(docs, least_count=8)[0].count()
    assert found > 300 and sum(rows[:-1]) < 12 * found  # the last is that of frequent_phrases, in each of about 80 buffers
    assert rows[-1] > 30 * found


def test_phrases_with_equal_hashes(spark, texts, monkeypatch):
    """Phrases that share a hash are found out, and counted by their words."""
    mixed = phrases._mixed
    monkeypatch.setattr(phrases, "_mixed", lambda left, right: mixed(left, right) & np.uint64(0xFF))
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, least_count=8, shards=1)
    assert sorted(map(tuple, got.collect())) == phrases_of(texts, 8)
    found, _ = phrases.frequent_phrases(docs, least_count=8, shards=1, by_words=False)
    assert found.count() > found.select("h").distinct().count()


def test_wrong_counts_by_hash_are_not_returned(spark, texts, monkeypatch):
    """Counts of the ranked phrases are compared with the texts."""
    counted = phrases.frequent_phrases

    def off(docs, by_words=True, **options):
        found, totals = counted(docs, by_words=by_words, **options)
        wrong = F.when((F.col("phrase") == "new york city") & ~F.lit(by_words), 1).otherwise(0)
        return found.withColumn("f", F.col("f") + wrong), totals

    monkeypatch.setattr(phrases, "frequent_phrases", off)
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(docs, least_count=8).collect())) == phrases_of(texts, 8)


def test_texts_are_read_once_for_phrases(spark, texts):
    """Naming and confirming work on the hashed shards; no later step splits the texts again."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(texts, 3).map(seen), "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, least_count=8).collect())) == phrases_of(texts, 8)
    assert read.value == len(texts)


def test_words_with_equal_hashes(spark, texts, monkeypatch):
    """Words that share a hash are found out, and all is done again with other hashes."""
    key, hashes = phrases._key, phrases._hashes
    monkeypatch.setattr(phrases, "_key", lambda lang, seed: key(lang, seed) if seed else 1)

    def few(words, key):
        h = hashes(words, key)
        return np.where((key == 1) & (h > 0), h % np.uint64(8) + np.uint64(1), h)

    monkeypatch.setattr(phrases, "_hashes", few)
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(docs, least_count=8).collect())) == phrases_of(texts, 8)


def test_odd_words_of_phrases(spark, monkeypatch):
    """Long words, words of odd characters, and texts cut within blanks."""
    monkeypatch.setattr(phrases, "SLICE_BYTES", 8)
    odd = ["\x00", "a\x00", "a\x00\x00", "\x1c\x1d", "\x85", "\u00a0x", "\u3000", "é" * 40, "é" * 40 + "x", "z" * 64, "z" * 65, "z" * 200, "\U0001f600", "-"]
    rows = [("en", " ".join(odd) + " " * 30 + "\t\t" + " \t".join(odd[::-1])), ("de", " " * 40), ("", "  ".join(odd) + ". . "), ("en", "  b  ")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    want = phrases_of(rows, 8)
    assert len(want) > 10 and sorted(map(tuple, phrases.collocations(docs, least_count=8).collect())) == want


def test_hashes_of_words():
    """A hash follows from the word and the language alone, wherever the word stands."""
    rng = np.random.default_rng(5)
    words = sorted({"w" * int(n) + str(i) for i, n in enumerate(rng.integers(0, 90, 3000))})
    h = phrases._hashes(phrases._split([" ".join(words).encode()]).flatten(), phrases._key("en", 0))
    again = phrases._hashes(phrases._split([" . ".join(words[::-1]).encode()]).flatten(), phrases._key("en", 0))
    assert len(set(h.tolist())) == len(words) and (again[::2] == h[::-1]).all() and not again[1::2].any()
    assert not set(h.tolist()) & set(phrases._hashes(phrases._split([" ".join(words).encode()]).flatten(), phrases._key("de", 0)).tolist())


@pytest.mark.parametrize("counted", ["by hash", "by words"])
def test_memory_of_scans_of_phrases(counted):
    """A task holds some tens of megabytes, however many words it reads and however many are counted."""

    class Frame:  # returns the function that tasks run
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    class Sent:
        def __init__(self, value):
            self.value = value

    every, none = Sent(np.full(1 << 10, 2**64 - 1, np.uint64)), Sent(np.zeros(1 << 10, np.uint64))
    run = phrases._scan(Frame(), every, none, 5, True) if counted == "by hash" else phrases._named(Frame(), every, 5)
    n = phrases.BLOCK_WORDS
    rng = np.random.default_rng(2)
    words = (rng.integers(1, 2**63, n, np.uint64).tobytes() for _ in range(0, 3_000_000, n))
    batches = (pa.record_batch({"words": [w], "own": [n - 4]}) for w in words)
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in run(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 14_000_000 and most < 100 << 20


def test_rows_of_shards_are_small(spark):
    """Readers decode a row group at a time, and rows of half a megabyte are too large for a region of Java's heap."""
    text = " ".join(f"w{i}" for i in range(2_000_000))
    dealt = phrases._dealt(spark.createDataFrame([("en", text)], "lang string, text string"), 1, 5)
    assert dealt.totals.first()["n"] == 2_000_000 == dealt.blocks.agg(F.sum("own")).first()[0] - 1  # the end of the piece
    assert dealt.vocabulary.agg(F.sum(F.size(F.split("words", " ")))).first()[0] == 2_000_001
    sizes = dealt.blocks.unionByName(dealt.vocabulary).select(F.octet_length("words").alias("b"))
    assert sizes.agg(F.max("b")).first()[0] < 400_000
    groups = []
    for file in dealt.blocks.inputFiles():
        meta = pq.ParquetFile(urlparse(file).path).metadata
        groups += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert max(groups) < 10_000_000 and sum(groups) > 15_000_000


def test_batches_of_phrases_are_small(spark, texts, monkeypatch):
    """Rows are sent to Python some megabytes at a time; the session's setting is left as it was."""
    name, scan, seen = "spark.sql.execution.arrow.maxBytesPerBatch", phrases._scan, []
    before = spark.conf.get(name)

    def noted(*args):
        seen.append(spark.conf.get(name))
        return scan(*args)

    monkeypatch.setattr(phrases, "_scan", noted)
    found, _ = phrases.frequent_phrases(spark.createDataFrame(texts, "lang string, text string"), least_count=8)
    assert found.count() and len(seen) > 1 and {int(x.rstrip("b")) for x in seen} == {1 << 23}
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_templates", "op13_collocations"])
def test_columns(spark, name):
    want = {
        "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
        "op12_templates": "page_id url text n_chars",
        "op13_collocations": "lang rank phrase a l r n score",
    }
    df = QUERIES[name](spark, SF)
    assert df.columns == want[name].split() and all(t in ("bigint", "string") for _, t in df.dtypes)
