"""The classifier and the pipeline against plain Python, row by row."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import regex

import corpus_pipeline
from odolog.llm import quality_classifier
from odolog.llm.suite import tokenizer_path
from tests.llm.test_cases import LONG, linked, repeats, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfglm" for b in ("a", "e", "o", "ü") for c in ("n", "r", "sts", "Q", "7")]


def words_of(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def lines_of(text):
    return [line for line in (text or "").split("\n") if words_of(line)]


def counted(text, pattern):
    return len(regex.findall(pattern, text or ""))


def statistics(text):
    words, lines = words_of(text), lines_of(text)
    n, letters = len(words), counted(text, r"\p{L}")
    share = lambda part, of: math.sqrt(part / max(of, 1))
    return [
        math.log1p(n), math.log1p(len(set(words))) / math.log1p(max(n, 1)), math.log1p(sum(map(len, words)) / max(n, 1)),
        share(repeats(words), n), share(counted(text, r"[#*$%&|<>]"), n), share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(lines) / max(n, 1)), share(counted(text, r"\p{Lu}"), letters), share(counted(text, r"\p{Nd}"), letters),
        share(counted(text, r"[!?]"), n), share(counted(text, r"[.,;:]"), n),
    ]


def random_texts(n, seed):
    """Texts of two kinds: long plain ones, and short ones with symbols, capitals and repeated lines."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = rng.choice(VOCABULARY, int(rng.integers(5, 120))).tolist()
        if i % 3 == 0:
            words = [w.upper() if rng.random() < 0.4 else w + str(rng.choice(["#", "!", "?", "$", "9"])) for w in words]
        text = "".join(w + str(rng.choice([" ", ", ", ".\n", "\t"], p=[0.8, 0.1, 0.08, 0.02])) for w in words)
        out.append(text + ("\n" + "\n".join(["same line here"] * 3) if i % 5 == 0 else ""))
    return out


def test_scores_against_brute_force(spark):
    texts = [None, "", " \n", LONG, "x"] + random_texts(300, 5)
    rng = np.random.default_rng(6)
    quality = [int(i % 3 != 2 if rng.random() < 0.9 else i % 2) for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, q if i != 40 else None) for i, q in enumerate(quality)] + [(50, quality[50])], "doc_id long, quality int")
    found = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality_classifier.statistics(docs["text"]).alias("s")).collect()}
    x = np.array([statistics(t) for t in texts])
    assert np.allclose([found[i] for i in range(len(texts))], x, atol=1e-12)

    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))]
    taught = [i for i in range(len(texts)) if not held[i] and i != 40] + ([50] if not held[50] else [])
    of_class = [x[[i for i in taught if quality[i] == c]] for c in (0, 1)]
    scatter = [(rows - rows.mean(0)).T @ (rows - rows.mean(0)) for rows in of_class]
    pooled = sum(scatter) / len(taught)
    logs = []
    for rows, s in zip(of_class, scatter):
        covariance = 0.98 * (0.85 * s / len(rows) + 0.15 * pooled) + 0.02 * np.trace(pooled) / x.shape[1] * np.eye(x.shape[1])
        away = x - rows.mean(0)
        distance = np.einsum("ij,ij->i", away, np.linalg.solve(covariance, away.T).T)
        logs.append(math.log(len(rows) / len(taught)) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * distance)
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    got = {r["doc_id"]: r for r in quality_classifier.score(docs, labels).collect()}
    assert len(got) == len(texts) and 0.2 < np.mean(want > 0.5) < 0.95
    assert np.allclose([got[i]["score"] for i in range(len(texts))], want, atol=1e-7)
    assert [got[i]["held_out"] for i in range(len(texts))] == held
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def rejected(text):
    """The rules one by one, on a plain text."""
    words, lines = words_of(text), lines_of(text)
    letters, n = counted(text, r"\p{L}"), len(words)
    return (
        n < 20 or 100 * repeats(words) > 30 * n or 10 * counted(text, r"[#*$%&|<>]") > 3 * n or 2 * (len(lines) - len(set(lines))) > len(lines)
        or (letters >= 20 and 10 * counted(text, r"\p{Lu}") > 6 * letters) or (n >= 50 and 10 * len(set(words)) < n)
    )


def mix_hash(*parts):
    text = "|".join("null" if p is None else str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def mixture(rows, max_repeat=1.25, grid=1 << 18):
    """(mix key, document) of each pass, for sources of one block each: the exponent by trying, the last pass by sorting."""
    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((mix_hash("mix", r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest()), len(words_of(r["text"])), r))
    t = {s: sum(n for _, n, _ in found) for s, found in sources.items()}
    budget = sum(t.values())

    def shares(k):
        z = sum(v ** (k / grid) for v in t.values())
        return {s: v ** (k / grid) / z for s, v in t.items()}

    low, high = -1, grid
    while high - low > 1:
        k = (low + high) // 2
        low, high = (low, k) if max(budget * p / t[s] for s, p in shares(k).items()) <= max_repeat else (k, high)
    out = []
    for s, p in shares(high).items():
        whole, rest = divmod(math.floor(p * budget), t[s])
        out += [(mix_hash("mix", s, c, 0), r) for c in range(whole) for _, _, r in sources[s]]
        before = 0
        for _, n, r in sorted(sources[s], key=lambda d: d[0]):
            if before < rest:
                out.append((mix_hash("mix", s, whole, 0), r))
            before += n
    return sorted(out, key=lambda d: (d[0], d[1]["doc_id"]))


def test_pipeline_against_brute_force(spark, tmp_path):
    texts = random_texts(120, 9)
    for i in range(0, 40, 4):  # exact and near copies
        words = texts[i + 1].split(" ")
        texts += [texts[i + 1], " ".join(words[:-1]), " ".join(words[: len(words) // 2])]
    mail = {3 * i: f"{t} mail to user{i % 4}x@mail.example today" for i, t in enumerate(texts[::3])}
    rows = [(i, mail.get(i, t), "en" if i % 2 else None, "abbbbcc"[i % 7] if i % 11 else None, 0) for i, t in enumerate(texts)]
    rows += [(1000, None, None, "a", 0), (1001, "", "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        found = out.collect()
        return [r.asDict() for r in found], spark.createDataFrame(found, SCHEMA)

    clean, docs = step("quality_rules", docs)
    assert sorted(r["doc_id"] for r in clean) == sorted(r[0] for r in rows if not rejected(r[1])) and 50 < len(clean) < len(rows)

    distinct, docs = step("minhash", docs)
    clean.sort(key=lambda r: r["doc_id"])
    first = set(linked([shingles(r["text"]) for r in clean], 80))
    assert sorted(r["doc_id"] for r in distinct) == sorted(clean[i]["doc_id"] for i in first) and len(distinct) < len(clean)

    anonymous, docs = step("surrogates", docs)
    before, names = {r["doc_id"]: r for r in distinct}, {}
    assert sorted(before) == sorted(r["doc_id"] for r in anonymous)
    for r in anonymous:
        old = before[r["doc_id"]]["text"]
        address = regex.search(r"user\dx@mail\.example", old)
        if address:
            new = regex.search(r" mail to (\S+@\S+) today$", r["text"])[1]
            assert names.setdefault(address[0], new) == new != address[0]
            old = old.replace(address[0], new)
        assert r == {**before[r["doc_id"]], "text": old, "n_chars": len(old)}
    assert len(set(names.values())) == len(names) == 4

    mixed, docs = step("mixing", docs)
    want = [r for _, r in mixture(anonymous)]
    assert mixed == want and max(Counter(r["doc_id"] for r in mixed).values()) == 2

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {r["doc_id"]: tokenizer.encode(r["text"], add_special_tokens=False).ids + [1] for r in mixed}
    copies = Counter(r["doc_id"] for r in mixed)
    for pieces in (stages["packing"](spark, docs, str(tmp_path)).collect(), corpus_pipeline.run(spark, str(tmp_path)).collect()):
        covered, windows = Counter(), {}
        for p in pieces:
            part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4")) and p["doc_tokens"] == len(ids[p["doc_id"]])
            covered.update((p["doc_id"], p["start"] + i) for i in range(p["length"]))
            windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert covered == {(d, i): copies[d] for d in copies for i in range(len(ids[d]))}
        for w, parts in windows.items():
            ends = [o + n for o, n in sorted(parts)]
            assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 2048 or w == max(windows))
        assert sorted(windows) == list(range(len(windows)))
