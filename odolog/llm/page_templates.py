"""HTML extraction: templates of hosts from classes of tokens with equal occurrence vectors, and the slots left.

Tokens of a page are its elements (by the path of names, ids and classes they stand at) and its blocks of text
(by path and text). A token's occurrence vector says how often each page of the host holds it; tokens with
equal vectors form a class. A class is part of the template if most pages hold it; a text is part of it if an element around it
is in its class, so that the classes nest: wherever the element is, the text is, once. On a page, template texts must also come
in the template's order; those that do not are data. All other texts fill slots.

The main text is what the slots of the article hold: those below ``article``, else ``main``, else the
template's innermost element, once a page, that holds most of the text of its slots. Menus, headers, footers, sidebars, notices,
adverts, forms and comments are known by element, role, or a word of class or id.

Vectors are never built: a token's is represented by its number of pages, of occurrences, and the exclusive or of
hashes of (page, occurrences), which Spark combines before the shuffle. What one host brings together is its
template, whose size is that of a page.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from odolog.llm.common import stored
from odolog.llm.page_blocks import blocks

LEAST_PAGES = 8  # different pages a host must have before a repeated text counts as its template's
HELD_BY = 0.5  # a template token stands on more than this share of the host's pages
MOST_TEXT = 0.7  # an element holds the article if this share of its parent's text is in it
SALTS = 64
LINE = "#page"  # the token that stands for a page's whole content


def host(url: Column) -> Column:
    """The host of a URL in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _number(*parts: str) -> int:
    digest = hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def tokens(pages: DataFrame) -> DataFrame:
    """The tokens of every page: ``host``, ``path``, ``text`` (hash, null for an element), ``page`` (hash), ``count``, ``chars``, ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lower in range(0, batch.num_rows, 256):
                columns: list[list] = [[] for _ in range(7)]
                for name, page_id, page in zip(*(c.to_pylist() for c in batch.slice(lower, 256).columns)):
                    texts, opened = blocks(page or "")
                    own = _number(page or "")
                    key = _number(str(page_id), str(own))
                    chars = Counter()
                    for path, text in texts:
                        chars[path] += len(text)
                    first: dict[str, int] = {}
                    for path, place in opened:
                        first.setdefault(path, place)
                    rows = [("", None, 1, 0, 0), (LINE, own, 1, 0, 0)]
                    rows += [(path, None, n, chars[path], first[path]) for path, n in Counter(path for path, _ in opened).items()]
                    seen = Counter(texts)
                    where: dict[tuple[str, str], int] = {}
                    for place, block in enumerate(texts):
                        where.setdefault(block, place)
                    rows += [(path, _number(text), n, len(text), where[path, text]) for (path, text), n in seen.items()]
                    for path, text, n, size, place in rows:
                        for column, cell in zip(columns, (name, path, text, key, n, size, place)):
                            column.append(cell)
                kinds = [pa.string(), pa.string(), *[pa.int64()] * 5]
                names = ["host", "path", "text", "page", "count", "chars", "place"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = pages.select(host(F.col("url")).alias("host"), F.col("page_id").cast("string"), "html")
    return rows.mapInArrow(run, "host string, path string, text long, page long, count long, chars long, place long")


def templates(pages: DataFrame, *, held_by: float = HELD_BY) -> DataFrame:
    """Template of each host: ``host``, ``pages``, ``different`` (pages) and ``tokens``, a list of the tokens that more than ``held_by`` of
    its pages hold, with ``class`` (hash of the vector), ``once`` (a page), ``chars`` and mean ``place``.

    Tokens are combined per task, then by host and token, so a host with a third of all pages is spread by its tokens. Only what
    most pages hold is brought together by host: a page's worth.
    """
    vectors = (
        tokens(pages)
        .groupBy("host", "path", "text")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.sum("count").alias("total"),
            F.bit_xor(F.xxhash64("page", "count")).alias("vector"),
            F.sum("chars").alias("chars"),
            F.sum("place").alias("places"),
        )
    )
    vectors = stored(vectors)
    hosts = vectors.where(F.col("path").isin("", LINE)).groupBy("host").agg(
        F.sum(F.when(F.col("path") == "", F.col("pages"))).alias("pages_of_host"), F.count_if(F.col("path") == LINE).alias("different")
    )
    # a host's many tokens meet its one row in SALTS places
    salted = stored(hosts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = vectors.where(F.col("path") != LINE).withColumn("salt", F.pmod(F.xxhash64("path", "text"), F.lit(SALTS)).cast("int"))
    held = own.join(salted, ["host", "salt"]).where(F.col("pages") > F.col("pages_of_host") * held_by)
    token = F.struct(
        "path", "text", F.xxhash64("pages", "total", "vector").alias("class"), (F.col("pages") == F.col("total")).alias("once"),
        "chars", (F.col("places") / F.col("pages")).alias("place"),
    )
    return held.groupBy("host").agg(
        F.max("pages_of_host").alias("pages"), F.max("different").alias("different"), F.array_sort(F.collect_list(token)).alias("tokens")
    )


def _below(path: str, top: str) -> bool:
    return path == top or path.startswith(top + "/")


def _main(path: str, top: str) -> bool:
    """Whether a block at ``path`` below ``top`` is main text by the elements between."""
    rest = path[len(top) :]
    if "/!" in rest:
        return False
    names = [x.split(".", 1)[0] for x in rest.split("/")]
    return "header" not in names or names[-1] in ("h1", "h2", "h3", "h4", "h5", "h6")


def _innermost(sizes: dict[str, int]) -> str:
    """The innermost path that holds ``MOST_TEXT`` of the text of each path around it; ``sizes`` by path, main text only."""
    below: Counter = Counter()
    for path, size in sizes.items():
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            below["/".join(parts[:i])] += size
    top = ""
    children: dict[str, list[str]] = {}
    for path in below:
        if path:
            children.setdefault(path.rpartition("/")[0], []).append(path)
    while True:
        inner = max(children.get(top, ()), key=lambda p: (below[p], p), default=None)
        if inner is None or below[inner] < MOST_TEXT * below[top] or inner.rpartition("/")[2].split(".", 1)[0] in ("p", "li", "td", "pre"):
            return top
        top = inner


@lru_cache(maxsize=64)
def _template(written: str) -> tuple[dict[tuple[str, int], float], str | None]:
    """(template texts with their places, path of the main text) from a row of ``templates`` as JSON."""
    if not written:
        return {}, None
    row = json.loads(written)
    classes: dict[str, int] = {t["path"]: t["class"] for t in row["tokens"] if t.get("text") is None}
    fixed: dict[tuple[str, int], float] = {}
    sizes: dict[str, int] = {}
    for t in row["tokens"]:
        path = t["path"]
        if t.get("text") is None:
            if path and _main(path, ""):
                sizes[path] = sizes.get(path, 0) + t["chars"]
            continue
        parts = path.split("/")
        around = ("/".join(parts[:i]) for i in range(len(parts), -1, -1))
        if row["different"] >= LEAST_PAGES and t["once"] and any(classes.get(p) == t["class"] for p in around):
            fixed[path, t["text"]] = t["place"]
            sizes[path] = sizes.get(path, 0) - t["chars"]
    single = {t["path"] for t in row["tokens"] if t.get("text") is None and t["once"]}
    top = _innermost(sizes) if row["different"] >= LEAST_PAGES and any(sizes.values()) else ""
    while top and top not in single:  # the article is there once a page
        top = top.rpartition("/")[0]
    return fixed, top or None


def _in_order(found: list[tuple[int, float]]) -> set[int]:
    """Of (block, place in the template) the blocks of a longest sequence in the template's order."""
    ends: list[float] = []
    last: list[int] = []
    back: dict[int, int | None] = {}
    for block, place in found:
        i = bisect.bisect_right(ends, place)
        ends[i : i + 1] = [place]
        last[i : i + 1] = [block]
        back[block] = last[i - 1] if i else None
    out: set[int] = set()
    at = last[-1] if last else None
    while at is not None:
        out.add(at)
        at = back[at]
    return out


def main_text(page: str, written: str) -> tuple[str, int]:
    """(main text, number of template texts on the page) of one page, given its host's template as JSON (or nothing)."""
    texts, opened = blocks(page)
    fixed, usual = _template(written)
    numbered = [(path, _number(text)) for path, text in texts] if fixed else []
    template = _in_order([(i, fixed[token]) for i, token in enumerate(numbered) if token in fixed])
    paths = [path for path, _ in opened]
    tops: list[str] = []
    for name in ("article", "main"):
        if not tops:  # elements of that name that are not within other things, nor within each other
            tops = [p for p in dict.fromkeys(paths) if p.rpartition("/")[2].split(".", 1)[0] == name and "/!" not in p]
            tops = [p for p in tops if not any(p != q and _below(p, q) for q in tops)]
    if not tops and usual in paths:
        tops = [usual]
    if not tops:
        sizes: Counter = Counter()
        for i, (path, text) in enumerate(texts):
            if i not in template and _main(path, ""):
                sizes[path] += len(text)
        tops = [_innermost(sizes)] if sizes else []
    kept = [
        text
        for i, (path, text) in enumerate(texts)
        if i not in template and any(_below(path, top) and "/!" not in top and _main(path, top) for top in tops)
    ]
    return "\n".join(kept), len(template)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``, ``html``): those columns but ``html``, ``text`` and ``n_template``, the
    number of blocks that the host's template explains.

    Blocks are joined by one line feed. A null or empty page gives an empty text; pages without a host share one; a repeated row
    gives a repeated result and counts as a page each time; a page unlike its host's others is read by its own structure;
    other columns of the input are not read. No rows give no rows.

    Templates meet pages in a join by host, which Spark broadcasts if the written table of templates is small;
    else it splits the pages of large hosts.
    """
    found = stored(templates(pages).select("host", F.to_json(F.struct("different", "tokens")).alias("template")))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, url = batch.column(0), batch.column(1)
            out = [main_text(page or "", template or "") for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            texts, numbers = pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())
            yield pa.RecordBatch.from_arrays([page_id, url, texts, numbers], names=["page_id", "url", "text", "n_template"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_template long")
