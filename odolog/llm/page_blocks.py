"""A page as blocks of text, each with the path of elements it lies in. Plain Python, used inside tasks."""

from __future__ import annotations

import html
import re
from functools import lru_cache

# one mark-up item; what is no item stays text ("a < b")
ITEM = re.compile(
    r"""<!--(?:>|->)?(?:.*?(?:-->|--!>)|.*\Z)|<!\[CDATA\[.*?\]\]>
    |<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[\s/]++|[^\s>/][^\s>/=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)
    |<[!?/][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s>/=][^\s>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav noscript ol optgroup
    option p pre search section select summary svg table tbody td template tfoot th thead tr ul video audio canvas object math
    """.split()
)
CLOSES_P = BLOCKS - frozenset("button caption datalist head html body noscript optgroup option select svg tbody td template tfoot th thead tr video audio canvas object math legend".split())
# an opening element ends these open ones, up to the nearest of the limits
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
WALLS = frozenset("td th table caption button".split())  # a stray end tag, or a paragraph, does not reach through these

# elements that are not the main text, by name, by role, and by a word of their class or id
ASIDE_NAMES = frozenset(
    """aside audio button canvas datalist dialog fieldset footer form frameset head menu nav noscript object option
    search select svg template video math""".split()
)
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ASIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies
    disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo
    promotion related recommended recommendations replies reply respond search share sharing sidebar sidebars signup skip social
    sponsor sponsored subscribe subscription teaser teasers toolbar widget widgets""".split()
)
PAGE_HEAD_WORDS = frozenset("header masthead topbar".split())  # outside an article
MAIN_WORDS = frozenset("article content entry main post story".split())

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d+")


@lru_cache(maxsize=1 << 14)
def _attributes(rest: str) -> tuple[tuple[str, str], ...]:
    wanted = ("class", "id", "role", "itemprop")
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        if name.lower() in wanted:
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return tuple(found.items())


@lru_cache(maxsize=1 << 14)
def label(name: str, attributes: tuple[tuple[str, str], ...], in_article: bool) -> str:
    """How an element stands in a path: name, id and classes, numbers as ``#``; ``!`` in front if it is not main text."""
    given = dict(attributes)
    names = [_NUMBER.sub("#", x).replace("/", "|") for x in (*given.get("id", "").split(), *sorted(given.get("class", "").split()))]
    words = {w.lower() for x in (given.get("id", ""), given.get("class", "")) for w in _WORD.findall(x)}
    drop = name in ASIDE_NAMES or given.get("role", "").strip().lower() in ASIDE_ROLES or given.get("itemprop") == "comment"
    if name not in ("html", "body", "main"):
        drop = drop or bool(words & ASIDE_WORDS) and not (name == "article" and words & MAIN_WORDS)
        drop = drop or not in_article and (name == "header" or bool(words & PAGE_HEAD_WORDS) and not words & MAIN_WORDS)
    drop = drop or name == "article" and in_article  # an article within one is a comment on it
    return ("!" if drop else "") + ".".join((name, *names))


def blocks(page: str) -> tuple[list[tuple[str, str]], list[tuple[str, int]]]:
    """(texts, opened) of a page: the blocks of text as (path, text) in page order, with references decoded and
    white space as single blanks, and the path of each element opened with the number of blocks before it.

    Any text ends: broken mark-up is read as browsers do where it matters here (implied ends of
    paragraphs, items and cells, stray ends, unfinished comments, scripts and tags).
    """
    texts: list[tuple[str, str]] = []
    opened: list[tuple[str, int]] = []
    stack: list[tuple[str, str]] = []  # (name, path)
    articles = 0
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                texts.append((stack[-1][1] if stack else "", text))

    def pop(depth: int) -> None:
        nonlocal articles
        articles -= sum(name == "article" for name, _ in stack[depth:])
        del stack[depth:]

    def find(names: set | frozenset, limits: set | frozenset) -> int | None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                return depth
            if stack[depth][0] in limits:
                return None
        return None

    at = 0
    while True:
        item = ITEM.search(page, at)
        if item is None:
            held.append(page[at:])
            flush()
            return texts, opened
        if item.start() > at:
            held.append(page[at : item.start()])
        at = item.end()
        name = item["name"]
        if name is None:
            continue
        name = name.lower()
        if item["end"]:
            if name not in BLOCKS and not any(n == name for n, _ in stack[-3:]):
                continue
            flush()
            if name in ("body", "html"):
                continue
            depth = find({name}, WALLS - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset())
            if depth is not None and (name in BLOCKS or not any(n in BLOCKS for n, _ in stack[depth + 1 :])):
                pop(depth)
            continue
        if name == "br":
            held.append(" ")
        elif name == "hr":
            flush()
        if name in VOID:
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        rest = item["rest"]
        marked = _attributes(rest) if rest else ()
        if name not in BLOCKS and not (marked and label(name, marked, articles > 0)[0] == "!"):
            continue
        flush()
        if rest.endswith("/") and name in ("svg", "math"):
            continue
        if name in CLOSES_P and (depth := find({"p"}, WALLS)) is not None:
            pop(depth)
        if name in ENDED_BY:
            while (depth := find(*ENDED_BY[name])) is not None:
                pop(depth)
        if name in ("html", "body") and any(n == name for n, _ in stack):
            continue
        path = (stack[-1][1] if stack else "") + "/" + label(name, marked, articles > 0)
        articles += name == "article"
        stack.append((name, path))
        opened.append((path, len(texts)))
