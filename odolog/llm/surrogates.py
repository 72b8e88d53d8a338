"""Surrogates for personal data (operator 5).

E-mail addresses, IP addresses, card numbers (with a right check digit), social security numbers,
telephone numbers and names after a title are found in whole texts, with every other mention of a text's
own names (whole words with a capital initial), and replaced by made-up ones of
the same type and look: digits keep their separators, cards their length, issuer digit and check
digit, letters their script and case, given names the gender of the title.

Surrogates are keyed hashes of the *entity*, not of the mention, so the same entity has the same
surrogate in the whole corpus, however it is written (``555-123-4567`` and ``(555) 123 4567``; ``Mr. Ada
Lo`` and ``Ms. Lo`` share the family name). Within a text a name is one entity, whatever its titles and place: a given name
if it stands before another name anywhere, of the gender its titles agree on. Two entities never share a surrogate, and no surrogate is
an entity of the corpus: candidates that collide are drawn again with the next attempt number, until
none is left. That is done on the table of distinct entities, which is aggregated before any shuffle.

Not found: names without any title in their text (the titles are a short list), street addresses, birth dates, IPv6
addresses and bank account numbers; a private IP address may become a public one.

Everything is column expressions. Texts without a find are never shuffled; the others are joined once
with their replacements. A hot entity is one row of the entity table; the join of mentions with it
splits over tasks (adaptive skew join).

Defined results: a null text stays null; an empty one empty; rows are told apart by key and text, so
repeated rows and repeated keys get the same, right replacements; an empty table gives an empty
result; all other columns are returned as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from odolog.llm.common import let, stored
from odolog.session import durable

_BEFORE = r"(?<![\p{L}\p{N}+.])"
_AFTER = r"(?![\p{L}\p{N}]|[.-]\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: The repeated group is possessive: Java matches it in a loop, others by recursion, which long texts would end.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
CARD = r"\d(?:[ -]?\d){12,18}"
#: Digits with single or repeated separators; ``_run_pieces`` finds the cards and other numbers in it.
RUN = r"\d[\d -]{11,}\d"
#: How cards are written: unbroken, or in the groups of their issuers with one separator.
GROUPED = r"\d{13,19}|" + "|".join(f"\\d{{4}}{s}" + s.join(rest) for s in " -" for rest in ([r"\d{4}"] * 3, [r"\d{6}", r"\d{4,5}"]))
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = (
    r"(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}"
    r"|(?:\+?1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|\+\d{1,3}[ -]\(?\d{1,5}\)?(?:[ -]?\d{2,8}){1,3}"
    r"|\+\d{8,15}"
)
#: Titles by the gender they tell (fixed values).
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Señorita", "Госпожа"],
    "n": ["Dr", "Prof", "Доктор"],
}
_TITLE = "|".join(form for titles in TITLES.values() for t in titles for form in (t, t.upper()))
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}"
ANY = f"{EMAIL}|{_BEFORE}{IP}{_AFTER}|{_BEFORE}{SSN}{_AFTER}|{_BEFORE}{RUN}{_AFTER}|{_BEFORE}(?:{PHONE}){_AFTER}|{PERSON}"

_ITEM = "array<struct<type:string,entity:string>>"
_LATIN = ("bdfgklmnprstvz", "aeiou", {"m": "on", "f": "ia", "n": "e", "family": "er"})
_CYRILLIC = ("бвгдзклмнпрст", "аеиоу", {"m": "он", "f": "ина", "n": "е", "family": "ко"})
_ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the check of a digit string, the last digit counting once."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(
        F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value),
        F.lit(0), lambda s, x: s + x,
    )


def _bare(word: Column) -> Column:
    """A name without the ending of a genitive."""
    return F.regexp_replace(word, "('[sS]|')$", "")


def _items(mention: Column) -> Column:
    """Type and entity of what a mention names; several for a person, none for a false alarm. The types of names tell
    what one mention says (``only``: one word after a title); ``_settled`` decides for the text."""

    def one(kind: str, entity: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("type"), entity.alias("entity"))).cast(_ITEM)

    def person(words: Column) -> Column:
        title = F.initcap(F.regexp_replace(F.get(words, F.lit(0)), r"\.", ""))
        given = F.lit("given n")
        for gender, titles in TITLES.items():
            given = F.when(title.isin(titles), F.lit(f"given {gender}")).otherwise(given)
        last = F.size(words) - F.lit(1)
        return F.filter(
            F.transform(
                words,
                lambda w, i: F.struct(
                    F.when((i == last) & (i == 1), F.concat(F.lit("only "), given)).when(i == last, F.lit("family")).otherwise(given).alias("type"),
                    _bare(F.lower(w)).alias("entity"), i.alias("i"),
                ),
            ),
            lambda x: x["i"] > 0,
        ).cast("array<struct<type:string,entity:string,i:int>>")

    names = let(F.split(mention, " "), lambda w: F.transform(person(w), lambda x: F.struct(x["type"].alias("type"), x["entity"].alias("entity"))))
    card = let(_digits(mention), lambda d: F.when(luhn_sum(d) % 10 == 0, one("card", d)).otherwise(F.array().cast(_ITEM)))
    return (
        F.when(mention.contains("@"), one("email", F.lower(mention)))
        .when(mention.rlike(r"^\p{L}"), names.cast(_ITEM))
        .when(mention.rlike(f"^{IP}$"), one("ip", mention))
        .when(mention.rlike(f"^{SSN}$"), one("ssn", _digits(mention)))
        .when(mention.rlike(f"^{CARD}$") & ~mention.rlike(f"^(?:{PHONE})$"), card)
        .otherwise(one("phone", F.right(_digits(mention), F.lit(10))))
    )


def _byte(h: Column, i: Column) -> Column:
    """A number from 0 to 255 out of a hex hash; the index wraps."""
    return F.conv(F.substr(h, (i % 32) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _hash_digits(h: Column) -> Column:
    """64 digits out of a hex hash."""
    return F.translate(h, "abcdef", "012345")


def _card(entity: Column, h: Column) -> Column:
    body = F.concat(F.left(entity, F.lit(1)), F.substr(_hash_digits(h), F.lit(1), F.length(entity) - F.lit(2)))
    return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def _ip(h: Column) -> Column:
    first = _byte(h, F.lit(0)) % 223 + 1
    return F.concat_ws(".", first.cast("string"), *[_byte(h, F.lit(i)).cast("string") for i in (1, 2, 3)])


def _email(entity: Column, h: Column, attempt: Column, key: str) -> Column:
    def letter(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("^[0-9]$"), (_byte(h, i) % 10).cast("string"))
        for alphabet in _ALPHABETS:
            out = out.when(c.rlike(f"^[{alphabet}]$"), F.substr(F.lit(alphabet), _byte(h, i) % len(alphabet) + 1, F.lit(1)))
        return out.when(c.rlike(r"^\p{L}$"), F.substr(F.lit(_ALPHABETS[0]), _byte(h, i) % 26 + 1, F.lit(1))).otherwise(c)

    local = F.array_join(F.transform(F.split(F.substring_index(entity, "@", 1), ""), letter), "")
    again = F.when(attempt > 0, F.substr(_hash_digits(h), F.lit(1), F.least(attempt * 4, F.lit(60)))).otherwise(F.lit(""))
    domain = F.substr(F.sha2(F.concat(F.lit(key + "|domain|"), F.substring_index(entity, "@", -1)), 256), F.lit(1), F.lit(12))
    return F.concat(local, again, F.lit("@d"), domain, F.lit(".example"))


def _name(entity: Column, kind: Column, h: Column, attempt: Column) -> Column:
    def syllables(consonants: str, vowels: str, endings: dict[str, str]) -> Column:
        body = F.transform(
            F.sequence(F.lit(0), attempt + F.lit(2)),
            lambda i: F.concat(
                F.substr(F.lit(consonants), _byte(h, i * 2) % len(consonants) + 1, F.lit(1)),
                F.substr(F.lit(vowels), _byte(h, i * 2 + 1) % len(vowels) + 1, F.lit(1)),
            ),
        )
        ending = reduce(
            lambda out, g: F.when(kind == F.lit(g if g == "family" else f"given {g}"), F.lit(endings[g])).otherwise(out),
            endings, F.lit(""),
        )
        return F.concat(F.array_join(body, ""), ending)

    return F.when(entity.rlike(r"\p{IsCyrillic}"), syllables(*_CYRILLIC)).otherwise(syllables(*_LATIN))


def candidate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity at an attempt, in canonical form (lower case, digits only)."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt.cast("string")), 256)
    return (
        F.when(kind == "email", _email(entity, h, attempt, key))
        .when(kind == "ip", _ip(h))
        .when(kind == "card", _card(entity, h))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(_hash_digits(h), F.lit(1), F.lit(8))))
        .when(kind == "phone", F.substr(_hash_digits(h), F.lit(1), F.length(entity)))
        .otherwise(_name(entity, kind, h, attempt))
    )


def assign(entities: DataFrame, key: str, attempts: int = 50) -> DataFrame:
    """``surrogate`` for distinct entities (``type``, ``entity``): distinct per type, and none of the entities."""
    taken = None
    pending = entities
    for attempt in range(attempts):
        drawn = pending.select(
            "type", "entity", candidate(F.col("type"), F.col("entity"), F.lit(attempt), key).alias("surrogate")
        )
        if taken is not None:
            drawn = drawn.join(taken.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        real = entities.select("type", F.col("entity").alias("surrogate"))
        free = drawn.join(real, ["type", "surrogate"], "left_anti")
        won = durable(free.groupBy("type", "surrogate").agg(F.min("entity").alias("entity")))
        taken = won if taken is None else durable(taken.unionByName(won))
        pending = durable(pending.join(won.select("type", "entity"), ["type", "entity"], "left_anti"))
        if pending.isEmpty():
            return taken
    raise ValueError(f"entities without a distinct surrogate after {attempts} attempts")


def _cased(mention: Column, surrogate: Column) -> Column:
    upper = (mention == F.upper(mention)) & (F.length(mention) > 1)
    return F.concat(F.when(upper, F.upper(surrogate)).otherwise(F.initcap(surrogate)), F.regexp_extract(mention, "('[sS]|')$", 0))


def _redigit(mention: Column, digits: Column) -> Column:
    """``mention`` with its last digits replaced, separators and leading digits kept."""

    def fill(d: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(mention, "[0-9]", -1),
                lambda p, i: F.concat(F.when(i > 0, F.substr(d, i, F.lit(1))).otherwise(F.lit("")), p),
            ),
            "",
        )

    own = _digits(mention)
    return let(F.concat(F.left(own, F.length(own) - F.length(digits)), digits), fill)


def render(mention: Column, kind: Column, surrogates: Column) -> Column:
    """What replaces a mention. ``surrogates`` has one element, or one per word of a name."""
    first = F.get(surrogates, F.lit(0))

    def named(words: Column) -> Column:
        titled = F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(_cased(w, F.get(surrogates, i - F.lit(1)))))
        return F.when(F.size(words) == 1, _cased(mention, first)).otherwise(F.array_join(titled, " "))

    return (
        F.when(kind == "email", F.when(mention == F.upper(mention), F.upper(first)).otherwise(first))
        .when(kind == "ip", first)
        .when(kind.isin("card", "ssn", "phone"), _redigit(mention, first))
        .otherwise(let(F.split(mention, " "), named))
    )


def _piece(gap: Column, mention: Column, name: bool = False) -> Column:
    """``name``: a name without a title."""
    return F.struct(gap.alias("gap"), mention.cast("string").alias("mention"), F.lit(name).alias("name"))


#: A window of 1 to 19 numbers as a letter; ``.`` where no window begins. The pattern takes, from left to right, each window
#: that begins after the last one taken: a regular expression walks through in one pass where a fold copies its state at each step.
_LETTERS = "ABCDEFGHIJKLMNOPQRS"
_WALK = "|".join(f"{c}[A-S.]{{{k}}}" for k, c in enumerate(_LETTERS)) + r"|\."


def _first_free(codes: Column) -> Column:
    """``codes`` with a letter only where a window is taken."""
    covered = lambda x: F.concat(F.array(F.left(x, F.lit(1))), F.array_repeat(F.lit("."), F.length(x) - 1))
    return F.flatten(F.transform(F.regexp_extract_all(F.array_join(codes, ""), F.lit(_WALK), F.lit(0)), covered))


def _joined(tokens: Column, first: Column, last: Column) -> Column:
    """The tokens from first to last as one text. (``slice`` would copy all tokens first.)"""
    return F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(tokens, i)), "")


def _run_pieces(run: Column) -> Column:
    """A run of digits cut into its numbers. Cards written as cards are are taken first, then, in what is left between, social
    security and telephone numbers, then other cards: groups of three digits and more, or as far as the run is one. Of those
    that overlap the first is taken, the longest of equal starts. Each start has few windows, so long runs take time in proportion."""

    def spans(tokens: Column) -> Column:  # digits and separators in turn
        last = F.size(tokens) - 1

        def is_card(text: Column, s: Column, e: Column) -> Column:
            return text.rlike(f"^{CARD}$") & (luhn_sum(_digits(text)) % 10 == 0)

        def grouped(text: Column, s: Column, e: Column) -> Column:
            return text.rlike(f"^(?:{GROUPED})$") & is_card(text, s, e)

        def other(text: Column, s: Column, e: Column) -> Column:
            return text.rlike(f"^(?:{SSN}|{PHONE})$") & ~F.coalesce(F.get(tokens, e + 1) == "-", F.lit(False))

        def loose(text: Column, s: Column, e: Column) -> Column:
            whole = (s == 0) & ((e == last) | (F.length(_digits(text)) + F.length(F.get(tokens, e + 2)) > 19))
            return (whole | ~text.rlike(r"(?:^|[ -])\d{1,2}(?:[ -]|$)")) & is_card(text, s, e)

        def found(first: Column, end: Column, lengths: tuple[int, ...], wanted) -> Column:  # in tokens first to end
            def code(s: Column) -> Column:  # of the longest window
                def fits(n: Column) -> Column:
                    e = s + n
                    return F.when(e <= end, let(_joined(tokens, s, e), lambda t: (F.length(t) <= 37) & wanted(t, s, e))).otherwise(F.lit(False))

                n = F.get(F.filter(F.array(*[F.lit(n) for n in lengths]), fits), F.lit(0))
                return F.coalesce(F.substr(F.lit(_LETTERS), (n / 2).cast("int") + 1, F.lit(1)), F.lit("."))

            def window(c: Column, i: Column) -> Column:
                s = first + i * 2
                e = s + (F.instr(F.lit(_LETTERS), c) - 1) * 2
                return F.when(c != ".", F.struct(s.alias("s"), e.alias("e"), _joined(tokens, s, e).alias("text")))

            starts = F.when(first <= end, F.sequence(first, F.greatest(first, end), F.lit(2))).otherwise(F.array().cast("array<int>"))
            return F.filter(F.transform(_first_free(F.transform(starts, code)), window), lambda c: c.isNotNull())

        def with_rest(taken: Column, lengths: tuple[int, ...], wanted) -> Column:  # and what is found between them
            def rest(c: Column, i: Column) -> Column:
                first = F.coalesce(F.get(taken, i - 1)["e"] + 2, F.lit(0))
                between = found(first, c["s"] - 2, lengths, wanted)
                return F.when(c["text"].isNull(), between).otherwise(F.concat(between, F.array(c)))

            end = F.struct((last + 2).alias("s"), (last + 2).alias("e"), F.lit(None).cast("string").alias("text"))
            return F.flatten(F.transform(F.concat(taken, F.array(end)), rest))

        def seconds(cards: Column) -> Column:
            return let(with_rest(cards, (6, 4), other), lambda some: with_rest(some, tuple(range(36, -1, -2)), loose))

        return let(found(F.lit(0), last, (6, 4, 0), grouped), seconds)

    def cut(tokens: Column) -> Column:
        def between(first: Column, end: Column) -> Column:
            return F.when(first < end, _joined(tokens, first, F.greatest(first, end - 1))).otherwise(F.lit(""))

        def pieces(found: Column) -> Column:
            after = lambda i: F.coalesce(F.get(found, i - 1)["e"] + 1, F.lit(0))
            numbers = F.transform(found, lambda c, i: _piece(between(after(i), c["s"]), c["text"]))
            return F.concat(numbers, F.array(_piece(between(after(F.size(found)), F.size(tokens)), F.lit(None))))

        return let(spans(tokens), pieces)

    return let(F.regexp_extract_all(run, F.lit(r"\d+|[ -]+"), F.lit(0)), cut)


def _pieces(text: Column) -> Column:
    """``text`` in order: what stands before each mention, and the mention; null where there is only text."""

    def cut(found: Column, between: Column) -> Column:
        def parts(m: Column, i: Column) -> Column:
            gap = F.get(between, i)
            bare = m.rlike(r"^\p{L}[\p{L}'-]*$")
            clear = ~m.rlike(f"^{RUN}$") | (m.rlike(f"^(?:{GROUPED})$") & (luhn_sum(_digits(m)) % 10 == 0))
            inside = F.concat(F.array(_piece(gap, F.lit(None))), _run_pieces(m))
            return F.when(bare, F.array(_piece(gap, m, True))).when(clear, F.array(_piece(gap, m))).otherwise(inside)

        end = F.array(_piece(F.get(between, F.size(found)), F.lit(None)))
        return F.concat(F.flatten(F.transform(found, parts)), end)

    def again(names: Column) -> Column:
        """The pattern with the text's own names, as whole words with a capital initial."""
        words = F.array_join(F.transform(F.reverse(F.array_sort(names)), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|")
        bare = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?iu:"), words, F.lit(r")(?![\p{L}\p{N}])"))
        found = F.regexp_extract_all(text, bare, F.lit(0))
        return let(found, lambda f: let(F.split(text, bare, -1), lambda between: cut(f, between)))

    def pieces(found: Column) -> Column:
        plain = let(F.split(text, ANY, -1), lambda between: cut(found, between))
        return let(_names(found), lambda n: F.when(F.size(n) == 0, plain).otherwise(again(n)))

    return let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), pieces)


def _names(found: Column) -> Column:
    """Distinct names after titles among the matches, in lower case."""
    titled = F.filter(found, lambda m: m.rlike(r"^\p{L}") & ~m.contains("@"))
    return F.array_distinct(F.flatten(F.transform(titled, lambda m: F.transform(_items(m), lambda x: x["entity"]))))


def _settled(found: DataFrame) -> DataFrame:
    """``found`` with one type per name and text: a given name if any mention has it before another word, else a family
    name; its gender is that of the titles, none if they differ."""
    kind = F.regexp_replace("type", "^only ", "")
    name = F.col("type").rlike("^(?:only |given |family|name)")
    votes = (
        found.where(name)
        .groupBy("_key", "_hash", "entity")
        .agg(
            F.max(F.col("type").startswith("given ")).alias("given"),
            F.max(kind == "given m").alias("m"),
            F.max(kind == "given f").alias("f"),
        )
    )
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n")
    settled = votes.select(
        F.col("_key").alias("_key2"), F.col("_hash").alias("_hash2"), F.col("entity").alias("_entity2"),
        F.when(F.col("given"), F.concat(F.lit("given "), gender)).otherwise("family").alias("_type2"),
    )
    same = F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_hash") == F.col("_hash2")) & (F.col("entity") == F.col("_entity2"))
    names = found.where(name).join(settled, same).withColumn("type", F.col("_type2")).select(*found.columns)
    return found.where(~name).unionByName(names)


def mentions(pieces: DataFrame) -> DataFrame:
    """One row per mention and entity in it, out of (``_key``, ``_hash`` of the text, ``_pieces``): the number of the piece
    ``i``, the mention, the number ``j`` of the item, its type and entity. Repeated texts of a key count once."""
    numbered = F.transform("_pieces", lambda p, i: F.struct(i.alias("i"), p["mention"].alias("mention"), p["name"].alias("name")))
    found = pieces.select("_key", "_hash", F.explode(F.filter(numbered, lambda p: p["mention"].isNotNull())).alias("_m"))
    mention = F.col("_m.mention")
    bare = F.array(F.struct(F.lit("name").alias("type"), F.lower(mention).alias("entity"))).cast(_ITEM)
    found = found.select(
        "_key", "_hash", F.col("_m.i").alias("i"), mention.alias("mention"),
        F.posexplode(F.when(F.col("_m.name"), bare).otherwise(_items(mention))).alias("j", "_item"),
    )
    rows = found.select("_key", "_hash", "i", "mention", "j", "_item.type", "_item.entity")
    return _settled(durable(rows.dropDuplicates(["_key", "_hash", "i", "j"])))


def _replaced(pieces: Column, new: Column) -> Column:
    """The text of ``pieces`` with mentions replaced: ``new`` is an array of (number of the piece, replacement), sorted."""

    def dense(new: Column) -> Column:  # the replacement of every piece up to the last one replaced, null for most
        def upto(n: Column, k: Column) -> Column:
            skipped = n["i"] - F.coalesce(F.get(new, k - 1)["i"], F.lit(-1)) - 1
            return F.concat(F.array_repeat(F.lit(None).cast("string"), skipped), F.array(n["by"]))

        return F.flatten(F.transform(new, upto))

    def build(by: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(p["gap"], F.coalesce(F.get(by, i), p["mention"], F.lit("")))), "")

    return let(dense(new), build)


def replace(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced. ``secret`` keys the surrogates. ``count``
    names a column for the number of mentions replaced.

    Each text is searched once: the rows are written with the pieces of those that have a find, and read again for the mentions
    and for the result."""
    columns = docs.columns
    own = "_"  # what no column of the input begins with
    while any(c.lower().startswith(own) for c in columns):
        own += "_"
    found_in, hash_of = f"{own}pieces", f"{own}hash"
    marked = stored(
        docs.withColumns(
            {
                found_in: F.when(F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(ANY), _pieces(F.col(f"`{text}`"))),
                hash_of: F.xxhash64(f"`{text}`"),
            }
        )
    )
    hit = marked.where(F.col(found_in).isNotNull())
    found = mentions(hit.select(F.col(f"`{key}`").alias("_key"), F.col(hash_of).alias("_hash"), F.col(found_in).alias("_pieces")))
    found = durable(found)
    chosen = assign(durable(found.select("type", "entity").distinct()), secret)
    per_mention = (
        found.join(chosen, ["type", "entity"])
        .groupBy("_key", "_hash", "i")
        .agg(F.first("mention").alias("mention"), F.array_sort(F.collect_list(F.struct("j", "type", "surrogate"))).alias("s"))
    )
    by = render(F.col("mention"), F.get("s", F.lit(0))["type"], F.transform("s", lambda x: x["surrogate"]))
    per_text = (
        per_mention.select("_key", "_hash", F.struct("i", by.alias("by")).alias("_n"))
        .groupBy("_key", "_hash")
        .agg(F.array_sort(F.collect_list("_n")).alias("_new"))
    )
    per_text = per_text.select(F.col("_key").alias(f"{own}key2"), F.col("_hash").alias(f"{own}hash2"), F.col("_new").alias(f"{own}new"))
    new = F.col(f"{own}new")
    touched = hit.join(per_text, (F.col(hash_of) == F.col(f"{own}hash2")) & F.col(f"`{key}`").eqNullSafe(F.col(f"{own}key2")), "left")
    new_text = F.when(new.isNull(), F.col(f"`{text}`")).otherwise(_replaced(F.col(found_in), new))
    number = F.coalesce(F.size(new), F.lit(0)).cast("long")
    extra = [] if count is None else [number.alias(count)]
    touched = touched.select(*[new_text.alias(c) if c == text else F.col(f"`{c}`") for c in columns], *extra)
    others = marked.where(F.col(found_in).isNull())
    others = others.select(*[F.col(f"`{c}`") for c in columns], *([] if count is None else [F.lit(0).cast("long").alias(count)]))
    return touched.unionByName(others)
