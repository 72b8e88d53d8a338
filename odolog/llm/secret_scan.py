"""Secret scan with corpus-wide ownership frequency (operator 2).

Candidates are found by patterns in whole texts. Every candidate value is hashed, and over the whole
corpus the distinct repositories and owners that hold the value are counted. A value that many
owners or repositories share is a widely copied example; one that few owners hold and that looks
random is owner-specific and probably live.

Everything is column expressions and joins of small rows: the texts are scanned once and never
shuffled. Counts are combined before the shuffle, and a value held by a third of all documents is
one row in the table of values; the join back splits its candidates over tasks (adaptive skew join).

Spark has no function for match positions. As matches do not overlap, the pieces between them
(``split``) and the matches themselves (``regexp_extract_all``) give the positions by running sums.

Defined results: a null text counts as empty and has no candidates; a null repository or owner is
not counted; repeated rows are scanned one by one and all returned; an empty table gives an empty
result; other columns of the input are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from odolog.llm.common import let
from odolog.session import durable


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int = 0  # the group that holds the secret itself
    least: int = 1  # characters of that group


#: Base kinds, in the order that breaks ties. A shorter match is dropped after it has been consumed.
BASE = [
    Kind(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Kinds with a fixed, public form that the base ones miss.
FURTHER = [
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}"),
]
KINDS = [*BASE, *FURTHER]
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0123456|1234567|abcdef"


@dataclass(frozen=True)
class Ownership:
    """A value is a copied example from this many owners or repositories on."""

    owners: int = 3
    repositories: int = 8


def _scan(a: Column) -> Column:
    """Sums of the elements before each element (quadratic, for short arrays)."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("r"))
    return F.aggregate(
        a,
        zero,
        lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["r"], F.array(acc["s"])).alias("r")),
        lambda acc: acc["r"],
    )


def sums_before(a: Column, block: int = 128) -> Column:
    """Sums of the elements before each element of a non-empty array, block by block."""

    def blocks(c: Column) -> Column:
        totals = F.transform(c, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y))
        return let(
            _scan(totals),
            lambda before: F.flatten(
                F.transform(c, lambda x, i: let(_scan(x), lambda s: F.transform(s, lambda y: y + F.get(before, i))))
            ),
        )

    starts = F.sequence(F.lit(0), F.size(a) - F.lit(1), F.lit(block))
    return let(F.transform(starts, lambda k: F.slice(a, k + F.lit(1), F.lit(block))), blocks)


def match_starts(matches: Column, between: Column) -> Column:
    """Start of each match, from the matches and the pieces between them."""

    def length(s: Column) -> Column:
        return F.char_length(s).cast("long")

    steps = F.transform(matches, lambda m, i: length(F.get(between, i)) + length(m))
    return let(steps, lambda x: F.transform(sums_before(x), lambda s, i: s + length(F.get(between, i))))


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    pattern = F.lit(kind.pattern)
    none = F.array().cast(
        "array<struct<start:bigint,rank:int,end:bigint,hash:string,random:boolean>>"
    )

    def located(m: Column) -> Column:
        starts = match_starts(m, F.split(text, kind.pattern, -1))
        values = m if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))

        def spans(x: Column) -> Column:
            all_ = F.transform(
                m,
                lambda s, i: F.struct(
                    F.get(x["starts"], i).alias("start"),
                    F.lit(rank).alias("rank"),
                    (F.get(x["starts"], i) + F.char_length(s)).alias("end"),
                    F.get(x["values"], i).alias("hash"),
                    F.lit(False).alias("random"),
                ),
            )
            long_enough = F.filter(all_, lambda s: F.char_length(s["hash"]) >= F.lit(kind.least))
            return F.transform(
                long_enough,
                lambda s: F.struct(
                    s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
                    F.sha2(s["hash"], 256).alias("hash"), looks_random(s["hash"]).alias("random"),
                ),
            )

        return let(F.struct(starts.alias("starts"), values.alias("values")), spans)

    return let(
        F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, located(m)).otherwise(none)
    )


def looks_random(value: Column) -> Column:
    """At least 8 different characters, a digit among them, and no placeholder word."""
    return (
        (F.size(F.array_distinct(F.split(value, ""))) >= 8)
        & value.rlike("[0-9]")
        & ~value.rlike(PLACEHOLDER)
    )


def joined(spans: Column, kinds: list[Kind]) -> Column:
    """``kind:start:end`` of each span, by start and kind, separated by commas."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find(docs: DataFrame, columns: list[str], text: str = "text", kinds: list[Kind] | None = None) -> DataFrame:
    """``columns`` and ``spans``: start, rank of the kind, end, hash of the value, whether it looks random."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = [_spans(whole, i, k) for i, k in enumerate(kinds or KINDS)]
    return docs.select(*columns, F.array_sort(F.concat(*parts)).alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per value (``hash``): distinct repositories and owners in the whole corpus."""
    return candidates.groupBy("hash").agg(
        F.count_distinct("_repo").alias("repositories"), F.count_distinct("_owner").alias("owners")
    )


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    kinds: list[Kind] | None = None,
    limits: Ownership = Ownership(),
) -> DataFrame:
    """Per document: its key, ``spans`` and the numbers of its candidates that are owner-specific and
    look live (``n_live``), that are copied examples (``n_copied``) and that are neither (``n_weak``)."""
    source = docs.select(
        F.col(key).alias("_key"), F.col(repository).alias("_repo"), F.col(owner).alias("_owner"), F.col(text).alias("_text")
    )
    found = durable(
        find(source, ["_key", "_repo", "_owner"], "_text", kinds).withColumn("_row", F.monotonically_increasing_id())
    )
    candidates = found.select("_row", "_repo", "_owner", F.explode("spans").alias("_s")).select(
        "_row", "_repo", "_owner", F.col("_s.hash").alias("hash"), F.col("_s.random").alias("random")
    )
    shared = durable(ownership(candidates))
    copied = (F.col("owners") >= limits.owners) | (F.col("repositories") >= limits.repositories)
    verdicts = (
        candidates.join(shared, "hash")
        .groupBy("_row")
        .agg(
            F.count_if(~copied & F.col("random")).alias("n_live"),
            F.count_if(copied).alias("n_copied"),
            F.count_if(~copied & ~F.col("random")).alias("n_weak"),
        )
    )
    return found.join(verdicts, "_row", "left").select(
        F.col("_key").alias(key), "spans",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "n_weak")],
    )


def digest(scanned: DataFrame, kinds: list[Kind] | None = None) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    kinds = kinds or KINDS

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == F.lit(rank))).cast("long")

    base = F.filter("spans", lambda s: s["rank"] < F.lit(len(BASE)))
    return scanned.select(
        "doc_id",
        *[count(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)],
        F.sha2(joined(base, kinds), 256).alias("base_sha256"),
        joined(F.col("spans"), kinds).alias("spans"),
        "n_live", "n_copied", "n_weak",
    )
