"""Temperature mixing of sources (operator 6).

A source with ``t`` tokens gets the weight ``t ** alpha``, normalised: 1 keeps the natural shares, 0 makes all
sources equal. The exponent is bisected on a fine grid: the smallest that keeps every source within
``max_repeat`` passes over its documents, the largest whose mixture reaches ``entropy`` (a share of that of
equal sources), or, with both, the larger of the two, so the repetition limit always holds.

The weights become token budgets. A source's documents are hashed into blocks of about
``block_tokens``. A budget is realised as whole passes over the source, each in a permutation of its
blocks of its own, and a last pass that ends where the budget does: documents are taken in permuted
order while the tokens before them are below what is left. So sources with large weights repeat evenly
and those with small ones are sampled evenly. ``mix_key`` orders the result: sorted by it, the blocks
of all sources interleave in the proportions of the budgets.

Each source needs one row (blocks, whole passes, the place of the last document). It is found with sums
over blocks, in two levels of the permutation, and one sort inside the block where the budget ends:
no task holds a source. Documents meet the row of their source in a join that Spark broadcasts only
where the table of sources is small; they are not grouped or sorted.

Defined results: a null source is a source; a null text has no tokens; documents without tokens are
taken like others; a source without tokens is passed over once; equal rows share their place and are
taken together; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from odolog.llm.common import stored, word_array
from odolog.session import durable

GRID = 1 << 18  # steps of the exponent between 0 and 1
_FAN = 64  # exponents tried per pass over the sources


def _hash(*parts: Column | str) -> Column:
    """60 bits of the md5 of the parts."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Words of a text; another count of tokens can be passed instead."""
    return F.size(word_array(text)).cast("long")


def _measures(sources: DataFrame, steps: list[int], budget: float) -> dict[int, tuple[float, float]]:
    """Per grid step: the largest number of passes over a source, and the entropy of the mixture."""
    t = F.col("t").cast("double")
    sums: list[Column] = []
    for k in steps:
        alpha = F.lit(k / GRID)
        power = F.pow(t, alpha)
        sums += [F.sum(power), F.max(F.pow(t, alpha - F.lit(1.0))), F.sum(power * F.log(t))]
    row = sources.filter("t > 0").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    found = {}
    for i, k in enumerate(steps):
        z, largest, logs = row[3 * i : 3 * i + 3]
        found[k] = (budget / z * largest, math.log(z) - k / GRID * logs / z)
    return found


def _bisect(sources: DataFrame, budget: float, good, low: int, high: int) -> int:
    """Smallest step in (low, high] that is ``good``, where ``high`` counts as good and goodness is monotone."""
    while high - low > 1:
        width = high - low
        steps = sorted({low + max(1, width * (i + 1) // (_FAN + 1)) for i in range(_FAN)} - {high})
        found = _measures(sources, steps, budget)
        fits = [k for k in steps if good(*found[k])]
        high = min(fits, default=high)
        low = max([k for k in steps if k < high], default=low)
    return high


def exponent(sources: DataFrame, budget: int, max_repeat: float | None, entropy: float | None) -> float:
    """The exponent for sources (``t`` tokens each) and a budget of tokens."""
    if sources.filter("t > 0").isEmpty():
        return 1.0
    chosen = 0 if max_repeat is not None or entropy is not None else GRID
    if entropy is not None:
        wanted = entropy * math.log(max(1, sources.filter("t > 0").count()))
        # the step before the first that falls short
        chosen = max(chosen, _bisect(sources, budget, lambda _, h: h < wanted - 1e-12, -1, GRID + 1) - 1)
    if max_repeat is not None:
        chosen = max(chosen, _bisect(sources, budget, lambda r, _: r <= max_repeat, -1, GRID))
    return chosen / GRID


def plan(
    counted: DataFrame, max_repeat: float | None, entropy: float | None, budget: int | None, block_tokens: int, seed: str
) -> DataFrame:
    """Per source: blocks, budget, whole passes, and the place where the last, partial pass ends.

    ``counted`` is a durable table (``_source``, ``_h``, ``_t``)."""
    sources = durable(counted.groupBy("_source").agg(F.sum("_t").alias("t")))
    total = sources.agg(F.sum("t")).first()[0] or 0
    wanted = total if budget is None else budget
    if max_repeat is not None:  # at natural shares every source is taken budget / total times, and no exponent takes the rarest less
        wanted = min(wanted, int(total * max_repeat))
    alpha = exponent(sources, wanted, max_repeat, entropy)
    z = sources.filter("t > 0").agg(F.sum(F.pow(F.col("t").cast("double"), F.lit(alpha)))).first()[0] or 1.0
    share = F.floor(F.pow(F.col("t").cast("double"), F.lit(alpha)) / F.lit(float(z)) * F.lit(float(wanted))).cast("long")
    budgets = durable(
        sources.withColumn("budget", F.when(F.col("t") > 0, share).otherwise(F.lit(0).cast("long")))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("t") / F.lit(block_tokens))).cast("long"))
        .withColumn("whole", F.when(F.col("t") > 0, F.floor(F.col("budget") / F.col("t"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.when(F.col("t") > 0, F.col("budget") % F.col("t")).otherwise(F.lit(0).cast("long")))
    )
    rows = with_source(counted, budgets, F.col("_source"))
    # tokens per block, in the order of the partial pass; 4,096 stretches of that order, then blocks within one
    blocks = durable(
        rows.groupBy("_source", block_of("_h").alias("_block"), "whole", "rest").agg(F.sum("_t").alias("n"))
        .withColumn("_place", _hash(seed, F.col("_source"), F.col("whole"), F.col("_block")))
        .withColumn("_stretch", F.shiftright("_place", 48))
    )
    earlier = Window.partitionBy("_source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = blocks.groupBy("_source", "_stretch").agg(F.sum("n").alias("n")).select(
        F.col("_source").alias("_s2"), F.col("_stretch").alias("_t2"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("_source", "_stretch").orderBy("_place", "_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = durable(
        blocks.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(stretches, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_stretch") == F.col("_t2")))
        .withColumn("left", F.col("rest") - F.col("before") - F.col("_in"))
        .filter("left > 0 and left <= n")
        .select(F.col("_source").alias("_s2"), F.col("_block").alias("_end"), F.col("_place").alias("_end_place"), "left")
    )
    last = Window.partitionBy("_source").orderBy("_h").rangeBetween(Window.unboundedPreceding, -1)
    cut = (
        rows.withColumn("_block", block_of("_h"))
        .join(ends, F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_block") == F.col("_end")))
        .withColumn("_in", F.coalesce(F.sum("_t").over(last), F.lit(0)))
        .filter("_in < left")
        .groupBy("_source", "_end", "_end_place").agg(F.max("_h").alias("_end_h"))
        .withColumnRenamed("_source", "_s2")
    )
    return stored(  # a table of known size: Spark broadcasts it where it is small, and the texts stay in place
        budgets.join(cut, F.col("_source").eqNullSafe(F.col("_s2")), "left").select(
            F.col("_source").alias("_mix_source"), "t", "budget", "blocks", "whole", "rest", "_end", "_end_place", "_end_h"
        )
    )


def with_source(rows: DataFrame, budgets: DataFrame, source: Column) -> DataFrame:
    named = budgets.select(F.col("_source").alias("_s1"), "blocks", "whole", "rest")
    return rows.join(named, source.eqNullSafe(F.col("_s1"))).drop("_s1")


def block_of(h: str) -> Column:
    return F.pmod(F.col(h), F.col("blocks"))


def mix(
    docs: DataFrame,
    max_repeat: float | None = 1.25,
    entropy: float | None = None,
    budget: int | None = None,
    block_tokens: int = 1 << 16,
    seed: str = "mix",
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    count: Column | None = None,
) -> DataFrame:
    """``docs``, a row per pass that takes it, with ``_mix`` (tokens, copy, block, mix_key).

    ``budget`` is in tokens; one that ``max_repeat`` does not allow is lowered to what it does. ``count`` is the number of tokens of
    a row, its words if not given."""
    size = tokens(F.col(text)) if count is None else F.coalesce(count, F.lit(0)).cast("long")
    marked = docs.withColumns(
        {"_mix_h": _hash(seed, F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")))), "_mix_t": size}
    )
    counted = durable(marked.select(F.col(source).alias("_source"), F.col("_mix_h").alias("_h"), F.col("_mix_t").alias("_t")))
    found = plan(counted, max_repeat, entropy, budget, block_tokens, seed)
    terms = found.select(
        "_mix_source", F.struct("blocks", "whole", "_end", "_end_place", "_end_h").alias("_mix_plan")
    )
    p = F.col("_mix_plan")
    block = F.pmod(F.col("_mix_h"), p["blocks"])
    place = _hash(seed, F.col(source), p["whole"], block)
    earlier = (place < p["_end_place"]) | ((place == p["_end_place"]) & (block < p["_end"]))
    partial = F.coalesce(earlier | ((block == p["_end"]) & (F.col("_mix_h") <= p["_end_h"])), F.lit(False))
    copies = p["whole"] + partial.cast("int")
    joined = marked.join(terms, F.col(source).eqNullSafe(F.col("_mix_source"))).filter(copies > 0)
    copy = F.explode(F.sequence(F.lit(0), copies - 1)).alias("_mix_copy")
    return joined.select(*docs.columns, "_mix_h", "_mix_t", block.alias("_mix_block"), copy).select(
        *docs.columns,
        F.struct(
            F.col("_mix_t").alias("tokens"), F.col("_mix_copy").alias("copy"), F.col("_mix_block").alias("block"),
            _hash(seed, F.col(source), F.col("_mix_copy"), F.col("_mix_block")).alias("mix_key"),
        ).alias("_mix"),
    )
