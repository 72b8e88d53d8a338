"""Quality classifier: regularised quadratic discriminant (operator 8).

Whole texts become a dozen transformed statistics. Per class, Spark adds up counts, sums and products
over all labelled rows (two result rows, whatever the size of the corpus); the driver turns them into
means and covariances, shrinks each covariance towards the pooled one and that towards a multiple of
the identity, and keeps the inverses of the Cholesky factors. A score is the logistic function of the
difference of the classes' log densities (Mahalanobis distances) plus the log of their shares.

Statistics are column expressions computed once in the scan and made durable; the scores are numpy on
Arrow batches of these few numbers. Texts are not shuffled.

Labels count only where ``crc32(doc_id as text) % 3`` is not 1. Neither labels nor language, source or id
enter a score.

Defined results: a null text counts as empty and is scored like any other; labels that are null or not
0 or 1 are ignored, repeated ones count repeatedly; with no labelled row of a class every score is
0.5; a null id is never held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from odolog.llm.common import let, word_array
from odolog.llm.quality_rules import lines_with_words, n_dup_lines, n_repeat_words, n_symbols
from odolog.session import durable


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def statistics(text: Column) -> Column:
    """Array of transformed statistics: roots of shares and logs of sizes, so that none has a long tail."""
    whole = F.coalesce(text, F.lit(""))

    def count(pattern: str) -> Column:
        """Characters outside ``pattern``, a class of those to remove."""
        return F.char_length(F.regexp_replace(whole, pattern, "")).cast("double")

    def share(part: Column, of: Column) -> Column:
        return F.sqrt(part / F.greatest(of, F.lit(1.0)))

    def of_words(words: Column) -> Column:
        n = F.size(words).cast("double")
        different = F.size(F.array_distinct(words)).cast("double")
        letters = count(r"\P{L}+")
        lines = F.size(lines_with_words(whole)).cast("double")
        return F.array(
            F.log1p(n),
            F.log1p(different) / F.log1p(F.greatest(n, F.lit(1.0))),
            F.log1p(F.char_length(F.array_join(words, "")).cast("double") / F.greatest(n, F.lit(1.0))),
            share(n_repeat_words(words).cast("double"), n),
            share(n_symbols(whole).cast("double"), n),
            share(n_dup_lines(whole).cast("double"), lines),
            F.log1p(lines / F.greatest(n, F.lit(1.0))),
            share(count(r"\P{Lu}+"), letters),
            share(count(r"\P{Nd}+"), letters),
            share(count("[^!?]+"), n),
            share(count("[^.,;:]+"), n),
        )

    return let(word_array(whole), of_words)


SIZE = 11


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log constants of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = (x - mean) @ factor.T
            logs.append(constant - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(labelled: DataFrame, label: str, stats: str, pooled: float = 0.15, ridge: float = 0.02) -> Model | None:
    """The model of rows with a 0/1 ``label``. ``pooled`` and ``ridge`` are the shares of the pooled
    covariance and of the scaled identity in a class's covariance."""
    x = [F.get(stats, F.lit(i)) for i in range(SIZE)]
    products = [F.sum(x[i] * x[j]) for i in range(SIZE) for j in range(i + 1)]
    sums = labelled.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)), *[F.sum(v) for v in x], *products)
    found = {int(r[0]): np.array([float(v) for v in r[1:]]) for r in sums.collect()}
    if set(found) != {0, 1}:
        return None
    means, scatters, counts = [], [], []
    for c in (0, 1):
        n, total, flat = found[c][0], found[c][1 : SIZE + 1], found[c][SIZE + 1 :]
        second = np.zeros((SIZE, SIZE))
        second[np.tril_indices(SIZE)] = flat
        second += np.tril(second, -1).T
        mean = total / n
        means.append(mean)
        counts.append(n)
        scatters.append(second - n * np.outer(mean, mean))
    together = sum(scatters) / sum(counts)
    factors, constants = [], []
    for scatter, n in zip(scatters, counts):
        own = (1 - pooled) * scatter / n + pooled * together
        own = (1 - ridge) * own + ridge * max(np.trace(together) / SIZE, 1e-9) * np.eye(SIZE)
        lower = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(lower))
        constants.append(np.log(n / sum(counts)) - np.log(np.diag(lower)).sum())
    return Model(np.array(means), np.array(factors), np.array(constants))


def score(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", **options
) -> DataFrame:
    """Per row: ``key``, ``held_out``, ``score`` and ``predicted``."""
    rows = durable(docs.select(F.col(key).alias("_key"), statistics(F.col(text)).alias("_stats")))
    known = labels.select(F.col(key).alias("_id"), F.col(label).alias("_label")).filter(~held_out(F.col("_id")))
    model = fit(rows.join(known, F.col("_key") == F.col("_id")), "_label", "_stats", **options)

    @F.pandas_udf("double")
    def scored(stats: pd.Series) -> pd.Series:
        if model is None or not len(stats):
            return pd.Series(np.full(len(stats), 0.5))
        return pd.Series(model.scores(np.stack(stats.to_numpy()).astype(float)))

    out = rows.select("_key", scored("_stats").alias("score"))
    return out.select(
        F.col("_key").alias(key), held_out(F.col("_key")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
