"""Joins that keep null keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which a null key equals a null key. Other column names must differ."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, same), how).drop(*[f"_right_{k}" for k in keys])
