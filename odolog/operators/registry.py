"""The file registry: which logs are known, and what is stored of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from odolog.operators.ordered import dense_ids


def new_files(found: DataFrame, registry: DataFrame, content_hash: str = "csvhash", name: str = "csvfile") -> DataFrame:
    """Found files whose content is not registered; of equal contents the first by name.

    Copies are reduced to one before the hash is shuffled, however many there are.
    """
    first = found.groupBy(content_hash).agg(F.min(name).alias(name))
    fresh = first.join(registry.select(content_hash), content_hash, "left_anti")
    return found.join(fresh, [content_hash, name], "left_semi")


def known_files(found: DataFrame, registry: DataFrame, row_counts: DataFrame, key: str = "fileid", content_hash: str = "csvhash") -> DataFrame:
    """Found files that are registered, with their id and stored rows. A content is registered once."""
    return (
        found.join(registry.select(key, content_hash), content_hash)
        .join(row_counts, key, "left")
        .withColumn("sent_rows", F.coalesce("sent_rows", F.lit(0)))
    )


def with_new_ids(files: DataFrame, registry: DataFrame, order: list[str], key: str = "fileid") -> DataFrame:
    """Files with ids that continue those of the registry."""
    top = registry.agg(F.max(key)).first()[0] or 0
    return dense_ids(files, order, key, start=int(top) + 1)


def repeated_starts(found: DataFrame, registry: DataFrame, start: str = "trip_start") -> DataFrame:
    """Trips whose start time is already registered."""
    return found.join(registry.select(start).distinct(), start, "left_semi")


def fresh_starts(found: DataFrame, registry: DataFrame, name: str, start: str = "trip_start") -> DataFrame:
    """Trips whose start time is not registered; of equal starts the first by name."""
    first = found.groupBy(start).agg(F.min(name).alias(name))
    fresh = first.join(registry.select(start), start, "left_anti")
    return found.join(fresh, [start, name], "left_semi")


def file_rows(files: DataFrame, logs: DataFrame, key: str = "fileid", how: str = "inner") -> DataFrame:
    """Log rows with the columns of their file."""
    return logs.join(files, key, how)


def updated_registry(registry: DataFrame, updates: DataFrame, key: str = "fileid") -> DataFrame:
    """Registry with the non-null fields of ``updates`` put in, files without an update unchanged."""
    fields = [c for c in updates.columns if c != key and c in registry.columns]
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = registry.join(fresh, key, "left")
    return joined.select(
        [F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in registry.columns]
    )
