"""Helpers the operators share: words, bindings inside expressions, stored tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from odolog.session import durable

SPACE = r"[\x20\x09-\x0D]"  # what separates words; everything else is part of one


SECRET = "surrogates of the query suite"  # a production job takes its own from its configuration


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """Words of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share (``spark.checkpoint.dir``)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        durable(spark.range(1))  # sets the folder of a local session, or raises
    return f"{context.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file as Spark names it."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition(":")
    known = {"s3a": "s3", "s3n": "s3"}
    try:
        return FileSystem.from_uri(f"{known.get(scheme, scheme)}:{rest}" if colon else uri)
    except pa.ArrowInvalid as error:
        raise ValueError(f"archives can be kept in file, hdfs, s3a and gs stores, not at {uri}") from error


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, compressed, and
    not lost with an executor. Used for wide rows; small ones are checkpointed (``durable``)."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected ``links`` (``a``, ``b``): rows (``node``, ``component``)
    with the smallest node reachable, for every node that has a link to another one.

    Alternates two steps until nothing changes: every node passes its larger neighbours to the
    smallest one it knows, then its smaller ones. Both keep what is connected connected, and end
    in stars around the smallest nodes after about as many rounds as the logarithm of the longest path.
    Minima are combined before the shuffle, so a node with very many links costs one row per task;
    nodes and links never meet on the driver.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = durable(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct()
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first())

    before = state(edges)
    while before[0]:
        ends = edges.select("a", F.col("a").alias("m")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("m")))
        least = durable(ends.groupBy("a").agg(F.min("m").alias("m")))
        edges = durable(edges.join(least, "a").select(F.col("m").alias("a"), "b").distinct())
        least = durable(edges.groupBy("b").agg(F.min("a").alias("m")))
        passed = edges.join(least, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        edges = durable(passed.unionByName(least.select(F.col("m").alias("a"), "b")).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
