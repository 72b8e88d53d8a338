"""Documents to packed sequences: rules, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before
the next. All but the last return the columns of ``documents``.

All stages take any table with the columns of ``documents``, whatever others it has. An empty table gives an empty result. Null and
empty texts have no words, so the rules reject them. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from odolog.llm import minhash, mixing, packing, quality_rules, surrogates
from odolog.llm.common import SECRET, stored, table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Repeated rows are judged alike, and so are equal texts."""
    return quality_rules.keep_clean(docs).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), the one with the smallest id.

    Of rows that repeat id and text one stays. Rows without an id link with nothing but rows of the same text. Texts without words
    link with nothing."""
    kept = minhash.keep_one(docs, percent=80, bands=37).select(*COLUMNS)  # 37 bands miss a pair at 0.8 with 4e-7
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("_text", F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_text"]).drop("_text")


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; ``n_chars`` follows the new text. Equal entities get equal surrogates over all rows.

    The key is the session's ``spark.odolog.surrogates.secret``; without one, that of the query suite."""
    return surrogates.replace(docs, spark.conf.get("spark.odolog.surrogates.secret", SECRET)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in the order of its block permutations. A null source is one of its own."""
    mixed_ = mixing.mix(docs)
    order = F.col("_mix.mix_key")
    return mixed_.repartitionByRange(order, "doc_id").sortWithinPartitions(order, "doc_id").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Repeated rows are packed as often as they are there."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", clean),
    ("minhash", distinct),
    ("surrogates", anonymous),
    ("mixing", mixed),
    ("packing", packed),
]
ORACLE_SQL = None  # SQL has no tokenizer; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
