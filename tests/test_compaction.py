"""What a compaction into many small files may cost."""

from pyspark.sql import functions as F

from odolog.plans.store import TripStore


def test_compaction_samples_few_ranges(spark, tmp_path, monkeypatch):
    asked = []
    kind = type(spark.range(1))
    inner = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, n, *c: asked.append(n) or inner(self, n, *c))
    store = TripStore(spark, str(tmp_path / "store"))
    rows = spark.range(20_000).select(
        (F.col("id") % 7).alias("fileid"), F.lit(0).cast("long").alias("block_start"), F.col("id").alias("seq"), F.lit(1.0).alias("latitude")
    )
    store.append("logs", rows)
    store.compact_logs(rows_per_file=100)
    assert asked == [1] and store.read("logs").count() == 20_000
    assert store.read("logindex").groupBy("path").agg(F.sum("rows").alias("n")).filter("n > 100").count() == 0
