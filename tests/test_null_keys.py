"""Null keys and null times are rows like any other."""

from pyspark.sql import functions as F

from odolog.catalog import LOG_COLUMNS
from odolog.functions.names import SPECIAL_LABELS, UNDERSCORE_LABELS, alias_name, canonical_name
from odolog.operators import ordered
from odolog.operators.stats import column_profile

ROWS = [(k, t, i, float(i)) for i, (k, t) in enumerate([(1, 5), (1, None), (None, 7), (None, None), (None, 90_000), (2, 1), (2, 2)])]


def table(spark):
    return spark.createDataFrame(ROWS, "k long, s long, i long, v double").withColumn("ts", F.timestamp_seconds("s"))


def test_neighbours_and_numbers_keep_null_keys(spark):
    df = table(spark)
    chunk = ordered.time_chunk(F.col("ts"), 60)
    got = {r["i"]: (r["prev_v"], r["next_v"]) for r in ordered.neighbours(df, ["k"], chunk, ["ts", "i"], ["v"]).collect()}
    assert got == {0: (1.0, None), 1: (None, 0.0), 3: (None, 2.0), 2: (3.0, 4.0), 4: (2.0, None), 5: (None, 6.0), 6: (5.0, None)}
    numbers = {r["i"]: r["row_no"] for r in ordered.row_numbers(df, ["k"], chunk, ["ts", "i"]).collect()}
    assert numbers == {0: 2, 1: 1, 3: 1, 2: 2, 4: 3, 5: 1, 6: 2}


def test_rows_without_time_do_not_shorten_the_slices(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.col("id") * 600)).alias("ts"))
    assert ordered.pick_chunk_seconds(df, ["k"], "ts", max_rows=200) == 86_400


def test_profile_of_a_null_key(spark):
    for max_group in (100, 1):
        got = {r["k"]: (r["min"], r["median"], r["max"]) for r in column_profile(table(spark), ["k"], ["v"], max_group=max_group).collect()}
        assert got == {1: (0.0, 0.5, 1.0), None: (2.0, 3.0, 4.0), 2: (5.0, 5.5, 6.0)}


def test_medians_do_not_overflow(spark):
    df = spark.createDataFrame([(1.5e308,), (1.6e308,)], "v double")
    assert [column_profile(df, columns=["v"], max_group=g).first()["median"] for g in (1, 100)] == [1.55e308, 1.55e308]


def test_aliases_never_leave_the_catalog(spark):
    labels = [*SPECIAL_LABELS, *UNDERSCORE_LABELS]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = df.select("label", canonical_name(F.col("label")).alias("plain"), alias_name(F.col("label"), known=LOG_COLUMNS).alias("name")).collect()
    lost = [r["label"] for r in got if r["plain"] in LOG_COLUMNS and r["name"] not in LOG_COLUMNS]
    assert not lost and len(got) == len(labels)
    kept = {r["label"]: r["name"] for r in got}
    assert kept["Fuel pressure(psi)"] == "fuelpressurepsi" and kept["DPF Pressure(bar)"] == "dpfpressurebar"
