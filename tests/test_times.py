"""Times by text length."""

from pyspark.sql import functions as F

from odolog.functions.times import parse_time


def test_long_time_texts(spark):
    """30 characters hold a zone name of five letters; no text of 36 fits its format."""
    texts = {
        "Wed Jun 29 18:12:15 ACWST 2022": "2022-06-29 09:27:15", "Wed Jun 29 18:12:15 CHAST 2022": "2022-06-29 05:27:15",
        "Wed Jun 29 18:12:15 GMT+2 2022": None, "Wed Jun 29 18:12:15 GMT+02:00 2022": "2022-06-29 16:12:15",
        "Wed Jun 29 18:12:15 GMT+02:0000 2022": None, "Wed Jun 29 18:12:15 UTC+02:00:0 2022": None,
    }
    assert sorted(map(len, texts)) == [30, 30, 30, 34, 36, 36]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", F.date_format(parse_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("p")).collect()}
    assert got == texts
