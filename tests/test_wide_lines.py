"""Lines joined with what is known of their files: which side is broadcast, which cells are parsed."""

from pyspark.sql import functions as F

from odolog.plans import ingest
from odolog.sources import files as sources
from odolog.sources.logs import parse_lines
from tests.test_many_files import write_logs


def test_lines_are_not_broadcast(spark, tmp_path):
    write_logs(tmp_path / "logs")
    files = sources.list_files(spark, str(tmp_path / "logs"), "*.csv", 0, inclusive=True)
    lines = sources.lines_of(files)
    layout = files.select("path", F.array(F.lit("gpstime")).alias("names"))
    for joined in (parse_lines(lines, layout, "path", ["seq"]), ingest._of_files(lines, files.select("path"), ingest.BATCH_FILES + 1)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert joined.count() == 18


def test_columns_of_no_file_are_not_parsed(spark):
    lines = spark.createDataFrame([("f", 0, "1, 2,3"), ("g", 0, "4,-,5")], "path string, seq int, line string")
    layout = spark.createDataFrame([("f", ["gpstime", "gx", "odd"]), ("g", ["gpstime", "gx", "gx"])], "path string, names array<string>")
    raw = parse_lines(lines, layout, "path", ["seq"], broadcast=True)
    got = {r["path"]: r.asDict() for r in raw.collect()}
    assert (got["f"]["gpstime"], got["f"]["gx"], got["f"]["gy"]) == ("1", "2", None)
    assert (got["g"]["gpstime"], got["g"]["gx"], got["g"]["gy"]) == ("4", "5", None)
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get(_cells") < 20
