"""The logs that the queries of the file sources read."""

from odolog.plans import file_suite
from odolog.sources import files as sources


def test_logs_are_rendered_one_file_a_user(spark):
    root = file_suite.render_logs(spark, "/root/testdata/sf0.001")
    files = sources.list_files(spark, root, "part-*", 1, inclusive=True)
    users = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct()
    assert [r[0] for r in files.select("csvfile").distinct().collect()] == ["part-00000.txt"]  # one writer, no job of many renames
    assert files.count() == users.count() == files.select(file_suite.user_of("path")).join(users, "user_id").count()
    assert all(r[0].startswith(file_suite.HEADER) for r in sources.read_headers(spark, root, "part-*").select("header").collect())
