"""Jobs on many files list them once and open them by name in tasks."""

import gzip

import pytest
from pyspark.sql import functions as F

from odolog.plans.ingest import LoadOptions, load_logs, repair_logs, transfer_legacy
from odolog.plans.store import TripStore
from odolog.sources import files as sources


@pytest.fixture
def listings(monkeypatch):
    """Paths of every listing of files from here on."""
    seen = []
    inner = sources._listed
    monkeypatch.setattr(sources, "_listed", lambda spark, paths, *a, **k: seen.append(paths) or inner(spark, paths, *a, **k))
    text = sources.read_lines
    monkeypatch.setattr(sources, "read_lines", lambda spark, paths, *a, **k: seen.append(paths) or text(spark, paths, *a, **k))
    return seen


def write_logs(folder, n=3):
    folder.mkdir()
    for i in range(n):
        rows = [f"2024-01-{i + 1:02d} 10:00:0{s}.000000,{i + 1}.5,{i + 2}.5" for s in range(5)]
        (folder / f"trackLog-{i}.csv").write_text("\n".join(["GPS Time, Longitude, Latitude", *rows, ""]))


def test_lines_read_by_name_are_those_of_spark(spark, tmp_path):
    texts = [b"a\nb\n", b"a\r\nb\rc\r\r\nd", b"\xef\xbb\xbfa\n\n\nb", b"", b"\n", b"\xff\xfe,1\n\xc2", "∞ é\n".encode(), b"no end"]
    for i, text in enumerate(texts):
        (tmp_path / f"x {i}%[1].csv").write_bytes(text)
    (tmp_path / "y.csv.gz").write_bytes(gzip.compress(b"p\nq\n"))
    (tmp_path / "large.csv").write_bytes(b"".join(b"%d\n" % i for i in range(20_000)))

    def rows(lines):
        order = [F.col("path"), F.col("block_start"), F.col("seq")]
        return [(r[0], bytes(r[1])) for r in lines.orderBy(*order).select("path", F.col("line").cast("binary")).collect()]

    files = sources.list_files(spark, str(tmp_path), "*", 0, inclusive=True)
    assert rows(sources.lines_of(files)) == rows(sources.read_lines(spark, str(tmp_path)))
    assert sources.lines_of(files).groupBy("path", "block_start", "seq").count().filter("count > 1").count() == 0


def test_files_are_listed_once(spark, tmp_path, listings):
    logs = tmp_path / "logs"
    write_logs(logs)
    assert sources.discover(spark, str(logs), min_size=1).count() == 3 and len(listings) == 1
    listings.clear()
    report = load_logs(TripStore(spark, str(tmp_path / "store")), str(logs), LoadOptions(min_size=1))
    assert sorted(r["sent_rows"] for r in report.collect()) == [5, 5, 5] and len(listings) == 1
    listings.clear()
    assert repair_logs(spark, str(logs), str(tmp_path / "repaired"), "*.csv").count() == 3 and len(listings) == 1


def test_folders_of_old_trips_are_listed_once(spark, tmp_path, listings):
    root = tmp_path / "old"
    for i in range(3):
        folder = root / "ab" [i % 2] / f"{i:013d}"
        folder.mkdir(parents=True)
        (folder / "trackLog.csv").write_text(f"1,{i}\n2,{i}\n")
        (folder / "profile.properties").write_text(f"#p\n#Mon Jan 0{i + 1} 10:00:00 GMT 2024\nname=x\nfuel=1\ncost=2\ntime=3\n")
    done = transfer_legacy(spark, str(root), str(tmp_path / "out"))
    assert {r["status"] for r in done.collect()} == {"transferred"} and len(listings) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_paths_are_fetched_in_few_jobs(spark):
    paths = spark.range(0, 3000, 1, 300).select(F.col("id").cast("string"))
    spark.sparkContext.setJobGroup("paths", "paths")
    batches = list(sources._in_batches(paths))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("paths")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(map(len, batches)) == 3000 and len(jobs) <= 5
