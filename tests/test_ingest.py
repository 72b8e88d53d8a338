"""The load job on log files, from discovery to registry and places."""

from datetime import timedelta
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from odolog.plans import ingest, statistics
from odolog.plans.ingest import LoadOptions, load_logs, repair_logs, transfer_legacy
from odolog.plans.store import TripStore
from odolog.sources import files as sources
from odolog.sources.files import discover, list_files, read_headers, read_lines
from tests.logfiles import HEADER, T0, row, trip, write


@pytest.fixture(autouse=True)
def small_data(spark):
    """Compiling code for dozens of tiny jobs takes longer than running them."""
    settings = {
        "spark.sql.codegen.wholeStage": "false",
        "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        "spark.sql.shuffle.partitions": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def store(spark, tmp_path):
    return TripStore(spark, str(tmp_path / "store"))


@pytest.fixture
def logs(tmp_path):
    return tmp_path / "logs"


def report(df):
    return {unquote(r["path"].split("/")[-1]): r.asDict() for r in df.collect()}


def test_load_and_reload(spark, store, logs):
    write(logs, "a/trackLog-1.csv", trip())
    write(logs, "b c/trackLog-2 [x] å.csv", trip(T0 + timedelta(days=1), lon=10.00001))
    write(logs, "b/other.csv", trip(T0 + timedelta(days=2)))
    out = report(load_logs(store, str(logs)))
    assert {k: v["sent_rows"] for k, v in out.items()} == {"trackLog-1.csv": 60, "trackLog-2 [x] å.csv": 60}
    assert all(v["reason"] is None and v["dropped_rows"] == 0 and v["header_rows"] == 0 for v in out.values())
    files = {r["csvfile"]: r for r in store.read("files").collect()}
    first, second = files["trackLog-1.csv"], files["trackLog-2 [x] å.csv"]
    assert (first["fileid"], second["fileid"]) == (1, 2)
    assert first["trip_duration"] == 59.0 and first["sent_rows"] == 60
    assert (first["startlat"], first["startlon"]) == (50.0, 10.0)
    assert (first["endlat"], first["endlon"]) == (50.059, 10.059)
    # the second trip starts and ends within the box of the first one's places
    assert first["startid"] == second["startid"] == 1 and first["endid"] == second["endid"] == 1
    assert [r["count"] for r in store.read("startpos").collect()] == [2]
    assert load_logs(store, str(logs)).count() == 0
    assert store.read("logs").count() == 120

    # later loads continue ids and places
    write(logs, "c/trackLog-3.csv", trip(T0 + timedelta(days=3), lat=51.0))
    assert report(load_logs(store, str(logs)))["trackLog-3.csv"]["sent_rows"] == 60
    third = store.read("files").filter("fileid = 3").first()
    assert third["csvfile"] == "trackLog-3.csv" and third["startid"] == 2
    assert store.read("logs").count() == 180 and store.read("files").count() == 3


def test_gates(spark, store, logs):
    day = lambda i: T0 + timedelta(days=i)
    half = lambda t, gap: [*trip(t, 30), HEADER, *trip(t + timedelta(seconds=29 + gap), 30)]
    write(logs, "trackLog-ok60.csv", half(day(0), 60))
    write(logs, "trackLog-bad61.csv", half(day(1), 61))
    write(logs, "trackLog-day.csv", [*trip(day(2), 40), row(day(3))])
    write(logs, "trackLog-long.csv", [*trip(day(4), 40), row(day(5) + timedelta(seconds=1))])
    write(logs, "trackLog-notime.csv", ["-" + r[28:] for r in trip(day(6))])
    twin = trip(day(7))
    write(logs, "trackLog-twin1.csv", twin)
    write(logs, "trackLog-twin2.csv", twin)
    write(logs, "trackLog-same.csv", [*twin, row(day(7) + timedelta(seconds=70))])
    some = trip(day(8))
    some[3] = "-" + some[3][28:]
    some[5] = "yesterday" + some[5][28:]
    write(logs, "trackLog-some.csv", [*some, HEADER])
    out = report(load_logs(store, str(logs)))
    reasons = {k[9:-4]: v["reason"] for k, v in out.items()}
    assert reasons == {
        "ok60": None, "bad61": "header gap", "day": None, "long": "too long", "notime": "no data",
        "same": None, "twin1": "known start", "some": None,
    }
    assert out["trackLog-ok60.csv"]["sent_rows"] == 60 and out["trackLog-ok60.csv"]["header_rows"] == 1
    assert out["trackLog-some.csv"]["dropped_rows"] == 2 and out["trackLog-some.csv"]["sent_rows"] == 58
    # rejected files are not registered and come up again; accepted and known ones do not come back as new rows
    again = report(load_logs(store, str(logs)))
    assert set(k[9:-4] for k in again) == {"bad61", "long", "notime", "twin1"}
    assert all(v["sent_rows"] == 0 for v in again.values())
    # conservation: every read row is stored, dropped or in a rejected file
    for r in out.values():
        if r["reason"] is None:
            assert r["rows"] == r["dropped_rows"] + r["sent_rows"]


def test_cells_layout_and_missing(spark, store, logs):
    header = "Speed (OBD)(km/h),Latitude,Strange Gauge(x),GPS Time,Longitude,Latitude"
    t = [T0 + timedelta(seconds=i) for i in range(80)]
    lines = [f"∞,50.5,7,{x.strftime('%a %b %d %H:%M:%S GMT+02:00 %Y')},-,1" for x in t]
    lines[1] = lines[1].rsplit(",", 2)[0]
    lines[2] = "12.5,-,7," + lines[2].split(",")[3] + ",11.5,2.5,extra,fields"
    write(logs, "trackLog-x.csv", lines, header)
    load_logs(store, str(logs))
    rows = store.read("logs").orderBy("block_start", "seq").take(3)
    assert rows[0]["gpstime"].isoformat() == "2022-06-29T06:00:00"
    assert [r["speedobdkmh"] for r in rows] == [None, None, 12.5]
    assert [r["latitude"] for r in rows] == [50.5, 50.5, 2.5]
    assert [r["longitude"] for r in rows] == [None, None, 11.5]

    zero = TripStore(spark, store.root + "-zero")
    load_logs(zero, str(logs), LoadOptions(missing="zero"))
    assert zero.read("logs").filter("longitude = 0 and speedobdkmh = 0 and gx = 0").count() == 79


def test_size_bounds_and_hash(spark, logs):
    text = HEADER + "\n"
    for name, size in (("trackLog-3000.csv", 3000), ("trackLog-3001.csv", 3001), ("trackLog-2999.csv", 2999)):
        path = write(logs, name, [])
        path.write_text(text + "x" * (size - len(text)))
    names = lambda df: sorted(r["csvfile"] for r in df.select("csvfile").collect())
    assert names(discover(spark, str(logs))) == ["trackLog-3001.csv"]
    assert names(discover(spark, str(logs), "*.csv", inclusive=True)) == ["trackLog-3000.csv", "trackLog-3001.csv"]
    plan = list_files(spark, str(logs), "trackLog*.csv")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,3000)" in plan


def test_lines_keep_order_over_splits(spark, logs):
    write(logs, "trackLog-s.csv", [f"{i},x" for i in range(5000)], "n,x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = read_lines(spark, str(logs))
        assert lines.select("block_start").distinct().count() > 3
        got = [r["line"] for r in lines.orderBy("block_start", "seq").collect()]
        assert got == ["n,x", *[f"{i},x" for i in range(5000)]]
        assert read_headers(spark, str(logs)).first()["header"] == "n,x"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_many_blocks_per_file(spark, store, logs):
    """Gates and summaries do not depend on how a file is cut into splits."""
    t1 = T0 + timedelta(seconds=200 + 61)
    write(logs, "trackLog-gap.csv", [*trip(T0, 201), HEADER, *trip(t1, 200)])
    write(logs, "trackLog-fine.csv", [*trip(T0 + timedelta(days=1), 201), HEADER, *trip(T0 + timedelta(days=1, seconds=260), 200)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        out = report(load_logs(store, str(logs)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out["trackLog-gap.csv"]["reason"] == "header gap"
    assert out["trackLog-fine.csv"]["reason"] is None and out["trackLog-fine.csv"]["sent_rows"] == 401
    entry = store.read("files").first()
    assert entry["trip_duration"] == 260 + 199.0 and entry["startlat"] == 50.0 and entry["endlat"] == 50.0 + 199 * 0.001


def test_limit_and_aliases(spark, store, logs):
    for i in range(3):
        write(logs, f"trackLog-{i}.csv", trip(T0 + timedelta(days=i)))
    assert load_logs(store, str(logs), LoadOptions(limit=2)).count() == 2
    assert sorted(r["csvfile"] for r in store.read("files").collect()) == ["trackLog-0.csv", "trackLog-1.csv"]
    header = HEADER.replace("GPS Speed(km/h)", "Altitude")
    write(logs, "alias/trackLog-9.csv", trip(T0 + timedelta(days=9)), header)
    load_logs(store, str(logs / "alias"), LoadOptions(use_aliases=True))
    assert store.read("logs").filter("altitudem = 30.5 and altitude is null").count() == 60


def test_failed_run_leaves_nothing(spark, store, logs):
    write(logs, "trackLog-1.csv", trip())
    store.stage("logs", store.read("logs"), 1)  # what a run that died before its commit leaves
    assert store.version() == 0
    load_logs(store, str(logs))
    assert store.version() == 1 and store.read("logs").count() == 60


def test_statistics_jobs(spark, store, logs):
    write(logs, "trackLog-1.csv", trip())
    write(logs, "trackLog-2.csv", trip(T0 + timedelta(days=1), lat=50.01))
    write(logs, "trackLog-3.csv", trip(T0 + timedelta(days=2), lat=70.0))
    load_logs(store, str(logs))
    statistics.refresh_all(store)
    speeds = {r["fileid"]: r for r in store.read("speeds").collect()}
    assert speeds[1]["gpsspeedkmh"] == 30.5 and speeds[1]["speedgpskmh"] == 0.0
    nulls = {r["column_name"]: r["null_ratio"] for r in store.read("columnstats").collect()}
    assert len(nulls) == 77 and nulls["gx"] == 1.0 and nulls["latitude"] == 0.0
    assert store.read("filestats").count() == 3 * 77
    # two starts lie within 0.05 degrees of both places, the third only of its own
    assert sorted(r["count"] for r in store.read("startpos").collect()) == [2, 3, 3]
    counts = statistics.store_counts(store).first().asDict()
    assert counts == {"trips": 0, "files": 3, "logs": 180}
    long = statistics.all_trip_statistics(store).filter("fileid = 1 and stat_group = 'timestats' and column = 'gpstime'")
    assert long.first()["tdelta_s"] == 59.0
    assert statistics.trip_report(store).filter("fileid = 2 and column = 'latitude'").first()["min"] == 50.01
    with pytest.raises(ValueError):
        store.reset()
    store.reset(confirm=True)
    assert store.read("logs").count() == 0 and store.read("files").count() == 0


def test_repair(spark, logs, tmp_path):
    write(logs, "trackLog-1.csv", ["a,-,-,b", "-,∞,c"], "GPS Time,Speed (OBD)(km/h),x,CO₂")
    write(logs, "trackLog-2.csv", ["1", "gps,2"], "gps")
    out = str(tmp_path / "repaired")
    status = {r["path"][-5]: (r["status"], r["changed_lines"]) for r in repair_logs(spark, str(logs), out).collect()}
    assert status == {"1": ("ok", 2), "2": ("error", 0)}
    got = [r["line"] for r in spark.read.parquet(out).orderBy("path", "seq").collect()]
    assert got == ["gpstime,speedobdkmh,x,co", "a,0,0,b", "0,0,c"]
    again = repair_logs(spark, str(logs), out)
    assert [r["path"][-5] for r in again.collect()] == ["2"]
    assert spark.read.parquet(out).count() == 3


def test_legacy_layout(spark, tmp_path):
    root = tmp_path / "old"

    def folder(name, date, n=6, log=True):
        (root / name).mkdir(parents=True)
        lines = ["#head", f"#{date}", *["k=v"] * (n - 2)]
        (root / name / "profile.properties").write_text("\n".join(lines) + "\n")
        if log:
            write(root / name, "trackLog.csv", trip())

    folder("1656526335000", "Wed Jun 29 18:12:15 GMT 2022")
    folder("1656526335001", "Wed Jun 29 20:12:15 GMT+02:00 2022", 8)
    folder("1656526335002", "Wed Jun 29 18:12:16 GMT 2022", 7)
    folder("1656526335003", "yesterday")
    folder("1656526335004", "Thu Jun 30 18:12:15 GMT 2022", log=False)
    folder("short", "Thu Jun 30 18:12:15 GMT 2022")
    out = str(tmp_path / "moved")
    got = {r["folder"][-1]: r for r in transfer_legacy(spark, str(root), out).collect()}
    assert set(got) == {"0", "1", "2", "3", "4"}
    assert got["0"]["csvfile"] == got["1"]["csvfile"] == "trackLog-2022-Jun-29_18-12-15.csv"
    status = {k: v["status"] for k, v in got.items()}
    assert status == {"0": "transferred", "1": "exists", "2": "no date", "3": "no date", "4": "no log"}
    assert spark.read.parquet(out).count() == 61
    assert transfer_legacy(spark, str(root), out).filter("status = 'transferred'").count() == 0
    assert spark.read.parquet(out).count() == 61
    assert got["2"]["tripdate"] is None and got["3"]["tripdate"] is None


def test_headers_are_read_by_range(spark, tmp_path, monkeypatch):
    """The first lines are those of Spark's line reader; of a long file only its head is read."""
    import gzip
    import io

    import pandas as pd

    contents = {
        "plain.csv": b"a,b\n1,2\n", "bom.csv": b"\xef\xbb\xbfa,b\n1\n", "crlf.csv": b"a,b\r\n1\r\n", "cr.csv": b"a,b\r1\r", "one.csv": b"a,b",
        "blank.csv": b"\n1,2\n", "empty.csv": b"", "latin \u00e5%20[1].csv": b"l\xe4nge,b\n1\n", "wide.csv": b"x," * 100_000 + b"\n1\n",
        "packed.csv.gz": gzip.compress(b"p,q\n1\n"),
    }
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"]: r["header"] for r in read_headers(spark, str(tmp_path), "*.csv*").select("path", F.col("header").cast("binary").alias("header")).collect()}
    lines = read_lines(spark, str(tmp_path)).filter("block_start = 0").groupBy("path").agg(F.min_by("line", "seq").cast("binary").alias("header"))
    assert got == {r["path"]: r["header"] for r in lines.collect()} and len(got) == len(contents) - 1

    read = []

    class Counted(io.BytesIO):
        def read(self, n=-1):
            block = super().read(n)
            read.append(len(block))
            return block

    monkeypatch.setattr(sources, "_open", lambda path: Counted(b"a,b\n" + b"1,2\n" * 2_000_000))
    (heads,) = sources._heads(iter([pd.DataFrame({"path": ["x", "y"]})]))
    assert list(heads["header"]) == [b"a,b"] * 2 and sum(read) == 2 * sources.HEAD_BYTES


def test_repaired_lines_are_not_shuffled(spark, logs):
    write(logs, "trackLog-1.csv", ["a,-"], "GPS Time,x")
    lines = read_lines(spark, str(logs))
    fixed = ingest.repaired_lines(lines, read_headers(spark, str(logs)), ingest.repair_report(lines), 1)
    plan = fixed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert [r["line"] for r in fixed.orderBy("seq").collect()] == ["gpstime,x", "a,0"]


def test_parse_failures_do_not_raise(spark):
    from odolog.functions.times import parse_time

    texts = ["29-Jun-2022 18:12:1x", "Wed Xxx 29 18:12:15 GMT 2022", "", None, "GPS Time", "2022-13-29 18:12:15.661000"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(parse_time(F.col("t")).alias("x")).filter("x is not null").count() == 0


def test_one_hash_at_every_size(spark, tmp_path, monkeypatch):
    """The hash is the md5 of the content, whether a file is read whole or piece by piece."""
    import hashlib

    content = ("GPS Time,Länge \n" + "x" * 5000).encode()
    for name in ("trackLog-a b[1]%.csv", "trackLog-copy.csv"):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "trackLog-other.csv").write_bytes(content[:-1] + b"y")
    (tmp_path / "trackLog-long.csv").write_bytes(content * 700)  # several megabytes
    for limit in (sources.WHOLE_BYTES, 4000, 6000):
        monkeypatch.setattr(sources, "WHOLE_BYTES", limit)
        found = {r["csvfile"]: r for r in discover(spark, str(tmp_path)).collect()}
        assert len(found) == 4 and found["trackLog-copy.csv"]["header"] == "GPS Time,Länge"
        for name, row in found.items():
            assert row["csvhash"] == hashlib.md5((tmp_path / name).read_bytes()).hexdigest()


def test_known_files_are_not_opened(spark, store, logs, monkeypatch):
    import os

    for i in range(4):
        write(logs, f"trackLog-{i}.csv", trip(T0 + timedelta(days=i)))
    assert load_logs(store, str(logs)).count() == 4 and store.read("manifest").count() == 4
    version = store.version()
    # same size and time, other bytes: nobody looks
    path = logs / "trackLog-2.csv"
    before, times = path.read_bytes(), path.stat()
    path.write_bytes(before.replace(b"30.5", b"99.9"))
    os.utime(path, ns=(times.st_atime_ns, times.st_mtime_ns))
    opened = []
    monkeypatch.setattr(sources, "_hashed", lambda files, inner=sources._hashed: opened.append(1) or inner(files))
    assert load_logs(store, str(logs)).count() == 0 and not opened and store.version() == version
    # a copy under a new name is hashed, found known, and remembered
    (logs / "trackLog-copy.csv").write_bytes((logs / "trackLog-1.csv").read_bytes())
    assert load_logs(store, str(logs)).count() == 0 and opened == [1] and store.read("manifest").count() == 5
    assert load_logs(store, str(logs)).count() == 0 and opened == [1]
    # a changed file is hashed again, and only it
    write(logs, "trackLog-3.csv", trip(T0 + timedelta(days=30), n=70))
    out = report(load_logs(store, str(logs)))
    assert set(out) == {"trackLog-3.csv"} and out["trackLog-3.csv"]["sent_rows"] == 70
    found = discover(spark, str(logs), manifest=store.read("manifest"))
    assert found.filter("fresh").count() == 0 and found.count() == 5


def test_new_files_are_read_by_name_in_batches(spark, logs, monkeypatch):
    monkeypatch.setattr(sources, "READ_PATHS", 2)
    for i in range(14):
        write(logs, f"x[{i}] y/trackLog-{i}.csv", trip(T0 + timedelta(days=i)))
    whole = discover(spark, str(logs))
    seen = list_files(spark, str(logs), "trackLog*.csv").join(whole.select("path", "csvhash", "header"), "path")
    manifest = seen.select("path", "size", "modified", "csvhash", "header")
    some = discover(spark, str(logs), manifest=manifest.filter("path not like '%trackLog-1%'"))
    assert some.filter("fresh").count() == 5
    key = lambda df: sorted(map(tuple, df.select("csvfile", "size", "csvhash", "header").collect()))
    assert key(some) == key(whole)


def test_bad_rows_are_set_aside(spark, store, logs):
    lines = trip(n=80)
    lines[3] = row(T0 + timedelta(seconds=3), lat="fifty")
    lines[7] = row(T0 + timedelta(seconds=7), obd="x", cost="1,5")
    write(logs, "trackLog-1.csv", lines)
    write(logs, "trackLog-2.csv", trip(T0 + timedelta(days=1)), HEADER.replace("GPS Speed(km/h)", "My Gauge (x)"))
    write(logs, "trackLog-3.csv", [row(T0 + timedelta(days=2, seconds=i), lon="?") for i in range(70)])
    first = load_logs(store, str(logs))
    out = report(first)
    keys = ("rows", "sent_rows", "bad_rows", "bad_cells", "status", "unknown_columns")
    assert tuple(out["trackLog-1.csv"][k] for k in keys) == (80, 78, 2, 2, "warning", [])
    assert tuple(out["trackLog-2.csv"][k] for k in keys) == (60, 60, 0, 0, "success", ["mygaugex"])
    assert tuple(out["trackLog-3.csv"][k] for k in keys) == (70, 0, 70, 70, "error", [])
    aside = store.read("quarantine").filter("fileid = 1").orderBy("seq").collect()
    assert [r["line"] for r in aside] == [lines[3], lines[7]] and store.read("quarantine").count() == 72
    assert store.read("logs").count() == 138 and store.read("files").count() == 3
    assert store.state()["metrics"] == {"rows": 210, "set_aside": 72, "bad_cells": 72}
    # the report is stored: showing it reads no log
    for path in logs.iterdir():
        path.unlink()
    assert report(first) == out and store.read("loadreport").count() == 3

    for name in ("trackLog-1.csv",):
        write(logs, name, lines)
    keep = TripStore(spark, store.root + "-keep")
    kept = report(load_logs(keep, str(logs), LoadOptions(bad_rows="keep")))["trackLog-1.csv"]
    assert (kept["sent_rows"], kept["bad_rows"], kept["bad_cells"], kept["status"]) == (80, 2, 2, "warning")
    assert keep.read("logs").filter("latitude is null").count() == 1 and keep.read("quarantine").count() == 0
    with pytest.raises(ValueError):
        load_logs(keep, str(logs), LoadOptions(bad_rows="x"))


def test_equal_folder_names_in_two_roots(spark, tmp_path):
    root = tmp_path / "old"
    for top, day in (("a", 29), ("b", 28)):
        folder = root / top / "1656526335000"
        folder.mkdir(parents=True)
        (folder / "profile.properties").write_text("\n".join(["#x", f"#Wed Jun {day} 18:12:15 GMT 2022" if day == 29 else "#Tue Jun 28 18:12:15 GMT 2022", *["k=v"] * 4]) + "\n")
        write(folder, "trackLog.csv", [f"{top}1"], "head")
    twin = root / "c" / "1656526335000"
    twin.mkdir(parents=True)
    (twin / "profile.properties").write_text((root / "a" / "1656526335000" / "profile.properties").read_text())
    write(twin, "trackLog.csv", ["c1"], "head")
    out = str(tmp_path / "moved")
    got = {r["directory"].split("/")[-2]: r["status"] for r in transfer_legacy(spark, str(root), out).collect()}
    assert got == {"a": "transferred", "b": "transferred", "c": "exists"}
    moved = sorted((r["csvfile"], r["line"]) for r in spark.read.parquet(out).collect())
    a, b = "trackLog-2022-Jun-29_18-12-15.csv", "trackLog-2022-Jun-28_18-12-15.csv"
    assert moved == sorted([(a, "head"), (a, "a1"), (b, "head"), (b, "b1")])
