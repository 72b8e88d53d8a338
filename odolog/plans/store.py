"""Versioned tables in a folder: Parquet datasets, and a file per committed version.

A job writes everything of one run under the next version, in folders of its own, and then puts the commit file of
that version, which names the folders every table consists of from then on. The file is created only if it does not exist, so of two
jobs that work at the same version exactly one commits. Readers follow the last commit file, so a job that dies half-way
leaves nothing behind that counts, and no path is read and overwritten at once.

Log rows come with an index: the data files and rows of each trip. A trip is read from its own files.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from odolog.catalog import TABLES

BUCKET = 100  # commit files of one folder, so that a reader lists few however many there are
TRIP_FILES = 10_000  # a trip in more data files is read by a filtered scan of them all
ROWS_PER_FILE = 1_000_000  # of compacted logs
ROWS_PER_TASK = 250_000  # least that a task of the compaction sorts


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet folder, or no rows where it does not exist. Any other failure is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class TripStore:
    """Tables ``logs``, ``manifest``, ``quarantine``, ``loadreport`` (append) and the dimension / statistics tables (a full
    snapshot per version)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.job = uuid.uuid4().hex[:12]  # names the folders this object writes

    # -- commit files ---------------------------------------------------------------------------

    def _java_path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._java_path("commits").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._java_path(folder)
        files = self._files()
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _read_commit(self, name: str) -> dict | None:
        """A commit file, or None where it is not (yet) complete."""
        stream = self._files().open(self._java_path(name))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def _put_if_absent(self, name: str, text: str) -> bool:
        """Create a file with its content; False if it exists."""
        path, files = self._java_path(name), self._files()
        files.mkdirs(path.getParent())
        if files.getScheme() == "file":  # a link to a complete file appears at once, or not at all
            target = path.toUri().getPath()
            own = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(own, "x", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(own, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        try:
            stream = files.create(path, False)
        except Py4JJavaError as error:
            if files.exists(path):
                return False
            raise error
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def state(self) -> dict:
        """The last commit: ``version``, ``tables`` (folders of each table, in order) and ``metrics``. Lists the folders of commit files
        and the last of them."""
        for bucket in sorted((n for n in self._names("commits") if n.isdigit()), reverse=True):
            names = [n for n in self._names(f"commits/{bucket}") if n.endswith(".json") and n[0] != "."]
            for name in sorted(names, reverse=True):
                commit = self._read_commit(f"commits/{bucket}/{name}")
                if commit is not None:
                    return commit
        return {"version": 0, "tables": {}, "metrics": {}}

    def version(self) -> int:
        """Last committed version, 0 when there is none."""
        return self.state()["version"]

    def commit(self, version: int, tables: dict[str, bool], folders: dict[str, str] | None = None, metrics: dict | None = None) -> None:
        """Make a version count. ``tables``: name -> True for a full write, False for an append. ``folders`` names those that
        ``stage`` has not written (none: nothing was written).

        A version another job has committed meanwhile is refused; the job has to run again."""
        last = self.state()
        taken = RuntimeError(f"version {version} was committed by another job")
        if last["version"] != version - 1:
            raise taken
        live = dict(last["tables"])
        tables = dict(tables)
        if "logs" in tables:
            tables["logindex"] = tables["logs"]
        for table, full in tables.items():
            folder = (folders or {}).get(table, self._folder(table, version))
            live[table] = ([] if full else live.get(table, [])) + ([folder] if folder else [])
        now = datetime.now(timezone.utc).isoformat()
        text = json.dumps({"version": version, "job": self.job, "committed_at": now, "tables": live, "metrics": metrics or {}})
        if not self._put_if_absent(f"commits/{version // BUCKET:012d}/{version:012d}.json", text):
            raise taken

    # -- tables ---------------------------------------------------------------------------------

    def _folder(self, table: str, version: int) -> str:
        return f"{table}/version={version}-{self.job}"

    def read(self, table: str) -> DataFrame:
        """The table as of the last commit: its last full write and the appends after it."""
        folders = self.state()["tables"].get(table, [])
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{f}" for f in folders])

    def read_trip(self, trip: int) -> DataFrame:
        """The log rows of one trip, out of the data files that hold some."""
        own = self.read("logindex").filter(F.col("fileid") == trip).select("path").distinct()
        paths = [r[0] for r in own.limit(TRIP_FILES + 1).collect()]
        if not paths:
            return self.spark.createDataFrame([], TABLES["logs"])
        if len(paths) > TRIP_FILES:
            return self.read("logs").filter(F.col("fileid") == trip)
        rows = self.spark.read.schema(TABLES["logs"]).parquet(*[f"{self.root}/{p}" for p in paths])
        return rows.filter(F.col("fileid") == trip)

    def staged(self, table: str, version: int) -> DataFrame:
        """Rows written under a version that is not committed yet."""
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{self._folder(table, version)}")

    def stage(self, table: str, df: DataFrame, version: int, rows_per_file: int = 0) -> None:
        """Write rows under a version, if given at most so many to a file; they count once it is committed."""
        schema = TABLES[table]
        missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
        typed = df.withColumns(missing) if missing else df
        typed = typed.select([F.col(f.name).cast(f.dataType) for f in schema])
        typed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.root}/{self._folder(table, version)}")
        if table == "logs":
            self.stage_index(self._folder(table, version), version)

    def stage_index(self, folder: str, version: int) -> None:
        """Write which data file of a folder of log rows holds how many rows of which trip. Reads one column."""
        rows = self.spark.read.schema("fileid long").parquet(f"{self.root}/{folder}")
        path = F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name"))
        index = rows.groupBy("fileid", path.alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        self.stage("logindex", index.sortWithinPartitions("fileid"), version)

    def has_data(self, folder: str) -> bool:
        """Whether a folder below the store was written."""
        return self._files().exists(self._java_path(folder))

    def replace(self, table: str, df: DataFrame) -> None:
        """Full refresh of one table."""
        version = self.version() + 1
        self.stage(table, df, version)
        self.commit(version, {table: True})

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to one table."""
        version = self.version() + 1
        self.stage(table, df, version)
        self.commit(version, {table: False})

    def compact_logs(self, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write all log rows anew, by trip and in row order, into files of about ``rows_per_file``, so that a trip lies in few.

        Loads write rows as they read them, without a shuffle; this is the one that puts them in order. Files are cut by rows,
        not by trips, so a trip with a third of all rows is written by many tasks."""
        order = ["fileid", "block_start", "seq"]
        version = self.version() + 1
        rows = self.read("logindex").agg(F.sum("rows")).first()[0] or 0
        # a task writes many small files in turn: the driver gets a sample of rows for each range
        parts = max(1, math.ceil(rows / max(rows_per_file, ROWS_PER_TASK)))
        self.stage("logs", self.read("logs").repartitionByRange(parts, *order).sortWithinPartitions(*order), version, rows_per_file)
        self.commit(version, {"logs": True})

    def reset(self, confirm: bool = False) -> None:
        """Empty every table. Data of earlier versions stays on disk; it is no longer read."""
        if not confirm:
            raise ValueError("reset empties all tables; pass confirm=True")
        self.commit(self.version() + 1, {table: True for table in TABLES}, {table: "" for table in TABLES})
