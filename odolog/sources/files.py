"""Finding log files and reading their lines."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from odolog.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # what runs in tasks is sent with them

MIN_SIZE = 3000
WHOLE_BYTES = 128 << 20  # files up to this size are hashed from one row, larger ones piece by piece, to the same hash
READ_PATHS = 10_000  # new files read by name at a time
HEAD_BYTES = 1 << 16  # read at a time to find a first line
LINES_BYTES = 32 << 20  # files up to this size are cut into lines by one task that opens them by name
TASK_FILES, TASK_BYTES = 500, 64 << 20  # of small files that a task opens by name
BATCH_LINES = 10_000


def list_files(spark: SparkSession, root: str, pattern: str, min_size: int = MIN_SIZE, inclusive: bool = False) -> DataFrame:
    """Files below ``root``: (path, location, csvfile, size, modified). Reads no content; size bounds are pushed into the listing.

    ``path`` is the name ``read_lines`` gives the file's lines, ``location`` the path to read it by.
    """
    return _described(_listed(spark, root, pattern, min_size, inclusive))


def _described(listed: DataFrame) -> DataFrame:
    return listed.select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_replace("path", r"([\[\]{}*?])", r"\\$1").alias("location"),
        F.element_at(F.split("path", "/"), -1).alias("csvfile"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def _listed(spark: SparkSession, paths: str | list[str], pattern: str, min_size: int, inclusive: bool) -> DataFrame:
    size = F.col("length")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(paths)
        .filter(size >= min_size if inclusive else size > min_size)
    )


def _hashed(files: DataFrame) -> DataFrame:
    """Hash and first line of files up to ``WHOLE_BYTES``, read by Spark's own reader."""
    return files.filter(F.col("length") <= WHOLE_BYTES).select(
        F.col("_metadata.file_path").alias("path"),
        F.md5("content").alias("csvhash"),
        F.rtrim(F.make_valid_utf8(F.substring_index(F.col("content").cast("string"), "\n", 1))).alias("header"),
    )


# Schemes of paths, and the stores that read them in ranges.
STORES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs"}
PACKED = r"\.(gz|bz2|zst|deflate|lz4|snappy)$"  # names of files that Spark unpacks as it reads lines


def _open(path: str):
    """A stream on a file of a store that can be read in ranges."""
    from urllib.parse import quote

    from pyarrow.fs import FileSystem

    uri = quote(path, safe="%/:@!$&'()*+,;=~")  # Spark leaves letters beyond ASCII
    scheme, _, rest = uri.partition(":")
    if scheme not in STORES:
        raise ValueError(f"files above {WHOLE_BYTES} bytes can be read from file, hdfs, s3a and gs stores only: {path}")
    store, name = FileSystem.from_uri(f"{STORES[scheme]}:{rest}")
    return store.open_input_stream(name)


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for larger files, a megabyte at a time."""
    import hashlib

    for rows in batches:
        found, heads = [], []
        for path in rows["path"]:
            digest, head, whole = hashlib.md5(), b"", False
            with _open(path) as file:
                while block := file.read(1 << 20):
                    digest.update(block)
                    if not whole:
                        head += block
                        whole = b"\n" in block
            found.append(digest.hexdigest())
            heads.append(head.split(b"\n", 1)[0].decode("utf-8", "replace").rstrip(" "))
        yield pd.DataFrame({"path": rows["path"], "csvhash": found, "header": heads})


def _heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First lines, as bytes, ended and freed of a byte order mark as Spark's line reader does it."""
    for rows in batches:
        heads = []
        for path in rows["path"]:
            head, start = bytearray(), 0
            with _open(path) as file:
                while block := file.read(HEAD_BYTES):
                    head += block
                    if any(end in block for end in (b"\n", b"\r")):
                        break
            if head.startswith(b"\xef\xbb\xbf"):
                start = 3
            line = bytes(head[start:])
            heads.append(line[: min((i for i in (line.find(b"\n"), line.find(b"\r")) if i >= 0), default=len(line))])
        yield pd.DataFrame({"path": rows["path"], "header": heads})


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole files, as bytes, ended and freed of a byte order mark as Spark's line reader does it."""
    names = ["path", "block_start", "seq", "line"]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with _open(path) as file:
                text = file.read()
            text = text.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
            lines = text.split(b"\n")
            if not lines[-1]:
                lines.pop()
            for at in range(0, len(lines), BATCH_LINES):
                some = lines[at : at + BATCH_LINES]
                n = len(some)
                cells = [pa.repeat(path, n), pa.repeat(pa.scalar(0, pa.int64()), n), pa.array(range(at, at + n), pa.int64()), pa.array(some, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names=names)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of whole files."""
    for rows in batches:
        contents = []
        for path in rows["path"]:
            with _open(path) as file:
                contents.append(file.read())
        yield pd.DataFrame({"path": rows["path"], "content": contents})


def _ranged() -> Column:
    """Whether a file can be opened in a task by its ``path``, and read as it is."""
    return F.split("path", ":")[0].isin(*STORES) & ~F.col("path").rlike(PACKED)


def _dealt(files: DataFrame) -> DataFrame:
    """``files`` (with ``size``) dealt to tasks of about ``TASK_FILES`` files or ``TASK_BYTES``, at least one per core."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = max(n // TASK_FILES, size // TASK_BYTES, min(n, files.sparkSession.sparkContext.defaultParallelism), 1)
    return files.repartition(int(parts), "path")


def _in_batches(paths: DataFrame) -> Iterator[list[str]]:
    """Lists of ``READ_PATHS`` paths, of a job each, however many partitions the paths lie in."""
    n = paths.count()
    if n == 0:
        return
    batch: list[str] = []
    for (path,) in paths.repartition(-(-n // READ_PATHS)).toLocalIterator():
        batch.append(path)
        if len(batch) == READ_PATHS:
            yield batch
            batch = []
    if batch:
        yield batch


def discover(
    spark: SparkSession,
    root: str,
    pattern: str = "trackLog*.csv",
    min_size: int = MIN_SIZE,
    inclusive: bool = False,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Files below ``root``: (path, location, csvfile, size, csvhash, header), and with a ``manifest`` also (modified, fresh).

    ``csvhash`` is the md5 of the content, at every size. ``inclusive`` also takes files of exactly ``min_size`` bytes.

    ``manifest`` (path, size, modified, csvhash, header) tells what earlier calls have hashed: files listed with the
    same size and time are not opened; the others are ``fresh``. Fresh files are read by name, ``READ_PATHS`` at a time, or all in one scan
    where they are most of the files. Any store Spark reads will do; files above ``WHOLE_BYTES`` need one of file, hdfs, s3a or gs.
    """
    relation = _listed(spark, root, pattern, min_size, inclusive)  # lists the files once, for both uses
    listed = _described(relation)
    if manifest is None:
        fresh, content = listed, [relation]
    else:
        # the last entry of a path counts
        last = manifest.groupBy("path").agg(F.max_by(F.struct(*[c for c in manifest.columns if c != "path"]), "modified").alias("m"))
        known = last.select("path", F.col("m.size").alias("_size"), F.col("m.modified").alias("_modified"), "m.csvhash", "m.header")
        same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")), F.lit(False))
        seen = durable(listed.join(known, "path", "left").withColumn("fresh", ~same))
        fresh = seen.filter("fresh").select(*listed.columns)
        n_fresh = fresh.count()
        unchanged = seen.filter("not fresh").select(*listed.columns, "csvhash", "header", "fresh")
        if n_fresh == 0:
            return unchanged
        if 2 * n_fresh >= seen.count():
            content = [relation]
        else:
            content = [_listed(spark, paths, pattern, min_size, inclusive) for paths in _in_batches(fresh.select("location"))]
    hashed = reduce(DataFrame.unionByName, [_hashed(c) for c in content])
    large = fresh.filter(F.col("size") > WHOLE_BYTES).select("path").repartition("path")
    hashed = hashed.unionByName(large.mapInPandas(_streamed, "path string, csvhash string, header string"))
    out = fresh.join(hashed, "path")
    if manifest is None:
        return out.select("path", "location", "csvfile", "size", "csvhash", "header")
    return unchanged.unionByName(out.withColumn("fresh", F.lit(True)).select(*unchanged.columns))


def read_lines(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """Lines of text files: (path, block_start, seq, line).

    (block_start, seq) orders the lines of a file even when the file is read in several splits:
    ``seq`` grows within a split and splits do not overlap.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )


def lines_of(files: DataFrame) -> DataFrame:
    """Lines of each of ``files`` (path, location, size), as ``read_lines`` gives them; the files are not listed again.

    They are opened by name in tasks. Files above ``LINES_BYTES``, packed ones, and those of stores that have no ranged reads are
    read by Spark, ``READ_PATHS`` at a time."""
    whole = _ranged() & (F.col("size") <= LINES_BYTES)
    lines = _dealt(files.filter(whole).select("path", "size")).select("path").mapInArrow(_lines, "path string, block_start long, seq long, line binary")
    lines = lines.withColumn("line", F.col("line").cast("string"))
    for paths in _in_batches(files.filter(~whole).select("location")):
        lines = lines.unionByName(read_lines(files.sparkSession, paths))
    return lines


def texts_of(files: DataFrame) -> DataFrame:
    """Whole text of each of ``files`` (path, location, size), which are small: (path, text). The files are not listed again."""
    found = _dealt(files.filter(_ranged()).select("path", "size")).select("path").mapInPandas(_texts, "path string, content binary")
    found = found.select("path", F.col("content").cast("string").alias("text"))
    for paths in _in_batches(files.filter(~_ranged()).select("location")):
        texts = files.sparkSession.read.text(paths, wholetext=True)
        found = found.unionByName(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))
    return found


def first_lines(files: DataFrame) -> DataFrame:
    """First line of each of ``files`` (path, location, size): (path, header). Files are opened by range: no more is read of one than
    ``HEAD_BYTES`` beyond its first line.

    Packed files, and those of stores that have no ranged reads, are read by Spark as lines. Empty files have no line."""
    heads = _dealt(files.filter(_ranged()).select("path", "size")).select("path").mapInPandas(_heads, "path string, header binary")
    heads = heads.select("path", F.col("header").cast("string").alias("header"))
    for paths in _in_batches(files.filter(~_ranged()).select("location")):
        lines = read_lines(files.sparkSession, paths).filter(F.col("block_start") == 0)
        heads = heads.unionByName(lines.groupBy("path").agg(F.min_by("line", "seq").alias("header")))
    return heads


def read_headers(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """First line of each file: (path, file, header), from ranged reads (``first_lines``)."""
    heads = first_lines(durable(list_files(spark, root, pattern, 1, inclusive=True)))
    return heads.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "header")
