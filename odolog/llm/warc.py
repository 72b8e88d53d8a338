"""WARC archives, index first (operator 3).

Writing: each task appends records, one gzip member each, to archives of its own in the shared folder
and returns an index row per record: archive, offset, length, URL and digest. The index is made
durable before anything reads it. Archives carry the number of the task attempt in their names, so a
task that is run again writes new files and the index names only those of the attempt that counted.

Reading: index rows, all or selected, are range-partitioned and sorted by archive and offset. A task
joins neighbouring ranges while the gap and the read stay small, reads each such range once, and cuts
the records out of it.

Equal payloads of at least ``revisit_bytes`` are stored once: the one with the smallest id is the
response, the others are revisits that refer to it. Which ones is decided on ids and digests; the
payloads themselves move once, evenly dealt by id. A digest that a third of all pages share is
one row in the table of digests.

Archives are read and written with ``pyarrow.fs``, which knows local (shared), HDFS, S3 and GCS paths.

Defined results: a null payload is empty; a null id is written as an empty one and read as null; a
null URL leaves the header out; rows with the id of the response and its payload are all responses;
an empty table gives an empty index; other columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from odolog.llm.common import file_system, shared_folder
from odolog.session import durable

INDEX = (
    "path string, offset long, length long, url string, digest string, record_id long, record_type string, "
    "refers_to long"
)
RECORDS = (
    "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary"
)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _urn(record_id: int | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def _from_urn(urn: str | None) -> int | None:
    digits = (urn or "")[10:-1]
    return int(digits) if digits else None


def render(record_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit has the HTTP header but no payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {size}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _headers(stream: io.BytesIO) -> dict[str, str]:
    stream.readline()
    found = {}
    while line := stream.readline().decode().rstrip("\r\n"):
        name, _, value = line.partition(":")
        found[name.lower()] = value.strip()
    return found


def parse(record: bytes) -> dict:
    """The fields of ``RECORDS`` from one uncompressed record. Size and digest of a response are
    those of the bytes found; a revisit states those of the payload it stands for."""
    stream = io.BytesIO(record)
    head = _headers(stream)
    block = io.BytesIO(stream.read(int(head["content-length"])))
    http = _headers(block)
    revisit = head["warc-type"] == "revisit"
    payload = None if revisit else block.read()
    return {
        "record_id": _from_urn(head["warc-record-id"]),
        "url": unquote(head["warc-target-uri"]) if "warc-target-uri" in head else None,
        "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload_digest": head["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest(),
        "record_type": head["warc-type"],
        "refers_to": _from_urn(head.get("warc-refers-to")),
        "payload": payload,
    }


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _writer(folder: str, archive_bytes: int):
    schema = _arrow_schema(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        number, out, offset, path = 0, None, 0, ""
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.gz"
                    path, offset, number = f"{folder}/{name}", 0, number + 1
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                record = gzip.compress(
                    render(row["id"], row["url"], row["payload"], row["digest"], row["size"], row["refers_to"]), 6, mtime=0
                )
                out.write(record)
                kind = "response" if row["refers_to"] is None else "revisit"
                index.append(
                    (path, offset, len(record), row["url"], row["digest"], row["id"], kind, row["refers_to"])
                )
                offset += len(record)
                if offset >= archive_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in index], schema=schema)
        if out is not None:
            out.close()

    return write


def write(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    folder: str | None = None,
    revisit_bytes: int = 100,
    archive_bytes: int = 64 << 20,
) -> DataFrame:
    """Writes a record per row below ``folder`` and returns the durable index."""
    folder = folder or shared_folder(pages.sparkSession)
    bytes_ = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.sha2(bytes_, 256).alias("digest"),
        F.octet_length(bytes_).cast("long").alias("size"), bytes_.alias("payload"),
    )
    digests = durable(rows.filter(F.col("size") >= revisit_bytes).select("id", "digest"))
    first = durable(
        digests.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    refers = (
        digests.join(first, "digest").filter("id is null or id != first").groupBy("id", "digest").agg(F.first("first").alias("refers_to"))
    )
    r = refers.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    matched = rows.join(r, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return durable(matched.drop("_id", "_digest").mapInArrow(_writer(folder, archive_bytes), INDEX))


def _reader(gap_bytes: int, read_bytes: int):
    schema = _arrow_schema(RECORDS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
            """Runs of records close enough to be read at once: archive, start, end, parts."""
            path, start, end, parts = None, 0, 0, []
            for batch in batches:
                names, offsets, lengths = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
                for p, o, n in zip(names, offsets, lengths):
                    if p != path or o - end > gap_bytes or max(end, o + n) - start > read_bytes:
                        if parts:
                            yield path, start, end, parts
                        path, start, end, parts = p, o, o, []
                    parts.append((o, n))
                    end = max(end, o + n)
            if parts:
                yield path, start, end, parts

        opened, source = None, None
        for path, start, end, parts in ranges():
            if path != opened:
                if source is not None:
                    source.close()
                store, name = file_system(path)
                opened, source = path, store.open_input_file(name)
            chunk = source.read_at(end - start, start)
            for i in range(0, len(parts), 512):
                found = [parse(gzip.decompress(chunk[o - start : o - start + n])) for o, n in parts[i : i + 512]]
                yield pa.RecordBatch.from_pylist(found, schema=schema)
        if source is not None:
            source.close()

    return read


def read(index: DataFrame, gap_bytes: int = 64 << 10, read_bytes: int = 4 << 20, task_bytes: int = 64 << 20) -> DataFrame:
    """The records of the index rows given. Ranges less than ``gap_bytes`` apart are read together,
    up to ``read_bytes`` at a time (more only for a single longer record). A task reads about ``task_bytes``."""
    wanted = index.select("path", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0] or 0
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-total // task_bytes))
    placed = wanted.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(_reader(gap_bytes, read_bytes), RECORDS)
