"""WARC archives: captures written as request, response or revisit, and metadata records, read and assembled again."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm.shared import bounded, materialize, shared_dir, texts

#: A file is closed once it has so many bytes; what one task holds does not grow with its input.
FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f6d7c1e-3b0b-5a68-9d0a-6a1e6d2a7c11")
_BAD = re.compile(r"[\r\n\x00]")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '/'.join(map(str, parts)))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {_BAD.sub(' ', v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def records(stream: BinaryIO, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of a WARC file, member by member."""
    rest, unzip, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(chunk)
        if not data:
            break
        parts.append(unzip.decompress(data))
        rest = unzip.unused_data
        if unzip.eof:
            head, _, body = b"".join(parts).partition(b"\r\n\r\n")
            headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
            yield headers, body[: int(headers["content-length"])]
            unzip, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record is cut off")


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def capture(row: dict, name: str, number: int) -> list[bytes]:
    """The records of one capture: its request, its response or revisit, and its metadata.

    A response that others revisit is named by its payload, all else by its place, the number of a file's capture.
    """
    uri = row["url"] or "urn:unknown"
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    main = record_id("leads", digest) if row["role"] == LEADS else record_id(name, number)
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    path = re.sub(r"^[a-z]+://[^/]*", "", uri) or "/"
    request = record(
        [("WARC-Type", "request"), ("WARC-Record-ID", record_id(name, number, "request")), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/http; msgtype=request")],
        f"GET {_BAD.sub(' ', path)} HTTP/1.1\r\nHost: {_BAD.sub(' ', re.sub(r'^[a-z]+://([^/]*).*', r'\1', uri))}\r\n\r\n".encode(),
    )
    head = [("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if row["role"] != FOLLOWS:
        answer = record([("WARC-Type", "response"), *head], http_block(payload) + payload)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        answer = record([("WARC-Type", "revisit"), *head, ("WARC-Refers-To", record_id("leads", digest)), ("WARC-Profile", profile)], http_block(payload))
    fields = f"archive: {name}\r\n" + ("" if row["page_id"] is None else f"page-id: {row['page_id']}\r\n") + ("" if row["url"] is None else "has-url: 1\r\n")
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id(name, number, "metadata")), ("WARC-Concurrent-To", main), *common, ("Content-Type", "application/warc-fields")], fields.encode())
    return [request, answer, meta]


#: A page's role: its payload is its own, others have it too and revisit this page, or this page revisits another.
ALONE, LEADS, FOLLOWS = 0, 1, 2


def with_roles(pages: DataFrame, least: int) -> DataFrame:
    """pages (page_id, url, html) with `role`.

    Of rows with equal payloads of `least` bytes or more, the one with the largest page_id leads and the others follow.
    Digests and sizes are grouped (partial maxima first), and payloads that occur once leave before the join, which is on
    the digest alone: no row needs a number that a second scan might give to another. Only where several rows share
    the largest page_id, those are written with numbers first, and the smallest number leads.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = materialize(pages.select("page_id", F.unhex(F.sha1(payload)).alias("digest"), F.length(payload).alias("bytes")))
    groups = keys.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.withColumnRenamed("digest", "d"))
    at_top = F.col("page_id").eqNullSafe(F.col("last"))
    tied = keys.join(groups, F.col("digest") == F.col("d")).where(at_top).groupBy("d").agg(F.count("*").alias("tops")).where("tops > 1")
    tied = materialize(tied.select(F.col("d").alias("t")))
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("digest")).join(groups, F.col("digest") == F.col("d"), "left")
    rows = rows.withColumn("role", F.when(F.col("d").isNull(), ALONE).when(at_top, LEADS).otherwise(FOLLOWS))
    columns = ["page_id", "url", "html", "role"]
    if tied.isEmpty():
        return rows.select(columns)
    top = (F.col("role") == LEADS) & F.col("t").isNotNull()
    rows = rows.join(tied, F.col("digest") == F.col("t"), "left")
    numbered = materialize(rows.where(top).select("page_id", "url", "html", "digest", F.monotonically_increasing_id().alias("number")))
    first = numbered.groupBy("digest").agg(F.min("number").alias("least")).withColumnRenamed("digest", "f")
    settled = numbered.join(first, F.col("digest") == F.col("f")).withColumn("role", F.when(F.col("number") == F.col("least"), LEADS).otherwise(FOLLOWS))
    return rows.where(~top).select(columns).unionByName(settled.select(columns))


def qualified(spark: SparkSession, folder: str) -> str:
    """folder with the scheme that Spark resolves it to, so that workers use the same file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified folder, and the path in it."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write(pages: DataFrame, folder: str, least: int = 1000) -> DataFrame:
    """Archives of pages in `folder`, which all executors share; the table of their paths (path, records).

    Every attempt of a task writes files with names of its own, and only those of the attempt whose rows Spark keeps
    are in the table, so lost executors and repeated tasks leave no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        out, number, size, count = None, 0, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, count))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.gz"
                    path, number, count = f"{base}/{name}", number + 1, 0
                    out = store.open_output_stream(path, compression=None)
                    size = out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                for one in capture(row, name, count):
                    size += len(one)
                    count += 1
                    out.write(one)
                if size >= FILE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    return materialize(texts(with_roles(pages, least)).mapInArrow(bounded(run), "path string, records long"))


RECORDS = "record_type string, record_id string, concurrent_to string, target_uri string, refers_to string, payload_digest string, http_bytes long, payload binary, fields string"


def read(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives of files (path), without warcinfo; each file is read as a stream.

    payload_digest of a response is taken of the payload that was read; one that differs from its header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in records(stream):
                        kind = head["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest, size, payload = head.get("warc-payload-digest"), None, None
                        if kind in ("response", "revisit"):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
                            if kind == "response" and (len(payload) != size or "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                                raise ValueError(f"{head['warc-record-id']}: the payload is not what its headers say")
                            payload = payload if kind == "response" and with_payload else None
                        rows.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, size, payload, block.decode() if kind != "response" and kind != "revisit" else None))
                        if len(rows) >= 2000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    spread = files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return spread.mapInArrow(bounded(run), RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: the answer (response or revisit), its request and its metadata.

    Request and metadata records name their answer in WARC-Concurrent-To; record ids are unique, so these joins
    have no hot key. A revisit's response is looked up by WARC-Refers-To, where one response may have most of the
    revisits: a plain equi-join, which adaptive execution may split.
    """
    main = found.where(F.col("record_type").isin("response", "revisit")).select(
        F.struct("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "http_bytes", "payload").alias("answer"), F.col("record_id").alias("id")
    )
    request = found.where("record_type = 'request'").select(F.col("concurrent_to").alias("rid"), F.struct("record_id", "fields").alias("request"))
    meta = found.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("mid"), F.struct("record_id", "fields").alias("metadata"))
    return main.join(request, F.col("id") == F.col("rid"), "left").join(meta, F.col("id") == F.col("mid"), "left").select("id", "answer", "request", "metadata")


def round_trip(pages: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Null html: an empty payload, a response. Null url: the target is urn:unknown, and null again when read. Null
    page_id: a capture without id, smaller than all ids. Repeated rows are captures of their own; of those with the
    same largest page_id one is the response and the others revisit it. Empty table: no rows. Other columns are not
    written.
    """
    spark: SparkSession = pages.sparkSession
    folder = qualified(spark, folder or shared_dir(spark) + "/warc")
    rows = captures(materialize(read(write(pages, folder, least), folder)))
    page = F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1)
    flat = rows.select(
        "id",
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.col("answer.http_bytes").alias("payload_bytes"),
        F.col("answer.payload_digest").alias("b32"),
        F.col("answer.record_type").alias("record_type"),
        F.col("answer.refers_to").alias("to"),
        F.when(F.col("metadata.fields").contains("has-url"), F.col("answer.target_uri")).alias("url"),
    )
    flat = materialize(flat)
    targets = flat.where("to is not null").select("to").distinct()
    named = flat.join(targets.withColumnRenamed("to", "t"), F.col("id") == F.col("t"), "left_semi").select(F.col("id").alias("rid"), F.col("page_id").alias("refers_to"))
    return flat.join(named, F.col("to") == F.col("rid"), "left").select("page_id", "payload_bytes", hex_digest(F.col("b32")).alias("payload_digest"), "record_type", "refers_to", "url")


def letter(body: Column, at: int) -> Column:
    """The value of a BASE32 letter: A to Z are 0 to 25, 2 to 7 are 26 to 31."""
    code = F.ascii(F.substring(body, at, 1))
    return F.when(code >= 65, code - 65).otherwise(code - 24)


def hex_digest(b32: Column) -> Column:
    """Bare lower-case hex of a sha1:BASE32 digest: eight letters of five bits are ten hex digits."""
    body = F.substring(b32, 6, 32)
    groups = []
    for g in range(4):
        number = F.lit(0).cast("long")
        for k in range(8):
            number = number * 32 + letter(body, g * 8 + k + 1)
        groups.append(F.lpad(F.lower(F.hex(number)), 10, "0"))
    return F.concat(*groups)


def payloads(stream: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of an archive in memory."""
    return list(records(BytesIO(stream)))
