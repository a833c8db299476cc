"""WARC archives: a writer and a splittable reader.

Archives hold one gzip member for each record.  The reader deals byte ranges to tasks.  A task
looks for gzip magic in its range, decodes the member there and takes it for a record only if it
begins with complete WARC headers whose length fits; a record belongs to the range in which its
member starts, and is read beyond the range's end where need be.  Two tasks thus never read the
same record, and none is lost, without an index.

Defined cases: a null payload is an empty one; a null id is written as ``<urn:page:none>`` and
read as null; control characters and spaces of a URL are percent-encoded; records with equal ids
are all written; an empty table gives archives without records.  A payload that itself holds an
uncompressed gzip WARC stored without compression could be taken for records if a range starts
inside it; text payloads can't (the magic isn't UTF-8).
"""

from __future__ import annotations

import base64
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
#: Records with at least so many payload bytes may be revisits.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "file string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def encode_record(record_id: str, url: str | None, payload: bytes, digest: str, revisit_of: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response, or a revisit without payload if ``revisit_of`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit_of else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit_of else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit_of:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{revisit_of}>"]
    out = zlib.compressobj(6, zlib.DEFLATED, 31)
    return out.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + out.flush()


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records(record_id, url, payload, digest, revisit_of)``, one archive a task.

    Returns the manifest (file, records, bytes): only files that a finished task names count, so
    those that a lost task left are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _fs(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                        record_id, url, payload, digest, revisit_of = row
                        out.write(encode_record(record_id, url, payload or b"", digest, revisit_of))
                        n += 1
            size = out.tell()
        yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    return records.select("record_id", "url", "payload", "digest", "revisit_of").mapInArrow(run, "file string, records long, bytes long")


class _Blocks:
    """Reads of a file through one cached block."""

    def __init__(self, stream, size: int, block: int = 4 << 20):
        self.stream, self.size, self.block = stream, size, block
        self.at, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.stream.read_at(max(n, min(self.block, self.size - at)), at) if at < self.size else b""
        return self.data[at - self.at : at - self.at + n]


def _member(blocks: _Blocks, at: int, step: int = 1 << 15) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at`` if it is one that begins as WARC does."""
    out, pos, parts = zlib.decompressobj(31), at, []
    try:
        while not out.eof:
            raw = blocks.get(pos, min(step, blocks.size - pos))
            if not raw:
                return None
            parts.append(out.decompress(raw))
            pos += len(raw)
            if len(parts) == 1 and not parts[0].startswith(b"WARC/"):
                return None
    except zlib.error:
        return None
    return b"".join(parts), pos - len(out.unused_data)


def decode_record(data: bytes) -> dict | None:
    """Headers (lower-case names) and block of a record, or None if they don't fit."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = head.get("content-length", "")
    if not first.startswith("WARC/") or "warc-type" not in head or not length.isdigit() or len(data) != end + 8 + int(length):
        return None
    return {"head": head, "block": data[end + 4 : end + 4 + int(length)]}


def scan(stream, size: int, start: int, end: int) -> Iterator[tuple[int, dict]]:
    """(offset, record) of the records whose member starts in [start, end)."""
    blocks, at, window = _Blocks(stream, size), start, 1 << 12
    while at < end:
        raw = blocks.get(at, min(window + 2, size - at))
        found = raw.find(MAGIC)
        if found < 0:
            if at + len(raw) >= size:
                return
            at += max(1, len(raw) - 2)
            continue
        at += found
        if at >= end:
            return
        member = _member(blocks, at)
        record = member and decode_record(member[0])
        if record:
            yield at, record
            at = member[1]
        else:
            at += 1


def fields(record: dict) -> tuple:
    head, block = record["head"], record["block"]
    payload, length = block, None
    if "application/http" in head.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        length = int(m[1]) if m else None
    digest = head.get("warc-payload-digest", "")
    if digest.lower().startswith("sha1:"):
        try:
            digest = base64.b32decode(digest[5:].upper()).hex()
        except ValueError:
            digest = digest[5:].lower()
    strip = lambda k: head[k].strip("<>") if k in head else None
    revisit = head["warc-type"] == "revisit"
    return (head["warc-type"], strip("warc-record-id"), head.get("warc-target-uri"), strip("warc-refers-to"), digest or None, length if revisit and length is not None else len(payload), None if revisit else payload)


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, size: int):
        self.file, self.start, self.end, self.size = file, start, end, size


class _WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def files(self) -> list[tuple[str, int]]:
        """(file, bytes) as the manifest table has them, or as found under the paths."""
        from pyarrow import dataset, fs

        if "manifest" in self.options:
            files, root = _fs(self.options["manifest"])
            found = dataset.dataset(root, filesystem=files, format="parquet").to_table(columns=["file", "bytes"], filter=dataset.field("records") > 0)
            return sorted(zip(found["file"].to_pylist(), found["bytes"].to_pylist(), strict=True))
        out = []
        for path in json.loads(self.options["files"]) if "files" in self.options else [self.options["path"]]:
            files, root = _fs(path)
            info = files.get_file_info(root)
            infos = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
            scheme = path[: len(path) - len(root)] if path.endswith(root) else ""
            out += [(scheme + i.path, i.size) for i in sorted(infos, key=lambda x: x.path) if i.is_file and i.path.endswith((".warc.gz", ".gz"))]
        return out

    def partitions(self) -> list[_Range]:
        split = int(self.options.get("splitbytes", SPLIT_BYTES))
        return [_Range(file, at, min(size, at + split), size) for file, size in self.files() for at in range(0, size, split)] or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        files, path = _fs(part.file)
        with files.open_input_file(path) as stream:
            for offset, record in scan(stream, part.size, part.start, part.end):
                rows.append((part.file, offset, *fields(record)))
                held += len(record["block"])
                if held > 4 << 20 or len(rows) >= 1024:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("splitBytes", n).load(path)``; ``manifest`` names a table of files, ``files`` lists them in JSON."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, paths: str | list[str] | None = None, split_bytes: int = SPLIT_BYTES, manifest: str | None = None) -> DataFrame:
    """Records of a folder, a list of files, or the files a manifest table (file, records, bytes) names."""
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc").option("splitBytes", str(split_bytes))
    if manifest:
        return reader.option("manifest", manifest).load()
    return reader.load(paths) if isinstance(paths, str) else reader.option("files", json.dumps(paths)).load()


def plan_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """Records of ``pages(page_id, url, html)``: of equal payloads of at least ``least`` bytes the
    row with the largest id is the response, the others revisit it.

    Only digests are grouped, partly before the shuffle; the join back is split where one digest
    is frequent.
    """
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = base.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.concat(F.lit("urn:page:"), F.col("first")))
    record_id = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    return base.join(groups, "digest", "left").select(record_id.alias("record_id"), "url", "payload", "digest", refers.alias("revisit_of"))


def archive(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their records back."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(plan_revisits(pages), folder).write.parquet(f"{folder}-manifest")
    return read_warc(spark, split_bytes=split_bytes, manifest=f"{folder}-manifest")
