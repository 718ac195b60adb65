"""WARC archives: written with an index first, read back through it by coalesced byte ranges.

Writing: each task writes one archive of gzipped records, a member a record, to the shared folder and passes on an
index row a record: file, offset, length, url, digest, page. The index is stored as Parquet before anything is read.
Of equal payloads of REVISIT_BYTES or more, the record of the smallest page id is a response; the others are revisit
records that refer to it, without the payload.

Reading: the index rows of the selected records are sorted by file and offset in blocks of a file; neighbours no
further apart than GAP bytes are read at once, up to RUN bytes, and cut into records by the index.

A task that is run again writes another file; the index names only the files of the attempts that ended well, so what
a lost executor left half written is never read.

Defined results: a null html is an empty payload; payloads under REVISIT_BYTES are all responses, equal or not; where
several rows have the smallest page id, all of them are responses; a row without a page id refers to the smallest id
of its payload, or is a response if that payload has none. An empty table gives an empty index. Only page_id, url and
html are looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from . import _shared

REVISIT_BYTES = 100
GAP, RUN, FILE_BLOCK = 1 << 16, 8 << 20, 64 << 20
#: Bytes of archives that a reading task has at most, and, where there are tasks to spare, at least.
READ_MOST, READ_LEAST = 1 << 28, 1 << 22
#: The table of revisits is sent to all tasks up to so many rows (of under 100 bytes); a larger one is shuffled.
SENT_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, digest string, page_id {id}, record_type string"


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the rows that repeat a payload. Narrow rows: the payload itself is not moved."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size")).where(F.col("size") >= REVISIT_BYTES).drop("size")
    rows = _shared.spilled(rows, "digests")
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = _shared.attach(rows, first, "digest")
    return _shared.stable(found.where("refers_to is not null and not page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct())


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    found = revisits(pages)
    if found.count() <= SENT_ROWS:
        found = F.broadcast(found)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    found = found.select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "refers_to")
    return rows.join(found, rows["page_id"].eqNullSafe(F.col("__page")) & (rows["digest"] == F.col("__digest")), "left").drop("__page", "__digest")


def _clean(value: object) -> str:
    """A header's value: no line breaks."""
    return re.sub(r"[\r\n]+", " ", str(value))


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One gzipped WARC record."""
    kind = "response" if refers_to is None else "revisit"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Payload-Length: {len(payload)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {_clean(page_id)}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {digest}')}>", f"WARC-Refers-To-Page-ID: {_clean(refers_to)}"]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """A gzipped record's headers (names in lower case) and payload."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :]


#: The schemes that Hadoop alone has for a store that pyarrow opens by another name.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder in it. Stores that pyarrow doesn't know are refused."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise ValueError(f"archives can't be written to {path}: pyarrow has no file system for {scheme}") from e


def write(rows: DataFrame, folder: str) -> DataFrame:
    """rows: as marked() gives them -> the index, stored under folder/index; the archives are beside it."""
    kind = rows.schema["page_id"].dataType.simpleString()
    names = ["file", "offset", "length", "url", "digest", "page_id", "record_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = _open(folder)
        name, at, sink = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                found = []
                for page, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if sink is None:
                        disk.create_dir(top, recursive=True)
                        sink = disk.open_output_stream(f"{top}/{name}", compression=None)
                    data = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers_to)
                    sink.write(data)
                    found.append((name, at, len(data), url, digest, page, "response" if refers_to is None else "revisit"))
                    at += len(data)
                if found:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), batch.column(0).type, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)
        finally:
            if sink is not None:
                sink.close()

    _open(folder)  # refused here, before anything is written
    index = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, INDEX.format(id=kind))
    index.write.parquet(f"{folder}/index")
    return rows.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def read(selected: DataFrame, folder: str) -> DataFrame:
    """Index rows -> page_id, url, payload (binary; of a revisit none), payload_bytes, payload_digest, record_type, refers_to (string)."""
    kind = selected.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, top = _open(folder)
        sources: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            k, found, size = 0, [], 0
            types = [batch.column(3).type, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)  # noqa: E731, B023
            while k < len(rows):
                file, start, end, m = rows[k][0], rows[k][1], rows[k][1] + rows[k][2], k + 1
                while m < len(rows) and rows[m][0] == file and 0 <= rows[m][1] - end <= GAP and rows[m][1] + rows[m][2] - start <= RUN:
                    end, m = rows[m][1] + rows[m][2], m + 1
                if file not in sources:
                    for s in sources.values():
                        s.close()
                    sources = {file: disk.open_input_file(f"{top}/{file}")}
                data = sources[file].read_at(end - start, start)
                for _, at, length, page in rows[k:m]:
                    head, payload = parse(data[at - start : at - start + length])
                    if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != head["warc-payload-digest"].removeprefix("sha256:"):
                        raise ValueError(f"a payload in {file} is not what its digest says")
                    found.append((page, head.get("warc-target-uri"), payload, int(head["warc-payload-length"]), head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"], head.get("warc-refers-to-page-id")))
                    size += len(payload)
                if size > RUN:
                    yield out()
                    found, size = [], 0
                k = m
            if found:
                yield out()

    blocks = selected.select("file", "offset", "length", "page_id", F.floor(F.col("offset") / FILE_BLOCK).alias("block"))
    # the index says little about the bytes to read: as many tasks as these need
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, total // READ_MOST, min(total // READ_LEAST, selected.sparkSession.sparkContext.defaultParallelism))
    blocks = blocks.repartition(tasks, "file", "block").sortWithinPartitions("file", "offset").drop("block")
    schema = f"page_id {kind}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return blocks.mapInArrow(run, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder, and reads them all back."""
    folder = _shared.fresh_dir(pages.sparkSession, "warc")
    return read(write(marked(pages), folder), folder)
