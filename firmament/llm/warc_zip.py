"""WARC records in ZIP-packaged archives, written and read in ranges.

An archive is a ZIP file with two stored members: ``archive/data.warc.gz`` (records, each compressed by itself) and
``indexes/index.cdx`` (a line for each record with its offset and length). The reader parses the end record, the ZIP64
records and the central directory, finds where the stored members lie, reads the index, and range-reads blocks of records;
nothing is extracted or read whole.

Archives go to the shared folder under names of their own; only those of finished tasks are in the list that the reader
gets, so a repeated task leaves nothing that counts. Paths may be of any file system that pyarrow knows.

Null html is an empty payload, a null url leaves its header out, a null page id stays null. Of equal payloads of
``LEAST_SHARED`` bytes or more, the records with the largest id are responses and the others refer to it; rows without
any id are responses. An empty table makes no archive and no record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.common import join_small, materialize, ship_package
from firmament.session import shared_dir

LEAST_SHARED = 1000
ROLL, BLOCK = 32 << 20, 4 << 20  # bytes of an archive, and of records read at once
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


# ---- the ZIP directory ---------------------------------------------------------

class Member(NamedTuple):
    name: str
    method: int
    size: int
    offset: int  # of its data in the archive


def end_of_directory(read: Callable[[int, int], bytes], size: int) -> tuple[int, int, int]:
    """Offset, length and number of entries of the central directory."""
    tail_at = max(0, size - 65557)  # the end record with its longest comment
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    entries, length, offset = struct.unpack_from("<H2I", tail, at + 10)
    where = tail_at + at - 20
    locator = read(where, 20) if where >= 0 else b""
    if locator[:4] == b"PK\x06\x07":
        record = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end of central directory")
        entries, length, offset = struct.unpack_from("<3Q", record, 32)
    return offset, length, entries


def members(read: Callable[[int, int], bytes], size: int) -> Iterator[Member]:
    """The archive's members, from the central directory and the local headers it points to."""
    offset, length, entries = end_of_directory(read, size)
    raw, at = read(offset, length), 0
    for _ in range(entries):
        if raw[at:at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<2H", raw, at + 8)
        packed, full = struct.unpack_from("<2I", raw, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<3H", raw, at + 28)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = raw[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<2H", extra, x)
            if kind == 1:  # the long values, in this order, of the fields that are full
                y = x + 4
                if full == 0xFFFFFFFF:
                    full, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                if packed == 0xFFFFFFFF:
                    packed, y = struct.unpack_from("<Q", extra, y)[0], y + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack_from("<Q", extra, y)[0]
            x += 4 + n
        head = read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        yield Member(name, method, packed, local + 30 + sum(struct.unpack_from("<2H", head, 26)))
        at += 46 + n_name + n_extra + n_comment


# ---- records -------------------------------------------------------------------

def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "")[10:-1]
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit with the headers alone if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; a payload that does not match its headers is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, digest, refers_to`` as archives; ``path, bytes, records`` of each."""
    ship_package(records.sparkSession)
    records = records.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), "digest", "refers_to")

    def save(data: io.BytesIO, lines: list[str]) -> tuple[str, int, int]:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, content in ((DATA, data.getbuffer()), (INDEX, "".join(lines).encode())):
                with z.open(name, "w", force_zip64=True) as f:
                    f.write(content)
        target, path = file_system(folder)
        target.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        with target.open_output_stream(f"{path}/{name}") as f:
            f.write(out.getbuffer())
        return f"{folder}/{name}", out.tell(), len(lines)

    def write(batches):
        data, lines, done = io.BytesIO(), [], []
        for b in batches:
            for page, url, html, digest, refers_to in zip(*(c for c in b.columns), strict=True):
                raw = gzip.compress(record(page.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), digest.as_py(),
                                           refers_to.as_py()), 1, mtime=0)
                lines.append(f"{data.tell()} {len(raw)}\n")
                data.write(raw)
                if data.tell() >= ROLL:
                    done.append(save(data, lines))
                    data, lines = io.BytesIO(), []
        if lines:
            done.append(save(data, lines))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         ["path", "bytes", "records"])

    return records.mapInArrow(write, "path string, bytes long, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """All records of the archives (``path``): ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload``.

    A directory is parsed by one task; its records are dealt out in blocks of ``BLOCK`` bytes.
    """
    ship_package(archives.sparkSession)

    def blocks(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                source, name = file_system(path)
                with source.open_input_file(name) as f:
                    def read(offset: int, length: int, f=f) -> bytes:
                        return f.read_at(length, offset)

                    found = {m.name: m for m in members(read, f.size()) if m.method == zipfile.ZIP_STORED}
                    data, index = found[DATA], found[INDEX]
                    spans = [tuple(map(int, line.split())) for line in read(index.offset, index.size).decode().splitlines()]
                out, held = [], []
                for offset, length in spans:
                    if held and offset + length - held[0][0] > BLOCK:
                        out.append((data.offset + held[0][0], [n for _, n in held]))
                        held = []
                    held.append((offset, length))
                if held:
                    out.append((data.offset + held[0][0], [n for _, n in held]))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(out), pa.string()), pa.array([o for o, _ in out], pa.int64()),
                                                  pa.array([n for _, n in out], pa.list_(pa.int64()))], ["path", "offset", "lengths"])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def records(batches):
        for b in batches:
            for path, offset, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                source, name = file_system(path)
                with source.open_input_file(name) as f:
                    raw = f.read_at(sum(lengths), offset)
                rows, at = [], 0
                for n in lengths:
                    warc, http, payload = parse(gzip.decompress(raw[at:at + n]))
                    at += n
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    whole = warc["warc-type"] == "response"
                    if whole and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"damaged record at {offset} in {path}")
                    rows.append((_page(warc["warc-record-id"]), int(http["content-length"]), digest, warc["warc-type"],
                                 _page(warc.get("warc-refers-to")), warc.get("warc-target-uri"), payload if whole else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    wanted = archives.sparkSession.sparkContext.defaultParallelism
    spread = archives.select("path").repartition(wanted).mapInArrow(blocks, "path string, offset long, lengths array<long>")
    return spread.repartition(4 * wanted, F.xxhash64("path", "offset")).mapInArrow(records, schema)


def deduplicated(pages: DataFrame) -> DataFrame:
    """``pages`` with ``digest`` and ``refers_to``, the page whose equal payload stands for this one's, if another."""
    payload = F.coalesce("html", F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("digest"),
                       F.octet_length(payload).alias("size"))
    shared = src.where(F.col("size") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    shared = materialize(shared.where("n > 1 and kept is not null").select("digest", "kept"), "warc-shared")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("kept"))
    return join_small(src, shared, "digest", "left").withColumn("refers_to", F.when(F.col("kept").isNotNull() & other, F.col("kept")))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write a record for each page (``page_id, url, html``) and read all records back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(materialize(write_archives(deduplicated(pages), folder), "warc-archives"))
