"""Web archives in ZIP packages: written by tasks, read back by ranges without extraction.

A package holds stored WARC members under ``archive/``, whose records are gzip members each
on its own, and an index of the records under ``indexes/``.  Each task writes one package under a name of its own
attempt and returns that name; only names in the staged result are ever read, so a lost or
repeated attempt leaves no trace in the data.  Reading parses the central directory (with
ZIP64 fields), finds members by it, cuts the index into ranges of records, spreads the
ranges over tasks and reads just these bytes.

Of records with equal payloads of at least ``LEAST_SHARED`` bytes, those of the smallest id
are responses, the others are revisits that carry digest and length instead of the payload.

Defined results: NULL payload is empty; a NULL id is larger than any other and never
referred to, so records whose ids are all NULL are responses; repeated rows of the smallest
id are all responses; a NULL or unprintable url is written escaped; an empty table gives no
rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .staging import staged, workspace

LEAST_SHARED = 100
RANGE_BYTES = 4 << 20
MEMBER_BYTES = 256 << 20
CREATED = "1970-01-01T00:00:00Z"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
RECORD_COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def described(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """Each page with digest, length, and what its record refers to (NULL for a response)."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    shared = pages.filter(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = shared.filter("n > 1 and first is not null").select("digest", "first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return pages.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", "bytes", refers.alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {CREATED}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=_PRINTABLE)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PRINTABLE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%"


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``described`` as packages in ``folder``; one row (path, records) for each."""

    def write(batches):
        package, stream, index, member, records = None, None, [], None, 0
        path = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, _, refers_to = (c[i].as_py() for c in columns)
                if package is None:
                    files, place = fs.FileSystem.from_uri(folder)
                    files.create_dir(place, recursive=True)
                    stream = files.open_output_stream(f"{place}/{os.path.basename(path)}")
                    package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                if member is None:
                    name, at = f"archive/data-{len(package.filelist):04d}.warc.gz", 0
                    member = package.open(name, "w", force_zip64=True)
                raw = gzip.compress(record(page_id, url, payload.encode(), digest, refers_to), 5, mtime=0)
                member.write(raw)
                index.append(json.dumps({"filename": name, "offset": at, "length": len(raw), "page": page_id}))
                at += len(raw)
                records += 1
                if at >= MEMBER_BYTES:
                    member.close()
                    member = None
        if package is None:
            return
        if member is not None:
            member.close()
        package.writestr("indexes/index.cdxj", "\n".join(index))
        package.close()
        stream.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([records], pa.int64())})

    return pages.select("page_id", "url", "payload", "digest", "bytes", "refers_to").mapInArrow(write, "path string, records long")


def read_at(file, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a package from its central directory: name -> (method, header offset, size, checksum)."""
    tail_size = min(size, 22 + 0xFFFF + 20)
    tail = read_at(file, size - tail_size, tail_size)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack("<Q", tail[at - 12 : at - 4])[0]
        end64 = read_at(file, where, 56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    raw, p, members = read_at(file, start, length), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, checksum, packed, plain = struct.unpack("<H4xIII", raw[p + 10 : p + 28])
        names, extra, comment = struct.unpack("<HHH", raw[p + 28 : p + 34])
        offset = struct.unpack("<I", raw[p + 42 : p + 46])[0]
        name = raw[p + 46 : p + 46 + names].decode()
        q, stop = p + 46 + names, p + 46 + names + extra
        while q + 4 <= stop:  # ZIP64 field: 8 bytes for each value that is all ones above, in this order
            tag, n = struct.unpack("<HH", raw[q : q + 4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", raw[q + 4 : q + 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            q += 4 + n
        members[name] = (method, offset, packed, checksum)
        p = stop + comment
    return members


def data_start(file, header: int) -> int:
    """First byte of a member's data; the local header has its own name and extra lengths."""
    raw = read_at(file, header, 30)
    if raw[:4] != LOCAL:
        raise ValueError("no local header")
    return header + 30 + sum(struct.unpack("<HH", raw[26:30]))


def record_ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of whole consecutive records (path, start, lengths), from directory and index alone."""

    def ranges(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as file:
                    members = directory(file, file.size())
                    starts = {}
                    for name, (method, header, _, _) in members.items():
                        if name.startswith("archive/"):
                            if method != 0:
                                raise ValueError(f"{name} is compressed; stored members can be read by range")
                            starts[name] = data_start(file, header)
                    out = []
                    for name, (_, header, size, checksum) in members.items():
                        if name.startswith("indexes/"):
                            raw = read_at(file, data_start(file, header), size)
                            if zlib.crc32(raw) != checksum:
                                raise ValueError(f"{name} is damaged")
                            out += _joined(map(json.loads, raw.decode().splitlines()), starts, range_bytes)
                columns = {"path": [path] * len(out), "start": pa.array([a for a, _ in out], pa.int64()), "lengths": pa.array([b for _, b in out], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(columns)

    return packages.select("path").mapInArrow(ranges, "path string, start long, lengths array<long>")


def _joined(entries, starts: dict[str, int], range_bytes: int) -> list[tuple[int, list[int]]]:
    out, end = [], -1
    for e in entries:
        at = starts[e["filename"]] + e["offset"]
        if out and at == end and at + e["length"] - out[-1][0] <= range_bytes:
            out[-1][1].append(e["length"])
        else:
            out.append((at, [e["length"]]))
        end = at + e["length"]
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields in lower case, and the block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return fields, rest[:size]


def _page(urn: str | None) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">") if urn else "None"
    return None if value == "None" else int(value)


def read_records(ranges: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the ranges; a response's payload is checked against its digest."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload

    def read(batches):
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "lengths"))):
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as file:
                    raw, p, rows = read_at(file, start, sum(lengths)), 0, []
                for n in lengths:
                    fields, block = parse_record(gzip.decompress(raw[p : p + n]))
                    p += n
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["x-payload-length"])
                    if fields["warc-type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload in {path}")
                    rows.append((_page(fields["warc-record-id"]), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), fields["warc-target-uri"], payload))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[: 6 + with_payload])]
                yield pa.RecordBatch.from_arrays(arrays, names=[*RECORD_COLUMNS, "url", "payload"][: 6 + with_payload])

    spread = ranges.repartition(F.col("path"), F.col("start"))
    return spread.mapInArrow(read, schema)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write ``pages`` as packages in the shared folder and read every record back."""
    folder = workspace(pages.sparkSession).child(f"packages-{uuid.uuid4().hex}")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    packages = staged(write_packages(described(pages, **columns), folder), "packages")
    return read_records(record_ranges(packages))
