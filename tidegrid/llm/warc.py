"""WARC records in ZIP archives: written by tasks, read by range without extraction.

Writing: every task writes the records of its partition. An archive is a ZIP file with stored members: one WARC file and
an index of its records (key, offset, length). A task writes each archive under a name of its own and renames it when
it is whole, so that a lost or repeated task leaves no half file that is read: the rows that a task returns name its file.
Equal payloads of at least `least` bytes are written once, as the response with the smallest key; the others
are revisit records that refer to it. Payload sizes and digests are of the full payload for either.

Reading: the end record is found from the archive's tail, with the ZIP64 locator and record if they are there; the central
directory (or the ZIP64 extra fields) gives each member's place; the index member is read by range, and then each record
by its own range. Folders are reached by pyarrow's file systems: local folders, hdfs, gs, abfs and s3, of which s3a and s3n are other names; a store that only
Hadoop knows is an error.

Null html is an empty payload. Repeated keys make a record each: all rows that share the smallest key of a payload are responses.
A row of null key is a response that nothing refers to. Payloads of any length are one record, held whole by its task. A page with a null url gets an empty target URI; extra
columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegrid.llm.common import shared_dir, stash, text_of

#: fixed values: ZIP signatures
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX32 = 0xFFFFFFFF


def address(uri: str) -> str:
    """A URI of Hadoop's connectors as Arrow names it."""
    for theirs in ("s3a://", "s3n://"):
        if uri.startswith(theirs):
            return "s3://" + uri.removeprefix(theirs)
    return uri


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file."""
    from pyarrow import fs

    uri = address(uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


class ZipWriter:
    """Stored members, one after another, each of unknown size while it is written: sizes are patched by a second header
    pass only in the central directory, which is what a range reader uses; members that need them carry ZIP64 fields there, and none before its data."""

    def __init__(self, sink):
        self.sink, self.at, self.members, self.open_member = sink, 0, [], None

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def begin(self, name: str) -> int:
        raw = name.encode()
        self.open_member = [raw, self.at, 0, 0]
        # bit 3: sizes and checksum follow the data; bit 11: UTF-8 name
        self.write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 33, 0, 0, 0, len(raw), 0) + raw)
        return self.at

    def add(self, data: bytes) -> None:
        self.write(data)
        self.open_member[2] += len(data)
        self.open_member[3] = zlib.crc32(data, self.open_member[3])

    def end(self) -> None:
        raw, at, size, crc = self.open_member
        self.write(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size) if size > _MAX32 else b"PK\x07\x08" + struct.pack("<III", crc, size, size))
        self.members.append(self.open_member)

    def close(self, force64: bool = False) -> None:
        start = self.at
        for raw, at, size, crc in self.members:
            big = force64 or size >= _MAX32 or at >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            shown = (_MAX32, _MAX32, _MAX32) if big else (size, size, at)
            self.write(
                CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 33, crc, shown[0], shown[1], len(raw), len(extra), 0, 0, 0, 0, shown[2]) + raw + extra
            )
        size, n = self.at - start, len(self.members)
        if force64 or start >= _MAX32 or n >= 0xFFFF:
            end64 = self.at
            self.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self.write(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, size, start = 0xFFFF, _MAX32, _MAX32
        self.write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def read_range(f, start: int, length: int) -> bytes:
    f.seek(start)
    data = f.read(length)
    if len(data) != length:
        raise ValueError(f"{length} bytes wanted at {start}, {len(data)} there")
    return data


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name: (offset of the data, size, method) of every member, from the central directory."""
    tail_at = max(0, size - 65_557)
    tail = read_range(f, tail_at, size - tail_at)
    i = tail.rfind(END)
    if i < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, i + 10)
    if n == 0xFFFF or length == _MAX32 or start == _MAX32:
        locator = read_range(f, tail_at + i - 20, 20)
        if locator[:4] == LOCATOR64:
            (end64,) = struct.unpack_from("<Q", locator, 8)
            record = read_range(f, end64, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, out, at = read_range(f, start, length), {}, 0
    for _ in range(n):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("a broken central directory")
        method, _, _, _, packed, whole, names, extras, notes = struct.unpack_from("<HHHIIIHHH", directory, at + 10)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode()
        extra, j = directory[at + 46 + names : at + 46 + names + extras], 0
        while j + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, j)
            if tag == 1:  # only the fields that are full in the plain record, in this order
                k = j + 4
                if whole == _MAX32:
                    (whole,), k = struct.unpack_from("<Q", extra, k), k + 8
                if packed == _MAX32:
                    (packed,), k = struct.unpack_from("<Q", extra, k), k + 8
                if local == _MAX32:
                    (local,) = struct.unpack_from("<Q", extra, k)
            j += 4 + width
        head = read_range(f, local, 30)
        name_size, extra_size = struct.unpack_from("<HH", head, 26)
        out[name] = (local + 30 + name_size + extra_size, packed, method)
        at += 46 + names + extras + notes
    return out


def warc_record(key, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    name = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{k}:{digest}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(key)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"X-Page-Id: {key}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}", "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {name(refers_to)}")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record at this place")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def originals(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = 0) -> DataFrame:
    """(k, url, html, sha1, refers_to): refers_to is null for responses.

    The revisits are found without payloads and written as a table, whose known size lets a small one be broadcast; then
    payloads do not move. A large one is joined by a shuffle.
    """
    rows = pages.select(F.col(key).alias("k"), F.col("url").cast("string").alias("url"), text_of(html).alias("html")).withColumn("sha1", F.sha1("html"))
    # payloads made to collide under SHA-1 still differ in length or in the other hash
    same = ["sha1", "size", "other"]
    rows = rows.withColumn("size", F.octet_length("html")).withColumn("other", F.xxhash64("html"))
    prints = rows.filter(F.col("size") >= least).select("k", *same)
    first = prints.groupBy(*same).agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisits = prints.join(first, same).filter("k <> first").select("k", *same, F.col("first").alias("refers_to")).distinct()
    return rows.join(stash(revisits, "revisits"), ["k", *same], "left").drop("size", "other")


def write_archives(records: DataFrame, folder: str, archive_bytes: int) -> DataFrame:
    """Write `records` (k, url, html, sha1, refers_to) to ZIP archives; (archive string, records bigint) for each.

    Tasks write the records of their partitions as they come and begin a new archive after `archive_bytes`.
    """

    def run(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        out = None

        def finish():
            out.end()
            out.begin(f"{made}.cdx")
            out.add("".join(index).encode())
            out.end()
            out.close(force64=True)
            sink.close()
            system.move(place, f"{path}/{made}.zip")
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{made}.zip"]), pa.array([len(index)], pa.int64())], names=["archive", "records"]
            )

        for b in batches:
            for i in range(0, b.num_rows, 64):
                for r in b.slice(i, 64).to_pylist():
                    if out is None:
                        made, index = f"part-{uuid.uuid4().hex}", []
                        place = f"{path}/_{made}.tmp"
                        sink = system.open_output_stream(place)
                        out = ZipWriter(sink)
                        base = out.begin(f"{made}.warc")
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    raw = warc_record(r["k"], r["url"], r["html"].encode(), digest, r["refers_to"])
                    index.append(f"{r['k']} {out.at - base} {len(raw)}\n")
                    out.add(raw)
                    if out.at >= archive_bytes:
                        yield finish()
                        out = None
        if out is not None:
            yield finish()

    return records.select("k", "url", "html", "sha1", "refers_to").mapInArrow(run, "archive string, records bigint")


def list_records(archives: DataFrame) -> DataFrame:
    """(archive, at, length): the place of every record, from each archive's directory and index member."""

    def run(batches):
        for b in batches:
            for a in b.column(0).to_pylist():
                system, path = file_system(a)
                with system.open_input_file(path) as f:
                    found = members(f, f.size())
                    for name, (at, size, method) in found.items():
                        if not name.endswith(".cdx"):
                            continue
                        warc, _, stored = found[name.removesuffix(".cdx") + ".warc"]
                        if method or stored:
                            raise ValueError(f"{a}: only stored members can be read by range")
                        rows = [x.split() for x in read_range(f, at, size).decode().splitlines()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([a] * len(rows), pa.string()), pa.array([warc + int(r[1]) for r in rows], pa.int64()), pa.array([int(r[2]) for r in rows], pa.int64())],
                            names=["archive", "at", "length"],
                        )

    return archives.select("archive").mapInArrow(run, "archive string, at bigint, length bigint")


def read_records(places: DataFrame, step: int = 64) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload) of each place, read by range.

    A response's size and digest are computed from the payload that was read; a revisit's are those of its header.
    """
    schema = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        name, f = "", None
        for b in batches:
            for i in range(0, b.num_rows, step):
                rows = []
                for p in b.slice(i, step).to_pylist():
                    if p["archive"] != name:
                        if f is not None:
                            f.close()
                        system, path = file_system(p["archive"])
                        name, f = p["archive"], system.open_input_file(path)
                    h, body = parse_record(read_range(f, p["at"], p["length"]))
                    if h["WARC-Type"] == "response":
                        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
                        if f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                            raise ValueError(f"{name}: the payload at {p['at']} differs from its digest")
                    else:
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Bytes"])
                    refers = h.get("X-Refers-To-Page-Id")
                    page = h["X-Page-Id"]
                    rows.append((None if page == "None" else int(page), h["WARC-Target-URI"], h["WARC-Type"], digest, size, int(refers) if refers else None, body))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
        if f is not None:
            f.close()

    return places.select("archive", "at", "length").mapInArrow(run, schema)


def archive_and_read(
    pages: DataFrame, archive_bytes: int = 64_000_000, rows_a_task: int = 1_000, least: int = 0, key: str = "page_id", html: str = "html"
) -> DataFrame:
    """Write `pages` to archives in the shared folder and read every record back, neighbours in an archive together."""
    folder = f"{shared_dir(pages.sparkSession)}/tidegrid/warc-{uuid.uuid4().hex}"
    written = stash(write_archives(originals(pages, key, html, least), folder, archive_bytes), "archives")
    sizes = written.agg(F.count("*").alias("n"), F.sum("records").alias("rows")).first()
    places = list_records(written.repartition(max(1, sizes["n"]), "archive"))
    tasks = max(1, -(-(sizes["rows"] or 0) // rows_a_task))
    return read_records(places.repartition(tasks, "archive", F.shiftright("at", 22)).sortWithinPartitions("archive", "at"))
