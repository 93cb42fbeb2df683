"""WARC records in ZIP-packaged archives: written, then read by ranges without extraction.

An archive is a ZIP file with stored members: WARC files below archive/, plain or with a gzip member for each record, and CDXJ
indexes below indexes/, plain or gzipped, whose lines name a file and a record's offset and length in it. The reader
parses the end-of-directory record, its ZIP64 form and the central directory, locates all stored members, reads all
indexes, and then fetches single records by their byte ranges, dealt out over all workers.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import materialize, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payloads from this size are stored once; a record with the same payload refers to the first.
REVISIT_FROM = 100
_ID = "<urn:loadlens:page:{}>"


# Writing

def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without payload, whose HTTP header tells the length of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_ID.format(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def cdxj_line(url: str | None, filename: str, offset: int, length: int, digest: str) -> str:
    """Key of the address (host reversed, path), time, and where the record is."""
    host, _, path = (url or "").partition("://")[2].lower().partition("/")
    key = "".join(c if c > " " else f"%{ord(c):02x}" for c in ",".join(reversed(host.split("."))) + ")/" + path)
    return f"{key} 19700101000000 " + json.dumps({"url": url or "", "digest": f"sha256:{digest}", "length": str(length), "offset": str(offset), "filename": filename})


class _Archive:
    """An archive being written. Its name is new for each attempt of a task, so a retry never meets an earlier one."""

    def __init__(self, root: str):
        self.path = f"{root}/{uuid.uuid4().hex}.wacz"
        system, inside = pafs.FileSystem.from_uri(self.path)
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inside)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(DATA, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, url: str | None, digest: str, record: bytes) -> None:
        packed = _gzip(record)
        self.member.write(packed)
        self.lines.append(cdxj_line(url, DATA.rpartition("/")[2], self.at, len(packed), digest))
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(sorted(self.lines)) + "\n")
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def _write(root: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, digest, refers = (c[i].as_py() for c in batch.columns)
                archive = archive or _Archive(root)
                archive.add(url, digest, warc_record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers))
                if archive.at >= archive_bytes:
                    done, archive = [*done, archive.close()], None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": pa.array([n for _, n in done], pa.int64())})

    return run


def write_archives(pages: DataFrame, root: str, archive_bytes: int = 64_000_000) -> DataFrame:
    """Write pages (page_id, url, html) to archives below root; (path, records) of those that tasks completed.

    root is a folder that all workers share. Of records with equal payloads of at least REVISIT_FROM bytes, those with the
    smallest page_id are responses and the others revisits of it; a null html is an empty payload. Workers hold one record
    and the index of one archive. Files of failed attempts are in no result and are not read. Rows with a null or repeated
    page_id have records of their own; an empty table gives no archive; other columns are ignored.
    """
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    full = full.withColumn("digest", F.sha2("html", 256)).withColumn("shared", F.when(F.octet_length("html") >= REVISIT_FROM, F.col("digest")))
    first = full.where("shared is not null").groupBy("shared").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = full.join(first, "shared", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return materialize(ready.mapInArrow(_write(root, archive_bytes), "path string, records long"), "archives")


# Reading

@dataclass(frozen=True)
class Member:
    """A stored member: where its bytes begin in the archive, and how many there are."""

    name: str
    start: int
    size: int


def _u(form: str, data: bytes, at: int) -> tuple[int, ...]:
    return struct.unpack_from("<" + form, data, at)


def members(read_at, size: int) -> dict[str, Member]:
    """The stored members of a ZIP file of this size; read_at(offset, length) gives bytes. ZIP64 is understood.

    A file without an end-of-directory record or with a damaged directory raises ValueError. Compressed and encrypted
    members are left out: their bytes cannot be read by ranges.
    """
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) - end < 22 or end + 22 + _u("H", tail, end + 20)[0] > len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = _u("HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at64,) = _u("Q", tail, end - 12)
        record = read_at(at64, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = _u("QQQ", record, 32)
    directory = read_at(start, length)
    found, at = {}, 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = _u("HH", directory, at + 8)
        packed, unpacked, n_name, n_extra, n_comment = _u("IIHHH", directory, at + 20)
        (local,) = _u("I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = _u("HH", extra, k)
            if tag == 1:  # only the fields that overflowed are there, in this order
                wide = iter(_u(f"{n // 8}Q", extra, k + 4))
                unpacked = next(wide) if unpacked == 0xFFFFFFFF else unpacked
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + n
        at += 46 + n_name + n_extra + n_comment
        if method == 0 and not flags & 1:
            head = read_at(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("damaged local header")
            found[name] = Member(name, local + 30 + sum(_u("HH", head, 26)), packed)
    return found


def _unpacked(data: bytes) -> bytes:
    """data, or what its gzip members hold."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) if out else data


def index_entries(inside: dict[str, Member], read_at) -> list[tuple[int, int]]:
    """(place in the archive, length) of each record that the indexes name, in all WARC members; each record once.

    An archive without members below archive/ or indexes/, a line of a file that is not there, and a file that no line names
    raise ValueError."""
    files = {n.removeprefix("archive/"): m for n, m in inside.items() if n.startswith("archive/") and n.lower().endswith((".warc", ".warc.gz"))}
    indexes = [m for n, m in sorted(inside.items()) if n.startswith("indexes/") and n.lower().endswith((".cdxj", ".cdxj.gz", ".cdx", ".cdx.gz"))]
    if not files or not indexes:
        raise ValueError("no stored WARC member below archive/" if not files else "no stored index below indexes/")
    found, named = set(), set()
    for index in indexes:
        for line in _unpacked(read_at(index.start, index.size)).decode().splitlines():
            _, brace, rest = line.partition("{")
            if not brace or line.startswith("!"):
                continue  # a header line, or none
            entry = json.loads(brace + rest)
            name = entry["filename"].removeprefix("archive/")
            if name not in files:
                raise ValueError(f"the index names {name}, which is not there")
            named.add(name)
            found.add((files[name].start + int(entry["offset"]), int(entry["length"])))
    if missing := files.keys() - named:
        raise ValueError(f"no index names {min(missing)}")
    return sorted(found)


def parse_record(packed: bytes) -> dict:
    """type, page_id, refers_to, payload (None in revisits), payload_bytes and digest of one record, gzipped or plain."""
    data = _unpacked(packed)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
    number = lambda k: int(n) if (n := fields.get(k, "").removesuffix(">").rpartition(":")[2]) else None
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response" and (len(payload) != told or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("damaged payload")
    return {"page_id": number("warc-record-id"), "payload_bytes": told, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": number("warc-refers-to"), "payload": payload if fields["warc-type"] == "response" else None}


class _Reader:
    def __init__(self, path: str):
        system, inside = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inside)

    def __call__(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            read = _Reader(path)
            inside = members(read, read.file.size())
            places = index_entries(inside, read)
            read.file.close()
            if places:
                yield pa.RecordBatch.from_pydict({"path": [path] * len(places), "at": [p for p, _ in places], "length": [n for _, n in places]})


def _fetch(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, read = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if read:
                        read.file.close()
                    path, read = row["path"], _Reader(row["path"])
                rows.append(parse_record(read(row["at"], row["length"])))
            columns = {k: pa.array([r[k] for r in rows], t) for k, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))}
            if keep_payload:
                columns["payload"] = pa.array([r["payload"] for r in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def read_archives(archives: DataFrame, keep_payload: bool = False) -> DataFrame:
    """One row per record of the archives (path): page_id, payload_bytes, payload_digest, record_type, refers_to and, if
    asked for, payload. Archives may have several WARC members and indexes under any names; see index_entries. A payload that
    does not match its digest raises; an empty table of archives gives no records, and a path named twice is read twice.
    Other columns are ignored."""
    places = archives.select("path").mapInArrow(_locate, "path string, at long, length long")
    # ranges of about 16 MB of an archive are read together, in order
    dealt = places.withColumn("stretch", F.floor(F.col("at") / 16_000_000)).repartition("path", "stretch").sortWithinPartitions("path", "at").select("path", "at", "length")
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload
    return dealt.mapInArrow(_fetch(keep_payload), kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages (page_id, url, html) to archives in the cluster's shared folder and read all records back."""
    root = scratch_path(pages.sparkSession, "wacz")
    return read_archives(write_archives(pages, root))
