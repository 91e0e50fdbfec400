"""Web archives packaged in ZIP files: written by tasks, read by ranges without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per WARC record) and ``indexes/index.cdx`` (one JSON line per record
with its offset and length), both stored uncompressed, so a record is a range of the package.

Writing.  Of pages with equal payloads the one with the largest id is the response and the others are revisits that refer to
it.  Payloads are compared by SHA-1 and length.  A batch keeps the payload of its largest id only before pages are
dealt out by digest: the others can only be revisits, which carry none, so a payload on a third of all pages crosses the shuffle
about once a batch.  The join to each digest's largest id has one row on the other side; the engine splits a hot digest.
Each task writes packages under names of its own and returns their paths as rows.  The table of these rows is
committed by Spark, so a lost or repeated task leaves at most files that no row names.

Reading.  Each package is a row of that table.  A task reads the end record, the ZIP64 end record where one is needed, the central
directory and the local header of each stored member; then the index, from which it makes ranges of neighbouring records.  Ranges are dealt out
again and read one at a time.  A package without an index is split at its gzip members.  Whatever cannot be read is a row with ``problem``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.session import cut, shared_folder

#: Compressed bytes of a package; one record more at most.
PACKAGE = 256 << 20
#: Bytes of neighbouring records read at once, and of a block where a member is split without an index.
RANGE, BLOCK = 4 << 20, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"

#: Signatures and lengths of the ZIP format (fixed values).
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
STORED, ENCRYPTED, ZIP64_FIELD = 0, 1, 1

MEMBERS = "package string, member string, method int, size long, stored long, start long, problem string"
RANGES = "package string, member string, start long, size long, problem string"
RECORDS = ("package string, start long, record_id string, record_type string, refers_to string, url string, payload_digest string, "
           "payload_bytes long, payload binary, problem string")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column (five hexadecimal digits are four of base 32)."""
    digits = F.upper(F.sha1(payload))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``id, url, payload, bytes, digest, refers_to`` of every row of ``id, url, payload``: ``refers_to`` is the id of the response that it revisits.

    Payloads of fewer than ``min_bytes`` bytes are never revisits, and rows without id neither refer nor are referred to.  Rows that
    share both id and payload are equal: all are responses if their id is the largest, or all revisits.  A revisit may have lost its payload.
    """
    sized = pages.select("id", "url", "payload", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))
    largest = sized.filter(F.col("id").isNotNull() & (F.col("bytes") >= min_bytes)).groupBy(F.col("digest").alias("d"), F.col("bytes").alias("b")).agg(F.max("id").alias("largest"))

    def thin(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, size, digest = (batch.column(k).to_pylist() for k in (0, 3, 4))
        best: dict[str, int] = {}
        for i, d in zip(ids, digest):
            if i is not None and i >= best.get(d, i):
                best[d] = i
        keep = pa.array([i is None or n < min_bytes or i == best[d] for i, n, d in zip(ids, size, digest)], pa.bool_())
        payload = pa.compute.if_else(keep, batch.column(2), pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), payload, *batch.columns[3:]], names=batch.schema.names)

    thinned = C.per_batch(sized, thin, ", ".join(f"{name} {kind}" for name, kind in sized.dtypes))
    joined = thinned.join(largest, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    refers = F.when(F.col("id").isNotNull() & (F.col("bytes") >= min_bytes) & (F.col("id") != F.col("largest")), F.col("largest"))
    return joined.select("id", "url", "payload", "bytes", "digest", refers.alias("refers_to"))


def record_name(key: int | None, digest: str) -> str:
    """The record id of a page: its id and payload digest."""
    return f"<urn:page:{'' if key is None else key}:{digest}>"


def page_of(name: str | None) -> int | None:
    """The page id in a record id."""
    key = (name or "").strip("<>").split(":")[2:3]
    return int(key[0]) if key and key[0] else None


def record(key: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP head of the full response and no body."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"") if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(key, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_name(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Package:
    """A package being written: records go to the file at once, only index lines stay in memory."""

    def __init__(self, folder: str) -> None:
        system, root = fs.FileSystem.from_uri(folder)
        name = f"package-{uuid.uuid4().hex}.wacz"
        self.path = f"{folder}/{name}"
        self.out = system.open_output_stream(f"{root}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, key: int | None, digest: str, data: bytes) -> None:
        self.member.write(data)
        self.lines.append(json.dumps({"id": record_name(key, digest), "offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(f"{line}\n" for line in self.lines))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.at


def write(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = PACKAGE) -> DataFrame:
    """Packages of all rows of ``id, url, payload`` in ``folder`` (on storage that every executor reaches): ``package, records, bytes``.

    A null payload is an empty one.  Every row is one record.  An empty table gives no package.
    """
    rows = decided(pages.select("id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")), min_bytes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for key, url, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                package = package or Package(folder)
                package.add(key, digest, gzip_member(record(key, url, payload, size, digest, refers_to)))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["package", "records", "bytes"])

    return cut(rows.mapInArrow(work, "package string, records long, bytes long"), "packages")


class Unreadable(Exception):
    """What a package's bytes cannot give."""


def _part(source, start: int, size: int) -> bytes:
    source.seek(start)
    data = source.read(size)
    if len(data) < size:
        raise Unreadable(f"ends before {start + size}")
    return data


def _end_record(source, length: int) -> tuple[int, int, int, int]:
    """Start and size of the central directory, its number of entries, and the bytes before the first member."""
    tail_at = max(0, length - END_SIZE - FULL16)
    tail = _part(source, tail_at, length - tail_at)
    spot = tail.rfind(END)
    while spot >= 0 and (len(tail) < spot + END_SIZE or spot + END_SIZE + struct.unpack_from("<H", tail, spot + 20)[0] != len(tail)):
        spot = tail.rfind(END, 0, spot)
    if spot < 0:
        raise Unreadable("no end record")
    entries, size, start = struct.unpack_from("<HII", tail, spot + 10)
    at = tail_at + spot
    locator = _part(source, at - LOCATOR_SIZE, LOCATOR_SIZE) if at >= LOCATOR_SIZE else b""
    if locator[:4] == LOCATOR:
        place = struct.unpack_from("<Q", locator, 8)[0]
        # Bytes before the package move the end record away from where its locator says.
        for at64 in (place, at - LOCATOR_SIZE - END64_SIZE):
            if 0 <= at64 <= length - END64_SIZE and (found := _part(source, at64, END64_SIZE))[:4] == END64:
                entries, size, start = struct.unpack_from("<QQQ", found, 32)
                at = at64
                break
        else:
            raise Unreadable("no ZIP64 end record")
    elif entries == FULL16 or FULL32 in (size, start):
        raise Unreadable("no ZIP64 locator")
    if at - size - start < 0:
        raise Unreadable("the central directory lies outside the file")
    return at - size, size, entries, at - size - start


def _wide(extra: bytes, values: list[int], limits: list[int]) -> list[int]:
    """The fields of an entry, those at their limit taken from its ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            wide = [struct.unpack_from("<Q", extra, k)[0] for k in range(at + 4, min(at + 4 + size, len(extra)) - 7, 8)]
            return [wide.pop(0) if value == limit and wide else value for value, limit in zip(values, limits)]
        at += 4 + size
    return values


def directory(source, length: int) -> Iterator[tuple[str, int, int, int, int, str | None]]:
    """``member, method, size, stored size, start of its bytes, problem`` of each entry of a package, in the directory's order."""
    start, size, entries, shift = _end_record(source, length)
    body, at = _part(source, start, size), 0
    for _ in range(entries):
        if body[at:at + 4] != ENTRY or at + ENTRY_SIZE > len(body):
            raise Unreadable(f"no directory entry at {start + at}")
        flags, method = struct.unpack_from("<HH", body, at + 8)
        stored, full, n, m, k = struct.unpack_from("<IIHHH", body, at + 20)
        offset = struct.unpack_from("<I", body, at + 42)[0]
        name = body[at + ENTRY_SIZE:at + ENTRY_SIZE + n].decode("utf-8", "replace")
        full, stored, offset = _wide(body[at + ENTRY_SIZE + n:at + ENTRY_SIZE + n + m], [full, stored, offset], [FULL32] * 3)
        at += ENTRY_SIZE + n + m + k
        local = _part(source, offset + shift, LOCAL_SIZE) if offset + shift + LOCAL_SIZE <= length else b""
        if local[:4] != LOCAL:
            yield name, method, full, stored, -1, "no local header"
            continue
        first = offset + shift + LOCAL_SIZE + sum(struct.unpack_from("<HH", local, 26))
        problem = "encrypted" if flags & ENCRYPTED else "ends after the file" if first + stored > length else None
        yield name, method, full, stored, first, problem


def _opened(path: str):
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def members(packages: DataFrame) -> DataFrame:
    """``package, member, method, size, stored, start, problem``: the central directories of all packages (column ``package``).

    A package that cannot be read is one row without member.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path in batch.column(0).to_pylist():
            rows = []
            try:
                with _opened(path) as source:
                    rows = [(path, *entry) for entry in directory(source, source.size())]
            except (Unreadable, OSError, TypeError, ValueError, struct.error) as why:
                rows.append((path, None, None, None, None, None, str(why)))
            yield _rows(rows, MEMBERS)

    return C.per_batch(_spread(packages.select("package")), work, MEMBERS)


def _spread(rows: DataFrame) -> DataFrame:
    """Small rows that stand for much work, dealt to many tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _joined_ranges(places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Neighbouring ``(start, size)`` joined to about ``RANGE`` bytes."""
    begin = end = None
    for start, size in sorted(set(places)):
        if begin is not None and start <= end and start + size - begin <= RANGE:
            end = max(end, start + size)
            continue
        if begin is not None:
            yield begin, end - begin
        begin, end = start, start + size
    if begin is not None:
        yield begin, end - begin


def _boundaries(source, start: int, size: int) -> Iterator[tuple[int, int]]:
    """The gzip members between ``start`` and ``start + size``, found by unpacking block by block."""
    at, stop, begin, packer = start, start + size, start, zlib.decompressobj(31)
    while at < stop:
        data = _part(source, at, min(BLOCK, stop - at))
        at += len(data)
        while data:
            packer.decompress(data)
            if not packer.eof:
                break
            data = packer.unused_data
            yield begin, at - len(data) - begin
            begin, packer = at - len(data), zlib.decompressobj(31)
    if begin < stop:
        raise Unreadable("the last record is cut off")


def ranges(found: DataFrame) -> DataFrame:
    """``package, member, start, size, problem``: runs of whole records of the stored archive members among ``members``.

    Taken from the package's stored index where it has a sound one, else from the member itself.  A member that is not stored cannot be
    read by ranges and is a row with a problem, as is an unreadable package; other members give none.
    """
    packed = found.groupBy("package").agg(F.collect_list(F.struct("member", "method", "stored", "start", "problem")).alias("members"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [(path, e["member"], None, None, e["problem"]) for e in entries if e["problem"] and (e["member"] is None or e["member"].startswith("archive/"))]
            sound = [e for e in entries if not e["problem"]]
            index = [e for e in sound if e["member"].startswith("indexes/") and e["member"].endswith(".cdx") and e["method"] == STORED]
            data = [e for e in sound if e["member"].startswith("archive/") and e["member"].endswith((".warc.gz", ".warc"))]
            for e in data:
                if e["method"] != STORED or not e["member"].endswith(".gz"):
                    rows.append((path, e["member"], None, None, "not stored as separate records"))
            data = [e for e in data if e["method"] == STORED and e["member"].endswith(".gz")]
            if data:
                with _opened(path) as source:
                    places = _listed(source, index, data) if len(data) == 1 else None
                    for e in data:
                        try:
                            own = places if places is not None else list(_boundaries(source, e["start"], e["stored"]))
                            rows += [(path, e["member"], a, n, None) for a, n in _joined_ranges(own)]
                        except (Unreadable, zlib.error) as why:
                            rows.append((path, e["member"], None, None, str(why)))
            if rows:
                yield _rows(rows, RANGES)

    return C.per_batch(packed, work, RANGES)


def _listed(source, index: list[dict], data: list[dict]) -> list[tuple[int, int]] | None:
    """Absolute places of the records by the index; None if it is missing or does not cover the member end to end."""
    places = []
    for e in index:
        try:
            lines = [json.loads(line) for line in _part(source, e["start"], e["stored"]).splitlines() if line.strip()]
            places += [(data[0]["start"] + int(one["offset"]), int(one["length"])) for one in lines]
        except (Unreadable, ValueError, KeyError, TypeError):
            return None
    at = data[0]["start"]
    for start, size in sorted(places):
        if start != at or size <= 0:
            return None
        at += size
    return places if at == data[0]["start"] + data[0]["stored"] and places else None


def parse(data: bytes) -> tuple[str | None, ...]:
    """``record_id, record_type, refers_to, url, payload_digest, payload_bytes, payload, problem`` of one unpacked record.

    The digest is that of the payload itself; a revisit's and both lengths come from the heads.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not gap or not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
        return None, None, None, None, None, None, None, "no record head"
    body = rest[:int(fields["content-length"])]
    if len(body) < int(fields["content-length"]):
        return fields.get("warc-record-id"), fields.get("warc-type"), None, fields.get("warc-target-uri"), None, None, None, "the record is cut off"
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next((int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length" and v.strip().isdigit()), None)
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind, problem = fields.get("warc-type"), None
    if kind == "revisit":
        payload, digest = None, given
    else:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        problem = "the payload differs from its digest" if given not in (None, digest) else "the payload differs from its length" if size not in (None, len(payload)) else None
        size = len(payload)
    return fields.get("warc-record-id"), kind, fields.get("warc-refers-to"), fields.get("warc-target-uri"), digest, size, payload, problem


def records(found: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of ``ranges``, read range by range; a range with a problem is one row with it.

    ``payloads`` False leaves the payloads out of the result; they are read and compared with their digests all the same.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for path, _, start, size, problem in zip(*(c.to_pylist() for c in batch.columns)):
            rows = []
            if problem is not None:
                rows.append((path, start, *[None] * 7, problem))
            else:
                try:
                    with _opened(path) as source:
                        data, at = memoryview(_part(source, start, size)), start
                    while len(data):
                        packer = zlib.decompressobj(31)
                        one = packer.decompress(data)
                        if not packer.eof:
                            raise Unreadable("the record is cut off")
                        name, kind, refers, url, digest, n, payload, why = parse(one)
                        rows.append((path, at, name, kind, refers, url, digest, n, payload if payloads else None, why))
                        at += len(data) - len(packer.unused_data)
                        data = memoryview(packer.unused_data)
                except (Unreadable, OSError, zlib.error) as why:
                    rows.append((path, start, *[None] * 7, str(why)))
            yield _rows(rows, RECORDS)

    return C.per_batch(_spread(found), work, RECORDS)


def read(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages (column ``package``, a path or URI): columns ``RECORDS``.  No package gives no row."""
    return records(ranges(members(packages)), payloads)


def round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, package_bytes: int = PACKAGE) -> DataFrame:
    """Pages (``page_id, url, html``; others are ignored) written to packages and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, problem``.

    One row per page; null html is empty, null and repeated ids stay (see ``decided``).  ``folder`` is by default a new one in the session's shared folder.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/packages-{uuid.uuid4().hex}"
    made(folder)
    written = write(pages.select(F.col("page_id").alias("id"), "url", F.encode("html", "utf-8").alias("payload")), folder, min_bytes, package_bytes)

    def name(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, other = (pa.array([page_of(x) for x in batch.column(k).to_pylist()], pa.int64()) for k in (0, 4))
        yield pa.RecordBatch.from_arrays([own, batch.column(1), batch.column(2), batch.column(3), other, batch.column(5)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"])

    got = read(written, payloads=False).select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    return C.per_batch(got, name, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string")


def made(folder: str) -> None:
    """Create the folder where its file system has folders."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
