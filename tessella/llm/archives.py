"""Web archives in ZIP packages: WARC records written, located through directories and indexes, and range-read.

A package is a ZIP file of stored (never compressed) members, so that any byte of
a member lies at a known place of the package:

    archive/data.warc.gz    WARC/1.1 records, each a gzip member of its own
    indexes/index.cdxj      a line per record: offset, length and what the record is
    datapackage.json        names and sizes of both

The writer streams: sizes and checksums follow each member in a ZIP64 data
descriptor and stand in the central directory. The reader takes a package of any
origin: it finds the end record (with a comment too), follows the ZIP64 locator
where it is needed, reads the central directory and the local headers, and asks
for stored members' bytes by range. Nothing is extracted. A package that can't be
read is a row with an error.

Listing, indexes and records are three steps: a task lists packages, a task reads
an index line by line, and the record ranges, a few dozen bytes each, are dealt to
tasks by package and place, so that one large package is many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import bound_batches, kept, new_folder, small
from tessella.llm.workers import tidy

#: Fixed values of the ZIP format: signatures of its records, and the marks for "see the ZIP64 field".
LOCAL, DESCRIPTOR, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x08074B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
WIDE16, WIDE32 = 0xFFFF, 0xFFFFFFFF
#: The longest comment after the end record.
_TAIL = 22 + WIDE16
#: Version 4.5, streamed member (bit 3) with a UTF-8 name (bit 11), 1 January 1980.
_VERSION, _FLAGS, _DAY = 45, 0x0808, 0x21

RECORDS, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of so many bytes at least are stored once.
LEAST_BYTES = 0
#: Bytes of a package that a task reads at a time, and of ranges that are read together.
RANGE_BYTES = 16 << 20
#: Bytes of packages behind the ranges of one task, on average.
TASK_BYTES = 32 << 20
LEVEL = 6


# ZIP -----------------------------------------------------------------------------------------------------------------


class Package:
    """Writes a ZIP file of stored members to a stream that can't seek; holds a few bytes a member."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        # Sizes are told later; the ZIP64 field says that they take 8 bytes.
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, _VERSION, _FLAGS, 0, 0, _DAY, 0, WIDE32, WIDE32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, raw: bytes) -> None:
        self.open[2], self.open[3] = zlib.crc32(raw, self.open[2]), self.open[3] + len(raw)
        self._put(raw)

    def end(self) -> None:
        name, at, crc, size = self.open
        self._put(struct.pack("<IIQQ", DESCRIPTOR, crc, size, size))
        self.members.append((name, at, crc, size))

    def finish(self) -> None:
        start = self.at
        for name, at, crc, size in self.members:
            self._put(
                struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, _VERSION, _VERSION, _FLAGS, 0, 0, _DAY, crc, WIDE32, WIDE32, len(name), 28, 0, 0, 0, 0, WIDE32)
                + name + struct.pack("<HHQQQ", 1, 24, size, size, at)
            )
        n, size, at64 = len(self.members), self.at - start, self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, _VERSION, _VERSION, 0, 0, n, n, size, start) + struct.pack("<IIQI", LOCATOR, 0, at64, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, min(n, WIDE16), min(n, WIDE16), min(size, WIDE32), min(start, WIDE32), 0))


def _read(stream, at: int, n: int) -> bytes:
    if at < 0 or n < 0:
        raise ValueError("a range before the file")
    stream.seek(at)
    raw = stream.read(n)
    if len(raw) != n:
        raise ValueError("the file ends early")
    return raw


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """The values, those that are all ones taken from the ZIP64 field in their order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            found = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(found) if v == WIDE32 else v for v in values]
        at += 4 + n
    if WIDE32 in values:
        raise ValueError("a ZIP64 field is missing")
    return values


def directory(stream, size: int) -> list[dict]:
    """(name, method, stored, size, crc, at) of the members of a ZIP file, at being where the member's bytes begin."""
    tail_at = max(0, size - _TAIL)
    tail = _read(stream, tail_at, size - tail_at)
    mark, k = struct.pack("<I", END), len(tail)
    while True:
        k = tail.rfind(mark, 0, k)
        if k < 0:
            raise ValueError("not a ZIP file")
        # The comment must end the file, else the mark is part of something else.
        if k + 22 <= len(tail) and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
            break
    n, length, start = struct.unpack_from("<HII", tail, k + 10)
    end_at = tail_at + k
    shift = end_at - start - length
    if end_at >= 20:
        sign, _, at64, _ = struct.unpack("<IIQI", _read(stream, end_at - 20, 20))
        if sign == LOCATOR:
            sign, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", _read(stream, at64, 56))
            if sign != END64:
                raise ValueError("no ZIP64 end record where the locator points")
            shift = 0
    if shift < 0:
        raise ValueError("the central directory is cut off")
    raw, at, found = _read(stream, start + shift, length), 0, []
    for _ in range(n):
        fields = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if fields[0] != CENTRAL:
            raise ValueError("a central record is broken")
        method, crc, stored, whole, names, extras, comments, header = fields[4], *fields[7:13], fields[16]
        name = raw[at + 46 : at + 46 + names].decode("utf-8", "replace")
        extra = raw[at + 46 + names : at + 46 + names + extras]
        whole, stored, header = _wide(extra, [whole, stored, header])
        at += 46 + names + extras + comments
        local = struct.unpack("<IHHHHHIIIHH", _read(stream, header + shift, 30))
        if local[0] != LOCAL:
            raise ValueError(f"no local header for {name}")
        found.append({"name": name, "method": method, "stored": stored, "size": whole, "crc": crc, "at": header + shift + 30 + local[9] + local[10]})
    return found


# WARC ----------------------------------------------------------------------------------------------------------------


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_id(page: str | None, digest: str) -> str:
    """A URI for a page's record: the same for the same page and payload."""
    return f"urn:page:{'' if page is None else quote(page, safe='')}:{digest}"


def warc_record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record of another page's equal payload; the HTTP head of both tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{record_id(page, digest)}>")]
    if url is not None:
        # A header is one line of visible characters.
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    head += [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
        payload = b""
    head.append(("Content-Length", str(len(http) + len(payload))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record, unpacked."""
    edge = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or edge < 0:
        raise ValueError("not a WARC record")
    lines = raw[:edge].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(headers.get("content-length", ""))
    block = raw[edge + 4 : edge + 4 + n]
    if len(block) != n:
        raise ValueError("a record is cut off")
    return headers, block


def http_payload(block: bytes) -> bytes:
    """What follows the HTTP head of a record's block."""
    edge = block.find(b"\r\n\r\n")
    return block[edge + 4 :] if edge >= 0 else b""


def unpacked(raw: bytes) -> bytes:
    """A record's bytes: of a gzip member, or as they are."""
    return zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw


# Spark ---------------------------------------------------------------------------------------------------------------


def _firsts(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(first_digest, first_size, first) of the payloads that several pages hold: first is the smallest id."""
    found = pages.where(F.col("size") >= least_bytes).groupBy(F.col("digest").alias("first_digest"), F.col("size").alias("first_size"))
    return found.agg(F.min("page").alias("first"), F.count("*").alias("pages")).where("pages > 1 and first is not null").drop("pages")


def write_packages(
    pages: DataFrame, out_dir: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """Write a WARC record for each row of pages into packages of out_dir (a folder all executors share); returns their manifest.

    Manifest: (file, folder, records, bytes), a package a partition of pages. Of
    equal payloads of least_bytes or more, rows with the smallest id are responses
    and the others revisit it, rows without an id too; payloads that only such rows
    hold are all responses. Null payloads count as empty, null URLs have no header.
    A package's name tells its job and attempt; the manifest names those that count.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    out_dir, job = out_dir or new_folder(spark, "packages"), uuid.uuid4().hex
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    named = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    hashed = named.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    firsts = kept(_firsts(hashed.select("page", "digest", "size"), least_bytes), "firsts")
    same = (F.col("digest") == F.col("first_digest")) & (F.col("size") == F.col("first_size"))
    told = hashed.join(small(firsts), same, "left").select(
        F.col("page").cast("string").alias("page"), "url", "html", "digest",
        F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("refers_to"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(out_dir)
        name, package, stream, index = f"{root}/{job}-{uuid.uuid4().hex}.wacz", None, None, []
        for batch in batches:
            if package is None and batch.num_rows:
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(name)
                package = Package(stream)
                package.begin(RECORDS)
            for page, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base32_sha1(digest)
                target = None if refers_to is None else record_id(refers_to, digest)
                press = zlib.compressobj(LEVEL, wbits=31)
                raw = press.compress(warc_record(page, url, html.encode(), digest, target)) + press.flush()
                index.append((package.open[3], len(raw)))
                package.write(raw)
        if package is None:
            return
        package.end()
        package.begin(INDEX)
        for offset, length in index:
            package.write(json.dumps({"offset": offset, "length": length, "filename": RECORDS}).encode() + b"\n")
        package.end()
        package.begin(PACKAGE)
        package.write(json.dumps({"profile": "data-package", "resources": [{"path": m[0].decode(), "bytes": m[3]} for m in package.members]}).encode())
        package.end()
        package.finish()
        stream.close()
        yield pa.RecordBatch.from_pylist([{"file": name, "folder": out_dir, "records": len(index), "bytes": package.at}])

    return kept(told.mapInArrow(tidy(run), "file string, folder string, records long, bytes long"), "manifest")


_LISTED = "file string, folder string, bytes long, member string, at long, stored long, error string"
_RANGES = "file string, folder string, at long, length long, error string"


def list_members(packages: DataFrame) -> DataFrame:
    """(file, folder, bytes, member, at, stored, error): the members of each package (file, folder, bytes).

    at is where a member's bytes begin. Members that aren't stored as they are, and packages that can't be read, have an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = {"file": row["file"], "folder": row["folder"], "bytes": row["bytes"], "member": None, "at": None, "stored": None, "error": None}
                try:
                    fs, _ = pafs.FileSystem.from_uri(row["folder"])
                    with fs.open_input_file(row["file"]) as stream:
                        found = directory(stream, row["bytes"])
                    out = [own | {"member": m["name"], "at": m["at"], "stored": m["stored"], "error": f"method {m['method']}" if m["method"] else None} for m in found]
                except (OSError, ValueError, struct.error, StopIteration, RuntimeError) as e:
                    out = [own | {"error": f"{type(e).__name__}: {e}"[:200]}]
                yield pa.RecordBatch.from_pylist(out, _schema(_LISTED))

    return packages.select("file", "folder", "bytes").mapInArrow(tidy(run), _LISTED)


def record_ranges(members: DataFrame, records: str = RECORDS) -> DataFrame:
    """(file, folder, at, length, error): each record's bytes in its package, from the packages' stored indexes.

    Index lines are read RANGE_BYTES at a time. Lines that name another member than `records` are errors, as are ranges beyond it.
    """
    data = F.max(F.when(F.col("member") == records, F.struct("at", "stored"))).alias("data")
    lists = members.where("error is null").groupBy("file", "folder").agg(data, F.max(F.when(F.col("member") == INDEX, F.struct("at", "stored"))).alias("list"))
    told = lists.select("file", "folder", F.col("data.at").alias("at"), F.col("data.stored").alias("stored"), F.col("list.at").alias("list_at"), F.col("list.stored").alias("list_stored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = {"file": row["file"], "folder": row["folder"], "at": None, "length": None, "error": None}
                if row["at"] is None or row["list_at"] is None:
                    yield pa.RecordBatch.from_pylist([own | {"error": "no records or no index"}], _schema(_RANGES))
                    continue
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                with fs.open_input_file(row["file"]) as stream:
                    for lines in _lines(stream, row["list_at"], row["list_stored"]):
                        out = [own | _range(line, row["at"], row["stored"], records) for line in lines if line.strip()]
                        yield pa.RecordBatch.from_pylist(out, _schema(_RANGES))

    broken = members.where("error is not null").select("file", "folder", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length"), "error")
    return told.mapInArrow(tidy(run), _RANGES).union(broken)


def _lines(stream, at: int, size: int) -> Iterator[list[bytes]]:
    rest, end = b"", at + size
    while at < end:
        n = min(RANGE_BYTES, end - at)
        lines = (rest + _read(stream, at, n)).split(b"\n")
        at, rest = at + n, lines.pop()
        yield lines
    yield [rest]


def _range(line: bytes, at: int, stored: int, records: str) -> dict:
    """The range that an index line names. CDXJ lines may have a key before the JSON."""
    try:
        entry = json.loads(line[line.index(b"{") :])
        offset, length = int(entry["offset"]), int(entry["length"])
        if not (0 <= offset and 0 < length and offset + length <= stored and entry.get("filename", records).rsplit("/", 1)[-1] == records.rsplit("/", 1)[-1]):
            raise ValueError("outside of the records")
        return {"at": at + offset, "length": length}
    except (ValueError, KeyError, TypeError) as e:
        return {"error": f"index line: {type(e).__name__}: {e}"[:200]}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


_READ = "record string, refers string, type string, url string, digest string, size long, sha1 string, payload binary, error string"


def read_records(ranges: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """(record, refers, type, url, digest, size, sha1, payload, error), a row for each range.

    digest is what the record says of its payload; sha1 (base32) and size are those
    of the payload's bytes, null for revisits, which hold none. payload is null
    unless asked for. Ranges are dealt by package and place to so many tasks, and
    neighbours are read together; without a number Spark goes by the ranges' own
    bytes, which tell little of what is behind them.
    """
    bound_batches(ranges.sparkSession)
    block = F.floor(F.col("at") / range_bytes)
    keyed = ranges.withColumn("block", block)
    dealt = (keyed.repartition(tasks, "file", "block") if tasks else keyed.repartition("file", "block")).sortWithinPartitions("file", "at").select("file", "folder", "at", "length", "error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            while k < len(rows):
                row = rows[k]
                if row["error"] is not None:
                    yield pa.RecordBatch.from_pylist([{"error": row["error"]}], _schema(_READ))
                    k += 1
                    continue
                if opened != row["file"]:
                    if stream is not None:
                        stream.close()
                    fs, _ = pafs.FileSystem.from_uri(row["folder"])
                    opened, stream = row["file"], fs.open_input_file(row["file"])
                many = k + 1
                while many < len(rows) and rows[many]["file"] == opened and rows[many]["error"] is None and rows[many]["at"] + rows[many]["length"] <= row["at"] + range_bytes:
                    many += 1
                try:
                    raw = memoryview(_read(stream, row["at"], max(r["at"] + r["length"] for r in rows[k:many]) - row["at"]))
                    out = [_record(bytes(raw[r["at"] - row["at"] :][: r["length"]]), payloads) for r in rows[k:many]]
                except ValueError as e:
                    out = [{"error": f"range: {e}"} for _ in rows[k:many]]
                yield pa.RecordBatch.from_pylist(out, _schema(_READ))
                k = many
        if stream is not None:
            stream.close()

    return dealt.mapInArrow(tidy(run), _READ)


def _record(raw: bytes, payloads: bool) -> dict:
    try:
        headers, block = parse_record(unpacked(raw))
    except (ValueError, zlib.error) as e:
        return {"error": f"record: {type(e).__name__}: {e}"[:200]}
    kind = headers.get("warc-type")
    found = {
        "record": headers.get("warc-record-id", "").strip("<>"), "refers": headers.get("warc-refers-to", "").strip("<>") or None, "type": kind,
        "url": headers.get("warc-target-uri"), "digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "size": None, "sha1": None, "payload": None, "error": None,
    }
    if kind == "response":
        payload = http_payload(block)
        found |= {"size": len(payload), "sha1": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload if payloads else None}
        if found["digest"] not in (None, found["sha1"]):
            found["error"] = "the payload has another digest"
    return found


def _page_of(record: str | Column, kind: str) -> Column:
    """The page's id in a record's URI."""
    return F.nullif(F.url_decode(F.split_part(F.col(record), F.lit(":"), F.lit(3))), F.lit("")).cast(kind)


def archive_digest(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES, out_dir: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error), a row for each row of pages, read back from packages.

    A revisit's length and digest are those of the payload that it refers to: the
    response's, found by its record. See write_packages for what is stored.
    An empty table makes no package and gives no rows.
    """
    manifest = write_packages(pages, out_dir, id_col, url_col, payload_col, least_bytes)
    tasks = max(1, (manifest.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES)
    found = kept(read_records(record_ranges(list_members(manifest)), payloads=False, tasks=tasks), "records")
    kind = pages.schema[id_col].dataType.simpleString()
    full = found.where("type = 'response'").groupBy(F.col("record").alias("target")).agg(F.max("size").alias("full_size"), F.max("sha1").alias("full_sha1"))
    revisited = found.where("type = 'revisit'").select(F.col("refers").alias("target")).distinct()
    full = kept(full.join(revisited, "target"), "revisited")
    return found.join(small(full), found["refers"] == full["target"], "left").select(
        _page_of("record", kind).alias(id_col), F.coalesce("size", "full_size").alias("payload_bytes"), F.coalesce("sha1", "full_sha1").alias("payload_digest"),
        F.col("type").alias("record_type"), _page_of("refers", kind).alias("refers_to"),
        F.coalesce("error", F.when((F.col("type") == "revisit") & F.col("full_size").isNull(), F.lit("its response is missing"))).alias("error"),
    )
