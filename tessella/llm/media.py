"""ISO base media files in a binary column: boxes, sample tables, keyframe byte ranges.

index_media() walks the boxes of each file and decodes the sample tables of its
tracks, and the runs of fragments. Payload bytes are never decoded; they are only
named by offset and size.
pack_text() makes such a file of a text: frames of 64 8-bit samples, stored raw.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrowtext import gathered, text_array
from tessella.llm.shared import bound_batches, new_folder
from tessella.llm.workers import tidy

FRAME = 64
RATE = 25
#: Every so many frames of a packed text is a keyframe; a chunk holds so many frames.
KEY_EVERY = 16
CHUNK_FRAMES = 256
#: Boxes that hold boxes (fixed values of the format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Nesting beyond this is malformed.
DEPTH = 16


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack_payload(payload: bytes) -> bytes:
    """A media file whose one track holds payload, frame by frame (8 x 8 samples of 8 bits)."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("payload isn't a positive multiple of a frame")
    side = 8
    entry = box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", side, side, 0x480000, 0x480000, 0, 1),
        bytes(32), struct.pack(">Hh", 40, -1),
    )
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, min(frames, CHUNK_FRAMES))] if chunks == 1 or last == CHUNK_FRAMES else [(1, CHUNK_FRAMES), (chunks, last)]
    keys = np.arange(1, frames + 1, KEY_EVERY)
    wide = len(payload) > 2**31

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks) * CHUNK_FRAMES * FRAME
        table = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, frames, 1)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            full_box(b"stsz", struct.pack(">II", FRAME, frames)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        reference = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
            full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"),
            box(b"minf", full_box(b"vmhd", bytes(8), flags=1), reference, table),
        )
        header = full_box(
            b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), _UNITY, struct.pack(">II", side << 16, side << 16), flags=3
        )
        movie = full_box(
            b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2)
        )
        return box(b"moov", movie, box(b"trak", header, media))

    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")
    head = 8 if len(payload) + 8 < 2**32 else 16
    first = len(brand) + len(moov(0)) + head
    return b"".join([brand, moov(first), box(b"mdat", payload)])


def pad(raw: bytes, unit: int = FRAME) -> bytes:
    """raw with bytes 0 appended up to a positive multiple of unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = (), depth: int = 0) -> Iterator[tuple]:
    """(path, offset of the body, end) of each box, outer boxes first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("box header cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} of {size} bytes doesn't fit")
        here = (*path, kind)
        yield here, body, stop
        if kind in CONTAINERS and depth < DEPTH:
            yield from walk(data, body, stop, here, depth + 1)
        start = stop


def _table(data: memoryview, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """The rows of a table box: version and flags, count, then count rows."""
    count = struct.unpack_from(">I", data, at + 4)[0]
    bytes_ = np.dtype(kind).itemsize * width * count
    if at + 8 + bytes_ > end:
        raise ValueError("table longer than its box")
    rows = np.frombuffer(data[at + 8 : at + 8 + bytes_], kind).astype(np.int64)
    return rows.reshape(-1, width) if width > 1 else rows


def _sizes(data: memoryview, at: int, end: int, compact: bool) -> np.ndarray:
    field, count = struct.unpack_from(">II", data, at + 4)
    if not compact:
        if field:
            if field * count > len(data):
                raise ValueError("samples longer than the file")
            return np.full(count, field, np.int64)
        return np.frombuffer(data[at + 12 : end], ">u4", count).astype(np.int64)
    bits = field & 0xFF
    if bits not in (4, 8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    if bits == 4:
        pairs = np.frombuffer(data[at + 12 : end], np.uint8, (count + 1) // 2)
        return np.stack([pairs >> 4, pairs & 15], 1).reshape(-1)[:count].astype(np.int64)
    return np.frombuffer(data[at + 12 : end], f">u{bits // 8}", count).astype(np.int64)


def _fragment_header(view: memoryview, at: int, moof: int, defaults: dict[int, tuple]) -> dict:
    """What a tfhd box says of its fragment; what it leaves out comes from trex, and its base from the moof box."""
    flags, track = struct.unpack_from(">I", view, at)[0] & 0xFFFFFF, struct.unpack_from(">I", view, at + 4)[0]
    duration, size, sample_flags = defaults.get(track, (0, 0, 0))
    base, at = moof, at + 8
    if flags & 0x1:
        base, at = struct.unpack_from(">Q", view, at)[0], at + 8
    at += 4 if flags & 0x2 else 0
    fields = {0x8: duration, 0x10: size, 0x20: sample_flags}
    for flag in fields:
        if flags & flag:
            fields[flag], at = struct.unpack_from(">I", view, at)[0], at + 4
    return {"track": track, "base": base, "next": base, "duration": fields[0x8], "size": fields[0x10], "flags": fields[0x20]}


def _run(view: memoryview, at: int, end: int, head: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(offsets, sizes, keys) of a trun box's samples, and their duration."""
    flags, count = struct.unpack_from(">I", view, at)[0] & 0xFFFFFF, struct.unpack_from(">I", view, at + 4)[0]
    start, at = head["next"], at + 8
    if flags & 0x1:
        start, at = head["base"] + struct.unpack_from(">i", view, at)[0], at + 4
    first = head["flags"]
    if flags & 0x4:
        first, at = struct.unpack_from(">I", view, at)[0], at + 4
    given = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
    if at + 4 * len(given) * count > end or (not given and count > len(view)):
        raise ValueError("run longer than its box")
    rows = np.frombuffer(view[at : at + 4 * len(given) * count], ">u4").astype(np.int64).reshape(count, len(given))
    field = lambda flag, default: rows[:, given.index(flag)] if flag in given else np.full(count, default, np.int64)
    sizes, marks = field(0x200, head["size"]), field(0x400, head["flags"]).copy()
    if flags & 0x4 and count:
        marks[0] = first
    offsets = start + np.cumsum(sizes) - sizes
    head["next"] = start + int(sizes.sum())
    # Bit 16 of a sample's flags: it isn't a sync sample.
    return offsets, sizes, (marks >> 16) & 1 == 0, int(field(0x100, head["duration"]).sum())


def tracks(data: bytes) -> list[dict]:
    """Each track: number, handler, codec, width, height, timescale, duration, and its samples' offsets, sizes and keys.

    Samples of fragments come after those of the sample tables.
    """
    view, found = memoryview(data), []
    defaults: dict[int, tuple] = {}
    head, moof, runs = None, 0, []
    for path, at, end in walk(view):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            found.append({"number": 0, "handler": "", "codec": "", "width": 0, "height": 0, "timescale": 0, "duration": 0})
        elif kind == b"trex":
            number, _, *values = struct.unpack_from(">5I", view, at + 4)
            defaults[number] = tuple(values)
        elif path == (b"moof",):
            moof = at - 8
        elif kind == b"tfhd":
            head = _fragment_header(view, at, moof, defaults)
        elif kind == b"trun":
            if head is None:
                raise ValueError("run without a fragment header")
            runs.append((head["track"], *_run(view, at, end, head)))
        if not found or b"trak" not in path:
            continue
        track = found[-1]
        if kind == b"tkhd":
            track["number"] = struct.unpack_from(">I", view, at + (20 if view[at] == 1 else 12))[0]
        elif kind == b"mdhd":
            form = ">QQIQ" if view[at] == 1 else ">IIII"
            _, _, track["timescale"], track["duration"] = struct.unpack_from(form, view, at + 4)
        elif kind == b"hdlr" and path[-2] == b"mdia":
            track["handler"] = bytes(view[at + 8 : at + 12]).decode("latin-1")
        elif kind == b"stsd":
            track["codec"] = bytes(view[at + 12 : at + 16]).decode("latin-1")
            if track["handler"] == "vide" and at + 44 <= end:
                track["width"], track["height"] = struct.unpack_from(">HH", view, at + 40)
        elif kind == b"stts":
            track["stts"] = _table(view, at, end, ">u4", 2)
        elif kind == b"stss":
            track["stss"] = _table(view, at, end, ">u4")
        elif kind == b"stsc":
            track["stsc"] = _table(view, at, end, ">u4", 3)
        elif kind in (b"stco", b"co64"):
            track["chunks"] = _table(view, at, end, ">u4" if kind == b"stco" else ">u8")
        elif kind in (b"stsz", b"stz2"):
            track["sizes"] = _sizes(view, at, end, kind == b"stz2")
    for track in found:
        _place(track, len(data))
        _append_runs(track, [r[1:] for r in runs if r[0] == track["number"]], len(data))
    return found


def _append_runs(track: dict, runs: list[tuple], length: int) -> None:
    if not runs:
        return
    before = len(track["sizes"])
    offsets, sizes, keys, durations = zip(*runs, strict=True)
    track["duration"] = (track["duration"] if before else 0) + sum(durations)
    track["keys"] = np.concatenate([track["keys"], before + np.flatnonzero(np.concatenate(keys))])
    track["offsets"] = np.concatenate([track["offsets"], *offsets])
    track["sizes"] = np.concatenate([track["sizes"], *sizes])
    if (track["offsets"] < 0).any() or (track["offsets"] + track["sizes"] > length).any():
        raise ValueError("sample beyond the file")


def _place(track: dict, length: int) -> None:
    """Offsets of a track's samples, from its chunk and size tables."""
    sizes, chunks = track.pop("sizes", np.zeros(0, np.int64)), track.pop("chunks", np.zeros(0, np.int64))
    runs = track.pop("stsc", np.zeros((0, 3), np.int64))
    per_chunk = np.zeros(len(chunks), np.int64)
    for k, (first, n, _) in enumerate(runs):
        stop = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunks)
        per_chunk[first - 1 : stop] = n
    if per_chunk.sum() != len(sizes):
        raise ValueError("chunks and samples disagree")
    chunk = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    track["offsets"] = chunks[chunk] + before - before[np.minimum(first[chunk], max(len(sizes) - 1, 0))]
    track["sizes"] = sizes
    if len(sizes) and (track["offsets"] + sizes > length).any():
        raise ValueError("sample beyond the file")
    times = track.pop("stts", np.zeros((0, 2), np.int64))
    track["duration"] = int((times[:, 0] * times[:, 1]).sum()) if len(times) else track["duration"]
    keys = track.pop("stss", None)
    track["keys"] = np.arange(len(sizes)) if keys is None else keys - 1
    if len(track["keys"]) and not (0 <= track["keys"].min() and track["keys"].max() < len(sizes)):
        raise ValueError("keyframe that isn't a sample")


def payload(data: bytes, track: dict) -> bytes:
    """A track's sample bytes in order."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(sizes):
        return b""
    cuts = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    edges = np.concatenate([[0], cuts, [len(sizes)]])
    return b"".join(data[offsets[a] : offsets[b - 1] + sizes[b - 1]] for a, b in zip(edges[:-1], edges[1:], strict=True))


_KEYFRAMES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
INDEX_SCHEMA = (
    "track int, handler string, codec string, timescale long, duration long, samples long, "
    "keyframes array<struct<offset:bigint,size:bigint>>, error string"
)
#: Bytes of media taken at a time.
GATHER = 8_000_000


def keyframes(track: dict) -> list[dict]:
    """Byte ranges of a track's keyframes."""
    keys = track["keys"]
    return [{"offset": o, "size": n} for o, n in zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist(), strict=True)]


def index_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(doc_id, track, handler, codec, timescale, duration, samples, keyframes, error), a row for each track of each file.

    track counts from 1 in file order. duration is in units of 1/timescale seconds;
    keyframes are byte ranges of the file. A null, empty or malformed file is one
    row of nulls that says why in error, however it is malformed; a track without a
    sync table has a keyframe for each sample. Other columns are ignored.
    """
    bound_batches(media.sparkSession)
    names = ("track", "handler", "codec", "timescale", "duration", "samples", "keyframes", "error")
    kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3, _KEYFRAMES, pa.string()]

    def rows_of(raw: bytes) -> list[dict]:
        try:
            found = [
                {k: t[k] for k in ("handler", "codec", "timescale", "duration")}
                | {"track": n, "samples": len(t["sizes"]), "keyframes": keyframes(t)}
                for n, t in enumerate(tracks(raw), 1)
            ]
            return found or [{"error": "no track"}]
        except Exception as e:  # noqa: BLE001  a bad file must not end the job
            return [{"error": str(e) or type(e).__name__}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER):
            rows, owner = [], []
            for k, raw in enumerate(batch.column(1)):
                mine = rows_of(raw.as_py() or b"")
                rows += mine
                owner += [k] * len(mine)
            columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *columns], ["doc_id", *names])

    kind = media.schema[id_col].dataType.simpleString()
    found = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(
        tidy(run), f"doc_id {kind}, {INDEX_SCHEMA}"
    )
    return found.withColumnRenamed("doc_id", id_col)


def pack_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded to whole frames, as a media file.

    Null texts count as empty; an empty text is one frame of zeros.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER):
            raws = text_array(batch.column(1)).cast(pa.binary()).to_pylist()
            files = [pack_payload(pad(r)) for r in raws]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(files, pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), f"doc_id {kind}, n_bytes long, media binary"
    )
    return packed.withColumnRenamed("doc_id", id_col)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
             "codec", "duration", "timescale", "keyframes"]
    for batch in gathered(batches, GATHER, 2):
        rows = []
        for doc, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            track = tracks(raw)[0]
            body, keys = payload(raw, track), track["keys"]
            ranges = np.stack([track["offsets"][keys], track["sizes"][keys]], 1).astype("<i8").tobytes()
            feature = (
                f"{track['codec'].strip()} {track['width']}x{track['height']} "
                f"{track['duration']}/{track['timescale']} s, {len(track['sizes'])} samples, "
                f"{len(keys)} keyframes {zlib.crc32(ranges):08x}"
            )
            rows.append((
                doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-FRAME:]),
                len(raw), hashlib.sha256(raw).hexdigest(), feature, track["codec"], track["duration"], track["timescale"], keyframes(track),
            ))
        if rows:
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            columns[-1] = columns[-1].cast(_KEYFRAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[1:]], names)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a media file in the shared folder, read the files back and describe them, keyframe byte ranges included."""
    spark = docs.sparkSession
    packed = pack_text(docs, id_col, text_col).withColumnRenamed(id_col, "doc_id")
    path = f"{new_folder(spark, 'media')}/t"
    packed.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(packed.schema).parquet(path)
    kind = packed.schema["doc_id"].dataType.simpleString()
    found = stored.mapInArrow(
        tidy(_digest),
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string, codec string, duration long, timescale long, "
        "keyframes array<struct<offset:bigint,size:bigint>>",
    )
    return found.withColumnRenamed("doc_id", id_col)
