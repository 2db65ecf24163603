"""Token-id files: ids in chunks, each chunk as compressed planes, with a chunk index.

A file holds the ids of consecutive documents, in ascending id order:

    magic "TPLN1\\0\\0\\0"
    chunks, each the frames of its planes one after the other
    footer: a zstandard frame of JSON-free fixed records (below)
    trailer: footer offset (u64), footer bytes (u64), magic

A chunk is CHUNK ids (the last may have fewer), transposed into planes: `byte`
has four planes, plane k being byte k of each id; `bit` has 32, plane k being bit
k of each id, packed. Each plane is one zstandard frame. The footer holds
  plane kind (u8: 0 byte, 1 bit), chunk ids (u32), chunks (u64), documents (u64),
  per chunk: offset (u64), ids (u32), and the bytes of each plane (u32 each),
  per document: has id (u8), id (i64), tokens (u64).
Anyone can read one chunk, or one document's chunks, from the index alone. All
integers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrowtext import gathered, text_array
from tessella.llm.shared import bound_batches, kept, new_folder
from tessella.llm.tokenization import worker_encoder
from tessella.llm.workers import tidy

MAGIC = b"TPLN1\0\0\0"
CHUNK = 1 << 16
PLANES = "byte"
LEVEL = 3
END_ID = 1
#: Documents of one file, about, and the most files of a table.
FILE_DOCS = 8192
MOST_FILES = 20_000
_KINDS = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, planes: str = PLANES) -> list[bytes]:
    """The planes of a block of ids."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == "byte":
        return [o.tobytes() for o in octets]
    return [np.packbits((o >> b) & 1).tobytes() for o in octets for b in range(8)]


def from_planes(parts: list[bytes], n: int, planes: str = PLANES) -> np.ndarray:
    """The ids of a block from its planes."""
    if planes == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in parts])
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in parts]
        octets = np.stack([sum(bits[8 * o + b] << np.uint8(b) for b in range(8)) for o in range(4)])
    return np.ascontiguousarray(octets.T).astype(np.uint8).view("<u4").reshape(-1)


class Writer:
    """Writes one file; holds at most a chunk of ids and the index."""

    def __init__(self, out, planes: str = PLANES, chunk: int = CHUNK, level: int = LEVEL):
        self.out, self.planes, self.chunk = out, planes, chunk
        self.press = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.held = 0
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc, len(ids) // 4))
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.chunk:
            flat = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(flat) // self.chunk * self.chunk
            for k in range(0, whole, self.chunk):
                self._put(flat[k : k + self.chunk])
            self.waiting, self.held = [flat[whole:].tobytes()], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        frames = [self.press.compress(p) for p in to_planes(ids, self.planes)]
        self.chunks.append((self.at, len(ids), [len(f) for f in frames]))
        for frame in frames:
            self.out.write(frame)
            self.at += len(frame)

    def finish(self) -> None:
        if self.held:
            self._put(np.frombuffer(b"".join(self.waiting), "<u4"))
        kind = list(_KINDS).index(self.planes)
        footer = struct.pack("<BIQQ", kind, self.chunk, len(self.chunks), len(self.docs))
        footer += b"".join(struct.pack(f"<QI{len(s)}I", at, n, *s) for at, n, s in self.chunks)
        footer += bytes(d is not None for d, _ in self.docs)
        footer += np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        footer += np.array([n for _, n in self.docs], "<u8").tobytes()
        frame = self.press.compress(footer)
        self.out.write(frame + struct.pack("<QQ", self.at, len(frame)) + MAGIC)


class Reader:
    """Reads one file through a random-access stream; holds a chunk and the index."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = self._at(size - 24, 24)
        if tail[16:] != MAGIC:
            raise ValueError("not a token file")
        at, length = struct.unpack("<QQ", tail[:16])
        raw = zstandard.ZstdDecompressor().decompress(self._at(at, length))
        kind, self.chunk, chunks, docs = struct.unpack_from("<BIQQ", raw)
        self.planes = list(_KINDS)[kind]
        record = struct.Struct(f"<QI{_KINDS[self.planes]}I")
        base = struct.calcsize("<BIQQ")
        self.chunks = [record.unpack_from(raw, base + k * record.size) for k in range(chunks)]
        base += chunks * record.size
        there = raw[base : base + docs]
        ids = np.frombuffer(raw, "<i8", docs, base + docs).tolist()
        self.lengths = np.frombuffer(raw, "<u8", docs, base + 9 * docs).astype(np.int64)
        self.docs = [i if h else None for i, h in zip(ids, there, strict=True)]

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(length)

    def read_chunk(self, k: int) -> np.ndarray:
        offset, n, *sizes = self.chunks[k]
        raw, parts, open_ = self._at(offset, sum(sizes)), [], zstandard.ZstdDecompressor()
        for size in sizes:
            parts.append(open_.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(parts, n, self.planes)

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
        """(id, the pieces of its ids) in order; pieces of a document must be taken before the next."""
        chunk, used, k = np.zeros(0, "<u4"), 0, 0
        for doc, length in zip(self.docs, self.lengths, strict=True):
            pieces, need = [], int(length)
            while need:
                if used == len(chunk):
                    chunk, used, k = self.read_chunk(k), 0, k + 1
                piece = chunk[used : used + need]
                pieces.append(piece)
                used, need = used + len(piece), need - len(piece)
            yield doc, pieces

    def document(self, index: int) -> np.ndarray:
        """The ids of the document at a place of the file, from its chunks only."""
        start = int(self.lengths[:index].sum())
        end = start + int(self.lengths[index])
        ids = [self.read_chunk(k) for k in range(start // self.chunk, -(-end // self.chunk))]
        first = start // self.chunk * self.chunk
        return np.concatenate([*ids, np.zeros(0, "<u4")])[start - first : end - first]


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    out_dir: str | None = None,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    planes: str = PLANES,
    file_docs: int = FILE_DOCS,
) -> DataFrame:
    """Encode docs into files of out_dir (a folder all executors share); returns their manifest.

    Manifest: (file, part, docs, ids, bytes); files in order of part hold documents
    in ascending id, null ids first, equal ids by the text's hash, which also deals
    a repeated id to several files. Each text gets end_id after it; null texts count
    as empty. A file's name tells job and attempt, and nothing is renamed:
    a task that runs again writes another file, the manifest names the one that
    counts, and files it doesn't name are removed. An empty table makes no file.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out_dir, job = out_dir or new_folder(spark, "tokens"), uuid.uuid4().hex
    parts = min(MOST_FILES, max(1, -(-docs.count() // file_docs)))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("text_hash", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "text_hash")
        .sortWithinPartitions("doc_id", "text_hash", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(out_dir)
        name = f"{root}/{job}-{part:06d}-{uuid.uuid4().hex}.tokens"
        encoder, writer, stream = None, None, None
        end = struct.pack("<I", end_id)
        for batch in gathered(batches):
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(root, recursive=True)
                encoder, stream = worker_encoder(tokenizer_path), fs.open_output_stream(name)
                writer = Writer(stream, planes)
            counts, ids = encoder.encode(text_array(batch.column(1)))
            raw, at = ids.tobytes(), 0
            for doc, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                writer.add(doc, raw[at : at + 4 * n] + end)
                at += 4 * n
        if writer is None:
            return
        writer.finish()
        stream.close()
        yield pa.RecordBatch.from_pylist([{
            "file": name, "part": part, "docs": len(writer.docs),
            "ids": sum(n for _, n in writer.docs), "bytes": fs.get_file_info(name).size,
        }])

    manifest = ordered.mapInArrow(tidy(run, keeps=True), "file string, part long, docs long, ids long, bytes long")
    named = kept(manifest.withColumn("folder", F.lit(out_dir)), "manifest")
    _remove_others(named, out_dir, job)
    return named


def _remove_others(manifest: DataFrame, out_dir: str, job: str) -> None:
    """Delete this job's files that its manifest doesn't name: what lost attempts left. At most MOST_FILES names."""
    spark = manifest.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    named = {row["file"].rsplit("/", 1)[-1] for row in manifest.select("file").collect()}
    if named:
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith(job) and name not in named:
                fs.delete(status.getPath(), False)


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of a manifest."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = pafs.FileSystem.from_uri(row["folder"])
                with fs.open_input_file(row["file"]) as stream:
                    reader, start, out = Reader(stream, row["bytes"]), row["first"], []
                    for (doc, pieces), length in zip(reader.documents(), reader.lengths.tolist(), strict=True):
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece.tobytes(), crc)
                        out.append((doc, start, length, crc))
                        start += length
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    files = placed.repartition(min(MOST_FILES, max(1, manifest.count())), "part")
    read = files.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read.withColumnRenamed("doc_id", id_col)


def token_file_digest(docs: DataFrame, tokenizer_path: str, **settings) -> DataFrame:
    """Write docs to token files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer_path, **settings), settings.get("id_col", "doc_id"))
