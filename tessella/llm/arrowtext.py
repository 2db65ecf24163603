"""Words of whole Arrow batches, cut by Arrow's kernels instead of a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that gathered() puts together.
GATHER_BYTES = 4_000_000
_UPPER = bytes(range(65, 91))
#: Byte tables for bytes.translate(). Both lower-case A-Z alone.
#: SPACED: words are what stands between the bytes 20 and 09-0D.
SPACED = bytes.maketrans(_UPPER, _UPPER.lower())
#: ALNUM: words are digits, letters and everything outside ASCII.
ALNUM = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in SPACED
)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """The column as one StringArray without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def gathered(batches: Iterator[pa.RecordBatch], most: int = GATHER_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about `most` bytes of the text column, one row at least.

    Larger ones repeat more words; the bound holds a worker's memory however long texts are.
    """
    held, size = [], 0
    for batch in batches:
        start = 0
        for row, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            size += n
            if size >= most:
                yield pa.concat_batches([*held, batch.slice(start, row + 1 - start)])
                held, size, start = [], 0, row + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.concat_batches(held)


def mapped(texts: pa.StringArray, table: bytes) -> pa.StringArray:
    """texts with each byte sent through the 256-byte table; lengths stay."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, np.int32)
    raw = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().translate(table) if data else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(raw))


def words(texts: pa.StringArray, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(words of each text, code of each word in order, the distinct words by code)."""
    split = pc.ascii_split_whitespace(mapped(texts, table))
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = full.to_numpy(zero_copy_only=False)
    counts = np.bincount(owner[keep], minlength=len(texts)).astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return counts, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_hashes(distinct: pa.StringArray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(
        (digest(w, seed) for w in distinct.cast(pa.binary()).to_pylist()),
        dtype=np.uint64,
        count=len(distinct),
    )


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Where each text's words begin in the flat array, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)])
