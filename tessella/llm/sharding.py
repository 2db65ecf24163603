"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered in the order of a 64-bit hash: fixed ranges of the hash are
counted, the counts accumulated, and rows numbered within their range, so no
task sees more than a range. A keyed Feistel network over the smallest domain
of 4^h >= rows permutes the numbers, walking the cycle while it lands outside.
Position p goes to slot p div shards of shard p mod shards: shard sizes differ by
one at most, and anyone who knows rows, key and a number computes its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import kept, small

SHARDS = 8
KEY = 20240101
ROUNDS = 6
#: Rows of one hash range, on average.
RANGE_ROWS = 8_000
_MASK = np.uint64(0xFFFFFFFF)


def _round_keys(key: int, rounds: int) -> np.ndarray:
    return np.random.default_rng(key).integers(0, 2**32, rounds, dtype=np.uint64)


def _network(x: np.ndarray, half: int, keys: np.ndarray, inverse: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    left, right = x >> shift, x & low

    def scramble(value, k):
        h = ((value ^ k) * np.uint64(0x9E3779B1)) & _MASK
        h = ((h ^ (h >> np.uint64(15))) * np.uint64(0x85EBCA77)) & _MASK
        return (h ^ (h >> np.uint64(13))) & low

    if inverse:
        for k in keys[::-1]:
            left, right = right ^ scramble(left, k), left
    else:
        for k in keys:
            left, right = right, left ^ scramble(right, k)
    return (left << shift) | right


def permuted(rows: np.ndarray, total: int, key: int = KEY, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """The place of each row number in a keyed permutation of range(total); inverse: the way back."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    if half > 32:
        raise ValueError("more than 2^64 rows")
    keys = _round_keys(key, rounds)
    out = _network(rows.astype(np.uint64), half, keys, inverse)
    outside = np.flatnonzero(out >= total)
    while len(outside):
        out[outside] = _network(out[outside], half, keys, inverse)
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def global_rows(docs: DataFrame, order: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with row_number long, from 0 without gaps, by (unsigned) hash of `order`, then by `order`."""
    ranges = max(1, -(-docs.count() // range_rows))
    hashed = docs.withColumn("row_hash", F.xxhash64(*order)).withColumn(
        "row_range", F.floor(F.expr(f"(shiftrightunsigned(row_hash, 33) * {ranges}) / 2147483648"))
    )
    counts = hashed.groupBy("row_range").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("row_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept(
        counts.select("row_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("row_offset")), "offsets"
    )
    inside = Window.partitionBy("row_range").orderBy(F.col("row_hash") < 0, "row_hash", *order)
    return (
        hashed.withColumn("row_inside", F.row_number().over(inside))
        .join(small(offsets), "row_range")
        .withColumn("row_number", F.col("row_offset") + F.col("row_inside") - 1)
        .drop("row_hash", "row_range", "row_inside", "row_offset")
    )


def shard(
    docs: DataFrame, shards: int = SHARDS, key: int = KEY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number), a row for each row of docs.

    The law is `rows`: shard sizes differ by one row at most, slots have no gaps.
    Row numbers follow a hash of id and text checksum, so they don't depend on how
    the table is partitioned; rows that repeat both may swap places. size is the
    text's UTF-8 bytes and one more; null texts count as empty, null ids as any
    other id. Other columns are ignored; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = kept(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ),
        "sized",
    )
    total = sized.count()
    numbered = global_rows(sized, ["doc_id", "text_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = permuted(batch.column("row_number").to_numpy(), total, key)
            yield batch.append_column("place", pa.array(at))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema) + ", place long"
    placed = numbered.mapInArrow(place, schema)
    return placed.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
