"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is WINDOW consecutive words of an item, or all of a shorter item. Its
shingles are its runs of SHINGLE words. A document holds a window only if it
holds all its shingles, so the necessary prefix of the window, in order of
rarity over all documents, is its rarest shingle. Documents are joined on that
one; the shingle's place in the window bounds where the window can start and the
document's length where it can end; what is left is compared word by word.

Items are taken in blocks of a bounded size, each held by every task, and each
block sees all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrowtext import ALNUM, gathered, starts_of, text_array, words
from tessella.llm.shared import bound_batches
from tessella.llm.workers import tidy

WINDOW = 10
SHINGLE = 3
#: Bytes of item texts in one block.
BLOCK_BYTES = 16_000_000
#: Bytes of document texts scanned at a time.
GATHER = 4_000_000
#: Candidate places that are compared at a time.
_CHUNK = 1 << 16


@dataclass
class Items:
    """The windows of a block of items, words as numbers from 1 (0: in no item)."""

    ids: list[str]
    vocabulary: dict[str, int]
    flat: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    #: By shingle width: the sorted keys, and for each window (of that width) its anchor.
    keys: dict[int, np.ndarray]
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None


def _shingle_keys(flat: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the run of `width` words at each place; 0 where a word is in no item.

    Runs that share a hash only make more candidates: windows are compared word by word.
    """
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(width):
        part = flat[k : k + n]
        key = (key ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        known &= part > 0
    return np.where(known, key | np.uint64(1), np.uint64(0))


def _items(rows: list[tuple[str, str]], window: int, shingle: int) -> Items:
    counts, codes, distinct = words(text_array(pa.array([t for _, t in rows], pa.string())), ALNUM)
    flat = codes + 1
    starts = starts_of(counts)[:-1]
    number = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    item = np.repeat(np.arange(len(rows)), number)
    start = np.repeat(starts, number) + np.arange(number.sum()) - np.repeat(starts_of(number)[:-1], number)
    length = np.minimum(counts, window)[item]
    vocabulary = {w: i + 1 for i, w in enumerate(distinct.to_pylist())}
    keys = {}
    for width in range(1, shingle + 1):
        mine = np.minimum(length, shingle) == width
        if mine.any():
            every = _shingle_keys(flat, width)
            runs = length[mine] - width + 1
            places = np.repeat(start[mine], runs) + np.arange(runs.sum()) - np.repeat(starts_of(runs)[:-1], runs)
            keys[width] = np.unique(every[np.unique(places)])
    return Items([i for i, _ in rows], vocabulary, flat, start, length, item, keys)


def _anchored(items: Items, frequency: dict[int, np.ndarray], shingle: int) -> Items:
    """Choose each window's rarest shingle; windows sorted by it."""
    items.anchors = {}
    for width, keys in items.keys.items():
        mine = np.flatnonzero(np.minimum(items.length, shingle) == width)
        every = _shingle_keys(items.flat, width)
        rank = np.searchsorted(keys, every).clip(0, len(keys) - 1)
        best, where = np.full(len(mine), np.iinfo(np.int64).max), np.zeros(len(mine), np.int64)
        for k in range(int(items.length[mine].max()) - width + 1):
            inside = k <= items.length[mine] - width
            at = np.minimum(items.start[mine] + k, len(every) - 1)
            cost = np.where(inside, frequency[width][rank[at]], np.iinfo(np.int64).max)
            where = np.where(cost < best, k, where)
            best = np.minimum(best, cost)
        anchor = rank[items.start[mine] + where]
        order = np.argsort(anchor, kind="stable")
        items.anchors[width] = (anchor[order], mine[order], where[order])
    return items


def _numbered(texts: pa.StringArray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    counts, codes, distinct = words(texts, ALNUM)
    find = items.vocabulary.get
    known = np.fromiter((find(w, 0) for w in distinct.to_pylist()), np.int64, len(distinct))
    return counts, known[codes] if len(codes) else np.zeros(0, np.int64)


def _found(flat: np.ndarray, owner: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, rank of its key) of the shingles in flat that items have, within one document."""
    key = _shingle_keys(flat, width)
    place = np.flatnonzero(key)
    place = place[owner[place] == owner[place + width - 1]]
    rank = np.searchsorted(keys, key[place]).clip(0, len(keys) - 1)
    hit = keys[rank] == key[place]
    return place[hit], rank[hit]


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        total = {w: np.zeros(len(k), np.int64) for w, k in items.keys.items()}
        for batch in gathered(batches, GATHER, 0):
            counts, flat = _numbered(text_array(batch.column(0)), items)
            owner = np.repeat(np.arange(len(counts)), counts)
            for width, keys in items.keys.items():
                _, rank = _found(flat, owner, keys, width)
                total[width] += np.bincount(rank, minlength=len(keys))
        for width, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), width), pa.int32()), pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())],
                ["width", "rank", "n"],
            )

    return run


def _candidates(flat, owner, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start in flat, window) in chunks: anchors met whose window fits into the document."""
    for width, keys in items.keys.items():
        anchor, window, offset = items.anchors[width]
        place, rank = _found(flat, owner, keys, width)
        low, high = np.searchsorted(anchor, rank, "left"), np.searchsorted(anchor, rank, "right")
        reps = high - low
        ends = np.cumsum(reps)
        for chunk in np.split(np.arange(len(place)), np.searchsorted(ends, np.arange(_CHUNK, ends[-1] if len(ends) else 0, _CHUNK))):
            r = reps[chunk]
            at = np.repeat(low[chunk], r) + np.arange(r.sum()) - np.repeat(starts_of(r)[:-1], r)
            begin = np.repeat(place[chunk], r) - offset[at]
            end = begin + items.length[window[at]] - 1
            fits = (begin >= 0) & (end < len(flat))
            fits[fits] = owner[begin[fits]] == owner[end[fits]]
            yield begin[fits], window[at][fits]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in gathered(batches, GATHER):
            counts, flat = _numbered(text_array(batch.column(1)), items)
            starts, owner = starts_of(counts), np.repeat(np.arange(len(counts)), counts)
            met: dict[int, tuple[set, set]] = {}
            for begin, window in _candidates(flat, owner, items):
                length = items.length[window]
                same = np.ones(len(begin), bool)
                for k in range(int(length.max()) if len(length) else 0):
                    inside = k < length
                    same &= ~inside | (
                        flat[np.minimum(begin + k, len(flat) - 1)]
                        == items.flat[np.minimum(items.start[window] + k, len(items.flat) - 1)]
                    )
                for b, w in zip(begin[same].tolist(), window[same].tolist(), strict=True):
                    doc = int(owner[b])
                    spans, which = met.setdefault(doc, (set(), set()))
                    spans.add((b - int(starts[doc]), b - int(starts[doc]) + int(items.length[w])))
                    which.add(items.ids[items.item[w]])
            spans, which = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for doc, (more, ids) in met.items():
                old = [(s["start"], s["end"]) for s in spans[doc]]
                spans[doc] = [{"start": a, "end": b} for a, b in _merged(old + list(more))]
                which[doc] = sorted({*which[doc], *ids})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(which, pa.list_(pa.string())),
                ],
                ["doc_id", "text", "n_words", "spans", "items"],
            )

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, spans, items), a row for each row of docs.

    spans are the ranges of word places that lie in an occurrence of some window,
    disjoint and in order; items the ids, as strings, of the items that occur.
    Null or empty texts have no words and no hits; so have null or empty items. A
    null item id is the string `null`; items that share an id count once. Other
    columns are ignored; an empty table gives none, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    given = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(item_text_col), F.lit("")).alias("words"),
    )
    total = given.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    state = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    texts = state.select("text")
    for b in range(max(1, blocks)):
        # A block's rows are bounded by block_bytes, or by one item where an item is larger.
        mine = given.where(F.pmod(F.xxhash64("item", "words"), F.lit(max(1, blocks))) == b)
        items = _items([tuple(r) for r in mine.collect()], window, shingle)
        unranked = spark.sparkContext.broadcast(items)
        counted = texts.mapInArrow(tidy(_count(unranked)), "width int, rank long, n long")
        frequency = {w: np.zeros(len(k), np.int64) for w, k in items.keys.items()}
        for row in counted.groupBy("width", "rank").agg(F.sum("n").alias("n")).collect() if items.keys else []:
            frequency[row["width"]][row["rank"]] = row["n"]
        ranked = spark.sparkContext.broadcast(_anchored(items, frequency, shingle))
        state = state.mapInArrow(
            tidy(_scan(ranked)),
            f"doc_id {id_type}, text string, n_words long, spans array<struct<start:int,end:int>>, items array<string>",
        )
    return state.select(F.col("doc_id").alias(id_col), "n_words", "spans", "items")


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """contamination() in figures: n_hit, n_items, items_sha256 and contaminated for each document."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
