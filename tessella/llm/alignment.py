"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers cut the same bytes, a space and the text. Over these bytes each
tokenizer has a packed bitset with a one where a token ends:

* the AND of both has a one at each shared cut, which ends a group;
* popcounts before a cut (rank) tell how many tokens of either side end there, so
  cuts map to ranges of tokens;
* the OR has a one at the end of each stretch that lies in one token of either
  side: a stretch is a link, and ranks before it name its two tokens.

A text is cut before single spaces between characters that aren't white space.
No token of either side crosses such a place (`can_cut` checks the files), so
each distinct segment is encoded and aligned once a worker, segments being put
into one line of bytes; a text's groups and links are its segments' in order.
Counts of id pairs over all texts are sums per pair, and come back to the texts
by a join on the pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.arrowtext import gathered, starts_of, text_array
from tessella.llm.shared import bound_batches, kept, small
from tessella.llm.tokenization import breaks_before_spaces, load
from tessella.llm.workers import KEPT, tidy

#: Segments that a worker remembers, of at most SEGMENT_CHARS characters each: some 150 MB at most.
SEGMENTS = 350_000
SEGMENT_CHARS = 48
#: Characters of new segments that are encoded and aligned together.
LINE = 200_000
#: Ids of the second tokenizer fit so many bits of a pair's code.
SHIFT = 20
#: A pair's code has so many bits; a batch's rows are counted above them.
OWNER = 2 * SHIFT

_CUT = re.compile(r" (?=\S)(?<=\S )")
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one letter: visible Latin-1 letters stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def entry_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a tokenizer file."""
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        hexed = [_BYTE_PIECE.fullmatch(p) for p in pieces]
        return [bytes.fromhex(h[1]) if h else p.replace("▁", " ").encode() for p, h in zip(pieces, hexed, strict=True)]
    letters, vocabulary = byte_letters(), Tokenizer.from_file(path).get_vocab()
    found = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        plain = all(c in letters for c in token)
        found[i] = bytes(letters[c] for c in token) if plain else token.encode()
    return found


def can_cut(path_a: str, path_b: str) -> bool:
    """Whether neither tokenizer has a token over a single space between other characters."""
    if not path_b.endswith(".model"):
        return False
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = (model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return breaks_before_spaces(path_a) and not any("▁" in p for p in pieces)


class Bits:
    """A packed bitset over positions 0 to n - 1 with popcounts, so that rank and select are table lookups."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = starts_of(np.bitwise_count(words).astype(np.int64))

    @classmethod
    def at(cls, places: np.ndarray, n: int) -> Bits:
        """Ones at the places."""
        flags = np.zeros(-(-n // 64) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """The places of all ones, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def groups_and_links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the last byte of each token of either side, over the same bytes:

    (last byte of each group, its first token of A, of B, and for each link its token of A, of B).
    """
    n = int(ends_a[-1]) + 1
    a, b = Bits.at(ends_a, n), Bits.at(ends_b, n)
    cuts = (a & b).select()
    ends = (a | b).select()
    after = np.concatenate([[0], cuts[:-1] + 1])
    return cuts, a.rank(after), b.rank(after), a.rank(ends), b.rank(ends)


#: Longs of a segment before its pairs.
HEAD = 3


class Aligned(NamedTuple):
    """What a segment gives: the groups as text; as packed longs its numbers of tokens of either side and of groups, then the code of each link's pair."""

    shown: str
    packed: bytes


def unpacked(found: list[list[Aligned] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row for each of n_a, n_b and n_groups, a column for each text; links of each text; the pairs of all texts in order)."""
    packed = [x.packed for parts in found for x in parts or ()]
    edges = starts_of(np.array([len(parts or ()) for parts in found], np.int64))
    starts = starts_of(np.array(list(map(len, packed)), np.int64) >> 3)
    longs = np.frombuffer(b"".join(packed), np.int64)
    sums = np.array([np.diff(starts_of(longs[starts[:-1] + k])[edges]) for k in range(HEAD)])
    keep = np.ones(len(longs), bool)
    for k in range(HEAD):
        keep[starts[:-1] + k] = False
    return sums, np.diff(starts[edges]) - HEAD * np.diff(edges), longs[keep]


class Aligner:
    """Aligns texts; remembers short segments."""

    def __init__(self, path_a: str, path_b: str, most: int = SEGMENTS):
        self.first, self.second = load(path_a), load(path_b)
        self.first.encode_special_tokens = True
        self.bytes_a, self.bytes_b = entry_bytes(path_a), entry_bytes(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in found], np.int64) for found in (self.bytes_a, self.bytes_b))
        #: Each id as text before a comma, a bar and a semicolon.
        self.signed = np.array([f"{i}{sign}" for sign in ",|;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)
        self.cuts, self.most = can_cut(path_a, path_b), most
        self.known: dict[str, Aligned | None] = {}

    def _encoded(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.first.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False)]
        return a, self.second.encode(parts, num_threads=1)

    def _joined(self, parts: list[str], ids_a: np.ndarray, edge_a: np.ndarray, ids_b: np.ndarray, edge_b: np.ndarray) -> np.ndarray:
        """Whether both sides' tokens of each part join to a space and the part: lengths first, then the bytes of all parts at once."""
        raw = [f" {p}".encode() for p in parts]
        sizes = np.array(list(map(len, raw)), np.int64)
        good = (np.diff(starts_of(self.size_a[ids_a])[edge_a]) == sizes) & (np.diff(starts_of(self.size_b[ids_b])[edge_b]) == sizes)
        want = np.frombuffer(b"".join(raw if good.all() else compress(raw, good.tolist())), np.uint8)
        lengths, ends, checked = good.copy(), np.cumsum(sizes[good]), np.flatnonzero(good)
        for entries, ids, edges in ((self.bytes_a, ids_a, edge_a), (self.bytes_b, ids_b, edge_b)):
            here = ids if len(checked) == len(parts) else ids[np.repeat(lengths, np.diff(edges))]
            found = np.frombuffer(b"".join(map(entries.__getitem__, here.tolist())), np.uint8)
            good[checked[np.searchsorted(ends, np.flatnonzero(found != want), side="right")]] = False
        return good

    def _line(self, parts: list[str]) -> list[Aligned | None]:
        """Each part's alignment; None where its tokens don't join to it."""
        every_a, every_b = self._encoded(parts)
        found: list[Aligned | None] = [None] * len(parts)
        counts_a, counts_b = (np.array(list(map(len, every)), np.int64) for every in (every_a, every_b))
        ids_a, ids_b = (np.array(list(chain.from_iterable(every)), np.int64) for every in (every_a, every_b))
        good = self._joined(parts, ids_a, starts_of(counts_a), ids_b, starts_of(counts_b))
        if not good.any():
            return found
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, counts_a)], ids_b[np.repeat(good, counts_b)]
        cuts, first_a, first_b, link_a, link_b = groups_and_links(np.cumsum(self.size_a[ids_a]) - 1, np.cumsum(self.size_b[ids_b]) - 1)
        pairs = (ids_a[link_a] << SHIFT) | ids_b[link_b]
        edge_a, edge_b = starts_of(counts_a[good]), starts_of(counts_b[good])
        # A part's bytes end at a shared cut, so parts are runs of groups and of links.
        edge_group, edge_link = np.searchsorted(first_a, edge_a), np.searchsorted(link_a, edge_a)
        heads = np.stack([np.diff(edge_a), np.diff(edge_b), np.diff(edge_group)], axis=1)
        packed, edge_packed = np.insert(pairs, np.repeat(edge_link[:-1], HEAD), heads.ravel()).tobytes(), (edge_link + HEAD * np.arange(len(edge_link))).tolist()
        shown, edge_shown = self._shown(ids_a, ids_b, first_a, first_b), (edge_a + edge_b).tolist()
        for at, k in enumerate(np.flatnonzero(good).tolist()):
            found[k] = Aligned("".join(shown[edge_shown[at] : edge_shown[at + 1]])[:-1], packed[8 * edge_packed[at] : 8 * edge_packed[at + 1]])
        return found

    def _shown(self, ids_a: np.ndarray, ids_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[str]:
        """The ids of both sides in the order of their groups, each with the sign that follows it."""
        ends_a, ends_b = np.append(first_a[1:], len(ids_a)), np.append(first_b[1:], len(ids_b))
        code_a, code_b, order = ids_a.copy(), ids_b.copy(), np.empty(len(ids_a) + len(ids_b), np.int64)
        code_a[ends_a - 1] += len(self.signed) // 3
        code_b[ends_b - 1] += len(self.signed) // 3 * 2
        order[np.arange(len(ids_a)) + np.repeat(first_b, ends_a - first_a)] = code_a
        order[np.arange(len(ids_b)) + np.repeat(ends_a, ends_b - first_b)] = code_b
        return self.signed[order].tolist()

    def _lines(self, parts: list[str]) -> Iterator[Aligned | None]:
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= LINE:
                yield from self._line(held)
                held, size = [], 0
        if held:
            yield from self._line(held)

    def align(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The segments of each text; None for texts without tokens: empty, or not what its tokens join to."""
        cut = [(_CUT.split(t) if self.cuts else [t]) if t else [] for t in texts]
        new = list(dict.fromkeys(p for parts in cut for p in parts if p not in self.known))
        here = dict(zip(new, self._lines(new), strict=True))
        found = [[here[p] if p in here else self.known[p] for p in parts] for parts in cut]
        short = {p: x for p, x in here.items() if len(p) <= SEGMENT_CHARS}
        if len(self.known) + len(short) > self.most:
            # What came first is what texts hold most.
            keep = self.most // 2
            self.known = dict(list(self.known.items())[:keep])
            short = dict(list(short.items())[: self.most - len(self.known)])
        self.known |= short
        for k, parts in enumerate(cut):
            if any(x is None for x in found[k]):
                found[k] = self._whole(texts[k]) if len(parts) > 1 else None
        return [x or None for x in found]

    def _whole(self, text: str) -> list[Aligned] | None:
        """A text with a segment that its tokens don't join to, encoded as one."""
        (one,) = self._line([text])
        return one and [one]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
KEPT.append(_ALIGNERS)


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner for two files, kept over the tasks that a Python worker runs."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


_KINDS = "n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<long>"


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, groups_sha256, pairs, times), a row for each row of docs.

    groups is `a1,a2|b1;a3|b2,b3` (null unless asked for); pairs are the codes of
    the text's distinct id pairs (a << SHIFT | b), times how many of its links hold
    each. Texts null or empty, or whose tokens of either side don't join to a space
    and the text, have no tokens: zeros, empty groups and hash. A long text is
    encoded by segments; only one without spaces is one call of the libraries.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(path_a, path_b)
        for batch in gathered(batches):
            found = aligner.align(text_array(batch.column(1)).to_pylist())
            sums, links, pairs = unpacked(found)
            keys, times = np.unique((np.repeat(np.arange(len(found)), links) << OWNER) | pairs, return_counts=True)
            edges = pa.array(np.searchsorted(keys >> OWNER, np.arange(len(found) + 1)).astype(np.int32))
            shown = [";".join([x.shown for x in parts]) if parts else "" for parts in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *map(pa.array, sums), pa.array(links),
                    pa.array(shown if groups else [None] * len(shown), pa.string()),
                    pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown], pa.string()),
                    pa.ListArray.from_arrays(edges, pa.array(keys & ((1 << OWNER) - 1))), pa.ListArray.from_arrays(edges, pa.array(times)),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, keeps=True), f"doc_id {kind}, {_KINDS}")
    return found.withColumnRenamed("doc_id", id_col)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of all texts that hold each id pair; best where it is its B id's highest count, ties included."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = kept(links.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count")), "pairs")
    by_b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = counts.groupBy(by_b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", by_b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs.

    n_best: the text's links whose pair's count over all texts is its B id's
    highest, ties included; count_sum: the sum of those counts over the links.
    Null and repeated ids are rows of their own. Other columns are ignored; an
    empty table gives none.
    """
    found = aligned_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path_a, path_b, groups=False)
    aligned = kept(found.drop("groups").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = small(kept(pair_counts(aligned), "counts"))
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    scored = (
        links.select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")).join(counts, "pair")
        .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    )
    return aligned.join(scored, "row", "left").select(
        F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
