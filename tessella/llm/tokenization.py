"""Public tokenizers on whole Arrow batches: a cached encoder and a counter of lengths."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrowtext import SPACED, gathered, mapped, starts_of, text_array, words
from tessella.llm.shared import bound_batches
from tessella.llm.workers import KEPT, tidy

#: Bytes of text given to the library at a time.
BATCH_BYTES = 1_000_000
#: Distinct pieces that a worker remembers, of at most PIECE_CHARS characters each: some 150 MB at most, whatever the texts.
CACHE_PIECES = 500_000
PIECE_CHARS = 48

#: New words encoded at a time.
_LINE = 2000
#: Letters up to U+017F that lower-case one by one and are composed already.
_PLAIN = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
_MARKS = frozenset(".,;:!?")
_BREAK = re.compile(r"(?<=\w)(?= \w)")


def load(path: str):
    """The tokenizer in a .json file (tokenizers) or a .model file (sentencepiece)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _encode(tokenizer, texts: list[str]) -> list:
    if hasattr(tokenizer, "encode_batch_fast"):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return tokenizer.encode(texts, num_threads=1)


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    if hasattr(tokenizer, "encode_batch_fast"):
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(e) for e in tokenizer.encode(texts, num_threads=1)]


def breaks_before_spaces(path: str) -> bool:
    """Whether the tokenizer starts a new piece at a single space between word characters.

    True for byte-level splitting by its own pattern, whose words carry the space before
    them, if no added token holds a space or takes those beside it.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and not spec["model"].get("dropout")
    plain = plain and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
    return bool(plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"))


def segments(text: str) -> list[str]:
    """text cut before single spaces between word characters; the segments joined are the text."""
    return _BREAK.split(text)


class Counter:
    """Numbers of tokens of texts; remembers those of short distinct segments where texts may be cut."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, most: int = CACHE_PIECES):
        self.tokenizer, self.cuts = load(path), breaks_before_spaces(path)
        self.batch_bytes, self.most = batch_bytes, most
        self.known: dict[str, int] = {"": 0}

    def _counted(self, texts: list[str]) -> Iterator[int]:
        """Lengths from the library, in batches balanced by bytes."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text) if text.isascii() else len(text.encode())
            if size >= self.batch_bytes:
                yield from _lengths(self.tokenizer, held)
                held, size = [], 0
        if held:
            yield from _lengths(self.tokenizer, held)

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return list(self._counted(texts))
        cut = [segments(t) for t in texts]
        pieces = set(chain.from_iterable(cut))
        long = [p for p in pieces if len(p) > PIECE_CHARS]
        pieces.difference_update(long)
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > self.most:
            # What came first is what texts hold most.
            self.known = dict(islice(self.known.items(), self.most // 2))
            new = list(pieces.difference(self.known))
        self.known.update(zip(new, self._counted(new), strict=True))
        find = self.known.__getitem__
        if long:
            here = dict(zip(long, self._counted(long), strict=True))
            find = lambda p: here[p] if len(p) > PIECE_CHARS else self.known[p]
        return [sum(map(find, parts)) for parts in cut]


def worker_counter(path: str, batch_bytes: int) -> Counter:
    """The counter for a file, kept over the tasks that a Python worker runs."""
    if path not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(path, batch_bytes)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs.

    Counts are those of the library without added special tokens, truncation or
    padding; only lengths leave the worker. The library gets batches of about
    batch_bytes. Where the tokenizer allows it, texts are cut at safe places first,
    so one long text never makes a batch much larger and a repeated piece is
    encoded once. Null texts count as empty. Other columns are ignored; an empty table gives none.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(tokenizer_path, batch_bytes)
        for batch in gathered(batches):
            texts = text_array(batch.column(1))
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counter.count(texts.to_pylist()), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run, keeps=True), f"doc_id {kind}, n_bytes long, n_tokens long"
    )
    return counted.select(
        F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat's runs (starts, lengths) one after the other."""
    return flat[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]


_COUNTERS: dict[str, Counter] = {}


class CachedEncoder:
    """Ids of texts for a tokenizer that drops white space: each distinct piece is encoded once.

    Texts are cut at ASCII white space, which such a tokenizer drops and never
    joins over, so the pieces' ids in order are the text's. Pieces of more than
    PIECE_CHARS characters are forgotten after each batch. Where it folds case,
    A-Z are folded first. A new piece is put together from its word and the mark
    at its end where both are plain, and new plain words are encoded as one line,
    which end-of-word ids divide again.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.cuts = splits[0].get("behavior") == "Removed" and bool(splits[0].get("invert"))
        self.folds = self.cuts and "Lowercase" in kinds
        self.specials = [t["content"].lower().encode() for t in spec.get("added_tokens", [])]
        self.tokenizer = load(path)
        suffix = spec["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix and self.folds:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.most = most
        self.place: dict[str, int] = {}
        self.flat, self.edges = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _append(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))
        used = int(self.edges[-1])
        self.edges = np.concatenate([self.edges, used + np.cumsum(lengths)])
        if used + len(ids) > len(self.flat):
            # Twice the size, so that ids are copied a few times at most.
            self.flat = np.concatenate([self.flat[:used], np.zeros(used + 2 * len(ids), "<u4")])
        self.flat[used : used + len(ids)] = ids

    def _forget(self, most: int) -> None:
        """Keep the first `most` pieces."""
        if most < len(self.place) // 2:
            self.place = dict(islice(self.place.items(), most))
        while len(self.place) > most:
            self.place.popitem()
        self.edges = self.edges[: most + 1].copy()
        if len(self.flat) > 4 * int(self.edges[-1]):
            self.flat = self.flat[: self.edges[-1]].copy()

    def _runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.edges[places]
        return starts, self.edges[places + 1] - starts

    def _encode_words(self, words_: list[str]) -> None:
        plain = [w for w in words_ if _PLAIN.fullmatch(w)] if self.ends is not None else []
        lines = [plain[k : k + _LINE] for k in range(0, len(plain), _LINE)]
        found = [np.asarray(_encode(self.tokenizer, [" ".join(line)])[0], "<u4") for line in lines]
        ids = np.concatenate([np.zeros(0, "<u4"), *found])
        cuts = np.flatnonzero(self.ends[ids]) + 1 if plain else np.zeros(0, np.int64)
        if len(cuts) != len(plain):
            raise ValueError("words and end-of-word ids disagree")
        self._append(plain, ids, np.diff(cuts, prepend=0))
        rest = [w for w in words_ if w not in self.place]
        if rest:
            parts = _encode(self.tokenizer, rest)
            self._append(rest, np.array([i for ids in parts for i in ids], "<u4"), np.array([len(ids) for ids in parts]))

    def _learn(self, new: list[str]) -> None:
        whole, marked = [], []
        for piece in new:
            if self.ends is not None and piece[-1] in _MARKS and _PLAIN.fullmatch(piece, 0, len(piece) - 1):
                marked.append(piece)
            else:
                whole.append(piece)
        parts = {w for piece in marked for w in (piece[:-1], piece[-1])}.difference(self.place, whole)
        self._encode_words([*whole, *parts])
        if marked:
            pairs = np.array([[self.place[piece[:-1]], self.place[piece[-1]]] for piece in marked]).ravel()
            starts, lengths = self._runs(pairs)
            self._append(marked, _gather(self.flat, starts, lengths), lengths.reshape(-1, 2).sum(axis=1))

    def _places(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, all ids in order) of texts without nulls."""
        table = SPACED if self.folds else bytes(range(256))
        raw = mapped(texts, SPACED).buffers()[2].to_pybytes()
        if not self.cuts or any(special in raw for special in self.specials):
            found = _encode(self.tokenizer, texts.to_pylist())
            counts = np.array([len(ids) for ids in found], np.int64)
            return counts, np.array([i for ids in found for i in ids], "<u4")
        counts, codes, distinct = words(texts, table)
        names = distinct.to_pylist()
        places = self._places(names)
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            if len(self.place) + 2 * len(unknown) > self.most:
                # What came first is what texts hold most.
                self._forget(min(len(self.place), self.most * 3 // 4))
                places = self._places(names)
                unknown = np.flatnonzero(places < 0)
            new = [names[i] for i in unknown.tolist()]
            self._learn([w for w in new if len(w) <= PIECE_CHARS])
            remembered = len(self.place)
            self._learn([w for w in new if len(w) > PIECE_CHARS])
            places[unknown] = self._places(new)
        starts, lengths = self._runs(places[codes])
        edges = starts_of(lengths)[starts_of(counts)]
        ids = _gather(self.flat, starts, lengths)
        if len(unknown):
            self._forget(min(remembered, self.most))
        return np.diff(edges), ids


_ENCODERS: dict[str, CachedEncoder] = {}


KEPT += [_ENCODERS, _COUNTERS]


def worker_encoder(path: str) -> CachedEncoder:
    """The encoder for a file, kept over the tasks that a Python worker runs."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]
