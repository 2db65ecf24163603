"""Language of texts by a convolutional network over bytes.

Bytes are embedded, filters of several widths slide over them, each filter's
maximum over a window is kept, and a softmax over languages follows. The network
is trained in numpy on windows of labelled texts. A text is cut into windows of a
fixed length, windows are scored in batches, and a text's language is that of
the highest mean log probability, windows weighing by their bytes.

Applied, the embedding and a filter's weights for two neighbouring bytes are one
table of 65,536 rows, so a filter of width 4 is two look-ups.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrowtext import SPACED, gathered, mapped, text_array
from tessella.llm.folds import hash_sample, held_out, with_texts
from tessella.llm.shared import bound_batches
from tessella.llm.workers import tidy

#: Bytes of a window.
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled documents of each language, and windows of each, that training sees at most.
SAMPLE = 500
SAMPLE_WINDOWS = 4
EPOCHS = 8
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = 32
#: Windows scored at a time.
_BATCH = 256


@dataclass
class Network:
    """Languages and weights: embedding (256, E), per width filters (width, E, F) and bias, and the last layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables of its filters' sums: over pairs of bytes, and a single byte if the width is odd."""
        found = {}
        for width, w in self.filters.items():
            single = [self.embedding @ w[k] for k in range(width)]
            parts = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, width - 1, 2)]
            found[width] = [np.ascontiguousarray(t, np.float32) for t in parts + single[width - width % 2 :]]
        return found


def windows(raw: bytes, length: int = LENGTH) -> np.ndarray:
    """raw as rows of `length` bytes, the last filled with spaces; one row at least."""
    rows = max(1, -(-len(raw) // length))
    return np.frombuffer(raw.ljust(rows * length, b" "), np.uint8).reshape(rows, length)


def _pooled(x: np.ndarray, width: int, tables: list[np.ndarray]) -> np.ndarray:
    """Maximum of each filter over each row of bytes."""
    pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    n = x.shape[1] - width + 1
    total = tables[0][pair[:, :n]]
    for k, table in enumerate(tables[1:], 1):
        total += table[(pair if len(table) > 256 else x)[:, 2 * k : 2 * k + n]]
    return total.max(axis=1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_probabilities(x: np.ndarray, net: Network, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Log probability of each language for each row of bytes."""
    out = np.empty((len(x), len(net.languages)))
    for k in range(0, len(x), _BATCH):
        part = x[k : k + _BATCH]
        hidden = [np.maximum(_pooled(part, w, tables[w]) + net.bias[w], 0) for w in net.filters]
        out[k : k + _BATCH] = _log_softmax(np.concatenate(hidden, axis=1) @ net.out + net.out_bias)
    return out


def sample_windows(text: str) -> np.ndarray:
    """At most SAMPLE_WINDOWS windows of a text, drawn by a hash of it."""
    raw = text.encode()
    every = windows(raw.translate(SPACED))
    return every[np.random.default_rng(zlib.crc32(raw)).permutation(len(every))[:SAMPLE_WINDOWS]]


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train on windows of sample texts."""
    return train_windows([sample_windows(t) for t in texts], labels, epochs, seed)


def train_windows(samples: list[np.ndarray], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Train on windows, an array of them for each label. Without any, the network knows no language."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        {w: rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS},
        {w: np.zeros(FILTERS) for w in WIDTHS},
        rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))),
        np.zeros(len(languages)),
    )
    if len(languages) < 2:
        return net
    x = np.concatenate(samples)
    y = np.repeat([languages.index(label) for label in labels], [len(s) for s in samples])
    theta = {"e": net.embedding, "o": net.out, "c": net.out_bias}
    theta |= {f"f{w}": net.filters[w] for w in WIDTHS} | {f"b{w}": net.bias[w] for w in WIDTHS}
    mean, square = {k: np.zeros_like(v) for k, v in theta.items()}, {k: np.zeros_like(v) for k, v in theta.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 64):
            rows, step = order[k : k + 64], step + 1
            part = x[rows]
            grad = {k: np.zeros_like(v) for k, v in theta.items()}
            pooled, places = {}, {}
            for w in WIDTHS:
                pooled[w], places[w] = _training_pooled(part, net, w)
            hidden = {w: np.maximum(pooled[w] + net.bias[w], 0) for w in WIDTHS}
            h = np.concatenate([hidden[w] for w in WIDTHS], axis=1)
            p = np.exp(_log_softmax(h @ net.out + net.out_bias))
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad["o"], grad["c"] = h.T @ p, p.sum(axis=0)
            back = p @ net.out.T
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS] * (hidden[w] > 0)
                grad[f"b{w}"] = g.sum(axis=0)
                for o in range(w):
                    byte = part[np.arange(len(rows))[:, None], places[w] + o]
                    grad[f"f{w}"][o] = np.einsum("nfe,nf->ef", net.embedding[byte], g)
                    np.add.at(grad["e"], byte, g[:, :, None] * net.filters[w][o].T[None])
            for key, g in grad.items():
                mean[key] = 0.9 * mean[key] + 0.1 * g
                square[key] = 0.99 * square[key] + 0.01 * g**2
                theta[key] -= 0.01 * (mean[key] / (1 - 0.9**step)) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-8)
    return net


def _training_pooled(part: np.ndarray, net: Network, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(pooled, places) of a training batch, from single-byte tables: pair tables change too often to build."""
    n = part.shape[1] - width + 1
    total = sum(((net.embedding @ net.filters[width][o]).astype(np.float32))[part[:, o : o + n]] for o in range(width))
    at = total.argmax(axis=1)
    return np.take_along_axis(total, at[:, None, :], axis=1)[:, 0], at


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> Network:
    """A network trained on at most `sample` documents of each language outside the held-out fold.

    The sample is taken by hash of the id, so it doesn't depend on row order, and
    only its windows reach the driver. Null ids, texts and languages are left out;
    an id of several languages counts as the first of them.
    """
    known = docs.where(
        ~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    ).select(F.col(id_col), F.col(lang_col).alias("label"))
    chosen = hash_sample(known, id_col, sample).groupBy(id_col).agg(F.min("label").alias("label"))
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 4_000_000, 2):
            parts = [sample_windows(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["id", "label", "windows"])

    texts = with_texts(chosen, docs, id_col, text_col).select(F.col(id_col).cast("string"), F.col("label").cast("string"), "sample_text")
    rows = sorted(tuple(r) for r in texts.mapInArrow(tidy(cut), "id string, label string, windows binary").collect())
    samples = [np.frombuffer(bytes(w), np.uint8).reshape(-1, LENGTH) for _, _, w in rows]
    return train_windows(samples, [label for _, label, _ in rows])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = shared.value
        tables = net.tables()
        for batch in gathered(batches, 4_000_000):
            texts = text_array(batch.column(1))
            has_letter = [bool(_LETTER.search(t)) for t in texts.to_pylist()]
            raws = mapped(texts, SPACED).cast(pa.binary()).to_pylist()
            cut = [windows(r) for r in raws]
            lang, score = [UNKNOWN] * len(raws), [0.0] * len(raws)
            if net.languages and raws:
                found = log_probabilities(np.concatenate(cut), net, tables)
                at = 0
                for row, (raw, part) in enumerate(zip(raws, cut, strict=True)):
                    mine, at = found[at : at + len(part)], at + len(part)
                    if has_letter[row]:
                        weight = np.full(len(part), float(LENGTH))
                        weight[-1] = len(raw) - LENGTH * (len(part) - 1)
                        mean = (weight @ mine) / weight.sum()
                        p = np.exp(mean - mean.max())
                        best = int(p.argmax())
                        lang[row], score[row] = net.languages[best], float(p[best] / p.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return run


def languages(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of docs.

    score is the probability of lang_pred by the mean of the windows' log
    probabilities. Null and empty texts and texts without a letter are `und` with
    score 0, as are all if the network knows no language. Only the text decides.
    Other columns are ignored; an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(_predict(shared)), f"doc_id {kind}, lang_pred string, score double"
    )
    return found.withColumnRenamed("doc_id", id_col)
