"""Toxic spans by a linear-chain conditional random field with two states.

Labels exist for documents only, so tokens are labelled first: a word or a word
start that stands in toxic sample documents nearly alone, more often than chance
allows, marks its tokens there. The field is trained on those tokens (hashed word
and affix features, transitions) by exact gradients in numpy. Forward-backward
marginals of each whole text give its offending spans, and, through a logistic
fit on the same sample, its score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.arrowtext import ALNUM, gathered, starts_of, text_array, words
from tessella.llm.folds import hash_sample, held_out, with_texts
from tessella.llm.shared import bound_batches
from tessella.llm.workers import tidy

#: Labelled documents of each class that training sees at most, lowest hash first.
SAMPLE = 1500
#: Bytes of their texts of each class at most: of the sample in hash order, texts are taken as long as they fit.
SAMPLE_BYTES = 8_000_000
BUCKETS = 1 << 18
BLOCK = 128
#: Training sees segments of so many tokens, and about so many tokens in all.
SEGMENT = 64
TOKENS = 400_000
STEPS = 60
#: A marker's documents must be toxic to this share, were the classes of equal size.
PURITY = 0.95
#: Chance that any pattern passes as a marker by luck.
LUCK = 0.01
THRESHOLD = 0.7
_MEMO = 200_000
#: Bytes of text scored at a time: each token takes about 150 bytes of messages.
_GATHER = 2_000_000
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, its starts and its end."""
    names = ("w" + word, "a" + word[:4], "b" + word[:5], "c" + word[:6], "z" + word[-3:])
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def _patterns(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Field:
    """The trained field: feature weights, log potentials of start and transitions, and the document fit."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    start: float = -5.0
    #: Log odds of toxic after clean, and after toxic.
    after: tuple[float, float] = (-5.0, 0.0)
    fit: np.ndarray | None = None


def _steps(odds: np.ndarray, first: np.ndarray, model: Field) -> np.ndarray:
    """(n, 2, 2) step matrices: from state to state, with the token's emission; rows alike at a text's first token."""
    gain = np.exp(np.clip(odds, -40, 40))
    out = np.empty((len(odds), 2, 2))
    after = np.exp(np.array(model.after))
    out[:, 0, 0], out[:, 0, 1] = 1 / (1 + after[0]), gain * after[0] / (1 + after[0])
    out[:, 1, 0], out[:, 1, 1] = 1 / (1 + after[1]), gain * after[1] / (1 + after[1])
    begin = np.exp(model.start)
    out[first, :, 0], out[first, :, 1] = 1 / (1 + begin), (gain[first] * begin / (1 + begin))[:, None]
    return out / np.maximum(out.max(axis=(1, 2)), 1e-300)[:, None, None]


def _scan(steps: np.ndarray, backward: bool) -> np.ndarray:
    """(n, 2) normalised messages: after each step forward, or before the next step's end backward.

    Blocks of steps are multiplied side by side, their ends chained, and the
    messages within blocks filled in side by side: exact for any length.
    """
    n = len(steps)
    size = min(BLOCK, max(1, n))
    blocks = -(-n // size)
    full = np.broadcast_to(np.eye(2), (blocks * size, 2, 2)).copy()
    full[:n] = steps
    full = full.reshape(blocks, size, 2, 2)
    product = np.broadcast_to(np.eye(2), (blocks, 2, 2)).copy()
    order = range(size - 1, -1, -1) if backward else range(size)
    for k in order:
        product = full[:, k] @ product if backward else product @ full[:, k]
        product /= product.max(axis=(1, 2))[:, None, None]
    edge, vector = np.empty((blocks, 2)), np.array([0.5, 0.5])
    for b in range(blocks - 1, -1, -1) if backward else range(blocks):
        edge[b] = vector
        vector = product[b] @ vector if backward else vector @ product[b]
        vector = vector / vector.sum()
    out, state = np.empty((blocks, size, 2)), edge
    for k in order:
        if backward:
            out[:, k] = state
            state = np.einsum("bij,bj->bi", full[:, k], state)
        else:
            state = np.einsum("bi,bij->bj", state, full[:, k])
            out[:, k] = state
        state = state / state.sum(axis=1, keepdims=True)
        if not backward:
            out[:, k] = state
    return out.reshape(-1, 2)[:n]


def marginals(odds: np.ndarray, counts: np.ndarray, model: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(toxic) of each token, forward and backward messages) for texts of `counts` tokens in one flat array."""
    if not len(odds):
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    first = np.zeros(len(odds), bool)
    first[starts_of(counts)[:-1][counts > 0]] = True
    steps = _steps(odds, first, model)
    alpha, beta = _scan(steps, False), _scan(steps, True)
    joint = alpha * beta
    return joint[:, 1] / joint.sum(axis=1), alpha, beta


def _document_features(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 3): 1, the log odds of the likeliest token, the log of the expected toxic tokens."""
    out = np.zeros((len(counts), 3))
    out[:, 0] = 1
    full = np.flatnonzero(counts)
    top, total = np.zeros(len(counts)), np.zeros(len(counts))
    if len(p):
        cuts = starts_of(counts)[:-1][full]
        top[full], total[full] = np.maximum.reduceat(p, cuts), np.add.reduceat(p, cuts)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    out[:, 1], out[:, 2] = np.log(top / (1 - top)), np.log(total + 1e-4)
    return out


def _markers(pattern: np.ndarray, doc: np.ndarray, toxic: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Patterns (of pairs pattern, doc) that toxic documents of `use` hold and clean ones hardly do."""
    size = int(pattern.max()) + 1
    mine = use[doc]
    n = np.bincount(pattern[mine], minlength=size).astype(float)
    a = np.bincount(pattern[mine & toxic[doc]], minlength=size).astype(float)
    share = toxic[use].mean()
    if not 0 < share < 1:
        return np.zeros(size, bool)
    q = a / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = n * (np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0))
    pure = (a / share) / np.maximum(a / share + (n - a) / (1 - share), 1e-9) >= PURITY
    return pure & (q > share) & (surprise > np.log((a > 0).sum() / LUCK + 1))


def _unlike(distinct: list[str], codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """True for texts that aren't near copies of an earlier one: three of eight least word hashes agree.

    The words of a text copied often would look like markers.
    """
    hashes = np.array([zlib.crc32(w.encode()) for w in distinct], np.uint64)
    rng = np.random.default_rng(2)
    full = np.flatnonzero(counts)
    cuts = starts_of(counts)[:-1][full]
    least = np.stack([
        np.minimum.reduceat(((hashes ^ x) * k)[codes], cuts)
        for x, k in rng.integers(1, 2**63, (8, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ])
    seen: list[dict[int, int]] = [{} for _ in least]
    out = np.ones(len(counts), bool)
    for doc, column in zip(full.tolist(), least.T.tolist(), strict=True):
        met = [table.setdefault(value, doc) for table, value in zip(seen, column, strict=True)]
        earlier = [m for m in met if m != doc]
        out[doc] = max((earlier.count(m) for m in set(earlier)), default=0) < 3
    return out


def _mark_tokens(distinct: list[str], codes: np.ndarray, counts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels of the sample: tokens of marker patterns in toxic documents.

    A pattern may mark by itself, or only where a text holds it two or three times.
    """
    width = np.array([len(_patterns(w)) for w in distinct])
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(p) for w in distinct for p in _patterns(w)), np.uint64, width.sum())
    known, flat = np.unique(hashes, return_inverse=True)
    flat, patterns = flat.astype(np.int32), len(known)
    del hashes, known
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs, token, times = np.unique(owner * np.int64(len(distinct)) + codes, return_inverse=True, return_counts=True)
    doc, word = pairs // len(distinct), pairs % len(distinct)
    reps = width[word]
    at = np.repeat((starts_of(width)[:-1][word] - starts_of(reps)[:-1]).astype(np.int32), reps) + np.arange(reps.sum(), dtype=np.int32)
    at = flat[at] * np.int64(len(counts))
    at += np.repeat(doc, reps)
    seen, row = np.unique(at, return_inverse=True)
    del at
    occurs = np.bincount(row, weights=np.repeat(times, reps))
    pattern, holder = seen // len(counts), seen % len(counts)
    use, hit = _unlike(distinct, codes, counts), np.zeros(len(seen), bool)
    for least in (1, 2, 3):
        often = occurs >= least
        if often.any():
            marker = _markers(pattern[often], holder[often], toxic, use)
            hit |= often & np.append(marker, np.zeros(patterns, bool))[pattern]
    marked = np.logical_or.reduceat(hit[row], starts_of(reps)[:-1])
    return marked[token] & toxic[owner]


def _training_part(marked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens to train on, their segment lengths): all segments with a mark, and others up to TOKENS."""
    ends = starts_of(counts)
    cuts = np.unique(np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(ends[:-1], ends[1:], strict=True)]).astype(np.int64))
    sizes = np.diff(np.append(cuts, len(marked)))
    has = np.logical_or.reduceat(marked, cuts)
    order = np.concatenate([np.flatnonzero(has), np.random.default_rng(1).permutation(np.flatnonzero(~has))])
    order = np.sort(order[: max(1, np.searchsorted(np.cumsum(sizes[order]), TOKENS))])
    keep = np.repeat(cuts[order], sizes[order]) + np.arange(sizes[order].sum()) - np.repeat(starts_of(sizes[order])[:-1], sizes[order])
    return keep, sizes[order]


def train(texts: list[str], toxic: list[int], steps: int = STEPS) -> Field:
    """Fit a field on sample texts and their document labels. One class only gives a field that finds nothing."""
    model = Field()
    labels = np.array(toxic, bool)
    counts, codes, distinct = words(text_array(pa.array(texts, pa.string())), ALNUM)
    if not len(codes) or labels.all() or not labels.any():
        return model
    names = distinct.to_pylist()
    every, whole = codes, counts
    marked = _mark_tokens(names, codes, counts, labels)
    part, counts = _training_part(marked, counts)
    codes, marked = codes[part], marked[part].astype(float)
    features = np.array([word_features(w) for w in names])
    hit = np.bincount(codes, weights=marked, minlength=len(names))
    first = starts_of(counts)[:-1][counts > 0]
    keep = np.ones(len(codes), bool)
    keep[first] = False
    later = np.flatnonzero(keep)
    from_toxic = np.array([marked[later - 1] == 0, marked[later - 1] == 1])
    seen_after = [marked[later][from_toxic[k]].sum() for k in (0, 1)]
    seen_start = marked[first].sum()
    theta = {"w": np.zeros(BUCKETS), "t": np.array([model.start, *model.after])}
    mean, square = {k: np.zeros_like(v) for k, v in theta.items()}, {k: np.zeros_like(v) for k, v in theta.items()}
    for step in range(1, steps + 1):
        now = Field(theta["w"], float(theta["t"][0]), (float(theta["t"][1]), float(theta["t"][2])))
        word_odds = theta["w"][features].sum(axis=1)
        odds = word_odds[codes]
        p, alpha, beta = marginals(odds, counts, now)
        expected = np.bincount(codes, weights=p, minlength=len(names))
        slope = expected - hit
        grad_w = np.bincount(features.ravel(), weights=np.repeat(slope, features.shape[1]), minlength=BUCKETS)
        grad_w += 0.05 * theta["w"]
        pair = alpha[later - 1][:, :, None] * _steps(odds, ~keep, now)[later] * beta[later][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        both = pair.sum(axis=0)
        # A step from state i to toxic has the slope 1 - sigma(t_i), to clean -sigma(t_i); model minus sample.
        prior = 1 / (1 + np.exp(-theta["t"][1:]))
        modelled = both[:, 1] - prior * both.sum(axis=1)
        observed = np.array(seen_after) - prior * from_toxic.sum(axis=1)
        grad_t = np.array([p[first].sum() - seen_start, *(modelled - observed)])
        for key, grad in (("w", grad_w), ("t", grad_t)):
            mean[key] = 0.9 * mean[key] + 0.1 * grad
            square[key] = 0.99 * square[key] + 0.01 * grad**2
            theta[key] = theta[key] - 0.3 * (mean[key] / (1 - 0.9**step)) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-8)
    model = Field(theta["w"].astype(np.float32), float(theta["t"][0]), (float(theta["t"][1]), float(theta["t"][2])))
    word_odds, ends = theta["w"][features].sum(axis=1), starts_of(whole)
    model.fit = _logistic(np.concatenate([
        _document_features(marginals(word_odds[every[ends[k] : ends[min(k + 50, len(whole))]]], whole[k : k + 50], model)[0], whole[k : k + 50])
        for k in range(0, len(whole), 50)
    ]), labels.astype(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; slopes are not negative, so more evidence never lowers a score."""
    used = np.arange(x.shape[1])
    while True:
        part, beta = x[:, used], np.zeros(len(used))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(part @ beta, -30, 30)))
            slope = part.T @ (p - y) + 0.1 * beta
            beta -= np.linalg.solve(part.T @ (part * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(used)), slope)
        worst = 1 + int(beta[1:].argmin()) if len(used) > 1 else 0
        if not worst or beta[worst] >= 0:
            out = np.zeros(x.shape[1])
            out[used] = beta
            return out
        used = np.delete(used, worst)


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Offending spans in code points: runs of tokens that are toxic rather than not."""
    out: list[dict] = []
    previous = -2
    for k, found in enumerate(_TOKEN.finditer(text)):
        if p[k] < 0.5:
            continue
        if previous == k - 1:
            out[-1]["end"], out[-1]["p"] = found.end(), max(out[-1]["p"], float(p[k]))
        else:
            out.append({"start": found.start(), "end": found.end(), "p": float(p[k])})
        previous = k
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Field = shared.value
        memo: dict[str, float] = {}
        for batch in gathered(batches, _GATHER):
            texts = text_array(batch.column(1))
            counts, codes, distinct = words(texts, ALNUM)
            names = distinct.to_pylist()
            if len(memo) > _MEMO:
                memo.clear()
            new = [w for w in names if w not in memo]
            if new:
                memo.update(zip(new, model.weights[np.array([word_features(w) for w in new])].sum(axis=1).tolist(), strict=True))
            odds = np.fromiter(map(memo.__getitem__, names), float, len(names))
            p, _, _ = marginals(odds[codes] if len(codes) else np.zeros(0), counts, model)
            starts = starts_of(counts)
            if model.fit is None:
                score = np.zeros(len(counts))
            else:
                score = 1 / (1 + np.exp(-np.clip(_document_features(p, counts) @ model.fit, -30, 30)))
            owner = np.repeat(np.arange(len(counts)), counts)
            spans: list[list[dict]] = [[] for _ in range(len(counts))]
            for doc in np.unique(owner[p >= 0.5]):
                spans[doc] = _spans(texts[int(doc)].as_py(), p[starts[doc] : starts[doc + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array(spans, _SPAN)], ["doc_id", "score", "spans"]
            )

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE,
    sample_bytes: int = SAMPLE_BYTES,
) -> Field:
    """A field trained on at most `sample` labelled documents of each class outside the held-out fold.

    The sample is taken by hash of the id, so it doesn't depend on row order; its
    texts have at most sample_bytes a class. Null labels, ids and texts are left out.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(
        ~held_out(id_col) & F.col(id_col).isNotNull()
    )
    chosen = hash_sample(known.where("label in (0, 1)").distinct(), id_col, sample)
    texts = with_texts(chosen, docs, id_col, text_col).withColumn("size", F.octet_length("sample_text")).where(F.col("size") <= sample_bytes)
    in_order = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col, "sample_text").rowsBetween(Window.unboundedPreceding, 0)
    rows = texts.withColumn("total", F.sum("size").over(in_order)).where(F.col("total") <= sample_bytes).collect()
    rows = sorted(rows, key=lambda r: (r[id_col], r["label"], r["sample_text"]))
    return train([r["sample_text"] for r in rows], [r["label"] for r in rows])


def toxicity(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, spans), a row for each row of docs.

    spans: start and end in code points and the highest marginal of each offending
    run of tokens. Only the text decides. Null and empty texts, or texts without
    tokens, get the score of a text in which nothing was found. Other columns are
    ignored; an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(_score(shared)), f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>"
    )
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select(F.col("doc_id").alias(id_col), "score", predicted, "spans")
