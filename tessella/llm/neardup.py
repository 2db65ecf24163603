"""MinHash near-duplicates through a signature-coordinate inverted join.

Documents are posted under each (coordinate, minimum) pair of their signature.
A pair of documents is a candidate if at least MATCHES of the COORDINATES agree,
and a link if the Jaccard similarity of the full shingle sets reaches the limit.

* Equal sets are one class, and classes are what is posted.
* Posts that stand alone cannot collide, so they go; a class left with fewer
  than MATCHES posts is skipped.
* The other posts are ordered by rarity; two classes with MATCHES common posts
  meet in the first (posts - MATCHES + 1) of each, so only that prefix is joined.
* Each post's classes are first merged with the post's best connected class (a
  star: linear in the post's length), which unites groups of copies.
* Pairs that are still apart are met in the posts that hold both. Posts of up to
  SHORT classes give their pairs. The classes of longer ones are dealt to blocks,
  and two blocks that share a post are compared in one task of a bounded size, so
  no pair of a long post is ever written unless it is a link.
* Collisions of a pair's signatures are counted before its sets are compared,
  pairs below MATCHES go, and every link is confirmed on full sets.

Two texts of similarity 0.75 agree in fewer than 28 of 64 coordinates with a
chance of 2.5e-8, the method's only way to lose a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.arrowtext import SPACED, gathered, starts_of, text_array, word_hashes, words
from tessella.llm.components import components
from tessella.llm.shared import bound_batches, kept, small
from tessella.llm.workers import tidy

WIDTH = 5
COORDINATES = 64
MATCHES = 28
SIMILAR = (75, 100)
#: Classes of a post whose pairs are made directly: no more than one and a half for each class.
SHORT = 4
#: Classes of one side of a comparison of what longer posts hold.
BLOCK = 512

#: Bytes of text hashed at a time.
GATHER = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _coordinate_keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (
        rng.integers(0, 2**64, n, dtype=np.uint64),
        rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1),
    )


def shingle_hashes(texts: pa.StringArray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of each text with repeats, 64-bit hash of each shingle in order).

    A text of fewer words than `width`, but not none, has its whole sequence as one.
    """
    counts, codes, distinct = words(texts, SPACED)
    if not len(codes):
        return counts, np.zeros(0, np.uint64)
    hashes = word_hashes(distinct)[codes]
    starts = starts_of(counts)[:-1]
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.repeat(starts, shingles) + (
        np.arange(shingles.sum()) - np.repeat(starts_of(shingles)[:-1], shingles)
    )
    span = np.repeat(np.minimum(counts, width), shingles)
    value = span.astype(np.uint64) * _MIX
    for k in range(width):
        at = np.minimum(first + k, len(hashes) - 1)
        value = np.where(k < span, _mixed(value * np.uint64(5) + hashes[at] + np.uint64(k + 1)), value)
    return shingles, value


def _set_rows(shingles: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    ends = starts_of(shingles)
    return [np.unique(value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _sign(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xors, odds = _coordinate_keys(coordinates)
        for batch in gathered(batches, GATHER):
            shingles, value = shingle_hashes(text_array(batch.column(1)), width)
            sets = _set_rows(shingles, value)
            full = np.flatnonzero(shingles)
            signature = np.zeros((len(full), coordinates), np.uint32)
            if len(full):
                cuts = starts_of(shingles)[full]
                for i in range(coordinates):
                    low = np.minimum.reduceat((value ^ xors[i]) * odds[i], cuts)
                    signature[:, i] = (_mixed(low) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = np.full(len(shingles), -1)
            rows[full] = np.arange(len(full))
            signs = signature.view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signs[r] if r >= 0 else None for r in rows], pa.list_(pa.int32())),
                ],
                ["id", "row_key", "n", "class", "sign"],
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, GATHER, 0):
            sets = _set_rows(*shingle_hashes(text_array(batch.column(0)), width))
            packed = [s.tobytes() for s in sets]
            digests = [xxhash.xxh3_128_digest(s) for s in packed]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["class", "items"])

    return run


def _linked(common: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    return SIMILAR[1] * common >= SIMILAR[0] * (a + b - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs whose full sets are similar enough."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x = np.frombuffer(a.as_buffer(), np.uint64)
            y = np.frombuffer(b.as_buffer(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(bool(_linked(common, len(x), len(y))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(
            pa.array(keep, pa.bool_())
        )


def _compare_blocks(matches: int):
    """Links between the classes of two blocks that aren't one component already: a forest."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        left = block[block.side == 0].reset_index(drop=True)
        alone = bool(block.alone.iloc[0])
        right = left if alone else block[block.side == 1].reset_index(drop=True)
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        parent = {x: x for x in pd.concat([left.label, right.label]).unique()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets = [np.frombuffer(x, np.uint64) for x in right["items"]]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
        signs = np.stack(right.sign.to_numpy())
        found = []
        for i, (items, sign, label) in enumerate(zip(left["items"], left.sign, left.label, strict=True)):
            agree = (signs == np.asarray(sign)[None, :]).sum(axis=1) >= matches
            if alone:
                agree[: i + 1] = False
            agree &= right.label.to_numpy() != label
            if not agree.any():
                continue
            own = np.frombuffer(items, np.uint64)
            low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            reps = high - low
            at = np.repeat(low, reps) + np.arange(reps.sum()) - np.repeat(starts_of(reps)[:-1], reps)
            common = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero(agree & _linked(common, len(own), sizes)):
                a, b = root(label), root(right.label[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((left.node[i], right.node[j]))
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    return run


def _agreeing(a: str, b: str) -> Column:
    equal = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(equal, F.lit(0), lambda n, x: n + x)


def _prefix_posts(classes: DataFrame, matches: int) -> DataFrame:
    """(node, key, rank): the posts that a document must share with any candidate.

    rank grows with the length of all the document's posts: the most connected
    document of a post has the greatest.
    """
    post = classes.select("node", F.posexplode("sign").alias("at", "low")).select(
        "node", F.expr("shiftleft(cast(at as bigint), 32) | (cast(low as bigint) & 4294967295)").alias("key")
    )
    shared = post.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    live = (
        post.join(shared, "key")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("length", "key"))).alias("posts"), F.sum("length").alias("rank"))
        .where(F.size("posts") >= matches)
    )
    prefix = F.slice("posts", 1, F.size("posts") - matches + 1)
    return live.select("node", "rank", F.explode(prefix).alias("post")).select("node", "rank", "post.key")


def _apart(posts: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, size, length) of the posts that hold classes of several components."""
    labelled = posts.select("key", "node").join(labels, "node")
    live = labelled.groupBy("key").agg(F.count("*").alias("length"), F.min("label").alias("a"), F.max("label").alias("b"))
    return labelled.join(live.where("a <> b").select("key", "length"), "key")


def _pairs(posts: DataFrame) -> DataFrame:
    """(u, v) of different components that share a short post and whose sizes may be similar enough."""
    one = posts.select("key", F.col("node").alias("u"), F.col("label").alias("lu"), F.col("size").alias("nu"))
    two = posts.select("key", F.col("node").alias("v"), F.col("label").alias("lv"), F.col("size").alias("nv"))
    near = SIMILAR[1] * F.least("nu", "nv") >= SIMILAR[0] * F.greatest("nu", "nv")
    return one.join(two, "key").where((F.col("u") < F.col("v")) & (F.col("lu") != F.col("lv")) & near).select("u", "v").distinct()


def _tasks(posts: DataFrame, block: int) -> DataFrame:
    """The classes of long posts (key, node, label) dealt to tasks: (task, alone, side, node, label), two blocks a task.

    A component above half a block gets blocks of its own, never compared with
    each other; smaller ones are packed by a hash of their label within what long
    posts connect. Two blocks meet only if some post holds classes of both.
    """
    edges = posts.join(posts.groupBy("key").agg(F.min("node").alias("hub")), "key").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    family = components(edges).toDF("node", "family")
    members = kept(posts.select("node", "label").distinct().join(family, "node"), "members")
    by_label = members.groupBy("family", "label").agg(F.count("*").alias("size")).withColumn("large", F.col("size") > block // 2)
    packed = by_label.where("not large").groupBy("family").agg(F.sum("size").alias("packed"))
    half = F.lit(block / 2.0)
    dealt = kept(
        members.join(by_label, ["family", "label"]).join(packed, "family", "left")
        .withColumn("parts", F.ceil(F.when(F.col("large"), F.col("size")).otherwise(F.col("packed")) / half))
        .withColumn("part", F.pmod(F.xxhash64(F.when(F.col("large"), F.col("node")).otherwise(F.col("label"))), "parts"))
        .withColumn("own", F.when(F.col("large"), F.col("label")))
        .select("node", "label", "own", F.xxhash64("family", "own", "part").alias("block")),
        "dealt",
    )
    held = kept(posts.select("key", "node").join(dealt, "node").select("key", "block", "own").distinct(), "held")
    met = held.toDF("key", "b1", "own1").join(held.toDF("key", "b2", "own2"), "key").where("b1 <= b2")
    apart = F.col("own1").isNull() | F.col("own2").isNull() | (F.col("own1") != F.col("own2"))
    # A block is compared with itself unless one component fills it.
    pairs = met.where(apart).select("b1", "b2").distinct()
    sides = pairs.select(
        F.xxhash64("b1", "b2").alias("task"), (F.col("b1") == F.col("b2")).alias("alone"),
        F.explode(F.array(F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")), F.struct(F.col("b2").alias("block"), F.lit(1).alias("side")))).alias("s"),
    ).where("not (alone and s.side = 1)").select("task", "alone", "s.*")
    return sides.join(dealt.select("block", "node", "label"), "block").select("task", "alone", "side", "node", "label")


def _confirmed(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links."""
    return (
        pairs.select("u", "v")
        .join(items.select(F.col("node").alias("u"), F.col("items").alias("u_items")), "u")
        .join(items.select(F.col("node").alias("v"), F.col("items").alias("v_items")), "v")
        .select("u", "v", "u_items", "v_items")
        .mapInArrow(tidy(_confirm), "u long, v long")
    )


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label, size) after uniting the components that links join."""
    label = labels.select("node", "label")
    across = links.join(label.toDF("u", "lu"), "u").join(label.toDF("v", "lv"), "v").select(
        F.col("lu").alias("u"), F.col("lv").alias("v")
    )
    merged = components(across).toDF("label", "merged")
    return labels.join(merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"), "size")


def _united(classes: DataFrame, own: DataFrame, width: int, matches: int, short: int, block: int) -> DataFrame:
    """(node, label) of the classes that have a candidate: label is the smallest class that links reach."""
    posts = kept(_prefix_posts(classes, matches), "posts")
    hubs = posts.groupBy("key").agg(F.max(F.struct("rank", (-F.col("node")).alias("hub"))).alias("h"))
    hubs = hubs.select("key", (-F.col("h.hub")).alias("hub"))
    stars = kept(posts.join(hubs, "key").where("node <> hub").select("node", "hub").distinct(), "stars")
    active = kept(stars.select("node").union(stars.select("hub")).distinct(), "active")
    live = kept(classes.join(small(active), "node", "left_semi"), "live")
    rows = own.join(small(live.select("row_key")), "row_key", "left_semi").select("text")
    sets = rows.mapInArrow(tidy(_full_sets(width)), "class binary, items binary")
    items = kept(sets.join(small(live.select("class", "node")), "class").select("node", "items").dropDuplicates(["node"]), "items")
    signs = live.select("node", "sign")

    def colliding(pairs: DataFrame) -> DataFrame:
        both = pairs.join(signs.toDF("u", "u_sign"), "u").join(signs.toDF("v", "v_sign"), "v")
        return both.select("u", "v", _agreeing("u_sign", "v_sign").alias("agree")).where(F.col("agree") >= matches)

    linked = _confirmed(colliding(stars.toDF("u", "v")), items)
    first = kept(components(linked).toDF("node", "label"), "first")
    labels = kept(
        live.select("node", F.col("n").alias("size")).join(first, "node", "left")
        .select("node", F.coalesce("label", "node").alias("label"), "size"),
        "labels",
    )
    apart = kept(_apart(posts, labels), "apart")
    short_links = _confirmed(colliding(_pairs(apart.where(F.col("length") <= short))), items)
    long_links = (
        _tasks(apart.where(F.col("length") > short), block).join(items, "node").join(signs, "node")
        .groupBy("task").applyInPandas(_compare_blocks(matches), "u long, v long")
    )
    return _relabelled(labels, kept(short_links.union(long_links), "links")).select("node", "label")


def _tied(signed: DataFrame, labelled: DataFrame) -> DataFrame:
    """labelled after uniting the components that rows of one id lie in."""
    spread = signed.where("n > 0 and id is not null").groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b"))
    spread = kept(spread.where("a <> b").select("id"), "spread")
    if not spread.count():
        return labelled
    places = signed.where("n > 0").join(small(spread), "id").select("id", "class").distinct()
    places = kept(places.join(labelled.select("class", "label"), "class").select("id", "label").distinct(), "places")
    hub = places.groupBy("id").agg(F.min("label").alias("hub"))
    tied = components(places.join(hub, "id").select(F.col("label").alias("u"), F.col("hub").alias("v")))
    joined = labelled.join(tied.toDF("label", "tied"), "label", "left")
    return kept(joined.select("class", "node", F.coalesce("tied", "label").alias("label"), "least"), "labelled")


def _rows(docs: DataFrame, id_col: str, text_col: str, width: int, coordinates: int, matches: int, short: int, block: int, ties: bool = True) -> DataFrame:
    """(id, row_key, n, component, least): for each row its component's number (null without shingles) and smallest id.

    ties: rows of one id are one document, so that an id in several classes joins them.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.withColumn("row_key", F.xxhash64("id", "text"))
    signed = kept(
        own.select("id", "text", "row_key").mapInArrow(
            tidy(_sign(width, coordinates)), "id long, row_key long, n long, class binary, sign array<int>"
        ),
        "signed",
    )
    classes = kept(
        signed.where("n > 0").groupBy("class")
        .agg(F.min("id").alias("least"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("sign").alias("sign"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    labels = _united(classes, own, width, matches, short, block)
    labelled = kept(
        classes.select("class", "node", "least").join(labels, "node", "left")
        .select("class", "node", F.coalesce("label", "node").alias("label"), "least"),
        "labelled",
    )
    if ties:
        labelled = _tied(signed, labelled)
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_class = kept(labelled.join(smallest, "label").select("class", "label", "component_id"), "component")
    whole = signed.where("n > 0").join(by_class, "class").select(
        "id", "row_key", "n", F.col("label").alias("component"), F.col("component_id").alias("least")
    )
    none = signed.where("n = 0").select("id", "row_key", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("least"))
    return whole.union(none)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    short: int = SHORT,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs.

    component_id is the smallest id that links reach, itself included; kept marks
    the rows whose id that is. Null or empty texts have no shingles and are linked
    with nothing. Equal sets are one class and compared once. Rows that repeat an
    id are one document for the links, whatever their texts; a null id is never the
    smallest: such a row's component is its group's, or null. Other columns are
    ignored; an empty table gives none. The id is an integer.
    """
    bound_batches(docs.sparkSession)
    return _rows(docs, id_col, text_col, width, coordinates, matches, short, block).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def deduplicated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
    short: int = SHORT,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of docs, one of each group of near copies: that of the smallest id, null last, then by the text's hash.

    Rows without shingles all stay. Rows are grouped by their texts alone: unlike
    texts under one id, or under none, all stay.
    """
    bound_batches(docs.sparkSession)
    found = kept(_rows(docs, id_col, text_col, width, coordinates, matches, short, block, ties=False).where("n > 0"), "rows")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row_key")
    best = found.groupBy("component").agg(F.min(order).alias("best"))
    judged = found.join(best, "component").withColumn("stays", order == F.col("best"))
    gone = kept(judged.where("not stays").select("id", "row_key").distinct(), "gone")
    again = judged.where("stays").groupBy("component").agg(F.count("*").alias("n"), F.first("best").alias("best")).where("n > 1")
    again = kept(again.select(F.col("best.id").alias("id"), F.col("best.row_key").alias("row_key")), "again")
    key = "dedup_row_key" + "_" * max(map(len, docs.columns))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)))

    def same(other: DataFrame) -> Column:
        return (keyed[key] == other["row_key"]) & keyed[id_col].cast("long").eqNullSafe(other["id"])

    gone, again = small(gone), small(again)
    rest = keyed.join(gone, same(gone), "left_anti")
    if not again.count():
        return rest.select(*docs.columns)
    once = rest.join(again, same(again), "left_anti").select(*docs.columns)
    more = rest.join(again, same(again), "left_semi").dropDuplicates([id_col, key])
    return once.unionByName(more.select(*docs.columns))
