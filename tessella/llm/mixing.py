"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a hash-random key, of its id and text. Within a source, documents are dealt to
ranges of that key, so that a source with a third of all rows is many ranges;
word counts are summed per range, ranges are accumulated per source, and rows
only within their range. A source's words are taken in key order up to its
budget; budgets above the source's size repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import kept, small

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix"
#: Rows of one range of keys, on average.
RANGE_ROWS = 4_000
_KEY_SPAN = 16**6


def word_count(text: str | Column) -> Column:
    """Words between the bytes 20 and 09-0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """sources (source, source_size) with target (double) and budget (long).

    Sources by code point, null last, weigh `weights` in turn. Together they get
    `share` of all words, by weight; none gets more than `repeats` times its
    size, and what a source can't take is shared again by weight. A row per
    source, so the windows below stay as small as the list of sources.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(in_order) - 1) % len(weights) + 1
    weighed = sources.withColumn("w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), place)).withColumn(
        "cap", F.col("source_size") * repeats
    )
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = (
        weighed.withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("below", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap") / F.col("w") * F.col("open") + F.col("below") <= F.col("pool"))
        .withColumn("spent", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("left", F.sum(F.when(~F.col("full"), F.col("w"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("w") * (F.col("pool") - F.col("spent")) / F.col("left")
    )
    return filled.select("source", "source_size", target.alias("target")).withColumn(
        "budget", F.floor("target").cast("long")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of docs.

    taken is the words that the mix takes of the document, repeats counted; only
    the document at a source's cut is taken in part. Null sources are one source;
    null or empty texts have size 0 and nothing is taken of them. Rows with equal
    id and text may swap their counts; otherwise reruns agree. Other columns are
    ignored; an empty table gives none.
    """
    return _counted(docs, id_col, text_col, source_col, weights, share, repeats, seed, range_rows)


def _counted(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    seed: str = SEED,
    range_rows: int = RANGE_ROWS,
    tie: str | None = None,
    row: str | None = None,
) -> DataFrame:
    """mix(), with docs' column `tie` deciding between equal ids and sizes, and its column `row` passed on."""
    own = [c for c in (tie, row) if c]
    # The text's checksum deals rows without an id, and rows of a repeated one, to many ranges.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")))))
    sized = kept(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"), key.alias("key"), *own,
        ),
        "sized",
    )
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = kept(sources, "sources")
    targets = source_targets(sources.select("source", "source_size"), weights, share, repeats)
    plan = targets.join(
        sources.select(F.col("source").alias("s"), F.ceil(F.col("docs") / range_rows).alias("ranges")),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    plan = small(kept(plan, "targets"))
    place = F.conv(F.substring("key", 1, 6), 16, 10).cast("long")
    placed = sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "range", F.floor(place * F.col("ranges") / _KEY_SPAN)
    )
    sums = placed.groupBy("s", "range").agg(F.sum("size").alias("words"))
    before_range = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("s").alias("s_"), F.col("range").alias("range_"),
        F.coalesce(F.sum("words").over(before_range), F.lit(0)).alias("offset"),
    )
    within = (
        Window.partitionBy("s", "range").orderBy("key", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = placed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        small(kept(offsets, "offsets")),
        (F.col("range") == F.col("range_")) & F.col("s").eqNullSafe(F.col("s_")),
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    taken = epochs * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return counted.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *([row] if row else [])
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs as the mix takes them: once for each whole take, and the words of a part.

    A part's words are joined by single spaces. Ids may be null or repeated: rows
    are numbered, written with their number and joined by it. Of equal ids and
    sizes, the checksum of the text decides which is cut.
    """
    row, sum_, whole, part, take = (f"mix_{name}" + "_" * max(map(len, docs.columns)) for name in ("row", "sum", "whole", "part", "take"))
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(sum_, F.xxhash64(text_col))
    numbered = kept(numbered, "numbered")
    counts = _counted(numbered, id_col, text_col, tie=sum_, row=row, **settings).where("taken > 0")
    counts = counts.select(row, F.expr("taken div size").alias(whole), F.expr("taken % size").cast("int").alias(part))
    parts = F.concat(
        F.array_repeat(F.lit(-1), F.col(whole).cast("int")),
        F.when(F.col(part) > 0, F.array(part)).otherwise(F.array().cast("array<int>")),
    )
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col(take) < 0, F.col(text_col)).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.greatest(take, F.lit(1))), " ")
    )
    return numbered.join(counts, row).withColumn(take, F.explode(parts)).withColumn(text_col, cut).select(*docs.columns)
