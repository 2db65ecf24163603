"""Which rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import kept, small


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text, mod 3, is 1: no model learns from such rows. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def with_texts(chosen: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chosen (a bounded sample: id_col, label) with the texts of docs; of a repeated id, the least text."""
    texts = docs.select(F.col(id_col), F.col(text_col).alias("sample_text")).where(F.col(text_col).isNotNull())
    found = texts.join(small(kept(chosen, "chosen")), id_col)
    return found.groupBy(id_col, "label").agg(F.min("sample_text").alias("sample_text"))


def hash_sample(known: DataFrame, id_col: str, sample: int) -> DataFrame:
    """At most `sample` rows of each label of known (id_col, label), lowest hash of the id first.

    Labels are counted first, and only rows whose hash lies under what `sample` rows
    of the label need, with room to spare, are ranked: a label's window holds about
    `sample` rows however many the table has. known is read twice.
    """
    # Six standard deviations of the count above it: the hash is as good as random.
    wanted = sample + 6 * sample**0.5 + 40
    counts = known.groupBy("label").agg((F.lit(wanted) / F.count("*")).alias("share"))
    place = F.shiftrightunsigned(F.xxhash64(id_col), 1) / F.lit(float(2**63))
    near = known.join(small(kept(counts, "labels")), "label").where(place <= F.col("share"))
    first = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col)
    return near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= sample).select(id_col, "label")
