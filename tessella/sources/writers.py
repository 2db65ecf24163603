"""Writers: tables sorted for lookups, reports, extracts, and tables that are rebuilt only when inputs changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.readers import input_stamp


def by_cell(places: DataFrame, path: str, partitions: int | None = None) -> None:
    """Places in order of grid cell and id, with new ids without gaps in that order.

    Rows are ranged by cell; per-cell counts, accumulated, give each cell its first id.
    """
    counts = places.groupBy("cell").agg(F.count("*").alias("n"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("cell").orderBy("pid")
    numbered = places.join(offsets, "cell").withColumn("id", F.col("before") + F.row_number().over(within)).drop("before")
    ranged = numbered.repartitionByRange(partitions, "cell", "id") if partitions else numbered.repartitionByRange("cell", "id")
    ranged.sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(path)


def by_term(postings: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Postings as a table bucketed and sorted by term, one file a bucket: lookups and joins on it don't shuffle, and read few row groups."""
    writer = postings.repartition(buckets, "term").write.mode("overwrite").option("parquet.block.size", 8 << 20)
    writer = writer.option("path", path) if path else writer
    writer.bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def corpus(articles: DataFrame, chunks: DataFrame, postings: DataFrame, path: str, prefix: str, buckets: int = 64) -> None:
    """A corpus: articles and chunks as files by article, postings and document frequencies as tables `prefix`_postings and _df by term.

    All files lie under path, those of the tables too: they live as long as it does.
    """
    articles.repartitionByRange("article_id").sortWithinPartitions("article_id").write.mode("overwrite").parquet(f"{path}/articles")
    chunks.repartitionByRange("article_id").sortWithinPartitions("article_id", "start").write.mode("overwrite").parquet(f"{path}/chunks")
    by_term(postings, f"{prefix}_postings", buckets, f"{path}/postings")
    by_term(postings.groupBy("term").agg(F.count("*").alias("doc")), f"{prefix}_df", buckets, f"{path}/df")


def parquet(rows: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Parquet files whose row groups have about group_bytes, so that a lookup reads little."""
    rows.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def report(rows: DataFrame, order: list[str], digits: int = 2, markdown: bool = True) -> DataFrame:
    """(line) of a report table, head first: Markdown rows, or tab-separated ones. For the few rows of a report.

    Fractions are rounded to `digits`, nulls are empty.
    """
    sep, edge = (" | ", "|") if markdown else ("\t", "")
    shown = [
        F.coalesce(F.format_string(f"%.{digits}f", F.col(n)) if t in ("double", "float") else F.col(n).cast("string"), F.lit("")) for n, t in rows.dtypes
    ]
    wrap = (lambda c: F.concat(F.lit(edge + " "), c, F.lit(" " + edge))) if markdown else (lambda c: c)
    body = rows.select(F.row_number().over(Window.orderBy(*order)).alias("at"), wrap(F.concat_ws(sep, *shown)).alias("line"))
    heads = [sep.join(rows.columns)] + ([" | ".join("---" for _ in rows.columns)] if markdown else [])
    head = rows.sparkSession.createDataFrame([(k - 2, f"{edge} {h} {edge}" if markdown else h) for k, h in enumerate(heads)], "at int, line string")
    return head.unionByName(body).orderBy("at").select("line")


def tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", header).csv(path)


def json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def extract(articles: DataFrame, titles: list[str], more: int, seed: int) -> DataFrame:
    """Named articles, and `more` others in an order that only the seed fixes: a fixture's content."""
    named = articles.where(F.col("title").isin(titles))
    others = articles.where(~F.col("title").isin(titles)).orderBy(F.xxhash64("article_id", F.lit(seed)), "article_id").limit(more)
    return named.unionByName(others)


def boxed(places: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Places within any of the boxes (south, west, north, east)."""
    inside = F.lit(False)
    for south, west, north, east in boxes:
        inside = inside | (F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return places.where(inside)


def rebuilt(spark, path: str, inputs: list[str], settings: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built only if the stamp written with it differs from that of its inputs now."""
    stamp = input_stamp(spark, inputs, settings)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/stamp-{stamp}")
    if not mark.getFileSystem(conf).exists(mark):
        build().write.mode("overwrite").parquet(f"{path}/table")
        mark.getFileSystem(conf).create(mark).close()
    return spark.read.parquet(f"{path}/table")
