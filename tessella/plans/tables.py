"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as articles: title is the first four words, views a fixed pseudo-popularity."""
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"),
        (F.col("doc_id") * 7919 % 20011).alias("views"), "text", "source", "lang",
    )


ARTICLES = """articles AS (SELECT doc_id AS article_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS title,
    doc_id * 7919 % 20011 AS views, text, source, lang FROM documents)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as places of two sources, a few streets of a city."""
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        p.alias("pid"), F.col("p_name").alias("name"), F.col("p_type").alias("cat"), F.col("p_brand").alias("brand"),
        (40.0 + (p * 37 % 97) / 10000.0).alias("lat"), (-8.0 + (p * 101 % 89) / 10000.0).alias("lon"),
        (30 + F.col("p_size") % 70).cast("long").alias("conf"), (p % 1024).alias("diet"),
        F.when(p % 2 == 0, "a").otherwise("b").alias("src"),
    )


PLACES = """places AS (SELECT p_partkey AS pid, p_name AS name, p_type AS cat, p_brand AS brand,
    40.0::DOUBLE + (p_partkey * 37 % 97) / 10000.0::DOUBLE AS lat, -8.0::DOUBLE + (p_partkey * 101 % 89) / 10000.0::DOUBLE AS lon,
    (30 + p_size % 70)::BIGINT AS conf, p_partkey % 1024 AS diet, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS src FROM part)"""
