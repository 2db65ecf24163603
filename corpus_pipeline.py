"""From raw documents to token files in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.decontam import contamination
from tessella.llm.mixing import mixed_documents
from tessella.llm.neardup import deduplicated
from tessella.llm.shared import kept, small
from tessella.llm.token_files import token_file_digest
from tessella.llm.toxicity import fit_toxicity, toxicity

TOKENIZER = "word_bpe_49k.json"
#: Rejected rows, of about 40 bytes each, up to which they are broadcast.
BROADCAST_ROWS = 300_000


def _without(docs: DataFrame, rejected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that rejected names by `row`, which stands for id and text.

    So rows are judged one by one, with null and repeated ids too; equal rows go together.
    """
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    named = docs.select(row.alias("row"), "text")
    rows = kept(rejected(named).select("row").distinct(), "rejected")
    return docs.join(small(rows, BROADCAST_ROWS), row == rows["row"], "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field doesn't call toxic. It learns from the labels of these documents."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, lambda named: toxicity(named, model, "row").where("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, and one row of that id."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda named: contamination(named, benchmark, "row").where("size(spans) > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: again where a source is repeated, in part at its cut."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and each document's ids in them."""
    return token_file_digest(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", token_output),
]
#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
