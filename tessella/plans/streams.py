"""Streams over events, held against the same in batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.names import ascii_key
from tessella.plans.tables import read
from tessella.sources.scratch import new_path
from tessella.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A file source lists a folder; the pattern picks the table's own files.
    stream = live.source(spark, f"{sf_dir}/[e]vents.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast(T.TimestampType()))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.tumbling(_events(spark, sf_dir), "ts", "event_type", "value", "1 day", "1 hour")
    found = live.complete_table(stream, f"tumbling_{uuid.uuid4().hex}")
    return found.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.first_events(_events(spark, sf_dir), "ts", "user_id", "event_type", "1 hour", "365 days")
    found = live.complete_table(stream, f"first_{uuid.uuid4().hex}")
    return found.groupBy("user_id", "event_type").agg(F.unix_micros(F.min("first")).alias("first"))


#: Characters of a delta of the streamed plans.
_DELTA = 97


def plan_deltas(documents: DataFrame) -> DataFrame:
    """Documents as plans that arrive in pieces: (run, step, delta, done, ts)."""
    n = F.ceil(F.length("text") / _DELTA).cast("int")
    steps = F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("step")
    spread = documents.where("text is not null").select("doc_id", "text", n.alias("n"), steps)
    delta = F.substring("text", F.col("step") * _DELTA + 1, F.lit(_DELTA))
    return spread.select(
        F.col("doc_id").alias("run"), F.col("step").cast("long").alias("step"), delta.alias("delta"), (F.col("step") >= F.col("n") - 1).alias("done"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("step")).alias("ts"),
    )


def _first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of documents as titles: (title_key, article_id), the least document of each."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(ascii_key(F.trim(F.substring_index("text", "\n", 1))).alias("title_key")).agg(F.min("doc_id").alias("article_id"))


def stream_plan_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as plans that stream in pieces: titles as their lines are finished, resolved to documents that start with them."""
    path = f"{sf_dir}/documents.parquet"
    docs = live.source(spark, f"{sf_dir}/[d]ocuments.parquet", spark.read.parquet(path).schema)
    lines = live.planned_lines(plan_deltas(docs), "ts", "1 hour")
    where = new_path(spark, "plan_titles")
    live.run_once(live.resolved_lines(lines, _first_lines(spark, sf_dir)), f"{where}/out", f"{where}/checkpoint")
    return spark.read.schema("run long, place int, title string, article_id long").parquet(f"{where}/out")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_first_events, stream_plan_titles)}
ORACLES = {
    "stream_tumbling": """SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "stream_plan_titles": r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS i FROM documents),
        t AS (SELECT doc_id, i, trim(trim(regexp_replace(line, '^\s*(?:[-*•]\s+|\d{1,2}[.)]\s+)?', ''), chr(32) || chr(9) || chr(13)), '"') AS title FROM l),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM t WHERE length(title) BETWEEN 2 AND 79
            AND NOT (len(list_filter(regexp_split_to_array(title, '\s+'), lambda x: x <> '')) >= 5 AND ends_with(title, '.'))),
        a AS (SELECT translate(trim(split_part(text, chr(10), 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS title_key, min(doc_id) AS article_id
            FROM documents WHERE text IS NOT NULL GROUP BY 1)
        SELECT doc_id AS run, place::INTEGER AS place, title, article_id FROM k LEFT JOIN a ON translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = title_key WHERE place < 4""",
    "stream_first_events": "SELECT user_id, event_type, epoch_us(min(ts)) AS first FROM events GROUP BY 1, 2",
}
