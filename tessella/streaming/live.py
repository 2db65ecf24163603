"""Streaming counterparts: tumbling means, first events, sessions, resumable rows, accumulated deltas.

Each takes a streaming DataFrame and returns one; watermarks bound the state, so
it doesn't grow with the stream. run_once() drives a query over what is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessella.functions.names import ascii_key
from tessella.functions.questions import planned_titles
from tessella.sources.scratch import new_path


def source(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files appearing at a path, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def tumbling(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Count, sum and mean of each key and window; rows later than `late` behind are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")
    ).select(F.col("w.start").alias("start"), key, "n", "total", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events no further apart than the gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(
        key, F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "events"
    )


def first_events(events: DataFrame, time: str, run: str, name: str, late: str, day: str = "1 day") -> DataFrame:
    """The first time of each event of a run within a day: later ones don't count."""
    return events.withWatermark(time, late).groupBy(F.window(time, day).alias("w"), run, name).agg(F.min(time).alias("first")).select(run, name, F.col("w.start").alias("day"), "first")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; the keys are forgotten once the watermark has passed them."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def accumulated(deltas: DataFrame, time: str, late: str, idle: str = "1 hour") -> DataFrame:
    """(run, step, text): text of each run after each step of (run, step, delta, reset) and a time.

    A delta is appended; with reset it replaces what was there. Steps of a batch are
    taken in order. A run's state is its text, forgotten once the watermark (`late`
    behind the latest time) is `idle` past the run's last delta.
    """
    schema = "run long, step long, text string"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, last = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values("step")
        out = []
        for row in rows.itertuples():
            text = row.delta if row.reset else text + row.delta
            out.append((int(key[0]), int(row.step), text))
        last = max(last, int(pd.Timestamp(rows[time].max()).timestamp() * 1000))
        state.update((text, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["run", "step", "text"])

    grouped = deltas.withWatermark(time, late).groupBy("run")
    return grouped.applyInPandasWithState(grow, schema, "text string, last long", "append", GroupStateTimeout.EventTimeTimeout)


def planned_lines(deltas: DataFrame, time: str, late: str, idle: str = "1 hour", most: int = 4) -> DataFrame:
    """(run, place, title): titles that a plan names, each as soon as its line is finished, of (run, step, delta, done) and a time.

    Steps count from 0 without gaps; those that arrive before their turn wait in
    the state, so titles come out in order however the stream is cut. A line is
    finished by its end, the last one by a delta with `done`, or when nothing has
    come for `idle` behind the watermark. The first `most` titles count, by the rules of
    questions.planned_titles(). The state is an unfinished line and the steps that wait.
    """
    schema = "run long, place int, title string"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def grow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line, step, found, waiting = state.get if state.exists else ("", 0, 0, "{}")
        waiting = {int(k): v for k, v in json.loads(waiting).items()}
        ended, lines = state.hasTimedOut, []
        if not ended:
            rows = pd.concat(list(frames))
            # A step that is sent again counts once.
            waiting |= {int(r.step): (r.delta or "", bool(r.done)) for r in rows.itertuples() if int(r.step) >= step}
        while step in waiting or (ended and waiting):
            delta, done = waiting.pop(step if step in waiting else min(waiting))
            *whole, line = (line + delta).replace("\r\n", "\n").split("\n")
            lines, step, ended = lines + whole, step + 1, ended or done
        if ended:
            lines, line = [*lines, line], ""
        titles = [t for x in lines for t in planned_titles(x)][: most - found]
        if ended:
            state.update(("", 1 << 62, most, "{}")) if not state.hasTimedOut else state.remove()
        else:
            state.update((line, step, found + len(titles), json.dumps(waiting)))
        if not state.hasTimedOut:
            latest = int(pd.Timestamp(rows[time].max()).timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(int(key[0]), found + i, t) for i, t in enumerate(titles)], columns=["run", "place", "title"])

    kept = "line string, step long, found int, waiting string"
    return deltas.withWatermark(time, late).groupBy("run").applyInPandasWithState(grow, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def resolved_lines(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """lines (run, place, title) as they come, with the article of each title by titles (title_key, article_id); null where there is none."""
    # The key is a column of its own: rows of a Python state must pass a projection before they are shuffled.
    keyed = lines.withColumn("title_key", ascii_key("title"))
    return keyed.join(titles.select("title_key", "article_id"), "title_key", "left").select("run", "place", "title", "article_id")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream has now to Parquet at a path, and stop; called again, it goes on where it stopped."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def complete_table(stream: DataFrame, name: str) -> DataFrame:
    """The stream's whole result so far, as Parquet files: each batch writes it anew, the last one's is read."""
    path, batches = new_path(stream.sparkSession, name), []

    def put(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/{batch}")
        batches.append(batch)

    writer = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{batches[-1]}")
