"""Logs and measurements over time: as-of values, interpolated energy, windows, gaps, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.search import few


def as_of(probes: DataFrame, samples: DataFrame, key: str, time: str, value: str, forward: bool = False) -> DataFrame:
    """probes with `value` of the last sample at or before their time (forward: the first at or after).

    One union sorted per key instead of a range join; a sample without the value is
    passed over. At equal times a sample comes before a probe.
    """
    both = samples.where(F.col(value).isNotNull()).select(
        F.col(key), F.col(time), F.col(value).alias("seen"), F.col(time).alias("seen_at"), F.lit(0).alias("side")
    ).unionByName(
        probes.select("*", F.lit(1).alias("side")), allowMissingColumns=True
    )
    order = [F.col(time).desc() if forward else F.col(time).asc(), F.col("side").asc()]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.select("*", F.last("seen", ignorenulls=True).over(w).alias(value), F.last("seen_at", ignorenulls=True).over(w).alias(f"{value}_at"))
    return filled.where("side = 1").drop("side", "seen", "seen_at")


def interpolated(probes: DataFrame, samples: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """probes with `value` (cumulative) interpolated at their time; clamped to the first and last sample.

    A sample at exactly the time is taken itself. Times are numbers.
    """
    low = {value: "low_value", f"{value}_at": "low_time"}
    high = {value: "high_value", f"{value}_at": "high_time"}
    before = as_of(probes, samples, key, time, value).withColumnsRenamed(low)
    both = as_of(before, samples, key, time, value, forward=True).withColumnsRenamed(high)
    t, t0, t1, v0, v1 = (F.col(c) for c in (time, "low_time", "high_time", "low_value", "high_value"))
    line = v0 + (v1 - v0) * (t - t0) / F.greatest(t1 - t0, F.lit(1))
    found = F.when(t0.isNull(), v1).when(t1.isNull(), v0).when(t1 == t, v1).otherwise(line)
    return both.withColumn(value, found).drop(*low.values(), *high.values())


def window_power(windows: DataFrame, samples: DataFrame, key: str = "rail") -> DataFrame:
    """windows (name, t0, t1) with the mean power of each rail in them: energy at the end less that at the start, per ms.

    samples (rail, t, energy), cumulative.
    """
    rails = samples.select(key).distinct()
    # A device's rails are a few dozen; what is counted as more isn't sent to all tasks.
    small = few(rails)
    ends = windows.crossJoin(rails if small is None else F.broadcast(small)).select(
        "name", "t0", "t1", key, F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("end"), F.col("t1").alias("t")))).alias("p")
    ).select("name", "t0", "t1", key, "p.end", "p.t")
    at = interpolated(ends, samples, key, "t", "energy")
    gained = F.sum(F.when(F.col("end") == 1, F.col("energy")).otherwise(-F.col("energy")))
    return at.groupBy("name", "t0", "t1", key).agg((gained / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))).alias("power"))


def in_windows(samples: DataFrame, windows: DataFrame, time: str) -> DataFrame:
    """samples within [t0, t1] of each window, by slots as long as the mean window.

    A window stands in each slot that it touches: together not many more than there
    are windows. So the join has a key, however many windows there are.
    """
    seconds = lambda c: F.col(c).cast("double")
    width = windows.agg(F.avg(seconds("t1") - seconds("t0"))).first()[0] or 1.0
    slot = lambda c: F.floor(seconds(c) / width)
    spread = windows.where("t0 <= t1").withColumn("window_slot", F.explode(F.sequence(slot("t0"), slot("t1"))))
    placed = samples.withColumn("window_slot", slot(time))
    return placed.join(spread, "window_slot").where(F.col(time).between(F.col("t0"), F.col("t1"))).drop("window_slot")


def gaps(windows: DataFrame, key: str, least: float, end: Column | None = None) -> DataFrame:
    """(key, t0, t1) between windows (key, t0, t1) more than `least` apart, and after the last up to `end`."""
    w = Window.partitionBy(key).orderBy("t0")
    between = windows.select(key, F.lag("t1").over(w).alias("a"), F.col("t0").alias("b"))
    found = between.where(F.col("b") - F.col("a") > least).select(key, F.col("a").alias("t0"), F.col("b").alias("t1"))
    if end is not None:
        last = windows.groupBy(key).agg(F.max("t1").alias("t0")).withColumn("t1", end)
        found = found.unionByName(last.where(F.col("t1") - F.col("t0") > least))
    return found


def sessions(events: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """(key, t0, t1, events): runs of events no further apart than the gap."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.unix_micros(F.col(time)) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds).cast("int"), F.lit(1))
    numbered = events.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return numbered.groupBy(key, "run").agg(F.min(time).alias("t0"), F.max(time).alias("t1"), F.count("*").alias("events")).drop("run")


def tagged_groups(lines: DataFrame, order: str, head: Column, value: Column) -> DataFrame:
    """lines with `head_value`: the value of the last line before or at them that `head` marks (continuation lines belong to it)."""
    w = Window.orderBy(order) if "file" not in lines.columns else Window.partitionBy("file").orderBy(order)
    return lines.withColumn("head_value", F.last(F.when(head, value), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def first_events(events: DataFrame, run: str, name: str, time: str) -> DataFrame:
    """Each run's first time of each event; later ones don't count."""
    return events.groupBy(run, name).agg(F.min(time).alias("first"))


def segments(firsts: DataFrame, run: str, name: str) -> DataFrame:
    """Consecutive first events of a run as segments (from, to, start, stop)."""
    w = Window.partitionBy(run).orderBy("first", name)
    return firsts.select(
        run, F.col(name).alias("from_event"), F.lead(name).over(w).alias("to_event"), F.col("first").alias("start"), F.lead("first").over(w).alias("stop")
    ).where("to_event is not null")


def column_stats(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Count, least, mean and greatest of each column's known values."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s"))
    return long.groupBy(*by, F.col("s.name").alias("name")).agg(
        F.count("s.x").alias("n"), F.min("s.x").alias("least"), F.avg("s.x").alias("mean"), F.max("s.x").alias("greatest")
    )


def pearson(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(n, r, strength) over rows where both are known; r is null under three rows or where one is constant."""
    known = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    found = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.corr(a, b).alias("c"), F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1")
    )
    flat = (F.col("n") < 3) | (F.col("a0") == F.col("a1")) | (F.col("b0") == F.col("b1"))
    r = F.when(flat, None).otherwise(F.col("c"))
    strength = F.when(F.abs(r) >= 0.8, "strong").when(F.abs(r) >= 0.4, "moderate").when(r.isNotNull(), "weak")
    return found.select(*by, "n", r.alias("r"), strength.alias("strength"))


def normalised(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """value scaled to 0..1 within its series; 0 in a constant one."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("scaled", F.when(high == low, 0.0).otherwise((F.col(value) - low) / (high - low)))


def category_share(rows: DataFrame, text: str, value: str, rules: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """Sums of value by the first rule (name, pattern) that a text matches."""
    name = None
    for label, pattern in rules:
        hit = F.col(text).rlike(pattern)
        name = F.when(hit, label) if name is None else name.when(hit, label)
    return rows.groupBy(name.otherwise(other).alias("category")).agg(F.sum(value).alias("total"), F.count("*").alias("rows"))


def time_parts(wall: Column, compute: Column, flash: Column, manage: Column) -> dict[str, Column]:
    """A token's time split into what was computed, waited for and managed; the rest is unattributed. -1: unknown."""
    known = lambda c: F.when(c == -1, None).otherwise(c)
    waited = F.greatest(known(flash), F.lit(0.0))
    rest = F.greatest(wall - F.coalesce(known(compute), F.lit(0.0)) - F.coalesce(waited, F.lit(0.0)) - F.coalesce(known(manage), F.lit(0.0)), F.lit(0.0))
    return {"compute": known(compute), "flash_wait": waited, "manage": known(manage), "unattributed": rest, "per_second": F.when(wall > 0, 1000.0 / wall)}


def weighted_rate(tokens: Column, rate: Column) -> Column:
    """Tokens a second over several runs: all tokens over all seconds."""
    return F.sum(tokens) / F.sum(F.when(rate > 0, tokens / rate))


def config_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """(key, one, two) where two runs' settings (key, value) differ, or only one has them."""
    both = one.withColumnRenamed("value", "one").join(two.withColumnRenamed("value", "two"), "key", "full_outer")
    return both.where(~F.col("one").eqNullSafe(F.col("two")))
