"""Queries over logs, grades and conversations, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import evaluation as e
from tessella.operators import telemetry as t
from tessella.plans.tables import read

EVENT_KINDS = ["click", "error", "login", "purchase", "view"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("ts"))


def _half(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clicks as probes, views as samples, of each user."""
    events = _events(spark, sf_dir)
    probes = events.where("event_type = 'click'").select("user_id", "t", "event_id")
    return probes, events.where("event_type = 'view'").groupBy("user_id", "t").agg(F.max("value").alias("value"))


def asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.as_of(*_half(spark, sf_dir), "user_id", "t", "value").select("event_id", "value")


def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.as_of(*_half(spark, sf_dir), "user_id", "t", "value", forward=True).select("event_id", "value")


def energy_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes, samples = _half(spark, sf_dir)
    return t.interpolated(probes, samples, "user_id", "t", "value").select("event_id", F.round("value", 6).alias("value"))


def window_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_micros(F.date_trunc("day", "ts")) / 1000
    events = _events(spark, sf_dir)
    samples = events.groupBy(F.col("event_type").alias("rail"), F.expr("t div 1000").alias("t")).agg(F.sum("value").alias("energy"))
    days = events.select(day.cast("long").alias("t0")).distinct()
    windows = days.select(F.col("t0").cast("string").alias("name"), "t0", (F.col("t0") + 86_400_000).alias("t1"))
    return t.window_power(windows, samples).select("name", "rail", F.round(F.col("power") * 1e6, 4).alias("power"))


def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg((F.min("t") / 1e6).alias("t0"), (F.max("t") / 1e6).alias("t1"))
    found = t.gaps(windows, "user_id", 3600.0)
    return found.select("user_id", F.round("t0", 3).alias("t0"), F.round(F.col("t1") - F.col("t0"), 3).alias("seconds"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sessions(_events(spark, sf_dir), "user_id", "ts", 7200.0).select("user_id", F.unix_micros("t0").alias("t0"), F.unix_micros("t1").alias("t1"), "events")


def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return t.pearson(lines, "l_quantity", "l_extendedprice", ["l_linestatus"]).withColumn("r", F.round("r", 6))


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.column_stats(read(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return found.withColumns({c: F.round(c, 6) for c in ("least", "mean", "greatest")})


def log_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.segments(t.first_events(_events(spark, sf_dir), "user_id", "event_type", "t"), "user_id", "event_type")


def category_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("reading", "view|click"), ("failing", "err"), ("buying", "purchase|cart")]
    return t.category_share(_events(spark, sf_dir), "event_type", "value", rules).withColumn("total", F.round("total", 4))


def normalise_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.normalised(_events(spark, sf_dir), "value", ["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


def weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    rate = t.weighted_rate(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))
    return lines.groupBy("l_linestatus").agg(F.round(rate, 6).alias("rate"))


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.min("t").alias("t0"), (F.min("t") + 6 * 3_600_000_000).alias("t1"))
    met = t.in_windows(events.select("t", "value"), days, "t")
    return met.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as grades: quality and toxicity as two systems' scores, by the document's source."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "source", (F.col("quality") * 5 + F.col("n_chars") % 3).alias("ours"), (F.col("toxic") * 4 + F.col("n_chars") % 5 + 1).alias("theirs")
    )


def share_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.share_rollup(_scores(spark, sf_dir), "source", F.col("ours"), F.col("theirs"))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "reference_mean", "share", "median")})


def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = e.share_rollup(_scores(spark, sf_dir), "source", F.col("ours"), F.col("theirs")).select("source", "wins", "losses")
    return counts.withColumn("p", F.round(e.sign_test(F.col("wins"), F.col("losses")), 6))


def prefer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    effect = F.when(F.col("ours") > F.col("theirs"), "better").when(F.col("ours") < F.col("theirs"), "worse").otherwise("same")
    return e.effect_counts(_scores(spark, sf_dir).withColumn("effect", effect), "source", "effect", ["better", "same", "worse"])


def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("source", F.concat_ws("/", F.col("ours").cast("string"), F.lit("7")).alias("facts"), (F.col("theirs") > 4).alias("fabricated"))
    return e.key_facts(rows, ["source"])


def blind_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    answers = items.select("id", F.explode(F.array(*[F.lit(x) for x in ("one", "two", "three")])).alias("system"), F.col("text").alias("answer"))
    return e.blind(answers, 7).select("id", "system", "letter")


def unblind_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blind sets graded by letter, then unblinded: scores come back to their systems."""
    key = blind_sets(spark, sf_dir)
    worth = F.when(F.col("system") == "one", 1).when(F.col("system") == "two", 2).otherwise(3) + F.col("id") % 4
    grades = key.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("letter", worth.alias("score")))).alias("scores"))
    return e.unblinded(grades, key).groupBy("system").agg(F.count("*").alias("n"), F.sum("score").alias("total"))


def chat_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.conversations(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "n_turns", "title", F.md5(F.array_join(F.transform("turns", lambda x: x["text"]), "|")).alias("turns_md5"))


def previous_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = e.previous_exchange(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "turn", F.md5("last_question").alias("question_md5"), F.md5("last_answer").alias("answer_md5"))


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled, and have as many characters as some order has key."""
    docs = read(spark, sf_dir, "documents")
    sets = [docs.select(F.col("doc_id").alias("id")), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))]
    return e.common_ids(sets)


def config_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' customers by segment, for two segments as two runs' settings."""
    counts = read(spark, sf_dir, "customer").groupBy("c_mktsegment", F.col("c_nationkey").alias("key")).agg(F.count("*").alias("value"))
    side = lambda s: counts.where(F.col("c_mktsegment") == s).select("key", "value")
    return t.config_difference(side("BUILDING"), side("MACHINERY"))


QUERIES = {
    f.__name__: f
    for f in (
        asof_last, asof_next, energy_interpolate, window_power, idle_gaps, session_windows, pearson_pairs, column_stats, log_timeline,
        category_pct, normalise_series, weighted_rates, interval_join, share_rollup, sign_test, prefer_counts, key_facts, blind_sets,
        unblind_shares, chat_rollup, previous_exchange, shared_ids, config_difference,
    )
}

_E = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"
_HALF = f"""{_E}, probe AS (SELECT user_id, t, event_id FROM e WHERE event_type = 'click'),
    sample AS (SELECT user_id, t, max(value) AS value FROM e WHERE event_type = 'view' GROUP BY 1, 2)"""
_S = """s AS (SELECT doc_id, source, quality * 5 + n_chars % 3 AS ours, toxic * 4 + n_chars % 5 + 1 AS theirs FROM labels JOIN documents USING (doc_id))"""

ORACLES = {
    "asof_last": f"WITH {_HALF} SELECT event_id, value FROM probe p ASOF LEFT JOIN sample s ON p.user_id = s.user_id AND p.t >= s.t",
    "asof_next": f"WITH {_HALF} SELECT event_id, value FROM probe p ASOF LEFT JOIN sample s ON p.user_id = s.user_id AND p.t <= s.t",
    "energy_interpolate": f"""WITH {_HALF}, b AS (SELECT p.*, s.t AS t0, s.value AS v0 FROM probe p ASOF LEFT JOIN sample s ON p.user_id = s.user_id AND p.t >= s.t),
        c AS (SELECT b.*, s.t AS t1, s.value AS v1 FROM b ASOF LEFT JOIN sample s ON b.user_id = s.user_id AND b.t <= s.t)
        SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 = t THEN v1 ELSE v0 + (v1 - v0) * (t - t0) / greatest(t1 - t0, 1) END, 6) AS value FROM c""",
    "window_power": f"""WITH {_E}, sample AS (SELECT event_type AS rail, t // 1000 AS t, sum(value) AS energy FROM e GROUP BY 1, 2),
        w AS (SELECT DISTINCT epoch_us(date_trunc('day', ts)) // 1000 AS t0 FROM events), r AS (SELECT DISTINCT rail FROM sample),
        p AS (SELECT t0 AS w0, rail, 0 AS fin, t0 AS t FROM w, r UNION ALL SELECT t0, rail, 1, t0 + 86400000 FROM w, r),
        b AS (SELECT p.*, s.t AS t0, s.energy AS v0 FROM p ASOF LEFT JOIN sample s ON p.rail = s.rail AND p.t >= s.t),
        c AS (SELECT b.*, s.t AS t1, s.energy AS v1 FROM b ASOF LEFT JOIN sample s ON b.rail = s.rail AND b.t <= s.t),
        d AS (SELECT w0, rail, fin, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 = t THEN v1 ELSE v0 + (v1 - v0) * (t - t0) / greatest(t1 - t0, 1) END AS x FROM c)
        SELECT w0::VARCHAR AS name, rail, round(sum(CASE WHEN fin = 1 THEN x ELSE -x END) / 86400000 * 1e6, 4) AS power FROM d GROUP BY 1, 2""",
    "idle_gaps": f"""WITH {_E}, w AS (SELECT user_id, min(t) / 1e6 AS t0, max(t) / 1e6 AS t1 FROM e GROUP BY user_id, ts::DATE),
        b AS (SELECT user_id, lag(t1) OVER (PARTITION BY user_id ORDER BY t0) AS a, t0 AS b FROM w)
        SELECT user_id, round(a, 3) AS t0, round(b - a, 3) AS seconds FROM b WHERE b - a > 3600""",
    "session_windows": f"""WITH {_E}, n AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 7200000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS run FROM n)
        SELECT user_id, min(t) AS t0, max(t) AS t1, count(*) AS events FROM r GROUP BY user_id, run""",
    "pearson_pairs": """WITH c AS (SELECT l_linestatus, count(*) AS n, round(corr(l_quantity::DOUBLE, l_extendedprice::DOUBLE), 6) AS r FROM lineitem
            WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1)
        SELECT *, CASE WHEN abs(r) >= 0.8 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' END AS strength FROM c""",
    "column_stats": """WITH l AS (UNPIVOT (SELECT l_returnflag, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem)
            ON l_quantity, l_discount, l_tax INTO NAME name VALUE x)
        SELECT l_returnflag, name, count(x) AS n, round(min(x), 6) AS least, round(avg(x), 6) AS mean, round(max(x), 6) AS greatest FROM l GROUP BY 1, 2""",
    "log_timeline": f"""WITH {_E}, f AS (SELECT user_id, event_type, min(t) AS first_t FROM e GROUP BY 1, 2),
        g AS (SELECT user_id, event_type AS from_event, lead(event_type) OVER w AS to_event, first_t AS start, lead(first_t) OVER w AS stop
              FROM f WINDOW w AS (PARTITION BY user_id ORDER BY first_t, event_type)) SELECT * FROM g WHERE to_event IS NOT NULL""",
    "category_pct": """SELECT CASE WHEN regexp_matches(event_type, 'view|click') THEN 'reading' WHEN regexp_matches(event_type, 'err') THEN 'failing'
        WHEN regexp_matches(event_type, 'purchase|cart') THEN 'buying' ELSE 'other' END AS category, round(sum(value), 4) AS total, count(*) AS rows FROM events GROUP BY 1""",
    "normalise_series": """SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS scaled
        FROM events WINDOW w AS (PARTITION BY event_type)""",
    "weighted_rates": """SELECT l_linestatus, round(sum(l_quantity::DOUBLE) / sum(CASE WHEN l_extendedprice > 0 THEN l_quantity::DOUBLE / l_extendedprice::DOUBLE END), 6) AS rate FROM lineitem GROUP BY 1""",
    "interval_join": f"""WITH {_E}, d AS (SELECT ts::DATE AS day, min(t) AS t0, min(t) + 21600000000 AS t1 FROM e GROUP BY 1)
        SELECT day::VARCHAR AS day, count(*) AS n, round(avg(value), 6) AS mean FROM e JOIN d ON t BETWEEN t0 AND t1 GROUP BY 1""",
    "share_rollup": f"""WITH {_S} SELECT source, count(*) AS n, round(avg(ours), 6) AS mean, round(avg(theirs), 6) AS reference_mean, round(sum(ours) / sum(theirs), 6) AS share,
        round(median(ours)::DOUBLE, 6) AS median, count(*) FILTER (ours > theirs) AS wins, count(*) FILTER (ours < theirs) AS losses, count(*) FILTER (ours = theirs) AS ties
        FROM s GROUP BY ROLLUP (source)""",
    "sign_test": f"""WITH {_S}, c AS (SELECT source, count(*) FILTER (ours > theirs) AS wins, count(*) FILTER (ours < theirs) AS losses FROM s GROUP BY ROLLUP (source))
        SELECT source, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1)
            - (wins + losses) * ln(2))) FROM unnest(range(0, least(wins, losses) + 1)) AS r(k))) END, 6) AS p FROM c""",
    "prefer_counts": f"""WITH {_S} SELECT source, count(*) FILTER (ours > theirs) AS better, count(*) FILTER (ours = theirs) AS same, count(*) FILTER (ours < theirs) AS worse FROM s GROUP BY 1""",
    "key_facts": f"WITH {_S} SELECT source, sum(ours)::BIGINT AS hit, (7 * count(*))::BIGINT AS of, count(*) FILTER (theirs > 4) AS fabricated FROM s GROUP BY 1",
    "unblind_shares": """WITH a AS (SELECT item_id, unnest([1, 2, 3]) AS k FROM benchmark) SELECT ['one', 'two', 'three'][k] AS system, count(*) AS n, sum(k + item_id % 4)::BIGINT AS total FROM a GROUP BY k""",
    "chat_rollup": """SELECT conv_id, count(*) AS n_turns, left(min_by(text, turn) FILTER (role = 'user'), 60) AS title, md5(string_agg(text, '|' ORDER BY turn)) AS turns_md5
        FROM conversations GROUP BY 1""",
    "previous_exchange": """WITH w AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER b AS q, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER b AS a
            FROM conversations WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, turn, md5(q) AS question_md5, md5(a) AS answer_md5 FROM w WHERE role = 'user'""",
    "shared_ids": "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT c_custkey FROM customer)",
    "config_difference": """WITH c AS (SELECT c_mktsegment AS s, c_nationkey AS key, count(*) AS value FROM customer GROUP BY 1, 2)
        SELECT coalesce(a.key, b.key) AS key, a.value AS one, b.value AS two FROM (SELECT * FROM c WHERE s = 'BUILDING') a
        FULL JOIN (SELECT * FROM c WHERE s = 'MACHINERY') b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value""",
}
