"""Queries that classify questions and pack contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import questions as q
from tessella.operators import context as c
from tessella.operators import search as s
from tessella.plans.search import _hits as _bm25_hits
from tessella.plans.search import _item_stems, _posts
from tessella.plans.tables import articles, read


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'")


def working_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns, each asked how far if something, every third with a number."""
    asked = F.concat(F.lit("how many "), "text", F.when(F.col("turn") % 3 == 0, " 12").otherwise(""))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", q.needs_working(asked).alias("works"))


def language_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", q.needs_translation(F.col("text")).alias("translate"))


def leak_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item answered with one to four marks of a recital; questions of some items use marks themselves."""
    i = F.col("item_id")
    answer = F.concat("text", F.lit(" No preamble."), F.when(i % 2 == 0, " no LaTeX,").otherwise(""), F.when(i % 3 == 0, " be concise:").otherwise(""), F.when(i % 5 == 0, " avoid guessing").otherwise(""))
    question = F.concat("text", F.when(i % 4 == 0, " in LaTeX").otherwise(""))
    return read(spark, sf_dir, "benchmark").select("item_id", q.recites_instructions(answer, question).alias("leak"))


def followup_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_turns(spark, sf_dir).select("conv_id", "turn", q.follows_up(F.col("text")).alias("follows_up"))


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(q.plan_titles("text")).alias("place", "title"))


def clean_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(q.clean_check(F.concat("text", F.lit("\nHmm, wait")))).alias("text_md5"))


def place_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("best vegan food in "), F.initcap("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", q.place_asks(asked).alias("ask")).select("item_id", "ask.*")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    best = s.top(_bm25_hits(spark, sf_dir, s.query_terms(_item_stems(spark, sf_dir, posts))), 6)
    return best.join(articles(spark, sf_dir), best.id == F.col("article_id")).select(
        "question", "rank", "id", "title", F.lit("").alias("section"), "text", (F.col("rank") == 1).alias("lead")
    )


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.packed(_hits(spark, sf_dir)).select("question", "context", "used")


def check_terms_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("question_text"))
    return c.check_overlaps(_hits(spark, sf_dir).join(items, "question")).select("question", "id", "overlap")


QUERIES = {
    f.__name__: f
    for f in (
        working_detector, language_detector, leak_detector, followup_detector, plan_lines, clean_checks, place_questions,
        context_pack, check_terms_overlap,
    )
}


def _count(pattern: str) -> str:
    """SQL for the words of `low` that a pattern of whole words matches: the other engine's word boundaries know ASCII letters only."""
    whole = pattern.replace("\\b", "").replace("'", "''")
    return rf"len(list_filter(regexp_extract_all(low, '[\pL\pM\pN_]+'), lambda x: regexp_full_match(x, '{whole}')))"


_W = q.CALCULATES.replace("'", "''")
ORACLES = {
    "working_detector": f"""WITH a AS (SELECT conv_id, turn, 'how many ' || text || CASE WHEN turn % 3 = 0 THEN ' 12' ELSE '' END AS t FROM conversations)
        SELECT conv_id, turn, regexp_matches(t, '{_W}') OR regexp_matches(t, '{q.SUPPOSES}') OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, '{q.MEASURES}')) AS works FROM a""",
    "leak_detector": f"""WITH a AS (SELECT item_id, lower(text || ' No preamble.' || CASE WHEN item_id % 2 = 0 THEN ' no LaTeX,' ELSE '' END || CASE WHEN item_id % 3 = 0 THEN ' be concise:' ELSE '' END
            || CASE WHEN item_id % 5 = 0 THEN ' avoid guessing' ELSE '' END) AS a, lower(text || CASE WHEN item_id % 4 = 0 THEN ' in LaTeX' ELSE '' END) AS q FROM benchmark)
        SELECT item_id, {" + ".join(f"(regexp_matches(a, '{x}') AND NOT regexp_matches(q, '{x}'))::INT" for x in q.RECITES)} >= 3 AS leak FROM a""",
    "language_detector": f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '\\p{{Latin}}')) AS latin FROM documents)
        SELECT doc_id, letters - latin > latin OR ({_count(q.FOREIGN)} >= 2 AND {_count(q.FOREIGN)} > {_count(q.ENGLISH)}) AS translate FROM d""",
    "plan_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        t AS (SELECT doc_id, i, trim(trim(regexp_replace(line, '^\\s*(?:[-*•]\\s+|\\d{1,2}[.)]\\s+)?', ''), chr(32) || chr(9) || chr(13)), '"') AS title FROM l),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS place FROM t WHERE length(title) BETWEEN 2 AND 79
            AND NOT (len(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '')) >= 5 AND ends_with(title, '.')))
        SELECT doc_id, place::INTEGER AS place, title FROM k WHERE place < 4""",
    "clean_checks": """WITH l AS (SELECT doc_id, string_split(trim(text || chr(10) || 'Hmm, wait', chr(32) || chr(9) || chr(10) || chr(13)), chr(10)) AS ls FROM documents),
        k AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, '^\\s*(?:[-*]\\s*)?(?:But wait|Wait[,. ]|Hmm|Let me|Let''s|Actually,|On second thought)')), true) AS cut FROM l)
        SELECT doc_id, md5(trim(array_to_string(ls[1:cut - 1], chr(10)), chr(32) || chr(9) || chr(10) || chr(13))) AS text_md5 FROM k""",
    "place_questions": f"""WITH t AS (SELECT item_id, 'best vegan food in ' || lower(text) AS low FROM benchmark)
        SELECT item_id, 'eat' AS kind, 'vegan' AS diet, CASE WHEN regexp_matches(low, '{q.CHEAP.pattern}') THEN 'Budget' WHEN regexp_matches(low, '{q.FANCY.pattern}') THEN 'Splurge' END AS price,
            regexp_matches(low, '{q.NEAR_ME.pattern}') AS here, regexp_matches(low, '{q.AT_NIGHT.pattern}') AS late FROM t""",
    "followup_detector": f"""WITH t AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[?.!]+$', '') AS bare FROM conversations WHERE role = 'user'),
        w AS (SELECT *, len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda x: x <> '')) AS n, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM t),
        f AS (SELECT *, list_position(list_transform(ws, lambda x, i: i > 1 AND regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_matches(x, '{q.MYSELF.replace("'", "''")}')), true) AS name,
            list_position(list_transform(ws, lambda x: lower(trim(x, '?.!,''"')) IN {q.PERSONS}), true) AS person FROM w)
        SELECT conv_id, turn, n BETWEEN 1 AND 16 AND (regexp_matches(bare, '{q.OPENS}') OR (n <= 4 AND regexp_matches(bare, '{q.SHORT_OPENS}'))
            OR (coalesce(name, 0) = 0 AND (n <= 5 OR (n <= 12 AND regexp_matches(bare, '{q.POINTS}')))) OR (coalesce(person, 0) > 0 AND (coalesce(name, 0) = 0 OR person < name))) AS follows_up FROM f""",
}
