"""Queries that build a corpus from documents and pages, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.html import html_main_text
from tessella.operators import corpus as c
from tessella.plans.tables import ARTICLES, articles, read


def tier_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.tiers(articles(spark, sf_dir), 100).select("article_id", "views", "tier")


def lead_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads and hard leads, by length and content; a full stop and line end stand in for a blank line."""
    text = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n"))
    return articles(spark, sf_dir).select(
        "article_id", F.length(c.lead_of(text)).cast("long").alias("lead_chars"), F.md5(c.lead_of(text)).alias("lead_md5"),
        F.md5(c.hard_lead_of(text)).alias("hard_md5"),
    )


def table_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.col("text"), F.lit("\nT"), F.lit("\n|T"))
    return articles(spark, sf_dir).select(
        "article_id", c.table_chars(text).alias("table_chars"), c.is_table(text).alias("is_table")
    )


def usable_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 3).alias("article_id")).agg(F.count("*").alias("views"))
    return c.with_views(c.usable(articles(spark, sf_dir).drop("views")), views).select("article_id", "views")


def budget_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = c.budget_marks(articles(spark, sf_dir), [10, 50, 100, 150, 200])
    return marks.withColumn("share", F.round("share", 6))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return c.first_copies(lines, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


def infobox_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of events: a box of each event's JSON properties."""
    raw = F.concat(F.lit('[{"data": '), F.col("props"), F.lit('}, {"data": {"type": "'), F.col("event_type"), F.lit('", "empty": ""}}]'))
    return read(spark, sf_dir, "events").select("event_id", c.infobox_facts(raw).alias("facts"))


def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles with unique titles; even ones redirect to a neighbour or to a new title."""
    part = read(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit(" "), (F.col("p_partkey") % 700).cast("string"))
    made = part.select(F.col("p_partkey").alias("article_id"), title.alias("title")).where("article_id % 3 = 0")
    index = part.select(F.col("p_partkey").alias("id"), title.alias("title"))
    target = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("NEW "), title)).otherwise(
        F.when(F.col("p_partkey") % 10 == 1, F.concat(F.lit("new "), "p_name", F.lit(" "), ((F.col("p_partkey") + 5) % 700).cast("string")))
        .otherwise(F.upper(F.concat("p_name", F.lit(" "), ((F.col("p_partkey") + 2) % 700).cast("string"))))
    )
    redirects = part.where("p_partkey % 2 = 0 or p_partkey % 10 = 1").select(F.col("p_partkey").alias("from_id"), target.alias("target"))
    return c.resolve_redirects(redirects, index, made)


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.chunks(c.usable(articles(spark, sf_dir))).drop("body")


def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("article_id"), html_main_text("html").alias("page"))
    return c.chunks(pages.select("article_id", F.col("page.text").alias("text"))).groupBy("section").agg(
        F.count("*").alias("passages"), F.sum(F.length("body")).alias("chars")
    )


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_main_text("html").alias("page")).select("page_id", "page.*")


QUERIES = {
    f.__name__: f
    for f in (
        tier_top_n, lead_text, table_chars, usable_articles, budget_marks, dedup_first, infobox_facts, redirect_resolve,
        chunk_spans, section_paths,
    )
} | {"html_main_text": html_pages}

ORACLES = {
    "tier_top_n": f"""WITH {ARTICLES} SELECT article_id, views, CASE WHEN row_number() OVER (ORDER BY views DESC, article_id) <= 100
        THEN 'full' ELSE 'lead' END AS tier FROM articles""",
    "lead_text": f"""WITH {ARTICLES}, t AS (SELECT article_id, split_part(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || '## ', 1) AS lead FROM articles),
        u AS (SELECT *, left(lead, 2500) AS hard, regexp_extract(left(lead, 2500), '(?s)^(.+)\\n\\n', 1) AS cut FROM t),
        v AS (SELECT *, CASE WHEN length(lead) <= 2500 THEN lead WHEN length(cut) > 0 THEN cut ELSE hard END AS best FROM u)
        SELECT article_id, length(best)::BIGINT AS lead_chars, md5(best) AS lead_md5, md5(hard) AS hard_md5 FROM v""",
    "table_chars": f"""WITH {ARTICLES}, t AS (SELECT article_id, string_split(replace(text, chr(10) || 'T', chr(10) || '|T'), chr(10)) AS lines FROM articles)
        SELECT article_id, coalesce(list_sum([length(x) + 1 FOR x IN lines IF starts_with(x, '|')]), 0)::BIGINT AS table_chars,
               len([x FOR x IN lines IF starts_with(x, '|')]) * 2 > len(lines) AS is_table FROM t""",
    "usable_articles": """SELECT doc_id AS article_id, coalesce(v.views, 0) AS views FROM documents
        LEFT JOIN (SELECT o_custkey * 3 AS k, count(*) AS views FROM orders GROUP BY 1) v ON k = doc_id WHERE length(text) >= 200""",
    "budget_marks": f"""WITH {ARTICLES}, t AS (SELECT article_id, views, length(text) AS full_chars, length(left(split_part(text, chr(10) || '## ', 1), 2500)) AS lead,
            coalesce(list_sum([length(x) + 1 FOR x IN string_split(text, chr(10)) IF starts_with(x, '|')]), 0) AS tables FROM articles),
        r AS (SELECT row_number() OVER w AS mark, sum(views) OVER w AS views, sum(full_chars) OVER w AS full_chars, sum(lead) OVER w AS lead,
              sum(tables) OVER w AS tables, sum(views) OVER () AS all_views, sum(lead) OVER () AS all_lead
              FROM t WINDOW w AS (ORDER BY views DESC, article_id ROWS UNBOUNDED PRECEDING))
        SELECT mark, round(views / all_views, 6) AS share, full_chars::BIGINT AS chars, (full_chars - tables)::BIGINT AS chars_without_tables,
               (all_lead - lead)::BIGINT AS remaining_leads FROM r WHERE mark IN (10, 50, 100, 150, 200)""",
    "dedup_first": """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1""",
    "infobox_facts": """SELECT event_id, 'Key facts: k: ' || json_extract_string(props, '$.k') || '; type: ' || event_type AS facts FROM events""",
    "redirect_resolve": """WITH p AS (SELECT p_partkey AS id, p_name AS name, p_name || ' ' || (p_partkey % 700) AS title FROM part),
        articles AS (SELECT min(id) AS article_id, lower(title) AS k FROM p WHERE id % 3 = 0 GROUP BY 2),
        rd AS (SELECT id AS from_id, lower(title) AS title_key, lower(CASE WHEN id % 6 = 0 THEN 'NEW ' || title
            WHEN id % 10 = 1 THEN 'new ' || name || ' ' || ((id + 5) % 700) ELSE name || ' ' || ((id + 2) % 700) END) AS target FROM p WHERE id % 2 = 0 OR id % 10 = 1),
        moved AS (SELECT target AS new_key, article_id, from_id FROM rd JOIN articles ON k = title_key WHERE target NOT IN (SELECT k FROM articles)),
        every AS (SELECT title_key, article_id, 1 AS step, from_id FROM rd JOIN articles ON k = target
            UNION ALL SELECT new_key, article_id, 2, from_id FROM moved
            UNION ALL SELECT title_key, moved.article_id, 3, rd.from_id FROM rd JOIN moved ON new_key = target)
        SELECT title_key, article_id FROM every WHERE title_key NOT IN (SELECT k FROM articles)
        QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY step, from_id, article_id) = 1""",
}
