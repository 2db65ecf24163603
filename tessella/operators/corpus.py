"""From article dumps to passages: first copies, tiers, leads, facts, spans, redirects, budgets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.names import ascii_key

#: Fixed values of the passage rules, in code points.
CHUNK, LONGEST, LEAD, SHORTEST = 1000, 1500, 2500, 200
FACT_VALUE, FACTS = 200, 800
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_STOP = re.compile(r"\n|(?<=[.!?])\s+")


def first_copies(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order (dropDuplicates keeps any)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("copy", F.row_number().over(w)).where(F.col("copy") == 1).drop("copy")


def usable(articles: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """Articles of at least `shortest` characters."""
    return articles.where(F.length("text") >= shortest)


def with_views(articles: DataFrame, views: DataFrame) -> DataFrame:
    """Articles with their page views; 0 where there are none."""
    return articles.join(views, "article_id", "left").withColumn("views", F.coalesce("views", F.lit(0)))


def tiers(articles: DataFrame, full: int) -> DataFrame:
    """tier `full` for the `full` most viewed (ties by id; 0: all), else `lead`.

    The border is found by a top-k that Spark computes per task, not by ranking all rows.
    """
    if full == 0:
        return articles.withColumn("tier", F.lit("full"))
    top = articles.select("article_id", "views").orderBy(F.desc("views"), "article_id").limit(full)
    border = top.agg(F.min(F.struct("views", -F.col("article_id"))).alias("b"))
    inside = F.struct("views", -F.col("article_id")) >= F.col("b")
    return articles.crossJoin(F.broadcast(border)).withColumn("tier", F.when(inside, "full").otherwise("lead")).drop("b")


def lead_of(text: str | Column, limit: int = LEAD) -> Column:
    """What stands before the first level-2 heading, cut at the last blank line within limit, or at limit."""
    text = F.col(text) if isinstance(text, str) else text
    lead = F.substring_index(text, "\n## ", 1)
    head = F.substring(lead, 1, limit)
    # The last blank line that starts within the limit and isn't at the very start.
    cut = F.regexp_extract(head, r"(?s)^(.+)\n\n", 1)
    return F.when(F.length(lead) <= limit, lead).when(F.length(cut) > 0, cut).otherwise(head)


def hard_lead_of(text: str | Column, limit: int = LEAD) -> Column:
    """The lead as budgets count it: cut at limit exactly."""
    return F.substring(F.substring_index(text, "\n## ", 1), 1, limit)


def table_chars(text: str | Column) -> Column:
    """Characters in table lines, which start with a bar, and their line ends."""
    rows = F.filter(F.split(text, "\n"), lambda line: line.startswith("|"))
    return F.aggregate(rows, F.lit(0).cast("long"), lambda n, line: n + F.length(line) + 1)


def is_table(body: str | Column) -> Column:
    """Whether more than half of the lines are table lines: such passages aren't indexed."""
    lines = F.split(body, "\n")
    return F.size(F.filter(lines, lambda line: line.startswith("|"))) * 2 > F.size(lines)


def infobox_facts(raw: str | Column) -> Column:
    """`Key facts: name: value; ...` of a JSON list of boxes; empty for none or bad JSON."""
    boxes = F.from_json(raw, T.ArrayType(T.StructType([T.StructField("data", T.MapType(T.StringType(), T.StringType()))])))
    pairs = F.flatten(F.transform(boxes, lambda b: F.coalesce(F.map_entries(b["data"]), F.array().cast("array<struct<key:string,value:string>>"))))
    good = F.filter(pairs, lambda e: (e["key"] != "") & (e["value"] != "") & (F.length(e["value"]) < FACT_VALUE))
    text = F.array_join(F.transform(good, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit("Key facts: "), F.substring(text, 1, FACTS)))


def _pieces(paragraph: str, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of a long paragraph: each ends at the last line or sentence end that fits into limit.

    Where none fits, at the next one within half as much again, else at limit by force.
    """
    stops = [m.end() for m in _STOP.finditer(paragraph)]
    if not stops or stops[-1] < len(paragraph):
        stops.append(len(paragraph))
    begin = 0
    while begin < len(paragraph):
        following, beyond = bisect_right(stops, begin), bisect_right(stops, begin + limit)
        if beyond > following:
            end = stops[beyond - 1]
        else:
            end = stops[following] if stops[following] - begin <= 1.5 * limit else begin + limit
        yield begin, end
        begin = end


class _Path:
    """The heading path in force."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def enter(self, level: int, title: str) -> None:
        self.parts = (self.parts + [""] * level)[: level - 1] + [title]

    def named(self, drop_empty: bool) -> str:
        return " > ".join(p for p in self.parts[1:] if p or not drop_empty)


def chunk_spans(text: str | None, limit: int = CHUNK, longest: int = LONGEST) -> list[tuple[int, int, str]]:
    """(start, end, section) of a text's passages in code points; none crosses a heading.

    Paragraphs are packed up to limit. One above `longest` is cut by itself. A
    heading's line belongs to the path, what follows it in its paragraph to the body.
    """
    text = text or ""
    path, out, pack = _Path(), [], None

    def close() -> None:
        nonlocal pack
        if pack and text[pack[0] : pack[1]].strip():
            out.append((*pack, path.named(False)))
        pack = None

    offset = 0
    for paragraph in text.split("\n\n"):
        start, end = offset, offset + len(paragraph)
        offset = end + 2
        if not paragraph.strip():
            continue
        line, _, body = paragraph.partition("\n")
        heading = _HEADING.match(line)
        if heading:
            close()
            path.enter(len(heading[1]), heading[2].strip())
            if not body:
                continue
            start, paragraph = start + len(line) + 1, body
        if len(paragraph) > longest:
            close()
            out.extend((start + a, start + b, path.named(False)) for a, b in _pieces(paragraph, limit))
            continue
        if pack and end - pack[0] > limit:
            close()
        pack = (pack[0] if pack else start, end)
    close()
    return out


def section_at(text: str, start: int) -> str:
    """The heading path at an offset as lookups name it: without empty levels."""
    path = _Path()
    for heading in re.finditer(r"^(#{1,6})\s+(.*)$", text[:start], re.M):
        path.enter(len(heading[1]), heading[2].strip())
    return path.named(True)


_SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("section", T.StringType()),
]))


@F.pandas_udf(_SPANS)
def _spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("start", "end", "section"), s, strict=True)) for s in chunk_spans(t)], na_action=None)


def chunks(articles: DataFrame) -> DataFrame:
    """(article_id, place, start, end, section, body, is_table) of each article's passages, in order."""
    spread = articles.select("article_id", "text", F.posexplode(_spans("text")).alias("place", "s"))
    body = F.expr("substring(text, s.start + 1, s.end - s.start)")
    return spread.select(
        "article_id", "place", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.section").alias("section"),
        body.alias("body"), is_table(body).alias("is_table"),
    )


def overlaps(spans: DataFrame) -> DataFrame:
    """Passages that begin before their predecessor in the article ends: there should be none."""
    before = F.lag("end").over(Window.partitionBy("article_id").orderBy("start", "place"))
    return spans.withColumn("before", before).where(F.col("start") < F.col("before"))


#: Views below which each number of them is a range of its own, and ids of a part of it.
OWN_VIEWS, RANGE_IDS = 64, 100_000


def budget_marks(articles: DataFrame, marks: list[int]) -> DataFrame:
    """At each mark: articles by views read in full up to it, the share of views, and characters in full and as leads.

    Rows are ranked within ranges of views and the ranges accumulated; up to
    OWN_VIEWS views a range has one number of views and is cut again by id, as most
    articles are read little. So no task holds all articles of a range that grows
    with the corpus; the marks are then sums up to a rank.
    """
    cost = articles.select(
        "article_id", "views", F.length("text").cast("long").alias("full"),
        F.length(hard_lead_of("text")).cast("long").alias("lead"), table_chars("text").alias("tables"),
    )
    few = F.col("views") < OWN_VIEWS
    bucket = F.when(few, F.col("views")).otherwise(OWN_VIEWS + F.floor(F.log2(F.col("views") + 1) * 64))
    order = [F.desc("views"), F.col("article_id")]
    within = Window.partitionBy("bucket", "ids").orderBy(*order)
    per = cost.withColumn("bucket", bucket).withColumn("ids", F.when(few, F.floor(F.col("article_id") / RANGE_IDS)).otherwise(0))
    sums = per.groupBy("bucket", "ids").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("views", "full", "lead", "tables")])
    above = Window.orderBy(F.desc("bucket"), "ids").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("bucket", "ids", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("n", "views", "full", "lead", "tables")])
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.join(earlier, ["bucket", "ids"]).select(
        (F.row_number().over(within) + F.col("n_before")).alias("mark"),
        *[(F.sum(c).over(running) + F.col(f"{c}_before")).alias(c) for c in ("views", "full", "lead", "tables")],
    )
    whole = sums.agg(F.sum("views").alias("all_views"), F.sum("lead").alias("all_lead"))
    return ranked.where(F.col("mark").isin(marks)).crossJoin(F.broadcast(whole)).select(
        F.col("mark").cast("long").alias("mark"), (F.col("views") / F.col("all_views")).alias("share"), F.col("full").alias("chars"),
        (F.col("full") - F.col("tables")).alias("chars_without_tables"), (F.col("all_lead") - F.col("lead")).alias("remaining_leads"),
    )


def resolve_redirects(redirects: DataFrame, index: DataFrame, articles: DataFrame) -> DataFrame:
    """(title_key, article_id): where each redirecting title leads; the first writer of a title wins.

    redirects (from_id, target), index (id, title), articles (article_id, title).
    Passes in order: (1) redirects whose target is an article; (2) articles that
    have been renamed: their own id now redirects, and the new title isn't an
    article; (3) redirects to such new titles. Titles compare without ASCII case.
    """
    named = articles.select("article_id", ascii_key("title").alias("article_key"))
    named = first_copies(named, ["article_key"], [F.col("article_id")])
    source = redirects.join(index, redirects.from_id == index.id).select(
        ascii_key("title").alias("title_key"), ascii_key("target").alias("target_key"), "from_id"
    )
    direct = source.join(named, F.col("target_key") == F.col("article_key")).select("title_key", "article_id", F.lit(1).alias("step"), "from_id")
    moved = source.join(named, F.col("title_key") == F.col("article_key")).select(
        F.col("target_key").alias("new_key"), "article_id", "from_id"
    ).join(named.select(F.col("article_key").alias("new_key")), "new_key", "left_anti")
    renamed = moved.select(F.col("new_key").alias("title_key"), "article_id", F.lit(2).alias("step"), "from_id")
    chained = source.join(moved.select("new_key", "article_id"), F.col("target_key") == F.col("new_key")).select(
        "title_key", "article_id", F.lit(3).alias("step"), "from_id"
    )
    every = direct.unionByName(renamed).unionByName(chained)
    free = every.join(named.select(F.col("article_key").alias("title_key")), "title_key", "left_anti")
    return first_copies(free, ["title_key"], [F.col("step"), F.col("from_id"), F.col("article_id")]).select("title_key", "article_id")
