"""Blind-graded evaluations: sets and keys, unblinding, shares, wins, sign tests, differences of result lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blind(answers: DataFrame, seed: int, letters: str = "ABCDEFGH") -> DataFrame:
    """answers (id, system, answer) with a letter each, in an order that only the seed fixes; the key is (id, letter, system).

    Beyond the letters given, two are joined: AA, AB, and so on.
    """
    w = Window.partitionBy("id").orderBy(F.xxhash64("id", "system", F.lit(seed)), "system")
    place, n = F.row_number().over(w) - 1, len(letters)
    letter = lambda k: F.substring(F.lit(letters), k + 1, F.lit(1))
    two = F.concat(letter((F.floor(place / n) - 1).cast("int")), letter(place % n))
    return answers.withColumn("letter", F.when(place < n, letter(place)).otherwise(two))


def common_ids(sets: list[DataFrame]) -> DataFrame:
    """Ids that every set has."""
    every = sets[0].select("id").distinct()
    for other in sets[1:]:
        every = every.join(other.select("id").distinct(), "id", "left_semi")
    return every


def unblinded(grades: DataFrame, key: DataFrame) -> DataFrame:
    """grades (id, scores map letter to score) as (id, system, score), by the key (id, letter, system)."""
    return grades.select("id", F.explode("scores").alias("letter", "score")).join(key, ["id", "letter"]).select("id", "system", "score")


def missing(key: DataFrame, grades: DataFrame) -> DataFrame:
    """Ids in the key without grades."""
    return key.select("id").distinct().join(grades, "id", "left_anti")


def share_rollup(scores: DataFrame, category: str, ours: Column, reference: Column) -> DataFrame:
    """Per category and over all (null): n, means, our total as a share of the reference's, wins, losses and ties."""
    return scores.rollup(category).agg(
        F.count("*").alias("n"), F.avg(ours).alias("mean"), F.avg(reference).alias("reference_mean"), (F.sum(ours) / F.sum(reference)).alias("share"),
        F.median(ours).cast("double").alias("median"), F.count_if(ours > reference).alias("wins"), F.count_if(ours < reference).alias("losses"),
        F.count_if(ours == reference).alias("ties"),
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided sign test: twice the chance of so few of the rarer outcome, at most 1; 1 without outcomes.

    Binomial terms are built one from the other, in logarithms, so no count overflows.
    """
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct((-n * math.log(2)).cast("double").alias("term"), F.lit(0.0).alias("sum"))
    grown = lambda a, i: F.struct(
        (a["term"] + F.log(n - i) - F.log(i + F.lit(1.0))).alias("term"), (a["sum"] + F.exp(a["term"])).alias("sum")
    )
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, grown)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(2 * total, F.lit(1.0)))


def effect_counts(rows: DataFrame, form: str, effect: str, effects: list[str]) -> DataFrame:
    """Counts of each effect by form, 0 where none."""
    return rows.groupBy(form).pivot(effect, effects).agg(F.count(F.lit(1))).na.fill(0)


def key_facts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums of `hit/of` strings (facts) and of fabricated flags."""
    part = lambda i: F.get(F.split("facts", "/"), F.lit(i)).try_cast("long")
    return rows.groupBy(*by).agg(F.sum(part(0)).alias("hit"), F.sum(part(1)).alias("of"), F.count_if("fabricated").alias("fabricated"))


def retrieval_difference(one: DataFrame, two: DataFrame, cut: int = 120) -> DataFrame:
    """(question, same, one, two): two builds' hits (question, rank, title, section, via, text) compared as lists.

    Whole texts are compared; the lists show `cut` characters of each.
    """
    shown = ["rank", "title", "section", "via", "text"]
    listed = lambda hits, name: hits.groupBy("question").agg(
        F.sort_array(F.collect_list(F.struct("rank", "title", "section", "via", F.substring("text", 1, cut).alias("text"), F.sha2("text", 256).alias("whole")))).alias(name)
    )
    both = listed(one, "one").join(listed(two, "two"), "question", "full_outer").withColumn("same", F.col("one").eqNullSafe(F.col("two")))
    short = lambda name: F.transform(name, lambda h: F.struct(*[h[c].alias(c) for c in shown])).alias(name)
    return both.select("question", short("one"), short("two"), "same")


def conversations(turns: DataFrame, id_col: str, order: str, role: str, text: str, cut: int = 60) -> DataFrame:
    """One row per conversation: its turns in order, how many, and its title, the first question cut short."""
    return turns.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct(order, role, text))).alias("turns"), F.count("*").alias("n_turns"),
        F.substring(F.min_by(F.when(F.col(role) == "user", F.col(text)), F.when(F.col(role) == "user", F.col(order))), 1, cut).alias("title"),
    )


def previous_exchange(turns: DataFrame, id_col: str, order: str, role: str, text: str) -> DataFrame:
    """Each question with the question and answer before it in its conversation."""
    w = Window.partitionBy(id_col).orderBy(order)
    before = lambda who: F.last(F.when(F.col(role) == who, F.col(text)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = turns.select("*", before("user").alias("last_question"), before("assistant").alias("last_answer"))
    return marked.where(F.col(role) == "user")


def sampled(articles: DataFrame, views: tuple[int, int], chars: int, n: int, seed: int) -> DataFrame:
    """n articles of middling views and enough text, not lists, in an order that only the seed fixes."""
    fit = F.col("views").between(*views) & (F.length("text") > chars) & ~F.col("title").rlike("^(List of|Timeline of)")
    return articles.where(fit).orderBy(F.xxhash64("article_id", F.lit(seed)), "article_id").limit(n)
