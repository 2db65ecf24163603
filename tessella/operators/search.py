"""Full-text index and BM25 as tables: postings, lengths, document frequencies, ranked hits.

An index is made once and joined: a question's terms are a small table joined to
postings on the term, contributions are summed per (question, document), and the
top hits are taken by a window that Spark limits per group before shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.sums import ordered_sum

#: Fixed values of the ranking formula.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows of questions' terms that are taken as a local table, and terms that are pushed into a scan.
FEW, PUSHED = 20_000, 200


def plain_tokens(text: str | Column) -> Column:
    """Runs of a-z of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def _weighed(weight: float):
    return lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))


def postings(docs: DataFrame, id_col: str, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """(id, term, tf, dl): weighted term frequency over the fields, and the plain token count of all.

    fields: name to (array of tokens, weight). One shuffle on (id, term); map-side
    sums keep repeated words out of it.
    """
    tokens = F.concat(*[
        F.transform(column, _weighed(float(weight)))
        for column, weight in fields.values()
    ])
    spread = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    spread = spread.select("id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("t"))
    return spread.groupBy("id", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"), F.first("dl").alias("dl"))


def document_frequency(posts: DataFrame, min_doc: int = 1) -> DataFrame:
    """(term, doc): documents that hold the term, where at least min_doc do."""
    return posts.groupBy("term").agg(F.count("*").alias("doc")).where(F.col("doc") >= min_doc)


def collection(posts: DataFrame) -> DataFrame:
    """One row: n documents with a token, and their mean length."""
    lengths = posts.groupBy("id").agg(F.first("dl").alias("dl"))
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def collection_of(docs: DataFrame, fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """collection() from the documents: lengths are counted where they are read, and only sums are shuffled."""
    dl = F.size(F.concat(*[column for column, _ in fields.values()])).cast("long")
    return docs.select(dl.alias("dl")).where("dl > 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def few(rows: DataFrame, most: int = FEW) -> DataFrame | None:
    """rows as a local table if they are at most `most`, else None: a question's terms, say, which Spark then knows to be small."""
    found = rows.limit(most + 1).collect()
    return rows.sparkSession.createDataFrame(found, rows.schema) if len(found) <= most else None


def bm25(posts: DataFrame, terms: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(question, id, score) of every document that holds a term of a question (question, term).

    The idf is ln((n - df + 0.5) / (df + 0.5)), floored; postings meet the
    question's terms before anything is counted, so only their lists are read: up to
    PUSHED terms reach the scan as a filter. Parts are added in the order of terms, so
    copies have equal scores however rows are dealt.
    """
    wanted = terms.select("question", "term").distinct()
    small = few(wanted)
    if small is None:
        mine = posts.join(wanted.select("term").distinct(), "term", "left_semi")
    else:
        wanted = small
        names = sorted({r.term for r in wanted.collect()})
        mine = posts.where(F.col("term").isin(names)) if len(names) <= PUSHED else posts.join(wanted.select("term").distinct(), "term", "left_semi")
    stats = collection(posts) if stats is None else stats
    df = document_frequency(mine)
    idf = F.log((F.col("n") - F.col("doc") + 0.5) / (F.col("doc") + 0.5))
    weighed = df.crossJoin(F.broadcast(stats)).select(
        "term", "avgdl", F.greatest(idf, F.lit(IDF_FLOOR)).alias("idf")
    )
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return (
        mine.join(weighed, "term").join(wanted, "term").groupBy("question", "id").agg(ordered_sum(part, "term").alias("score"))
    )


def with_prior(hits: DataFrame, views: DataFrame, prior: float = 2.0) -> DataFrame:
    """hits with the popularity prior added: prior x log10(1 + views)."""
    return hits.join(views, "id").withColumn("score", F.col("score") + prior * F.log10(1 + F.col("views")))


def top(hits: DataFrame, k: int, order: list[Column] | None = None, by: str = "question") -> DataFrame:
    """The first k hits of each question with their rank; ties, to nine decimals, by id."""
    order = order or [F.round("score", 9).desc(), F.col("id")]
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def capped(hits: DataFrame, group: str, cap: int = 2, by: str = "question") -> DataFrame:
    """At most `cap` hits of a group (an article) for each question, best first; ties, to nine decimals, by id, larger first."""
    best = Window.partitionBy(by, group).orderBy(F.round("score", 9).desc(), F.col("id").desc())
    return hits.withColumn("of_group", F.row_number().over(best)).where(F.col("of_group") <= cap).drop("of_group")


def gated(hits: DataFrame, coverage_least: float, views_least: int, cap: int = 2, group: str = "article") -> DataFrame:
    """hits (question, id, score, coverage, views, and a group) that cover enough of the question and are read enough, then capped by group."""
    return capped(hits.where((F.col("coverage") >= coverage_least) & (F.col("views") >= views_least)), group, cap)


def idf_terms(posts: DataFrame, n_indexed: int | Column) -> DataFrame:
    """(term, doc, idf): idf is ln(n_indexed / documents)."""
    n = F.lit(n_indexed) if isinstance(n_indexed, int) else n_indexed
    return document_frequency(posts).withColumn("idf", F.log(n / F.col("doc")))


def query_terms(stems: DataFrame, max_df: float = 0.02, keep_min: int = 3) -> DataFrame:
    """(question, term, idf) without very common terms, as long as keep_min rarer ones stay; else the keep_min rarest.

    Ties keep the order of terms, as a stable sort of a sorted list does.
    """
    rarest = Window.partitionBy("question").orderBy(F.col("idf").desc(), F.col("term"))
    rare = F.col("idf") >= F.log(F.lit(1 / max_df))
    whole = Window.partitionBy("question")
    ranked = stems.withColumn("place", F.row_number().over(rarest)).withColumn(
        "rare", F.count(F.when(rare, 1)).over(whole)
    )
    keep = F.when(F.col("rare") >= keep_min, rare).otherwise(F.col("place") <= keep_min)
    return ranked.where(keep).select("question", "term", "idf")


def coverage(pairs: DataFrame, stems: DataFrame, text_col: str = "text") -> DataFrame:
    """pairs (question, id, text) with the share of the question's idf mass whose terms begin a word of the text."""
    low = F.lower(text_col)
    prefix = F.regexp_replace("term", "^(...+)i$", "$1")
    bag = stems.groupBy("question").agg(F.collect_list(F.struct(prefix.alias("prefix"), "idf")).alias("bag"))
    local = few(bag)
    bag = bag if local is None else local
    held = F.filter("bag", lambda s: F.regexp_like(low, F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), s["prefix"])))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda n, s: n + s["idf"])
    whole = total(F.col("bag"))
    return pairs.join(bag, "question").select(
        *pairs.columns, F.when(whole == 0, total(held)).otherwise(total(held) / whole).alias("coverage")
    )


def affinity(ours: DataFrame, theirs: DataFrame, unseen: float, foreign_ratio: float = 0.5) -> DataFrame:
    """(question, best, foreign): how much a question belongs to a library rather than an encyclopedia.

    ours, theirs: (question, term, idf). A term's log ratio is its encyclopedia idf
    (or `unseen`) less its library idf; best is the largest. foreign is the share
    of idf weight in terms that the library lacks or holds no more often.
    """
    both = theirs.select("question", "term", F.col("idf").alias("w")).join(
        ours.select("question", "term", F.col("idf").alias("p")), ["question", "term"], "full_outer"
    ).withColumn("w", F.coalesce("w", F.lit(float(unseen))))
    ratio = F.col("w") - F.col("p")
    away = F.when(F.col("p").isNull() | (ratio < foreign_ratio), F.col("w")).otherwise(0.0)
    summed = both.groupBy("question").agg(F.max(ratio).alias("best"), F.sum(away).alias("away"), F.sum("w").alias("total"))
    return summed.select("question", "best", F.when(F.col("total") == 0, 1.0).otherwise(F.col("away") / F.col("total")).alias("foreign"))


def library_route(scores: DataFrame, min_ratio: float = 3.0, max_foreign: float = 0.25) -> DataFrame:
    """affinity() with `route`: true where the library answers."""
    return scores.withColumn(
        "route", F.coalesce((F.col("best") >= min_ratio) & (F.col("foreign") < max_foreign), F.lit(False))
    )
