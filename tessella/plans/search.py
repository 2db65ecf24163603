"""Queries of the full-text index, ranking and routing, with the same in DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.questions import STOP
from tessella.functions.stemming import porter_tokens, question_stems, stemmed_again
from tessella.operators import search as s
from tessella.operators.retrieval import travels
from tessella.plans.tables import ARTICLES, articles, read
from tessella.sources.readers import input_stamp
from tessella.sources.scratch import new_path
from tessella.sources.writers import by_term

QUESTION = "aning nicht inble"


#: Bytes of documents for a bucket of the index, and the least buckets.
_BUCKET_BYTES, _LEAST_BUCKETS = 64 << 20, 8


def _fields(stemmed: bool) -> dict:
    return {"title": (porter_tokens("title"), 8.0), "body": (porter_tokens("text"), 1.0)} if stemmed else {"body": (s.plain_tokens("text"), 1.0)}


def _stands(spark: SparkSession, table: str) -> bool:
    """Whether a table and its files are there. A lasting catalog may name tables whose scratch files are gone: those are dropped."""
    if not spark.catalog.tableExists(table):
        return False
    files = spark.table(table).inputFiles()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]) if files else None
    if where is not None and where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return True
    for name in (table, table.replace("_stats", "_posts")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return False


def _index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the documents, as tables by term that a session builds once for the same files."""
    path = f"{sf_dir}/documents.parquet"
    name = f"index_{'stem' if stemmed else 'plain'}_{input_stamp(spark, [path])[:24]}"
    if not _stands(spark, f"{name}_stats"):
        folder, docs = new_path(spark, "index"), articles(spark, sf_dir)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
        fields = _fields(stemmed)
        by_term(s.postings(docs, "article_id", fields), f"{name}_posts", max(_LEAST_BUCKETS, size // _BUCKET_BYTES), f"{folder}/posts")
        s.collection_of(docs, fields).write.mode("overwrite").option("path", f"{folder}/stats").saveAsTable(f"{name}_stats")
    return spark.table(f"{name}_posts"), spark.table(f"{name}_stats")


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[0]


def _hits(spark: SparkSession, sf_dir: str, terms: DataFrame, stemmed: bool = False) -> DataFrame:
    posts, stats = _index(spark, sf_dir, stemmed)
    return s.bm25(posts, terms, stats)


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that the other queries read: documents and their mean length."""
    return _index(spark, sf_dir)[1].select("n", F.round("avgdl", 6).alias("avgdl"))


def _question(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.createDataFrame([("q", t) for t in text.split()], "question string, term string")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(F.col("article_id").alias("id"), "views", "source")


def _out(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), *more)


def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(s.top(_hits(spark, sf_dir, _question(spark)), 10), F.col("rank").cast("long").alias("rank"))


def bm25_prior_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = s.with_prior(_hits(spark, sf_dir, _question(spark)), _views(spark, sf_dir))
    return _out(s.top(hits, 10), "views")


def bm25_per_article_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = s.top(s.with_prior(_hits(spark, sf_dir, _question(spark)), _views(spark, sf_dir)), 80)
    return _out(s.capped(pool, "source", 2), "source")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question"), F.explode(F.array_distinct(s.plain_tokens("text"))).alias("term"), "text"
    )


def _item_stems(spark: SparkSession, sf_dir: str, posts: DataFrame, n: DataFrame | None = None) -> DataFrame:
    """Each benchmark item's distinct terms with their idf; n: one row, the number of indexed documents, that of the whole index unless given."""
    n = _index(spark, sf_dir)[1].select("n") if n is None else n
    idf = s.document_frequency(posts).crossJoin(F.broadcast(n)).select("term", F.log(F.col("n") / F.col("doc")).alias("idf"))
    return _items(spark, sf_dir).drop("text").join(idf, "term")


def bm25_batch_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = _posts(spark, sf_dir)
    terms = s.query_terms(_item_stems(spark, sf_dir, posts))
    return _out(s.top(_hits(spark, sf_dir, terms), 5), F.col("question").alias("item_id"), F.col("rank").cast("long").alias("rank"))


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.document_frequency(_posts(spark, sf_dir), 2)


def idf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").count()
    return s.idf_terms(_posts(spark, sf_dir), n).select("term", "doc", F.round("idf", 6).alias("idf"))


def check_terms_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three rarest terms with enough documents: the statistics' own check."""
    return s.document_frequency(_posts(spark, sf_dir), 5).orderBy("doc", "term").limit(3)


def query_terms_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = s.query_terms(_item_stems(spark, sf_dir, _posts(spark, sf_dir)))
    return kept.select(F.col("question").alias("item_id"), "term", F.round("idf", 6).alias("idf"))


def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each item's five best hits: the share of its idf mass that they hold."""
    posts = _posts(spark, sf_dir)
    stems = _item_stems(spark, sf_dir, posts)
    hits = s.top(_hits(spark, sf_dir, s.query_terms(stems)), 5).select("question", "id")
    pairs = hits.join(articles(spark, sf_dir).select(F.col("article_id").alias("id"), "text"), "id")
    return s.coverage(pairs, stems).select(
        F.col("id").alias("doc_id"), F.col("question").alias("item_id"), F.round("coverage", 6).alias("coverage")
    )


def passage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturated, idf-weighted frequency of the question's terms: two for each in the title."""
    stems = _question(spark).join(s.document_frequency(_posts(spark, sf_dir)), "term")
    n = read(spark, sf_dir, "documents").count()
    bag = stems.agg(F.sort_array(F.collect_list(F.struct("term", F.log(n / F.col("doc")).alias("idf")))).alias("bag"))
    body, head = F.lower("text"), F.lower("title")
    tf = lambda t: F.regexp_count(body, F.concat(F.lit(r"\b"), t)) + 2 * F.regexp_count(head, F.concat(F.lit(r"\b"), t))
    part = F.aggregate("bag", F.lit(0.0), lambda a, b: a + b["idf"] * tf(b["term"]) / (tf(b["term"]) + 1.5))
    whole = F.aggregate("bag", F.lit(0.0), lambda a, b: a + b["idf"])
    return articles(spark, sf_dir).crossJoin(F.broadcast(bag)).select(
        F.col("article_id").alias("doc_id"), F.round(part / whole, 6).alias("score")
    )


def _part_stems(spark: SparkSession, sf_dir: str, part: DataFrame) -> DataFrame:
    """_item_stems() of a part of the documents, from their postings in the whole index."""
    posts = _posts(spark, sf_dir).join(part.select(F.col("article_id").alias("id")), "id", "left_semi")
    return _item_stems(spark, sf_dir, posts, posts.agg(F.count_distinct("id").alias("n")))


def library_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items between a library (documents of src0 to src4) and the rest."""
    docs = articles(spark, sf_dir)
    inside = F.col("source").isin("src0", "src1", "src2", "src3", "src4")

    def stems(part: DataFrame) -> DataFrame:
        return _part_stems(spark, sf_dir, part)

    unseen = math.log(max(1, docs.where(~inside).count()))
    scores = s.library_route(s.affinity(stems(docs.where(inside)), stems(docs.where(~inside)), unseen))
    return scores.select(
        F.col("question").alias("item_id"), F.round("best", 6).alias("best"), F.round("foreign", 6).alias("foreign"), "route"
    )


def views_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer first unless the planned article (same number as the item) is little read."""
    planned = read(spark, sf_dir, "benchmark").select("item_id", F.expr("item_id * 5").alias("article_id"))
    joined = planned.join(articles(spark, sf_dir).select("article_id", "title", "views"), "article_id", "left")
    return joined.select(
        "item_id", "title", "views", F.when(F.col("views") < 5000, "sources first").otherwise("answer first").alias("route")
    )


def stem_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.document_frequency(_index(spark, sf_dir, True)[0], 2)


def porter_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("q", QUESTION)], "question string, text string")
    terms = asked.select("question", F.explode(porter_tokens("text")).alias("term"))
    return _out(s.top(_hits(spark, sf_dir, terms, True), 10))


def question_stem_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of each item's content words that the stemmed index knows, and whether they ask about travelling."""
    asked = read(spark, sf_dir, "benchmark").select("item_id", question_stems("text", STOP).alias("stems"))
    known = s.document_frequency(_index(spark, sf_dir, True)[0])
    spread = asked.select("item_id", travels(F.col("stems")).alias("travels"), F.explode("stems").alias("stem"))
    return spread.join(known, spread.stem == known.term).select("item_id", "travels", "stem", stemmed_again("stem").alias("term"), "doc")


def gated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of each item that cover half of it and are read enough, two of a source."""
    stems = _item_stems(spark, sf_dir, _posts(spark, sf_dir))
    hits = s.top(_hits(spark, sf_dir, s.query_terms(stems)), 20).select("question", "id", "score")
    pairs = hits.join(articles(spark, sf_dir).select(F.col("article_id").alias("id"), "text", "views", "source"), "id")
    kept = s.gated(s.coverage(pairs.select("question", "id", "score", "views", "source", "text"), stems), 0.5, 3000, 2, "source")
    return kept.select(F.col("question").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "source")


QUERIES = {
    f.__name__: f
    for f in (
        bm25_index, bm25_top10, bm25_prior_top10, bm25_per_article_cap, bm25_batch_benchmark, doc_freq, idf_terms, check_terms_smallest,
        question_stem_idf, gated_hits, query_terms_prune, coverage_score, passage_score, library_affinity, views_router, stem_index_stats, porter_bm25,
    )
}

_TOKENS = """tok AS (SELECT article_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM articles),
post AS (SELECT id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY 1, 2),
len AS (SELECT id, count(*) AS dl FROM tok GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT term, count(*) AS doc FROM post GROUP BY 1)"""


def _ranked(terms: str) -> str:
    """CTEs: hits (question, id, score) for a CTE named terms (question, term)."""
    return f"""WITH {ARTICLES}, {_TOKENS}, {terms},
hits AS (SELECT t.question, p.id, sum(greatest(ln((n - doc + 0.5) / (doc + 0.5)), 1e-6) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
    FROM terms t JOIN post p USING (term) JOIN df USING (term) JOIN len ON len.id = p.id, stats GROUP BY 1, 2)"""


_FIXED = "terms AS (SELECT 'q' AS question, unnest(['aning', 'nicht', 'inble']) AS term)"
_STEMS = """stems AS (SELECT DISTINCT b.item_id AS question, t.term, ln(stats.n / df.doc) AS idf
    FROM benchmark b, unnest(regexp_extract_all(lower(b.text), '[a-z]+')) AS t(term) JOIN df ON df.term = t.term, stats)"""
_PRUNED = """placed AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY idf DESC, term) AS place,
    count(*) FILTER (idf >= ln(50)) OVER (PARTITION BY question) AS rare FROM stems),
terms AS (SELECT question, term, idf FROM placed WHERE CASE WHEN rare >= 3 THEN idf >= ln(50) ELSE place <= 3 END)"""
_PRIOR = """prior AS (SELECT h.id, h.score + 2 * log10(1 + a.views) AS score, a.views, a.source
    FROM hits h JOIN articles a ON a.article_id = h.id)"""

ORACLES = {
    "bm25_index": f"WITH {ARTICLES}, {_TOKENS} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_top10": f"""{_ranked(_FIXED)} SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank
        FROM hits QUALIFY rank <= 10""",
    "bm25_prior_top10": f"{_ranked(_FIXED)}, {_PRIOR} SELECT id AS doc_id, round(score, 6) AS score, views FROM prior ORDER BY prior.score DESC, id LIMIT 10",
    "bm25_per_article_cap": f"""{_ranked(_FIXED)}, {_PRIOR}, pool AS (SELECT * FROM prior ORDER BY score DESC, id LIMIT 80)
        SELECT id AS doc_id, round(score, 6) AS score, source FROM pool
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY pool.score DESC, id DESC) <= 2""",
    "bm25_batch_benchmark": f"""{_ranked(_STEMS + ", " + _PRUNED)}
        SELECT id AS doc_id, round(score, 6) AS score, question AS item_id,
               row_number() OVER (PARTITION BY question ORDER BY hits.score DESC, id) AS rank FROM hits QUALIFY rank <= 5""",
    "doc_freq": f"WITH {ARTICLES}, {_TOKENS} SELECT term, doc FROM df WHERE doc >= 2",
    "idf_terms": f"WITH {ARTICLES}, {_TOKENS} SELECT term, doc, round(ln((SELECT count(*) FROM documents) / doc), 6) AS idf FROM df",
    "check_terms_smallest": f"WITH {ARTICLES}, {_TOKENS} SELECT term, doc FROM df WHERE doc >= 5 ORDER BY doc, term LIMIT 3",
    "query_terms_prune": f"WITH {ARTICLES}, {_TOKENS}, {_STEMS}, {_PRUNED} SELECT question AS item_id, term, round(idf, 6) AS idf FROM terms",
    "coverage_score": f"""{_ranked(_STEMS + ", " + _PRUNED)},
        best AS (SELECT question, id FROM hits QUALIFY row_number() OVER (PARTITION BY question ORDER BY hits.score DESC, id) <= 5)
        SELECT article_id AS doc_id, question AS item_id, round(coalesce(sum(idf) FILTER (
            regexp_matches(lower(text), '(^|[^\\pL\\pN_])' || regexp_replace(term, '^(...+)i$', '\\1'))), 0) / sum(idf), 6) AS coverage
        FROM best JOIN articles ON article_id = id JOIN stems USING (question) GROUP BY 1, 2""",
    "gated_hits": f"""{_ranked(_STEMS + ", " + _PRUNED)},
        best AS (SELECT question, id, score FROM hits QUALIFY row_number() OVER (PARTITION BY question ORDER BY hits.score DESC, id) <= 20),
        c AS (SELECT question, best.id, any_value(score) AS score, any_value(source) AS source, coalesce(sum(idf) FILTER (
            regexp_matches(lower(text), '(^|[^\\pL\\pN_])' || regexp_replace(term, '^(...+)i$', '\\1'))), 0) / sum(idf) AS coverage
            FROM best JOIN articles ON article_id = id JOIN stems USING (question) WHERE views >= 3000 GROUP BY question, best.id)
        SELECT question AS item_id, id AS doc_id, round(score, 6) AS score, source FROM c WHERE coverage >= 0.5
        QUALIFY row_number() OVER (PARTITION BY question, source ORDER BY c.score DESC, id DESC) <= 2""",
    "passage_score": f"""WITH {ARTICLES}, {_TOKENS}, bag AS (SELECT term, ln((SELECT count(*) FROM documents) / doc) AS idf
            FROM df WHERE term IN ('aning', 'nicht', 'inble')),
        counted AS (SELECT article_id, idf, len(regexp_extract_all(lower(text), '\\b' || term))
            + 2 * len(regexp_extract_all(lower(title), '\\b' || term)) AS tf FROM articles, bag)
        SELECT article_id AS doc_id, round(sum(idf * tf / (tf + 1.5)) / sum(idf), 6) AS score FROM counted GROUP BY 1""",
    "library_affinity": f"""WITH {ARTICLES},
        tok AS (SELECT source IN ('src0', 'src1', 'src2', 'src3', 'src4') AS inside, article_id AS id,
                unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM articles),
        n AS (SELECT inside, count(DISTINCT id) AS n FROM tok GROUP BY 1),
        df AS (SELECT inside, term, count(DISTINCT id) AS doc FROM tok GROUP BY 1, 2),
        idf AS (SELECT inside, term, ln(n / doc) AS idf FROM df JOIN n USING (inside)),
        asked AS (SELECT DISTINCT item_id, t.term FROM benchmark, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t(term)),
        m AS (SELECT item_id, coalesce(w.idf, ln((SELECT count(*) FROM articles WHERE source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4')))) AS w,
                p.idf AS p FROM asked LEFT JOIN idf w ON w.term = asked.term AND NOT w.inside
                LEFT JOIN idf p ON p.term = asked.term AND p.inside WHERE w.idf IS NOT NULL OR p.idf IS NOT NULL),
        g AS (SELECT item_id, max(w - p) AS best, sum(CASE WHEN p IS NULL OR w - p < 0.5 THEN w ELSE 0 END) AS away, sum(w) AS total FROM m GROUP BY 1)
        SELECT item_id, round(best, 6) AS best, round(CASE WHEN total = 0 THEN 1 ELSE away / total END, 6) AS foreign,
               coalesce(best >= 3 AND away / total < 0.25, false) AS route FROM g""",
    "views_router": f"""WITH {ARTICLES} SELECT item_id, title, views, CASE WHEN views < 5000 THEN 'sources first' ELSE 'answer first' END AS route
        FROM benchmark LEFT JOIN articles ON article_id = item_id * 5""",
}
