"""The opN_ queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.alignment import align
from tessella.llm.archives import archive_digest
from tessella.llm.decontam import contamination, contamination_digest
from tessella.llm.folds import held_out
from tessella.llm.langid import fit_languages, languages
from tessella.llm.media import media_digest
from tessella.llm.mixing import mix
from tessella.llm.neardup import near_duplicates
from tessella.llm.sharding import shard
from tessella.llm.surrogates import surrogates
from tessella.llm.token_files import token_file_digest
from tessella.llm.tokenization import count_tokens
from tessella.llm.toxicity import fit_toxicity, toxicity
from tessella.llm.whitening import whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learnt outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents")
    scored = toxicity(documents, fit_toxicity(documents, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learnt outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents")
    found = languages(documents, fit_languages(documents))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mix(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in each document."""
    documents, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return contamination_digest(contamination(documents, benchmark))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, from token files."""
    return token_file_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its personal data replaced."""
    return surrogates(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document."""
    return shard(_table(spark, sf_dir, "documents")).drop("row_number")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a media file, and what its boxes say."""
    return media_digest(_table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, for each document."""
    return align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding on the first whitened components."""
    return whitening(_table(spark, sf_dir, "embeddings"))


def op13_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's archive record, as packages give it back."""
    return archive_digest(_table(spark, sf_dir, "pages")).drop("error")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_token_files": op5_token_files,
    "op6_token_counts": op6_token_counts,
    "op7_surrogates": op7_surrogates,
    "op8_sharding": op8_sharding,
    "op9_media": op9_media,
    "op10_minhash_neardup": op10_minhash_neardup,
    "op11_alignment": op11_alignment,
    "op12_whitening": op12_whitening,
    "op13_archives": op13_archives,
}

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, source_size * 2 AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS pool,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
g AS (SELECT *, cap / w * open + below <= pool AS is_full FROM f),
h AS (SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS spent, sum(w) FILTER (NOT is_full) OVER () AS rest FROM g),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE w * (pool - spent) / rest END AS target FROM h),
p AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::BIGINT AS taken FROM e
"""

OP4_SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents, fold),
i AS (SELECT item_id, regexp_extract_all(translate(text, a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, fold),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + 9], ' ') AS g
      FROM i, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(k) WHERE len(ws) > 0),
l AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM d, l, unnest(range(1, len(ws) - n + 2)) AS r(k)),
m AS (SELECT o.doc_id, o.k, o.n, g.item_id FROM o JOIN g ON o.g = g.g AND o.n = g.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(range(k, k + n)) AS r(q) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
             ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x AS node, x AS here FROM b UNION SELECT reach.node, b.y FROM reach JOIN b ON b.x = reach.here),
m AS (SELECT node, min(here) AS low FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.low, w.doc_id) AS component_id,
       coalesce(m.low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.node = w.doc_id
"""

OP13_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda k: [
        '0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'
      ][position(h[k] IN '0123456789abcdef')]), '') AS bits FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda k:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[16 * bits[5 * k + 1]::INT + 8 * bits[5 * k + 2]::INT + 4 * bits[5 * k + 3]::INT
                                           + 2 * bits[5 * k + 4]::INT + bits[5 * k + 5]::INT + 1]), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, n) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""

ORACLES = {
    "op3_mixing": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op10_minhash_neardup": OP10_SQL,
    "op13_archives": OP13_SQL,
}
