"""Queries that write the driver's tables in a file format, and read them back through the reader of that format."""

from __future__ import annotations

import hashlib
import sqlite3

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import markup as m
from tessella.functions.html import html_main_text
from tessella.operators import cleaning as k
from tessella.operators import corpus as c
from tessella.operators import search as s
from tessella.plans.tables import ARTICLES, PLACES, articles, places, read
from tessella.sources import readers as r
from tessella.sources import writers as w
from tessella.sources.scratch import new_path


def _lines(spark: SparkSession, rows: DataFrame, name: str, line: Column, files: int | None = None) -> str:
    """rows as lines of text under a new path, in `files` files if given."""
    path, text = new_path(spark, name), rows.select(line.alias("value"))
    (text.coalesce(files) if files else text).write.text(path)
    return path


def _each(spark: SparkSession, rows: DataFrame, name: str, key: str, text: Column) -> str:
    """A file of its own for each row, in a folder named by key. For tables of a few rows."""
    path = new_path(spark, name)
    rows.select(F.col(key), text.alias("value")).write.partitionBy(key).text(path)
    return path


def source_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as article shards, each written twice; one copy is read."""
    path = new_path(spark, "shards")
    shard = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("T"), "doc_id").alias("title"), "text", F.lit(None).cast("string").alias("infoboxes")
    )
    for _ in range(2):
        w.parquet(shard, f"{path}/part={_}", 1 << 20)
    found = r.article_shards(spark, f"{path}/*")
    return found.select("page_id", "title", F.md5("text").alias("text_md5"))


def source_nested_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a nested places table, flattened again."""
    path, p = new_path(spark, "nested"), F.col("p_partkey")
    x, y = (p % 97).cast("double"), (p % 89).cast("double")
    hier = F.when(p % 4 == 0, F.array(F.lit("food"), "p_type")).when(p % 4 == 1, F.array(F.lit("travel"), F.lit("hotel"))).otherwise(F.array(F.lit("shops"), F.lit("books")))
    read(spark, sf_dir, "part").select(
        p.cast("string").alias("id"), F.struct(x.alias("xmin"), (x + 1).alias("xmax"), y.alias("ymin"), (y + 1).alias("ymax")).alias("bbox"),
        F.struct(F.col("p_name").alias("primary")).alias("names"),
        F.struct(F.element_at(hier, -1).alias("primary"), hier.alias("hierarchy"), F.lit(None).cast("array<string>").alias("alternates")).alias("taxonomy"),
        ((p % 10) / 10.0).cast("double").alias("confidence"), F.when(p % 7 == 0, "permanently_closed").alias("operating_status"),
        F.array(F.struct(F.col("p_brand").alias("freeform"), F.col("p_mfgr" if "p_mfgr" in read(spark, sf_dir, "part").columns else "p_brand").alias("locality"), F.lit("C").alias("country"))).alias("addresses"),
        F.array(F.concat(F.lit("https://www.x"), p.cast("string"), F.lit("/"))).alias("websites"), F.lit(None).cast("array<string>").alias("phones"),
        F.struct(F.struct(F.col("p_brand").alias("primary")).alias("names")).alias("brand"),
    ).write.parquet(path)
    rows = k.wanted_places(spark.read.parquet(path), ["food"], ["hotel"], ["books"])
    return rows.select("id", "name", "cat", "conf", "lat", "lon", "street", "website", "brand", "more")


def _document(spark: SparkSession, rows: DataFrame, name: str, head: str, tail: str) -> str:
    """A file of one document: head, the rows (key, value) in order with commas between, tail; no row is the whole."""
    edge = spark.createDataFrame([(-1, -1, head), (1, -1, tail)], "part int, key long, value string")
    body = rows.select(F.lit(0).alias("part"), F.col("key").cast("long").alias("key"), F.concat(F.when(F.col("key") == F.lit(rows.agg(F.min("key")).first()[0]), "").otherwise(", "), "value").alias("value"))
    path = new_path(spark, name)
    edge.unionByName(body).repartition(1).sortWithinPartitions("part", "key").select("value").write.text(path)
    return path


def source_sparql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the bindings of one JSON result; every third doesn't bind a name, names hold quotes and braces."""
    value = lambda c: F.struct(F.lit("literal").alias("type"), c.cast("string").alias("value"))
    name = F.concat("s_name", F.lit(' "}, {\\'))
    row = F.struct(value(F.col("s_suppkey")).alias("s"), F.when(F.col("s_suppkey") % 3 != 0, value(name)).alias("name"))
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.to_json(row).alias("value"))
    path = _document(spark, rows, "sparql", '{"head": {"vars": ["s", "name"]}, "results": {"bindings": [', "]}}")
    return r.sparql_bindings(spark, path, ["s", "name"]).select(F.col("s").cast("long").alias("s_suppkey"), "name")


def source_tag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tag triples, pivoted for those that have a brand or a type."""
    p = F.col("p_partkey")
    tags = F.filter(F.array(
        F.struct(F.lit("name").alias("key"), F.col("p_name").alias("value")), F.struct(F.when(p % 2 == 0, "brand").alias("key"), F.col("p_brand").alias("value")),
        F.struct(F.when(p % 3 == 0, "type").alias("key"), F.col("p_type").alias("value")),
    ), lambda t: t["key"].isNotNull())
    triples = read(spark, sf_dir, "part").select(p.alias("s"), F.explode(tags).alias("t")).select("s", "t.*")
    return r.pivoted_tags(triples, ["name", "brand", "type"], ["brand", "type"])


def source_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts through the TSV writer and reader, below a comment line."""
    path = new_path(spark, "tsv")
    w.tsv(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), f"{path}/a", header=False)
    spark.createDataFrame([("# key name brand",)], "value string").write.text(f"{path}/b")
    return r.tsv(spark, f"{path}/*", "p_partkey long, p_name string, p_brand string", comment="#")


def source_pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as view counts of two wikis; malformed pages go."""
    key = F.col("l_partkey")
    line = F.concat_ws(
        " ", F.when(F.col("l_linenumber") % 5 == 0, "de.wikipedia").otherwise("en.wikipedia"), F.lit("Title"),
        F.when(key % 11 == 0, "null").otherwise(key.cast("string")), F.lit("desktop"), F.col("l_quantity").cast("long").cast("string"),
    )
    return r.pageview_dump(spark, _lines(spark, read(spark, sf_dir, "lineitem"), "views", line))


def source_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the tuples of a redirect dump, with escapes; every fourth in another namespace."""
    p = F.col("p_partkey")
    tuple_ = F.concat(F.lit("("), p.cast("string"), F.lit(","), F.when(p % 4 == 0, "1").otherwise("0"), F.lit(",'"), F.translate("p_name", " ", "_"), F.lit(r"\'s','','')"))
    lines = read(spark, sf_dir, "part").groupBy((p % 50).alias("g")).agg(F.concat(F.lit("INSERT INTO `redirect` VALUES "), F.concat_ws(",", F.collect_list(tuple_)), F.lit(";")).alias("l"))
    return r.redirect_dump(spark, _lines(spark, lines, "redirects", F.col("l")))


def source_page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an index with colons in titles; those of size 1 to 25 are wanted."""
    part = read(spark, sf_dir, "part")
    line = F.concat_ws(":", (F.col("p_partkey") * 100).cast("string"), F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"))
    wanted = part.where("p_size <= 25").select(F.col("p_partkey").alias("id"))
    return r.page_index(spark, _lines(spark, part, "index", line), wanted)


def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the pages of an XML dump; every third in another namespace, even ones redirect."""
    p = F.col("p_partkey")
    page = F.concat(
        F.lit("<page><title>"), "p_name", F.lit("</title><ns>"), F.when(p % 3 == 0, "10").otherwise("0"), F.lit("</ns><id>"), p.cast("string"), F.lit("</id>"),
        F.when(p % 2 == 0, F.concat(F.lit('<redirect title="'), "p_brand", F.lit('"/>'))).otherwise(""),
        F.lit('<revision><id>1</id><text bytes="9">'), "p_type", F.lit(" &amp; more</text></revision></page>"),
    )
    dumps = read(spark, sf_dir, "part").groupBy((p % 16).alias("g")).agg(F.concat_ws("\n", F.collect_list(page)).alias("pages"))
    path = _each(spark, dumps, "xml", "g", F.concat(F.lit("<mediawiki>\n"), "pages", F.lit("\n</mediawiki>")))
    return r.xml_pages(spark, f"{path}/*")


def source_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as Markdown files with front matter; a skipped folder is left out."""
    text = F.concat(F.lit('---\nTitle: "'), "n_name", F.lit('"\nregion: '), F.col("n_regionkey").cast("string"), F.lit("\n---\n# Body of "), "n_name", F.lit("\n"))
    path = _each(spark, read(spark, sf_dir, "nation"), "front", "n_nationkey", text)
    found = r.front_matter(spark, path, ("n_nationkey=3",), "*.txt")
    return found.select(F.element_at("meta", "title").alias("title"), F.element_at("meta", "region").cast("long").alias("region"), F.rtrim("body", F.lit("\n")).alias("body"))


def source_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as HTML pages with menus, scripts and lists; the main text is read."""
    page = F.concat(
        F.lit("<html><head><title>"), "p_name", F.lit(" | Site</title><script>x()</script></head><body><nav>menu</nav><main><h2>"), "p_brand",
        F.lit("</h2><p>size <b>"), F.col("p_size").cast("string"), F.lit("</b></p><ul><li>"), "p_type", F.lit("</li></ul></main><footer>out</footer></body></html>"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", html_main_text(page).alias("page")).select("p_partkey", "page.*")


def source_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as laid-out pages with running heads, page numbers and hyphens at line ends; the prose is read."""
    first = F.concat(F.lit("Running head\nfront matter that goes\n1. Section of "), F.initcap("p_name"), F.lit("\n"))
    prose = "The scheme is described here in all its parts, with what is wanted for every well-\nmeaning reader of these pages and for the\nothers."
    pages = F.concat(first, F.lit(f"{prose}\n\n7\n\fRunning head\n2. Empty one\n\fRunning head\n3. Last Words\n{prose}\n8\n"))
    prosed = F.pandas_udf(lambda t: t.map(m.pdf_prose), "string")
    return read(spark, sf_dir, "part").select("p_partkey", prosed(pages).alias("text"))


def source_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON lines; those of nation 3 are done already."""
    path, customer = new_path(spark, "lines"), read(spark, sf_dir, "customer")
    w.json_lines(customer.select(F.col("c_custkey").alias("id"), "c_name", "c_nationkey"), path)
    done = customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    return r.json_lines(spark, path, "id long, c_name string, c_nationkey long", done)


def source_keyed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one JSON object by key, with nested braces in their names."""
    record = F.to_json(F.struct(F.concat("c_name", F.lit(" {}")).alias("c_name"), "c_nationkey"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('": '), record).alias("value"))
    found = r.keyed_json(spark, _document(spark, rows, "keyed", "{", "}"), "c_name string, c_nationkey long")
    return found.select(F.col("id").cast("long").alias("c_custkey"), "c_name", "c_nationkey")


def source_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tagged log lines, each message going on over a second line, with noise between."""
    prefix, key = "10-02 12:00:00.123  1  2 I App: ", F.col("o_orderkey")
    line = F.concat(F.lit(f"{prefix}run="), (key % 40).cast("string"), F.lit(" t="), key.cast("string"), F.lit("ms text[0]="), "o_orderstatus", F.lit(f"\nnoise\n{prefix}more "), "o_orderpriority")
    path = _lines(spark, read(spark, sf_dir, "orders"), "runs", line)
    return r.run_log(spark, path, "App").select("run", "t_ms", F.replace("message", F.lit("\n"), F.lit("|")).alias("message"))


def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each nation-like group as metric files with settings, a header and -1 for unknown."""
    p = F.col("p_partkey")
    row = F.concat_ws(",", p.cast("string"), F.when(p % 3 == 0, "-1").otherwise(F.col("p_size").cast("string")))
    files = read(spark, sf_dir, "part").groupBy((p % 5).alias("g")).agg(F.concat_ws("\n", F.collect_list(row)).alias("rows"))
    text = F.concat(F.lit("# model=m"), F.col("g").cast("string"), F.lit(" threads=4\nkey,size\n"), "rows", F.lit("\n# summary x=1\n"))
    settings, rows = r.metrics_csv(spark, _each(spark, files, "metrics", "g", text), ("size",))
    joined = rows.join(settings, "file")
    return joined.select(F.element_at("row", "key").cast("long").alias("p_partkey"), F.element_at("row", "size").cast("long").alias("size"), F.element_at("settings", "model").alias("model"))


def source_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in `DONE {json}` lines among others."""
    body = F.concat(F.lit("DONE "), F.to_json(F.struct("doc_id", "text")), F.lit("\nother line"))
    found = r.protocol_lines(spark, _lines(spark, read(spark, sf_dir, "documents"), "protocol", body), "DONE", "doc_id long, text string")
    return found.select("doc_id", F.md5("text").alias("text_md5"))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*fields: tuple[int, int | bytes]) -> bytes:
    return b"".join(_varint(i << 3 | 2) + _varint(len(v)) + v if isinstance(v, bytes) else _varint(i << 3) + _varint(v) for i, v in fields)


def source_power_rails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as binary traces, a rail named by status with one energy sample each."""

    @F.pandas_udf("binary")
    def encoded(key: pd.Series, status: pd.Series) -> pd.Series:
        return pd.Series([
            _message((1, _message((40, _message((1, _message((1, 7), (2, s.encode()))), (2, _message((1, 7), (2, x), (3, x * 1000))))))), (1, _message((8, 5))))
            for x, s in zip(key, status, strict=True)
        ])

    traces = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), encoded("o_orderkey", "o_orderstatus").alias("content"))
    return r.rails_of(traces)


def source_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sampler's lines, two values after each time."""
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("T "), key, F.lit(" "), (F.col("o_orderkey") % 100).cast("string"), F.lit(".5\ncpu0 "), key, F.lit(" 6\nS "), "o_orderstatus")
    return r.sampler_log(spark, _lines(spark, read(spark, sf_dir, "orders"), "sampler", line)).drop("file")


def source_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in a SQLite file in a folder that all executors share, read in ranges of row ids."""
    folder = new_path(spark, "sqlite").removeprefix("file:")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    path = f"{'/' + folder.lstrip('/')}/t.db"
    base = sqlite3.connect(path)
    base.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
    rows = [tuple(x) for x in read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()]
    base.executemany("INSERT INTO nation VALUES (?, ?, ?)", rows)
    base.commit()
    base.close()
    return r.sqlite_table(spark, path, "nation", "n_nationkey long, n_name string, n_regionkey long")


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read by key: those that benchmark items name, from files ranged by id."""
    path = new_path(spark, "blocks")
    docs = articles(spark, sf_dir).select("article_id", "title", "text")
    docs.repartitionByRange(8, "article_id").sortWithinPartitions("article_id").write.option("parquet.block.size", 1 << 20).parquet(path)
    asked = read(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("article_id")).distinct()
    return spark.read.schema(docs.schema).parquet(path).join(asked, "article_id", "left_semi").select("article_id", "title", F.md5("text").alias("text_md5"))


def source_connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL with arguments over a table of another format."""
    path = new_path(spark, "orc")
    read(spark, sf_dir, "part").write.orc(path)
    return spark.sql("SELECT p_partkey, p_name FROM {t} WHERE p_size <= :most AND p_brand <> :brand", args={"most": 20, "brand": "none"}, t=spark.read.orc(path))


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region checked against a manifest: one hash is wrong, one file is missing."""
    path, rows = new_path(spark, "manifest"), []
    for region in read(spark, sf_dir, "region").collect():
        key, content = region.r_regionkey, f"{region.r_name}\n".encode()
        spark.createDataFrame([(region.r_name,)], "value string").coalesce(1).write.text(f"{path}/{key}")
        at = spark.read.text(f"{path}/{key}").inputFiles()[0]
        rows.append((at.rsplit("/", 1)[-1], len(content), "wrong" if key == 1 else hashlib.sha256(content).hexdigest(), key))
    manifest = spark.createDataFrame([*rows, ("gone", -5, "x", 99)], "name string, bytes long, sha256 string, r_regionkey long")
    found = r.verified_files(spark, f"{path}/*", manifest)
    return manifest.join(found, "name").select("r_regionkey", "good")


def sink_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built once for the same inputs and settings, and again when they change."""
    path, built = new_path(spark, "rebuilt"), []

    def build() -> DataFrame:
        built.append(1)
        return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(len(built)).alias("build"))

    for settings in ("a", "a", "b", "b"):
        found = w.rebuilt(spark, path, [f"{sf_dir}/nation.parquet"], settings, build)
    return found


def sink_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus written and read: articles, chunks of them, postings and document frequencies by term."""
    path, prefix = new_path(spark, "corpus"), new_path(spark, "c").rsplit("/", 1)[-1].replace("-", "_")
    docs = articles(spark, sf_dir)
    chunks = c.chunks(c.usable(docs)).select("article_id", "start", "end")
    w.corpus(docs.select("article_id", "title", "views"), chunks, s.postings(docs, "article_id", {"body": (s.plain_tokens("text"), 1.0)}), path, prefix)
    posts, df = spark.table(f"{prefix}_postings"), spark.table(f"{prefix}_df")
    per = posts.join(df, "term").groupBy(F.col("id").alias("article_id")).agg(F.count("*").alias("terms"), F.sum("doc").alias("docs"))
    return spark.read.parquet(f"{path}/articles").join(per, "article_id", "left").select(
        "article_id", "title", "views", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("docs", F.lit(0)).alias("docs"))


def sink_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in order of grid cell and id, numbered without gaps."""
    path = new_path(spark, "cells")
    cell = F.floor((F.col("lat") + 90) * 2000) * 720000 + F.floor((F.col("lon") + 180) * 2000)
    w.by_cell(places(spark, sf_dir).select("pid", "name", cell.alias("cell")), path)
    return spark.read.parquet(path).select("id", "pid", "name")


def sink_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JSON lines, written and appended to."""
    path, part = new_path(spark, "json"), read(spark, sf_dir, "part").select("p_partkey", "p_name")
    w.json_lines(part, path)
    w.json_lines(part.withColumn("p_name", F.concat(F.lit("é "), "p_name")), path, append=True)
    return spark.read.schema("p_partkey long, p_name string").json(path)


def sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority as a Markdown table."""
    by = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))
    return w.report(by, ["o_orderpriority"])


def sink_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in two boxes, as a fixture keeps them."""
    return w.boxed(places(spark, sf_dir), [(40.0, -8.0, 40.003, -7.997), (40.008, -7.995, 40.009, -7.993)]).select("pid", "name")


def capital_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", k.capital_words(F.col("text")).alias("capitals"))


def kind_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of categories for each category: the least of those its places have."""
    rows = places(spark, sf_dir).select("cat", F.array("src", "cat").alias("hier"))
    return k.path_of_kinds(rows).select("cat", F.array_join("hier", "/").alias("hier"))


def fork_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the rows of a Markdown table of forks, with a link and a date; a row without a date goes."""
    key = F.col("n_nationkey")
    day = F.when(key == 4, "soon").otherwise(F.date_format(F.date_add(F.lit("2015-07-30").cast("date"), (key * 97).cast("int")), "MMM d, yyyy"))
    line = F.concat(F.lit("| [**"), F.initcap("n_name"), F.lit("**](#x) | 1 | "), day, F.lit(" |"))
    return k.fork_dates(read(spark, sf_dir, "nation").select(line.alias("line")), "line")


QUERIES = {
    f.__name__: f
    for f in (
        source_shards, source_nested_places, source_sparql, source_tag_pivot, source_tsv, source_pageviews, source_redirects, source_page_index, source_xml,
        source_front_matter, source_html, source_pdf, source_json_lines, source_keyed_json, source_run_log, source_metrics, source_protocol,
        source_power_rails, source_sampler, source_sqlite, source_blocks, source_connector, source_manifest, sink_rebuilt, sink_corpus, sink_places,
        sink_json_lines, sink_report, sink_extract, capital_words, kind_paths, fork_dates,
    )
}
_PROSE = (
    "The scheme is described here in all its parts, with what is wanted for every well-meaning reader of these pages and for the others."
)
ORACLES = {
    "source_shards": "SELECT doc_id AS page_id, 'T' || doc_id AS title, md5(text) AS text_md5 FROM documents WHERE length(text) >= 200",
    "source_nested_places": """WITH p AS (SELECT p_partkey::VARCHAR AS id, p_name AS name, p_partkey AS k, (p_partkey % 10) / 10.0::DOUBLE AS conf,
            CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'hotel' ELSE 'books' END AS cat, p_brand FROM part WHERE p_partkey % 7 <> 0)
        SELECT id, name, cat, conf, k % 89 + 0.5::DOUBLE AS lat, k % 97 + 0.5::DOUBLE AS lon, p_brand AS street, 'x' || id AS website, p_brand AS brand, k % 4 > 1 AS more
        FROM p WHERE CASE k % 4 WHEN 0 THEN conf >= 0.3 ELSE conf >= 0.5 END""",
    "source_sparql": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_name || ' \"}, {\\' END AS name FROM supplier",
    "source_tag_pivot": "SELECT p_partkey AS s, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS type FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0",
    "source_tsv": "SELECT p_partkey, p_name, p_brand FROM part",
    "source_pageviews": "SELECT l_partkey AS page_id, sum(l_quantity::BIGINT)::BIGINT AS views FROM lineitem WHERE l_linenumber % 5 <> 0 AND l_partkey % 11 <> 0 GROUP BY 1",
    "source_redirects": "SELECT p_partkey AS from_id, p_name || '''s' AS target FROM part WHERE p_partkey % 4 <> 0",
    "source_page_index": "SELECT p_partkey * 100 AS \"offset\", p_partkey AS id, p_name || ':' || p_brand AS title FROM part WHERE p_size <= 25",
    "source_xml": "SELECT p_name AS title, p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS redirect, p_type || ' & more' AS text FROM part WHERE p_partkey % 3 <> 0",
    "source_front_matter": "SELECT n_name AS title, n_regionkey AS region, '# Body of ' || n_name AS body FROM nation WHERE n_nationkey <> 3",
    "source_html": "SELECT p_partkey, p_name AS title, '## ' || p_brand || chr(10) || chr(10) || 'size ' || p_size || chr(10) || chr(10) || '- ' || p_type AS text FROM part",
    "source_pdf": f"""SELECT p_partkey, '## Section of ' || array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || chr(10) || chr(10) || '{_PROSE}'
        || chr(10) || chr(10) || '## Last Words' || chr(10) || chr(10) || '{_PROSE}' AS text FROM part""",
    "source_json_lines": "SELECT c_custkey AS id, c_name, c_nationkey FROM customer WHERE c_nationkey <> 3",
    "source_keyed_json": "SELECT c_custkey, c_name || ' {}' AS c_name, c_nationkey FROM customer",
    "source_run_log": "SELECT o_orderkey % 40 AS run, o_orderkey AS t_ms, 'text[0]=' || o_orderstatus || '|more ' || o_orderpriority AS message FROM orders",
    "source_metrics": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size::BIGINT END AS size, 'm' || p_partkey % 5 AS model FROM part",
    "source_protocol": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "source_power_rails": "SELECT o_orderkey::VARCHAR AS path, o_orderstatus AS rail, o_orderkey AS t_ms, o_orderkey * 1000 AS energy_uws FROM orders",
    "source_sampler": """SELECT o_orderkey::DOUBLE AS epoch, o_orderkey % 100 + 0.5::DOUBLE AS uptime, 'cpu0' AS tag, o_orderkey || ' 6' AS value FROM orders
        UNION ALL SELECT o_orderkey::DOUBLE, o_orderkey % 100 + 0.5::DOUBLE, 'S', o_orderstatus FROM orders""",
    "source_sqlite": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "source_blocks": f"WITH {ARTICLES} SELECT article_id, title, md5(text) AS text_md5 FROM articles WHERE article_id IN (SELECT item_id * 3 FROM benchmark)",
    "source_connector": "SELECT p_partkey, p_name FROM part WHERE p_size <= 20 AND p_brand <> 'none'",
    "source_manifest": "SELECT r_regionkey, r_regionkey <> 1 AS good FROM region UNION ALL SELECT 99, false",
    "sink_rebuilt": "SELECT n_nationkey, n_name, 2 AS build FROM nation",
    "sink_corpus": f"""WITH {ARTICLES}, t AS (SELECT article_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM articles),
        d AS (SELECT term, count(*) AS doc FROM t GROUP BY 1), p AS (SELECT article_id, count(*) AS terms, sum(doc) AS docs FROM t JOIN d USING (term) GROUP BY 1)
        SELECT article_id, title, views, coalesce(terms, 0)::BIGINT AS terms, coalesce(docs, 0)::BIGINT AS docs FROM articles LEFT JOIN p USING (article_id)""",
    "sink_places": f"""WITH {PLACES} SELECT row_number() OVER (ORDER BY floor((lat + 90) * 2000)::BIGINT * 720000 + floor((lon + 180) * 2000)::BIGINT, pid) AS id, pid, name FROM places""",
    "sink_json_lines": "SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, 'é ' || p_name FROM part",
    "sink_report": """SELECT '| o_orderpriority | orders |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL
        SELECT '| ' || o_orderpriority || ' | ' || count(*) || ' |' FROM orders GROUP BY o_orderpriority""",
    "sink_extract": f"WITH {PLACES} SELECT pid, name FROM places WHERE (lat BETWEEN 40.0 AND 40.003 AND lon BETWEEN -8.0 AND -7.997) OR (lat BETWEEN 40.008 AND 40.009 AND lon BETWEEN -7.995 AND -7.993)",
    "capital_words": r"SELECT doc_id, len(regexp_extract_all(text, '(^|\s)\p{Lu}')) AS capitals FROM documents",
    "kind_paths": f"WITH {PLACES} SELECT cat, min(src) || '/' || cat AS hier FROM places GROUP BY cat",
    "fork_dates": """SELECT lower(n_name) AS name, ('2015-07-30'::DATE + (n_nationkey * 97)::INTEGER)::DATE AS day
        FROM nation WHERE n_nationkey <> 4""",
}
