"""Readers of the file formats that corpora, places and telemetry come in.

Everything is read as text or bytes by Spark's own readers and parsed with
expressions; Python only where a format needs a real parser. Schemas are given,
never inferred.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SHARD = "page_id long, title string, text string, infoboxes string"
PAGEVIEWS = "page_id long, views long"


def article_shards(spark: SparkSession, path: str, shortest: int = 200) -> DataFrame:
    """Article shards, four columns, texts of at least `shortest` characters; the first copy of a page by file and place."""
    rows = spark.read.schema(ARTICLE_SHARD).parquet(path).where(F.length("text") >= shortest)
    placed = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    first = Window.partitionBy("page_id").orderBy("file", "row")
    return placed.withColumn("copy", F.row_number().over(first)).where("copy = 1").drop("copy", "file", "row")


def tsv(spark: SparkSession, path: str, schema: str, comment: str | None = None, header: bool = False) -> DataFrame:
    """Tab-separated fields without quoting; lines that start with `comment` are left out."""
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", header)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def pageview_dump(spark: SparkSession, path: str, wiki: str = "en.wikipedia") -> DataFrame:
    """(page_id, views): the fifth field summed per numeric third field, of one wiki's lines."""
    f = F.split("value", " ")
    lines = spark.read.text(path).select(f[0].alias("wiki"), f[2].alias("page"), f[4].try_cast("long").alias("n"))
    mine = lines.where((F.col("wiki") == wiki) & F.col("page").rlike("^[0-9]+$"))
    return mine.groupBy(F.col("page").cast("long").alias("page_id")).agg(F.sum("n").alias("views"))


def redirect_dump(spark: SparkSession, path: str) -> DataFrame:
    """(from_id, target) of a dump's INSERT tuples in namespace 0; backslash escapes undone, underscores are spaces."""
    pattern = r"\((\d+),(-?\d+),'((?:[^'\\]|\\.)*)',"
    part = lambda i: F.regexp_extract_all("value", F.lit(pattern), F.lit(i))
    rows = spark.read.text(path).select(F.explode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("t"))
    target = F.replace(F.regexp_replace("t.c", r"\\(.)", "$1"), F.lit("_"), F.lit(" "))
    return rows.where("t.b = '0'").select(F.col("t.a").cast("long").alias("from_id"), target.alias("target"))


def page_index(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(offset, id, title) of `offset:id:title` lines, colons allowed in titles; only ids of `wanted` if given."""
    f = F.split("value", ":", 3)
    rows = spark.read.text(path).select(f[0].cast("long").alias("offset"), f[1].cast("long").alias("id"), f[2].alias("title"))
    return rows if wanted is None else rows.join(wanted, "id", "left_semi")


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, page_id, redirect, text) of an XML dump's pages in namespace 0."""
    schema = "title string, ns int, id long, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.where("ns = 0").select("title", F.col("id").alias("page_id"), F.col("redirect._title").alias("redirect"), F.col("revision.text._VALUE").alias("text"))


def sparql_bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One column for each name of a SPARQL JSON result's bindings; null where a row doesn't bind it.

    Each row is read by itself, see json_records(): a result of any size is many tasks.
    """
    row = ", ".join(f"`{n}`: struct<value: string>" for n in names)
    rows = json_records(spark, path, 3, r'"bindings"\s*:\s*\[').select(F.from_json("text", f"struct<{row}>").alias("b"))
    return rows.select(*[F.col(f"b.`{n}`.value").alias(n) for n in names])


def pivoted_tags(triples: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """Subjects that have one of the wanted keys, with each of `keys` as a column: optional patterns as a pivot."""
    subjects = triples.where(F.col("key").isin(wanted)).select("s").distinct()
    return subjects.join(triples.where(F.col("key").isin(keys)), "s", "left").groupBy("s").pivot("key", keys).agg(F.min("value"))


def front_matter(spark: SparkSession, path: str, skip: tuple[str, ...] = (), pattern: str = "*.md") -> DataFrame:
    """(path, meta map, body) of Markdown files under a folder; files in skipped subtrees are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("value"))
    for name in skip:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    block = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w-]+:"))
    entry = lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value"))
    meta = F.map_from_entries(F.transform(lines, lambda x: F.struct(entry(x)["key"], F.regexp_replace(entry(x)["value"], r"""^['"]|['"]$""", ""))))
    return files.select("path", meta.alias("meta"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---(?:\n|\z)", "").alias("body"))


def json_lines(spark: SparkSession, path: str, schema: str, done: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Records of a JSON-lines file, blank lines skipped; those whose key is done already are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows if done is None else rows.join(done.select(key), key, "left_anti")


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(id, fields...) of a JSON file that maps ids to records: read record by record, see json_records()."""
    records = json_records(spark, path, 1, r"\{").select(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,struct<{value_schema}>>").alias("m"))
    return records.select(F.explode("m").alias("id", "r")).select("id", "r.*")


def ordered_lines(spark: SparkSession, path: str, separator: str | None = None, blocks: bool = False) -> DataFrame:
    """(file, line, value): lines numbered within their file from 0, however large it is; with `blocks` also the block of each.

    Lines are numbered within the blocks that the file is read in, and blocks by
    the lines before them: no file is one row, one task or one window.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("order"), "value",
    )
    numbered = lines.withColumn("inside", F.row_number().over(Window.partitionBy("file", "block").orderBy("order")))
    sizes = numbered.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    line = (F.col("start") + F.col("inside") - 1).cast("long").alias("line")
    return numbered.join(starts, ["file", "block"]).select("file", *(["block"] if blocks else []), line, "value")


def carried(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """lines (file, block, line, ...) with the last known `value` at or before each line of its file; null before the first.

    A segmented scan: the last value of each block is carried over the blocks after
    it, a few dozen rows a file, and then filled within blocks. So one large file is
    as many tasks as it has blocks.
    """
    marked = lines.withColumn(name, value)
    last = marked.groupBy("file", "block").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("line"))).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carry"))
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(name, ignorenulls=True).over(within), F.col("carry"))
    return marked.join(carry, ["file", "block"]).withColumn(name, filled).drop("carry")


def run_log(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(file, run, t_ms, message) of tagged log lines; lines between that carry no `run=` continue the message before.

    A message is known by the line of its head, which is carried over its lines and over blocks of the file.
    """
    prefix = rf"^\d\d-\d\d \d\d:\d\d:\d\d\.\d+\s+\d+\s+\d+ I {tag}\s*: ?"
    mine = ordered_lines(spark, path, blocks=True).where(F.col("value").rlike(prefix)).withColumn("m", F.regexp_replace("value", prefix, ""))
    head = r"^run=(\d+) t=(\d+)ms ?(.*)$"
    grouped = carried(mine, F.when(F.col("m").rlike(head), F.col("line")), "head").where("head is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "m"))), lambda x: x["m"]), "\n")
    joined = grouped.groupBy("file", "head").agg(text.alias("m"))
    part = lambda i: F.regexp_extract("m", r"(?s)^run=(\d+) t=(\d+)ms ?(.*)$", i)
    return joined.select("file", part(1).cast("long").alias("run"), part(2).cast("long").alias("t_ms"), part(3).alias("message"))


def metrics_csv(spark: SparkSession, path: str, unknown: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(settings, rows) of metric files: `# key=value ...` lines as a map per file, rows as maps of columns by name.

    The first other line is the header. In the columns `unknown`, -1 is null.
    """
    lines = ordered_lines(spark, path).where(F.trim("value") != "")
    pairs = F.flatten(F.collect_list(F.regexp_extract_all("value", F.lit(r"([^\s#=]+=\S+)"), F.lit(1))))
    entries = F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_replace(p, "^[^=]*=", ""))))
    settings = lines.where(F.col("value").startswith("#") & ~F.col("value").startswith("# summary")).groupBy("file").agg(entries.alias("settings"))
    data = lines.where(~F.col("value").startswith("#"))
    header = data.groupBy("file").agg(F.min_by("value", "line").alias("header"), F.min("line").alias("first"))
    rows = data.join(header, "file").where("line > first").select(
        "file", "line", F.map_from_arrays(F.split("header", ","), F.split("value", ",", -1)).alias("row")
    )
    clean = F.transform_values("row", lambda k, v: F.when((k.isin(*unknown) if unknown else F.lit(False)) & (v == "-1"), None).otherwise(v))
    return settings, rows.withColumn("row", clean)


def protocol_lines(spark: SparkSession, path: str, prefix: str, schema: str) -> DataFrame:
    """Records of the lines `PREFIX {json}`."""
    lines = spark.read.text(path).where(F.col("value").startswith(prefix + " "))
    return lines.select(F.from_json(F.substring("value", F.lit(len(prefix) + 2), F.length("value")), schema).alias("r")).select("r.*")


def sampler_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, epoch, uptime, tag, value) of a sampler's lines: each belongs to the last `T epoch uptime` before it, in whichever block that is."""
    lines = ordered_lines(spark, path, blocks=True).where(F.trim("value") != "")
    f = F.split("value", " ")
    head = F.when(f[0] == "T", F.struct(f[1].cast("double").alias("epoch"), f[2].cast("double").alias("uptime")))
    tagged = carried(lines, head, "head").where((f[0] != "T") & F.col("head").isNotNull())
    return tagged.select("file", "head.epoch", "head.uptime", f[0].alias("tag"), F.regexp_replace("value", r"^\S+ ?", "").alias("value"))


def json_records(spark: SparkSession, path: str, depth: int, opening: str) -> DataFrame:
    """(file, record, text): the objects at a depth of JSON files of any size, in order, each as its own text with what names it.

    depth counts the brackets that are open around an object; opening is a pattern,
    without a closing brace in it, of what stands before the first one: what comes
    earlier doesn't count. A file is read in blocks, cut at closing
    braces. Where a piece lies is known from prefix sums, per block and then over
    blocks: quotes before it tell whether it starts inside a string, brackets
    outside of strings how deep it ends, ends at `depth` which record it is of. So
    one document is many tasks, and only a record is put together in one row.
    Commas between records go; `"key": {...}` keeps its key. Files of no object give none.
    """
    pieces = ordered_lines(spark, path, "}", blocks=True).withColumn("value", F.coalesce("value", F.lit("")))
    # Escapes stand in strings alone; without them each quote opens or ends one.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quoted = _prefix(pieces.withColumn("bare", bare).withColumn("quotes", F.length("bare") - F.length(F.replace("bare", F.lit('"')))), "quotes", "before")
    inside = F.col("before") % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), "bare"), r'(?s)"[^"]*("|$)', "")
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x)))
    ends_inside = (F.col("before") + F.col("quotes")) % 2 == 1
    # Each piece but a file's last has lost its closing brace.
    ends = pieces.groupBy("file").agg(F.max("line").alias("last"), F.min(F.when(F.col("value").rlike(opening), F.col("line"))).alias("first"))
    told = quoted.join(ends, "file").withColumn("outside", outside).withColumn("closed", ~ends_inside & (F.col("line") < F.col("last")))
    change = count("outside", "{") + count("outside", "[") - count("outside", "}") - count("outside", "]") - F.col("closed").cast("int")
    deep = _prefix(told.withColumn("change", change), "change", "start")
    closing = F.coalesce(F.col("closed") & (F.col("start") + F.col("change") == depth) & (F.col("line") >= F.col("first")), F.lit(False))
    placed = _prefix(deep.withColumn("end", closing.cast("int")), "end", "record")
    whole = F.concat("value", F.when(F.col("line") < F.col("last"), "}").otherwise(""))
    parts = placed.where("line >= first").select("file", "record", "line", whole.alias("whole"), "end")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "whole"))), lambda x: x["whole"]), "")
    found = parts.groupBy("file", "record").agg(text.alias("text"), F.max("end").alias("ended")).where("ended = 1")
    first = F.regexp_replace("text", rf"(?s)\A.*?{opening}", "")
    return found.select("file", "record", F.regexp_replace(F.when(F.col("record") == 0, first).otherwise(F.col("text")), r"\A[\s,]+", "").alias("text"))


def _prefix(lines: DataFrame, value: str, name: str) -> DataFrame:
    """lines (file, block, line, ...) with the sum of `value` over the lines before each in its file: per block, over blocks, within blocks."""
    sums = lines.groupBy("file", "block").agg(F.sum(value).alias("sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carry"))
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.join(starts, ["file", "block"]).withColumn(name, F.col("carry") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("carry")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message: integers, or bytes of nested messages and strings."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = struct.unpack_from("<Q", data, at)[0], at + 8
        elif kind == 5:
            value, at = struct.unpack_from("<I", data, at)[0], at + 4
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


#: Fixed field numbers of the trace format: packet, power rails, descriptor and energy entries.
PACKET, RAILS, DESCRIPTOR, ENERGY = 1, 40, 1, 2


def rail_samples(trace: bytes) -> list[tuple[str, int, int]]:
    """(rail, t_ms, energy_uws) of a trace's power-rail packets, in order."""
    names, samples = {}, []
    for number, packet in wire_fields(trace):
        if number != PACKET or not isinstance(packet, bytes):
            continue
        for kind, rails in wire_fields(packet):
            if kind != RAILS or not isinstance(rails, bytes):
                continue
            for entry, body in wire_fields(rails):
                if not isinstance(body, bytes):
                    continue
                found = dict(wire_fields(body))
                if entry == DESCRIPTOR:
                    names[found.get(1, 0)] = found.get(2, b"").decode()
                elif entry == ENERGY:
                    samples.append((found.get(1, 0), found.get(2, 0), found.get(3, 0)))
    return [(names.get(i, str(i)), t, e) for i, t, e in samples]


def power_rails(spark: SparkSession, path: str) -> DataFrame:
    """(path, rail, t_ms, energy_uws) of binary traces."""
    return rails_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def rails_of(traces: DataFrame) -> DataFrame:
    """(path, rail, t_ms, energy_uws) of traces (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *sample) for path, content in zip(frame.path, frame.content, strict=True) for sample in rail_samples(content)]
            yield pd.DataFrame(rows, columns=["path", "rail", "t_ms", "energy_uws"])

    return traces.mapInPandas(run, "path string, rail string, t_ms long, energy_uws long")


#: Files of more bytes than this are hashed in ranges, smaller ones as one value; bytes of a range.
HASH_WHOLE, HASH_RANGE = 64 << 20, 8 << 20


def file_hashes(files: DataFrame, wanted: DataFrame, whole: int = HASH_WHOLE, range_bytes: int = HASH_RANGE) -> DataFrame:
    """(path, hash): SHA-256 of the wanted (path) of files (Spark's binaryFile rows), a file a task, its memory the same for any file.

    Files of at most `whole` bytes are read by Spark, from any store it knows;
    larger ones a range at a time, through Arrow's file systems (local, HDFS and object stores).
    """
    mine = files.join(wanted.select("path").distinct(), "path", "left_semi")
    # The bound on length reaches the scan, so contents of larger files aren't read there.
    direct = mine.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("hash"))
    large = mine.select("path", "length").where(F.col("length") > whole).select("path")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame.path:
                store, name = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(path, safe="/:@")))
                digest = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while data := stream.read(range_bytes):
                        digest.update(data)
                yield pd.DataFrame({"path": [path], "hash": [digest.hexdigest()]})

    return direct.unionByName(large.repartition(max(1, large.count()), "path").mapInPandas(run, "path string, hash string"))


def verified_files(spark: SparkSession, path: str, manifest: DataFrame, whole: int = HASH_WHOLE) -> DataFrame:
    """manifest (name, bytes, sha256) with the file that is it, by name, else by size, and whether size and hash agree.

    Files are listed without being read, empty ones aren't listed by Spark and count as missing; only those that the manifest names, or whose size it has, are hashed, see file_hashes().
    """
    files = spark.read.format("binaryFile").load(path)
    there = files.select(F.col("path").alias("at"), F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"))
    asked = manifest.select("name", "bytes", "sha256")
    named = asked.join(there, F.col("file") == F.col("name")).withColumn("by_name", F.lit(True))
    sized = asked.join(there, F.col("size") == F.col("bytes")).withColumn("by_name", F.lit(False))
    best = Window.partitionBy("name").orderBy(F.desc("by_name"), "file")
    first = named.union(sized).withColumn("r", F.row_number().over(best)).where("r = 1")
    hashes = file_hashes(files, first.select(F.col("at").alias("path")), whole).withColumnRenamed("path", "at")
    good = (F.col("size") == F.col("bytes")) & (F.col("hash") == F.col("sha256"))
    checked = first.join(hashes, "at").select("name", "file", good.alias("good"))
    return asked.select("name").join(checked, "name", "left").select("name", "file", F.coalesce("good", F.lit(False)).alias("good"))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, pieces: int = 8) -> DataFrame:
    """A table of a SQLite file that all executors can open, read in ranges of its row ids.

    The file is opened read-only by each task, which sees one range; columns are
    those of the schema, in order.
    """
    import sqlite3

    where = path.removeprefix("file://")
    columns = [f.name for f in T._parse_datatype_string(schema).fields]
    names = ", ".join(f'"{c}"' for c in columns)

    def connect():
        return sqlite3.connect(f"file:{where}?mode=ro&immutable=1", uri=True)

    base = connect()
    low, high = base.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
    base.close()
    low, high = low or 0, high if high is not None else -1
    step = max(1, -(-(high - low + 1) // pieces))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = connect()
        for frame in frames:
            for start in frame.start:
                found = opened.execute(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(start), int(start) + step))
                while rows := found.fetchmany(10_000):
                    yield pd.DataFrame(rows, columns=columns)
        opened.close()

    ranges = spark.range(low, high + 1, step, max(1, pieces)).withColumnRenamed("id", "start")
    return ranges.mapInPandas(run, schema)


def input_stamp(spark: SparkSession, paths: list[str], settings: str = "") -> str:
    """A fingerprint of inputs (path, size, time) and settings: equal stamps mean that a built table can be used again."""
    jvm, parts = spark.sparkContext._jvm, []
    for path in sorted(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in sorted(fs.globStatus(where) or [], key=lambda s: s.getPath().toString()):
            parts.append(f"{status.getPath()}:{fs.getContentSummary(status.getPath()).getLength()}:{status.getModificationTime()}")
    return spark.range(1).select(F.sha2(F.lit("|".join([*parts, settings])), 256)).first()[0]
