import bz2
import datetime
import gzip
import hashlib
import json

from pyspark.sql import functions as F

from tessella.operators import telemetry as t
from tessella.sources import readers, writers
from tessella.streaming import live


def put(folder, name, content, opener=open):
    path = folder / name
    with opener(path, "wt", encoding="utf-8") as f:
        f.write(content)
    return str(path)


def test_dumps(spark, tmp_path):
    views = put(tmp_path, "v.bz2", "en.wikipedia A 12 desktop 5\nen.wikipedia A 12 mobile 7\nde.wikipedia A 12 x 9\nen.wikipedia B null x 1\n", bz2.open)
    assert [tuple(r) for r in readers.pageview_dump(spark, views).collect()] == [(12, 12)]
    dump = put(tmp_path, "r.sql.gz", r"INSERT INTO `redirect` VALUES (1,0,'A_b','',''),(2,1,'No','',''),(3,0,'O\'Neil_x','','');" + "\n", gzip.open)
    assert sorted(map(tuple, readers.redirect_dump(spark, dump).collect())) == [(1, "A b"), (3, "O'Neil x")]
    index = put(tmp_path, "i.txt", "5:10:One\n6:11:Two: More\n")
    wanted = spark.createDataFrame([(11,)], "id long")
    assert [r.title for r in readers.page_index(spark, index, wanted).collect()] == ["Two: More"]
    xml = put(tmp_path, "x.xml", "<mediawiki><page><title>T</title><ns>0</ns><id>4</id><redirect title='U'/><revision><id>9</id><text a='1'>body</text></revision></page>"
              "<page><title>N</title><ns>1</ns><id>5</id><revision><text a='1'>no</text></revision></page></mediawiki>")
    assert [tuple(r) for r in readers.xml_pages(spark, xml).collect()] == [("T", 4, "U", "body")]


def test_shards_keep_the_first_copy(spark, tmp_path):
    rows = [(1, "a", "x" * 300, None), (1, "b", "y" * 300, None), (2, "c", "short", None)]
    spark.createDataFrame(rows, readers.ARTICLE_SHARD).coalesce(1).write.parquet(str(tmp_path / "s"))
    assert [r.title for r in readers.article_shards(spark, str(tmp_path / "s")).collect()] == ["a"]


def test_tables_json_and_tags(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "# comment\nAR\tx \"q\"\n")
    assert [tuple(r) for r in readers.tsv(spark, path, "code string, name string", comment="#").collect()] == [("AR", 'x "q"')]
    osm = put(tmp_path, "o.json", json.dumps({"results": {"bindings": [{"s": {"value": "n1"}, "name": {"value": "Bar"}}, {"s": {"value": "n2"}}]}}))
    assert sorted(map(tuple, readers.sparql_bindings(spark, osm, ["s", "name"]).collect())) == [("n1", "Bar"), ("n2", None)]
    triples = spark.createDataFrame([("a", "diet", "v"), ("a", "name", "A"), ("b", "name", "B")], "s string, key string, value string")
    assert [tuple(r) for r in readers.pivoted_tags(triples, ["name", "diet"], ["diet"]).collect()] == [("a", "A", "v")]
    lines = put(tmp_path, "q.jsonl", '{"id": "1", "q": "x"}\n\n{"id": "2", "q": "y"}\n')
    done = spark.createDataFrame([("1",)], "id string")
    assert [r.id for r in readers.json_lines(spark, lines, "id string, q string", done).collect()] == ["2"]
    keyed = put(tmp_path, "k.json", '{"q1": {"A": "x"}, "q2": {"A": "y"}}')
    assert sorted(map(tuple, readers.keyed_json(spark, keyed, "A string").collect())) == [("q1", "x"), ("q2", "y")]


def test_front_matter(spark, tmp_path):
    (tmp_path / "docs" / "skip").mkdir(parents=True)
    put(tmp_path / "docs", "a.md", "---\ntitle: \"T: x\"\nlang: en\n---\n# Body\n")
    put(tmp_path / "docs" / "skip", "b.md", "---\ntitle: no\n---\n")
    (row,) = readers.front_matter(spark, str(tmp_path / "docs"), ("skip",)).collect()
    assert row.meta == {"title": "T: x", "lang": "en"} and row.body == "# Body\n"


def test_logs(spark, tmp_path):
    p = "10-02 12:00:00.123  1  2 I App: "
    log = put(tmp_path, "l.log", f"{p}run=3 t=5ms phase=plan\nnoise\n{p}run=3 t=9ms text[0]=one\n{p}two\n{p}run=4 t=1ms done\n")
    found = sorted((r.run, r.t_ms, r.message) for r in readers.run_log(spark, log, "App").collect())
    assert found == [(3, 5, "phase=plan"), (3, 9, "text[0]=one\ntwo"), (4, 1, "done")]
    csv = put(tmp_path, "m.csv", "# model=x threads=4\na,b,new\n1,-1,q\n2,-1,\n# summary tok=1\n")
    settings, rows = readers.metrics_csv(spark, csv, ("b",))
    assert settings.first().settings == {"model": "x", "threads": "4"}
    assert [r.row for r in rows.orderBy("line").collect()] == [{"a": "1", "b": None, "new": "q"}, {"a": "2", "b": None, "new": ""}]
    wire = put(tmp_path, "p.txt", 'DONE {"id": 1, "tok_s": 2.5}\nother\n')
    assert readers.protocol_lines(spark, wire, "DONE", "id long, tok_s double").first().tok_s == 2.5
    long = "x" * 1_100_000
    wire = put(tmp_path, "long.txt", f'DONE {{"id": 2, "text": "{long}"}}\n')
    assert [(r.id, len(r.text)) for r in readers.protocol_lines(spark, wire, "DONE", "id long, text string").collect()] == [(2, len(long))]
    sampler = put(tmp_path, "s.log", "X early\nT 100 1.5\ncpu0 5 6\nS 31\nT 101 2.5\nS 32\n")
    assert sorted((r.uptime, r.tag, r.value) for r in readers.sampler_log(spark, sampler).collect()) == [(1.5, "S", "31"), (1.5, "cpu0", "5 6"), (2.5, "S", "32")]


def message(*fields):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return b"".join(varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v) for k, v in fields)


def test_power_rails(spark, tmp_path):
    rails = message((1, message((1, 7), (2, b"cpu"))), (2, message((1, 7), (2, 300), (3, 12345))))
    (tmp_path / "t.trace").write_bytes(message((1, message((40, rails))), (1, message((8, 5)))))
    assert [tuple(r)[1:] for r in readers.power_rails(spark, str(tmp_path / "t.trace")).collect()] == [("cpu", 300, 12345)]


def test_manifest_and_stamp(spark, tmp_path):
    put(tmp_path, "a.bin", "hello")
    good = hashlib.sha256(b"hello").hexdigest()
    manifest = spark.createDataFrame([("a.bin", 5, good), ("renamed.bin", 5, good), ("gone", 9, "x")], "name string, bytes long, sha256 string")
    assert {r.name: r.good for r in readers.verified_files(spark, str(tmp_path / "a.bin"), manifest).collect()} == {"a.bin": True, "renamed.bin": True, "gone": False}
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.rebuilt(spark, str(tmp_path / "out"), [str(tmp_path / "a.bin")], "v1", build).count() == 3
    assert len(calls) == 1
    writers.rebuilt(spark, str(tmp_path / "out"), [str(tmp_path / "a.bin")], "v2", build)
    assert len(calls) == 2


def test_writers(spark, tmp_path):
    places = spark.createDataFrame([(i, 7 - i % 3, float(i)) for i in range(30)], "pid long, cell long, lat double")
    writers.by_cell(places, str(tmp_path / "p"), 3)
    rows = sorted(spark.read.parquet(str(tmp_path / "p")).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == list(range(1, 31)) and [(r.cell, r.pid) for r in rows] == sorted((r.cell, r.pid) for r in rows)
    writers.tsv(places, str(tmp_path / "t"))
    writers.json_lines(places, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 30
    assert writers.boxed(places.withColumn("lon", F.lit(0.0)), [(2, -1, 4, 1), (28, -1, 30, 1)]).count() == 5
    arts = spark.createDataFrame([(i, f"t{i}") for i in range(9)], "article_id long, title string")
    assert writers.extract(arts, ["t3"], 2, 5).count() == 3


def test_interpolation_edges(spark):
    samples = spark.createDataFrame([("r", 10, 100.0), ("r", 20, 300.0)], "k string, t long, v double")
    probes = spark.createDataFrame([("r", x, x) for x in (5, 10, 15, 20, 99)], "k string, t long, i long")
    found = {r.i: r.v for r in t.interpolated(probes, samples, "k", "t", "v").collect()}
    assert found == {5: 100.0, 10: 100.0, 15: 200.0, 20: 300.0, 99: 300.0}


def test_streams_match_batch_and_resume(spark, tmp_path):
    schema = "run long, step long, delta string, reset boolean, at timestamp"
    at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
    src = str(tmp_path / "in")
    out, mark = str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([(1, 1, "a", False, at(1)), (1, 2, "b", False, at(2)), (2, 1, "x", False, at(2))], schema).coalesce(1).write.parquet(src)
    stream = lambda: live.accumulated(live.source(spark, src, spark.read.parquet(src).schema), "at", "1 minute")
    live.run_once(stream(), out, mark)
    spark.createDataFrame([(1, 3, "new", True, at(3)), (1, 4, "!", False, at(4))], schema).coalesce(1).write.mode("append").parquet(src)
    live.run_once(stream(), out, mark)
    found = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert found == [(1, 1, "a"), (1, 2, "ab"), (1, 3, "new"), (1, 4, "new!"), (2, 1, "x")]
    # Runs that the watermark has left behind by an hour start anew.
    for rows in ([(3, 1, "z", False, at(1) + datetime.timedelta(hours=5))], [(4, 1, "z", False, at(2) + datetime.timedelta(hours=5))],
                 [(1, 5, "late", False, at(3) + datetime.timedelta(hours=5))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        live.run_once(stream(), out, mark)
    assert (1, 5, "late") in {tuple(r) for r in spark.read.parquet(out).collect()}


def test_windowed_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = live.source(spark, f"{sf_dir}/[e]vents.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    live.run_once(live.deduplicated(events, "ts", ["user_id", "event_type"], "400 days"), str(tmp_path / "d"), str(tmp_path / "dc"))
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct().count()
    assert spark.read.parquet(str(tmp_path / "d")).count() == batch
    live.run_once(live.sessions(events, "ts", "user_id", "2 hours", "1 hour"), str(tmp_path / "s"), str(tmp_path / "sc"))
    assert spark.read.parquet(str(tmp_path / "s")).where("events > 1").count() > 0
