import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import markup as m
from tessella.operators import cleaning as k
from tessella.operators import evaluation as e
from tessella.operators import places as p
from tessella.operators import retrieval as r
from tessella.operators import search as s


def test_markdown():
    text = '# T\n<!-- x -->\nwrapped\nline [a](b)\n\n| h | k |\n|---|---|\n| 1 | |\n\n```py\nx = 1\n\n# y\n```\n### Deep {#i}\n<Card title="Q">t</Card>\n```mermaid\nno\n```'
    assert m.plain_markdown(text) == "## T\n\nwrapped line a\n\n- h: 1\n\n    x = 1\n    \n    # y\n\n### Deep\n\n**Q** t"
    assert m.plain_markdown(None) == "" and m.plain_markdown("### A", 1) == "## A"
    assert m.without_sections("# T\n\n## See also\nx\n### sub\ny\n## Keep\nz") == "# T\n\n## Keep\nz"
    assert m.document("T", "", "body") == "# T\n\nbody"
    assert m.without_sections("## Tutorials: first\nx\n### y\nz\n## References and more\nkeep\n### Videos\ngone\n### Z\nq") == "## References and more\nkeep\n### Z\nq"


def test_wiki_and_listings():
    wiki = "== Eat ==\n<ref>no</ref>* {{eat|name=Bar [[X|Y]]|address=1 St|content=Nice {{km|5}} place}}\n[[File:x]] '''b''' [http://a.b text]\n{|\ntable\n|}\n;term"
    assert m.plain_wiki(wiki) == "## Eat\n\n- - Bar Y: 1 St. Nice place\nb text\n\nterm"
    assert m.plain_wiki("a {{open") is not None and m.plain_wiki(None) == ""
    guide = "## Eat\n### Budget\n- - Bar. Foo: 12 St. nice\n- - X: no\n## Climate\n- - no: x"
    assert list(m.guide_listings(guide)) == [("Eat", "Budget", "Bar. Foo", "12 St. nice")]


@pytest.mark.parametrize(("text", "kinds"), [
    ("# Noma\n\nNoma is a three-star restaurant in Copenhagen.", {"food"}), ("# X\n\nX is a luxury hotel chain.", set()),
    ("# Paris\n\nParis is the capital city of France.", set()), ("Key facts: a\n\n# BM\n\n51°N\nThe British Museum (BM) is a public museum in London.", {"other"}),
    ("# Site\n\nA World Heritage Site is a landmark.", set()), ("# Ritz\n\nThe Ritz is a hotel and restaurant.", {"food", "lodging"}), ("", set()), (None, set()),
])
def test_lead_kinds(spark, text, kinds):
    row = spark.createDataFrame([(text,)], "t string").select(m.lead_kinds(F.col("t")).alias("k")).first()
    assert set(row.k) == kinds


def test_pdf_prose():
    line = "This document describes the scheme and the way that it works in practice for everyone involved."
    raw = f"Header\nfront matter\n1. Introduction\n{line}\n12\n\fHeader\n2. Empty\n\fHeader\n3. Next\n137   {line}\n138   {line}\n"
    assert m.pdf_prose(raw).startswith(f"## Introduction\n\n{line}\n\n## Next")


def test_coordinates(spark):
    rows = [("35°40′N x 35.67°N 139.76°E",), ("33.9°S 151.2°W",), ("none",)]
    got = [x.c for x in spark.createDataFrame(rows, "t string").select(m.article_coords("t").alias("c")).collect()]
    assert tuple(got[0]) == (35.67, 139.76) and tuple(got[1]) == (-33.9, -151.2) and got[2] is None
    shapes = [("Point(2.5 41.25)",), ("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0), (9 9, 8 8))",), ("POINT EMPTY",)]
    got = [x.c for x in spark.createDataFrame(shapes, "t string").select(m.wkt_point("t").alias("c")).collect()]
    assert tuple(got[0]) == (41.25, 2.5) and tuple(got[1]) == (1.0, 1.0) and got[2] is None


def test_nested_places(spark):
    schema = """id string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>, names struct<primary:string>,
        taxonomy struct<primary:string,hierarchy:array<string>,alternates:array<string>>, confidence double, operating_status string,
        addresses array<struct<freeform:string,locality:string,country:string>>, websites array<string>, phones array<string>,
        brand struct<names:struct<primary:string>>"""
    row = lambda i, name, hier, conf, status=None: (i, (1.0, 3.0, 2.0, 4.0), (name,), (hier[-1], hier, None), conf, status, [("1 St", "L", "C")], ["https://www.a.b/"], None, None)
    rows = [row("a", "Bar", ["food_and_drink", "bar"], 0.4), row("b", "Mall", ["shopping", "florist"], 0.6), row("c", "Old", ["lodging"], 0.9, "permanently_closed"),
            row("d", "x", ["lodging"], 0.9), row("e", "Zoo", ["arts", "zoo"], 0.4)]
    found = k.wanted_places(spark.createDataFrame(rows, schema), ["food_and_drink", "lodging"], ["zoo"], ["florist"]).collect()
    assert [(x.id, x.more, x.lat, x.website, x.street) for x in found] == [("a", False, 3.0, "a.b", "1 St"), ("b", True, 3.0, "a.b", "1 St")]


def test_tags_and_keys(spark):
    rows = [("restaurant", None, "Sushi; vegan", None), ("restaurant", None, "thai", None), ("atm", None, None, None), (None, "bakery", None, None), ("bench", None, None, None), ("cafe", None, None, "only")]
    df = spark.createDataFrame(rows, "a string, s string, c string, v string")
    cat = k.tagged_category(F.col("a"), F.col("s"), F.col("c"), F.col("v"), F.lit(None).cast("string"), ["restaurant", "thai_restaurant", "atm", "bakery", "cafe"])
    assert [x.k for x in df.select(cat.alias("k")).collect()] == ["vegan_restaurant", "thai_restaurant", "atm", "bakery", None, "vegan_restaurant"]
    bits = spark.createDataFrame([("Yes", "only")], "a string, b string").select(k.diet_bits({"vegan": F.col("a"), "halal": F.col("b")}).alias("d")).first().d
    assert bits == 2 | 256
    cities = spark.createDataFrame([(1, "Łódź", "Lodz", "Lodsch,ロツ,x", 600_000), (2, "Small", "Small", "Tiny", 10)], "city long, name string, ascii string, alternates string, population long")
    assert sorted(map(tuple, k.city_keys(cities).collect())) == [("lodsch", 1), ("lodz", 1), ("small", 2)]


def test_records(spark):
    q = spark.createDataFrame([("1", "q")], "id string, q string")
    e = spark.createDataFrame([("1", "", "see")], "id string, expect string, check string")
    assert k.with_expectation(q, e).first().expected == "see"
    lines = spark.createDataFrame([(1, 0, "A — x | B part"), (1, 1, "two — y | C — z")], "g long, n long, t string")
    assert [x.text for x in k.joined_entries(lines, "g", "n", "t").orderBy("entry").collect()] == ["A — x", "B part | two — y", "C — z"]
    assert k.merged_lists([1, 2, 3], [2, 3, 4]) == [1, 2, 3, 4] and k.merged_lists([1], [2]) == [1, 2]
    cpu = spark.createDataFrame([("big", c, t, b, n) for c, t, b, n in ((0, 0, 0, 0), (0, 9, 50, 100), (1, 0, 10, 10), (1, 9, 10, 110))], "cluster string, core int, t int, busy long, total long")
    assert k.cpu_shares(cpu, ["cluster"]).first().share == 0.25
    row = spark.range(1).select(k.run_title(F.lit("model"), F.array(F.lit(2.0), F.lit(3.5))).alias("t"), k.is_sub(F.array(F.lit("x")), F.lit(None).cast("array<string>"), F.lit("Ramen, soup"), F.lit("n"), "ramen_restaurant").alias("s")).first()
    assert row.t == "M 3.5, 2.0 tok/s" and row.s


def test_overruled_branches(spark):
    rows = [(1, 1, "a", 0, False, False), (1, 2, "a", 2, True, False), (1, 3, "b", 0, True, False), (1, 4, "c", 0, False, True), (1, 5, "c", 2, True, False)]
    df = spark.createDataFrame(rows, "ask int, pid int, key string, tier int, options boolean, named boolean")
    assert {x.pid: x.tier for x in k.overruled(df).collect()} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 2}


def test_titles_resolve_in_order(spark):
    arts = spark.createDataFrame([(1, "Rent control", 10), (2, "Rent control in New York", 900), (3, "Paris", 5), (4, "Rent control law", 90)], "article_id long, title string, views long")
    red = spark.createDataFrame([("lutetia", 3)], "title_key string, article_id long")
    asked = spark.createDataFrame([("RENT control",), ("Lutetia",), ("control rent",), ("Nothing here",), ("par",)], "title string")
    found = {x.title: (x.article_id, x.how) for x in r.resolve_titles(asked, arts, red).collect()}
    assert found == {"RENT control": (1, "title"), "Lutetia": (3, "redirect"), "control rent": (4, "words"), "Nothing here": (None, None), "par": (None, None)}


def test_lead_skips_key_facts_and_aspects_count(spark):
    chunks = spark.createDataFrame([(7, 0, 0, 9, "", "Key facts: x"), (7, 1, 10, 50, "", "Prose lead."), (7, 2, 60, 90, "Treatment", "of fever"), (7, 3, 91, 99, "History", "old")],
                                   "article_id long, place int, start int, end int, section string, body string")
    asked = spark.createDataFrame([(1, 7)], "question long, article_id long")
    stems = spark.createDataFrame([(1, "treat", 2.0), (1, "fever", 3.0)], "question long, term string, idf double")
    found = r.article_passages(asked, chunks, stems).orderBy("rank").collect()
    assert [(x.start, x.lead) for x in found] == [(10, True), (60, False)] and found[1].score > 0.6


def test_library_hits_carry_facts_once(spark):
    arts = spark.createDataFrame([(1, "Key facts: status Final\n\nbody")], "article_id long, text string")
    hits = spark.createDataFrame([(1, 1, 1, "one"), (1, 2, 1, "two")], "question long, rank int, article_id long, text string")
    assert [x.text for x in r.with_key_facts(hits, arts).orderBy("rank").collect()] == ["Key facts: status Final\none", "two"]


def test_grid_join_equals_brute_force(spark):
    import math
    import random

    rng = random.Random(5)
    pts = [(i, 40 + rng.random() * 0.01, -8 + rng.random() * 0.01, "n") for i in range(120)]
    a, b = (spark.createDataFrame(x, "id long, lat double, lon double, name string") for x in (pts[:50], pts[50:]))
    want = {(x[0], y[0]) for x in pts[:50] for y in pts[50:]
            if math.hypot((x[1] - y[1]) * 110540, (x[2] - y[2]) * 111320 * math.cos(math.radians(x[1]))) <= 120}
    assert {(x.a, x.b) for x in p.near_pairs(a, b).collect()} == want


def test_guides_alternate_with_articles(spark):
    titles = spark.createDataFrame([(1, 0, 10, 20), (1, 1, 11, None)], "question long, place int, article_id long, guide_id long")
    row = lambda a, start, score, rank: (1, a, 0, start, score, rank)
    kind = "question long, article_id long, place int, start int, score double, rank int"
    ours = spark.createDataFrame([row(10, 0, 1.0, 0), row(10, 5, 0.4, 1), row(10, 9, 0.3, 2), row(11, 0, 1.0, 0)], kind)
    guide = spark.createDataFrame([row(20, 0, 1.0, 0), row(20, 7, 0.6, 1)], kind)
    ranked = spark.createDataFrame([(1, 10, 5, 9.0, 0.9), (1, 30, 0, 8.0, 0.2), (1, 31, 0, 7.0, 0.8)], "question long, article_id long, start int, score double, coverage double")
    got = [(x.corpus, x.article_id, x.start, x.via) for x in r.retrieve(titles, ours, ranked, guide=guide).orderBy("rank").collect()]
    assert got == [("main", 10, 0, "title"), ("guide", 20, 7, "title"), ("main", 11, 0, "title"), ("main", 10, 5, "title"), ("main", 10, 9, "title"), ("main", 31, 0, "rank")]


def test_late_hours_and_price_count(spark):
    rows = [("Mo-Su 10:00-23:00", True, "Budget", "Budget"), ("10:00-18:00", True, None, "Budget"), ("24/7", False, "Mid-range", "Budget")]
    df = spark.createDataFrame(rows, "h string, late boolean, tier string, price string")
    zero = F.lit(0.0)
    got = [x.s for x in df.select(p.question_score(F.lit(100), zero, zero, F.col("h"), F.col("late"), F.col("tier"), F.col("price")).alias("s")).collect()]
    assert got == [3.0, 1.0, 1.0]


def test_bm25_adds_a_document_s_parts_in_one_order(spark):
    terms = [f"t{k}" for k in range(9)]
    rows = [(d, t, float(1 + k * k % 7), 50 + k) for k, t in enumerate(terms) for d in range(12 + k)]
    asked = spark.createDataFrame([("q", t) for t in terms], "question string, term string")
    scores = []
    for found in (rows, rows[::-1], sorted(rows, key=lambda r: r[2])):
        posts = spark.createDataFrame(found, "id long, term string, tf double, dl long").coalesce(1)
        stats = spark.createDataFrame([(1000, 37.3)], "n long, avgdl double")
        scores.append({r.id: r.score for r in s.bm25(posts, asked, stats).collect()})
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 20


def test_hits_that_differ_in_the_last_bit_are_ties(spark):
    hits = spark.createDataFrame([("q", 1, 0.3, "a"), ("q", 2, 0.1 + 0.2, "a"), ("q", 3, 0.4, "a")], "question string, id long, score double, source string")
    assert [(r.id, r["rank"]) for r in s.top(hits, 2).orderBy("rank").collect()] == [(3, 1), (1, 2)]
    tied = spark.createDataFrame([("q", 1, 0.1 + 0.2, "a"), ("q", 2, 0.3, "a")], "question string, id long, score double, source string")
    assert [r.id for r in s.capped(tied, "source", 1).collect()] == [2]


def test_terms_begin_after_what_is_no_letter_number_or_underline(spark):
    """Java's word bound takes a fraction or a Roman numeral sign for none of these."""
    pairs = spark.createDataFrame([("q", k, x) for k, x in enumerate(["\u00bdcup", "\u2167cup", "_cup", "\u00e9cup", "a cup", "cupped", "-cup"])], "question string, id long, text string")
    stems = spark.createDataFrame([("q", "cup", 2.0)], "question string, term string, idf double")
    assert [r.coverage for r in s.coverage(pairs, stems).orderBy("id").collect()] == [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0]


def test_hits_differ_by_what_the_lists_do_not_show(spark):
    hit = lambda text: spark.createDataFrame([(1, 1, "t", "", "rank", text)], "question long, rank int, title string, section string, via string, text string")
    found = e.retrieval_difference(hit("x" * 120 + "one"), hit("x" * 120 + "two")).first()
    assert not found.same and found.one == found.two and found.one[0].text == "x" * 120
    assert e.retrieval_difference(hit("x" * 120 + "one"), hit("x" * 120 + "one")).first().same


def made_places(spark, seed, n=150, lats=(0.0, 40.0, -33.9, 57.5, 64.0, 89.99)):
    rng = random.Random(seed)
    spot = lambda: (rng.choice(lats) + rng.randrange(-9, 9) * 0.0004, -0.0003 + rng.randrange(-9, 9) * 0.0004)
    rows = [(k, *spot(), rng.choice(["casa verde", "casa verda", "verde", "bar", "bart", "", None])) for k in range(n)]
    return rows, spark.createDataFrame([*rows, (n, None, 1.0, "bar")], "id long, lat double, lon double, name string")


def test_near_pairs_are_all_pairs_of_neighbouring_squares(spark):
    (one, a), (two, b) = made_places(spark, 1), made_places(spark, 2)
    metres = lambda x, y: math.sqrt(((x[1] - y[1]) * 110540.0) ** 2 + ((x[2] - y[2]) * 111320.0 * math.cos(math.radians(x[1]))) ** 2)
    next_to = lambda x, y: all(abs(math.floor(x[i] / 0.002) - math.floor(y[i] / 0.002)) <= 1 for i in (1, 2))
    want = {(x[0], y[0]) for x in one for y in two if metres(x, y) <= 120 and next_to(x, y)}
    found = [(r.a, r.b) for r in p.near_pairs(a, b).collect()]
    assert set(found) == want and len(found) == len(want) > 300
    # Few pairs meet in small squares beyond the near ones.
    left, right = (x.where("lat between 39 and 41") for x in p._squares(a, b, 120, 0.002))
    assert left.join(right, ["fy", "fx"]).count() < 4 * sum(39 < one[x][1] < 41 for x, _ in want)


def test_near_ids_are_the_near_pairs_and_points_with_many_places_meet_once(spark):
    (_, a), (_, b) = made_places(spark, 7), made_places(spark, 8)
    odd = spark.createDataFrame([(None, 40.0, 0.0001, "bar"), (3, 40.0, 0.0001, "bar"), (3, 40.0, 0.0001, "bar")], "id long, lat double, lon double, name string")
    a, b = a.unionByName(odd), b.unionByName(odd)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(p.near_ids(a, b, 6)) == rows(p.near_pairs(a, b).select("a", "b", F.round("d", 6).alias("d")))
    town = spark.range(5_000).selectExpr("id", "40.0D + id % 2 / 1000 lat", "-8.0D lon", "'casa' name")
    found = p.near_ids(town, town, 6)
    assert found.groupBy("d").count().orderBy("d").collect() == [(0.0, 2 * 2_500 ** 2), (110.54, 2 * 2_500 ** 2)]
    # 25 million rows of a handful of pairs of blocks: none of 5,000 places meets each other's row by row.
    assert p._folded(town).count() < 10 and p._folded(town).agg(F.sum(F.size("ids"))).first()[0] == 5_000


def test_matches_are_those_of_all_pairs_and_copies_do_not_meet(spark):
    (_, a), (_, b) = made_places(spark, 3), made_places(spark, 4)
    want = p.mutual_best(p.alike(p.near_pairs(a, b)))
    rows = lambda df: sorted((r.a, r.b, round(r.sim, 9)) for r in df.select("a", "b", "sim").collect())
    assert rows(p.mutual_matches(a, b)) == rows(want) and want.count() > 20
    copies = spark.range(200_000).selectExpr("id", "40.0D lat", "-8.0D lon", "'casa verde' name")
    assert rows(p.mutual_matches(copies, copies)) == [(0, 0, 1.0)]


def test_titles_of_one_name_meet_in_many_tasks_and_lose_none(spark):
    titles = [(k, f"bar ({'hotel' if k % 3 else 'film'})") for k in range(9_000)] + [(None, "bar (hotel)"), (1, None), (2, "bar"), (3, "inn (old) (hotel)"), (3, "inn (old) (hotel)")]
    names = [(k, "bar") for k in range(1_000, 1_300)] + [(None, "bar"), (5, None), (6, "inn (old)"), (7, "inn")]
    made = lambda rows, kind: spark.createDataFrame(rows, kind).coalesce(1)
    found = p.qualified_titles(made(names, "pid long, n string"), made(titles, "aid long, t string"), ["restaurant", "hotel"])
    counts = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in counts) == 301 * 6_001 + 2
    assert len(counts) >= 3 and max(r["count"] for r in counts) < 301 * 6_001 * 0.75
    assert found.where("aid is null").count() == 301 and found.where("pid is null").count() == 6_001
    assert found.where("pid = 6").collect() == [(6, 3, "hotel")] * 2
    assert found.distinct().count() == 301 * 6_001 + 1


def test_merge_makes_pairs_once(spark):
    (_, a), (_, b) = made_places(spark, 5), made_places(spark, 6)
    more = lambda df: df.selectExpr("id", "lat", "lon", "name", "'c' cat", "id % 90 conf", "id % 7 diet")
    pairs = p.mutual_matches(a, b).select("a", "b")
    merged = p.merge_sources(more(b), more(a), pairs)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    # The filter on the measure and its column.
    assert plan.count("ArrowEvalPython") == 2
    of = {r.b: r.a for r in pairs.collect()}
    want = [(k, k % 90, of.get(k, 0) % 7, 3 if k in of else 1) for k in range(151)] + [(k, 60, k % 7, 2) for k in range(151) if k not in of.values()]
    found = merged.select("id", "conf", "diet", "sources").collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(of) > 20
