import math
import sqlite3

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import geo, names, questions, stemming
from tessella.functions.html import main_text
from tessella.operators import context, corpus

WORDS = """caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing
fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli
vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti
sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner
gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti
homologous effective bowdlerize probate rate cease controll roll housing generously archaeology a is by été naïve x2 2024""".split()


@pytest.fixture(scope="module")
def index():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    return con


def sqlite_tokens(index, text):
    index.execute("DELETE FROM t")
    index.execute("INSERT INTO t VALUES (?)", (text,))
    return [r[0] for r in index.execute("SELECT term FROM v ORDER BY offset")]


def test_tokens_equal_sqlite(index):
    text = ", ".join(WORDS)
    assert stemming.index_tokens(text) == sqlite_tokens(index, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeginlorstuyz", min_size=1, max_size=14))
def test_stems_equal_sqlite(index, word):
    assert [stemming.porter(word)] == sqlite_tokens(index, word)


def test_rare_stems():
    """Words on which the index and the rules as published differ."""
    assert [stemming.porter(w) for w in ("ies", "yyed", "ties", "sses", "caresses")] == ["ie", "y", "ti", "sse", "caress"]


def test_question_stems(spark, index):
    text = "What are the best Hostels to visit in Bogotá, a relational plan?"
    row = spark.createDataFrame([(text,), (None,)], "q string").select(stemming.question_stems("q", questions.STOP).alias("s")).collect()
    content = "best hostels visit bogotá relational plan"
    assert row[0].s == sorted(set(sqlite_tokens(index, content))) and row[1].s == []
    again = spark.createDataFrame([(x,) for x in row[0].s], "t string").select(stemming.stemmed_again("t").alias("t")).collect()
    assert [r.t for r in again] == [sqlite_tokens(index, x)[0] for x in row[0].s]


def test_names_and_similarity():
    assert names.key_of("Łódź, Ærø & Straße!") == "lodz aero strasse"
    assert names.key_of(None) == "" and names.key_of("東京") == ""
    assert names.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler_of("", "a") == 0 and names.jaro_winkler_of("a", "a") == 1


def test_cells_cover_a_circle_and_wrap(spark):
    rows = [(0.0, 179.99, 5.0), (89.99, 10.0, 5.0), (41.38, 2.17, 12.0)]
    asks = spark.createDataFrame(rows, "lat double, lon double, r double")
    found = asks.select("lat", "lon", geo.cells_around(F.col("lat"), F.col("lon"), F.col("r")).alias("c")).collect()
    cell = lambda lat, lon: math.floor((lat + 90) * 20) * 7200 + math.floor((lon + 180) * 20) % 7200
    assert cell(0.0, -179.99) in found[0].c
    assert all(0 <= c < 3600 * 7200 for r in found for c in r.c)
    for k in range(36):
        a = math.radians(k * 10)
        lat, lon = 41.38 + 0.1 * math.sin(a), 2.17 + 0.1 * math.cos(a) / math.cos(math.radians(41.38))
        assert cell(lat, lon) in found[2].c


def test_radius_and_fame(spark):
    row = spark.range(1).select(
        geo.city_radius_km(F.lit(500)).alias("a"), geo.city_radius_km(F.lit(100_000)).alias("b"), geo.city_radius_km(F.lit(10**8)).alias("c"),
        geo.fame_bonus(F.lit(0)).alias("d"), geo.fame_bonus(F.lit(900)).alias("e"), geo.fame_bonus(F.lit(10**9)).alias("f"),
    ).first()
    assert (row.a, row.b, row.c) == (3.0, 10.0, 22.0) and (row.d, row.e, row.f) == (0.0, 1.0, 3.0)


@pytest.mark.parametrize(("question", "follows"), [
    ("what about in winter?", True), ("why?", True), ("how old was he?", True), ("Is it safe to drink the water in Mexico City?", False),
    ("How old was Obama when he became president?", False), ("when did he win the Nobel prize?", True), ("", False), (None, False),
    ("how much is a taxi?", True), ("tell me " + "more " * 20, False),
])
def test_follow_ups(spark, question, follows):
    row = spark.createDataFrame([(question,)], "q string").select(questions.follows_up(F.col("q")).alias("f")).first()
    assert row.f is follows


def test_question_expressions(spark):
    rows = [(0, "how many times larger is it"), (1, "who wrote Hamlet"), (2, "it takes 3 days, when do we arrive"), (3, "東京のラーメンはどこ"),
            (4, "dónde están los mejores bares y cafés en la ciudad"), (5, "what is the best of the bars in town"), (6, "if the train is late how far"), (7, None)]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, q string").select("i", questions.needs_working(F.col("q")).alias("w"), questions.needs_translation(F.col("q")).alias("t")).collect()}
    assert [got[i].w for i in range(7)] == [True, False, True, False, False, False, True]
    assert [got[i].t for i in range(7)] == [False, False, False, True, True, False, False]


def test_plans_and_checks():
    plan = "1. Rome\n- \"Paris\"\n1984 (novel)\nOutput only the titles, nothing else.\nThis is a whole sentence here.\nX\nA B\nC D\nE F"
    assert questions.planned_titles(plan, "output only the titles, nothing else.") == ["Rome", "Paris", "1984 (novel)", "A B"]
    assert questions.without_deliberation("Fine.\nBut wait, no.\nMore") == "Fine." and questions.without_deliberation(None) == ""
    assert questions.usable_line("\n “Where is it?” \n") == "Where is it?" and questions.usable_line("ab") is None


def test_place_questions():
    ask = questions.place_ask("best cheap vegan restaurants in Lima open late")
    assert ask == {"kind": "eat", "diet": "vegan", "price": "Budget", "here": False, "late": True}
    assert questions.place_ask("a pharmacy near my hotel near me")["kind"] == "pharmacy"
    assert questions.place_ask("how much is a coffee in Rome") is None and questions.place_ask("best museums in Paris") is None
    kinds = {"wine shop in Rome": "liquor", "best pet food in Rome": "pets", "find a second-hand shop in Rome": "clothes", "where to fix my bike in Rome": "outdoor",
             "best karting in Rome": "karting", "find a subway station in Rome": "transport", "best games stores in Rome": "games"}
    assert {q: (questions.place_ask("find a " + q) or {}).get("kind") for q in kinds} == kinds
    assert questions.place_ask("who wrote Hamlet") is None and questions.place_ask(None) is None
    assert questions.place_spans("ramen in Kyoto for two, or near the Gion Corner")[0] == ("Gion Corner", True)


def test_html_main_text():
    page = "<html><head><title>Fish | Site</title><style>x</style></head><body><nav>menu</nav><main><h2>A</h2><p>b <b>c</b></p><ul><li>d</li></ul></main><p>out</p></body>"
    assert main_text(page) == ("Fish", "## A\n\nb c\n\n- d")
    assert main_text("<p>one</p>two<script>no</script>") == ("", "one\n\ntwo") and main_text(None) == ("", "")


def test_chunks_never_cross_headings_or_overlap(spark):
    text = "# T\n\nLead one.\n\nLead two.\n\n## A\n\n" + "x" * 400 + "\n\n" + "y" * 700 + "\n\n### B\nbody of b\n\n" + ("Long sentence here. " * 120) + "\n\n## \n\n| a |\n| b |"
    spans = corpus.chunk_spans(text)
    assert [k for i, (_, _, k) in enumerate(spans) if not i or spans[i - 1][2] != k] == ["", "A", "A > B", ""]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert text[spans[0][0] : spans[0][1]] == "Lead one.\n\nLead two." and "body of b" in "".join(text[a:b] for a, b, _ in spans)
    assert corpus.section_at("# T\n\n#### deep\nx", 20) == "deep" and corpus.chunk_spans(None) == []
    rows = corpus.chunks(spark.createDataFrame([(1, text)], "article_id long, text string"))
    assert rows.where("is_table").count() == 1 and corpus.overlaps(rows).count() == 0
    assert all(r.body == text[r.start : r.end] for r in rows.collect())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n#|", max_size=600))
def test_spans_cover_all_words(text):
    spans = corpus.chunk_spans(text, 40, 60)
    held = "".join(text[a:b] for a, b, _ in spans)
    assert held.count("b") + sum(s.count("b") for s in text.split("\n") if s.startswith("#")) >= text.count("b")


def test_context_packing(spark):
    rows = [(1, 1, "A", "", "x. " * 500, True), (1, 2, "B", "S", "y" * 300, False), (1, 3, "C", None, "z", False)]
    hits = spark.createDataFrame(rows, "question long, rank int, title string, section string, text string, lead boolean")
    one = context.packed(hits, 1100).first()
    assert one.used == [0, 2] and one.context.startswith("[1] A\nx. x.") and one.context.endswith("\n\n[2] C\nz")
    assert "[2] B — S\n" + "y" * 300 in context.packed(hits).first().context
    row = spark.range(1).select(context.check_terms(F.lit("1,024 Paris cafes the big Ox paris")).alias("t"), context.check_terms(F.lit("Paris has 2,100 cafes")).alias("u")).first()
    assert dict(map(tuple, row.t)) == {"1024": 3, "paris": 2, "cafes": 1, "ox": 2}
    assert dict(map(tuple, row.u)) == {"2100": 3, "paris": 2, "cafes": 1}
    text = "Opening line here. Nothing at all. Paris counts 2,100 of them. End of it now."
    cut = spark.createDataFrame([(text, "Paris has 2,100 cafes"), ("", "x"), (text, "")], "text string, q string").withColumn("terms", context.check_terms(F.col("q")))
    got = [r.e for r in context.with_excerpt(cut, "text", "terms", F.lit(200), "e").collect()]
    assert got == ["Opening line here. … Paris counts 2,100 of them.", "", "Opening line here."]
    checked = context.check_packed(hits.withColumn("draft", F.lit("Zebra z")).withColumn("question_text", F.lit("Zzz yyyy")).withColumn("text", F.when(F.col("rank") == 3, "Zebra").otherwise(F.col("text"))), excerpts=True).first()
    assert checked.used[0] == 2 and sorted(checked.used) == [0, 1, 2]
    a = [{"aid": 1, "start": s} for s in (0, 5, 9)]
    b = [{"aid": 2, "start": s} for s in (0, 5)]
    assert [(h["aid"], h["start"]) for h in context.round_robin([a, b], [{"aid": 1, "start": 0}, {"aid": 3, "start": 1}])] == [(1, 0), (1, 5), (2, 0), (2, 5), (1, 9), (3, 1)]


def test_diversity():
    from tessella.operators.places import diversify

    frame = pd.DataFrame([("Bar A", False, 1.0, 1.0), ("bar a", False, 1.1, 1.1), ("Bar A", False, 2.0, 2.0), ("Chain", True, 3.0, 3.0), ("Chain", True, 4.0, 4.0), ("Bar A Annex", False, 1.0, 1.0)],
                         columns=["name", "chain", "lat", "lon"])
    assert list(diversify(frame)) == [0, 1, 3]


def test_main_part_with_nested_elements_of_its_own_kind():
    from tessella.functions.html import main_text

    assert main_text("<div role=main><div>a</div><p>b</p></div><p>c</p>")[1] == "a\n\nb"
    assert main_text("<p>x</p><main><main><p>a</p></main><div>b</div></main><p>c</p>")[1] == "a\n\nb"
    assert main_text("<div role=main><div><div>a</div></div>b<div>c</div></div><div>d</div>")[1] == "a\n\nb\n\nc"


def test_letters_bound_the_measure(spark):
    """No pair is alike beyond what masks, lengths and first letters allow."""
    import itertools

    from tessella.functions import names as n

    words = ["", "a", "martha", "marhta", "dixon", "dicksonx", "cafe roma", "caffè roma", "ROMA cafe", "zürich haus", "zurich haus", "aaaa", "aaab", "🙂 bar", "bar"]
    pairs = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    for r in pairs.select("a", "b", n.most_alike(F.col("a"), F.col("b")).alias("most"), n.similarity(F.col("a"), F.col("b"), 0.8).alias("sim")).collect():
        if r.a and r.b:
            assert n.jaro_winkler_of(r.a, r.b) <= r.most + 1e-12
            measured = n.jaro_winkler_of(r.a, r.b)
            held = len(r.a) >= 4 and len(r.b) >= 4 and (r.a in r.b or r.b in r.a)
            assert r.sim == 1.0 if r.a == r.b else r.sim == 0.95 if held else (abs(r.sim - measured) < 1e-12 if measured >= 0.8 else r.sim in (0.0, measured))


def test_more_than_eight_systems_have_letters_of_their_own(spark):
    from tessella.operators import evaluation

    rows = [(i, f"s{k}", "x") for i in range(3) for k in range(20)]
    found = evaluation.blind(spark.createDataFrame(rows, "id long, system string, answer string"), 5).collect()
    for i in range(3):
        assert {r.letter for r in found if r.id == i} == set("ABCDEFGH") | {a + b for a in "AB" for b in "ABCDEFGH"} - {"BE", "BF", "BG", "BH"}


def test_capitalised_runs_keep_small_words():
    found = questions.place_spans("what about Rio de Janeiro, or Santiago de Compostela?")
    assert [text for text, _ in found] == ["Rio de Janeiro", "Santiago de Compostela"]
