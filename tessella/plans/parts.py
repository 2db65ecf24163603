"""Queries of single rules: names, tags, kinds of place, runs, grades, streams of sessions and texts; all with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import geo, names
from tessella.functions import markup as m
from tessella.functions.questions import DIETS, KIND_WORDS, place_asks, place_texts
from tessella.operators import cleaning as k
from tessella.operators import corpus as c
from tessella.operators import evaluation as e
from tessella.plans.streams import plan_deltas
from tessella.plans.passages import _BEST, _POOL, _POSTS
from tessella.plans.tables import articles, places, read
from tessella.sources.scratch import new_path
from tessella.streaming import live


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of whole documents and of parts' names, and parts' names without generic words."""
    docs = read(spark, sf_dir, "documents").where("text is not null").select(F.lit("doc").alias("table"), F.col("doc_id").alias("id"), F.md5(names.norm_key("text")).alias("key"), F.lit("").alias("core"))
    core = names.core_name(F.col("p_name"), ("red", "small", "ring"))
    return docs.unionByName(read(spark, sf_dir, "part").select(F.lit("part").alias("table"), F.col("p_partkey").alias("id"), names.norm_key("p_name").alias("key"), core.alias("core")))


def run_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each order: its status as the model, its lines' quantities as rates."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("rates"))
    met = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.select("o_orderkey", k.run_title(F.lower("o_orderpriority"), F.col("rates")).alias("title"))


def core_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of four cores, busy and total growing by time, by kind of event."""
    x = F.col("event_id")
    samples = read(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("core"), x.alias("t"), (x * 3 + F.col("user_id") % 7).alias("busy"), (x * 8).alias("total"))
    return k.cpu_shares(samples, ["event_type"]).select("event_type", F.round("share", 6).alias("share"))


def overruled_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a name as branches: those called vegan whose namesakes only have options."""
    x = F.col("pid")
    base = places(spark, sf_dir).select((x % 5).alias("ask"), "pid", F.lower("name").alias("key"), F.when(x % 3 == 0, 0).otherwise(2).cast("int").alias("tier"), (x % 11 == 0).alias("options"), (x % 6 == 0).alias("named"))
    return k.overruled(base).select("ask", "pid", "tier")


def narrower_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether parts are of a group, and rings, by category, alternates, cuisine or name."""
    x = F.col("p_partkey")
    path = F.array(F.lower("p_type"), F.when(x % 7 == 0, "ring").otherwise("thing"))
    found = k.is_sub(path, F.when(x % 3 == 0, F.array(F.lit("ring"), F.lit("x"))), F.when(x % 5 == 0, F.lit("big RING food")), F.col("p_name"), "ring")
    return read(spark, sf_dir, "part").select("p_partkey", k.in_group(path, ["economy", "promo"]).alias("in_group"), found.alias("is_sub"))


def tagged_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and diets of parts as tagged objects."""
    x = F.col("p_partkey")

    def pick(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (x % len(values) + 1).cast("int"))

    amenity, shop = pick("restaurant", "cafe", "pub", "atm", "cinema", None, "fast_food"), pick("bakery", None, "deli")
    cuisine, vegan, vegetarian = pick("Thai; noodles", "pizza,Sushi", None, "vegan", "burger"), pick(None, "only", "yes", "No", "limited"), pick("only", None, "YES")
    known = ["thai_restaurant", "sushi_restaurant", "vegan_restaurant", "restaurant", "cafe", "pub", "bakery", "fast_food_restaurant"]
    return read(spark, sf_dir, "part").select(
        "p_partkey", k.diet_bits({"vegan": vegan, "vegetarian": vegetarian, "halal": pick("yes", None)}).cast("long").alias("diet"),
        k.tagged_category(amenity, shop, cuisine, vegan, vegetarian, known).alias("category"),
    )


def expected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as questions; what customers of the same number expect, else what is to be checked."""
    questions = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("check"))
    expectations = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("expect"))
    return k.with_expectation(questions, expectations).select("id", "expected")


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of lists in the lines of orders: every second piece has no dash and goes on in the next."""
    n = F.col("part")
    text = F.concat(F.lit("p"), n.cast("string"), F.when(n % 2 == 0, " — q").otherwise(""), F.lit(" | r"), n.cast("string"), F.when(n % 3 == 0, " — s").otherwise(""))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.min("l_partkey").alias("part"))
    lines = rows.select("l_orderkey", "line", text.alias("text"))
    return k.joined_entries(lines, "l_orderkey", "line", "text").select("l_orderkey", F.col("entry").cast("long").alias("entry"), "text")


def city_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius and fame of customers as cities of so many people and views, none among them."""
    people = F.pow(F.lit(10.0), F.col("c_custkey") % 9).cast("long")
    views = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 7 - 5)
    return read(spark, sf_dir, "customer").select("c_custkey", F.round(geo.city_radius_km(people), 6).alias("radius"), F.round(geo.fame_bonus(views), 6).alias("fame"))


def unblinded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders graded by letter, and whose letters they were; every tenth key is missing."""
    x = F.col("o_orderkey")
    orders = read(spark, sf_dir, "orders")
    grades = orders.select(x.alias("id"), F.create_map(F.lit("A"), x % 11, F.lit("B"), x % 7, F.lit("C"), x % 5).alias("scores"))
    letters = F.array(*[F.struct(F.lit(a).alias("letter"), F.concat(F.lit("s"), ((x + i) % 3).cast("string")).alias("system")) for i, a in enumerate("ABC")])
    key = orders.where("o_orderkey % 10 <> 0").select(x.alias("id"), F.explode(letters).alias("l")).select("id", "l.*")
    return e.unblinded(grades, key)


def kinds_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts that ask for places of every kind and diet, one or two kinds a question."""
    words = [w for kinds in KIND_WORDS.values() for w in kinds]
    diets = ["", *(w for ws in DIETS.values() for w in ws)]
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    x = F.col("item_id")
    asked = F.concat(F.lit("find a "), at(diets, x), F.lit(" "), at(words, x * 7), F.when(x % 3 == 0, F.concat(F.lit(" or "), at(words, x * 5 + 1))).otherwise(""), F.lit(" in Rome, "), F.lower("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", place_asks(asked).alias("ask")).select("item_id", F.col("ask.kind").alias("kind"), F.col("ask.diet").alias("diet"))


def fork_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sections of a history, suppliers as documents, every fifth a plan of an upgrade that links parts."""
    n = F.col("n_nationkey")
    nation = read(spark, sf_dir, "nation")
    head = F.concat(F.lit("Upgrade"), F.translate(n.cast("string"), "0123456789", "abcdefghij"), F.when(n % 2 == 0, F.concat(F.lit(' ("N'), n.cast("string"), F.lit('") {#x}'))).otherwise(""))
    link = F.concat(F.lit("eips.ethereum.org/EIPS/eip-"), (n * 3).cast("string"), F.lit(" and eips.ethereum.org/EIPS/eip-"), (n * 5 + 1).cast("string"))
    history = nation.select(n.alias("place"), F.concat(head, F.lit("\ntext "), link).alias("section"))
    dates = nation.where("n_nationkey % 3 <> 0").select(F.lower(F.regexp_extract(head, "^(Upgrade[a-z]+)", 1)).alias("name"), F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int")).alias("day"))
    k_ = F.col("s_suppkey")
    word = lambda x: F.concat(F.lit("Upgrade"), F.translate((x % 25).cast("string"), "0123456789", "abcdefghij"))
    to = lambda x: F.concat(F.lit("- [x](./eip-"), x.cast("string"), F.lit(".md)\n"))
    body = F.concat(to(k_ * 7), F.lit("### EIPs Considered for Inclusion\n"), to(k_ * 7 + 1), F.lit("### Declined\n"), to(k_ * 7 + 2), F.lit("### Other\n"), to(k_ * 7 + 1), to(k_ * 7 + 3), F.lit("## Rationale\n"), to(k_ * 7 + 4))
    documents = read(spark, sf_dir, "supplier").select(
        k_.alias("number"), F.when(k_ % 5 == 0, F.concat(F.lit("Hardfork Meta: "), word(k_ + 1))).otherwise(F.col("s_name")).alias("title"),
        F.concat(F.lit("about "), word(k_ + 2)).alias("description"), F.when(k_ % 2 == 0, "Final").otherwise("Draft").alias("status"),
        (k_ * 7 + 5).cast("string").alias("requires"), body.alias("body"),
    )
    return k.fork_stages(history, documents, dates)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written to scratch and read back: what they come from is computed once."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def retrieval_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose five best passages change when popularity counts."""
    from tessella.plans import passages as pp

    index, docs = pp._index(spark, sf_dir, "lines"), articles(spark, sf_dir)
    terms = pp._terms(index, pp._items(spark, sf_dir))
    # The best five of all are those of the pool, which is kept, as are the passages shown.
    pool = _stored(pp.p.top_passages(index, terms, _POOL), "pool")
    one, two = pool.where(F.col("rank") <= _BEST), pp.p.with_popularity(pool, docs, per_article=_BEST).where(F.col("rank") <= _BEST)
    named = ["question", "rank", "article_id", "start"]
    hits = _stored(one.select(F.lit(1).alias("build"), *named).unionByName(two.select(F.lit(2).alias("build"), *named)), "shown")
    # Texts aren't shuffled to meet the few that are shown: the hits come to them.
    met = F.broadcast(hits) if hits.count() <= pp.p.BROADCAST_ROWS else hits
    text = pp.line_passages(spark, sf_dir).select("article_id", "start", "title", "section", F.col("body").alias("text"))
    shown = _stored(text.join(met, ["article_id", "start"]).withColumn("via", F.lit("rank")), "texts")
    found = e.retrieval_difference(shown.where("build = 1"), shown.where("build = 2"))
    return found.select(F.col("question").alias("item_id"), "same", F.array_join(F.transform("two", lambda h: F.md5(h["text"])), ",").alias("two"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' coordinates from article texts, and those of points and closed rings in WKT."""
    x = F.col("s_suppkey")
    part = lambda c: F.format_string("%.2f", c)
    lat, lon = part(x % 80 + 0.25), part(x % 170 + 0.5)
    text = F.concat(F.lit("35°40′N 139°45′E near "), lat, F.lit("°"), F.when(x % 2 == 0, "N").otherwise("S"), F.lit(" "), lon, F.lit("°"), F.when(x % 3 == 0, "E").otherwise("W"), F.lit(" and 1.5°N 2.5°E"))
    point = F.concat(F.lit("POINT ("), lon, F.lit(" -"), lat, F.lit(")"))
    corner = lambda a, b: F.concat((x % 50 + a).cast("string"), F.lit(" "), (x % 30 + b).cast("string"))
    ring = F.concat(F.lit("POLYGON (("), corner(0, 0), F.lit(", "), corner(4, 0), F.lit(", "), corner(4, 2), F.lit(", "), corner(0, 0), F.lit("), (9 9, 8 8))"))
    found = read(spark, sf_dir, "supplier").select("s_suppkey", m.article_coords(text).alias("a"), m.wkt_point(F.when(x % 2 == 0, point).otherwise(ring)).alias("w"))
    return found.select("s_suppkey", *[F.round(f"{c}.{n}", 6).alias(f"{c}_{n}") for c in "aw" for n in ("lat", "lon")])


def document_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents that weigh by their status."""
    docs = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return k.weighted_documents(docs, {"f": 1000, "o": 500}, 7).select("o_orderkey", F.col("views").cast("long").alias("views"))


#: Descriptions of subjects, and the kinds that they are.
_SUBJECTS = [
    ("a sushi restaurant in Ginza", "food"), ("a grand hotel and casino bar near the sea", "food,lodging"), ("an art museum that holds coins", "other"), ("a village in the north", ""),
    ("a 2014 comedy film about a hotel", ""), ("one of the oldest coffeehouses in Paris", "food"), ("a hotel chain", ""), ("a department store with a bakery", "food,other"), ("a guest house by a lake", "lodging"),
]


def subject_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles whose first sentence says what they are."""
    x = F.col("p_partkey")
    said = F.element_at(F.array(*[F.lit(a) for a, _ in _SUBJECTS]), (x % len(_SUBJECTS) + 1).cast("int"))
    text = F.concat(F.lit("Key facts: a: b\n\n# "), F.initcap("p_name"), F.lit("\n\nThe "), F.initcap("p_name"), F.lit(" (old; new) is "), said, F.lit(". It is a museum. "), "p_type")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(m.lead_kinds(text), ",").alias("kinds"))


def span_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of parts as passages: those that begin before their predecessor ends."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_linenumber").alias("n"))
    spans = lines.select(F.col("l_partkey").alias("article_id"), F.col("l_orderkey").alias("place"), (F.col("l_orderkey") * 2).alias("start"), (F.col("l_orderkey") * 2 + F.col("n") * 900).alias("end"))
    return c.overlaps(spans).select("article_id", "place", "before")


def place_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where questions about parts may name a place."""
    name, other = F.initcap("p_name"), F.translate("p_brand", "#", "x")
    asked = F.concat(F.lit("what is good in "), name, F.lit(", or near the "), other, F.lit("?"))
    found = read(spark, sf_dir, "part").select("p_partkey", F.posexplode(place_texts(asked)).alias("at", "s"))
    return found.select("p_partkey", F.col("at").cast("long").alias("at"), "s.text", "s.anchored")


def guide_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wiki pages of a guide with listings, references and tables; the listings found in them."""
    x, name = F.col("p_partkey"), F.initcap("p_name")
    section = F.element_at(F.array(*[F.lit(v) for v in ("Eat", "Sleep", "Understand")]), (x % 3 + 1).cast("int"))
    page = F.concat(
        F.lit("Intro<ref>x {{y}}</ref>\n=="), section, F.lit("==\n===Budget===\n* {{listing | name="), name, F.lit(" | address="), x.cast("string"),
        F.lit(" [[High Street|Street]] | content=''Fine'' {{tag}}food}}\n{| class=x\n* {{eat|name=None}}\n|}\n* plain\n* {{see|name=Second "), name, F.lit("}}\n==Buy==\n* {{buy | name=X}}\n* {{buy|name="), "p_brand", F.lit("|price=9}}"),
    )
    found = read(spark, sf_dir, "part").select("p_partkey", m.wiki_column(page).alias("text"))
    return found.select("p_partkey", F.explode(m.listings_column("text")).alias("l")).select("p_partkey", "l.*")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' runs of events no more than half an hour apart, from a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = live.source(spark, f"{sf_dir}/[e]vents.parquet", schema).withColumn("ts", F.col("ts").cast(T.TimestampType()))
    found = live.complete_table(live.sessions(events, "ts", "user_id", "30 minutes", "1 hour"), "sessions")
    return found.select("user_id", F.unix_micros("t0").alias("t0"), F.unix_micros("t1").alias("t1"), "events")


def stream_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that stream in pieces, as they are after their last piece."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    deltas = plan_deltas(live.source(spark, f"{sf_dir}/[d]ocuments.parquet", schema)).withColumn("reset", F.lit(False))
    where = new_path(spark, "texts")
    live.run_once(live.accumulated(deltas.select("run", "step", "delta", "reset", "ts"), "ts", "1 hour"), f"{where}/out", f"{where}/checkpoint")
    steps = spark.read.schema("run long, step long, text string").parquet(f"{where}/out")
    return steps.groupBy("run").agg(F.max("step").alias("last"), F.md5(F.max_by("text", "step")).alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        name_keys, run_titles, core_shares, overruled_branches, narrower_kinds, tagged_kinds, expected_answers, list_entries, city_numbers, unblinded_scores,
        kinds_asked, fork_stages, retrieval_changes, coordinates, document_weights, subject_kinds, span_overlaps, place_spans, guide_listings, stream_sessions, stream_texts,
    )
}


def _values(pairs: dict[str, tuple[str, ...]]) -> str:
    """(word, value, place) of word lists as SQL rows."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(w, value, place) for place, (value, words) in enumerate(pairs.items()) for w in words]
    return "(VALUES " + ", ".join(f"({quoted(w)}, {quoted(v)}, {n})" for w, v, n in rows) + ") AS v(word, value, place)"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WORDS = _listed([w for kinds in KIND_WORDS.values() for w in kinds])
_DIETS = _listed(["", *(w for ws in DIETS.values() for w in ws)])
#: The first word of a list in `low`, the longer at one place; a plural s counts.
_FIRST = """SELECT item_id, value FROM (SELECT item_id, value, word, place, length(regexp_extract(low, '^(.*?(?:^|[^a-z0-9]))' || regexp_escape(word) || 's?(?:$|[^a-z0-9])', 1)) AS pos,
        regexp_matches(low, '(?:^|[^a-z0-9])' || regexp_escape(word) || 's?(?:$|[^a-z0-9])') AS there FROM q, {values}) WHERE there
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos, -length(word), place) = 1"""

ORACLES = {
    "name_keys": """WITH t AS (SELECT 'doc' AS "table", doc_id AS id, text AS s, '' AS core FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'part', p_partkey, p_name,
            array_to_string(list_filter(string_split(lower(p_name), ' '), lambda w: w NOT IN ('red', 'small', 'ring')), ' ') FROM part),
        n AS (SELECT "table", id, core, trim(regexp_replace(strip_accents(replace(replace(lower(s), 'ß', 'ss'), 'œ', 'oe')), '[^a-z0-9]+', ' ', 'g')) AS key FROM t)
        SELECT "table", id, CASE WHEN "table" = 'doc' THEN md5(key) ELSE key END AS key, core FROM n""",
    "run_titles": """WITH l AS (SELECT l_orderkey, string_agg(printf('%.1f', l_quantity::DOUBLE), ', ' ORDER BY l_quantity DESC) AS rates FROM lineitem GROUP BY 1)
        SELECT o_orderkey, upper(left(o_orderpriority, 1)) || ' ' || rates || ' tok/s' AS title FROM orders JOIN l ON l_orderkey = o_orderkey""",
    "core_shares": """WITH p AS (SELECT event_type, user_id % 4 AS core, arg_max(event_id * 3 + user_id % 7, event_id) - arg_min(event_id * 3 + user_id % 7, event_id) AS b, max(event_id * 8) - min(event_id * 8) AS n
            FROM events GROUP BY 1, 2)
        SELECT event_type, round(CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0 END, 6) AS share FROM p GROUP BY 1""",
    "overruled_branches": """WITH b AS (SELECT p_partkey % 5 AS ask, p_partkey AS pid, lower(p_name) AS key, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 2 END AS tier, p_partkey % 11 = 0 AS options, p_partkey % 6 = 0 AS named FROM part)
        SELECT ask, pid, CASE WHEN tier = 0 AND NOT named AND count(*) OVER w >= 2 AND count(*) FILTER (options) OVER w > 0 THEN 2 ELSE tier END::INTEGER AS tier FROM b WINDOW w AS (PARTITION BY ask, key)""",
    "narrower_kinds": """SELECT p_partkey, lower(p_type) IN ('economy', 'promo') AS in_group,
        lower(p_type) = 'ring' OR p_partkey % 7 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR contains(lower(p_name), 'ring') AS is_sub FROM part""",
    "tagged_kinds": """WITH t AS (SELECT p_partkey, ['restaurant', 'cafe', 'pub', 'atm', 'cinema', NULL, 'fast_food'][p_partkey % 7 + 1] AS amenity, ['bakery', NULL, 'deli'][p_partkey % 3 + 1] AS shop,
            ['thai; noodles', 'pizza;sushi', '', 'vegan', 'burger'][p_partkey % 5 + 1] AS cuisine, [NULL, 'only', 'yes', 'no', 'limited'][p_partkey % 5 + 1] AS vegan, ['only', NULL, 'yes'][p_partkey % 3 + 1] AS vegetarian,
            ['yes', NULL][p_partkey % 2 + 1] AS halal FROM part),
        u AS (SELECT *, list_transform(string_split(cuisine, ';'), lambda c: trim(c)) AS cs, coalesce(amenity IN ('restaurant', 'fast_food', 'cafe'), false) AS eats,
            coalesce(CASE amenity WHEN 'restaurant' THEN 'restaurant' WHEN 'cafe' THEN 'cafe' WHEN 'pub' THEN 'pub' WHEN 'atm' THEN 'atm' WHEN 'fast_food' THEN 'fast_food_restaurant' END,
                CASE shop WHEN 'bakery' THEN 'bakery' WHEN 'deli' THEN 'delicatessen' END) AS base FROM t),
        v AS (SELECT *, list_filter(list_transform(cs, lambda c: c || '_restaurant'), lambda c: c IN ('thai_restaurant', 'sushi_restaurant', 'vegan_restaurant'))[1] AS named FROM u)
        SELECT p_partkey, (coalesce(CASE vegan WHEN 'only' THEN 1 WHEN 'yes' THEN 2 WHEN 'limited' THEN 4 WHEN 'no' THEN 8 END, 0) | coalesce(CASE vegetarian WHEN 'only' THEN 16 WHEN 'yes' THEN 32 END, 0)
                | coalesce(CASE halal WHEN 'yes' THEN 256 END, 0))::BIGINT AS diet,
            CASE WHEN base IS NULL THEN NULL WHEN eats AND (list_contains(cs, 'vegan') OR coalesce(vegan = 'only', false)) THEN 'vegan_restaurant'
                WHEN eats AND (list_contains(cs, 'vegetarian') OR coalesce(vegetarian = 'only', false)) THEN 'vegetarian_restaurant'
                WHEN amenity = 'restaurant' AND named IS NOT NULL THEN named
                WHEN base IN ('restaurant', 'cafe', 'pub', 'bakery', 'fast_food_restaurant') THEN base WHEN amenity IN ('pharmacy', 'atm', 'bureau_de_change') THEN NULL
                WHEN amenity IS NOT NULL THEN 'restaurant' ELSE 'food_and_drink' END AS category FROM v""",
    "expected_answers": """SELECT o_orderkey AS id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, o_orderpriority) AS expected FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""",
    "list_entries": """WITH l AS (SELECT l_orderkey, l_linenumber AS line, min(l_partkey) AS n FROM lineitem GROUP BY ALL),
        p AS (SELECT l_orderkey, line, 0 AS k, 'p' || n || CASE WHEN n % 2 = 0 THEN ' — q' ELSE '' END AS piece FROM l
            UNION ALL SELECT l_orderkey, line, 1, 'r' || n || CASE WHEN n % 3 = 0 THEN ' — s' ELSE '' END FROM l),
        e AS (SELECT *, coalesce(lag(contains(piece, ' — ')) OVER (PARTITION BY l_orderkey ORDER BY line, k), true)::INT AS starts FROM p),
        n AS (SELECT *, sum(starts) OVER (PARTITION BY l_orderkey ORDER BY line, k) AS entry FROM e)
        SELECT l_orderkey, entry::BIGINT AS entry, string_agg(piece, ' | ' ORDER BY line, k) AS text FROM n GROUP BY ALL""",
    "city_numbers": """SELECT c_custkey, round(greatest(3.0, least(25.0, 2 + 4 * log10(greatest(pow(10, c_custkey % 9), 1000) / 1000)))::DOUBLE, 6) AS radius,
        round(CASE WHEN c_custkey % 4 = 0 OR c_custkey * 7 - 5 <= 0 THEN 0.0 ELSE least(3.0, log10(1 + (c_custkey * 7 - 5) / 100)) END::DOUBLE, 6) AS fame FROM customer""",
    "unblinded_scores": """SELECT o_orderkey AS id, 's' || (o_orderkey + i) % 3 AS system, CASE i WHEN 0 THEN o_orderkey % 11 WHEN 1 THEN o_orderkey % 7 ELSE o_orderkey % 5 END AS score
        FROM orders, range(3) AS r(i) WHERE o_orderkey % 10 <> 0""",
    "kinds_asked": f"""WITH q AS (SELECT item_id, 'find a ' || {_DIETS}[item_id % len({_DIETS}) + 1] || ' ' || {_WORDS}[item_id * 7 % len({_WORDS}) + 1]
            || CASE WHEN item_id % 3 = 0 THEN ' or ' || {_WORDS}[(item_id * 5 + 1) % len({_WORDS}) + 1] ELSE '' END || ' in rome, ' || lower(text) AS low FROM benchmark),
        k AS ({_FIRST.format(values=_values(KIND_WORDS))}), d AS ({_FIRST.format(values=_values(DIETS))})
        SELECT q.item_id, CASE WHEN k.value <> 'sights' THEN k.value END AS kind, CASE WHEN k.value <> 'sights' THEN d.value END AS diet FROM q LEFT JOIN k USING (item_id) LEFT JOIN d USING (item_id)""",
    "fork_stages": """WITH w AS (SELECT n_nationkey AS n, 'Upgrade' || translate(n_nationkey::VARCHAR, '0123456789', 'abcdefghij') AS name, '2020-01-01'::DATE + n_nationkey::INTEGER AS day FROM nation),
        d AS (SELECT name, day FROM w WHERE n % 3 <> 0),
        live AS (SELECT unnest([n * 3, n * 5 + 1]) AS number, CASE WHEN n % 2 = 0 THEN 'N' || n ELSE w.name END AS upgrade, 'live' AS stage, d.day::DATE AS day, 0 AS source, n AS rank FROM w LEFT JOIN d USING (name)),
        m AS (SELECT s_suppkey AS k, 'Upgrade' || translate(((s_suppkey + 1) % 25)::VARCHAR, '0123456789', 'abcdefghij') AS upgrade,
            'Upgrade' || translate(((s_suppkey + 2) % 25)::VARCHAR, '0123456789', 'abcdefghij') AS other, s_suppkey % 2 = 0 AS final FROM supplier WHERE s_suppkey % 5 = 0),
        meta AS (SELECT m.*, coalesce(a.day, b.day) AS day FROM m LEFT JOIN d a ON a.name = upgrade LEFT JOIN d b ON b.name = other),
        links AS (SELECT k * 7 + i AS number, upgrade, CASE WHEN final THEN 'live' WHEN i = 1 THEN 'considered' ELSE 'scheduled' END AS stage, CASE WHEN final THEN day END AS day, 1 AS source, k AS rank
            FROM meta, range(6) AS r(i) WHERE i IN (0, 1, 3) OR (i = 5 AND final))
        SELECT number, upgrade, stage, day::DATE AS day FROM (SELECT * FROM live UNION ALL SELECT * FROM links WHERE number <> rank)
        QUALIFY row_number() OVER (PARTITION BY number ORDER BY source, rank) = 1""",
    "retrieval_changes": f"""{_POSTS},
        pool AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(hits.score, 9) DESC, article_id, start) AS rank FROM hits QUALIFY rank <= {_POOL}),
        s AS (SELECT question, article_id, start, score + 2 * log10(1 + views) AS score FROM pool JOIN articles USING (article_id)),
        t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question, article_id ORDER BY round(s.score, 9) DESC, start DESC) <= 5),
        u AS (SELECT question, article_id, start, row_number() OVER (PARTITION BY question ORDER BY round(t.score, 9) DESC, article_id DESC, start DESC) AS rank FROM t QUALIFY rank <= {_BEST}),
        x AS (SELECT question, rank, title || '|' || body AS shown, left(body, 120) AS cut, 1 AS build FROM pool JOIN pas USING (article_id, start) WHERE rank <= {_BEST}
            UNION ALL SELECT question, rank, title || '|' || body, left(body, 120), 2 FROM u JOIN pas USING (article_id, start)),
        g AS (SELECT question, string_agg(shown, '~' ORDER BY rank) FILTER (build = 1) AS one, string_agg(shown, '~' ORDER BY rank) FILTER (build = 2) AS two,
            string_agg(md5(cut), ',' ORDER BY rank) FILTER (build = 2) AS texts FROM x GROUP BY 1)
        SELECT question AS item_id, one = two AS same, texts AS two FROM g""",
    "coordinates": """WITH s AS (SELECT s_suppkey, s_suppkey % 80 + 0.25 AS lat, s_suppkey % 170 + 0.5 AS lon, s_suppkey % 50 AS x, s_suppkey % 30 AS y FROM supplier)
        SELECT s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN lat ELSE -lat END)::DOUBLE AS a_lat, (CASE WHEN s_suppkey % 3 = 0 THEN lon ELSE -lon END)::DOUBLE AS a_lon,
            round((CASE WHEN s_suppkey % 2 = 0 THEN -lat ELSE y + 2 / 3 END)::DOUBLE, 6) AS w_lat, round((CASE WHEN s_suppkey % 2 = 0 THEN lon ELSE x + 8 / 3 END)::DOUBLE, 6) AS w_lon FROM s""",
    "document_weights": "SELECT o_orderkey, CASE lower(o_orderstatus) WHEN 'f' THEN 1000 WHEN 'o' THEN 500 ELSE 7 END::BIGINT AS views FROM orders",
    "subject_kinds": f"SELECT p_partkey, {_listed([kinds for _, kinds in _SUBJECTS])}[p_partkey % {len(_SUBJECTS)} + 1] AS kinds FROM part",
    "span_overlaps": """WITH l AS (SELECT l_partkey AS article_id, l_orderkey AS place, l_orderkey * 2 AS start, l_orderkey * 2 + min(l_linenumber) * 900 AS stop FROM lineitem GROUP BY 1, 2),
        p AS (SELECT *, lag(stop) OVER (PARTITION BY article_id ORDER BY start, place) AS before FROM l)
        SELECT article_id, place, before FROM p WHERE start < before""",
    "place_spans": """WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, replace(p_brand, '#', 'x') AS other FROM part),
        s AS (SELECT p_partkey, 0 AS at_, other AS text, true AS anchored FROM n UNION ALL SELECT p_partkey, 1, name, true FROM n
            UNION ALL SELECT p_partkey, 2, name, false FROM n UNION ALL SELECT p_partkey, 3, other, false FROM n)
        SELECT p_partkey, at_::BIGINT AS "at", text, anchored FROM s""",
    "guide_listings": """WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name,
            ['Eat', 'Sleep', NULL][p_partkey % 3 + 1] AS section, p_brand FROM part)
        SELECT p_partkey, section, 'Budget' AS tier, name, p_partkey || ' Street. Fine food' AS rest FROM n WHERE section IS NOT NULL
        UNION ALL SELECT p_partkey, section, 'Budget', 'Second ' || name || ':', '' FROM n WHERE section IS NOT NULL
        UNION ALL SELECT p_partkey, 'Buy', NULL, 'X:', '' FROM n UNION ALL SELECT p_partkey, 'Buy', NULL, p_brand, '9' FROM n""",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE, true)::INT AS starts FROM events),
        s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
        SELECT user_id, epoch_us(min(ts)) AS t0, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS t1, count(*) AS events FROM s GROUP BY user_id, n""",
    "stream_texts": "SELECT doc_id AS run, greatest(ceil(length(text) / 97)::BIGINT, 1) - 1 AS last, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL",
}
