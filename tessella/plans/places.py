"""Queries that merge, correct and look up places, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import answers as a
from tessella.operators import places as p
from tessella.plans.tables import ARTICLES, PLACES, articles, places, read

VEGAN_CAT = "PROMO PLATED BRASS"


def _side(spark: SparkSession, sf_dir: str, src: str) -> DataFrame:
    return places(spark, sf_dir).where(F.col("src") == src).withColumnRenamed("pid", "id").withColumn("name", F.lower("name"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.mutual_matches(_side(spark, sf_dir, "a"), _side(spark, sf_dir, "b"))


def spatial_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.near_ids(_side(spark, sf_dir, "a"), _side(spark, sf_dir, "b"), 6)


def mutual_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round("sim", 6).alias("sim"))


def anti_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).select("a", "b")
    merged = p.merge_sources(_side(spark, sf_dir, "b"), _side(spark, sf_dir, "a"), pairs)
    return merged.select("id", "name", "cat", "conf", "diet", "sources")


def fold_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = places(spark, sf_dir).select("pid", "name", "lat", "lon", F.lit("x").alias("top"), "conf", "diet", (F.col("pid") % 2 + 1).alias("sources"))
    return p.fold_duplicates(base).select("pid", "name", "conf", "diet", "sources", "copies")


def _businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select(
        "pid", "name", F.concat_ws("|", "name", "brand").alias("biz"), "cat", (F.col("diet") * 2 % 1024).alias("diet")
    )


def branch_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _businesses(spark, sf_dir).withColumn("biz", F.substring_index("biz", " ", 1))
    cat = base.groupBy("cat").agg(F.count("*").alias("n")).orderBy("n", "cat").first()["cat"]
    return p.correct_branches(base, cat).select("pid", "cat", "diet")


def name_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = places(spark, sf_dir).select("name", (F.col("lat") + F.col("pid") % 7).alias("lat"), "lon", (F.col("pid") % 3 == 0).alias("more"))
    return p.name_spread(base)


def qualified_title_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "part")
    names = base.select(F.col("p_partkey").alias("pid"), F.lower("p_name").alias("n"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("restaurant", "hotel", "film")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    titles = base.select(F.col("p_partkey").alias("aid"), F.concat(F.lower("p_name"), F.lit(" ("), kind, F.lit(")")).alias("t"))
    return p.qualified_titles(names, titles, ["restaurant", "hotel"])


def fame_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs = places(spark, sf_dir), articles(spark, sf_dir)
    cands = base.select("pid", F.explode(F.array(F.col("pid") % 500, F.col("pid") % 311)).alias("aid"))
    tops = F.element_at(F.array(*[F.lit(x) for x in ("food_and_drink", "lodging", "shop")]), (F.col("pid") % 3 + 1).cast("int"))
    kinds = docs.select(
        F.col("article_id").alias("aid"), F.element_at(F.array(*[F.lit(x) for x in ("food", "lodging", "other")]), (F.col("article_id") % 3 + 1).cast("int")).alias("kind"),
        F.when(F.col("article_id") % 4 != 0, 40.0 + F.col("article_id") % 3 * 0.08).alias("alat"), F.when(F.col("article_id") % 4 != 0, -8.0).cast("double").alias("alon"),
    )
    return p.fame(cands, base.select("pid", "lat", "lon", tops.alias("top")), kinds, docs.select(F.col("article_id").alias("aid"), "title", "views"))


def blocking_join_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the one source as a guide's listings, those of the other as places."""
    base = places(spark, sf_dir)
    name, full = F.lower("name"), F.lower(F.concat_ws(" ", "name", "brand"))
    section = F.element_at(F.array(*[F.lit(x) for x in ("Eat", "Sleep", "See")]), (F.col("pid") % 3 + 1).cast("int"))
    top = F.element_at(F.array(*[F.lit(x) for x in ("food_and_drink", "lodging", "shop")]), (F.col("pid") % 3 + 1).cast("int"))
    listings = base.where("src = 'a'").select(
        F.col("pid").alias("lid"), name.alias("name"), full.alias("full"), section.alias("section"), (F.col("pid") % 9).cast("string").alias("digits"),
        "lat", "lon", F.lit(0.8).alias("radius_km"),
    )
    there = base.where("src = 'b'").select(
        "pid", name.alias("name"), full.alias("full"), F.concat(F.lit("Street "), (F.col("pid") % 9).cast("string")).alias("street"), top.alias("top"), "lat", "lon"
    )
    return p.guide_match(listings, there)


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ask"), (40.0 + F.col("n_nationkey") * 0.0004).alias("lat"), (-8.0 + F.col("n_nationkey") * 0.0003).alias("lon")
    )


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = p.static_rank(F.col("pid") % 8, F.col("conf"), F.col("pid") % 10 == 0, F.when(F.col("pid") % 3 == 0, "w"), F.lit(0))
    return p.with_cells(places(spark, sf_dir)).withColumn("rank", rank).withColumn("chain", F.col("pid") % 10 == 0)


def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.within(_asks(spark, sf_dir).withColumn("radius_km", F.lit(0.3)), _ranked(spark, sf_dir))
    return found.select("ask", "pid", F.round("km", 6).alias("km"))


def radius_topk_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.within(_asks(spark, sf_dir).withColumn("radius_km", F.lit(0.9)), _ranked(spark, sf_dir))
    return p.candidates(found).select("ask", "pid", "rank", "capped")


def widening_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.widening(_asks(spark, sf_dir), _ranked(spark, sf_dir), (0.004, 0.01, 0.02))


def diet_tiers_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).select("pid", p.diet_tier(F.col("diet"), F.col("cat"), F.col("name")).alias("tier"))


def _cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    made = customers.groupBy(F.col("c_nationkey").alias("country"), (F.col("c_custkey") % 7).alias("k")).agg(
        F.sum(F.abs("c_acctbal")).cast("long").alias("population")
    )
    return made.select(
        (F.col("country") * 10 + F.col("k")).cast("long").alias("city"), "country", F.concat(F.lit("city "), (F.col("k") * 3 % 5).cast("string")).alias("name"),
        "population", (F.col("k") == 2).alias("capital"),
    )


def region_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("country"), F.col("n_regionkey").alias("region"))
    return p.largest_city(_cities(spark, sf_dir).join(F.broadcast(nations), "country"), ["region"])


def country_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.country_city(_cities(spark, sf_dir), 1.1)


def locate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("ask"), F.posexplode(F.array(F.lit("nowhere"), F.concat(F.lit("city "), (F.col("n_nationkey") % 6).cast("string")), F.lit("city 1"))).alias("place", "key")
    )
    names = _cities(spark, sf_dir).select(F.col("name").alias("key"), "city", "population", (F.col("city") % 2 == 0).alias("primary"), "capital")
    return p.locate(asks, names)


def diversify_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.candidates(p.within(_asks(spark, sf_dir).withColumn("radius_km", F.lit(0.9)), _ranked(spark, sf_dir)))
    scored = found.withColumn("score", p.score(F.col("rank"), F.col("km"), F.col("radius_km")))
    return p.diversified(scored.select("ask", "pid", "name", "chain", "lat", "lon", "score"))


def city_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ask with radii of its own, until there is a place."""
    radii = p.city_radii(0.0005 + (F.col("ask") % 4) * 0.002)
    return p.widening_each(_asks(spark, sf_dir).withColumn("radii", radii), _ranked(spark, sf_dir)).withColumn("radius_km", F.round("radius_km", 6))


def cash_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places asked for cash or food; every fifth name is a bitcoin machine's, every seventh question wants one."""
    k = F.col("pid")
    found = places(spark, sf_dir).select(
        "pid", F.when(k % 2 == 0, "money").otherwise("eat").alias("kind"), F.when(k % 7 == 0, "where is a Bitcoin ATM").otherwise("where is an atm").alias("question"),
        F.when(k % 5 == 0, F.concat(F.lit("BTC "), "name")).otherwise(F.col("name")).alias("name"),
    )
    return p.without_crypto(found).select("pid", "name")


def hinted_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities of one name, asked for with a nation's name after them, a region's, or nothing that is known."""
    nations = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    after = F.when(key % 3 == 0, F.lower("n_name")).when(key % 3 == 1, "part 1 please").otherwise("nothing known")
    rest = nations.select(key.alias("ask"), F.split(F.concat(F.lit("in the "), after), " ").alias("words"))
    cities = _cities(spark, sf_dir).where("name = 'city 1'").select("city", "country", (F.col("city") % 2).cast("string").alias("region"))
    names = nations.select(F.lower("n_name").alias("key"), key.alias("country"), F.lit("").alias("region")).unionByName(
        nations.select(F.concat(F.lit("part "), (key % 2).cast("string")).alias("key"), key.alias("country"), F.lit("1").alias("region")))
    return p.hinted(nations.select(key.alias("ask")).join(cities, F.col("ask") % 5 == F.col("country") % 5), rest, names)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("pid")
    diet = F.element_at(F.array(F.lit("vegan"), F.lit("vegetarian"), F.lit("gluten_free"), F.lit(None)), (k % 4 + 1).cast("int"))
    article = F.when(k % 3 == 0, "Town")
    why = a.reasons(diet, (k % 3).cast("int"), F.when(k % 2 == 0, 0).otherwise(1), article, F.when(k % 6 == 0, "Budget"))
    return places(spark, sf_dir).select(
        "pid", "name", why.alias("why"), F.when(k % 5 == 0, "vegan_restaurant").otherwise("coffee_shop").alias("kind"), F.when(k % 2 == 0, "1 Main St").alias("street"),
        ((k % 50) / 10.0).alias("km"), article.isNotNull().alias("in_guide"),
    )


def place_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, sf_dir).select("pid", F.array_join("why", "|").alias("why"))


def place_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place as a list and a prompt show it."""
    c, none, you = F.col, F.lit(None).cast("string"), F.lit("you")
    listed = a.list_line(c("pid"), c("name"), c("kind"), c("why"), c("street"), c("km"), you, c("in_guide"))
    hours = F.when(c("pid") % 2 == 1, "Mo-Su 08:00-24:00")
    prompt = a.prompt_line(c("pid"), c("name"), c("kind"), c("why"), F.lit("thai; hot_pot;"), c("street"), c("km"), you, hours, F.when(c("in_guide"), "Good."), none)
    return _listed(spark, sf_dir).select("pid", listed.alias("listed"), prompt.alias("prompt"))


QUERIES = {
    f.__name__: f
    for f in (
        spatial_grid_join, mutual_best_match, anti_union_merge, fold_duplicates, branch_correction, name_spread, qualified_title_join,
        fame_join, blocking_join_guide, cell_lookup, radius_topk_capped, widening_lookup, diet_tiers_bits, region_city, country_city,
        locate_candidates, diversify_top12, city_widening, cash_places, hinted_cities, place_reasons, place_lines,
    )
}

_D = "sqrt(pow((a.lat - b.lat) * 110540, 2) + pow((a.lon - b.lon) * 111320 * cos(radians(a.lat)), 2))"
_NEAR = f"""near AS (SELECT a.pid AS a, b.pid AS b, lower(a.name) AS na, lower(b.name) AS nb, {_D} AS d
    FROM places a, places b WHERE a.src = 'a' AND b.src = 'b' AND {_D} <= 120)"""
_MUTUAL = f"""{_NEAR}, scored AS (SELECT *, CASE WHEN na = nb THEN 1.0
        WHEN length(na) >= 4 AND length(nb) >= 4 AND (contains(na, nb) OR contains(nb, na)) THEN 0.95
        ELSE jaro_winkler_similarity(na, nb) END::DOUBLE AS sim FROM near),
    best AS (SELECT * FROM scored WHERE sim >= 0.9 QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, d, b) = 1),
    pairs AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY b ORDER BY sim DESC, d, a) = 1)"""
_KM = """6371.0 * sqrt(pow(radians(p.lon - k.lon) * cos(radians((k.lat + p.lat) / 2)), 2) + pow(radians(p.lat - k.lat), 2))"""
_ASKS = "asks AS (SELECT n_nationkey AS ask, 40.0 + n_nationkey * 0.0004 AS lat, -8.0 + n_nationkey * 0.0003 AS lon FROM nation)"
_RANKED = """ranked AS (SELECT *, conf + CASE WHEN pid % 8 & 4 != 0 THEN 150 ELSE 0 END + CASE WHEN pid % 8 & 3 = 3 THEN 50 ELSE 0 END
    + CASE WHEN pid % 3 = 0 THEN 20 ELSE 0 END - CASE WHEN pid % 10 = 0 THEN 100 ELSE 0 END AS rank FROM places)"""
_CITIES = """cities AS (SELECT c_nationkey * 10 + c_custkey % 7 AS city, c_nationkey AS country, 'city ' || (c_custkey % 7 * 3 % 5) AS name,
    trunc(sum(abs(c_acctbal)))::BIGINT AS population, c_custkey % 7 = 2 AS capital FROM customer GROUP BY 1, 2, 3, 5)"""

_LISTED = """listed AS (SELECT pid, name, pid % 3 AS tier, pid % 2 = 0 AS vegan, pid % 3 = 0 AS guide, CASE WHEN pid % 5 = 0 THEN 'vegan_restaurant' ELSE 'coffee_shop' END AS kind,
        ['vegan', 'vegetarian', 'gluten_free', NULL][pid % 4 + 1] AS diet, CASE WHEN pid % 2 = 0 THEN '1 Main St' END AS street, (pid % 50) / 10.0 AS km, pid % 6 = 0 AS budget FROM places),
    why AS (SELECT *, CASE WHEN diet = 'vegan' THEN ['vegan', 'vegetarian', 'vegan options'][tier + 1]
            WHEN diet = 'vegetarian' THEN CASE WHEN tier = 0 AND vegan THEN 'vegan' WHEN tier = 0 THEN 'vegetarian' ELSE 'vegetarian options' END
            WHEN diet IS NOT NULL THEN CASE WHEN tier = 0 THEN 'gluten-free' ELSE 'gluten-free options' END END AS w,
        CASE WHEN guide THEN 'in the Wikivoyage guide (Town' || CASE WHEN budget THEN ', Budget' ELSE '' END || ')' END AS g FROM listed),
    said AS (SELECT *, CASE WHEN w IN ('vegan', 'vegetarian') AND kind = 'vegan_restaurant' THEN [w || ' restaurant'] ELSE list_filter([replace(kind, '_', ' '), w], lambda x: x IS NOT NULL) END AS words,
        printf('%.1f km from you', km::DOUBLE) AS away FROM why)"""

ORACLES = {
    "city_widening": f"""WITH {PLACES}, {_ASKS}, f AS (SELECT ask, 0.0005::DOUBLE + ask % 4 * 0.002::DOUBLE AS r, {_KM} AS km FROM asks k, places p),
        c AS (SELECT ask, r, count(*) FILTER (km <= r) AS n1, count(*) FILTER (km <= 2 * r) AS n2, count(*) FILTER (km <= 4 * r) AS n4 FROM f GROUP BY ask, r)
        SELECT ask, round(CASE WHEN n1 > 0 THEN r WHEN n2 > 0 THEN 2 * r ELSE 4 * r END, 6) AS radius_km, CASE WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n4 END AS total FROM c""",
    "cash_places": f"""WITH {PLACES} SELECT pid, CASE WHEN pid % 5 = 0 THEN 'BTC ' || name ELSE name END AS name FROM places WHERE pid % 2 <> 0 OR pid % 7 = 0 OR pid % 5 <> 0""",
    "hinted_cities": f"""WITH {_CITIES}, k AS (SELECT city, country, (city % 2)::VARCHAR AS region FROM cities WHERE name = 'city 1'),
        c AS (SELECT n_nationkey AS ask, k.* FROM nation JOIN k ON n_nationkey % 5 = country % 5),
        m AS (SELECT ask, city FROM c WHERE (ask % 3 = 0 AND country = ask) OR (ask % 3 = 1 AND country % 2 = 1 AND region = '1'))
        SELECT * FROM m UNION ALL SELECT ask, city FROM c WHERE ask NOT IN (SELECT ask FROM m)""",
    "place_reasons": f"WITH {PLACES}, {_LISTED} SELECT pid, array_to_string(list_filter([w, g], lambda x: x IS NOT NULL), '|') AS why FROM said",
    "place_lines": f"""WITH {PLACES}, {_LISTED} SELECT pid, '[' || pid || '] ' || name || ' — ' || array_to_string(list_filter(words || [street, away, CASE WHEN guide THEN 'in the travel guide' END], lambda x: x IS NOT NULL), ' · ') AS listed,
        '[' || pid || '] ' || name || ': ' || array_to_string(list_filter(words || ['cuisine: thai, hot pot', 'address: ' || street, away, CASE WHEN pid % 2 = 1 THEN 'hours: Mo-Su 08:00-24:00' END], lambda x: x IS NOT NULL), '; ')
        || '.' || CASE WHEN guide THEN ' The travel guide says: Good.' ELSE '' END AS prompt FROM said""",
    "spatial_grid_join": f"WITH {PLACES}, {_NEAR} SELECT a, b, round(d, 6) AS d FROM near",
    "mutual_best_match": f"WITH {PLACES}, {_MUTUAL} SELECT a, b, round(sim, 6) AS sim FROM pairs",
    "anti_union_merge": f"""WITH {PLACES}, {_MUTUAL}
        SELECT v.pid AS id, lower(v.name) AS name, v.cat, v.conf, coalesce(o.diet, 0) AS diet, (CASE WHEN o.pid IS NULL THEN 1 ELSE 3 END)::BIGINT AS sources
        FROM places v LEFT JOIN pairs ON pairs.b = v.pid LEFT JOIN places o ON o.pid = pairs.a WHERE v.src = 'b'
        UNION ALL SELECT pid, lower(name), cat, 60::BIGINT, diet, 2::BIGINT FROM places WHERE src = 'a' AND pid NOT IN (SELECT a FROM pairs)""",
    "fold_duplicates": f"""WITH {PLACES}, g AS (SELECT *, pid % 2 + 1 AS s, lower(trim(name)) AS nk, round(lat * 300)::BIGINT AS gy, round(lon * 300)::BIGINT AS gx FROM places)
        SELECT pid, name, conf, bit_or(diet) OVER w AS diet, bit_or(s) OVER w AS sources, count(*) OVER w AS copies FROM g
        WINDOW w AS (PARTITION BY nk, gy, gx) QUALIFY row_number() OVER (PARTITION BY nk, gy, gx ORDER BY conf DESC, pid) = 1""",
    "branch_correction": f"""WITH {PLACES}, g AS (SELECT pid, name, split_part(name, ' ', 1) AS biz, cat, diet * 2 % 1024 AS diet FROM places),
        v AS (SELECT cat AS vegan FROM g GROUP BY 1 ORDER BY count(*), cat LIMIT 1),
        s AS (SELECT biz, count(*) AS n, count(*) FILTER (cat = vegan OR diet & 1 != 0) AS veg FROM g, v GROUP BY 1 HAVING count(*) >= 3),
        m AS (SELECT biz, cat AS usual FROM g, v WHERE cat != vegan GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY biz ORDER BY count(*) DESC, cat) = 1),
        d AS (SELECT pid, coalesce(usual, 'restaurant') AS usual FROM g JOIN s USING (biz) LEFT JOIN m USING (biz), v WHERE g.cat = vegan AND g.diet & 1 = 0 AND veg * 3 < n)
        SELECT g.pid, coalesce(usual, cat) AS cat, CASE WHEN usual IS NULL THEN diet ELSE diet | 2 END AS diet FROM g LEFT JOIN d ON d.pid = g.pid""",
    "name_spread": f"""WITH {PLACES}, g AS (SELECT lower(trim(name)) AS n, floor((lat + pid % 7) * 10)::BIGINT * 4000 + floor(lon * 10)::BIGINT AS cell, pid % 3 = 0 AS more FROM places)
        SELECT n, more_only, count(DISTINCT cell) AS cells FROM g, (SELECT unnest([false, true]) AS more_only) WHERE more_only OR NOT more GROUP BY 1, 2""",
    "qualified_title_join": """WITH t AS (SELECT p_partkey AS aid, lower(p_name) || ' (' || ['restaurant', 'hotel', 'film'][p_partkey % 3 + 1] || ')' AS t FROM part)
        SELECT p_partkey AS pid, aid, regexp_extract(t, '\\(([^)]*)\\)$', 1) AS qualifier FROM part JOIN t ON t LIKE lower(p_name) || ' (%)'
        WHERE regexp_extract(t, '\\(([^)]*)\\)$', 1) IN ('restaurant', 'hotel')""",
    "fame_join": f"""WITH {PLACES}, {ARTICLES}, c AS (SELECT DISTINCT pid, unnest([pid % 500, pid % 311]) AS aid FROM places),
        k AS (SELECT article_id AS aid, ['food', 'lodging', 'other'][article_id % 3 + 1] AS kind, CASE WHEN article_id % 4 != 0 THEN 40.0 + article_id % 3 * 0.08 END AS alat,
              CASE WHEN article_id % 4 != 0 THEN -8.0 END AS alon, title, views FROM articles)
        SELECT pid, max(views) AS views, max_by(title, {{'v': views, 't': title}}) AS title FROM c JOIN places m USING (pid) JOIN k USING (aid)
        WHERE kind = ['food', 'lodging', 'other'][pid % 3 + 1] AND (alat IS NULL OR sqrt(pow((lat - alat) * 110.54, 2) + pow((lon - alon) * 111.32 * cos(radians(lat)), 2)) <= 10)
        GROUP BY pid""",
    "blocking_join_guide": f"""WITH {PLACES}, x AS (SELECT pid, lower(name) AS n, lower(name || ' ' || brand) AS f, lat, lon, pid % 3 AS kind, pid % 9 AS num, src FROM places),
        near AS (SELECT l.pid AS lid, p.pid, l.n AS a, p.n AS b, l.f AS fa, p.f AS fb, l.num = p.num AS num, l.f = p.f AS same, jaro_winkler_similarity(p.n, l.n) AS jw,
            sqrt(pow((p.lat - l.lat) * 110.54, 2) + pow((p.lon - l.lon) * 111.32 * cos(radians(l.lat)), 2)) AS km,
            len(string_split(l.f, ' ')) >= 2 AND len(string_split(p.f, ' ')) >= 2 AND (list_has_all(string_split(p.f, ' '), string_split(l.f, ' '))
                OR list_has_all(string_split(l.f, ' '), string_split(p.f, ' '))) AS subset
            FROM x l JOIN x p ON left(l.n, 3) = left(p.n, 3) AND l.kind = p.kind WHERE l.src = 'a' AND p.src = 'b'),
        ok AS (SELECT * FROM near WHERE km <= 0.8 AND (same OR (a = b AND length(a) >= 4) OR (jw >= 0.95 AND length(a) >= 6) OR (num AND jw >= 0.88) OR subset)),
        r AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY (same OR a = b) DESC, num DESC, subset DESC, jw DESC, km, pid) AS rk, count(*) OVER (PARTITION BY lid) AS nc FROM ok)
        SELECT lid, pid FROM r WHERE rk = 1 AND (nc = 1 OR num OR same OR (a = b AND length(a) >= 6) OR subset)""",
    "cell_lookup": f"WITH {PLACES}, {_ASKS} SELECT ask, pid, round({_KM}, 6) AS km FROM asks k, places p WHERE {_KM} <= 0.3",
    "radius_topk_capped": f"""WITH {PLACES}, {_ASKS}, {_RANKED}, f AS (SELECT ask, pid, rank FROM asks k, ranked p WHERE {_KM} <= 0.9
            QUALIFY row_number() OVER (PARTITION BY ask ORDER BY rank DESC, pid) <= 400)
        SELECT ask, pid, rank, count(*) OVER (PARTITION BY ask) = 400 AS capped FROM f""",
    "widening_lookup": f"""WITH {PLACES}, {_ASKS}, f AS (SELECT ask, {_KM} AS km FROM asks k, places p),
        c AS (SELECT ask, count(*) FILTER (km <= 0.004) AS r0, count(*) FILTER (km <= 0.01) AS r1, count(*) FILTER (km <= 0.02) AS r2 FROM f GROUP BY ask)
        SELECT ask, CASE WHEN r0 >= 5 THEN 0.004 WHEN r1 >= 5 THEN 0.01 ELSE 0.02 END::DOUBLE AS radius_km, CASE WHEN r0 >= 5 THEN r0 WHEN r1 >= 5 THEN r1 ELSE r2 END AS total FROM c""",
    "diet_tiers_bits": f"""WITH {PLACES} SELECT pid, CASE WHEN diet & 1 != 0 THEN 0 WHEN diet & 8 != 0 THEN NULL WHEN diet & 16 != 0 THEN 1 WHEN diet & 2 != 0 THEN 2
        WHEN diet & 4 != 0 OR diet & 32 != 0 THEN 3 END AS tier FROM places""",
    "region_city": f"""WITH {_CITIES}, c AS (SELECT n_regionkey AS region, cities.* FROM cities JOIN nation ON n_nationkey = country)
        SELECT region, (sum(population) OVER (PARTITION BY region))::BIGINT AS total, city, name, population FROM c
        QUALIFY row_number() OVER (PARTITION BY region ORDER BY population DESC, city) = 1""",
    "country_city": f"""WITH {_CITIES}, b AS (SELECT country, city, population FROM cities QUALIFY row_number() OVER (PARTITION BY country ORDER BY population DESC, city) = 1),
        k AS (SELECT country, city, population FROM cities WHERE capital)
        SELECT b.country, CASE WHEN k.city IS NULL OR b.population > 1.1 * k.population THEN b.city ELSE k.city END AS city FROM b LEFT JOIN k USING (country)""",
    "locate_candidates": f"""WITH {_CITIES}, a AS (SELECT n_nationkey AS ask, 1 AS place, 'city ' || (n_nationkey % 6) AS key FROM nation UNION ALL SELECT n_nationkey, 2, 'city 1' FROM nation)
        SELECT ask, city FROM a JOIN cities ON name = key
        QUALIFY row_number() OVER (PARTITION BY ask ORDER BY place, -population * CASE WHEN city % 2 = 0 THEN 3 ELSE 1 END * CASE WHEN capital THEN 5 ELSE 1 END, city) = 1""",
}
