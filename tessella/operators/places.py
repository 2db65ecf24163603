"""Places from several sources: matching, merging, folding, correcting, fame, and lookups around a point.

Joins by distance are equi joins on grid squares: the smaller side is put into
the squares round it, then distances are checked. Rankings are windows with
a total order, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geo
from tessella.functions.names import jaro_winkler, letter_mask, may_reach, most_alike, similarity

#: Diet bits and source bits of a place.
VEGAN = {"only": 1, "yes": 2, "limited": 4, "no": 8}
VEGETARIAN = {"only": 16, "yes": 32, "limited": 64}
GLUTEN_FREE, HALAL, KOSHER = 128, 256, 512
FROM_FIRST, FROM_SECOND, FROM_GUIDE = 1, 2, 4
#: Fixed values of the matching and lookup rules.
MATCH_M, MATCH_GRID, MATCH_SIMILARITY = 120, 0.002, 0.9
FOLD_PER_DEGREE, GUIDE_GRID = 300, 0.05
CANDIDATES, WIDENING_KM, ENOUGH = 400, (2.0, 5.0, 10.0), 5
CITY_WIDEN, CITY_MOST_KM = (1.0, 2.0, 4.0), 50.0
CRYPTO = r"(?i)\b(bitcoin|crypto|btc)"
#: Small squares to a side of a grid square.
FINER = 4
#: Titles of a name, and places of a point, that are joined as one row.
BLOCK = 2000
#: Asks and their cells up to which they are broadcast.
BROADCAST_ROWS = 1_000_000
VEGAN_WORDS = r"(?i)\b(vegan[oa]?s?|v[eé]gane?s?|plant[- ]based)\b"


def _squares(left: DataFrame, right: DataFrame, metres: float, grid: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): left in each small square that its circle can touch, right in its own; fy, fx name the square, gy, gx the one of the grid.

    Small squares are a quarter of the grid's: few pairs meet beyond the distance, and a
    dense town is many keys.
    """
    size = grid / FINER
    fine = lambda c: F.floor(F.col(c) / size)
    up = F.lit(int(-(-metres // (geo.BUILD_LAT_M * size))))
    # Beyond twice FINER no square of the grid is a neighbour.
    side = F.least(F.ceil(metres / (geo.BUILD_LON_M * size * F.greatest(F.cos(F.radians("lat")), F.lit(1e-9)))), F.lit(2 * FINER))
    named = [F.floor(F.col(c) / grid).alias(n) for c, n in (("lat", "gy"), ("lon", "gx"))]
    a = left.select("*", *named, F.cos(F.radians("lat")).alias("narrow"), side.alias("side"), fine("lon").alias("fx0"), F.explode(F.sequence(fine("lat") - up, fine("lat") + up)).alias("fy"))
    a = a.select("*", F.explode(F.sequence(F.col("fx0") - F.col("side"), F.col("fx0") + F.col("side"))).alias("fx")).drop("fx0", "side")
    return a, right.select("*", *named, fine("lat").alias("fy"), fine("lon").alias("fx"))


def _met(a: DataFrame, b: DataFrame, on: list[str], metres: float) -> DataFrame:
    """The pairs of _squares() in equal squares, and equal in `on`, that are neighbours in the grid and within metres; d is their distance."""
    other = b.select(*[F.col(c) if c in ("fy", "fx", *on) else F.col(c).alias(f"{c}_b") for c in b.columns])
    near = (F.abs(F.col("gy") - F.col("gy_b")) <= 1) & (F.abs(F.col("gx") - F.col("gx_b")) <= 1)
    # geo.build_distance_m(), with products for its squares and the cosine of each place taken once.
    y, x = (F.col("lat") - F.col("lat_b")) * geo.BUILD_LAT_M, (F.col("lon") - F.col("lon_b")) * geo.BUILD_LON_M * F.col("narrow")
    return a.join(other, ["fy", "fx", *on]).where(near).withColumn("d", F.sqrt(y * y + x * x)).where(F.col("d") <= metres)


def near_pairs(left: DataFrame, right: DataFrame, metres: float = MATCH_M, grid: float = MATCH_GRID) -> DataFrame:
    """(a, b, name_a, name_b, mask_a, mask_b, d): places of left and right (id, lat, lon, name) within metres; masks are those of their names' letters.

    Squares of the grid that hold the two are the same or neighbours.
    """
    side = lambda rows: rows.select("id", "lat", "lon", "name", letter_mask(F.col("name")).alias("mask"))
    pairs = _met(*_squares(side(left), side(right), metres, grid), [], metres)
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b"), F.col("name").alias("name_a"), F.col("name_b"), F.col("mask").alias("mask_a"), F.col("mask_b"), "d")


def _folded(rows: DataFrame) -> DataFrame:
    """(lat, lon, ids): the ids of rows (id, lat, lon) at each point, at most about BLOCK in a row."""
    sizes = rows.groupBy("lat", "lon").agg(F.ceil(F.count("*") / BLOCK).alias("slots"))
    dealt = rows.select("id", "lat", "lon").join(sizes, ["lat", "lon"]).withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")))
    # A list of lists keeps null ids.
    return dealt.groupBy("lat", "lon", "slot").agg(F.flatten(F.collect_list(F.array("id"))).alias("ids")).drop("slot")


def near_ids(left: DataFrame, right: DataFrame, digits: int, metres: float = MATCH_M, grid: float = MATCH_GRID) -> DataFrame:
    """(a, b, d) of near_pairs(), d to so many digits.

    All pairs are rows of the result, which grows with the square of a town. So points meet
    with their ids, a distance is measured and rounded once for the two, and only there
    ids become rows, in many tasks.
    """
    spark = left.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    a, b = (x.repartition(tasks, "fy", "fx") for x in _squares(_folded(left), _folded(right), metres, grid))
    points = _met(a, b.hint("merge"), [], metres).select("ids", "ids_b", F.round("d", digits).alias("d"))
    return points.select(F.explode("ids").alias("a"), "ids_b", "d").select("a", F.explode("ids_b").alias("b"), "d")


def alike(pairs: DataFrame, least: float = MATCH_SIMILARITY) -> DataFrame:
    """near_pairs() with `sim`, 0 where names can't reach `least`."""
    return pairs.withColumn("sim", similarity(F.col("name_a"), F.col("name_b"), least, F.col("mask_a"), F.col("mask_b")))


def alike_names(left: DataFrame, right: DataFrame, least: float = MATCH_SIMILARITY, grid: float = MATCH_GRID) -> DataFrame:
    """(name, other, sim): the names of left and right that are alike and met in neighbouring squares of the grid, each pair once."""
    gy, gx = F.floor(F.col("lat") / grid), F.floor(F.col("lon") / grid)
    a = left.select("name", gy.alias("gy"), gx.alias("gx")).distinct()
    a = a.select("name", letter_mask(F.col("name")).alias("mask"), F.explode(geo.neighbours(F.col("gy") + 0.5, F.col("gx") + 0.5, 1)).alias("q")).select("name", "mask", "q.*").distinct()
    b = right.select(F.col("name").alias("other"), gy.alias("gy"), gx.alias("gx")).distinct().withColumn("mask_b", letter_mask(F.col("other")))
    sides = F.col("name"), F.col("other"), least, F.col("mask"), F.col("mask_b")
    # Masks as results of the grouping: a filter on the measure doesn't move below it, to all squares.
    met = a.join(b, ["gy", "gx"]).where(may_reach(*sides)).groupBy("name", "other").agg(F.max("mask").alias("mask"), F.max("mask_b").alias("mask_b"))
    return met.withColumn("sim", similarity(*sides)).where(F.col("sim") >= least).select("name", "other", "sim")


def mutual_matches(left: DataFrame, right: DataFrame, least: float = MATCH_SIMILARITY, metres: float = MATCH_M, grid: float = MATCH_GRID) -> DataFrame:
    """(a, b, d, sim): mutual_best() of all pairs of left and right (id, lat, lon, name) within metres.

    Of places of a side with one name at one point only the smallest id can be of a pair,
    so these meet. A place with its own name nearby has its best partner there; only the
    others look for names alike, compared once, as far as metres.
    """
    one = lambda rows: rows.groupBy("name", "lat", "lon").agg(F.min("id").alias("id"))

    def best(asked: DataFrame, reach: float) -> DataFrame:
        met = _met(*_squares(asked, there, reach, grid), ["other"], reach)
        return best_per(met.select(F.col("id").alias("a"), F.col("id_b").alias("b"), "d", "sim").where(F.col("sim") >= least), "a", "b")

    here, there = one(left), one(right).withColumnRenamed("name", "other")
    close = best(here.select("*", F.col("name").alias("other"), F.lit(1.0).alias("sim")), metres / FINER)
    others = here.join(close.select(F.col("a").alias("id")), "id", "left_anti")
    far = best(others.join(alike_names(left, right, least, grid), "name"), metres)
    return best_per(close.unionByName(far), "b", "a")


def best_per(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """The most similar, then nearest, pair of each key; ties by the other side's id."""
    w = Window.partitionBy(key).orderBy(F.desc("sim"), F.col("d"), F.col(other))
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).drop("r")


def mutual_best(pairs: DataFrame, least: float = MATCH_SIMILARITY) -> DataFrame:
    """One to one: the best partner of each a, then of those pairs the best of each b.

    Not symmetric: a b sees only the pairs that some a has chosen.
    """
    return best_per(best_per(pairs.where(F.col("sim") >= least), "a", "b"), "b", "a")


def match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): mutual best matches of named places within the matching distance."""
    return mutual_matches(left.where("name <> ''"), right.where("name <> ''")).select("a", "b")


def merge_sources(first: DataFrame, second: DataFrame, pairs: DataFrame) -> DataFrame:
    """Places of both sources, a matched pair once.

    first and second: (id, lat, lon, name, cat, conf, diet); pairs (a: second's id,
    b: first's id). A matched place keeps the first source's fields and the second's
    diet. A place of the second source alone has confidence 60; its kind's top is
    that of the first source's places of the category.
    """
    # Both ends of a pair as rows, so that one join marks the places of both sources and pairs are made once.
    fields = ["id", "lat", "lon", "name", "cat", "conf", "diet"]
    ends = pairs.select(F.explode(F.array(
        F.struct(F.lit(True).alias("mine"), F.col("b").alias("id"), F.col("a").alias("other")),
        F.struct(F.lit(False).alias("mine"), F.col("a").alias("id"), F.col("b").alias("other")),
    )).alias("x")).select("x.*")
    every = first.select(*fields, F.lit(True).alias("mine")).unionByName(second.select(*fields, F.lit(False).alias("mine")))
    extra = second.select(F.lit(True).alias("mine"), F.col("id").alias("other"), F.col("diet").alias("other_diet"))
    # A place of the second source that is of a pair is in the first's row.
    marked = every.join(ends, ["mine", "id"], "left").where(F.col("mine") | F.col("other").isNull()).join(extra, ["mine", "other"], "left")
    alone = lambda of_second, of_first: F.when(F.col("mine"), of_first).otherwise(of_second).cast("long")
    return marked.select(
        "id", "lat", "lon", "name", "cat", alone(F.lit(60), F.col("conf")).alias("conf"), alone(F.col("diet"), F.coalesce("other_diet", F.lit(0))).alias("diet"),
        alone(F.lit(FROM_SECOND), F.lit(FROM_FIRST) + F.when(F.col("other").isNull(), 0).otherwise(FROM_SECOND)).alias("sources"),
    )


def fold_duplicates(places: DataFrame, per_degree: int = FOLD_PER_DEGREE) -> DataFrame:
    """One place per name, kind and square of about 300 m: the most certain, with all sources and diets."""
    key = F.lower(F.regexp_replace(F.trim("name"), r"\s+", " "))
    square = [F.round(F.col(c) * per_degree).cast("long").alias(n) for c, n in (("lat", "gy"), ("lon", "gx"))]
    keyed = places.select("*", key.alias("nk"), *square)
    group = ["nk", "gy", "gx", "top"]
    best = keyed.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("conf"), F.col("pid")))).where("r = 1")
    summed = keyed.groupBy(*group).agg(F.bit_or("diet").alias("all_diet"), F.bit_or("sources").alias("all_sources"), F.count("*").alias("copies"))
    return best.join(summed, group).select(
        *[c for c in places.columns if c not in ("diet", "sources")], F.col("all_diet").alias("diet"),
        F.col("all_sources").alias("sources"), "copies",
    )


def lone_branches(places: DataFrame, vegan_cat: str, least: int = 3) -> DataFrame:
    """(pid, usual): branches filed as vegan whose business mostly isn't, and its usual category.

    places (pid, name, biz, cat, diet). A business of `least` branches, fewer than a
    third of them vegan; the usual category is the most frequent other, ties by
    name. A branch tagged vegan only, or with vegan in its name, stays.
    """
    only = F.col("diet").bitwiseAND(VEGAN["only"]) != 0
    sizes = places.groupBy("biz").agg(F.count("*").alias("n"), F.count_if((F.col("cat") == vegan_cat) | only).alias("veg")).where(F.col("n") >= least)
    counts = places.where(F.col("cat") != vegan_cat).groupBy("biz", "cat").agg(F.count("*").alias("k"))
    usual = counts.groupBy("biz").agg(F.min(F.struct((-F.col("k")).alias("k"), "cat")).alias("best")).select("biz", F.col("best.cat").alias("usual"))
    wrong = (F.col("cat") == vegan_cat) & ~only & (F.col("veg") * 3 < F.col("n")) & ~F.col("name").rlike(VEGAN_WORDS)
    return places.join(sizes, "biz").where(wrong).join(usual, "biz", "left").select("pid", F.coalesce("usual", F.lit("restaurant")).alias("usual"))


def correct_branches(places: DataFrame, vegan_cat: str) -> DataFrame:
    """places with lone_branches() filed as their business is, and marked as serving vegan food."""
    fixed = lone_branches(places, vegan_cat)
    return places.join(fixed, "pid", "left").withColumns({
        "cat": F.coalesce("usual", "cat"),
        "diet": F.when(F.col("usual").isNull(), F.col("diet")).otherwise(F.col("diet").bitwiseOR(VEGAN["yes"])),
    }).drop("usual")


def name_spread(places: DataFrame, per_degree: int = 10) -> DataFrame:
    """(n, more_only, cells): in how many grid cells each name is found, among all places and among the earlier kinds."""
    cell = F.floor(F.col("lat") * per_degree) * 400 * per_degree + F.floor(F.col("lon") * per_degree)
    both = places.select(F.lower(F.trim("name")).alias("n"), cell.alias("cell"), "more", F.explode(F.array(F.lit(False), F.lit(True))).alias("more_only"))
    return both.where("more_only or not more").groupBy("n", "more_only").agg(F.count_distinct("cell").alias("cells"))


def qualified_titles(names: DataFrame, titles: DataFrame, qualifiers: list[str]) -> DataFrame:
    """names (pid, n) met by titles (t, aid) `name (qualifier)`: a join on the title's own parts, not on a pattern.

    All pairs of a name are rows of the result, so a frequent name is far more of them than of the
    input. Titles of one name and qualifier are folded to blocks, a name is dealt to each block of its
    own, and only there pairs become rows: a row of the join is a block, in many tasks.
    """
    parts = titles.select(
        "aid", F.regexp_extract("t", r"^(.*) \([^)]*\)$", 1).alias("n"), F.regexp_extract("t", r" \(([^)]*)\)$", 1).alias("qualifier")
    ).where(F.col("qualifier").isin(qualifiers))
    key = ["n", "qualifier", "slot"]
    sizes = parts.groupBy("n", "qualifier").agg(F.ceil(F.count("*") / BLOCK).alias("slots"))
    dealt = parts.join(sizes, ["n", "qualifier"]).withColumn("slot", F.pmod(F.xxhash64("aid"), F.col("slots")))
    # A list of lists keeps null ids.
    blocks = dealt.groupBy(*key).agg(F.flatten(F.collect_list(F.array("aid"))).alias("aids"))
    asked = names.select("pid", "n").join(sizes, "n").select("pid", "n", "qualifier", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    spark = names.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Merged, names first: a task then holds one block's rows of one name, never those of all names of a block.
    met = asked.repartition(tasks, *key).join(blocks.repartition(tasks, *key).hint("merge"), key)
    return met.select("pid", F.explode("aids").alias("aid"), "qualifier")


def fame(candidates: DataFrame, places: DataFrame, kinds: DataFrame, articles: DataFrame, within_km: float = 10.0) -> DataFrame:
    """(pid, views, title): the most viewed article of a place's own name, of its kind and, where it says, its place.

    candidates (pid, aid), places (pid, lat, lon, top), kinds (aid, kind, alat, alon), articles (aid, title, views).
    """
    kind = F.when(F.col("top") == "food_and_drink", "food").when(F.col("top") == "lodging", "lodging").otherwise("other")
    km = F.sqrt(
        F.pow((F.col("lat") - F.col("alat")) * (geo.BUILD_LAT_M / 1000), F.lit(2))
        + F.pow((F.col("lon") - F.col("alon")) * (geo.BUILD_LON_M / 1000) * F.cos(F.radians("lat")), F.lit(2))
    )
    met = candidates.join(places, "pid").join(kinds, "aid").join(articles, "aid")
    good = met.where((F.col("kind") == kind) & (F.col("alat").isNull() | (km <= within_km)))
    return good.groupBy("pid").agg(
        F.max("views").alias("views"), F.max_by("title", F.struct("views", "title")).alias("title")
    )


def guide_match(listings: DataFrame, places: DataFrame, grid: float = GUIDE_GRID) -> DataFrame:
    """(lid, pid): the place that a guide's listing names.

    listings (lid, name, full, section, digits, lat, lon, radius_km), places (pid,
    name, full, street, top, lat, lon); name is the core name, full the whole.
    Blocks are the squares within the radius and the first three letters; then the
    section must fit the kind and the names be alike. Ranked by equal names,
    house number, one name's words in the other's, similarity, distance; a doubtful
    best is kept only if it stands alone.

    Names are compared once a pair that meets in a block; listings and places then meet
    by the names that may be of one place.
    """
    span = F.ceil(F.col("radius_km") / 5.5)
    gy, gx = F.floor(F.col("lat") / grid), F.floor(F.col("lon") / grid)
    kind = F.when(F.col("section") == "Sleep", "lodging").when(F.col("section").isin("Eat", "Drink"), "food_and_drink").otherwise("other")
    there = places.where("name <> ''").select(
        "pid", F.col("name").alias("b"), F.col("full").alias("fb"), F.regexp_extract_all("street", F.lit(r"(\d+)"), F.lit(1)).alias("street_numbers"),
        F.when(F.col("top").isin("lodging", "food_and_drink"), F.col("top")).when(F.col("top").isNotNull(), "other").alias("kind"),
        F.col("lat").alias("plat"), F.col("lon").alias("plon"), gy.alias("gy"), gx.alias("gx"),
    )
    asked = listings.where("name <> ''").select(
        "lid", F.col("name").alias("a"), F.col("full").alias("fa"), kind.alias("kind"), "digits", "lat", "lon", "radius_km",
        F.explode(F.sequence(gy - span, gy + span)).alias("gy"), gx.alias("gx0"), span.alias("span")
    ).withColumn("gx", F.explode(F.sequence(F.col("gx0") - 2 * F.col("span"), F.col("gx0") + 2 * F.col("span")))).drop("gx0", "span")
    # Squares and kinds without a place go before a listing meets names.
    asked = asked.join(there.select("gy", "gx", "kind").distinct(), ["gy", "gx", "kind"], "left_semi")
    a, b = F.col("a"), F.col("b")
    # Full names in structs, so that null ones meet too.
    named = guide_names(asked, there).select("a", F.struct("fa").alias("fa"), "b", F.struct("fb").alias("fb"), "same", "subset", "jw", "enough")
    met = asked.withColumn("fa", F.struct("fa")).join(named, ["a", "fa"]).join(there.withColumn("fb", F.struct("fb")), ["gy", "gx", "kind", "b", "fb"])
    km = F.sqrt(
        F.pow((F.col("plat") - F.col("lat")) * 110.54, F.lit(2)) + F.pow((F.col("plon") - F.col("lon")) * 111.32 * F.cos(F.radians("lat")), F.lit(2))
    )
    number = F.coalesce((F.col("digits") != "") & F.arrays_overlap(F.split("digits", " "), "street_numbers"), F.lit(False))
    met = met.withColumn("km", km).where(F.col("km") <= F.col("radius_km")).withColumn("num", number).where(F.col("enough") | F.col("num"))
    # The first in order, as the least of structs: what counts by being true comes negated.
    order = F.struct((~(F.col("same") | (a == b))).alias("a"), (~F.col("num")).alias("b"), (~F.col("subset")).alias("c"), (-F.col("jw")).alias("d"), F.col("km").alias("e"), F.col("pid").alias("pid"))
    sure = F.col("num") | F.col("same") | ((a == b) & (F.length(a) >= 6)) | F.col("subset")
    best = met.select("lid", F.struct(order.alias("o"), sure.alias("sure")).alias("x")).groupBy("lid").agg(F.min("x").alias("x"), F.count("*").alias("n"))
    return best.where((F.col("n") == 1) | F.col("x.sure")).select("lid", F.col("x.o.pid").alias("pid"))


def guide_names(asked: DataFrame, there: DataFrame) -> DataFrame:
    """(a, fa, b, fb, same, subset, jw, enough): names of listings and places that may be of one place: alike `enough`, or if the house number agrees.

    asked (a, fa, gy, gx, kind) and there (b, fb, gy, gx, kind): core and full names in their blocks.
    """
    split = lambda x: F.split(x, " ")
    a, fa, b, fb = (F.col(x) for x in ("a", "fa", "b", "fb"))
    block = ["gy", "gx", "kind", "p3"]
    ours = asked.select("a", "fa", "gy", "gx", "kind").distinct().select(
        "*", F.substring("a", 1, 3).alias("p3"), letter_mask(a).alias("mask"), split("fa").alias("words"), letter_mask(fa).alias("full_mask")
    )
    theirs = there.select("b", "fb", "gy", "gx", "kind").distinct().select(
        "*", F.substring("b", 1, 3).alias("p3"), letter_mask(b).alias("b_mask"), split("fb").alias("b_words"), letter_mask(fb).alias("fb_mask")
    )
    lacks = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))) == 0
    holds = lambda x, y: F.size(F.array_except(y, x)) == 0
    # Words within words need letters within letters, which costs two instructions.
    within = (lacks(F.col("fb_mask"), F.col("full_mask")) & holds(F.col("words"), F.col("b_words"))) | (
        lacks(F.col("full_mask"), F.col("fb_mask")) & holds(F.col("b_words"), F.col("words"))
    )
    # What neither holds the other's words nor can be alike enough goes before similarity is measured, in Python, on the rest.
    near = most_alike(b, a, F.col("b_mask"), F.col("mask")) >= 0.88
    met = ours.join(theirs, block).withColumn("same", F.coalesce(fa == fb, F.lit(False))).withColumn("within", F.coalesce(within, F.lit(False))).where(F.col("same") | (a == b) | near | F.col("within"))
    subset = (F.size("words") >= 2) & (F.size("b_words") >= 2) & F.col("within")
    pairs = met.select("a", "fa", "b", "fb", "same", subset.alias("subset")).distinct().withColumn("jw", jaro_winkler(b, a))
    enough = F.col("same") | ((a == b) & (F.length(a) >= 4)) | ((F.col("jw") >= 0.95) & (F.length(a) >= 6)) | F.col("subset")
    return pairs.withColumn("enough", enough).where(F.col("enough") | (F.col("jw") >= 0.88))


def static_rank(sources: Column, conf: Column, chain: Column, website: Column, fame_views: Column) -> Column:
    """The part of a place's score that no question changes, times 100."""
    bit = lambda b: sources.bitwiseAND(b) != 0
    flag = lambda c, n: F.when(c, n).otherwise(0)
    return (
        conf + flag(bit(FROM_GUIDE), 150) + flag(bit(FROM_FIRST) & bit(FROM_SECOND), 50) + flag(website.isNotNull(), 20)
        - flag(chain, 100) + F.bround(geo.fame_bonus(fame_views) * 100).cast("long")
    )


def diet_tier(diet: Column, cat: Column, name: Column) -> Column:
    """0: a vegan place, 1: vegetarian, 2: has vegan options, 3: limited, null: none, for a vegan question."""
    bit = lambda b: diet.bitwiseAND(b) != 0
    return (
        F.when(bit(VEGAN["only"]) | (cat == "vegan_restaurant") | name.rlike(VEGAN_WORDS), 0)
        .when(bit(VEGAN["no"]), None)
        .when(bit(VEGETARIAN["only"]) | (cat == "vegetarian_restaurant"), 1)
        .when(bit(VEGAN["yes"]), 2)
        .when(bit(VEGAN["limited"]) | bit(VEGETARIAN["yes"]), 3)
    )


def score(place_rank: Column, km: Column, radius_km: Column) -> Column:
    """A candidate's score: its static rank less up to 0.6 for distance."""
    return place_rank / 100.0 - 0.6 * F.least(km / F.greatest(radius_km, F.lit(1.0)), F.lit(1.0))


def question_score(place_rank: Column, km: Column, radius_km: Column, hours: Column, late: Column, tier: Column, price: Column) -> Column:
    """score() with a point for hours past ten at night where the question asks for them, and one for the guide's price tier."""
    open_late = late & F.coalesce(hours.rlike(r"24/7|-\s*(2[2-4]|0[0-5])[:.]"), F.lit(False))
    priced = F.coalesce(tier.startswith(price), F.lit(False))
    return score(place_rank, km, radius_km) + open_late.cast("int") + priced.cast("int")


def with_cells(places: DataFrame) -> DataFrame:
    return places.withColumn("cell", geo.cell_of(F.col("lat"), F.col("lon")))


def within(asks: DataFrame, places: DataFrame) -> DataFrame:
    """asks (ask, lat, lon, radius_km) with each place (with cell) in the circle, and km. Cells join, then distance decides."""
    spread = asks.select(
        "ask", F.col("lat").alias("alat"), F.col("lon").alias("alon"), "radius_km",
        F.explode(geo.cells_around(F.col("lat"), F.col("lon"), F.col("radius_km"))).alias("cell"),
    )
    km = geo.lookup_distance_km(F.col("alat"), F.col("alon"), F.col("lat"), F.col("lon"))
    # Asks are few beside places: their cells are counted, and sent to all tasks where they fit the bound.
    spread = F.broadcast(spread) if spread.count() <= BROADCAST_ROWS else spread
    return places.join(spread, "cell").withColumn("km", km).where(F.col("km") <= F.col("radius_km")).drop("alat", "alon", "cell")


def candidates(found: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best `most` places of each ask by static rank, ties by id; capped: as many came back."""
    w = Window.partitionBy("ask").orderBy(F.desc("rank"), F.col("pid"))
    cut = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
    return cut.withColumn("capped", F.count("*").over(Window.partitionBy("ask")) == most)


def widening(asks: DataFrame, places: DataFrame, radii: tuple[float, ...] = WIDENING_KM, enough: int = ENOUGH) -> DataFrame:
    """(ask, radius_km, total): the first radius with enough places, else the last. All radii are counted in one pass."""
    widest = within(asks.withColumn("radius_km", F.lit(float(max(radii)))), places)
    counts = widest.groupBy("ask").agg(*[F.count_if(F.col("km") <= r).alias(f"r{i}") for i, r in enumerate(radii)])
    full = asks.select("ask").join(counts, "ask", "left").na.fill(0)
    pick = None
    for i, r in enumerate(radii[:-1]):
        hit = F.col(f"r{i}") >= enough
        value = F.struct(F.lit(float(r)).alias("radius_km"), F.col(f"r{i}").alias("total"))
        pick = F.when(hit, value) if pick is None else pick.when(hit, value)
    last = F.struct(F.lit(float(radii[-1])).alias("radius_km"), F.col(f"r{len(radii) - 1}").alias("total"))
    return full.select("ask", (last if pick is None else pick.otherwise(last)).alias("p")).select("ask", "p.*")


def city_radii(radius_km: Column) -> Column:
    """The radii to try around a city, widest last: its own, twice and four times that, 50 km at most."""
    return F.array(*[F.least(radius_km * m, F.lit(CITY_MOST_KM)) for m in CITY_WIDEN])


def widening_each(asks: DataFrame, places: DataFrame, steps: int = len(CITY_WIDEN), enough: int = 1) -> DataFrame:
    """(ask, radius_km, total): widening() with each ask's own `radii` (at most `steps`, growing) instead of one list for all."""
    widest = within(asks.withColumn("radius_km", F.array_max("radii")), places).select("ask", "km").join(asks.select("ask", "radii"), "ask")
    counts = widest.groupBy("ask").agg(F.array(*[F.count_if(F.col("km") <= F.get("radii", F.lit(i))) for i in range(steps)]).alias("counts"))
    full = asks.select("ask", "radii").join(counts, "ask", "left")
    count = lambda i: F.coalesce(F.get("counts", i), F.lit(0))
    tried = F.transform("radii", lambda r, i: F.struct(r.alias("radius_km"), count(i).alias("total")))
    first = F.get(F.filter(tried, lambda t: t["total"] >= enough), F.lit(0))
    return full.select("ask", F.coalesce(first, F.element_at(tried, -1)).alias("p")).select("ask", "p.*")


def without_crypto(found: DataFrame) -> DataFrame:
    """found (kind, question, name, ...) without cryptocurrency machines where cash is asked for and the question doesn't name them."""
    return found.where(~((F.col("kind") == "money") & ~F.col("question").rlike(CRYPTO) & F.col("name").rlike(CRYPTO)))


def hinted(candidates_: DataFrame, rest: DataFrame, region_names: DataFrame) -> DataFrame:
    """(ask, city): of each ask's candidate cities those in the country or region that words after the city's name say; all if none does.

    candidates_ (ask, city, country, region), rest (ask, words): the words after the
    name, region_names (key, country, region; region '' for a country). Runs of
    words are tried from the first word on, longer ones first; the first that names
    the place of some candidate decides.
    """
    n = F.size("words")
    run = lambda i, j: F.struct(i.alias("start"), (-j).alias("less"), F.array_join(F.slice("words", i + 1, j - i), " ").alias("key"))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: run(i, j))))
    said = rest.where(n > 0).select("ask", F.explode(runs).alias("run")).select("ask", "run.start", "run.less", "run.key")
    named = said.join(region_names.select("key", F.col("country").alias("in_country"), F.col("region").alias("in_region")), "key")
    met = candidates_.join(named, "ask").where((F.col("country") == F.col("in_country")) & ((F.col("in_region") == "") | (F.col("in_region") == F.col("region"))))
    place = F.struct("start", "less")
    first = met.groupBy("ask").agg(F.min(place).alias("first"))
    chosen = met.join(first, "ask").where(place == F.col("first")).select("ask", "city").distinct()
    return chosen.union(candidates_.join(first, "ask", "left_anti").select("ask", "city"))


def diversify(ranked, limit: int = 12, per_name: int = 2):
    """Greedy choice from an ask's candidates (a pandas frame in rank order): at most per_name of a name, one of a chain,
    and none within 1 km of a chosen one whose words its name has or shares."""
    chosen, names = [], {}
    for row in ranked.itertuples():
        words = set(row.name.lower().split())
        key = " ".join(row.name.lower().split())
        if names.get(key, 0) >= (1 if row.chain else per_name):
            continue
        twin = any(
            (words <= w or w <= words) and ((row.lat - lat) * 111.2) ** 2 + ((row.lon - lon) * 85.0) ** 2 <= 1.0 and n != key
            for w, lat, lon, n in chosen
        )
        if twin:
            continue
        names[key] = names.get(key, 0) + 1
        chosen.append((words, row.lat, row.lon, key))
        yield row.Index
        if len(chosen) == limit:
            return


def diversified(ranked: DataFrame, limit: int = 12) -> DataFrame:
    """diversify() of each ask's candidates, which candidates() has bounded."""

    def run(pdf):
        pdf = pdf.sort_values(["score", "pid"], ascending=[False, True])
        return pdf.loc[list(diversify(pdf, limit))]

    return ranked.groupBy("ask").applyInPandas(run, ranked.schema)


def largest_city(cities: DataFrame, by: list[str]) -> DataFrame:
    """The most populous city of each region and the region's population; ties by id."""
    best = F.max(F.struct("population", (-F.col("city")).alias("k"), "name")).alias("best")
    return cities.groupBy(*by).agg(F.coalesce(F.sum("population"), F.lit(0)).alias("total"), best).select(
        *by, "total", (-F.col("best.k")).alias("city"), F.col("best.name").alias("name"), F.col("best.population").alias("population")
    )


def country_city(cities: DataFrame, factor: float = 2.0, need_capital: bool = False) -> DataFrame:
    """The city a country's name stands for: its capital, unless the largest is over `factor` times as populous.

    A country without a capital has its largest city, or with need_capital none.
    """
    top = largest_city(cities, ["country"]).select("country", F.col("city").alias("big"), F.col("population").alias("big_pop"))
    capital = cities.where("capital").groupBy("country").agg(F.min(F.struct("city", "population")).alias("c"))
    joined = top.join(capital, "country", "left")
    use_big = F.col("c").isNull() | (F.col("big_pop") > factor * F.col("c.population"))
    joined = joined.where(F.col("c").isNotNull()) if need_capital else joined
    return joined.select("country", F.when(use_big, F.col("big")).otherwise(F.col("c.city")).alias("city"))


def locate(candidates_: DataFrame, city_names: DataFrame, factor_primary: float = 3.0, factor_capital: float = 5.0) -> DataFrame:
    """(ask, city): of each ask's candidate texts (ask, place, key) the first that names a city, the heaviest of that name.

    city_names (key, city, population, primary, capital); weight is the population, times 3 for a primary name, 5 for a capital.
    """
    weight = F.col("population") * F.when(F.col("primary"), factor_primary).otherwise(1.0) * F.when(F.col("capital"), factor_capital).otherwise(1.0)
    met = candidates_.join(city_names, "key")
    best = F.min(F.struct("place", (-weight).alias("w"), "city")).alias("best")
    return met.groupBy("ask").agg(best).select("ask", F.col("best.city").alias("city"))
