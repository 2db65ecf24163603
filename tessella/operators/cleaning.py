"""Small transformations of places, documents and records that builders and reports share."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.names import norm_key

#: Categories by tag, tags' diet bits, and document weights by status.
AMENITIES = {
    "restaurant": "restaurant", "cafe": "cafe", "fast_food": "fast_food_restaurant", "bar": "bar", "pub": "pub", "biergarten": "beer_garden",
    "ice_cream": "ice_cream_shop", "food_court": "food_court", "pharmacy": "pharmacy", "atm": "atm", "bureau_de_change": "currency_exchange",
}
SHOPS = {"bakery": "bakery", "pastry": "patisserie", "confectionery": "candy_store", "deli": "delicatessen", "ice_cream": "ice_cream_shop"}
DIET_TAGS = {
    "vegan": {"only": 1, "yes": 2, "limited": 4, "no": 8}, "vegetarian": {"only": 16, "yes": 32, "limited": 64},
    "gluten_free": {"only": 128, "yes": 128}, "halal": {"only": 256, "yes": 256}, "kosher": {"only": 512, "yes": 512},
}
LEAST_SURE, LEAST_SURE_OTHER = 0.3, 0.5


def wanted_places(rows: DataFrame, tops: list[str], travel: list[str], more: list[str]) -> DataFrame:
    """Rows of a nested places table that are wanted, flattened, with `more`: wanted only for the later categories.

    A place to eat or sleep needs a confidence of 0.3, others 0.5; closed ones and
    those without a name go. Conditions on nested fields reach the scan.
    """
    hier, sure = F.col("taxonomy.hierarchy"), F.col("confidence")
    array = lambda names: F.array(*[F.lit(n) for n in names])
    early = (F.get(hier, F.lit(0)).isin(*tops) & (sure >= LEAST_SURE)) | (F.arrays_overlap(hier, array(travel)) & (sure >= LEAST_SURE_OTHER))
    late = F.arrays_overlap(hier, array(more)) & (sure >= LEAST_SURE_OTHER)
    early, late = F.coalesce(early, F.lit(False)), F.coalesce(late, F.lit(False))
    open_ = F.coalesce("operating_status", F.lit("")) != "permanently_closed"
    named = F.col("names.primary").isNotNull() & (F.length(F.trim("names.primary")) > 1)
    one = lambda c: F.get(F.col(c), F.lit(0))
    return rows.where((early | late) & open_ & named).select(
        "id", F.col("names.primary").alias("name"), F.col("taxonomy.primary").alias("cat"), hier.alias("hier"), sure.alias("conf"),
        ((F.col("bbox.ymin") + F.col("bbox.ymax")) / 2).alias("lat"), ((F.col("bbox.xmin") + F.col("bbox.xmax")) / 2).alias("lon"),
        one("addresses")["freeform"].alias("street"), one("addresses")["locality"].alias("locality"), clean_website(one("websites")).alias("website"),
        one("phones").alias("phone"), F.col("brand.names.primary").alias("brand"), (~early).alias("more"),
    )


def clean_website(url: Column) -> Column:
    """Without scheme, www. and final slashes, at most 100 characters; null if nothing is left."""
    return F.nullif(F.substring(F.regexp_replace(F.regexp_replace(F.trim(url), r"^https?://(www\.)?", ""), "/+$", ""), 1, 100), F.lit(""))


def tagged_category(amenity: Column, shop: Column, cuisine: Column, vegan: Column, vegetarian: Column, known: list[str]) -> Column:
    """A tagged object's category: of its diet, of a known cuisine, or of its kind."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    cuisines = F.transform(F.split(F.replace(F.lower(F.coalesce(cuisine, F.lit(""))), F.lit(","), F.lit(";")), ";"), lambda c: F.trim(c))
    eats = amenity.isin("restaurant", "fast_food", "cafe")
    has = lambda name, tag: eats & (F.array_contains(cuisines, name) | F.coalesce(tag == "only", F.lit(False)))
    named = F.get(F.filter(F.transform(cuisines, lambda c: F.concat(c, F.lit("_restaurant"))), lambda c: c.isin(*known)), F.lit(0))
    base = F.coalesce(F.element_at(table(AMENITIES), amenity), F.element_at(table(SHOPS), shop))
    plain = F.when(base.isin(*known), base).when(amenity.isin("pharmacy", "atm", "bureau_de_change"), None)
    return F.when(base.isNull(), None).when(has("vegan", vegan), "vegan_restaurant").when(has("vegetarian", vegetarian), "vegetarian_restaurant").when(
        (amenity == "restaurant") & named.isNotNull(), named
    ).otherwise(plain.otherwise(F.when(amenity.isNotNull(), "restaurant").otherwise("food_and_drink")))


def diet_bits(tags: dict[str, Column]) -> Column:
    """Diet bits of tag values, by tag name."""
    bits = F.lit(0)
    for name, column in tags.items():
        values = F.create_map(*[F.lit(x) for kv in DIET_TAGS[name].items() for x in kv])
        bits = bits.bitwiseOR(F.coalesce(F.element_at(values, F.lower(column)), F.lit(0)))
    return bits


def city_keys(cities: DataFrame, least: int = 15_000) -> DataFrame:
    """(key, city): names that a question may use for a city; alternates only of larger cities, in Latin script, 2 to 40 long."""
    latin = F.filter(F.split(F.coalesce("alternates", F.lit("")), ","), lambda a: (a != "") & ~a.rlike(r"[^\x{0}-\x{24F}]"))
    extra = F.when(F.col("population") >= least, latin).otherwise(F.array().cast("array<string>"))
    main = cities.select("city", F.explode(F.array("name", "ascii")).alias("said"), F.lit(False).alias("alternate"))
    every = main.unionByName(cities.select("city", F.explode(extra).alias("said"), F.lit(True).alias("alternate")))
    keyed = every.select(norm_key("said").alias("key"), "city", "alternate").where("key <> ''")
    return keyed.where(~F.col("alternate") | F.length("key").between(2, 40)).select("key", "city").distinct()


def unique_titles(documents: DataFrame) -> DataFrame:
    """documents (doc, title, source, text) with repeated titles numbered by source, in the text's title line too."""
    w = Window.partitionBy("title").orderBy("doc")
    numbered = documents.withColumn("i", F.row_number().over(w))
    new = F.when(F.col("i") > 1, F.concat("title", F.lit(" ("), "source", F.lit(", "), F.col("i").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    body = F.regexp_replace("text", r"(?s)^# [^\n]*", "")
    text = F.when((F.col("i") > 1) & F.col("text").startswith("# "), F.concat(F.lit("# "), new, body)).otherwise(F.col("text"))
    return numbered.withColumns({"title": new, "text": text}).drop("i")


def weighted_documents(documents: DataFrame, weights: dict[str, int], other: int = 100) -> DataFrame:
    """documents with views: a weight by status in place of a popularity."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return documents.withColumn("views", F.coalesce(F.element_at(table, F.lower("status")), F.lit(other)))


def clip(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last space beyond half of it, with an ellipsis."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.when(F.length(cut) > limit // 2, cut).otherwise(head)), F.lit("…")))


def with_expectation(questions: DataFrame, expectations: DataFrame) -> DataFrame:
    """questions with `expected`: what is expected, else what is checked."""
    return questions.join(expectations, "id", "left").withColumn("expected", F.coalesce(F.nullif(F.col("expect"), F.lit("")), F.col("check")))


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """parents with `children`: their rows' fields in order, an empty array if none."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias("children"))
    kind = listed.schema["children"].dataType
    return parents.join(listed, key, "left").withColumn("children", F.coalesce("children", F.array().cast(kind)))


def joined_entries(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, entry): entries of lists in lines, split at ` | `; one without ` — ` goes on in the next piece."""
    pieces = lines.select(group, order, F.posexplode(F.split(text, r" \| ")).alias("k", "piece"))
    w = Window.partitionBy(group).orderBy(order, "k")
    ended = F.coalesce(F.lag(F.col("piece").contains(" — ")).over(w), F.lit(True))
    numbered = pieces.withColumn("entry", F.sum(ended.cast("int")).over(w))
    listed = F.sort_array(F.collect_list(F.struct(order, "k", "piece")))
    return numbered.groupBy(group, "entry").agg(F.array_join(F.transform(listed, lambda p: p["piece"]), " | ").alias("text"))


def _shared(left: list, right: list) -> int:
    """How long the longest end of left is that right starts with: right's failure function, then one pass over left's end."""
    if not left or not right:
        return 0
    border, k = [0] * len(right), 0
    for i in range(1, len(right)):
        while k and right[i] != right[k]:
            k = border[k - 1]
        k += right[i] == right[k]
        border[i] = k
    k = 0
    for item in left[-len(right) :]:
        while k and (k == len(right) or item != right[k]):
            k = border[k - 1]
        k += item == right[k]
    return k


def merged_lists(left: list, right: list) -> list:
    """Two overlapping windows of one list as one: the longest end of the first that starts the second is shared. Linear in both."""
    return left + right[_shared(left, right) :]


@F.pandas_udf(T.ArrayType(T.StringType()))
def merged_windows(windows: pd.Series) -> pd.Series:
    """Ordered windows (an array of arrays of strings) as the one list they are windows of; nulls are passed over."""
    return windows.map(lambda ws: reduce(merged_lists, [list(w) for w in (ws if ws is not None else []) if w is not None], []), na_action=None)


def lists_of_windows(rows: DataFrame, key: str, order: str, window: str) -> DataFrame:
    """(key, items): of each key the list that its windows, in order, overlap to. A key's windows are one array: a screen's, or a page's."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(window).alias("w"))))
    ordered = rows.groupBy(key).agg(F.transform(listed, lambda x: x["w"]).alias("windows"))
    return ordered.select(key, merged_windows("windows").alias("items"))


def run_title(model: Column, rates: Column) -> Column:
    """A run's name: the model's initial and its rates, best first."""
    said = F.array_join(F.transform(F.reverse(F.array_sort(rates)), lambda r: F.format_number(r, 1)), ", ")
    return F.concat(F.upper(F.substring(model, 1, 1)), F.lit(" "), said, F.lit(" tok/s"))


def cpu_shares(samples: DataFrame, by: list[str]) -> DataFrame:
    """Busy share of each group of cores between the first and last sample: (by..., core, t, busy, total), cumulative."""
    per = samples.groupBy(*by, "core").agg(
        (F.max_by("busy", "t") - F.min_by("busy", "t")).alias("b"), (F.max_by("total", "t") - F.min_by("total", "t")).alias("n")
    )
    return per.groupBy(*by).agg(F.when(F.sum("n") > 0, F.sum("b") / F.sum("n")).otherwise(0.0).alias("share"))


def overruled(places: DataFrame) -> DataFrame:
    """places (ask, pid, key, tier, options, named) with a branch's tier 0 taken back to 2 where its namesakes only have options.

    options: another branch's diet bits say yes or limited; named: its own category or name says vegan.
    """
    w = Window.partitionBy("ask", "key")
    wrong = (F.col("tier") == 0) & ~F.col("named") & (F.count("*").over(w) >= 2) & (F.count_if(F.col("options")).over(w) > 0)
    return places.withColumn("tier", F.when(wrong, 2).otherwise(F.col("tier")))


def in_group(path: Column, kinds: list[str]) -> Column:
    """Whether a category's path has one of a group's kinds."""
    return F.arrays_overlap(path, F.array(*[F.lit(k) for k in kinds]))


def is_sub(path: Column, alternates: Column, cuisine: Column, name: Column, sub: str) -> Column:
    """Whether a place is of a narrower kind: by category, alternates, cuisine or name."""
    word = sub.removesuffix("_restaurant").replace("_", " ")
    said = lambda c: F.coalesce(F.lower(c).contains(word), F.lit(False))
    has = lambda c: F.coalesce(F.array_contains(c, sub), F.lit(False))
    return has(path) | has(alternates) | said(cuisine) | said(name)


def capital_words(text: Column) -> Column:
    """Words that start with a capital: how much of a text are names."""
    return F.regexp_count(text, F.lit(r"(?:^|\s)\p{Lu}")).cast("long")


def path_of_kinds(rows: DataFrame) -> DataFrame:
    """(cat, hier): for each category one path of categories, the least, whichever of its rows has it."""
    return rows.groupBy("cat").agg(F.min("hier").alias("hier"))


def fork_dates(rows: DataFrame, line: str) -> DataFrame:
    """(name, day) of a Markdown table's rows that start with a name, linked or not, and end with a day such as `Jul 30, 2015`."""
    cells = F.filter(F.split(line, r"\|"), lambda x: F.trim(x) != "")
    name = F.regexp_replace(F.regexp_replace(F.get(cells, F.lit(0)), r"\[([^\]]*)\]\([^)]*\)+", "$1"), r"^[*_ ]+|[*_ ]+$", "")
    day = F.regexp_extract(F.trim(F.element_at(cells, -1)), r"^[*_]*([A-Z][a-z]{2} \d{1,2}, \d{4})[*_]*$", 1)
    parsed = F.try_to_date(F.when(day != "", day), "MMM d, yyyy") if hasattr(F, "try_to_date") else F.to_date(F.when(day != "", day), "MMM d, yyyy")
    return rows.where(F.size(cells) >= 2).select(F.lower(name).alias("name"), parsed.alias("day")).where("day is not null and name <> ''")


#: A name in a heading or a description (fixed).
_NAMED = r"([A-Z][a-zé]+)"


def _first_day(rows: DataFrame, key: list[str], words: Column, dates: DataFrame) -> DataFrame:
    """(key..., day): the day of the first of the words that names one."""
    said = rows.select(*key, F.posexplode(words).alias("at", "word")).withColumn("name", F.lower("word"))
    return said.join(dates, "name").groupBy(*key).agg(F.min_by("day", "at").alias("day"))


def fork_stages(history: DataFrame, documents: DataFrame, dates: DataFrame) -> DataFrame:
    """(number, upgrade, stage, day): which upgrade each numbered document belongs to; the first source that says so wins.

    history (place, section: its heading line and text): a linked number is live
    with that upgrade, by place. Then documents (number, title, description, status,
    requires, body) titled `Hardfork Meta: name`, by number: those linked before
    their rationale, in the stage of the heading above (declined and activation
    don't count), and where the document is final those it requires. What a final
    one includes is live, what another includes is scheduled. dates (name in lower case, day).
    """
    line = F.regexp_replace(F.substring_index("section", "\n", 1), r"\s*\{#[^}]*\}", "")
    quoted = F.regexp_extract("section", r'\A[^\n]*\("([^"\n]+)"\)', 1)
    told = history.select("place", "section", F.trim(line).alias("head"), F.when(quoted != "", quoted).otherwise(F.trim(line)).alias("upgrade"))
    days = _first_day(told, ["place"], F.regexp_extract_all("head", F.lit(_NAMED), F.lit(1)), dates)
    links = F.regexp_extract_all("section", F.lit(r"eips\.ethereum\.org/EIPS/eip-(\d+)"), F.lit(1))
    live = told.join(days, "place", "left").select(F.explode(links).alias("n"), "upgrade", F.lit("live").alias("stage"), "day", F.lit(0).alias("source"), F.col("place").cast("long").alias("rank"))

    name = F.trim(F.regexp_extract("title", r"(?i)^hardfork meta\s*[-:]\s*(.+)$", 1))
    metas = documents.where((name != "") & ~F.lower("title").contains("backfill")).select(
        "number", name.alias("upgrade"), (F.lower(F.coalesce("status", F.lit(""))) == "final").alias("final"), F.coalesce("requires", F.lit("")).alias("requires"),
        F.split(F.substring_index(F.coalesce("body", F.lit("")), "## Rationale", 1), "\n").alias("lines"),
        F.concat(F.array("title"), F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(_NAMED), F.lit(1))).alias("words"),
    )
    # The upgrade's own name comes before the words of the description.
    words = F.concat(F.array("upgrade"), F.slice("words", 2, F.size("words")))
    meta_days = _first_day(metas, ["number"], words, dates)
    low = F.lower(F.regexp_extract("line", r"^###\s+(.*)", 1))
    stage = F.when(low == "", None)
    for word in ("declined", "considered", "proposed", "activation"):
        stage = stage.when(low.contains(word), word)
    lines = metas.select("number", F.posexplode("lines").alias("at", "line")).withColumn("head", stage.otherwise("included"))
    above = F.last("head", ignorenulls=True).over(Window.partitionBy("number").orderBy("at"))
    linked = lines.withColumn("stage", F.coalesce(above, F.lit("included"))).where(F.col("head").isNull() & ~F.col("stage").isin("declined", "activation"))
    linked = linked.select("number", "at", "stage", F.explode(F.regexp_extract_all("line", F.lit(r"\(\./eip-(\d+)\.md\)"), F.lit(1))).alias("n"))
    required = metas.where("final").select("number", F.lit(2**31 - 1).alias("at"), F.lit("included").alias("stage"), F.explode(F.regexp_extract_all("requires", F.lit(r"(\d+)"), F.lit(1))).alias("n"))
    found = linked.unionByName(required).groupBy("number", "n").agg(F.min_by("stage", "at").alias("stage")).where(F.col("n").cast("long") != F.col("number"))
    planned = found.join(metas.select("number", "upgrade", "final"), "number").join(meta_days, "number", "left").select(
        "n", "upgrade", F.when(F.col("final"), "live").when(F.col("stage") == "included", "scheduled").otherwise(F.col("stage")).alias("stage"),
        F.when(F.col("final"), F.col("day")).alias("day"), F.lit(1).alias("source"), F.col("number").cast("long").alias("rank"),
    )
    every = live.unionByName(planned).withColumn("number", F.col("n").cast("long"))
    first = Window.partitionBy("number").orderBy("source", "rank")
    return every.withColumn("r", F.row_number().over(first)).where("r = 1").select("number", "upgrade", "stage", "day")
