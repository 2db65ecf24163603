"""The city that a question names, from free text: spans, runs of words in them, a join with the names, and the rules that choose.

A question has spans where it may name a place: the words after "in", "near" and
so on (anchored, the last first), then runs of capitalised words. Of a span the
runs of up to five words are tried, from its start and longest first. All runs of
all questions meet the dictionary of names in one join on the run; what a run
stands for, and which run decides, are aggregates per run, span and question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.names import norm_key
from tessella.functions.questions import ASKS, NOT_PLACES, place_texts
from tessella.operators.places import country_city, hinted, largest_city

#: Words of a run, the weight of a city's own name and of a capital, and people that make a town a city.
RUN, OWN_NAME, CAPITAL, CITY = 5, 3, 5, 100_000
#: Countries whose cities are labelled with their region (fixed).
WITH_REGION = ("US", "CA", "AU", "IN", "BR", "MX")


def named_runs(asks: DataFrame) -> DataFrame:
    """(ask, span, anchored, upper, at, less, key, rest): the runs of words of asks (ask, question, and cuisine: a word that is none).

    at and less order the runs of a span: by start, longer ones first. rest: the
    words after the run. A run of capitalised words may start after words that open
    questions; such words alone are no names there. The cuisine's word never is.
    """
    spans = asks.select("ask", "cuisine", F.posexplode(place_texts("question")).alias("span", "s")).select(
        "ask", "span", F.col("s.anchored").alias("anchored"), F.col("s.text").rlike(r"^\p{Lu}").alias("upper"), norm_key("cuisine").alias("cuisine"),
        F.split(norm_key("s.text"), " ").alias("words"),
    )
    spans = spans.where(F.get("words", F.lit(0)) != "")
    opens = F.transform("words", lambda w: w.isin(*sorted(NOT_PLACES)))
    first = F.array_position(opens, False)
    skipped = F.when(F.col("anchored"), 0).when(first == 0, F.size("words") - 1).otherwise(first - 1).cast("int")

    def run(at: Column, n: Column) -> Column:
        return F.struct(
            at.alias("at"), (-n).alias("less"), F.array_join(F.slice("words", at + 1, n), " ").alias("key"),
            F.slice("words", at + n + 1, F.size("words")).alias("rest"),
        )

    most = lambda at: F.least(F.size("words") - at, F.lit(RUN))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), skipped), lambda at: F.transform(F.sequence(F.lit(1), most(at)), lambda n: run(at, n))))
    spread = spans.select("ask", "span", "anchored", "upper", "cuisine", F.explode(runs).alias("r")).select("ask", "span", "anchored", "upper", "cuisine", "r.*")
    dull = ~F.col("anchored") & F.col("key").isin(*sorted(NOT_PLACES))
    return spread.where(~dull & (F.col("key") != F.col("cuisine"))).drop("cuisine")


def name_dictionary(city_names: DataFrame, cities: DataFrame) -> DataFrame:
    """(key, country, region, best): the heaviest city that each name may stand for in each region: (weight, less, population, capital), less the city's id negated.

    A city's own name weighs three times its people, a capital's own name five times
    that; other names of it weigh its people. Only the heaviest of a region can be
    chosen, as what follows a name narrows it to countries and regions.
    """
    own = norm_key("name") == F.col("key")
    weight = F.col("population") * F.when(own, OWN_NAME * F.when(F.col("capital"), CAPITAL).otherwise(1)).otherwise(1)
    met = city_names.join(cities, "city")
    best = F.max(F.struct(weight.alias("weight"), (-F.col("city")).alias("less"), "population", "capital")).alias("best")
    return met.groupBy("key", "country", "region").agg(best)


def region_dictionary(region_names: DataFrame, cities: DataFrame) -> DataFrame:
    """(key, people, city, population, capital): the region of each name with the most people in its cities, and its largest city."""
    largest = largest_city(cities, ["country", "region"]).select("country", "region", F.col("total").alias("people"), "city")
    met = region_names.where("region <> ''").join(largest, ["country", "region"]).where("people > 0")
    best = met.groupBy("key").agg(F.min(F.struct((-F.col("people")).alias("less"), "country", "region", "city")).alias("b"))
    return best.select("key", (-F.col("b.less")).alias("people"), F.col("b.city").alias("city")).join(cities.select("city", "population", "capital"), "city")


def _meanings(runs: DataFrame, names: DataFrame, regions: DataFrame, region_names: DataFrame) -> DataFrame:
    """runs with what each stands for: `city`, or else `code` of a country; runs that stand for nothing are left out."""
    # A run's cities depend on its key and the words after it alone, so equal ones are looked up once.
    said = F.struct("key", "rest")
    met = runs.select("key", "rest").distinct().join(names, "key").withColumn("said", said).withColumn("place", F.struct("country", "region"))
    places = region_names.select("key", "country", "region")
    chosen = hinted(
        met.select(F.col("said").alias("ask"), F.col("place").alias("city"), "country", "region"), met.select(F.col("said").alias("ask"), F.col("rest").alias("words")).distinct(), places
    )
    mine = met.join(chosen.select(F.col("ask").alias("said"), F.col("city").alias("place")).distinct(), ["said", "place"])
    best = mine.groupBy("said").agg(F.max("best").alias("b"))
    best = best.select("said.key", "said.rest", F.struct(F.col("b.weight").alias("weight"), (-F.col("b.less")).alias("city"), "b.population", "b.capital").alias("named"))
    of_region = regions.select("key", F.struct(F.col("people").alias("weight"), "city", "population", "capital").alias("largest"))
    country = region_names.where("region = ''").groupBy("key").agg(F.min("country").alias("code"))
    all_ = runs.join(best, ["key", "rest"], "left").join(of_region, "key", "left").join(country, "key", "left")
    larger = F.col("anchored") & F.col("largest").isNotNull() & (F.col("largest.weight") > F.coalesce("named.weight", F.lit(0)))
    found = all_.withColumn("best", F.when(larger, F.col("largest")).otherwise(F.col("named")))
    great = F.coalesce((F.col("best.population") >= CITY) | F.col("best.capital"), F.lit(False))
    code = F.when(F.col("anchored") & ~great, F.col("code"))
    city = F.when(code.isNull() & ((F.col("anchored") & F.col("upper")) | (F.col("best.population") >= CITY)), F.col("best.city"))
    return found.select("ask", "span", "anchored", "at", "less", city.alias("city"), code.alias("code")).where("city is not null or code is not null")


def named_cities(asks: DataFrame, city_names: DataFrame, cities: DataFrame, region_names: DataFrame, countries: DataFrame) -> DataFrame:
    """(ask, city, label): the city that each of asks (ask, question, cuisine) names; city and label are null where it names none.

    city_names (key, city), cities (city, name, country, region, population,
    capital), region_names (key, country, region; region '' for a country),
    countries (country, country_name).

    * A run that names cities stands for the heaviest, narrowed by a country or
      region that the words after it name; after "in" and so on a region of that
      name counts with all its people, and stands for its largest city.
    * A country after "in" and so on without a city of 100,000 people or a capital of
      its name ends its span, and then no run of capitalised words is the place.
    * A run after "in" and so on counts if it is capitalised or its city has 100,000
      people, any other only in the latter case.
    * A question that names only a country and asks for places gets its capital, or its
      largest city if that is twice as large.
    """
    runs = named_runs(asks)
    meant = _meanings(runs, name_dictionary(city_names, cities), region_dictionary(region_names, cities), region_names)
    decided = meant.groupBy("ask", "span", "anchored").agg(F.min(F.struct("at", "less", "city", "code")).alias("d")).select("ask", "span", "anchored", "d.city", "d.code")
    first = lambda value, where: F.min(F.when(where & value.isNotNull(), F.struct("span", value.alias("v"))))
    per = decided.groupBy("ask").agg(
        first(F.col("city"), F.col("anchored")).alias("after"), first(F.col("city"), ~F.col("anchored")).alias("bare"), first(F.col("code"), F.lit(True)).alias("land")
    )
    city = F.coalesce("after.v", F.when(F.col("land").isNull(), F.col("bare.v")))
    stands = country_city(cities, need_capital=True).select(F.col("country").alias("code"), F.col("city").alias("of_land"))
    joined = asks.select("ask", "question").join(per.select("ask", city.alias("city"), F.col("land.v").alias("code")), "ask", "left").join(stands, "code", "left")
    asked = F.lower("question").rlike(ASKS.pattern)
    of_land = F.when(F.col("city").isNull() & asked, F.col("of_land"))
    chosen = joined.select("ask", F.coalesce("city", of_land).alias("city"), (F.col("city").isNull() & of_land.isNotNull()).alias("for_country"))
    return chosen.join(labels(cities, countries), "city", "left").select(
        "ask", "city", F.when(F.col("for_country"), F.concat("label", F.when(F.col("is_capital"), " (the capital)").otherwise(" (the largest city)"))).otherwise(F.col("label")).alias("label")
    )


def labels(cities: DataFrame, countries: DataFrame) -> DataFrame:
    """(city, label, is_capital): where a city is: its name, in some countries its region, and its country."""
    region = F.when(F.col("country").isin(*WITH_REGION) & (F.col("region") != "") & (F.col("region") != F.col("name")), F.col("region"))
    return cities.join(countries, "country", "left").select(
        "city", F.concat_ws(", ", "name", region, F.coalesce("country_name", "country")).alias("label"), F.col("capital").alias("is_capital")
    )
