"""Lines that say what a place is and why it is listed: for a list on screen and for a model's prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a tier of a diet is called (fixed values); other diets are named by their own words.
TIER_NAMES = {
    "vegan": ("vegan", "vegetarian", "vegan options", "a few vegan options"),
    "vegetarian": ("vegetarian", "vegetarian options", "vegetarian options", "a few vegetarian options"),
}
GUIDE_CHARS, LEAD_CHARS = 400, 400


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def reasons(diet: Column, tier: Column, vegan_tier: Column, article: Column, guide_tier: Column) -> Column:
    """Why a place is listed: its tier of the diet asked for, and the guide's article that lists it.

    A vegan place found for a vegetarian question is called vegan. Null diet or
    article: no such reason.
    """
    named = F.when((diet == "vegetarian") & (tier == 0) & (vegan_tier == 0), F.lit("vegan"))
    for name, labels in TIER_NAMES.items():
        named = named.when(diet == name, F.get(F.array(*[F.lit(x) for x in labels]), tier))
    words = F.replace(diet, F.lit("_"), F.lit("-"))
    named = named.when(diet.isNotNull(), F.when(tier == 0, words).otherwise(_text(words, " options")))
    listed = F.when(article.isNotNull(), _text("in the Wikivoyage guide (", article, F.when(guide_tier != "", _text(", ", guide_tier)).otherwise(""), ")"))
    return F.array_compact(F.array(named, listed))


def kind_words(kind: Column, why: Column) -> Column:
    """A place's kind and why it matches, without the guide: `vegan restaurant` says both."""
    mine = F.filter(why, lambda w: ~w.startswith("in the Wikivoyage"))
    first = F.get(mine, F.lit(0))
    merged = first.isin("vegan", "vegetarian") & kind.isin("vegan_restaurant", "vegetarian_restaurant")
    rest = F.slice(mine, 2, 100)
    return F.when(merged, F.concat(F.array(_text(first, " restaurant")), rest)).otherwise(F.concat(F.array(F.replace(kind, F.lit("_"), F.lit(" "))), mine))


def _distance(km: Column, origin: Column) -> Column:
    return _text(F.format_string("%.1f", km), " km from ", origin)


def _some(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def list_line(n: Column, name: Column, kind: Column, why: Column, street: Column, km: Column, origin: Column, in_guide: Column) -> Column:
    """`[n] Name — what it is · street · distance · in the travel guide`."""
    parts = F.concat(kind_words(kind, why), _some(F.when(street != "", street), _distance(km, origin), F.when(in_guide, F.lit("in the travel guide"))))
    return _text("[", n.cast("string"), "] ", name, " — ", F.array_join(parts, " · "))


def prompt_line(
    n: Column, name: Column, kind: Column, why: Column, cuisine: Column, street: Column, km: Column, origin: Column, hours: Column, guide: Column, lead: Column
) -> Column:
    """A place as a prompt reads it: kind, cuisine, address, distance, hours, then the guide's words and its article's lead."""
    dishes = F.array_join(F.filter(F.transform(F.split(cuisine, ";"), lambda c: F.trim(F.replace(c, F.lit("_"), F.lit(" ")))), lambda c: c != ""), ", ")
    parts = F.concat(kind_words(kind, why), _some(
        F.when(dishes != "", _text("cuisine: ", dishes)), F.when(street != "", _text("address: ", street)), _distance(km, origin), F.when(hours != "", _text("hours: ", hours)),
    ))
    said = lambda c, head: F.when(c != "", _text(head, c)).otherwise("")
    return _text("[", n.cast("string"), "] ", name, ": ", F.array_join(parts, "; "), ".", said(guide, " The travel guide says: "), said(lead, " Wikipedia: "))
