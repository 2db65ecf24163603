"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by pattern. Each distinct entity gets a surrogate of its own
type: derived from a keyed hash of its canonical form, so every mention, however
written, becomes the same stand-in. Letters stand for letters of the same script
and case, digits for digits, punctuation stays, addresses stay valid, cards and
accounts keep right check digits, and names keep their gender. Surrogates that
two entities share, or that are some entity's own form, are drawn again until all
differ; forms so short that few are free grow by a character a draw.

Digits that look like a card or an account but fail its check are left alone, and
so are hexadecimal strings that nothing calls a secret.

Canonical forms: digits only for phone, card and social security numbers,
letters and digits for account numbers, lower case for e-mail addresses and
names; credentials and network addresses as written. A name's parts are entities of
their own, so `Mrs Ann Lee`, `Mrs Lee` and a bare `Lee` later on stay one person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import kept

KEY = "surrogates-1"
#: Draws after which remaining collisions are an error, and those after which forms grow.
DRAWS = 24
SAME_LENGTH = 5

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: An apostrophe belongs to a name where two letters follow: O'Brien, but not the s of Lee's.
_NAME = r"\p{Lu}(?:\p{L}|['’]\p{L}{2})+(?:-\p{Lu}(?:\p{L}|['’]\p{L}{2})+)*"
#: What a name of a place or thing ends in (fixed words): no person.
_THINGS = (
    "Airport|Terminal|Square|Street|Road|Avenue|Boulevard|Station|Bridge|Park|Church|Cathedral|Chapel|Museum|Library|School|College|University|Hospital|Tower|"
    "Stadium|Theatre|Theater|Hotel|Foundation|Institute|Prize|Award|Kirche|Straße|Platz|Allee|Brücke|Schule|Universität|Flughafen|Bahnhof|Strafe|Buße"
)
#: Titles before names, by gender (fixed words).
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"),
}
_TITLE = {g: r"(?:" + "|".join(words) + r")" for g, words in TITLES.items()}
#: Frequent given names that make a name of the capitalised words after them, by gender (fixed words).
GIVEN = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Mark", "Paul",
          "Steven", "Andrew", "Peter", "Hans", "Klaus", "Jürgen", "Wolfgang", "Pierre", "Jean", "Jacques", "François", "José", "Juan", "Carlos", "Antonio",
          "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Владимир"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Lisa", "Margaret", "Sandra",
          "Emily", "Anna", "Laura", "Ursula", "Monika", "Petra", "Sabine", "Marie", "Nathalie", "Isabelle", "Sophie", "María", "Carmen", "Ana", "Lucía", "Elena",
          "Мария", "Анна", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"),
}
_GIVEN = {g: r"(?:" + "|".join(words) + r")" for g, words in GIVEN.items()}
#: Words that a secret is assigned to (fixed). What costs little is asked first, at every place: the character before, a digit ahead.
_CALLED = r"""(?<=[\s"':=])(?=[A-Za-z_]{0,64}[0-9])(?<=(?i:token|secret|api[_-]?key|password|passwd|pwd)["']?\s{0,2}[:=]\s{0,2}["']?)"""
#: Only here may a title or a given name start: two titles are written small.
_INITIAL = r"(?<![\p{L}-])(?=[\p{Lu}г])"
_MAIL = r"[\p{L}\p{M}\p{N}_.%+-]"
#: Patterns by type, in order of precedence.
PATTERNS = {
    "email": rf"(?<!{_MAIL}){_MAIL}{{1,64}}+@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,8}}\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}_-])",
    "credential": rf"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9_-]{{20,64}}|xox[abprs]-[A-Za-z0-9-]{{10,64}})(?![A-Za-z0-9])"
    rf"|(?<=password=)[A-Za-z0-9]{{6,64}}|{_CALLED}[A-Za-z0-9_+/-]{{8,128}}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": rf"(?<![0-9.])(?<!(?i:version|release) )(?<![vV]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "card": r"(?<![0-9])(?:[2-6][0-9]{12,18}|[2-6][0-9]{3}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,8}){1,5}(?![0-9])|\+[0-9]{8,15}(?![0-9])|(?<![0-9.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])"
    r"|(?<![0-9.,] ?)[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?! ?[0-9])|(?<![0-9])8[ -]\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{2}[ -][0-9]{2}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": rf"{_INITIAL}(?:(?:{_TITLE['m']}|{_TITLE['f']})\.?|{_GIVEN['m']}|{_GIVEN['f']})(?: {_NAME}){{1,4}}",
}
#: Texts without any of these hold no entity: each pattern needs one of them, secrets of letters alone their marks.
_MARKS = ("password=", "AKIA", "sk-", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
_NAME_HINT = rf"{_INITIAL}(?:(?:{_TITLE['m']}|{_TITLE['f']})\.?|{_GIVEN['m']}|{_GIVEN['f']}) \p{{Lu}}"
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What matched a pattern, but isn't what the pattern looks for.
PLAIN = "plain"
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Endings that read as a gender, by script (fixed).
_ENDS = {"latin": {"m": ("o", "on", "er", "us"), "f": ("a", "ina", "ela", "ie")}, "cyrillic": {"m": ("ин", "ов"), "f": ("ина", "ова")}}
_SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеио"],
}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _mod97(form: Column) -> Column:
    """The remainder of an account number that is 1 where its check digits are right."""
    turned = F.concat(F.substring(form, F.lit(5), F.length(form)), F.substring(form, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    step = lambda n, c: F.pmod(n * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step)


def _hinted(text: Column) -> Column:
    """Whether a text may hold an entity; what costs least is asked first. Null: no."""
    out = text.rlike("[@0-9]")
    for mark in _MARKS:
        out = out | text.contains(mark)
    return F.coalesce(out | text.rlike(_NAME_HINT), F.lit(False))


def _kind(raw: Column) -> Column:
    out = None
    for name, pattern in PATTERNS.items():
        # Look-around needs surroundings, so the edges are blanks; what matches nothing then stood after `password=` and the like.
        hit = F.length(F.regexp_extract(F.concat(F.lit(" "), raw, F.lit(" ")), pattern, 0)) == F.length(raw)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    kind = out.otherwise("credential")
    thing = (kind == "name") & raw.rlike(rf" (?:{_THINGS})$")
    wrong = thing | ((kind == "card") & (_luhn(_digits(raw)) % 10 != 0)) | ((kind == "account") & (_mod97(F.regexp_replace(raw, "[^A-Z0-9]", "")) != 1))
    return F.when(wrong, PLAIN).otherwise(kind)


def _canonical(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind.isin("card", "phone", "ssn"), _digits(raw))
        .when(kind == "account", F.regexp_replace(raw, "[^A-Z0-9]", ""))
        .when(kind.isin("credential", "address"), raw)
        .otherwise(F.lower(raw))
    )


def _stream(key: str, kind: Column, form: Column, draw: Column) -> Column:
    """256 keyed hex digits of an entity and a draw."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, form, draw.cast("string"))
    return F.concat(*[F.sha2(F.concat_ws("\u0001", seed, F.lit(str(k))), 256) for k in range(4)])


def _byte(stream: Column, at: Column) -> Column:
    """A number below 65,536 from the stream; long forms go round it."""
    return F.conv(F.substring(stream, (at * 4) % 252 + 1, F.lit(4)), 16, 10).cast("int") + at


def _pick(options, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (n % len(options) + 1).cast("int"))


def _mapped(stream: Column, form: Column) -> Column:
    """form with letters and digits replaced one by one; scripts, cases and everything else stay."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", n))
        for letters in _LETTERS.values():
            out = out.when(F.lit(letters).contains(c), _pick(letters, n)).when(
                F.lit(letters.upper()).contains(c), _pick(letters.upper(), n)
            )
        return out.when(c.rlike(r"\p{Ll}"), _pick(_LETTERS["latin"], n)).when(c.rlike(r"\p{Lu}"), _pick(_LETTERS["latin"].upper(), n)).otherwise(c)

    return F.array_join(F.transform(F.split(form, "(?<=.)(?=.)"), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's rule over digits, the last of which is the check digit."""
    array = F.reverse(F.split(digits, "(?<=.)(?=.)"))
    worth = F.transform(
        array, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b)


def _named(stream: Column, kind: Column, form: Column) -> Column:
    """A made-up name part of the form's script; given names end as their gender does."""

    def build(script: str) -> Column:
        parts = [_pick(_SYLLABLES[script], _byte(stream, F.lit(k))) for k in range(3)]
        ends = _ENDS[script]
        ending = (
            F.when(kind == "given_m", _pick(ends["m"], _byte(stream, F.lit(9))))
            .when(kind == "given_f", _pick(ends["f"], _byte(stream, F.lit(9))))
            .otherwise(_pick(_SYLLABLES[script], _byte(stream, F.lit(10))))
        )
        more = F.when(_byte(stream, F.lit(11)) % 2 == 0, _pick(_SYLLABLES[script], _byte(stream, F.lit(12)))).otherwise("")
        return F.concat(*parts, more, ending)

    return F.when(form.rlike(r"\p{IsCyrillic}"), build("cyrillic")).otherwise(build("latin"))


def _surrogate(key: str, kind: Column, form: Column, draw: Column) -> Column:
    """The surrogate of a canonical form at a draw, in canonical form too."""
    stream = _stream(key, kind, form, draw)
    mapped = _mapped(stream, form)
    at = F.instr(F.reverse(form), ".")
    email = F.concat(F.substring(mapped, F.lit(1), F.length(form) - at), F.substring(form, F.length(form) - at + 1, at))
    octets = F.concat_ws(".", *[(_byte(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    # Card: the last digit is set so that the sum has the remainder it had.
    base = F.concat(F.substring(form, 1, 1), F.substring(mapped, F.lit(2), F.length(form) - 2), F.lit("0"))
    last = F.pmod(_luhn(form) - _luhn(base), F.lit(10))
    card = F.concat(F.substring(base, F.lit(1), F.length(form) - 1), last.cast("string"))
    mark = F.regexp_extract(form, "^(AKIA|gh[pousr]_|sk-|xox[abprs]-)", 1)
    credential = F.when(mark != "", F.concat(mark, F.substring(mapped, F.length(mark) + 1, F.length(form)))).otherwise(
        F.when(form.rlike("^[0-9a-f]{32,256}$"), F.substring(stream, F.lit(1), F.length(form)))
        .when(form.rlike("^[0-9A-F]{32,256}$"), F.upper(F.substring(stream, F.lit(1), F.length(form))))
        .otherwise(mapped)
    )
    # Account: country and kind of each character stay, check digits are made right.
    rest = F.substring(mapped, F.lit(5), F.length(form))
    right = F.lit(98) - _mod97(F.concat(F.substring(form, 1, 2), F.lit("00"), rest))
    account = F.concat(F.substring(form, 1, 2), F.lpad(right.cast("string"), 2, "0"), rest)
    more = F.greatest(draw - SAME_LENGTH, F.lit(0))
    letters = F.substring(F.translate(F.substring(stream, 193, 32), "0123456789abcdef", "bcdfghjklmnpqrst"), F.lit(1), more)
    figures = F.substring(F.translate(F.substring(stream, 193, 32), "abcdef", "012345"), F.lit(1), more)
    return (
        F.when(kind == "email", F.concat(letters, email)).when(kind == "address", octets).when(kind == "card", card)
        .when(kind == "credential", F.concat(credential, letters)).when(kind == "account", account).when(kind == "phone", F.concat(mapped, figures))
        .when(kind.startswith("given") | (kind == "family"), F.concat(_named(stream, kind, form), letters)).otherwise(mapped)
    )


def _distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct entities; no two of a kind share one, none is an entity's own form.

    Each round draws for those without one; of those that collide the smallest
    form keeps it, and the rest draw again.
    """
    settled = None
    waiting = entities.withColumn("draw", F.lit(0))
    owner = lambda table: table.select("kind", F.col("form").alias("surrogate"))
    for draw in range(DRAWS):
        drawn = waiting.select("kind", "form", _surrogate(key, F.col("kind"), F.col("form"), F.lit(draw)).alias("surrogate"))
        taken = owner(entities) if settled is None else owner(entities).union(settled.select("kind", "surrogate"))
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))
        first = kept(first.select("kind", "form", "surrogate"), "surrogates")
        settled = first if settled is None else kept(settled.union(first), "surrogates")
        left = waiting.select("kind", "form").join(settled, ["kind", "form"], "left_anti")
        waiting = kept(left, "waiting")
        if not waiting.count():
            return settled
    raise ValueError(f"{waiting.count()} entities have no distinct surrogate after {DRAWS} draws")


def _rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """A surrogate written as the mention was: its separators and letter case."""
    sparse = kind.isin("card", "phone", "ssn", "account")

    def step(state: Column, c: Column) -> Column:
        counts = ~sparse | c.rlike("[0-9A-Z]")
        given = F.substring(surrogate, state["k"] + 1, F.lit(1))
        written = F.when(c.rlike(r"\p{Lu}"), F.upper(given)).otherwise(given)
        return F.struct(
            F.concat(state["o"], F.when(counts, written).otherwise(c)).alias("o"), (state["k"] + counts.cast("int")).alias("k")
        )

    walked = F.aggregate(F.split(raw, "(?<=.)(?=.)"), F.struct(F.lit("").alias("o"), F.lit(0).alias("k")), step)["o"]
    name = kind.startswith("given") | (kind == "family")
    titled = F.when(raw.rlike(r"^\p{Lu}{2,}$"), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    # A form that grew: an address is written whole, digits go on at the end.
    own = F.length(F.regexp_replace(raw, "[^0-9A-Z]", ""))
    longer = F.concat(walked, F.substring(surrogate, own + 1, F.length(surrogate)))
    return (
        F.when(kind == PLAIN, raw).when(kind.isin("address", "credential"), surrogate).when(name, titled)
        .when((kind == "email") & (F.length(raw) != F.length(surrogate)), surrogate).when(kind == "phone", longer).otherwise(walked)
    )


def _parts(raw: Column) -> Column:
    """A mention's parts (kind, form, raw): a name is its title, kept as it is, its given parts and its family name."""
    kind, words = _kind(raw), F.split(raw, " ")
    first = F.get(words, F.lit(0))
    gender = F.when(first.rlike(rf"^(?:{_TITLE['f']}\.?|{_GIVEN['f']})$"), "f").otherwise("m")
    part = lambda k, f, r: F.struct(k.alias("kind"), f.alias("form"), r.alias("raw"))
    title = F.when(first.rlike(rf"^(?:{_TITLE['m']}|{_TITLE['f']})\.?$"), F.array(part(F.lit("title"), first, first))).otherwise(F.array())
    given = F.transform(F.slice(words, F.size(title) + 1, F.size(words) - F.size(title) - 1), lambda w: part(F.concat(F.lit("given_"), gender), F.lower(w), w))
    last = F.element_at(words, -1)
    named = F.concat(title, given, F.array(part(F.lit("family"), F.lower(last), last)))
    return F.when(kind == "name", named).otherwise(F.array(part(kind, _canonical(kind, raw), raw)))


def _bare(gap: Column, names: Column) -> Column:
    """A stretch between mentions with names' parts (raw, new), standing alone, replaced: as they were written, and in capitals."""
    edge = lambda raw: F.concat(F.lit(r"(?<![\p{L}\p{N}_-])"), raw, F.lit(r"(?![\p{L}\p{N}_-])"))

    def replaced(text: Column, n: Column) -> Column:
        once = F.when(text.contains(n["raw"]), F.regexp_replace(text, edge(n["raw"]), n["new"])).otherwise(text)
        loud = F.upper(n["raw"])
        return F.when(once.contains(loud) & (loud != n["raw"]), F.regexp_replace(once, edge(loud), F.upper(n["new"]))).otherwise(once)

    return F.aggregate(names, gap, replaced)


def surrogates(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities, kinds), a row for each row of docs.

    text has every entity replaced, and parts of its names wherever else they stand
    alone in it; n_entities counts the mentions that patterns find, kinds are their
    types in order. Equal texts get equal results. Null texts stay null with no
    entity; empty ones and texts without entities are unchanged. Other columns are
    ignored; an empty table gives none. A key gives the same surrogates every time
    on the same table; a surrogate changes only where it would collide.
    """
    text = F.col("text")
    found = F.when(_hinted(text), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    touched = kept(
        own.where(text.isNotNull()).withColumn("mentions", found).where(F.size("mentions") > 0)
        .select(F.md5("text").alias("text_key"), "text", "mentions"),
        "mentions",
    ).dropDuplicates(["text_key"])
    touched = kept(touched, "texts")
    mentions = touched.select("text_key", F.posexplode("mentions").alias("at", "raw"))
    parts = kept(
        mentions.select("text_key", "at", F.posexplode(_parts(F.col("raw"))).alias("part", "p")).select("text_key", "at", "part", "p.*"),
        "parts",
    )
    entities = kept(parts.where(~F.col("kind").isin("title", PLAIN)).select("kind", "form").distinct(), "entities")
    given = _distinct_surrogates(entities, key)
    written = (
        parts.join(given, ["kind", "form"], "left")
        .withColumn("new", F.when(F.col("surrogate").isNull(), F.col("raw")).otherwise(_rendered(F.col("kind"), F.col("raw"), F.col("surrogate"))))
        .withColumn("type", F.when(F.col("kind").isin("title", "family", "given_m", "given_f"), "name").otherwise(F.col("kind")))
    )
    # Of a text's names, parts of two letters or more also stand alone; longer ones are put back first.
    named = F.when(F.col("kind").isin("family", "given_m", "given_f") & (F.length("raw") > 1), F.struct((-F.length("raw")).alias("less"), "raw", "new"))
    per_text = written.groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.struct("at", "part", "new", "type"))).alias("parts"), F.array_sort(F.collect_set(named)).alias("names")
    )
    pieces = lambda i: F.array_join(F.transform(F.filter("parts", lambda p: p["at"] == i), lambda p: p["new"]), " ")
    per_text = per_text.select(
        "text_key",
        F.transform(F.sequence(F.lit(0), F.element_at("parts", -1)["at"]), pieces).alias("news"),
        F.transform(F.filter("parts", lambda p: (p["part"] == 0) & (p["type"] != PLAIN)), lambda p: p["type"]).alias("kinds"), "names",
    )
    gaps = F.transform(F.split("text", _ALL, -1), lambda g: _bare(g, F.col("names")))
    joined = F.array_join(
        F.flatten(F.zip_with(gaps, F.col("news"), lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), ""
    )
    rewritten = kept(touched.join(per_text, "text_key").select("text_key", joined.alias("new_text"), "kinds"), "rewritten")
    # Texts without a hint pass by the join: they would all share the null key.
    hinted = _hinted(text)
    keyed = own.where(hinted).withColumn("text_key", F.md5("text")).join(rewritten, "text_key", "left")
    none = F.array().cast("array<string>")
    shown = lambda new, kinds: (
        F.col("doc_id").alias(id_col), F.coalesce(new, "text").alias("text"), F.coalesce(F.size(kinds), F.lit(0)).cast("int").alias("n_entities"),
        F.coalesce(kinds, none).alias("kinds"),
    )
    return keyed.select(*shown(F.col("new_text"), F.col("kinds"))).union(own.where(~hinted).select(*shown(F.lit(None).cast("string"), none)))
