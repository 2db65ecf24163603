"""Small documents with every awkward case, and plain re-implementations to compare with."""

import re

from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{i % 977} tail{i}." for i in range(6000))
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog tonight.", "en", "a", 1),
    (2, "the QUICK brown fox jumps over the lazy dog tonight.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, "short one", "de", None, 9),
    (6, "short one", "de", "b", 9),
    (7, "  \t\n ", "fr", "c", 5),
    (8, LONG, "en", "a", 1),
    (9, LONG + " more", "en", "a", 1),
    (None, "The quick brown fox jumps over the lazy dog tonight.", "en", "a", 1),
    (5, "short one", "de", None, 9),
    (10, "Été ça 你好 мир!!! <|endoftext|> 12345", "fr", "z", 3),
]


def table(spark, rows=AWKWARD, clash=()):
    """The rows as a table; clash: columns of these names are added."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in clash:
        df = df.withColumn(name, F.lit("clash"))
    return df


def words5(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingles(text):
    w = words5(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


words_strategy = st.lists(st.sampled_from("a b c d e f g h".split()), min_size=0, max_size=30).map(" ".join)
