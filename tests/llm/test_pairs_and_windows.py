import hashlib
import random

import pytest
from hypothesis import HealthCheck, given, settings

from tessella.llm import components as cc
from tessella.llm.decontam import contamination, contamination_digest
from tessella.llm.neardup import deduplicated, near_duplicates
from tests.llm.helpers import AWKWARD, SCHEMA, plain_words, shingles, table, words_strategy


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            both = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j])
            if linked or same_id:
                parent[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return [(doc, len(sets[i]), low.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_components_of_awkward_rows(spark):
    found = near_duplicates(table(spark, clash=("node", "class", "sign", "n")))
    assert got(found) == sorted(brute_components([r[:2] for r in AWKWARD]), key=str)
    kept = {(r.doc_id, r.kept) for r in found.collect()}
    assert (1, True) in kept and (2, False) in kept and (3, True) in kept and (None, False) in kept


def family(seed, size):
    """Texts that differ from one another by a few words, so that links form chains and near misses."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(10**6)}" for _ in range(120)]
    rows, texts = [], [base]
    for i in range(size):
        words = list(rng.choice(texts))
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(words)
        rows.append((1000 - i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("short", "block"), [(1, 8), (2, 256), (4, 16), (1000, 8)])
def test_chains_match_brute_force_in_short_and_long_posts(spark, short, block):
    rows = family(1, 60) + [(5000 + i, t) for i, (_, t) in enumerate(family(2, 40))]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert got(near_duplicates(df, short=short, block=block)) == sorted(brute_components(rows), key=str)


def test_an_id_with_several_texts_ties_their_groups(spark):
    first, second = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(7, first), (7, second), (8, first + " x"), (9, second + " y"), (None, second + " z"), (None, "some other text that is alone here"), (7, "short")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    assert got(near_duplicates(df)) == sorted(brute_components(rows), key=str)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).where("doc_id = 9").collect()} == {9: 7}


def test_one_row_of_each_group_stays(spark):
    first, second = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, first), (4, first + " x"), (4, first + " x"), (6, second), (None, second), (None, "alone " * 9), (None, "alone " * 9), (2, ""), (2, None), (3, "  ")]
    df = table(spark, [(i, t, None, None, None) for i, t in rows], clash=("row_key", "component", "id"))
    stay = sorted(((r.doc_id, r.text) for r in deduplicated(df).collect()), key=str)
    assert stay == sorted([(4, first + " x"), (6, second), (None, "alone " * 9), (2, ""), (2, None), (3, "  ")], key=str)
    assert deduplicated(df).columns == df.columns


def test_a_large_family_that_shares_most_words_stays_in_bounded_tasks(spark):
    """4,000 texts share three fifths of their words and are no copies; 20 are copied: no pairs of all with all."""
    rng, common = random.Random(5), [f"c{k}" for k in range(60)]
    texts = [" ".join([*common, *(f"u{rng.randrange(10**9)}" for _ in range(40))]) for _ in range(4000)]
    rows = list(enumerate(texts)) + [(5000 + i, texts[i] + " end") for i in range(20)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    found = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert found == {i: i - 5000 if i >= 5000 else i for i, _ in rows}


def test_no_documents(spark):
    assert near_duplicates(table(spark, [])).collect() == []


def test_star_rounds_and_one_task_agree(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, 7), (400, 401), (400, 401)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    one, many = (sorted(map(tuple, cc.components(edges, local_edges=n).collect())) for n in (10**6, 0))
    assert one == many
    assert (401, 400) in one and (7, 7) not in [x for x in one if x[0] == 7 and all(7 not in p or p == (7, 7) for p in pairs)]


def brute_contamination(docs, items, window=10):
    out = []
    for doc, text in docs:
        w, hit, which = plain_words(text), set(), set()
        for item, item_text in items:
            iw = plain_words(item_text)
            runs = [iw[i : i + window] for i in range(max(1, len(iw) - window + 1))] if iw else []
            for run in runs:
                for i in range(len(w) - len(run) + 1):
                    if w[i : i + len(run)] == run:
                        hit |= set(range(i, i + len(run)))
                        which.add("null" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(which), digest, bool(hit)))
    return sorted(out, key=str)


def digest(spark, docs, items, **settings_):
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in contamination_digest(contamination(d, b, **settings_)).collect()), key=str)


def test_contamination_of_awkward_rows(spark):
    docs = [r[:2] for r in AWKWARD]
    items = [(1, "Quick brown FOX jumps over the lazy dog tonight"), (2, None), (3, ""), (4, "one"), (None, "short one"), (4, "Été ÇA"),
             (9, " ".join(f"w{i} tail{i}." for i in range(40))), (10, "ça")]
    assert digest(spark, docs, items) == brute_contamination(docs, items)
    assert digest(spark, docs, items, block_bytes=40) == brute_contamination(docs, items)
    clashing = table(spark, clash=("item", "items", "spans", "n_words", "words", "state"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS words")
    assert sorted((tuple(r) for r in contamination_digest(contamination(clashing, benchmark)).collect()), key=str) == brute_contamination(docs, items)
    assert digest(spark, docs, []) == brute_contamination(docs, [])
    assert digest(spark, [], items) == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(words_strategy, words_strategy, words_strategy, words_strategy)
def test_contamination_matches_brute_force(spark, a, b, c, d):
    docs, items = [(1, a + " " + c), (2, b), (3, d + " " + a)], [(1, a), (2, c), (3, d[:9])]
    for window in (3, 10):
        assert digest(spark, docs, items, window=window) == brute_contamination(docs, items, window)
