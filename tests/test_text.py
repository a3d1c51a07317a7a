"""Fuzzy matching against brute force, and the title rules."""

import random

import pytest
from pyspark.sql import functions as F

from aisle.functions import titles
from aisle.operators import text


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    return int(200 * common(a, b) / (len(a) + len(b)) + 0.5)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(160)]


def test_near_matches_are_complete(spark, words):
    left, right = words[:120], words[100:]
    a = spark.createDataFrame([(w,) for w in set(left)], "a string")
    b = spark.createDataFrame([(w,) for w in right], "b string")
    found = {(r.a, r.b) for r in text.near_matches(a, b, "a", "b").collect()}
    # Entries of up to two letters allow fewer edits than they have letters.
    expected = {(x, y) for x in left for y in right if edit_distance(x, y) <= min(2, len(y) - 1)}
    assert {p for p in found if len(p[1]) > 2} == {p for p in expected if len(p[1]) > 2}


def test_near_matches_above_similarity_are_complete(spark, words):
    a = spark.createDataFrame([(w,) for w in set(words)], "a string")
    found = {
        (r.a, r.b): r.ratio for r in text.near_matches(a, a.toDF("b"), "a", "b", accept=85)
        .select("a", "b", titles.near_ratio(F.col("a"), F.col("b"), F.col("edits")).alias("ratio"))
        .where("ratio > 85").collect()
    }
    expected = {
        (x, y): similarity(x, y) for x in words for y in words
        if edit_distance(x, y) <= 2 and similarity(x, y) > 85
    }
    assert found == expected


def test_listed_runs_are_few_and_lose_no_match(spark, words):
    """Against all runs of all titles: the same matches, from a small part of the runs."""
    draw = random.Random(9)
    noise = ["".join(draw.choice("opqrstuv") for _ in range(draw.randrange(3, 9))) for _ in range(300)]
    entries = [*words[:12], *(" ".join(draw.sample(words, n)) for n in (2, 2, 2, 3, 3)), "ab", "c", "a b"]
    rows = [(i, " ".join(draw.choices(noise, k=40) + draw.choices(words, k=4))) for i in range(30)]
    rows += [(100 + i, e[: i % len(e)] + "x" + e[i % len(e) + 1 :]) for i, e in enumerate(entries)]
    rows += [(200, "a c b ba"), (201, ", ."), (202, None), (None, entries[-4]), (203, entries[-4]), (203, entries[-5])]
    frame = spark.createDataFrame(rows, "id bigint, t string")
    brands = spark.createDataFrame([(e,) for e in entries] + [("",), (None,)], "brand string")
    runs = set()
    for i, t in rows:
        w = [x for x in (t or "").replace(",", " ").replace(".", " ").split(" ") if x]
        runs |= {(i, " ".join(w[k : k + n])) for n in (1, 2, 3) for k in range(len(w) - n + 1)}
    every = spark.createDataFrame(list(runs), "id bigint, ngram string")
    near = lambda f, accept: {
        tuple(r)[:3] for r in text.near_matches(f, brands, "ngram", "brand", accept=accept).select("id", "ngram", "brand").collect()}
    for accept in (None, 60, 85):
        grams = text.title_ngrams(frame, "id", "t", [1, 2, 3], brands, "brand", accept)
        listed = [tuple(r) for r in grams.collect()]
        assert len(listed) == len(set(listed)) and set(listed) <= runs
        assert near(grams, accept) == near(every, accept)
        assert len(listed) < 0.2 * len(runs)


def test_similarity_of_any_pair(spark, words):
    pairs = [(x, y) for x in words[:20] for y in words[20:40]]
    frame = spark.createDataFrame(pairs, "a string, b string")
    out = frame.select("a", "b", titles.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r.s == similarity(r.a, r.b) for r in out)


def test_best_entries(spark):
    predictions = spark.createDataFrame([("dvoe",), ("dove",), ("xyz",), ("babydove",)], "pred string")
    entries = spark.createDataFrame([("dove",), ("baby dove",), ("clear",)], "brand string")
    out = {r.pred: (r.brand_mapped, r.score) for r in text.best_entries(predictions, "pred", entries, "brand").collect()}
    assert out == {"dvoe": ("dove", 75), "dove": ("dove", 100), "xyz": ("not-detected", 0), "babydove": ("baby dove", 94)}


@pytest.mark.parametrize("accept", [55, 68, 70, 85, 100])
def test_best_entries_lose_no_pair(spark, words, accept):
    """Every pair that reaches ``accept`` is a candidate."""
    draw = random.Random(accept)
    made = {"".join(draw.choice("abcd") for _ in range(draw.randrange(1, 9))) for _ in range(60)}
    left, right = {*words[:60], *list(made)[:30], "aaaa", "a", ""}, {*words[30:120], *list(made)[20:], "aaa", "éa", "a"}
    predictions = spark.createDataFrame([(x,) for x in left] + [(None,)], "pred string")
    entries = spark.createDataFrame([(x,) for x in right] + [(None,)], "brand string")
    good = {(x, y) for x in left for y in right if x and y and similarity(x, y) >= accept}
    found = {tuple(r) for r in text.entry_candidates(predictions, "pred", entries, "brand", accept).select("pred", "brand").collect()}
    assert good <= found
    out = {r.pred: (r.brand_mapped, r.score) for r in text.best_entries(predictions, "pred", entries, "brand", accept).collect()}
    for x in left - {""}:
        best = min(((-similarity(x, y), y) for a, y in good if a == x), default=(0, "not-detected"))
        assert out[x] == (best[1], -best[0])


def test_few_entries_are_candidates(spark, folder):
    """Of all pairs of benchmark words and dictionary entries less than one in twenty is scored."""
    from aisle.plans.text import _dictionary
    from aisle.sources.retail import Tables

    tables = Tables(spark, folder)
    words = tables.benchmark.select(F.explode(titles.tokens_of("text")).alias("pred")).distinct()
    entries = _dictionary(tables).select("brand").distinct()
    assert text.entry_candidates(words, "pred", entries, "brand").count() < 0.05 * words.count() * entries.count()


def test_title_rules(spark):
    frame = spark.createDataFrame([("[combo] x dove 5kg",), ("baby dove 500, new!",), ("dvoe 12 34",)], "t string")
    out = frame.select(
        titles.keep_combo("t").alias("combo"), titles.clean_title("t").alias("clean"),
        titles.first_keyword("t", {"dove": "DOVE", "baby dove": "BABY DOVE"}).alias("brand"),
        titles.pack_type("t", F.lit(2)).alias("pack")).collect()
    assert [r.combo for r in out] == ["combo  x dove 5kg", "baby dove 500, new!", "dvoe 12 34"]
    assert [r.clean for r in out] == ["x dove 5kg", "baby dove new", "dvoe"]
    assert [r.brand for r in out] == ["DOVE", "BABY DOVE", None]
    assert [r.pack for r in out] == ["combo", "single", "single"]


def test_standardize_composes_compatibility_forms(spark):
    frame = spark.createDataFrame([("ﬁne Ａ é",)], "t string")
    assert frame.select(titles.standardize("t")).first()[0] == "fine a é"


def test_fuzzy_brands_and_family(spark):
    rows = [(1, "clear men shampoo"), (2, "cleer for hair"), (3, "nothing here"), (4, "clear men and dove soap")]
    frame = spark.createDataFrame(rows, "id bigint, t string")
    brands = spark.createDataFrame([("clear", "clear"), ("clear men", "clear men"), ("dove", "dove")], "brand string, family string")
    found = text.fuzzy_brands(frame, "id", "t", brands, "brand")
    assert {(r.id, r.brand, r.ratio) for r in found.collect()} == {
        (1, "clear", 100), (1, "clear men", 100), (4, "clear", 100), (4, "clear men", 100), (4, "dove", 100)}
    final = text.main_brand(frame, "id", "t", found, "brand", brands, "family").collect()
    assert {r.id: r.brand_final for r in final} == {
        1: "clear|clear men", 2: "not-detected", 3: "not-detected", 4: "clear|clear men|dove"}


def test_entries_of_three_words(spark):
    frame = spark.createDataFrame([(1, "buy baby dove dermaseries soap now"), (2, None)], "id bigint, t string")
    brands = spark.createDataFrame([("baby dove dermaseries", "dove"), ("dove", "dove")], "brand string, family string")
    found = text.fuzzy_brands(frame, "id", "t", brands, "brand")
    assert {(r.brand, r.ratio) for r in found.collect()} == {("baby dove dermaseries", 100), ("dove", 100)}
    final = text.main_brand(frame, "id", "t", found, "brand", brands, "family")
    assert {r.id: r.brand_final for r in final.collect()} == {1: "dove", 2: "not-detected"}
