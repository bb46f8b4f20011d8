import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import lexicon as lx

CATS = "id string, name_zh string, name_en string"


def brute(names, cats):
    out = {}
    for name, tokens in names:
        best = None
        for cid, zh, en in cats:
            score = int(bool(zh) and zh in tokens) + len({w for w in (en or "").replace("_", " ").split() if w} & set(tokens))
            if score and (best is None or (-score, cid) < best):
                best = (-score, cid)
        if best:
            out[name] = (best[1], -best[0])
    return out


def world(seed, common=("all", "every")):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    cats = [(f"c{i:03d}", rnd.choice([None, "", "all", rnd.choice(words)]),
             "_".join([*rnd.sample(words, rnd.randint(0, 3)), *[c for c in common if rnd.random() < 0.8]]) or None) for i in range(60)]
    names = [(f"n{i}", rnd.sample([*words, *common, "unknown"], rnd.randint(0, 6))) for i in range(150)]
    return names, cats


@pytest.mark.parametrize("hot", [0, 3, 20, 64])
def test_best_match_equals_all_pairs(spark, hot):
    for seed in (1, 2):
        names, cats = world(seed)
        got = lx.best_word_match(spark.createDataFrame(names, "name string, tokens array<string>"), spark.createDataFrame(cats, CATS), hot)
        assert {r["name"]: (r["cid"], r["score"]) for r in got.collect()} == brute(names, cats)


def test_a_word_of_all_names_and_categories_adds_no_pairs(spark):
    n = 3000
    names = spark.range(n).select(F.concat(F.lit("n"), "id").alias("name"), F.array(F.lit("all"), F.concat(F.lit("x"), F.col("id") % 700)).alias("tokens"))
    cats = spark.range(n).select(F.format_string("c%05d", "id").alias("id"), F.lit("").alias("name_zh"), F.concat(F.lit("all_x"), "id").alias("name_en"))
    got = {r["name"]: r for r in lx.best_word_match(names, cats).collect()}
    assert len(got) == n and all(r["score"] == 2 and r["cid"] == f"c{int(name[1:]) % 700:05d}" for name, r in got.items())
    only = spark.createDataFrame([(f"n{i}", ["all", f"q{i}"]) for i in range(500)], "name string, tokens array<string>")
    assert {(r["cid"], r["score"]) for r in lx.best_word_match(only, cats).collect()} == {("c00000", 1)}


def test_names_settled_before_words(spark):
    cats = spark.createDataFrame([("c1", "雁", "Geese_Flock", "08_雁_Geese"), ("c2", "", "Geese", "09_Geese"), ("c3", None, None, None)],
                                 "id string, name_zh string, name_en string, name_template string")
    aliases = spark.createDataFrame([("c3", "Wild_Geese")], "category_id string, preset_name string")
    names = spark.createDataFrame([("08_Wild_Geese",), ("Geese",), ("07_Flock_Geese_雁",), ("nothing",), ("",), (None,), ("Geese",)], "name string")
    got = sorted(((r["name"], r["category_id"], r["tier"]) for r in lx.resolve_category_ids(names, cats, aliases).collect()), key=str)
    assert got == sorted([("08_Wild_Geese", "c3", 0), ("Geese", "c2", 1), ("Geese", "c2", 1), ("07_Flock_Geese_雁", "c1", 2), ("nothing", None, None),
                          ("", None, None), (None, None, None)], key=str)


def test_empty_tables(spark):
    names = spark.createDataFrame([], "name string, tokens array<string>")
    cats = spark.createDataFrame([], CATS)
    one = spark.createDataFrame([("n", ["a"])], "name string, tokens array<string>")
    assert lx.best_word_match(names, spark.createDataFrame([("c", "a", "a")], CATS)).count() == 0
    assert lx.best_word_match(one, cats).count() == 0
