import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkloom.llm import quality_classifier as qc
from inkloom.llm import toxicity as tox
from inkloom.llm.quality_rules_fit import Condition, decision_list, lasso_logistic, rule_holds, sparse_ensemble
from inkloom.llm.words import word_chunks


def corpus(n=240):
    rnd = random.Random(2)
    plain = [f"{a}{b}" for a in "bcdfgmnprst" for b in ("ado", "imel", "ona", "ery", "ust")]
    bad = ["vilething", "vilest", "grimslur"]
    rows = []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))]
        y = i % 3 == 0
        if y:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    f = tox.Field(np.zeros(1), np.array([-1.0, -0.5, 0.7]), -0.3, (0.0, 1.0))
    emit, first = rng.normal(size=9), np.array([0, 4, 4, 9])
    logit = tox.marginals(emit, first, f)[2]
    for lo, hi in ((0, 4), (4, 9)):
        n, mass = hi - lo, np.zeros((hi - lo, 2))
        for code in range(1 << n):
            y = [code >> i & 1 for i in range(n)]
            s = f.start * y[0] + sum(emit[lo + i] * y[i] for i in range(n))
            s += sum({(0, 1): f.moves[0], (1, 0): f.moves[1], (1, 1): f.moves[2]}.get((a, b), 0.0) for a, b in zip(y, y[1:]))
            for i in range(n):
                mass[i, y[i]] += np.exp(s)
        assert np.allclose(logit[lo:hi], np.log(mass[:, 1] / mass[:, 0]))


def test_toxic_words_are_found_in_held_out_texts_with_their_places():
    rows = corpus()
    f = tox.fit([r[1] for r in rows[:160]], [r[2] for r in rows[:160]])
    held = rows[160:] + [(0, "", 0), (0, None, 0), (0, "vilestone " + "bado " * 3000, 1)]
    out = tox.score_texts(pa.array([r[1] for r in held]), f)
    right = [(s >= 0.5) == bool(r[2]) for s, r in zip(out["score"], held)]
    assert np.mean(right) > 0.95 and out["score"][-2] == out["score"][-3]
    for r, spans in zip(held, out["spans"]):
        assert all(r[1][s["start"]:s["end"]].startswith(("vile", "grim")) for s in spans)


def test_no_labels_and_one_class():
    for y in ([], [1, 1]):
        f = tox.fit(["a b"] * len(y), y)
        assert not f.weights.any() and 0 <= tox.score_texts(pa.array(["a", None]), f)["score"][0] <= 1


def test_frames_are_scored_whole(spark, odd_docs, no_docs):
    rows = corpus(90)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[2]) for r in rows] + [(5, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    field = tox.fit_field(docs, labels)
    assert tox.tag_toxic(odd_docs, field).count() == odd_docs.count() and tox.tag_toxic(no_docs, field).count() == 0
    model = qc.fit_rules(docs, labels)
    got = qc.score_quality(odd_docs, model)
    assert got.count() == odd_docs.count() and got.where(~F.col("score").between(0, 1)).count() == 0
    assert qc.score_quality(no_docs, qc.fit_rules(no_docs, labels.limit(0))).count() == 0


def test_column_expression_equals_the_rules(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 3)).round(2)
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(int)
    rules, b = sparse_ensemble(x, y)
    z = b + sum(w * rule_holds(r, x) for r, w in rules)
    assert np.mean((z > 0) == (y == 1)) > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.select(qc.compiled(rules, b, ["a", "b", "c"])).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_statistics_by_hand():
    (_, _, w), = word_chunks(pa.array(["Aa aa bb!\nAa aa bb!\n", "", "a1 a1 a1"]))
    s = dict(zip(qc.STATISTICS, qc.statistics(w).T))
    assert s["n_words"].tolist() == [6, 0, 3] and s["word_length"].tolist() == [2, 0, 2]
    assert s["distinct_lines"][0] == 0.5 and s["distinct_words"].tolist() == [2 / 6, 0, 1 / 3]
    assert s["repeated_pairs"].tolist() == [2 / 6, 0, 2 / 3] and s["top_word"][2] == 1


def test_decision_list_covers_in_order_and_lasso_is_sparse():
    rng = np.random.default_rng(4)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))).astype(int)
    rules = decision_list(x, y)
    hit = np.zeros(600, dtype=bool)
    for r in rules:
        hit |= rule_holds(r, x)
    assert len(rules) >= 2 and (hit & (y == 0)).mean() < 0.02 and (hit & (y == 1)).sum() > 0.85 * y.sum()
    assert decision_list(x, np.zeros(600, int)) == [] and isinstance(rules[0][0], Condition)
    w, _ = lasso_logistic((x > 0.5).astype(float), (x[:, 0] > 0.5).astype(float), 0.05)
    assert abs(w[0]) > 0.5 and np.abs(w[1:]).max() < 0.1
