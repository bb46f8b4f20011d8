import random

import numpy as np

from inkloom.operators.quantiles import exact_percentiles
from inkloom.operators.ranking import fill_forward, global_rank, previous_value
from inkloom.operators.similarity import top_similar


def test_percentiles_with_one_hot_group(spark):
    rng = np.random.default_rng(0)
    data = {"hot": rng.normal(size=30000), "ties": np.repeat([1.0, 2.0, 5.0], 400), "tiny": np.array([3.0, 9.0]), "one": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0, "p0": 0.0}
    # accuracy 200: the hot group takes the bracket path
    for acc in (200, 100000):
        for r in exact_percentiles(df, ["k"], "v", probs, accuracy=acc).collect():
            for n, p in probs.items():
                assert abs(r[n] - np.percentile(data[r.k], p * 100)) < 1e-12, (acc, r.k, n)
    whole = exact_percentiles(df, [], "v", {"m": 0.5}, accuracy=300).first().m
    assert abs(whole - np.percentile(np.concatenate(list(data.values())), 50)) < 1e-12


def test_chunked_windows(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice(["a", "b", None])) for k in ("x", "y") for i in sorted(rng.sample(range(500), 120))]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    for chunk in (5, 4096):
        prev = {(r.k, r.i): r.p for r in previous_value(df, ["k"], "i", "v", "p", chunk).collect()}
        filled = {(r.k, r.i): r.f for r in fill_forward(df, ["k"], "i", "v", "f", chunk).collect()}
        for key in ("x", "y"):
            last, seen = None, None
            for k, i, v in rows:
                if k != key:
                    continue
                assert prev[(k, i)] == last
                seen = v if v is not None else seen
                assert filled[(k, i)] == seen
                last = v


def test_global_rank(spark):
    vals = list(range(1000))
    random.Random(2).shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "v long").repartition(7)
    assert all(r.pos == r.v + 1 for r in global_rank(df, ["v"]).collect())


def test_similarity_literals(spark):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(1000, 128))
    index = spark.createDataFrame([(i, [float(x) for x in v], i % 2 == 0) for i, v in enumerate(vecs)] + [(5000, [0.0] * 128, True)],
                                  "task_id long, embedding array<double>, audit_passed boolean")
    near = vecs[10] + 0.1 * rng.normal(size=128)
    queries = spark.createDataFrame([(0, [float(x) for x in near]), (1, [float(x) for x in rng.normal(size=128)]), (2, [0.0] * 128)], "q long, vec array<double>")
    kw = dict(query_id="q", query_vec="vec")
    hit = top_similar(queries, index, min_similarity=0.7, **kw).collect()
    assert [(r.q, r.task_id) for r in hit] == [(0, 10)] and hit[0].similarity >= 0.7
    assert top_similar(queries.where("q = 1"), index, min_similarity=0.9, **kw).count() == 0
    best = top_similar(queries.where("q = 1"), index, min_similarity=-1.0, **kw).collect()
    assert len(best) == 5 and all(r.task_id % 2 == 0 and -1 <= r.similarity <= 1 for r in best)
    # more queries than a block holds: several passes, same answer
    many = spark.createDataFrame([(i, [float(x) for x in vecs[i]]) for i in range(25)], "q long, vec array<double>")
    a = top_similar(many, index, min_similarity=0.0, block_rows=4, **kw).select("q", "task_id", "rank")
    b = top_similar(many, index, min_similarity=0.0, **kw).select("q", "task_id", "rank")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    brute = {}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for i in range(25):
        s = unit @ unit[i]
        s[1::2] = -9
        brute[i] = set(np.argsort(-s)[:5])
    got = {}
    for r in b.collect():
        got.setdefault(r.q, set()).add(r.task_id)
    assert got == brute


