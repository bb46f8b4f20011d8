import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.operators import similarity as sim


def vectors(spark, rows, name="task_id"):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<double>")


def brute(queries, index, k, least):
    out = {}
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    for q, v in queries:
        if v is None or not np.any(v):
            continue
        s = [(-round(float(unit(v) @ unit(w)), 12), i) for i, w in index if w is not None and np.any(w)]
        out[q] = [(i, r + 1) for r, (x, i) in enumerate(sorted(s)[:k]) if -x >= least]
    return {q: v for q, v in out.items() if v}


def groups(n, dims=24, centres=12, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return [(i, c[i % centres] + 0.05 * rng.normal(size=dims)) for i in range(n)]


@pytest.mark.parametrize("least", [-1.0, 0.7, 0.999])
@pytest.mark.parametrize("hot", [False, True])
def test_search_equals_brute_force(spark, least, hot):
    index = groups(400) + [(9000, None), (9001, [0.0] * 24)]
    if hot:
        index += [(10_000 + i, index[5][1]) for i in range(300)]  # one direction held by many
    rng = np.random.default_rng(1)
    queries = [(i, v + 0.01 * rng.normal(size=24)) for i, v in groups(40, seed=3)] + [(100, rng.normal(size=24)), (101, [0.0] * 24), (102, None), (103, index[5][1])]
    built = sim.build_index(vectors(spark, index).repartition(3), pivots=20, pack=16)
    got = {}
    for r in sim.search(vectors(spark, queries, "q"), built, query_id="q", query_vec="embedding", top_k=4, min_similarity=least, block_rows=7, spread=1, held=5).collect():
        got.setdefault(r.q, []).append((r.task_id, r["rank"]))
    assert {q: sorted(v, key=lambda x: x[1]) for q, v in got.items()} == brute(queries, index, 4, least)


def test_far_cells_are_skipped(spark):
    index, queries = groups(1200), groups(36)
    built = sim.build_index(vectors(spark, index), pivots=48, pack=32)
    assert built.size.sum() == 1200 and (built.low <= built.high)[built.size > 0].all()
    parts = np.ones(len(built.pivots), dtype=int)
    asked = sim._routed(vectors(spark, queries, "q"), built, parts, "q", "embedding", 5, -1.0, 512)
    met = asked.select(F.sum(F.size("qids")).alias("n")).first().n
    assert met < 0.3 * 36 * (built.size > 0).sum()  # of all queries times cells


def test_queries_stream_past_the_parts(spark):
    """Neither side is sorted: a sorted task would hold all queries that ask one part."""
    built = sim.build_index(vectors(spark, groups(60)), pivots=4, pack=16)
    found = sim.search(vectors(spark, groups(10), "q"), built, query_id="q", query_vec="embedding")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BuildLeft" in next(x for x in plan.split("\n") if "ShuffledHashJoin" in x)


def test_empty_sides(spark):
    none = vectors(spark, []).withColumn("audit_passed", F.lit(True))
    some = vectors(spark, groups(5)).withColumn("audit_passed", F.col("task_id") > 9)
    q = vectors(spark, groups(3), "q")
    for index in (none, some):  # nothing there, and nothing admitted
        got = sim.top_similar(q, index, query_id="q", query_vec="embedding")
        assert got.count() == 0 and got.columns == ["q", "task_id", "similarity", "rank"]
    assert sim.top_similar(q.limit(0), some, query_id="q", query_vec="embedding", only_audited=False).count() == 0


def joined_rows(found):
    """Rows that the join of a collected search has made."""
    todo = [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName() == "ShuffledHashJoin":
            return node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]


def test_queries_meet_tiles_instead_of_packs(spark):
    """Every pair of a joined row crosses to Python: a query went there once for each pack."""
    built = sim.build_index(vectors(spark, groups(600)), pivots=4, pack=16)
    found = sim.search(vectors(spark, groups(300), "q").coalesce(1), built, query_id="q", query_vec="embedding", min_similarity=-1.0)
    found.collect()
    assert built.packs.count() > 36 and joined_rows(found) <= 4  # one block of queries


def test_few_rows_are_multiplied_in_doubles(monkeypatch):
    rng, hits, find = np.random.default_rng(2), [], sim._hits
    q, m = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(200, 64)), rng.normal(size=(20_000, 64))))
    monkeypatch.setattr(sim, "_hits", lambda *a: hits.append(find(*a)) or hits[-1])
    best = sim._Best(q, np.full(200, np.pi), pa.int64(), 5, 0.2)
    best.offer(np.arange(200), pa.array(np.arange(20_000)), m, m.astype(np.float32), np.empty(sim.ROWS * sim.COLUMNS, np.float32))
    assert sum(map(len, hits[1:])) < 0.01 * 200 * 20_000
    assert best.ids.to_pylist() == [i for r in q for i in np.lexsort((np.arange(20_000), -np.round(m @ r, 12)))[:5]]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ties_and_odd_ids(spark, monkeypatch, kind):
    """Floats cannot tell these rows apart; ids come twice or are null; vectors are equal, point the same way or hold infinite numbers."""
    monkeypatch.setattr(sim, "TILE_BYTES", 8 * 24 * 40)
    monkeypatch.setattr(sim, "LOT_BYTES", 8 * 24 * 100)
    rng = np.random.default_rng(4)
    c = rng.normal(size=24)
    index = [(i % 230, c * (1 + i % 5)) for i in range(300)] + [(1000 + i, c + 1e-8 * rng.normal(size=24)) for i in range(300)]
    index += [(None, c), (None, 2 * c), (2000, [float("inf")] * 24)] + [(3000 + i, rng.normal(size=24)) for i in range(300)]
    index = [(i if i is None or kind == "long" else f"id{i}", v) for i, v in index]
    queries = [(i, c + 1e-8 * rng.normal(size=24)) for i in range(60)] + [(i, rng.normal(size=24)) for i in range(100, 130)] + [(7, c), (None, c), (None, -c)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in index], f"task_id {kind}, embedding array<double>").repartition(3)
    built = sim.build_index(frame, pivots=3, pack=16)
    got = {}
    for r in sim.search(vectors(spark, queries, "q"), built, query_id="q", query_vec="embedding", min_similarity=0.1, block_rows=16).collect():
        got.setdefault(r.q, []).append((r["rank"], r.similarity, r.task_id))
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    pairs = {}
    for q, v in queries:
        s = [(-round(float(unit(v) @ unit(w)), 12), i is not None, i) for i, w in index if np.isfinite(w).all()]
        pairs[q] = sorted(pairs.get(q, []) + [x for x in s if -x[0] >= 0.1], key=lambda x: (*x[:2], x[2] if x[1] else ""))[:5]
    same_order = {q: [(-s, i) for s, _, i in v] for q, v in pairs.items() if v}
    assert {q: [(s, i) for _, s, i in sorted(v, key=lambda x: x[0])] for q, v in got.items()} == same_order
