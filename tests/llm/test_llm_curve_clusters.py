import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from inkloom.llm.curve_clusters import candidates, cluster, distances, hilbert_keys, integers, op11_curve_clusters


def brute(rows, k, rounds, width, scale):
    """Plain clustering over (id, vector): (id, cluster, distance) and centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, cv)), j) for j, cv in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), x in zip(kept, of) if x == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), c


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (8, 1)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = hilbert_keys(cells, bits)
    assert sorted(key.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_no_box_loses_a_centroid_that_is_nearest_somewhere():
    rng = np.random.default_rng(3)
    pruned = 0
    for _ in range(300):
        x = rng.normal(rng.normal(0, 30, 5), rng.uniform(0, 20), (40, 5))
        c = rng.normal(0, 30, (9, 5))
        may = candidates(x.min(axis=0), x.max(axis=0), c)
        best = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        assert set(best) <= set(may.tolist())
        pruned += 9 - len(may)
    assert pruned > 300


def test_odd_vectors_and_large_components():
    rows, x = integers(pa.array([[1.0, -0.3], None, [1.0], [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], [], [1e30, -1e30]], pa.list_(pa.float32())), 2, 64)
    assert rows.tolist() == [0, 7] and x.tolist() == [[64, -20], [1 << 26, -(1 << 26)]]
    far = distances(np.array([[1 << 26, 3]], dtype=np.int32), np.array([[-(1 << 26), 4]]))
    assert far.tolist() == [[(1 << 54) + 1]]


@pytest.mark.parametrize("hot", [False, True])
def test_clusters_equal_plain_ones(spark, hot):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss((i % 5) * 0.7, 0.2 + 0.2 * (i % 3)) for _ in range(4)]) for i in range(400)]
    rows += [(7, [0.25, 0.25, -0.25, 0.0])] * (300 if hot else 2)
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan] * 4), (904, [0.0, math.inf, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, centroids, share = cluster(df, k=6, rounds=3, width=4, block=16)
    want, c = brute(rows, 6, 3, 4, 64)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=str) == want
    assert centroids.tolist() == c and 0 < share < 0.8


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got, centroids, _ = cluster(df, k=5, width=2)
    assert sorted(tuple(r) for r in got.collect())[0][2] == 0 and len(centroids) == 3
    none, centroids, _ = cluster(df.where("vec_id > 5"), width=2)
    assert none.count() == 0 and len(centroids) == 0
    assert cluster(df)[0].count() == 0  # no vector of 64


def test_query_columns(spark):
    got = op11_curve_clusters(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = got.collect()
    assert {r["inertia"] for r in rows} == {sum(r["distance"] for r in rows)}
    source = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, c = brute(source, 16, 3, 64, 64)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=str) == want
    assert {(r["cluster"], r["centroid_sha256"]) for r in rows} == \
        {(j, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for j, v in enumerate(c) if any(w[1] == j for w in want)}
