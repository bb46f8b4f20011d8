import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.operators.episodes import category_priors
from inkloom.operators.rollup import lifted_moments, lifted_percentiles

PARENT = {"a": "root", "b": "root", "c": "a", "d": "a", "e": "b", "lone": None, "root": None}


def below(name):
    out = [name]
    for n in out:
        out += [k for k, p in PARENT.items() if p == n and k not in out]
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(9)
    rows = [("c", float(v)) for v in np.exp(rng.normal(0, 3, 900))] + [("d", 0.25)] * 700 + [("d", 0.25 + 1e-9 * i) for i in range(300)]
    rows += [("e", float(v)) for v in rng.random(40)] + [("a", 7.5), ("lone", 3.0), ("b", -1.0), ("b", 0.0), ("b", None)]
    closure = [(k, p) for k in PARENT for p in PARENT if k != p and k in below(p)]
    return rows, spark.createDataFrame(rows, "category_id string, v double"), spark.createDataFrame(closure, "category_id string, ancestor string")


@pytest.mark.parametrize("bins,fine", [(4096, 1 << 20), (2, 4)])
def test_percentiles_of_all_values_below(world, bins, fine):
    rows, df, closure = world
    probs = {"low": 0.1, "mid": 0.5, "high": 0.9, "top": 1.0, "least": 0.0}
    got = {r["category_id"]: r for r in lifted_percentiles(df, closure, probs, bins=bins, fine=fine).collect()}
    for name in PARENT:
        mine = [v for k, v in rows if k in below(name) and v is not None and v > 0]
        if not mine:
            assert name not in got
            continue
        for n, p in probs.items():
            assert got[name][n] == pytest.approx(np.percentile(mine, 100 * p), rel=1e-12), (name, n)
    alone = {r["category_id"]: r.mid for r in lifted_percentiles(df, None, {"mid": 0.5}, bins=bins, fine=fine).collect()}
    assert set(alone) == {"a", "c", "d", "e", "lone"} and alone["lone"] == 3.0


def test_moments_merge_without_cancelling(spark, world):
    rows, df, closure = world
    shifted = df.where("v IS NOT NULL").select("category_id", (F.col("v") + 1e8).alias("v"))
    got = {r["category_id"]: r for r in lifted_moments(shifted, closure, ["v"]).collect()}
    for name in PARENT:
        mine = np.array([v + 1e8 for k, v in rows if k in below(name) and v is not None])
        assert got[name].n_samples == len(mine) and got[name].v_mean == pytest.approx(mine.mean(), rel=1e-12)
        assert got[name].v_std == pytest.approx(mine.std(), rel=1e-6, abs=1e-7)


def test_no_box_is_copied_to_its_ancestors(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}" if i < 9 else None) for i in range(10)], "id string, parent_id string")
    boxes = spark.range(4000).select((F.col("id") % 50).alias("episode_id"), F.lit("c0").alias("category_id"), (0.1 + (F.col("id") % 7) / 10).alias("w"), F.lit(0.5).alias("h"))
    got = category_priors(boxes, chain).collect()
    area = (0.1 + (np.arange(4000) % 7) / 10) * 0.5
    assert len(got) == 10 and {r.n_samples for r in got} == {4000} and {r.n_components_mode for r in got} == {80}
    assert all(r.area_budget_min == pytest.approx(np.percentile(area, 10)) and r.area_budget_max == pytest.approx(np.percentile(area, 90)) for r in got)
    assert category_priors(boxes.limit(0), chain).count() == 0
