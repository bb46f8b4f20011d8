import numpy as np
import pytest

from inkloom.operators import audit as au
from inkloom.operators import delivery as dl
from inkloom.operators import episodes as ep
from inkloom.operators import grid
from inkloom.plans import jobs
from inkloom.session import cut_lineage

LAYERS = "image_id int, layer string, position int, visible boolean, top int, btm int, lft int, rgt int"
FACTS = "image_id int, color_mode string, tac_max_pct double, plate_purity_ok boolean, generated_ratio double, has_manifest boolean, has_source boolean"


def colours(spark, arr, image=0):
    h, w, _ = arr.shape
    return spark.createDataFrame([(image, y, x, *map(int, arr[y, x]), int(0.114 * arr[y, x, 0] + 0.587 * arr[y, x, 1] + 0.299 * arr[y, x, 2] + 0.5)) for y in range(h) for x in range(w)],
                                 "image_id int, y int, x int, b int, g int, r int, gray int")


def run(spark, arr, masks, base, comp, has_source=True, extra_layers=()):
    h, w, _ = arr.shape
    rows = [(0, n, i, True, int(np.nonzero(m)[0].min()), int(np.nonzero(m)[0].max()) + 1, int(np.nonzero(m)[1].min()), int(np.nonzero(m)[1].max()) + 1)
            for i, (n, m) in enumerate(masks.items())] + list(extra_layers)
    layers = spark.createDataFrame(rows, LAYERS)
    mask = spark.createDataFrame([(0, n, int(y), int(x)) for n, m in masks.items() for y, x in zip(*np.nonzero(m))], "image_id int, layer string, y int, x int")
    canvases = spark.createDataFrame([(0, h, w)], "image_id int, h int, w int")
    facts = spark.createDataFrame([(0, "rgb", 280.0, True, 0.0, True, has_source)], FACTS)
    dims = jobs.delivery_audit(layers, mask, colours(spark, arr), base, canvases, comp, facts, layers.select("image_id", "layer"))
    return {r.dim: r for r in dims.collect()}


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(2)
    arr = rng.integers(196, 206, (12, 14, 3))
    arr[3:7, 4:9] = 20
    ink = np.zeros((12, 14), bool)
    ink[3:7, 4:9] = True
    return arr, ink, np.ones((12, 14), bool)


def test_lost_ink_and_low_frequency(spark, scene):
    arr, ink, whole = scene
    white = colours(spark, np.where(ink[..., None], 255, arr))  # the base lost the ink
    shift = np.clip(arr + 30, 0, 255)
    kept = run(spark, arr, {"01_Base_Ground": whole, "04_tree": ink}, white, colours(spark, shift))
    k = ep.DIM_KEYS
    assert kept[k[3]].passed and kept[k[3]].metrics["lost_px"] == 0 and kept[k[3]].metrics["ink_px"] == 20
    diff = (shift - arr).astype(float)
    assert kept[k[4]].metrics["rmse_raw"] == pytest.approx(np.sqrt((diff ** 2).mean()), abs=0.006)
    assert not kept[k[4]].passed and kept[k[4]].metrics["rmse_lowfreq"] == pytest.approx(30, abs=0.5)  # raw alone would pass
    w = np.array(grid.gaussian_weights(16.0))
    mirror = lambda i, n: (lambda m: m if m < n else 2 * (n - 1) - m)(i % (2 * (n - 1)))
    r = len(w) // 2
    low = sum(w[i + r] * diff[[mirror(y + i, 12) for y in range(12)]] for i in range(-r, r + 1))
    low = sum(w[i + r] * low[:, [mirror(x + i, 14) for x in range(14)]] for i in range(-r, r + 1))
    assert kept[k[4]].metrics["rmse_lowfreq"] == pytest.approx(np.sqrt((low ** 2).mean()), abs=0.006)
    part = ink.copy()
    part[3] = False
    lost = run(spark, arr, {"01_Base_Ground": whole, "04_tree": part, "13_Spot": whole}, white, colours(spark, arr))  # press work carries nothing
    assert not lost[k[3]].passed and lost[k[3]].metrics["lost_px"] == 5 and lost[k[3]].issue == "content lost" and lost[k[4]].passed


def test_without_source_or_base(spark, scene):
    arr, ink, whole = scene
    k = ep.DIM_KEYS
    blind = run(spark, arr, {"01_Base_Ground": whole, "04_tree": ink}, colours(spark, arr * 0), colours(spark, 255 - arr), has_source=False)
    assert [(blind[k[i]].passed, blind[k[i]].evaluated) for i in (3, 4)] == [(True, False)] * 2 and "ink_px" not in blind[k[3]].metrics
    bare = run(spark, arr, {"04_tree": ink}, colours(spark, arr).limit(0), colours(spark, arr))
    assert bare[k[3]].passed and not bare[k[5]].passed and bare[k[5]].issue == "no base layer"
    thin = run(spark, arr, {"01_Base_Ground": whole, "04_tree": ink}, colours(spark, arr).limit(1), colours(spark, arr))
    assert not thin[k[5]].passed and thin[k[5]].issue == "empty base layer" and thin[k[5]].metrics["opaque_pct"] == 0.6


def test_layers_boxes_and_repeated_instances(spark, scene):
    arr, ink, whole = scene
    k = ep.DIM_KEYS
    near = ink.copy()
    near[3, 4] = False
    masks = {"01_Base_Ground": whole, "03_seal_01": ink, "03_seal_02": near, "04_tree": ink}
    got = run(spark, arr, masks, colours(spark, arr), colours(spark, arr), extra_layers=[(0, "04_tree", 9, False, 3, 9, 4, 9), (0, "09_gone", 10, True, 0, 4, 0, 4)])
    assert got[k[2]].metrics["duplicate_pairs"] == 1 and not got[k[2]].passed  # the tree covers the same place under another name
    assert got[k[0]].metrics["duplicate_names"] == 1 and got[k[0]].metrics["invisible_layers"] == 1 and got[k[0]].metrics["layer_count"] == 6
    assert got[k[1]].metrics["res_mismatch"] == 2  # a box that is too tall, and a layer without pixels
    assert got[k[6]].na and got[k[7]].passed and au.verdict(spark.createDataFrame([(0, *r[1:]) for r in got.values()], "artifact int, dim string, passed boolean, evaluated boolean, na boolean, issue string, metrics map<string,double>")).first().failed_dims == 3


def test_more_layers_than_one_word_of_bits(spark):
    n = dl.BITS + 5
    masks = {f"{i:02d}_thing{chr(97 + i % 26)}{chr(97 + i // 26)}": np.eye(9, 12, k=i % 4, dtype=bool) for i in range(n)}
    arr = np.full((9, 12, 3), 90)
    got = run(spark, arr, masks, colours(spark, arr), colours(spark, arr))
    assert got[ep.DIM_KEYS[0]].metrics["content_layers"] == n and got[ep.DIM_KEYS[1]].metrics["res_mismatch"] == 0
    assert got[ep.DIM_KEYS[3]].metrics == {}  # no base layer to compare


def test_shuffles_do_not_grow_with_the_dimensions(spark, scene):
    arr, ink, whole = scene
    layers = spark.createDataFrame([(0, "04_tree", 1, True, 3, 7, 4, 9)], LAYERS)
    lists = cut_lineage(dl.layer_lists(layers, layers.select("image_id", "layer")))
    table = dl.pixel_table(spark.createDataFrame([(0, "04_tree", 3, 4)], "image_id int, layer string, y int, x int"), lists, *[colours(spark, arr)] * 3)
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Join") == 1
