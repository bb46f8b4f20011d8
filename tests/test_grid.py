import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.operators import components as cc
from inkloom.operators import fingerprint as fp
from inkloom.operators import grid, plate, segments
from inkloom.operators.masks import keep_distinct_instances, layer_pairs

PIX = "image_id int, y int, x int, gray int"


def px(spark, arr, image=0):
    h, w = arr.shape
    return spark.createDataFrame([(image, y, x, int(arr[y, x])) for y in range(h) for x in range(w)], PIX)


def canvas(spark, arr, image=0):
    return spark.createDataFrame([(image, *arr.shape)], "image_id int, h int, w int")


def mask(spark, arr, layer="m"):
    return spark.createDataFrame([(0, layer, int(y), int(x)) for y, x in zip(*np.nonzero(arr))], "image_id int, layer string, y int, x int")


def back(df, shape, col=None):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[col] if col else 1
    return out


def mirror(i, n):
    if n == 1:
        return 0
    m = i % (2 * (n - 1))
    return m if m < n else 2 * (n - 1) - m


@pytest.mark.parametrize("shape,sigma", [((300, 9), 2.0), ((5, 270), 4.0), ((7, 1), 1.0)])
def test_smoothing_across_tiles(spark, shape, sigma):
    arr = np.random.default_rng(1).integers(0, 256, shape)
    got = back(grid.gaussian(px(spark, arr), canvas(spark, arr), "gray", sigma), shape, "gray")
    w = np.array(grid.gaussian_weights(sigma))
    r = len(w) // 2
    h, n = shape
    rows = sum(w[i + r] * arr[:, [mirror(x + i, n) for x in range(n)]] for i in range(-r, r + 1))
    want = sum(w[i + r] * rows[[mirror(y + i, h) for y in range(h)]] for i in range(-r, r + 1))
    assert np.allclose(got, want)


def brute(m, offs, op):
    h, w = m.shape
    out = np.zeros_like(m)
    for y in range(h):
        for x in range(w):
            vals = [m[y + a, x + b] for a, b in offs if 0 <= y + a < h and 0 <= x + b < w]
            out[y, x] = op(vals)
    return out


@pytest.mark.parametrize("k", [2, 3, 5])
@pytest.mark.parametrize("tile", [4, 1024])
def test_square_kernels(spark, k, tile):
    m = np.random.default_rng(k).random((19, 14)) < 0.7
    offs = [(a, b) for a in range(-(k // 2), k - k // 2) for b in range(-(k // 2), k - k // 2)]
    c = canvas(spark, m)
    assert (back(grid.erode(mask(spark, m), c, k, k, tile=tile), m.shape) == brute(m, offs, min)).all()
    sparse = m & (np.random.default_rng(9).random(m.shape) < 0.2)
    got = grid.dilate(mask(spark, sparse), c, k, k, tile=tile)
    assert (back(got, m.shape) == brute(sparse, offs, max)).all()
    assert got.count() == got.distinct().count()


def test_ellipse_kernels(spark):
    m = np.random.default_rng(5).random((15, 15)) < 0.8
    offs = list(grid.ellipse_offsets(5))
    assert len(offs) == 17 and set(grid.ellipse_offsets(3)) == {(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)}
    c = canvas(spark, m)
    assert (back(grid.erode_ellipse(mask(spark, m), c, 5), m.shape) == brute(m, offs, min)).all()
    assert (back(grid.dilate_ellipse(mask(spark, m & (m.cumsum(0) % 4 == 1)), c, 5), m.shape) == brute(m & (m.cumsum(0) % 4 == 1), offs, max)).all()


def flood(m, diagonal):
    h, w = m.shape
    lab = -np.ones(m.shape, dtype=np.int64)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for y in range(h):
        for x in range(w):
            if m[y, x] and lab[y, x] < 0:
                code, stack = (y << cc.ROW_BITS) + x, [(y, x)]
                lab[y, x] = code
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        p, q = a + dy, b + dx
                        if 0 <= p < h and 0 <= q < w and m[p, q] and lab[p, q] < 0:
                            lab[p, q] = code
                            stack.append((p, q))
    return lab


@pytest.mark.parametrize("tile", [5, 256])
@pytest.mark.parametrize("diagonal", [True, False])
def test_components_do_not_depend_on_tiles(spark, tile, diagonal):
    rng = np.random.default_rng(7)
    m = rng.random((31, 23)) < 0.45
    m[3, :] = True
    m[:, 11] = True
    want = flood(m, diagonal)
    got = {(r.y, r.x): r.label for r in cc.connected_components(mask(spark, m), diagonal=diagonal, tile=tile).repartition(3).collect()}
    assert got == {(y, x): want[y, x] for y, x in zip(*np.nonzero(m))}


def test_snake_crosses_many_tiles(spark):
    m = np.zeros((24, 24), dtype=bool)
    for i, y in enumerate(range(0, 24, 2)):
        m[y] = True
        if y + 1 < 24:
            m[y + 1, 23 if i % 2 == 0 else 0] = True
    lab = cc.connected_components(mask(spark, m), tile=4)
    assert lab.select("label").distinct().count() == 1


def test_islands(spark):
    pos = [0, 1, 2, 3, 4, 5, 9, 10, 15, 16, 17, 18, 19, 20, 21, 40]
    df = spark.createDataFrame([("k", p) for p in pos], "k string, y int")
    for tile in (4, 1000):
        got = sorted((r.start, r.end) for r in grid.islands(df, ["k"], "y", tile=tile).collect())
        assert got == [(0, 5), (9, 10), (15, 21), (40, 40)]


def test_instances_kept_in_order(spark):
    a = np.zeros((6, 6), dtype=bool)
    a[:4, :4] = True
    b, c = a.copy(), np.zeros_like(a)
    c[4:, :] = True
    m = mask(spark, a, "i1").union(mask(spark, b, "i2")).union(mask(spark, c, "i3"))
    order = spark.createDataFrame([(0, "i1", 2), (0, "i2", 1), (0, "i3", 3)], "image_id int, layer string, seq int")
    got = [r.layer for r in keep_distinct_instances(order, m).orderBy("pos").collect()]
    assert got == ["i2", "i3"]
    assert layer_pairs(m).first().iou == 1.0


def test_dark_dots_are_peaks(spark):
    arr = np.full((40, 40), 150)
    for y, x in ((8, 8), (20, 30), (32, 12)):
        arr[y - 1:y + 2, x - 1:x + 2] = 40
    hits = {(r.y, r.x) for r in plate.micro_holes(px(spark, arr), canvas(spark, arr), threshold=3.0).collect()}
    assert {(8, 8), (20, 30), (32, 12)} <= hits


def test_copper_and_gold_are_apart(spark):
    rows = [(0, y, x, *((30, 80, 220) if x < 10 else (30, 190, 210))) for y in range(12) for x in range(20)]
    p = spark.createDataFrame(rows, "image_id int, y int, x int, b int, g int, r int")
    out = plate.split_foils(p, p, spark.createDataFrame([(0, 12, 20)], "image_id int, h int, w int"))
    n = {r.layer: r["count"] for r in out.groupBy("layer").count().collect()}
    assert n["copper"] > 0 and n["gold"] > 0
    assert out.groupBy("y", "x").count().where("count > 1").count() == 0


def test_occlusion_zone_equals_its_metric(spark):
    fg, bg = np.zeros((140, 140), dtype=bool), np.zeros((140, 140), dtype=bool)
    fg[40:80, 50:90] = True
    bg[50:120, 20:130] = True
    m = mask(spark, fg, "fg").union(mask(spark, bg, "bg"))
    order = spark.createDataFrame([(0, "fg", 1), (0, "bg", 2)], "image_id int, layer string, pos int")
    c = canvas(spark, fg)
    z = plate.occlusion_zones(m, order, c)
    met = plate.occlusion_metrics(z, c).first()
    assert met.reconstruction_pixel_count == z.count() > 0 and z.select("layer").distinct().collect()[0][0] == "bg"


def test_otsu_splits_two_levels(spark):
    arr = np.where(np.arange(100).reshape(10, 10) % 2, 200, 30)
    assert 30 <= segments.otsu_threshold(px(spark, arr)).first().threshold < 200


def test_texture_across_tiles(spark):
    arr = np.random.default_rng(2).integers(0, 256, (20, 17))
    a = fp.lbp_codes(px(spark, arr), tile=6).select("y", "x", "code")
    b = fp.lbp_codes(px(spark, arr), tile=128).select("y", "x", "code")
    assert a.exceptAll(b).count() == 0 and a.count() == arr.size


def test_trap_width(spark):
    from inkloom.operators.rules import trap_width_px
    df = spark.createDataFrame([(0.2, 150.0), (0.4, 300.0)], "mm double, ppi double")
    assert [r[0] for r in df.select(trap_width_px(F.col("mm"), F.col("ppi"))).collect()] == [1, 5]


@pytest.mark.parametrize("dst,want", [((180_000, 6), {(0, 0, 5.0), (1, 2, 5.0), (179_998, 3, 7.0), (179_999, 5, 7.0)}), ((45_000, 1), {(0, 0, 5.0), (44_999, 0, 7.0)})])
def test_resample_of_images_with_very_many_lines(spark, dst, want):
    src = spark.createDataFrame([(0, 90_000, 2)], "image_id int, h int, w int")
    tall = spark.createDataFrame([(0, 0, 0, 5), (0, 89_999, 1, 7)], PIX)
    got = {(r.y, r.x, r.gray) for r in grid.resample(tall, src, spark.createDataFrame([(0, *dst)], src.schema)).collect()}
    assert want <= got and len(got) == (12 if dst[1] == 6 else 2)
