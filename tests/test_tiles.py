import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_grid import back, canvas, flood, px

from inkloom.operators import fingerprint as fp
from inkloom.operators import grid, plate, segments
from inkloom.operators.tiles import on_tiles


def plain_edges(g, low, high):
    """Hysteresis edges, pixel by pixel."""
    h, w = g.shape
    at = lambda y, x: int(g[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    dx, dy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            dx[y, x] = sum(k * (at(y + i, x + 1) - at(y + i, x - 1)) for i, k in ((-1, 1), (0, 2), (1, 1)))
            dy[y, x] = sum(k * (at(y + 1, x + i) - at(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    size = abs(dx) + abs(dy)
    mag = lambda y, x: size[y, x] if 0 <= y < h and 0 <= x < w else 0
    weak, strong = np.zeros((h, w), bool), np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            m, angle = size[y, x], math.degrees(math.atan2(abs(dy[y, x]), abs(dx[y, x]))) if size[y, x] else 0
            if m <= low:
                continue
            if angle < 22.5:
                top = m > mag(y, x - 1) and m >= mag(y, x + 1)
            elif angle > 67.5:
                top = m > mag(y - 1, x) and m >= mag(y + 1, x)
            else:
                s = -1 if (dx[y, x] < 0) != (dy[y, x] < 0) else 1
                top = m > mag(y - 1, x - s) and m > mag(y + 1, x + s)
            weak[y, x], strong[y, x] = top, top and m > high
    lab = flood(weak, True)
    return weak & np.isin(lab, np.unique(lab[strong]))


@pytest.fixture(scope="module")
def picture():
    rng = np.random.default_rng(6)
    g = rng.integers(90, 130, (41, 37))
    g[5:30, 8:9] = 255  # a long edge over many small tiles
    g[20:21, 3:36] = 0
    g[25:38, 20:33] += np.arange(13)[:, None] * 8
    return np.clip(g, 0, 255)


@pytest.mark.parametrize("tile", [8, 256])
def test_edges_equal_plain_ones(spark, picture, tile):
    got = back(fp.edge_pixels(px(spark, picture), canvas(spark, picture), tile=tile), picture.shape)
    want = plain_edges(picture, 50, 150)
    assert (got.astype(bool) == want).all() and 0.02 < want.mean() < 0.9
    share = fp.edge_density(px(spark, picture), canvas(spark, picture), tile=tile).first().edge_density
    assert share == pytest.approx(want.mean())


def test_weak_edges_count_only_beside_strong_ones(spark):
    g = np.full((12, 60), 100)
    g[:, 30:] = 120          # a step of 80: weak alone
    alone = fp.edge_pixels(px(spark, g), canvas(spark, g), tile=8)
    assert alone.count() == 0
    g[0, 30:] = 160          # one strong end carries the whole line across tiles
    got = back(fp.edge_pixels(px(spark, g), canvas(spark, g), tile=8), g.shape)
    assert (got.astype(bool) == plain_edges(g, 50, 150)).all() and got.sum() >= 11
    flat = np.full((5, 5), 7)
    assert fp.edge_density(px(spark, flat), canvas(spark, flat)).first().edge_density == 0


@pytest.mark.parametrize("tile", [8, 256])
def test_co_occurrence_holes_voids_and_panels_do_not_depend_on_tiles(spark, picture, tile):
    p, c = px(spark, picture), canvas(spark, picture)
    q = picture // 16
    pairs = np.zeros((16, 16))
    np.add.at(pairs, (q[:, :-1], q[:, 1:]), 1)
    pairs = (pairs + pairs.T) / (pairs + pairs.T).sum()
    row = fp.glcm_features(p, c, tile=tile).where("angle = 'a0'").first()
    i, j = np.indices(pairs.shape)
    assert row.energy == pytest.approx(np.sqrt((pairs ** 2).sum())) and row.contrast == pytest.approx((pairs * (i - j) ** 2).sum())
    blur = [back(grid.gaussian(p, c, "gray", s), picture.shape, "gray") for s in (0.9, 2.0)]
    dog = blur[1] - blur[0]
    pad = np.pad(dog, 1, constant_values=-np.inf)
    peak = (dog > 4.5) & (dog >= pad[:-2, 1:-1]) & (dog >= pad[2:, 1:-1]) & (dog >= pad[1:-1, :-2]) & (dog >= pad[1:-1, 2:]) & (picture < 225)
    assert (back(plate.micro_holes(p, c, tile=tile), picture.shape).astype(bool) == peak).all() and peak.any()
    coloured = p.withColumns({"r": F.col("gray"), "b": F.col("gray") - F.when(F.col("x") % 3 == 0, 60).otherwise(0)})
    whole = plate.void_pixels(coloured, c, desk_gray=120.0, edge_energy=60.0, tile=1024).collect()
    assert {tuple(r) for r in plate.void_pixels(coloured, c, desk_gray=120.0, edge_energy=60.0, tile=tile).collect()} == {tuple(r) for r in whole} and whole
    framed = np.full((41, 37), 50)
    framed[8:30, 7:25] = 200
    assert tuple(segments.sample_panel(px(spark, framed), canvas(spark, framed), tile=tile).first()) == (0, 7, 29, 6, 24)
    ink = px(spark, framed).where("gray < 100").select("image_id", "y", "x")
    built = [{tuple(r) for r in segments.buildings(px(spark, framed), ink, canvas(spark, framed), run=5, close=3, min_area=5, tile=t)[0].collect()} for t in (tile, 1024)]
    assert built[0] == built[1] and built[0]


def test_tiles_see_only_known_pixels_and_mirror_the_rest(spark):
    g = np.arange(35).reshape(5, 7)
    p = px(spark, g).where("NOT (y = 2 AND x = 3)")
    seen = on_tiles(p, canvas(spark, g), ["gray"], 2, lambda t: {**t.pixels(t.inside()), "left": t.around("gray", 1)[1:-1, :-2][t.inside()]}, "y int, x int, left double", 8)
    rows = {(r.y, r.x): r.left for r in seen.collect()}
    assert len(rows) == 34 and (2, 3) not in rows
    assert rows[(1, 0)] == g[1, 1] and rows[(4, 6)] == g[4, 5] and rows[(2, 4)] == 0


def test_structure_features_over_a_blank_and_a_lined_picture(spark):
    g = np.zeros((60, 60), dtype=int)
    g[10:14, 5:55] = 255
    g[30:50, 30:50] = 255
    p = px(spark, g).unionByName(px(spark, np.full((6, 6), 9), 1))
    c = canvas(spark, g).unionByName(canvas(spark, np.zeros((6, 6)), 1))
    got = {r.image_id: r for r in fp.structure_features(p, c).collect()}
    assert got[0].n_components == 2 and got[0].area_mean == pytest.approx(300 / 3600) and got[0].area_std == pytest.approx(100 / 3600)
    assert got[0].text_density == pytest.approx(1 / 3) and got[0].edge_density == pytest.approx(plain_edges(g, 50, 150).mean())
    assert (got[1].edge_density, got[1].n_components, got[1].area_mean, got[1].text_density) == (0, 0, 0, 0)
