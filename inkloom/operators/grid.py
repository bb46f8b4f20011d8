"""Neighbourhood primitives on long pixel tables.

Work is grouped by image *and* tile, with the pixels a tile needs from its
neighbours copied in: windows by a tile of the line they run along, array code
by a square tile.  No group grows with the image, also when one image is most of
the table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs
from .images import with_image

TILE = 1024
SIZE_OF = {"y": "h", "x": "w"}
OTHER = {"y": "x", "x": "y"}


@lru_cache
def gaussian_weights(sigma: float, eight_bit: bool = False, radius: int | None = None) -> tuple[float, ...]:
    """Normalized taps; the radius follows the pixel depth as is usual for this filter."""
    if radius is None:
        size = int(round(sigma * (3 if eight_bit else 4) * 2 + 1)) | 1
        radius = size // 2
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return tuple(w / total for w in raw)


def _mirror_index(lo: int, hi: int, n: int) -> np.ndarray:
    """Source position of each position lo .. hi-1 of a line of ``n`` pixels."""
    if n == 1:
        return np.zeros(hi - lo, dtype=np.int64)
    p = np.mod(np.arange(lo, hi), 2 * (n - 1))
    return np.where(p < n, p, 2 * (n - 1) - p)


def _smooth_tiles(df: DataFrame, keys: list[str], value: str, weights: tuple[float, ...]) -> DataFrame:
    """Both passes on square tiles that carry their halo: one shuffle for any radius."""
    r = len(weights) // 2
    tile = max(256, 4 * r)
    last = lambda n: F.floor((F.col(n) - 1) / tile)
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - r) / tile)).cast("int"),
                                             F.least(last(n), F.floor((F.col(c) + r) / tile)).cast("int")))
    tiled = df.withColumn("_ty", span("y", "h")).withColumn("_tx", span("x", "w"))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", y int, x int, {value} double, h int, w int"
    taps = np.asarray(weights)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["h"].iloc[0]), int(pdf["w"].iloc[0])
        y0, x0 = int(pdf["_ty"].iloc[0]) * tile, int(pdf["_tx"].iloc[0]) * tile
        y1, x1 = min(h, y0 + tile), min(w, x0 + tile)
        ylo, xlo = max(0, y0 - r), max(0, x0 - r)
        grid = np.zeros((min(h, y1 + r) - ylo, min(w, x1 + r) - xlo))
        grid[pdf["y"].to_numpy() - ylo, pdf["x"].to_numpy() - xlo] = pdf[value].to_numpy()
        grid = grid[_mirror_index(y0 - r, y1 + r, h) - ylo][:, _mirror_index(x0 - r, x1 + r, w) - xlo]
        ny, nx = y1 - y0, x1 - x0
        rows = sum(taps[i] * grid[:, i:i + nx] for i in range(2 * r + 1))
        done = sum(taps[i] * rows[i:i + ny] for i in range(2 * r + 1))
        yy, xx = np.divmod(np.arange(ny * nx), nx)
        out = {k: [pdf[k].iloc[0]] * (ny * nx) for k in keys}
        return pd.DataFrame({**out, "y": yy + y0, "x": xx + x0, value: done.ravel(), "h": h, "w": w})

    return tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(solve, schema)


def gaussian(df: DataFrame, canvases: DataFrame, value: str, sigma: float, *, eight_bit: bool = False,
             radius: int | None = None, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Separable smoothing of a dense field, mirrored at the borders.

    Window expressions would need two shuffles, two sorts and every tap of the
    kernel per pixel; array arithmetic on tiles needs one shuffle and was faster
    at every radius that was timed.
    """
    weights = gaussian_weights(sigma, eight_bit, radius)
    ks = list(keys)
    base = with_image(df.select(*ks, "y", "x", F.col(value).cast("double").alias(value)), canvases)
    return _smooth_tiles(base, ks, value, weights).select(*ks, "y", "x", value)


# ---- square kernels on sparse masks ---------------------------------------

def _span(k: int) -> tuple[int, int]:
    return -(k // 2), k - 1 - k // 2


def _dilate_axis(mask: DataFrame, axis: str, keys: list[str], lo: int, hi: int, tile: int) -> DataFrame:
    """Positions p with a foreground pixel in p+lo .. p+hi; each is emitted once."""
    q, n = F.col(axis), F.col(SIZE_OF[axis])
    home = F.floor(q / tile)
    reach = hi - lo + 1
    tiles = F.when((q % tile < reach) & (home > 0), F.array(home - 1, home)).otherwise(F.array(home))
    df = mask.withColumn("_t", F.explode(tiles))
    w = Window.partitionBy(*keys, OTHER[axis], "_t").orderBy(axis)
    df = df.withColumn("_next", F.lead(axis).over(w)).where(F.floor(q / tile) == F.col("_t"))
    start = F.greatest(F.lit(0), q - hi)
    end = F.least(n - 1, q - lo, F.coalesce(F.col("_next") - hi - 1, q - lo))
    return df.where(start <= end).withColumn(axis, F.explode(F.sequence(start.cast("int"), end.cast("int")))).drop("_t", "_next")


def _erode_axis(mask: DataFrame, axis: str, keys: list[str], lo: int, hi: int, tile: int) -> DataFrame:
    """Foreground pixels whose whole span inside the canvas is foreground."""
    q, n = F.col(axis), F.col(SIZE_OF[axis])
    first, last = F.greatest(F.lit(0), F.floor((q - hi) / tile)), F.floor((q - lo) / tile)
    df = mask.withColumn("_t", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, OTHER[axis], "_t").orderBy(F.col(axis).cast("long")).rangeBetween(lo, hi)
    need = F.least(n - 1, q + hi) - F.greatest(F.lit(0), q + lo) + 1
    return df.withColumn("_c", F.count(F.lit(1)).over(w)).where(
        (F.floor(q / tile) == F.col("_t")) & (F.col("_c") == need)).drop("_t", "_c")


def _with_size(mask: DataFrame, canvases: DataFrame) -> DataFrame:
    return mask if "w" in mask.columns else with_image(mask, canvases)


def dilate(mask: DataFrame, canvases: DataFrame, kh: int, kw: int, keys=("image_id", "layer"), tile: int = TILE) -> DataFrame:
    m, ks = _with_size(mask, canvases), list(keys)
    if kw > 1:
        m = _dilate_axis(m, "x", ks, *_span(kw), tile)
    if kh > 1:
        m = _dilate_axis(m, "y", ks, *_span(kh), tile)
    return m.select(*ks, "y", "x", "h", "w")


def erode(mask: DataFrame, canvases: DataFrame, kh: int, kw: int, keys=("image_id", "layer"), tile: int = TILE) -> DataFrame:
    m, ks = _with_size(mask, canvases), list(keys)
    if kw > 1:
        m = _erode_axis(m, "x", ks, *_span(kw), tile)
    if kh > 1:
        m = _erode_axis(m, "y", ks, *_span(kh), tile)
    return m.select(*ks, "y", "x", "h", "w")


def opening(mask: DataFrame, canvases: DataFrame, kh: int, kw: int, keys=("image_id", "layer")) -> DataFrame:
    return _in_runs(mask, canvases, keys, (runs.open_runs, runs.rectangle(kh, kw)))


def closing(mask: DataFrame, canvases: DataFrame, kh: int, kw: int, keys=("image_id", "layer")) -> DataFrame:
    return _in_runs(mask, canvases, keys, (runs.close_runs, runs.rectangle(kh, kw)))


# ---- elliptic kernels ------------------------------------------------------

@lru_cache
def ellipse_offsets(k: int) -> tuple[tuple[int, int], ...]:
    """(dy, dx) of an elliptic kernel of odd size ``k``."""
    r = k // 2
    out = []
    for dy in range(-r, r + 1):
        dx = round(r * math.sqrt(max(0.0, (r * r - dy * dy) / (r * r)))) if r else 0
        out.extend((dy, j) for j in range(-dx, dx + 1))
    return tuple(out)


def _row_widths(k: int) -> dict[int, int]:
    widths: dict[int, int] = {}
    for dy, dx in ellipse_offsets(k):
        widths[dy] = max(widths.get(dy, 0), dx)
    return widths


def ellipse(k: int) -> runs.Kernel:
    """Elliptic kernel of odd size ``k`` as one interval per row."""
    return {dy: (-dx, dx) for dy, dx in _row_widths(k).items()}


def _in_runs(mask: DataFrame, canvases: DataFrame, keys, *steps) -> DataFrame:
    """``mask`` taken through ``steps`` of (operation, kernel) without leaving runs."""
    ks = tuple(keys)
    r = runs.to_runs(mask, canvases, ks)
    for step, kernel in steps:
        r = step(r, kernel, ks)
    return runs.to_pixels(r, ks)


def dilate_ellipse(mask: DataFrame, canvases: DataFrame, k: int, keys=("image_id", "layer")) -> DataFrame:
    return _in_runs(mask, canvases, keys, (runs.dilate_runs, ellipse(k)))


def erode_ellipse(mask: DataFrame, canvases: DataFrame, k: int, keys=("image_id", "layer")) -> DataFrame:
    """Foreground pixels that reach every kernel offset inside the canvas."""
    return _in_runs(mask, canvases, keys, (runs.erode_runs, ellipse(k)))


def close_ellipse(mask, canvases, k, keys=("image_id", "layer"), iterations: int = 1):
    """Closing; with ``iterations`` that many dilations, then as many erosions."""
    return _in_runs(mask, canvases, keys, *[(runs.dilate_runs, ellipse(k))] * iterations, *[(runs.erode_runs, ellipse(k))] * iterations)


def open_ellipse(mask, canvases, k, keys=("image_id", "layer")):
    return _in_runs(mask, canvases, keys, (runs.open_runs, ellipse(k)))


# ---- lines and sizes -------------------------------------------------------

def islands(df: DataFrame, keys: list[str], pos: str = "y", tile: int = 65536) -> DataFrame:
    """Runs of consecutive integer positions: (keys, start, end).

    Runs are found inside tiles first; only the runs that touch a tile border
    meet again, one or two rows per tile.
    """
    t = df.select(*keys, F.col(pos).cast("long").alias("_p")).withColumn("_t", F.floor(F.col("_p") / tile))
    w = Window.partitionBy(*keys, "_t").orderBy("_p")
    local = t.withColumn("_g", F.col("_p") - F.row_number().over(w)).groupBy(*keys, "_t", "_g").agg(
        F.min("_p").alias("start"), F.max("_p").alias("end"))
    touches = (F.col("start") % tile == 0) | (F.col("end") % tile == tile - 1)
    inner = local.where(~touches).select(*keys, "start", "end")
    edge = local.where(touches)
    order = Window.partitionBy(*keys).orderBy("start")
    edge = edge.withColumn("_new", F.coalesce((F.lag("end").over(order) + 1 != F.col("start")).cast("int"), F.lit(1)))
    edge = edge.withColumn("_r", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_r").agg(
        F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")
    return inner.unionByName(edge)


def resample(px: DataFrame, src: DataFrame, dst: DataFrame, value: str = "gray") -> DataFrame:
    """Nearest enlargement or area-mean reduction onto the size in ``dst``.

    Reduction needs whole-number factors, as its cells would otherwise share pixels.
    """
    sizes = src.select("image_id", F.col("h").alias("_h0"), F.col("w").alias("_w0")).join(
        dst.select("image_id", F.col("h").alias("_h1"), F.col("w").alias("_w1")), "image_id")
    df = with_image(px.select("image_id", "y", "x", value), sizes, F.col("_h0") - 1)
    # products of a position and a size pass the range of int
    first = lambda p, a, b: F.expr(f"(({p}) * cast({b} as bigint) + {a} - 1) div {a}")
    span = lambda p, a, b: F.sequence(first(p, a, b).cast("int"), (first(f"{p} + 1", a, b) - 1).cast("int"))
    cell = lambda p, a, b: F.expr(f"{p} * cast({b} as bigint) div {a}").cast("int").alias(p)
    up = df.where("_w1 >= _w0").withColumn("_x", F.explode(span("x", "_w0", "_w1"))).withColumn("_y", F.explode(span("y", "_h0", "_h1"))) \
        .select("image_id", F.col("_y").alias("y"), F.col("_x").alias("x"), F.col(value).cast("double").alias(value))
    down = df.where("_w1 < _w0").groupBy("image_id", cell("y", "_h0", "_h1"), cell("x", "_w0", "_w1")).agg(F.avg(value).alias(value))
    return up.unionByName(down)
