"""Array code on square tiles that carry their halo: one shuffle, one bounded group a tile.

A pixel travels once, and again only where it lies in the halo of a neighbouring tile.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .images import with_image

TILE = 256


def mirrored(lo: int, hi: int, n: int) -> np.ndarray:
    """Source position of each position lo .. hi-1 of a line of ``n`` pixels, mirrored at its ends."""
    if n == 1:
        return np.zeros(hi - lo, dtype=np.int64)
    p = np.mod(np.arange(lo, hi), 2 * (n - 1))
    return np.where(p < n, p, 2 * (n - 1) - p)


class Tile:
    """Rows y0 to y1 and columns x0 to x1 of an image of ``h`` by ``w`` pixels, with what is known around them."""

    def __init__(self, table: pa.Table, size: int, halo: int, values: list[str]):
        at = lambda c: table.column(c)[0].as_py()
        self.h, self.w = at("h"), at("w")
        self.y0, self.x0 = at("_ty") * size, at("_tx") * size
        self.y1, self.x1 = min(self.h, self.y0 + size), min(self.w, self.x0 + size)
        self._ylo, self._xlo = max(0, self.y0 - halo), max(0, self.x0 - halo)
        shape = (min(self.h, self.y1 + halo) - self._ylo, min(self.w, self.x1 + halo) - self._xlo)
        cells = (table.column("y").to_numpy() - self._ylo, table.column("x").to_numpy() - self._xlo)
        self._known = np.zeros(shape, dtype=bool)
        self._known[cells] = True
        self._grids = {}
        for v in values:
            self._grids[v] = np.zeros(shape)
            np.add.at(self._grids[v], cells, table.column(v).to_numpy())

    def _pick(self, n: int, border: str):
        if border == "mirror":
            yy, xx = mirrored(self.y0 - n, self.y1 + n, self.h), mirrored(self.x0 - n, self.x1 + n, self.w)
        else:
            yy, xx = (np.clip(np.arange(a - n, b + n), 0, m - 1) for a, b, m in ((self.y0, self.y1, self.h), (self.x0, self.x1, self.w)))
        return np.ix_(yy - self._ylo, xx - self._xlo)

    def around(self, value: str, n: int = 0, border: str = "mirror") -> np.ndarray:
        """``value`` on the tile and ``n`` pixels around it; beyond the image mirrored, or the border pixel repeated."""
        return self._grids[value][self._pick(n, border)]

    def inside(self, n: int = 0) -> np.ndarray:
        """Whether there is a pixel, on the tile and ``n`` pixels around it; never beyond the image."""
        out = np.zeros((self.y1 - self.y0 + 2 * n, self.x1 - self.x0 + 2 * n), dtype=bool)
        y, x = max(0, self.y0 - n), max(0, self.x0 - n)
        part = self._known[y - self._ylo:min(self.h, self.y1 + n) - self._ylo, x - self._xlo:min(self.w, self.x1 + n) - self._xlo]
        oy, ox = y - (self.y0 - n), x - (self.x0 - n)
        out[oy:oy + part.shape[0], ox:ox + part.shape[1]] = part
        return out

    def pixels(self, hit: np.ndarray) -> dict[str, np.ndarray]:
        """Columns y and x of the tile's pixels where ``hit`` holds."""
        yy, xx = np.nonzero(hit)
        return {"y": (yy + self.y0).astype(np.int32), "x": (xx + self.x0).astype(np.int32)}


def smooth(grid: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Separable filter; the result is smaller by the filter's reach on each side."""
    n = len(taps)
    rows = sum(taps[i] * grid[:, i:grid.shape[1] - n + 1 + i] for i in range(n))
    return sum(taps[i] * rows[i:grid.shape[0] - n + 1 + i] for i in range(n))


def on_tiles(df: DataFrame, canvases: DataFrame, values: list[str], halo: int, fn: Callable[[Tile], dict[str, np.ndarray]], columns: str,
             tile: int = TILE) -> DataFrame:
    """(image_id, ``columns``) of all tiles; ``fn`` turns a tile into its columns.

    A tile is at least four halos wide.  Values given several times for one place add up.
    """
    size = max(tile, 4 * halo)
    span = lambda c, n: F.explode(F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(c) - halo) / size)).cast("int"), F.least(F.floor((F.col(n) - 1) / size), F.floor((F.col(c) + halo) / size)).cast("int")))
    named = df.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(v).cast("double").alias(v) for v in values])
    cut = with_image(named, canvases.select("image_id", "h", "w")).withColumn("_ty", span("y", "h")).withColumn("_tx", span("x", "w"))
    out = T.StructType([df.schema["image_id"], *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(out)

    def run(table: pa.Table) -> pa.Table:
        made = fn(Tile(table, size, halo, values))
        n = len(next(iter(made.values())))
        image = pa.repeat(table.column("image_id")[0], n).cast(arrow.field(0).type)
        return pa.Table.from_arrays([image, *(pa.array(made[f.name], f.type) for f in list(arrow)[1:])], schema=arrow)

    return cut.groupBy("image_id", "_ty", "_tx").applyInArrow(run, out)
