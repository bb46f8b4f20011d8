"""Phase correlation of two bands of image rows, in passes over rows, blocks of frequencies, and rows again.

No task holds more than a row of an image, a block of frequencies, or at the end the correlation surface of one band.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK = 512
EPS = 1.1920929e-07  # keeps frequencies that neither band has at zero
DIGITS = 9           # of the surface, so that equal heights are equal however they were summed


def transform_length(n: int) -> int:
    """The least length from ``n`` on that has no prime factor above five."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def surface_peak(surface: np.ndarray) -> tuple[float, float]:
    """(y, x) of the highest place, the first one on ties, as the centroid of the five by five around it."""
    y, x = np.unravel_index(int(surface.argmax()), surface.shape)
    y0, x0 = max(0, y - 2), max(0, x - 2)
    part = surface[y0:y + 3, x0:x + 3]
    yy, xx = np.mgrid[y0:y0 + part.shape[0], x0:x0 + part.shape[1]]
    total = part.sum() + np.finfo(float).eps
    return float((part * yy).sum() / total), float((part * xx).sum() / total)


def phase_shift(bands: DataFrame, max_shift: int) -> DataFrame:
    """(image_id, shift_x): whole pixels by which band ``b`` lies to the right of band ``a``; 0 beyond ``max_shift``.

    ``bands`` holds image_id, i (row of the band), x, a, b, and the band's ``rows`` and ``w``; missing pixels are zero.
    """
    id_field = bands.schema["image_id"]
    size = "rows int, w int"

    def schema(ddl: str) -> T.StructType:
        return T.StructType([id_field, *T.StructType.fromDDL(ddl).fields])

    def table(out: T.StructType, image, columns: dict) -> pa.Table:
        arrow = to_arrow_schema(out)
        n = len(next(iter(columns.values())))
        cols = [pa.repeat(image, n).cast(arrow.field(0).type), *(pa.array(columns[f.name], f.type) for f in list(arrow)[1:])]
        return pa.Table.from_arrays(cols, schema=arrow)

    at = lambda t, c: t.column(c)[0].as_py()
    cut, turned, lines, shifts = schema(f"block int, i int, spec binary, {size}"), schema(f"r int, block int, spec binary, {size}"), \
        schema(f"r int, line binary, {size}"), schema("shift_x int")

    def rows(t: pa.Table) -> pa.Table:
        w = at(t, "w")
        pair = np.zeros((2, w))
        np.add.at(pair, (0, t.column("x").to_numpy()), t.column("a").to_numpy())
        np.add.at(pair, (1, t.column("x").to_numpy()), t.column("b").to_numpy())
        spec = np.fft.fft(pair, transform_length(w))
        k = range(0, spec.shape[1], BLOCK)
        return table(cut, t.column("image_id")[0], {"block": [j // BLOCK for j in k], "i": [at(t, "i")] * len(k), "spec": [spec[:, j:j + BLOCK].tobytes() for j in k],
                                                    "rows": [at(t, "rows")] * len(k), "w": [w] * len(k)})

    def columns(t: pa.Table) -> pa.Table:
        n, w = at(t, "rows"), at(t, "w")
        first = np.frombuffer(at(t, "spec"), dtype=complex)
        both = np.zeros((2, n, len(first) // 2), dtype=complex)
        for i, spec in zip(t.column("i").to_pylist(), t.column("spec").to_pylist()):
            both[:, i] = np.frombuffer(spec, dtype=complex).reshape(2, -1)
        m = transform_length(n)
        a, b = np.fft.fft(both, m, axis=1)
        cross = a * np.conj(b)
        size = np.abs(cross)
        back = np.fft.ifft(cross * size / (size ** 2 + EPS), axis=0)
        return table(turned, t.column("image_id")[0], {"r": range(m), "block": [at(t, "block")] * m, "spec": [r.tobytes() for r in back], "rows": [n] * m, "w": [w] * m})

    def back(t: pa.Table) -> pa.Table:
        parts = [s for _, s in sorted(zip(t.column("block").to_pylist(), t.column("spec").to_pylist()))]
        line = np.round(np.fft.fftshift(np.fft.ifft(np.frombuffer(b"".join(parts), dtype=complex)).real), DIGITS)
        return table(lines, t.column("image_id")[0], {"r": [at(t, "r")], "line": [line.tobytes()], "rows": [at(t, "rows")], "w": [at(t, "w")]})

    def peak(t: pa.Table) -> pa.Table:
        by_row = [np.frombuffer(s) for _, s in sorted(zip(t.column("r").to_pylist(), t.column("line").to_pylist()))]
        surface = np.fft.fftshift(np.stack(by_row), axes=0)
        shift = round(surface.shape[1] // 2 - surface_peak(surface)[1])
        return table(shifts, t.column("image_id")[0], {"shift_x": [shift if abs(shift) <= max_shift else 0]})

    typed = bands.select("image_id", F.col("i").cast("int").alias("i"), F.col("x").cast("int").alias("x"), F.col("a").cast("double").alias("a"),
                         F.col("b").cast("double").alias("b"), F.col("rows").cast("int").alias("rows"), F.col("w").cast("int").alias("w"))
    return typed.groupBy("image_id", "i").applyInArrow(rows, cut).groupBy("image_id", "block").applyInArrow(columns, turned) \
        .groupBy("image_id", "r").applyInArrow(back, lines).groupBy("image_id").applyInArrow(peak, shifts)
