"""Masks as runs: one row (keys, y, x0, x1, h, w) per maximal stretch of foreground in a line, both ends included.

A kernel is one shifted interval per kernel row. A run is sent once to each line its kernel reaches, so what is shuffled
grows with runs times kernel height, never with kernel area. What the intervals of a line make together is read off one
sweep over their ends: +1 where one begins, -1 behind its end, and a running sum. The group of a sweep is one line of one
layer. Chains of steps stay in runs; pixels appear once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .images import by_line, with_image

KEYS = ("image_id", "layer")
Kernel = dict[int, tuple[int, int]]  # dy -> first and last dx


def rectangle(kh: int, kw: int) -> Kernel:
    """Kernel of any size; even ones reach one further up and left."""
    return {dy: (-(kw // 2), kw - 1 - kw // 2) for dy in range(-(kh // 2), kh - kh // 2)}


def to_runs(mask: DataFrame, canvases: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Runs of a pixel mask; a pixel given twice counts once."""
    line = [*keys, "y"]
    size = [c for c in ("h", "w") if "w" in mask.columns]
    order = Window.partitionBy(*line).orderBy("x")
    near = by_line(mask.select(*line, "x", *size), line).select(*line, "x", *size, F.lag("x").over(order).alias("_was"), F.lead("x").over(order).alias("_next"))
    # of a run, its first and its last pixel stay: next to each other in the same order, so no group is kept in memory
    first, last = F.coalesce(F.col("_was") < F.col("x") - 1, F.lit(True)), F.coalesce(F.col("_next") > F.col("x") + 1, F.lit(True))
    ends = near.withColumns({"_first": first, "_last": last}).where("_first OR _last")
    x1 = F.when(F.col("_last"), F.col("x")).otherwise(F.lead("x").over(order))
    found = ends.withColumn("x1", x1).where("_first").select(*line, F.col("x").alias("x0"), "x1", *size)
    return found if size else with_image(found, canvases.select("image_id", "h", "w")).select(*line, "x0", "x1", "h", "w")


def to_pixels(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return runs.select(*keys, "y", F.explode(F.sequence(F.col("x0").cast("int"), F.col("x1").cast("int"))).alias("x"), "h", "w")


def _ends(runs: DataFrame, keys: tuple[str, ...], sign: int = 1) -> DataFrame:
    ends = F.array(F.struct(F.col("x0").cast("int").alias("p"), F.lit(sign).alias("d")), F.struct((F.col("x1") + 1).cast("int").alias("p"), F.lit(-sign).alias("d")))
    return runs.select(*keys, "y", "h", "w", F.explode(ends).alias("_e")).select(*keys, "y", "h", "w", "_e.p", "_e.d")


def _sweep(ends: DataFrame, keys: tuple[str, ...], need: Column) -> DataFrame:
    """Maximal runs where the sum of open intervals is at least ``need``."""
    line = Window.partitionBy(*keys, "y").orderBy("p")
    inside = F.sum("d").over(line.rangeBetween(Window.unboundedPreceding, Window.currentRow)) >= need  # ends at one place count together
    turns = by_line(ends, [*keys, "y"]).withColumn("_in", inside).withColumn("_was", F.coalesce(F.lag("_in").over(line), F.lit(False))).where("_in <> _was")
    return turns.withColumn("x1", F.lead("p").over(line) - 1).where("_in").select(*keys, "y", F.col("p").alias("x0"), "x1", "h", "w")


def _sent(runs: DataFrame, kernel: Kernel) -> DataFrame:
    """Each run once per line the kernel reaches, with that row's reach in ``_k``."""
    rows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for dy, (lo, hi) in kernel.items()]))
    sent = runs.withColumn("_k", rows).withColumn("y", (F.col("y") - F.col("_k.dy")).cast("int"))
    return sent.where((F.col("y") >= 0) & (F.col("y") < F.col("h")))


def dilate_runs(runs: DataFrame, kernel: Kernel, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Places with foreground anywhere under the kernel."""
    wide = _sent(runs, kernel).withColumns({"x0": F.greatest(F.lit(0), F.col("x0") - F.col("_k.hi")), "x1": F.least(F.col("w") - 1, F.col("x1") - F.col("_k.lo"))})
    return _sweep(_ends(wide.where("x0 <= x1"), keys), keys, F.lit(1))


def erode_runs(runs: DataFrame, kernel: Kernel, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Places whose kernel, as far as it lies on the canvas, is all foreground."""
    x0 = F.when(F.col("x0") == 0, 0).otherwise(F.col("x0") - F.col("_k.lo"))
    x1 = F.when(F.col("x1") == F.col("w") - 1, F.col("x1")).otherwise(F.col("x1") - F.col("_k.hi"))
    near = _sent(runs, kernel).withColumns({"x0": F.greatest(F.lit(0), x0), "x1": F.least(F.col("w") - 1, x1)})
    rows = sum(((F.col("y") + dy >= 0) & (F.col("y") + dy < F.col("h"))).cast("int") for dy in kernel)
    return _sweep(_ends(near.where("x0 <= x1"), keys), keys, rows)


def close_runs(runs: DataFrame, kernel: Kernel, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return erode_runs(dilate_runs(runs, kernel, keys), kernel, keys)


def open_runs(runs: DataFrame, kernel: Kernel, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return dilate_runs(erode_runs(runs, kernel, keys), kernel, keys)


def union_runs(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return _sweep(_ends(a, keys).unionByName(_ends(b, keys)), keys, F.lit(1))


def intersect_runs(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return _sweep(_ends(a, keys).unionByName(_ends(b, keys)), keys, F.lit(2))


def subtract_runs(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return _sweep(_ends(a, keys).unionByName(_ends(b, keys, -1)), keys, F.lit(1))


def run_area(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, pixels), from the ends alone."""
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"))
