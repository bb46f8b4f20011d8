"""Layer compositing as per-pixel aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PX = ["image_id", "y", "x"]


def composite_print(layer_px: DataFrame, substrate: DataFrame | None = None) -> DataFrame:
    """Ink per pixel: the topmost covering layer wins; die-cut holes show the substrate.

    ``layer_px`` has z, alpha, layer_type, visible and inks c, m, yl, k (0 = no
    ink).  One aggregate finds both the top ink and the holes.
    """
    vis = layer_px.where("visible")
    inks = F.struct("c", "m", "yl", "k")
    top = vis.groupBy(*PX).agg(
        F.max_by(F.when((F.col("layer_type") != "diecut_mask") & (F.col("alpha") > 0), inks),
                 F.when((F.col("layer_type") != "diecut_mask") & (F.col("alpha") > 0), F.col("z"))).alias("_ink"),
        F.bool_or((F.col("layer_type") == "diecut_mask") & (F.col("alpha") == 0)).alias("_hole"))
    blank = F.struct(*[F.lit(0).alias(c) for c in ("c", "m", "yl", "k")])
    if substrate is not None:
        top = top.join(substrate.select(*PX, F.struct("c", "m", "yl", "k").alias("_sub")), PX, "left")
        blank = F.coalesce("_sub", blank)
    out = top.withColumn("_o", F.when(F.col("_hole") | F.col("_ink").isNull(), blank).otherwise(F.col("_ink")))
    return out.select(*PX, "_o.*", F.col("_hole").alias("hole"))


def composite_design(layer_px: DataFrame, background: int = 255) -> DataFrame:
    """RGB over white from bottom to top, truncated to whole codes after each layer.

    The fold walks the layers of one pixel, a list as long as the layer stack.
    """
    stack = layer_px.where("visible").groupBy(*PX).agg(F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "alpha"))).alias("_l"))

    def blend(acc, s):
        a = s["alpha"] / 255.0
        mix = lambda ch: F.floor(acc[ch] * (1.0 - a) + s[ch] * a + 1e-9).cast("int")
        return F.struct(mix("r").alias("r"), mix("g").alias("g"), mix("b").alias("b"))

    start = F.struct(*[F.lit(background).alias(c) for c in ("r", "g", "b")])
    return stack.select(*PX, F.aggregate("_l", start, blend).alias("_c")).select(*PX, "_c.*")


def composite_check(layer_px: DataFrame) -> DataFrame:
    """RGB in 0..1 with opacity and multiply blending, flattened over white."""
    stack = layer_px.where("visible").groupBy(*PX).agg(
        F.sort_array(F.collect_list(F.struct("z", "r", "g", "b", "alpha", "opacity", "blend"))).alias("_l"))

    def blend(acc, s):
        a = s["alpha"] / 255.0 * (s["opacity"] / 255.0)
        out_a = a + acc["a"] * (1.0 - a)

        def mix(ch):
            v = s[ch] / 255.0
            src = F.when(F.lower(s["blend"]) == "multiply", acc[ch] * v).otherwise(v)
            return (src * a + acc[ch] * acc["a"] * (1.0 - a)) / F.greatest(out_a, F.lit(1e-6))

        return F.struct(mix("r").alias("r"), mix("g").alias("g"), mix("b").alias("b"), out_a.alias("a"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b", "a")])
    flat = stack.select(*PX, F.aggregate("_l", start, blend).alias("_c"))
    return flat.select(*PX, *[(F.col(f"_c.{c}") * F.col("_c.a") + (1.0 - F.col("_c.a"))).alias(c) for c in ("r", "g", "b")])
