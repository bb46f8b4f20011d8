"""Ink density fields, percentiles, bands and hotspots."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import component_stats, connected_components, drop_small
from .grid import closing, gaussian, opening
from .images import with_image
from .masks import in_regions, mask_stats
from .quantiles import exact_percentiles
from .rules import diffuse_reason


def ink_density(pixels: DataFrame, gold_percentile: float = 88.0) -> DataFrame:
    """Density ``d`` of every pixel against the whole image's bright ground."""
    gold = pixels.groupBy("image_id").agg(F.greatest(F.percentile("gray", gold_percentile / 100.0) / 255.0, F.lit(1e-6)).alias("_g"), F.max("y").alias("_last"))
    t = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.col("gray") / 255.0 / F.col("_g")))
    return with_image(pixels, gold, F.col("_last")).select("image_id", "y", "x", (F.lit(0.0) - F.ln(t) / math.log(50.0)).alias("d"))


def density_map(pixels: DataFrame, canvases: DataFrame, gold_percentile: float = 88.0, sigma: float = 4.0) -> DataFrame:
    d = ink_density(pixels, gold_percentile)
    return gaussian(d, canvases, "d", sigma) if sigma > 0 else d


def global_percentiles(density: DataFrame, probs: dict[str, float] | None = None) -> DataFrame:
    return exact_percentiles(density, ["image_id"], "d", probs or {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})


def block_means(density: DataFrame, canvases: DataFrame, block: int = 256) -> DataFrame:
    """Mean density per block; edges are evenly spaced and truncated to pixels."""
    n = lambda s: F.greatest(F.lit(1), F.floor(F.col(s) / block))
    j = with_image(density, canvases).withColumn("gy", n("h")).withColumn("gx", n("w"))
    at = lambda p, s, g: (F.ceil((F.col(p) + 1) * F.col(g) / F.col(s)) - 1).cast("int")
    return j.groupBy("image_id", "gy", "gx", at("y", "h", "gy").alias("by"), at("x", "w", "gx").alias("bx")).agg(F.avg("d").alias("mean_d"))


def hotspots(density: DataFrame, canvases: DataFrame, *, block: int = 256, percentile: float = 85.0, min_blocks: int = 1,
             max_regions: int = 5) -> DataFrame:
    """Joined groups of the densest blocks as normalized boxes, best few per image."""
    grid = block_means(density, canvases, block)
    thr = exact_percentiles(grid, ["image_id"], "mean_d", {"_thr": percentile / 100.0}).where("_thr > 0")
    hot = grid.join(thr, "image_id").where(F.col("mean_d") >= F.col("_thr")).withColumnRenamed("by", "y").withColumnRenamed("bx", "x")
    lab = connected_components(hot, ("image_id",))
    st = component_stats(lab, ("image_id",)).where(F.col("area") >= max(1, min_blocks))
    score = lab.join(hot.select("image_id", "y", "x", "mean_d", "gy", "gx"), ["image_id", "y", "x"]).groupBy("image_id", "label").agg(
        F.round(F.avg("mean_d"), 4).alias("score"), F.first("gy").alias("gy"), F.first("gx").alias("gx"))
    box = lambda v, n: F.round(v / F.col(n), 4)
    out = st.join(score, ["image_id", "label"]).select(
        "image_id", box(F.col("lft"), "gx").alias("rx0"), box(F.col("top"), "gy").alias("ry0"),
        box(F.col("lft") + F.col("bw"), "gx").alias("rx1"), box(F.col("top") + F.col("bh"), "gy").alias("ry1"),
        "score", F.col("area").alias("blocks"), "label")
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "label")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_regions).drop("label")


def region_bands(density: DataFrame, canvases: DataFrame, regions, low: float = 60.0, high: float = 95.0) -> DataFrame:
    """Density band and its coverage per region; regions without ink give no row."""
    px = in_regions(density, canvases, regions).select("image_id", "region", "d")
    p = exact_percentiles(px, ["image_id", "region"], "d", {"_lo": low / 100.0, "_hi": high / 100.0}).where("_hi > 1e-6")
    p = p.withColumn("_hi", F.when(F.col("_lo") >= F.col("_hi"), F.least(F.lit(1.0), F.col("_lo") + 0.02)).otherwise(F.col("_hi")))
    # a value within rounding of an edge counts as on it
    inside = (F.col("d") >= F.col("_lo") - 1e-12) & (F.col("d") <= F.col("_hi") + 1e-12)
    return px.join(p, ["image_id", "region"]).groupBy("image_id", "region").agg(
        F.round(F.first("_lo"), 4).alias("density_min"), F.round(F.first("_hi"), 4).alias("density_max"),
        F.round(F.avg(inside.cast("double")), 4).alias("coverage"))


def grid_regions(nx: int = 3, ny: int = 3) -> list[tuple[str, float, float, float, float]]:
    return [(f"grid_{ix}{iy}", ix / nx, iy / ny, ix / nx + 1 / nx, iy / ny + 1 / ny) for iy in range(ny) for ix in range(nx)]


def suggest_bands(density: DataFrame, canvases: DataFrame, classes: list[dict] | None = None, regions=None) -> DataFrame:
    """Bands for classes with a region, else for the given regions, else for a 3x3 grid."""
    named = [(c.get("name") or c.get("layer_name") or c.get("category_id") or "类", *map(float, c["region"])) for c in classes or [] if c.get("region")]
    return region_bands(density, canvases, named or regions or grid_regions())


def histogram(density: DataFrame, bins: int = 64) -> DataFrame:
    """Counts per equal bin of [0, 1]; the last bin includes its right edge."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("d") * bins)).cast("int")
    return density.where(F.col("d").between(0, 1)).groupBy("image_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def band_mask(density: DataFrame, canvases: DataFrame, dmin: float, dmax: float, region=None, *, close: int = 9, open_: int = 3,
              min_blob: int = 0, name: str = "band") -> DataFrame:
    """Layer of the pixels inside a density band, cleaned, small blobs removed."""
    px = density.where(F.col("d").between(dmin, dmax))
    if region is not None:
        px = in_regions(px, canvases, [(name, *region)]).select("image_id", "y", "x")
    m = px.select("image_id", F.lit(name).alias("layer"), "y", "x")
    if close > 1:
        m = closing(m, canvases, close, close)
    if open_ > 1:
        m = opening(m, canvases, open_, open_)
    m = m.select("image_id", "layer", "y", "x")
    return drop_small(m, min_blob) if min_blob > 0 else m


def refine_masks(mask: DataFrame, density: DataFrame, canvases: DataFrame, floor: float = 0.12, close: int = 9, open_: int = 3) -> DataFrame:
    """Masks cut back to real ink."""
    m = mask.join(density.where(F.col("d") > floor).select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").select(
        "image_id", "layer", "y", "x")
    if close > 1:
        m = closing(m, canvases, close, close)
    if open_ > 1:
        m = opening(m, canvases, open_, open_)
    return m.select("image_id", "layer", "y", "x")


def recovered_layers(refined: DataFrame, canvases: DataFrame) -> DataFrame:
    """Gate verdict of refined masks; an emptied layer simply has no row."""
    st = mask_stats(refined, canvases)
    return st.select("image_id", "layer", "pixels", "bbox_ratio", diffuse_reason(F.col("layer"), F.col("bbox_ratio")).alias("diffuse_reason"))
