"""Press-work operators: safe cut, micro holes, traps, foils, occlusion, seams, panel fill."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from . import runs
from .components import component_stats, connected_components
from .grid import close_ellipse, dilate_ellipse, ellipse, gaussian, gaussian_weights, open_ellipse
from .images import with_image
from .phase import phase_shift
from .tiles import TILE, Tile, on_tiles, smooth

PX = ["image_id", "y", "x"]


def void_pixels(pixels: DataFrame, canvases: DataFrame, *, desk_gray: float = 215.0, edge_energy: float = 4.0, kernel: int = 7,
                iterations: int = 2, tile: int = TILE) -> DataFrame:
    """Bright background that is cool or has no texture, with pinholes closed."""
    taps = np.asarray(gaussian_weights(0.3 * ((kernel - 1) * 0.5 - 1) + 0.8, radius=kernel // 2))
    reach = kernel // 2 + 1

    def find(t: Tile) -> dict[str, np.ndarray]:
        g = t.around("gray", reach)
        lap = np.abs(g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1])
        cool = t.around("r") - t.around("b") < 25
        return t.pixels(t.inside() & (t.around("gray") > desk_gray) & (cool | (smooth(lap, taps) < edge_energy)))

    void = on_tiles(pixels, canvases, ["gray", "r", "b"], reach, find, "y int, x int", tile).withColumn("layer", F.lit("void"))
    return close_ellipse(void, canvases, kernel, iterations=iterations).select(*PX)


def safe_cut(void: DataFrame, canvases: DataFrame, min_y, max_y, max_tear: float) -> DataFrame:
    """Last row before the first torn one, from row sums alone.

    No scan is needed: the first bad row bounds the answer.
    """
    rows = void.groupBy("image_id", "y").agg(F.count(F.lit(1)).alias("_n"))
    rows = with_image(rows, canvases)
    bad = rows.where((F.col("y") >= min_y) & (F.col("y") < F.least(F.lit(max_y), F.col("h"))) & (F.col("_n") / F.col("w") > max_tear)) \
        .groupBy("image_id").agg(F.min("y").alias("_bad"))
    end = F.least(F.coalesce("_bad", F.lit(max_y)), F.lit(max_y), F.col("h"))
    cut = canvases.join(bad, "image_id", "left").select("image_id", "h", "w", F.greatest(F.lit(min_y), end - 1).cast("int").alias("safe_bottom_y"))
    above = with_image(void, cut).groupBy("image_id").agg(
        F.count_if(F.col("y") < F.col("safe_bottom_y")).alias("_a"), F.count_if(F.col("y") == F.col("safe_bottom_y")).alias("_c"))
    j = cut.join(above, "image_id", "left")
    area = F.greatest(F.lit(1), F.col("safe_bottom_y") * F.col("w"))
    return j.select("image_id", "safe_bottom_y", F.round((F.col("safe_bottom_y") * F.col("w") - F.coalesce("_a", F.lit(0))) / area, 4).alias("fabric_solid_ratio"),
                    F.round(F.coalesce("_c", F.lit(0)) / F.col("w"), 4).alias("tear_ratio_at_cut"))


def micro_holes(pixels: DataFrame, canvases: DataFrame, valid: DataFrame | None = None, *, sigma1: float = 0.9, sigma2: float = 2.0,
                threshold: float = 4.5, gray_max: float = 225.0, tile: int = TILE) -> DataFrame:
    """Dark points: local peaks of the difference of two smoothings, with that difference."""
    w1, w2 = (np.asarray(gaussian_weights(s)) for s in (sigma1, sigma2))
    reach = max(len(w1), len(w2)) // 2 + 1

    def find(t: Tile) -> dict[str, np.ndarray]:
        dog = smooth(t.around("gray", len(w2) // 2 + 1), w2) - smooth(t.around("gray", len(w1) // 2 + 1), w1)
        dog[~t.inside(1)] = -np.inf
        mid = dog[1:-1, 1:-1]
        peak = (mid > threshold) & (mid >= dog[:-2, 1:-1]) & (mid >= dog[2:, 1:-1]) & (mid >= dog[1:-1, :-2]) & (mid >= dog[1:-1, 2:])
        return {**t.pixels(peak), "dog": mid[peak]}

    hits = on_tiles(pixels, canvases, ["gray"], reach, find, "y int, x int, dog double", tile)
    if valid is not None:
        return hits.join(valid.select(*PX), PX, "left_semi")
    return hits.join(pixels.where(F.col("gray") < gray_max).select(*PX), PX, "left_semi")


def trap(spot: DataFrame, canvases: DataFrame, width_px: int, adjacent: DataFrame | None = None, trap_type: str = "spread") -> tuple[DataFrame, DataFrame]:
    """(trapped spot, trap band): spread into neighbouring ink, or choke back the spot."""
    kernel = ellipse(width_px * 2 + 1)
    key = ["image_id", "layer", "y", "x"]
    own = runs.to_runs(spot.select(*key), canvases)
    pixels = lambda r: runs.to_pixels(r).select(*key)
    if trap_type == "choke":
        inner = runs.erode_runs(own, kernel)
        return pixels(inner), pixels(runs.subtract_runs(own, inner))
    wide = runs.dilate_runs(own, kernel)
    if adjacent is None:
        return pixels(wide), pixels(runs.subtract_runs(wide, own))
    under = with_image(runs.to_runs(adjacent.select(*PX), canvases, ("image_id",)), own.select("image_id", "layer", F.col("h").alias("_h")).distinct(), F.col("_h") - 1)
    band = runs.intersect_runs(wide, under)
    return pixels(runs.union_runs(own, band)), pixels(band)


def trap_metrics(trapped: DataFrame, band: DataFrame, canvases: DataFrame) -> DataFrame:
    n = lambda df, c: df.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias(c))
    j = n(trapped, "spot_active_pixels").join(n(band, "trap_band_pixels"), ["image_id", "layer"], "left").join(canvases, "image_id")
    b = F.coalesce("trap_band_pixels", F.lit(0)).cast("long")
    return j.select("image_id", "layer", "spot_active_pixels", b.alias("trap_band_pixels"),
                    F.round(F.col("spot_active_pixels") / (F.col("h") * F.col("w")), 4).alias("spot_coverage_ratio"),
                    F.round(b / F.greatest(F.lit(1), F.col("spot_active_pixels")), 4).alias("trap_expansion_ratio"))


def foil_seeds(pixels: DataFrame, valid: DataFrame | None = None, *, rb: float = 90.0, rg: float = 35.0, lab_a: float = 140.0,
               band: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Copper-coloured pixels of the printable area, optionally inside a band of rows."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    _l, a8, _b = color.lab8(b, g, r)
    hit = (r - b > rb) & (r - g > rg) & (a8 >= lab_a)
    if band[0] is not None:
        hit &= F.col("y") >= band[0]
    if band[1] is not None:
        hit &= F.col("y") < band[1]
    out = pixels.where(hit).select(*PX)
    return out if valid is None else out.join(valid.select(*PX), PX, "left_semi")


def split_foils(pixels: DataFrame, valid: DataFrame, canvases: DataFrame, close_k: int = 5, open_k: int = 3, **seed) -> DataFrame:
    """Copper and gold layers of the printable area, which never overlap."""
    c = foil_seeds(pixels, valid, **seed).select("image_id", F.lit("copper").alias("layer"), "y", "x")
    c = close_ellipse(c, canvases, close_k)
    if open_k > 1:
        c = open_ellipse(c, canvases, open_k)
    c = c.select("image_id", "layer", "y", "x")
    gold = valid.select(*PX).distinct().join(c.select(*PX), PX, "left_anti").select("image_id", F.lit("gold").alias("layer"), "y", "x")
    return c.unionByName(gold)


def occlusion_zones(mask: DataFrame, order: DataFrame, canvases: DataFrame, *, extension: int = 20, min_px: int = 20,
                    skip: tuple[str, ...] = ("base", "canvas", "frame", "seal", "seam")) -> DataFrame:
    """Pixels of each layer's widened shape that a layer above it covers.

    "Covered by any layer above" is one number per pixel, the smallest stack
    position there, so the running foreground needs no walk through the layers.
    """
    from .rules import has_any

    m = mask.join(order.select("image_id", "layer", "pos"), ["image_id", "layer"]).where(~has_any(F.lower("layer"), skip))
    top = m.groupBy(*PX).agg(F.min("pos").alias("_top"))
    k = max(5, (extension // 2) * 2 + 1)
    wide = dilate_ellipse(m.select("image_id", "layer", "pos", "y", "x"), canvases, k, ("image_id", "layer", "pos"))
    zone = wide.join(top, PX).where(F.col("_top") < F.col("pos")).select("image_id", "layer", "y", "x")
    n = zone.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_px)
    return zone.join(n.select("image_id", "layer"), ["image_id", "layer"], "left_semi")


def occlusion_metrics(zones: DataFrame, canvases: DataFrame, max_ratio: float = 0.08) -> DataFrame:
    """Reconstructed pixels and share, largest component diagonal, and whether it stays in bounds."""
    px = zones.select(*PX).distinct()
    n = px.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    st = component_stats(connected_components(px, ("image_id",)), ("image_id",)).groupBy("image_id").agg(
        F.max(F.sqrt(F.col("bw") * F.col("bw") + F.col("bh") * F.col("bh"))).alias("_d"))
    j = canvases.join(n, "image_id", "left").join(st, "image_id", "left")
    ratio = F.coalesce("_n", F.lit(0)) / (F.col("h") * F.col("w"))
    return j.select("image_id", F.coalesce("_n", F.lit(0)).cast("long").alias("reconstruction_pixel_count"), F.round(ratio, 5).alias("reconstruction_area_ratio"),
                    F.round(F.coalesce("_d", F.lit(0.0)), 2).alias("max_component_diameter_px"), (ratio <= max_ratio).alias("controlled"))


# ---- cyclic seam -----------------------------------------------------------

def seam_shift(pixels: DataFrame, canvases: DataFrame, band: int = 32, max_shift: int = 16) -> DataFrame:
    """Whole-pixel shift that lines the bottom band up with the top band, by phase correlation; 0 beyond ``max_shift``.

    Images of fewer than four rows, or without pixels in the bands, have the shift 0.
    """
    j = with_image(pixels.select(*PX, "gray"), canvases).withColumn("rows", F.least(F.lit(band), F.floor(F.col("h") / 4)).cast("int"))
    top, low = F.col("y") < F.col("rows"), F.col("h") - F.col("rows")
    cut = j.where(top | (F.col("y") >= low)).select("image_id", F.when(top, F.col("y")).otherwise(F.col("y") - low).alias("i"), "x", "rows", "w",
                                                     F.when(top, 0).otherwise(F.col("gray")).alias("a"), F.when(top, F.col("gray")).otherwise(0).alias("b"))
    found = phase_shift(cut.where("rows > 0"), max_shift)
    return canvases.select("image_id").join(found, "image_id", "left").select("image_id", F.coalesce("shift_x", F.lit(0)).alias("shift_x"))


def harmonize_seam(pixels: DataFrame, canvases: DataFrame, shifts: DataFrame | None = None, band: int = 32, channel: str = "gray") -> DataFrame:
    """Bottom band sheared by the shift and blended toward the top band; other rows unchanged."""
    j = with_image(pixels.select(*PX, F.col(channel).alias("v")), canvases).withColumn("_b", F.least(F.lit(band), F.floor(F.col("h") / 4)).cast("int"))
    j = j.withColumn("i", (F.col("y") - F.col("h") + F.col("_b")).cast("int"))
    bottom = j.where("i >= 0")
    if shifts is not None:
        wide = bottom.join(shifts, "image_id").withColumn("_dx", F.col("shift_x") * F.col("i") / F.col("_b"))
        lo = F.floor(F.col("x") - F.col("_dx")).cast("int")
        mirror = lambda p: F.when(p < 0, -1 - p).when(p >= F.col("w"), 2 * F.col("w") - 1 - p).otherwise(p)
        f = (F.col("x") - F.col("_dx")) - lo
        want = wide.select(*PX, "w", "h", "_b", "i", F.explode(F.array(
            F.struct(mirror(lo).cast("int").alias("sx"), (1 - f).alias("wt")), F.struct(mirror(lo + 1).cast("int").alias("sx"), f.alias("wt")))).alias("p"))
        src = bottom.select("image_id", "y", F.col("x").alias("sx"), F.col("v").alias("sv"))
        bottom = want.select(*PX, "w", "h", "_b", "i", F.col("p.sx").alias("sx"), F.col("p.wt").alias("wt")).join(src, ["image_id", "y", "sx"]) \
            .groupBy(*PX, "w", "h", "_b", "i").agg(F.floor(F.sum(F.col("wt") * F.col("sv")) + 0.5).cast("int").alias("v"))
    top = j.where(F.col("y") < F.col("_b")).select("image_id", F.col("y").alias("i"), "x", F.col("v").alias("t"))
    step = F.when(F.col("_b") > 1, math.pi * F.col("i") / (F.col("_b") - 1)).otherwise(F.lit(0.0))
    half = 0.5 * (1 - F.cos(step)) * 0.5
    mixed = bottom.join(top, ["image_id", "i", "x"]).select(*PX, color.byte((1 - half) * F.col("v") + half * F.col("t")).alias("v"))
    return j.where("i < 0").select(*PX, F.col("v").cast("int").alias("v")).unionByName(mixed)


def seam_rmse(pixels: DataFrame, canvases: DataFrame, value: str = "gray") -> DataFrame:
    """Root mean square jump between the first and the last row."""
    j = with_image(pixels.select(*PX, F.col(value).alias("v")), canvases).where("y = 0 OR y = h - 1")
    pair = j.groupBy("image_id", "x").agg(F.max(F.when(F.col("y") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("y") == F.col("h") - 1, F.col("v"))).alias("b"))
    return pair.groupBy("image_id").agg(F.round(F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))), 3).alias("seam_rmse"))


# ---- clean background ------------------------------------------------------

def _panels(df: DataFrame, n: int) -> DataFrame:
    """Panel number and its column range for each pixel of the active area."""
    wp = (F.col("rgt") - F.col("lft")) / float(n)
    edge = lambda i: F.floor(F.col("lft") + i * wp).cast("int")
    arms = [F.when((F.col("x") >= edge(i)) & (F.col("x") < edge(i + 1)), F.struct(F.lit(i).alias("panel"), edge(i).alias("p0"), edge(i + 1).alias("p1"))) for i in range(n)]
    return df.withColumn("_p", F.coalesce(*arms)).where("_p IS NOT NULL").select("*", "_p.*").drop("_p")


def reference_panel(ink: DataFrame, active: DataFrame, n_panels: int) -> DataFrame:
    """Panel with the least ink in each image, the first one on ties."""
    inside = ink.join(active, "image_id").where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("btm")))
    counts = _panels(inside, n_panels).groupBy("image_id", "panel").agg(F.count(F.lit(1)).alias("_n"))
    every = active.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(n_panels - 1))).alias("panel"))
    return every.join(counts, ["image_id", "panel"], "left").groupBy("image_id").agg(
        F.min_by("panel", F.struct(F.coalesce("_n", F.lit(0)), F.col("panel"))).alias("ref_panel"))


def clean_reference(pixels: DataFrame, ink: DataFrame, active: DataFrame, n_panels: int, channel: str = "gray") -> DataFrame:
    """Reference panel with its ink replaced by the column's clean mean, else by the panel's clean median."""
    ref = reference_panel(ink, active, n_panels)
    area = pixels.select(*PX, F.col(channel).alias("v")).join(active, "image_id").where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("btm")))
    p = _panels(area, n_panels).join(ref, "image_id").where("panel = ref_panel").join(
        ink.select(*PX).distinct().withColumn("_ink", F.lit(True)), PX, "left").withColumn("_ink", F.coalesce("_ink", F.lit(False)))
    col_mean = p.where("NOT _ink").groupBy("image_id", "x").agg(F.avg("v").alias("_m"))
    med = p.where("NOT _ink").groupBy("image_id").agg(F.percentile("v", 0.5).alias("_med"))
    j = p.join(col_mean, ["image_id", "x"], "left").join(med, "image_id", "left")
    v = F.when(F.col("_ink"), F.floor(F.coalesce("_m", "_med", F.lit(200.0))).cast("int")).otherwise(F.col("v"))
    return j.select(*PX, v.alias("v"), (F.col("x") - F.col("p0")).alias("px"), (F.col("p1") - F.col("p0")).alias("pw"))


def fill_panels(pixels: DataFrame, ink: DataFrame, active: DataFrame, canvases: DataFrame, n_panels: int, channel: str = "gray",
                sigma: float = 8.0, radius: int = 12) -> DataFrame:
    """Background with the ink of every panel covered by the clean reference panel.

    The reference is shifted by the clipped difference of the panels' upper
    bands, and blended with the larger of the blurred mask and 0.95 of the mask.
    """
    ref = clean_reference(pixels, ink, active, n_panels, channel)
    area = pixels.select(*PX, F.col(channel).alias("v")).join(active, "image_id").where((F.col("y") >= F.col("top")) & (F.col("y") < F.col("btm")))
    p = _panels(area, n_panels).join(reference_panel(ink, active, n_panels), "image_id")
    wp = (F.col("rgt") - F.col("lft")) / float(n_panels)
    pad = F.greatest(F.lit(5), F.floor(wp * 0.05))
    hgt = F.col("btm") - F.col("top")
    sky = (F.col("y") >= F.col("top") + F.floor(hgt * 0.05)) & (F.col("y") < F.col("top") + F.floor(hgt * 0.20)) \
        & (F.col("x") >= F.col("p0") + pad) & (F.col("x") < F.col("p1") - pad)
    band = p.where(sky).groupBy("image_id", "panel").agg(F.avg("v").alias("_b"), F.first("ref_panel").alias("ref_panel"))
    base = band.where("panel = ref_panel").select("image_id", F.col("_b").alias("_r"))
    diff = band.join(base, "image_id", "left").select("image_id", "panel", F.greatest(F.lit(-25.0), F.least(F.lit(25.0), F.col("_b") - F.coalesce("_r", F.lit(0.0)))).alias("_d"))
    hit = ink.select(*PX).distinct().withColumn("_i", F.lit(1.0))
    cells = p.select(*PX, "v", "panel", "p0", "p1", "ref_panel", "top").join(hit, PX, "left").withColumn("_i", F.coalesce("_i", F.lit(0.0)))
    # every panel is blurred on its own canvas
    local = cells.select("image_id", "panel", (F.col("y") - F.col("top")).alias("y"), (F.col("x") - F.col("p0")).alias("x"), F.col("_i").alias("a"))
    size = p.groupBy("image_id", "panel").agg(F.max(hgt).cast("int").alias("h"), F.max(F.col("p1") - F.col("p0")).alias("w"))
    blur = _blur_panels(local, size, sigma, radius)
    refs = ref.select("image_id", "y", F.col("px").alias("rx"), F.col("v").alias("rv"))
    rw = ref.groupBy("image_id").agg(F.max("pw").alias("rw"))
    j = cells.join(diff, ["image_id", "panel"], "left").join(rw, "image_id").withColumn("_ly", F.col("y") - F.col("top")).withColumn("_lx", F.col("x") - F.col("p0"))
    j = j.join(blur.select("image_id", "panel", F.col("y").alias("_ly"), F.col("x").alias("_lx"), "a"), ["image_id", "panel", "_ly", "_lx"])
    j = j.withColumn("rx", F.floor(F.col("_lx") * F.col("rw") / (F.col("p1") - F.col("p0"))).cast("int")).join(refs, ["image_id", "y", "rx"])
    alpha = F.greatest(F.col("a"), 0.95 * F.col("_i"))
    adj = color.byte(F.col("rv") + F.coalesce("_d", F.lit(0.0)))
    out = F.when(F.col("panel") == F.col("ref_panel"), F.col("rv")).otherwise(
        # whole results must not fall a code short by rounding
        color.byte(F.col("v") * (1 - alpha) + adj * alpha + 1e-9))
    inked = cells.groupBy("image_id", "panel").agg(F.max("_i").alias("_any"))
    return j.join(inked, ["image_id", "panel"]).select(*PX, F.when((F.col("panel") != F.col("ref_panel")) & (F.col("_any") == 0), F.col("v")).otherwise(out).alias("v"))


def _blur_panels(local: DataFrame, size: DataFrame, sigma: float, radius: int) -> DataFrame:
    both = local.withColumn("image_id", F.struct("image_id", "panel")).drop("panel")
    canv = size.select(F.struct("image_id", "panel").alias("image_id"), "h", "w")
    out = gaussian(both, canv, "a", sigma, radius=radius)
    return out.select("image_id.image_id", "image_id.panel", "y", "x", "a")


def flatten_light(pixels: DataFrame, canvases: DataFrame, sigma: float = 50.0, target: float = 230.0) -> DataFrame:
    """L channel with slow lighting removed, for detection only."""
    l8, _a, _b = color.lab8(F.col("b"), F.col("g"), F.col("r"))
    lum = pixels.select(*PX, l8.cast("double").alias("l"))
    illum = gaussian(lum, canvases, "l", sigma).withColumnRenamed("l", "_i")
    return lum.join(illum, PX).select(*PX, F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("l") - F.col("_i") + target)).alias("l"))


def run_plate_operators(pixels: DataFrame, mask: DataFrame, canvases: DataFrame, config: dict, ppi: float = 150.0) -> DataFrame:
    """Status and headline count of each configured operator per image: ok, skipped or disabled."""

    def status(name, df, count):
        return canvases.select("image_id").join(df.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")), "image_id", "left").select(
            "image_id", F.lit(name).alias("operator"), F.lit("ok").alias("status"), F.coalesce("_n", F.lit(0)).cast("long").alias(count))

    def constant(name, state):
        return canvases.select("image_id", F.lit(name).alias("operator"), F.lit(state).alias("status"), F.lit(0).cast("long").alias("n"))

    parts = []
    c = config.get("contour_protection", {})
    if c.get("enabled", True):
        cut = safe_cut(void_pixels(pixels, canvases), canvases, c.get("min_y", F.floor(F.col("h") * 0.8).cast("int")),
                       c.get("max_y", F.col("h") - 1), c.get("max_tear", 0.01))
        parts.append(cut.select("image_id", F.lit("contour_protection").alias("operator"), F.lit("ok").alias("status"), F.col("safe_bottom_y").cast("long").alias("n")))
    else:
        parts.append(constant("contour_protection", "disabled"))
    m = config.get("micro_holes", {})
    parts.append(status("micro_holes", micro_holes(pixels, canvases, threshold=m.get("threshold", 4.5)), "n") if m.get("enabled") else constant("micro_holes", "disabled"))
    t = config.get("trapping", {})
    if t.get("enabled") and t.get("spot_layer_name"):
        spot = mask.where(F.col("layer") == t["spot_layer_name"])
        width = max(1, round(t.get("trap_mm", 0.2) / 25.4 * ppi))
        band = trap(spot, canvases, width)[1]
        have = spot.select("image_id").distinct().withColumn("_h", F.lit(True))
        parts.append(status("trapping", band, "n").join(have, "image_id", "left").select(
            "image_id", "operator", F.when(F.col("_h"), "ok").otherwise("skipped").alias("status"), "n"))
    else:
        parts.append(constant("trapping", "skipped" if t.get("enabled") else "disabled"))
    f = config.get("metallic_foil", {})
    parts.append(status("metallic_foil", split_foils(pixels, mask, canvases).where("layer = 'copper'"), "n") if f.get("enabled") else constant("metallic_foil", "disabled"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


