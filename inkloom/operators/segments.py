"""Rule-based regions: picture frame, sample panel, seams, blobs, component classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .components import component_stats, connected_components, keep_components
from .grid import close_ellipse, closing, islands, opening
from .images import with_image
from .masks import keep_distinct_instances
from .tiles import TILE, Tile, on_tiles


def otsu_threshold(pixels: DataFrame, by: str = "image_id", value: str = "gray") -> DataFrame:
    """Threshold of largest between-class variance, the first on ties, from 256 counts per image."""
    h = pixels.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(by)
    h = h.withColumns({"_w0": F.sum("_n").over(w), "_s0": F.sum(F.col("_n") * F.col(value)).over(w),
                       "_w": F.sum("_n").over(tot), "_s": F.sum(F.col("_n") * F.col(value)).over(tot)})
    w1 = F.col("_w") - F.col("_w0")
    between = F.when(w1 > 0, F.col("_w0").cast("double") * w1 * F.pow(F.col("_s0") / F.col("_w0") - (F.col("_s") - F.col("_s0")) / w1, 2)).otherwise(F.lit(0.0))
    # variances that differ only by rounding count as equal
    score = F.round(between / F.col("_w") / F.col("_w"), 9)
    return h.withColumn("_b", score).groupBy(by).agg(F.min_by(value, F.struct(-F.col("_b"), F.col(value))).alias("threshold"))


def painting_roi(pixels: DataFrame, canvases: DataFrame, edge_band: int = 12, min_contrast: float = 10.0, min_run: int = 8) -> DataFrame:
    """Rows and columns of the picture inside its frame: (image_id, top, btm, lft, rgt), half-open.

    A line belongs to the picture when its mean is nearer to the centre's grey
    than to the border's, for at least ``min_run`` lines in a row.
    """
    j = with_image(pixels.select("image_id", "y", "x", "gray"), canvases)
    lines = j.select("image_id", "h", "w", "gray", F.explode(F.array(
        F.struct(F.lit("y").alias("axis"), F.col("y").alias("p"), F.col("h").alias("n")),
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("p"), F.col("w").alias("n")))).alias("l"))
    means = lines.groupBy("image_id", "h", "w", "l.axis", "l.p", "l.n").agg(F.avg("gray").alias("m"))
    eb = F.greatest(F.lit(2), F.least(F.lit(edge_band), F.floor(F.col("h") / 8), F.floor(F.col("w") / 8)))
    edge = means.where((F.col("p") < eb) | (F.col("p") >= F.col("n") - eb)).groupBy("image_id").agg(F.percentile("m", 0.5).alias("_edge"))
    mid = lambda p, n: (F.col(p) >= F.floor(F.col(n) / 4)) & (F.col(p) < F.floor(3 * F.col(n) / 4))
    inner = j.where(mid("y", "h") & mid("x", "w")).groupBy("image_id").agg(F.percentile("gray", 0.5).alias("_inner"))
    refs = edge.join(inner, "image_id")
    near = means.join(refs, "image_id").where(F.abs(F.col("m") - F.col("_inner")) < F.abs(F.col("m") - F.col("_edge")))
    runs = islands(near, ["image_id", "axis"], "p").where(F.col("end") - F.col("start") + 1 >= min_run)
    ends = runs.groupBy("image_id").agg(
        *[f(F.when(F.col("axis") == a, c)).alias(n) for a, f, c, n in (
            ("y", F.min, F.col("start"), "top"), ("y", F.max, F.col("end") + 1, "btm"),
            ("x", F.min, F.col("start"), "lft"), ("x", F.max, F.col("end") + 1, "rgt"))])
    out = canvases.join(refs, "image_id").join(ends, "image_id", "left")
    t, b = F.coalesce("top", F.lit(0)), F.coalesce("btm", F.col("h"))
    lf, r = F.coalesce("lft", F.lit(0)), F.coalesce("rgt", F.col("w"))
    whole = (F.abs(F.col("_inner") - F.col("_edge")) < min_contrast) | ((b - t > 0.98 * F.col("h")) & (r - lf > 0.98 * F.col("w")))
    return out.select("image_id", F.when(whole, 0).otherwise(t).cast("int").alias("top"), F.when(whole, F.col("h")).otherwise(b).cast("int").alias("btm"),
                      F.when(whole, 0).otherwise(lf).cast("int").alias("lft"), F.when(whole, F.col("w")).otherwise(r).cast("int").alias("rgt"))


def sample_panel(pixels: DataFrame, canvases: DataFrame, grad: float = 12.0, persistence: float = 0.45, min_side: float = 0.20,
                 min_inset: float = 0.01, tile: int = TILE) -> DataFrame:
    """Box of a photographed panel from edges that persist along whole rows and columns."""
    def steps(t: Tile) -> dict[str, np.ndarray]:
        g, ok = t.around("gray", 1, "edge"), t.inside(1)
        here, right, down = ok[1:-1, 1:-1], ok[1:-1, 2:], ok[2:, 1:-1]
        across, along = (np.abs(b - g[1:-1, 1:-1]) > grad for b in (g[1:-1, 2:], g[2:, 1:-1]))
        count = lambda hit, axis: hit.sum(axis=axis)
        return {"axis": np.repeat(["x", "y"], [t.x1 - t.x0, t.y1 - t.y0]).astype(object), "p": np.concatenate((np.arange(t.x0, t.x1), np.arange(t.y0, t.y1))),
                "n": np.concatenate((count(here & right, 0), count(here & down, 1))),
                "s": np.concatenate((count(here & right & across, 0), count(here & down & along, 1)))}

    large = canvases.where("h >= 16 AND w >= 16")
    parts = on_tiles(pixels, large, ["gray"], 1, steps, "axis string, p int, n long, s long", tile)
    lines = parts.groupBy("image_id", "axis", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where(f"n > 0 AND s / n >= {persistence}")
    end = lambda a, f: f(F.when(F.col("axis") == a, F.col("p")))
    found = lines.groupBy("image_id").agg(end("x", F.min).alias("lft"), end("x", F.max).alias("rgt"), F.count_if(F.col("axis") == "x").alias("_nx"),
                                          end("y", F.min).alias("top"), end("y", F.max).alias("btm"), F.count_if(F.col("axis") == "y").alias("_ny"))
    j = found.join(large, "image_id").where("_nx >= 2 AND _ny >= 2")
    big = (F.col("rgt") - F.col("lft") >= min_side * F.col("w")) & (F.col("btm") - F.col("top") >= min_side * F.col("h"))
    ix, iy = min_inset * F.col("w"), min_inset * F.col("h")
    inset = (F.col("lft") > ix) & (F.col("top") > iy) & (F.col("rgt") < F.col("w") - 1 - ix) & (F.col("btm") < F.col("h") - 1 - iy)
    return j.where(big & inset).select("image_id", "top", "btm", "lft", "rgt")


def fold_seams(pixels: DataFrame, roi: DataFrame, canvases: DataFrame, panels: int = 6, reach: int = 30, margin: int = 50) -> DataFrame:
    """Darkest column near each expected fold."""
    j = with_image(pixels.select("image_id", "y", "x", "gray"), roi.join(canvases, "image_id"))
    fold = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), (F.col("lft") + F.floor((F.col("rgt") - F.col("lft")) * (i / panels))).alias("c"))
                               for i in range(1, panels)]))
    cand = j.where((F.col("y") >= F.col("top") + margin) & (F.col("y") < F.col("btm") - margin)).withColumn("_f", fold).where(
        (F.col("x") >= F.greatest(F.lit(0), F.col("_f.c") - reach)) & (F.col("x") < F.least(F.col("w"), F.col("_f.c") + reach)))
    means = cand.groupBy("image_id", "_f.fold", "x").agg(F.avg("gray").alias("m"))
    return means.groupBy("image_id", "fold").agg(F.min_by("x", F.struct("m", "x")).alias("seam_x"))


def blob_instances(pixels: DataFrame, canvases: DataFrame, configs: list[dict], name: str = "blob") -> DataFrame:
    """Separate dark blobs in preset regions, numbered from left to right."""
    med = pixels.groupBy("image_id").agg(F.percentile("gray", 0.5).alias("_med"))
    base = with_image(pixels.select("image_id", "y", "x", "gray"), med.join(canvases, "image_id"))
    arms = []
    for i, c in enumerate(configs):
        x0, y0, x1, y1 = c["region"]
        cut = lambda v, n: F.floor(F.lit(float(v)) * F.col(n)).cast("int")
        hit = (F.col("x") >= cut(x0, "w")) & (F.col("x") < cut(x1, "w")) & (F.col("y") >= cut(y0, "h")) & (F.col("y") < cut(y1, "h")) \
            & (F.col("gray") < F.col("_med") - float(c.get("ink_delta", 35)))
        arms.append(F.when(hit, F.struct(F.lit(f"{i:03d}").alias("cfg"), cut(x0, "w").alias("ox"), cut(y0, "h").alias("oy"),
                                         (cut(x1, "w") - cut(x0, "w")).alias("rw"), (cut(y1, "h") - cut(y0, "h")).alias("rh"))))
    # each region is its own small canvas, so cleaning stops at its border
    px = base.withColumn("_a", F.explode(F.array_compact(F.array(*arms)))).select(
        "image_id", F.col("_a.cfg").alias("layer"), (F.col("y") - F.col("_a.oy")).alias("y"), (F.col("x") - F.col("_a.ox")).alias("x"),
        F.col("_a.rh").alias("h"), F.col("_a.rw").alias("w"), F.col("_a.ox").alias("ox"), F.col("_a.oy").alias("oy"))
    shift = px.groupBy("image_id", "layer").agg(F.first("ox").alias("ox"), F.first("oy").alias("oy"))
    opened = opening(px.drop("ox", "oy"), canvases, 2, 2).select("image_id", "layer", "y", "x")
    lab = connected_components(opened)
    st = component_stats(lab)
    ok = F.lit(False)
    for i, c in enumerate(configs):
        long_, short = F.greatest("bw", "bh"), F.greatest(F.lit(1), F.least("bw", "bh"))
        ok |= (F.col("layer") == f"{i:03d}") & F.col("area").between(int(c.get("min_blob_px", 25)), int(c.get("max_blob_px", 3000))) \
            & (long_ / short <= float(c.get("max_aspect_ratio", 4.0)))
    cap = F.create_map(*[F.lit(x) for i, c in enumerate(configs) for x in (f"{i:03d}", int(c.get("max_instances", 20)))])[F.col("layer")]
    order = Window.partitionBy("image_id", "layer").orderBy("cx", "label")
    listed = st.where(ok).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap)
    blobs = lab.join(listed.select("image_id", "layer", "label", "_r"), ["image_id", "layer", "label"]).join(shift, ["image_id", "layer"]).select(
        "image_id", F.concat("layer", F.lit("/"), F.lpad(F.col("_r").cast("string"), 6, "0")).alias("layer"),
        (F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x"))
    seq = listed.select("image_id", F.concat("layer", F.lit("/"), F.lpad(F.col("_r").cast("string"), 6, "0")).alias("layer")) \
        .withColumn("seq", F.col("layer"))
    kept = keep_distinct_instances(seq, blobs, max_instances=sum(int(c.get("max_instances", 20)) for c in configs))
    named = kept.select("image_id", "layer", F.concat(F.lit(f"{name}_"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("name"))
    return blobs.join(named, ["image_id", "layer"]).select("image_id", F.col("name").alias("layer"), "y", "x")


# Fixed values below: size and position rules of the component classes.
def seals(pixels: DataFrame, roi_px: DataFrame | None = None, min_area: int = 50, max_area: int = 30000) -> DataFrame:
    """Compact red components."""
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    h8, s8, _v = color.hsv8(b, g, r)
    _l, a8, _b = color.lab8(b, g, r)
    red = pixels.where(((h8 < 15) | (h8 > 165)) & (s8 > 35) & (a8 > 136)).select("image_id", "y", "x")
    if roi_px is not None:
        red = red.join(roi_px, ["image_id", "y", "x"], "left_semi")
    lab = connected_components(red, ("image_id",))
    st = component_stats(lab, ("image_id",))
    aspect = F.col("bw") / F.greatest(F.lit(1), F.col("bh"))
    keep = st.where(F.col("area").between(min_area, max_area) & aspect.between(0.3, 3.0))
    return keep_components(lab, keep, ("image_id",)).drop("label")


def inscriptions(ink: DataFrame, canvases: DataFrame, min_area: int = 6, max_area: int = 3000) -> DataFrame:
    """Small components in the upper part of the outer quarters."""
    lab = connected_components(ink, ("image_id",))
    st = with_image(component_stats(lab, ("image_id",)).withColumn("y", F.col("top")), canvases)
    side = (F.col("lft") > F.floor(F.col("w") * 0.75)) | (F.col("lft") < F.floor(F.col("w") * 0.25))
    keep = st.where(F.col("area").between(min_area, max_area) & (F.col("top") < F.floor(F.col("h") * 0.45))
                    & (F.greatest("bw", "bh") < 150) & side)
    return keep_components(lab, keep, ("image_id",)).drop("label")


def birds(ink: DataFrame, canvases: DataFrame, min_area: int = 6, max_area: int = 400) -> DataFrame:
    """Small components in the upper half, away from the right column."""
    lab = connected_components(ink, ("image_id",))
    st = with_image(component_stats(lab, ("image_id",)).withColumn("y", F.col("top")), canvases)
    keep = st.where(F.col("area").between(min_area, max_area) & (F.col("top") < F.floor(F.col("h") * 0.5))
                    & (F.greatest("bw", "bh") <= 60) & (F.col("lft") < F.floor(F.col("w") * 0.75)))
    return keep_components(lab, keep, ("image_id",)).drop("label")


def component_classes(pixels: DataFrame, ink: DataFrame, canvases: DataFrame, min_px: int = 30, seal_min: int = 50) -> DataFrame:
    """Seal, inscription and bird layers; each takes its ink from the later ones.

    A seal or inscription layer that covers no more than ``min_px`` pixels is not made.
    """
    at = ["image_id", "y", "x"]

    def enough(px, least):
        big = px.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"), F.max("y").alias("_last")).where(F.col("_n") > least)
        return with_image(px, big, F.col("_last")).select(*at)

    seal = seals(pixels, min_area=seal_min)
    named = seal.withColumn("layer", F.lit("seal"))
    seal = enough(close_ellipse(named, canvases, 3).select(*at), min_px)
    left = ink.select(*at).join(seal, at, "left_anti")
    text = enough(inscriptions(left, canvases), min_px)
    left = left.join(text, at, "left_anti")
    bird = birds(left, canvases)
    tag = lambda df, n: df.select("image_id", F.lit(n).alias("layer"), "y", "x")
    return tag(seal, "seal").unionByName(tag(text, "inscription")).unionByName(tag(bird, "bird"))


def buildings(pixels: DataFrame, ink: DataFrame, canvases: DataFrame, *, edge: float = 40.0, run: int = 11, close: int = 25,
              min_area: int = 1000, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(building ink, its box) from dense straight strokes; the largest envelope of each image."""
    key = ["image_id", "y", "x"]

    def gradients(t: Tile) -> dict[str, np.ndarray]:
        g = t.around("gray", 1)
        col = lambda d: g[:, 1 + d:g.shape[1] - 1 + d]
        across, along = col(1) - col(-1), col(-1) + 2 * col(0) + col(1)
        gx, gy = np.abs(across[:-2] + 2 * across[1:-1] + across[2:]), np.abs(along[2:] - along[:-2])
        hit = t.inside() & ((gx > edge) | (gy > edge))
        return {**t.pixels(hit), "gx": gx[hit], "gy": gy[hit]}

    grad = on_tiles(pixels, canvases, ["gray"], 1, gradients, "y int, x int, gx double, gy double", tile).join(ink.select(*key), key, "left_semi")
    line = lambda c, n: grad.where(F.col(c) > edge).select("image_id", F.lit(n).alias("layer"), "y", "x")
    flat, tall = opening(line("gy", "h"), canvases, 1, run), opening(line("gx", "v"), canvases, run, 1)
    dense = flat.unionByName(tall).select("image_id", F.lit("env").alias("layer"), "y", "x").distinct()
    env = closing(dense, canvases, close, close).select("image_id", "layer", "y", "x")
    lab = connected_components(env)
    st = component_stats(lab).where(F.col("area") > min_area)
    best = st.groupBy("image_id").agg(F.min_by(F.struct("label", "lft", "top", "bw", "bh"), F.struct(-F.col("area"), F.col("label"))).alias("b")) \
        .select("image_id", "b.*")
    hull = lab.join(best.select("image_id", "label"), ["image_id", "label"], "left_semi").select(*key)
    return ink.select(*key).join(hull, key, "left_semi"), best


def figures_near(ink: DataFrame, boxes: DataFrame, canvases: DataFrame) -> DataFrame:
    """Ink in the lower left part of a building's box."""
    j = with_image(ink, boxes.join(canvases, "image_id"))
    y0, y1 = F.col("top") + F.floor(F.col("bh") * 0.25), F.least(F.col("h"), F.col("top") + F.col("bh"))
    return j.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= F.col("lft")) & (F.col("x") < F.col("lft") + F.floor(F.col("bw") * 0.65))) \
        .select("image_id", "y", "x")


def distant_wash(pixels: DataFrame, ink: DataFrame, canvases: DataFrame, kernel: int = 21) -> DataFrame:
    """Pale ink between 45 and 12 codes under the ground, bridged."""
    med = pixels.groupBy("image_id").agg(F.percentile("gray", 0.5).alias("_med"), F.max("y").alias("_last"))
    pale = with_image(pixels, med, F.col("_last")).where((F.col("gray") >= F.col("_med") - 45) & (F.col("gray") < F.col("_med") - 12)) \
        .select("image_id", F.lit("wash").alias("layer"), "y", "x").join(ink.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    return close_ellipse(pale.select("image_id", "layer", "y", "x"), canvases, kernel).select("image_id", "layer", "y", "x")
