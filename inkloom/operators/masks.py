"""Mask statistics, overlap, gates and set operations on foreground pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rules
from .images import with_image

PX = ["image_id", "y", "x"]


def mask_stats(mask: DataFrame, canvases: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Pixels, coverage, inclusive box and box share per layer; of ``layers`` (image_id, layer) also those without a pixel."""
    s = mask.groupBy("image_id", "layer").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    if layers is not None:
        s = layers.select("image_id", "layer").distinct().join(s, ["image_id", "layer"], "left").na.fill(0, ["pixels"])
    area = F.col("h") * F.col("w")
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) / area
    return s.join(canvases, "image_id").select(
        "image_id", "layer", "pixels", (F.col("pixels") / area).alias("coverage"), "x0", "y0", "x1", "y1",
        F.coalesce(box, F.lit(0.0)).alias("bbox_ratio"))


def half_open_boxes(mask: DataFrame) -> DataFrame:
    return mask.groupBy("image_id", "layer").agg(
        F.min("x").alias("lft"), F.min("y").alias("top"), (F.max("x") + 1).alias("rgt"), (F.max("y") + 1).alias("btm"))


def layer_pairs(mask: DataFrame, same_base: bool = False) -> DataFrame:
    """Intersection, union and IoU of every two layers that share a pixel.

    Layers meet on their pixels, so a pixel yields as many pairs as layers cover
    it; unions follow from the areas.
    """
    cols = [*PX, "layer"] + (["base"] if same_base else [])
    m = mask.withColumn("base", instance_base("layer")) if same_base else mask
    n = m.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    on = PX + (["base"] if same_base else [])
    a, b = m.select(*cols), m.select(*[F.col(c).alias("layer_b") if c == "layer" else F.col(c) for c in cols])
    inter = a.join(b, on).where("layer < layer_b").groupBy("image_id", "layer", "layer_b").agg(F.count(F.lit(1)).alias("inter"))
    both = inter.join(n.withColumnRenamed("n", "n_a"), ["image_id", "layer"]).join(
        n.select("image_id", F.col("layer").alias("layer_b"), F.col("n").alias("n_b")), ["image_id", "layer_b"])
    union = F.col("n_a") + F.col("n_b") - F.col("inter")
    return both.select("image_id", F.col("layer").alias("layer_a"), "layer_b", "inter", union.alias("union_px"), (F.col("inter") / union).alias("iou"))


def instance_base(layer: str):
    """Layer name without its instance number.

    The characters third and second from the end decide: digits there (underscores
    aside) make it an instance name.
    """
    mid = F.replace(F.expr(f"substr({layer}, length({layer}) - 2, 2)"), F.lit("_"), F.lit(""))
    is_inst = (F.length(layer) >= 3) & mid.rlike(r"^\d+$")
    return F.when(is_inst, F.regexp_replace(layer, r"_[^_]*$", "")).otherwise(F.col(layer))


def duplicate_instances(mask: DataFrame, threshold: float = 0.9) -> DataFrame:
    return layer_pairs(mask, same_base=True).where(F.col("iou") > threshold)


def keep_distinct_instances(order: DataFrame, mask: DataFrame, threshold: float = 0.9, max_instances: int = 20) -> DataFrame:
    """Instances kept in order, one is dropped when it repeats a kept one.

    ``order`` gives image_id, layer and seq.  The instance limit is part of the
    operator, so the per-image list that is walked stays short.
    """
    w = Window.partitionBy("image_id").orderBy("seq", "layer")
    listed = order.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_instances)
    kept_mask = mask.join(listed.select("image_id", "layer"), ["image_id", "layer"], "left_semi")
    pairs = layer_pairs(kept_mask).where(F.col("iou") > threshold)
    rivals = pairs.select("image_id", F.col("layer_a").alias("layer"), F.col("layer_b").alias("o")).unionByName(
        pairs.select("image_id", F.col("layer_b").alias("layer"), F.col("layer_a").alias("o"))) \
        .groupBy("image_id", "layer").agg(F.collect_set("o").alias("rivals"))
    rows = listed.join(rivals, ["image_id", "layer"], "left").groupBy("image_id").agg(F.sort_array(F.collect_list(
        F.struct("_r", "layer", F.coalesce("rivals", F.array().cast("array<string>")).alias("rivals")))).alias("_l"))
    kept = F.aggregate("_l", F.array().cast("array<string>"), lambda acc, s: F.when(
        F.arrays_overlap(acc, s["rivals"]), acc).otherwise(F.concat(acc, F.array(s["layer"]))))
    return rows.select("image_id", F.posexplode(kept).alias("pos", "layer"))


def overlap_with_rule(neural: DataFrame, rule: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Pixel counts of equally named neural and rule masks and what they share; NULL where there is no rule mask."""
    n = neural.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("pixels"))
    if layers is not None:
        n = layers.select("image_id", "layer").distinct().join(n, ["image_id", "layer"], "left").na.fill(0, ["pixels"])
    r = rule.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("rule_pixels"))
    both = neural.join(rule, ["image_id", "layer", "y", "x"], "left_semi").groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("inter"))
    return n.join(r, ["image_id", "layer"], "left").join(both, ["image_id", "layer"], "left") \
        .withColumn("inter", F.when(F.col("rule_pixels").isNotNull(), F.coalesce("inter", F.lit(0))))


def gate(neural: DataFrame, rule: DataFrame, canvases: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """Quality and diffuse verdict per layer; a mask of ``layers`` without a pixel is refused as empty."""
    ov = overlap_with_rule(neural, rule, layers)
    st = mask_stats(neural, canvases, layers).select("image_id", "layer", "bbox_ratio", "coverage")
    j = ov.join(st, ["image_id", "layer"]).join(canvases, "image_id")
    q = rules.quality_reason(F.col("layer"), F.col("pixels"), F.col("h") * F.col("w"), F.col("rule_pixels"), F.col("inter"))
    return j.select("image_id", "layer", "pixels", "coverage", "bbox_ratio", q.alias("quality_reason"),
                    rules.diffuse_reason(F.col("layer"), F.col("bbox_ratio")).alias("diffuse_reason"))


def allow_layers(mask: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept masks, rejected ink): refused layers lose their name, never their pixels."""
    ok = F.col("layer").isin(*allowed) if allowed else F.lit(False)
    return mask.where(ok), mask.where(~ok).select(*PX).distinct()


def allow_report(mask: DataFrame, allowed: list[str]) -> DataFrame:
    per = mask.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("layer").isin(*allowed) if allowed else F.lit(False)
    return per.groupBy("image_id").agg(F.count_if(ok).alias("kept_layers"), F.count_if(~ok).alias("dropped_layers"),
                                       (F.count_if(ok) == 0).alias("all_dropped"))


def pixel_union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PX)
    for m in masks[1:]:
        out = out.unionByName(m.select(*PX))
    return out.distinct()


def ink_pixels(pixels: DataFrame, mask: DataFrame, rejected: DataFrame | None = None, delta: float = 12.0) -> DataFrame:
    """All ink of an image: dark pixels and layer pixels without the fold seam, plus rejected ink.

    The seam is taken off before rejected ink is added, so rejected pixels stay.
    """
    med = pixels.groupBy("image_id").agg(F.percentile("gray", 0.5).alias("_med"), F.max("y").alias("_last"))
    dark = with_image(pixels.select(*PX, "gray"), med, F.col("_last")).where(F.col("gray") < F.col("_med") - delta).select(*PX)
    low = F.lower("layer")
    seam = F.contains(low, F.lit("seam")) | F.contains(low, F.lit("fold"))
    fg = mask.where(~seam & ~F.contains(low, F.lit("frame"))).select(*PX)
    ink = dark.unionByName(fg).distinct().join(mask.where(seam).select(*PX), PX, "left_anti")
    return ink if rejected is None else ink.unionByName(rejected.select(*PX)).distinct()


def residue(ink: DataFrame, mask: DataFrame, canvases: DataFrame, min_share: float = 0.001) -> DataFrame:
    """Ink no layer carries, for images where it is more than a trace."""
    low = F.lower("layer")
    fg = mask.where(~(F.contains(low, F.lit("frame")) | F.contains(low, F.lit("seam")) | F.contains(low, F.lit("fold")))).select(*PX)
    rest = ink.join(fg, PX, "left_anti")
    n = rest.groupBy("image_id").agg(F.count(F.lit(1)).alias("_n")).join(canvases, "image_id")
    big = n.where(F.col("_n") > min_share * F.col("h") * F.col("w")).select("image_id")
    return rest.join(big, "image_id", "left_semi")


def clip_to_roi(mask: DataFrame, roi: DataFrame) -> DataFrame:
    return mask.join(roi.select(*PX), PX, "left_semi")


def content_loss(ink: DataFrame, erased: DataFrame, mask: DataFrame, canvases: DataFrame, limit: float = 0.02) -> DataFrame:
    """Ink the base lost that no carrying layer holds; press-work layers do not carry."""
    carriers = mask.where(~rules.has_any(F.col("layer"), rules.PROCESS_LAYERS)).select(*PX).distinct()
    tag = lambda df, n: df.select(*PX, F.lit(1).alias(n))
    j = tag(ink, "_i").join(tag(erased, "_e"), PX, "full_outer").join(tag(carriers, "_u"), PX, "full_outer")
    i, e, u = F.col("_i").isNotNull(), F.col("_e").isNotNull(), F.col("_u").isNotNull()
    s = j.groupBy("image_id").agg(F.count_if(i).alias("_n"), F.count_if(i & e & ~u).alias("lost_px"), F.count_if(e).alias("_e"),
                                  F.count_if(u).alias("_u"), F.count_if(i & e).alias("_ie")).join(canvases, "image_id")
    n, area = F.greatest(F.lit(1), F.col("_n")), F.col("h") * F.col("w")
    return s.select("image_id", n.cast("long").alias("ink_px"), "lost_px", F.round(F.col("lost_px") / n, 6).alias("lost_ratio"),
                    F.round(100.0 * F.col("_e") / area, 2).alias("erased_pct"), F.round(100.0 * F.col("_u") / area, 2).alias("union_pct"),
                    F.round(100.0 * F.col("_ie") / n, 3).alias("ink_erased_pct"), (F.col("lost_px") / n <= limit).alias("passed"))


def layer_stack(mask: DataFrame, canvases: DataFrame) -> DataFrame:
    """Depth, blend and opacity per layer: keyword depth plus up to three for lying lower."""
    cy = mask.groupBy("image_id", "layer").agg(F.avg("y").alias("_cy")).join(canvases, "image_id")
    low = F.lower("layer")
    pick = lambda i, d: rules.first_match(low, [(g[0], g[i]) for g in rules.Z_ORDER], F.lit(d))
    z = pick(1, 50.0) + F.col("_cy") / F.col("h") * 3.0
    order = Window.partitionBy("image_id").orderBy(F.desc("z_index"), "layer")
    return cy.select("image_id", "layer", z.alias("z_index"), pick(2, "NORMAL").alias("blend_mode"), pick(3, 255).alias("opacity")) \
        .withColumn("rank", F.row_number().over(order))


def coverage(configured: DataFrame, produced: DataFrame, rejected: DataFrame) -> DataFrame:
    """What became of each configured class: first produced layer that contains its name or the reverse.

    ``configured`` has image_id, name; ``produced`` image_id, layer, pos, source;
    ``rejected`` image_id, layer, reason.  Class lists of one image are short.
    """
    hit = lambda a, b: (F.col(a) == F.col(b)) | F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a))
    got = configured.join(produced, "image_id").where(hit("layer", "name")).groupBy("image_id", "name").agg(
        F.min_by(F.struct("layer", "source"), F.struct("pos", "layer")).alias("_p"))
    why = configured.join(rejected, "image_id").where(hit("layer", "name")).groupBy("image_id", "name").agg(
        F.min_by("reason", "layer").alias("_why"))
    j = configured.join(got, ["image_id", "name"], "left").join(why, ["image_id", "name"], "left")
    status = F.when(F.col("_p").isNotNull(), "produced").when(F.col("_why").isNotNull(), "rejected").otherwise("missing")
    return j.select("image_id", "name", status.alias("status"), F.col("_p.layer").alias("layer"), F.col("_p.source").alias("source"),
                    F.when(F.col("_p").isNull(), F.col("_why")).alias("reason"))


def extra_layers(cov: DataFrame, produced: DataFrame) -> DataFrame:
    return produced.select("image_id", "layer").join(cov.where("layer IS NOT NULL").select("image_id", "layer"), ["image_id", "layer"], "left_anti")


def missing_core(core: DataFrame, detected: DataFrame) -> DataFrame:
    return core.join(detected.select("image_id", F.col("layer").alias("name")).distinct(), ["image_id", "name"], "left_anti")


def in_regions(px: DataFrame, canvases: DataFrame, regions: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Pixels with each region they lie in; borders are truncated pixel positions."""
    j = with_image(px, canvases)
    cut = lambda v, n: F.floor(F.lit(float(v)) * F.col(n))
    arms = [F.when((F.col("x") >= cut(x0, "w")) & (F.col("x") < cut(x1, "w")) & (F.col("y") >= cut(y0, "h")) & (F.col("y") < cut(y1, "h")),
                   F.lit(name)) for name, x0, y0, x1, y1 in regions]
    return j.withColumn("region", F.explode(F.array_compact(F.array(*arms))))
