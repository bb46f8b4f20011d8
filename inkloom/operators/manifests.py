"""Delivery manifests: honest resolution figures, generated share, purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolution_grade(ppi: Column) -> Column:
    return F.when(ppi.isNull(), "UNKNOWN").when(ppi >= 150, "NATIVE").when(ppi >= 50, "MILD") \
        .when(ppi >= 15, "HEAVY").otherwise("EXTREME")


def _ratio(a: Column, b: Column) -> Column:
    return F.when((b == 0) | b.isNull(), F.lit(0.0)).otherwise(a / b)


def size_facts(runs: DataFrame) -> DataFrame:
    """Effective source resolution, physical size and enlargement per run."""
    wide = _ratio(F.col("out_w").cast("double"), F.col("ppi")) * 25.4
    high = _ratio(F.col("out_h").cast("double"), F.col("ppi")) * 25.4
    df = runs.withColumns({"_mm": wide, "_mh": high,
                           "_fx": _ratio(F.col("out_w").cast("double"), F.col("src_w")),
                           "_fy": _ratio(F.col("out_h").cast("double"), F.col("src_h"))})
    eff = _ratio(F.col("src_w").cast("double"), F.col("_mm") / 25.4)
    return df.select(*runs.columns, F.round(F.col("src_w") * F.col("src_h") / 1e6, 3).alias("megapixels"),
                     F.round(eff, 2).alias("effective_ppi"), F.round("_mm", 1).alias("physical_width_mm"),
                     F.round("_mh", 1).alias("physical_height_mm"), F.round("_fx", 3).alias("upscale_factor_x"),
                     F.round("_fy", 3).alias("upscale_factor_y"),
                     F.round(F.greatest("_fx", "_fy"), 3).alias("max_upscale_factor"),
                     resolution_grade(eff).alias("grade"))


def area_shares(layers: DataFrame, runs: DataFrame) -> DataFrame:
    """Area-weighted share of generated and of filled content, at most 1.

    A layer's ratio is weighted with its box, as in the source of these figures;
    ``exact_recon_share`` divides the reconstructed pixels themselves.
    """
    box = F.greatest(F.lit(0), F.col("rgt") - F.col("lft")) * F.greatest(F.lit(0), F.col("btm") - F.col("top"))
    part = F.col("recon_ratio") * box
    acc = layers.groupBy("run_id").agg(
        F.sum(F.when(F.col("generated"), part)).alias("_g"),
        F.sum(F.when(F.col("filled") & ~F.col("generated"), part)).alias("_f"),
        F.sum("recon_pixels").alias("_p"))
    canvas = F.col("out_w").cast("double") * F.col("out_h")
    share = lambda c: F.round(F.when(canvas > 0, F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0)) / canvas)).otherwise(F.lit(0.0)), 6)
    return runs.join(acc, "run_id", "left").select("run_id", share("_g").alias("generated_ratio"),
                                                   share("_f").alias("fill_ratio"), share("_p").alias("exact_recon_share"))


def plate_purity(layers: DataFrame, runs: DataFrame) -> DataFrame:
    """Plates may hold no generated layer and use no generative stage."""
    dirty = layers.groupBy("run_id").agg(F.count_if("generated").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    msg = F.when(F.col("output_mode") != "plate", "not_plate").when(n > 0, F.concat(F.lit("generated_layers:"), n)) \
        .when(F.col("generative_stage"), "generative_stage").otherwise("pure")
    return runs.join(dirty, "run_id", "left").select("run_id", msg.alias("message"),
                                                     msg.isin("not_plate", "pure").alias("plate_purity_ok"))


def totals(layers: DataFrame, runs: DataFrame, inks: DataFrame) -> DataFrame:
    """One row of manifest totals per run."""
    from .inks import tac_pct

    recon = layers.groupBy("run_id").agg(F.sum("recon_pixels").alias("deocclusion_pixel_count"))
    tac = inks.groupBy("run_id").agg(F.round(F.max(tac_pct()), 2).alias("tac_max_pct"),
                                     F.round(F.avg(tac_pct()), 2).alias("tac_mean_pct"))
    out = runs.select("run_id", "output_mode")
    for part in (area_shares(layers, runs), plate_purity(layers, runs), recon, tac):
        out = out.join(part, "run_id", "left")
    return out


def reasons_by_kind(entries: DataFrame) -> DataFrame:
    """Distinct reasons per layer, generated and filled kept apart.

    Fills leave a trace but do not make a layer generated.
    """
    distinct = entries.select("run_id", "name", "kind", "reason").distinct()
    pick = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("reason"))))
    return distinct.groupBy("run_id", "name").agg(
        F.bool_or(F.col("kind") == "generated").alias("generated"),
        pick("generated").alias("generation_reasons"), pick("fill").alias("fill_reasons"))


def layer_records(layers: DataFrame, mask_boxes: DataFrame, recon: DataFrame, *, support: str | None = None,
                  generative_upscale: bool = False, generative_fill: bool = False, upscaler: str = "sr",
                  filler: str = "telea") -> DataFrame:
    """Manifest rows for the layers of each image, the support layer added if undeclared.

    Boxes are half-open; the reconstruction ratio is over the whole mask.
    """
    df = layers.select("image_id", "layer").join(mask_boxes, ["image_id", "layer"], "left") \
        .join(recon, ["image_id", "layer"], "left")
    has = F.coalesce("recon_pixels", F.lit(0)) > 0
    reasons = F.array_compact(F.array(
        F.when(F.lit(generative_upscale), f"super_resolution({upscaler})"),
        F.when(has & F.lit(generative_fill), f"deocclusion({filler})")))
    fills = F.array_compact(F.array(F.when(has & F.lit(not generative_fill), f"deocclusion({filler})")))
    rows = df.select("image_id", "layer", (F.size(reasons) > 0).alias("generated"),
                     F.array_join(reasons, "|").alias("generation_reasons"), F.array_join(fills, "|").alias("fill_reasons"),
                     "lft", "top", "rgt", "btm", F.coalesce("recon_pixels", F.lit(0)).cast("long").alias("recon_pixel_count"),
                     F.when(has, F.col("recon_pixels") / F.col("mask_pixels")).otherwise(F.lit(0.0)).alias("recon_ratio"))
    if support is None:
        return rows
    totals_ = rows.groupBy("image_id").agg(F.sum("recon_pixel_count").alias("_t"), F.bool_or(F.col("layer") == support).alias("_has"))
    why = f"support_background({filler})"
    extra = totals_.where(~F.col("_has")).select(
        "image_id", F.lit(support).alias("layer"), F.lit(generative_fill).alias("generated"),
        F.lit(why if generative_fill else "").alias("generation_reasons"), F.lit("" if generative_fill else why).alias("fill_reasons"),
        *[F.lit(None).cast("int").alias(c) for c in ("lft", "top", "rgt", "btm")],
        F.col("_t").cast("long").alias("recon_pixel_count"), F.lit(0.0).alias("recon_ratio"))
    return rows.unionByName(extra)


def recon_mask_facts(recon_px: DataFrame, canvases: DataFrame) -> DataFrame:
    """Size, pixel count and ratio of each reconstruction mask."""
    n = recon_px.groupBy("image_id", "layer").agg(F.count(F.lit(1)).alias("recon_pixel_count"))
    return n.join(canvases, "image_id").select(
        "image_id", "layer", F.col("w").alias("mask_w"), F.col("h").alias("mask_h"), "recon_pixel_count",
        F.round(F.col("recon_pixel_count") / (F.col("w") * F.col("h")), 6).alias("recon_ratio"))


def valid_layer_count(layers: DataFrame, minimum: int = 1, by: str = "run_id") -> DataFrame:
    good = F.count_if((F.col("rgt") > F.col("lft")) & (F.col("btm") > F.col("top")))
    return layers.groupBy(by).agg(good.alias("valid_layers"), (good >= minimum).alias("passed"))


def output_size(w: Column, h: Column, target_w: Column, target_h: Column, cli_scale: Column, preset_scale: Column) -> tuple[Column, Column]:
    """Explicit size, else the given scale, else the preset's, else 4; truncated."""
    s = F.coalesce(cli_scale, preset_scale, F.lit(4.0))
    both = target_w.isNotNull() & target_h.isNotNull()
    return (F.when(both, target_w.cast("int")).otherwise(F.floor(w * s).cast("int")),
            F.when(both, target_h.cast("int")).otherwise(F.floor(h * s).cast("int")))


def safe_file_name(name: Column) -> Column:
    safe = F.regexp_replace(F.trim(name), r'[\\/:*?"<>|\x00-\x1f]', "_")
    safe = F.coalesce(F.nullif(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("layer"))
    return F.concat(F.substring(safe, 1, 120), F.lit(".png"))


def clean_layer_name(name: Column) -> Column:
    """Trim blanks, then trailing NULs."""
    return F.regexp_replace(F.trim(name), r"\x00+$", "")
