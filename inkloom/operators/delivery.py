"""Delivery audit in one pass over the pixels.

All pixel inputs of an artifact are stacked and grouped once by place: colours by ``max``, the layers that cover the place
as bits by ``bit_or``.  One grouping-sets aggregate then leaves, per image, counts by source grey (at most 256 rows), by
base grey (256) and by layer pattern; patterns become counts of layers and of pairs of layers.  Medians, ink, loss, boxes
and overlaps all follow from these counts, so no pixel is read for a threshold first and none is stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..session import cut_lineage
from . import audit as au
from . import rules
from .grid import gaussian_weights
from .masks import instance_base
from .tiles import Tile, on_tiles, smooth

PX = ["image_id", "y", "x"]
WORDS, BITS = 4, 62  # room for 248 content layers of one artifact
ERASED_DELTA = 40    # fixed value: difference from which the base has lost a pixel
LOWFREQ_SIGMA = 16.0  # fixed value: smoothing of the low-frequency comparison


def layer_lists(layers: DataFrame, declared: DataFrame) -> DataFrame:
    """One row per artifact: layer counts, names on one side only, content layers with boxes, base layer and its box."""
    own = layers.select("image_id", F.struct("layer", "position", "visible", "top", "btm", "lft", "rgt", instance_base("layer").alias("base"),
                                             (~rules.has_any(F.col("layer"), rules.SUPPORT_LAYERS)).alias("content"),
                                             rules.has_any(F.col("layer"), rules.BASE_LAYER_WORDS).alias("ground")).alias("l"), F.lit(None).cast("string").alias("d"))
    stated = declared.select("image_id", F.lit(None).cast(own.schema["l"].dataType).alias("l"), F.col("layer").alias("d"))
    g = own.unionByName(stated).groupBy("image_id").agg(F.collect_list("l").alias("l"), F.collect_set("d").alias("d"))
    names = F.transform("l", lambda s: s["layer"])
    unique = F.array_distinct(names)
    ground = F.array_min(F.transform(F.filter("l", lambda s: s["ground"]), lambda s: F.struct(
        s["position"].alias("position"), s["layer"].alias("layer"), ((s["btm"] - s["top"]) * (s["rgt"] - s["lft"])).alias("area"))))
    return g.select(
        "image_id", F.size("l").alias("layer_count"), F.size(F.filter("l", lambda s: s["content"])).alias("content_layers"),
        F.size(F.filter(unique, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)).alias("duplicate_names"),
        F.size(F.filter("l", lambda s: ~s["visible"])).alias("invisible_layers"),
        F.size("d").alias("declared"), F.size(unique).alias("actual"),
        F.size(F.array_except(unique, "d")).alias("undeclared"), F.size(F.array_except("d", unique)).alias("absent"),
        ground["layer"].alias("base_layer"), ground["area"].alias("base_area"),
        F.array_sort(F.array_distinct(F.transform(F.filter("l", lambda s: s["content"]), lambda s: F.struct(s["layer"].alias("layer"), s["base"].alias("base"))))).alias("content"),
        F.transform(F.filter("l", lambda s: s["content"]), lambda s: F.struct(
            s["layer"].alias("layer"), (s["btm"] - s["top"]).alias("h"), (s["rgt"] - s["lft"]).alias("w"))).alias("boxes"))


def pixel_table(mask: DataFrame, lists: DataFrame, pixels: DataFrame, base: DataFrame, composite: DataFrame) -> DataFrame:
    """One row per place with what every input holds there; one shuffle."""
    names = lists.select("image_id", F.transform("content", lambda s: s["layer"]).alias("_c"))
    at = F.array_position("_c", F.col("layer")).cast("int") - 1
    room = F.when(F.size("_c") <= WORDS * BITS, at).otherwise(F.raise_error(F.lit(f"more than {WORDS * BITS} content layers")).cast("int"))
    bit = lambda w: F.when(F.floor(F.col("_i") / BITS) == w, F.expr(f"shiftleft(1L, _i % {BITS})"))
    carrier = (~rules.has_any(F.col("layer"), rules.PROCESS_LAYERS)).cast("int")
    covered = mask.join(names, "image_id").withColumn("_i", room).where("_i >= 0").select(*PX, carrier.alias("u"), *[bit(w).alias(f"m{w}") for w in range(WORDS)])
    colours = lambda df, p: df.select(*PX, *[F.col(c).alias(p + c) for c in "bgr"])
    parts = [pixels.select(*PX, *[F.col(c).alias("s" + c) for c in "bgr"], F.col("gray").cast("int").alias("sgray")), colours(base, "g"), colours(composite, "c"), covered]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    kept = [c + k for c in "sgc" for k in "bgr"]
    one = stacked.groupBy(*PX).agg(*[F.max(c).alias(c) for c in [*kept, "sgray"]], F.coalesce(F.max("u"), F.lit(0)).alias("u"),
                                   *[F.coalesce(F.bit_or(f"m{w}"), F.lit(0).cast("long")).alias(f"m{w}") for w in range(WORDS)])
    off = F.greatest(*[F.abs(F.coalesce(F.col("g" + k), F.lit(255)) - F.col("s" + k)) for k in "bgr"])
    err = sum((F.pow((F.col("c" + k) - F.col("s" + k)).cast("double"), 2.0) for k in "bgr"), F.lit(0.0)) / 3
    return one.select(*PX, "sgray", F.when(F.col("gb").isNotNull(), color.gray(F.col("gb"), F.col("gg"), F.col("gr"))).alias("ggray"), (off > ERASED_DELTA).alias("e"), (F.col("u") > 0).alias("u"),
                      err.alias("err"), *[f"m{w}" for w in range(WORDS)])


def pixel_counts(table: DataFrame) -> DataFrame:
    """(image_id, kind, a, b, n, box, flags): counts by source grey, by base grey, and by layer or pair of layers."""
    masks = [f"m{w}" for w in range(WORDS)]
    sets = table.groupingSets([["image_id", "sgray"], ["image_id", "ggray"], ["image_id", *masks]], "image_id", "sgray", "ggray", *masks).agg(
        F.grouping("sgray").alias("_s"), F.grouping("ggray").alias("_g"), F.count(F.lit(1)).alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.count_if("e").alias("erased"), F.count_if("u").alias("united"),
        F.count_if(F.col("e") & ~F.col("u")).alias("lost"), F.sum("err").alias("sse"), F.count("err").alias("compared"))
    sets = cut_lineage(sets)
    box = ["n", "y0", "y1", "x0", "x1"]
    flags = ["erased", "united", "lost", "sse", "compared"]
    by_gray = lambda c, kind: F.when(F.col(c) == 0, F.lit(kind))
    grays = sets.where("_s = 0 OR _g = 0").select("image_id", F.coalesce(by_gray("_s", "source"), by_gray("_g", "base")).alias("kind"),
                                                F.coalesce("sgray", "ggray").alias("a"), F.lit(None).cast("int").alias("b"), *box, *flags)
    places = F.sequence(F.lit(0), F.lit(BITS - 1))

    def numbers(w: int):
        held = F.filter(places, lambda i: F.col(f"m{w}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
        return F.transform(held, lambda i: i + BITS * w)

    set_bits = F.concat(*[numbers(w) for w in range(WORDS)])
    layers = sets.where("_s = 1 AND _g = 1").withColumn("_l", set_bits).withColumn("a", F.explode("_l")).withColumn("b", F.explode("_l")).where("a <= b")
    pairs = layers.groupBy("image_id", "a", "b").agg(F.sum("n").alias("n"), *[f(c).alias(c) for c, f in (("y0", F.min), ("y1", F.max), ("x0", F.min), ("x1", F.max))])
    return grays.unionByName(pairs.withColumn("kind", F.lit("layers")), allowMissingColumns=True)


_FACTS = """res_mismatch long, duplicate_pairs long, ink_px long, lost_px long, ink_erased_px long, erased_px long, union_px long, source_px long,
 rmse_raw double, opaque_px long, dark_ratio double"""


def _median(values: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(values)
    upto = np.cumsum(n[order])
    at = lambda k: float(values[order][np.searchsorted(upto, k, side="right")])
    total = int(upto[-1])
    return (at((total - 1) // 2) + at(total // 2)) / 2


def _image_facts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Figures of one image from at most 512 rows of greys and one row per pair of its layers."""
    out: dict[str, object] = {"image_id": pdf["image_id"].iloc[0]}
    content, boxes = pdf["content"].iloc[0], pdf["boxes"].iloc[0]
    content, boxes = ([] if x is None else list(x) for x in (content, boxes))
    pairs = pdf[pdf["kind"] == "layers"]
    own = {int(r.a): r for r in pairs[pairs["a"] == pairs["b"]].itertuples()}
    size = {content[i]["layer"]: (r.y1 - r.y0 + 1, r.x1 - r.x0 + 1) for i, r in own.items()}
    out["res_mismatch"] = sum(size.get(b["layer"], (0, 0)) != (b["h"], b["w"]) for b in boxes)
    out["duplicate_pairs"] = sum(content[int(r.a)]["base"] == content[int(r.b)]["base"] and r.n / (own[int(r.a)].n + own[int(r.b)].n - r.n) > au.DUPLICATE_IOU
                                 for r in pairs[pairs["a"] < pairs["b"]].itertuples())
    src = pdf[(pdf["kind"] == "source") & pdf["a"].notna()]
    ink = src[src["a"] < _median(src["a"].to_numpy(), src["n"].to_numpy()) - au.INK_GRAY_DELTA] if len(src) else src
    out |= {"ink_px": ink["n"].sum(), "lost_px": ink["lost"].sum(), "ink_erased_px": ink["erased"].sum(), "source_px": src["n"].sum(),
            "erased_px": src["erased"].sum(), "union_px": pdf.loc[pdf["kind"] == "source", "united"].sum()}
    compared = src["compared"].sum()
    out["rmse_raw"] = float(np.sqrt(src["sse"].sum() / compared)) if compared else None
    ground = pdf[(pdf["kind"] == "base") & pdf["a"].notna()]
    out["opaque_px"] = ground["n"].sum()
    dark = ground["a"] < _median(ground["a"].to_numpy(), ground["n"].to_numpy()) - au.BASE_DARK_DELTA if len(ground) else None
    out["dark_ratio"] = float(ground["n"][dark].sum() / ground["n"].sum()) if len(ground) else None
    return pd.DataFrame([out])


def image_facts(counts: DataFrame, lists: DataFrame) -> DataFrame:
    """One row of figures per image."""
    kind = counts.schema["image_id"].dataType.simpleString()
    return counts.join(lists.select("image_id", "content", "boxes"), "image_id", "left").groupBy("image_id").applyInPandas(_image_facts, f"image_id {kind}, {_FACTS}")


def lowfreq_rmse(pixels: DataFrame, composite: DataFrame, canvases: DataFrame, sigma: float = LOWFREQ_SIGMA) -> DataFrame:
    """Root mean square of the smoothed difference over all channels; both sides meet inside the tiles, without a join."""
    taps = np.asarray(gaussian_weights(sigma))
    halo = len(taps) // 2

    def errors(t: Tile) -> dict[str, np.ndarray]:
        sums = [np.square(smooth(t.around(c, halo), taps)).sum() for c in "bgr"]
        return {"sse": np.array([sum(sums)]), "n": np.array([3 * (t.y1 - t.y0) * (t.x1 - t.x0)])}

    minus = pixels.select(*PX, *[(-F.col(c)).alias(c) for c in "bgr"])
    both = composite.select(*PX, *"bgr").unionByName(minus)
    parts = on_tiles(both, canvases, list("bgr"), halo, errors, "sse double, n long")
    return parts.groupBy("image_id").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse_lowfreq"))
