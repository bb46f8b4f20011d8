"""Jobs: whole workflows composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..operators import audit as au
from ..operators import delivery as dl
from ..operators import density as de
from ..operators import episodes as ep
from ..operators import feedback as fb
from ..operators import inks as ik
from ..operators import lexicon as lx
from ..operators import masks as mk
from ..operators import rules
from ..operators import similarity as sim
from ..operators.quantiles import join_all
from ..session import cut_lineage


def delivery_audit(layers: DataFrame, mask: DataFrame, pixels: DataFrame, base: DataFrame, canvases: DataFrame,
                   composite: DataFrame, facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Long table of the eight dimensions per artifact, each with its metrics; :func:`au.verdict` sums it up.

    ``layers`` holds name, position, visibility and box, ``base`` the base layer's opaque pixels (elsewhere it is white),
    ``composite`` the rendered picture, ``facts`` the manifest figures (color_mode, tac_max_pct, plate_purity_ok,
    generated_ratio, has_manifest) and, if given, ``has_source``; ``declared`` the manifest's layer names.  Without a
    source picture dimensions four and five pass unevaluated; without a base layer the fourth has nothing to judge.
    """
    lists = cut_lineage(dl.layer_lists(layers, declared))
    figures = dl.image_facts(dl.pixel_counts(dl.pixel_table(mask, lists, pixels, base, composite)), lists)
    plate = au.plate_compliance(facts.withColumnRenamed("image_id", "run_id")).select(
        F.col("run_id").alias("image_id"), F.col("passed").alias("_plate"), F.col("evaluated").alias("_checked"), "na", F.nullif(F.col("issues"), F.lit("")).alias("_why"))
    has_source = F.col("has_source") if "has_source" in facts.columns else F.lit(True)
    known = facts.select("image_id", "has_manifest", "tac_max_pct", "generated_ratio", has_source.alias("has_source"))
    j = join_all([canvases, lists.drop("content", "boxes"), figures, dl.lowfreq_rmse(pixels, composite, canvases), plate, known], ["image_id"])
    area, n_ink = F.col("h") * F.col("w"), F.greatest(F.lit(1), F.col("ink_px"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ground, lost, opaque = F.col("base_layer").isNotNull(), zero("lost_px") / n_ink, 100.0 * zero("opaque_px") / F.greatest(F.lit(1), F.col("base_area"))
    apart = (F.col("rmse_lowfreq") > au.RMSE_LOWFREQ_MAX) | (F.col("rmse_raw") > au.RMSE_RAW_MAX)
    listed = (zero("undeclared") == 0) & (zero("absent") == 0)

    def dim(i, passed, issue, metrics, evaluated=None, na=None):
        no = F.lit(False)
        values = F.map_filter(F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]), lambda k, v: v.isNotNull())
        passed = F.coalesce(passed, no)
        return F.struct(F.lit(ep.DIM_KEYS[i]).alias("dim"), passed.alias("passed"), (F.lit(True) if evaluated is None else F.coalesce(evaluated, no)).alias("evaluated"),
                        (no if na is None else F.coalesce(na, no)).alias("na"), F.when(~passed, issue).alias("issue"), values.alias("metrics"))

    cols = lambda *names: {c: F.col(c) for c in names}
    with_base = lambda v: F.when(ground & F.col("has_source"), v)
    dims = [
        dim(0, (zero("duplicate_names") == 0) & (zero("invisible_layers") == 0), F.lit("duplicate or invisible layers"),
            cols("layer_count", "content_layers", "duplicate_names", "invisible_layers")),
        dim(1, zero("res_mismatch") == 0, F.lit("layer size differs from its box"), cols("res_mismatch")),
        dim(2, zero("duplicate_pairs") == 0, F.lit("repeated instances"), cols("duplicate_pairs")),
        dim(3, ~F.col("has_source") | ~ground | (lost <= au.CONTENT_LOSS_MAX), F.lit("content lost"),
            {"ink_px": with_base(n_ink), "lost_px": with_base(zero("lost_px")), "lost_ratio": with_base(F.round(lost, 6)),
             "erased_pct": with_base(F.round(100.0 * zero("erased_px") / area, 2)), "union_pct": with_base(F.round(100.0 * zero("union_px") / area, 2)),
             "ink_erased_pct": with_base(F.round(100.0 * zero("ink_erased_px") / n_ink, 3))}, F.col("has_source")),
        dim(4, ~F.col("has_source") | ~F.coalesce(apart, F.lit(False)), F.lit("composite differs"),
            {c: F.when(F.col("has_source"), F.round(c, 2)) for c in ("rmse_raw", "rmse_lowfreq")}, F.col("has_source") & F.col("rmse_raw").isNotNull()),
        dim(5, ground & (opaque >= 1), F.when(ground, "empty base layer").otherwise("no base layer"),
            {"opaque_pct": F.when(ground, F.round(opaque, 1)), "dark_ratio_all": F.when(ground, F.round(100.0 * F.col("dark_ratio"), 2))}),
        dim(6, F.col("_plate"), F.col("_why"), {"tac_max_pct": F.when(F.col("_checked"), F.col("tac_max_pct")), "generated_pixel_ratio": F.when(F.col("has_manifest"), F.col("generated_ratio"))},
            F.col("_checked"), F.col("na")),
        dim(7, ~F.col("has_manifest") | listed, F.lit("layer lists differ"), {c: F.when(F.col("has_manifest"), F.col(c)) for c in ("declared", "actual")}, F.col("has_manifest"))]
    return j.select(F.col("image_id").alias("artifact"), F.explode(F.array(*dims)).alias("d")).select("artifact", "d.*")


def learn(detections: DataFrame, prompts: DataFrame | None) -> DataFrame:
    """New weight per (category, prompt) after all episodes; shadow suggestions, nothing is written."""
    return ep.fold_updates(ep.weight_updates(ep.attributions(detections), prompts))


def retrieve_similar(queries: DataFrame, index: DataFrame, episodes: DataFrame, *, query_id: str, query_vec: str, key: str,
                     top_k: int = 5, min_similarity: float = 0.7, preset: str | None = None, line: str | None = None,
                     expected_keys: list[str] | None = None) -> DataFrame:
    """Most similar admitted episodes and whether each may be reused.

    ``episodes`` carries dims and output_mode; those that fail admission are not searched.
    """
    indexed = episodes.withColumnRenamed(key, "task_id").join(index.select("task_id"), "task_id", "left_semi")
    ok = indexed.where(ep.admission_reason(F.col("dims"), F.col("output_mode")) == "ok").select("task_id")
    hits = sim.top_similar(queries, index.join(ok, "task_id", "left_semi"), query_id=query_id, query_vec=query_vec, top_k=top_k,
                           min_similarity=min_similarity, only_audited=False)
    block = sim.reuse_block_reason(preset, line, expected_keys)
    return hits.join(episodes.withColumnRenamed(key, "task_id"), "task_id").withColumn("blocked", block).withColumn("reusable", F.col("blocked").isNull())


def build_priors(boxes: DataFrame, categories: DataFrame, min_samples: int = 3) -> DataFrame:
    """Priors with roll-up, for categories that exist."""
    priors = ep.category_priors(boxes, categories.select("id", "parent_id"), min_samples)
    return priors.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_semi")


def auto_tune(pixels: DataFrame, canvases: DataFrame, classes: list[dict] | None = None, *, gold_percentile: float = 88.0,
              sigma: float = 4.0, block: int = 256, max_regions: int = 5) -> dict[str, DataFrame]:
    """Percentiles, hotspots and density bands per image; the density field is computed once and stored."""
    d = cut_lineage(de.density_map(pixels, canvases, gold_percentile, sigma))
    return {"percentiles": de.global_percentiles(d), "regions": de.hotspots(d, canvases, block=block, max_regions=max_regions),
            "bands": de.suggest_bands(d, canvases, classes)}


def select_categories(images: DataFrame, affinity: DataFrame, categories: DataFrame, *, limit: int = 50, mode: str = "auto",
                      preset_ids: list[str] | None = None) -> DataFrame:
    """Category ids per image in search order.

    Families are resolved once each and then joined to the images of that family.
    """
    if mode not in ("locked", "auto", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "auto" and preset_ids is None:
        raise ValueError(f"{mode} needs preset_ids")
    given = F.array(*[F.lit(c) for c in preset_ids or []]).cast("array<string>")
    if mode == "locked":
        return images.withColumn("category_ids", given)
    best = lx.categories_by_material(affinity, categories, limit=20 if mode == "hybrid" else limit)
    per = best.groupBy("material_family").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category_id"))), lambda s: s["category_id"]).alias("_ids"))
    j = images.join(per, "material_family", "left")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    return j.withColumn("category_ids", lx.with_core_first(lx.hybrid_ids(given, ids))).drop("_ids")


def prepress_inks(pixels: DataFrame, limit_pct: float = 300.0, max_k_pct: float = 96.0, k_gain: float = 1.0, k_gamma: float = 1.0,
                  k_shift_pct: float = 0.0) -> DataFrame:
    """Separation, black curve and ink limit in one pass over the pixels."""
    c, m, yl, k = color.rgb_to_inverse_cmyk(F.col("b"), F.col("g"), F.col("r"))
    sep = pixels.withColumns({"c": c, "m": m, "yl": yl, "k": k})
    return ik.limit_ink(ik.black_generation(sep, k_gain, k_gamma, k_shift_pct), limit_pct, max_k_pct)


def gate_layers(neural: DataFrame, rule: DataFrame, pixels: DataFrame, canvases: DataFrame, *, refine: list[str] | None = None,
                floor: float = 0.12, close: int = 9, open_: int = 3, layers: DataFrame | None = None) -> DataFrame:
    """Fate of every neural layer: accepted, rejected by a gate, or recovered by refinement."""
    gated = mk.gate(neural, rule, canvases, layers)
    fate = F.when(F.col("quality_reason").isNotNull(), F.concat(F.lit("quality:"), F.col("quality_reason"))) \
        .when(F.col("diffuse_reason").isNotNull(), "diffuse").otherwise("accepted")
    gated = gated.withColumn("fate", fate)
    again = gated.where("fate = 'diffuse'").select("image_id", "layer")
    again = again.where(F.col("layer").isin(*refine)) if refine else again.limit(0)
    cut = de.refine_masks(neural.join(again, ["image_id", "layer"], "left_semi"), de.ink_density(pixels), canvases, floor, close, open_)
    back = de.recovered_layers(cut, canvases).where("diffuse_reason IS NULL").select("image_id", "layer", F.lit(True).alias("_back"))
    return gated.join(back, ["image_id", "layer"], "left").withColumn("fate", F.when(F.col("_back"), "recovered").otherwise(F.col("fate"))).drop("_back")


def apply_feedback(actions: DataFrame, categories: DataFrame, prompts: DataFrame, now: int) -> dict[str, DataFrame]:
    """Lexicon after a batch of reviewed requests, and one result row per action.

    Accepts see the lexicon as it was; then renames, deletes and merges follow.
    """
    acts = fb.first_actions(actions)
    raised, accepted = fb.accept(acts, categories, prompts)
    renamed = fb.rename(acts, categories, now).drop("updated_at")
    deleted = fb.soft_delete(acts, renamed, now)
    pairs = acts.where("user_action = 'merge' AND target_category_id IS NOT NULL").select(F.col("category_id").alias("source"), F.col("target_category_id").alias("target"), "seq")
    merged, cats, counts = fb.merge(pairs, deleted, raised, now)
    known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("_k"))
    other = acts.where("user_action <> 'accept'").join(known, "category_id", "left").select(
        "feedback_request_id", "category_id", F.when(F.col("_k"), "ok").otherwise("no_category").alias("status"))
    results = accepted.select("feedback_request_id", "category_id", "status").unionByName(other) \
        .join(acts.select("feedback_request_id", "user_action"), "feedback_request_id")
    return {"prompts": merged, "categories": cats, "merge_counts": counts, "results": results, "versions": fb.version_nodes(results, now)}
