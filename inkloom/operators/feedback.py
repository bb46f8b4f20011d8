"""Human feedback applied to the lexicon as set-wise snapshot rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCEPT_FACTOR = 1.1


def first_actions(actions: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """One action per request, requests reviewed before left out: applying twice changes nothing."""
    once = actions.groupBy("feedback_request_id").agg(F.min_by(F.struct(*actions.columns), "seq").alias("_r")).select("_r.*")
    return once if reviewed is None else once.join(reviewed.select("feedback_request_id"), "feedback_request_id", "left_anti")


def accept(actions: DataFrame, categories: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raise all prompts of accepted live categories; (new prompts, result per action)."""
    acts = actions.where("user_action = 'accept'").select("feedback_request_id", "category_id")
    live = categories.where("deleted_at IS NULL").select(F.col("id").alias("category_id"), F.lit(True).alias("_live"))
    n = prompts.groupBy("category_id").agg(F.count(F.lit(1)).alias("affected"))
    result = acts.join(live, "category_id", "left").join(n, "category_id", "left").select(
        "feedback_request_id", "category_id",
        F.when(F.col("_live").isNull(), "no_category").when(F.col("affected").isNull(), "no_prompt").otherwise("ok").alias("status"),
        F.when(F.col("_live"), F.coalesce("affected", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("affected"))
    times = result.where("status = 'ok'").groupBy("category_id").agg(F.count(F.lit(1)).alias("_t"))
    t = F.coalesce("_t", F.lit(0))
    raised = prompts.join(times, "category_id", "left").withColumn("weight", F.col("weight") * F.pow(F.lit(ACCEPT_FACTOR), t)) \
        .withColumn("n_accept", F.col("n_accept") + t).drop("_t")
    return raised, result


def renamed_template(old: Column, zh: Column, en: Column) -> Column:
    """Keep a short leading tag of the old template and rebuild the rest."""
    head = F.split_part(old, F.lit("_"), F.lit(1))
    keep = F.contains(old, F.lit("_")) & head.rlike(r"^[\p{L}\p{N}]{1,4}$")
    prefix = F.when(F.coalesce(keep, F.lit(False)), F.concat(head, F.lit("_"))).otherwise("")
    return F.concat(prefix, zh, F.when(F.coalesce(en, F.lit("")) != "", F.concat(F.lit("_"), en)).otherwise(""))


def rename(actions: DataFrame, categories: DataFrame, now: int) -> DataFrame:
    """Categories after renames; the last rename of a category wins."""
    acts = actions.where("user_action = 'rename' AND trim(coalesce(new_name, '')) <> ''").groupBy("category_id").agg(
        F.max_by(F.struct(F.trim("new_name").alias("zh"), F.nullif(F.trim("new_name_en"), F.lit("")).alias("en")), "seq").alias("_n"))
    j = categories.join(acts.withColumnRenamed("category_id", "id"), "id", "left")
    hit = F.col("_n").isNotNull()
    en = F.coalesce("_n.en", "name_en")
    return j.withColumns({
        "name_template": F.when(hit, renamed_template(F.col("name_template"), F.col("_n.zh"), en)).otherwise(F.col("name_template")),
        "name_zh": F.when(hit, F.col("_n.zh")).otherwise(F.col("name_zh")),
        "name_en": F.when(hit, F.nullif(en, F.lit(""))).otherwise(F.col("name_en")),
        "updated_at": F.when(hit, F.lit(now)).otherwise(F.lit(None))}).drop("_n")


def soft_delete(actions: DataFrame, categories: DataFrame, now: int) -> DataFrame:
    ids = actions.where("user_action = 'delete'").select(F.col("category_id").alias("id")).distinct().withColumn("_d", F.lit(True))
    return categories.join(ids, "id", "left").withColumn(
        "deleted_at", F.when(F.col("_d"), F.lit(now).cast("long")).otherwise(F.col("deleted_at"))).drop("_d")


def _last_targets(ends: DataFrame) -> DataFrame:
    """Follows (source, _end, _s) to merges of the end that come later in the batch; one join a link of the longest chain."""
    later = ends.select(F.col("source").alias("_end"), F.col("_end").alias("_next"), F.col("_s").alias("_ns"))
    while True:
        step = ends.join(later, "_end", "left").withColumn("_go", F.coalesce(F.col("_ns") > F.col("_s"), F.lit(False)))
        if step.where("_go").isEmpty():
            return ends
        ends = cut_lineage(step.select("source", F.when(F.col("_go"), F.col("_next")).otherwise(F.col("_end")).alias("_end"),
                                       F.when(F.col("_go"), F.col("_ns")).otherwise(F.col("_s")).alias("_s")))


def merge(pairs: DataFrame, categories: DataFrame, prompts: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move prompts of ``source`` to ``target``; equal prompts keep the larger weight.

    Returns (prompts, categories, counts per pair).  Pairs whose ends are unknown
    or equal are ignored, and a source is merged once, into its first target: that
    of the smallest ``seq`` where pairs have one, else the smallest name.  A target
    that is itself merged later in the batch hands its prompts on.
    """
    ids = categories.select("id")
    ok = pairs.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi") \
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    ok = ok.groupBy("source").agg(F.min_by("target", F.struct("seq", "target")).alias("target"), F.min("seq").alias("_s")) if "seq" in pairs.columns \
        else ok.groupBy("source").agg(F.min("target").alias("target"), F.lit(0).alias("_s"))
    ends = ok.select("source", F.col("target").alias("_end"), "_s")
    if "seq" in pairs.columns:
        ends = _last_targets(ends)
    ok = ok.drop("_s")
    moved = prompts.join(ok.withColumnRenamed("source", "category_id"), "category_id", "left") \
        .join(ends.select(F.col("source").alias("category_id"), "_end"), "category_id", "left")
    final = F.coalesce("_end", "category_id")
    tagged = moved.withColumn("_moved", F.col("target").isNotNull()).withColumn("category_id", final)
    cols = [c for c in prompts.columns if c != "category_id"]
    # the target's own row stays unless a moved one is heavier
    merged = tagged.groupBy("category_id", "prompt").agg(
        F.max_by(F.struct(*cols), F.struct(~F.col("_moved"), F.col("weight"))).alias("_r"), F.max("weight").alias("_w"))
    out = merged.select("category_id", *[F.col("_w").alias("weight") if c == "weight" else F.col(f"_r.{c}").alias(c) for c in cols])
    own = prompts.select(F.col("category_id").alias("target"), "prompt", F.col("weight").alias("_tw"))
    src = moved.where("target IS NOT NULL").select(F.col("category_id").alias("source"), "target", "prompt", "weight") \
        .join(own, ["target", "prompt"], "left")
    counts = src.groupBy("source", "target").agg(
        F.count_if(F.col("_tw").isNull()).alias("migrated"), F.count_if(F.col("weight") > F.col("_tw")).alias("merged"),
        F.count_if(F.col("weight") <= F.col("_tw")).alias("kept"))
    gone = ok.select(F.col("source").alias("id"), F.lit(True).alias("_d"))
    cats = categories.join(gone, "id", "left").withColumn(
        "deleted_at", F.when(F.col("_d"), F.lit(now).cast("long")).otherwise(F.col("deleted_at"))).drop("_d")
    return out, cats, counts


def version_nodes(results: DataFrame, now: int) -> DataFrame:
    """One pending version per successful action."""
    return results.where("status = 'ok'").select(
        F.concat(F.lit("v"), F.col("feedback_request_id")).alias("version_id"),
        F.concat(F.lit("human_feedback:"), F.col("user_action"), F.lit(":"), F.col("category_id")).alias("changeset"),
        F.lit("pending").alias("regression_status"), F.lit(now).cast("long").alias("created_at"))


def pending_requests(requests: DataFrame, reviews: DataFrame, limit: int | None = None) -> DataFrame:
    """Requests without a review event, oldest first."""
    open_ = requests.join(reviews.select("feedback_request_id"), "feedback_request_id", "left_anti").orderBy("seq")
    return open_.limit(limit) if limit else open_


def feedback_id(ts: Column, task: Column) -> Column:
    return F.concat(F.lit("fb_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.sha1(task), 1, 6))


def merge_bands(existing: DataFrame, suggested: DataFrame) -> DataFrame:
    """Density bands of a preset after accepting suggestions: upsert by label, new values win."""
    s = suggested.where("label <> ''").select("preset", F.col("label").alias("name"), F.col("density_min").alias("_lo"),
                                              F.col("density_max").alias("_hi"), F.lit(True).alias("_s"))
    j = existing.join(s, ["preset", "name"], "full_outer")
    hit = F.col("_s").isNotNull()
    return j.select("preset", "name", F.when(hit, F.col("_lo")).otherwise(F.col("density_min")).alias("density_min"),
                    F.when(hit, F.col("_hi")).otherwise(F.col("density_max")).alias("density_max"), hit.alias("updated"))


def apply_tuning(classes: DataFrame, saved: DataFrame) -> DataFrame:
    """Regions of a similar run put on the classes of the same name."""
    return classes.join(saved.select("name", F.col("region").alias("_r")), "name", "left").select(
        *[F.coalesce("_r", "region").alias("region") if c == "region" else F.col(c) for c in classes.columns],
        F.col("_r").isNotNull().alias("applied"))
