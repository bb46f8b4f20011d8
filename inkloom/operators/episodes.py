"""Signals, weight learning, priors and admission over run episodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lexicon import ancestors, learned_weight
from .rollup import lift, lifted_moments, lifted_percentiles

# The eight audit dimensions in report order.
DIM_KEYS = ("① 层属性", "② 分辨率真实性", "③ 实例重复", "④ 内容承载",
            "⑤ 合成等价性", "⑥ 底板纯净度", "⑦ plate 合规", "⑧ manifest 一致")
PLATE_DIM = "⑦ plate 合规"
# Default texts of the two gates.
QUALITY_FAILED, QUALITY_MISSING = "质量门未通过", "质量门缺字段(未评估)"
DIFFUSE_FAILED, DIFFUSE_MISSING = "弥散门未通过", "弥散门缺字段(未评估)"

REJECT_PENALTY, ACCEPT_BOOST = 0.8, 1.1
WEIGHT_MIN, WEIGHT_MAX = 0.05, 5.0


def _filled(col: str) -> Column:
    return F.nullif(F.col(col), F.lit(""))


def category_key() -> Column:
    return F.coalesce(_filled("category_id"), _filled("layer_name"), F.lit("unknown"))


def signal() -> Column:
    """accept / quality_reject / diffuse_reject; a gate that was never run rejects."""
    return F.when(~F.coalesce("quality_gate_passed", F.lit(False)), "quality_reject") \
        .when(~F.coalesce("diffuse_gate_passed", F.lit(False)), "diffuse_reject").otherwise("accept")


def attributions(detections: DataFrame) -> DataFrame:
    """One (category, prompt, signal, reason) row per detection with a prompt."""
    reason = F.when(F.col("signal") == "accept", "").when(
        F.col("signal") == "quality_reject",
        F.coalesce(_filled("quality_gate_reason"),
                   F.when(F.col("quality_gate_passed").isNull(), QUALITY_MISSING).otherwise(QUALITY_FAILED))).otherwise(
        F.coalesce(_filled("diffuse_gate_reason"),
                   F.when(F.col("diffuse_gate_passed").isNull(), DIFFUSE_MISSING).otherwise(DIFFUSE_FAILED)))
    kept = detections.where("prompt <> ''").withColumn("category_id", category_key()).withColumn("signal", signal())
    return kept.withColumn("reason", reason).select("episode_id", "seq", "category_id", "prompt", "signal", "reason")


def signal_counts(attributed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Signal counts per (category, prompt) and per category in one pass."""
    count = lambda s: F.count_if(F.col("signal") == s)
    keys = [F.col(c) for c in (*by, "category_id")]
    return attributed.groupingSets([[*keys, F.col("prompt")], keys], *keys, F.col("prompt")).agg(
        F.grouping("prompt").alias("level"), count("accept").alias("n_accept"),
        count("quality_reject").alias("n_quality_reject"), count("diffuse_reject").alias("n_diffuse_reject"))


def uncertain_detections(detections: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Detections under the confidence threshold; the best logit stands in for a missing value."""
    conf = F.coalesce("confidence", F.array_max("logits"), F.lit(0.0))
    return detections.withColumn("category_id", F.coalesce(_filled("category_id"), _filled("layer_name"))) \
        .withColumn("confidence", conf).where(F.col("confidence") < threshold) \
        .withColumn("logit", F.array_max("logits"))


def clamp_weight(w: Column) -> Column:
    return F.greatest(F.lit(WEIGHT_MIN), F.least(F.lit(WEIGHT_MAX), w))


def weight_updates(attributed: DataFrame, prompts: DataFrame | None) -> DataFrame:
    """Suggested weight per (episode, category, prompt).

    Any reject in an episode wins over its accepts.  Pairs the lexicon does not
    know keep a NULL weight and are reported, not adjusted; without a lexicon
    the base weight is 1.
    """
    per = attributed.groupBy("episode_id", "category_id", "prompt").agg(
        F.count_if(F.col("signal") == "accept").alias("n_accept"),
        F.count_if(F.col("signal") != "accept").alias("n_reject"), F.min("seq").alias("seq"))
    per = per.withColumn("old_weight", F.lit(1.0)) if prompts is None else learned_weight(per, prompts)
    factor = F.when(F.col("n_reject") > 0, F.pow(F.lit(REJECT_PENALTY), F.col("n_reject"))) \
        .otherwise(F.pow(F.lit(ACCEPT_BOOST), F.col("n_accept")))
    new = F.when(F.col("old_weight").isNotNull(), clamp_weight(F.col("old_weight") * factor))
    sig = F.when(F.col("old_weight").isNull(), "unknown").when(F.col("n_reject") > 0, "reject").otherwise("accept")
    return per.withColumn("new_weight", new).withColumn("signal", sig)


def fold_updates(updates: DataFrame, order: str = "seq", chunk: int = 8192) -> DataFrame:
    """Chain the episodes' updates per (category, prompt), clamping after each.

    ``order`` is a whole number, by default the place of the record.
    "Multiply, then clamp" maps compose into one map of the same shape
    ``x -> min(hi, max(lo, a*x))``, so ordered chunks are folded on their own and
    the chunk maps are folded again until no number is left to tell chunks
    apart.  No list ever holds more than ``chunk`` entries, however often a
    pair occurs; rows of a pair with equal order are folded by episode.
    """
    known = updates.where("old_weight IS NOT NULL")
    ratio = F.when(F.col("old_weight") > 0, F.col("new_weight") / F.col("old_weight")).otherwise(1.0)  # from 0 only the clamp moves
    steps = known.select("category_id", "prompt", F.col(order).cast("long").alias("_o"), F.col("episode_id").cast("string").alias("_e"),
                         ratio.alias("a"), F.lit(WEIGHT_MIN).alias("lo"), F.lit(WEIGHT_MAX).alias("hi"))

    def compose(acc, nxt):
        bound = lambda v: F.least(nxt["hi"], F.greatest(nxt["lo"], nxt["a"] * v))
        return F.struct((acc["a"] * nxt["a"]).alias("a"), bound(acc["lo"]).alias("lo"), bound(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    # five floor divisions by 8192 leave 0 or -1 of any long; the last fold joins these two
    levels = math.ceil(63 / math.log2(chunk))
    for level in range(levels + 1):
        last = level == levels
        keys = ["category_id", "prompt"] + ([] if last else [F.floor(F.col("_o") / chunk).alias("_n")])
        steps = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", "_e", "a", "lo", "hi"))).alias("_l"))
        steps = steps.select("category_id", "prompt", (F.lit(0) if last else F.col("_n")).cast("long").alias("_o"), F.lit("").alias("_e"),
                             F.aggregate("_l", start, compose).alias("m")).select("category_id", "prompt", "_o", "_e", "m.*")
    totals = known.groupBy("category_id", "prompt").agg(
        F.max("old_weight").alias("old_weight"), F.count_if(F.col("signal") == "accept").alias("n_accept"),
        F.count_if(F.col("signal") == "reject").alias("n_reject"))
    new = F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("a") * F.col("old_weight")))
    return totals.join(steps.drop("_o", "_e"), ["category_id", "prompt"]).select(
        "category_id", "prompt", "old_weight", new.alias("new_weight"), "n_accept", "n_reject")


# ---- priors ----------------------------------------------------------------

def _shape_columns(boxes: DataFrame) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    return boxes.where("w > 0 AND h > 0 AND category_id <> ''").select(
        "episode_id", "category_id", (w * h).alias("area"),
        (F.greatest(w, h) / F.least(w, h)).alias("elongation"),
        (F.lit(math.pi) * w * h / F.pow(w + h, 2)).alias("compactness"))


def category_priors(boxes: DataFrame, edges: DataFrame | None = None, min_samples: int = 3) -> DataFrame:
    """Area band, shape moments and usual instance count per category.

    With ``edges`` every box also counts for all ancestors: states of the leaves are lifted and merged, so the figures are
    those over all boxes below a category, though no box is copied.
    """
    up = None if edges is None else cut_lineage(ancestors(edges).select(F.col("id").alias("category_id"), "ancestor"))
    shapes = _shape_columns(boxes)
    bands = lifted_percentiles(shapes, up, {"area_budget_min": 0.1, "area_budget_max": 0.9}, value="area")
    moments = lifted_moments(shapes, up, ["elongation", "compactness"])
    # most frequent count, the smaller one on ties; counting first keeps the state small
    counts = boxes.where("category_id <> ''").groupBy("episode_id", "category_id").agg(F.count(F.lit(1)).alias("c"))
    freq = lift(cut_lineage(counts.groupBy("category_id", "c").agg(F.count(F.lit(1)).alias("f"))), up, ["c"], ["f"])
    mode = freq.groupBy("category_id").agg(F.min_by("c", F.struct(-F.col("f"), F.col("c"))).alias("n_components_mode"))
    return moments.where(F.col("n_samples") >= min_samples).join(bands, "category_id").join(mode, "category_id", "left")


# ---- admission -------------------------------------------------------------

def bound_once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated a single time, however often ``fn`` uses it.

    The optimizer otherwise copies the expression behind a column into every use.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))



def admission_reason(dims: Column, output_mode: Column) -> Column:
    """First failing required dimension, ``ok`` when all hold.

    ``dims`` maps a dimension to struct(passed, evaluated, na); NULL means that
    no full report exists.  The design line does not need the plate dimension.
    """
    keys = F.array(*[F.lit(k) for k in DIM_KEYS])
    needed = F.when(F.lower(F.coalesce(output_mode, F.lit(""))) == "design",
                    F.array_except(keys, F.array(F.lit(PLATE_DIM)))).otherwise(keys)

    def verdict(k, d):
        return F.when(d.isNull(), F.concat(F.lit("missing_dim:"), k)) \
            .when(F.coalesce(d["na"], F.lit(False)) | ~F.coalesce(d["evaluated"], F.lit(False)),
                  F.concat(F.lit("not_evaluated:"), k)) \
            .when(~F.coalesce(d["passed"], F.lit(False)), F.concat(F.lit("failed:"), k))

    def first_failing(m):
        found = F.transform(needed, lambda k: bound_once(F.try_element_at(m, k), lambda d: verdict(k, d)))
        return F.when(m.isNull(), "no_full_report").otherwise(
            F.coalesce(F.get(F.filter(found, lambda r: r.isNotNull()), F.lit(0)), F.lit("ok")))

    return bound_once(dims, first_failing)


def describe_reason(reason: Column) -> Column:
    """Readable form of an admission reason."""
    kind, dim = F.split_part(reason, F.lit(":"), F.lit(1)), F.split_part(reason, F.lit(":"), F.lit(2))
    # The texts shown for each reason code.
    return F.when(reason == "no_full_report", "审计报告缺少完整 8 维 'dims'（旧式/不完整报告，已拒绝收口）") \
        .when(reason == "no_episode_log", "episode 日志不存在") \
        .when(reason == "episode_not_found", "未找到对应 episode 记录") \
        .when(kind == "missing_dim", F.concat(F.lit("缺必需审计维度："), dim)) \
        .when(kind == "not_evaluated", F.concat(F.lit("必需维度未真正核验："), dim)) \
        .when(kind == "failed", F.concat(F.lit("必需维度未通过："), dim)) \
        .otherwise(F.coalesce(F.nullif(reason, F.lit("")), F.lit("unknown")))


def audit_summary(metrics: Column, passed: Column) -> list[Column]:
    """Short view of a full report; ``metrics`` maps dimension -> metric map. Missing stays NULL."""
    pick = lambda dim, key, typ: F.try_element_at(F.try_element_at(metrics, F.lit(dim)), F.lit(key)).cast(typ)
    return [pick("④ 内容承载", "lost_ratio", "double").alias("lost_ratio"),
            pick("⑤ 合成等价性", "rmse_lowfreq", "double").alias("rmse_lowfreq"),
            pick("⑤ 合成等价性", "rmse_raw", "double").alias("rmse_raw"),
            pick("⑦ plate 合规", "plate_purity_ok", "boolean").alias("plate_purity_ok"),
            pick("⑦ plate 合规", "tac_max_pct", "double").alias("tac_max_pct"),
            pick("① 层属性", "layer_count", "int").alias("n_layers"), passed.alias("passed")]


def regression_metrics(metrics: Column, passed: Column) -> list[Column]:
    """The same fields with the defaults regression needs: 0 and pure."""
    defaults = {"lost_ratio": 0.0, "rmse_lowfreq": 0.0, "rmse_raw": 0.0, "plate_purity_ok": True,
                "tac_max_pct": 0.0, "n_layers": 0}
    names = ["lost_ratio", "rmse_lowfreq", "rmse_raw", "plate_purity_ok", "tac_max_pct", "n_layers", "passed"]
    return [F.coalesce(c, F.lit(defaults[n])).alias(n) if n in defaults else c
            for n, c in zip(names, audit_summary(metrics, passed))]


# ---- upserts ---------------------------------------------------------------

def patch_records(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """New snapshot of ``base`` where non-NULL patch fields win."""
    fields = [c for c in patch.columns if c != key]
    renamed = patch.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    out = base.join(renamed, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def first_by_id(log: DataFrame, key: str = "episode_id", order: str = "seq") -> DataFrame:
    """First record of every id."""
    row = F.struct(*log.columns)
    return log.groupBy(key).agg(F.min_by(row, F.col(order)).alias("_r")).select("_r.*")


def last_by_id(log: DataFrame, key: str = "episode_id", order: str = "seq") -> DataFrame:
    """Last record of every id: how an append-only status log is read."""
    row = F.struct(*log.columns)
    return log.groupBy(key).agg(F.max_by(row, F.col(order)).alias("_r")).select("_r.*")


def month_of_task(task_id: Column) -> Column:
    """``YYYY-MM`` from ``task_YYYYMMDD_...``; NULL when the id has no date."""
    y = F.regexp_extract(task_id, r"task_(\d{4})(\d{2})\d{2}_", 1)
    m = F.regexp_extract(task_id, r"task_(\d{4})(\d{2})\d{2}_", 2)
    return F.when(y != "", F.concat(y, F.lit("-"), m))
