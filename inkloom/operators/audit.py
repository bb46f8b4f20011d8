"""Delivery audit dimensions, their verdict, and regression against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .episodes import DIM_KEYS, PLATE_DIM

# Audit thresholds.
CONTENT_LOSS_MAX = 0.02
RMSE_LOWFREQ_MAX, RMSE_RAW_MAX = 25.0, 60.0
TAC_LIMIT = 310.0
DUPLICATE_IOU = 0.9
BASE_DARK_DELTA = 20.0
INK_GRAY_DELTA = 12.0


def layer_properties(layers: DataFrame, by: str = "image_id", name: str = "layer") -> DataFrame:
    """Layer count, repeated names and invisible layers per artifact."""
    per = layers.groupBy(by, name).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("visible")).alias("_hidden"))
    dup, hidden = F.count_if(F.col("_n") > 1), F.sum("_hidden")
    return per.groupBy(by).agg(F.sum("_n").alias("layer_count"), dup.alias("duplicate_names"),
                               hidden.alias("invisible_layers"), ((dup == 0) & (hidden == 0)).alias("passed"))


def size_mismatches(layers: DataFrame, layer_px: DataFrame, by: tuple[str, str] = ("image_id", "layer")) -> DataFrame:
    """Layers whose pixel rows and columns differ from their box."""
    have = layer_px.groupBy(*by).agg((F.max("y") - F.min("y") + 1).alias("px_h"), (F.max("x") - F.min("x") + 1).alias("px_w"))
    j = layers.join(have, list(by), "left")
    bad = ~(F.coalesce("px_h", F.lit(0)).eqNullSafe(F.col("btm") - F.col("top"))
            & F.coalesce("px_w", F.lit(0)).eqNullSafe(F.col("rgt") - F.col("lft")))
    return j.groupBy(by[0]).agg(F.count_if(bad).alias("res_mismatch"), (F.count_if(bad) == 0).alias("passed"))


def declared_vs_actual(declared: DataFrame, actual: DataFrame, by: str = "run_id", name: str = "name") -> DataFrame:
    """Layer names that only one side knows."""
    d = declared.select(by, name).distinct().withColumn("_d", F.lit(True))
    a = actual.select(by, name).distinct().withColumn("_a", F.lit(True))
    both = d.join(a, [by, name], "full_outer")
    side = F.when(F.col("_d").isNull(), "undeclared").when(F.col("_a").isNull(), "absent")
    return both.withColumn("side", side).where("side IS NOT NULL").select(by, name, "side")


def manifest_consistency(declared: DataFrame, actual: DataFrame, by: str = "run_id") -> DataFrame:
    """Names declared and found per artifact, each pair seen once; a null never meets a null."""
    side = lambda df, d: df.select(by, "name", F.lit(d).alias("_d"))
    # a given number of partitions is not merged by bytes, which say little about the rows in them
    n = int(declared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = side(declared, True).unionByName(side(actual, False)).repartition(n, by, "name")
    both = pairs.groupBy(by, "name").agg(F.bool_or("_d").alias("_d"), F.bool_or(~F.col("_d")).alias("_a"))
    alone = F.col(by).isNull() | F.col("name").isNull()
    undeclared, absent = F.col("_a") & (~F.col("_d") | alone), F.col("_d") & (~F.col("_a") | alone)
    return both.groupBy(by).agg(F.count_if("_d").alias("declared"), F.count_if("_a").alias("actual"),
                                F.count_if(undeclared).alias("undeclared"), F.count_if(absent).alias("absent"),
                                (F.count_if(undeclared | absent) == 0).alias("passed"))


def metric_or_fail(metric: Column, ok: Column, label: str) -> tuple[Column, Column]:
    """A metric that could not be computed fails its dimension and says so."""
    return (F.coalesce(metric.isNotNull() & ok, F.lit(False)),
            F.when(metric.isNull(), F.lit(f"{label}: metric missing")).when(~ok, F.lit(f"{label}: over limit")))


def plate_compliance(runs: DataFrame) -> DataFrame:
    """Plate dimension per artifact; colour mode rgb does not apply.

    Needs color_mode, tac_max_pct, plate_purity_ok, generated_ratio, has_manifest.
    """
    plate = F.col("color_mode") == "cmyk"
    issues = F.array_compact(F.array(
        F.when(plate & F.col("has_manifest") & (F.col("tac_max_pct") > TAC_LIMIT), "tac_over_limit"),
        F.when(plate & F.col("has_manifest") & (F.col("plate_purity_ok") == F.lit(False)), "impure"),
        F.when(plate & F.col("has_manifest") & (F.col("generated_ratio") > 0), "generated_content")))
    return runs.select("run_id", (F.size(issues) == 0).alias("passed"), (plate & F.col("has_manifest")).alias("evaluated"),
                       (~plate).alias("na"), F.array_join(issues, ",").alias("issues"))


def verdict(dims: DataFrame, by: str = "artifact") -> DataFrame:
    """One verdict per artifact from its long table of dimensions.

    A skipped dimension passes with ``evaluated = false``; both flags are kept,
    because only admission asks whether a dimension was really checked.
    """
    listed = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("dim", "passed", "issue"))),
                                  lambda s: s["issue"].isNotNull()),
                         lambda s: F.concat(s["dim"], F.lit(": "), s["issue"]))
    return dims.groupBy(by).agg(
        F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"),
        F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed_dims"),
        F.count_if("evaluated").alias("evaluated_dims"), F.count_if("na").alias("na_dims"),
        F.array_join(listed, "; ").alias("issues"))


def dims_as_map(dims: DataFrame, by: str = "artifact") -> DataFrame:
    """The nested form that admission reads."""
    entry = F.struct("dim", F.struct("passed", "evaluated", "na").alias("v"))
    return dims.groupBy(by).agg(F.map_from_entries(F.collect_list(entry)).alias("dims"))


# ---- regression ------------------------------------------------------------

WORSE_WHEN_HIGHER = ("lost_ratio", "rmse_raw", "rmse_lowfreq", "tac_max_pct")


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 0.05, key: str = "task_id",
                dim_flags: tuple[str, ...] = ()) -> DataFrame:
    """Issues per task against its baseline.

    A zero baseline flags every positive value; tasks without a baseline are
    left to :func:`tasks_without_baseline`.
    """
    base = baseline.select(key, *[F.col(c).alias(f"b_{c}") for c in baseline.columns if c != key])
    j = current.join(base, key)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    checks = [F.when(zero(m) > zero(f"b_{m}") * (1 + tolerance), m) for m in WORSE_WHEN_HIGHER]
    bl, cl = F.coalesce("b_n_layers", F.lit(0)), F.coalesce("n_layers", F.lit(0))
    checks.append(F.when((bl > 0) & (cl < bl * (1 - tolerance)), "n_layers"))
    checks.append(F.when(F.coalesce("b_plate_purity_ok", F.lit(False)) & ~F.coalesce("plate_purity_ok", F.lit(False)), "plate_purity_ok"))
    for flag in ("passed", *dim_flags):
        checks.append(F.when((F.col(f"b_{flag}") == F.lit(True)) & (F.col(flag) == F.lit(False)), flag))
    issues = F.array_compact(F.array(*checks))
    return j.select(key, F.array_join(issues, ",").alias("issues"), F.size(issues).alias("n_issues"),
                    (F.size(issues) == 0).alias("regression_passed"))


def tasks_without_baseline(current: DataFrame, baseline: DataFrame, key: str = "task_id") -> DataFrame:
    return current.select(key).join(baseline.select(key), key, "left_anti")


def recommendation(n_issues: Column) -> Column:
    # The two recommendation texts.
    return F.when(n_issues == 0, "回归测试通过，可以采纳学习器的权重调整建议").otherwise(
        F.concat(F.lit("回归测试失败（"), n_issues, F.lit(" 个退化项），建议人工审核后再采纳")))


# ---- composite / source comparison ----------------------------------------

def rmse(pairs: DataFrame, channels: list[tuple[str, str]], by: list[str], name: str = "rmse_raw") -> DataFrame:
    """Root mean square difference over all channels of joined pixels."""
    err = sum(((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in channels), F.lit(0.0)) / len(channels)
    return pairs.groupBy(*by).agg(F.sqrt(F.avg(err)).alias(name))


def mean_abs_error(pairs: DataFrame, channels: list[tuple[str, str]], by: list[str], limit: float) -> DataFrame:
    err = sum((F.abs(F.col(a) - F.col(b)) for a, b in channels), F.lit(0.0)) / len(channels)
    return pairs.groupBy(*by).agg(F.avg(err).alias("mae"), (F.avg(err) <= limit).alias("passed"))


def dark_ratio(px: DataFrame, canvases: DataFrame, regions: dict[str, tuple], by: str = "image_id",
               delta: float = BASE_DARK_DELTA) -> DataFrame:
    """Share of base-layer pixels well below the layer's median, overall and per region."""
    med = px.groupBy(by).agg(F.percentile("gray", 0.5).alias("_med"))
    df = px.join(med, by).join(canvases, by).withColumn("_dark", (F.col("gray") < F.col("_med") - delta).cast("double"))
    inside = []
    for name, (x0, y0, x1, y1) in regions.items():
        rx = (F.col("x") >= F.floor(F.lit(x0) * F.col("w"))) & (F.col("x") < F.floor(F.lit(x1) * F.col("w")))
        ry = (F.col("y") >= F.floor(F.lit(y0) * F.col("h"))) & (F.col("y") < F.floor(F.lit(y1) * F.col("h")))
        inside.append(F.round(F.avg(F.when(rx & ry, F.col("_dark"))) * 100, 2).alias(f"dark_{name}"))
    return df.groupBy(by).agg(F.round(F.avg("_dark") * 100, 2).alias("dark_ratio_all"), *inside)


def base_layer(layers: DataFrame, words, by: str = "image_id") -> DataFrame:
    """First layer of each artifact whose name holds a keyword."""
    from .rules import has_any

    return layers.where(has_any(F.col("layer"), words)).groupBy(by).agg(
        F.min_by("layer", F.struct("position", "layer")).alias("base_layer"))


def effective_source(artifacts: DataFrame, effective: DataFrame, key: str = "artifact") -> DataFrame:
    """Audit source of each artifact: the rewritten one where it exists."""
    return artifacts.join(effective.select(key, F.col("path").alias("_eff")), key, "left").select(
        key, F.coalesce("_eff", "source_path").alias("source_path"), F.col("_eff").isNotNull().alias("source_effective"))


# ---- batch reports ---------------------------------------------------------

def batch_report(runs: DataFrame, by: str = "case_name") -> DataFrame:
    """Cold against repeated run per case: same bytes, audit result, reuse hit."""
    p = runs.groupBy(by).pivot("phase", ["cold", "repeat"]).agg(
        F.max("sha").alias("sha"), F.max("seconds").alias("seconds"), F.bool_and("audit_passed").alias("audit"),
        F.bool_or(F.col("log").rlike("reuse hit")).alias("hit"))
    return p.select(by, "cold_seconds", "repeat_seconds", "cold_audit", "repeat_audit", "repeat_hit",
                    F.coalesce(F.col("cold_sha") == F.col("repeat_sha"), F.lit(False)).alias("byte_reproducible"))


def corpus_coverage(samples: DataFrame, taxonomy: DataFrame, target: int = 15, key: str = "family") -> DataFrame:
    """Samples per taxonomy family against the target; families without samples are listed."""
    n = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(
        F.col("n").isNull(), "missing").when(F.col("n") < target, "short").otherwise("ok").alias("status"))


def classifier_report(preds: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class from one confusion table."""
    cm = preds.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    tp = cm.where(F.col(label) == F.col(pred)).select(F.col(label).alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col(label).alias("cls")).agg(F.sum("n").alias("support"))
    got = cm.groupBy(F.col(pred).alias("cls")).agg(F.sum("n").alias("predicted"))
    j = sup.join(got, "cls", "full_outer").join(tp, "cls", "left").na.fill(0, ["tp", "support", "predicted"])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec, rec = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    return j.select("cls", "support", "predicted", "tp", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(div(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), 6).alias("f1"))


def all_dims() -> tuple[str, ...]:
    return DIM_KEYS


PLATE = PLATE_DIM
