"""Ink limits, black generation and ink statistics on inverse CMYK codes (255 = no ink)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color

# Print conditions (id -> total ink limit %, black limit %).
PRINT_CONDITIONS = {
    "eci_coated_practice": (300.0, 96.0),
    "iso_coated_sheetfed": (330.0, 97.0),
    "iso_coated_web": (300.0, 97.0),
    "iso_uncoated": (260.0, 95.0),
    "us_web_coated": (300.0, 100.0),
    "newsprint": (240.0, 90.0),
}
DEFAULT_CONDITION = "eci_coated_practice"
EXPLICIT_MAX_K = 97.0
# Words in a profile description that hint at a condition, in order.
PROFILE_HINTS = (
    (("uncoated", "fogra47", "fogra29", "inp"), "iso_uncoated"),
    (("news", "snp", "newspaper"), "newsprint"),
    (("psocoated", "fogra51", "psocoated_v3"), "eci_coated_practice"),
    (("isocoated", "fogra39", "coated_fogra"), "eci_coated_practice"),
)
# Allowed ranges of the black generation parameters.
GAIN_RANGE, GAMMA_RANGE, SHIFT_RANGE = (0.0, 2.0), (0.1, 3.0), (-100.0, 100.0)
# Fixed values: (gain, gamma) pairs tried in calibration, identity first.
BLACK_CANDIDATES = ((1.00, 1.00), (1.10, 1.00), (1.20, 1.00), (1.35, 1.00), (1.00, 0.90),
                    (1.00, 0.80), (1.15, 0.90), (1.30, 0.85), (0.90, 1.10), (0.80, 1.20))


@dataclass(frozen=True)
class InkPolicy:
    limit_pct: float = 300.0
    max_k_pct: float = 96.0


def resolve_policy(condition: Column, limit_pct: Column, max_k_pct: Column, description: Column) -> dict[str, Column]:
    """Explicit limit, else known condition, else profile hint, else default."""
    desc = F.replace(F.lower(F.coalesce(description, F.lit(""))), F.lit(" "), F.lit(""))
    hint = F.lit(None).cast("string")
    for words, cond in reversed(PROFILE_HINTS):
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(desc, F.lit(w))
        hint = F.when(hit, cond).otherwise(hint)
    known = F.when(condition.isin(*PRINT_CONDITIONS), condition)
    chosen = F.coalesce(known, hint, F.lit(DEFAULT_CONDITION))
    table = lambda i: F.create_map(*[F.lit(x) for k, v in PRINT_CONDITIONS.items() for x in (k, v[i])])[chosen]
    explicit = limit_pct.isNotNull()
    return {
        "limit_pct": F.when(explicit, limit_pct.cast("double")).otherwise(table(0)),
        "max_k_pct": F.when(explicit, F.coalesce(max_k_pct.cast("double"), F.lit(EXPLICIT_MAX_K))).otherwise(table(1)),
        "condition_id": F.when(explicit, F.coalesce(condition, F.lit("preset"))).otherwise(chosen),
    }


def tac_pct(c="c", m="m", yl="yl", k="k") -> Column:
    return (1020 - F.col(c) - F.col(m) - F.col(yl) - F.col(k)) / 255.0 * 100.0


def limit_ink(inks: DataFrame, limit_pct: Column | float = 300.0, max_k_pct: Column | float = 96.0) -> DataFrame:
    """Cap black, then scale C/M/Y so that the total meets the limit with black kept.

    Adds c2, m2, yl2, k2 plus the flags k_over and over.  Codes round up, which
    rounds ink down, so the result never exceeds the limit.
    """
    lim = (limit_pct if isinstance(limit_pct, Column) else F.lit(float(limit_pct))) / 100.0 * 255.0
    mk = (max_k_pct if isinstance(max_k_pct, Column) else F.lit(float(max_k_pct))) / 100.0 * 255.0
    df = inks.withColumn("_lim", lim).withColumn("_mk", F.ceil(F.lit(255.0) - mk).cast("int"))
    total = 1020 - F.col("c") - F.col("m") - F.col("yl") - F.col("k")
    df = df.withColumn("k_over", F.col("k") < F.col("_mk")).withColumn(
        "over", (total - F.greatest(F.col("_mk") - F.col("k"), F.lit(0))) > F.floor("_lim"))
    df = df.withColumn("_k1", F.greatest("k", "_mk"))
    cmy = (765 - F.col("c") - F.col("m") - F.col("yl")).cast("double")
    room = F.greatest(F.col("_lim") - (255 - F.col("_k1")), F.lit(0.0))
    df = df.withColumn("_ratio", F.least(F.lit(1.0), room / F.greatest(cmy, F.lit(1e-6))))
    squeeze = lambda ch: F.when(F.col("over"), F.least(F.lit(255), F.greatest(F.lit(0), F.ceil(
        F.lit(255.0) - (255 - F.col(ch)) * F.col("_ratio")))).cast("int")).otherwise(F.col(ch))
    k2 = F.when(F.col("over") & ((255 - F.col("_k1")) > F.col("_lim")), F.ceil(F.lit(255.0) - F.col("_lim")).cast("int")) \
        .otherwise(F.col("_k1"))
    return df.withColumns({"c2": squeeze("c"), "m2": squeeze("m"), "yl2": squeeze("yl"), "k2": k2}) \
        .drop("_lim", "_mk", "_k1", "_ratio")


def limit_stats(limited: DataFrame, by: str = "image_id", limit_pct: Column | float = 300.0) -> DataFrame:
    """Totals before and after, clipped pixels and compliance per image."""
    before, after = tac_pct(), tac_pct("c2", "m2", "yl2", "k2")
    lim = limit_pct if isinstance(limit_pct, Column) else F.lit(float(limit_pct))
    return limited.groupBy(by).agg(
        F.round(F.max(before), 2).alias("tac_before_max"), F.round(F.avg(before), 2).alias("tac_before_mean"),
        F.round(F.max(after), 2).alias("tac_after_max"), F.round(F.avg(after), 2).alias("tac_after_mean"),
        F.count_if("over").alias("tac_clipped_pixels"),
        F.round(F.count_if("over") / F.count(F.lit(1)), 6).alias("tac_clipped_ratio"),
        F.count_if("k_over").alias("k_clipped_pixels"),
        (F.max(after - lim) <= 1e-6).alias("compliant"))


def audit_tac(inks: DataFrame, by: str = "image_id", limit_pct: float = 300.0) -> DataFrame:
    """Total ink statistics without changing anything."""
    t = tac_pct()
    return inks.groupBy(by).agg(
        F.round(F.max(t), 2).alias("tac_max"), F.round(F.avg(t), 2).alias("tac_mean"),
        F.round(F.max((255 - F.col("k")) / 255.0 * 100.0), 2).alias("max_k_pct"),
        F.round(F.avg((t > limit_pct).cast("double")), 6).alias("over_limit_ratio"),
        (F.max(t) <= limit_pct + 1e-6).alias("compliant"))


def black_generation(inks: DataFrame, k_gain: float = 1.0, k_gamma: float = 1.0, k_shift_pct: float = 0.0,
                     suffix: str = "") -> DataFrame:
    """Black curve with C/M/Y reduced by the black that was added; identity returns the input.

    Codes are floored as the original does, although that rounds ink up.
    """
    clip = lambda v, r: min(max(float(v), r[0]), r[1])
    gain, gamma, shift = clip(k_gain, GAIN_RANGE), clip(k_gamma, GAMMA_RANGE), clip(k_shift_pct, SHIFT_RANGE)
    if abs(gain - 1) < 1e-9 and abs(gamma - 1) < 1e-9 and abs(shift) < 1e-9:
        if not suffix:
            return inks
        return inks.withColumns({f"{ch}{suffix}": F.col(ch) for ch in ("c", "m", "yl", "k")})
    ik = (255 - F.col("k")).cast("double")
    box = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    new = box(F.pow(box(ik) / 255.0, F.lit(gamma)) * 255.0 * gain + shift / 100.0 * 255.0)
    df = inks.withColumn("_new", new).withColumn("_d", F.col("_new") - (255 - F.col("k")))
    cmy = lambda ch: color.byte(F.lit(255.0) - box((255 - F.col(ch)) - F.col("_d")))
    return df.withColumns({f"c{suffix}": cmy("c"), f"m{suffix}": cmy("m"), f"yl{suffix}": cmy("yl"),
                           f"k{suffix}": color.byte(F.lit(255.0) - F.col("_new"))}).drop("_new", "_d")


def black_presence(inks: DataFrame) -> DataFrame:
    """Share of pixels with black ink of each image, over all its pixels."""
    kk = F.col("k") / 255.0
    return inks.groupBy("image_id").agg(
        F.round(F.avg((kk < 0.999).cast("double")) * 100, 1).alias("k_channel_nonzero_pct"),
        F.round(F.avg((kk < 0.5).cast("double")) * 100, 1).alias("k_channel_strong_pct"),
        F.round(F.avg(1 - kk) * 100, 2).alias("k_ink_mean_pct"))


def calibrate_black(pixels: DataFrame, limit_pct: float = 300.0, max_k_pct: float = 96.0,
                    candidates=BLACK_CANDIDATES, by: str = "image_id") -> DataFrame:
    """Metrics of every candidate curve per image, in one pass over the pixels.

    ``pixels`` carries b, g, r and the separated c, m, yl, k of the same pixel.
    Appearance is the plain multiply-by-black model, since profiles are not read,
    and the colour error is taken on the pixels themselves.
    """
    arms = F.explode(F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(g).alias("gain"), F.lit(p).alias("gamma"))
                               for i, (g, p) in enumerate(candidates)]))
    df = pixels.withColumn("_a", arms).select("*", "_a.*").drop("_a")
    ik = (255 - F.col("k")).cast("double")
    box = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))
    ident = (F.col("gain") == 1.0) & (F.col("gamma") == 1.0)
    df = df.withColumn("_new", F.when(ident, ik).otherwise(box(F.pow(ik / 255.0, F.col("gamma")) * 255.0 * F.col("gain"))))
    cmy = lambda ch: color.byte(F.lit(255.0) - box((255 - F.col(ch)) - (F.col("_new") - ik)))
    df = df.withColumns({"c": cmy("c"), "m": cmy("m"), "yl": cmy("yl"), "k": color.byte(F.lit(255.0) - F.col("_new"))})
    lim = limit_ink(df, limit_pct, max_k_pct)
    r2, g2, b2 = color.inverse_cmyk_to_rgb(F.col("c2"), F.col("m2"), F.col("yl2"), F.col("k2"))
    err = (F.pow(F.col("r") - r2, 2) + F.pow(F.col("g") - g2, 2) + F.pow(F.col("b") - b2, 2)) / 3
    ink = 255 - F.col("k2")
    return lim.groupBy(by, "cand", "gain", "gamma").agg(
        F.round(F.avg(ink) / 255.0 * 100, 3).alias("k_mean_pct"),
        F.round(F.avg((ink > 0.05 * 255).cast("double")) * 100, 2).alias("k_nonzero_pct"),
        F.round(F.max(tac_pct("c2", "m2", "yl2", "k2")), 2).alias("tac_max_pct"),
        F.round(F.sqrt(F.avg(err)), 3).alias("color_rmse"))


def recommend_black(metrics: DataFrame, by: str = "image_id", tolerance: float = 1.15) -> DataFrame:
    """Most black coverage whose colour error stays within 115% of the identity's."""
    base = metrics.where("gain = 1.0 AND gamma = 1.0").select(by, (F.col("color_rmse") * tolerance + 1e-6).alias("_tol"))
    ok = metrics.join(base, by).where(F.col("color_rmse") <= F.col("_tol"))
    best = ok.groupBy(by).agg(F.min_by(
        F.struct("cand", "gain", "gamma", "k_nonzero_pct", "color_rmse"),
        F.struct(-F.col("k_nonzero_pct"), F.col("color_rmse"), F.col("cand"))).alias("b"))
    return best.select(by, "b.*").withColumn("action", F.when(F.col("cand") == 0, "keep_identity").otherwise("tune"))
