"""Ordered keyword and threshold rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Area budget per keyword group, first match wins.
AREA_BUDGETS = (
    (("seal", "印章", "cinnabar", "朱红"), 0.005),
    (("calligraphy", "题跋", "inscription", "款识"), 0.02),
    (("geese", "芦雁", "fauna", "禽"), 0.02),
    (("figures", "人物", "高士", "attendant"), 0.03),
    (("pavilion", "草堂", "architecture", "建筑"), 0.05),
    (("trees", "枯木", "林", "vegetation"), 0.20),
    (("cliffs", "峭壁", "墨岩", "mountain", "山"), 0.25),
    (("seam", "折痕", "fold"), 0.05),
    (("frame", "外框", "brocade"), 0.35),
)
DEFAULT_AREA_BUDGET = 0.15
INSTANCE_BUDGET_FACTOR = 3.0
MAX_EXPANSION_FACTOR = 3.0
MIN_SHAPE_IOU = 0.02
MAX_BOX_AREA_RATIO = 0.08
MAX_BBOX_AREA_RATIO = 0.5
# Layers that may cover the whole canvas.
BBOX_EXEMPT = ("base", "底板", "frame", "外框", "brocade", "绫边", "fold", "seam", "折痕", "residue", "残层",
               "unclassified", "背景带", "photo_background")
# Layers judged only for being empty.
REGION_LAYERS = ("远山", "mountain", "水波", "ripple", "折痕", "seam", "fold", "外框", "frame", "brocade", "底板",
                 "base", "ground")
# Press-work layers that carry no picture content.
PROCESS_LAYERS = ("DieCut", "Perforations", "Foil", "Trap", "Spot", "冲孔", "烫金", "陷印", "专色")
# Support and decoration layers outside the content statistics.
SUPPORT_LAYERS = ("Gold_Base", "Fabric_Base", "Base_Ground", "底板", "Brocade_Outer_Frame", "Panel_Fold_Seams",
                  "外框", "折痕")
# Keywords of the base layer.
BASE_LAYER_WORDS = ("Base_Ground", "底版", "底板", "Substrate", "Gold_Base", "Fabric_Base")
# Fixed values: (keywords, base depth, blend, opacity), first match wins.
Z_ORDER = (
    (("frame", "brocade"), 100.0, "NORMAL", 255),
    (("seam", "fold"), 95.0, "MULTIPLY", 190),
    (("seal", "stamp"), 90.0, "NORMAL", 255),
    (("callig", "text", "inscript"), 85.0, "NORMAL", 255),
    (("fauna", "geese", "bird"), 75.0, "NORMAL", 255),
    (("fig", "person", "scholar"), 70.0, "NORMAL", 255),
    (("pavilion", "arch", "house"), 60.0, "NORMAL", 255),
    (("tree", "branch"), 50.0, "NORMAL", 255),
    (("distant",), 35.0, "NORMAL", 255),
    (("cliff", "rock", "mountain"), 40.0, "NORMAL", 255),
    (("shore", "spit"), 30.0, "NORMAL", 255),
    (("water", "ripple"), 20.0, "NORMAL", 255),
    (("gold", "base", "bg", "canvas"), 0.0, "NORMAL", 255),
)
# Progress stages and the words that announce them, in order.
STAGES = (
    ("初始化|引擎.*启动|seed", "初始化引擎"),
    ("CUDA|探活|加载完成|GroundingDINO", "加载模型"),
    ("分割|DINORadar|语义类", "神经分割"),
    ("超分|RealESRGAN|渐进", "超分重建"),
    ("补全|LaMa|遮挡", "遮挡补全"),
    ("ICC|分色|黑版|TAC|陷印|trapping", "制版分色"),
    (r"写盘|PSDCompiler|写盘完成|\.psb", "写盘输出"),
    ("manifest|掩码|完成|RK-16", "收尾校验"),
)
# Expected seconds per preset.
PRESET_SECONDS = {"japanese_screen_gold": 250, "textile_damask": 80, "textile_damask_photo": 150,
                  "chinese_ink_landscape_ai": 230, "western_oil_painting": 220, "traditional_chinese_ink": 230}
# Material family -> preset.
FAMILY_PRESET = {"金地屏风": "japanese_screen_gold", "绢本工笔": "chinese_ink_landscape_ai",
                 "宣纸水墨": "chinese_ink_landscape_ai", "油画布": "western_oil_painting",
                 "织物壁布": "textile_damask_photo"}
TEXTILE_FAMILIES = ("绢本工笔", "织物壁布")
# Accepted upload extensions and size.
UPLOAD_EXTENSIONS = (".jpg", ".jpeg", ".png", ".psd", ".psb")
UPLOAD_MAX_BYTES = 100 * 1024 * 1024


def has_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(text, F.lit(w))
    return hit


def first_match(text: Column, groups, default: Column) -> Column:
    """Value of the first (words, value) group with a word inside ``text``."""
    out = default
    for words, value in reversed(groups):
        out = F.when(has_any(text, words), F.lit(value)).otherwise(out)
    return out


def area_budget(name: Column) -> Column:
    """Largest share of the canvas a layer may fill; single instances get three times as much."""
    base = F.regexp_replace(name, r"_\d{2}$", "")
    budget = first_match(F.lower(base), AREA_BUDGETS, F.lit(DEFAULT_AREA_BUDGET))
    return F.when(base != name, budget * INSTANCE_BUDGET_FACTOR).otherwise(budget)


def bbox_exempt(name: Column) -> Column:
    return has_any(F.lower(name), BBOX_EXEMPT)


def quality_reason(name: Column, pixels: Column, canvas: Column, rule_pixels: Column, inter: Column) -> Column:
    """NULL when a mask may replace the rule mask, else empty / over_budget / drifted."""
    union = pixels + rule_pixels - inter
    iou = F.when(union > 0, inter / union).otherwise(F.lit(0.0))
    drift = (rule_pixels > 0) & (pixels / rule_pixels > MAX_EXPANSION_FACTOR) & (iou < MIN_SHAPE_IOU)
    return F.when(F.coalesce(pixels, F.lit(0)) == 0, "empty").when(pixels / canvas > area_budget(name), "over_budget") \
        .when(F.coalesce(drift, F.lit(False)), "drifted")


def diffuse_reason(name: Column, bbox_ratio: Column) -> Column:
    return F.when(~bbox_exempt(name) & (bbox_ratio > MAX_BBOX_AREA_RATIO), "diffuse")


def mask_verdicts(name: Column, fill: Column, bbox_cover: Column, iou: Column) -> Column:
    """Diagnostic flags of a mask; region-like layers are judged for emptiness and drift only."""
    region = has_any(F.lower(name), REGION_LAYERS)
    flags = F.array_compact(F.array(
        F.when(fill < 0.00001, "EMPTY").when(~region & (fill > 0.15), "OVERFLOW"),
        F.when(~region & (bbox_cover > 0.60), "BBOX_TOO_LARGE"),
        F.when(iou < 0.10, "SEMANTIC_DRIFT")))
    return F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, ","))


def baseline_verdicts(name: Column, pixels: Column, base_pixels: Column, fill: Column, cover: Column, iou: Column, *,
                      max_factor: float = 10.0, min_iou: float = 0.10) -> Column:
    """Delivered layer against its baseline mask: IMBALANCE for elements, DRIFT (a warning) for regions."""
    region = has_any(F.lower(name), REGION_LAYERS)
    factor = F.when((base_pixels > 0) & (pixels > 0), pixels / base_pixels)
    off = (iou < min_iou) & ((factor > max_factor) | (factor < 1.0 / max_factor))
    flags = F.array_compact(F.array(
        F.when(fill < 0.00001, "EMPTY"), F.when(~region & (fill > 0.15), "OVERFLOW"),
        F.when(~region & (cover > 0.60), "BBOX_TOO_LARGE"),
        F.when(off & region, "DRIFT").when(off, "IMBALANCE")))
    return F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, ","))


def candidate_boxes(boxes: DataFrame, regions: list[tuple[float, float, float, float]], *, by: list[str],
                    max_boxes: int, max_area: float = MAX_BOX_AREA_RATIO) -> DataFrame:
    """Boxes whose centre lies in a region and that are not too large, biggest first, at most ``max_boxes``."""
    from pyspark.sql import Window

    inside = F.lit(not regions)
    for x0, y0, x1, y1 in regions:
        inside |= F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)
    kept = boxes.where(inside & (F.col("w") * F.col("h") <= max_area))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("w") * F.col("h")), "seq")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_boxes)


def layer_attributes(name: Column, rules: list[dict]) -> dict[str, Column]:
    """Attributes of a layer from keyword rules; a later matching rule overwrites."""
    low = F.lower(name)
    out = {}
    for key in ("fixed_color", "blend_mode", "opacity"):
        col = F.lit(None)
        for rule in rules:
            if key in rule:
                col = F.when(has_any(low, [w.lower() for w in rule["match"]]), F.lit(rule[key])).otherwise(col)
        out[key] = col
    return out


def display_name(name: Column, mapping: dict[str, str]) -> Column:
    """Display name by lower-cased key; unmapped names stay as they are."""
    if not mapping:
        return name
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(table[F.lower(F.trim(name))], name)


def stage_of(line: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, stage in reversed(STAGES):
        out = F.when(line.rlike(f"(?i){pattern}"), stage).otherwise(out)
    return out


def upload_accepted(path: Column, length: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*UPLOAD_EXTENSIONS) & (length <= UPLOAD_MAX_BYTES)


def recommend_preset(family: Column, family_conf: Column, has_panel: Column, width: Column, height: Column,
                     min_conf: float = 0.6) -> dict[str, Column]:
    """Preset by material family, textiles with a panel by photo preset, else by aspect ratio.

    A guess is never shown with more than 0.55.
    """
    table = F.create_map(*[F.lit(x) for kv in FAMILY_PRESET.items() for x in kv])
    known = F.coalesce(table[family].isNotNull() & (family_conf >= min_conf), F.lit(False))
    panel = known & family.isin(*TEXTILE_FAMILIES) & F.coalesce(has_panel, F.lit(False))
    ratio = F.when(height > 0, width / height).otherwise(F.lit(1.0))
    no_dims = width.isNull() | height.isNull()
    wide, square = ratio.between(1.6, 2.4) & ~no_dims, ratio.between(0.85, 1.18) & ~no_dims
    guess = F.when(square, "textile_damask").otherwise("japanese_screen_gold")
    guess_conf = F.when(no_dims, 0.5).when(wide, 0.78).when(square, 0.72).otherwise(0.55)
    return {
        "preset": F.when(panel, "textile_damask_photo").when(known, table[family]).otherwise(guess),
        "confidence": F.when(panel, F.lit(0.85)).when(known, F.round(family_conf, 2)).otherwise(F.least(guess_conf, F.lit(0.55))),
        "matched": known,
        "reason": F.when(panel, "panel").when(known, "material").when(family.isNotNull(), "material_low_conf")
                   .when(no_dims, "no_dimensions").otherwise("aspect"),
    }


def get_param(value: Column, default, low=None, high=None) -> Column:
    out = F.coalesce(value, F.lit(default))
    if low is not None:
        out = F.greatest(F.lit(low), out)
    if high is not None:
        out = F.least(F.lit(high), out)
    return out


def trap_width_px(trap_mm: Column, ppi: Column) -> Column:
    """Millimetres to whole pixels, half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(trap_mm / 25.4 * ppi, 0).cast("int"))


def canonical_order_key(name: Column) -> list[Column]:
    """Sort keys: leading number (99 without one), its letter, the name."""
    num = F.regexp_extract(name, r"^(\d+)([A-Za-z]?)", 1)
    return [F.when(num != "", num.cast("int")).otherwise(F.lit(99)),
            F.upper(F.regexp_extract(name, r"^(\d+)([A-Za-z]?)", 2)), name]


# ---- material families -----------------------------------------------------

def _steps(*arms, otherwise=0.0) -> Column:
    out = F.lit(otherwise)
    for cond, value in reversed(arms):
        out = F.when(cond, F.lit(float(value))).otherwise(out)
    return out


def _open(c: Column, lo: float, hi: float) -> Column:
    return (c > lo) & (c < hi)


# Fixed values throughout the scoring tables below: thresholds and points per family.
def family_scores(L: Column, a: Column, b: Column, sat: Column, edge: Column, glcm: Column, entropy: Column) -> dict[str, Column]:
    """Additive rule score per material family from the centre of the picture."""
    warm = b.between(14, 24) & (sat >= 14)
    gold = _steps((b > 30, 0.40), (b > 20, 0.25), (b > 10, 0.10)) + _steps((L >= 75, 0.30), (L > 65, 0.15)) \
        + _steps((F.abs(a) < 15, 0.15)) + _steps((_open(sat, 20, 55), 0.15)) + _steps((_open(edge, 0.03, 0.10), 0.05))
    paper = _steps((L > 82, 0.30), (L > 60, 0.20)) + _steps((b < 12, 0.30), (b < 20, 0.20)) \
        + _steps((edge < 0.10, 0.25), (edge < 0.16, 0.15)) + _steps((glcm < 0.22, 0.15), (glcm < 0.28, 0.10)) \
        + _steps((warm & (glcm >= 0.34) & (edge >= 0.08), -0.20))
    dense = edge >= 0.16
    silk = _steps(((b >= 10) & (b < 30), 0.20), ((b >= 6) & (b < 36), 0.10)) \
        + _steps((_open(L, 65, 88), 0.20), (_open(L, 58, 92), 0.10)) + _steps((dense, 0.30), (edge >= 0.12, 0.05)) \
        + _steps((dense & (glcm >= 0.28), 0.30), (dense & (glcm >= 0.22), 0.05)) \
        + _steps((warm & (glcm >= 0.34), 0.35), (warm & (glcm >= 0.30) & (edge >= 0.08), 0.15))
    oil = _steps((sat > 30, 0.4), (sat > 20, 0.2)) + _steps((edge > 0.08, 0.3), (edge > 0.05, 0.15)) + _steps((_open(L, 30, 80), 0.2))
    points = _steps((sat < 8, 0.40), (sat < 12, 0.25), otherwise=0.05) + _steps((b < 8, 0.35), (b < 12, 0.20), otherwise=0.05) \
        + _steps((edge >= 0.12, 0.20), (edge >= 0.08, 0.10)) + _steps((F.abs(a) < 6, 0.10))
    closed = ~((sat < 15) & (b < 15)) | F.coalesce(entropy < 2.0, F.lit(False))
    return {"金地屏风": gold, "宣纸水墨": F.greatest(F.lit(0.0), paper), "绢本工笔": silk, "油画布": oil,
            "织物壁布": F.when(closed, F.lit(0.0)).otherwise(points), "其他": F.lit(0.3)}


def classify_family(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Family of the highest score, the earlier one on ties, with the score in 0..1."""
    # the sums are binary fractions, so ties are decided on rounded points
    ranked = F.array(*[F.struct((-F.round(s, 6)).alias("s"), F.lit(i).alias("i"), F.lit(n).alias("n"))
                       for i, (n, s) in enumerate(scores.items())])
    best = F.array_min(ranked)
    return best["n"], F.greatest(F.lit(0.0), F.least(F.lit(1.0), -best["s"]))


def histogram_entropy(hist: Column) -> Column:
    total = F.aggregate(hist, F.lit(0.0), lambda acc, v: acc + v) + 1e-9
    return F.aggregate(hist, F.lit(0.0), lambda acc, v: acc - (v / total) * F.ln(v / total + 1e-12))


def explain_family(family: Column, L: Column, b: Column, sat: Column, edge: Column) -> Column:
    """Which of a family's textbook traits hold; these thresholds differ from the scoring ones."""
    mark = lambda text, cond: F.concat(F.lit(text), F.when(cond, "✓").otherwise("✗"))
    join = lambda *parts: F.concat_ws("; ", *parts)
    # Trait texts and thresholds.
    return F.when(family == "金地屏风", join(mark("L* > 80 ", L > 80), mark("b* > 20 ", b > 20), mark("15 < sat < 40 ", _open(sat, 15, 40)))) \
        .when(family == "宣纸水墨", join(mark("L* > 90 ", L > 90), mark("sat < 10 ", sat < 10), mark("edge < 0.03 ", edge < 0.03))) \
        .when(family == "绢本工笔", join(mark("70 < L* < 85 ", _open(L, 70, 85)), mark("10 < sat < 25 ", _open(sat, 10, 25)), mark("0.05 < edge < 0.12 ", _open(edge, 0.05, 0.12)))) \
        .when(family == "油画布", join(mark("sat > 30 ", sat > 30), mark("edge > 0.08 ", edge > 0.08))) \
        .when(family == "织物壁布", join(mark("sat < 12 ", sat < 12), mark("b* < 12 ", b < 12), mark("edge >= 0.08 ", edge >= 0.08))) \
        .otherwise("no family matched")
