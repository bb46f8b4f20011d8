"""The starting lexicon and its tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import VERSION_SCHEMA
from . import lexicon_store

# Families in column order of the affinity table below.
FAMILIES = ("金地屏风", "宣纸水墨", "绢本工笔", "油画布", "其他")
# Id, Chinese name, English name, template, confidence, affinity per family.
CATEGORIES = (
    ("distant_mountains", "远山", "Distant_Mountains", "NN_远山_Distant_Mountains", 0.85, (0.6, 0.95, 0.75, 0.50, 0.60)),
    ("mountains_cliffs", "山石崖壁", "Mountains_Cliffs", "NN_山石崖壁_Mountains_Cliffs", 0.88, (0.65, 0.92, 0.88, 0.70, 0.65)),
    ("trees_vegetation", "树木植被", "Trees_Vegetation", "NN_树木植被_Trees_Vegetation", 0.90, (0.80, 0.90, 0.85, 0.75, 0.75)),
    ("water_ripples", "水波纹", "Water_Ripples", "NN_水波_Water_Ripples", 0.80, (0.55, 0.88, 0.72, 0.60, 0.60)),
    ("architecture", "建筑亭台", "Architecture_Pavilion", "NN_建筑亭台_Architecture_Pavilion", 0.82, (0.92, 0.70, 0.88, 0.85, 0.75)),
    ("figures_scholar", "文人高士", "Figures_Scholar", "NN_文人高士_Figures_Scholar", 0.78, (0.75, 0.82, 0.95, 0.65, 0.70)),
    ("fauna_birds", "鸟禽", "Fauna_Birds", "NN_鸟禽_Fauna_Birds", 0.83, (0.95, 0.75, 0.88, 0.60, 0.70)),
    ("fauna_geese", "雁", "Fauna_Geese", "NN_雁_Fauna_Geese", 0.75, (0.92, 0.78, 0.85, 0.55, 0.68)),
    ("calligraphy", "题跋书法", "Calligraphy_Inscription", "NN_题跋书法_Calligraphy", 0.92, (0.88, 0.95, 0.92, 0.70, 0.80)),
    ("seal", "印章", "Cinnabar_Seal", "NN_印章_Cinnabar_Seal", 0.95, (0.90, 0.98, 0.95, 0.65, 0.82)),
    ("brocade_frame", "织锦边框", "Brocade_Outer_Frame", "NN_织锦边框_Brocade_Outer_Frame", 0.70, (0.98, 0.40, 0.55, 0.45, 0.85)),
    ("panel_folds", "屏风折痕", "Panel_Fold_Seams", "NN_屏风折痕_Panel_Fold_Seams", 0.65, (0.95, 0.30, 0.40, 0.25, 0.50)),
    ("clouds_mist", "云雾", "Clouds_Mist", "NN_云雾_Clouds_Mist", 0.72, (0.60, 0.90, 0.78, 0.70, 0.65)),
    ("boats_ships", "舟船", "Boats_Ships", "NN_舟船_Boats_Ships", 0.68, (0.70, 0.82, 0.80, 0.65, 0.68)),
    ("figures_fisherman", "渔人", "Figures_Fisherman", "NN_渔人_Figures_Fisherman", 0.70, (0.65, 0.88, 0.82, 0.60, 0.68)),
    ("stone_steps", "石阶", "Stone_Steps", "NN_石阶_Stone_Steps", 0.65, (0.68, 0.75, 0.78, 0.72, 0.70)),
    ("waterfalls", "瀑布", "Waterfalls", "NN_瀑布_Waterfalls", 0.74, (0.60, 0.92, 0.80, 0.68, 0.70)),
    ("bamboo", "竹", "Bamboo", "NN_竹_Bamboo", 0.76, (0.75, 0.95, 0.88, 0.60, 0.72)),
    ("plum_blossom", "梅花", "Plum_Blossom", "NN_梅花_Plum_Blossom", 0.73, (0.85, 0.90, 0.92, 0.58, 0.70)),
    ("repair_marks", "修复痕迹", "Repair_Marks", "NN_修复痕迹_Repair_Marks", 0.88, (0.85, 0.88, 0.90, 0.82, 0.85)),
)
# Prompts as category: language prompt weight.
PROMPTS = (
    ("distant_mountains", "zh", "远山", 1.0), ("distant_mountains", "en", "distant mountains", 0.9),
    ("mountains_cliffs", "zh", "山石", 1.2), ("mountains_cliffs", "zh", "崖壁", 1.0), ("mountains_cliffs", "en", "cliffs", 0.95),
    ("trees_vegetation", "zh", "树木", 1.1), ("trees_vegetation", "zh", "植被", 0.95), ("trees_vegetation", "en", "trees", 1.0),
    ("water_ripples", "zh", "水波", 1.0), ("water_ripples", "zh", "涟漪", 0.85),
    ("architecture", "zh", "建筑", 1.1), ("architecture", "zh", "亭台", 1.0), ("architecture", "en", "pavilion", 0.95),
    ("figures_scholar", "zh", "文人", 1.0), ("figures_scholar", "zh", "高士", 0.95), ("figures_scholar", "en", "scholar", 0.9),
    ("fauna_birds", "zh", "鸟", 1.2), ("fauna_birds", "zh", "禽", 0.9), ("fauna_geese", "zh", "雁", 1.1), ("fauna_geese", "en", "geese", 1.0),
    ("calligraphy", "zh", "题跋", 1.3), ("calligraphy", "zh", "书法", 1.1), ("calligraphy", "en", "calligraphy", 1.0),
    ("seal", "zh", "印章", 1.5), ("seal", "zh", "朱砂", 1.2), ("seal", "en", "seal", 1.3),
    ("brocade_frame", "zh", "织锦边框", 1.0), ("brocade_frame", "en", "brocade", 0.95),
    ("panel_folds", "zh", "折痕", 1.0), ("panel_folds", "zh", "屏风缝", 0.85), ("clouds_mist", "zh", "云", 1.0), ("clouds_mist", "zh", "雾", 0.95),
    ("boats_ships", "zh", "舟", 1.0), ("boats_ships", "zh", "船", 1.0), ("figures_fisherman", "zh", "渔人", 1.1), ("figures_fisherman", "en", "fisherman", 0.95),
    ("stone_steps", "zh", "石阶", 1.0), ("stone_steps", "en", "stone steps", 0.9), ("waterfalls", "zh", "瀑布", 1.2), ("waterfalls", "en", "waterfall", 1.0),
    ("bamboo", "zh", "竹", 1.1), ("bamboo", "en", "bamboo", 1.0), ("plum_blossom", "zh", "梅花", 1.1), ("plum_blossom", "en", "plum blossom", 1.0),
    ("repair_marks", "zh", "修复痕迹", 1.4), ("repair_marks", "zh", "破损", 1.2), ("repair_marks", "en", "repair", 1.1),
)
# Aliases as category, preset name, priority.
ALIASES = (
    ("distant_mountains", "远山_Distant_Mountains", 100), ("mountains_cliffs", "山石崖壁_Mountains_Cliffs", 100),
    ("trees_vegetation", "树木植被_Trees_Vegetation", 100), ("water_ripples", "水波纹_Water_Ripples", 100),
    ("architecture", "建筑亭台_Architecture_Pavilion", 100), ("figures_scholar", "文人高士侍童_Figures_Attendants", 100),
    ("figures_scholar", "文人高士_Figures_Scholar", 110), ("fauna_birds", "鸟禽_Fauna_Birds", 100), ("fauna_geese", "雁_Fauna_Geese", 100),
    ("fauna_geese", "芦雁群禽_Geese_Flock", 110), ("calligraphy", "题跋书法_Calligraphy_Inscription", 100),
    ("calligraphy", "题跋书法_Calligraphy", 110), ("seal", "印章_Cinnabar_Seal", 100), ("brocade_frame", "织锦边框_Brocade_Outer_Frame", 100),
    ("panel_folds", "屏风折痕折缝_Panel_Fold_Seams", 100), ("panel_folds", "屏风折痕_Panel_Fold_Seams", 110), ("clouds_mist", "云雾_Clouds_Mist", 100),
    ("boats_ships", "舟船_Boats_Ships", 100), ("figures_fisherman", "渔人_Figures_Fisherman", 100), ("stone_steps", "石阶_Stone_Steps", 100),
    ("waterfalls", "瀑布_Waterfalls", 100), ("bamboo", "竹_Bamboo", 100), ("plum_blossom", "梅花_Plum_Blossom", 100),
    ("repair_marks", "修复痕迹_Repair_Marks", 100),
)
ROOT = "landscape_painting"
# Upper tree nodes as id, Chinese name, English name, parent, confidence.
TREE_NODES = (
    ("landscape_painting", "山水画", "Landscape_Painting", None, 1.0), ("mountains", "山", "Mountains", ROOT, 0.95),
    ("water", "水", "Water", ROOT, 0.95), ("vegetation", "植被", "Vegetation", ROOT, 0.95),
    ("architecture", "建筑", "Architecture", ROOT, 0.95), ("celestial", "天象与云雾", "Celestial_And_Mist", ROOT, 0.95),
    ("figures_animals", "人物与动物", "Figures_And_Animals", ROOT, 0.95), ("base_borders", "底板与边框", "Base_And_Borders", ROOT, 0.95),
)
# Leaf -> parent; ids that are not in the lexicon are passed over.
LEAF_PARENTS = (
    ("distant_mountains", "mountains"), ("mountains_cliffs", "mountains"), ("peaks_ridges", "mountains"),
    ("water_ripples", "water"), ("rivers_streams", "water"), ("waterfalls", "water"),
    ("trees_vegetation", "vegetation"), ("grass_ground", "vegetation"), ("bamboo_plants", "vegetation"),
    ("architecture", "architecture"), ("bridges", "architecture"), ("boats_vessels", "architecture"),
    ("clouds_mist", "celestial"), ("sky_celestial", "celestial"), ("figures_people", "figures_animals"),
    ("animals_birds", "figures_animals"), ("decorative_borders", "base_borders"), ("base_ground", "base_borders"),
)


PRIOR_SCHEMA = "category_id string, area_budget_min double, area_budget_max double, elongation_mean double, elongation_std double, " \
               "compactness_mean double, compactness_std double, n_components_mode int, n_samples int, updated_at long"
NEGATIVE_SCHEMA = "id long, category_id string, prompt string, context_fingerprint array<float>, reject_reason string, created_at long"


def insert_missing(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows plus those new ones whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)


def attach_tree(categories: DataFrame, leaf_parents: DataFrame, root: str = ROOT) -> DataFrame:
    """Hang leaves under their parents; self-loops, new or old, go under the root."""
    have = categories.select(F.col("id").alias("parent_new"), F.col("path").alias("_pp"))
    links = leaf_parents.where("id <> parent_new").join(have, "parent_new")
    j = categories.join(links, "id", "left")
    loop = F.col("parent_id") == F.col("id")
    parent = F.coalesce("parent_new", F.when(loop, F.lit(root)).otherwise(F.col("parent_id")))
    path = F.when(F.col("parent_new").isNotNull(), F.concat("_pp", "id", F.lit("/"))) \
        .when(loop, F.concat(F.lit(f"/{root}/"), "id", F.lit("/"))).otherwise(F.col("path"))
    return j.withColumns({"parent_id": parent, "path": path}).drop("parent_new", "_pp")


def build(spark: SparkSession, now: int) -> dict[str, DataFrame]:
    """All lexicon tables of a fresh start."""
    cats = spark.createDataFrame([(i, zh, en, None, "/", t, c, now, now, None) for i, zh, en, t, c, _ in CATEGORIES],
                                 "id string, name_zh string, name_en string, parent_id string, path string, name_template string, "
                                 "confidence double, created_at long, updated_at long, deleted_at long")
    nodes = spark.createDataFrame([(i, zh, en, p, "/" if p is None else f"/{p}/", f"{zh}_{en}", c, now, now, None)
                                   for i, zh, en, p, c in TREE_NODES], cats.schema)
    leaves = spark.createDataFrame(LEAF_PARENTS, "id string, parent_new string")
    aff = spark.createDataFrame([(i, f, float(a)) for i, *_x, row in CATEGORIES for f, a in zip(FAMILIES, row)],
                                "category_id string, material_family string, affinity double")
    prompts = spark.createDataFrame([(n + 1, c, p, w, lang, "seed", 0, 0, 0, 0, None, now) for n, (c, lang, p, w) in enumerate(PROMPTS)],
                                    "id long, category_id string, prompt string, weight double, lang string, source string, n_hits int, "
                                    "n_accept int, n_reject int, n_images int, last_hit_at long, created_at long")
    aliases = spark.createDataFrame([(c, p, k) for c, p, k in ALIASES], "category_id string, preset_name string, priority int")
    # The row of the first version.
    versions = spark.createDataFrame([("v0-seed", None, '{"categories": 20, "prompts": 50, "affinity": 100, "source": "human_curated"}',
                                       "初始化：20 类目 + 50 提示词 + 100 材质亲和度", "人工校准种子数据", "passed", now, now)], VERSION_SCHEMA)
    return {"categories": attach_tree(insert_missing(cats, nodes), leaves), "affinity": aff, "prompts": prompts, "aliases": aliases,
            "priors": spark.createDataFrame([], PRIOR_SCHEMA), "negative_samples": spark.createDataFrame([], NEGATIVE_SCHEMA), "versions": versions}


def publish(spark: SparkSession, path: str, now: int) -> None:
    """Store a fresh lexicon as its first, active version."""
    tables = build(spark, now)
    first = tables.pop("versions").first()
    lexicon_store.create_version(spark, path, first["version_id"], tables, now, changeset=first["changeset"], evidence=first["evidence"],
                                 status=first["regression_status"], activate=True)


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in (*lexicon_store.TABLES, "versions")}
