"""Registered queries over the lexicon tables."""

from pyspark.sql import functions as F

from ..operators import lexicon as lx
from ..operators.episodes import category_priors
from .registry import query


@query("serving_prompts_p1", """
SELECT category_id, prompt, weight, lang, source FROM prompts WHERE source <> 'shadow' AND weight >= 0.3""",
       ("prompts",))
def _(v):
    return lx.serving_prompts(v.prompts).select("category_id", "prompt", "weight", "lang", "source")


@query("ranked_prompts_j2", """
SELECT p.category_id, p.prompt, p.weight, c.name_en, c.confidence AS category_confidence
FROM (SELECT 's' || CAST(substr(prompt, 2) AS INT) AS category_id, prompt, weight, source FROM prompts) p
JOIN categories c ON p.category_id = c.id WHERE p.source <> 'shadow' AND p.weight >= 0.3""", ("prompts", "categories"))
def _(v):
    p = v.prompts.withColumn("category_id", F.concat(F.lit("s"), F.expr("substring(prompt, 2)").cast("int")))
    return lx.ranked_prompts(p, v.categories).select("category_id", "prompt", "weight", "name_en", "category_confidence")


@query("categories_by_material_j1", """
SELECT * FROM (SELECT a.material_family, c.id AS category_id, a.affinity, c.confidence,
  CAST(row_number() OVER (PARTITION BY a.material_family ORDER BY a.affinity DESC, c.confidence DESC, c.id) AS INT) AS rank
 FROM affinity a JOIN categories c ON c.id = 's' || a.category_id
 WHERE a.affinity >= 0.3 AND c.deleted_at IS NULL) WHERE rank <= 20""", ("affinity", "categories"))
def _(v):
    aff = v.affinity.withColumn("category_id", F.concat(F.lit("s"), "category_id"))
    return lx.categories_by_material(aff, v.categories, limit=20).select(
        "material_family", "category_id", "affinity", "confidence", "rank")


@query("categories_by_material_with_deleted_j1", """
SELECT * FROM (SELECT a.material_family, c.id AS category_id, a.affinity,
  CAST(row_number() OVER (PARTITION BY a.material_family ORDER BY a.affinity DESC, c.confidence DESC, c.id) AS INT) AS rank
 FROM affinity a JOIN categories c ON c.id = 's' || a.category_id WHERE a.affinity >= 0.3) WHERE rank <= 20""",
       ("affinity", "categories"))
def _(v):
    aff = v.affinity.withColumn("category_id", F.concat(F.lit("s"), "category_id"))
    return lx.categories_by_material(aff, v.categories, limit=20, live_only=False).select(
        "material_family", "category_id", "affinity", "rank")


@query("category_aliases_j3", """
SELECT c.id, c.name_template, string_agg(a.preset_name, '|' ORDER BY a.preset_name) AS preset_aliases,
  min_by(a.preset_name, (a.priority, a.preset_name)) AS primary_preset_name
FROM categories c LEFT JOIN aliases a ON a.category_id = c.id GROUP BY c.id, c.name_template""", ("categories", "aliases"))
def _(v):
    return lx.categories_with_aliases(v.categories, v.aliases).select(
        "id", "name_template", "preset_aliases", "primary_preset_name")


@query("categories_without_prompts_j4", """
SELECT id FROM categories c WHERE NOT EXISTS (SELECT 1 FROM prompts p WHERE 's' || substr(p.prompt, 2) = c.id)""",
       ("prompts", "categories"))
def _(v):
    p = v.prompts.select(F.concat(F.lit("s"), F.expr("substr(prompt, 2)")).alias("category_id"))
    return lx.categories_without_prompts(v.categories, p).select("id")


@query("category_info_j5", """
SELECT c.id AS category_id, c.name_template, coalesce(len(list(p.prompt) FILTER (p.prompt IS NOT NULL)), 0) AS n_prompts,
  min_by(p.prompt, (-p.weight, p.prompt)) AS first_prompt, any_value(a.affinity) IS NOT NULL AS has_family,
  coalesce(any_value(a.affinity), 0.5) AS affinity
FROM categories c LEFT JOIN (SELECT * FROM prompts WHERE weight >= 0.3) p ON 's' || substr(p.prompt, 2) = c.id
LEFT JOIN affinity a ON 's' || a.category_id = c.id GROUP BY c.id, c.name_template""",
       ("categories", "prompts", "affinity"))
def _(v):
    p = v.prompts.withColumn("category_id", F.concat(F.lit("s"), F.expr("substr(prompt, 2)")))
    aff = v.affinity.withColumn("category_id", F.concat(F.lit("s"), "category_id"))
    no_priors = v.categories.select(F.col("id").alias("category_id"), F.lit(0.0).alias("area_budget_min"),
                                    F.lit(1.0).alias("area_budget_max"))
    return lx.category_info(v.categories, p, no_priors, aff).select(
        "category_id", "name_template", F.coalesce(F.size("prompts"), F.lit(0)).cast("long").alias("n_prompts"),
        F.col("prompts")[0]["text"].alias("first_prompt"), F.col("material_family").isNotNull().alias("has_family"), "affinity")


_RESOLVE_SQL = r"""
WITH names AS (SELECT DISTINCT name, regexp_replace(name, '^\d+[A-Da-d]?_', '') AS base FROM layer_names),
keys AS (SELECT name, 0 AS p, name AS k FROM names UNION ALL SELECT name, 1, base FROM names),
toks AS (SELECT DISTINCT name, unnest(regexp_split_to_array(base, '[_\s]+')) AS t FROM names),
vocab AS (SELECT DISTINCT id, t, src FROM (SELECT id, unnest(regexp_split_to_array(name_en, '[_\s]+')) AS t, 1 AS src FROM categories
  UNION ALL SELECT id, name_zh, 0 FROM categories)),
cand AS (
 SELECT k.name, 0 AS tier, p, 0 AS score, a.category_id AS cid FROM keys k JOIN aliases a ON a.preset_name = k.k
 UNION ALL SELECT k.name, 1, p, 0, c.id FROM keys k JOIN categories c ON k.k IN (c.name_zh, c.name_en, c.name_template)
 UNION ALL SELECT name, 2, 0, CAST(count(*) AS INT), id FROM toks JOIN vocab USING (t) WHERE t <> '' GROUP BY name, id),
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tier, p, score DESC, cid) AS rn FROM cand)
SELECT l.name, b.cid AS category_id, b.tier FROM layer_names l LEFT JOIN best b ON b.name = l.name AND b.rn = 1"""


@query("resolve_category_names_j6", _RESOLVE_SQL, ("layer_names", "categories", "aliases"))
def _(v):
    return lx.resolve_category_ids(v.layer_names, v.categories, v.aliases)


# one word in every name and every category: all pairs would share it
_COMMON_SQL = "WITH ln AS (SELECT name || '_shared' AS name FROM layer_names), ct AS (SELECT id, name_zh, name_en || '_shared' AS name_en, name_template FROM categories), " \
    + _RESOLVE_SQL.strip()[len("WITH "):].replace("FROM layer_names", "FROM ln").replace("categories", "ct")


@query("resolve_common_words_j6", _COMMON_SQL, ("layer_names", "categories", "aliases"))
def _(v):
    names = v.layer_names.select(F.concat("name", F.lit("_shared")).alias("name"))
    return lx.resolve_category_ids(names, v.categories.withColumn("name_en", F.concat("name_en", F.lit("_shared"))), v.aliases)


@query("learned_weights_j14", """
SELECT d.episode_id, d.seq, d.category_id, d.prompt, w.old_weight, w.old_weight IS NULL AS unknown
FROM detections d LEFT JOIN (SELECT category_id, prompt, max(weight) AS old_weight FROM prompts WHERE source <> 'shadow'
  GROUP BY 1, 2) w USING (category_id, prompt)""", ("detections", "prompts"))
def _(v):
    return lx.learned_weight(v.detections.select("episode_id", "seq", "category_id", "prompt"), v.prompts) \
        .withColumn("unknown", F.col("old_weight").isNull())


@query("best_learned_prompt_m26", """
SELECT category_id, min_by(prompt, (-weight, prompt)) AS prompt, max(weight) AS weight FROM prompts
WHERE lang = 'en' AND (n_accept > 0 OR n_reject > 0) GROUP BY category_id""", ("prompts",))
def _(v):
    return lx.best_learned_prompt(v.prompts)


@query("top_prompts_k4", """
SELECT category_id, prompt, weight, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category_id
  ORDER BY weight DESC, prompt) AS INT) AS rank FROM prompts) WHERE rank <= 5""", ("prompts",))
def _(v):
    return lx.top_prompts(v.prompts).select("category_id", "prompt", "weight", "rank")


@query("core_categories_first_k6", """
SELECT material_family, array_to_string(list_concat(['repair_marks', 'calligraphy', 'seal'], list(category_id ORDER BY rank)), ',') AS ids
FROM (SELECT a.material_family, 's' || a.category_id AS category_id, row_number() OVER (PARTITION BY a.material_family
  ORDER BY a.affinity DESC, c.confidence DESC, c.id) AS rank FROM affinity a JOIN categories c ON c.id = 's' || a.category_id
  WHERE a.affinity >= 0.3 AND c.deleted_at IS NULL) WHERE rank <= 50 GROUP BY 1""", ("affinity", "categories"))
def _(v):
    aff = v.affinity.withColumn("category_id", F.concat(F.lit("s"), "category_id"))
    best = lx.categories_by_material(aff, v.categories, limit=50)
    ids = best.groupBy("material_family").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category_id"))),
                                                          lambda s: s["category_id"]).alias("ids"))
    return ids.select("material_family", F.array_join(lx.with_core_first(F.col("ids")), ",").alias("ids"))


@query("hybrid_category_ids_u6", """
SELECT n_name AS material_family, array_to_string(list_concat(['s1', 's2'], coalesce(a.auto, [])), ',') AS ids FROM nation LEFT JOIN
 (SELECT material_family, list(category_id ORDER BY rank) FILTER (category_id NOT IN ('s1', 's2')) AS auto FROM
  (SELECT a.material_family, 's' || a.category_id AS category_id, row_number() OVER (PARTITION BY a.material_family
   ORDER BY a.affinity DESC, c.confidence DESC, c.id) AS rank FROM affinity a JOIN categories c ON c.id = 's' || a.category_id
   WHERE a.affinity >= 0.3 AND c.deleted_at IS NULL) WHERE rank <= 20 GROUP BY 1) a ON a.material_family = n_name""",
       ("affinity", "categories"))
def _(v):
    aff = v.affinity.withColumn("category_id", F.concat(F.lit("s"), "category_id"))
    best = lx.categories_by_material(aff, v.categories, limit=20)
    auto = best.groupBy("material_family").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "category_id"))),
                                                           lambda s: s["category_id"]).alias("auto"))
    fams = v.nation.select(F.col("n_name").alias("material_family")).join(auto, "material_family", "left")
    preset = F.array(F.lit("s1"), F.lit("s2"))
    return fams.select("material_family", F.array_join(
        lx.hybrid_ids(preset, F.coalesce("auto", F.array().cast("array<string>"))), ",").alias("ids"))


@query("hybrid_supplement_j16", """
SELECT material_family, name, affinity, added FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY material_family ORDER BY rank) AS INT) AS added FROM (
  SELECT *, row_number() OVER (PARTITION BY material_family ORDER BY affinity DESC, name) AS rank FROM (
   SELECT n.n_name AS material_family, p.p_name || '_' || lower(p.p_type) AS name, max(round(p.p_size / 50e0, 4)) AS affinity
   FROM part p JOIN nation n ON n.n_nationkey = p.p_partkey % 25 GROUP BY 1, 2))
 WHERE affinity >= 0.6
  AND NOT (position(name IN 'red plate_promo') > 0 OR position('red plate_promo' IN name) > 0)
  AND NOT (position(name IN 'hot bolt_large') > 0 OR position('hot bolt_large' IN name) > 0)
  AND NOT list_has_any(list_filter(regexp_split_to_array(name, '[^a-z]+'), lambda t: length(t) >= 4), ['plate', 'promo', 'bolt', 'large'])
) WHERE added <= 3""")
def _(v):
    named = v.part.join(v.nation, v.nation.n_nationkey == v.part.p_partkey % 25).groupBy(
        F.col("n_name").alias("material_family"), F.concat("p_name", F.lit("_"), F.lower("p_type")).alias("name")) \
        .agg(F.max(F.round(F.col("p_size") / 50, 4)).alias("affinity"))
    from pyspark.sql import Window
    ranked = named.withColumn("name_zh", F.lit(None).cast("string")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("material_family").orderBy(F.desc("affinity"), "name")))
    return lx.supplement_preset(ranked, ["red plate_promo", "hot bolt_large"]).select(
        "material_family", "name", "affinity", "added")


@query("affinity_from_cooccurrence_m27", """
WITH obs AS (SELECT n_name AS material_family, l_suppkey AS category_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
share AS (SELECT material_family, category_id, count(*) / sum(count(*)) OVER (PARTITION BY material_family) AS s FROM obs GROUP BY 1, 2)
SELECT material_family, category_id, round(CASE WHEN a.affinity IS NULL THEN s WHEN s IS NULL THEN a.affinity
  ELSE 0.7 * a.affinity + 0.3 * s END, 6) AS affinity FROM affinity a FULL JOIN share USING (material_family, category_id)""",
       ("affinity",))
def _(v):
    obs = (v.lineitem.select("l_orderkey", F.col("l_suppkey").alias("category_id"))
           .join(v.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
           .join(v.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")), "o_custkey")
           .join(v.nation.select("n_nationkey", F.col("n_name").alias("material_family")), "n_nationkey"))
    return lx.affinity_from_cooccurrence(obs, v.affinity).withColumn("affinity", F.round("affinity", 6))


@query("lexicon_stats_m23", """
SELECT 'categories' AS item, CAST(count(*) AS VARCHAR) AS value FROM categories
UNION ALL SELECT 'prompts', CAST(count(*) AS VARCHAR) FROM prompts
UNION ALL SELECT 'live_prompts', CAST(count(*) AS VARCHAR) FROM prompts WHERE source <> 'shadow'
UNION ALL SELECT 'active_version', max_by(version_id, activated_at) FROM versions""", ("categories", "prompts", "versions"))
def _(v):
    return lx.lexicon_stats(v.categories, v.prompts, v.versions)


@query("lexicon_health_m24", """
SELECT 'categories' AS check, count(*) >= 20 AS passed, count(*) AS detail FROM categories
UNION ALL SELECT 'seed_prompts', count(*) >= 40, count(*) FROM prompts WHERE source = 'seed'
UNION ALL SELECT 'affinities', count(*) >= 100, count(*) FROM affinity
UNION ALL SELECT 'active_version', count(*) >= 1, count(*) FROM versions WHERE activated_at IS NOT NULL
UNION ALL SELECT 'orphan_categories', count(*) = 0, count(*) FROM categories WHERE id NOT IN (SELECT category_id FROM prompts)
UNION ALL SELECT 'core_confidence', count(*) = 0, count(*) FROM categories WHERE id IN ('s1', 's2', 's9') AND confidence < 0.85""",
       ("categories", "prompts", "affinity", "versions"))
def _(v):
    return lx.lexicon_health(v.categories, v.prompts, v.affinity, v.versions, core=("s1", "s2", "s9"))


_UP = """WITH RECURSIVE up AS (SELECT id, parent_id AS ancestor, 1 AS distance FROM categories WHERE parent_id IS NOT NULL
 UNION ALL SELECT u.id, c.parent_id, u.distance + 1 FROM up u JOIN categories c ON c.id = u.ancestor WHERE c.parent_id IS NOT NULL)"""


@query("category_ancestors_g1", _UP + " SELECT id, ancestor, distance FROM up", ("categories",))
def _(v):
    return lx.ancestors(v.categories.select("id", "parent_id"))


@query("category_paths_g1", _UP + """
SELECT c.id, CASE WHEN c.parent_id IS NULL THEN '/' ELSE '/' || coalesce((SELECT string_agg(ancestor, '/' ORDER BY distance DESC)
 FROM up u WHERE u.id = c.id AND u.distance < (SELECT max(distance) FROM up m WHERE m.id = c.id)) || '/', '') || c.id || '/' END AS path
FROM categories c""", ("categories",))
def _(v):
    return lx.materialized_paths(v.categories.select("id", "parent_id"))


@query("cyclic_category_inserts_g1", _UP + """
SELECT p.id, p.parent_id, (p.id = p.parent_id OR EXISTS (SELECT 1 FROM up u WHERE u.id = p.parent_id AND u.ancestor = p.id)) AS creates_cycle
FROM (SELECT 'n' || s_nationkey AS id, 's' || s_suppkey AS parent_id FROM supplier
 UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey % 7) FROM supplier) p""", ("categories",))
def _(v):
    s = v.supplier
    proposed = s.select(F.concat(F.lit("n"), "s_nationkey").alias("id"), F.concat(F.lit("s"), "s_suppkey").alias("parent_id")) \
        .unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"),
                              F.concat(F.lit("s"), (F.col("s_suppkey") % 7)).alias("parent_id")))
    return lx.cyclic_inserts(proposed, v.categories.select("id", "parent_id"))


_PRIOR_COLS = ["area_budget_min", "area_budget_max", "elongation_mean", "elongation_std", "compactness_mean", "compactness_std"]
_PRIOR_AGG = """round(quantile_cont(w * h, 0.1), 6) AS area_budget_min, round(quantile_cont(w * h, 0.9), 6) AS area_budget_max,
 round(avg(greatest(w, h) / least(w, h)), 6) AS elongation_mean, round(stddev_pop(greatest(w, h) / least(w, h)), 6) AS elongation_std,
 round(avg(pi() * w * h / pow(w + h, 2)), 6) AS compactness_mean, round(stddev_pop(pi() * w * h / pow(w + h, 2)), 6) AS compactness_std,
 count(*) AS n_samples"""
_MODE = """SELECT category_id, min_by(c, (-f, c)) AS n_components_mode FROM (SELECT category_id, c, count(*) AS f FROM (
 SELECT {cat} AS category_id, cc.c FROM (SELECT episode_id, category_id, count(*) AS c FROM boxes GROUP BY 1, 2) cc {join}) GROUP BY 1, 2) GROUP BY 1"""


def _round_priors(df):
    return df.select("category_id", "n_samples", "n_components_mode", *[F.round(c, 6).alias(c) for c in _PRIOR_COLS])


@query("category_priors_m4", f"""
SELECT * FROM (SELECT category_id, {_PRIOR_AGG} FROM boxes WHERE w > 0 AND h > 0 GROUP BY category_id HAVING count(*) >= 3)
JOIN ({_MODE.format(cat='cc.category_id', join='')}) USING (category_id)""", ("boxes",))
def _(v):
    return _round_priors(category_priors(v.boxes))


_LIFT = "LEFT JOIN (SELECT id, ancestor AS t FROM up UNION ALL SELECT id, id FROM categories) a ON a.id = {c}.category_id"


@query("category_priors_rollup_m5", f"""{_UP},
lift AS (SELECT b.w, b.h, coalesce(a.t, b.category_id) AS category_id FROM boxes b {_LIFT.format(c='b')})
SELECT * FROM (SELECT category_id, {_PRIOR_AGG} FROM lift GROUP BY category_id HAVING count(*) >= 3)
JOIN ({_MODE.format(cat='coalesce(a.t, cc.category_id)', join=_LIFT.format(c='cc'))}) USING (category_id)""", ("categories", "boxes"))
def _(v):
    return _round_priors(category_priors(v.boxes, v.categories.select("id", "parent_id")))


@query("inherited_priors_m6", """
WITH pri AS (SELECT category_id, min(w * h) AS lo, max(w * h) AS hi FROM boxes GROUP BY 1 UNION ALL SELECT 'n3', 0.1, 0.2 UNION ALL SELECT 'r0', 0.3, 0.4)
SELECT c.id, c.parent_id, CASE WHEN o.category_id IS NOT NULL THEN 'has_own_priors' WHEN c.parent_id IS NULL THEN 'no_parent'
 WHEN p.category_id IS NULL THEN 'parent_without_priors' ELSE 'inherited' END AS status,
 CASE WHEN o.category_id IS NULL THEN round(p.lo, 6) END AS area_budget_min,
 CASE WHEN o.category_id IS NULL THEN round(p.hi, 6) END AS area_budget_max,
 CASE WHEN o.category_id IS NULL AND p.category_id IS NOT NULL THEN 0 END AS n_samples
FROM categories c LEFT JOIN pri o ON o.category_id = c.id LEFT JOIN pri p ON p.category_id = c.parent_id""", ("categories", "boxes"))
def _(v):
    pri = v.boxes.groupBy("category_id").agg(F.min(F.col("w") * F.col("h")).alias("area_budget_min"),
                                             F.max(F.col("w") * F.col("h")).alias("area_budget_max"))
    pri = pri.unionByName(v.spark.sql("SELECT 'n3' category_id, 0.1D area_budget_min, 0.2D area_budget_max UNION ALL SELECT 'r0', 0.3D, 0.4D"))
    out = lx.inherit_priors(v.categories, pri)
    return out.withColumn("area_budget_min", F.round("area_budget_min", 6)).withColumn("area_budget_max", F.round("area_budget_max", 6))


@query("version_parents_w14", """
SELECT version_id, coalesce(parent_version_id, lag(version_id) OVER (ORDER BY created_at, version_id)) AS parent_version_id FROM versions""",
       ("versions",))
def _(v):
    return lx.version_parents(v.versions).select("version_id", "parent_version_id")


@query("version_rollback_g10", """
SELECT version_id, CASE WHEN version_id = (SELECT parent_version_id FROM versions WHERE version_id = 'v10') THEN 1800000000
 ELSE activated_at END AS activated_at FROM versions
WHERE activated_at IS NOT NULL OR created_at >= 1700500000
 OR version_id = (SELECT parent_version_id FROM versions WHERE version_id = 'v10')""", ("versions",))
def _(v):
    rolled = lx.rollback_version(v.versions, "v10", 1800000000)
    return lx.drop_stale_versions(rolled, 1700500000).select("version_id", "activated_at") \
        .withColumn("activated_at", F.col("activated_at").cast("long"))


@query("version_history_k5", "SELECT version_id, created_at, changeset FROM versions ORDER BY created_at DESC, version_id DESC LIMIT 10",
       ("versions",))
def _(v):
    return lx.version_history(v.versions).select("version_id", "created_at", "changeset")


@query("english_tokens_c21", r"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(nm), '[^a-z]+'), lambda t: length(t) >= 4))), ',') AS tokens
FROM (SELECT p_partkey, p_name || '_' || p_type || '_山石_' || p_brand AS nm FROM part)""")
def _(v):
    nm = F.concat("p_name", F.lit("_"), "p_type", F.lit("_山石_"), "p_brand")
    return v.part.select("p_partkey", F.array_join(F.array_sort(lx.english_tokens(nm)), ",").alias("tokens"))


@query("name_tokens_c22", r"""
SELECT seq, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(name, '^\d+[A-Da-d]?_', ''), '[_\s]+'), lambda t: t <> ''))), ',') AS tokens
FROM layer_names""", ("layer_names",))
def _(v):
    return v.layer_names.select("seq", F.array_join(F.array_sort(lx.name_tokens(F.col("name"))), ",").alias("tokens"))
