"""Registered queries on whole jobs, preset files and the batch form of the streams."""

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import episodes as ep
from ..operators import masks as mk
from ..operators import rules
from ..operators import similarity as sim
from ..session import new_folder
from ..sources import index as ix
from ..sources import lexicon_store as ls
from ..sources import logs
from ..sources import presets as ps
from ..streaming import learning as le
from ..streaming import progress as pr
from . import jobs
from . import raster_sql as rs
from .catalog_audit import _acts, _ACTS, _fine_prompts, _FINE, _type_categories, _TYPES
from .catalog_episodes import _admit_sql, _CENTROIDS, _dims, _metrics, _SIM, _UPD
from .catalog_lexicon import _LIFT, _PRIOR_AGG, _round_priors, _UP
from .catalog_masks import _ST
from .catalog_raster import _D
from .registry import query

M = ("mask_px", "canvases", "pixels")
K = ep.DIM_KEYS


# Five pictures, so that every dimension passes for some and fails for others: 0 has no source, 1 a box that is too tall and
# an almost empty base, 2 a layer twice and an inverted rendering, 3 no base, 4 a hidden layer, a base that kept everything
# and a layer the manifest does not know; only 1, 3 and 4 have the same seal twice.
def _audit_inputs(v):
    named = F.when((F.col("layer") == "10_frame") & (F.col("image_id") != 3), "10_Base_Ground").otherwise(F.col("layer"))
    mask = v.masks.where("NOT (layer = '03_seal_02' AND image_id IN (0, 2))").withColumn("layer", named)
    layers = mk.half_open_boxes(mask).withColumn("position", F.substring("layer", 1, 2).cast("int")) \
        .withColumn("visible", F.expr("NOT (image_id = 4 AND layer = '08_geese_01')")).withColumn("btm", F.expr("btm + CASE WHEN image_id = 1 AND layer = '04_trees' THEN 1 ELSE 0 END"))
    twice = F.explode(F.sequence(F.lit(1), F.expr("CASE WHEN image_id = 2 AND layer = '05_cliffs' THEN 2 ELSE 1 END")))
    layers = layers.withColumn("_t", twice).drop("_t")
    base = v.pixels.where("image_id <> 1 OR (x = 0 AND y = 0)").select("image_id", "y", "x", "b", F.expr("CASE WHEN image_id = 4 THEN g ELSE 0 END").alias("g"), "r")
    seen = lambda c, e: F.expr(f"CASE WHEN image_id = 2 THEN 255 - {c} ELSE {e} END").cast("int").alias(c)
    comp = v.pixels.select("image_id", "y", "x", seen("b", "b"), seen("g", "g"), seen("r", "floor(r * 0.9)"))
    facts = v.canvases.select("image_id", F.expr("CASE WHEN image_id % 2 = 0 THEN 'cmyk' ELSE 'rgb' END").alias("color_mode"), (300 + 5 * F.col("image_id")).alias("tac_max_pct"),
                              (F.col("image_id") != 2).alias("plate_purity_ok"), F.lit(0.0).alias("generated_ratio"), (F.col("image_id") != 1).alias("has_manifest"),
                              (F.col("image_id") != 0).alias("has_source"))
    return layers, mask, v.pixels, base, v.canvases, comp, facts, layers.where("NOT (image_id = 4 AND layer = '04_trees')").select("image_id", "layer")


def _long(dim: int, metrics: dict[str, str], src: str) -> str:
    return " UNION ALL ".join(f"SELECT image_id AS artifact, '{K[dim]}' AS dim, '{k}' AS metric, CAST({e} AS DOUBLE) AS value FROM {src}" for k, e in metrics.items())


_AUDIT = f"""mk2 AS (SELECT image_id, CASE WHEN layer = '10_frame' AND image_id <> 3 THEN '10_Base_Ground' ELSE layer END AS layer, y, x FROM mask_px WHERE NOT (layer = '03_seal_02' AND image_id IN (0, 2))),
lb AS (SELECT image_id, layer, max(y) - min(y) + 1 AS ph, max(x) - min(x) + 1 AS pw, count(*) AS n, layer <> '10_Base_Ground' AS content FROM mk2 GROUP BY 1, 2),
ly AS (SELECT *, ph + CASE WHEN image_id = 1 AND layer = '04_trees' THEN 1 ELSE 0 END AS bh, NOT (image_id = 4 AND layer = '08_geese_01') AS visible FROM lb, unnest(range(0, CASE WHEN image_id = 2 AND layer = '05_cliffs' THEN 2 ELSE 1 END)) t(i)),
q1 AS (SELECT image_id, count(*) AS layer_count, count(*) FILTER (content) AS content_layers, count(*) - count(DISTINCT layer) AS duplicate_names, count(*) FILTER (NOT visible) AS invisible_layers, count(*) FILTER (content AND bh <> ph) AS res_mismatch,
 count(DISTINCT layer) AS actual, count(DISTINCT layer) FILTER (NOT (image_id = 4 AND layer = '04_trees')) AS declared FROM ly GROUP BY 1),
q3 AS (SELECT image_id, count(*) AS pairs FROM (SELECT a.image_id, count(*) AS i FROM mk2 a JOIN mk2 b USING (image_id, y, x) WHERE a.layer = '03_seal_01' AND b.layer = '03_seal_02' GROUP BY 1) JOIN lb n1 USING (image_id) JOIN lb n2 USING (image_id)
 WHERE n1.layer = '03_seal_01' AND n2.layer = '03_seal_02' AND i / (n1.n + n2.n - i) > 0.9 GROUP BY 1),
bs AS (SELECT image_id, y, x, b, CASE WHEN image_id = 4 THEN g ELSE 0 END AS g, r, floor(0.114e0 * b + 0.587e0 * (CASE WHEN image_id = 4 THEN g ELSE 0 END) + 0.299e0 * r + 0.5) AS gr FROM pixels WHERE image_id <> 1 OR (x = 0 AND y = 0)),
med AS (SELECT image_id, quantile_cont(gray, 0.5) AS m FROM pixels GROUP BY 1), fl AS (SELECT p.image_id, p.gray < m - 12 AS i, greatest(abs(coalesce(s.b, 255) - p.b), abs(coalesce(s.g, 255) - p.g), abs(coalesce(s.r, 255) - p.r)) > 40 AS e,
 EXISTS (SELECT 1 FROM mk2 k WHERE k.image_id = p.image_id AND k.y = p.y AND k.x = p.x AND k.layer NOT IN ('10_Base_Ground', '13_Spot')) AS u FROM pixels p JOIN med USING (image_id) LEFT JOIN bs s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x),
q4 AS (SELECT image_id, greatest(1, count(*) FILTER (i)) AS ink_px, count(*) FILTER (i AND e AND NOT u) AS lost_px, count(*) FILTER (e) AS e, count(*) FILTER (u) AS u, count(*) FILTER (i AND e) AS ie, count(*) AS n FROM fl GROUP BY 1),
df AS (SELECT image_id, y, x, CASE WHEN image_id = 2 THEN 255 - 2 * b ELSE 0 END AS b, CASE WHEN image_id = 2 THEN 255 - 2 * g ELSE 0 END AS g, CASE WHEN image_id = 2 THEN 255 - 2 * r ELSE floor(r * 0.9e0) - r END AS r FROM pixels),
{', '.join(rs.gauss('l' + c, 'df', c, sigma=16.0) for c in 'bgr')},
q5 AS (SELECT image_id, sqrt(avg((pow(df.b, 2) + pow(df.g, 2) + pow(df.r, 2)) / 3)) AS raw, sqrt(avg((pow(lb.b, 2) + pow(lg.g, 2) + pow(lr.r, 2)) / 3)) AS low FROM df JOIN lb2 lb USING (image_id, y, x) JOIN lg USING (image_id, y, x) JOIN lr USING (image_id, y, x) GROUP BY 1),
bm AS (SELECT image_id, quantile_cont(gr, 0.5) AS m FROM bs GROUP BY 1), bd AS (SELECT image_id, count(*) AS n, avg(CASE WHEN gr < m - 20 THEN 1e0 ELSE 0e0 END) AS dark FROM bs JOIN bm USING (image_id) GROUP BY 1),
q6 AS (SELECT image_id, 100e0 * bd.n / (bh * pw) AS opaque, dark FROM bd JOIN ly USING (image_id) WHERE layer = '10_Base_Ground'),
dims AS (SELECT image_id AS artifact, '{K[0]}' AS dim, duplicate_names + invisible_layers = 0 AS passed, true AS evaluated, false AS na, CASE WHEN duplicate_names + invisible_layers > 0 THEN 'duplicate or invisible layers' END AS issue FROM q1
UNION ALL SELECT image_id, '{K[1]}', res_mismatch = 0, true, false, CASE WHEN res_mismatch > 0 THEN 'layer size differs from its box' END FROM q1
UNION ALL SELECT image_id, '{K[2]}', pairs IS NULL, true, false, CASE WHEN pairs IS NOT NULL THEN 'repeated instances' END FROM canvases LEFT JOIN q3 USING (image_id)
UNION ALL SELECT image_id, '{K[3]}', ok, image_id <> 0, false, CASE WHEN NOT ok THEN 'content lost' END FROM (SELECT image_id, image_id IN (0, 3) OR lost_px / ink_px <= 0.02 AS ok FROM q4)
UNION ALL SELECT image_id, '{K[4]}', ok, image_id <> 0, false, CASE WHEN NOT ok THEN 'composite differs' END FROM (SELECT image_id, image_id = 0 OR (raw <= 60 AND low <= 25) AS ok FROM q5)
UNION ALL SELECT image_id, '{K[5]}', coalesce(opaque >= 1, false), true, false, CASE WHEN opaque IS NULL THEN 'no base layer' WHEN opaque < 1 THEN 'empty base layer' END FROM canvases LEFT JOIN q6 USING (image_id)
UNION ALL SELECT image_id, '{K[6]}', NOT (image_id % 2 = 0 AND (300 + 5 * image_id > 310 OR image_id = 2)), image_id % 2 = 0, image_id % 2 = 1, CASE WHEN image_id = 2 THEN 'impure' WHEN image_id = 4 THEN 'tac_over_limit' END FROM canvases
UNION ALL SELECT image_id, '{K[7]}', declared = actual OR image_id = 1, image_id <> 1, false, CASE WHEN declared <> actual AND image_id <> 1 THEN 'layer lists differ' END FROM q1)""".replace("lb_w", "lb2_w").replace("lb_h", "lb2_h").replace("lb AS (SELECT p.image_id", "lb2 AS (SELECT p.image_id")
_METRICS = " UNION ALL ".join([
    _long(0, {c: c for c in ("layer_count", "content_layers", "duplicate_names", "invisible_layers")}, "q1"), _long(1, {"res_mismatch": "res_mismatch"}, "q1"),
    _long(2, {"duplicate_pairs": "coalesce(pairs, 0)"}, "canvases LEFT JOIN q3 USING (image_id)"),
    _long(3, {"ink_px": "ink_px", "lost_px": "lost_px", "lost_ratio": "round(lost_px / ink_px, 6)", "erased_pct": "round(100e0 * e / n, 2)", "union_pct": "round(100e0 * u / n, 2)",
              "ink_erased_pct": "round(100e0 * ie / ink_px, 3)"}, "q4 WHERE image_id NOT IN (0, 3)"),
    _long(4, {"rmse_raw": "round(raw, 2)", "rmse_lowfreq": "round(low, 2)"}, "q5 WHERE image_id <> 0"),
    _long(5, {"opaque_pct": "round(opaque, 1)", "dark_ratio_all": "round(100 * dark, 2)"}, "q6"), _long(6, {"tac_max_pct": "300 + 5 * image_id"}, "canvases WHERE image_id % 2 = 0"),
    _long(6, {"generated_pixel_ratio": "0"}, "canvases WHERE image_id <> 1"), _long(7, {"declared": "declared", "actual": "actual"}, "q1 WHERE image_id <> 1")])


@query("delivery_audit_x1", f"WITH {_AUDIT} SELECT * FROM dims", M)
def _(v):
    return jobs.delivery_audit(*_audit_inputs(v)).drop("metrics")


@query("delivery_metrics_x1", f"WITH {_AUDIT} {_METRICS}", M)
def _(v):
    return jobs.delivery_audit(*_audit_inputs(v)).select("artifact", "dim", F.explode("metrics").alias("metric", "value"))


@query("delivery_verdict_x1_m21", f"""WITH {_AUDIT} SELECT artifact, bool_and(passed) AS passed, count(*) FILTER (NOT passed) AS failed_dims, count(*) FILTER (evaluated) AS evaluated_dims, count(*) FILTER (na) AS na_dims,
 coalesce(string_agg(dim || ': ' || issue, '; ' ORDER BY dim), '') AS issues FROM dims GROUP BY 1""", M)
def _(v):
    return au.verdict(jobs.delivery_audit(*_audit_inputs(v)))


@query("learned_suggestions_x2", f"""WITH {_UPD} SELECT category_id, prompt, round(list_reduce(list_prepend(max(old_weight), list(CASE WHEN old_weight > 0 THEN new_weight / old_weight ELSE 1e0 END ORDER BY seq, CAST(episode_id AS VARCHAR))), lambda acc, r: greatest(0.05e0, least(5e0, acc * r))), 6) AS new_weight
FROM upd WHERE old_weight IS NOT NULL GROUP BY 1, 2""", ("detections", "prompts"))
def _(v):
    return jobs.learn(v.detections, v.prompts).select("category_id", "prompt", F.round("new_weight", 6).alias("new_weight"))


@query("retrieved_episodes_x3", f"""{_CENTROIDS}, adm AS (SELECT seq, episode_id, preset, output_mode FROM episodes WHERE {_admit_sql()} = 'ok')
SELECT family, task_id, round(s, 6) AS similarity, rank, episode_id, CASE WHEN preset <> 'preset1' THEN 'preset:' || preset WHEN output_mode <> 'plate' THEN 'line:' || output_mode END AS blocked FROM (
 SELECT c.family, e.vec_id AS task_id, {_SIM} AS s, a.episode_id, a.preset, a.output_mode, CAST(row_number() OVER (PARTITION BY c.family ORDER BY {_SIM} DESC, e.vec_id) AS INT) AS rank
 FROM c, embeddings e JOIN adm a ON a.seq = e.vec_id WHERE {_SIM} >= 0.05) WHERE rank <= 5""", ("episodes",))
def _(v):
    out = jobs.retrieve_similar(sim.family_centroids(v.episode_index), v.episode_index, _dims(v).withColumnRenamed("seq", "task"), query_id="family", query_vec="centroid",
                                key="task", min_similarity=0.05, preset="preset1", line="plate")
    return out.select(F.col("family").cast("int"), "task_id", F.round("similarity", 6).alias("similarity"), "rank", "episode_id", "blocked")


@query("built_priors_x4", f"""{_UP}, lift AS (SELECT b.w, b.h, coalesce(a.t, b.category_id) AS category_id FROM boxes b {_LIFT.format(c='b')})
SELECT category_id, {_PRIOR_AGG} FROM lift SEMI JOIN categories c ON c.id = category_id GROUP BY category_id HAVING count(*) >= 3""", ("categories", "boxes"))
def _(v):
    return _round_priors(jobs.build_priors(v.boxes, v.categories)).drop("n_components_mode")


@query("selected_categories_x6", """
WITH b AS (SELECT a.material_family, 's' || a.category_id AS category_id, row_number() OVER (PARTITION BY a.material_family ORDER BY a.affinity DESC, c.confidence DESC, c.id) AS rank
 FROM affinity a JOIN categories c ON c.id = 's' || a.category_id WHERE a.affinity >= 0.3 AND c.deleted_at IS NULL),
l AS (SELECT material_family, list(category_id ORDER BY rank) FILTER (category_id NOT IN ('s3', 'seal')) AS ids FROM b WHERE rank <= 20 GROUP BY 1)
SELECT c_custkey, n_name AS material_family, array_to_string(list_concat(['repair_marks', 'calligraphy'], ['s3', 'seal'], coalesce(ids, [])), ',') AS ids
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l ON l.material_family = n_name""", ("affinity", "categories"))
def _(v):
    images = v.customer.join(v.nation, v.nation.n_nationkey == v.customer.c_nationkey).select("c_custkey", F.col("n_name").alias("material_family"))
    aff = v.affinity.withColumn("category_id", F.concat(F.lit("s"), "category_id"))
    out = jobs.select_categories(images, aff, v.categories, mode="hybrid", preset_ids=["s3", "seal"])
    return out.select("c_custkey", "material_family", F.array_join("category_ids", ",").alias("ids"))


@query("gated_layers_x9", f"""WITH {_D}, {_ST}, g AS (SELECT image_id, layer, CASE WHEN pixels / (h * w) > CASE layer WHEN '03_seal_01' THEN 0.015e0 WHEN '03_seal_02' THEN 0.015e0 WHEN '04_trees' THEN 0.2e0 WHEN '05_cliffs' THEN 0.25e0 WHEN '08_geese_01' THEN 0.06e0 WHEN '10_frame' THEN 0.35e0 ELSE 0.15e0 END
 THEN 'quality:over_budget' WHEN layer <> '10_frame' AND bbox_ratio > 0.5 THEN 'diffuse' ELSE 'accepted' END AS fate FROM st),
src AS (SELECT m.image_id, m.layer, m.y, m.x FROM mask_px m JOIN dens USING (image_id, y, x) SEMI JOIN (SELECT * FROM g WHERE fate = 'diffuse' AND layer = '05_cliffs') q ON q.image_id = m.image_id AND q.layer = m.layer WHERE d > 0.05e0),
{rs.closing('cl', 'src', rs.rect(2, 2))}, {rs.opening('op', 'cl', rs.rect(3, 3))}, bk AS (SELECT image_id, layer FROM op JOIN canvases USING (image_id) GROUP BY 1, 2 HAVING (max(x) - min(x) + 1) * (max(y) - min(y) + 1) / any_value(h * w) <= 0.5)
SELECT image_id, layer, CASE WHEN (image_id, layer) IN (SELECT (image_id, layer) FROM bk) THEN 'recovered' ELSE fate END AS fate FROM g""", M)
def _(v):
    return jobs.gate_layers(v.masks, v.masks, v.pixels, v.canvases, refine=["05_cliffs"], floor=0.05, close=2, open_=3).select("image_id", "layer", "fate")


def _feedback(v):
    acts = _acts(v).withColumn("target_category_id", F.expr("CASE WHEN user_action = 'merge' THEN concat('click', seq % 7) END"))
    return jobs.apply_feedback(acts, _type_categories(v), _fine_prompts(v), 1800000000)


@query("feedback_results_x10", f"""WITH {_ACTS}, {_TYPES}, {_FINE} SELECT feedback_request_id, a.category_id, user_action, CASE WHEN user_action = 'accept' THEN CASE WHEN NOT EXISTS (SELECT 1 FROM cats WHERE id = a.category_id AND deleted_at IS NULL) THEN 'no_category'
 WHEN NOT EXISTS (SELECT 1 FROM fine f WHERE f.category_id = a.category_id) THEN 'no_prompt' ELSE 'ok' END WHEN a.category_id = 'ghost' THEN 'no_category' ELSE 'ok' END AS status FROM acts a""", ("detections",))
def _(v):
    return _feedback(v)["results"].select("feedback_request_id", "category_id", "user_action", "status")


@query("feedback_lexicon_x10", f"""WITH {_ACTS}, {_TYPES}, r AS (SELECT category_id, max(seq) AS seq FROM acts WHERE user_action = 'rename' AND seq % 8 = 1 GROUP BY 1),
mg AS (SELECT DISTINCT category_id FROM acts WHERE user_action = 'merge' AND category_id <> 'click' || (seq % 7) AND EXISTS (SELECT 1 FROM cats WHERE id = category_id) AND EXISTS (SELECT 1 FROM cats WHERE id = 'click' || (seq % 7)))
SELECT c.id, CASE WHEN r.seq IS NULL THEN c.id ELSE 'N' || r.seq END AS name_zh, CASE WHEN c.id IN (SELECT category_id FROM acts WHERE user_action = 'delete') OR c.id IN (SELECT category_id FROM mg) THEN 1800000000 ELSE deleted_at END AS deleted_at FROM cats c LEFT JOIN r ON r.category_id = c.id""")
def _(v):
    return _feedback(v)["categories"].select("id", "name_zh", "deleted_at")


# ---- presets and index -----------------------------------------------------

def _presets(v):
    text = F.expr("""concat('{"preset_name":"p', p_partkey, '"',
      CASE p_size % 4 WHEN 0 THEN ',"super_res_scale":"x"' WHEN 1 THEN ',"super_res_scale":-1' WHEN 2 THEN ',"super_res_scale":2.5' ELSE '' END,
      CASE p_size % 5 WHEN 0 THEN ',"mode":"weird"' WHEN 1 THEN ',"mode":"auto"' ELSE '' END,
      CASE p_size % 3 WHEN 0 THEN ',"auto_evolve":1' WHEN 1 THEN ',"auto_evolve":true' ELSE '' END,
      CASE p_partkey % 4 WHEN 0 THEN ',"ai_semantic_classes":"bad"' WHEN 1 THEN ',"ai_semantic_classes":[{"name":"a","prompt":"x","region":[0,0,1,1]},{"layer_name":"b","region":[0,0,2,1]}]'
        WHEN 2 THEN ',"ai_semantic_classes":[{"prompt":"x","regions":[[0,0,0.5,1],[0,0,1]]},3]' ELSE '' END,
      CASE p_partkey % 7 WHEN 0 THEN ',"density_refine":{"classes":{"a":{"floor":0.1},"b":{}}}' WHEN 1 THEN ',"density_refine":[]' ELSE '' END,
      CASE p_partkey % 3 WHEN 0 THEN ',"plate_operators":{"trapping":{"enabled":true}}' WHEN 1 THEN ',"plate_operators":{"micro_holes":{"enabled":"yes"},"contour_protection":5}' ELSE '' END,
      CASE p_partkey % 5 WHEN 0 THEN ',"output":{"mode":"plate","color_mode":"rgb"}' WHEN 1 THEN ',"output":{"mode":"both"},"icc_path":"a.icc","print_condition":"newsprint"' WHEN 2 THEN ',"output":{"mode":"plate"},"icc_path":"lost.icc","print_condition":"moon"' ELSE '' END,
      CASE WHEN p_partkey % 13 = 0 THEN '' ELSE '}' END)""")
    return v.part.select(F.concat(F.lit("f"), "p_partkey").alias("file"), text.alias("text"))


_PRESET = "SELECT p_partkey AS k, p_size AS z, 'f' || p_partkey AS file, p_partkey % 13 = 0 AS broken FROM part"


@query("preset_listing_s12", f"""SELECT 'p' || k AS name, file AS display_name, '' AS description, CASE k % 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS semantic_classes, CASE k % 5 WHEN 0 THEN 'plate' WHEN 1 THEN 'design,plate' WHEN 2 THEN 'plate' ELSE 'design' END AS output_modes FROM ({_PRESET}) WHERE NOT broken""")
def _(v):
    return ps.list_presets(_presets(v))


@query("preset_issues_p14", f"""SELECT file, array_to_string(list_filter([CASE WHEN z % 4 = 0 THEN 'super_res_scale 必须是数值' END, CASE WHEN z % 4 = 1 THEN 'super_res_scale 必须 > 0' END,
 CASE WHEN z % 5 = 0 THEN 'mode 必须是 [''auto'', ''hybrid'', ''locked''] 之一，实际 ''weird''' END, CASE WHEN z % 3 = 0 THEN 'auto_evolve 必须是布尔' END, CASE WHEN k % 4 = 0 THEN 'ai_semantic_classes 必须是列表' END,
 CASE WHEN k % 4 = 1 THEN 'ai_semantic_classes[1]（b）缺少 prompt' END, CASE WHEN k % 4 = 1 THEN 'ai_semantic_classes[1].region 取值应在 [0,1]' END,
 CASE WHEN k % 4 = 2 THEN 'ai_semantic_classes[0] 缺少 name/layer_name' END, CASE WHEN k % 4 = 2 THEN 'ai_semantic_classes[0].regions 必须是 4 元归一化数值' END, CASE WHEN k % 4 = 2 THEN 'ai_semantic_classes[1] 必须是对象' END,
 CASE WHEN k % 7 = 1 THEN 'density_refine 必须是对象' END, CASE WHEN k % 7 = 0 THEN 'density_refine.classes[''b''] 缺少数值 floor' END, CASE WHEN k % 3 = 1 THEN 'plate_operators.contour_protection 必须是对象' END,
 CASE WHEN k % 3 = 1 THEN 'plate_operators.micro_holes.enabled 必须是布尔' END, CASE WHEN k % 3 = 0 THEN 'plate_operators.trapping 启用时须提供 spot_layer_name' END], lambda s: s IS NOT NULL), '; ') AS issues FROM ({_PRESET}) WHERE NOT broken""")
def _(v):
    p = ps.parsed(_presets(v)).where("v IS NOT NULL")
    return p.select("file", F.array_join(ps.preset_issues(F.col("v")), "; ").alias("issues"))


@query("print_integrity_p15", f"""SELECT file, 'unreadable' AS issue FROM ({_PRESET}) WHERE broken UNION ALL SELECT file, 'icc_missing' FROM ({_PRESET}) WHERE NOT broken AND k % 5 = 0 UNION ALL SELECT file, 'color_mode_not_cmyk' FROM ({_PRESET}) WHERE NOT broken AND k % 5 = 0
UNION ALL SELECT file, 'icc_not_found' FROM ({_PRESET}) WHERE NOT broken AND k % 5 = 2 UNION ALL SELECT file, 'print_condition_unknown' FROM ({_PRESET}) WHERE NOT broken AND k % 5 = 2""")
def _(v):
    files = v.part.select(F.when(F.col("p_size") > 1, "a.icc").otherwise("b.icc").alias("path"))
    return ps.print_integrity(_presets(v), files)


@query("index_rows_s7", f"SELECT e.vec_id AS task_id, {_admit_sql()} = 'ok' AS audit_passed, len(e.embedding) AS n FROM embeddings e JOIN episodes ON seq = e.vec_id", ("episodes",))
def _(v):
    e = _dims(v).join(v.embeddings.select(F.col("vec_id").alias("seq"), "embedding"), "seq")
    e = e.select(F.col("seq").alias("episode_id"), "embedding", ep.admission_reason(F.col("dims"), F.col("output_mode")).alias("reason"))
    return ix.index_rows(e, 64).select("task_id", "audit_passed", F.size("embedding").cast("long").alias("n"))


@query("published_index_s7_t9", f"SELECT e.vec_id AS task_id, e.vec_id % 5 <> 0 AND {_admit_sql()} = 'ok' AS audit_passed, len(e.embedding) AS n FROM embeddings e JOIN episodes ON seq = e.vec_id", ("episodes",))
def _(v):
    e = _dims(v).join(v.embeddings.select(F.col("vec_id").alias("seq"), "embedding"), "seq")
    rows = ix.index_rows(e.select(F.col("seq").alias("episode_id"), "embedding", ep.admission_reason(F.col("dims"), F.col("output_mode")).alias("reason")), 64)
    path, failed = new_folder(v.spark), rows.where("task_id % 5 = 0").withColumn("audit_passed", F.lit(False))
    for batch in range(3):
        ix.upsert_index(rows.where(F.pmod("task_id", F.lit(3)) == batch), path, batch, "audits")
    ix.upsert_index(failed, path, 3, "audits")  # later audits of the same episodes
    ix.upsert_index(rows, path, 2, "audits")    # a batch that comes again changes nothing
    return ix.load_index(v.spark, path).select("task_id", "audit_passed", F.size("embedding").cast("long").alias("n"))


@query("stored_episodes_s4_s5", """WITH p AS (SELECT l_orderkey AS seq, arg_max('p' || l_partkey, l_linenumber * 10000000 + l_partkey) FILTER (l_returnflag = 'R') AS preset, arg_max('a' || l_partkey, l_linenumber * 10000000 + l_partkey) AS artifact FROM lineitem GROUP BY 1)
SELECT episode_id, e.seq, output_mode, coalesce(p.preset, e.preset) AS preset, p.artifact FROM episodes e LEFT JOIN p USING (seq)""", ("episodes",))
def _(v):
    path, rows = new_folder(v.spark), v.episodes.select("episode_id", "seq", "output_mode", "preset")
    for mode in ("plate", "design", "both"):
        logs.append_episodes(rows.where(F.col("output_mode") == mode), path)
    logs.patch_episodes(v.lineitem.select(F.concat(F.lit("ep_"), "l_orderkey").alias("episode_id"), F.expr("l_linenumber * 10000000L + l_partkey").alias("seq"),
                                          F.expr("CASE WHEN l_returnflag = 'R' THEN 'p' || l_partkey END").alias("preset"), F.concat(F.lit("a"), "l_partkey").alias("artifact")), path)
    return logs.stored_episodes(v.spark, path).select("episode_id", "seq", "output_mode", "preset", "artifact")


@query("published_prompts_s17_g10", """SELECT 'v1' AS version_id, true AS active, 'v1,v2' AS kept, category_id, prompt, weight, source FROM prompts
UNION ALL SELECT 'v2', false, 'v1,v2', category_id, prompt, weight * 0.5e0, source FROM prompts""", ("prompts",))
def _(v):
    path, t = new_folder(v.spark), 1_700_000_000
    ls.create_version(v.spark, path, "v1", {"categories": v.categories, "affinity": v.affinity, "prompts": v.prompts}, t, activate=True)
    ls.create_version(v.spark, path, "v2", {"prompts": v.prompts.withColumn("weight", F.col("weight") * 0.5)}, t + 100, activate=True)
    ls.create_version(v.spark, path, "v3", {"prompts": v.prompts.where("weight >= 0.3")}, t + 200)
    ls.roll_back(v.spark, path, "v2", t + 300)
    ls.expire(v.spark, path, t + 400)  # v3 was never activated
    kept = ",".join(sorted(r["version_id"] for r in ls.versions(v.spark, path).select("version_id").collect()))
    active = ls.active_version(v.spark, path).first()["version_id"]
    rows = [ls.load(v.spark, path, named)["prompts"].select(F.lit(name).alias("version_id"), F.lit(name == active).alias("active"), F.lit(kept).alias("kept"),
                                                            "category_id", "prompt", "weight", "source") for name, named in (("v1", None), ("v2", "v2"))]
    return rows[0].unionByName(rows[1])


def _baseline(v):
    m = _metrics(v).withColumn("metrics", F.when(F.col("has_report"), F.col("metrics")))
    return ix.extract_baseline(v.episodes.select("episode_id"), m.select("episode_id", "metrics", "passed"), "episode_id")


@query("baseline_rows_s14", """SELECT episode_id, CASE WHEN k1 % 5 <> 0 THEN k1 / 100000e0 ELSE 0e0 END AS lost_ratio, k2 % 97 / 8e0 AS rmse_raw, CAST(k1 % 40 AS INT) AS n_layers, has_report AS passed FROM episodes WHERE has_report""", ("episodes",))
def _(v):
    return _baseline(v)[0].select("episode_id", "lost_ratio", "rmse_raw", "n_layers", "passed")


@query("baseline_rejects_s14", "SELECT episode_id FROM episodes WHERE NOT has_report", ("episodes",))
def _(v):
    return _baseline(v)[1]


# ---- batch form of the streams ---------------------------------------------

_LOG = """lg AS (SELECT conv_id AS task_id, turn AS seq, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn * 37 + conv_id % 11) AS ts, text || CASE (conv_id + turn) % 5 WHEN 0 THEN ' seed 1' WHEN 1 THEN '分割' WHEN 2 THEN ' out.psb' ELSE '' END AS message,
 CASE conv_id % 3 WHEN 0 THEN 'textile_damask' WHEN 1 THEN 'japanese_screen_gold' ELSE 'other' END AS preset FROM conversations)"""


def _log(v):
    return v.conversations.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 37 + F.col("conv_id") % 11).alias("ts"),
                                  F.concat("text", F.expr("CASE (conv_id + turn) % 5 WHEN 0 THEN ' seed 1' WHEN 1 THEN '分割' WHEN 2 THEN ' out.psb' ELSE '' END")).alias("message"),
                                  F.expr("CASE conv_id % 3 WHEN 0 THEN 'textile_damask' WHEN 1 THEN 'japanese_screen_gold' ELSE 'other' END").alias("preset"))


def _stage_sql():
    arms = " ".join("WHEN regexp_matches(message, '(?i)" + p.replace("\\", "\\") + f"') THEN '{s}'" for p, s in rules.STAGES)
    return f"CASE {arms} END"


@query("task_progress_t2_t3", f"""WITH {_LOG}, s AS (SELECT *, {_stage_sql()} AS st, min(ts) OVER (PARTITION BY task_id) AS t0 FROM lg)
SELECT task_id, seq, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING), '处理中') AS stage,
 CAST(least(95, floor((epoch(ts) - epoch(t0)) / CASE preset WHEN 'textile_damask' THEN 80 WHEN 'japanese_screen_gold' THEN 250 ELSE 240 END * 100)) AS INT) AS progress FROM s""")
def _(v):
    return pr.progress_batch(_log(v)).select("task_id", "seq", "stage", "progress")


@query("log_replay_t4", f"WITH {_LOG} SELECT task_id, seq, CAST(back AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS back FROM lg) WHERE back <= 20")
def _(v):
    return pr.replay(_log(v)).select("task_id", "seq", "back")


_TASKS = "ev AS (SELECT user_id AS episode_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'no_op' ELSE 'enqueue' END AS event FROM events)"


def _tasks(v):
    return v.events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), F.expr("CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'no_op' ELSE 'enqueue' END").alias("event"))


@query("enqueue_decisions_t5", f"""WITH {_TASKS}, p AS (SELECT *, lag(event) OVER (PARTITION BY episode_id ORDER BY seq) AS prev FROM ev) SELECT episode_id, seq, CASE WHEN prev IS NULL OR prev IN ('failed', 'no_op') THEN 'queued' ELSE 'duplicate' END AS decision FROM p WHERE event = 'enqueue'""")
def _(v):
    return le.enqueue_decisions_batch(_tasks(v))


@query("task_outcomes_t6", f"""WITH {_UPD}, t AS (SELECT user_id AS episode_id FROM events UNION SELECT c_custkey FROM customer)
SELECT t.episode_id, CASE WHEN t.episode_id NOT IN (SELECT episode_id FROM detections) THEN 'failed' WHEN coalesce(n, 0) = 0 THEN 'no_op' ELSE 'completed' END AS status, coalesce(n, 0) AS n_suggestions, coalesce(u, 0) AS n_unknown FROM t
LEFT JOIN (SELECT episode_id, count(old_weight) AS n, count(*) FILTER (old_weight IS NULL) AS u FROM upd GROUP BY 1) x USING (episode_id)""", ("detections", "prompts"))
def _(v):
    tasks = v.events.select(F.col("user_id").alias("episode_id")).unionByName(v.customer.select(F.col("c_custkey").alias("episode_id"))).distinct()
    return le.task_outcomes(tasks, v.detections, v.prompts)


@query("closed_requests_t8", """
SELECT q.event_id AS id, q.user_id, date_diff('second', date_trunc('second', q.ts), date_trunc('second', r.ts)) >= 0 AS in_order, r.event_type AS action FROM events q JOIN (SELECT user_id, max(event_id) AS m FROM events GROUP BY 1) l USING (user_id) JOIN events r ON r.event_id = l.m
WHERE q.event_type = 'error' AND r.ts >= q.ts""")
def _(v):
    last = v.events.groupBy("user_id").agg(F.max("event_id").alias("m"))
    rev = v.events.join(last.select(F.col("m").alias("event_id")), "event_id").select(F.col("user_id").cast("string").alias("feedback_request_id"), "ts", F.col("event_type").alias("action"))
    req = v.events.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("feedback_request_id"), "ts", F.col("event_id").alias("id"), "user_id")
    return le.close_requests(req, rev).select("id", "user_id", (F.col("reviewed_at") >= F.col("ts")).alias("in_order"), "action")


@query("finalized_episodes_t9", f"""SELECT episode_id, {_admit_sql()} AS reason, {_admit_sql()} = 'ok' AS admitted FROM episodes""", ("episodes",))
def _(v):
    d = _dims(v)
    e = d.select("episode_id", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")).alias("ts"), "output_mode")
    a = d.select("episode_id", F.timestamp_seconds(F.lit(1704067200) + F.col("seq") + (F.col("k2") % 40) * 3600).alias("ts"), "dims", "output_mode")
    return le.finalize(e, a).select("episode_id", "reason", "admitted")
