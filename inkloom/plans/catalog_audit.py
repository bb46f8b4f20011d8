"""Registered queries on delivery audits, regression, feedback and logs."""

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import episodes as ep
from ..operators import feedback as fb
from ..operators import rules
from ..sources import logs
from .registry import query

_ISSUES = """array_to_string(list_filter([
 CASE WHEN lost_ratio > b.lost_ratio * 1.05e0 THEN 'lost_ratio' END, CASE WHEN rmse_raw > b.rmse_raw * 1.05e0 THEN 'rmse_raw' END,
 CASE WHEN rmse_lowfreq > b.rmse_lowfreq * 1.05e0 THEN 'rmse_lowfreq' END, CASE WHEN tac_max_pct > b.tac_max_pct * 1.05e0 THEN 'tac_max_pct' END,
 CASE WHEN b.n_layers > 0 AND n_layers < b.n_layers * 0.95e0 THEN 'n_layers' END, CASE WHEN b.plate_purity_ok AND NOT plate_purity_ok THEN 'plate_purity_ok' END,
 CASE WHEN b.passed AND NOT passed THEN 'passed' END, CASE WHEN b.dim_a AND NOT dim_a THEN 'dim_a' END, CASE WHEN b.dim_b AND NOT dim_b THEN 'dim_b' END], lambda s: s IS NOT NULL), ',')"""
for _c in ("lost_ratio", "rmse_raw", "rmse_lowfreq", "tac_max_pct", "n_layers", "plate_purity_ok", "passed", "dim_a", "dim_b"):
    import re as _re
    _ISSUES = _re.sub(rf"(?<![\w.'])({_c})(?!['\w])", rf"a.\1", _ISSUES)


@query("baseline_regression_j13_x7", f"""
SELECT task_id, issues, n_issues, n_issues = 0 AS regression_passed, CASE WHEN n_issues = 0 THEN '回归测试通过，可以采纳学习器的权重调整建议'
 ELSE '回归测试失败（' || n_issues || ' 个退化项），建议人工审核后再采纳' END AS recommendation FROM (
SELECT task_id, issues, CASE WHEN issues = '' THEN 0 ELSE length(issues) - length(replace(issues, ',', '')) + 1 END AS n_issues
FROM (SELECT a.task_id, {_ISSUES} AS issues FROM audits a JOIN baseline b USING (task_id)))""", ("audits", "baseline"))
def _(v):
    out = au.regressions(v.audits, v.baseline, dim_flags=("dim_a", "dim_b"))
    return out.withColumn("n_issues", F.col("n_issues").cast("long")).withColumn("recommendation", au.recommendation(F.col("n_issues")))


@query("manifest_vs_layers_j12", """
WITH d AS (SELECT DISTINCT run_id, name FROM run_layers WHERE tax > 0.02), a AS (SELECT DISTINCT run_id, name FROM run_layers WHERE recon_ratio > 0.03)
SELECT run_id, name, CASE WHEN d.name IS NULL THEN 'undeclared' ELSE 'absent' END AS side
FROM (SELECT run_id, name FROM d) d FULL JOIN (SELECT run_id, name FROM a) a USING (run_id, name) WHERE d.name IS NULL OR a.name IS NULL""".replace("FULL JOIN (SELECT run_id, name FROM a) a USING (run_id, name) WHERE d.name IS NULL OR a.name IS NULL", "ANTI JOIN a USING (run_id, name)").replace("CASE WHEN d.name IS NULL THEN 'undeclared' ELSE 'absent' END", "'absent'") + """
UNION ALL SELECT run_id, name, 'undeclared' FROM a ANTI JOIN d USING (run_id, name)""", ("run_layers",))
def _(v):
    return au.declared_vs_actual(v.run_layers.where("tax > 0.02"), v.run_layers.where("recon_ratio > 0.03"))


@query("manifest_consistency_j12", """
WITH d AS (SELECT DISTINCT run_id, name, 1 AS d FROM run_layers WHERE tax > 0.02), a AS (SELECT DISTINCT run_id, name, 1 AS a FROM run_layers WHERE recon_ratio > 0.03)
SELECT run_id, count(d) AS declared, count(a) AS actual, count(*) FILTER (d IS NULL) AS undeclared, count(*) FILTER (a IS NULL) AS absent,
 count(*) FILTER (d IS NULL OR a IS NULL) = 0 AS passed FROM d FULL JOIN a USING (run_id, name) GROUP BY 1""", ("run_layers",))
def _(v):
    return au.manifest_consistency(v.run_layers.where("tax > 0.02"), v.run_layers.where("recon_ratio > 0.03"))


@query("layer_properties_m20", """
SELECT run_id, CAST(sum(n) AS BIGINT) AS layer_count, count(*) FILTER (n > 1) AS duplicate_names, CAST(sum(hidden) AS BIGINT) AS invisible_layers,
 count(*) FILTER (n > 1) = 0 AND sum(hidden) = 0 AS passed FROM (SELECT l_orderkey AS run_id, l_linenumber, count(*) AS n, count(*) FILTER (l_discount = 0) AS hidden FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    layers = v.lineitem.select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("layer_"), "l_linenumber").alias("layer"),
                               (F.col("l_discount") != 0).alias("visible"))
    return au.layer_properties(layers, "run_id")


_DIM_SQL = "dims AS (" + " UNION ALL ".join(
    f"SELECT run_id AS artifact, 'd{i}' AS dim, CASE WHEN run_id % {11 + i} = 0 THEN NULL WHEN run_id % {23 + i} = 0 THEN false ELSE true END AS passed, "
    f"run_id % {7 + i} <> 0 AS evaluated, run_id % {13 + i} = 0 AS na, CASE WHEN run_id % {23 + i} = 0 THEN 'issue{i}' END AS issue FROM runs" for i in range(8)) + ")"


def _dims(v):
    rows = F.explode(F.array(*[F.struct(
        F.lit(f"d{i}").alias("dim"), F.expr(f"CASE WHEN run_id % {11 + i} = 0 THEN NULL WHEN run_id % {23 + i} = 0 THEN false ELSE true END").alias("passed"),
        F.expr(f"run_id % {7 + i} <> 0").alias("evaluated"), F.expr(f"run_id % {13 + i} = 0").alias("na"),
        F.expr(f"CASE WHEN run_id % {23 + i} = 0 THEN 'issue{i}' END").alias("issue")) for i in range(8)]))
    return v.runs.select(F.col("run_id").alias("artifact"), rows.alias("d")).select("artifact", "d.*")


@query("audit_verdicts_m21_m22", f"""WITH {_DIM_SQL}
SELECT artifact, bool_and(coalesce(passed, false)) AS passed, count(*) FILTER (NOT coalesce(passed, false)) AS failed_dims, count(*) FILTER (evaluated) AS evaluated_dims,
 count(*) FILTER (na) AS na_dims, coalesce(string_agg(dim || ': ' || issue, '; ' ORDER BY dim), '') AS issues FROM dims GROUP BY 1""", ("runs",))
def _(v):
    return au.verdict(_dims(v))


@query("metric_failures_m22", """
SELECT run_id, coalesce(m IS NOT NULL AND m <= 310, false) AS passed, CASE WHEN m IS NULL THEN 'tac: metric missing' WHEN m > 310 THEN 'tac: over limit' END AS issue
FROM (SELECT run_id, CASE WHEN run_id % 9 = 0 THEN NULL ELSE 200 + run_id % 150 END AS m FROM runs)""", ("runs",))
def _(v):
    m = v.runs.select("run_id", F.expr("CASE WHEN run_id % 9 = 0 THEN NULL ELSE 200 + run_id % 150 END").alias("m"))
    ok, issue = au.metric_or_fail(F.col("m"), F.col("m") <= 310, "tac")
    return m.select("run_id", ok.alias("passed"), issue.alias("issue"))


@query("plate_compliance_x1", """
SELECT run_id, len(i) = 0 AS passed, plate AND has_manifest AS evaluated, NOT plate AS na, array_to_string(i, ',') AS issues FROM (SELECT *, list_filter([
 CASE WHEN plate AND has_manifest AND tac > 310 THEN 'tac_over_limit' END, CASE WHEN plate AND has_manifest AND NOT pure THEN 'impure' END,
 CASE WHEN plate AND has_manifest AND gen > 0 THEN 'generated_content' END], lambda s: s IS NOT NULL) AS i FROM (SELECT run_id, output_mode = 'plate' AS plate, run_id % 6 <> 0 AS has_manifest, 250 + run_id % 80 AS tac,
 run_id % 5 <> 0 AS pure, (run_id % 3) / 10e0 AS gen FROM runs))""", ("runs",))
def _(v):
    r = v.runs.select("run_id", F.expr("CASE WHEN output_mode = 'plate' THEN 'cmyk' ELSE 'rgb' END").alias("color_mode"),
                      F.expr("run_id % 6 <> 0").alias("has_manifest"), F.expr("250 + run_id % 80").alias("tac_max_pct"),
                      F.expr("run_id % 5 <> 0").alias("plate_purity_ok"), F.expr("(run_id % 3) / 10D").alias("generated_ratio"))
    return au.plate_compliance(r)


@query("effective_sources_p29", """
SELECT run_id AS artifact, CASE WHEN run_id % 4 = 0 THEN 'eff_' || run_id ELSE 'src_' || run_id END AS source_path, run_id % 4 = 0 AS source_effective FROM runs""", ("runs",))
def _(v):
    art = v.runs.select(F.col("run_id").alias("artifact"), F.concat(F.lit("src_"), "run_id").alias("source_path"))
    eff = v.runs.where("run_id % 4 = 0").select(F.col("run_id").alias("artifact"), F.concat(F.lit("eff_"), "run_id").alias("path"))
    return au.effective_source(art, eff)


@query("base_layers_p30", """
SELECT image_id, min_by(layer, (position, layer)) AS base_layer FROM (SELECT l_orderkey AS image_id, l_linenumber AS position, CASE l_suppkey % 5 WHEN 0 THEN '01_Base_Ground' WHEN 1 THEN 'Gold_Base' WHEN 2 THEN '底板_x' ELSE 'other' END AS layer FROM lineitem)
WHERE layer <> 'other' GROUP BY 1""")
def _(v):
    layers = v.lineitem.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("position"), F.expr(
        "CASE l_suppkey % 5 WHEN 0 THEN '01_Base_Ground' WHEN 1 THEN 'Gold_Base' WHEN 2 THEN '底板_x' ELSE 'other' END").alias("layer"))
    return au.base_layer(layers, rules.BASE_LAYER_WORDS)


_COMP = """comp AS (SELECT image_id, y, x, r AS r1, g AS g1, b AS b1, CAST(floor(r * 0.9e0) AS INT) AS r2, CAST(floor(g * 0.95e0 + 3) AS INT) AS g2, b AS b2 FROM pixels)"""


def _composite(v):
    return v.pixels.select("image_id", "y", "x", F.col("r").alias("r1"), F.col("g").alias("g1"), F.col("b").alias("b1"),
                           F.floor(F.col("r") * 0.9).cast("int").alias("r2"), F.floor(F.col("g") * 0.95 + 3).cast("int").alias("g2"), F.col("b").alias("b2"))


_PAIRS = [("r1", "r2"), ("g1", "g2"), ("b1", "b2")]


@query("composite_rmse_m16", f"""WITH {_COMP}
SELECT image_id, round(sqrt(avg((pow(r1 - r2, 2) + pow(g1 - g2, 2) + pow(b1 - b2, 2)) / 3)), 6) AS rmse_raw FROM comp GROUP BY 1""", ("pixels",))
def _(v):
    return au.rmse(_composite(v), _PAIRS, ["image_id"]).withColumn("rmse_raw", F.round("rmse_raw", 6))


@query("composite_mae_m18", f"""WITH {_COMP}
SELECT image_id, round(avg((abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2)) / 3e0), 6) AS mae, avg((abs(r1 - r2) + abs(g1 - g2) + abs(b1 - b2)) / 3e0) <= 6 AS passed FROM comp GROUP BY 1""", ("pixels",))
def _(v):
    return au.mean_abs_error(_composite(v), _PAIRS, ["image_id"], 6.0).withColumn("mae", F.round("mae", 6))


_REG = {"left": (0.05, 0.3, 0.15, 0.45), "mid": (0.4, 0.3, 0.55, 0.6)}


@query("base_dark_ratio_m14", """
WITH med AS (SELECT image_id, quantile_cont(gray, 0.5) AS med FROM pixels GROUP BY 1), d AS (SELECT *, CASE WHEN gray < med - 20 THEN 1e0 ELSE 0e0 END AS dark FROM pixels JOIN med USING (image_id) JOIN canvases USING (image_id))
SELECT image_id, round(avg(dark) * 100, 2) AS dark_ratio_all, round(avg(dark) FILTER (x >= floor(0.05e0 * w) AND x < floor(0.15e0 * w) AND y >= floor(0.3e0 * h) AND y < floor(0.45e0 * h)) * 100, 2) AS dark_left,
 round(avg(dark) FILTER (x >= floor(0.4e0 * w) AND x < floor(0.55e0 * w) AND y >= floor(0.3e0 * h) AND y < floor(0.6e0 * h)) * 100, 2) AS dark_mid FROM d GROUP BY 1""", ("pixels", "canvases"))
def _(v):
    return au.dark_ratio(v.pixels, v.canvases, _REG)


@query("cold_repeat_report_m28", """
WITH r AS (SELECT p_brand || '_' || p_type AS case_name, p_partkey % 2 AS ph, p_size % 9 AS sha, p_retailprice AS s, p_partkey % 3 <> 0 AS ok, p_partkey % 4 = 1 AS hit FROM part)
SELECT case_name, max(s) FILTER (ph = 0) AS cold_seconds, max(s) FILTER (ph = 1) AS repeat_seconds, bool_and(ok) FILTER (ph = 0) AS cold_audit, bool_and(ok) FILTER (ph = 1) AS repeat_audit,
 bool_or(hit) FILTER (ph = 1) AS repeat_hit, coalesce(max(sha) FILTER (ph = 0) = max(sha) FILTER (ph = 1), false) AS byte_reproducible FROM r GROUP BY 1""")
def _(v):
    r = v.part.select(F.concat("p_brand", F.lit("_"), "p_type").alias("case_name"), F.when(F.col("p_partkey") % 2 == 0, "cold").otherwise("repeat").alias("phase"),
                      (F.col("p_size") % 9).cast("string").alias("sha"), F.col("p_retailprice").alias("seconds"), (F.col("p_partkey") % 3 != 0).alias("audit_passed"),
                      F.when(F.col("p_partkey") % 4 == 1, "x reuse hit y").otherwise("none").alias("log"))
    return au.batch_report(r)


@query("corpus_coverage_m25", """
SELECT n_name AS family, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 15 THEN 'short' ELSE 'ok' END AS status FROM nation LEFT JOIN
 (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 3000 GROUP BY 1) USING (n_name)""")
def _(v):
    s = v.supplier.where("s_acctbal > 3000").join(v.nation, v.nation.n_nationkey == v.supplier.s_nationkey).select(F.col("n_name").alias("family"))
    return au.corpus_coverage(s, v.nation.select(F.col("n_name").alias("family")))


@query("classifier_report_m29", """
WITH p AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 30 THEN l_returnflag WHEN l_partkey % 2 = 0 THEN 'N' ELSE 'R' END AS pred FROM lineitem),
c AS (SELECT cls, CAST(sum(s) AS BIGINT) AS support, CAST(sum(q) AS BIGINT) AS predicted, CAST(sum(t) AS BIGINT) AS tp FROM (SELECT label AS cls, 1 AS s, 0 AS q, CASE WHEN label = pred THEN 1 ELSE 0 END AS t FROM p UNION ALL SELECT pred, 0, 1, 0 FROM p) GROUP BY 1)
SELECT cls, support, predicted, tp, round(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall,
 round(CASE WHEN predicted + support > 0 THEN 2.0e0 * tp / (predicted + support) ELSE 0 END, 6) AS f1 FROM c""")
def _(v):
    p = v.lineitem.select(F.col("l_returnflag").alias("label"), F.expr("CASE WHEN l_quantity < 30 THEN l_returnflag WHEN l_partkey % 2 = 0 THEN 'N' ELSE 'R' END").alias("pred"))
    return au.classifier_report(p)


# ---- feedback --------------------------------------------------------------

_ACTS = """acts AS (SELECT 'fb' || event_id AS feedback_request_id, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'ghost' ELSE event_type || user_id END AS category_id,
 CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'rename' WHEN 2 THEN 'delete' ELSE 'merge' END AS user_action FROM events)"""


def _acts(v):
    return v.events.select(F.concat(F.lit("fb"), "event_id").alias("feedback_request_id"), F.col("event_id").alias("seq"),
                           F.expr("CASE WHEN event_id % 9 = 0 THEN 'ghost' ELSE event_type || user_id END").alias("category_id"),
                           F.expr("CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'rename' WHEN 2 THEN 'delete' ELSE 'merge' END").alias("user_action"),
                           F.expr("CASE WHEN event_id % 8 = 1 THEN concat(' N', event_id, ' ') END").alias("new_name"),
                           F.expr("CASE WHEN event_id % 16 = 1 THEN 'En' END").alias("new_name_en"))


def _type_categories(v):
    return v.events.select(F.concat("event_type", "user_id").alias("id"), (F.col("event_type") == "view").alias("_old")).distinct().select(
        "id", F.col("id").alias("name_zh"), F.upper("id").alias("name_en"), F.concat(F.lit("NN_"), "id").alias("name_template"),
        F.when(F.col("_old"), F.lit(1700000000).cast("long")).alias("deleted_at"))


def _fine_prompts(v):
    return v.detections.where("prompt <> ''").join(v.events.select(F.col("event_id").alias("seq"), "event_type"), "seq").groupBy(
        F.concat("event_type", "episode_id").alias("category_id"), "prompt").agg(F.lit(1.0).alias("weight"), F.lit(0).alias("n_accept"))


_TYPES = """cats AS (SELECT DISTINCT event_type || user_id AS id, upper(event_type || user_id) AS name_en, 'NN_' || event_type || user_id AS name_template, CASE WHEN event_type = 'view' THEN CAST(1700000000 AS BIGINT) END AS deleted_at FROM events)"""
_FINE = """fine AS (SELECT DISTINCT event_type || episode_id AS category_id, prompt FROM detections JOIN events ON event_id = seq WHERE prompt <> '')"""


@query("feedback_accept_results_f1", f"""WITH {_ACTS}, {_TYPES}, {_FINE}, n AS (SELECT category_id, count(*) AS n FROM fine GROUP BY 1)
SELECT a.feedback_request_id, a.category_id, CASE WHEN c.id IS NULL THEN 'no_category' WHEN n.n IS NULL THEN 'no_prompt' ELSE 'ok' END AS status, CASE WHEN c.id IS NOT NULL THEN coalesce(n.n, 0) ELSE 0 END AS affected
FROM acts a LEFT JOIN (SELECT * FROM cats WHERE deleted_at IS NULL) c ON c.id = a.category_id LEFT JOIN n ON n.category_id = a.category_id WHERE user_action = 'accept'""", ("detections",))
def _(v):
    return fb.accept(fb.first_actions(_acts(v)), _type_categories(v), _fine_prompts(v))[1]


@query("feedback_accept_weights_f1", f"""WITH {_ACTS}, {_TYPES}, {_FINE}, t AS (SELECT category_id, count(*) AS t FROM acts JOIN cats ON id = category_id WHERE user_action = 'accept' AND deleted_at IS NULL GROUP BY 1)
SELECT p.category_id, p.prompt, round(pow(1.1e0, coalesce(t.t, 0)), 6) AS weight, CAST(coalesce(t.t, 0) AS BIGINT) AS n_accept FROM fine p LEFT JOIN t USING (category_id)""", ("detections",))
def _(v):
    raised, _res = fb.accept(_acts(v), _type_categories(v), _fine_prompts(v))
    return raised.select("category_id", "prompt", F.round("weight", 6).alias("weight"), F.col("n_accept").cast("long").alias("n_accept"))


@query("feedback_rename_f2_c24", f"""WITH {_ACTS}, {_TYPES}, r AS (SELECT category_id, max_by(seq, seq) AS seq FROM acts WHERE user_action = 'rename' AND seq % 8 = 1 GROUP BY 1)
SELECT c.id, CASE WHEN r.seq IS NULL THEN c.id ELSE 'N' || r.seq END AS name_zh, CASE WHEN r.seq % 16 = 1 THEN 'En' ELSE c.name_en END AS name_en,
 CASE WHEN r.seq IS NULL THEN c.name_template ELSE 'NN_N' || r.seq || '_' || CASE WHEN r.seq % 16 = 1 THEN 'En' ELSE c.name_en END END AS name_template FROM cats c LEFT JOIN r ON r.category_id = c.id""")
def _(v):
    return fb.rename(_acts(v), _type_categories(v), 1800000000).select("id", "name_zh", "name_en", "name_template")


@query("feedback_delete_f3", f"""WITH {_ACTS}, {_TYPES} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM acts WHERE user_action = 'delete' AND category_id = id) THEN 1800000000 ELSE deleted_at END AS deleted_at FROM cats""")
def _(v):
    return fb.soft_delete(_acts(v), _type_categories(v), 1800000000).select("id", "deleted_at")


_MERGE_P = "mp AS (SELECT 's' || (CAST(substr(prompt, 2) AS INT) % 60) AS category_id, 'w' || (CAST(substr(prompt, 2) AS INT) % 7) AS prompt, max(weight) AS weight FROM prompts GROUP BY 1, 2)"
_MERGE_OK = """pr AS (SELECT 's' || s_suppkey AS source, 's' || (s_suppkey % 10) AS target FROM supplier),
ok AS (SELECT source, min(target) AS target FROM pr WHERE source <> target GROUP BY 1)"""


def _merge_inputs(v):
    n = F.expr("CAST(substr(prompt, 2) AS INT)")
    mp = v.prompts.groupBy(F.concat(F.lit("s"), n % 60).alias("category_id"), F.concat(F.lit("w"), n % 7).alias("p")).agg(
        F.max("weight").alias("weight")).withColumnRenamed("p", "prompt")
    pairs = v.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("s"), F.col("s_suppkey") % 10).alias("target"))
    return pairs, v.categories, mp


@query("feedback_merge_prompts_f4", f"""WITH {_MERGE_P}, {_MERGE_OK}
SELECT coalesce(ok.target, mp.category_id) AS category_id, prompt, max(weight) AS weight FROM mp LEFT JOIN ok ON ok.source = mp.category_id GROUP BY 1, 2""", ("prompts",))
def _(v):
    return fb.merge(*_merge_inputs(v), 1800000000)[0]


@query("feedback_merge_counts_f4", f"""WITH {_MERGE_P}, {_MERGE_OK}
SELECT source, target, count(*) FILTER (t.weight IS NULL) AS migrated, count(*) FILTER (s.weight > t.weight) AS merged, count(*) FILTER (s.weight <= t.weight) AS kept
FROM ok JOIN mp s ON s.category_id = ok.source LEFT JOIN mp t ON t.category_id = ok.target AND t.prompt = s.prompt GROUP BY 1, 2""", ("prompts",))
def _(v):
    return fb.merge(*_merge_inputs(v), 1800000000)[2]


@query("feedback_versions_f5", f"""WITH {_ACTS} SELECT 'v' || feedback_request_id AS version_id, 'human_feedback:' || user_action || ':' || category_id AS changeset, 'pending' AS regression_status, CAST(1800000000 AS BIGINT) AS created_at
FROM acts WHERE category_id <> 'ghost'""")
def _(v):
    res = _acts(v).withColumn("status", F.when(F.col("category_id") == "ghost", "no_category").otherwise("ok"))
    return fb.version_nodes(res, 1800000000)


@query("feedback_apply_once_f6", f"""WITH {_ACTS} SELECT feedback_request_id, user_action FROM acts WHERE seq % 6 <> 0""")
def _(v):
    acts = _acts(v)
    twice = acts.unionByName(acts.withColumn("seq", F.col("seq") + 1000000))
    return fb.first_actions(twice, acts.where("seq % 6 = 0").select("feedback_request_id")).select("feedback_request_id", "user_action")


@query("pending_feedback_s8", """
SELECT event_id AS seq, 'fb' || event_id AS feedback_request_id FROM events WHERE event_type = 'click' AND value >= 15 ORDER BY event_id LIMIT 20""")
def _(v):
    req = v.events.where("event_type = 'click'").select(F.col("event_id").alias("seq"), F.concat(F.lit("fb"), "event_id").alias("feedback_request_id"))
    rev = v.events.where("value < 15").select(F.concat(F.lit("fb"), "event_id").alias("feedback_request_id"))
    return fb.pending_requests(req, rev, 20).select("seq", "feedback_request_id")


@query("feedback_ids_s4_c27", """
SELECT event_id, 'fb_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(sha1('task' || user_id), 1, 6) AS feedback_request_id,
 'ep_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substr(sha1(user_id || '|' || event_type || '|' || event_id), 1, 12) AS episode_id FROM events""")
def _(v):
    return v.events.select("event_id", fb.feedback_id(F.col("ts"), F.concat(F.lit("task"), "user_id")).alias("feedback_request_id"),
                           logs.episode_id(F.col("ts"), "user_id", "event_type", "event_id").alias("episode_id"))


@query("file_hash_equality_c27", """
SELECT doc_id, sha256(text) AS sha, sha256(text) = sha256(text || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END) AS same FROM documents""")
def _(v):
    other = F.concat("text", F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'x' END"))
    return v.documents.select("doc_id", F.sha2("text", 256).alias("sha"), (F.sha2("text", 256) == F.sha2(other, 256)).alias("same"))


@query("merged_bands_c29", """
WITH e AS (SELECT p_brand AS preset, p_type AS name, max(p_size) / 100e0 AS density_min, max(p_size) / 50e0 AS density_max FROM part WHERE p_size < 35 GROUP BY 1, 2),
s AS (SELECT p_brand AS preset, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'band_' || p_size END AS name, min(p_size) / 90e0 AS lo, min(p_size) / 45e0 AS hi FROM part WHERE p_size > 40 GROUP BY 1, 2)
SELECT preset, name, round(CASE WHEN s.lo IS NOT NULL THEN s.lo ELSE density_min END, 6) AS density_min, round(CASE WHEN s.lo IS NOT NULL THEN s.hi ELSE density_max END, 6) AS density_max, s.lo IS NOT NULL AS updated
FROM e FULL JOIN s USING (preset, name)""")
def _(v):
    e = v.part.where("p_size < 35").groupBy(F.col("p_brand").alias("preset"), F.col("p_type").alias("name")).agg(
        (F.max("p_size") / 100).alias("density_min"), (F.max("p_size") / 50).alias("density_max"))
    label = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lit("band_"), "p_size"))
    s = v.part.where("p_size > 40").groupBy(F.col("p_brand").alias("preset"), label.alias("label")).agg(
        (F.min("p_size") / 90).alias("density_min"), (F.min("p_size") / 45).alias("density_max"))
    out = fb.merge_bands(e, s)
    return out.withColumn("density_min", F.round("density_min", 6)).withColumn("density_max", F.round("density_max", 6))


@query("applied_tuning_c28", """
SELECT p_partkey, p_name AS name, coalesce(r.region, 'own_' || p_size) AS region, r.region IS NOT NULL AS applied FROM part
LEFT JOIN (SELECT p_name AS n, 'tuned_' || max(p_size) AS region FROM part WHERE p_size > 46 GROUP BY 1) r ON r.n = p_name""")
def _(v):
    cls = v.part.select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit("own_"), "p_size").alias("region"))
    saved = v.part.where("p_size > 46").groupBy(F.col("p_name").alias("name")).agg(F.concat(F.lit("tuned_"), F.max("p_size")).alias("region"))
    return fb.apply_tuning(cls, saved)


# ---- logs and sources ------------------------------------------------------

@query("newest_episodes_s1", """
SELECT event_id AS seq, event_type AS material_family FROM events WHERE event_type = 'click' AND event_id % 17 <> 0 ORDER BY event_id DESC LIMIT 1000""")
def _(v):
    lines = v.events.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.concat(F.lit("ep"), "event_id").alias("episode_id"), F.col("event_type").alias("material_family"), F.col("value").alias("extra")))).alias("line"))
    return logs.newest(logs.parse_episode_lines(lines), 1000, "click").select("seq", "material_family")


@query("corrupt_episode_lines_s1", "SELECT event_id AS seq FROM events WHERE event_id % 17 = 0")
def _(v):
    lines = v.events.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(
        F.to_json(F.struct(F.concat(F.lit("ep"), "event_id").alias("episode_id")))).alias("line"))
    return logs.corrupt_lines(lines).select("seq")


@query("preferred_episode_source_s3", """
SELECT user_id AS episode_id, min_by(event_id, (CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id)) AS seq FROM events GROUP BY 1""")
def _(v):
    e = v.events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("priority"))
    return logs.preferred(e, "episode_id").select("episode_id", "seq")


@query("unknown_samples_page_s10", """
SELECT event_id AS seq, event_type, (SELECT count(*) FROM events WHERE value < 5) AS total FROM events WHERE value < 5 ORDER BY event_id DESC LIMIT 25""")
def _(v):
    q = v.events.where("value < 5").select(F.col("event_id").alias("seq"), "event_type")
    return logs.page_with_total(q, 25)


@query("history_page_s11", """
SELECT o_orderkey AS seq, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40""")
def _(v):
    return logs.page_with_total(v.orders.select(F.col("o_orderkey").alias("seq")), 20, 40)


@query("manifest_preference_s13_s16", """
SELECT l_orderkey AS run_id, min_by('result.' || CASE l_linenumber % 3 WHEN 0 THEN 'plate.' WHEN 1 THEN 'design.' ELSE '' END || 'manifest.json', l_linenumber % 3) AS file_name FROM lineitem GROUP BY 1""")
def _(v):
    files = v.lineitem.select(F.col("l_orderkey").alias("run_id"), F.expr("concat('result.', CASE l_linenumber % 3 WHEN 0 THEN 'plate.' WHEN 1 THEN 'design.' ELSE '' END, 'manifest.json')").alias("file_name"))
    return logs.preferred_manifest(files, "run_id")


@query("task_status_listing_t7", """
SELECT user_id AS episode_id, status, seq FROM (SELECT user_id, max_by(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1) WHERE status = 'error' ORDER BY seq DESC LIMIT 20""")
def _(v):
    log = v.events.select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return logs.status_listing(ep.last_by_id(log), "error", 20).select("episode_id", "status", "seq")


@query("artifact_episode_pairs_j17", """
WITH l AS (SELECT user_id AS task_id, event_id AS seq, 'ep' || event_id AS eid FROM events WHERE event_type IN ('error', 'click')),
f AS (SELECT task_id, min_by(eid, seq) AS first_id, max_by(eid, seq) AS last_id, count(*) AS n_ids FROM l GROUP BY 1),
s AS (SELECT task_id, eid AS second_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS rn FROM l) WHERE rn = 2),
a AS (SELECT user_id AS task_id, event_id AS artifact, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n_arts, CASE WHEN event_id % 3 = 0 THEN 'design' ELSE 'plate' END AS line, user_id % 2 = 0 AS both_mode FROM events WHERE value < 20)
SELECT task_id, artifact, CASE WHEN both_mode AND n_arts = 2 AND n_ids >= 2 THEN CASE pos WHEN 1 THEN first_id ELSE second_id END WHEN line = 'design' THEN last_id ELSE first_id END AS episode_id
FROM a JOIN f USING (task_id) LEFT JOIN s USING (task_id)""")
def _(v):
    lines = v.events.where("event_type IN ('error', 'click')").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"),
                                                                      F.concat(F.lit("episode 已归档: ep"), "event_id").alias("message"))
    noise = v.events.where("event_type = 'view'").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.lit("step done").alias("message"))
    arts = v.events.where("value < 20").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("artifact"), F.col("event_id").alias("seq"),
                                               F.when(F.col("event_id") % 3 == 0, "design").otherwise("plate").alias("output_mode"), (F.col("user_id") % 2 == 0).alias("both_mode"))
    return logs.pair_artifacts(arts, lines.unionByName(noise)).select("task_id", "artifact", "episode_id")


@query("json_key_sets_c25", """
SELECT event_id, array_to_string(list_sort(json_keys(j)), ',') AS keys, TRY_CAST(json_extract_string(j, '$.k') AS INT) AS k FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_merge_patch(props, '{"bands": [], "a": {"b": 1}}') ELSE props END AS j FROM events)""")
def _(v):
    j = F.when(F.col("event_id") % 2 == 0, F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "bands": [], "a": {"b": 1}}'))).otherwise(F.col("props"))
    e = v.events.select("event_id", j.alias("j"))
    return e.select("event_id", F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("keys"),
                    F.try_variant_get(F.parse_json("j"), "$.k", "int").alias("k"))
