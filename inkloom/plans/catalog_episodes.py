"""Registered queries over episodes, detections and the similarity index."""

from pyspark.sql import functions as F

from ..operators import episodes as ep
from ..operators import similarity as sim
from .registry import query

_CENTROIDS = """WITH c AS (SELECT family, list(m ORDER BY d) AS centroid FROM (SELECT family, d, avg(CAST(x AS DOUBLE)) AS m FROM
 (SELECT label AS family, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
_SIM = "list_dot_product(c.centroid, CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(c.centroid, c.centroid)) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))"


@query("similar_episodes_j7", f"""{_CENTROIDS}
SELECT family, task_id, round(s, 6) AS similarity, rank FROM (
 SELECT c.family, e.vec_id AS task_id, {_SIM} AS s,
  CAST(row_number() OVER (PARTITION BY c.family ORDER BY {_SIM} DESC, e.vec_id) AS INT) AS rank
 FROM c, embeddings e WHERE e.label % 2 = 0 AND {_SIM} >= 0.1) WHERE rank <= 5""")
def _(v):
    index = v.episode_index
    out = sim.top_similar(sim.family_centroids(index), index, query_id="family", query_vec="centroid", min_similarity=0.1)
    return out.select(F.col("family").cast("int"), "task_id", F.round("similarity", 6).alias("similarity"), "rank")


_SELF = "round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(e.v, e.v)), 12)"


@query("every_similar_episode_j7", f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, e.vec_id AS task_id, {_SELF} AS s FROM e q, e WHERE e.label % 2 = 0 AND {_SELF} >= 0.2)
SELECT query, task_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, task_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def _(v):
    built = sim.build_index(v.episode_index.where("audit_passed"), pivots=16)
    out = sim.search(v.embeddings.select(F.col("vec_id").alias("query"), "embedding"), built, query_id="query", query_vec="embedding", min_similarity=0.2)
    return out.select("query", "task_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("similarity_hit_message_p28", f"""{_CENTROIDS}
SELECT family, 'reuse ' || task_id || ' (similarity ' || printf('%.2f', s) || ')' AS message FROM (
 SELECT c.family, e.vec_id AS task_id, {_SIM} AS s, row_number() OVER (PARTITION BY c.family ORDER BY {_SIM} DESC, e.vec_id) AS rank
 FROM c, embeddings e) WHERE rank = 1""")
def _(v):
    index = v.episode_index
    out = sim.top_similar(sim.family_centroids(index), index, query_id="family", query_vec="centroid",
                          min_similarity=-1.0, top_k=1, only_audited=False)
    return out.select(F.col("family").cast("int"), sim.hit_message("similarity", "task_id").alias("message"))


@query("reuse_whitelist_j11", """
SELECT episode_id, CASE WHEN preset <> 'preset1' THEN 'preset:' || preset WHEN output_mode <> 'plate' THEN 'line:' || output_mode
 WHEN k1 % 3 = 0 THEN 'schema:empty' WHEN k1 % 3 = 1 THEN 'schema:bands' END AS reason FROM episodes""", ("episodes",))
def _(v):
    keys = F.when(F.col("k1") % 3 == 0, F.array().cast("array<string>")).when(F.col("k1") % 3 == 1, F.array(F.lit("bands"))) \
        .otherwise(F.array(F.lit("regions"), F.lit("bands")))
    e = v.episodes.withColumn("tune_keys", keys)
    return e.select("episode_id", sim.reuse_block_reason("preset1", "plate", ["bands", "regions"]).alias("reason"))


_SIGNAL = """CASE WHEN NOT coalesce(quality_gate_passed, false) THEN 'quality_reject'
 WHEN NOT coalesce(diffuse_gate_passed, false) THEN 'diffuse_reject' ELSE 'accept' END"""
_CAT = "coalesce(nullif(category_id, ''), nullif(layer_name, ''), 'unknown')"
_ATTR = f"""attr AS (SELECT episode_id, seq, {_CAT} AS category_id, prompt, {_SIGNAL} AS signal,
 CASE {_SIGNAL} WHEN 'accept' THEN '' WHEN 'quality_reject' THEN coalesce(nullif(quality_gate_reason, ''),
  CASE WHEN quality_gate_passed IS NULL THEN '质量门缺字段(未评估)' ELSE '质量门未通过' END)
 ELSE coalesce(nullif(diffuse_gate_reason, ''), CASE WHEN diffuse_gate_passed IS NULL THEN '弥散门缺字段(未评估)' ELSE '弥散门未通过' END) END AS reason
 FROM detections WHERE prompt <> '')"""


@query("gate_attributions_p7_p8", f"WITH {_ATTR} SELECT * FROM attr", ("detections",))
def _(v):
    return ep.attributions(v.detections)


@query("signal_counts_m3", f"""WITH {_ATTR}
SELECT category_id, prompt, CAST(grouping(prompt) AS INT) AS level, count(*) FILTER (signal = 'accept') AS n_accept,
 count(*) FILTER (signal = 'quality_reject') AS n_quality_reject, count(*) FILTER (signal = 'diffuse_reject') AS n_diffuse_reject
FROM attr GROUP BY GROUPING SETS ((category_id, prompt), (category_id))""", ("detections",))
def _(v):
    return ep.signal_counts(ep.attributions(v.detections)).withColumn("level", F.col("level").cast("int"))


@query("uncertain_detections_p6", f"""
SELECT episode_id, seq, coalesce(nullif(category_id, ''), nullif(layer_name, '')) AS category_id,
 round(coalesce(confidence, list_max(logits), 0), 6) AS confidence, round(list_max(logits), 6) AS logit
FROM detections WHERE coalesce(confidence, list_max(logits), 0) < 0.7""", ("detections",))
def _(v):
    return ep.uncertain_detections(v.detections).select("episode_id", "seq", "category_id",
                                                        F.round("confidence", 6).alias("confidence"), F.round("logit", 6).alias("logit"))


_UPD = f"""{_ATTR}, per AS (SELECT episode_id, category_id, prompt, count(*) FILTER (signal = 'accept') AS n_accept,
  count(*) FILTER (signal <> 'accept') AS n_reject, min(seq) AS seq FROM attr GROUP BY 1, 2, 3),
 known AS (SELECT category_id, prompt, max(weight) AS old_weight FROM prompts WHERE source <> 'shadow' GROUP BY 1, 2),
 upd AS (SELECT per.*, old_weight, greatest(0.05e0, least(5e0, old_weight * CASE WHEN n_reject > 0 THEN pow(0.8e0, n_reject) ELSE pow(1.1e0, n_accept) END)) AS new_weight,
  CASE WHEN old_weight IS NULL THEN 'unknown' WHEN n_reject > 0 THEN 'reject' ELSE 'accept' END AS signal
  FROM per LEFT JOIN known USING (category_id, prompt))"""


@query("weight_updates_c19", f"""WITH {_UPD}
SELECT episode_id, category_id, prompt, n_accept, n_reject, old_weight,
 CASE WHEN old_weight IS NOT NULL THEN round(new_weight, 6) END AS new_weight, signal FROM upd""", ("detections", "prompts"))
def _(v):
    out = ep.weight_updates(ep.attributions(v.detections), v.prompts).drop("seq")
    return out.withColumn("new_weight", F.round("new_weight", 6))


@query("learned_weight_fold_c20", f"""WITH {_UPD}
SELECT category_id, prompt, max(old_weight) AS old_weight,
 round(list_reduce(list_prepend(max(old_weight), list(CASE WHEN old_weight > 0 THEN new_weight / old_weight ELSE 1e0 END ORDER BY seq, CAST(episode_id AS VARCHAR))), lambda acc, r: greatest(0.05e0, least(5e0, acc * r))), 6) AS new_weight,
 count(*) FILTER (signal = 'accept') AS n_accept, count(*) FILTER (signal = 'reject') AS n_reject
FROM upd WHERE old_weight IS NOT NULL GROUP BY 1, 2""", ("detections", "prompts"))
def _(v):
    upd = ep.weight_updates(ep.attributions(v.detections), v.prompts)
    return ep.fold_updates(upd).withColumn("new_weight", F.round("new_weight", 6))


def _dims(v):
    """Dimension map of each projected episode; some keys missing, some not evaluated."""
    entries = [F.when((F.col("k1") + i * 37) % 41 != 0, F.struct(F.lit(k).alias("key"), F.struct(
        ((F.col("k1") * (i + 3)) % 31 != 0).alias("passed"), ((F.col("k2") + i * 11) % 37 != 0).alias("evaluated"),
        ((F.col("k2") + i) % 43 == 0).alias("na")).alias("value"))) for i, k in enumerate(ep.DIM_KEYS)]
    dims = F.map_from_entries(F.array_compact(F.array(*entries)))
    return v.episodes.withColumn("dims", F.when(F.col("has_report"), dims))


def _admit_sql():
    arms = []
    for i, k in enumerate(ep.DIM_KEYS):
        guard = "output_mode <> 'design' AND " if k == ep.PLATE_DIM else ""
        arms.append(f"WHEN {guard}(k1 + {i * 37}) % 41 = 0 THEN 'missing_dim:{k}'")
        arms.append(f"WHEN {guard}((k2 + {i}) % 43 = 0 OR (k2 + {i * 11}) % 37 = 0) THEN 'not_evaluated:{k}'")
        arms.append(f"WHEN {guard}(k1 * {i + 3}) % 31 = 0 THEN 'failed:{k}'")
    return "CASE WHEN NOT has_report THEN 'no_full_report' " + " ".join(arms) + " ELSE 'ok' END"


@query("admission_p4", f"SELECT episode_id, {_admit_sql()} AS reason, {_admit_sql()} = 'ok' AS admitted FROM episodes", ("episodes",))
def _(v):
    reason = ep.admission_reason(F.col("dims"), F.col("output_mode"))
    return _dims(v).select("episode_id", reason.alias("reason")).withColumn("admitted", F.col("reason") == "ok")


@query("admission_reason_text_p5", f"""
SELECT text, count(*) AS n FROM (SELECT CASE WHEN r = 'no_full_report' THEN '审计报告缺少完整 8 维 ''dims''（旧式/不完整报告，已拒绝收口）'
 WHEN r LIKE 'missing_dim:%' THEN '缺必需审计维度：' || split_part(r, ':', 2)
 WHEN r LIKE 'not_evaluated:%' THEN '必需维度未真正核验：' || split_part(r, ':', 2)
 WHEN r LIKE 'failed:%' THEN '必需维度未通过：' || split_part(r, ':', 2) ELSE r END AS text FROM (SELECT {_admit_sql()} AS r FROM episodes)) GROUP BY 1""", ("episodes",))
def _(v):
    reason = ep.admission_reason(F.col("dims"), F.col("output_mode"))
    return _dims(v).select(reason.alias("reason")).groupBy(ep.describe_reason(F.col("reason")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


def _metrics(v):
    m = F.expr("""map('④ 内容承载', CASE WHEN k1 % 5 = 0 THEN map() ELSE map('lost_ratio', CAST(k1 / 100000D AS STRING)) END,
      '⑤ 合成等价性', map('rmse_raw', CAST(k2 % 97 / 8D AS STRING), 'rmse_lowfreq', CAST(k2 % 53 / 16D AS STRING)),
      '① 层属性', map('layer_count', CAST(k1 % 40 AS STRING)))""")
    plate = F.expr("map('⑦ plate 合规', map('tac_max_pct', CAST(200 + k2 % 128 AS STRING), 'plate_purity_ok', CAST(k1 % 3 <> 0 AS STRING)))")
    return v.episodes.withColumn("metrics", F.when(F.col("output_mode") == "plate", F.map_concat(m, plate)).otherwise(m)) \
        .withColumn("passed", F.col("has_report"))


@query("audit_summary_p2", """
SELECT episode_id, CASE WHEN k1 % 5 <> 0 THEN k1 / 100000e0 END AS lost_ratio, k2 % 53 / 16e0 AS rmse_lowfreq, k2 % 97 / 8e0 AS rmse_raw,
 CASE WHEN output_mode = 'plate' THEN k1 % 3 <> 0 END AS plate_purity_ok, CASE WHEN output_mode = 'plate' THEN CAST(200 + k2 % 128 AS DOUBLE) END AS tac_max_pct,
 CAST(k1 % 40 AS INT) AS n_layers, has_report AS passed FROM episodes""", ("episodes",))
def _(v):
    return _metrics(v).select("episode_id", *ep.audit_summary(F.col("metrics"), F.col("passed")))


@query("regression_metrics_p3", """
SELECT episode_id, CASE WHEN k1 % 5 <> 0 THEN k1 / 100000e0 ELSE 0e0 END AS lost_ratio, k2 % 53 / 16e0 AS rmse_lowfreq, k2 % 97 / 8e0 AS rmse_raw,
 CASE WHEN output_mode = 'plate' THEN k1 % 3 <> 0 ELSE true END AS plate_purity_ok, CASE WHEN output_mode = 'plate' THEN CAST(200 + k2 % 128 AS DOUBLE) ELSE 0e0 END AS tac_max_pct,
 CAST(k1 % 40 AS INT) AS n_layers, has_report AS passed FROM episodes""", ("episodes",))
def _(v):
    return _metrics(v).select("episode_id", *ep.regression_metrics(F.col("metrics"), F.col("passed")))


@query("patched_episodes_s5_s6", """
SELECT episode_id, CASE WHEN k1 % 2 = 0 THEN 'patched' ELSE preset END AS preset,
 CASE WHEN k1 % 4 = 0 THEN 'both' ELSE output_mode END AS output_mode FROM episodes""", ("episodes",))
def _(v):
    base = v.episodes.select("episode_id", "preset", "output_mode")
    patch = v.episodes.where("k1 % 2 = 0").select("episode_id", F.lit("patched").alias("preset"),
                                                   F.when(F.col("k1") % 4 == 0, "both").alias("output_mode"))
    return ep.patch_records(base, patch, "episode_id")


@query("first_record_by_id_s2", """
SELECT user_id, min_by(event_id, event_id) AS seq, min_by(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def _(v):
    log = v.events.select("user_id", F.col("event_id").alias("seq"), "event_type")
    return ep.first_by_id(log, "user_id")


@query("last_status_by_id_s9", """
SELECT user_id, max(event_id) AS seq, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def _(v):
    log = v.events.select("user_id", F.col("event_id").alias("seq"), "event_type")
    return ep.last_by_id(log, "user_id")


@query("task_months_c26", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE strftime(ts, '%Y-%m') END AS month FROM events""")
def _(v):
    tid = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("job_"), "event_id")).otherwise(
        F.concat(F.lit("task_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_x")))
    return v.events.select("event_id", ep.month_of_task(tid).alias("month"))
