from pyspark.sql import functions as F

from inkloom.operators import audit as au
from inkloom.operators import feedback as fb
from inkloom.operators import manifests as mf
from inkloom.operators import masks as mk
from inkloom.operators import rules


def family(spark, L, a, b, sat, edge, glcm=0.3, ent=None):
    df = spark.createDataFrame([(L, a, b, sat, edge, glcm, ent)], "L double, a double, b double, s double, e double, g double, n double")
    fam, conf = rules.classify_family(rules.family_scores(*[F.col(c) for c in ("L", "a", "b", "s", "e", "g", "n")]))
    return df.select(fam.alias("f"), conf.alias("c")).first()


def test_material_literals(spark):
    gold = family(spark, 79.2, 5.0, 38.0, 34.9, 0.069)
    assert gold.f == "金地屏风" and gold.c >= 0.9
    assert family(spark, 52.2, 7.0, 27.0, 28.1, 0.241, 0.159).f == "油画布"
    for L, a, b, s, e, n, t in ((45.9, 2.0, 7.0, 7.1, 0.133, 2.47, 0.15), (69.0, 1.0, 9.0, 10.7, 0.385, 2.18, 0.15), (84.3, 0.0, 5.0, 7.0, 0.098, 2.46, 0.3)):
        r = family(spark, L, a, b, s, e, glcm=t, ent=n)
        assert r.f == "织物壁布" and r.c >= 0.7
    assert family(spark, 69.0, 1.0, 9.0, 10.7, 0.385, ent=0.1).f != "织物壁布"


def test_diffuse_gate(spark):
    rows = [(0, "scatter", 0, 0), (0, "scatter", 8, 8), (0, "block", 1, 1), (0, "block", 2, 2), (0, "10_frame", 0, 0), (0, "10_frame", 9, 9)]
    m = spark.createDataFrame(rows, "image_id int, layer string, y int, x int")
    c = spark.createDataFrame([(0, 10, 10)], "image_id int, h int, w int")
    got = {r.layer: r.diffuse_reason for r in mk.gate(m, m.limit(0), c).collect()}
    assert got == {"scatter": "diffuse", "block": None, "10_frame": None}


def test_manifest_literals(spark):
    run = spark.createDataFrame([(1, "plate", 4000, 1952, 16000, 7808, 150.0, False)],
                                "run_id int, output_mode string, src_w int, src_h int, out_w int, out_h int, ppi double, generative_stage boolean")
    f = mf.size_facts(run).first()
    assert (f.effective_ppi, f.physical_width_mm, f.upscale_factor_x, f.max_upscale_factor, f.grade) == (37.5, 2709.3, 4.0, 4.0, "HEAVY")
    schema = "run_id int, name string, generated boolean, filled boolean, lft int, top int, rgt int, btm int, recon_ratio double, recon_pixels long"
    layer = spark.createDataFrame([(1, "a", True, False, 0, 0, 16000, 7808, 0.5, 1)], schema)
    assert mf.area_shares(layer, run).first().generated_ratio == 0.5
    assert mf.plate_purity(layer, run).first().plate_purity_ok is False
    assert mf.plate_purity(layer.withColumn("generated", F.lit(False)), run.withColumn("generative_stage", F.lit(True))).first().message == "generative_stage"
    assert mf.plate_purity(layer.withColumn("generated", F.lit(False)), run).first().message == "pure"
    assert mf.plate_purity(layer, run.withColumn("output_mode", F.lit("design"))).first().plate_purity_ok is True


def test_replayed_baseline_has_no_issue(spark):
    rows = [("golden_screen", 0.000018, 3.35, 1.99, 43), ("golden_ink_song", 0.000114, 6.74, 2.53, 9), ("golden_oil", 0.000418, 6.99, 3.04, 8),
            ("golden_commercial", 0.000006, 4.58, 1.67, 12), ("golden_silk", 0.0, 5.63, 1.86, 7)]
    base = spark.createDataFrame(rows, "task_id string, lost_ratio double, rmse_raw double, rmse_lowfreq double, n_layers int") \
        .withColumn("tac_max_pct", F.lit(0.0)).withColumn("plate_purity_ok", F.lit(True)).withColumn("passed", F.lit(True))
    assert au.regressions(base, base).where("n_issues > 0").count() == 0
    worse = base.withColumn("tac_max_pct", F.lit(0.1)).withColumn("passed", F.lit(False))
    assert {r.issues for r in au.regressions(worse, base).collect()} == {"tac_max_pct,passed"}
    assert au.tasks_without_baseline(base, base.where("task_id <> 'golden_oil'")).first().task_id == "golden_oil"


def test_merge_moves_prompts_and_deletes_the_source(spark):
    cats = spark.createDataFrame([("a",), ("b",)], "id string").withColumn("deleted_at", F.lit(None).cast("long"))
    prompts = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("a", "z", 0.5), ("b", "x", 1.0), ("b", "z", 0.9)], "category_id string, prompt string, weight double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "ghost"), ("b", "b")], "source string, target string")
    out, new, counts = fb.merge(pairs, cats, prompts, 7)
    assert {(r.category_id, r.prompt, r.weight) for r in out.collect()} == {("b", "x", 2.0), ("b", "y", 1.0), ("b", "z", 0.9)}
    assert {r.id: r.deleted_at for r in new.collect()} == {"a": 7, "b": None}
    c = counts.first()
    assert (c.migrated, c.merged, c.kept) == (1, 1, 1)


def test_chained_merges_end_where_the_requests_lead(spark):
    cats = spark.createDataFrame([(c,) for c in "abcdez"], "id string").withColumn("deleted_at", F.lit(None).cast("long"))
    prompts = spark.createDataFrame([("a", "x", 2.0), ("b", "y", 1.0), ("d", "v", 3.0), ("e", "u", 1.0)], "category_id string, prompt string, weight double")
    pairs = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("d", "z", 3), ("d", "e", 4), ("c", "e", 5), ("e", "a", 0)], "source string, target string, seq long")
    out, _, counts = fb.merge(pairs, cats, prompts, 7)
    assert {(r.category_id, r.prompt, r.weight) for r in out.collect()} == {("e", "x", 2.0), ("e", "y", 1.0), ("z", "v", 3.0), ("e", "u", 1.0)}
    assert {(r.source, r.target) for r in counts.collect()} == {("a", "b"), ("b", "c"), ("d", "z"), ("e", "a")}


def test_unmatched_uploads_never_look_sure(spark):
    df = spark.createDataFrame([(None, None, 2000, 1000), ("其他", 0.3, 1000, 1000), ("油画布", 0.8, 10, 10), ("绢本工笔", 0.9, 1, 1)], "f string, c double, w int, h int")
    rec = rules.recommend_preset(F.col("f"), F.col("c"), F.lit(True), F.col("w"), F.col("h"))
    rows = df.select(*[c.alias(n) for n, c in rec.items()]).collect()
    assert [(r.preset, r.confidence, r.reason) for r in rows] == [("japanese_screen_gold", 0.55, "aspect"), ("textile_damask", 0.55, "material_low_conf"),
                                                                 ("western_oil_painting", 0.8, "material"), ("textile_damask_photo", 0.85, "panel")]


def test_manifest_names_meet_in_one_pass_over_many_tasks(spark):
    from pyspark.sql import functions as F

    from inkloom.operators import audit

    at = "run_id long, name string"
    declared = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (2, "c")], at)
    actual = spark.createDataFrame([(1, "a"), (1, "d"), (1, None), (2, "c"), (3, "e")], at)
    got = {tuple(r) for r in audit.manifest_consistency(declared, actual).collect()}
    assert got == {(1, 3, 3, 2, 2, False), (2, 1, 1, 0, 0, True), (3, 0, 1, 1, 0, False)}
    many = spark.range(2000).select((F.col("id") % 500).alias("run_id"), F.col("id").cast("string").alias("name"))
    plan = audit.manifest_consistency(many, many)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
