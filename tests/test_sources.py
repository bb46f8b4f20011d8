import json

from pyspark.sql import functions as F

from inkloom.operators import lexicon as lx
from inkloom.sources import index as ix
from inkloom.sources import logs, presets, seed_lexicon


def test_episode_log_skips_bad_lines(spark, tmp_path):
    d = tmp_path / "log"
    d.mkdir()
    lines = [json.dumps({"episode_id": f"e{i}", "material_family": "a" if i % 2 else "b", "other_key": [1]}) for i in range(6)]
    (d / "part0.jsonl").write_text("\n".join(lines[:3] + ["{broken", ""] + lines[3:]))
    got = [r.episode_id for r in logs.read_episodes(spark, str(d)).collect()]
    assert got == ["e5", "e4", "e3", "e2", "e1", "e0"]
    assert [r.episode_id for r in logs.read_episodes(spark, str(d), 2, "a").collect()] == ["e5", "e3"]
    assert "other_key" in logs.parse_episode_lines(logs.read_lines(spark, str(d))).first()._raw
    assert logs.corrupt_lines(logs.read_lines(spark, str(d))).count() == 1


def test_episode_files_and_outputs(spark, tmp_path):
    m = tmp_path / "eps" / "2024-03"
    m.mkdir(parents=True)
    (m / "x.episode.json").write_text(json.dumps({"episode_id": "x", "output_mode": "plate"}, indent=1))
    (m / "note.json").write_text("{}")
    r = logs.read_episode_files(spark, str(tmp_path / "eps")).collect()
    assert [(x.episode_id, x.month) for x in r] == [("x", "2024-03")]
    run = tmp_path / "run"
    run.mkdir()
    for n in ("result.plate.psb", "result.plate.manifest.json", "junk.txt"):
        (run / n).write_bytes(b"12345")
    assert {(x.type, x.length) for x in logs.output_files(spark, str(run)).collect()} == {("plate", 5), ("manifest", 5)}
    (tmp_path / "corpus" / "silk").mkdir(parents=True)
    (tmp_path / "corpus" / "silk" / "a.png").write_bytes(b"x")
    assert [x.label for x in logs.image_corpus(spark, str(tmp_path / "corpus")).collect()] == ["silk"]


def test_append_and_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("e1", [0.0] * 128, "ok"), ("e2", [1.0] * 3, "ok"), ("e3", [2.0] * 128, "failed:x")], "episode_id string, embedding array<double>, reason string")
    ix.save_index(ix.index_rows(df), str(tmp_path / "ix"))
    assert {(r.task_id, r.audit_passed) for r in ix.load_index(spark, str(tmp_path / "ix")).collect()} == {("e1", True), ("e3", False)}
    for _ in range(2):
        logs.append_json(df.select("episode_id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_preset_files(spark, tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    (d / "good.json").write_text(json.dumps({"preset_name": "g", "description": "d", "output": {"mode": "both"}, "icc_path": "a.icc", "ai_semantic_classes": [{"name": "n", "prompt": "p", "region": [0, 0, 1, 1]}]}, indent=2))
    (d / "bad.json").write_text("{")
    (d / "list.json").write_text("[1]")
    p = presets.read_presets(spark, str(d))
    got = {r.name: (r.semantic_classes, r.output_modes) for r in presets.list_presets(p.where("file <> 'list'")).collect()}
    assert got == {"g": (1, "design,plate")}
    issues = {r.file: r.i for r in presets.parsed(p).where("v IS NOT NULL").select("file", presets.preset_issues(F.col("v")).alias("i")).collect()}
    assert issues == {"good": [], "list": ["preset 根必须是对象"]}
    assert {(r.file, r.issue) for r in presets.print_integrity(p).collect()} == {("bad", "unreadable")}


def test_seed_lexicon(spark, tmp_path):
    t = seed_lexicon.build(spark, 1_700_000_000)
    assert t["affinity"].count() == 100
    cats = {r.id: r for r in t["categories"].collect()}
    # the 20 seeds, one root and the second level, architecture being both
    assert len(cats) == 27
    assert cats["distant_mountains"].path == "/landscape_painting/distant_mountains/" or cats["distant_mountains"].parent_id == "mountains"
    assert cats["architecture"].parent_id is None and cats["seal"].parent_id is None
    up = {}
    for r in lx.ancestors(t["categories"].select("id", "parent_id")).orderBy("id", "distance").collect():
        up.setdefault(r.id, []).append(r.ancestor)
    assert up["distant_mountains"] == ["mountains", "landscape_painting"]
    seeds = t["categories"].join(t["affinity"].select(F.col("category_id").alias("id")).distinct(), "id", "left_semi")
    health = {r.check: r.passed for r in lx.lexicon_health(seeds, t["prompts"], t["affinity"], t["versions"]).collect()}
    assert all(health.values()) and len(health) == 6
    best = lx.categories_by_material(t["affinity"], t["categories"], limit=1).where("material_family = '金地屏风'").first()
    assert best.category_id == "brocade_frame"
    loop = spark.createDataFrame([("a", "a", "/a/")], "id string, parent_id string, path string")
    fixed = seed_lexicon.attach_tree(loop, spark.createDataFrame([], "id string, parent_new string")).first()
    assert (fixed.parent_id, fixed.path) == ("landscape_painting", "/landscape_painting/a/")
    seed_lexicon.save(t, str(tmp_path / "lex"))
    assert seed_lexicon.load(spark, str(tmp_path / "lex"))["prompts"].count() == t["prompts"].count()


def test_resolution_by_alias_name_and_words(spark):
    t = seed_lexicon.build(spark, 0)
    names = spark.createDataFrame([("08_芦雁群禽_Geese_Flock",), ("Cinnabar_Seal",), ("03_my_Ripples_of_Water",), ("nothing",)], "name string")
    got = {r.name: (r.category_id, r.tier) for r in lx.resolve_category_ids(names, t["categories"], t["aliases"]).collect()}
    assert got["08_芦雁群禽_Geese_Flock"] == ("fauna_geese", 0)
    assert got["Cinnabar_Seal"] == ("seal", 1)
    assert got["03_my_Ripples_of_Water"] == ("water_ripples", 2)
    assert got["nothing"] == (None, None)


def test_presets_of_one_split_are_parsed_in_many_tasks(spark):
    one = spark.range(400).coalesce(1).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("{}").alias("text"))
    tasks = presets.parsed(one).select("file", F.spark_partition_id().alias("p")).collect()
    assert len(tasks) == 400 and len({r.p for r in tasks}) > 1
