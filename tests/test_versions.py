"""Published states: numbered entries, merged parts, conflicts and what is removed."""

import pytest
from pyspark.sql import functions as F

from inkloom.operators import lexicon as lx
from inkloom.sources import index as ix
from inkloom.sources import lexicon_store as ls
from inkloom.sources import logs, seed_lexicon
from inkloom.sources.versions import Conflict, VersionLog, part_folders, union


def test_one_writer_gets_a_number(spark, tmp_path):
    log, other = VersionLog(spark, str(tmp_path / "s")), VersionLog(spark, str(tmp_path / "s"))
    assert log.current() == (0, {})
    log.publish(1, {"a": "ä"})
    with pytest.raises(Conflict):
        other.publish(1, {"a": "b"})
    assert other.current() == (1, {"a": "ä"}) and other.numbers() == [1]


def test_parts_stay_few_and_rows_whole(spark, tmp_path):
    log, parts, rows = VersionLog(spark, str(tmp_path / "s")), [], 0
    for i in range(12):
        parts = log.with_part(parts, spark.range(i * 10, i * 10 + 1 + i % 3).coalesce(1), union)
        rows += 1 + i % 3
        assert sum(p["rows"] for p in parts) == rows and len(parts) <= 4
        assert all(a["rows"] > 2 * b["rows"] for a, b in zip(parts, parts[1:]))
    assert log.with_part(parts, spark.range(0), union) == parts
    log.publish(1, {"parts": parts})
    log.publish(2, {"parts": parts[:1]})
    log.forget(1, part_folders)
    assert log.folders() == [parts[0]["folder"]] and log.numbers() == [2]


def test_upserts_against_a_dictionary(spark, tmp_path):
    path, want = str(tmp_path / "ix"), {}
    for b in range(7):
        rows = [(f"t{(b * 5 + j * (b + 1)) % 17}", [float(b), float(j)], (b + j) % 3 > 0) for j in range(4)]
        rows = list({r[0]: r for r in rows}.values())
        for _ in range(1 + b % 2):  # every second batch comes twice
            ix.upsert_index(spark.createDataFrame(rows, ix.INDEX_SCHEMA).coalesce(1), path, b, "s")
        want |= {r[0]: (r[1], r[2]) for r in rows}
        got = {r.task_id: (list(r.embedding), r.audit_passed) for r in ix.load_index(spark, path).collect()}
        assert got == want
    ix.save_index(spark.createDataFrame([("only", [1.0, 2.0], True)], ix.INDEX_SCHEMA), path)
    assert [r.task_id for r in ix.load_index(spark, path).collect()] == ["only"]
    assert not ix.upsert_index(spark.createDataFrame(rows, ix.INDEX_SCHEMA), path, 6, "s")


def test_lexicon_versions_go_through_files_and_back(spark, tmp_path):
    path, now = str(tmp_path / "lex"), 1_700_000_000
    assert ls.active_version(spark, path).count() == 0 and ls.load(spark, path) == {}
    seed_lexicon.publish(spark, path, now)
    first = ls.load(spark, path)
    assert set(first) == set(ls.TABLES) and first["affinity"].count() == 100
    heavier = first["prompts"].withColumn("weight", F.col("weight") + 1)
    ls.create_version(spark, path, "v1", {"prompts": heavier}, now + 10, changeset="weights", evidence="3 images", activate=True)
    ls.create_version(spark, path, "v2", {"prompts": heavier.limit(1)}, now + 20)
    rows = {r.version_id: r for r in ls.versions(spark, path).collect()}
    assert (rows["v1"].parent_version_id, rows["v2"].parent_version_id, rows["v0-seed"].parent_version_id) == ("v0-seed", "v1", None)
    assert rows["v1"].evidence == "3 images" and rows["v2"].activated_at is None
    weight = lambda tables: tables["prompts"].agg(F.sum("weight")).first()[0]
    n = first["prompts"].count()
    assert weight(ls.load(spark, path)) == pytest.approx(weight(first) + n)
    assert ls.load(spark, path, "v2")["prompts"].count() == 1 and ls.load(spark, path, "v2")["affinity"].count() == 100
    assert not ls.activate(spark, path, "nope", now) and ls.active_version(spark, path).first().version_id == "v1"
    # back to the parent; the first version has none
    assert ls.roll_back(spark, path, "v1", now + 30) == "v0-seed" and ls.roll_back(spark, path, "v0-seed", now) is None
    assert tuple(ls.active_version(spark, path).first()) == (1, "v0-seed", now + 30)
    assert weight(ls.load(spark, path)) == pytest.approx(weight(first))
    # only what was never activated expires, and shared tables stay
    assert ls.expire(spark, path, now + 15) == 0 and ls.expire(spark, path, now + 100) == 1
    assert {r.version_id for r in ls.versions(spark, path).collect()} == {"v0-seed", "v1"}
    assert ls.load(spark, path, "v2") == {} and ls.load(spark, path, "v1")["aliases"].count() == first["aliases"].count()
    # a version of the same id is replaced and counts as new
    ls.create_version(spark, path, "v1", {}, now + 200)
    assert [(r.parent_version_id, r.activated_at) for r in ls.versions(spark, path).where("version_id = 'v1'").collect()] == [("v0-seed", None)]


def test_episode_log_is_appended_and_patched(spark, tmp_path):
    path = str(tmp_path / "eps")
    make = lambda rows: spark.createDataFrame(rows, "episode_id string, preset string, _raw string")
    logs.append_episodes(make([("a", "p", "{}"), ("b", None, "{}")]), path)
    logs.append_episodes(make([("c", "q", "{}")]), path)
    patch = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "z.psb"), ("a", 3, "y", None), ("ghost", 1, "n", "n"), (None, 1, "n", "n"), ("b", 1, None, None)],
                                  "episode_id string, seq long, preset string, artifact string")
    assert logs.patch_episodes(patch, path) == 2
    got = {r.episode_id: (r.preset, r.artifact, r._raw) for r in logs.stored_episodes(spark, path).collect()}
    assert got == {"a": ("y", "z.psb", "{}"), "b": (None, None, "{}"), "c": ("q", None, "{}")}
    before = VersionLog(spark, path).current()
    assert logs.patch_episodes(patch.where("episode_id = 'ghost'"), path) == 0 and VersionLog(spark, path).current() == before
    # records written before a field was known
    logs.append_episodes(make([("d", "r", "{}")]), path)
    assert logs.stored_episodes(spark, path).where("artifact IS NULL").count() == 3


def test_parents_of_many_versions_in_one_second(spark):
    rows = [(f"v{i:04d}", "own" if i % 7 == 3 else None, 5 if 20 < i < 380 else i) for i in range(400)]
    got = {r.version_id: r.parent_version_id for r in lx.version_parents(spark.createDataFrame(rows, "version_id string, parent_version_id string, created_at long")).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: r[1] or (order[i - 1][0] if i else None) for i, r in enumerate(order)}
    empty = spark.createDataFrame([], "version_id string, parent_version_id string, created_at long")
    assert lx.version_parents(empty).count() == 0
