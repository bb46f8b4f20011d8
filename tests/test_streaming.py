import json
import time

from pyspark.sql import functions as F

from inkloom.streaming import learning as le
from inkloom.streaming import progress as pr


def write_parts(path, rows, n=3):
    path.mkdir()
    for i in range(n):
        (path / f"{i:02d}.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows[i * len(rows) // n:(i + 1) * len(rows) // n]))
        time.sleep(0.02)


def drain(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")) \
        .trigger(availableNow=True).start()
    done = q.awaitTermination(90)
    q.stop()
    assert done and q.exception() is None


LINES = ["引擎启动", "x", "GroundingDINO 加载完成", "[SAM2] 级联分割执行中", "plain", "写盘 result.psb"]


def watch(spark, stream, name, tmp_path, until):
    """Rows of a query that timers keep running: stopped once ``until(table)`` holds."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(processingTime="1 second").start()
    end = time.time() + 90
    while time.time() < end and q.isActive and not until(spark.table(name)):
        time.sleep(0.5)
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"] if q.lastProgress else None
    q.stop()
    assert q.exception() is None
    return spark.table(name), state


def test_progress_stream_equals_batch(spark, tmp_path):
    # the fourth line is dated before the third: the percent must not fall
    rows = [{"task_id": f"t{k}", "seq": i * 2 + k, "ts": f"2024-01-01T00:0{i if i != 3 else 1}:1{k}Z", "message": m, "preset": "textile_damask"}
            for i, m in enumerate(LINES) for k in range(2)]
    write_parts(tmp_path / "log", rows)
    got, _ = watch(spark, pr.progress_stream(pr.read_log_stream(spark, str(tmp_path / "log"))), "progress_out", tmp_path,
                   lambda t: t.where("NOT heartbeat").count() >= len(rows))
    got = got.where("NOT heartbeat").select("task_id", "seq", "stage", "progress")
    want = pr.progress_batch(spark.read.schema(pr.LOG_SCHEMA).json(str(tmp_path / "log"))).select("task_id", "seq", "stage", "progress")
    assert got.count() == len(rows)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert want.where("progress > 95").count() == 0
    rises = [r.progress for r in want.where("task_id = 't0'").orderBy("seq").collect()]
    assert rises == sorted(rises) and rises[3] == rises[2] > 0


def test_heartbeats_follow_the_log_and_end_with_the_task(spark, tmp_path):
    # an old log: the machine's clock would put every heartbeat at the cap at once
    rows = [{"task_id": t, "seq": i, "ts": f"2020-01-01T00:00:{10 * i:02d}Z", "message": m, "preset": "other", "status": s}
            for t, end in (("open", None), ("done", "completed")) for i, (m, s) in enumerate([("seed = 1", None), ("x", None), ("y", end)])]
    write_parts(tmp_path / "log", rows, 2)
    src = pr.read_log_stream(spark, str(tmp_path / "log"), pr.LOG_SCHEMA + ", status string")
    got, kept = watch(spark, pr.progress_stream(src, heartbeat_ms=2000), "beats_out", tmp_path,
                      lambda t: t.where("heartbeat AND task_id = 'open'").count() >= 2 and t.where("NOT heartbeat").count() == len(rows))
    beats = got.where("heartbeat").collect()
    last = 20 * 100 // 240  # the third line, twenty seconds in
    after = [r.progress for r in beats if r.task_id == "open"]
    assert len(after) >= 2 and after == sorted(after) and all(r.stage == "初始化引擎" for r in beats)
    assert all(p < 95 for p in after) and after[-1] >= last
    ended = got.where("task_id = 'done' AND NOT heartbeat").orderBy("seq").collect()
    assert [r.progress for r in ended] == [0, 10 * 100 // 240, last]
    # the four values and the timer of the open task (and its index entry) are all that is left
    assert kept is not None and 0 < kept <= 8


def test_tasks_go_after_their_time_to_live(spark, tmp_path):
    write_parts(tmp_path / "log", [{"task_id": "lost", "seq": 0, "ts": "2020-01-01T00:00:00Z", "message": "seed = 1", "preset": "other"}], 1)
    out = pr.progress_stream(pr.read_log_stream(spark, str(tmp_path / "log")), heartbeat_ms=1000, ttl_ms=4000)
    seen = {"n": -1, "same": 0}

    def quiet(t):
        n = t.count()
        seen["same"], seen["n"] = (seen["same"] + 1 if n == seen["n"] and n else 0), n
        return seen["same"] > 12
    got, kept = watch(spark, out, "lost_out", tmp_path, quiet)
    assert seen["same"] > 12 and got.where("heartbeat").count() >= 1


def test_progress_is_the_same_over_chunks(spark):
    rows = [("t", i, f"2024-01-01 00:{(i * 7) % 40 // 10:02d}:{(i * 37) % 60:02d}", LINES[i % 6] if i % 5 == 0 else "plain" if i % 7 else "", "other") for i in range(120)]
    lines = spark.createDataFrame(rows, "task_id string, seq long, ts string, message string, preset string").withColumn("ts", F.to_timestamp("ts"))
    whole, cut = ({(r.seq, r.stage, r.progress) for r in pr.progress_batch(lines, chunk=c).collect()} for c in (4096, 8))
    assert whole == cut and len(cut) == sum(r[3] != "" for r in rows)
    secs = [(i, int(t[14:16]) * 60 + int(t[17:])) for _, i, t, m, _ in rows if m]
    best, want = 0, {}
    for i, s in secs:
        best = max(best, min(95, (s - secs[0][1]) * 100 // 240))
        want[i] = best
    assert {i: p for i, _, p in cut} == want
    assert pr.progress_batch(lines.limit(0)).count() == 0


def test_stage_rules(spark):
    df = spark.createDataFrame([("[SAM2] 级联分割执行中",), ("nothing here",), ("seed = 42",)], "m string")
    assert [r[0] for r in df.select(pr.stage_of(F.col("m"))).collect()] == ["神经分割", None, "初始化引擎"]


def test_enqueue_stream_equals_batch(spark, tmp_path):
    events = ["enqueue", "enqueue", "running", "enqueue", "failed", "enqueue", "enqueue", "no_op", "enqueue", "completed", "enqueue"]
    rows = [{"episode_id": e, "seq": i, "event": ev} for i, ev in enumerate(events) for e in ("a", "b")]
    write_parts(tmp_path / "ev", rows, 4)
    schema = "episode_id string, seq long, event string"
    src = pr.read_log_stream(spark, str(tmp_path / "ev"), schema)
    drain(le.enqueue_decisions(src), "enqueue_out", tmp_path, "append")
    got = {tuple(r) for r in spark.table("enqueue_out").collect()}
    want = {tuple(r) for r in le.enqueue_decisions_batch(spark.read.schema(schema).json(str(tmp_path / "ev"))).collect()}
    assert got == want
    assert [d for e, s, d in sorted(want) if e == "a"] == ["queued", "duplicate", "duplicate", "queued", "duplicate", "queued", "duplicate"]


def test_learning_runs_per_batch(spark, tmp_path):
    rows = [{"episode_id": e, "seq": i, "decision": d} for i, (e, d) in enumerate([("1", "queued"), ("1", "duplicate"), ("2", "queued"), ("9", "queued")])]
    write_parts(tmp_path / "dec", rows, 2)
    det = spark.createDataFrame([("1", 0, "a", "", "p", True, True), ("2", 1, "ghost", "", "p", True, True)],
                                "episode_id string, seq long, category_id string, layer_name string, prompt string, quality_gate_passed boolean, diffuse_gate_passed boolean") \
        .withColumn("quality_gate_reason", F.lit(None).cast("string")).withColumn("diffuse_gate_reason", F.lit(None).cast("string"))
    prompts = spark.createDataFrame([("a", "p", 1.0, "seed")], "category_id string, prompt string, weight double, source string")
    got, seen = {}, []

    def sink(df, _epoch):
        rows = df.collect()
        seen.extend((r.episode_id, r.status) for r in rows)
        got.update({r.episode_id: (r.status, r.n_suggestions, r.n_unknown) for r in rows})

    src = pr.read_log_stream(spark, str(tmp_path / "dec"), "episode_id string, seq long, decision string")
    q = le.run_tasks(src, det, prompts, sink, str(tmp_path / "cp")) \
        .trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    q.stop()
    assert got == {"1": ("completed", 1, 0), "2": ("no_op", 0, 1), "9": ("failed", 0, 0)}
    assert len(seen) == 6 and all(seen.index((e, "running")) < seen.index((e, got[e][0])) for e in got)


def test_requests_close_in_a_stream(spark, tmp_path):
    req = [{"feedback_request_id": f"f{i}", "ts": f"2024-01-0{i + 1}T00:00:00Z"} for i in range(4)]
    rev = [{"feedback_request_id": "f1", "ts": "2024-01-02T05:00:00Z", "action": "accept"}, {"feedback_request_id": "f3", "ts": "2024-01-05T00:00:00Z", "action": "merge"}]
    write_parts(tmp_path / "req", req, 2)
    write_parts(tmp_path / "rev", rev, 1)
    s1, s2 = "feedback_request_id string, ts timestamp", "feedback_request_id string, ts timestamp, action string"
    out = le.close_requests(pr.read_log_stream(spark, str(tmp_path / "req"), s1), pr.read_log_stream(spark, str(tmp_path / "rev"), s2))
    drain(out, "closed_out", tmp_path)
    got = {(r.feedback_request_id, r.action) for r in spark.table("closed_out").collect()}
    batch = le.close_requests(spark.read.schema(s1).json(str(tmp_path / "req")), spark.read.schema(s2).json(str(tmp_path / "rev")))
    assert got == {(r.feedback_request_id, r.action) for r in batch.collect()} == {("f1", "accept"), ("f3", "merge")}


def test_finalize_stream_equals_batch(spark, tmp_path):
    from inkloom.operators.episodes import DIM_KEYS
    ok = {k: {"passed": True, "evaluated": True, "na": False} for k in DIM_KEYS}
    bad = {**ok, DIM_KEYS[3]: {"passed": False, "evaluated": True, "na": False}}
    eps = [{"episode_id": f"e{i}", "ts": "2024-01-01T00:00:00Z", "output_mode": "plate"} for i in range(3)]
    auds = [{"episode_id": "e0", "ts": "2024-01-01T01:00:00Z", "dims": ok, "output_mode": "plate"},
            {"episode_id": "e1", "ts": "2024-01-01T02:00:00Z", "dims": bad, "output_mode": "plate"}]
    write_parts(tmp_path / "eps", eps, 1)
    write_parts(tmp_path / "aud", auds, 2)
    s1 = "episode_id string, ts timestamp, output_mode string"
    s2 = "episode_id string, ts timestamp, dims map<string,struct<passed:boolean,evaluated:boolean,na:boolean>>, output_mode string"
    drain(le.finalize(pr.read_log_stream(spark, str(tmp_path / "eps"), s1), pr.read_log_stream(spark, str(tmp_path / "aud"), s2)), "final_out", tmp_path)
    got = {(r.episode_id, r.reason) for r in spark.table("final_out").collect()}
    assert got == {("e0", "ok"), ("e1", f"failed:{DIM_KEYS[3]}")}


def test_replay_keeps_the_last_lines(spark):
    df = spark.createDataFrame([("t", i) for i in range(50)], "task_id string, seq long")
    assert sorted(r.seq for r in pr.replay(df).collect()) == list(range(30, 50))


def test_admitted_episodes_are_found_after_one_batch(spark, tmp_path):
    from inkloom.operators import similarity as sim
    from inkloom.operators.episodes import DIM_KEYS
    from inkloom.sources import index as ix
    from inkloom.sources.versions import VersionLog
    ok = {k: {"passed": True, "evaluated": True, "na": False} for k in DIM_KEYS}
    bad = {**ok, DIM_KEYS[0]: {"passed": False, "evaluated": True, "na": False}}
    eps = [{"episode_id": f"e{i}", "ts": "2024-01-01T00:00:00Z", "embedding": [float(j == i) for j in range(8)]} for i in range(4)]
    auds = [{"episode_id": "e0", "ts": "2024-01-01T01:00:00Z", "dims": ok, "output_mode": "plate"},
            {"episode_id": "e1", "ts": "2024-01-01T02:00:00Z", "dims": bad, "output_mode": "plate"},
            {"episode_id": "e2", "ts": "2024-01-01T02:00:00Z", "dims": ok, "output_mode": "plate"},
            {"episode_id": "e2", "ts": "2024-01-01T03:00:00Z", "dims": bad, "output_mode": "plate"}]
    write_parts(tmp_path / "eps", eps, 1)
    write_parts(tmp_path / "aud", auds[:3], 1)
    s1 = "episode_id string, ts timestamp, embedding array<float>, output_mode string"
    s2 = "episode_id string, ts timestamp, dims map<string,struct<passed:boolean,evaluated:boolean,na:boolean>>, output_mode string"
    path, cp = str(tmp_path / "index"), str(tmp_path / "cp")

    def refresh():
        done = le.finalize(pr.read_log_stream(spark, str(tmp_path / "eps"), s1), pr.read_log_stream(spark, str(tmp_path / "aud"), s2))
        q = le.refresh_index(done, path, cp, size=8).trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None

    def found():
        ask = spark.createDataFrame([(f"q{i}", [float(j == i) for j in range(8)]) for i in range(4)], "q string, v array<float>")
        return {(r.q, r.task_id) for r in sim.top_similar(ask, ix.load_index(spark, path), query_id="q", query_vec="v").collect()}

    assert ix.load_index(spark, path).count() == 0
    refresh()
    assert found() == {("q0", "e0"), ("q2", "e2")}
    # a later audit fails: the row is replaced
    (tmp_path / "aud" / "99.json").write_text(json.dumps(auds[3], ensure_ascii=False))
    refresh()
    assert found() == {("q0", "e0")}
    assert {(r.task_id, r.audit_passed) for r in ix.load_index(spark, path).collect()} == {("e0", True), ("e1", False), ("e2", False)}
    # a batch that comes again changes nothing, neither rows nor the published number
    number, entry = VersionLog(spark, path).current()
    again = spark.createDataFrame([("e9", [1.0] * 8, True)], ix.INDEX_SCHEMA)
    assert not ix.upsert_index(again, path, entry["batches"][cp], cp)
    assert VersionLog(spark, path).current() == (number, entry)
    assert ix.upsert_index(again, path, 0, "another stream")
    assert ix.load_index(spark, path).count() == 4
