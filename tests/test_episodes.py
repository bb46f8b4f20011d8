import random

from pyspark.sql import functions as F

from inkloom.operators import episodes as ep
from inkloom.operators import lexicon as lx

DET = ("episode_id long, seq long, category_id string, layer_name string, prompt string, quality_gate_passed boolean, "
       "diffuse_gate_passed boolean, quality_gate_reason string, diffuse_gate_reason string")
PROMPT = "category_id string, prompt string, weight double, source string"


def det(frame, rows):
    return frame([(e, i, c, l, p, q, d, None, None) for i, (e, c, l, p, q, d) in enumerate(rows)], DET)


def test_missing_gates_reject(frame):
    rows = [(1, "a", "", "p", True, None)] * 4 + [(1, "a", "", "p", None, False)] * 3 + [(1, "a", "", "p", None, None)] * 5
    got = {r.signal: r["count"] for r in ep.attributions(det(frame, rows)).groupBy("signal").count().collect()}
    assert got == {"quality_reject": 8, "diffuse_reject": 4}


def test_category_falls_back_and_empty_prompts_drop(frame):
    rows = [(1, "", "layer", "p", True, True), (1, None, None, "p", True, True), (1, "a", "b", "", True, True)]
    assert sorted(r.category_id for r in ep.attributions(det(frame, rows)).collect()) == ["layer", "unknown"]


def test_weight_update_literals(frame):
    prompts = frame([("a", "p", 2.5, "seed"), ("a", "s", 9.0, "shadow")], PROMPT)
    d = det(frame, [(1, "a", "", "p", True, True), (2, "a", "", "p", False, True), (3, "ghost", "", "ghost prompt", True, True), (4, "a", "", "s", True, True)])
    got = {r.episode_id: r for r in ep.weight_updates(ep.attributions(d), prompts).collect()}
    assert got[1].new_weight == 2.75 and got[1].signal == "accept"
    assert got[2].signal == "reject" and got[2].new_weight == 2.0
    assert got[3].signal == "unknown" and got[3].new_weight is None
    assert got[4].signal == "unknown"
    bare = ep.weight_updates(ep.attributions(d.where("episode_id = 1")), None).first()
    assert (bare.old_weight, round(bare.new_weight, 9)) == (1.0, 1.1)


def test_chunked_fold_equals_walking_the_episodes(frame):
    rng = random.Random(3)
    rows, want = [], {}
    for prompt in ("p", "q"):
        w = start = 2.0
        for e in range(300):
            rejects, accepts = rng.choice([(0, 1), (0, 3), (2, 0), (1, 1)])
            new = max(0.05, min(5.0, start * (0.8 ** rejects if rejects else 1.1 ** accepts)))
            rows.append((e, "c", prompt, start, new, "reject" if rejects else "accept"))
            w = max(0.05, min(5.0, w * new / start))
        want[prompt] = w
    upd = frame(rows, "episode_id long, category_id string, prompt string, old_weight double, new_weight double, signal string")
    far = upd.withColumn("seq", F.col("episode_id") * 10_000_000_000 - 1_700_000_000_000)
    for frame_, order, chunk in ((upd, "episode_id", 7), (upd, "episode_id", 8192), (far, "seq", 8192)):
        got = {r.prompt: r.new_weight for r in ep.fold_updates(frame_, order=order, chunk=chunk).collect()}
        assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert all(0.05 <= w <= 5.0 for w in got.values())


def test_uncertain_literals(frame):
    d = frame([("a", "", 0.85, [0.9]), ("b", "", 0.62, [0.1]), ("c", "", 0.95, None), ("", "l", None, [0.3, 0.6]), ("e", "", None, None)],
              "category_id string, layer_name string, confidence double, logits array<double>")
    got = {(r.category_id, r.confidence) for r in ep.uncertain_detections(d).collect()}
    assert got == {("b", 0.62), ("l", 0.6), ("e", 0.0)}


def _dims(frame, overrides=(), drop=(), mode="plate"):
    m = {k: (True, True, False) for k in ep.DIM_KEYS}
    m.update(dict(overrides))
    for k in drop:
        m.pop(k)
    return frame([(m, mode)], "dims map<string,struct<passed:boolean,evaluated:boolean,na:boolean>>, mode string")


def reason(df):
    return df.select(ep.admission_reason(F.col("dims"), F.col("mode")).alias("r")).first().r


def test_admission_literals(frame):
    p = ep.PLATE_DIM
    assert reason(_dims(frame)) == "ok"
    assert reason(_dims(frame, [(p, (False, True, False))])) == f"failed:{p}"
    assert reason(_dims(frame, [(p, (True, False, True))], mode="design")) == "ok"
    assert reason(_dims(frame, drop=["① 层属性"])) == "missing_dim:① 层属性"
    assert reason(_dims(frame, [("③ 实例重复", (True, False, False))])) == "not_evaluated:③ 实例重复"
    none = frame([(None, "plate")], "dims map<string,struct<passed:boolean,evaluated:boolean,na:boolean>>, mode string")
    assert reason(none) == "no_full_report"


def test_tree(frame):
    edges = frame([("landscape", None), ("mountains", "landscape"), ("distant", "mountains"), ("a", "b"), ("b", "a"), ("self", "self")],
                  "id string, parent_id string")
    got = {}
    for r in lx.ancestors(edges).orderBy("id", "distance").collect():
        got.setdefault(r.id, []).append(r.ancestor)
    assert got == {"mountains": ["landscape"], "distant": ["mountains", "landscape"], "a": ["b"], "b": ["a"]}
    paths = {r.id: r.path for r in lx.materialized_paths(edges).collect()}
    assert paths["landscape"] == "/" and paths["distant"] == "/mountains/distant/"
    bad = frame([("landscape", "distant"), ("distant", "landscape")], "id string, parent_id string")
    assert {r.id: r.creates_cycle for r in lx.cyclic_inserts(bad, edges).collect()} == {"landscape": True, "distant": False}


def test_inherited_priors(frame):
    cats = frame([("r", None), ("p", "r"), ("c", "p"), ("d", "r")], "id string, parent_id string")
    pri = frame([("p", 0.01, 0.2)], "category_id string, area_budget_min double, area_budget_max double")
    got = {r.id: (r.status, r.area_budget_max, r.n_samples) for r in lx.inherit_priors(cats, pri).collect()}
    assert got == {"r": ("no_parent", None, None), "p": ("has_own_priors", None, None), "c": ("inherited", 0.2, 0), "d": ("parent_without_priors", None, None)}
