import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.llm import pieces
from inkloom.llm.pieces import MODEL, decode, encode, lattice, normal, times

sentencepiece = pytest.importorskip("sentencepiece")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n=300):
    rnd = random.Random(5)
    fixed = ["", " ", "   a", "a  b", "\n\n a", "def f(x):\n        return  x", "日本語のテキスト", "🙂🙂 x", "a" * 40, "1234567 89", "http://www.example.com/a?b=c", "\x00\x01 é"]
    return fixed + ["".join(rnd.choice("abcdetinro  \n.ée1日本,)(") for _ in range(rnd.randint(1, 80))) for _ in range(n)]


def test_ids_equal_the_library_and_come_back():
    lat = lattice(MODEL)
    for t in texts():
        ids = lat.encode(t)
        assert list(ids) == LIB.encode(t)
        assert lat.decode(ids) == t


def test_transfer_matrices_are_associative_and_lead_to_the_same_path():
    lat = lattice(MODEL)
    for t in texts(120)[3:]:
        whole = normal(t)
        for chunk in (5, 16):
            n, margin = -(-len(whole) // chunk), 2 * lat.width
            parts = [(whole[max(0, c * chunk - margin):(c + 1) * chunk + margin], min(c * chunk, margin)) for c in range(n)]
            parts = [(p, b, b + min(chunk, len(whole) - c * chunk)) for c, (p, b) in enumerate(parts)]
            ms = [lat.transfer(p, b, e, c == 0) for c, (p, b, e) in enumerate(parts)]
            if len(ms) >= 3:
                assert times(times(ms[0], ms[1]), ms[2]) == times(ms[0], times(ms[1], ms[2]))
            total = ms[0]
            for m in ms[1:]:
                total = times(total, m)
            assert len([x for x in total["0"] if x < 64]) == 1


def test_frames_with_giant_texts_nulls_and_clashes(spark, odd_docs, no_docs):
    for giant, chunk in ((100, 64), (10_000, 700)):
        docs = odd_docs.withColumn("ids", F.lit("old"))
        made = decode(encode(docs, giant=giant, chunk=chunk))
        rows = made.collect()
        assert len(rows) == docs.count() + 0
        for r in rows:
            if r["text"] is None:
                assert r["ids"] is None and r["decoded"] is None
            else:
                assert r["ids"] == LIB.encode(r["text"]) and r["decoded"] == r["text"]
    assert encode(no_docs).count() == 0


def test_decoding_where_the_ids_are_made(spark, odd_docs):
    """The same rows as in two steps, with one Python step for short texts instead of two in a row."""
    docs = odd_docs.withColumn("ids", F.lit("old"))
    key = lambda df: sorted(map(repr, df.select(*docs.columns, "decoded").collect()))
    for giant, chunk in ((100, 64), (10_000, 700)):
        made = encode(docs, giant=giant, chunk=chunk, decoded="decoded")
        assert key(made) == key(decode(encode(docs, giant=giant, chunk=chunk)))
    top = lambda df: df._jdf.queryExecution().optimizedPlan().toString().split()[0]
    assert top(encode(docs, decoded="decoded")) == "Union" and top(decode(encode(docs))) == "MapInArrow"


def test_short_runs_scanned_side_by_side_are_those_scanned_alone():
    rng = random.Random(3)
    lat = pieces.Lattice(MODEL)
    runs = list(dict.fromkeys("".join(rng.choice("▁▁aeinrstlhxyzéñß#<~|0129\x01中я") for _ in range(rng.randint(1, 36))) for _ in range(3000)))
    runs += ["▁hello", "▁über", "naïve", "▁" * 9, "x" * 32, "x" * 33]
    ids, count, taken = lat.short_ids(runs)
    ends = [0, *np.cumsum(count).tolist()]
    alone = [lat.to_ids(lat.run_path(r)).tolist() for r, t in zip(runs, taken) if t]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == alone and 100 < len(alone) < len(runs)
    assert taken[-6:].tolist() == [True] * 5 + [False]


def test_runs_met_first_leave_no_room_for_python_loops(monkeypatch):
    lat = pieces.Lattice(MODEL)
    asked = []
    monkeypatch.setattr(lat, "run_path", lambda run: asked.append(run) or pieces.Lattice.run_path(lat, run))
    words = [f"{a}{b}{c}" for a in ("grün", "ab", "Zéro") for b in ("lich", "quon", "tra") for c in ("sen", "xo", "é")]
    lat.encode_all([" ".join(words)])
    assert not asked


def test_pairs_that_meet_in_one_slot_are_judged_alone(monkeypatch):
    monkeypatch.setattr(pieces, "_SLOTS", 2)
    text = "Unrelated wörds, numbers 12345 and <tags/> of several kinds; again: wörds and kinds!"
    assert pieces.Lattice(MODEL).encode(text) == LIB.encode(text)
