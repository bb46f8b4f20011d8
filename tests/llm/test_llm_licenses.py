import pytest

from inkloom.llm.licenses import PHRASES, TEMPLATES, Automaton, scan_licenses
from inkloom.llm.words import words_of


def accepts(template, text):
    a, w = Automaton(template), words_of(text)
    return any(a.match(lambda i: w[i], i, len(w)) is not None for i in range(len(w)))


def test_automata():
    t = "<<who:3>> grants use [[and [[free]] copying]] of the work <<year:1>> forever"
    for text in ("A B grants use of the work forever", "grants use and copying of the work 1999 forever more", "grants use and free copying of the work forever"):
        assert accepts(t, text)
    for text in ("grants use and free of the work forever", "grants use of the work in 1999 forever", "grants usage of the work forever", "grants use of the work", ""):
        assert not accepts(t, text)
    with pytest.raises(ValueError):
        Automaton("[[only optional]]")
    with pytest.raises(ValueError):
        Automaton("a [[b")


def test_every_template_accepts_its_own_wording():
    import re

    for name, t in TEMPLATES.items():
        full = re.sub(r"<<(\w+):\d+>>", r"\1", t.replace("[[", "").replace("]]", ""))
        bare = t
        while "[[" in bare:
            bare = re.sub(r"\[\[[^\[\]]*\]\]", "", bare)
        assert accepts(t, full) and accepts(t, re.sub(r"<<\w+:\d+>>", "", bare)), name


def test_frames(spark, odd_docs, no_docs):
    rows = [(1, "MIT License. The Apache  License! mit license"), (2, "Released under the MIT License."), (3, None), (4, "permit license"),
            (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Released under the MITT License")]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(p["start"] for p in got[1]["places"]) == [0, 3, 5] and got[3]["n_words"] == 0 and not got[4]["places"]
    assert [a["label"] for a in got[2]["accepted"]] == ["mit-notice"] and [a["label"] for a in got[5]["accepted"]] == ["gpl-notice"]
    assert not got[6]["accepted"] and set(PHRASES.values()) == {"mit", "apache", "gpl"}
    assert scan_licenses(odd_docs).count() == odd_docs.count() and scan_licenses(no_docs).count() == 0
