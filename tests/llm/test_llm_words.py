import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm.words import find_words, group_hash, window_hash, word_chunks, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBz09 .\n\x00é日🙂-'"), max_size=60))
def test_words_match_the_pattern(text):
    assert words_of(text) == WORD.findall(text.translate(LOW))


def test_texts_do_not_join_and_hashes_do_not_depend_on_the_place():
    texts = ["alpha beta", None, "beta", "gamma alpha beta"]
    (_, _, w), = word_chunks(pa.array(texts))
    assert np.diff(w.first).tolist() == [2, 0, 1, 3]
    h = w.hashes()
    assert h[0] == h[4] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 3
    win = window_hash(h, 2)
    assert win[0] == win[4]
    g = group_hash(h, w.first, 1)
    (_, _, one), = word_chunks(pa.array(["Alpha,  BETA!"]))
    assert group_hash(one.hashes(), one.first, 1)[0] == g[0]


def test_chunks_hold_whole_texts():
    texts = ["ab " * n for n in (1, 500, 2, 900, 0)]
    parts = list(word_chunks(pa.array(texts), limit=600))
    assert [p[0] for p in parts][0] == 0 and parts[-1][1] == 5
    assert np.concatenate([np.diff(p[2].first) for p in parts]).tolist() == [1, 500, 2, 900, 0]
    assert len(find_words(np.zeros(0, np.uint8), np.array([0, 0])).starts) == 0
