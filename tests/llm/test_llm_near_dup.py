import random
from collections import Counter

import numpy as np
import pyarrow as pa

from inkloom.llm.near_dup import elements, keep_one, near_groups, throw_darts
from inkloom.llm.words import word_chunks, words_of


def weighted_jaccard(a, b):
    sets = []
    for t in (a, b):
        w = words_of(t)
        sets.append(Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    both = sum((sets[0] & sets[1]).values())
    return both / max(1, sum(sets[0].values()) + sum(sets[1].values()) - both)


def test_signatures_agree_as_often_as_weighted_jaccard_says(prose):
    rnd = random.Random(1)
    base = [rnd.choice(prose.split()) + str(rnd.randint(0, 40)) for _ in range(400)]
    pairs = []
    for share in (0.02, 0.1):
        other = [w if rnd.random() > share else "new" for w in base]
        pairs.append((" ".join(base + base[:50]), " ".join(other + other[:90])))
    for a, b in pairs:
        (_, _, w), = word_chunks(pa.array([a, b]))
        owner, element = elements(w)
        sig = throw_darts(owner, element, 2, 2048)
        assert abs((sig[0] == sig[1]).mean() - weighted_jaccard(a, b)) < 0.05


def test_short_and_empty_sets():
    (_, _, w), = word_chunks(pa.array(["", "one", "one two three four", None]))
    owner, element = elements(w)
    assert np.bincount(owner, minlength=4).tolist() == [0, 1, 1, 0]
    assert (throw_darts(owner, element, 4, 16)[1] != 0).all()


def test_groups_match_brute_force(spark, prose):
    rnd = random.Random(3)
    words = [f"{w}{i}" for i, w in enumerate(prose.split() * 4)]
    texts = []
    for g in range(6):
        own = [f"{w}g{g}" for w in words]
        texts.append(" ".join(own))
        for k in range(8):
            mine = list(own)
            for _ in range(k):
                mine[rnd.randrange(len(mine))] = f"x{rnd.random()}"
            texts.append(" ".join(mine))
        texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "."), (903, "one two"), (904, "One,  TWO")]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and a and b and words_of(a) and words_of(b) and weighted_jaccard(a, b) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i, _ in rows}


def test_keep_one_keeps_columns_and_a_row_a_group(odd_docs):
    got = keep_one(odd_docs)
    assert got.columns == odd_docs.columns
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got.collect())
    assert [i for known, i in ids if known] == [1, 3, 4, 5, 6, 7]
