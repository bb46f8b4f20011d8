import math
import random

import numpy as np
import pytest

from inkloom.llm import lexical_search
from inkloom.llm.lexical_search import Postings, build_index, impacts, op12_ranked_search, pack, rank_shard, search, weight
from inkloom.llm.words import words_of


def brute(docs, items, k):
    """Rows of (query, rank, id, score) over (id, text) documents and texts of queries."""
    texts = [(i, words_of(t or "")) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df, out = {}, []
    for _, w in texts:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for q, text in enumerate(items):
        found = []
        for i, w in texts:
            s = 0
            for t in words_of(text or ""):
                if t in w:
                    m = 100 - 25 + (25 * len(w) * n_docs) // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 12 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


def corpus(n, seed=4):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(n * 30)] + ["Émile"] * n
    rnd.shuffle(words)
    docs, at = [], 0
    for i in range(n):
        size = rnd.choice([3, 10, 40, 80])
        docs.append((i * 7 % n, " ".join(words[at:at + size])))
        at = (at + size) % (len(words) - 100)
    return docs


@pytest.mark.parametrize("shard_bytes,slice_terms", [(1 << 24, 50_000), (3_000, 20)])
def test_ranking_equals_plain_scoring(spark, shard_bytes, slice_terms):
    docs = corpus(300) + [(None, "w1 w2 rare"), (None, None), (5000, ""), (5001, "..."), (5002, "w1 W2 RARE"), (5003, "w1 w2 rare"), (5003, "w1 w2 rare"), (5004, "rare " * 3000)]
    items = ["w1 w2 w3 w4 w1", "RARE w1", "émile Émile w7 w11 w2", "", None, "nothing-here", "w1", "w2 w3 w5 w8 w13 w21 w34 w55 w1 w1 w1"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, term string").repartition(3)
    index, n_docs, n_terms = build_index(df, shard_bytes=shard_bytes)
    assert n_docs == sum(bool(words_of(t or "")) for _, t in docs) and n_terms == sum(len(words_of(t or "")) for _, t in docs)
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(items)], "item_id string, text string").coalesce(1)
    got = sorted((int(r["item_id"][1:]), r["rank"], r["doc_id"], r["score"]) for r in search(index, n_docs, queries, k=7, slice_terms=slice_terms).collect())
    assert got == brute(docs, items, 7)


def test_blocks_are_rejected_unopened_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    n, terms = 6000, [f"t{i}" for i in range(12)]
    norm = rng.integers(75, 300, n)
    doc, tf, first, tops = [], [], [0], {}
    for i in range(len(terms)):
        own = np.flatnonzero(rng.random(n) < 0.8 / (i + 1) ** 1.5)
        own = own if len(own) else np.array([5])
        doc.append(own)
        tf.append(rng.integers(1, 4, len(own)) * np.where(rng.random(len(own)) < 0.002, 200 + i * 7000, 1))
        first.append(first[-1] + len(own))
    doc, tf, first = np.concatenate(doc), np.concatenate(tf), np.array(first)
    impact = impacts(tf, norm[doc])
    blocks, block_at, postings, posting_at = pack(doc, tf, impact, first)
    opened = whole = 0
    for trial in range(30):
        lists = {t: Postings(blocks[block_at[i]:block_at[i + 1]].tobytes(), postings[posting_at[i]:posting_at[i + 1]].tobytes()) for i, t in enumerate(terms)}
        tops = {t: int(impact[first[i]:first[i + 1]].max()) for i, t in enumerate(terms)}
        for i, t in enumerate(terms):  # unpacking gives back what was packed
            if trial == 0:
                d, f = Postings(blocks[block_at[i]:block_at[i + 1]].tobytes(), postings[posting_at[i]:posting_at[i + 1]].tobytes()).all()
                assert (d == doc[first[i]:first[i + 1]]).all() and (f == tf[first[i]:first[i + 1]]).all()
        query = [(t, int(rng.integers(1, 3)) * weight(n, int(first[i + 1] - first[i]))) for i, t in enumerate(terms)]
        score = np.zeros(n, dtype=np.int64)
        for i, (_, w) in enumerate(query):
            own = slice(first[i], first[i + 1])
            score[doc[own]] += w * impact[own]
        order = np.lexsort((np.arange(n), -score))[:20]
        order = order[score[order] > 0]
        for floor in (1, int(score[order[10]])):
            got, total = rank_shard(query, lists, tops, norm, 20, floor)
            best = np.lexsort((got, -total))
            want = order[score[order] >= floor]
            assert got[best][:len(want)].tolist() == want.tolist() and (total[best][:len(want)] == score[want]).all()
        opened += sum(len(p.opened) for p in lists.values())
        whole += sum(len(p.first) for p in lists.values())
    assert opened < 0.8 * whole


def test_empty_tables(spark, no_docs, odd_docs):
    asked = spark.createDataFrame([(1, "the miller")], "item_id long, text string")
    index, n_docs, _ = build_index(no_docs)
    assert n_docs == 0 and search(index, n_docs, asked).count() == 0
    index, n_docs, _ = build_index(odd_docs)
    assert search(index, n_docs, asked.where("item_id > 1")).count() == 0
    rows = search(index, n_docs, asked).collect()
    assert [(r["rank"], r["doc_id"]) for r in rows] == [(1, 1), (2, 2), (3, 2), (4, 8)] or sorted(r["doc_id"] for r in rows) == [1, 2, 2, 8]


def test_query_columns(spark):
    got = op12_ranked_search(spark, "/root/testdata/sf0.001")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.K == 20 and got.groupBy("item_id").count().where("count > 20").count() == 0
