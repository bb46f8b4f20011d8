from pyspark.sql import functions as F

from inkloom.llm.decontaminate import decontaminate, find_leaks, items_digest
from inkloom.llm.words import words_of


def brute(text, items, size=10):
    w, hit, names = words_of(text or ""), set(), set()
    for item, t in items:
        v = words_of(t or "")
        n = min(size, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[j:j + n]:
                    hit |= set(range(i, i + n))
                    names |= {item} - {None}
    return len(w), len(hit), sorted(names)


def test_hits_match_brute_force_in_one_slice_and_in_many(spark, odd_docs, prose):
    items = [("10", " ".join(prose.split()[3:18]).upper()), ("9", "Grey Sky"), ("9", "grey sky"), (None, "the coast"), ("12", ""), ("13", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = {}
    for slices in (200_000, 2):
        got = find_leaks(odd_docs, bench, slice_windows=slices).collect()
        rows[slices] = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in got)
        assert len(got) == odd_docs.count()
    assert rows[2] == rows[200_000]
    texts = {str(r["doc_id"]): r["text"] for r in odd_docs.collect()}
    for doc, n, hit, names, spans in rows[2]:
        assert (n, hit, names) == brute(texts[doc], items)
        assert sum(len(words_of(texts[doc][a:b])) for a, b in spans) == hit
    assert items_digest(["9", "10"]) == items_digest(["10", "9"])


def test_spans_are_cut_and_mostly_leaked_documents_go(spark, prose):
    bench = spark.createDataFrame([(1, prose)], "item_id long, text string")
    clean = "nothing of this stands in any list of questions that anyone has ever written down before now"
    docs = spark.createDataFrame([(1, prose, 5), (2, f"{clean} {prose} {clean} {clean} {clean} {clean}", 6), (3, clean, 7), (4, None, None)],
                                 "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in decontaminate(docs, bench).collect()}
    assert set(got) == {2, 3, 4} and got[3]["text"] == clean and got[3]["n_chars"] == 7 and got[4]["text"] is None
    assert "miller" not in got[2]["text"] and got[2]["n_chars"] == len(got[2]["text"])
    assert decontaminate(docs, bench).columns == docs.columns


def test_empty_tables(spark, no_docs, odd_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(no_docs, bench).count() == 0
    assert find_leaks(odd_docs, bench).where(F.col("n_hit") > 0).count() == 0
