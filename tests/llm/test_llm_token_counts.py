import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkloom.llm import token_counts
from inkloom.llm.token_counts import Counts, Frequent, count_tokens, op13_token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
LIBRARY, COUNTS = Tokenizer.from_file(PATH), Counts(SPEC)
TABLE = Frequent({p: n for p, n in zip([b"the", b"'s", b"1", b"a", b"!", b"\x00", b"\x00\x00", b"abcdefghabcdefgh"], [1, 1, 1, 1, 1, 1, 2, 4])})
ODD = ["don't we're 'tis --'s ''s 'S I'LL", "l’été “Hello”, 2024année №5 ½", "é ≠ J̌ K ſ İ ΑΣ. ΑΣ.a", "<|startoftext|>a<|endoftext|> <|start<|endoftext|>oftext|>",
       "a\x1cb \x85c d  e\x0b\x0cf", "日本語のテキスト 🙂🙂 ไทย", "x" * 3000 + " " + "1" * 50 + "!" * 40, "\x00 \x00\x00", "<|ENDOFTEXT|> <|endoftext|", "", "  \n\t ", None]


def by_library(texts):
    return [len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("slice_bytes", [1, 7, 100, 1 << 20])
@pytest.mark.parametrize("table", [Frequent({}), TABLE])
def test_odd_texts_count_as_the_library_counts(slice_bytes, table):
    if table is TABLE:
        assert [COUNTS.encoded([p])[0] for p in (b"the", b"'s", b"1", b"!")] == [1, 1, 1, 1]
        table = Frequent({p: COUNTS.encoded([p])[0] for p in (b"the", b"'s", b"1", b"a", b"!", b"\x00", b"\x00\x00", b"abcdefghabcdefgh")})
    assert COUNTS.of_texts(pa.array(ODD), table, slice_bytes).tolist() == by_library(ODD)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("the's l12 .\t\n’éß̸́JΣσ<|>"))), max_size=6), st.integers(1, 60))
def test_any_text_counts_as_the_library_counts(texts, slice_bytes):
    assert COUNTS.of_texts(pa.array(texts, pa.string()), TABLE_ONE, slice_bytes).tolist() == by_library(texts)


TABLE_ONE = Frequent(dict(zip(names := [b"the", b"'s", b"1", b"a", b".", b"l", b"<|>"], COUNTS.encoded(names))))


def test_the_table_finds_what_it_holds_and_nothing_else():
    rng = np.random.default_rng(5)
    known = {rng.integers(97, 100, rng.integers(1, 17)).astype(np.uint8).tobytes(): int(rng.integers(0, 256)) for _ in range(5000)}
    made = Frequent(known)
    asked = [rng.integers(97, 100, rng.integers(1, 17)).astype(np.uint8).tobytes() for _ in range(5000)] + list(known)
    ends = np.cumsum([len(p) for p in asked])
    data = np.frombuffer(b"".join(asked), dtype=np.uint8)
    got = made.find(*token_counts.packed(data, ends - [len(p) for p in asked], ends))
    assert got.tolist() == [known.get(p, -1) for p in asked]


def test_memory_of_a_worker_is_bounded_and_forgets_nothing_wrongly(monkeypatch):
    monkeypatch.setattr(token_counts, "_KEEP", 10)
    own = Counts(SPEC)
    texts = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)} again" for i in range(200)] * 2
    for t in texts:
        assert own.of_texts(pa.array([t]), Frequent({})).tolist() == by_library([t])
        assert len(own.new) <= 12 and len(own.old) <= 12


def test_operator_keeps_rows_and_columns(spark, odd_docs, no_docs):
    rows = count_tokens(odd_docs.withColumn("n_tokens", odd_docs.score), tokenizer=PATH, limit=20).collect()
    want = odd_docs.collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    for got, src in zip(sorted(rows, key=key), sorted(want, key=key), strict=True):
        n = by_library([src["text"]])[0]
        assert (got["n_tokens"], got["over_limit"], got["n_bytes"], got["n_words"], got["score"]) == \
            (n, n > 20, len((src["text"] or "").encode()), src["n_words"], src["score"])
    assert count_tokens(no_docs, tokenizer=PATH).count() == 0
    assert [r["n_tokens"] for r in count_tokens(odd_docs, tokenizer=PATH, sample=0).orderBy("doc_id", "text").collect()] == \
        [r["n_tokens"] for r in count_tokens(odd_docs, tokenizer=PATH, sample=2).orderBy("doc_id", "text").collect()]


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_token_counts(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(want)
    assert [r["n_tokens"] for r in rows] == by_library([want[r["doc_id"]] for r in rows])
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
