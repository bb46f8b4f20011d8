"""Benchmark decontamination with a broadcast hash set of test n-grams.

Windows are runs of ``size`` normalised words of a benchmark item; an item with fewer words, but not none, is one window.
Their hashes go to the tasks as a checked, bounded slice (several slices when there are more windows than
``slice_windows``; each slice is one more narrow pass over the same rows, so nothing is lost and nothing is shuffled).
Tasks look every window of every text up in the set, compare the words of each hit one by one, and mark the words of
true hits.

Defined cases: a null or empty text has no words and no hits; a benchmark without words leaves everything clean; equal
items under several ids all count; an item without id masks words but is not named; repeated rows are judged alike;
columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import stored, table
from .words import Words, find_words, map_batches, window_hash, word_chunks

WINDOW = 10
SLICE_WINDOWS = 200_000  # windows of one broadcast: about 30 MB with their words
_FILTER_BITS = 22

_HIT = T.StructType([T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("item", T.StringType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("clean_text", T.StringType())])


def item_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(item, n, phrase): every window of every item, n its number of words."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("phrase", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batch):
        items, ns, phrases = [], [], []
        ids = batch.column("item").to_pylist()
        for lo, hi, w in word_chunks(batch.column("text")):
            for d in range(hi - lo):
                a, b = int(w.first[d]), int(w.first[d + 1])
                n = min(size, b - a)
                for i in range(a, b - n + 1 if n else a):
                    items.append(ids[lo + d]), ns.append(n), phrases.append(w.phrase(i, i + n))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(ns, pa.int32()), pa.array(phrases, pa.binary())], schema=arrow)

    return map_batches(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text).alias("text")), run, schema).distinct()


def _phrase_hash(phrase: bytes, n: int) -> int:
    raw = np.frombuffer(phrase, dtype=np.uint8)
    return int(window_hash(find_words(raw, np.array([0, len(raw)])).hashes(), n)[0])


class HashSet:
    """One slice of windows: per size a bit filter and the exact words behind each hash."""

    def __init__(self, rows: list[tuple[str | None, int, bytes]]):
        self.by_size: dict[int, tuple[np.ndarray, dict[int, dict[bytes, list[str | None]]]]] = {}
        for item, n, phrase in rows:
            bits, known = self.by_size.setdefault(n, (np.zeros(1 << _FILTER_BITS, dtype=bool), {}))
            h = _phrase_hash(phrase, n)
            bits[h & ((1 << _FILTER_BITS) - 1)] = True
            known.setdefault(h, {}).setdefault(phrase, []).append(item)

    def hits(self, w: Words) -> list[tuple[int, int, int, str | None]]:
        """(text, first word, end word, item) of each true hit; words count from the text's start."""
        hashes, text, out = w.hashes(), w.text_of(), []
        for n, (bits, known) in self.by_size.items():
            win = window_hash(hashes, n)
            found = np.flatnonzero(bits[(win & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            found = found[text[found] == text[found + n - 1]]
            for i, h in zip(found.tolist(), win[found].tolist()):
                if h in known:
                    for item in known[h].get(w.phrase(i, i + n), ()):
                        d = int(text[i])
                        out.append((d, i - int(w.first[d]), i - int(w.first[d]) + n, item))
        return out


def _finish(w: Words, d: int, hits: list[tuple[int, int, str | None]]) -> dict:
    """Result columns of text ``d`` of the chunk from all its hits."""
    a, b = int(w.first[d]), int(w.first[d + 1])
    o, e = int(w.offsets[d]), int(w.offsets[d + 1])
    raw = w.raw[o:e]
    if not hits:
        return {"n_words": b - a, "n_hit": 0, "items": [], "spans": [], "clean_text": raw.tobytes().decode()}
    delta = np.zeros(b - a + 1, dtype=np.int64)
    np.add.at(delta, [h[0] for h in hits], 1)
    np.add.at(delta, [h[1] for h in hits], -1)
    hit = np.cumsum(delta[:-1]) > 0
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    lo, hi = w.starts[a + first] - o, w.ends[a + last] - o
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    parts, at = [], 0
    for x, y in zip(lo.tolist(), hi.tolist()):
        parts.append(raw[at:x].tobytes())
        at = y
    parts.append(raw[at:].tobytes())
    return {"n_words": b - a, "n_hit": int(hit.sum()), "items": sorted({h[2] for h in hits if h[2] is not None}),
            "spans": [{"start": int(point[x]), "end": int(point[y])} for x, y in zip(lo, hi)], "clean_text": b"".join(parts).decode()}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, id_col: str = "item_id", text: str = "text",
               keep_text: bool = True, slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids found), spans (code points of runs of hit words), clean_text.

    ``clean_text`` is the text without its spans, left out with ``keep_text=False``. Null texts give 0, 0, [], [], "".
    """
    spark = docs.sparkSession
    windows = stored(item_windows(benchmark, size, id_col), "windows")
    n_slices = max(1, -(-windows.count() // slice_windows))
    out = docs
    for s in range(n_slices):
        part = windows.where(F.pmod(F.xxhash64("phrase"), F.lit(n_slices)) == s) if n_slices > 1 else windows
        rows = [(r["item"], r["n"], bytes(r["phrase"])) for r in part.collect()]  # a slice holds about slice_windows rows
        out = _scan(out, spark.sparkContext.broadcast(rows), text, s == n_slices - 1, keep_text)
    return out


def _scan(df: DataFrame, rows, text: str, last: bool, keep_text: bool) -> DataFrame:
    new = [f for f in RESULT.fields if keep_text or f.name != "clean_text"] if last else [T.StructField("_hits", T.ArrayType(_HIT))]
    names = {f.name for f in new}
    carried = "_hits" in df.columns
    kept = [f for f in df.schema.fields if f.name not in names and f.name != "_hits"]
    schema = T.StructType(kept + new)
    arrow = to_arrow_schema(schema)
    sets: list[HashSet] = []

    def run(batch):
        if not sets:
            sets.append(HashSet(rows.value))
        found: list = [[] for _ in range(batch.num_rows)]
        if carried:
            for own, old in zip(found, batch.column("_hits").to_pylist()):
                own.extend((h["lo"], h["hi"], h["item"]) for h in old or ())
        made: list[dict] = []
        for lo, hi, w in word_chunks(batch.column(text)):
            for d, a, b, item in sets[0].hits(w):
                found[lo + d].append((a, b, item))
            if last:
                made.extend(_finish(w, d, found[lo + d]) for d in range(hi - lo))
        if not last:
            made = [{"_hits": [{"lo": a, "hi": b, "item": i} for a, b, i in own]} for own in found]
        cols = [pa.array([m[f.name] for m in made], type=f.type) if f.name in names else batch.column(f.name).cast(f.type) for f in arrow]
        yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return map_batches(df, run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, drop_share: float = 0.5, **params) -> DataFrame:
    """``docs`` with hit spans cut out of the texts; documents with more than ``drop_share`` of their words hit go.

    Columns stay as they are; n_chars, where there is one, follows the new text. Untouched texts, nulls too, stay as given.
    """
    text = params.get("text", "text")
    res = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text"))
    found = find_leaks(res, benchmark, **{**params, "text": "text"}).where(F.col("n_hit") <= F.lit(drop_share) * F.col("n_words"))
    hit = F.col("n_hit") > 0
    cols = []
    for c in docs.columns:
        old = F.col("_doc").getField(c)
        if c == text:
            old = F.when(hit, F.col("clean_text")).otherwise(old)
        elif c == "n_chars":
            old = F.when(hit, F.char_length("clean_text").cast(docs.schema[c].dataType)).otherwise(old)
        cols.append(old.alias(c))
    return found.select(*cols)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS.format('text')} END AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
bs AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM bs, unnest(range(1, len(w) - n + 2)) AS r(i)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
       FROM d, sizes, unnest(range(1, greatest(len(w) - n + 2, 1))) AS r(i)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.phrase = bw.phrase),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""
