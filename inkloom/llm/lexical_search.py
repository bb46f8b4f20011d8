"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

``build_index`` makes one row per shard and term: how many documents of the shard hold it, its largest impact there, and
its postings in blocks of 128, each with its last document, its largest impact and byte-packed gaps and occurrences. The
impact of a posting is its saturated frequency; a term's weight times the impact is what it adds to a score. A shard is a
run of documents of about ``SHARD_BYTES`` inside one task, so building the index shuffles nothing. Each shard has one more
row, of the empty term, with its documents and their length norms.

``search`` joins the index with the terms of the queries, brings the lists of a shard together and ranks shard by shard
inside the task. The lists of a query are taken by falling bound. While what the lists left can add still reaches the
query's threshold they are essential: all their documents are candidates. From there on the lists are non-essential: a
candidate goes when its score so far, the bounds of the lists left and the largest impact of the block it would be found in
stay under the threshold, and only blocks with candidates left are unpacked. The threshold is the best known lower bound of
the query's k-th score, kept from shard to shard. The tasks' best rows are merged by a window with a rank limit.

Defined cases: null texts and texts without terms count for nothing and are never found; equal scores go by ascending id,
null ids last; repeated rows are documents of their own; queries without terms have no rows; each query row is a query of
its own, also under a repeated id; fewer than k rows come out where fewer documents score above 0; other columns are ignored.
Terms are grouped inside a shard by a 64-bit hash and from then on are compared as strings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import stored, table
from .words import Words, map_batches, word_chunks, words_of

K = 20
BLOCK = 128
SHARD_BYTES = 8 << 20  # of text in a shard; one longer text is a shard of its own
SLICE_TERMS = 50_000   # query terms searched at once, the bound of what is broadcast

# Constants of the saturated frequency.
_SCALE, _TF, _NORM, _LENGTH = 1_000_000_000, 1_000, 12, 25

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERM = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
                      T.StructField("top", T.LongType()), T.StructField("blocks", T.BinaryType()), T.StructField("postings", T.BinaryType())])


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, all their terms)."""

    def run(batch):
        n, total = 0, 0
        for _, _, w in word_chunks(batch.column(0)):
            n, total = n + int((np.diff(w.first) > 0).sum()), total + len(w.starts)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.LongType())])
    row = map_batches(docs.select(text), run, schema).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return row["n"] or 0, row["total"] or 0


def norms(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Length norm of documents of so many terms."""
    if length.max(initial=0) * n_docs * _LENGTH < 1 << 62:
        return 100 - _LENGTH + (_LENGTH * length * n_docs) // max(n_terms, 1)
    return np.array([100 - _LENGTH + (_LENGTH * n * n_docs) // max(n_terms, 1) for n in length.tolist()], dtype=np.int64)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (_SCALE * tf) // (_TF * tf + _NORM * norm)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


# ---------------------------------------------------------------------------------------------------------------- index


def _widths(top: np.ndarray) -> np.ndarray:
    """Bytes for values up to ``top``: 1, 2 or 4."""
    return np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, 4)).astype(np.int64)


def _put(out: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray) -> None:
    for byte in range(4):
        has = width > byte
        out[at[has] + byte] = (value[has] >> (8 * byte)) & 0xFF


def pack(doc: np.ndarray, tf: np.ndarray, impact: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block bytes, their offsets, posting bytes, their offsets) of lists; list i is ``first[i]`` to ``first[i + 1]``, by document."""
    size = np.diff(first)
    n_blocks = -(-size // BLOCK)
    list_of = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(doc)) - first[:-1][list_of]
    begins = np.flatnonzero(place % BLOCK == 0)
    count = np.diff(np.append(begins, len(doc)))
    block_of = np.repeat(np.arange(len(begins)), count)
    gap = doc.copy()
    gap[1:] -= doc[:-1]
    gap[begins] = 0  # the first document of a block stands in its head
    gap_width, tf_width = _widths(np.maximum.reduceat(gap, begins)), _widths(np.maximum.reduceat(tf, begins))
    ends = np.cumsum(count * (gap_width + tf_width))
    starts = ends - count * (gap_width + tf_width)
    postings = np.zeros(int(ends[-1]), dtype=np.uint8)
    inside = np.arange(len(doc)) - begins[block_of]
    _put(postings, starts[block_of] + inside * gap_width[block_of], gap, gap_width[block_of])
    _put(postings, starts[block_of] + count[block_of] * gap_width[block_of] + inside * tf_width[block_of], tf, tf_width[block_of])
    first_block = np.concatenate(([0], np.cumsum(n_blocks)))
    list_start = starts[first_block[:-1]]
    heads = np.empty((len(begins), 6), dtype="<i4")  # first and last document, largest impact, place in the list's bytes, widths, postings
    heads[:, 0], heads[:, 1], heads[:, 2] = doc[begins], doc[begins + count - 1], np.maximum.reduceat(impact, begins)
    heads[:, 3] = starts - np.repeat(list_start, n_blocks)
    heads[:, 4], heads[:, 5] = gap_width * 8 + tf_width, count
    return heads.reshape(-1).view(np.uint8), first_block * 24, postings, np.append(list_start, len(postings))


class Postings:
    """One list of a shard; blocks are unpacked when asked for."""

    def __init__(self, blocks: bytes, postings: bytes):
        heads = np.frombuffer(blocks, dtype="<i4").reshape(-1, 6).astype(np.int64)
        self.first, self.last, self.top, self.at, self.widths, self.count = heads.T
        self.bytes, self.opened = postings, {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, occurrences) of a block."""
        got = self.opened.get(b)
        if got is None:
            n, gap, tf, at = int(self.count[b]), int(self.widths[b]) // 8, int(self.widths[b]) % 8, int(self.at[b])
            docs = np.cumsum(np.frombuffer(self.bytes, f"<u{gap}", n, at), dtype=np.int64) + self.first[b]
            got = self.opened[b] = docs, np.frombuffer(self.bytes, f"<u{tf}", n, at + n * gap).astype(np.int64)
        return got

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.block(b) for b in range(len(self.first))]
        return (parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))


class Shard:
    """Terms of the documents of one shard; of a chunk only what the index needs is held."""

    def __init__(self):
        self.size, self.n, self.ids, self.parts = 0, 0, [], []

    def add(self, w: Words, ids: pa.Array) -> None:
        span = np.stack((w.starts, w.ends)).astype(np.int32) + np.int32(self.size)
        self.parts.append((w.hashes(), (w.text_of() + self.n).astype(np.int32), span, w.data, np.diff(w.first)))
        self.ids.append(ids)
        self.size, self.n = self.size + len(w.data), self.n + len(ids)


def _shard_rows(held: Shard, shard: int, n_docs: int, n_terms: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard; its documents are numbered by ascending id, null ids last."""
    ids = pa.concat_arrays(held.ids)
    order = np.asarray(pc.sort_indices(ids, null_placement="at_end"))
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    term, doc, word_at, data, length = (np.concatenate([p[j] for p in held.parts], axis=-1) for j in range(5))
    held.parts.clear()
    doc = place[doc]
    norm = norms(length[order], n_docs, n_terms)
    by = np.lexsort((doc, term))
    term, doc = term[by], doc[by].astype(np.int64)
    new_term = np.concatenate(([True], term[1:] != term[:-1]))
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(term)))
    first = np.append(np.flatnonzero(new_term[at]), len(at))
    doc = doc[at]
    impact = impacts(tf, norm[doc])
    blocks, block_at, postings, posting_at = pack(doc, tf, impact, first)
    names = word_at[:, by[at[first[:-1]]]].astype(np.int64)
    size = names[1] - names[0]
    name_at = np.concatenate(([0], np.cumsum(size)))
    letters = data[np.repeat(names[0] - name_at[:-1], size) + np.arange(name_at[-1])]

    def many(kind, offsets, values):
        wide = np.ascontiguousarray(offsets, dtype=np.int32)
        return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(wide), pa.py_buffer(np.ascontiguousarray(values))])

    n = len(first) - 1
    rows = {"shard": np.full(n, shard), "term": many(pa.string(), name_at, letters), "df": np.diff(first),
            "top": np.maximum.reduceat(impact, first[:-1]), "blocks": many(pa.binary(), block_at, blocks),
            "postings": many(pa.binary(), posting_at, postings), "ids": pa.nulls(n, arrow.field("ids").type)}
    own = {"shard": [shard], "term": [""], "df": [len(order)], "top": [0], "blocks": [norm.astype("<i8").tobytes()], "postings": [b""],
           "ids": pa.ListArray.from_arrays([0, len(order)], ids.take(pa.array(order)))}
    for cols in (own, rows):
        made = [cols[f.name].cast(f.type) if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in arrow]
        whole = pa.RecordBatch.from_arrays(made, schema=arrow)
        for lo in range(0, whole.num_rows, 8192):
            yield whole.slice(lo, 8192)


def build_index(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """(stored index, documents with a term, all terms)."""
    n_docs, n_terms = corpus_size(docs, text)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([*_TERM.fields, T.StructField("ids", T.ArrayType(id_type))])
    arrow = to_arrow_schema(schema)
    source = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.spark_partition_id().cast("long").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]):
        held, made, part = Shard(), 0, 0
        for batch in batches:
            for lo, hi, w in word_chunks(batch.column("text")):
                if not len(w.starts):
                    continue
                if held.n and held.size + len(w.data) > shard_bytes:
                    yield from _shard_rows(held, (part << 32) + made, n_docs, n_terms, arrow)
                    held, made = Shard(), made + 1
                part = batch.column("part")[lo].as_py()
                held.add(w, batch.column("id").slice(lo, hi - lo))
        if held.n:
            yield from _shard_rows(held, (part << 32) + made, n_docs, n_terms, arrow)

    return stored(source.mapInArrow(run, schema), "postings"), n_docs, n_terms


# --------------------------------------------------------------------------------------------------------------- search


class Best:
    """The best (score, id) of one query so far: falling score, ascending id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """Least score that still matters; documents of score 0 never do."""
        return max(1, self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, found: list[tuple[int, object]]) -> None:
        self.rows = sorted(self.rows + found, key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))[:self.k]


def rank_shard(query: list[tuple[str, int]], lists: dict[str, Postings], tops: dict[str, int], norm: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard that may be among the query's best k; ``query`` has terms with their weights.

    All documents of a score of ``floor`` or more that belong to the shard's best k, ties by number, are among them.
    """
    mine = sorted(((w * tops[t], t, w) for t, w in query if t in lists and w > 0), key=lambda x: (-x[0], x[1]))
    left = np.append(np.cumsum([b for b, _, _ in mine][::-1])[::-1], 0).tolist() if mine else [0]
    score = np.zeros(len(norm), dtype=np.int64)
    at = 0
    while at < len(mine) and left[at] >= floor:  # essential lists
        _, t, w = mine[at]
        docs, tf = lists[t].all()
        score[docs] += w * impacts(tf, norm[docs])
        at += 1
        if at < len(mine) and left[at] >= floor and np.count_nonzero(score) >= k:
            floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))  # k documents have that much already
    alive = np.flatnonzero(score + left[at] >= floor) if at else np.zeros(0, dtype=np.int64)
    alive = alive[score[alive] > 0]
    total = score[alive]
    for i in range(at, len(mine)):  # non-essential lists
        if not len(alive):
            break
        _, t, w = mine[i]
        p = lists[t]
        b = np.searchsorted(p.last, alive)
        inside = b < len(p.last)
        inside[inside] &= p.first[b[inside]] <= alive[inside]
        most = np.zeros(len(alive), dtype=np.int64)
        most[inside] = w * p.top[b[inside]]
        stay = total + most + left[i + 1] >= floor  # the block's maximum decides before the block is opened
        alive, total, b, inside = alive[stay], total[stay], b[stay], inside[stay]
        for block in np.unique(b[inside]).tolist():
            docs, tf = p.block(block)
            asked = np.flatnonzero(inside & (b == block))
            place = np.minimum(np.searchsorted(docs, alive[asked]), len(docs) - 1)
            hit = docs[place] == alive[asked]
            total[asked[hit]] += w * impacts(tf[place[hit]], norm[alive[asked[hit]]])
        if len(alive) >= k:
            floor = max(floor, int(np.partition(total, len(total) - k)[len(total) - k]))
    keep = total >= floor
    alive, total = alive[keep], total[keep]
    if len(alive) > k:
        best = np.lexsort((alive, -total))[:k]
        alive, total = alive[best], total[best]
    return alive, total


def _slices(queries: Iterator, limit: int) -> Iterator[list]:
    """Runs of (id, terms) with about ``limit`` terms in all."""
    held, n = [], 0
    for row in queries:
        words = words_of(row["text"] or "")
        if held and n + len(words) > limit:
            yield held
            held, n = [], 0
        held.append((row["id"], words))
        n += len(words)
    if held:
        yield held


def _search_slice(index: DataFrame, n_docs: int, asked: list, first: int, k: int) -> DataFrame:
    spark = index.sparkSession
    names = sorted({t for _, words in asked for t in words})
    terms = F.broadcast(spark.createDataFrame([(t,) for t in ["", *names]], "term string"))  # bounded by the slice
    mine = index.join(terms, "term")
    frequency = {r["term"]: r["df"] for r in mine.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row per query term
    weights = {t: weight(n_docs, df) for t, df in frequency.items()}
    queries = []
    for words in (w for _, w in asked):
        own: dict[str, int] = {}
        for t in words:
            if t in weights:
                own[t] = own.get(t, 0) + weights[t]
        queries.append(list(own.items()))
    shared = spark.sparkContext.broadcast(queries)
    id_field = T.StructField("id", index.schema["ids"].dataType.elementType)
    out = T.StructType([T.StructField("query", T.LongType()), id_field, T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]):
        queries, best = shared.value, {}
        shard, lists, tops, norm, ids = None, {}, {}, None, None

        def rank():
            for q, query in enumerate(queries):
                mine = best.setdefault(q, Best(k))
                docs, scores = rank_shard(query, lists, tops, norm, k, mine.floor())
                if len(docs):
                    mine.add(list(zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())))

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for i in range(batch.num_rows):
                if shards[i] != shard:
                    if lists:
                        rank()
                    shard, lists, tops, norm, ids = shards[i], {}, {}, None, None
                t = batch.column("term")[i].as_py()
                if t:
                    lists[t], tops[t] = Postings(batch.column("blocks")[i].as_py(), batch.column("postings")[i].as_py()), batch.column("top")[i].as_py()
                else:
                    norm, ids = np.frombuffer(batch.column("blocks")[i].as_py(), "<i8").astype(np.int64), batch.column("ids")[i].values
        if lists:
            rank()
        rows = [(first + q, d, s) for q, b in best.items() for s, d in b.rows]
        for at in range(0, len(rows), 10_000):
            part = rows[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], f.type) for j, f in enumerate(arrow)], schema=arrow)

    together = mine.select("shard", "term", "top", "blocks", "postings", "ids").repartition("shard").sortWithinPartitions("shard")
    return together.mapInArrow(run, out)


def search(index: DataFrame, n_docs: int, queries: DataFrame, *, text: str = "text", item_col: str = "item_id", id_col: str = "doc_id", k: int = K,
           slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(item_col, rank, id_col, score) of each query's best ``k`` documents; queries are searched in slices of about ``slice_terms`` terms."""
    spark = index.sparkSession
    item_field = T.StructField("item", queries.schema[item_col].dataType)
    found, first, items = [], 0, []
    source = queries.select(F.col(item_col).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")
    for asked in _slices(source.toLocalIterator(), slice_terms):
        found.append(stored(_search_slice(index, n_docs, asked, first, k), "found"))
        items.append(spark.createDataFrame([(first + i, q) for i, (q, _) in enumerate(asked)], T.StructType([T.StructField("query", T.LongType()), item_field])))
        first += len(asked)
    result = T.StructType([T.StructField(item_col, item_field.dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, index.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    if not found:
        return spark.createDataFrame([], result)
    every, named = (reduce(DataFrame.unionByName, x) for x in (found, items))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id")))  # cut to k rows before the shuffle
    return every.withColumn("rank", rank).where(F.col("rank") <= k).join(named, "query") \
        .select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs, _ = build_index(table(spark, sf_dir, "documents"))
    return search(index, n_docs, table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate({}, '" + _UP + "', '" + _UP.lower() + "'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH dt AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY doc_id, t),
dn AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
size AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
q AS (SELECT item_id, unnest({_TERMS.format('text')}) AS t FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY item_id, t),
tw AS (SELECT p.t, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
       FROM p, size WHERE p.t IN (SELECT t FROM qt) GROUP BY p.t),
dm AS (SELECT doc_id, 100 - 25 + ((25 * n * nn) // ll) AS m FROM dn, size),
s AS (SELECT qt.item_id, p.doc_id, CAST(sum(qt.times * tw.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * dm.m))) AS BIGINT) AS score
      FROM qt JOIN tw ON tw.t = qt.t JOIN p ON p.t = qt.t JOIN dm ON dm.doc_id = p.doc_id GROUP BY qt.item_id, p.doc_id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
"""
