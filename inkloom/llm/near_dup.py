"""Near-duplicate documents by DartMinHash on five-word shingles.

A document is a weighted set: its shingles weighted by how often they stand in it. Each unit of an element's weight
carries one fixed random stream of darts, the arrivals of a Poisson process over rank; all darts of a set up to rank
``t / weight`` fall into its regions, about ``t = k ln k + 2k`` of them whatever its length. Each dart belongs to one of
``k`` coordinates, and a coordinate keeps its earliest dart; if one stays empty the rank limit doubles. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity, sum of minima over sum of maxima.

Bands of coordinates give buckets; ``links.group`` compares members of a bucket exactly and merges what is similar.

Defined cases: null texts and texts without words are in no group; a text of one to four words is one shingle; equal
word sequences are always one group; repeated rows count as copies; an id that is null never names a group unless all ids
of the group are null; further columns pass through ``keep_one`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import links
from .store import stored, table
from .words import Words, group_hash, map_batches, mix, window_hash, word_chunks

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6  # a pair at 0.8 shares no band once in 1,500 times
BLOCK = 384          # texts of a block, two of which a task compares

_STEP = 0xA0761D6478BD642F
_MASK = (1 << 64) - 1


def elements(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, element) sorted by text: one element for each unit of a shingle's weight."""
    hashes, first = w.hashes(), w.first
    count = np.diff(first)
    text = w.text_of()
    win = window_hash(hashes, size)
    inside = np.flatnonzero(text[:len(win)] == text[size - 1:]) if len(win) else np.zeros(0, dtype=np.int64)
    owners, values = [text[inside]], [win[inside]]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            owners.append(short)
            values.append(window_hash(hashes, n)[first[short]])
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if not len(owner):
        return owner, value
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
    at = np.arange(len(owner))
    layer = at - np.maximum.accumulate(np.where(new, at, 0))
    return owner, mix(value + layer.astype(np.uint64) * np.uint64(_STEP))


def throw_darts(owner: np.ndarray, element: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """(n_sets, k) signatures; a set without elements has zeros."""
    size = np.bincount(owner, minlength=n_sets)
    sig = np.zeros(n_sets * k, dtype=np.uint64)
    best = np.full(n_sets * k, np.inf)
    limit = k * (np.log(k) + 2) / np.maximum(size, 1)
    todo = size > 0
    while todo.any():
        alive = np.flatnonzero(todo[owner])
        own, el, rank = owner[alive], element[alive], np.zeros(len(alive))
        n = 0
        while len(own):
            n += 1
            dart = mix(el + np.uint64(n * _STEP & _MASK))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53)
            hit = rank <= limit[own]
            own, el, rank, dart = own[hit], el[hit], rank[hit], dart[hit]
            name = mix(dart)
            cell = own * k + (name % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            first = best[cell] == rank
            sig[cell[first]] = name[first]
        todo &= np.isinf(best.reshape(n_sets, k)).any(axis=1)
        limit = limit * 2
    return sig.reshape(n_sets, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        key = mix(key ^ parts[:, :, r])
    return key.view(np.int64)


_SIGNED = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                        T.StructField("cid", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def row_keys(text: str, id_col: str):
    """Two hashes that name a row by its id and text, nulls included."""
    return (F.xxhash64(F.lit(1), id_col, text).alias("k1"), F.xxhash64(text, F.lit(2), id_col).alias("k2"))


def signatures(docs: DataFrame, text: str = "text", id_col: str = "doc_id", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, cid, keys): cid names the word sequence, keys its bands; both null for texts without words."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *_SIGNED.fields[1:]])
    arrow = to_arrow_schema(schema)

    def run(batch):
        cids, keys = [], []
        for lo, hi, w in word_chunks(batch.column("text")):
            n = hi - lo
            full = np.diff(w.first) > 0
            hashes = w.hashes()
            pair = np.empty((n, 2), dtype=np.uint64)
            for j in (0, 1):
                pair[:, j] = group_hash(hashes, w.first, j + 1)
            owner, element = elements(w)
            band = band_keys(throw_darts(owner, element, n, bands * rows), bands, rows)
            for i in range(n):
                cids.append(pair[i].tobytes() if full[i] else None)
                keys.append(band[i] if full[i] else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(cids, pa.binary()),
                                          pa.array(keys, pa.list_(pa.int64()))], schema=arrow)

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), *row_keys(text, id_col), F.col(text).alias("text")), run, schema)


def similarity(pairs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``similarity``, the exact weighted Jaccard of ta and tb."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def sets(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for lo, hi, w in word_chunks(texts):
            owner, element = elements(w, shingle)
            cut = np.searchsorted(owner, np.arange(hi - lo + 1))
            out.extend(element[cut[i]:cut[i + 1]] for i in range(hi - lo))
        return out

    def run(batch):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sim = []
            for x, y in zip(sets(part.column("ta")), sets(part.column("tb"))):
                both = np.sort(np.concatenate((x, y)))
                same = int((both[1:] == both[:-1]).sum())
                sim.append(same / max(1, len(both) - same))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim, pa.float64())], schema=arrow)

    return map_batches(pairs.select("a", "b", "ta", "tb"), run, schema)


def open_links(members: DataFrame, threshold: float, shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between texts of different roots in one (key, cell): counts of shared elements by a sparse product."""
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def solve(cell: pa.Table) -> pa.Table:
        nodes, roots, owners, values = cell.column("node").to_pylist(), cell.column("root").to_pylist(), [], []
        for lo, hi, w in word_chunks(cell.column("text").combine_chunks()):
            owner, element = elements(w, shingle)
            owners.append(owner + lo)
            values.append(element)
        owner, value = np.concatenate(owners), np.concatenate(values)
        size = np.bincount(owner, minlength=len(nodes))
        _, column, times = np.unique(value, return_inverse=True, return_counts=True)
        several = np.flatnonzero(times[column] > 1)  # elements of one text only share nothing
        number = np.cumsum(times > 1) - 1
        owner, column = owner[several], number[column[several]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
        for lo in range(0, int((times > 1).sum()), 4096):
            a, b = np.searchsorted(column, (lo, lo + 4096))
            part = np.zeros((len(nodes), 4096), dtype=np.float32)
            part[owner[a:b], column[a:b] - lo] = 1
            shared += part @ part.T
        x, y = np.nonzero(np.triu(shared, 1) / np.maximum(1, size[:, None] + size - shared) >= threshold)
        got = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in zip(x.tolist(), y.tolist()) if roots[i] != roots[j]]
        return pa.Table.from_arrays([pa.array([p[k] for p in got], pa.binary()) for k in (0, 1)], schema=arrow)

    return members.groupBy("key", "cell").applyInArrow(solve, schema).distinct()


def near_groups(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE,
                bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k1, k2, class_id, class_size, kept): one row per document; class_id is the smallest id of its group.

    Equal word sequences fall together first; only one text of each goes on to the buckets, and only texts that share a
    bucket are read again, to be compared.
    """
    signed = stored(signatures(docs, text, id_col, bands, rows), "signed")
    one = stored(signed.where("cid IS NOT NULL").groupBy("cid").agg(
        F.min(F.struct("k1", "k2")).alias("_row"), F.first("keys").alias("keys")), "distinct")
    buckets = links.shared_buckets(one.select(F.col("cid").alias("node"), F.explode("keys").alias("key")))
    wanted = one.join(buckets.select(F.col("node").alias("cid")).distinct(), "cid", "left_semi").select("cid", "_row.k1", "_row.k2")
    texts = stored(docs.select(*row_keys(text, id_col), F.col(text).alias("text")).join(stored(wanted, "wanted").hint("merge"), ["k1", "k2"])
                   .dropDuplicates(["k1", "k2"]).select("cid", "text"), "texts")

    def verify(pairs: DataFrame) -> DataFrame:
        ta = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))
        return similarity(pairs.join(tb.hint("merge"), "b").join(ta.hint("merge"), "a"), shingle)

    def rest(live: DataFrame) -> DataFrame:
        members = links.cells(live, BLOCK).select("key", "cell", "node", "root")
        return open_links(members.join(texts.select(F.col("cid").alias("node"), "text").hint("merge"), "node"), threshold, shingle)

    roots = stored(links.group(buckets, verify, threshold, rest=rest), "roots")
    named = stored(signed.select("doc_id", "k1", "k2", "cid").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
                   .select("doc_id", "k1", "k2", F.coalesce("root", "cid").alias("root")), "named")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "k1", "k2")).alias("_head")
    classes = stored(named.where("root IS NOT NULL").groupBy("root").agg(head, F.count(F.lit(1)).alias("class_size")), "classes")
    alone = F.col("root").isNull()
    return named.join(classes, "root", "left").select(
        "doc_id", "k1", "k2", F.when(alone, F.col("doc_id")).otherwise(F.col("_head.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | ((F.col("_head.k1") == F.col("k1")) & (F.col("_head.k2") == F.col("k2")))).alias("kept"))


def keep_one(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id (of repeated rows, one)."""
    groups = near_groups(docs, text=text, id_col=id_col, **params)
    kept = groups.where("kept").select("k1", "k2").distinct()
    k1, k2 = row_keys(text, id_col)
    inside = docs.select(F.struct(*docs.columns).alias("_doc"), k1, k2).join(stored(kept, "kept"), ["k1", "k2"], "left_semi")
    first = F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.lit(1)))
    plain = F.col(f"_doc.{text}").isNull() | ~F.col(f"_doc.{text}").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    return inside.withColumn("_n", first).where((F.col("_n") == 1) | plain).select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select("doc_id", "class_id", "class_size", "kept")
