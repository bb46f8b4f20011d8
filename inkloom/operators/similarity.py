"""Cosine retrieval over the episode index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

MARGIN = 1e-6  # radians, for rounding in the bounds
PACK = 256     # vectors of a pack
TILE_BYTES = 16 << 20  # of the vectors of a tile in doubles, at most
LOT_BYTES = 32 << 20   # of the tiles that meet the same queries in one task
ROWS, COLUMNS = 1024, 512  # of the products that are made at once: they stay in a core's cache
KEYS = 8  # keys of the join for each core
EXACT = 16_384  # products in doubles at once


@dataclass
class CellIndex:
    """Stored packs (cell, ids, vecs, n, lo, hi) of vectors, and what is known of the cells.

    A cell holds the vectors nearest to one pivot; ``lo`` and ``hi`` are the least and largest angle to it.
    """

    packs: DataFrame
    pivots: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    id_type: T.DataType


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows; floats stay floats."""
    flat = column.flatten()
    flat = flat if pa.types.is_float32(flat.type) else flat.cast(pa.float64())
    if len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors of several lengths")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their normalised vectors)."""
    m = m.astype(np.float64)
    norms = np.linalg.norm(m, axis=1)
    keep = norms > 0
    unit = m[keep] / norms[keep, None]
    if np.isnan(unit).any():  # of infinite numbers
        whole = ~np.isnan(unit).any(axis=1)
        keep[keep] = whole
        unit = unit[whole]
    return keep, unit


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _lists(values: pa.Array) -> pa.Array:
    """All values as the one list of a column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _order(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, nulls first as in Spark."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def build_index(index: DataFrame, *, id_col: str = "task_id", vec_col: str = "embedding", pivots: int = 64, pack: int = PACK) -> CellIndex:
    """Packs of at most ``pack`` vectors of one cell, made inside the tasks and stored once.

    The pivots are ``pivots`` vectors chosen by hash; they and one row per cell are all that reaches the driver.
    """
    rows = index.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    chosen = rows.orderBy(F.xxhash64("id", "v"), "id").limit(pivots).select("v").toPandas()
    kept, centres = _unit(np.stack(chosen["v"].to_numpy())) if len(chosen) else (None, np.zeros((0, 0)))
    id_type = index.schema[id_col].dataType
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("vecs", T.BinaryType()),
                           T.StructField("n", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])
    if not len(centres):
        empty = index.sparkSession.createDataFrame([], schema)
        return CellIndex(empty, centres, *[np.zeros(0)] * 3, id_type)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def packed(cell: int, last: bool) -> Iterator[pa.RecordBatch]:
            ids, vecs, far = zip(*held.pop(cell))
            ids, vecs, far = pa.concat_arrays(ids), np.concatenate(vecs), np.concatenate(far)
            for at in range(0, len(ids), pack):
                i, v, f = ids[at:at + pack], vecs[at:at + pack], far[at:at + pack]
                if len(i) < pack and not last:
                    held[cell] = [(i, v, f)]
                    return
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), _lists(i), pa.array([v.tobytes()], pa.binary()), pa.array([len(i)], pa.int64()),
                                                  pa.array([f.min()]), pa.array([f.max()])], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("v"))
            keep, m = _unit(raw)
            angle = _angles(m, centres)
            cell = angle.argmin(axis=1)
            order = np.argsort(cell, kind="stable")
            at = np.flatnonzero(keep)[order]
            ids, raw, far, cell = batch.column("id").take(pa.array(at)), raw[at], angle[order, cell[order]], cell[order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cell)]):
                mine = held.setdefault(c := int(cell[a]), [])
                mine.append((ids[a:b], raw[a:b], far[a:b]))
                if sum(len(x) for _, _, x in mine) >= pack:
                    yield from packed(c, False)
        for c in list(held):
            yield from packed(c, True)

    packs = cut_lineage(rows.mapInArrow(make, schema))
    size, low, high = np.zeros(len(centres), dtype=np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for r in packs.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    return CellIndex(packs, centres, size, low, high, id_type)


def _lots(built: CellIndex, parts: np.ndarray) -> list[np.ndarray]:
    """The lot of every tile, by cell: neighbouring tiles in lots of about the same number of rows."""
    most = max(1, LOT_BYTES // (8 * built.pivots.shape[1]))
    total = max(1, int(built.size.sum()))
    lots = -(-total // most)
    before = np.cumsum(built.size) - built.size
    return [np.minimum(lots - 1, ((b + (np.arange(p) + 0.5) * n / p) * lots / total).astype(int)) for b, n, p in zip(before, built.size, parts)]


def _routed(queries: DataFrame, built: CellIndex, parts: np.ndarray, query_id: str, query_vec: str, top_k: int, min_similarity: float,
            block_rows: int, chunks: int = 1, tasks: int = 1) -> DataFrame:
    """(slot, block, cells, qids, qvecs, within): blocks of queries for each lot with cells that may hold one of their best rows.

    The cells' counts and largest angles alone bound the angle of the k-th best row of a query (``within``); a cell whose
    least possible angle is larger is skipped.  The blocks are dealt in turn over ``chunks`` slots of each lot.
    """
    limit = np.arccos(np.clip(min_similarity, -1.0, 1.0))
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())),
                           T.StructField("qids", T.ArrayType(queries.schema[query_id].dataType)), T.StructField("qvecs", T.BinaryType()),
                           T.StructField("within", T.ArrayType(T.DoubleType()))])
    full = built.size > 0
    pivots, size, low, high = built.pivots[full], built.size[full], built.low[full], built.high[full]
    numbers = np.flatnonzero(full)
    cells_of: dict[int, list[int]] = {}  # of a lot; places among the full cells
    lots = _lots(built, parts)
    for place, c in enumerate(numbers):
        for lot in np.unique(lots[c]).tolist():
            cells_of.setdefault(lot, []).append(place)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, first = 0, task * chunks // tasks
        for whole in batches:
            if not whole.num_rows:
                continue
            even = -(-whole.num_rows // -(-whole.num_rows // block_rows))
            for at in range(0, whole.num_rows, even):
                batch = whole.slice(at, even)
                raw = _matrix(batch.column("v"))
                keep, q = _unit(raw)
                kept = np.flatnonzero(keep)
                angle = _angles(q, pivots)
                worst = np.sort(angle + high, axis=1)
                enough = np.cumsum(size[np.argsort(angle + high, axis=1)], axis=1) >= top_k
                within = np.where(enough.any(axis=1), worst[np.arange(len(q)), enough.argmax(axis=1)], np.pi)
                within = np.minimum(within, limit) + MARGIN
                near = np.maximum(0, np.maximum(angle - high, low - angle)) <= within[:, None]
                for lot, places in cells_of.items():
                    mine = np.flatnonzero(near[:, places].any(axis=1))
                    if len(mine):
                        asked = numbers[[p for p in places if near[:, p].any()]]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lot * chunks + (first + block) % chunks], pa.int32()), pa.array([(task << 32) + block], pa.int64()),
                            _lists(pa.array(asked, pa.int32())), _lists(batch.column("id").take(pa.array(kept[mine]))),
                            pa.array([raw[kept[mine]].tobytes()], pa.binary()), _lists(pa.array(within[mine]))], names=schema.names)
                block += 1

    return queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("v")).where("v IS NOT NULL").mapInArrow(route, schema)


def _first_of_equal(vecs: np.ndarray, order: np.ndarray, top_k: int) -> np.ndarray:
    """Rows in the order of their ids, without those that have ``top_k`` equal vectors of smaller ids: no query can have these among its best."""
    bits = vecs.view(np.uint32)
    with np.errstate(over="ignore"):
        mixed = (bits * np.random.default_rng(0).integers(1, 1 << 62, bits.shape[1], dtype=np.uint64)).sum(axis=1)
    rows = np.lexsort((order, mixed))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = mixed[rows[1:]] != mixed[rows[:-1]]
    alike = np.flatnonzero(~new)
    new[alike] = (bits[rows[alike]] != bits[rows[alike - 1]]).any(axis=1)
    nth = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    rows = rows[nth < top_k]
    return rows[np.argsort(order[rows], kind="stable")]


def _hits(near: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Places in ``near`` that reach the floor of their row; few rows have any."""
    some = np.flatnonzero(near.max(axis=1) >= floor)
    row, place = np.divmod(np.flatnonzero(near[some] >= floor[some, None]), near.shape[1])
    return some[row] * near.shape[1] + place


def _top(sims: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the best ``k`` of each row that reach its least one; of equal ones the first columns."""
    kth = np.partition(sims, -k, axis=1)[:, -k, None]
    more, even = sims > kth, sims == kth
    even &= np.cumsum(even, axis=1) <= k - more.sum(axis=1, keepdims=True)
    j, i = np.nonzero((more | even) & (sims >= least[:, None]))
    return j, i, sims[j, i]


class _Best:
    """The best rows so far of some queries.

    Products in floats, less than ``slack`` from the true ones, leave out nearly all rows; the others are multiplied in doubles,
    one by one or, where a query has many of them, with all their neighbours.
    """

    def __init__(self, q: np.ndarray, within: np.ndarray, id_type: pa.DataType, top_k: int, min_similarity: float):
        self.q, self.q32, self.within, self.k = q, q.astype(np.float32), within, top_k
        self.least = np.full(len(q), min_similarity)  # a row that is to count has this similarity
        self.slack = (q.shape[1] + 8) * 2.0 ** -24 + 1e-11
        self.floor = (np.maximum(self.least, np.cos(np.minimum(within, np.pi))) - self.slack).astype(np.float32)
        self.row, self.sim, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0), pa.array([], id_type)
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def offer(self, rows: np.ndarray, ids: pa.Array, m: np.ndarray, m32: np.ndarray, space: np.ndarray) -> None:
        """Index rows, in the order of their ids, for the queries ``rows``; ``space`` is for ``ROWS`` times ``COLUMNS`` products."""
        q32 = self.q32 if len(rows) == len(self.q) else self.q32[rows]
        waiting = 0
        for at in range(0, len(m), COLUMNS):
            part = m32[at:at + COLUMNS]
            near = np.dot(q32, part.T, out=space[:len(rows) * len(part)].reshape(len(rows), len(part)))
            hits = _hits(near, self.floor[rows])
            if len(hits) > 4 * self.k * len(rows) and len(part) > self.k:
                kth = np.partition(near, -self.k, axis=1)[:, -self.k]
                self.floor[rows] = np.maximum(self.floor[rows], kth - np.float32(2 * self.slack))
                hits = _hits(near, self.floor[rows])
            count = np.bincount(hits // len(part), minlength=len(rows))
            if len(many := np.flatnonzero(count > 8 * self.k)):
                hits = hits[count[hits // len(part)] <= 8 * self.k]
                j, i, sims = _top(np.round(self.q[rows[many]] @ m[at:at + COLUMNS].T, 12), self.least[rows[many]], self.k)
                self.found.append((rows[many[j]], sims, ids.take(pa.array(i + at))))
                waiting += len(j)
            for some in range(0, len(hits), EXACT):
                j, i = np.divmod(hits[some:some + EXACT], len(part))
                j, i = rows[j], i + at
                sims = np.round(np.einsum("ij,ij->i", self.q[j], m[i]), 12)  # the same however vectors are packed
                true = sims >= self.least[j]
                self.found.append((j[true], sims[true], ids.take(pa.array(i[true]))))
                waiting += int(true.sum())
            if waiting > 8 * self.k * len(rows):
                self.merge()
                waiting = 0
        self.merge()

    def merge(self) -> None:
        if not self.found:
            return
        row, sim, ids = zip((self.row, self.sim, self.ids), *self.found)
        row, sim, ids = np.concatenate(row), np.concatenate(sim), pa.concat_arrays(ids)
        self.found = []
        order = np.lexsort((_order(ids), -sim, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < self.k
        self.row, self.sim, self.ids = row[kept], sim[order[kept]], ids.take(pa.array(order[kept]))
        last = nth[kept] == self.k - 1
        j, s = self.row[last], self.sim[last]
        self.least[j] = np.maximum(self.least[j], s)
        self.floor[j] = np.maximum(self.floor[j], (s - self.slack).astype(np.float32))
        self.within[j] = np.minimum(self.within[j], np.arccos(np.clip(s, -1.0, 1.0)) + MARGIN)


def search(queries: DataFrame, built: CellIndex, *, query_id: str, query_vec: str, id_col: str = "task_id", top_k: int = 5, min_similarity: float = 0.7,
           block_rows: int = 4096, spread: int = 64, held: int = 50_000) -> DataFrame:
    """Top-k most similar index rows per query vector; exact.

    Packs of a cell are put together to tiles of about ``spread`` packs, and tiles to lots of bounded size, so a direction
    that fills the index is no hot task.  Queries are stored once and go in blocks to the lots that their bound leaves, where
    they meet the tiles by an equal join; each lot stands in so many slots that all cores have work.  Inside a task the k-th
    best row so far tightens each query's bound, tiles out of reach are not multiplied, and only the best k rows of a query
    leave the task (at the latest when ``held`` queries are done).
    """
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, built.id_type),
                           T.StructField("similarity", T.DoubleType())])
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity"), F.asc(id_col))
    spark, pivots = built.packs.sparkSession, built.pivots
    if not len(pivots):
        return spark.createDataFrame([], schema.add("rank", T.IntegerType()))
    dims = pivots.shape[1]
    tile_rows = max(1, min(PACK * spread, TILE_BYTES // (8 * dims)))
    parts = np.maximum(1, -(-built.size // tile_rows)).astype(int)
    part = F.pmod(F.xxhash64("ids"), F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)).cast("int")
    lots = _lots(built, parts)
    n_lots = 1 + max(int(x.max()) for x in lots)

    stored = cut_lineage(queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("v")).where("v IS NOT NULL"))
    keys = KEYS * spark.sparkContext.defaultParallelism
    n = stored.count()
    block_rows = min(block_rows, max(ROWS // 2, -(-n * n_lots // keys)), max(1, TILE_BYTES // (8 * dims)))
    chunks = max(1, min(-(-keys // n_lots), -(-n // block_rows)))
    asked = _routed(stored, built, parts, "id", "v", top_k, min_similarity, block_rows, chunks, max(1, stored.rdd.getNumPartitions()))

    def vectors(vecs: pa.Scalar, n: int) -> np.ndarray:
        buffer = vecs.as_buffer()
        return np.frombuffer(buffer, np.float32 if len(buffer) == 4 * n * dims else np.float64).reshape(n, -1)

    tile_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("lot", T.IntegerType()), T.StructField("ids", T.ArrayType(built.id_type)),
                                T.StructField("vecs", T.BinaryType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs = None, []

        def tile() -> pa.RecordBatch:
            ids, vecs, lo, hi = zip(*packs)
            ids, vecs = pa.concat_arrays(ids), np.concatenate(vecs)
            rows = _first_of_equal(vecs, _order(ids), top_k)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([lots[now[0]][now[1]]], pa.int32()), _lists(ids.take(pa.array(rows))),
                                               pa.array([vecs[rows].tobytes()], pa.binary()), pa.array([min(lo)]), pa.array([max(hi)])], names=tile_schema.names)

        for batch in batches:
            cell, number, ids, vecs, lo, hi = (batch.column(c) for c in ("cell", "part", "ids", "vecs", "lo", "hi"))
            for i in range(batch.num_rows):
                if packs and now != (cell[i].as_py(), number[i].as_py()):
                    yield tile()
                    packs = []
                now = cell[i].as_py(), number[i].as_py()
                packs.append((ids[i].values, vectors(vecs[i], len(ids[i].values)), lo[i].as_py(), hi[i].as_py()))
        if packs:
            yield tile()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, angle, qids = None, [], None, None
        done: list[pa.RecordBatch] = []
        n_done, space = 0, np.empty(ROWS * COLUMNS, dtype=np.float32)

        def rows() -> pa.RecordBatch:
            at = np.concatenate([b.row + k * ROWS for k, b in enumerate(best)])
            return pa.RecordBatch.from_arrays([qids.take(pa.array(at)), pa.concat_arrays([b.ids for b in best]), pa.array(np.concatenate([b.sim for b in best]))],
                                              names=schema.names)

        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                cell, ids = column["cell"][i].as_py(), column["ids"][i].values
                if now != (this := (column["slot"][i].as_py(), column["block"][i].as_py())):
                    if best:
                        done.append(rows())
                        n_done += len(qids)
                    if n_done > held:
                        yield from done
                        done, n_done = [], 0
                    now, qids = this, column["qids"][i].values
                    _, q = _unit(vectors(column["qvecs"][i], len(qids)))
                    angle, within = _angles(q, pivots), column["within"][i].values.to_numpy().copy()
                    best = [_Best(q[a:a + ROWS], within[a:a + ROWS], ids.type, top_k, min_similarity) for a in range(0, len(q), ROWS)]
                lo, hi = column["lo"][i].as_py(), column["hi"][i].as_py()
                m = m32 = None
                for k, b in enumerate(best):
                    far = angle[k * ROWS:(k + 1) * ROWS, cell]
                    near = np.flatnonzero(np.maximum(0, np.maximum(far - hi, lo - far)) <= b.within)
                    if len(near):
                        if m is None:
                            _, m = _unit(vectors(column["vecs"][i], len(ids)))
                            m32 = m.astype(np.float32)
                        b.offer(near, ids, m, m32, space)
        if best:
            done.append(rows())
        yield from done

    # a lot is held and queries stream past it: sorted, all that ask one lot would stand in one task
    tiles = built.packs.withColumn("part", part).repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(put_together, tile_schema)
    slots = F.explode(F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda c: F.col("lot") * chunks + c)).alias("slot")
    spots = 2 * n_lots * chunks
    met = tiles.select("cell", "ids", "vecs", "lo", "hi", slots).repartition(spots, "slot").hint("shuffle_hash") \
        .join(asked.repartition(spots, "slot"), "slot").where(F.array_contains("cells", F.col("cell")))
    met = met.select("slot", "block", "cell", "qids", "qvecs", "within", "ids", "vecs", "lo", "hi")
    return met.mapInArrow(score, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def top_similar(queries: DataFrame, index: DataFrame, *, query_id: str, query_vec: str, id_col: str = "task_id",
                vec_col: str = "embedding", top_k: int = 5, min_similarity: float = 0.7,
                only_audited: bool = True, block_rows: int = 4096, pivots: int = 64) -> DataFrame:
    """Top-k most similar index rows per query vector, from an index built for this call; exact."""
    if only_audited:
        index = index.where("audit_passed")
    built = build_index(index, id_col=id_col, vec_col=vec_col, pivots=pivots)
    return search(queries, built, query_id=query_id, query_vec=query_vec, id_col=id_col, top_k=top_k, min_similarity=min_similarity, block_rows=block_rows)


def family_centroids(index: DataFrame, family: str = "family", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per family, aggregated per dimension so no group is collected."""
    long = index.select(family, F.posexplode(vec_col).alias("_d", "_x"))
    mean = long.groupBy(family, "_d").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_d", "_m")))
    return mean.groupBy(family).agg(F.transform(ordered, lambda s: s["_m"]).alias("centroid"))


def hit_message(similarity: str, task: str) -> F.Column:
    return F.format_string("reuse %s (similarity %.2f)", F.col(task).cast("string"), F.col(similarity))


def reuse_block_reason(preset_now: str | None = None, line_now: str | None = None,
                       expected_keys: list[str] | None = None, *, preset_col="preset", family_col="material_family",
                       line_col="output_mode", keys_col="tune_keys", subset: bool = False) -> F.Column:
    """Why a candidate may not be reused; NULL when it may."""
    parts = []
    if preset_now is not None:
        cand = F.coalesce(F.nullif(F.col(preset_col), F.lit("")), F.col(family_col))
        parts.append(F.when(~cand.eqNullSafe(F.lit(preset_now)),
                            F.concat(F.lit("preset:"), F.coalesce(cand, F.lit("none")))))
    if line_now is not None:
        line = F.lower(F.coalesce(F.col(line_col), F.lit("")))
        parts.append(F.when((line != "") & (line != line_now.lower()), F.concat(F.lit("line:"), line)))
    if expected_keys is not None:
        want = F.array(*[F.lit(k) for k in sorted(expected_keys)])
        got = F.array_sort(F.coalesce(F.col(keys_col), F.array().cast("array<string>")))
        same = (F.size(F.array_except(want, got)) == 0) if subset else (got == want)
        parts.append(F.when(F.size(got) == 0, F.lit("schema:empty")).when(
            ~same, F.concat(F.lit("schema:"), F.array_join(got, ","))))
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")
