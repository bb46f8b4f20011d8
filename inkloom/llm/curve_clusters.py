"""Centroid clustering over zone maps along a space-filling curve.

Vectors become integers, are turned onto the principal axes of all of them, and are ordered by the Hilbert curve through a
grid over the first axes. Runs of ``BLOCK`` neighbours on the curve become blocks, each with its least and largest value on
every axis. In a round a block keeps a centroid as candidate only if its box allows it: the least distance from the box must
not exceed the largest distance to any other centroid, and some corner of the box must be at least as near to it as to the
centroid nearest to the box. The vectors of a block are then compared with the candidates by one exact matrix product.

Axes and order decide about speed alone; bounds carry a margin for rounding, so no centroid that could win is left out.
One range shuffle orders the vectors; a round shuffles one row per task and cluster. Equal vectors are dealt out by a salt
behind the curve's key, so that a vector held by a third of all rows is spread over tasks.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out; components
beyond 2^26 after scaling count as 2^26; null ids are clustered like others but start no centroid while other ids are left;
repeated rows count each; fewer vectors than ``k`` start fewer centroids; sums beyond 64 bits show the largest 64-bit number;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import stored, table

K, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
BLOCK = 256
CURVE_AXES, CURVE_BITS = 8, 7  # 56 bits of key
_MOST = 1 << 26
_EXACT = 1 << 20  # components up to which products are exact in doubles


def integers(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integer vectors) of a list column."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = np.asarray(vectors.offsets)
    rows = np.flatnonzero((np.diff(offsets) == width) & np.asarray(vectors.is_valid()))
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is not a number there
    x = flat[offsets[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
    good = np.isfinite(x).all(axis=1)
    return rows[good], np.clip(np.floor(scale * x[good]), -_MOST, _MOST).astype(np.int32)


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits an axis, after Skilling's transposed form."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer rows."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        x, c = x.astype(np.float64), c.astype(np.float64)  # every sum stays below 2^53
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids (on the axes of the box) that may be nearest to a point of the box."""
    near = (np.maximum(0, np.maximum(low - c, c - high)) ** 2).sum(axis=1)
    far = (np.maximum(np.abs(c - low), np.abs(c - high)) ** 2).sum(axis=1)
    margin = 1e-9 * (1 + (c * c).sum(axis=1).max() + (np.maximum(np.abs(low), np.abs(high)) ** 2).sum())
    stay = np.flatnonzero(near <= far.min() + margin)
    best = stay[np.argmin(((c[stay] - (low + high) / 2) ** 2).sum(axis=1))]
    step = c[stay] - c[best]
    gain = (c[best] @ c[best]) - (c[stay] * c[stay]).sum(axis=1) + 2 * np.maximum(low * step, high * step).sum(axis=1)
    return stay[gain >= -margin]  # largest lead over the best one anywhere in the box


class Axes:
    """Mean and principal axes, widest first."""

    def __init__(self, n: float, total: np.ndarray, cross: np.ndarray):
        self.mean = total / max(n, 1)
        spread, axes = np.linalg.eigh(cross / max(n, 1) - np.outer(self.mean, self.mean))
        self.spread, self.axes = np.sqrt(np.maximum(spread[::-1], 1e-12)), np.ascontiguousarray(axes[:, ::-1])

    def turn(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def key(self, x: np.ndarray) -> np.ndarray:
        n = min(CURVE_AXES, len(self.mean))
        cells = (self.turn(x)[:, :n] / self.spread[:n] + 2) * (1 << (CURVE_BITS - 2))  # two spreads to each side
        return hilbert_keys(np.clip(cells, 0, (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS)


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i4").reshape(-1, width)


def kept_vectors(df: DataFrame, id_col: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, v) of the vectors that count, as packed integers."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("v", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, x = integers(batch.column("v"), width, scale)
            packed = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)).cast(arrow.field("id").type), packed], schema=arrow)

    return stored(df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema), "vectors")


def first_centroids(kept: DataFrame, k: int, width: int) -> np.ndarray:
    """The ``k`` vectors of smallest hash of their id."""
    rows = kept.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r["v"]) for r in rows), dtype="<i4").reshape(-1, width).astype(np.int64)


def principal_axes(kept: DataFrame, width: int) -> Axes:
    """Axes of all vectors; each task adds up its moments, width * (width + 1) + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = _vectors(batch, width).astype(np.float64)
            total += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)))
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["m"])

    sums = kept.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).collect()
    m = np.zeros(1 + width + width * width)
    for r in sums:
        m[r["i"]] = r["m"]
    return Axes(m[0], m[1:1 + width], m[1 + width:].reshape(width, width))


def blocks(kept: DataFrame, axes: Axes, width: int, block: int = BLOCK) -> DataFrame:
    """Stored blocks of neighbours on the curve: ids, vectors, and the box on the axes."""
    id_type = kept.schema["id"].dataType
    keyed_schema = T.StructType([*kept.schema.fields, T.StructField("key", T.LongType())])
    keyed_arrow = to_arrow_schema(keyed_schema)

    def keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(axes.key(_vectors(batch, width)), pa.int64())], schema=keyed_arrow)

    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *(T.StructField(c, T.BinaryType()) for c in ("vectors", "low", "high"))])
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                x = _vectors(batch, width)
                turned = axes.turn(x)
                ids = pa.ListArray.from_arrays([0, len(x)], batch.column("id"))
                yield pa.RecordBatch.from_arrays([ids.cast(arrow.field("ids").type), *(pa.array([a.tobytes()], pa.binary()) for a in
                                                  (x, turned.min(axis=0), turned.max(axis=0)))], schema=arrow)

    keyed = kept.mapInArrow(keys, keyed_schema).withColumn("salt", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("key", "salt").sortWithinPartitions("key").select("id", "v")
    return stored(ordered.mapInArrow(pack, schema), "blocks")


def _assigned(batch: pa.RecordBatch, axes: Axes, centroids: np.ndarray, width: int):
    """(ids, vectors, cluster, distance, candidates) of each block of a batch."""
    turned = axes.turn(centroids)
    for i in range(batch.num_rows):
        x = np.frombuffer(batch.column("vectors")[i].as_py(), dtype="<i4").reshape(-1, width)
        low, high = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.float64) for c in ("low", "high"))
        may = candidates(low, high, turned)
        d = distances(x, centroids[may])
        best = d.argmin(axis=1)  # the first of equals has the smallest number
        yield batch.column("ids")[i].values, x, may[best], d[np.arange(len(x)), best], len(may)


def round_sums(zones: DataFrame, axes: Axes, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sums, counts, comparisons made, comparisons without boxes) of one round; at most ``k`` rows reach the driver."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]):
        sums, count, compared = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, x, cluster, _, may in _assigned(batch, axes, centroids, width):
                np.add.at(sums, cluster, x)
                n = np.bincount(cluster, minlength=k)
                count += n
                compared += n * may
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[full].tolist(), pa.list_(pa.int64())),
                                              pa.array(count[full], pa.int64()), pa.array(compared[full], pa.int64())], ["c", "s", "n", "m"])

    made = zones.mapInArrow(run, "c int, s array<bigint>, n bigint, m bigint")
    rows = made.groupBy("c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"), F.sum("n").alias("n"), F.sum("m").alias("m")).collect()
    sums, count, compared = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64), 0
    for r in rows:
        sums[r["c"]], count[r["c"]], compared = r["s"], r["n"], compared + r["m"]
    return sums, count, compared, int(count.sum()) * k


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE,
            block: int = BLOCK) -> tuple[DataFrame, np.ndarray, float]:
    """(rows of id_col, cluster, distance; the final centroids; share of comparisons that the boxes left)."""
    spark = df.sparkSession
    kept = kept_vectors(df, id_col, vector, width, scale)
    centroids = first_centroids(kept, k, width)
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return spark.createDataFrame([], out), centroids, 0.0
    axes = principal_axes(kept, width)
    zones = blocks(kept, axes, width, block)
    made = possible = 0
    for _ in range(rounds):
        sums, count, compared, every = round_sums(zones, axes, centroids)
        centroids = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], centroids)
        made, possible = made + compared, possible + every
    arrow, last = to_arrow_schema(out), centroids

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for ids, _, c, d, _ in _assigned(batch, axes, last, width):
                yield pa.RecordBatch.from_arrays([ids.cast(arrow.field(0).type), pa.array(c, pa.int32()), pa.array(d, pa.int64())], schema=arrow)

    return stored(zones.mapInArrow(run, out), "clusters"), centroids, made / max(possible, 1)


def op11_curve_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = cluster(table(spark, sf_dir, "embeddings"))
    top = (1 << 63) - 1
    whole = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(top).cast("decimal(38,0)")).cast("long")
    inertia = [(r["cluster"], r["i"]) for r in found.groupBy("cluster").agg(whole("distance").alias("i")).collect()]  # one row a cluster
    each = spark.createDataFrame([(c, i, min(sum(x for _, x in inertia), top), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
                                  for c, i in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """SQL of assignment ``n`` and, before the last, of the centroids after it."""
    ip = "list_inner_product"
    assign = f"""d{n} AS (SELECT rid, vec_id, v, c, CAST({ip}(v, v) - 2 * {ip}(v, cv) + {ip}(cv, cv) AS BIGINT) AS d FROM kept, c{n}),
a{n} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM d{n} GROUP BY rid)"""
    if n == ROUNDS:
        return assign
    return assign + f""",
u{n} AS (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, unnest(range(1, {WIDTH + 1})) AS r(i) GROUP BY c, i),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS cv FROM u{n} GROUP BY c),
c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.cv, c{n}.cv) AS cv FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c)"""


OP11_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, v AS cv FROM kept QUALIFY c < {K}),
{', '.join(_round_sql(n) for n in range(ROUNDS + 1))},
named AS (SELECT c, sha256(array_to_string(list_transform(cv, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS name FROM c{ROUNDS})
SELECT vec_id, a.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, name AS centroid_sha256
FROM a{ROUNDS} a JOIN named ON named.c = a.c
"""
