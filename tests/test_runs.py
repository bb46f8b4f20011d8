import numpy as np
import pytest
from pyspark.sql import functions as F
from test_grid import brute

from inkloom.operators import grid, plate, runs


def layered(spark, arrays):
    """Masks and canvases of several images, ``arrays`` by (image, layer)."""
    rows = [(i, n, int(y), int(x)) for (i, n), a in arrays.items() for y, x in zip(*np.nonzero(a))]
    sizes = {i: a.shape for (i, _), a in arrays.items()}
    return (spark.createDataFrame(rows, "image_id int, layer string, y int, x int"),
            spark.createDataFrame([(i, *s) for i, s in sizes.items()], "image_id int, h int, w int"))


_rows = {}


def rows_of(df):
    """Rows of a frame, collected once."""
    return _rows.setdefault(id(df), (df, df.collect()))[1]


def of(df, i, n, shape):
    out = np.zeros(shape, dtype=bool)
    for r in rows_of(df):
        if (r.image_id, r.layer) == (i, n):
            out[r.y, r.x] = True
    return out


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(11)
    arrays = {(0, "a"): rng.random((17, 29)) < 0.7, (0, "b"): rng.random((17, 29)) < 0.3, (1, "a"): rng.random((9, 8)) < 0.9, (2, "a"): np.ones((5, 6), dtype=bool),
              (3, "a"): rng.random((1, 40)) < 0.8, (4, "a"): rng.random((33, 1)) < 0.8}
    return arrays, *layered(spark, arrays)


def test_runs_and_back(some):
    arrays, mask, canvases = some
    r = runs.to_runs(mask.unionByName(mask.limit(5)), canvases)
    rows, pixels = r.collect(), runs.to_pixels(r)
    for (i, n), a in arrays.items():
        mine = {(x.y, x.x0, x.x1) for x in rows if (x.image_id, x.layer) == (i, n)}
        pad = np.pad(a.astype(int), ((0, 0), (1, 1)))
        assert len(mine) == (np.diff(pad, axis=1) == 1).sum()
        assert (of(pixels, i, n, a.shape) == a).all()
    area = {(x.image_id, x.layer): x.pixels for x in runs.run_area(r).collect()}
    assert area == {k: a.sum() for k, a in arrays.items() if a.any()}


@pytest.mark.parametrize("kernel", [runs.rectangle(3, 3), runs.rectangle(2, 4), runs.rectangle(1, 5), runs.rectangle(5, 1), grid.ellipse(5), grid.ellipse(9)],
                         ids=["3x3", "2x4", "1x5", "5x1", "ellipse5", "ellipse9"])
def test_steps_equal_pixel_by_pixel_ones(some, kernel):
    arrays, mask, canvases = some
    offsets = [(dy, dx) for dy, (lo, hi) in kernel.items() for dx in range(lo, hi + 1)]
    r = runs.to_runs(mask, canvases)
    made = {f: runs.to_pixels(getattr(runs, f)(r, kernel)) for f in ("dilate_runs", "erode_runs", "close_runs", "open_runs")}
    for (i, n), a in arrays.items():
        wide, thin = brute(a, offsets, max), brute(a, offsets, min)
        want = {"dilate_runs": wide, "erode_runs": thin, "close_runs": brute(wide, offsets, min), "open_runs": brute(thin, offsets, max)}
        for f, df in made.items():
            assert (of(df, i, n, a.shape) == want[f]).all(), f
    for df in made.values():
        assert len(rows_of(df)) == len({(r.image_id, r.layer, r.y, r.x) for r in rows_of(df)})


def test_sets(spark, some):
    arrays, mask, canvases = some
    rng = np.random.default_rng(4)
    others = {k: rng.random(a.shape) < 0.5 for k, a in arrays.items() if k != (1, "a")}
    a, b = runs.to_runs(mask, canvases), runs.to_runs(layered(spark, others)[0], canvases)
    for f, op in ((runs.union_runs, np.logical_or), (runs.intersect_runs, np.logical_and), (runs.subtract_runs, lambda p, q: p & ~q)):
        got = runs.to_pixels(f(a, b))
        assert len(rows_of(got)) == len(set(rows_of(got)))
        for k, x in arrays.items():
            assert (of(got, *k, x.shape) == op(x, others.get(k, np.zeros_like(x)))).all()


def test_no_row_per_kernel_cell(spark):
    canvases = spark.createDataFrame([(0, 400, 4000)], "image_id int, h int, w int")
    block = spark.createDataFrame([(0, "m", y) for y in range(100, 140)], "image_id int, layer string, y int") \
        .select("image_id", "layer", "y", F.explode(F.sequence(F.lit(500), F.lit(2500))).alias("x"))
    r = runs.to_runs(block, canvases)
    assert r.count() == 40
    assert runs._sent(r, grid.ellipse(21)).count() == 40 * 21  # 333 cells a pixel before
    closed = runs.close_runs(r, grid.ellipse(21))
    assert closed.count() == 40 and runs.run_area(closed).first().pixels == 40 * 2001


def test_empty_masks_and_repeated_steps(spark, some):
    arrays, mask, canvases = some
    none = mask.where("false")
    assert grid.close_ellipse(none, canvases, 5).count() == 0 and runs.union_runs(*[runs.to_runs(none, canvases)] * 2).count() == 0
    twice = grid.close_ellipse(mask, canvases, 5, iterations=2)
    offs = [(dy, dx) for dy, (lo, hi) in grid.ellipse(5).items() for dx in range(lo, hi + 1)]
    for k, a in arrays.items():
        want = brute(brute(brute(brute(a, offs, max), offs, max), offs, min), offs, min)
        assert (of(twice, *k, a.shape) == want).all()


def test_traps(spark, some):
    arrays, mask, canvases = some
    offs = [(dy, dx) for dy, (lo, hi) in grid.ellipse(3).items() for dx in range(lo, hi + 1)]
    rng = np.random.default_rng(8)
    side = {k: rng.random(a.shape) < 0.5 for k, a in arrays.items()}
    thin, rim = plate.trap(mask, canvases, 1, trap_type="choke")
    full, band = plate.trap(mask, canvases, 1, layered(spark, side)[0])
    free, edge = plate.trap(mask, canvases, 1)
    for k, a in arrays.items():
        wide, inner = brute(a, offs, max), brute(a, offs, min)
        near = np.any([s for (i, _), s in side.items() if i == k[0]], axis=0)
        for got, want in ((thin, inner), (rim, a & ~inner), (full, a | (wide & near)), (band, wide & near), (free, wide), (edge, wide & ~a)):
            assert (of(got, *k, a.shape) == want).all()


def test_steps_on_one_large_image_run_in_many_tasks(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    tall = spark.range(4000).select(F.lit(0).alias("image_id"), F.lit("m").alias("layer"), F.col("id").cast("int").alias("y"), F.lit(3).alias("x"))
    canvas = spark.createDataFrame([(0, 4000, 9)], "image_id int, h int, w int")
    kernel = grid.ellipse(3)
    own = runs.to_runs(tall, canvas)
    trapped, band = plate.trap(tall, canvas, 1, tall.withColumn("x", F.lit(4)).drop("layer"))
    try:
        for k, value in conf.items():
            spark.conf.set(k, value)
        for made in (own, runs.subtract_runs(runs.dilate_runs(own, kernel), own), grid.closing(tall, canvas, 3, 3), band, trapped,
                     grid.gaussian(tall.withColumn("v", F.col("y")), canvas, "v", 1.0)):
            sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert max(sizes) < 0.7 * sum(sizes)
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)


def test_lines_packed_small_are_not_merged_into_one_task(spark):
    tall = spark.range(4000).select(F.lit(0).alias("image_id"), F.lit("m").alias("layer"), F.col("id").cast("int").alias("y"), F.lit(3).alias("x"))
    closed = grid.closing(tall, spark.createDataFrame([(0, 4000, 9)], "image_id int, h int, w int"), 3, 3)
    assert "REPARTITION_BY_NUM" in closed._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_over_more_partitions_as_the_files_grow(spark, tmp_path, monkeypatch):
    from inkloom.operators import images

    monkeypatch.setattr(images, "ROWS", 100)
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = {}
    for n in (50, 5000):
        path = str(tmp_path / f"mask {n}")
        pixels = spark.range(n).selectExpr("0 AS image_id", "'a' AS layer", "cast(id div 10 AS int) AS y", "cast(id % 10 * 2 AS int) AS x")
        pixels.repartition(3).write.parquet(path)
        mask = spark.read.parquet(path)
        counts[n] = images.by_line(mask.where("x >= 0"), ["image_id", "layer", "y"]).rdd.getNumPartitions()
        found = runs.to_runs(mask, spark.createDataFrame([(0, 500, 20)], "image_id int, h int, w int"))
        assert found.count() == n and found.where("x0 = x1").count() == n
    assert counts == {50: few, 5000: 50}
