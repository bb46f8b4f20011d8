"""Picture fingerprints: colour, texture and structure features, and their embedding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.vectors import pad_or_cut
from ..session import cut_lineage
from .components import component_stats, connected_components
from .quantiles import join_all
from .segments import otsu_threshold
from .tiles import TILE, Tile, on_tiles

EMBEDDING_SIZE = 128
TAN_22 = 13573  # fixed value: tangent of 22.5 degrees in 15 binary places


def lab_pixels(pixels: DataFrame) -> DataFrame:
    l8, a8, b8 = color.lab8(F.col("b"), F.col("g"), F.col("r"))
    return pixels.select("image_id", "y", "x", l8.alias("l8"), a8.alias("a8"), b8.alias("b8"))


def global_features(lab: DataFrame, canvases: DataFrame) -> DataFrame:
    """Shape, border and centre medians, saturation and lightness spread, in one aggregate.

    Medians are taken on 8-bit codes, whose states are bounded, and rescaled.
    """
    j = lab.join(canvases, "image_id")
    mh, mw = F.floor(F.col("h") * 0.1), F.floor(F.col("w") * 0.1)
    top, left = F.col("y") < mh, F.col("x") < mw
    # an empty margin selects everything, as a slice from -0 does
    low = (F.col("y") >= F.col("h") - mh) | (mh == 0)
    right = (F.col("x") >= F.col("w") - mw) | (mw == 0)
    border = top | left | low | right
    my, mx = F.floor(F.col("h") * 0.15), F.floor(F.col("w") * 0.15)
    centre = (F.col("y") >= my) & (F.col("y") < F.col("h") - my) & (F.col("x") >= mx) & (F.col("x") < F.col("w") - mx)
    j = j.withColumn("_b", border).withColumn("_c", centre)
    med = lambda c, m: F.percentile(F.when(F.col(m), F.col(c)), 0.5)
    scale = 100.0 / 255.0
    norm = lambda a, b: F.sqrt(F.pow(a - 128.0, 2) + F.pow(b - 128.0, 2))
    mean_in = lambda c: F.avg(F.when(F.col("_c"), F.col(c)))
    return j.groupBy("image_id", "h", "w").agg(
        (med("l8", "_b") * scale).alias("bg_l"), (med("a8", "_b") - 128.0).alias("bg_a"), (med("b8", "_b") - 128.0).alias("bg_b"),
        (med("l8", "_c") * scale).alias("center_l"), (med("a8", "_c") - 128.0).alias("center_a"), (med("b8", "_c") - 128.0).alias("center_b"),
        norm(F.avg("a8"), F.avg("b8")).alias("saturation"), norm(mean_in("a8"), mean_in("b8")).alias("center_saturation"),
        (F.stddev_pop("l8") * scale).alias("l_std")) \
        .withColumn("aspect_ratio", F.col("w") / F.col("h")).withColumn("megapixels", F.col("w") * F.col("h") / 1e6)


def lab_histograms(lab: DataFrame) -> DataFrame:
    """Share of pixels per channel and 16-wide bin."""
    long = lab.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.floor(F.col(f"{c}8") / 16).cast("int").alias("bin")) for c in "lab"])).alias("v"))
    n = long.groupBy("image_id", "v.channel", "v.bin").agg(F.count(F.lit(1)).alias("n"))
    total = lab.groupBy("image_id").agg(F.count(F.lit(1)).alias("_t"))
    return n.join(total, "image_id").select("image_id", "channel", "bin", (F.col("n") / F.col("_t")).alias("share"))


GLCM_STEPS = {"a0": (0, 1), "a45": (1, 1), "a90": (1, 0), "a135": (1, -1)}


def glcm_features(pixels: DataFrame, canvases: DataFrame, value: str = "gray", tile: int = TILE) -> DataFrame:
    """Energy, contrast, homogeneity and correlation per direction of the 16-level co-occurrence table.

    Pairs are counted inside tiles and then both ways, so what a tile hands on is at most 256 rows a direction.
    """
    def count(t: Tile) -> dict[str, np.ndarray]:
        q, ok = (t.around(value, 1, "edge") // 16).astype(np.int64), t.inside(1)
        at = lambda g, dy, dx: g[1 + dy:g.shape[0] - 1 + dy, 1 + dx:g.shape[1] - 1 + dx]
        pairs = {n: (at(q, 0, 0) * 16 + at(q, *step))[at(ok, 0, 0) & at(ok, *step)] for n, step in GLCM_STEPS.items()}
        found = {n: np.unique(v, return_counts=True) for n, v in pairs.items()}
        both = np.concatenate([v for v, _ in found.values()])
        return {"angle": np.repeat(list(found), [len(v) for v, _ in found.values()]).astype(object), "i": both // 16, "j": both % 16,
                "n": np.concatenate([n for _, n in found.values()])}

    pairs = on_tiles(pixels, canvases, [value], 1, count, "angle string, i int, j int, n long", tile)
    c = pairs.groupBy("image_id", "angle", "i", "j").agg(F.sum("n").alias("n"))
    sym = c.unionByName(c.select("image_id", "angle", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("image_id", "angle", "i", "j").agg(F.sum("n").alias("n"))
    tot = sym.groupBy("image_id", "angle").agg(F.sum("n").alias("t"), (F.sum(F.col("i") * F.col("n")) / F.sum("n")).alias("mu"))
    p = sym.join(tot, ["image_id", "angle"]).withColumn("p", F.col("n") / F.col("t"))
    d = F.col("i") - F.col("j")
    var = F.sum(F.col("p") * F.pow(F.col("i") - F.col("mu"), 2))
    cov = F.sum(F.col("p") * (F.col("i") - F.col("mu")) * (F.col("j") - F.col("mu")))
    return p.groupBy("image_id", "angle").agg(
        F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"), F.sum(F.col("p") * d * d).alias("contrast"),
        F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.when(var < 1e-15, F.lit(1.0)).otherwise(cov / var).alias("correlation"))


def _lbp_tile(g: np.ndarray, radius: int, points: int) -> np.ndarray:
    """Uniform local binary pattern of the inner part of a padded tile."""
    pad = radius + 1
    h, w = g.shape[0] - 2 * pad, g.shape[1] - 2 * pad
    c = g[pad:pad + h, pad:pad + w]
    bits = []
    for i in range(points):
        dy = round(-radius * math.sin(2 * math.pi * i / points), 5)
        dx = round(radius * math.cos(2 * math.pi * i / points), 5)
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        at = lambda a, b: g[pad + a:pad + a + h, pad + b:pad + b + w]
        t = (1 - fx) * (1 - fy) * at(y0, x0)
        if fx:
            t = t + fx * (1 - fy) * at(y0, x0 + 1)
        if fy:
            t = t + (1 - fx) * fy * at(y0 + 1, x0)
        if fx and fy:
            t = t + fx * fy * at(y0 + 1, x0 + 1)
        bits.append(t - c >= -1e-9)
    b = np.stack(bits)
    changes = (b != np.roll(b, 1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, b.sum(axis=0), points + 1)


def lbp_codes(pixels: DataFrame, value: str = "gray", *, radius: int = 3, points: int = 24, tile: int = 128) -> DataFrame:
    """Uniform pattern code per pixel (``points + 1`` for irregular ones); outside counts as 0.

    Tiles travel with their halo, so each group is a small square of one image.
    """
    pad = radius + 1
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - pad) / tile), F.floor((F.col(c) + pad) / tile)))
    px = pixels.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(value).cast("double").alias("v")) \
        .withColumn("ty", span("y")).withColumn("tx", span("x")).where("ty >= 0 AND tx >= 0")
    typ = px.schema["image_id"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        oy, ox = int(pdf["ty"].iloc[0]) * tile, int(pdf["tx"].iloc[0]) * tile
        ys, xs = pdf["y"].to_numpy() - oy, pdf["x"].to_numpy() - ox
        g = np.zeros((tile + 2 * pad, tile + 2 * pad))
        g[ys + pad, xs + pad] = pdf["v"].to_numpy()
        inner = (ys >= 0) & (ys < tile) & (xs >= 0) & (xs < tile)
        codes = _lbp_tile(g, radius, points)
        return pd.DataFrame({"image_id": pdf["image_id"].to_numpy()[inner], "y": ys[inner] + oy, "x": xs[inner] + ox,
                             "code": codes[ys[inner], xs[inner]]})

    return px.groupBy("image_id", "ty", "tx").applyInPandas(solve, f"image_id {typ}, y int, x int, code int")


def lbp_histogram(codes: DataFrame, bins: int = 16) -> DataFrame:
    """Density of codes 0..16 in sixteen unit bins, the last one closed; larger codes are left out."""
    kept = codes.where(F.col("code") <= bins)
    n = kept.groupBy("image_id", F.least(F.lit(bins - 1), F.col("code")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("_t"))
    return n.join(total, "image_id").select("image_id", "bin", (F.col("n") / F.col("_t")).alias("density"))


def _thin_edges(t: Tile, value: str, low: float, high: float) -> dict[str, np.ndarray]:
    """Pixels whose gradient is over ``low`` and largest across the edge, and whether it is over ``high``."""
    g = t.around(value, 2, "edge").astype(np.int64)
    col = lambda d: g[:, 1 + d:g.shape[1] - 1 + d]
    across, along = col(1) - col(-1), col(-1) + 2 * col(0) + col(1)
    dx, dy = across[:-2] + 2 * across[1:-1] + across[2:], along[2:] - along[:-2]
    size = np.abs(dx) + np.abs(dy)
    beyond = lambda a, b, n: (np.arange(a - 1, b + 1) < 0) | (np.arange(a - 1, b + 1) >= n)
    size[beyond(t.y0, t.y1, t.h)] = 0
    size[:, beyond(t.x0, t.x1, t.w)] = 0
    at = lambda oy, ox: size[1 + oy:size.shape[0] - 1 + oy, 1 + ox:size.shape[1] - 1 + ox]
    m, dx, dy = at(0, 0), dx[1:-1, 1:-1], dy[1:-1, 1:-1]
    steep, flat = np.abs(dy) << 15, np.abs(dx) * TAN_22
    level, upright = steep < flat, steep > flat + (np.abs(dx) << 16)
    falls = (dx < 0) != (dy < 0)
    top = np.where(level, (m > at(0, -1)) & (m >= at(0, 1)), np.where(upright, (m > at(-1, 0)) & (m >= at(1, 0)), np.where(
        falls, (m > at(-1, 1)) & (m > at(1, -1)), (m > at(-1, -1)) & (m > at(1, 1)))))
    hit = top & (m > low)
    return {**t.pixels(hit), "strong": m[hit] > high}


def edge_pixels(pixels: DataFrame, canvases: DataFrame, value: str = "gray", *, low: float = 50, high: float = 150, tile: int = TILE) -> DataFrame:
    """Thinned edges by hysteresis: pixels over ``low`` that hang together, by corners too, with one over ``high``.

    Gradients and thinning are one pass over tiles with a halo of two; the growth from strong pixels through weak ones is
    a component question, answered in tiles and then over the labels that meet across borders.
    """
    thin = cut_lineage(on_tiles(pixels, canvases, [value], 2, lambda t: _thin_edges(t, value, low, high), "y int, x int, strong boolean", tile))
    lab = connected_components(thin, ("image_id",), tile=tile)
    alive = lab.join(thin.where("strong").select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi").select("image_id", "label").distinct()
    return lab.join(alive, ["image_id", "label"], "left_semi").select("image_id", "y", "x")


def edge_density(pixels: DataFrame, canvases: DataFrame, value: str = "gray", *, low: float = 50, high: float = 150, tile: int = TILE) -> DataFrame:
    """Share of edge pixels per image, 0 where there is none."""
    n = edge_pixels(pixels, canvases, value, low=low, high=high, tile=tile).groupBy("image_id").agg(F.count(F.lit(1)).alias("_n"))
    return canvases.join(n, "image_id", "left").select("image_id", (F.coalesce("_n", F.lit(0)) / (F.col("h") * F.col("w"))).alias("edge_density"))


def structure_features(pixels: DataFrame, canvases: DataFrame, value: str = "gray") -> DataFrame:
    """Edge density and statistics of the components above the Otsu threshold."""
    thr = otsu_threshold(pixels, value=value)
    fg = pixels.select("image_id", "y", "x", value).join(thr, "image_id").where(F.col(value) > F.col("threshold"))
    st = component_stats(connected_components(fg, ("image_id",)), ("image_id",))
    aspect = F.greatest("bw", "bh") / (F.least("bw", "bh") + 1e-8)
    comp = st.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_components"), F.avg("area").alias("_m"), F.stddev_pop("area").alias("_s"),
                                      F.count_if((aspect > 3) & (aspect < 20) & (F.col("area") > 50)).alias("_t"))
    j = canvases.join(edge_density(pixels, canvases, value), "image_id").join(comp, "image_id", "left").na.fill(0, ["n_components", "_m", "_s", "_t"])
    area = F.col("h") * F.col("w")
    return j.select("image_id", "edge_density", "n_components", (F.col("_m") / area).alias("area_mean"), (F.col("_s") / area).alias("area_std"),
                    (F.col("_t") / (F.col("n_components") + 1)).alias("text_density"))


def classifier_inputs(pixels: DataFrame, canvases: DataFrame) -> DataFrame:
    """The features the material rules read, one row per image."""
    from .rules import histogram_entropy

    glob = global_features(lab_pixels(pixels), canvases).select("image_id", "center_l", "center_a", "center_b", "center_saturation")
    glcm = glcm_features(pixels, canvases).groupBy("image_id").agg(F.avg("energy").alias("glcm_energy"))
    hist = lbp_histogram(lbp_codes(pixels)).groupBy("image_id").agg(F.collect_list("density").alias("_h"))
    ent = hist.select("image_id", histogram_entropy(F.col("_h")).alias("lbp_entropy"))
    return join_all([glob, glcm, ent, edge_density(pixels, canvases)], ["image_id"])


# ---- embedding -------------------------------------------------------------

def fit_scaler(vectors: DataFrame, vec: str = "raw") -> DataFrame:
    """Mean and population deviation per dimension: one row with two arrays.

    Aggregated per dimension; the result is as long as one vector.
    """
    long = vectors.select(F.posexplode(vec).alias("d", "v"))
    per = long.groupBy("d").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("d", "m", "s")))
    return per.agg(ordered.alias("_o")).select(F.transform("_o", lambda s: s["m"]).alias("mean"),
                                               F.transform("_o", lambda s: F.when(s["s"] == 0, F.lit(1.0)).otherwise(s["s"])).alias("scale"))


def embed(vectors: DataFrame, mean: list[float] | None = None, scale: list[float] | None = None, components: np.ndarray | None = None,
          vec: str = "raw", size: int = EMBEDDING_SIZE) -> DataFrame:
    """Standardize, project if a model is given, then pad or cut to ``size``."""
    x = F.transform(vec, lambda v: v.cast("double"))
    if mean is not None:
        m, s = F.array(*[F.lit(float(v)) for v in mean]), F.array(*[F.lit(float(v)) for v in scale])
        x = F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / (b + 1e-8))
    if components is not None:
        comp = np.asarray(components, dtype=np.float64)
        df = vectors.withColumn("_x", x)

        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s_ in batches:
                yield pd.Series(list(np.stack(s_.to_numpy()) @ comp.T)) if len(s_) else pd.Series([], dtype=object)

        proj = F.pandas_udf(project, "array<double>")
        return df.withColumn("embedding", pad_or_cut(proj("_x"), size)).drop("_x")
    return vectors.withColumn("embedding", pad_or_cut(x, size))


def fit_projection(vectors: DataFrame, vec: str = "raw", min_samples: int = 20, min_components: int = 16, size: int = EMBEDDING_SIZE):
    """(mean, scale, components or None); too few samples only standardize.

    The second moments are summed by Spark, so the driver sees one matrix as
    wide as a vector whatever the number of rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    row = fit_scaler(vectors, vec).first()
    mean, scale = list(row["mean"]), list(row["scale"])
    n = vectors.count()
    k = min(size, len(mean), n - 1)
    if n < min_samples or k < min_components:
        return mean, scale, None
    scaled = embed(vectors, mean, scale, vec=vec, size=len(mean))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(scaled.select(array_to_vector("embedding").alias("_v")))
    return mean, scale, model.pc.toArray().T


def train_family_classifier(samples: DataFrame, label: str = "family", vec: str = "raw", holdout: float = 0.2, trees: int = 50, seed: int = 42):
    """(model, predictions on the held-out fifth); the split is by hashed row within each class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector

    df = samples.withColumn("features", array_to_vector(F.transform(vec, lambda v: v.cast("double"))))
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(vec)), F.lit(1000)) < int(holdout * 1000)
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df)
    forest = RandomForestClassifier(labelCol="_y", featuresCol="features", numTrees=trees, seed=seed)
    model = Pipeline(stages=[index, forest, IndexToString(inputCol="prediction", outputCol="pred", labels=index.labels)]).fit(df.where(~part))
    return model, model.transform(df.where(part)).select(F.col(label).alias("label"), "pred")
