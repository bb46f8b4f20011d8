"""Registered queries on density, smoothing, regions, press work and compositing."""

from pyspark.sql import functions as F

from ..operators import audit as au
from ..operators import composite as cp
from ..operators import density as de
from ..operators import fingerprint as fp
from ..operators import grid
from ..operators import masks as mk
from ..operators import plate as pl
from ..operators import segments as sg
from . import jobs
from . import raster_sql as rs
from .catalog_inks import LAB_SQL
from .registry import query

P = ("pixels", "canvases")
M = ("mask_px", "canvases", "pixels")
_D = """gold AS (SELECT image_id, greatest(quantile_cont(gray, 0.88) / 255e0, 1e-6) AS gd FROM pixels GROUP BY 1),
dens AS (SELECT image_id, y, x, 0e0 - ln(greatest(0.01e0, least(1e0, gray / 255e0 / gd))) / ln(50e0) AS d FROM pixels JOIN gold USING (image_id))"""
_DS = f"{_D}, {rs.gauss('sm', 'dens', 'd', sigma=0.9)}"


def _r(df, *cols, places=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


@query("ink_density_c1", f"WITH {_D} SELECT image_id, y, x, round(d, 6) AS d FROM dens", P)
def _(v):
    return _r(de.ink_density(v.pixels), "d")


@query("smoothed_density_w6", f"WITH {_DS} SELECT image_id, y, x, round(d, 6) AS d FROM sm", P)
def _(v):
    return _r(de.density_map(v.pixels, v.canvases, sigma=0.9), "d")


@query("wide_smoothing_w6", f"WITH {rs.gauss('sm', 'pixels', 'gray', sigma=4.0)} SELECT image_id, y, x, round(gray, 6) AS gray FROM sm", P)
def _(v):
    return _r(grid.gaussian(v.pixels, v.canvases, "gray", 4.0), "gray")


@query("density_percentiles_m7", f"WITH {_DS} SELECT image_id, {', '.join(f'round(quantile_cont(d, {p}), 6) AS {n}' for n, p in (('p50', .5), ('p75', .75), ('p90', .9), ('p95', .95)))} FROM sm GROUP BY 1", P)
def _(v):
    return _r(de.global_percentiles(de.density_map(v.pixels, v.canvases, sigma=0.9)), "p50", "p75", "p90", "p95")


_REG = [("a", 0.1, 0.1, 0.5, 0.4), ("b", 0.3, 0.2, 0.9, 0.8)]


def _bands_sql(regions, src):
    reg = " UNION ALL ".join(f"SELECT image_id, '{n}' AS region, d FROM {src} JOIN canvases USING (image_id) WHERE x >= floor({a!r}::DOUBLE * w) AND x < floor({c!r}::DOUBLE * w) AND y >= floor({b!r}::DOUBLE * h) AND y < floor({d!r}::DOUBLE * h)" for n, a, b, c, d in regions)
    return f"""rg AS ({reg}), bq AS (SELECT image_id, region, quantile_cont(d, 0.6) AS lo, quantile_cont(d, 0.95) AS hi0 FROM rg GROUP BY 1, 2), bp AS (SELECT image_id, region, lo, CASE WHEN lo >= hi0 THEN least(1, lo + 0.02) ELSE hi0 END AS hi FROM bq WHERE hi0 > 1e-6),
bands AS (SELECT image_id, region, round(any_value(lo), 4) AS density_min, round(any_value(hi), 4) AS density_max, round(avg(CASE WHEN d >= lo - 1e-12 AND d <= hi + 1e-12 THEN 1e0 ELSE 0e0 END), 4) AS coverage FROM rg JOIN bp USING (image_id, region) GROUP BY 1, 2)"""


@query("region_bands_m8", f"WITH {_DS}, {_bands_sql(_REG, 'sm')} SELECT * FROM bands", P)
def _(v):
    return de.region_bands(de.density_map(v.pixels, v.canvases, sigma=0.9), v.canvases, _REG)


@query("grid_bands_m9", f"WITH {_D}, {_bands_sql(de.grid_regions(), 'dens')} SELECT * FROM bands", P)
def _(v):
    return de.suggest_bands(de.ink_density(v.pixels), v.canvases, [{"name": "no region"}])


_BLK = """blk AS (SELECT image_id, gy, gx, CAST(ceil((y + 1) * gy / h) - 1 AS INT) AS by_, CAST(ceil((x + 1) * gx / w) - 1 AS INT) AS bx_, avg(d) AS mean_d
 FROM (SELECT *, greatest(1, h // 4) AS gy, greatest(1, w // 4) AS gx FROM {src} JOIN canvases USING (image_id)) GROUP BY 1, 2, 3, 4, 5)"""


@query("block_means_m10", f"WITH {_D}, {_BLK.format(src='dens')} SELECT image_id, by_ AS by, bx_ AS bx, round(mean_d, 6) AS mean_d FROM blk", P)
def _(v):
    return _r(de.block_means(de.ink_density(v.pixels), v.canvases, 4), "mean_d").select("image_id", "by", "bx", "mean_d")


_HOT = f"""{_BLK}, thr AS (SELECT image_id, quantile_cont(mean_d, 0.85) AS t FROM blk GROUP BY 1), hot AS (SELECT image_id, by_ AS y, bx_ AS x, mean_d, gy, gx FROM blk JOIN thr USING (image_id) WHERE t > 0 AND mean_d >= t),
{rs.components('cc', 'hot', 'image_id')}, {rs.stats('st', 'cc', 'image_id')},
hs AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, label) AS INT) AS rank FROM (SELECT image_id, round(lft / gx, 4) AS rx0, round(top / gy, 4) AS ry0, round((lft + bw) / gx, 4) AS rx1, round((top + bh) / gy, 4) AS ry1, round(sc, 4) AS score, area AS blocks, label
 FROM st JOIN (SELECT image_id, label, avg(mean_d) AS sc, any_value(gy) AS gy, any_value(gx) AS gx FROM cc JOIN hot USING (image_id, y, x) GROUP BY 1, 2) USING (image_id, label)))"""


@query("hotspots_g3_k3", f"WITH RECURSIVE {_D}, {_HOT.format(src='dens')} SELECT * EXCLUDE (label) FROM hs WHERE rank <= 5", P)
def _(v):
    return de.hotspots(de.ink_density(v.pixels), v.canvases, block=4)


@query("density_histogram_m33", f"WITH {_D} SELECT image_id, CAST(least(63, floor(d * 64)) AS INT) AS bin, count(*) AS n FROM dens WHERE d BETWEEN 0 AND 1 GROUP BY 1, 2", P)
def _(v):
    return de.histogram(de.ink_density(v.pixels))


@query("density_band_layer_g8", f"""WITH RECURSIVE {_D}, src AS (SELECT image_id, 'band' AS layer, y, x FROM dens JOIN canvases USING (image_id) WHERE d BETWEEN 0.05e0 AND 0.3e0 AND x >= floor(0.1e0 * w) AND x < floor(0.9e0 * w) AND y >= floor(0.1e0 * h) AND y < floor(0.9e0 * h)),
{rs.closing('cl', 'src', rs.rect(3, 3))}, {rs.opening('op', 'cl', rs.rect(2, 2))}, {rs.components('cc', 'op')} SELECT image_id, layer, y, x FROM cc JOIN (SELECT image_id, layer, label FROM cc GROUP BY 1, 2, 3 HAVING count(*) >= 6) USING (image_id, layer, label)""", P)
def _(v):
    return de.band_mask(de.ink_density(v.pixels), v.canvases, 0.05, 0.3, (0.1, 0.1, 0.9, 0.9), close=3, open_=2, min_blob=6)


@query("refined_masks_g9", f"""WITH {_D}, src AS (SELECT image_id, layer, y, x FROM mask_px JOIN dens USING (image_id, y, x) WHERE d > 0.12e0), {rs.closing('cl', 'src', rs.rect(3, 3))}, {rs.opening('op', 'cl', rs.rect(3, 3))}
SELECT image_id, layer, pixels, round(br, 6) AS bbox_ratio, CASE WHEN layer <> '10_frame' AND br > 0.5 THEN 'diffuse' END AS diffuse_reason FROM (SELECT image_id, layer, count(*) AS pixels, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) / any_value(h * w) AS br FROM op JOIN canvases USING (image_id) GROUP BY 1, 2)""", M)
def _(v):
    out = de.recovered_layers(de.refine_masks(v.masks, de.ink_density(v.pixels), v.canvases, close=3, open_=3), v.canvases)
    return _r(out, "bbox_ratio")


@query("auto_tune_x5", f"""WITH RECURSIVE {_D}, {rs.gauss('sm', 'dens', 'd', sigma=0.9)}, {_HOT.format(src='sm')}, {_bands_sql(de.grid_regions(), 'sm')}
SELECT image_id, 'percentile' AS kind, n AS label, v1, CAST(NULL AS DOUBLE) AS v2 FROM (SELECT image_id, 'p50' AS n, round(quantile_cont(d, 0.5), 4) AS v1 FROM sm GROUP BY 1 UNION ALL SELECT image_id, 'p95', round(quantile_cont(d, 0.95), 4) FROM sm GROUP BY 1)
UNION ALL SELECT image_id, 'hotspot', CAST(rank AS VARCHAR), score, CAST(blocks AS DOUBLE) FROM hs WHERE rank <= 5 UNION ALL SELECT image_id, 'band', region, density_min, density_max FROM bands""", P)
def _(v):
    tuned = jobs.auto_tune(v.pixels, v.canvases, sigma=0.9, block=4)
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.round(n, 4).alias("v1")) for n in ("p50", "p95")]))
    out = tuned["percentiles"].select("image_id", F.lit("percentile").alias("kind"), arms.alias("a")).select("image_id", "kind", "a.label", "a.v1", F.lit(None).cast("double").alias("v2"))
    hs = tuned["regions"].select("image_id", F.lit("hotspot").alias("kind"), F.col("rank").cast("string").alias("label"), F.col("score").alias("v1"), F.col("blocks").cast("double").alias("v2"))
    bands = tuned["bands"].select("image_id", F.lit("band").alias("kind"), F.col("region").alias("label"), F.col("density_min").alias("v1"), F.col("density_max").alias("v2"))
    return out.unionByName(hs).unionByName(bands)


# ---- comparison ------------------------------------------------------------

@query("lowfreq_rmse_m17", f"""WITH a AS (SELECT image_id, y, x, CAST(r AS DOUBLE) AS v FROM pixels), b AS (SELECT image_id, y, x, CAST(g AS DOUBLE) AS v FROM pixels), {rs.gauss('sa', 'a', 'v', sigma=16.0)}, {rs.gauss('sb', 'b', 'v', sigma=16.0)}
SELECT image_id, round(sqrt(avg(pow(sa.v - sb.v, 2))), 6) AS rmse_lowfreq FROM sa JOIN sb USING (image_id, y, x) GROUP BY 1""", P)
def _(v):
    # smoothing is linear: the difference is smoothed once
    diff = v.pixels.select("image_id", "y", "x", (F.col("r") - F.col("g")).cast("double").alias("v"))
    sm = grid.gaussian(diff, v.canvases, "v", 16.0).withColumn("zero", F.lit(0.0))
    return _r(au.rmse(sm, [("v", "zero")], ["image_id"], "rmse_lowfreq"), "rmse_lowfreq")


@query("reduced_pixels_c33", "SELECT image_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(avg(gray), 6) AS gray FROM pixels GROUP BY 1, 2, 3", P)
def _(v):
    dst = v.canvases.select("image_id", (F.col("h") / 2).cast("int").alias("h"), (F.col("w") / 2).cast("int").alias("w"))
    return _r(grid.resample(v.pixels, v.canvases, dst), "gray")


@query("enlarged_pixels_c33", """
SELECT p.image_id, CAST(p.y * 2 + dy AS INT) AS y, CAST(p.x * 3 + dx AS INT) AS x, CAST(p.gray AS DOUBLE) AS gray FROM pixels p, (VALUES (0), (1)) a(dy), (VALUES (0), (1), (2)) b(dx)""", P)
def _(v):
    dst = v.canvases.select("image_id", (F.col("h") * 2).alias("h"), (F.col("w") * 3).alias("w"))
    return grid.resample(v.pixels, v.canvases, dst)


# ---- regions ---------------------------------------------------------------

@query("otsu_thresholds_w9", """
WITH h AS (SELECT image_id, gray, count(*) AS n FROM pixels GROUP BY 1, 2), c AS (SELECT image_id, gray, sum(n) OVER w AS w0, sum(n * gray) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * gray) OVER (PARTITION BY image_id) AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY gray)),
b AS (SELECT image_id, gray, round(CASE WHEN w > w0 THEN CAST(w0 AS DOUBLE) * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END / w / w, 9) AS v FROM c) SELECT image_id, min_by(gray, (-v, gray)) AS threshold FROM b GROUP BY 1""", P)
def _(v):
    return sg.otsu_threshold(v.pixels)


_FRAMED = "SELECT image_id, y, x, CASE WHEN x < 3 OR x >= 17 OR y < 9 OR y >= 140 THEN CAST(gray // 32 AS INT) ELSE CAST(140 + gray // 32 AS INT) END AS gray FROM pixels"


def _framed(v):
    return v.spark.sql(_FRAMED.replace("gray // 32", "floor(gray / 32)").replace("pixels", "{px}"), px=v.pixels)


@query("painting_roi_w3", f"""WITH fr AS ({_FRAMED}), l AS (SELECT image_id, 'y' AS ax, y AS p, any_value(h) AS n, avg(gray) AS m FROM fr JOIN canvases USING (image_id) GROUP BY 1, y UNION ALL SELECT image_id, 'x', x, any_value(w), avg(gray) FROM fr JOIN canvases USING (image_id) GROUP BY 1, x),
e AS (SELECT image_id, greatest(2, least(12, h // 8, w // 8)) AS eb FROM canvases), ed AS (SELECT image_id, quantile_cont(m, 0.5) AS edge FROM l JOIN e USING (image_id) WHERE p < eb OR p >= n - eb GROUP BY 1),
inn AS (SELECT image_id, quantile_cont(gray, 0.5) AS inn FROM fr JOIN canvases USING (image_id) WHERE y >= h // 4 AND y < 3 * h // 4 AND x >= w // 4 AND x < 3 * w // 4 GROUP BY 1),
nr AS (SELECT image_id, ax, p, p - row_number() OVER (PARTITION BY image_id, ax ORDER BY p) AS g FROM l JOIN ed USING (image_id) JOIN inn USING (image_id) WHERE abs(m - inn) < abs(m - edge)),
runs AS (SELECT image_id, ax, min(p) AS s, max(p) + 1 AS e FROM nr GROUP BY 1, 2, g HAVING count(*) >= 8),
b AS (SELECT image_id, coalesce(min(s) FILTER (ax = 'y'), 0) AS t, coalesce(max(e) FILTER (ax = 'y'), any_value(h)) AS b, coalesce(min(s) FILTER (ax = 'x'), 0) AS l, coalesce(max(e) FILTER (ax = 'x'), any_value(w)) AS r, any_value(h) AS h, any_value(w) AS w FROM canvases LEFT JOIN runs USING (image_id) GROUP BY 1),
f AS (SELECT *, abs(inn - edge) < 10 OR (b - t > 0.98 * h AND r - l > 0.98 * w) AS whole FROM b JOIN ed USING (image_id) JOIN inn USING (image_id))
SELECT image_id, CAST(CASE WHEN whole THEN 0 ELSE t END AS INT) AS top, CAST(CASE WHEN whole THEN h ELSE b END AS INT) AS btm, CAST(CASE WHEN whole THEN 0 ELSE l END AS INT) AS lft, CAST(CASE WHEN whole THEN w ELSE r END AS INT) AS rgt FROM f""", P)
def _(v):
    return sg.painting_roi(_framed(v), v.canvases)


@query("sample_panel_w4", f"""WITH fr AS ({_FRAMED}), c AS (SELECT a.image_id, a.x, avg(CASE WHEN abs(b.gray - a.gray) > 12 THEN 1e0 ELSE 0e0 END) AS s FROM fr a JOIN fr b ON a.image_id = b.image_id AND a.y = b.y AND b.x = a.x + 1 GROUP BY 1, 2),
r AS (SELECT a.image_id, a.y, avg(CASE WHEN abs(b.gray - a.gray) > 12 THEN 1e0 ELSE 0e0 END) AS s FROM fr a JOIN fr b ON a.image_id = b.image_id AND a.x = b.x AND b.y = a.y + 1 GROUP BY 1, 2),
cc AS (SELECT image_id, min(x) AS lft, max(x) AS rgt, count(*) AS nx FROM c WHERE s >= 0.65 GROUP BY 1), rr AS (SELECT image_id, min(y) AS top, max(y) AS btm, count(*) AS ny FROM r WHERE s >= 0.65 GROUP BY 1)
SELECT image_id, top, btm, lft, rgt FROM cc JOIN rr USING (image_id) JOIN canvases USING (image_id) WHERE nx >= 2 AND ny >= 2 AND h >= 16 AND w >= 16 AND rgt - lft >= 0.2 * w AND btm - top >= 0.2 * h AND lft > 0.01 * w AND top > 0.01 * h AND rgt < w - 1 - 0.01 * w AND btm < h - 1 - 0.01 * h""", P)
def _(v):
    return sg.sample_panel(_framed(v), v.canvases, persistence=0.65)


@query("fold_seams_w10", """
WITH f AS (SELECT image_id, i AS fold, x, avg(gray) AS m FROM pixels JOIN canvases USING (image_id), (VALUES (1), (2), (3), (4), (5)) t(i) WHERE y >= 50 AND y < h - 50 AND x >= greatest(0, floor(w * (i / 6e0)) - 3) AND x < least(w, floor(w * (i / 6e0)) + 3) GROUP BY 1, 2, 3)
SELECT image_id, fold, min_by(x, (m, x)) AS seam_x FROM f GROUP BY 1, 2""", P)
def _(v):
    roi = v.canvases.select("image_id", F.lit(0).alias("top"), F.col("h").alias("btm"), F.lit(0).alias("lft"), F.col("w").alias("rgt"))
    return sg.fold_seams(v.pixels, roi, v.canvases, reach=3)


@query("blob_instances_g4_w1", f"""WITH RECURSIVE med AS (SELECT image_id, quantile_cont(gray, 0.5) AS m FROM pixels GROUP BY 1),
cf(layer, x0, y0, x1, y1, delta, mn, mx, ar) AS (VALUES ('000', 0.1e0, 0.1e0, 0.6e0, 0.5e0, 20e0, 4, 300, 4e0), ('001', 0.5e0, 0.4e0, 0.95e0, 0.9e0, 10e0, 5, 300, 3e0)),
rc AS (SELECT image_id, layer, CAST(floor(x0 * w) AS INT) AS ox, CAST(floor(y0 * h) AS INT) AS oy, CAST(floor(x1 * w) AS INT) AS ex, CAST(floor(y1 * h) AS INT) AS ey, delta, mn, mx, ar FROM canvases, cf),
src AS (SELECT image_id || '/' || layer AS image_id, 'r' AS layer, y - oy AS y, x - ox AS x FROM pixels JOIN med USING (image_id) JOIN rc USING (image_id) WHERE x >= ox AND x < ex AND y >= oy AND y < ey AND gray < m - delta),
rcan AS (SELECT image_id || '/' || layer AS image_id, ey - oy AS h, ex - ox AS w FROM rc), {rs.opening('op', 'src', rs.rect(2, 2), canv='rcan')}, {rs.components('cc', 'op')}, {rs.stats('st', 'cc')},
ok AS (SELECT st.image_id AS key, label, row_number() OVER (PARTITION BY st.image_id ORDER BY cx, label) AS r, rc.image_id AS img, rc.layer AS cfg, ox, oy FROM st JOIN rc ON st.image_id = rc.image_id || '/' || rc.layer WHERE area BETWEEN mn AND mx AND greatest(bw, bh) / greatest(1, least(bw, bh)) <= ar),
nm AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY cfg, r) AS k FROM ok WHERE r <= 20)
SELECT img AS image_id, 'blob_' || lpad(CAST(k AS VARCHAR), 2, '0') AS layer, y + oy AS y, x + ox AS x FROM cc JOIN nm ON nm.key = cc.image_id AND nm.label = cc.label""", P)
def _(v):
    cfg = [{"region": (0.1, 0.1, 0.6, 0.5), "ink_delta": 20, "min_blob_px": 4, "max_blob_px": 300, "max_aspect_ratio": 4.0},
           {"region": (0.5, 0.4, 0.95, 0.9), "ink_delta": 10, "min_blob_px": 5, "max_blob_px": 300, "max_aspect_ratio": 3.0}]
    return sg.blob_instances(v.pixels, v.canvases, cfg)


_HSV = """hv AS (SELECT *, CAST(floor((CASE WHEN hh < 0 THEN hh + 360 ELSE hh END) / 2 + 0.5) AS INT) % 180 AS h8, CAST(floor(CASE WHEN v = 0 THEN 0 ELSE 255e0 * d / v END + 0.5) AS INT) AS s8 FROM (SELECT *, CASE WHEN d = 0 THEN 0e0 WHEN v = r THEN 60e0 * (g - b) / d WHEN v = g THEN 120e0 + 60e0 * (b - r) / d ELSE 240e0 + 60e0 * (r - g) / d END AS hh
 FROM (SELECT *, greatest(b, g, r) AS v, CAST(greatest(b, g, r) - least(b, g, r) AS DOUBLE) AS d FROM lab8)))"""
_CLS = f"""{LAB_SQL}, {_HSV}, red AS (SELECT image_id, y, x FROM hv WHERE (h8 < 15 OR h8 > 165) AND s8 > 35 AND a8 > 136), {rs.components('rc', 'red', 'image_id')}, {rs.stats('rst', 'rc', 'image_id')},
sl0 AS (SELECT image_id, 'seal' AS layer, y, x FROM rc JOIN (SELECT image_id, label FROM rst WHERE area BETWEEN 6 AND 30000 AND bw / bh BETWEEN 0.3 AND 3) USING (image_id, label)), {rs.closing('sl1', 'sl0', rs.ellipse(3))},
sl AS (SELECT image_id, y, x FROM sl1 WHERE image_id IN (SELECT image_id FROM sl1 GROUP BY 1 HAVING count(*) > 30)),
ink AS (SELECT image_id, y, x FROM pixels WHERE gray < 70), l1 AS (SELECT * FROM ink ANTI JOIN sl USING (image_id, y, x)), {rs.components('tc', 'l1', 'image_id')}, {rs.stats('tst', 'tc', 'image_id')},
tx0 AS (SELECT image_id, y, x FROM tc JOIN (SELECT image_id, label FROM tst JOIN canvases USING (image_id) WHERE area BETWEEN 6 AND 3000 AND top < floor(h * 0.45) AND greatest(bw, bh) < 150 AND (lft > floor(w * 0.75) OR lft < floor(w * 0.25))) USING (image_id, label)),
tx AS (SELECT * FROM tx0 WHERE image_id IN (SELECT image_id FROM tx0 GROUP BY 1 HAVING count(*) > 30)), l2 AS (SELECT * FROM l1 ANTI JOIN tx USING (image_id, y, x)), {rs.components('bc', 'l2', 'image_id')}, {rs.stats('bst', 'bc', 'image_id')},
bd AS (SELECT image_id, y, x FROM bc JOIN (SELECT image_id, label FROM bst JOIN canvases USING (image_id) WHERE area BETWEEN 6 AND 400 AND top < floor(h * 0.5) AND greatest(bw, bh) <= 60 AND lft < floor(w * 0.75)) USING (image_id, label))"""


@query("component_classes_g5", f"WITH RECURSIVE {_CLS} SELECT image_id, 'seal' AS layer, y, x FROM sl UNION ALL SELECT image_id, 'inscription', y, x FROM tx UNION ALL SELECT image_id, 'bird', y, x FROM bd", P)
def _(v):
    return sg.component_classes(v.pixels, v.pixels.where("gray < 70").select("image_id", "y", "x"), v.canvases, seal_min=6)


_SOBEL = f"""sob AS (SELECT c.image_id, c.y, c.x, abs(CAST(sum(p.gray * k.wx) AS INT)) AS gx, abs(CAST(sum(p.gray * k.wy) AS INT)) AS gy FROM (SELECT * FROM pixels JOIN canvases USING (image_id)) c
 CROSS JOIN (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) k(dy, dx, wx, wy)
 JOIN pixels p ON p.image_id = c.image_id AND p.y = {rs.reflect('c.y + k.dy', 'c.h')} AND p.x = {rs.reflect('c.x + k.dx', 'c.w')} GROUP BY 1, 2, 3)"""
_BLD = f"""{_SOBEL}, ink AS (SELECT image_id, y, x FROM pixels WHERE gray < 150), fh AS (SELECT image_id, 'h' AS layer, y, x FROM sob JOIN ink USING (image_id, y, x) WHERE gy > 40), fv AS (SELECT image_id, 'v' AS layer, y, x FROM sob JOIN ink USING (image_id, y, x) WHERE gx > 40),
{rs.opening('oh', 'fh', rs.rect(1, 5))}, {rs.opening('ov', 'fv', rs.rect(5, 1))}, dn AS (SELECT DISTINCT image_id, 'env' AS layer, y, x FROM (SELECT * FROM oh UNION ALL SELECT * FROM ov)), {rs.closing('env', 'dn', rs.rect(3, 3))}, {rs.components('ec', 'env')}, {rs.stats('est', 'ec')},
best AS (SELECT image_id, label, lft, top, bw, bh FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS rn FROM est WHERE area > 20) WHERE rn = 1), hull AS (SELECT image_id, y, x FROM ec SEMI JOIN best USING (image_id, label))"""


@query("buildings_g6", f"WITH RECURSIVE {_BLD} SELECT image_id, 'building' AS layer, y, x FROM ink SEMI JOIN hull USING (image_id, y, x) UNION ALL SELECT image_id, 'figures', y, x FROM ink JOIN best USING (image_id) JOIN canvases USING (image_id) WHERE y >= top + floor(bh * 0.25) AND y < least(h, top + bh) AND x >= lft AND x < lft + floor(bw * 0.65)", P)
def _(v):
    ink = v.pixels.where("gray < 150").select("image_id", "y", "x")
    b, box = sg.buildings(v.pixels, ink, v.canvases, run=5, close=3, min_area=20)
    return b.select("image_id", F.lit("building").alias("layer"), "y", "x").unionByName(
        sg.figures_near(ink, box, v.canvases).select("image_id", F.lit("figures").alias("layer"), "y", "x"))


@query("distant_wash_g6", f"""WITH med AS (SELECT image_id, quantile_cont(gray, 0.5) AS m FROM pixels GROUP BY 1), src AS (SELECT image_id, 'wash' AS layer, y, x FROM pixels JOIN med USING (image_id) WHERE gray >= m - 45 AND gray < m - 12 AND r > b), {rs.closing('o', 'src', rs.ellipse(5))} SELECT * FROM o""", P)
def _(v):
    return sg.distant_wash(v.pixels, v.pixels.where("r > b"), v.canvases, 5)


# ---- press work ------------------------------------------------------------

_CUT = """rw AS (SELECT image_id, y, count(*) AS n FROM void GROUP BY 1, 2), bd AS (SELECT image_id, min(y) AS bad FROM rw JOIN canvases USING (image_id) WHERE y >= {mn} AND y < least({mx}, h) AND n / w > {tear} GROUP BY 1),
cut AS (SELECT image_id, h, w, CAST(greatest({mn}, least(coalesce(bad, {mx}), {mx}, h) - 1) AS INT) AS sb FROM canvases LEFT JOIN bd USING (image_id)),
ct AS (SELECT image_id, sb AS safe_bottom_y, round((sb * w - (SELECT count(*) FROM void v WHERE v.image_id = cut.image_id AND v.y < sb)) / greatest(1, sb * w), 4) AS fabric_solid_ratio, round((SELECT count(*) FROM void v WHERE v.image_id = cut.image_id AND v.y = sb) / w, 4) AS tear_ratio_at_cut FROM cut)"""


@query("safe_cut_w2", f"WITH void AS (SELECT image_id, y, x FROM pixels WHERE gray > 215 AND r - b < 25), {_CUT.format(mn=20, mx=120, tear=0.12)} SELECT * FROM ct", P)
def _(v):
    return pl.safe_cut(v.pixels.where("gray > 215 AND r - b < 25"), v.canvases, 20, 120, 0.12)


_VOID = f"""lp AS (SELECT c.image_id, c.y, c.x, CAST(abs(u.gray + d.gray + l.gray + q.gray - 4 * c.gray) AS DOUBLE) AS lap FROM (SELECT * FROM pixels JOIN canvases USING (image_id)) c JOIN pixels u ON u.image_id = c.image_id AND u.x = c.x AND u.y = {rs.reflect('c.y - 1', 'c.h')}
 JOIN pixels d ON d.image_id = c.image_id AND d.x = c.x AND d.y = {rs.reflect('c.y + 1', 'c.h')} JOIN pixels l ON l.image_id = c.image_id AND l.y = c.y AND l.x = {rs.reflect('c.x - 1', 'c.w')} JOIN pixels q ON q.image_id = c.image_id AND q.y = c.y AND q.x = {rs.reflect('c.x + 1', 'c.w')}),
{rs.gauss('ls', 'lp', 'lap', weights=grid.gaussian_weights(1.4, radius=3))}, v0 AS (SELECT image_id, 'void' AS layer, y, x FROM pixels JOIN ls USING (image_id, y, x) WHERE gray > 215 AND (r - b < 25 OR lap < 4)),
{rs.dilate('v1', 'v0', rs.ellipse(7))}, {rs.dilate('v2', 'v1', rs.ellipse(7))}, {rs.erode('v3', 'v2', rs.ellipse(7))}, {rs.erode('void', 'v3', rs.ellipse(7))}"""


@query("void_pixels_w2", f"WITH {_VOID} SELECT image_id, y, x FROM void", P)
def _(v):
    return pl.void_pixels(v.pixels, v.canvases)


_DOG = f"""{rs.gauss('s1', 'pixels', 'gray', sigma=0.9)}, {rs.gauss('s2', 'pixels', 'gray', sigma=2.0)}, dog AS (SELECT image_id, y, x, s2.gray - s1.gray AS dog FROM s1 JOIN s2 USING (image_id, y, x)),
pk AS (SELECT d.image_id, d.y, d.x, d.dog FROM dog d WHERE d.dog > 4.5 AND NOT EXISTS (SELECT 1 FROM dog n WHERE n.image_id = d.image_id AND abs(n.y - d.y) + abs(n.x - d.x) = 1 AND n.dog > d.dog))"""


@query("micro_holes_w5", f"WITH {_DOG} SELECT image_id, y, x, round(dog, 4) AS dog FROM pk JOIN pixels USING (image_id, y, x) WHERE gray < 225", P)
def _(v):
    return _r(pl.micro_holes(v.pixels, v.canvases), "dog", places=4)


_SPOT = "spot AS (SELECT * FROM mask_px WHERE layer = '03_seal_01')"


@query("trap_spread_u4", f"""WITH {_SPOT}, {rs.dilate('wd', 'spot', rs.ellipse(3))}, band AS (SELECT * FROM wd SEMI JOIN (SELECT image_id, y, x FROM mask_px WHERE layer = '04_trees') USING (image_id, y, x))
SELECT image_id, layer, y, x, 'band' AS part FROM band UNION ALL (SELECT image_id, layer, y, x, 'spot' FROM spot UNION SELECT image_id, layer, y, x, 'spot' FROM band)""", M)
def _(v):
    spot, band = pl.trap(v.masks.where("layer = '03_seal_01'"), v.canvases, 1, v.masks.where("layer = '04_trees'"))
    return band.withColumn("part", F.lit("band")).unionByName(spot.withColumn("part", F.lit("spot")))


@query("trap_choke_u4", f"WITH spot AS (SELECT * FROM mask_px WHERE layer = '10_frame'), {rs.erode('er', 'spot', rs.ellipse(3))} SELECT image_id, layer, y, x FROM spot ANTI JOIN er USING (image_id, layer, y, x)", M)
def _(v):
    return pl.trap(v.masks.where("layer = '10_frame'"), v.canvases, 1, trap_type="choke")[1]


@query("trap_metrics_w8", f"""WITH {_SPOT}, {rs.dilate('wd', 'spot', rs.ellipse(5))} SELECT image_id, layer, count(*) AS spot_active_pixels, count(*) FILTER (s.y IS NULL) AS trap_band_pixels, round(count(*) / any_value(h * w), 4) AS spot_coverage_ratio, round(count(*) FILTER (s.y IS NULL) / count(*), 4) AS trap_expansion_ratio
FROM wd JOIN canvases USING (image_id) LEFT JOIN (SELECT image_id, y, x FROM spot) s USING (image_id, y, x) GROUP BY 1, 2""".replace("s.y IS NULL", "hit IS NULL").replace("(SELECT image_id, y, x FROM spot) s", "(SELECT image_id, y, x, 1 AS hit FROM spot) s"), M)
def _(v):
    spot, band = pl.trap(v.masks.where("layer = '03_seal_01'"), v.canvases, 2)
    return pl.trap_metrics(spot, band, v.canvases)


@query("foil_seeds_c8", f"WITH {LAB_SQL} SELECT image_id, y, x FROM lab8 WHERE r - b > 90 AND r - g > 35 AND a8 >= 140 AND y >= 10 AND y < 130", P)
def _(v):
    return pl.foil_seeds(v.pixels, band=(10, 130))


@query("split_foils_u3", f"""WITH {LAB_SQL}, valid AS (SELECT image_id, y, x FROM pixels WHERE x >= 2), cs AS (SELECT image_id, 'copper' AS layer, y, x FROM lab8 WHERE r - b > 20 AND r - g > 10 AND a8 >= 130 AND x >= 2), {rs.closing('c1', 'cs', rs.ellipse(3))}, {rs.opening('c2', 'c1', rs.ellipse(3))}
SELECT image_id, layer, y, x FROM c2 UNION ALL SELECT image_id, 'gold', y, x FROM valid ANTI JOIN (SELECT image_id, y, x FROM c2) q USING (image_id, y, x)""", P)
def _(v):
    return pl.split_foils(v.pixels, v.pixels.where("x >= 2"), v.canvases, close_k=3, rb=20.0, rg=10.0, lab_a=130.0)


_ORD = "ord(layer, pos) AS (VALUES ('08_geese_01', 1), ('04_trees', 2), ('05_cliffs', 3), ('03_seal_01', 4), ('13_Spot', 5))"
_ZONE = f"""{_ORD}, el AS (SELECT m.*, pos FROM mask_px m JOIN ord USING (layer) WHERE layer <> '03_seal_01'), tp AS (SELECT image_id, y, x, min(pos) AS tp FROM el GROUP BY 1, 2, 3), {rs.dilate('wd', 'el', rs.ellipse(5), keys='image_id, layer, pos')},
z0 AS (SELECT image_id, layer, y, x FROM wd JOIN tp USING (image_id, y, x) WHERE tp < pos), zn AS (SELECT * FROM z0 SEMI JOIN (SELECT image_id, layer FROM z0 GROUP BY 1, 2 HAVING count(*) > 20) USING (image_id, layer))"""


def _zones(v):
    order = v.masks.select("layer").distinct().select("layer", F.expr("CASE layer WHEN '08_geese_01' THEN 1 WHEN '04_trees' THEN 2 WHEN '05_cliffs' THEN 3 WHEN '03_seal_01' THEN 4 WHEN '13_Spot' THEN 5 END").alias("pos")).where("pos IS NOT NULL")
    order = v.masks.select("image_id", "layer").distinct().join(order, "layer")
    return pl.occlusion_zones(v.masks, order, v.canvases, extension=5)


@query("occlusion_zones_w11", f"WITH {_ZONE} SELECT image_id, layer, y, x FROM zn", M)
def _(v):
    return _zones(v)


@query("occlusion_metrics_w11", f"""WITH RECURSIVE {_ZONE}, zp AS (SELECT DISTINCT image_id, y, x FROM zn), {rs.components('cc', 'zp', 'image_id')}, {rs.stats('st', 'cc', 'image_id')}
SELECT c.image_id, coalesce(n, 0) AS reconstruction_pixel_count, round(coalesce(n, 0) / (h * w), 5) AS reconstruction_area_ratio, round(coalesce(d, 0), 2) AS max_component_diameter_px, coalesce(n, 0) / (h * w) <= 0.08 AS controlled FROM canvases c LEFT JOIN (SELECT image_id, count(*) AS n FROM zp GROUP BY 1) USING (image_id)
LEFT JOIN (SELECT image_id, max(sqrt(bw * bw + bh * bh)) AS d FROM st GROUP BY 1) USING (image_id)""", M)
def _(v):
    return pl.occlusion_metrics(_zones(v), v.canvases)


# the band's two-dimensional transform, one direction after the other; the surface's peak is the centroid of 5 x 5 places
_SEAM = """sb AS (SELECT image_id, y, x, gray, h, w, CAST(least(32, h // 4) AS INT) AS b FROM pixels JOIN canvases USING (image_id)), tp AS (SELECT image_id, y AS i, x, gray AS t FROM sb WHERE y < b), bt AS (SELECT image_id, y - h + b AS i, y, x, gray AS g, w, b FROM sb WHERE y >= h - b),
smooth AS (SELECT CAST(pow(2, p) * pow(3, q) * pow(5, r) AS BIGINT) AS v FROM generate_series(0, 12) a(p), generate_series(0, 8) c(q), generate_series(0, 5) d(r)),
sz AS (SELECT image_id, (SELECT min(v) FROM smooth WHERE v >= w) AS n, (SELECT min(v) FROM smooth WHERE v >= least(32, h // 4)) AS m FROM canvases WHERE h >= 4),
bd AS (SELECT image_id, i, x, sum(g) AS g, sum(t) AS t FROM (SELECT image_id, i, x, g, 0 AS t FROM bt UNION ALL SELECT image_id, i, x, 0, t FROM tp) GROUP BY 1, 2, 3),
f1 AS (SELECT image_id, i, k, n, m, sum(g * cos(u)) AS gr, -sum(g * sin(u)) AS gi, sum(t * cos(u)) AS tr, -sum(t * sin(u)) AS ti FROM (SELECT *, 2 * pi() * (k * x % n) / n AS u FROM (SELECT bd.*, n, m, unnest(range(n)) AS k FROM bd JOIN sz USING (image_id))) GROUP BY 1, 2, 3, 4, 5),
f2 AS (SELECT image_id, q, k, n, m, sum(gr * cos(u) + gi * sin(u)) AS ar, sum(gi * cos(u) - gr * sin(u)) AS ai, sum(tr * cos(u) + ti * sin(u)) AS br, sum(ti * cos(u) - tr * sin(u)) AS bi FROM (SELECT *, 2 * pi() * (q * i % m) / m AS u FROM (SELECT *, unnest(range(m)) AS q FROM f1)) GROUP BY 1, 2, 3, 4, 5),
f3 AS (SELECT image_id, q, k, n, m, pr * sqrt(pr * pr + pi * pi) / (pr * pr + pi * pi + 1.1920929e-07) AS cr, pi * sqrt(pr * pr + pi * pi) / (pr * pr + pi * pi + 1.1920929e-07) AS ci FROM (SELECT *, ar * br + ai * bi AS pr, ai * br - ar * bi AS pi FROM f2)),
f4 AS (SELECT image_id, r, k, n, m, sum(cr * cos(u) - ci * sin(u)) / m AS cr, sum(cr * sin(u) + ci * cos(u)) / m AS ci FROM (SELECT *, 2 * pi() * (q * r % m) / m AS u FROM (SELECT *, unnest(range(m)) AS r FROM f3)) GROUP BY 1, 2, 3, 4, 5),
f5 AS (SELECT image_id, n, (r + m // 2) % m AS y, (z + n // 2) % n AS x, round(sum(cr * cos(u) - ci * sin(u)) / n, 9) AS v FROM (SELECT *, 2 * pi() * (k * z % n) / n AS u FROM (SELECT *, unnest(range(n)) AS z FROM f4)) GROUP BY 1, 2, 3, 4),
pk AS (SELECT image_id, n, y AS py, x AS px FROM f5 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) = 1),
ce AS (SELECT image_id, round_even(any_value(pk.n) // 2 - sum(v * x) / (sum(v) + 2.220446049250313e-16), 0) AS s FROM f5 JOIN pk USING (image_id) WHERE abs(y - py) <= 2 AND abs(x - px) <= 2 GROUP BY 1),
shf AS (SELECT image_id, CAST(CASE WHEN abs(s) <= 5 THEN s ELSE 0 END AS INT) AS shift_x FROM canvases LEFT JOIN ce USING (image_id))"""


@query("seam_shift_w12", f"WITH {_SEAM} SELECT image_id, coalesce(shift_x, 0) AS shift_x FROM shf", P)
def _(v):
    return pl.seam_shift(v.pixels, v.canvases, max_shift=5)


@query("harmonized_seam_w12", f"""WITH {_SEAM}, w1 AS (SELECT bt.*, x - shift_x * i / b AS sx FROM bt JOIN shf USING (image_id)), w2 AS (SELECT *, CAST(floor(sx) AS INT) AS lo, sx - floor(sx) AS f FROM w1),
w3 AS (SELECT a.image_id, a.y, a.x, a.i, a.b, CAST(floor((1 - f) * p.g + f * q.g + 0.5) AS INT) AS v FROM w2 a JOIN bt p ON p.image_id = a.image_id AND p.y = a.y AND p.x = CASE WHEN lo < 0 THEN -1 - lo WHEN lo >= a.w THEN 2 * a.w - 1 - lo ELSE lo END
 JOIN bt q ON q.image_id = a.image_id AND q.y = a.y AND q.x = CASE WHEN lo + 1 < 0 THEN -2 - lo WHEN lo + 1 >= a.w THEN 2 * a.w - 2 - lo ELSE lo + 1 END),
mx AS (SELECT w3.image_id, w3.y, w3.x, CAST(floor((1 - hf) * v + hf * t) AS INT) AS v FROM (SELECT *, 0.25e0 * (1 - cos(pi() * i / (b - 1))) AS hf FROM w3) w3 JOIN tp USING (image_id, i, x))
SELECT image_id, y, x, gray AS v FROM sb WHERE y < h - b UNION ALL SELECT * FROM mx""", P)
def _(v):
    return pl.harmonize_seam(v.pixels, v.canvases, pl.seam_shift(v.pixels, v.canvases, max_shift=5))


@query("seam_rmse_w12", "SELECT image_id, round(sqrt(avg(pow(a.gray - b.gray, 2))), 3) AS seam_rmse FROM pixels a JOIN canvases USING (image_id) JOIN pixels b USING (image_id, x) WHERE a.y = 0 AND b.y = h - 1 GROUP BY 1", P)
def _(v):
    return pl.seam_rmse(v.pixels, v.canvases)


_PAN = """act AS (SELECT image_id, 5 AS top, h - 5 AS btm, 0 AS lft, w AS rgt FROM canvases), ik AS (SELECT image_id, y, x FROM pixels WHERE gray < 60),
pn AS (SELECT p.image_id, y, x, gray AS v, top, btm, CAST(floor(x / 5) AS INT) AS panel, (gray < 60) AS i FROM pixels p JOIN act USING (image_id) WHERE y >= top AND y < btm),
rp AS (SELECT image_id, min_by(panel, (n, panel)) AS rp FROM (SELECT image_id, panel, count(*) FILTER (i) AS n FROM pn GROUP BY 1, 2) GROUP BY 1),
rf AS (SELECT image_id, y, x, x - panel * 5 AS px, CASE WHEN i THEN CAST(floor(coalesce(m, md)) AS INT) ELSE v END AS v FROM pn JOIN rp USING (image_id) LEFT JOIN (SELECT image_id, x, avg(v) AS m FROM pn WHERE NOT i GROUP BY 1, 2) cm USING (image_id, x)
 LEFT JOIN (SELECT image_id, quantile_cont(v, 0.5) AS md FROM pn JOIN rp USING (image_id) WHERE rp.rp = panel AND NOT i GROUP BY 1) q USING (image_id) WHERE rp.rp = panel)"""


def _active(v):
    return v.canvases.select("image_id", F.lit(5).alias("top"), (F.col("h") - 5).alias("btm"), F.lit(0).alias("lft"), F.col("w").alias("rgt"))


@query("clean_reference_panel_m32", f"WITH {_PAN} SELECT image_id, y, x, v FROM rf", P)
def _(v):
    return pl.clean_reference(v.pixels, v.pixels.where("gray < 60"), _active(v), 4).select("image_id", "y", "x", "v")


@query("filled_panels_w15", f"""WITH {_PAN}, pm AS (SELECT image_id || '/' || panel AS image_id, y - top AS y, x - panel * 5 AS x, CASE WHEN i THEN 1e0 ELSE 0e0 END AS a FROM pn), pc AS (SELECT image_id, CAST(max(y) + 1 AS INT) AS h, CAST(max(x) + 1 AS INT) AS w FROM pm GROUP BY 1),
{rs.gauss('bl', 'pm', 'a', weights=grid.gaussian_weights(8.0, radius=12), canv='pc')}
SELECT pn.image_id, pn.y, pn.x, CASE WHEN panel = rp.rp THEN rf.v WHEN NOT bool_or(i) OVER (PARTITION BY pn.image_id, panel) THEN pn.v ELSE CAST(floor(pn.v * (1 - al) + rf.v * al + 1e-9) AS INT) END AS v
FROM (SELECT pn.*, greatest(bl.a, CASE WHEN i THEN 0.95e0 ELSE 0 END) AS al FROM pn JOIN bl ON bl.image_id = pn.image_id || '/' || panel AND bl.y = pn.y - top AND bl.x = pn.x - panel * 5) pn JOIN rp USING (image_id) JOIN rf ON rf.image_id = pn.image_id AND rf.y = pn.y AND rf.px = pn.x - panel * 5""", P)
def _(v):
    return pl.fill_panels(v.pixels, v.pixels.where("gray < 60"), _active(v), v.canvases, 4)


@query("flattened_light_c7", f"""WITH {LAB_SQL}, lm AS (SELECT image_id, y, x, CAST(l8 AS DOUBLE) AS l FROM lab8), {rs.gauss('il', 'lm', 'l', sigma=12.0)} SELECT image_id, y, x, round(greatest(0, least(255, lm.l - il.l + 230)), 5) AS l FROM lm JOIN il USING (image_id, y, x)""", P)
def _(v):
    return _r(pl.flatten_light(v.pixels, v.canvases, sigma=12.0), "l", places=5)


@query("plate_operators_x11", f"""WITH {_VOID}, {_CUT.format(mn='floor(h * 0.8)', mx='(h - 1)', tear=0.3)}, {_DOG}, {_SPOT}, {rs.dilate('wd', 'spot', rs.ellipse(3))}
SELECT image_id, 'contour_protection' AS operator, 'ok' AS status, CAST(safe_bottom_y AS BIGINT) AS n FROM ct
UNION ALL SELECT c.image_id, 'micro_holes', 'ok', (SELECT count(*) FROM pk JOIN pixels p USING (image_id, y, x) WHERE pk.image_id = c.image_id AND p.gray < 225) FROM canvases c
UNION ALL SELECT c.image_id, 'trapping', 'ok', (SELECT count(*) FROM wd ANTI JOIN spot USING (image_id, y, x) WHERE image_id = c.image_id) FROM canvases c
UNION ALL SELECT image_id, 'metallic_foil', 'disabled', 0 FROM canvases""", M)
def _(v):
    return pl.run_plate_operators(v.pixels, v.masks, v.canvases, {"contour_protection": {"max_tear": 0.3}, "micro_holes": {"enabled": True},
                                                                 "trapping": {"enabled": True, "spot_layer_name": "03_seal_01"}})


# ---- compositing -----------------------------------------------------------

_LP = """lp AS (SELECT image_id, y, x, z, layer_type, alpha, visible, opacity, blend, (gray * (z + 1)) % 256 AS c, (r + z * 31) % 256 AS m, (g + z * 17) % 256 AS yl, (b + z * 7) % 256 AS k,
 (r + z * 31) % 256 AS r, (g + z * 17) % 256 AS g, (b + z * 7) % 256 AS b FROM (SELECT image_id, y, x, b, g, r, gray, z, CASE WHEN z = 3 THEN 'diecut_mask' ELSE 'ink' END AS layer_type, CASE WHEN (x + y + z) % 3 = 0 THEN 0 ELSE (gray * (z + 2)) % 256 END AS alpha, NOT (z = 2 AND image_id = 1) AS visible, 255 - z * 40 AS opacity, CASE WHEN z = 1 THEN 'multiply' ELSE 'normal' END AS blend
 FROM pixels {z}))"""


def _stack(v):
    sql = _LP.format(z="LATERAL VIEW explode(array(0, 1, 2, 3)) t AS z").replace("FROM pixels", "FROM {px}")
    return v.spark.sql("WITH " + sql + " SELECT * FROM lp", px=v.pixels)


_LPD = _LP.format(z=", (VALUES (0), (1), (2), (3)) t(z)")


@query("print_composite_c30", f"""WITH {_LPD}, t AS (SELECT image_id, y, x, max_by((c, m, yl, k), z) FILTER (layer_type <> 'diecut_mask' AND alpha > 0) AS ink, bool_or(layer_type = 'diecut_mask' AND alpha = 0) AS hole FROM lp WHERE visible GROUP BY 1, 2, 3)
SELECT image_id, y, x, hole, CASE WHEN hole OR ink IS NULL THEN 0 ELSE ink[1] END AS c, CASE WHEN hole OR ink IS NULL THEN 0 ELSE ink[2] END AS m, CASE WHEN hole OR ink IS NULL THEN 0 ELSE ink[3] END AS yl, CASE WHEN hole OR ink IS NULL THEN 0 ELSE ink[4] END AS k FROM t""", P)
def _(v):
    return cp.composite_print(_stack(v))


def _fold_sql(kind):
    """Layer by layer over the pixel table, one CTE per layer."""
    if kind == "design":
        start = "SELECT image_id, y, x, 255 AS r, 255 AS g, 255 AS b FROM pixels"
        out = "s0 AS (" + start + ")"
        for z in range(4):
            ch = ", ".join(f"CASE WHEN l.y IS NULL THEN s.{c} ELSE CAST(floor(s.{c} * (1 - l.alpha / 255e0) + l.{c} * (l.alpha / 255e0) + 1e-9) AS INT) END AS {c}" for c in "rgb")
            out += f", s{z + 1} AS (SELECT s.image_id, s.y, s.x, {ch} FROM s{z} s LEFT JOIN (SELECT * FROM lp WHERE z = {z} AND visible) l ON (l.image_id, l.y, l.x) = (s.image_id, s.y, s.x))"
        return out
    out = "s0 AS (SELECT image_id, y, x, 0e0 AS r, 0e0 AS g, 0e0 AS b, 0e0 AS a FROM pixels)"
    for z in range(4):
        ch = ", ".join(f"CASE WHEN l.y IS NULL THEN s.{c} ELSE ((CASE WHEN blend = 'multiply' THEN s.{c} * (l.{c} / 255e0) ELSE l.{c} / 255e0 END) * l.al + s.{c} * s.a * (1 - l.al)) / greatest(l.al + s.a * (1 - l.al), 1e-6) END AS {c}" for c in "rgb")
        out += f", s{z + 1} AS (SELECT s.image_id, s.y, s.x, {ch}, CASE WHEN l.y IS NULL THEN s.a ELSE l.al + s.a * (1 - l.al) END AS a FROM s{z} s LEFT JOIN (SELECT *, alpha / 255e0 * (opacity / 255e0) AS al FROM lp WHERE z = {z} AND visible) l ON (l.image_id, l.y, l.x) = (s.image_id, s.y, s.x))"
    return out


@query("design_composite_c31", f"WITH {_LPD}, {_fold_sql('design')} SELECT * FROM s4", P)
def _(v):
    return cp.composite_design(_stack(v))


@query("composite_check_c32", f"WITH {_LPD}, {_fold_sql('check')} SELECT image_id, y, x, round(r * a + 1 - a, 6) AS r, round(g * a + 1 - a, 6) AS g, round(b * a + 1 - a, 6) AS b FROM s4", P)
def _(v):
    return _r(cp.composite_check(_stack(v)), "r", "g", "b")


# ---- fingerprints ----------------------------------------------------------

_GLOB = f"""{LAB_SQL}, gj AS (SELECT *, (y < floor(h * 0.1) OR x < floor(w * 0.1) OR y >= h - floor(h * 0.1) OR x >= w - floor(w * 0.1)) AS bd, (y >= floor(h * 0.15) AND y < h - floor(h * 0.15) AND x >= floor(w * 0.15) AND x < w - floor(w * 0.15)) AS ce FROM lab8 JOIN canvases USING (image_id))"""


@query("global_features_c12", f"""WITH {_GLOB} SELECT image_id, round(w / h, 6) AS aspect_ratio, round(h * w / 1e6, 6) AS megapixels, round(quantile_cont(l8, 0.5) FILTER (bd) * 100 / 255e0, 6) AS bg_l, quantile_cont(a8, 0.5) FILTER (bd) - 128 AS bg_a, quantile_cont(b8, 0.5) FILTER (bd) - 128 AS bg_b,
 round(quantile_cont(l8, 0.5) FILTER (ce) * 100 / 255e0, 6) AS center_l, quantile_cont(a8, 0.5) FILTER (ce) - 128 AS center_a, quantile_cont(b8, 0.5) FILTER (ce) - 128 AS center_b, round(sqrt(pow(avg(a8) - 128, 2) + pow(avg(b8) - 128, 2)), 6) AS saturation,
 round(sqrt(pow(avg(a8) FILTER (ce) - 128, 2) + pow(avg(b8) FILTER (ce) - 128, 2)), 6) AS center_saturation, round(stddev_pop(l8) * 100 / 255e0, 6) AS l_std FROM gj GROUP BY image_id, h, w""", P)
def _(v):
    g = fp.global_features(fp.lab_pixels(v.pixels), v.canvases).drop("h", "w")
    return _r(g, "aspect_ratio", "megapixels", "bg_l", "center_l", "saturation", "center_saturation", "l_std")


@query("lab_histograms_c12", f"""WITH {LAB_SQL}, lo AS (SELECT image_id, 'l' AS channel, l8 // 16 AS bin FROM lab8 UNION ALL SELECT image_id, 'a', a8 // 16 FROM lab8 UNION ALL SELECT image_id, 'b', b8 // 16 FROM lab8)
SELECT image_id, channel, CAST(bin AS INT) AS bin, round(count(*) / any_value(h * w), 6) AS share FROM lo JOIN canvases USING (image_id) GROUP BY 1, 2, 3""", P)
def _(v):
    return _r(fp.lab_histograms(fp.lab_pixels(v.pixels)), "share")


_GLCM = """q AS (SELECT image_id, y, x, gray // 16 AS q FROM pixels), pr AS (SELECT a.image_id, angle, a.q AS i, b.q AS j FROM q a, (VALUES ('a0', 0, 1), ('a45', 1, 1), ('a90', 1, 0), ('a135', 1, -1)) o(angle, dy, dx), q b WHERE b.image_id = a.image_id AND b.y = a.y + dy AND b.x = a.x + dx),
sy AS (SELECT image_id, angle, i, j FROM pr UNION ALL SELECT image_id, angle, j, i FROM pr), cn AS (SELECT image_id, angle, i, j, count(*) AS n FROM sy GROUP BY 1, 2, 3, 4), mu AS (SELECT image_id, angle, sum(n) AS t, sum(i * n) / sum(n) AS mu FROM cn GROUP BY 1, 2),
gl AS (SELECT image_id, angle, sqrt(sum(pow(n / t, 2))) AS energy, sum(n / t * (i - j) * (i - j)) AS contrast, sum(n / t / (1 + (i - j) * (i - j))) AS homogeneity, sum(n / t * (i - mu) * (j - mu)) / sum(n / t * pow(i - mu, 2)) AS correlation FROM cn JOIN mu USING (image_id, angle) GROUP BY 1, 2)"""


@query("glcm_features_c13", f"WITH {_GLCM} SELECT image_id, angle, round(energy, 6) AS energy, round(contrast, 6) AS contrast, round(homogeneity, 6) AS homogeneity, round(correlation, 6) AS correlation FROM gl", P)
def _(v):
    return _r(fp.glcm_features(v.pixels, v.canvases), "energy", "contrast", "homogeneity", "correlation")


def _lbp_sql():
    import math
    rows = []
    for i in range(24):
        dy, dx = round(-3 * math.sin(2 * math.pi * i / 24), 5), round(3 * math.cos(2 * math.pi * i / 24), 5)
        y0, x0 = math.floor(dy), math.floor(dx)
        fy, fx = dy - y0, dx - x0
        for a, b, wt in ((y0, x0, (1 - fx) * (1 - fy)), (y0, x0 + 1, fx * (1 - fy)), (y0 + 1, x0, (1 - fx) * fy), (y0 + 1, x0 + 1, fx * fy)):
            if wt:
                rows.append(f"({i}, {a}, {b}, {wt!r}::DOUBLE)")
    return f"""tp(i, dy, dx, wt) AS (VALUES {', '.join(rows)}), sm AS (SELECT p.image_id, p.y, p.x, t.i, (sum(t.wt * coalesce(n.gray, 0)) - any_value(p.gray) >= -1e-9) AS bit FROM pixels p CROSS JOIN tp t LEFT JOIN pixels n ON n.image_id = p.image_id AND n.y = p.y + t.dy AND n.x = p.x + t.dx GROUP BY 1, 2, 3, 4),
cg AS (SELECT image_id, y, x, bit, bit <> lag(bit, 1) OVER w AS ch, last_value(bit) OVER (PARTITION BY image_id, y, x ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastb, i FROM sm WINDOW w AS (PARTITION BY image_id, y, x ORDER BY i)),
lb AS (SELECT image_id, y, x, CASE WHEN count(*) FILTER (CASE WHEN i = 0 THEN bit <> lastb ELSE ch END) <= 2 THEN count(*) FILTER (bit) ELSE 25 END AS code FROM cg GROUP BY 1, 2, 3)"""


@query("lbp_histogram_c14", f"WITH {_lbp_sql()} SELECT image_id, CAST(least(15, code) AS INT) AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY image_id), 6) AS density FROM lb WHERE code <= 16 GROUP BY 1, 2", P)
def _(v):
    return _r(fp.lbp_histogram(fp.lbp_codes(v.pixels)), "density")


_CANNY = f"""cs AS (SELECT c.image_id, c.y, c.x, CAST(sum(p.gray * k.wx) AS INT) AS dx, CAST(sum(p.gray * k.wy) AS INT) AS dy FROM (SELECT * FROM pixels JOIN canvases USING (image_id)) c
 CROSS JOIN (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) k(dy, dx, wx, wy)
 JOIN pixels p ON p.image_id = c.image_id AND p.y = greatest(0, least(c.h - 1, c.y + k.dy)) AND p.x = greatest(0, least(c.w - 1, c.x + k.dx)) GROUP BY 1, 2, 3),
cm AS (SELECT *, abs(dx) + abs(dy) AS m FROM cs), cd AS (SELECT *, CASE WHEN abs(dy) * 32768 < abs(dx) * 13573 THEN 0 WHEN abs(dy) * 32768 > abs(dx) * 79109 THEN 2 WHEN (dx < 0) <> (dy < 0) THEN 3 ELSE 1 END AS dir FROM cm WHERE m > 50),
ca AS (SELECT d.image_id, d.y, d.x, d.m > 150 AS strong FROM cd d LEFT JOIN cm a ON a.image_id = d.image_id AND a.y = d.y - CASE dir WHEN 0 THEN 0 ELSE 1 END AND a.x = d.x + CASE dir WHEN 0 THEN -1 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE 1 END
 LEFT JOIN cm b ON b.image_id = d.image_id AND b.y = d.y + CASE dir WHEN 0 THEN 0 ELSE 1 END AND b.x = d.x + CASE dir WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END
 WHERE d.m > coalesce(a.m, 0) AND CASE WHEN dir % 2 = 1 THEN d.m > coalesce(b.m, 0) ELSE d.m >= coalesce(b.m, 0) END),
{rs.components('ec', 'ca', 'image_id')}, ed AS (SELECT image_id, y, x FROM ec WHERE (image_id, label) IN (SELECT image_id, label FROM ec JOIN ca USING (image_id, y, x) WHERE strong)),
de AS (SELECT image_id, coalesce(n, 0) / (h * w) AS edge_density FROM canvases LEFT JOIN (SELECT image_id, count(*) AS n FROM ed GROUP BY 1) USING (image_id))"""


@query("edge_pixels_c15", f"WITH RECURSIVE {_CANNY} SELECT image_id, y, x FROM ed", P)
def _(v):
    return fp.edge_pixels(v.pixels, v.canvases)


@query("edge_density_c15", f"WITH RECURSIVE {_CANNY} SELECT image_id, round(edge_density, 6) AS edge_density FROM de", P)
def _(v):
    return _r(fp.edge_density(v.pixels, v.canvases), "edge_density")


@query("structure_features_c15", f"""WITH RECURSIVE {_CANNY}, oh AS (SELECT image_id, gray, count(*) AS n FROM pixels GROUP BY 1, 2), oc AS (SELECT image_id, gray, sum(n) OVER w AS w0, sum(n * gray) OVER w AS s0, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * gray) OVER (PARTITION BY image_id) AS s FROM oh WINDOW w AS (PARTITION BY image_id ORDER BY gray)),
ot AS (SELECT image_id, min_by(gray, (-round(CASE WHEN w > w0 THEN CAST(w0 AS DOUBLE) * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END / w / w, 9), gray)) AS t FROM oc GROUP BY 1), fg AS (SELECT image_id, y, x FROM pixels JOIN ot USING (image_id) WHERE gray > t), {rs.components('cc', 'fg', 'image_id')}, {rs.stats('st', 'cc', 'image_id')},
ks AS (SELECT image_id, count(*) AS n, avg(area) AS m, stddev_pop(area) AS s, count(*) FILTER (greatest(bw, bh) / (least(bw, bh) + 1e-8) > 3 AND greatest(bw, bh) / (least(bw, bh) + 1e-8) < 20 AND area > 50) AS t FROM st GROUP BY 1)
SELECT image_id, round(edge_density, 6) AS edge_density, coalesce(n, 0) AS n_components, round(coalesce(m, 0) / (h * w), 6) AS area_mean, round(coalesce(s, 0) / (h * w), 6) AS area_std, round(coalesce(t, 0) / (coalesce(n, 0) + 1), 6) AS text_density
FROM de JOIN canvases USING (image_id) LEFT JOIN ks USING (image_id)""", P)
def _(v):
    return _r(fp.structure_features(v.pixels, v.canvases), "edge_density", "area_mean", "area_std", "text_density")


@query("embeddings_c16", """
WITH l AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM l GROUP BY 1),
e AS (SELECT vec_id, d, (v - m) / (CASE WHEN s = 0 THEN 1 ELSE s END + 1e-8) AS v FROM l JOIN s USING (d)) SELECT vec_id, CAST(128 AS INT) AS size, round(sum(v), 4) AS total, round(max(v) FILTER (d = 3), 6) AS third FROM e GROUP BY 1""")
def _(v):
    vec = v.embeddings.select("vec_id", F.col("embedding").alias("raw"))
    m = fp.fit_scaler(vec).first()
    out = fp.embed(vec, m["mean"], m["scale"])
    return out.select("vec_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.col("embedding")[2], 6).alias("third"))


@query("fitted_scaler_c17", """
WITH l AS (SELECT generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT CAST(d - 1 AS INT) AS d, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale FROM l GROUP BY 1""")
def _(v):
    s = fp.fit_scaler(v.embeddings.select(F.col("embedding").alias("raw")))
    return s.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("d", "z")).select("d", F.round("z.mean", 6).alias("mean"), F.round("z.scale", 6).alias("scale"))


@query("projected_embeddings_c17")
def _(v):
    vec = v.embeddings.select("vec_id", F.col("embedding").alias("raw"))
    mean, scale, comp = fp.fit_projection(vec)
    return fp.embed(vec, mean, scale, comp).select("vec_id", F.size("embedding").alias("size"), F.round(F.abs(F.col("embedding")[0]), 4).alias("first"))


@query("family_classifier_c18")
def _(v):
    samples = v.embeddings.select(F.concat(F.lit("fam"), F.col("label") % 3).alias("family"), F.col("embedding").alias("raw"))
    return au.classifier_report(fp.train_family_classifier(samples, trees=10)[1])


@query("classifier_inputs_x6")
def _(v):
    return _r(fp.classifier_inputs(v.pixels, v.canvases), "center_l", "center_saturation", "glcm_energy", "lbp_entropy", "edge_density")
