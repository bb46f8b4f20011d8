"""Seam shift by phase correlation, on planted shifts and against one transform of the whole band."""

import numpy as np
import pytest

from inkloom.operators import phase
from inkloom.operators import plate as pl


def bands(spark, pictures):
    rows, sizes = [], []
    for name, p in pictures.items():
        sizes.append((name, *p.shape))
        rows += [(name, int(y), int(x), int(p[y, x])) for y, x in np.ndindex(*p.shape)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, gray int"), spark.createDataFrame(sizes, "image_id string, h int, w int")


def whole(p, band=32):
    b = min(band, p.shape[0] // 4)
    size = [phase.transform_length(n) for n in (b, p.shape[1])]
    cross = np.fft.fft2(p[-b:].astype(float), size) * np.conj(np.fft.fft2(p[:b].astype(float), size))
    mag = np.abs(cross)
    surface = np.round(np.fft.fftshift(np.fft.ifft2(cross * mag / (mag ** 2 + phase.EPS)).real), phase.DIGITS)
    return round(size[1] // 2 - phase.surface_peak(surface)[1])


@pytest.mark.parametrize("block", [7, 512])
def test_planted_shifts_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(phase, "BLOCK", block)
    rng, pictures = np.random.default_rng(3), {}
    for d, w in ((0, 60), (3, 60), (-4, 64), (9, 75), (2, 61)):
        p = rng.integers(0, 256, (24, w))
        p[:6] = np.roll(p[-6:], d, axis=1)  # the top band lies d pixels to the right of the bottom band
        pictures[f"{d}:{w}"] = p
    pixels, canvases = bands(spark, pictures)
    got = {r.image_id: r.shift_x for r in pl.seam_shift(pixels, canvases, max_shift=5).collect()}
    assert got["0:60"] == 0 and got["3:60"] == 3 and got["-4:64"] == -4
    assert got["9:75"] == 0  # too far
    for name, p in pictures.items():
        want = whole(p)
        assert got[name] == (want if abs(want) <= 5 else 0), name


def test_flat_and_small_images_do_not_shift(spark):
    pixels, canvases = bands(spark, {"low": np.arange(30).reshape(3, 10), "noise": np.random.default_rng(1).integers(0, 256, (16, 40))})
    more = spark.createDataFrame([("bare", 50, 50)], canvases.schema)
    got = {r.image_id: r.shift_x for r in pl.seam_shift(pixels, canvases.union(more)).collect()}
    assert got["low"] == 0 and got["bare"] == 0 and set(got) == {"low", "noise", "bare"}
    assert pl.seam_shift(pixels.limit(0), canvases.limit(0)).count() == 0


def test_transform_lengths():
    assert [phase.transform_length(n) for n in (1, 5, 7, 11, 61, 150, 301)] == [1, 5, 8, 12, 64, 150, 320]
