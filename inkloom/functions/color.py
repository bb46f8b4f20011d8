"""Colour arithmetic as column expressions on 8-bit channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(c: Column) -> Column:
    """Truncate into 0..255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c.cast("double")))).cast("int")


def round_byte(c: Column) -> Column:
    return byte(F.floor(c + 0.5))


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma of a BGR pixel, rounded to the nearest code."""
    return round_byte(0.114 * b + 0.587 * g + 0.299 * r)


def _linear(c: Column) -> Column:
    u = c / 255.0
    return F.when(u > 0.04045, F.pow((u + 0.055) / 1.055, F.lit(2.4))).otherwise(u / 12.92)


def _lab_f(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Standard L*a*b* (D65): L in 0..100, neutral a and b at 0."""
    rl, gl, bl = _linear(r), _linear(g), _linear(b)
    x = (0.412453 * rl + 0.357580 * gl + 0.180423 * bl) / 0.950456
    y = 0.212671 * rl + 0.715160 * gl + 0.072169 * bl
    z = (0.019334 * rl + 0.119193 * gl + 0.950227 * bl) / 1.088754
    lum = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return lum, 500.0 * (_lab_f(x) - _lab_f(y)), 200.0 * (_lab_f(y) - _lab_f(z))


def lab8(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit coding of :func:`lab`: L scaled to 0..255, a and b around 128."""
    lum, a, bb = lab(b, g, r)
    return round_byte(lum * 255.0 / 100.0), round_byte(a + 128.0), round_byte(bb + 128.0)


def lab_from8(l8: Column, a8: Column, b8: Column) -> tuple[Column, Column, Column]:
    return l8 * (100.0 / 255.0), a8 - 128.0, b8 - 128.0


def hsv8(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """8-bit HSV with hue halved to 0..179."""
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    span = (v - low).cast("double")
    sat = F.when(v == 0, F.lit(0.0)).otherwise(255.0 * span / v)
    hue = F.when(span == 0, F.lit(0.0)).when(v == r, 60.0 * (g - b) / span) \
        .when(v == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    hue = F.when(hue < 0, hue + 360.0).otherwise(hue)
    return F.pmod(round_byte(hue / 2.0), F.lit(180)), round_byte(sat), v.cast("int")


def rgb_to_inverse_cmyk(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column, Column]:
    """Plain separation without colour management, stored inversely (255 = no ink); no black."""
    return r.cast("int"), g.cast("int"), b.cast("int"), F.lit(255)


def inverse_cmyk_to_rgb(c: Column, m: Column, yl: Column, k: Column) -> tuple[Column, Column, Column]:
    """Appearance of an inversely stored pixel: each channel times the black channel."""
    return c * k / 255.0, m * k / 255.0, yl * k / 255.0
