import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.operators import inks as ik

SCHEMA = "image_id int, c int, m int, yl int, k int"


def codes(*pct):
    return tuple(round(255 - p / 100 * 255) for p in pct)


def one(df):
    return df.first()


@pytest.fixture
def inks(frame):
    return lambda *rows: frame([(0, *r) for r in rows], SCHEMA)


def test_total_ink_meets_the_limit(inks):
    r = one(ik.limit_stats(ik.limit_ink(inks(codes(100, 100, 100, 100)), 300, 96)))
    assert r.tac_before_max == 400 and r.tac_after_max <= 300 and r.compliant


def test_black_is_kept_and_the_rest_shared(inks):
    r = one(ik.limit_ink(inks(codes(100, 100, 100, 80)), 300, 100))
    assert (255 - r.k2) / 255 * 100 == pytest.approx(80, abs=0.5)
    for ch in (r.c2, r.m2, r.yl2):
        assert (255 - ch) / 255 * 100 == pytest.approx((300 - 80) / 3, abs=0.5)


def test_black_cap_counts_every_pixel(inks):
    out = ik.limit_ink(inks(*[codes(0, 0, 0, 100)] * 5), 400, 95)
    assert all((255 - r.k2) / 255 * 100 <= 95 for r in out.collect())
    assert one(ik.limit_stats(out, limit_pct=400)).k_clipped_pixels == 5


def test_compliant_pixels_stay(inks):
    r = one(ik.limit_ink(inks(codes(20, 20, 20, 10))))
    assert (r.c2, r.m2, r.yl2, r.k2) == (r.c, r.m, r.yl, r.k) and not r.over and not r.k_over


def test_clip_ratio(inks):
    r = one(ik.limit_stats(ik.limit_ink(inks(*[codes(100, 100, 100, 90)] * 4, *[codes(10, 10, 10, 0)] * 4))))
    assert r.tac_clipped_pixels == 4 and r.tac_clipped_ratio == 0.5


def test_limiting_twice_changes_nothing(inks):
    rng = np.random.default_rng(0)
    rows = [tuple(int(v) for v in r) for r in rng.integers(0, 256, (200, 4))]
    once = ik.limit_ink(inks(*rows)).select("image_id", *[F.col(f"{c}2").alias(c) for c in ("c", "m", "yl", "k")])
    twice = ik.limit_ink(once)
    assert twice.where("c <> c2 OR m <> m2 OR yl <> yl2 OR k <> k2").count() == 0
    assert twice.agg(F.max(ik.tac_pct())).first()[0] <= 300 + 1e-9


def test_black_curve_moves_grey_from_colour(inks):
    src = inks(codes(50, 50, 50, 50))
    a, b = one(src), one(ik.black_generation(src, k_gain=1.2))
    dk = a.k - b.k
    assert dk > 0
    for ch in ("c", "m", "yl"):
        assert (b[ch] - a[ch]) == pytest.approx(dk, abs=1.5)


def test_black_curve_end_points_and_identity(inks):
    out = ik.black_generation(inks(codes(0, 0, 0, 0), codes(0, 0, 0, 100), codes(0, 0, 0, 50)), k_gamma=2.0).collect()
    assert [r.k for r in out[:2]] == [255, 0] and out[2].k > codes(0, 0, 0, 50)[3]
    src = inks(codes(1, 2, 3, 4))
    assert ik.black_generation(src) is src


def test_policy_order(frame):
    df = frame([("newsprint", None, None, "x"), (None, 280.0, None, ""), (None, None, None, "PSO Uncoated FOGRA47"), ("?", None, None, None)],
               "cond string, lim double, mk double, d string")
    pol = ik.resolve_policy(F.col("cond"), F.col("lim"), F.col("mk"), F.col("d"))
    rows = df.select(*[c.alias(n) for n, c in pol.items()]).collect()
    assert [(r.limit_pct, r.max_k_pct, r.condition_id) for r in rows] == [
        (240.0, 90.0, "newsprint"), (280.0, 97.0, "preset"), (260.0, 95.0, "iso_uncoated"), (300.0, 96.0, "eci_coated_practice")]
