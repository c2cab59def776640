"""Thinning over tiles against steps pixel by pixel over the whole scene, and widths against all pairs."""

import math
import random

import numpy as np
import pytest

from plumeline.operators import image, thinning

RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def brute(pixels):
    """Both halves of a step, a pixel at a time, until nothing goes."""
    on = set(pixels)
    while True:
        before = len(on)
        for half in (0, 1):
            gone = set()
            for r, c in on:
                p = [(r + a, c + b) in on for a, b in RING]
                n, runs = sum(p), sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                trios = [(0, 2, 4), (2, 4, 6)] if half == 0 else [(0, 2, 6), (0, 4, 6)]
                block = [(r + a, c + b) for a in range(-1, 3) for b in range(-1, 3)]
                lone = {q for q in block if q in on} == {(r, c), (r + 1, c), (r, c + 1), (r + 1, c + 1)}
                if 2 <= n <= 6 and runs == 1 and not any(all(p[i] for i in t) for t in trios) and not lone:
                    gone.add((r, c))
            on -= gone
        if len(on) == before:
            return on


def shapes(draw):
    """Discs, bars, a ring, lone squares, noise."""
    a = {(r, c) for r in range(60) for c in range(70) if (r - 20) ** 2 + (c - 18) ** 2 <= 170 or 40 <= r <= 47 and 5 <= c <= 64 or 120 <= (r - 20) ** 2 + (c - 48) ** 2 <= 260}
    b = {(r, c) for r in range(40) for c in range(40) if draw.random() < 0.6}
    c = {(r, c + r // 2) for r in range(-10, 30) for c in range(4)} | {(50, 50), (50, 51), (51, 50), (51, 51), (80, 3)}
    return {"a": a, "b": b, "c": c}


def test_tiles_equal_the_whole_scene(spark):
    all_ = shapes(random.Random(1))
    rows = [(s, r, c, 1) for s, px in all_.items() for r, c in px] + [("a", 20, 18, 2), (None, 1, 1, 1), ("a", None, 1, 1)]
    df = spark.createDataFrame(rows, "scene_id string, r int, c int, kept int")
    for tile, reach in ((16, 8), (64, 32)):
        got = [tuple(p) for p in thinning.thinned(df, tile, reach).collect()]
        assert len(got) == len(set(got))
        for s, px in all_.items():
            assert {(r, c) for n, r, c in got if n == s} == brute(px)
    assert thinning.thinned(df.where("false"), 16, 8).count() == 0
    with pytest.raises(ValueError, match="reach"):
        thinning.thinned(df, 16, 6)


def test_regions_stay_joined():
    draw = np.random.default_rng(4)
    for share in (0.3, 0.5, 0.7, 0.85):
        m = np.pad(draw.random((80, 80)) < share, 1)
        before = image.label_components(m)
        t = m
        while True:
            nxt = thinning.peeled(thinning.peeled(t, False), True)
            if (nxt == t).all():
                break
            t = nxt
        after = image.label_components(t)
        pairs = {(int(before[r, c]), int(after[r, c])) for r, c in zip(*np.nonzero(t), strict=True)}
        assert len(pairs) == len({a for a, _ in pairs}) == len(np.unique(before[m]))


def test_widths_and_profiles(spark):
    all_ = shapes(random.Random(2))
    df = spark.createDataFrame([(s, r, c) for s, px in all_.items() for r, c in px], "scene_id string, r int, c int")
    got = {(p.scene_id, p.r, p.c): p.d for p in thinning.half_widths(df, df).collect()}
    for s, px in all_.items():
        edge = {(r + a, c + b) for r, c in px for a, b in RING} - px
        assert all(got[s, r, c] == pytest.approx(math.sqrt(min((r - y) ** 2 + (c - x) ** 2 for y, x in edge))) for r, c in px)
    assert len(got) == sum(map(len, all_.values()))
    profile = thinning.medial_profile(df, 50.0, 16, 8)
    rows = {(p.scene_id, p.r, p.c): p for p in profile.collect()}
    for s, px in all_.items():
        assert {(r, c) for n, r, c in rows if n == s} == brute(px)
        xy = np.array([(c * 50.0, -r * 50.0) for r, c in px])
        centre = xy.mean(0)
        axis = np.linalg.svd(xy - centre, full_matrices=False)[2][0]
        want = {k: float((np.array([k[2] * 50.0, -k[1] * 50.0]) - centre) @ axis) for k in rows if k[0] == s}
        sign = 1 if axis[0] >= 0 else -1
        assert all(rows[k].along_m == pytest.approx(sign * v, abs=1e-6) and rows[k].width_m == pytest.approx(100 * got[k]) for k, v in want.items())
    f = {p.scene_id: p for p in thinning.profile_figures(profile, df, 50.0).collect()}
    n = len(brute(all_["a"]))
    assert f["a"].axis_px == n and f["a"].mean_width_m == pytest.approx(len(all_["a"]) * 50 / n) and f["a"].aspect == pytest.approx(n * n / len(all_["a"]))
    assert thinning.medial_profile(df.where("scene_id = 'c' and r > 45"), 50.0).count() == 0


def test_many_tiles_are_thinned_in_one_call():
    draw = np.random.default_rng(7)
    for share in (0.4, 0.7, 0.9):
        m = np.pad(draw.random((5, 30, 33)) < share, ((0, 0), (3, 3), (3, 3)))
        g, r, c = np.nonzero(m)
        shuffled = draw.permutation(len(g))
        for steps in (2, 8):
            kept, late = thinning.peeled_places(g[shuffled], r[shuffled], c[shuffled], steps)
            told = np.zeros((2, *m.shape), bool)
            told[:, g[shuffled], r[shuffled], c[shuffled]] = kept, late
            for k, whole in enumerate(m):
                before = whole
                for j in range(steps):
                    before = whole if j == steps - 2 else before
                    whole = thinning.peeled(whole, bool(j % 2))
                assert (told[0, k] == whole).all() and (told[1, k] == (before & ~whole)).all()
