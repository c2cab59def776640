"""Local means, masks and ships over tiles, against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import masks
from plumeline.operators.image import label_components


def table(spark, arrays):
    rows = [(s, r, c, float(a[r, c])) for s, a in arrays.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    px = spark.createDataFrame(rows, "scene_id string, r int, c int, db double")
    return px, spark.createDataFrame([(s, *a.shape) for s, a in arrays.items()], "scene_id string, rows int, cols int")


def scenes():
    """A coast with a lake, points, gaps; and a sea smaller than a window."""
    draw = np.random.default_rng(2)
    a = draw.normal(-18, 1, (47, 38))
    a[:, 25:] += 14
    a[20:26, 29:34] -= 14
    a[5, 5], a[30:33, 8:11], a[40, 2] = 2.0, 6.0, 0.0
    a[12:14, 3:5] = np.nan
    return {"coast": a, "small": draw.normal(-18, 1, (4, 6))}


def steps(mask, k, grow=True):
    h, w = mask.shape
    for _ in range(k):
        old = mask.copy()
        for r in range(h):
            for c in range(w):
                near = [old[r, c]] + [bool(0 <= r + y < h and 0 <= c + x < w and old[r + y, c + x]) for y, x in ((1, 0), (-1, 0), (0, 1), (0, -1))]
                mask[r, c] = any(near) if grow else all(near)
    return mask


def brute(db, window, bright_steps, close, least, land_steps):
    has = np.isfinite(db) & (db != 0)
    h, w = db.shape
    whole = np.where(has, db, np.median(db[has]))
    half = window // 2
    at = lambda i, n: (i % (2 * n)) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    means = np.array([[np.mean([whole[at(r + y, h), at(c + x, w)] for y in range(-half, half + 1) for x in range(-half, half + 1)]) for c in range(w)] for r in range(h)])
    sea = np.percentile(means[has], 20)
    bright = steps(has & (db > -10), bright_steps)
    land = steps(steps((means > sea + 7) | ~has, close), close, grow=False)
    out = label_components(~land, diagonal=False)
    rim = np.unique(np.concatenate([out[0], out[-1], out[:, 0], out[:, -1]]))
    land = land | ~np.isin(out, rim) & (out > 0)
    lab = label_components(land, diagonal=False)
    land = steps(np.isin(lab, [k for k in range(1, lab.max() + 1) if (lab == k).sum() >= least]), land_steps)
    valid = has & ~bright & ~land
    return means, sea, valid, land, np.where(valid, db, sea)


@pytest.mark.parametrize("tile", [8, 64])
def test_prepared_scenes_equal_arrays(spark, tile):
    arrays = scenes()
    px, sizes = table(spark, arrays)
    got = masks.prepare(px, sizes, 1.0, window=7, bright_steps=2, close=2, least_km2=12.0, land_steps=3, tile=tile).collect()
    assert len(got) == sum(a.size for a in arrays.values())
    want = {s: brute(a, 7, 2, 2, 12, 3) for s, a in arrays.items()}
    for g in got:
        _, sea, valid, land, filled = want[g.scene_id]
        assert (g.valid, g.land) == (valid[g.r, g.c], land[g.r, g.c])
        assert g.sea_db == pytest.approx(sea, abs=1e-9) and g.filled == pytest.approx(filled[g.r, g.c], abs=1e-9)
    assert want["coast"][3].any() and want["coast"][2].any()


def test_awkward_scenes(spark):
    """No data at all, repeated and misplaced pixels, unknown scenes, clashing columns, empty tables."""
    px = spark.createDataFrame([("a", 0, 0, -18.0, 1), ("a", 0, 0, -17.0, 2), ("a", 9, 9, -17.0, 2), (None, 0, 0, -17.0, 2), ("x", 0, 0, -17.0, 2), ("b", 0, 0, None, 3)], "scene_id string, r int, c int, db double, land int")
    sizes = spark.createDataFrame([("a", 1, 2), ("b", 2, 2), (None, 3, 3)], "scene_id string, rows int, cols int")
    got = {(r.scene_id, r.r, r.c): (r.valid, r.land, r.sea_db) for r in masks.prepare(px, sizes, 0.01, window=3, tile=4).collect()}
    assert got == {("a", 0, 0): (True, False, -17.0), ("a", 0, 1): (False, False, -17.0), **{("b", r, c): (False, False, None) for r in range(2) for c in range(2)}}
    assert masks.prepare(px, sizes.where("false"), 1.0).count() == 0 == masks.ships(px.where("false"), sizes, 10.0).count()


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_quantiles_are_exact(spark, share):
    draw = np.random.default_rng(1)
    values = {"many": np.round(draw.normal(size=30_000), 3), "few": draw.normal(size=7), "same": np.ones(20_000)}
    v = spark.createDataFrame([(s, float(x)) for s, a in values.items() for x in a] + [("few", None)], "scene_id string, v double")
    got = {r.scene_id: r.q for r in masks.quantiles(v, share).collect()}
    assert got == {s: pytest.approx(np.percentile(a, 100 * share)) for s, a in values.items()}


def test_ships_equal_arrays(spark):
    """A hull with a dim pixel, near fragments, chains of near ones, a streak, specks and land."""
    db = np.random.default_rng(3).normal(-18, 1, (60, 70))
    for r, c, v in ((10, 10, 5.0), (10, 15, 4.0), (10, 20, 3.0), (10, 25, 6.0), (40, 30, 2.0), (55, 66, 1.0)):
        db[r : r + 2, c : c + 2] = v
    db[30:32, 50:55] = 3.0
    db[30:32, 52] = -17.0
    db[np.arange(40, 58), np.arange(40, 58)] = 2.0
    db[5, 60] = 5.0
    px, sizes = table(spark, {"s": db})
    land = spark.createDataFrame([("s", r, c) for r in range(38, 45) for c in range(28, 35)], "scene_id string, r int, c int")
    got = sorted((r.r, r.c, r.px_area, r.peak_db) for r in masks.ships(px, sizes, 10.0, exclude=land, tile=16).collect())
    mask = np.ones(db.shape, bool)
    mask[38:45, 28:35] = False
    med = np.median(db[mask])
    hot = mask & (db > max(-10, med + 4 * 1.4826 * np.median(np.abs(db[mask] - med))))
    lab = label_components(masks._closed_square(hot))
    found = []
    for k in range(1, lab.max() + 1):
        r, c = np.nonzero(lab == k)
        if 4 <= len(r) <= 4000 and len(r) / ((np.ptp(r) + 1) * (np.ptp(c) + 1)) >= 0.2:
            found.append([float(db[r, c].max()), r.mean(), c.mean(), len(r)])
    kept = []
    for f in sorted(found, key=lambda x: -x[0]):
        head = next((k for k in kept if np.hypot(k[1] - f[1], k[2] - f[2]) <= 5), None)
        if head:
            head[3] += f[3]
        else:
            kept.append(f)
    assert np.allclose(got, sorted((r, c, n, p) for p, r, c, n in kept))
    assert len(found) > len(kept) >= 4


def test_merging_goes_from_the_brightest(spark):
    """A line of contacts, each in reach of the next: every second one stays; ties go by label."""
    f = spark.createDataFrame([("s", k, 0.0, 4.0 * k, 10, float(9 - k)) for k in range(6)] + [("t", k, 0.0, 4.0 * k, 1, 1.0) for k in range(3)], "scene_id string, label long, r double, c double, px_area long, peak_db double")
    got = {(r.scene_id, r.label): r.px_area for r in masks.merged_contacts(f, 5.0).collect()}
    assert got == {("s", 0): 20, ("s", 2): 20, ("s", 4): 20, ("t", 0): 2, ("t", 2): 1}


def test_a_raster_is_made_from_its_pixels_in_one_shuffle_and_small_scenes_are_not_sketched(spark):
    """No join with every place; repeated, unusable and outlying pixels, scenes over several parts, and scenes without any."""
    from plumeline.operators import masks

    px = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 0, 2.0), ("a", 0, 1, float("nan")), ("a", 1, 0, 0.0), ("a", 5, 0, 3.0), ("a", -1, 0, 3.0), ("z", 0, 0, 1.0), (None, 0, 0, 1.0), ("w", 0, masks.TILE, 4.0)], "scene_id string, r int, c int, db double")
    scenes = spark.createDataFrame([("a", 2, 2), ("b", 1, 1), ("w", 1, masks.TILE + 1), (None, 1, 1)], "scene_id string, rows int, cols int")
    made = masks.raster(px, scenes)
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hashpartitioning(scene_id") <= 2
    got = {(r.scene_id, r.r, r.c): r.db for r in made.collect()}
    assert len(got) == 4 + 1 + masks.TILE + 1
    assert {k: v for k, v in got.items() if v is not None} == {("a", 0, 0): 2.0, ("w", 0, masks.TILE): 4.0}
    values = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0)], "scene_id string, v double")
    small = masks.quantiles(values, 0.5, scenes)
    assert "percentile_approx" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert {r.scene_id: r.q for r in small.collect()} == {"a": 1.5, "b": 5.0}
