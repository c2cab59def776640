"""Dark spots over tiles against the same chain on whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import image, spots


def whole(filled, valid, sizes, close, least, extent):
    depth = image.depth_map(filled, sizes)
    med = np.median(depth[valid])
    mad = max(1.4826 * np.median(np.abs(depth[valid] - med)), 1e-3)
    weak = image.label_components(valid & (depth >= med + max(1.0, 1.5 * mad)))
    strong = np.unique(weak[valid & (depth >= med + max(2.0, 3.0 * mad)) & (weak > 0)])
    lab = image.label_components(image.closed(np.isin(weak, strong) & (weak > 0), close) & valid)
    r, c = np.indices(lab.shape)
    out = {}
    for k in range(1, lab.max() + 1):
        y, x = np.nonzero(lab == k)
        if len(y) < least and max(np.ptp(y), np.ptp(x)) + 1 < extent:
            continue
        away = np.full(lab.shape, 999)
        for a, b in zip(y, x, strict=True):
            away = np.minimum(away, abs(r - a) + abs(c - b))
        ring = valid & (away > 5) & (away <= 25)
        contrast = np.median(filled[lab == k]) - np.median(filled[ring]) if ring.any() else None
        out[y[0] * 2**32 + x[0]] = (len(y), depth[lab == k].mean(), depth[lab == k].max(), contrast)
    return out


def test_tiles_equal_the_whole_scene(spark):
    rng = np.random.default_rng(5)
    want, rows = {}, []
    for name, (h, w) in {"a": (70, 90), "b": (33, 40)}.items():
        db = -15 + rng.normal(0, 0.4, (h, w))
        y, x = np.indices((h, w))
        for r, c, a, b in ((20, 25, 6, 18), (50, 60, 9, 9), (12, 33, 3, 5)):
            db[((y - r) / a) ** 2 + ((x - c) / b) ** 2 <= 1] -= 5
        valid = ~((y > h - 8) | ((y - 21) ** 2 + (x - 28) ** 2 < 6))
        filled = np.where(valid, db, -15.0)
        want[name] = whole(filled, valid, (9, 25), 5, 12, 9)
        rows += [(name, int(i), int(j), float(filled[i, j]), bool(valid[i, j]), False, -15.0) for i in range(h) for j in range(w)]
    scenes = spark.createDataFrame([("a", 70, 90), ("b", 33, 40), ("empty", 20, 20)], "scene_id string, rows int, cols int")
    rows += [("empty", i, j, None, False, True, None) for i in range(20) for j in range(20)]
    prepared = spark.createDataFrame(rows, "scene_id string, r int, c int, filled double, valid boolean, land boolean, sea_db double")
    got = spots.dark_spots(prepared, scenes, 0.01, prepared=prepared, sizes=(9, 25), close=5, least_km2=0.115, least_extent=9, tile=16)
    found = {(p.scene_id, p.label): (p.n_px, p.mean_depth_db, p.max_depth_db, p.contrast_db) for p in got.collect()}
    assert len(want["a"]) >= 2 and set(found) == {(s, k) for s, v in want.items() for k in v}
    assert all(found[s, k] == pytest.approx(v) for s, per in want.items() for k, v in per.items())
    none = prepared.where(F.col("scene_id") == "empty")
    assert spots.dark_spots(none, scenes, 0.01, prepared=none, sizes=(9,), tile=16).count() == 0


def test_a_scene_within_a_tile_equals_its_tiles(spark):
    """Whole and over tiles, the same regions and figures; small scenes alone need no tiles, and their chain is one pass of Python."""
    rng = np.random.default_rng(8)
    rows = []
    for name, (h, w) in {"a": (40, 52), "b": (30, 33), "bare": (9, 12)}.items():
        db = -15 + rng.normal(0, 0.4, (h, w))
        y, x = np.indices((h, w))
        for r, c, a, b in ((14, 12, 5, 9), (27, 20, 2, 7)) if name != "bare" else ():
            db[((y - r) / a) ** 2 + ((x - c) / b) ** 2 <= 1] -= 5
        rows += [(name, i, j, float(db[i, j]), bool(i < h - 4 or j % 3 > 0), False, -15.0) for i in range(h) for j in range(w)]
    scenes = spark.createDataFrame([("a", 40, 52), ("b", 30, 33), ("bare", 9, 12), ("none", 5, 5)], "scene_id string, rows int, cols int")
    prepared = spark.createDataFrame(rows, "scene_id string, r int, c int, filled double, valid boolean, land boolean, sea_db double")
    made = [spots.dark_spots(prepared, scenes, 0.01, prepared=prepared, sizes=(9, 25), close=5, least_extent=9, tile=t) for t in (64, 16)]
    text = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "FlatMapGroups" not in text and "plumeline-staged" not in text
    whole, tiled = ({(p.scene_id, p.label): [p[x] for x in made[0].columns[2:]] for p in m.select(made[0].columns).collect()} for m in made)
    assert set(whole) == set(tiled) and {s for s, _ in whole} == {"a", "b"}
    assert all(whole[k] == pytest.approx(tiled[k]) for k in whole)
