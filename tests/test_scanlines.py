"""Scan lines against the crossing test of each pixel."""

import random

from plumeline.operators import scanlines

SCENES = "scene_id string, rows int, cols int, west double, south double, east double, north double"
RINGS = "scene_id string, ring_id long, ring array<struct<lon:double,lat:double>>, c int"


def inside(ring, x, y):
    n = 0
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]):
            n += 1
    return n % 2 == 1


def test_pixels_equal_the_crossing_test(spark):
    """Rings that cross themselves, closed ones, points on centres, level edges, parts outside the scene."""
    draw = random.Random(6)
    size = {"a": (17, 23, -95.0, 28.0, -93.0, 30.0), "b": (8, 8, 0.0, 0.0, 8.0, 8.0)}
    rings = [("a", k, [(draw.uniform(-95.5, -92.5), draw.uniform(27.5, 30.5)) for _ in range(draw.randint(3, 15))]) for k in range(30)]
    square = [(1.5, 1.5), (5.5, 1.5), (5.5, 5.5), (1.5, 5.5)]
    rings += [("b", 100, square), ("b", 101, square + square[:1]), ("b", 102, [(-9.0, -9.0), (20.0, -9.0), (20.0, 20.0), (-9.0, 20.0)]), ("b", 103, [(draw.randint(0, 8) + 0.5, draw.randint(0, 8) + 0.5) for _ in range(9)]), ("b", 104, [(20.0, 20.0), (21.0, 20.0), (21.0, 21.0)])]
    bad = [("b", 200, square[:2]), ("b", 201, None), ("b", 202, [(1.0, 1.0), (None, 2.0), (3.0, 9.0)]), ("none", 203, square), (None, 204, square)]
    r = spark.createDataFrame([(s, k, None if ring is None else [{"lon": x, "lat": y} for x, y in ring], 1) for s, k, ring in rings + bad], RINGS)
    s = spark.createDataFrame([(k, *v) for k, v in size.items()] + [("b", *size["b"]), ("flat", 0, 3, 0.0, 0.0, 1.0, 1.0)], SCENES)
    got = [(p.scene_id, p.ring_id, p.r, p.c) for p in scanlines.burned(r, s).collect()]
    want = set()
    for name, k, ring in rings:
        rows, cols, west, south, east, north = size[name]
        dy, dx = (north - south) / rows, (east - west) / cols
        want |= {(name, k, i, j) for i in range(rows) for j in range(cols) if inside(ring, west + (j + 0.5) * dx, north - (i + 0.5) * dy)}
    assert len(got) == len(set(got)) and set(got) == want
    assert scanlines.burned(r.where("false"), s).count() == 0 == scanlines.burned(r, s.where("false")).count()
