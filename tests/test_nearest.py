"""Nearest vertices by levels of cells and contacts of many scenes, against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumeline.operators import dark, nearest


def km(lon1, lat1, lon2, lat2):
    a, b, c, d = map(math.radians, (lon1, lat1, lon2, lat2))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def tables(spark, points, vertices):
    p = spark.createDataFrame(points, "case_id string, pid_ long, lon double, lat double")
    return p, spark.createDataFrame(vertices, "case_id string, vlon double, vlat double, cx long, d string")


def test_nearest_equals_brute_force(spark):
    """Places over the date line, by the pole, in clusters and far from all points; names that the search itself uses."""
    rng = random.Random(3)
    points, vertices = [], []
    for case, (x, y, s) in {"a": (-94.0, 29.0, 1.0), "line": (180.0, 10.0, 2.0), "pole": (0.0, 88.0, 1.9), "world": (0.0, 0.0, 85.0)}.items():
        spread = lambda s=s: rng.uniform(-s, s)
        points += [(case, len(points) + k, (x + spread() + 180) % 360 - 180, y + spread()) for k in range(40)]
        vertices += [(case, (x + spread() + 180) % 360 - 180, y + spread(), k, str(k % 3)) for k in range(300)]
        vertices += [(case, x + 1e-4 * k - (360 if x + 1e-4 * k >= 180 else 0), y, 1000 + k, "dense") for k in range(100)]
    p, v = tables(spark, points, vertices)
    got = {(r.case_id, r.pid_): (r.near_km, r.cx, r.d) for r in nearest.nearest_vertex(p, v, ["case_id", "pid_"], ["cx", "d"]).collect()}
    for case, pid, lon, lat in points:
        want = min((km(lon, lat, a, b), cx, d) for c, a, b, cx, d in vertices if c == case)
        assert got[case, pid][0] == pytest.approx(want[0], abs=1e-7) and got[case, pid][1:] == want[1:]
    assert len(got) == len(points)


def test_pairs_stay_far_below_the_product(spark):
    """A dense far cluster is met by few of its places, from each point."""
    points = [("c", k, -94 + 0.01 * k, 28.0) for k in range(100)]
    vertices = [("c", -90 + 0.001 * (k % 50), 30 + 0.001 * (k // 50), k, "") for k in range(2500)]
    p, v = tables(spark, points, vertices)
    pairs = nearest.nearest_pairs(p, v, ["pid_"], ["cx"])
    assert pairs.select("pid").distinct().count() == 100
    assert pairs.count() < 100 * 2500 / 20


def test_nearest_of_awkward_rows(spark):
    """Ties go to the least by columns; repeats, nulls, no place and no vertices."""
    p, v = tables(spark, [("c", 1, 0.0, 0.0), ("c", 1, 0.0, 0.0), ("c", None, 0.0, 1.0), ("c", 3, None, 0.0), ("c", 4, float("nan"), 0.0), ("empty", 5, 0.0, 0.0), (None, 6, 0.0, 0.0)], [("c", 1.0, 0.0, 7, "b"), ("c", -1.0, 0.0, 7, "a"), ("c", -1.0, 0.0, 9, "a"), ("c", None, 0.0, 1, ""), ("c", 0.0, float("nan"), 0, "")])
    got = {r.pid_: (r.cx, r.d) for r in nearest.nearest_vertex(p, v, ["pid_"], ["cx", "d"]).collect()}
    assert got == {1: (7, "a"), None: (7, "a")}
    assert nearest.nearest_vertex(p, v.where("false"), ["pid_"], ["cx"]).count() == 0
    assert nearest.nearest_vertex(p.where("false"), v, ["pid_"], ["cx"]).count() == 0


def test_contacts_of_scenes_equal_one_scene_at_a_time(spark):
    """Fixes at the instant, silences beyond reach, first and last fixes, the date line, placed vessels."""
    rng = random.Random(5)
    rows = []
    for m in range(12):
        x, t = (179.5 if m % 4 == 0 else -94.0) + rng.uniform(-0.4, 0.4), 0
        for _ in range(12):
            t += rng.choice((10, 30, 60, 200, 400))
            x += rng.uniform(-0.2, 0.2)
            rows.append((f"{m}", t, (x + 180) % 360 - 180, 29 + rng.uniform(-0.3, 0.3)))
    p = spark.createDataFrame(rows, "mmsi string, m int, lon double, lat double")
    clock = lambda c: F.timestamp_micros(F.lit(1704067200000000) + F.col(c).cast("long") * 60000000)
    p = p.select("mmsi", clock("m").alias("ts"), "lon", "lat")
    fixes = [rng.choice(rows) for _ in range(60)]
    contacts = [(k, (r[2] + rng.uniform(-0.5, 0.5) + 180) % 360 - 180, r[3] + rng.uniform(-0.5, 0.5), r[1] + rng.choice((0, 0, 5, 60, 100))) for k, r in enumerate(fixes)]
    contacts += [(900 + k, r[2], r[3], r[1]) for k, r in enumerate(fixes[:10])]
    c = spark.createDataFrame(contacts, "contact_id long, lon double, lat double, m int").withColumn("t0", clock("m")).drop("m")
    placed = spark.createDataFrame([("1", -94.0, 29.0, contacts[0][3]), ("2", contacts[3][1], contacts[3][2], contacts[3][3])], "mmsi string, lon double, lat double, m int").withColumn("t0", clock("m")).drop("m")
    got = {r.contact_id: r.n_vessels for r in dark.match_scene_contacts(c, placed, p).collect()}

    def bound(a, b):
        return 25.0 if a is None or b is None else min(25.0, max(6.0, km(a[2], a[3], b[2], b[3]) / 1.852 / ((b[1] - a[1]) / 60) * 1.5))

    want = {}
    for k, x, y, t in contacts:
        fixed = {"1": (-94.0, 29.0)} if t == contacts[0][3] else {}
        fixed |= {"2": contacts[3][1:3]} if t == contacts[3][3] else {}
        n = 0
        for m in {r[0] for r in rows}:
            if m in fixed:
                n += km(*fixed[m], x, y) <= 1
                continue
            track = sorted(r for r in rows if r[0] == m)
            track.sort(key=lambda r: r[1])
            i = max((j for j, r in enumerate(track) if 0 <= t - r[1] <= 90), default=None)
            j = min((j for j, r in enumerate(track) if 0 <= r[1] - t <= 90), default=None)
            a, b = track[i] if i is not None else None, track[j] if j is not None else None
            if a and b and a is not b:
                n += km(a[2], a[3], x, y) + km(x, y, b[2], b[3]) <= bound(a, b) * 1.852 * (b[1] - a[1]) / 60 + 2
            elif a:
                n += km(a[2], a[3], x, y) <= bound(track[i - 1] if i else None, a) * 1.852 * (t - a[1]) / 60 + 1
            elif b:
                n += km(b[2], b[3], x, y) <= bound(b, track[j + 1] if j + 1 < len(track) else None) * 1.852 * (b[1] - t) / 60 + 1
        want[k] = n
    assert got == want and 0 < sum(v > 0 for v in want.values()) < len(want)


def test_contacts_of_scenes_of_awkward_rows(spark):
    c = spark.sql("select * from values (1L, null, 1D, timestamp'2024-01-01 00:00:00'), (null, 1D, 1D, timestamp'2024-01-01 00:00:00'), (2L, 1D, 1D, null) as t(contact_id, lon, lat, t0)")
    p = spark.sql("select * from values ('1', timestamp'2024-01-01 00:00:00', 1D, 1D), ('1', timestamp'2024-01-01 00:00:00', 1D, 1D), (null, timestamp'2024-01-01 00:00:00', 1D, 1D), ('2', null, 1D, 1D) as t(mmsi, ts, lon, lat)")
    none = p.where("false").select("mmsi", "lon", "lat", F.col("ts").alias("t0"))
    assert {r.contact_id: r.n_vessels for r in dark.match_scene_contacts(c, none, p).collect()} == {1: 0, None: 1, 2: 0}
    assert dark.match_scene_contacts(c.where("false"), none, p).count() == 0
    assert {r.matched for r in dark.match_scene_contacts(c, none, p.where("false")).collect()} == {False}


def test_a_prism_is_found_once_for_an_instant_and_met_pairs_are_counted(spark):
    """Places of an instant meet a row of each vessel there; contacts of one place send no pairs, and no window or join holds whole prisms."""
    when = F.timestamp_micros(F.lit(1704844800000000))
    c = spark.range(40).select(F.col("id").alias("contact_id"), (-94 + F.col("id") * 0.02).alias("lon"), F.lit(29.0).alias("lat"), when.alias("t0"))
    p = spark.range(60).select((F.col("id") % 6).cast("string").alias("mmsi"), F.timestamp_micros(F.lit(1704844800000000) + (F.col("id") - 30) * 600_000_000).alias("ts"), (-94 + (F.col("id") * 7 % 40) * 0.02).alias("lon"), F.lit(29.0).alias("lat"))
    none = p.where("false").select("mmsi", "lon", "lat", F.col("ts").alias("t0"))
    names, held = [], dark.staged
    dark.staged = lambda df, name: names.append(name) or held(df, name)
    try:
        got = {r.contact_id: r.n_vessels for r in dark.match_scene_contacts(c, none, p).collect()}
    finally:
        dark.staged = held
    fixes = dark.scene_fixes(p, when).where("a is not null or b is not null")
    want = c.crossJoin(fixes).where(dark.in_prism(F.col("lon"), F.col("lat"), F.col("t0"))).groupBy("contact_id").count().collect()
    assert {k: n for k, n in got.items() if n} == {r.contact_id: r["count"] for r in want} and want
    assert names == ["places", "instants", "reached", "pairs"]
