"""Figures of very large groups: no task takes a whole group, and the results are those of one sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import drift, evaluate, grid as G, image


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles_of_large_groups(spark):
    draw = np.random.default_rng(3)
    values = {"a": [*draw.normal(0, 3, 400), -1e-9, 0.0, 0.0, 1e300], "b": [2.0] * 50 + [5.0], "c": [7.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("void", None)], "k string, x double")
    got = {r.k: (r.lo, r.mid) for r in G.percentiles(df, ["k"], "x", {"lo": 0.02, "mid": 0.5}).collect()}
    assert set(got) == set(values)
    assert all(got[k] == pytest.approx((np.quantile(v, 0.02), np.median(v))) for k, v in values.items())
    assert "_p" in plan(G.weighted_percentile(df.withColumn("w", F.lit(1.0)), ["k"], "x", "w", {"m": 0.5}))


def test_weighted_percentiles_equal_one_sort(spark):
    draw = np.random.default_rng(4)
    rows = [("a", float(x), float(w)) for x, w in zip(draw.integers(-40, 40, 500), draw.integers(0, 5, 500), strict=True)] + [("b", 3.0, 2.0)]
    got = {r.k: (r.p, r.q) for r in G.weighted_percentile(spark.createDataFrame(rows, "k string, x double, w double"), ["k"], "x", "w", {"p": 0.5, "q": 0.9}).collect()}
    for k in "ab":
        own = sorted((x, w) for a, x, w in rows if a == k)
        total, want = sum(w for _, w in own), []
        for share in (0.5, 0.9):
            run, before = 0.0, None
            for x, w in own:
                if run + w >= share * total:
                    want.append(x if before is None else before + (share * total - run) / w * (x - before))
                    break
                run, before = run + w, x
        assert got[k] == pytest.approx(tuple(want))


def test_pixels_of_one_scene_are_not_sorted(spark):
    px = spark.range(300).select(F.lit("s").alias("scene_id"), F.when(F.col("id") > 2, F.col("id").cast("double")).alias("db"))
    n = image.normalise(px)
    x = sorted(r.x for r in n.where("x is not null").collect())
    v = np.arange(3, 300.0)
    z = (v - np.median(v)) / (1.4826 * np.median(np.abs(v - np.median(v))) + 1e-6)
    assert n.count() == 300 and x == pytest.approx(list(np.clip(z, -6, 6) / 6))
    assert "percentile" not in plan(n) and "median" not in plan(n)


def test_models_are_counted_not_windowed(spark):
    d = spark.createDataFrame([("c", "a", 1), ("c", "a", 2), ("c", "b", 3), ("e", "a", 4), (None, "a", 5)], "case_id string, model string, pid int")
    got = drift.pool_models(d)
    assert {r.pid: r.w for r in got.collect()} == {1: 0.25, 2: 0.25, 3: 0.5, 4: 1.0, 5: 1.0}
    assert "collect_set" not in plan(got)


def test_a_run_holds_the_wanted_steps_alone():
    move = lambda x, y, t: (np.ones_like(x), np.zeros_like(y))
    start = np.array([-94.0, -93.0]), np.array([28.0, 29.0])
    whole = drift.integrate(*start, 0.0, 900.0, 12, move)
    few = drift.integrate(*start, 0.0, 900.0, 12, move, kept={0, 5, 11})
    assert all(b.shape == (3, 2) and (a[[0, 5, 11]] == b).all() for a, b in zip(whole, few, strict=True))


def test_ablations_are_counted_from_a_row_a_candidate(spark):
    rows = [("c", "x", "gap", 1.0), ("c", "x", "proximity", 0.5), ("c", "y", "gap", None), ("d", "x", "parity", 2.0), ("d", "z", None, 3.0)]
    c = spark.createDataFrame(rows, "case_id string, mmsi string, component string, value double")
    got = {r["without"]: (r.n, r.total) for r in evaluate.ablation_totals(c, F.col("value")).collect()}
    want = {r["without"]: (r.n, r.total) for r in evaluate.ablations(c).groupBy("without").agg(F.countDistinct("case_id", "mmsi").alias("n"), F.sum("value").alias("total")).collect()}
    assert got == want


def test_masks_are_closed_by_tiles(spark):
    from plumeline.operators import records

    draw = np.random.default_rng(6)
    m = draw.random((2, 40, 50)) < 0.2
    g, r, c = np.nonzero(m)
    df = spark.createDataFrame([(int(a), int(b), int(d)) for a, b, d in zip(g, r, c, strict=True)] + [(0, 45, 3), (0, None, 3)], "scene_id int, r long, c long")
    scenes = spark.createDataFrame([(0, 40, 50), (1, 40, 50), (2, 9, 9)], "scene_id int, rows int, cols int")
    shut = records.close_mask(df, scenes, 7)
    assert {tuple(p) for p in shut.collect()} == {(k, int(y), int(x)) for k in (0, 1) for y, x in zip(*np.nonzero(image.closed(m[k], 7)), strict=True)}
    assert "FlatMapGroupsInArrow" in plan(shut) and dict(shut.dtypes)["r"] == "bigint"
