"""Regions over tiles against one array; rate limits and nested documents with awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeline.operators import records, regions
from plumeline.operators.image import label_components


def as_mask(spark, masks):
    rows = [(s, int(r), int(c), "x") for s, m in masks.items() for r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "scene_id string, r int, c int, own string")


@pytest.mark.parametrize("tile", [4, 64])
def test_tiles_equal_one_array(spark, tile):
    draw = np.random.default_rng(4)
    masks = {"sparse": draw.random((40, 37)) < 0.3, "full": np.ones((19, 23), bool), "dense": draw.random((33, 21)) < 0.55}
    snake = np.zeros((31, 31), bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks["snake"] = snake  # one thin region through all tiles
    px = as_mask(spark, masks)
    got = regions.labelled(px.union(px.limit(5)).union(px.limit(1).withColumn("scene_id", F.lit(None).cast("string"))), tile).collect()
    assert len(got) == sum(m.sum() for m in masks.values())
    for s, m in masks.items():
        lab = label_components(m)
        first = {k: min((r << 32) | c for r, c in zip(*(x.tolist() for x in np.nonzero(lab == k)), strict=True)) for k in range(1, lab.max() + 1)}
        assert all(r.label == first[lab[r.r, r.c]] for r in got if r.scene_id == s)


def test_held_regions_and_figures(spark):
    m = np.zeros((12, 30), bool)
    m[2, 1:26], m[8:11, 5:8] = True, True
    px = as_mask(spark, {"s": m})
    strong = spark.createDataFrame([("s", 2, 20), ("s", 11, 29)], "scene_id string, r int, c int")
    assert {(r.r, r.c) for r in regions.held(px, strong, tile=8).collect()} == {(2, c) for c in range(1, 26)}
    values = px.select("scene_id", "r", "c", (-F.col("c")).cast("double").alias("db"))
    line, block = sorted(regions.region_figures(regions.labelled(px, 8), values).collect(), key=lambda r: r.label)
    assert (line.n_px, line.r0, line.r1, line.c0, line.c1, line.mean, line.low, line.fill) == (25, 2, 2, 1, 25, -13.0, -25.0, 1.0)
    assert line.elongation == pytest.approx(np.sqrt(np.var(np.arange(25)) * 12)) and block.elongation == pytest.approx(1)
    assert regions.labelled(px.where("false")).count() == 0


def brute_limited(rows, most, window):
    out, passed = [], {}
    for who, t, k in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        mine = passed.setdefault(str(who), [])
        ok = sum(t - p <= window for p in mine) < most
        mine += [t] * ok
        out.append((str(who), t, k, ok))
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("most", [1, 5])
def test_limits_with_null_clients_ties_and_clashing_names(spark, kind, most):
    draw = np.random.default_rng(8)
    rows = [(None if w == 3 else w, float(t), k) for k, (w, t) in enumerate(zip(draw.integers(0, 4, 400).tolist(), draw.integers(0, 2500, 400).tolist(), strict=True))]
    rows += [(None, 7.0, 1000 + k) for k in range(9)] + [(1, float(t), 2000 + t) for t in range(0, 400, 3)]
    given = spark.createDataFrame([(None if w is None else str(w) if kind == "string" else w, t, k, True, 1) for w, t, k in rows], f"client {kind}, at_s double, `k k` long, accepted boolean, who long")
    got = records.limited(given.repartition(3), most=most)
    assert got.columns == ["client", "at_s", "k k", "who", "accepted"]
    assert sorted((str(r.client), r.at_s, r["k k"], r.accepted) for r in got.collect()) == brute_limited(rows, most, 60.0)


def test_limits_of_hits_without_a_time(spark):
    given = spark.createDataFrame([("a", None), ("a", 1.0)], "client string, at_s double")
    assert {(r.at_s, r.accepted) for r in records.limited(given).collect()} == {(None, None), (1.0, True)}
    assert records.limited(given.where("false")).count() == 0


def test_placeholders_of_malformed_and_awkward_documents(spark):
    docs = {1: '{"a": TODO', 2: None, 3: "", 4: '"a TODO"', 5: '[[], {}, null, 3, ["TODO"]]', 6: '{"x.y": {"TODO": "no"}, "z": "TODO", "_n": {"z": "TODO"}}', 7: '{"a": null, "b": [{"c": ["", "TODO"]}]}'}
    given = spark.createDataFrame([(k, v, "p", 5) for k, v in docs.items()], "case_id int, body string, path string, key int")
    got = records.placeholders(given)
    assert got.columns == ["case_id", "key", "path"]
    assert sorted((r.case_id, r.path) for r in got.collect()) == [(4, ""), (5, "[4][0]"), (6, "z"), (7, "b[0].c[1]")]
    assert records.placeholders(given.where("false")).count() == 0


def test_many_small_tiles_share_one_call(spark):
    import numpy as np
    import pyarrow as pa

    from plumeline.operators import regions

    px = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("scene_id"), F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (1, 1), (3, 5), (3, 6), (0, 0))))).alias("p")).select("scene_id", "p.*")
    made = regions.labelled(px, tile=4)
    sizes = made.groupBy("scene_id", "label").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert [(r["count"], r.n) for r in sizes] == [(2, 6000)]
    told = [pa.record_batch({"k": pa.array(x)}) for x in ([1.0, 1.0], [], [1.0, None, None], [float("nan"), float("nan"), 2.0])]
    assert [(t.num_rows, at.tolist()) for t, at in regions.whole_groups(iter(told), ["k"])] == [(3, [0]), (4, [0, 2]), (1, [0])]
    r, c = np.array([0, 1, 0]), np.array([3, 4, 3])
    assert regions.joined_places(np.array([0, 0, 1]), r, c, 8).tolist() == [0, 0, 2]
